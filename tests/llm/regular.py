"""Words whose letters follow the parity of the ones in a place's number: sums of values times powers can't tell these from
their counterparts with both letters exchanged."""


def regular(n, letters="ab"):
    return "".join(letters[i.bit_count() & 1] for i in range(n))


def both(n):
    return [regular(n), regular(n, "ba")]
