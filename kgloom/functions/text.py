"""Names and texts: normalisation, keys, classification. Every function maps columns to a column and stays in the JVM."""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import defaults as D


#: Fixed values of the standard: the first Hangul syllable and the last, the first characters that syllables decompose into, and how many
#: vowels and tails there are (tails: one more than there are characters, as a syllable may have none).
SYLLABLES, LEAD, VOWEL, TAIL, VOWELS, TAILS = (0xAC00, 0xD7A3), 0x1100, 0x1161, 0x11A7, 21, 28


@functools.cache
def accent_table() -> tuple[str, str, dict[str, str]]:
    """Arguments of `translate` that replace each character by what its canonical decomposition leaves without nonspacing
    marks, and those that leave several characters, but for Hangul syllables, which decompose by a rule."""
    single, alone, removed, several = [], [], [], {}
    for c in map(chr, range(sys.maxunicode + 1)):
        if not 0xD800 <= ord(c) <= 0xDFFF and not SYLLABLES[0] <= ord(c) <= SYLLABLES[1] and not c.isascii():
            left = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
            if not left:
                removed.append(c)
            elif len(left) > 1:
                several[c] = left
            elif left != c:
                single.append(c)
                alone.append(left)
    return "".join(single + removed), "".join(alone), several


def _syllable(c: Column) -> Column:
    """A Hangul syllable's two or three characters, by arithmetic on its code point."""
    at = F.ascii(c) - SYLLABLES[0]
    one = lambda first, k: F.substring(F.lit("".join(map(chr, range(first, first + 30)))), (k + 1).cast("int"), F.lit(1))
    tail = at % TAILS
    return F.concat(one(LEAD, F.floor(at / (VOWELS * TAILS))), one(VOWEL, F.floor(at / TAILS) % VOWELS), F.when(tail > 0, one(TAIL, tail)).otherwise(F.lit("")))


def strip_accents(s: Column) -> Column:
    """Canonically decomposed, without nonspacing marks. Texts that have no character of several are translated only."""
    plain, alone, several = accent_table()
    simple = F.translate(s, plain, alone)
    first, last = map(chr, SYLLABLES)
    known = F.create_map(*(F.lit(x) for kv in several.items() for x in kv))
    whole = F.transform(F.split(simple, ""), lambda c: F.when(c.between(first, last), _syllable(c)).otherwise(F.coalesce(F.try_element_at(known, c), c)))
    return F.when(simple.rlike(f"[{first}-{last}{''.join(several)}]"), F.array_join(whole, "")).otherwise(simple)


def normalize(s: Column) -> Column:
    """Lower case, no accents, anything but letters, digits and underscore as one blank, trimmed."""
    plain = F.regexp_replace(strip_accents(F.lower(s)), r"[^\p{L}\p{N}_\s]", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def _tokens(norm: Column) -> Column:
    return F.filter(F.split(norm, " "), lambda t: t != "")


def match_key(name: Column, kind: Column, noise: list[str] | None = None, club: str = "Club") -> Column:
    """The normalised name; for clubs without legal forms."""
    drop = D.CLUB_NOISE if noise is None else noise
    return F.when(kind == club, F.array_join(F.filter(_tokens(normalize(name)), lambda t: ~t.isin(drop)), " ")).otherwise(normalize(name))


def significant_tokens(name: Column, noise: list[str] | None = None) -> Column:
    """The sorted set of tokens of more than two characters that are no noise."""
    drop = D.NAME_NOISE if noise is None else noise
    return F.array_sort(F.array_distinct(F.filter(_tokens(normalize(name)), lambda t: (F.char_length(t) > 2) & ~t.isin(drop))))


def is_youth_team(name: Column, markers: list[str] | None = None) -> Column:
    """The last token is a marker, and no single letter stands before it (`F. C.` is none)."""
    t = _tokens(normalize(name))
    last, before = F.try_element_at(t, F.lit(-1)), F.try_element_at(t, F.lit(-2))
    return F.coalesce(last.isin(D.YOUTH_MARKERS if markers is None else markers) & ~F.coalesce(F.char_length(before) == 1, F.lit(False)), F.lit(False))


def strip_year(name: Column) -> Column:
    """Years and seasons at the end go, with a linking word before them, however many there are."""
    return F.trim(F.regexp_replace(F.trim(name), r"(?:\s+(?:(?:en|de|del)\s+)?\d{4}(?:\s*[-/]\s*\d{2,4})?)+$", ""))


def slugify(title: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one underscore, none at the ends; accents aren't folded."""
    return F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def truncated(text: Column, chars: int = D.DOCUMENT_CHARS) -> Column:
    return F.substring(text, 1, chars)


def year_range(first: Column, last: Column) -> Column:
    """`first-last` without a dangling dash."""
    return F.regexp_replace(F.concat(F.coalesce(first, F.lit("")), F.lit("-"), F.coalesce(last, F.lit(""))), "^-+|-+$", "")


def _word(words: list[str]) -> str:
    return r"\b(?:" + "|".join(words) + r")\b"


def noise_rules(name: Column) -> list[tuple[str, Column]]:
    """Reason classes and their conditions, in order of precedence."""
    n = normalize(name)
    return [
        ("empty", n == ""),
        ("generic", n.isin(D.GENERIC_NAMES)),
        ("sentence", F.char_length(name) > 55),
        ("leading count", name.rlike(r"^\d+\s")),
        ("too many words", F.size(F.filter(F.split(name, r"\s+"), lambda w: w != "")) > 9),
        ("description", n.rlike("^(?:" + "|".join(D.DESCRIPTION_STARTS) + r")\b") | n.rlike("^equipos? de (?:" + "|".join(D.TEAM_OF_WHOM) + r")\b")),
        ("result", n.rlike(r"\b(?:(?:" + "|".join(D.RESULT_STEMS) + r")[\p{L}\p{N}_]*|" + "|".join(D.RESULT_WORDS) + r")\b")),
        ("parenthetical", name.contains("(") | name.contains(")")),
        ("phrase", n.rlike(_word(D.PHRASE_WORDS))),
    ]


def noise_reason(name: Column) -> Column:
    """Why a name is no entity: the first rule that holds, or null for a legitimate name."""
    return F.coalesce(*(F.when(condition, F.lit(reason)) for reason, condition in noise_rules(name)))


def fact(src: Column, rel: Column, dst: Column) -> Column:
    """An edge as text in its stored direction; null if any part is."""
    return F.concat(src, F.lit(" -"), rel, F.lit("-> "), dst)


def contains_words(text_norm: Column, name_norm: Column) -> Column:
    """Whether normalised words stand in a normalised text, at word borders."""
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    return F.contains(pad(text_norm), pad(name_norm))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def length(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, length_a: Column | None = None, length_b: Column | None = None) -> Column:
    """Cosine similarity of two arrays; null where one is null or has no length. Lengths may be given, if known."""
    product = (length(a) if length_a is None else length_a) * (length(b) if length_b is None else length_b)
    return F.when(product > 0, dot(a, b) / product)
