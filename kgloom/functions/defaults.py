"""Word lists and schema of the domain. All of them are parameters of the functions that use them."""

# Legal forms and initials that don't tell one club from another.
CLUB_NOISE = ["a", "c", "f", "d", "r", "s", "u", "ac", "fc", "cf", "cd", "ud", "sc", "sl", "rcd", "afc", "acf", "usc", "football", "club", "calcio"]

# Normalised names that are no entities.
GENERIC_NAMES = [
    "el", "la", "los", "las", "un", "una", "club", "competicion", "entrenador", "entrenadores", "jugador", "jugadores", "seleccion", "liga", "ligas",
    "copa", "copas", "campeonato", "campeonatos", "titulos", "unknown", "n/a", "na", "none", "null", "actualmente", "se convirtio", "su padre",
    "temporada", "equipo", "equipos", "partido", "partidos",
]

# First words of descriptions, words and stems of results, and prepositions or times that mark a phrase.
DESCRIPTION_STARTS = ["partido", "partidos", "generacion", "mejor", "mejores", "personalidad", "campeona"]
TEAM_OF_WHOM = ["su", "mi", "la", "el", "los"]
RESULT_STEMS, RESULT_WORDS = ["subcampeon", "clasificad"], ["puesto", "posicion", "rendimiento"]
PHRASE_WORDS = ["contra", "frente", "para", "desde", "hasta", "durante", "tras", "segun", "historia", "epoca", "temporada"]

# Words that don't tell one team from another when names of two sources are compared.
NAME_NOISE = [
    "a", "b", "c", "d", "f", "r", "s", "u", "ac", "fc", "cf", "cd", "ud", "sc", "sl", "sd", "rcd", "afc", "acf", "usc", "fsv", "ssd", "football", "futbol",
    "futebol", "fussball", "calcio", "soccer", "club", "clube", "kulubu", "sports", "sportiva", "sporting", "societa", "association", "associazione",
    "seleccion", "nacional", "equipo", "unione", "union", "deportivo", "deportiva", "atletico", "athletic", "de", "del", "la", "las", "los", "el",
]

# Last words of a youth or second team.
YOUTH_MARKERS = ["atletic", "ii", "iii", "b", "c", "sub19", "sub21", "sub23", "juvenil", "inferiores", "juniors"]

# Entity types in order of declaration, typed relations, and the subset used for paths.
ENTITY_TYPES = ["Entrenador", "Jugador", "Club", "Seleccion", "Competicion", "EstiloJuego"]
PERSON_TYPES = ["Entrenador", "Jugador"]
TYPED_RELATIONS = [
    ("Entrenador", "ENTRENO_A", "Club"),
    ("Entrenador", "ENTRENO_A", "Seleccion"),
    ("Entrenador", "INFLUYO_EN", "Entrenador"),
    ("Entrenador", "FUE_ASISTENTE_DE", "Entrenador"),
    ("Entrenador", "PRACTICA", "EstiloJuego"),
    ("Jugador", "JUGO_EN", "Club"),
    ("Jugador", "ENTRENADO_POR", "Entrenador"),
    ("Club", "GANO", "Competicion"),
    ("Entrenador", "GANO_COMO_ENTRENADOR", "Competicion"),
    ("Jugador", "GANO_COMO_JUGADOR", "Competicion"),
]
CAREER_RELATIONS = ["ENTRENO_A", "JUGO_EN", "ENTRENADO_POR", "INFLUYO_EN", "FUE_ASISTENTE_DE"]
DOMAIN_RELATIONS = [*CAREER_RELATIONS, "GANO", "GANO_COMO_ENTRENADOR", "GANO_COMO_JUGADOR", "PRACTICA"]

# Sizes and limits.
CHUNK_SIZE, CHUNK_OVERLAP, SEPARATORS, DOCUMENT_CHARS = 1500, 200, ["\n\n", "\n", ". ", " "], 8000
TOP_K, MIN_ENTITY_LENGTH, MAX_FACTS, MAX_CHUNK_FACTS, MAX_HOPS = 4, 4, 60, 30, 6
SEARCH_HINTS = ["futbol", "fútbol", "entrenador", "football", "soccer"]
