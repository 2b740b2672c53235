"""Lexicons whose words occur in the base tables, and SQL fragments built from lists."""

KEYWORDS = ["worthless", "pathetic", "stupid", "idiot", "loser", "token", "license", "free", "rating", "enter"]
KEYWORD_TYPES = [
    ("insult", ["worthless", "pathetic", "stupid"]), ("secret", ["token"]), ("legal", ["license", "rating"])]
SLANG_WORDS = ["tear", "only"]
SLANG = {"the": "teh", "that thing": "thing", "and": "n", "of": "o", "nicht": "net", "que": "k"}
URGENCY = ["worthless", r"path.*tic", r"token\s*=", r"[0-9]{16}", "license", "rating"]
ACTIONS = ["idiot", "stupid", r"[0-9]+@mail"]
LINKS = [r"mail[0-9]\.example", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", r"\+1 \(", "@"]
INTENTS = [
    ("abuse", 0.9, ["worthless", "pathetic", "stupid", "idiot", "loser"]),
    ("credential", 0.95, [r"token\s*=", r"[0-9]{16}", r"[0-9]+@mail"]),
    ("legal", 0.5, ["license", "free", "rating"]),
    ("pressure", 0.7, ["thing", "only", "enter", "rest"]),
]
DOMAINS = [
    ("secrets", r"token\s*="), ("contact", r"@|\+1 \("),
    ("network", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"),
    ("abuse", "worthless|pathetic|idiot|loser"), ("legal", "license"),
]


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_count_patterns(col: str, patterns) -> str:
    return "(" + " + ".join(f"regexp_matches({col}, {quoted(p)})::int" for p in patterns) + ")"


def sql_count_words(col: str, words) -> str:
    return "(" + " + ".join(f"contains({col}, {quoted(w)})::int" for w in words) + ")"


def sql_words(col: str, words) -> str:
    """The list words contained in the column, joined by commas."""
    inner = ", ".join(quoted(w) for w in words)
    return f"array_to_string(list_filter([{inner}], lambda k: contains({col}, k)), ',')"


def dbl(value: float) -> str:
    return f"'{value!r}'::double"
