"""Pieces of SQL shared by the checks (DuckDB dialect)."""

from __future__ import annotations

from ..functions.text import NON_SPACE, WORD
from ..functions.wordlists import ENGLISH_STOPWORDS


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def literals(words) -> str:
    return ", ".join(literal(w) for w in words)


STOP = "[" + literals(ENGLISH_STOPWORDS) + "]"
WORDS = literal(WORD)
CHUNKS = literal(NON_SPACE)


def tokens(text: str) -> str:
    return f"regexp_extract_all(lower({text}), {WORDS})"


def no_punctuation(text: str) -> str:
    return f"regexp_replace({text}, '[[:punct:]]', '', 'g')"


def no_stopwords(text: str) -> str:
    return (f"array_to_string(list_filter(regexp_extract_all({text}, {CHUNKS}), "
            f"lambda w: NOT list_contains({STOP}, lower(w))), ' ')")


def cleaned(text: str, short: bool = True) -> str:
    t = no_stopwords(f"regexp_replace({no_punctuation(f'lower({text})')}, '[0-9]', '', 'g')")
    return f"array_to_string(list_filter({tokens(t)}, lambda w: length(w) >= 3), ' ')" if short else t


def normalised(text: str, contractions: bool = True, keep: str = "") -> str:
    t = f"regexp_replace({text}, '[^A-Za-z0-9(),!?''`{keep}]', ' ', 'g')"
    if contractions:
        for e in ("'s", "'ve", "n't", "'re", "'d", "'ll"):
            t = f"replace({t}, {literal(e)}, {literal(' ' + e)})"
    for m in (",", "!", "(", ")", "?"):
        t = f"replace({t}, '{m}', ' {m} ')"
    return f"lower(trim(regexp_replace({t}, '\\s{{2,}}', ' ', 'g')))"
