"""SQL twins of the text functions, for comparing results in DuckDB."""

from __future__ import annotations

from millrace.functions import routing
from millrace.functions.text import LIGATURES, STOPWORDS, fold_map


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(ws: list[str]) -> str:
    return ", ".join(map(quoted, ws))


def clean(x: str) -> str:
    for pattern, to in ((r"\r\n?", "chr(10)"), (r"[\x{2018}\x{2019}\x{201b}]", "''''"), (r"[\x{201c}\x{201d}]", "'\"'"), (r"[\x{2013}\x{2014}]", "'-'"), (r"\x{a0}", "' '"), (r"[ \t]+", "' '"), (r" ?\n ?", "chr(10)"), (r"\n{3,}", "chr(10) || chr(10)"), (r"^\s+|\s+$", "''")):
        x = f"regexp_replace({x}, '{pattern}', {to}, 'g')"
    return x


def fold(x: str) -> str:
    src, dst = fold_map()
    x = f"translate({x}, {quoted(src)}, {quoted(dst)})"
    for sign, letters in LIGATURES.items():
        x = f"replace({x}, '{sign}', '{letters}')"
    return f"regexp_replace({x}, '[\\x{{300}}-\\x{{36f}}]', '', 'g')"


def tokens(x: str) -> str:
    return f"regexp_extract_all({fold(f'lower({x})')}, '[a-z0-9]+(?:[''-][a-z0-9]+)*')"


def content(x: str) -> str:
    return f"list_filter({tokens(x)}, lambda t: t NOT IN ({words(STOPWORDS)}) AND length(t) > 1)"


def terms(x: str) -> str:
    return f"list_filter({content(x)}, lambda t: t NOT IN ({words(routing.NOISE)}))"


def stem(t: str) -> str:
    return (
        f"CASE WHEN length({t}) > 4 AND {t} LIKE '%ies' THEN left({t}, -3) || 'y'"
        f" WHEN length({t}) > 4 AND regexp_matches({t}, '(ches|shes|xes|sses|zes)$') THEN left({t}, -2)"
        f" WHEN length({t}) > 4 AND {t} LIKE '%s' AND {t} NOT LIKE '%ss' AND {t} NOT LIKE '%us' THEN left({t}, -1)"
        f" WHEN length({t}) > 5 AND {t} LIKE '%ing' THEN left({t}, -3)"
        f" WHEN length({t}) > 4 AND {t} LIKE '%ed' THEN left({t}, -2) ELSE {t} END"
    )


def stems(array: str) -> str:
    return f"list_transform({array}, lambda t: {stem('t')})"


def ordered_distinct(array: str) -> str:
    return f"list_filter({array}, lambda x, i: list_position({array}, x) = i)"


def trimmed(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def sentences(x: str) -> str:
    marked = f"regexp_replace({x}, '([.!?])\\s+([A-Z0-9(])', '\\1' || chr(1) || '\\2', 'g')"
    return f"list_transform(regexp_split_to_array({marked}, '\\n+|\\x01'), lambda s: {trimmed('s')})"


def truncate(x: str, n: int) -> str:
    return f"CASE WHEN {x} IS NULL THEN '' WHEN length({x}) <= {n} THEN {x} ELSE regexp_replace(substring({x}, 1, {n - 1}), '\\s+$', '') || '…' END"


def squash(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({x}), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')"
