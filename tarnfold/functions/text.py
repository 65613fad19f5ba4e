"""Text functions as column expressions: index tokens, query terms, BM25, hashes, row text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "㐀-鿿"
RUNS = f"[{CJK}]+|[a-zA-Z0-9_]+"
# The code points whose case folding differs from their lower case in index tokens.
FOLDED = {
    "ß": "ss", "ŉ": "ʼn", "ſ": "s", "ǰ": "ǰ", "ẖ": "ẖ", "ẗ": "ẗ", "ẘ": "ẘ", "ẙ": "ẙ", "ẚ": "aʾ", "ẞ": "ss",
    "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st",
}
# These, and the other letters whose lower case has an ASCII letter in it.
LETTERS = {**FOLDED, "\u0130": "i\u0307", "\u212a": "k"}
#: Stands between the tokens of a row that are written as one string; tokens that hold it are left out.
SEPARATOR = "\0"


def fold_ascii(c: Column) -> Column:
    """A-Z as a-z, all else as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def casefolded(c: Column) -> Column:
    """Lower case in which the seventeen letters above are folded as well."""
    singles = {k: v for k, v in FOLDED.items() if len(v) == 1}
    out = F.translate(c, "".join(singles), "".join(singles.values()))
    for k, v in FOLDED.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return F.lower(out)


def _pairs(run: Column) -> Column:
    n = F.length(run)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(run, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def _letters(run: Column) -> Column:
    return F.filter(F.split(run, ""), lambda x: x != "")


def tokens(c: Column) -> Column:
    """Index tokens in order: CJK runs as single characters then pairs, words split at underscores."""
    runs = F.regexp_extract_all(casefolded(c), F.lit(f"({RUNS})"), F.lit(1))
    each = F.transform(
        runs,
        lambda r: F.when(r.rlike(f"^[{CJK}]"), F.concat(_letters(r), _pairs(r))).otherwise(F.filter(F.split(r, "_"), lambda w: w != "")),
    )
    return F.coalesce(F.flatten(each), F.array().cast("array<string>"))


def index_tokens(c: Column) -> Column:
    """The same tokens by the shortest way: ASCII text needs no case folding, text without CJK one expression."""

    def latin(folded):
        return F.regexp_extract_all(folded, F.lit("([a-z0-9]+)"), F.lit(1))

    is_ascii = F.octet_length(c) == F.char_length(c)
    found = F.when(is_ascii, latin(F.lower(c))).when(c.rlike(f"[{CJK}]"), tokens(c)).otherwise(latin(casefolded(c)))
    return F.coalesce(found, F.array().cast("array<string>"))


def has_cjk(c: Column) -> Column:
    """Whether a text has CJK; in all others the index tokens are runs of ASCII letters and digits, once ``LETTERS`` are replaced."""
    return (F.octet_length(c) != F.char_length(c)) & c.rlike(f"[{CJK}]")


def path_grams(c: Column) -> Column:
    """Runs of three characters of a path (A-Z as a-z), and of CJK runs the single characters and pairs."""
    folded = fold_ascii(c)
    n = F.char_length(folded)
    threes = F.when(n > 2, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(folded, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))
    short = F.flatten(F.transform(F.regexp_extract_all(folded, F.lit(f"([{CJK}]+)"), F.lit(1)), lambda r: F.concat(_letters(r), _pairs(r))))
    return F.coalesce(F.concat(threes, short), F.array().cast("array<string>"))


def query_grams(query: str) -> list[str]:
    """The grams that every path with ``query`` in it has; none for a query too short to have any, or with none that is written."""
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in query)
    if len(folded) > 2:
        return sorted({g for i in range(len(folded) - 2) if SEPARATOR not in (g := folded[i : i + 3])})
    return [folded] if re.fullmatch(f"[{CJK}]{{1,2}}", folded) else []


def query_phrases(query: str) -> list[list[str]]:
    """Distinct phrases of a query, each as the token run that a document must hold."""
    found: dict[str, list[str]] = {}
    for run in re.findall(RUNS, query.casefold()):
        if "㐀" <= run[0] <= "鿿":
            parts = [run[i : i + 2] for i in range(len(run) - 1)] if len(run) > 1 else [run]
            found.update((p, [p]) for p in parts)
        elif split := [w for w in run.split("_") if w]:
            found[run] = split
    return list(found.values())


def phrase_count(tokens: Column, phrase: list[str]) -> Column:
    """How often the phrase occurs as adjacent tokens."""
    if len(phrase) == 1:
        return F.size(tokens) - F.size(F.array_remove(tokens, phrase[0]))
    width = len(phrase)
    wanted = F.array(*[F.lit(p) for p in phrase])
    starts = F.when(F.size(tokens) >= width, F.sequence(F.lit(1), F.size(tokens) - (width - 1))).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(starts, lambda i: F.slice(tokens, i, width) == wanted))


def bm25_term(tf: Column, rows_with: Column, rows: Column, length: Column, average: Column) -> Column:
    """One phrase's share of the score; the more negative the sum, the better the row."""
    odds = (rows - rows_with + F.lit(0.5)) / (rows_with + F.lit(0.5))
    idf = F.when(F.log(odds) > 0, F.log(odds)).otherwise(F.lit(1e-6))
    return -idf * tf * F.lit(2.2) / (tf + F.lit(1.2) * (F.lit(0.25) + F.lit(0.75) * length / average))


def row_text(columns: list[str], cell: int = 12_001, record: int = 12_000) -> tuple[Column, Column]:
    """``name: value`` lines of the non-null columns, and whether anything was cut off."""
    parts = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.substring(F.col(c).cast("string"), 1, cell))) for c in columns]
    whole = F.concat_ws("\n", *parts)
    long_cell = [F.coalesce(F.length(F.col(c).cast("string")) >= cell, F.lit(False)) for c in columns]
    cut = F.length(whole) > record
    for x in long_cell:
        cut = cut | x
    return F.substring(whole, 1, record), cut


def extension_of(name: Column) -> Column:
    """The last suffix of a file name in lower case, empty if there is none."""
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))
