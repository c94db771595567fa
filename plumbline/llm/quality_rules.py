"""Quality rules on repetition: the share of characters that lie inside repeated n-grams and lines.

Words are mapped to 64-bit codes; polynomial rolling hashes of each n-gram length are computed over
the whole text in numpy, and the n-grams whose hash occurs before are marked. The marks of a length
are spread over the n-gram's words, and the characters of marked words are counted. Whole texts are
read; memory is a few arrays of the longest document's words.

Cases: null and empty texts have no words and fail the base rule; a text of fewer than n words has
no n-grams; repeated rows each get their own result; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from plumbline.llm._common import ship, table

# The largest share of characters in repeated n-grams, by length of n-gram,
# and in repeated lines, that a document may have (published limits for web text).
MAX_DUP_NGRAM_CHARS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
MAX_DUP_LINE_CHARS = 0.20
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_SYMBOLS = b"#*$%&|<>"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SEPARATE = {c: " " for c in (9, 10, 11, 12, 13)}


def coded(words: list[str]) -> np.ndarray:
    """A number for each word, the same for equal words."""
    ids: dict[str, int] = {}
    return np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.uint64, count=len(words))


def rolling(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams, by Horner's rule over shifted arrays; odd multipliers keep 64 bits."""
    mixed = (codes + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    out = mixed[: len(codes) - n + 1].copy()
    for k in range(1, n):
        out *= _MULTIPLIER
        out += mixed[k : len(codes) - n + 1 + k]
    return out


def repeated(hashes: np.ndarray, first: bool) -> np.ndarray:
    """Which hashes occur twice or more; without first, which occur earlier already."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    same = ranked[1:] == ranked[:-1]
    marks = np.zeros(len(hashes), dtype=bool)
    marks[order[1:][same]] = True
    if first:
        marks[order[:-1][same]] = True
    return marks


def spread(marks: np.ndarray, n: int) -> np.ndarray:
    """The words that lie in a marked n-gram."""
    edges = np.zeros(len(marks) + n, dtype=np.int32)
    edges[: len(marks)] += marks
    edges[n:] -= marks
    return np.cumsum(edges)[:-1] > 0


def measured(text: str | None, lengths: tuple[int, ...] = tuple(MAX_DUP_NGRAM_CHARS)) -> dict:
    """Counts and shares of one text."""
    text = text or ""
    words = text.translate(_SEPARATE).split(" ") if text else []
    words = [w for w in words if w]
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    chars = int(sizes.sum())
    codes = coded(words)
    repeat = 0
    if len(words) >= 3:
        repeat = int(spread(repeated(rolling(codes, 3), first=True), 3).sum())
    shares = {}
    for n in lengths:
        shares[n] = float(sizes[spread(repeated(rolling(codes, n), first=False), n)].sum()) / chars if len(words) >= n else 0.0
    seen: set[str] = set()
    dup_lines = dup_chars = line_chars = 0
    for line in text.split("\n"):
        if line.strip(" \t\r\x0b\x0c"):
            line_chars += len(line)
            if line in seen:
                dup_lines += 1
                dup_chars += len(line)
            else:
                seen.add(line)
    raw = text.encode("utf-8", "replace")
    return {
        "n_words": len(words),
        "word_chars": chars,
        "n_symbols": len(raw) - len(raw.translate(None, _SYMBOLS)),
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeat,
        "dup_line_share": dup_chars / line_chars if line_chars else 0.0,
        "dup_ngram_shares": shares,
    }


SCHEMA = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, dup_line_share double, dup_ngram_shares map<int,double>, base_failed boolean, kept boolean"


def judged(x: dict, max_ngram: dict[int, float], max_line: float, min_words: int, max_repeat: int) -> dict:
    failed = x["n_words"] < min_words or 100 * x["n_repeat_words"] > max_repeat * x["n_words"]
    kept = not failed and x["dup_line_share"] <= max_line and all(x["dup_ngram_shares"][n] <= most for n, most in max_ngram.items())
    return x | {"base_failed": failed, "kept": kept}


def repetition(
    docs: DataFrame,
    keep: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    max_ngram: dict[int, float] | None = None,
    max_line: float = MAX_DUP_LINE_CHARS,
    min_words: int = MIN_WORDS,
    max_repeat: int = MAX_REPEAT_PERCENT,
) -> DataFrame:
    """keep, and the columns of SCHEMA for each document."""
    ship(docs.sparkSession)
    limits = MAX_DUP_NGRAM_CHARS if max_ngram is None else max_ngram
    given = docs.select(*keep, text)
    whole = StructType([given.schema[k] for k in keep] + list(StructType.fromDDL(SCHEMA)))
    target = to_arrow_schema(whole)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [judged(measured(t, tuple(limits)), limits, max_line, min_words, max_repeat) for t in b.column(len(keep)).to_pylist()]
            made = [pa.array([list(r[f.name].items()) if f.name == "dup_ngram_shares" else r[f.name] for r in rows], f.type) for f in list(target)[len(keep) :]]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *made], schema=target)

    return given.mapInArrow(work, whole)


def op8_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = repetition(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The same in DuckDB SQL.
ORACLE = f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
split AS (SELECT doc_id, r, t, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM d),
words AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM split),
sizes AS (SELECT r, sum(length(w)) AS chars FROM words GROUP BY r),
grams AS (SELECT r, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM split CROSS JOIN (SELECT unnest([3, 5, 6, 7, 8, 9, 10]) AS n))),
counted AS (SELECT r, n, i, count(*) OVER (PARTITION BY r, n, g) AS k, row_number() OVER (PARTITION BY r, n, g ORDER BY i) AS nth FROM grams),
marks AS (SELECT DISTINCT r, n, unnest(range(i, i + n)) AS i FROM counted WHERE CASE WHEN n = 3 THEN k > 1 ELSE nth > 1 END),
shares AS (SELECT m.r, n, count(*) AS marked, sum(length(w)) / max(chars) AS share FROM marks m JOIN words w ON w.r = m.r AND w.i = m.i JOIN sizes s ON s.r = m.r GROUP BY m.r, n),
lines AS (SELECT r, line, row_number() OVER (PARTITION BY r, line) AS nth FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
line_sums AS (SELECT r, count(*) FILTER (nth > 1) AS dup, coalesce(sum(length(line)) FILTER (nth > 1), 0) / sum(length(line)) AS share FROM lines GROUP BY r),
limits AS (SELECT * FROM (VALUES {", ".join(f"({n}, {most})" for n, most in MAX_DUP_NGRAM_CHARS.items())}) v(n, most)),
over AS (SELECT DISTINCT r FROM shares JOIN limits USING (n) WHERE share > most),
rows AS (SELECT s.doc_id, s.r, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(chars, 0) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(three.marked, 0) AS BIGINT) AS n_repeat_words, coalesce(l.share, 0) AS line_share
  FROM split s LEFT JOIN sizes z ON z.r = s.r LEFT JOIN line_sums l ON l.r = s.r LEFT JOIN shares three ON three.r = s.r AND three.n = 3)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND line_share <= {MAX_DUP_LINE_CHARS} AND r NOT IN (SELECT r FROM over) AS kept FROM rows"""
