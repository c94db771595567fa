"""Benchmark decontamination by a generalised suffix automaton over the words of the test items.

The automaton of all items is built once in a worker process. A document's words stream through it;
at each word it gives the longest suffix read so far that some item contains. Where that length
reaches the window (8 words; a shorter item counts as one window), the words of the window are hit,
and the items of the automaton's state are noted. The walk is skipped over stretches where no two
neighbouring words are neighbours in any item, for there no window can end or begin.

The items go to the executors as a broadcast, in blocks of at most BLOCK_BYTES of text each, one
pass over the documents for each block in the same stage; so the size of a broadcast is bounded
however many items there are.

Cases: null and empty texts have no words; items without words never match; equal items are all
reported, rows of one id once; null item ids are reported as an empty string; an empty table of items hits nothing.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.llm._common import ship, table

WINDOW = 8
#: Text of the items in one broadcast.
BLOCK_BYTES = 8 << 20

#: Word bytes, A-Z lower-cased; all others separate words.
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


#: The same words in the text itself, for their places.
_PLACE = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")


def words_of(text: str | None) -> list[bytes]:
    """Words of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ with A-Z lower-cased."""
    return (text or "").encode("utf-8", "replace").translate(_WORD).split()


class Automaton:
    """A generalised suffix automaton of word sequences."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ids = [i for i, _ in items]
        coded = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words] for _, words in items]
        ends = []
        for seq in coded:
            last = 0
            for c in seq:
                last = self._extend(last, c)
            ends.append(last)
        # The items of a state: each prefix's state, and every state on the way to the root.
        self.items: list[set[int]] = [set() for _ in self.next]
        for k, seq in enumerate(coded):
            at = 0
            for c in seq:
                at = self.next[at][c]
                up = at
                while up > 0 and k not in self.items[up]:
                    self.items[up].add(k)
                    up = self.link[up]
        # Short items by the state that ends with them and their length.
        self.short: dict[int, set[int]] = {}
        self.whole: dict[int, dict[int, set[int]]] = {}
        for k, seq in enumerate(coded):
            if 0 < len(seq) < window:
                at = 0
                for c in seq:
                    at = self.next[at][c]
                self.whole.setdefault(at, {}).setdefault(len(seq), set()).add(k)
        self.least = min([window, *(len(s) for s in coded if s)])
        size = max(1, len(self.vocabulary))
        pairs = {a * size + b for seq in coded for a, b in zip(seq, seq[1:], strict=False)}
        self.pairs, self.size = np.array(sorted(pairs), dtype=np.int64), size

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, c, q)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        twin = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = twin
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = twin
            p = link[p]
        return twin

    def stretches(self, coded: np.ndarray) -> list[tuple[int, int]]:
        """Where an occurrence can lie: maximal runs of words of which neighbours are neighbours in an item."""
        known = coded >= 0
        if self.least <= 1:
            edge = known[:-1] & known[1:] if len(coded) else known
            joined = edge
        else:
            if len(coded) < 2 or not len(self.pairs):
                return []
            joined = known[:-1] & known[1:]
            at = np.flatnonzero(joined)
            key = coded[at].astype(np.int64) * self.size + coded[at + 1]
            spot = np.searchsorted(self.pairs, key)
            spot[spot == len(self.pairs)] = 0
            joined[at] = self.pairs[spot] == key
        if self.least <= 1:
            flags = np.concatenate(([0], known.astype(np.int8), [0]))
            d = np.diff(flags)
            return list(zip(np.flatnonzero(d == 1).tolist(), np.flatnonzero(d == -1).tolist(), strict=True))
        d = np.diff(np.concatenate(([0], joined.astype(np.int8), [0])))
        begin, end = np.flatnonzero(d == 1), np.flatnonzero(d == -1) + 1
        ok = end - begin >= self.least
        return list(zip(begin[ok].tolist(), end[ok].tolist(), strict=True))

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged spans of hit words, and the items whose windows occur."""
        if not words or not self.vocabulary:
            return [], set()
        coded = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), dtype=np.int32, count=len(words))
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        nxt, link, length, window = self.next, self.link, self.length, self.window
        for begin, end in self.stretches(coded):
            state = run = 0
            seq = coded[begin:end].tolist()
            for i, c in enumerate(seq, begin):
                while state and c not in nxt[state]:
                    state = link[state]
                    run = length[state]
                if c in nxt[state]:
                    state = nxt[state][c]
                    run += 1
                else:
                    run = 0
                least = 0
                if run >= window:
                    up = state
                    while length[link[up]] >= window:
                        up = link[up]
                    found |= self.items_with_window(up)
                    least = window
                if self.whole:
                    up = state
                    while up > 0:
                        for n, ks in self.whole.get(up, {}).items():
                            if n <= run:
                                found |= ks
                                least = max(least, n)
                        up = link[up]
                if least:
                    if spans and spans[-1][1] >= i + 1 - least:
                        a = min(spans[-1][0], i + 1 - least)
                        spans[-1] = (a, i + 1)
                    else:
                        spans.append((i + 1 - least, i + 1))
        return spans, found

    def items_with_window(self, state: int) -> set[int]:
        return self.items[state]


_BUILT: dict[tuple[int, int], Automaton] = {}


def _automaton(items, window: int) -> Automaton:  # noqa: ANN001
    """The automaton of a broadcast block, built once in a process; an earlier run's are let go."""
    key = (items.value[0], window)
    if key not in _BUILT:
        if len(_BUILT) > 8:
            _BUILT.clear()
        _BUILT[key] = Automaton(items.value[1], window)
    return _BUILT[key]


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items' words, read partition by partition, in blocks of at most block_bytes of text (or one item)."""
    block, size = [], 0
    for row in items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.col("text").alias("t")).toLocalIterator():
        words = words_of(row["t"])
        n = sum(map(len, words)) + 64
        if block and size + n > block_bytes:
            yield block
            block, size = [], 0
        if words:
            block.append((row["i"], words))
            size += n
    if block:
        yield block


def matched(docs: DataFrame, items: DataFrame, keep: tuple[str, ...], text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, prefix: str = "") -> DataFrame:
    """keep, with n_words, spans (of hit words, from and to), chars (the same in code points) and items (ids, sorted) for each document; prefix goes before these names."""
    spark = docs.sparkSession
    ship(spark)
    given = [*keep] if text in keep else [*keep, text]
    at, n = given.index(text), len(given)
    span = "array<struct<a:int,b:int>>"
    made = [f"{prefix}{c}" for c in ("n_words", "spans", "chars", "items")]
    df = docs.select(*given, *(c.alias(name) for c, name in zip((F.lit(None).cast("bigint"), F.array().cast(span), F.array().cast(span), F.array().cast("array<string>")), made, strict=True)))
    target = to_arrow_schema(df.schema)
    blocks = (spark.sparkContext.broadcast((uuid.uuid4().hex, b)) for b in item_blocks(items, block_bytes))
    for block in [*blocks] or [spark.sparkContext.broadcast((uuid.uuid4().hex, []))]:

        def work(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            auto = _automaton(block, window)
            for b in batches:
                rows = []
                for t, old, seen in zip(b.column(at).to_pylist(), b.column(n + 1).to_pylist(), b.column(n + 3).to_pylist(), strict=True):
                    words = words_of(t)
                    got, ks = auto.match(words)
                    spans = merged(old or [], got)
                    rows.append((len(words), spans, _chars(t, spans), sorted({*(seen or ()), *(auto.ids[k] for k in ks)})))
                columns = [pa.array([r[j] for r in rows], target.field(n + j).type) for j in range(4)]
                yield pa.RecordBatch.from_arrays([*b.columns[:n], *columns], schema=target)

        df = df.mapInArrow(work, df.schema)
    return df.select(*keep, *made)


def _chars(text: str | None, spans: list[dict]) -> list[dict]:
    """Spans of words as spans of code points."""
    if not spans:
        return []
    places = [m.span() for m in _PLACE.finditer(text or "")]
    return [{"a": places[s["a"]][0], "b": places[s["b"] - 1][1]} for s in spans]


def merged(old: list[dict], new: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for a, b in sorted([*((x["a"], x["b"]) for x in old), *new]):
        if out and out[-1]["b"] >= a:
            out[-1]["b"] = max(out[-1]["b"], b)
        else:
            out.append({"a": a, "b": b})
    return out


def hit_words(spans) -> F.Column:  # noqa: ANN001
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["b"] - s["a"])


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_span: int = 12, max_share: float = 0.1) -> DataFrame:
    """docs with its own columns, decontaminated.

    A document is dropped if a hit span has over max_span words, or over max_share of its words are
    hit; from the others the hit spans are cut out of the text, so that no window of an item stays.
    """
    names = tuple(docs.columns)
    got = matched(docs.select(*names), items, names, window=window, prefix="__")
    share = hit_words(F.col("__spans")) > F.col("__n_words") * max_share
    long = F.exists("__spans", lambda s: s["b"] - s["a"] > max_span)
    cut = F.aggregate(
        "__chars",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda x, s: F.struct(s["b"].alias("at"), F.concat(x["out"], F.substr(F.col("text"), x["at"] + 1, s["a"] - x["at"])).alias("out")),
        lambda x: F.concat(x["out"], F.substr(F.col("text"), x["at"] + 1)),
    )
    kept = got.where(~(share | long))
    return kept.withColumn("text", F.when(F.size("__chars") > 0, cut).otherwise(F.col("text"))).select(*names)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = matched(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ("doc_id",))
    n = F.size("items").cast("bigint")
    return got.select("doc_id", "n_words", hit_words(F.col("spans")).alias("n_hit"), n.alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n >= 2).alias("contaminated"))


#: The same in DuckDB SQL.
ORACLE = f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS ws FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS ws FROM benchmark),
sized AS (SELECT item, ws, least({WINDOW}, len(ws)) AS n FROM b WHERE len(ws) > 0),
item_windows AS (SELECT DISTINCT item, n, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (SELECT item, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM sized)),
doc_windows AS (SELECT r, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM sized))),
met AS (SELECT r, w.n, i, item FROM doc_windows w JOIN item_windows x ON w.n = x.n AND w.g = x.g),
hits AS (SELECT r, count(DISTINCT p) AS hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM met) GROUP BY r),
found AS (SELECT r, count(DISTINCT item) AS items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM met GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN found USING (r)"""
