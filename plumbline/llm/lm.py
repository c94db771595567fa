"""Language-model scoring: a hierarchical Pitman-Yor process, seated by Gibbs sampling.

Tokens are words with A-Z lower-cased, then one end token. The word before is the context: each of
the CONTEXTS most frequent words has a restaurant of its own (the end token's seats what begins a
text), and rarer words share one by their last byte. All context restaurants share one parent of
words, whose base is uniform over the vocabulary and one unknown word. A word that sits down at a
new table in a context is a customer of the parent.

A state is, for each cell (word, context) with n customers, the places in their order at which a new
table was opened. A sweep takes all customers of a cell away, seats them again one after another
given the rest (its restaurant's other tables, and the parent without this cell's customers), and
takes the new seating by the Metropolis-Hastings ratio, which makes the step exact for the cell's
conditional distribution (reseated()). The waiting time until the next new table is drawn by
thinning, so that a cell's cost grows with its tables, not with its customers, and is exact for any
count. Cells are reseated in parallel given the totals of the sweep before, then the parent's.
Draws are hashes of cell, sweep and step, the same whatever the partitions and however often a task
runs. The predictive probabilities are averaged over the seatings after BURN sweeps.

A first pass counts words, for the HEAD most frequent; a second counts pairs. Cells of head words
are rows of their own, for each is bounded by nothing but the corpus; those of a rarer word, of which
there are fewer than the head's least count, are one row. Cells with one customer have one table, and
words that occur once are all alike: neither is sampled.

Scoring adds up in the workers what needs no table: frequent pairs (at most PAIRS are broadcast), and
for others what they are worth if they occur once in training texts, or not at all in texts that were
held out. The pairs then meet the table of cells in a join, whose rows hold by how much they are worth more.
What is broadcast is of fixed size: the head's totals (a few MB) and the frequent pairs (16 bytes
each). Words go as their 64-bit XXH64.

Cases: a null text is empty and has one token, the end; a null doc_id counts as empty text for the
division into parts; equal rows are scored each; without training documents (or with an empty table)
all words are unknown; a very long text is read whole, its pairs are sent on in pieces; other
columns of any name are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from plumbline.llm._common import forget, gathered, ship, table, written

#: Words that are held by every worker, and pairs whose probabilities are broadcast; at most.
HEAD, PAIRS = 65_536, 1_000_000
#: Words with a restaurant of their own as contexts; at most.
CONTEXTS = 4096
#: Restaurants that rarer contexts share.
SHARED = 256
#: Sweeps; the states after the first BURN of them are not averaged.
SWEEPS, BURN = 3, 1
#: Discount and strength of the context restaurants, and of the parent.
DISCOUNT, STRENGTH = 0.75, 20.0
DISCOUNT_0, STRENGTH_0 = 0.6, 100.0
#: Counts that a task holds before it sends them, and bytes of text that it reads at once, to count and to score; its arrays are several times that.
HELD, AT_ONCE, SCORED_AT_ONCE = 2_000_000, 3 << 20, 3 << 20
#: Documents whose remainder is this are held out.
PARTS, HELD_OUT = 7, 2
#: Bits of a context's number in a head cell's code.
BITS = 20


def _bytes_of(words: pa.LargeStringArray) -> tuple[bytes, np.ndarray]:
    """The bytes of all words, one after the other, and where they end, after a first 0."""
    _, ends, data = words.buffers()
    ends = np.frombuffer(ends, dtype=np.int64)[words.offset : words.offset + len(words) + 1] if ends and len(words) else np.zeros(1, dtype=np.int64)
    first, last = int(ends[0]), int(ends[-1])
    return (data[first:last].to_pybytes() if data else b""), ends - first


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted key in the sorted keys, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


class Words:
    """The tokens of a column of texts, one text after the other: word (a number in keys and last), and tokens of each text."""

    def __init__(self, texts: pa.Array) -> None:
        # Lowered before the cast: of a slice that was cast first, ascii_lower returns other bytes (pyarrow 23).
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")).cast(pa.large_string()))
        coded = lists.flatten().dictionary_encode()
        data, ends = _bytes_of(coded.dictionary)
        empty = np.flatnonzero(np.diff(ends) == 0)
        # A text's ends can give empty words; the empty word is the end token, which each text has once.
        if not len(empty):
            ends = np.append(ends, ends[-1])
        end = int(empty[0]) if len(empty) else len(ends) - 2
        word = coded.indices.to_numpy()
        some = word != end
        owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))[some]
        self.sizes = np.bincount(owner, minlength=len(texts)) + 1
        is_end = np.zeros(self.sizes.sum(), dtype=bool)
        is_end[np.cumsum(self.sizes) - 1] = True
        self.word = np.full(len(is_end), end, dtype=np.int64)
        self.word[~is_end] = word[some]
        begin, stop, digest = ends[:-1].tolist(), ends[1:].tolist(), xxhash.xxh64_intdigest
        self.end, self.keys = end, np.array([digest(data[a:b]) for a, b in zip(begin, stop, strict=True)], dtype=np.uint64).view(np.int64)
        self.last = np.zeros(len(self.keys), dtype=np.int64)
        some = np.diff(ends) > 0
        self.last[some] = np.frombuffer(data, dtype=np.uint8)[ends[1:][some] - 1]

    def contexts(self, head: Head) -> tuple[np.ndarray, np.ndarray]:
        """For each token its context, and for each word its place in the head or -1."""
        place = _find(head.keys, self.keys)
        own = np.where(place >= 0, head.context[place] if len(head.keys) else -1, -1)
        of = np.where(own >= 0, own, head.contexts + self.last)
        context = np.full(len(self.word), of[self.end], dtype=np.int64)
        context[1:] = of[self.word[:-1]]  # after an end token comes the beginning of the next text
        return context, place


class Head:
    """The most frequent words: keys (sorted), counts, and the number of their restaurants or -1."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, contexts: int) -> None:
        self.keys, self.counts = keys, counts
        top = np.lexsort((keys, -counts))[:contexts]
        self.context = np.full(len(keys), -1, dtype=np.int64)
        self.context[top] = np.arange(len(top))
        self.contexts = len(top)


def _texts(batches: Iterator[pa.RecordBatch], at: int, at_once: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """batches with at most at_once bytes of text in column `at`, or one row, or as they come if they are smaller and many."""
    for b in gathered(batches, 2048):
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(at)), 0).to_numpy(zero_copy_only=False))
        cuts = [0, *(np.flatnonzero(np.diff(ends // at_once)) + 1).tolist(), b.num_rows]
        for x, y in zip(cuts, cuts[1:], strict=False):
            if y > x:
                yield b.slice(x, y - x)


def vocabulary(docs: DataFrame, text: str = "text") -> DataFrame:
    """key and c: the count of each word of docs."""
    ship(docs.sparkSession)
    target = pa.schema([("key", pa.int64()), ("c", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def sent() -> Iterator[pa.RecordBatch]:
            for x in _pieces(_summed(held)):
                yield pa.RecordBatch.from_arrays([*map(pa.array, x)], schema=target)
            held.clear()

        for b in _texts(batches, 0):
            words = Words(b.column(0))
            held.append((words.keys, np.bincount(words.word, minlength=len(words.keys))))
            if sum(len(k) for k, _ in held) > HELD:
                held[:] = [_summed(held)]
                if len(held[0][0]) > HELD // 2:
                    yield from sent()
        yield from sent()

    return docs.select(text).mapInArrow(work, "key bigint, c bigint").where("c > 0").groupBy("key").agg(F.sum("c").alias("c"))


def cells(docs: DataFrame, head: Head, text: str = "text", held: str | None = None) -> DataFrame:
    """own, key, context, n, m: the counts of pairs, n in texts to learn from and m in those where the column `held` is true.

    own: of a head word, with its code as key (word << BITS | context) and context 0; else key is the word's.
    """
    ship(docs.sparkSession)
    target = pa.schema([("own", pa.bool_()), ("key", pa.int64()), ("context", pa.int32()), ("n", pa.int64()), ("m", pa.int64())])
    sent_head = docs.sparkSession.sparkContext.broadcast(head)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent_head.value
        own: list[tuple[np.ndarray, np.ndarray]] = []

        def rows(is_own: bool, out: np.ndarray, key: np.ndarray, context: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for o, k, c, x in _pieces((out, key, context, n)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), is_own)), pa.array(k), pa.array(c.astype(np.int32)), pa.array(np.where(o, 0, x)), pa.array(np.where(o, x, 0))], schema=target)

        def sent() -> Iterator[pa.RecordBatch]:
            code, n = _summed(own)
            yield from rows(True, code & 1 > 0, code >> 1, np.zeros(len(code)), n)
            own.clear()

        for b in _texts(batches, 0):
            words = Words(b.column(0))
            context, place = words.contexts(known)
            out = np.repeat(b.column(1).to_numpy(zero_copy_only=False).astype(np.int64), words.sizes)
            code, n = np.unique((words.word << BITS | context) << 1 | out, return_counts=True)
            out, context, word = code & 1, code >> 1 & ((1 << BITS) - 1), code >> BITS + 1
            mine = place[word] >= 0
            own.append(((place[word[mine]] << BITS | context[mine]) << 1 | out[mine], n[mine]))
            rest = ~mine
            yield from rows(False, out[rest] > 0, words.keys[word[rest]], context[rest], n[rest])
            if sum(len(k) for k, _ in own) > HELD:
                own[:] = [_summed(own)]
                if len(own[0][0]) > HELD // 2:
                    yield from sent()
        yield from sent()

    flag = F.coalesce(F.col(held), F.lit(False)) if held else F.lit(False)
    # Dealt by key: a head word's pairs are spread, and a rarer word has few.
    dealt = docs.select(text, flag.alias("out")).mapInArrow(work, "own boolean, key bigint, context int, n bigint, m bigint").repartition("own", "key")
    return dealt.groupBy("own", "key", "context").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def _pieces(columns: tuple[np.ndarray, ...]) -> Iterator[list[np.ndarray]]:
    for i in range(0, len(columns[0]), 1 << 16):
        yield [c[i : i + (1 << 16)] for c in columns]


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not held:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    if len(held) == 1:
        return held[0]
    codes, at = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
    return codes, np.bincount(at, weights=np.concatenate([n for _, n in held]), minlength=len(codes)).astype(np.int64)


def _uniform(key: np.ndarray, salt: int) -> np.ndarray:
    """Hashes of keys as numbers in (0, 1)."""
    x = key.view(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0: Stirling's series after eight steps of the recurrence."""
    low = x * (x + 1) * (x + 2) * (x + 3)
    high = (x + 4) * (x + 5) * (x + 6) * (x + 7)
    y = x + 8
    r = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / y - np.log(low) - np.log(high)


class Weights:
    """The weight of a new table for each cell when it has t: (a + discount t) (b + g t) / (c + g t)."""

    def __init__(self, discount: float, a: np.ndarray, b: np.ndarray, c: np.ndarray, g: float) -> None:
        self.discount, self.a, self.b, self.c, self.g = discount, a, b, c, g

    def only(self, i: np.ndarray) -> Weights:
        """Those of the cells i."""
        return Weights(self.discount, self.a[i], self.b[i], self.c[i], self.g)

    def at(self, i: np.ndarray, t: np.ndarray) -> np.ndarray:
        return (self.a[i] + self.discount * t) * (self.b[i] + self.g * t) / (self.c[i] + self.g * t)


def _path_weight(n: np.ndarray, owner: np.ndarray, opens: np.ndarray, weights: Weights) -> np.ndarray:
    """For each cell the sum over its customers of log(new table's weight + places at tables). opens: customers that opened a table, after the first, in order, with their cells."""
    cell = np.arange(len(n))
    per = np.bincount(owner, minlength=len(n))
    begin = np.cumsum(per) - per
    nth = np.arange(len(owner)) - begin[owner]
    # Stretches of customers that find equally many tables: from one opening to the next, and from the last to the end.
    who = np.concatenate((owner, cell))
    t = np.concatenate((nth, per)) + 1.0
    stop = np.concatenate((opens + 1, n)).astype(np.float64)
    start = np.ones(len(who))
    start[: len(owner)][nth > 0] = opens[np.flatnonzero(nth > 0) - 1] + 1
    some = per > 0
    start[len(owner) :][some] = opens[(begin + per - 1)[some]] + 1
    there = stop > start
    who, t, start, stop = who[there], t[there], start[there], stop[there]
    more = weights.at(who, t) - weights.discount * t
    one = stop == start + 1
    total = np.log(start + more)
    wide = ~one
    total[wide] = _log_gamma(stop[wide] + more[wide]) - _log_gamma(start[wide] + more[wide])
    return np.bincount(who, weights=total, minlength=len(n))


def _seated(n: np.ndarray, weights: Weights, key: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(cells, customers) that open tables after the first one when the customers come in one by one."""
    t, k = np.ones(len(n)), np.ones(len(n), dtype=np.int64)
    live = np.flatnonzero(n > 1)
    who, where, step = [], [], 0
    d = weights.discount
    while len(live):
        w, here, now = weights.at(live, t[live]), k[live], t[live]
        found = w + here - d * now
        # The chance of a new table falls until the next one is opened: wait at the present chance, then thin.
        chance = np.minimum(w / found, 1 - 1e-12)
        wait = np.minimum(np.log(_uniform(key[live], salt + 2 * step)) / np.log1p(-chance), 1e15).astype(np.int64)
        nxt = here + wait
        inside = nxt < n[live]
        live, w, found, nxt, now = live[inside], w[inside], found[inside], nxt[inside], now[inside]
        new = _uniform(key[live], salt + 2 * step + 1) * (w + nxt - d * now) < found
        who.append(live[new])
        where.append(nxt[new])
        t[live[new]] += 1
        k[live] = nxt + 1
        live = live[nxt + 1 < n[live]]
        step += 1
    if not who:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    who, where = np.concatenate(who), np.concatenate(where)
    order = np.argsort(who, kind="stable")
    return who[order], where[order]


def reseated(n: np.ndarray, owner: np.ndarray, opens: np.ndarray, weights: Weights, key: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, opens) after one Metropolis-Hastings step for each cell.

    The proposal seats the customers in turn, each new table by its conditional probability. The
    target is the product of the chosen weights; so the ratio is that of the products of all weights
    met on the way.
    """
    several = np.flatnonzero(n > 1)
    if len(several) < len(n):  # the others have one table, whatever is drawn
        at = np.cumsum(n > 1) - 1
        owner, opens = reseated(n[several], at[owner], opens, weights.only(several), key[several], salt)
        return several[owner], opens
    to_owner, to = _seated(n, weights, key, salt)
    gain = _path_weight(n, to_owner, to, weights) - _path_weight(n, owner, opens, weights)
    take = np.log(_uniform(key, salt - 1)) < gain
    new, old = take[to_owner], ~take[owner]
    who, where = np.concatenate((to_owner[new], owner[old])), np.concatenate((to[new], opens[old]))
    order = np.argsort(who, kind="stable")
    return who[order], where[order]


def _salt(sweep: int, parent: bool) -> int:
    return ((sweep * 2 + parent) << 32) + 1


class Totals:
    """Sums over all cells at one state of the seating, of fixed size; parent: the head words' customers and tables there."""

    def __init__(self, words: int, customers: np.ndarray, tables: np.ndarray, c: np.ndarray, t: np.ndarray, rare_tables: int) -> None:
        self.words, self.customers, self.tables, self.c, self.t = words, customers, tables, c, t
        self.all, self.parents = float(tables.sum()), float(t.sum() + rare_tables)
        self.base = 1 / (words + 1)
        self.new = (STRENGTH + DISCOUNT * tables) / (STRENGTH + customers)
        self.p = self.parent(c, t)

    def mass(self) -> float:
        return (STRENGTH_0 + DISCOUNT_0 * self.parents) * self.base

    def parent(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        """The parent's probabilities of words with so many customers and tables."""
        return (c - DISCOUNT_0 * t + self.mass()) / (STRENGTH_0 + self.all)

    def for_cells(self, context: np.ndarray, own: np.ndarray, c: np.ndarray, t: np.ndarray) -> Weights:
        """Weights for cells with so many tables of their own, whose words have c customers and t tables at the parent: all without the cell."""
        rest = c - own
        return Weights(DISCOUNT, STRENGTH + DISCOUNT * (self.tables[context] - own), rest - DISCOUNT_0 * np.minimum(t, rest) + self.mass(), STRENGTH_0 + self.all - own, 1.0)

    def for_parents(self, own: np.ndarray) -> Weights:
        one = np.ones(len(own))
        return Weights(DISCOUNT_0, STRENGTH_0 + DISCOUNT_0 * (self.parents - own), self.base * one, one, 0.0)


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, values) of a column of lists."""
    ends = column.offsets.to_numpy()
    return np.repeat(np.arange(len(column)), np.diff(ends)), column.flatten().to_numpy(zero_copy_only=False)


def _listed(owner: np.ndarray, values: np.ndarray, size: int, kind: pa.DataType) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=size)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


#: Cells of head words with more than one customer; tables noted in samples.
OWN = "key bigint, n bigint, opens array<bigint>, noted bigint"
#: Rarer words: for each of their cells the tables after the first; opens of all cells, one after the other; the parent's, and its probability in each sample.
RARE = "key bigint, contexts array<int>, ns array<bigint>, later array<bigint>, opens array<bigint>, noted array<bigint>, parent array<bigint>, ps array<double>"


def _swept_own(state: DataFrame, totals: Totals, sweep: int, note: bool, reseat: bool = True) -> DataFrame:
    """Cells of head words after a sweep. note: count the tables that there are before it for the averages."""
    ship(state.sparkSession)
    target, held = to_arrow_schema(StructType.fromDDL(OWN)), state.sparkSession.sparkContext.broadcast(totals)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = held.value
        for b in gathered(batches, 1 << 16):
            key, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            owner, opens = _lists(b.column(2))
            word = key >> BITS
            own = np.bincount(owner, minlength=len(n)) + 1
            noted = b.column(3).to_numpy() + note * own
            if reseat:
                owner, opens = reseated(n, owner, opens, now.for_cells(key & ((1 << BITS) - 1), own, now.c[word], now.t[word]), key, _salt(sweep, False))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _listed(owner, opens, len(n), pa.int64()), pa.array(noted, pa.int64())], schema=target)

    return state.mapInArrow(work, OWN)


def _swept_rare(state: DataFrame, totals: Totals, sweep: int, note: bool, reseat: bool = True) -> DataFrame:
    """The cells of rarer words, and these words' tables at the parent, after a sweep. note: as in _swept_own(), and the parent's probabilities."""
    ship(state.sparkSession)
    target, held = to_arrow_schema(StructType.fromDDL(RARE)), state.sparkSession.sparkContext.broadcast(totals)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = held.value
        for b in gathered(batches, 1 << 14):
            key, size = b.column(0).to_numpy(), b.num_rows
            word, context = _lists(b.column(1))
            n, later, opens, noted = (b.column(j).flatten().to_numpy() for j in (2, 3, 4, 5))
            at, parents = _lists(b.column(6))
            c = np.bincount(word, weights=later + 1, minlength=size).astype(np.int64)
            t = np.bincount(at, minlength=size) + 1
            ps = b.column(7)
            if note:
                noted = noted + later + 1
                who, old = _lists(ps)
                who, old = np.concatenate((who, np.arange(size))), np.concatenate((old, now.parent(c, t)))
                order = np.argsort(who, kind="stable")
                ps = _listed(who[order], old[order], size, pa.float64())
            owner = np.repeat(np.arange(len(n)), later)
            if reseat:
                cell = (key[word].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + context.astype(np.uint64)).view(np.int64)
                owner, opens = reseated(n, owner, opens, now.for_cells(context, later + 1, c[word], t[word]), cell, _salt(sweep, False))
                later = np.bincount(owner, minlength=len(n))
                c = np.bincount(word, weights=later + 1, minlength=size).astype(np.int64)
                stays = parents < c[at]  # the parent has other customers now: the last ones leave, or new ones come
                at, parents = reseated(c, at[stays], parents[stays], now.for_parents(t), key, _salt(sweep, True))
            given = [b.column(0), b.column(1), b.column(2), _listed(word, later, size, pa.int64()), _listed(word[owner], opens, size, pa.int64()), _listed(word, noted, size, pa.int64()), _listed(at, parents, size, pa.int64()), ps]
            yield pa.RecordBatch.from_arrays(given, schema=target)

    return state.mapInArrow(work, RARE)


class Model:
    """The head's words, the table of cells, and the totals of each averaged sample."""

    def __init__(self, head: Head, words: int, tokens: int, own: DataFrame, rare: DataFrame, samples: list[Totals]) -> None:
        self.head, self.vocabulary, self.tokens, self.own, self.rare, self.samples = head, words, tokens, own, rare, samples
        self.customers = samples[0].customers
        #: By context, and by head word, for each sample: the weight of the parent's probability, and this probability.
        self.new = np.stack([s.new for s in samples], axis=1)
        self.p = np.stack([s.p for s in samples], axis=1)
        #: The parent's probability of a word without customers, and of one that has sat down once.
        self.never, self.once = (np.array([float(s.parent(np.full(1, x), np.full(1, x))[0]) for s in samples]) for x in (0.0, 1.0))

    def logs(self) -> Logs:
        return Logs(self.customers, self.new, self.p, self.never, self.once)


class Logs:
    """log10 probabilities in a worker."""

    def __init__(self, customers: np.ndarray, new: np.ndarray, p: np.ndarray, never: np.ndarray, once: np.ndarray) -> None:
        self.customers, self.new, self.p, self.samples = customers, new, p, len(never)
        self.unknown = np.log10((new * never).mean(axis=1))
        self.hapax = np.log10((1 - DISCOUNT) / (STRENGTH + customers) + (new * once).mean(axis=1))

    def cell(self, n: np.ndarray, tables: np.ndarray, context: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """Of cells with n customers at so many tables (a mean); parent: their words' probabilities there, by sample."""
        return np.log10((n - DISCOUNT * tables) / (STRENGTH + self.customers[context]) + (self.new[context] * parent).mean(axis=1))

    def rest(self, context: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """Of words that never followed the context."""
        return np.log10((self.new[context] * parent).mean(axis=1))


def _sums(df: DataFrame, by: str, value: str, size: int) -> np.ndarray:
    """Sums of value by a number below size; so many rows come back at most."""
    out = np.zeros(size)
    got = df.groupBy(F.expr(by).alias("k")).agg(F.sum(F.expr(value)).alias("v")).toArrow()
    out[got["k"].to_numpy().astype(np.int64)] = got["v"].to_numpy()
    return out


def _later_tables(rare: DataFrame, size: int) -> DataFrame:
    """context and later: the tables after the first ones in rarer words' cells. Each task adds up its own, so it gives a row for each context at most."""
    ship(rare.sparkSession)
    target = pa.schema([("context", pa.int64()), ("later", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for b in gathered(batches, 1 << 14):
            context, later = (b.column(j).flatten().to_numpy() for j in (0, 1))
            total += np.bincount(context, weights=later, minlength=size).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], schema=target)

    return rare.where(F.size("opens") > 0).select("contexts", "later").mapInArrow(work, "context bigint, later bigint")


def train(docs: DataFrame, text: str = "text", held: str | None = None, sweeps: int = SWEEPS, burn: int = BURN, head: int = HEAD, contexts: int = CONTEXTS) -> Model:
    """The averaged model of all texts of docs, but those where the column `held` is true.

    These are to be scored only; where they are given, the model's table leaves out cells of one
    customer, and words that occur once, that they don't hold. So it can score docs, and no others.
    """
    learnt = docs.where(~F.coalesce(F.col(held), F.lit(False))) if held else docs
    words = written(vocabulary(learnt, text), "vocabulary")
    one = words.agg(F.count("*").alias("v"), F.sum("c").alias("n")).first()
    top = words.where(F.col("c") >= _least_count(words, head)).orderBy("key").toArrow()
    forget(words)
    known = Head(top["key"].to_numpy().astype(np.int64), top["c"].to_numpy().astype(np.int64), contexts)
    every, size, h = written(cells(docs, known, text, held), "cells"), known.contexts + SHARED, len(known.keys)

    mask = (1 << BITS) - 1
    wanted = F.lit(True) if held is None else F.col("m") > 0
    none, zero = F.array().cast("array<bigint>"), F.lit(0).cast("bigint")
    singles = every.where("own and n = 1")
    own = every.where("own and n > 1").select("key", "n", none.alias("opens"), zero.alias("noted"))
    alone = singles.where(wanted).select("key", "n", none.alias("opens"), F.lit(0).alias("noted"))
    context = F.expr(f"if(own, key & {mask}, context)")
    seen = every.where("n > 0").groupBy(context.alias("k"), "own").agg(F.sum("n").alias("n"), F.count("*").alias("cells"), F.count_if(F.expr("own and n = 1")).alias("single")).toArrow()  # at most two rows for each context
    customers, tables_0 = np.zeros(size), np.zeros(size)
    at_own = seen["own"].to_numpy(zero_copy_only=False).astype(bool)
    np.add.at(customers, seen["k"].to_numpy(), seen["n"].to_numpy())
    np.add.at(tables_0, seen["k"].to_numpy(), np.where(at_own, seen["single"].to_numpy(), seen["cells"].to_numpy()))
    fixed_c = _sums(singles, f"key >> {BITS}", "1", h)

    cell = F.sort_array(F.collect_list(F.when(F.col("n") > 0, F.struct("context", "n"))))
    rare = every.where("not own").groupBy("key").agg(cell.alias("x"), F.sum("n").alias("c"), F.max(wanted).alias("wanted"))
    rare = rare.where((F.col("c") > 1) | (F.col("c") > 0) & F.col("wanted")).select("key", F.col("x.context").alias("contexts"), F.col("x.n").alias("ns"))
    zeros = F.transform("ns", lambda _: zero)
    rare = written(rare.select("key", "contexts", "ns", zeros.alias("later"), none.alias("opens"), zeros.alias("noted"), none.alias("parent"), F.array().cast("array<double>").alias("ps")), "rare")
    rare_words = one["v"] - h  # words that are in no table occur once: one table each

    at, parents = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)  # the head words' tables at the parent, after their first ones

    def totals(before: Totals | None, sweep: int) -> Totals:
        """Those of the present state; the head words' customers at the parent are reseated first."""
        nonlocal at, parents
        t = own.select("key", (F.size("opens") + 1).alias("t"))
        later = _sums(_later_tables(rare, size), "context", "later", size)
        tables = tables_0 + _sums(t, f"key & {mask}", "t", size) + later
        c = (fixed_c + _sums(t, f"key >> {BITS}", "t", h)).astype(np.int64)
        if before:
            stays = parents < c[at]
            at, parents = reseated(c, at[stays], parents[stays], before.for_parents(before.t), known.keys, _salt(sweep, True))
        return Totals(one["v"], customers, tables, c, np.bincount(at, minlength=h) + 1, rare_words + (rare.agg(F.sum(F.size("parent"))).first()[0] or 0))

    now, samples = totals(None, 0), []
    for sweep in range(1, sweeps + 1):
        note = sweep > burn
        if note:
            samples.append(now)
        old = own, rare
        own, rare = written(_swept_own(own, now, sweep, note), "seating"), written(_swept_rare(rare, now, sweep, note), "rare")
        forget(*old)
        now = totals(now, sweep)
    samples.append(now)
    own, rare = _swept_own(own, now, 0, True, False), _swept_rare(rare, now, 0, True, False)
    own = own.select("key", "n", "noted").unionByName(alone.select("key", "n", F.lit(len(samples)).cast("bigint").alias("noted")))
    return Model(known, one["v"], int(one["n"] or 0), own, rare, samples)


def _least_count(words: DataFrame, size: int, c: str = "c") -> int:
    """The least count such that at most size rows have it or more, up to steps of a sixteenth of an octave. Some hundred rows come back, however many there are."""
    step = F.floor(F.log2(c) * 16)
    got = words.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min(c).alias("c")).orderBy(F.desc("step")).collect()
    least, total = 1 << 62, 0
    for r in got:
        total += r["n"]
        if total > size:
            break
        least = r["c"]
    return least


def _own_logs(model: Model, cells: DataFrame) -> DataFrame:
    """key; log (log10 of the probability), and how much it is above that of a cell of one customer, and of a pair never seen."""
    ship(cells.sparkSession)
    held = cells.sparkSession.sparkContext.broadcast(model.logs())
    target = pa.schema([("key", pa.int64()), ("log", pa.float64()), ("single", pa.float64()), ("unseen", pa.float64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = held.value
        for b in gathered(batches, 1 << 16):
            key, n, noted = (b.column(j).to_numpy() for j in range(3))
            context, p, one = key & ((1 << BITS) - 1), logs.p[key >> BITS], np.ones(len(n))
            log = logs.cell(n, noted / logs.samples, context, p)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(log), pa.array(log - logs.cell(one, one, context, p)), pa.array(log - logs.rest(context, p))], schema=target)

    return cells.select("key", "n", "noted").mapInArrow(work, "key bigint, log double, single double, unseen double")


def _rare_logs(model: Model) -> DataFrame:
    """key, c, contexts, ps, and how much each cell's log10 probability is above that of a word that occurs once, and of an unknown one."""
    ship(model.rare.sparkSession)
    held = model.rare.sparkSession.sparkContext.broadcast(model.logs())
    ddl = "key bigint, c bigint, contexts array<int>, single array<double>, unseen array<double>, ps array<double>"
    target = to_arrow_schema(StructType.fromDDL(ddl))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = held.value
        for b in gathered(batches, 1 << 14):
            word, context = _lists(b.column(1))
            n, noted, p = b.column(2).flatten().to_numpy(), b.column(3).flatten().to_numpy(), b.column(4).flatten().to_numpy().reshape(-1, logs.samples)
            log = logs.cell(n, noted / logs.samples, context, p[word])
            c = np.bincount(word, weights=n, minlength=b.num_rows).astype(np.int64)
            lists = (_listed(word, log - base[context], b.num_rows, pa.float64()) for base in (logs.hapax, logs.unknown))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c), _listed(word, context, b.num_rows, pa.int32()), *lists, b.column(4)], schema=target)

    return model.rare.select("key", "contexts", "ns", "noted", "ps").mapInArrow(work, ddl)


def scored(docs: DataFrame, model: Model, text: str = "text", pairs: int = PAIRS) -> DataFrame:
    """doc_id, held_out (from docs), n_tokens, n_known, train_tokens, base_score and score for each row. held_out must be true for all rows that the model hasn't learnt from, and for no others."""
    spark, s = docs.sparkSession, len(model.samples)
    many = model.own.where("n > 1").where(F.col("n") >= _least_count(model.own, pairs, "n"))
    top = _own_logs(model, many).select("key", "log").orderBy("key").toArrow()
    frequent = top["key"].to_numpy().astype(np.int64), top["log"].to_numpy()
    ship(spark)
    held = spark.sparkContext.broadcast((model.head, frequent, model.logs()))
    total = float(np.log10(model.tokens + model.vocabulary + 1))
    # A document's sums, or a pair: n, whether held out, whether of a head word, context.
    row = StructType([*StructType.fromDDL("row bigint, own boolean, key bigint, about bigint, new array<double>").fields, StructType.fromDDL("x struct<n_tokens: bigint, n_known: bigint, base_score: double, score: double>")[0]])
    row = StructType([row[0], docs.schema["doc_id"], *StructType.fromDDL("held_out boolean").fields, *row.fields[1:]])
    target = to_arrow_schema(row)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, (codes, frequent_logs), logs = held.value
        for b in _texts(batches, 3, SCORED_AT_ONCE):
            words = Words(b.column(3))
            sizes, rows = words.sizes, len(words.sizes)
            context, place = words.contexts(head)
            doc = np.repeat(np.arange(rows), sizes)
            # By word and context first: equal pairs of several documents are looked up once, and in an order that keeps to one stretch of the table.
            code, n = np.unique((words.word << BITS | context) * rows + doc, return_counts=True)
            pair, doc = np.divmod(code, rows)
            context, word = pair & ((1 << BITS) - 1), pair >> BITS
            at = place[word]
            own, out = at >= 0, b.column(2).to_numpy(zero_copy_only=False).astype(bool)[doc]
            key = np.where(own, at << BITS | context, words.keys[word])
            first = np.flatnonzero(np.diff(pair, prepend=-1))
            near = np.where(own, np.repeat(_find(codes, key[first]), np.diff(first, append=len(pair))), -1)
            log, c = np.where(out, logs.unknown[context], logs.hapax[context]), np.where(out, 0, 1)
            c[own] = head.counts[at[own]]
            log[near >= 0] = frequent_logs[near[near >= 0]]
            other = own & (near < 0)
            i, j = np.flatnonzero(other & out), np.flatnonzero(other & ~out)
            if len(i):
                log[i] = logs.rest(context[i], logs.p[at[i]])
            if len(j):
                one = np.ones(len(j))
                log[j] = logs.cell(one, one, context[j], logs.p[at[j]])
            each = lambda w: pa.array(np.bincount(doc, weights=w, minlength=len(sizes)))  # noqa: B023, E731
            x = pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), each(n * (c > 0)).cast(pa.int64()), each(n * (np.log10(c + 1) - total)), each(n * log)], fields=list(target.field(7).type))
            mine = np.array([xxhash.xxh64_intdigest(int(r).to_bytes(8, "little"), 1) for r in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            # What meets a document's row in the join counts for nothing, for its `about` is null.
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(0), b.column(2), pa.array(np.zeros(len(sizes), dtype=bool)), pa.array(mine), *(pa.nulls(len(sizes), target.field(j).type) for j in (5, 6)), x], schema=target)
            # Only what goes on is held while it is sent.
            far = np.flatnonzero(near < 0)
            doc, own, out, key, n, context = (v[far] for v in (doc, own, out, key, n, context))
            del words, code, pair, word, first, place, at, near, log, c, other, i, j, far
            for f in (slice(k, k + (1 << 16)) for k in range(0, len(doc), 1 << 16)):
                bare = own[f] | ~out[f]
                ends = np.concatenate(([0], np.cumsum(np.where(bare, 0, s)))).astype(np.int32)
                new = pa.ListArray.from_arrays(pa.array(ends), pa.array(logs.new[context[f][~bare]].ravel()))
                size = len(bare)
                columns = b.column(1).take(pa.array(doc[f])), pa.nulls(size, target.field(1).type), pa.nulls(size, pa.bool_()), pa.array(own[f]), pa.array(key[f]), pa.array((n[f] << 1 | out[f]) << BITS | context[f]), new
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(size, target.field(7).type)], schema=target)

    given = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.coalesce("held_out", F.lit(False)).alias("held_out"), text)
    parts = given.mapInArrow(work, row)
    none = F.lit(None)
    of_head = _own_logs(model, model.own).select(F.lit(True).alias("own"), "key", none.cast("bigint").alias("c"), none.cast("array<int>").alias("contexts"), F.array("single").alias("single"), F.array("unseen").alias("unseen"), none.cast("array<double>").alias("ps"))
    words = of_head.unionByName(_rare_logs(model).select(F.lit(False).alias("own"), "key", "c", "contexts", "single", "unseen", "ps"))
    # The table of cells is the smaller side by far, and spread evenly by key: hashed, so that the pairs needn't be sorted.
    met = parts.join(words.hint("shuffle_hash"), ["own", "key"], "left").where("x is not null or single is not null")
    bits = lambda x: F.col("about").bitwiseAND(F.lit(x).cast("bigint"))
    n, out, context = F.shiftright("about", BITS + 1), bits(1 << BITS) > 0, bits((1 << BITS) - 1).cast("int")
    place = F.when(F.col("own"), 1).otherwise(F.array_position("contexts", context).cast("int"))
    unknown = F.element_at(F.lit([float(x) for x in model.logs().unknown]), context + 1)
    fresh = F.log10(F.aggregate(F.zip_with("new", "ps", lambda a, v: a * v), F.lit(0.0), lambda a, v: a + v) / s) - unknown
    more = F.when(place > 0, F.when(out, F.get("unseen", place - 1)).otherwise(F.get("single", place - 1))).otherwise(fresh)
    zero, base = F.lit(0).cast("bigint"), F.log10(F.col("c") + 1) - F.when(out, 0.0).otherwise(float(np.log10(2)))
    met = met.select(
        "row", "doc_id", "held_out", "x.n_tokens",
        (F.coalesce("x.n_known", zero) + F.when(out & ~F.col("own"), n).otherwise(zero)).alias("n_known"),
        F.coalesce("x.base_score", F.when(~F.col("own"), n * base), F.lit(0.0)).alias("base_score"),
        F.coalesce("x.score", n * more, F.lit(0.0)).alias("score"),
    )
    sums = met.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")))
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


def divided(docs: DataFrame) -> DataFrame:
    """docs with held_out."""
    return docs.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % PARTS == HELD_OUT)


def perplexity(scores: DataFrame) -> DataFrame:
    """held_out and perplexity per token, by the model and by the base."""
    p = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scores.groupBy("held_out").agg(p("score").alias("perplexity"), p("base_score").alias("base_perplexity"))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = divided(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored(docs, train(docs, held="held_out"))
