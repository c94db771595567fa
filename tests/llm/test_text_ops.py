"""Chat, BPE, decontamination, repetition rules and the language model, against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from plumbline.llm import bpe, chat, decontam, lm, quality_rules
from pyspark.sql import functions as F

DOC = "doc_id long, text string"
NASTY = ["", None, " ", "\n\n", "a", "é𝄞中 ß", "x" * 5000, " " * 3000, "word " * 4000, "<|im_end|> <\\|x <\\\\|", "it's 12 'll  \t end\n", "\x00\x01 　 \u0085 ​", "don't " * 50 + "\n" * 40]


def docs_of(spark, texts, extra=False):
    df = spark.createDataFrame([(None if i == 3 else i, t) for i, t in enumerate(texts)], DOC)
    return df.withColumn("key", F.lit("x")).withColumn("__t", F.lit(1)).withColumn("n_words", F.lit("clash")) if extra else df


def test_bpe_equals_whole_texts_and_round_trips(spark):
    c = bpe.codec(bpe.public_tokenizers.path(bpe.RANKS))
    whole = tiktoken.Encoding("w", pat_str=bpe.public_tokenizers.PATTERN, mergeable_ranks=c.encoding._mergeable_ranks, special_tokens={})
    rnd = random.Random(3)
    texts = [t or "" for t in NASTY] + ["".join(rnd.choice("ab 1.,'s\n\té中  ") for _ in range(rnd.randint(1, 400))) for _ in range(200)]
    for t in texts:
        want = whole.encode_ordinary(t)
        for size in (1, 7, 50, 1 << 15):
            assert c.encode(t, size) == want
        assert c.decode(want) == t.encode()
    rows = bpe.encode_decode(docs_of(spark, NASTY, True)).collect()
    assert len(rows) == len(NASTY) and all(r.ids == whole.encode_ordinary(t or "") and bytes(r.decoded) == (t or "").encode() for r, t in zip(rows, NASTY, strict=True))
    assert bpe.encode_decode(docs_of(spark, NASTY).limit(0)).count() == 0
    d = bpe.encode_decode(docs_of(spark, ["a b c"]), output=bpe.digests, schema="n_tokens bigint, ids_sha256 string, decoded_sha256 string").first()
    ids = whole.encode_ordinary("a b c")
    assert (d.n_tokens, d.ids_sha256, d.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(b"a b c").hexdigest())


def brute_hits(words, items, window=8):
    hit, found = set(), set()
    for k, item in items:
        n = min(window, len(item))
        wins = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)} if item else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n]) in wins:
                hit.update(range(i, i + n))
                found.add(k)
    return hit, found


def test_automaton_against_brute_force():
    rnd = random.Random(1)
    for trial in range(120):
        letters = "ab" if trial % 3 else "abcde"
        word = lambda: rnd.choice(letters).encode()  # noqa: B023, E731
        items = [(str(k), [word() for _ in range(rnd.choice([0, 1, 2, 5, 7, 8, 9, 12, 30]))]) for k in range(rnd.randint(0, 6))]
        if trial % 5 == 0 and items:
            items.append(("same", list(items[0][1])))
        if trial % 2:
            items = [x for x in items if len(x[1]) >= 3]
        words = [word() for _ in range(rnd.randint(0, 80))] + [b"zz"] + (items[0][1] if items else []) + [b"zz"]
        auto = decontam.Automaton([x for x in items if x[1]])
        spans, found = auto.match(words)
        hit, want = brute_hits(words, items)
        assert {i for a, b in spans for i in range(a, b)} == hit
        assert {auto.ids[k] for k in found} == want
        assert all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False)) or len(spans) < 2 or {i for a, b in spans for i in range(a, b)} == hit


def test_decontamination(spark):
    item = "One two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    items = spark.createDataFrame([(1, item), (2, "short item"), (3, None), (4, ""), (5, item), (5, item)], "item_id long, text string")
    long = "pre " * 300
    texts = [f"{long}{item.upper()}! end", f"{long}one-two_three four five six seven eight nine; {long}", "a SHORT, item.", "short thing item", None, ""]
    got = {r.doc_id: r for r in decontam.matched(spark.createDataFrame(list(enumerate(texts)), DOC), items, ("doc_id",)).collect()}
    assert got[0].items == ["1", "5"] and got[1].items == ["1", "5"] and got[2].items == ["2"] and got[3].items == [] and got[4].n_words == 0
    assert [s.b - s.a for s in got[0].spans] == [14] and [s.b - s.a for s in got[1].spans] == [9]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id: r.text for r in decontam.decontaminated(docs, items).collect()}
    assert set(kept) == {1, 3, 4, 5}  # 0 has a long span, 2 is all item
    assert "two_three" not in kept[1] and kept[1].startswith("pre ") and kept[1].rstrip().endswith("pre") and kept[3] == texts[3] and kept[4] is None
    blocks = {r.doc_id: (r.n_words, r.spans, r.items) for r in decontam.matched(spark.createDataFrame(list(enumerate(texts)), DOC), items, ("doc_id",), block_bytes=10).collect()}
    assert blocks == {k: (r.n_words, r.spans, r.items) for k, r in got.items()}
    none = decontam.matched(docs, items.limit(0), ("doc_id",)).collect()
    assert len(none) == len(texts) and not any(r.items for r in none)


def brute_rules(text):
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    triples = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeat = {j for i in range(len(words) - 2) if triples[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    shares = {}
    for n in range(5, 11):
        seen, marked = set(), set()
        for i in range(len(words) - n + 1):
            g = tuple(words[i : i + n])
            if g in seen:
                marked.update(range(i, i + n))
            seen.add(g)
        shares[n] = sum(len(words[i]) for i in marked) / max(1, sum(map(len, words)))
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if any(c not in " \t\r\x0b\x0c" for c in line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(repeat), shares


def test_repetition_against_brute_force(spark):
    rnd = random.Random(2)
    texts = [*NASTY, *(" ".join(rnd.choice(["a", "bb", "é", "#x|", "line\nline", "\n"]) for _ in range(rnd.randint(1, 120))) for _ in range(60)), "same line\n" * 30]
    got = quality_rules.repetition(docs_of(spark, texts, True)).collect()
    for r, t in zip(got, texts, strict=True):
        want = brute_rules(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want[:5]
        assert all(abs(r.dup_ngram_shares[n] - s) < 1e-12 for n, s in want[5].items())
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)
    clean = " ".join(f"w{i}" for i in range(80))
    assert quality_rules.repetition(docs_of(spark, [clean])).first().kept


CONV = "conv_id long, turn long, role string, text string"


def digest(turns):
    ordered = sorted(turns, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "", x[2] or ""))
    whole = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in ordered)
    loss = "".join(t or "" for _, r, t in ordered if r == "assistant")
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


@pytest.mark.parametrize("budget", [16, 64, 1024])
def test_chat_reads_back(spark, budget):
    rnd = random.Random(budget)
    convs = {}
    for c in [None, *range(12)]:
        turns = [(0, "system", "be <|im_start|> kind")] if c and c % 3 == 0 else []
        for i in range(700 if c == 4 else rnd.choice([1, 2, 9, 3])):
            turns.append((i + 1, ("user", "assistant")[i % 2], rnd.choice(["", None, "hi <|im_end|>\n<\\|", "word " * rnd.randint(1, 60), "é𝄞<|"])))
        convs[c] = turns
    convs[50] = [(None, None, None), (None, "assistant", "x"), (1, "a\\n\nb", "tie"), (1, "a\\n\nb", "tie"), (1, "assistant", "z")]
    rows = [(c, *t) for c, ts in convs.items() for t in ts]
    rnd.shuffle(rows)
    given = spark.createDataFrame(rows, CONV).withColumn("key", F.lit("clash")).withColumn("segment", F.lit("s"))
    w = chat.windows(given, budget=budget, history=budget // 4).cache()
    got = {r.conv_id: r for r in chat.digests(w).collect()}
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == {c: digest(ts) for c, ts in convs.items()}
    many = w.where("n_turns > 1").collect()
    assert all(r.n_tokens <= budget for r in many)
    for r in w.collect():
        spans = [r.text[m.a : m.b] for m in r.mask]
        assert all(m.a >= r.own_from for m in r.mask) and all("<|" not in s for s in spans)
        if r.conv_id and r.conv_id < 50 and r.conv_id % 3 == 0:
            assert r.text.startswith("<|im_start|>system\n")
    if budget == 64:
        assert w.where("own_from > 0 and conv_id = 4").count() > 5
    assert chat.digests(chat.windows(given.limit(0))).count() == 0
    assert chat.digests(chat.windows(given.repartition(5), budget=budget, history=budget // 4)).where("conv_id = 4").first() == got[4]


def test_escaping_is_reversible():
    for t in ["<|", "<\\|", "<\\\\|x", "<", "|", "<|im_end|>" * 3, "\\<|", "<<||"]:
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)
        assert chat.unescape_role(chat.escape_role(t + "\n\\n")) == t + "\n\\n"


def tokens(t):
    return (t or "").encode().lower().split() + [b""]


def held(doc_id):
    return zlib.crc32(str(doc_id if doc_id is not None else "").encode()) % 7 == 2


def key_of(word):
    return np.array([xxhash.xxh64_intdigest(word)], dtype=np.uint64).view(np.int64)[0]


class Cells:
    """A model's probabilities, from its cells collected."""

    def __init__(self, model):
        self.model, self.cells, self.ps = model, {}, {}
        for r in model.own.collect():
            self.cells[r.key >> lm.BITS, r.key & ((1 << lm.BITS) - 1)] = (r.n, r.noted)
        for r in model.rare.collect():
            self.ps[r.key] = np.array(r.ps)
            for u, n, t in zip(r.contexts, r.ns, r.noted, strict=True):
                self.cells[-1, r.key, u] = (n, t)
        self.place = {k: i for i, k in enumerate(model.head.keys.tolist())}

    def context(self, word):
        u = self.model.head.context[self.place[key_of(word)]] if key_of(word) in self.place else -1
        return u if u >= 0 else self.model.head.contexts + (word[-1] if word else 0)

    def p(self, word, context):
        m, k = self.model, key_of(word)
        w = self.place.get(k)
        n, noted = self.cells.get((w, context) if w is not None else (-1, k, context), (0, 0))
        parent = m.p[w] if w is not None else self.ps.get(k, m.never)
        return (n - lm.DISCOUNT * noted / len(m.samples)) / (lm.STRENGTH + m.customers[context]) + (m.new[context] * parent).mean()


@pytest.mark.parametrize(("head", "contexts", "pairs"), [(0, 9, 10), (5, 3, 0), (10_000, 10_000, 3), (10_000, 10_000, 10**6)])
def test_language_model(spark, head, contexts, pairs):
    rnd = random.Random(7)
    texts = [None, "", "A a b", *(" ".join(rnd.choice("the of a cat dog ran sat UPON é mat".split()) for _ in range(rnd.randint(1, 60))) for _ in range(120)), "new words only here"]
    docs = lm.divided(spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "a b"), (5, texts[5])], DOC).withColumns({c: F.lit("clash") for c in ("key", "n", "own", "c", "row", "x")}))
    model = lm.train(docs.where("not held_out").select("doc_id", "text"), sweeps=2, burn=0, head=head, contexts=contexts)
    got = lm.scored(docs, model, pairs=pairs).collect()
    small = lm.train(docs, held="held_out", sweeps=2, burn=0, head=head, contexts=contexts)
    again = lm.scored(docs, small, pairs=pairs).collect()
    rows_of = lambda x: Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in x)
    assert rows_of(got) == rows_of(again)
    rows = docs.collect()
    counts = Counter(w for r in rows if not held(r.doc_id) for w in tokens(r.text))
    n, v = sum(counts.values()), len(counts)
    cells = Cells(model)

    def score(t):
        w = tokens(t)
        return sum(math.log10(cells.p(b, cells.context(a))) for a, b in zip([b"", *w[:-1]], w, strict=True))

    want = Counter((r.doc_id, held(r.doc_id), len(tokens(r.text)), sum(counts[w] > 0 for w in tokens(r.text)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(r.text)), 6), round(score(r.text), 6)) for r in rows)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == want
    for u in range(len(model.customers)):
        assert abs(sum(cells.p(w, u) for w in counts) + 10 ** model.logs().unknown[u] - 1) < 1e-9
    p = {r.held_out: r for r in lm.perplexity(lm.scored(docs, model)).collect()}
    assert p[True].perplexity < v + 1


def test_language_model_scores_do_not_depend_on_pairs_or_partitions(spark):
    texts = [" ".join(random.Random(i).choice("a b c d e f g h".split()) for _ in range(30)) for i in range(40)]
    docs = lm.divided(spark.createDataFrame(list(enumerate(texts)), DOC))
    score = lambda d, h: {r.doc_id: round(r.score, 9) for r in lm.scored(d, lm.train(d.where("not held_out"), sweeps=2, burn=1), pairs=h).collect()}
    assert score(docs, 3) == score(docs.repartition(7), 1000)


def test_language_model_without_training_text(spark):
    docs = spark.createDataFrame([(1, "a b")], DOC).withColumn("held_out", F.lit(True))
    model = lm.train(docs.where("not held_out"))
    r = lm.scored(docs, model).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and r.score <= 0
    assert lm.scored(docs.limit(0), model).count() == 0


def tables_law(n, weight, d):
    """The exact law of n customers' tables: the product of the chosen weights over all orders of openings."""
    law = np.zeros(n + 1)
    law[1] = 1.0
    for k in range(1, n):
        new = np.zeros(n + 1)
        for t in range(1, k + 1):
            new[t] += law[t] * (k - d * t)
            new[t + 1] += law[t] * weight(t)
        law = new
    return law / law.sum()


@pytest.mark.parametrize("n", [2, 9, 40])
def test_cells_are_reseated_by_their_exact_law(n):
    size, one = 4000, np.ones(4000)
    weights = lm.Weights(0.7, 3.0 * one, 0.4 * one, 2.0 * one, 1.0)
    key = np.arange(size, dtype=np.int64) * 7919
    owner = opens = np.zeros(0, dtype=np.int64)
    seen = np.zeros(n + 1)
    for sweep in range(1, 31):
        owner, opens = lm.reseated(np.full(size, n), owner, opens, weights, key, lm._salt(sweep, False))
        assert (np.diff(owner) >= 0).all() and (opens >= 1).all() and (opens < n).all()
        if sweep > 5:
            seen += np.bincount(np.bincount(owner, minlength=size) + 1, minlength=n + 1)
    law = tables_law(n, lambda t: (3.0 + 0.7 * t) * (0.4 + t) / (2.0 + t), 0.7)
    assert np.abs(seen / seen.sum() - law).max() < 0.01


def test_tables_of_very_many_customers():
    """The mean number of tables agrees with customers seated one by one, whatever the count."""
    size, one = 300, np.ones(300)
    for n, w, d in ((10_000, 0.5, 0.75), (1000, 20.0, 0.75), (3000, 200.0, 0.75)):
        weights = lm.Weights(0.0, w * one, one, one, 0.0)
        weights.discount = d
        weights.at = lambda i, t, w=w: np.full(len(i), w)
        who, _ = lm._seated(np.full(size, n), weights, np.arange(size, dtype=np.int64), 12345)
        rnd, t = np.random.default_rng(1), np.ones(size)
        for k in range(1, n):
            t += rnd.random(size) < w / (w + k - d * t)
        assert abs(len(who) / size + 1 - t.mean()) < 0.05 * t.mean()


def test_log_gamma():
    x = np.array([0.01, 0.5, 1.0, 2.5, 10.0, 1e3, 1e7])
    assert np.allclose(lm._log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-9)


def test_texts_are_counted_in_small_pieces():
    """Of many rows of usual length, as of few long ones, a worker holds the arrays of at most 3 MB of text."""
    batch = pa.RecordBatch.from_arrays([pa.array(["word " * 700] * 2048)], names=["text"])
    pieces = list(lm._texts(iter([batch]), 0))
    assert sum(b.num_rows for b in pieces) == 2048 and all(b.num_rows * 3500 <= (3 << 20) + 3500 for b in pieces)


def test_words_of_all_pieces_are_counted():
    """The pieces after a batch's first one hold their own words, with nulls as without."""
    rnd = random.Random(3)
    texts = [" ".join(f"W{rnd.randint(0, 5000)}" for _ in range(rnd.randint(1, 1500))) for _ in range(2048)]
    for given in (texts, [None, *texts[1:700], None, *texts[701:]]):
        got, pieces = Counter(), list(lm._texts(iter([pa.RecordBatch.from_arrays([pa.array(given)], names=["text"])]), 0))
        sizes = []
        for b in pieces:
            words = lm.Words(b.column(0))
            sizes += words.sizes.tolist()
            got.update(dict(zip(words.keys.tolist(), np.bincount(words.word, minlength=len(words.keys)).tolist(), strict=True)))
        want = Counter(w for t in given for w in tokens(t))
        assert len(pieces) > 2 and sizes == [len(tokens(t)) for t in given]
        assert got == {key_of(w): n for w, n in want.items()}


def test_cells_are_summed_before_they_become_rows(spark, monkeypatch):
    """The tables of rarer words reach the totals as one row for each task and context at most, however many cells there are."""
    seen, real = [], lm._sums

    def sums(df, by, value, size):
        got = real(df, by, value, size)
        if value.endswith("later"):
            seen.append((df.rdd.getNumPartitions(), df.count(), got))
        return got

    monkeypatch.setattr(lm, "_sums", sums)
    texts = [" ".join(f"{a} w{i % 400}" for a in "abababab") for i in range(800)]
    model = lm.train(spark.createDataFrame(list(enumerate(texts)), DOC), sweeps=2, burn=0, head=2, contexts=2)
    want, contexts, cells = np.zeros(model.head.contexts + lm.SHARED), set(), 0
    for r in model.rare.collect():
        contexts |= set(r.contexts)
        for u, later in zip(r.contexts, r.later, strict=True):
            want[u] += later
            cells += later > 0
    assert len(seen) == 3 and (seen[-1][2] == want).all() and cells > 300
    assert all(rows <= tasks * len(contexts) < cells for tasks, rows, _ in seen)


class Restaurant:
    """Chinese-restaurant seating, customer by customer."""

    def __init__(self, discount, strength, parent, rnd):
        self.d, self.s, self.parent, self.rnd = discount, strength, parent, rnd
        self.at, self.tables, self.customers = {}, 0, 0

    def p(self, w):
        sizes = self.at.get(w, ())
        return (sum(sizes) - self.d * len(sizes) + (self.s + self.d * self.tables) * self.parent.p(w)) / (self.s + self.customers)

    def add(self, w):
        sizes = self.at.setdefault(w, [])
        chance = [x - self.d for x in sizes] + [(self.s + self.d * self.tables) * self.parent.p(w)]
        i = self.rnd.choices(range(len(chance)), chance)[0]
        self.customers += 1
        if i == len(sizes):
            sizes.append(1)
            self.tables += 1
            self.parent.add(w)
        else:
            sizes[i] += 1

    def remove(self, w):
        sizes = self.at[w]
        i = self.rnd.choices(range(len(sizes)), sizes)[0]
        sizes[i] -= 1
        self.customers -= 1
        if not sizes[i]:
            del sizes[i]
            self.tables -= 1
            self.parent.remove(w)


class Uniform:
    def __init__(self, p):
        self.value = p

    def p(self, _):
        return self.value

    def add(self, _):
        pass

    remove = add


def test_scores_agree_with_a_sampler_of_single_customers(spark):
    """Held-out log probability, averaged over samples, of a plain sequential Gibbs sampler over the same corpus."""
    rnd = random.Random(17)
    words = [f"w{i}" for i in range(60)]
    follow = {w: [rnd.choice(words) for _ in range(4)] for w in words}

    def text():
        out = [rnd.choice(words)]
        while len(out) < 25:
            out.append(rnd.choice(follow[out[-1]]) if rnd.random() < 0.8 else rnd.choice(words))
        return " ".join(out)

    texts = [text() for _ in range(150)]
    docs = lm.divided(spark.createDataFrame(list(enumerate(texts)), DOC))
    got = {r.doc_id: r.score for r in lm.scored(docs, lm.train(docs.where("not held_out"), sweeps=8, burn=3)).collect()}
    pairs = [(a, b) for i, t in enumerate(texts) if not held(i) for a, b in zip([b"", *tokens(t)[:-1]], tokens(t), strict=True)]
    parent = Restaurant(lm.DISCOUNT_0, lm.STRENGTH_0, Uniform(1 / (len({b for _, b in pairs}) + 1)), rnd)
    rooms = {a: Restaurant(lm.DISCOUNT, lm.STRENGTH, parent, rnd) for a in {a for a, _ in pairs}}
    for a, b in pairs:
        rooms[a].add(b)
    out = [(i, list(zip([b"", *tokens(t)[:-1]], tokens(t), strict=True))) for i, t in enumerate(texts) if held(i)]
    total = {x: 0.0 for _, ts in out for x in ts}
    for sweep in range(25):
        for a, b in pairs:
            rooms[a].remove(b)
            rooms[a].add(b)
        if sweep >= 5:
            for a, b in total:
                total[a, b] += (rooms[a].p(b) if a in rooms else parent.p(b)) / 20
    want = sum(math.log10(total[x]) for _, ts in out for x in ts)
    assert abs(sum(got[i] for i, _ in out) - want) < 0.005 * abs(want)
    base = sum(math.log10(1 / 62) for _, ts in out for _ in ts)
    assert want > 0.9 * base
