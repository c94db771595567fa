"""PII, secrets, SimHash, sharding, the classifier and the pipeline, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import xxhash
from plumbline.llm import graph, pii, quality_model, secrets, sharding, simhash
from pyspark.sql import functions as F

DOC = "doc_id long, text string"
FULL = "doc_id long, text string, lang string, source string, n_chars long"


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0


def only(v):
    return re.sub("[^0-9]", "", v)


PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(only(m[0])) <= 19 and luhn(only(m[0]))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(only(m[0])) <= 15),
}
SECRET = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 6),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
}


def base(text, kinds):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if good(m)] for k, (p, good) in kinds.items()}


def pieces(rnd):
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    card = next(d for d in iter(lambda: digits(16), "") if luhn(d))
    return [
        "a@b.c", "x.y@q@z.io", "a@b.c_d@e.f.g", "@", "a@b", "1.2.3.4", "1.2.3.999.1.2.3.4", "0001.2.3.4.5", "300.1.1.1", card, " ".join(card[i : i + 4] for i in range(0, 16, 4)), digits(25), digits(3) + "  " + digits(12), "+1 (234) 555-6789", "+1 2", "+" + digits(30), "é𝄞", "the", "+-", "-", ".", " ", "\n",
        "token = \"abcdef123\"", "Password:x", "token=token:abcdef12", "api_key='ZZZZZZ'", "AKIA" + "Q" * 16, "AKIAX", "0af" * 9, "secretpassword=abc.def", "token", "=", '"',
    ]


def texts_of(seed, n):
    rnd = random.Random(seed)
    return [None, "", *("".join(rnd.choice(pieces(rnd)) + rnd.choice(["", " ", "", "x"]) for _ in range(rnd.randint(1, 25))) for _ in range(n)), "a" * 30_000, "1" * 30_000, "a@b." * 8000, "1.2." * 8000, "1 " * 10_000, "token=" * 4000, "a." * 9000 + "@x.y"]


def test_pii_base_against_brute_force(spark):
    texts = texts_of(1, 300)
    docs = spark.createDataFrame([(None if i == 7 else i % 250, t) for i, t in enumerate(texts)], DOC).withColumn("key", F.lit("clash")).withColumn("t", F.lit(0))
    want = Counter()
    for i, t in enumerate(texts):
        b = base(t, PII)
        want[(None if i == 7 else i % 250, *(tuple(b[k]) for k in PII))] += 1
    got = Counter((r.doc_id, *(tuple((s.a, s.b) for s in r[k]) for k in PII)) for r in pii.found_spans(docs).collect())
    assert got == want
    assert pii.found_spans(docs.limit(0)).count() == 0


def test_pii_bootstrap_finds_unseen_identifiers(spark):
    seeds = [f"please write member no 4{i}39 1234 5678 90{i} or mail member no user{i}@mail{i}.org today" for i in range(8)]
    more = ["the member no AB12345-99 is new", "the price was 120000 there", "member no Q77812x left", "member no Q77812x left"]
    got = pii.found_spans(spark.createDataFrame(list(enumerate(seeds + more)), DOC)).orderBy("doc_id").collect()
    found = [[(seeds + more)[r.doc_id][s.a : s.b] for s in r.more] for r in got[len(seeds) :]]
    assert found == [["AB12345-99"], [], ["Q77812x"], ["Q77812x"]]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(seeds + more)] + [(99, None, None, None, None)], FULL)
    red = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    assert red[len(seeds)] == "the member no <context> is new" and red[len(seeds) + 1] == more[1] and "<email>" in red[0] and "@" not in red[0] and red[99] is None and len(red) == 13


def test_pii_bootstrap_goes_beyond_its_first_generation(spark):
    ids = ["EMP-004127", "user_12345", "employee48213", "ABCDE12345", "jdoe1990", "12/345/678"] + [f"Q{i}" for i in range(20)]
    seeds = [f"member no user{i}@mail{i}.org" for i in range(80)]
    second = [f"member no {v}" for v in ids] + [f"badge of {v}" for v in ids]
    texts = seeds + second + ["badge of ZX-99 was lost", "bought 17 of them", "year 2019"]
    got = {r.doc_id: [texts[r.doc_id][s.a : s.b] for s in r.more] for r in pii.found_spans(spark.createDataFrame(list(enumerate(texts)), DOC)).collect()}
    assert [got[80 + i] for i in range(2 * len(ids))] == [[v] for v in ids] * 2
    assert [got[i] for i in range(80 + 2 * len(ids), len(texts))] == [["ZX-99"], [], []]


def test_function_words_are_no_patterns(spark):
    """Words that precede phone numbers, but mostly plain words, add nothing; a rare cue does, in the same corpus."""
    rnd = random.Random(31)
    plain = "river house market bridge stone garden letter window harbour evening story song bread hill road".split()
    small = ["the", "of", "in", "from", "and", "|"]
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    bad = lambda: next(d for d in iter(lambda: digits(16), "") if not luhn(d))
    texts = []
    for _ in range(200):
        words = []
        for _ in range(40):
            words += [rnd.choice(small), rnd.choice(plain) + rnd.choice(["", "s", "ed"])]
        words += [rnd.choice(small), f"+1 (234) 555-{digits(4)}", rnd.choice(plain), rnd.choice(small), bad(), rnd.choice(plain)]
        texts.append(" ".join(words))
    cued = [f"{rnd.choice(texts[:20])} passport holder {f'p{i}@mail{i}.org' if i % 3 else f'PX-{digits(6)}'} {rnd.choice(plain)}" for i in range(60)]
    got = {r.doc_id: [(texts + cued)[r.doc_id][s.a : s.b] for s in r.more] for r in pii.found_spans(spark.createDataFrame(list(enumerate(texts + cued)), DOC)).collect()}
    assert all(got[i] == [] for i in range(len(texts)))
    assert all([x[:3] for x in got[len(texts) + i]] == ([] if i % 3 else ["PX-"]) for i in range(len(cued)))


def test_plain_words_are_counted_over_whole_texts(spark):
    docs = spark.createDataFrame([(1, "The cat the dog (the cat) of the"), (2, None), (3, "x the 'bird' the 17"), (4, "x the 'bird' the a@b")], DOC)
    want = spark.createDataFrame([("1 the",), ("2 cat the",), ("1 nothing",)], "pattern string")
    assert {r.pattern: r.others for r in pii.others(docs, want).collect()} == {"1 the": 5, "2 cat the": 1}


def test_secret_base_against_brute_force(spark):
    texts = texts_of(2, 300)
    docs = spark.createDataFrame(list(enumerate(texts)), DOC).withColumn("key", F.lit("clash"))
    for r in secrets.found_spans(docs).collect():
        b = base(texts[r.doc_id], SECRET)
        assert {k: [(s.a, s.b) for s in r[k]] for k in SECRET} == b, texts[r.doc_id]
    assert secrets.found_spans(docs.limit(0)).count() == 0


def test_random_tokens_are_found_and_names_are_not(spark):
    rnd = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    words = "the quick river flows past many old houses where people trade bread and stories until evening comes again with quiet songs over green hills beyond every little harbour town".split()
    plain = [" ".join(rnd.choice(words) for _ in range(60)) for _ in range(400)]
    keys = ["".join(rnd.choice(letters) for _ in range(40)) for _ in range(30)]
    keys = [k for k in keys if re.search("[0-9]", k)]
    names = ["the-quick-river-flows-past-many-old-houses-1", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1", "1111111111111111111111111111111111111111111"]
    texts = plain + [f"use {k} now" for k in keys] + [f"see {n} there" for n in names]
    got = {r.doc_id: r.more for r in secrets.found_spans(spark.createDataFrame(list(enumerate(texts)), DOC)).collect()}
    hit = [i for i, m in got.items() if m]
    assert len([i for i in hit if len(plain) <= i < len(plain) + len(keys)]) >= 0.8 * len(keys)
    assert not [i for i in hit if i < len(plain) or i >= len(plain) + len(keys)]


LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
FRAMES = ("use {} now", "auth={} end", "see https://h.example/a?sig={}&x=1", 'key: "{}"', "The key is {}. Then", "user@{} x", "jwt aaa.{}.bbb")


def prose(rnd, n):
    words = "the quick river flows past many old houses where people trade bread and stories until evening comes again with quiet songs over green hills beyond every little harbour town under bright stars while children learn their letters near windows".split()
    return [" ".join(rnd.choice(words) for _ in range(80)) for _ in range(n)]


def test_random_tokens_are_found_wherever_they_stand(spark):
    """Recall by length and frame, and false finds among names, addresses and words run together."""
    rnd = random.Random(41)
    plain, texts, where = prose(rnd, 600), [], []
    for n in (20, 32, 40, 64):
        for f in FRAMES:
            for _ in range(12):
                texts.append(f.format("".join(rnd.choice(LETTERS) for _ in range(n))))
                where.append((n, f))
    words = " ".join(plain).split()
    pick = lambda k: [rnd.choice(words) for _ in range(k)]
    false = []
    for _ in range(60):
        false += ["see " + "-".join(pick(7)) + " there", "https://site.example/" + "/".join(pick(6)) + "/index", "call " + "".join(w.title() for w in pick(6)) + "()", "in " + "_".join(pick(6)), "x " + "".join(pick(6)) + " y"]
    every = plain + texts + false
    got = {r.doc_id: len(r.more) for r in secrets.found_spans(spark.createDataFrame(list(enumerate(every)), DOC)).collect()}
    found = defaultdict(list)
    for i, w in enumerate(where):
        found[w].append(got[len(plain) + i] > 0)
    by_length = {n: sum(sum(found[n, f]) for f in FRAMES) / (12 * len(FRAMES)) for n in (20, 32, 40, 64)}
    assert by_length[20] >= 0.5 and min(by_length[n] for n in (32, 40, 64)) >= 0.85, by_length
    assert all(sum(found[n, f]) >= 8 for n in (32, 40, 64) for f in FRAMES), found
    wrong = sum(got[i] > 0 for i in range(len(plain) + len(texts), len(every)))
    assert wrong <= 0.05 * (wrong + sum(map(sum, found.values()))), wrong
    assert not any(got[i] for i in range(len(plain)))


def test_deviates_on_known_tokens(spark):
    rows = {r.v: r for r in secrets.tested(secrets.with_encoding(spark.createDataFrame([("0123456789abcdef",), ("0000000000000000",), ("0f0f0f0f0f0f0f0f",)], "v string"))).collect()}
    even, same, swing = (rows[k] for k in ("0123456789abcdef", "0000000000000000", "0f0f0f0f0f0f0f0f"))
    assert even.encoding == "hex" and even.squares == 16 and same.squares == 256 and same.z_chi > 5 and swing.z_runs > 3 and swing.z_serial < -2 and even.z_serial > 2


def brute_fp(t, k=4):
    w = (t or "").encode().lower().split()
    sh = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def union(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprints(spark):
    rnd = random.Random(6)
    texts = [None, "", " \n", "one", "One TWO three", "É é", *(" ".join(rnd.choice("a b c d E".split()) for _ in range(rnd.randint(1, 40))) for _ in range(50))]
    docs = spark.createDataFrame(list(enumerate(texts)), DOC).withColumn("fp", F.lit("clash"))
    for r in simhash.fingerprints(docs.drop("fp")).collect():
        assert r.fp & (2**64 - 1) == brute_fp(texts[r.doc_id])
    same = spark.sql("select xxhash64('a b c d') as h").first().h & (2**64 - 1)
    assert brute_fp("A b  c\nd") == same


def test_links_equal_brute_force(spark):
    rnd = random.Random(8)
    centres = [rnd.getrandbits(64) for _ in range(30)]
    fps = set(centres)
    for c in centres[:12]:
        for _ in range(25):
            x = c
            for b in rnd.sample(range(64), rnd.randint(1, 6)):
                x ^= 1 << b
            fps.add(x)
    x = centres[20]
    for i in range(0, 48, 4):  # a chain of steps of four bits
        for b in range(i, i + 4):
            x ^= 1 << b
        fps.add(x)
    for radius in (2, 4, 6):
        vals = sorted(np.array(sorted(fps), dtype=np.uint64).view(np.int64).tolist())
        a = np.array(vals, dtype=np.int64).view(np.uint64)
        pairs = [(i, j) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= radius).tolist() if j > i]
        root = union(len(vals), pairs)
        size = Counter(root)
        want = {vals[i]: vals[r] for i, r in enumerate(root) if size[r] > 1}
        df = spark.createDataFrame([(v,) for v in vals], "fp long")
        assert {r.node: r.root for r in simhash.linked(df, radius).collect()} == want


def test_components_of_documents(spark):
    rnd = random.Random(9)
    long = [" ".join(rnd.choice([f"w{i}" for i in range(500)]) for _ in range(400)) for _ in range(6)]
    texts = long + [t + " tail" for t in long[:3]] + long[:2] * 3 + ["", None, " "]
    ids = [100 - i for i in range(len(texts))]
    ids[0] = None
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in zip(ids, texts, strict=True)], FULL).withColumn("component_id", F.lit("clash"))
    fps = [brute_fp(t) for t in texts]
    root = union(len(texts), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    least = defaultdict(list)
    for i, r in enumerate(root):
        if ids[i] is not None:
            least[r].append(ids[i])
    want = Counter((d, f, min(least[r])) for d, f, r in zip(ids, fps, root, strict=True))
    got = Counter((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.grouped(docs.drop("component_id")).collect())
    assert got == want
    again = docs.drop("component_id")
    kept = simhash.deduplicated(again.unionByName(again)).collect()
    assert len(kept) == len(set(root)) and {r.doc_id for r in kept} == {min(v) for v in least.values()}
    assert simhash.deduplicated(again.limit(0)).count() == 0


def jaccard(a, b, k=5):
    x, y = (({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}) for w in ((t or "").lower().split() for t in (a, b)))
    return len(x & y) / len(x | y)


def edited(rnd, base, other, kind, share):
    """base with a share of another text appended, with its end cut off, or with words put for others."""
    n = len(base)
    if kind == "append":
        return base + other[: round(n * share)]
    if kind == "cut":
        return base[: n - round(n * share)]
    return [rnd.choice(other) if rnd.random() < share / 5 else w for w in base]


def copies_of(seed, n, shares):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    draw = lambda size: [rnd.choice(words) for _ in range(size)]
    out = []
    for _ in range(n):
        base = draw(rnd.randint(5, 300))
        kind = rnd.choice(["append", "cut", "substitute"])
        out.append((kind, " ".join(base), " ".join(edited(rnd, base, draw(400), kind, rnd.uniform(*shares)))))
    return out


def test_near_copies_of_all_edits_meet(spark):
    pairs = [p for p in copies_of(20, 400, (0.05, 0.25)) if p[1] != p[2] and jaccard(*p[1:]) >= 0.8]
    assert min(Counter(k for k, _, _ in pairs).values()) >= 30
    none = np.zeros(0, dtype=np.int64)
    sets = [simhash.shingles(t) for p in pairs for t in p[1:]]
    rows = [(i, len(s), simhash.prefix(s, none, none).tolist()) for i, s in enumerate(sets)]
    met = simhash.cells_of(spark.createDataFrame(rows, "node long, n int, prefix array<long>"))
    got = {(r.a, r.b) for r in simhash._pairs(met, F.col("x"), F.col("p0"), (4, 5)).collect()}
    assert got >= {(2 * i + 1, 2 * i) for i in range(len(pairs))}


def test_copies_that_are_no_pivots_are_compared(spark):
    """Two copies in one cell with strangers that are its pivots."""
    rows = [(node, 50, [*range(7), *range(2000, 2004)]) for node in range(40)]  # more in common with each other than with the copies
    rows += [(100, 50, [*range(7), *range(3000, 3004)]), (101, 50, [*range(7), *range(4000, 4004)])]
    whole = [(n, [*p, *(10**6 * (1 + min(n, 100)) + i for i in range(39))]) for n, _, p in rows]
    met = simhash.cells_of(spark.createDataFrame(rows, "node long, n int, prefix array<long>"))
    assert {(r.node, r.root) for r in simhash.copies(met, spark.createDataFrame(whole, "node long, hashes array<long>")).collect()} == {(100, 100), (101, 100)}


def test_kept_documents_do_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(x for p in copies_of(21, 60, (0.05, 0.4)) for x in p[1:])], FULL)
    kept = [{r.doc_id for r in simhash.deduplicated(docs.repartition(n)).collect()} for n in (1, 7)]
    assert kept[0] == kept[1] and 60 <= len(kept[0]) < 120


def test_near_copies_equal_brute_force(spark):
    texts = [x for p in copies_of(22, 150, (0.05, 0.5)) for x in p[1:]]
    rnd = random.Random(23)
    base = [f"v{i}" for i in range(120)]
    texts += [" ".join(base)] + [" ".join(edited(rnd, base, ["x", "y"], "substitute", 0.12)) for _ in range(40)]
    like = [(i, j) for i in range(len(texts)) for j in range(max(0, i - 41), i) if jaccard(texts[i], texts[j]) >= 0.8]
    below = [i for i in range(0, 300, 2) if 0.6 <= jaccard(texts[i], texts[i + 1]) < 0.8]
    want = {i for i, r in enumerate(union(len(texts), like)) if i == r}
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], FULL).repartition(5)
    assert {r.doc_id for r in simhash.deduplicated(docs).collect()} == want and len(below) >= 10 and len(like) > 100


def test_near_dedup_takes_all_simhash_links(spark):
    """Fingerprints link these texts, though too few of their five-word shingles agree."""
    rnd = random.Random(31)
    texts = []
    while len(texts) < 6:
        base = [f"w{rnd.randrange(40)}" for _ in range(60)]
        other = list(base)
        for i in rnd.sample(range(60), 3):
            other[i] = "x"
        a, b = " ".join(base), " ".join(other)
        if (brute_fp(a) ^ brute_fp(b)).bit_count() <= 4 and jaccard(a, b) < 0.8:
            texts += [a, b]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], FULL)
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == {0, 2, 4}


def test_shared_passages_stay_out_of_prefixes(spark, monkeypatch):
    """Strangers that share one passage: 24, so few that a sixteenth of all texts holds it hardly ever three times."""
    monkeypatch.setattr(simhash, "LEAST", 1)
    rnd = random.Random(32)
    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join([f"s{rnd.randrange(10**6)}" for _ in range(200)] + passage * (i % 250 == 0)) for i in range(6000)]
    known = simhash.common_shingles(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], FULL))
    rows = [(i, len(s), simhash.prefix(s, *known).tolist()) for i, s in ((i, simhash.shingles(texts[i])) for i in range(0, 6000, 250))]
    met = simhash.cells_of(spark.createDataFrame(rows, "node long, n int, prefix array<long>"))
    assert met.groupBy("cell").count().where("count > 12").isEmpty()


def test_graph_components(spark):
    rnd = random.Random(10)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(60)] + [(600, 700 + i) for i in range(50)]
    root = union(800, pairs)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {n: root[n] for n in nodes}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_edges_take_few_jobs(spark, monkeypatch):
    """Rounds of joins weigh on the driver, so a small graph needs none; with many edges they go on until few are left."""
    pairs = [(i, i + 1) for i in range(300)] + [(2**60, -5), (-5, 1000), (1000, 1000), (2000, 2000)]
    want = dict.fromkeys(range(301), 0) | {2**60: -5, -5: -5, 1000: -5}
    edges = spark.createDataFrame(pairs, "a long, b long")
    sc, jobs = spark.sparkContext, {}
    for few in (1 << 16, 20, 0):
        monkeypatch.setattr(graph, "FEW", few)
        sc.setJobGroup(f"few{few}", "")
        got = graph.components(edges)
        jobs[few] = len(sc.statusTracker().getJobIdsForGroup(f"few{few}"))
        sc.setJobGroup("", "")
        assert {r.node: r.root for r in got.collect()} == want
    assert jobs[1 << 16] <= 8 < jobs[20] < jobs[0]


def check_shards(rows, texts, shards):
    counts = Counter(r.shard for r in rows)
    assert len(rows) == len(texts) and max(counts.values()) - min([counts[s] for s in range(shards)]) <= 1
    slots = defaultdict(set)
    for r in rows:
        slots[r.shard].add(r.slot)
    assert all(slots[s] == set(range(n)) for s, n in counts.items())


def test_sharding(spark):
    rnd = random.Random(11)
    texts = ["hot"] * 200 + [f"pair {i // 2}" for i in range(120)] + [f"single {i}" for i in range(300)] + [None, "", "é𝄞"]
    rnd.shuffle(texts)
    docs = spark.createDataFrame([(None if i == 5 else i % 600, t) for i, t in enumerate(texts)], DOC).withColumn("shard", F.lit("clash")).withColumn("row", F.lit("clash")).repartition(6)
    rows = sharding.sharded(docs).collect()
    check_shards(rows, texts, 24)
    assert Counter((r.size, r.text_crc32) for r in rows) == Counter((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for t in texts)
    where = defaultdict(set)
    for r in rows:
        where[r.text_crc32].add(r.shard)
    split = [c for c in {zlib.crc32(f"pair {i}".encode()) for i in range(60)} if len(where[c]) > 1]
    assert len(split) <= 3 and len(where[zlib.crc32(b"hot")]) <= 16
    check_shards(sharding.sharded(docs.limit(7)).collect(), texts[:7], 24)
    assert sharding.sharded(docs.limit(0)).count() == 0
    check_shards(sharding.sharded(docs.withColumn("text", F.lit("same"))).collect(), texts, 24)


def graded_docs(n, seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        body = [rnd.choice(words) for _ in range(rnd.randint(20, 120))]
        grade = rnd.choice([0, 1, 2, 2, 2])
        if grade == 0:
            body[rnd.randrange(len(body))] = rnd.choice(["vile", "scumbag"])
        if grade == 1:
            body = [w + "***" for w in body]
        rows.append((i, " ".join(body), grade))
    return rows


def test_classifier(spark):
    rows = graded_docs(1200, 12)
    docs = spark.createDataFrame(rows, "doc_id long, text string, grade int").withColumn("key", F.lit("clash"))
    train, test = docs.where("doc_id < 800"), docs.where("doc_id >= 800")
    model = quality_model.train(docs, train.select("doc_id", "grade"), 2)
    assert (np.diff(model.thresholds) >= 0).all()
    got = {r.doc_id: r for r in quality_model.scored(test, model).collect()}
    right = [(got[i].kept == (g == 2)) for i, _, g in rows if i >= 800]
    assert sum(right) / len(right) > 0.95
    mean = {g: np.mean([got[i].expected_grade for i, _, x in rows if i >= 800 and x == g]) for g in (0, 1, 2)}
    assert mean[0] < mean[1] < mean[2]
    assert all(r.tails[0] >= r.tails[1] == r.tail and abs(sum(r.tails) - r.expected_grade) < 1e-9 for r in got.values())
    again = quality_model.train(docs.repartition(5), train.select("doc_id", "grade").repartition(3), 2)
    assert np.allclose(again.weights, model.weights)


def test_classifier_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x y"), (2, "dup id")], DOC)
    none = quality_model.train(docs, spark.createDataFrame([], "doc_id long, grade int"), 2)
    assert all(r.kept and r.expected_grade > 1.99 for r in quality_model.scored(docs, none).collect())
    one = quality_model.train(docs, spark.createDataFrame([(1, 0), (2, 0), (None, 1), (2, None)], "doc_id long, grade int"), 2)
    assert all(r.expected_grade < 0.01 and not r.kept for r in quality_model.scored(docs, one).collect())
    assert quality_model.scored(docs.limit(0), none).count() == 0


def test_long_texts_train_with_all_their_features(spark):
    long = " ".join(f"v{i}" for i in range(12_000))
    docs = spark.createDataFrame([(f"id{i}", long if i % 2 else "short text", "clash") for i in range(20)], "doc_id string, text string, places string")
    seen = []
    keep, quality_model.fit = quality_model.fit, lambda rows, grades, top: seen.append((rows, grades))
    try:
        quality_model.train(docs, docs.selectExpr("doc_id", "if(text = 'short text', 0, 2) as grade"), 2)
        quality_model.train(docs, docs.selectExpr("doc_id", "0 as grade"), 2, fit_places=30_000)
    finally:
        quality_model.fit = keep
    (rows, grades), (few, _) = seen
    assert len(rows) == 20 and all(set(r.tolist()) == set(quality_model.features(long if g else "short text").tolist()) for r, g in zip(rows, grades, strict=True))
    assert 1 <= len(few) < 20 and sum(map(len, few)) <= 30_000


def test_sample_is_never_too_small(spark):
    rated = spark.range(100_000).withColumnRenamed("id", "doc_id").withColumn("grade", F.lit(1))
    for n in (1, 3, 10, 200_000):
        got = {r.doc_id for r in quality_model.sampled(rated, n).collect()}
        assert len(got) == min(n, 100_000)
        if n < 100:
            least = rated.selectExpr("doc_id", "shiftrightunsigned(xxhash64(doc_id), 32) as h").orderBy("h", "doc_id").limit(n)
            assert got == {r.doc_id for r in least.collect()}


def test_pipeline(spark, tmp_path):
    rnd = random.Random(13)
    rows = graded_docs(400, 14)
    item = " ".join(f"bench{i}" for i in range(30))
    docs = [[i, t] for i, t, _ in rows]
    good = [i for i, _, g in rows if g == 2]
    docs[good[0]][1] += " " + item
    docs[good[1]][1] += " write to jo@mail.example.com now"
    docs.append([1000, docs[good[2]][1]])
    docs.append([1001, None])
    full = [(i, t, "en", rnd.choice("ab"), len(t or "")) for i, t in docs]
    given = spark.createDataFrame(full, FULL).withColumns({c: F.lit(c) for c in ("kept", "tail", "spans", "chars", "n_words", "ids", "key", "fp", "email", "node")})
    given.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(i, int(g != 1), int(g == 0)) for i, _, g in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen, now = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        now = spark.read.parquet(f"{tmp_path}/out{k}")
        seen[name] = {r.doc_id: r for r in now.collect()}
        if name != "encode":
            assert now.columns == given.columns
    bad = {i for i, _, g in rows if g != 2}
    assert len(bad & set(seen["quality"])) < 0.1 * len(bad) and len(set(good) & set(seen["quality"])) > 0.97 * len(good)
    assert (good[2] in seen["near_dedup"]) + (1000 in seen["near_dedup"]) == 1
    assert good[0] in seen["near_dedup"] and good[0] not in seen["decontaminate"]
    assert "<email>" in seen["redact"][good[1]].text and seen["redact"][good[1]].n_chars == len(seen["redact"][good[1]].text)
    assert all(r.same for r in seen["encode"].values()) and set(seen["encode"]) == set(seen["redact"])
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert {(r.doc_id, tuple(r.ids)) for r in run.collect()} == {(r.doc_id, tuple(r.ids)) for r in seen["encode"].values()}
    assert hashlib.sha256(b"").hexdigest()
