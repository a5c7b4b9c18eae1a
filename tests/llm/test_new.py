"""Divergence, prefix tries and best-fit packing against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import bestfit, divergence, trie

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def audited(rows, least, top):
    """(lang, source, part, item) -> (value, rank), all pairs and terms at once."""
    docs = defaultdict(Counter)
    counts = defaultdict(Counter)
    for lang, source, text in rows:
        found = TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        docs[lang or ""].update(set(found))
        counts[lang or "", source or ""].update(found)
    out = {}
    for lang in {a for a, _ in counts}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = [s for a, s in counts if a == lang]
        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})

        def share(c, t):
            return 1 + 1_000_000_000 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept))

        for a in sources:
            pairs = [(sum(abs(share(counts[lang, a], t) - share(counts[lang, b], t)) for t in kept), b) for b in sources if b != a]
            terms = [(share(counts[lang, a], t) - share(whole, t), t) for t in kept if counts[lang, a][t] > 0]
            for part, found, limit in (("pair", pairs, None), ("term", [x for x in terms if x[0] > 0], top)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:limit], 1):
                    out[lang, a, part, item] = (value, rank)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_divergence(spark, seed):
    rng = random.Random(seed)
    words = ["the", "The", "été", "Été", "ß", "naïve", "x", "日本", "a1b", "don't", "\x80"] + [f"w{'abcdefghij'[k]}" for k in range(10)]
    rows = [(rng.choice(["en", "fr", None, "x\0y"]), rng.choice(["a", "b", "é", None, ""]), rng.choice([None, "", "12 34"] + [" ".join(rng.choices(words, k=rng.randint(1, 12))) for _ in range(6)])) for _ in range(300)]
    docs = spark.createDataFrame([(k % 250, t, a, b, "?", 7) for k, (a, b, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, TERM string, n int").repartition(5)
    got = divergence.audit(docs, min_documents=8, top=4, entries=(5, 40, 10_000)[seed])
    assert {(r["lang"], r["source"], r["part"], r["item"]): (r["value"], r["rank"]) for r in got.collect()} == audited(rows, 8, 4)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_divergence_in_blocks_and_beyond_64_bits(spark):
    rows = [("en", f"s{k % 9}", f"alpha {'beta ' * (k % 5)} gamma{'abc'[k % 3]}") for k in range(90)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    whole = divergence.audit(docs, min_documents=3)
    terms = [r for r in whole.collect()]
    assert {(r["lang"], r["source"], r["part"], r["item"]): (r["value"], r["rank"]) for r in terms} == audited(rows, 3, 50)
    huge = divergence.shares(np.array([10**15, 3]), np.array([2 * 10**15 + 7, 10**16]))
    assert huge.tolist() == [1 + 10**9 * (10**15 + 5) // (2 * 10**15 + 7), 1 + 10**9 * 8 // 10**16]
    long = "word " * 400_000 + "Long" * 400_000
    assert sum(len(c) for c in divergence.chunks(long.encode())) == 400_001
    assert divergence.audit(spark.createDataFrame([("en", "a", long)] * 2, "lang string, source string, text string"), min_documents=2).count() == 0


def test_dense_blocks_of_sources_give_the_same(spark):
    rows = [("en", f"s{k % 9}", f"alpha {'beta ' * (k % 5)} gamma{'abc'[k % 3]}") for k in range(90)]
    terms = spark.createDataFrame([("en", b"alpha", ["s0", "s1"], [3, 4], 2, 12, ["s0", "s1", "s2"], [5, 4, 3]), ("en", b"beta", ["s2"], [5], 2, 12, ["s0", "s1", "s2"], [5, 4, 3])], "lang string, term binary, sources array<string>, counts array<long>, v long, n_lang long, names array<string>, totals array<long>")
    flat = lambda dense: sorted(map(tuple, divergence.partials(terms, dense=dense).groupBy("source", "part", "item").agg(F.sum("value")).collect()))
    assert flat(1) == flat(4) == flat(1 << 20) and rows


def tried(rows):
    """The nodes of the trie, by prefix."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [(r, t) for _, r, t in sorted(v)] for c, v in own.items() if c is not None}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        base = turns.get(c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20)), [])
        built[c] = tuple(base[:h] + turns[c][h:])
    nodes = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], set()).add(c)
    out = set()
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        inner = {p[:-1] for p in nodes if p}
        ends = sorted(c for c in members if len(built[c]) == len(path))
        saved = sum((len(nodes[p]) - 1) * len(WORD.findall(p[-1][1])) for p in below if p)
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        parent = min(nodes[path[:-1]]) if path else None
        out.add((min(members), len(path), parent, len(members), sum(len(p) == len(path) + 1 for p in below), sum(p not in inner for p in below), saved, digest))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_trie(spark, seed):
    rng = random.Random(seed)
    texts = [None, "", "hello there", "a b c", "one", "x " * 50]
    rows = []
    for conv in rng.sample(range(-30, 200), 90):
        for k in range(rng.randint(1, 6) if seed % 2 else rng.randint(1, 2)):
            rows.append((conv, rng.choice([k, k, None]), rng.choice(["user", "assistant", None]), rng.choice(texts if seed < 4 else texts[2:3])))
    rows += [(None, 1, "user", "lost"), (rows[0][0], *rows[0][1:])]
    df = spark.createDataFrame([(*r, 5, "z") for r in rows], "conv_id long, turn long, role string, text string, depth int, PATH string").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", str((1, 4, 9, 17, 5, 8)[seed]))
    try:
        got = [tuple(r) for r in trie.prefix_trie(df, held=rng.choice([1, 3, 1000]), ids=rng.choice([1, 3, 4096])).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == len(set(got)) and set(got) == tried(rows)
    assert trie.prefix_trie(df.limit(0)).count() == 0


def test_a_group_of_copies_over_many_partitions(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(1, 400) for t in range(3)] + [(c, 0, "user", "other") for c in range(400, 420)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = {tuple(r) for r in trie.prefix_trie(df, ids=7).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == tried(rows)


def test_a_conversation_of_many_turns(spark):
    rows = [(c, t, "user", f"t {t if t < 1500 else (t, c)}") for c in (40, 60) for t in range(2000)]
    got = trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    by = {r["depth"]: r["n"] for r in got.groupBy("depth").agg(F.count("*").alias("n")).collect()}
    assert by[1500] == 1 and by[1501] == by[2000] == 2 and got.filter("depth = 1500").first()["n_leaves"] == 2


def used(bins):
    out = Counter()
    for pattern, times in bins.items():
        for length, copies in pattern:
            out[length] += copies * times
    return out


@pytest.mark.parametrize("seed", range(5))
def test_solutions_hold_all_documents_and_cross_well(seed):
    rng = random.Random(seed)
    window = 64
    histogram = [0] + [rng.choice([0, 0, 1, 3, 200]) for _ in range(window - 1)]
    want = Counter({n: k for n, k in enumerate(histogram) if k})
    people = [bestfit.greedy(histogram, window, rng, rng.choice([0, 0.1, 0.5])) for _ in range(5)]
    least = -(-sum(n * k for n, k in enumerate(histogram)) // window)
    for _ in range(3):
        people = bestfit.evolve(people, histogram, window, rng, 4)
        for p in people:
            assert used(p) == want and all(bestfit.fill(x) <= window and t > 0 for x, t in p.items())
    scores = [bestfit.fitness(p, window) for p in people]
    plain = {}
    bestfit.insert(plain, list(histogram), window)
    assert used(plain) == want and scores[0] == min(scores) and least <= scores[0][0] <= sum(plain.values()) * 1.01 + 1


def test_small_problems_are_solved_to_the_optimum(spark):
    def optimum(items, window):
        best = len(items)

        def place(k, gaps):
            nonlocal best
            if len(gaps) >= best:
                return
            if k == len(items):
                best = len(gaps)
                return
            for g in {g for g in gaps if g >= items[k]}:
                rest = list(gaps)
                rest.remove(g)
                place(k + 1, [*rest, g - items[k]])
            place(k + 1, [*gaps, window - items[k]])

        place(0, [])
        return best

    rng = random.Random(4)
    for seed in range(6):
        items = sorted((rng.randint(1, 20) for _ in range(9)), reverse=True)
        histogram = [items.count(n) for n in range(32)]
        found = bestfit.islands_best(spark, histogram, 32, seed=seed, islands=2, epochs=2)
        assert used(found) == Counter(items) and sum(found.values()) == optimum(items, 32)


def test_islands_agree_with_themselves(spark):
    histogram = [0] + [(k * 7) % 11 for k in range(1, 64)]
    runs = [bestfit.islands_best(spark, histogram, 64, islands=3, epochs=2) for _ in range(2)]
    assert runs[0] == runs[1]
    assert bestfit.islands_best(spark, [0] * 64, 64, islands=2) == {}


@pytest.mark.parametrize("broadcast", [64 << 20, 0])
def test_documents_are_packed_whole(spark, broadcast):
    rng = random.Random(2)
    texts = [None, "", "word", "word " * 3000] + ["w " * rng.randint(0, 90) for _ in range(200)]
    docs = spark.createDataFrame([(k // 2 if k else None, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, piece string").repartition(3)
    got = bestfit.pack_whole(docs, window=128, broadcast_bytes=broadcast, islands=2, epochs=1).toPandas()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 128
    total = got.length.sum()
    assert got.sequence_id.nunique() <= total / 128 * 1.02 + 2
    long = got[(got.doc_id == 1) & (got.length == 128)]
    first = got[(got.doc_id == 1) & (got.piece == 0)]
    assert sorted(long.start) == [int(first.length.max()) + 128 * k for k in range(len(long))] if len(first) else True
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [library.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]
    assert total == sum(map(len, ids))
    pieces = Counter(bytes(x) for x in got.ids)
    expected = Counter()
    for x in ids:
        cut = len(x) % 128
        for part in ([x[:cut]] if cut else []) + [x[k : k + 128] for k in range(cut, len(x), 128)]:
            expected[np.array(part, "<u4").tobytes()] += 1
    assert pieces == expected
    assert bestfit.pack_whole(docs.limit(0), window=128).count() == 0
