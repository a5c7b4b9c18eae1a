"""Quality rules, sharding, mixing and near-duplicates against brute force."""

import os
import random
import re
import zlib

import numpy as np
import pytest

from gleaner.llm import mixing, quality, sharding, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string"


def texts(n, seed):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "the", "of", "é", "x###", "A", "b|c"]
    out = [None, "", "  \n ", "one", "a b", " x y　z"]
    while len(out) < n:
        body = [rng.choice(words) for _ in range(rng.randint(1, 60))]
        out.append(rng.choice((" ", "\n", "  ", "\t")).join(body))
    return out + out[-5:]


def brute_quality(text):
    words = WORD.findall(text or "")
    places = {}
    for k in range(len(words) - 4):
        places.setdefault(tuple(words[k : k + 5]), []).append(k)
    covered = {j for v in places.values() if len(v) > 1 for k in v for j in range(k, k + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    docs = spark.createDataFrame([(k, t, "s", 5) for k, t in enumerate(texts(120, 1))], SCHEMA + ", kept int")
    got = quality.assess(docs).toPandas()
    assert len(got) == docs.count()
    for r in got.itertuples():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(r.text)
        assert r.kept == (len(r.failed_rules) == 0)
    assert quality.assess(docs.limit(0)).count() == 0


def test_a_filter_on_the_verdict_counts_once(spark):
    docs = spark.createDataFrame([(1, "x", "s")], SCHEMA)
    plan = quality.assess(docs).filter("kept").select("doc_id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct") <= 4


def test_rules_are_a_table(spark):
    docs = spark.createDataFrame([(1, "x y z", "s"), (2, "w " * 50, "s")], SCHEMA)
    got = quality.assess(docs, (quality.Rule("few", "n_words", low=4),)).orderBy("doc_id").collect()
    assert [r["failed_rules"] for r in got] == [["few"], []]


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_shards_are_contiguous_and_balanced(spark, shards):
    rows = [(k // 2, t, "s", 1) for k, t in enumerate(texts(200, 2))] + [(None, "n", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA + ", shard int").repartition(3)
    got = sharding.shard_by_bytes(docs, shards).toPandas()
    size = lambda t: len((t or "").encode()) + 1
    assert sorted(zip(got["size"], got.text_crc32)) == sorted((size(r[1]), zlib.crc32((r[1] or "").encode())) for r in rows)
    total, most = got["size"].sum(), got["size"].max()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
        assert abs(g["size"].sum() - total / shards) <= 2 * most
    order = got.sort_values(["shard", "slot"]).doc_id.fillna(-1).tolist()
    assert order == sorted(order)
    assert sharding.shard_by_bytes(docs.limit(0)).count() == 0


def test_sharding_plan_is_native(spark):
    plan = sharding.shard_by_bytes(spark.createDataFrame([(1, "x", "s")], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|ArrowEval|Cartesian|NestedLoop", plan)


def targets(sizes, cap=3.0):
    keys = sorted((k for k in sizes if k is not None), key=lambda k: k.encode()) + [k for k in sizes if k is None]
    weight = {k: i % 3 + 1 for i, k in enumerate(keys)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [k for k in keys if k not in fixed]
        share = (total - sum(fixed.values())) / sum(weight[k] for k in free) if free else 0
        over = [k for k in free if weight[k] * share > cap * sizes[k]]
        if not over:
            return fixed | {k: weight[k] * share for k in free}
        fixed |= {k: cap * sizes[k] for k in over}


def test_mixing_meets_targets(spark):
    rng = random.Random(3)
    rows = [(k, "w " * rng.randint(0, 40), rng.choice(["a", "b", "b", "b", "c", "é", None]), k) for k in range(900)] + [(1000, None, "b", 0), (1001, "w", "tiny", 0)]
    docs = spark.createDataFrame(rows, SCHEMA + ", size long")
    got = mixing.mix_rows(mixing.sized_rows(docs)).toPandas()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    expected = targets(sizes)
    got["source"] = got.source.astype(object).where(got.source.notna(), None)
    for source, want in expected.items():
        g = got[got.source.isna()] if source is None else got[got.source == source]
        assert abs(g.target.iloc[0] - want) < 1e-6
        assert abs((g["size"] * g.copies).sum() - want) <= (1 if len(g) > 20 else 40)
        floor = int(min(want / max(sizes[source], 1), 3))
        assert g[g["size"] > 0].copies.isin([floor, floor + 1]).all() and g.copies.max() <= 3
    again = mixing.mix_rows(mixing.sized_rows(docs)).toPandas()
    assert got.sort_values("key").copies.tolist() == again.sort_values("key").copies.tolist()
    out = mixing.mix(docs)
    assert out.columns == docs.columns and out.count() == got.copies.sum()
    assert mixing.mix(docs.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sources_of_few_documents_come_near_their_targets(spark, sf):
    path = f"/root/testdata/{sf}/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables here")
    got = mixing.mix_rows(mixing.sized_rows(spark.read.parquet(path))).toPandas()
    for _, g in got.groupby("source", dropna=False):
        assert abs((g["size"] * g.copies).sum() - g.target.iloc[0]) <= max(g["size"][g["size"] > 0].quantile(0.1), g.target.iloc[0] / 1000)


def test_settling_never_leaves_more_open_than_it_must(spark):
    rng = random.Random(8)
    rows = [(g, rng.getrandbits(60), g * 100 + k, float(rng.choice([1, 2, 5, 40, 300, 2000]) + rng.randint(0, 3)), rng.choice([0.02, 0.3, 0.97])) for g in range(40) for k in range(rng.randint(1, 40))]
    items = spark.createDataFrame(rows, "group int, h long, row long, size double, p double")
    got = mixing.round_by_pairs(items, seed=2).join(items, "row").toPandas()
    assert len(got) == len(rows) and set(got.copies) <= {0, 1}
    for _, g in got.groupby("group"):
        size = g["size"].sort_values().to_numpy()
        alone = max([s - size[:k].sum() for k, s in enumerate(size)])  # what one item exceeds all smaller ones by
        assert abs((g.copies * g["size"]).sum() - (g.p * g["size"]).sum()) <= max(alone, 0) / 2 + 1e-6


def test_rounding_keeps_expectations(spark):
    rows = [(0, k * 7919 + s * 104729, k + 40 * s, float(1 + k % 5), 0.3) for s in range(60) for k in range(40)]
    items = spark.createDataFrame([(r[2] // 40, *r[1:]) for r in rows], "group int, h long, row long, size double, p double")
    got = mixing.round_by_pairs(items, seed=5, fan_in=8, reserve=2).join(items, "row").toPandas()
    assert len(got) == len(rows)
    assert abs(got.copies.mean() - 0.3) < 0.03
    by = got.assign(m=got.copies * got["size"], e=got.p * got["size"]).groupby("group")[["m", "e"]].sum()
    assert (by.m - by.e).abs().max() <= 5


def brute_fingerprint(text, width=3):
    words = [w.encode().lower() for w in WORD.findall(text or "")]
    if not words:
        return 0
    import xxhash

    shingles = [b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(marks):
    root = {m: m for m in marks}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    a = np.array(sorted(marks), np.uint64)
    for k, m in enumerate(a):
        for other in a[k + 1 :][np.bitwise_count(a[k + 1 :] ^ m) <= 2]:
            x, y = sorted((find(int(m)), find(int(other))))
            root[y] = x
    return {m: find(m) for m in marks}


def test_near_duplicates_against_all_pairs(spark):
    rows = [(1000 - k, t, "s", 3) for k, t in enumerate(texts(150, 4))]
    docs = spark.createDataFrame(rows, SCHEMA + ", fp int")
    got = simhash.near_duplicates(docs).toPandas()
    expected = {d: brute_fingerprint(t) for d, t, _, _ in rows}
    assert {r.doc_id: r.fp % (1 << 64) for r in got.itertuples()} == expected
    roots = brute_components(set(expected.values()))
    least = {}
    for d, m in expected.items():
        least[roots[m]] = min(least.get(roots[m], d), d)
    assert {r.doc_id: r.component_id for r in got.itertuples()} == {d: least[roots[m]] for d, m in expected.items()}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("crowded", [64, 2])
def test_links_reach_the_same_sets_as_all_pairs(spark, crowded):
    rng = np.random.default_rng(6)
    marks = {0, (1 << 64) - 1}
    for base in rng.integers(0, 1 << 63, 6, dtype=np.uint64).tolist():
        for _ in range(60):
            m = base
            for bit in rng.integers(0, 64, rng.integers(0, 4)).tolist():
                m ^= 1 << bit
            marks.add(m)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    df = spark.createDataFrame([(signed(m),) for m in marks], "fp long")
    found = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in simhash.components(simhash.links(df, cell_pairs=crowded)).collect()}
    groups = lambda f: {frozenset(m for m in marks if f(m) == r) for r in map(f, marks)}
    expected = brute_components(marks)
    assert groups(lambda m: found.get(m, m)) == groups(lambda m: expected[m])


def test_one_of_each_group_stays(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [[word() for _ in range(200)] for _ in range(12)]
    rows = []
    for k, words in enumerate(base):
        rows += [(100 + k, " ".join(words), "s"), (k, " ".join(words), "s"), (200 + k, " ".join([*words[:120], word(), *words[121:]]), "s")]
    rows += [(None, None, "s"), (900, "", "s"), (None, " ".join(base[0]), "s"), (0, rows[1][1], "s")]
    kept = simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).toPandas()
    assert sorted(kept.doc_id) == [*range(12), 900]


def test_documents_below_the_similarity_stay(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for k in range(40):  # 171 of 221 shingles are common: 0.77
        words = [word() for _ in range(200)]
        rows += [(k, " ".join(words), "s"), (100 + k, " ".join(word() if i in (30, 60, 90, 120, 150) else w for i, w in enumerate(words)), "s")]
    kept = simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).toPandas()
    assert sorted(kept.doc_id) == sorted(d for d, _, _ in rows)


def test_all_pairs_of_a_shared_passage_are_found(spark):
    rng = random.Random(22)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage, rows = [word() for _ in range(60)], []
    for k in range(150):  # 0.53 across, 0.8 to 0.9 between k and 1000 + k
        own = [word() for _ in range(28)]
        rows += [(k, " ".join([*passage, *own]), "s"), (1000 + k, " ".join([*passage, *own[: rng.choice((-8, -4, -2))], word()]), "s")]
    sets = {d: set(simhash.shingle_hashes(t, 5).tolist()) for d, t, _ in rows}
    near = {a for a in range(150) if len(sets[a] & sets[1000 + a]) >= 0.8 * len(sets[a] | sets[1000 + a])}
    kept = simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).toPandas()
    assert len(near) > 100 and set(sets) - set(kept.doc_id) == {1000 + a for a in near}


def test_stop_words_count_without_case_and_marks(spark):
    rows = [(1, "Die Pas. At, «De» " + "xxxx " * 96), (2, "xxxx yyyy " * 60), (3, " ".join(f"word{k}" for k in range(40))), (4, " ".join(f"word{k}" for k in range(140)))]
    got = {r["doc_id"]: r["failed_rules"] for r in quality.assess(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "few_stop_words" not in got[1] and "few_stop_words" in got[2] and got[3] == [] and got[4] == ["few_stop_words"]
