import os
import re

import numpy as np
import pytest

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
needs_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def shingles(text, width=5):
    words = [w.encode().lower() for w in WORD.findall(text or "")]
    return frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))) if words else frozenset()


def one_of_each(rows):
    """The ids that stay when all pairs of sets are compared."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or (a and b and len(a & b) >= 0.8 * len(a | b)):
                up[root(i)] = root(j)
    groups = {}
    for k, (ident, _) in enumerate(rows):
        groups.setdefault(root(k), []).append(ident)
    return sorted(min(g) for g in groups.values())


@needs_tables
def test_stages_against_brute_force(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline as p
    from gleaner.llm import quality, toxicity
    from gleaner.llm.common import materialize, table

    docs = table(spark, DATA, "documents")
    seen = {}
    for name, stage in p.STAGES[:-1]:
        out = materialize(stage(spark, docs, DATA), name)
        assert out.columns == list(p.COLUMNS)
        seen[name] = ([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["doc_id"], r["text"]) for r in out.collect()])
        if name == "quality":
            counts = quality.assess(docs).select("doc_id", "n_words", "n_repeat_words", "kept").collect()
            assert sorted(i for i, _ in seen[name][1]) == sorted(r["doc_id"] for r in counts if r["kept"])
            assert all(r["n_words"] >= 10 and 100 * r["n_repeat_words"] <= 20 * r["n_words"] for r in counts if r["kept"])
        if name == "toxicity":
            model = toxicity.fit(docs, table(spark, DATA, "labels"))
            assert sorted(i for i, _ in seen[name][1]) == sorted(i for i, t in seen[name][0] if model.score(t) < p.TOXIC_FROM)
        docs = out
    assert sorted(i for i, _ in seen["near_duplicates"][1]) == one_of_each(seen["near_duplicates"][0])
    times = {}
    for i, _ in seen["mixing"][1]:
        times[i] = times.get(i, 0) + 1
    assert max(times.values()) <= 3 and set(times) <= {i for i, _ in seen["mixing"][0]}
    packed = p.STAGES[-1][1](spark, docs, DATA).toPandas()
    for _, g in packed.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 1024
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = {i: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in seen["mixing"][1]}
    assert packed.groupby("doc_id").length.sum().to_dict() == {i: n * times[i] for i, n in lengths.items()}


@needs_tables
def test_stages_on_odd_rows(spark):
    import corpus_pipeline as p

    text = "the quick brown fox is on the way to a house of many people that was built by hands " * 3
    rows = [(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "a", 0), (3, text, "en", "a", 1), (3, text, "en", "a", 1), (None, text + "and more of it", "de", None, 2), (4, "x " * 50_000, "fr", "b", 3), (5, "日本 " * 30, "ja", "b", 4)]
    docs = spark.createDataFrame([(*r, 7, "z") for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, _row int, SCORE string")
    for name, stage in p.STAGES:
        out = stage(spark, docs, DATA)
        assert name == "packing" or out.columns == list(p.COLUMNS)
        got = [r["doc_id"] for r in out.collect()]
        assert set(got) <= {1, 2, 3, 4, 5, None}
        if name == "near_duplicates":
            assert sorted(got, key=str) == [1, 3, 4, 5]
        if name == "packing":
            assert set(got) == {1, 2, 3, 4, 5, None}
        assert stage(spark, docs.limit(0), DATA).count() == 0


@needs_tables
@pytest.mark.parametrize("name", [f"op{k}" for k in range(1, 14)])
def test_registered_queries_run(spark, name):
    import __spark_entry__

    found = [f for k, f in __spark_entry__.queries().items() if k.startswith(name + "_")]
    assert len(found) == 1 and found[0](spark, DATA).count() > 0
