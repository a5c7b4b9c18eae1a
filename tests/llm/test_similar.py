import os

from gleaner.llm import simhash
from gleaner.sources import scratch

TEXT = " ".join(f"w{k}" for k in range(60))
LONG = (TEXT + " ") * 9


def test_candidates_come_from_fingerprints_too(spark, monkeypatch):
    """Sets that SimHash brings together are verified, and only those of the similarity stay together."""
    rows = [(1, LONG), (2, LONG + "tail"), (3, "another text that shares nothing with them at all"), (4, LONG)]
    seen = []
    real = simhash.similar_roots
    monkeypatch.setattr(simhash, "similar_roots", lambda nodes, marks, alike, *rest: (seen.append(alike.count()), real(nodes, marks, alike, *rest))[1])
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
    assert seen == [1]


def test_scratch_of_near_duplicates_goes_before_its_result_is_read(spark):
    before = scratch.shared_dir(spark).removeprefix("file://") + "/gleaner"
    had = set(os.listdir(before)) if os.path.isdir(before) else set()
    rows = [(k, TEXT.replace("w7 ", f"x{k % 7} ")) for k in range(40)]
    simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    left = {n.rpartition("-")[0] for n in set(os.listdir(before)) - had}
    assert left == {"simhash-docs", "simhash-best"}


def test_temporary_keeps_what_is_named_and_goes_on_errors(spark):
    here = lambda df: os.path.isdir(df._scratch.removeprefix("file://"))
    made = []
    with scratch.temporary(spark) as outer:
        with scratch.temporary(spark) as inner:
            made = [scratch.materialize(spark.range(2), f"t{k}") for k in range(3)]
            inner.update(df._scratch for df in made[1:])
        assert [here(df) for df in made] == [False, True, True]
        outer.add(made[2]._scratch)
    assert [here(df) for df in made] == [False, False, True]
    try:
        with scratch.temporary(spark):
            made.append(scratch.materialize(spark.range(2), "t"))
            raise ValueError
    except ValueError:
        assert not here(made[-1])
