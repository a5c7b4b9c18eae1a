"""Every registered query of the core library against its SQL, over the smallest tables."""

import math
import os

import duckdb
import pytest

from gleaner.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(df):
    def plain(v):
        v = v.item() if hasattr(v, "item") else v
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6)
        return v

    df = df[sorted(df.columns)]
    return sorted((tuple(plain(x) for x in r) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    if name in registry.ORACLE_SQL:
        expected = duck.execute(registry.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(expected.columns)
        assert rows(got) == rows(expected)
    else:
        assert len(got) > 0


def test_entry(spark):
    import __spark_entry__

    if os.path.isdir(__spark_entry__.ENTRY_DIR):
        assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_repeats_within_a_time_are_dropped_from_a_stream(spark, tmp_path):
    from gleaner.streaming import events as E

    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    stream = E.without_repeats(E.event_stream(spark, DATA))
    got = E.run_once(stream, "gleaner_repeats", str(tmp_path / "c")).count()
    everything = spark.read.parquet(f"{DATA}/events.parquet")
    assert everything.select("user_id", "event_type").distinct().count() <= got <= everything.count()


def test_shapes_of_lines_beside_other_letters_and_of_empty_texts(spark, tmp_path):
    """Words end at ASCII characters, letters fold as in SQL, and a text without lines is a run."""
    odd = ["so ñerr!! x", "an éerror y", "errorñ and z", "a fail: x", "a fail:x", "paſst aſſert", "tracK tracebacK", "faıled faİled", "exit code", "_error_ 1", "x ERR! y"]
    texts = [(k, "en", "s" if k % 2 else "t", text) for k, text in enumerate(["\n".join(odd)] * 4 + ["", "", "so ñerr!! x"])]
    spark.createDataFrame(texts, "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("suggest_shapes", "suggest_drafts"):
        got, expected = registry.QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(registry.ORACLE_SQL[name]).df()
        assert rows(got) == rows(expected)
    assert len(registry.QUERIES["suggest_shapes"](spark, str(tmp_path)).toPandas()) > 3
