"""The corpus pipeline: quality rules, toxicity, near-duplicates, mixing, packing, each on what the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which `run` writes as Parquet into the shared folder and
reads again as the next stage's docs. All but the last keep the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import mixing, packing, quality, simhash, toxicity
from gleaner.llm.common import materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document goes when its toxicity score reaches this.
TOXIC_FROM = 0.7


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that every quality rule passes.

    A null or empty text is too short and goes. Repeated rows stay or go alike; a null id, language or source stays as it
    is. An empty table stays empty, columns beyond those of `documents` are left out.
    """
    return quality.assess(docs).filter("kept").select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity score; the model is trained on the labelled rows among `docs`, but for its fold.

    Rows of one text get one score. A null or empty text is scored as an empty one; labels of null ids count for nothing.
    Labels of one kind only, or none, give every document the share of the toxic label as its score (without any: a quarter).
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter(F.col("score") < TOXIC_FROM).select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id; of rows of that id, one.

    Null, empty and wordless texts are one group. A null id stays only where its group has no other.
    """
    return simhash.keep_one(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document as often as its source's target has it, at most three times.

    A null source is a source of its own. Repeated rows are taken one by one, and rows without words as often as their
    source's rate rounds down to.
    """
    return mixing.mix(docs).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all packed sequences, with their ids' digest. A null text is empty and has its end id only."""
    out = packing.pack(docs)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality", keep_good),
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_each),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No SQL: scores of a trained model, 64-bit fingerprints and rounding by a keyed generator are beyond DuckDB's functions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
