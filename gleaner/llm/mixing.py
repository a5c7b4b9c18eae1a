"""Operator 6: mix sources to target weights by pivotal dependent rounding over a reduction tree."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, free_names, materialize, table

#: Documents that one task of the reduction tree pairs at a time.
FAN_IN = 32
#: Documents of each source and power of two of size that wait for the last chain, where they absorb what is left open.
RESERVE = 16
ITEM = "struct<h:bigint,row:bigint,size:double,p:double>"
#: Sources up to this number are broadcast (a row of about 100 bytes each); beyond it they are joined by shuffle.
BROADCAST_SOURCES = 10_000


def source_targets(sized: DataFrame, cap: float = 3.0) -> DataFrame:
    """Targets of all sources: weights 1, 2, 3, repeating by code point order (null last), share all sizes.

    A target stops at `cap` times its source's size; the excess is shared again by weight among the others until none
    is above. Each round is one aggregation over the sources. One row per source: source, source_size, weight, target.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source, not per document
    s = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    s = s.withColumn("rank", F.row_number().over(order) - 1).withColumn("weight", (F.col("rank") % 3 + 1).cast("double"))
    s = materialize(s, "mix-sources")
    total = s.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    share, capped = 0.0, -1
    while True:  # the capped set only grows, and by one source at least
        above = F.col("weight") * share > cap * F.col("source_size")
        row = s.agg(
            F.count_if(above).alias("n"),
            F.coalesce(F.sum(F.when(above, cap * F.col("source_size"))), F.lit(0.0)).alias("fixed"),
            F.sum(F.when(~above, F.col("weight"))).alias("free"),
        ).first()
        if row["n"] == capped or not row["free"]:
            break
        capped, share = row["n"], (total - row["fixed"]) / row["free"]
    return s.withColumn("target", F.least(F.col("weight") * F.lit(share), cap * F.col("source_size")).cast("double"))


def uniform(*keys: Column | int) -> Column:
    """A number in [0, 1) that the keys decide."""
    return F.shiftrightunsigned(F.xxhash64(*[F.lit(k) if isinstance(k, int) else k for k in keys]), 11) / F.lit(float(1 << 53))


def pivot(items: Column, seed: int) -> Column:
    """Pair the items of an array one after the other: struct of the one still open and those decided.

    Two items of probabilities p and q move along the line that keeps size * p + size * q, up or down with the odds
    that keep each expectation, until one of them is 0 or 1; that one is decided and the other meets the next item.
    """

    def step(acc: Column, x: Column) -> Column:
        r = acc["open"]
        return F.transform(F.array(F.struct(r.alias("r"), x.alias("x"))), lambda v: _meet(acc["done"], v["r"], v["x"], seed))[0]

    first = F.struct(
        F.element_at(items, 1).cast(ITEM).alias("open"), F.array().cast("array<struct<row:bigint,copies:int>>").alias("done")
    )
    rest = F.when(F.size(items) > 1, F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(1)))).otherwise(F.slice(items, 1, 0))
    return F.aggregate(rest, first, step)


def _meet(done: Column, r: Column, x: Column, seed: int) -> Column:
    ratio = x["size"] / r["size"]
    moves = F.array(
        F.struct(
            F.least(1 - r["p"], x["p"] * ratio).alias("up"),
            F.least(r["p"], (1 - x["p"]) * ratio).alias("down"),
            uniform(seed, r["h"], x["h"]).alias("u"),
        )
    )

    def outcome(m: Column) -> Column:
        clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
        item = lambda o, p: F.struct(o["h"].alias("h"), o["row"].alias("row"), o["size"].alias("size"), clamp(p).alias("p"))
        decided = lambda o, k: F.struct(o["row"].alias("row"), F.lit(k).alias("copies"))
        result = lambda still, out: F.struct(still.cast(ITEM).alias("open"), F.concat(done, F.array(out)).alias("done"))
        rises = m["u"] * (m["up"] + m["down"]) < m["down"]
        return (
            F.when(rises & (1 - r["p"] <= x["p"] * ratio), result(item(x, x["p"] - m["up"] / ratio), decided(r, 1)))
            .when(rises, result(item(r, r["p"] + m["up"]), decided(x, 0)))
            .when(r["p"] <= (1 - x["p"]) * ratio, result(item(x, x["p"] + m["down"] / ratio), decided(r, 0)))
            .otherwise(result(item(r, r["p"] - m["down"]), decided(x, 1)))
        )

    return F.transform(moves, outcome)[0]


def settle(items: Column, seed: int) -> Column:
    """Decide the items of an array in the order given, largest first: array of (row, copies).

    Each item is made integral in turn, by its share of the mass that is open, and what that leaves goes to the next one. A
    choice that the smaller items together could not make good is not taken, so in the end no more is open than the
    smallest items can leave; where one item outweighs all smaller ones, the choice that misses by less is taken.
    """
    total = lambda value: F.aggregate(items, F.lit(0.0), lambda n, x: n + value(x))

    def step(acc: Column, x: Column) -> Column:
        at = F.struct(
            (acc["open"] + x["p"] * x["size"]).alias("w"), (acc["take"] - (1 - x["p"]) * x["size"]).alias("take"), (acc["give"] - x["p"] * x["size"]).alias("give"),
        )
        return F.transform(F.array(at), lambda v: decide(acc, x, v))[0]

    def decide(acc: Column, x: Column, v: Column) -> Column:
        up, down = v["w"] - x["size"] >= -v["give"] - 1e-9, v["w"] <= v["take"] + 1e-9
        drawn = uniform(seed, x["h"]) * x["size"] < v["w"]
        copies = F.when(F.when(up & down, drawn).when(up != down, up).otherwise(x["size"] - v["w"] - v["give"] < v["w"] - v["take"]), 1).otherwise(0)
        return F.transform(
            F.array(copies),
            lambda k: F.struct(
                (v["w"] - k * x["size"]).alias("open"), v["take"].alias("take"), v["give"].alias("give"), F.concat(acc["done"], F.array(F.struct(x["row"].alias("row"), k.alias("copies")))).alias("done")
            ),
        )[0]

    first = F.struct(
        F.lit(0.0).alias("open"), total(lambda x: (1 - x["p"]) * x["size"]).alias("take"), total(lambda x: x["p"] * x["size"]).alias("give"),
        F.array().cast("array<struct<row:bigint,copies:int>>").alias("done"),
    )
    return F.aggregate(items, first, step, lambda acc: acc["done"])


def round_by_pairs(items: DataFrame, seed: int = 0, fan_in: int = FAN_IN, reserve: int = RESERVE, broadcast: int = BROADCAST_SOURCES) -> DataFrame:
    """Round the probabilities of `items` (group, h, row, size, p) to (row, copies): 0 or 1, near each group's mass.

    Every draw and every order comes from `h`, which no two items share, so the result does not depend on how the items
    lie in files or partitions; `row` is only carried along.

    A level deals every group into blocks of about `fan_in` items by hash, whatever the group's size, and leaves one
    open item in each; the open items are the next level's items, until a group is down to one. A few items of every
    power of two of size stay out of the levels; with that one they are settled in falling order of size, each handing on
    what it leaves open, so that what stays open in the end is small. So no task holds more than a block or a reserve.
    """
    few = items.select("group").distinct().count() <= broadcast
    octave = Window.partitionBy("group", F.floor(F.log2("size"))).orderBy("h", "row")
    last = materialize(items.withColumn("_n", F.row_number().over(octave)).filter(F.col("_n") <= reserve).drop("_n"), "mix-reserve")
    rows = last.select("row")
    items = items.join(F.broadcast(rows) if few else rows, "row", "left_anti")
    item, level, found = F.struct("h", "row", "size", "p"), 0, []
    while True:
        blocks = items.groupBy("group").agg(F.ceil(F.count("*") / fan_in).cast("long").alias("blocks"))
        blocks = materialize(blocks, f"mix-blocks-{level}")
        most = blocks.agg(F.max("blocks")).first()[0]
        if most is None:
            break
        block = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), F.col("h")), F.col("blocks"))
        dealt = items.join(F.broadcast(blocks) if few else blocks, "group").select("group", block.alias("block"), item.alias("item"))
        done = dealt.groupBy("group", "block").agg(F.sort_array(F.collect_list("item")).alias("items"))
        done = materialize(done.select("group", "block", pivot(F.col("items"), seed + level).alias("r")), f"mix-level-{level}")
        found.append(done.select(F.explode("r.done").alias("d")).select("d.row", "d.copies"))
        items, level = done.select("group", "r.open.*"), level + 1
        if most == 1:
            break
    falling = F.struct(F.col("size").alias("by_size"), item.alias("item"))
    chain = items.unionByName(last.select(items.columns)).groupBy("group").agg(F.sort_array(F.collect_list(falling), asc=False).alias("items"))
    chain = chain.select(F.explode(settle(F.transform("items", lambda x: x["item"]), seed + level)).alias("d"))
    out = materialize(chain.select("d.row", "d.copies"), "mix-last")
    for df in found:
        out = out.unionByName(df)
    return out


def mix_rows(sized: DataFrame, cap: float = 3.0, seed: int = 20240521, broadcast: int = BROADCAST_SOURCES) -> DataFrame:
    """Copies of every row of `sized` (row, key, source, size, h), which is read several times: pass a written table.

    A source with target t and size s repeats its documents t / s times on average: floor(t / s) copies for each, and
    one more for those that the rounding picks, so that its words come near t. Rows of size 0 get the floor.
    """
    targets = source_targets(sized, cap)
    few = targets.count() <= broadcast
    side = F.broadcast(targets) if few else targets
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = sized.join(side.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = rows.withColumn("_rate", F.least(rate, F.lit(cap))).withColumn("_floor", F.floor("_rate").cast("int"))
    items = rows.filter((F.col("size") > 0) & (F.col("_rate") > F.col("_floor"))).select(
        F.col("rank").alias("group"),
        F.xxhash64(F.lit(seed), "h").alias("h"),
        "row",
        F.col("size").cast("double").alias("size"),
        (F.col("_rate") - F.col("_floor")).alias("p"),
    )
    extra = round_by_pairs(items, seed, broadcast=broadcast)
    return rows.join(extra, "row", "left").select(
        "row", "key", "source", "size", "source_size", "target", (F.col("_floor") + F.coalesce("copies", F.lit(0))).alias("copies")
    )


def told_apart(rows: DataFrame) -> DataFrame:
    """Rows (.., row, h) with an `h` that no two share: the numbers among equal ones, 0, 1, .., are hashed in.

    `row` is numbered by partition, so the number within a partition and the counts of the partitions before it give the
    place, and a value that most rows have is still dealt over all partitions.
    """
    many = materialize(rows.groupBy("h").agg(F.count("*").alias("_n")).filter("_n > 1").select("h"), "mix-repeated")
    part = rows.join(many, "h", "left_semi").withColumn("_part", F.shiftright("row", 33))
    here = Window.partitionBy("h", "_part").orderBy("row")
    counts = part.groupBy("h", "_part").agg(F.count("*").alias("_c"))
    before = Window.partitionBy("h").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    counts = counts.select("h", "_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    placed = part.withColumn("_k", F.row_number().over(here) - 1).join(counts, ["h", "_part"])
    placed = placed.withColumn("h", F.xxhash64("h", F.col("_before") + F.col("_k"))).select(*rows.columns)
    return rows.join(many, "h", "left_anti").select(*rows.columns).unionByName(placed)


def sized_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """row, key, source, size (words of the text; null: 0) and a hash `h` of its own for every document, written twice.

    `row` is the column `row_col`, numbered by partition, or such a number given here. `h` comes from all columns that can
    be hashed, so it is the same wherever the row lies; equal rows are told apart by their number among each other.
    """
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    size = F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    simple = [f.name for f in docs.schema.fields if f.name != row_col and not re.search("map<|variant", f.dataType.simpleString())]
    h = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(simple)])
    rows = docs.select(row.alias("row"), F.col(id_col).alias("key"), F.col(source_col).alias("source"), size.alias("size"), h.alias("h"))
    return materialize(told_apart(materialize(rows, "mix-read")), "mix-rows")


def mix(docs: DataFrame, cap: float = 3.0, seed: int = 20240521, broadcast: int = BROADCAST_SOURCES) -> DataFrame:
    """The mix itself: every document as often as it was taken, in the columns of `docs`.

    Null texts and empty texts have size 0 and are taken as often as their source's rate rounds down to. A null source
    is a source of its own. Repeated rows are rounded one by one. An empty table gives an empty mix. Equal rows give equal
    results, however they lie in files and partitions. Further columns stay as they are, whatever their names.
    """
    row, copy, times = free_names(docs, "_row", "_copy", "copies")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "mix-docs")
    copies = mix_rows(sized_rows(numbered, row_col=row), cap, seed, broadcast)
    copies = copies.select(F.col("row").alias(row), F.col("copies").alias(times)).filter(F.col(times) > 0)
    out = numbered.join(copies, row).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    out = mix_rows(sized_rows(table(spark, sf_dir, "documents").select("doc_id", "text", "source")))
    return out.select(
        F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken")
    )
