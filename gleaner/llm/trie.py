"""Operator 12: the prefix trie of conversations, from a global sort of turn arrays and a sweep of their common prefixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, table

#: Bytes that stand for a turn in a turn array: the head of its SHA-256.
WIDTH = 16
#: Closed nodes that a task holds before it hands them on.
HELD = 200_000
#: Ids of equal conversations that are handed on as one text where their group goes on in another partition.
IDS = 4_096
BASE_EVERY = 20
BASE_MODULUS = 4


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, path (the digests of its turns, one behind the other) and words (of each turn's text).

    Turns are ordered by (turn, role, text) with nulls first; null roles and texts are empty.
    """
    clean = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).filter("conv_id is not null")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    said = F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text")
    digest = F.substring(F.unhex(F.sha2(said, 256)), 1, WIDTH)
    rows = clean.select("conv_id", place.alias("at"), digest.alias("digest"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    rows = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "digest", "words"))).alias("turns"))
    return rows.select("conv_id", F.transform("turns", lambda t: F.struct(t.digest.alias("digest"), t.words.alias("words"))).alias("turns"))


def rebuilt(conversations: DataFrame, every: int = BASE_EVERY, modulus: int = BASE_MODULUS) -> DataFrame:
    """conv_id, path, words of each conversation behind the first turns of its base.

    The base of c is c - c % every, of which the first h turns come first, h being crc32(decimal c) % modulus; then what c
    itself has after its first h turns. At most modulus - 1 turns of a base are moved, and a base has few followers.
    """
    own = materialize(turns(conversations), "trie-turns")
    base = own.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, modulus - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % modulus).cast("int")
    rows = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", h).join(base, "base", "left")
    none = F.slice("turns", 1, 0)
    head = F.when(F.col("head").isNull() | (F.col("h") == 0), none).otherwise(F.expr("slice(head, 1, greatest(h, 1))"))
    rest = F.when(F.size("turns") > F.col("h"), F.expr("slice(turns, h + 1, greatest(size(turns) - h, 1))")).otherwise(none)
    rows = rows.select("conv_id", F.concat(head, rest).alias("turns"))
    return rows.select("conv_id", "turns.digest", "turns.words")


def shared(a: bytes, b: bytes) -> int:
    """How many turns two turn arrays begin with in common."""
    most = min(len(a), len(b)) // WIDTH
    if a[: most * WIDTH] == b[: most * WIDTH]:
        return most
    at = 0
    while a[at * WIDTH : at * WIDTH + WIDTH] == b[at * WIDTH : at * WIDTH + WIDTH]:
        at += 1
    return at


class Node:
    """An open node: what its closed children and its own ends have brought so far."""

    __slots__ = ("number", "words", "least", "n_convs", "n_children", "n_leaves", "saved", "ends", "ids", "seen")

    def __init__(self, number: int, words: int) -> None:
        self.number, self.words, self.least = number, words, None
        self.n_convs = self.n_children = self.n_leaves = self.saved = 0
        self.ends, self.ids = None, []
        self.seen = False  # whether a deeper turn was met in this block


#: Nodes (kind n), parts of nodes that other partitions share (p), their ids in pieces (i), and who an early child's parent is (f).
SWEPT = (
    "kind string, part int, number long, up long, node binary, up_node binary, conv_id long, depth long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ids string"
)
EMPTY = hashlib.sha256(b"").hexdigest()


NAMES = [c.split()[0] for c in SWEPT.split(", ")]


def _batch(rows: list[list]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(NAMES)
    types = {"kind": pa.string(), "part": pa.int32(), "node": pa.binary(), "up_node": pa.binary(), "ends_sha256": pa.string(), "ids": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, types.get(n, pa.int64())) for n, c in zip(NAMES, columns, strict=True)], NAMES)


class Sweep:
    """One block of sorted turn arrays, read from its first to its last.

    `before` and `after` are the turns that its first and last array share with the neighbouring blocks (-1: there is
    none). Nodes on those paths go on beyond the block; they, and the root, come out as parts, which add up. What belongs
    to a node once (that it is a leaf, a child, has its first copy) is counted where it ends, so a part that goes on in
    the next block leaves it out. A closed node knows its parent's number; the parent's least conversation is known when
    that closes, so children handed on earlier are joined with a row of kind f.
    """

    def __init__(self, block: int, first: bytes, before: int, after: int, ids: int) -> None:
        self.block, self.first, self.before, self.after, self.most = block, first, before, after, ids
        self.number, self.path, self.stack = 0, b"", [Node(0, 0)]
        self.closed: list[list] = []
        self.parents: dict[int, int] = {}  # least conversation of closed nodes, which their children among `closed` need
        self.told: set[int] = set()  # open parents of children that were handed on

    def add(self, path: bytes, words: list[int], conv: int) -> None:
        common = shared(self.path, path)
        while len(self.stack) - 1 > common:
            self._pop(False)
        self.path, depth = path, len(path) // WIDTH
        while len(self.stack) - 1 < depth:
            self.number += 1
            self.stack.append(Node(self.number, words[len(self.stack) - 1]))
        for x in self.stack[common:depth]:  # those above were seen with an earlier array
            x.seen = True
        top = self.stack[-1]
        top.n_convs += 1
        top.least = conv if top.least is None else min(top.least, conv)
        if depth == 0 or depth <= self.after or depth <= self.before and self.first[: depth * WIDTH] == path:
            top.ids.append(conv)  # the group may go on in another block: its ids are digested later
            if len(top.ids) >= self.most:
                self._ids(depth, top)
        if top.ends is None:
            top.ends = hashlib.sha256(str(conv).encode())
        else:
            top.ends.update(f",{conv}".encode())

    def flush(self) -> pa.RecordBatch:
        for row in self.closed:
            if row[0] == "n":
                row[8] = self.parents.get(row[3])
                if row[8] is None:
                    self.told.add(row[3])
        out, self.closed, self.parents = _batch(self.closed), [], {}
        return out

    def end(self) -> pa.RecordBatch:
        while self.stack:
            self._pop(True)
        return self.flush()

    def _pop(self, last: bool) -> None:
        """Close the deepest node; `last`: the block is over, so nodes on the path may go on."""
        depth, x = len(self.stack) - 1, self.stack.pop()
        goes_on = last and depth <= self.after
        begun = depth <= self.before and self.first[: depth * WIDTH] == self.path[: depth * WIDTH]
        if not goes_on:
            x.n_leaves += not x.seen
            x.saved -= x.words
        x.saved += x.n_convs * x.words
        up = self.stack[-1] if self.stack else None
        if up is not None:
            up.n_convs += x.n_convs
            up.n_leaves += x.n_leaves
            up.saved += x.saved
            up.n_children += not goes_on
            up.least = x.least if up.least is None else min(up.least, x.least)
        row = [None, self.block, x.number, up.number if up else None, None, None, x.least, depth, None, x.n_convs, x.n_children, x.n_leaves, x.saved, None, None]
        if goes_on or begun or depth == 0:
            row[0], row[4], row[5] = "p", self._identity(depth), self._identity(depth - 1) if depth else None
            if x.ids:
                self._ids(depth, x)
        else:
            row[0], row[13] = "n", x.ends.hexdigest() if x.ends else EMPTY
            self.parents[x.number] = x.least
            if x.number in self.told:
                self.told.discard(x.number)
                self.closed.append(["f", self.block, x.number, None, None, None, x.least, *[None] * 8])
        self.closed.append(row)

    def _identity(self, depth: int) -> bytes:
        return hashlib.sha256(self.path[: depth * WIDTH]).digest()

    def _ids(self, depth: int, x: Node) -> None:
        self.closed.append(["i", self.block, None, None, self._identity(depth), None, x.ids[0], *[None] * 7, ",".join(map(str, x.ids))])
        x.ids = []


def sweep(ordered: DataFrame, held: int = HELD, ids: int = IDS) -> DataFrame:
    """Rows of SWEPT from rows of block, before, after, path, words, conv_id that are sorted within their block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            for block, before, after, path, words, conv in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now is None or now.block != block:
                    if now is not None:
                        yield now.end()
                    now = Sweep(block, path, before, after, ids)
                now.add(path, words, conv)
                if len(now.closed) >= held:
                    yield now.flush()
        if now is not None:
            yield now.end()

    return ordered.select("block", "before", "after", "path", "words", "conv_id").mapInArrow(run, SWEPT)


def borders(ordered: DataFrame) -> DataFrame:
    """block, before, after: how many turns the first and last array of a block share with its neighbours; -1: none there."""
    ends = ordered.groupBy("block").agg(F.min("path").alias("low"), F.max("path").alias("high"))
    line = Window.orderBy("block")  # a row for each block
    ends = ends.select("block", F.lag("high").over(line).alias("left"), "low", "high", F.lead("low").over(line).alias("right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = lambda a, b: -1 if a is None or b is None else shared(a, b)
        for batch in batches:
            block, left, low, high, right = [c.to_pylist() for c in batch.columns]
            both = [pa.array([turns(a, b) for a, b in zip(x, y, strict=True)], pa.int32()) for x, y in ((left, low), (high, right))]
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), *both], ["block", "before", "after"])

    return ends.mapInArrow(run, "block int, before int, after int")


def digests(pieces: DataFrame) -> DataFrame:
    """node, ends_sha256 of the groups of equal conversations whose ids came in pieces, in ascending order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()])], ["node", "ends_sha256"])
        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if node == now:
                    digest.update(b",")
                elif now is not None:
                    yield row()
                if node != now:
                    now, digest = node, hashlib.sha256()
                digest.update(text.encode())
        if now is not None:
            yield row()

    rows = pieces.select("node", "ids", "conv_id").repartition("node").sortWithinPartitions("node", "conv_id").select("node", "ids")
    return rows.mapInArrow(run, "node binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, every: int = BASE_EVERY, modulus: int = BASE_MODULUS, held: int = HELD, ids: int = IDS) -> DataFrame:
    """The trie of all prefixes of rebuilt conversations (see `rebuilt`), a row for each node.

    Conversations become arrays of turn digests, which are sorted over the whole cluster; equal arrays lie by conv_id, so a
    group of copies may fill many partitions. Each partition is swept once: the common prefix of neighbouring arrays closes
    and opens nodes on a stack as deep as a conversation. Nodes that go on over partition borders come out in parts that
    are added up by a digest of their prefix; there are no more of them than turns that neighbouring partitions share.
    The digest of a group of equal conversations is sequential by its definition; where such a group crosses a border, its
    ids reach one task as texts of up to `ids` ids, in order, and are read one by one.

    Turns are ordered by (turn, role, text), null turns first; a null role or text is empty; repeated rows are turns of
    their own. Rows without a conv_id belong to no conversation and are left out. A conversation that is left without turns
    is a member of the root alone. An empty table has no nodes. Further columns are not read. A conversation's digests
    (16 bytes a turn) are one row. Returns conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256.
    """
    rows = rebuilt(conversations, every, modulus).select("conv_id", F.expr("array_join(transform(digest, d -> hex(d)), '')").alias("path"), "words")
    rows = rows.select(F.unhex("path").alias("path"), "words", "conv_id")
    ordered = rows.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    ordered = ordered.select("*", F.spark_partition_id().alias("block"))
    ordered = materialize(ordered, "trie-order")
    placed = ordered.join(borders(ordered), "block").repartition("block").sortWithinPartitions("block", "path", "conv_id")
    swept = materialize(sweep(placed, held, ids), "trie-swept")

    parts = swept.filter("kind = 'p'")
    whole = parts.groupBy("node", "up_node", "depth").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    )
    whole = materialize(whole, "trie-shared")
    above = whole.select(F.col("node").alias("up_node"), F.col("conv_id").alias("parent_conv_id"))
    named = whole.join(above, "up_node", "left").join(digests(swept.filter("kind = 'i'")), "node", "left")
    named = named.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
    # Children of nodes that closed later, or elsewhere, look their parent up by its number in the partition.
    facts = swept.filter("kind = 'f'").select("part", F.col("number").alias("up"), F.col("conv_id").alias("_parent"))
    facts = facts.unionByName(parts.select("part", F.col("number").alias("up"), "node").join(whole.select("node", F.col("conv_id").alias("_parent")), "node").select("part", "up", "_parent"))
    nodes = swept.filter("kind = 'n'")
    late = nodes.filter("parent_conv_id is null").drop("parent_conv_id").join(facts, ["part", "up"]).withColumnRenamed("_parent", "parent_conv_id")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return nodes.filter("parent_conv_id is not null").select(columns).unionByName(late.select(columns)).unionByName(named.select(columns))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt on the first turns of its base."""
    return prefix_trie(table(spark, sf_dir, "conversations"))
