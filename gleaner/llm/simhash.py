"""Operator 5: SimHash near-duplicates by a segment-popcount embedding and a grid range-join."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_names, materialize, materialize_by, remove, table, temporary

#: Cells with more fingerprints than this are not paired; their members are linked through one-bit segments instead.
CELL_PAIRS = 64
#: Shingles sorted by count are those that so many of a task's rows have, and the most frequent of them. The rest are sorted
#: by hash: these bounds decide on the cost of the search for similar sets, and on no result. Hashes that a task holds to count.
OFTEN, ORDERED, HELD = 3, 1 << 19, 4_000_000
#: Cells of sets with this number of members or fewer make all their pairs at once. It decides on the cost, and on no result.
SMALL = 16
#: Bits of the fingerprints that joins compare. They decide on the cost, and on no result.
FOLDED = 512
#: Rounds of drawn members at most, draws in each, the pairs for each member from which on they pay, and the members for each
#: link found below which they no longer do. They decide on the cost, and on no result.
TURNS, DRAWS, CROWDED, RARE = 4, 3, 8, 2000


def shingle_hashes(text: str | None, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of the word shingles of a text, A-Z lower-cased; fewer words than `width`: of the whole sequence."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII white space and letters only
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(b" ".join(words), seed)], np.uint64)
    joined = b" ".join
    shifted = [words[k:] for k in range(width)]
    return np.fromiter((digest(joined(s), seed) for s in zip(*shifted, strict=False)), np.uint64, len(words) - width + 1)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint: a bit is 1 if it is set in over half the hashes. In pieces, so that long texts stay small."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        octets = np.ascontiguousarray(hashes[at : at + (1 << 15)]).astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the 64-bit fingerprint (as a signed long) of every row; null and wordless texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [majority(shingle_hashes(t.as_py(), width)) for t in batch.column(1)]
            signed = np.array(marks, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def popcounts(fp: Column, bits: int) -> Column:
    """The embedding: the bit counts of all segments of `bits` bits, packed into one long."""
    room = bits.bit_length()
    out = F.lit(0).cast("long")
    for k in range(64 // bits):
        part = F.shiftrightunsigned(fp, k * bits).bitwiseAND((1 << bits) - 1)
        out = out.bitwiseOR(F.shiftleft(F.bit_count(part).cast("long"), k * room))
    return out


def ball(cell: Column, bits: int) -> Column:
    """The grid cells at Manhattan distance 0 or 1 of a cell."""
    room, near = bits.bit_length(), [cell]
    for k in range(64 // bits):
        count, one = F.shiftrightunsigned(cell, k * room).bitwiseAND((1 << room) - 1), F.lit(1 << (k * room)).cast("long")
        near += [F.when(count < bits, cell + one), F.when(count > 0, cell - one)]
    return F.array_compact(F.array(*near))


def flips(fp: Column) -> Column:
    """A fingerprint and all that differ from it in one bit."""
    ones = [F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)]
    return F.array(fp, *[fp.bitwiseXOR(one) for one in ones])


def links(marks: DataFrame, bits: int = 4, cell_pairs: int = CELL_PAIRS) -> DataFrame:
    """Links (a, b), a < b, between distinct fingerprints `fp` that join all at Hamming distance 2 or less.

    Bit counts of segments move by one at most when a bit flips, so the Manhattan distance of the counts is a lower
    bound of the Hamming distance. Two points at Manhattan distance 2 or less have a common grid cell at distance 1 or
    less from both: every fingerprint goes to the cells of its ball, cells with two or more are joined, and the pairs
    are verified on the bits. A crowded cell is cut finer, down to segments of one bit: there two members of a cell are
    within two bits for certain, so each is linked to the cell's least member and no pairs are made. Links are kept in
    that star form then; the reachable sets are those of all pairs.
    """
    point = marks.select("fp", popcounts(F.col("fp"), bits).alias("cell"))
    dealt = point.select("fp", F.explode(ball(F.col("cell"), bits)).alias("cell"))
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= 2
    cell = Window.partitionBy("cell")  # the points move once: counts and members come from the same deal
    dealt = dealt.select("fp", "cell", F.count("*").over(cell).alias("n"), F.min("fp").over(cell).alias("a"), F.max("fp").over(cell).alias("b"))
    more = materialize(dealt.filter("n > 1").filter((F.col("n") > 2) | ((F.col("fp") == F.col("a")) & near("a", "b"))), "simhash-crowd")
    two = more.filter("n = 2").select("a", "b")
    few = more.filter((F.col("n") > 2) & (F.col("n") <= cell_pairs)).select("cell", "fp")
    left, right = few.withColumnRenamed("fp", "a"), few.withColumnRenamed("fp", "b")
    pairs = left.join(right, (left.cell == right.cell) & (F.col("a") < F.col("b")) & near("a", "b")).select("a", "b")
    crowd = more.filter((F.col("n") > 2) & (F.col("n") > cell_pairs)).select("fp").distinct()
    fine = crowd.select("fp", F.explode(flips(F.col("fp"))).alias("cell"))
    least = fine.groupBy("cell").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1")
    stars = fine.join(least, "cell").filter(F.col("fp") > F.col("a")).select("a", F.col("fp").alias("b"))
    return two.unionByName(pairs).unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the least node reachable.

    Large-star and small-star steps in turn: each hangs a node's neighbours on the least of them, until only stars are
    left. Every step is an aggregation and a join, written to the shared folder; nothing is collected.
    """

    def hang(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
            out = e.join(least, "a").select(F.col("m").alias("a"), "b")  # of a node's neighbours only the larger ones move
        else:
            least = e.groupBy("b").agg(F.min("a").alias("m"))
            out = e.join(least, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
        return out.filter("a < b").distinct()

    state = None
    edges = materialize(edges, "simhash-links")
    while True:
        edges = materialize(hang(materialize(hang(edges, True), "simhash-star"), False), "simhash-star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        state = now


def near_duplicates(docs: DataFrame, width: int = 3, bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and component_id of every row: components of fingerprints linked at two or fewer differing bits.

    component_id is the smallest doc_id reachable, the row's own included. Rows of one fingerprint are one node, so
    copies cost nothing beyond their row. Null, empty and wordless texts have fingerprint 0 and are linked like any
    other. Repeated rows are kept; a null doc_id is never the smallest (a component of null ids only has a null id).
    An empty table gives no rows. Further columns of the input are not read.
    """
    return reachable(materialize(fingerprints(docs, width, id_col, text_col), "simhash-rows"), bits)


def reachable(rows: DataFrame, bits: int = 4) -> DataFrame:
    """doc_id, fp and component_id of written rows (doc_id, fp): see `near_duplicates`."""
    marks = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-marks")
    roots = components(links(marks.select("fp"), bits))
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()
    linked = roots.join(marks, roots.node == marks.fp).select("node", "root", "least")
    linked = materialize(linked, "simhash-linked")
    smallest = linked.groupBy("root").agg(F.min("least").alias("component"))
    named = linked.join(smallest, "root").select(F.col("node").alias("fp"), "component")
    named = marks.join(named, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id"))
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def shingle_sets(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the distinct shingle hashes of every row, as an array of longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                cut = batch.slice(at, 64)
                out = [np.unique(shingle_hashes(t.as_py(), width)).view(np.int64) for t in cut.column(1)]
                yield pa.RecordBatch.from_arrays([cut.column(0), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "shingles"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, shingles array<long>")


def parities(hashes: np.ndarray) -> bytes:
    """The fingerprint of a set: a bit for each residue of the hashes, 1 if an odd number of them has it.

    The Hamming distance of two fingerprints is a lower bound of how many members the sets do not share. The number of
    bits is a power of two, 128 or more and twice the members at least; longer ones fold into shorter ones by exclusive or.
    """
    bits = max(128, 1 << (2 * max(1, len(hashes)) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(hashes: np.ndarray) -> np.ndarray:
    """The fingerprint of `parities` at FOLDED bits for every set, as longs: a weaker bound that a join can test by itself."""
    odd = np.bincount((hashes & np.uint64(FOLDED - 1)).astype(np.int64), minlength=FOLDED) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def differing(a: bytes, b: bytes) -> int:
    """The Hamming distance of two fingerprints of `parities`."""
    x, y = sorted((np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def not_too_far(pairs: DataFrame, marks: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes that the fingerprints of `marks` (node, bits, size) leave a chance of the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(4).to_numpy() + batch.column(5).to_numpy()
            most = (1 - similarity) / (1 + similarity) * sizes + 1e-9  # members not shared, at the similarity
            far = [differing(x.as_py(), y.as_py()) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(np.array(far, np.int64) <= most))

    side = lambda name: marks.select(F.col("node").alias(name), F.col("bits").alias(f"bits_{name}"), F.col("size").alias(f"n_{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "bits_a", "bits_b", "n_a", "n_b")
    return both.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, marks: DataFrame, docs: DataFrame, width: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) of ids of `docs` whose exact Jaccard similarity of shingle sets is `similarity` or more.

    The lower bound of the fingerprints comes first; only for what it leaves are the sets made again and compared.
    """
    pairs = materialize(not_too_far(pairs.distinct(), marks, similarity), "similar-candidates")
    named = pairs.select(F.explode(F.array("a", "b")).alias(id_col)).distinct()
    sets = materialize(shingle_sets(docs.join(named.hint("shuffle_hash"), id_col, "left_semi"), width, id_col, text_col), "similar-sets")
    one, other = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("_a")), sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("_b"))
    both = pairs.join(one, "a").join(other, "b").withColumn("_n", F.size(F.array_intersect("_a", "_b")))
    same = both.filter(F.col("_n") >= similarity * (F.size("_a") + F.size("_b") - F.col("_n")) - 1e-9).select("a", "b")
    same = materialize(same, "similar-pairs")
    remove(docs.sparkSession, sets._scratch)
    return same


def frequencies(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """Rows of two kinds: doc_id, the SimHash `fp`, the digest `sig` of the shingle set, its fingerprints `bits` and `fold` and its
    size `n`; and a shingle `h` that many rows have, with the count `n` (the others are null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def often(sets: list[np.ndarray]) -> pa.RecordBatch:
            found, n = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]), return_counts=True)
            found, n = found[n >= OFTEN].view(np.int64), n[n >= OFTEN]
            return pa.RecordBatch.from_arrays([*[pa.nulls(len(n), pa.int64())] * 2, *[pa.nulls(len(n), pa.binary())] * 2, pa.nulls(len(n), pa.list_(pa.int64())), pa.array(found), pa.array(n, pa.int64())], names)

        names, held, size = ["doc_id", "fp", "sig", "bits", "fold", "h", "n"], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                cut = batch.slice(at, 256)
                hashes = [shingle_hashes(t.as_py(), width) for t in cut.column(1)]
                fps = np.array([majority(h) for h in hashes], np.uint64).view(np.int64)
                sets = [np.unique(h) for h in hashes]
                sigs = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                lengths = pa.array([len(s) for s in sets], pa.int64())
                bits = pa.array([parities(s) for s in sets], pa.binary())
                fold = pa.array([folded(s) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([cut.column(0), pa.array(fps, pa.int64()), pa.array(sigs, pa.binary()), bits, fold, pa.nulls(len(sets), pa.int64()), lengths], names)
                held += sets
                size += sum(map(len, sets))
                if size >= HELD:
                    yield often(held)
                    held, size = [], 0
        yield often(held)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long, sig binary, bits binary, fold array<long>, h long, n long")


def prefixes(docs: DataFrame, often: dict[str, np.ndarray], width: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """The first shingles of every row's set, rare ones first: node, size and place in one number `sp`, and the hash `h`.

    All sets are sorted by one order, the counts in `often` (0: not there) and then the hash. Two sets of size n with the
    similarity have a common shingle among the first n - ceil(similarity n) + 1 of each, whatever the order is; rare ones
    first only make that a sign that few other sets share.
    """
    shared = docs.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = shared.value["h"], shared.value["n"]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                cut = batch.slice(at, 256)
                out = []
                for node, t in zip(cut.column(0).to_pylist(), cut.column(1), strict=True):
                    h = np.unique(shingle_hashes(t.as_py(), width)).view(np.int64)
                    if not (n := len(h)):
                        continue
                    if len(known):
                        k = np.minimum(np.searchsorted(known, h), len(known) - 1)
                        h = h[np.lexsort((h, np.where(known[k] == h, counts[k], 0)))]
                    h = h[: n - math.ceil(similarity * n - 1e-9) + 1]
                    out.append((np.full(len(h), node), (n << 31) + np.arange(len(h), dtype=np.int64), h))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["node", "sp", "h"])

    rows = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "node long, sp long, h long")


def similar_roots(nodes: DataFrame, marks: DataFrame, alike: DataFrame, often: dict[str, np.ndarray], width: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """(node, root) for every row of `nodes` with a link: components of all pairs of the similarity or more.

    `marks` has the fingerprints and the size of every node's set (node, bits, fold, size), `alike` pairs (a, b) whose SimHash
    fingerprints are linked: those are candidates, and what their fingerprints do not bring together is found in cells.

    Sets that share a shingle of their prefixes are in one cell, and every pair of the similarity is in a cell where the
    rest of both sets is long enough for the common part that it needs, which the smaller set's can only be at its first
    places: cells without such a member are left out, and no pair is missed. First the members of a cell are verified
    against its first one. Pairs inside a component add nothing, so a cell whose members are all in one is done, however
    large. Small cells make all other pairs. In large ones, while the pairs of different components are many, the members
    are verified against a few drawn anew in each round, which soon joins what belongs together; of the components that are
    left, all pairs are verified. The joins make only pairs that the folded fingerprints, a lower bound, leave a chance.
    """
    size, place = (lambda c: F.shiftright(c, 31)), (lambda c: c.bitwiseAND((1 << 31) - 1))

    def possible(x: Column, y: Column) -> Column:
        rest = F.least(size(x) - place(x), size(y) - place(y))
        common = similarity / (1 + similarity) * (size(x) + size(y)) - 1e-9
        return (rest >= common) & (F.least(size(x), size(y)) >= similarity * F.greatest(size(x), size(y)) - 1e-9)

    def near(x: str, y: str, xs: str, ys: str) -> Column:
        apart = reduce(Column.__add__, [F.bit_count(F.col(x)[k].bitwiseXOR(F.col(y)[k])) for k in range(FOLDED // 64)])
        return apart <= (1 - similarity) / (1 + similarity) * (size(F.col(xs)) + size(F.col(ys))) + 1e-9

    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    check = lambda pairs: verified(pairs, marks, nodes, width, similarity, id_col, text_col)
    both_ways = lambda roots: roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()
    again = lambda roots, more: components(roots.filter("node != root").select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(more).distinct())

    cell = Window.partitionBy("h")  # the prefixes move once: counts, first members and the members themselves come from one deal
    early = place(F.col("sp")) <= size(F.col("sp")) * ((1 - similarity) / (1 + similarity)) + 1e-9
    first = prefixes(nodes, often, width, similarity, id_col, text_col).repartition("h")
    first = first.select("*", F.count("*").over(cell).alias("n"), F.max(early).over(cell).alias("_early"), F.min("node").over(cell).alias("x"), F.min_by("sp", "node").over(cell).alias("xs"))
    members = materialize(first.filter("n > 1 and _early").select("h", "n", "node", "sp", "x", "xs"), "similar-members")
    stars = members.filter((F.col("x") != F.col("node")) & possible(F.col("xs"), F.col("sp"))).select(*pair("x", "node"))
    roots = components(check(stars.unionByName(alike)))

    named = members.filter("n > 2").select("h", "n", "node", "sp").join(both_ways(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = materialize(named, "similar-named")
    items = named.filter(F.col("n") <= SMALL).groupBy("h").agg(F.collect_list(F.struct("node", "root", "sp")).alias("items")).select("items", F.explode("items").alias("p"))
    others = F.filter("items", lambda q: (q["node"] > F.col("p.node")) & (q["root"] != F.col("p.root")) & possible(q["sp"], F.col("p.sp")))
    small = items.select("p", F.explode(others).alias("q")).select(*pair("p.node", "q.node"))
    roots = again(roots, check(small))

    links, used = None, []
    crowded = materialize(named.filter(F.col("n") > SMALL).select("h", "node", "sp").join(marks.select("node", "fold"), "node"), "similar-crowded")
    for turn in range(TURNS + 1):
        crowd = crowded.join(both_ways(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
        crowd = materialize(crowd.select("h", "root", F.col("node").alias("x"), F.col("sp").alias("xs"), F.col("fold").alias("xf")), "similar-crowd")
        parts = crowd.groupBy("h", "root").agg(F.count("*").alias("n"))
        parts = parts.groupBy("h").agg(F.max(F.struct("n", "root")).alias("most"), F.count("*").alias("parts"), F.sum("n").alias("n"))
        parts = materialize(parts.filter("parts > 1").select("h", "n", "most"), "similar-parts")
        todo = parts.agg(F.sum("n").alias("rows"), F.sum((F.col("n") - F.col("most.n")) * F.col("n")).alias("pairs")).first()
        if not todo["rows"]:
            return roots
        mixed = materialize(crowd.join(parts.select("h", F.col("most.root").alias("main")), "h"), "similar-mixed")
        last = turn == TURNS or todo["pairs"] <= CROWDED * todo["rows"] or (links is not None and links * RARE < todo["rows"])
        if last:
            left = mixed.filter("root != main").select("h", F.col("root").alias("_root"), F.col("x").alias("y"), F.col("xs").alias("ys"), F.col("xf").alias("yf"))  # main ones are all linked
            once = (F.col("root") == F.col("main")) | (F.col("y") < F.col("x"))
        else:
            draw = lambda by: mixed.groupBy("h").agg(F.min_by("root", by).alias("_root"), F.min_by("x", by).alias("y"), F.min_by("xs", by).alias("ys"), F.min_by("xf", by).alias("yf"))  # noqa: B023, E731
            left = reduce(DataFrame.unionByName, [draw(F.xxhash64("h", "x", F.lit(turn), F.lit(k))) for k in range(DRAWS)])
            once = F.lit(True)
        chance = possible(F.col("xs"), F.col("ys")) & near("xf", "yf", "xs", "ys")
        more = check(mixed.join(left, "h").filter((F.col("root") != F.col("_root")) & once & chance).select(*pair("x", "y")))
        links = more.count()
        roots = again(roots, more)
        for path in (*used, crowd._scratch):
            remove(nodes.sparkSession, path)
        used = [mixed._scratch]
        if last:
            return roots
        crowded = mixed.select("h", F.col("x").alias("node"), F.col("xs").alias("sp"), F.col("xf").alias("fold"))  # components only grow: the other cells are done


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id; of repeated rows, one.

    Groups are the components of all pairs whose sets of word shingles have a Jaccard similarity of `similarity` or more;
    rows of one set are one node. Rows that `near_duplicates` brings together by their SimHash fingerprints are verified on
    their sets; cells of common shingles find the pairs whose fingerprints lie further apart. Null, empty and wordless texts
    are one group. Rows with a null id stay only in groups without any id, one in each. An empty table stays empty. The
    columns are those of `docs`, whatever their names.
    """
    row = free_names(docs, "_row")[0]
    # The texts move once, into buckets of the row number; the joins that choose rows below move numbers only.
    numbered = materialize_by(docs.withColumn(row, F.monotonically_increasing_id()), "simhash-docs", row)
    with temporary(docs.sparkSession) as kept:
        found = materialize(frequencies(numbered, width, row, text_col), "simhash-sets")
        rows = found.filter("sig is not null").select("doc_id", "sig")
        marks = found.filter("sig is not null").groupBy("sig").agg(F.min(F.struct("doc_id", "fp")).alias("_m"))
        marks = materialize(marks.select("sig", F.col("_m.doc_id").alias("node"), "_m.fp"), "simhash-nodes")
        prints = found.filter("sig is not null").select(F.col("doc_id").alias("node"), "bits", "fold", F.col("n").alias("size"))
        top = found.filter("sig is null").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(ORDERED).toPandas().sort_values("h")
        often = {"h": top["h"].to_numpy(np.int64), "n": top["n"].to_numpy(np.int64)}
        distinct = numbered.join(marks.select(F.col("node").alias(row)).hint("shuffle_hash"), row, "left_semi")
        alike = reachable(marks.select(F.col("node").alias("doc_id"), "fp")).filter("doc_id != component_id").select(F.col("component_id").alias("a"), F.col("doc_id").alias("b"))
        roots = similar_roots(distinct, prints, alike, often, width, similarity, row, text_col)
        nodes = marks.join(roots, "node", "left").select("sig", F.coalesce("root", "node").alias("root"))
        ids = numbered.select(F.col(row).alias("doc_id"), F.col(id_col).alias("_id"))
        best = rows.join(nodes, "sig").select("doc_id", "root").join(ids, "doc_id").groupBy("root").agg(
            F.min_by("doc_id", F.struct(F.col("_id").isNull(), F.col("_id"), F.col("doc_id"))).alias(row)
        )
        best = materialize(best.select(row), "simhash-best")
        kept.add(best._scratch)
    return numbered.join(best.hint("shuffle_hash"), row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
