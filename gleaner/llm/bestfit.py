"""Operator 13: best-fit packing by a grouping genetic algorithm on islands.

A solution is a set of bins. Documents of one length are alike, so a bin is a pattern, the lengths in it with their copies,
and a solution says how often each pattern is used: its size is bounded by the number of lengths, whatever the input.
"""

from __future__ import annotations

import json
import random
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table
from .packing import BROADCAST_BYTES, END, encode_documents, spans

WINDOW = 2048
ISLANDS = 8
POPULATION = 6
EPOCHS = 3
GENERATIONS = 8

#: The lengths of a bin in falling order, each with its copies.
Pattern = tuple[tuple[int, int], ...]
Bins = dict[Pattern, int]


def fill(pattern: Pattern) -> int:
    return sum(length * copies for length, copies in pattern)


def put(pattern: Pattern, length: int, copies: int) -> Pattern:
    """The pattern with more copies of a length, in falling order of lengths."""
    held = dict(pattern)
    held[length] = held.get(length, 0) + copies
    return tuple(sorted(held.items(), reverse=True))


def insert(bins: Bins, left: list[int], window: int) -> None:
    """Best-fit documents (`left`: how many of each length) in falling order of length: each goes where the gap is tightest.

    All bins of a pattern are filled alike, so a step moves many documents; where nothing has room, bins are opened.
    """
    by_gap: dict[int, list[Pattern]] = {}
    gaps = 0  # a bit for each gap that some bin has
    for pattern in bins:
        gap = window - fill(pattern)
        by_gap.setdefault(gap, []).append(pattern)
        gaps |= 1 << gap

    def change(old: Pattern | None, length: int, copies: int, times: int) -> None:
        nonlocal gaps
        if old is not None:
            bins[old] -= times
            if not bins[old]:
                del bins[old]
                gap = window - fill(old)
                by_gap[gap].remove(old)
                if not by_gap[gap]:
                    gaps &= ~(1 << gap)
        new = put(old or (), length, copies)
        if new in bins:
            bins[new] += times
        else:
            bins[new] = times
            gap = window - fill(new)
            by_gap.setdefault(gap, []).append(new)
            gaps |= 1 << gap

    for length in range(len(left) - 1, 0, -1):
        todo = left[length]
        while todo:
            room = gaps >> length
            gap = (room & -room).bit_length() - 1 + length if room else window
            old = by_gap[gap][-1] if room else None
            each = min(todo, gap // length)
            times = todo // each if old is None else min(bins[old], todo // each)
            change(old, length, each, times)
            todo -= each * times
        left[length] = 0


def greedy(histogram: list[int], window: int, rng: random.Random, noise: float) -> Bins:
    """A first solution: bins begun with the longest document and filled by the longest that fits, now and then by any."""
    left, bins = list(histogram), {}
    mask = sum(1 << n for n, k in enumerate(left) if k and n)
    while mask:
        length = mask.bit_length() - 1
        used, gap = {length: 1}, window - length
        free = mask if left[length] > 1 else mask & ~(1 << length)
        while gap and (fits := free & ((1 << (gap + 1)) - 1)):
            length = fits.bit_length() - 1
            if rng.random() < noise:  # the longest below a random length
                below = fits & ((1 << (rng.randint(1, length) + 1)) - 1)
                length = below.bit_length() - 1 if below else length
            gap -= length
            used[length] = used.get(length, 0) + 1
            if left[length] == used[length]:
                free &= ~(1 << length)
        times = min(left[n] // k for n, k in used.items())
        if noise and times > 1:
            times = max(1, int(times * rng.uniform(0.4, 1)))
        pattern = tuple(sorted(used.items(), reverse=True))
        bins[pattern] = bins.get(pattern, 0) + times
        for n, k in used.items():
            left[n] -= k * times
            if not left[n]:
                mask &= ~(1 << n)
    return bins


def fitness(bins: Bins, window: int) -> tuple[int, float]:
    """Fewer bins are better; of as many, those whose fill is least even."""
    return sum(bins.values()), -sum((times * (fill(p) / window) ** 2 for p, times in bins.items()), 0.0)


def crossover(a: Bins, b: Bins, histogram: list[int], window: int, rng: random.Random) -> Bins:
    """Inject whole well-filled bins of `b` into `a`; bins of `a` that hold the same documents go, and what they held besides
    is inserted again by best fit. Of a pattern as many bins stay as the documents left over allow."""
    full = sorted(b, key=lambda p: (window - fill(p), p))
    full = full[: max(1, len(full) * 2 // 3)]
    left, child = list(histogram), {}
    for pattern in rng.sample(full, max(1, int(len(full) * rng.uniform(0.1, 0.6)))):
        child[pattern] = b[pattern]
        for length, copies in pattern:
            left[length] -= copies * b[pattern]
    for pattern in sorted(a, key=lambda p: (window - fill(p), p)):
        times = min(a[pattern], *(left[length] // copies for length, copies in pattern))
        if times:
            child[pattern] = child.get(pattern, 0) + times
            for length, copies in pattern:
                left[length] -= copies * times
    insert(child, left, window)
    return child


def mutated(bins: Bins, window: int, rng: random.Random) -> Bins:
    """Take the worst-filled bins and some others apart and insert their documents again."""
    out, left = dict(bins), [0] * window
    worst = sorted(out, key=lambda p: (fill(p), p))
    for pattern in {*worst[: max(1, len(worst) // 20)], *rng.sample(worst, max(1, len(worst) // 20))}:
        for length, copies in pattern:
            left[length] += copies * out[pattern]
        del out[pattern]
    insert(out, left, window)
    return out


def evolve(population: list[Bins], histogram: list[int], window: int, rng: random.Random, generations: int) -> list[Bins]:
    """Some generations of one island: tournaments choose parents, the worst make room."""
    least = -(-sum(n * k for n, k in enumerate(histogram)) // window)
    scored = sorted(((fitness(p, window), k, p) for k, p in enumerate(population)), key=lambda x: x[:2])
    made = len(scored)
    for _ in range(generations):
        if scored[0][0][0] == least:  # no solution has fewer bins
            break
        for _ in range(max(1, len(scored) // 2)):
            a, b = (min(rng.sample(range(len(scored)), min(2, len(scored)))) for _ in range(2))
            child = crossover(scored[a][2], scored[b][2], histogram, window, rng)
            if rng.random() < 0.5:
                child = mutated(child, window, rng)
            made += 1
            scored[-1] = (fitness(child, window), made, child)
            scored.sort(key=lambda x: x[:2])
    return [p for _, _, p in scored]


def _write(bins: Bins) -> list:
    return [[list(map(list, p)), times] for p, times in bins.items()]


def _read(stored: list) -> Bins:
    return {tuple(map(tuple, p)): times for p, times in stored}


def islands_best(spark: SparkSession, histogram: list[int], window: int, seed: int = 13, islands: int = ISLANDS, population: int = POPULATION, epochs: int = EPOCHS, generations: int = GENERATIONS) -> Bins:
    """The best solution of all islands. Each island is a task; after an epoch its elite goes to the next island.

    Populations are written after each epoch, so a lost executor costs one epoch of its islands. All draws come from the
    seed, the island and the epoch, so reruns agree. It ends early when the bins are as few as the sum of lengths allows.
    """
    given = spark.sparkContext.broadcast(histogram)  # `window` numbers
    least = -(-sum(n * k for n, k in enumerate(histogram)) // window)

    def step(epoch: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    rng = random.Random(f"{seed} {r['island']} {epoch}")
                    if epoch == 0:
                        people = [greedy(given.value, window, rng, rng.uniform(0.02, 0.5) if k or r["island"] else 0.0) for k in range(population)]
                    else:
                        people = [_read(p) for p in json.loads(r["people"])]
                        people[-1] = _read(json.loads(r["guest"]))
                    people = evolve(people, given.value, window, rng, generations)
                    bins, even = fitness(people[0], window)
                    columns = [[r["island"]], [json.dumps([_write(p) for p in people])], [json.dumps(_write(people[0]))], [bins], [even]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["island", "people", "elite", "bins", "even"])

        return run

    schema = "island long, people string, elite string, bins long, even double"
    rows = spark.range(0, islands, 1, islands).select(F.col("id").alias("island"), F.lit("").alias("people"), F.lit("").alias("guest"))
    for epoch in range(epochs):
        out = materialize(rows.mapInArrow(step(epoch), schema), "islands")
        best = out.orderBy("bins", "even", "island").select("bins", "elite").first()
        if best["bins"] == least:
            break
        guests = out.select(((F.col("island") + 1) % islands).alias("island"), F.col("elite").alias("guest"))
        rows = out.select("island", "people").join(guests, "island").repartition(islands, "island")
    return _read(json.loads(best["elite"]))


def slots_of(bins: Bins, window: int) -> tuple[list[np.ndarray], int]:
    """For each length its slots (first rank, first sequence, offset, copies) in rising rank, and the number of sequences."""
    slots: list[list[tuple[int, int, int, int]]] = [[] for _ in range(window)]
    ranks, sequence = [0] * window, 0
    for pattern, times in sorted(bins.items()):
        offset = 0
        for length, copies in pattern:
            slots[length].append((ranks[length], sequence, offset, copies))
            ranks[length] += times * copies
            offset += length * copies
        sequence += times
    return [np.array(s, np.int64).reshape(-1, 4) for s in slots], sequence


def pieces_of(n: int, rank: int, first_window: int, slots: list[np.ndarray], sequences: int, window: int) -> list[tuple[int, int, int, int]]:
    """(start, length, sequence, offset) of the pieces of one document: what is beyond whole windows comes first."""
    rest, out = n % window, []
    if rest:
        own = slots[rest]
        start, sequence, offset, copies = own[int(np.searchsorted(own[:, 0], rank, "right")) - 1].tolist()
        out.append((0, rest, sequence + (rank - start) // copies, offset + (rank - start) % copies * rest))
    return [*out, *((rest + k * window, window, sequences + first_window + k, 0) for k in range(n // window))]


def pack_whole(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, end: int = END, broadcast_bytes: int = BROADCAST_BYTES, **search: int) -> DataFrame:
    """Pack documents whole into as few sequences of at most `window` ids as it can. One row per piece, with its ids.

    Documents are encoded once, with the id `end` behind them. One that is longer than a window is cut into whole windows
    behind a first piece with the rest, and each whole window is a sequence of its own. The rests are packed by a grouping
    genetic algorithm over the histogram of their lengths (fewer than `window` numbers, whatever the input): islands, which
    are tasks, cross solutions by injecting whole well-filled bins, and send their elites around. A document finds its place
    by its rank among those of its length, so texts and ids are not moved; what partitions before each one hold is
    broadcast, in runs of partitions of at most `broadcast_bytes`.

    A null text counts as empty: it has the end id only. Repeated rows are packed one by one; a null id is kept. An empty
    table gives no pieces. Only doc_id and text are read. Returns doc_id, piece, start, length, ids (binary, unsigned
    little-endian 32-bit), sequence_id, offset.
    """
    spark = docs.sparkSession
    rows = materialize(encode_documents(docs, vocabulary, end, window), "bestfit-ids")
    counts = rows.groupBy("part", "rest").agg(F.count("*").alias("n"), F.sum(F.expr(f"octet_length(ids) div {4 * window}")).alias("w"))
    counts = materialize(counts, "bestfit-counts")
    histogram = [0] * window
    for r in counts.groupBy("rest").agg(F.sum("n").alias("n")).collect():  # at most `window` rows
        histogram[r["rest"]] = r["n"] if r["rest"] else 0
    slots, sequences = slots_of(islands_best(spark, histogram, window, **search), window)
    shape = spark.sparkContext.broadcast(slots)
    before = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select("part", "rest", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ranks_before"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    whole = counts.groupBy("part").agg(F.sum("w").alias("w"))
    whole = whole.select("part", F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("windows_before"))
    offsets = materialize(ranks.join(whole, "part"), "bestfit-offsets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                cols = {k: [] for k in ("doc_id", "piece", "start", "length", "ids", "sequence_id", "offset")}
                for doc, ids, rank, windows in zip(*[c.to_pylist() for c in batch.slice(at, 64).columns], strict=True):
                    for piece, (start, length, sequence, offset) in enumerate(pieces_of(len(ids) // 4, rank, windows, shape.value, sequences, window)):
                        for k, v in zip(cols, (doc, piece, start, length, ids[4 * start : 4 * (start + length)], sequence, offset), strict=True):
                            cols[k].append(v)
                types = {"ids": pa.binary(), "piece": pa.int32()}
                yield pa.RecordBatch.from_arrays([pa.array(v, types.get(k, pa.int64())) for k, v in cols.items()], list(cols))

    def placed(first: int, last: int) -> DataFrame:
        near = F.col("part").between(first, last)  # a file holds one partition, so others are skipped by their statistics
        joined = rows.filter(near).join(F.broadcast(offsets.filter(near)), ["part", "rest"])
        shifted = joined.select("doc_id", "ids", (F.col("rank") + F.col("ranks_before")).alias("rank"), (F.col("windows") + F.col("windows_before")).alias("windows"))
        return shifted.mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long")

    runs = spans(offsets, broadcast_bytes) or [(0, 0)]
    if len(runs) == 1:
        return placed(*runs[0])
    return reduce(DataFrame.unionByName, [materialize(placed(*r), "bestfit-pieces") for r in runs])


def op13_bestfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all documents in sequences of at most 2048 ids."""
    out = pack_whole(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
