"""Operator 1: pack token sequences by non-negative least squares over the histogram of lengths."""

from __future__ import annotations

import base64
import json
import os
import sys
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

WINDOW = 1024
END = 0
#: Offsets of partitions are broadcast up to this size; more partitions are placed in several passes.
BROADCAST_BYTES = 64 << 20


def default_vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Ids of a byte-level vocabulary.

    Added tokens, which the tokenizers library's file of the same name beside the vocabulary lists, are matched in the
    text first and have their own ids; without such a file there are none.
    """

    def __init__(self, ranks_path: str, pattern: str) -> None:
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        listed = os.path.splitext(ranks_path)[0] + ".json"
        added = {}
        if os.path.exists(listed):
            with open(listed, encoding="utf-8") as file:
                added = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
        encoding = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
        self._added, self._encode = tuple(added), encoding.encode_ordinary
        self._encode_added = lambda text: encoding.encode(text, allowed_special="all")

    def ids(self, text: str) -> bytes:
        """The ids as unsigned little-endian 32-bit numbers."""
        found = array("I", (self._encode_added if any(token in text for token in self._added) else self._encode)(text))
        if sys.byteorder == "big":
            found.byteswap()
        return found.tobytes()


@cache
def encoder(ranks_path: str, pattern: str) -> Encoder:
    """One encoder for a worker, which its tasks share."""
    return Encoder(ranks_path, pattern)


def encode_documents(docs: DataFrame, vocabulary: str | None = None, end: int = END, window: int = WINDOW) -> DataFrame:
    """Every row's ids with the end id, its remainder (ids beyond whole windows) and its rank among equal remainders.

    The ranks and the running count of whole windows are counted within the partition as rows are written; the table of
    counts by partition turns them into global ranks later, so that no row has to be sorted or moved.
    """
    path, pattern = vocabulary or default_vocabulary(), public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part = encoder(path, pattern).ids, TaskContext.get().partitionId()
        seen, windows, tail = np.zeros(window, np.int64), 0, np.array([end], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                cut = batch.slice(at, 64)
                ids, rest, rank, whole = [], [], [], []
                for text in cut.column(1):
                    own = ids_of(text.as_py() or "") + tail
                    k, r = divmod(len(own) // 4, window)
                    ids.append(own), rest.append(r), rank.append(int(seen[r])), whole.append(windows)
                    seen[r] += 1
                    windows += k
                columns = [cut.column(0), pa.array(ids, pa.binary()), pa.array(rest, pa.int32()), pa.array(rank, pa.int64())]
                columns += [pa.array(whole, pa.int64()), pa.array([part] * len(ids), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "rest", "rank", "windows", "part"])

    schema = "doc_id long, ids binary, rest int, rank long, windows long, part int"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def combinations(window: int, used: np.ndarray) -> np.ndarray:
    """All one-, two- and three-piece combinations of the lengths in use that fill a window exactly; -1: no piece."""
    have = np.zeros(window + 1, bool)
    have[used] = True
    out = [(a, window - a, -1) for a in used if a <= window - a and have[window - a]]
    for a in used[used <= window // 3]:
        b = used[(used >= a) & (used <= (window - a) // 2)]
        c = window - a - b
        out += [(a, y, z) for y, z in zip(b[have[c]], c[have[c]], strict=True)]
    return np.array(out, np.int64).reshape(-1, 3)


def solve_counts(combos: np.ndarray, histogram: np.ndarray, rounds: int = 60, step: int = 48) -> np.ndarray:
    """Repeat counts x >= 0 of the combinations that minimise |A x - histogram|: active sets, several columns a round.

    A round takes in the combinations with the steepest gradient whose lengths do not meet, solves the small normal
    equations of the active set and drops what came out negative. The active set stays below the number of lengths.
    """
    n, size = len(combos), len(histogram)
    x, h = np.zeros(n), histogram.astype(float)
    if not n:
        return x
    valid, at = combos >= 0, np.where(combos >= 0, combos, 0)
    weight = h.sum() or 1.0

    def column(k: int) -> np.ndarray:
        return np.bincount(combos[k][combos[k] >= 0], minlength=size).astype(float)

    active: list[int] = []
    columns: dict[int, np.ndarray] = {}
    for _ in range(rounds):
        residual = h - sum((x[k] * columns[k] for k in active), np.zeros(size))
        gradient = (residual[at] * valid).sum(axis=1)
        gradient[active] = -np.inf
        taken, new = np.zeros(size, bool), []
        best = np.argpartition(-gradient, min(n - 1, 40 * step))[: 40 * step + 1]
        for k in best[np.argsort(-gradient[best], kind="stable")]:
            if gradient[k] <= 1e-9 * weight or len(new) == step or len(active) + len(new) >= size - 1:
                break
            if not taken[combos[k][valid[k]]].any():
                taken[combos[k][valid[k]]] = True
                new.append(int(k))
        if not new:
            break
        for k in new:
            columns[k] = column(k)
        active += new
        while active:
            a = np.stack([columns[k] for k in active], axis=1)
            z = np.linalg.solve(a.T @ a + 1e-9 * np.eye(len(active)), a.T @ h)
            if (z > 1e-12).all():
                break
            active = [k for k, value in zip(active, z, strict=True) if value > 1e-12]
        x[:] = 0
        if active:
            x[active] = z
    return x


@dataclass
class Plan:
    """Where the pieces of each length go: by length, ascending ranks, the first sequence and the offset from there on.

    A slot covers the ranks from its `start` on: rank start + i goes to sequence + i (times 1), at `offset`. Ranks from
    `stream[length]` on go one behind the other into a stream that is cut at every window.
    """

    start: list[np.ndarray]
    sequence: list[np.ndarray]
    offset: list[np.ndarray]
    stream: np.ndarray
    stream_base: np.ndarray
    sequences: int
    streamed: int


def plan(histogram: np.ndarray, window: int = WINDOW, slack: int = 16) -> Plan:
    """Turn the histogram of remainders into slots: least squares, rounding, greedy best fit, then the stream."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    slots: list[list[tuple[int, int, int]]] = [[] for _ in range(window)]
    used_so_far, sequence = np.zeros(window, np.int64), 0

    def place(lengths: list[int], times: int) -> None:
        nonlocal sequence
        offset = 0
        for length in lengths:
            slots[length].append((int(used_so_far[length]), sequence, offset))
            used_so_far[length] += times
            left[length] -= times
            offset += length
        sequence += times

    def room(lengths: list[int]) -> int:
        return min(int(left[v]) // lengths.count(v) for v in set(lengths))

    combos = combinations(window, np.nonzero(left)[0])
    x = solve_counts(combos, left)
    order = np.argsort(-(x - np.floor(x)), kind="stable")
    for rounding in (np.floor, lambda v: np.minimum(1.0, np.ceil(v - np.floor(v)))):
        for k in order[x[order] > 1e-9]:
            lengths = [int(v) for v in combos[k] if v >= 0]
            if times := min(int(rounding(x[k])), room(lengths)):
                place(lengths, times)
    skipped = np.zeros(window, bool)
    while len(todo := np.nonzero((left > 0) & ~skipped)[0]):  # best fit, whole classes of lengths at a time
        lengths, gap = [int(todo[-1])], window - int(todo[-1])
        while gap > 0:
            free = left[1 : gap + 1].copy()
            for v in lengths:
                if v <= gap:
                    free[v - 1] -= 1
            fits = np.nonzero(free > 0)[0]
            if not len(fits):
                break
            lengths.append(int(fits[-1]) + 1)
            gap -= lengths[-1]
        if gap <= slack:
            place(lengths, room(lengths))
        else:
            skipped[lengths[0]] = True
    base = np.concatenate([[0], np.cumsum(left[1:] * np.arange(1, window))])
    column = lambda j: [np.array([s[j] for s in slots[v]], np.int64) for v in range(window)]
    return Plan(column(0), column(1), column(2), used_so_far, base, sequence, int(base[-1]))


def pieces_of(n: int, rest: int, rank: int, first_window: int, p: Plan, whole_base: int, window: int) -> list[tuple[int, int, int, int]]:
    """(start, length, sequence, offset) of the pieces of one document."""
    out = [(k * window, window, whole_base + first_window + k, 0) for k in range(n // window)]
    if not rest:
        return out
    start = n - rest
    if rank < p.stream[rest]:
        i = int(np.searchsorted(p.start[rest], rank, "right")) - 1
        return [*out, (start, rest, int(p.sequence[rest][i]) + rank - int(p.start[rest][i]), int(p.offset[rest][i]))]
    at = int(p.stream_base[rest - 1]) + (rank - int(p.stream[rest])) * rest
    while rest:
        length = min(rest, window - at % window)
        out.append((start, length, p.sequences + at // window, at % window))
        start, at, rest = start + length, at + length, rest - length
    return out


def spans(offsets: DataFrame, limit: int) -> list[tuple[int, int]]:
    """First and last numbers of runs of partitions whose offsets take `limit` bytes at most, or one partition each."""
    out, size = [], 0
    for r in offsets.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").toLocalIterator():  # a row for each partition
        size += 32 * r["n"]
        if not out or size > limit:
            out.append((r["part"], r["part"]))
            size = 32 * r["n"]
        out[-1] = (out[-1][0], r["part"])
    return out


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, end: int = END, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Pack documents into sequences of at most `window` ids. One row per piece, with its ids.

    Documents are encoded once, with the id `end` behind them, and cut into whole windows and a remainder below one
    window. The histogram of the remainders (fewer than `window` numbers, whatever the input) goes to the driver: all
    combinations of two or three lengths that fill a window are fitted to it by non-negative least squares, the repeat
    counts are rounded, and what is left is packed by best fit with at most 16 ids of padding. Remainders that fit
    nowhere follow one another in a stream that is cut at each window, so that only the last sequence is short.

    The ids themselves are never shuffled. What the partitions before each one hold is broadcast; where that takes more
    than `broadcast_bytes`, runs of partitions are placed one after the other, each with its own part of it, and written.

    A null text counts as empty: it has the end id only. Repeated rows are packed one by one; a null id is kept. An empty
    table gives no pieces. Only doc_id and text are read. Returns doc_id, start, length, ids (binary, unsigned
    little-endian 32-bit), doc_tokens, sequence_id, offset.
    """
    spark = docs.sparkSession
    rows = materialize(encode_documents(docs, vocabulary, end, window), "pack-ids")
    counts = rows.groupBy("part", "rest").agg(F.count("*").alias("n"), F.sum(F.expr(f"octet_length(ids) div {4 * window}")).alias("w"))
    counts = materialize(counts, "pack-counts")
    histogram = np.zeros(window, np.int64)
    for r in counts.groupBy("rest").agg(F.sum("n").alias("n")).collect():  # at most `window` rows
        histogram[r["rest"]] = r["n"]
    fitted = plan(histogram, window)
    shape = spark.sparkContext.broadcast(fitted)
    # What the partitions before each one hold: remainders of every length, and whole windows.
    before = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select("part", "rest", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ranks_before"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    whole = counts.groupBy("part").agg(F.sum("w").alias("w"))
    whole = whole.select("part", F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("windows_before"))
    offsets = materialize(ranks.join(whole, "part"), "pack-offsets")
    whole_base = fitted.sequences + -(-fitted.streamed // window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shape.value
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                cols = {k: [] for k in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")}
                for r in batch.slice(at, 64).to_pylist():
                    n = len(r["ids"]) // 4
                    for start, length, seq, offset in pieces_of(n, r["rest"], r["rank"], r["windows"], p, whole_base, window):
                        values = (r["doc_id"], start, length, r["ids"][4 * start : 4 * (start + length)], n, seq, offset)
                        for k, v in zip(cols, values, strict=True):
                            cols[k].append(v)
                types = {"ids": pa.binary()}
                yield pa.RecordBatch.from_arrays([pa.array(v, types.get(k, pa.int64())) for k, v in cols.items()], list(cols))

    def placed(first: int, last: int) -> DataFrame:
        near = F.col("part").between(first, last)  # a file holds one partition, so others are skipped by their statistics
        joined = rows.filter(near).join(F.broadcast(offsets.filter(near)), ["part", "rest"])
        shifted = joined.select(
            "doc_id", "ids", "rest", (F.col("rank") + F.col("ranks_before")).alias("rank"), (F.col("windows") + F.col("windows_before")).alias("windows")
        )
        return shifted.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")

    runs = spans(offsets, broadcast_bytes) or [(0, 0)]
    if len(runs) == 1:
        return placed(*runs[0])
    return reduce(DataFrame.unionByName, [materialize(placed(*r), "pack-pieces") for r in runs])


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all documents in sequences of at most 1024 ids."""
    out = pack(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
