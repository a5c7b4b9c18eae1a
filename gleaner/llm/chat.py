r"""Operator 8: chat formatting by columnar byte assembly.

Template of a turn: ``<|turn:ROLE|>\n``, the text, ``<|end|>\n``. Control strings begin with ``<|``; inside a text, any
number of backslashes between ``<`` and ``|`` gets one more, so no text holds a control string and reading back is exact.
Characters of a role other than letters, digits, ``_``, ``.``, ``~`` and ``-`` are percent-encoded.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

OPEN, CLOSE, TAIL = "<|turn:", "|>\n", b"<|end|>\n"
#: Bytes of text that are assembled at a time.
PIECE_BYTES = 4 << 20
#: Segments from this length on are copied without indices.
LONG = 1 << 16
LOSS_ROLES = ("assistant",)


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, pattern=r"<(\\*)\|", replacement=r"<\\\1|")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def header(role: str | None) -> bytes:
    return f"{OPEN}{quote(role or '', safe='')}{CLOSE}".encode()


def scatter(out: np.ndarray, to: np.ndarray, source: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
    """Copy the segments source[start : start + length] to out[to : to + length]: long ones as slices, all others at once,
    so that the indices take a few times PIECE_BYTES, however long a segment is."""
    long = length >= LONG
    for t, s, n in zip(to[long].tolist(), start[long].tolist(), length[long].tolist(), strict=True):
        out[t : t + n] = source[s : s + n]
    to, start, length = to[~long], start[~long], length[~long]
    within = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(to, length) + within] = source[np.repeat(start, length) + within]


def assemble(roles: pa.Array, texts: pa.Array, first: np.ndarray, loss_roles: tuple[str, ...] = LOSS_ROLES) -> tuple[pa.Array, pa.Array]:
    """One formatted string per conversation piece, and its loss spans (code points) as a list of starts and ends.

    `first` marks the turns that begin a piece. Lengths of headers, texts and tails give the places of all segments by
    one running sum; they are scattered into one buffer, which becomes the data of an Arrow string array as it is.
    """
    texts = escape(pc.fill_null(texts.cast(pa.large_string()), ""))
    names, which = np.unique(np.array([r or "" for r in roles.to_pylist()], dtype=object).astype(str), return_inverse=True)
    heads = [header(str(r)) for r in names]
    head_length = np.array([len(h) for h in heads], np.int64)
    pool = np.frombuffer(b"".join([*heads, TAIL]), np.uint8)
    head_start = np.cumsum(head_length) - head_length

    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lengths = np.stack([head_length[which], np.diff(offsets), np.full(len(texts), len(TAIL), np.int64)], axis=1)
    ends = np.cumsum(lengths.reshape(-1)).reshape(-1, 3)
    to = ends - lengths
    out = np.empty(int(ends[-1, 2]), np.uint8)
    scatter(out, to[:, 0], pool, head_start[which], lengths[:, 0])
    scatter(out, to[:, 1], data, offsets[:-1], lengths[:, 1])
    scatter(out, to[:, 2], pool, np.full(len(texts), len(pool) - len(TAIL), np.int64), lengths[:, 2])

    begins = np.nonzero(first)[0]
    bounds = np.append(to[begins, 0], len(out)).astype(np.int64)
    formatted = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(bounds), pa.py_buffer(out))

    chars = np.stack([lengths[:, 0], pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64), lengths[:, 2]], axis=1)
    char_ends = np.cumsum(chars.reshape(-1)).reshape(-1, 3)
    piece = np.cumsum(first) - 1
    char_base = (char_ends - chars)[begins, 0][piece]
    loss = np.isin(names, loss_roles)[which]
    spans = np.stack([(char_ends - chars)[:, 1] - char_base, char_ends[:, 1] - char_base], axis=1)[loss].reshape(-1)
    counts = np.bincount(piece[loss], minlength=len(begins)) * 2
    list_offsets = np.append(0, np.cumsum(counts)).astype(np.int32)
    return formatted, pa.ListArray.from_arrays(pa.array(list_offsets), pa.array(spans, pa.int64()))


def format_chats(conversations: DataFrame, loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """conv_id, piece, n_turns, formatted, loss_spans: the conversations as text with the spans a loss is taken on.

    Turns are sorted by (turn, role, text) with nulls first; a null role or text counts as empty, rows of a null conv_id
    are one conversation, and repeated rows stay. A conversation is one piece unless it meets the border of a batch: a
    long one comes as pieces 0, 1, ... of whole turns, so memory stays bounded however long it is. loss_spans holds start
    and end of each span in turn, in code points of `formatted`. Further columns are not read; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, piece = object(), 0
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            group = (np.cumsum(sizes) - sizes) // PIECE_BYTES
            edges = [0, *(np.nonzero(np.diff(group))[0] + 1), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                cut = batch.slice(a, b - a)
                ids = cut.column(0).to_pylist()
                first = np.array([True, *(x != y for x, y in zip(ids, ids[1:], strict=False))])
                formatted, spans = assemble(cut.column(1), cut.column(2), first, loss_roles)
                begins = np.nonzero(first)[0]
                numbers = []
                for k in begins:
                    piece = piece + 1 if ids[k] == last else 0
                    last = ids[k]
                    numbers.append(piece)
                turns = np.diff(np.append(begins, len(ids)))
                columns = [pa.array([ids[k] for k in begins], pa.int64()), pa.array(numbers, pa.int32()), pa.array(turns, pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, formatted.cast(pa.string()), spans], ["conv_id", "piece", "n_turns", "formatted", "loss_spans"])

    text = F.col("text").cast("string")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("role").cast("string"), text.alias("text"), "turn")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")
    return rows.mapInArrow(run, "conv_id long, piece int, n_turns long, formatted string, loss_spans array<long>")


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn of a formatted string; a malformed string is an error."""
    marks = formatted.split("<|")
    if marks[0] or len(marks) % 2 == 0:
        raise ValueError("not a formatted conversation")
    for opened, closed in zip(marks[1::2], marks[2::2], strict=True):
        role, bar, text = opened.partition(CLOSE)
        if not role.startswith("turn:") or not bar or closed != "end|>\n":
            raise ValueError("not a formatted conversation")
        yield unquote(role[5:]), unescape(text)


def digests(chats: DataFrame) -> DataFrame:
    """Read formatted pieces back, in the order of `format_chats`: counts and digests of each conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        now = None

        def row() -> tuple:
            return (now["id"], now["turns"], now["all"].hexdigest(), now["loss"], now["hash"].hexdigest(), now["chars"])

        for batch in batches:
            done = []
            for conv, piece, formatted, spans in zip(*[batch.column(k).to_pylist() for k in (0, 1, 3, 4)], strict=True):
                if piece == 0:
                    if now:
                        done.append(row())
                    now = {"id": conv, "turns": 0, "all": hashlib.sha256(), "loss": 0, "hash": hashlib.sha256(), "chars": 0}
                for role, text in read_turns(formatted):
                    now["all"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    now["turns"] += 1
                for start, end in zip(spans[::2], spans[1::2], strict=True):
                    text = unescape(formatted[start:end])
                    now["hash"].update(text.encode("utf-8", "surrogatepass"))
                    now["loss"] += len(text)
                now["chars"] += len(formatted)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*done, strict=True) if done else [[]] * 6, types, strict=True)], names)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row(), types, strict=True)], names)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return chats.mapInArrow(run, schema)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return digests(format_chats(rows.unionByName(more)))
