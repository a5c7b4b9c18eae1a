"""Operator 11: how far the sources of a language diverge, by a sort of (lang, term, source, document) and a scan of its runs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Terms are runs of ASCII letters and of all other characters beyond ASCII; only A-Z change their case.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
MIN_DOCUMENTS = 30
SMOOTHING = 5
UNIT = 1_000_000_000
TOP_TERMS = 50
#: Counters that a task holds before it hands its counts on (about 300 bytes each).
ENTRIES = 200_000
#: Bytes of a text that are cut into terms at a time.
CHUNK = 1 << 20
#: Numbers of a dense block of terms by sources, or of sources by sources, that a task holds.
DENSE = 1 << 21

RUNS = "lang string, term binary, sources array<string>, counts array<long>, documents long, edge boolean"


def chunks(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, at most about CHUNK bytes of it at a time."""
    text, at = text.translate(TERM_BYTES), 0
    while at < len(text):
        end = text.find(b" ", at + CHUNK)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def counted(docs: DataFrame, entries: int = ENTRIES) -> DataFrame:
    """Partial counts: key, source, document, documents, n; the key is the language, a zero byte and the term.

    Documents are dealt in ranges of (lang, source), a large group over many tasks, so that a task sees few groups and its
    counts by (lang, source, term) are far fewer than the terms of its documents. A document is in one task, so these are
    counts of documents too; a block is handed on whenever it holds `entries` counters, and `document` numbers its first
    document. The term '' stands for the group itself, so groups without terms are kept. No term holds a zero byte, so a key has one reading, and
    one column that differs in its first bytes sorts much faster than two.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = first = TaskContext.get().partitionId() << 33
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def block() -> Iterator[pa.RecordBatch]:
            for (lang, source), (documents, n) in groups.items():
                size, head = len(documents), lang.encode() + b"\0"
                columns = [pa.array([head + t for t in documents], pa.binary()), pa.repeat(pa.scalar(source, pa.string()), size), pa.repeat(pa.scalar(first, pa.int64()), size)]
                columns += [pa.array(list(documents.values()), pa.int64()), pa.array([n[t] for t in documents], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "source", "document", "documents", "n"])

        held = 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                documents, n = groups.setdefault((lang, source), (Counter(), Counter()))
                before, own = len(documents), set()
                documents[b""] += 1
                for terms in chunks(text.as_py()):
                    n.update(terms)
                    own.update(terms)
                documents.update(own)
                held += len(documents) - before
                at += 1
                if held >= entries:
                    yield from block()
                    groups, held, first = {}, 0, at
        yield from block()

    named = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("lang", "source", "text")]
    rows = docs.select(named[0].alias("lang"), named[1].alias("source"), named[2].cast("binary").alias("text"), F.monotonically_increasing_id().alias("at"))
    rows = rows.repartitionByRange("lang", "source", "at").drop("at")
    return rows.mapInArrow(run, "key binary, source string, document long, documents long, n long")


def _starts(*columns: pa.Array) -> np.ndarray:
    """Where a row differs from the one before it in any of the columns; the first row does."""
    size = len(columns[0])
    out = np.zeros(size, bool)
    for c in columns:
        out[1:] |= pc.not_equal(c.slice(1), c.slice(0, size - 1)).to_numpy(zero_copy_only=False)
    out[:1] = True
    return out


def scan(ordered: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """One row for each term of a language from partitions sorted by (lang, term, source, document).

    A run of equal (lang, term, source) is added up; the runs of a (lang, term) give its document frequency. The first and
    the last term of a partition may go on in the neighbours, so they are returned as they are, marked `edge`; of the others
    only those in enough documents come out. What is carried from batch to batch is one run for each source of one term.
    """
    names = ["key", "source", "documents", "n"]

    def rows(key: pa.Array, source: pa.Array, documents: np.ndarray, n: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
        begins = np.nonzero(_starts(key))[0]
        total = np.add.reduceat(documents, begins)
        edge, keys = edge[begins], key.take(pa.array(begins))
        group = pc.equal(pc.binary_slice(keys, -1), b"\0").to_numpy(zero_copy_only=False)
        keep = pa.array(edge | group | (total >= min_documents))
        offsets = pa.array(np.append(begins, len(key)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, x).filter(keep) for x in (source, pa.array(n))]
        split = [k.rpartition(b"\0") for k in keys.filter(keep).to_pylist()]
        columns = [pa.array([x[0].decode() for x in split], pa.string()), pa.array([x[2] for x in split], pa.binary()), *lists, pa.array(total).filter(keep), pa.array(edge).filter(keep)]
        return pa.RecordBatch.from_arrays(columns, ["lang", "term", "sources", "counts", "documents", "edge"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_runs, first = None, True
        for batch in batches:
            part = pa.Table.from_batches([batch]).select(names)
            part = part if open_runs is None else pa.concat_tables([open_runs, part])
            if not part.num_rows:
                continue
            key, source, documents, n = [part[c].combine_chunks() for c in names]
            begins = np.nonzero(_starts(key, source))[0]
            key, source = key.take(pa.array(begins)), source.take(pa.array(begins))
            documents, n = np.add.reduceat(documents.to_numpy(), begins), np.add.reduceat(n.to_numpy(), begins)
            terms = np.nonzero(_starts(key))[0]
            cut = int(terms[-1])  # the last term stays open
            if cut:
                edge = np.zeros(cut, bool)
                edge[: terms[1]] = first
                first = False
                yield rows(key.slice(0, cut), source.slice(0, cut), documents[:cut], n[:cut], edge)
            open_runs = pa.Table.from_arrays([key.slice(cut), source.slice(cut), pa.array(documents[cut:]), pa.array(n[cut:])], names)
        if open_runs is not None:
            key, source, documents, n = [open_runs[c].combine_chunks() for c in names]
            yield rows(key, source, documents.to_numpy(), n.to_numpy(), np.ones(len(key), bool))

    return ordered.mapInArrow(run, RUNS)


def merged(runs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """The kept terms, and the groups as the term '': rows of `scan` with those of partition borders put together."""
    edges = runs.filter("edge")
    documents = edges.groupBy("lang", "term").agg(F.sum("documents").alias("documents"))
    counts = edges.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("r")).groupBy("lang", "term", F.col("r.sources").alias("s")).agg(F.sum("r.counts").alias("c"))
    counts = counts.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("s", "c"))).alias("r"))
    put = counts.join(documents, ["lang", "term"]).filter((F.col("documents") >= min_documents) | (F.length("term") == 0))
    put = put.select("lang", "term", F.col("r.s").alias("sources"), F.col("r.c").alias("counts"))
    return runs.filter("not edge").select("lang", "term", "sources", "counts").unionByName(put)


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + SMOOTHING) / total), exactly: beyond 64 bits by Python's integers."""
    if counts.size and int(counts.max()) + SMOOTHING > (2**63 - 1) // UNIT:
        counts, total = counts.astype(object), np.asarray(total).astype(object)
    return (1 + UNIT * (counts + SMOOTHING) // total).astype(np.int64)


def partials(terms: DataFrame, top: int = TOP_TERMS, dense: int = DENSE) -> DataFrame:
    """Sums of pairs and leading terms of each task: lang, source, part, item, value.

    `terms` are rows of a term with the totals of its language (v, n_lang, names, totals). Sources where a term does not
    occur have its smoothed share too, so a block of terms is made dense.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[list[str], np.ndarray]] = {}
        best: dict[tuple[str, str], list[tuple[int, bytes]]] = {}

        def pairs(lang: str, names: list[str], first: int, found: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k, own in enumerate(found):
                a = names[first + k]
                others = [j for j in range(len(names)) if j != first + k]
                yield result(lang, a, "pair", [names[j].encode() for j in others], [int(own[j]) for j in others])

        for batch in batches:
            for lang_rows in _by_lang(batch):
                lang, v, n_lang = lang_rows.column(0)[0].as_py(), lang_rows.column(4)[0].as_py(), lang_rows.column(5)[0].as_py()
                listed = lang_rows.column(6)[0].values
                names, totals = listed.to_pylist(), np.array(lang_rows.column(7)[0].as_py(), np.int64) + SMOOTHING * v
                size, step = len(names), max(1, dense // max(1, len(names)))
                for at in range(0, lang_rows.num_rows, step):
                    cut = lang_rows.slice(at, step)
                    where = pc.index_in(cut.column(2).flatten(), value_set=listed).to_numpy()
                    row = np.repeat(np.arange(cut.num_rows), pc.list_value_length(cut.column(2)).to_numpy())
                    counts = cut.column(3).flatten().to_numpy()
                    p = np.repeat(shares(np.zeros(size, np.int64), totals)[None, :], cut.num_rows, axis=0)
                    p[row, where] = shares(counts, totals[where])
                    whole = np.add.reduceat(counts, np.append(0, np.nonzero(np.diff(row))[0] + 1))
                    q = shares(whole, np.full(len(whole), n_lang + SMOOTHING * v, np.int64))
                    ahead = np.nonzero((counts > 0) & (p[row, where] > q[row]))[0]
                    for source in np.unique(where[ahead]):
                        own = ahead[where[ahead] == source]
                        value = p[row[own], source] - q[row[own]]
                        terms_of = cut.column(1).take(pa.array(row[own])).to_pylist()
                        held = best.setdefault((lang, names[source]), [])
                        held += zip((-value).tolist(), terms_of, strict=True)
                        held.sort()
                        del held[top:]
                    width = max(1, dense // size)  # sources whose distances are held at once
                    for first in range(0, size, width):
                        found = np.stack([np.abs(p - p[:, a : a + 1]).sum(axis=0) for a in range(first, min(size, first + width))])
                        if width >= size:
                            sums.setdefault(lang, (names, np.zeros((size, size), np.int64)))[1][:] += found
                        else:
                            yield from pairs(lang, names, first, found)
        for lang, (names, found) in sums.items():
            yield from pairs(lang, names, 0, found)
        for (lang, source), held in best.items():
            yield result(lang, source, "term", [t for _, t in held], [-x for x, _ in held])

    return terms.mapInArrow(run, "lang string, source string, part string, item binary, value long")


def _by_lang(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    begins = np.nonzero(_starts(batch.column(0)))[0].tolist() if batch.num_rows else []
    for a, b in zip(begins, [*begins[1:], batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def result(lang: str, source: str, part: str, items: list[bytes], values: list[int]) -> pa.RecordBatch:
    """Rows of one group."""
    same = [pa.repeat(pa.scalar(x, pa.string()), len(items)) for x in (lang, source, part)]
    return pa.RecordBatch.from_arrays([*same, pa.array(items, pa.binary()), pa.array(values, pa.int64())], ["lang", "source", "part", "item", "value"])


def audit(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP_TERMS, entries: int = ENTRIES) -> DataFrame:
    """How far the sources of each language are apart, and which terms each of them uses more than its language does.

    Counts are added up within tasks and range-sorted by (lang, term, source, document), so a term that fills many
    partitions is split between them; a scan of the runs gives document frequencies and counts, and only the first and last
    term of a partition are put together across partitions. A second scan of the kept terms, each with the totals of its
    language, adds up the distances of sources within a task and keeps its leading terms. The result has a row for each
    ordered pair of sources of a language, which is all that grows with the square of their number.

    Every row is a document of its own, repeated rows included. A null lang, source or text counts as empty; a text without
    terms, or an empty one, still makes its group known, and a group without kept terms has the smoothed share of all of
    them. Ties go to the smaller item in UTF-8. An empty table gives no rows. Only lang, source and text are read.
    Returns lang, source, part, item, value, rank.
    """
    blocks = materialize(counted(docs, entries), "audit-counts")
    order = ["key", "source", "document"]
    ordered = blocks.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = materialize(merged(materialize(scan(ordered, min_documents), "audit-runs"), min_documents), "audit-terms")
    terms = kept.filter(F.length("term") > 0)
    groups = kept.filter(F.length("term") == 0).select("lang", F.explode("sources").alias("source"))
    # One row for each group, with its count over kept terms.
    totals = terms.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("r")).groupBy("lang", F.col("r.sources").alias("source")).agg(F.sum("r.counts").alias("n"))
    totals = groups.join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    langs = totals.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("g"), F.sum("n").alias("n_lang"))
    sizes = terms.groupBy("lang").agg(F.count("*").alias("v"))
    langs = langs.join(sizes, "lang", "left").select("lang", F.coalesce("v", F.lit(0)).alias("v"), "n_lang", F.col("g.source").alias("names"), F.col("g.n").alias("totals"))
    langs = materialize(langs, "audit-languages")
    found = partials(terms.join(langs, "lang"), top)
    named = langs.select("lang", F.explode("names").alias("source"), "names").select("lang", "source", F.explode("names").alias("item")).filter("source <> item")
    zeros = named.select("lang", "source", F.lit("pair").alias("part"), F.col("item").cast("binary").alias("item"), F.lit(0).cast("long").alias("value"))
    summed = found.unionByName(zeros).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = summed.withColumn("rank", place).filter((F.col("part") == "pair") | (F.col("rank") <= top))
    return ranked.select("lang", "source", "part", F.col("item").cast("string").alias("item"), "value", "rank")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents: terms in at least 30 documents of their language, the 50 leading terms of each group."""
    return audit(table(spark, sf_dir, "documents"))
