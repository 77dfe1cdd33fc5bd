"""Exact deduplication by a content sort.

Sampled splitters range-partition the rows by normalised text, an external sort puts equal texts next to each other,
and each row is compared in full with its neighbour. The range key is (first characters, digest, doc_id): texts that
share a beginning, and even one text with very many copies, are dealt over as many tasks as their share of the rows
needs. A run of equal texts that touches an end of its partition may go on in the next one; those runs (two for each
partition at most, whatever the data) are joined by their digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

SPACE = r"[\x20\x09-\x0D]+"
KEY_CHARS = 32  # of the range key only; comparisons are of whole texts
_OUT = "doc_id long, text_sha256 string, run_id long, run_size long, at_end boolean, part int"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition -> the same rows with the smallest doc_id and the size of their run of equal texts."""
    part = TaskContext.get().partitionId()
    pending: list[pa.Array] = []  # doc_ids of the run that may go on in the next batch
    text, sha, first = None, None, True

    def closed(at_end: bool) -> pa.RecordBatch:
        ids = pa.concat_arrays(pending)
        n = len(ids)
        columns = [ids, pa.repeat(sha, n), pa.repeat(ids[0], n), pa.repeat(pa.scalar(n, pa.int64()), n), pa.repeat(pa.scalar(at_end), n), pa.repeat(pa.scalar(part, pa.int32()), n)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_sha256", "run_id", "run_size", "at_end", "part"])

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ids, shas, texts = batch.column(0), batch.column(1).cast(pa.string()), batch.column(2)
        starts = [0] if text is None or texts[0] != text else []
        if n > 1:
            change = pc.invert(pc.equal(texts.slice(1), texts.slice(0, n - 1)))
            starts += [i + 1 for i in pc.indices_nonzero(change).to_pylist()]
        if not starts:
            pending.append(ids)
            continue
        if starts[0] > 0:
            pending.append(ids.slice(0, starts[0]))
        if pending:
            yield closed(first)
            first = False
        whole = len(starts) - 1  # runs that begin and end in this batch
        if whole and first:  # the partition's first run
            pending, sha = [ids.slice(starts[0], starts[1] - starts[0])], shas[starts[0]]
            yield closed(True)
            first, starts, whole = False, starts[1:], whole - 1
        if whole:
            bounds = pa.array(starts, pa.int64())
            sizes = pc.subtract(bounds.slice(1), bounds.slice(0, whole))
            of = pa.array([k for k, size in enumerate(sizes.to_pylist()) for _ in range(size)], pa.int64())
            m = len(of)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(starts[0], m), shas.slice(starts[0], m), ids.take(bounds.slice(0, whole)).take(of), sizes.take(of), pa.repeat(pa.scalar(False), m), pa.repeat(pa.scalar(part, pa.int32()), m)],
                names=["doc_id", "text_sha256", "run_id", "run_size", "at_end", "part"],
            )
        pending, sha, text = [ids.slice(starts[-1])], shas[starts[-1]], texts[n - 1]
    if pending:
        yield closed(True)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    A null text counts as empty, and empty texts are equal to each other. Of equal rows the smallest id stays, null ids
    come last; of rows repeated with the same id, each gets a result row and `kept` is true for each of them (an id
    can't tell them apart). No rows give no rows. Other columns are ignored, whatever their names."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    rows = rows.select("doc_id", F.sha2("norm", 256).alias("sha"), "norm")
    key = [F.substring("norm", 1, KEY_CHARS), F.col("sha"), F.col("doc_id").asc_nulls_last()]
    order = [F.substring("norm", 1, KEY_CHARS), F.col("sha"), F.col("norm"), F.col("doc_id").asc_nulls_last()]
    runs = cut(rows.repartitionByRange(*key).sortWithinPartitions(*order).mapInArrow(_runs, _OUT))
    ends = runs.where("at_end").groupBy("text_sha256", "part").agg(F.min("run_id").alias("run_id"), F.first("run_size").alias("run_size"))
    # two rows for each partition at most, so the broadcast doesn't grow with the rows
    ends = ends.groupBy("text_sha256").agg(F.min("run_id").alias("all_id"), F.sum("run_size").alias("all_size"))
    out = runs.join(F.broadcast(ends), "text_sha256", "left")
    keep = F.coalesce("all_id", "run_id")
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("all_size", "run_size").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    kept = exact_duplicates(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("__kept_id"), F.col("text_sha256").alias("__kept_sha"))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__kept_id")) & (F.sha2(normalised(F.col(text_col)), 256) == F.col("__kept_sha"))
    return docs.join(kept, same, "left_semi")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM d
"""
