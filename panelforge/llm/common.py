"""What the corpus operators share: reading tables, cutting lineage, splitting words, hashing shingles."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_ROWS = 2048


def modest_batches(spark: SparkSession) -> None:
    """Texts are long, so fewer of them go to a Python worker at once than by default; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster names a shared folder in spark.checkpoint.dir. Only in local mode, where one machine holds all, a
    folder is made if none is named; elsewhere that is an error, as other machines couldn't read it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="panelforge-"))


def cut(df: DataFrame) -> DataFrame:
    """The rows of df from replicated storage: lineage ends here and survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def renamed_apart(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Only the named columns, so that extra columns with clashing names can't interfere."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


_MASK = (1 << 64) - 1


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that order by value is unrelated to the words."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_SPACES = b" \t\n\x0b\x0c\r"
_IN_WORD = np.ones(256, bool)
_IN_WORD[list(_SPACES)] = False
PIECE = 1 << 17  # bytes hashed at once
_BASE = 0x9E3779B97F4A7C15 & ~7 | 5  # odd and 5 modulo 8, so that its powers repeat as late as can be


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, PIECE), _powers(pow(_BASE, -1, 1 << 64), PIECE)
# a 64-bit value for each byte, the same for A-Z and a-z
_VALUES = np.array([xxhash.xxh3_64_intdigest(bytes([b]).lower()) | 1 for b in range(256)], np.uint64)
_PLACES = np.array([xxhash.xxh3_64_intdigest(b"place%d" % k) | 1 for k in range(64)], np.uint64)


def _hashed(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words raw[start:end]: a polynomial in each word's bytes, from one running sum."""
    out, a, n = np.empty(len(starts), np.uint64), 0, len(starts)
    while a < n:
        first = int(starts[a])
        b = int(np.searchsorted(ends, first + PIECE, "right"))
        if b == a:  # one word that is longer than a piece
            total = 0
            for at in range(first, int(ends[a]), PIECE):
                part = _VALUES[raw[at : min(at + PIECE, int(ends[a]))]]
                total += int((part * _UP[: len(part)]).sum(dtype=np.uint64)) * pow(_BASE, at - first, 1 << 64)
            out[a] = total & _MASK
            a += 1
            continue
        values = _VALUES[raw[first : int(ends[b - 1])]]
        sums = np.empty(len(values) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(values * _UP[: len(values)], out=sums[1:])
        s, e = starts[a:b] - first, ends[a:b] - first
        out[a:b] = (sums[e] - sums[s]) * _DOWN[s]
        a = b
    return mixed(out)


def shingle_sets(texts: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct 64-bit hashes of all runs of `width` words (of the whole sequence, if it is
    shorter; none without words). Words are what stands between ASCII white space after A-Z are lower-cased. Texts are
    taken from the column's bytes, many at a time, without an object for each word."""
    texts = texts.cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    k, n = 0, len(texts)
    while k < n:
        last = max(k + 1, int(np.searchsorted(bounds, bounds[k] + PIECE, "right")) - 1)
        raw, cuts = data[bounds[k] : bounds[last]], bounds[k : last + 1] - bounds[k]
        word = _IN_WORD[raw]
        begins, stops = word.copy(), word.copy()
        begins[1:] &= ~word[:-1]
        stops[:-1] &= ~word[1:]
        inner = cuts[(cuts > 0) & (cuts < len(raw))]
        begins[inner], stops[inner - 1] = word[inner], word[inner - 1]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        h = _hashed(raw, starts, ends)
        runs = None
        if len(h) >= width:
            runs = np.full(len(h) - width + 1, width, np.uint64)
            for i in range(width):
                runs += h[i : len(h) - width + 1 + i] * _PLACES[i]
            runs = mixed(runs)
        at = np.searchsorted(starts, cuts)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= width:
                s = np.sort(runs[a : b - width + 1])
                new = np.empty(len(s), bool)
                new[0] = True
                np.not_equal(s[1:], s[:-1], out=new[1:])
                yield s[new]
            elif b > a:
                yield mixed(((h[a:b] * _PLACES[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)).reshape(1))
            else:
                yield np.empty(0, np.uint64)
        k = last


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, rows: int, keep: Column | None = None) -> DataFrame:
    """(doc_id, text, target) of about `rows` labelled documents at most, chosen by a hash of the doc_id.

    Only ids of the sample are broadcast: their number is bounded by `rows` (plus chance), whatever the tables hold.
    Documents repeated with their id come once; labels that contradict each other give the larger one."""
    one = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col(target).cast("int").alias("__y")).where("__id IS NOT NULL AND __y IS NOT NULL")
    one = one.groupBy("__id").agg(F.max("__y").alias("__y"))
    if keep is not None:
        one = one.where(keep)
    total = one.count()
    share = F.pmod(F.xxhash64("__id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, rows / max(total, 1)))
    picked = one.where(share) if total > rows else one
    texts = docs.select(F.col("doc_id").cast("long").alias("__doc"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    out = texts.join(F.broadcast(picked), F.col("__doc") == F.col("__id"))
    # of rows that share an id, the first text in order; the sample is bounded, so this is a small shuffle
    out = out.groupBy("__id").agg(F.min("text").alias("text"), F.first("__y").alias("__y"))
    return out.select(F.col("__id").alias("doc_id"), "text", F.col("__y").alias(target))


def in_fold(id_col: str = "doc_id") -> Column:
    """The held-out quarter of the documents."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2


BROADCAST_IDS = 1_000_000


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose id isn't in the one column of ids, with all their columns. Null ids match null ids.

    The ids are broadcast where they are few; else docs are shuffled by id."""
    ids = cut(ids.toDF("gone").distinct())
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, docs[f"`{id_col}`"].cast("long").eqNullSafe(ids["gone"]), "left_anti")
