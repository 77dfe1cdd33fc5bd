"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Every row has a number from 0 to n - 1: rows are in the order of (bucket, doc_id, size, checksum), where a bucket is a
hash of the doc_id (of size and checksum where it is null), so numbering needs one narrow shuffle and a table of bucket counts of fixed length, and no row
passes through a single task. A keyed Feistel network over the rectangle a x b >= n permutes the numbers; results
outside [0, n) are permuted again (cycle walking). From the permuted number p both the shard (p mod k) and the slot
(p div k) can be computed, so counts differ by one at most, slots have no gap, and the shuffle can be reproduced.
DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import table

SEED = "feistel-1"
ROUNDS = 4
BUCKET_DIGITS = 3  # hex digits: 4096 buckets
SHORT_WALK = 64


def _bucket(doc_id: Column, *more: Column) -> Column:
    """Rows with an id by the id alone; those without one by what else orders them, so that they aren't one bucket."""
    rest = F.concat_ws(":", F.lit("null"), *[m.cast("string") for m in more])
    return F.substring(F.md5(F.coalesce(doc_id.cast("string"), rest).cast("binary")), 1, BUCKET_DIGITS)


def _round(value: Column, r: int, seed: str) -> Column:
    """60 bits that depend on the round and one half."""
    text = F.concat(F.lit(f"{seed}:{r}:"), value.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def permuted(x: Column, a: int, b: int, seed: str = SEED, rounds: int = ROUNDS) -> Column:
    """One pass of the network over [0, a*b)."""
    left, right = F.floor(x / F.lit(b)).cast("long") if a * b < 1 << 50 else F.expr("0L"), F.pmod(x, F.lit(b))
    if a * b >= 1 << 50:
        left = F.call_function("div", x, F.lit(b))
    for r in range(rounds):
        if r % 2 == 0:
            left = F.pmod(left + _round(right, r, seed) % F.lit(a), F.lit(a))
        else:
            right = F.pmod(right + _round(left, r, seed) % F.lit(b), F.lit(b))
    return left * F.lit(b) + right


def sides(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, -(-max(n, 1) // a)


def walked(x: Column, n: int, seed: str = SEED) -> Column:
    """The permutation of [0, n): passes until the value is inside. As a*b - n < a, few values need a second pass; a
    walk visits each outside value once at most, which bounds the long walk."""
    a, b = sides(n)
    outside = a * b - n

    def walk(start: Column, steps: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda v, _: F.when(v >= F.lit(n), permuted(v, a, b, seed)).otherwise(v))

    once = permuted(x, a, b, seed)
    if not outside:
        return once

    def finished(v: Column) -> Column:
        short = F.when(v >= F.lit(n), walk(v, min(outside, SHORT_WALK))).otherwise(v)
        if outside <= SHORT_WALK:
            return short
        return F.transform(F.array(short), lambda w: F.when(w >= F.lit(n), walk(w, outside)).otherwise(w))[0]

    return F.transform(F.array(once), finished)[0]


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """rows (doc_id, row, the columns of `order`) with `number`, a dense global row number from 0, and their count.
    `order` breaks ties of the id."""
    spark = rows.sparkSession
    bucketed = rows.withColumn("bucket", _bucket(F.col("doc_id"), *map(F.col, order)))
    counts = {r["bucket"]: r["n"] for r in bucketed.groupBy("bucket").agg(F.count("*").alias("n")).collect()}  # 4096 rows at most
    offsets, total = [], 0
    for b in sorted(counts):
        offsets.append((b, total))
        total += counts[b]
    schema = T.StructType([T.StructField("bucket", T.StringType()), T.StructField("offset", T.LongType())])
    by = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), *order)
    out = bucketed.withColumn("rank", F.row_number().over(by).cast("long")).join(F.broadcast(spark.createDataFrame(offsets, schema)), "bucket")
    return out.withColumn("number", F.col("offset") + F.col("rank") - F.lit(1).cast("long")).drop("bucket", "offset", "rank"), total


def placed(rows: DataFrame, order: list[str], shards: int = 40, seed: str = SEED) -> DataFrame:
    """rows (doc_id, row, the columns of `order`) with `shard` and `slot`."""
    out, n = numbered(rows, order)
    out = out.withColumn("place", walked(F.col("number"), n, seed))
    k = F.lit(shards).cast("long")
    return out.withColumn("shard", F.pmod("place", k).cast("int")).withColumn("slot", F.floor(F.col("place") / k).cast("long")).drop("place", "number")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """(doc_id, size, text_crc32), with `row`, a struct of all columns, if whole."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole else []
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + F.lit(16).cast("long")).alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        *row,
    )


def shard_table(docs: DataFrame, shards: int = 40, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row, by the law `rows`.

    A null text has no bytes (size 16, checksum 0). Repeated rows are rows like others, each with a place of its own;
    rows equal in id, size and checksum may swap places. Rows without an id are bucketed by size and checksum. The text doesn't decide
    the place, so groups of equal texts spread evenly. No rows give no rows."""
    out = placed(sized(docs, id_col, text_col), ["size", "text_crc32"], shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def sharded(docs: DataFrame, shards: int = 40, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs with shard and slot; columns of docs with these two names are replaced, all others stay,
    whatever their names. Null texts have no bytes, rows without an id are spread by size and checksum, repeated rows
    each get a place of their own, and no rows give no rows."""
    out = placed(sized(docs.drop("shard", "slot"), id_col, text_col, whole=True), ["size", "text_crc32"], shards, seed)
    return out.select("row.*", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 40, chunk_rows: int = 500_000, **kwargs: str) -> None:
    """Shard folders of Parquet files under path, each file in slot order, with chunk_rows rows at most."""
    out, chunk = sharded(docs, shards, **kwargs), F.floor(F.col("slot") / F.lit(chunk_rows))
    out.repartition("shard", chunk).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_table(table(spark, sf_dir, "documents"))


def _sql_pass(x: str, rounds: int = ROUNDS) -> str:
    """One pass over the row's x with a and b as columns."""
    left, right = f"({x} // b)", f"({x} % b)"
    for r in range(rounds):
        half = right if r % 2 == 0 else left
        bits = f"(('0x' || substr(md5('{SEED}:{r}:' || cast({half} AS VARCHAR)), 1, 15))::BIGINT)"
        if r % 2 == 0:
            left = f"(({left} + {bits} % a) % a)"
        else:
            right = f"(({right} + {bits} % b) % b)"
    return f"({left} * b + {right})"


_CRC_STEP = "xor(acc >> 1, (acc & 1) * 3988292384)"

SQL = f"""
WITH RECURSIVE poly AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda acc, z: {_CRC_STEP}) AS v FROM range(256) r(i))),
d AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(coalesce(text, ''))),
             lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda acc, z: xor(acc >> 8, t[xor(acc & 255, z) + 1])), 4294967295) AS text_crc32
  FROM (SELECT doc_id, text, hex(encode(coalesce(text, ''))) AS h FROM documents) CROSS JOIN poly),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY substr(md5(coalesce(cast(doc_id AS VARCHAR), 'null:' || size || ':' || text_crc32)), 1, {BUCKET_DIGITS}), doc_id NULLS FIRST, size, text_crc32) - 1 AS x,
         count(*) OVER () AS n FROM d),
sided AS (SELECT *, (n + a - 1) // a AS b FROM (SELECT *, cast(ceil(sqrt(n)) AS BIGINT) AS a FROM numbered)),
walk AS (
  SELECT x AS x0, n, a, b, {_sql_pass("x")} AS v FROM sided
  UNION ALL
  SELECT x0, n, a, b, {_sql_pass("v")} FROM walk WHERE v >= n)
SELECT doc_id, cast(size AS BIGINT) AS size, cast(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, cast(v % 40 AS INTEGER) AS shard,
       cast(v // 40 AS BIGINT) AS slot, cast(NULL AS INTEGER) AS grown_shard
FROM sided JOIN walk ON x = x0 WHERE v < walk.n
"""
