"""Stage tables with manifests: what they were made from, checked before they are used again."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def row_digest(*columns: str) -> Column:
    """SHA-256 of the columns' texts; what is null is left out."""
    return F.sha2(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in columns]), 256)


def code_hash() -> str:
    """Of the package's source files, in the order of their names: a part of a stage's identity."""
    root, out = Path(__file__).parents[1], hashlib.sha256()
    for p in sorted(root.rglob("*.py")):
        if "llm" not in p.parts:
            out.update(str(p.relative_to(root)).encode() + b"\0" + p.read_bytes())
    return out.hexdigest()


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows, counted, that only one of two tables has, with the side that has them; none if the tables are equal."""
    right = right.select(*left.columns)
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def bundled(rows: DataFrame, columns: list[str], key: str = "eom") -> DataFrame:
    """A row for each key with its rows' columns as arrays, in the order of the first of them."""
    one = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("x"))
    return one.select(key, *[F.col("x").getField(c).alias(c) for c in columns])


def unbundled(bundle: DataFrame, columns: list[str], key: str = "eom") -> DataFrame:
    return bundle.select(key, F.inline(F.arrays_zip(*columns))).toDF(key, *columns)


def write_models(models: DataFrame, path: str) -> None:
    """Fits (year, penalty, beta), a row a year, sorted, with a digest of each to tell a damaged one by."""
    models.withColumn("digest", row_digest("year", "penalty", "beta")).coalesce(1).sortWithinPartitions("year").write.mode("overwrite").parquet(path)


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """The fits; reading a row whose digest differs raises."""
    rows = spark.read.parquet(path)
    fine = row_digest("year", "penalty", "beta") == F.col("digest")
    return rows.withColumn("beta", F.when(fine, F.col("beta")).otherwise(F.raise_error(F.lit("a stored fit has changed")))).drop("digest")


def receipts(rows: DataFrame, cutoffs: list[str], column: str = "eom") -> DataFrame:
    """(cutoff, rows, fingerprint): what was known by each cutoff, never hashing anything later."""
    out = []
    for c in cutoffs:
        known = known_by(rows, c, column)
        out.append((c, known.count(), fingerprint(known)))
    return rows.sparkSession.createDataFrame(out, "cutoff string, rows long, fingerprint string")


def certified(scores: DataFrame, chosen: DataFrame, keys: list[str], candidate: str, score: str) -> DataFrame:
    """(keys, candidate, regret): how much worse each choice is than the best candidate; 0 where it is an argmin."""
    best = scores.groupBy(*keys).agg(F.min(score).alias("__best"))
    return chosen.join(scores, [*keys, candidate]).join(best, keys).select(*keys, candidate, (F.col(score) - F.col("__best")).alias("regret"))


def fingerprint(df: DataFrame) -> str:
    """Of the rows in any order: null is not NaN, NaN is NaN, -0 is 0. Row hashes are added up, so nothing is sorted."""
    columns = []
    for c, kind in sorted(df.dtypes):
        x = F.col(f"`{c}`")
        if kind in ("double", "float"):
            x = F.when(x == 0, F.lit(0.0)).otherwise(x)
        columns.append(F.coalesce(x.cast("string"), F.lit("\x00null")))
    row = F.sha2(F.concat_ws("\x1f", *columns), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).alias(f"p{k}") for k in range(4)]
    one = df.agg(F.count("*").alias("n"), *parts).first()
    return hashlib.sha256(json.dumps([sorted(df.dtypes), *map(str, one)]).encode()).hexdigest()


class Store:
    """Stages under a folder: Parquet by month, and a one-row manifest table that is written last, so a stage without
    it counts as not done."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def _manifest(self, stage: str) -> dict | None:
        path = f"{self.root}/{stage}.manifest"
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs_path):
            return None
        return json.loads(self.spark.read.text(path).first()[0])

    def write(self, stage: str, df: DataFrame, identity: dict) -> DataFrame:
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy("eom") if "eom" in df.columns else writer).parquet(f"{self.root}/{stage}")
        out = self.spark.read.parquet(f"{self.root}/{stage}")
        record = {"identity": identity, "fingerprint": fingerprint(out)}
        self.spark.createDataFrame([(json.dumps(record, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/{stage}.manifest")
        return out

    def read(self, stage: str, identity: dict, verify: bool = False) -> DataFrame | None:
        """The stage if it was made from the same identity; None if it isn't there; an error if it is another's."""
        record = self._manifest(stage)
        if record is None:
            return None
        if record["identity"] != identity:
            raise ValueError(f"{stage} was made from something else")
        out = self.spark.read.parquet(f"{self.root}/{stage}")
        if verify and fingerprint(out) != record["fingerprint"]:
            raise ValueError(f"{stage} has changed")
        return out

    def get(self, stage: str, identity: dict, make: Callable[[], DataFrame]) -> DataFrame:
        done = self.read(stage, identity)
        return self.write(stage, make(), identity) if done is None else done


def known_by(df: DataFrame, cutoff: str, column: str = "eom") -> DataFrame:
    """Only what a fingerprint at the cutoff may cover: never later months."""
    return df.where(F.col(column) <= F.lit(cutoff).cast("date"))
