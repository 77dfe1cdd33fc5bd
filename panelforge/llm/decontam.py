"""Benchmark decontamination by winnowing.

Each text becomes a list of words; of the hashes of its 5-word grams the smallest in every 9 consecutive ones is kept
as a fingerprint. 9 grams of 5 words cover 13 words, so two texts that share 13 consecutive words keep the same hash at
the same place in them: no shared window can be missed. Fingerprints of documents that a benchmark item also has are
extended: every 13-word window around such a hit is compared, as words, with the windows of the items. A document's
words never leave its row; only its hits do, with the words around them. Items of fewer than 13 words are one window
each and are looked for at every position. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, without_ids

WINDOW, GRAM = 13, 5
SPAN = WINDOW - GRAM + 1
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PLACE_BITS = 28  # a row of Spark holds 2 GB, so fewer words than 2^28 that an array of strings could hold
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32_000_000


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once."""
    return F.transform(F.array(value), f)[0]


def words_of(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def fingerprints(words: Column) -> Column:
    """array<long>, distinct: 36 bits of a gram's hash, then its position; the least of every SPAN consecutive ones."""
    n = F.size(words)

    def gram(i: Column) -> Column:
        return F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.slice(words, i + 1, F.lit(GRAM))), PLACE_BITS), PLACE_BITS).bitwiseOR(i.cast("long"))

    grams = F.transform(F.sequence(F.lit(0), n - GRAM), gram)
    chosen = let(grams, lambda g: F.array_distinct(F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.array_min(F.slice(g, i + 1, F.lit(SPAN))))))
    return F.when(n >= WINDOW, chosen).otherwise(F.array().cast("array<long>"))


def hash_of(mark: Column) -> Column:
    return F.shiftrightunsigned(mark, PLACE_BITS)


def place_of(mark: Column) -> Column:
    return mark.bitwiseAND(_long((1 << PLACE_BITS) - 1)).cast("int")


def windows_of(words: Column, width: int) -> Column:
    """All runs of `width` words, joined by spaces, by start; `words` has that many at least."""
    return F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.array_join(F.slice(words, i + 1, F.lit(width)), " "))


def _small(df: DataFrame, weight: Column) -> DataFrame:
    """df to be broadcast where its rows and bytes are within bounds, else df to be shuffled."""
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(weight), _long(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row for each distinct doc_id.

    Null and empty texts have no words, hit nothing and are no windows. Rows that repeat a doc_id (null is one id)
    count as one document: the most words of them and the hits of all. Items that repeat count once by their id. Other
    columns are ignored. No documents give no rows; no items give no hits."""
    items = items.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(item_text)).alias("words")).where(F.size("words") > 0)
    items = cut(items)
    long_items, short_items = items.where(F.size("words") >= WINDOW), items.where(F.size("words") < WINDOW)
    marks = long_items.select(F.explode(fingerprints(F.col("words"))).alias("mark")).select(hash_of(F.col("mark")).alias("mark_hash")).distinct()
    windows = long_items.select("item", F.explode(F.array_distinct(windows_of(F.col("words"), WINDOW))).alias("window"))
    windows = windows.unionByName(short_items.select("item", F.array_join("words", " ").alias("window")))
    by_window = windows.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))
    by_window = cut(by_window.withColumn("set_id", F.sha2(F.to_json("items"), 256)))
    lookup = by_window.select("window", "set_id")
    lookup = _small(lookup, F.octet_length("window") + 64)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    lacks = F.xxhash64("doc_id").bitwiseOR(_long(-1 << 63))  # no fingerprint's hash is negative

    def around(mark: Column) -> Column:
        place, words = place_of(mark), F.col("words")
        start = F.greatest(place - (SPAN - 1), F.lit(0))
        return F.struct(hash_of(mark).alias("mark_hash"), start.alias("start"), F.array_join(F.slice(words, start + 1, place + WINDOW - start), " ").alias("near"), F.lit(None).cast("int").alias("n_words"))

    whole = F.struct(lacks.alias("mark_hash"), F.lit(0).alias("start"), F.lit(None).cast("string").alias("near"), F.size("words").alias("n_words"))
    marked = rows.select("doc_id", F.inline(F.concat(F.transform(fingerprints(F.col("words")), around), F.array(whole))))
    found = marked.join(_small(marks.withColumn("known", F.lit(True)), _long(8)), "mark_hash", "left").where("known OR n_words IS NOT NULL")
    near = F.split("near", " ")
    tries = F.when(
        F.col("near").isNotNull(),
        let(near, lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.struct((F.col("start") + i).alias("at"), F.array_join(F.slice(w, i + 1, F.lit(WINDOW)), " ").alias("window")))),
    ).otherwise(F.array(F.struct(F.lit(-1).alias("at"), F.concat(F.lit(" "), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("window"))))
    tried = found.select("doc_id", "n_words", F.inline(tries)).withColumn("width", F.lit(WINDOW))
    lengths = sorted(r[0] for r in short_items.select(F.size("words")).distinct().collect())  # 12 lengths at most
    for m in lengths:
        at_all = rows.where(F.size("words") >= m).select("doc_id", F.posexplode(windows_of(F.col("words"), m)).alias("at", "window"))
        tried = tried.unionByName(at_all.select("doc_id", F.lit(None).cast("int").alias("n_words"), "at", "window", F.lit(m).alias("width")))
    hits = tried.join(lookup, "window", "left").where("set_id IS NOT NULL OR n_words IS NOT NULL")
    by_doc = hits.groupBy("doc_id").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.collect_set(F.when(F.col("set_id").isNotNull(), F.struct("at", "width"))).alias("spans"),
        F.collect_set("set_id").alias("sets"),
    )
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("end"), _long(0).alias("n")),
        lambda acc, s: F.struct(F.greatest(acc["end"], s["at"] + s["width"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), s["at"] + s["width"] - F.greatest(acc["end"], s["at"]))).alias("n")),
        lambda acc: acc["n"],
    )
    by_doc = cut(by_doc.select("doc_id", "n_words", covered.alias("n_hit"), "sets"))
    listed = by_doc.where(F.size("sets") > 0).select("doc_id", F.explode("sets").alias("set_id"))
    set_items = by_window.select("set_id", "items").dropDuplicates(["set_id"])
    listed = listed.join(_small(set_items, F.octet_length(F.to_json("items")) + 64), "set_id").select("doc_id", F.explode("items").alias("item"))
    listed = listed.groupBy("doc_id").agg(F.array_sort(F.collect_set("item")).alias("items"))
    listed = listed.select(F.col("doc_id").alias("listed_id"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    out = by_doc.join(listed, F.col("doc_id").eqNullSafe(F.col("listed_id")), "left")
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.coalesce("n_items", _long(0)).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns, whatever their names.

    Rows that repeat a doc_id go or stay together, rows without an id too. Null and empty texts stay. No documents give
    no rows."""
    return without_ids(docs, contamination(docs, items, id_col, text_col).where("contaminated").select("doc_id"), id_col)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')"
SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
i AS (SELECT cast(item_id AS VARCHAR) AS item, {_SQL_WORDS} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item, len(v) AS width, array_to_string(v, ' ') AS win
  FROM (SELECT item, unnest(CASE WHEN len(w) >= {WINDOW} THEN list_transform(range(len(w) - {WINDOW} + 1), lambda k: w[k + 1 : k + {WINDOW}]) ELSE [w] END) AS v FROM i WHERE len(w) > 0)),
widths AS (SELECT DISTINCT width FROM iw),
dw AS (
  SELECT doc_id, width, k, array_to_string(w[k + 1 : k + width], ' ') AS win
  FROM (SELECT doc_id, w, width, unnest(range(len(w) - width + 1)) AS k FROM d CROSS JOIN widths WHERE len(w) >= width)),
hit AS (SELECT doc_id, k, dw.width, item FROM dw JOIN iw ON dw.win = iw.win AND dw.width = iw.width),
words_hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + width)) AS p FROM (SELECT DISTINCT doc_id, k, width FROM hit)) GROUP BY doc_id),
listed AS (SELECT doc_id, count(DISTINCT item) AS n_items, sha256(array_to_string(list_sort(list_distinct(list(item))), ',')) AS items_sha256 FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words_hit USING (doc_id) LEFT JOIN listed USING (doc_id)
"""
