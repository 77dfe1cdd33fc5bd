"""Personal data by bootstrapped contextual extraction.

Base entities (emails, addresses, payment cards, phone numbers) come from four patterns over the whole text and are the
seeds; long tokens of mixed hexadecimal digits are weak seeds of a fifth kind, secrets. Every seed and every other token
that could be an identifier stands in lexical patterns: the two or three words before it, one that ends as a label does,
or the words on both sides. Patterns and instances form a bipartite graph, which is scored in rounds: a pattern's
confidence for a kind is the smoothed mean of its instances' scores, an instance's score is the best confidence that one
of its patterns gives it, and seeds keep the score 1. Confident patterns with enough support give their kind to further instances of a fitting shape, which are added to the base spans; a weak seed
counts as found only by such a pattern. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .decontam import let

KINDS = ["email", "ip", "card", "phone"]
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
# Each finds what the plain pattern finds, in linear time: a match begins where a run of its first class begins, or
# where the last match ended; possessive runs have nothing to give back. `card` skips runs that have too few or too
# many digits, which the digit count would drop.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
SECRET = r"^(?=[^0-9]*[0-9])(?=[^A-Fa-f]*[A-Fa-f])[0-9A-Fa-f]{32,}$"
WEAK = 4  # the place of secrets, after the kinds
LEFT = 3  # words before an instance
ROUNDS, SMOOTHING, CONFIDENCE, SUREST, SUPPORT = 3, 1.0, 0.7, 0.8, 5
SHAPES = {"email": r"^[^@]+@[^@]+\.[^@]+$", "ip": r"^[0-9a-fA-F]*[:.][0-9a-fA-F:.]+$", "card": r"^(?:[^0-9]*[0-9]){12,19}[^0-9]*$", "phone": r"^(?:[^0-9]*[0-9]){7,15}[^0-9]*$", "secret": r"^(?=[^0-9]*[0-9])[0-9A-Za-z+/_=-]{16,}$"}
ALL_KINDS = [*KINDS, "secret"]
_WORDS = "array<string>"
_SPANS = "array<struct<start:int,end:int,value:string,left:array<string>,right:string>>"
SPACE = r"[\x20\x09-\x0D]+"
FOLD = 256


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def value(i: Column) -> Column:
        d = F.ascii(F.substring(back, i, F.lit(1))) - F.ascii(F.lit("0"))
        return F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), lambda p: F.coalesce(p.try_cast("long") <= 255, F.lit(False))),
    "card": lambda v: luhn(_digits(v)),
    "phone": lambda v: F.length(_digits(v)).between(8, 15),
}


def last_words(words: Column) -> Column:
    return F.when(F.size(words) > LEFT, F.slice(words, -LEFT, LEFT)).otherwise(words)


def stand_in(value: Column) -> Column:
    """What an instance is as a word before another one: its digits as 0, and one word for all with an @."""
    return F.when(F.instr(value, "@") > 0, F.lit("<@>")).otherwise(F.regexp_replace(F.lower(value), "[0-9]", "0"))


def located(text: Column, pattern: str) -> Column:
    """All matches with their places in code points, the LEFT words before them (fewer at the text's beginning),
    lower-cased, and the word after them up to the next match: the pieces between matches tell all of it. Two levels of
    folds keep the copying of lists small for texts with very many matches."""

    def placed(pieces: Column, hits: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            piece, hit = F.get(pieces, i), F.get(hits, i)
            start = acc["at"] + F.char_length(piece)
            end = start + F.char_length(hit)
            words = F.filter(F.split(F.lower(piece), SPACE), lambda w: w != "")
            right = F.nullif(F.regexp_extract(F.lower(F.get(pieces, i + 1)), r"^[\x20\x09-\x0D]*+([^\x20\x09-\x0D]++)", 1), F.lit(""))

            def done(left: Column) -> Column:
                one = F.struct(start.alias("start"), end.alias("end"), hit.alias("value"), left.alias("left"), right.alias("right"))
                return F.struct(end.alias("at"), last_words(F.concat(left, F.array(stand_in(hit)))).alias("tail"), F.concat(acc["out"], F.array(one)).alias("out"))

            return let(last_words(F.concat(acc["tail"], let(words, last_words))), done)

        def zero(at: Column, tail: Column) -> Column:
            return F.struct(at.alias("at"), tail.alias("tail"), F.array().cast(_SPANS).alias("out"))

        def block(acc: Column, first: Column) -> Column:
            last = F.least(first + (FOLD - 1), F.size(hits) - 1)
            return let(F.aggregate(F.sequence(first, last), zero(acc["at"], acc["tail"]), step), lambda x: F.struct(x["at"].alias("at"), x["tail"].alias("tail"), F.concat(acc["out"], x["out"]).alias("out")))

        blocks = F.when(F.size(hits) > 0, F.sequence(F.lit(0), F.size(hits) - 1, F.lit(FOLD))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(blocks, zero(F.lit(0), F.array().cast(_WORDS)), block, lambda acc: acc["out"])

    return let(F.split(text, pattern, -1), lambda pieces: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: placed(pieces, hits)))


def base_spans(text: Column, kind: str) -> Column:
    """Base matches of a kind that pass its test."""
    gate = F.instr(text, "@") > 0 if kind == "email" else text.rlike(GATES[kind])
    found = F.filter(located(text, PATTERNS[kind]), lambda s: VALID[kind](s["value"]))
    return F.when(gate, found).otherwise(F.array().cast(_SPANS))


def patterns_of(left: Column, right: Column) -> Column:
    """Lexical patterns of an instance, digits as 0: the last two and three words, the last one if it ends as a label
    does, and the last one with the next one."""

    def named(words: Column) -> Column:
        def words_before(n: int) -> Column:
            return F.when(F.size(words) >= n, F.concat(F.lit(f"{n}:"), F.array_join(F.slice(words, -n, n), " ")))

        last = F.element_at(words, -1)
        label = F.when(F.size(words) > 0, F.when(last.rlike("[:=#]$"), F.concat(F.lit("1:"), last)))
        both = F.when((F.size(words) > 0) & right.isNotNull(), F.concat(F.lit("b:"), last, F.lit(" _ "), F.regexp_replace(right, "[0-9]", "0")))
        return F.filter(F.array(words_before(2), words_before(3), label, both), lambda p: p.isNotNull())

    return let(F.transform(left, lambda w: F.regexp_replace(w, "[0-9]", "0")), named)


def _listed(spans: Column) -> Column:
    """kind:start:end, comma-joined, by kind as listed, then start."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(F.array(*map(F.lit, ALL_KINDS)), s["k"]), s["start"], s["end"])), ",")


def confident_patterns(edges: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """(pattern, kind, p): what the graph of distinct (pattern, value, kind of the seed or null) is confident of.

    Only patterns with `support` distinct instances can qualify, so the others leave the graph first. A pattern must
    have `confidence`, and where a kind has a large share of all edges, be halfway from it to certainty, though no more
    than SUREST is asked for: where most identifiers are of one kind, any context would seem to announce it."""
    kinds = range(len(ALL_KINDS))
    shares = edges.agg(F.count("*").alias("n"), *[F.count_if(F.col("seed") == k).alias(f"n{k}") for k in kinds]).first()
    needed = [max(confidence, min(SUREST, 0.5 + 0.5 * shares[f"n{k}"] / max(1, shares["n"]))) for k in kinds]
    wide = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= support).select("pattern")
    edges = cut(edges.join(wide, "pattern", "left_semi"))
    seed = [F.when(F.col("seed") == k, F.lit(1.0)).otherwise(F.lit(0.0)) for k in kinds]
    scored = edges.select("pattern", "value", "seed", *[s.alias(f"s{k}") for k, s in enumerate(seed)])
    known = F.col("seed").isNotNull()
    trusted = [F.when((F.col(f"n{k}") >= support) & (F.col(f"p{k}") >= needed[k]), F.col(f"p{k}")).otherwise(0.0) for k in kinds]
    for turn in range(rounds):
        patterns = scored.groupBy("pattern").agg(*[(F.sum(f"s{k}") / (F.count("*") + SMOOTHING)).alias(f"p{k}") for k in kinds], *[F.sum((F.col(f"s{k}") >= confidence).cast("int")).alias(f"n{k}") for k in kinds])
        patterns = cut(patterns.select("pattern", *[t.alias(f"p{k}") for k, t in enumerate(trusted)]))
        if turn == rounds - 1:
            break
        values = edges.where(~known).join(patterns, "pattern").groupBy("value").agg(*[F.max(f"p{k}").alias(f"v{k}") for k in kinds])
        scored = edges.join(values, "value", "left").select("pattern", "value", "seed", *[F.when(known, seed[k]).otherwise(F.coalesce(f"v{k}", F.lit(0.0))).alias(f"s{k}") for k in kinds])
    best = F.array_max(F.array(*[F.struct(F.col(f"p{k}").alias("p"), F.lit(-k).alias("k")) for k in kinds]))
    return patterns.select("pattern", best.alias("best")).where("best.p > 0").select("pattern", (-F.col("best.k")).alias("kind"), F.col("best.p").alias("p"))


def _found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row_hash, base, added) for every row: added spans are null where there are none."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    t = F.col("t")

    def of_kind(k: int) -> Callable[[Column], Column]:
        return lambda s: F.struct(F.lit(k).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), s["left"].alias("left"), s["right"].alias("right"))

    rows = rows.select("doc_id", "t", *[base_spans(t, kind).alias(f"b{k}") for k, kind in enumerate(KINDS)])
    rows = rows.select("doc_id", "t", F.concat(*[F.transform(f"b{k}", of_kind(k)) for k in range(len(KINDS))]).alias("base"))
    tokens = F.filter(F.when(t.rlike("[0-9@]"), located(t, TOKEN)).otherwise(F.array().cast(_SPANS)), lambda s: F.length(_digits(s["value"])).between(4, 40) | s["value"].contains("@"))

    def trimmed(s: Column) -> Column:
        """Without punctuation at its ends; what stood before it is the last word to its left."""
        bare = F.regexp_replace(s["value"], r"^[^0-9A-Za-z+]++", "")
        lead = F.char_length(s["value"]) - F.char_length(bare)
        value = F.regexp_replace(bare, r"(?<![^0-9A-Za-z])[^0-9A-Za-z]++$|(?<=[0-9A-Za-z])[^0-9A-Za-z]++$", "")
        left = F.when(lead > 0, last_words(F.concat(s["left"], F.array(F.substring(s["value"], F.lit(1), lead))))).otherwise(s["left"])
        return F.struct((s["start"] + lead).alias("start"), (s["start"] + lead + F.char_length(value)).alias("end"), value.alias("value"), left.alias("left"), s["right"].alias("right"))

    apart = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    others = F.filter(F.transform(tokens, trimmed), lambda s: (F.char_length(s["value"]) > 0) & apart(s))
    rows = rows.select("doc_id", "t", "base", others.alias("others"))

    def instance(s: Column, k: Column) -> Column:
        return F.struct(k.alias("seed"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), patterns_of(s["left"], s["right"]).alias("patterns"))

    weak = lambda s: F.when(s["value"].rlike(SECRET), F.lit(WEAK))
    instances = F.concat(F.transform("base", lambda s: instance(s, s["k"])), F.transform("others", lambda s: instance(s, weak(s))))
    slim = F.transform("base", lambda s: F.struct(s["k"].alias("k"), s["start"].alias("start"), s["end"].alias("end")))
    rows = cut(rows.select("doc_id", F.xxhash64("doc_id", "t").alias("row_hash"), slim.alias("base"), instances.alias("instances")))
    each = rows.select("doc_id", "row_hash", F.inline("instances")).select("doc_id", "row_hash", "seed", "start", "end", "value", F.explode("patterns").alias("pattern"))
    edges = each.groupBy("pattern", F.xxhash64("value").alias("value")).agg(F.min("seed").alias("seed"))
    patterns = confident_patterns(edges)
    fits = F.coalesce(*[F.when(F.col("kind") == k, F.col("value").rlike(SHAPES[kind])) for k, kind in enumerate(ALL_KINDS)])
    hits = each.where(F.col("seed").isNull() | (F.col("seed") == WEAK)).join(patterns, "pattern").where(fits)
    surest = hits.groupBy("doc_id", "row_hash", "start", "end").agg(F.max(F.struct("p", (-F.col("kind")).alias("k"))).alias("m"))
    added = surest.groupBy("doc_id", "row_hash").agg(F.collect_set(F.struct((-F.col("m.k")).alias("k"), "start", "end")).alias("added"))
    added = added.select(F.col("doc_id").alias("added_id"), F.col("row_hash").alias("added_hash"), "added")
    return rows.select("doc_id", "row_hash", "base").join(added, (F.col("row_hash") == F.col("added_hash")) & F.col("doc_id").eqNullSafe(F.col("added_id")), "left").select("doc_id", "row_hash", "base", "added")


def _all_spans() -> Column:
    return F.when(F.col("added").isNull(), F.col("base")).otherwise(F.concat("base", "added"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added for every row.

    `spans` has the base spans and those that the patterns added, secrets last; `n_added` counts the latter. A null text
    counts as empty and has no spans. Rows repeated with their id and text each get a row, with the same spans; ids may
    be null. Equal values in one document are instances of their own in `spans` and one instance of a pattern in the
    graph. No rows give no rows. Other columns are ignored."""
    out = _found(docs, id_col, text_col)

    def is_kind(k: int) -> Callable[[Column], Column]:
        return lambda s: s["k"] == k

    counts = [F.size(F.filter("base", is_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    n_added = F.when(F.col("added").isNull(), F.lit(0)).otherwise(F.size("added")).cast("long")
    return out.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(_all_spans()).alias("spans"), n_added.alias("n_added"))


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each span of its text replaced by the span's kind in angle brackets: of overlapping spans, the first.

    Spans are joined by id and text, so rows that share an id keep their own texts, repeated rows and null ids too. Null
    texts stay null. Columns of docs with any names stay as they are."""
    key, spans = "__pii_hash", "__pii_spans"
    while {key, spans} & set(docs.columns):
        key, spans = f"{key}_", f"{spans}_"
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    found = _found(docs, id_col, text_col).select("row_hash", _all_spans().alias("s")).where(F.size("s") > 0)
    found = found.groupBy(F.col("row_hash").alias(f"{key}f")).agg(F.first("s").alias(spans))  # a row's hash is of its id and text
    parts = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(F.array(*map(F.lit, ALL_KINDS)), s["k"]).alias("kind")))
    done = F.aggregate(
        F.array_sort(parts),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), s["kind"], F.lit(">")).alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))),
    )
    joined = docs.withColumn(key, F.xxhash64(F.col(f"`{id_col}`").cast("long"), text)).join(found, F.col(key) == F.col(f"{key}f"), "left")
    return joined.withColumn(text_col, F.when(F.col(spans).isNull(), F.col(f"`{text_col}`")).otherwise(done)).select(*[f"`{c}`" for c in docs.columns])


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
