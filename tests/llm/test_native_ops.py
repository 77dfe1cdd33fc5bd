"""Exact dedup, sharding, decontamination and personal data, against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from panelforge.llm import decontam, exact_dedup, pii, sharding

SCHEMA = "doc_id long, text string, lang string, shard string"
LONG = "word%d " * 3
TEXTS = [
    "a b  c", "a b c", "a\tb\nc", None, "", " ", "x", "x", "É" * 40, " ".join(f"w{i}" for i in range(30000)),
    "mail bob.x@a-b.example.com, or _q@z.d.e_f@g.h 1.2.3.4.5 and 999.1.1.1 or 010.002.3.255",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112 and 41111111111111111111111 5 4111111111111111",
    "+1 (724) 555-7058 then +1.......... x +49 (0) 30-1234567) +1+2+3 4",
    "é" * 50 + " z@y.xx " + "7" * 3000 + "@" + "a" * 5000,
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "clash") for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    some = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    return frame(spark, TEXTS + some)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(spark, docs):
    def check(df):
        rows = [(r.doc_id, re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")) for r in df.collect()]
        groups = defaultdict(list)
        for i, t in rows:
            groups[t].append(i)
        want = {(i, min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows}
        out = exact_dedup.exact_duplicates(df)
        assert {tuple(r) for r in out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()} == want

    check(docs)
    check(empty(spark))
    # one group holds most rows and spans partitions; rows fit several Arrow batches
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(frame(spark, ["same  text"] * 700 + ["one", "two", "one"] + ["same text"] * 300 + [None] * 40))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_exact_dedup_of_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (3, "a"), (3, "a"), (None, "b")], "doc_id long, text string")
    out = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(df).collect()), key=str)
    assert out == sorted([(None, 3, 4, False), (None, 3, 4, False), (3, 3, 4, True), (3, 3, 4, True), (None, None, 1, True)], key=str)
    assert exact_dedup.deduplicated(df).where("text = 'a'").count() == 2


def test_sharding(spark, docs):
    both = docs.union(docs)  # repeated rows
    rows = sharding.shard_table(both).collect()
    n = both.count()
    assert len(rows) == n
    assert sorted((r.shard, r.slot) for r in rows) == sorted((p % 40, p // 40) for p in range(n))
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert all(r.size == len(texts[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) for r in rows)
    again = sharding.shard_table(both.repartition(7)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    assert sharding.shard_table(empty(spark)).count() == 0
    kept = sharding.sharded(docs)
    assert kept.columns == ["doc_id", "text", "lang", "shard", "slot"] and kept.count() == docs.count()


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 10, 99, 1000, 1023])
def test_permutation_is_a_bijection(spark, n):
    out = [r[0] for r in spark.range(n).select(sharding.walked(F.col("id"), n)).collect()]
    assert sorted(out) == list(range(n))


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_decontamination(spark, docs):
    w = [f"t{i}" for i in range(60)]
    extra = [" ".join(w[5:40]), " ".join(["x"] * 20 + w[10:23] + ["y"] * 400), " ".join(w[10:22]), "Short Item, here", "nothing short item here", "x " * 30, " ".join(w[:13] + w[:13])]
    items = [(7, " ".join(w)), (10, " ".join(w[8:30])), (2, "short ITEM"), (3, ""), (4, None), (5, "x " * 14), (2, "short ITEM")]
    items += [(r.item_id + 100, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    df = docs.union(spark.createDataFrame([(1000 + i, t, "en", "s") for i, t in enumerate(extra)], SCHEMA))
    windows = defaultdict(set)
    for i, t in items:
        v = plain_words(t)
        for k in range(max(1, len(v) - 12)) if v else ():
            windows[tuple(v[k : k + 13])].add(str(i))
    want = {}
    for r in df.collect():
        v, hit, found = plain_words(r.text), set(), set()
        for m in {len(k) for k in windows}:
            for k in range(len(v) - m + 1):
                if got := windows.get(tuple(v[k : k + m])):
                    hit |= set(range(k, k + m))
                    found |= got
        want[r.doc_id] = (len(v), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(v))
    bench = spark.createDataFrame(items, "item_id long, text string")

    def got():
        return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.contamination(df, bench).collect()}

    assert got() == want
    bounds = decontam.BROADCAST_ROWS
    decontam.BROADCAST_ROWS = 0  # the way for benchmarks that are too large to broadcast
    try:
        assert got() == want
    finally:
        decontam.BROADCAST_ROWS = bounds
    left = {r.doc_id for r in decontam.decontaminated(df, bench).collect()}
    assert left == {i for i, x in want.items() if not x[4]}
    assert decontam.contamination(empty(spark), bench).count() == 0
    assert decontam.contamination(df, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontam.contamination(spark.createDataFrame([(None, "a b")], "doc_id long, text string"), bench).count() == 1


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    def luhn(d):
        x = [int(c) for c in reversed(d)]
        return (sum(x[::2]) + sum(sum(divmod(2 * c, 10)) for c in x[1::2])) % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    fine = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s)), "phone": lambda s: 8 <= len(digits(s)) <= 15}
    return [(k, m.start(), m.end()) for k in PLAIN for m in re.finditer(PLAIN[k], text or "") if fine[k](m.group())]


def test_personal_data(spark, docs):
    rows = pii.personal_data(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        spans = plain_spans(texts[r.doc_id])
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        count = Counter(k for k, _, _ in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (count["email"], count["ip"], count["card"], count["phone"])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) - {""} <= set(r.spans.split(","))
    assert pii.personal_data(empty(spark)).count() == 0


def test_contexts_find_further_identifiers(spark):
    texts = [f"please ring me at +1 (555) 010-{1000 + i} thanks" for i in range(12)] + ["please ring me at 555-010-7777, thanks", "it costs about 555-010-7778 for now"]
    rows = {r.doc_id: r.spans for r in pii.personal_data(frame(spark, texts)).collect()}
    assert rows[12] == "phone:18:30"
    assert rows[13] == ""
    out = {r.doc_id: r.text for r in pii.masked(frame(spark, texts)).collect()}
    assert out[12] == "please ring me at <phone>, thanks" and out[0] == "please ring me at <phone> thanks"


def contexts(text, spans):
    """(start, end, patterns) of each span: words before it, words before and after; in plain Python."""
    out, tail, at = [], [], 0
    zero = lambda w: re.sub("[0-9]", "0", w)
    for k, (a, b) in enumerate(spans):
        left = (tail + text[at:a].lower().split())[-3:]
        following = text[b : spans[k + 1][0] if k + 1 < len(spans) else None].lower().split()
        words, found = [zero(w) for w in left], []
        found += [f"{n}:{' '.join(words[-n:])}" for n in (2, 3) if len(words) >= n]
        if words and words[-1][-1] in ":=#":
            found.append(f"1:{words[-1]}")
        if words and following:
            found.append(f"b:{words[-1]} _ {zero(following[0])}")
        out.append((a, b, set(found)))
        value = text[a:b]
        tail, at = (left + ["<@>" if "@" in value else zero(value.lower())])[-3:], b
    return out


def test_words_around_instances(spark):
    texts = ["pay a@b.co c@d.co e@f.co g@h.co", "ID: a@b.co, and " + "x" * 300 + " y z@w.xx.", "u@v.w", "", "e1 é2 a@b.co\tç c@d.co"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.transform(pii.located(F.col("t"), pii.PATTERNS["email"]), lambda s: F.struct(s["start"], s["end"], pii.patterns_of(s["left"], s["right"]).alias("p"))).alias("s")).collect()
    for r in rows:
        spans = [m.span() for m in re.finditer(PLAIN["email"], r.t)]
        assert [(s[0], s[1], set(s["p"])) for s in r.s] == contexts(r.t, spans)
    assert all(s["p"] for s in rows[0].s[1:])


def scored(edges, rounds=pii.ROUNDS, confidence=pii.CONFIDENCE, support=pii.SUPPORT):
    """confident_patterns in plain Python."""
    kinds = range(len(pii.ALL_KINDS))
    needed = [max(confidence, min(pii.SUREST, 0.5 + 0.5 * sum(s == k for _, _, s in edges) / len(edges))) for k in kinds]
    of = defaultdict(list)
    for p, v, s in edges:
        of[p].append((v, s))
    of = {p: x for p, x in of.items() if len(x) >= support}
    best = {}
    for _ in range(rounds):
        trust = {}
        for p, x in of.items():
            scores = [[float(s == k) if s is not None else best.get(v, [0.0] * len(kinds))[k] for v, s in x] for k in kinds]
            trust[p] = [sum(c) / (len(c) + 1) if sum(c) / (len(c) + 1) >= needed[k] and sum(z >= confidence for z in c) >= support else 0.0 for k, c in enumerate(scores)]
        best = {}
        for p, x in of.items():
            for v, s in x:
                if s is None:
                    best[v] = [max(a, b) for a, b in zip(best.get(v, [0.0] * len(kinds)), trust[p], strict=True)]
    return {(p, max(kinds, key=lambda k: (t[k], -k)), round(max(t), 9)) for p, t in trust.items() if max(t) > 0}


def test_graph_scores_equal_brute_force(spark):
    import random

    r = random.Random(4)
    edges = {}
    for p in range(40):
        kind, share = p % 5, r.choice([0.2, 0.6, 0.9, 1.0])
        for _ in range(r.choice([3, 6, 20, 60])):
            edges[p, r.randrange(400)] = kind if r.random() < share else None
    seed = {}  # a value is one kind of seed throughout
    rows = [(f"p{p}", v, seed.setdefault(v, s)) for (p, v), s in edges.items()]
    got = pii.confident_patterns(spark.createDataFrame(rows, "pattern string, value long, seed int")).collect()
    want = scored(rows)
    assert {(x.pattern, x.kind, round(x.p, 9)) for x in got} == want and want


def test_secrets_need_a_context(spark):
    hexes = [hashlib.sha1(b"%d" % i).hexdigest() for i in range(30)]
    texts = [f'some prose {i} token = "{h}" more prose' for i, h in enumerate(hexes[:20])] + ['other prose token = "Abc-93kd_02mfQpLz81" tail', f"commit {hexes[25]} fixes it", f"a hash like {hexes[26]}"]
    rows = {r.doc_id: r for r in pii.personal_data(frame(spark, texts)).collect()}
    assert all(rows[i].spans == f"secret:{texts[i].index(h)}:{texts[i].index(h) + 40}" and rows[i].n_added == 1 for i, h in enumerate(hexes[:20]))
    assert rows[20].spans == "secret:21:40" and rows[21].spans == rows[22].spans == ""  # found by the context alone; not by the shape alone


def test_masking_of_repeated_and_null_ids(spark):
    data = [(1, "write to a@b.co", 5), (1, "totally different text without any", 6), (None, "at c@d.ee now", 7), (None, "at c@d.ee now", 7), (2, None, 8)]
    df = spark.createDataFrame(data, "doc_id long, text string, __pii_hash long").withColumn("base", F.lit(1)).withColumn("spans", F.lit("s")).withColumn("others", F.lit(2))
    out = pii.masked(df)
    assert out.columns == df.columns
    assert sorted((tuple(r)[:3] for r in out.collect()), key=str) == sorted([(1, "write to <email>", 5), data[1], (None, "at <email> now", 7), (None, "at <email> now", 7), data[4]], key=str)
    assert Counter((r.doc_id, r.spans, r.n_added) for r in pii.personal_data(df).collect()) == Counter([(1, "email:9:15", 0), (1, "", 0), (None, "email:3:9", 0), (None, "email:3:9", 0), (2, "", 0)])


def test_sharding_keeps_columns_and_spreads_null_ids(spark):
    df = spark.createDataFrame([(None if i % 2 else i, f"text {i}", i) for i in range(300)], "doc_id long, text string, __size long")
    for name in ("bucket", "rank", "offset", "number", "place", "row", "size", "text_crc32"):
        df = df.withColumn(name, F.lit(name))
    out = sharding.sharded(df)
    assert out.columns == [*df.columns, "shard", "slot"]
    rows = out.collect()
    assert sorted((r.shard, r.slot) for r in rows) == sorted((p % 40, p // 40) for p in range(300))
    assert Counter(tuple(r)[:-2] for r in rows) == Counter(map(tuple, df.collect()))
    buckets = sharding.sized(df).select(sharding._bucket(F.col("doc_id"), F.col("size"), F.col("text_crc32")).alias("b")).distinct().count()
    assert buckets > 250


def test_decontaminated_keeps_columns_and_repeated_rows(spark):
    item = " ".join(f"b{i}" for i in range(14))
    rows = [(1, item, "x"), (1, "other text", "y"), (None, None, "z"), (2, "", "z"), (3, "some text", "w"), (3, "some text", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone string")
    out = decontam.decontaminated(df, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert out.columns == df.columns and Counter(map(tuple, out.collect())) == Counter(rows[2:])
