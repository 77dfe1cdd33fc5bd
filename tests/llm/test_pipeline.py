"""The near-duplicate join against brute force, and the pipeline stage by stage."""

import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from panelforge.llm import decontam, ngram_join, toxicity
from panelforge.llm.components import components

SCHEMA = "doc_id long, text string, rep string, n long"


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_force(rows):
    """doc_id -> (set sizes, component)."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return Counter((i, len(s), None if i is None else find(i)) for i, s in sets)


def near_copies(seed=5):
    r, rows = random.Random(seed), [(None, "a b c d e f"), (None, None), (0, "a b c d e f"), (1, "A b\tC d e f"), (2, ""), (3, None), (4, " \n"), (5, "one two"), (6, "ONE two"), (7, "one two three"), (7, "a b c d e f")]
    common = [f"shared{i}" for i in range(60)]
    for base in range(25):
        words = [f"w{base}x{i}" for i in range(r.choice([6, 12, 40, 150, 600]))]
        if base % 3 == 0:
            words = common + words
        rows.append((100 * base + 10, " ".join(words)))
        for copy in range(r.choice([0, 1, 5])):
            mine = list(words)
            for _ in range(r.choice([0, 1, 1, 2, 4, 9])):
                k = r.randrange(len(mine))
                mine[k : k + 1] = r.choice([[], [f"n{base}c{copy}k{k}"], [mine[k], "extra"]])
            rows.append((100 * base + 11 + copy, " ".join(mine)))
    long = [f"q{i}" for i in range(200)]
    for copy in range(150):  # a chain of near copies that share most of their shingles
        long[copy] = f"z{copy}"
        rows.append((9000 - copy, " ".join(long)))
    rows.append((9999, " ".join(f"v{i}" for i in range(40000))))
    r.shuffle(rows)
    return rows


def test_components_of_links(spark):
    r = random.Random(2)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {x: x for e in links for x in e}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: y for x, y in root.items() if any(a != b and x in (a, b) for a, b in links)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_near_duplicates_equal_brute_force(spark, small, monkeypatch):
    if small:  # the ways for large inputs: many flushes, blocks of common shingles in pairs, shuffled ids
        monkeypatch.setattr(ngram_join, "BLOCK", 20)
        monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 0)
    rows = near_copies()
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df).collect())
    assert got == brute_force(rows)
    if not small:
        kept = ngram_join.one_of_each(df)
        assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, _, c in brute_force(rows) if i is None or i == c}
        assert ngram_join.near_duplicates(df.limit(0)).count() == 0


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    steps, now = [], docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, sf).cache()
        steps.append(now.collect())
        assert now.columns[: len(columns)] == columns
    whole = docs.collect()
    model = toxicity.trained(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.toxicity(docs, model).where("toxic").collect()}
    assert {r.doc_id for r in steps[0]} == {r.doc_id for r in whole} - toxic and toxic
    parts = brute_force([(r.doc_id, r.text) for r in steps[0]])
    assert {r.doc_id for r in steps[1]} == {i for i, _, c in parts if i == c}
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    windows = defaultdict(set)
    word = decontam.WORD
    import re

    split = lambda t: re.findall(word, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    for r in items.collect():
        w = split(r.text)
        for k in range(max(1, len(w) - 12)):
            windows[tuple(w[k : k + 13])].add(r.item_id)
    clean = set()
    for r in steps[1]:
        w = split(r.text)
        hit = {k + x for k in range(len(w) - 12) if tuple(w[k : k + 13]) in windows for x in range(13)}
        if not hit or 20 * len(hit) < len(w):
            clean.add(r.doc_id)
    assert {r.doc_id for r in steps[2]} == clean
    copies = Counter(r.doc_id for r in steps[3])
    assert set(copies) == clean and all(tuple(r) in {tuple(x) for x in steps[2]} for r in steps[3][:50])
    n = len(steps[3])
    assert sorted((r.shard, r.slot) for r in steps[4]) == sorted((p % 40, p // 40) for p in range(n))
    assert Counter(r.doc_id for r in steps[4]) == copies


def test_pipeline_on_odd_rows(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    some = spark.read.parquet(f"{sf}/documents.parquet").limit(30)
    text = "a text that stands here twice and has words enough for some shingles"
    odd = spark.createDataFrame([(None, None, "en", "s", 0), (None, "", None, None, 0), (5001, None, "en", "s", 0), (5002, text, "en", "s", 9), (5002, text, "en", "s", 9), (5003, text + " more", "en", "s", 9)], some.schema)
    extra = {name: spark_lit(name) for name in ("gone", "row", "copies", "m", "node", "root", "__graded", "__copies", "number", "place")}
    docs = some.unionByName(odd).withColumns(extra)
    for name, frame in (("documents", docs), ("none", docs.limit(0))):
        folder = tmp_path / name
        frame.write.parquet(f"{folder}/documents.parquet")
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
        out = corpus_pipeline.run(spark, str(folder))
        assert out.columns == [*docs.columns, "shard", "slot"]
        rows = out.collect()
        assert sorted((r.shard, r.slot) for r in rows) == sorted((p % 40, p // 40) for p in range(len(rows)))
        if name == "none":
            assert not rows
            continue
        kept = Counter((r.doc_id, r.text) for r in rows)
        assert kept[None, None] and kept[None, ""] and kept[5001, None] and kept[5002, text] >= 2 and not kept[5003, text + " more"]


def spark_lit(name):
    from pyspark.sql import functions as F

    return F.lit(name)
