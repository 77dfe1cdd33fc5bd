"""Token counts, toxicity and quality: against brute force and by held-out accuracy."""

import random
import zlib

import numpy as np
import pytest

from panelforge.llm import quality, tokens, toxicity

SCHEMA = "doc_id long, text string, score string, grade string"
ODD = [None, "", "   ", "Hello, World!  it's 42 o'clock", "naïve ΣΑΣ straße \x00   ok", "a" * 50000, "x y " * 20000, "🙂🙂 ok"]


@pytest.fixture(scope="module")
def docs(spark):
    some = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(ODD + some)], SCHEMA)


def greedy(word, pieces):
    at, total, symbols = 0, 0, (*word, tokens.END)
    while at < len(symbols):
        for end in range(len(symbols), at, -1):
            if (piece := symbols[at:end]) in pieces:
                total += pieces[piece]
                at = end
                break
        else:
            return 1
    return total


def test_automaton_equals_greedy_search():
    rng = random.Random(3)
    for _ in range(60):
        pieces = {(bytes(rng.choices(b"abc", k=rng.randint(1, 5))), rng.random() < 0.4) for _ in range(rng.randint(1, 14))}
        known = {(*b, tokens.END) if ends else tuple(b): 1 for b, ends in pieces} | {(tokens.END,): 0}
        automaton = tokens.LongestMatch(pieces)
        for _ in range(60):
            word = bytes(rng.choices(b"abcd", k=rng.randint(0, 12)))
            assert automaton.count(word) == greedy(word, known), (pieces, word)


def test_token_counts(spark, docs):
    vocabulary = tokens.read_vocabulary(tokens.VOCABULARY)
    known = {(*b, tokens.END) if ends else tuple(b): 1 for b, ends in vocabulary} | {(tokens.END,): 0}
    find = tokens.regex.compile(tokens.SPLIT).findall
    rows = {r.doc_id: (r.n_tokens, r.n_words) for r in tokens.token_counts(docs.where("length(text) < 3000 OR text IS NULL")).collect()}
    for r in docs.where("length(text) < 3000 OR text IS NULL").collect():
        words = find((r.text or "").lower())
        assert rows[r.doc_id] == (sum(greedy(w.encode(), known) for w in words), len(words))
    assert tokens.token_counts(docs).count() == docs.count()
    assert tokens.token_counts(docs.limit(0)).count() == 0


def labelled(spark, sf="sf0.1"):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_toxicity_on_held_out_labels(spark, docs):
    all_docs, labels = labelled(spark)
    model = toxicity.trained(all_docs, labels)
    assert np.all(np.diff(model.thresholds) > 0)
    out = {r.doc_id: r for r in toxicity.toxicity(all_docs, model).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect() if held_out(r.doc_id)}
    wrong = [i for i, y in truth.items() if out[i].toxic != bool(y)]
    assert len(truth) > 500 and len(wrong) < 0.02 * len(truth)
    assert len({r.grade for r in out.values()}) == 4
    assert all(abs(r.severity) <= 3 and r.toxic == (r.p_toxic >= 0.5) for r in out.values())
    odd = toxicity.toxicity(docs, model).collect()
    assert len(odd) == docs.count() and not any(r.toxic for r in odd[:3])
    left = toxicity.without_toxic(docs, model)
    assert left.columns == docs.columns and left.count() == sum(not r.toxic for r in odd)
    assert toxicity.toxicity(docs.limit(0), model).count() == 0
    nothing = toxicity.trained(all_docs, labels.limit(0))
    assert toxicity.toxicity(docs, nothing).where("toxic").count() == 0


def test_quality_on_held_out_labels(spark, docs):
    all_docs, labels = labelled(spark)
    model = quality.trained(all_docs, labels)
    assert model.pairs and len(model.tables) == len(quality.FEATURES)
    out = {r.doc_id: r for r in quality.quality(all_docs, model).collect()}
    assert all(r.held_out == held_out(i) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for i, r in out.items())
    truth = {r.doc_id: r.quality for r in labels.collect() if held_out(r.doc_id)}
    wrong = [i for i, y in truth.items() if out[i].predicted != y]
    assert len(truth) > 500 and len(wrong) < 0.02 * len(truth)
    assert quality.quality(docs, model).count() == docs.count()
    assert quality.quality(docs.limit(0), model).count() == 0
    nothing = quality.trained(all_docs, labels.limit(0))
    assert {r.score for r in quality.quality(docs, nothing).collect()} == {0.5}


def test_mixing_reaches_targets(spark, docs):
    from panelforge.llm import mixing

    all_docs, labels = labelled(spark, "sf0.01")
    model = mixing.trained(all_docs, labels)
    lang = {r.doc_id: r.lang for r in all_docs.collect()}
    targets = dict(zip(sorted(set(lang.values())), (0.1, 0.4, 0.2, 0.3), strict=True))
    rows = mixing.rates(all_docs, model, targets).collect()
    assert sum(r.domain == lang[r.doc_id] for r in rows) > 0.95 * len(rows)
    total = sum(r.tokens for r in rows)
    for d, share in targets.items():
        assert sum(r.rate * r.tokens for r in rows if r.domain == d) == pytest.approx(share * total, rel=0.05)
        assert sum(r.copies * r.tokens for r in rows if r.domain == d) == pytest.approx(share * total, rel=0.3)
    assert all(0 <= r.rate <= mixing.CEILING and abs(r.copies - r.rate) < 1 for r in rows)
    floored = mixing.rates(all_docs, model, floor=1.0).collect()
    assert min(r.copies for r in floored) == 1
    again = mixing.mixed(all_docs, model, floor=1.0)
    assert again.columns == all_docs.columns and again.count() == sum(r.copies for r in floored)
    odd = docs.drop("score").withColumnRenamed("grade", "lang")
    assert mixing.rates(odd, model).count() == docs.count()
    assert mixing.rates(odd.limit(0), model).count() == 0
    assert mixing.rates(odd, mixing.trained(all_docs, labels.limit(0))).count() == docs.count()


def test_mixing_reaches_a_rare_domain(spark):
    from panelforge.llm import mixing

    rows = [(10_000, [1.0, 0.0])] * 100 + [(10, [0.0, 1.0])] * 10
    members = spark.createDataFrame(rows, "tokens long, posteriors array<double>")
    totals = mixing.fitted(members, ["common", "rare"]).totals()
    assert [d for d, *_ in totals] == ["common", "rare"] and totals[1][1] > 8 * 100
    assert all(reached == pytest.approx(target, rel=0.005) for _, target, reached in totals)


def test_rates_equal_projected_gradient_by_rows(spark):
    """The rates that follow from the stored steps against plain projected gradient descent with a rate for each row."""
    from panelforge.llm import mixing

    rng = np.random.default_rng(6)
    t, p = rng.integers(0, 400, 300), rng.dirichlet([0.4, 0.4, 0.4], 300)
    members = spark.createDataFrame([(k, int(a), [float(x) for x in b]) for k, (a, b) in enumerate(zip(t, p, strict=True))], "id long, tokens long, posteriors array<double>")
    for floor, ceiling in ((0.0, np.inf), (0.5, 1.8)):
        mix = mixing.fitted(members, ["a", "b", "c"], {"a": 0.6, "b": 0.3, "c": 0.1}, floor, ceiling)
        got = np.array([r.rate for r in members.withColumn("rate", mix.rate(mixing.F.col("posteriors"))).orderBy("id").collect()])
        total = (t[:, None] * p).sum(0).sum()
        targets = np.array([0.6, 0.3, 0.1]) * max(total, float((floor * (t[:, None] * p).sum(0) / [0.6, 0.3, 0.1]).max()))
        gram = (t[:, None] * p).T @ p
        weigh, rate = np.linalg.inv(gram + 1e-9 * np.trace(gram) * np.eye(3)), np.ones(300)
        for _ in mix.steps:
            rate = np.clip(rate - p @ (weigh @ (rate * t @ p - targets)), floor, ceiling)
        assert np.allclose(got, rate, atol=1e-6) and np.allclose(mix.targets, targets)
        assert np.allclose([x for _, _, x in mix.totals()], rate * t @ p, rtol=1e-6)


def test_mixing_of_repeated_null_and_clashing_rows(spark):
    from panelforge.llm import mixing

    rows = [(i % 20 if i % 7 else None, None if i % 5 == 0 else f"la casa {i % 20} " * 9 if i % 2 else f"the house {i % 20} " * 4, None if i % 3 == 0 else "xy"[i % 2], 1, 2) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, copies int, row int")
    labels = spark.createDataFrame([(i, 1) for i in range(20)] * 2, "doc_id long, quality int")
    model = mixing.trained(docs, labels)
    assert model.domains[0] == ""
    out = mixing.mixed(docs, model, {"x": 3.0, "y": 1.0}, copy_col="copy")
    assert out.columns == [*docs.columns, "copy"]
    want = {}
    for r in mixing.rates(docs, model, {"x": 3.0, "y": 1.0}).collect():
        want[r.doc_id, r.tokens] = max(r.copies, want.get((r.doc_id, r.tokens), 0))
    seen = {}
    for r in out.collect():
        seen.setdefault((r.doc_id, len((r.text or "").split())), set()).add(r.copy)
    assert seen == {k: set(range(1, c + 1)) for k, c in want.items() if c}


def test_severity_equals_a_sum_of_weights(spark):
    """Scores recomputed without the memo, and the likelihood's gradient is near nought where the fit ended."""
    model = toxicity.OrdinalModel(np.array([f for w in ("bad", "worse") for f in toxicity.features_of(w)[:1]]), np.array([2.0, 3.0]), np.array([1.0, 2.5, 4.5]))
    texts = ["bad", "BAD bad worse!", "fine", None, "", "worse"] * 2
    rows = toxicity.toxicity(spark.createDataFrame([(k % 3, t, 0) for k, t in enumerate(texts)], "doc_id long, text string, __graded int"), model).collect()
    for t, r in zip(texts, rows, strict=True):
        words = set((t or "").lower().replace("!", "").split())
        z = 2.0 * ("bad" in words) + 3.0 * ("worse" in words)
        p = [1 / (1 + np.exp(c - z)) for c in (1.0, 2.5, 4.5)]
        assert r.severity == pytest.approx(sum(p)) and r.grade == sum(x >= 0.5 for x in p) and r.p_toxic == pytest.approx(p[0])
    clash = spark.createDataFrame([(1, "bad", 5), (1, "fine", 5), (None, None, 6)], "doc_id long, text string, __graded int")
    assert [tuple(r) for r in toxicity.without_toxic(clash, model).collect()] == [(1, "fine", 5), (None, None, 6)]


def test_additive_scores_by_hand():
    """Lookup tables against one row at a time, and a fit that finds a planted interaction."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, len(quality.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit(x, y)
    assert (0, 1) in model.pairs and np.mean((model.score(x) > 0.5) == (y > 0)) > 0.9
    for row, s in zip(x[:40], model.score(x[:40]), strict=True):
        z = model.base + sum(t[sum(v >= e for e in edges)] for v, edges, t in zip(row, model.edges, model.tables, strict=True))
        z += sum(t[sum(row[f] >= e for e in model.pair_edges[f]), sum(row[g] >= e for e in model.pair_edges[g])] for (f, g), t in model.pairs.items())
        assert s == pytest.approx(1 / (1 + np.exp(-z)))


def test_samples_of_repeated_documents(spark):
    from panelforge.llm.common import labelled_sample

    docs = spark.createDataFrame([(i % 20, f"t{i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 20, i % 2) for i in range(40)], "doc_id long, toxic int")
    got = labelled_sample(docs, labels, "toxic", 1000).collect()
    assert len(got) == 20 and all(r.text == min(f"t{r.doc_id + k}" for k in (0, 20, 40)) for r in got)
