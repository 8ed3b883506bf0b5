import random
import re
from collections import Counter
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import mixing, quality


def dealt_by_hand(children, budget):
    """children {name: (weight, most)}: fill by weight until nobody is over, in exact steps."""
    full: dict[str, int] = {}
    while True:
        rest, weight = budget - sum(full.values()), sum(w for k, (w, _) in children.items() if k not in full)
        over = {k: m for k, (w, m) in children.items() if k not in full and m * weight <= rest * w}
        if not over:
            return full | {k: rest * w // weight for k, (w, _) in children.items() if k not in full}
        full |= over


def tree_by_hand(leaves, percent, epochs):
    total = sum(leaves.values()) * percent // 100
    below = lambda *key: sum(t * epochs for k, t in leaves.items() if k[: len(key)] == key)
    out = {}
    top = dealt_by_hand({d: (mixing.DOMAINS.get(d, mixing.OTHER), below(d)) for d in {k[0] for k in leaves}}, total)
    for d, budget in top.items():
        middle = dealt_by_hand({x: (mixing.LANGUAGES.get(x, mixing.OTHER), below(d, x)) for x in {k[1] for k in leaves if k[0] == d}}, budget)
        for x, part in middle.items():
            low = dealt_by_hand({k[2]: (1, t * epochs) for k, t in leaves.items() if k[:2] == (d, x)}, part)
            out |= {(d, x, s): v for s, v in low.items()}
    return out


@pytest.mark.parametrize(("percent", "epochs"), [(80, 2), (30, 1), (150, 2), (100, 1)])
def test_budgets(spark, percent, epochs):
    rng = random.Random(percent)
    leaves = {(d, x, f"s{i}"): rng.choice([3, 50, 700, 9000]) for d in ("web", "forum", "other") for x in ("en", "fr", "xx") for i in range(rng.randrange(1, 5))}
    df = spark.createDataFrame([(*k, t) for k, t in leaves.items()], "domain string, language string, origin string, tokens long")
    got = {(r.domain, r.language, r.origin): r.budget for r in mixing.budgets(df, percent, epochs).collect()}
    assert got == tree_by_hand(leaves, percent, epochs)
    assert all(v <= leaves[k] * epochs for k, v in got.items())
    assert sum(got.values()) <= sum(leaves.values()) * percent // 100 < sum(got.values()) + 3 * len(leaves) or percent >= 100 * epochs


def test_mixing(messy, pairs, empty):
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    out = mixing.mixed(messy)
    assert out.columns[: len(messy.columns)] == messy.columns and "_mix_copies" in out.columns and "mix_copies" in messy.columns
    rows = out.collect()
    leaves: dict[tuple, list] = {}
    for r in rows:
        assert r["_mix_tokens"] == count(r.text) > 0 and r.mix_tokens == "x" and 1 <= r["_mix_copies"] <= 2
        leaves.setdefault((r["_mix_domain"], r.lang, r.source), []).append(r)
    for group in leaves.values():
        assert sum(r["_mix_tokens"] * r["_mix_copies"] for r in group) <= group[0]["_mix_leaf_budget"]
    again = mixing.mixed(messy.repartition(5)).select("doc_id", "text", "_mix_copies")
    assert sorted(map(str, again.collect())) == sorted(map(str, out.select("doc_id", "text", "_mix_copies").collect()))
    times = mixing.epochs_of(messy)
    assert times.columns == messy.columns and times.count() == sum(r["_mix_copies"] for r in rows)
    assert mixing.mixed(empty).count() == 0 == mixing.epochs_of(empty).count()


@pytest.mark.parametrize(("leaves", "bucket"), [(20_000, 4096), (0, 2)])
def test_mixing_against_brute_force(spark, monkeypatch, leaves, bucket):
    """Null and repeated ids, repeated rows, one leaf with most rows; both ways of the join."""
    monkeypatch.setattr(mixing, "BROADCAST_LEAVES", leaves)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
    rng = random.Random(bucket)
    rows = [(rng.choice([None, i, i, i, i % 7]), "w " * rng.randrange(1, 30) + str(rng.randrange(40)), rng.choice(["en", "en", None]), rng.choice(["s1", "s1", "s1", "s2", "s3", None])) for i in range(600)]
    rows += rows[:50] * 2 + [(None, "a hot text", "en", "s1")] * 90
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(7)
    prints = {r.text: r.p for r in df.select("text", F.xxhash64("text").alias("p")).distinct().collect()}
    got = Counter()
    for r in mixing.mixed(df).collect():
        got[r.doc_id, r.text, r.lang, r.source, r.mix_copies] += 1

    domain = {"s1": "forum", "s2": "reference", "s3": "web", None: "other"}
    by_leaf: dict[tuple, list] = {}
    for r in rows:
        by_leaf.setdefault((domain[r[3]], r[2] or "unknown", r[3] or "unknown"), []).append(r)
    sizes = {k: sum(len(r[1].split()) for r in v) for k, v in by_leaf.items()}
    want = Counter()
    for key, budget in tree_by_hand(sizes, mixing.SHARE_PERCENT, mixing.EPOCHS).items():
        whole, rest = divmod(budget, sizes[key])
        place = lambda r: (lambda unit: (md5(f"{mixing.SEED}|{whole}|{unit}".encode()).hexdigest(), unit, prints[r[1]]))(f"|{prints[r[1]]}" if r[0] is None else str(r[0]))  # noqa: B023, E731
        units: dict[tuple, list] = {}
        for r in by_leaf[key]:
            units.setdefault(place(r), []).append(r)
        reach = 0
        for at in sorted(units):
            reach += sum(len(r[1].split()) for r in units[at])
            copies = whole + (reach <= rest)
            for r in units[at]:
                want[(*r, copies)] += copies > 0
    assert got == +want and len({k[4] for k in got}) == 2


def test_mixing_moves_no_text(spark):
    """Rows keep the partitions they came in, those without ids too: no shuffle of texts."""
    df = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"), F.lit("s1").alias("source"))
    out = mixing.mixed(df)
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("part")).count().collect()]
    assert len(sizes) == df.rdd.getNumPartitions() and max(sizes) < 2 * min(sizes)


def quality_rows(n=900):
    rng = random.Random(8)
    words = [f"{a}{b}" for a in ("ba", "re", "li", "mo", "tu", "se") for b in ("n", "rk", "st", "la", "", "ming")]
    rows = []
    for i in range(n):
        body = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        bad = i % 6 == 0
        if bad:
            body = [w.upper() + "!!" for w in body] if i % 12 else [rng.choice(words)] * 80
        rows.append((i, " ".join(body) + ".", bad))
    return rows


def test_classifier_separates_held_out_rows(spark):
    rows = quality_rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0 if bad else 1, 0) for i, _, bad in rows if i % 2], "doc_id long, quality int, toxic int").unionByName(spark.createDataFrame([(i, 0, 0) for i, _, bad in rows if bad], "doc_id long, quality int, toxic int"))
    model, prior = quality.trained(docs, labels)
    assert 0.6 < prior < 0.95
    scored = {r.doc_id: r for r in quality.with_score(docs, model, "score").withColumn("fold", quality.fold_of("doc_id")).collect()}
    held = [(scored[i].score >= quality.THRESHOLD) != bad for i, _, bad in rows if scored[i].fold == 0]
    assert np.mean(held) > 0.95 and len(held) > 100


def test_labels_of_bad_texts_and_of_fold_zero_are_not_used(spark):
    rows = quality_rows(300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0 if bad else 1) for i, _, bad in rows], "doc_id long, quality int")
    other = labels.withColumn("quality", F.when((quality.fold_of("doc_id") == 0) | (F.col("quality") == 0), F.lit(None).cast("int")).otherwise(F.col("quality")))
    a, b = quality.trained(docs, labels), quality.trained(docs, other)
    assert a[1] == b[1] and all(np.array_equal(x, y) for x, y in zip(a[0].weights, b[0].weights, strict=True))


def test_scores_of_messy_rows(messy, pairs, empty):
    model, prior = quality.train(np.zeros((0, quality.N_FEATURES)), np.zeros(0, bool))
    assert prior == 0.5
    rows = quality.with_score(messy, model, "fresh").collect()
    assert len(rows) == len(pairs) and all(r.fresh == 0.5 and r.score == "x" for r in rows)
    assert quality.with_score(empty, model, "fresh").count() == 0
    assert quality.features_of(b"") == [0.0] * quality.N_FEATURES and len(quality.features_of(b"a b")) == quality.N_FEATURES


def test_risk_is_corrected_when_negative():
    slopes = quality._non_negative(0.9)
    positive = np.array([True, True, False])
    out = np.array([5.0, 5.0, -5.0])  # the negative part of the risk is below zero
    g = slopes(out, 1 / (1 + np.exp(-out)), positive)
    assert g[2] < 0 and g[0] > 0


def test_features_read_every_word_of_a_long_text():
    one_letter, ending = 12, 14
    got = quality.features_of(b"a river, " * 60_000)
    assert np.allclose([got[one_letter], got[ending]], np.sqrt(0.5))
    assert quality.features_of(b" \n ")[ending] == 1.0


def test_target_weights_and_domains_are_parameters(spark):
    docs = spark.createDataFrame([(i, "a b c d e", "en", f"s{i % 2}") for i in range(400)], "doc_id long, text string, lang string, source string")
    targets = mixing.Targets(domains={"first": 3, "second": 1})
    got = mixing.mixed(docs, percent=40, targets=targets, domain=lambda s: F.when(s == "s0", "first").otherwise("second")).groupBy("mix_domain").agg(F.sum(F.col("mix_tokens") * F.col("mix_copies")).alias("n")).collect()
    assert {r.mix_domain: r.n for r in got} == {"first": 600, "second": 200}
    by_source = mixing.mixed(docs, percent=40, targets=mixing.Targets(sources={"s0": 1, "s1": 3}), domain=lambda s: F.lit("one")).groupBy("source").agg(F.sum(F.col("mix_tokens") * F.col("mix_copies")).alias("n")).collect()
    assert {r.source: r.n for r in by_source} == {"s0": 200, "s1": 600}


def test_the_risk_and_its_gradient_against_brute_force():
    """The non-negative risk written out row by row; its gradient by differences. Where the
    second term is negative, the step goes up that term alone."""
    rng = np.random.default_rng(3)
    positive = np.array([True] * 4 + [False] * 6)
    loss = lambda z: np.log1p(np.exp(-z))

    def terms(out, prior):
        p, u = [x for x, good in zip(out, positive, strict=True) if good], [x for x, good in zip(out, positive, strict=True) if not good]
        rest = sum(loss(-x) for x in u) / len(u) - prior * sum(loss(-x) for x in p) / len(p)
        return prior * sum(loss(x) for x in p) / len(p), rest

    for prior, shift in ((0.3, 0.0), (0.9, 4.0)):
        out = rng.normal(0, 1, 10) + np.where(positive, shift, -shift)
        good, rest = terms(out, prior)
        got = quality._non_negative(prior)(out, 1 / (1 + np.exp(-out)), positive)
        risk = (lambda z, pr=prior: sum(terms(z, pr))) if rest >= 0 else (lambda z, pr=prior: -terms(z, pr)[1])
        for i in range(10):
            up, down = out.copy(), out.copy()
            up[i] += 1e-6
            down[i] -= 1e-6
            assert abs(got[i] - (risk(up) - risk(down)) / 2e-6) < 1e-6, (prior, i)
    assert terms(rng.normal(0, 1, 10) + np.where(positive, 4.0, -4.0), 0.9)[1] < 0 <= terms(np.zeros(10), 0.3)[1]
