"""Joins, searches, components, thresholds, models and folds against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from shelfmark.operators import dedup, features, hamming, knn, linear, thresholds, transfer
from shelfmark.operators.graph import connected_components


def union_find(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)], [(random.Random(4).randint(0, 80), random.Random(i).randint(0, 80)) for i in range(70)], [(5, 5)], []])
def test_components(spark, edges):
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == union_find([e for e in edges if e[0] != e[1]])


def test_components_pass_over_nulls(spark):
    assert connected_components(spark.createDataFrame([(None, 1), (2, None), (3, 4), (4, 3)], "a long, b long")).count() == 2


def test_retrieval_policy(spark):
    """(category, n_exact, low, high, same, near_low, near_high) to (decision, reason)."""
    bad, fire = "БАД", "Легковоспламеняющиеся"
    cases = [
        ((bad, 2, 1, 1, True, None, None), (1, "exact_sha256_multi_name")), ((bad, 1, 1, 1, True, None, None), (None, "exact_sha256_observe")), ((bad, 0, None, None, False, 1, 1), (1, "dhash_name_positive")), ((fire, 0, None, None, False, 1, 1), (1, "dhash_name_positive")),
        ((fire, 1, 0, 0, False, 1, 1), (None, "image_conflict")), ((fire, 2, 0, 1, False, None, None), (None, "exact_sha256_conflict")), ((fire, 0, None, None, False, 0, 0), (0, "dhash_name_negative")), ((bad, 0, None, None, False, 0, 0), (None, "image_abstain")), ((fire, 0, None, None, False, 0, 1), (None, "image_abstain")),
    ]
    rows = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, c string, n long, lo int, hi int, s boolean, nl int, nh int")
    d, r = hamming.decide(*[F.col(x) for x in ("c", "n", "lo", "hi", "s", "nl", "nh")], bad, fire)
    assert [(x.d, x.r) for x in rows.select("i", d.alias("d"), r.alias("r")).orderBy("i").collect()] == [w for _, w in cases]


def test_top_k_order(spark):
    train = spark.createDataFrame([(0, 0), (1, 1), (2, 3), (3, 7)], "id long, word long")
    got = hamming.top_k(spark.createDataFrame([(9, 0)], "query_id long, word long"), train, 8, 2, 4).orderBy("rank").collect()
    assert [(r.id, r.dist) for r in got] == [(0, 0), (1, 1), (2, 2)]


def test_banded_join_finds_all_pairs(spark):
    r = random.Random(7)
    words = [r.getrandbits(20) & r.getrandbits(20) for _ in range(150)] + [5, 5, 5]
    rows = spark.createDataFrame(list(enumerate(words)), "id long, word long")
    got = {x.id: x.n_links for x in hamming.neighbours(rows, 20, 3).collect()}
    assert got == {i: sum(bin(a ^ b).count("1") <= 3 for b in words) - 1 for i, a in enumerate(words)}
    fam = union_find([(i, j) for i in range(len(words)) for j in range(i) if bin(words[i] ^ words[j]).count("1") <= 3])
    assert {x.node: x.component for x in connected_components(hamming.word_edges(rows, 20, 3)).collect()} == fam


def test_knn_blocks(spark, monkeypatch):
    r = np.random.default_rng(3)
    x = r.normal(size=(60, 6))
    rows = spark.createDataFrame([(i, i % 2, x[i].tolist(), int(i % 3 == 0)) for i in range(60)] + [(60, 0, None, 1), (61, 0, [0.0] * 6, 1)], "id long, category long, vector array<double>, label int")
    monkeypatch.setattr(knn, "BLOCK", 7)
    got = {}
    for row in knn.top_k(rows.drop("label"), rows, 3, 0.2).collect():
        got.setdefault(row.query_id, []).append((row["rank"], row.id))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(60):
        near = sorted([(-(u[i] @ u[j]), j) for j in range(60) if j != i and j % 2 == i % 2 and u[i] @ u[j] >= 0.2])[:3]
        assert [j for _, j in sorted(got.get(i, []))] == [j for _, j in near]


def test_verdict_edges(spark):
    rows = spark.createDataFrame([(10, 1), (10, 9), (10, 0), (1, 1), (2, 1), (20, 2)], "n long, pos long")
    assert [r.v for r in rows.select(transfer.verdict(F.col("n"), F.col("pos")).alias("v")).collect()] == [None, 1, 0, None, None, None]


def brute_threshold(pairs):
    positives = sum(y for _, y in pairs)
    if not positives:
        return 0.0, 0.5
    cuts = [(p, 2 * sum(y for q, y in pairs if q >= p) / (sum(q >= p for q, _ in pairs) + positives)) for p, _ in pairs]
    best = max(f for _, f in cuts)
    return best, float(np.median(sorted({p for p, f in cuts if f >= best - 1e-12}))) if best > 0 else 0.5


def test_best_threshold(spark):
    r = random.Random(5)
    rows = [(c, round(r.random(), 2), int(r.random() < 0.3)) for c in "abc" for _ in range(90)] + [("none", 0.4, 0), ("one", 0.7, 1)]
    got = {x.category: (x.best_f1, x.threshold) for x in thresholds.best_threshold(spark.createDataFrame(rows, "category string, prob double, label int"), ["category"]).collect()}
    for c in ("a", "b", "c", "none", "one"):
        want = brute_threshold([(p, y) for k, p, y in rows if k == c])
        assert math.isclose(got[c][0], want[0]) and math.isclose(got[c][1], want[1]), c


def test_families_and_queue(spark):
    cards = spark.createDataFrame([(1, "a", "x", 1), (2, "b", "x", 0), (3, "c", "x", None), (4, "d", "x", 1), (5, "e", "y", 0)], "id long, name string, category string, label int")
    members = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)], "id long, family long")
    queue = dedup.conflict_queue(cards, members, spark.createDataFrame([(2,)], "id long")).collect()
    assert [(r.family, r.ids, r.n_label1, r.n_label0, r.resolved_ids, r.first_name) for r in sorted(queue, key=lambda r: r.family)] == [(1, "1 2", 1, 1, 1, "a"), (4, "4 5", 1, 1, 0, "d")]
    assert dedup.family_report(cards, members).first().n_mixed == 2
    kept = dedup.keep_first(cards, F.col("category"), ["id"], ["label"]).collect()
    assert sorted(r.id for r in kept) == [1, 2, 3, 5]


def test_char_ngrams_of_short_words(spark):
    def wb(text, low, high):
        out = []
        for w in text.lower().split():
            w = f" {w} "
            for n in range(low, high + 1):
                out.append(w[:n])
                at = 0
                while at + n < len(w):
                    at += 1
                    out.append(w[at : at + n])
                if at == 0:
                    break
        return sorted(out)

    for text in ("a bcd efghij", "", "xy", "печь газ"):
        got = spark.createDataFrame([(text,)], "t string").select(features.char_wb_ngrams(F.col("t"), 3, 6).alias("g")).first().g
        assert sorted(got) == wb(text, 3, 6)


def test_logistic_regression_against_newton(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(200, 3))
    y = (x @ [1.0, -2.0, 0.5] + r.normal(size=200) > 0.3).astype(int)
    head = linear.train(spark.createDataFrame([(Vectors.dense(a), int(b)) for a, b in zip(x, y)], ["features", "label"]), 1.0)
    w = np.where(y == 1, 200 / (2 * y.sum()), 200 / (2 * (200 - y.sum())))
    z, d = np.zeros(4), np.c_[x, np.ones(200)]
    for _ in range(40):
        p = 1 / (1 + np.exp(-d @ z))
        reg = np.diag([1, 1, 1, 0.0])
        z -= np.linalg.solve(d.T @ (d * (w * p * (1 - p))[:, None]) + reg, d.T @ (w * (p - y)) + reg @ z)
    assert np.allclose(head.weights, z[:3], atol=2e-3) and abs(head.bias - z[3]) < 2e-3


def test_folds_keep_groups_together(spark):
    r = random.Random(8)
    rows = [(i, i % 60, int(r.random() < 0.2)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, g long, label int")
    folds = {x.g: x.fold for x in linear.group_folds(df, "g").collect()}
    assert len(folds) == 60 and set(folds.values()) == set(range(5))
    pos = [sum(y for _, g, y in rows if folds[g] == f) for f in range(5)]
    assert max(pos) <= 2 * min(pos) + 5
    shuffled = {x.g: x.fold for x in linear.group_folds(df.orderBy(F.rand(3)).repartition(7), "g").collect()}
    assert folds == shuffled


def test_out_of_fold_and_bagging(spark):
    r = np.random.default_rng(2)
    rows = [(i, i % 20, int(v > 0), Vectors.dense([v, 1.0])) for i, v in enumerate(r.normal(size=120))]
    df = spark.createDataFrame(rows, ["id", "g", "label", "features"])
    oof = linear.out_of_fold(df, linear.group_folds(df, "g", folds=3), "g", n_folds=3)
    assert oof.count() == 120 and oof.where("(prob >= 0.5) = (label = 1)").count() >= 110
    assert linear.bagged(df, df, 2).count() == 120
