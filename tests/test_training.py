"""Training end to end, saved models, prompts and model-backed columns."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import prompts
from shelfmark.functions import rules
from shelfmark.operators import linear, providers
from shelfmark.plans import pipeline, training


def test_train_save_load(spark, tmp_path):
    rows = [(i, f"товар {i}", ("зажигалка с газом " if i % 3 == 0 else "чехол для телефона ") + f"вариант {i}", "c", int(i % 3 == 0)) for i in range(60)] + [(99, "x", "y", "c", None), (98, "z", "w", "other", 1)]
    cards = pipeline.prepared(spark.createDataFrame(rows, "id long, name string, description string, category string, label int"))
    families = spark.createDataFrame([(0, 0), (3, 0)], "id long, family long")
    made = training.train_category(cards, families, "c", grid=(1.0,), seeds=(1, 2), slots=256)
    assert made.f1 > 0.95 and 0 <= made.head.threshold <= 1
    training.save(spark, {"c": made}, str(tmp_path / "m"))
    assert training.load(spark, str(tmp_path / "m"))["c"].head.weights == made.head.weights
    spark.read.parquet(str(tmp_path / "m")).withColumn("version", F.lit(2)).write.parquet(str(tmp_path / "old"))
    with pytest.raises(ValueError):
        training.load(spark, str(tmp_path / "old"))


def test_prompts(spark):
    one = spark.createDataFrame([("К", "имя", None, "т" * 3000)], "c string, n string, d string, t string")
    r = one.select(prompts.comment_prompt(F.col("c"), F.col("t"), F.lit(1), F.lit("Основания.")).alias("a"), prompts.card_prompt(F.col("c"), F.col("n"), F.col("d"), {"К": "правило"}).alias("b"), prompts.messages(F.col("n"), "s", [("q", "a")]).alias("m")).first()
    assert "«К»" in r.a and r.a.count("т" * 2400) == 1 and "т" * 2401 not in r.a
    assert r.b.startswith("Категория проверки: К.\nПравило: правило.\nНазвание: имя\nОписание: \n")
    versions = {"v1": {"К": "кратко"}, "v2": {"К": "полностью"}}
    assert prompts.rules_of(versions) == versions["v1"] and prompts.rules_of(versions, "v2") == versions["v2"]
    with pytest.raises(ValueError):
        prompts.rules_of(versions, "v3")
    assert [(m.role, m.content) for m in r.m] == [("system", "s"), ("user", "q"), ("assistant", "a"), ("user", "имя")]


def test_provider_keeps_failures_to_their_rows(spark):
    def load():
        def model(part):
            if (part["x"] == 5).any():
                raise MemoryError
            return (part["x"] * 2.0).tolist()

        return model

    rows = providers.by_length(spark.createDataFrame([(i, "a" * i) for i in range(12)], "x long, t string"), "t", 2)
    got = {r.x: r.y for r in providers.with_provider(rows, "y", "double", load, 4).collect()}
    assert got == {i: None if i == 5 else 2.0 * i for i in range(12)}


def test_masked_mean(spark):
    rows = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0]), ([[1.0, 2.0]], [0])], "s array<array<double>>, m array<int>")
    assert [r.v for r in rows.select(providers.masked_mean(F.col("s"), F.col("m")).alias("v")).collect()] == [[2.0, 3.0], [0.0, 0.0]]


def test_providers_fall_back(spark):
    def first():
        def model(part):
            if (part["x"] % 3 == 0).any():
                raise MemoryError
            return (part["x"] * 2.0).tolist()

        return model

    def second():
        def model(part):
            if (part["x"] == 6).any():
                raise ValueError
            return [-1.0] * len(part)

        return model

    rows = spark.createDataFrame([(i, ["p"] if i % 2 else None) for i in range(10)], "x long, image_paths array<string>")
    got = {r.x: r.y for r in providers.with_provider(rows, "y", "double", first, 4, (second,), 0.0).collect()}
    assert got == {i: 0.0 if i == 6 else -1.0 if i % 3 == 0 else 2.0 * i for i in range(10)}
    got = {r.x: r.y for r in providers.by_image(rows, "y", "double", first, second, 0.0).collect()}
    assert got == {i: (-1.0 if i % 3 == 0 else 2.0 * i) if i % 2 else (0.0 if i == 6 else -1.0) for i in range(10)}
    assert {r.y for r in providers.with_provider(rows, "y", "double", first, 4, default=7.0, seconds=-1.0).collect()} == {7.0}


def test_each_category_its_way(spark):
    bank = rules.Bank()
    assert training.config_of(bank.flammable, bank) == training.RICH and training.config_of(bank.supplement, bank) == training.BASIC
    rows = [(i, f"товар {i}", ("зажигалка с газом " if i % 4 == 0 else "чехол для телефона ") + f"вариант {i}", bank.flammable, int(i % 4 == 0)) for i in range(48)]
    cards = pipeline.prepared(spark.createDataFrame(rows, "id long, name string, description string, category string, label int"))
    families = spark.createDataFrame([], "id long, family long")
    made = training.train_category(cards, families, bank.flammable, grid=(1.0,), seeds=(1,), slots=256)
    assert made.f1 > 0.95 and len(made.head.weights) == 256 + 38
    space = training.search_space(True, n=5)
    assert space == training.search_space(True, n=5) and all(c.rich and c.chars[0] < c.chars[1] and 0.5 <= c.rule_weight <= 8 for c in space)
    few = [training.BASIC, replace(training.BASIC, words=1, structure=True)]
    f1, best = training.tune_category(cards, families, bank.flammable, few, seeds=(1,), slots=64)
    assert f1 > 0.9 and best in few


def test_regularised_bias_and_dense_head(spark):
    rows = spark.createDataFrame([([float(i % 5), 1.0 if i % 2 else -1.0], i % 2) for i in range(60)], "embedding array<double>, label int")
    head = linear.dense_head(rows)
    got = linear.score(rows.select("label", linear.dense_vector(F.col("embedding")).alias("features")), head).collect()
    assert all(r.pred == r.label for r in got)
    # Plain gradient descent on the same loss, the bias a weight of its own that is regularised too.
    import numpy as np

    x = np.array([[float(i % 5), 1.0 if i % 2 else -1.0, 1.0] for i in range(60)])
    y, c, w = np.array([i % 2 for i in range(60)]), 0.05, np.zeros(3)
    weight = np.where(y == 1, linear.RARE_WEIGHT, 1.0)
    for _ in range(20000):
        p = 1 / (1 + np.exp(-x @ w))
        w -= 0.05 * (x.T @ (weight * (p - y)) + w / c) / weight.sum()
    made = linear.train(rows.select("label", linear.dense_vector(F.col("embedding")).alias("features")), c, balanced=False, regular_bias=True)
    # rows that repeat are turned together, so the fixture has ten kinds of rows
    assert np.allclose([*made.weights, made.bias], w, atol=2e-3)
    prob = linear.score(rows.select("embedding", linear.dense_vector(F.col("embedding")).alias("features")), made).collect()
    assert all(abs(r.prob - 1 / (1 + np.exp(-(np.dot(r.embedding, w[:2]) + w[2])))) < 2e-3 for r in prob)


def test_dense_heads_over_a_grid(spark):
    rows = spark.createDataFrame([(i, i % 2, i // 3, [float(i % 2) + 0.1 * (i % 7), 1.0, float(i % 5)]) for i in range(60)], "id long, label int, g long, embedding array<float>")
    made, unit, k = training.train_dense(rows, grid=(3.0,), units=(True, False), components=(None, 2))
    assert made.f1 > 0.7 and len(made.head.weights) == (k or 3) and unit in (True, False)
