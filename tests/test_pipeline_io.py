"""Sources, sinks, the layered pipeline and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import explain, transfer
from shelfmark.plans import pipeline
from shelfmark.sources import cards as src
from shelfmark.streaming import inference


def test_csv_round_trip(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('Unnamed: 0,id,name,description,extra\n0,7.0,"Спички ""Гост""","a\nb",x\n1,8,,,y\n', encoding="utf-8")
    cards = src.read_cards(spark, str(path)).orderBy("pos")
    rows = cards.collect()
    assert [(r.id, r.pos, r.category, r.description) for r in rows] == [("7", 1, "", "a\nb"), ("8", 2, "", "")] and rows[0].name == 'Спички "Гост"'
    src.write_results(pipeline.fallback_results(cards), str(tmp_path / "out"))
    back = src.read_results(spark, str(tmp_path / "out"))
    assert explain.contract(cards, back).first().ok


def test_no_id_fails(spark, tmp_path):
    (tmp_path / "x.csv").write_text("name\na\n")
    with pytest.raises(ValueError):
        src.read_cards(spark, str(tmp_path / "x.csv"))


def test_images(spark, tmp_path):
    for name in ("1/b.JPG", "1/a.png", "2/x.txt", "3/c.webp"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    lists = src.image_lists(spark, str(tmp_path))
    got = {r.id: (r.n_images, [p.rsplit("/", 1)[1] for p in r.image_paths]) for r in src.with_images(spark.createDataFrame([("1",), ("2",), ("3",)], "id string"), lists).collect()}
    assert got == {"1": (2, ["a.png", "b.JPG"]), "2": (0, []), "3": (1, ["c.webp"])}
    assert src.content_hashes(spark, str(tmp_path)).count() == 3


def test_pack_and_scores(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text(json.dumps({"id": "1", "name": "a b", "label": 1}, ensure_ascii=False) + "\n\n" + json.dumps({"id": "2"}) + "\n", encoding="utf-8")
    rows = src.read_pack(spark, str(tmp_path / "p.jsonl"), spark.createDataFrame([(1, 5)], "id long, family long")).orderBy("id").collect()
    assert [(r.id, r.name, r.family) for r in rows] == [("1", "a b", 5), ("2", None, -1)]
    for f, p in (("oof_fold0.csv", 0.1), ("oof_fold1.csv", 0.9)):
        (tmp_path / f).write_text(f"id,prob\n1,{p}\n")
    assert src.read_fold_scores(spark, str(tmp_path / "oof_fold*.csv")).first().prob == 0.9


def test_artifacts(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"format_version": 1, "categories": {"БАД": {"prior": 0.7, "brands": {"abc": [5, 4]}}}}))
    brands, priors = src.brand_tables(spark, src.read_artifact(spark, str(tmp_path / "b.json"), "brand"))
    cards = spark.createDataFrame([(1, "БАД", "abc x"), (2, "БАД", "zz"), (3, "y", "abc")], "id long, category string, name_n string")
    got = {r.id: round(r.brand_prob, 6) for r in transfer.with_brand_prob(cards, brands, priors).collect()}
    assert got == {1: round((4 + 3 * 0.7) / 8, 6), 2: 0.7, 3: 0.5}
    with pytest.raises(ValueError):
        src.read_artifact(spark, str(tmp_path / "b.json"), "template")
    assert src.blend_config(spark, str(tmp_path / "missing.json")) == {}


CARD = "id long, pos long, name string, description string, category string, text_prob double, vlm_prob double"


def test_layers_in_order(spark):
    fire = "Легковоспламеняющиеся"
    rows = pipeline.prepared(spark.createDataFrame([(1, 1, "Горелка", "баллон не входит", fire, 0.9, None), (2, 2, "x", "y", fire, 0.4, 0.9), (3, 3, "x", "y", "other", 0.6, 0.1), (4, 4, "x", "y", fire, 0.6, None)], CARD))
    blend = src.blend_table(spark, {"weights": {fire: 0.5}, "thresholds": {fire: 0.5}})
    images = spark.createDataFrame([(4, 0, "dhash_name_negative")], "id long, image_decision int, image_reason string")
    got = {r.id: (r.pred, r.reason) for r in pipeline.decide(rows, tables=pipeline.Tables(blend=blend, images=images)).collect()}
    assert got == {1: (0, "veto"), 2: (1, "blend"), 3: (1, "text_model"), 4: (0, "dhash_name_negative")}


def test_stream_gives_what_a_batch_gives(spark, tmp_path):
    rows = spark.createDataFrame([(i, i, f"Зажигалка {i}", "газ в комплекте", "Легковоспламеняющиеся", i / 10, None) for i in range(10)], CARD)
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    q = inference.start(inference.card_stream(spark, str(tmp_path / "in"), CARD, 1), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    want = inference.decided(rows).select("id", "prob", "pred", "reason", "result")
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.select(F.min(explain.result_is_valid(F.col("result")))).first()[0]


def test_positions_run_on_over_files(spark, tmp_path):
    for name, ids in (("a.csv", (5, 3)), ("b.csv", (9, 1, 2))):
        (tmp_path / name).write_text("id,name\n" + "".join(f"{i},n\n" for i in ids))
    rows = src.read_cards(spark, str(tmp_path / "*.csv"))
    assert [(r.pos, r.id) for r in rows.orderBy("pos").collect()] == [(1, "5"), (2, "3"), (3, "9"), (4, "1"), (5, "2")]
    back = rows.withColumn("id", F.when(F.col("pos") == 4, "7").otherwise(F.col("id"))).where("pos <> 2")
    assert sorted((r.pos, r.expected_id, r.id) for r in explain.moved(rows, back).collect()) == [(2, "3", None), (4, "1", "7")]
    assert explain.moved(rows, rows).count() == 0


def test_artifact_tables(spark, tmp_path):
    keys = spark.createDataFrame([("c", "desc", "k", 3, 2)], "category string, kind string, key string, n long, pos long")
    src.save_tables({"keys": keys}, str(tmp_path / "t"), "template")
    assert src.load_tables(spark, str(tmp_path / "t"), "template")["keys"].collect() == keys.collect()
    with pytest.raises(ValueError):
        src.load_tables(spark, str(tmp_path / "t"), "brand")
    with pytest.raises(ValueError):
        src.save_tables({"keys": keys.drop("n")}, str(tmp_path / "u"), "template")
    gates = spark.createDataFrame([("c", 0.98, 5, 1)], "category string, cos_thr double, k int, min_agree int")
    vectors = spark.createDataFrame([(1, "c", [1.0, 0.0], 1)], "id long, category string, vector array<double>, label int")
    src.save_tables({"vectors": vectors, "gates": gates}, str(tmp_path / "k"), "knn")
    assert src.load_tables(spark, str(tmp_path / "k"), "knn")["gates"].first().k == 5
    (tmp_path / "t.json").write_text(json.dumps({"format_version": 2, "categories": {"c": {"desc": {"k": [3, 2]}, "name": {}}}}))
    assert [tuple(r) for r in src.template_table(spark, src.read_artifact(spark, str(tmp_path / "t.json"), "template")).collect()] == [("c", "desc", "k", 3, 2)]
    (tmp_path / "bad.json").write_text("{not json")
    assert src.blend_config(spark, str(tmp_path / "bad.json")) == {}


def test_what_is_left_to_transcribe(spark, tmp_path):
    rows = [(1, "1", "a", "без маркировки", "БАД", 1), (2, "2", "a", "это БАД к пище", "БАД", 1), (3, "3", "a", "<b>Dietary  supplement</b>", "БАД", 1), (4, "4", "a", "абад", "БАД", 1), (5, "5", "a", "x", "БАД", 0), (6, "6", "a", "x", "y", 1)]
    cards = spark.createDataFrame(rows, "pos long, id string, name string, description string, category string, label int")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(src.to_transcribe(cards, unmarked_of="БАД")) == ["1", "4"]
    assert ids(src.to_transcribe(cards, ["y"])) == ["6"] and ids(src.to_transcribe(cards, limit=2)) == ["1", "2"]
    some = cards.where("id in ('2', '5')")
    assert ids(src.to_transcribe(cards, ids=some)) == ["2", "5"]
    out, inside = src.disjoint_split(cards, some)
    assert ids(out) == ["1", "3", "4", "6"] and ids(inside) == ["2", "5"]
    src.append_results(some.select("id"), str(tmp_path / "done"))
    src.append_results(cards.where("id = '6'").select("id"), str(tmp_path / "done"))
    assert ids(src.not_done(cards, spark.read.parquet(str(tmp_path / "done")))) == ["1", "3", "4"]


def test_largest_images(spark):
    row = spark.createDataFrame([([("a", 2, 2), ("b", 9, 9), ("c", None, 3), ("d", 3, 3), ("e", 9, 9), ("f", 1, 1), ("g", 99, 99)],)], "x array<struct<path:string,width:int,height:int>>")
    assert row.select(src.largest_images(F.col("x")).alias("y")).first().y == ["b", "e"]
    assert spark.createDataFrame([(["p", "q"],), ([],)], "x array<string>").select(src.main_image(F.col("x")).alias("y")).collect() == [("p",), (None,)]
