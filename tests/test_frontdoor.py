"""Scoring front door, judge answers, generation contracts, manifests, orientation: shapes and edge cases."""

import json
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from slabwise.functions import scoring as S
from slabwise.operators import generation as G
from slabwise.operators import scored as SC
from slabwise.operators import volume as V
from slabwise.sources import records as IO
from slabwise.sources.nrrd import axes_of, orientation, oriented

RECORD = "case_id string, images array<string>, prompt string, labels string, candidates array<struct<text:string,temperature:double,index:int>>, score int, _c int"
GOOD = "Vascular summary: the left M1 segment is occluded. Impression: occlusion of the left M1."


def records(spark):
    rows = [
        ("a", ["i.png"], "p", '{"anomaly": true}', [(GOOD, 0.7, 0), ("", 1.0, 1), (None, None, 2)], 1, 2), ("b", None, "p", None, [("Normal.", 0.2, 0)], 1, 2), (None, [], None, None, [(GOOD, 0.7, 0)], 1, 2), ("e", ["x"], "p", "{}", [], 1, 2), ("n", ["x"], "p", "{}", None, 1, 2),
    ]
    return spark.createDataFrame(rows, RECORD)


def test_nested_scores(spark):
    refs = spark.createDataFrame([("a", GOOD), ("b", "")], "case_id string, reference string")
    answers = records(spark).select("case_id", F.explode("candidates.text").alias("t")).select(S.cache_key("case_id", "t").alias("cache_key"), F.lit('{"overall": 1, "correctness": 1, "grounding": 1, "laterality": 1, "calibration": 1}').alias("raw"), F.lit(1).alias("at")).dropna()
    got = {r["case_id"]: r for r in SC.score_nested(records(spark), refs, "composite", answers).collect()}
    assert set(got) == {"a", "b", None, "e", "n"} and got["e"]["candidates"] == [] == got["n"]["candidates"]
    a = got["a"]["candidates"]
    assert [c["text"] for c in a] == [GOOD, "", None] and [c["metadata"]["index"] for c in a] == [0, 1, 2] and a[0]["metadata"]["temperature"] == 0.7
    assert {"judge", "structure", "similarity"} <= set(a[0]["score_detail"]["components"]) and a[0]["score_detail"]["components"]["similarity"] == 1.0
    assert set(got["b"]["candidates"][0]["score_detail"]["components"]) == {"structure"}  # no images, an empty reference
    assert all(0 <= c["score"] <= 1 for r in got.values() for c in r["candidates"])
    assert "judge" not in SC.score_nested(records(spark), refs).filter("case_id = 'a'").first()["candidates"][0]["score_detail"]["weights_used"]
    assert SC.score_nested(records(spark).limit(0), refs).count() == 0
    rand = [[c["score"] for r in sorted(SC.score_nested(records(spark).coalesce(1), None, "random", seed=3).collect(), key=str) for c in r["candidates"]] for _ in range(2)]
    assert rand[0] == rand[1] and all(0 <= x < 1 for x in rand[0])
    with pytest.raises(ValueError):
        SC.score_nested(records(spark), None, "other")


def test_judge_abstains_without_readable_images(spark):
    df = spark.createDataFrame([("a", "t", ["x", "y"]), ("a", "t", ["z"]), ("b", "t", None), ("c", "u", ["y"])], "case string, text string, images array<string>")
    answers = spark.createDataFrame([("a", "t", "no object", 1), ("a", "t", '{"overall": 1}', 2), ("b", "t", '{"overall": 1}', 1)], "case string, text string, raw string, at int").select(S.cache_key("case", "text").alias("cache_key"), "raw", "at")
    got = sorted((r["case"], str(r["images"]), r["judge"]["available"]) for r in SC.judge_answers(df, "case", "text", "images", answers).collect())
    assert got == [("a", "['x', 'y']", True), ("a", "['z']", True), ("b", "None", False), ("c", "['y']", False)]
    files = spark.createDataFrame([("x",)], "path string")
    got = {r["case"]: r["judge"]["available"] for r in SC.judge_answers(df.limit(1), "case", "text", "images", answers, files).collect()}
    assert got == {"a": True}
    assert not any(r["judge"]["available"] for r in SC.judge_answers(df, "case", "text", "images", None).collect())
    assert SC.judge_settings({"LLM_JUDGE_MODEL": "m", "OPENAI_API_KEY": "k"})["configured"] and not SC.judge_settings({}, model="m")["configured"]


def test_record_files(spark, tmp_path):
    scored = SC.score_nested(records(spark), None, "rule_based")
    assert SC.write_preferences(scored, str(tmp_path), ["group", "binary", "what"]) == ["group", "binary", "scored_candidates"]
    assert IO.read_jsonl(spark, f"{tmp_path}/binary", "binary").count() == 5 and IO.read_jsonl(spark, f"{tmp_path}/group", "group").count() == 5
    line = json.loads(next(x for f in (tmp_path / "scored_candidates").glob("*.json") for x in f.read_text().splitlines() if '"a"' in x))
    assert line["reference"] is None and line["candidates"][0]["score_detail"] is None and line["candidates"][0]["metadata"]["index"] == 0
    with pytest.raises(ValueError):
        SC.write_preferences(scored, str(tmp_path / "x"), ["what"])


def test_generation_contracts(spark):
    df = spark.createDataFrame([("a", ["1", "2", "3", "4", "5"], "p", None, "ref"), ("b", None, None, "{}", "")], "case_id string, images array<string>, prompt string, labels string, response string")
    assert [(r["case_id"], len(r["images"]), r["labels"]) for r in G.inference_rows(df).collect()] == [("a", 4, "{}"), ("b", 0, "{}")]
    asked = G.requests(df, [0.1, 0.2, 0.3], 2)
    assert sorted((r["case_id"], r["index"], r["temperature"]) for r in asked.collect()) == [("a", 0, 0.1), ("a", 1, 0.2), ("b", 0, 0.1), ("b", 1, 0.2)]
    assert G.requests(df, [0.1], 4).count() == 2 and G.requests(df, [], 4).count() == 0
    c = {r["case_id"]: r["candidates"] for r in G.collected(asked.withColumn("text", F.lit(" x\n")), ["case_id"], "response").collect()}
    assert [x["text"] for x in c["a"]] == ["x", "x", "ref"] and c["a"][2]["is_reference"] and c["a"][2]["index"] == 2 and len(c["b"]) == 2
    assert G.predictions(asked.withColumn("text", F.lit(None).cast("string"))).first()["prediction"] == ""
    b = df.withColumn("batch", F.lit(1)).withColumn("chosen", F.lit("c")).withColumn("rejected", F.lit(None).cast("string"))
    r = G.collate(b, "batch", "case_id", "pairwise").first()
    assert r["images"] == ["1", "2", "3", "4"] and r["chosen"][0] == "user:\n<image><image><image><image>p\nassistant:\nc\n" and r["rejected"][1] == "user:\n\nassistant:\n\n"
    r = G.collate(b, "batch", "case_id", "inference").first()
    assert r["case_ids"] == ["a", "b"] and r["texts"][1].endswith("assistant:\n")
    t = G.trainer_pairs(b, "/r").collect()
    assert t[0]["images"] == ["/r/1", "/r/2", "/r/3", "/r/4"] and t[0]["prompt"] == "p" and t[1]["images"] == []
    with pytest.raises(ValueError):
        G.collate(b, "batch", "case_id", "other")


def test_images_and_folders(spark):
    df = spark.createDataFrame([(1, ["a", None, "b"]), (2, None)], "id int, images array<string>")
    files = spark.createDataFrame([("a", bytearray(b"x"))], "path string, content binary")
    got = {r["path"]: (bytes(r["content"])[:4], r["placeholder"]) for r in IO.load_images(df, "id", "images", files).collect()}
    assert got == {"a": (b"x", False), "b": (b"\x89PNG", True)}
    assert IO.stamped("/o/", "run", datetime(2024, 1, 2, 3, 4, 5)) == "/o/run_20240102_030405"
    assert tuple(spark.range(1).select(SC.side_mentions(F.lit("Left leftward RIGHT")).alias("m")).first()["m"]) == (2, 1)


def test_sweep_and_manifests(spark, tmp_path):
    grid = spark.createDataFrame([("p", 2), ("q", 2)], "patient string, k int")
    plan = V.sweep_plan(grid, spark.createDataFrame([("p", "p.nrrd")], "patient string, file string"), dry_run=True)
    assert {r["patient"]: r["status"] for r in plan.collect()} == {"p": "dry_run", "q": "missing"}
    assert tuple(V.outcome(plan).first()) == (2, 1, 1) and tuple(V.outcome(plan.filter("patient = 'p'")).first()) == (1, 0, 0) and tuple(V.outcome(plan.limit(0)).first()) == (0, 0, 0)
    shape = spark.createDataFrame([("p", 4, 4, 4), ("q", 4, 4, 4)], "patient string, h int, w int, n int")
    m = V.patient_manifest(V.slabs(shape, 2), V.image_budget(2, True), spark.createDataFrame([("p", "RAS")], "patient string, original string"))
    r = {x["patient"]: x for x in V.rollup(m).collect()}
    assert r["p"]["n_patients"] == 2 and len(r["p"]["images"]) == 9 and r["p"]["orientation_original"] == "RAS" and r["q"]["orientation_original"] is None
    assert r["p"]["images"][0].startswith("p/") and {c["extent_mm"] is None for c in r["p"]["coverage"] if c["view"].startswith("global")} == {True}
    V.write_patient_manifests(m, str(tmp_path / "m"))
    text = "".join(f.read_text() for f in (tmp_path / "m").glob("patient=p/*.json"))
    assert json.loads(text)["protocol"] == {"image_budget": 9}


def test_pixels(spark):
    p = spark.createDataFrame([("p", v, 0, 0, c, 100.0 * c) for v in ("axial", "sagittal") for c in range(3)], "patient string, view string, slab_index int, row int, col int, hu double")
    got = {(r["view"], r["col"]): r["value"] for r in V.pixels(p, "per_image", low=0.0, high=1.0, flip=True).collect()}
    assert got[("axial", 0)] == 254 and got[("axial", 2)] == 0 and got[("sagittal", 0)] == 0 and got[("sagittal", 2)] == 254
    assert V.pixels(p, "per_volume", spark.createDataFrame([("p", 0.0, 100.0)], "patient string, lo double, hi double")).agg(F.max("value")).first()[0] == 254
    for norm in ("per_volume", "other"):
        with pytest.raises(ValueError):
            V.pixels(p, norm)


def test_orientation():
    lps = {"space": "left-posterior-superior", "space directions": "(0.5,0,0) (0,0.5,0) (0,0,1)"}
    ras = {"space": "RAS", "space directions": "(0.5,0,0) (0,0.5,0) (0,0,1)"}
    turned = {"space": "left-posterior-superior", "space directions": "(0,0,1) (-0.5,0.1,0) (0,0.5,0)"}
    v = np.arange(24).reshape(4, 3, 2)
    assert (oriented(v, lps) == v).all() and (oriented(v, {}) == v).all() and orientation(lps) == "LPS" and orientation(ras) == "RAS"
    assert (oriented(v, ras) == v[:, ::-1, ::-1]).all()
    assert axes_of(turned) == [(2, 1), (0, -1), (1, 1)] and orientation(turned) == "SRP"
    w = oriented(v, turned)  # file axes: z, -x, y
    assert w.shape == (2, 4, 3) and w[1, 2, 0] == v[2, 2, 1]
