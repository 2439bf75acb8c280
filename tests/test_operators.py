import json

import pytest
from pyspark.sql import functions as F

from slabwise.operators import evaluate as E
from slabwise.operators import preference as P
from slabwise.operators import records as R
from slabwise.operators import volume as V

CASE = "id int, candidates array<struct<text:string,score:double>>"


def test_pairwise_shapes_agree(spark):
    rows = [(1, [("a", 0.5), ("b", 0.9), ("c", 0.9), ("d", None)]), (2, [("x", 0.3)]), (3, []), (4, [("p", 0.55), ("q", 0.5)]), (5, None)]
    df = spark.createDataFrame(rows, CASE)
    nested = {(r["id"], r["chosen"], r["rejected"]) for r in P.pairwise_nested(df, "candidates").collect()}
    assert nested == {(1, "b", "a"), (1, "b", "d")} | ({(4, "p", "q")} if 0.55 > 0.5 + 0.05 else set())
    flat = df.select("id", F.posexplode("candidates").alias("pos", "c")).select("id", "pos", F.col("c.score").alias("score"))
    got = {(r["id"], r["best"], r["worse"]) for r in P.pairwise_flat(flat, "id", "pos", "score").collect()}
    assert got == {(1, 1, 0), (1, 1, 3)} | ({(4, 0, 1)} if 0.55 > 0.5 + 0.05 else set())


def test_groups(spark):
    df = spark.createDataFrame([(1, [("a", 0.5), ("b", 0.9), ("c", 0.9)]), (2, []), (3, None)], CASE)
    got = {r["id"]: [c["response"] for c in r["candidates"]] for r in P.group_nested(df, "candidates", 2).collect()}
    assert got == {1: ["b", "c"], 2: [], 3: []}
    assert {r["id"]: r["t"] for r in df.select("id", P.best_response("candidates").alias("t")).collect()} == {1: "b", 2: "", 3: ""}
    with pytest.raises(ValueError):
        P.group_nested(df, "candidates", -1)


def test_top_k_flat(spark):
    rows = [("a", i, 1.0 if i % 2 else 0.5) for i in range(50)] + [("b", 1, None)]
    df = spark.createDataFrame(rows, "k string, o int, s double")
    got = {(r["k"], r["item"], r["rank"]) for r in P.top_k_flat(df, "k", "o", "s", 3).collect()}
    assert got == {("a", 1, 1), ("a", 3, 2), ("a", 5, 3), ("b", 1, 1)}
    assert P.top_k_flat(df.limit(0), "k", "o", "s", 3).count() == 0


def test_small_rules(spark):
    assert P.formats(["binary", "x", " pairwise"]) == ["binary", "pairwise"]
    with pytest.raises(ValueError):
        P.formats(["x"])
    df = spark.createDataFrame([("k", "a", 1), ("k", "b", 2), (None, "c", 3)], "k string, v string, o int")
    assert [tuple(r) for r in P.last_by(df, "k", "v", "o").collect()] == [("k", "b")]
    assert spark.range(1).select(P.length_reward(F.lit("x" * 300))).first()[0] == 1.0


def test_aggregate_and_running_mean(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, 2.0)], "a double, b double")
    got = {r["metric"]: tuple(r)[1:] for r in E.aggregate(df, ["a", "b"]).collect()}
    assert got == {"a": (2.0, 1.0, 1.0, 3.0, 2.0), "b": (2.0, 0.0, 2.0, 2.0, 2.0)}
    assert E.aggregate(df.limit(0), ["a", "b"]).count() == 0
    m = E.running_mean(spark.createDataFrame([(1, 1, 2.0, 1), (1, 2, 4.0, 3)], "k int, t int, v double, w int"), "k", ["t"], "v", "w")
    assert [r["avg"] for r in m.orderBy("t").collect()] == [2.0, 3.5]


def test_missing_predictions_count_as_empty(spark):
    t = spark.createDataFrame([(1, "a", "the ref text"), (2, "b", "x"), (3, None, None)], "id int, case string, ref string")
    p = spark.createDataFrame([("a", "old", 1), ("a", "the ref text", 2)], "case string, text string, o int")
    j = E.join_predictions(t, "case", p, "text", "o")
    assert {r["id"]: r["prediction"] for r in j.collect()} == {1: "the ref text", 2: "", 3: ""}
    m = {r["id"]: r for r in E.flat_metrics(j, "id", "prediction", "ref").collect()}
    assert m[1]["rouge_l"] == 1.0 and m[2]["rouge_l"] == 0.0 and m[3]["bleu"] == 0.0


def test_conversations(spark):
    df = spark.createDataFrame([("p", ["1", "2", "3", "4", "5"], "r"), ("p", None, None)], "p string, i array<string>, r string")
    c = [r[0] for r in df.select(R.conversation("p", "i", "r")).collect()]
    assert [x["type"] for x in c[0][0]["content"]] == ["image"] * 4 + ["text"] and c[0][1]["role"] == "assistant"
    assert [x["type"] for x in c[1][0]["content"]] == ["text"]
    texts = ["a <|im_start|>assistant\n b ", "q Assistant: r", "x <|im_start|>assistant y", "plain", "aASSISTANT:b"]
    got = [tuple(r[0]) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(R.split_conversation("t")).collect()]
    assert got == [("a <|im_start|>", "b"), ("q", "r"), ("x", "y"), ("plain", ""), ("aASSISTANT:b", "")]


def test_label_mask(spark):
    df = spark.createDataFrame([([0, 5, 6, 7, 8], [0, 1, 1, 1, 1], 2, True), ([5, 6, 7, 0, 0], [1, 1, 1, 0, 0], 2, False), ([5, 6], [1, 1], 9, False)], "i array<int>, a array<int>, p int, l boolean")
    assert [r[0] for r in df.select(R.label_mask("i", "a", "p", "l")).collect()] == [[-100, -100, -100, 7, 8], [-100, -100, 7, -100, -100], [-100, -100]]
    m = spark.createDataFrame([("abc", "abc<image>", " abc "), ("x", "x", "y"), ("", "", "y")], "s string, r string, e string").select(R.mask_report("s", "r", "e").alias("m")).select("m.*").collect()
    assert [tuple(x) for x in m] == [(True, True, False), (False, False, False), (True, False, True)]


def test_record_helpers(spark):
    row = spark.range(1).select(
        R.data_uri(F.lit("x").cast("binary"), F.lit("a.JPG")), R.data_uri(F.lit("x").cast("binary"), F.lit("a.d/b")), R.data_uri(F.lit(None).cast("binary"), F.lit("a.png")), R.number_list(F.lit("1, 2,,3")),
        R.reporters(F.lit(" a, ,b")), R.reporters(F.lit("None")), R.gib(F.lit(3 * 1024**3)), R.unknown_settings(F.lit('{"data": {"y": 1}, "x": 1}')), R.config(F.lit('{"data": {"max_seq_length": 5}, "training": {"report_to": ["a"]}}'), {"generation.top_k": 9}),
    ).first()
    assert tuple(row)[:8] == ("data:image/jpeg;base64,eA==", "data:image/png;base64,eA==", None, [1, 2, 3], ["a", "b"], [], "3.00 GiB", ["data.y", "x"])
    c = row[8]
    assert c["data"]["max_seq_length"] == 5 and c["generation"]["top_k"] == 9 and c["training"]["seed"] == 42 and c["training"]["report_to"] == ["a"] and c["evaluation"]["llm_judge_model"] is None
    echo = json.loads(spark.range(1).select(R.config_json(F.lit("{}"))).first()[0])
    assert set(echo) == set(R.CONFIG) and echo["model"]["use_qlora"] is True and echo["distributed"]["fsdp"] == []
    assert spark.range(1).select(R.load_config(F.lit("{}"))).first()[0]["lora"]["r"] == 64
    with pytest.raises(Exception, match="unknown settings: data.y"):
        spark.range(1).select(R.load_config(F.lit('{"data": {"y": 1}}'))).collect()
    with pytest.raises(ValueError):
        R.config(F.lit("{}"), {"data.y": 1})
    for bad, kind in ((" , ", "int"), ("1,,2", "double")):
        with pytest.raises(Exception):
            spark.range(1).select(R.number_list(F.lit(bad), kind)).collect()


def test_volume(spark):
    vox = [("p", y, x, z, 100.0 * (y + x + z) - 150.0) for y in range(3) for x in range(2) for z in range(5)]
    v = spark.createDataFrame(vox, "patient string, y int, x int, z int, hu double")
    assert [r["e"] for r in spark.range(1).select(V.slab_edges(F.lit(5), 2).alias("e")).collect()] == [[0, 2, 5]]
    assert spark.range(1).select(V.slab_edges(F.lit(2), 9)).first()[0] == [0, 1, 2]
    mip = {(r["slab_index"], r["row"], r["col"]): r["hu"] for r in V.project(v, 2).filter("view = 'axial'").collect()}
    assert mip[(0, 0, 0)] == -50.0 and mip[(1, 2, 1)] == 550.0 and len(mip) == 12
    top = V.project_global(v).groupBy("view").agg(F.max("hu").alias("m"), F.count("*").alias("n")).collect()
    assert {(r["view"], r["m"], r["n"]) for r in top} == {("global_axial", 550.0, 6), ("global_coronal", 550.0, 10), ("global_sagittal", 550.0, 15)}
    box = V.crop_box(v, threshold=10_000.0).first()
    assert tuple(box)[1:] == (0, 2, 0, 1, 0, 4)
    assert tuple(V.crop_box(v, (1.0, 1.0, 1.0), 500.0, 1.0).first())[1:] == (1, 2, 0, 1, 3, 4)
    assert tuple(V.trim_range(v, 0.0, 0.6).first())[1:] == (1, 4)
    px = spark.range(1).select(V.to_pixel(F.lit(435.0), *V.window_bounds()), V.to_pixel(F.lit(-2000.0), *V.window_bounds())).first()
    assert tuple(px) == (254, 0)
    f = [spark.range(1).select(V.hu_filter(F.lit(x).cast("float"), m)).first()[0] for x in (10.0, 500.0) for m in ("none", "low", "clip", "low_clip", "bandpass")]
    assert f == [10.0, -1000.0, 10.0, -1000.0, -1000.0, 500.0, 500.0, 420.0, 420.0, -1000.0]


def test_percentiles_without_foreground(spark):
    v = spark.createDataFrame([("p", 0, 0, 0, -500.0), ("q", 0, 0, 0, 5.0)], "patient string, y int, x int, z int, hu double")
    assert {tuple(r) for r in V.percentiles(v).collect()} == {("p", 0.0, 1.0), ("q", 5.0, 6.0)}


def test_reorient_and_sweep(spark):
    v = spark.createDataFrame([("p", 0, 1, 2, 5.0), ("p", 1, 0, 0, 7.0)], "patient string, y int, x int, z int, hu double")
    assert {tuple(r)[1:] for r in V.reorient(v, "zyx", "y").collect()} == {(0, 0, 1, 5.0), (2, 1, 0, 7.0)}
    with pytest.raises(ValueError):
        V.reorient(v, "yyx")
    p = spark.createDataFrame([("b",), ("a",), ("a",), ("c",)], "patient string")
    done = spark.createDataFrame([("a", 2)], "patient string, k int")
    assert {tuple(r) for r in V.sweep(p, [1, 2], done, ["a,c", "b"], 2).collect()} == {("a", 1), ("b", 1), ("b", 2)}
    assert V.pipeline(v.limit(0), 2).count() == 0
    assert spark.range(1).select(V.command("s", F.lit("i"), F.lit("o"), F.lit(3), {"a": 1, "b": 0, "c": True})).first()[0] == "s --nrrd_path i --out_root o --slabs_per_axis 3 --a 1 --c"


def test_report(spark):
    import json

    a = E.aggregate(spark.createDataFrame([(1.0, 2.0)], "a double, b double"), ["a", "b"])
    r = json.loads(E.report(a, {"model": "m"}).first()["report"])
    assert r["config"] == {"model": "m"} and r["aggregated_metrics"]["a"]["mean"] == 1.0
    assert sorted(x["line"] for x in E.summary(a).collect()) == ["a                   : mean=1.0000, std=0.0000", "b                   : mean=2.0000, std=0.0000"]


def test_candidates_are_scored_against_the_reference(spark, tmp_path):
    from slabwise.plans import queries as Q

    labels = '{"anomaly_present": true, "vessel": "MCA", "side": "left"}'
    reference = "Vascular: left MCA occlusion is seen . Impression: acute stroke"
    refs = [(1, "a", "an older one", None), (2, "a", reference, labels), (3, "b", reference, None), (4, "c", "", labels), (5, "d", None, labels)]
    texts = ["left MCA occlusion", "Impression: no occlusion of the right MCA", "acute  STROKE is seen", ""]
    cands = [(10 * i + j, c, t) for i, c in enumerate(["a", "b", "c", "d", "e"]) for j, t in enumerate(texts)]
    spark.createDataFrame(refs, "rec_id long, case_id string, response string, labels string").write.parquet(f"{tmp_path}/ctamip_dataset.parquet")
    spark.createDataFrame(cands + cands[:3], "cand_id long, case_id string, text string").write.parquet(f"{tmp_path}/candidates.parquet")
    part = {r["cand_id"]: r for r in Q.score_candidates(spark, str(tmp_path)).collect()}
    got = {r["cand_id"]: r for r in Q.score_candidates_whole(spark, str(tmp_path)).collect()}

    def lcs(a, b):
        if not a or not b:
            return 0
        return lcs(a[:-1], b[:-1]) + 1 if a[-1] == b[-1] else max(lcs(a[:-1], b), lcs(a, b[:-1]))

    assert len(got) == len(cands)
    for i, c, t in cands:
        want, w = part[i]["score"], 0.6 if part[i]["available"] else 0.1
        if c in "ab":
            r, h = reference.lower().split(), t.lower().split()
            want = (want * w + 0.1 * lcs(r, h) / len(r)) / (w + 0.1)
        assert got[i]["available"] == part[i]["available"] and got[i]["score"] == pytest.approx(want, abs=2e-6)
    assert got[0]["score"] != part[0]["score"]
