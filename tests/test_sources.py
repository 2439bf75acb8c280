import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from slabwise.sources import records as IO
from slabwise.sources.nrrd import NrrdSource, parse
from slabwise.streaming import scoring as ST


def test_jsonl_round_trip(spark, tmp_path):
    p = tmp_path / "c.jsonl"
    p.write_text('{"case_id": "a", "prompt": "p", "response": "r", "labels": {"anomaly": true}}\n\n   \n{"case_id": "b", "images": ["x"]}\n')
    got = {r["case_id"]: r for r in IO.read_jsonl(spark, str(p), "cases").collect()}
    assert got["a"]["labels"].replace(" ", "") == '{"anomaly":true}' and got["b"]["labels"] == "{}" and got["b"]["images"] == ["x"]
    IO.write_jsonl(spark.createDataFrame([("a", None)], "case_id string, reference string"), str(tmp_path / "out"))
    assert '"reference":null' in "".join(f.read_text() for f in (tmp_path / "out").glob("*.json"))


def test_malformed_line_raises(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text('{"case_id": "a"}\n{broken\n')
    with pytest.raises(Exception):
        IO.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "predictions").collect()


def test_images_and_manifests(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b", "c", "d", "e"]), (2, None)], "id int, images array<string>")
    files = spark.createDataFrame([("a",), ("a",), ("e",)], "path string")
    assert [tuple(r) for r in IO.images_with_files(df, "id", "images", files).orderBy("pos").collect()] == [(1, 0, "a", True), (1, 1, "b", False), (1, 2, "c", False), (1, 3, "d", False)]
    (tmp_path / "p1").mkdir()
    (tmp_path / "p1/manifest.json").write_text('{"protocol": {"image_budget": 15}, "orientation": {"original": "RAS"}, "images": [{"file": "f.png", "view": "axial"}]}')
    m = IO.read_manifests(spark, str(tmp_path)).first()
    assert (m["patient"], m["image_budget"], m["orientation_original"], m["images"][0]["file"]) == ("p1", 15, "RAS", "f.png")
    assert IO.default_case_id(spark.createDataFrame([(None, 3)], "case_id string, i int"), "i").first()["case_id"] == "pref_3"


def test_nrrd(spark, tmp_path):
    vol = np.arange(24, dtype="<i2").reshape(4, 3, 2)
    head = "NRRD0004\n# c\ntype: short\ndimension: 3\nsizes: 2 3 4\nendian: little\nencoding: {}\n\n"
    (tmp_path / "a.nrrd").write_bytes(head.format("raw").encode() + vol.tobytes())
    (tmp_path / "b.nrrd").write_bytes(head.format("gzip").encode() + gzip.compress(vol.tobytes()))
    assert (parse((tmp_path / "b.nrrd").read_bytes())[0] == vol).all()
    spark.dataSource.register(NrrdSource)
    df = spark.read.format("nrrd").load(str(tmp_path))
    assert df.count() == 48 and df.filter("z = 3 AND y = 2 AND x = 1").select("hu").distinct().first()[0] == 23.0
    with pytest.raises(ValueError):
        parse(b"x")


def test_stream_scores_like_a_table(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text('{"id": 1, "text": "Impression: left mca\\nright mca", "ts": "2024-01-01T00:00:00"}\n')
    (src / "2.json").write_text('{"id": 2, "text": "", "ts": "2024-01-01T00:01:00"}\n')
    schema = "id int, text string, ts timestamp"
    scored = ST.score_stream(ST.read_stream(spark, str(src), schema), "text")
    q = ST.write_stream(scored, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("id", "structure_score", "consistency_score").collect()}
    want = {tuple(r) for r in ST.score_stream(spark.read.schema(schema).json(str(src)), "text").select("id", "structure_score", "consistency_score").collect()}
    assert got == want and len(got) == 2
    w = ST.windowed_means(ST.score_stream(spark.read.schema(schema).json(str(src)), "text").withColumn("ts", F.col("ts")), "ts", "structure_score")
    assert w.first()["n"] == 2
