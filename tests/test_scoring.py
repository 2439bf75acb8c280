"""Reports with known scores, and one test for every trap of the semantics."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slabwise.functions import scoring as S
from slabwise.functions import text as T

GOOD_LVO = "Findings: Abrupt cutoff of the right middle cerebral artery M1 segment with non-opacification of distal branches, consistent with occlusion. Impression: Acute occlusion of the right MCA."
WRONG_SIDE = "Findings: Occlusion of the LEFT middle cerebral artery M1 segment. Impression: Acute left MCA occlusion."
WRONG_VESSEL = "Findings: Occlusion of the basilar artery. Impression: Acute basilar occlusion."
MISS = "Findings: The intracranial vessels are patent with normal opacification. Impression: No large vessel occlusion. Unremarkable CTA."
GARBAGE = "Findings: Bad images. Impression: Massive stroke with complete blockage everywhere and definitely certain hemorrhage."
GOOD_NORMAL = "Findings: Major intracranial arteries are patent without cutoff. Impression: No definite large vessel occlusion. Limited slab review; correlate with full CTA source images."
A, B = '{"anomaly_present": true, "main_region": "Right MCA"}', '{"anomaly_present": false}'


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols))
    return df.select(expr.alias("x")).first()["x"]


def fact(spark, text, labels):
    df = spark.createDataFrame([(text, labels)], "t string, l string").withColumn("c", S.claims("t")).withColumn("g", S.labels("l")).withColumn("k", S.contradictions("t"))
    return df.select(S.fact_report("c", "g", "k").alias("f")).first()["f"]


@pytest.mark.parametrize(
    "text,labels,score",
    [
        (GOOD_LVO, A, 1.0), (WRONG_SIDE, A, 0.75), (WRONG_VESSEL, A, 0.625), (GARBAGE, A, 0.345), (MISS, A, 0.1645), (GOOD_NORMAL, B, 1.0), (GOOD_LVO, B, 0.1 / 0.55), (GOOD_NORMAL, A, 0.46),
        (GARBAGE, B, 0.545455), (MISS, B, 0.7), (WRONG_SIDE, B, 0.181818),
    ],
)
def test_fact_scores(spark, text, labels, score):
    f = fact(spark, text, labels)
    assert f["available"] and f["score"] == pytest.approx(score, abs=1e-6)


def test_fact_unavailable_without_truth(spark):
    for labels in (None, "{}", '{"source": "import"}', "not json", "[1]"):
        assert fact(spark, GOOD_LVO, labels)["available"] is False


@pytest.mark.parametrize(
    "labels,expected",
    [
        (A, (True, "mca", "right")), (B, (False, None, None)), ('{"vessel": "mca", "side": "right", "anomaly_present": true}', (True, "mca", "right")), ("{}", (None, None, None)), (None, (None, None, None)),
        ('{"anomaly": 1, "region": "Left ICA"}', (True, "ica", "left")), ('{"anomaly_present": null, "anomaly": true}', (False, None, None)), ('{"anomaly_present": "false"}', (True, None, None)),
        ('{"occlusion_present": true, "side": "left", "segment": "M1"}', (None, None, "left")), ('{"anomaly_present": true, "vessel": "M2", "laterality": "Midline"}', (True, "mca", "midline")),
        ('{"anomaly": 0}', (False, None, None)), ('{"anomaly": ""}', (False, None, None)), ('{"anomaly_present": true, "vessel": "Circle", "side": "left and right"}', (True, "circle", "left and right")),
    ],
)
def test_labels(spark, labels, expected):
    assert tuple(one(spark, S.labels("l"), l=labels)) == expected


def test_composite(spark):
    df = spark.createDataFrame([(GOOD_LVO, A, GOOD_LVO), (GARBAGE, A, GOOD_LVO)], "t string, l string, r string")
    df = df.withColumn("c", S.claims("t")).withColumn("g", S.labels("l")).withColumn("k", S.contradictions("t")).withColumn("f", S.fact_report("c", "g", "k"))
    out = df.select(S.composite(F.col("f.score"), None, S.structure_score("t"), T.rouge_l(T.tokens("r"), T.tokens("t"))).alias("x")).collect()
    assert out[0]["x"]["score"] == pytest.approx(0.65 / 0.7) and out[1]["x"]["score"] == pytest.approx(0.300275, abs=1e-6)
    assert set(out[0]["x"]["weights_used"]) == {"fact", "structure", "similarity"}
    assert spark.range(1).select(S.composite(None, None, None, None)["score"].alias("x")).first()["x"] == 0.0


def test_vessels_by_containment_keep_false_positives(spark):
    assert one(spark, S.mentioned_vessels("t"), t=MISS) == ["ica"]
    assert "ica" in one(spark, S.mentioned_vessels("t"), t=GOOD_LVO)


def test_laterality(spark):
    assert one(spark, S.laterality_changes("t"), t="left mca\nright mca\nleft mca") == 2
    assert one(spark, S.laterality_changes("t"), t="left mca\nthe mca\nleft mca") == 0
    assert one(spark, S.laterality_changes("t"), t="") == 0
    assert one(spark, S.sided_after_bilateral("t"), t="bilateral" + " " * 200 + "left") is False
    assert one(spark, S.consistency_score("t"), t="left mca\nright mca\nbilateral left") == pytest.approx(0.6)


def test_contradictions(spark):
    assert one(spark, S.contradictions("t"), t="normal, occlusion. acute and chronic") == 2
    assert one(spark, S.contradictions("t"), t="acute on chronic") == 0


def test_sections(spark):
    assert one(spark, S.impression_text("t"), t="Impression: a\nb\nRec: c") == " a\nb"
    assert one(spark, S.impression_text("t"), t="none") == ""
    assert one(spark, S.section_order("t"), t="Vascular summary: x Impression: y") is True
    assert one(spark, S.section_order("t"), t="Impression: y vascular findings : x") is False
    assert one(spark, S.section_order("t"), t="Impression: y") is None
    assert one(spark, S.structure_score("t"), t="") == 0.0


def test_unicode_words_and_boundaries(spark):
    assert one(spark, T.tokens("t"), t="A b\tC d ") == ["a", "b", "c", "d"]
    assert one(spark, T.tokens("t"), t="") == [] and one(spark, T.tokens("t"), t="  ") == []
    assert one(spark, S.vessels("t"), t="ämca") == [] and one(spark, S.vessels("t"), t="MCA.") == ["mca"]
    assert one(spark, T.strip("t"), t=" \n x ") == "x"


def test_judge(spark):
    j = one(spark, S.judge_result("t"), t='ok ```{"correctness": 1, "grounding": "x", "laterality": 2, "overall": 0.5, "rationale": "r"}``` end')
    assert j["available"] and j["score"] == pytest.approx(0.5 * 0.5 + 0.5 * 0.5) and j["laterality"] == 1.0 and j["calibration"] == 0.0
    for bad in ("none", "{broken", None, "[1]"):
        x = one(spark, S.judge_result("t"), t=bad)
        assert x["available"] is False and x["score"] is None
    assert one(spark, S.cache_key("c", "t"), c="k", t="a") == "k:ca978112ca1bbdca"


def _bleu(r, h):
    from collections import Counter

    r, h, p = r.lower().split(), h.lower().split(), []
    for n in range(1, 5):
        a, b = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (r, h))
        p.append(sum((a & b).values()) / max(1, sum(b.values())))
    bp = 1.0 if len(h) > len(r) else math.exp(1 - len(r) / max(len(h), 1))
    return bp * math.exp(sum(map(math.log, p)) / 4) if all(p) else 0.0


def test_bleu_against_counting(spark):
    pairs = [("a b c d e", "a b c d e"), ("a a b c d", "a b a b c d e"), ("", "a"), ("a b", ""), ("", ""), ("the cat sat on the mat", "the the cat sat on a mat the cat sat on")]
    df = spark.createDataFrame([(i, r, h) for i, (r, h) in enumerate(pairs)], "id int, r string, h string").select("id", T.tokens("r").alias("r"), T.tokens("h").alias("h"))
    got = {x["id"]: x["bleu"] for x in T.bleu(df, "id", "r", "h").collect()}
    assert len(got) == len(pairs)
    for i, (r, h) in enumerate(pairs):
        assert got[i] == pytest.approx(_bleu(r, h))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_lcs_against_table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    assert T._lcs(a, b) == t[-1][-1]


def test_rouge_edges(spark):
    df = spark.createDataFrame([("a b c", "a c"), ("", "a"), ("a", "")], "r string, h string").select(T.tokens("r").alias("r"), T.tokens("h").alias("h"))
    out = [tuple(x) for x in df.select(T.rouge_n("r", "h", 1), T.rouge_n("r", "h", 2), T.rouge_l("r", "h")).collect()]
    assert out == [(2 / 3, 0.0, 2 / 3), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)]


def test_ngrams_of_short_texts(spark):
    df = spark.createDataFrame([("a",), ("a b",), ("",)], "t string")
    assert [x[0] for x in df.select(T.ngrams(T.tokens("t"), 2)).collect()] == [[], ["a b"], []]


def test_shared_ngrams_are_never_broadcast(spark):
    left = spark.createDataFrame([(1, "a b c d a b c"), (2, "b c d"), (3, "x y"), (4, None), (5, "A  B\tc")], "k int, t string")
    right = spark.createDataFrame([("z a b c",), ("b c d",), ("ab c",), (None,)], "o string")
    out = T.shared_ngrams(left, "k", "t", right, "o", 3)
    assert {r["k"]: r["n_shared"] for r in out.collect()} == {1: 2, 2: 1, 5: 1}
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
