"""Queries of the scoring front door, generation contracts, evaluation files, configuration and the volume
chain, with their SQL. Registered beside those of queries.py."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slabwise.functions import scoring as S
from slabwise.functions import vocab as V
from slabwise.operators import evaluate as E
from slabwise.operators import generation as G
from slabwise.operators import records as R
from slabwise.operators import scored as SC
from slabwise.operators import volume as Vol
from slabwise.plans import queries as Base
from slabwise.plans import sql as Q
from slabwise.plans.queries import REFERENCES, _r, _t, big, query
from slabwise.sources import records as IO

# ---- scoring -----------------------------------------------------------------
# A record per preference pair with its two answers as candidates; judge answers exist for the chosen
# answers of every other pair.

_CID = "coalesce(case_id, 'pref_' || pref_id)"
_TWO = f"""(SELECT pref_id, 0 AS idx, {_CID} AS cid, images, labels, chosen AS x FROM prefs_dpo_5x WHERE chosen IS NOT NULL AND rejected IS NOT NULL
  UNION ALL SELECT pref_id, 1, {_CID}, images, labels, rejected FROM prefs_dpo_5x WHERE chosen IS NOT NULL AND rejected IS NOT NULL)"""
_ANSWERS = f"(SELECT {_CID} || ':' || substring(sha256(chosen), 1, 16) AS cache_key, arg_max({Base._RAW}, pref_id) AS raw FROM prefs_dpo_5x WHERE chosen IS NOT NULL AND pref_id % 2 = 0 GROUP BY 1)"


def _records(spark: SparkSession, d: str) -> DataFrame:
    p = IO.default_case_id(_t(spark, d, "prefs_dpo_5x").filter("chosen IS NOT NULL AND rejected IS NOT NULL"), "pref_id")
    one = lambda c, i: F.struct(F.col(c).alias("text"), F.lit(0.7 + 0.3 * i).alias("temperature"), F.lit(0.9).alias("top_p"), F.lit(i).alias("index"), F.col("pref_id"))
    return IO.spread(p.select("case_id", "images", "prompt", "labels", F.array(one("chosen", 0), one("rejected", 1)).alias("candidates")))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    p = IO.default_case_id(_t(spark, d, "prefs_dpo_5x").filter("chosen IS NOT NULL AND pref_id % 2 = 0"), "pref_id")
    return p.select(S.cache_key("case_id", "chosen").alias("cache_key"), F.expr(Base._RAW).alias("raw"), F.col("pref_id").alias("at"))


def _flat(scored: DataFrame) -> DataFrame:
    c = scored.select("case_id", "reference", F.explode("candidates").alias("c"))
    return c.select(F.col("c.metadata.pref_id").alias("pref_id"), F.col("c.metadata.index").cast("bigint").alias("idx"), "case_id", F.col("c.text").alias("text"), F.col("c.score").alias("score"), F.col("c.score_detail").alias("detail"), "reference")


_AX = ", ".join(f"CASE WHEN o IS NOT NULL THEN {Q.clip(f'''coalesce(TRY_CAST(json_extract_string(o, '$.{k}') AS DOUBLE), 0)''')} END AS j_{k}" for k in [*V.JUDGE_AXES, "overall"])
_NESTED = (
    f"""WITH two AS (SELECT t.*, f.reference, a.raw FROM {_TWO} t LEFT JOIN {REFERENCES} f ON t.cid = f.case_id LEFT JOIN {_ANSWERS} a ON a.cache_key = t.cid || ':' || substring(sha256(t.x), 1, 16)),
    o AS (SELECT *, CASE WHEN json_valid(y) AND json_type(y) = 'OBJECT' THEN y END AS o FROM (SELECT *, CASE WHEN len(list_filter(coalesce(images, [])[1:4], lambda i: i IS NOT NULL)) > 0 THEN regexp_extract(raw, '\\{{.*\\}}', 0, 's') END AS y FROM two)),
    base AS (SELECT pref_id, idx, cid, x, coalesce(reference, '') AS r, {_AX}, """
    + ", ".join(f"{v} AS c_{k}" for k, v in Q.claims("x").items()) + ", " + ", ".join(f"{v} AS g_{k}" for k, v in Q.labels("labels").items()) + f", {Q.contradictions('x')} AS k FROM o), f AS ("
    + Q.fact("c_", "g_", "k")
    + f"""), g AS (SELECT *, CASE WHEN available THEN fact_score END AS fact, 0.5::DOUBLE * j_overall + 0.5::DOUBLE * (j_correctness + j_grounding + j_laterality + j_calibration) / 4 AS judge, {Q.structure('x')} AS structure, {Q.toks('r')} AS rt, {Q.toks('x')} AS xt FROM f),
    h AS (SELECT *, CASE WHEN length(r) > 0 THEN {Q.rouge_l('rt', 'xt')} END AS similarity FROM g) """
)


def _blend(w: dict[str, float]) -> str:
    top = " + ".join(f"coalesce({k} * {v}::DOUBLE, 0)" for k, v in w.items())
    return Q.clip(f"(({top}) / (" + " + ".join(f"CASE WHEN {k} IS NULL THEN 0 ELSE {v}::DOUBLE END" for k, v in w.items()) + "))")


_SELECT = "SELECT pref_id, idx::BIGINT AS idx, cid AS case_id, round({score}, 6) AS score, ((fact IS NOT NULL)::INT + (judge IS NOT NULL)::INT + 1 + (similarity IS NOT NULL)::INT)::BIGINT AS n_components, round(judge, 6) AS judge, r <> '' AS has_reference FROM h"


def _shown(scored: DataFrame) -> DataFrame:
    return _flat(scored).select("pref_id", "idx", "case_id", _r("score").alias("score"), big(F.size("detail.components")).alias("n_components"), _r(F.element_at("detail.components", "judge")).alias("judge"), (F.length(F.coalesce("reference", F.lit(""))) > 0).alias("has_reference"))


@query(_NESTED + _SELECT.format(score=_blend(V.COMPOSITE_WEIGHTS)))
def score_candidates_nested(spark: SparkSession, d: str) -> DataFrame:
    """Composite of facts, judge, structure and similarity of every candidate of nested records."""
    return _shown(SC.score_nested(_records(spark, d), Base._references(spark, d), "composite", _answers(spark, d)))


_OTHER = {"fact": 0.2, "judge": 0.6, "structure": 0.05, "similarity": 0.15}


@query(_NESTED + _SELECT.format(score=_blend(_OTHER)))
def composite_with_judge(spark: SparkSession, d: str) -> DataFrame:
    """The same with weights of the caller's."""
    return _shown(SC.score_nested(_records(spark, d), Base._references(spark, d), "composite", _answers(spark, d), _OTHER))


_RULE = f"0.3::DOUBLE * structure + 0.4::DOUBLE * {Q.clinical('x', 'r')} + 0.3::DOUBLE * coalesce(similarity, 0.5::DOUBLE)"


@query(_NESTED + f"SELECT pref_id, idx::BIGINT AS idx, round(coalesce(fact, {_RULE}), 6) AS score FROM h")
def score_fact_based(spark: SparkSession, d: str) -> DataFrame:
    return _flat(SC.score_nested(_records(spark, d), Base._references(spark, d), "fact_based")).select("pref_id", "idx", _r("score").alias("score"))


@query(_NESTED + f"SELECT pref_id, idx::BIGINT AS idx, round({_RULE}, 6) AS score FROM h")
def score_rule_based(spark: SparkSession, d: str) -> DataFrame:
    return _flat(SC.score_nested(_records(spark, d), Base._references(spark, d), "rule_based")).select("pref_id", "idx", _r("score").alias("score"))


@query(f"SELECT pref_id, idx::BIGINT AS idx, round(0.7::DOUBLE + 0.3::DOUBLE * idx, 6) AS temperature, 0.9::DOUBLE AS top_p FROM {_TWO}")
def scored_metadata(spark: SparkSession, d: str) -> DataFrame:
    """What a scored candidate keeps of its other fields."""
    c = SC.score_nested(_records(spark, d), None, "random").select(F.explode("candidates.metadata").alias("m"))
    return c.select("m.pref_id", big(F.col("m.index")).alias("idx"), _r("m.temperature").alias("temperature"), "m.top_p")


def _shared(spark: SparkSession) -> str:
    """A new folder below the session's shared one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        root = tempfile.mkdtemp(prefix="slabwise_")
    return f"{root.rstrip('/')}/files-{uuid.uuid4().hex}"


_FILES = f"""{_NESTED}, s AS (SELECT pref_id, idx, cid, x, {_blend(V.COMPOSITE_WEIGHTS)} AS score FROM h),
  w AS (SELECT pref_id, max(score) AS top, min(score) AS low FROM s GROUP BY pref_id)
  SELECT 'pairwise' AS format, count(*) AS n_rows, count(*) AS n_items FROM w WHERE top > low + 0.05::DOUBLE
  UNION ALL SELECT 'binary', count(*), count(*) FILTER (score >= 0.5::DOUBLE) FROM s UNION ALL SELECT 'group', count(*), 2 * count(*) FROM w UNION ALL SELECT 'scored_candidates', count(*), 2 * count(*) FROM w"""


@query(_FILES)
def preference_files(spark: SparkSession, d: str) -> DataFrame:
    """All record files written, read back by their declared schemas, and counted."""
    target = _shared(spark)
    scored = SC.score_nested(_records(spark, d), Base._references(spark, d), "composite", _answers(spark, d))
    SC.write_preferences(scored, target, ["pairwise", " binary", "group", "unknown"])
    n = {"pairwise": F.count("*"), "binary": F.count_if(F.col("preference") == "good"), "group": F.sum(F.size("candidates"))}
    out = [IO.read_jsonl(spark, f"{target}/{k}", k).agg(F.count("*").alias("n_rows"), v.alias("n_items")).select(F.lit(k).alias("format"), "n_rows", "n_items") for k, v in n.items()]
    s = spark.read.schema("case_id string, candidates array<struct<text:string,score:double>>").json(f"{target}/scored_candidates")
    out.append(s.agg(F.count("*").alias("n_rows"), F.sum(F.size("candidates")).alias("n_items")).select(F.lit("scored_candidates").alias("format"), "n_rows", "n_items"))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("SELECT pref_id, ((length(t) - length(replace(t, 'left', ''))) / 4)::BIGINT AS left_mentions, ((length(t) - length(replace(t, 'right', ''))) / 5)::BIGINT AS right_mentions FROM (SELECT pref_id, lower(chosen) AS t FROM prefs_dpo_5x WHERE chosen IS NOT NULL)")
def laterality_mentions(spark: SparkSession, d: str) -> DataFrame:
    m = _t(spark, d, "prefs_dpo_5x").filter("chosen IS NOT NULL").select("pref_id", SC.side_mentions("chosen").alias("m"))
    return m.select("pref_id", F.col("m.left").alias("left_mentions"), F.col("m.right").alias("right_mentions"))


# ---- records, generation, batches ----------------------------------------------

_LIST = "array_to_string(coalesce(images, [])[1:4], '|')"


@query(f"SELECT case_id, {_LIST} AS images, prompt, coalesce(labels, '{{}}') AS labels FROM ctamip_dataset")
def inference_rows(spark: SparkSession, d: str) -> DataFrame:
    return G.inference_rows(_t(spark, d, "ctamip_dataset")).withColumn("images", F.array_join("images", "|"))


@query("SELECT rec_id, i::BIGINT AS index, [0.3, 0.7, 1.0][i + 1]::DOUBLE AS temperature, 0.9::DOUBLE AS top_p FROM ctamip_dataset, (SELECT unnest(range(0, 3)) AS i)")
def generation_requests(spark: SparkSession, d: str) -> DataFrame:
    """Four candidates are wanted and three temperatures given: three requests a case."""
    return G.requests(_t(spark, d, "ctamip_dataset").select("rec_id"), [0.3, 0.7, 1.0], 4).select("rec_id", big(F.col("index")).alias("index"), "temperature", "top_p")


@query(
    f"""SELECT rec_id, (3 + (length(response) > 0)::INT)::BIGINT AS n_candidates, array_to_string(list_concat(['0 p', '1 p', '2 p'], CASE WHEN length(response) > 0 THEN [response] ELSE [] END), '|') AS texts FROM (SELECT rec_id, coalesce(response, '') AS response FROM ctamip_dataset)"""
)
def candidate_records(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a generator as nested records, stripped, the reference behind them."""
    asked = G.requests(_t(spark, d, "ctamip_dataset").select("rec_id", "response"), [0.3, 0.7, 1.0], 4)
    made = asked.withColumn("text", F.concat(F.lit(" "), F.col("index").cast("string"), F.lit(" p \n")))
    c = G.collected(made, ["rec_id"], "response")
    return c.select("rec_id", big(F.size("candidates")).alias("n_candidates"), F.array_join("candidates.text", "|").alias("texts"))


def _turns(*texts: str) -> str:
    mark = "repeat('<image>', least(4, coalesce(len(images), 0)))"
    user = f"'user:' || chr(10) || {mark} || prompt || chr(10)"
    return user + " || 'assistant:' || chr(10)" + "".join(f" || coalesce({t}, '') || chr(10)" for t in texts)


@query(
    f"""SELECT batch, count(*) AS n, md5(string_agg({_turns('chosen')}, '' ORDER BY pref_id)) AS chosen, md5(string_agg({_turns('rejected')}, '' ORDER BY pref_id)) AS rejected, sum(least(4, coalesce(len(images), 0)))::BIGINT AS n_images
    FROM (SELECT *, pref_id // 8 AS batch FROM prefs_dpo_5x) GROUP BY batch"""
)
def collate_pairwise(spark: SparkSession, d: str) -> DataFrame:
    b = _t(spark, d, "prefs_dpo_5x").withColumn("batch", F.expr("pref_id div 8"))
    c = G.collate(b, "batch", "pref_id", "pairwise")
    return c.select("batch", big(F.size("chosen")).alias("n"), F.md5(F.array_join("chosen", "")).alias("chosen"), F.md5(F.array_join("rejected", "")).alias("rejected"), big(F.size("images")).alias("n_images"))


@query(f"SELECT batch, md5(string_agg({_turns()}, '' ORDER BY rec_id)) AS texts, string_agg(coalesce(case_id, '-'), '|' ORDER BY rec_id) AS case_ids, sum(least(4, coalesce(len(images), 0)))::BIGINT AS n_images FROM (SELECT *, rec_id // 8 AS batch FROM ctamip_dataset) GROUP BY batch")
def collate_inference(spark: SparkSession, d: str) -> DataFrame:
    b = _t(spark, d, "ctamip_dataset").withColumn("batch", F.expr("rec_id div 8"))
    c = G.collate(b, "batch", "rec_id", "inference")
    return c.select("batch", F.md5(F.array_join("texts", "")).alias("texts"), F.array_join(F.transform("case_ids", lambda x: F.coalesce(x, F.lit("-"))), "|").alias("case_ids"), big(F.size("images")).alias("n_images"))


@query(f"SELECT pref_id, {_turns()} AS prompt, chosen, rejected, array_to_string(list_transform(coalesce(images, [])[1:4], lambda p: '/data/images/' || p), '|') AS images FROM prefs_dpo_5x")
def trainer_records_absolute(spark: SparkSession, d: str) -> DataFrame:
    t = G.trainer_pairs(_t(spark, d, "prefs_dpo_5x"), "/data/images/", G.plain_template)
    return t.select("pref_id", "prompt", "chosen", "rejected", F.array_join("images", "|").alias("images"))


@query("SELECT count(*) AS n_images, count(*) FILTER (NOT there) AS n_placeholders FROM (SELECT path IN (SELECT unnest(images) FROM sft_from_prefs_5x WHERE sft_id % 2 = 0) AS there FROM (SELECT unnest(images[1:4]) AS path FROM ctamip_dataset))")
def image_load(spark: SparkSession, d: str) -> DataFrame:
    """The first images of every case with their content, a black placeholder where there is no file."""
    files = _t(spark, d, "sft_from_prefs_5x").filter("sft_id % 2 = 0").select(F.explode("images").alias("path")).distinct().withColumn("content", F.encode("path", "utf-8"))
    i = IO.load_images(_t(spark, d, "ctamip_dataset"), "rec_id", "images", files)
    return i.agg(F.count_if(F.col("content").isNotNull()).alias("n_images"), F.count_if("placeholder").alias("n_placeholders"))


# ---- evaluation and configuration -------------------------------------------


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    test = _t(spark, d, "ctamip_dataset").select("rec_id", "case_id", "response", "labels")
    return E.join_predictions(test, "case_id", _t(spark, d, "candidates").select("cand_id", "case_id", "text"), "text", "cand_id")


@query(Base._EVAL + "SELECT m.rec_id, t.case_id, k.p AS prediction, t.response AS reference, t.labels, round(m.bleu, 6) AS bleu, round(m.rouge_l, 6) AS rouge_l, round(m.clinical_score, 6) AS clinical_score FROM m JOIN k USING (rec_id) JOIN ctamip_dataset t USING (rec_id)")
def evaluation_cases(spark: SparkSession, d: str) -> DataFrame:
    """The evaluation of every case beside its texts and labels."""
    p = IO.spread(_predicted(spark, d))
    c = E.per_case(p, E.flat_metrics(p, "rec_id", "prediction", "response"), "rec_id", ["case_id", "prediction", "response", "labels"])
    return c.select("rec_id", "case_id", "prediction", F.col("response").alias("reference"), "labels", *[_r(f"metrics.{m}").alias(m) for m in ("bleu", "rouge_l", "clinical_score")])


_KEYS = [("data", "max_images_per_case"), ("data", "train_jsonl"), ("training", "seed"), ("training", "learning_rate"), ("alignment", "beta"), ("generation", "top_p"), ("lora", "r"), ("evaluation", "use_llm_judge"), ("distributed", "strategy")]
_JSON = [(1, {}), (2, {"data": {"max_images_per_case": 8}, "training": {"seed": 1, "learning_rate": 0.5}}), (3, {"lora": {"r": 8}, "evaluation": {"use_llm_judge": True}, "alignment": {"beta": 0.3, "gamma": 1}, "other": {}})]


@query("SELECT * FROM (VALUES (1, 4, 'x.jsonl', 42, 0.0002::DOUBLE, 0.1::DOUBLE, 0.9::DOUBLE, 64, false, 'single', 'tensorboard|wandb', '', 8), (2, 8, 'x.jsonl', 1, 0.5, 0.1, 0.9, 64, false, 'single', 'tensorboard|wandb', '', 8), (3, 4, 'x.jsonl', 42, 0.0002, 0.3, 0.9, 8, true, 'single', 'tensorboard|wandb', 'alignment.gamma|other', 8)) t(id, max_images_per_case, train_jsonl, seed, learning_rate, beta, top_p, r, use_llm_judge, strategy, report_to, unknown, n_sections)")
def config_whole(spark: SparkSession, d: str) -> DataFrame:
    """All sections by precedence: an override, the file, the default; what is unknown is named."""
    t = spark.createDataFrame([(i, json.dumps(j)) for i, j in _JSON], "id int, j string").withColumn("c", R.config("j", {"data.train_jsonl": "x.jsonl"}))
    n = F.size(F.json_object_keys(R.config_json("j")))
    return t.select("id", *[F.col(f"c.{s}.{k}").alias(k) for s, k in _KEYS], F.array_join("c.training.report_to", "|").alias("report_to"), F.array_join(R.unknown_settings("j"), "|").alias("unknown"), n.alias("n_sections"))


@query("SELECT count(*) AS n, count(*) FILTER (n_sup > 0) AS n_ok, bool_and(n_sup > 0) AS passed FROM (SELECT len(list_filter(string_split_regex(lower(response), '" + V.BLANK + "'), lambda x: x <> '')) AS n_sup FROM sft_from_prefs_5x WHERE response IS NOT NULL ORDER BY sft_id LIMIT 40)")
def mask_verify_first(spark: SparkSession, d: str) -> DataFrame:
    """The verdict over the first 40 records, which is how many the verification looks at."""
    first = Base._masked(spark, d).orderBy("sft_id").limit(40)
    m = Base._mask_reports(first).select((F.col("m.ok") & (F.col("n") > 0)).alias("ok"))
    return m.agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"), F.bool_and("ok").alias("passed"))


# ---- volumes -----------------------------------------------------------------

_SETS = "(SELECT DISTINCT 'p' || (vec_id % 5) AS patient FROM embeddings)"
_PLAN = f"""(SELECT patient, k::INT AS k, CASE WHEN patient <> 'p4' THEN patient || '_brain.nrrd' END AS file, CASE WHEN patient = 'p4' THEN 'missing' WHEN patient = 'p1' AND k = 2 THEN 'skip' ELSE 'run' END AS status,
  CASE WHEN patient = 'p4' THEN 'K' || k || ' p4: no brain-only NRRD found' END AS error FROM {_SETS}, (SELECT unnest([2, 4]) AS k))"""


def _plan(spark: SparkSession, d: str) -> DataFrame:
    patients = _t(spark, d, "embeddings").select(F.concat(F.lit("p"), F.pmod("vec_id", F.lit(5)).cast("string")).alias("patient")).distinct()
    files = patients.filter("patient <> 'p4'").withColumn("file", F.concat("patient", F.lit("_brain.nrrd")))
    return Vol.sweep_plan(Vol.sweep(patients, [2, 4]), files, spark.createDataFrame([("p1", 2)], "patient string, k int"))


@query(f"SELECT * FROM {_PLAN}")
def sweep_plan(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d)


@query(f"SELECT patient, k, coalesce(error, 'K' || k || ' p0: exit 3') AS message FROM {_PLAN} WHERE error IS NOT NULL OR (patient = 'p0' AND k = 4)")
def sweep_failures(spark: SparkSession, d: str) -> DataFrame:
    return Vol.failures(_plan(spark, d), spark.createDataFrame([("p0", 4, 3), ("p2", 4, 0)], "patient string, k int, code int"))


@query(f"SELECT count(*) AS n_jobs, count(*) FILTER (error IS NOT NULL OR (patient = 'p0' AND k = 4)) AS n_failed, 1::INT AS exit_code FROM {_PLAN}")
def sweep_outcome(spark: SparkSession, d: str) -> DataFrame:
    return Vol.outcome(_plan(spark, d), spark.createDataFrame([("p0", 4, 3), ("p2", 4, 0)], "patient string, k int, code int"))


_FILE = "CASE WHEN starts_with(view, 'global_') THEN 'global/' || view || '.png' ELSE view || '/' || view || '_slab_' || lpad(slab_index::VARCHAR, 2, '0') || '_of_' || slabs_total || '.png' END"


@query(
    f"""WITH s AS (SELECT *, {_FILE} AS file FROM ({Base._SLABS})) SELECT (SELECT count(DISTINCT patient) FROM s) AS n_patients, patient, 15::INT AS image_budget, 'LPS' AS orientation_original, array_to_string(list_sort(list(patient || '/' || file)), '|') AS images,
    count(mm_lo) AS n_with_extent, string_agg(coalesce(coverage_band, '-') || coalesce(side, '-'), '|' ORDER BY file) AS coverage FROM s GROUP BY patient"""
)
def manifest_rollup(spark: SparkSession, d: str) -> DataFrame:
    s = Vol.slabs(Vol.shape_of(Base._voxels(spark, d)), 4, (0.7, 0.7, 0.5))
    at = s.select("patient").distinct().withColumn("original", F.lit("LPS"))
    m = Vol.rollup(Vol.patient_manifest(s, Vol.image_budget(4, True), at))
    cover = F.array_join(F.transform("coverage", lambda c: F.concat(F.coalesce(c["coverage_band"], F.lit("-")), F.coalesce(c["side"], F.lit("-")))), "|")
    n = F.size(F.filter("coverage", lambda c: c["extent_mm"].isNotNull()))
    return m.select("n_patients", "patient", "image_budget", "orientation_original", F.array_join(F.array_sort("images"), "|").alias("images"), big(n).alias("n_with_extent"), cover.alias("coverage"))


_THREE = Base.ORACLES["volume_mip"]
_PX = "trunc((greatest(lo, least(hi, hu)) - lo) / (hi - lo + 1e-6::DOUBLE) * 255.0::DOUBLE)::INT"


@query(
    f"""WITH m AS ({_THREE}), b AS (SELECT patient, view, slab_index, lo, CASE WHEN h > lo THEN h ELSE lo + 1 END AS hi FROM (SELECT patient, view, slab_index, coalesce(quantile_cont(hu, 0.01) FILTER (hu > -100), 0) AS lo, coalesce(quantile_cont(hu, 0.995) FILTER (hu > -100), 1) AS h FROM m GROUP BY ALL)),
    w AS (SELECT patient, view, slab_index, max(col) AS last FROM m GROUP BY ALL)
    SELECT patient, view, slab_index, "row", CASE WHEN view = 'sagittal' THEN col ELSE last - col END AS col, {_PX} AS value FROM m JOIN b USING (patient, view, slab_index) JOIN w USING (patient, view, slab_index)"""
)
def volume_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Images of every slab in all three views, stretched image by image and turned left to right."""
    return Vol.pixels(Vol.project(Base._voxels(spark, d), 3), "per_image", flip=True)
