"""The scoring front door: candidates by method, with judge answers from a table, in nested and flat
form, and the record files that are made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slabwise.functions import scoring as S
from slabwise.functions import text as T
from slabwise.operators import preference as P
from slabwise.sources import records as IO

METHODS = ("composite", "fact_based", "rule_based", "random")
MAX_JUDGE_IMAGES = 4


def judge_answers(df: DataFrame, case: str, text: str, images: str, answers: DataFrame | None, files: DataFrame | None = None, overall_weight: float = 0.5) -> DataFrame:
    """df with judge, the struct of scoring.judge_result of each row's answer.

    answers: (cache_key, raw), the last row of a key by `at` where there is that column; it is
    joined by key, so an answer serves every row of the same case and text. The judge abstains
    (available false) without an answer, without images among the first four, and, where
    files (path) are given, if none of those can be read. Rows stay as many as they are."""
    if answers is None:
        return df.withColumn("judge", F.struct(F.lit(False).alias("available"), F.lit(None).cast("double").alias("score")))
    one = answers.groupBy(F.col("cache_key").alias("_key")).agg((F.max_by("raw", "at") if "at" in answers.columns else F.max("raw")).alias("_raw"))
    shown = F.slice(F.coalesce(F.col(images), F.array().cast("array<string>")), 1, MAX_JUDGE_IMAGES)
    keyed = df.withColumn("_key", S.cache_key(case, text)).withColumn("_n", F.size(F.filter(shown, lambda p: p.isNotNull())))
    if files is not None:
        there = files.select(F.col("path").alias("_p")).distinct()
        wanted = keyed.select(F.explode(F.array_distinct(shown)).alias("_p")).distinct().join(there, "_p", "left_semi")
        seen = keyed.select("_key", F.explode(shown).alias("_p")).join(wanted, "_p").groupBy("_key").agg(F.count("*").alias("_seen"))
        keyed = keyed.join(seen, "_key", "left").withColumn("_n", F.coalesce("_seen", F.lit(0))).drop("_seen")
    j = keyed.join(one, "_key", "left").withColumn("_raw", F.when(F.col("_n") > 0, F.col("_raw")))
    return j.withColumn("judge", S.judge_result(F.coalesce("_raw", F.lit("")), overall_weight)).drop("_key", "_n", "_raw")


def score_rows(df: DataFrame, text: str, reference: str, labels: str, method: str = "composite", weights: dict[str, float] | None = None, use_similarity: bool = True, seed: int | None = 42) -> DataFrame:
    """df with score and score_detail struct(components, weights_used), null but for the composite.

    composite blends facts, the judge (df.judge, if there is that column), structure and
    similarity, whichever are there; fact_based falls back to the rules without labels;
    random is uniform on [0, 1), the same for a seed. A null or empty reference has no similarity;
    a null text scores as an empty one."""
    if method not in METHODS:
        raise ValueError(f"unknown scoring method {method}; known are {METHODS}")
    kinds = "struct<components:map<string,double>,weights_used:map<string,double>>"
    if method == "random":
        return df.withColumn("score", F.rand(seed) if seed is not None else F.rand()).withColumn("score_detail", F.lit(None).cast(kinds))
    x, r = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(reference), F.lit(""))
    d = df.withColumn("_x", x).withColumn("_r", r)
    if method == "rule_based":
        return d.withColumn("score", S.rule_score("_x", "_r")).withColumn("score_detail", F.lit(None).cast(kinds)).drop("_x", "_r")
    d = d.withColumn("_c", S.claims("_x")).withColumn("_g", S.labels(labels)).withColumn("_k", S.contradictions("_x")).withColumn("_f", S.fact_report("_c", "_g", "_k"))
    fact = F.when(F.col("_f.available"), F.col("_f.score"))
    if method == "fact_based":
        d = d.withColumn("score", F.coalesce(fact, S.rule_score("_x", "_r"))).withColumn("score_detail", F.lit(None).cast(kinds))
    else:
        judge = F.when(F.col("judge.available"), F.col("judge.score")) if "judge" in df.columns else None
        similarity = F.when(F.length("_r") > 0, T.rouge_l(T.tokens("_r"), T.tokens("_x"))) if use_similarity else None
        d = d.withColumn("_s", S.composite(fact, judge, S.structure_score("_x"), similarity, weights))
        d = d.withColumn("score", F.col("_s.score")).withColumn("score_detail", F.struct(F.col("_s.components").alias("components"), F.col("_s.weights_used").alias("weights_used")))
    return d.drop("_x", "_r", "_c", "_g", "_k", "_f", "_s")


def score_nested(df: DataFrame, references: DataFrame | None = None, method: str = "composite", answers: DataFrame | None = None, weights: dict[str, float] | None = None, use_similarity: bool = True, seed: int | None = 42) -> DataFrame:
    """(case_id, images, prompt, labels, candidates, reference) of rows (case_id, images, prompt, labels,
    candidates ARRAY<STRUCT<text, ...>>): every candidate becomes struct(text, score, metadata,
    score_detail), metadata holding its other fields, in the same order. references: (case_id,
    reference), one row per case. Rows without candidates stay, with an empty list; rows with a
    null case_id have no reference. A record's candidates are as many as one record holds."""
    fields = [f for f in df.schema["candidates"].dataType.elementType.names if f != "text"]
    rows = df.select(F.monotonically_increasing_id().alias("_row"), "case_id", "images", "prompt", "labels", "candidates")
    if references is not None:
        known = rows.filter("case_id IS NOT NULL").join(references.select("case_id", "reference"), "case_id", "left")
        rows = known.unionByName(rows.filter("case_id IS NULL").withColumn("reference", F.lit(None).cast("string")))
    else:
        rows = rows.withColumn("reference", F.lit(None).cast("string"))
    e = rows.select("*", F.posexplode_outer("candidates").alias("_pos", "_cand")).drop("candidates").withColumn("_text", F.col("_cand.text"))
    if answers is not None:
        e = judge_answers(e, "case_id", "_text", "images", answers)
    e = score_rows(e, "_text", "reference", "labels", method, weights, use_similarity, seed)
    meta = F.struct(*[F.col(f"_cand.{f}").alias(f) for f in fields]) if fields else F.struct(F.lit(None).cast("string").alias("none"))
    item = F.struct(F.col("_pos").alias("p"), F.struct(F.col("_text").alias("text"), "score", meta.alias("metadata"), "score_detail").alias("c"))
    keep = ["case_id", "images", "prompt", "labels", "reference"]
    g = e.groupBy("_row").agg(*[F.first(k).alias(k) for k in keep], F.sort_array(F.collect_list(F.when(F.col("_pos").isNotNull(), F.struct(F.col("_pos").alias("p"), F.to_json(item, {"ignoreNullFields": "false"}).alias("j"))))).alias("l"))
    kind = e.select(item.alias("i")).schema["i"].dataType.simpleString()
    return g.select("case_id", "images", "prompt", "labels", F.transform("l", lambda x: F.from_json(x["j"], kind)["c"]).alias("candidates"), "reference")


def binary_nested(scored: DataFrame, threshold: float = P.THRESHOLD) -> DataFrame:
    """(case_id, images, prompt, labels, response, preference, score): a row per candidate."""
    e = scored.select("case_id", "images", "prompt", "labels", F.explode("candidates").alias("_c"))
    return e.select("case_id", "images", "prompt", "labels", F.col("_c.text").alias("response"), P.preference(F.col("_c.score"), threshold).alias("preference"), F.col("_c.score").alias("score"))


def preference_frames(scored: DataFrame, formats: list[str], margin: float = P.MARGIN, threshold: float = P.THRESHOLD, k: int = P.TOP_K) -> dict[str, DataFrame]:
    """A frame per known format among those requested (an error if none is)."""
    out: dict[str, DataFrame] = {}
    for f in P.formats(formats):
        if f == "pairwise":
            out[f] = P.pairwise_nested(scored, "candidates", margin).select("case_id", "images", "prompt", "labels", "chosen", "rejected", "chosen_score", "rejected_score")
        elif f == "binary":
            out[f] = binary_nested(scored, threshold)
        else:
            out[f] = P.group_nested(scored, "candidates", k).select("case_id", "images", "prompt", "labels", "candidates", "reference")
    return out


def write_preferences(scored: DataFrame, target: str, formats: list[str], **options: float) -> list[str]:
    """Writes <target>/<format> for every requested format, and always <target>/scored_candidates; the
    names written. Every frame is one JSON object per line with nulls written."""
    P.formats(formats)
    at = target.rstrip("/")
    IO.write_jsonl(scored, f"{at}/scored_candidates")
    kept = scored.sparkSession.read.schema(scored.schema).json(f"{at}/scored_candidates")  # scored once, not once per format
    frames = preference_frames(kept, formats, **options)
    for name, df in frames.items():
        IO.write_jsonl(df, f"{at}/{name}")
    return [*frames, "scored_candidates"]


def judge_settings(conf: dict[str, str], model: str | None = None, base_url: str | None = None, api_key: str | None = None) -> dict[str, object]:
    """Judge settings: what is given, else the environment's value in conf; `configured` is whether a judge
    could be called, else it abstains."""
    out: dict[str, object] = {"model": model or conf.get("LLM_JUDGE_MODEL"), "base_url": base_url or conf.get("LLM_JUDGE_BASE_URL"), "api_key": api_key or conf.get("OPENAI_API_KEY")}
    return out | {"configured": bool(out["model"] and out["api_key"])}


def side_mentions(text: Column | str) -> Column:
    """struct(left, right): how often either word stands in the text, case ignored, also inside words."""
    t = F.lower(F.col(text) if isinstance(text, str) else text)
    n = lambda w: ((F.length(t) - F.length(F.replace(t, F.lit(w), F.lit("")))) / len(w)).cast("bigint")
    return F.struct(n("left").alias("left"), n("right").alias("right"))
