"""The queries of the scoring and curation operators over the test tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slabwise.functions import scoring as S
from slabwise.functions import text as T
from slabwise.functions import vocab as V
from slabwise.operators import evaluate as E
from slabwise.operators import preference as P
from slabwise.operators import records as R
from slabwise.operators import volume as Vol
from slabwise.plans import sql as Q
from slabwise.sources import records as IO

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _r(c: Column | str, n: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def big(c: Column) -> Column:
    return c.cast("bigint")


def _prefs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with both answers: the chosen one is the reference, the rejected one the hypothesis."""
    p = _t(spark, d, "prefs_dpo_5x").filter(F.col("chosen").isNotNull() & F.col("rejected").isNotNull())
    return IO.spread(p.select("pref_id", "case_id", "prompt", "labels", "images", F.col("chosen").alias("r"), F.col("rejected").alias("h")))


PREFS = "(SELECT pref_id, case_id, prompt, labels, images, chosen AS r, rejected AS h FROM prefs_dpo_5x WHERE chosen IS NOT NULL AND rejected IS NOT NULL)"

# ---- text ------------------------------------------------------------------


@query(f"SELECT doc_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct, greatest(0, len(w) - 1) AS n_bigrams FROM (SELECT doc_id, {Q.toks('text')} AS w FROM documents WHERE text IS NOT NULL)")
def text_tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    w = IO.spread(_t(spark, d, "documents").filter(F.col("text").isNotNull()).select("doc_id", "text")).select("doc_id", T.tokens("text").alias("w"))
    return w.select("doc_id", big(F.size("w")).alias("n_tokens"), big(F.size(F.array_distinct("w"))).alias("n_distinct"), big(F.greatest(F.lit(0), F.size("w") - 1)).alias("n_bigrams"))


@query(f"SELECT gram, count(*) AS n FROM (SELECT unnest({Q.grams('w', 2)}) AS gram FROM (SELECT {Q.toks('text')} AS w FROM documents WHERE text IS NOT NULL)) GROUP BY gram")
def text_ngram_counts(spark: SparkSession, d: str) -> DataFrame:
    return T.ngram_counts(_t(spark, d, "documents").filter(F.col("text").isNotNull()), "text", 2)


def _tokenised(spark: SparkSession, d: str) -> DataFrame:
    return _prefs(spark, d).select("pref_id", T.tokens("r").alias("r"), T.tokens("h").alias("h"))


TOKENISED = f"(SELECT pref_id, {Q.toks('r')} AS r, {Q.toks('h')} AS h FROM {PREFS})"


@query(f"WITH p AS {TOKENISED} SELECT pref_id, round(bleu_1, 6) AS bleu_1, round(bleu_2, 6) AS bleu_2, round(bleu_3, 6) AS bleu_3, round(bleu_4, 6) AS bleu_4, round(bleu, 6) AS bleu FROM ({Q.bleu('p', 'pref_id', 'r', 'h')})")
def text_bleu(spark: SparkSession, d: str) -> DataFrame:
    b = T.bleu(_tokenised(spark, d), "pref_id", "r", "h")
    return b.select("pref_id", *[_r(c).alias(c) for c in b.columns[1:]])


@query(f"SELECT pref_id, round({Q.rouge_n('r', 'h', 1)}, 6) AS rouge_1, round({Q.rouge_n('r', 'h', 2)}, 6) AS rouge_2 FROM {TOKENISED}")
def text_rouge_n(spark: SparkSession, d: str) -> DataFrame:
    return _tokenised(spark, d).select("pref_id", _r(T.rouge_n("r", "h", 1)).alias("rouge_1"), _r(T.rouge_n("r", "h", 2)).alias("rouge_2"))


@query(f"SELECT pref_id, round({Q.rouge_l('r', 'h')}, 6) AS rouge_l FROM {TOKENISED}")
def text_rouge_l(spark: SparkSession, d: str) -> DataFrame:
    return _tokenised(spark, d).select("pref_id", _r(T.rouge_l("r", "h")).alias("rouge_l"))


@query(
    f"""SELECT rec_id, count(*) AS n_shared FROM (SELECT rec_id, unnest(list_distinct({Q.grams('w', 8)})) AS g FROM (SELECT rec_id, {Q.toks('response')} AS w FROM ctamip_dataset WHERE response IS NOT NULL))
    WHERE g IN (SELECT unnest({Q.grams('w', 8)}) FROM (SELECT {Q.toks('response')} AS w FROM sft_from_prefs_5x WHERE response IS NOT NULL)) GROUP BY rec_id"""
)
def ngram_contamination(spark: SparkSession, d: str) -> DataFrame:
    """Records whose 8-grams occur in the fine-tuning responses."""
    left, right = _t(spark, d, "ctamip_dataset").filter("response IS NOT NULL"), _t(spark, d, "sft_from_prefs_5x").filter("response IS NOT NULL")
    return T.shared_ngrams(left, "rec_id", "response", right, "response", 8)


# ---- structure and rubric --------------------------------------------------


@query(
    f"""SELECT pref_id, {Q.has('r', V.IMPRESSION)} AS has_impression_section, {Q.has('r', V.VASCULAR)} AS has_vascular_section, len({Q.toks('r')}) AS word_count, length(r) AS char_count,
    len({Q.toks('r')}) BETWEEN 20 AND 500 AS within_length_limits, {Q.order('r')} AS correct_section_order, round({Q.structure('r')}, 6) AS structure_score FROM {PREFS}"""
)
def structure_metrics(spark: SparkSession, d: str) -> DataFrame:
    n = S.word_count("r")
    return _prefs(spark, d).select(
        "pref_id", S.has_impression("r").alias("has_impression_section"), S.has_vascular("r").alias("has_vascular_section"), big(n).alias("word_count"), big(F.length("r")).alias("char_count"),
        n.between(20, 500).alias("within_length_limits"), S.section_order("r").alias("correct_section_order"), _r(S.structure_score("r")).alias("structure_score"),
    )


@query(f"SELECT pref_id, {Q.impression('r')} AS impression FROM {PREFS}")
def section_extract(spark: SparkSession, d: str) -> DataFrame:
    return _prefs(spark, d).select("pref_id", S.impression_text("r").alias("impression"))


@query(f"SELECT pref_id, array_to_string({Q.mentioned('h')}, '|') AS mentioned, array_to_string({Q.unsupported('h', 'r')}, '|') AS unsupported, round({Q.hallucination('h', 'r')}, 6) AS score FROM {PREFS}")
def rubric_hallucination(spark: SparkSession, d: str) -> DataFrame:
    return _prefs(spark, d).select("pref_id", F.array_join(S.mentioned_vessels("h"), "|").alias("mentioned"), F.array_join(S.unsupported_vessels("h", "r"), "|").alias("unsupported"), _r(S.hallucination_score("h", "r")).alias("score"))


_CASES = [
    "left mca occluded\nthe right mca is patent\nleft mca again", "bilateral carotid plaque, worse on the left", "acute and chronic changes", "acute on chronic infarct", "left ica\n\nica right\nica", "Normal study. No abnormality.",
    "right basilar\nbasilar left", "",
]


def _reports(spark: SparkSession, d: str) -> DataFrame:
    """Every chosen answer, and behind it a set phrase by id, so that rare rules are met too."""
    phrase = F.element_at(F.array(*map(F.lit, _CASES)), (F.pmod("pref_id", F.lit(len(_CASES))) + 1).cast("int"))
    return _prefs(spark, d).withColumn("x", F.concat("r", F.lit("\n"), phrase))


_PHRASES = "[" + ", ".join("replace(" + Q.q(c.replace("\n", "~")) + ", '~', chr(10))" for c in _CASES) + "]"
REPORTS = f"(SELECT *, r || chr(10) || {_PHRASES}[(pref_id % {len(_CASES)} + 1)::INT] AS x FROM {PREFS})"


@query(f"SELECT pref_id, {Q.changes('x')}::BIGINT AS n_changes, {Q.bilateral('x')} AS sided, round({Q.consistency('x')}, 6) AS score FROM {REPORTS}")
def rubric_consistency(spark: SparkSession, d: str) -> DataFrame:
    return _reports(spark, d).select("pref_id", big(S.laterality_changes("x")).alias("n_changes"), S.sided_after_bilateral("x").alias("sided"), _r(S.consistency_score("x")).alias("score"))


@query(
    f"SELECT pref_id, {Q.count_of('lower(x)', V.OVERCONFIDENT)}::BIGINT AS overconfident, {Q.count_of('lower(x)', V.UNCERTAIN)}::BIGINT AS uncertain, CASE WHEN {Q.impression('x')} <> '' THEN {Q.any_of('lower(' + Q.impression('x') + ')', V.UNCERTAIN)} END AS impression_uncertain, round({Q.uncertainty('x')}, 6) AS score FROM {REPORTS}"
)
def rubric_uncertainty(spark: SparkSession, d: str) -> DataFrame:
    return _reports(spark, d).select("pref_id", big(S.overconfident("x")).alias("overconfident"), big(S.uncertain("x")).alias("uncertain"), S.impression_uncertain("x").alias("impression_uncertain"), _r(S.uncertainty_score("x")).alias("score"))


@query(f"SELECT pref_id, {Q.contradictions('x')}::BIGINT AS n FROM {REPORTS}")
def rubric_contradictions(spark: SparkSession, d: str) -> DataFrame:
    return _reports(spark, d).select("pref_id", big(S.contradictions("x")).alias("n"))


@query(f"SELECT pref_id, round({Q.clinical('h', 'r')}, 6) AS score FROM {PREFS}")
def rubric_overall(spark: SparkSession, d: str) -> DataFrame:
    return _prefs(spark, d).select("pref_id", _r(S.clinical_score("h", "r")).alias("score"))


@query(
    f"WITH p AS (SELECT pref_id, r, h, {Q.toks('r')} AS rt, {Q.toks('h')} AS ht FROM {PREFS}) SELECT pref_id, round(0.3::DOUBLE * {Q.structure('h')} + 0.4::DOUBLE * {Q.clinical('h', 'r')} + 0.3::DOUBLE * CASE WHEN length(r) > 0 THEN {Q.rouge_l('rt', 'ht')} ELSE 0.5::DOUBLE END, 6) AS score FROM p"
)
def rule_based_score(spark: SparkSession, d: str) -> DataFrame:
    return _prefs(spark, d).select("pref_id", _r(S.rule_score("h", "r")).alias("score"))


# ---- facts and rewards -----------------------------------------------------


@query("SELECT pref_id, " + ", ".join(f"{('array_to_string(' + v + ', chr(124))') if k == 'vessels' else v + ('::BIGINT' if k == 'overconfident' else '')} AS {k}" for k, v in Q.claims("x").items()) + f" FROM {REPORTS}")
def report_claims(spark: SparkSession, d: str) -> DataFrame:
    c = _reports(spark, d).select("pref_id", S.claims("x").alias("c")).select("pref_id", "c.*")
    return c.withColumn("vessels", F.array_join("vessels", "|")).withColumn("overconfident", big(F.col("overconfident")))


@query("SELECT pref_id, " + ", ".join(f"{v} AS {k}" for k, v in Q.labels("labels").items()) + " FROM prefs_dpo_5x")
def labels_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "prefs_dpo_5x").select("pref_id", S.labels("labels").alias("g")).select("pref_id", "g.*")


_BASE = (
    "WITH base AS (SELECT pref_id, r, x, " + ", ".join(f"{v} AS c_{k}" for k, v in Q.claims("x").items()) + ", " + ", ".join(f"{v} AS g_{k}" for k, v in Q.labels("labels").items()) + f", {Q.contradictions('x')} AS k FROM {REPORTS}), f AS ("
    + Q.fact("c_", "g_", "k") + ") "
)


def _facts(spark: SparkSession, d: str) -> DataFrame:
    c = _reports(spark, d).withColumn("c", S.claims("x")).withColumn("g", S.labels("labels")).withColumn("k", S.contradictions("x"))
    return c.withColumn("f", S.fact_report("c", "g", "k"))


@query(_BASE + "SELECT pref_id, available, round(fact_score, 6) AS score, detection, vessel_axis AS vessel, side_axis AS side, round(calibration, 6) AS calibration FROM f")
def fact_report(spark: SparkSession, d: str) -> DataFrame:
    f = _facts(spark, d).select("pref_id", "f.*")
    return f.withColumn("score", _r("score")).withColumn("calibration", _r("calibration"))


@query(
    _BASE + f", g AS (SELECT *, {Q.toks('r')} AS rt, {Q.toks('x')} AS xt FROM f) SELECT pref_id, round(CASE WHEN available THEN fact_score ELSE 0.3::DOUBLE * {Q.structure('x')} + 0.4::DOUBLE * {Q.clinical('x', 'r')} + 0.3::DOUBLE * CASE WHEN length(r) > 0 THEN {Q.rouge_l('rt', 'xt')} ELSE 0.5::DOUBLE END END, 6) AS score FROM g"
)
def fact_score(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d).select("pref_id", _r(F.when(F.col("f.available"), F.col("f.score")).otherwise(S.rule_score("x", "r"))).alias("score"))


@query(
    _BASE + f""", g AS (SELECT *, CASE WHEN available THEN fact_score END AS fact, {Q.structure('x')} AS structure, {Q.toks('r')} AS rt, {Q.toks('x')} AS xt FROM f), h AS (SELECT *, CASE WHEN length(r) > 0 THEN {Q.rouge_l('rt', 'xt')} END AS similarity FROM g)
    SELECT pref_id, round({Q.clip("(coalesce(fact * 0.5::DOUBLE, 0) + structure * 0.1::DOUBLE + coalesce(similarity * 0.1::DOUBLE, 0)) / (CASE WHEN fact IS NULL THEN 0 ELSE 0.5::DOUBLE END + 0.1::DOUBLE + CASE WHEN similarity IS NULL THEN 0 ELSE 0.1::DOUBLE END)")}, 6) AS score,
    (CASE WHEN fact IS NULL THEN 0 ELSE 1 END + 1 + CASE WHEN similarity IS NULL THEN 0 ELSE 1 END)::BIGINT AS n_components FROM h"""
)
def composite_reward(spark: SparkSession, d: str) -> DataFrame:
    f = _facts(spark, d)
    fact = F.when(F.col("f.available"), F.col("f.score"))
    similarity = F.when(F.length("r") > 0, T.rouge_l(T.tokens("r"), T.tokens("x")))
    c = f.select("pref_id", S.composite(fact, None, S.structure_score("x"), similarity).alias("c"))
    return c.select("pref_id", _r("c.score").alias("score"), big(F.size("c.weights_used")).alias("n_components"))


_RAW = """CASE pref_id % 5 WHEN 0 THEN 'Here it is: {"correctness": ' || coalesce(chosen_score, 0) || ', "grounding": 0.5, "laterality": 1.5, "calibration": "high", "overall": 0.8, "rationale": "ok"} done'
  WHEN 1 THEN 'no object here' WHEN 2 THEN '{"overall": ' || coalesce(rejected_score, 0) || '}' WHEN 3 THEN '{"correctness": -1, "overall": 0.4' ELSE '{"correctness": 1, "grounding": 1, "laterality": 0.5, "calibration": 0.25, "overall": 1}' END"""
_AXES = [*V.JUDGE_AXES, "overall"]


@query(
    f"""WITH j AS (SELECT pref_id, CASE WHEN json_valid(o) AND json_type(o) = 'OBJECT' THEN o END AS o FROM (SELECT pref_id, regexp_extract({_RAW}, '\\{{.*\\}}', 0, 's') AS o FROM prefs_dpo_5x)),
    a AS (SELECT pref_id, o IS NOT NULL AS available, {', '.join(f"CASE WHEN o IS NOT NULL THEN {Q.clip(f'''coalesce(TRY_CAST(json_extract_string(o, '$.{k}') AS DOUBLE), 0)''')} END AS {k}" for k in _AXES)} FROM j)
    SELECT pref_id, available, round(0.5::DOUBLE * overall + 0.5::DOUBLE * (correctness + grounding + laterality + calibration) / 4, 6) AS score, round(correctness, 6) AS correctness, laterality, calibration FROM a"""
)
def judge_parse_blend(spark: SparkSession, d: str) -> DataFrame:
    raw = _t(spark, d, "prefs_dpo_5x").select("pref_id", F.expr(_RAW).alias("raw"))
    j = raw.select("pref_id", S.judge_result("raw").alias("j")).select("pref_id", "j.*")
    return j.select("pref_id", "available", _r("score").alias("score"), _r("correctness").alias("correctness"), "laterality", "calibration")


@query("SELECT pref_id, coalesce(case_id, 'pref_' || pref_id) || ':' || substring(sha256(chosen), 1, 16) AS cache_key FROM prefs_dpo_5x WHERE chosen IS NOT NULL")
def judge_cache_key(spark: SparkSession, d: str) -> DataFrame:
    p = IO.default_case_id(_t(spark, d, "prefs_dpo_5x").filter("chosen IS NOT NULL"), "pref_id")
    return p.select("pref_id", S.cache_key("case_id", "chosen").alias("cache_key"))


@query()
def random_score(spark: SparkSession, d: str) -> DataFrame:
    return _prefs(spark, d).select("pref_id", S.SCORERS["random"](F.col("h"), F.col("r")).alias("score"))


# ---- candidates and preferences --------------------------------------------


def _candidates(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Each candidate once, with the columns asked for: a row that was sent twice has the same content,
    so distinct rows are distinct candidates, hashed and combined before the shuffle. A NaN
    score is a missing one."""
    score = F.when(~F.isnan("score"), F.col("score")).alias("score")
    return _t(spark, d, "candidates").select(*[score if c == "score" else c for c in columns]).distinct()


CANDIDATES = "(SELECT DISTINCT cand_id, case_id, cand_index, text, is_reference, CASE WHEN NOT isnan(score) THEN score END AS score FROM candidates)"
REFERENCES = "(SELECT case_id, arg_max(response, rec_id) AS reference, arg_max(labels, rec_id) AS labels FROM ctamip_dataset WHERE case_id IS NOT NULL AND response IS NOT NULL GROUP BY case_id)"


def _references(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d, "ctamip_dataset").filter("case_id IS NOT NULL AND response IS NOT NULL")
    return t.groupBy("case_id").agg(F.max_by("response", "rec_id").alias("reference"), F.max_by("labels", "rec_id").alias("labels"))


@query(f"SELECT case_id, reference FROM {REFERENCES}")
def reference_dedup_last(spark: SparkSession, d: str) -> DataFrame:
    return P.last_by(_t(spark, d, "ctamip_dataset").filter("response IS NOT NULL"), "case_id", "response", "rec_id").withColumnRenamed("response", "reference")


_SCORED = (
    "WITH base AS (SELECT cand_id, x, " + ", ".join(f"{v} AS c_{k}" for k, v in Q.claims("x").items()) + ", " + ", ".join(f"{v} AS g_{k}" for k, v in Q.labels("labels").items())
    + f", {Q.contradictions('x')} AS k FROM (SELECT c.cand_id, c.text AS x, f.labels FROM {CANDIDATES} c LEFT JOIN {REFERENCES} f ON c.case_id = f.case_id)), f AS (" + Q.fact("c_", "g_", "k") + ") "
)


@query(
    _SCORED + f"""SELECT cand_id, available, round({Q.clip("(CASE WHEN available THEN fact_score * 0.5::DOUBLE ELSE 0 END + s * 0.1::DOUBLE) / (CASE WHEN available THEN 0.5::DOUBLE ELSE 0 END + 0.1::DOUBLE)")}, 6) AS score FROM (SELECT *, {Q.structure('x')} AS s FROM f)"""
)
def score_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Composite of fact and structure alone, as its SQL has it; score_candidates_whole adds similarity."""
    s = S.composite(F.when(F.col("f.available"), F.col("f.score")), None, S.structure_score("text"), None)
    return _judged(spark, d).select("cand_id", F.col("f.available").alias("available"), _r(s["score"]).alias("score")).distinct()


@query()
def score_candidates_whole(spark: SparkSession, d: str) -> DataFrame:
    """Composite of fact, structure and, where the case has a reference, similarity to it."""
    similarity = F.when(F.length("reference") > 0, T.rouge_l(T.tokens("reference"), T.tokens("text")))
    s = S.composite(F.when(F.col("f.available"), F.col("f.score")), None, S.structure_score("text"), similarity)
    return _judged(spark, d).select("cand_id", F.col("f.available").alias("available"), _r(s["score"]).alias("score")).distinct()


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """Each candidate row with the reference of its case and its fact report f, labels joined by case.
    Candidates that were sent twice are dropped by the callers, from their narrow results."""
    c = _t(spark, d, "candidates").select("cand_id", "case_id", "text")
    r = _references(spark, d)
    known = c.filter("case_id IS NOT NULL").join(r, "case_id", "left")  # cases without an id stay out of the join
    c = known.unionByName(c.filter("case_id IS NULL"), allowMissingColumns=True).withColumn("c", S.claims("text")).withColumn("g", S.labels("labels")).withColumn("k", S.contradictions("text"))
    return c.withColumn("f", S.fact_report("c", "g", "k"))


@query(
    f"""WITH c AS (SELECT case_id, cand_id, coalesce(score, 0) AS s FROM {CANDIDATES} WHERE case_id IS NOT NULL), b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY s DESC, cand_id) = 1)
    SELECT c.case_id, b.cand_id AS best, c.cand_id AS worse, b.s AS best_score, c.s AS worse_score FROM c JOIN b USING (case_id) WHERE c.cand_id <> b.cand_id AND b.s > c.s + 0.05::DOUBLE"""
)
def preference_pairwise(spark: SparkSession, d: str) -> DataFrame:
    return P.pairwise_flat(_candidates(spark, d, "cand_id", "case_id", "score").filter("case_id IS NOT NULL"), "case_id", "cand_id", "score")


@query(f"SELECT cand_id, CASE WHEN coalesce(score, 0) >= 0.5::DOUBLE THEN 'good' ELSE 'bad' END AS preference FROM {CANDIDATES}")
def preference_binary(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d, "cand_id", "score").select("cand_id", P.preference(F.coalesce("score", F.lit(0.0))).alias("preference"))


@query(f"SELECT CASE WHEN coalesce(score, 0) >= 0.5::DOUBLE THEN 'good' ELSE 'bad' END AS preference, count(*) AS n FROM {CANDIDATES} GROUP BY 1")
def preference_binary_distribution(spark: SparkSession, d: str) -> DataFrame:
    return preference_binary(spark, d).groupBy("preference").agg(F.count("*").alias("n"))


@query(
    f"""SELECT g.case_id, g.cand_id AS item, g.s AS score, g.r AS rank, f.reference IS NOT NULL AS has_reference FROM (SELECT case_id, cand_id, s, r FROM (SELECT case_id, cand_id, coalesce(score, 0) AS s, row_number() OVER (PARTITION BY case_id ORDER BY coalesce(score, 0) DESC, cand_id) AS r FROM {CANDIDATES} WHERE case_id IS NOT NULL) WHERE r <= 4) g LEFT JOIN {REFERENCES} f ON g.case_id = f.case_id"""
)
def preference_group(spark: SparkSession, d: str) -> DataFrame:
    top = P.top_k_flat(_candidates(spark, d, "cand_id", "case_id", "score").filter("case_id IS NOT NULL"), "case_id", "cand_id", "score")
    return top.join(_references(spark, d).select("case_id", "reference"), "case_id", "left").select("case_id", "item", "score", big(F.col("rank")).alias("rank"), F.col("reference").isNotNull().alias("has_reference"))


@query(f"SELECT pref_id, coalesce(case_id, 'pref_' || pref_id) AS case_id, prompt, r AS chosen, h AS rejected FROM {PREFS}")
def trainer_records_pairwise(spark: SparkSession, d: str) -> DataFrame:
    return IO.default_case_id(_prefs(spark, d), "pref_id").select("pref_id", "case_id", "prompt", F.col("r").alias("chosen"), F.col("h").alias("rejected"))


@query(f"SELECT cand_id, text AS completion, coalesce(score, 0) >= 0.5::DOUBLE AS label, CASE WHEN coalesce(score, 0) >= 0.5::DOUBLE THEN 1.0::DOUBLE ELSE 0.0 END AS value FROM {CANDIDATES}")
def trainer_records_binary(spark: SparkSession, d: str) -> DataFrame:
    p = P.preference(F.coalesce("score", F.lit(0.0)))
    return _candidates(spark, d, "cand_id", "text", "score").select("cand_id", F.col("text").alias("completion"), (p == "good").alias("label"), F.when(p == "good", 1.0).otherwise(0.0).alias("value"))


@query(f"SELECT case_id, text AS completion FROM {CANDIDATES} WHERE case_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY coalesce(score, 0) DESC, cand_id) = 1")
def trainer_records_group(spark: SparkSession, d: str) -> DataFrame:
    """The best candidate's text per case, by a combining aggregate."""
    c = _candidates(spark, d, "cand_id", "case_id", "text", "score").filter("case_id IS NOT NULL")
    return c.groupBy("case_id").agg(F.max_by("text", F.struct(F.coalesce("score", F.lit(0.0)), -F.col("cand_id"))).alias("completion"))


@query(
    f"""SELECT case_id, cand_id, text, false AS is_appended FROM {CANDIDATES} WHERE case_id IS NOT NULL UNION ALL SELECT f.case_id, 0, f.reference, true FROM {REFERENCES} f WHERE length(f.reference) > 0 AND f.case_id IN (SELECT case_id FROM candidates)"""
)
def reference_append(spark: SparkSession, d: str) -> DataFrame:
    c = _candidates(spark, d, "cand_id", "case_id", "text").filter("case_id IS NOT NULL").select("case_id", "cand_id", "text", F.lit(False).alias("is_appended"))
    r = _references(spark, d).filter(F.length("reference") > 0).join(c.select("case_id").distinct(), "case_id", "left_semi")
    return c.unionByName(r.select("case_id", F.lit(0).cast("bigint").alias("cand_id"), F.col("reference").alias("text"), F.lit(True).alias("is_appended")))


@query("SELECT sum(n)::BIGINT AS n_candidates, count(*) AS n_cases FROM (SELECT case_id, count(DISTINCT cand_id) AS n FROM candidates WHERE case_id IS NOT NULL GROUP BY case_id)")
def candidate_totals(spark: SparkSession, d: str) -> DataFrame:
    n = _candidates(spark, d, "cand_id", "case_id").filter("case_id IS NOT NULL").groupBy("case_id").agg(F.count("*").alias("n"))
    return n.agg(F.sum("n").alias("n_candidates"), F.count("*").alias("n_cases"))


# ---- records ---------------------------------------------------------------


@query("SELECT sft_id, least(4, coalesce(len(images), 0))::BIGINT AS n_images, 'user' AS first_role, prompt AS user_text, 'assistant' AS second_role, response AS assistant_text FROM sft_from_prefs_5x")
def chat_conversations(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "sft_from_prefs_5x").select("sft_id", R.conversation("prompt", "images", "response").alias("c"))
    user, bot = F.get("c", F.lit(0)), F.get("c", F.lit(1))
    return c.select(
        "sft_id", big(F.size(F.filter(user["content"], lambda p: p["type"] == "image"))).alias("n_images"), user["role"].alias("first_role"), F.element_at(user["content"], -1)["text"].alias("user_text"),
        bot["role"].alias("second_role"), F.element_at(bot["content"], -1)["text"].alias("assistant_text"),
    )


_CHAT = "CASE sft_id % 4 WHEN 0 THEN '<|im_start|>user' || chr(10) || prompt || chr(10) || '<|im_start|>assistant' || chr(10) || response WHEN 1 THEN 'User: ' || prompt || ' Assistant: ' || response WHEN 2 THEN prompt || '<|im_start|>assistant ' || response ELSE prompt END"
_CUT = "CASE WHEN contains(t, 'assistant' || chr(10)) THEN 'assistant' || chr(10) WHEN contains(t, 'Assistant:') THEN 'Assistant:' WHEN contains(t, '<|im_start|>assistant') THEN '<|im_start|>assistant' END"


@query(
    f"""SELECT sft_id, CASE WHEN m IS NULL THEN t ELSE regexp_replace(substring(t, 1, strpos(t, m) - 1), '^{V.BLANK}|{V.BLANK}$', '', 'g') END AS prompt, CASE WHEN m IS NULL THEN '' ELSE regexp_replace(substring(t, strpos(t, m) + length(m)), '^{V.BLANK}|{V.BLANK}$', '', 'g') END AS response
    FROM (SELECT *, {_CUT} AS m FROM (SELECT sft_id, {_CHAT} AS t FROM sft_from_prefs_5x WHERE response IS NOT NULL))"""
)
def conversation_split(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d, "sft_from_prefs_5x").filter("response IS NOT NULL").select("sft_id", F.expr(_CHAT.replace("chr(10)", "'\\n'")).alias("t"))
    return t.select("sft_id", R.split_conversation("t").alias("s")).select("sft_id", "s.*")


@query(
    """SELECT rec_id, pos::BIGINT AS pos, path, path IN (SELECT unnest(images) FROM sft_from_prefs_5x) AS "exists" FROM (SELECT rec_id, unnest(images[1:4]) AS path, unnest(range(0, least(4, len(images)))) AS pos FROM ctamip_dataset WHERE images IS NOT NULL)"""
)
def image_prefix_exists(spark: SparkSession, d: str) -> DataFrame:
    files = _t(spark, d, "sft_from_prefs_5x").select(F.explode("images").alias("path"))
    return IO.images_with_files(_t(spark, d, "ctamip_dataset"), "rec_id", "images", files).withColumn("pos", big(F.col("pos")))


@query("SELECT doc_id, 'data:image/' || CASE doc_id % 3 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' ELSE 'webp' END || ';base64,' || base64(encode(text)) AS uri FROM documents WHERE text IS NOT NULL")
def image_data_uri(spark: SparkSession, d: str) -> DataFrame:
    path = F.element_at(F.array(F.lit("a/b.JPG"), F.lit("a.d/b"), F.lit("b.webp")), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    t = _t(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.col("text").cast("binary").alias("c"), path.alias("p"))
    return t.select("doc_id", F.regexp_replace(R.data_uri("c", "p"), "[\r\n]", "").alias("uri"))


# ids are the lengths of the tokens of prompt and response, padded by (sft_id % 3) on either side
_IDS = f"list_transform({Q.toks('prompt')}, lambda x: length(x)::INT)", f"list_transform({Q.toks('response')}, lambda x: length(x)::INT)"


@query(
    f"""WITH t AS (SELECT sft_id, {_IDS[0]} AS p, {_IDS[1]} AS r, list_transform(range(0, sft_id % 3), lambda i: 0::INT) AS pad, sft_id % 2 = 0 AS lp FROM sft_from_prefs_5x WHERE response IS NOT NULL),
    u AS (SELECT sft_id, len(p) AS n, len(pad) AS k, lp, CASE WHEN lp THEN list_concat(list_concat(pad, p), r) ELSE list_concat(list_concat(p, r), pad) END AS ids, CASE WHEN lp THEN len(pad) ELSE 0 END AS s FROM t)
    SELECT sft_id, array_to_string(list_transform(range(1, len(ids) + 1), lambda i: CASE WHEN (lp AND i <= k) OR (NOT lp AND i > len(ids) - k) OR (i > s AND i <= s + n) THEN -100 ELSE ids[i] END), ',') AS labels FROM u"""
)
def sft_label_mask(spark: SparkSession, d: str) -> DataFrame:
    t = _masked(spark, d)
    return t.select("sft_id", F.array_join(F.transform("labels", lambda x: x.cast("string")), ",").alias("labels"))


def _masked(spark: SparkSession, d: str) -> DataFrame:
    t = IO.spread(_t(spark, d, "sft_from_prefs_5x").filter("response IS NOT NULL").select("sft_id", "prompt", "response"))
    t = t.select("sft_id", "response", T.tokens("prompt").alias("pt"), T.tokens("response").alias("rt"), F.pmod("sft_id", F.lit(3)).cast("int").alias("k"), (F.pmod("sft_id", F.lit(2)) == 0).alias("lp"))
    body, pad = F.concat("pt", "rt"), F.array_repeat(F.lit(""), F.col("k"))
    t = t.withColumn("words", F.when(F.col("lp"), F.concat(pad, body)).otherwise(F.concat(body, pad)))
    t = t.withColumn("ids", F.transform("words", F.length)).withColumn("mask", F.transform("words", lambda w: F.when(w == "", 0).otherwise(1)))
    return t.withColumn("labels", R.label_mask("ids", "mask", F.size("pt"), "lp"))


def _mask_reports(t: DataFrame) -> DataFrame:
    """The supervised text is put together from the tokens whose label is not ignored, and compared with
    the response's."""
    kept = F.filter("words", lambda w, i: F.get("labels", i) != R.IGNORE)
    t = t.withColumn("n", F.size(kept)).withColumn("s", F.array_join(kept, " "))
    return t.withColumn("m", R.mask_report("s", "s", F.array_join("rt", " ")))


_SUPERVISED = f"""WITH t AS (SELECT sft_id, {Q.toks('prompt')} AS p, {Q.toks('response')} AS r, (sft_id % 3)::INT AS k, sft_id % 2 = 0 AS lp FROM sft_from_prefs_5x WHERE response IS NOT NULL),
  u AS (SELECT sft_id, array_to_string(r, ' ') AS e, CASE WHEN lp THEN list_concat(list_concat(list_transform(range(0, k), lambda i: ''), p), r) ELSE list_concat(list_concat(p, r), list_transform(range(0, k), lambda i: '')) END AS w, CASE WHEN lp THEN k ELSE 0 END + len(p) AS a, CASE WHEN lp THEN k + len(p) + len(r) ELSE len(p) + len(r) END AS b FROM t),
  v AS (SELECT sft_id, e, b - a AS n, array_to_string(w[a + 1:b], ' ') AS s FROM u)"""


@query(
    _SUPERVISED + """ SELECT sft_id, n::BIGINT AS n_supervised, contains(s, left(e, 50)) OR contains(e, left(s, 50)) AS covers, contains(s, '<|image') OR contains(s, '<|vision') OR contains(s, '<|video') OR contains(s, 'image_pad') OR contains(s, '<image>') AS leaked FROM v"""
)
def mask_verify(spark: SparkSession, d: str) -> DataFrame:
    m = _mask_reports(_masked(spark, d))
    return m.select("sft_id", big(F.col("n")).alias("n_supervised"), "m.covers", "m.leaked")


@query("SELECT b.x AS batch_size, i.x AS n_images, b.x * i.x AS images_total FROM (SELECT unnest([1, 2, 4]) AS x) b, (SELECT unnest([1, 2, 3, 4]) AS x) i")
def capacity_grid(spark: SparkSession, d: str) -> DataFrame:
    one = spark.range(1).select(R.number_list(F.lit("1,2, 4")).alias("b"), R.number_list(F.lit("1,2,3,,4")).alias("i"))
    g = one.select(F.explode("b").alias("batch_size"), "i").select("batch_size", F.explode("i").alias("n_images"))
    return g.withColumn("images_total", F.col("batch_size") * F.col("n_images"))


@query("SELECT event_id, user_id, value AS val, round(sum(value) OVER w, 4) AS sum, count(*) OVER w AS count, round(avg(value) OVER w, 10) AS avg FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def running_average(spark: SparkSession, d: str) -> DataFrame:
    m = E.running_mean(_t(spark, d, "events"), "user_id", ["ts", "event_id"], "value")
    return m.select("event_id", "user_id", F.col("value").alias("val"), _r("sum", 4).alias("sum"), big(F.col("count")).alias("count"), _r("avg", 10).alias("avg"))


@query("SELECT * FROM (VALUES ('dpo', 'pairwise'), ('orpo', 'pairwise'), ('kto', 'binary'), ('grpo', 'group'), ('ppo', NULL)) t(kind, format)")
def alignment_formats(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([("dpo",), ("orpo",), ("kto",), ("grpo",), ("ppo",)], "kind string").select("kind", P.alignment_format("kind").alias("format"))


@query("SELECT sft_id, least(length(response) / 100.0::DOUBLE, 1.0::DOUBLE) AS reward FROM sft_from_prefs_5x WHERE response IS NOT NULL")
def length_reward(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "sft_from_prefs_5x").filter("response IS NOT NULL").select("sft_id", P.length_reward("response").alias("reward"))


# ---- evaluation ------------------------------------------------------------

_EVAL = f"""WITH p AS (SELECT case_id, arg_max(text, cand_id) AS prediction FROM {CANDIDATES} WHERE case_id IS NOT NULL GROUP BY case_id),
  t AS (SELECT rec_id, coalesce(prediction, '') AS p, coalesce(response, '') AS r FROM ctamip_dataset LEFT JOIN p ON ctamip_dataset.case_id = p.case_id),
  k AS (SELECT *, {Q.toks('p')} AS ht, {Q.toks('r')} AS rt FROM t),
  m AS (SELECT k.rec_id, b.bleu, {Q.rouge_n('rt', 'ht', 1)} AS rouge_1, {Q.rouge_n('rt', 'ht', 2)} AS rouge_2, {Q.rouge_l('rt', 'ht')} AS rouge_l, {Q.structure('p')} AS structure_score,
    CASE WHEN {Q.has('p', V.IMPRESSION)} THEN 1.0::DOUBLE ELSE 0.0 END AS has_impression, CASE WHEN {Q.has('p', V.VASCULAR)} THEN 1.0::DOUBLE ELSE 0.0 END AS has_vascular,
    {Q.clinical('p', 'r')} AS clinical_score, {Q.hallucination('p', 'r')} AS hallucination_score, {Q.consistency('p')} AS consistency_score, {Q.uncertainty('p')} AS uncertainty_score
    FROM k JOIN ({Q.bleu('k', 'rec_id', 'rt', 'ht')}) b ON k.rec_id = b.rec_id) """


def _evaluated(spark: SparkSession, d: str) -> DataFrame:
    """Every record against the last candidate of its case; none counts as an empty prediction."""
    test = IO.spread(_t(spark, d, "ctamip_dataset").select("rec_id", "case_id", "response"))
    return E.flat_metrics(E.join_predictions(test, "case_id", _candidates(spark, d, "cand_id", "case_id", "text"), "text", "cand_id"), "rec_id", "prediction", "response")


@query(_EVAL + "SELECT rec_id, " + ", ".join(f"round({m}, 6) AS {m}" for m in E.METRICS) + " FROM m")
def evaluate_flat(spark: SparkSession, d: str) -> DataFrame:
    return _evaluated(spark, d).select("rec_id", *[_r(m).alias(m) for m in E.METRICS])


@query(_EVAL + "SELECT metric, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max, round(median(v), 6) AS median FROM (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, {m} AS v FROM m" for m in E.METRICS) + ") GROUP BY metric")
def evaluate_aggregate(spark: SparkSession, d: str) -> DataFrame:
    a = E.aggregate(_evaluated(spark, d), E.METRICS)
    return a.select("metric", *[_r(c).alias(c) for c in ("mean", "std", "min", "max", "median")])


# ---- volumes ---------------------------------------------------------------


def _voxels(spark: SparkSession, d: str) -> DataFrame:
    """Every embedding as a slice of 8 x 8 voxels; five volumes by the vector's number."""
    e = _t(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    return e.select(F.concat(F.lit("p"), F.pmod("vec_id", F.lit(5)).cast("string")).alias("patient"), F.floor(F.col("pos") / 8).cast("int").alias("y"), F.pmod("pos", F.lit(8)).alias("x"), F.floor(F.col("vec_id") / 5).cast("int").alias("z"), (F.col("v").cast("double") * 1000.0).alias("hu"))


VOXELS = "(SELECT 'p' || (vec_id % 5) AS patient, (pos // 8)::INT AS y, (pos % 8)::INT AS x, (vec_id // 5)::INT AS z, v::DOUBLE * 1000.0::DOUBLE AS hu FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(0, len(embedding))) AS pos FROM embeddings))"


def _box(a: str, mm: float) -> str:
    pad = round(10.0 / mm)
    return f"coalesce(greatest(min({a}), min({a}) FILTER (hu > 150) - {pad}), min({a}))::INT AS {a}0, coalesce(least(max({a}), max({a}) FILTER (hu > 150) + {pad}), max({a}))::INT AS {a}1"


@query(f"SELECT patient, {_box('y', 8.0)}, {_box('x', 8.0)}, {_box('z', 0.5)} FROM {VOXELS} GROUP BY patient")
def volume_crop(spark: SparkSession, d: str) -> DataFrame:
    return Vol.crop_box(_voxels(spark, d), (8.0, 8.0, 0.5), 150.0)


@query(
    f"""WITH a AS (SELECT patient, z, count(*) FILTER (hu > 100) AS area FROM {VOXELS} GROUP BY patient, z), t AS (SELECT patient, max(area) AS top, max(z) AS last FROM a GROUP BY patient),
    r AS (SELECT patient, min(z) AS a, max(z) AS b, min(last) AS last FROM a JOIN t USING (patient) WHERE top = 0 OR area >= 0.5::DOUBLE * top GROUP BY patient),
    s AS (SELECT patient, greatest(0, least(a + round_even(0.05::DOUBLE * (b - a + 1), 0)::INT, last)) AS z0, b - round_even(0.1::DOUBLE * (b - a + 1), 0)::INT AS zz, last FROM r)
    SELECT patient, z0::INT AS z0, greatest(z0, least(zz, last))::INT AS z1 FROM s"""
)
def volume_trim(spark: SparkSession, d: str) -> DataFrame:
    return Vol.trim_range(_voxels(spark, d), 100.0, 0.5, 0.05, 0.1)


@query(
    f"""SELECT patient, sum(CASE WHEN hu < 30 THEN -1000 WHEN hu > 120 THEN 120 ELSE round(hu, 3) END) AS low_clip, sum(CASE WHEN hu < 30 OR hu > 120 THEN -1000 ELSE round(hu, 3) END) AS bandpass, sum(CASE WHEN hu < 30 THEN -1000 ELSE round(hu, 3) END) AS low, sum(CASE WHEN hu > 120 THEN 120 ELSE round(hu, 3) END) AS clip
    FROM {VOXELS} GROUP BY patient""".replace("sum(", "round(sum(").replace(" END)", " END), 3)")
)
def volume_hu_filter(spark: SparkSession, d: str) -> DataFrame:
    v = _voxels(spark, d)
    return v.groupBy("patient").agg(*[F.round(F.sum(F.round(Vol.hu_filter("hu", m, 30.0, 120.0), 3)), 3).alias(m) for m in ("low_clip", "bandpass", "low", "clip")])


_SHAPE = f"(SELECT patient, max(y) + 1 AS h, max(x) + 1 AS w, max(z) + 1 AS n FROM {VOXELS} GROUP BY patient)"


def _slab_sql(view: str, size: str, axis: str, mm: float) -> str:
    c = "((lo + hi) / 2.0::DOUBLE / len)"
    names = {"axial": ("inferior", "superior"), "coronal": ("anterior", "posterior")}.get(view)
    band = f"CASE WHEN {c} < 1::DOUBLE / 3 THEN '{names[0]}' WHEN {c} > 2::DOUBLE / 3 THEN '{names[1]}' ELSE 'middle' END" if names else "NULL::VARCHAR"
    sided = "NULL::VARCHAR" if names else f"CASE WHEN {c} < 0.4::DOUBLE THEN 'right' WHEN {c} > 0.6::DOUBLE THEN 'left' ELSE 'midline' END"
    one = f"""SELECT patient, '{view}' AS view, '{axis}' AS axis, i AS slab_index, 4 AS slabs_total, lo, hi, round(lo * {mm}::DOUBLE, 2) AS mm_lo, round(hi * {mm}::DOUBLE, 2) AS mm_hi, round(lo::DOUBLE / len, 4) AS frac_lo, round(hi::DOUBLE / len, 4) AS frac_hi, {band} AS coverage_band, {sided} AS side
      FROM (SELECT patient, {size} AS len, i::INT AS i, round_even(i * {size}::DOUBLE / least(4, {size}), 0)::INT AS lo, round_even((i + 1) * {size}::DOUBLE / least(4, {size}), 0)::INT AS hi FROM (SELECT *, unnest(range(0, least(4, {size}))) AS i FROM {_SHAPE}))"""
    whole = f"SELECT patient, 'global_{view}', '{axis}', 0, 1, 0, {size}, NULL, NULL, 0.0, 1.0, {'NULL' if view == 'sagittal' else chr(39) + 'all' + chr(39)}, {chr(39) + 'both' + chr(39) if view == 'sagittal' else 'NULL'} FROM {_SHAPE}"
    return one + " UNION ALL " + whole


_SLABS = " UNION ALL ".join(_slab_sql(*x) for x in (("axial", "n", "Z", 0.5), ("coronal", "h", "Y", 0.7), ("sagittal", "w", "X", 0.7)))


@query(_SLABS)
def volume_slabs(spark: SparkSession, d: str) -> DataFrame:
    return Vol.slabs(Vol.shape_of(_voxels(spark, d)), 4, (0.7, 0.7, 0.5))


@query(
    "SELECT patient, view, slab_index, \"row\", col, max(hu) AS hu FROM (" + " UNION ALL ".join(
        f"""SELECT patient, '{v}' AS view, (CASE WHEN {a} >= round_even({s}::DOUBLE / 3, 0) THEN 1 ELSE 0 END + CASE WHEN {a} >= round_even(2 * {s}::DOUBLE / 3, 0) THEN 1 ELSE 0 END)::INT AS slab_index, {r} AS "row", {c} AS col, hu FROM {VOXELS} JOIN {_SHAPE} USING (patient)"""
        for v, s, a, r, c in (("axial", "n", "z", "y", "x"), ("coronal", "h", "y", "z", "x"), ("sagittal", "w", "x", "z", "y"))
    ) + ") GROUP BY ALL"
)
def volume_mip(spark: SparkSession, d: str) -> DataFrame:
    return Vol.project(_voxels(spark, d), 3)


@query(
    "SELECT patient, view, \"row\", col, max(hu) AS hu FROM (" + " UNION ALL ".join(f"SELECT patient, 'global_{v}' AS view, {r} AS \"row\", {c} AS col, hu FROM {VOXELS}" for v, r, c in (("axial", "y", "x"), ("coronal", "z", "x"), ("sagittal", "z", "y"))) + ") GROUP BY ALL"
)
def volume_mip_global(spark: SparkSession, d: str) -> DataFrame:
    return Vol.project_global(_voxels(spark, d))


_PIXEL = "trunc((greatest(lo, least(hi, hu)) - lo) / (hi - lo + 1e-6::DOUBLE) * 255.0::DOUBLE)::INT"


@query(
    f"""WITH v AS {VOXELS}, p AS (SELECT patient, coalesce(quantile_cont(hu, 0.01) FILTER (hu > -100), 0) AS lo, coalesce(quantile_cont(hu, 0.995) FILTER (hu > -100), 1) AS h FROM v GROUP BY patient), b AS (SELECT patient, lo, CASE WHEN h > lo THEN h ELSE lo + 1 END AS hi FROM p)
    SELECT patient, z, sum({_PIXEL})::BIGINT AS per_volume, sum(w)::BIGINT AS windowed FROM (SELECT v.*, lo, hi, trunc((greatest(-35.0::DOUBLE, least(435.0::DOUBLE, hu)) + 35.0::DOUBLE) / (470.0::DOUBLE + 1e-6::DOUBLE) * 255.0::DOUBLE)::INT AS w FROM v JOIN b USING (patient)) GROUP BY patient, z"""
)
def volume_to_uint8(spark: SparkSession, d: str) -> DataFrame:
    v = _voxels(spark, d)
    j = v.join(Vol.percentiles(v), "patient")
    return j.groupBy("patient", "z").agg(F.sum(Vol.to_pixel("hu", F.col("lo"), F.col("hi"))).alias("per_volume"), F.sum(Vol.to_pixel("hu", *Vol.window_bounds())).alias("windowed"))


@query(
    f"""SELECT patient, 15 AS image_budget, count(*) AS n_images, array_to_string(list_sort(list(patient || '/' || CASE WHEN starts_with(view, 'global_') THEN 'global/' || view || '.png' ELSE view || '/' || view || '_slab_' || lpad(slab_index::VARCHAR, 2, '0') || '_of_' || slabs_total || '.png' END)), '|') AS images
    FROM ({_SLABS}) WHERE NOT (view = 'axial' AND slab_index = 0) GROUP BY patient"""
)
def dataset_manifest(spark: SparkSession, d: str) -> DataFrame:
    m = Vol.manifest(Vol.slabs(Vol.shape_of(_voxels(spark, d)), 4, (0.7, 0.7, 0.5)), Vol.image_budget(4, True), True)
    return m.withColumn("images", F.array_join("images", "|"))


_FILES = [
    ("a_brain", "a_brain.nrrd"), ("a_brain", "x.nrrd"), ("b", "b_brain.nrrd"), ("b", "b.seg.nrrd"), ("c", "brain_only.nrrd"), ("c", "c_brain.nrrd"), ("d", "y_brain.nrrd"), ("d", "z.nrrd"), ("e", "only.nrrd"), ("e", "e_Segmentation.nrrd"),
    ("f", "p.nrrd"), ("f", "q.nrrd"), ("g", "notes.txt"),
]


@query("SELECT * FROM (VALUES ('a_brain', 'a', 'a_brain.nrrd'), ('b', 'b', 'b_brain.nrrd'), ('c', 'c', 'c_brain.nrrd'), ('d', 'd', 'y_brain.nrrd'), ('e', 'e', 'only.nrrd'), ('f', 'f', NULL), ('g', 'g', NULL)) t(folder, patient, file)")
def source_file_choice(spark: SparkSession, d: str) -> DataFrame:
    return Vol.choose_source(spark.createDataFrame(_FILES, "folder string, file string"))


@query("SELECT k::INT AS k, g AS include_global, 'slabs' || k || CASE WHEN g THEN '_global' ELSE '' END AS name, (3 * greatest(1, k) + CASE WHEN g THEN 3 ELSE 0 END)::INT AS image_budget FROM (SELECT unnest([0, 1, 2, 3, 4]) AS k), (SELECT unnest([true, false]) AS g)")
def protocol_grid(spark: SparkSession, d: str) -> DataFrame:
    rows = [(k, g, Vol.config_name(k, g), Vol.image_budget(k, g)) for k in range(5) for g in (True, False)]
    return spark.createDataFrame(rows, "k int, include_global boolean, name string, image_budget int")


@query("SELECT p AS patient, k::INT AS k, 'mip --nrrd_path /in/' || p || ' --out_root /out/slabs' || k || ' --slabs_per_axis ' || k || ' --norm window --include_global' AS command FROM (SELECT DISTINCT 'p' || (vec_id % 5) AS p FROM embeddings), (SELECT unnest([2, 4]) AS k) WHERE NOT (p = 'p1' AND k = 2) AND p IN ('p0', 'p1', 'p3')")
def protocol_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Image sets still to be made, with the call that makes them."""
    patients = _t(spark, d, "embeddings").select(F.concat(F.lit("p"), F.pmod("vec_id", F.lit(5)).cast("string")).alias("patient"))
    todo = Vol.sweep(patients, [2, 4], spark.createDataFrame([("p1", 2)], "patient string, k int"), ["p0, p1", "p3"])
    call = Vol.command("mip", F.concat(F.lit("/in/"), "patient"), F.concat(F.lit("/out/slabs"), F.col("k").cast("string")), "k", {"norm": "window", "trim_area_frac": 0.0, "include_global": True, "radiological_flip": False})
    return todo.select("patient", "k", call.alias("command"))


@query(
    f"""WITH v AS {VOXELS}, b AS (SELECT patient, {_box('y', 8.0)}, {_box('x', 8.0)}, {_box('z', 0.5)} FROM v GROUP BY patient),
    c0 AS (SELECT patient, y - y0 AS y, x - x0 AS x, z - z0 AS z, hu FROM v JOIN b USING (patient) WHERE y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1 AND z BETWEEN z0 AND z1),
    a AS (SELECT patient, z, count(*) FILTER (hu > 150) AS area FROM c0 GROUP BY patient, z), t AS (SELECT patient, max(area) AS top FROM a GROUP BY patient),
    k AS (SELECT patient, min(z) AS a, max(z) AS b FROM a JOIN t USING (patient) WHERE top = 0 OR area >= 0.5::DOUBLE * top GROUP BY patient),
    c AS (SELECT patient, y, x, z - a AS z, CASE WHEN hu < 30 THEN -1000 WHEN hu > 420 THEN 420 ELSE hu END AS hu FROM c0 JOIN k USING (patient) WHERE z BETWEEN a AND b),
    s AS (SELECT patient, max(z) + 1 AS n, max(y) + 1 AS h, max(x) + 1 AS w FROM c GROUP BY patient)
    SELECT patient, 'axial' AS view, (z >= round_even(n / 2.0::DOUBLE, 0))::INT AS slab_index, y AS "row", x AS col, max(hu) AS hu FROM c JOIN s USING (patient) GROUP BY ALL
    UNION ALL SELECT patient, 'coronal', (y >= round_even(h / 2.0::DOUBLE, 0))::INT, z, x, max(hu) FROM c JOIN s USING (patient) GROUP BY ALL
    UNION ALL SELECT patient, 'sagittal', (x >= round_even(w / 2.0::DOUBLE, 0))::INT, z, y, max(hu) FROM c JOIN s USING (patient) GROUP BY ALL"""
)
def volume_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Crop, trim, filter and project in three views."""
    return Vol.pipeline(_voxels(spark, d), 2, (8.0, 8.0, 0.5), 150.0, 0.5)


@query("SELECT line FROM (" + ORACLES["evaluate_aggregate"].replace("SELECT metric, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max, round(median(v), 6) AS median", "SELECT rpad(metric, 20, ' ') || ': mean=' || printf('%.4f', avg(v)) || ', std=' || printf('%.4f', stddev_pop(v)) AS line") + ")")
def evaluation_summary(spark: SparkSession, d: str) -> DataFrame:
    return E.summary(E.aggregate(_evaluated(spark, d), E.METRICS))
