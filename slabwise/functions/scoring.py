"""Structure, rubric, fact and composite scores of reports, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from slabwise.functions import vocab as V
from slabwise.functions.text import col, let, rouge_l, tokens

U = "(?U)"  # Unicode word boundaries; texts are lower-cased first, which is cheaper than ignoring case


def clip(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _any(text: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in terms])


def _count(text: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(t)).cast("int") for t in terms])


# ---- structure -------------------------------------------------------------


def has_impression(text: Column | str) -> Column:
    return F.lower(col(text)).rlike(V.IMPRESSION)


def has_vascular(text: Column | str) -> Column:
    return F.lower(col(text)).rlike(V.VASCULAR)


def word_count(text: Column | str) -> Column:
    return F.size(tokens(text))


def section_order(text: Column | str) -> Column:
    """Vascular section before impression; null unless both are there."""
    t = F.lower(col(text))
    at = [F.regexp_instr(t, F.lit(p)) for p in (V.VASCULAR, V.IMPRESSION)]
    return F.when((at[0] > 0) & (at[1] > 0), at[0] < at[1])


def structure_score(text: Column | str) -> Column:
    t = col(text)
    n = word_count(t)
    parts = [(has_impression(t), 0.3), (has_vascular(t), 0.3), ((n >= 20) & (n <= 500), 0.2), (F.coalesce(section_order(t), F.lit(False)), 0.2)]
    return reduce(lambda a, b: a + b, [F.when(c, F.lit(w)).otherwise(F.lit(0.0)) for c, w in parts])


def impression_text(text: Column | str) -> Column:
    """What follows the first impression heading, up to the next line that opens a section; ''
    without one."""
    return F.regexp_extract(col(text), "(?is)" + V.IMPRESSION_TEXT, 1)


# ---- rubric ----------------------------------------------------------------


def mentioned_vessels(text: Column | str) -> Column:
    low = F.lower(col(text))
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(v)), F.lit(v)) for v in V.VESSEL_TERMS]))


def contradictions(text: Column | str) -> Column:
    """0 to 2: a normal statement beside findings; acute and chronic without 'acute on chronic'."""
    low = F.lower(col(text))
    first = _any(low, V.NORMAL_TERMS) & _any(low, V.FINDING_TERMS)
    second = F.contains(low, F.lit("acute")) & F.contains(low, F.lit("chronic")) & ~F.contains(low, F.lit("acute on chronic"))
    return first.cast("int") + second.cast("int")


def unsupported_vessels(prediction: Column | str, reference: Column | str) -> Column:
    """Vessels of the prediction that the reference does not mention; none without a reference."""
    r = col(reference)
    return F.when(F.length(r) > 0, F.array_except(mentioned_vessels(prediction), mentioned_vessels(r))).otherwise(F.array().cast("array<string>"))


def hallucination_score(prediction: Column | str, reference: Column | str) -> Column:
    return clip(1.0 - 0.2 * F.size(unsupported_vessels(prediction, reference)) - 0.3 * contradictions(prediction))


def laterality_changes(text: Column | str) -> Column:
    """Times that a vessel's side differs from the side the last line gave it.

    Per line and vessel the side is left, right or none; lines without one are skipped, so only
    neighbours of the remaining list count. Native array functions per vessel, no explode."""
    low = F.lower(col(text))
    return reduce(lambda a, b: a + b, [F.when(F.contains(low, F.lit(v)), _changes_of(v, F.split(low, "\n"))).otherwise(F.lit(0)) for v in V.VESSEL_TERMS])


def _changes_of(v: str, lines: Column) -> Column:
    def side(line: Column) -> Column:
        left = F.contains(line, F.lit(f"left {v}")) | F.contains(line, F.lit(f"{v} left"))
        right = F.contains(line, F.lit(f"right {v}")) | F.contains(line, F.lit(f"{v} right"))
        return F.when(left, F.lit(1)).when(right, F.lit(2))

    seen = F.array_compact(F.transform(lines, side))
    n = F.size(seen)
    return F.when(n > 1, F.size(F.filter(F.zip_with(F.slice(seen, 1, n - 1), F.slice(seen, 2, n - 1), lambda a, b: a != b), lambda x: x))).otherwise(F.lit(0))


def sided_after_bilateral(text: Column | str) -> Column:
    low = F.lower(col(text))
    part = F.substring(low, F.locate("bilateral", low), F.lit(200))
    return F.contains(low, F.lit("bilateral")) & (F.contains(part, F.lit("left")) | F.contains(part, F.lit("right")))


def consistency_score(text: Column | str) -> Column:
    return clip(1.0 - 0.25 * laterality_changes(text) - F.when(sided_after_bilateral(text), 0.15).otherwise(0.0))


def overconfident(text: Column | str) -> Column:
    return _count(F.lower(col(text)), V.OVERCONFIDENT)


def uncertain(text: Column | str) -> Column:
    return _count(F.lower(col(text)), V.UNCERTAIN)


def impression_uncertain(text: Column | str) -> Column:
    """Whether the impression holds uncertainty; null without an impression."""
    part = F.lower(impression_text(text))
    return F.when(part != "", _any(part, V.UNCERTAIN))


def uncertainty_score(text: Column | str) -> Column:
    return clip(1.0 - 0.1 * overconfident(text))


def clinical_score(prediction: Column | str, reference: Column | str) -> Column:
    w = V.RUBRIC_WEIGHTS
    return hallucination_score(prediction, reference) * w["hallucination"] + consistency_score(prediction) * w["consistency"] + uncertainty_score(prediction) * w["uncertainty"]


def rule_score(prediction: Column | str, reference: Column | str) -> Column:
    r = col(reference)
    similarity = F.when(F.length(r) > 0, rouge_l(tokens(r), tokens(prediction))).otherwise(F.lit(0.5))
    return 0.3 * structure_score(prediction) + 0.4 * clinical_score(prediction, r) + 0.3 * similarity


# ---- facts -----------------------------------------------------------------


def vessels(text: Column | str) -> Column:
    low = F.lower(col(text))
    return F.array_compact(F.array(*[F.when(low.rlike(U + p), F.lit(k)) for k, p in V.VESSEL_PATTERNS.items()]))


def side(text: Column | str) -> Column:
    """bilateral, left or right; null for none and for both left and right."""
    low = F.lower(col(text))
    both, left, right = (low.rlike(rf"{U}\b{x}\b") for x in ("bilateral", "left", "right"))
    return F.when(both, "bilateral").when(left & right, None).when(left, "left").when(right, "right")


def claims(text: Column | str) -> Column:
    """struct(positive, negative, vessels, side, hedged, overconfident) that the report asserts."""
    low = F.lower(col(text))
    told = F.filter(F.split(low, V.CLAUSE_END), lambda c: c.rlike(U + V.POSITIVE))
    negated = F.transform(told, lambda c: c.rlike(U + V.NEGATION))
    return let(negated, lambda n: F.struct(
        F.exists(n, lambda x: ~x).alias("positive"), (F.exists(n, lambda x: x) | low.rlike(U + V.NEGATIVE)).alias("negative"), vessels(low).alias("vessels"),
        side(low).alias("side"), low.rlike(U + V.HEDGE).alias("hedged"), overconfident(low).alias("overconfident"),
    ))


def _truth(v: Column) -> Column:
    """Truthiness of a variant that is not absent: false for null, false, 0 and empty values."""
    text = v.cast("string")
    kind = F.schema_of_variant(v)
    return ~((kind == "VOID") | F.coalesce(text.isin("false", "", "0", "0.0", "[]", "{}") & ~((kind == "STRING") & (text != "")), F.lit(False)))


def labels(json: Column | str) -> Column:
    """struct(anomaly, vessel, side) of a label object in any of its accepted shapes; all null for
    null, malformed or non-object labels. A key that is present decides even when it is null."""
    v = F.try_parse_json(col(json))

    def get(k: str) -> Column:
        return F.try_variant_get(v, f"$.{k}", "variant")

    def text(k: str) -> Column:
        x = get(k)
        kind = F.schema_of_variant(x)
        return F.when(x.isNull(), F.lit("")).when(kind == "VOID", F.lit("None")).when(kind == "BOOLEAN", F.initcap(x.cast("string"))).otherwise(x.cast("string"))

    def own(k: str) -> Column:
        x = get(k)
        return F.when(x.isNotNull() & _truth(x), F.lower(text(k)))

    present, other = get("anomaly_present"), get("anomaly")
    anomaly = F.when(present.isNotNull(), _truth(present)).when(other.isNotNull(), _truth(other))
    region = F.concat_ws(" ", *[text(k) for k in ("main_region", "region", "vessel", "side", "laterality")])
    return F.struct(
        anomaly.alias("anomaly"), F.coalesce(F.get(vessels(region), F.lit(0)), own("vessel")).alias("vessel"), F.coalesce(side(region), own("side"), own("laterality")).alias("side")
    )


def fact_report(c: Column | str, g: Column | str, contradiction_count: Column | str) -> Column:
    """struct(available, score, detection, vessel, side, calibration) from claims c and labels g.
    Axes that can't be judged are null and drop out of the weighted mean."""
    c, g, k = col(c), col(g), col(contradiction_count)
    yes, no = c["positive"], c["negative"]
    found = F.when(yes, 1.0).when(no & ~c["hedged"], 0.0).when(c["hedged"], 0.5).otherwise(0.3)
    clear = F.when(yes, 0.0).when(no, 1.0).when(c["hedged"], 0.7).otherwise(0.5)
    anomaly = F.coalesce(g["anomaly"], F.lit(False))
    detection = F.when(g["anomaly"].isNull(), None).when(anomaly, found).otherwise(clear)
    vessel = F.when(anomaly & (F.length(g["vessel"]) > 0), F.when(F.size(c["vessels"]) == 0, 0.3).when(F.array_contains(c["vessels"], g["vessel"]), 1.0).otherwise(0.0))
    lat = F.when(anomaly & g["side"].isin("left", "right", "bilateral"), F.when(c["side"].isNull(), 0.3).when(c["side"] == g["side"], 1.0).otherwise(0.0))
    calm = 1.0 - 0.25 * c["overconfident"]
    calibration = clip(F.when((g["anomaly"] == F.lit(False)) & c["hedged"], F.least(F.lit(1.0), calm + 0.1)).otherwise(calm))
    axes = {"detection": detection, "vessel": vessel, "side": lat, "calibration": calibration}
    total = weighted_mean([(v, F.lit(V.FACT_WEIGHTS[n])) for n, v in axes.items()])
    score = clip(total * F.greatest(F.lit(0.0), 1.0 - 0.3 * k))
    available = detection.isNotNull() | vessel.isNotNull() | lat.isNotNull()
    return F.struct(available.alias("available"), score.alias("score"), *[v.alias(n) for n, v in axes.items()])


def weighted_mean(parts: list[tuple[Column, Column]]) -> Column:
    """Mean over the values that are there, weights renormalised; 0.0 when none is."""
    zero = F.lit(0.0)
    top = reduce(lambda a, b: a + b, [F.when(v.isNotNull(), v * w).otherwise(zero) for v, w in parts])
    weight = reduce(lambda a, b: a + b, [F.when(v.isNotNull(), w).otherwise(zero) for v, w in parts])
    return F.when(weight > 0, top / weight).otherwise(zero)


def composite(fact: Column | None, judge: Column | None, structure: Column | None, similarity: Column | None, weights: dict[str, float] | None = None) -> Column:
    """struct(score, components, weights_used): whatever signals are there, blended."""
    w = weights or V.COMPOSITE_WEIGHTS
    given = {"fact": fact, "judge": judge, "structure": structure, "similarity": similarity}
    none = F.lit(None).cast("double")
    parts = {k: (v if v is not None else none) for k, v in given.items()}
    pairs = [x for k, v in parts.items() for x in (F.lit(k), v)]
    used = [x for k, v in parts.items() for x in (F.lit(k), F.when(v.isNotNull(), F.lit(w[k])))]
    there = lambda m: F.map_filter(F.create_map(*m), lambda _, v: v.isNotNull())
    return F.struct(clip(weighted_mean([(v, F.lit(w[k])) for k, v in parts.items()])).alias("score"), there(pairs).alias("components"), there(used).alias("weights_used"))


# ---- judge -----------------------------------------------------------------


def cache_key(case: Column | str, prediction: Column | str) -> Column:
    return F.concat(col(case), F.lit(":"), F.substring(F.sha2(col(prediction), 256), 1, 16))


def judge_result(raw: Column | str, overall_weight: float = 0.5) -> Column:
    """struct(available, score, correctness, grounding, laterality, calibration, overall, rationale) of a
    judge's raw answer: the JSON object from the first { to the last }. Axes that are missing
    or no numbers count 0; without an object the judge abstains (available false, rest null)."""
    v = F.try_parse_json(F.regexp_extract(col(raw), r"(?s)\{.*\}", 0))
    ok = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    axis = {k: F.when(ok, clip(F.coalesce(F.try_variant_get(v, f"$.{k}", "string").try_cast("double"), F.lit(0.0)))) for k in [*V.JUDGE_AXES, "overall"]}
    mean = reduce(lambda a, b: a + b, [axis[k] for k in V.JUDGE_AXES]) / 4
    score = F.when(ok, clip(overall_weight * axis["overall"] + (1 - overall_weight) * mean))
    rationale = F.when(ok, F.coalesce(F.try_variant_get(v, "$.rationale", "string"), F.lit("")))
    return F.struct(ok.alias("available"), score.alias("score"), *[x.alias(k) for k, x in axis.items()], rationale.alias("rationale"))


SCORERS = {
    "structure": lambda p, r: structure_score(p),
    "rule_based": rule_score,
    "clinical": clinical_score,
    "rouge_l": lambda p, r: rouge_l(tokens(r), tokens(p)),
    "random": lambda p, r: F.rand(42),
}


def register_scorer(name: str, scorer) -> None:  # noqa: ANN001
    """Adds a scorer f(prediction Column, reference Column) -> Column under a name."""
    SCORERS[name] = scorer
