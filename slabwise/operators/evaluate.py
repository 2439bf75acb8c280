"""Evaluation of predictions against references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slabwise.functions import scoring as S
from slabwise.functions.text import bleu_parts, clipped_matches, rouge_l, rouge_n, tokens
from slabwise.functions.vocab import RUBRIC_WEIGHTS
from slabwise.operators.preference import last_by

METRICS = ["bleu", "rouge_1", "rouge_2", "rouge_l", "structure_score", "has_impression", "has_vascular", "clinical_score", "hallucination_score", "consistency_score", "uncertainty_score"]


def join_predictions(test: DataFrame, case: str, predictions: DataFrame, prediction: str, order: str) -> DataFrame:
    """test with a prediction column: '' where there is none, the last of several."""
    p = last_by(predictions, case, prediction, order).select(F.col(case).alias("_c"), F.col(prediction).alias("prediction"))
    return test.join(p, F.col(case) == F.col("_c"), "left").drop("_c").withColumn("prediction", F.coalesce("prediction", F.lit("")))


def flat_metrics(df: DataFrame, key: str, prediction: str, reference: str) -> DataFrame:
    """(key, the 11 metrics as doubles) of each row. Tokens are cut once and used by all metrics."""
    d = df.select(key, F.col(prediction).alias("_p"), F.coalesce(F.col(reference), F.lit("")).alias("_r"))
    d = d.withColumn("_pt", tokens("_p")).withColumn("_rt", tokens("_r"))
    d = d.withColumn("_m", clipped_matches("_rt", "_pt", F.lit(4)))
    b = bleu_parts("_m", F.size("_rt"), F.size("_pt"))["bleu"]
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    m = d.select(
        key, b.alias("bleu"), rouge_n("_rt", "_pt", 1).alias("rouge_1"), rouge_n("_rt", "_pt", 2).alias("rouge_2"), rouge_l("_rt", "_pt").alias("rouge_l"), S.structure_score("_p").alias("structure_score"),
        flag(S.has_impression("_p")).alias("has_impression"), flag(S.has_vascular("_p")).alias("has_vascular"),
        S.hallucination_score("_p", "_r").alias("hallucination_score"), S.consistency_score("_p").alias("consistency_score"), S.uncertainty_score("_p").alias("uncertainty_score"),
    )
    parts = [F.col(f"{k}_score") * w for k, w in RUBRIC_WEIGHTS.items()]
    return m.withColumn("clinical_score", parts[0] + parts[1] + parts[2]).select(key, *METRICS)


def aggregate(df: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, mean, std, min, max, median): population deviation; nulls are left out; no rows for
    an empty input. One pass with partial aggregation over the unpivoted values."""
    long = df.select([F.col(m).cast("double").alias(m) for m in metrics]).unpivot([], metrics, "metric", "value").filter(F.col("value").isNotNull())
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.median("value").alias("median"))


def running_mean(df: DataFrame, key: str, order: list[str], value: str, weight: str | None = None) -> DataFrame:
    """df with val (last value), sum, count and avg of all rows of the key so far."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.col(weight) if weight else F.lit(1)
    out = df.withColumn("sum", F.sum(F.col(value) * n).over(w)).withColumn("count", F.sum(n).over(w))
    return out.withColumn("avg", F.col("sum") / F.col("count"))


def report(aggregated: DataFrame, settings: dict[str, str]) -> DataFrame:
    """One row with the whole report as JSON: {config, aggregated_metrics}. aggregated has a row per
    metric, so the collected list is bounded by their number."""
    stats = F.struct("mean", "std", "min", "max", "median")
    m = aggregated.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", stats.alias("s"))))).alias("aggregated_metrics"))
    pairs = [F.lit(x) for kv in sorted(settings.items()) for x in kv]
    return m.select(F.to_json(F.struct(F.create_map(*pairs).alias("config"), "aggregated_metrics"), {"ignoreNullFields": "false"}).alias("report"))


def summary(aggregated: DataFrame) -> DataFrame:
    """(line) per metric for printing: its name, mean and deviation to four places."""
    return aggregated.select(F.format_string("%-20s: mean=%.4f, std=%.4f", "metric", "mean", "std").alias("line"))


def per_case(df: DataFrame, metrics: DataFrame, key: str, carried: list[str]) -> DataFrame:
    """(key, carried columns, metrics struct): the evaluation of every case beside its texts."""
    return df.select(key, *carried).join(metrics.select(key, F.struct(*METRICS).alias("metrics")), key)


def write_document(target: str, aggregated: DataFrame, cases: DataFrame, settings: dict[str, str]) -> None:
    """The evaluation as files: <target>/report with config and aggregated metrics in one object, and
    <target>/per_case_results with one object per case, which may be as many as they are."""
    report(aggregated, settings).select("report").write.mode("errorifexists").text(f"{target.rstrip('/')}/report")
    cases.write.option("ignoreNullFields", "false").mode("errorifexists").json(f"{target.rstrip('/')}/per_case_results")
