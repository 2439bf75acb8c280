"""Preference data from scored candidates: pairs, binary labels, top-k groups, trainer records.

Two shapes of the same operators: nested (one row per case with an array of candidates; no
shuffle at all) and flat (one row per candidate, grouped by a key)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MARGIN = 0.05
THRESHOLD = 0.5
TOP_K = 4


def ranked(candidates: Column | str) -> Column:
    """Candidates by score, best first, equal scores in their order; a missing score counts 0.

    candidates: array of structs with a score. Returns structs (score, pos, c)."""
    c = F.col(candidates) if isinstance(candidates, str) else candidates
    keyed = F.transform(c, lambda x, i: F.struct((-F.coalesce(x["score"].cast("double"), F.lit(0.0))).alias("k"), i.alias("pos")))
    return F.transform(F.array_sort(keyed), lambda x: F.struct((-x["k"]).alias("score"), x["pos"].alias("pos"), F.get(c, x["pos"]).alias("c")))


def pairwise_nested(df: DataFrame, candidates: str, margin: float = MARGIN) -> DataFrame:
    """One row per case and candidate that the best beats by more than the margin, in rank order:
    the case's other columns, rank, chosen, rejected, chosen_score, rejected_score. Cases of
    fewer than two candidates give none."""
    keep = [c for c in df.columns if c != candidates]
    r = df.withColumn("_r", ranked(candidates)).filter(F.size("_r") >= 2).withColumn("_b", F.get("_r", F.lit(0)))
    e = r.select(*keep, "_b", F.posexplode(F.slice("_r", 2, F.size("_r") - 1)).alias("rank", "_w"))
    e = e.filter(F.col("_b.score") > F.col("_w.score") + F.lit(margin))
    return e.select(*keep, "rank", F.col("_b.c.text").alias("chosen"), F.col("_w.c.text").alias("rejected"), F.col("_b.score").alias("chosen_score"), F.col("_w.score").alias("rejected_score"))


def group_nested(df: DataFrame, candidates: str, k: int = TOP_K) -> DataFrame:
    """The case with its k best candidates in rank order; cases without candidates stay, empty."""
    if k < 0:
        raise ValueError("k must not be negative")
    best = F.transform(F.slice(ranked(candidates), 1, k) if k else F.array().cast("array<struct<score:double,pos:int,c:struct<text:string>>>"), lambda x: F.struct(x["c"]["text"].alias("response"), x["score"].alias("score")))
    return df.withColumn(candidates, F.coalesce(best, F.array().cast("array<struct<response:string,score:double>>")))


def best_response(candidates: Column | str) -> Column:
    """Text of the best candidate, the first of equals; '' without one."""
    return F.coalesce(F.get(ranked(candidates), F.lit(0))["c"]["text"], F.lit(""))


def pairwise_flat(df: DataFrame, key: str, order: str, score: str, margin: float = MARGIN) -> DataFrame:
    """(key, best, worse, best_score, worse_score): the flat form, items being named by `order`.

    The best of a group comes from a combining aggregate (max_by), so a group of a third of
    all rows is reduced before the shuffle and is never sorted in one task; joining it back is
    a join on the group key that adaptive execution may broadcast or split."""
    s = F.coalesce(F.col(score), F.lit(0.0))
    rows = df.select(F.col(key).alias("_k"), F.col(order).alias("_o"), s.alias("_s"))
    best = rows.groupBy("_k").agg(F.max(F.struct(F.col("_s").alias("s"), (-F.col("_o")).alias("o"))).alias("b"))
    j = rows.join(best, "_k").filter((F.col("_o") != -F.col("b.o")) & (F.col("b.s") > F.col("_s") + F.lit(margin)))
    return j.select(F.col("_k").alias(key), (-F.col("b.o")).alias("best"), F.col("_o").alias("worse"), F.col("b.s").alias("best_score"), F.col("_s").alias("worse_score"))


def preference(score: Column | str, threshold: float = THRESHOLD) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s >= threshold, "good").otherwise("bad")


def top_k_flat(df: DataFrame, key: str, order: str, score: str, k: int = TOP_K, salts: int | None = None) -> DataFrame:
    """(key, item, score, rank) of each group's k best items, equals by the smaller `order`. Two
    windows, the first salted (as many ways as there are shuffle partitions), so no group is
    sorted in one task; Spark keeps k rows a salt before either shuffle."""
    salts = salts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    if k < 0:
        raise ValueError("k must not be negative")
    rows = df.select(F.col(key).alias("_k"), F.col(order).alias("_o"), F.coalesce(F.col(score), F.lit(0.0)).alias("_s")).withColumn("_salt", F.pmod(F.xxhash64("_o"), F.lit(salts)))
    by = [F.desc("_s"), F.asc("_o")]
    part = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_k", "_salt").orderBy(*by))).filter(F.col("_r") <= k)
    out = part.withColumn("_r", F.row_number().over(Window.partitionBy("_k").orderBy(*by))).filter(F.col("_r") <= k)
    return out.select(F.col("_k").alias(key), F.col("_o").alias("item"), F.col("_s").alias("score"), F.col("_r").alias("rank"))


def last_by(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value) of each non-null key's last row: later rows replace earlier ones."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(value, order).alias(value))


def formats(requested: list[str]) -> list[str]:
    """The known formats among the requested, in their order; an error if none is."""
    known = [f for f in (x.strip() for x in requested) if f in ("pairwise", "binary", "group")]
    if not known:
        raise ValueError(f"no known format among {requested}")
    return known


def alignment_format(kind: Column | str) -> Column:
    """Record format that an alignment method takes; null for an unknown method."""
    k = F.col(kind) if isinstance(kind, str) else kind
    return F.when(k.isin("dpo", "orpo"), "pairwise").when(k == "kto", "binary").when(k == "grpo", "group")


def length_reward(completion: Column | str) -> Column:
    c = F.col(completion) if isinstance(completion, str) else completion
    return F.least(F.length(c) / F.lit(100.0), F.lit(1.0))
