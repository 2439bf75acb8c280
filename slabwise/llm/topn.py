"""The N best items of every group, with hot groups split off (problem 2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slabwise.llm.common import written

MOST_HOT = 1000  # hot groups up to which their list is broadcast; more are joined by a shuffle


def top_n(df: DataFrame, group: str, score: str, tie: str, n: int, hot_rows: int = 50_000, salt_rows: int = 25_000) -> DataFrame:
    """Rows (group, score, tie) of the n highest scores of each non-null group, equal scores
    by the smaller tie.

    * Exact counts per group (combined before the shuffle) name the hot groups: those of more
      than hot_rows rows, all of them. Their list is broadcast while it is short (1000) and joined
      by a shuffle beyond that, so no light group is large at any number of hot ones.
    * Light groups: one window per group; Spark limits each partition to n ranks before the
      shuffle.
    * Hot groups: rows are range-sorted by (group, salt), ranked within, and the at most
      n x salts survivors of a group are ranked again.
    * Null groups, null and NaN scores are never kept; -0.0 counts as 0.0. Equal (group,
      score, tie) rows are the same item and count once (dense rank). A group with fewer than
      n items keeps what it has; a null tie is the smallest; n = 0 and empty input give no rows; other columns are
      ignored, whatever their names."""
    if n < 0:
        raise ValueError("n must not be negative")
    rows = df.select(F.col(f"`{group}`").alias("_g"), (F.col(f"`{score}`") + F.lit(0.0)).alias("_s"), F.col(f"`{tie}`").alias("_t"))
    rows = rows.filter(F.col("_g").isNotNull() & F.col("_s").isNotNull() & ~F.isnan("_s"))
    counts = rows.groupBy("_g").agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_rows)
    hot = counts.limit(MOST_HOT + 1).collect()

    best = [F.desc("_s"), F.asc("_t")]

    def kept(d: DataFrame, *by: str | Column) -> DataFrame:
        return d.withColumn("_r", F.dense_rank().over(Window.partitionBy(*by).orderBy(*best))).filter(F.col("_r") <= n).drop("_r")

    if hot:
        if len(hot) > MOST_HOT:
            named = written(counts.select("_g", F.ceil(F.col("_n") / salt_rows).alias("_salts")))
        else:
            kind = rows.schema["_g"].dataType.simpleString()
            named = F.broadcast(df.sparkSession.createDataFrame([(r["_g"], -(-r["_n"] // salt_rows)) for r in hot], f"_g {kind}, _salts bigint"))
        light = kept(rows.join(named, "_g", "left_anti"), "_g")
        salted = rows.join(named, "_g").withColumn("_salt", F.pmod(F.xxhash64("_t"), F.col("_salts"))).drop("_salts")
        salted = salted.repartitionByRange("_g", "_salt")
        heavy = kept(kept(salted, "_g", "_salt").drop("_salt"), "_g")
        out = light.unionByName(heavy)
    else:
        out = kept(rows, "_g")
    return out.dropDuplicates(["_g", "_s", "_t"]).select(F.col("_g").alias(group), F.col("_s").alias(score), F.col("_t").alias(tie))
