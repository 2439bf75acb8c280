"""Near-duplicate records within a field (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slabwise.llm.similar import HOT, bands, groups, similar_classes

BANDS, ROWS, SLOTS = 74, 5, 373  # of a round; SLOTS is prime and at least BANDS x ROWS
PASSES = 1  # rounds, each with permutations of its own; two meet 0.99 of all pairs of likeness 0.5


def near_duplicates(rows: DataFrame, least: float = 0.8, n_bands: int = BANDS, band_rows: int = ROWS, slots: int = SLOTS, passes: int = PASSES, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(members, links) of the texts of rows (field int, id bigint, text); see similar_classes.
    Candidates come from banded SuperMinHash signatures; a pair of likeness s is met with
    probability 1 - (1 - s^ROWS)^(BANDS x PASSES) there, or by way of a text that both are linked to; every candidate is compared exactly."""
    if n_bands * band_rows > slots:
        raise ValueError("bands x rows must not exceed the slots")
    rows = rows.select("field", "id", F.lit(0).alias("side"), "text")
    members, links = similar_classes(rows, [(bands(n_bands, band_rows, slots, i), 3.0) for i in range(passes)], least, hot=hot, closed=True)
    return members.select("field", "id", "class"), links


def duplicate_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(field, id_a, id_b) of all pairs, copies expanded; for tables where every pair is asked for."""
    m = members.select("field", "class", "id")
    left = m.select("field", F.col("class").alias("class_a"), F.col("id").alias("x"))
    right = m.select("field", F.col("class").alias("class_b"), F.col("id").alias("y"))
    across = links.select("field", "class_a", "class_b").join(left, ["field", "class_a"]).join(right, ["field", "class_b"])
    equal = left.join(right.withColumnRenamed("class_b", "class_a"), ["field", "class_a"]).filter("x < y")
    both = across.select("field", "x", "y").unionByName(equal.select("field", "x", "y"))
    return both.select("field", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def duplicate_groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """(field, id, class, group, n_links): one row per text with its class, the smallest class that
    a chain of links reaches, and the number of classes linked to its own."""
    tag = F.col("field").cast("bigint")
    coded = links.select(F.struct(tag.alias("f"), F.col("class_a").alias("c")).alias("a"), F.struct(tag.alias("f"), F.col("class_b").alias("c")).alias("b"))
    g = groups(coded, "a", "b").select(F.col("node.f").cast("int").alias("field"), F.col("node.c").alias("class"), F.col("group.c").alias("group"))
    ends = links.select("field", F.explode(F.array("class_a", "class_b")).alias("class")).groupBy("field", "class").agg(F.count("*").alias("n_links"))
    out = members.join(g, ["field", "class"], "left").join(ends, ["field", "class"], "left")
    return out.select("field", "id", "class", F.coalesce("group", "class").alias("group"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
