"""Records of evaluation splits that recur in training (problem 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slabwise.llm.common import written
from slabwise.llm.prefixes import BLOCK, prefix_pairs


def image_names(images: Column) -> Column:
    """The set of the last two path parts, without letter case; nulls and empty paths left out."""

    def name(p: Column) -> Column:
        parts = F.filter(F.split(F.lower(F.trim(p)), r"[/\\]+"), lambda x: x != "")
        return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "/")

    return F.array_distinct(F.filter(F.transform(images, name), lambda x: x.isNotNull() & (x != "")))


def _sides(df: DataFrame, split: str, train: str, evaluation: list[str]) -> DataFrame:
    side = F.when(F.col(split) == train, 0).when(F.col(split).isin(evaluation), 1)
    return df.withColumn("_side", side).filter(F.col("_side").isNotNull())


def keys_and_sets(d: DataFrame) -> DataFrame:
    """(id, side, k, set): the case key and the sorted image set of each row, written once."""
    k = F.regexp_replace(F.lower("case"), r"[^\p{L}\p{N}]", "")
    return written(d.select("id", "side", k.alias("k"), F.array_sort(image_names(F.col("images"))).alias("set")))


def same_key(d: DataFrame) -> DataFrame:
    """(a, b): train and evaluation ids with the same case key. d: (id, side, k)."""
    k = d.select("id", "side", "k").filter(F.col("k") != "").distinct()
    return k.filter("side = 0").select("k", F.col("id").alias("a")).join(k.filter("side = 1").select("k", F.col("id").alias("b")), "k").select("a", "b")


def same_images(d: DataFrame, least: float) -> DataFrame:
    """(a, b): ids whose image sets have at least `least` of all their images in common. d: (id, side, set).

    Equal sets fall into one class per side first. Each class is then known by its rarest
    images only - as many as a partner at that likeness can't miss - and the classes that
    meet there are compared exactly."""
    s = d.select("id", "side", "set", F.xxhash64("set", F.lit(1)).alias("c")).filter(F.size("set") > 0)
    ids = s.select("side", "c", "id").distinct()
    classes = written(s.select("side", "c", "set").dropDuplicates(["side", "c"]))
    counts = classes.select(F.explode("set").alias("i"), "side").groupBy("i").agg(F.count("*").alias("df"), F.min("side").alias("lo"), F.max("side").alias("hi"))
    each = classes.select("side", "c", F.size("set").alias("n"), F.explode("set").alias("i")).join(counts, "i")
    w = Window.partitionBy("side", "c").orderBy("df", "i")  # the images of one record
    rare = each.withColumn("r", F.row_number().over(w)).filter((F.col("r") <= F.col("n") - F.ceil(F.col("n") * least) + 1) & (F.col("lo") < F.col("hi")))
    left, right = rare.filter("side = 0").select("i", F.col("c").alias("ca"), F.col("n").alias("na")), rare.filter("side = 1").select("i", F.col("c").alias("cb"), F.col("n").alias("nb"))
    met = left.join(right, "i").filter((F.col("na") >= least * F.col("nb")) & (F.col("nb") >= least * F.col("na"))).select("ca", "cb").distinct()
    met = met.join(classes.filter("side = 0").select(F.col("c").alias("ca"), F.col("set").alias("sa")), "ca").join(classes.filter("side = 1").select(F.col("c").alias("cb"), F.col("set").alias("sb")), "cb")
    both = F.size(F.array_intersect("sa", "sb"))
    near = met.filter(both >= least * (F.size("sa") + F.size("sb") - both)).select("ca", "cb")
    return near.join(ids.filter("side = 0").select(F.col("c").alias("ca"), F.col("id").alias("a")), "ca").join(ids.filter("side = 1").select(F.col("c").alias("cb"), F.col("id").alias("b")), "cb").select("a", "b")


def same_text(d: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """(a, b, containment): ids whose texts have a likeness of at least `least`, and the share of b's triples
    that a holds. Each text is known by its triples
    in which fewest texts meet - as many as a partner at that likeness can't miss - and those
    of the training texts are looked up in those of evaluation, block by block."""
    return prefix_pairs(d, least, block)


def cross_split(df: DataFrame, key: str, split: str, case: str, text: str, images: str, train: str = "train", evaluation: list[str] | None = None, likeness: float = 0.5) -> DataFrame:
    """(a, b, by_case, by_text, by_images, containment): every pair of a training and an evaluation record
    that overlaps in at least one way. containment is the share of the evaluation text's triples
    that the training text holds, where the texts are alike, else null.

    Null and empty values overlap with nothing, neither do rows of no split or without an id; a text of fewer
    than 20 words has no likeness. Repeated rows count once; other columns are ignored; an
    empty table or a missing split gives no rows."""
    d = _sides(df, split, train, evaluation or ["val", "test"])
    d = d.filter(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("id"), F.col("_side").alias("side"), F.col(f"`{case}`").alias("case"), F.col(f"`{text}`").alias("text"), F.col(f"`{images}`").alias("images"))
    narrow = keys_and_sets(d)
    ways = {"by_case": same_key(narrow), "by_text": same_text(d, likeness), "by_images": same_images(narrow, likeness)}
    out = None
    for name, pairs in ways.items():
        held = F.col("containment") if "containment" in pairs.columns else F.lit(None).cast("double")
        part = pairs.select("a", "b", *[F.lit(name == w).alias(w) for w in ways], held.alias("containment"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("a", "b").agg(*[F.bool_or(w).alias(w) for w in ways], F.max("containment").alias("containment"))
