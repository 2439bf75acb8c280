"""The pN_ queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from slabwise.llm.common import table


def _texts(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import functions as F

    c = table(spark, d, "candidates").select(F.lit("candidates.text").alias("field"), F.col("cand_id").alias("rec_id"), "source", "text")
    p = table(spark, d, "prefs_dpo_5x").select(F.lit("prefs_dpo_5x.rejected").alias("field"), F.col("pref_id").alias("rec_id"), "source", F.col("rejected").alias("text"))
    return c.unionByName(p)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from slabwise.llm.unfinished import unfinished

    return unfinished(_texts(spark, d)).select("field", "rec_id")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    from slabwise.llm.unfinished import truncation_report

    return truncation_report(_texts(spark, d))


def _overlap(spark: SparkSession, d: str) -> DataFrame:
    from slabwise.llm.overlap import cross_split

    return cross_split(table(spark, d, "ctamip_dataset"), "rec_id", "split_name", "case_id", "response", "images")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import functions as F

    return _overlap(spark, d).select(F.least("a", "b").alias("rec_id_a"), F.greatest("a", "b").alias("rec_id_b"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping evaluation records and pairs per split and source of the evaluation record."""
    from pyspark.sql import functions as F

    t = table(spark, d, "ctamip_dataset").select(F.col("rec_id").alias("b"), "split_name", "source").distinct()
    j = _overlap(spark, d).join(t, "b")
    return j.groupBy("split_name", "source").agg(F.count("*").alias("n_pairs"), F.countDistinct("b").alias("n_records"), *[F.count_if(w).alias(f"n_{w}") for w in ("by_case", "by_text", "by_images")])


FIELDS = ["candidates.text", "prefs_dpo_5x.chosen", "prefs_dpo_5x.rejected"]


def _near(spark: SparkSession, d: str, least: float) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import functions as F

    from slabwise.llm.duplicates import near_duplicates

    c, p = table(spark, d, "candidates"), table(spark, d, "prefs_dpo_5x")
    parts = [(c, "cand_id", "text"), (p, "pref_id", "chosen"), (p, "pref_id", "rejected")]
    rows = [t.select(F.lit(i).alias("field"), F.col(k).alias("id"), F.col(x).alias("text")) for i, (t, k, x) in enumerate(parts)]
    return near_duplicates(rows[0].unionByName(rows[1]).unionByName(rows[2]), least)


def _named(df: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    return df.withColumn("field", F.element_at(F.array(*map(F.lit, FIELDS)), F.col("field") + 1))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from slabwise.llm.duplicates import duplicate_pairs

    return _named(duplicate_pairs(*_near(spark, d, 0.5)))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    from slabwise.llm.duplicates import duplicate_groups

    return _named(duplicate_groups(*_near(spark, d, 0.8)))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import functions as F

    p, s = table(spark, d, "prefs_dpo_5x"), table(spark, d, "sft_from_prefs_5x")
    parts = [(p, "prefs_dpo_5x", "pref_id", "chosen"), (p, "prefs_dpo_5x", "pref_id", "rejected"), (s, "sft_from_prefs_5x", "sft_id", "response")]
    out = [t.select(F.lit(f"{n}.{c}").alias("field"), F.col(k).alias("rec_id"), "source", "prompt", F.col(c).alias("answer")) for t, n, k, c in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from slabwise.llm.defects import pair_defects

    return pair_defects(_pairs(spark, d)).select("field", "rec_id", "defect")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """How often each source gives each defect type."""
    from pyspark.sql import functions as F

    from slabwise.llm.defects import pair_defects

    pairs = _pairs(spark, d)
    sources = pairs.select("field", "rec_id", "source").dropDuplicates(["field", "rec_id"])
    found = pair_defects(pairs).select("field", "rec_id", F.explode("defects").alias("defect"))
    return found.join(sources, ["field", "rec_id"]).groupBy("field", "source", "defect").agg(F.count("*").alias("n"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from slabwise.llm.topn import top_n

    return top_n(table(spark, d, "candidates"), "case_id", "score", "cand_id", 4).select("case_id", "cand_id")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    from slabwise.llm.tokens import encode

    return encode(table(spark, d, "documents"), "doc_id", "text")


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    from slabwise.llm.common import checkpointed
    from slabwise.llm.packing import pack
    from slabwise.llm.tokens import sizes

    return pack(checkpointed(sizes(table(spark, d, "documents"), "doc_id", "text")), "doc_id", "n_tokens")


_TAGGERS: dict[tuple[str, str], object] = {}


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the sequences of p7_packing are, against the number that no packing can go below."""
    from slabwise.llm.packing import fill

    return fill(p7_packing(spark, d))


def _personal(spark: SparkSession, d: str) -> DataFrame:
    """The tagger is fitted once per application and table, and passed to the scan."""
    from slabwise.llm.personal import scan, train
    from slabwise.llm.tagger import Tagger

    docs, at = table(spark, d, "documents"), (spark.sparkContext.applicationId, d)
    if at not in _TAGGERS:
        _TAGGERS[at] = train(docs, "doc_id", "text", table(spark, d, "given_names")) or Tagger()
    return scan(docs, "doc_id", "text", model=_TAGGERS[at])


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import functions as F

    m = _personal(spark, d).select("doc_id", F.explode("mentions").alias("m"))
    return m.select("doc_id", "m.kind", "m.mention").distinct()


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import functions as F

    return _personal(spark, d).select("doc_id", F.size("mentions").alias("n_mentions"), "redacted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_report": p1_report,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_report": p3_report,
    "p4_found": p4_found,
    "p4_report": p4_report,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p6_ids": p6_ids,
    "p7_packing": p7_packing,
    "p7_fill": p7_fill,
    "p8_found": p8_found,
    "p8_redacted": p8_redacted,
}

ORACLES: dict[str, str] = {
    "p2_found": """
        SELECT case_id, cand_id FROM (
          SELECT case_id, cand_id, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, cand_id) AS r
          FROM (SELECT DISTINCT case_id, cand_id, score FROM candidates
                WHERE case_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)))
        WHERE r <= 4""",
}
