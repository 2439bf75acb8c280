"""Texts cut off by field limits or broken transfers (problem 1).

Two kinds of evidence, both over all rows:

* limits: per field and source, the histograms of length in characters and in UTF-8 bytes
  are searched for spikes at the maximum - a length that far more texts have than its
  neighbours, with an excess of texts that lack terminal punctuation, and that hardly any text
  exceeds. Such a text at such a length is cut, whatever its last words are.
* broken transfers stop anywhere. A text without terminal punctuation is cut unless its last
  segment is a closing remark, that is, one that follows many different texts word for word
  (digits masked). A text that stops behind the point of a decimal number is found from the
  words that the corpus puts before decimals and before final numbers.

Every threshold is a share or a ratio, so a text is judged alike in a small and a large table.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slabwise.llm.common import checkpointed

REMARK_SHARE = 0.005  # of a field's open texts: a segment that closes such a share of different texts is a remark
REMARK_LEAST = 3  # different texts behind which a remark stands at least
SPIKE_FACTOR = 4.0  # times the mean of the 8 lengths around
SPIKE_LEAST = 4
LONGER = 0.1  # times the texts at a limit: at most so many may be longer
WHOLE_WORDS = 5  # an answer of fewer words, off a limit and without a mark of cutting, has lost nothing

#: Marks that cutting leaves behind, and what may close a sentence.
_BLANK = r"[\s\p{Z}​﻿]"
_MARKS = r"(?:…|\.{3,}|�|\[(?:\.{3}|…|truncated|cut(?: off)?|gekürzt)\]|\((?:\.{3}|…|truncated|cut(?: off)?|gekürzt)\))"
_CLOSED = r"[.!?。！？؟][\"'”’»)\]*_]*$"


def _trimmed(text: Column) -> Column:
    return F.expr("trim(trailing {} from {})".format("' \\t\\n\\r\\f\\u000b\\u0085\\u00a0\\u2028\\u2029\\u200b\\ufeff\\u3000'", text))


def _closed(text: Column) -> Column:
    """Whether the text ends as _CLOSED says, which its last character mostly tells."""
    ends = lambda marks: reduce(or_, [F.endswith(text, F.lit(m)) for m in marks])
    return F.when(ends(".!?。！？؟"), F.lit(True)).when(ends("\"'”’»)]*_\n\r\u0085\u2028\u2029"), text.rlike(_CLOSED)).otherwise(F.lit(False))


def tails(rows: DataFrame) -> DataFrame:
    """rows: (field, rec_id, source, text). One row per non-null text with its lengths and how
    it ends: closed (terminal punctuation), tail (last segment in lower case, digits masked), decimal (the
    word before a final number, '' without one), marked (ends in a mark of cutting), words."""
    d = rows.filter(F.col("text").isNotNull()).withColumn("_all", _trimmed("text"))
    may = F.right("_all", F.lit(1)).isin("…", "�", "]", ")") | F.endswith("_all", F.lit("..."))  # only such ends go through the pattern
    d = d.withColumn("_body", F.when(may, F.regexp_replace("_all", rf"(?:{_BLANK}{{0,3}}{_MARKS})+$", "")).otherwise(F.col("_all")))
    closed = _closed(F.col("_body"))
    segment = F.element_at(F.split("_all", r"(?=\s)(?<=[.!?。！？؟][\"'”’»)\]*_]{0,3})\s+|\n"), -1)
    number = F.when(F.right("_body", F.lit(4)).rlike(r"[0-9]\.$"), F.regexp_extract("_body", r"(?<![\p{L}±])([\p{L}±]++)\s[0-9]++\.$", 1)).otherwise(F.lit(""))
    return d.select(
        "field", "rec_id", "source", F.length("text").cast("bigint").alias("chars"), F.octet_length("text").cast("bigint").alias("bytes"), closed.alias("closed"),
        F.when(~closed, F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(segment, r"\d", "0"), r"\s+", " "), r" (?=[,.;:!?)])", "")))).alias("tail"),
        F.when(~closed, F.xxhash64(F.expr("left(_all, greatest(length(_all) - 40, 0))"))).alias("head"),
        F.when(~closed, F.size(F.array_remove(F.split("_body", r"\s+"), ""))).alias("words"), (F.length("_body") < F.length("_all")).alias("marked"),
        F.when(closed, number).otherwise(F.lit("")).alias("decimal"),
    )


def spikes(t: DataFrame) -> DataFrame:
    """(field, source, unit, at, n, n_open, near, n_longer) of each length with a spike of open texts at the
    maximum. unit is chars or bytes; near: mean number at the 8 lengths around; n_longer: texts
    of the field and source beyond it. The histogram has a row per length, not per text."""
    lengths = t.select("field", "source", "closed", F.explode(F.create_map(F.lit("chars"), F.col("chars"), F.lit("bytes"), F.col("bytes"))).alias("unit", "at"))
    h = lengths.groupBy("field", "source", "unit", "at").agg(F.count("*").alias("n"), F.count_if(~F.col("closed")).alias("n_open"))
    by = Window.partitionBy("field", "source", "unit").orderBy("at")
    h = h.withColumn("near", (F.sum("n_open").over(by.rangeBetween(-4, 4)) - F.col("n_open")) / F.lit(8.0))
    h = h.withColumn("n_longer", F.coalesce(F.sum("n").over(by.rangeBetween(1, Window.unboundedFollowing)), F.lit(0)))
    return h.filter((F.col("n_open") >= SPIKE_LEAST) & (F.col("n_open") > SPIKE_FACTOR * F.greatest("near", F.lit(0.5))) & (F.col("n_longer") <= LONGER * F.col("n")))


def remarks(loose: DataFrame) -> DataFrame:
    """(tail) of every closing remark: at least two words, no heading, behind enough different texts of
    some field. loose: open texts of no limit length, at which the same words recur by cutting
    alone. Copies of one text count once, so a text that was copied often is no remark."""
    named = loose.filter(F.col("tail").rlike(r"\S\s+\S") & ~F.col("tail").rlike(r":\W*$"))
    heads = named.groupBy("field", "tail", "head").agg(F.lit(1).alias("_one"))
    counts = heads.groupBy("field", "tail").agg(F.count("*").alias("_n"))
    total = counts.groupBy("field").agg(F.sum("_n").alias("_all"))
    return counts.join(total, "field").filter((F.col("_n") >= REMARK_LEAST) & (F.col("_n") >= REMARK_SHARE * F.col("_all"))).select("tail").distinct()


def decimal_words(rows: DataFrame) -> DataFrame:
    """(word, inside, final): how often the corpus writes 'word 1.5' and 'word 1.' at an end."""
    found = rows.filter(F.col("text").isNotNull()).select(F.explode(F.expr(r"regexp_extract_all(text, '(?<![\\p{L}±])([\\p{L}±]++\\s[0-9]++\\.(?:[0-9]|\\s|$))', 1)")).alias("m"))
    parts = found.select(F.regexp_extract("m", r"^([\p{L}±]+)", 1).alias("decimal"), F.col("m").rlike(r"\.[0-9]$").alias("_in"))
    return parts.groupBy("decimal").agg(F.count_if("_in").alias("inside"), F.count_if(~F.col("_in")).alias("final"))


def unfinished(rows: DataFrame) -> DataFrame:
    """(field, rec_id, source, chars, bytes, at_limit, reason) of every unfinished text.

    rows: (field, rec_id, source, text); other columns are ignored. reason is limit (no terminal
    punctuation at a limit), open (none, and no closing remark) or decimal (stops inside a decimal
    number). Null and blank texts are not unfinished, nor are answers of a few words, unless they
    stand at a limit or carry a mark of cutting behind some word; rows without a field or an id are left out; very long texts are taken whole; repeated rows give one row."""
    rows = rows.select("field", "rec_id", "source", "text").filter(F.col("field").isNotNull() & F.col("rec_id").isNotNull())
    t = checkpointed(tails(rows))  # narrow: no texts
    limits = spikes(t).select("field", "source", "unit", "at")
    by_chars = limits.filter("unit = 'chars'").select(F.col("field").alias("_f"), F.col("source").alias("_s"), F.col("at").alias("_at"), F.lit(True).alias("_c"))
    by_bytes = limits.filter("unit = 'bytes'").select(F.col("field").alias("_f2"), F.col("source").alias("_s2"), F.col("at").alias("_at2"), F.lit(True).alias("_b"))
    s = t.filter(~F.col("closed"))
    s = s.join(by_chars, (F.col("field") == F.col("_f")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("chars") == F.col("_at")), "left")
    s = s.join(by_bytes, (F.col("field") == F.col("_f2")) & F.col("source").eqNullSafe(F.col("_s2")) & (F.col("bytes") == F.col("_at2")), "left")
    at_limit = F.coalesce(F.col("_c"), F.lit(False)) | F.coalesce(F.col("_b"), F.lit(False))
    loose = s.select("field", "rec_id", "source", "chars", "bytes", "tail", "head", "words", "marked", at_limit.alias("at_limit")).filter("words > 0")
    elsewhere = loose.filter(~F.col("at_limit"))
    open_ = elsewhere.filter((F.col("words") >= WHOLE_WORDS) | (F.col("marked") & (F.col("words") > 1))).join(remarks(elsewhere), "tail", "left_anti")
    suspects = loose.filter("at_limit").select(*open_.columns).unionByName(open_)
    out = suspects.select("field", "rec_id", "source", "chars", "bytes", "at_limit", F.when(F.col("at_limit"), "limit").otherwise("open").alias("reason"))
    inner = t.filter(F.col("decimal") != "").join(decimal_words(rows), "decimal").filter(F.col("inside") > 20 * F.col("final"))
    inner = inner.select("field", "rec_id", "source", "chars", "bytes", F.lit(False).alias("at_limit"), F.lit("decimal").alias("reason"))
    return out.unionByName(inner).dropDuplicates(["field", "rec_id"])


def truncation_report(rows: DataFrame) -> DataFrame:
    """(field, source, n_texts, n_unfinished, n_at_limit, share): how often each source cuts. A
    record counts once, however often it was sent."""
    rows = rows.select("field", "rec_id", "source", "text").filter(F.col("field").isNotNull() & F.col("rec_id").isNotNull())
    n = rows.filter(F.col("text").isNotNull()).dropDuplicates(["field", "rec_id"]).groupBy("field", "source").agg(F.count("*").alias("n_texts"))
    u = unfinished(rows).groupBy("field", F.col("source").alias("_s")).agg(F.count("*").alias("n_unfinished"), F.count_if("at_limit").alias("n_at_limit")).withColumnRenamed("field", "_f")
    j = n.join(u, (F.col("field") == F.col("_f")) & F.col("source").eqNullSafe(F.col("_s")), "left")
    zero = F.lit(0).cast("bigint")
    return j.select("field", "source", "n_texts", F.coalesce("n_unfinished", zero).alias("n_unfinished"), F.coalesce("n_at_limit", zero).alias("n_at_limit"), F.round(F.coalesce("n_unfinished", zero) / F.col("n_texts"), 6).alias("share"))
