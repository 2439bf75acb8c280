"""Contracts around a generator: what it is asked, how its answers become records, and the batches that
trainers and generators take. The model itself stays outside."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slabwise.functions.text import strip
from slabwise.operators import records as R

Template = Callable[[Column, bool], Column]


def plain_template(conversation: Column, generation_prompt: bool) -> Column:
    """The default rendering: each turn as 'role:', a mark per image, and its text."""
    part = lambda p: F.when(p["type"] == "image", F.lit("<image>")).otherwise(F.coalesce(p["text"], F.lit("")))
    turn = lambda m: F.concat(m["role"], F.lit(":\n"), F.array_join(F.transform(m["content"], part), ""), F.lit("\n"))
    text = F.array_join(F.transform(conversation, turn), "")
    return F.concat(text, F.lit("assistant:\n")) if generation_prompt else text


def render(conversation: Column | str, generation_prompt: bool = False, template: Template | None = None) -> Column:
    """The text of a conversation by a chat template, a function of (conversation, generation_prompt)."""
    c = F.col(conversation) if isinstance(conversation, str) else conversation
    return (template or plain_template)(c, generation_prompt)


def inference_rows(df: DataFrame, most: int = R.MAX_IMAGES) -> DataFrame:
    """(case_id, images, prompt, labels): what a generator needs of a case, the first images only and '{}'
    for missing labels. No other column is read."""
    return df.select("case_id", R.image_prefix("images", most).alias("images"), "prompt", F.coalesce("labels", F.lit("{}")).alias("labels"))


def requests(df: DataFrame, temperatures: list[float], n: int, top_p: float = 0.9) -> DataFrame:
    """A row per case and candidate to be made: df with index, temperature and top_p. The first n
    temperatures are used, so there may be fewer candidates than n."""
    if n < 0:
        raise ValueError("n must not be negative")
    grid = F.array(*[F.lit(float(t)) for t in temperatures[:n]]).cast("array<double>")
    return df.select("*", F.posexplode(grid).alias("index", "temperature")).withColumn("top_p", F.lit(float(top_p)))


def collected(answers: DataFrame, key: list[str], reference: str | None = None) -> DataFrame:
    """(key, candidates) of answers (key, text, temperature, top_p, index): texts stripped, in the order of
    index; the reference column, where it is not empty, stands behind them as one more."""
    item = F.struct("index", strip("text").alias("text"), "temperature", "top_p")
    agg = [F.sort_array(F.collect_list(item)).alias("l")] + ([F.first(reference).alias("_ref")] if reference else [])  # the few answers of one request
    g = answers.groupBy(*key).agg(*agg)
    out = g.withColumn("candidates", F.transform("l", lambda c: F.struct(c["text"].alias("text"), c["temperature"].alias("temperature"), c["top_p"].alias("top_p"), c["index"].alias("index"), F.lit(False).alias("is_reference"))))
    if reference:
        extra = F.struct(F.col("_ref").alias("text"), F.lit(None).cast("double").alias("temperature"), F.lit(None).cast("double").alias("top_p"), F.size("l").alias("index"), F.lit(True).alias("is_reference"))
        out = out.withColumn("candidates", F.when(F.length("_ref") > 0, F.array_append("candidates", extra)).otherwise(F.col("candidates")))
    return out.select(*key, "candidates")


def predictions(answers: DataFrame, case: str = "case_id", text: str = "text") -> DataFrame:
    """(case_id, prediction): answers of an evaluation run, stripped; null texts are empty."""
    return answers.select(F.col(case).alias("case_id"), F.coalesce(strip(text), F.lit("")).alias("prediction"))


def collate(df: DataFrame, batch: str, order: str, kind: str, template: Template | None = None, most: int = R.MAX_IMAGES) -> DataFrame:
    """One row per batch: its texts in order and the images of its rows, flattened in the same order.

    kind pairwise: df has prompt, chosen, rejected, images; gives chosen, rejected, which share the
    images. kind inference: prompt, images, case_id; gives texts that end with the assistant's
    turn open, and case_ids. batch names the batch of a row, so a batch is as large as the caller
    makes it. Null answers render as empty ones."""
    images = R.image_prefix("images", most)
    if kind == "pairwise":
        texts = {k: render(R.conversation("prompt", "images", F.coalesce(k, F.lit("")), most), False, template) for k in ("chosen", "rejected")}
    elif kind == "inference":
        texts = {"texts": render(R.conversation("prompt", "images", None, most), True, template), "case_ids": F.col("case_id")}
    else:
        raise ValueError(f"unknown kind of batch {kind}")
    row = F.struct(F.col(order).alias("o"), *[v.alias(k) for k, v in texts.items()], images.alias("i"))
    g = df.select(F.col(batch).alias(batch), row.alias("r")).groupBy(batch).agg(F.sort_array(F.collect_list("r")).alias("l"))
    return g.select(batch, *[F.col(f"l.{k}").alias(k) for k in texts], F.flatten("l.i").alias("images"))


def trainer_pairs(df: DataFrame, root: str, template: Template | None = None, most: int = R.MAX_IMAGES) -> DataFrame:
    """(prompt, chosen, rejected, images): paths under the root, the first images only, and the prompt
    rendered by the template; the bare prompt without one."""
    path = F.transform(R.image_prefix("images", most), lambda p: F.concat(F.lit(root.rstrip("/") + "/"), p))
    prompt = F.col("prompt") if template is None else render(R.conversation("prompt", "images", None, most), True, template)
    return df.withColumn("prompt", prompt).withColumn("images", path)
