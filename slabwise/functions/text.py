"""Lexical metrics: tokens, n-grams, BLEU, ROUGE."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

from slabwise.functions.vocab import BLANK


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text: Column | str) -> Column:
    """Lower-cased words between white space (Unicode); no empty tokens; null for null."""
    return F.array_remove(F.split(F.lower(col(text)), BLANK), "")


def let(value: Column, body) -> Column:  # noqa: ANN001
    """body(value) with value computed once a row: inside lambdas an expression would be computed
    again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ngrams(words: Column | str, n: int) -> Column:
    """All runs of n words, joined by blanks; an empty array for fewer words."""
    if n == 1:
        return col(words)

    def grams(w: Column) -> Column:
        some = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, some).otherwise(F.array().cast("array<string>"))

    return let(col(words), grams)


def strip(text: Column | str) -> Column:
    """Without white space (Unicode) at either end."""
    return F.regexp_replace(col(text), rf"^{BLANK}|{BLANK}$", "")


def rouge_n(reference: Column | str, hypothesis: Column | str, n: int) -> Column:
    """Recall of the reference's distinct n-grams, from token arrays; 0.0 without any."""
    r, h = F.array_distinct(ngrams(reference, n)), ngrams(hypothesis, n)
    return F.when(F.size(r) > 0, F.size(F.array_intersect(r, h)) / F.size(r)).otherwise(F.lit(0.0))


def _lcs(a: list[str], b: list[str]) -> int:
    """Length of a longest common subsequence, a bit per token of a."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & where.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(IntegerType())
def lcs_length(a, b):  # noqa: ANN001, ANN201
    """Longest common subsequence of two token arrays, Arrow-batched: no built-in has it."""
    import pandas as pd

    return pd.Series([None if x is None or y is None else _lcs(list(x), list(y)) for x, y in zip(a, b)], dtype="Int32")


def rouge_l(reference: Column | str, hypothesis: Column | str) -> Column:
    """LCS length over the reference's tokens, from token arrays; 0.0 for an empty reference."""
    r = col(reference)
    return F.when(F.size(r) > 0, lcs_length(r, col(hypothesis)) / F.size(r)).otherwise(F.lit(0.0))


@F.pandas_udf(ArrayType(LongType()))
def clipped_matches(reference, hypothesis, max_n):  # noqa: ANN001, ANN201
    """For n = 1..max_n the n-grams of the hypothesis that the reference holds too, each at most as often
    as there: row-local counting in Arrow batches, where exploding would shuffle every n-gram."""
    import pandas as pd

    out = []
    for r, h, top in zip(reference, hypothesis, max_n):
        r, h = list(r if r is not None else ()), list(h if h is not None else ())
        found = []
        for n in range(1, int(top) + 1):
            there = Counter(zip(*(r[i:] for i in range(n))))
            found.append(sum(min(c, there[g]) for g, c in Counter(zip(*(h[i:] for i in range(n)))).items()) if there else 0)
        out.append(found)
    return pd.Series(out)


def bleu(df: DataFrame, key: str, reference: str, hypothesis: str, max_n: int = 4) -> DataFrame:
    """(key, bleu_1..bleu_n, bleu) of rows with two token-array columns, one for every row, whatever its
    key. Clipped counts are taken within the row, so nothing is shuffled."""
    base = df.select(key, F.size(reference).alias("_lr"), F.size(hypothesis).alias("_lh"), clipped_matches(reference, hypothesis, F.lit(max_n)).alias("_m"))
    parts = bleu_parts("_m", "_lr", "_lh", max_n)
    return base.select(key, *[v.alias(k) for k, v in parts.items()])


def bleu_parts(matches: Column | str, n_reference: Column | str, n_hypothesis: Column | str, max_n: int = 4) -> dict[str, Column]:
    """bleu_1..bleu_n and bleu of clipped match counts and the two numbers of tokens."""
    m, lr, lh = col(matches), col(n_reference), col(n_hypothesis)
    each = {f"bleu_{n}": F.get(m, F.lit(n - 1)) / F.greatest(lh - (n - 1), F.lit(1)) for n in range(1, max_n + 1)}
    names = list(each.values())
    positive = F.least(*names) > 0 if max_n > 1 else names[0] > 0
    logs = F.lit(0.0)
    for x in names:
        logs = logs + F.ln(F.when(x > 0, x))
    brevity = F.when(lh > lr, F.lit(1.0)).otherwise(F.exp(1 - lr / F.greatest(lh, F.lit(1))))
    return each | {"bleu": F.when(positive, brevity * F.exp(logs / max_n)).otherwise(F.lit(0.0))}


def ngram_counts(df: DataFrame, text: str, n: int) -> DataFrame:
    """(gram, n): how often each n-gram occurs in the whole column."""
    return df.select(F.explode(ngrams(tokens(text), n)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


def shared_ngrams(left: DataFrame, key: str, text: str, right: DataFrame, other: str, n: int) -> DataFrame:
    """(key, n_shared): number of distinct n-grams of each left text that occur in any right text;
    texts without one are left out. N-grams travel as 96 bits of two hashes, and neither side is ever
    broadcast: a small file holds many times its size in n-grams."""

    def hashed(df: DataFrame, *keep: Column) -> DataFrame:
        return df.select(*keep, F.xxhash64(F.lit(1), "g").alias("g1"), F.shiftright(F.xxhash64(F.lit(2), "g"), 32).cast("int").alias("g2"))

    mine = hashed(left.select(F.col(key).alias("_k"), F.explode(F.array_distinct(ngrams(tokens(text), n))).alias("g")), F.col("_k"))
    theirs = hashed(right.select(F.explode(F.array_distinct(ngrams(tokens(other), n))).alias("g"))).distinct()
    return mine.join(theirs.hint("merge"), ["g1", "g2"], "left_semi").groupBy(F.col("_k").alias(key)).agg(F.count("*").alias("n_shared"))
