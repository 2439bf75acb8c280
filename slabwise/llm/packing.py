"""Packing of documents into training sequences of fixed capacity (problem 7)."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CAPACITY = 2048
SALT_ROWS = 1_000_000  # documents of one length that are ranked together


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths of one sequence, number of such sequences) for the histogram
    {length: items} of lengths 1..capacity.

    Lengths are placed longest first. The copies of one length go to the open patterns of
    the shortest filling first; a pattern that more sequences have than copies are left is
    split in two. Only what fits nowhere opens new sequences, and copies of one length may
    share a sequence. Work depends on the number of different lengths, not on items."""
    open_by_room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for length in sorted((x for x in histogram if histogram[x] > 0), reverse=True):
        left = histogram[length]
        fresh: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
        for room in sorted((r for r in open_by_room if r >= length), reverse=True):
            while left and open_by_room[room]:
                pattern, sequences = open_by_room[room].pop()
                fits = room // length
                full = min(sequences, left // fits)
                rest = sequences - full
                if full:
                    fresh[room - fits * length].append((pattern + (length,) * fits, full))
                    left -= full * fits
                if rest and 0 < left < fits:
                    fresh[room - left * length].append((pattern + (length,) * left, 1))
                    rest, left = rest - 1, 0
                if rest:
                    fresh[room].append((pattern, rest))
            if not left:
                break
        if left:
            fits = capacity // length
            if left // fits:
                fresh[capacity - fits * length].append(((length,) * fits, left // fits))
            if left % fits:
                fresh[capacity - (left % fits) * length].append(((length,) * (left % fits), 1))
        for room, patterns in fresh.items():
            open_by_room[room].extend(patterns)
    return [x for room in sorted(open_by_room) for x in open_by_room[room]]


def _places(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[dict[int, tuple[np.ndarray, ...]], int]:
    """({length: (first rank, sequence base, copies per sequence, offset in the sequence) of
    each interval of ranks}, number of sequences)."""
    taken: dict[int, int] = defaultdict(int)
    rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    base = 0
    for pattern, sequences in patterns:
        at = 0
        for length in sorted(set(pattern), reverse=True):
            copies = pattern.count(length)
            rows[length].append((taken[length], base, copies, at))
            taken[length] += copies * sequences
            at += copies * length
        base += sequences
    return {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in rows.items()}, base


def pack(docs: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """Which sequence each document went to: (key, part, part_start, n_tokens, seq_id, seq_offset).

    docs has one row per document with its size in tokens. A document larger than the
    capacity is cut into full parts, each a sequence of its own, and a last part that is
    packed like a whole document; no other document is cut. Sizes null, 0 or less take no
    room: part 0 of 0 tokens, spread evenly over the sequences (sequence 0 when there is
    none). The histogram has at most `capacity` rows, so it is planned on the driver; ranks
    within a length come from salted counts, a salt per million documents of that length, so that
    no length is one task's burden. Repeated
    rows are separate documents; an empty table gives no rows."""
    n = F.greatest(F.coalesce(F.col(f"`{size}`"), F.lit(0)), F.lit(0)).cast("bigint")
    rows = docs.select(F.col(f"`{key}`").alias("_k"), n.alias("_n"))
    whole, rest = F.floor(F.col("_n") / capacity).cast("bigint"), F.pmod("_n", F.lit(capacity).cast("bigint"))
    by_length = {r["_len"]: r["_c"] for r in rows.groupBy(rest.alias("_len")).agg(F.count("*").alias("_c")).collect()}  # at most capacity rows
    salts = [-(-by_length.get(i, 0) // SALT_ROWS) or 1 for i in range(capacity)]
    at = np.cumsum([0] + salts)  # where the salts of each length begin
    ways = F.element_at(F.array(*map(F.lit, salts)), rest.cast("int") + 1) if max(salts) > 1 else F.lit(1)
    items = rows.select("_k", whole.alias("_whole"), rest.alias("_len"), F.pmod(F.xxhash64("_k"), ways).alias("_salt"), "_n")

    counts = items.groupBy("_len", "_salt").agg(F.count("*").alias("_c"), F.sum("_whole").alias("_w")).collect()  # at most capacity + documents / SALT_ROWS rows
    histogram: dict[int, int] = defaultdict(int)
    start, whole_start = (np.zeros(int(at[-1]), np.int64) for _ in range(2))
    n_whole = 0
    for r in sorted(counts, key=lambda r: (r["_len"], r["_salt"])):
        i = at[r["_len"]] + r["_salt"]
        start[i], whole_start[i] = histogram[r["_len"]], n_whole
        histogram[r["_len"]] += r["_c"]
        n_whole += r["_w"]
    places, n_packed = _places(shortest_pack_first({k: v for k, v in histogram.items() if k}, capacity))
    shared = docs.sparkSession.sparkContext.broadcast((places, at, start, whole_start))

    w = Window.partitionBy("_len", "_salt").orderBy("_k")
    ranked = items.withColumn("_rank", F.row_number().over(w) - 1).withColumn("_before", F.sum("_whole").over(w.rowsBetween(Window.unboundedPreceding, -1)))

    @F.pandas_udf("struct<seq: bigint, at: bigint, whole: bigint>")
    def place(length: pd.Series, salt: pd.Series, rank: pd.Series) -> pd.DataFrame:
        places, at_, start, whole_start = shared.value
        ln, s = length.to_numpy(np.int64), salt.to_numpy(np.int64)
        rk = rank.to_numpy(np.int64) + start[at_[ln] + s]
        seq, at = np.zeros(len(ln), np.int64), np.zeros(len(ln), np.int64)
        for x in np.unique(ln):
            if x == 0:
                continue
            here = np.flatnonzero(ln == x)
            lo, base, copies, offset = places[int(x)]
            i = np.searchsorted(lo, rk[here], "right") - 1
            seq[here] = base[i] + (rk[here] - lo[i]) // copies[i]
            at[here] = offset[i] + (rk[here] - lo[i]) % copies[i] * x
        return pd.DataFrame({"seq": seq, "at": at, "whole": whole_start[at_[ln] + s]})

    placed = ranked.withColumn("_p", place("_len", "_salt", "_rank"))
    n_all = n_packed + n_whole
    last = F.struct(
        F.col("_whole").cast("int").alias("part"), (F.col("_whole") * capacity).alias("part_start"), F.col("_len").alias("n_tokens"),
        F.when(F.col("_len") > 0, F.col("_p.seq")).otherwise(F.pmod(F.xxhash64("_k"), F.lit(max(1, n_all)))).alias("seq_id"),
        F.when(F.col("_len") > 0, F.col("_p.at")).otherwise(F.lit(0)).cast("bigint").alias("seq_offset"),
    )
    full = F.transform(
        F.when(F.col("_whole") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("_whole") - 1)).otherwise(F.array().cast("array<bigint>")),
        lambda i: F.struct(
            i.cast("int").alias("part"), (i * capacity).alias("part_start"), F.lit(capacity).cast("bigint").alias("n_tokens"),
            (F.lit(n_packed) + F.col("_p.whole") + F.coalesce("_before", F.lit(0)) + i).alias("seq_id"), F.lit(0).cast("bigint").alias("seq_offset"),
        ),
    )
    tail = F.when((F.col("_len") > 0) | (F.col("_whole") == 0), F.array(last)).otherwise(F.array().cast("array<struct<part:int,part_start:bigint,n_tokens:bigint,seq_id:bigint,seq_offset:bigint>>"))
    return placed.select(F.col("_k").alias(key), F.explode(F.concat(full, tail)).alias("_x")).select(key, "_x.*")


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(n_sequences, n_tokens, least_sequences, fill) of what pack gives: the sequences used, the tokens in
    them, the number that no packing can go below, and tokens over the room of the sequences."""
    g = packed.agg(F.countDistinct("seq_id").alias("n_sequences"), F.coalesce(F.sum("n_tokens"), F.lit(0)).cast("bigint").alias("n_tokens"))
    return g.withColumn("least_sequences", F.ceil(F.col("n_tokens") / capacity)).withColumn("fill", F.round(F.col("n_tokens") / (F.greatest("n_sequences", F.lit(1)) * capacity), 6))
