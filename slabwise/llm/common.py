"""Helpers shared by the corpus operators: table access, checkpoints, and vectorised
word hashing over Arrow string buffers."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

WORD = regex.compile(r"[\p{L}\p{N}]+")
MIN_WORDS = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the cluster's shared folder (spark.checkpoint.dir). Only a local session, as in tests,
    may name none and gets a folder of its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not sc.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="slabwise_ckpt_"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint, which survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def balanced(df: DataFrame) -> DataFrame:
    """The frame in a few partitions a core, for work that costs far more than moving the rows; one
    that has as many already, as any large table does, is not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(4 * cores) if df.rdd.getNumPartitions() < 3 * cores else df


def partitions(spark: SparkSession, least: int = 8) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


# ---------------------------------------------------------------------------
# Words as 64-bit hashes, a whole Arrow batch at a time.
# ---------------------------------------------------------------------------

_M = np.uint64
_MULT = _M(0x9E3779B97F4A7C15)
_MIX1 = _M(0xBF58476D1CE4E5B9)
_MIX2 = _M(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> _M(30))
    x = x * _MIX1
    x = x ^ (x >> _M(27))
    x = x * _MIX2
    return x ^ (x >> _M(31))


def _ascii_table() -> np.ndarray:
    """Lower-cased code of each ASCII letter or digit, 0 for anything else."""
    t = np.zeros(256, np.uint8)
    for c in range(128):
        if chr(c).isalnum():
            t[c] = ord(chr(c).lower())
    return t


_TABLE = _ascii_table()
_POWERS = np.cumprod(np.full(4096, _MULT, np.uint64), dtype=np.uint64)


def _hash_bytes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Polynomial hash of each word. data: the words' bytes without gaps; first: where each
    word begins in data."""
    if not len(first):
        return np.empty(0, np.uint64)
    at = np.arange(len(data), dtype=np.int64) - np.repeat(first, lengths)
    terms = (data.astype(np.uint64) + _M(1)) * _POWERS[at & 4095]
    return mix64(np.add.reduceat(terms, first) + lengths.astype(np.uint64) * _MIX2)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of every text, number of words per text).

    A word is a longest run of Unicode letters and digits of the lower-cased text. Pure
    ASCII texts are cut in one vectorised pass over the batch's byte buffer; a text with
    any other character is rewritten by the Unicode rule first and joins the same pass,
    so both kinds get the same hash for the same word. Nulls have no words."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.offset or column.null_count:
        column = pa.concat_arrays([column.fill_null("")])
    n = len(column)
    if not n:
        return np.empty(0, np.uint64), np.zeros(0, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    raw = column.buffers()[2]
    raw = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    high = np.concatenate([[0], np.cumsum(raw >= 128)])
    odd = np.flatnonzero(high[offsets[1:]] > high[offsets[:-1]])
    keep = _TABLE[raw]
    if len(odd):
        pieces, at, lens = [], 0, np.diff(offsets)
        for i in odd:
            pieces.append(keep[at : offsets[i]])
            text = " ".join(WORD.findall(raw[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace").lower()))
            new = np.frombuffer(text.encode(), np.uint8).copy()
            new[new == 32] = 0
            pieces.append(new)
            lens[i] = len(new)
            at = offsets[i + 1]
        pieces.append(keep[at:])
        keep = np.concatenate(pieces)
        offsets = np.concatenate([[0], np.cumsum(lens)])
    inside = keep > 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(keep)]
    begins[edges] = inside[edges]  # a text's first character begins a word even right behind another text's last
    first_at = np.flatnonzero(begins)
    counts = np.searchsorted(first_at, offsets[1:]) - np.searchsorted(first_at, offsets[:-1])
    data = keep[inside]
    dense = np.cumsum(inside) - 1
    first = dense[first_at]
    lengths = np.diff(np.append(first, len(data)))
    return _hash_bytes(data, first_at, lengths, first), counts


def runs(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of n words next to each other, index of its text)."""
    if len(words) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    text = np.repeat(np.arange(len(counts)), counts)
    h = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        h = h * _MULT + words[k : len(words) - n + 1 + k]
    whole = text[: len(h)] == text[n - 1 :]
    return mix64(h[whole]), text[: len(h)][whole]


TEXTS = 2048  # texts in a vectorised step; text number and hash share 64 bits
HASH_BITS = 50


def unique_sets(values: np.ndarray, text: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(50-bit values sorted and unique within each text, their texts, number per text)."""
    key = (text.astype(np.uint64) << _M(HASH_BITS)) | (values >> _M(64 - HASH_BITS))
    key.sort()
    if len(key):
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        key = key[new]
    t = (key >> _M(HASH_BITS)).astype(np.int64)
    return key & _M((1 << HASH_BITS) - 1), t, np.bincount(t, minlength=n_texts)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # shuffle files go when their query has ended


def written(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared checkpoint folder, which cuts the lineage and
    survives lost executors. The shuffle files of its making are removed at once; the folder is removed when the application ends."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    sc = spark.sparkContext
    jvm, at = sc._jvm, f"{sc._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(at)
    finally:
        spark.conf.set(CLEANUP, was) if was is not None else spark.conf.unset(CLEANUP)
    path = jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(at)
