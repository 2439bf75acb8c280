"""Pairs of texts with a likeness (Jaccard of word triples) of at least a threshold.

One scan turns each text into keys - bands of a SuperMinHash signature, or prefixes (prefixes.py) -
and one small feature row. Keys travel as packed columns, 8 bytes each, to the partition of
their hash; texts that share a key become candidates. A text is known there by a fold of the
hash of its whole triple set, so copies fall together and never make pairs. Candidates are
screened by small sketches, and only what passes is compared exactly, set by set."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from slabwise.llm.common import MIN_WORDS, TEXTS, mix64, partitions, runs, unique_sets, word_hashes, written

U = np.uint64
SLOTS = 48  # of a sketch: four bits of a SuperMinHash slot each
BINS = SLOTS // 2  # bytes of a sketch
ITEM = 5  # bytes by which a text is known in the shuffle
GROUP_BYTES = 64 << 20  # of packed keys that one task gathers
HOT = 512  # texts that share a key: beyond that they are compared in blocks, never paired
BITMAP_BITS = 1 << 23  # of the filter over the texts that are compared exactly: 1 MB


class Texts:
    """The triple sets of a batch: values v of text t, n per text; words and counts as cut."""

    def __init__(self, text: pa.Array, field: np.ndarray):
        self.words, self.counts = word_hashes(text)
        self.size = len(text)
        h, t = runs(self.words, self.counts, 3)
        long = self.counts >= MIN_WORDS
        keep = long[t]
        self.v, self.t, self.n = unique_sets(h[keep], t[keep], self.size)
        self.which = np.flatnonzero(self.n > 0)
        self.first = np.cumsum(self.n)[self.which] - self.n[self.which]
        self.salt = mix64(field.astype(U) + U(1))
        x = mix64(self.v + U(0x1234567))
        self.lo, self.hi = (np.zeros(self.size, U) for _ in range(2))
        if len(self.which):
            self.lo[self.which] = np.add.reduceat(x, self.first)
            self.hi[self.which] = np.add.reduceat(mix64(x), self.first)
        self.lo, self.hi = mix64(self.lo + self.salt), mix64(self.hi ^ self.salt)
        self.item = self.lo >> U(64 - 8 * ITEM)

    def sketches(self, sig: np.ndarray | None = None) -> np.ndarray:
        """BINS bytes per text of x.which: four bits of each of the first SLOTS slots of a signature."""
        sig = superminhash(self, 53) if sig is None else sig
        v = (mix64(sig[:, :SLOTS].astype(U) + U(0x77)) >> U(60)).astype(np.uint8)
        return v[:, ::2] << 4 | v[:, 1::2]


def screen(least: float) -> int:
    """Equal slots of two sketches that a pair must reach: 3.7 standard deviations below what
    a pair of likeness `least` has; at 0.5 a pair is lost here with a probability of 3 in 100,000."""
    p = least + (1 - least) / 16
    return max(0, int(np.floor(SLOTS * p - 3.7 * np.sqrt(SLOTS * p * (1 - p)))))


def equal_slots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Number of equal slots of sketches, over the last axis."""
    d = x ^ y
    return ((d & 15) == 0).sum(-1) + (d < 16).sum(-1)


def superminhash(x: Texts, slots: int, seed: int = 0) -> np.ndarray:
    """SuperMinHash signatures (texts x slots, uint32) of the texts x.which.

    Every element ranks the slots by a permutation of its own (an arithmetic progression modulo
    the prime number of slots) and offers its j-th slot the value j + r with a fresh r in
    [0, 1); a slot keeps the least. Values of round j lie above all of earlier rounds, so
    rounds go over all elements at once and a text leaves as soon as its slots are full. A value
    is the round in 9 bits and r in 23: a text of one element needs as many rounds as slots."""
    if slots > 512:
        raise ValueError("at most 512 slots")
    texts = len(x.which)
    sig = np.full((texts, slots), 0xFFFFFFFF, np.uint32)
    if not texts:
        return sig
    flat = sig.reshape(-1)
    h = mix64(x.v + U(0xABCDEF + 0x1000003 * seed))
    at = ((h & U(0xFFFFFF)) * U(slots) >> U(24)).astype(np.int32)
    step = (((h >> U(24)) & U(0xFFFFFF)) * U(slots - 1) >> U(24)).astype(np.int32) + np.int32(1)
    base = (np.cumsum(x.n > 0) - 1)[x.t].astype(np.int32) * np.int32(slots)
    draw = mix64(h)
    for j in range(slots):
        r = ((draw * U(2 * j + 0x9E3779B97F4A7C15)) >> U(41)).astype(np.uint32) | np.uint32(j << 23)
        np.minimum.at(flat, base + at, r)
        at += step
        at[at >= slots] -= np.int32(slots)
        if j >= 6 and j % 3 == 0:
            open_ = (sig == 0xFFFFFFFF).any(axis=1)
            if not open_.any():
                break
            live = open_[base // slots]
            if live.mean() < 0.7:
                at, step, base, draw = at[live], step[live], base[live], draw[live]
    return sig


def bands(n_bands: int, rows: int, prime: int, seed: int = 0) -> Callable[[Texts], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys: n_bands hashes of `rows` signature slots each; and the signatures. Another seed gives other
    permutations."""

    def keys(x: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        all_ = superminhash(x, prime, seed)
        sig = all_[:, : n_bands * rows].reshape(-1, n_bands, rows)
        h = np.zeros(sig.shape[:2], U)
        for k in range(rows):
            h = (h ^ sig[:, :, k]) * U(0x9E3779B97F4A7C15)
            h ^= h >> U(29)
        h = mix64(h + mix64(np.arange(n_bands, dtype=U) + U(3 + 1000 * seed))[None, :] + x.salt[x.which][:, None])
        return h.reshape(-1), np.repeat(x.which, n_bands), all_

    return keys


_SCAN = "part int, key binary, item binary, side binary, field binary, id binary, lo binary, hi binary, sketch binary"
_OUT = "kind int, a bigint, b bigint, side int, field int, id bigint, hi bigint, sketch binary"


def n_parts(rows: DataFrame, bytes_per_byte: float) -> int:
    """Groups of packed keys, each of about GROUP_BYTES: from the size of the input as Catalyst knows it
    and the bytes that the keys take per byte of input; at least two per shuffle partition. Frames
    of no known size (not read from files) get the least."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return int(min(200_000, max(48, 2 * partitions(rows.sparkSession), 0 if size >= 1 << 58 else size * bytes_per_byte / GROUP_BYTES)))


def packed(items: np.ndarray) -> bytes:
    """The low ITEM bytes of each number."""
    return items.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :ITEM].tobytes()


def unpacked(column: pa.ChunkedArray) -> np.ndarray:
    raw = _joined(column, np.uint8).reshape(-1, ITEM)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :ITEM] = raw
    return out.view("<u8").reshape(-1).astype(U)


def _scan(rows: DataFrame, keys: Callable, parts: int, feature_parts: int) -> DataFrame:
    """rows: (field int, id bigint, side int, text string) -> packed columns by partition: keys
    under 0..parts-1, features (none if feature_parts is 0) from `parts` on. Keys are held back until
    some 64 of them go to each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> list[tuple]:
            h, item = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            held.clear()
            part = ((h >> U(32)) * U(parts) >> U(32)).astype(np.uint32)
            order = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[order], np.arange(parts + 1))
            key, item = h[order].astype(np.uint32), item[order]
            return [(int(p), key[i:j].tobytes(), packed(item[i:j]), None, None, None, None, None, None) for p in np.flatnonzero(np.diff(edges)) for i, j in [(edges[p], edges[p + 1])]]

        def out(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], pa.int32())] + [pa.array([r[k] for r in found], pa.binary()) for k in range(1, 9)], ["part", "key", "item", "side", "field", "id", "lo", "hi", "sketch"])

        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                b = batch.slice(at, TEXTS)
                field, ids, side = (np.asarray(b.column(i)) for i in range(3))
                x = Texts(b.column(3), field)
                if not len(x.which):
                    continue
                h, t, sig = keys(x)
                first = np.zeros(x.size, bool)
                order = np.argsort(x.lo[x.which], kind="stable")
                mine = x.lo[x.which][order]
                first[x.which[order[np.r_[True, mine[1:] != mine[:-1]]]]] = True
                if not first[t].all():  # of copies in one step, one speaks for all
                    h, t = h[first[t]], t[first[t]]
                held.append((h, x.item[t]))
                if feature_parts:
                    w, sk = x.which, x.sketches(sig)
                    group = (x.item[w] % U(feature_parts)).astype(np.int64)
                    yield out([(parts + int(p), None, packed(x.item[w[g]]), side[w[g]].astype(np.uint8).tobytes(), field[w[g]].astype(np.uint8).tobytes(), ids[w[g]].astype(np.int64).tobytes(), x.lo[w[g]].tobytes(), x.hi[w[g]].tobytes(), sk[g].tobytes()) for p in np.unique(group) for g in [np.flatnonzero(group == p)]])
                if sum(len(k[0]) for k in held) >= min(64 * parts, 4 << 20):
                    yield out(flush())
        if held:
            yield out(flush())

    return rows.mapInArrow(run, _SCAN)


def _joined(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def _unique(x: np.ndarray) -> np.ndarray:
    """Sorted different values; sorts x in place, which is faster here than hashing."""
    x.sort()
    keep = np.ones(len(x), bool)
    keep[1:] = x[1:] != x[:-1]
    return x[keep]


def _same_key(key: np.ndarray, item: np.ndarray, hot: int) -> tuple[np.ndarray, ...]:
    """Unique pairs (a, b) of different items with the same key, and the rows (key, item) of keys that
    more than `hot` items share, which are left unpaired. Copies of a text are one item, so
    they are dropped first, however many there are."""
    items, small = np.unique(item, return_inverse=True)
    both = _unique((key.astype(U) << U(32)) | small.astype(U))
    starts = np.flatnonzero(np.r_[True, both[1:] >> U(32) != both[:-1] >> U(32)]) if len(both) else np.empty(0, np.int64)
    sizes = np.diff(np.r_[starts, len(both)])
    rest = both[:0]
    if (sizes > hot).any():
        crowded = np.repeat(sizes > hot, sizes)
        rest, both = both[crowded], both[~crowded]
    low = U(0xFFFFFFFF)
    many = (rest >> U(32)).astype(np.int64), items[(rest & low).astype(np.int64)].astype(np.int64)
    n = len(both)
    key, item = both >> U(32), both & low
    found: list[np.ndarray] = []
    at, d = np.arange(n), 0
    while True:
        d += 1
        at = at[at + d < n]
        at = at[key[at] == key[at + d]]
        if not len(at):
            break
        found.append((item[at] << U(32)) | item[at + d])  # items ascend within a key
        if sum(map(len, found)) > 1 << 22:
            found = [_unique(np.concatenate(found))]
    pairs = _unique(np.concatenate(found)) if found else np.empty(0, U)
    return (*(items[(x & low).astype(np.int64)].astype(np.int64) for x in (pairs >> U(32), pairs)), *many)


def _reduce(scan: DataFrame, parts: int, hot: int) -> DataFrame:
    names = ["kind", "a", "b", "side", "field", "id", "hi", "sketch"]

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        item = unpacked(table.column("item"))
        if part < parts:
            a, b, k, i = _same_key(_joined(table.column("key"), np.uint32), item, hot)
            n = len(a) + len(k)
            kind = np.r_[np.zeros(len(a), np.int32), np.full(len(k), 2, np.int32)]
            return pa.table([pa.array(kind), pa.array(np.r_[a, k | (part << 32)]), pa.array(np.r_[b, i]), *(pa.nulls(n, x) for x in (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names)
        side, field = _joined(table.column("side"), np.uint8), _joined(table.column("field"), np.uint8)
        sketch = b"".join(table.column("sketch").to_pylist())
        sketches = pa.Array.from_buffers(pa.binary(BINS), len(item), [None, pa.py_buffer(sketch)]).cast(pa.binary())
        ids, lo, hi = (_joined(table.column(c), np.int64) for c in ("id", "lo", "hi"))
        return pa.table([pa.array(np.ones(len(item), np.int32)), pa.array(item.astype(np.int64)), pa.array(lo), pa.array(side.astype(np.int32)), pa.array(field.astype(np.int32)), pa.array(ids), pa.array(hi), sketches], names)

    return scan.groupBy("part").applyInArrow(run, _OUT)


def candidates(rows: DataFrame, rounds: list[tuple[Callable, float]], hot: int = HOT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(features, candidate pairs of items, rows (key, item) of crowded keys) of rows (field, id, side, text).
    rounds: functions from texts to keys, and the bytes that each takes per byte of input; each is a scan
    of its own, whose keys are gone from the disk before the next, and the first gives the features."""
    features, pairs, many = None, None, None
    for keys, share in rounds:
        parts = n_parts(rows, share)
        feature_parts = 0 if features is not None else max(4, parts // 12)
        t = written(_reduce(_scan(rows, keys, parts, feature_parts), parts, hot))
        if features is None:
            features = t.filter("kind = 1").select("field", "side", "id", F.col("a").alias("item"), F.col("b").alias("lo"), "hi", "sketch")
        p, m = t.filter("kind = 0").select("a", "b"), t.filter("kind = 2").select(F.col("a").alias("key"), F.col("b").alias("item"))
        pairs, many = (p, m) if pairs is None else (pairs.unionByName(p), many.unionByName(m))
    return features, pairs.distinct(), many


@F.pandas_udf(IntegerType())
def _agreement(a, b):  # noqa: ANN001, ANN202
    """Number of equal slots of two sketches."""
    import pandas as pd

    x = np.frombuffer(b"".join(a), np.uint8).reshape(-1, BINS)
    y = np.frombuffer(b"".join(b), np.uint8).reshape(-1, BINS)
    return pd.Series(equal_slots(x, y).astype(np.int32))


def _crowded(many: DataFrame, classes: DataFrame, least: float, sided: bool, hot: int) -> DataFrame:
    """(field, ca, cb) of classes that share a crowded key and pass the screen. many: (key, item)."""
    m = many.distinct().join(classes.select("item", "field", "side", "class", "sketch"), "item")
    return _in_blocks(m.select("key", "field", "side", "class", "sketch"), least, sided, hot)


def _in_blocks(m: DataFrame, least: float, sided: bool, hot: int) -> DataFrame:
    """(field, ca, cb) of classes of one field that share a key and pass the screen, whatever the number
    that shares it. m: (key, field, side, class, sketch).

    The members of a key are dealt into blocks of about `hot`, and block meets block: each pair of
    blocks has a key of its own, under which the two meet, so the pairs of one crowded key
    spread over all tasks. Their sketches are compared in numpy, and only what passes comes
    out: no task or shuffle ever holds all pairs of a key."""
    n = m.groupBy("key", "field").agg(F.ceil(F.count("*") / F.lit(hot)).alias("nb"))
    dealt = m.join(n, ["key", "field"]).withColumn("blk", F.pmod(F.xxhash64("class"), F.col("nb")))
    blocks = dealt.groupBy("key", "field", "side", "blk", "nb").agg(F.collect_list(F.struct("class", "sketch")).alias("l"))  # about `hot` each
    blocks = written(blocks.select("key", "field", "side", "blk", "nb", F.col("l.class").alias("c"), F.col("l.sketch").alias("s")))
    to, each = F.explode(F.sequence("blk", F.col("nb") - 1)), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("nb") - 1))
    every, up = F.sequence(F.lit(0).cast("bigint"), F.col("nb") - 1), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blk")))
    if sided:
        left = blocks.filter("side = 0").select("key", "field", "blk", F.explode(every).alias("blk2"), "c", "s")
        right = blocks.filter("side = 1").select("key", "field", each.alias("blk"), F.col("blk").alias("blk2"), F.col("c").alias("c2"), F.col("s").alias("s2"))
    else:
        left = blocks.select("key", "field", "blk", to.alias("blk2"), "c", "s")
        right = blocks.select("key", "field", up.alias("blk"), F.col("blk").alias("blk2"), F.col("c").alias("c2"), F.col("s").alias("s2"))
    met = left.join(right, ["key", "field", "blk", "blk2"]).select("field", "c", "s", "c2", "s2")
    enough = screen(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                c, c2 = (batch.column(i)[k].values.to_numpy() for i in (1, 3))
                x, y = (np.frombuffer(b"".join(batch.column(i)[k].values.to_pylist()), np.uint8).reshape(-1, BINS) for i in (2, 4))
                field = batch.column(0)[k].as_py()
                for at in range(0, len(x), 64):
                    i, j = np.nonzero(equal_slots(x[at : at + 64, None], y[None]) >= enough)
                    keep = c[at + i] != c2[j]
                    i, j = c[at + i[keep]], c2[j[keep]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), field, np.int32)), pa.array(i), pa.array(j)], ["field", "ca", "cb"])

    return met.mapInArrow(run, "field int, ca bigint, cb bigint")


@F.pandas_udf(DoubleType())
def _jaccard(a, b):  # noqa: ANN001, ANN202
    """Likeness of two sorted unique sets, packed as int64."""
    import pandas as pd

    out = np.zeros(len(a))
    for i, (p, q) in enumerate(zip(a, b)):
        x, y = np.frombuffer(p, np.int64), np.frombuffer(q, np.int64)
        both = np.concatenate([x, y])
        both.sort()
        same = int((both[1:] == both[:-1]).sum())
        out[i] = same / (len(both) - same)
    return pd.Series(out)


def _bitmap(ids: DataFrame) -> np.ndarray:
    """A bitmap of BITMAP_BITS over hashed (field, id): at most BITMAP_BITS / 32 rows reach the driver."""
    h = F.pmod(F.xxhash64("field", "id"), F.lit(BITMAP_BITS))
    words = ids.select(h.alias("h")).groupBy((F.floor(F.col("h") / 32)).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(h, 32) as int)))").alias("m"))
    out = np.zeros(BITMAP_BITS // 32, np.uint32)
    got = words.toPandas()
    out[got["w"].to_numpy()] = got["m"].to_numpy().astype(np.uint32)
    return out


def triple_sets(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(field, id, triples BINARY) of the texts in ids: a fixed-size bitmap drops nearly all other
    rows during the scan, so that texts are never shuffled; a join drops the rest."""
    bits = rows.sparkSession.sparkContext.broadcast(_bitmap(ids))
    tagged = rows.select("field", "id", "text", F.pmod(F.xxhash64("field", "id"), F.lit(BITMAP_BITS)).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.asarray(batch.column(3))
            batch = batch.filter(pa.array((bits.value[h >> 5] >> (h & 31).astype(np.uint32) & 1).astype(bool)))
            for at in range(0, batch.num_rows, TEXTS):
                b = batch.slice(at, TEXTS)
                x = Texts(b.column(2), np.asarray(b.column(0)))
                ends = np.cumsum(x.n)
                raw = x.v.astype(np.int64)
                sets = [raw[e - n : e].tobytes() for e, n in zip(ends[x.which], x.n[x.which])]
                take = pa.array(x.which)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(sets, pa.binary())], ["field", "id", "triples"])

    found = tagged.mapInArrow(run, "field int, id bigint, triples binary")
    return found.join(ids.select("field", "id"), ["field", "id"], "left_semi")


def similar_classes(rows: DataFrame, keys: Callable | list[tuple[Callable, float]], least: float, sided: bool = False, hot: int = HOT, closed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (field, side, id, class) has every eligible text with the smallest
    id among its equals (same triple set, field and side) as its class; links (field, class_a,
    class_b, likeness) every pair of different classes of one field found with likeness >= least
    (sided: one of side 0 and one of side 1, and keys(rows, least, hot) gives what candidates
    gives; else keys are the rounds of candidates). Rows with a null in field, id, side or text and
    texts of fewer than 20 words are in neither; repeated rows count once."""
    rows = rows.select("field", "id", "side", "text").dropna()
    features, pairs, many = keys(rows, least, hot) if sided else candidates(rows, keys, hot=hot)
    by = ["field", "side", "lo", "hi"]
    classes = features.groupBy(*by).agg(F.min("id").alias("class"), F.first("item").alias("item"), F.first("sketch").alias("sketch"))
    classes = written(classes)
    members = features.select(*by, "id").distinct().join(classes.select(*by, "class"), by).select("field", "side", "id", "class")

    a = classes.select(F.col("item").alias("a"), F.col("field").alias("fa"), F.col("side").alias("sa"), F.col("class").alias("ca"), F.col("sketch").alias("ka"))
    b = classes.select(F.col("item").alias("b"), F.col("field").alias("fb"), F.col("side").alias("sb"), F.col("class").alias("cb"), F.col("sketch").alias("kb"))
    met = pairs.join(a, "a").join(b, "b").filter("fa = fb AND (sa <> sb)" if sided else "fa = fb")
    near = met.filter(_agreement("ka", "kb") >= screen(least)).select(F.col("fa").alias("field"), "ca", "cb")
    if many.limit(1).count():
        near = near.unionByName(_crowded(many, classes, least, sided, hot))
    if sided:  # equal sets on the two sides have one item
        same = classes.groupBy("field", "lo", "hi").agg(F.min(F.when(F.col("side") == 0, F.col("class"))).alias("ca"), F.min(F.when(F.col("side") == 1, F.col("class"))).alias("cb"))
        near = near.unionByName(same.filter("ca IS NOT NULL AND cb IS NOT NULL").select("field", "ca", "cb"))
    near = written(near.select("field", F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")).distinct())

    links = verified(rows, near, least)
    if closed:  # texts that are linked to the same text are candidates too
        links = written(links)
        ends = links.select("field", F.col("class_a").alias("key"), F.col("class_b").alias("class")).unionByName(links.select("field", F.col("class_b").alias("key"), F.col("class_a").alias("class")))
        shared = ends.groupBy("field", "key").agg(F.count("*").alias("n")).filter("n > 1")
        m = ends.join(shared.select("field", "key"), ["field", "key"], "left_semi").join(classes.select("field", "class", "side", "sketch"), ["field", "class"])
        more = _in_blocks(m.select("key", "field", "side", "class", "sketch"), least, False, hot).select("field", F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")).distinct()
        more = written(more.join(near, ["field", "ca", "cb"], "left_anti"))
        links = links.unionByName(verified(rows, more, least))
    return members, links


def verified(rows: DataFrame, near: DataFrame, least: float) -> DataFrame:
    """(field, class_a, class_b, likeness, n_a, n_b: triples of each) of the candidates (field, ca, cb) whose exact likeness is at
    least `least`. AQE splits the partition of a text that
    has many candidates."""
    ids = near.select("field", F.explode(F.array("ca", "cb")).alias("id")).distinct()
    sets = triple_sets(rows, ids).dropDuplicates(["field", "id"])
    left = sets.select("field", F.col("id").alias("ca"), F.col("triples").alias("ta"))
    right = sets.select("field", F.col("id").alias("cb"), F.col("triples").alias("tb"))
    out = near.join(left, ["field", "ca"]).join(right, ["field", "cb"]).withColumn("likeness", _jaccard("ta", "tb")).filter(F.col("likeness") >= least)
    return out.select("field", F.col("ca").alias("class_a"), F.col("cb").alias("class_b"), "likeness", (F.length("ta") / 8).cast("int").alias("n_a"), (F.length("tb") / 8).cast("int").alias("n_b"))


def groups(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, group): connected components of an undirected graph, group being the smallest node.

    Alternates large-star and small-star steps, each one shuffle with combining aggregates, on
    edges that are written between rounds; the number of rounds grows with the logarithm of
    the graph's size, and no component is ever gathered in one task or on the driver."""
    edges = written(links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct())
    last = None
    while True:
        # large star: every neighbour above u goes to the smallest of u's neighbourhood
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the lower neighbours of u and u itself go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = written(small)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    out = edges.groupBy("u").agg(F.min("v").alias("group"))
    roots = edges.select(F.col("v").alias("u")).distinct().join(out.select("u"), "u", "left_anti").withColumn("group", F.col("u"))
    return out.unionByName(roots).select(F.col("u").alias("node"), "group")
