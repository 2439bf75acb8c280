"""Top-N, near-duplicates, groups and overlap against brute force; edge cases of each."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from slabwise.llm import common as C
from slabwise.llm import prefixes as P
from slabwise.llm.duplicates import duplicate_groups, duplicate_pairs, near_duplicates
from slabwise.llm.overlap import cross_split, image_names, same_text
from slabwise.llm.similar import Texts, groups, superminhash
from slabwise.llm.topn import top_n

WORDS = [f"w{i}" for i in range(4000)]


def triples(t):
    w = re.findall(r"[^\W_]+", t.lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 20 else set()


def like(a, b):
    x, y = triples(a), triples(b)
    return len(x & y) / len(x | y) if x and y else 0.0


def family(rng, n, size, edits):
    """Texts in families whose members differ by a few replaced words."""
    out = []
    for _ in range(n):
        base = [rng.choice(WORDS) for _ in range(rng.randint(25, 90))]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            out.append(" ".join(w))
    return out


def test_top_n_hot_and_cold(spark):
    rng = random.Random(1)
    rows = [("hot", i, rng.choice([0.1, 0.5, 0.9, float("nan"), None])) for i in range(3000)] + [(f"g{i % 40}", 5000 + i, rng.choice([0.2, 0.4])) for i in range(200)]
    rows += [(None, 9000, 1.0), ("few", 9001, 0.3), ("none", 9002, None), ("zero", 9003, -0.0), ("zero", 9004, 0.0)] + rows[:50]
    df = spark.createDataFrame(rows, "case_id string, cand_id int, score double").withColumn("_g", F.lit(1)).withColumn("_s", F.lit("x")).withColumn("_n", F.lit(2))
    best = defaultdict(set)
    for g, i, s in rows:
        if g is not None and s is not None and s == s:
            best[g].add((-s, i))
    want = {(g, i) for g, x in best.items() for _, i in sorted(x)[:4]}
    for hot_rows in (100, 10_000):
        got = [tuple(r) for r in top_n(df, "case_id", "score", "cand_id", 4, hot_rows=hot_rows, salt_rows=200).select("case_id", "cand_id").collect()]
        assert len(got) == len(set(got)) and set(got) == want
    import slabwise.llm.topn as topn

    most, topn.MOST_HOT = topn.MOST_HOT, 3
    try:  # more hot groups than may be broadcast
        got = [tuple(r) for r in top_n(df, "case_id", "score", "cand_id", 4, hot_rows=3, salt_rows=2).select("case_id", "cand_id").collect()]
        assert len(got) == len(set(got)) and set(got) == want
    finally:
        topn.MOST_HOT = most
    assert top_n(df.limit(0), "case_id", "score", "cand_id", 4).count() == 0
    assert top_n(df, "case_id", "score", "cand_id", 0).count() == 0
    with pytest.raises(ValueError):
        top_n(df, "case_id", "score", "cand_id", -1)


def test_words_are_cut_alike_in_every_batch():
    texts = ["Hello, World-2 x", None, "", "  ", "Größe ﬁx 漢字 déjà", "a" * 9000 + " b", "Hello", "World 2", "İstanbul I", "x"]
    h, n = C.word_hashes(pa.array(texts))
    assert n.tolist() == [4, 0, 0, 0, 4, 2, 1, 2, len(C.WORD.findall("İstanbul I".lower())), 1]
    assert h[0] == h[10] and h[1] == h[11] and h[2] == h[12] and h[3] == h[-1]
    for t in texts:
        if t:
            one, _ = C.word_hashes(pa.array([t]))
            two, _ = C.word_hashes(pa.array(["zz " + t, t]))
            assert (one == two[-len(one) :]).all() if len(one) else True
    assert C.word_hashes(pa.array([], pa.string()))[1].tolist() == []
    assert C.word_hashes(pa.array(["a b", "c"]).slice(1))[1].tolist() == [1]


def test_superminhash_estimates_likeness():
    rng = random.Random(3)
    a = [" ".join(rng.choice(WORDS) for _ in range(80)) for _ in range(300)]
    b = [" ".join(x.split()[:50] + [rng.choice(WORDS) for _ in range(30)]) for x in a]
    x = Texts(pa.array(a + b), np.zeros(600, np.int32))
    sig = superminhash(x, 281)
    same = (sig[:300] == sig[300:]).mean(1)
    true = np.array([like(p, q) for p, q in zip(a, b)])
    assert abs((same - true).mean()) < 0.01 and (same - true).std() < np.sqrt((true * (1 - true)).mean() / 281) * 1.05


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(7)
    texts = family(rng, 60, 4, 9) + ["short text", "", "  ", "x" * 50_000]
    rows = [(i % 2, i // 2, t) for i, t in enumerate(texts)] + [(0, 900, texts[0].upper()), (0, 901, texts[0]), (0, 902, None), (1, 903, texts[0]), (0, 901, texts[0])]
    df = spark.createDataFrame(rows, "field int, id long, text string").withColumn("side", F.lit("clash")).withColumn("lo", F.lit(5)).repartition(5)
    by = defaultdict(dict)
    for f, i, t in rows:
        by[f][i] = t or ""
    want = {(f, a, b) for f, d in by.items() for a in d for b in d if a < b and like(d[a], d[b]) >= 0.5}
    members, links = near_duplicates(df, 0.5)
    got = [tuple(r) for r in duplicate_pairs(members, links).collect()]
    assert len(got) == len(set(got)) and set(got) <= want
    assert len(want - set(got)) <= 0.02 * len(want)
    sure = {p for p in want if like(by[p[0]][p[1]], by[p[0]][p[2]]) >= 0.65}
    assert sure <= set(got)
    g = {(r["field"], r["id"]): r for r in duplicate_groups(members, links).collect()}
    assert len(g) == members.count() and g[(0, 900)]["group"] == g[(0, 0)]["group"] and g[(0, 900)]["class"] == g[(0, 901)]["class"] == 0
    empty = near_duplicates(df.limit(0), 0.5)
    assert empty[0].count() == 0 and duplicate_groups(*empty).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(45)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["group"] for r in groups(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {n: find(n) for n in parent}
    assert groups(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_cross_split_against_all_pairs(spark):
    rng = random.Random(11)
    texts = family(rng, 40, 4, 10)
    rows = []
    for i, t in enumerate(texts):
        case = rng.choice([f"Case_{i // 8}", f" case-{i // 8} ", f"other{i}", None, "", "--"])
        images = rng.choice([None, [], [f"/data/p{i // 6}/{k}.PNG" for k in range(4)], [f"p{i // 6}\\{k}.png" for k in (0, 1, 2, 7)], [f"./P{i // 6}/0.png", None, f"p{i // 6}/0.png"]])
        rows.append((i, case, images, rng.choice([t, t, t, None, ""]), rng.choice(["train", "train", "val", "test", None])))
    rows += rows[:5]
    df = spark.createDataFrame(rows, "rec_id long, case_id string, images array<string>, response string, split_name string").withColumn("id", F.lit(1)).withColumn("side", F.lit("z"))

    def key(c):
        return re.sub(r"[\W_]", "", (c or "").lower())

    def names(x):
        return {"/".join([p for p in re.split(r"[/\\]+", i.strip().lower()) if p not in ("", ".")][-2:]) for i in x or [] if i}

    want = set()
    for a, ca, ia, ta, sa in rows:
        for b, cb, ib, tb, sb in rows:
            if sa == "train" and sb in ("val", "test"):
                x, y = names(ia), names(ib)
                if key(ca) and key(ca) == key(cb) or like(ta or "", tb or "") >= 0.5 or x and y and len(x & y) >= 0.5 * len(x | y):
                    want.add((a, b))
    found = cross_split(df, "rec_id", "split_name", "case_id", "response", "images").collect()
    got = [(r["a"], r["b"]) for r in found]
    assert len(got) == len(set(got)) and set(got) == want
    by_id = {r[0]: r[3] for r in rows}
    for r in found:
        x, y = triples(by_id[r["a"]] or ""), triples(by_id[r["b"]] or "")
        assert r["containment"] is None if not r["by_text"] else r["containment"] == pytest.approx(len(x & y) / len(y))
    assert cross_split(df.limit(0), "rec_id", "split_name", "case_id", "response", "images").count() == 0


def test_image_names(spark):
    df = spark.createDataFrame([(["/a/B/c.png", "x\\b\\C.PNG", None, "", " c.png "],), ([],), (None,)], "i array<string>")
    assert [r[0] for r in df.select(image_names(F.col("i"))).collect()] == [["b/c.png", "c.png"], [], None]


def test_copies_of_a_third_of_all_rows(spark):
    rng = random.Random(21)
    texts = family(rng, 30, 2, 3)
    copy = " ".join(rng.choice(WORDS) for _ in range(50))
    near = copy.rsplit(" ", 2)[0] + " else where"
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").unionByName(spark.range(10_000, 16_000).select("id", F.lit(copy).alias("text"))).unionByName(spark.range(90_000, 90_001).select("id", F.lit(near).alias("text")))
    members, links = near_duplicates(df.withColumn("field", F.lit(0)), 0.5)
    g = duplicate_groups(members, links)
    assert g.filter("class = 10000").count() == 6000 and g.filter("`group` = 10000").count() == 6001
    assert links.filter("class_a = 10000 AND class_b = 90000").count() == 1


def test_crowded_keys_are_compared_in_blocks(spark):
    rng = random.Random(31)
    common = " ".join(rng.choice(WORDS) for _ in range(16))
    texts = [t + " " + common for t in family(rng, 40, 3, 6)]
    rows = [(0, i, i % 2, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "field int, id long, side int, text string")
    d = {i: (s, t) for _, i, s, t in rows}
    want = {(a, b) for a in d for b in d if d[a][0] == 0 and d[b][0] == 1 and like(d[a][1], d[b][1]) >= 0.5}
    for hot in (8, 10_000):
        got = [(r["a"], r["b"]) for r in same_text(df, 0.5, hot).distinct().collect()]
        assert len(want) > 40 and set(got) == want
    wide = {(a, b) for a in d for b in d if a < b and like(d[a][1], d[b][1]) >= 0.65}
    got = {(r["id_a"], r["id_b"]) for r in duplicate_pairs(*near_duplicates(df, 0.5, hot=2)).collect()}
    assert wide <= got and all(like(d[a][1], d[b][1]) >= 0.5 for a, b in got)


def test_pairs_that_only_a_common_neighbour_shows(spark):
    rng = random.Random(51)
    base = [rng.choice(WORDS) for _ in range(120)]
    rows = [(0, 0, " ".join(base))]
    for i in range(1, 13):
        w = list(base)
        for k in rng.sample(range(120), 7):
            w[k] = rng.choice(WORDS)
        rows.append((0, i, " ".join(w)))
    want = {(a, b) for _, a, t in rows for _, b, u in rows if a < b and like(t, u) >= 0.5}
    df = spark.createDataFrame(rows, "field int, id long, text string")
    few = near_duplicates(df, 0.5, n_bands=12, band_rows=5, slots=61, hot=4)
    got = {(r["id_a"], r["id_b"]) for r in duplicate_pairs(*few).collect()}
    assert len(want) > 20 and got <= want and len(got) > 0.9 * len(want)


def test_null_ids_are_left_out(spark):
    t = " ".join(WORDS[:40])
    df = spark.createDataFrame([(0, None, t), (0, 1, t), (None, 2, t), (0, 3, t)], "field int, id long, text string")
    assert {(r["id_a"], r["id_b"]) for r in duplicate_pairs(*near_duplicates(df, 0.5)).collect()} == {(1, 3)}
    rows = [(None, "a", None, t, "train"), (1, "a", None, t, "train"), (2, "A ", None, t, "val"), (None, "a", None, t, "test")]
    df = spark.createDataFrame(rows, "rec_id long, case_id string, images array<string>, response string, split_name string")
    assert [(r["a"], r["b"]) for r in cross_split(df, "rec_id", "split_name", "case_id", "response", "images").collect()] == [(1, 2)]
    top = top_n(spark.createDataFrame([("g", None, 1.0), ("g", 5, 1.0)], "g string, i long, s double"), "g", "s", "i", 1)
    assert [r["i"] for r in top.collect()] == [None]


def test_texts_of_few_different_triples(spark):
    rows = [(0, 100 * k + c, " ".join("abcdef"[i % k] for i in range(40 + c))) for k in range(1, 7) for c in (0, 1)]
    x = Texts(pa.array([r[2] for r in rows]), np.zeros(len(rows), np.int32))
    assert set(x.n) == set(range(1, 7))
    sig = superminhash(x, 353)
    assert (sig != 0xFFFFFFFF).all() and (sig[::2] == sig[1::2]).all()
    members, links = near_duplicates(spark.createDataFrame(rows, "field int, id long, text string"), 0.5)
    got = {(r["id_a"], r["id_b"]) for r in duplicate_pairs(members, links).collect()}
    assert got == {(100 * k, 100 * k + 1) for k in range(1, 7)}
    assert duplicate_groups(members, links).count() == len(rows)


def test_texts_without_a_long_run_in_common(spark):
    rng = random.Random(41)
    rows = []
    for i, (n, every) in enumerate([(90, 10), (90, 11), (200, 10), (200, 12), (60, 10), (41, 13)]):
        w = [rng.choice(WORDS) for _ in range(n)]
        other = [rng.choice(WORDS) if k % every == every - 1 else x for k, x in enumerate(w)]
        rows += [(2 * i, 0, " ".join(w)), (2 * i + 1, 1, " ".join(other))]
    want = {(a, b) for a, s, t in rows for b, r, u in rows if s == 0 and r == 1 and like(t, u) >= 0.5}
    assert len(want) == 6
    df = spark.createDataFrame(rows, "id long, side int, text string")
    assert {(r["a"], r["b"]) for r in same_text(df, 0.5).collect()} == want


def test_overlap_of_texts_shuffles_little(spark):
    rng = random.Random(61)
    texts = []
    for _ in range(1000):  # of few different words, so that nearly all triples are keys
        w = rng.choices(WORDS[:30], k=60)
        texts += [" ".join(w), " ".join(w[: rng.randint(30, 59)])]
    rows = [(i, i % 4 == 3, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, evaluation boolean, text string").select("id", F.col("evaluation").cast("int").alias("side"), "text")
    want = {(a, b) for a, b in ((i - 1, i) for i in range(3, len(texts), 4)) if like(texts[a], texts[b]) >= 0.5}
    sc, jvm = spark._jsc.sc(), spark._jvm

    def written():
        sc.listenerBus().waitUntilEmpty(30_000)
        seen = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(seen.apply(i).shuffleWriteBytes() for i in range(seen.size()))

    before = written()
    got = {(r["a"], r["b"]) for r in same_text(df, 0.5).collect()}
    assert len(want) > 50 and got == want
    assert written() - before < 4 * sum(map(len, texts))


def test_blocks_of_evaluation_texts(spark):
    rng = random.Random(71)
    texts = family(rng, 30, 4, 8) + [" ".join(rng.choice(WORDS) for _ in range(3000))]
    texts.append(texts[-1].rsplit(" ", 900)[0])
    rows = [(i, i % 2, t) for i, t in enumerate(texts)] + [(1001, 1, texts[0]), (1000, 0, texts[0]), (1003, 1, texts[0])]
    d = {i: (s, t) for i, s, t in rows}
    want = {(a, b): len(triples(d[a][1]) & triples(d[b][1])) / len(triples(d[b][1])) for a in d for b in d if d[a][0] == 0 and d[b][0] == 1 and like(d[a][1], d[b][1]) >= 0.5}
    df = spark.createDataFrame(rows, "id long, side int, text string")
    for block, step in ((7, 5), (1000, P.STEP)):
        was, P.STEP = P.STEP, step  # pairs of one key over several steps
        try:
            got = {(r["a"], r["b"]): r["containment"] for r in same_text(df, 0.5, block).collect()}
        finally:
            P.STEP = was
        assert got.keys() == want.keys() and got == pytest.approx(want)
    assert (120, 121) in want and (1000, 1003) in want
