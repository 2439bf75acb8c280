"""Unfinished texts, defective pairs, tokens, packing, personal information."""

import base64
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slabwise.llm.defects import pair_defects
from slabwise.llm.packing import fill, pack, shortest_pack_first
from slabwise.llm.personal import LEAN, Words, clean_name, label, learn, load, mentions_of, redact, save, scan, spark_runner, train
from slabwise.llm.tagger import KINDS, UNKNOWN, Tagger, codes, fit, spans, tag_texts
from slabwise.llm.tokens import VOCABULARY, Encoder, encode, sentencepiece_model, sizes
from slabwise.llm.unfinished import spikes, tails, truncation_report, unfinished

FULL = "The left vessel is open and well seen. No cutoff of the {0} branch at slab {1}. Flow is {2}."


def reports(n, seed=1):
    rng = random.Random(seed)
    pick = lambda: (rng.choice(["basilar", "frontal", "insular"]), rng.randint(1, 50), rng.choice(["normal", "slow", "fast"]))
    return [" ".join(FULL.format(*pick()) for _ in range(rng.randint(2, 5))) for _ in range(n)]


def test_unfinished(spark):
    texts = reports(400)
    rows = [("f", i, "src", t) for i, t in enumerate(texts)]
    rows += [("f", 1000 + i, "src", t + " Read and released 10:" + str(10 + i)) for i, t in enumerate(texts[:30])]
    cut = [("f", 2000 + i, "lim", (t + " " + t)[:201]) for i, t in enumerate(reports(60, 2))]
    cut = [r for r in cut if not r[3].rstrip().endswith(".")]
    rows += cut + [("f", 3000, "src", texts[0][:-20]), ("f", 3001, "src", texts[1] + " And the…"), ("f", 3002, "src", texts[2] + " ..."), ("f", 3003, "src", texts[3] + " No cutoff of the�")]
    rows += [("f", 4000, "src", None), ("f", 4001, "src", ""), ("f", 4002, "src", " \n"), ("f", 4003, "src", "N/A"), ("f", 4004, None, "x y " * 20_000 + "end."), ("f", 4005, None, "x y " * 20_000 + "en")] + rows[:3]
    df = spark.createDataFrame(rows, "field string, rec_id long, source string, text string").withColumn("tail", F.lit(1)).withColumn("chars", F.lit("c"))
    got = unfinished(df).collect()
    ids = [r["rec_id"] for r in got]
    assert len(ids) == len(set(ids))
    assert set(ids) == {r[1] for r in cut} | {3000, 3001, 3003, 4005}
    assert {r["rec_id"] for r in got if r["at_limit"]} >= {r[1] for r in cut}
    rep = {r["source"]: r for r in truncation_report(df).collect()}
    assert rep["lim"]["n_at_limit"] == len(cut) and rep["lim"]["n_texts"] == len(cut) and rep[None]["n_unfinished"] == 1
    assert unfinished(df.limit(0)).count() == 0 and truncation_report(df.limit(0)).count() == 0
    assert {r["at"] for r in spikes(tails(df)).collect() if r["source"] == "lim"} == {201}


def test_limits_decide_whatever_the_last_words_are(spark):
    texts = reports(300, 3)
    rows = [("f", i, "s", t + " Read and released 10:" + str(10 + i % 50)) for i, t in enumerate(texts[:60])] + [("f", 100 + i, "s", t) for i, t in enumerate(texts)]
    long = [" ".join(texts[i : i + 4])[:120] for i in range(30)]
    rows += [("f", 1000 + i, "lim", t[:97] + " Read and released 10:1" if i < 8 else t) for i, t in enumerate(long)] + [("f", 2000, "lim", "Open vessel"), ("f", 2001, "lim", "The lef…"), ("f", 2002, "lim", "…"), ("f", 2003, "lim", "Patent")]
    df = spark.createDataFrame(rows, "field string, rec_id long, source string, text string")
    got = {r["rec_id"]: r["reason"] for r in unfinished(df).collect()}
    at = {1000 + i for i, t in enumerate(long) if i < 8 or not t.rstrip().endswith(".")}
    assert {k for k in got if 1000 <= k < 2000} == at and {got[k] for k in at} == {"limit"} and not [k for k in got if k < 1000]
    assert {k for k in got if k >= 2000} == {2001}
    twice = df.unionByName(df.withColumn("rec_id", F.col("rec_id") + 10_000).withColumn("field", F.lit("g")))
    assert {r["rec_id"] for r in unfinished(twice).collect() if r["rec_id"] < 10_000} == set(got)


def test_stops_inside_a_decimal(spark):
    rows = [("f", i, "s", f"It measures {i % 9}.{i % 7} mm at slab {i}.") for i in range(80)] + [("f", 900, "s", "Seen at the left side. It measures 4.")]
    got = unfinished(spark.createDataFrame(rows, "field string, rec_id long, source string, text string")).collect()
    assert [(r["rec_id"], r["reason"]) for r in got] == [(900, "decimal")]


PROMPT = "Assess these 8 slabs of a 40-year-old man with a headache and write a short report on the carotid; list the slabs by number."
REPORT = "Findings: The left carotid is open and the right one is of normal calibre on slab 12. There is no cutoff at the M1 segment within 12.5 mm. Impression: Normal study."
DEFECTS = [
    (None, "empty"), ("", "empty"), ("  \n​", "empty"), ("Findings:\n\nImpression:\n", "empty"), ("N/A", "empty"), ("[empty]", "empty"), ("<p></p>", "empty"), ("--", "empty"), ("**Findings**\n**Impression**", "empty"),
    ("I am sorry, but I cannot interpret these images.", "refusal"), ("Das kann ich nicht beurteilen.", "refusal"), ("Lo siento, no puedo informar estas imágenes.", "refusal"), ("Désolé, je ne peux pas lire ces images.", "refusal"),
    ("I can't help. You ask about a 40-year-old man. Pressure 120/80, weight 80 kg.", "refusal"), (PROMPT, "copy"), ("You asked: " + PROMPT.upper(), "copy"), (PROMPT.replace("headache", "stroke") + " OK", "copy"),
    ("Der linke Abschnitt ist offen und gut abgrenzbar, die rechte Seite wird zu 40 Prozent versorgt. Keine Einengung über 7 mm, eher durch Bewegung. Wegen der Dosis ist das Bild nicht gut.", "other_language"),
    ("El segmento izquierdo queda bien definido y no hay corte en el ramo. La densidad del tálamo es de 20 UH por una dosis baja en los cortes 3 a 9 con la serie.", "other_language"),
    ("Снимок показывает открытые сосуды без признаков закупорки и сужения просвета артерий слева.", "other_language"), (REPORT[:-30], "truncated"), (REPORT[:-9] + "…", "truncated"),
    ("Assess these 8 slabs", "copy"), (REPORT + " See (figure 3.", "truncated"), (REPORT + " ```x.", "truncated"), (REPORT + " See (figure 3).", None),
    ("O segmento esquerdo não é visível e há uma imagem do lado direito com mais ruído para a base.", "other_language"),
    (REPORT, None), ("No occlusion.", None), ("Patent.", None), ("No", None), ("I cannot assess the P1 segment because of motion. " + REPORT, None), (PROMPT + " " + REPORT + " " + REPORT.replace("left", "upper").replace("12", "31"), None),
    (REPORT + " The note said: \"keine Einengung, Befund gut\".", None), ("Findings: odd shadows. Impression: huge clot everywhere!", None),
]


def test_pair_defects(spark):
    filler = [("f", 5000 + i, "s", PROMPT, t) for i, t in enumerate(reports(100))]
    rows = [("f", i, "s", PROMPT, a) for i, (a, _) in enumerate(DEFECTS)] + filler
    german = "Bitte beschreiben Sie die Bilder und schreiben Sie einen kurzen Befund zu den Gefäßen des Patienten mit der Angabe der Seite."
    de = DEFECTS[17][0]
    rows += [("g", 1, "s", german, de), ("g", 2, "s", german, REPORT), ("g", 3, "s", PROMPT + " Please answer in German.", de), ("g", 4, None, None, REPORT), ("g", 5, "s", None, None), ("g", 6, "s", PROMPT, "x " * 50_000 + ".")] + rows[:2]
    df = spark.createDataFrame(rows, "field string, rec_id long, source string, prompt string, answer string").withColumn("empty", F.lit(1)).withColumn("_a", F.lit(2)).withColumn("text", F.lit("t"))
    got = {(r["field"], r["rec_id"]): r for r in pair_defects(df).collect()}
    for i, (a, want) in enumerate(DEFECTS):
        r = got.get(("f", i))
        assert (r["defect"] if r else None) == want, a
    assert {k: v["defect"] for k, v in got.items() if k[0] == "g"} == {("g", 2): "other_language", ("g", 5): "empty"}
    assert not [k for k in got if k[1] >= 5000]
    assert all(r["defects"][0] == r["defect"] for r in got.values())
    assert pair_defects(df.limit(0)).count() == 0
    assert pair_defects(spark.createDataFrame([(None, 1, "s", "p", None), ("f", None, "s", "p", None)], "field string, rec_id long, source string, prompt string, answer string")).count() == 0


@pytest.fixture(scope="module")
def encoder():
    with open(VOCABULARY, "rb") as f:
        return Encoder(sentencepiece_model(f.read()))


ODD = ["", "a", " a  b\n\n c ", "don't WE'LL", "<|endoftext|>x", "Größe 漢字 👩🏽‍⚕️", "\x1c\x85 　x", "½²Ⅷ ٣", "A" * 20_000, " " * 3000 + "x", "\u0000\u0001", "ﬁ é́", "1,234.56"]


def test_encoder_equals_the_public_tokenizer(encoder):
    import tiktoken

    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    t = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    texts = ODD + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x3000), 32, 10])) for _ in range(60)) for _ in range(300)]
    for x in texts:
        ids = encoder.encode(x)
        assert ids == t.encode_ordinary(x) and encoder.decode(ids) == x
    assert encoder.encode(None) == [] and encoder.decode([]) == ""


def test_encode_rows(spark, encoder):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(98, None), (0, "")], "doc_id long, text string").withColumn("_text", F.lit(3)).withColumn("ids", F.lit(4))
    got = [(r["doc_id"], r["ids"]) for r in encode(df, "doc_id", "text").collect()]
    assert sorted(got) == sorted([(i, encoder.encode(t)) for i, t in enumerate(ODD)] + [(98, []), (0, [])])
    assert {(r["doc_id"], r["n_tokens"]) for r in sizes(df, "doc_id", "text").collect()} == {(i, len(x)) for i, x in got}
    assert encode(df.limit(0), "doc_id", "text").count() == 0


def test_patterns_hold_every_item():
    rng = random.Random(4)
    for cap in (10, 64):
        for _ in range(40):
            h = {rng.randint(1, cap): rng.randint(1, 200) for _ in range(rng.randint(0, 20))}
            p = shortest_pack_first(h, cap)
            assert all(sum(x) <= cap and n > 0 for x, n in p)
            got = {}
            for x, n in p:
                for k in x:
                    got[k] = got.get(k, 0) + n
            assert got == h


def test_pack(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([0, 1, 5, 17, 60, 64, 65, 200, None, 13])) for i in range(3000)] + [(7000 + i, 17) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, n long").withColumn("_k", F.lit(1)).withColumn("_len", F.lit(1))
    got = pack(df, "doc_id", "n", 64).collect()
    by, seq = {}, {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
        seq.setdefault(r["seq_id"], []).append(r)
    assert set(by) == {i for i, _ in rows}
    for i, n in rows:
        parts = sorted(by[i], key=lambda r: r["part"])
        assert sum(r["n_tokens"] for r in parts) == (n or 0) and [r["part"] for r in parts] == list(range(len(parts))) and all(r["part_start"] == 64 * r["part"] for r in parts)
        assert len(parts) == max(1, -(-(n or 0) // 64))
    used = 0
    for x in seq.values():
        at = 0
        for r in sorted((r for r in x if r["n_tokens"]), key=lambda r: r["seq_offset"]):
            assert r["seq_offset"] == at
            at += r["n_tokens"]
        assert at <= 64
        used += at
    assert used / (64 * len(seq)) > 0.97
    f = fill(pack(df, "doc_id", "n", 64), 64).first()
    assert f["n_tokens"] == used and f["n_sequences"] == len(seq) and f["least_sequences"] <= f["n_sequences"] and f["fill"] > 0.97
    import slabwise.llm.packing as packing

    many, packing.SALT_ROWS = packing.SALT_ROWS, 100
    try:
        assert fill(pack(df, "doc_id", "n", 64), 64).first() == f
    finally:
        packing.SALT_ROWS = many
    assert pack(df.limit(0), "doc_id", "n", 64).count() == 0
    assert {r["seq_id"] for r in pack(df.filter("n = 0"), "doc_id", "n", 64).collect()} == {0}


KNOWN = frozenset("lunawyn pelibert sylotia jorina belarick tamisha orinel".split())  # what the labelling rules know
OTHERS = "Fenwick Hadrisel Jolanta Quiberon Ustinara Wendolf".split()
FAMILIES = "Braskerdahl Thrupolmann Haringvane Moringski Ostumwick Zabelfold Prenelbard Duningren Wexolaso Carrumquist".split()


def note(rng):
    """A note and the mentions planted in it. Half of the given names are in no list."""
    truth = []

    def put(kind, x):
        truth.append((kind, x))
        return x

    def name():
        given, family = rng.choice(sorted(KNOWN) + OTHERS).capitalize(), rng.choice(FAMILIES)
        return put("name", rng.choice([f"{given} {family}", f"{given} {family}", f"{given[0]}. {family}"]))

    number = lambda: put("phone", rng.choice(["+1 312 555 0{0}", "(415) 555-0{0}", "020 7946 0{0}", "0049 30 23125{0}"]).format(rng.randint(100, 999)))
    policy = lambda: put("id_number", f"{rng.choice('QX')}{rng.randint(10**8, 10**9 - 1)}")
    parts = [
        lambda: f"Referred by {rng.choice(['', 'Dr ', 'Mrs '])}{name()}.", lambda: f"{name()} was seen in the clinic.", lambda: f"Discussed at length with {name()} this morning.", lambda: f"{rng.choice(['Call back on', 'Best reached with'])} {number()}.",
        lambda: f"Mail {put('email', rng.choice(['ward', 'jo.brask', 'h_vane']) + str(rng.randint(1, 99)) + rng.choice(['@', ' (at) ']) + 'mail.example.net')} if anything is missing.", lambda: f"Please merge {rng.choice(['insurance no.', 'folder'])} {policy()} with this study.",
        lambda: f"Lives at {put('address', f'{rng.randint(1, 200)} Wychemoor ' + rng.choice(['Road', 'Lane', 'Way']))}.", lambda: f"Lot {rng.randint(10**7, 10**8 - 1)} of the contrast agent was used.",
        lambda: "The vein of Galen and the Sylvian fissure are outlined.", lambda: f"Axial slab {rng.randint(10, 40)} shows mild stenosis of the left M1 segment, about {rng.randint(1, 9)}.5 mm wide.",
    ]
    rng.shuffle(parts)
    return rng.choice([" ", "\n"]).join(p() for p in parts[: rng.randint(3, 10)]), set(truth)


@pytest.fixture(scope="module")
def tagger(spark):
    rng = random.Random(1)
    return learn([note(rng)[0] for _ in range(600)], KNOWN, spark_runner(spark), rounds=(6, 8))


def test_tagger_gradients():
    m = Tagger(6, 1)
    ids = np.array([[40, 41, 42, 43, 0, 0], [50, 40, 41, 60, 61, 62]], np.uint8)
    tags = np.array([[0, 1, 2, 0, 0, 0], [0, 9, 10, 10, 0, 3]], np.uint8)
    _, g = m.gradients(ids, tags)
    for k, at in (("X", (0, 41, 3)), ("X", (1, 40, 9)), ("U", (1, 2, 7)), ("V", (3, 2)), ("b", (1,)), ("A", (0, 9))):
        old, eps = m.p[k][at], 3e-2
        m.p[k][at] = old + eps
        up, _ = m.gradients(ids, tags)
        m.p[k][at] = old - eps
        down, _ = m.gradients(ids, tags)
        m.p[k][at] = old
        assert (up - down) / (2 * eps) == pytest.approx(float(g[k][at]), abs=2e-3)


def test_unknown_labels_leave_the_tag_open():
    m = Tagger(6, 1)
    ids, tags = np.array([[40, 41, 42, 43]], np.uint8), np.full((1, 4), UNKNOWN, np.uint8)
    loss, g = m.gradients(ids, tags)
    assert abs(loss) < 1e-5 and all(np.abs(x).max() < 1e-6 for x in g.values())


def test_averaged_shards_learn():
    rng = np.random.default_rng(2)
    ids = rng.integers(34, 60, (900, 20)).astype(np.uint8)
    tags = (ids < 40).astype(np.uint8)
    start = Tagger(seed=7).gradients(ids, tags)[0]
    assert fit(Tagger(), ids, tags, 12, 0.03).gradients(ids, tags)[0] < 0.5 * start


def score(found, truth):
    hits = sum(len(a & b) for a, b in zip(found, truth))
    return hits / sum(map(len, truth)), hits / max(1, sum(map(len, found)))


def test_mentions_that_no_labelling_rule_knows(tagger):
    """The tagger finds planted mentions that its own labels leave open; an untrained one finds none."""
    rng = random.Random(99)
    notes = [note(rng) for _ in range(150)]
    texts, truth = [t for t, _ in notes], [x for _, x in notes]

    def decoded(model):
        return [{(KINDS[k], t[s:e]) for k, s, e in mentions_of(t, *x)} for t, x in zip(texts, tag_texts(model, texts, LEAN))]

    words = Words(texts, KNOWN)
    y = [label(t, words) for t in texts]
    labelled = [{(KINDS[k], t[s:e]) for k, s, e in spans(np.where(z == UNKNOWN, 0, z).astype(np.uint8))} for t, z in zip(texts, y)]
    recall, precision = score(decoded(tagger), truth)
    rules, _ = score(labelled, truth)
    untrained, _ = score(decoded(Tagger()), truth)
    assert recall > 0.93 and precision > 0.93 and rules < recall - 0.08 and untrained < 0.05


def test_windows_agree_with_one_pass(tagger):
    rng = random.Random(5)
    long = "\n".join(note(rng)[0] for _ in range(12))
    (tags, _), (again, _) = tag_texts(tagger, [long, long], 0.0)
    assert len(tags) == len(long) and (tags == again).all()
    kinds = {k for k, _, _ in spans(tags)}
    assert len(kinds) >= 4
    assert tag_texts(tagger, [""], 0.0)[0][0].tolist() == [] and len(codes("a😀ß")) == 3


def test_names_are_cleaned():
    for text, part, want in [
        ("Dr Anna Krethwick's note", "Dr Anna Krethwick's", "Anna Krethwick"), ("Referred by Prof. von Ostumwick.", "Prof. von Ostumwick.", "von Ostumwick"), ("seen Haringvane, Pelibert,", "ringvane, Pelibert", "Haringvane, Pelibert"),
        ("the left side", "left side", None), ("seen by Ana Seven. The", "Ana Seven. The", "Ana Seven"),
    ]:
        s = text.index(part)
        span = clean_name(text, s, s + len(part))
        assert (text[span[0] : span[1]] if span else None) == want


def test_scan_rows(spark, tagger):
    rng = random.Random(3)
    texts = [note(rng)[0] for _ in range(20)] + [None, "", " ", "x" * 30_000, "漢字 👩🏽‍⚕️"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0])], "doc_id long, text string").withColumn("_text", F.lit(1)).withColumn("mentions", F.lit(2))
    rows = scan(df, "doc_id", "text", model=tagger).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        t = texts[r["doc_id"]]
        if not t:
            assert r["mentions"] == [] and r["redacted"] == t
            continue
        assert all(t[m["start"] : m["start"] + m["length"]] == m["mention"] for m in r["mentions"])
        assert all(m["mention"] not in r["redacted"] for m in r["mentions"] if len(m["mention"]) > 8)
    assert scan(df.limit(0), "doc_id", "text").count() == 0 and train(df.limit(0), "doc_id", "text") is None
    assert redact("a b c", [(4, 2, 3)]) == "a [NAME] c"


def test_tagger_is_kept_as_a_table(spark, tagger, tmp_path):
    save(tagger, spark, str(tmp_path / "tagger"))
    again = load(spark, str(tmp_path / "tagger"))
    assert all((again.p[k] == v).all() for k, v in tagger.p.items())


def test_a_long_run_of_letters_is_read_once(spark):
    import time

    from slabwise.llm.unfinished import decimal_words

    long = "x" * 300_000
    df = spark.createDataFrame([("f", 1, "s", long + " 5."), ("f", 2, "s", long), ("f", 3, "s", "a lumen of 1.5 mm, later 2.")], "field string, rec_id long, source string, text string")
    began = time.time()
    assert {r["rec_id"]: r["decimal"] for r in tails(df).collect()} == {1: long, 2: "", 3: "later"}
    assert {(r["decimal"], r["inside"], r["final"]) for r in decimal_words(df).collect()} == {(long, 0, 1), ("of", 1, 0), ("later", 0, 1)}
    assert time.time() - began < 15


def test_pair_defects_goes_through_all_words_once(spark):
    """Copies around the threshold are as counted in Python; sets of whole texts are made only to leave out what can't be a copy."""
    from slabwise.llm.defects import COPY_SHARE, COPY_WORDS, may_copy

    rng = random.Random(5)
    rows = []
    for i in range(600):
        prompt = [f"w{rng.randrange(rng.choice([4, 12, 60]))}" for _ in range(rng.randrange(0, 40))]
        at = rng.randrange(len(prompt) + 1)
        answer = (prompt[at:] + [f"{rng.choice('vw')}{rng.randrange(30)}" for _ in range(rng.randrange(0, 14))])[: rng.randrange(0, 30)]
        rows.append(("f", i, "s", " ".join(prompt), " ".join(answer) + "."))
    rows += [("f", 600, "s", None, "a b c d e f g."), ("f", 601, "s", "a b c d e f g", None)]
    df = spark.createDataFrame(rows, "field string, rec_id long, source string, prompt string, answer string")

    def copied(p, a):
        if p is None or a is None:
            return False
        p, a = p.split(), a[:-1].split()
        t, u = ({tuple(x[i : i + 3]) for i in range(len(x) - 2)} for x in (a, p))
        return 2 <= len(a) < len(p) and p[: len(a)] == a or len(a) >= COPY_WORDS and len(t & u) >= COPY_SHARE * len(t)

    out = pair_defects(df)
    want = {r[1] for r in rows if copied(r[3], r[4])}
    assert 50 < len(want) < 550 and {r["rec_id"] for r in out.collect() if "copy" in r["defects"]} == want
    words = lambda c: F.array_remove(F.split(F.regexp_replace(c, r"\.", ""), " "), "")
    may = {r["rec_id"]: r["m"] for r in df.select("rec_id", may_copy(words(F.col("answer")), words(F.col("prompt"))).alias("m")).collect()}
    assert sum(m is False for m in may.values()) > 50
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_intersect(") == 1 and plan.count("array_except(") == 1


def test_closed_is_told_by_the_last_character(spark):
    from slabwise.llm.unfinished import _CLOSED, _closed

    rng = random.Random(6)
    marks = ".!?。！？؟\"'”’»)]*_\n\r\u0085\u2028\u2029…�a ,é"
    texts = [""] + [rng.choice(["", "Patent ", "é. "]) + "".join(rng.choice(marks) for _ in range(rng.randrange(5))) for _ in range(4000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", _closed(F.col("t")).alias("got"), F.col("t").rlike(_CLOSED).alias("want"))
    r = df.collect()
    assert [x["t"] for x in r if x["got"] != x["want"]] == [] and 500 < sum(x["got"] for x in r) < 3500
