"""Personal information in free text (problem 8).

A character-level BiLSTM-CRF decides what a mention is and where it begins and ends. It is
trained from labelled spans of a bounded sample of documents: what an address or an e-mail
address looks like says what it is; a number is labelled where a plain word before it names
its kind; a name where it has a title or a known given name. All else that might be a mention
is left open (UNKNOWN), so the model learns from the sentences around the labelled spans and
finds mentions in the open places too. Every document is decoded, whole, in overlapping
windows, and no list, cue or lexicon takes part in that; a decoded span only has to have the
form of its kind."""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slabwise.llm.common import balanced
from slabwise.llm.tagger import KINDS, UNKNOWN, Tagger, codes, fit, shard_round, spans, tag_texts

SAMPLE = 2500  # documents that the tagger learns from, by the hash of their key
WINDOWS = 6000  # training windows at most
SPAN = 112  # characters of a training window
ROUNDS = (10, 28)  # of training, before and after hard places are added
LEAN = 1.0  # added to the score of every mention that begins
DISGUISED = 0.5  # share of training names whose letters are exchanged, so that contexts are learnt

EMAIL, PHONE, ID, ADDRESS, NAME = range(5)
PLACEHOLDERS = tuple(f"[{k.upper()}]" for k in KINDS)

# Shapes.
_LOCAL = r"(?:(?:[\p{L}\d._+-]*(?<![\p{L}\d])|[\p{L}\d]?|[\p{L}\d]+[._+-])(?:van|von|de la|van der|von der) )?[\p{L}\d](?:[\p{L}\d._+-]*[\p{L}\d])?"
_AT = r"(?:@| ?[\[(] ?at ?[\])] ?)"
_DOT = r"(?:\.| ?[\[(] ?dot ?[\])] ?| dot )"
_LABEL = r"[\p{L}\d](?:[\p{L}\d-]*[\p{L}\d])?"
_SURFACE = {
    EMAIL: rf"(?i)(?<![\p{{L}}\d._+-])(?:{_LOCAL}{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}\p{{L}}{{2,}}|{_LOCAL} at {_LABEL}(?:{_DOT}{_LABEL})* dot \p{{L}}{{2,}})(?![\p{{L}}\d])",
    PHONE: r"(?<![\p{L}\d/.+-])(?<!\d,)(?:\+\d{1,3}|00\d{1,3}|\(\d{2,5}\)|\d)(?:[ ./-]?\(\d{1,4}\)|[ ./-]?\d)*\d(?:,? (?:ext\.?|extension|x|Durchwahl|DW|poste|int\.?|anexo) ?\d{1,5})?(?![\p{L}\d])",
    ID: r"(?<![\p{L}\d/.+-])(?:\p{Lu}{1,3}-?\d{5,12}|\d{3}-\d{2}-\d{4}|\d{2}-\d{4}-\d|\d{3} \d{3} \d{4}|\d{4}-\d{4}|\d{8}-\p{Lu}|\d{8,13})(?![\p{L}\d]|[-/.]\d)",
    ADDRESS: r"(?<![\p{L}\d])(?:"
    r"(?:(?:Flat|Unit|Apt\.?|Apartment|Suite|Room) \d+\p{Lu}?, )?\d+ ?\p{L}? (?:\p{Lu}[\p{L}'’-]+ ){1,3}(?:Rd|Road|St|Street|Ave|Avenue|Lane|Ln|Way|Drive|Dr|Close|Crescent|Cres|Terrace|Court|Place|Square|Gardens|Hill|Row|Walk)\b"
    r"|(?:\p{Lu}[\p{L}-]*(?:straße|strasse|str\.|gasse|weg|allee|platz|ring|damm|ufer|steig)|(?:\p{Lu}[\p{L}-]+ )(?:Straße|Strasse|Str\.|Gasse|Weg|Allee|Platz|Ring)) \d+(?: ?[a-z](?![\p{L}]))?"
    r"|(?:Calle|C/|Avenida|Avda\.|Av\.|Plaza|Paseo|Camino|Ronda|Travesía) ?(?:de (?:la |los )?|del )?(?:\p{Lu}[\p{L}'’-]+ ?){1,3}(?<! ),? (?:n\.º ?|nº ?|núm\. ?)?\d+(?: ?[A-Z](?![\p{L}]))?"
    r"|\d+(?: (?:bis|ter|quater))?,? (?:rue|avenue|chemin|boulevard|allée|impasse|place|quai|route|cours|square|passage) (?:de (?:la )?|du |des |de l['’]|d['’])?\p{Lu}[\p{L}'’-]+(?: \p{Lu}[\p{L}'’-]+){0,2}"
    r")",
}
SHAPES = {k: regex.compile(p) for k, p in _SURFACE.items()}
TITLES = "Drs?|Prof|Professor|Professorin|Mr|Mrs|Ms|Miss|Mx|Nurse|Sister|Herrn?|Frau|Sra?|Dra|Srta|Don|Doña|Mme|Mlle|Monsieur|Madame|Sir|Lady|Med"
_PART = r"\p{Lu}[\p{L}\p{M}]*(?:['’](?!s\b)\p{L}+)?(?:-\p{Lu}[\p{L}\p{M}]*)*"
_PARTICLE = r"(?i:von der|van der|van den|de la|von|van|de|del|della|da|di|af|zu|ten|ter|le)"
_FIRST = rf"(?:\p{{Lu}}\. )*(?:{_PARTICLE} )?(?:\p{{Lu}}\. )*{_PART}"
_FULL = rf"{_FIRST}(?: {_FIRST})*(?:, {_PART}(?!\p{{L}}|[.-]\p{{L}}|\.-))?"
_TITLED = rf"(?:(?:{TITLES})\.? )*"
#: Plain words for a phone, for a number of a person, and for a number of something else.
_PHONE_WORD = r"tel|tél|telephone|teléfono|téléphone|telefon|phone|phoned|fax|call|mobile|cell|text|pager|reachable|line|erreichbar|rückruf|handy|mobil|llamar|móvil|rappeler|portable"
_ID_WORD = (
    r"ssn|social security|mrn|record (?:no|number)|hospital number|patient (?:id|no|number)|insurance|insured|member|policy|national id|nid|nhs|identity card|id card|passport|travel document"
    r"|personalausweis|ausweis|pass|pat\.-nr|patienten-id|patientennummer|versicherten\w*|pasaporte|dni|nie|documento de identidad|identidad|historia|afiliación|paciente n|passeport|assuré|dossier|carte d['’]identité|identité"
)
_GOODS_WORD = r"lot|batch|serial|accession|order|item|catalogue|protocol|uid|grid|build|version|software|study|series|device|model|acquired|ratio|charge|auftrag|lote|serie|commande"
_WORD_BEFORE = regex.compile(rf"(?i)(?<!\p{{L}})(?:(?P<phone>{_PHONE_WORD})|(?P<id>{_ID_WORD})|(?P<goods>{_GOODS_WORD}))(?!\p{{L}})")
_NEAR = regex.compile(r"[^\n\d]{0,24}")
_NUMBER = regex.compile(r"(?<![\p{L}\d])[+(]?\p{Lu}{0,3}-?\d(?: ?\(\d{1,4}\)|[ ./-]?\d|\)[ ./-]?\d)*(?:-\p{Lu}(?!\p{L}))?")
#: Medical terms that hold a person's name, and what stands before the name of a place.
_EPONYMS = frozenset("Galen Willis Sylvian Sylvius Rolando Rolandic Heubner Monro Luschka Magendie Labbé Trolard Percheron Broca Wernicke Doppler Hounsfield".split())
_PLACE = regex.compile(r"(?i:(?<!\p{L})(?:room|ward|station|unit|clinic|hospital|saal|zimmer|sala|planta|salle|klinik))(?: \p{Lu}[\p{L}-]+)+")
_TOWN = regex.compile(r",? (?:\d{4,5} )?\p{Lu}[\p{L}'’-]+(?: \p{Lu}[\p{L}'’-]+)?(?: \d{4,5})?")
_PARTICLES = frozenset("von van der den de la del della da di af zu ten ter le".split())
_TITLE = regex.compile(rf"(?:{TITLES})\.?$")
_TITLE_AT = regex.compile(rf"(?:(?:{TITLES})\.?(?: |$))+")
_RUN = regex.compile(rf"(?<![\p{{L}}\d@._-]){_TITLED}{_FULL}(?![\p{{L}}@])")
_TOKEN = regex.compile(r"\p{Lu}\.(?=[ ,]|$)|(?:Drs?|Prof|Sra?|Dra|Mrs?|Ms|Mx|Med|M)\.|[\p{L}\p{M}\d'’-]+")
_CAPITAL = regex.compile(r"(?<![\p{L}\d@._-])\p{Lu}[\p{L}\p{M}]+(?![\p{L}@])")
_LOWER = regex.compile(r"(?<![\p{L}\d@._+-])\p{Ll}[\p{L}\p{M}]+(?![\p{L}\d@_+-]|\.\p{L}|\.?\w*@| ?[\[(])")
_BETWEEN = regex.compile(rf"\.? (?:\p{{Lu}}\. )*(?:{_PARTICLE} )?|-")
_SENTENCE = regex.compile(rf"(?<=[\p{{L}}\p{{M}}]{{2}})(?<!(?<!\p{{L}})(?:{TITLES}))[.!?:;](?: |$)|\n")
_LEADING = regex.compile(r"(?i)(?<!\p{L})(?:von der|van der|van den|de la|van) $")
_WORDCHAR = regex.compile(r"[\p{L}\p{M}\d]")
_FRENCH, _ENGLISH = regex.compile(r"(?i)(?<!\p{L})(?:le|la|les|du|des|au|aux|sur|et|une|par|vers|pour)(?!\p{L})"), regex.compile(r"(?i)(?<!\p{L})(?:the|of|and|is|at|in|with|was|to)(?!\p{L})")


def _is_french(text: str) -> bool:
    return len(_FRENCH.findall(text)) > len(_ENGLISH.findall(text))


class Words:
    """What labelling knows of words, all of it from the training sample: given names (of the list that
    the caller has), words that are also written in lower case, and capitalised words that
    recur without ever being part of a labelled name."""

    OFTEN = 8  # occurrences from which a capitalised word that is never part of a labelled name is none

    def __init__(self, texts: list[str], given: frozenset[str] = frozenset()):
        self.given = given
        self.lower = frozenset(w for t in texts for w in _LOWER.findall(t))
        self.common: frozenset[str] = frozenset()
        seen, inside = Counter(), Counter()
        for t in texts:
            end, named, before = 0, False, ""
            for m in _CAPITAL.finditer(t):
                w = m.group()
                named = w.lower() in self.given or (named or bool(_TITLE.fullmatch(before))) and bool(_BETWEEN.fullmatch(t, end, m.start()))
                seen[w] += 1
                inside[w] += named
                end, before = m.end(), w
        self.common = frozenset(w for w, n in seen.items() if n >= self.OFTEN and inside[w] < 0.02 * n)

    def ordinary(self, word: str) -> bool:
        parts = [p for p in word.split("-") if len(p) > 1]
        return any(p in self.common or p in _EPONYMS or p.lower() not in self.given and p.lower() in self.lower for p in parts)


def _label_name(text: str, m: regex.Match, words: Words, y: np.ndarray) -> None:
    """Labels one run of capitalised words, or leaves open what can't be told."""
    tokens = [(t.group(), t.start(), t.end()) for t in _TOKEN.finditer(text, m.start(), m.end())]
    titled = False
    while tokens and (_TITLE.match(tokens[0][0]) or tokens[0][0] == "M." and _is_french(text)):
        tokens, titled = tokens[1:], True
    while tokens and not titled and (words.ordinary(tokens[0][0]) or tokens[0][0].lower() in _PARTICLES and not _LEADING.match(text, tokens[0][1], tokens[1][1] if len(tokens) > 1 else 0) and not _LEADING.match(text, tokens[0][1], tokens[2][1] if len(tokens) > 2 else 0)):
        if tokens[0][0].lower() in _PARTICLES:
            y[tokens[0][1] : tokens[0][2]] = UNKNOWN
        tokens = tokens[1:]
    for i, (w, _, _) in enumerate(tokens):  # a title or an ordinary word ends the name
        if i and (words.ordinary(w) and w.lower() not in _PARTICLES or _TITLE.match(w)):
            rest, tokens = tokens[i + 1 :], tokens[:i]
            for r, s, e in rest:
                if not words.ordinary(r):
                    y[s:e] = UNKNOWN
            break
    while tokens and tokens[-1][0].lower() in _PARTICLES:
        tokens = tokens[:-1]
    names = [w for w, _, _ in tokens if len(w) > 2 and w[0].isupper()]
    if not names:
        return
    s, e = tokens[0][1], tokens[-1][2]
    known = [w.lower() in words.given or any(p in words.given for p in w.lower().split("-")) for w in names]
    comma = text.rfind(",", s, e)
    if titled or any(known) or regex.match(r"\p{Lu}\.$", tokens[0][0]) or len(tokens) > 1 and regex.match(r"\p{Lu}$", tokens[-1][0]):
        end = e
        if comma >= 0 and not known[-1]:
            y[comma:e] = UNKNOWN
            end = comma
        y[s] = 1 + 2 * NAME
        y[s + 1 : end] = 2 + 2 * NAME
        if titled and not any(known) and len(names) == 1 and end == e and text[e : e + 2] == ", ":
            y[e] = UNKNOWN
    else:
        y[s:e] = UNKNOWN


def label(text: str, words: Words) -> np.ndarray:
    """The training label of every character: the tag of what is told apart, UNKNOWN where something
    might be a mention, O elsewhere."""
    y = np.zeros(len(text), np.uint8)
    free = np.ones(len(text) + 1, bool)

    def put(kind: int, s: int, e: int) -> None:
        y[s] = 1 + 2 * kind
        y[s + 1 : e] = 2 + 2 * kind
        free[s:e] = False

    for m in SHAPES[EMAIL].finditer(text):
        put(EMAIL, *m.span())
    for m in SHAPES[ADDRESS].finditer(text):
        if free[slice(*m.span())].all():
            put(ADDRESS, *m.span())
            town = _TOWN.match(text, m.end())
            if town:
                free[town.start() : town.end()] = False
    for m in _PLACE.finditer(text):
        free[slice(*m.span())] = False
    for m in _NUMBER.finditer(text):
        s, e = m.span()
        digits = sum(c.isdigit() for c in m.group())
        if digits < 5 or not free[s:e].all():
            continue
        before = None
        for before in _WORD_BEFORE.finditer(text, max(0, s - 60), s):
            pass  # the last one
        if before and not _NEAR.fullmatch(text, before.end(), s):
            before = None
        kinds = {k: x for k in (PHONE, ID) if (x := SHAPES[k].match(text, s) or text[s] == "(" and SHAPES[k].match(text, s + 1)) and x.end() >= e}
        kind = None
        if before is None:
            kind = PHONE if m.group()[0] in "+(" and 9 <= digits <= 15 else ID if regex.match(r"\d{3}-\d{2}-\d{4}$", m.group()) else None
        elif before.group("phone"):
            kind = PHONE if 9 <= digits <= 15 else None
        elif before.group("id"):
            kind = ID
        else:
            free[s:e] = False
            continue
        if kind in kinds:
            put(kind, *kinds[kind].span())
        elif kinds or before is not None or digits >= 7:
            e = max([e] + [x.end() for x in kinds.values()])
            y[s:e], free[s:e] = UNKNOWN, False
    for m in _RUN.finditer(text):
        if free[slice(*m.span())].all():
            _label_name(text, m, words, y)
    return y


def clean_name(text: str, s: int, e: int) -> tuple[int, int] | None:
    """The name in text[s:e]: to whole words, without titles, possessive ending and closing
    punctuation; None if no word of at least three letters with a capital is left."""
    while s > 0 and s < len(text) and _WORDCHAR.match(text[s]) and _WORDCHAR.match(text[s - 1]):
        s -= 1
    while 0 < e < len(text) and _WORDCHAR.match(text[e - 1]) and _WORDCHAR.match(text[e]):
        e += 1
    if e < len(text) and text[e] == "-" and e + 1 < len(text) and text[e + 1].isupper():
        m = regex.compile(r"(?:-\p{Lu}[\p{L}\p{M}]*)+").match(text, e)
        e = m.end() if m else e
    m = _SENTENCE.search(text, s, e)  # the name's sentence ends
    e = m.start() if m else e
    while True:
        m = _TITLE_AT.match(text, s, e)
        if not m:
            break
        s = m.end()
    if text[s:e].startswith("M. ") and _is_french(text):
        s += 3
    while s < e and not text[s].isalpha():
        s += 1
    m = regex.search(r"['’]s$", text[s:e])
    if m:
        e = s + m.start()
    while e > s and not text[e - 1].isalpha():
        e -= 1
    m = _LEADING.search(text, max(0, s - 12), s)
    s = m.start() if m else s
    words = regex.findall(r"\p{L}[\p{L}\p{M}'’-]*", text[s:e])
    strong = [w for w in words if len(w) >= 3 and w[0].isupper()]
    if any(w[0].islower() and w.lower() not in _PARTICLES for w in words) or any(c.isdigit() or c in "@:;()" for c in text[s:e]):
        return None
    return (s, e) if strong and "\n" not in text[s:e] else None


def clean(kind: int, text: str, s: int, e: int) -> tuple[int, int] | None:
    """The mention in a decoded span, or None where the span has not the form of its kind."""
    if kind == NAME:
        return clean_name(text, s, e)
    best, most = None, 0.5
    for m in SHAPES[kind].finditer(text, max(0, s - 40), min(len(text), e + 40)):
        a, b = m.span()
        if kind == PHONE and not 9 <= sum(c.isdigit() for c in m.group()) <= 19:
            continue
        share = (min(b, e) - max(a, s)) / (max(b, e) - min(a, s))
        if share > most and not (a > 0 and _WORDCHAR.match(text[a]) and _WORDCHAR.match(text[a - 1])):
            best, most = (a, b), share
    return best


def _merged(text: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Neighbouring spans of names with nothing but a blank, an initial or a particle between are one."""
    out: list[tuple[int, int, int]] = []
    for kind, s, e in found:
        if out and kind == NAME == out[-1][0] and s - out[-1][2] <= 12 and _BETWEEN.fullmatch(text, out[-1][2], s):
            out[-1] = (NAME, out[-1][1], e)
        else:
            out.append((kind, s, e))
    return out


def mentions_of(text: str, tags: np.ndarray, margin: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the mentions of one text, in order and without overlap: the decoded spans
    that have the form of their kind. Then the text is reconciled as a whole: a word of a
    decoded name is a name at its other places too."""
    out: list[tuple[int, int, int]] = []
    taken = np.zeros(len(text) + 1, bool)
    names: set[str] = set()
    for kind, s, e in _merged(text, spans(tags)):
        span = clean(kind, text, s, e)
        if span and not taken[slice(*span)].any():
            taken[slice(*span)] = True
            out.append((kind, *span))
            if kind == NAME:
                names.update(regex.findall(r"\p{Lu}[\p{L}\p{M}]{4,}", text[slice(*span)]))
    return _repeated(text, sorted(out, key=lambda x: x[1]), names)


def _windows(c: np.ndarray, y: np.ndarray, starts: list[int], width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Windows that begin at the starts, without much overlap."""
    out, covered, n = [], -width, len(c)
    for s in sorted(max(0, min(x, n - width)) for x in starts):
        if s - covered < width // 2:
            continue
        covered = s
        row, lab = np.zeros(width, np.uint8), np.zeros(width, np.uint8)
        row[: len(c[s : s + width])], lab[: len(y[s : s + width])] = c[s : s + width], y[s : s + width]
        out.append((row, lab))
    return out


def _stacked(w: list[tuple[np.ndarray, np.ndarray]], rng: np.random.Generator, most: int) -> tuple[np.ndarray, np.ndarray]:
    pick = rng.permutation(len(w))[:most]
    return np.stack([w[i][0] for i in pick]), np.stack([w[i][1] for i in pick])


def _disguised(ids: np.ndarray, tags: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The windows with the letters of some names exchanged, vowels for vowels, so that a name is told
    by its place and not by its wording."""
    out = ids.copy()
    vowels = np.array([ord(c) - 96 for c in "aeiou"])
    others = np.array([x for x in range(1, 27) if x not in vowels])
    name = (tags == 1 + 2 * NAME) | (tags == 2 + 2 * NAME)
    for r in np.flatnonzero(name.any(1) & (rng.random(len(ids)) < DISGUISED)):
        to = np.arange(256, dtype=np.uint8)
        for group in (vowels, others):
            new = rng.permutation(group)
            to[group + 65], to[group + 33] = new + 65, new + 33  # codes of lower and upper case
        out[r, name[r]] = to[out[r, name[r]]]
    return out


def learn(texts: list[str], given: frozenset[str] = frozenset(), runner: Callable | None = None, rounds: tuple[int, int] = ROUNDS, width: int = SPAN, seed: int = 5) -> Tagger | None:
    """Two lessons: windows around every labelled span and elsewhere; then, once more, with the
    places where the first model differs from the labels. given: known given names in lower case;
    runner: see tagger.fit."""
    rng = np.random.default_rng(seed)
    texts = [t for t in texts if t]
    words = Words(texts, given)
    coded = [(t, codes(t)) for t in texts]
    labels = [label(t, words) for t in texts]
    w: list[tuple[np.ndarray, np.ndarray]] = []
    for (t, c), y in zip(coded, labels):
        begins = np.flatnonzero((y % 2 == 1) & (y != UNKNOWN))
        starts = [int(s - rng.integers(8, width - 20)) for s in begins]
        starts += [int(rng.integers(0, max(1, len(t) - width))) for _ in range(2 + len(begins) // 2)]
        w += _windows(c, y, starts, width)
    if not w:
        return None
    ids, tags = _stacked(w, rng, WINDOWS)
    model = fit(Tagger(), _disguised(ids, tags, rng), tags, rounds[0], 0.035, runner)
    hard: list[tuple[np.ndarray, np.ndarray]] = []
    for (t, c), y, (z, _) in zip(coded, labels, tag_texts(model, texts)):
        wrong = np.flatnonzero((y != z) & (y != UNKNOWN))
        hard += _windows(c, y, [int(s - rng.integers(8, width - 20)) for s in wrong[::5]], width)
    ids, tags = _stacked(w, rng, WINDOWS)
    if hard:
        more = _stacked(hard, rng, WINDOWS // 2)
        ids, tags = np.concatenate([ids, more[0]]), np.concatenate([tags, more[1]])
    return fit(model, _disguised(ids, tags, rng), tags, rounds[1], 0.03, runner)


def spark_runner(spark: SparkSession) -> Callable:
    """Carries out the jobs of a training round as Spark tasks. The windows (a bounded sample, a few MB)
    and the parameters (0.6 MB) are broadcast; a lost task is run again with the same result."""
    sent: dict[int, Broadcast] = {}

    def run(jobs: list, ids: np.ndarray, tags: np.ndarray) -> list[tuple[dict, dict]]:
        if id(ids) not in sent:
            for b in sent.values():
                b.destroy()
            sent.clear()
            sent[id(ids)] = spark.sparkContext.broadcast((ids, tags))
        data, todo = sent[id(ids)], spark.sparkContext.broadcast(jobs)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    out = pickle.dumps(shard_round(todo.value[i], *data.value))
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([out], pa.binary())], ["i", "out"])

        got = spark.range(0, len(jobs), 1, len(jobs)).mapInArrow(work, "i long, out binary").collect()  # one result a shard
        todo.destroy()
        return [pickle.loads(r["out"]) for r in sorted(got, key=lambda r: r["i"])]

    return run


def train(docs: DataFrame, key: str, text: str, given_names: DataFrame | None = None, name: str = "given_name") -> Tagger | None:
    """A tagger learnt from at most SAMPLE whole documents, the same ones for the same table; None for
    a table without texts. given_names: a list of given names of any length, of which the words
    of the sample are looked up. The rounds of training run as Spark tasks."""
    spark = docs.sparkSession
    rows = docs.filter(F.length(f"`{text}`") > 0).select(F.xxhash64(f"`{key}`").alias("h"), F.col(f"`{text}`").cast("string").alias("t"))
    picked = rows.orderBy("h", "t").limit(SAMPLE)
    texts = [r["t"] for r in picked.collect()]
    known: frozenset[str] = frozenset()
    if given_names is not None and texts:
        words = {p.lower() for t in texts for w in _CAPITAL.findall(t) for p in w.split("-")}
        said = spark.createDataFrame([(w,) for w in sorted(words)] or [("",)], "w string")
        known = frozenset(r["w"] for r in given_names.select(F.lower(f"`{name}`").alias("w")).join(said, "w", "left_semi").distinct().collect())
    return learn(texts, known, spark_runner(spark))


def save(model: Tagger, spark: SparkSession, path: str) -> None:
    """Writes a tagger as a small table, so that it is fitted once and used by any number of jobs."""
    rows = [(k, list(v.shape), v.astype(np.float32).tobytes()) for k, v in model.p.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, data binary").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Tagger:
    model = Tagger()
    model.p = {r["name"]: np.frombuffer(bytes(r["data"]), np.float32).reshape(r["shape"]) for r in spark.read.parquet(path).collect()}
    return model


def _repeated(text: str, out: list[tuple[int, int, int]], names: set[str]) -> list[tuple[int, int, int]]:
    """Adds the other places of a text where a word of a found name stands as a capitalised word."""
    if not names:
        return out
    taken = np.zeros(len(text) + 1, bool)
    for _, s, e in out:
        taken[s:e] = True
    names = {x for w in names for x in (w, w.upper(), w.capitalize())}
    p = regex.compile(r"(?<![\p{L}\d@._+-])(?:(?:" + _PARTICLE + r") )?(?:" + "|".join(sorted(map(regex.escape, names))) + r")(?![\p{L}\d@_+-]|\.\p{L})")
    more = [(NAME, *m.span()) for m in p.finditer(text) if not taken[m.start() : m.end()].any()]
    return sorted(out + more, key=lambda x: x[1]) if more else out


def redact(text: str, found: list[tuple[int, int, int]]) -> str:
    pieces, at = [], 0
    for kind, s, e in found:
        pieces += [text[at:s], PLACEHOLDERS[kind]]
        at = e
    return "".join(pieces) + text[at:]


def scan(docs: DataFrame, key: str, text: str, given_names: DataFrame | None = None, model: Tagger | None = None) -> DataFrame:
    """(key, mentions ARRAY<STRUCT<kind, mention, start, length>>, redacted) of every row: mentions
    in order of place (start counts code points from 0), and the text with typed placeholders
    for them. A null text gives an empty list and null; an empty one an empty list and ''.
    Whole texts are read, however long; repeated rows are repeated; other columns are ignored."""
    model = model or train(docs, key, text, given_names) or Tagger()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = balanced(docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").cast("string").alias("_text")))
    kind = rows.schema[key].dataType.simpleString()
    item = pa.struct([("kind", pa.string()), ("mention", pa.string()), ("start", pa.int32()), ("length", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                b = batch.slice(at, 1000)
                texts = b.column(1).to_pylist()
                different = list(dict.fromkeys(t for t in texts if t))
                tagged = dict(zip(different, tag_texts(tagger, different, LEAN)))
                lists, clear = [], []
                for t in texts:
                    m = mentions_of(t, *tagged[t]) if t else []
                    lists.append([{"kind": KINDS[k], "mention": t[s:e], "start": s, "length": e - s} for k, s, e in m])
                    clear.append(redact(t, m) if t else t)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lists, pa.list_(item)), pa.array(clear, pa.string())], [key, "mentions", "redacted"])

    return rows.mapInArrow(run, f"`{key}` {kind}, mentions array<struct<kind:string,mention:string,start:int,length:int>>, redacted string")
