"""Broken prompt-response pairs (problem 4)."""

from __future__ import annotations

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slabwise.llm.unfinished import unfinished

COPY_SHARE = 0.6  # of the answer's word triples that stand in the prompt
COPY_WORDS = 6  # from which triples tell a copy; a shorter answer is one if the prompt begins with it
LANGUAGE_LEAST = 3  # different function words that must speak for a language
LANGUAGE_WORDS = 6

#: Function words that tell the languages apart.
FUNCTION_WORDS = {
    "en": "the of and with is in on to for at by no was as from this a an are there within or not be but it that has have been which".split(),
    "de": "der die das und mit ist im am zur zum den dem eine keine kein für bei wegen nicht von zu des auf durch über zwischen ein einen einer sich auch vom beim oder wird sind".split(),
    "es": "el la los las de del en con por y es un una no se para sin al que hay hacia ante entre su lo como más está desde o".split(),
    "fr": "le la les du des de en avec par et est un une pas au aux sur dans sans vers près pour on devant ce cette qui que ne ou plus".split(),
    "it": "il lo la gli le di del della dei delle in con per e è un una non si da al alla che nel nella sono più senza tra".split(),
    "nl": "de het een en van in op met is niet geen voor bij door aan te zijn dat die er naar tussen over uit wordt".split(),
    "pt": "o a os as de do da dos das em no na com por e é um uma não se para sem ao à que há entre mais".split(),
}
#: Languages as prompts name them.
LANGUAGE_NAMES = {
    "en": "english englisch englische englischer englischen inglés inglesa anglais anglaise".split(),
    "de": "german deutsch deutsche deutscher deutschen alemán alemana allemand allemande".split(),
    "es": "spanish spanisch spanische spanischer spanischen español española espagnol espagnole".split(),
    "fr": "french französisch französische französischer französischen francés francesa français française".split(),
}
#: What declines a task, in the four languages.
REFUSAL = (
    r"(?i)\b(?:cannot|can['’]?t|can not|unable to|not able to|won['’]t|will not|must decline|have to decline|decline to|refuse|rather not|not possible for me"
    r"|not comfortable|do not feel comfortable|don['’]t feel comfortable|outside (?:my|what i)|beyond (?:my|what i)|nothing to contribute|no report can be|not (?:allowed|permitted|authori[sz]ed|qualified)"
    r"|so i pass|i pass\b|(?:consult|ask|see|contact|take (?:these|this|them)[^.;]{0,40}? to) an? (?:qualified |medical |licensed )?(?:doctor|radiologist|specialist|professional|physician|clinician)"
    r"|only an? (?:doctor|radiologist|specialist|professional|physician|clinician)"
    r"|kann (?:ich|das|dies)[^.]{0,40}\bnicht|darf ich|ich darf|nicht in der lage|tut mir leid|lehne ich|ich lehne|leider (?:kann|darf|ist)|keine auskunft|nicht möglich"
    r"|no puedo|no me es posible|lo siento|lamentablemente|me niego|no estoy (?:autorizad|en condiciones)|je ne (?:peux|suis)|désolée?|impossible pour moi|je refuse|je regrette)"
)
#: Headings and measures by which a text reports something.
HEADING = r"impression(?: first)?|findings|vascular (?:summary|findings)|report|befund|beurteilung|conclusi[oó]n|hallazgos|impresi[oó]n|informe|résultats|conclusion|compte rendu"
MEASURE = r"(?i)\d+(?:[.,]\d+)?\s?(?:mm|HU|HE|UH|percent|Prozent|por ciento|pour cent|millimetres?|%)(?![\p{L}])|\b(?:slabs?|sections?|schicht(?:en)?|cortes?|coupes?)\s\d|\d+ slabs affected"
#: Words that stand for a missing answer.
PLACEHOLDER = r"n\s?/\s?a|n\.a\.|none|null|nil|nan|tbd|todo|pending|empty|no answer|no response|no output|missing|placeholder|blank|keine antwort|leer|k\.\s?a\.|sin respuesta|vacío|sans réponse|vide|undefined|lorem ipsum"
_MARKUP = r"<\|?/?[\p{L}_][^<>]*\|?>|&nbsp;|```\w*"


def _words(text: str) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def empty(text: Column, words: Column) -> Column:
    """Nothing but blanks, headings, placeholders or markup; null too. words: those of the text."""
    known = set(regex.findall(r"\p{L}+", HEADING.replace("[oó]", "ó") + " " + PLACEHOLDER.replace(r"\s", " ")))
    said = F.exists(words, lambda w: ~w.isin(sorted(known)))  # a word that is no heading and no placeholder
    full = said & ~F.contains(text, F.lit("<")) & ~F.contains(text, F.lit("&")) & ~F.contains(text, F.lit("`"))
    rest = F.when(full, F.lit("x")).otherwise(text)  # only what may be empty goes through the patterns
    bare = F.regexp_replace(rest, _MARKUP, " ")
    bare = F.regexp_replace(bare, rf"(?i)(?<![\p{{L}}])(?:{HEADING})\s*(?::|(?=\W*$)|(?=\W*\n))", " ")
    bare = F.trim(F.regexp_replace(bare, r"[\s\p{Z}\p{C}\p{P}\p{S}]+", " "))
    mark = F.trim(F.regexp_replace(rest, r"[\s\p{Z}\p{C}\[\](){}<>*_#|\"'.:-]+", " "))
    nothing = (bare == "") | mark.rlike(rf"(?i)^(?:{PLACEHOLDER})$") | bare.rlike(rf"(?i)^(?:{PLACEHOLDER.replace('.', ' ?')})$")
    return F.coalesce(nothing, F.lit(True))


#: Delimiters that come in pairs.
PAIRS = (("(", ")"), ("[", "]"), ("{", "}"), ("«", "»"), ("„", "“"))


def unclosed(text: Column) -> Column:
    """Whether a bracket, quotation or code fence is opened and not closed: more openings than closings
    over the whole text, or an odd number of fences."""
    many = lambda mark: (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark)
    out = F.contains(text, F.lit("```")) & (many("```") % 2 == 1)
    for a, b in PAIRS:
        out = out | F.contains(text, F.lit(a)) & (many(a) > many(b))
    return out


def telling(words: Column) -> Column:
    """The different words that some list of function words or language names has, so that a text's words are gone through once."""
    known = sorted({w for v in [*FUNCTION_WORDS.values(), *LANGUAGE_NAMES.values()] for w in v})
    return F.array_distinct(F.filter(words, lambda w: w.isin(known)))


def _spoken(told: Column, language: str) -> Column:
    """Number of the different function words of a language. told: telling() of the words."""
    return F.size(F.filter(told, lambda w: w.isin(FUNCTION_WORDS[language])))


def _language(told: Column) -> Column:
    """struct(lang, n) of the language with the most different function words; ties by name."""
    return F.greatest(*[F.struct(_spoken(told, k).alias("n"), F.lit(k).alias("lang")) for k in sorted(FUNCTION_WORDS, reverse=True)])


def may_copy(answer: Column, prompt: Column) -> Column:
    """Whether the share of the answer's triples in the prompt can reach COPY_SHARE, by words alone. Each
    different word that begins a triple and isn't in the prompt begins a different triple that isn't there, and
    the answer has no more different triples than places."""
    places = F.size(answer) - 2
    missing = F.size(F.array_except(F.slice(answer, 1, F.greatest(places, F.lit(0))), prompt))
    return (F.size(answer) >= COPY_WORDS) & (missing <= (1 - COPY_SHARE) * places + 0.5)  # 0.5: above rounding


def pair_defects(rows: DataFrame) -> DataFrame:
    """(field, rec_id, defects, defect): every triggered defect type of each answer, and the first of
    them in the order empty, copy, refusal, other_language, truncated; only defective answers.

    rows: (field, rec_id, source, prompt, answer); other columns are ignored. A null answer is
    empty; a null prompt neither is copied nor has a language. Whole texts are judged. An
    answer that only quotes its prompt's sentences before its own report is no copy, and a
    refusal is none when the text reports measures or has filled headings. A language
    counts from 6 words and 3 different function words on; a script of its own counts too. An
    answer is truncated if it is unfinished or leaves a delimiter open.
    Repeated rows give one row; rows without a field or an id are left out."""
    base = rows.select("field", "rec_id", "source", "prompt", "answer").filter(F.col("field").isNotNull() & F.col("rec_id").isNotNull())
    w = base.withColumn("_a", _words("answer")).withColumn("_p", _words("prompt"))

    def triples(c: str) -> Column:
        n = F.size(c)
        return F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(c, i), F.get(c, i + 1), F.get(c, i + 2)))).otherwise(F.array().cast("array<bigint>"))

    w = w.withColumn("_may", may_copy(F.col("_a"), F.col("_p"))).withColumn("_ca", F.when(F.col("_may"), F.col("_a"))).withColumn("_cp", F.when(F.col("_may"), F.col("_p")))
    w = w.withColumn("_at", F.array_distinct(triples("_ca"))).withColumn("_pt", triples("_cp"))
    shared = F.size(F.array_intersect("_at", "_pt"))
    begins = (F.size("_a") >= 2) & (F.size("_p") > F.size("_a")) & (F.slice("_p", 1, F.greatest(F.size("_a"), F.lit(1))) == F.col("_a"))
    is_copy = begins | (F.size("_a") >= COPY_WORDS) & (F.size("_at") > 0) & (shared >= COPY_SHARE * F.size("_at"))
    reports = F.col("answer").rlike(MEASURE) | F.col("answer").rlike(rf"(?i)(?<![\p{{L}}])(?:{HEADING})\W{{0,3}}[:\n]")
    is_refusal = F.when(reports, F.lit("")).otherwise(F.col("answer")).rlike(REFUSAL)

    foreign = r"\p{IsCyrillic}\p{IsArabic}\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsGreek}\p{IsHebrew}\p{IsDevanagari}\p{IsThai}"
    w = w.withColumn("_ta", telling(F.col("_a"))).withColumn("_tp", telling(F.col("_p")))
    w = w.withColumn("_la", _language(F.col("_ta"))).withColumn("_lp", _language(F.col("_tp")))
    asked = F.coalesce(*[F.when(F.arrays_overlap("_tp", F.array(*map(F.lit, v))), F.lit(k)) for k, v in LANGUAGE_NAMES.items()])
    letters, alien = F.regexp_replace("answer", r"[^\p{L}]+", ""), F.regexp_replace("answer", rf"[^{foreign}]+", "")
    wide = F.octet_length("answer") > 1.25 * F.length("answer")  # these scripts take two bytes a letter and more
    script = F.when(wide, (F.length(alien) > 0.3 * F.length(letters)) & ~F.coalesce(F.col("prompt"), F.lit("")).rlike(f"[{foreign}]")).otherwise(F.lit(False))
    wanted = F.coalesce(asked, F.col("_lp.lang"))
    sure = (F.size("_a") >= LANGUAGE_WORDS) & (F.col("_la.n") >= LANGUAGE_LEAST) & (F.col("_lp.n") >= 3)
    ahead = F.col("_la.n") >= 2 * F.coalesce(*[F.when(wanted == k, _spoken(F.col("_ta"), k)) for k in FUNCTION_WORDS])
    is_foreign = (sure & (F.col("_la.lang") != wanted) & ahead) | script

    cut = unfinished(base.select("field", "rec_id", "source", F.col("answer").alias("text"))).select("field", "rec_id", F.lit(True).alias("_cut"))
    flags = w.select(
        "field", "rec_id", empty(F.col("answer"), F.col("_a")).alias("empty"), F.coalesce(is_copy, F.lit(False)).alias("copy"), F.coalesce(is_refusal, F.lit(False)).alias("refusal"), F.coalesce(is_foreign, F.lit(False)).alias("other_language"),
        F.coalesce(unclosed(F.col("answer")), F.lit(False)).alias("unclosed"),
    )
    flags = flags.join(cut, ["field", "rec_id"], "left").withColumn("truncated", F.coalesce("_cut", F.lit(False)) | F.col("unclosed"))
    order = ["empty", "copy", "refusal", "other_language", "truncated"]
    listed = flags.select("field", "rec_id", F.array_compact(F.array(*[F.when(F.col(x), F.lit(x)) for x in order])).alias("defects"))
    return listed.filter(F.size("defects") > 0).dropDuplicates(["field", "rec_id"]).withColumn("defect", F.element_at("defects", 1))
