"""Pieces of the reference SQL: the same results in another engine's dialect."""

from __future__ import annotations

from slabwise.functions import vocab as V


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def toks(t: str) -> str:
    return f"list_filter(string_split_regex(lower({t}), {q(V.BLANK)}), lambda x: x <> '')"


def grams(w: str, n: int) -> str:
    if n == 1:
        return w
    return f"list_transform(range(1, len({w}) - {n - 2}), lambda i: array_to_string(({w})[i:i + {n - 1}], ' '))"


def rouge_n(r: str, h: str, n: int) -> str:
    a, b = f"list_distinct({grams(r, n)})", f"list_distinct({grams(h, n)})"
    return f"CASE WHEN len({a}) > 0 THEN len(list_intersect({a}, {b}))::DOUBLE / len({a}) ELSE 0.0::DOUBLE END"


def lcs(r: str, h: str) -> str:
    inner = f"list_reduce(range(1, len({r}) + 1), lambda cur, j: list_append(cur, CASE WHEN {r}[j] = y THEN prev[j] + 1 ELSE greatest(prev[j + 1], cur[j]) END), [0])"
    return f"list_extract(list_reduce({h}, lambda prev, y: {inner}, list_transform(range(0, len({r}) + 1), lambda i: 0)), -1)"


def rouge_l(r: str, h: str) -> str:
    return f"CASE WHEN len({r}) = 0 THEN 0.0::DOUBLE WHEN len({h}) = 0 THEN 0.0::DOUBLE ELSE ({lcs(r, h)})::DOUBLE / len({r}) END"


def any_of(t: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({t}, {q(x)})" for x in terms) + ")"


def count_of(t: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"contains({t}, {q(x)})::INT" for x in terms) + ")"


def has(t: str, pattern: str) -> str:
    return f"regexp_matches({t}, {q(pattern)}, 'i')"


def order(t: str) -> str:
    at = [f"length(regexp_extract({t}, {q('(?is)^(.*?)' + p)}, 1))" for p in (V.VASCULAR, V.IMPRESSION)]
    return f"CASE WHEN {has(t, V.VASCULAR)} AND {has(t, V.IMPRESSION)} THEN {at[0]} < {at[1]} END"


def structure(t: str) -> str:
    n = f"len({toks(t)})"
    return (
        f"(CASE WHEN {has(t, V.IMPRESSION)} THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN {has(t, V.VASCULAR)} THEN 0.3::DOUBLE ELSE 0 END"
        f" + CASE WHEN {n} BETWEEN 20 AND 500 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN coalesce({order(t)}, false) THEN 0.2::DOUBLE ELSE 0 END)"
    )


def mentioned(t: str) -> str:
    return f"list_filter([{', '.join(map(q, V.VESSEL_TERMS))}], lambda v: contains(lower({t}), v))"


def unsupported(p: str, r: str) -> str:
    return f"CASE WHEN length({r}) > 0 THEN list_filter({mentioned(p)}, lambda v: NOT contains(lower({r}), v)) ELSE []::VARCHAR[] END"


def contradictions(t: str) -> str:
    low = f"lower({t})"
    return f"(({any_of(low, V.NORMAL_TERMS)} AND {any_of(low, V.FINDING_TERMS)})::INT + (contains({low}, 'acute') AND contains({low}, 'chronic') AND NOT contains({low}, 'acute on chronic'))::INT)"


def clip(x: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"


def hallucination(p: str, r: str) -> str:
    return clip(f"1.0::DOUBLE - 0.2::DOUBLE * len({unsupported(p, r)}) - 0.3::DOUBLE * {contradictions(p)}")


def changes(t: str) -> str:
    parts = []
    for v in V.VESSEL_TERMS:
        side = f"CASE WHEN contains(l, 'left {v}') OR contains(l, '{v} left') THEN 1 WHEN contains(l, 'right {v}') OR contains(l, '{v} right') THEN 2 END"
        s = f"list_filter(list_transform(string_split(lower({t}), chr(10)), lambda l: {side}), lambda s: s IS NOT NULL)"
        parts.append(f"CASE WHEN contains(lower({t}), '{v}') THEN len(list_filter(list_zip({s}[2:], {s}[:-2]), lambda z: z[1] <> z[2])) ELSE 0 END")
    return "(" + " + ".join(parts) + ")"


def bilateral(t: str) -> str:
    part = f"substring(lower({t}), strpos(lower({t}), 'bilateral'), 200)"
    return f"(contains(lower({t}), 'bilateral') AND (contains({part}, 'left') OR contains({part}, 'right')))"


def consistency(t: str) -> str:
    return clip(f"1.0::DOUBLE - 0.25::DOUBLE * {changes(t)} - CASE WHEN {bilateral(t)} THEN 0.15::DOUBLE ELSE 0 END")


def uncertainty(t: str) -> str:
    return clip(f"1.0::DOUBLE - 0.1::DOUBLE * {count_of(f'lower({t})', V.OVERCONFIDENT)}")


def impression(t: str) -> str:
    return f"regexp_extract({t}, {q(V.IMPRESSION_TEXT)}, 1, 'is')"


def clinical(p: str, r: str) -> str:
    return f"({hallucination(p, r)} * 0.4::DOUBLE + {consistency(p)} * 0.35::DOUBLE + {uncertainty(p)} * 0.25::DOUBLE)"


def vessels(t: str) -> str:
    parts = ", ".join(f"CASE WHEN {has(t, p)} THEN '{k}' END" for k, p in V.VESSEL_PATTERNS.items())
    return f"list_filter([{parts}], lambda v: v IS NOT NULL)"


def side(t: str) -> str:
    b, le, r = (has(t, rf"\b{x}\b") for x in ("bilateral", "left", "right"))
    return f"CASE WHEN {b} THEN 'bilateral' WHEN {le} AND {r} THEN NULL WHEN {le} THEN 'left' WHEN {r} THEN 'right' END"


def claims(t: str) -> dict[str, str]:
    told = f"list_filter(string_split_regex({t}, {q(V.CLAUSE_END)}), lambda c: {has('c', V.POSITIVE)})"
    neg = f"len(list_filter({told}, lambda c: {has('c', V.NEGATION)}))"
    pos = f"len(list_filter({told}, lambda c: NOT {has('c', V.NEGATION)}))"
    return {
        "positive": f"({pos} > 0)", "negative": f"({neg} > 0 OR {has(t, V.NEGATIVE)})", "vessels": vessels(t), "side": side(t), "hedged": has(t, V.HEDGE),
        "overconfident": count_of(f"lower({t})", V.OVERCONFIDENT),
    }


def truth(j: str, k: str) -> str:
    """Truthiness of a key that is there; null for one that is absent."""
    kind, text = f"json_type({j}, '$.{k}')", f"json_extract_string({j}, '$.{k}')"
    return f"CASE WHEN {kind} IS NULL THEN NULL WHEN {kind} = 'NULL' THEN false WHEN {kind} = 'VARCHAR' THEN {text} <> '' WHEN {kind} = 'BOOLEAN' THEN {text} = 'true' ELSE {text} NOT IN ('0', '0.0', '[]', '{{}}') END"


def labels(j: str) -> dict[str, str]:
    def text(k: str) -> str:
        kind = f"json_type({j}, '$.{k}')"
        return f"CASE WHEN {kind} IS NULL THEN '' WHEN {kind} = 'NULL' THEN 'None' ELSE json_extract_string({j}, '$.{k}') END"

    def own(k: str) -> str:
        return f"CASE WHEN {truth(j, k)} THEN lower(json_extract_string({j}, '$.{k}')) END"

    region = " || ' ' || ".join(f"({text(k)})" for k in ("main_region", "region", "vessel", "side", "laterality"))
    return {
        "anomaly": f"coalesce({truth(j, 'anomaly_present')}, {truth(j, 'anomaly')})",
        "vessel": f"coalesce(list_extract({vessels(f'({region})')}, 1), {own('vessel')})", "side": f"coalesce({side(f'({region})')}, {own('side')}, {own('laterality')})",
    }


def fact(c: str, g: str, k: str) -> str:
    """Columns available, score, detection, vessel, side, calibration over columns of a subquery."""
    return f"""
      SELECT *, {clip("(coalesce(detection * 0.45::DOUBLE, 0) + coalesce(vessel_axis * 0.2::DOUBLE, 0) + coalesce(side_axis * 0.25::DOUBLE, 0) + calibration * 0.1::DOUBLE)"
        " / ((CASE WHEN detection IS NULL THEN 0 ELSE 0.45::DOUBLE END) + (CASE WHEN vessel_axis IS NULL THEN 0 ELSE 0.2::DOUBLE END) + (CASE WHEN side_axis IS NULL THEN 0 ELSE 0.25::DOUBLE END) + 0.1::DOUBLE)"
        f" * greatest(0.0::DOUBLE, 1.0::DOUBLE - 0.3::DOUBLE * {k})")} AS fact_score,
        (detection IS NOT NULL OR vessel_axis IS NOT NULL OR side_axis IS NOT NULL) AS available
      FROM (SELECT *,
        CASE WHEN {g}anomaly IS NULL THEN NULL
             WHEN {g}anomaly THEN CASE WHEN {c}positive THEN 1.0::DOUBLE WHEN {c}negative AND NOT {c}hedged THEN 0.0 WHEN {c}hedged THEN 0.5 ELSE 0.3 END
             ELSE CASE WHEN {c}positive THEN 0.0::DOUBLE WHEN {c}negative THEN 1.0 WHEN {c}hedged THEN 0.7 ELSE 0.5 END END AS detection,
        CASE WHEN {g}anomaly AND length({g}vessel) > 0 THEN CASE WHEN len({c}vessels) = 0 THEN 0.3::DOUBLE WHEN list_contains({c}vessels, {g}vessel) THEN 1.0 ELSE 0.0 END END AS vessel_axis,
        CASE WHEN {g}anomaly AND {g}side IN ('left', 'right', 'bilateral') THEN CASE WHEN {c}side IS NULL THEN 0.3::DOUBLE WHEN {c}side = {g}side THEN 1.0 ELSE 0.0 END END AS side_axis,
        {clip(f"CASE WHEN {g}anomaly = false AND {c}hedged THEN least(1.0::DOUBLE, 1.0::DOUBLE - 0.25::DOUBLE * {c}overconfident + 0.1::DOUBLE) ELSE 1.0::DOUBLE - 0.25::DOUBLE * {c}overconfident END")} AS calibration
      FROM base)"""


def bleu(source: str, key: str, r: str, h: str) -> str:
    """(key, bleu_1..4, bleu) of a relation with token lists r and h."""
    each = " UNION ALL ".join(f"SELECT {key}, {n} AS n, {s} AS side, unnest({grams(w, n)}) AS g FROM {source}" for n in range(1, 5) for w, s in ((r, 0), (h, 1)))
    cols = ", ".join(f"coalesce(max(CASE WHEN n = {n} THEN m / greatest(t, 1) END), 0)::DOUBLE AS bleu_{n}" for n in range(1, 5))
    logs = " + ".join(f"ln(bleu_{n})" for n in range(1, 5))
    return f"""
      SELECT s.{key}, {', '.join(f'coalesce(bleu_{n}, 0)::DOUBLE AS bleu_{n}' for n in range(1, 5))},
        CASE WHEN coalesce(least(bleu_1, bleu_2, bleu_3, bleu_4), 0) > 0 THEN
          (CASE WHEN len({h}) > len({r}) THEN 1.0::DOUBLE ELSE exp(1 - len({r})::DOUBLE / greatest(len({h}), 1)) END) * exp(({logs}) / 4) ELSE 0.0::DOUBLE END AS bleu
      FROM {source} s LEFT JOIN (SELECT {key}, {cols} FROM (
        SELECT {key}, n, sum(least(r, h))::DOUBLE AS m, sum(h)::DOUBLE AS t FROM (
          SELECT {key}, n, g, count(*) FILTER (side = 0) AS r, count(*) FILTER (side = 1) AS h FROM ({each}) GROUP BY ALL) GROUP BY {key}, n) GROUP BY {key}) b ON s.{key} = b.{key}"""
