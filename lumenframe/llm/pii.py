"""Personal data by weak supervision, with DataFrame functions only.

The base patterns find spans that always count. Wider patterns propose further candidates; labelers vote on each: its
shape (pattern), its digits (checksum or length), a gazetteer of issuers, prefixes and words before it, and
its surroundings. Candidates with equal votes and equal form are counted together, so that what is left to fit is a
table whose size the labelers bound, not the corpus. On it expectation-maximisation estimates each labeler's
reliability; the posteriors are the soft labels of a logistic span classifier, which then accepts candidates.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import stored

# Fixed patterns. (?:\G|(?<!..)) starts a match only where a run begins or the last match ended, which a search
# from the left does anyhow; possessive repeats do not go back, as nothing that follows could match less. Both keep the
# search linear in long runs.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # 13 to 19 digits of the longest run, or nothing
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Candidates beyond the base; those of cards pass the Luhn test.
WIDER = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:\x20?[\[(](?:at|AT)[\])]\x20?|\x20at\x20|\x20?@\x20?)[A-Za-z0-9-]{1,63}+(?:(?:\x20?[\[(](?:dot|DOT)[\])]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]{2,24}+)++",
    "ip": r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){2,7}+(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4})(?![0-9])",
    "phone": r"(?<![0-9])\+?(?:[0-9]{1,3}[\x20.-])?\([0-9]{2,4}\)[\x20.-]?[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9])(?=[0-9]{0,64}[A-Za-z])(?=[A-Za-z]{0,64}[0-9])(?:[0-9a-f]{16,64}|[A-Z0-9]{16,40})(?![A-Za-z0-9])",
}
#: Kinds in the order of results.
KINDS = ("email", "ip", "card", "phone", "secret")
#: A regular expression that a candidate with a plausible form matches.
SHAPES = {
    "email": r"[\[(@]|\x20at\x20.*\x20dot\x20",
    "ip": r"::|^(?:[^:]+:){7}[^:]+$",
    "card": r"^[0-9]{15,16}$|[\x20-]",
    "phone": r"^\+?[0-9]|^\([0-9]{3,4}\)",
    "secret": r"^(?:[0-9a-f]{18}|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[A-Z0-9]{20})$",
}
#: Gazetteers: how each kind begins or ends, and words that stand before it.
ISSUERS = {
    "email": r"(?i)[\x20.)\]](?:com|org|net|edu|gov|info|io|co|eu|uk|de|fr|es|it|nl|example)$",
    "ip": r"(?i)^(?:20[0-9a-f]{2}|2[4-9a-f][0-9a-f]{2}|fe80|f[cd][0-9a-f]{2}):",
    "card": r"^(?:4|5[1-5]|2[2-7]|34|37|6011|65)",
    "phone": r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])[^0-9]|^\(?0[1-9]|^\([2-9][0-9]{2}\)",
    "secret": r"^(?:AKIA|ASIA)",
}
WORDS = {
    "email": r"(?i)(?:e-?mail|mail|write to|contact|correo|courriel)\W{0,3}$",
    "ip": r"(?i)(?:ip|ipv6|host|server|addr|address|from)\W{0,3}$",
    "card": r"(?i)(?:card|visa|mastercard|karte|carte|tarjeta)\W{0,3}$",
    "phone": r"(?i)(?:phone|call|tel|telefon|mobile|fax)\W{0,3}$",
    "secret": r"(?i)(?:password|passwd|pwd|secret|token|key)\W{0,4}$",
}
LABELERS = ("shape", "digits", "gazetteer", "context")
FORMS = ("long", "separated", *KINDS)
#: Counts of prior belief that each labeler's rates start with.
PRIOR = 4.0

_BLOCK = 256


def _luhn(text: str) -> str:
    """SQL: whether the digits in ``text`` pass the Luhn test."""
    d = f"reverse(regexp_replace({text}, '[^0-9]', ''))"
    return f"""(aggregate(transform(split({d}, '(?<=.)(?=.)'), (x, i) -> IF(i % 2 = 1, IF(int(x) > 4, int(x) * 2 - 9, int(x) * 2), int(x))), 0, (a, x) -> a + x) % 10 = 0)"""


def _found(df: DataFrame, patterns: dict[str, str], prefix: str) -> DataFrame:
    """Adds for each kind an array {prefix}_{kind} of (start, end, t), code points, of all its matches in _text."""
    for step in ("match", "gap"):
        columns = {}
        for kind, pattern in patterns.items():
            maybe = F.col("_text").contains("@") if (prefix, kind) == ("base", "email") else F.col("_text").rlike("(?i)[ \\[(]at[ \\])]|@") if kind == "email" else F.col("_text").contains(":") if (prefix, kind) == ("wider", "ip") else F.col("_text").contains("+") if (prefix, kind) == ("base", "phone") else F.lit(True)
            found = F.regexp_extract_all("_text", F.lit(pattern), F.lit(0)) if step == "match" else F.when(F.size(f"{prefix}_{kind}_match") > 0, F.split("_text", pattern, -1))
            columns[f"{prefix}_{kind}_{step}"] = F.when(maybe, found).otherwise(F.array().cast("array<string>")) if step == "match" else found
        df = df.withColumns(columns)
    lengths, sums, spans = {}, {}, {}
    for kind in patterns:
        name = f"{prefix}_{kind}"
        lengths[f"{name}_n"] = F.expr(f"transform({name}_match, (m, i) -> struct(char_length({name}_gap[i]) AS g, char_length({name}_gap[i]) + char_length(m) AS a))")
        # where each block of matches starts: sums within a block stay short however many matches a text has
        sums[f"{name}_at"] = F.expr(
            f"aggregate(transform(sequence(0, greatest(0, size({name}_n) - 1) div {_BLOCK}), b -> aggregate(slice({name}_n, b * {_BLOCK} + 1, {_BLOCK}), 0L, (s, x) -> s + x.a)), array(0L), (s, x) -> s || array(element_at(s, -1) + x))"
        )
        before = f"element_at({name}_at, int(i div {_BLOCK}) + 1) + aggregate(slice({name}_n, int(i div {_BLOCK}) * {_BLOCK} + 1, i % {_BLOCK}), 0L, (s, y) -> s + y.a)"
        spans[name] = F.expr(f"transform(transform({name}_match, (m, i) -> struct({before} + {name}_n[i].g AS start, m AS t)), x -> struct(x.start AS start, x.start + char_length(x.t) AS end, x.t AS t))")
    df = df.withColumns(lengths).withColumns(sums).withColumns(spans)
    return df.drop(*[f"{prefix}_{k}_{s}" for k in patterns for s in ("match", "gap", "n", "at")])


def _votes(kind: str) -> str:
    """SQL: the candidate ``x`` with its labelers' votes (1, -1, 0: none) and its form."""
    digits = "regexp_replace(x.t, '[^0-9]', '')"
    good = {
        "email": "x.t rlike '[A-Za-z]{2,}[^A-Za-z0-9]*$'",
        "ip": "x.t rlike '[A-Fa-f]' AND x.t rlike '[0-9]' AND NOT x.t rlike '^([0-9A-Fa-f]{2}:){2,5}[0-9A-Fa-f]{2}$'",
        "card": f"char_length({digits}) = IF({digits} rlike '^3[47]', 15, 16)",
        "phone": f"char_length({digits}) BETWEEN 9 AND 15",
        "secret": "char_length(regexp_replace(x.t, '[^0-9]', '')) BETWEEN char_length(x.t) div 8 AND char_length(x.t) * 7 div 8",
    }[kind]
    start = "substring(_text, int(greatest(0, x.start - 16)) + 1, int(least(16, x.start)))"
    return f"""struct('{kind}' AS kind, x.start AS start, x.end AS end,
        IF(x.t rlike r'{SHAPES[kind]}', 1, -1) AS shape,
        IF({good}, 1, -1) AS digits,
        IF(x.t rlike r'{ISSUERS[kind]}' OR {start} rlike r'{WORDS[kind]}', 1, {0 if kind in ("secret", "phone") else -1}) AS gazetteer,
        IF({start} rlike r'[A-Za-z0-9_/#-]$' OR substring(_text, int(x.end) + 1, 1) rlike r'[A-Za-z0-9_/#]', -1, 1) AS context,
        int(char_length(x.t) > 16) AS long, int(x.t rlike r'[\\x20().-]') AS separated)"""


def candidates(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with base (kind, start, end) and wider (the same, with votes and form)."""
    given = [c for c in docs.columns if c != text_col]
    df = docs.select(*[F.col(f"`{c}`").alias(f"given_{i}") for i, c in enumerate(given)], F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    df = _found(df, BASE, "base")
    parts = "transform(split(x.t, '\\\\.'), p -> regexp_replace(p, '^0+(?=.)', ''))"
    keep = {
        "email": "true",
        "ip": f"forall({parts}, p -> char_length(p) <= 3 AND int(p) <= 255)",
        "card": _luhn("x.t"),
        "phone": "char_length(regexp_replace(x.t, '[^0-9]', '')) BETWEEN 9 AND 15",
    }
    base = "concat(" + ", ".join(f"transform(filter(base_{k}, x -> {keep[k]}), x -> struct('{k}' AS kind, x.start AS start, x.end AS end))" for k in BASE) + ")"
    df = df.withColumn("base", F.expr(base)).drop(*[f"base_{k}" for k in BASE])
    df = _found(df, WIDER, "wider")
    inside = "exists(base, b -> b.kind = '{k}' AND b.start < x.end AND x.start < b.end)"
    wider = "concat(" + ", ".join(f"transform(filter(wider_{k}, x -> NOT {inside.format(k=k)}{' AND ' + _luhn('x.t') if k == 'card' else ''}), x -> {_votes(k)})" for k in WIDER) + ")"
    return df.select(*[F.col(f"given_{i}").alias(c) for i, c in enumerate(given)], "base", F.expr(wider).alias("wider"))


def fit(patterns: list[tuple[tuple[int, ...], tuple[int, ...], int]], *, rounds: int = 50) -> tuple[dict[str, tuple[float, float]], list[float]]:
    """Of (votes, form, count): each labeler's hit rates on true and false spans, and the classifier's weights (bias first).

    The table has a row for each combination of votes and form, a few hundred at most.
    """
    rate = [[0.8, 0.3] for _ in LABELERS]  # P(vote 1 | true), P(vote 1 | false) among votes cast
    prior = 0.5
    total = sum(n for _, _, n in patterns)
    post = [0.5] * len(patterns)
    for _ in range(rounds if total else 0):
        for i, (votes, _, _) in enumerate(patterns):
            odds = math.log(prior / (1 - prior))
            for (t, f), v in zip(rate, votes, strict=True):
                odds += math.log(t / f) if v > 0 else math.log((1 - t) / (1 - f)) if v < 0 else 0.0
            post[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        prior = min(0.95, max(0.05, sum(p * n for p, (_, _, n) in zip(post, patterns, strict=True)) / total))
        for k in range(len(LABELERS)):
            for side in (0, 1):
                w = [(p if side == 0 else 1 - p) * n for p, (_, _, n) in zip(post, patterns, strict=True)]
                yes = sum(x for x, (v, _, _) in zip(w, patterns, strict=True) if v[k] > 0)
                no = sum(x for x, (v, _, _) in zip(w, patterns, strict=True) if v[k] < 0)
                # a few counts of prior belief keep the rates inside (0, 1) and the classes apart
                rate[k][side] = (yes + PRIOR * (0.8, 0.3)[side]) / (yes + no + PRIOR)
    weights = [0.0] * (1 + len(LABELERS) + len(FORMS))
    for t in range(400 if total else 0):
        slope = [1e-3 * w for w in weights]
        for (votes, form, n), p in zip(patterns, post, strict=True):
            x = (1, *votes, *form)
            z = sum(a * b for a, b in zip(weights, x, strict=True))
            g = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - p) * n / total
            for j, b in enumerate(x):
                slope[j] += g * b
        weights = [w - 2.0 / (1 + t / 200) * s for w, s in zip(weights, slope, strict=True)]
    return dict(zip(LABELERS, map(tuple, rate), strict=True)), weights


def find_pii(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with base and spans: arrays of (kind, start, end), code points, end exclusive.

    spans holds the base and the accepted candidates, ordered by kind, start and end. A null text is empty and has
    none; repeated rows stay as they are; columns of docs named base, wider or spans are replaced. The candidates of
    all texts are stored once, without the texts, and read for the fit and for the result.
    """
    kept = docs.drop("base", "wider", "spans")
    found = stored(candidates(kept, text_col=text_col))
    x = found.select(F.explode("wider").alias("x")).select("x.*")
    form = [F.col("long"), F.col("separated"), *[(F.col("kind") == k).cast("int").alias(k) for k in KINDS]]
    rows = x.select(*LABELERS, *form).groupBy(*LABELERS, *FORMS).agg(F.count("*").alias("n")).collect()
    patterns = sorted((tuple(r[k] for k in LABELERS), tuple(r[k] for k in FORMS), r["n"]) for r in rows)
    _, w = fit(patterns)
    z = " + ".join([str(w[0]), *(f"({a}) * x.{k}" for a, k in zip(w[1 : 3 + len(LABELERS)], [*LABELERS, "long", "separated"], strict=False)), *(f"({a}) * int(x.kind = '{k}')" for a, k in zip(w[-len(KINDS):], KINDS, strict=True))])
    added = F.expr(f"transform(filter(wider, x -> {z} >= 0), x -> struct(x.kind AS kind, x.start AS start, x.end AS end))")
    return found.withColumn("spans", _ordered(F.concat("base", added))).drop("wider")


def _ordered(spans: Column) -> Column:
    """Sorted by kind as listed, then start, then end; double finds once."""
    order = ", ".join(f"'{k}'" for k in KINDS)
    return F.transform(
        F.array_sort(F.array_distinct(F.transform(spans, lambda x: F.struct(F.array_position(F.expr(f"array({order})"), x["kind"]).alias("o"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))),
        lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")),
    )


def joined(spans: str) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')")
