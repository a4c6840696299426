"""Personal data by weak supervision.

Spans of four base kinds follow fixed patterns and checks and always stay. Further candidates
(written-out addresses, national phone numbers, account and social security numbers, secrets,
titled names) are judged: four labelers vote on every candidate and base span - its own form
(regex), word lists (gazetteer), cue words before it (context) and what it is attached to.
Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler
is, and a naive Bayes classifier is fitted to its posteriors on the votes and the shape of the
spans. Only the table of patterns, whose size the kinds and labelers bound, comes to the
driver; it covers all texts. The verdict is a column expression.

Positions are code points, ends exclusive. Nulls: a null text is empty. Every row is judged by
itself, so repeated rows, null ids and empty tables need no care; a column that has the
result's name is replaced.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpora.llm.expressions import let, starts, total

#: Patterns of the base kinds, in the order in which spans are listed. Possessive loops and the
#: look-behinds find what the plain leftmost patterns find, in linear time.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Patterns of the candidates that the labelers judge.
CANDIDATES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]++\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z]{2,10}+",
    "phone": r"(?<![0-9+().-])\(?[0-9]{3,5}\)?[\x20./-][0-9]{3,4}[\x20./-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+",
    "name": r"(?<![\p{L}])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.?\x20\p{Lu}\p{Ll}+(?:\x20\p{Lu}\p{Ll}+)?",
}
_TITLES = ["Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Señor"]
KINDS = ["email", "ip", "card", "phone", "iban", "name", "secret", "ssn"]
LABELERS = ["form", "gazetteer", "context", "edges"]
_SIZES = [4, 8, 12, 16, 24, 40]

#: Word lists of the gazetteer labeler: a span of the kind that matches is supported.
_KNOWN = {
    "email": r"(?i)(?:\.|dot[\])]?\x20?)(?:com|org|net|edu|gov|info|io|co|uk|de|fr|es|it|eu|at|ch|be|nl)$",
    "ip": r"^(?!0*(?:0|10|127|255)\.|192\.168\.|169\.254\.)",
    "card": r"^[3-6]",
    "phone": r"^(?:\+(?:1|7|2[0-9]|3[0-9]|4[0-9]|5[0-9]|6[0-9]|8[0-9]|9[0-9])|\(?0)",
    "iban": r"^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)",
    "name": r"^(?:Mr|Mrs|Ms|Dr|Prof)\b",
    "secret": r"^(?:sk[-_]|pk[-_]|ghp_|gho_|AKIA|xox|eyJ|[0-9a-f]{32}$|[0-9a-f]{40}$|[0-9a-f]{64}$)",
    "ssn": r"^(?!000|666|9)",
}
#: Cue words before a span that support its kind.
_CUES = {
    "email": r"(?i)mail|contact|write|adresse|correo",
    "ip": r"(?i)\bip\b|host|server|address|adresse",
    "card": r"(?i)card|visa|credit|karte|carte|tarjeta",
    "phone": r"(?i)phone|call|tel|mobile|fax|anruf|appel",
    "iban": r"(?i)iban|account|konto|compte|cuenta",
    "name": r"(?i)name|dear|contact|lieber|cher|querid",
    "secret": r"(?i)token|key|secret|passw|pwd|auth|bearer|credential",
    "ssn": r"(?i)ssn|social|security",
}
#: Cue words before a span that speak against any kind.
_AGAINST = r"(?i)version|isbn|issn|page|figure|table|chapter|order|https?://\S*$"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether the digits of ``value`` (19 at most) pass the Luhn check; leading zeros do not matter."""
    padded = F.lpad(_digits(value), 19, "0")

    def share(digits: Column) -> Column:
        def of_place(p: Column) -> Column:
            d = F.substring(digits, p, F.lit(1)).cast("long")
            return F.when(p % 2 == 0, (2 * d) % 10 + F.floor(2 * d / 10)).otherwise(d)

        return total(F.transform(F.sequence(F.lit(1), F.lit(19)), of_place)) % 10 == 0

    return let(padded, share)


def _valid(kind: str, value: Column) -> Column:
    """The check of a base kind beside its pattern."""
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
        return value.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


_SPAN = "array<struct<kind:string,start:int,end:int,value:string,before:string,after:string>>"


def _found(text: Column, kind: str, pattern: str) -> Column:
    """All matches of ``pattern`` with their places and surroundings, checked for the kind.

    The pieces between matches give the places: a match starts after all pieces and matches
    before it and its own piece.
    """

    def placed(matches: Column) -> Column:
        def with_pieces(pieces: Column) -> Column:
            lengths = F.transform(matches, lambda m, i: (F.length(F.get(pieces, i)) + F.length(m)).cast("long"))

            def spans(before: Column) -> Column:
                def span(m: Column, i: Column) -> Column:
                    start = (F.get(before, i) + F.length(F.get(pieces, i))).cast("int")
                    return F.struct(
                        F.lit(kind).alias("kind"), start.alias("start"),
                        (start + F.length(m)).alias("end"), m.alias("value"),
                        F.right(F.get(pieces, i), F.lit(24)).alias("before"),
                        F.left(F.get(pieces, i + 1), F.lit(1)).alias("after"),
                    )

                return F.transform(matches, span)

            return let(starts(lengths), spans)

        none = F.from_json(F.lit("[]"), _SPAN)
        return F.when(F.size(matches) == 0, none).otherwise(let(F.split(text, pattern, -1), with_pieces))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _found_where(gate: Column, text: Column, patterns: dict[str, str]) -> Column:
    """Matches of several patterns in texts that pass a cheap test, which all matches need."""
    found = F.concat(*[_found(text, kind, pattern) for kind, pattern in patterns.items()])
    return F.when(gate, found).otherwise(F.from_json(F.lit("[]"), _SPAN))


def _any_of(text: Column, parts: list[str]) -> Column:
    test = F.lit(False)
    for part in parts:
        test = test | F.contains(text, F.lit(part))
    return test


def _pick(patterns: dict[str, str], *kinds: str) -> dict[str, str]:
    return {kind: patterns[kind] for kind in kinds}


def base_spans(text: Column) -> Column:
    """Spans of the base kinds, by kind as listed and then by start."""
    found = F.concat(
        _found_where(F.contains(text, F.lit("@")), text, _pick(BASE, "email")),
        _found_where(text.rlike("[0-9]"), text, _pick(BASE, "ip", "card", "phone")),
    )

    def valid(s: Column) -> Column:
        choice = F
        for kind in ("ip", "card", "phone"):
            choice = choice.when(s["kind"] == kind, _valid(kind, s["value"]))
        return choice.otherwise(F.lit(True))

    return F.filter(found, valid)


def candidate_spans(text: Column, base: Column) -> Column:
    """Further candidates that do not overlap a base span."""
    digits = text.rlike("[0-9]{2}")
    every = F.concat(
        _found_where(_any_of(text, ["dot)", "dot]", " dot "]), text, _pick(CANDIDATES, "email")),
        _found_where(digits, text, _pick(CANDIDATES, "phone", "ssn", "iban")),
        _found_where(text.rlike("[A-Za-z0-9_+/-]{20}"), text, _pick(CANDIDATES, "secret")),
        _found_where(_any_of(text, _TITLES), text, _pick(CANDIDATES, "name")),
    )
    return F.filter(
        every,
        lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])),
    )


def _of(kind: str):
    return lambda span: span["kind"] == kind


def _by_kind(span: Column, patterns: dict[str, str], value: Column) -> Column:
    choice = F
    for kind, pattern in patterns.items():
        choice = choice.when(span["kind"] == kind, value.rlike(pattern))
    return choice.otherwise(F.lit(False))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def votes(span: Column) -> list[Column]:
    """Each labeler's vote on a span: 1 for, -1 against, 0 none."""
    value, kind = span["value"], span["kind"]
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    odd_secret = (kind == "secret") & (~mixed | value.rlike(r"^[a-z]+[-_/]|[-_/]{2}|(?:[a-z]{6,}[-_/]){2}"))
    digits = F.length(_digits(value))
    odd_digits = (kind.isin("phone", "ssn") & ~digits.between(8, 15)) | ((kind == "iban") & ~mixed)
    known, cue = _by_kind(span, _KNOWN, value), _by_kind(span, _CUES, span["before"])
    attached = span["before"].rlike(r"[\p{L}\p{N}/=&?#]$") | span["after"].rlike(r"^[\p{L}\p{N}/=&]")
    return [
        _vote(F.lit(True), odd_secret | odd_digits),
        _vote(known, ~known & kind.isin("ip", "card", "ssn", "iban")),
        _vote(cue, span["before"].rlike(_AGAINST)),
        _vote(F.lit(True), attached),
    ]


def features(span: Column) -> Column:
    """Kind, votes, and the shape of a span: its size and its share of digits, in steps."""
    size = F.lit(0)
    for limit in _SIZES:
        size = size + (F.length(span["value"]) >= limit).cast("int")
    share = F.floor(4 * F.length(_digits(span["value"])) / F.length(span["value"])).cast("int")
    named = [v.alias(name) for v, name in zip(votes(span), LABELERS)]
    return F.struct(span["kind"].alias("kind"), *named, size.alias("size"), share.alias("digits"))


FEATURES = ["kind", *LABELERS, "size", "digits"]


def pattern_counts(docs: DataFrame, text: str = "text") -> list[tuple[bool, tuple, int]]:
    """Whether spans are of the base kinds, their features, and how many all texts have of them."""
    whole = F.coalesce(F.col(text), F.lit(""))

    def known(spans: Column, sure: bool) -> Column:
        return F.transform(spans, lambda s: F.struct(F.lit(sure).alias("sure"), s.alias("s")))

    def both(base: Column) -> Column:
        return F.concat(known(base, True), known(candidate_spans(whole, base), False))

    rows = docs.select(F.explode(let(base_spans(whole), both)).alias("c"))
    rows = rows.select(F.col("c.sure").alias("sure"), features(F.col("c.s")).alias("f"))
    counts = rows.groupBy("sure", "f").count().collect()
    return sorted((r["sure"], tuple(r["f"][name] for name in FEATURES), r["count"]) for r in counts)


def _weight(table: dict, vote: int) -> float:
    """What a vote adds to the log odds: a labeler is never worse than chance, and none is no evidence."""
    return vote * max(0.0, vote * math.log(table[True][vote] / table[False][vote]))


def posteriors(counts: list[tuple[bool, tuple, int]], rounds: int = 40) -> dict[tuple, float]:
    """Probability that candidates of each pattern are personal data, by expectation-maximisation.

    A span is real or not, with a prior for its kind; each labeler votes by its own
    probabilities given which. Spans of the base kinds are known to be real, which fixes the
    meaning of the two classes. The first guess stays in each table with the weight of two spans.
    """
    start = {True: {1: 0.6, 0: 0.3, -1: 0.1}, False: {1: 0.2, 0: 0.4, -1: 0.4}}
    chance = [{z: dict(start[z]) for z in (True, False)} for _ in LABELERS]
    prior = defaultdict(lambda: 0.5)
    real: dict[tuple, float] = {}
    for _ in range(rounds):
        for sure, pattern, _n in counts:
            odds = math.log(prior[pattern[0]] / (1 - prior[pattern[0]]))
            for table, vote in zip(chance, pattern[1:]):
                odds += _weight(table, vote)
            real[sure, pattern] = 1.0 if sure else 1 / (1 + math.exp(-max(-60.0, min(60.0, odds))))
        sums = [{z: {v: 2 * p for v, p in start[z].items()} for z in start} for _ in LABELERS]
        of_kind = defaultdict(lambda: [1.0, 1.0])
        for sure, pattern, n in counts:
            p = real[sure, pattern]
            if not sure:
                of_kind[pattern[0]][0] += n * p
                of_kind[pattern[0]][1] += n * (1 - p)
            for table, vote in zip(sums, pattern[1:]):
                table[True][vote] += n * p
                table[False][vote] += n * (1 - p)
        prior.update({k: a / (a + b) for k, (a, b) in of_kind.items()})
        chance = [{z: {v: s / sum(t[z].values()) for v, s in t[z].items()} for z in t} for t in sums]
    return real


def classifier(counts: list[tuple[bool, tuple, int]]) -> dict:
    """Weights of the span classifier: log odds of each feature value under the posteriors.

    Each class is smoothed by one span with the values that all spans have, so a class with
    little evidence says little.
    """
    real = posteriors(counts)
    soft = [(pattern, n * real[sure, pattern], n * (1 - real[sure, pattern])) for sure, pattern, n in counts]
    yes, no = (1 + sum(x[place] for x in soft) for place in (1, 2))
    weights: dict = {"bias": math.log(yes / no)}
    for place, name in enumerate(FEATURES):
        sums = defaultdict(lambda: [0.0, 0.0])
        for pattern, p, q in soft:
            sums[pattern[place]][0] += p
            sums[pattern[place]][1] += q
        share = {v: (p + q) / (yes + no - 2) for v, (p, q) in sums.items()}
        weights[name] = {v: math.log((p + share[v]) / yes / ((q + share[v]) / no)) for v, (p, q) in sums.items()}
    return weights


def accepted(span: Column, weights: dict) -> Column:
    """Whether the classifier takes a candidate for personal data."""

    def score(f: Column) -> Column:
        odds = F.lit(float(weights["bias"]))
        for name in FEATURES:
            choice = F.lit(0.0)
            for value, weight in weights[name].items():
                choice = F.when(f[name] == F.lit(value), F.lit(float(weight))).otherwise(choice)
            odds = odds + choice
        return odds > 0

    return let(features(span), score)


def personal_data(docs: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """``docs`` with a struct ``into``: ``base`` (spans of the base kinds) and ``spans`` (all).

    Spans are structs of kind, start and end, by kind as in ``KINDS`` and then by start.
    """
    weights = classifier(pattern_counts(docs, text))
    whole = F.coalesce(F.col(text), F.lit(""))

    def narrow(spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    def both(base: Column) -> Column:
        further = F.filter(candidate_spans(whole, base), lambda s: accepted(s, weights))

        def ordered(every: Column) -> Column:
            return F.concat(*[F.array_sort(F.filter(every, _of(kind))) for kind in KINDS])

        every = let(narrow(F.concat(base, further)), ordered)
        return F.struct(narrow(base).alias("base"), every.alias("spans"))

    return docs.withColumn(into, let(base_spans(whole), both))


def masked(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in brackets; what spans share is replaced once."""

    def rewrite(ordered: Column) -> Column:
        def reach(i: Column) -> Column:  # where the earlier spans end
            return F.coalesce(F.array_max(F.transform(F.slice(ordered, F.lit(1), i), lambda s: s["end"])), F.lit(0))

        parts = F.transform(
            ordered,
            lambda s, i: F.concat(
                F.substring(text, reach(i) + 1, F.greatest(s["start"] - reach(i), F.lit(0))),
                F.when(s["end"] > reach(i), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(""),
            ),
        )
        rest = F.substring(text, reach(F.size(ordered)) + 1, F.length(text))
        return F.concat(F.array_join(parts, ""), rest)

    by_start = F.array_sort(
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    )
    return F.when(F.size(spans) == 0, text).otherwise(let(by_start, rewrite))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def digests(found: DataFrame, id: str = "doc_id", into: str = "pii") -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as one string."""
    base = F.col(into)["base"]
    counts = [
        F.size(F.filter(base, _of(kind))).cast("long").alias(f"n_{kind}") for kind in BASE
    ]
    return found.select(
        id, *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col(into)["spans"]).alias("spans")
    )
