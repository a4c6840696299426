"""Quality rules as a short-circuit cascade.

Each rule is a condition that rejects a text. Its cost (time over a sample) and selectivity
(share of the sample it rejects) are measured on a bounded sample, and the rules are ordered by
rejection per cost. The cascade is one CASE expression, so a text that one rule rejects is not
looked at by the later ones. Counts that most rules need, and those that a report shows, are
made once before it; the others are made in the rule that asks for them. The order changes only
the work and which rule is named for a text that several reject; whether a text is kept does not
depend on it.

Nulls: a null text has no words. Every row is judged by itself, so repeated rows, null ids,
empty tables and other columns need no care; a column that has the result's name is replaced.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpora.llm.expressions import let, total

#: Characters between words, and characters that count as symbols.
_BLANKS = r"[\x20\x09-\x0D]+"
_NOT_SYMBOLS = r"[^#*$%&|<>]+"

Metric = Callable[[str], Column]
Rule = Callable[[Metric], Column]


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, _BLANKS), "")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def repeated_words(text: Column) -> Column:
    """How many words lie in windows of three words that the text has twice or more.

    Windows are sorted with their places; those that equal a neighbour are repeated, and each
    covers up to three words, fewer if the next repeated window begins before.
    """

    def covered(places: Column) -> Column:
        return total(
            F.transform(
                places,
                lambda x, j: F.coalesce(F.least(F.get(places, j + 1) - x, F.lit(3)), F.lit(3)).cast("long"),
            )
        )

    def repeated(ordered: Column) -> Column:
        again = F.transform(
            ordered,
            lambda x, j: F.when(
                (x["g"] == F.get(ordered, j - 1)["g"]) | (x["g"] == F.get(ordered, j + 1)["g"]), x["i"]
            ),
        )
        return let(F.sort_array(F.filter(again, lambda x: x.isNotNull())), covered)

    def windows(own: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(own) - 3),
            lambda i: F.concat_ws(" ", F.get(own, i), F.get(own, i + 1), F.get(own, i + 2)),
        )

    def count(grams: Column) -> Column:
        placed = F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i")))
        none = F.size(F.array_distinct(grams)) == F.size(grams)
        return F.when(none, F.lit(0).cast("long")).otherwise(let(F.sort_array(placed), repeated))

    few = F.lit(0).cast("long")
    return let(words(text), lambda own: F.when(F.size(own) < 4, few).otherwise(let(windows(own), count)))


#: Metrics of a text (a column without nulls), all longs.
METRICS: dict[str, Callable[[Column], Column]] = {
    "n_words": lambda t: F.size(words(t)).cast("long"),
    "word_chars": lambda t: F.length(F.regexp_replace(t, _BLANKS, "")).cast("long"),
    "n_symbols": lambda t: F.length(F.regexp_replace(t, _NOT_SYMBOLS, "")).cast("long"),
    "n_lines": lambda t: F.size(_lines(t)).cast("long"),
    "n_dup_lines": lambda t: let(_lines(t), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    "n_repeat_words": repeated_words,
    "n_capitals": lambda t: F.length(F.regexp_replace(t, r"\P{Lu}+", "")).cast("long"),
}

#: The base rules, then the further ones.
BASE: dict[str, Rule] = {
    "few_words": lambda m: m("n_words") < 50,
    "repeated_words": lambda m: 100 * m("n_repeat_words") > 50 * m("n_words"),
}
RULES: dict[str, Rule] = BASE | {
    "symbols": lambda m: 10 * m("n_symbols") > m("n_words"),
    "repeated_lines": lambda m: (m("n_dup_lines") > 0) & (2 * m("n_dup_lines") > m("n_lines")),
    "capitals": lambda m: 10 * m("n_capitals") > 3 * m("word_chars"),
    "short_words": lambda m: m("word_chars") < 3 * m("n_words"),
    "long_words": lambda m: m("word_chars") > 12 * m("n_words"),
}


#: Metrics that most rules read, and those of a report.
SHARED = ("n_words", "word_chars")
SHOWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def of_text(text: str) -> Metric:
    """Metrics computed from the column named ``text``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return lambda name: METRICS[name](whole)


def _measured(docs: DataFrame, text: str, names: tuple[str, ...]) -> tuple[DataFrame, Metric]:
    """``docs`` with the named metrics in a column of their own, and metrics that read them there.

    The one-element generator makes them once per row, also under a filter on the cascade's result.
    """
    into, from_text = "_metrics", of_text(text)
    while into in docs.columns:
        into += "_"
    made = F.struct(F.struct(*[from_text(n).alias(n) for n in names]).alias(into))
    measured = docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.inline(F.array(made)))
    return measured, lambda name: F.col(into)[name] if name in names else from_text(name)


def cascade_order(
    docs: DataFrame,
    rules: dict[str, Rule] = RULES,
    text: str = "text",
    sample_rows: int = 1_000,
    known: tuple[str, ...] = SHARED,
) -> list[str]:
    """Names of the rules by rejections per second on a sample.

    The sample is at most ``sample_rows`` texts of at most 20,000 characters. The cost of a rule
    is the time that it adds to a job which makes the ``known`` metrics only.
    """
    whole = F.coalesce(F.col(text), F.lit("")).alias(text)
    taken = docs.select(whole).where(F.length(text) <= 20_000).head(sample_rows)
    sample = docs.sparkSession.createDataFrame(taken, f"`{text}` string")
    measured, metric = _measured(sample, text, known)
    made = [F.sum(metric(name)) for name in known]

    def timed(condition: Column) -> tuple[int, float]:
        """Rows that meet the condition, and the seconds of the faster of two runs."""
        job = measured.select(F.count_if(condition).alias("n"), *made)
        seconds = []
        for _ in range(2):  # the first run also compiles
            start = time.perf_counter()
            n = job.collect()[0]["n"]
            seconds.append(time.perf_counter() - start)
        return n, min(seconds)

    before, worth = timed(F.lit(True))[1], {}
    for name, rule in rules.items():
        n, seconds = timed(rule(metric))
        worth[name] = n / max(len(taken), 1) / max(seconds - before, 1e-3)
    return sorted(rules, key=lambda name: -worth[name])


def rejected_by(order: list[str], metric: Metric, rules: dict[str, Rule] = RULES) -> Column:
    """Name of the first rule in ``order`` that rejects the text; null if none does."""
    cascade = F
    for name in order:
        cascade = cascade.when(rules[name](metric), F.lit(name))
    return cascade if order else F.lit(None).cast("string")


def judged(
    docs: DataFrame, rules: dict[str, Rule] = RULES, text: str = "text", into: str = "rejected_by"
) -> DataFrame:
    """``docs`` with the rule that rejects each row in the column ``into``, null for kept rows."""
    order = cascade_order(docs, rules, text)
    names = [c for c in docs.columns if c != into]
    made, metric = _measured(docs, text, SHARED)
    return made.select(*[F.col(f"`{c}`") for c in names], rejected_by(order, metric, rules).alias(into))


def quality_report(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The ``SHOWN`` metrics and the verdict of every row.

    The further metrics are made only for texts that no base rule fails, and only when the
    cascade comes to a rule that reads them.
    """
    order = cascade_order(docs, RULES, text, known=SHOWN)
    given = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    made, metric = _measured(given, "text", SHOWN)
    failed = F.lit(False)
    for rule in BASE.values():
        failed = failed | rule(metric)
    further = [name for name in order if name not in BASE]
    return made.select(
        F.col("id").alias(id), *[metric(name).alias(name) for name in SHOWN], failed.alias("base_failed"),
        F.when(failed, False).otherwise(rejected_by(further, metric).isNull()).alias("kept"),
    )
