"""Quality rules as a short-circuit cascade: the rule that rejects most per unit of cost runs first.

A rule is a named predicate over the measures of a text, true where the text is rejected. `plan_cascade` times each rule
and counts its rejections on a bounded sample, and `cascade` writes the rules as one CASE in the order of rejections per
cost, so that a rejected text skips the rules behind the one that caught it. The order changes the cost only: a text is
kept if no rule rejects it, and the rule that is named for a rejected text is the first in the order of the list.

Defined results: a null text is the empty text, has no words and is rejected; a very long text is measured whole; columns
besides `text` are never read, so they may be null, repeated or have any names (those of the results are replaced); an
empty table gives an empty table; equal rows give equal results. Built-in expressions only; nothing is shuffled.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = r"[#*$%&|<>]"


def split_words(text: Column) -> Column:
    trimmed = F.btrim(common.text_of(text), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def _covered(starts: Column) -> Column:
    """Positions covered by windows with these sorted starts."""
    step = lambda a, p: F.struct((p + WINDOW).alias("end"), (a["total"] + p + WINDOW - F.greatest(a["end"], p)).alias("total"))
    return F.aggregate(starts, F.struct(F.lit(0).alias("end"), F.lit(0).alias("total")), step)["total"]


def _repeats_exactly(words: Column) -> Column:
    """Words in windows found twice or more, by sorting the windows as strings."""
    window = lambda i: F.struct(F.concat_ws(" ", F.slice(words, i + 1, WINDOW)).alias("s"), i.alias("p"))
    pairs = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), window))

    def starts(p: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(p, j)["s"] == x["s"], F.lit(False))
        return F.sort_array(F.transform(F.filter(p, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["p"]))

    return _covered(common.bind(pairs, starts))


def repeat_words(words: Column) -> Column:
    """Words in 8-word windows found twice or more in the text, the first included; words must be bound.

    Hashes of 4-word, then of 8-word windows tell the texts without a repeat, which is most of them; the others are
    counted on strings.
    """

    def joined(h: Column, by: int) -> Column:
        n = F.size(h) - by
        return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(1 + by), n), lambda x, y: F.xxhash64(x, y))

    repeats = lambda k: F.size(F.array_distinct(k)) < F.size(k)
    eights = lambda fours: F.when(repeats(fours), common.bind(joined(fours, 4), repeats)).otherwise(False)
    repeated = common.bind(joined(words, 1), lambda twos: common.bind(joined(twos, 2), eights))
    return F.when(F.size(words) <= WINDOW, 0).when(repeated, _repeats_exactly(words)).otherwise(0).cast("long")


def full_lines(text: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(common.text_of(text), "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")


def duplicate_lines(lines: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return common.bind(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def symbols(text: Column) -> Column:
    return F.regexp_count(common.text_of(text), F.lit(SYMBOLS)).cast("long")


def _word_chars(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("long"), lambda a, x: a + F.length(x))


#: The measures that the rules use, from a text and its bound array of words.
MEASURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda t, w: F.size(w).cast("long"),
    "word_chars": lambda t, w: _word_chars(w),
    "n_symbols": lambda t, w: symbols(t),
    "n_dup_lines": lambda t, w: duplicate_lines(full_lines(t)),
    "n_repeat_words": lambda t, w: repeat_words(w),
    "n_lines": lambda t, w: F.size(full_lines(t)).cast("long"),
    "n_bangs": lambda t, w: F.regexp_count(common.text_of(t), F.lit("!")),
    "n_digits": lambda t, w: F.length(F.regexp_replace(common.text_of(t), "[^0-9]+", "")),
}
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Measures:
    """Measures as attributes: columns that are known already, or expressions over the text and its words."""

    def __init__(self, text: Column, words: Column, known: dict[str, Column] | None = None):
        self._text, self._words, self._known = text, words, known or {}

    def __getattr__(self, name: str) -> Column:
        return self._known[name] if name in self._known else MEASURES[name](self._text, self._words)


@dataclass(frozen=True)
class Rule:
    """rejects: from measures to a boolean column, true where the text goes."""

    name: str
    rejects: Callable[[Measures], Column]


#: The rules of base_failed.
BASE = [
    Rule("few_words", lambda m: m.n_words < MIN_WORDS),
    Rule("repeats", lambda m: 100 * m.n_repeat_words > MAX_REPEAT_PERCENT * m.n_words),
]


def production_rules() -> list[Rule]:
    """The base rules, and five that take tables, symbol noise, shouting, odd words and numbers for junk."""
    return [
        *BASE,
        Rule("symbols", lambda m: 100 * m.n_symbols > 20 * m.n_words),
        # most lines say nothing new
        Rule("duplicate_lines", lambda m: 2 * m.n_dup_lines > m.n_lines),
        Rule("shouting", lambda m: 2 * m.n_bangs > m.n_words),
        Rule("long_words", lambda m: m.word_chars > 16 * m.n_words),
        Rule("digits", lambda m: 5 * m.n_digits > 2 * m.word_chars),
    ]


@dataclass(frozen=True)
class Measured:
    rule: Rule
    cost: float
    rejected: float


def plan_cascade(docs: DataFrame, rules: list[Rule], text: str = "text", sample_rows: int = 400, repeats: int = 3, seed: int = 7) -> list[Measured]:
    """The rules in order of rejections per cost, measured on at most sample_rows texts.

    sample_rows bounds the sample; it decides the order of the rules, never a verdict. A rule's cost is the least of
    `repeats` runs behind one that compiles it, less that of a rule that does nothing, in whole powers of two so that
    small differences don't change the order. Rules that reject nothing in the sample come last, the cheapest first;
    ties stay in the order of the list.
    """
    n = docs.count()
    if not n:
        return [Measured(r, 0.0, 0.0) for r in rules]
    texts = docs.select(F.col(text).alias("text"))
    sample = common.stored(texts.sample(min(1.0, 4 * sample_rows / n), seed).orderBy(F.rand(seed)).limit(sample_rows), "rule-sample")

    def timed(rejects: Callable[[Measures], Column]) -> tuple[float, float]:
        rejected = common.bind(split_words(F.col("text")), lambda w: rejects(Measures(F.col("text"), w)))
        run = sample.agg(F.avg(F.when(rejected, 1.0).otherwise(0.0)).alias("share"))
        share, seconds = run.first()["share"], []
        for _ in range(repeats):
            began = time.perf_counter()
            run.collect()
            seconds.append(time.perf_counter() - began)
        return min(seconds), share or 0.0

    idle = timed(lambda m: m.n_words < 0)[0]
    measured = []
    for rule in rules:
        seconds, share = timed(rule.rejects)
        measured.append(Measured(rule, 2.0 ** math.ceil(math.log2(max(seconds - idle, 1 / 256))), share))
    return sorted(measured, key=lambda m: (-m.rejected / m.cost, m.cost))


def cascade(rules: list[Rule], measures: Measures) -> Column:
    """The name of the first rule that rejects, null if none does."""
    first = F.lit(None).cast("string")
    for rule in reversed(rules):
        first = F.when(rule.rejects(measures), F.lit(rule.name)).otherwise(first)
    return first


def judge(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text") -> DataFrame:
    """docs with the reported measures, base_failed, rejected_by (null: kept) and kept.

    The measures are wanted for every row, so they are computed once and the rules read them; one cascade of all rules
    gives the verdict, and a rejected text skips the rules behind the one that caught it.
    """
    rules = rules or production_rules()
    order = [m.rule for m in plan_cascade(docs, rules, text)]
    t = F.col(text)

    def judged(words: Column) -> Column:
        def verdict(c: Column) -> Column:
            known = Measures(t, words, {k: c[k] for k in REPORTED})
            caught = cascade(order, known).isNotNull()
            names = F.when(caught, cascade(rules, known))
            base = F.coalesce(cascade(BASE, known).isNotNull(), F.lit(False))
            return F.struct(c.alias("counts"), caught.alias("caught"), names.alias("rule"), base.alias("base"))

        return common.bind(F.struct(*[MEASURES[k](t, words).alias(k) for k in REPORTED]), verdict)

    (own,) = common.fresh(docs, "__counts")
    found = docs.withColumn(own, common.bind(split_words(t), judged))
    c = lambda k: F.col(f"{own}.{k}")
    clash = {*REPORTED, "base_failed", "rejected_by", "kept"}
    return found.select(*[F.col(f"`{x}`") for x in docs.columns if x.lower() not in clash], *[c(f"counts.{n}").alias(n) for n in REPORTED], c("base").alias("base_failed"), c("rule").alias("rejected_by"), (~(c("base") | c("caught"))).alias("kept"))


def keep_good(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text") -> DataFrame:
    """The rows that no rule rejects, with the columns of docs. Rules behind the rejecting one aren't computed."""
    order = [m.rule for m in plan_cascade(docs, rules or production_rules(), text)]
    return docs.filter(common.bind(split_words(F.col(text)), lambda w: F.coalesce(cascade(order, Measures(F.col(text), w)), F.lit(""))) == "")
