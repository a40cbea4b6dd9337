"""Quality rules as a short-circuit cascade.

Each rule is a Boolean column over a document's words and text.  Their cost and
their selectivity are estimated on a sample, each rule over every sampled row
``REPEATS`` times and beside a run without a rule, so that what a job costs by
itself does not count; the rules are ordered by rejections per second, and one CASE expression evaluates them in that order: a document
that an early rule rejects never reaches the later ones.  The order changes the
time that the cascade takes, never its verdict, since a document is kept only
when no rule rejects it.

Edge cases: a null or empty text has no word and is rejected; extra columns pass
through (the operator's own columns replace any of the same name); an empty
table gives an empty result and the rules' given order.
"""

from __future__ import annotations

import time
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, spill, words

SYMBOLS = "[^#*$%&|<>]+"
REPEATS = 20
_W = "words"
_T = "whole"


class Rule(NamedTuple):
    """``fails`` maps (words, text) columns to a Boolean column: true rejects."""

    name: str
    fails: object


def word_chars(w: Column) -> Column:
    return F.length(F.array_join(w, "")).cast("long")


def symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))


def duplicate_lines(text: Column) -> Column:
    return let(_lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def window_hashes(hashed: Column, n: int) -> Column:
    """Hashes of all runs of ``n`` items of an array of hashes."""
    return let(
        hashed,
        lambda h: F.transform(
            F.slice(h, 1, F.greatest(F.size(h) - (n - 1), F.lit(0))),
            lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, n)]),
        ),
    )


def repeated_words(w: Column, n: int = 5) -> Column:
    """Words inside windows of ``n`` words that occur twice or more in the text."""

    def covered(g: Column) -> Column:
        ranked = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        twice = let(
            ranked,
            lambda s: F.sort_array(
                F.transform(
                    F.filter(
                        s,
                        lambda y, k: F.coalesce(F.get(s, k - 1)["x"] == y["x"], F.lit(False))
                        | F.coalesce(F.get(s, k + 1)["x"] == y["x"], F.lit(False)),
                    ),
                    lambda y: y["i"],
                )
            ),
        )
        return let(
            twice,
            lambda at: F.aggregate(
                F.transform(at, lambda p, k: F.least(F.lit(n), F.coalesce(F.get(at, k + 1) - p, F.lit(n)))),
                F.lit(0).cast("long"),
                lambda a, x: a + x,
            ),
        )

    g = window_hashes(F.transform(w, lambda x: F.xxhash64(x)), n)
    return let(g, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(covered(g)))


#: Rejected outright by the contract of the base measures.
BASE_RULES = (
    Rule("few_words", lambda w, t: F.size(w) < 10),
    Rule("repeated_windows", lambda w, t: 100 * repeated_words(w) > 20 * F.size(w)),
)
#: The method's own rules.
RULES = BASE_RULES + (
    Rule("symbols", lambda w, t: 10 * symbols(t) > F.size(w)),
    Rule("word_length", lambda w, t: let(word_chars(w), lambda c: (c < 2 * F.size(w)) | (c > 15 * F.size(w)))),
    Rule("duplicate_lines", lambda w, t: 2 * duplicate_lines(t) > F.size(_lines(t))),
    Rule("no_letters", lambda w, t: 2 * F.size(F.filter(w, lambda x: x.rlike("\\p{L}"))) < F.size(w)),
    Rule("upper_case", lambda w, t: 10 * F.length(F.regexp_replace(t, "[^\\p{Lu}]+", "")) > 6 * word_chars(w)),
)


def _prepared(text: Column) -> tuple[Column, Column]:
    return words(text, SPACE).alias(_W), F.coalesce(text, F.lit("")).alias(_T)


def order_rules(docs: DataFrame, rules=RULES, sample_rows: int = 1000, seed: int = 8) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected) on a sample, most rejections per second first."""
    total = docs.count()
    if not total:
        return [(r, 0.0, 0.0) for r in rules]
    part = docs.select("text").sample(fraction=min(1.0, 1.5 * sample_rows / total), seed=seed).limit(sample_rows)
    part = spill(part, "quality-sample").select(*_prepared(F.col("text")))
    again = spill(part, "quality-words").withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

    def run(fails: Column) -> tuple[float, float]:
        ask = again.agg(F.count_if(fails).alias("bad"), F.count("*").alias("n"), F.sum(F.size(_W) + F.length(_T) + F.col("again")))
        ask.first()  # compiles
        began = time.perf_counter()
        row = ask.first()
        return time.perf_counter() - began, row["bad"] / max(1, row["n"])

    idle, _ = run(F.lit(False))
    found = []
    for rule in rules:
        took, share = run(rule.fails(F.col(_W), F.col(_T)))
        found.append((rule, max(took - idle, 1e-3), share))
    return sorted(found, key=lambda x: -x[2] / x[1])


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def cascade(docs: DataFrame, rules=RULES, sample_rows: int = 1000, measures: bool = False) -> DataFrame:
    """``docs`` with failed_rule (the first in the chosen order that rejects, or null) and kept.

    With ``measures``, also n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words and base_failed, over every document.
    """
    ranked = [r for r, _, _ in order_rules(docs, rules, sample_rows)]
    own = {"failed_rule", "kept"} | (set(MEASURES) if measures else set())
    names = [c for c in docs.columns if c not in own]
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), *_prepared(F.col("text")))
    w, t = F.col(_W), F.col(_T)
    known: dict[str, Column] = {}
    if measures:
        out = out.withColumns(
            {
                "n_words": F.size(w).cast("long"),
                "word_chars": word_chars(w),
                "n_symbols": symbols(t),
                "n_dup_lines": duplicate_lines(t),
                "n_repeat_words": repeated_words(w),
            }
        )
        known = {
            "few_words": F.col("n_words") < 10,
            "repeated_windows": 100 * F.col("n_repeat_words") > 20 * F.col("n_words"),
            "symbols": 10 * F.col("n_symbols") > F.col("n_words"),
        }
        out = out.withColumn("base_failed", known["few_words"] | known["repeated_windows"])
    verdict = None
    for r in ranked:
        fails = known.get(r.name)
        if fails is None:
            fails = r.fails(w, t)
        verdict = F.when(fails, r.name) if verdict is None else verdict.when(fails, r.name)
    out = out.withColumn("failed_rule", verdict).withColumn("kept", F.col("failed_rule").isNull())
    return out.select("row.*", *(MEASURES if measures else ()), "failed_rule", "kept")


def filter_quality(docs: DataFrame, **how) -> DataFrame:
    """The documents that no rule rejects, with the columns of ``docs``."""
    packed = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return cascade(packed, **how).where("kept").select("row.*")
