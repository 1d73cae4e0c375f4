"""Quality rules as a short-circuit cascade; DataFrame functions only.

A document is kept if no rule rejects it, so the order of the rules changes the cost but never the
verdict. The order comes from a sample: rules with the most rejections per second go first, and a
``CASE`` evaluates a later rule only for documents that all earlier ones let pass.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sugarline.llm.common import native_words, stored

#: Low bits of a sort key that hold a window's place; the rest are bits of its hash.
PLACE_BITS = 26


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also inside functions of array elements."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeats(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more."""
    low = (1 << PLACE_BITS) - 1

    def count(hashes: Column) -> Column:
        key = lambda h, i: h.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))
        same = lambda a, b: F.get(hashes, a.bitwiseAND(F.lit(low)).cast("int")) == F.get(
            hashes, b.bitwiseAND(F.lit(low)).cast("int")
        )

        def covered(keys: Column) -> Column:
            twice = F.filter(
                keys,
                lambda x, j: F.coalesce(same(F.get(keys, j - 1), x), F.lit(False))
                | F.coalesce(same(x, F.get(keys, j + 1)), F.lit(False)),
            )
            places = F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(F.lit(low))))
            own = lambda p: F.transform(p, lambda x, j: F.least(F.coalesce(F.get(p, j + 1) - x, F.lit(3)), F.lit(3)))
            return let(places, lambda p: F.aggregate(own(p), F.lit(0).cast("long"), lambda a, x: a + x))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
            let(F.sort_array(F.transform(hashes, key)), covered)
        )

    windows = lambda w: F.transform(
        F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    )
    return let(
        words,
        lambda w: F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(let(windows(w), count)),
    )


def _count(text: Column, pattern: str) -> Column:
    return (F.size(F.split(text, pattern)) - 1).cast("long")


def figures(text: Column, words: Column | None = None) -> dict[str, Column]:
    """Figures of a text, each an expression of its own. A null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = native_words(text) if words is None else words
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^ \\t\\n\\x0B\\f\\r]"))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": _count(text, "[#*$%&|<>]"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": _repeats(words),
        "n_lines": F.size(lines).cast("long"),
        "n_capitals": _count(text, "[A-Z]"),
    }


@dataclass(frozen=True)
class Rule:
    """Rejects a document where ``rejects``, a condition over figures by name, holds."""

    name: str
    rejects: Callable[[Mapping[str, Column]], Column]


BASE_RULES = (
    Rule("few_words", lambda f: f["n_words"] < 50),
    Rule("repeated_words", lambda f: 100 * f["n_repeat_words"] > 50 * f["n_words"]),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", lambda f: 10 * f["n_symbols"] > 3 * f["n_words"]),
    Rule("long_words", lambda f: f["word_chars"] > 15 * f["n_words"]),
    Rule("repeated_lines", lambda f: 10 * f["n_dup_lines"] > 3 * f["n_lines"]),
    Rule("capitals", lambda f: 2 * f["n_capitals"] > f["word_chars"]),
)


def ordered(rules: Sequence[Rule], docs: DataFrame, rows: int = 1000, share: float = 0.1) -> list[Rule]:
    """Rules by rejections per second, measured on at most ``rows`` rows of a sample of ``docs``.

    The sample decides the order of evaluation only.
    """
    sample = stored(docs.select("text").sample(share, seed=11).limit(rows), "rule-sample").repartition(1)
    own = figures(F.col("text"))
    true = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    rejected = sample.agg(*[true(r.rejects(own)).alias(r.name) for r in rules]).first()

    def seconds(frame: DataFrame) -> float:
        start = time.perf_counter()
        frame.first()
        return time.perf_counter() - start

    scan = seconds(sample.agg(F.sum(F.length("text"))))
    cost = {r.name: max(1e-3, seconds(sample.agg(true(r.rejects(own)))) - scan) for r in rules}
    return sorted(rules, key=lambda r: (-((rejected[r.name] or 0) + 1) / cost[r.name], r.name))


def cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, given: Sequence[str] = ()) -> Column:
    """The name of the first rule that rejects a row of ``docs``, null if none does.

    ``given`` names figures that ``docs`` already has as columns. The others are computed from
    ``text`` when a rule that needs them is reached. A null text counts as empty. Without rules, or
    if a condition is null, nothing is rejected.
    """
    values = figures(F.col("text")) | {name: F.col(name) for name in given}
    verdict = F.lit(None).cast("string")
    for rule in reversed(ordered(rules, docs) if rules else []):
        verdict = F.when(rule.rejects(values), F.lit(rule.name)).otherwise(verdict)
    return verdict


def judged(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id, all figures, ``base_failed``, ``kept`` and ``failed_rule`` for each row of ``docs``.

    Repeated rows are judged one by one; extra columns are ignored; no rows give no result.
    """
    docs = docs.select("doc_id", "text")
    names = list(figures(F.col("text")))
    split = docs.withColumn("words", native_words(F.col("text")))
    made = figures(F.col("text"), F.col("words"))
    found = split.withColumns(made)
    values = {name: F.col(name) for name in names}
    base = BASE_RULES[0].rejects(values) | BASE_RULES[1].rejects(values)
    return (
        found.withColumn("failed_rule", cascade(docs, rules, given=names))
        .withColumns({"base_failed": base, "kept": F.col("failed_rule").isNull() & ~base})
        .drop("text", "words")
    )
