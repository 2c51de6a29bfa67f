"""Quality rules: base statistics and a learned decision list, Spark expressions only.

Words are runs of anything but space, tab and the line breaks \\n \\v \\f \\r. Statistics of the whole text: n_words,
word_chars, n_symbols (`#*$%&|<>`), n_dup_lines (lines with a word that equal an earlier line), n_repeat_words (words
in windows of three words that occur twice or more). A text fails the base rules with fewer than 50 words or if more
than half of its words are in repeated windows.

The decision list is learned by sequential covering from the labels of a bounded sample: rules are conjunctions of
thresholds (at quantiles of the sample), grown by FOIL gain on two thirds of the rows and pruned on the rest, for the
class of bad texts; texts covered by a rule leave the sample, and the next rule is grown. Only the sample's numbers
(features and label, no text) reach the driver. The list becomes one ordered CASE expression.

Null or empty text: all zero, base_failed. Very long texts go whole. Repeated rows, and rows of one doc_id or without one: a row
each. A value equal to a threshold is not above it; of rules of equal gain the first in order of feature, side and threshold
is grown. Of labels of one doc_id that differ, the better one counts. Extra columns pass through in `row`, whatever their names. An
empty table gives no rows. With no labelled row of either class the list is empty and keeps what passes the base rules.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm import common as C

#: The most labelled rows that a list is fitted on, those with the smallest hash of doc_id; a documented bound.
SAMPLE = 20_000
QUANTILES, MAX_CONDITIONS, MAX_RULES, LEAST_COVER, LEAST_PRECISION = 20, 3, 8, 8, 0.85
FEATURES = ("mean_word", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "line_words", "end_mark_share", "bang_share")
NOT_SPACE, SPACE = r"[^ \t\n\x0B\f\r]", r"[ \t\n\x0B\f\r]+"


def let(value: Column, body) -> Column:
    """body(value) with value computed once, whatever the optimiser inlines."""
    return F.get(F.transform(F.array(value), body), 0)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words that are in a window of three which occurs twice or more; the windows are sorted, equal ones are neighbours."""

    def count(sorted_windows: Column) -> Column:
        same = lambda x, i: (F.get(sorted_windows, i - 1)["w"] == x["w"]) | F.coalesce(F.get(sorted_windows, i + 1)["w"] == x["w"], F.lit(False))
        at = F.transform(F.filter(sorted_windows, lambda x, i: F.coalesce(same(x, i), F.coalesce(F.get(sorted_windows, i + 1)["w"] == x["w"], F.lit(False)))), lambda x: x["i"])
        # a place adds the words that the repeated window before it has not covered
        return let(F.sort_array(at), lambda p: F.aggregate(F.transform(p, lambda x, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - F.get(p, k - 1)))), F.lit(0), lambda s, v: s + v))

    def of(w: Column) -> Column:
        windows = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)))
        return let(windows, lambda v: F.when(F.size(F.array_distinct(v)) == F.size(v), F.lit(0)).otherwise(let(F.sort_array(F.transform(v, lambda x, i: F.struct(x.alias("w"), i.alias("i")))), count)))

    return let(words, of)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the base statistics, the features of the list, and the row itself as the struct `row`."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(NOT_SPACE))
    of_words = let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).cast("long").alias("n_repeat_words")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    kept = lambda chars: F.length(F.regexp_replace("text", f"[^{chars}]+", "")).cast("double")
    rows = rows.select("row", "doc_id", of_words.alias("w"), of_lines.alias("l"), kept(r"#*$%&|<>").cast("long").alias("n_symbols"), kept("A-Z").alias("upper"), kept("0-9").alias("digits"), kept(".,;:!?").alias("marks"), kept("!").alias("bangs"), kept(".!?").alias("ends"))
    rows = rows.select("row", "doc_id", "w.*", "l.*", "n_symbols", "upper", "digits", "marks", "bangs", "ends")
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return rows.select(
        "row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("word_chars", "n_words").alias("mean_word"), share("n_symbols", "n_words").alias("symbols_per_word"), share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"), share("upper", "word_chars").alias("upper_share"), share("digits", "word_chars").alias("digit_share"), share("marks", "n_words").alias("mark_share"),
        share("n_words", "n_lines").alias("line_words"), share("ends", "n_words").alias("end_mark_share"), share("bangs", "n_words").alias("bang_share"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    at: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] > self.at if self.above else row[self.feature] <= self.at

    def column(self) -> Column:
        return F.col(self.feature) > F.lit(self.at) if self.above else F.col(self.feature) <= F.lit(self.at)


def grow(rows: list[dict], thresholds: dict[str, list[float]]) -> list[Condition]:
    """The conjunction that FOIL gain builds for the bad texts of rows."""
    rule: list[Condition] = []
    while len(rule) < MAX_CONDITIONS:
        bad = sum(r["bad"] for r in rows)
        if not bad or bad == len(rows):
            break
        best, gain, now = None, 0.0, math.log2(bad / len(rows))
        for f, cuts in thresholds.items():
            for above in (True, False):
                order = sorted(rows, key=lambda r: r[f], reverse=above)
                at, b, k = 0, 0, 0
                for cut in sorted(cuts, reverse=above):
                    while at < len(order) and (order[at][f] > cut if above else order[at][f] <= cut):
                        b += order[at]["bad"]
                        k += 1
                        at += 1
                    if b >= LEAST_COVER and (g := b * (math.log2(b / k) - now)) > gain:
                        best, gain = Condition(f, above, cut), g
        if best is None:
            break
        rule.append(best)
        rows = [r for r in rows if best.holds(r)]
    return rule


def precision(rule: list[Condition], rows: list[dict]) -> tuple[float, int]:
    held = [r["bad"] for r in rows if all(c.holds(r) for c in rule)]
    return ((sum(held) + 1) / (len(held) + 2), sum(held)) if held else (0.0, 0)


def prune(rule: list[Condition], rows: list[dict]) -> list[Condition]:
    """Drop last conditions as long as the held-back rows' worth (bad less good covered) does not fall."""
    worth = lambda x: sum(1 if r["bad"] else -4 for r in rows if all(c.holds(r) for c in x))
    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learn(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[list[Condition]]:
    """The ordered rules, from labelled statistics."""
    known = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    chosen = known.select("doc_id", "quality", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(sample)
    fitted = stats.join(F.broadcast(chosen), "doc_id").where(~base_failed())
    rows = [r.asDict() | {"bad": int(r["quality"] == 0)} for r in fitted.select("h", "quality", *FEATURES).collect()]
    rows.sort(key=lambda r: (r["h"], *(r[f] for f in FEATURES)))
    rules: list[list[Condition]] = []
    thresholds = {}
    for f in FEATURES:
        for kind in (0, 1):  # quantiles of either class
            v = sorted(r[f] for r in rows if r["bad"] == kind)
            if v:
                thresholds.setdefault(f, set()).update(v[min(len(v) - 1, k * len(v) // QUANTILES)] for k in range(QUANTILES + 1))
    thresholds = {f: sorted(x) for f, x in thresholds.items()}
    while rows and len(rules) < MAX_RULES:
        growing, held = [r for i, r in enumerate(rows) if i % 3], rows[::3]
        rule = prune(grow(growing, thresholds), held)
        p, n = precision(rule, rows)
        if not rule or p < LEAST_PRECISION or n < LEAST_COVER:
            break
        rules.append(rule)
        rows = [r for r in rows if not all(c.holds(r) for c in rule)]
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """Number of the first rule that holds (from 1), 0 if none: an ordered conditional expression."""
    out = None
    for k, rule in enumerate(rules, 1):
        both = rule[0].column()
        for c in rule[1:]:
            both = both & c.column()
        out = F.when(both, F.lit(k)) if out is None else out.when(both, F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[list[Condition]]:
    """The rules, from the labelled rows among docs. Their texts are written out before, as Spark would otherwise push the base rules below the join and work out the statistics of every document."""
    chosen = labels.where(F.col("quality").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    few = C.cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id", "left_semi"), "sample")
    rules = learn(statistics(few), labels, sample)
    C.drop_cut(few)
    return rules


def judged(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """row (the document's own columns), doc_id, n_words, the four base statistics, base_failed, rule, kept."""
    rules = learned(docs, labels, sample)
    rows = statistics(docs).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return rows.select("row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"))


def digest(rows: DataFrame) -> DataFrame:
    """The contract's columns and the number of the rule."""
    return rows.drop("row")


def passing(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that the rules keep."""
    return judged(docs, labels, sample).where("kept").select("row.*")
