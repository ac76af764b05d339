"""Quality rules by weak supervision, in DataFrame functions only.

Every rule looks at a few counts of the whole text and votes good, bad or abstains. Expectation-maximisation over the
counts of vote patterns (3 ** rules at most, whatever the corpus' size) estimates how often each rule votes bad on good
and on bad documents, within limits that keep the two meanings apart (a good share of 0.5 to 0.99; a rule accuses at most
0.3 of the good documents and at least 0.05 of the bad, and half as much again as of the good): a rule that accuses fewer
ends on the limit, which then is no estimate. The posterior probability of a good document replaces a filter that all rules must pass. Two base
rules stay hard: fewer than 50 words, or over half the words in repeated three-word windows.

Nulls and odd cases: a null or empty text has no words, so all counts are 0 and the base rules fail it. A null doc_id
is kept as it is; repeated rows are judged one by one. Texts of any length are counted whole. An empty table gives an empty
result. Further columns of the
input are ignored by `text_counts`, and kept untouched by `keep_good` unless they bear the helpers' leading underscore.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwright.sources.scratch import written

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50


@dataclass(frozen=True)
class Rule:
    """`value` above `bad` votes bad, at or below `good` votes good, between them (or null) it abstains."""

    name: str
    value: str
    good: float
    bad: float


#: Each value is an SQL expression over the columns of `text_counts`.
RULES = (
    Rule("symbols_per_word", "n_symbols / n_words", 0.1, 0.4),
    Rule("marks_in_words", "n_marks / word_chars", 0.12, 0.2),
    Rule("unusual_marks", "if(n_marks >= 5, 1 - n_sentence_marks / n_marks, null)", 0.4, 0.7),
    Rule("duplicate_lines", "if(n_lines > 2, n_dup_lines / n_lines, null)", 0.05, 0.3),
    Rule("repeated_words", "n_repeat_words / n_words", 0.2, 0.35),
    Rule("long_words", "abs(word_chars / n_words - 6)", 3.0, 6.0),
    Rule("capitals", "n_capitals / word_chars", 0.2, 0.5),
    Rule("exclamations", "n_exclamations / n_words", 0.05, 0.3),
)


def text_counts(docs: DataFrame, passed: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts over whole texts: one row per input row, `passed` columns first.

    Repeated windows are found inside the row: hashes of all three-word windows, sorted with their positions, so equal
    windows are neighbours. Only texts that have a repeated window at all are sorted.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = docs.select(*passed, text.alias("_text"), F.array_remove(F.split(text, BLANKS), "").alias("_words"))
    windows = split.select(
        "*",
        F.size("_words").cast("long").alias("n_words"),
        F.when(F.size("_words") >= 3, F.slice(F.transform("_words", lambda w, i: F.xxhash64(
            w, F.get("_words", i + 1), F.get("_words", i + 2))), F.lit(1), F.size("_words") - 2)).alias("_windows"),
        # Marks are neither letters, digits nor blanks: a short rest on which the other counts are cheap.
        F.regexp_replace("_text", r"[\p{L}\p{M}\p{N}\x20\x09-\x0D]+", "").alias("_marks"),
        F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    counted = windows.select(
        *passed, "n_words",
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.length("_marks").cast("long").alias("n_marks"),
        _occurrences("_marks", SYMBOLS).alias("n_symbols"),
        _occurrences("_marks", "!+").alias("n_exclamations"),
        _occurrences("_marks", r"[.,;:?!'\"()-]+").alias("n_sentence_marks"),
        _occurrences("_text", "[A-Z]+").alias("n_capitals"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array(F.transform(
            "_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_sorted"),
    )
    repeated = counted.withColumn("_repeated", F.filter("_sorted", lambda x, i: (
        F.get("_sorted", i - 1)["h"].eqNullSafe(x["h"]) | F.get("_sorted", i + 1)["h"].eqNullSafe(x["h"]))))
    covered = F.aggregate(
        F.sort_array(F.transform("_repeated", lambda x: x["i"])),
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("total")),
        lambda s, i: F.struct(i.alias("last"), (s["total"] + F.least(F.lit(3), i - s["last"])).alias("total")),
        lambda s: s["total"],
    )
    return repeated.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_sorted", "_repeated")


def _occurrences(column: str, runs: str) -> Column:
    """How many characters of `column` lie in runs that match the pattern."""
    return (F.length(column) - F.length(F.regexp_replace(column, runs, ""))).cast("long")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


def with_votes(counts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds `_votes`: per rule 1 (good), -1 (bad) or 0 (abstains; also where the value is null or divides by 0)."""
    def vote(rule: Rule) -> Column:
        value = F.when((F.col("n_words") > 0) & (F.col("word_chars") > 0), F.expr(rule.value))
        return F.when(value > rule.bad, -1).when(value <= rule.good, 1).otherwise(0)

    return counts.withColumn("_votes", F.array(*[vote(r) for r in rules]))


@dataclass(frozen=True)
class Accuracies:
    """P(document is good), and per rule P(votes bad | good document) and P(votes bad | bad document)."""

    good: float
    bad_on_good: tuple[float, ...]
    bad_on_bad: tuple[float, ...]

    def posterior(self, votes: list[int]) -> float:
        odds = math.log(self.good / (1 - self.good))
        for vote, g, b in zip(votes, self.bad_on_good, self.bad_on_bad, strict=True):
            odds += math.log(g / b) if vote < 0 else math.log((1 - g) / (1 - b)) if vote > 0 else 0
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def expectation_maximisation(patterns: list[tuple[list[int], int]], rules: int, rounds: int = 40) -> Accuracies:
    """Fit on (votes, number of documents) pairs.

    Starts from rules that seldom accuse a good document. A rule's two rates stay on their own side of each other, so
    "good" keeps its meaning.
    """
    fitted = Accuracies(0.85, (0.03,) * rules, (0.4,) * rules)
    for _ in range(rounds if patterns else 0):
        good = total = 0.0
        votes = [[[1.0, 30.0], [1.0, 2.0]] for _ in range(rules)]  # pseudo-counts: [good doc, bad doc][bad, good vote]
        for pattern, count in patterns:
            p = fitted.posterior(pattern)
            good, total = good + p * count, total + count
            for tally, vote in zip(votes, pattern, strict=True):
                if vote:
                    tally[0][vote > 0] += p * count
                    tally[1][vote > 0] += (1 - p) * count
        on_good = tuple(min(0.3, max(1e-4, t[0][0] / sum(t[0]))) for t in votes)
        on_bad = tuple(min(0.99, max(0.05, 1.5 * g, t[1][0] / sum(t[1]))) for t, g in zip(votes, on_good, strict=True))
        fitted = Accuracies(min(0.99, max(0.5, good / total)), on_good, on_bad)
    return fitted


def posterior_odds(accuracies: Accuracies) -> Column:
    """Logarithm of the odds that a document is good, from its `_votes`."""
    odds = F.lit(math.log(accuracies.good / (1 - accuracies.good)))
    for k, (g, b) in enumerate(zip(accuracies.bad_on_good, accuracies.bad_on_bad, strict=True)):
        vote = F.col("_votes")[k]
        odds += F.when(vote < 0, math.log(g / b)).when(vote > 0, math.log((1 - g) / (1 - b))).otherwise(0.0)
    return odds


def fit(voted: DataFrame, rules: tuple[Rule, ...] = RULES) -> Accuracies:
    """The driver gets one row per vote pattern; documents that fail the base rules do not count."""
    rows = voted.groupBy("_votes", base_failed().alias("failed")).count().collect()
    return expectation_maximisation(sorted((list(r["_votes"]), r["count"]) for r in rows if not r["failed"]), len(rules))


def judge(docs: DataFrame, passed: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """doc_id, the counts, base_failed, quality (posterior) and kept, for every row of `docs`.

    The counts are written once to the shared scratch folder: the fit and the verdicts both read them.
    """
    voted = written(with_votes(text_counts(docs, passed)), "votes")
    odds = posterior_odds(fit(voted))
    return voted.select("*", base_failed().alias("base_failed"), (1 / (1 + F.exp(-odds))).alias("quality")).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= 0.5)).drop("_votes")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of `docs` whose verdict is kept, with their own columns.

    The verdict needs the fitted rates first, so texts are counted twice: once to fit and once to filter, which spares
    a shuffle of all texts.
    """
    accuracies = fit(with_votes(text_counts(docs, ())))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text")
    good = ~base_failed() & (posterior_odds(accuracies) >= 0)
    # The row number is not wanted for itself: Spark does not push a filter below a column that is not deterministic,
    # and pushed down, this one would carry all the counting with it, several times over.
    judged = with_votes(text_counts(whole, ("_row",))).select("_row", good.alias("_good"), F.monotonically_increasing_id().alias("_nr"))
    return judged.where("_good and _nr >= 0").select("_row.*")
