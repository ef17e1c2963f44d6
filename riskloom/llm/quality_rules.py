"""Quality rules as weak supervision: rules vote or abstain, EM weighs the votes.

Each rule looks at one measure of a text and votes good, bad or abstains. A two-class
model with, for every rule, the probability of a right vote on good and on bad texts is
fitted by expectation-maximisation on the counts of vote patterns; there are at most
3 ** (number of rules) patterns, whatever the corpus. The posterior probability of a good
text then decides. DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce
from operator import mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import GAP, stored, words

WINDOW = 5
ROUNDS = 20
PRIOR, ON_GOOD, ON_BAD = 0.8, 0.98, 0.5  # where the rounds start
MOST, LEAST = 0.999, 0.02
PRIOR_VOTES = 1.0  # votes a text at ON_GOOD that a rule's accuracy on good texts starts with


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of every whole text: n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words, n_upper, n_stops (long).

    Repeated five-word windows are found inside the row: window hashes (64 bits) are
    compared as an array; only rows with a repeat are sorted. Nothing is shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    def length_of(pattern: str) -> Column:
        """Characters left when what matches ``pattern`` is removed."""
        return F.length(F.regexp_replace(text, pattern, "")).cast("long")

    split = docs.select(
        F.col(id_col).alias("doc_id"),
        words(text).alias("w"),
        length_of(GAP).alias("word_chars"),
        length_of(r"[^#*$%&|<>]+").alias("n_symbols"),
        length_of(r"[^\p{Lu}]+").alias("n_upper"),
        F.regexp_count(text, F.lit(r"[.!?。](?=[\x20\x09-\x0D]|$)")).cast("long").alias("n_stops"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    w = F.col("w")
    hashed = split.select(
        "doc_id", "word_chars", "n_symbols", "n_upper", "n_stops",
        F.size("w").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("w") >= WINDOW,
            F.transform(
                F.slice(w, F.lit(1), F.size(w) - (WINDOW - 1)),
                lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, WINDOW)]),
            ),
        ).otherwise(F.array().cast("array<bigint>")).alias("h"),
    )
    repeated = hashed.withColumn("repeats", F.size(F.array_distinct("h")) < F.size("h"))
    in_order = repeated.withColumn(
        "s", F.when(F.col("repeats"), F.array_sort(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    ).drop("h")
    s = F.col("s")
    found = in_order.withColumn(
        "p",
        F.array_sort(F.transform(
            F.filter(s, lambda e, i: F.coalesce(F.get(s, i + 1).h == e.h, F.lit(False))
                     | ((i > 0) & (F.get(s, F.greatest(i - 1, F.lit(0))).h == e.h))),
            lambda e: e.i,
        )),
    ).drop("s")
    p = F.col("p")
    covered = F.aggregate(
        F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))),
        F.lit(0).cast("long"), lambda total, n: total + n,
    )
    return found.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("p", "repeats")


def _vote(value: Column, good: Column, bad: Column) -> Column:
    return F.when(value.isNull(), 0).when(bad, -1).when(good, 1).otherwise(0)


def votes(measured: DataFrame) -> dict[str, Column]:
    """One column per rule: 1 good, -1 bad, 0 abstains."""
    n = F.nullif(F.col("n_words"), F.lit(0))
    symbols = F.col("n_symbols") / n
    repeats = F.col("n_repeat_words") / n
    duplicates = F.col("n_dup_lines") / F.nullif(F.col("n_lines"), F.lit(0))
    mean = (F.col("word_chars") - F.col("n_symbols")) / n
    upper = F.col("n_upper") / F.nullif(F.col("word_chars"), F.lit(0))
    per_stop = F.col("n_words") / (F.col("n_stops") + 1)
    return {
        "few_symbols": _vote(symbols, symbols < 0.05, symbols > 0.2),
        "few_repeats": _vote(repeats, repeats < 0.05, repeats > 0.2),
        "few_duplicate_lines": _vote(duplicates, duplicates < 0.1, duplicates > 0.3),
        "usual_word_length": _vote(mean, mean.between(3, 8), (mean < 2) | (mean > 12)),
        "few_capitals": _vote(upper, upper < 0.15, upper > 0.4),
        "sentences": _vote(per_stop, (per_stop <= 20) & (F.col("n_stops") > 0), per_stop > 30),
        "enough_words": _vote(n, n >= 40, n < 10),
    }


def estimate(voted: DataFrame, rules: list[str], rounds: int = ROUNDS) -> dict:
    """Prior of good texts and, per rule, the accuracy on good and on bad texts.

    ``voted`` has one column per rule. The pattern counts (at most 3 ** rules of them) are
    gathered in one row, in which an array fold runs the rounds. Accuracies on good texts
    have a prior of ``PRIOR_VOTES`` votes a text at 0.98, in proportion to the corpus, which
    keeps the classes from swapping; a rule that is wrong on a tenth of the good texts comes
    out near 0.94 and its bad votes weigh less. A rule that sees only one kind of bad text
    may be wrong about most others, whose good votes then say little. One vote is added to
    each, so that few votes settle nothing. Without rows the starting values are given.
    """
    counts = voted.groupBy(*rules).agg(F.count("*").cast("double").alias("n"))
    patterns = counts.agg(F.sort_array(F.collect_list(F.struct(*rules, "n"))).alias("patterns"), F.sum("n").alias("total"))
    start = F.struct(
        F.lit(PRIOR).alias("prior"),
        F.array(*[F.lit(ON_GOOD)] * len(rules)).alias("good"),
        F.array(*[F.lit(ON_BAD)] * len(rules)).alias("bad"),
    )
    seen = ("good_right", "good_wrong", "bad_right", "bad_wrong")

    def one_round(model: Column, _: Column) -> Column:
        weighed = F.transform("patterns", lambda p: F.struct(
            *[p[r].alias(r) for r in rules], p["n"].alias("n"),
            (p["n"] * posterior([p[r] for r in rules], model["prior"], model["good"], model["bad"])).alias("g"),
        ))
        nothing = F.struct(F.lit(0.0).alias("g"), *[F.array(*[F.lit(0.0)] * len(rules)).alias(s) for s in seen])

        def add_up(acc: Column, x: Column) -> Column:
            bad = x["n"] - x["g"]
            share = {"good_right": (1, x["g"]), "good_wrong": (-1, x["g"]), "bad_right": (-1, bad), "bad_wrong": (1, bad)}
            return F.struct((acc["g"] + x["g"]).alias("g"), *[
                F.array(*[acc[s][i] + F.when(x[r] == vote, n).otherwise(0.0) for i, r in enumerate(rules)]).alias(s)
                for s, (vote, n) in share.items()
            ])

        def kept(right: Column, wrong: Column, start: float, added: Column) -> Column:
            return F.zip_with(right, wrong, lambda a, b: F.least(
                F.lit(MOST), F.greatest(F.lit(LEAST), (a + start * added) / (a + b + added))
            ))

        return F.aggregate(weighed, nothing, add_up, lambda acc: F.struct(
            F.least(F.lit(MOST), F.greatest(F.lit(1 - MOST), acc["g"] / F.col("total"))).alias("prior"),
            kept(acc["good_right"], acc["good_wrong"], ON_GOOD, 1 + PRIOR_VOTES * F.col("total")).alias("good"),
            kept(acc["bad_right"], acc["bad_wrong"], ON_BAD, F.lit(1.0)).alias("bad"),
        ))

    fitted = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, one_round)
    row = patterns.select(F.when(F.col("total") > 0, fitted).otherwise(start).alias("m")).first()["m"]
    return row.asDict()


def posterior(votes_cast: list[Column], prior: Column, good: Column, bad: Column) -> Column:
    """Probability of a good text given the votes; abstentions say nothing."""
    def chance(right: int, accuracies: Column) -> Column:
        return reduce(mul, [
            F.when(v == right, accuracies[i]).when(v == -right, 1 - accuracies[i]).otherwise(1.0)
            for i, v in enumerate(votes_cast)
        ])

    is_good = prior * chance(1, good)
    return is_good / (is_good + (1 - prior) * chance(-1, bad))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """Measures, votes, posterior and verdict of every whole text.

    ``base_failed``: fewer than 10 words, or over a fifth of the words in repeated
    five-word windows. ``kept``: not base_failed and posterior of at least ``least``.
    Null and empty texts have no words and fail. One row per row, repeated rows included;
    the empty table gives no rows.
    """
    measured = stored(measures(docs, id_col, text_col), "quality-measures")
    rules = votes(measured)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    voted = measured.withColumns(rules).withColumn("base_failed", failed)
    # Texts that the base rules drop have no say in how far the other rules are trusted.
    model = estimate(voted.where("NOT base_failed"), list(rules))
    return (
        voted.withColumn("posterior", posterior([F.col(r) for r in rules], *[F.lit(model[k]) for k in ("prior", "good", "bad")]))
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least))
    )
