"""Quality rules under weak supervision, in DataFrame functions only.

Each rule votes that a text is bad (-1) or good (+1), or abstains (0); all but one can only vote bad, since
a text that is clean in one respect may be junk in another. A two-class model with one vote
distribution per rule and class is fitted by expectation maximisation on the histogram of vote patterns
(3^9 patterns at most, however large the corpus), starting from "bad if any rule says so". The posterior
probability of the good class decides, instead of an all-must-pass filter; a rule that fires on good texts
as often as on bad ones loses its say.

The measures and votes are written once to the shared folder; the fit and the verdicts read that table.

Defined results: null and empty texts have no words, measures of 0 and fail the base rules; rows that
repeat get the same answer; an empty table gives no rows; other columns are ignored, or kept by
keep_good(). The probability of an empty corpus's model is 0.5 for every pattern.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.llm.common import written

WINDOW = 8
#: Base rules: fewer words than this, or a larger share of words in repeated windows, and a text fails.
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Texts below this posterior probability of being good are not kept.
MIN_PROBABILITY = 0.5
ROUNDS = 60


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(hashes: Column) -> Column:
    """Words that stand in a window of 8 found twice or more, from the array of word hashes."""

    def covered(windows: Column) -> Column:
        def of_sorted(pairs: Column) -> Column:
            same = lambda p, k: F.coalesce(F.get(pairs, k)["h"] == p["h"], F.lit(False))
            twice = F.filter(pairs, lambda p, k: same(p, k - 1) | same(p, k + 1))
            return _let(
                F.sort_array(F.transform(twice, lambda p: p["i"])),
                lambda at: F.aggregate(F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda s, x: s + x),
            )

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(_let(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), of_sorted))

    windows = F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))
    return F.when(F.size(hashes) < WINDOW, F.lit(0)).otherwise(_let(windows, covered))


def measured(docs: DataFrame) -> DataFrame:
    """docs with a struct column _q of measures: the base ones and those that only the votes use."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kept_chars = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))

    def of_words(words: Column) -> Column:
        def of_hashes(hashes: Column) -> Column:
            return F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
                F.size(F.array_distinct(hashes)).cast("long").alias("n_kinds"),
                _repeat_words(hashes).cast("long").alias("n_repeat_words"),
            )

        return _let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)

    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    of_lines = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return docs.select(
        "*",
        _let(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""), of_words).alias("_q_words"),
        of_lines.alias("_q_lines"),
        F.struct(kept_chars(r"[^#*$%&|<>]+").cast("long").alias("n_symbols"), kept_chars(r"\P{Lu}+").cast("long").alias("n_upper"), kept_chars(r"[^!?]+").cast("long").alias("n_cries")).alias("_q_chars"),
    ).select(*docs.columns, F.struct("_q_words.*", "_q_lines.*", "_q_chars.*").alias("_q"))


def _votes(q: Column) -> dict[str, Column]:
    """By rule: -1 bad, +1 good, 0 abstains."""
    words, chars = F.greatest(q["n_words"], F.lit(1)), F.greatest(q["word_chars"], F.lit(1))
    bad = lambda when: F.when(when, -1).otherwise(0)
    size, symbols, upper, cries = chars / words, q["n_symbols"] / chars, q["n_upper"] / chars, q["n_cries"] / words
    copied, repeated = q["n_dup_lines"] / F.greatest(q["n_lines"], F.lit(1)), q["n_repeat_words"] / words
    variety = q["n_kinds"] / F.sqrt(words)
    return {
        "words": bad(q["n_words"] < MIN_WORDS),
        "word_size": bad((size < 2) | (size > 14)),
        "symbols": bad(symbols > 0.05),
        "upper_case": bad(upper > 0.4),
        "cries": bad(cries > 0.25),
        "copied_lines": bad(copied > 0.3),
        "repeats": bad(repeated > 0.3),
        "variety": bad((variety < 1.6) & (q["n_words"] >= 40)),
        "prose": F.when((symbols < 0.02) & (upper < 0.15) & (cries < 0.05) & (repeated <= 0.3) & (variety > 2) & size.between(3, 12), 1).otherwise(0),
    }


RULES = 9


def _coded(q: Column) -> Column:
    """A vote pattern as one number, base 3."""
    return sum(((v + 1) * 3**k for k, v in enumerate(_votes(q).values())), F.lit(0)).cast("int")


def fit(histogram: dict[int, int]) -> tuple[float, list[dict[int, float]]]:
    """EM over vote patterns: the prior log-odds of good, and by rule the log-odds that each vote adds."""
    rows = [([code // 3**k % 3 for k in range(RULES)], n) for code, n in sorted(histogram.items())]
    if not rows:
        return 0.0, [{v: 0.0 for v in range(3)} for _ in range(RULES)]
    good = [0.05 if 0 in votes else 0.95 for votes, _ in rows]
    prior, odds = 0.0, []
    for _ in range(ROUNDS):
        total = [1.0, 1.0]
        seen = [[[1.0] * 3 for _ in range(2)] for _ in range(RULES)]
        for (votes, n), p in zip(rows, good, strict=True):
            total[0] += n * (1 - p)
            total[1] += n * p
            for k, v in enumerate(votes):
                seen[k][0][v] += n * (1 - p)
                seen[k][1][v] += n * p
        prior = math.log(total[1] / total[0])
        odds = [{v: math.log(s[1][v] / sum(s[1])) - math.log(s[0][v] / sum(s[0])) for v in range(3)} for s in seen]
        good = [1 / (1 + math.exp(-max(-50.0, min(50.0, prior + sum(odds[k][v] for k, v in enumerate(votes)))))) for votes, _ in rows]
    return prior, odds


def judged(docs: DataFrame, columns: list[str]) -> DataFrame:
    """These columns of docs, as written, with _q and the columns _base_failed, _probability and _kept."""
    rated = written(measured(docs).withColumn("_votes", _coded(F.col("_q"))).select(*columns, "_q", "_votes"), "votes")
    prior, odds = fit({r["_votes"]: r["n"] for r in rated.groupBy("_votes").agg(F.count("*").alias("n")).collect()})
    digit = lambda k: F.floor(F.col("_votes") / 3**k) % 3
    logit = F.lit(prior)
    for k, by in enumerate(odds):
        logit = logit + F.when(digit(k) == 0, by[0]).when(digit(k) == 1, by[1]).otherwise(by[2])
    q = F.col("_q")
    failed = (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEAT_PERCENT * q["n_words"])
    scored = rated.withColumn("_base_failed", failed).withColumn("_probability", 1 / (1 + F.exp(-logit)))
    return scored.withColumn("_kept", ~F.col("_base_failed") & (F.col("_probability") >= MIN_PROBABILITY))


def quality_rules(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the base measures, base_failed, kept, and the posterior probability of good."""
    out = judged(docs.select("doc_id", "text"), ["doc_id"])
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select("doc_id", *[F.col("_q")[n].alias(n) for n in names], F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"), F.col("_probability").alias("probability"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""
    return judged(docs, docs.columns).filter("_kept").select(*docs.columns)
