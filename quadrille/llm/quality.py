"""Quality by weak supervision: rules vote or abstain, and their accuracies are learned.

Each rule votes good, bad or nothing from a few counts of the text. Rules come
in grades, a strict one that good documents fail now and then beside a lax one
that they hardly ever fail, so that how much a fault says is for the data to
tell. Documents are counted by their combination of votes, of which there are at
most 3 to the number of rules, whatever the corpus (some hundreds in practice, as
the grades of one count go together). Expectation-maximisation over these counts
estimates the share of good documents and how often each rule says good for good
and for bad ones, with Beta priors worth a few documents and no bounds; a
document's posterior odds are the prior's times each vote's likelihood ratio.
The classes are told apart at the end: good is the one whose rules say good more
often. Counts and posteriors are SQL functions; no Python runs on executors.

Rows: a null text has no words and fails; texts are counted whole; equal texts
have equal results; a document on which all rules abstain has the prior; a
posterior of exactly 0.5 is kept; an empty table gives no rows. Extra columns
are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.plans.lineage import cut

WORD = r"[^\x20\x09-\x0D]+"
WINDOW = 8
CHARACTERS = {"n_symbols": "[#*$%&|<>]", "n_other": r"[^\p{L}\p{M}\x20\x09-\x0D]", "n_upper": r"\p{Lu}", "n_ends": r"[.,;:!?](?![^\x20\x09-\x0D])"}


@dataclass(frozen=True)
class Rule:
    """A name and SQL conditions over the counts for either vote; neither: the rule abstains."""

    name: str
    good: str
    bad: str


RULES = (
    Rule("short", "n_words >= 100", "n_words < 50"),
    Rule("symbols", "n_symbols = 0", "50 * n_symbols > n_words"),
    Rule("many_symbols", "10 * n_symbols <= n_words", "3 * n_symbols > n_words"),
    Rule("word_length", "word_chars between 4 * n_words and 7 * n_words", "word_chars < 3 * n_words or word_chars > 10 * n_words"),
    Rule("other_chars", "20 * n_other <= word_chars", "10 * n_other > word_chars"),
    Rule("many_other_chars", "10 * n_other <= word_chars", "10 * n_other > 3 * word_chars"),
    Rule("capitals", "20 * n_upper <= n_letters", "10 * n_upper > n_letters"),
    Rule("many_capitals", "5 * n_upper <= n_letters", "2 * n_upper > n_letters"),
    Rule("lines", "n_lines > 1 and n_dup_lines = 0", "10 * n_dup_lines > n_lines"),
    Rule("many_lines", "n_lines > 1 and 10 * n_dup_lines <= n_lines", "n_dup_lines > 2 and 10 * n_dup_lines > 3 * n_lines"),
    Rule("repeats", "n_repeat_words = 0", "50 * n_repeat_words > n_words"),
    Rule("many_repeats", "50 * n_repeat_words <= n_words", "4 * n_repeat_words > n_words"),
    Rule("stutter", "50 * n_stutter <= n_words", "10 * n_stutter > n_words"),
    Rule("variety", "4 * n_distinct >= 3 * n_words", "3 * n_distinct < 2 * n_words"),
    Rule("much_variety", "2 * n_distinct >= n_words", "10 * n_distinct < 3 * n_words"),
    Rule("sentences", "12 * n_ends >= n_words and 2 * n_ends <= n_words", "20 * n_ends < n_words or 5 * n_ends > 4 * n_words"),
)


def _pairs(hashes: Column, step: int) -> Column:
    n = F.size(hashes) - step
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols and n_repeat_words as documented for the rules, and further counts.

    n_other: characters of words that are neither letters nor marks on them;
    n_upper, n_letters: capital and all other characters of words; n_ends: stops
    at the end of a word; n_lines, n_dup_lines: lines with a word, and those equal
    to an earlier one; n_stutter: words equal to the one before; n_distinct words.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    one = docs.select(F.col("doc_id").cast("long"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("w"), *(F.regexp_count(text, F.lit(pattern)).cast("long").alias(name) for name, pattern in CHARACTERS.items()), lines.alias("l"))
    known = (F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"), *CHARACTERS, F.size("l").cast("long").alias("n_lines"), (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"))
    hashed = F.transform("w", lambda x: F.xxhash64(x))
    step = one.select("doc_id", *known, hashed.alias("h"))
    again = F.zip_with(F.slice("h", F.lit(1), F.size("h") - 1), F.slice("h", F.lit(2), F.size("h") - 1), lambda a, b: (a == b).cast("int"))
    stutter = F.when(F.size("h") > 1, F.aggregate(again, F.lit(0), lambda total, x: total + x)).otherwise(0)
    # Hashes of 1, 2, 4 and then 8 consecutive words.
    step = step.select("*", stutter.cast("long").alias("n_stutter"), F.size(F.array_distinct("h")).cast("long").alias("n_distinct"), (F.col("word_chars") - F.col("n_other")).alias("n_letters")).withColumn("h", F.when(F.size("h") >= WINDOW, F.col("h")))
    for n in (1, 2, 4):
        step = step.select("doc_id", *(c for c in step.columns if c.startswith("n_") or c == "word_chars"), _pairs(F.col("h"), n).alias("h"))
    named = [c for c in step.columns if c != "h"]
    # Only texts in which a window comes twice sort their windows to find where.
    twice = F.size(F.array_distinct("h")) < F.size("h")
    step = step.select(*named, F.when(twice, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("s"))
    n = F.size("s")
    near = F.arrays_zip(F.col("s").alias("x"), F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice("s", F.lit(1), n - 1)).alias("p"), F.slice("s", F.lit(2), n).alias("q"))
    step = step.select(*named, F.when(F.col("s").isNotNull(), near).alias("z"))
    same = F.filter("z", lambda z: F.coalesce(z["x"]["h"] == z["p"]["h"], F.lit(False)) | F.coalesce(z["x"]["h"] == z["q"]["h"], F.lit(False)))
    step = step.select(*named, F.sort_array(F.transform(same, lambda z: z["x"]["i"])).alias("at"))
    gaps = F.zip_with("at", F.slice("at", F.lit(2), F.size("at")), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    covered = F.aggregate(gaps, F.lit(0), lambda total, x: total + x)
    return step.select(*named, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


@dataclass(frozen=True)
class Voters:
    """What was learned: the share of good documents, and for each rule how often a vote says good in good and in bad ones."""

    prior: float
    good: tuple[float, ...]
    bad: tuple[float, ...]


#: Beta priors in documents (says good, says bad): of good documents, of bad ones; and (good, bad) of the share.
PRIOR_GOOD, PRIOR_BAD, PRIOR_SHARE = (9.0, 1.0), (2.0, 2.0), (4.0, 1.0)


def fit(patterns: list[tuple[tuple[int, ...], int]], rules: int, rounds: int = 500) -> Voters:
    """Expectation-maximisation over counts of vote patterns; -1 is bad, 1 good, 0 nothing."""
    patterns = sorted(patterns)
    votes = np.array([v for v, _ in patterns], np.int8).reshape(-1, rules)
    n = np.array([c for _, c in patterns], float)
    yes, no = (votes > 0).astype(float), (votes < 0).astype(float)
    prior, good, bad = 0.8, np.full(rules, 0.9), np.full(rules, 0.5)
    for _ in range(rounds):
        odds = math.log(prior / (1 - prior)) + yes @ np.log(good / bad) + no @ np.log((1 - good) / (1 - bad))
        p = n / (1 + np.exp(-np.clip(odds, -500, 500)))
        q = n - p
        up, down = PRIOR_GOOD[0] + p @ yes, PRIOR_GOOD[1] + p @ no
        bad_up, bad_down = PRIOR_BAD[0] + q @ yes, PRIOR_BAD[1] + q @ no
        share = (PRIOR_SHARE[0] + p.sum()) / (sum(PRIOR_SHARE) + n.sum())
        moved = max(abs(share - prior), np.abs(up / (up + down) - good).max(), np.abs(bad_up / (bad_up + bad_down) - bad).max())
        prior, good, bad = share, up / (up + down), bad_up / (bad_up + bad_down)
        if moved < 1e-12:
            break
    if good.mean() < bad.mean():
        prior, good, bad = 1 - prior, bad, good
    return Voters(float(prior), tuple(good.tolist()), tuple(bad.tolist()))


def _weights(voters: Voters) -> list[tuple[float, float]]:
    return [(math.log(g / b), math.log((1 - g) / (1 - b))) for g, b in zip(voters.good, voters.bad, strict=True)]


def posterior(votes: tuple[int, ...], voters: Voters) -> float:
    """The probability that a document with these votes is good."""
    odds = math.log(voters.prior / (1 - voters.prior))
    for v, (up, down) in zip(votes, _weights(voters), strict=True):
        odds += up if v > 0 else down if v < 0 else 0.0
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The counts of every document with base_failed, quality (the posterior) and kept."""
    seen = cut(counts(docs), "counts")
    votes = [F.when(F.expr(r.bad), -1).when(F.expr(r.good), 1).otherwise(0).alias(r.name) for r in rules]
    voted = seen.select("*", *votes)
    names = [r.name for r in rules]
    patterns = [(tuple(row[n] for n in names), row["count"]) for row in voted.groupBy(*names).count().collect()]  # at most 3 ** len(rules)
    voters = fit(patterns, len(rules))
    odds = F.lit(math.log(voters.prior / (1 - voters.prior)))
    for name, (up, down) in zip(names, _weights(voters), strict=True):
        odds = odds + F.when(F.col(name) > 0, up).when(F.col(name) < 0, down).otherwise(0.0)
    failed = F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")
    scored = voted.withColumn("quality", 1 / (1 + F.exp(-odds))).withColumn("base_failed", failed)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5)).drop(*names)
