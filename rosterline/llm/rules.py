"""Quality rules as weak supervision: each votes good, bad or not at all, and a model of their accuracies decides.

All statistics of a text, the votes and the rounds of expectation-maximisation are DataFrame expressions. The rounds run
over the counts of vote patterns, of which there are at most 3 to the number of rules, whatever the number of documents.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterline.llm import common

WORD = r"[^\x20\x09-\x0D]+"
#: A document fails the base with fewer words, or a larger percentage of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
ROUNDS = 20
#: Pseudo-counts (right, wrong) of a rule's votes on good and on bad documents, and (good, bad) of documents.
ON_GOOD, ON_BAD, PRIOR = (9, 1), (5, 5), (8, 2)
#: Expected counts are added up in whole parts of this, so that no order of rows or partitions changes a sum. Fits 64 bits
#: up to 9 * 10**12 documents; beyond that Spark reports the overflow.
PARTS = 1_000_000

#: rule: (good, bad), over the statistics of a document.
RULES: dict[str, tuple[str, str]] = {
    "symbols": ("50 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    "word_length": ("word_chars BETWEEN 3 * n_words AND 10 * n_words", "2 * word_chars < 5 * n_words OR word_chars > 20 * n_words"),
    "capitals": ("100 * n_upper <= 15 * word_chars", "100 * n_upper > 30 * word_chars"),
    "repetition": ("100 * n_repeat_words <= 20 * n_words", "100 * n_repeat_words > 40 * n_words"),
    "lines": ("n_lines > 1 AND n_dup_lines = 0", "10 * n_dup_lines > 3 * n_lines"),
    "variety": ("n_words <= 1000 AND 100 * n_distinct >= 30 * n_words", "n_words <= 1000 AND 100 * n_distinct < 15 * n_words"),
    "sentences": ("n_ends BETWEEN n_words / 40 AND n_words / 3", "2 * n_ends > n_words OR n_words >= 100 AND 200 * n_ends < n_words"),
    "marks": ("100 * n_marks <= n_words", "20 * n_marks > n_words"),
    "bare": ("100 * n_bare >= 85 * n_words", "100 * n_bare < 70 * n_words"),
}


def _held(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is computed once however often, and inside whatever function, it is used."""
    return F.transform(F.array(value), use)[0]


def _repeated_words(words: Column) -> Column:
    """Words in windows of three that occur twice or more: equal windows are neighbours once sorted; the places of those
    are put in order again, and each adds what the one before it didn't cover."""
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.concat_ws(" ", words[i], words[i + 1], words[i + 2]).alias("w"), i.alias("i")))
    again = lambda s: F.filter(s, lambda x, k: (F.get(s, k - 1)["w"] == x["w"]) | (F.get(s, k + 1)["w"] == x["w"]))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    add = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"))
    covered = lambda s: F.aggregate(F.array_sort(F.transform(again(s), lambda x: x["i"])), start, add, lambda a: a["n"])
    return F.when(F.size(words) >= 3, _held(F.sort_array(windows), covered)).otherwise(F.lit(0).cast("long"))


def statistics(docs: DataFrame, text: str = "text", identifier: str = "doc_id") -> DataFrame:
    """doc_id and the statistics of every whole text, n_words to n_bare."""
    given = F.coalesce(F.col(text), F.lit(""))
    split = docs.select(F.col(identifier).cast("long").alias("doc_id"), given.alias("text")).withColumns({
        "words": F.regexp_extract_all("text", F.lit(WORD), F.lit(0)),
        "lines": F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD)),
    })
    matching = lambda pattern: F.size(F.filter("words", lambda w: w.rlike(pattern)))
    found = {
        "n_words": F.size("words"),
        "word_chars": F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")),
        "n_symbols": F.regexp_count("text", F.lit(r"[#*$%&|<>]")),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": _repeated_words(F.col("words")),
        "n_lines": F.size("lines"),
        "n_distinct": F.size(F.array_distinct("words")),
        "n_upper": F.regexp_count("text", F.lit(r"\p{Lu}")),
        "n_marks": F.regexp_count("text", F.lit(r"[!?*#$%&|<>=+~^_]{2,}")),
        "n_ends": matching(r"[.?!][\"')\]]*$"),
        "n_bare": matching(r"^\p{L}[\p{L}\p{M}'-]*[,.;:!?]?$"),
    }
    return split.select("doc_id", *(c.cast("long").alias(name) for name, c in found.items()))


def with_votes(rows: DataFrame, rules: Mapping[str, tuple[str, str]] = RULES) -> DataFrame:
    """base_failed, and the votes of the rules in their order: 1 good, -1 bad, 0 no vote."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    votes = [F.when(F.expr(good), 1).when(F.expr(bad), -1).otherwise(0) for good, bad in rules.values()]
    return rows.withColumns({"base_failed": failed, "votes": F.array(*votes)})


@dataclass(frozen=True)
class Accuracies:
    """The share of good documents, and of each rule's votes the share that is right on good and on bad documents."""

    good: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]

    def log_odds(self) -> Column:
        """Of being good rather than bad, given the votes."""
        pairs = list(zip(self.on_good, self.on_bad, strict=True))
        if_good, if_bad = (F.array(*map(F.lit, x)) for x in ([math.log(a / (1 - b)) for a, b in pairs], [math.log((1 - a) / b) for a, b in pairs]))
        each = F.transform("votes", lambda v, k: F.when(v == 1, F.get(if_good, k)).when(v == -1, F.get(if_bad, k)).otherwise(0.0))
        return F.aggregate(each, F.lit(math.log(self.good / (1 - self.good))), lambda total, x: total + x)


def fit(voted: DataFrame, rules: int = len(RULES), rounds: int = ROUNDS) -> Accuracies:
    """Expectation-maximisation over the counts of vote patterns; without rows, what the pseudo-counts say."""
    patterns = common.stored(voted.groupBy("votes").agg(F.count("*").alias("n")), "vote-patterns")
    none = {(k, v): (0.0, 0.0) for k in range(rules) for v in (-1, 1)}
    now = _estimate(none, 0, 0)
    for _ in range(rounds):
        shared = patterns.withColumn("good", F.floor(PARTS / (1 + F.exp(-now.log_odds()))) * F.col("n"))
        each = shared.select("good", (PARTS * F.col("n") - F.col("good")).alias("bad"), F.posexplode("votes").alias("rule", "vote"))
        # Three rows per rule; those of the first rule hold every pattern once.
        sums = each.groupBy("rule", "vote").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect()
        found = none | {(r.rule, r.vote): (r.good / PARTS, r.bad / PARTS) for r in sums}
        whole = [sum(r[c] for r in sums if r.rule == 0) / PARTS for c in ("good", "bad")]
        now = _estimate(found, *whole)
    return now


def _estimate(found: Mapping[tuple[int, int], tuple[float, float]], good: float, bad: float) -> Accuracies:
    """From the good and bad documents there are for each rule and vote, and in all."""
    share = lambda a, b, prior: (a + prior[0]) / (a + b + sum(prior))
    rules = sorted({k for k, _ in found})
    on_good = tuple(share(found[k, 1][0], found[k, -1][0], ON_GOOD) for k in rules)
    return Accuracies(share(good, bad, PRIOR), on_good, tuple(share(found[k, -1][1], found[k, 1][1], ON_BAD) for k in rules))


def judged(docs: DataFrame, rules: Mapping[str, tuple[str, str]] = RULES, text: str = "text", identifier: str = "doc_id") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, quality, kept of every row.

    The accuracies are learned from all documents that pass the base rules. ``quality`` is the posterior probability of
    a good document, also for those that fail the base; kept are those that pass it with 0.5 or more. A null or empty
    text has no words and fails. Repeated rows and ids count each time; a null id is kept as it is. Other columns take
    no part, whatever their names. An empty table gives an empty result. One text's words are held in memory at a time.
    """
    voted = common.stored(with_votes(statistics(docs, text, identifier), rules), "votes")
    odds = fit(voted.filter("NOT base_failed"), len(rules)).log_odds()
    found = voted.withColumn("odds", odds)
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return found.select(*base, (1 / (1 + F.exp(-F.col("odds")))).alias("quality"), (~F.col("base_failed") & (F.col("odds") >= 0)).alias("kept"))
