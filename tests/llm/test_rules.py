"""The weakly supervised quality rules against a plain version in loops."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from rosterline.llm import common, rules

SCHEMA = "doc_id long, text string, words string, kept int, votes string, n_words double"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(33)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopéß𝒳"), rng.integers(2, 9)))
    prose = lambda n: " ".join(word() + ("." if rng.random() < 0.1 else "") for _ in range(n))
    texts: list[str | None] = [prose(int(n)) for n in rng.integers(40, 400, 80)]
    texts += [" ".join(w + rng.choice(["$$$", "%%%", "###"]) for w in t.split()) for t in texts[:12]]
    texts += [" | ".join(t.split()) for t in texts[12:18]] + [t.upper().replace(" ", "!! ") for t in texts[18:24]]
    texts += ["one two three " * 60, "a " * 200, "line of text here\n" * 30 + prose(60), "", None, " \t\n\x0b", "x", "a b", "a b c", "a b c a b c a b", "\n\n", prose(9000)]
    texts += ["z" * 100_000 + " " + prose(60), prose(30) + " " + prose(30)]
    out = [(i, t) for i, t in enumerate(texts)]
    return [(*r, "w", 3, "v", 1.0) for r in [*out, (None, texts[0]), out[3], out[3], (5, texts[9])]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    common.ship(spark)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def base(text):
    words = [w for w in (text or "").translate({k: " " for k in range(9, 14)}).split(" ") if w]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    times = Counter(windows)
    repeated = {k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if any(c not in " \t\n\x0b\x0c\r" for c in x)]
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(repeated)


def test_statistics(docs, rows):
    got = rules.statistics(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert Counter(map(tuple, got)) == Counter((r[0], *base(r[1])) for r in rows)


def test_verdicts(docs, rows):
    """The rounds of the model over single documents in place of patterns give the same verdicts."""
    n = len(rules.RULES)
    voted = rules.with_votes(rules.statistics(docs)).collect()
    for r in voted:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.votes[0] == (1 if 50 * r.n_symbols <= r.n_words else -1 if 10 * r.n_symbols > r.n_words else 0)
    ballots = [r.votes for r in voted if not r.base_failed]
    good, on_good, on_bad = 0.8, [0.9] * n, [0.5] * n

    def odds(ballot):
        total = math.log(good / (1 - good))
        for v, a, b in zip(ballot, on_good, on_bad, strict=True):
            total += math.log(a / (1 - b)) if v == 1 else math.log((1 - a) / b) if v == -1 else 0
        return total

    for _ in range(rules.ROUNDS):
        p = [1 / (1 + math.exp(-odds(b))) for b in ballots]
        new_good, new_bad = [], []
        for j in range(n):
            right = sum(x for x, b in zip(p, ballots, strict=True) if b[j] == 1)
            wrong = sum(x for x, b in zip(p, ballots, strict=True) if b[j] == -1)
            new_good.append((right + 9) / (right + wrong + 10))
            right = sum(1 - x for x, b in zip(p, ballots, strict=True) if b[j] == -1)
            wrong = sum(1 - x for x, b in zip(p, ballots, strict=True) if b[j] == 1)
            new_bad.append((right + 5) / (right + wrong + 10))
        good, on_good, on_bad = (sum(p) + 8) / (len(p) + 10), new_good, new_bad
    want = Counter((r.doc_id, r.n_words, not r.base_failed and odds(r.votes) >= 0) for r in voted)
    got = rules.judged(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.kept) for r in got) == want and len(got) == len(rows)
    assert all(0 <= r.quality <= 1 for r in got)
    kept = {r.doc_id for r in got if r.kept}
    assert not kept & set(range(80, 92)) and not kept & set(range(98, 104))  # symbols after each word, capitals
    clean = [i for i in range(80) if base(rows[i][1])[0] >= 50]
    assert len(kept & set(clean)) >= 0.97 * len(clean)


def test_no_documents(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert rules.judged(none).count() == 0
    only = rules.judged(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.n_words, r.base_failed, r.kept) for r in only] == [(1, 0, True, False)]


def test_rules_run_without_python(spark, docs):
    plan = rules.with_votes(rules.statistics(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan and "Exchange hash" not in plan
