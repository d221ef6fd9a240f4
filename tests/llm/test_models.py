"""Quality and language against plain versions in loops, and held-out results on the given tables."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterline.llm import common, language, quality, queries

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
TEXTS = [
    "", " \n\t", "One two TWO two\nline two\n\nline two\nlast.", "été à Zürich, 42 % of 7!", "A" * 300, "word " * 50 + "\n" + "word " * 50,
    "#### $$$$ ||||", "The quick brown fox jumps.\nThe quick brown fox jumps.\n", "x", "MIXED Case Words; here, there - and 3rd.", None,
]


def logit(part, whole):
    return math.log((part + 0.5) / (max(whole - part, 0) + 0.5)) - math.log1p(1 / (whole + 1))


def plain_statistics(text):
    b = (text or "").encode()
    words = WORDS.findall(b)
    n, sizes, counts = len(words), [len(w) for w in words], Counter(words)
    lines = [x for x in b.split(b"\n") if x]
    mean = sum(sizes) / max(n, 1)
    spread = math.sqrt(max(sum(s * s for s in sizes) / max(n, 1) - mean**2, 0))
    upper, lower, digit = (lambda w: sum(65 <= c <= 90 for c in w)), (lambda w: sum(97 <= c <= 122 for c in w)), (lambda w: sum(48 <= c <= 57 for c in w))
    wide, space = (lambda w: sum(c >= 128 for c in w)), (lambda w: sum(c == 32 or 9 <= c <= 13 for c in w))
    symbol = lambda w: sum(33 <= c < 127 for c in w) - upper(w) - lower(w) - digit(w)
    letters = lambda w: upper(w) + lower(w) + wide(w)
    return [
        math.log1p(len(b)), *(logit(f(b), len(b)) for f in (upper, digit, symbol, space, wide)),
        math.log1p(mean), math.log1p(spread), logit(len(counts), n), logit(sum(x == y for x, y in zip(words, words[1:])), n),
        logit(max(counts.values(), default=0), n), logit(sum(letters(w) == 0 for w in words), n), logit(sum(symbol(w[-1:]) for w in words), n),
        math.log1p(len(b) / max(len(lines), 1)), logit(len(lines) - len(set(lines)), len(lines)), logit(sum(s < 3 for s in sizes), n),
        logit(sum(upper(w) * 2 > letters(w) for w in words), n),
    ]


def test_statistics_equal_a_plain_count(spark):
    common.ship(spark)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(2)
    got = {r.doc_id: r.statistics for r in quality.with_features(docs).collect()}
    for i, text in enumerate(TEXTS):
        np.testing.assert_allclose(got[i], plain_statistics(text), atol=1e-9, err_msg=f"text {i}")


def plain_scores(x, y, asked):
    """Log densities by solve and slogdet of covariances that np.cov gives."""
    centre, scale = x.mean(axis=0), np.sqrt(np.maximum(x.var(axis=0), 1e-6))
    z = (x - centre) / scale
    spreads = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    pooled = sum(s * (y == k).mean() for k, s in enumerate(spreads))
    log_density = []
    for k in (0, 1):
        c = (1 - quality.POOLED) * spreads[k] + quality.POOLED * pooled
        c = (1 - quality.IDENTITY) * c + quality.IDENTITY * max(np.trace(c) / len(c), 1e-6) * np.eye(len(c))
        d = (asked - centre) / scale - z[y == k].mean(axis=0)
        log_density.append(np.log((y == k).mean()) - 0.5 * np.einsum("ij,ij->i", d, np.linalg.solve(c, d.T).T) - 0.5 * np.linalg.slogdet(c)[1])
    return 1 / (1 + np.exp(-np.clip(log_density[1] - log_density[0], -500, 500)))


def area(good, bad):
    return np.mean([(g > bad).mean() + 0.5 * (g == bad).mean() for g in good])


def test_quality_equals_plain_densities(spark):
    """All documents of a given table; scores from statistics that loops computed, by solve and slogdet."""
    rows = common.table(spark, SMALL, "documents").select("doc_id", "text", (common.remainder("doc_id", 4) == 2).alias("out")).collect()
    labels = {r.doc_id: r.quality for r in common.table(spark, SMALL, "labels").collect() if r.quality in (0, 1)}
    x = {r.doc_id: plain_statistics(r.text) for r in rows}
    learnt = [r.doc_id for r in rows if not r.out and r.doc_id in labels]
    want = plain_scores(np.array([x[i] for i in learnt]), np.array([labels[i] for i in learnt]), np.array([x[r.doc_id] for r in rows]))
    got = {r.doc_id: r for r in queries.op7_quality(spark, SMALL).collect()}
    assert len(got) == len(rows)
    np.testing.assert_allclose([got[r.doc_id].score for r in rows], want, atol=1e-6)
    assert all(r.out == got[r.doc_id].held_out and got[r.doc_id].predicted == (got[r.doc_id].score >= 0.7) for r in rows)


def test_held_out_quality(spark):
    labels = common.table(spark, SF, "labels").select("doc_id", "quality")
    held = queries.op7_quality(spark, SF).filter("held_out").join(labels, "doc_id").collect()
    scores = [np.array([r.score for r in held if r.quality == k]) for k in (0, 1)]
    assert min(map(len, scores)) > 10 and area(scores[1], scores[0]) >= 0.99


def test_quality_of_odd_labels(spark):
    """Labels besides 0 and 1 don't count, an empty table and one class alone give a constant score."""
    common.ship(spark)
    docs = spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(TEXTS)], "doc_id long, text string, quality long")
    odd = docs.unionByName(docs.withColumn("quality", F.lit(7))).unionByName(docs.withColumn("quality", F.lit(None).cast("long")))
    one, two = quality.train(docs), quality.train(odd)
    np.testing.assert_allclose(one.centre, two.centre)
    assert {r.score for r in quality.score(docs, quality.train(docs.filter("quality = 1"))).collect()} == {1.0}
    assert {r.score for r in quality.score(docs, quality.train(docs.filter("false"))).collect()} == {0.5}
    assert quality.score(docs.filter("false"), one).count() == 0


def plain_grams(text):
    b = [32, *(text or "").lower().encode(), 32]
    b = [32 if c < 128 and not chr(c).isalpha() else c for c in b]
    codes = ((b[i - 1] << 16) | (b[i] << 8) | b[i + 1] for i in range(1, len(b) - 1) if b[i] != 32)
    return Counter(((c * 0x9E3779B1) % 2**32) >> 19 for c in codes)


def plain_model(rows):
    totals = {}
    for lang, text in rows:
        totals.setdefault(lang, Counter()).update(plain_grams(text))
    names = sorted(totals)
    sizes = {name: sum(totals[name].values()) + language.SMOOTHING * language.BUCKETS for name in names}
    return names, {name: lambda g, name=name: (totals[name][g] + language.SMOOTHING) / sizes[name] for name in names}


def plain_em(names, p, grams):
    total = sum(grams.values())
    table = [(n, [p[name](g) for name in names]) for g, n in grams.items()]
    w = [1 / len(names)] * len(names)
    for _ in range(language.STEPS):
        new = [0.0] * len(names)
        for n, row in table:
            joint = sum(a * b for a, b in zip(w, row))
            for j, v in enumerate(row):
                new[j] += n * w[j] * v / joint / total
        w = new
    return w, sum(n * math.log(sum(a * b for a, b in zip(w, row))) for n, row in table)


def plain_language(names, p, text):
    grams = plain_grams(text)
    if not grams or not any(c.isalpha() for c in text or ""):
        return language.UNKNOWN, 0.0
    w, _ = plain_em(names, p, grams)
    order = sorted(range(len(names)), key=lambda j: (-w[j], j))
    chosen, shares, best = [names[order[0]]], [1.0], plain_em([names[order[0]]], p, grams)[1]
    for k in range(2, len(order) + 1):
        if w[order[k - 1]] < language.LEAST:
            break
        some = [names[j] for j in order[:k]]
        found, value = plain_em(some, p, grams)
        if value - best <= language.PENALTY * 0.5 * math.log(sum(grams.values()) + 1):
            break
        chosen, shares, best = some, found, value
    share, name = min((-s, c) for s, c in zip(shares, chosen))
    return name, min(1.0, -share)


MIXED = "the house and the garden of the people with many words that they have " * 6 + "\n" + "la maison et le jardin des gens avec beaucoup de mots qui sont dans les livres " * 6


def test_languages_equal_plain_mixtures(spark):
    common.ship(spark)
    rows = [(r.doc_id, r.text, r.lang) for r in common.table(spark, SMALL, "documents").filter("doc_id < 15 AND length(text) < 5000").select("doc_id", "text", "lang").collect()]
    rows += [(-1, None, "en"), (-2, "", "fr"), (-3, "12 + 30", None), (-4, MIXED, None), (-5, "é", None), (-6, "ab", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    names, p = plain_model([(lang, text) for _, text, lang in rows if lang is not None and text is not None])
    model = language.train(docs, F.lit(True))
    assert model.languages == names
    for r in language.identify(docs, model).collect():
        name, score = plain_language(names, p, r.text)
        assert r.lang_pred == name, r.doc_id
        assert r.score == pytest.approx(score, abs=1e-6), r.doc_id


def test_ties_go_to_the_first_language(spark):
    common.ship(spark)
    docs = spark.createDataFrame([(1, "same words", "b"), (2, "same words", "a")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.identify(docs, language.train(docs, F.lit(True))).collect()} == {"a"}


def test_held_out_languages(spark):
    known = {r.doc_id: r.lang for r in common.table(spark, SF, "documents").filter("lang IS NOT NULL").collect()}
    held = [r for r in queries.op10_language(spark, SF).collect() if r.held_out and r.doc_id in known and r.lang_pred != language.UNKNOWN]
    assert len(held) > 100 and np.mean([known[r.doc_id] == r.lang_pred for r in held]) >= 0.98


def test_rows_without_id_spread_over_groups(spark, monkeypatch):
    """Groups are told by id and text, so null or repeated ids don't fill one of them."""
    monkeypatch.setattr(common, "GROUP_BYTES", 500)
    for name in ("CAST(NULL AS BIGINT)", "7L"):
        docs = spark.range(200).selectExpr(f"{name} AS doc_id", "concat('text number ', id, ' has words') AS text")
        packed, groups = common.grouped(docs, "text", "doc_id")
        assert groups > 5 and packed.select("part").distinct().count() > 5
