"""The audit of sources, the quality rules and the draw, each against a plain version in loops."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from rosterline.llm import common, divergence, importance, terms

SCHEMA = "doc_id long, text string, lang string, source string, term string, rank int, score double, n_words string, value long"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(21)
    pool = ["".join(rng.choice(list("abcdefghÉß"), rng.integers(1, 6))) for _ in range(60)]
    out = []
    for i in range(240):
        words = rng.choice(pool[: 20 + i % 40], rng.integers(0, 40))
        text = " ".join(w.upper() if rng.random() < 0.2 else w + rng.choice(["", ".", "7", "'s"]) for w in words)
        out.append((i, text, ["en", "fr", None, ""][i % 4] if i % 7 else "en", f"s{i % 11}" if i % 5 else None))
    out += [(300, None, "en", "s0"), (300, "", "xx", "only"), (301, "tie", "xx", "other"), (None, out[7][1] + " a" * 30, "fr", None), (None, "a b " * 30, None, "é")]
    out += [out[9]] * 4 + [(310, "long " * 3000 + "x" * 700, "en", "s1"), (311, "..! 12", "zz", "z")]
    return [(*r, "clash", 5, 2.0, "y", 9) for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    common.ship(spark)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("groups, width, size", [(256, 512, 1 << 21), (3, 4, 400)])
def test_divergence(docs, rows, monkeypatch, groups, width, size):
    monkeypatch.setattr(divergence, "GROUPS", groups)
    monkeypatch.setattr(divergence, "TERMS", width)
    monkeypatch.setattr(terms, "SLICE_BYTES", size)
    count, held = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))
        count[lang or "", source or ""].update(found)
        held[lang or ""].update(set(found))
    want = []
    for lang in held:
        kept = [t for t, n in held[lang].items() if n >= 30]
        sources = sorted(s for g, s in count if g == lang)
        parts = {s: {t: count[lang, s][t] for t in kept} for s in sources}
        whole = {t: sum(parts[s][t] for s in sources) for t in kept}
        p = {s: {t: 1 + 10**9 * (c + 5) // (sum(parts[s].values()) + 5 * len(kept)) for t, c in parts[s].items()} for s in sources}
        q = {t: 1 + 10**9 * (c + 5) // (sum(whole.values()) + 5 * len(kept)) for t, c in whole.items()}
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            own = sorted((q[t] - p[s][t], t.encode()) for t in kept if parts[s][t] and p[s][t] > q[t])[:50]
            want += [(lang, s, part, o.decode(), -v, k + 1) for part, found in (("pair", pairs), ("term", own)) for k, (v, o) in enumerate(found)]
    got = [tuple(r) for r in divergence.divergence(docs).collect()]
    assert sorted(got) == sorted(want) and any(r[2] == "term" for r in got) and any(r[0] == "xx" and r[4] == 0 for r in got)


def test_divergence_counts_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    n, total, kept = 10**13, 3 * 10**13, 10**6
    got = spark.range(1).select(divergence._probability(F.lit(n), F.lit(total), F.lit(kept)).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * kept)


@pytest.mark.parametrize("least, most", [(1, 1), (1, 3), (2, 2)])
def test_importance(spark, docs, rows, least, most):
    target = spark.createDataFrame([("a b c long tie", 1), (None, 2), ("é " + rows[8][1], 3)], "text string, score int")

    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in range(least, most + 1) for i in range(len(w) - n + 1)]

    everywhere, wanted = Counter(), Counter()
    for r in rows:
        everywhere.update(features(r[1])[1])
    for r in target.collect():
        wanted.update(features(r.text)[1])
    s_all, t_all = sum(everywhere.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (s_all + 10000) / ((everywhere[b] + 1) * (t_all + 10000))))
    scored = []
    for i, text, *_ in rows:
        n, f = features(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    long_enough = sorted((r for r in scored if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    drawn = len(long_enough) * 30 // 100
    want = Counter((*(r[j] for j in (0, 2, 3, 4)), k + 1 if k < drawn else None) for k, r in enumerate(long_enough))
    want += Counter((*(r[j] for j in (0, 2, 3, 4)), None) for r in scored if r[1] < 20)
    got = Counter(map(tuple, importance.resampled(docs, target, percent=30, least=least, most=most).collect()))
    assert got == want and len(rows) == sum(got.values())


def test_repeated_rows_are_drawn_one_by_one(spark):
    """A row that fills a third of the table takes as many ranks as it has copies."""
    common.ship(spark)
    table = [(None, "w " * 25)] * 500 + [(i, f"w{i % 7} " * 25) for i in range(1000)]
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    got = importance.resampled(docs, docs.limit(0), percent=50).collect()
    assert len(got) == 1500 and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 751))


def test_audit_of_empty_tables(spark):
    common.ship(spark)
    none = spark.createDataFrame([], SCHEMA)
    assert divergence.divergence(none).count() == 0 and importance.resampled(none, none).count() == 0
