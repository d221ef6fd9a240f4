"""Texts whose sums of powers are equal are told apart; crowded regions lose no pair."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from rosterline.llm import bpe, common, minhash, substrings


def thue_morse(n):
    one = "".join("ab"[k.bit_count() % 2] for k in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_hashes_of_complementary_words_differ(n):
    a, b = (t.encode() for t in thue_morse(n))
    data = np.frombuffer(a + b, np.uint8)
    for seed in (1, 52, 71):
        x, y = common.Hashes(data, seed).of(np.array([0, n]), np.array([n, 2 * n]))
        assert x != y


def test_operators_tell_complementary_words_apart(spark):
    common.ship(spark)
    pairs = [t for n in (1024, 2048, 4096) for t in thue_morse(n)]
    docs = spark.createDataFrame(list(enumerate(pairs)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == {i: i for i in range(6)}
    whole = spark.createDataFrame([(i, " ".join([t] + [f"w{k}" for k in range(12)])) for i, t in enumerate(pairs)], "doc_id long, text string")
    assert {r.n_removed for r in substrings.first_seen(whole).collect()} == {0}
    tokenizer = bpe.load(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))
    library = bpe.Tokenizer.from_str(tokenizer)
    got = {r.doc_id: (list(r.ids), r.decoded) for r in bpe.encoded(docs, tokenizer).collect()}
    assert got == {i: (library.encode(t, add_special_tokens=False).ids, t) for i, t in enumerate(pairs)}


def test_near_copies_among_one_template(spark, monkeypatch):
    """Groups of near copies, large and small, in a family whose members are just below the threshold."""
    common.ship(spark)
    monkeypatch.setattr(minhash, "TILE", 60_000)
    monkeypatch.setattr(minhash, "COLUMNS", 512)
    rng = np.random.default_rng(77)
    word = lambda: hashlib.md5(rng.bytes(8)).hexdigest()[:7]
    template = [word() for _ in range(150)]
    texts, want = [], {}
    for size in [120, 40, 12, *[2] * 60, *[1] * 700]:
        own = [word() for _ in range(14)]
        first = len(texts)
        for _ in range(size):
            want[len(texts)] = first
            texts.append(" ".join([*template, *own, *(word() for _ in range(7))]))
    sets = [{tuple(w[k : k + 4]) for k in range(len(w) - 3)} for w in map(str.split, texts)]
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert alike(0, 1) >= 0.8 > alike(0, 120) and alike(172, 173) >= 0.8
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, shingle=4).collect()} == want
