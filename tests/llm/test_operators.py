"""Each operator against a plain version of what it computes, on small rows with awkward cases."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest

from rosterline.llm import bpe, common, graph, language, minhash, packing, quality, substrings, suffixes, vectors, warc

SCHEMA = "doc_id long, text string, lang string, score double, part long"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopé"), rng.integers(2, 9)))
    passage = " ".join(word() for _ in range(70))
    texts: list[str | None] = [" ".join(word() for _ in range(rng.integers(1, 160))) for _ in range(60)]
    texts += [texts[0], texts[0], texts[1] + " more", passage + " " + texts[2], texts[3] + "\n" + passage, "", None, "one two", "One  TWO"]
    texts += ["ab " * 400, " \n\t", "aaaa" * 200, "x", " ".join([texts[4], passage, texts[5]])]
    out = [(i, t, "en" if i % 2 else "fr", 1.0, 7) for i, t in enumerate(texts)]
    return [*out, (None, texts[6], None, None, None), out[7], out[7]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    common.ship(spark)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    common.ship(spark)
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tokenizer():
    return bpe.load(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))


@pytest.fixture
def small_groups(monkeypatch):
    monkeypatch.setattr(common, "GROUP_BYTES", 2000)
    monkeypatch.setattr(common, "SLICE_BYTES", 700)
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 8000)


@pytest.mark.parametrize("many", [20_000, 1])
def test_repeated_strings_go(docs, rows, small_groups, monkeypatch, many):
    monkeypatch.setattr(suffixes, "MANY", many)
    count = Counter(b[i : i + 200] for _, t, *_ in rows for b in [(t or "").encode()] for i in range(len(b) - 199))
    want = Counter()
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        want[i, len(b), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), bytes(np.frombuffer(b, np.uint8)[~gone])] += 1
    got = Counter((r.doc_id, r.n_bytes, len(r.spans), bytes(r.kept)) for r in suffixes.repeats_removed(docs).collect())
    assert got == want


def test_repeated_windows_go(docs, rows, small_groups):
    first: dict[tuple, float] = {}
    number = lambda i: np.inf if i is None else i
    for i, t, *_ in rows:
        w = (t or "").split()
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, np.inf), number(i))
    want = Counter()
    for i, t, *_ in rows:
        w = (t or "").split()
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < number(i) for j in range(13)}
        want[i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.first_seen(docs).collect()) == want


def test_minhash_components(docs, rows):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set()

    named = {i: shingles(t) for i, t, *_ in rows if i is not None}
    label = {i: i for i in named}
    for _ in named:
        for a in named:
            for b in named:
                if named[a] and named[b] and 100 * len(named[a] & named[b]) >= 80 * len(named[a] | named[b]):
                    label[a] = label[b] = min(label[a], label[b])
    got = [r for r in minhash.near_duplicates(docs, shingle=4).collect()]
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == {
        i: (len(s), label[i], label[i] == i) for i, s in named.items()
    }


def test_minhash_template_family(spark):
    """Texts that share a long template are below the threshold as a whole; the pairs among them are found all the same."""
    common.ship(spark)
    rng = np.random.default_rng(51)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 8))
    template = [word() for _ in range(140)]
    texts = []
    for _ in range(500):
        own = [word() for _ in range(10)]
        texts += [" ".join([*template, *own, *(word() for _ in range(16))]) for _ in range(2)]
    sets = [{tuple(w[k : k + 4]) for k in range(len(w) - 3)} for w in map(str.split, texts)]
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert all(alike(i, i + 1) >= 0.8 > alike(i, i + 2) for i in range(0, 998, 2))
    got = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shingle=4).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i - i % 2 for i in range(1000)}


def test_stages_keep_null_and_repeated_ids(spark):
    """Documents with null ids, or an id that others have too, go only as duplicates."""
    common.ship(spark)
    rng = np.random.default_rng(6)
    a, b, c, d, e, f = (" ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(40)) for _ in range(6))
    # A unique null id; a group of null ids only, near and equal; a null id beside a number; one id with two texts, one
    # of them a duplicate of a smaller id; wordless rows.
    table = [(None, a), (None, b), (None, b), (None, b + " more"), (None, c), (4, c + " more"), (5, d), (5, e), (3, e + " more"), (7, f), (8, f), (None, ""), (None, ""), (9, " ")]
    docs = spark.createDataFrame([(i, t, "en", len(t)) for i, t in table], "doc_id long, text string, lang string, n_chars long").repartition(3)
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.minhash_dedup(spark, docs, "").collect())
    group = [x for x in got if x in ((None, b), (None, b + " more"))]
    assert len(group) == 1 and got == Counter([(None, a), group[0], (4, c + " more"), (5, d), (3, e + " more"), (7, f), (None, ""), (None, ""), (9, " ")])
    linked = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame([(None, c), (4, c + " more"), (3, c + " most")], "doc_id long, text string")).collect()}
    assert linked == {(None, 3), (4, 3), (3, 3)}
    short = spark.createDataFrame([(None, a[:150], 0), (None, b[:150], 0), (5, c[:150], 0), (5, d[:150], 0), (6, e, 0), (6, f, 0), (None, e, 0)], "doc_id long, text string, n_chars long")
    left = Counter((r.doc_id, r.text, r.n_chars) for r in corpus_pipeline.suffix_dedup(spark, short, "").collect())
    assert left == Counter([(None, a[:150], 150), (None, b[:150], 150), (5, c[:150], 150), (5, d[:150], 150), (6, f, len(f))])


def test_encoding_and_decoding(docs, rows, small_groups, tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "ONE_IN", 8)
    library = bpe.Tokenizer.from_str(tokenizer)
    got = Counter((r.doc_id, tuple(r.ids), r.decoded) for r in bpe.encoded(docs, tokenizer).collect())
    assert got == Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids), t or "") for i, t, *_ in rows)
    codec = bpe.Codec.of(tokenizer)
    rng = np.random.default_rng(5)
    for _ in range(300):
        t = "".join(rng.choice([chr(rng.integers(0, 0x250)), " ", "a", "\n", "'s", "9", "語", "<|endoftext|>"], p=[0.3, 0.2, 0.2, 0.1, 0.05, 0.05, 0.05, 0.05]) for _ in range(40))
        assert codec.encode(t.encode()) == library.encode(t, add_special_tokens=False).ids


def test_packing(docs, rows, tokenizer):
    got = packing.packed(common.stored(packing.pieces(docs, tokenizer, size=64), "test"), size=64).toPandas()
    codec = bpe.Codec.of(tokenizer)
    want = Counter()
    for i, t, *_ in rows:
        ids = np.array([*codec.encode((t or "").encode()), 0], "<u4")
        for k in range(0, len(ids), 64):
            want[-1 if i is None else i, k, min(64, len(ids) - k), zlib.crc32(ids[k : k + 64].tobytes())] += 1
    assert Counter(zip(got.doc_id.fillna(-1), got.start, got.length, got.ids_crc32, strict=True)) == want
    placed = got.sort_values(["sequence_id", "offset"])
    before = placed.groupby("sequence_id").length.cumsum() - placed.length
    assert (before == placed.offset).all() and placed.groupby("sequence_id").length.sum().max() <= 64


def test_embedding_links_and_neighbours(spark, monkeypatch):
    common.ship(spark)
    monkeypatch.setattr(vectors, "TILE", 40)
    monkeypatch.setattr(vectors, "TREE", 50)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((150, 12))
    x[100:140] = x[:40] + 0.2 * rng.standard_normal((40, 12))
    x[140] = x[0]
    x[141] = 2 * x[1]
    table = [(i, v.tolist()) for i, v in enumerate(x)] + [(150, None), (151, [0.0] * 12), (152, [float("nan")] * 12), (153, [1.0, None] * 6), (154, [1e200] * 12)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    y = np.vstack([x, np.ones((1, 12))])
    ids = np.append(np.arange(150), 154)
    unit = y / np.linalg.norm(y, axis=1, keepdims=True)
    cosine = unit @ unit.T
    link = (cosine >= 0.9) & ~np.eye(len(y), dtype=bool)
    label = ids.copy()
    for _ in ids:
        for a, b in np.argwhere(link):
            label[a] = label[b] = min(label[a], label[b])
    want = {int(i): (int(n), int(c)) for i, n, c in zip(ids, link.sum(axis=1), label, strict=True)} | {i: (0, i) for i in range(150, 154)}
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(df).collect()}
    assert got == want
    found = vectors.nearest(df, df.filter("vec_id % 10 = 0")).collect()
    hits = 0
    for q in range(0, 150, 10):
        order = sorted((i for i in range(len(ids)) if i != q), key=lambda i: (-cosine[q, i], ids[i]))[:5]
        hits += len({int(ids[i]) for i in order} & {r.vec_id for r in found if r.query_id == q})
    assert hits >= 0.9 * 75 and len(found) == 75


def test_neighbours_among_copies(spark):
    """A query with hundreds of copies gets those with the smallest ids, whichever way its cosine of 1 is rounded."""
    common.ship(spark)
    rng = np.random.default_rng(8)
    x = rng.standard_normal((2000, 64))
    groups = [sorted(g.tolist()) for g in rng.permutation(2000)[:1800].reshape(6, 300)]
    for g in groups:
        x[g] = x[g[0]]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = {q: g for g in groups for q in g[::100]}
    found = vectors.nearest(df, df.filter(df.vec_id.isin(list(asked)))).collect()
    got = {q: [r.vec_id for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q] for q in asked}
    assert got == {q: [i for i in g if i != q][:5] for q, g in asked.items()}


def test_archives(spark):
    common.ship(spark)
    body = "<p>" + "é\r\n\r\nWARC/1.0\r\n" * 20
    table = [(3, "u", body), (1, "v\r\nX: y", body), (2, None, body), (4, "w", "short"), (5, "w", "short"), (6, "z", None), (None, "n", "other" * 40)]
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archived(spark.createDataFrame(table, "page_id long, url string, html string")).collect()}
    digest = lambda t: (len((t or "").encode()), hashlib.sha256((t or "").encode()).hexdigest())
    want = {i: (*digest(h), "revisit" if i in (2, 3) else "response", 1 if i in (2, 3) else None) for i, _, h in table}
    assert got == want


def test_language_and_quality(docs, rows, spark):
    model = language.train(docs, common.remainder("doc_id", 5) != 0)
    got = language.identify(docs, model).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got if not any(c.isalpha() for c in r.text or "")} == {language.UNKNOWN}
    assert all(0 <= r.score <= 1 for r in got) and model.languages == ["en", "fr"]
    labelled = docs.selectExpr("text", "CAST(length(text) > 300 AS INT) AS quality")
    scored = quality.score(docs, quality.train(labelled)).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in scored)
    assert quality.score(docs, quality.train(labelled.filter("false"))).first().score == 0.5


def test_empty_tables(empty, spark, tokenizer):
    assert suffixes.repeats_removed(empty).count() == 0
    assert substrings.first_seen(empty).count() == 0
    assert minhash.near_duplicates(empty).count() == 0
    assert bpe.encoded(empty, tokenizer).count() == 0
    assert packing.packed(common.stored(packing.pieces(empty, tokenizer), "test")).count() == 0
    assert language.identify(empty, language.train(empty, common.remainder("doc_id", 5) != 0)).count() == 0
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.near_duplicates(none).count() == 0 and vectors.nearest(none, none).count() == 0
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_components(spark):
    common.ship(spark)
    edges = [(i, i + 1) for i in range(10, 60)] + [(5, 60), (100, 101), (102, 101), (7, 7)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 5 for i in [5, *range(10, 61)]} | {100: 100, 101: 100, 102: 100}


def test_stages_carry_any_columns(spark, monkeypatch):
    """Columns named like an operator's results, or as the stages' own, and maps pass through the stages unchanged."""
    common.ship(spark)
    rng = np.random.default_rng(9)
    word = lambda letters: "".join(rng.choice(list(letters), rng.integers(3, 8)))
    kinds = {"en": "thonerisa", "fr": "éèlauxpie", "de": "chungßöäk"}
    texts = [(lang, " ".join(word(letters) for _ in range(90)) + ".") for lang, letters in kinds.items() for _ in range(40)]
    texts.append(("en", " ".join(t for _, t in (texts[0], texts[50], texts[100]))))  # clean, in three languages
    fields = "doc_id long, text string, lang string, n_chars long, score double, lang_pred string, predicted int, _row string, _text int, row int, m map<string,int>"
    table = [(i, t, lang, len(t), 77.0, "x", 5, "r", i, 3, {"b": 1, "a": i}) for i, (lang, t) in enumerate(texts)]
    docs = spark.createDataFrame(table, fields).repartition(3)
    found = corpus_pipeline.language_id(spark, docs, "")
    assert found.columns == docs.columns
    rows = {r.doc_id: r for r in found.collect()}
    assert set(rows) == set(range(121)) and all((r.score, r.lang_pred, r.m["a"]) == (77.0, "x", r.doc_id) for r in rows.values())
    labels = spark.createDataFrame([(i, i % 10 != 0) for i in range(120)], "doc_id long, good boolean").selectExpr("doc_id", "int(good) AS quality")
    monkeypatch.setattr(common, "table", lambda *_: labels)
    kept = corpus_pipeline.quality_classifier(spark, docs, "")
    assert kept.columns == docs.columns and all((r.score, r.predicted) == (77.0, 5) for r in kept.collect())
    once = corpus_pipeline.minhash_dedup(spark, docs.unionByName(docs.limit(3)), "")
    assert once.columns == docs.columns and {r.doc_id for r in once.collect()} == set(range(121))
    short = docs.filter("doc_id < 120")
    left = corpus_pipeline.suffix_dedup(spark, short, "").collect()
    assert {(r.doc_id, r.text, r._row, r._text) for r in left} == {(i, t, "r", i) for i, (_, t) in enumerate(texts[:120])}
