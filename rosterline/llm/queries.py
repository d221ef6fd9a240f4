"""One query per operator, over whole tables, with the SQL that checks it where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterline.llm import bpe, common, divergence, importance, language, minhash, packing, quality, rules, substrings, suffixes, vectors, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WARC archives of all pages with repeated payloads as revisits, read back."""
    return warc.archived(common.table(spark, sf_dir, "pages"))


SQL["op6_warc"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS f FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > f THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > f THEN f END AS refers_to
FROM q
"""


def language_model(docs: DataFrame) -> language.Model:
    return language.train(docs, common.remainder("doc_id", 5) != 0)


@query
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of all documents."""
    docs = common.table(spark, sf_dir, "documents")
    found = language.identify(docs.select("doc_id", "text"), language_model(docs))
    return found.select("doc_id", (common.remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.Model:
    """Fitted on the labelled documents that aren't held out; statistics first, so that no text is shuffled."""
    known = labels.select(F.col("doc_id").alias("doc_id"), F.col("quality").alias("quality"))
    statistics = quality.with_features(docs.filter(common.remainder("doc_id", 4) != 2).select("doc_id", "text"))
    return quality.fit(statistics.join(known, "doc_id"))


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of all documents."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model(docs, common.table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", (common.remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def tokenizer() -> str:
    import public_tokenizers

    return bpe.load(public_tokenizers.path("byte_bpe_50k.json"))


@query
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents and the text decoded from them, as digests."""
    return bpe.digests(common.table(spark, sf_dir, "documents"), tokenizer())


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return packing.packed(common.stored(packing.pieces(common.table(spark, sf_dir, "documents"), tokenizer()), "pieces"))


@query
def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return vectors.near_duplicates(common.table(spark, sf_dir, "embeddings"))


SQL["op1_embeddings"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0
),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(m, vec_id) AS component_id, vec_id = coalesce(m, vec_id) AS kept
FROM embeddings e LEFT JOIN counts c ON c.a = e.vec_id LEFT JOIN least l ON l.a = e.vec_id
"""


@query
def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every 50th embedding among all embeddings."""
    rows = common.table(spark, sf_dir, "embeddings")
    return vectors.nearest(rows, rows.filter("vec_id % 50 = 0"))


@query
def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that remain once windows of earlier documents are removed."""
    found = substrings.first_seen(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL["op4_substrings"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM w WHERE len(ws) >= 13),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win FROM starts),
least AS (SELECT win, min(doc_id) AS m FROM windows GROUP BY win),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM windows JOIN least USING (win), range(13) t(k) WHERE m < doc_id),
lost AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN ps IS NULL THEN array_to_string(ws, ' ')
              ELSE array_to_string(list_filter(ws, lambda x, j: NOT list_contains(ps, j)), ' ') END) AS kept_sha256
FROM w LEFT JOIN lost USING (doc_id)
"""


@query
def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents that remain once 200-byte strings that occur elsewhere are removed."""
    found = suffixes.repeats_removed(common.table(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents, on 4-word shingles."""
    return minhash.near_duplicates(common.table(spark, sf_dir, "documents"), shingle=4)


@query
def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word use of every source against the others of its language, and the terms that set it apart."""
    return divergence.divergence(common.table(spark, sf_dir, "documents"))


SQL["op11_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT i, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term),
cells AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS in_lang FROM g JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
total AS (SELECT lang, source, sum(n) AS s, sum(in_lang) AS s_lang, count(*) AS v FROM cells GROUP BY lang, source),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (s + 5 * v)::HUGEINT AS p,
        1 + (1000000000::HUGEINT * (in_lang + 5)) // (s_lang + 5 * v)::HUGEINT AS q FROM cells JOIN total USING (lang, source)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
every AS (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM every QUALIFY part = 'pair' OR rank <= 50
"""


@query
def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents drawn to be like the benchmark in their words; scores of all."""
    return importance.resampled(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


SQL["op13_importance"] = r"""
WITH bits AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) AS t FROM range(256) x(i)),
d AS (SELECT row_number() OVER () AS i, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
dw AS (SELECT i, unnest(ws) AS w FROM d),
each AS (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM b)),
bytes AS (SELECT w, hex(encode(w)) AS h FROM each),
named AS (SELECT w, xor(list_reduce(list_transform(range(1, length(h), 2), lambda k: ('0x' || substr(h, k, 2))::BIGINT),
            lambda c, y: xor(t[(xor(c, y) % 256) + 1], c // 256), 4294967295), 4294967295) % 10000 AS bucket FROM bytes, bits),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN named USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN named USING (w) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE
            / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
mean AS (SELECT i, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM dw JOIN named USING (w) JOIN gains USING (bucket) GROUP BY i),
noise AS (SELECT i, doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
            ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN mean USING (i)),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM noise),
ranked AS (SELECT i, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= n * 10 // 100 THEN r END AS rank FROM scored LEFT JOIN ranked USING (i)
"""


@query
def op12_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of all documents and the verdict of the weakly supervised rules."""
    return rules.judged(common.table(spark, sf_dir, "documents")).drop("quality")


def _rounds_sql() -> str:
    """The statistics, the votes and the rounds of expectation-maximisation in DuckDB's SQL."""
    names = list(rules.RULES)
    each = lambda form, join=", ": join.join(form.format(j=j, name=name) for j, name in enumerate(names))
    votes = ", ".join(f"CASE WHEN {good} THEN 1 WHEN {bad} THEN -1 ELSE 0 END AS v{j}" for j, (good, bad) in enumerate(rules.RULES.values()))
    odds = "ln(good / (1 - good)) + " + each(
        "CASE v{j} WHEN 1 THEN ln(a{j} / (1 - b{j})) WHEN -1 THEN ln((1 - a{j}) / b{j}) ELSE 0 END", " + "
    )
    start = rules._estimate({(j, v): (0, 0) for j in range(len(names)) for v in (-1, 1)}, 0, 0)
    first = ", ".join(f"{start.on_good[j]}::DOUBLE AS a{j}, {start.on_bad[j]}::DOUBLE AS b{j}" for j in range(len(names)))

    def share(x: str, y: str, prior: tuple[int, int]) -> str:
        total = lambda q: f"coalesce(sum({q}), 0)::DOUBLE / {rules.PARTS}"
        return f"(({total(x)} + {prior[0]}) / ({total(x)} + {total(y)} + {sum(prior)}))"

    vote = lambda part, j, v: f"CASE WHEN v{j} = {v} THEN {part} END"
    estimates = ", ".join(
        f"{share(vote('g', j, 1), vote('g', j, -1), rules.ON_GOOD)}, {share(vote('b', j, -1), vote('b', j, 1), rules.ON_BAD)}" for j in range(len(names))
    )
    return rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS i, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
windows AS (SELECT i, k, array_to_string(ws[k:k + 2], ' ') AS t FROM (SELECT i, ws, unnest(range(1, len(ws) - 1)) AS k FROM w WHERE len(ws) >= 3)),
repeats AS (SELECT i, count(DISTINCT k + x) AS n FROM (SELECT i, k, count(*) OVER (PARTITION BY i, t) AS c FROM windows), range(3) r(x) WHERE c > 1 GROUP BY i),
s AS (SELECT i, doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
  len(ls) AS n_lines, len(list_distinct(ws)) AS n_distinct, len(regexp_extract_all(text, '\p{{Lu}}')) AS n_upper, len(regexp_extract_all(text, '[!?*#$%&|<>=+~^_]{{2,}}')) AS n_marks,
  len(list_filter(ws, lambda x: regexp_matches(x, '[.?!]["'')\]]*$'))) AS n_ends,
  len(list_filter(ws, lambda x: regexp_matches(x, '^\p{{L}}[\p{{L}}\p{{M}}''-]*[,.;:!?]?$'))) AS n_bare FROM w LEFT JOIN repeats USING (i)),
v AS (SELECT *, n_words < {rules.LEAST_WORDS} OR 100 * n_repeat_words > {rules.MOST_REPEATED} * n_words AS base_failed, {votes} FROM s),
patterns AS (SELECT {each("v{j}")}, count(*) AS n FROM v WHERE NOT base_failed GROUP BY ALL),
em AS (SELECT 0 AS k, {start.good}::DOUBLE AS good, {first}
  UNION ALL
  SELECT k + 1, {share("g", "b", rules.PRIOR)}, {estimates} FROM (
    SELECT *, n * {rules.PARTS}::HUGEINT - g AS b FROM (SELECT *, n * floor({rules.PARTS} / (1 + exp(-({odds}))))::HUGEINT AS g FROM em, patterns WHERE k < {rules.ROUNDS}))
  GROUP BY k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {odds} >= 0 AS kept
FROM v, (SELECT * FROM em ORDER BY k DESC LIMIT 1)
"""


SQL["op12_rules"] = _rounds_sql()
