"""Registered queries of the training-data operators, and the SQL that checks them."""

from __future__ import annotations

from secrets import token_hex

from pyspark.sql import DataFrame, SparkSession

from . import bpe, cotraining, decontaminate, merkle, mixing, negatives, packing, quality_rules, secrets, simhash, substrings, surrogates, warc

#: Surrogates under a known key can be reversed by trying names, so none is written here.
SURROGATE_KEY = "spark.emulsia.surrogates.key"
QUERIES: dict = {}
SQL: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judge(docs).drop("text", "rejected_by")


SQL["op9_quality_rules"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
),
rep AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS n FROM wins) WHERE n > 1),
cov AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n FROM rep GROUP BY doc_id),
c AS (
  SELECT d.doc_id, t, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN cov USING (doc_id)
),
f AS (
  SELECT *, CAST(len(ln) - len(list_distinct(ln)) AS BIGINT) AS n_dup_lines, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 20 * n_words OR 2 * n_dup_lines > len(ln)
    OR 2 * len(regexp_extract_all(t, '!')) > n_words OR word_chars > 16 * n_words OR 5 * len(regexp_extract_all(t, '[0-9]')) > 2 * word_chars) AS kept
FROM f
"""


@query
def op3_vector_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), shards=8)


@query
def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL["op6_decontaminate"] = r"""
WITH low AS (SELECT *, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
),
g AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM g),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hits AS (SELECT dw.doc_id, dw.i, dw.k, g.item_id FROM dw JOIN g ON dw.k = g.k AND dw.s = g.s),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items.s, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(table(spark, sf_dir, "documents"))


SQL["op2_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
late AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY s) AS m FROM win) WHERE m < doc_id),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM late) GROUP BY doc_id),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (
  SELECT word.doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word
  LEFT JOIN (SELECT doc_id, unnest(ps) AS p FROM gone) g USING (doc_id, p) WHERE g.p IS NULL GROUP BY word.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@query
def op10_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


SQL["op10_warc_bundles"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
k AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY t) ELSE page_id END AS keeper FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(t) AS payload_digest, CASE WHEN keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM k
"""


@query
def op4_randomness_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


@query
def op7_surrogate_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key comes from spark.emulsia.surrogates.key; without one, a session draws its own and keeps it."""
    if not spark.conf.get(SURROGATE_KEY, ""):
        spark.conf.set(SURROGATE_KEY, token_hex(32))
    return surrogates.report(table(spark, sf_dir, "documents"), key=spark.conf.get(SURROGATE_KEY))


@query
def op5_co_training_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.report(table(spark, sf_dir, "embeddings"))


SQL["op11_hard_negatives"] = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.anchor_id, positive_id, positive_score, id AS negative_id, score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.report(table(spark, sf_dir, "documents"))


def _merkle_sql(levels: int = 7) -> str:
    """The levels written out, own trees first, then the tree of the subroots: enough for 8 to the power of `levels` rows a group."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR) END"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bit = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    byte = f"list_reduce(list_prepend(xor(crc, b), range(8)), lambda c, k: {bit})"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda crc, b: {byte}), 4294967295)"
    up = lambda a, b: f"{b} AS (SELECT tree, i // 8 AS i, (any_value(n) + 7) // 8 AS n, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {a} WHERE n > 1 GROUP BY tree, i // 8)"
    steps = 2 * levels
    ctes = [
        f"d AS (SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf(low)} ELSE {leaf('text')} END AS other FROM documents)",
        "r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM d)",
        "l0 AS (SELECT tree, i, n, leaf AS h FROM r)",
        *[up(f"l{k}", f"l{k + 1}") for k in range(levels)],
        "sub AS (" + " UNION ALL ".join(f"SELECT tree, h FROM l{k} WHERE n = 1" for k in range(levels + 1)) + ")",
        f"l{levels + 1} AS (SELECT -1 AS tree, tree AS i, (SELECT count(*) FROM sub) AS n, h FROM sub)",
        *[up(f"l{k}", f"l{k + 1}") for k in range(levels + 1, steps + 1)],
        "root AS (" + " UNION ALL ".join(f"SELECT h FROM l{k} WHERE n = 1" for k in range(levels + 1, steps + 2)) + ")",
        "nodes AS (" + " UNION ALL ".join(f"SELECT {k} AS step, * FROM l{k} WHERE n > 1" for k in range(steps + 1)) + ")",
    ]
    place = lambda k: (f"(r.i // {8**k})", "r.tree") if k <= levels else (f"(r.tree // {8 ** (k - levels - 1)})", "-1")
    ctes.append("sib AS (" + " UNION ALL ".join(
        f"SELECT r.tree, r.i, step, x.i AS pos, h, x.i < {place(k)[0]} AS before FROM r JOIN nodes x ON step = {k} AND x.tree = {place(k)[1]} AND x.i // 8 = {place(k)[0]} // 8 AND x.i <> {place(k)[0]}"
        for k in range(steps + 1)) + ")")
    ctes.append("side AS (SELECT tree, i, step, coalesce(string_agg(h, '' ORDER BY pos) FILTER (before), '') AS a, coalesce(string_agg(h, '' ORDER BY pos) FILTER (NOT before), '') AS b FROM sib GROUP BY ALL)".replace("GROUP BY ALL", "GROUP BY tree, i, step"))
    ctes.append("proof AS (SELECT tree, i, string_agg(h, '' ORDER BY step, pos) AS p FROM sib GROUP BY tree, i)")
    ctes.append("f0 AS (SELECT *, other AS h FROM r)")
    for k in range(steps + 1):
        nodes = f"(r.n + {8**k - 1}) // {8**k}" if k <= levels else f"((SELECT count(*) FROM sub) + {8 ** (k - levels - 1) - 1}) // {8 ** (k - levels - 1)}"
        ctes.append(f"f{k + 1} AS (SELECT r.* EXCLUDE (h), CASE WHEN {nodes} > 1 THEN sha256(coalesce(a, '') || r.h || coalesce(b, '')) ELSE r.h END AS h FROM f{k} r LEFT JOIN side ON side.tree = r.tree AND side.i = r.i AND side.step = {k})")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, leaf, sub.h AS subroot, (SELECT h FROM root) AS root, sha256(coalesce(p, '')) AS proof_sha256, f.h AS folded_root, f.h = (SELECT h FROM root) AS verified
FROM f{steps + 1} f JOIN sub USING (tree) LEFT JOIN proof ON proof.tree = f.tree AND proof.i = f.i
"""


SQL["op12_merkle_manifest"] = _merkle_sql()


@query
def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.report(table(spark, sf_dir, "documents"))
