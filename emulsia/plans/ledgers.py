"""Scans, content keys, the ledger, the detection memo and the reports built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emulsia.operators import reports
from emulsia.sources import archive, ledger

from .registry import registrar, table

QUERIES: dict = {}
SQL: dict = {}
query = registrar(QUERIES, SQL)

FILES = """files AS (SELECT doc_id, source, source || '/' || CAST(doc_id AS VARCHAR) AS path, text AS content,
  CAST(octet_length(encode(text)) AS BIGINT) AS size, CAST(doc_id % 97 AS BIGINT) AS mtime, sha256(text) AS content_hash, substr(sha256('{"q":' || CAST(doc_id % 3 AS VARCHAR) || '}'), 1, 16) AS fingerprint FROM documents)"""
LEDGER = """ledger AS (SELECT path, CASE WHEN doc_id % 10 = 1 THEN 'stale' ELSE content_hash END AS content_hash,
  CASE WHEN doc_id % 10 = 2 THEN 'stale' ELSE fingerprint END AS fingerprint, path || '.avif' AS output_path,
  CASE WHEN doc_id % 10 <> 3 THEN size END AS size, CASE WHEN doc_id % 10 = 4 THEN mtime + 1 ELSE mtime END AS mtime FROM files WHERE doc_id % 4 <> 0)"""
OUTPUTS = "outputs AS (SELECT path || '.avif' AS output_path FROM files JOIN labels USING (doc_id))"


def files_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, with a content hash and the fingerprint of their settings."""
    files = archive.with_content_hash(archive.documents_as_files(table(spark, sf_dir, "documents")))
    return files.withColumn("fingerprint", ledger.fingerprint(F.struct(F.pmod("doc_id", F.lit(3)).alias("q"))))


def ledger_of(files: DataFrame) -> DataFrame:
    """Three quarters of the files as recorded earlier, some with another hash, fingerprint or stat."""
    nth = F.pmod("doc_id", F.lit(10))
    stale = lambda n, c: F.when(nth == n, "stale").otherwise(F.col(c)).alias(c)
    return files.filter("doc_id % 4 <> 0").select(
        "path", stale(1, "content_hash"), stale(2, "fingerprint"), F.concat("path", F.lit(".avif")).alias("output_path"),
        F.when(nth != 3, F.col("size")).alias("size"), F.when(nth == 4, F.col("mtime") + 1).otherwise(F.col("mtime")).alias("mtime"),
    )


def outputs_of(spark: SparkSession, sf_dir: str, files: DataFrame) -> DataFrame:
    return files.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id").select(F.concat("path", F.lit(".avif")).alias("output_path"))


@query(f"WITH {FILES} SELECT path, size, mtime FROM files")
def scan_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.documents_as_files(table(spark, sf_dir, "documents")).select("path", "size", "mtime")


@query(f"WITH {FILES} SELECT path, content_hash FROM files")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.with_content_hash(archive.documents_as_files(table(spark, sf_dir, "documents"))).select("path", "content_hash")


@query("""SELECT p_partkey, substr(sha256('{"brand":"' || p_brand || '","codec":"avif","effort":null,"quality":' || CAST(p_size + 40 AS VARCHAR) || '}'), 1, 16) AS fingerprint FROM part""")
def settings_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = F.struct(F.col("p_brand").alias("brand"), F.lit("avif").alias("codec"), F.lit(None).cast("int").alias("effort"), (F.col("p_size") + 40).alias("quality"))
    return table(spark, sf_dir, "part").select("p_partkey", ledger.fingerprint(settings).alias("fingerprint"))


HIT = "SELECT f.path FROM files f JOIN ledger l ON f.path = l.path AND f.content_hash = l.content_hash AND f.fingerprint = l.fingerprint WHERE l.output_path IN (SELECT output_path FROM outputs)"


@query(f"WITH {FILES}, {LEDGER}, {OUTPUTS} {HIT}")
def ledger_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = files_of(spark, sf_dir)
    return ledger.hits(files, ledger_of(files), outputs_of(spark, sf_dir, files)).select("path")


@query(f"WITH {FILES}, {LEDGER}, {OUTPUTS} SELECT path, size FROM files WHERE path NOT IN ({HIT})")
def ledger_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = files_of(spark, sf_dir)
    return ledger.misses(files, ledger_of(files), outputs_of(spark, sf_dir, files)).select("path", "size")


@query(f"WITH {FILES}, {LEDGER} SELECT f.path FROM files f JOIN ledger l ON f.path = l.path AND f.size = l.size AND f.mtime = l.mtime AND f.fingerprint = l.fingerprint")
def ledger_stat_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = files_of(spark, sf_dir)
    return ledger.stat_hits(files, ledger_of(files)).select("path")


@query("""WITH base AS (SELECT user_id, max(struct_pack(ts := ts, event_id := event_id, value := value)) AS r FROM events WHERE event_id % 2 = 0 GROUP BY user_id),
ch AS (SELECT user_id, max(struct_pack(ts := ts, event_id := event_id, value := value)) AS r FROM events WHERE event_id % 2 = 1 AND event_type <> 'error' GROUP BY user_id)
SELECT user_id, r.event_id AS event_id, r.value AS value FROM ch UNION ALL SELECT user_id, r.event_id, r.value FROM base WHERE user_id NOT IN (SELECT user_id FROM ch)""")
def ledger_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", "event_type")
    empty = events.limit(0).select("user_id", "ts", "event_id", "value")
    base = ledger.upsert(empty, events.filter("event_id % 2 = 0").drop("event_type"), "user_id", ["ts", "event_id"])
    changes = events.filter("event_id % 2 = 1 AND event_type <> 'error'").drop("event_type")
    return ledger.upsert(base, changes, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "value")


@query(f"""WITH {FILES}, pairs AS (SELECT content_hash, fingerprint, min(content) AS content, min(doc_id) AS d FROM files GROUP BY content_hash, fingerprint)
SELECT content_hash, fingerprint, CASE WHEN d % 2 = 0 THEN 7 ELSE length(content) % 5 END AS boxes, d % 2 = 0 AS cached FROM pairs""")
def detection_cache_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = files_of(spark, sf_dir)
    pairs = files.groupBy("content_hash", "fingerprint").agg(F.min("doc_id").alias("d"))
    cache = pairs.filter("d % 2 = 0").select("content_hash", "fingerprint", F.lit(7).cast("long").alias("boxes"))
    return ledger.fill_cache(files, cache, lambda c: F.pmod(F.length(c), F.lit(5)).cast("long"))


RESULTS = """results AS (SELECT doc_id, source, size AS original_size, CAST(trunc(size * (60 + doc_id % 50) / 100) AS BIGINT) AS compressed_size,
  CASE doc_id % 3 WHEN 0 THEN 'faithful' WHEN 1 THEN 'aggressive' ELSE 'video' END AS mode,
  CASE WHEN doc_id % 11 = 0 THEN 'failed' WHEN doc_id % 13 = 0 THEN 'skipped' WHEN doc_id % 7 = 0 THEN 'skipped-unchanged'
    WHEN doc_id % 3 = 2 AND doc_id % 5 = 0 THEN 'would-encode' WHEN doc_id % 3 = 2 AND doc_id % 5 = 1 THEN 'kept-original'
    WHEN doc_id % 3 = 0 AND doc_id % 5 = 0 THEN 'skipped-larger' ELSE 'ok' END AS status, doc_id % 2 = 0 AS dry_run FROM files)"""


def results_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with made-up outcomes of a run."""
    d = F.col("doc_id")
    status = (
        F.when(d % 11 == 0, "failed").when(d % 13 == 0, "skipped").when(d % 7 == 0, "skipped-unchanged").when((d % 3 == 2) & (d % 5 == 0), "would-encode")
        .when((d % 3 == 2) & (d % 5 == 1), "kept-original").when((d % 3 == 0) & (d % 5 == 0), "skipped-larger").otherwise("ok")
    )
    files = table(spark, sf_dir, "documents").select("doc_id", "source", F.octet_length("text").cast("long").alias("original_size"))
    return files.select(
        "doc_id", "source", "original_size", F.expr("original_size * (60 + doc_id % 50) div 100").alias("compressed_size"),
        F.when(d % 3 == 0, "faithful").when(d % 3 == 1, "aggressive").otherwise("video").alias("mode"), status.alias("status"), (d % 2 == 0).alias("dry_run"),
    )


STATUS = """CASE WHEN status = 'failed' THEN 'failed' WHEN status = 'skipped' THEN 'skipped' WHEN status = 'skipped-unchanged' THEN 'cached'
  WHEN status = 'would-encode' THEN 'would-write' WHEN status IN ('kept-original', 'skipped-larger') THEN CASE WHEN dry_run THEN 'would-keep-original' ELSE 'kept-original' END
  ELSE CASE WHEN dry_run AND mode <> 'video' THEN 'would-write' ELSE 'written' END END"""


@query(f"""WITH {FILES}, {RESULTS}, r AS (SELECT *, {STATUS} AS row_status FROM results)
SELECT doc_id, mode, row_status, CASE WHEN row_status NOT IN ('failed', 'skipped') THEN original_size END AS original_bytes,
  CASE WHEN row_status NOT IN ('failed', 'skipped') AND status <> 'would-encode' THEN compressed_size END AS output_bytes,
  CASE WHEN row_status NOT IN ('failed', 'skipped') AND status <> 'would-encode' THEN coalesce(CAST(original_size AS DOUBLE) / nullif(compressed_size, 0), 0) END AS ratio FROM r""")
def report_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = results_of(spark, sf_dir).withColumn("row_status", reports.row_status(F.col("status"), F.col("mode"), F.col("dry_run")))
    known = ~F.col("row_status").isin("failed", "skipped")
    measured = known & (F.col("status") != "would-encode")
    return rows.select("doc_id", "mode", "row_status", F.when(known, F.col("original_size")).alias("original_bytes"), F.when(measured, F.col("compressed_size")).alias("output_bytes"), F.when(measured, reports.ratio(F.col("original_size"), F.col("compressed_size"))).alias("ratio"))


TOTALS = """SELECT {by}, count(*) FILTER (WHERE status IN ('ok', 'skipped-larger', 'kept-original', 'would-encode')) AS ok, count(*) FILTER (WHERE status = 'skipped-unchanged') AS unchanged,
  count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'skipped') AS skipped,
  CAST(coalesce(sum(original_size) FILTER (WHERE status IN ('ok', 'skipped-larger', 'kept-original')), 0) AS BIGINT) AS total_in,
  CAST(coalesce(sum(compressed_size) FILTER (WHERE status IN ('ok', 'skipped-larger', 'kept-original')), 0) AS BIGINT) AS total_out FROM results GROUP BY {by}"""
RATIO = "coalesce(CAST(total_in AS DOUBLE) / nullif(total_out, 0), 0) AS ratio"


@query(f"WITH {FILES}, {RESULTS}, t AS ({TOTALS.format(by='source, mode')}) SELECT *, {RATIO} FROM t")
def report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.totals(results_of(spark, sf_dir), ["source", "mode"])


@query(f"""WITH {FILES}, {LEDGER}, {OUTPUTS}, hit AS ({HIT}),
results AS (SELECT source, CASE WHEN path IN (SELECT path FROM hit) THEN 'skipped-unchanged' ELSE 'ok' END AS status, size AS original_size, CAST(trunc(size * 0.5) AS BIGINT) AS compressed_size FROM files),
t AS ({TOTALS.format(by='source')}) SELECT *, {RATIO} FROM t""")
def skip_unchanged_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = files_of(spark, sf_dir).withColumn("source", F.substring_index("path", "/", 1))
    flagged = ledger.with_hits(files.select("path", "content_hash", "fingerprint", "source", "size"), ledger_of(files), outputs_of(spark, sf_dir, files))
    status = F.when(F.col("hit"), "skipped-unchanged").otherwise("ok")
    results = flagged.select("source", status.alias("status"), F.col("size").alias("original_size"), F.floor(F.col("size") / 2).cast("long").alias("compressed_size"))
    return reports.totals(results, ["source"])


@query("""WITH clips AS (SELECT page_id, 'roll' || CAST(page_id % 5 AS VARCHAR) AS folder, 'img' || CAST(page_id AS VARCHAR) AS stem FROM pages)
SELECT page_id, folder, stem FROM clips c WHERE EXISTS (SELECT 1 FROM documents d WHERE 'roll' || CAST(d.doc_id % 7 AS VARCHAR) = c.folder AND 'img' || CAST(d.doc_id AS VARCHAR) = c.stem)""")
def live_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = lambda df, k, n: df.select(k, F.concat(F.lit("roll"), (F.col(k) % n).cast("string")).alias("folder"), F.concat(F.lit("img"), F.col(k).cast("string")).alias("stem"))
    return ledger.live_pairs(keyed(table(spark, sf_dir, "pages"), "page_id", 5), keyed(table(spark, sf_dir, "documents"), "doc_id", 7)).select("page_id", "folder", "stem")


@query(f"""WITH {FILES}, {LEDGER} SELECT l.path, CASE WHEN f.path IS NOT NULL THEN f.size ELSE l.size END AS size, CASE WHEN f.path IS NOT NULL THEN f.mtime ELSE l.mtime END AS mtime
FROM ledger l LEFT JOIN files f ON f.path = l.path AND f.content_hash = l.content_hash AND f.fingerprint = l.fingerprint""")
def stat_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stats of the ledger after the hits by content have refreshed theirs."""
    files = files_of(spark, sf_dir)
    return ledger.refreshed(ledger_of(files), files.select("path", "content_hash", "fingerprint", "size", "mtime")).select("path", "size", "mtime")


@query("""SELECT doc_id, '/data/' || source || '/' || CAST(doc_id AS VARCHAR) AS key FROM documents""")
def ledger_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of files that are reached by odd paths."""
    path = F.concat(F.when(F.col("doc_id") % 2 == 0, "./x/../").otherwise("/data//./"), F.col("source"), F.lit("//"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", archive.ledger_key(path, "/data").alias("key"))
