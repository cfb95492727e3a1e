"""Comparisons of runs, settings in layers, running totals, and the watched inbox."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emulsia.operators import reports
from emulsia.streaming import watch

from .registry import registrar, table

#: The SQL of a size in units.
SIZE = "(CASE WHEN {n} < 1024 THEN printf('%.1f B', CAST({n} AS DOUBLE)) WHEN {n} < 1048576 THEN printf('%.1f KB', {n} / 1024.0::DOUBLE) WHEN {n} < 1073741824 THEN printf('%.1f MB', {n} / 1048576.0::DOUBLE) ELSE printf('%.1f GB', {n} / 1073741824.0::DOUBLE) END)"

QUERIES: dict = {}
SQL: dict = {}
query = registrar(QUERIES, SQL)



def run_rows(spark: SparkSession, sf_dir: str, new: bool) -> DataFrame:
    """Measured rows of one of two runs, by user and kind of event."""
    e = table(spark, sf_dir, "events").filter("event_id % 2 = 1" if new else "event_id % 2 = 0")
    return e.groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("ratio"), F.max(F.when(F.col("event_id") % 3 == 0, F.col("value"))).alias("ssim"))


@query("""WITH o AS (SELECT user_id, event_type, round(avg(value), 6) AS ratio, max(value) FILTER (WHERE event_id % 3 = 0) AS ssim FROM events WHERE event_id % 2 = 0 GROUP BY ALL),
n AS (SELECT user_id, event_type, round(avg(value), 6) AS ratio, max(value) FILTER (WHERE event_id % 3 = 0) AS ssim FROM events WHERE event_id % 2 = 1 GROUP BY ALL)
SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(o.event_type, n.event_type) AS event_type, CASE WHEN o.user_id IS NULL THEN 'NEW' WHEN n.user_id IS NULL THEN 'GONE' ELSE 'BOTH' END AS presence,
  round(n.ratio - o.ratio, 6) AS d_ratio, round(n.ssim - o.ssim, 6) AS d_ssim FROM o FULL JOIN n ON o.user_id = n.user_id AND o.event_type = n.event_type""")
def bench_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = reports.diff_runs(run_rows(spark, sf_dir, False), run_rows(spark, sf_dir, True), ["user_id", "event_type"], ["ratio", "ssim"])
    return d.withColumns({c: F.round(c, 6) for c in ("d_ratio", "d_ssim")})


@query("""SELECT p_partkey, m.mode, CASE m.mode WHEN 'faithful' THEN p_size * 10 ELSE p_size * 4 END AS cost FROM part, (VALUES ('faithful'), ('aggressive')) m(mode)""")
def bench_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file under each mode, by a literal array of the modes."""
    rows = table(spark, sf_dir, "part").withColumn("mode", F.explode(F.array(F.lit("faithful"), F.lit("aggressive"))))
    return rows.select("p_partkey", "mode", F.when(F.col("mode") == "faithful", F.col("p_size") * 10).otherwise(F.col("p_size") * 4).alias("cost"))


@query("""SELECT p_partkey, coalesce(CASE WHEN p_partkey % 5 = 0 THEN 55 END, CASE WHEN p_partkey % 3 = 0 THEN 66 END, CASE WHEN p_size % 2 = 0 THEN 90 END, 70) AS quality,
  coalesce(CASE WHEN p_partkey % 7 = 0 THEN 'webp' END, CASE WHEN p_size % 2 = 0 THEN 'jxl' END, 'avif') AS codec, p_partkey % 5 <> 0 AS auto_tune FROM part""")
def config_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults under a preset under a file under flags; an explicit quality turns the search off."""
    k, preset = F.col("p_partkey"), F.col("p_size") % 2 == 0
    flag = F.when(k % 5 == 0, 55)
    quality = reports.layered(flag, F.when(k % 3 == 0, 66), F.when(preset, 90), F.lit(70))
    codec = reports.layered(F.when(k % 7 == 0, "webp"), F.when(preset, "jxl"), F.lit("avif"))
    return table(spark, sf_dir, "part").select("p_partkey", quality.alias("quality"), codec.alias("codec"), flag.isNull().alias("auto_tune"))


@query("""SELECT o_orderkey, count(*) OVER w AS files, round(sum(o_totalprice) OVER w, 2) AS total_in FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)""")
def running_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running counts and sums of each customer's orders."""
    orders = table(spark, sf_dir, "orders").withColumn("one", F.lit(1).cast("long"))
    done = reports.running(orders, ["o_orderdate", "o_orderkey"], ["o_custkey"], {"files": "one", "total": "o_totalprice"})
    return done.select("o_orderkey", "files", F.round("total", 2).alias("total_in"))


@query("""SELECT p_partkey, CASE WHEN n < 1024 THEN printf('%.1f B', n) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576) ELSE printf('%.1f GB', n / 1073741824) END AS size_text
FROM (SELECT p_partkey, CAST(p_partkey * p_partkey * p_size * 8 AS DOUBLE) AS n FROM part)""")
def size_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("p_partkey") * F.col("p_partkey") * F.col("p_size") * 8).cast("long")
    return table(spark, sf_dir, "part").select("p_partkey", reports.size_text(n).alias("size_text"))


SCANS = """scans AS (SELECT user_id AS path, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS scan, CAST(least(count(*), 2) AS BIGINT) AS size, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS mtime, user_id % 3 = 0 AS fails FROM events GROUP BY ALL),
lagged AS (SELECT *, coalesce(lag(scan) OVER w = scan - 1 AND lag(size) OVER w = size AND lag(mtime) OVER w = mtime, false) AS stable FROM scans WINDOW w AS (PARTITION BY path ORDER BY scan))"""


def scans_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' days as scans of an inbox."""
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("long")
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("path"), day.alias("scan"))
    return e.agg(F.least(F.count("*"), F.lit(2)).cast("long").alias("size"), F.count_if(F.col("event_type") == "error").alias("mtime")).withColumn("fails", F.col("path") % 3 == 0)


@query(f"WITH {SCANS} SELECT path, scan, stable FROM lagged")
def watch_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.stability(scans_of(spark, sf_dir)).select("path", "scan", "stable")


BLOCKED = f"""{SCANS}, runs AS (SELECT *, sum(CASE WHEN stable THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY scan) AS run FROM lagged),
b AS (SELECT *, stable AND coalesce(max(CASE WHEN stable AND fails THEN 1 END) OVER (PARTITION BY path, run ORDER BY scan ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS held FROM runs)"""


@query(f"WITH {BLOCKED} SELECT path, scan, stable, held, stable AND NOT held AS tried FROM b")
def watch_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.blocked_runs(scans_of(spark, sf_dir)).select("path", "scan", "stable", "held", "tried")


@query(f"""WITH {BLOCKED}, c AS (SELECT scan, count(*) FILTER (WHERE stable AND NOT held) AS processed, count(*) FILTER (WHERE stable AND NOT held AND NOT fails) AS ok, count(*) FILTER (WHERE stable AND NOT held AND fails) AS failed,
  count(*) FILTER (WHERE NOT stable) AS awaiting, count(*) FILTER (WHERE held) AS held FROM b GROUP BY scan)
SELECT *, CASE WHEN processed = 0 THEN 'silent' WHEN failed > 0 THEN 'problem' ELSE 'done' END AS notice FROM c""")
def cycle_notice(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = watch.blocked_runs(scans_of(spark, sf_dir))
    c = s.groupBy("scan").agg(
        F.count_if("tried").alias("processed"), F.count_if(F.col("tried") & ~F.col("fails")).alias("ok"), F.count_if(F.col("tried") & F.col("fails")).alias("failed"),
        F.count_if(~F.col("stable")).alias("awaiting"), F.count_if("held").alias("held"),
    )
    return c.withColumn("notice", reports.notice(F.col("processed"), F.col("ok"), F.col("failed")))
