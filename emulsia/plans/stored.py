"""What outlives a run: the keyed store, the watched folder, containers as a data source, and files with gain maps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emulsia.functions import exif, jpeg, pixels, restore
from emulsia.functions import pixels as P
from emulsia.operators import reports
from emulsia.session import shared_folder
from emulsia.sources import container, container_source, ledger
from emulsia.streaming.inbox import Inbox

from .measures import parts
from .media import GREY
from .registry import registrar, table

QUERIES: dict = {}
SQL: dict = {}
query = registrar(QUERIES, SQL)


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'h2' ELSE 'h1' END AS content_hash, CAST(p_size + CASE WHEN p_partkey % 3 = 0 THEN 100 ELSE 0 END AS BIGINT) AS size,
  CASE WHEN p_partkey % 5 = 0 THEN 'kept-original' WHEN p_partkey % 3 = 0 THEN 'skipped-larger' ELSE 'ok' END AS status FROM part""")
def store_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of all parts, two records of changes over it, a compaction between them, and what a read then says."""
    k = F.col("p_partkey")
    thirds = k % 3 == 0
    rows = parts(spark, sf_dir).select(
        "p_partkey", k.cast("string").alias("path"), F.lit("h1").alias("content_hash"), F.lit("f").alias("fingerprint"), F.lit("o").alias("output_path"),
        F.col("p_size").cast("long").alias("size"), F.lit(0).cast("long").alias("mtime"), F.lit("faithful").alias("mode"), F.lit("ok").alias("status"),
    )
    changed = {"content_hash": F.when(thirds, "h2").otherwise("h1"), "size": F.col("size") + F.when(thirds, 100).otherwise(0)}
    with ledger.processed(spark, shared_folder(spark, "store")) as store:
        store.record(rows)
        store.record(rows.filter(thirds).withColumns(changed | {"status": F.lit("skipped-larger")}))
        store.compact()
        store.record(rows.filter(k % 5 == 0).withColumns(changed | {"status": F.lit("kept-original")}))
        return store.read().select(F.col("path").cast("long").alias("p_partkey"), "content_hash", "size", "status")


@query("""WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), n AS (SELECT day, row_number() OVER (ORDER BY day) AS scan FROM d),
s AS (SELECT scan, user_id, max(event_id) % 3 AS size FROM events JOIN n ON CAST(ts AS DATE) = day WHERE scan <= 3 GROUP BY scan, user_id),
p AS (SELECT s.scan, s.user_id, s.size, b.size = s.size AS stable FROM s LEFT JOIN s b ON b.user_id = s.user_id AND b.scan = s.scan - 1),
t AS (SELECT *, coalesce(stable, FALSE) AS now, coalesce(lag(stable AND size = size) OVER (PARTITION BY user_id ORDER BY scan), FALSE) AND lag(size) OVER (PARTITION BY user_id ORDER BY scan) = size AND lag(scan) OVER (PARTITION BY user_id ORDER BY scan) = scan - 1 AS before FROM p)
SELECT scan, count(*) AS files, count(*) FILTER (now AND NOT before) AS taken FROM t GROUP BY scan""")
def inbox_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three days of events as three scans of a folder: the files found, and those given out once each."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.to_date("ts").alias("day"))
    days = [r["day"] for r in events.select("day").distinct().orderBy("day").limit(3).collect()]
    inbox, rows = Inbox(spark, shared_folder(spark, "inbox")), None
    for number, day in enumerate(days, 1):
        files = events.filter(F.col("day") == F.lit(day)).groupBy(F.col("user_id").cast("string").alias("path")).agg((F.max("event_id") % 3).alias("size")).withColumn("mtime", F.lit(0).cast("long"))
        now, found = inbox.cycle(files)
        taken = found.agg(F.count("*").alias("taken")).first()["taken"]
        inbox.settle(found.withColumn("verdict", F.lit("done")))
        row = now.agg(F.lit(number).cast("long").alias("scan"), F.count("*").alias("files"), F.lit(taken).cast("long").alias("taken"))
        row = spark.createDataFrame(row.collect(), row.schema)  # one row: the next cycle removes the scan behind it
        rows = row if rows is None else rows.unionByName(row)
    return rows


@query("""SELECT p_partkey, 2 AS members, p_name || '.jpg' AS filename, CAST(p_size AS INT) AS width FROM part""")
def container_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers written by the data source, and their names and manifests read back without their members."""
    folder = shared_folder(spark, "containers")
    manifest = F.to_json(F.struct(F.lit(container.VERSION).alias("version"), F.struct(F.concat("p_name", F.lit(".jpg")).alias("filename"), F.col("p_size").alias("width")).alias("original")))
    dealt = parts(spark, sf_dir).select("p_partkey", "p_name", "p_size").repartition(4 * spark.sparkContext.defaultParallelism)  # a table of few bytes is read by few tasks, and each row becomes a file
    rows = dealt.select(F.concat(F.col("p_partkey").cast("string"), F.lit(".zip")).alias("path"), manifest.alias("manifest"), F.create_map(F.lit("background.jpg"), F.col("p_name").cast("binary")).alias("members"))
    container_source.register(spark)
    rows.write.format(container_source.NAME).mode("append").save(folder)
    read = spark.read.format(container_source.NAME).schema("path string, names array<string>, manifest string").load(folder)
    original = F.from_json("manifest", container.MANIFEST)["original"]
    return read.select(F.regexp_extract("path", r"(\d+)\.zip$", 1).cast("long").alias("p_partkey"), F.size("names").alias("members"), original["filename"].alias("filename"), original["width"].alias("width"))


def _grey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", P.clipped(F.transform("embedding", lambda x: 128 + x.cast("double") * 300), 8).alias("g"))


@F.pandas_udf(T.BinaryType())
def with_gain(values: pd.Series) -> pd.Series:
    """Grey rasters of 8 by 8 blocks as JPEG files, each with its own negative as the gain map behind it."""
    xmp = b'<x xmlns:hdrgm="http://ns.adobe.com/hdr-gain-map/1.0/" hdrgm:Version="1.0"/>'
    segment = lambda marker, body: bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body
    number = lambda n, size=4: int(n).to_bytes(size, "little")

    def index(total: int, mark: int, gain: int) -> bytes:
        first = b"II" + number(42, 2) + number(8) + number(1, 2) + number(0xB002, 2) + number(7, 2) + number(32) + number(26) + number(0)
        return segment(0xE2, exif.MPF_NAME + first + number(0) + number(total) + number(0) + number(0) + number(0) + number(gain) + number(total - mark) + number(0))

    def one(v) -> bytes:
        square = np.kron(np.asarray(v, dtype=np.uint8).reshape(8, 8), np.ones((8, 8), dtype=np.uint8))
        behind = jpeg.encode(255 - square, 100)
        behind = behind[:2] + segment(0xE1, exif.XMP_NAME + xmp) + behind[2:]
        return exif.with_gain_map(jpeg.encode(square, 100), behind, lambda n: f"<x>{n}</x>", index, lambda p: segment(0xE1, exif.XMP_NAME + p.encode()))

    return pd.Series([one(v) for v in values], dtype=object)


@query(f"WITH g AS ({GREY}) SELECT vec_id, CAST(64 * list_sum(g) AS BIGINT) AS total, CAST(64 * (64 * 255 - list_sum(g)) AS BIGINT) AS gain_total, TRUE AS says_gain FROM g")
def gain_map_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JPEG files with a gain map behind them: both pictures decoded, the map found by its index and packet."""
    f = _grey(spark, sf_dir).select("vec_id", with_gain("g").alias("f")).select("vec_id", "f", exif.jpeg_metadata_udf("f").alias("m"))
    total = lambda c: F.aggregate(jpeg.jpeg_values(c), F.lit(0).cast("long"), lambda s, x: s + x)
    return f.select("vec_id", total("f").alias("total"), total("m.gain_map").alias("gain_total"), F.contains("m.gain_xmp", F.lit("hdr-gain-map")).alias("says_gain"))


@F.pandas_udf(T.DoubleType())
def seam(back: pd.Series, front: pd.Series) -> pd.Series:
    """The middle of a 3 by 3 patch from the middle of one raster, laid into another so that differences between neighbours stay."""
    cut = lambda v: np.asarray(v, dtype=float).reshape(8, 8)
    return pd.Series([float(restore.poisson(cut(b), (2, 3, 5, 6), cut(f)[3:6, 2:5])[4, 3]) for b, f in zip(back, front)])


@query(f"""WITH g AS ({GREY}) SELECT a.vec_id, round(b.g[36] + ((a.g[28] - b.g[28]) + (a.g[44] - b.g[44]) + (a.g[35] - b.g[35]) + (a.g[37] - b.g[37])) / 4.0::DOUBLE, 6) AS middle FROM g a JOIN g b ON b.vec_id = a.vec_id + 1""")
def poisson_seams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each raster with a patch of the next one: with one inner pixel the equation has a closed form."""
    g = _grey(spark, sf_dir)
    pair = g.join(g.select((F.col("vec_id") - 1).alias("vec_id"), F.col("g").alias("h")), "vec_id")
    return pair.select("vec_id", F.round(seam("g", "h"), 6).alias("middle"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def halves(values: pd.Series) -> pd.Series:
    return pd.Series([pixels.resized(np.asarray(v, dtype=float).reshape(8, 8), 4, 4).ravel().tolist() for v in values], dtype=object)


@query(f"""WITH g AS ({GREY}) SELECT vec_id, list_transform(range(16), lambda i: round((g[1 + i // 4 * 16 + i % 4 * 2] + g[2 + i // 4 * 16 + i % 4 * 2] + g[9 + i // 4 * 16 + i % 4 * 2] + g[10 + i // 4 * 16 + i % 4 * 2]) / 4.0::DOUBLE, 6)) AS small FROM g""")
def halved_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters at half their size: means of areas."""
    return _grey(spark, sf_dir).select("vec_id", F.transform(halves("g"), lambda x: F.round(x, 6)).alias("small"))


@query("""SELECT o_orderkey, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS took
FROM (SELECT o_orderkey, CAST(floor(o_totalprice / 20) AS BIGINT) AS s FROM orders)""")
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds as a clock shows them."""
    return table(spark, sf_dir, "orders").select("o_orderkey", reports.duration_text(F.col("o_totalprice") / 20).alias("took"))
