"""Metadata of photos and clips, written and read back over part and events, and what a run says about itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emulsia import photos, settings, tools
from emulsia.functions import align, cascade, exif, heif, jpeg, perceptual, png, probe
from emulsia.functions import metadata as M
from emulsia.functions import pixels as P
from emulsia.operators import reports
from emulsia.sources import container, ledger

from .ledgers import FILES, RESULTS, STATUS, results_of
from .measures import PAIR, SSIM_SQL, pairs, parts
from .registry import registrar, table
from .runs import SIZE

QUERIES: dict = {}
SQL: dict = {}
query = registrar(QUERIES, SQL)


def exif_block(orientation: Column, place: Column) -> Column:
    """A small EXIF block, with a GPS directory of one position where `place`."""
    entry = lambda tag, kind, count, value: F.concat(M.le(tag, 2), M.le(kind, 2), M.le(count, 4), value)
    turned = entry(exif.ORIENTATION, 3, 1, F.concat(M.le(orientation, 2), M.le(0, 2)))
    plain = F.concat(M.le(1, 2), turned, M.le(0, 4))
    at = 8 + 2 + 2 * 12 + 4
    gps = F.concat(M.le(1, 2), entry(2, 5, 3, M.le(at + 2 + 12 + 4, 4)), M.le(0, 4), F.unhex(F.lit("2F000000010000001E000000010000000F00000001000000")))
    located = F.concat(M.le(2, 2), turned, entry(exif.GPS, 4, 1, M.le(at, 4)), M.le(0, 4), gps)
    return F.concat(F.lit("II").cast("binary"), M.le(42, 2), M.le(8, 4), F.when(place, located).otherwise(plain))


@query("""SELECT p_partkey, CAST(1 + p_partkey % 8 AS INT) AS orientation, 1 AS turned, CAST(CASE WHEN p_size % 2 = 0 THEN 80 ELSE 26 END AS INT) AS bytes FROM part""")
def exif_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orientation that a block says, and that of the block for pixels that were turned."""
    b = parts(spark, sf_dir).select("p_partkey", exif_block(1 + F.col("p_partkey") % 8, F.col("p_size") % 2 == 0).alias("b")).withColumn("u", exif.upright_udf("b"))
    return b.select("p_partkey", exif.orientation_udf("b").alias("orientation"), exif.orientation_udf("u").alias("turned"), F.octet_length("u").alias("bytes"))


@query("""SELECT p_partkey, p_size % 2 = 0 AS had_place, FALSE AS has_place, CAST(1 + p_partkey % 8 AS INT) AS orientation, TRUE AS gone FROM part""")
def exif_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks without their place: no pointer, no position in the bytes, and the rest as it was."""
    b = parts(spark, sf_dir).select("p_partkey", exif_block(1 + F.col("p_partkey") % 8, F.col("p_size") % 2 == 0).alias("b")).withColumn("w", exif.without_place_udf("b"))
    return b.select("p_partkey", exif.has_place_udf("b").alias("had_place"), exif.has_place_udf("w").alias("has_place"), exif.orientation_udf("w").alias("orientation"), (~F.contains(F.hex("w"), F.lit("2F000000010000001E"))).alias("gone"))


DETECTOR = '"detector":{"backend":"haar","confidence":0.6,"max_aspect_ratio":1.6,"min_size_ratio":0.05,"nms_iou":0.3},'


@query(f"""SELECT p_partkey, substr(sha256('{{"auto_tune":false,"crf":' || CAST(p_size AS VARCHAR) || ',' || CASE WHEN p_partkey % 2 = 0 THEN '{DETECTOR}"face_aware":true' ELSE '"face_aware":false' END ||
  ',"face_vmaf_target":95.0,"mode":"video","preserve_dolby_vision":true,"preserve_live_photos":true,"preset":6,"skip_efficient":true,"vmaf_target":93.0}}'), 1, 16) AS fingerprint FROM part""")
def clip_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of clip settings: the detector counts only where faces matter."""
    of = lambda aware: ledger.fingerprint(settings.clip_struct(settings.DEFAULTS | {"video.crf": F.col("p_size").cast("bigint"), "video.face_aware": aware}))
    return parts(spark, sf_dir).select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, of(True)).otherwise(of(False)).alias("fingerprint"))


@query("""SELECT p_partkey, CAST(640 + 8 * p_size AS BIGINT) AS width, CAST(480 + p_size AS BIGINT) AS height, round(CASE WHEN p_size % 4 = 0 THEN 25.0::DOUBLE ELSE 30000 / 1001.0::DOUBLE END, 9) AS fps,
  CASE p_size % 3 WHEN 0 THEN 'av1' WHEN 1 THEN 'hevc' ELSE 'h264' END AS codec, CAST(CASE WHEN p_size % 5 = 0 THEN 12 WHEN p_size % 2 = 0 THEN 10 ELSE 8 END AS INT) AS bit_depth,
  CAST(CASE WHEN p_size % 6 = 0 THEN 9000 ELSE 1000 * p_size END AS BIGINT) AS bit_rate, CAST(CASE WHEN p_size % 7 = 0 THEN -90 ELSE 0 END AS INT) AS rotation,
  CASE WHEN p_partkey % 4 <> 0 THEN 'aac' END AS audio_codec, CAST(CASE WHEN p_size % 9 = 0 THEN 8 END AS INT) AS dynamic_profile, CASE WHEN p_partkey % 5 = 0 THEN 'id-' || CAST(p_partkey AS VARCHAR) END AS pair_id
FROM part WHERE p_partkey % 10 <> 1""")
def clip_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts read from a prober's JSON; a file without a video stream has none."""
    n, k = F.col("p_size"), F.col("p_partkey")
    side = F.concat(
        F.when(n % 7 == 0, F.array(F.create_map(F.lit("rotation"), F.lit("-90.0")))).otherwise(F.array().cast("array<map<string,string>>")),
        F.when(n % 9 == 0, F.array(F.create_map(F.lit("dv_profile"), F.lit("8"), F.lit("rpu_present_flag"), F.lit("1")))).otherwise(F.array(F.create_map(F.lit("dv_profile"), F.lit("5"), F.lit("rpu_present_flag"), F.lit("0")))),
    )
    video = F.struct(
        F.lit("video").alias("codec_type"), F.when(n % 3 == 0, "av1").when(n % 3 == 1, "hevc").otherwise("h264").alias("codec_name"), (640 + 8 * n).alias("width"), (480 + n).alias("height"),
        F.when(n % 2 == 0, "yuv420p10le").otherwise("yuv420p").alias("pix_fmt"), F.when(n % 5 == 0, "12").otherwise("x").alias("bits_per_raw_sample"), F.when(n % 4 == 0, "0/0").otherwise("30000/1001").alias("avg_frame_rate"),
        F.lit("25/1").alias("r_frame_rate"), F.when(n % 6 != 0, (1000 * n).cast("string")).alias("bit_rate"), side.alias("side_data_list"),
    )
    audio = F.struct(F.lit("audio").alias("codec_type"), F.lit("aac").alias("codec_name"))
    streams = F.concat_ws(",", F.when(k % 4 != 0, F.to_json(audio)), F.when(k % 10 != 1, F.to_json(video)))
    tags = F.when(k % 5 == 0, F.create_map(F.lit("com.apple.QuickTime.content.identifier"), F.concat(F.lit("id-"), k.cast("string"))))
    form = F.to_json(F.struct(F.lit("1234").alias("size"), F.lit("12.5").alias("duration"), F.lit("9000").alias("bit_rate"), tags.alias("tags")))
    text = F.concat(F.lit('{"streams":['), streams, F.lit('],"format":'), form, F.lit("}"))
    found = F.filter(F.array(probe.clip_facts(text)), lambda f: f.isNotNull())  # a filter behind it would be moved before it, and read each text again
    names = ("width", "height", "codec", "bit_depth", "bit_rate", "rotation", "audio_codec", "dynamic_profile", "pair_id")
    return parts(spark, sf_dir).select("p_partkey", F.inline(found)).select("p_partkey", F.round("fps", 9).alias("fps"), *names)


@query("""WITH v AS (SELECT user_id, list(value ORDER BY value) AS v FROM events GROUP BY user_id)
SELECT user_id, round(list_avg(v), 9) AS mean, v[CAST(greatest(0, len(v) // 100 - 1) AS INT) + 1] AS p1, v[1] AS min, CAST(len(v) AS BIGINT) AS frames FROM v""")
def clip_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a clip's frames, read from a scorer's JSON and pooled; a user's events stand for the frames."""
    frame = F.struct(F.struct(F.col("value").alias("vmaf")).alias("metrics"))
    texts = table(spark, sf_dir, "events").groupBy("user_id").agg(F.to_json(F.struct(F.collect_list(frame).alias("frames"))).alias("t"))
    p = texts.select("user_id", P.pooled(probe.frame_scores(F.col("t"))).alias("p"))
    return p.select("user_id", F.round("p.mean", 9).alias("mean"), "p.p1", "p.min", "p.frames")


@query(f"""WITH s AS ({SSIM_SQL.format(digits=6)}), q AS ({PAIR}),
p AS (SELECT vec_id, round(-10 * log10(list_avg(list_transform(range(1, 65), lambda i: pow(CAST(a[i] AS DOUBLE) - b[i], 2)))), 6) AS psnr FROM q)
SELECT vec_id, p.psnr AS psnr, s.ssim AS ssim, round((4096 + vec_id) / CAST(1000 + vec_id % 300 AS DOUBLE), 6) AS ratio, CASE WHEN vec_id % 2 = 0 THEN s.ssim END AS face_ssim, CAST(NULL AS DOUBLE) AS background_ssim FROM p JOIN s USING (vec_id)""")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of pictures as rows of a report; in every second one the whole picture is a face."""
    p = pairs(spark, sf_dir).withColumn("s", P.ssim_8x8("a", "b"))
    faces = F.when(F.col("vec_id") % 2 == 0, F.struct(F.col("s").alias("inside"), F.lit(None).cast("double").alias("outside")))
    r = p.select("vec_id", reports.quality_report(F.col("a"), F.col("b"), F.col("s"), 4096 + F.col("vec_id"), 1000 + F.col("vec_id") % 300, faces).alias("r"))
    return r.select("vec_id", *[F.round(f"r.{c}", 6).alias(c) for c in ("psnr", "ssim", "ratio", "face_ssim", "background_ssim")])


@query("""SELECT p_partkey, 1 + p_size / 8.0::DOUBLE AS most, CAST(CASE WHEN p_size % 2 = 0 THEN 3 ELSE 1 END AS INT) AS channels, CASE WHEN p_size % 2 = 0 THEN p_size / 16.0::DOUBLE ELSE 0.0::DOUBLE END AS last_min, p_size % 3 = 0 AS base_is_hdr FROM part""")
def gain_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of gain maps, written to a packet and read back."""
    n = F.col("p_size")
    fixed = M.headroom_parameters(1 + n / F.lit(8.0))
    least = F.when(n % 2 == 0, F.array(F.lit(0.0), F.lit(0.5), n / F.lit(16.0))).otherwise(F.array(F.lit(0.0)))
    p = parts(spark, sf_dir).select("p_partkey", "p_size", M.gain_packet(fixed.withField("GainMapMin", least).withField("base_is_hdr", n % 3 == 0)).alias("x"))
    r = p.select("p_partkey", M.gain_map_parameters(F.col("x")).alias("r"))
    return r.select("p_partkey", F.get("r.GainMapMax", F.lit(0)).alias("most"), F.size("r.GainMapMin").alias("channels"), F.element_at("r.GainMapMin", -1).alias("last_min"), "r.base_is_hdr")


@query("""SELECT p_partkey, CAST(90 AS INT) AS bytes, CAST(100000 + p_partkey AS BIGINT) AS first_bytes, CAST(5000 + p_size AS BIGINT) AS gain_bytes, CAST(100000 + p_partkey - 700 AS BIGINT) AS gain_at, CAST(5000 + p_size AS BIGINT) AS said FROM part""")
def picture_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-picture blocks, written and read back, and the length that the first picture's packet says."""
    block = M.picture_block(100000 + F.col("p_partkey"), F.lit(700).cast("long"), 5000 + F.col("p_size"))
    p = parts(spark, sf_dir).select("p_partkey", block.alias("b"), M.directory_packet(5000 + F.col("p_size")).alias("x"))
    i = p.select("p_partkey", F.octet_length(M.app2(F.col("b"))).alias("bytes"), M.picture_index(F.col("b")).alias("i"), F.regexp_extract("x", r'Item:Length="(\d+)"', 1).cast("long").alias("said"))
    at = lambda k, c: F.get("i", F.lit(k))[c]
    return i.select("p_partkey", "bytes", at(0, "size").alias("first_bytes"), at(1, "size").alias("gain_bytes"), at(1, "offset").alias("gain_at"), "said")


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 AND NOT p_partkey % 3 = 0 THEN 'ssim' WHEN p_size % 2 = 0 THEN 'ssimulacra2' ELSE 'ssim' END AS metric, CASE WHEN p_size % 2 = 0 AND NOT p_partkey % 3 = 0 THEN 0.98::DOUBLE ELSE CAST(p_size AS DOUBLE) END AS target,
  640 * p_size <= 16383 AND 480 * p_size <= 16383 AS fits FROM part""")
def tune_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metric of a search where the wanted one may not be there, and sides that a format takes."""
    n = F.col("p_size")
    m = reports.tune_metric(F.when(n % 2 == 0, "ssimulacra2").otherwise("ssim"), F.col("p_partkey") % 3 == 0, n.cast("double"))
    return parts(spark, sf_dir).select("p_partkey", m.alias("m"), P.fits_webp(640 * n, 480 * n).alias("fits")).select("p_partkey", "m.metric", "m.target", "fits")


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(greatest(0, least(255, trunc(128 + CAST(x AS DOUBLE) * 300))) AS INT)) AS c FROM embeddings)
SELECT vec_id, CAST(list_sum(c) AS BIGINT) AS cut, CAST(list_sum(list_transform(c, lambda x: x * 257)) AS BIGINT) AS deep, CAST(list_sum(list_transform(c, lambda x: CAST(round_even(x * 257 / 257.0::DOUBLE, 0) AS INT))) AS BIGINT) AS back,
  round(list_sum(list_transform(c, lambda x: x * 257 / 65535.0::DOUBLE)), 6) AS unit FROM e""")
def sample_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blends cut to 8 bits, taken to 16 and back, and as numbers from 0 to 1."""
    c = table(spark, sf_dir, "embeddings").select("vec_id", P.clipped(F.transform("embedding", lambda x: 128 + x.cast("double") * 300), 8).alias("c"))
    d = c.withColumn("d", P.to_depth(F.col("c"), 8, 16))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, v: s + v)
    unit = F.aggregate(P.to_unit(F.col("d"), 16), F.lit(0.0), lambda s, v: s + v)
    return d.select("vec_id", total("c").alias("cut"), total("d").alias("deep"), total(P.to_depth(F.col("d"), 16, 8)).alias("back"), F.round(unit, 6).alias("unit"))


@query("""WITH p AS (SELECT p_partkey, p_size % 5 <> 0 AS enabled, p_size % 7 = 0 AS unwanted, CASE WHEN p_partkey % 3 = 0 THEN 'aggressive' ELSE 'faithful' END AS mode, p_partkey % 4 <> 0 AS encoder, p_size % 2 = 0 AS lossless FROM part)
SELECT p_partkey, enabled AND NOT unwanted AND mode <> 'aggressive' AND encoder AS include,
  CASE WHEN enabled AND NOT unwanted THEN CASE WHEN mode = 'aggressive' THEN 'clips are only encoded in faithful mode and will be skipped' WHEN NOT encoder THEN 'clips will be skipped: no encoder was found' END END AS reason,
  CASE WHEN mode = 'aggressive' THEN 'backgrounds are made anew on restoring: not a copy to keep alone' WHEN NOT lossless THEN 'visually lossless, not exact: ask for lossless if this is the only copy' END AS note FROM p""")
def watch_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a watch takes clips, why not, and what a backup must say."""
    n, k = F.col("p_size"), F.col("p_partkey")
    mode = F.when(k % 3 == 0, "aggressive").otherwise("faithful")
    d = reports.watch_videos(n % 5 != 0, n % 7 == 0, mode, k % 4 != 0)
    return parts(spark, sf_dir).select("p_partkey", d.alias("d"), reports.honesty_note(mode, n % 2 == 0).alias("note")).select("p_partkey", "d.include", "d.reason", "note")


@query("""WITH c AS (SELECT p_partkey, p_size % 4 AS processed, p_size % 3 AS ok, p_size % 2 AS failed, p_partkey % 3 AS skipped, p_size * 10 AS saved, p_partkey % 4 AS unchanged, p_partkey % 5 AS awaiting, p_partkey % 7 AS held FROM part)
SELECT p_partkey, concat_ws(' | ', CASE WHEN processed > 0 THEN 'processed ' || processed || ': ' || concat_ws(', ', ok || ' ok', CASE WHEN failed > 0 THEN failed || ' failed' END, CASE WHEN skipped > 0 THEN skipped || ' skipped' END) ELSE 'idle' END,
  CASE WHEN processed > 0 THEN 'saved ' || printf('%.1f B', CAST(saved AS DOUBLE)) END, CASE WHEN unchanged > 0 THEN unchanged || ' unchanged' END, CASE WHEN awaiting > 0 THEN awaiting || ' not yet stable (still syncing?)' END,
  CASE WHEN held > 0 THEN held || ' failed/skipped earlier (retried when the file changes)' END, 'next scan in 30s') AS line FROM c""")
def cycle_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a watch says about its cycles."""
    n, k = F.col("p_size"), F.col("p_partkey")
    c = F.struct((n % 4).alias("processed"), (n % 3).alias("ok"), (n % 2).alias("failed"), (k % 3).alias("skipped"), (n * 10).alias("saved"), (k % 4).alias("unchanged"), (k % 5).alias("awaiting"), (k % 7).alias("held"))
    return parts(spark, sf_dir).select("p_partkey", c.alias("c")).select("p_partkey", reports.cycle_line(F.col("c"), F.lit("30")).alias("line"))


TOTALS = """t AS (SELECT source, count(*) FILTER (WHERE status IN ('ok', 'skipped-larger', 'kept-original', 'would-encode')) AS ok, count(*) FILTER (WHERE status = 'skipped-unchanged') AS unchanged, count(*) FILTER (WHERE status = 'failed') AS failed,
  count(*) FILTER (WHERE status = 'skipped') AS skipped, CAST(coalesce(sum(original_size) FILTER (WHERE status IN ('ok', 'skipped-larger', 'kept-original')), 0) AS BIGINT) AS total_in,
  CAST(coalesce(sum(compressed_size) FILTER (WHERE status IN ('ok', 'skipped-larger', 'kept-original')), 0) AS BIGINT) AS total_out FROM results GROUP BY source)"""


@query(f"""WITH {FILES}, {RESULTS}, {TOTALS}
SELECT source, concat_ws(chr(10), concat_ws(', ', ok || ' compressed', CASE WHEN unchanged > 0 THEN unchanged || ' already backed up' END, CASE WHEN failed > 0 THEN failed || ' failed' END, CASE WHEN skipped > 0 THEN skipped || ' skipped' END),
  CASE WHEN total_out > 0 THEN {SIZE.format(n='total_in')} || ' to ' || {SIZE.format(n='total_out')} || ', ' || printf('%.1f', round_even(CAST(total_in AS DOUBLE) / total_out, 1)) || ' times smaller' END,
  'Clips were skipped: no encoder was found.', 'The copies are visually lossless, not exact.', 'The sources were not changed.') AS summary FROM t""")
def backup_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a finished backup of each source says."""
    t = reports.totals(results_of(spark, sf_dir), ["source"])
    return t.select("source", reports.backup_summary(F.struct("ok", "unchanged", "failed", "skipped", "total_in", "total_out"), F.lit(False), F.lit(True)).alias("summary"))


@query(f"""WITH {FILES}, {RESULTS}, r AS (SELECT *, {STATUS} AS row_status FROM results)
SELECT CAST(doc_id AS VARCHAR) AS file, row_status AS status, mode, '' AS codec, {SIZE.format(n='original_size')} AS original_bytes, CASE WHEN row_status = 'written' THEN {SIZE.format(n='compressed_size')} ELSE '' END AS output_bytes,
  CASE WHEN row_status = 'written' THEN printf('%.1fx', round_even(coalesce(CAST(original_size AS DOUBLE) / nullif(compressed_size, 0), 0), 1)) ELSE '' END AS ratio, CAST(doc_id % 100 AS VARCHAR) AS quality, '' AS faces FROM r""")
def report_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of a run as cells to show: blank where nothing was measured."""
    rows = results_of(spark, sf_dir).withColumn("status", reports.row_status(F.col("status"), F.col("mode"), F.col("dry_run")))
    done = F.col("status") == "written"
    return reports.table_cells(rows.select(
        F.col("doc_id").cast("string").alias("file"), "status", "mode", F.lit(None).cast("string").alias("codec"), F.col("original_size").alias("original_bytes"), F.when(done, F.col("compressed_size")).alias("output_bytes"),
        F.when(done, reports.ratio(F.col("original_size"), F.col("compressed_size"))).alias("ratio"), (F.col("doc_id") % 100).alias("quality"), F.lit(None).cast("int").alias("faces"),
    ))


GREY = "SELECT vec_id, list_transform(embedding, lambda x: CAST(greatest(0, least(255, trunc(128 + CAST(x AS DOUBLE) * 300))) AS INT)) AS g FROM embeddings"


def rasters(spark: SparkSession, sf_dir: str, times: int, tasks: int | None = None) -> DataFrame:
    """vec_id, path and a grey PNG of each embedding as an 8x8 raster, enlarged; dealt to so many tasks, as few read a table of few bytes."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    grey = (rows.repartition(tasks) if tasks else rows).select("vec_id", P.clipped(F.transform("embedding", lambda x: 128 + x.cast("double") * 300), 8).alias("g"))
    return grey.select("vec_id", F.col("vec_id").cast("string").alias("path"), png.grey_png("g", F.lit(8), F.lit(times)).alias("content"))


@query(f"WITH g AS ({GREY}) SELECT vec_id, 64 AS samples, CAST(list_sum(g) AS BIGINT) AS total, g[64] AS last FROM g")
def png_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters written as PNG and read back."""
    v = rasters(spark, sf_dir, 1).select("vec_id", png.png_values("content").alias("v"))
    return v.select("vec_id", F.size("v").alias("samples"), F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.element_at("v", -1).alias("last"))


#: The first coefficient of a uniform block is 8 times its distance from 128; it is rounded to the quality's step.
FLAT = "least(255, greatest(0, round_even(128 + round_even(8 * (x - 128) / q::DOUBLE, 0) * q / 8.0::DOUBLE, 0)))"
STEP = "least(255, greatest(1, (16 * CASE WHEN k < 50 THEN 5000 // k ELSE 200 - 2 * k END + 50) // 100))"


@query(f"""WITH g AS ({GREY}), q AS (SELECT vec_id, g, k, {STEP} AS q FROM (SELECT vec_id, g, CAST(1 + vec_id % 100 AS BIGINT) AS k FROM g))
SELECT vec_id, 64 * 64 AS samples, CAST(64 * list_sum(list_transform(g, lambda x: {FLAT})) AS BIGINT) AS total, CAST(list_last(list_transform(g, lambda x: {FLAT})) AS INT) AS last FROM q""")
def jpeg_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters whose pixels are whole blocks, written as JPEG at each quality and read back."""
    grey = table(spark, sf_dir, "embeddings").select("vec_id", P.clipped(F.transform("embedding", lambda x: 128 + x.cast("double") * 300), 8).alias("g"))
    v = grey.select("vec_id", jpeg.jpeg_values(jpeg.grey_jpeg("g", F.lit(8), F.lit(8), (1 + F.col("vec_id") % 100).cast("int"))).alias("v"))
    return v.select("vec_id", F.size("v").alias("samples"), F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.element_at("v", -1).alias("last"))


@query("""SELECT p_partkey, CAST(640 + p_size AS INT) AS width, CAST(480 + p_size AS INT) AS height, CAST(p_size % 4 AS INT) AS quarters, CAST(CASE WHEN p_size % 3 = 0 THEN 3 ELSE 2 END AS INT) AS items,
  CAST(1 + p_partkey % 8 AS INT) AS orientation, p_name AS icc, CASE WHEN p_size % 3 = 0 THEN 'urn:com:apple:photo:2020:aux:hdrgainmap' END AS gain_name,
  CAST(CASE WHEN p_size % 3 = 0 THEN (640 + p_size) // 2 END AS INT) AS gain_width, CAST(CASE WHEN p_size % 3 = 0 THEN 100 + p_size END AS INT) AS gain_bytes FROM part WHERE p_partkey % 7 <> 0""")
def heif_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of items, written and read back; every seventh lacks its end and is left out."""
    k, n = F.col("p_partkey"), F.col("p_size")
    block = exif_block(1 + k % 8, F.lit(False))
    sizes = F.struct((640 + n).alias("width"), (480 + n).alias("height"), (n % 4).alias("quarters"), block.alias("exif"), F.col("p_name").cast("binary").alias("icc"), F.when(n % 3 == 0, 100 + n).otherwise(0).alias("gain"))
    files = parts(spark, sf_dir).select("p_partkey", heif.heif_file(sizes).alias("f"))
    cut = F.when(k % 7 == 0, F.expr("substring(f, 1, octet_length(f) DIV 2)")).otherwise(F.col("f"))
    x = files.select("p_partkey", heif.heif_facts(cut).alias("x")).filter("x.width IS NOT NULL")
    shown = ("width", "height", "quarters", "items")
    return x.select("p_partkey", *[f"x.{c}" for c in shown], exif.orientation_udf("x.exif").alias("orientation"), F.col("x.icc").cast("string").alias("icc"), "x.gain_name", "x.gain_width", "x.gain_bytes")


def _score_sql() -> str:
    """The score of two grey 8x8 rasters: of equal colours only brightness can differ, and there is one size."""
    taps = perceptual.kernel()
    half = len(taps) // 2
    weight = perceptual.WEIGHTS[1, 0].ravel()
    kernel = ", ".join(f"({i}, {j}, {float(taps[i - j + half])!r}::DOUBLE)" for i in range(8) for j in range(8) if abs(i - j) <= half)
    bias, a, b = repr(perceptual.BIAS), perceptual.SUM_TIMES, perceptual.CUBIC
    unit = lambda v: f"({v} / 255.0::DOUBLE)"
    light = lambda v: f"CASE WHEN {unit(v)} <= 0.04045 THEN {unit(v)} / 12.92::DOUBLE ELSE pow(({unit(v)} + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END"
    bright = lambda v: f"cbrt({light(v)} + {bias}::DOUBLE) - cbrt({bias}::DOUBLE) + 0.01::DOUBLE"
    sums = ", ".join(f"sum(w * {c}) AS {c}" for c in ("p", "q", "pp", "qq", "pq"))
    norms = ", ".join(f"avg({e}), pow(avg(pow({e}, 4)), 0.25::DOUBLE)" for e in ("greatest(d, 0)", "greatest(e, 0)", "greatest(-e, 0)"))
    order = [0, 3, 1, 4, 2, 5]  # of `norms` as the weights have them
    total = " + ".join(f"{float(weight[k])!r}::DOUBLE * n[{i + 1}]" for i, k in enumerate(order))
    return f"""WITH g AS ({GREY}), px AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, {bright("g[i + 1]")} AS p, {bright("(g[i + 1] // 16 * 16)")} AS q FROM g, range(64) t(i)),
k(i, j, w) AS (VALUES {kernel}), m AS (SELECT *, p AS p0, q AS q0, p * p AS pp, q * q AS qq, p * q AS pq FROM px),
h AS (SELECT vec_id, y, i AS x, {sums} FROM m JOIN k ON j = x GROUP BY vec_id, y, i), v AS (SELECT vec_id, i AS y, x, {sums} FROM h JOIN k ON j = y GROUP BY vec_id, i, x),
e AS (SELECT vec_id, 1 - (1 - pow(v.p - v.q, 2)) * (2 * (v.pq - v.p * v.q) + 0.0009::DOUBLE) / ((v.pp - v.p * v.p) + (v.qq - v.q * v.q) + 0.0009::DOUBLE) AS d,
  (1 + abs(m.q0 - v.q)) / (1 + abs(m.p0 - v.p)) - 1 AS e FROM v JOIN m USING (vec_id, y, x)),
s AS (SELECT vec_id, {a!r}::DOUBLE * ({total}) AS s FROM (SELECT vec_id, [{norms}] AS n FROM e GROUP BY vec_id)), c AS (SELECT vec_id, {b[0]!r}::DOUBLE * s + ({b[1]!r}::DOUBLE) * s * s + {b[2]!r}::DOUBLE * s * s * s AS s FROM s)
SELECT vec_id, round(CASE WHEN s > 0 THEN 100 - 10 * pow(s, {perceptual.POWER!r}::DOUBLE) ELSE 100.0::DOUBLE END, 6) AS score FROM c"""


@query(_score_sql())
def perceptual_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters against themselves in sixteen shades."""
    grey = table(spark, sf_dir, "embeddings").select("vec_id", P.clipped(F.transform("embedding", lambda x: 128 + x.cast("double") * 300), 8).alias("g"))
    coarse = F.transform("g", lambda x: F.floor(x / 16) * 16)
    return grey.select("vec_id", F.round(perceptual.raster_score("g", coarse, F.lit(8)), 6).alias("score"))


#: A cascade of two stages over a window of 24 by 24: brighter on the left than on the right, then above than below.
LIGHT_LEFT_ABOVE = cascade.Cascade(24, 24, [cascade.Stage(0.5, [([(0, -1, k, 0.02)], [0.0, 1.0])]) for k in (0, 1)], [[(0, 0, 24, 24, -1.0), (0, 0, 12, 24, 2.0)], [(0, 0, 24, 24, -1.0), (0, 0, 24, 12, 2.0)]])


@query(f"""WITH g AS ({GREY}), w AS (SELECT vec_id, g, [CASE WHEN i IN (0, 7) THEN 2 ELSE 3 END for i in range(8)] AS r FROM g),
c AS (SELECT vec_id, i, g[i + 1] AS v, r[i // 8 + 1] * r[i % 8 + 1] AS n FROM w, range(64) t(i)),
s AS (SELECT vec_id, sum(CASE WHEN i % 8 < 4 THEN 9 * v ELSE -9 * v END) AS across, sum(CASE WHEN i < 32 THEN 9 * v ELSE -9 * v END) AS down, 484 * sum(n * v * v) - sum(n * v) * sum(n * v) AS spread FROM c GROUP BY vec_id)
SELECT vec_id, CAST(CASE WHEN least(across, down) >= 0.02::DOUBLE * CASE WHEN spread > 0 THEN sqrt(CAST(spread AS DOUBLE)) ELSE 1.0::DOUBLE END THEN 1 ELSE 0 END AS INT) AS windows FROM s""")
def cascade_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters of the size of a cascade's window, and whether they pass it."""
    grey = table(spark, sf_dir, "embeddings").select("vec_id", P.clipped(F.transform("embedding", lambda x: 128 + x.cast("double") * 300), 8).alias("g"))
    return grey.select("vec_id", cascade.raster_faces(LIGHT_LEFT_ABOVE, 8, 3)("g").alias("windows"))


_UP = ", ".join(f"({i}, {x!r}::DOUBLE, {y!r}::DOUBLE)" for i, (x, y) in enumerate(align.UPRIGHT.tolist()))


@query(f"""WITH u(i, u, v) AS (VALUES {_UP}), p AS (SELECT vec_id, i, u, v, 100 * CAST(embedding[2 * i + 1] AS DOUBLE) AS x, 100 * CAST(embedding[2 * i + 2] AS DOUBLE) AS y FROM embeddings, u),
m AS (SELECT vec_id, avg(x) AS x, avg(y) AS y, avg(u) AS u, avg(v) AS v FROM p GROUP BY vec_id),
c AS (SELECT vec_id, sum((p.x - m.x) * (p.u - m.u) + (p.y - m.y) * (p.v - m.v)) / sum(pow(p.x - m.x, 2) + pow(p.y - m.y, 2)) AS re, sum((p.x - m.x) * (p.v - m.v) - (p.y - m.y) * (p.u - m.u)) / sum(pow(p.x - m.x, 2) + pow(p.y - m.y, 2)) AS im
  FROM p JOIN m USING (vec_id) GROUP BY vec_id)
SELECT vec_id, round(re, 6) AS re, round(im, 6) AS im, round(u - re * x + im * y, 6) AS dx, round(v - re * y - im * x, 6) AS dy FROM c JOIN m USING (vec_id)""")
def face_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five points brought nearest to an upright face's; an embedding's first values stand for landmarks."""
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    value = lambda i: 100 * F.get("embedding", F.lit(i)).cast("double")
    points, onto = F.array(*[point(value(2 * i), value(2 * i + 1)) for i in range(5)]), F.array(*[point(F.lit(x), F.lit(y)) for x, y in align.UPRIGHT.tolist()])
    t = table(spark, sf_dir, "embeddings").select("vec_id", align.fit_column(points, onto).alias("t"))
    return t.select("vec_id", *[F.round(f"t.{c}", 6).alias(name) for c, name in (("re", "re"), ("im", "im"), ("x", "dx"), ("y", "dy"))])


def _middle(image) -> list:
    """Stands for a detector: one face in the middle."""
    height, width = image.shape[:2]
    return [(width // 4, height // 4, 3 * width // 4, 3 * height // 4, 0.9)]


@query(f"WITH g AS ({GREY}) SELECT vec_id, 'ok' AS status, 'png' AS codec, 1 AS faces, CAST(3 * 4 * list_sum(g) AS BIGINT) AS total, 1.0::DOUBLE AS similarity FROM g")
def photo_lossless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters as photos through the faithful mode without loss."""
    chosen = settings.resolve(flags={"faithful.lossless": True, "faithful.verify_thorough": True, "faithful.skip_if_larger": False})
    done = photos.compress_faithful(rasters(spark, sf_dir, 2), chosen, _middle).withColumn("v", png.png_values("content"))
    total = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x)
    return done.select(F.col("path").cast("long").alias("vec_id"), "status", "codec", "faces", total.alias("total"), F.round("similarity", 9).alias("similarity"))


@query("SELECT vec_id, TRUE AS sound, 1 AS faces, 32 AS width, 32 AS height, 0.25::DOUBLE AS scale, 3072 AS samples FROM embeddings")
def photo_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters as photos into containers, their audit, and what comes back: each photo is packed once, and its facts go along with it."""
    chosen = settings.resolve(flags={"aggressive.content_aware": False})
    packed = photos.compress_photos(rasters(spark, sf_dir, 4, 4 * spark.sparkContext.defaultParallelism), chosen, _middle)
    facts = F.struct(F.size("manifest.faces").alias("faces"), "manifest.original.width", "manifest.original.height", F.col("manifest.settings.bg_scale").alias("scale"))
    read = container.read_containers(packed, ["content"]).withColumn("facts", facts)
    back = photos.restore_photos(container.audit(read, ["content", "facts"]), kept=["ok", "facts"])
    return back.select(F.col("path").cast("long").alias("vec_id"), F.col("ok").alias("sound"), "facts.*", F.size(png.png_values("content")).alias("samples"))


@query("""SELECT p_partkey, 'ffmpeg -y -hide_banner -nostdin -loglevel error -i in/' || p_partkey || '.mov -map 0:v:0 -map 0:a:0? -map_metadata 0 -fps_mode passthrough -c:v libsvtav1 -crf ' || p_size || ' -preset 6 -svtav1-params tune=0 -pix_fmt '
  || CASE WHEN p_size % 2 = 0 THEN 'yuv420p10le' ELSE 'yuv420p' END || CASE WHEN p_size % 3 = 0 THEN ' -dolbyvision 1 -strict unofficial' ELSE '' END || ' -c:a copy -movflags +faststart+use_metadata_tags -f mp4 out/' || p_partkey || '.mp4' AS command,
  '[0:v]' || s || 'settb=AVTB,setpts=N/(30*TB)[d];[1:v]' || s || 'settb=AVTB,setpts=N/(30*TB)[r];[d][r]libvmaf=model=version=vmaf_v0.6.1:n_threads=4:eof_action=endall:log_fmt=json:log_path=vmaf.json' AS graph
FROM (SELECT *, CASE WHEN p_size % 5 <> 0 THEN 'scale=-2:1080:flags=bicubic,' ELSE '' END AS s FROM part)""")
def clip_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commands that encode clips and the graphs that score them."""
    k, n = F.col("p_partkey").cast("string"), F.col("p_size")
    command = tools.clip_command(F.concat(F.lit("in/"), k, F.lit(".mov")), F.concat(F.lit("out/"), k, F.lit(".mp4")), n, F.lit(6), n % 2 == 0, n % 3 == 0)
    return parts(spark, sf_dir).select("p_partkey", F.array_join(command, " ").alias("command"), tools.score_graph(F.lit("vmaf_v0.6.1"), n % 5 != 0, 4).alias("graph"))
