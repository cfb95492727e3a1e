"""Searches, pooled scores and pixel arithmetic over part, events and embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emulsia.functions import pixels as P
from emulsia.functions import search as S
from emulsia.operators import pooled

from .registry import registrar, table

QUERIES: dict = {}
SQL: dict = {}
query = registrar(QUERIES, SQL)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part")


@query("""WITH c AS (SELECT p_partkey, 1000 + (p_partkey * 7) % 400 AS avif, 1000 + (p_partkey * 11) % 400 AS jxl, p_size % 5 <> 0 AS has_jxl FROM part)
SELECT p_partkey, CASE WHEN has_jxl AND jxl < avif THEN 'jxl' ELSE 'avif' END AS codec, CAST(CASE WHEN has_jxl AND jxl < avif THEN jxl ELSE avif END AS BIGINT) AS bytes FROM c""")
def codec_argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smaller of two encodings, the first on ties; a codec may be unavailable."""
    k = F.col("p_partkey")
    entry = lambda size, pref, name: F.struct(size.cast("long").alias("bytes"), F.lit(pref).alias("pref"), F.lit(name).alias("codec"))
    avif, jxl = entry(1000 + (k * 7) % 400, 0, "avif"), entry(1000 + (k * 11) % 400, 1, "jxl")
    tried = F.when(F.col("p_size") % 5 != 0, F.array(avif, jxl)).otherwise(F.array(avif))
    return parts(spark, sf_dir).select("p_partkey", S.cheapest(tried).alias("b")).select("p_partkey", "b.codec", "b.bytes")


def sql_probe(lo: int, hi: int, up: bool, check: bool, passes: str) -> str:
    """A recursive probe of part; up: a pass raises lo. check: stop on an empty range."""
    mid = "((lo + hi) // 2)"
    ok = passes.format(mid=mid)
    new_lo, new_hi = (f"CASE WHEN {ok} THEN {mid} + 1 ELSE lo END", f"CASE WHEN {ok} THEN hi ELSE {mid} - 1 END") if up else (f"CASE WHEN {ok} THEN lo ELSE {mid} + 1 END", f"CASE WHEN {ok} THEN {mid} - 1 ELSE hi END")
    stop = " AND lo <= hi" if check else ""
    return f"""WITH RECURSIVE r AS (SELECT p_partkey, p_size, 0 AS n, {lo} AS lo, {hi} AS hi, CAST(NULL AS INT) AS best FROM part
UNION ALL SELECT p_partkey, p_size, n + 1, {new_lo}, {new_hi}, CASE WHEN {ok} THEN {mid} ELSE best END FROM r WHERE n < 6{stop}),
f AS (SELECT p_partkey, arg_max(best, n) AS best, max(CASE WHEN best IS NOT NULL THEN n END) AS k FROM r GROUP BY p_partkey),
last AS (SELECT r.p_partkey, r.best FROM r JOIN (SELECT p_partkey, max(n) AS n FROM r GROUP BY p_partkey) m ON r.p_partkey = m.p_partkey AND r.n = m.n)"""


@query(sql_probe(40, 95, False, False, "({mid} * 2 + p_size >= 120 + p_partkey % 90)") + " SELECT p_partkey, CAST(coalesce(best, 95) AS INT) AS quality FROM last")
def quality_bisect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least quality whose score meets the part's target."""
    passes = lambda q: q * 2 + F.col("p_size") >= 120 + F.col("p_partkey") % 90
    return parts(spark, sf_dir).select("p_partkey", S.lowest_quality(passes).cast("int").alias("quality"))


CRF_PASS = "(100 - {mid} * 0.3::DOUBLE + p_size * 0.1::DOUBLE >= 85 + p_partkey % 17)"


@query(sql_probe(20, 55, True, True, CRF_PASS) + " SELECT p_partkey, CAST(coalesce(best, 20) AS INT) AS crf FROM last")
def crf_bisect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest rate factor whose score meets the part's target."""
    return parts(spark, sf_dir).select("p_partkey", S.highest_crf(_clip_passes).cast("int").alias("crf"))


def _clip_passes(crf: Column) -> Column:
    return 100 - crf * 0.3 + F.col("p_size") * 0.1 >= 85 + F.col("p_partkey") % 17


@query(f"""WITH RECURSIVE g AS (SELECT p_partkey, p_size, 0 AS retries, 20 + p_partkey % 36 AS crf FROM part
UNION ALL SELECT p_partkey, p_size, retries + 1, greatest(18, crf - 4) FROM g WHERE retries < 2 AND crf > 18 AND NOT {CRF_PASS.format(mid='crf')})
SELECT p_partkey, CAST(max(retries) AS INT) AS retries, CAST(min(crf) AS INT) AS crf, bool_or({CRF_PASS.format(mid='crf')}) AS passed FROM g GROUP BY p_partkey""")
def gate_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An encode whose gate fails is tried again at a smaller factor, at most twice."""
    end = S.gated_crf((20 + F.col("p_partkey") % 36).cast("int"), _clip_passes)
    return parts(spark, sf_dir).select("p_partkey", end.alias("e")).select("p_partkey", "e.retries", "e.crf", "e.passed")


SCALES = (0.125, 0.2, 0.25, 0.35, 0.5)


@query(f"""WITH c AS (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END AS floor, s, abs((p_partkey % 13) / 20.0::DOUBLE - s) AS d FROM part, (VALUES {', '.join(f'({s}::DOUBLE)' for s in SCALES)}) t(s)),
ok AS (SELECT p_partkey, floor, min(s) FILTER (WHERE d <= 0.08::DOUBLE) AS within, min(struct_pack(d := d, s := s)).s AS closest FROM c WHERE s > floor GROUP BY p_partkey, floor)
SELECT p_partkey, coalesce(within, closest, floor) AS scale FROM ok""")
def scale_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least scale above the floor within the target distance, else the closest."""
    distance = lambda s: F.struct(F.lit(s).alias("scale"), F.abs((F.col("p_partkey") % 13) / F.lit(20.0) - s).alias("distance"))
    floor = F.when(F.col("p_size") % 4 == 0, 0.2).otherwise(0.1)
    return parts(spark, sf_dir).select("p_partkey", S.best_scale(F.array(*map(distance, SCALES)), F.lit(0.08), floor).alias("scale"))


@query("""WITH v AS (SELECT event_type, list(value ORDER BY value) AS v FROM events GROUP BY event_type)
SELECT event_type, round(list_avg(v), 6) AS mean, v[CAST(greatest(1, len(v) // 100) AS INT)] AS p1, v[1] AS min, CAST(len(v) AS BIGINT) AS frames FROM v""")
def score_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores pooled by clip: mean, order statistic, least, count."""
    events = table(spark, sf_dir, "events").select("event_type", "value")
    counts = events.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("min"), F.count("*").alias("frames"))
    p1 = pooled.ranked_values(events, "event_type", "value", counts.select("event_type", F.greatest(F.lit(1), F.floor(F.col("frames") / 100)).alias("nth")))
    return counts.join(p1.select("event_type", F.col("value").alias("p1")), "event_type").select("event_type", "mean", "p1", "min", "frames")


@query("""WITH d AS (SELECT user_id, CAST(count(*) AS DOUBLE) * 1.5::DOUBLE AS s FROM events GROUP BY user_id)
SELECT user_id, 0.0::DOUBLE AS start, greatest(s, 3.0::DOUBLE) AS length FROM d WHERE s <= 18 UNION ALL
SELECT user_id, round(greatest(0.0::DOUBLE, s * p - 1.5::DOUBLE), 3), 3.0::DOUBLE FROM d, (VALUES (0.15::DOUBLE), (0.5::DOUBLE), (0.85::DOUBLE)) t(p) WHERE s > 18""")
def sample_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of clips that are probed: a user's events stand for the length."""
    clips = table(spark, sf_dir, "events").groupBy("user_id").agg((F.count("*").cast("double") * 1.5).alias("s"))
    return clips.select("user_id", F.inline(S.sample_spans(F.col("s"))))


PAIR = "SELECT a.vec_id, a.embedding AS a, b.embedding AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block of pixels with the next one."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")


@query(f"WITH p AS ({PAIR}) SELECT vec_id, round(-10 * log10(list_avg(list_transform(range(1, 65), lambda i: pow(CAST(a[i] AS DOUBLE) - b[i], 2)))), 6) AS psnr FROM p")
def psnr_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("vec_id", F.round(P.psnr(F.col("a"), F.col("b")), 6).alias("psnr"))


@query(f"WITH p AS ({PAIR}) SELECT vec_id, round(list_avg(list_transform(range(1, 65), lambda i: least(1.0::DOUBLE, abs(CAST(a[i] AS DOUBLE) - b[i]) * 4))), 6) AS mean_diff, round(list_max(list_transform(range(1, 65), lambda i: least(1.0::DOUBLE, abs(CAST(a[i] AS DOUBLE) - b[i]) * 4))), 6) AS max_diff FROM p")
def diff_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pairs(spark, sf_dir).select("vec_id", P.diff_map(F.col("a"), F.col("b"), 4.0).alias("d"))
    return d.select("vec_id", F.round(F.aggregate("d", F.lit(0.0), lambda s, v: s + v) / F.size("d"), 6).alias("mean_diff"), F.round(F.array_max("d"), 6).alias("max_diff"))


@query("""WITH r AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 1000) AS r FROM embeddings),
e AS (SELECT vec_id, list_transform(r, lambda x: CAST(greatest(0, least(255, round_even(x / 2 + 128, 0))) AS INT)) AS e FROM r)
SELECT vec_id, CAST(list_sum(e) AS BIGINT) AS code_sum, CAST(list_sum(list_transform(e, lambda x: x * 2 - 256)) AS BIGINT) AS decoded_sum FROM e""")
def residual_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offset codes of residuals and their decoding."""
    r = table(spark, sf_dir, "embeddings").select("vec_id", P.encode_residual(F.transform("embedding", lambda x: x.cast("double") * 1000)).alias("e"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, v: s + v)
    return r.select("vec_id", total("e").alias("code_sum"), total(P.decode_residual(F.col("e"))).alias("decoded_sum"))


@query("""WITH b AS (SELECT p_partkey, 20 + p_size AS w, 20 + p_size % 7 AS h FROM part),
g AS (SELECT p_partkey, w, h, x, unnest(range(0, h)) AS y FROM (SELECT p_partkey, w, h, unnest(range(0, w)) AS x FROM b))
SELECT p_partkey, round(sum(greatest(0.0::DOUBLE, least(1.0::DOUBLE, least(y, h - 1 - y, x, w - 1 - x) / 8.0::DOUBLE))), 6) AS mass FROM g GROUP BY p_partkey""")
def soft_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summed weight of the feathered mask of a crop."""
    b = parts(spark, sf_dir).select("p_partkey", (20 + F.col("p_size")).alias("w"), (20 + F.col("p_size") % 7).alias("h"))
    return b.select("p_partkey", F.round(P.mask_mass(F.col("w"), F.col("h"), 8), 6).alias("mass"))


@query("""WITH v AS (SELECT p_partkey, (p_partkey % 101) / 100.0::DOUBLE AS v FROM part), l AS (SELECT p_partkey, v, CASE WHEN v <= 0.04045::DOUBLE THEN v / 12.92::DOUBLE ELSE pow((v + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END AS lin FROM v),
p AS (SELECT *, pow(greatest(0.0::DOUBLE, least(1.0::DOUBLE, lin * 1000 / 10000.0::DOUBLE)), 2610 / 16384.0::DOUBLE) AS m FROM l)
SELECT p_partkey, round(lin, 9) AS linear, round(pow((3424 / 4096.0::DOUBLE + 2413 / 4096.0::DOUBLE * 32 * m) / (1 + 2392 / 4096.0::DOUBLE * 32 * m), 2523 / 4096.0::DOUBLE * 128), 9) AS pq, round(lin * pow(2.0::DOUBLE, v * 1.5::DOUBLE), 9) AS boosted FROM p""")
def tone_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear light, its code on the perceptual curve at 1000 nits, and the light after a gain."""
    v = (F.col("p_partkey") % 101) / 100.0
    lin = P.srgb_to_linear(v)
    boosted = F.element_at(P.gain_mapped(F.array(lin), F.array(v), 1.5), 1)
    return parts(spark, sf_dir).select("p_partkey", F.round(lin, 9).alias("linear"), F.round(P.pq_encode(lin * 1000), 9).alias("pq"), F.round(boosted, 9).alias("boosted"))


@query("""WITH r AS (SELECT label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS r FROM embeddings), m AS (SELECT label, r, list_median(r) AS m FROM r),
s AS (SELECT label, 1.4826::DOUBLE * list_median(list_transform(r, lambda x: abs(x - m))) AS s FROM m) SELECT label, round(median(s), 6) AS sigma FROM s GROUP BY label""")
def grain_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robust noise of each block, then the median by label."""
    s = table(spark, sf_dir, "embeddings").select("label", P.robust_sigma(F.transform("embedding", lambda x: x.cast("double"))).alias("s"))
    n = s.groupBy("label").agg(F.count("*").alias("n"))
    both = n.select("label", F.explode(F.array_distinct(F.array(F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1))).alias("nth"))
    return pooled.ranked_values(s, "label", "s", both).groupBy("label").agg(F.round(F.avg("s"), 6).alias("sigma"))


@query("SELECT p_partkey, CAST(round_even((p_partkey * 331 % 65536) / 257.0::DOUBLE, 0) AS INT) AS rounded, CAST(floor((p_partkey * 331 % 65536) * 255 / 65535.0::DOUBLE) AS INT) AS viewed FROM part")
def depth_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two conversions of 16-bit samples to 8 bits."""
    x = F.col("p_partkey") * 331 % 65536
    return parts(spark, sf_dir).select("p_partkey", P.to_eight_bits(x).alias("rounded"), P.view_eight_bits(x).alias("viewed"))


SSIM_SQL = f"""WITH p AS ({PAIR}), w AS (SELECT vec_id, a, b, t.dy AS dy, t.dx AS dx FROM p, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(dy, dx)),
c AS (SELECT vec_id, dy, dx, CAST(a[1 + (dy + i // 7) * 8 + dx + i % 7] AS DOUBLE) AS x, CAST(b[1 + (dy + i // 7) * 8 + dx + i % 7] AS DOUBLE) AS y FROM (SELECT *, unnest(range(0, 49)) AS i FROM w)),
m AS (SELECT vec_id, dy, dx, avg(x) AS mx, avg(y) AS my, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS cov FROM c GROUP BY vec_id, dy, dx)
SELECT vec_id, round(avg((2 * mx * my + 0.0001::DOUBLE) * (2 * cov + 0.0009::DOUBLE) / ((mx * mx + my * my + 0.0001::DOUBLE) * (vx + vy + 0.0009::DOUBLE))), {{digits}}) AS ssim FROM m GROUP BY vec_id"""


@query(SSIM_SQL.format(digits=6))
def ssim_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windowed similarity of neighbouring blocks."""
    return pairs(spark, sf_dir).select("vec_id", F.round(P.ssim_8x8("a", "b"), 6).alias("ssim"))
