"""Clip rules over lineitem and orders: a line is a clip."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emulsia.functions import video as V

from .registry import registrar, table

QUERIES: dict = {}
SQL: dict = {}
query = registrar(QUERIES, SQL)

CLIP = """clip AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'av1' WHEN 1 THEN 'h264' ELSE 'hevc' END AS codec, CAST(640 + o_orderkey % 3 * 1600 AS BIGINT) AS w, CAST(480 + o_orderkey % 3 * 840 AS BIGINT) AS h,
  CAST(trunc(o_totalprice) * 20 AS BIGINT) AS rate, CASE WHEN o_orderkey % 4 = 0 THEN 0.0::DOUBLE WHEN o_orderkey % 4 = 1 THEN 30000 / 1001.0::DOUBLE ELSE 25.0::DOUBLE END AS fps FROM orders),
bits AS (SELECT *, coalesce(CAST(rate AS DOUBLE) / nullif(w * h * fps, 0), 0) AS b FROM clip)"""


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as clips with a codec, a frame and rates as a prober prints them."""
    k = F.col("o_orderkey")
    rates = F.when(k % 4 == 0, "0/0").when(k % 4 == 1, "30000/1001").otherwise("0/1"), F.when(k % 4 >= 2, "25").otherwise("0/0")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(k % 5 == 0, "av1").when(k % 5 == 1, "h264").otherwise("hevc").alias("codec"), (640 + k % 3 * 1600).cast("long").alias("w"), (480 + k % 3 * 840).cast("long").alias("h"),
        (F.floor("o_totalprice") * 20).cast("long").alias("rate"), V.frame_rate(*rates).alias("fps"),
    )


@query(f"""WITH {CLIP} SELECT o_orderkey, fps, b AS bits, CASE WHEN codec = 'av1' THEN 'already av1' WHEN b > 0 AND b <= 0.05::DOUBLE THEN 'already efficient' END AS reason,
  CASE WHEN least(w, h) >= 1800 THEN 'vmaf_4k' ELSE 'vmaf' END AS model FROM bits""")
def clip_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates, the reason to leave a clip alone, and the model that scores it."""
    c = clips(spark, sf_dir).withColumn("b", V.bits_per_pixel(F.col("rate"), F.col("w"), F.col("h"), F.col("fps")))
    return c.select("o_orderkey", "fps", F.col("b").alias("bits"), V.skip_reason(F.col("codec"), F.col("b")).alias("reason"), V.vmaf_model(F.col("w"), F.col("h")).alias("model"))


@query("""WITH p AS (SELECT o_orderkey, 'in/clip.' || o_orderkey || CASE o_orderkey % 3 WHEN 0 THEN '.mp4' WHEN 1 THEN '.MOV' ELSE '' END AS path, CASE WHEN o_orderkey % 2 = 0 THEN 'in' ELSE 'out' END AS folder FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND folder = 'in' THEN 'in/clip.' || o_orderkey || '_av1.mp4' WHEN o_orderkey % 3 = 2 THEN folder || '/clip.mp4' ELSE folder || '/clip.' || o_orderkey || '.mp4' END AS output_path FROM p""")
def clip_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output names that never are the input."""
    k = F.col("o_orderkey")
    path = F.concat(F.lit("in/clip."), k.cast("string"), F.when(k % 3 == 0, ".mp4").when(k % 3 == 1, ".MOV").otherwise(""))
    return table(spark, sf_dir, "orders").select("o_orderkey", V.output_path(path, F.when(k % 2 == 0, "in").otherwise("out")).alias("output_path"))


@query("""WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN 90.0::DOUBLE + o_orderkey % 9 END AS gate, CASE WHEN o_orderkey % 4 = 0 THEN 92.0::DOUBLE END AS tune, o_orderkey % 2 AS faces FROM orders)
SELECT o_orderkey, CASE WHEN gate IS NOT NULL THEN CASE WHEN faces > 0 THEN greatest(gate, 95.0::DOUBLE) ELSE gate END END AS gate_target,
  CASE WHEN faces > 0 THEN greatest(coalesce(tune, gate, 93.0::DOUBLE), 95.0::DOUBLE) ELSE coalesce(tune, gate, 93.0::DOUBLE) END AS tune_target FROM t""")
def clip_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate's and the search's targets, raised by a face; a gate that is off stays off."""
    k = F.col("o_orderkey")
    gate, tune = V.targets(F.when(k % 3 > 0, 90.0 + k % 9), F.when(k % 4 == 0, 92.0), k % 2)
    return table(spark, sf_dir, "orders").select("o_orderkey", gate.alias("gate_target"), tune.alias("tune_target"))


@query("SELECT l_orderkey, l_linenumber, l_quantity, NOT (l_linenumber % 2 = 0) AND l_extendedprice * (1 + l_tax) * (1 - l_discount) >= l_extendedprice AS kept FROM lineitem")
def keep_if_smaller(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = F.col("l_extendedprice") * (1 + F.col("l_tax")) * (1 - F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", V.keep_original(encoded, F.col("l_extendedprice"), F.col("l_linenumber") % 2 == 0).alias("kept"))


@query("""SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: ((i - 1) / 63.0::DOUBLE) * embedding[i] + (1 - (i - 1) / 63.0::DOUBLE) * embedding[65 - i])), 5) AS mass FROM embeddings""")
def blend_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block blended over its mirror image under a ramp."""
    from emulsia.functions.restore import blended

    e = F.transform("embedding", lambda x: x.cast("double"))
    ramp = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i / 63.0)
    mixed = table(spark, sf_dir, "embeddings").select("vec_id", e.alias("a"), F.reverse(e).alias("b"), ramp.alias("m"))
    out = blended(F.col("a"), F.col("b"), F.col("m"))
    return mixed.select("vec_id", F.round(F.aggregate(out, F.lit(0.0), lambda s, v: s + v), 5).alias("mass"))
