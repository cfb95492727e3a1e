"""Box queries over lineitem: an order is an image, its lines are boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emulsia import detectors
from emulsia.functions import boxes as B

from .registry import registrar, table

QUERIES: dict = {}
SQL: dict = {}
query = registrar(QUERIES, SQL)

WIDTH, HEIGHT = 1000, 800
FACE = """face AS (SELECT l_orderkey AS image, CAST(l_partkey % 900 AS INT) AS x1, CAST(l_suppkey % 700 AS INT) AS y1, CAST(l_partkey % 900 + 20 + 2 * trunc(l_quantity) AS INT) AS x2,
  CAST(l_suppkey % 700 + 20 + 2 * trunc(l_quantity) + 3 * l_linenumber AS INT) AS y2, l_discount AS conf FROM lineitem)"""
ORDER = "ORDER BY conf DESC, (x2 - x1) * (y2 - y1) DESC, x1, y1, x2, y2"
AREA = "(CAST({b}.x2 - {b}.x1 AS BIGINT) * ({b}.y2 - {b}.y1))"
OVER = "(greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * CAST(greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)) AS BIGINT))"


def sql_iou(a: str, b: str) -> str:
    over, areas = OVER.format(a=a, b=b), f"{AREA.format(b=a)} + {AREA.format(b=b)}"
    return f"(CASE WHEN {over} > 0 THEN CAST({over} AS DOUBLE) / ({areas} - {over}) ELSE 0 END)"


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, box and conf of each line."""
    side = 20 + 2 * F.col("l_quantity").cast("int")
    x, y = F.pmod("l_partkey", F.lit(900)), F.pmod("l_suppkey", F.lit(700))
    box = B.box(x, y, x + side, y + side + 3 * F.col("l_linenumber"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), box.alias("box"), F.col("l_discount").alias("conf"))


def ordered(df: DataFrame) -> DataFrame:
    """One row an image: `boxes` by confidence, then area, both descending, then corners; an image has a few boxes."""
    keyed = F.struct((-F.col("conf")).alias("c"), (-B.area(F.col("box"))).alias("a"), F.col("box").alias("b"))
    return df.groupBy("image").agg(F.transform(F.sort_array(F.collect_list(keyed)), lambda e: e["b"]).alias("boxes"))


def frame() -> tuple[Column, Column]:
    return F.lit(WIDTH), F.lit(HEIGHT)


def listed(df: DataFrame, column: Column | str = "boxes") -> DataFrame:
    """A row a box, with its place; a merge given as an expression is computed once, one of a column before it again for a filter."""
    return df.select("image", F.posexplode(column).alias("at", "b")).select("image", "at", "b.*")


PADDED = f"""padded AS (SELECT *, greatest(0, CAST(trunc((x1 + x2) / 2.0::DOUBLE - (x2 - x1) * 1.5::DOUBLE / 2.0) AS INT)) AS px1, greatest(0, CAST(trunc((y1 + y2) / 2.0::DOUBLE - (y2 - y1) * 1.5::DOUBLE / 2.0) AS INT)) AS py1,
  least({WIDTH}, CAST(trunc((x1 + x2) / 2.0::DOUBLE + (x2 - x1) * 1.5::DOUBLE / 2.0) AS INT)) AS px2, least({HEIGHT}, CAST(trunc((y1 + y2) / 2.0::DOUBLE + (y2 - y1) * 1.5::DOUBLE / 2.0) AS INT)) AS py2 FROM face)"""


@query(f"WITH {FACE}, {PADDED} SELECT image, conf, px1 AS x1, py1 AS y1, px2 AS x2, py2 AS y2 FROM padded")
def box_pad_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faces(spark, sf_dir).select("image", "conf", B.pad_and_clip(F.col("box"), 1.5, *frame()).alias("p")).select("image", "conf", "p.*")


@query(f"""WITH {FACE}, {PADDED} SELECT image, conf, greatest(0, CAST(trunc(px1 - (x2 - x1) * 0.3::DOUBLE) AS INT)) AS x1, py1 AS y1,
  least({WIDTH}, CAST(trunc(px2 + (x2 - x1) * 0.3::DOUBLE) AS INT)) AS x2, least({HEIGHT}, CAST(trunc(py2 + (y2 - y1) * 1.2::DOUBLE) AS INT)) AS y2 FROM padded""")
def box_roi_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = faces(spark, sf_dir).withColumn("p", B.pad_and_clip(F.col("box"), 1.5, *frame()))
    return padded.select("image", "conf", B.expand_roi(F.col("p"), F.col("box"), "head_shoulders", *frame()).alias("r")).select("image", "conf", "r.*")


FIT = f"x2 > x1 AND y2 > y1 AND least(x2 - x1, y2 - y1) >= 0.05::DOUBLE * {min(WIDTH, HEIGHT)} AND greatest(CAST(x2 - x1 AS DOUBLE) / (y2 - y1), CAST(y2 - y1 AS DOUBLE) / (x2 - x1)) <= 1.6::DOUBLE"


def plausible(df: DataFrame) -> DataFrame:
    """Boxes that aren't empty, too small for the frame or too long."""
    w, h = F.col("box.x2") - F.col("box.x1"), F.col("box.y2") - F.col("box.y1")
    return df.filter((w > 0) & (h > 0) & (F.least(w, h) >= 0.05 * min(WIDTH, HEIGHT)) & (F.greatest(w / h, h / w) <= 1.6))


@query(f"WITH {FACE} SELECT * FROM face WHERE {FIT}")
def face_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plausible(faces(spark, sf_dir)).select("image", "box.*", "conf")


@query(f"""WITH {FACE}, n AS (SELECT *, row_number() OVER (PARTITION BY image {ORDER}) AS at FROM face)
SELECT a.image, a.at AS a, b.at AS b, {sql_iou('a', 'b')} AS iou FROM n a JOIN n b ON a.image = b.image AND a.at < b.at WHERE {sql_iou('a', 'b')} > 0""")
def box_iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping pairs within an image, from its array: no self-join."""
    pairs = F.flatten(F.transform("boxes", lambda x, i: F.transform(F.filter(F.transform("boxes", lambda y, j: F.struct(j.alias("j"), y.alias("y"))), lambda e: e["j"] > i), lambda e: F.struct((i + 1).cast("long").alias("a"), (e["j"] + 1).cast("long").alias("b"), B.iou(x, e["y"]).alias("iou")))))
    return ordered(faces(spark, sf_dir)).select("image", F.inline(F.filter(pairs, lambda p: p["iou"] > 0)))


def sql_greedy(source: str, order: str, keep: str) -> str:
    """Greedy selection over an ordered list of one-element lists."""
    return f"""l AS (SELECT image, list([{{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] {order}) AS bs FROM {source} GROUP BY image),
k AS (SELECT image, list_reduce(bs, lambda acc, e: CASE WHEN len(list_filter(acc, lambda k: NOT ({keep}))) = 0 THEN list_concat(acc, e) ELSE acc END) AS kept FROM l)
SELECT image, CAST(i - 1 AS INT) AS at, kept[i].x1 AS x1, kept[i].y1 AS y1, kept[i].x2 AS x2, kept[i].y2 AS y2 FROM (SELECT image, kept, unnest(range(1, len(kept) + 1)) AS i FROM k)"""


@query(f"WITH {FACE}, fit AS (SELECT * FROM face WHERE {FIT}), {sql_greedy('fit', ORDER, sql_iou('k', 'e[1]') + ' <= 0.3::DOUBLE')}")
def face_suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(ordered(plausible(faces(spark, sf_dir))).select("image", B.suppress(F.col("boxes"), 0.3, True, B.BOX).alias("boxes")))


@query(f"WITH {FACE}, {sql_greedy('face', 'ORDER BY (x2 - x1) * (y2 - y1) DESC, x1, y1, x2, y2', sql_iou('k', 'e[1]') + ' < 0.4::DOUBLE')}")
def box_suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_area = ordered(faces(spark, sf_dir).withColumn("conf", F.lit(0.0)))
    return listed(by_area.select("image", B.suppress(F.col("boxes"), 0.4, False, B.BOX).alias("boxes")))


BANDS = f"""bands AS (SELECT image, greatest(0, CAST(trunc((x1 + x2) / 2.0::DOUBLE + s * (CASE WHEN s < 0 THEN 2.2::DOUBLE ELSE 0.6::DOUBLE END) * (x2 - x1)) AS INT)) AS x1, greatest(0, CAST(trunc(y2 + 1.0::DOUBLE * (y2 - y1)) AS INT)) AS y1,
  least({WIDTH}, CAST(trunc((x1 + x2) / 2.0::DOUBLE + s * (CASE WHEN s < 0 THEN 0.6::DOUBLE ELSE 2.2::DOUBLE END) * (x2 - x1)) AS INT)) AS x2, least({HEIGHT}, CAST(trunc(y2 + 3.0::DOUBLE * (y2 - y1)) AS INT)) AS y2
  FROM face, (VALUES (-1), (1)) t(s))"""


@query(f"""WITH {FACE}, {BANDS}, ok AS (SELECT * FROM bands WHERE x2 > x1 AND y2 > y1), cov AS (SELECT image, sum({AREA.format(b='ok')}) / {float(WIDTH * HEIGHT)}::DOUBLE AS c FROM ok GROUP BY image)
SELECT image, ok.x1, ok.y1, ok.x2, ok.y2 FROM ok JOIN cov USING (image) WHERE c <= 0.30::DOUBLE""")
def hand_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands beside the faces of an image; none where they cover too much of the frame."""
    zones = ordered(faces(spark, sf_dir)).select("image", F.flatten(F.transform("boxes", lambda b: B.hand_zones(b, *frame()))).alias("zones"))
    return zones.filter(B.coverage(F.col("zones"), *frame()) <= B.HAND_COVERAGE).select("image", F.inline("zones"))


@query(f"""WITH {FACE}, n AS (SELECT *, row_number() OVER (PARTITION BY image {ORDER}) AS at FROM face)
SELECT e.image, e.x1, e.y1, e.x2, e.y2 FROM n e WHERE e.at > 2 AND {AREA.format(b='e')} > 0 AND NOT EXISTS (SELECT 1 FROM n p WHERE p.image = e.image AND p.at <= 2 AND {OVER.format(a='p', b='e')} >= 0.7::DOUBLE * {AREA.format(b='e')})""")
def region_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two boxes of an image are primary, the others extra."""
    split = ordered(faces(spark, sf_dir)).select("image", F.slice("boxes", 1, 2).alias("p"), F.slice("boxes", F.lit(3), F.greatest(F.lit(0), F.size("boxes") - 2)).alias("e"))
    return split.select("image", F.inline(B.dedupe(F.col("p"), F.col("e"))))


@query(f"""WITH {FACE}, {PADDED} SELECT image, min(px1) AS x1, min(py1) AS y1, max(px2) AS x2, max(py2) AS y2 FROM padded GROUP BY image""")
def region_union_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = faces(spark, sf_dir).select("image", B.pad_and_clip(F.col("box"), 1.5, *frame()).alias("p"))
    return p.groupBy("image").agg(F.min("p.x1").alias("x1"), F.min("p.y1").alias("y1"), F.max("p.x2").alias("x2"), F.max("p.y2").alias("y2"))


def sql_merged(source: str, order: str) -> str:
    """CTE m (image, bs): the boxes of source merged in passes until a pass leaves no box less."""
    hit = f"list_position(list_transform(acc, lambda k: {sql_iou('k', 'e[1]')} >= 0.2::DOUBLE), true)"
    both = "{'x1': least(k.x1, e[1].x1), 'y1': least(k.y1, e[1].y1), 'x2': greatest(k.x2, e[1].x2), 'y2': greatest(k.y2, e[1].y2)}"
    once = f"list_reduce(list_transform(bs, lambda x: [x]), lambda acc, e: CASE WHEN {hit} > 0 THEN list_transform(acc, lambda k, i: CASE WHEN i = {hit} THEN {both} ELSE k END) ELSE list_concat(acc, e) END)"
    return f"""l AS (SELECT image, list({{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} {order}) AS bs FROM {source} GROUP BY image),
r AS (SELECT image, bs, CAST(-1 AS BIGINT) AS before FROM l UNION ALL SELECT image, {once}, len(bs) FROM r WHERE len(bs) <> before),
m AS (SELECT image, bs FROM r WHERE len(bs) = before)"""


@query(f"""WITH RECURSIVE {FACE}, {PADDED}, p AS (SELECT image, conf, x2 - x1 AS w, y2 - y1 AS h, x1 AS fx1, y1 AS fy1, x2 AS fx2, y2 AS fy2, px1 AS x1, py1 AS y1, px2 AS x2, py2 AS y2 FROM padded),
{sql_merged('p', 'ORDER BY conf DESC, w * h DESC, fx1, fy1, fx2, fy2')}
SELECT image, CAST(i - 1 AS INT) AS at, bs[i].x1 AS x1, bs[i].y1 AS y1, bs[i].x2 AS x2, bs[i].y2 AS y2 FROM (SELECT image, bs, unnest(range(1, len(bs) + 1)) AS i FROM m)""")
def box_merge_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padded boxes merged until no two overlap by a fifth."""
    arrays = ordered(faces(spark, sf_dir)).select("image", F.transform("boxes", lambda b: B.pad_and_clip(b, 1.5, *frame())).alias("boxes"))
    return listed(arrays, B.merge_overlapping(F.col("boxes"), B.HAND_MERGE_IOU, F.size("boxes")))


@query("""WITH RECURSIVE t AS (SELECT vec_id, i, embedding[i + 1] > 0.1::FLOAT AS hot FROM (SELECT vec_id, embedding, unnest(range(0, 64)) AS i FROM embeddings)),
h AS (SELECT vec_id, i FROM t WHERE hot),
e AS (SELECT a.vec_id, a.i AS a, b.i AS b FROM h a JOIN h b ON a.vec_id = b.vec_id AND abs(a.i // 8 - b.i // 8) <= 1 AND abs(a.i % 8 - b.i % 8) <= 1),
r AS (SELECT vec_id, i, i AS label FROM h UNION SELECT e.vec_id, e.b, r.label FROM r JOIN e ON r.vec_id = e.vec_id AND r.i = e.a),
l AS (SELECT vec_id, i, min(label) AS label FROM r GROUP BY vec_id, i)
SELECT vec_id, CAST(label AS INT) AS label, count(*) AS tiles, CAST(min(i // 8) AS INT) AS top, CAST(max(i // 8) AS INT) AS bottom, CAST(min(i % 8) AS INT) AS first, CAST(max(i % 8) AS INT) AS last FROM l GROUP BY vec_id, label HAVING count(*) >= 2""")
def tile_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8-connected clusters of two or more hot tiles of an 8x8 grid, labelled by their least tile.

    Least labels spread to the neighbours in a fold within the row; 32 rounds reach the ends of any path of an 8x8 grid.
    """
    hot = F.transform("embedding", lambda v, i: F.when(v > F.lit(0.1).cast("float"), i))

    def spread(labels: Column, _: Column) -> Column:
        def least(v: Column, i: Column) -> Column:
            near = []
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    inside = (F.floor(i / 8) + dy).between(0, 7) & (i % 8 + dx).between(0, 7)
                    near.append(F.when(inside, F.get(labels, i + 8 * dy + dx)))
            return F.when(v.isNotNull(), F.least(*near))

        return F.transform(labels, least)

    labels = F.aggregate(F.sequence(F.lit(1), F.lit(32)), hot, spread)
    tiles = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(labels).alias("i", "label")).filter("label IS NOT NULL")
    row, column = F.floor(F.col("i") / 8).cast("int"), (F.col("i") % 8).cast("int")
    found = tiles.groupBy("vec_id", "label").agg(F.count("*").alias("tiles"), F.min(row).alias("top"), F.max(row).alias("bottom"), F.min(column).alias("first"), F.max(column).alias("last"))
    return found.filter("tiles >= 2")


@query(f"""WITH {FACE}, s AS (SELECT image, count(*) AS n, min(least(x2 - x1, y2 - y1)) AS small, max(conf) AS detail, CASE WHEN count(*) = 1 THEN 0.25::DOUBLE ELSE 0.125::DOUBLE END AS base FROM face GROUP BY image),
r AS (SELECT *, CASE WHEN small > 0 AND small < 0.06::DOUBLE * {HEIGHT} THEN 'small face' WHEN detail > 0.08::DOUBLE THEN 'detail' END AS why FROM s)
SELECT image, CASE WHEN why IS NOT NULL THEN greatest(base, 0.25::DOUBLE) ELSE base END AS scale, CASE WHEN base < 0.25::DOUBLE THEN why END AS reason FROM r""")
def scale_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The background's scale, raised to a floor by small faces or detail, and why if it was raised."""
    w, h = F.col("box.x2") - F.col("box.x1"), F.col("box.y2") - F.col("box.y1")
    s = faces(spark, sf_dir).groupBy("image").agg(F.count("*").alias("n"), F.min(F.least(w, h)).alias("small"), F.max("conf").alias("detail"))
    base = F.when(F.col("n") == 1, 0.25).otherwise(0.125)
    why = F.when((F.col("small") > 0) & (F.col("small") < 0.06 * HEIGHT), "small face").when(F.col("detail") > 0.08, "detail")
    return s.select("image", F.when(why.isNotNull(), F.greatest(base, F.lit(0.25))).otherwise(base).alias("scale"), F.when(base < 0.25, why).alias("reason"))


MANIFEST_SQL = f"""WITH {FACE}, n AS (SELECT *, row_number() OVER (PARTITION BY image {ORDER}) - 1 AS pos FROM face)
SELECT image, CAST(pos AS INT) AS id, x1, y1, x2, y2, conf FROM n"""


@query(MANIFEST_SQL)
def manifest_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces written to a JSON manifest and read back under a declared schema."""
    keyed = F.struct((-F.col("conf")).alias("c"), (-B.area(F.col("box"))).alias("a"), F.col("box").alias("b"))
    ranked = faces(spark, sf_dir).groupBy("image").agg(F.sort_array(F.collect_list(keyed)).alias("f"))
    entries = F.transform("f", lambda e, i: F.struct(i.alias("id"), F.array(e["b"]["x1"], e["b"]["y1"], e["b"]["x2"], e["b"]["y2"]).alias("bbox"), (-e["c"]).alias("confidence")))
    text = F.to_json(F.struct(F.lit("1.11.0").alias("version"), entries.alias("faces")))
    read = F.from_json(text, "version string, faces array<struct<id:int,bbox:array<int>,confidence:double>>")
    rows = ranked.select("image", read.alias("m")).select("image", F.inline("m.faces"))
    return rows.select("image", "id", *[F.get("bbox", F.lit(i)).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))], F.col("confidence").alias("conf"))


@query(f"""WITH {FACE}, n AS (SELECT *, row_number() OVER (PARTITION BY image {ORDER}) - 1 AS pos FROM face),
p AS (SELECT image, CASE WHEN (image + pos) % 7 = 0 THEN 'missing crop' END AS a, CASE WHEN NOT (x2 > x1 AND y2 > y1 AND (image + pos) % 11 <> 0) THEN 'malformed bbox' END AS b FROM n)
SELECT image, count(a) + count(b) AS n_problems, count(a) + count(b) = 0 AS ok FROM p GROUP BY image""")
def container_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared faces against the crops that a container has; every problem counts."""
    arrays = ordered(faces(spark, sf_dir)).select("image", F.transform("boxes", lambda b, i: F.struct(i.alias("i"), F.when((F.col("image") + i) % 11 == 0, F.array(b["x2"], b["y1"], b["x1"], b["y2"])).otherwise(F.array(b["x1"], b["y1"], b["x2"], b["y2"])).alias("bbox"))).alias("faces"))
    crops = F.transform(F.filter("faces", lambda f: (F.col("image") + f["i"]) % 7 != 0), lambda f: f["i"])
    missing = F.transform(F.array_except(F.transform("faces", lambda f: f["i"]), crops), lambda i: F.concat(F.lit("face "), i.cast("string"), F.lit(": missing crop")))
    broken = F.transform(F.filter("faces", lambda f: ~B.well_formed(f["bbox"])), lambda f: F.concat(F.lit("face "), f["i"].cast("string"), F.lit(": malformed bbox")))
    problems = F.concat(missing, broken)
    return arrays.select("image", F.size(problems).cast("long").alias("n_problems"), (F.size(problems) == 0).alias("ok"))


@query(f"""WITH {FACE}, {PADDED} SELECT image, px1 AS x1, py1 AS y1, px2 AS x2, py2 AS y2 FROM padded
WHERE least(x2 - x1, y2 - y1) > 0 AND least(x2 - x1, y2 - y1) < 0.06::DOUBLE * {min(WIDTH, HEIGHT)} AND px2 > px1 AND py2 > py1""")
def risky_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padded boxes of the small faces of an image."""
    arrays = faces(spark, sf_dir).groupBy("image").agg(F.collect_list("box").alias("boxes"))
    padded = F.transform("boxes", lambda b: B.pad_and_clip(b, 1.5, *frame()))
    return arrays.select("image", F.inline(B.risky_regions(F.col("boxes"), padded, *frame(), 0.06)))


@query(f"""WITH RECURSIVE {FACE}, n AS (SELECT *, row_number() OVER (PARTITION BY image {ORDER}) AS nth FROM face),
bands AS (SELECT image, nth, s, greatest(0, CAST(trunc((x1 + x2) / 2.0::DOUBLE + s * (CASE WHEN s < 0 THEN 2.2::DOUBLE ELSE 0.6::DOUBLE END) * (x2 - x1)) AS INT)) AS x1, greatest(0, CAST(trunc(y2 + 1.0::DOUBLE * (y2 - y1)) AS INT)) AS y1,
  least({WIDTH}, CAST(trunc((x1 + x2) / 2.0::DOUBLE + s * (CASE WHEN s < 0 THEN 0.6::DOUBLE ELSE 2.2::DOUBLE END) * (x2 - x1)) AS INT)) AS x2, least({HEIGHT}, CAST(trunc(y2 + 3.0::DOUBLE * (y2 - y1)) AS INT)) AS y2
  FROM n, (VALUES (-1), (1)) t(s)), ok AS (SELECT * FROM bands WHERE x2 > x1 AND y2 > y1),
{sql_merged('ok', 'ORDER BY nth, s')},
g AS (SELECT image, unnest(bs) AS b FROM m WHERE image % 3 <> 0 AND list_sum(list_transform(bs, lambda b: CAST(b.x2 - b.x1 AS BIGINT) * (b.y2 - b.y1))) / {float(WIDTH * HEIGHT)}::DOUBLE <= 0.30::DOUBLE)
SELECT image, b.x1 AS x1, b.y1 AS y1, b.x2 AS x2, b.y2 AS y2 FROM g UNION ALL SELECT image, x1, y1, x2, y2 FROM n WHERE image % 3 = 0 AND nth = 1""")
def hand_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hands of a detector (in every third image the first box stands for one), else the merged bands beside the faces."""
    arrays = ordered(faces(spark, sf_dir))
    found = F.when(F.col("image") % 3 == 0, F.slice("boxes", 1, 1)).otherwise(F.array().cast(B.BOXES))
    return arrays.select("image", F.inline(B.hand_regions(found, F.col("boxes"), *frame())))


@query(f"WITH {FACE}, f AS (SELECT image, x1 % 3 AS frame, count(*) FILTER (WHERE conf > 0.02::DOUBLE) AS n FROM face GROUP BY image, x1 % 3) SELECT image, CAST(max(n) AS INT) AS faces FROM f GROUP BY image")
def clip_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most faces of a sampled frame of each clip."""
    sure = F.collect_list(F.when(F.col("conf") > 0.02, F.col("box")))
    frames = faces(spark, sf_dir).groupBy("image", (F.col("box.x1") % 3).alias("frame")).agg(sure.alias("faces")).withColumnsRenamed({"image": "path"})
    return detectors.faces_in_clips(frames).withColumnsRenamed({"path": "image"})
