"""Queries on header groups, alignment, lookups, class columns, annotations and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.functions.scalar import stable
from fieldloom.operators import evaluation as ev
from fieldloom.operators import relational as rel
from fieldloom.plans.catalogue import query
from fieldloom.plans.object_plans import _BOUND_COUNTS, _RASTER, _bound, _bound_counts
from fieldloom.sources.views import CUBE, FIELDS, INST, PX, cube, fields, instances, pixels, table

_CLASSES = [f"cls_{k}" for k in range(5)]


def _grouped(spark, sf_dir):
    """The field table under its two-level header."""
    return fields(spark, sf_dir).select(F.struct("tile_id", "field_id").alias("meta"), F.struct("area", "n_lines", "agri").alias("stats"), F.struct(*_CLASSES).alias("clc"))


@query("drop_header_group", f"WITH {FIELDS} SELECT tile_id, field_id, area, n_lines, agri FROM fields")
def drop_header_group(spark, sf_dir):
    return rel.meta_first(rel.without_groups(_grouped(spark, sf_dir), "clc"), ["field_id", "tile_id"])


@query("categorical_conjunction", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7")
def categorical_conjunction(spark, sf_dir):
    return table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING' AND c_nationkey = 7").select("c_custkey")


@query("drop_null_rows", f"WITH {PX} SELECT tile, r, c, gt, pred FROM px WHERE gt IS NOT NULL AND pred IS NOT NULL")
def drop_null_rows(spark, sf_dir):
    return pixels(spark, sf_dir).select("tile", "r", "c", "gt", "pred").na.drop()


_AREAS = f"WITH {PX}, g AS (SELECT tile, gt AS label, count(*) AS gt_area FROM px WHERE gt IS NOT NULL GROUP BY ALL), p AS (SELECT tile, pred AS label, count(*) AS pred_area FROM px WHERE pred IS NOT NULL GROUP BY ALL)"


def _areas(spark, sf_dir, label):
    px = pixels(spark, sf_dir).where(F.col(label).isNotNull())
    return px.groupBy("tile", F.col(label).alias("label")).agg(F.count("*").alias(f"{label}_area"))


@query("aligned_columns", _AREAS + " SELECT tile, label, gt_area, pred_area FROM g FULL JOIN p USING (tile, label)")
def aligned_columns(spark, sf_dir):
    return rel.aligned(_areas(spark, sf_dir, "gt"), _areas(spark, sf_dir, "pred"), ["tile", "label"])


@query("reindexed_labels", _AREAS + ", k AS (SELECT DISTINCT tile, unnest(range(1, 19)) AS label FROM px) SELECT tile, label, gt_area FROM k LEFT JOIN g USING (tile, label)")
def reindexed_labels(spark, sf_dir):
    keys = pixels(spark, sf_dir).select("tile").distinct().withColumn("label", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(18).cast("long"))))
    return rel.reindexed(_areas(spark, sf_dir, "gt"), keys, ["tile", "label"])


@query("coregistered_raster", f"""WITH {PX}, co AS (SELECT tile, r // 3 AS cr, c // 3 AS cc, value AS coarse FROM px WHERE r % 3 = 0 AND c % 3 = 0), la AS (SELECT tile, max(cr) AS lr, max(cc) AS lc FROM co GROUP BY tile)
SELECT px.tile, r, c, coarse FROM px JOIN la USING (tile) LEFT JOIN co ON co.tile = px.tile AND cr = least(CAST(floor(r / 3 + 0.5) AS BIGINT), lr) AND cc = least(CAST(floor(c / 3 + 0.5) AS BIGINT), lc)""")
def coregistered_raster(spark, sf_dir):
    px = pixels(spark, sf_dir)
    coarse = px.where("r % 3 = 0 AND c % 3 = 0").selectExpr("tile", "r div 3 AS cr", "c div 3 AS cc", "value AS coarse")
    return rel.coregistered(px.select("tile", "r", "c"), coarse, 3)


@query("uid_of_tiles", f"""WITH {PX}, u AS (SELECT s_suppkey - 1 AS tile, CAST((s_nationkey + 1) || lpad(CAST(s_suppkey AS VARCHAR), 7, '0') AS BIGINT) AS uid FROM supplier)
SELECT tile, uid, count(gt) AS labelled FROM px LEFT JOIN u USING (tile) GROUP BY tile, uid""")
def uid_of_tiles(spark, sf_dir):
    """One join instead of a lookup for each tile."""
    from fieldloom.functions.scalar import country_uid

    uids = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") - 1).alias("tile"), country_uid((F.col("s_nationkey") + 1).cast("long"), F.col("s_suppkey")).alias("uid"))
    return pixels(spark, sf_dir).groupBy("tile").agg(F.count("gt").alias("labelled")).join(uids, "tile", "left")


@query("annotation_lists", """WITH a AS (SELECT l_orderkey AS o_orderkey, string_agg(l_partkey || ':' || l_linenumber || ':' || CAST(l_quantity AS BIGINT), ';' ORDER BY l_partkey, l_linenumber, CAST(l_quantity AS BIGINT)) AS annotations, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT o_orderkey, coalesce(annotations, '') AS annotations, coalesce(n, 0) AS n FROM orders LEFT JOIN a USING (o_orderkey)""")
def annotation_lists(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"))
    listed = rel.annotated_images(table(spark, sf_dir, "orders").select("o_orderkey"), lines, "o_orderkey", ["l_partkey", "l_linenumber", "q"])
    shown = F.array_join(F.transform("annotations", lambda x: F.concat_ws(":", x["l_partkey"], x["l_linenumber"], x["q"])), ";")
    return listed.select("o_orderkey", shown.alias("annotations"), F.size("annotations").cast("long").alias("n"))


_FULL = f"""WITH {FIELDS}, k AS (SELECT * FROM fields WHERE area > 25 AND n_lines > 1 AND agri / area > 0.1 AND n_lines <= 5 AND coalesce(cls_1, 0) + coalesce(cls_4, 0) <= 2),
t AS (SELECT tile_id, count(*) AS n_fields, coalesce(sum(cls_2 + cls_3 + cls_0), 0) / sum(area) AS agri_share, sum(area) / 65536 AS field_share FROM k GROUP BY tile_id
  HAVING coalesce(sum(cls_2 + cls_3 + cls_0), 0) / sum(area) >= 0.025 AND sum(area) / 65536 >= 0.1 AND count(*) >= 5)"""


def _quality(spark, sf_dir):
    """The columns that stand for shape: lines for the minor axis and the Euler number, the share of one class for solidity."""
    named = fields(spark, sf_dir).withColumns({"axis_minor": F.col("n_lines"), "solidity": F.col("agri") / F.col("area"), "euler_8": F.col("n_lines")})
    return rel.field_quality(named, 25, 1, 0.1, 5, ["cls_1", "cls_4"], 2)


@query("field_quality_all_terms", _FULL + " SELECT tile_id, field_id, area FROM k")
def field_quality_all_terms(spark, sf_dir):
    return _quality(spark, sf_dir).select("tile_id", "field_id", "area")


@query("tile_having_all_terms", _FULL + " SELECT tile_id, n_fields, round(agri_share + 1e-9, 6) AS agri_share, round(field_share + 1e-9, 6) AS field_share FROM t")
def tile_having_all_terms(spark, sf_dir):
    found = rel.tile_filter(_quality(spark, sf_dir), ["cls_2", "cls_3", "cls_0"], 65536, 0.025, 0.1, 5)
    return found.select("tile_id", "n_fields", stable("agri_share").alias("agri_share"), stable("field_share").alias("field_share"))


@query("curated_fields_all_terms", _FULL + " SELECT tile_id, field_id FROM k WHERE tile_id IN (SELECT tile_id FROM t)")
def curated_fields_all_terms(spark, sf_dir):
    kept = _quality(spark, sf_dir)
    return kept.join(rel.tile_filter(kept, ["cls_2", "cls_3", "cls_0"], 65536, 0.025, 0.1, 5), "tile_id", "left_semi").select("tile_id", "field_id")


@query("classwise_precision", f"""WITH {PX}, n AS (SELECT tile, gt % 4 AS class, CASE WHEN count(*) FILTER (pred IS NOT NULL) > 0 THEN count(*) FILTER (pred = gt) / count(*) FILTER (pred IS NOT NULL) ELSE -1 END AS p FROM px WHERE gt IS NOT NULL GROUP BY ALL)
SELECT class, round(avg(p) FILTER (p > -1) + 1e-9, 6) AS ap FROM n GROUP BY class""")
def classwise_precision(spark, sf_dir):
    hits, seen = F.count_if(F.col("pred") == F.col("gt")), F.count("pred")
    by_tile = pixels(spark, sf_dir).where("gt IS NOT NULL").groupBy("tile", (F.col("gt") % 4).alias("class")).agg(F.when(seen > 0, hits / seen).otherwise(-1.0).alias("p"))
    return by_tile.groupBy("class").agg(stable(rel.mean_precision("p")).alias("ap"))


@query("mean_tile_loss", _RASTER + f""", n AS (SELECT tile, {_BOUND_COUNTS} FROM rs GROUP BY tile),
l AS (SELECT -tp / nullif(tp + 0.5 * (fp + fn), 0) AS loss FROM n WHERE tile % 7 <> 0 UNION ALL SELECT NULL FROM n WHERE tile % 7 = 0)
SELECT round(avg(coalesce(loss, 0)) + 1e-9, 6) AS loss, count(*) AS tiles FROM l""")
def mean_tile_loss(spark, sf_dir):
    scores = _bound_counts(spark, sf_dir).select(F.when(F.col("tile") % 7 != 0, -F.col("f1")).alias("loss"))
    return scores.agg(stable(rel.mean_loss("loss")).alias("loss"), F.count("*").alias("tiles"))


@query("cv_mean_scores", "SELECT event_id % 6 AS param, round(avg(value) + 1e-9, 6) AS mean_score, count(*) AS folds, rank() OVER (ORDER BY avg(value) DESC) AS place FROM events GROUP BY 1")
def cv_mean_scores(spark, sf_dir):
    """Mean of scores by parameter over folds, with the place of each; a row for each parameter is ranked."""
    from pyspark.sql import Window

    means = table(spark, sf_dir, "events").groupBy((F.col("event_id") % 6).alias("param")).agg(F.avg("value").alias("m"), F.count("*").alias("folds"))
    return means.select("param", stable("m").alias("mean_score"), "folds", F.rank().over(Window.orderBy(F.desc("m"))).cast("long").alias("place"))


@query("sorted_index", f"WITH {FIELDS} SELECT tile_id, field_id FROM fields ORDER BY tile_id, field_id")
def sorted_index(spark, sf_dir):
    return fields(spark, sf_dir).select("tile_id", "field_id").orderBy("tile_id", "field_id")


@query("segment_subset", f"""WITH {PX}, s AS (SELECT DISTINCT tile * 100 + gt AS segment FROM px WHERE gt IS NOT NULL), d AS (SELECT segment FROM s ORDER BY md5(segment || ':42'), segment LIMIT 50)
SELECT tile, r, c, tile * 100 + gt AS segment FROM px WHERE tile * 100 + gt IN (SELECT segment FROM d)""")
def segment_subset(spark, sf_dir):
    px = pixels(spark, sf_dir).select("tile", "r", "c", (F.col("tile") * 100 + F.col("gt")).alias("segment"))
    return rel.segment_subset(px, "segment", 50, 42)


_CAT = f"boxes AS (SELECT inst, x0 - 3 AS x, y0 - 3 AS y, w - 5 AS w, h - 5 AS h, (w - 5) * (h - 5) AS area, inst % 11 = 0 AS ignore, CAST(inst % 4 AS INT) AS category FROM inst)"


@query("valid_annotations", f"""WITH {INST}, {_CAT} SELECT inst, x, y, x + w AS x1, y + h AS y1 FROM boxes WHERE NOT ignore AND greatest(0, least(x + w, 96) - greatest(x, 0)) * greatest(0, least(y + h, 96) - greatest(y, 0)) <> 0
AND area > 0 AND w >= 1 AND h >= 1 AND category IN (0, 1, 2)""")
def valid_annotations(spark, sf_dir):
    boxes = instances(spark, sf_dir).selectExpr("inst", "x0 - 3 AS x", "y0 - 3 AS y", "w - 5 AS w", "h - 5 AS h", "(w - 5) * (h - 5) AS area", "inst % 11 = 0 AS ignore", "int(inst % 4) AS category")
    return rel.valid_annotations(boxes, 96, 96, [0, 1, 2]).selectExpr("inst", "x", "y", "x + w AS x1", "y + h AS y1")


@query("usable_images", "SELECT p_partkey FROM part WHERE least(p_size, CAST(p_retailprice AS BIGINT) % 60) >= 12 AND p_partkey IN (SELECT l_partkey FROM lineitem)")
def usable_images(spark, sf_dir):
    images = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("width"), (F.round("p_retailprice").cast("long") % 60).alias("height"))
    return rel.usable_images(images, table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", 12).select("p_partkey")


@query("concatenated_arrays", f"WITH {PX}, u AS (SELECT tile, gt AS label FROM px WHERE gt IS NOT NULL AND r % 4 = 0 AND c % 4 = 0 UNION ALL SELECT tile, pred FROM px WHERE pred IS NOT NULL AND r % 5 = 0 AND c % 5 = 0) SELECT tile, string_agg(label, ',' ORDER BY label) AS labels FROM u GROUP BY tile")
def concatenated_arrays(spark, sf_dir):
    """Arrays of two sources by tile, concatenated."""
    px = pixels(spark, sf_dir)
    lists = lambda label, k: px.where(f"{label} IS NOT NULL AND r % {k} = 0 AND c % {k} = 0").groupBy("tile").agg(F.collect_list(label).alias("part"))
    both = lists("gt", 4).unionByName(lists("pred", 5)).groupBy("tile").agg(F.flatten(F.collect_list("part")).alias("labels"))
    return both.select("tile", F.array_join(F.sort_array("labels"), ",").alias("labels"))


@query("path_functions", "SELECT p_partkey, replace(p_brand, '#', '_') AS brand, ends_with(p_type, 'L') AS l, 'data/' || p_brand || '/' || p_partkey || '.tif' AS path, p_partkey || '.tif' AS base, CAST(p_partkey AS VARCHAR) AS stem FROM part")
def path_functions(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    path = F.concat_ws("/", F.lit("data"), "p_brand", F.concat(F.col("p_partkey").cast("string"), F.lit(".tif")))
    base = F.substring_index(path, "/", -1)
    return p.select("p_partkey", F.replace("p_brand", F.lit("#"), F.lit("_")).alias("brand"), F.endswith("p_type", F.lit("L")).alias("l"), path.alias("path"), base.alias("base"), F.regexp_replace(base, "\\.tif$", "").alias("stem"))


_CODES = {"AFRICA": 1, "AMERICA": 2, "ASIA": 3, "EUROPE": 4}


@query("dictionary_lookup", "SELECT r_name, CASE r_name " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _CODES.items()) + " END AS code FROM region")
def dictionary_lookup(spark, sf_dir):
    """Look a value up in a fixed dictionary; a value that it lacks is null."""
    codes = F.create_map(*[F.lit(x) for pair in _CODES.items() for x in pair])
    return table(spark, sf_dir, "region").select("r_name", F.try_element_at(codes, "r_name").alias("code"))


@query("net_input_scaling", f"WITH {CUBE} SELECT id, " + ", ".join(f"CAST(floor(255 * greatest(least(coalesce(ndvi[{k}], -1.0) * 0.5 + 0.5, 1.0), 0.0)) AS INT) AS n_{k}" for k in range(1, 7)) + " FROM cube")
def net_input_scaling(spark, sf_dir):
    return cube(spark, sf_dir).select("id", *[rel.net_input(F.get("ndvi", F.lit(k - 1))).alias(f"n_{k}") for k in range(1, 7)])


@query("box_centres", f"WITH {INST} SELECT inst, x0 + w / 2 AS x, y0 + h / 2 AS y, x0 + w / 2 - 25 AS left_, x0 + w / 2 + 25 AS right_ FROM inst")
def box_centres(spark, sf_dir):
    x, y = rel.box_centre("box")
    boxes = instances(spark, sf_dir).select("inst", F.struct("x0", "y0", "w", "h").alias("box"))
    return boxes.select("inst", x.alias("x"), y.alias("y"), (x - 25).alias("left_"), (x + 25).alias("right_"))


@query("coco_documents", f"""WITH {PX}, a AS (SELECT tile, gt AS id, count(*) AS area, min(c) AS x, min(r) AS y, max(c) - min(c) + 1 AS w, max(r) - min(r) + 1 AS h FROM px WHERE gt IS NOT NULL GROUP BY ALL)
SELECT tile, '{{"image_id":' || tile || ',"annotations":[' || string_agg('{{"id":' || id || ',"category_id":1,"bbox":[' || x || ',' || y || ',' || w || ',' || h || '],"area":' || area || '}}', ',' ORDER BY id) || ']}}' AS document FROM a GROUP BY tile""")
def coco_documents(spark, sf_dir):
    px = pixels(spark, sf_dir)
    own = ev.annotations(px, "gt", 65536).select("tile", F.col("label").alias("id"), F.lit(1).alias("category_id"), F.array("x", "y", "w", "h").alias("bbox"), "area")
    return rel.coco_document(px.select("tile").distinct(), own, "tile")


@query("run_names", "SELECT o_orderkey, 'run_' || strftime(o_orderdate, '%Y%m%d_%H%M%S') AS name FROM orders")
def run_names(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", rel.run_name("run", F.col("o_orderdate")).alias("name"))


@query("rescored_instances", f"WITH {INST} SELECT inst, round(score * least(w, h) / greatest(w, h) + 1e-9, 6) AS score FROM inst")
def rescored_instances(spark, sf_dir):
    """The class score times the quality of the mask, here the ratio of its sides."""
    return instances(spark, sf_dir).select("inst", stable(F.col("score") * (F.least("w", "h") / F.greatest("w", "h"))).alias("score"))


_BITS = "list_transform(range(1, len(embedding) // 2 + 1), lambda k: {0})"


@query("mask_iou_targets", """WITH m AS (SELECT vec_id, list_transform(embedding[1:32], lambda x: CASE WHEN x >= 0.05 THEN 1 ELSE 0 END) AS p, list_transform(embedding[33:64], lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS t FROM embeddings),
s AS (SELECT vec_id, list_sum(list_transform(range(1, 33), lambda k: p[k] * t[k])) AS b, list_sum(list_transform(range(1, 33), lambda k: greatest(p[k], t[k]))) AS e FROM m)
SELECT vec_id, round(CASE WHEN e > 0 THEN b / e END + 1e-9, 6) AS iou FROM s""")
def mask_iou_targets(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double")))
    return e.select("vec_id", stable(rel.mask_iou_target(F.slice("v", 1, 32), F.slice("v", 33, 32), 0.05)).alias("iou"))


@query("region_raster", f"WITH {INST}, ce AS (SELECT tile, inst, unnest(range(x0 // 10, (x0 + w - 1) // 10 + 1)) AS cx, y0, h FROM inst), c2 AS (SELECT tile, inst, cx, unnest(range(y0 // 10, (y0 + h - 1) // 10 + 1)) AS cy FROM ce) SELECT tile, cx, cy, max(inst) AS region FROM c2 GROUP BY ALL")
def region_raster(spark, sf_dir):
    """Regions drawn on a coarse grid; where several meet a cell, the one with the highest number wins."""
    cells = instances(spark, sf_dir).withColumn("cx", F.explode(F.expr("sequence(x0 div 10, (x0 + w - 1) div 10)"))).withColumn("cy", F.explode(F.expr("sequence(y0 div 10, (y0 + h - 1) div 10)")))
    return cells.groupBy("tile", "cx", "cy").agg(F.max("inst").alias("region"))


_GOOD = f"""WITH {PX}, gd AS (SELECT tile, gt FROM px WHERE gt IS NOT NULL GROUP BY ALL HAVING count(*) > 10),
fb AS (SELECT tile, r, c, CASE WHEN gd.gt IS NOT NULL THEN px.gt END AS gt, value FROM px LEFT JOIN gd USING (tile, gt)), {_bound('gt', 'bound', 'fb')}"""


@query("filtered_label_bands", _GOOD + " SELECT tile, r, c, gt, CASE WHEN gt IS NOT NULL THEN 1 ELSE 0 END AS extent, CASE WHEN gt IS NOT NULL THEN value ELSE 0 END AS dist, bound FROM bound")
def filtered_label_bands(spark, sf_dir):
    px = pixels(spark, sf_dir).select("tile", "r", "c", "gt", F.lit(1).alias("extent"), F.col("value").alias("dist"))
    good = px.where("gt IS NOT NULL").groupBy("tile", "gt").count().where("count > 10")
    return rel.filtered_bands(px, good)


@query("group_kfold_rows", "SELECT count(*) AS n, 15 * (SELECT count(*) FROM embeddings) AS rows FROM (SELECT DISTINCT label FROM embeddings)")
def group_kfold_rows(spark, sf_dir):
    """Groups that are test in exactly one fold of each of three repeats, and all train and test rows."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    folds = rel.balanced_group_folds(e.groupBy("label").agg(F.count("*").alias("n")), "label", "n", 5, 3)
    rows = rel.train_test_rows(e, folds, "label", 5)
    by_group = rows.groupBy("label", "repeat").agg(F.countDistinct(F.when(F.col("is_test"), F.col("fold"))).alias("tests"), F.count("*").alias("rows"))
    return by_group.agg(F.countDistinct(F.when(F.col("tests") == 1, F.col("label"))).alias("n"), F.sum("rows").alias("rows"))
