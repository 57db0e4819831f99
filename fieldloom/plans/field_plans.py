"""Queries on the field view and the dimension tables: curation, crosstabs, joins, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.functions.scalar import stable
from fieldloom.operators import curation as cu
from fieldloom.plans.catalogue import query
from fieldloom.sources.views import CUBE, FIELDS, PX, cube, fields, pixels, table

_KEPT = f"WITH {FIELDS}, k AS (SELECT * FROM fields WHERE area > 60 AND coalesce(cls_0, 0) + coalesce(cls_1, 0) <= 2)"
_TILES = _KEPT + ", t AS (SELECT tile_id, count(*) AS n_fields, coalesce(sum(agri), 0.0) / sum(area) AS agri_share FROM k GROUP BY tile_id HAVING coalesce(sum(agri), 0.0) / sum(area) >= 0.335 AND count(*) >= 5)"


def _kept(spark, sf_dir):
    return cu.quality_filter(fields(spark, sf_dir), 60, ["cls_0", "cls_1"], 2)


@query("field_quality_filter", _KEPT + " SELECT tile_id, field_id, area, n_lines FROM k")
def field_quality_filter(spark, sf_dir):
    return _kept(spark, sf_dir).select("tile_id", "field_id", "area", "n_lines")


@query("tile_having_filter", _TILES + " SELECT tile_id, n_fields, round(agri_share + 1e-9, 6) AS agri_share FROM t")
def tile_having_filter(spark, sf_dir):
    return cu.tile_thresholds(_kept(spark, sf_dir), 0.335, 5).select("tile_id", "n_fields", stable("agri_share").alias("agri_share"))


@query("curated_fields", _TILES + " SELECT tile_id, field_id, area FROM k WHERE tile_id IN (SELECT tile_id FROM t)")
def curated_fields(spark, sf_dir):
    kept = _kept(spark, sf_dir)
    return kept.join(cu.tile_thresholds(kept, 0.335, 5), "tile_id", "left_semi").select("tile_id", "field_id", "area")


@query("tile_stats", f"WITH {FIELDS} SELECT tile_id, count(*) AS n_fields, sum(area) AS area, round_even(avg(area), 2) AS avg_size, count(DISTINCT n_lines) AS line_kinds FROM fields GROUP BY tile_id")
def tile_stats(spark, sf_dir):
    f = fields(spark, sf_dir)
    return f.groupBy("tile_id").agg(F.count("*").alias("n_fields"), F.sum("area").alias("area"), F.bround(F.avg("area"), 2).alias("avg_size"), F.countDistinct("n_lines").alias("line_kinds"))


@query("zone_class_crosstab", f"""WITH {PX} SELECT tile, gt, nullif(count(*) FILTER (CAST(floor(value) AS BIGINT) % 4 = 0), 0) AS n_0, nullif(count(*) FILTER (CAST(floor(value) AS BIGINT) % 4 = 1), 0) AS n_1,
nullif(count(*) FILTER (CAST(floor(value) AS BIGINT) % 4 = 2), 0) AS n_2, nullif(count(*) FILTER (CAST(floor(value) AS BIGINT) % 4 = 3), 0) AS n_3 FROM px WHERE gt IS NOT NULL GROUP BY tile, gt""")
def zone_class_crosstab(spark, sf_dir):
    return cu.crosstab(pixels(spark, sf_dir).where("gt IS NOT NULL"), ["tile", "gt"], F.floor("value") % 4, [0, 1, 2, 3])


@query("mode_smallest", f"""WITH {PX}, n AS (SELECT tile, CAST(floor(value) AS BIGINT) AS v, count(*) AS n FROM px WHERE value IS NOT NULL GROUP BY ALL)
SELECT tile, v AS mode, n FROM n QUALIFY row_number() OVER (PARTITION BY tile ORDER BY n DESC, v) = 1""")
def mode_smallest(spark, sf_dir):
    return cu.mode_smallest(pixels(spark, sf_dir).withColumn("v", F.floor("value")), ["tile"], "v")


@query("tile_uid", "SELECT s_suppkey, CAST((s_nationkey + 1) || lpad(CAST(s_suppkey AS VARCHAR), 7, '0') AS BIGINT) AS uid, split_part(s_name, '#', 1) AS prefix FROM supplier")
def tile_uid(spark, sf_dir):
    from fieldloom.functions.scalar import country_uid

    s = table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", country_uid((F.col("s_nationkey") + 1).cast("long"), F.col("s_suppkey").cast("long")).alias("uid"), F.element_at(F.split("s_name", "#"), 1).alias("prefix"))


_REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query("env_covariates_onehot", "SELECT c_custkey, " + ", ".join(f"CASE WHEN r_name = '{r}' THEN 1 ELSE 0 END AS \"r_name_{r}\"" for r in _REGIONS) + " FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def env_covariates_onehot(spark, sf_dir):
    """Join of a dimension and its one-hot columns; the dimension has one row for each nation."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    c = table(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return cu.one_hot(c, "r_name", _REGIONS).select("c_custkey", *[f"r_name_{x}" for x in _REGIONS])


@query("dictionary_encode", "SELECT c_mktsegment, min(c_custkey) AS code, count(*) AS n FROM customer GROUP BY c_mktsegment")
def dictionary_encode(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.min("c_custkey").alias("code"), F.count("*").alias("n"))


@query("images_with_annotations", "SELECT o_orderkey, count(l_orderkey) AS n, sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END)::BIGINT AS large FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def images_with_annotations(spark, sf_dir):
    """Every image with its annotations, those without included."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return o.join(l, o.o_orderkey == l.l_orderkey, "left").groupBy("o_orderkey").agg(F.count("l_orderkey").alias("n"), F.count_if(F.col("l_quantity") > 25).alias("large"))


@query("images_without_annotations", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def images_without_annotations(spark, sf_dir):
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return o.join(l, o.o_orderkey == l.l_orderkey, "left_anti").select("o_orderkey")


@query("id_set_operations", "(SELECT l_partkey AS id FROM lineitem INTERSECT SELECT p_partkey FROM part WHERE p_size > 25) UNION (SELECT p_partkey FROM part WHERE p_size < 3)")
def id_set_operations(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    used = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"))
    return used.intersect(p.where("p_size > 25").select("p_partkey")).union(p.where("p_size < 3").select("p_partkey")).distinct()


@query("unique_keys", "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS keys, count(*) = count(DISTINCT o_orderkey) AS is_unique FROM orders")
def unique_keys(spark, sf_dir):
    o = table(spark, sf_dir, "orders").agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("keys"))
    return o.withColumn("is_unique", F.col("n") == F.col("keys"))


@query("concat_with_missing_columns", "SELECT s_suppkey AS id, 'supplier' AS kind, s_nationkey AS nation, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, 'customer', c_nationkey, c_mktsegment FROM customer")
def concat_with_missing_columns(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("nation"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return s.unionByName(c, allowMissingColumns=True)


@query("config_product", "SELECT a.n_name AS a, b.r_name AS b FROM nation a CROSS JOIN region b")
def config_product(spark, sf_dir):
    """All combinations of two configuration lists (25 x 5 rows at any scale)."""
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("a")).crossJoin(table(spark, sf_dir, "region").select(F.col("r_name").alias("b")))


@query("minmax_normalise", "SELECT event_id, round((value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()) + 1e-9, 6) AS value FROM events")
def minmax_normalise(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "value")
    return cu.scaled(e, ["value"], "minmax").select("event_id", stable("value").alias("value"))


@query("zscore", "SELECT event_id, round((value - avg(value) OVER ()) / stddev_samp(value) OVER () + 1e-9, 5) AS value FROM events")
def zscore(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "value")
    return cu.scaled(e, ["value"], "zscore").select("event_id", stable("value", 5).alias("value"))


@query("percentile_thresholds", "SELECT event_id // 256 AS tile, round(quantile_cont(value, 0.1) + 1e-9, 6) AS low, round(quantile_cont(value, 0.9) + 1e-9, 6) AS high FROM events GROUP BY 1")
def percentile_thresholds(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.expr("event_id div 256").alias("tile"))
    return e.agg(stable(F.percentile("value", 0.1)).alias("low"), stable(F.percentile("value", 0.9)).alias("high"))


@query("seeded_sample", """WITH s AS (SELECT unnest([1, 2, 3]) AS seed), m AS (SELECT vec_id, seed, row_number() OVER (PARTITION BY seed ORDER BY md5(vec_id || ':' || seed), vec_id) AS place FROM embeddings, s)
SELECT vec_id, seed, place FROM m WHERE place <= 40""")
def seeded_sample(spark, sf_dir):
    return cu.seeded_sample(table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id", [1, 2, 3], 40)


@query("topk_lowest", "SELECT event_id, value FROM events ORDER BY value, event_id LIMIT 250")
def topk_lowest(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "value").orderBy("value", "event_id").limit(250)


@query("set_overlap", f"""WITH s AS (SELECT unnest([1, 2, 3]) AS seed), m AS (SELECT vec_id, seed, row_number() OVER (PARTITION BY seed ORDER BY md5(vec_id || ':' || seed), vec_id) AS place FROM embeddings, s),
k AS (SELECT vec_id, seed FROM m WHERE place <= 300) SELECT a.seed AS a, b.seed AS b, count(*) AS shared FROM k a JOIN k b ON a.vec_id = b.vec_id AND a.seed < b.seed GROUP BY 1, 2""")
def set_overlap(spark, sf_dir):
    """Sizes of the intersections of samples, by a join on the member and not over pairs of sets."""
    k = cu.seeded_sample(table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id", [1, 2, 3], 300)
    a, b = k.select("vec_id", F.col("seed").alias("a")), k.select("vec_id", F.col("seed").alias("b"))
    return a.join(b, "vec_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


_NEAR = f"""WITH {CUBE}, s AS (SELECT id, label, nir FROM cube WHERE id % 50 = 0),
d AS (SELECT a.id, list_sum(list_transform(range(1, 7), lambda k: (a.nir[k] - b.nir[k]) * (a.nir[k] - b.nir[k]))) AS d2 FROM s a JOIN cube b ON a.label = b.label AND a.id <> b.id),
n AS (SELECT id, min(d2) AS d2 FROM d GROUP BY id)"""


def _near(spark, sf_dir):
    c = cube(spark, sf_dir).select("id", "label", "nir")
    return cu.knn_distances(c.where("id % 50 = 0"), c.withColumnRenamed("id", "other"), "id", "other", "nir", 1, ["label"])


@query("knn1", _NEAR + " SELECT id, round(sqrt(d2) + 1e-9, 6) AS distance FROM n")
def knn1(spark, sf_dir):
    """Nearest neighbour within the class, for a stated query set (every 50th row)."""
    return _near(spark, sf_dir).select("id", stable(F.sqrt("d2")).alias("distance"))


@query("knn2", f"""WITH {CUBE}, s AS (SELECT id, label, nir FROM cube WHERE id % 50 = 0),
d AS (SELECT a.id, b.id AS other, list_sum(list_transform(range(1, 7), lambda k: (a.nir[k] - b.nir[k]) * (a.nir[k] - b.nir[k]))) AS d2 FROM s a JOIN cube b ON a.label = b.label AND a.id <> b.id)
SELECT id, round(sqrt(d2) + 1e-9, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY d2) = 2""")
def knn2(spark, sf_dir):
    """Second nearest neighbour within the class, for the same query set."""
    c = cube(spark, sf_dir).select("id", "label", "nir")
    found = cu.knn_distances(c.where("id % 50 = 0"), c.withColumnRenamed("id", "other"), "id", "other", "nir", 2, ["label"])
    return found.select("id", stable(F.sqrt("d2")).alias("distance"))


@query("kl_divergence", f"""WITH {CUBE}, x AS (SELECT id, nir FROM cube WHERE id % 50 = 0), y AS (SELECT id, nir FROM cube WHERE id % 50 <> 0),
dr AS (SELECT a.id, list_sum(list_transform(range(1, 7), lambda k: (a.nir[k] - b.nir[k]) * (a.nir[k] - b.nir[k]))) AS d FROM x a JOIN x b ON a.id <> b.id),
ds AS (SELECT a.id, list_sum(list_transform(range(1, 7), lambda k: (a.nir[k] - b.nir[k]) * (a.nir[k] - b.nir[k]))) AS d FROM x a, y b),
r AS (SELECT id, sqrt(min(d)) AS r FROM dr GROUP BY id), s AS (SELECT id, sqrt(min(d)) AS s FROM ds GROUP BY id)
SELECT round(-sum(ln(r / s)) * 6 / count(*) + ln((SELECT count(*) FROM y) / (count(*) - 1)) + 1e-9, 6) AS kl FROM r JOIN s USING (id)""")
def kl_divergence(spark, sf_dir):
    """Nearest-neighbour estimate of the divergence of a sample from the rest (6 dimensions)."""
    c = cube(spark, sf_dir).select("id", "nir")
    x, y = c.where("id % 50 = 0"), c.where("id % 50 <> 0").withColumnRenamed("id", "other")
    near = lambda o: cu.knn_distances(x, o, "id", "other", "nir", 1, [])
    both = near(x.withColumnRenamed("id", "other")).withColumnRenamed("d2", "r").join(near(y).withColumnRenamed("d2", "s"), "id")
    m = y.count()
    terms = both.agg(F.sum(F.ln(F.sqrt("r") / F.sqrt("s"))).alias("sum"), F.count("*").alias("n"))
    return terms.select(stable(-F.col("sum") * 6 / F.col("n") + F.ln(F.lit(m) / (F.col("n") - 1))).alias("kl"))


@query("group_kfold", "SELECT vec_id, r AS repeat, CAST(CAST('0x' || substr(md5(label || ':' || r), 1, 8) AS BIGINT) % 5 AS INT) AS fold FROM embeddings, (SELECT unnest([0, 1, 2]) AS r)")
def group_kfold(spark, sf_dir):
    return cu.group_folds(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", 5, 3).drop("label").withColumn("fold", F.col("fold").cast("int"))


_CELL = "cell AS (SELECT event_id % 20 AS cx, event_id // 20 % 20 AS cy, max(event_id) AS class FROM events WHERE event_id % 3 <> 0 GROUP BY ALL)"


@query("nearest_cell", f"WITH {_CELL} SELECT c_custkey, class FROM customer LEFT JOIN cell ON cx = c_custkey % 200 // 10 AND cy = c_custkey * 7 % 200 // 10")
def nearest_cell(spark, sf_dir):
    """Look up the grid cell of a point by its integer key."""
    return _with_cells(spark, sf_dir).select("c_custkey", "class")


def _cells(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_id % 3 <> 0")
    return e.groupBy(F.expr("event_id % 20").alias("cx"), F.expr("event_id div 20 % 20").alias("cy")).agg(F.max("event_id").alias("class"))


def _with_cells(spark, sf_dir):
    points = table(spark, sf_dir, "customer").select("c_custkey", F.expr("c_custkey % 200").alias("x"), F.expr("c_custkey * 7 % 200").alias("y"))
    return cu.nearest(points, _cells(spark, sf_dir), 10)


@query("nearest_with_fallback", f"""WITH {_CELL}, p AS (SELECT c_custkey, c_custkey % 200 // 10 AS px, c_custkey * 7 % 200 // 10 AS py FROM customer),
hit AS (SELECT p.*, class FROM p LEFT JOIN cell ON cx = px AND cy = py AND class % 2 = 0),
f AS (SELECT c_custkey, class % 5 AS v, count(*) AS n FROM hit h JOIN cell c ON cx BETWEEN px - 1 AND px + 1 AND cy BETWEEN py - 1 AND py + 1 WHERE h.class IS NULL GROUP BY ALL),
m AS (SELECT c_custkey, v FROM f QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY n DESC, v) = 1)
SELECT hit.c_custkey, coalesce(hit.class % 5, v) AS class FROM hit LEFT JOIN m USING (c_custkey)""".replace("class % 5 AS v, count(*) AS n FROM hit h", "c.class % 5 AS v, count(*) AS n FROM hit h"))
def nearest_with_fallback(spark, sf_dir):
    """The class of the point's cell, or the modal class of the nine cells around it."""
    cells = _cells(spark, sf_dir)
    points = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_custkey % 200 AS x", "c_custkey * 7 % 200 AS y")
    hit = cu.nearest(points, cells.where("class % 2 = 0"), 10)
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])).alias("s")
    missed = hit.where("class IS NULL").select("c_custkey", "cx", "cy", around)
    near = missed.select("c_custkey", (F.col("cx") + F.col("s.a")).alias("cx"), (F.col("cy") + F.col("s.b")).alias("cy")).join(cells, ["cx", "cy"])
    modes = cu.mode_smallest(near.withColumn("v", F.col("class") % 5), ["c_custkey"], "v").select("c_custkey", "mode")
    return hit.join(modes, "c_custkey", "left").select("c_custkey", F.coalesce(F.col("class") % 5, "mode").alias("class"))


@query("chunked_batches", "SELECT o_orderkey // 50 AS chunk, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1")
def chunked_batches(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.expr("o_orderkey div 50").alias("chunk")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@query("text_functions", "SELECT p_partkey, split_part(p_name, ' ', 1) AS head, starts_with(p_name, 'a') AS a, replace(p_name, ' ', '_') AS path, concat_ws('_', p_brand, p_size) AS uid FROM part")
def text_functions(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.element_at(F.split("p_name", " "), 1).alias("head"), F.startswith("p_name", F.lit("a")).alias("a"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("path"), F.concat_ws("_", "p_brand", F.col("p_size").cast("string")).alias("uid"))


@query("climate_units", "SELECT event_id, round(value + 200 - 273.15 + 1e-9, 6) AS celsius, round(365 * (value / 100000) * 1000 + 1e-9, 6) AS mm, round(coalesce(least(value / 100, 1.0), 0.0) + 1e-9, 6) AS share FROM events")
def climate_units(spark, sf_dir):
    from fieldloom.functions.scalar import daily_metres_to_yearly_mm, kelvin_to_celsius, reflectance

    e = table(spark, sf_dir, "events")
    return e.select("event_id", stable(kelvin_to_celsius(F.col("value") + 200)).alias("celsius"), stable(daily_metres_to_yearly_mm(F.col("value") / 100000)).alias("mm"), stable(reflectance(F.col("value") * 100)).alias("share"))


