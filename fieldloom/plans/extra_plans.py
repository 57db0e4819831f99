"""Queries on contrast enhancement, map projection and boundary overlap."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldloom.functions.scalar import hyperbolised, laea_to_degrees, stable
from fieldloom.operators import matching as mt
from fieldloom.plans.catalogue import query
from fieldloom.sources.views import PX, pixels, table


@query("histogram_hyperbolisation", f"""WITH {PX}, m AS (SELECT *, min(value) OVER (PARTITION BY tile) AS lo, max(value) OVER (PARTITION BY tile) AS hi FROM px)
SELECT tile, r, c, round((exp(-pow((value - lo) / (hi - lo), 0.8)) - 1) / (exp(-1) - 1) + 1e-9, 6) AS grey FROM m""")
def histogram_hyperbolisation(spark, sf_dir):
    tile = Window.partitionBy("tile")
    px = pixels(spark, sf_dir)
    return px.select("tile", "r", "c", stable(hyperbolised(F.col("value"), F.min("value").over(tile), F.max("value").over(tile))).alias("grey"))


def _laea_sql() -> str:
    """The inverse projection in SQL, with its constants as numbers."""
    a, e2, lat0 = 6378137.0, 0.006694380022900787, math.radians(52)
    e = math.sqrt(e2)
    q = lambda s: (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))
    qp = q(1.0)
    b0, rq = math.asin(q(math.sin(lat0)) / qp), a * math.sqrt(qp / 2)
    d = a * math.cos(lat0) / math.sqrt(1 - e2 * math.sin(lat0) ** 2) / (rq * math.cos(b0))
    s2, s4, s6 = e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040, 23 * e2**2 / 360 + 251 * e2**3 / 3780, 761 * e2**3 / 45360
    return f"""WITH p AS (SELECT c_custkey, (c_custkey % 1000 - 500) * 1000.0::DOUBLE AS x, (c_custkey * 7 % 1000 - 500) * 1000.0::DOUBLE AS y FROM customer),
r AS (SELECT *, sqrt(pow(x / {d!r}, 2) + pow(y * {d!r}, 2)) AS rho FROM p), c AS (SELECT *, 2 * asin(rho / {2 * rq!r}) AS c FROM r),
b AS (SELECT *, asin(cos(c) * {math.sin(b0)!r} + CASE WHEN rho > 0 THEN y * {d!r} * sin(c) * {math.cos(b0)!r} / rho ELSE 0 END) AS b FROM c)
SELECT c_custkey, round(degrees(CASE WHEN rho > 0 THEN {math.radians(10)!r} + atan2(x * sin(c), {d * math.cos(b0)!r} * rho * cos(c) - {d * d * math.sin(b0)!r} * y * sin(c)) ELSE {math.radians(10)!r} END), 7) AS lon,
  round(degrees(b + {s2!r} * sin(2 * b) + {s4!r} * sin(4 * b) + {s6!r} * sin(6 * b)), 7) AS lat FROM b"""


_LAEA = _laea_sql()


def _ring(label: str, name: str, source: str) -> str:
    own = f"coalesce({label}, -1)"
    windows = ("PARTITION BY tile, c ORDER BY r", "PARTITION BY tile, r ORDER BY c")
    near = " OR ".join(f"coalesce({f}({own}, {k}) OVER ({w}) <> {own}, true)" for k in (1, 2) for w in windows for f in ("lag", "lead"))
    return f"{name} AS (SELECT *, ({near}) AND {label} IS NOT NULL AS {name} FROM {source})"


_RINGS = f"""WITH {PX}, {_ring('gt', 'gr', 'px')}, {_ring('pred', 'pr', 'gr')},
o AS (SELECT tile, gt, pred, count(*) AS n FROM px WHERE gt IS NOT NULL AND pred IS NOT NULL GROUP BY ALL), ga AS (SELECT tile, gt, count(*) AS a FROM px WHERE gt IS NOT NULL GROUP BY ALL),
pa AS (SELECT tile, pred, count(*) AS b FROM px WHERE pred IS NOT NULL GROUP BY ALL), m AS (SELECT tile, gt, pred FROM o JOIN ga USING (tile, gt) JOIN pa USING (tile, pred) QUALIFY rank() OVER (PARTITION BY tile, gt ORDER BY n / (a + b - n) DESC) = 1),
gn AS (SELECT tile, gt, count(*) AS g FROM pr WHERE gr GROUP BY ALL), pn AS (SELECT tile, pred, count(*) AS p FROM pr WHERE pr GROUP BY ALL), sh AS (SELECT tile, gt, pred, count(*) AS s FROM pr WHERE gr AND pr GROUP BY ALL)
SELECT tile, gt, pred, round(coalesce(s, 0) / (g + p - coalesce(s, 0)) + 1e-9, 6) AS iou_boundary FROM m LEFT JOIN gn USING (tile, gt) LEFT JOIN pn USING (tile, pred) LEFT JOIN sh USING (tile, gt, pred)"""


@query("laea_to_lonlat", _LAEA)
def laea_to_lonlat(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    x, y = F.lit(4321000.0) + (F.col("c_custkey") % 1000 - 500) * 1000, F.lit(3210000.0) + (F.col("c_custkey") * 7 % 1000 - 500) * 1000
    lon, lat = laea_to_degrees(x, y)
    return c.select("c_custkey", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


@query("object_boundary_iou", _RINGS)
def object_boundary_iou(spark, sf_dir):
    px = pixels(spark, sf_dir)
    best = mt.best_matches(mt.object_overlaps(px)).select("tile", "gt", "pred")
    return mt.boundary_iou(px, best).withColumn("iou_boundary", stable("iou_boundary"))
