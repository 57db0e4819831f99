"""Queries on shape properties of regions, on the true labels of the pixel view."""

from __future__ import annotations

from fieldloom.functions.scalar import stable
from fieldloom.operators import shapes as sh
from fieldloom.plans.catalogue import query
from fieldloom.sources.views import PX, pixels

_L = f"WITH {PX}, l AS (SELECT tile, gt AS label, CAST(r AS DOUBLE) AS r, CAST(c AS DOUBLE) AS c FROM px WHERE gt IS NOT NULL)"
_MU = _L + """, ce AS (SELECT tile, label, count(*) AS n, avg(r) AS y, avg(c) AS x FROM l GROUP BY ALL),
mu AS (SELECT tile, label, n, """ + ", ".join(f"sum(pow(r - y, {p}) * pow(c - x, {q})) AS mu_{p}{q}" for p in range(4) for q in range(4) if 2 <= p + q <= 3) + " FROM l JOIN ce USING (tile, label) GROUP BY tile, label, n)"


def _labels(spark, sf_dir):
    return sh.labelled(pixels(spark, sf_dir), "gt")


_E = {f"{p}{q}": f"mu_{p}{q} / pow(n, {1 + (p + q) / 2})" for p in range(4) for q in range(4) if 2 <= p + q <= 3}
_HU = _MU + ", e AS (SELECT tile, label, " + ", ".join(f"{v} AS e{k}" for k, v in _E.items()) + """ FROM mu),
ab AS (SELECT *, e30 + e12 AS a, e21 + e03 AS b, e30 - 3 * e12 AS u, 3 * e21 - e03 AS v, e20 - e02 AS d FROM e)
SELECT tile, label, round(e20 + e02 + 1e-9, 6) + 0.0 AS hu_1, round(d * d + 4 * e11 * e11 + 1e-9, 6) + 0.0 AS hu_2, round(u * u + v * v + 1e-9, 6) + 0.0 AS hu_3, round(a * a + b * b + 1e-9, 6) + 0.0 AS hu_4,
  round(u * a * (a * a - 3 * b * b) + v * b * (3 * a * a - b * b) + 1e-9, 6) + 0.0 AS hu_5, round(d * (a * a - b * b) + 4 * e11 * a * b + 1e-9, 6) + 0.0 AS hu_6,
  round(v * a * (a * a - 3 * b * b) - u * b * (3 * a * a - b * b) + 1e-9, 6) + 0.0 AS hu_7 FROM ab"""


@query("hu_moments", _HU)
def hu_moments(spark, sf_dir):
    return sh.hu_moments(_labels(spark, sf_dir)).select("tile", "label", *[stable(f"hu_{k}").alias(f"hu_{k}") for k in range(1, 8)])


@query("region_axes", _MU + """, v AS (SELECT tile, label, n, (mu_20 / n + mu_02 / n) / 2 + 1 / 12 AS m, sqrt(pow(mu_20 / n - mu_02 / n, 2) / 4 + pow(mu_11 / n, 2)) AS s FROM mu)
SELECT tile, label, n AS area, round(4 * sqrt(m + s) + 1e-9, 5) AS axis_major, round(4 * sqrt(greatest(m - s, 0)) + 1e-9, 5) AS axis_minor FROM v""")
def region_axes(spark, sf_dir):
    return sh.axes(_labels(spark, sf_dir)).select("tile", "label", "area", stable("axis_major", 5).alias("axis_major"), stable("axis_minor", 5).alias("axis_minor"))


@query("region_euler", _L + """, q AS (SELECT tile, label, r + a AS r, c + b AS c, CAST(sum(CASE WHEN a = 0 AND b = 0 THEN 1 WHEN a = 0 THEN 2 WHEN b = 0 THEN 4 ELSE 8 END) AS INT) AS code FROM l, range(2) x(a), range(2) y(b) GROUP BY ALL),
k AS (SELECT tile, label, count(*) FILTER (code IN (1, 2, 4, 8)) - count(*) FILTER (code IN (7, 11, 13, 14)) AS d, count(*) FILTER (code IN (6, 9)) AS x FROM q GROUP BY ALL)
SELECT tile, label, (d + 2 * x) // 4 AS euler_4, CAST((d - 2 * x) / 4 AS BIGINT) AS euler_8 FROM k""")
def region_euler(spark, sf_dir):
    return sh.euler_numbers(_labels(spark, sf_dir))


_RIM = _L + """, b AS (SELECT l.* FROM l WHERE (SELECT count(*) FROM l o WHERE o.tile = l.tile AND o.label = l.label AND abs(o.r - l.r) + abs(o.c - l.c) = 1) < 4),
w AS (SELECT b.tile, b.label, b.r, b.c, CAST(sum(CASE WHEN o.r = b.r AND o.c = b.c THEN 1 WHEN o.r <> b.r AND o.c <> b.c THEN 10 ELSE 2 END) AS INT) AS code
  FROM b JOIN b o ON o.tile = b.tile AND o.label = b.label AND abs(o.r - b.r) <= 1 AND abs(o.c - b.c) <= 1 GROUP BY ALL),
p AS (SELECT tile, label, sum(CASE WHEN code IN (5, 7, 15, 17, 25, 27) THEN 1 WHEN code IN (21, 33) THEN sqrt(2) WHEN code IN (13, 23) THEN (1 + sqrt(2)) / 2 ELSE 0 END) AS p FROM w GROUP BY ALL)"""


@query("region_perimeter", _RIM + """ SELECT tile, label, round(p + 1e-9, 5) AS perimeter, round(CASE WHEN p > 0 THEN 4 * pi() * (SELECT count(*) FROM l WHERE l.tile = p.tile AND l.label = p.label) / (p * p) END + 1e-9, 5) AS circularity FROM p""")
def region_perimeter(spark, sf_dir):
    found = sh.region_properties(_labels(spark, sf_dir))
    return found.select("tile", "label", stable("perimeter", 5).alias("perimeter"), stable("circularity", 5).alias("circularity"))
