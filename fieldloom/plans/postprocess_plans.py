"""Queries that turn instance masks into label rasters; masks are the boxes of the instance view with
a gap on every seventh diagonal."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.functions.scalar import stable
from fieldloom.operators import postprocess as pp
from fieldloom.plans.catalogue import query
from fieldloom.sources.views import INST, instances

SIZE = 128
_MASKS = f"""WITH {INST}, rr AS (SELECT *, unnest(range(y0, y0 + h)) AS r FROM inst), cc AS (SELECT *, unnest(range(x0, x0 + w)) AS c FROM rr),
mk AS (SELECT tile, inst, score, r, c FROM cc WHERE (r + c + inst) % 7 <> 0), ar AS (SELECT tile, inst, count(*) AS area FROM mk GROUP BY ALL),
kp AS (SELECT mk.*, area FROM mk JOIN ar USING (tile, inst) WHERE score > 40 AND area > 25),
sh AS (SELECT a.tile, a.inst AS a, b.inst AS b, count(*) AS n, any_value(a.area) AS aa, any_value(b.area) AS ab FROM kp a JOIN kp b ON a.tile = b.tile AND a.r = b.r AND a.c = b.c AND a.score > b.score GROUP BY ALL),
be AS (SELECT DISTINCT tile, b AS inst FROM sh WHERE n / (aa + ab - n) > 0.1)"""


def masks(spark, sf_dir):
    rows = instances(spark, sf_dir).withColumn("r", F.explode(F.expr("sequence(y0, y0 + h - 1)"))).withColumn("c", F.explode(F.expr("sequence(x0, x0 + w - 1)")))
    return rows.where("(r + c + inst) % 7 <> 0").select("tile", "inst", "score", "r", "c")


@query("mask_overlaps", _MASKS + " SELECT tile, a, b, round(n / (aa + ab - n) + 1e-9, 6) AS iou FROM sh")
def mask_overlaps(spark, sf_dir):
    return pp.mask_overlaps(masks(spark, sf_dir), 40, 25).withColumn("iou", stable("iou"))


@query("suppressed_masks", _MASKS + " SELECT tile, inst, count(*) AS area FROM kp ANTI JOIN be USING (tile, inst) GROUP BY tile, inst")
def suppressed_masks(spark, sf_dir):
    return pp.suppressed_masks(masks(spark, sf_dir), 40, 25, 0.1).groupBy("tile", "inst").agg(F.count("*").alias("area"))


@query("mask_pp")
def mask_pp(spark, sf_dir):
    return pp.mask_pp(masks(spark, sf_dir), SIZE, 40, 25, 0.1)


@query("bbox_pp")
def bbox_pp(spark, sf_dir):
    return pp.bbox_pp(masks(spark, sf_dir), SIZE, 120, 25)


def _largest(size):
    import numpy as np
    import pandas as pd

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        mask = np.zeros((size, size), bool)
        mask[frame.r, frame.c] = True
        r, c = np.nonzero(pp.largest_part(mask))
        return pd.DataFrame({"tile": frame.tile.iloc[0], "inst": frame.inst.iloc[0], "first": [int(r[0] * size + c[0])], "area": [len(r)]})

    return run


_PARTS = """, sm AS (SELECT tile, inst, r, c, r * 128 + c AS k FROM mk WHERE score > 190),
reach AS (SELECT tile, inst, r, c, k FROM sm UNION SELECT b.tile, b.inst, b.r, b.c, a.k FROM reach a JOIN sm b ON a.tile = b.tile AND a.inst = b.inst AND abs(a.r - b.r) + abs(a.c - b.c) = 1),
lo AS (SELECT tile, inst, r, c, min(k) AS k FROM reach GROUP BY ALL), pa AS (SELECT tile, inst, k, count(*) AS area FROM lo GROUP BY ALL)
SELECT tile, inst, k AS first, area FROM pa QUALIFY row_number() OVER (PARTITION BY tile, inst ORDER BY area DESC, k) = 1"""


@query("largest_component", _MASKS.replace("WITH", "WITH RECURSIVE", 1).split(", ar AS")[0] + _PARTS)
def largest_component(spark, sf_dir):
    """The largest part of each mask over a score: its first pixel and its area."""
    return masks(spark, sf_dir).where("score > 190").groupBy("tile", "inst").applyInPandas(_largest(SIZE), "tile bigint, inst bigint, first bigint, area bigint")


@query("rle_texts", f"""WITH {INST}, rr AS (SELECT *, unnest(range(y0, y0 + h)) AS r FROM inst), cc AS (SELECT *, unnest(range(x0, x0 + w)) AS c FROM rr),
mk AS (SELECT tile, inst, r, c FROM cc WHERE (r + c + inst) % 7 <> 0 AND score > 120) SELECT tile, inst, count(*) AS area, min(c) AS x, min(r) AS y, max(c) - min(c) + 1 AS w, max(r) - min(r) + 1 AS h FROM mk GROUP BY ALL""")
def rle_texts(spark, sf_dir):
    """Masks written as run-length text and read back: area and box of what comes out."""
    import numpy as np
    import pandas as pd

    from fieldloom.functions import masks as fm

    def write(frame: pd.DataFrame) -> pd.DataFrame:
        mask = np.zeros((SIZE, SIZE), bool)
        mask[frame.r, frame.c] = True
        return pd.DataFrame({"tile": [frame.tile.iloc[0]], "inst": [frame.inst.iloc[0]], "counts": [fm.text_of_lengths(fm.run_lengths(mask))]})

    def read(frames):
        for frame in frames:
            found = [fm.mask_of(fm.lengths_of_text(t), SIZE, SIZE) for t in frame["counts"]]
            boxes = np.array([fm.box_of(x) for x in found]).reshape(-1, 4)
            yield frame.drop(columns="counts").assign(area=[int(x.sum()) for x in found], **{k: boxes[:, n] for n, k in enumerate("xywh")})

    texts = masks(spark, sf_dir).where("score > 120").groupBy("tile", "inst").applyInPandas(write, "tile bigint, inst bigint, counts string")
    return texts.mapInPandas(read, "tile bigint, inst bigint, area bigint, x bigint, y bigint, w bigint, h bigint")


@query("rotated_boxes")
def rotated_boxes(spark, sf_dir):
    """The least rotated box around each mask's pixels."""
    import numpy as np
    import pandas as pd

    from fieldloom.functions import masks as fm

    def box(frame: pd.DataFrame) -> pd.DataFrame:
        found = fm.rotated_box(np.column_stack([frame.c, frame.r]))
        return pd.DataFrame([(frame.tile.iloc[0], frame.inst.iloc[0], *found)], columns=["tile", "inst", "x", "y", "w", "h", "angle"])

    px = masks(spark, sf_dir).where("score > 120")
    out = px.groupBy("tile", "inst").applyInPandas(box, "tile bigint, inst bigint, x double, y double, w double, h double, angle double")
    return out.select("tile", "inst", *[stable(c).alias(c) for c in ("x", "y", "w", "h", "angle")])
