"""Connected components of an edge table, by alternating large-star and small-star rounds.

Both rounds only regroup edges around smaller nodes (Kiveris et al. 2014), so no round makes
more edges than twice the number it got, and neither edges nor labels ever reach the driver:
it only sees two sums that tell whether a round changed anything. Once a table has at most
`SMALL` edges one task ends the work by union-find; every round has a plan of several exchanges,
and these are what fills the driver's memory when there are many small tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._common import stored

#: Edges that one task may have; of more the rounds take care, in any number of tasks.
SMALL = 1 << 17


def _stored(edges: DataFrame) -> tuple[DataFrame, dict]:
    """The stored edges, and two sums that were taken while they were written."""
    seen = Observation()
    hashed = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return stored(edges.observe(seen, F.count(F.lit(1)).alias("n"), hashed.alias("h")), "components"), seen.get


def _key(x):
    return tuple(x.values()) if isinstance(x, dict) else x


def _joined(schema: pa.Schema):
    """(node, root) of all nodes of the edges of one task, by union-find towards the smaller node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict = {}

        def top(x):
            at = x
            while above[at] != at:
                at = above[at]
            while above[x] != at:
                above[x], x = at, above[x]
            return at

        names = {}
        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ends = []
                for x in (u, v):
                    k = _key(x)
                    if k not in above:
                        above[k], names[k] = k, x
                    ends.append(top(k))
                above[max(ends)] = min(ends)
        nodes = list(above)
        for at in range(0, len(nodes), 1 << 14):
            own = nodes[at : at + (1 << 14)]
            columns = [names[k] for k in own], [names[top(k)] for k in own]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of the edges, root being the smallest node it reaches."""
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges, now = _stored(edges)
    before = None
    while now["n"] and now != before:
        if now["n"] <= SMALL:
            form = T.StructType([T.StructField("node", edges.schema["u"].dataType), T.StructField("root", edges.schema["u"].dataType)])
            return stored(edges.coalesce(1).mapInArrow(_joined(to_arrow_schema(form)), form), "components")
        before = now
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("w"), F.least("u", "low").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        joined = large.join(low, F.col("u") == F.col("w"))
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("w", "m")).distinct()
        edges, now = _stored(small)
    return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
