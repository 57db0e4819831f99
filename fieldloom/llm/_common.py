"""What the text operators share: the shared folder, stored intermediate tables, row keys."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are runs of anything but ASCII white space, in every operator here.
SPACE = "[\\x20\\x09-\\x0D]+"

#: Name of the row key that filtering stages carry through an operator.
ROW = "__row"

_own: dict[str, str] = {}
#: Paths written within each `scratch`, the innermost last.
_written: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    Where the setting is missing a folder of our own is made, but only if driver and executors
    are one process; on a cluster that would lose what other machines write, so it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or _own.setdefault("dir", tempfile.mkdtemp(prefix="fieldloom-"))


#: Bounds of the Arrow batches that carry texts to Python: rows, and bytes (reached by one row at most).
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


@contextmanager
def text_batches(spark: SparkSession):
    """While this holds, plans that run send texts to Python in small batches."""
    before = {k: spark.conf.get(k, None) for k in BATCH}
    for k, v in BATCH.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@contextmanager
def scratch(spark: SparkSession):
    """Tables stored while this holds are deleted at its end, so only what is read by then may need them."""
    _written.append([])
    try:
        yield
    finally:
        for path in _written.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it again.

    This cuts lineage, so that a lost executor costs a read and not the work before it, and
    gives the optimiser real sizes. The returned DataFrame reads the files lazily: they go with
    the innermost `scratch` unless they are to be kept, or stay until the owner of the folder clears it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fieldloom/{name}-{uuid.uuid4().hex}"
    if _written and not keep:
        _written[-1].append(path)
    with text_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _positions_hold(docs: DataFrame) -> bool:
    """Whether the rows are those of Parquet files, filtered and projected at most, each file read once."""
    plan = docs._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    try:
        roots = plan.relation().location().rootPaths()
        docs.select(docs.metadataColumn("_metadata")["row_index"])
    except (Py4JError, PySparkException):  # no scan of files, or of files without row positions
        return False
    return roots.distinct().size() == roots.size()


def with_row(docs: DataFrame, by_values: bool = False) -> DataFrame:
    """Add the key `ROW` of each row: a hash of its file's path, and its position in the file.

    The key is the same however often and by however many splits the table is read. With `by_values` it begins
    with a hash of the row's values, so that keys of rows that differ come in the same order wherever the files
    lie, and ties end alike when a run is repeated. A table that
    is anything but a plain scan of Parquet files is stored first. A table with the key keeps it."""
    if ROW in docs.columns:
        return docs
    docs = docs if _positions_hold(docs) else stored(docs, "numbered")
    where = docs.metadataColumn("_metadata")
    plain = [f.name for f in docs.schema if by_values and isinstance(f.dataType, T.AtomicType)]
    values = [F.xxhash64(*[F.col(f"`{c}`") for c in plain]).alias("row")] if plain else []
    return docs.withColumn(ROW, F.struct(*values, F.call_function("xxhash64", where["file_path"]).alias("file"), where["row_index"].alias("at")))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """Array of the words of a text; null counts as empty, and an empty text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")
