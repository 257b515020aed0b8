"""Session helpers: shared scratch space, materialised tables and shipping the package to workers."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

_ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()
_own_dirs: dict[str, str] = {}


#: Rows of an Arrow batch where the session has Spark's default: rows here are documents, and a batch of ten thousand of
#: them is tens of megabytes, several times over, in each task.
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_DEFAULT_ROWS, _ROWS = "10000", "2048"


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application (needed where PYTHONPATH lacks it), and keep Arrow
    batches small unless the session asks for another size."""
    if spark.conf.get(ARROW_ROWS) == _DEFAULT_ROWS:
        spark.conf.set(ARROW_ROWS, _ROWS)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    target = os.path.join(tempfile.mkdtemp(prefix="tidewell-"), "tidewell_pkg.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(_ROOT.rglob("*.py")):
            archive.write(path, str(Path(_ROOT.name) / path.relative_to(_ROOT)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def give_back() -> None:
    """Return a Python worker's free memory to the system. Spark keeps workers between tasks, and Arrow's pool and the C
    library keep what was freed in them, which counts as their executor's memory in every later stage."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim:
        trim(0)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow, after which the worker gives its free memory back."""

    def task(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return task


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share.

    ``spark.checkpoint.dir`` names that folder. Where it is unset a local master gets a temporary folder of this
    process; on a cluster, whose executors would not see that folder, RuntimeError is raised.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not base:
        app = spark.sparkContext.applicationId
        if app not in _own_dirs:
            _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="tidewell-scratch-")
        base = _own_dirs[app]
    return f"{base.rstrip('/')}/tidewell-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` of a table just read, dealt over all cores where the scan has fewer tasks than there are cores.

    Only for scans: the number of tasks of what follows a shuffle is not known before it has run.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.isStreaming or rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def numbered(rows: DataFrame, order: list[str], name: str, after: int = 0) -> DataFrame:
    """``rows`` with a number from ``after + 1`` on in ``order`` (whose values are distinct) as the column ``name``.

    Rows are dealt by ranges of ``order`` and numbered within each; only the table of ranges, one row a partition, is
    summed up in one task.
    """
    part, place = f"_{name}_part", f"_{name}_place"
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = materialise(ranged.withColumns({part: F.spark_partition_id(), place: F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "numbered")
    sizes = ranged.groupBy(part).agg(F.count("*").alias("_n"))
    before = sizes.select(part, (F.sum("_n").over(Window.orderBy(part)) - F.col("_n")).alias("_before"))
    return ranged.join(F.broadcast(before), part).select(*rows.columns, (F.col("_before") + F.col(place) + 1 + after).cast("long").alias(name))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
