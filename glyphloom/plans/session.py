"""Session helpers shared by all operators."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows of one Arrow batch given to Python: documents may be megabytes long.
BATCH_ROWS = 256


def package_zip(target: str) -> str:
    """Writes this package as a zip archive that Spark's file server hands to the executors."""
    root = Path(__file__).resolve().parents[1]
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*")):
            if p.is_file() and p.suffix in (".py", ".json", ".toml", ".txt"):
                z.write(p, Path(root.name) / p.relative_to(root))
    with open(target, "wb") as f:
        f.write(buffer.getvalue())
    return target


def prepare(spark: SparkSession) -> SparkSession:
    """Arrow batch size, and the package on the executors' Python path (once a context)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    sc = spark.sparkContext
    if getattr(sc, "_glyphloom_shipped", None) is None:
        # the driver's own copy for its file server; executors fetch it over the network
        folder = tempfile.mkdtemp(prefix="glyphloom-")
        sc.addPyFile(package_zip(os.path.join(folder, "glyphloom.zip")))
        sc._glyphloom_shipped = folder
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Plan nodes after which the number of tasks is the shuffle's business.
_WIDE = ("Aggregate", "Join", "Repartition", "RepartitionByExpression", "RebalancePartitions", "Window", "Sort", "Distinct", "Deduplicate")


def _wide(df: DataFrame) -> bool:
    """Whether a plan holds a node that shuffles, by the class names of its nodes."""
    todo = [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() in _WIDE:
            return True
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return False


def spread(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows over at least all cores before work that costs much CPU a row.

    Only a plain scan in fewer splits than cores is dealt out; a large input has more splits
    than cores and is left alone (no shuffle), and so is anything behind a shuffle or a stream.
    """
    if columns:
        df = df.select(*columns)
    if df.isStreaming or _wide(df):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * 2) if df.rdd.getNumPartitions() < cores else df


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage by a reliable checkpoint in ``spark.checkpoint.dir``.

    Where no folder is set, a local session (tests) gets one of its own; on a cluster that is an error, as
    a folder of one machine would be lost with it.
    """
    sc = df.sparkSession.sparkContext
    if sc.getConf().get("spark.checkpoint.dir", None) is None and sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="glyphloom-checkpoint-"))
    return df.checkpoint(eager=True)
