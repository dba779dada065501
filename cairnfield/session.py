"""What operators need from the session: shared storage, shipped code, size checks."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PACKAGE = Path(__file__).resolve().parent


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local master gets a temporary folder; any other master
    is refused, as a machine-local folder would be invisible to executors.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="cairnfield-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends here.

    An executor lost later costs a re-read of files, never a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    trim(spark)
    return spark.read.schema(df.schema).parquet(path)


def trim(spark: SparkSession) -> bool:
    """Hand unused memory of the driver's JVM back to the system, its heap's and what native code has freed; whether that could be done for the latter.

    Neither is handed back otherwise, so a job of many small plans grows to the whole heap and some 300 MB beside it.
    """
    jvm = spark.sparkContext._jvm
    jvm.System.gc()
    try:
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        # A JVM without this command, or not on Linux.
        return False
    return True


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of plans that are no longer reachable.

    Python lets go of its proxies in the first round, so the JVM can let go of what they stood for in the second.
    """
    for _ in range(2):
        gc.collect()
        trim(spark)
        time.sleep(0.3)


def ship(spark: SparkSession) -> None:
    """Send this package to executors that don't have it on their path (once a context)."""
    sc = spark.sparkContext
    if getattr(sc, "_cairnfield_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="cairnfield-")) / "cairnfield.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent))
    sc.addPyFile(str(target))
    sc._cairnfield_shipped = True


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """A broadcast hint only if df has max_rows rows at most; else Spark picks a shuffle join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
