"""Intermediate tables in the folder that the cluster shares.

``Scratch.keep`` writes a DataFrame as Parquet below ``spark.checkpoint.dir`` and
reads it back: the lineage is cut, the files outlive a lost executor, and Spark
knows the table's size when it plans the next join.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import threading
import uuid
from contextlib import suppress

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset on one machine (tests), a
    folder of our own which is also set as the checkpoint folder. On a cluster it has to be set."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if not own:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts are long: at most so many rows go to a Python worker at once, from here on in this session."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, rows)


_one_at_a_time = threading.Lock()


def give_back(spark: SparkSession) -> None:
    """The driver's JVM collects and gives back what it doesn't use: heap down to the least share of free
    heap it is set to (else it keeps up to 70 %), then what the C library holds of native memory
    that was freed. Another JVM than HotSpot, or one without that command, just collects."""
    gateway = spark.sparkContext._gateway
    jvm = gateway.jvm
    found = jvm.java.lang.Class.forName
    beans = jvm.java.lang.management.ManagementFactory

    def array(kind, *values):
        out = gateway.new_array(kind, len(values))
        for i, value in enumerate(values):
            out[i] = value
        return out

    with _one_at_a_time:  # else one call takes the other's ratio for the one to go back to
        most = None
        with suppress(Py4JError, PySparkException):
            options = beans.getPlatformMXBean(found("com.sun.management.HotSpotDiagnosticMXBean"))
            least, most = (options.getVMOption(f"{x}HeapFreeRatio").getValue() for x in ("Min", "Max"))
            options.setVMOption("MaxHeapFreeRatio", least)
        try:
            jvm.System.gc()
        finally:
            if most is not None:
                options.setVMOption("MaxHeapFreeRatio", most)
    with suppress(Py4JError, PySparkException):
        kinds = [found(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
        invoke = found("javax.management.MBeanServer").getMethod("invoke", array(jvm.java.lang.Class, *kinds))
        commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        invoke.invoke(beans.getPlatformMBeanServer(), array(jvm.java.lang.Object, commands, "systemTrimNativeHeap", None, None))


class Scratch:
    """Tables of one operator call. ``drop`` deletes what later steps don't read;
    the rest goes when the driver's process ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self._settled = spark, name, 0
        small_batches(spark)
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._quiet_drop, self.root)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.spark.sparkContext.setJobDescription(f"{self.name}: {name}")
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        heap = self.spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
        # jobs of very many tasks leave much to the driver; a heap that can't shrink isn't collected again and again
        if heap.totalMemory() > max(heap.maxMemory() / 2, 1.25 * self._settled):
            self.release()
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")

    def release(self) -> None:
        """Let go of shuffle files that no live DataFrame refers to, and of the driver's unused memory."""
        gc.collect()
        give_back(self.spark)
        self._settled = self.spark.sparkContext._jvm.java.lang.Runtime.getRuntime().totalMemory()

    def shrink(self) -> None:
        """Executors collect and give back heap that they don't use: their Python workers share the machine's memory."""
        n = self.spark.sparkContext.defaultParallelism
        self.spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')")).collect()

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def _quiet_drop(self, path: str) -> None:
        if self.spark.sparkContext._jsc is None:
            return
        try:
            self._delete(path)
        except Exception:  # the session is already gone; the folder is the cluster's to clear
            pass
