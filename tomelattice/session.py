"""Sessions, and tables that cut lineage."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, Observation, SparkSession

_written: list[tuple[SparkSession, str]] = []
_own_dir: list[str] = []
_shipped: set[str] = set()


def local_session(name: str = "tomelattice", cores: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(cores),
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.checkpoint.dir": f"file://{tempfile.mkdtemp(prefix='tomelattice-')}",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    spark = builder.config(map=settings).getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers, once for an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="tomelattice-"), f"{root.name}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where that is unset and all runs on one machine a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="tomelattice-"))
    return _own_dir[0]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Stage:
    """A result written to the shared folder, so that later steps start from files that outlive executors."""

    def __init__(self, df: DataFrame, path: str | None = None, group_bytes: int = 128 << 20, **counted: Column) -> None:
        """counted: aggregates taken while writing, to be found in `seen`; path: a place of the caller's, who removes it; group_bytes: of a file's row groups."""
        self.spark = df.sparkSession
        self.path = path or f"{shared_dir(self.spark)}/stage-{uuid.uuid4().hex}"
        seen = Observation() if counted else None
        out = df.observe(seen, *(c.alias(k) for k, c in counted.items())) if counted else df
        out.write.option("compression", "zstd").option("parquet.block.size", group_bytes).parquet(self.path)
        self.seen: dict = seen.get if counted else {}
        if path is None:
            _written.append((self.spark, self.path))
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Removes the files; frames read from them may no longer be evaluated."""
        _delete(self.spark, self.path)
        _written.remove((self.spark, self.path))


def stage(df: DataFrame) -> DataFrame:
    """Evaluates df once and returns it as read from files."""
    return Stage(df).df


def _trimmed(spark: SparkSession) -> str | None:
    """Has the JVM give back what its native allocator holds but nothing uses, as left by ended threads and compilations; its answer, None if it lacks the command."""
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    names = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
    kinds, values = array(jvm.java.lang.Class, len(names)), array(jvm.java.lang.Object, len(names))
    try:
        for i, name in enumerate(names):
            kinds[i] = jvm.java.lang.Class.forName(name)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds)  # the server's own class is not open to others
        return invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JError:
        return None


def tidy(spark: SparkSession) -> str | None:
    """Lets go of the shuffle files of finished steps, which stay until the driver has collected the objects they belong to, and of native memory freed with them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return _trimmed(spark)


def release() -> None:
    """Removes all stages written so far, once no result that builds on them will be evaluated any more.  Done at exit as well."""
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone already
            continue


atexit.register(release)
