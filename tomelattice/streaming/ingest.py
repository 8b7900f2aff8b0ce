"""Documents taken in as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tomelattice.operators.dedupe import new_documents
from tomelattice.session import stage


def table_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A folder of Parquet files, those to come as well, as a stream; or one file, as it is now."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if path.rstrip("/").endswith(".parquet") and "/" in path:
        folder, _, name = path.rstrip("/").rpartition("/")
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
            return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def distinct_stream(stream: DataFrame, key: str) -> DataFrame:
    """The first row of every key that isn't null.  The keys seen are the state, kept for good: a copy may come at any time."""
    return stream.where(F.col(key).isNotNull()).dropDuplicates([key])


def ingest_stream(stream: DataFrame, accept: Callable[[DataFrame, int], None], known: Callable[[], DataFrame], checkpoint: str, key: str = "md5", order: list[str] | None = None, once: bool = True) -> StreamingQuery:
    """Calls accept(new documents, batch number) for each batch of the stream, with what is neither known nor a copy within the batch.

    `known` is asked for the keys taken so far before each batch.  A batch that is repeated after a
    failure has the same number, so that accept can tell.  once: what is there now, then end.
    """

    def each(batch: DataFrame, number: int) -> None:
        fresh = stage(new_documents(batch, known(), key, order))
        if not fresh.isEmpty():
            accept(fresh, number)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
