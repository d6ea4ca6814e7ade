"""The scan over a stream: stateless, so it is the same map-only query as over a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracelode.operators.scan import scan


def lines(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    """Lines of text files as they arrive, each with its line break."""
    reader = spark.readStream.format("text")
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.load(path).select(F.concat("value", F.lit("\n")).alias("text"))


def findings(stream: DataFrame, text: str = "text", ids: tuple[str, ...] = (), **options) -> DataFrame:
    return scan(stream, text, ids, **options)


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, in spark.checkpoint.dir, deleted when the driver ends; beside the warehouse only
    on a local master without that setting."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    home = f"{path.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    there = spark._jvm.org.apache.hadoop.fs.Path(home)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return home


def run_through(found: DataFrame, name: str) -> DataFrame:
    """Runs a stream of findings over what is there now, into a table in the shared folder, and reads it again."""
    spark = found.sparkSession
    home = folder(spark, name)
    start(found, "parquet", f"{home}/out", f"{home}/checkpoint", once=True).awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{home}/out")


def start(found: DataFrame, sink: str, path: str | None = None, checkpoint: str | None = None, name: str | None = None, once: bool = False) -> StreamingQuery:
    """Writes a stream of findings to a file format or to memory; a checkpoint makes it go on where it was."""
    writer = found.writeStream.format(sink).outputMode("append")
    for key, value in (("path", path), ("checkpointLocation", checkpoint)):
        if value:
            writer = writer.option(key, value)
    if name:
        writer = writer.queryName(name)
    return (writer.trigger(availableNow=True) if once else writer).start()
