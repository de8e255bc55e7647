"""Structured Streaming: stateless annotation, running counts, event-time windows, sentence assembly across lines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.shared import shared_dir


def source(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table's files as a stream; its schema is read from the files."""
    path = f"{sf_dir}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    # a single file is watched through its folder by name
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir) if _is_file(spark, path) else spark.readStream.schema(schema).parquet(path)


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """All that the stream gives for what is there now, as a table in the shared folder (append) or of the last state (complete, update)."""
    spark = stream.sparkSession
    path = shared_dir(spark)
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{path}/out")

    def keep(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/out/{n}")

    q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    last = (q.lastProgress or {}).get("batchId", 0)
    return spark.read.schema(stream.schema).parquet(f"{path}/out/{last}")


def running_counts(stream: DataFrame, *keys: str) -> DataFrame:
    return stream.groupBy(*keys).agg(F.count("*").alias("n"))


def timed(stream: DataFrame, column: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Event time with a watermark; times without zone are read as the session's."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def tumbling(stream: DataFrame, width: str, late: str, key: str = "event_type") -> DataFrame:
    w = timed(stream, late=late).groupBy(F.window("ts", width), key).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), key, "n")


def sliding(stream: DataFrame, width: str, step: str, late: str, key: str = "event_type") -> DataFrame:
    w = timed(stream, late=late).groupBy(F.window("ts", width, step), key).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n")


def sessions(stream: DataFrame, gap: str, late: str, key: str = "user_id") -> DataFrame:
    w = timed(stream, late=late).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"))
    return w.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def annotated(stream: DataFrame, *columns) -> DataFrame:
    """Stateless annotation: the same expressions as in batch."""
    return stream.select("*", *columns)


def sentences(stream: DataFrame, key: str = "doc_id", idle: str | None = None) -> DataFrame:
    """(key, sentence, lines): vertical lines (key, line_no, line) are buffered until a line starts with `</s>`.

    A key's state is the lines of its open sentence.  With `idle` (milliseconds) a key that gets no line for so long gives out what it holds and is forgotten.
    """

    def run(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, held = state.get if state.exists else (0, [])
        held, out = list(held), []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(k[0], n, "\n".join(held))] if held else [], columns=[key, "sentence", "lines"])
            return
        for pdf in batches:
            for line in pdf.sort_values("line_no")["line"]:
                held.append(line)
                if line.startswith("</s>"):
                    out.append((k[0], n, "\n".join(held)))
                    held, n = [], n + 1
        state.update((n, held))
        if idle:
            state.setTimeoutDuration(int(idle))
        yield pd.DataFrame(out, columns=[key, "sentence", "lines"])

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, sentence long, lines string", "n long, held array<string>", "append", "ProcessingTimeTimeout" if idle else "NoTimeout")


def ordered_sink(path: str, order: str):
    """foreachBatch function that writes each batch in input order, once a batch number: files in the order of their names, each sorted."""

    def write(df: DataFrame, n: int) -> None:
        df.repartitionByRange(order).sortWithinPartitions(order).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return write


def socket(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines from a socket, for demonstrations: one request a line."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()
