"""Streaming forms of append-and-resume pipelines (R-01 to R-05)."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor
from concurrent.futures import wait as wait_for
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.schemas import schema


def results_stream(spark: SparkSession, path: str, record: str = "result") -> DataFrame:
    """New result files as they arrive."""
    return spark.readStream.schema(schema(record)).json(path)


def first_results(stream: DataFrame, key: str, time_column: str, late: str = "1 hour") -> DataFrame:
    """R-01: the first row of each key; state of keys older than the watermark goes."""
    timed = stream.withColumn("__ts", F.timestamp_seconds(time_column)) if dict(stream.dtypes)[time_column] == "double" else stream.withColumn("__ts", F.col(time_column))
    return timed.withWatermark("__ts", late).dropDuplicatesWithinWatermark([key]).drop("__ts")


def parse_rates(stream: DataFrame, key: Sequence[str], flag: str) -> DataFrame:
    """R-04: running counts and rates, for update or complete mode."""
    return stream.groupBy(*key).agg(F.count("*").alias("n"), F.avg(F.col(flag).cast("double")).alias("rate"))


def table_sink(path: str) -> Callable[[DataFrame, int], None]:
    """R-02: each batch in a folder of its own, which a batch that is run again replaces, so no row is written twice."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def latest(table: DataFrame, key: Sequence[str]) -> DataFrame:
    """The last row of each key of a table of an update-mode aggregate, by batch."""
    others = [c for c in table.columns if c not in (*key, "batch")]
    return table.groupBy(*key).agg(F.max_by(F.struct(*others), "batch").alias("x")).select(*key, "x.*")


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """R-02, R-03: everything there is, batch by batch; the checkpoint makes a rerun start where the last ended."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()


class Transient(Exception):
    """A call that may succeed if it is made again."""


def called(df: DataFrame, call: Callable[[pd.DataFrame], pd.DataFrame], output: str, attempts: int = 3, wait: float = 0.5, limit: int = 8, rows: int = 1, transient: tuple[type[Exception], ...] = (Transient, OSError)) -> DataFrame:
    """R-05: calls of up to ``rows`` rows, at most ``limit`` of them in flight in a task, results as they come.

    A call that fails with one of ``transient`` is made again after a wait that
    doubles, up to ``attempts`` times; other errors, and the last, end the task.
    No more calls are begun than are in flight, so a task holds one batch.
    Results come in no order: what they belong to is a column of theirs.
    """

    def tried(part: pd.DataFrame) -> pd.DataFrame:
        for attempt in range(attempts):
            try:
                return call(part)
            except transient:
                if attempt + 1 == attempts:
                    raise
                time.sleep(wait * 2**attempt)
        raise ValueError("attempts must be at least one")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = (pdf.iloc[i : i + rows] for pdf in batches for i in range(0, len(pdf), rows))
        with ThreadPoolExecutor(limit) as pool:
            flying = {pool.submit(tried, part) for part in islice(parts, limit)}
            while flying:
                done, flying = wait_for(flying, return_when=FIRST_COMPLETED)
                for call_ in done:
                    yield call_.result()
                flying |= {pool.submit(tried, part) for part in islice(parts, len(done))}

    return df.mapInPandas(run, output)


def windowed(stream: DataFrame, time_column: str, key: Sequence[str], value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """An addition for event tables: counts and sums in tumbling windows with a watermark."""
    return stream.withWatermark(time_column, late).groupBy(F.window(time_column, width), *key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *key, "n", "total")
