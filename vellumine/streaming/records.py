"""The per-document operators on arriving documents. Documents don't depend on one another, so most need no state."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import EMAIL, contact_text, ground_form


def arriving(spark: SparkSession, path: str, schema: str, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def contacts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """First e-mail of each document and its line, within the row: the same in batch and in streams."""
    found = F.transform(F.split(text_col, "\n"), lambda t, i: F.struct(i.alias("line_no"), F.regexp_extract(contact_text(t), EMAIL, 0).alias("email")))
    first = F.try_element_at(F.filter(found, lambda x: x["email"] != ""), F.lit(1))
    return docs.select(id_col, first["email"].alias("email"), first["line_no"].alias("line_no"))


def once(docs: DataFrame, text_col: str = "text", time_col: str = "ts", late: str = "1 hour") -> DataFrame:
    """Documents whose normal form has not come before, within the watermark."""
    keyed = docs.withColumn(time_col, F.col(time_col).cast("timestamp")).withColumn("_form", F.sha2(ground_form(text_col, compat=False), 256))
    return keyed.withWatermark(time_col, late).dropDuplicatesWithinWatermark(["_form"]).drop("_form")


def windowed_counts(events: DataFrame, time_col: str, width: str, late: str, *keys: str) -> DataFrame:
    """``window_start, keys, n, total`` of ``value``. Times without a zone are cast, which watermarks need."""
    timed = events.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, late)
    out = timed.groupBy(F.window(time_col, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sessions(events: DataFrame, time_col: str, gap: str, late: str, *keys: str) -> DataFrame:
    timed = events.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, late)
    out = timed.groupBy(F.session_window(time_col, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")


def running_totals(events: DataFrame, key: str, value: str) -> DataFrame:
    """``key, n, total`` so far after each batch, kept as state for each key."""

    def step(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for p in parts:
            n, total = n + len(p), total + float(p[value].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [name[0]], "n": [n], "total": [total]})

    kind = dict(events.dtypes)[key]
    return events.select(key, value).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, folder: str, transform: Callable[[DataFrame], DataFrame] = lambda d: d, mode: str = "append") -> None:
    """All that has arrived, through ``transform``, to Parquet under ``folder``; a second call goes on where it ended."""
    out = transform(stream).writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/table")
    out.trigger(availableNow=True).start().awaitTermination()
