"""The polled flows as Structured Streaming.

Each function maps a streaming DataFrame to a streaming DataFrame (it works on a batch
DataFrame too, which is how the results are compared). ``run_available_now`` drives a
stream over everything that has landed and stores each micro-batch under its own id, so a
repeated batch overwrites itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from duelmark.operators.keys import keep_last
from duelmark.session import scratch_path
from duelmark.streaming.stateful import CloseOfContest, ConsensusOfPoll

MOST_HELD = 500_000             # quotes that a task holds before it keeps the last ones

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_landed(spark: SparkSession, folder: str, file_glob: str, schema, max_files: int = 1000) -> DataFrame:
    """Streaming file source over landed parquet files."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
            .option("maxFilesPerTrigger", max_files).parquet(folder))


def run_available_now(stream: DataFrame, label: str, mode: str = "append",
                      split: dict | None = None) -> dict[str, DataFrame]:
    """Run to completion and return the stored outputs.

    ``split`` names outputs with a filter each (a side output for rejects); by default
    there is one output called ``out``. Rows carry the ``batch_id`` that wrote them.
    """
    spark = stream.sparkSession
    root = scratch_path(spark, f"stream-{label}")
    outputs = split or {"out": None}
    schema = stream.schema

    def store(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist() if len(outputs) > 1 else batch
        for name, cond in outputs.items():
            rows = kept if cond is None else kept.filter(cond)
            rows.write.mode("overwrite").parquet(f"{root}/{name}/batch_id={batch_id}")
        if len(outputs) > 1:
            kept.unpersist()

    query = (stream.writeStream.outputMode(mode).foreachBatch(store)
             .option("checkpointLocation", f"{root}/_checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return {name: spark.read.schema(_with_batch(schema))
            .parquet(f"{root}/{name}") for name in outputs}


def _with_batch(schema):
    return T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])


def latest_update(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Final value per key of an update-mode stream."""
    return keep_last(rows, keys, ["batch_id"]).drop("batch_id")


def _fields(df: DataFrame, names: list[str]) -> list:
    return [T.StructField(n, df.schema[n].dataType) for n in names]


def _keyed_state(spark: SparkSession) -> None:
    """Processors with timers keep their state in the store that has column families."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def last_in_task(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key by ``order`` (numbers, texts or times, missing first) of what a task reads, before any shuffle.

    Works on streams, where an aggregation would keep a state of its own. A key may be left with several rows: one per task, and more when
    a task meets too many keys to hold.
    """
    def keep(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        def last(held):
            part = pa.Table.from_batches(held).combine_chunks()
            line = pc.sort_indices(part, sort_keys=[(c, "ascending") for c in order], null_placement="at_start")
            at = part.select(keys).take(line).append_column("_at", line).group_by(keys, use_threads=False)
            return part.take(at.aggregate([("_at", "last")])["_at_last"]).combine_chunks().to_batches()

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= MOST_HELD:
                held = last(held)
                n = sum(b.num_rows for b in held)
                if n > MOST_HELD // 2:
                    yield from held
                    held, n = [], 0
        if n:
            yield from last(held)

    return rows.mapInArrow(keep, rows.schema)


def live_consensus(quotes: DataFrame, keys: list[str], book: str, fetched_at: str, window: str, watermark: str, order: list[str] = (),
                   odds_a="odds_a", odds_b="odds_b", prob="book_prob") -> DataFrame:
    """Consensus per key and poll window as quotes arrive, from the last quote of every book.

    State is one quote per (window, key, book), so it is bounded by the books and not by the quotes; a timer at the window's end
    drops it. A group is one key in one window, so a busy key is many groups. A task hands on only the last quotes of what it reads, so what
    moves and reaches the groups follows tasks and books, not quotes. Quotes of one book at one time are ordered by ``order``. A window whose end the watermark has passed takes no quotes any more. Every micro-batch emits
    the new consensus of the windows that it changed (update mode): poll_start, keys, upper-median prices, median
    probability, books, spread, and the best price of each side with the book that offers it (the smallest of equals).
    """
    _keyed_state(quotes.sparkSession)
    poll = F.window(fetched_at, window)
    rows = quotes.select(
        F.unix_micros(poll["start"]).alias("start_us_"), F.unix_micros(poll["end"]).alias("end_us_"), *keys,
        F.unix_micros(fetched_at).alias("at_us_"), *order, F.col(book).alias("book_"),
        F.col(odds_a).cast("double").alias("a_"), F.col(odds_b).cast("double").alias("b_"), F.col(prob).cast("double").alias("p_"), fetched_at)
    # the latest quote of all is the last one of its book, so the watermark is that of all quotes
    rows = last_in_task(rows, ["start_us_", *keys, "book_"], ["at_us_", *order]).withWatermark(fetched_at, watermark)
    state = T.StructType(_fields(rows, ["book_", "at_us_", *order, "a_", "b_", "p_"]))
    book_type = rows.schema["book_"].dataType
    out = T.StructType([*_fields(rows, ["start_us_", *keys]), *(T.StructField(n, T.DoubleType()) for n in ("odds_a", "odds_b", "market_prob_a")),
                        T.StructField("market_books", T.LongType()), *(T.StructField(n, T.DoubleType()) for n in ("market_spread", "best_odds_a", "best_odds_b")),
                        T.StructField("best_book_a", book_type), T.StructField("best_book_b", book_type)])
    made = rows.groupBy("start_us_", *keys).transformWithState(ConsensusOfPoll(state, out.fieldNames()), out, "Update", "EventTime")
    return made.select(F.timestamp_micros("start_us_").alias("poll_start"), *out.fieldNames()[1:])


def append_once(rows: DataFrame, key: str, event_time: str, watermark: str) -> DataFrame:
    """Each id once, with state bounded by the watermark."""
    return rows.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark([key])


def close_snapshots(quotes: DataFrame, schedule: DataFrame, event: str, captured_at: str, start: str, values: list[str],
                    watermark: str = "0 seconds", low: float = 10.0, high: float = 50.0) -> DataFrame:
    """First capture per event inside the due window [low, high] minutes before the start, emitted when the event starts.

    State is one capture per event that has not started. A timer at the start emits it and drops it, so state goes back to
    nothing; captures that come after that are ignored. Append mode: one row per event.
    """
    _keyed_state(quotes.sparkSession)
    lead = (F.unix_micros(start) - F.unix_micros(captured_at)) / 6.0e7
    due = quotes.withWatermark(captured_at, watermark).join(schedule, event).withColumn("lead_minutes", lead)
    due = due.filter(F.col("lead_minutes").between(low, high))
    rows = due.select(F.unix_micros(start).alias("start_us_"), event, F.unix_micros(captured_at).alias("at_us_"), "lead_minutes", *values, captured_at)
    state = T.StructType(_fields(rows, ["at_us_", "lead_minutes", *values]))
    out = T.StructType(_fields(rows, [event, "start_us_", "at_us_", "lead_minutes", *values]))
    made = rows.groupBy(event, "start_us_").transformWithState(CloseOfContest(state, out.fieldNames()), out, "Append", "EventTime")
    return made.select(event, F.timestamp_micros("start_us_").alias(start), F.timestamp_micros("at_us_").alias(captured_at), "lead_minutes", *values)


def admit_pre_start(quotes: DataFrame, captured_at: str, start: str) -> DataFrame:
    """Marks quotes at or after the start; the sink splits them off as rejects."""
    return quotes.withColumn("admitted", F.coalesce(F.col(captured_at) < F.col(start), F.lit(False)))


def missing_results(tracked: DataFrame, results: DataFrame, key: str, tracked_at: str, result_at: str,
                    grace: str = "12 HOURS", watermark: str = "0 seconds") -> DataFrame:
    """Tracked contests without a result within ``grace``: stream-stream left outer join."""
    l = tracked.withWatermark(tracked_at, watermark).alias("l")
    r = results.withWatermark(result_at, watermark).alias("r")
    cond = ((F.col(f"l.{key}") == F.col(f"r.{key}")) & (F.col(f"r.{result_at}") >= F.col(f"l.{tracked_at}"))
            & (F.col(f"r.{result_at}") <= F.col(f"l.{tracked_at}") + F.expr(f"INTERVAL {grace}")))
    return l.join(r, cond, "leftOuter").filter(F.col(f"r.{result_at}").isNull()).select("l.*")
