"""Sources and annotators outside the engine, through callables that the user hands over: retries, pages, cached answers."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession

from korpusverk.operators.pairing import resume
from korpusverk.sources.files import annotate


class Busy(Exception):
    """What a callable raises when its service asks to wait."""


def patient(call: Callable, tries: int = 5, base: float = 1.0, pause: float = 15.0, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """call with retries: after a failure the wait doubles from base on, after Busy it grows by pause each time; the last failure is raised."""

    def attempt(*args, **kw):
        for turn in range(1, tries + 1):
            try:
                return call(*args, **kw)
            except Busy:
                if turn == tries:
                    raise
                sleep(pause * turn)
            except Exception:
                if turn == tries:
                    raise
                sleep(base * 2 ** (turn - 1))

    return attempt


def pages(fetch: Callable[[object], Sequence[dict]], cursor: str, start: object = None) -> Iterator[Sequence[dict]]:
    """Pages from fetch(before): each next page lies before the smallest cursor so far; ends at an empty page or when the cursor no longer falls."""
    before = start
    while rows := fetch(before):
        yield rows
        lowest = min(r[cursor] for r in rows)
        if before is not None and lowest >= before:
            return
        before = lowest


def paged_table(spark: SparkSession, fetch: Callable[[object], Sequence[dict]], cursor: str, key: str, schema: str, path: str, start: object = None, batch: int = 100) -> DataFrame:
    """A paged source as a Parquet table without repeated keys; pages are written batch by batch, so the driver never holds all of them."""
    held: list[dict] = []
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)

    def flush() -> None:
        if held:
            spark.createDataFrame(held, schema).write.mode("append").parquet(path)
            held.clear()

    for n, rows in enumerate(pages(fetch, cursor, start), 1):
        held.extend(rows)
        if n % batch == 0:
            flush()
    flush()
    return spark.read.schema(schema).parquet(path).dropDuplicates([key])


def answered(todo: DataFrame, done: DataFrame, keys: Sequence[str], call: Callable, schema: str, verdict: str | None = None) -> DataFrame:
    """The answers that done does not hold yet, each batch of rows through call with retries; with verdict, UNKNOWN answers are asked again."""
    return annotate(resume(todo, done, keys, verdict), patient(call), schema)
