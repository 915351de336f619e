"""Reading tables, cutting lineage and sizing helpers shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """A scan in as many partitions as there are cores, if its files give fewer; large tables stay as they are, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, F.col(key))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder of checkpoint(): the session's own setting wins.

    Only where none is set, and only in local mode, a folder on this machine is taken; it goes with the session.
    """
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    asked = spark.conf.get("spark.checkpoint.dir", None)
    if not asked:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        asked = tempfile.mkdtemp(prefix="korpusverk-checkpoint-")
        atexit.register(shutil.rmtree, asked, ignore_errors=True)
    sc.setCheckpointDir(asked)
    return asked


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder, so that lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def clash_free(df: DataFrame, *wanted: str) -> DataFrame:
    """Only the wanted columns, found by exact name even if others differ in case only."""
    by_name = {c: c for c in df.columns}
    missing = [c for c in wanted if c not in by_name]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    same = [c.lower() for c in df.columns]
    if all(same.count(c.lower()) == 1 for c in wanted):
        return df.select(*[F.col(f"`{c}`") for c in wanted])
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))]).select(*[F.col(f"_c{df.columns.index(c)}").alias(c) for c in wanted])


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on equal keys in which null equals null; right brings its other columns only."""
    named = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(named, on, how).drop(*[f"_r_{k}" for k in keys])
