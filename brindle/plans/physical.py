"""Helpers that shape the physical plan: input spreading, lineage cuts, joins that keep hot keys apart."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SALTS = 64


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition by ``keys`` only where the scan has fewer partitions than the cluster has cores.

    Text operators cost far more CPU than a shuffle of their input, so one unsplittable file must not
    keep a cluster idle. A scan that already fills the cores is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores * 2, *[F.col(k) for k in keys])


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, which all executors share. Only a local session may do without one."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not sc.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return where or _own.setdefault(sc.applicationId, os.path.join(tempfile.gettempdir(), f"brindle-{uuid.uuid4().hex}"))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Whether old checkpoints are deleted is up to ``spark.cleaner.referenceTracking.cleanCheckpoints``."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(spark))


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable (never local) checkpoint: survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def join_facts(rows: DataFrame, facts: DataFrame, key: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``rows`` with the columns of ``facts`` (one row a key), no task holding more than a ``salts``-th of a key's rows.

    The facts are first joined with the distinct (key, salt) of the rows, which are at most ``salts`` a key, and
    then with the rows on both. The salt is a hash of a row's other columns. Rows with a null key match nothing. ``rows`` should be cheap to read twice.
    """
    others = [F.col(c) for c in rows.columns if c != key]
    salted = rows.withColumn("_salt", (F.pmod(F.xxhash64(*others), F.lit(salts)) if others else F.lit(0)).cast("int"))
    spots = salted.select(key, "_salt").distinct().join(facts, key)
    return salted.join(spots, [key, "_salt"], how).drop("_salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
