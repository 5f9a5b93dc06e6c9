"""Run-keyed result tables with a manifest written last."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "_manifest"
MANIFEST_FIELDS = "run string, tables array<string>, meta string, buckets map<string,int>"


def _path(root: str, table: str) -> str:
    return f"{root.rstrip('/')}/{table}"


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as exc:  # noqa: BLE001 - only a missing table is a normal state
        if "PATH_NOT_FOUND" in str(exc) or "UNABLE_TO_INFER_SCHEMA" in str(exc):
            return None
        raise


def _bucket(entity: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(entity), F.lit(buckets)).cast("int")


def save_run(root: str, run: str, tables: dict[str, DataFrame], meta: dict | None = None,
             overwrite: bool = False, buckets: dict[str, int] | None = None) -> None:
    """Write each table under ``run=<run>``; the run counts once its manifest row is there.

    Only this run's partition is replaced; other runs are never touched. Tables named in
    ``buckets`` are split by a hash of the entity and sorted by it, so that a reader of
    one entity opens one bucket and skips to its rows.
    """
    buckets = buckets or {}
    spark = next(iter(tables.values())).sparkSession
    if not overwrite and run in {r["run"] for r in list_runs(spark, root).collect()}:
        raise FileExistsError(f"run {run!r} exists; ask for overwrite to replace it")
    for name, df in tables.items():
        df, keys = df.withColumn("run", F.lit(run)), ["run"]
        if name in buckets:
            df = df.withColumn("bucket", _bucket(F.col("entity"), buckets[name]))
            # One file per bucket; a hot entity's rows are its bucket's.
            df = df.repartition(buckets[name], "bucket").sortWithinPartitions("bucket", "entity")
            keys.append("bucket")
        (
            df.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*keys)
            .parquet(_path(root, name))
        )
    row = [(run, sorted(tables), json.dumps(meta or {}, sort_keys=True, default=str),
            {t: n for t, n in buckets.items() if t in tables})]
    (
        spark.createDataFrame(row, MANIFEST_FIELDS)
        .coalesce(1)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run")
        .parquet(_path(root, MANIFEST))
    )


def load_run(spark: SparkSession, root: str, run: str, table: str,
             entity: str | None = None) -> DataFrame:
    """One table of one complete run; the run filter prunes directories.

    ``entity`` reads that entity's rows only, from the one bucket that can hold them.
    """
    known = list_runs(spark, root).where(F.col("run") == run).collect()
    if not known:
        raise FileNotFoundError(f"no complete run {run!r} under {root}")
    if table not in known[0]["tables"]:
        raise FileNotFoundError(f"run {run!r} has no table {table!r}")
    rows = spark.read.parquet(_path(root, table)).where(F.col("run") == run)
    n = known[0]["buckets"].get(table)
    if entity is not None:
        if n:
            rows = rows.where(F.col("bucket") == _bucket(F.lit(entity), n))
        rows = rows.where(F.col("entity") == entity)
    return rows.drop("run", "bucket") if n else rows.drop("run")


def list_runs(spark: SparkSession, root: str) -> DataFrame:
    """Complete runs only: an interrupted run has no manifest row."""
    found = _read(spark, _path(root, MANIFEST))
    if found is None:
        return spark.createDataFrame([], f"{MANIFEST_FIELDS}")
    return found.select(F.col("run").cast("string"), "tables", "meta", "buckets").orderBy("run")
