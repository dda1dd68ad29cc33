"""Sinks: tables with a declared schema, written strictly or with columns added."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def check_schema(df: DataFrame, schema: T.StructType, strict: bool = True) -> DataFrame:
    """`df` in the schema's column order and types; unknown columns are errors if strict, else kept behind; missing ones are null."""
    known = set(schema.names)
    extra = [c for c in df.columns if c not in known]
    if extra and strict:
        raise ValueError(f"columns not in the schema: {', '.join(sorted(extra))}")
    have = set(df.columns)
    cols = []
    for f in schema.fields:
        if f.name in have and df.schema[f.name].dataType != f.dataType and not _widens(df.schema[f.name].dataType, f.dataType):
            raise ValueError(f"column {f.name} is {df.schema[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
        cols.append((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name))
    return df.select(*cols, *extra)


def _widens(a: T.DataType, b: T.DataType) -> bool:
    order = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType()]
    return isinstance(a, T.NullType) or (a in order and b in order and order.index(a) <= order.index(b))


def append(df: DataFrame, path: str, schema: T.StructType, strict: bool = True, partition_by: list[str] = ()) -> None:
    """Add rows; columns the table doesn't have yet are additive and read back with merge_schema."""
    check_schema(df, schema, strict).write.mode("append").partitionBy(*partition_by).parquet(path)


def replace(df: DataFrame, path: str, schema: T.StructType, strict: bool = True) -> None:
    """Put a result, which may have been computed from the table, in the table's place.

    The new rows are written beside it and counted; only if all are there the folders change places, by
    renaming.  A failure on the way leaves the old rows, at `path` or at `path`__old.
    """
    spark = df.sparkSession
    at = path.rstrip("/")
    beside, old = f"{at}__next", f"{at}__old"
    seen = Observation()
    check_schema(df, schema, strict).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(beside)
    written = spark.read.parquet(beside).count()
    if written != seen.get["n"]:
        raise RuntimeError(f"{written} rows written of {seen.get['n']}; {path} is unchanged")
    here, new, away = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (at, beside, old))
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(away, True)
    if fs.exists(here) and not fs.rename(here, away):
        raise RuntimeError(f"{path} can't be moved away")
    if not fs.rename(new, here):
        raise RuntimeError(f"the new rows stay at {beside}, the old ones at {old}")
    fs.delete(away, True)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)
