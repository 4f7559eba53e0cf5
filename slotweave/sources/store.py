"""Keyed tables in Parquet: last writer wins, anti-join upserts, partition-wise rewrites, schema alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W


def dedupe_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the greatest in ``order`` (nulls first). Spark limits the groups before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*[o.desc_nulls_last() for o in order])
    return df.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def align(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Conform to a schema: missing columns are typed nulls, others are left out."""
    return df.select([(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def union_all(*tables: DataFrame) -> DataFrame:
    """UNION ALL by name with missing columns as null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``existing`` whose key is not in ``new``, and ``new``."""
    return union_all(existing.join(new.select(*keys).distinct(), list(keys), "left_anti"), new)


def merge_preferring_known(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Full outer union on the keys; of each value the known one, the first table's if both are."""
    j = a.select(*keys, *[F.col(v).alias(f"__a_{v}") for v in values]).join(b.select(*keys, *[F.col(v).alias(f"__b_{v}") for v in values]), list(keys), "full")
    return j.select(*keys, *[F.coalesce(f"__a_{v}", f"__b_{v}").alias(v) for v in values])


def append_idempotent(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str], order: Sequence[Column], partition: str) -> None:
    """Merge rows into a table partitioned by ``partition``: only the partitions touched are read and rewritten."""
    days = [r[0] for r in new.select(partition).distinct().collect()]  # names of partitions, not data
    try:
        old = spark.read.parquet(path).where(F.col(partition).isin(days))
        whole = union_all(old, new)
    except Exception as e:  # a table that is not there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        whole = new
    from slotweave.runtime import cut

    merged = cut(dedupe_last(whole, keys, order))
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def read_window(spark: SparkSession, path: str, start: str, end: str, *, parameters: Sequence[str] | None = None, stations: Sequence[str] | None = None, partition: str = "day", ts: str = "observed_utc") -> DataFrame:
    """Rows of a store partitioned by day, in the closed window of instants (``YYYY-MM-DDTHH:MM:SSZ``): whole days are pruned by the partition, the rest is pushed to the files."""
    t = spark.read.parquet(path)
    t = t.where(F.col(partition).between(F.to_date(F.lit(start[:10])), F.to_date(F.lit(end[:10])))).where(F.col(ts).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    if parameters is not None:
        t = t.where(F.col("parameter_id").isin(list(parameters)))
    return t if stations is None else t.where(F.col("station_id").isin(list(stations)))


def partition_spans(spark: SparkSession, path: str, name: str = "day") -> DataFrame:
    """``first_us, last_us, n``: the half-open span of instants each partition can hold, by its path alone, and its rows."""
    day = F.to_date(F.regexp_extract(F.input_file_name(), rf"{name}=(\d{{4}}-\d{{2}}-\d{{2}})", 1))
    a = F.unix_micros(day.cast("timestamp"))
    return spark.read.parquet(path).groupBy(a.alias("first_us"), (a + F.lit(86_400_000_000)).alias("last_us")).agg(F.count(F.lit(1)).alias("n"))


def month_rows(month: DataFrame, days: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A month's backfill with what later day files say: month rows whose key no day row has, and the day rows."""
    return upsert(month, days, keys)


def last_table_wins(tables: Sequence[DataFrame], keys: Sequence[str], tie: Sequence[Column]) -> DataFrame:
    """Union of tables with differing columns (missing ones null), one row per key: of the last table that has it, the greatest ``tie``."""
    ranked = [t.withColumn("__table", F.lit(i)) for i, t in enumerate(tables)]
    return dedupe_last(union_all(*ranked), keys, [F.col("__table"), *tie]).drop("__table")


def lead_columns(columns: Sequence[str], prefix: str = "p_rain_") -> dict[int, str]:
    """Leads of the wide probability columns, by name."""
    return {int(c[len(prefix):]): c for c in columns if c.startswith(prefix) and c[len(prefix):].isdigit()}


def to_wide(long: DataFrame, keys: Sequence[str], lead: str, value: str, leads: Sequence[int], prefix: str = "p_rain_") -> DataFrame:
    """One row per key with a column per lead (of repeated ones the greatest value)."""
    w = long.groupBy(*keys).pivot(lead, list(leads)).agg(F.max(value))
    return w.withColumnsRenamed({str(x): f"{prefix}{x}" for x in leads})


def to_long(wide: DataFrame, keys: Sequence[str], lead: str, value: str, prefix: str = "p_rain_") -> DataFrame:
    """One row per key and known lead."""
    cols = lead_columns(wide.columns, prefix)
    return wide.unpivot(list(keys), list(cols.values()), "__name", value).where(F.col(value).isNotNull()).select(*keys, F.substring_index("__name", "_", -1).cast("int").alias(lead), value)


def newest(df: DataFrame, stamp: str, keep: int, protected: Sequence[str] = ()) -> DataFrame:
    """Rows of the ``keep`` newest stamps and of the protected ones; only distinct stamps are put in order."""
    s = df.select(stamp).distinct().orderBy(F.col(stamp).desc()).limit(keep)
    if protected:
        s = s.unionByName(df.select(stamp).where(F.col(stamp).isin(list(protected))).distinct()).distinct()
    return df.join(s, stamp, "left_semi")


def with_flags(df: DataFrame, tags: str, vocabulary: Sequence[str], prefix: str = "tag_") -> DataFrame:
    """Adds one boolean per word of the vocabulary: whether the row's array of tags holds it (a null array holds none)."""
    return df.withColumns({f"{prefix}{v}": F.coalesce(F.array_contains(tags, v), F.lit(False)) for v in vocabulary})
