"""What the operators share: text expressions, saved intermediate tables, joins that survive hot keys."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.sources.code import shipped  # noqa: F401 - for the operators
from tessera.sources.saved import folder, placed, saved  # noqa: F401 - for the operators

#: The white space of every contract here: space and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; a small one in no more parts than there are cores, which may be one row group, is dealt out to all of them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores, plan = spark.sparkContext.defaultParallelism, df._jdf.queryExecution()
    small = plan.toRdd().getNumPartitions() <= cores and int(str(plan.optimizedPlan().stats().sizeInBytes())) < cores << 24
    return df.repartition(cores) if small else df


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. lower() is much faster than translate() and the same on pure ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The runs of other than white space, as an array; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[ \t-\r]+"), "")


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo folds; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def packed(docs: DataFrame, *columns: str, beside: str | None = None) -> DataFrame:
    """The named columns as _tz_NAME, and the whole row as _tz_row: extra columns of any name can't clash.

    The column `beside`, a long one, is not in _tz_row as well.
    """
    row = [F.col(f"`{c}`") for c in docs.columns if c != beside] or [F.lit(0).alias("_tz_none")]
    return docs.select(F.struct(*row).alias("_tz_row"), *(F.col(f"`{c}`").alias(f"_tz_{c}") for c in columns))


def row_and(base: DataFrame, ddl: str) -> StructType:
    """The schema of _tz_row, whatever names it has, and of the columns in ddl."""
    return StructType([base.schema["_tz_row"], *StructType.fromDDL(ddl).fields])


def unpacked(df: DataFrame, schema_of: DataFrame, without: str | None = None, **added: Column) -> DataFrame:
    """Undoes packed(); a column in `added` takes the place of one of the same name, or follows the others."""
    names = [c for c in schema_of.columns if c != without]
    kept = [added[c].alias(c) if c in added else F.col("_tz_row")[c].alias(c) for c in names]
    return df.select(*kept, *(v.alias(k) for k, v in added.items() if k not in names))


def join_skewed(rows: DataFrame, lookup: DataFrame, keys: list[str], weight: str, payload: list[str], spread: Column | None = None, hot_keys: int = 1000, inner: bool = False) -> DataFrame:
    """rows left join lookup on keys (inner, if asked), with no task that gathers a hot key.

    lookup, a saved table, has one row a key; `weight` says how many of `rows` hold the key at most. A key with over
    1/hot_keys of the sum of weights is hot: there are fewer than hot_keys of those whatever the data, so they are
    broadcast. Rows that hold one take no part in the shuffle join with the other keys; where working `rows` out twice is
    dear, `spread`, which must tell such rows apart, deals them out in that join instead, where they match nothing.
    """
    total = lookup.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) > total / hot_keys
    hot, cold = lookup.filter(is_hot).select(*keys, *payload), lookup.filter(~is_hot)
    cold = cold.select(*(F.col(k).alias(f"_tz_cold_{k}") for k in keys), F.lit(False).alias("_tz_cold_flag"), *(F.col(c).alias(f"_tz_cold_{c}") for c in payload))
    on = reduce(and_, (F.col(k) == F.col(f"_tz_cold_{k}") for k in keys))
    how, found = ("inner" if inner else "left"), [*rows.columns, *(F.col(f"_tz_cold_{c}").alias(c) for c in payload)]
    if hot.isEmpty():
        return rows.join(cold, on, how).select(*found)
    if spread is None or inner:
        rest = rows if inner else rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
        return rows.join(F.broadcast(hot), keys).select(*rows.columns, *payload).unionByName(rest.join(cold, on, how).select(*found))
    marks = hot.select(*keys, *(F.col(c).alias(f"_tz_hot_{c}") for c in payload), F.lit(True).alias("_tz_is_hot"))
    marked = rows.join(F.broadcast(marks), keys, "left").withColumn("_tz_is_hot", F.coalesce("_tz_is_hot", F.lit(False)))
    marked = marked.withColumn("_tz_key", F.when(F.col("_tz_is_hot"), spread.cast(rows.schema[keys[0]].dataType)).otherwise(F.col(keys[0])))
    on = (F.col("_tz_key") == F.col(f"_tz_cold_{keys[0]}")) & (F.col("_tz_is_hot") == F.col("_tz_cold_flag"))
    for k in keys[1:]:
        on = on & (F.col(k) == F.col(f"_tz_cold_{k}"))
    out = marked.join(cold, on, "left")
    return out.select(*rows.columns, *(F.coalesce(f"_tz_hot_{c}", f"_tz_cold_{c}").alias(c) for c in payload))
