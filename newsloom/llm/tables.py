"""Reading the input tables and small schema helpers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.plans.lineage import cut_lineage


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def with_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop empty batches, which carry nothing for a map over rows."""
    return (b for b in batches if b.num_rows)


def lower_in_place(text: str) -> str:
    """Lower case at unchanged positions; a letter that would grow when lowered stays as it is."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores in front as it takes to be no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def row_order(df: DataFrame) -> Column:
    """A digest of the whole row: equal for equal rows only, so that picking one of several does not depend on their place."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])


def keep_one(docs: DataFrame, marked: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """One row of ``docs`` per row of ``marked``, all columns kept; texts are shuffled once, twice if keys repeat.

    ``marked`` has the names of ``keys`` as columns, each combination once, and ``n``, the number of rows of ``docs`` that
    have it. Only rows that share all keys with another one are ranked; the first by ``row_order`` stays.
    """
    marked = cut_lineage(marked)
    own = fresh_names(docs, *[f"key_{k}" for k in range(len(keys))], "rows_of_key", "order_in_key")
    *names, count, order = own
    keyed = docs.withColumns(dict(zip([*names, order], [*keys.values(), row_order(docs)], strict=True)))
    sides = fresh_names(keyed, *[f"marked_{k}" for k in range(len(keys))])
    other = marked.select(*[F.col(k).alias(s) for k, s in zip(keys, sides, strict=True)], F.col("n").alias(count))
    same = F.lit(True)
    for a, b in zip(names, sides, strict=True):
        same = same & keyed[a].eqNullSafe(other[b])
    columns = [f"`{c}`" for c in docs.columns]
    single = keyed.join(other.filter(F.col(count) == 1), same).select(*columns)
    if marked.filter("n > 1").isEmpty():
        return single
    several = keyed.join(other.filter(F.col(count) > 1), same)
    place = fresh_names(several, "place_in_key")[0]
    first = several.withColumn(place, F.row_number().over(Window.partitionBy(*names).orderBy(order))).filter(F.col(place) == 1)
    return single.unionByName(first.select(*columns))
