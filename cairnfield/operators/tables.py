"""Attribute tables: stacking, consolidation of batches, paging. Values are text, as files give them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise


def as_text(table: DataFrame) -> DataFrame:
    return table.select(*[F.col(c).cast("string").alias(c) for c in table.columns])


def concatenate(*tables: DataFrame) -> DataFrame:
    """Rows of all tables, one after the other, columns by name in order of first sight; missing values are "".

    Nothing is joined and nothing deduplicated.
    """
    rows = as_text(tables[0])
    for t in tables[1:]:
        rows = rows.unionByName(as_text(t), allowMissingColumns=True)
    return rows.fillna("")


def consolidate_tables(*tables: DataFrame) -> DataFrame:
    return concatenate(*tables)


def consolidate_vectors(*tables: DataFrame) -> DataFrame:
    """Features of several batches; repeats stay."""
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t, allowMissingColumns=True)
    return rows


def page(table: DataFrame, order: list[str], limit: int, offset: int = 0) -> DataFrame:
    """A page as text; order makes it the same page each time. Cost follows offset + limit, not the table."""
    return as_text(table.orderBy(*order).offset(offset).limit(limit))


def distinct_pairs(table: DataFrame, a: str, b: str) -> DataFrame:
    return table.select(a, b).distinct()


def ordered_by_gid(table: DataFrame) -> DataFrame:
    """Keyed tables are ordered by gid as text."""
    return table.orderBy("gid")


def ranked(table: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """table with each row's place (from 0) in the order of all rows, without putting them into one task.

    Rows are dealt by range and written, ranges get prefix sums of their counts (one number each), and rows are numbered
    within their range.
    """
    dealt = materialise(table.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("__part").count().select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base"))
    at = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return dealt.join(F.broadcast(bases), "__part").select(*table.columns, (F.col("__base") + at).cast("long").alias(name))


def numbered(table: DataFrame, order: list[str], by: list[str], name: str = "fid") -> DataFrame:
    """Row numbers within each group of by."""
    return table.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
