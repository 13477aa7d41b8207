"""Looking back along an order within a group, when one group may be too large for one task.

A plain window puts each group into one task. ``ordered_rows`` counts the groups first. When all are small the
plain window is used as is. When one is larger than ``max_group_rows``, the rows are range partitioned on
(keys, order), which cuts a large group into consecutive blocks of about that many rows at most, and the block number is fixed by a checkpoint.
Windows then run per (keys, block). What a block needs from earlier ones is a table of one row per (keys, block),
whose size depends on the number of groups and partitions and not on the rows of a group.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.functions.metrics import column
from tallyline.session import shared_folder

MAX_GROUP_ROWS = 1_000_000
BLOCK = "_block"


@dataclass(frozen=True)
class OrderedRows:
    """Rows with a block number; ``split`` says whether a group can have more than one block."""

    rows: DataFrame
    keys: tuple[str, ...]
    order: tuple[Column, ...]
    split: bool

    def _in_block(self):
        return Window.partitionBy(*map(column, self.keys), BLOCK).orderBy(*self.order)

    def _across_blocks(self):
        return Window.partitionBy(*map(column, self.keys)).orderBy(BLOCK)

    def _with_carry(self, carry: DataFrame) -> DataFrame:
        """Join the per-block table on (keys, block); null keys match each other."""
        names = [*self.keys, BLOCK]
        right = carry.select(*[column(name).alias(f"_k{i}") for i, name in enumerate(names)], "_carry")
        match = [column(name).eqNullSafe(F.col(f"_k{i}")) for i, name in enumerate(names)]
        joined = self.rows.join(right, match, "left")
        return joined.drop(*[f"_k{i}" for i in range(len(names))])

    def last_before(self, name: str, value: Column) -> OrderedRows:
        """Add the last non-null ``value`` among the strictly earlier rows of the group."""
        earlier = self._in_block().rowsBetween(Window.unboundedPreceding, -1)
        if not self.split:
            return replace(self, rows=self.rows.withColumn(name, F.last(value, ignorenulls=True).over(earlier)))
        last_of_block = (
            self.rows.withColumn("_value", value)
            .withColumn("_at", F.row_number().over(self._in_block()))
            .groupBy(*map(column, self.keys), BLOCK)
            .agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("_at"))).alias("_last"))
        )
        before = self._across_blocks().rowsBetween(Window.unboundedPreceding, -1)
        carry = last_of_block.withColumn("_carry", F.last("_last", ignorenulls=True).over(before))
        rows = self._with_carry(carry)
        found = F.coalesce(F.last(value, ignorenulls=True).over(earlier), F.col("_carry"))
        return replace(self, rows=rows.withColumn(name, found).drop("_carry"))

    def last_n_before(self, name: str, value: Column, n: int) -> OrderedRows:
        """Add the ``value`` of the up to ``n`` rows just before, oldest first. ``value`` must not be null."""
        earlier = self._in_block().rowsBetween(-n, -1)
        if not self.split:
            return replace(self, rows=self.rows.withColumn(name, F.collect_list(value).over(earlier)))
        newest_first = Window.partitionBy(*map(column, self.keys), BLOCK).orderBy(F.col("_at").desc())
        tails = (
            self.rows.withColumn("_value", value)
            .withColumn("_at", F.row_number().over(self._in_block()))
            .withColumn("_back", F.row_number().over(newest_first))
            .filter(F.col("_back") <= n)
            .groupBy(*map(column, self.keys), BLOCK)
            .agg(F.array_sort(F.collect_list(F.struct("_at", "_value"))).alias("_tail"))
            .withColumn("_tail", F.col("_tail._value"))
        )
        before = self._across_blocks().rowsBetween(-n, -1)
        carry = tails.withColumn("_carry", F.flatten(F.collect_list("_tail").over(before)))
        rows = self._with_carry(carry)
        both = F.concat(F.coalesce("_carry", F.array()), F.collect_list(value).over(earlier))
        rows = rows.withColumn("_both", both)
        start = F.greatest(F.size("_both") - n + 1, F.lit(1))
        return replace(self, rows=rows.withColumn(name, F.slice("_both", start, F.lit(n))).drop("_both", "_carry"))

    def number(self, name: str) -> OrderedRows:
        """Add the place of the row in its group, from 1."""
        place = F.row_number().over(self._in_block()).cast("bigint")
        if not self.split:
            return replace(self, rows=self.rows.withColumn(name, place))
        before = self._across_blocks().rowsBetween(Window.unboundedPreceding, -1)
        carry = (
            self.rows.groupBy(*map(column, self.keys), BLOCK)
            .agg(F.count(F.lit(1)).alias("_rows"))
            .withColumn("_carry", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        )
        rows = self._with_carry(carry).withColumn(name, place + F.col("_carry"))
        return replace(self, rows=rows.drop("_carry"))

    def done(self) -> DataFrame:
        return self.rows.drop(BLOCK)


def group_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """Rows of the largest group and of all; one pass over the key columns, counted in part before the shuffle."""
    sizes = df.groupBy(*map(column, keys)).agg(F.count(F.lit(1)).alias("n"))
    largest, total = sizes.agg(F.max("n"), F.sum("n")).first()
    return largest or 0, total or 0


def ordered_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    max_group_rows: int | None = MAX_GROUP_ROWS,
    count_in: DataFrame | None = None,
) -> OrderedRows:
    """Prepare ``df`` for looking back along ``order`` within ``keys``. The order must have no ties in a group.

    The groups are counted in ``count_in`` when that is cheaper, such as the source of ``df``; its groups must not be
    smaller. Pass None for ``max_group_rows`` only where groups are small by construction; they are then not counted.
    """
    largest, total = (0, 0) if max_group_rows is None else group_sizes(df if count_in is None else count_in, keys)
    if max_group_rows is None or largest <= max_group_rows:
        return OrderedRows(df.withColumn(BLOCK, F.lit(0)), tuple(keys), tuple(order), split=False)
    spark = df.sparkSession
    shared_folder(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // max_group_rows))
    blocks = df.repartitionByRange(parts, *map(column, keys), *order).withColumn(BLOCK, F.spark_partition_id())
    return OrderedRows(blocks.checkpoint(), tuple(keys), tuple(order), split=True)
