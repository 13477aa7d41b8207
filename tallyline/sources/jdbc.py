"""SQL databases as a source, read in parallel ranges of a partition column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyline.operators.sql_audit import check_text

FETCH_ROWS = 10_000


def jdbc_options(
    url: str,
    table: str | None = None,
    query: str | None = None,
    partition_column: str | None = None,
    bounds: tuple[object, object] | None = None,
    num_partitions: int | None = None,
    fetch_rows: int = FETCH_ROWS,
    properties: dict[str, str] | None = None,
) -> dict[str, str]:
    """Reader options for one table or one query.

    Parallel ranges need a table or query as ``dbtable``, a numeric or time column and its bounds. Rows outside the
    bounds are still read, by the first and the last range. Bounds of an empty table, or of a column without values, are
    nulls; then there is nothing to split and one task reads.
    """
    if (table is None) == (query is None):
        raise ValueError("Give either a table or a query")
    source = table if table is not None else f"({query.strip().rstrip(';')}) source"
    options = {"url": url, "dbtable": source, "fetchsize": str(fetch_rows), **(properties or {})}
    if partition_column is not None:
        if bounds is None or num_partitions is None:
            raise ValueError("Parallel reads need bounds and a number of partitions")
        if None in bounds:
            return options
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(num_partitions),
        }
    return options


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str | None = None,
    query: str | None = None,
    partition_column: str | None = None,
    bounds: tuple[object, object] | None = None,
    num_partitions: int | None = None,
    single_task: bool = False,
    **settings,
) -> DataFrame:
    """Read one table or one read-only query; a query goes through the same checks as guarded SQL.

    With a partition column the bounds are asked from the database and the ranges are as many as shuffle partitions,
    unless they are given. Without one, one task reads everything, which must be asked for.
    """
    if query is not None:
        errors = check_text(spark, query)
        if errors:
            raise ValueError(f"Query is not read-only: {'; '.join(errors)}")
    if partition_column is None and not single_task:
        raise ValueError("Name a numeric or time partition column, or pass single_task=True to read in one task")
    if partition_column is not None:
        if bounds is None:
            source = table if table is not None else f"({query.strip().rstrip(';')}) bounded"
            bounds = column_bounds(spark, url, source, partition_column, **settings)
        num_partitions = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    options = jdbc_options(url, table, query, partition_column, bounds, num_partitions, **settings)
    return spark.read.format("jdbc").options(**options).load()


def column_bounds(spark: SparkSession, url: str, table: str, name: str, **settings) -> tuple[object, object]:
    """The smallest and largest value of a column, computed by the database."""
    bounds = f"SELECT MIN({name}) AS lo, MAX({name}) AS hi FROM {table}"
    row = read_jdbc(spark, url, query=bounds, single_task=True, **settings).first()
    return row[0], row[1]
