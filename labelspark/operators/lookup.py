"""Joins against small tables, and every row with every value of a list.

The engine picks the kind of join: a small side that is computed is written first, so its size in bytes is known before any
row of the big side moves. Adaptive execution splits hot keys of the others.
"""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from labelspark.session import written

#: Bytes of a list, as JSON, that may be paired with every row: it goes to all executors.
PAIRED_BYTES = 1 << 26


def lookup_join(big, small, on, how="inner"):
    """Join rows to a computed table with at most one row per key (class map, weights, offsets).

    `how` is one of inner, left, left_semi, left_anti. The table is written once; it is sent to the executors when its files
    are below `spark.sql.autoBroadcastJoinThreshold`, otherwise both sides are shuffled.
    """
    return big.join(written(small, "lookup"), on, how)


def pair_all(df, values, column):
    """Every row of `df` with every distinct non-null value of the one-column table `values`.

    The product is the result itself; the list of values, `PAIRED_BYTES` long at most, stands in the plan.
    """
    listed = values.select(column).where(F.col(column).isNotNull()).distinct()
    return beside_all(df, listed, "_pair").withColumn(column, F.col("_pair")[column]).drop("_pair")


def beside_all(df, table, name):
    """Every row of `df` beside every row of a small table as a struct `name`.

    The table becomes one value, an array, that is computed once before the rows are read; a table of more than `PAIRED_BYTES` is an error.
    """
    rows = F.struct(*[F.col(f"`{c}`") for c in table.columns])
    kept = written(table.select(rows.alias("_row")), "beside")
    size = kept.agg(F.sum(F.octet_length(F.to_json("_row")))).first()[0] or 0
    if size > PAIRED_BYTES:
        raise ValueError(f"{size} bytes to pair with every row; the bound is {PAIRED_BYTES}")
    listed = kept.groupBy().agg(F.sort_array(F.collect_list("_row")).alias("_rows"))
    return df.withColumn(name, F.explode(listed.scalar()))


def union_all(frames) -> DataFrame:
    """UNION ALL by name."""
    return reduce(lambda a, b: a.unionByName(b), frames)
