"""Exact ranks, cut points and running values without one big window.

A window over a whole class would put that class into one task. Here every rank is counted in two
steps: rows fall into many even buckets, bucket totals give the offset, and a window inside the bucket
gives the rest. Only bucket totals ever meet per group.
"""

from decimal import Decimal

from pyspark.sql import Window as W, functions as F

from labelspark.operators.lookup import lookup_join
from labelspark.session import written

BUCKET_DIGITS = 3
CHUNK = 65_536


def seeded_key(column, seed):
    """Pseudo-random but repeatable sort key: md5 of the value and the seed."""
    return F.md5(F.concat(F.col(column).cast("string"), F.lit(f"-{seed}")))


def stratum(columns):
    """One string for the columns that make up a group; empty for the whole table."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0001")) for c in columns]
    return F.concat_ws("\u0002", *parts) if parts else F.lit("")


def chunk_of(column, size):
    """Number of the fixed-size range an integer falls into, without rounding large ids."""
    return F.call_function("div", F.col(column), F.lit(size))


def _bucket_totals(keyed):
    order = W.partitionBy("_s").orderBy("_b")
    return (
        keyed.groupBy("_s", "_b")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.sum("_n").over(order) - F.col("_n"))
        .withColumn("_total", F.sum("_n").over(W.partitionBy("_s")))
    )


def cut_keys(df, strata, key, fractions, digits=BUCKET_DIGITS):
    """Per stratum the key at rank floor(n * fraction), for each named fraction.

    Returns `_s` and one column per name, '' where the rank is zero. Rows are never shuffled whole:
    the first pass counts buckets, the second ranks only the buckets that hold a cut.
    """
    keyed = df.select(stratum(strata).alias("_s"), key.alias("_k"))
    keyed = keyed.withColumn("_b", F.substring("_k", 1, digits))
    wanted = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.floor(F.col("_total") * F.lit(Decimal(str(fraction)))).cast("bigint").alias("rank"),
            )
            for name, fraction in fractions.items()
        ]
    )
    cuts = (
        _bucket_totals(keyed)
        .withColumn("_cut", F.explode(wanted))
        .where("_cut.rank > _before and _cut.rank <= _before + _n")
        .select("_s", "_b", F.col("_cut.name").alias("_name"), (F.col("_cut.rank") - F.col("_before")).alias("_r"))
    )
    cuts = written(cuts, "cuts")
    needed = lookup_join(keyed, cuts.select("_s", "_b").distinct(), ["_s", "_b"], "left_semi")
    ranked = needed.withColumn("_r", F.row_number().over(W.partitionBy("_b", "_s").orderBy("_k")).cast("bigint"))
    found = ranked.join(cuts, ["_s", "_b", "_r"])
    return found.groupBy("_s").agg(
        *[F.coalesce(F.max(F.when(F.col("_name") == name, F.col("_k"))), F.lit("")).alias(name) for name in fractions]
    )


def numbered(df, strata, key, digits=BUCKET_DIGITS, wanted=None):
    """Adds `_pos` (1..n inside the stratum, in key order); `key` must be evenly spread hex text.

    With a short table `wanted` (strata columns and `_pos`) only the buckets that hold one of these
    positions are ranked, and rows of other buckets are left out.
    """
    keyed = df.withColumn("_s", stratum(strata)).withColumn("_k", key)
    keyed = keyed.withColumn("_b", F.substring("_k", 1, digits))
    totals = _bucket_totals(keyed)
    offsets = totals.select("_s", "_b", "_before")
    if wanted is not None:
        places = wanted.select(stratum(strata).alias("_s"), "_pos")
        hit = totals.join(places, "_s").where("_pos > _before and _pos <= _before + _n")
        keyed = lookup_join(keyed, hit.select("_s", "_b").distinct(), ["_s", "_b"], "left_semi")
    inside = F.row_number().over(W.partitionBy("_b", "_s").orderBy("_k"))
    ranked = keyed.withColumn("_i", inside.cast("bigint"))
    return (
        lookup_join(ranked, offsets, ["_s", "_b"])
        .withColumn("_pos", F.col("_before") + F.col("_i"))
        .drop("_s", "_k", "_b", "_i", "_before")
    )


def row_index(df, id_col, name="row_index", chunk=CHUNK):
    """Consecutive 0-based index in the order of the id columns, the first of which holds integers.

    Rows fall into ranges of `chunk` ids; a window numbers those of a range.
    """
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    chunked = df.withColumn("_c", _level(ids[0], chunk, 1))
    offsets = running_offsets(chunked.groupBy("_c").agg(F.count(F.lit(1)).alias("_n")), [], "_c", "_n")
    inside = F.row_number().over(W.partitionBy("_c").orderBy(*ids)).cast("bigint") - 1
    ranked = chunked.withColumn("_i", inside)
    return (
        lookup_join(ranked, offsets, "_c")
        .withColumn(name, F.col("_before") + F.col("_i"))
        .drop("_c", "_i", "_before")
    )


def _range(totals, chunk, fan):
    """(lowest chunk, how often numbers counted from it are divided by `fan` until all are zero)"""
    low, high = totals.agg(F.min(chunk), F.max(chunk)).first()
    span, n = (high - low if low is not None else 0), 0
    while span:
        span, n = span // fan, n + 1
    return low or 0, n


def _level(column, fan, n):
    """The column divided by `fan` n times, rounded down; negative numbers too."""
    return F.call_function("div", F.col(column) - F.pmod(F.col(column), F.lit(fan**n)), F.lit(fan**n))


def running_offsets(totals, groups, chunk, value, fan=1024):
    """Sum of `value` over all earlier chunks of the group.

    Chunks are summed in levels, `fan` of one level to one of the next, as many levels as their range needs: a window never
    has more than `fan` rows, however sparse the numbers are.
    """
    totals = written(totals.select(*groups, chunk, F.col(value).alias("_v0")), "totals")
    low, levels = _range(totals, chunk, fan)
    totals = totals.withColumn("_c0", F.col(chunk) - F.lit(low))
    found, below = totals.withColumn("_before", F.lit(0).cast("bigint")), totals.select(*groups, "_c0", "_v0")
    for n in range(levels):
        above = below.withColumn("_up", _level("_c0", fan, 1))
        earlier = F.sum("_v0").over(W.partitionBy(*groups, "_up").orderBy("_c0")) - F.col("_v0")
        part = above.select(*groups, F.col("_c0").alias("_at"), earlier.alias("_part"))
        found = found.withColumn("_at", _level("_c0", fan, n)).join(part, [*groups, "_at"]).withColumn("_before", F.col("_before") + F.col("_part"))
        found = found.drop("_at", "_part")
        below = above.groupBy(*groups, F.col("_up").alias("_c0")).agg(F.sum("_v0").alias("_v0"))
    return found.select(*groups, chunk, "_before")


def last_before(ends, groups, chunk, columns, fan=1024):
    """(groups, chunk, _v_<column>): the last non-null cell `_e_<column>` of earlier chunks, in the same levels."""
    ends = written(ends, "ends")
    low, levels = _range(ends, chunk, fan)
    ends = ends.withColumn("_c0", F.col(chunk) - F.lit(low))
    found = ends.select(*groups, chunk, "_c0", *[F.lit(None).cast(ends.schema[f"_e_{c}"].dataType).alias(f"_v_{c}") for c in columns])
    below = ends.drop(chunk)
    for n in range(levels):
        above = below.withColumn("_up", _level("_c0", fan, 1))
        earlier = W.partitionBy(*groups, "_up").orderBy("_c0").rowsBetween(W.unboundedPreceding, -1)
        part = above.select(*groups, F.col("_c0").alias("_at"), *[F.last(f"_e_{c}", ignorenulls=True).over(earlier).alias(f"_p_{c}") for c in columns])
        found = found.withColumn("_at", _level("_c0", fan, n)).join(part, [*groups, "_at"])
        # a nearer level wins over a farther one
        found = found.select(*groups, chunk, "_c0", *[F.coalesce(f"_v_{c}", f"_p_{c}").alias(f"_v_{c}") for c in columns])
        below = above.groupBy(*groups, F.col("_up").alias("_c0")).agg(
            *[F.max_by(f"_e_{c}", F.when(F.col(f"_e_{c}").isNotNull(), F.col("_c0"))).alias(f"_e_{c}") for c in columns]
        )
    return found.drop("_c0")


def running_sum(df, groups, position, value, name, chunk=CHUNK):
    """Inclusive running sum of an integer column along `position`, chunk by chunk."""
    chunked = df.withColumn("_c", _level(position, chunk, 1))
    totals = chunked.groupBy(*groups, "_c").agg(F.sum(value).alias("_n"))
    offsets = running_offsets(totals, groups, "_c", "_n")
    inside = F.sum(value).over(W.partitionBy(*groups, "_c").orderBy(position))
    return (
        lookup_join(chunked.withColumn("_i", inside), offsets, groups + ["_c"])
        .withColumn(name, F.col("_before") + F.col("_i"))
        .drop("_c", "_i", "_before")
    )


def fill_down(df, groups, position, columns, chunk=CHUNK):
    """Null cells take the last value above them; the carry between chunks travels in a small table."""
    chunked = df.withColumn("_c", _level(position, chunk, 1))
    inside = W.partitionBy(*groups, "_c").orderBy(position)
    ends = chunked.groupBy(*groups, "_c").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(position))).alias(f"_e_{c}") for c in columns]
    )
    carry = last_before(ends, groups, "_c", columns)
    filled = chunked.select(
        *[c for c in df.columns if c not in columns],
        "_c",
        *[F.last(c, ignorenulls=True).over(inside).alias(c) for c in columns],
    )
    joined = lookup_join(filled, carry, groups + ["_c"], "left")
    return joined.select(
        *[F.coalesce(F.col(c), F.col(f"_v_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns]
    )
