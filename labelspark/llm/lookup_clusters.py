"""Centroid clustering of integer vectors by scalar lookup tables.

Vectors become whole numbers once and are written in blocks: a block keeps, per dimension, the values that occur in it in ascending order,
and each vector as places in these lists. In a round every block tabulates the squared difference of each dimension, occurring value and
centroid; a vector's distances are then sums of table cells gathered by its places. A block holds `BLOCK` vectors, so tables and
places are of bounded size however many values occur; only the centroids travel. Sums per cluster are exact and are folded per
task, then by the engine; the driver sees one row per cluster and dimension.

Kept are vectors of exactly `size` components, none null or non-finite; others have no row. Repeated rows and ids are vectors of their
own. A null id hashes as if it were absent and is the last to be chosen as a first centroid. Vectors with equal ids are ordered by their
components there. Fewer vectors than centroids give fewer centroids; without vectors the result is empty. A component beyond `LARGEST` after
scaling is an error, as its distances need not fit a long. Columns besides id and vector are not read.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from labelspark.llm import shared

BLOCK = 1 << 14
LARGEST = 1 << 27


def scaled(vectors, size=64, scale=1024, id_col="vec_id", vector_col="embedding"):
    """(vec_id, v): the kept vectors, every component x as the whole number floor(scale * x)."""
    parts = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), parts.alias("x"))
    finite = lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))  # noqa: E731  NaN is above infinity here
    kept = rows.where((F.size("x") == size) & F.forall("x", finite))
    whole = F.transform("x", lambda x: F.floor(F.lit(scale) * x))
    fits = F.forall("x", lambda x: F.abs(F.lit(scale) * x) <= LARGEST)
    checked = F.when(fits, whole).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST} after scaling")))
    return kept.select("vec_id", checked.alias("v"))


def blocks_of(vectors, size):
    """(ids, named, values, ends, places): blocks of up to `BLOCK` vectors, coded by the values that occur in each dimension."""
    fields = pa.schema([("ids", pa.binary()), ("named", pa.binary()), ("values", pa.binary()), ("ends", pa.binary()), ("places", pa.binary())])

    def block(ids, named, table):
        listed, places = [], np.empty((size, len(ids)), "<u2")
        for d in range(size):
            values, places[d] = np.unique(table[:, d], return_inverse=True)
            listed.append(values.astype("<i8"))
        ends = np.cumsum([len(x) for x in listed]).astype("<i8")
        cells = (ids.astype("<i8"), named.astype("u1"), np.concatenate(listed), ends, places)
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in cells], schema=fields)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(start, BLOCK)
                ids = piece.column(0)
                table = piece.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                held.append((ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False), table))
                n += piece.num_rows
                while n >= BLOCK:
                    whole = [np.concatenate(x) for x in zip(*held, strict=True)]
                    yield block(*[x[:BLOCK] for x in whole])
                    held, n = [tuple(x[BLOCK:] for x in whole)], n - BLOCK
        if n:
            yield block(*[np.concatenate(x) for x in zip(*held, strict=True)])

    coded = vectors.mapInArrow(run, "ids binary, named binary, values binary, ends binary, places binary")
    return shared.stored(coded, "clusters")


def opened(batch, size):
    """(ids, which ids are known, values per dimension, places per dimension and vector) of the blocks of a batch."""
    for ids, named, values, ends, places in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
        ids, named = np.frombuffer(ids, "<i8"), np.frombuffer(named, "u1").astype(bool)
        listed = np.split(np.frombuffer(values, "<i8"), np.frombuffer(ends, "<i8")[:-1])
        yield ids, named, listed, np.frombuffer(places, "<u2").reshape(size, len(ids))


def nearest(listed, places, centroids):
    """(cluster, squared distance) of each vector of a block: table cells gathered and summed; the smaller number wins a tie."""
    total = np.zeros((places.shape[1], len(centroids)), np.int64)
    for d, values in enumerate(listed):
        table = values[:, None] - centroids[None, :, d]
        total += np.take(table * table, places[d], axis=0)
    cluster = total.argmin(axis=1)
    return cluster, total[np.arange(len(cluster)), cluster]


def round_sums(blocks, centroids, size):
    """[(cluster, dim, sum, vectors, sum of distances)]: exact sums of the vectors nearest to each centroid."""
    fields = pa.schema([("cluster", pa.int32()), ("dim", pa.int32()), ("total", pa.int64()), ("n", pa.int64()), ("spent", pa.int64())])

    def run(batches):
        for batch in batches:
            for ids, _, listed, places in opened(batch, size):
                cluster, distance = nearest(listed, places, centroids)
                found = np.unique(cluster)
                n = np.bincount(cluster, minlength=len(centroids))
                totals = np.zeros((len(centroids), size), np.int64)
                spent = np.zeros(len(centroids), np.int64)
                for c in found:
                    mine = cluster == c
                    spent[c] = distance[mine].sum()
                    for d, values in enumerate(listed):
                        totals[c, d] = values[places[d][mine]].sum()
                columns = [np.repeat(found, size), np.tile(np.arange(size), len(found)), totals[found].ravel(), np.repeat(n[found], size), np.repeat(spent[found], size)]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, fields, strict=True)], schema=fields)

    sums = blocks.mapInArrow(run, "cluster int, dim int, total long, n long, spent long")
    exact = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("total", "n", "spent")]
    return sums.groupBy("cluster", "dim").agg(*exact).collect()


def moved(centroids, sums):
    """Centroids after a round: the floor of the exact mean; those without vectors stay."""
    after = centroids.copy()
    for row in sums:
        after[row["cluster"], row["dim"]] = int(row["total"]) // int(row["n"])
    return after


def first_centroids(vectors, k, seed):
    """The k vectors with the smallest sha256 of `<seed>:<vec_id>`, in that order."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(F.asc_nulls_last(name), "v").limit(k).collect()
    return np.array([row["v"] for row in rows], np.int64)


OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def cluster(vectors, k=8, rounds=10, size=64, scale=1024, seed=3, id_col="vec_id", vector_col="embedding"):
    """(rows of `OUT`, one per kept vector; the final centroids as an array of k x size whole numbers)."""
    spark = vectors.sparkSession
    shared.ship(spark)
    kept = scaled(vectors, size, scale, id_col, vector_col)
    centroids = first_centroids(kept, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], OUT), centroids
    blocks = blocks_of(kept, size)
    for _ in range(rounds):
        centroids = moved(centroids, round_sums(blocks, centroids, size))
    spent = {row["cluster"]: int(row["spent"]) for row in round_sums(blocks, centroids, size) if row["dim"] == 0}
    inertia = sum(spent.values())
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = np.array([spent.get(c, 0) for c in range(len(centroids))], np.int64)

    def run(batches):
        for batch in batches:
            for ids, named, listed, places in opened(batch, size):
                mine, distance = nearest(listed, places, centroids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64(), mask=~named),
                        pa.array(mine, pa.int32()),
                        pa.array(distance, pa.int64()),
                        pa.array(of[mine], pa.int64()),
                        pa.array(np.full(len(ids), inertia), pa.int64()),
                        pa.array([names[c] for c in mine], pa.string()),
                    ],
                    names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    return blocks.mapInArrow(run, OUT), centroids
