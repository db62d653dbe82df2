"""Sums of term weights over texts, in two tiers.

Weights of the most frequent terms, as many as fit `SENT_BYTES`, are sent to the executors and summed inside the row: no row per term, no
shuffle. Only when there are more terms, those a text has left over are looked for in a bloom filter of the rare ones; what passes is joined
to the rare weights and added. Without rare terms the second tier is not in the plan. Both give the same sums.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from labelspark.session import ship, written

#: Bytes of the weights that are sent, and bits of the filter: bounds of what every Python worker of an executor holds, some times over.
SENT_BYTES = 1 << 24
FILTER_BITS = 1 << 26
#: A term's own bytes besides its weights, as counted against `SENT_BYTES`.
TERM_BYTES = 48
#: Texts looked up at a time, and numbers gathered at a time.
TEXTS, CELLS = 512, 1 << 20


class Tiers:
    """`terms` and their `weights` (one row each, a last row of zeros), and the rare rest: a table and its filter, or None."""

    def __init__(self, terms, weights, rare=None, bits=None):
        self.terms, self.weights, self.rare, self.bits = terms, weights, rare, bits


def _positions(terms, size):
    """Two filter positions of each term."""
    hashed = pd.util.hash_array(terms.to_numpy(zero_copy_only=False))
    return hashed % np.uint64(size), (hashed >> np.uint64(32)) * np.uint64(2654435761) % np.uint64(size)


def in_filter(terms, bits):
    """Whether each term may be a rare one, by the filter; none is without a filter."""
    held = np.full(len(terms), bits is not None)
    if bits is not None:
        for at in _positions(terms, len(bits) * 64):
            held &= (bits[at // np.uint64(64)] >> at % np.uint64(64) & np.uint64(1)).astype(bool)
    return held


def filter_of(table, n):
    """Bits set for every term of a table: words of 64 bits, folded by task, then by word."""
    ship(table.sparkSession)
    size = 64
    while size < min(16 * n, FILTER_BITS):
        size *= 2

    def run(batches):
        bits = np.zeros(size // 64, np.uint64)
        for batch in batches:
            for places in _positions(batch.column(0), size):
                np.bitwise_or.at(bits, places // np.uint64(64), np.uint64(1) << places % np.uint64(64))
        used = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(bits[used].view(np.int64))], names=["word", "bits"])

    words = table.select("term").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(size // 64, np.uint64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return bits


def _matrix(found, width):
    weights = np.zeros((found.num_rows + 1, width))
    entries = found.column("entries").combine_chunks()
    rows = np.repeat(np.arange(found.num_rows), pc.list_value_length(entries).to_numpy(zero_copy_only=False))
    flat = entries.flatten()
    weights[rows, flat.field("idx").to_numpy()] = flat.field("weight").to_numpy()
    return weights


def tiers(weights, width):
    """Tiers of a table (term, idx, weight) with `idx` below `width`; the terms of the largest weights are sent."""
    by_term = weights.groupBy("term").agg(F.collect_list(F.struct("idx", "weight")).alias("entries"), F.sum("weight").alias("total"))
    by_term = written(by_term, "term-weights")
    n, most = by_term.count(), max(1, SENT_BYTES // (TERM_BYTES + 8 * max(width, 1)))
    if n <= most:
        found = by_term.select("term", "entries").toArrow()
        return Tiers(found.column("term").combine_chunks(), _matrix(found, width))
    edge = by_term.select(F.percentile_approx("total", 1 - most / n, 10_000)).first()[0]
    found = by_term.where(F.col("total") > edge).orderBy(F.desc("total"), "term").limit(most).select("term", "entries").toArrow()
    names = found.column("term").combine_chunks()
    sent = written(weights.sparkSession.createDataFrame(pa.table({"term": names})), "sent-terms")
    rare = written(by_term.select("term", "entries").join(sent, "term", "left_anti"), "rare-terms")
    return Tiers(names, _matrix(found, width), rare, filter_of(rare, n - found.num_rows))


def listed_terms(column):
    """(terms of all texts in a row, how many each text has) of a column of lists."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    if flat.null_count:
        known = flat.is_valid().to_numpy(zero_copy_only=False)
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[known], minlength=len(sizes))
        flat = flat.drop_null()
    return flat, sizes


def term_sums(df, found, id_col, column, terms_of=listed_terms):
    """(id, n_terms, sums): how many terms each text has, and the sums of its terms' weights; `column` is read by `terms_of`."""
    ship(df.sparkSession)
    width = found.weights.shape[1]
    sent = df.sparkSession.sparkContext.broadcast((found.terms, found.weights, found.bits))
    kind = "bigint" if pa.types.is_integer(found.terms.type) else "string"
    rows = df.select(id_col, F.col(column).alias("_terms"))
    schema = StructType([rows.schema.fields[0], *StructType.fromDDL(f"n_terms long, sums array<double>, _rest array<{kind}>").fields])
    fields = to_arrow_schema(schema)

    def summed(weights, place, sizes):
        """Per text the sum of its terms' rows; `CELLS` numbers are gathered at a time."""
        sums, ends = np.zeros((len(sizes), width)), np.cumsum(sizes)
        step = max(1, CELLS // max(width, 1))
        for a in range(0, len(place), step):
            part = weights[place[a : a + step]]
            first = np.searchsorted(ends, a, side="right")
            last = np.searchsorted(ends, a + len(part), side="left")
            own = first + np.flatnonzero(sizes[first : last + 1])
            starts = np.maximum(ends[own] - sizes[own] - a, 0)
            sums[own] += np.add.reduceat(part, starts, axis=0)
        return sums

    def run(batches):
        known, weights, bits = sent.value
        for whole in batches:
            for start in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(start, TEXTS)
                flat, sizes = terms_of(batch.column(1))
                n = len(sizes)
                place = pc.fill_null(pc.index_in(flat, value_set=known), len(known)).to_numpy(zero_copy_only=False)
                rest, left = flat.slice(0, 0), np.zeros(n, np.int64)
                if bits is not None:
                    other = np.flatnonzero(place == len(known))
                    rest = flat.take(pa.array(other))
                    held = in_filter(rest, bits)
                    rest = rest.filter(pa.array(held))
                    left = np.bincount(np.repeat(np.arange(n), sizes)[other[held]], minlength=n)
                lists = [
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(each)]), pa.int32()), values)
                    for each, values in ((np.full(n, width), pa.array(summed(weights, place, sizes).ravel())), (left, rest))
                ]
                columns = [batch.column(0), pa.array(sizes, pa.int64()), *lists]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, fields, strict=True)], schema=fields)

    sums = rows.mapInArrow(run, schema)
    if found.rare is None:
        return sums.drop("_rest")
    sums = written(sums, "term-sums")
    more = sums.select(id_col, F.explode("_rest").alias("term")).join(found.rare, "term").select(id_col, F.explode("entries").alias("e"))
    more = more.groupBy(id_col, "e.idx").agg(F.sum("e.weight").alias("s"))
    more = more.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("idx", "s"))).alias("_more"))
    added = F.transform("sums", lambda x, k: x + F.coalesce(F.try_element_at("_more", k), F.lit(0.0)))
    return sums.drop("_rest").join(more, id_col, "left").select(id_col, "n_terms", added.alias("sums"))
