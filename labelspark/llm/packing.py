"""Concatenate and cut: token streams in fixed windows, from two passes of prefix sums.

Pass one writes each document's ids with the tokens before it inside its partition. The partitions' totals, one number each, give
every partition its place in the whole stream. Pass two cuts the stream every `window` ids; a document that crosses a border gets a
piece on either side of it, so only the last sequence of all is short.

Null and empty texts hold only the end id. Rows with equal ids or null ids are documents of their own. An empty table gives no
piece. Very long texts are cut like any other. Columns besides the id and the text are not read.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelspark.llm import shared
from labelspark.llm.token_ids import default_path, pieces, width_of
from labelspark.session import small_batches

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padding long"
#: Totals of so many partitions, 16 bytes each, may be sent to all executors; beyond it they are joined.
SENT_PARTS = 1 << 20
#: Pieces of text whose ids a worker process keeps, and texts that come to it, or ids that it gives, at once.
KEEP, TEXTS = 240_000, 1024


def token_stream(docs, path, end_id, id_col="doc_id", text_col="text"):
    """(part, doc_id, before, n, ids): ids as unsigned integers of the tokenizer's width, `before` counts those earlier in the part."""
    spark = docs.sparkSession
    shared.ship(spark)
    fields = pa.schema(
        [("part", pa.int64()), ("doc_id", pa.int64()), ("before", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())]
    )

    def run(batches):
        part, before = TaskContext.get().partitionId(), 0
        coder = pieces(path, KEEP)
        end = np.array([end_id], dtype=coder.dtype).tobytes()
        for batch in shared.parts(batches, TEXTS):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in shared.slices(texts):
                coded = [x + end for x in coder.encode(texts[a:b])]
                sizes = np.array([len(x) // len(end) for x in coded], dtype=np.int64)
                starts = before + np.cumsum(sizes) - sizes
                before += int(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(b - a, part)), pa.array(ids[a:b], pa.int64()), pa.array(starts), pa.array(sizes), pa.array(coded, pa.binary())],
                    schema=fields,
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), shared.text_or_empty(text_col).alias("text"))
    with small_batches(spark, TEXTS):
        return shared.stored(rows.mapInArrow(run, "part long, doc_id long, before long, n long, ids binary"), "tokens")


def part_places(rows):
    """((part, offset) with the ids in all parts before it, all ids): one total per partition of the pass that wrote `rows`."""
    totals = rows.groupBy("part").agg(F.sum("n").alias("total")).orderBy("part").collect()
    offset, places = 0, []
    for row in totals:
        places.append((row["part"], offset))
        offset += row["total"]
    schema = T.StructType([T.StructField("part", T.LongType()), T.StructField("offset", T.LongType())])
    found = rows.sparkSession.createDataFrame(places, schema)
    return F.broadcast(found) if len(places) <= SENT_PARTS else found, offset


def pack(docs, path=None, window=2048, end_id=1, id_col="doc_id", text_col="text"):
    """Pieces of documents in sequences of `window` ids, in the order of the input's partitions.

    `padding`: how many ids the piece's sequence is filled up with.
    """
    path = path or default_path()
    width = width_of(path)
    tokens = token_stream(docs, path, end_id, id_col, text_col)
    places, total = part_places(tokens)
    last, rest = divmod(total, window)
    # Only the last sequence is short: it is filled up to the window, unless its length is a power of two.
    missing = window - rest if rest & (rest - 1) else 0
    placed = tokens.join(places, "part").select("doc_id", (F.col("before") + F.col("offset")).alias("place"), "ids")

    def cut(columns):
        out = {name: [] for name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padding")}
        for doc, place, data in zip(columns["doc_id"], columns["place"], columns["ids"], strict=True):
            ids = np.frombuffer(data, dtype=f"<u{width}").astype("<u4")
            start = 0
            while start < len(ids):
                at = place + start
                length = min(window - at % window, len(ids) - start)
                for name, value in zip(
                    out,
                    (doc, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids), at // window, at % window, missing if at // window == last else 0),
                    strict=True,
                ):
                    out[name].append(value)
                start += length
        return out

    return placed.mapInArrow(shared.per_batch(cut, PIECES), PIECES)
