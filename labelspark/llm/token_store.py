"""Token ids in files: one zstandard dictionary for all, every document compressed for itself.

A file is a run of documents in ascending id order:

    header   b"LTID", version u16, id width u16, dictionary sha256 (32 bytes), documents u64
    index    per document: doc_id i64, ids u64, frame offset u64 (from the first frame); then the end of the last frame u64
    frames   zstandard frames of the little-endian ids, each readable with the dictionary alone

Files are binary records of a Parquet table in the shared folder, written and committed by Spark, so any store works and a lost task
is repeated. The dictionary is fitted on a bounded sample of documents (`SAMPLE_DOCS`), lies beside the files and is named in each by
its hash. `read_document` opens one document from the offsets without touching the others.

Null and empty texts hold only the end id. Equal ids are kept as documents of their own, in any order among themselves; rows with null
ids come first. Without documents there is a dictionary-less, empty store.
"""

import hashlib
import math
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import functions as F

from labelspark.llm import shared
from labelspark.llm.packing import KEEP, part_places
from labelspark.llm.token_ids import default_path, pieces, width_of
from labelspark.session import shared_folder

MAGIC, VERSION = b"LTID", 1
HEADER = struct.Struct("<4sHH32sQ")
ENTRY = np.dtype([("doc_id", "<i8"), ("n", "<u8"), ("offset", "<u8")])
NO_ID = -(1 << 63)
#: The dictionary is fitted on at most so many documents, and on at most so many bytes of each.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 2000, 4096, 1 << 16
#: A file closes at so many ids.
FILE_IDS = 1 << 22


def train_dictionary(docs, path, end_id, id_col, text_col, size=DICTIONARY_BYTES):
    """Dictionary bytes from serialized ids of the `SAMPLE_DOCS` documents whose id hashes lowest; empty if they are too few."""
    shared.ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), shared.text_or_empty(text_col).alias("text"))
    key = F.xxhash64("doc_id")
    # a bound from the ids alone; the texts are then read once, by a plain filter
    lowest = rows.select(key.alias("key")).distinct().orderBy("key").limit(SAMPLE_DOCS).agg(F.max("key")).first()[0]
    chosen = rows.where(key <= F.lit(lowest).cast("bigint")).limit(SAMPLE_DOCS)

    def serialize(columns):
        coder = pieces(path)
        end = np.array([end_id], dtype=coder.dtype).tobytes()
        return {"ids": [(x + end)[:SAMPLE_BYTES] for x in coder.encode(columns["text"])]}

    samples = [bytes(row[0]) for row in chosen.mapInArrow(shared.per_batch(serialize, "ids binary"), "ids binary").collect()]
    samples = sorted(x for x in samples if len(x) >= 8)
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def compressor(dictionary, level):
    return zstandard.ZstdCompressor(level=level, **({"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}))


def decompressor(dictionary):
    return zstandard.ZstdDecompressor(**({"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}))


def encode_file(doc_ids, sizes, frames, width, digest):
    index = np.zeros(len(frames), dtype=ENTRY)
    index["doc_id"] = [NO_ID if x is None else x for x in doc_ids]
    index["n"] = sizes
    ends = np.cumsum([len(x) for x in frames], dtype=np.uint64)
    index["offset"][1:] = ends[:-1]
    return b"".join([HEADER.pack(MAGIC, VERSION, width, digest, len(frames)), index.tobytes(), struct.pack("<Q", int(ends[-1])), *frames])


def open_file(data):
    """(index, width, dictionary digest, place of the first frame, ends of the frames)"""
    magic, version, width, digest, n = HEADER.unpack_from(data)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a token file of this version")
    index = np.frombuffer(data, dtype=ENTRY, count=n, offset=HEADER.size)
    first = HEADER.size + n * ENTRY.itemsize
    (last,) = struct.unpack_from("<Q", data, first)
    return index, width, digest, first + 8, np.append(index["offset"][1:], np.uint64(last)).astype(np.int64)


def read_document(data, k, dictionary):
    """Ids of the k-th document of a file."""
    index, width, digest, first, ends = open_file(data)
    if hashlib.sha256(dictionary).digest() != digest:
        raise ValueError("the file was written with another dictionary")
    frame = data[first + int(index["offset"][k]) : first + int(ends[k])]
    return np.frombuffer(decompressor(dictionary).decompress(frame), dtype=f"<u{width}").astype("<u4")


def range_number(rows, parts):
    """The number of the id range a row falls into: ranges of about as many rows each, from the ids alone; null ids come first."""
    shares = [k / parts for k in range(1, parts)]
    found = rows.agg(F.percentile_approx("doc_id", shares, 100 * parts).alias("b")).first()["b"] if shares else None
    bounds = sorted(set(found or []))
    wide = math.isqrt(len(bounds)) + 1
    groups = [bounds[a : a + wide] for a in range(0, len(bounds), wide)]
    if not groups:
        return F.lit(0)
    # two short searches: which group of bounds, then where in it
    nested = F.array(*[F.array(*[F.lit(x).cast("bigint") for x in group]) for group in groups])
    first = F.size(F.filter(F.array(*[F.lit(group[-1]).cast("bigint") for group in groups]), lambda b: b < F.col("doc_id")))
    inside = F.size(F.filter(F.coalesce(F.get(nested, first), F.array().cast("array<bigint>")), lambda b: b < F.col("doc_id")))
    return F.when(F.col("doc_id").isNull(), 0).otherwise(F.least(first * wide + inside, F.lit(parts - 1))).cast("int")


def write_store(docs, folder, path=None, end_id=2, level=3, file_ids=FILE_IDS, id_col="doc_id", text_col="text"):
    """Writes `folder`/dictionary and `folder`/files; rows of the latter: part, ids earlier in the part, docs, ids, data.

    Range partitions ascend with the ids, so part and place in it order the whole.
    """
    path = path or default_path()
    spark = docs.sparkSession
    shared.ship(spark)
    dictionary = train_dictionary(docs, path, end_id, id_col, text_col)
    digest = hashlib.sha256(dictionary).digest()
    spark.createDataFrame([(digest, dictionary)], "digest binary, dictionary binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    sent = spark.sparkContext.broadcast(dictionary)
    fields = pa.schema([("part", pa.int64()), ("before", pa.int64()), ("docs", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])

    def run(batches):
        coder, packer = pieces(path, KEEP), compressor(sent.value, level)
        end = np.array([end_id], dtype=coder.dtype).tobytes()
        part, before = TaskContext.get().partitionId(), 0
        ids, sizes, frames, held = [], [], [], 0

        def file():
            data = encode_file(ids, sizes, frames, len(end), digest)
            columns = [pa.array([x], pa.int64()) for x in (part, before, len(ids), held)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([data], pa.binary())], schema=fields)

        for batch in shared.parts(batches):
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in shared.slices(texts):
                for key, coded in zip(keys[a:b], coder.encode(texts[a:b]), strict=True):
                    n = len(coded) // len(end) + 1
                    ids.append(key)
                    sizes.append(n)
                    frames.append(packer.compress(coded + end))
                    held += n
                    if held >= file_ids:
                        yield file()
                        before += held
                        ids, sizes, frames, held = [], [], [], 0
        if ids:
            yield file()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), shared.text_or_empty(text_col).alias("text"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionById(parts, range_number(rows, parts)).sortWithinPartitions("doc_id")
    ordered.mapInArrow(run, "part long, before long, docs long, n long, data binary").write.option("compression", "none").parquet(
        f"{folder}/files"
    )


def read_store(spark, folder):
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    shared.ship(spark)
    found = spark.read.parquet(f"{folder}/dictionary").first()
    sent = spark.sparkContext.broadcast(bytes(found["dictionary"]))
    files = spark.read.parquet(f"{folder}/files")
    places, _ = part_places(files)
    out = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def read(columns):
        got = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
        reader = decompressor(sent.value)
        for data, before in zip(columns["data"], columns["before"], strict=True):
            index, width, digest, first, ends = open_file(data)
            if hashlib.sha256(sent.value).digest() != digest:
                raise ValueError("the file was written with another dictionary")
            place = before
            for entry, end in zip(index, ends.tolist(), strict=True):
                raw = reader.decompress(data[first + int(entry["offset"]) : first + end])
                ids = np.frombuffer(raw, dtype=f"<u{width}").astype("<u4")
                got["doc_id"].append(None if entry["doc_id"] == NO_ID else int(entry["doc_id"]))
                got["start"].append(place)
                got["n_tokens"].append(len(ids))
                got["ids_crc32"].append(zlib.crc32(ids.tobytes()))
                place += len(ids)
        return got

    placed = files.join(places, "part").select("data", (F.col("before") + F.col("offset")).alias("before"))
    return placed.mapInArrow(shared.per_batch(read, out), out)


def round_trip(docs, **options):
    folder = shared_folder(docs.sparkSession, "token-store")
    write_store(docs, folder, **options)
    return read_store(docs.sparkSession, folder)
