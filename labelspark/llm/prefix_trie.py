"""Conversation prefix trie by whole-sequence collapse.

A turn is a 128-bit digest of its role and text, so texts are never shuffled. Conversations are read in order, streaming, and every prefix
gets the digest of the one before it and its last turn. Identical conversations collapse into one sequence with a weight, the
smallest id as representative and the list of all ids, in blocks of neighbouring ids. Sequences that are proper prefixes of another are found
by an anti-join against the inner prefixes; the others end in leaves. Nodes are the prefixes of all sequences, folded with their
weights before the shuffle; what a subtree saves is summed along the leaves' paths, each node's share carried by one leaf.

Turns with equal numbers come in the order of their digests; null numbers come first. Null roles and texts are empty. Repeated rows are
turns of their own. Rows without a conversation id belong to none. Without conversations there is no node, not even the root. A
conversation's turns and a node's id blocks are streamed through one task in constant memory. Columns besides the four are not read.
"""

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelspark.llm import shared

ROOT = bytes(16)
#: Ids per block of an end list, as a power of two.
BLOCK_BITS = 12
#: Rows given back at a time.
ROWS = 1 << 14


def turn_digests(turns, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text"):
    """(conv_id, turn, digest, words) of every turn of a known conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    content = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.unhex(F.substring(F.sha2(content, 256), 1, 32)).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )


def prefixes(turns, family=1, heads=1):
    """(conv_id, depth, parent, key, words, last): every prefix of every rebuilt conversation, from `turn_digests`.

    Conversation c is rebuilt from the first h turns of c - c % family and its own turns after its first h, where h is the crc32 of the
    decimal c modulo `heads`; one for both leaves conversations as they are. One without turns has one row, the root.
    """
    fields = pa.schema(
        [("conv_id", pa.int64()), ("depth", pa.int32()), ("parent", pa.binary()), ("key", pa.binary()), ("words", pa.int64()), ("last", pa.bool_())]
    )

    def run(batches):
        out = []
        base = conv = row = None
        head, skip, own = [], 0, 0

        def step(digest, words):
            nonlocal row
            before, depth = row[3], row[1]
            if depth:
                out.append((*row, False))
            row = (conv, depth + 1, before, hashlib.blake2b(before + digest, digest_size=16).digest(), words)

        def given():
            columns = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, fields, strict=True)], schema=fields)

        for batch in batches:
            for b, c, digest, words in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                if c != conv or row is None:
                    if row is not None:
                        out.append((*row, True))
                    if b != base:
                        base, head = b, []
                    conv, row, own = c, (c, 0, None, ROOT, 0), 0
                    skip = 0 if c == b else zlib.crc32(str(c).encode()) % heads
                    for turn in head[:skip]:
                        step(*turn)
                own += 1
                if c == b and own < heads:
                    head.append((digest, words))
                if own > skip:
                    step(digest, words)
                if len(out) >= ROWS:
                    yield given()
                    out.clear()
        if row is not None:
            out.append((*row, True))
            yield given()

    base = F.col("conv_id") - F.col("conv_id") % F.lit(family)
    rows = turns.withColumn("base", base).repartition("base")
    rows = rows.sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", F.asc_nulls_first("turn"), "digest")
    return rows.select("base", "conv_id", "digest", "words").mapInArrow(run, "conv_id long, depth int, parent binary, key binary, words long, last boolean")


def end_digests(ends):
    """(key, ends_sha256): hash of the ascending ids of the conversations that end in a node, from its blocks of ids one by one."""
    block = F.shiftright("conv_id", BLOCK_BITS)
    blocks = ends.groupBy("key", block.alias("block")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    blocks = blocks.select("key", "block", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("text"))
    ordered = blocks.repartition("key").sortWithinPartitions("key", "block").select("key", "text")
    fields = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])

    def run(batches):
        key = state = None
        for batch in batches:
            keys, digests = [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name == key:
                    state.update(b",")
                else:
                    if key is not None:
                        keys.append(key)
                        digests.append(state.hexdigest())
                    key, state = name, hashlib.sha256()
                state.update(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], schema=fields)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], schema=fields)

    return ordered.mapInArrow(run, "key binary, ends_sha256 string")


def collapse(paths):
    """(key, depth, conv_id, weight, leaf): the distinct whole conversations, their smallest id, how many they are, and whether none goes on."""
    ends = paths.where("last").groupBy("key", "depth").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight"))
    inner = paths.where("parent is not null").select(F.col("parent").alias("key")).distinct().withColumn("inner", F.lit(True))
    return ends.join(inner, "key", "left").select("key", "depth", "conv_id", "weight", F.col("inner").isNull().alias("leaf"))


def trie(paths):
    """One row per node: key, parent, and the columns of `nodes`, from the written table of `prefixes`."""
    root = F.lit(bytearray(ROOT))
    whole = shared.stored(collapse(paths), "trie-sequences")
    kept = paths.where("depth > 0").join(whole.select("conv_id", "weight", "leaf"), "conv_id")
    kept = kept.select("conv_id", "depth", "parent", "key", "words", "weight", "leaf")
    top = whole.select("conv_id", F.lit(0).alias("depth"), F.lit(None).cast("binary").alias("parent"), root.alias("key"), F.lit(0).cast("long").alias("words"), "weight", "leaf")
    steps = shared.stored(kept.unionByName(top), "trie-steps")
    found = steps.groupBy("key", "parent", "depth", "words").agg(
        F.sum("weight").alias("n_convs"),
        F.min("conv_id").alias("conv_id"),
        F.sum(F.col("leaf").cast("long")).alias("n_leaves"),
        F.min(F.when(F.col("leaf"), F.col("conv_id"))).alias("carrier"),
    )
    found = shared.stored(found, "trie-nodes")
    # every node's saving is carried by the path of one leaf below it, so no node counts twice
    own = found.select(F.col("carrier").alias("conv_id"), "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    along = steps.where("leaf").select("conv_id", "depth", "key").join(own, ["conv_id", "depth"], "left")
    below = F.sum(F.coalesce("saved", F.lit(0))).over(W.partitionBy("conv_id").orderBy(F.desc("depth")))
    saved = along.select("key", below.alias("below")).groupBy("key").agg(F.sum("below").alias("saved_tokens"))
    children = found.where("depth > 0").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = found.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    ends = end_digests(paths.where("last").select("key", "conv_id"))
    rows = found.join(saved, "key", "left").join(children, "key", "left").join(ends, "key", "left").join(parents, "parent", "left")
    return rows.select(
        "key",
        "parent",
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        "n_leaves",
        F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def build(conversations, family=20, heads=4, **columns):
    """The trie of all rebuilt conversations: one row per distinct prefix."""
    shared.ship(conversations.sparkSession)
    return trie(shared.stored(prefixes(turn_digests(conversations, **columns), family, heads), "trie-prefixes"))
