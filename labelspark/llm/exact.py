"""Exact dedup through an extendible-hash index kept in shared files. DataFrame functions only.

1. Texts are hashed to 64-bit keys. The keys with their row counts go to files; no text moves for that. A directory over the leading
   key bits doubles until no bucket holds more than `capacity` keys; cells below a bucket that need not be split share it (its local
   depth is smaller). The directory goes to files as well.
2. Every row goes, with its text, to the page of the directory its key's leading bits name, which holds whole buckets, and looks its
   bucket up there. Texts move this once, whether the directory is small enough to be sent or is joined. Only keys of very many rows (`MANY`, and more
   than one row in 65,536, so there are fewer than 65,536 such keys) are folded first, in `SHARES` shares, each on the way out of its
   scan: a group of copies of any size reaches its bucket as a few rows. A fold settles nothing, as its shares meet in the bucket only.
3. Pages and buckets are ranges of keys; each lies whole in one owner task, which compares the bytes of the texts with one key: equal ones become
   one entry with the kept id and the size, different ones stay apart and are numbered as that key's chain. The entries (with the
   text's digest, without the text) are the index, sorted by bucket and key.
4. Every row finds its bucket by the directory and there, by key and inside the chain by digest, its entry. Buckets with hot keys are
   split by adaptive execution.

A null text is the empty text. Null ids lose against any other id; a group of null ids only keeps them all. Rows alike in id and text
each count, and all of them are the kept row: an id names one document. An empty table gives an empty index. Columns with names
used here do not clash: only the id and the text are read.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from labelspark.llm import shared

CAPACITY = 512
#: A bucket spans at most 2**LEVELS cells; the cells below one such prefix are a page of the directory.
LEVELS = 2
#: Keys of more rows than this are folded before they move, in so many shares.
MANY, SHARES = 1024, 16


def keyed(docs, id_col, text_col, normalise):
    text = shared.text_or_empty(text_col)
    text = normalise(text) if normalise else text
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("key", F.xxhash64("text"))


def cell(depth, key="key"):
    """Leading `depth` bits of the key. Without any it is 0, by shifts: a literal would leave joins on it without a key, as cross joins."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.shiftrightunsigned(F.shiftrightunsigned(key, 63), 1)


def directory(keys, capacity=CAPACITY):
    """The directory of 2**depth cells, a row per page: (page, cells), `cells` leads from a cell to its bucket and local depth.

    And the depth. `keys`: a row per key.
    """
    total, depth = keys.count(), 0
    while total > capacity << depth:
        depth += 1
    while depth < 40:
        fullest = keys.groupBy(cell(depth).alias("cell")).count().agg(F.max("count")).first()[0] or 0
        if fullest <= capacity:
            break
        depth += 1  # the directory doubles: every cell becomes two
    cells = keys.groupBy(cell(depth).alias("cell")).agg(F.count("*").alias("n"))
    # A cell's bucket is the widest prefix that is not overfull; siblings are looked at as far up as that can be.
    found = cells.select("cell", F.col("cell").alias("bucket"), F.lit(depth).alias("local_depth"), "n")
    for up in range(1, min(depth, LEVELS) + 1):
        parent = Window.partitionBy(F.shiftrightunsigned("cell", up))
        held = F.sum("n").over(parent)
        fits = held <= capacity
        found = found.withColumn("fits", fits).select(
            "cell",
            F.when(F.col("fits"), F.shiftleft(F.shiftrightunsigned("cell", up), up)).otherwise(F.col("bucket")).alias("bucket"),
            F.when(F.col("fits"), F.lit(depth - up)).otherwise(F.col("local_depth")).alias("local_depth"),
            "n",
        )
    entry = F.struct("cell", F.struct("bucket", "local_depth"))
    pages = found.groupBy(page(depth, "cell").alias("page")).agg(F.map_from_entries(F.collect_list(entry)).alias("cells"))
    return shared.stored(pages, "directory"), depth


def page(depth, of="cell"):
    return F.shiftrightunsigned(of, min(depth, LEVELS))


def in_buckets(rows, pages, depth):
    """Rows that have a page, with bucket and local depth of their keys, looked up in the directory."""
    place = F.element_at("cells", cell(depth))
    return rows.join(pages, "page").withColumns({"bucket": place["bucket"], "local_depth": place["local_depth"]}).drop("cells")


def folded(rows, keys, many=MANY):
    """(key, text, keep_id, group_size): rows as they are, those of keys with very many rows summed up per share."""
    total = keys.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(keys.where(F.col("n") > max(many, total >> 16)).select("key"))
    share = F.pmod(F.xxhash64("doc_id"), F.lit(SHARES))
    summed = rows.join(hot, "key", "left_semi").groupBy(share.alias("share"), "key", "text")
    summed = summed.agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).drop("share")
    single = rows.join(hot, "key", "left_anti").select("key", "text", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    return single.unionByName(summed)


def settled(rows, pages, depth):
    """One entry per text of a bucket, made in the bucket's owner task: texts of one key are compared by their bytes."""
    owned = in_buckets(rows.withColumn("page", page(depth, cell(depth))).repartition("page"), pages, depth)
    owned = owned.groupBy("page", "bucket", "local_depth", "key", "text")
    owned = owned.agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    owned = owned.withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256)).drop("text")
    chain = Window.partitionBy("page", "bucket", "key").orderBy("text_sha256")
    return owned.withColumn("chain", F.row_number().over(chain))


def index_and_directory(docs, id_col="doc_id", text_col="text", capacity=CAPACITY, normalise=None, many=MANY):
    """The index of `build_index`, the directory's pages, and its depth."""
    rows = keyed(docs, id_col, text_col, normalise)
    keys = shared.stored(rows.groupBy("key").agg(F.count("*").alias("n")), "keys")
    pages, depth = directory(keys, capacity)
    entries = settled(folded(rows, keys, many), pages, depth)
    columns = ["bucket", "local_depth", "key", "chain", "text_sha256", "keep_id", "group_size"]
    return shared.stored(entries.select(columns).sortWithinPartitions("bucket", "key", "chain"), "index"), pages, depth


def build_index(docs, id_col="doc_id", text_col="text", capacity=CAPACITY, normalise=None, many=MANY):
    """(bucket, local_depth, key, chain, text_sha256, keep_id, group_size), one row per distinct text, from shared files."""
    return index_and_directory(docs, id_col, text_col, capacity, normalise, many)[0]


def probe(docs, index, pages, depth, id_col="doc_id", text_col="text", normalise=None):
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row."""
    rows = keyed(docs, id_col, text_col, normalise).select(
        "doc_id", "key", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")
    )
    rows = in_buckets(rows.withColumn("page", page(depth, cell(depth))), pages, depth).drop("page", "local_depth")
    return rows.join(index.drop("local_depth", "chain"), ["bucket", "key", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def exact_duplicates(docs, id_col="doc_id", text_col="text", capacity=CAPACITY, normalise=None, many=MANY):
    found = index_and_directory(docs, id_col, text_col, capacity, normalise, many)
    return probe(docs, *found, id_col, text_col, normalise)


def drop_exact(docs, id_col="doc_id", text_col="text", capacity=CAPACITY):
    """The rows of `docs` that stay, all columns. Only the ids to drop are joined, so texts move only if those are many."""
    found = exact_duplicates(docs, id_col, text_col, capacity)
    dropped = shared.stored(found.where(~F.col("kept")).select(F.col("doc_id").alias("_dropped")), "dropped").distinct()
    return docs.join(dropped, docs[id_col].eqNullSafe(dropped["_dropped"]), "left_anti")
