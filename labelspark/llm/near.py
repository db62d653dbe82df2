"""Near-duplicate groups: MinHash candidates, sequential Bayesian pruning, full sets for the last word.

1. Each text gives its set of distinct word shingles (64-bit hashes), a fingerprint of the set and a signature of `BANDS * ROWS` minima.
   Equal sets collapse to one class, whatever their number.
2. Classes that share a band of their signature meet in a bucket. Every member is paired with the bucket's hubs, one or a few members, so a bucket
   of any size gives linear many pairs.
3. A pair's signatures are compared batch by batch. After each batch the posterior chance that the similarity reaches the threshold, from a
   uniform prior, is bounded; below `MISS` the pair is dropped. Survivors are checked on their full sets, read again from the texts.
4. Links give components. Buckets whose members are still in several components get other hubs, from their largest component, for a few rounds.
   What is then still divided owes every pair between its components. These are compared in blocks of members against blocks, by signature and then
   on full sets, and only links that join two components come out. Pairs inside one component could change nothing and are left out.

A link joins two sets with similarity >= threshold, so 20 bands of 5 rows miss a pair at 0.85 with a chance below 1e-5.

Null and empty texts have an empty set and are alone. Texts shorter than a shingle are one shingle. Rows with a null id are alone, with a null component.
Rows with equal ids are in the components of all their texts. An empty table gives no row. Columns besides id and text are not read.
"""

import functools
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from labelspark.llm import shared

SHINGLE, BANDS, ROWS = 5, 20, 5
SIZE = BANDS * ROWS
BATCH, MISS = 20, 1e-6
#: Buckets beyond so many members get more hubs; members and shingles per block; pairs per chunk of one hub.
SMALL_BUCKET, BLOCK, BLOCK_SHINGLES, CHUNK = 24, 2048, 400_000, 128
#: Seeds of the hubs of a bucket, per round, before all pairs between components are compared.
HUBS = ((1, 2, 3), (4, 5, 6, 7))
#: Ids of so many rows, 8 bytes each, may be sent to all executors to pick their texts; beyond it they are joined by a shuffle.
SENT_IDS = 1 << 20

_ODD = np.random.default_rng(20).integers(1 << 32, 1 << 63, SIZE + SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = np.random.default_rng(21).integers(1 << 32, 1 << 63, SIZE, dtype=np.uint64)


def mixed(h):
    """Spreads every bit of 64-bit numbers over all others."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_set(text, size=SHINGLE):
    """Sorted distinct shingle hashes of a text; words are runs without ASCII white space, A-Z in lower case."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=n)
    take = min(n, size)
    total = np.zeros(n - take + 1, dtype=np.uint64)
    for k in range(take):
        total += hashes[k : n - take + 1 + k] * _ODD[SIZE + k]
    return np.unique(mixed(total + np.uint64(take)))


def signature(found):
    """Minima of `SIZE` permutations of the hashes, 32 leading bits of each."""
    low = np.full(SIZE, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(found), 2048):
        part = found[k : k + 2048]
        np.minimum(low, ((part[None, :] ^ _XOR[:, None]) * _ODD[:SIZE, None]).min(axis=1), out=low)
    return (low >> np.uint64(32)).astype("<u4")


def sketch(docs, id_col, text_col, size=SHINGLE):
    """(doc_id, n_shingles, node, check, sig): node and check are two fingerprints of the set."""
    shared.ship(docs.sparkSession)
    schema = "doc_id long, n_shingles long, node long, check long, sig binary"

    def run(columns):
        out = {name: [] for name in ("doc_id", "n_shingles", "node", "check", "sig")}
        for doc, text in zip(columns["doc_id"], columns["text"], strict=True):
            found = shingle_set(text, size)
            marks = [int(x.sum(dtype=np.uint64).view(np.int64)) for x in (mixed(found), mixed(found ^ _XOR[0]))]
            for name, value in zip(out, (doc, len(found), *marks, signature(found).tobytes()), strict=True):
                out[name].append(value)
        return out

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), shared.text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(shared.per_batch(run, schema), schema)


@functools.lru_cache(maxsize=8)
def least_matches(threshold, batch=BATCH, size=SIZE, miss=MISS):
    """[(n, m)]: with fewer than m equal among the first n, similarity >= threshold has a posterior chance below `miss`."""
    out = []
    for n in range(batch, size + 1, batch):
        chance, m = 0.0, 0
        while m <= n:
            chance += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)  # P(S >= threshold | m of n)
            if chance >= miss:
                break
            m += 1
        out.append((n, m))
    return tuple(out)


def survivors(left, right, threshold):
    """Which rows of two signature matrices stay after all batches; a dropped row is not compared further."""
    alive, before = np.arange(len(left)), 0
    equal = np.zeros(len(left), dtype=np.int64)
    for n, least in least_matches(threshold):
        equal[alive] += (left[alive, before:n] == right[alive, before:n]).sum(axis=1)
        alive, before = alive[equal[alive] >= least], n
    return alive


def signatures(column):
    return np.frombuffer(b"".join(column), dtype="<u4").reshape(-1, SIZE)


def prune(pairs, classes, threshold):
    """(a, b) of the pairs whose signatures leave a link possible."""
    sig = classes.select("node", "sig")
    both = pairs.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a")
    both = both.join(sig.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b").select("a", "b", "sig_a", "sig_b")
    fields = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                keep = survivors(signatures(batch.column(2).to_pylist()), signatures(batch.column(3).to_pylist()), threshold)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep))], schema=fields)

    return both.mapInArrow(run, "a long, b long")


def verify(pairs, classes, docs, percent, size=SHINGLE):
    """(a, b) of the pairs with 100 * intersection >= percent * union, on full sets, and how many. `docs`: (doc_id, text)."""
    pairs = shared.stored(pairs, "near-pairs")
    chunk = pairs.select("a", F.pmod(F.xxhash64("b"), F.lit(1 << 20)).alias("h"), "b")
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    dealt = chunk.join(counts, "a").select("a", "b", F.pmod("h", F.col("chunks")).alias("chunk"))
    needed = dealt.select("a", "chunk", F.col("b").alias("node"), F.lit(1).alias("member"))
    needed = needed.unionByName(dealt.select("a", "chunk", F.col("a").alias("node"), F.lit(0).alias("member")).distinct())
    needed, facts = shared.noted(needed.join(classes.select("node", "doc_id", "n_shingles", "check"), "node"), "near-needed", n=F.count("*"))
    ids = needed.select("doc_id").distinct()
    picked = docs.join(F.broadcast(ids) if facts["n"] <= SENT_IDS else ids, "doc_id", "left_semi")
    rows = needed.join(picked, "doc_id").select("a", "chunk", "member", "node", "check", "n_shingles", "text")
    rows = rows.repartition("a", "chunk").sortWithinPartitions("a", "chunk", "member", "node")
    fields = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        key, hub = None, None
        for batch in batches:
            found = []
            for a, chunk_no, member, node, n, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 3, 5, 6)), strict=True):
                values = shingle_set(text, size)
                if len(values) != n or int(mixed(values).sum(dtype=np.uint64).view(np.int64)) != node:
                    continue  # another text under the same id
                if member == 0:
                    key, hub = (a, chunk_no), values
                elif key == (a, chunk_no):
                    shared_n = len(np.intersect1d(hub, values, assume_unique=True))
                    if 100 * shared_n >= percent * (len(hub) + len(values) - shared_n):
                        found.append((a, node))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], schema=fields)

    links, facts = shared.noted(rows.mapInArrow(run, "a long, b long").distinct(), "near-links", n=F.count("*"))
    return links, facts["n"]


def written_edges(edges):
    """Different edges, written, with the number and fingerprint of their set."""
    h = F.xxhash64("u", "v")
    rows, mark = shared.noted(edges.where("u <> v").distinct(), "edges", n=F.count("*"), x=F.bit_xor(h), s=F.sum(F.shiftright(h, 24)))
    return rows, mark


def components(links):
    """(node, root): the smallest node that can be reached, for nodes with a link; alternating steps to larger and to smaller neighbours."""
    edges, mark = written_edges(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    before = None
    while mark != before:
        ways = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        # Larger neighbours are hung on the smallest one, then smaller ones likewise.
        large = ways.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v")
        small_low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(small_low, "u").select(F.explode(F.array(F.struct("u", F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("e"))
        before = mark
        edges, mark = written_edges(small.select("e.u", "e.v"))
    return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def bucket_rows(classes):
    """(bucket, node): one row per class and band, buckets with at least two classes."""
    schema = "bucket long, node long"

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                sig = signatures(batch.column(1).to_pylist()).astype(np.uint64).reshape(batch.num_rows, BANDS, ROWS)
                value = mixed((sig * _ODD[:ROWS]).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _XOR[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value.reshape(-1).view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], names=["bucket", "node"]
                )

    rows = classes.select("node", "sig").mapInArrow(run, schema)
    members = shared.stored(rows, "bands")
    hubs = members.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1")
    return shared.stored(members.join(hubs, "bucket"), "buckets")


def divided(buckets, roots):
    """(bucket, hub, node, root, n, hub_root) of buckets whose members are in several components, and how many; hub_root: the component most are in."""
    rooted = buckets.join(roots, "node", "left").select("bucket", "hub", "node", F.coalesce("root", "node").alias("root"))
    sides = rooted.groupBy("bucket", "root").agg(F.count("*").alias("k"))
    top = sides.groupBy("bucket").agg(F.sum("k").alias("n"), F.count("*").alias("roots"), F.max(F.struct("k", "root")).alias("top"))
    several = top.where("roots > 1").select("bucket", "n", F.col("top.root").alias("hub_root"))
    rows, facts = shared.noted(rooted.join(several, "bucket"), "divided", n=F.count("*"))
    return rows, facts["n"]


def hubs_of(members, seeds):
    """(bucket, with_): of each bucket the members that hash lowest under each seed. A node's hash is the same in all of its buckets, so these agree on few hubs."""
    chosen = [F.min_by("node", F.xxhash64("node", F.lit(seed))) for seed in seeds]
    return members.groupBy("bucket").agg(F.array_distinct(F.array(*chosen)).alias("hubs")).select("bucket", F.explode("hubs").alias("with_"))


def pairs_with(members, hubs):
    pairs = members.join(hubs, "bucket").where("node <> with_")
    return pairs.select(F.least("with_", "node").alias("a"), F.greatest("with_", "node").alias("b")).distinct()


def in_blocks(rows, weight, limit):
    """Rows dealt to (bucket, i, j): blocks of members against blocks, of about `limit` summed weight each.

    Members outside the hub's component (side 1) meet everyone, those inside it (side 0) meet side 1 only.
    """
    sided = rows.withColumn("side", (F.col("root") != F.col("hub_root")).cast("int"))
    held = lambda side: F.ceil(F.sum(F.when(F.col("side") == side, weight).otherwise(0)) / limit).cast("int")
    counts = sided.groupBy("bucket").agg(held(1).alias("outer"), held(0).alias("inner"))
    dealt = sided.join(counts, "bucket").withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("side") == 1, F.col("outer")).otherwise(F.col("inner"))).cast("int"))
    # Blocks of side 1 are numbered from 0, those of side 0 behind them.
    dealt = dealt.withColumn("block", F.when(F.col("side") == 1, F.col("own")).otherwise(F.col("own") + F.col("outer")))
    reach = F.when(F.col("side") == 1, F.col("outer") + F.col("inner")).otherwise(F.col("outer"))
    sent = dealt.where(reach > 0).withColumn("other", F.explode(F.sequence(F.lit(0), reach - 1)))
    sent = sent.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    return sent.drop("side", "outer", "inner", "own", "other")


def by_block(work, fields):
    """`mapInArrow` argument: `work(columns of one (bucket, i, j))` for rows sorted by these, however batches cut them."""

    def run(batches):
        key, held = None, []

        def done():
            table = pa.Table.from_batches(held).combine_chunks()
            found = work({name: table.column(name) for name in table.schema.names})
            if len(found[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(found, fields, strict=True)], schema=fields)

        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1) if batch.num_rows else np.empty((0, 3))
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if key is not None and tuple(keys[a]) != key:
                    yield from done()
                    held = []
                key = tuple(keys[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from done()

    return run


def sides(columns):
    """(rows of block i, rows of block j, node, root, whether both are one block)"""
    block, i, j = (columns[name].to_numpy() for name in ("block", "i", "j"))
    return np.flatnonzero(block == i), np.flatnonzero(block == j), columns["node"].to_numpy(), columns["root"].to_numpy(), i[0] == j[0]


def possible(columns, threshold):
    """Nodes of one pair of blocks with a possible link to another component, by their signatures."""
    rows, others, node, root, same = sides(columns)
    sig, hit = signatures(columns["sig"].to_pylist()), np.zeros(len(node), dtype=bool)
    for k in rows:
        with_ = others[(root[others] != root[k]) & ((others > k) | (not same))]
        if len(with_):
            keep = with_[survivors(np.broadcast_to(sig[k], (len(with_), SIZE)), sig[with_], threshold)]
            hit[keep] = True
            hit[k] |= len(keep) > 0
    return [columns["bucket"].to_numpy()[hit], node[hit]]


def found_links(columns, percent, size):
    """Links between components of one pair of blocks, on full sets; one link joins two components, further ones between them are not needed."""
    rows, others, node, root, same = sides(columns)
    sets = [shingle_set(text, size) for text in columns["text"].to_pylist()]
    real = np.array([len(x) and int(mixed(x).sum(dtype=np.uint64).view(np.int64)) == k for x, k in zip(sets, node.tolist(), strict=True)])
    sizes = np.array([len(x) for x in sets])
    _, ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    holder = np.repeat(np.arange(len(sets)), sizes)[np.argsort(ids, kind="stable")]
    first, ends = np.cumsum(counts) - counts, np.cumsum(sizes)
    component, a, b = np.unique(root, return_inverse=True)[1], [], []
    for k in rows[real[rows]]:
        with_ = others[(component[others] != component[k]) & real[others] & ((others > k) | (not same))]
        if not len(with_):
            continue
        own = ids[ends[k] - sizes[k] : ends[k]]
        n = counts[own]
        places = np.arange(int(n.sum())) + np.repeat(first[own] - np.cumsum(n) + n, n)
        both = np.bincount(holder[places], minlength=len(sets))[with_]
        for m in with_[100 * both >= percent * (sizes[k] + sizes[with_] - both)]:
            if component[m] != component[k]:
                a.append(min(node[k], node[m]))
                b.append(max(node[k], node[m]))
                component[component == component[m]] = component[k]
    return [a, b]


def owed_links(rows, classes, docs, percent, size=SHINGLE):
    """(a, b): links between components of divided buckets, so that none stays apart that has one, and how many. Every pair between components is compared."""
    threshold = percent / 100
    marked = in_blocks(rows.join(classes.select("node", "sig"), "node"), F.lit(1), BLOCK)
    marked = marked.select("bucket", "i", "j", "block", "node", "root", "sig").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    fields = pa.schema([("bucket", pa.int64()), ("node", pa.int64())])
    hits = marked.mapInArrow(by_block(lambda columns: possible(columns, threshold), fields), "bucket long, node long").distinct()
    left, facts = shared.noted(rows.join(hits, ["bucket", "node"], "left_semi").join(classes.select("node", "doc_id", "n_shingles"), "node"), "owed", n=F.count("*"))
    ids = left.select("doc_id").distinct()
    texts = docs.join(F.broadcast(ids) if facts["n"] <= SENT_IDS else ids, "doc_id", "left_semi")
    full = in_blocks(left, F.col("n_shingles"), BLOCK_SHINGLES).join(texts, "doc_id")
    full = full.select("bucket", "i", "j", "block", "node", "root", "text").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    fields = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    links, facts = shared.noted(full.mapInArrow(by_block(lambda columns: found_links(columns, percent, size), fields), "a long, b long").distinct(), "near-links", n=F.count("*"))
    return links, facts["n"]


def merged(roots, links):
    """Roots after further links."""
    between = links.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(
        roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left"
    )
    joined = components(between.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    step = joined.select(F.col("node").alias("root"), F.col("root").alias("top"))
    loose = joined.select("node", "root").join(roots, "node", "left_anti")
    raised = roots.join(step, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return shared.stored(raised.unionByName(loose), "roots")


def near_duplicates(docs, percent=85, id_col="doc_id", text_col="text", size=SHINGLE):
    """(doc_id, n_shingles, component_id, kept) of every row."""
    threshold = percent / 100
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), shared.text_or_empty(text_col).alias("text"))
    rows = shared.stored(sketch(docs, id_col, text_col, size), "sketches")
    linked = rows.where("n_shingles > 0 and doc_id is not null")
    classes = linked.groupBy("node", "check", "n_shingles").agg(F.min("doc_id").alias("doc_id"), F.min_by("sig", "doc_id").alias("sig"))
    classes = shared.stored(classes, "classes")
    buckets = bucket_rows(classes)
    star = buckets.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    large = buckets.where(F.col("n") > SMALL_BUCKET)
    star = star.unionByName(pairs_with(large, hubs_of(large, HUBS[0]))).distinct()
    links, _ = verify(prune(star, classes, threshold), classes, texts, percent, size)
    roots = shared.stored(components(links), "roots")
    # Other hubs join most of what is left with few pairs; the last round owes every pair between components.
    for seeds in (*HUBS[1:], None):
        left, n_left = divided(buckets, roots)
        if not n_left:
            break
        if seeds is None:
            more, n_more = owed_links(left, classes, texts, percent, size)
        else:
            pairs = pairs_with(left.where("root <> hub_root"), hubs_of(left.where("root = hub_root"), seeds))
            more, n_more = verify(prune(pairs, classes, threshold), classes, texts, percent, size)
        if n_more:
            roots = merged(roots, more)
    # The root is a set's fingerprint; a component is named by its smallest document.
    first = classes.join(roots, "node", "left").select("node", "check", "n_shingles", F.coalesce("root", "node").alias("root"), "doc_id")
    named = first.groupBy("root").agg(F.min("doc_id").alias("component"))
    of_class = first.drop("doc_id").join(named, "root").select("node", "check", "n_shingles", "component")
    out = rows.select("doc_id", "n_shingles", "node", "check").join(of_class, ["node", "check", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(component, F.col("doc_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near(docs, percent=85, id_col="doc_id", text_col="text"):
    """The rows of `docs` that stay, one document of each group, all columns."""
    found = near_duplicates(docs, percent, id_col, text_col)
    dropped = shared.stored(found.where(~F.col("kept")).select(F.col("doc_id").alias("_dropped")), "near-dropped").distinct()
    return docs.join(dropped, docs[id_col] == dropped["_dropped"], "left_anti")
