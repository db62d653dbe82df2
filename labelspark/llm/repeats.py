"""Removal of long repeats: every byte under a string of `least` bytes that also starts somewhere else.

Finding the common prefixes is the work of a Burrows-Wheeler transform. Its intervals are extended backward breadth first, so common prefixes come
out by increasing length; an interval is followed only where it settles a border that no shorter one settled, and the walk stops at the minimum
length. Borders not settled by then part suffixes with at least `least` bytes in common.

One transform over a corpus is one task's work, so text is dealt to many transforms first, without losing a match:

1. Winnowing. Of every `least`-byte window, the smallest hash of its `GRAM`-byte strings marks an anchor. Equal windows have equal anchors. An
   anchor's surroundings hold every window that it was chosen for.
2. Anchors whose string occurs once are dropped. Equal surroundings collapse to one string with a weight, however many copies there are.
3. The surroundings of one anchor string meet in one task, which transforms them in batches of bounded size. In strings of weight two and more
   every window is a repeat, in others those whose border with a neighbour was not settled. Surroundings that are alone with their
   anchor string have nothing to be compared with.
4. An anchor string with more than `HOT` different surroundings would be one task's burden that grows with the corpus. Its windows, not its
   surroundings, are dealt by their hash and counted, which gives the same answer at any size.
5. Covered ranges go back to every place the surroundings came from, and their union is cut out of each text.

Strings, surroundings and windows are told apart by 64-bit hashes. Null and empty texts have no byte. Rows alike in id and text are copies of each
other. Null ids are ids like any other. An empty table gives no row. Columns besides id and text are not read.
"""

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from labelspark.llm import shared

LEAST, GRAM = 400, 300
#: More different surroundings of one anchor string than this are dealt window by window.
HOT = 1024
#: Bytes of surroundings that one transform takes; an anchor string has at most HOT * 2 * LEAST of them.
BATCH_BYTES = 1 << 20
#: Keys of so many documents, 8 bytes each, may be sent to all executors; beyond it they are joined by a shuffle.
SENT_KEYS = 1 << 20

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BYTES = np.random.default_rng(400).integers(1 << 32, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TOP = np.uint64((1 << 64) - 1)


def mixed(h):
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@functools.lru_cache(maxsize=2)
def _powers(n):
    out = []
    for base in (BASE, BASE_BACK):
        p = np.full(n, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out


def powers(n):
    up, down = _powers(1 << max(20, int(n).bit_length()))
    return up[:n], down[:n]


def sliding(values, width, pick):
    """pick over every `width` neighbours, by doubling."""
    span = 1
    while 2 * span <= width:
        values = pick(values[:-span], values[span:])
        span *= 2
    return pick(values[: len(values) - (width - span)], values[width - span :]) if width > span else values


def anchors(texts, least=LEAST, gram=GRAM):
    """(text number, start and size of the surroundings, string hash, surroundings hash) of all anchors, as arrays; `texts` are bytes."""
    sizes = np.array([len(x) for x in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    total, width = int(ends[-1]) if len(ends) else 0, least - gram + 1
    empty = np.empty(0, dtype=np.int64)
    if total < least:
        return empty, empty, empty, empty, empty
    up, down = powers(total + 1)
    prefix = np.zeros(total + 1, dtype=np.uint64)
    np.cumsum(BYTES[np.frombuffer(b"".join(texts), dtype=np.uint8)] * up[:total], out=prefix[1:])
    grams = mixed((prefix[gram:] - prefix[:-gram]) * down[: total - gram + 1])
    low = sliding(grams, width, np.minimum)  # of the window that starts here
    inside = np.zeros(total + 1, dtype=np.int8)
    long = sizes >= least
    np.add.at(inside, (ends - sizes)[long], 1)
    np.add.at(inside, (ends - least + 1)[long], -1)
    low = np.where(np.cumsum(inside[: len(low)]) > 0, low, np.uint64(0))  # windows across two texts are none
    pad = np.zeros(width - 1, dtype=np.uint64)
    highest = sliding(np.concatenate([pad, low, pad]), width, np.maximum)  # over the windows that hold the place
    places = np.flatnonzero((highest == grams) & (highest > 0))
    text, value = np.searchsorted(ends, places, side="right"), grams[places]
    first, last = (ends - sizes)[text], ends[text]
    a, b = np.maximum(first, places - (least - gram)), np.minimum(last, places + least)
    for k in range(1, min(len(places), least - gram + 1)):
        # A window belongs to its smallest string, of equal ones to the first: one place of a text is in one string of a group.
        near = (text[k:] == text[:-k]) & (places[k:] - places[:-k] <= least - gram)
        if not near.any():
            break
        a[k:] = np.where(near & (value[:-k] <= value[k:]), np.maximum(a[k:], places[:-k] + 1), a[k:])
        b[:-k] = np.where(near & (value[k:] < value[:-k]), np.minimum(b[:-k], places[k:] + gram - 1), b[:-k])
    around = mixed((prefix[b] - prefix[a]) * down[a] + (places - a).astype(np.uint64) * BASE + (b - places).astype(np.uint64))
    return text, a - first, b - a, value.view(np.int64), around.view(np.int64)


def suffix_order(data):
    """All suffixes of `data` in order, by doubling. `data` holds byte + 1, and 0 ends a string; ends differ, by place."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint16)]).astype(np.uint64)
    key, open_ = np.zeros(n, dtype=np.uint64), np.ones(n, dtype=bool)
    for k in range(7):  # seven symbols of nine bits
        here = padded[k : n + k]
        key = (key << np.uint64(9)) | np.where(open_, here, np.uint64(0))
        open_ &= here > 0
    order = np.argsort(key)
    fresh = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    # Suffixes that ended within the key go by place.
    slots = np.flatnonzero(~open_[order])
    places = order[slots]
    places = places[np.argsort((rank[places].astype(np.uint64) << np.uint64(32)) | places.astype(np.uint64))]
    order[slots], rank[places], fresh[slots] = places, slots, True
    done, triple = 7, n < 1 << 21
    while True:
        starts = np.flatnonzero(fresh)
        widths = np.diff(np.append(starts, n))
        wide = widths > 1
        if not wide.any():
            return order
        slots = np.flatnonzero(np.repeat(wide, widths))
        places = order[slots]
        # What follows the part compared: no end lies in that part, or the suffixes would differ.
        key = rank[places].astype(np.uint64)
        next_ = rank[np.minimum(places + done, n - 1)].astype(np.uint64)
        if triple:
            # Three ranks in 63 bits. Where the second part ended, the third one says nothing new: those suffixes differ before it.
            third = rank[np.minimum(places + 2 * done, n - 1)].astype(np.uint64)
            key = (key << np.uint64(42)) | (next_ << np.uint64(21)) | third
        else:
            key = (key << np.uint64(32)) | next_
        by = np.argsort(key)
        order[slots], key = places[by], key[by]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        fresh[slots] = new
        rank[order[slots]] = slots[new][np.cumsum(new) - 1]
        done *= 3 if triple else 2


def settled_borders(data, order, least):
    """For every slot of the suffix order but the first: whether the common prefix with the slot before is shorter than `least`."""
    n = len(data)
    settled = np.zeros(n + 1, dtype=bool)
    settled[0] = settled[n] = True
    before = data[order - 1]  # the transform; the symbol before the first place is the last one, an end
    slot = np.empty(n, dtype=np.int32)
    slot[order] = np.arange(n, dtype=np.int32)
    # Runs of the transform: equal symbols in a row have their extensions in a row too.
    fresh = np.concatenate([[True], (before[1:] != before[:-1]) | (before[1:] == 0)])
    run_of = (np.cumsum(fresh) - 1).astype(np.int32)
    run_start = np.append(np.flatnonzero(fresh), n)
    run_image, run_symbol = slot[order[run_start[:-1]] - 1].astype(np.int64), before[run_start[:-1]]
    ends = int(np.count_nonzero(data == 0))
    settled[: ends + 1] = True  # suffixes that are ends share nothing
    # Strings of one symbol: each end by itself, and every byte.
    counts = np.bincount(data, minlength=257)[1:]
    begin = ends + np.cumsum(counts) - counts
    settled[begin[counts > 0]] = True
    low = np.concatenate([np.arange(ends), begin[counts > 0]])
    wide = np.concatenate([np.ones(ends, dtype=np.int64), counts[counts > 0]])
    for _ in range(1, least):
        # Extend every interval by each byte before it, run by run.
        first, last = run_of[low], run_of[low + wide - 1]
        pieces = (last - first + 1).astype(np.int64)
        offsets = np.cumsum(pieces) - pieces
        owner = np.repeat(np.arange(len(low)), pieces)
        runs = np.arange(len(owner)) - np.repeat(offsets - first, pieces)
        live = run_symbol[runs] > 0
        owner, runs = owner[live], runs[live]
        if not len(runs):
            break
        a = np.maximum(run_start[runs], low[owner])
        b = np.minimum(run_start[runs + 1], low[owner] + wide[owner])
        image = run_image[runs] + a - run_start[runs]
        by = np.argsort(image)
        image, size, owner, symbol = image[by], (b - a)[by], owner[by], run_symbol[runs[by]]
        new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1])])
        starts = np.flatnonzero(new)
        low, wide = image[starts], np.add.reduceat(size, starts)
        right = low + wide
        keep = ~settled[right]
        settled[right] = True
        low, wide = low[keep], wide[keep]
        if not len(low):
            break
    return settled


def repeated_ranges(strings, weights, least=LEAST):
    """Per string, the ranges (from, to) covered by `least`-byte windows that occur twice, weights counted."""
    n = sum(len(x) + 1 for x in strings)
    data = np.zeros(n, dtype=np.uint16)
    sizes = np.array([len(x) for x in strings], dtype=np.int64)
    stops = np.cumsum(sizes + 1) - 1
    data[np.setdiff1d(np.arange(n), stops, assume_unique=True)] = np.frombuffer(b"".join(strings), dtype=np.uint8).astype(np.uint16) + 1
    order = suffix_order(data)
    settled = settled_borders(data, order, least)
    repeat = np.zeros(n, dtype=bool)
    repeat[order] = ~settled[:-1] | ~settled[1:]
    starts = stops - sizes
    for k in np.flatnonzero((np.asarray(weights) > 1) & (sizes >= least)):
        repeat[starts[k] : stops[k] - least + 1] = True
    edge = np.diff(np.concatenate([[0], repeat.view(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    owner = np.searchsorted(stops, first, side="right")
    out = [[] for _ in strings]
    for k, a, b in zip(owner.tolist(), (first - starts[owner]).tolist(), (last - starts[owner]).tolist(), strict=True):
        out[k].append((a, b + least - 1))
    return out


def encoded(texts):
    return [x.encode("utf-8", "surrogatepass") for x in texts]


def anchor_rows(docs, least=LEAST, gram=GRAM):
    """(key, anchor, around, size, starts): one row per document and different surroundings, `starts` where they begin."""
    shared.ship(docs.sparkSession)
    fields = pa.schema([("key", pa.int64()), ("anchor", pa.int64()), ("around", pa.int64()), ("size", pa.int32()), ("starts", pa.list_(pa.int32()))])

    def run(batches):
        for batch in shared.parts(batches):
            keys, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for low, high in shared.slices(texts, 1 << 19):
                text, start, size, anchor, around = anchors(encoded(texts[low:high]), least, gram)
                if not len(text):
                    continue
                by = np.lexsort((around, text))
                text, start, size, anchor, around = (x[by] for x in (text, start, size, anchor, around))
                new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (around[1:] != around[:-1])]))
                starts = pa.ListArray.from_arrays(pa.array(np.append(new, len(text)), pa.int32()), pa.array(start, pa.int32()))
                columns = [pa.array(keys[low:high][text[new]]), pa.array(anchor[new]), pa.array(around[new]), pa.array(size[new], pa.int32()), starts]
                yield pa.RecordBatch.from_arrays(columns, schema=fields)

    return docs.select("key", "text").mapInArrow(run, "key long, anchor long, around long, size int, starts array<int>")


def sent_or_joined(rows, keys, on):
    """Rows whose key is among `keys` (distinct); the keys are sent to all executors if they are few."""
    return rows.join(F.broadcast(keys) if keys.count() <= SENT_KEYS else keys, on, "left_semi")


def surroundings(contents, docs):
    """(anchor, around, weight, string) of contents, cut out of one document that holds them."""
    wanted = contents.groupBy("key").agg(F.collect_list(F.struct("anchor", "around", "weight", "start", "size")).alias("cuts"))
    wanted = shared.stored(wanted, "cuts")
    texts = sent_or_joined(docs, wanted.select("key"), "key").dropDuplicates(["key"])
    schema = "anchor long, around long, weight long, string binary"

    def run(columns):
        out = {"anchor": [], "around": [], "weight": [], "string": []}
        for text, cuts in zip(encoded(columns["text"]), columns["cuts"], strict=True):
            for cut in cuts:
                for name in ("anchor", "around", "weight"):
                    out[name].append(cut[name])
                out["string"].append(text[cut["start"] : cut["start"] + cut["size"]])
        return out

    return texts.join(wanted, "key").select("text", "cuts").mapInArrow(shared.per_batch(run, schema), schema)


RANGES = "anchor long, around long, ranges array<int>"


def transformed(strings, least=LEAST):
    """(anchor, around, ranges): repeats inside the surroundings, by a transform per batch of whole anchor strings."""
    fields = pa.schema([("anchor", pa.int64()), ("around", pa.int64()), ("ranges", pa.list_(pa.int32()))])

    def batch_of(rows):
        found = repeated_ranges([x[3] for x in rows], [x[2] for x in rows], least)
        kept = [(row[0], row[1], [v for span in spans for v in span]) for row, spans in zip(rows, found, strict=True) if spans]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in kept], fields[k].type) for k in range(3)], schema=fields)

    def run(batches):
        rows, group, held = [], [], 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if group and group[-1][0] != row[0]:
                    size = sum(len(x[3]) for x in group)
                    if rows and held + size > BATCH_BYTES:
                        yield batch_of(rows)
                        rows, held = [], 0
                    rows += group
                    group, held = [], held + size
                group.append(row)
        if group and held + sum(len(x[3]) for x in group) > BATCH_BYTES and rows:
            yield batch_of(rows)
            rows = []
        if rows or group:
            yield batch_of(rows + group)

    return strings.repartition("anchor").sortWithinPartitions("anchor", "around").mapInArrow(run, RANGES)


def counted(strings, least=LEAST):
    """The same for anchor strings with very many surroundings: their windows meet by hash, folded before the shuffle."""
    schema = "anchor long, around long, weight long, place int, window long"

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(3).to_pylist()
            sizes = np.array([len(x) for x in texts], dtype=np.int64)
            ends, total = np.cumsum(sizes), int(sizes.sum())
            up, down = powers(total + 1)
            prefix = np.zeros(total + 1, dtype=np.uint64)
            np.cumsum(BYTES[np.frombuffer(b"".join(texts), dtype=np.uint8)] * up[:total], out=prefix[1:])
            each = np.maximum(sizes - least + 1, 0)
            row = np.repeat(np.arange(len(texts)), each)
            place = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
            at = (ends - sizes)[row] + place
            window = mixed((prefix[at + least] - prefix[at]) * down[at]).view(np.int64)
            columns = [batch.column(k).take(pa.array(row)) for k in range(3)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(place, pa.int32()), pa.array(window)], names=["anchor", "around", "weight", "place", "window"]
            )

    windows = strings.mapInArrow(run, schema)
    repeated = windows.groupBy("window").agg(F.sum("weight").alias("n")).where("n > 1").select("window")
    hits = windows.join(repeated, "window", "left_semi").groupBy("anchor", "around").agg(F.sort_array(F.collect_list("place")).alias("places"))
    spans = F.flatten(F.transform("places", lambda p: F.array(p, p + least)))
    return hits.select("anchor", "around", spans.alias("ranges"))


def repeat_ranges(docs, least=LEAST, gram=GRAM, hot=HOT):
    """(key, found): for each document with a repeat, where surroundings start and the ranges inside them. `docs`: (key, text)."""
    rows = anchor_rows(docs, least, gram)
    several = rows.groupBy("anchor").agg(F.sum(F.size("starts")).alias("n")).where("n > 1").select("anchor")
    rows = shared.stored(sent_or_joined(rows, shared.stored(several, "anchors"), "anchor"), "repeated-anchors")
    first = F.min(F.struct("key", F.col("starts")[0].alias("start")))
    contents = rows.groupBy("anchor", "around", "size").agg(F.sum(F.size("starts")).alias("weight"), first.alias("at"))
    contents = shared.stored(contents.select("anchor", "around", "size", "weight", "at.key", "at.start"), "surroundings")
    counts = contents.groupBy("anchor").agg(F.count("*").alias("n"))
    contents = shared.stored(contents.join(counts, "anchor"), "surroundings")
    alone = contents.where(f"n = 1 and weight > 1 and size >= {least}").select("anchor", "around", F.array(F.lit(0), F.col("size")).alias("ranges"))
    strings = shared.stored(surroundings(contents.where(f"n > 1 and n <= {hot}"), docs), "strings")
    ranges = alone.unionByName(transformed(strings, least))
    many = contents.where(f"n > {hot}")
    if many.limit(1).count():
        ranges = ranges.unionByName(counted(shared.stored(surroundings(many, docs), "strings"), least))
    covered = rows.join(shared.stored(ranges, "ranges"), ["anchor", "around"]).select("key", F.struct("starts", "ranges").alias("found"))
    return shared.stored(covered.groupBy("key").agg(F.collect_list("found").alias("found")), "covered")


def kept_bytes(text, found):
    """(bytes that stay, number of bytes removed, number of maximal runs removed)"""
    edge = np.zeros(len(text) + 1, dtype=np.int32)
    for x in found:
        starts, ranges = np.array(x["starts"]), np.array(x["ranges"])
        np.add.at(edge, (starts[:, None] + ranges[None, 0::2]).ravel(), 1)
        np.add.at(edge, (starts[:, None] + ranges[None, 1::2]).ravel(), -1)
    gone = np.cumsum(edge[:-1]) > 0
    runs = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(len(gone) > 0 and gone[0])
    return np.frombuffer(text, dtype=np.uint8)[~gone].tobytes(), int(np.count_nonzero(gone)), runs


def remove_repeats(docs, least=LEAST, gram=GRAM, hot=HOT, id_col="doc_id", text_col="text"):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row; `kept` holds the remaining bytes."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), shared.text_or_empty(text_col).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    found = repeat_ranges(rows.select("key", "text"), least, gram, hot)
    few = found.count() <= SENT_KEYS
    keys = F.broadcast(found.select("key")) if few else found.select("key")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"

    def run(columns):
        out = {name: [] for name in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for doc, text, x in zip(columns["doc_id"], encoded(columns["text"]), columns["found"], strict=True):
            kept, gone, runs = kept_bytes(text, x)
            for name, value in zip(out, (doc, len(text), gone, runs, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                out[name].append(value)
        return out

    cut = rows.join(keys, "key", "left_semi").join(found, "key").select("doc_id", "text", "found").mapInArrow(shared.per_batch(run, schema), schema)
    data = F.col("text").cast("binary")
    whole = rows.join(keys, "key", "left_anti").select(
        "doc_id", F.length(data).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.sha2(data, 256).alias("kept_sha256"), data.alias("kept"),
    )
    return whole.unionByName(cut)
