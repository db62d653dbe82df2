"""Language-model scores by logistic context mixing.

A text is a row of units, a word and the white space behind it, the last one closed by an end mark. A unit's symbols (bytes and the mark) are bits of a
Huffman code chosen by the symbol before, and each bit is predicted: several hashed contexts (the last one to four symbols, and the unit so far) have counts of zeros and ones,
their stretched probabilities are combined with weights that a gate chooses (place in the unit, how much the two longest contexts have seen), and the
sum is squashed. A unit that follows the end of a sentence or begins the text carries a sign of it, which is context but no symbol. Three refinements adapt to the text while it is read: the sharpness of the mix is averaged by how well each candidate has done so far, and
units that occurred before in the text, and units that followed the one before elsewhere in it, are predicted from it, with shares that follow how often that was right. All of it sums to one
over texts, so the bits are a code length.

Learning, over all training documents:

1. Every block of documents (a scan partition) gives its distinct units with counts, which are written.
2. Counts of the last one to four symbols are summed from them, one byte per count on a log scale, in tables of hashed slots: 2^16 to 2^22 slots, 11 MB
   in all at any size (`TABLE_BITS`). They are sent to every executor.
3. Counts of whole units so far grow with the corpus and are never in one place. Units that begin alike meet in one task: the shuffle goes by the first
   three bytes of the lower-cased word, by more bytes where so many rows begin alike that they would not fit (`MANY`). There every start of a unit longer than
   that has all its counts, and each unit keeps those of its own starts beside it. Starts that groups of more bytes have in common are summed over
   the groups by one more shuffle (`completed`), so the counts are the same however the rows were grouped. Starts of less than four symbols are the
   same as a context of four symbols. The first shuffle sums the words' counts as well.
4. Weights are learned online: tasks run through the units in steps, each with the unit's own occurrence taken out of the counts, and the tasks' weights
   are averaged.
5. Every distinct unit is coded once; its code lengths and its word's count go back to the blocks that hold it.

The base score counts words as they are, exactly; counts of contexts of one to four symbols that share a slot are added up. Null and empty texts are one end mark. Ties and
repeated rows score alike. Null ids belong to the fold of the empty text. Without training documents probabilities are one half per bit and the base score is -inf for nothing
learned (V = N = 0 gives log10 of 0.1 / 0.1). Columns besides id and text are not read.
"""

import functools
import heapq
import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import functions as F

from labelspark.llm import shared
from labelspark.session import small_batches

#: log2 of the slots per context: one to four symbols, the whole unit (in a table only where few units stand alone, as in tests).
TABLE_BITS = (16, 18, 20, 22, 22)
#: Tables of the first contexts are sent, two bytes a slot; the whole unit's counts lie beside the units.
SENT_BITS, HASH_BITS = TABLE_BITS[:4], 32
#: `decisions` gives 64-bit keys for this size and nothing for None.
WHOLE = 64
#: No counts beside the unit: a place within the bytes that its group has in common. Places before `OWN` never have them.
UNKNOWN = 0xFFFF
#: Bytes of the word that bring units together, and rows of a group beyond which more of them are taken.
LEVELS, MANY = (3, 7, 15, 31), 1 << 18
OWN = LEVELS[0] + 1
CONTEXTS = len(TABLE_BITS)
CHUNK = 1 << 14
PLACES, SEEN = 6, 5  # gates: place in the unit, how much the two longest contexts have seen
GATES = PLACES * SEEN * SEEN
SHARP = (0.75, 1.0, 1.25)
#: No UTF-8 text has this byte: the sign of a sentence's first unit.
SIGN = b"\xff"
SENTENCE = re.compile(rb"[.!?][\x22\x27)]*[\x20\x09-\x0d]+")
UNIT = re.compile(rb"[^\x20\x09-\x0d]*[\x20\x09-\x0d]+|[^\x20\x09-\x0d]+")
BLANK = b" \t\n\x0b\x0c\r"
END, SYMBOLS, START = 256, 257, 257
MIX = np.uint64(0x9E3779B97F4A7C15)
ODD = np.random.default_rng(11).integers(1 << 32, 1 << 63, 8 + SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPREAD = np.uint32(0x9E3779B1)


def units_of(data):
    """Units of a text's bytes; the last one has no white space behind it, and may be empty."""
    units = UNIT.findall(SIGN + SENTENCE.sub(b"\\g<0>" + SIGN, data))
    if not units or units[-1][-1] in BLANK:
        units.append(b"")
    return units


def is_last(unit):
    return not unit or unit[-1] not in BLANK


def word_of(unit):
    return unit.rstrip(BLANK).lstrip(SIGN).lower()


def huffman(counts):
    """Per symbol its code: lists of inner nodes and bits. Every symbol counts once at least, so codes stay short."""
    heap = [(int(c) + 1, k, None) for k, c in enumerate(counts)]
    heapq.heapify(heap)
    number = SYMBOLS
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], number, (a, b)))
        number += 1
    codes, stack = [None] * SYMBOLS, [(heap[0], [], [])]
    while stack:
        (_, k, parts), nodes, bits = stack.pop()
        if parts is None:
            codes[k] = (nodes, bits)
        else:
            stack += [(parts[bit], [*nodes, k - SYMBOLS], [*bits, bit]) for bit in (0, 1)]
    return codes


class Code:
    """A code per symbol before (START for none) as arrays: where a symbol's decisions begin, how many there are, their nodes and bits."""

    def __init__(self, counts):
        pairs = counts.reshape(START + 1, SYMBOLS)
        usual = pairs.sum(axis=0)
        size, node, bit = [], [], []
        for row in pairs:
            codes = huffman(1000 * row + usual * 1000 // (usual.sum() + 1))  # symbols new after this one have codes like elsewhere
            codes[SIGN[0]] = ([], [])  # never coded
            size += [len(nodes) for nodes, _ in codes]
            node += [x for nodes, _ in codes for x in nodes]
            bit += [x for _, bits in codes for x in bits]
        self.size = np.array(size, dtype=np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.spread = ((np.array(node, dtype=np.uint64) + np.uint64(1)) * ODD[7] >> np.uint64(32)).astype(np.uint32)
        self.bit = np.array(bit, dtype=np.int8)


@functools.lru_cache(maxsize=2)
def code_of(counts):
    return Code(np.frombuffer(counts, dtype=np.int64))


def symbols_of(units):
    """(symbols of all units in a row, number of symbols per unit)"""
    last = np.fromiter(map(is_last, units), dtype=bool, count=len(units))
    length = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
    size = length + last
    stops = np.cumsum(size)
    symbols = np.full(int(stops[-1]) if len(units) else 0, END, dtype=np.int64)
    place = np.ones(len(symbols), dtype=bool)
    place[stops[last] - 1] = False
    symbols[place] = np.frombuffer(b"".join(units), dtype=np.uint8)
    return symbols, size


def contexts(units):
    """(symbols, number of symbols per unit, symbol before or START, place in the unit, hash per context) of all symbols of `units`."""
    symbols, size = symbols_of(units)
    n, stops = len(symbols), np.cumsum(size)
    start = np.repeat(stops - size, size)
    place = np.arange(n) - start
    known = np.concatenate([np.zeros(4, dtype=np.uint64), symbols.astype(np.uint64) + np.uint64(1)])
    hashes, total = [], np.zeros(n, dtype=np.uint64)
    for k in range(1, 5):
        total = total + np.where(place >= k, known[4 - k : 4 - k + n], np.uint64(0)) * ODD[k]
        hashes.append(total)
    # The unit so far: a sum over places, each with its own factor.
    factor = ODD[8 + np.minimum(place, SYMBOLS - 1)]
    running = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * factor, dtype=np.uint64)])
    hashes.append(running[:-1] - running[start] + place.astype(np.uint64) * ODD[0])
    return symbols, size, np.where(place > 0, known[3 : 3 + n].astype(np.int64) - 1, START), place, hashes


def decisions(units, code, table_bits=TABLE_BITS):
    """(slot per context and decision, bit, first decision per unit, place in the unit) of all bits of `units`."""
    symbols, size, before, place, hashes = contexts(units)
    n, stops = len(symbols), np.cumsum(size)
    row = before * SYMBOLS + symbols
    per = code.size[row]
    ends = np.cumsum(per)
    index = np.arange(int(ends[-1]) if n else 0) + np.repeat(code.first[row] - ends + per, per)
    spread = code.spread[index]
    slots = []
    for h, bits in zip(hashes, table_bits, strict=True):
        if bits is None:
            slots.append(None)
            continue
        h = (h ^ (h >> np.uint64(31))) * MIX
        h ^= h >> np.uint64(29)
        if bits == WHOLE:
            slots.append(np.repeat(h, per) ^ spread.astype(np.uint64) * MIX)
            continue
        slot = np.repeat((h >> np.uint64(32)).astype(np.uint32), per)
        slot ^= spread
        slot *= SPREAD
        slot >>= np.uint32(HASH_BITS - bits)
        slots.append(slot.astype(np.intp))
    return slots, code.bit[index], (ends - per)[stops - size], np.repeat(place, per)


def bits_of(tables):
    """log2 of the slots of each table."""
    return tuple(len(table).bit_length() - 1 for table in tables)


def beside(units, code, tables, own):
    """(slots, bits, first, place, tables) of `units`, whose whole-unit counts `own` lie beside them; where these are unknown, those of four symbols serve."""
    slots, bits, first, place = decisions(units, code, (*bits_of(tables), None))
    whole = np.where(own == UNKNOWN, tables[-1].take(slots[-2]), own)
    return [*slots[:-1], np.arange(len(whole))], bits, first, place, (*tables, whole)


# One byte per count: 8 steps per doubling, exact up to 7 or so.
LEVEL = np.round(2.0 ** (np.arange(256) / 8) - 1, 3)


def level_of(counts):
    return np.minimum(np.round(8 * np.log2(1 + counts.astype(np.float64))), 255).astype(np.uint8)


@functools.lru_cache(maxsize=1)
def stretches():
    """Stretched chance of a one by (level of zeros, level of ones); the same by (bit, levels) with the bit's own occurrence taken out."""
    zeros, ones = LEVEL[:, None], LEVEL[None, :]
    of = lambda z, o: np.log((o + 0.3) / (z + 0.3)).astype(np.float32).ravel()
    return of(zeros, ones), np.concatenate([of(np.maximum(zeros - 1, 0), ones), of(zeros, np.maximum(ones - 1, 0))])


def seen_class(pair, less=0):
    """Gate part: how much the context has seen."""
    total = LEVEL[pair >> 8] + LEVEL[pair & 255] - less
    return np.digitize(total, (0.5, 3.0, 20.0, 300.0))


SEEN_CLASS = seen_class(np.arange(1 << 16)).astype(np.int16)
SEEN_CLASS_LESS = seen_class(np.arange(1 << 16), 1).astype(np.int16)


def inputs(slots, bits, place, tables, left_out=False):
    """(stretched chances per context, gate per decision)"""
    plain, left = stretches()
    bit = bits.astype(np.intp) << 16
    x, seen, gate = [], SEEN_CLASS_LESS if left_out else SEEN_CLASS, np.minimum(place, PLACES - 1).astype(np.int16)
    for k in range(CONTEXTS):
        pair = tables[k].take(slots[k]).astype(np.intp)
        if k >= CONTEXTS - 2:
            gate = gate * np.int16(SEEN) + seen.take(pair)
        x.append(left.take(bit + pair) if left_out else plain.take(pair))
    return x, gate.astype(np.intp)


def start_weights():
    return np.full((GATES, CONTEXTS), 0.3, dtype=np.float32)


def mix(x, gate, weights):
    columns = np.ascontiguousarray(weights.T, dtype=np.float32)
    z = columns[0].take(gate) * x[0]
    for k in range(1, CONTEXTS):
        z += columns[k].take(gate) * x[k]
    return z


def learn_weights(weights, x, gate, bits, counts, rate):
    """One online step on a group of decisions: the gradient of each gate's code length, scaled by how much the gate was used."""
    z = mix(x, gate, weights)
    error = (bits - 1 / (1 + np.exp(-np.clip(z, -20, 20)))) * counts
    used = np.bincount(gate, weights=counts, minlength=GATES) + 1e-9
    for k in range(CONTEXTS):
        weights[:, k] += rate * np.bincount(gate, weights=error * x[k], minlength=GATES) / used
    return used


#: Sums of the mix are rounded to this step and held within STEPS steps of zero, alike for both bits.
STEP, STEPS = 1 / 64, 1024


@functools.lru_cache(maxsize=1)
def losses():
    """Bits lost per rounded sum (from the worst to the best) and sharpness."""
    z = np.arange(-STEPS, STEPS + 1) * STEP
    return [np.logaddexp(0, -sharp * z) / np.log(2) for sharp in SHARP]


def code_lengths(units, code, tables, weights, own=None, step=512):
    """len(units) x len(SHARP): log2 of each unit's probability under each sharpness. `own`: bytes of each unit's counts, or the last table has them."""
    out = np.zeros((len(units), len(SHARP)))
    for a in range(0, len(units), step):
        part = units[a : a + step]
        if own is None:
            slots, bits, first, place = decisions(part, code, bits_of(tables))
            used = tables
        else:
            slots, bits, first, place, used = beside(part, code, tables, np.frombuffer(b"".join(own[a : a + step]), dtype=np.uint16))
        x, gate = inputs(slots, bits, place, used)
        z = np.clip(np.rint(mix(x, gate, weights) * np.float32(1 / STEP)), -STEPS, STEPS)
        z = (STEPS + z * (2 * bits - 1)).astype(np.intp)
        for m, lost in enumerate(losses()):
            out[a : a + len(part), m] = -np.add.reduceat(lost.take(z), first)
    return out


def ranked(key):
    """(how often each key occurred before, number of its group) of whole numbers."""
    n = len(key)
    order, width = np.arange(n), int(n).bit_length()
    if int(key.max()).bit_length() + width <= 64:
        both = np.sort((key << np.uint64(width)) | order.astype(np.uint64))
        by, key = (both & np.uint64((1 << width) - 1)).astype(np.int64), both >> np.uint64(width)
    else:
        by = np.argsort(key, kind="stable")
        key = key[by]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    earlier, group = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    earlier[by] = order - np.maximum.accumulate(np.where(new, order, 0))
    group[by] = np.cumsum(new) - 1
    return earlier, group


def adapted(lengths, unit, first):
    """log2 probability of each text: `lengths` per token and sharpness, `unit` numbers per token, `first` token of each text (ends included)."""
    n, sizes = len(unit), np.diff(first)
    if not n:
        return np.zeros(len(sizes))
    text, starts = np.repeat(np.arange(len(sizes)), sizes), first[:-1]
    at = np.arange(n) - np.repeat(starts, sizes)
    # Shares of the candidates follow what each has made of the text so far; sums are taken relative to the middle one.
    columns = [np.ascontiguousarray(lengths[:, m]) for m in range(lengths.shape[1])]
    middle = columns[len(columns) // 2]
    above, below = np.ones(n), np.ones(n)
    for column in columns:
        if column is not middle:
            lead = np.cumsum(column - middle)
            lead -= np.repeat(lead[starts] - (column - middle)[starts], sizes)  # up to and with each token
            above += np.exp2(np.clip(lead, -900, 900))
            below += np.exp2(np.clip(lead - (column - middle), -900, 900))
    mixed = middle + np.log2(above / below)
    # How often the unit occurred before in its text.
    earlier, group = ranked((text.astype(np.uint64) << np.uint64(int(unit.max()).bit_length())) | unit.astype(np.uint64))
    hit = earlier > 0
    hits = np.cumsum(hit) - hit
    hits -= np.repeat(hits[starts], sizes)
    share = (hits + 0.5) / (at + 1)
    share[starts] = 0
    bits = np.log2(1 - share) + mixed
    known = np.flatnonzero(hit)
    bits[known] = np.log2(np.exp2(np.maximum(bits[known], -900)) + share[known] * earlier[known] / at[known])
    return np.add.reduceat(followed(bits, earlier, group, starts, sizes), starts)


def followed(bits, earlier, group, starts, sizes):
    """`bits` with what followed the unit before elsewhere in the text mixed in, by a share that follows how often that was right.

    `earlier`: how often a unit occurred before in its text; `group`: numbers of the different units of each text.
    """
    seen = np.concatenate([[0], earlier[:-1]])  # each earlier place of the unit before has one that follows it
    seen[starts] = 0
    right = ranked((np.concatenate([[group.max() + 1], group[:-1]]).astype(np.uint64) << np.uint64(int(group.max()).bit_length())) | group.astype(np.uint64))[0]
    right[starts] = 0
    tried, hit = seen > 0, right > 0
    tries, hits = np.cumsum(tried) - tried, np.cumsum(hit) - hit
    share = (hits - np.repeat(hits[starts], sizes) + 0.5) / (tries - np.repeat(tries[starts], sizes) + 1)
    out = bits.copy()
    out[tried] += np.log2(1 - share[tried])
    known = np.flatnonzero(hit)
    out[known] = np.log2(np.exp2(np.maximum(out[known], -900)) + share[known] * right[known] / seen[known])
    return out


# Learning on Spark


def blocks_of(docs, id_col, text_col, folds, held_out):
    """Documents with their scan partition as `block`, from the shared folder."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (shared.buckets_of(id_col, folds) == held_out).alias("held_out"), shared.text_or_empty(text_col).alias("text")
    )
    return shared.stored(rows.withColumn("block", F.spark_partition_id()), "blocks", "snappy")


def hashes_of(units):
    """64-bit hashes of units, as signed numbers."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, units), dtype=np.uint64, count=len(units)).view(np.int64)


def unit_rows(blocks, keep=600_000):
    """(word, unit, block, n): a block's distinct units and how often training texts have them, written."""
    fields = pa.schema([("word", pa.binary()), ("unit", pa.binary()), ("block", pa.int32()), ("n", pa.int64())])

    def run(batches):
        counts, block = Counter(), None

        def out():
            units = list(counts)
            for a in range(0, len(units), 50_000):
                part = units[a : a + 50_000]
                n = pa.array(map(counts.__getitem__, part), pa.int64(), size=len(part))
                columns = [pa.array(map(word_of, part), pa.binary(), size=len(part)), pa.array(part, pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(part), block, dtype=np.int32)), n], schema=fields)

        for batch in shared.parts(batches):
            held, texts, numbers = (batch.column(k).to_pylist() for k in range(3))
            for is_held, text, number in zip(held, texts, numbers, strict=True):
                if number != block or len(counts) > keep:
                    yield from out()
                    counts, block = Counter(), number
                units = units_of(text.encode("utf-8", "surrogatepass"))
                counts.update(dict.fromkeys(units, 0) if is_held else units)
        yield from out()

    rows = blocks.select("held_out", "text", "block").mapInArrow(run, "word binary, unit binary, block int, n long")
    return shared.stored(rows, "units")


def keyed(rows, many=MANY):
    """Rows with `key`, the first bytes of their word, and `deep`, the symbols of a unit that settle it. Keys of more than `many` rows get more bytes."""
    out = rows.select("*", F.substring("word", 1, LEVELS[0]).alias("key"), F.lit(OWN).alias("deep"))
    for length in (*LEVELS[1:], None):
        hot = shared.stored(out.groupBy("key").count().where(F.col("count") > many).select("key", F.lit(True).alias("hot")), "hot-keys")
        if hot.isEmpty():
            break
        longer, deep = (F.col("word"), F.lit(1 << 30)) if length is None else (F.substring("word", 1, length), F.lit(length + 1))
        out = out.join(hot, "key", "left").select(
            *rows.columns, F.when(F.col("hot"), longer).otherwise(F.col("key")).alias("key"), F.when(F.col("hot"), deep).otherwise(F.col("deep")).alias("deep")
        )
    return out


def whole_groups(batches, rows):
    """Tables of at least `rows` rows with all rows of their keys, from batches where rows of a `key` lie together; more only where one key has more."""
    held, size, wanted = [], 0, rows
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= wanted:
            table = pa.Table.from_batches(held).combine_chunks()
            key = table.column("key")
            ended = np.flatnonzero(pc.not_equal(key, key[-1]).to_numpy())
            cut = int(ended[-1]) + 1 if len(ended) else 0
            if cut:
                yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
            size -= cut
            wanted = max(rows, 2 * size)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def whole_counts(units, n, deep, code):
    """Per unit the bytes of its decisions' counts under the unit so far (zeros and ones as levels, UNKNOWN before place `deep`), from these units."""
    keys, weights, bits, places, per = [], [], [], [], []
    for a in range(0, len(units), 2048):
        slots, bit, first, place = decisions(units[a : a + 2048], code, (*[None] * 4, WHOLE))
        size = np.diff(np.append(first, len(bit)))
        use = place >= np.repeat(deep[a : a + 2048], size)
        for held, x in zip((keys, weights, bits, places, per), (slots[-1][use], np.repeat(n[a : a + 2048], size)[use], bit[use], use, size), strict=True):
            held.append(x)
    keys, weights, bits, use, per = map(np.concatenate, (keys, weights, bits, places, per))
    found, at = np.unique(keys, return_inverse=True)
    ones = np.bincount(at, weights=weights * bits, minlength=len(found))
    zeros = np.bincount(at, weights=weights, minlength=len(found)) - ones
    out = np.full(len(use), UNKNOWN, dtype=np.uint16)
    out[use] = np.minimum((level_of(zeros).astype(np.uint16) << 8) | level_of(ones), UNKNOWN - 1)[at]
    offsets = np.concatenate([[0], 2 * np.cumsum(per)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(units), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def vocabulary(rows, counts, many=MANY):
    """(unit, hash, n, c, leads, own, blocks) per distinct unit: its count and its word's in training texts (-1: no word), whether it is its word's first row,
    the counts of its starts, the blocks that hold it."""
    names = ("unit", "hash", "n", "c", "leads", "own", "blocks", "deep")
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.list_(pa.int32()), pa.int32())
    fields = pa.schema(zip(names, kinds, strict=True))

    def run(batches):
        code = code_of(counts)
        for table in whole_groups(batches, 1 << 17):
            unit, block, n, deep = (table.column(name).combine_chunks() for name in ("unit", "block", "n", "deep"))
            new = np.ones(len(unit), dtype=bool)
            new[1:] = pc.not_equal(unit.slice(1), unit.slice(0, len(unit) - 1)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new)
            unit, deep = (x.take(pa.array(starts)) for x in (unit, deep))
            units = unit.to_pylist()
            word = pa.array(map(word_of, units), pa.binary(), size=len(units))
            total = np.add.reduceat(n.to_numpy(), starts)
            number = word.dictionary_encode().indices.to_numpy()
            leads = np.zeros(len(starts), dtype=bool)
            leads[np.unique(number, return_index=True)[1]] = True
            c = np.rint(np.bincount(number, weights=total)).astype(np.int64)[number]
            c[pc.equal(pc.binary_length(word), 0).to_numpy(zero_copy_only=False)] = -1
            blocks = pa.ListArray.from_arrays(pa.array(np.append(starts, len(new)).astype(np.int32)), pa.array(block.to_numpy()))
            columns = [unit, pa.array(hashes_of(units)), pa.array(total), pa.array(c), pa.array(leads), whole_counts(units, total, deep.to_numpy(), code), blocks, deep]
            out = pa.RecordBatch.from_arrays(columns, schema=fields)
            for a in range(0, out.num_rows, 10_000):
                yield out.slice(a, 10_000)

    # Groups are 32 bits of the key's hash (keys that share them are one group); one number sorts by group and unit.
    grouped = keyed(rows, many).select(F.shiftrightunsigned(F.xxhash64("key"), 32).alias("key"), "deep", "unit", "block", "n")
    turn = F.shiftleft("key", 32).bitwiseOR(F.shiftrightunsigned(F.xxhash64("unit"), 32))
    together = grouped.repartition("key").sortWithinPartitions(turn, "unit")
    schema = "unit binary, hash long, n long, c long, leads boolean, own binary, blocks array<int>, deep int"
    return completed(shared.stored(together.mapInArrow(run, schema), "vocabulary"), counts)


def open_decisions(heads, deep, code):
    """(slot, bit, head) of the decisions at places from `OWN` to before `deep` of heads, the first `deep` symbols of units."""
    slots, bits, first, place = decisions(heads, code, (*[None] * 4, WHOLE))
    row = np.repeat(np.arange(len(heads)), np.diff(np.append(first, len(bits))))
    use = (place >= OWN) & (place < deep[row])
    return slots[-1][use].view(np.int64), bits[use], row[use]


def completed(vocab, counts):
    """The vocabulary with counts for the starts that several groups share: each start's are summed over all groups, then set beside its units.

    Units with the same first `deep` symbols (`head`) lack the same counts, so heads are what is summed and looked up, a row per decision.
    """
    lacking = vocab.where(F.col("deep") > OWN).withColumn("head", F.expr("substring(unit, 1, deep)"))
    if lacking.isEmpty():
        return vocab.drop("deep")
    heads = shared.stored(lacking.groupBy("head", "deep").agg(F.sum("n").alias("n")), "heads")

    def sums(batches):
        code = code_of(counts)
        for batch in shared.parts(batches):
            if batch.num_rows:
                slot, bit, row = open_decisions(batch.column(0).to_pylist(), batch.column(1).to_numpy(), code)
                n = batch.column(2).to_numpy()[row]
                found, at = np.unique(slot, return_inverse=True)
                total = np.zeros((2, len(found)), dtype=np.int64)
                np.add.at(total, (bit, at), n)
                yield pa.RecordBatch.from_arrays([pa.array(found), *map(pa.array, total)], names=["slot", "zeros", "ones"])

    def asked(batches):
        code = code_of(counts)
        for batch in shared.parts(batches):
            if batch.num_rows:
                slot, _, row = open_decisions(batch.column(0).to_pylist(), batch.column(1).to_numpy(), code)
                each = np.bincount(row, minlength=batch.num_rows)
                at = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
                columns = [*(batch.column(k).take(pa.array(row)) for k in range(2)), pa.array(at.astype(np.int32)), pa.array(slot)]
                yield pa.RecordBatch.from_arrays(columns, names=["head", "deep", "at", "slot"])

    def set_beside(batches):
        for batch in shared.parts(batches):
            if not batch.num_rows:
                continue
            own, found = batch.column(place["own"]), batch.column(place["found"])
            size = pc.binary_length(own).to_numpy(zero_copy_only=False) // 2
            each = pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            values, ends, stops = np.frombuffer(b"".join(own.to_pylist()), dtype=np.uint16).copy(), np.cumsum(size), np.cumsum(each)
            unknown = np.cumsum(np.append(0, values == UNKNOWN))
            # Unknown places come first in a unit; the last of them are those from `OWN` on.
            last = (ends - size) + unknown[ends] - unknown[ends - size]
            at = np.repeat(last - stops, each) + np.arange(each.sum())
            counts = found.flatten()
            zeros, ones = (level_of(counts.field(k).to_numpy(zero_copy_only=False)) for k in (1, 2))
            values[at] = np.minimum((zeros.astype(np.uint16) << 8) | ones, UNKNOWN - 1)
            offsets = np.append(0, 2 * ends).astype(np.int32)
            columns = [batch.column(k) for k in range(batch.num_columns - 1)]
            columns[place["own"]] = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(values)])
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    totals = heads.mapInArrow(sums, "slot long, zeros long, ones long").groupBy("slot").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))
    # The engine takes the size of `heads` for that of `asked`, which has a row per decision: without the hint it would gather those on the driver.
    totals = shared.stored(totals, "starts").hint("merge")
    found = heads.select("head", "deep").mapInArrow(asked, "head binary, deep int, at int, slot long").join(totals, "slot")
    found = found.groupBy("head", "deep").agg(F.sort_array(F.collect_list(F.struct("at", "zeros", "ones"))).alias("found"))
    filled = lacking.join(found, ["head", "deep"], "left").select(*(x for x in vocab.columns if x != "deep"), "found")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in filled.schema.fields if f.name != "found")
    place = {name: k for k, name in enumerate(filled.columns)}
    with small_batches(vocab.sparkSession, 2048):  # a row holds the counts of all its starts
        filled = shared.stored(filled.mapInArrow(set_beside, schema), "vocabulary")
    return vocab.where(F.col("deep") == OWN).drop("deep").unionByName(filled)


def distinct_units(batches):
    """(units, counts) from rows of units and counts, a batch at a time."""
    for batch in batches:
        total = {}
        for unit, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if n:
                total[unit] = total.get(unit, 0) + n
        if total:
            yield list(total), np.fromiter(total.values(), dtype=np.int64, count=len(total))


def pair_counts(units, n):
    """How often each symbol follows each one, START for none."""
    symbols, size = symbols_of(units)
    before = np.concatenate([[START], symbols[:-1]])
    before[(np.cumsum(size) - size)] = START
    total = np.bincount(before * SYMBOLS + symbols, weights=np.repeat(n, size), minlength=(START + 1) * SYMBOLS)
    return np.rint(total).astype(np.int64)


def symbol_counts(vocab):
    def run(batches):
        total = np.zeros((START + 1) * SYMBOLS, dtype=np.int64)
        for units, n in distinct_units(batches):
            total += pair_counts(units, n)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["pair", "n"])

    rows = vocab.select("unit", "n").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    out = np.zeros((START + 1) * SYMBOLS, dtype=np.int64)
    for row in rows:
        out[row["pair"]] = row["n"]
    return out.tobytes()


def context_tables(rows, counts, sizes=SENT_BITS):
    """Levels of zeros and ones per slot, uint16 per table: sums over all training units, a chunk of slots per shuffled row."""
    names = ["t", "chunk", "sums"]

    def run(batches):
        code = code_of(counts)
        sums = [np.zeros(2 << bits, dtype=np.float32) for bits in sizes]
        for units, n in distinct_units(batches):
            for a in range(0, len(units), 512):
                slots, bits, first, _ = decisions(units[a : a + 512], code, (*sizes, None))
                weight = np.repeat(n[a : a + 512].astype(np.float32), np.diff(np.append(first, len(bits))))
                for table, slot in zip(sums, slots[:-1], strict=True):
                    np.add.at(table, slot * 2 + bits, weight)
        for k, table in enumerate(sums):
            parts = table.reshape(-1, 2 * CHUNK)
            for j in np.flatnonzero(parts.any(axis=1)).tolist():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([j]), pa.array([parts[j].tobytes()], pa.binary())], names=names)

    def add(batches):
        key, total = None, None

        def out():
            pair = total.reshape(-1, 2)
            data = (level_of(pair[:, 0]).astype(np.uint16) << 8) | level_of(pair[:, 1])
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([data.tobytes()], pa.binary())], names=["t", "chunk", "levels"])

        for batch in batches:
            for t, chunk, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if key != (t, chunk):
                    if key is not None:
                        yield out()
                    key, total = (t, chunk), np.zeros(2 * CHUNK)
                total += np.frombuffer(data, dtype=np.float32)
        if key is not None:
            yield out()

    parts = rows.select("unit", "n").mapInArrow(run, "t long, chunk long, sums binary")
    summed = parts.repartition("t", "chunk").sortWithinPartitions("t", "chunk").mapInArrow(add, "t long, chunk long, levels binary")
    tables = [np.zeros(1 << bits, dtype=np.uint16) for bits in sizes]
    for row in summed.collect():  # 11 MB at any size
        tables[row["t"]][row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(bytes(row["levels"]), dtype=np.uint16)
    return tables


def gate_weights(vocab, counts, sent):
    """Mean over tasks of weights learned online, gate by gate, by how often each task used the gate."""

    def run(batches):
        code, tables = code_of(counts), sent.value
        weights, used, steps = start_weights().astype(np.float64), np.zeros(GATES), 0
        for batch in shared.parts(batches, 1024):
            if batch.num_rows:
                units, n, own = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
                many = np.sqrt(n.astype(np.float64))
                slots, bits, first, place, with_own = beside(units, code, tables, np.frombuffer(b"".join(own), dtype=np.uint16))
                x, gate = inputs(slots, bits, place, with_own, left_out=True)
                steps += 1
                used += learn_weights(weights, x, gate, bits, np.repeat(many, np.diff(np.append(first, len(bits)))), 0.6 / (1 + steps / 80))
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([used.tobytes()], pa.binary())], names=["w", "used"])

    rows = vocab.where("n > 0").select("unit", "n", "own").mapInArrow(run, "w binary, used binary").collect()
    total, used = np.zeros((GATES, CONTEXTS)), np.zeros((GATES, 1))
    for row in sorted(rows, key=lambda r: bytes(r["used"])):
        share = np.frombuffer(bytes(row["used"]))[:, None]
        total += np.frombuffer(bytes(row["w"])).reshape(GATES, CONTEXTS) * share
        used += share
    return np.where(used > 0, total / np.maximum(used, 1e-12), start_weights()).astype(np.float32)


#: One unit's figures for a block: hash, count of its word, code lengths. A row carries many of them, column by column.
FIGURES = (np.int64, np.int64, *[np.float32] * len(SHARP))


def packed(columns):
    return b"".join(np.ascontiguousarray(x, dtype=kind).tobytes() for x, kind in zip(columns, FIGURES, strict=True))


def unpacked(data):
    n = len(data) // sum(np.dtype(kind).itemsize for kind in FIGURES)
    at = np.cumsum([0, *(n * np.dtype(kind).itemsize for kind in FIGURES)])
    return [np.frombuffer(data, dtype=kind, count=n, offset=int(start)) for kind, start in zip(FIGURES, at[:-1], strict=True)]


def block_rows(vocab, counts, weights, sent):
    """(block, figures): hashes of every block's distinct units with their word's count and their code lengths, packed."""

    def run(batches):
        model = code_of(counts), sent.value, np.frombuffer(weights, dtype=np.float32).reshape(GATES, CONTEXTS)
        for batch in shared.parts(batches, 8192):
            if batch.num_rows:
                lengths = code_lengths(batch.column(0).to_pylist(), *model, batch.column(3).to_pylist()).astype(np.float32)
                held = batch.column(4)
                unit, block = np.repeat(np.arange(batch.num_rows), pc.list_value_length(held).to_numpy()), held.flatten().to_numpy()
                order = np.argsort(block, kind="stable")
                unit, block = unit[order], block[order]
                cuts = np.flatnonzero(np.diff(block, prepend=-1, append=-1))
                figures = (batch.column(1).to_numpy(), batch.column(2).to_numpy(), *lengths.T)
                data = [packed([x[unit[a:b]] for x in figures]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(block[cuts[:-1]], pa.int32()), pa.array(data, pa.binary())], names=["block", "figures"])

    return vocab.select("unit", "hash", "c", "own", "blocks").mapInArrow(run, "block int, figures binary")


class Scores(dict):
    """unit -> its number; `rows` has the units' code lengths, `counts` how often training texts have their words.

    A new unit gets a number when it is first asked for and its figures with all other new ones in `fill`.
    """

    def __init__(self, keep=400_000):
        self.keep, self.new = keep, []
        self.rows, self.counts = np.zeros((1 << 16, len(SHARP))), np.zeros(1 << 16, dtype=np.int64)

    def __missing__(self, unit):
        self[unit] = k = len(self)
        self.new.append(unit)
        return k

    def forget(self, common=8):
        """Beyond `keep`, all units go but those of common words."""
        if len(self) > self.keep:
            kept = [unit for unit, k in self.items() if self.counts[k] >= common]
            rows = np.fromiter(map(self.__getitem__, kept), dtype=np.int64, count=len(kept))
            if len(kept) > self.keep // 2:
                kept, rows = [], rows[:0]
            self.rows[: len(kept)], self.counts[: len(kept)] = self.rows[rows], self.counts[rows]
            self.clear()
            self.update(zip(kept, range(len(kept)), strict=True))

    def fill(self, known, found, lengths):
        """`known`: sorted hashes of the block's units, `found` and `lengths`: their figures."""
        first = len(self) - len(self.new)
        if len(self) > len(self.rows):
            size = 1 << len(self).bit_length()
            self.rows, self.counts = np.resize(self.rows, (size, len(SHARP))), np.resize(self.counts, size)
        if self.new:
            hashes = hashes_of(self.new)
            at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
            if not len(known) or (known[at] != hashes).any():
                raise ValueError("a block's units are missing from its vocabulary")
            self.rows[first : len(self)], self.counts[first : len(self)] = lengths[at], found[at]
            self.new = []


_SCORES = {}


def scores_of(key):
    """One per worker process and model: tasks that follow each other share it."""
    if key not in _SCORES:
        _SCORES.clear()
        _SCORES[key] = Scores()
    return _SCORES[key]


def score(docs, folds=10, held_out=0, smooth=0.1, id_col="doc_id", text_col="text"):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) of every document."""
    spark = docs.sparkSession
    shared.ship(spark)
    blocks = blocks_of(docs, id_col, text_col, folds, held_out)
    rows = unit_rows(blocks)
    train_docs = blocks.where(~F.col("held_out")).count()
    counts = symbol_counts(rows)
    vocab = vocabulary(rows, counts)
    words = vocab.where("leads and c > 0").agg(F.count("*").alias("v"), F.sum("c").alias("n")).first()
    n, v = (words["n"] or 0) + train_docs, words["v"] + (train_docs > 0)
    sent = spark.sparkContext.broadcast(context_tables(vocab, counts))
    weights = gate_weights(vocab, counts, sent).tobytes()
    key = xxhash.xxh3_64_intdigest(counts + weights + str((n, v)).encode())
    floor, end_score = np.log10(n + smooth * (v + 1)), np.log10(train_docs + smooth)
    empty = [F.lit(None).cast(kind).alias(name) for name, kind in (("doc_id", "long"), ("held_out", "boolean"), ("text", "string"))]
    answers = block_rows(vocab, counts, weights, sent).select("block", *empty, "figures")
    asked = blocks.select("block", "doc_id", "held_out", "text", F.lit(None).cast("binary").alias("figures"))
    parts = (blocks.agg(F.max("block")).first()[0] or 0) + 1
    together = answers.unionByName(asked).withColumn("kind", F.col("figures").isNull().cast("int"))
    together = together.repartitionById(parts, "block").sortWithinPartitions("block", "kind")
    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")
    fields = pa.schema(zip(names, (pa.int64(), pa.bool_(), *[pa.int64()] * 3, pa.float64(), pa.float64(), pa.int64(), pa.float64()), strict=True))

    def texts(known, found, figures, ids, held, values):
        scores = scores_of(key)
        for low, high in shared.slices(values, 1 << 21):
            data = [x.encode("utf-8", "surrogatepass") for x in values[low:high]]
            rows = [units_of(x) for x in data]
            first = np.concatenate([[0], np.cumsum([len(row) for row in rows])])
            scores.forget()
            unit = np.fromiter(map(scores.__getitem__, itertools.chain.from_iterable(rows)), dtype=np.int64, count=first[-1])
            scores.fill(known, found, figures)
            bits = adapted(scores.rows[unit], unit, first)
            c = scores.counts[unit]
            is_word = c >= 0
            per = np.add.reduceat(is_word.astype(np.int64), first[:-1])
            base = np.add.reduceat(np.where(is_word, np.log10(np.maximum(c, 0) + smooth), 0), first[:-1]) + end_score - (per + 1) * floor
            n_known = np.add.reduceat((c > 0).astype(np.int64), first[:-1]) + (train_docs > 0)
            size = np.array([len(x) for x in data], dtype=np.int64)
            columns = (ids[low:high], held[low:high], per + 1, n_known, np.full(len(rows), n), base, bits * np.log10(2), size, -bits / np.maximum(size, 1))
            yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(columns, fields, strict=True)], schema=fields)

    def run(batches):
        heard, known, block = [], None, None
        for batch in batches:
            number = batch.column(0).to_numpy()
            # Rows come block by block, its units before its texts.
            cuts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1], [True]])) if len(number) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if number[a] != block:
                    heard, known, block = [], None, number[a]
                part = batch.slice(a, b - a)
                n_units = len(part) - part.column(4).null_count
                if n_units:
                    heard += map(unpacked, part.column(4).slice(0, n_units).to_pylist())
                if n_units < len(part):
                    if known is None:
                        hashes, found, *figures = (np.concatenate(x) for x in zip(*heard, strict=True))
                        known, at = np.unique(hashes, return_index=True)
                        found, figures, heard = found[at], np.stack(figures, axis=1)[at], []
                    yield from texts(known, found, figures, *(part.column(k).slice(n_units).to_pylist() for k in (1, 2, 3)))

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
    return together.select("block", "doc_id", "held_out", "text", "figures").mapInArrow(run, schema)
