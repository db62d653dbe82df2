"""Linear softmax heads on hashed words, all fitted together: one aggregate per step, whatever the number of tasks.

A text is hashed and weighed once, however many rows and tasks it has: its rows are counted per task, class and split first. Blocks of
texts are written once; a step sends the weights, adds up the gradients of all heads inside each task, then over the tasks, and moves the
weights. The same pass over the blocks scores the validation rows under the weights it was given, so a head that has stopped getting
better costs no extra job to find: it keeps its best weights and its rows are skipped from then on.
"""

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from labelspark.operators.tokens import tokens
from labelspark.session import ship, small_batches, written

#: Texts of a block. A block is dense while it is worked on: at most `BLOCK` x features numbers.
BLOCK = 256
#: Blocks that come to a Python worker at once, some 300 KB each.
SENT_BLOCKS = 16
#: Weights of heads fitted at a time, as they are sent to all executors. More heads are fitted in several groups, one after another.
HEAD_BYTES = 1 << 28
#: Numbers of a gradient that are added up as one row.
CELLS = 1 << 12
TEXT_KEY = ("_h", "_g")


def text_keys(text="text"):
    """Two 64-bit hashes that stand for a text in joins."""
    text = F.coalesce(F.col(text), F.lit(""))
    return {"_h": F.xxhash64(text), "_g": F.xxhash64(F.lit("g"), text)}


def word_list(size, clean, text="text"):
    """The words of a cleaned text as column numbers below `size`."""
    return F.transform(tokens(F.coalesce(clean(F.col(text)), F.lit(""))), lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("int"))


def hashed_words(rows, size, clean, text="text"):
    """(_h, _g, words): the hashed words of every distinct text of rows with text keys, cleaned once."""
    distinct = rows.groupBy(*TEXT_KEY).agg(F.first(F.coalesce(F.col(text), F.lit(""))).alias(text))
    return distinct.select(*TEXT_KEY, word_list(size, clean, text).alias("words"))


class Features:
    """Hashed words weighed by inverse document frequency; texts are scaled to length one."""

    def __init__(self, idf):
        self.idf = idf

    @property
    def size(self):
        return len(self.idf)

    def matrix(self, lists):
        """(columns, dense rows over these columns) of some texts."""
        rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        flat = np.concatenate([np.asarray(x, np.int64) for x in lists]) if len(lists) else np.zeros(0, np.int64)
        columns, place = np.unique(flat, return_inverse=True)
        dense = np.zeros((len(lists), len(columns)))
        np.add.at(dense, (rows, place), self.idf[flat])
        length = np.sqrt((dense * dense).sum(axis=1, keepdims=True))
        return columns, np.divide(dense, length, out=dense, where=length > 0)


def fit_features(words, size, min_docs=0):
    """Weights of the hashed words; those in fewer than `min_docs` texts get 0. One row per column comes to the driver."""
    every = F.explode(F.array_append(F.array_distinct("words"), F.lit(-1)).alias("w"))
    found = words.select(every.alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()
    seen = {row["w"]: row["n"] for row in found}
    n, docs = seen.pop(-1, 0), np.zeros(size)
    docs[list(seen)] = list(seen.values())
    return Features(np.where(docs >= max(min_docs, 1), np.log((n + 1) / (docs + 1)) + 1, 0.0))


class Heads:
    """Fitted heads: `classes` are (task, [class values]) in column order, `weights` has a column per class, its last row the bias.

    `history` has (task, step, accuracy on the validation rows) for every step that was scored.
    """

    def __init__(self, classes, weights, history=()):
        self.classes, self.weights, self.history = classes, weights, list(history)

    def __iter__(self):
        return iter(task for task, _ in self.classes)

    def __len__(self):
        return len(self.classes)


def column_starts(sizes):
    return np.concatenate([[0], np.cumsum(sizes)]).astype(int)


def chances(z):
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def evened(batches, rows):
    """The rows of `batches` in tables of `rows` rows, the last one of what is left: few rows are Python objects at a time."""
    held, size = [], 0
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            held.append(batch.slice(start, rows - size))
            size += held[-1].num_rows
            start += held[-1].num_rows
            if size == rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


BLOCKS = "columns binary, ends binary, places binary, cells binary, rows binary, tasks binary, classes binary, weights binary, valid binary"


def blocks_of(words, entries, features):
    """Written blocks of `BLOCK` texts: their weighed words, and their entries (task, class, weight, validation or not), by task."""
    idf, fields = features, to_arrow_schema(StructType.fromDDL(BLOCKS))

    def block(lists, marks):
        columns, dense = idf.matrix(lists)
        row, place = np.nonzero(dense)
        marks = sorted((m["t"], k, m["y"], m["w"], m["valid"]) for k, own in enumerate(marks) for m in own)
        tasks, rows, classes, weights, valid = zip(*marks, strict=True)
        cells = (
            columns.astype("<i4"),
            np.searchsorted(row, np.arange(1, len(lists) + 1)).astype("<i4"),
            place.astype("<i4"),
            dense[row, place].astype("<f4"),
            np.array(rows, "<i4"),
            np.array(tasks, "<i4"),
            np.array(classes, "<i4"),
            np.array(weights, "<f8"),
            np.array(valid, "u1"),
        )
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in cells], schema=fields)

    def run(batches):
        for part in evened(batches, BLOCK):
            yield block(part.column(0).to_pylist(), part.column(1).to_pylist())

    marked = entries.groupBy(*TEXT_KEY).agg(F.array_sort(F.collect_list(F.struct("t", "y", "w", "valid"))).alias("entries"))
    rows = words.join(marked, list(TEXT_KEY)).sortWithinPartitions(F.col("entries")[0]["t"])
    return written(rows.select("words", "entries").mapInArrow(run, BLOCKS), "head-blocks")


def opened(batch):
    """Of every block of a batch: columns, dense rows, and the entries as arrays. One block is open at a time, its numbers are not copied."""
    kinds = ("<i4", "<i4", "<i4", "<f4", "<i4", "<i4", "<i4", "<f8", "u1")
    for row in range(batch.num_rows):
        raw = [batch.column(k)[row].as_buffer() for k in range(len(kinds))]
        columns, ends, places, cells, *entries = (np.frombuffer(x, kind) for x, kind in zip(raw, kinds, strict=True))
        dense = np.zeros((len(ends), len(columns)), np.float32)
        dense[np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)), places] = cells
        yield columns, dense, entries


def one_step(blocks, weights, sizes, active):
    """(gradient of all heads, per task: loss, weight, validation hits, validation rows) under these weights."""
    spark, starts = blocks.sparkSession, column_starts(sizes)
    sent = spark.sparkContext.broadcast((weights.astype(np.float32), active))
    shape, fields = weights.shape, pa.schema([("chunk", pa.int32()), ("g", pa.list_(pa.float64()))])

    def run(batches):
        w, live = sent.value
        total, told = np.zeros(shape), np.zeros((len(sizes), 4))
        for batch in batches:
            for columns, dense, (rows, tasks, classes, shares, valid) in opened(batch):
                z = dense @ w[columns] + w[-1]
                g = np.zeros(z.shape, np.float32)
                edges = np.flatnonzero(np.diff(tasks, prepend=-1, append=-1))
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    t = tasks[a]
                    if not live[t]:
                        continue
                    r, y, v = rows[a:b], classes[a:b], valid[a:b].astype(bool)
                    p = chances(z[r, starts[t] : starts[t + 1]].astype(np.float64))
                    share = np.where(v, 0.0, shares[a:b])
                    told[t] += (
                        -(share * np.log(np.maximum(p[np.arange(len(r)), y], 1e-300))).sum(),
                        share.sum(),
                        (shares[a:b] * (p.argmax(axis=1) == y))[v].sum(),
                        shares[a:b][v].sum(),
                    )
                    p[np.arange(len(r)), y] -= 1
                    np.add.at(g, (r[:, None], np.arange(starts[t], starts[t + 1])[None, :]), p * share[:, None])
                total[columns] += dense.T @ g
                total[-1] += g.sum(axis=0)
        flat = total.ravel()
        out = [(k, flat[k * CELLS : (k + 1) * CELLS]) for k in range(-(-len(flat) // CELLS))]
        out = [(-1, told.ravel()), *[(k, x) for k, x in out if x.any()]]
        for a in range(0, len(out), 64):
            names, cells = zip(*out[a : a + 64], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([x.tolist() for x in cells], fields.field("g").type)], schema=fields)

    sums = blocks.mapInArrow(run, "chunk int, g array<double>").groupBy("chunk")
    with small_batches(spark, SENT_BLOCKS):
        found = sums.agg(vector_to_array(Summarizer.sum(array_to_vector("g"))).alias("g")).toArrow()
    sent.destroy()
    flat, told = np.zeros(shape[0] * shape[1]), np.zeros((len(sizes), 4))
    for name, cells in zip(found.column("chunk").to_pylist(), found.column("g"), strict=True):
        cells = cells.values.to_numpy()
        if name < 0:
            told = cells.reshape(-1, 4)
        else:
            flat[name * CELLS : name * CELLS + len(cells)] = cells
    return flat.reshape(shape), told


def descend(blocks, sizes, decays, size, steps, rate, patience):
    """(weights, [(task number, step, accuracy)]): adaptive steps for all heads at once.

    A head with validation rows keeps the weights of its best score and stops after `patience` steps without a better one.
    """
    starts = column_starts(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    weights = np.zeros((size + 1, len(owner)))
    first, second, kept = np.zeros_like(weights), np.zeros_like(weights), weights.copy()
    decay = np.asarray(decays, float)[owner][None, :] * np.ones((size + 1, 1))
    decay[-1] = 0
    best, waited, active = np.full(len(sizes), -1.0), np.zeros(len(sizes), int), np.array(sizes) > 1
    history, scored = [], np.zeros(len(sizes), bool)
    for step in range(steps + 1):
        # without validation rows the last move needs no pass of its own
        if not active.any() or (step == steps and not scored.any()):
            break
        gradient, told = one_step(blocks, weights, sizes, active)
        scored |= told[:, 3] > 0
        if step:
            for t in np.flatnonzero(active & (told[:, 3] > 0)):
                accuracy = told[t, 2] / told[t, 3]
                history.append((int(t), step, float(accuracy)))
                if accuracy > best[t]:
                    best[t], waited[t] = accuracy, 0
                    kept[:, starts[t] : starts[t + 1]] = weights[:, starts[t] : starts[t + 1]]
                else:
                    waited[t] += 1
                    active[t] = waited[t] < patience
        if step == steps:
            break
        moving = np.repeat(active, sizes)[None, :]
        gradient /= np.maximum(told[:, 1], 1e-300)[owner][None, :]
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient * gradient
        move = first / (1 - 0.9 ** (step + 1)) / (np.sqrt(second / (1 - 0.99 ** (step + 1))) + 1e-8)
        weights = weights - np.where(moving, rate * (move + decay * weights), 0.0)
    for t in np.flatnonzero(~scored):
        kept[:, starts[t] : starts[t + 1]] = weights[:, starts[t] : starts[t + 1]]
    return kept, history


def groups_of(sizes, size):
    """Ranges of tasks whose weights fit `HEAD_BYTES` together, one task at least."""
    first, held = 0, 0
    for k, n in enumerate(sizes):
        if held and (held + n) * (size + 1) * 8 > HEAD_BYTES:
            yield first, k
            first, held = k, 0
        held += n
    if first < len(sizes):
        yield first, len(sizes)


def fit_heads(rows, words, features, listed, decays, steps=30, rate=0.5, patience=5):
    """Heads of all tasks of `listed`, [(task, [(class value, class weight), ...]), ...].

    `rows` has task, value, `valid` and the text keys. The same task may be listed several times under a name (task, something):
    its rows then train each of these heads, with its own decay.
    """
    spark = rows.sparkSession
    ship(spark)
    weights, history = [], []
    sizes = [len(classes) for _, classes in listed]
    value_type = rows.schema["value"].dataType.simpleString()
    schema = f"task {rows.schema['task'].dataType.simpleString()}, value {value_type}, t int, y int, weight double"
    counted = rows.groupBy(*TEXT_KEY, "task", "value", "valid").agg(F.count(F.lit(1)).alias("n"))
    for a, b in groups_of(sizes, features.size):
        own = [(task[0] if isinstance(task, tuple) else task, v, t, y, w) for t, (task, classes) in enumerate(listed[a:b]) for y, (v, w) in enumerate(classes)]
        entries = counted.join(spark.createDataFrame(own, schema), ["task", "value"])
        entries = entries.select(*TEXT_KEY, "t", "y", (F.col("n") * F.when(F.col("valid"), 1.0).otherwise(F.col("weight"))).alias("w"), "valid")
        blocks = blocks_of(words, entries, features)
        found, told = descend(blocks, sizes[a:b], decays[a:b], features.size, steps, rate, patience)
        weights.append(found)
        history += [(listed[a + t][0], step, accuracy) for t, step, accuracy in told]
    whole = np.concatenate(weights, axis=1) if weights else np.zeros((features.size + 1, 0))
    return Heads([(task, [v for v, _ in classes]) for task, classes in listed], whole, history)


def scorer(spark, features, heads):
    """A function of (word lists, task numbers per text) that yields (text, task number, class, chances) from weights sent once."""
    ship(spark)
    starts = column_starts([len(classes) for _, classes in heads.classes])
    sent = spark.sparkContext.broadcast(heads.weights.astype(np.float32))

    def scored(lists, wanted):
        columns, dense = features.matrix([x or [] for x in lists])
        z = dense @ sent.value[columns] + sent.value[-1]
        for k, own in enumerate(wanted):
            for t in own:
                p = chances(z[k : k + 1, starts[t] : starts[t + 1]])[0]
                yield k, t, int(p.argmax()), p.tolist()

    return scored


def apply_heads(asked, words, features, heads):
    """(_h, _g, task, idx, probs) for every distinct text and task of `asked` that has a head; a text is weighed once for all its tasks."""
    spark, tasks = asked.sparkSession, [task for task, _ in heads.classes]
    scored = scorer(spark, features, heads)
    kind = asked.schema["task"].dataType.simpleString()
    numbered = spark.createDataFrame([(task, t) for t, task in enumerate(tasks)], f"task {kind}, t int")
    wanted = asked.select(*TEXT_KEY, "task").distinct().join(numbered, "task").groupBy(*TEXT_KEY).agg(F.sort_array(F.collect_set("t")).alias("ts"))
    out = f"_h long, _g long, task {kind}, idx int, probs array<double>"
    fields = to_arrow_schema(StructType.fromDDL(out))

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK):
                h, g, lists, ts = (column.to_pylist() for column in whole.slice(start, BLOCK).columns)
                found = [(h[k], g[k], tasks[t], y, p) for k, t, y, p in scored(lists, ts)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), fields, strict=True)], schema=fields)

    return words.join(wanted, list(TEXT_KEY)).select(*TEXT_KEY, "words", "ts").mapInArrow(run, out)


def apply_to_rows(rows, features, heads, keep):
    """(keep..., task, idx, probs) for every row of (keep..., words) and every head, without a shuffle."""
    tasks = [task for task, _ in heads.classes]
    scored = scorer(rows.sparkSession, features, heads)
    schema = StructType([*rows.select(*keep).schema.fields, *StructType.fromDDL("task string, idx int, probs array<double>").fields])
    fields = to_arrow_schema(schema)

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK):
                part = whole.slice(start, BLOCK)
                found = list(scored(part.column(len(keep)).to_pylist(), [range(len(tasks))] * part.num_rows))
                if found:
                    at, t, y, p = zip(*found, strict=True)
                    own = [part.column(k).take(pa.array(at)) for k in range(len(keep))]
                    new = [pa.array([str(tasks[k]) for k in t]), pa.array(y, pa.int32()), pa.array(p, fields.field("probs").type)]
                    yield pa.RecordBatch.from_arrays([*own, *new], schema=fields)

    return rows.mapInArrow(run, schema)
