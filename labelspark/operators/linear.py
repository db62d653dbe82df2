"""Linear heads over terms, kept as tables: learned from counts, applied by join and sum.

weights (term, task, label, weight) has a row for every term a class has shown; offsets (task, label,
bias, floor) holds the class's prior and what each term adds that the class has never shown.
Texts come as (id, terms), one array per text. An id names one text.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from labelspark.functions.columns import argmax, softmax
from labelspark.operators.lookup import beside_all
from labelspark.operators.tiers import TEXTS, in_filter, listed_terms, term_sums, tiers
from labelspark.session import ship, written

CLASSES = 100_000


def count_heads(lists, labels, id_col):
    """(weights, offsets) from add-one smoothed term shares: one head per task of `labels` (id, task, label).

    The counts are written once; applying the heads never reads the training texts again. Texts move to their labels as packed terms (`packed_terms`).
    """
    ship(lists.sparkSession)
    kinds = [labels.schema[name] for name in ("task", "label")]
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in kinds), T.StructField("term", T.StringType()), T.StructField("n", T.LongType())])
    fields = to_arrow_schema(schema)

    def counted(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(start, TEXTS)
                terms, n, sizes = unpacked_terms(batch.column(2))
                coded = terms.dictionary_encode()
                words, width = coded.dictionary, max(len(coded.dictionary), 1)
                own = np.zeros(batch.num_rows, np.int64)
                for k in range(2):
                    values = batch.column(k).dictionary_encode()
                    own = own * (len(values.dictionary) + 1) + pc.fill_null(values.indices, len(values.dictionary)).to_numpy(zero_copy_only=False)
                _, first, own = np.unique(own, return_index=True, return_inverse=True)
                cell, at = np.unique(np.repeat(own, sizes) * width + coded.indices.to_numpy(), return_inverse=True)
                total = np.rint(np.bincount(at, weights=n, minlength=len(cell))).astype(np.int64)
                row = pa.array(first[cell // width])
                columns = [batch.column(0).take(row), batch.column(1).take(row), words.take(pa.array(cell % width)), pa.array(total)]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, fields, strict=True)], schema=fields)

    texts = packed_terms(lists, id_col).join(labels, id_col).select("task", "label", "_packed")
    counts = texts.mapInArrow(counted, schema).groupBy("task", "label", "term").agg(F.sum("n").alias("n"))
    counts = written(counts, "head-counts")
    return weights_of(counts), offsets_of(counts, class_priors(labels))


def planes(*columns):
    """Bytes of whole numbers below 2^32, the lowest byte of all of them first: what is small compresses to little."""
    return np.ascontiguousarray(np.concatenate([np.asarray(x).astype("<u4") for x in columns]).view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(data, columns):
    """`columns` arrays of equal length from the bytes of `planes`."""
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").reshape(columns, -1).astype(np.int64)


def distinct_terms(column):
    """(different terms of all lists, per list and term of its own: its term's place among them, how often it has it, first of each list's; ends with all)."""
    flat, sizes = listed_terms(column)
    coded = flat.dictionary_encode()
    width = max(len(coded.dictionary), 1)
    cell, n = np.unique(np.repeat(np.arange(len(sizes)), sizes) * width + coded.indices.to_numpy(), return_counts=True)
    return coded.dictionary, cell % width, n, np.searchsorted(cell, np.arange(len(sizes) + 1) * width)


def packed_terms(lists, id_col):
    """(id, _packed): each text's different terms and how often it has them, compressed."""
    schema = T.StructType([lists.schema[id_col], T.StructField("_packed", T.BinaryType())])
    fields = to_arrow_schema(schema)

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(start, TEXTS)
                words, word, n, ends = distinct_terms(batch.column(1))
                terms = words.take(pa.array(word)).cast(pa.binary())
                length = pc.binary_length(terms).to_numpy(zero_copy_only=False)
                chars, stops = b"".join(terms.to_pylist()), np.concatenate([[0], np.cumsum(length)])
                out = []
                for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    data = planes(length[a:b], n[a:b]) + chars[stops[a] : stops[b]]
                    out.append(np.array([b - a, len(data)], "<u4").tobytes() + pa.compress(data, codec="zstd", asbytes=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(fields[0].type), pa.array(out, pa.binary())], schema=fields)

    return lists.select(id_col, "terms").mapInArrow(run, schema)


def unpacked_terms(column):
    """(terms of all texts in a row, how often their texts have them, how many terms each text has) of a column of packed terms."""
    chars, length, n, sizes = [], [], [], np.zeros(len(column), np.int64)
    for k, data in enumerate(column.to_pylist()):
        sizes[k], size = np.frombuffer(data, "<u4", 2).tolist()
        data = pa.decompress(memoryview(data)[8:], size, codec="zstd", asbytes=True)
        own = from_planes(data[: 8 * sizes[k]], 2)
        length.append(own[0])
        n.append(own[1])
        chars.append(data[8 * sizes[k] :])
    length, n = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (length, n))
    offsets = pa.py_buffer(np.concatenate([[0], np.cumsum(length)]).astype(np.int64))
    return pa.Array.from_buffers(pa.large_string(), len(length), [None, offsets, pa.py_buffer(b"".join(chars))]), n, sizes


def class_priors(labels):
    sizes = labels.groupBy("task", "label").agg(F.count(F.lit(1)).alias("_n"))
    share = F.col("_n") / F.sum("_n").over(W.partitionBy("task"))
    return sizes.select("task", "label", F.ln(share).alias("bias"))


def weights_of(counts):
    return counts.select("term", "task", "label", F.ln(F.col("n") + 1).alias("weight"))


def offsets_of(counts, priors):
    known = counts.select("task", "term").distinct().groupBy("task").agg(F.count(F.lit(1)).alias("_v"))
    sums = counts.groupBy("task", "label").agg(F.sum("n").alias("_t"))
    joined = priors.join(sums, ["task", "label"], "left").join(known, "task")
    floor = -F.ln(F.coalesce("_t", F.lit(0)) + F.col("_v"))
    return joined.select("task", "label", "bias", floor.alias("floor"))


def numbered_classes(offsets):
    """Rows of the classes of all tasks in order of task and label; a class's place is its number. At most `CLASSES` come to the driver."""
    rows = offsets.select("task", "label", "bias", "floor").orderBy("task", "label").limit(CLASSES + 1).collect()
    if len(rows) > CLASSES:
        raise ValueError(f"more than {CLASSES} classes")
    return rows


def class_tiers(weights, offsets, classes):
    """((_t, _l, idx): task and label of every numbered class, tiers of the weights by these numbers)"""
    kind = offsets.select("task", "label").schema
    schema = T.StructType([T.StructField("_t", kind["task"].dataType), T.StructField("_l", kind["label"].dataType), T.StructField("idx", T.IntegerType())])
    own = F.broadcast(weights.sparkSession.createDataFrame([(c["task"], c["label"], k) for k, c in enumerate(classes)], schema))
    placed = weights.join(own, (F.col("task") == F.col("_t")) & F.col("label").eqNullSafe(F.col("_l")))
    return own, tiers(placed.select("term", "idx", "weight"), len(classes))


def logits(lists, weights, offsets, id_col, column="terms", terms_of=listed_terms):
    """(id, n_terms, task, labels, logits) for every text and task, classes in label order.

    The sums over a text's terms are made inside its row for the frequent terms and joined in for the rare ones (`operators.tiers`).
    """
    classes = numbered_classes(offsets)
    spark = lists.sparkSession
    kind = offsets.select("task", "label").schema
    sums = term_sums(lists, class_tiers(weights, offsets, classes)[1], id_col, column, terms_of)
    head = T.StructType([*T.StructType.fromDDL("idx int, bias double, floor double").fields, T.StructField("label", kind["label"].dataType)])
    heads = {}
    for k, c in enumerate(classes):
        heads.setdefault(c["task"], []).append((k, c["bias"], c["floor"], c["label"]))
    tasks = spark.createDataFrame(list(heads.items()), T.StructType([T.StructField("task", kind["task"].dataType), T.StructField("heads", T.ArrayType(head))]))
    pairs = beside_all(sums, tasks, "_t")
    return pairs.select(
        id_col,
        "n_terms",
        F.col("_t.task").alias("task"),
        F.transform("_t.heads", lambda h: h["label"]).alias("labels"),
        F.transform("_t.heads", lambda h: h["bias"] + F.get("sums", h["idx"]) + F.col("n_terms") * h["floor"]).alias("logits"),
    )


def predict(lists, weights, offsets, id_col, task=None):
    """(id, task, labels, probs, predicted) for all tasks, or for one; the first largest class is predicted."""
    if task is not None:
        weights, offsets = weights.where(F.col("task") == task), offsets.where(F.col("task") == task)
    scored = logits(lists, weights, offsets, id_col)
    return scored.select(
        id_col,
        "task",
        "labels",
        softmax(F.col("logits")).alias("probs"),
        F.col("labels")[argmax(F.col("logits"))].alias("predicted"),
    )


PART = "array<struct<idx:int,term:string,a:double>>"
MORE = "array<struct<term:string,n:int,entries:array<struct<idx:int,weight:double>>>>"


def pulls_of(weights, floors, group):
    """terms x classes: what one occurrence of a term adds to the class beyond the mean class of its task; not a number where no class of the task shows it."""
    pulls = np.full(weights.shape, np.nan)
    for g in np.unique(group):
        own = np.flatnonzero(group == g)
        total = weights[:, own].sum(axis=1, keepdims=True)
        pulls[:, own] = np.where(total > 0, weights[:, own] - total / len(own) + (floors[own] - floors[own].mean()), np.nan)
    return pulls


def ranges(first, size):
    """The numbers from each `first`, as many as its `size`, in a row."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - first, size)


def lists_of(sizes, values):
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def term_parts(lists, predicted, weights, offsets, id_col):
    """(id, task, parts): per text and task an array of (predicted, term, attribution), one for every term that the task's classes have shown.

    A text's terms are counted where the text lies; the counts of those whose weights are sent (`operators.tiers`) move once, as numbers, to meet the
    winning classes by id and are weighed inside the row. Only terms whose weights are not sent are joined, a row each, and come back with their weights
    before anything is weighed: the parts never move.
    """
    spark = lists.sparkSession
    ship(spark)
    classes = numbered_classes(offsets)
    numbers, found = class_tiers(weights, offsets, classes)
    # classes of a task lie together
    group = np.cumsum([k > 0 and c["task"] != classes[k - 1]["task"] for k, c in enumerate(classes)], dtype=np.int32)
    floors = np.array([c["floor"] for c in classes])
    sent = spark.sparkContext.broadcast((found.terms, pulls_of(found.weights, floors, group), found.bits))
    won = predicted.select(id_col, F.col("task").alias("_task"), F.col("predicted").alias("_won"))
    won = won.join(numbers, (F.col("_task") == F.col("_t")) & F.col("_won").eqNullSafe(F.col("_l")))
    won = won.groupBy(id_col).agg(F.sort_array(F.collect_set("idx")).alias("_w"))
    texts = coded_terms(lists.where(F.col(id_col).isNotNull()), sent, id_col)
    if found.rare is None:
        more = None
    else:
        texts = written(texts, "term-codes")
        more = texts.select(id_col, F.explode("_rest").alias("_x")).select(id_col, "_x.*").join(found.rare, "term")
        more = more.groupBy(id_col).agg(F.collect_list(F.struct("term", "n", "entries")).alias("_more"))
    texts = texts.groupBy(id_col).agg(F.collect_list("_codes").alias("_codes")).join(won, id_col)
    texts = texts.withColumn("_more", F.lit(None).cast(MORE)) if more is None else texts.join(more, id_col, "left")
    texts = texts.select(id_col, "_w", "_codes", "_more")
    schema = T.StructType([texts.schema[id_col], *T.StructType.fromDDL(f"_g int, _parts {PART}").fields])
    fields = to_arrow_schema(schema)

    def weighed(batch):
        known, pulls, _ = sent.value
        text, place, n = decoded_terms(batch.column(2))
        # rare terms have the numbers after the known ones
        listed, first = batch.column(3), len(known)
        sizes = pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False)
        flat = listed.flatten()
        coded = flat.field("term").dictionary_encode()
        words, entries = coded.dictionary, flat.field("entries")
        number = coded.indices.to_numpy()
        table = np.zeros((len(words), len(floors)))
        held = entries.flatten()
        table[np.repeat(number, pc.list_value_length(entries).to_numpy(zero_copy_only=False)), held.field("idx").to_numpy()] = held.field("weight").to_numpy()
        table = pulls_of(table, floors, group)
        text, place, n = (np.concatenate(x) for x in ((text, np.repeat(np.arange(len(sizes)), sizes)), (place, number + first), (n, flat.field("n").to_numpy())))
        # one cell per text and different term
        used, word = np.unique(place, return_inverse=True)
        words = pa.concat_arrays([known.take(pa.array(used[used < first])), words.cast(known.type).take(pa.array(used[used >= first] - first))])
        of_word = np.concatenate([pulls[used[used < first]], table[used[used >= first] - first]])
        width = max(len(used), 1)
        cell, at = np.unique(text * width + word, return_inverse=True)
        n = np.bincount(at, weights=n, minlength=len(cell))
        word, ends = cell % width, np.searchsorted(cell, np.arange(len(sizes) + 1) * width)
        # a row per text and task, with its winning classes
        winners, text = batch.column(1).flatten().to_numpy(), np.repeat(np.arange(len(sizes)), pc.list_value_length(batch.column(1)).to_numpy())
        new = np.ones(len(text), dtype=bool)
        new[1:] = (text[1:] != text[:-1]) | (group[winners[1:]] != group[winners[:-1]])
        out, line = np.flatnonzero(new), np.cumsum(new) - 1
        per = ends[text + 1] - ends[text]
        at, idx, line = ranges(ends[text], per), np.repeat(winners, per), np.repeat(line, per)
        a = n[at] * of_word[word[at], idx]
        shown = ~np.isnan(a)
        parts = [pa.array(idx[shown], pa.int32()), words.take(pa.array(word[at[shown]])), pa.array(a[shown])]
        return [
            batch.column(0).take(pa.array(text[out])),
            pa.array(group[winners[out]], pa.int32()),
            lists_of(np.bincount(line[shown], minlength=len(out)), pa.StructArray.from_arrays(parts, names=["idx", "term", "a"])),
        ]

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, TEXTS):
                columns = weighed(whole.slice(start, TEXTS))
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, fields, strict=True)], schema=fields)

    rows = texts.mapInArrow(run, schema)
    kind = offsets.select("task", "label").schema
    head = [T.StructField("_of", T.IntegerType()), T.StructField("task", kind["task"].dataType), T.StructField("_first", T.IntegerType())]
    tasks = [(g, classes[own[0]]["task"], own[0], [classes[k]["label"] for k in own]) for g in np.unique(group).tolist() for own in [np.flatnonzero(group == g).tolist()]]
    tasks = spark.createDataFrame(tasks, T.StructType([*head, T.StructField("_labels", T.ArrayType(kind["label"].dataType))]))
    rows = rows.where(F.size("_parts") > 0).join(F.broadcast(tasks), F.col("_g") == F.col("_of"))
    # the norm is an argument, not part of the function: it is taken once per row
    norm = F.sqrt(F.aggregate("_parts", F.lit(0.0), lambda s, p: s + p["a"] * p["a"]))
    label = lambda p: F.get("_labels", p["idx"] - F.col("_first"))
    share = lambda p, n: F.coalesce(F.try_divide(p["a"], n), F.lit(0.0))
    parts = F.zip_with(
        "_parts", F.array_repeat(norm, F.size("_parts")), lambda p, n: F.struct(label(p).alias("predicted"), p["term"].alias("term"), share(p, n).alias("attribution"))
    )
    return rows.select(id_col, "task", parts.alias("parts"))


def coded_terms(lists, sent, id_col):
    """(id, _codes, _rest): the numbers of a text's different known terms with their counts as bytes, and the terms that may be rare with theirs.

    `sent`: known terms, anything, bits of the rare terms' filter. All other terms have no weight.
    """
    rows = lists.select(id_col, "terms")
    schema = T.StructType([rows.schema[id_col], *T.StructType.fromDDL("_codes binary, _rest array<struct<term:string,n:int>>").fields])
    fields = to_arrow_schema(schema)

    def coded(batch):
        known, _, bits = sent.value
        words, word, n, ends = distinct_terms(batch.column(1))
        place = pc.fill_null(pc.index_in(words, value_set=known), len(known)).to_numpy(zero_copy_only=False)
        rare = ((place == len(known)) & in_filter(words, bits))[word] if len(words) else np.zeros(0, dtype=bool)
        place = place[word]
        codes = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            order = np.argsort(place[a:b])
            order = order[: np.searchsorted(place[a:b][order], len(known))]
            codes.append(planes(np.diff(place[a:b][order], prepend=0), n[a:b][order]))
        text = np.repeat(np.arange(batch.num_rows), np.diff(ends))
        rest = pa.StructArray.from_arrays([words.take(pa.array(word[rare])), pa.array(n[rare], pa.int32())], names=["term", "n"])
        return [batch.column(0), pa.array(codes, pa.binary()), lists_of(np.bincount(text[rare], minlength=batch.num_rows), rest)]

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, TEXTS):
                columns = coded(whole.slice(start, TEXTS))
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, fields, strict=True)], schema=fields)

    return rows.mapInArrow(run, schema)


def decoded_terms(column):
    """(text, number of a known term, count) of a column of lists of `_codes`."""
    text, place, n = [], [], []
    for k, codes in enumerate(column.to_pylist()):
        for data in codes:
            own = from_planes(data, 2)
            text.append(np.full(own.shape[1], k))
            place.append(np.cumsum(own[0]))
            n.append(own[1])
    return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in (text, place, n))


def attribute_tokens(lists, predicted, weights, offsets, id_col):
    """(id, task, predicted, term, attribution): the term's part in the winning class, over the L2 norm of the text's parts."""
    parts = term_parts(lists, predicted, weights, offsets, id_col)
    return parts.select(id_col, "task", F.explode("parts").alias("_p")).select(id_col, "task", "_p.*")


def top_terms(parts, id_col, k, digits=9):
    """The k terms of `term_parts` that speak most for the winning class of each text and task, ranked inside the row; equal to `digits` digits, the first term."""
    less = lambda p: (-F.round(p["attribution"], digits)).alias("_less")
    ordered = F.array_sort(F.transform("parts", lambda p: F.struct(less(p), p["term"].alias("term"), p["predicted"].alias("predicted"), p["attribution"].alias("attribution"))))
    rows = parts.select(id_col, "task", F.posexplode(F.slice(ordered, 1, k)).alias("_k", "_p"))
    return rows.select(id_col, "task", "_p.predicted", "_p.term", "_p.attribution", (F.col("_k") + 1).alias("rank"))
