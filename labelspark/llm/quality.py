"""Quality scores from positive-unlabelled learning.

A linear model on text features minimises the non-negative risk estimate

    prior * E_positive[loss(g)] + max(0, E_unlabelled[loss(-g)] - prior * E_positive[loss(-g)])

over trusted positives and unlabelled web text, with the logistic loss, so sigmoid(g) estimates the chance that a text is good. All documents
of the training folds are the unlabelled text, their labels unseen, so it has the mixture the prior speaks of even if every document has a
label. Where the second part falls below zero, the step goes against it alone. Negative labels only serve the estimate of the class prior: the share of
positives among the labelled rows of the training folds.

The fit uses a bounded sample: `POSITIVES` and `UNLABELLED` documents, those whose id hashes lowest. Of rows with one id it takes one. Every
document is scored, whole.

A null text is the empty text, whose features are all zero. Null or repeated labels: only rows with a label count, each once. Without a
positive document nothing is learned: the score is the prior (0.5 without labels), and `drop_poor` keeps all rows. Columns besides id and text are not read.
"""

import functools
import zlib

import numpy as np
import regex
from pyspark.sql import functions as F

from labelspark.llm import shared

POSITIVES, UNLABELLED = 4000, 8000
SHAPES, WORDS, PLAIN = 128, 256, 13
SIZE = SHAPES + WORDS + PLAIN
RUNS = regex.compile(r"(.)\1+")


class Marks(dict):
    """Code point -> its mark: letters as a or A, digits as 9, anything else as it is."""

    def __missing__(self, point):
        c = chr(point)
        self[point] = "9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
        return self[point]


MARKS = Marks()


def shape(word):
    """The word in marks; runs are written once."""
    return RUNS.sub(r"\1", word.translate(MARKS))


class Codes(dict):
    """word -> shape bucket, word bucket and length; forgotten as a whole beyond `keep`."""

    def __init__(self, keep=120_000):
        self.keep = keep

    def __missing__(self, word):
        if len(self) > self.keep:
            self.clear()
        found = zlib.crc32(word.lower().encode("utf-8", "surrogatepass"))
        code = zlib.crc32(shape(word[:64]).encode("utf-8", "surrogatepass")) % SHAPES | (found % WORDS) << 8 | min(len(word), 63) << 20
        self[word] = code | (found >> 8) << 32
        return self[word]


@functools.lru_cache(maxsize=1)
def codes():
    return Codes()


def features(texts):
    """One row of `SIZE` numbers per text: shares of word shapes and hashed words, and a few plain figures."""
    out = np.zeros((len(texts), SIZE), dtype=np.float32)
    get = codes().__getitem__
    for k, text in enumerate(texts):
        words = text.split()
        if not words:
            continue
        row = np.fromiter(map(get, words), dtype=np.int64, count=len(words))
        n, low = len(words), row & 0xFFFFFFFF
        out[k, :SHAPES] = np.sqrt(np.bincount(low & 0xFF, minlength=SHAPES)[:SHAPES] / n)
        out[k, SHAPES : SHAPES + WORDS] = np.sqrt(np.bincount((low >> 8) & 0xFFF, minlength=WORDS)[:WORDS] / n)
        lines = text.count("\n") + 1
        out[k, -PLAIN:] = (
            np.log1p(n) / 8,
            np.mean(low >> 20) / 10,
            len(np.unique(row)) / n,
            same := np.mean(row[1:] == row[:-1]) if n > 1 else 0,
            min(1, 5 * same),
            np.log1p(n / lines) / 6,
            len(set(text.split("\n"))) / lines,
            min(1, text.count("|") / n),
            min(1, text.count("!") / n),
            min(1, text.count(".") / n),
            min(1, sum(map(str.isupper, words)) / n),
            min(1, text.count("http") / n),
            1,
        )
    return out


def scaled_with_one(x, scale):
    """Scaled features and a column of ones, made in place: this is the driver's memory."""
    out = np.ones((len(x), x.shape[1] + 1))
    np.multiply(x, scale, out=out[:, :-1])
    return out


def fit(positive, unlabelled, prior, steps=4000, rate=0.01, l2=1e-5, seed=7):
    """Weights and bias of the non-negative risk minimiser, by Adam on batches of scaled features."""
    rng = np.random.default_rng(seed)
    scale = 1 / (unlabelled.std(axis=0).astype(np.float64) + 0.02)
    positive, unlabelled = scaled_with_one(positive, scale), scaled_with_one(unlabelled, scale)
    weights, first, second = np.zeros(positive.shape[1]), 0.0, 0.0
    weights[-1] = np.log(prior / (1 - prior))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    mean = np.zeros_like(weights)
    for step in range(1, steps + 1):
        p = positive[rng.integers(0, len(positive), 512)]
        u = unlabelled[rng.integers(0, len(unlabelled), 1024)]
        gp, gu = p @ weights, u @ weights
        up = -(sigmoid(-gp) @ p) / len(p) * prior
        down = (sigmoid(gu) @ u) / len(u) - (sigmoid(gp) @ p) / len(p) * prior
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        gradient = (up + down if negative >= 0 else -down) + l2 * np.append(weights[:-1], 0)
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        pace = rate * min(1, 2 * (1 - step / (steps + 1)))
        weights = weights - pace * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        if step > steps // 2:
            mean += weights / (steps - steps // 2)
    return np.append(mean[:-1] * scale, mean[-1])


def sample(docs, chosen, id_col, text_col):
    """Features of the chosen documents, at most POSITIVES or UNLABELLED rows."""
    rows = docs.select(F.col(id_col).alias("doc_id"), shared.text_or_empty(text_col).alias("text")).join(F.broadcast(chosen), "doc_id", "left_semi")

    def run(columns):
        return {"doc_id": columns["doc_id"], "x": [row.astype(np.float16).tobytes() for row in features(columns["text"])]}

    found = rows.mapInArrow(shared.per_batch(run, "doc_id long, x binary"), "doc_id long, x binary")
    got = found.groupBy("doc_id").agg(F.min("x").alias("x")).collect()
    got.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))
    return np.array([np.frombuffer(bytes(r["x"]), dtype=np.float16) for r in got], dtype=np.float32).reshape(-1, SIZE)


def train(docs, labels, folds=5, held_out=0, label="quality", id_col="doc_id", text_col="text"):
    """(weights, prior) from documents and labels outside the held-out fold."""
    shared.ship(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(label).alias("label"))
    known = known.where(shared.buckets_of("doc_id", folds) != held_out).groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = known.agg(F.count("*").alias("n"), F.sum(F.expr("int(label = 1)")).alias("good")).first()
    if not counts["n"] or not counts["good"]:
        return None, 0.5 if not counts["n"] else 1 / (counts["n"] + 2)
    prior = float(np.clip(counts["good"] / counts["n"], 0.01, 0.99))
    first = lambda df, n: df.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    free = docs.select(F.col(id_col).alias("doc_id")).where(F.col("doc_id").isNotNull() & (shared.buckets_of("doc_id", folds) != held_out))
    positive = sample(docs, first(known.where("label = 1"), POSITIVES), id_col, text_col)
    unlabelled = sample(docs, first(free.distinct(), UNLABELLED), id_col, text_col)
    if not len(positive) or not len(unlabelled):
        return None, prior
    return fit(positive, unlabelled, prior), prior


def score(docs, model, folds=5, held_out=0, threshold=0.3, id_col="doc_id", text_col="text"):
    """(doc_id, held_out, score, predicted) of every document."""
    shared.ship(docs.sparkSession)
    weights, prior = model

    def run(columns):
        got = []
        for a, b in shared.slices(columns["text"], 1 << 20):
            x = features(columns["text"][a:b]).astype(np.float64)
            z = np.full(len(x), np.log(prior / (1 - prior))) if weights is None else x @ weights[:-1] + weights[-1]
            got.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return {"doc_id": columns["doc_id"], "held_out": columns["held_out"], "score": np.concatenate(got)}

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (shared.buckets_of(id_col, folds) == held_out).alias("held_out"), shared.text_or_empty(text_col).alias("text"))
    schema = "doc_id long, held_out boolean, score double"
    found = rows.mapInArrow(shared.per_batch(run, schema), schema)
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_poor(docs, labels, threshold=0.3, id_col="doc_id", text_col="text"):
    """The rows of `docs` that are not rejected, all columns. Only rejected ids are joined; all rows stay where nothing could be learned."""
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    if model[0] is None:
        return docs
    scored = score(docs, model, threshold=threshold, id_col=id_col, text_col=text_col)
    rejected = shared.stored(scored.where("predicted = 0").select(F.col("doc_id").alias("_rejected")), "rejected").distinct()
    return docs.join(rejected, docs[id_col] == rejected["_rejected"], "left_anti")
