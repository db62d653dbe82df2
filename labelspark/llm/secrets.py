"""Secrets in text: three base patterns, and a linear-chain conditional random field that adds spans of its own.

The field tags tokens as B (a secret begins), I (inside) or O (outside). A token's score is a sum over its own shape features, its neighbours'
words and shapes, and a feature of the whole text; tag pairs add theirs. It is trained on windows round base matches and on plain windows of a
bounded sample of documents (`TRAIN_DOCS`), by gradient steps on the exact log-likelihood, and decoded by Viterbi.

Decoding looks at every token. A token whose O score beats B and I by more than its two tag pairs could ever make up is O on the best
path whatever stands beside it, so the chain is cut there and Viterbi runs on the short stretches between; the result is that of the whole chain.

Null and empty texts have no span. Equal texts have equal spans. Overlaps: base spans of different kinds may overlap, spans of the field that touch
a base span are left out. With no match in the sample the field adds nothing. Columns besides id and text are not read.
"""

import functools
import hashlib
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from labelspark.llm import shared

#: The base patterns and the least length of each one's secret part.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run shorter than 24 is no match, so the runs need not be listed first
KINDS = ("assign", "access", "hex")
WORDS_OF_ASSIGN = ("passw", "secret", "token", "api")

TRAIN_DOCS, WINDOW, EPOCHS = 800, 12, 50
TOKEN = re.compile(r"\w+|[^\w\s]|\n")
SELF, NEAR = 256, 512
TAGS = 3  # O, B, I


def base_spans(text):
    """[(start, kind, end)] in code points, by start, then by kind as listed."""
    found, lower = [], text.lower()
    if any(word in lower for word in WORDS_OF_ASSIGN):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Marks(dict):
    """Code point -> 9 for digits, A and a for letters, itself otherwise."""

    def __missing__(self, point):
        c = chr(point)
        self[point] = "9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
        return self[point]


MARKS = Marks()


def row_of(name, size):
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % size


@functools.lru_cache(maxsize=1 << 14)
def shape_rows(length, plain, changes, variety):
    names = (f"l{length}", f"k{plain}", f"c{changes}", f"v{variety}", f"lk{length}{plain}", f"ck{changes}{plain}", "one")
    return [row_of(x, SELF) for x in names]


def shape_of(token):
    """Length class, kinds of characters, changes between kinds, variety."""
    n = len(token)
    length, variety = min(n, 8) if n < 8 else 8 + min(7, n // 6), min(len(set(token)), 16)
    if token.isalpha() and token.islower():
        return length, (False, False, True, not token.strip("abcdef")), 0, variety
    marks = token.translate(MARKS)
    digits, upper = marks.count("9"), marks.count("A")
    plain = (digits > 0, upper > 0, upper + marks.count("a") > digits, not token.strip("0123456789abcdef"))
    return length, plain, min(sum(a != b for a, b in zip(marks[:40], marks[1:40], strict=False)), 12), variety


def own_features(token):
    """Hashed shape features of a token, and its word if it is short and without digits."""
    key = shape_of(token)
    return [*shape_rows(*key), row_of(f"w{token.lower()}" if len(token) < 16 and not key[1][0] else "w", SELF)]


def near_features(token):
    """Hashed features a token gives its neighbours: its word, and whether it holds digits."""
    word = token.lower()[:24]
    return [zlib.crc32(f"n{word}".encode("utf-8", "surrogatepass")) % NEAR, int(any(c.isdigit() for c in token))]


PLACES = (-3, -2, -1, 1, 2)  # neighbours looked at
ROWS = SELF + NEAR * len(PLACES) + 4  # and four classes of texts


def file_class(text):
    """0 to 3: how much of the text looks like settings or code."""
    marks = text.count("=") + text.count('"') + text.count(":")
    return min(3, int(np.log2(1 + 400 * marks / (len(text) + 200))))


def token_rows(tokens, text_class):
    """Weight rows per token, for training."""
    own, near = [own_features(t) for t in tokens], [near_features(t) for t in tokens]
    rows = []
    for k in range(len(tokens)):
        row = own[k] + [SELF + NEAR * len(PLACES) + text_class]
        for j, place in enumerate(PLACES):
            if 0 <= k + place < len(tokens):
                row += [SELF + NEAR * j + x for x in near[k + place]]
        rows.append(row)
    return rows


def tagged(text, spans):
    """(tokens, tags, starts): silver tags from base spans, of an assignment its value alone."""
    secret = []
    for start, kind, end in spans:
        m = ASSIGN.match(text, start) if kind == 0 else None
        secret.append((m.start(2), m.end(2)) if m else (start, end))
    tokens, tags, starts, k = [], [], [], 0
    secret.sort()
    inside = -1
    for m in TOKEN.finditer(text):
        while k < len(secret) and secret[k][1] <= m.start():
            k += 1
        hit = k < len(secret) and secret[k][0] <= m.start()
        tags.append(0 if not hit else 2 if inside == k else 1)
        inside = k if hit else -1
        tokens.append(m[0])
        starts.append(m.start())
    return tokens, tags, starts


def windows(text):
    """Training windows of a text: round the first eight silver tags, at both ends, and two between."""
    spans = base_spans(text)
    tokens, tags, _ = tagged(text, spans)
    n = len(tokens)
    centres = [k for k, tag in enumerate(tags) if tag == 1][:8] + ([0, n // 4, n // 2, n - 1] if n else [])
    out = []
    for c in centres:
        a, b = max(0, c - WINDOW), min(len(tokens), c + WINDOW + 1)
        out.append((tokens[a:b], tags[a:b], file_class(text)))
    return out


def fit(examples, epochs=EPOCHS, rate=0.1, l2=1e-3):
    """(emission weights ROWS x 3, tag pairs 3 x 3) that maximise the likelihood, by Adam on all windows.

    Chances forward and backward along the windows are scaled to one at each token; memory goes with the number of tokens.
    """
    examples = [x for x in examples if x[0]]
    n, steps = len(examples), 2 * WINDOW + 1
    features = [token_rows(tokens, cls) for tokens, _, cls in examples]
    widest = max(len(r) for rows in features for r in rows)
    ids = np.full((widest, n, steps), ROWS, dtype=np.int32)
    tags, mask = np.zeros((n, steps), dtype=np.int64), np.zeros((n, steps), dtype=bool)
    for k, (rows, (_, tag, _)) in enumerate(zip(features, examples, strict=True)):
        for t, row in enumerate(rows):
            ids[: len(row), k, t] = row
        tags[k, : len(tag)] = tag
        mask[k, : len(tag)] = True
    weights, pairs = np.zeros((ROWS + 1, TAGS)), np.zeros((TAGS, TAGS))
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(pairs), np.zeros_like(pairs)]
    gold = np.eye(TAGS)[tags] * mask[..., None]
    both = (mask[:, 1:] & mask[:, :-1]).astype(float)
    gold_pairs = np.einsum("nta,ntb,nt->ab", gold[:, :-1], gold[:, 1:], both)
    for epoch in range(1, epochs + 1):
        emission = np.zeros((n, steps, TAGS))
        for k in range(widest):
            emission += weights[ids[k]]
        local = np.exp(emission - emission.max(axis=2, keepdims=True))
        step, forward, backward, scale = np.exp(pairs), np.zeros((n, steps, TAGS)), np.ones((n, steps, TAGS)), np.ones((n, steps))
        for t in range(steps):
            here = local[:, t] if t == 0 else (forward[:, t - 1] @ step) * local[:, t]
            live = mask[:, t]
            scale[live, t] = here[live].sum(axis=1)
            forward[:, t] = np.where(live[:, None], here / scale[:, t, None], forward[:, t - 1] if t else 1 / TAGS)
        for t in range(steps - 2, -1, -1):
            there = ((local[:, t + 1] * backward[:, t + 1]) @ step.T) / scale[:, t + 1, None]
            backward[:, t] = np.where(mask[:, t + 1, None], there, 1.0)
        unary = forward * backward
        unary *= mask[..., None] / unary.sum(axis=2, keepdims=True)
        right = local[:, 1:] * backward[:, 1:] * (both / scale[:, 1:])[..., None]
        pair_gradient = gold_pairs - np.einsum("nta,ab,ntb->ab", forward[:, :-1], step, right)
        gap, gradient = (gold - unary).reshape(-1, TAGS), np.zeros((ROWS + 1, TAGS))
        for k in range(widest):
            flat = ids[k].reshape(-1)
            for tag in range(TAGS):
                gradient[:, tag] += np.bincount(flat, weights=gap[:, tag], minlength=ROWS + 1)
        for k, (value, grad) in enumerate(((weights, gradient / n), (pairs, pair_gradient / n))):
            grad = grad - l2 * value
            moments[2 * k] = 0.9 * moments[2 * k] + 0.1 * grad
            moments[2 * k + 1] = 0.999 * moments[2 * k + 1] + 0.001 * grad**2
            value += rate * (moments[2 * k] / (1 - 0.9**epoch)) / (np.sqrt(moments[2 * k + 1] / (1 - 0.999**epoch)) + 1e-8)
        weights[ROWS] = 0
    return weights[:ROWS].astype(np.float32), pairs.astype(np.float32)


def train(docs, id_col="doc_id", text_col="text", sample=TRAIN_DOCS):
    """The field from silver tags of at most `sample` documents with a likely match and as many others; None without a match."""
    shared.ship(docs.sparkSession)
    text = shared.text_or_empty(text_col)
    likely = text.rlike(r"(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}")
    ids = docs.select(F.col(id_col).alias("doc_id"), likely.alias("likely")).where(F.col("doc_id").isNotNull())
    first = lambda rows: rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id")
    chosen = F.broadcast(first(ids.where("likely")).union(first(ids.where("not likely"))))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).join(chosen, "doc_id", "left_semi")
    schema = "doc_id long, no int, tokens array<string>, tags array<int>, class int"

    def run(columns):
        out = {"doc_id": [], "no": [], "tokens": [], "tags": [], "class": []}
        for doc, value in zip(columns["doc_id"], columns["text"], strict=True):
            for no, (tokens, tags, cls) in enumerate(windows(value)):
                for name, x in zip(out, (doc, no, [t[:64] for t in tokens], tags, cls), strict=True):
                    out[name].append(x)
        return out

    got = sorted(rows.mapInArrow(shared.per_batch(run, schema), schema).collect(), key=lambda r: (r["doc_id"], r["no"], r["tokens"]))
    examples = [(r["tokens"], r["tags"], r["class"]) for r in got]
    return fit(examples) if any(1 in tags for _, tags, _ in examples) else None


def margin(rows):
    """How far O lies above the better of B and I."""
    return rows[..., 0] - rows[..., 1:].max(axis=-1)


class Types(dict):
    """Token -> its number, with the lead of O from its own features and the rows it gives its neighbours.

    Leads add up to a bound: O's lead in a sum is at least the sum of its leads.
    """

    def __init__(self, weights, keep=200_000):
        self.weights, self.keep, self.shapes = weights, keep, {}
        self.own = np.zeros(keep + 1, dtype=np.float32)
        self.row, self.digit = np.zeros(keep + 1, dtype=np.int16), np.zeros(keep + 1, dtype=np.int8)
        self.near = margin(weights[SELF : SELF + NEAR * len(PLACES)].reshape(len(PLACES), NEAR, TAGS))
        self.of_text = margin(weights[-4:])

    def __missing__(self, token):
        k, key = len(self), shape_of(token)
        if key not in self.shapes:
            self.shapes[key] = self.weights[shape_rows(*key)].sum(axis=0)
        o, b, i = (self.shapes[key] + self.weights[row_of(f"w{token.lower()}" if len(token) < 16 and not key[1][0] else "w", SELF)]).tolist()
        self.own[k] = o - max(b, i)
        self.row[k], self.digit[k] = near_features(token)
        self[token] = k
        return k

    def doubtful(self, numbers, text_class, slack):
        """Places whose token O does not lead for certain by more than `slack`."""
        n = len(numbers)
        least = self.near.min(axis=1) + np.minimum(self.near[:, 0], self.near[:, 1])
        lead = self.own[numbers] + self.of_text[text_class]
        places = np.flatnonzero(lead + np.minimum(least, 0).sum() <= slack)
        total = lead[places]
        for j, place in enumerate(PLACES):
            at = places + place
            beside = numbers[np.clip(at, 0, n - 1)]
            total += np.where((at >= 0) & (at < n), self.near[j][self.row[beside]] + self.near[j][self.digit[beside]], 0)
        return places[total <= slack]


def slack_of(pairs):
    """What B or I can at most gain over O from the pairs on both sides of a token."""
    into = np.maximum((pairs[:, 1:] - pairs[:, :1]).max(axis=0), 0)
    out_of = np.maximum((pairs[1:] - pairs[:1]).max(axis=1), 0)
    return float((into + out_of).max())


@functools.lru_cache(maxsize=1)
def types_of(key, model):
    return Types(np.frombuffer(model, dtype=np.float32).reshape(ROWS, TAGS))


def viterbi(emission, pairs, before, after):
    """Best tags of a stretch between two tokens (or ends) that are O; `before`, `after`: whether there is such a token."""
    score = emission[0] + (pairs[0] if before else 0)
    back = []
    for row in emission[1:]:
        step = score[:, None] + pairs
        back.append(step.argmax(axis=0))
        score = step.max(axis=0) + row
    if after:
        score = score + pairs[:, 0]
    tags = [int(score.argmax())]
    for step in reversed(back):
        tags.append(int(step[tags[-1]]))
    return tags[::-1]


@functools.lru_cache(maxsize=1 << 16)
def near_rows(token):
    return near_features(token)


def emission(tokens, k, weights, text_class):
    """Scores of the tags at the k-th token."""
    rows = [*own_features(tokens[k]), SELF + NEAR * len(PLACES) + text_class]
    for j, place in enumerate(PLACES):
        if 0 <= k + place < len(tokens):
            rows += [SELF + NEAR * j + x for x in near_rows(tokens[k + place])]
    return weights[rows].sum(axis=0)


def decode(text, types, pairs):
    """[(start, end)] of the field's secrets."""
    tokens = TOKEN.findall(text)
    if not tokens:
        return []
    if len(types) + len(tokens) > types.keep:
        types.clear()
        if len(tokens) > types.keep:
            types = Types(types.weights, keep=len(tokens))
    numbers = np.fromiter(map(types.__getitem__, tokens), dtype=np.int64, count=len(tokens))
    text_class, slack = file_class(text), slack_of(pairs) + 1e-3
    doubtful = types.doubtful(numbers, text_class, slack)
    if not len(doubtful):
        return []
    scores = {k: emission(tokens, k, types.weights, text_class) for k in doubtful.tolist()}
    open_ = [k for k, row in scores.items() if margin(row) <= slack]
    found, first = [], 0
    for last in range(len(open_)):
        if last + 1 < len(open_) and open_[last + 1] == open_[last] + 1:
            continue
        a, b = open_[first], open_[last] + 1
        tags = viterbi([scores[k] for k in open_[first : last + 1]], pairs, a > 0, b < len(tokens))
        found += [(a + k, tag) for k, tag in enumerate(tags) if tag]
        first = last + 1
    if not found:
        return []
    places = [m.span() for m in TOKEN.finditer(text)]
    spans = []
    for k, tag in found:
        if tag == 2 and spans and spans[-1][2] == k - 1:
            spans[-1] = (spans[-1][0], places[k][1], k)
        else:
            spans.append((*places[k], k))
    return [(a, b) for a, b, _ in spans]


def scan(text, types, pairs):
    """(base spans, all spans) as lists of (start, kind name, end)."""
    base = [(start, KINDS[kind], end) for start, kind, end in base_spans(text)]
    more = [] if types is None else [(a, "crf", b) for a, b in decode(text, types, pairs) if not any(a < y and x < b for x, _, y in base)]
    order = {kind: k for k, kind in enumerate((*KINDS, "crf"))}
    return base, sorted(base + more, key=lambda s: (s[0], order[s[1]]))


def written(spans):
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def find(docs, model, id_col="doc_id", text_col="text"):
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_crf) of every document."""
    shared.ship(docs.sparkSession)
    weights = None if model is None else model[0].tobytes()
    pairs = None if model is None else model[1]
    key = None if model is None else zlib.crc32(weights)
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long"

    def run(columns):
        types = None if weights is None else types_of(key, weights)
        out = {name: [] for name in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf")}
        out["doc_id"] = columns["doc_id"]
        for text in columns["text"]:
            base, spans = scan(text, types, pairs)
            for kind in KINDS:
                out[f"n_{kind}"].append(sum(s[1] == kind for s in base))
            out["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest())
            out["spans"].append(written(spans))
            out["n_crf"].append(len(spans) - len(base))
        return out

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), shared.text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(shared.per_batch(run, schema), schema)
