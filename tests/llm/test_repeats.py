"""Removal of repeats against a count of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from fixtures import edge_rows, frame
from labelspark.llm import repeats


def cut(texts, least):
    """(bytes, removed, runs, digest) per text."""
    data = [(t or "").encode() for t in texts]
    windows = Counter(x[k : k + least] for x in data for k in range(len(x) - least + 1))
    out = []
    for x in data:
        gone = np.zeros(len(x), dtype=bool)
        for k in range(len(x) - least + 1):
            if windows[x[k : k + least]] > 1:
                gone[k : k + least] = True
        kept = np.frombuffer(x, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(x), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def random_texts(rng, n=60):
    base = "".join(rng.choice("abcdefgh ") for _ in range(400))
    texts = []
    for _ in range(n):
        kind = rng.randint(0, 4)
        if kind == 0:
            texts.append("".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 300))))
        elif kind == 1:
            a = rng.randint(0, 380)
            texts.append("".join(rng.choice("xyz") for _ in range(9)) + base[a : a + rng.randint(5, 120)] + "".join(rng.choice("xyz") for _ in range(30)))
        elif kind == 2:
            texts.append("ab" * rng.randint(0, 90))
        elif kind == 3:
            texts.append("é" * rng.randint(0, 60) + base[50:150])
        else:
            texts.append(rng.choice(texts) if texts else None)
    return texts


@pytest.mark.parametrize(("least", "gram", "hot"), [(20, 8, 1000), (20, 8, 1), (31, 30, 3), (12, 12, 1000)])
def test_matches_all_windows(spark, least, gram, hot):
    """`hot` 1 sends every anchor string with two surroundings the way of very common ones."""
    texts = random_texts(random.Random(least + hot))
    got = repeats.remove_repeats(frame(spark, list(enumerate(texts))), least, gram, hot).toPandas().sort_values("doc_id")
    assert list(zip(got.n_bytes, got.n_removed, got.n_spans, got.kept_sha256, strict=True)) == cut(texts, least)
    assert [hashlib.sha256(bytes(x)).hexdigest() for x in got.kept] == got.kept_sha256.tolist()


def test_whole_length_and_edges(spark):
    rows = edge_rows()
    got = repeats.remove_repeats(frame(spark, rows)).toPandas()
    assert sorted(zip(got.n_bytes, got.n_removed, got.n_spans, got.kept_sha256, strict=True)) == sorted(cut([t for _, t in rows], 400))
    assert repeats.remove_repeats(frame(spark, [])).count() == 0


def test_transform_of_weighted_strings():
    rng = random.Random(4)
    for _ in range(150):
        least = rng.choice([3, 5, 8, 20])
        strings = [(t or "").encode() for t in random_texts(rng, rng.randint(1, 8))]
        weights = [rng.choice([1, 1, 2]) for _ in strings]
        windows = Counter()
        for x, w in zip(strings, weights, strict=True):
            for k in range(len(x) - least + 1):
                windows[x[k : k + least]] += w
        for x, spans in zip(strings, repeats.repeated_ranges(strings, weights, least), strict=True):
            starts = {k for a, b in spans for k in range(a, b - least + 1)}
            assert starts == {k for k in range(len(x) - least + 1) if windows[x[k : k + least]] > 1}


def test_equal_windows_share_an_anchor():
    rng = random.Random(8)
    shared_part = "".join(rng.choice("abcd") for _ in range(400)).encode()
    texts = [bytes(rng.choice(b"wxyz") for _ in range(rng.randint(0, 200))) + shared_part + bytes(rng.choice(b"wxyz") for _ in range(50)) for _ in range(5)]
    text, start, size, anchor, _ = repeats.anchors(texts)
    place = [t.find(shared_part) for t in texts]
    holding = [{a for t, s, n, a in zip(text, start, size, anchor, strict=True) if t == k and s <= place[k] and s + n >= place[k] + 400} for k in range(5)]
    assert set.intersection(*holding)
