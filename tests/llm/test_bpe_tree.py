"""Tree concatenation against the tokenizer itself."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from fixtures import corpus, edge_rows, frame
from labelspark.llm import bpe_tree, token_ids

PATH = token_ids.default_path()


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def unsplit(rng, n):
    """Text of one piece: letters only, from alphabets small enough for many repeats, or of one kind of sign."""
    kind = rng.randrange(6)
    if kind == 0:
        return "".join(rng.choice("ab") for _ in range(n))
    if kind == 1:
        return rng.choice("axé東") * n
    if kind == 2:
        return "".join(rng.choice("the in an er on ing ation".split()) for _ in range(n // 3 + 1))
    if kind == 3:
        return "".join(chr(rng.randrange(0x4E00, 0x4F00)) for _ in range(n))
    if kind == 4:
        return "".join(rng.choice("=-_*#") for _ in range(n))
    return " " * n


def test_joins_of_halves_of_a_piece_are_exact():
    rng = random.Random(7)
    coder = bpe_tree.coder_of(PATH)
    for _ in range(1500):
        raw = unsplit(rng, rng.randint(2, 60)).encode()
        cut = rng.randint(1, len(raw) - 1)
        got = coder.join(coder.unsplit(raw[:cut]), coder.unsplit(raw[cut:]))
        assert got == coder.unsplit(raw)
        assert coder.bytes_of(got) == raw


def test_joins_of_texts_are_exact(tokenizer):
    rng = random.Random(8)
    coder = bpe_tree.coder_of(PATH)
    bits = ["'", "'s", "'ll", "re", "l", "s", " ", "  ", "\n", "\t ", "a", "Word", "don", "12", "3", "!", "..", "é", "東", "²", "\x1c", "\x85", "\u3000", "\u180e", "\u200b", "👍", "_"]
    for _ in range(4000):
        few = rng.sample(bits, rng.randint(1, 8))
        text = "".join(rng.choice(few) for _ in range(rng.randint(2, 60)))
        leaf = rng.randint(1, 12)
        spans = [bpe_tree.Span.of(text[a : a + leaf], coder) for a in range(0, len(text), leaf)]
        got = bpe_tree.tree(spans, coder)
        assert got.ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, (text, leaf)
        assert got.text == text
        assert [text[a : got.stop(k)] for k, a in enumerate(got.starts.tolist())] == coder.split(text)


def texts():
    rng = random.Random(11)
    rows = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 6)):
            parts.append(rng.choice([unsplit(rng, rng.randint(1, 700)), "some words, 12 of 'em ", "<|endoftext|>", "x²Ⅷ\x1c ", "\n\n  ", "don't"]))
        rows.append("".join(parts))
    return rows + ["a" * 5000, "東" * 3000, " " * 3000 + "x", "<|endoftext|>" * 3 + "b" * 900, "ab" * 4000 + " end"]


def expected(tokenizer, doc, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    decoded = tokenizer.decode(ids, skip_special_tokens=False)
    return doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def digests(spark, rows, **options):
    return sorted((tuple(r) for r in bpe_tree.digests(bpe_tree.round_trip(frame(spark, rows), **options)).collect()), key=str)


def test_long_texts_in_small_leaves(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(bpe_tree, "FAN", 3)
    rows = list(enumerate(texts()))
    assert digests(spark, rows, leaf=16) == sorted((expected(tokenizer, *r) for r in rows), key=str)


def test_production_leaves(spark, tokenizer):
    rng = random.Random(3)
    rows = [*corpus(), (900, "word " * 5000 + "東京" * 20000), (901, "".join(rng.choice("acgt") for _ in range(100_000))), (902, "so " * 9000)]
    assert digests(spark, rows) == sorted((expected(tokenizer, *r) for r in rows), key=str)


def test_edges(spark, tokenizer):
    rows = edge_rows() + [(None, "z" * 20000), (None, "z" * 20000), (4, "q" * 17000)]
    assert digests(spark, rows) == sorted((expected(tokenizer, *r) for r in rows), key=str)
    assert digests(spark, []) == []


def test_decoding_of_any_ids(spark, tokenizer):
    rng = random.Random(5)
    lists = [[rng.randrange(50257) for _ in range(rng.randint(0, 30))] for _ in range(300)] + [[50256], [60000, 64]]
    rows = [(k, bytearray(np.array(x, "<u4").tobytes())) for k, x in enumerate(lists)] + [(-1, None)]
    got = {r["doc_id"]: r["decoded"] for r in bpe_tree.decode(spark.createDataFrame(rows, "doc_id long, ids binary")).collect()}
    assert got.pop(-1) is None
    assert got == {k: tokenizer.decode(x, skip_special_tokens=False) for k, x in enumerate(lists)}
