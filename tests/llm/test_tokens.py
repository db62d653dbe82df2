"""Packing and token files: round trips against the tokenizer itself."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from tokenizers import Tokenizer

from fixtures import corpus, edge_rows, frame
from labelspark.llm import packing, token_ids, token_store
from labelspark.session import shared_folder


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(token_ids.default_path())


def ids(tokenizer, text, end):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [end]


def crc(values):
    return zlib.crc32(np.array(values, dtype="<u4").tobytes())


def test_pieces_give_the_librarys_ids(tokenizer):
    rng = random.Random(5)
    letters = [chr(k) for k in range(0x250)] + list("東한👍²½Ⅷ٣ 　́\x85᠎​'") + [" "] * 40 + ["'ll", "a", "B", "<|endoftext|>"] * 10
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    coder = token_ids.Pieces(token_ids.default_path(), keep=50)
    for a in range(0, len(texts), 100):
        for text, got in zip(texts[a : a + 100], coder.encode(texts[a : a + 100]), strict=True):
            assert np.frombuffer(got, "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_an_added_token_in_a_text_has_its_own_id(spark, tokenizer):
    rows = [(1, "a <|endoftext|> b"), (2, "<|endoftext|><|endoftext|>"), (3, "<|endoftext |> plain"), (4, "x" * 30 + "<|endoftext|>")]
    coder = token_ids.Pieces(token_ids.default_path())
    assert np.frombuffer(coder.encode(["a <|endoftext|> b"])[0], "<u2").tolist() == [64, 220, 50256, 275]
    packed = {r["doc_id"]: r for r in packing.pack(frame(spark, rows), window=1 << 16).collect()}
    files = {r["doc_id"]: r for r in token_store.round_trip(frame(spark, rows)).collect()}
    for doc, text in rows:
        assert packed[doc]["ids_crc32"] == crc(ids(tokenizer, text, 1))
        assert files[doc]["ids_crc32"] == crc(ids(tokenizer, text, 2))


@pytest.mark.parametrize("window", [2048, 64])
def test_packing_cuts_one_stream(spark, tokenizer, window):
    rows = corpus()
    pieces = packing.pack(frame(spark, rows), window=window).toPandas()
    whole = {doc: ids(tokenizer, text, 1) for doc, text in rows}
    for doc, part in pieces.groupby("doc_id"):
        part = part.sort_values("start")
        assert (part.doc_tokens == len(whole[doc])).all()
        assert part.start.tolist() == [0, *np.cumsum(part.length)[:-1]] and part.length.sum() == len(whole[doc])
        assert part.ids_crc32.tolist() == [crc(whole[doc][s : s + n]) for s, n in zip(part.start, part.length, strict=True)]
    assert set(pieces.doc_id) == set(whole)
    filled = pieces.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    for _, part in filled:
        assert part.offset.tolist() == [0, *np.cumsum(part.length)[:-1]]
    sizes = filled.length.sum()
    left = int(sizes.iloc[-1])
    padding = filled.padding.max()
    assert (padding.iloc[:-1] == 0).all() and padding.iloc[-1] == (0 if left & (left - 1) == 0 else window - left)
    assert (sizes.iloc[:-1] == window).all() and sizes.index.tolist() == list(range(len(sizes)))


def test_packing_of_edges(spark, tokenizer):
    rows = edge_rows()
    pieces = packing.pack(frame(spark, rows)).toPandas()
    assert pieces.length.sum() == sum(len(ids(tokenizer, text, 1)) for _, text in rows)
    assert pieces.doc_id.isna().any()
    assert packing.pack(frame(spark, [])).count() == 0


def test_token_files_round_trip(spark, tokenizer):
    rows = corpus()
    folder = shared_folder(spark, "test-store")
    token_store.write_store(frame(spark, rows), folder, file_ids=500)
    got = token_store.read_store(spark, folder).toPandas().sort_values("doc_id")
    whole = [ids(tokenizer, text, 2) for _, text in rows]
    sizes = [len(x) for x in whole]
    assert got.doc_id.tolist() == [doc for doc, _ in rows]
    assert got.n_tokens.tolist() == sizes
    assert got.start.tolist() == [0, *np.cumsum(sizes)[:-1]]
    assert got.ids_crc32.tolist() == [crc(x) for x in whole]
    dictionary = bytes(spark.read.parquet(f"{folder}/dictionary").first()["dictionary"])
    by_id = dict(zip((doc for doc, _ in rows), whole, strict=True))
    for row in spark.read.parquet(f"{folder}/files").collect():
        index = token_store.open_file(bytes(row["data"]))[0]
        for k in (0, len(index) - 1):
            assert token_store.read_document(bytes(row["data"]), k, dictionary).tolist() == by_id[index["doc_id"][k]]


def test_a_wrong_dictionary_is_refused(spark):
    folder = shared_folder(spark, "test-store")
    token_store.write_store(frame(spark, corpus(2, 30)), folder)
    data = bytes(spark.read.parquet(f"{folder}/files").first()["data"])
    with pytest.raises(ValueError, match="another dictionary"):
        token_store.read_document(data, 0, b"something else")


def test_token_files_of_edges(spark):
    rows = edge_rows()
    got = token_store.round_trip(frame(spark, rows)).toPandas().sort_values("start")
    assert len(got) == len(rows) and got.doc_id.isna().sum() == 2
    ordered = got.doc_id.dropna().tolist()
    assert ordered == sorted(ordered) and got.doc_id.iloc[:2].isna().all()
    assert got.start.tolist() == [0, *np.cumsum(got.n_tokens)[:-1]]
    assert token_store.round_trip(frame(spark, [])).count() == 0


def test_different_words_of_a_batch_are_split_once():
    coder, seen = token_ids.Pieces(token_ids.default_path()), []
    coder.known = type("Seen", (token_ids.Known,), {"__getitem__": lambda self, piece: seen.append(piece) or token_ids.Known.__missing__(self, piece)})(
        coder.tokenizer.model.tokenize, "H"
    )
    texts = ["one two, three two, one"] * 50 + [" two", "two ", "a\n two", "a \n\ntwo", "a  two", "a   two ", "  two", "a  two", " \n two\n\n  two\n", "1 2's '  's", "one\x1c two", "½ two", "<|endoftext|> two"]
    assert coder.encode(texts) == [coder.whole(text) for text in texts]
    assert len(seen) < 150
    signs = [chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000]
    spaces = pc.match_substring_regex(pa.array(signs), f"^{token_ids.SPACE}$").to_pylist()
    assert spaces == [c.isspace() for c in signs]
