"""Token ids of a byte-level BPE tokenizer file, by the tokenizers library, with the pieces' ids kept between texts."""

import functools
import json
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: The split before the merges that such files ask for: 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Characters that the two regular expression libraries may class differently: numbers that are no decimal digits, newer and private
#: characters, odd white space. A text with one of them goes to the library as it stands.
UNSURE = regex.compile(r"[\p{No}\p{Nl}\p{Cn}\p{Co}\p{Cs}\x1c-\x1f\x85᠎​]")

#: What str.isspace() holds for, as a class for Arrow's expressions.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def default_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters():
    """The letter that stands for each byte in such vocabularies: printable Latin-1 as itself, the rest from 256 on."""
    table, spare = {}, 256
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or byte >= 174:
            table[byte] = chr(byte)
        else:
            table[byte] = chr(spare)
            spare += 1
    return table


class Known(dict):
    """Ids per piece, made when first asked for; None for a piece with an unsure character."""

    def __init__(self, tokenize, code):
        self.tokenize, self.code, self.letters, self.old = tokenize, code, byte_letters(), {}

    def __missing__(self, piece):
        found = self.old.get(piece, 0)
        if found == 0:
            if (piece.isspace() or not piece.isascii()) and UNSURE.search(piece):
                found = None
            else:
                plain = piece.isascii() and piece.isprintable()
                letters = piece.replace(" ", self.letters[32]) if plain else piece.encode().decode("latin-1").translate(self.letters)
                found = array(self.code, [x.id for x in self.tokenize(letters)]).tobytes()
        self[piece] = found
        return found

    def forget(self):
        """Drops the pieces not asked for since the last time."""
        self.old = dict(self)
        self.clear()


class Pieces:
    """Ids of texts as little-endian bytes, from the ids of their pieces; pieces not used lately are forgotten beyond `keep`.

    A byte-level BPE works inside the pieces its split yields, so a text's ids are those of its pieces in a row. The library's model
    gives the ids of a piece. A text that holds an added token's string goes to the library as it stands, which gives that token's id.

    Of the words of a batch (what lies between blanks) only the different ones are split, in one text. No piece but a run of white space goes on
    beyond a blank, so a word with the blank before it has the same pieces anywhere, unless it begins with white space: texts with such a word,
    as with two blanks in a row, are split by themselves.
    """

    def __init__(self, path, keep=120_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            found = json.load(file)
        split = found.get("pre_tokenizer") or {}
        self.added = [x["content"] for x in found.get("added_tokens", [])]
        odd = ("single_word", "lstrip", "rstrip", "normalized")
        self.splits = (
            split.get("type") == "ByteLevel"
            and split.get("use_regex")
            and not split.get("add_prefix_space")
            and not found.get("normalizer")
            and not any(x.get(name) for x in found.get("added_tokens", []) for name in odd)
        )
        self.dtype, code, self.width = ("<u2", "H", 2) if self.tokenizer.get_vocab_size() <= 1 << 16 else ("<u4", "I", 4)
        self.known, self.keep = Known(self.tokenizer.model.tokenize, code), keep

    def whole(self, text):
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def by_pieces(self, text):
        """Ids from the pieces of a text, None where one of them has an unsure character."""
        try:
            return b"".join(map(self.known.__getitem__, SPLIT.findall(text)))
        except TypeError:
            return None

    def by_words(self, texts):
        """Ids of each text from the different words of all, None where these do not give them."""
        parts = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded, offsets = parts.values.dictionary_encode(), parts.offsets.to_numpy()
        number, first = coded.indices.to_numpy(), offsets[:-1]
        odd = pc.match_substring_regex(coded.dictionary, f"^({SPACE}|$)").to_numpy(zero_copy_only=False)
        usual = np.flatnonzero(~odd)
        words = pa.ListArray.from_arrays([0, len(usual)], coded.dictionary.take(pa.array(usual)))
        pieces = SPLIT.findall(" " + pc.binary_join(words, pa.scalar(" ", pa.large_string()))[0].as_py()) if len(usual) else []
        ids = list(map(self.known.__getitem__, pieces))
        begins = np.flatnonzero(np.fromiter((x[0] == " " for x in pieces), dtype=bool, count=len(pieces)))
        if len(usual):
            odd[usual] = np.logical_or.reduceat(np.fromiter((x is None for x in ids), dtype=bool, count=len(ids)), begins)
        ids = [x or b"" for x in ids]
        size, start = np.zeros(len(odd), dtype=np.int64), np.zeros(len(odd), dtype=np.int64)
        if len(usual):
            size[usual] = np.add.reduceat(np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // self.width, begins)
            start[usual] = np.cumsum(size[usual]) - size[usual]
        size, start = size[number], start[number]
        size[first] = 0  # a text's first word has no blank before it
        stop = np.cumsum(size)
        pool = np.frombuffer(b"".join(ids), dtype=self.dtype)
        data = pool[np.repeat(start - stop + size, size) + np.arange(stop[-1])].tobytes()
        stops = [0, *(stop[offsets[1:] - 1] * self.width).tolist()]
        bad, heads = odd[number], parts.values.take(pa.array(first)).to_pylist()
        bad[first] = False
        heads = [None if x else self.by_pieces(head) for x, head in zip(np.logical_or.reduceat(bad, first), heads, strict=True)]
        return [None if head is None else head + data[a:b] for head, a, b in zip(heads, stops[:-1], stops[1:], strict=True)]

    def encode(self, texts):
        """Ids of each text as bytes of `dtype`."""
        if not self.splits or not len(texts):
            return [self.whole(text) for text in texts]
        if len(self.known) > self.keep:
            self.known.forget()
        try:
            found = self.by_words(texts)
        except UnicodeEncodeError:  # half of a pair of surrogates
            found = [None] * len(texts)
        for k, text in enumerate(texts):
            if any(token in text for token in self.added):
                found[k] = self.whole(text)
            elif found[k] is None:
                found[k] = self.by_pieces(text)
                if found[k] is None:
                    found[k] = self.whole(text)
        return found


@functools.lru_cache(maxsize=2)
def pieces(path, keep=120_000):
    """One per worker process and tokenizer file."""
    return Pieces(path, keep)


def width_of(path):
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else 4
