"""BPE encoding by tree concatenation, and decoding.

A text of more than `LEAF` characters is cut, as it stands, into leaves of that length. Leaves are rows of their own, encoded side by side; then
neighbours are put together up a tree of `FAN` children a node. At each join the text around it is encoded again, in a window that grows
until both sides agree:

* A piece of the tokenizer's split depends on nothing before it and on little behind it, so all pieces of the left side stand but the
  last few. From there the window is split anew, twice as far each time, until one of its settled pieces ends where a piece of the right
  side begins: from that place on both splits are the same.
* A piece that crosses the join (script without blanks, one letter repeated) keeps the tokens of its two halves but for a window of one
  token on either side, doubled until its first token is the left half's and its last one the right half's. Then any two neighbouring
  tokens stand side by side in some encoding of the library's model, and a row of tokens of which that holds is the encoding of its text.

So ids are those of the library for the whole text. Shorter texts are leaves by themselves and have no join.

Null and empty texts have no ids and decode to an empty text. A text that holds an added token's string gets that token's id there, as
in the library; the text on either side is split by itself. Rows with equal or null ids stay rows of their own. An empty table gives
an empty one. Columns besides id and text are not read. The ids of one document end in one row, as its text began. A tokenizer file
with another kind of split encodes every text whole.
"""

import functools
import re
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import functions as F

from labelspark.llm import shared
from labelspark.llm.token_ids import SPLIT, UNSURE, byte_letters, default_path, pieces

#: Characters of a leaf.
LEAF = 1 << 14
#: Children of a node.
FAN = 16
#: Ids of added tokens and short texts between them that are held at a time.
RUN = 1 << 16
#: Pieces up to this length are looked up among those already encoded.
KEPT = 64
#: How many characters behind its start decide whether a piece is a contraction: ' and two letters.
SIGHT = 3
#: White space, and what the two regular expression libraries may class differently, at the end of a text.
LOOSE_END = regex.compile(rf"(?r)(?:\s|{UNSURE.pattern})*\Z")


class Coder:
    """Tokens of pieces, and the bytes of each token."""

    def __init__(self, path):
        self.own = pieces(path)
        self.tokenizer, self.letters = self.own.tokenizer, byte_letters()
        self.back = {letter: byte for byte, letter in self.letters.items()}
        self.of = {}
        for token, k in self.tokenizer.get_vocab(with_added_tokens=True).items():
            known = all(letter in self.back for letter in token)
            self.of[k] = bytes(self.back[letter] for letter in token) if known else token.encode()

    def unsplit(self, raw):
        """Ids of bytes that the split leaves together."""
        return array("I", [x.id for x in self.tokenizer.model.tokenize(raw.decode("latin-1").translate(self.letters))])

    def pack(self, ids):
        """Ids as bytes of the tokenizer's width."""
        return np.array(ids, self.own.dtype).tobytes()

    def piece(self, text):
        """Ids of one piece, packed."""
        found = self.own.known[text] if len(text) <= KEPT else None
        return self.pack(self.unsplit(text.encode())) if found is None else found

    def bytes_of(self, ids):
        return b"".join(map(self.of.__getitem__, ids))

    def split(self, text):
        """Pieces of a text without added tokens. Where the two regular expression libraries may differ, the tokenizer's own split decides."""
        if UNSURE.search(text):
            found = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
            return [bytes(self.back[x] for x in piece).decode() for piece, _ in found]
        return SPLIT.findall(text)

    def join(self, left, right):
        """Ids of two neighbouring halves of a piece as one, from the ids of each."""
        width = 1
        while True:
            a, b = min(width, len(left)), min(width, len(right))
            again = self.unsplit(self.bytes_of(left[-a:]) + self.bytes_of(right[:b]))
            if (a == len(left) or again[0] == left[-a]) and (b == len(right) or again[-1] == right[b - 1]):
                return left[:-a] + again + right[b:]
            width *= 2


@functools.lru_cache(maxsize=2)
def coder_of(path):
    """One per worker process and tokenizer file."""
    return Coder(path)


class Span:
    """Text with its ids: where each piece begins, and how many ids there are up to its end."""

    def __init__(self, text, starts, counts, ids):
        self.text, self.starts, self.counts, self.ids = text, starts, counts, ids

    @classmethod
    def of(cls, text, coder):
        if len(coder.own.known) > coder.own.keep:
            coder.own.known.forget()
        found = coder.split(text)
        return cls.made(text, found, [coder.piece(x) for x in found], coder.own.dtype)

    @classmethod
    def made(cls, text, found, coded, dtype):
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        counts = np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded))) // np.dtype(dtype).itemsize
        return cls(text, np.cumsum(sizes) - sizes, counts, np.frombuffer(b"".join(coded), dtype))

    def slice(self, first, last):
        """Ids of the pieces from `first` up to `last`."""
        a = self.counts[first - 1] if first else 0
        return self.ids[a : self.counts[last - 1] if last else 0]

    def stop(self, k):
        """Where piece k ends."""
        return int(self.starts[k + 1]) if k + 1 < len(self.starts) else len(self.text)


def settled_length(text):
    """Pieces that end here or before do not depend on what may follow the text."""
    return LOOSE_END.search(text).start() - SIGHT


def concat(left, right, coder):
    """The span of two neighbouring ones: what lies around the join is split and encoded again."""
    # the first piece of the left side that what follows might change: pieces before it end in the settled part
    first = max(0, int(np.searchsorted(left.starts, settled_length(left.text), side="right")) - 1)
    begin = int(left.starts[first])
    tail, k = left.text[begin:], 4
    while True:
        whole = k >= len(right.starts)
        window = tail + (right.text if whole else right.text[: int(right.starts[k])])
        found, place, taken, last = coder.split(window), 0, [], len(right.starts)
        sure = settled_length(window)
        agreed = False
        for piece in found:
            if place >= len(tail) and (at := int(np.searchsorted(right.starts, place - len(tail)))) < len(right.starts):
                if right.starts[at] == place - len(tail):
                    agreed, last = True, at
                    break
            if not whole and place + len(piece) > sure:
                break
            taken.append((place, piece))
            place += len(piece)
        if agreed or whole:
            break
        k *= 2
    coded = []
    for at, piece in taken:
        own = int(np.searchsorted(left.starts, begin + at))
        end = at + len(piece)
        if own < len(left.starts) and left.starts[own] == begin + at and end <= len(tail) and left.stop(own) == begin + end:
            coded.append(left.slice(own, own + 1).tobytes())
        elif own == len(left.starts) - 1 and left.starts[own] == begin + at and end - len(tail) == right.stop(0):
            halves = array("I", left.slice(own, own + 1)), array("I", right.slice(0, 1))
            coded.append(coder.pack(coder.join(*halves)))
        else:
            coded.append(coder.piece(piece))
    middle = Span.made("", [x for _, x in taken], coded, coder.own.dtype)
    before, behind = left.slice(0, first), right.slice(last, len(right.starts))
    gone = right.counts[last - 1] if last else 0
    return Span(
        left.text + right.text,
        np.concatenate([left.starts[:first], begin + middle.starts, len(left.text) + right.starts[last:]]),
        np.concatenate([left.counts[:first], len(before) + middle.counts, len(before) + len(middle.ids) + right.counts[last:] - gone]),
        np.concatenate([before, middle.ids, behind]),
    )


def tree(spans, coder):
    """One span out of neighbours, put together pair by pair."""
    while len(spans) > 1:
        pairs = [concat(spans[k], spans[k + 1], coder) for k in range(0, len(spans) - 1, 2)]
        spans = pairs + spans[len(pairs) * 2 :]
    return spans[0]


def segments(coder, text):
    """(added token's id or None, string) of a text, in order."""
    added = coder.own.added
    if not any(token in text for token in added):
        return [(None, text)]
    wanted = re.compile("(" + "|".join(re.escape(x) for x in sorted(added, key=len, reverse=True)) + ")")
    return [(coder.tokenizer.token_to_id(x) if k % 2 else None, x) for k, x in enumerate(wanted.split(text)) if x]


def short_texts(docs, path):
    """(doc_id, ids) of texts that are leaves by themselves."""
    fields = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        coder = pieces(path)
        for batch in shared.parts(batches):
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in shared.slices(texts):
                coded = [np.frombuffer(x, coder.dtype).astype("<u4").tobytes() for x in coder.encode(texts[a:b])]
                yield pa.RecordBatch.from_arrays([pa.array(keys[a:b], pa.int64()), pa.array(coded, pa.binary())], schema=fields)

    return docs.mapInArrow(run, "doc_id long, ids binary")


NODES = "doc long, doc_id long, part int, leaf int, leaves int, text string, starts binary, counts binary, ids binary"


NODE_FIELDS = pa.schema(
    [("doc", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int32()), ("leaf", pa.int32()), ("leaves", pa.int32())]
    + [("text", pa.string()), ("starts", pa.binary()), ("counts", pa.binary()), ("ids", pa.binary())]
)


def node_batch(rows):
    columns = [pa.array(x, field.type) for x, field in zip(zip(*rows, strict=True), NODE_FIELDS, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=NODE_FIELDS)


def leaves(docs, path, leaf):
    """Long texts as rows of `NODES`: the leaves of each stretch between added tokens, and finished ids of what needs no cut.

    `doc` numbers the texts by partition and place; a row that is no leaf has no number of its own.
    """

    def run(batches):
        coder, place = coder_of(path), TaskContext.get().partitionId() << 33
        for batch in shared.parts(batches, 64):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                place += 1
                part, rows, held = 0, [], array("I")
                for number, segment in segments(coder, text) if coder.own.splits else [(-1, text)]:
                    cut = number is None and len(segment) > leaf
                    if held and (cut or len(held) >= RUN):
                        rows.append((place, key, part, None, None, None, None, None, coder.pack(held)))
                        part, held = part + 1, array("I")
                    if cut:
                        n = -(-len(segment) // leaf)
                        rows += [(place, key, part, k, n, segment[k * leaf : (k + 1) * leaf], None, None, None) for k in range(n)]
                        part += 1
                    elif number is None:
                        held.extend(Span.of(segment, coder).ids)
                    elif number < 0:
                        held.extend(coder.tokenizer.encode(segment, add_special_tokens=False).ids)
                    else:
                        held.append(number)
                    if len(rows) >= 64:
                        yield node_batch(rows)
                        rows = []
                if held:
                    rows.append((place, key, part, None, None, None, None, None, coder.pack(held)))
                if rows:
                    yield node_batch(rows)

    return docs.mapInArrow(run, NODES)


def one_level(nodes, path, spread):
    """Up the tree: `FAN` neighbours become one node. Leaves, which have no ids yet, are encoded here; the last node of a text needs only ids."""

    def run(table):
        table = table.drop_columns("_node").sort_by("leaf")
        coder, rows = coder_of(path), table.to_pylist()
        spans = [
            Span.of(r["text"], coder)
            if r["ids"] is None
            else Span(r["text"], np.frombuffer(r["starts"], "<i8"), np.frombuffer(r["counts"], "<i8"), np.frombuffer(r["ids"], coder.own.dtype))
            for r in rows
        ]
        got, r = tree(spans, coder) if len(spans) > 1 else spans[0], rows[0]
        n = -(-r["leaves"] // FAN)
        rest = (got.text, got.starts.astype("<i8").tobytes(), got.counts.astype("<i8").tobytes()) if n > 1 else (None, b"", b"")
        row = (r["doc"], r["doc_id"], r["part"], r["leaf"] // FAN, n, *rest, got.ids.tobytes())
        return pa.Table.from_batches([node_batch([row])])

    node = F.floor(F.col("leaf") / FAN).cast("int")
    rows = nodes.withColumn("_node", node).repartition(spread, "doc", "part", "_node")
    return rows.groupBy("doc", "part", "_node").applyInArrow(run, NODES)


def long_texts(docs, path, leaf):
    """(doc_id, ids) of texts that have to be cut."""
    parts = shared.stored(leaves(docs, path, leaf), "leaves")
    most = parts.agg(F.max("leaves")).first()[0] or 0
    spread = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    nodes = parts.where("leaf is not null")
    while most > 1:
        nodes, most = one_level(nodes, path, spread), -(-most // FAN)
    whole = parts.where("leaf is null").unionByName(nodes).select("doc", "doc_id", "part", "ids")

    def together(table):
        table = table.sort_by("part")
        ids = np.frombuffer(b"".join(table.column("ids").to_pylist()), coder_of(path).own.dtype).astype("<u4")
        return pa.table([table.column("doc_id").slice(0, 1), pa.array([ids.tobytes()], pa.binary())], names=["doc_id", "ids"])

    return whole.groupBy("doc").applyInArrow(together, "doc_id long, ids binary")


def encode(docs, path=None, leaf=LEAF, id_col="doc_id", text_col="text"):
    """(doc_id, ids) of every text: ids as little-endian unsigned 32-bit integers."""
    path = path or default_path()
    shared.ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), shared.text_or_empty(text_col).alias("text"))
    long = F.length("text") > leaf
    return short_texts(rows.where(~long), path).unionByName(long_texts(rows.where(long), path, leaf))


def decode(coded, path=None, ids_col="ids", text_col="decoded"):
    """Every row with the text of its ids: special tokens as their strings, bytes that are no UTF-8 replaced, ids without a token left out."""
    path = path or default_path()
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StringType, StructField, StructType

    shared.ship(coded.sparkSession)
    schema = StructType([*coded.schema.fields, StructField(text_col, StringType())])
    fields = to_arrow_schema(schema)
    place = coded.columns.index(ids_col)

    def run(batches):
        of = coder_of(path).of
        for batch in shared.parts(batches, 256):
            texts = []
            for ids in batch.column(place).to_pylist():
                if ids is None:
                    texts.append(None)
                    continue
                texts.append(b"".join([of.get(k, b"") for k in array("I", ids)]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], schema=fields)

    return coded.mapInArrow(run, schema)


def round_trip(docs, **options):
    """(doc_id, ids, decoded) of every text."""
    return decode(encode(docs, **options), options.get("path"))


def digests(coded):
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of `round_trip`'s rows."""
    return coded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
