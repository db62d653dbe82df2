"""The prefix trie against a plain build of all prefixes."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import types as T

from labelspark.llm import prefix_trie

SCHEMA = T.StructType(
    [T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]
    + [T.StructField(name, T.StringType()) for name in ("key", "depth", "parent", "base", "words", "last", "weight")]
)
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["clash"] * 7) for r in rows], SCHEMA).repartition(3)


def plain(rows, family=20, heads=4):
    """{prefix: columns} by brute force."""
    own = {}
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(conv, []).append((role or "", text or ""))
    whole = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % heads
        whole[conv] = own.get(conv - int(f"{abs(conv) % family * (1 if conv >= 0 else -1)}"), [])[:h] + turns[h:]
    members = {}
    for conv, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(conv)
    words = lambda key: len(re.findall(r"[^\x20\x09-\x0D]+", key[-1][1])) if key else 0
    out = []
    for key, convs in members.items():
        inside = [k for k in members if k[: len(key)] == key]
        kids = {k for k in inside if len(k) == len(key) + 1}
        leaves = [k for k in inside if not any(len(m) == len(k) + 1 and m[: len(k)] == k for m in inside)]
        ends = ",".join(str(c) for c in sorted(convs) if len(whole[c]) == len(key))
        out.append(
            (
                min(convs),
                len(key),
                min(members[key[:-1]]) if key else None,
                len(convs),
                len(kids),
                len(leaves),
                sum((len(members[k]) - 1) * words(k) for k in inside),
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(out, key=str)


def trie(spark, rows, **options):
    return sorted((tuple(r) for r in prefix_trie.build(frame(spark, rows), **options).select(*COLUMNS).collect()), key=str)


def talks(seed, n, first=0):
    rng = random.Random(seed)
    said = ["hi", "hello there", "yes", "no  no\tno", "", None, "tell me more\x0bplease"]
    rows = []
    for conv in range(first, first + n):
        for turn in range(rng.choice([0, 1, 1, 2, 3, 5, 9])):
            rows.append((conv, turn, rng.choice(["user", "user", "assistant", None]), rng.choice(said[: 1 + turn * 2] if turn < 3 else said)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_nodes_of_random_conversations(spark, seed):
    rows = talks(seed, 150, first=-30)
    assert trie(spark, rows) == plain(rows)


def test_conversations_as_they_are(spark):
    rows = talks(3, 60)
    assert trie(spark, rows, family=1, heads=1) == plain(rows, 1, 1)


def test_absent_bases_and_turnless_conversations(spark):
    # 1, 2, ... have one turn and no conversation 0: those with a head of one turn or more are left without any
    rows = [(conv, 0, "user", "only") for conv in range(1, 20)]
    got = trie(spark, rows)
    assert got == plain(rows) and len(got) == 2
    assert trie(spark, [(c, 0, "user", "x") for c in (5,)]) == plain([(5, 0, "user", "x")])


def test_edges(spark):
    rows = [(None, 0, "user", "of nobody"), (0, None, None, None), (0, 1, "user", "then"), (40, 1, "user", "same"), (40, 1, "user", "same")]
    assert trie(spark, rows) == plain(rows)
    assert trie(spark, []) == []
    assert trie(spark, [(None, 0, "user", "of nobody")]) == []


def test_a_very_common_conversation_and_blocks_of_ids(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK_BITS", 3)
    rows = [(20 * c, t, "user", "word " * (t + 1)) for c in range(300) for t in range(3)] + [(7000, 0, "user", "word "), (8000, 0, "user", "other")]
    assert trie(spark, rows) == plain(rows)


def test_long_texts_and_long_conversations(spark):
    rows = [(20, t, "user", "ab " * 20000 if t == 5 else "x") for t in range(600)] + [(40, t, "user", "x") for t in range(300)]
    got = trie(spark, rows)
    assert len(got) == 1 + 600 + 295 and got == plain_chain(rows)


def plain_chain(rows):
    """Two conversations that part at turn 5."""
    first, second = (sorted(r for r in rows if r[0] == c) for c in (20, 40))
    words = [len(r[3].split()) for r in first]
    out = [(20, 0, None, 2, 1, 2, 5, hashlib.sha256(b"").hexdigest())]
    for d in range(1, 601):
        shared = d <= 5
        out.append(
            (20, d, 20, 2 if shared else 1, 2 if d == 5 else int(d < 600), 2 if shared else 1, sum(words[d - 1 : 5]) if shared else 0, hashlib.sha256(b"20" if d == 600 else b"").hexdigest())
        )
    for d in range(6, 301):
        out.append((40, d, 20 if d == 6 else 40, 1, int(d < 300), 1, 0, hashlib.sha256(b"40" if d == 300 else b"").hexdigest()))
    return sorted(out, key=str)
