"""Near-duplicate groups against all pairs on full sets."""

import re

import numpy as np
import pytest

from fixtures import corpus, edge_rows, frame, prose
from labelspark.llm import near

UPPER = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def plain(rows):
    sets = [shingles(text) for _, text in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                    root[find(a)] = find(b)
    least = {}
    for k, (doc, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), doc), doc)
    return sorted((doc, len(sets[k]), least[find(k)], doc == least[find(k)]) for k, (doc, _) in enumerate(rows))


def found(df):
    return sorted(tuple(r) for r in df.collect())


def family(rng, n, words):
    """Near copies of one text, each with changes of its own: some pairs are linked, some only through others."""
    base = prose(rng, words).split()
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = prose(rng, 1) + "q"
        out.append(" ".join(own))
    return out


def test_matches_all_pairs(spark):
    rows = corpus()
    assert found(near.near_duplicates(frame(spark, rows))) == plain(rows)


@pytest.mark.parametrize("small", [24, 2])
def test_families_need_pairs_beyond_the_hub(spark, monkeypatch, small):
    """With two members to a small bucket every bucket has several hubs; without hubs all is left to the blocks."""
    import random

    monkeypatch.setattr(near, "SMALL_BUCKET", small)
    monkeypatch.setattr(near, "BLOCK", 5)
    monkeypatch.setattr(near, "BLOCK_SHINGLES", 700)
    monkeypatch.setattr(near, "HUBS", ((1,),) if small == 2 else near.HUBS)
    monkeypatch.setattr(near, "CHUNK", 3)
    rng = random.Random(9)
    texts = [t for _ in range(4) for t in family(rng, 25, 100)] + ["few words", "Few Words", "few words x"]
    rows = list(enumerate(texts))
    assert found(near.near_duplicates(frame(spark, rows))) == plain(rows)


def test_edges(spark):
    rows = edge_rows()
    got = near.near_duplicates(frame(spark, rows)).toPandas()
    assert len(got) == len(rows)
    lost = got[got.doc_id.isna()]
    assert len(lost) == 2 and lost.component_id.isna().all() and lost.kept.all()
    assert (got[got.n_shingles == 0].component_id == got[got.n_shingles == 0].doc_id).all()
    assert near.near_duplicates(frame(spark, [])).count() == 0
    kept = near.drop_near(frame(spark, corpus()))
    assert sorted(r["doc_id"] for r in kept.collect()) == [r[0] for r in plain(corpus()) if r[3]]


def test_pruning_keeps_similar_pairs():
    rng = np.random.default_rng(3)
    for n, least in near.least_matches(0.85):
        assert 0 < least < n
    shared_part = rng.integers(0, 1 << 62, 2000, dtype=np.uint64)
    left = near.signature(near.mixed(shared_part))
    other = near.signature(near.mixed(rng.integers(0, 1 << 62, 2000, dtype=np.uint64)))
    close = near.signature(near.mixed(np.concatenate([shared_part[:1900], rng.integers(0, 1 << 62, 100, dtype=np.uint64)])))
    kept = near.survivors(np.stack([left, left, left]), np.stack([left, other, close]), 0.85)
    assert kept.tolist() == [0, 2]


def test_chance_to_miss_a_band():
    assert (1 - 0.85**near.ROWS) ** near.BANDS < 1e-5
