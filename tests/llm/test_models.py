"""Fitted models: quality, languages, secrets, language model."""

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from fixtures import corpus, edge_rows, frame, prose
from labelspark.llm import language_id, mixing, quality, secrets, shared

FOLD = lambda doc, n: zlib.crc32(str(doc).encode()) % n


# quality


def graded(n=400):
    rng, rows, labels = random.Random(3), [], []
    for k in range(n):
        good = k % 4 != 0
        text = prose(rng, rng.randint(20, 120))
        rows.append((k, text if good else " ".join(w.upper() + "!!" for w in text.split())))
        if k % 3 == 0:
            labels.append((k, int(good), 0))
    return rows, labels


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_quality_of_held_out_documents(spark):
    rows, labels = graded()
    docs, marks = frame(spark, rows), labels_of(spark, labels + [(5000, None, None), (None, 1, 0), labels[0]])
    got = quality.score(docs, quality.train(docs, marks)).toPandas().set_index("doc_id")
    truth = {k: k % 4 != 0 for k, _ in rows}
    assert all(got.loc[k].held_out == (FOLD(k, 5) == 0) for k in truth)
    right = [bool(got.loc[k].predicted) == truth[k] for k in truth if got.loc[k].held_out]
    assert np.mean(right) > 0.95
    assert ((got.score >= 0) & (got.score <= 1)).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    kept = {r["doc_id"] for r in quality.drop_poor(docs, marks).collect()}
    assert kept == set(got.index[got.predicted == 1])


def test_the_fit_holds_its_rows_once():
    rng = np.random.default_rng(1)
    good, all_ = (rng.random((n, quality.SIZE), dtype=np.float32) for n in (3000, 6000))
    tracemalloc.start()
    found = quality.fit(good, all_, 0.6, steps=2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == quality.SIZE + 1 and most < 1.5 * 9000 * 8 * (quality.SIZE + 1)


def test_quality_edges(spark):
    docs = frame(spark, edge_rows())
    none = quality.score(docs, quality.train(docs, labels_of(spark, []))).toPandas()
    assert len(none) == len(edge_rows()) and (none.score == 0.5).all()
    empty = frame(spark, [])
    assert quality.score(empty, quality.train(empty, labels_of(spark, [(1, 1, 0)]))).count() == 0


def test_quality_where_every_document_has_a_label(spark):
    rows, _ = graded()
    marks = labels_of(spark, [(k, int(k % 4 != 0), 0) for k, _ in rows])
    got = quality.score(frame(spark, rows), quality.train(frame(spark, rows), marks)).toPandas().set_index("doc_id")
    right = [bool(got.loc[k].predicted) == (k % 4 != 0) for k, _ in rows if got.loc[k].held_out]
    assert np.mean(right) > 0.95 and got.score.nunique() > 100


def test_quality_without_a_good_document_drops_nothing(spark):
    rows, _ = graded(60)
    docs = frame(spark, rows)
    for marks in ([], [(k, 0, 0) for k, _ in rows], [(9000, 1, 0)]):
        assert quality.drop_poor(docs, labels_of(spark, marks)).count() == len(rows)


def test_quality_sample_takes_one_row_of_an_id(spark):
    docs = frame(spark, [(1, f"text {k}") for k in range(50)] + [(2, "other")])
    chosen = docs.select("doc_id").distinct()
    assert quality.sample(docs, chosen, "doc_id", "text").shape == (2, quality.SIZE)


def test_quality_against_plain_scores(spark):
    """The scores of the query are those of the fitted weights, text by text."""
    rows, labels = graded(120)
    docs = frame(spark, rows + [(500, None), (501, "")])
    weights, prior = quality.train(docs, labels_of(spark, labels))
    got = quality.score(docs, (weights, prior)).toPandas().set_index("doc_id").score
    for doc, text in [*rows, (500, ""), (501, "")]:
        z = quality.features([text]).astype(np.float64)[0] @ weights[:-1] + weights[-1]
        assert math.isclose(got[doc], 1 / (1 + math.exp(-z)), rel_tol=1e-9)


def test_the_risk_is_held_above_zero():
    """Unlabelled data of which 70 % are positive: the learned chance ranks the negatives below the positives."""
    rng = np.random.default_rng(0)
    positive = rng.normal(1, 1, (800, 3)).astype(np.float32)
    hidden = np.concatenate([rng.normal(1, 1, (700, 3)), rng.normal(-2, 1, (300, 3))]).astype(np.float32)
    weights = quality.fit(positive, hidden, 0.7, steps=800)
    score = hidden @ weights[:-1] + weights[-1]
    assert np.mean(score[:700] > 0) > 0.9 and np.mean(score[700:] < 0) > 0.8


# languages


def test_languages(spark):
    rng = random.Random(6)
    tongues = {"aa": "ka ko ku ke".split(), "bb": "st rt pl ni".split(), "cc": "zé çu ñi öw".split()}

    def text(lang):
        return " ".join("".join(rng.choice(tongues[lang]) for _ in range(rng.randint(1, 5))) for _ in range(60))

    rows = [(k, text(lang), lang) for k, lang in enumerate(["aa", "bb", "cc"] * 60)]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "12 + \u0301 3!", "cc"), (903, text("aa"), None), (None, text("bb"), "bb"), (904, text("cc") * 40, None)]
    docs = frame(spark, rows)
    got = language_id.predict(docs, language_id.train(docs)).toPandas()
    by = {r.doc_id: r for r in got.itertuples()}
    held = [by[k] for k, _, _ in rows[:180] if FOLD(k, 3) == 1]
    assert held and all(r.held_out and r.lang_pred == ("aa", "bb", "cc")[int(r.doc_id) % 3] for r in held)
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (900, 901, 902))
    assert by[903].lang_pred == "aa" and by[904].lang_pred == "cc"
    assert got.score.between(0, 1).all() and len(got) == len(rows)


def test_nothing_learned(spark):
    docs = frame(spark, corpus(2, 10))
    got = language_id.predict(docs, language_id.train(docs)).toPandas()
    assert (got.lang_pred == "und").all()
    assert language_id.predict(frame(spark, []), {}).count() == 0


# secrets


def plain_spans(text):
    found = []
    for kind, pattern, group, least in (
        ("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 20),
        ("hex", r"[0-9a-f]+", 0, 24),
    ):
        found += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    order = ["assign", "access", "hex"]
    return sorted(found, key=lambda s: (s[0], order.index(s[1])))


def secret_texts(n=120):
    rng = random.Random(2)
    key = lambda k: "".join(rng.choice("0123456789abcdefghijkmnpqrstXYZ") for _ in range(k))
    out = []
    for k in range(n):
        text = prose(rng, 30)
        if k % 3 == 0:
            text += f' token = "{key(30)}" ' + prose(rng, 10)
        if k % 5 == 0:
            text += f" AKIA{key(16).upper()} then {rng.getrandbits(120):030x} " + prose(rng, 5)
        out.append(text)
    return out + ["PASSWORD: abc", "api_key='abcdef'", "apikey=x.y/z+1=", "AKIASHORT", "ſecret = longenough", "tokens = short", "deadbeef" * 3, "", None]


def test_base_spans_and_the_field(spark):
    texts = secret_texts()
    docs = frame(spark, list(enumerate(texts)))
    model = secrets.train(docs)
    got = secrets.find(docs, model).toPandas().set_index("doc_id")
    for k, text in enumerate(texts):
        base = plain_spans(text or "")
        row = got.loc[k]
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(s[1] == kind for s in base) for kind in secrets.KINDS)
        assert row.base_sha256 == __import__("hashlib").sha256(secrets.written(base).encode()).hexdigest()
        spans = row.spans.split(",") if row.spans else []
        assert {f"{kind}:{a}:{b}" for a, kind, b in base} <= set(spans) and len(spans) == len(base) + row.n_crf
    # A secret that no base pattern knows: the field has to find it by its shape and neighbours.
    types = secrets.Types(model[0])
    text = 'token is "' + "7xk2m9q4tr8b3n5d1ahj6gp0s2" + '" and ' + prose(random.Random(4), 10)
    assert plain_spans(text) == []
    assert any(text[a:b].startswith("7xk2m9q4") for a, b in secrets.decode(text, types, model[1]))


def test_cut_chains_decode_as_whole_ones(spark):
    texts = [t for t in secret_texts(60) if t]
    weights, pairs = secrets.train(frame(spark, list(enumerate(texts))))
    rng = np.random.default_rng(0)
    for noise in (0, 0.5, 2):
        noisy = (weights + rng.normal(0, noise, weights.shape)).astype(np.float32)
        types = secrets.Types(noisy)
        for text in texts[:40]:
            tokens = secrets.TOKEN.findall(text)
            scores = [secrets.emission(tokens, k, noisy, secrets.file_class(text)) for k in range(len(tokens))]
            tags, places, spans = secrets.viterbi(scores, pairs, False, False), [m.span() for m in secrets.TOKEN.finditer(text)], []
            for k, tag in enumerate(tags):
                if tag == 2 and spans and spans[-1][2] == k - 1:
                    spans[-1] = (spans[-1][0], places[k][1], k)
                elif tag:
                    spans.append((*places[k], k))
            assert secrets.decode(text, types, pairs) == [(a, b) for a, b, _ in spans]


def test_secrets_edges(spark):
    plain = frame(spark, [(k, t) for k, t in edge_rows() if t is None or "token" not in t])
    assert secrets.train(plain) is None
    got = secrets.find(plain, None).toPandas()
    assert len(got) == plain.count() and (got.spans == "").all()
    assert secrets.find(frame(spark, []), None).count() == 0


# language model


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})))


def test_base_scores_and_model(spark):
    rng = random.Random(12)
    rows = edge_rows() + [(2000 + k, prose(rng, 150)) for k in range(60)]
    got = mixing.score(frame(spark, rows)).toPandas()
    train = [t for d, t in rows if FOLD("" if d is None else d, 10) != 0]
    c = Counter(w for t in train for w in words(t))
    c[0] = len(train)
    n, v = sum(c.values()), len(c)
    want = Counter()
    for d, t in rows:
        tokens = words(t) + [0]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        want[(d, FOLD("" if d is None else d, 10) == 0, len(tokens), sum(c[w] > 0 for w in tokens), n, round(base, 6))] += 1
    have = Counter((None if np.isnan(r.doc_id) else int(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got.itertuples())
    assert have == want
    new = got[(got.doc_id >= 2000) & got.held_out]
    assert len(new) and (new.score < 0).all()
    assert -new.score.sum() / math.log10(2) / new.n_bytes.sum() < 3.5  # 25 syllables, two letters each, are 2.3 bits a byte
    assert np.isfinite(got.score).all()


def test_empty_corpus_and_nothing_to_learn_from(spark):
    assert mixing.score(frame(spark, [])).count() == 0
    lonely = next(k for k in range(100) if FOLD(k, 10) == 0)
    row = mixing.score(frame(spark, [(lonely, "held out alone")])).first()
    assert row["held_out"] and row["n_known"] == 0 and row["train_tokens"] == 0 and row["score"] < 0


@pytest.fixture(scope="module")
def small_model():
    rng = random.Random(1)
    units = Counter(u for _ in range(30) for u in mixing.units_of(prose(rng, 80).encode()))
    names, n = list(units), np.array(list(units.values()))
    code = mixing.Code(mixing.pair_counts(names, n))
    tables = []
    slots, bits, first, _ = mixing.decisions(names, code)
    weight = np.repeat(n, np.diff(np.append(first, len(bits))))
    for k, width in enumerate(mixing.TABLE_BITS):
        sums = np.bincount(slots[k] * 2 + bits, weights=weight, minlength=2 << width).reshape(-1, 2)
        tables.append((mixing.level_of(sums[:, 0]).astype(np.uint16) << 8) | mixing.level_of(sums[:, 1]))
    return code, tables


def test_a_symbols_chances_sum_to_one(small_model):
    """After any start, all next symbols together have probability one, but for the share of the byte that no text has."""
    code, tables = small_model
    rng = np.random.default_rng(2)
    weights = rng.normal(0.3, 0.3, mixing.start_weights().shape).astype(np.float32)

    def chance(unit, here):
        """Product of the chances of the decisions at one place, per sharpness."""
        slots, bits, _, place = mixing.decisions([unit], code)
        x, gate = mixing.inputs(slots, bits, place, tables)
        z = np.clip(np.rint(mixing.mix(x, gate, weights) / mixing.STEP), -mixing.STEPS, mixing.STEPS) * mixing.STEP
        z = np.where(bits == 1, z, -z)[place == here]
        return np.array([np.prod(1 / (1 + np.exp(-sharp * z))) for sharp in mixing.SHARP])

    for start in (b"", b"ba", b"\xffDob", b"zzzzzzz"):
        # a unit without white space carries the end mark at its own end
        following = [start + bytes([s]) for s in range(255)] + [start]
        total = sum(chance(unit, len(start)) for unit in following)
        assert np.all(total <= 1 + 1e-6) and np.all(total > 0.95)


def test_code_lengths_are_sums_of_chances(small_model):
    code, tables = small_model
    units = [b"bado ", b"\xffKila.\n", b"", b"zuta"]
    together = mixing.code_lengths(units, code, tables, mixing.start_weights())
    alone = np.concatenate([mixing.code_lengths([u], code, tables, mixing.start_weights()) for u in units])
    assert np.allclose(together, alone) and (together < 0).all()


def test_adapting_never_adds_probability():
    """Over all rows of three units out of two, chances sum to at most one."""
    lengths = np.log2(np.array([[0.6, 0.5, 0.55], [0.4, 0.5, 0.45]]))
    total = 0
    for a in range(2):
        for b in range(2):
            for c in range(2):
                unit = np.array([a, b, c])
                total += 2.0 ** mixing.adapted(lengths[unit], unit, np.array([0, 3]))[0]
    assert 0.9 < total <= 1 + 1e-9


def test_order_of_units_counts():
    """What followed a unit before is expected behind it again: a text that repeats its order costs less than the same units shuffled."""
    lengths = np.full((8, 3), -10.0)
    ordered = np.tile(np.arange(8), 30)
    mixed_up = np.random.default_rng(4).permutation(ordered)
    first = np.array([0, 240])
    assert mixing.adapted(lengths[ordered], ordered, first)[0] > 0.7 * mixing.adapted(lengths[mixed_up], mixed_up, first)[0]
    # Chances of all next units sum to one at most, whatever came before; texts beside each other do not touch.
    start = [0, 1, 0, 1, 1, 0]
    lengths = np.log2(np.array([[0.6, 0.5, 0.55], [0.4, 0.5, 0.45]]))
    base = mixing.adapted(lengths[start], np.array(start), np.array([0, 6]))[0]
    total = 0
    for k in (0, 1):
        unit = np.array([*start, k, 0, 1, 0])
        both = mixing.adapted(lengths[unit], unit, np.array([0, 7, 10]))
        total += 2.0 ** (both[0] - base)
        assert np.isclose(both[1], mixing.adapted(lengths[[0, 1, 0]], np.array([0, 1, 0]), np.array([0, 3]))[0])
    assert 0.9 < total <= 1 + 1e-9


def spelled(rng, count):
    """(word, unit, block, n) rows: many words that begin alike, in several spellings and blocks."""
    rows = []
    for _ in range(count):
        word = rng.choice(["inter", "interest", "interestingly" * 3, "Intern", "in", ""]) + "".join(rng.choices("ab", k=rng.randrange(4)))
        unit = (rng.choice(["", "\xff"]).encode("latin-1")) + word.encode() + rng.choice([b" ", b"\n", b""])
        rows += [(bytearray(mixing.word_of(unit)), bytearray(unit), block, rng.randrange(3)) for block in rng.sample(range(5), 2)]
    return list({(bytes(r[1]), r[2]): r for r in rows}.values())


@pytest.mark.parametrize("many", [1 << 18, 20, 0])
def test_whole_unit_counts_lie_beside_the_units(spark, many):
    """Every start of a unit that its group does not have in common has the counts of all units, however the rows were grouped."""
    shared.ship(spark)
    rows = spelled(random.Random(5), 400)
    frame_ = spark.createDataFrame(rows, "word binary, unit binary, block int, n long").repartition(4)
    counts = mixing.symbol_counts(frame_)
    code = mixing.code_of(counts)
    got = mixing.vocabulary(frame_, counts, many).collect()
    total, of_word, blocks = Counter(), Counter(), {}
    for word, unit, block, n in rows:
        total[bytes(unit)] += n
        of_word[bytes(word)] += n
        blocks.setdefault(bytes(unit), []).append(block)
    want = {u: (total[u], of_word[mixing.word_of(u)] if mixing.word_of(u) else -1, sorted(blocks[u])) for u in blocks}
    assert {bytes(r["unit"]): (r["n"], r["c"], sorted(r["blocks"])) for r in got} == want and len(got) == len(want)
    assert sum(r["c"] for r in got if r["leads"] and r["c"] > 0) == sum(c for w, c in of_word.items() if w)
    # Counts of a unit so far: by the symbols before a decision and the decisions of the symbol up to it.
    seen, decided = Counter(), {}
    for unit in blocks:
        symbols, _ = mixing.symbols_of([unit])
        _, bits, _, place = mixing.decisions([unit], code)
        path, decided[unit] = (), []
        for k, (bit, at) in enumerate(zip(bits.tolist(), place.tolist(), strict=True)):
            path = (path if k and place[k - 1] == at else ())
            decided[unit].append((tuple(symbols[:at].tolist()), path, at))
            seen[(*decided[unit][-1][:2], bit)] += total[unit]
            path += (bit,)
    known = 0
    for row in got:
        own = np.frombuffer(bytes(row["own"]), dtype=np.uint16)
        assert len(own) == len(decided[bytes(row["unit"])])
        for have, (start, path, at) in zip(own.tolist(), decided[bytes(row["unit"])], strict=True):
            if have == mixing.UNKNOWN:
                assert many < 1 << 18 or at < 4
                continue
            known += 1
            zeros, ones = mixing.level_of(np.array([seen[(start, path, 0)], seen[(start, path, 1)]])).tolist()
            assert at >= 4 and have == zeros << 8 | ones
    assert known > 0 or many == 0


@pytest.mark.parametrize("many", [20, 2, 0])
def test_counts_beside_units_do_not_depend_on_the_groups(spark, many):
    """Starts that several groups share have the counts of all of them, at every length."""
    shared.ship(spark)
    rows = spelled(random.Random(6), 400) + [(bytearray(b"a" * 40), bytearray(b"a" * 40 + end), block, 2) for end in (b" ", b"", b"\n") for block in range(5)]
    frame_ = spark.createDataFrame(rows, "word binary, unit binary, block int, n long").repartition(4)
    counts = mixing.symbol_counts(frame_)

    def beside(many):
        return {tuple(bytes(x) if isinstance(x, bytearray) else tuple(sorted(x)) if isinstance(x, list) else x for x in r) for r in mixing.vocabulary(frame_, counts, many).collect()}

    assert beside(many) == beside(1 << 18)


def test_rows_per_decision_are_not_gathered_on_the_driver(spark, monkeypatch):
    """Counts of shared starts are looked up by a join that sends no side as a whole, however small the file of heads is."""
    shared.ship(spark)
    rows = spelled(random.Random(6), 200)
    frame_ = spark.createDataFrame(rows, "word binary, unit binary, block int, n long").repartition(4)
    plans, stored = [], shared.stored

    def noting(df, name, *more):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, name, *more)

    monkeypatch.setattr(shared, "stored", noting)
    mixing.vocabulary(frame_, mixing.symbol_counts(frame_), 20).count()
    looked_up = [plan for plan in plans if "MapInArrow asked(" in plan]
    assert len(looked_up) == 1 and "BroadcastHashJoin [slot" not in looked_up[0] and "SortMergeJoin [slot" in looked_up[0]


def test_groups_grow_deeper_only_where_they_are_too_large(spark):
    rows = [(b"common%03d" % k, b"", 0, 1) for k in range(50)] + [(b"rare%d" % k, b"", 0, 1) for k in range(5)] + [(b"comet", b"", 0, 1), (b"com", b"", 0, 1)]
    frame_ = spark.createDataFrame([(bytearray(w), bytearray(u), b, n) for w, u, b, n in rows], "word binary, unit binary, block int, n long")
    got = {(bytes(r["word"]), bytes(r["key"]), r["deep"]) for r in mixing.keyed(frame_, 10).collect()}
    assert {(w, k, d) for w, k, d in got if w.startswith(b"rare")} == {(b"rare%d" % k, b"rar", 4) for k in range(5)}
    assert (b"comet", b"comet", 8) in got and (b"com", b"com", 8) in got and (b"common001", b"common0", 8) not in got
    assert (b"common001", b"common001", 16) in got and len(got) == len(rows)


def test_tables_hold_the_sums_of_all_units(spark):
    shared.ship(spark)
    rows = spark.range(0, 20_000, 1, 4).selectExpr("unhex(substr(sha2(string(id), 256), 1, 24)) as unit", "id % 5 + 1 as n")
    units, n = (list(x) for x in zip(*((bytes(r["unit"]), r["n"]) for r in rows.collect()), strict=True))
    counts = mixing.symbol_counts(rows)
    tables = mixing.context_tables(rows, counts)
    assert mixing.bits_of(tables) == mixing.SENT_BITS
    slots, bits, first, _ = mixing.decisions(units, mixing.code_of(counts))
    weight = np.repeat(np.array(n), np.diff(np.append(first, len(bits))))
    for k, width in enumerate(mixing.SENT_BITS):
        sums = np.bincount(slots[k] * 2 + bits, weights=weight, minlength=2 << width).reshape(-1, 2)
        assert np.array_equal(tables[k], (mixing.level_of(sums[:, 0]).astype(np.uint16) << 8) | mixing.level_of(sums[:, 1]))


def test_results_do_not_depend_on_batches(spark):
    """Groups put together from many small batches are those of one large batch."""
    import pyarrow as pa

    keys = sorted(random.Random(3).choices([b"a", b"b", b"c", b"dd", b"e"], k=300))
    batch = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(range(300))], names=["key", "n"])
    for size in (1, 7, 300):
        tables = list(mixing.whole_groups((batch.slice(k, size) for k in range(0, 300, size)), 50))
        assert [x for t in tables for x in t.column("n").to_pylist()] == list(range(300))
        ends = [(t.column("key").to_pylist()[0], t.column("key").to_pylist()[-1]) for t in tables]
        assert all(a[1] != b[0] for a, b in zip(ends[:-1], ends[1:], strict=True))


def test_counts_are_set_beside_units_without_a_python_object_each(spark, monkeypatch):
    counts, rows = mixing.pair_counts([b"aaaaaaab ", b"aaaaaaac "], np.array([2, 3])).tobytes(), []
    for block in range(3):
        rows += [(w, w + b" ", block, block + 1) for w in (b"aaaaaaab", b"aaaaaaac", b"aaaaaaaad", b"bcdefghij", b"b")]
    frame_ = spark.createDataFrame(rows, "word binary, unit binary, block int, n long")
    plain = {bytes(r["unit"]): bytes(r["own"]) for r in mixing.vocabulary(frame_, counts, 100).collect()}
    monkeypatch.setattr(shared, "per_batch", None)
    assert {bytes(r["unit"]): bytes(r["own"]) for r in mixing.vocabulary(frame_, counts, 2).collect()} == plain
