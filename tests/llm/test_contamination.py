"""Benchmark passages, as they are and re-parameterised."""

import random

from fixtures import corpus, frame, prose
from labelspark.llm import contamination

QUESTION = "A train leaves the town at 60 km per hour while Anna Berg walks 12 km towards it, when will Anna Berg meet the train after 60 minutes have gone by"


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def pairs(df):
    return {(r["doc_id"], r["item_id"]): r["exact_slots"] for r in df.collect()}


def test_copies_and_changed_slots(spark):
    rng = random.Random(1)
    changed = QUESTION.replace("60", "75").replace("12", "9").replace("Anna Berg", "Tom")
    mixed_up = QUESTION.replace("60 km", "75 km").replace("12", "9").replace("Anna Berg walks", "Tom walks")
    other_words = QUESTION.replace("train", "boat").replace("walks", "rows").replace("town", "lake").replace("meet", "see").replace("hour", "day")
    rows = [
        (1, prose(rng, 40) + ". " + QUESTION + ". " + prose(rng, 30)),
        (2, prose(rng, 40) + ". " + changed + ". " + prose(rng, 30)),
        (3, prose(rng, 40) + ". " + mixed_up + ". " + prose(rng, 30)),
        (4, prose(rng, 40) + ". " + other_words),
        (5, prose(rng, 200)),
        (6, None),
        (7, ""),
        (8, QUESTION.upper() + " " + prose(rng, 3)),
        (None, QUESTION),
    ]
    found = pairs(contamination.leaks(frame(spark, rows), items(spark, [(9, QUESTION), (10, None), (None, QUESTION), (11, "")])))
    assert found[(1, 9)] is True and found[(2, 9)] is False
    assert (3, 9) not in found and (4, 9) not in found and (5, 9) not in found
    assert (None, 9) in found and found[(8, 9)] is True
    kept = contamination.drop_contaminated(frame(spark, rows), items(spark, [(9, QUESTION)]))
    assert {1, 2}.isdisjoint(r["doc_id"] for r in kept.collect())
    assert {None, 3, 4, 5, 6, 7} <= {r["doc_id"] for r in kept.collect()}


def test_short_items_and_repeated_passages(spark):
    rows = [(1, "so the Short item here it is"), (2, QUESTION + ". " + QUESTION), (3, "short thing")]
    found = pairs(contamination.leaks(frame(spark, rows), items(spark, [(1, "short item here"), (2, QUESTION)])))
    assert (2, 2) in found and (3, 1) not in found


def test_empty_tables(spark):
    docs = frame(spark, corpus(2, 20))
    assert contamination.leaks(docs, items(spark, [])).count() == 0
    assert contamination.leaks(frame(spark, []), items(spark, [(1, QUESTION)])).count() == 0


def test_windows_joined_without_sending(spark, monkeypatch):
    monkeypatch.setattr(contamination, "SENT_WINDOWS", 0)
    found = contamination.leaks(frame(spark, [(1, "Well. " + QUESTION)]), items(spark, [(9, QUESTION)]))
    assert pairs(found) == {(1, 9): True}


def test_passages_in_another_case(spark):
    rng = random.Random(2)
    named = "tell Anna Berg that Tom Hill and Eva Stone met Ida Moor near Bonn and saw Ulm"
    changed = QUESTION.replace("60", "75").replace("12", "9")
    mixed_up = QUESTION.replace("60 km", "75 km").replace("12", "9").replace("Anna Berg walks", "Tom walks")
    rows = [
        (1, prose(rng, 20) + ". " + QUESTION.upper() + ". " + prose(rng, 20)),
        (2, QUESTION.title()),
        (3, prose(rng, 20) + ". " + QUESTION.lower()),
        (4, changed.upper()),
        (5, named.upper() + " " + prose(rng, 3)),
        (6, mixed_up),
        (7, mixed_up + ". " + QUESTION.upper()),
        (8, prose(rng, 60).upper()),
    ]
    found = pairs(contamination.leaks(frame(spark, rows), items(spark, [(9, QUESTION), (10, named)])))
    assert found == {(1, 9): True, (2, 9): True, (3, 9): True, (4, 9): False, (5, 10): True, (7, 9): True}


def test_a_long_run_counts_however_long_the_item_is(spark):
    rng = random.Random(4)
    long = prose(rng, 120)
    words = long.split()
    rows = [(1, prose(rng, 20) + " " + " ".join(words[40:58]) + " " + prose(rng, 20)), (2, prose(rng, 20) + " " + " ".join(words[40:50])), (3, prose(rng, 60))]
    assert {doc for doc, _ in pairs(contamination.leaks(frame(spark, rows), items(spark, [(9, long)])))} == {1}


def test_windows_of_placeholders_alone_do_not_meet(spark):
    numbers = " ".join(str(k) for k in range(400))
    item = "sum up " + " ".join(str(k) for k in range(60))
    both = items(spark, [(9, item), (10, "1 2 3")])
    assert contamination.matching(frame(spark, [(1, numbers)]).select("doc_id", "text"), both, contamination.WINDOW).count() == 0
    assert set(pairs(contamination.leaks(frame(spark, [(1, "1 2 3"), (2, item), (3, numbers)]), both))) == {(2, 9)}


def test_the_bit_map_is_one_literal_wherever_it_is_used(spark):
    words = " ".join(f"word{k}x{k}" for k in range(300))
    wanted = contamination.item_windows(items(spark, [(1, words)]), 8)
    bits, size = contamination.bit_map(wanted, wanted.count())
    made = spark.range(1).select(bits.alias("b"))
    assert size // 64 > 60 and made._jdf.queryExecution().analyzed().toString().count("cast(") <= 2
    assert contamination.item_windows(items(spark, [(1, words)]), 8)._jdf.queryExecution().analyzed().toString().count("Generate") <= 4
    words = made.first()["b"]
    assert len(words) == size // 64
    assert all(words[r["hash"] % size // 64] >> (r["hash"] % size % 64) & 1 for r in wanted.collect())


def test_many_windows_are_picked_inside_the_row(spark, monkeypatch):
    """Over 2^16 benchmark windows: the bit map picks the likely hits, all of them and few others become rows."""
    rng = random.Random(8)
    texts = [prose(rng, 400) for _ in range(100)]
    docs = frame(spark, [(1, prose(rng, 300) + " " + texts[7]), (2, prose(rng, 900))]).select("doc_id", "text")
    used, whole = [], contamination.route_hits

    def noting(names, windows, bits, size):
        used.append(size)
        return whole(names, windows, bits, size)

    monkeypatch.setattr(contamination, "route_hits", noting)
    both = items(spark, list(enumerate(texts)))
    assert sum(contamination.item_windows(both, 8, names).count() for names in (True, False)) > 1 << 16
    assert set(pairs(contamination.leaks(docs, both))) == {(1, 7)}
    assert used and all(used)
    wanted = contamination.item_windows(both, 8)
    bits, size = contamination.bit_map(wanted, wanted.count())
    rows = docs.select(contamination.F.explode(contamination.bound(bits, lambda b: contamination.route_hits(True, [8], b, size))).alias("w")).select("w.hash")
    exact = rows.join(wanted.select("hash").distinct(), "hash", "left_semi").count()
    assert 300 < exact <= rows.count() < exact + 50


def test_only_slots_become_rows(spark):
    rows = [(1, "well, walk 60 km with Anna Berg and 7 others"), (2, "no slot here"), (None, "5"), (3, None)]
    found = contamination.slots(frame(spark, rows).select("doc_id", "text"), "doc_id")
    assert {(r["doc_id"], r["pos"], r["value"][1:-1]) for r in found.collect()} == {(1, 2, "60"), (1, 3, "km"), (1, 5, "anna berg"), (1, 7, "7"), (None, 0, "5")}
    assert "posexplode" not in found._jdf.queryExecution().executedPlan().toString()


def test_long_runs_of_names_and_numbers(spark):
    rows = [(1, "well, " + "Anna " * 20_000 + ". " + QUESTION), (2, "1." * 20_000 + "1 " + QUESTION), (3, "so, " + "Anna Bo Cy " * 3)]
    both = items(spark, [(9, QUESTION), (10, "so, " + "Ida " * 20_000 + "met one two three four five six seven eight nine")])
    assert set(pairs(contamination.leaks(frame(spark, rows), both))) == {(1, 9), (2, 9)}
