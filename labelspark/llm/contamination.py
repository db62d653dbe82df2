"""Benchmark decontamination by templates. DataFrame functions only.

Texts become templates: numbers, units after a number and names (capitalised words inside a sentence, a run of them as one) turn into typed
placeholders, everything else into lower-case words. Windows of `window` template tokens of all documents are hashed and joined with those of
the benchmark, so a question is found again after its numbers or names were changed. Windows of placeholders alone say nothing and are left out. The
values in the slots then decide: along one alignment of document and item, a value of the item must always have become the same value of
the document. Alignments that break this are dropped. A document is contaminated by an item if the windows left cover at least `cover` of
the item's tokens that windows reach, or `RUN` of its tokens in a row along one alignment, however long the item is.

Documents are read once: both templates of a text, their token hashes and the hits among their windows come from one scan, and only hits become rows.

Names show by letter case, so a passage in another case has another template. A second route therefore folds the case of documents and items before
numbers and units are marked, and takes names as words; it adds the pairs that templates do not find. A pair that templates found and dropped for its
slots is only added if one alignment covers the whole item.

An item shorter than the window is one window of its own length; one of placeholders alone matches nothing. Null or empty texts have no token and match nothing. Documents with equal ids are
one document here. Rows with null ids are reported under a null id, their slots unchecked; `drop_contaminated` keeps such rows. Empty tables give no
row. Columns besides ids and texts are not read.
"""

from pyspark.sql import functions as F

from labelspark.llm import shared

WINDOW, COVER, RUN = 8, 0.5, 13
#: For so many benchmark windows a bit map picks the likely hits inside the row; beyond it all windows of a text become rows.
SENT_WINDOWS = 1 << 22
#: Bits of the map: `WINDOW_BITS` a window, `MOST_BITS` (2 MB) at most; with more windows more that are no hits become rows.
WINDOW_BITS, MOST_BITS = 32, 1 << 24

#: Units that may follow a number.
UNITS = "km|cm|mm|m|kg|mg|g|ml|l|ms|s|min|h|hours|hour|minutes|minute|seconds|second|days|day|weeks|week|months|month|years|year|miles|mile|feet|inches|dollars|euros|cents|percent|degrees"
NUMBER = r"(\p{Nd}+(?:[.,]\p{Nd}+)*)"
UNIT = rf"(\p{{Nd}} ?)({UNITS})([^\p{{L}}\p{{Nd}}]|$)"
NAME = r"([\p{Ll},;] )(\p{Lu}[\p{L}]*(?: \p{Lu}[\p{L}]*)*)"
# Marks round slot values: unit, number, name; each value ends with the last mark.
U, N, P, END = "\x01", "\x02", "\x03", "\x04"
TOKEN = r"[\x01\x02\x03][^\x04]*\x04|[\p{L}\p{Nd}]+"


def at_once(pattern):
    """The pattern with its closing repeated group taken in one go: the same matches, as nothing follows it, but no call per repetition, of which
    some thousands in a row (names, or a number's parts) overflow the executor's stack and end it."""
    return pattern.replace(")*)", ")*+)")


def marked(text, names=True):
    """The text with its slot values between marks; without `names` its case is folded first and names stay words."""
    plain = F.regexp_replace(text, r"[\x01-\x04]", " ")
    if not names:
        plain = F.lower(F.upper(plain))
    units = F.regexp_replace(plain, UNIT, f"$1 {U}$2{END}$3")
    numbers = F.regexp_replace(units, at_once(NUMBER), f"{N}$1{END}")
    return F.lower(F.regexp_replace(numbers, at_once(NAME), f"$1{P}$2{END}")) if names else numbers


def template_tokens(text, names=True):
    """Words and placeholders: a placeholder is its mark alone."""
    bare = F.regexp_replace(marked(text, names), r"([\x01\x02\x03])[^\x04]*\x04", "$1 ")
    return F.regexp_extract_all(bare, F.lit(r"[\x01\x02\x03]|[\p{L}\p{Nd}]+"), F.lit(0))


def window_hash(hashes, start, size):
    """Hash of the window from the hashes of its tokens."""
    return F.xxhash64(*[F.get(hashes, start + k) for k in range(size)])


def bound(value, use):
    """`use` of a value that is made once, however often it stands in the result."""
    return F.transform(F.array(value), use)[0]


def item_windows(items, window, names=True):
    """(hash, size, item_id, item_pos, n_tokens) of every window with a word in it."""
    tokens = items.withColumn("tokens", template_tokens(F.col("text"), names)).where(F.size("tokens") > 0)
    sized = tokens.withColumn("hashes", F.transform("tokens", lambda t: F.xxhash64(t))).withColumn("size", F.least(F.size("tokens"), F.lit(window)))
    out = sized.withColumn("item_pos", F.explode(F.sequence(F.lit(0), F.size("tokens") - F.col("size"))))
    out = out.where(F.exists(F.slice("tokens", F.col("item_pos") + 1, F.col("size")), lambda t: F.ascii(t) >= 4))
    # one branch for items of all lengths: a union of one per length would repeat the whole template in the plan
    hashes = [F.when(F.col("size") == size, window_hash(F.col("hashes"), F.col("item_pos"), size)) for size in range(1, window + 1)]
    out = out.select("item_id", "item_pos", F.coalesce(*hashes).alias("hash"), "size")
    # what windows with a word can reach: all of an item but for long rows of placeholders
    reached = out.withColumn("token", F.explode(F.sequence(F.col("item_pos"), F.col("item_pos") + F.col("size") - 1)))
    return out.join(reached.groupBy("item_id").agg(F.count_distinct("token").cast("int").alias("n_tokens")), "item_id")


def places(value, size):
    """The two places of a window's hash in a map of `size` bits."""
    return F.pmod(value, F.lit(size)).cast("int"), F.pmod(F.shiftrightunsigned(value, 32), F.lit(size)).cast("int")


def bit_map(wanted, n):
    """(a constant: 64-bit words with two bits set for every wanted hash, bits in all)."""
    size = 64
    while size < min(WINDOW_BITS * n, MOST_BITS):
        size *= 2
    place = wanted.select(F.explode(F.array(*places(F.col("hash"), size))).alias("place"))
    words = place.select(F.shiftright("place", 6).alias("word"), bit_of(F.col("place")).alias("bits"))
    empty = wanted.sparkSession.range(size // 64).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("bigint").alias("bits"))
    words = words.unionByName(empty).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    text = words.groupBy().agg(F.array_join(F.sort_array(F.collect_list(F.struct("word", "bits")))["bits"].cast("array<string>"), ",").alias("text"))
    # one literal for the analyser, which would copy an expression of as many parts again and again in the driver's memory
    return F.split(F.lit(text.first()["text"]), ",").cast("array<bigint>"), size


def bit_of(place):
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(63))


def hits(hashes, bits, size, window):
    """(size, doc_pos, hash) of a text's windows whose bit is set; all of them without a bit map."""
    found = F.transform(
        F.sequence(F.lit(0), F.size(hashes) - window), lambda i: F.struct(F.lit(window).alias("size"), i.alias("doc_pos"), window_hash(hashes, i, window).alias("hash"))
    )
    if size:
        is_set = lambda place: F.get(bits, F.shiftright(place, 6)).bitwiseAND(bit_of(place)) != 0
        found = F.filter(found, lambda w: is_set(places(w["hash"], size)[0]) & is_set(places(w["hash"], size)[1]))
    return F.when(F.size(hashes) >= window, found).otherwise(F.array().cast("array<struct<size:int,doc_pos:int,hash:bigint>>"))


def route_hits(names, windows, bits, size):
    """(names, size, doc_pos, hash) of a text's likely hits by one route, for windows of the given sizes."""
    hashes = F.transform(template_tokens(F.col("text"), names), lambda t: F.xxhash64(t))
    found = bound(hashes, lambda h: F.concat(*[hits(h, bits, size, window) for window in windows]))
    return F.transform(found, lambda w: F.struct(F.lit(names).alias("names"), w["size"].alias("size"), w["doc_pos"].alias("doc_pos"), w["hash"].alias("hash")))


def matching(docs, items, window):
    """(names, doc_id, item_id, size, n_tokens, item_pos, shift): the windows of both routes, with and without names, that a document shares."""
    wanted = [item_windows(items, window, names).withColumn("names", F.lit(names)) for names in (True, False)]
    wanted = shared.stored(wanted[0].unionByName(wanted[1]), "item-windows")
    sizes = [tuple(r) for r in wanted.groupBy("names", "size").agg(F.count(F.lit(1))).collect()]  # two times eight rows at most
    if not sizes:
        return None
    n, bits, size = sum(k for _, _, k in sizes), F.lit(None).cast("array<bigint>"), 0
    if n <= SENT_WINDOWS:
        bits, size = bit_map(wanted, n)
    routes = {names: sorted(k for route, k, _ in sizes if route == names) for names in (True, False)}
    found_by = lambda b: F.concat(*[route_hits(names, windows, b, size) for names, windows in routes.items() if windows])
    rows = docs.select("doc_id", F.explode(bound(bits, found_by)).alias("w")).select("doc_id", "w.*")
    found = rows.join(wanted, ["names", "size", "hash"])
    return shared.stored(found.select("names", "doc_id", "item_id", "size", "n_tokens", "item_pos", (F.col("doc_pos") - F.col("item_pos")).alias("shift")), "template-matches")


def slots(rows, id_col, names=True):
    """(id, pos, value): the slot values of texts at their token positions."""
    tokens = F.regexp_extract_all(marked(F.col("text"), names), F.lit(TOKEN), F.lit(0))
    placed = F.filter(F.transform(tokens, lambda t, k: F.struct(k.alias("pos"), t.alias("value"))), lambda t: F.ascii(t["value"]) < 4)
    return rows.select(id_col, F.explode(placed).alias("slot")).select(id_col, "slot.*")


def alignments(docs, items, matches, names=True):
    """(doc_id, item_id, shift, n_tokens, size, starts, consistent, same) of every alignment with a matching window."""
    # An alignment has at most as many window starts as its item has tokens.
    aligned = matches.groupBy("doc_id", "item_id", "shift", "n_tokens", "size").agg(F.collect_set("item_pos").alias("starts"))
    hit = matches.select("doc_id").distinct()
    doc_slots = slots(docs.join(hit, "doc_id", "left_semi"), "doc_id", names).distinct()
    item_slots = slots(items, "item_id", names)
    under = matches.join(item_slots, "item_id").where((F.col("pos") >= F.col("item_pos")) & (F.col("pos") < F.col("item_pos") + F.col("size")))
    pairs = under.select("doc_id", "item_id", "shift", F.col("value").alias("asked"), (F.col("pos") + F.col("shift")).alias("pos")).distinct()
    pairs = pairs.join(doc_slots, ["doc_id", "pos"])
    became = pairs.groupBy("doc_id", "item_id", "shift", "asked").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    verdict = became.groupBy("doc_id", "item_id", "shift").agg(
        F.bool_and(F.col("low") == F.col("high")).alias("consistent"), F.bool_and((F.col("low") == F.col("asked")) & (F.col("high") == F.col("asked"))).alias("same")
    )
    keys = [aligned[c].eqNullSafe(verdict[c]) for c in ("doc_id", "item_id", "shift")]
    return aligned.join(verdict, keys, "left").select(
        *(aligned[c] for c in aligned.columns), F.coalesce("consistent", F.lit(True)).alias("consistent"), F.coalesce("same", F.lit(True)).alias("same")
    )


def longest_run(tokens):
    """Length of the longest row of neighbours in a sorted array of distinct numbers."""
    start = F.struct(F.lit(-2).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(state, t):
        run = F.when(t == state["last"] + 1, state["run"] + 1).otherwise(1)
        return F.struct(t.alias("last"), run.alias("run"), F.greatest(state["most"], run).alias("most"))

    return F.aggregate(tokens, start, step, lambda state: state["most"])


def covering(aligned, cover):
    """(doc_id, item_id, consistent, n_windows, covered, exact_slots, whole) of the pairs whose alignments, consistent or not, cover enough.

    `whole`: one alignment covers the item.
    """
    token = F.array_sort(F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + F.col("size") - 1)))))
    aligned = shared.stored(aligned.withColumn("tokens", token).withColumn("run", longest_run(F.col("tokens"))), "alignments")
    pair = ["doc_id", "item_id", "consistent"]
    tokens = aligned.select(*pair, "n_tokens", F.explode("tokens").alias("token"), "same")
    per_shift = tokens.groupBy(*pair, "n_tokens", "token").agg(F.bool_or("same").alias("same"))
    total = per_shift.groupBy(*pair, "n_tokens").agg(F.count("*").alias("n_covered"), F.bool_and("same").alias("exact_slots"))
    starts = aligned.groupBy(*pair).agg(
        F.sum(F.size("starts")).alias("n_windows"), F.bool_or(F.size("tokens") == F.col("n_tokens")).alias("whole"), F.max("run").alias("run")
    )
    both = total.join(starts, [total[c].eqNullSafe(starts[c]) for c in pair])
    return both.where((F.col("n_covered") >= cover * F.col("n_tokens")) | (F.col("run") >= RUN)).select(
        *(total[c] for c in pair), "n_windows", (F.col("n_covered") / F.col("n_tokens")).alias("covered"), "exact_slots", "whole"
    )


def leaks(docs, items, window=WINDOW, cover=COVER, id_col="doc_id", text_col="text", item_col="item_id", item_text="text"):
    """(doc_id, item_id, n_windows, covered, exact_slots) of every contaminated document and its items.

    `covered`: share of the item's tokens under matching windows; `exact_slots`: no slot value was changed.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), shared.text_or_empty(text_col).alias("text"))
    items = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item_id"), shared.text_or_empty(item_text).alias("text"))
    matches, found = matching(docs, items, window), None
    if matches is None:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, n_windows bigint, covered double, exact_slots boolean")
    for names in (True, False):
        aligned = alignments(docs, items, matches.where(F.col("names") == names), names)
        part = covering(aligned, cover).withColumn("names", F.lit(names))
        found = part if found is None else found.unionByName(part)
    best = lambda kind: F.max(F.when(kind, F.struct("n_windows", "covered", "exact_slots", "whole")))
    by_pair = found.groupBy("doc_id", "item_id").agg(
        best(F.expr("names and consistent")).alias("template"), F.bool_or(F.expr("names and not consistent")).alias("rejected"),
        best(F.expr("not names and consistent")).alias("folded"),
    )
    by_pair = by_pair.withColumn("hit", F.coalesce("template", F.when(~F.col("rejected") | F.col("folded.whole"), F.col("folded"))))
    return by_pair.where(F.col("hit").isNotNull()).select("doc_id", "item_id", "hit.n_windows", "hit.covered", "hit.exact_slots")


def drop_contaminated(docs, items, **options):
    """The rows of `docs` without a leak, all columns."""
    id_col = options.get("id_col", "doc_id")
    hit = shared.stored(leaks(docs, items, **options).select(F.col("doc_id").alias("_leak")), "leaks").distinct()
    return docs.join(hit, docs[id_col] == hit["_leak"], "left_anti")
