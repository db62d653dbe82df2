"""Scalar derivations: label flags, label lists, targets, arrays, masked spellings, probabilities."""

from functools import reduce
from operator import add, or_

from pyspark.sql import functions as F


def label_from_value(c, positive):
    """1 where the gold string equals `positive`, else 0; null counts as not positive."""
    return F.coalesce((c == F.lit(positive)).cast("int"), F.lit(0))


def map_values(c, mapping):
    """Dictionary lookup; a value without an entry becomes null."""
    pairs = [F.lit(x) for key, value in mapping.items() for x in (key, value)]
    return F.try_element_at(F.create_map(*pairs), c)


def normalise_target(c):
    """Trimmed, spaces as hyphens, missing as 'Other'."""
    trimmed = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.coalesce(F.replace(trimmed, F.lit(" "), F.lit("-")), F.lit("Other"))


def severity_label(target, level):
    """Target and severity in one label; rows without a level are 'Level 0'."""
    return F.concat_ws(" ", target, F.coalesce(level, F.lit("Level 0")))


def any_flag(columns):
    """1 when one of the flag columns is positive."""
    total = reduce(add, [F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in columns])
    return (total > 0).cast("int")


def flag_groups(columns):
    """Flag columns by the second '_' part of their names: {'race': ['target_race_asian', ...]}."""
    groups = {}
    for name in columns:
        parts = name.split("_")
        groups.setdefault(parts[1] if len(parts) > 1 else name, []).append(name)
    return dict(sorted(groups.items()))


def has_any_label(columns):
    """Predicate: at least one of the columns equals 1."""
    return reduce(or_, [F.col(c) == 1 for c in columns])


def labels_array(columns):
    """Names of the columns that equal 1, sorted by name."""
    return F.array_compact(F.array(*[F.when(F.col(c) == 1, F.lit(c)) for c in sorted(columns)]))


def labels_string(columns):
    """The same names, comma-joined."""
    return F.concat_ws(",", labels_array(columns))


def first_k(texts, k):
    """First k elements; null counts as empty."""
    return F.slice(F.coalesce(texts, F.array().cast("array<string>")), 1, k)


def drop_elements_containing(texts, term):
    """Elements without the term, upper and lower case alike."""
    return F.filter(texts, lambda x: ~F.contains(F.lower(x), F.lit(term.lower())))


def unmask(c, spellings):
    """Replaces masked spellings in the given order; the asterisk is literal, case does not matter."""
    for masked, plain in spellings.items():
        c = F.regexp_replace(c, "(?iu)" + _literal(masked), plain.replace("\\", "\\\\").replace("$", "\\$"))
    return c


def _literal(text):
    return "".join("\\" + ch if ch in "\\^$.|?*+()[]{}" else ch for ch in text)


def argmax(scores):
    """Index of the first largest element."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def softmax(logits):
    """Probabilities of a logit array."""
    n = F.size(logits)
    shifted = F.zip_with(logits, F.array_repeat(F.array_max(logits), n), lambda x, top: F.exp(x - top))
    total = F.aggregate(shifted, F.lit(0.0), lambda acc, x: acc + x)
    return F.zip_with(shifted, F.array_repeat(total, n), lambda x, t: x / t)
