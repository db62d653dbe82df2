"""Result tables: best run per target, and the gain of one data variant over another."""

from pyspark.sql import functions as F


def best_runs(report, by="accuracy", keys=("dataset", "target")):
    """The best model per data set and target; the smaller name wins a tie, NaN counts as worst."""
    score = F.coalesce(F.nanvl(F.col(by), F.lit(None).cast("double")), F.lit(float("-inf")))
    rest = [c for c in report.columns if c not in keys]
    best = report.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(-score, "model")).alias("_b"))
    return best.select(*keys, "_b.*").select(*report.columns)


def compare_runs(report, base, other, by="accuracy"):
    """Score of two data set variants side by side per model and target, with the difference."""
    sides = report.groupBy("model", "target").pivot("dataset", [base, other]).agg(F.max(by))
    return sides.select(
        "model",
        "target",
        F.col(base).alias("base"),
        F.col(other).alias("other"),
        (F.col(other) - F.col(base)).alias("gain"),
    )
