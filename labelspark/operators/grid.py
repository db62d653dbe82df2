"""Every text with every target, kept in factors: the texts, the targets, and the cells that are not zero.

A corpus of T texts and K targets has T * K cells, nearly all zero. Its factors have T + K rows and one per other cell; counts and wide tables are
made from them without the product. Only `unfolded` writes a row per cell, by id: texts are joined where a result is written.
"""

from pyspark.sql import functions as F

from labelspark.operators.lookup import pair_all
from labelspark.session import written


class Grid:
    """`texts` (id, text and what else is kept), `targets` (target), `cells` (id, target, value) of values other than zero."""

    def __init__(self, texts, targets, cells, id_col):
        self.texts, self.targets, self.cells, self.id_col = texts, targets, cells, id_col

    @classmethod
    def of_rows(cls, df, order, text="text", target="target", id_col="text_id"):
        """From long rows (text, target, value): the last value other than zero of a text and target in `order` counts.

        The id of a text is its md5; the texts and the cells are written once.
        """
        rows = df.withColumn(id_col, F.md5(text))
        # one row per text without sorting texts: the md5 stands for it
        texts = written(rows.groupBy(id_col).agg(F.first(text).alias(text)), "grid-texts")
        cells = rows.where(F.col("value") != 0).groupBy(id_col, F.col(target).alias("target")).agg(F.max_by("value", order).alias("value"))
        targets = rows.select(F.col(target).alias("target")).where(F.col(target).isNotNull()).distinct()
        return cls(texts, targets, written(cells.where("target is not null"), "grid-cells"), id_col)

    @classmethod
    def of_types(cls, df, id_col, keep=(), types="types"):
        """From rows with an array of types, one row per id: value 1 where the row has the type."""
        cells = df.select(id_col, F.explode(F.array_distinct(types)).alias("target"), F.lit(1).alias("value"))
        cells = written(cells.where("target is not null"), "grid-cells")
        return cls(df.select(id_col, *keep), cells.select("target").distinct(), cells, id_col)

    def counts(self):
        """(target, value, n) over the whole grid; zeros are what is left of the texts."""
        known = self.cells.groupBy("target", "value").agg(F.count(F.lit(1)).alias("n"))
        used = known.groupBy("target").agg(F.sum("n").alias("_used"))
        texts = written(self.texts.agg(F.count(F.lit(1)).alias("_texts")), "grid-size")
        zeros = self.targets.join(used, "target", "left").withColumn("_texts", texts.scalar())
        zeros = zeros.select("target", F.lit(0).alias("value"), (F.col("_texts") - F.coalesce("_used", F.lit(0))).alias("n")).where("n > 0")
        return known.unionByName(zeros)

    def _own(self, ids):
        """The given rows with a map of the text's own cells."""
        own = self.cells.groupBy(self.id_col).agg(F.map_from_entries(F.collect_list(F.struct("target", "value"))).alias("_own"))
        return ids.join(own, self.id_col, "left")

    def wide(self, targets):
        """One row per text, one column per listed target."""
        cells = [F.coalesce(F.try_element_at("_own", F.lit(t)), F.lit(0)).alias(t) for t in targets]
        return self._own(self.texts).select(*self.texts.columns, *cells)

    def unfolded(self):
        """(id, target, value): a row per cell, zeros too."""
        pairs = pair_all(self._own(self.texts.select(self.id_col)), self.targets, "target")
        return pairs.select(self.id_col, "target", F.coalesce(F.try_element_at("_own", F.col("target")), F.lit(0)).alias("value"))

    def with_texts(self, rows):
        """Rows by id with the texts attached: what a result needs at its end."""
        return rows.join(self.texts, self.id_col)
