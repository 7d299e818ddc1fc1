"""Line de-duplication across documents. DataFrame operations only.

Lines are exploded with their places, normalised and hashed; the documents of each hash are counted; lines of hashes over
the threshold go, and the others are put together again by place.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

_SPACE = " \t\n\x0b\x0c\r"
_NO_ID = -(1 << 63)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, other letters as they are."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


@dataclass(frozen=True)
class LineDedup:
    """Keys of ``least`` code points or more that ``documents`` or more documents hold lose their lines, but in the
    document with the largest id that holds them. ``heavy``: as many keys at most go to all tasks.
    """

    least: int = 20
    documents: int = 3
    heavy: int = 4096

    def _lines(self, docs: DataFrame) -> DataFrame:
        """``id, text_a, text_b, place, a, b``: lines with keys that are long enough. The key and the text stand as two
        hashes of 64 bits each."""
        hashes = lambda x: (F.xxhash64(F.lit(0), x), F.xxhash64(F.lit(1), x))
        text_a, text_b = hashes("text")
        rows = docs.select("id", text_a.alias("text_a"), text_b.alias("text_b"), F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
        rows = rows.select("id", "text_a", "text_b", "place", ascii_lower(F.btrim("line", F.lit(_SPACE))).alias("key"))
        a, b = hashes("key")
        return rows.where(F.length("key") >= self.least).select("id", "text_a", "text_b", "place", a.alias("a"), b.alias("b"))

    def _dropped(self, docs: DataFrame) -> DataFrame:
        """``id, text_a, text_b, dropped``: sorted places of the lines that go, of the documents that lose any.

        A key that many documents hold is compared in all tasks: each of these keys has a ``heavy``-th of all places that
        can go, so that they are ``heavy`` at most. The others are joined by key, and none of them is large.
        """
        lines = self._lines(docs)
        often = lines.groupBy("a", "b").agg(F.count_distinct("id").alias("n"), F.count("*").alias("places"), F.max("id").alias("last"))
        often = keep(often.where(F.col("n") >= self.documents), "lines")
        total = often.agg(F.sum("places")).first()[0] or 0
        heavy = F.col("places") * self.heavy >= total
        known = F.broadcast(often.where(heavy).select("a", "b", F.col("last").alias("last_heavy")))
        lines = lines.join(known, ["a", "b"], "left").where("last_heavy is null or id < last_heavy")
        # lines of heavy keys meet nothing in the join: places of their own deal them out
        apart = lambda x, y: F.when(F.col("last_heavy").isNull(), F.col(x)).otherwise(F.col(y).cast("long")).alias(x)
        lines = lines.select("id", "text_a", "text_b", "place", "last_heavy", apart("a", "text_a"), apart("b", "place"))
        out = lines.join(often.where(~heavy).select("a", "b", "last"), ["a", "b"], "left").where("last_heavy is not null or id < last")
        return out.groupBy("id", "text_a", "text_b").agg(F.array_sort(F.collect_set("place")).alias("dropped"))

    def drop(self, docs: DataFrame) -> DataFrame:
        """``docs`` (``doc_id, text``) with the text that stays in ``text``, and ``n_lines`` (before), ``n_dropped``.

        Lines end at each \\n; null counts as empty, which is one empty line. Rows with equal ids are one document when
        documents are counted, and so are all rows without an id, whose document is the smallest; a row that comes twice
        loses the same lines twice. Equal keys within a document go or stay together. Texts of any length, an empty table
        and other columns, whatever their names, are fine and come out as they are; only columns of the two new names are
        replaced.
        """
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        rows = docs.select(F.struct(*docs.columns).alias("doc"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), text.alias("text"))
        dropped = self._dropped(rows.select("id", "text"))
        rows = rows.withColumns({"text_a": F.xxhash64(F.lit(0), "text"), "text_b": F.xxhash64(F.lit(1), "text")})
        rows = rows.join(dropped.hint("merge"), ["id", "text_a", "text_b"], "left").withColumn("lines", F.split("text", "\n", -1))
        # runs of lines between two places that go
        n, places = F.size("lines"), F.concat(F.array(F.lit(-1)), "dropped", F.array(F.size("lines")))
        run = lambda i: F.slice("lines", F.get(places, i) + 2, F.get(places, i + 1) - F.get(places, i) - 1)
        runs = F.flatten(F.transform(F.sequence(F.lit(0), F.size("dropped")), run))
        kept = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(runs, "\n"))
        found = F.struct(kept.alias("text"), n.cast("long").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"))
        own = [F.col("doc")[x].alias(x) for x in docs.columns if x not in ("text", "n_lines", "n_dropped")]
        return rows.select("doc", found.alias("found")).select(*own, "found.*")
