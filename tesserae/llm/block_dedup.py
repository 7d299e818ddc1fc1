"""Exact de-duplication by deterministic block naming.

Texts are cut into blocks of a fixed size. The distinct blocks are sorted and numbered; a text is then a row of
integers. Adjacent numbers are paired, the distinct pairs sorted and numbered in turn, and so on until each text has
one number. Equal numbers of a level mean equal texts: contents are compared, never their digests alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep


def _numbered(distinct: DataFrame, *by: str) -> DataFrame:
    """A number for each distinct row: its partition's, then its place in the partition's order."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


@dataclass(frozen=True)
class BlockNames:
    """``block`` bytes of UTF-8 a block. ``digest_bits``: of the digest that blocks are looked up by (fewer in tests)."""

    block: int = 4096
    digest_bits: int = 64

    def _blocks(self, texts: DataFrame) -> DataFrame:
        rows = texts.select("rid", "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("data"))
        count = F.greatest(F.lit(1), F.ceil(F.length("data") / self.block).cast("int"))
        rows = rows.select("rid", "doc_id", "data", F.sha2("data", 256).alias("sha"), count.alias("left"))
        cut = F.transform(F.sequence(F.lit(0), F.col("left") - 1), lambda i: F.substring("data", i * self.block + 1, F.lit(self.block)))
        rows = rows.select("rid", "doc_id", "sha", "left", F.posexplode(cut).alias("pos", "content"))
        digest = F.xxhash64("content")
        return rows.withColumn("digest", digest if self.digest_bits >= 64 else F.pmod(digest, F.lit(1 << self.digest_bits)))

    def _first_names(self, texts: DataFrame, rows: DataFrame) -> DataFrame:
        """``rows`` with the names of their blocks. Contents are sorted once, where they are; rows find their names by
        digest, and by content where two contents share a digest."""
        blocks = self._blocks(texts)
        names = keep(_numbered(blocks.select("digest", "content").distinct(), "digest", "content").select("digest", "name"), "names")
        shared = keep(names.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "shared")
        if shared.isEmpty():
            return rows.join(names, "digest").drop("digest")
        alone = rows.join(names.join(shared, "digest", "left_anti"), "digest").drop("digest")
        contents = blocks.join(shared, "digest", "left_semi").select("rid", "pos", "digest", "content")
        named = _numbered(contents.select("digest", "content").distinct(), "digest", "content")
        named = keep(named.withColumn("name", -1 - F.col("name")), "shared-names")
        named = contents.join(named, ["digest", "content"]).select("rid", "pos", "name")
        return alone.unionByName(rows.join(named, ["rid", "pos"]).drop("digest"))

    def identities(self, texts: DataFrame) -> DataFrame:
        """``rid, doc_id, sha, level, name`` of written ``rid, doc_id, text`` rows (``rid`` is distinct): rows with the same
        level and name have the same text. Names are a function of the rows and the number of partitions."""
        rows = keep(self._blocks(texts).select("rid", "doc_id", "sha", "left", "pos", "digest"), "blocks")
        most = rows.agg(F.max("left")).first()[0] or 1
        rows = keep(self._first_names(texts, rows), "level-0")
        done, level = [rows.where("left = 1").withColumn("level", F.lit(0))], 0
        while most > 1:
            most, level = -(-most // 2), level + 1
            side = lambda k: F.max(F.when(F.col("pos") % 2 == k, F.col("name")))
            half = (F.col("pos") / 2).cast("int").alias("pos")
            # a row's last block may stand alone; names of contents are never this number
            pairs = rows.where("left > 1").groupBy("rid", "doc_id", "sha", F.ceil(F.col("left") / 2).cast("int").alias("left"), half)
            pairs = keep(pairs.agg(side(0).alias("a"), F.coalesce(side(1), F.lit(-(1 << 62))).alias("b")), f"pairs-{level}")
            names = keep(_numbered(pairs.select("a", "b").distinct(), "a", "b"), f"names-{level}")
            rows = keep(pairs.join(names, ["a", "b"]).drop("a", "b"), f"level-{level}")
            done.append(rows.where("left = 1").withColumn("level", F.lit(level)))
        return reduce(DataFrame.unionByName, [x.select("rid", "doc_id", "sha", "level", "name") for x in done])

    def _groups(self, texts: DataFrame) -> DataFrame:
        named = keep(self.identities(texts), "identities")
        top = named.groupBy("level", "name").agg(F.max(F.struct("doc_id", "rid")).alias("top"), F.count("*").alias("group_size"))
        return named.join(keep(top, "groups"), ["level", "name"]).withColumn("kept", F.col("rid") == F.col("top.rid"))

    def groups(self, docs: DataFrame) -> DataFrame:
        """``doc_id, keep_id, group_size, kept, text_sha256``, a row for each row of ``docs`` (``doc_id, text``).

        Null counts as the empty text. Of equal texts the row with the largest doc_id stays (null ids are smallest; of
        rows that repeat that id, one stays). Texts of any length and an empty table are fine; other columns are ignored.
        """
        texts = keep(docs.select(F.col("doc_id").cast("long"), "text").withColumn("rid", F.monotonically_increasing_id()), "texts")
        return self._groups(texts).select("doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", "kept", F.col("sha").alias("text_sha256"))

    def distinct(self, docs: DataFrame) -> DataFrame:
        """The rows of ``docs`` that stay, with all their columns."""
        rows = keep(docs.select(F.struct(*docs.columns).alias("doc")).withColumn("rid", F.monotonically_increasing_id()), "rows")
        found = self._groups(rows.select("rid", F.col("doc.doc_id").cast("long").alias("doc_id"), "doc.text"))
        stay = keep(found.where("kept").select("rid"), "stay").hint("merge")  # as many as there are texts: nothing to broadcast
        return rows.join(stay, "rid", "left_semi").select("doc.*")
