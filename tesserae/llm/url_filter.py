"""URL filter: host and path rules, and for the rest the ratio of two character models. DataFrame operations only.

The models are of variable order: the chance of a character after a context is smoothed by its chance after the
context that is one character shorter, down to single characters. A URL's score is the log ratio of its chances among
rejected and accepted URLs, for each character; scores above a threshold are blocked. Three hosts of four teach the
models, the examples of the others calibrate the threshold.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

START, END = "^", "$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: then up to ``?``, ``#``
    or the end. Both are empty without ``://`` and for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


@dataclass(frozen=True)
class UrlRule:
    """A host with its subdomains, and the beginning of a path: ``example.com/de/``."""

    rule: str
    verdict: str

    def fits(self, host: Column, path: Column) -> Column:
        own, slash, rest = self.rule.partition("/")
        return ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + rest))


@dataclass(frozen=True)
class UrlFilter:
    """``rules``: the longest that fits decides. ``terms`` in a host make a URL an example of rejected ones; URLs without
    them that no rule blocks are examples of accepted ones. Examples are weak labels: the models decide, also on these.

    ``taught``: hex digits of the host's digest, of 16, whose hosts teach the models.

    ``order``: characters of the longest context; ``weight``: of the shorter context's chance, in characters;
    ``alphabet``: characters that are equally likely without any context; ``step``: of the calibrated scores.
    """

    rules: tuple[UrlRule, ...]
    terms: tuple[str, ...]
    order: int = 4
    weight: float = 2.0
    alphabet: int = 256
    step: float = 0.05
    taught: str = "0123456789ab"

    def _rule(self, value: str) -> Column:
        host, path = F.col("host"), F.col("path")
        out = F.lit(None).cast("string")
        for rule in sorted(self.rules, key=lambda x: (len(x.rule), x.rule)):
            out = F.when(rule.fits(host, path), F.lit(getattr(rule, value))).otherwise(out)
        return out

    def _chances(self, grams: DataFrame) -> DataFrame:
        """``gram, ratio``: log ratio of each gram's last character after the rest; ``grams``: gram, accepted, rejected."""
        below = None
        for k in range(self.order + 1):
            level = grams.groupBy(F.substring("gram", self.order + 1 - k, k + 1).alias("gram"))
            level = level.agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))
            context = Window.partitionBy(F.substring("gram", 1, k))
            level = level.select("*", *[F.sum(x).over(context).alias(f"{x}_all") for x in ("accepted", "rejected")])
            if below is None:
                less = {x: F.lit(1.0 / self.alphabet) for x in ("accepted", "rejected")}
            else:
                level = level.join(below, F.substring(level["gram"], 2, k) == below["shorter"])
                less = {x: F.col(f"{x}_chance") for x in ("accepted", "rejected")}
            chance = [((F.col(x) + self.weight * less[x]) / (F.col(f"{x}_all") + self.weight)).alias(f"{x}_chance") for x in less]
            below = level.select(F.col("gram").alias("shorter"), *chance)
        return below.select(F.col("shorter").alias("gram"), (F.log("rejected_chance") - F.log("accepted_chance")).alias("ratio"))

    def judge(self, pages: DataFrame) -> DataFrame:
        """``page_id, host, path, rule, verdict, score`` of each ``page_id, url`` row (other columns are ignored).

        The verdict is the rule's, else the models'. A null URL, or one without ``://``, has an empty host and path and
        is allowed; so is every URL if there are no examples of either kind. Repeated rows come out repeated. URLs of any
        length are scored by all their characters; equal scores have equal verdicts.
        """
        host, path = host_and_path(F.col("url"))
        rows = pages.select("page_id", host.alias("host"), path.alias("path"))
        rows = rows.select("*", self._rule("rule").alias("rule"), self._rule("verdict").alias("by_rule"))
        bad = F.col("host").rlike("|".join(self.terms)) if self.terms else F.lit(False)
        good = ~bad & (F.coalesce("by_rule", F.lit("allow")) == "allow") & (F.col("host") != "")
        spelled = F.concat(F.lit(START * self.order), "host", "path", F.lit(END)).alias("spelled")
        texts = rows.select("host", "path", spelled, good.cast("int").alias("good"), bad.cast("int").alias("bad"))
        texts = texts.groupBy("host", "path", "spelled").agg(F.sum("good").alias("accepted"), F.sum("bad").alias("rejected"))
        texts = keep(texts.withColumn("taught", F.substring(F.sha2("host", 256), 1, 1).isin(*self.taught)), "urls")
        places = F.sequence(F.lit(1), F.length("spelled") - self.order)
        spell = F.explode(F.transform(places, lambda i: F.substr("spelled", i, F.lit(self.order + 1)))).alias("gram")
        taught = [F.when(F.col("taught"), F.col(x)).otherwise(0).alias(x) for x in ("accepted", "rejected")]
        grams = texts.select(spell, *taught).groupBy("gram")
        grams = keep(grams.agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")), "grams")
        ratios = keep(self._chances(grams), "ratios")
        # equal rows of a text are many, those of a frequent gram more: both sides are plain, so that Spark splits them
        scores = texts.select("host", "path", spell).join(ratios, "gram").groupBy("host", "path")
        scores = keep(scores.agg(F.floor(F.round(F.avg("ratio"), 9) / self.step).cast("int").alias("bin"), F.avg("ratio").alias("score")), "scores")
        limit = self._limit(texts.join(scores, ["host", "path"]))
        blocked = F.lit(False) if limit is None else (F.col("bin") >= limit) & (F.col("host") != "")
        verdict = F.coalesce("by_rule", F.when(blocked, "block").otherwise("allow")).alias("verdict")
        return rows.join(scores, ["host", "path"]).select("page_id", "host", "path", "rule", verdict, "score")

    def _limit(self, examples: DataFrame) -> int | None:
        """First blocked bin: half way between the median bins of the held-out examples of each kind, which some wrong labels
        do not move. All examples count where a kind has no held-out ones.

        A bin is ``step`` wide and the log ratio of a character is bounded by the counts' logarithm, so bins are few.
        """
        sums = [F.sum(F.when(~F.col("taught"), F.col(x)).otherwise(0)).alias(f"own_{x}") for x in ("accepted", "rejected")]
        bins = examples.groupBy("bin").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"), *sums).orderBy("bin").collect()
        total = lambda kind: sum(x[kind] for x in bins)
        side = "own_" if total("own_accepted") and total("own_rejected") else ""
        middle = []
        for kind in (f"{side}accepted", f"{side}rejected"):
            below, half = 0, total(kind) / 2
            if not half:
                return None
            for x in bins:
                below += x[kind]
                if below >= half:
                    middle.append(x["bin"])
                    break
        return math.ceil(sum(middle) / 2)
