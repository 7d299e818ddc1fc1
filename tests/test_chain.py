"""A locked threshold against all candidates tried one by one."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import chain


def counts(score, target, threshold):
    called = score >= threshold
    return int((called & target).sum()), int((called & ~target).sum()), int((~called & target).sum()), int((~called & ~target).sum())


def dice(tp, fp, fn, _):
    return 1.0 if 2 * tp + fp + fn == 0 else 2 * tp / (2 * tp + fp + fn)


def test_lock_and_evaluation(spark):
    rng = np.random.default_rng(7)
    target = {k: rng.random(n) < 0.3 for k, n in (("c", 90), ("t", 70))}
    score = {k: np.round(rng.normal(size=len(v)) + v, 1) for k, v in target.items()}  # ties
    frames = {k: spark.createDataFrame([(float(s), bool(t)) for s, t in zip(score[k], target[k], strict=True)], "score double, target boolean") for k in target}
    grid = np.unique(np.quantile(score["c"], np.linspace(0, 1, 17)))
    got = {r.threshold: (r.tp, r.fp, r.fn, r.tn) for r in chain.candidate_counts(frames["c"], [*grid.tolist(), 99.0]).collect()}
    assert got == {x: counts(score["c"], target["c"], x) for x in [*grid.tolist(), 99.0]}
    best = max(grid, key=lambda x: (round(dice(*got[x]), 12), got[x][0] / max(1, sum(got[x][:2])), x))
    assert chain.lock(frames["c"], 17) == (pytest.approx(best), pytest.approx(dice(*got[best])))
    row = chain.evaluate(frames["c"], frames["t"].unionByName(spark.createDataFrame([(None, True)], "score double, target boolean")), 17).first()
    expected = counts(score["t"], target["t"], best)
    assert (row.tp, row.fp, row.fn, row.tn, row.abstained) == (*expected, 1) and row.dice == pytest.approx(dice(*expected))
    wins = [(a > b) + (a == b) / 2 for a in score["t"][target["t"]] for b in score["t"][~target["t"]]]
    assert row.auroc == pytest.approx(np.mean(wins))
    with pytest.raises(ValueError, match="no scores"):
        chain.lock(frames["c"].where(F.lit(False)))
