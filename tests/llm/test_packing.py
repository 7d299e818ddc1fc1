"""Choices and padding of the vector packer."""

from __future__ import annotations

import random

import pytest

from tesserae.llm import packing
from tesserae.llm.packing import VectorPacker, loss_tokens


def plain(items, tokens, segments, loss, pool):
    """The same heuristic over plain lists: the waiting piece with the largest dot product that fits, else the best cut."""
    out, waiting, bin_ = [], [], []

    def left():
        return tokens - sum(x[3] - x[2] for x in bin_), segments - len(bin_), loss - sum(map(loss_tokens, bin_))

    def close():
        nonlocal bin_
        flat = [(x[0], x[2] + k) for x in bin_ for k in range(x[3] - x[2])]
        while flat:
            size = tokens if len(flat) >= tokens else 1 << (len(flat).bit_length() - 1)
            out.append(flat[:size])
            flat = flat[size:]
        bin_ = []

    def step():
        t, s, free = left()
        if t < 1 or s < 1:
            return close()
        dot = lambda x: (x[3] - x[2]) / tokens * t / tokens + loss_tokens(x) / loss * free / loss
        fit = [x for x in waiting if x[3] - x[2] <= t and loss_tokens(x) <= free]
        room = lambda x: min(t, x[3] - x[2] - loss_tokens(x) + free)
        can = fit or [x for x in waiting if room(x) >= 1]
        if not can:
            return close()
        best = max(can, key=dot)
        i = waiting.index(best)
        if fit:
            bin_.append(best)
            last = waiting.pop()
            if i < len(waiting):
                waiting[i] = last
        else:
            end = best[2] + room(best)
            bin_.append((*best[:3], end, best[4]))
            waiting[i] = (*best[:2], end, *best[3:])
        if left()[0] < 1:
            close()

    for x in items:
        waiting.append(x)
        while len(waiting) >= pool:
            step()
    while waiting:
        step()
    close()
    return out


@pytest.mark.parametrize(("tokens", "segments", "loss"), [(64, 100, 64), (64, 3, 64), (64, 100, 40), (128, 4, 70)])
def test_packs_as_the_plain_heuristic_does(tokens, segments, loss):
    draw = random.Random(tokens + segments + loss)
    items = [(k, b"", 0, n, draw.randint(0, n)) for k, n in enumerate(draw.choices(range(1, 61), k=300))]
    out = []
    packer = VectorPacker(tokens, segments, loss, lambda s: out.append([(x[0], x[2] + k) for x in s for k in range(x[3] - x[2])]), pool=16)
    for x in items:
        packer.add(x)
    packer.finish()
    assert out == plain(items, tokens, segments, loss, 16)


def test_each_limit_binds():
    draw = random.Random(1)
    items = [(k, b"", 0, n, draw.randint(0, n // 2)) for k, n in enumerate(draw.choices(range(4, 400), k=600))]

    def pack(tokens, segments, loss):
        out = []
        packer = VectorPacker(tokens, segments, loss, out.append)
        for x in items:
            packer.add(x)
        packer.finish()
        return out

    free = pack(1024, 512, 1024)
    assert max(map(len, free)) > 4 and max(sum(map(loss_tokens, s)) for s in free) > 820
    few, light = pack(1024, 4, 1024), pack(1024, 512, 820)
    assert max(map(len, few)) == 4 and max(sum(map(loss_tokens, s)) for s in light) == 820
    full = lambda out: sum(sum(x[3] - x[2] for x in s) == 1024 for s in out) / len(out)
    assert full(free) > 0.95 and full(light) > 0.9


def test_the_query_has_sequences_at_the_limit_on_loss(spark, sf_dir):
    from tesserae.llm import queries

    rows = queries.op4_packing(spark, sf_dir).groupBy("sequence_id").agg({"loss_tokens": "sum", "length": "sum"}).collect()
    assert max(x["sum(loss_tokens)"] for x in rows) == queries.LOSS_TOKENS
    assert all(x["sum(length)"] == 4096 or x["sum(length)"].bit_count() == 1 for x in rows)
    assert sum(x["sum(length)"] for x in rows if x["sum(length)"] == 4096) > 0.9 * sum(x["sum(length)"] for x in rows)
    assert packing.Packing.context == 0.0
