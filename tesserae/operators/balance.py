"""Groups dealt to roles of fixed sizes so that the roles' weights are as near as can be to their targets."""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .splits import order_key

#: Groups from which deals are looked for near the relaxed one first, and the most states of that search.
MANY, STATES = 32, 1 << 18


def deviation(sums: list[float], targets: list[float]) -> float:
    return sum(abs(a - b) for a, b in zip(sums, targets, strict=True))


def exchanged(weights: list[float], sizes: list[int], targets: list[float]) -> list[int]:
    """A good deal: groups by weight, each to the role that lacks most; then exchanges of pairs while they help."""
    order = sorted(range(len(weights)), key=lambda i: (-weights[i], i))
    left, sums, role = list(sizes), [0.0] * len(sizes), [0] * len(weights)
    for i in order:
        r = max((r for r in range(len(sizes)) if left[r]), key=lambda r: (targets[r] - sums[r], -r))
        left[r], sums[r], role[i] = left[r] - 1, sums[r] + weights[i], r
    while True:
        best = None
        for i in range(len(weights)):
            for j in range(i + 1, len(weights)):
                x, y, d = role[i], role[j], weights[j] - weights[i]
                if x != y and d:
                    gain = abs(sums[x] + d - targets[x]) + abs(sums[y] - d - targets[y]) - abs(sums[x] - targets[x]) - abs(sums[y] - targets[y])
                    if gain < -1e-9 and (best is None or gain < best[0]):
                        best = (gain, i, j)
        if best is None:
            return role
        _, i, j = best
        d = weights[j] - weights[i]
        sums[role[i]] += d
        sums[role[j]] -= d
        role[i], role[j] = role[j], role[i]


def _relaxed(cost: np.ndarray, v: np.ndarray, sizes: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Prices of a place and of a unit of weight in each role, near the best ones of the relaxed deal: Newton's steps on its dual,
    smoothed less and less. Any prices give a true bound."""
    n, k = cost.shape
    unit = max(1.0, float(np.abs(v).max()))
    x = np.stack([np.ones(n), v / unit], axis=1)
    wanted, prices, heat = np.stack([sizes, sums / unit], axis=1)[:-1], np.zeros((k, 2)), float(n)

    def look(p: np.ndarray) -> tuple[float, np.ndarray]:
        h = (x @ p.T - cost) / heat
        top = h.max(axis=1, keepdims=True)
        e = np.exp(h - top)
        total = e.sum(axis=1, keepdims=True)
        return float((p[:-1] * wanted).sum() - heat * (top + np.log(total)).sum()), e / total

    while heat > 0.2:
        value, share = look(prices)
        for _ in range(20):
            gradient = (wanted - (share.T @ x)[:-1]).ravel()
            if np.abs(gradient).max() < 1e-3:
                break
            curve = _curve(share[:, :-1], x)
            step = np.linalg.lstsq(curve / heat + 1e-9 * np.eye(len(curve)), gradient, rcond=None)[0].reshape(k - 1, 2)
            size = 1.0
            while size > 1e-6:
                new = prices.copy()
                new[:-1] += size * step
                found = look(new)
                if found[0] > value:
                    break
                size /= 2
            else:
                break
            prices, (value, share) = new, found
        heat /= 2
    return prices / [1.0, unit]


def _curve(s: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Covariances of the roles' places and weights."""
    k = s.shape[1]
    blocks = [[(x * (s[:, a] * ((a == b) - s[:, b]))[:, None]).T @ x for b in range(k)] for a in range(k)]
    return np.block(blocks)


def _states(core: list[int], loss: np.ndarray, base: np.ndarray, limit: float, move: Callable[[int, int], int], most: int) -> tuple | None:
    """What groups can change by roles that lose up to ``limit`` in all: sorted numbers, the least loss of each, and a function
    that gives the groups and roles of one. None if they are over ``most``."""
    keys, lost, node = np.zeros(1, np.int64), np.zeros(1), np.full(1, -1)
    chosen: list[tuple[np.ndarray, int, int]] = []  # nodes: their parents, the group and its role
    begins = [0]
    for i in core:
        some = [(keys, lost, node)]
        for r in np.flatnonzero((loss[i] <= limit) & (np.arange(loss.shape[1]) != base[i])):
            able = np.flatnonzero(lost + loss[i, r] <= limit)
            some.append((keys[able] + move(i, r), lost[able] + loss[i, r], begins[-1] + np.arange(len(able))))
            chosen.append((node[able], int(i), int(r)))
            begins.append(begins[-1] + len(able))
        keys, lost, node = (np.concatenate(x) for x in zip(*some, strict=True))
        order = np.lexsort((lost, keys))
        keys = keys[order]
        first = np.concatenate(([True], keys[1:] != keys[:-1]))
        keys, lost, node = keys[first], lost[order][first], node[order][first]
        if len(keys) > most or begins[-1] > 8 * most:
            return None

    def ways(state: int) -> list[tuple[int, int]]:
        at, out = node[state], []
        while at >= 0:
            block = int(np.searchsorted(begins, at, "right")) - 1
            before, i, r = chosen[block]
            out.append((i, r))
            at = before[at - begins[block]]
        return out

    return keys, lost, ways


def near_relaxed(weights: list[float], sizes: list[int], targets: list[float], most: int = STATES) -> list[int] | None:
    """:func:`best_deal` of many groups of whole weights, or None where it cannot be proven in this way.

    No deal is nearer to the targets than the whole sums around them are. Prices of the relaxed deal bound what a deal costs by
    what its groups lose against their cheapest roles: deals that lose up to a limit differ in a few groups from the cheapest
    roles, and all of them are looked at. The limit grows until a deal with such sums costs no more than any beyond it can.
    """
    n, k = len(weights), len(sizes)
    w = np.array(weights)
    low, step = w.min(), np.gcd.reduce(np.rint(w - w.min()).astype(np.int64)) if n else 0
    if k < 2 or k > 6 or not step or (w != np.rint(w)).any() or abs(sum(targets) - w.sum()) > 1e-6:
        return None
    v, places = np.rint((w - low) / step), np.array(sizes, float)
    near = (np.array(targets) - low * places) / step
    # the roles' sums are whole, each next to its target: one that lies farther could give to one that lies on the other side
    ends = [u for u in product(*[sorted({np.floor(x), np.ceil(x)}) for x in near]) if sum(u) == v.sum()]
    if not ends:
        return None
    heavy = np.concatenate(([0.0], np.cumsum(np.sort(v)[::-1])))
    if any(not v.sum() - heavy[n - m] <= max(u[r] for u in ends) or not heavy[m] >= min(u[r] for u in ends) for r, m in enumerate(sizes)):
        return None  # a role's groups are too light or heavy, whichever they are
    far = [float(np.abs(np.array(u) - near).sum()) for u in ends]
    ends = [u for u, x in zip(ends, far, strict=True) if x <= min(far) + 1e-7]
    middle = np.rint(v.mean())
    v, ends = v - middle, [np.array(u) - middle * places for u in ends]
    cost = np.arange(1, n + 1)[:, None] * np.arange(1.0, k + 1)
    prices = _relaxed(cost, v, places, near - middle * places)
    held = cost - prices[:, 0] - v[:, None] * prices[:, 1]
    base = held.argmin(axis=1)
    loss = held - held.min(axis=1, keepdims=True)
    floors = [held.min(axis=1).sum() + (prices[:, 0] * places).sum() + (prices[:, 1] * u).sum() for u in ends]
    # a state: what the roles but the last have more than their cheapest groups, in places and weight, as one number
    span = float(1 << (62 // (2 * (k - 1))))
    digit = np.array([span**j for j in range(2 * (k - 1))])
    code = lambda counts, sums: np.rint(np.stack([counts, sums], -1).reshape(*np.shape(counts)[:-1], -1)).astype(np.int64) @ digit.astype(np.int64)
    count = np.array([(base == r).sum() for r in range(k)])
    have = np.array([v[base == r].sum() for r in range(k)])
    needs = [code((places - count)[:-1], (u - have)[:-1]) for u in ends]
    if any(np.abs(np.concatenate([places - count, u - have])).max() * 2 >= span for u in ends):
        return None
    one, limit = np.eye(k)[:, :-1], 6.0
    while True:
        core = [i for i in np.flatnonzero((loss <= limit).sum(axis=1) > 1)]
        core.sort(key=lambda i: -np.partition(loss[i], 1)[1])
        reach = (limit / max(1e-9, min((np.partition(loss[i], 1)[1] for i in core), default=1.0)), len(core))
        if not np.abs(v[core]).max(initial=1.0) * min(reach) * 2 < span:
            return None
        # two tables, each of every other group, that complete one another
        tables = [_states(some, loss, base, limit, lambda i, r: int(code(one[r] - one[base[i]], (one[r] - one[base[i]]) * v[i])), most) for some in (core[::2], core[1::2])]
        if None in tables:
            return None
        (keys, lost, ways), (others, more, rest) = tables
        found = []
        for u, need, floor in zip(ends, needs, floors, strict=True):
            at = np.minimum(np.searchsorted(others, need - keys), len(others) - 1)
            total = np.where(others[at] == need - keys, lost + more[at], np.inf)
            best = int(total.argmin())
            if total[best] <= limit:
                found.append((round(floor + total[best]), tuple(u), best, int(at[best])))
        if found:
            least, _, mine, its = min(found, key=lambda x: x[:2])
            if least <= min(floors) + limit - 1e-6:
                role = base.tolist()
                for i, r in ways(mine) + rest(its):
                    role[i] = r
                return role
            limit = max(limit + 1, least - min(floors) + 1e-3)
        elif limit >= loss.max() * n:
            return None
        else:
            limit = max(limit + 4, limit * 1.25)


def best_deal(weights: list[float], sizes: list[int], targets: list[float]) -> list[int]:
    """Role of each group: least sum of the roles' deviations from their targets, proven; of deals with the same, the least sum
    of (group's place + 1) times (role's place + 1).

    Many groups are dealt by :func:`near_relaxed`, where that proves its deal. Else a table of the places and weights that the roles have had after each group, the heaviest first. What the groups that
    remain can add to a role is bounded by the lightest and the heaviest of them, and a row that cannot reach the best
    deviation known, which is at first that of :func:`exchanged`, is dropped. The table has as many rows as there are
    different such weights, at worst.
    """
    n, k = len(weights), len(sizes)
    deal = near_relaxed(weights, sizes, targets) if n >= MANY else None
    if deal is not None:
        return deal
    order = sorted(range(n), key=lambda i: (-weights[i], i))
    heavy = [weights[i] for i in order]
    ups = [list(accumulate(heavy[i:], initial=0.0)) for i in range(n + 1)]  # heaviest first
    downs = [list(accumulate(reversed(heavy[i:]), initial=0.0)) for i in range(n + 1)]
    first = exchanged(weights, sizes, targets)
    known = deviation([sum(w for w, r in zip(weights, first, strict=True) if r == q) for q in range(k)], targets) + 1e-9

    def within(i: int, left: tuple[int, ...], sums: tuple[float, ...]) -> bool:
        total = 0.0
        for r in range(k):
            low, high = sums[r] + downs[i][left[r]], sums[r] + ups[i][left[r]]
            total += max(0.0, low - targets[r], targets[r] - high)
        return total <= known

    rows: dict[tuple, tuple[int, tuple | None, int]] = {(tuple(sizes), (0.0,) * k): (0, None, -1)}
    tables = [rows]
    for i, g in enumerate(order):
        after: dict[tuple, tuple[int, tuple | None, int]] = {}
        for at, (cost, _, _) in rows.items():
            left, sums = at
            for r in range(k):
                if not left[r]:
                    continue
                new = (left[:r] + (left[r] - 1,) + left[r + 1 :], sums[:r] + (sums[r] + heavy[i],) + sums[r + 1 :])
                price = cost + (g + 1) * (r + 1)
                found = after.get(new)
                if (found is None and within(i + 1, *new)) or (found is not None and price < found[0]):
                    after[new] = (price, at, r)
        rows = after
        tables.append(rows)
    at = min(rows, key=lambda x: (round(deviation(list(x[1]), targets), 9), rows[x][0], x))
    role = [0] * n
    for i in range(n, 0, -1):
        _, before, r = tables[i][at]
        role[order[i - 1]], at = r, before
    return role


def balanced(groups: DataFrame, by: list[str], group: str, weight: str, sizes: DataFrame, seed: int) -> DataFrame:
    """``by, group, role, objective``: the deal of each stratum's groups with the least sum of the roles' deviations from their
    targets, which is ``objective``; of equal ones that which the groups' hash order prefers.

    ``sizes``: ``by, role, size`` with as many groups in all as there are, and perhaps ``share``, the role's target as a share of
    the stratum's weight (else that of its groups). A stratum's groups are few: one is the work of one task.
    """
    key = order_key(seed, *[F.col(x) for x in by], F.col(group))
    rows = groups.select(*by, F.col(group).cast("string").alias("group"), F.col(weight).cast("double").alias("weight"), key.alias("key"))
    share = F.col("share").cast("double") if "share" in sizes.columns else F.lit(None).cast("double")
    roles = sizes.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("role", "size", share.alias("share")))).alias("roles"))

    def deal(table: pa.Table) -> pa.Table:
        some = sorted(zip(*(table.column(c).to_pylist() for c in ("key", "group", "weight")), strict=True))
        roles = table.column("roles")[0].as_py()
        weights, count = [w for *_, w in some], sum(x["size"] for x in roles)
        if count != len(some):
            raise ValueError("the roles have more or fewer places than there are groups")
        targets = [sum(weights) * (x["size"] / count if x["share"] is None else x["share"]) for x in roles]
        role = best_deal(weights, [x["size"] for x in roles], targets)
        sums = [sum(w for w, r in zip(weights, role, strict=True) if r == q) for q in range(len(roles))]
        keys = [pa.array([table.column(x)[0].as_py()] * len(some), table.column(x).type) for x in by]
        found = [pa.array([g for _, g, _ in some]), pa.array([roles[r]["role"] for r in role]), pa.array([deviation(sums, targets)] * len(some))]
        return pa.table([*keys, *found], names=[*by, "group", "role", "objective"])

    schema = ", ".join(f"{x} {dict(groups.dtypes)[x]}" for x in by) + ", group string, role string, objective double"
    return rows.join(roles, by).groupBy(*by).applyInArrow(deal, schema)
