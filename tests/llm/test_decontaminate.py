"""Decontamination against a plain version that compares every item with every text."""

from __future__ import annotations

import math
import random
from collections import defaultdict
from itertools import groupby

import pytest

from tesserae.llm.decontaminate import UNITS, Decontamination

QUESTION = "We know that a train leaves Paris at 60 km per hour and that Anna waits 15 minutes for it in the station before she goes home"


def plain_words(text):
    out, start, after = [], True, False
    for word in (text or "").split():
        core = word.strip(".,!?:;()\"'")
        if not core:
            continue
        low = core.lower()
        kind = "literal"
        if core[0].isdigit() and (core.isdigit() or low.lstrip("0123456789") in UNITS):
            kind = "number"
        elif low in UNITS:
            kind = "unit" if after else "literal"
        elif core[0].isupper() and not start:
            kind = "name"
        out.append((low, kind))
        start, after = word[-1] in ".!?:", kind == "number"
    return out


def template(words):
    """(placeholder or word, value) of runs of one kind, and of single words."""
    out = []
    for kind, run in groupby(words, key=lambda x: x[1]):
        run = [x for x, _ in run]
        out += [(x, None) for x in run] if kind == "literal" else [((kind,), " ".join(run))]
    return out


def windows(items, size):
    return [tuple(items[i : i + size]) for i in range(len(items) - size + 1)]


def brute(docs, bench, size=8, literals=4, share=0.5, run=20):
    found = set()
    for doc, text in docs:
        words = plain_words(text)
        mine, places = [w for w, _ in words], template(words)
        for item, asked in bench:
            own = plain_words(asked)
            if doc is None or item is None or not own:
                continue
            n = min(size, len(own))
            theirs = windows([w for w, _ in own], n)
            at = defaultdict(set)
            for i, w in enumerate(windows(mine, n)):
                at[w].add(i)
            hit = [i for i, w in enumerate(theirs) if w in at]
            lines = defaultdict(set)
            for i in hit:
                for k in at[theirs[i]]:
                    lines[k - i].add(i)
            long = any(all(i + d in x for d in range(run - size + 1)) for x in lines.values() for i in x)
            if len(hit) >= math.ceil(share * len(theirs)) or long and n == size:
                found.add((doc, item, "copy"))
                continue
            some = [(i, w) for i, w in enumerate(windows(template(own), size)) if sum(v is None for _, v in w) >= literals]
            if not some or n < size:
                continue
            shape = lambda w: tuple(x for x, _ in w)
            at = defaultdict(list)
            for k, w in enumerate(windows(places, size)):
                at[shape(w)].append((k, w))
            met = [(i, k, a, b) for i, a in some for k, b in at[shape(a)]]
            for rows in [met, *[[x for x in met if x[1] - x[0] == line] for line in {k - i for i, k, _, _ in met}]]:
                values = defaultdict(set)
                for _, _, a, b in rows:
                    for (_, x), (_, y) in zip(a, b, strict=True):
                        if x is not None:
                            values[x].add(y)
                if len({i for i, *_ in rows}) >= math.ceil(share * len(some)) and all(len(v) == 1 for v in values.values()):
                    found.add((doc, item, "re-parameterised"))
                    break
    return found


def matches(spark, docs, bench):
    docs, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    return {(x.doc_id, x.item_id, x.kind) for x in Decontamination().matches(docs, bench).collect()}


def test_matches_are_those_of_the_plain_version(spark):
    draw = random.Random(2)
    common = "the of and to in that it was for on with as his they be at one have this from or had by hot word but what some we can out other were all there when up use your how said an each she".split()
    names = ["Paris", "Anna", "London", "Rome", "New York", "Anna Lee", "Berta"]
    word = lambda: draw.choice(names) if draw.random() < 0.1 else str(draw.randrange(99)) if draw.random() < 0.1 else draw.choice(common)
    text = lambda n: " ".join(word() + draw.choice([".", ""] if draw.random() < 0.1 else [""]) for _ in range(n))
    bench = [(i, text(draw.choice([1, 2, 3, 5, 7, 8, 9, 15, 40, 60]))) for i in range(25)] + [(25, None), (None, text(20)), (26, "")]
    docs = [(i, text(draw.randrange(0, 90))) for i in range(40)]
    for i in range(120):
        asked = draw.choice(bench[:25])[1].split()
        if draw.random() < 0.5:  # other values
            asked = [draw.choice(names) if x[0].isupper() else str(draw.randrange(99)) if x[0].isdigit() else x for x in asked]
        a = draw.randrange(len(asked)) if draw.random() < 0.3 else 0
        docs.append((100 + i, f"{text(5)} {' '.join(asked[a : a + draw.choice([10, 25, 99])])} {text(9)}"))
    docs += [(1, docs[50][1]), (None, docs[50][1]), (999, None), (998, "")]
    expected = brute(docs, bench)
    assert len({x for x in expected if x[2] == "copy"}) > 40 and len({x for x in expected if x[2] != "copy"}) > 10
    assert matches(spark, docs, bench) == expected


@pytest.mark.parametrize(
    ("asked", "text", "kind"),
    [
        ("too short", "this one is Too short, they say", "copy"),
        ("量子力学の基本原理を説明してください", "問題：量子力学の基本原理を説明してください。", "copy"),
        (QUESTION, QUESTION.replace("Paris", "New York").replace("60", "3 000").replace("Anna", "Berta Lee"), "re-parameterised"),
        (QUESTION, " ".join(f"{QUESTION.replace(str(60), str(n)).replace(str(15), str(n + 1)).replace('Paris', 'Rome')}." for n in (70, 80, 90)), "re-parameterised"),
        (QUESTION + " " + " ".join(f"more{k}" for k in range(60)), QUESTION, "copy"),  # a long run of a longer item
        (QUESTION, "the train leaves the station and nobody waits for it in the rain before going home", None),
    ],
)
def test_what_counts_as_contamination(spark, asked, text, kind):
    assert matches(spark, [(1, f"Before that. {text}")], [(7, asked)]) == ({(1, 7, kind)} if kind else set())


def test_clean_keeps_all_columns_and_drops_rows_not_ids(spark):
    docs = spark.createDataFrame([(1, QUESTION, "a"), (1, "clean", "b"), (None, QUESTION, "c"), (None, None, "d"), (2, "clean", None)], "doc_id long, text string, node string")
    bench = spark.createDataFrame([(1, QUESTION)], "item_id long, text string")
    out = Decontamination().clean(docs, bench)
    assert out.columns == docs.columns and {x.node for x in out.collect()} == {"b", "d", None}
    assert Decontamination().clean(docs.limit(0), bench).count() == 0 and Decontamination().clean(docs, bench.limit(0)).count() == 5
