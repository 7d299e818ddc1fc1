"""Near copies of the pipeline against brute force."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from tesserae.llm.near_copies import NearCopies


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows):
    """Rows that stay: the smallest doc_id of each component of pairs at 0.8, null ids last."""
    sets, own = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while own[i] != i:
            i = own[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            own[root(i)] = root(j)
    rank, least = (lambda i: (rows[i][0] is None, rows[i][0] or 0)), {}
    for i in range(len(rows)):
        least[root(i)] = min(rank(i), least.get(root(i), rank(i)))
    return {i for i in range(len(rows)) if rank(i) == least[root(i)]}


@pytest.mark.parametrize("hot", [1024, 12])
def test_near_copies_reach_0_8_and_no_less(spark, monkeypatch, hot):
    monkeypatch.setattr(corpus_pipeline, "NearCopies", lambda **x: NearCopies(**x, hot=hot))
    rng, texts = np.random.default_rng(3), []
    notice = " ".join(f"notice{k}" for k in range(30))
    for family in range(25):
        base = [f"f{family}w{k}" for k in range(int(rng.integers(20, 300)))]
        for copy in range(8):
            own = list(base)
            for k in rng.integers(0, len(own), int(rng.integers(0, 2 + len(own) // 25))):
                own[k] = f"x{family}.{copy}.{k}"
            text = " ".join(own)
            texts.append(f"{text}\n{notice}" if copy % 3 == 0 else text)
    base = " ".join(f"r{k}" for k in range(100))
    texts += [base + " again and again we say" * n for n in (1, 60)]  # repeated lines add no shingles
    texts += [None, "  ", "one two", "One  TWO", "one two three four five"]
    rows = [(int(d), t) for d, t in zip(rng.permutation(len(texts)), texts, strict=True)]
    rows += [(None, texts[3]), (rows[0][0], "another text under a number that is taken already")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(x.doc_id, x.text) for x in corpus_pipeline.near(spark, docs, "").collect()}
    assert got == {rows[i] for i in brute(rows)}
    assert corpus_pipeline.near(spark, docs.limit(0), "").count() == 0


@pytest.mark.parametrize("hot", [1024, 20])
def test_a_large_family_whose_copies_are_alike_to_their_source_only(spark, hot):
    rng = np.random.default_rng(5)
    base, texts = [f"w{k}" for k in range(300)], []
    for copy in range(120):
        own = list(base)
        for k in rng.choice(300, 6, replace=False):
            own[k] = f"x{copy}.{k}"
        texts.append(" ".join(own))
    texts.append(" ".join(base))
    texts += [" ".join(f"y{i}.{k}" for k in range(40)) for i in range(30)]
    sets = [shingles(x) for x in texts]
    share = [len(a & b) / len(a | b) for a, b in combinations(sets[:121], 2)]
    assert min(share) < 0.75 and all(len(sets[i] & sets[120]) >= 0.8 * len(sets[i] | sets[120]) for i in range(120))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {x.doc_id for x in NearCopies(hot=hot).drop(docs).collect()} == {0, *range(121, 151)}


def test_recall_of_pairs_at_the_threshold(spark):
    """Pairs just above 0.8 of every length are found; pairs just below it are not linked."""
    rng, rows, expected = np.random.default_rng(7), [], set()
    for pair in range(400):
        size, share = int(rng.choice([40, 100, 400])), float(rng.choice([0.74, 0.81, 0.86]))
        common = round(size * 2 * share / (1 + share))
        a = [f"p{pair}w{k}" for k in range(size)]
        b = a[:common] + [f"q{pair}w{k}" for k in range(size - common)]
        x, y = shingles(" ".join(a)), shingles(" ".join(b))
        if 5 * len(x & y) >= 4 * len(x | y):
            expected.add(2 * pair + 1)
        rows += [(2 * pair, " ".join(a)), (2 * pair + 1, " ".join(b))]
    kept = {x.doc_id for x in NearCopies().drop(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gone = {x for x, _ in rows} - kept
    assert gone <= expected and len(gone) >= 0.97 * len(expected) > 150
