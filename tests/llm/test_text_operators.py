"""Line dedup, fill-in-the-middle and target resampling: edges, and plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserae.llm import target_resampling as tr
from tesserae.llm.fill_middle import ChunkCounts, Chunks, FillInMiddle
from tesserae.llm.line_dedup import LineDedup

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LINE = "This line stands in Many documents"
LONG = "\n".join(f"word{i % 977} und{i % 31} Ärger {i % 400}" for i in range(30_000))
#: Null, empty, blank, very long and repeated texts; null and repeated ids; marks of the forms.
ROWS = [
    (1, LINE), (2, f"  {LINE.upper()}\t\nown line of the second text\n"), (3, None), (4, ""), (5, " \n\n"), (6, LONG), (7, LONG + "\n" + LINE), (8, f"{LINE}\n{LINE}"),
    (8, f"{LINE}\n{LINE}"), (8, "another text with the same id"), (None, LINE + "\nx"), (9, "ÉCOLE Straße, 12 <P> \r"), (10, "été Straße! 12 zzz " * 30),
]


@pytest.fixture(scope="module")
def docs(spark):
    """With extra columns whose names clash with those that the operators make."""
    rows = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    for name in ("id", "a", "b", "last", "place", "line", "doc", "lines", "dropped", "n", "form", "output", "score", "rank", "span", "weight", "bucket"):
        rows = rows.withColumn(name, F.lit("x"))
    return rows


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def dropped_lines(rows, least=20, documents=3):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    low = lambda d: -math.inf if d is None else d
    held = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                held[key(line)].add(low(d))
    gone = lambda d, line: len(held[key(line)]) >= documents and low(d) < max(held[key(line)])
    return Counter((d, "\n".join(x for x in (t or "").split("\n") if not gone(d, x)), (t or "").count("\n") + 1, sum(gone(d, x) for x in (t or "").split("\n"))) for d, t in rows)


@pytest.mark.parametrize("heavy", [1, 4096])
def test_lines(docs, none, heavy):
    out = LineDedup(heavy=heavy).drop(docs)
    assert set(out.columns) == {*docs.columns, "n_lines", "n_dropped"}
    again = LineDedup(heavy=heavy).drop(out.withColumn("text", F.lit("")))  # with columns of the names that it makes
    assert sorted(again.columns) == sorted(out.columns) and again.where("n_lines = 1 AND n_dropped = 0").count() == len(ROWS)
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()) == dropped_lines(ROWS)
    assert LineDedup().drop(none).count() == 0


def test_lines_of_random_texts(spark):
    rng = random.Random(3)
    rows = [(d, "\n".join(rng.choice(["", " a", "A", "bb ", "ccc", "É", "dd\td"]) for _ in range(rng.randrange(6)))) for d in range(60)]
    for heavy in (2, 64):
        out = LineDedup(1, 3, heavy).drop(spark.createDataFrame(rows, "doc_id long, text string"))
        assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()) == dropped_lines(rows, 1, 3)


def test_lines_use_no_python(spark, docs):
    plan = LineDedup().drop(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


TOKEN = re.compile("[A-Za-z]+|[^A-Za-z]")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abZ é\n0ß機.", max_size=80), max_size=5), st.sampled_from([1, 7, 40, 1000]), st.sampled_from([30, 1 << 20]))
def test_chunks_count_tokens_and_find_them(texts, piece, limit):
    counts = ChunkCounts(Chunks(bits=2, least=2, most=9, slice=piece), limit)
    for text in texts:
        index, tokens = counts.index(text.encode()), TOKEN.findall(text)
        assert index.n == len(tokens)
        for k in range(len(tokens) + 1):
            before = "".join(tokens[:k])
            assert index.place(k) == (len(before.encode()), len(before))


def test_shared_passages_are_counted_once():
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdef ghi.") for _ in range(40_000)).encode()
    counts = ChunkCounts(Chunks())
    counts.index(passage)
    first = counts.counted
    counts.index(b"other words before it " * 3 + passage + b" and after")
    assert first > 20 and counts.counted - first <= 4


def middle(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    tokens = TOKEN.findall(text)
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    x, y, z = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(x), len(y), f"<S>{z}<P>{x}<M>{y}"
    return doc_id, n, "psm", len(x), len(y), f"<P>{x}<S>{z}<M>{y}"


def test_fill_in_the_middle(spark, docs, none):
    rows = [*ROWS, *[(100 + i, f"Text {i} of many, été, ok {'ab ' * i}") for i in range(60)]]
    every = docs.unionByName(spark.createDataFrame(rows[len(ROWS) :], "doc_id long, text string"), allowMissingColumns=True)
    out = FillInMiddle().apply(every)
    out = out.withColumn("back", FillInMiddle().restored()).collect()
    names = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    assert Counter(tuple(r[c] for c in names) for r in out) == Counter(middle(*x) for x in rows)
    assert Counter((r.doc_id, r.back) for r in out) == Counter((d, t or "") for d, t in rows)
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert FillInMiddle().apply(none).count() == 0


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def runs(text):
    words = WORD.findall((text or "").translate(UPPER))
    return [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)], len(words)


@settings(max_examples=120, deadline=None)
@given(st.lists(st.text(alphabet="abAB é0. \nßZz-機{", max_size=90), min_size=1, max_size=5), st.integers(1, 40))
def test_slots_hold_the_runs_of_words(texts, limit):
    found = tr.features([x.encode() for x in texts], 3)
    raw = found.ranges.data.tobytes()
    got = [[] for _ in texts]
    for b, s, o in zip(found.begin, found.size, found.text, strict=True):
        got[o].append(raw[b : b + s].decode())
    assert [sorted(x) for x in got] == [sorted(runs(x)[0]) for x in texts]
    assert found.words.tolist() == [runs(x)[1] for x in texts]
    assert found.ranges.hashes(found.begin, found.size).tolist() == [xxhash.xxh64_intdigest(raw[b : b + s]) for b, s in zip(found.begin, found.size, strict=True)]
    every = Counter(x for t in texts for x in runs(t)[0])
    for keys in (None, np.zeros(len(found.begin), np.uint64)):  # all keys alike: only bytes tell features apart
        table = tr.SlotTable(found, 97, keys)
        assert table.count[table.count > 0].sum() == len(found.begin) and (table.count > 0).sum() == len(every)
        assert [table.bucket[s] for s in table.slot] == [zlib.crc32(raw[b : b + s]) % 97 for b, s in zip(found.begin, found.size, strict=True)]
    parts, words = [], 0
    for piece, skip in tr.pieces(texts[0].encode(), 3, limit):
        some = tr.features([piece], 3, skip)
        words += int(some.words[0]) - skip
        parts += [some.ranges.data[b : b + s].tobytes().decode() for b, s in zip(some.begin, some.size, strict=True)]
    assert sorted(parts) == sorted(runs(texts[0])[0]) and words == runs(texts[0])[1]


def test_checksums_of_runs_are_joined_from_their_words():
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdé9") for _ in range(rng.choice([1, 2, 7, 31, 63, 64, 65, 90]))) for _ in range(300)]
    found = tr.features([" ".join(words[:200]).encode(), " ".join(words[200:]).encode()], 3)
    table, raw = tr.SlotTable(found, 1 << 32), found.ranges.raw
    assert [table.bucket[s] for s in table.slot] == [zlib.crc32(raw[b : b + s]) for b, s in zip(found.begin, found.size, strict=True)]


def sampled(rows, targets, percent=5, least=20):
    count = lambda texts: Counter(zlib.crc32(x.encode()) % 10000 for t in texts for x in runs(t)[0])
    s, t = count(x for _, x in rows), count(targets)
    big_s, big_t = sum(s.values()) + 10000, sum(t.values()) + 10000
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * big_s / ((s[b] + 1.0) * big_t)))
    out = []
    for d, x in rows:
        found, n = runs(x)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(zlib.crc32(y.encode()) % 10000) for y in found)
        out.append((d, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], -math.inf if x[0] is None else x[0]))
    drawn = Counter((*x, k + 1) for k, x in enumerate(able[: percent * len(able) // 100]))
    rest = able[percent * len(able) // 100 :] + [x for x in out if x[1] < least]
    return drawn + Counter((*x, None) for x in rest)


def test_target_resampling(spark, docs, none):
    names = ("doc_id", "n_words", "n_features", "weight", "score", "rank")
    rows = [*ROWS, *[(100 + i, f"text {i % 7} of many words and numbers {' '.join(map(str, range(i)))}") for i in range(80)]]
    targets = ["Many words, many numbers: 1 2 3 4", None, "", "text of words"]
    wanted = spark.createDataFrame([(x,) for x in targets], "text string")
    every = docs.unionByName(spark.createDataFrame(rows[len(ROWS) :], "doc_id long, text string"), allowMissingColumns=True)
    for slice_ in (1 << 21, 3000):  # long texts in pieces
        out = tr.TargetResampling(percent=30, slice=slice_).sample(every, wanted)
        assert Counter(tuple(r[c] for c in names) for r in out.collect()) == sampled(rows, targets, 30)
    out = tr.TargetResampling().sample(every, wanted.limit(0))
    assert Counter(tuple(r[c] for c in names) for r in out.collect()) == sampled(rows, [])
    assert tr.TargetResampling().sample(none, wanted).count() == 0
