"""Edges and brute-force versions of the training-data operators."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations, product

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from tesserae.llm import chat_template, html_extract, langid, packing, resampling, simhash, token_files, word_ids
from tesserae.llm.block_dedup import BlockNames
from tesserae.llm.chat_format import CONTROL, ChatFormat, Escaping
from tesserae.llm.decontaminate import Decontamination
from tesserae.llm.url_filter import UrlFilter, UrlRule
from tesserae.operators.linking import components

PATH = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"word{i % 977} und{i % 31}" for i in range(60_000))
#: Null, empty, blank, wordless, very long, repeated texts; null and repeated ids.
ROWS = [
    (1, "a b c d e"), (2, "a b c d e"), (3, None), (4, ""), (5, "  \n"), (6, LONG), (7, LONG + " x"), (8, "A B c d e"), (8, "A B c d e"),
    (None, "a b c d e"), (9, "été, Straße! 12"), (10, "... !!"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """With extra columns whose names clash with those that the operators make."""
    rows = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    for name in ("fp", "name", "node", "level", "start", "ids", "component_id", "lang", "n", "id", "part"):
        rows = rows.withColumn(name, F.lit("x"))
    return rows


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, quality int, item_id long, url string, page_id long, html string")


TOKENIZER = Tokenizer.from_file(PATH)


def ids_of(text: str | None) -> list[int]:
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


# components


def test_components_of_a_chain_a_star_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (None, 3), (3, 2), (3, 2)]
    got = {x.node: x.label for x in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# op1


def brute_fingerprint(text: str | None, k: int = 4) -> int:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = lower.encode().split()
    grams = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abAB é\t\n\x0b\x1c\u00a0.", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode(), 4) == [brute_fingerprint(text)]


def test_fingerprint_of_a_text_read_in_pieces(monkeypatch):
    monkeypatch.setattr(simhash, "word_lists", lambda data: ([x for x in data.split()[i : i + 3]] for i in range(0, len(data.split()), 3)))
    text = " ".join(f"w{i % 13}" for i in range(100))
    assert simhash.fingerprint(text.encode(), 4) == [brute_fingerprint(text)]


@pytest.mark.parametrize("radius", [0, 1, 4, 7, 48])
@pytest.mark.parametrize("lanes", [1, 4])
def test_bit_sliced_pairs(radius, lanes):
    rng, parts = np.random.default_rng(radius), []
    for size in (1, 2, 64, 65, 130):
        base = rng.integers(0, 2**63, lanes, dtype=np.uint64)
        flips = rng.integers(0, 2, (size, lanes, 64)) * (rng.random((size, lanes, 64)) < 0.04)
        parts.append(base ^ (flips.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=2, dtype=np.uint64))
    values, starts = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))
    got = set(zip(*(x.tolist() for x in simhash.close_pairs(values, starts, radius)), strict=True))
    near = lambda i, j: int(np.bitwise_count(values[i] ^ values[j]).sum()) <= radius
    assert got == {(i, j) for a, b in zip(starts[:-1], starts[1:], strict=True) for i, j in combinations(range(a, b), 2) if near(i, j)}


def brute_components(rows, radius=4):
    found = [(d, brute_fingerprint(t)) for d, t in rows]
    own = list(range(len(found)))

    def root(i):
        while own[i] != i:
            i = own[i]
        return i

    for i, j in combinations(range(len(found)), 2):
        if (found[i][1] ^ found[j][1]).bit_count() <= radius:
            own[root(i)] = root(j)
    low = defaultdict(list)
    for i, (d, _) in enumerate(found):
        low[root(i)].append(d)
    least = lambda x: min((d for d in x if d is not None), default=None)
    return Counter((d, f"{f:016x}", least(low[root(i)])) for i, (d, f) in enumerate(found))


@pytest.mark.parametrize("hot", [1024, 2])
def test_simhash_components(spark, docs, none, hot):
    got = simhash.SimHash(hot=hot).components(docs)
    assert Counter(map(tuple, got.collect())) == brute_components(ROWS)
    assert simhash.SimHash().components(none).count() == 0


@pytest.mark.parametrize("hot", [1024, 16, 3])
def test_simhash_of_a_crowd_of_near_copies(spark, hot):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(150):
        own = list(words) if i % 3 else [f"v{i}.{k}" for k in range(30)]
        for k in rng.integers(0, len(own), int(rng.integers(0, 3))):
            own[k] = f"x{i}"
        rows.append((i, " ".join(own)))
    got = simhash.SimHash(hot=hot).components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, got.collect())) == brute_components(rows)


def test_tables_of_groups_miss_no_pair_within_the_radius():
    rng = np.random.default_rng(0)
    for n in (10, 10**7, 10**10):
        masks = simhash.SimHash().masks(n)
        for _ in range(200):
            flips = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(flips & mask == 0 for mask in masks)
        assert min(mask.bit_count() for mask in masks) >= math.log2(max(1, n / 256)) - 1


# op2, op4


def test_word_ids_are_those_of_whole_texts():
    memo = word_ids.WordIds(PATH, limit=50)
    alphabet = "aAbZz '.,!$&*<|>\n\t\r\x0b\x1c\x85\xa0ßéÉİΣς²½Ⅷ٣\u0327\u0303的_-9"
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list(alphabet), int(n))) for n in rng.integers(0, 30, 3000)]
    texts += ["<|endoftext|>", "a<|endoftext|>.B", "DON'T. it's!", None, "", "x" * 3000, LONG[:5000]]
    assert [np.frombuffer(x, "<u4").tolist() for x in memo.ids(texts)] == [ids_of(x) for x in texts]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.none() | st.integers(-(2**63), 2**63 - 1), st.lists(st.integers(0, 2**32 - 1), max_size=40))), st.sampled_from([1, 8]), st.integers(1, 30))
def test_token_file_round_trip(docs, bits, block):
    ids = [np.array(x, "<u4").tobytes() for _, x in docs]
    assert token_files.decode_file(token_files.encode_file([d for d, _ in docs], ids, block, bits)) == ([d for d, _ in docs], ids)


@pytest.mark.parametrize("plane_bits", [1, 8])
def test_token_files(spark, docs, none, tmp_path, plane_bits):
    files = token_files.TokenFiles(PATH, 1, block=1000, plane_bits=plane_bits, file_tokens=5000)
    files.write(docs, f"file://{tmp_path}/t")
    got = files.read(spark, f"file://{tmp_path}/t").orderBy("start").collect()
    order = sorted(ROWS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    assert [x.doc_id for x in got] == [d for d, _ in order]
    at = 0
    for row, (_, text) in zip(got, order, strict=True):
        assert (row.start, np.frombuffer(row.ids, "<u4").tolist()) == (at, [*ids_of(text), 1])
        at += row.n_tokens
    files.write(none, f"file://{tmp_path}/e")
    assert files.read(spark, f"file://{tmp_path}/e").count() == 0


def test_packing_covers_every_id_once(spark, docs, none):
    got = packing.Packing(PATH, 2, tokens=512, segments=6).pack(docs).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for x in got:
        assert len(x.ids) == 4 * x.length > 0
        sequences[x.sequence_id].append(x)
        pieces[x.doc_id, x.doc_tokens].append(x)
    for rows in sequences.values():
        at = 0
        for x in sorted(rows, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert len(rows) <= 6 and (at == 512 or at.bit_count() == 1)
    whole = Counter()
    for (doc, n), rows in pieces.items():
        rows.sort(key=lambda x: x.start)
        text = b"".join(x.ids for x in rows)
        copies = len(text) // (4 * n)
        assert len(text) == 4 * n * copies
        whole[doc] += copies
    assert whole == Counter(d for d, _ in ROWS)
    assert sum(x.length for x in got) == sum(len(ids_of(t)) + 1 for _, t in ROWS)
    assert packing.Packing(PATH, 2).pack(none).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 60), st.integers(0, 60)), max_size=60), st.integers(1, 64), st.integers(1, 8), st.integers(1, 64))
def test_vector_packer_keeps_all_limits(items, tokens, segments, loss):
    out = []
    packer = packing.VectorPacker(tokens, segments, loss, out.append, pool=8)
    for k, (n, start) in enumerate(items):
        packer.add((k, b"", 0, n, min(start, n)))
    packer.finish()
    assert Counter({k: n for k, (n, _) in enumerate(items)}) == sum((Counter({x[0]: x[3] - x[2]}) for s in out for x in s), Counter())
    for s in out:
        assert 0 < sum(x[3] - x[2] for x in s) <= tokens and len(s) <= segments and sum(map(packing.loss_tokens, s)) <= loss


def test_packer_without_cutting_rejects_what_fits_nowhere():
    packer = packing.VectorPacker(8, 2, 8, lambda s: None, cut=False)
    with pytest.raises(ValueError):
        packer.add((0, b"", 0, 9, 0))


# op3


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*CONTROL, *"<|s>/[INST]\\anturex\n", "é"]), max_size=20).map("".join))
def test_escaping(text):
    escaped = Escaping().escape(text)
    assert Escaping.unescape(escaped) == text and not any(x in escaped for x in CONTROL)


def render(source, **scope):
    out = []
    chat_template.Template(source, {"escape": Escaping().escape}).render(lambda text, marked: out.append((text, marked)), **scope)
    return out


def test_template_language():
    source = "{% set n = 2 * 3 + 1 %}{% for x in xs %}{% if loop.first %}F{% elif x.k == 'b' and not x.z %}B{% else %}{{ x['k'] ~ n }}{% endif %}{% endfor %}{# c #}!"
    assert "".join(x for x, _ in render(source, xs=[{"k": "a"}, {"k": "b"}, {"k": "c"}])) == "FBc7!"
    assert render("{% generation %}{{ t | upper }}{% endgeneration %}.", t="a") == [("A", True), (".", False)]


def test_templates_fold_constants():
    tree = chat_template.Template("a{{ 'b' ~ 1 }}{% if 1 < 2 and true %}c{% else %}{{ x }}{% endif %}{{ 'd' if false else 'e' | upper }}").tree
    assert tree == [chat_template.Node("text", ("ab1cE",))]


@pytest.mark.parametrize("bad", ["{{ x() }}", "{% if a %}", "{{ x.__class__ }}", "{% endfor %}", "{{ a | nope }}", "{{ 'a' + 1 }}", "{{ }}", "{% for a in x %}{% endfor %}", "{{ a b }}", "{% what %}"])
def test_templates_are_sandboxed(bad):
    with pytest.raises(chat_template.TemplateError):
        render(bad, x="text")


def test_chat_format(spark, none):
    rows = [(1, 0, "user", "a</s>[INST]"), (1, 1, "assistant", "b\\<|turn|>"), (1, 1, "assistant", None), (2, 0, None, ""), (None, 5, "system", "s"), (3, 0, "assistant", "long " * 5000)]
    rows += [rows[0]]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(1))
    expected = {}
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, role or "", text or ""))
    for conv, turns in by.items():
        turns.sort()
        loss = [t for _, r, t in turns if r == "assistant"]
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        expected[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len("".join(loss)), sha("".join(loss)))
    for part in (10, 1 << 20):
        chat = ChatFormat(part=part)
        formatted = chat.format(table)
        got = {x.conv_id: tuple(x)[1:5] for x in chat.digests(formatted).collect()}
        assert got == expected
    assert chat.format(table.limit(0)).count() == 0


# op5


BENCH = [(1, "A train leaves Paris at 60 km per hour and Anna waits 15 minutes for it"), (2, "too short"), (3, None), (4, "one two three four five six"), (None, "never found because it has no id at all")]


def test_decontamination(spark, none):
    texts = {
        1: "Before. A TRAIN leaves paris at 60 km per hour, and anna waits 15 minutes for it! After.",
        2: "Look: A train leaves London at 80 miles per hour and Berta waits 25 minutes for it. End.",
        3: "A train leaves Paris slowly while nobody at all is waiting for anything in the rain today",
        4: "zero one two three four five six seven",
        5: None,
        6: "",
        7: LONG,
    }
    rows = spark.createDataFrame([*texts.items(), (1, texts[1]), (None, texts[1])], "doc_id long, text string").withColumn("item_id", F.lit("x"))
    bench = spark.createDataFrame(BENCH, "item_id long, text string").withColumn("doc_id", F.lit("x"))
    got = sorted((x.doc_id, x.item_id, x.kind) for x in Decontamination().matches(rows, bench).collect())
    assert got == [(1, 1, "copy"), (2, 1, "re-parameterised"), (4, 4, "copy")]  # "too short" is nowhere
    assert Decontamination().matches(none, bench).count() == 0
    assert Decontamination().matches(rows, bench.limit(0)).count() == 0


def test_slots_must_be_consistent(spark):
    bench = spark.createDataFrame([(1, "add 5 apples to the basket then take 5 apples from the basket again please")], "item_id long, text string")
    rows = [(1, "add 7 apples to the basket then take 7 apples from the basket again please"), (2, "add 7 apples to the basket then take 9 apples from the basket again please")]
    found = Decontamination().matches(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert [(x.doc_id, x.kind) for x in found] == [(1, "re-parameterised")]


# op6


RULES = (UrlRule("net/", "block"), UrlRule("example.net/en/", "allow"), UrlRule("example.com/de/", "block"), UrlRule("org/fr/", "allow"))


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("https://A.Example.NET/en/1?x#y", "a.example.net", "/en/1", "example.net/en/", "allow"),
        ("http://example.net/de/", "example.net", "/de/", "net/", "block"),
        ("http://badexample.net/en/", "badexample.net", "/en/", "net/", "block"),
        ("http://x.net", "x.net", "", None, "allow"),
        ("http://www.example.com/de/#a", "www.example.com", "/de/", "example.com/de/", "block"),
        ("http://q.org/fr/é?b", "q.org", "/fr/é", "org/fr/", "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("://", "", "", None, "allow"),
        ("x://h?a://b/c", "h", "", None, "allow"),
    ],
)
def test_url_rules(spark, url, host, path, rule, verdict):
    rows = spark.createDataFrame([(1, url)], "page_id long, url string").withColumn("host", F.lit("x"))
    got = UrlFilter(RULES, ()).judge(rows).collect()[0]
    assert (got.host, got.path, got.rule, got.verdict) == (host, path, rule, verdict)


def test_url_models_match_a_plain_version(spark, none):
    hosts = ("casino-win", "free-casino", "casino-one", "my-casino", "top-casino", "garden", "library", "museum", "school", "river")
    urls = [f"http://{h}.com/{i % 7}" for i in range(12) for h in hosts]
    taught = {h: hashlib.sha256(f"{h}.com".encode()).hexdigest()[0] < "c" for h in hosts}
    assert {("casino" in h, t) for h, t in taught.items()} == {(True, True), (True, False), (False, True), (False, False)}
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    model = UrlFilter(RULES, ("casino",), order=2)
    texts = Counter("^^" + u.split("://")[1] + "$" for u in urls)
    counts = {k: [Counter(), Counter()] for k in range(3)}
    for text in texts:
        for i in range(2, len(text)) if taught[text[2:].split(".")[0]] else ():
            for k in range(3):
                counts[k]["casino" in text][text[i - k : i + 1]] += texts[text]

    def chance(gram, kind):
        if not gram:
            return 1 / 256
        k = len(gram) - 1
        all_ = sum(n for g, n in counts[k][kind].items() if g[:-1] == gram[:-1])
        return (counts[k][kind][gram] + 2 * chance(gram[1:], kind)) / (all_ + 2)

    for row in model.judge(rows).collect():
        text = "^^" + row.host + row.path + "$"
        score = np.mean([math.log(chance(text[i - 2 : i + 1], 1) / chance(text[i - 2 : i + 1], 0)) for i in range(2, len(text))])
        assert row.score == pytest.approx(score)
        assert row.verdict == ("block" if "casino" in row.host else "allow")
    assert model.judge(none).count() == 0


def test_url_models_block_hosts_without_any_term_and_take_long_urls(spark):
    kinds = ("win", "bonus", "jackpot", "slots", "royal", "spin", "vegas", "club")
    draw = random.Random(3)
    odd = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(40)]
    urls = [f"http://casino-{a}-{b}.com/play" for a in kinds for b in kinds] + [f"http://casino-{x}.com/p" for x in odd] + [f"http://{x[::-1]}.org/n" for x in odd] + [f"http://{a}-{b}.org/news" for a in ("garden", "river", "museum", "school", "library", "harbour", "forest", "bridge") for b in ("north", "south", "house", "trust", "press", "guide")]
    new = next(h for n in range(99) if hashlib.sha256((h := f"kasino-jackpot-slots{n}.com").encode()).hexdigest()[0] >= "c")  # teaches nothing
    asked = [f"http://{new}/play", "http://garden-museum.org/news", "http://a.org/" + "x" * 50_000, f"http://{new}/play"]
    rows = spark.createDataFrame(list(enumerate(urls + asked)), "page_id long, url string")
    got = {x.page_id: x.verdict for x in UrlFilter((), ("casino",)).judge(rows).collect()}
    assert [got[len(urls) + k] for k in (0, 1, 3)] == ["block", "allow", "block"] and got[len(urls) + 2] in ("allow", "block")
    assert sum(got[k] == "block" for k in range(104)) >= 95 and sum(got[k] == "block" for k in range(104, len(urls))) <= 5


def test_url_filter_runs_no_python(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    plan = UrlFilter(RULES, ("casino",)).judge(rows)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


# op7


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Top</header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><aside>Aside</aside><%s><h1>Title &amp; more</h1><p>First  paragraph<br>goes on with many words in it.
<p><b>Bold &eacute;.<br><p>Ok.</p><ul><li>One<li>Two</ul><div class="ad">Buy</div><form><p>Name</p></form><script>var x="</p>";</script><!-- no -->
<section id="comments"><p>Nice post with a long comment text, many words in it.</p></section></%s><footer>&copy; me</footer></body></html>"""


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_main_text(tag):
    assert html_extract.HtmlExtraction().main_text(PAGE % (tag, tag)) == "Title & more\nFirst paragraph goes on with many words in it.\nBold é.\nOk.\nOne\nTwo"


@pytest.mark.parametrize(("name", "expected"), [("left-sidebar", ""), ("page no-sidebar", "text"), ("has-ads", "text"), ("adContainer", ""), ("readable", "text"), ("cookieNotice", "")])
def test_names_of_furniture(name, expected):
    assert html_extract.HtmlExtraction().main_text(f'<body><div class="{name}"><p>text</p></div></body>') == expected


def test_main_text_edges(spark, none):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "plain words"), (4, "<p>" * 3000 + "deep"), (5, "<nav>only</nav>"), (6, "<article><p>a&nbsp;b\t c</article>")], "page_id long, html string")
    got = {x.page_id: x.t for x in rows.select("page_id", html_extract.HtmlExtraction().text().alias("t")).collect()}
    assert got == {1: "", 2: "", 3: "plain words", 4: "deep", 5: "", 6: "a b c"}
    assert none.select(html_extract.HtmlExtraction().text()).count() == 0


# op8


def test_kth_largest(spark):
    values = [1.0, 1.0, 1.0, -5.0, 3.5, 1e9, 1.0000001, 0.0, -1e-12]
    rows = spark.createDataFrame([(x,) for x in values], "x double")
    for k in range(1, len(values) + 1):
        assert resampling.kth_largest(rows, "x", lambda n, k=k: k) == sorted(values, reverse=True)[k - 1]
    assert resampling.kth_largest(rows, "x", lambda n: 0) is None
    assert resampling.kth_largest(rows.limit(0), "x", lambda n: 1) is None


def test_resampling(spark, docs, none):
    good = [(i, f"the quiet garden number {i} grows and the river runs") for i in range(40)]
    bad = [(100 + i, "%%% buy $$$ now !!! " * 5 + str(i)) for i in range(10)]
    rows = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(8)] + [(100, 0), (101, 0)], "doc_id long, quality int")
    got = resampling.ImportanceResampling(size=4096).sample(rows, labels).collect()
    assert {x.doc_id for x in got if x.kept} == set(range(40)) and len(got) == 50
    every = resampling.ImportanceResampling().sample(docs.drop("quality"), labels.limit(0)).collect()
    assert len(every) == len(ROWS) and all(x.kept for x in every) and {x.log_weight for x in every} == {0.0}
    assert resampling.ImportanceResampling().sample(none.drop("quality"), labels).count() == 0


def test_resampling_weights_and_sample_match_a_plain_version(spark):
    draw = random.Random(4)
    words = [f"w{k}" for k in range(60)]
    docs = [(k, " ".join(draw.choices(words[:20] if k % 3 == 0 else words, k=draw.randint(0, 60)))) for k in range(150)]
    docs += [(3, docs[3][1]), (7, None)]
    labels = [(k, int(k % 3 == 0)) for k in range(0, 90, 2)]
    size, window = 512, 128
    model = resampling.ImportanceResampling(size=size)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = model.sample(table, spark.createDataFrame(labels, "doc_id long, quality int")).collect()

    def grams(text):
        ids = [zlib.crc32(w.encode()) + 1 for w in (text or "").split()]
        mixed = ids + [(a * 0x9E3779B97F4A7C15 + b - 1) % 2**64 for a, b in zip(ids, ids[1:], strict=False)]
        out = []
        for x in mixed:
            x = (x ^ x >> 31) * 0xBF58476D1CE4E5B9 % 2**64
            out.append((x >> 33) % size)
        return out

    targets = {k for k, q in labels if q}
    every, target = Counter(), Counter()
    for k, t in docs:
        every.update(grams(t))
        target.update(grams(t) if k in targets else ())
    share = lambda c, b: (c[b] + 1) / (sum(c.values()) + size)
    ratio = [math.log(share(target, b)) - math.log(share(every, b)) for b in range(size)]
    weight = lambda t: window * sum(ratio[b] for b in grams(t)) / max(1, len(grams(t)))
    assert sorted((x.doc_id, round(x.log_weight, 6)) for x in got) == sorted((k, round(weight(t), 6)) for k, t in docs)
    kept = round(len(docs) * len(targets) / len(labels))
    keys = sorted((x.sample_key for x in got), reverse=True)
    assert {x.kept for x in got if x.sample_key >= keys[kept - 1]} == {True} and not any(x.kept for x in got if x.sample_key < keys[kept - 1])
    assert {x.sample_key - x.log_weight for x in got if x.doc_id == 3}.__len__() == 1  # noise is of the id alone


# op9


VOCABULARY = TOKENIZER.get_vocab()
CHANCE = np.random.default_rng(0).random((1 + max(VOCABULARY.values()), 2)) * 1e-4


def shown(word: str) -> str:
    """A word in the vocabulary's own letters, one for each byte."""
    return "".join(x for x, _ in ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(word))


def piece_chance(letters: str, last: bool) -> np.ndarray:
    at = VOCABULARY.get(letters + "</w>" * last)
    return np.zeros(2) if at is None else CHANCE[at]


def test_forward_sums_all_segmentations():
    words = ["a", "the", "then", "thermo", "été", "straße", "zq"]

    def brute(word):
        letters, total = shown(word), np.zeros(2)
        for cut in product((0, 1), repeat=len(letters) - 1):
            ends = [0, *[i + 1 for i, x in enumerate(cut) if x], len(letters)]
            total += np.prod([piece_chance(letters[a:b], b == len(letters)) for a, b in zip(ends, ends[1:], strict=False)], axis=0)
        return np.log(total)

    assert np.allclose(langid.forward([x.encode() for x in words], langid.pieces(PATH), CHANCE), [brute(x) for x in words])


def test_forward_sums_words_of_any_length():
    seeds = ["donaudampfschifffahrtsgesellschaft", "достопримечательность", "機械学習入門講座", "ภาษาไทย", "x"]
    words = [(x * 40)[:n] for x in seeds for n in (1, 7, 11, 30, 60, 70, 200, 1000)]

    def plain(word):
        letters, sums = shown(word), [np.zeros(2)]
        for j in range(1, len(letters) + 1):
            parts = [sums[i] + np.log(piece_chance(letters[i:j], j == len(letters))) for i in range(max(0, j - 40), j)]
            sums.append(np.logaddexp.reduce(parts, axis=0))
        return sums[-1]

    with np.errstate(divide="ignore"):
        expected = np.array([plain(x) for x in words])
    data = [x.encode() for x in words]
    assert np.isfinite(expected).all() and {len(x) for x in data} > {30, 60, 200, 1000}
    for most in (1, 500, 1 << 17):  # words alone, and many together
        assert np.allclose(langid.forward(data, langid.pieces(PATH), CHANCE, most), expected, rtol=1e-9)


@pytest.mark.parametrize("limit", [1, 4, 1000])
def test_word_scores_are_those_of_the_letter_runs_of_a_text(limit):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["alpha", "Beta,", "l'été-gamma", "d" * 90, "x1y", "...", "слово" * 9], 5)) for _ in range(30)]
    scores, words = langid.WordScores(PATH, CHANCE, limit), sorted({w for x in texts for w in langid.words_of(x)})
    one = dict(zip(words, langid.forward([x.encode() for x in words], langid.pieces(PATH), CHANCE), strict=True))
    for k in range(0, 30, 3):
        assert np.allclose(scores.totals([*texts[k : k + 3], None, ""]), [sum(one[w] for w in langid.words_of(x)) + np.zeros(2) for x in [*texts[k : k + 3], None, ""]], rtol=1e-5)


def test_language_id(spark, docs, none):
    learn = spark.createDataFrame([("the house and the garden of the king", "en"), ("das haus und der garten des königs", "de"), (None, "de"), ("x", None)], "text string, lang string")
    model = langid.LanguageId(PATH).fit(learn)
    assert model.languages == ["de", "en"]
    rows = spark.createDataFrame([(1, "the garden"), (2, "DER Garten!"), (3, None), (4, ""), (5, "123 .,!"), (6, LONG)], "doc_id long, text string")
    got = {x.doc_id: x.p for x in rows.select("doc_id", model.predict(spark).alias("p")).collect()}
    assert [got[i].lang for i in range(1, 6)] == ["en", "de", "und", "und", "und"]
    assert got[3].score == 0 and 0.5 < got[1].score <= 1 and got[6].lang in ("de", "en")
    empty = langid.LanguageId(PATH).fit(none)
    assert {x.p.lang for x in rows.select(empty.predict(spark).alias("p")).collect()} == {"und"}


# op10


@pytest.mark.parametrize(("block", "bits"), [(4096, 64), (3, 64), (3, 2), (1000, 1)])
def test_block_names(spark, none, block, bits):
    rows = [x for x in ROWS if block > 100 or x[1] is not LONG and x[0] not in (6, 7)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("name", F.lit("x")).repartition(3)
    got = BlockNames(block, bits).groups(table).collect()
    size, most = Counter(t or "" for _, t in rows), {}
    for d, t in rows:
        most[t or ""] = max(most.get(t or "", -math.inf), -math.inf if d is None else d)
    sha = {hashlib.sha256((t or "").encode()).hexdigest(): t or "" for _, t in rows}
    assert Counter(x.doc_id for x in got) == Counter(d for d, _ in rows)
    kept = Counter()
    for x in got:
        text = sha[x.text_sha256]
        assert (x.keep_id, x.group_size) == (most[text], size[text])
        kept[text] += x.kept
        assert not x.kept or x.doc_id == x.keep_id
    assert kept == dict.fromkeys(size, 1)
    assert BlockNames().groups(none).count() == 0


def test_crc_matches_zlib(spark):
    data = np.arange(5, dtype="<u4").tobytes()
    assert spark.createDataFrame([(bytearray(data),)], "b binary").select(F.crc32("b")).first()[0] == zlib.crc32(data)
