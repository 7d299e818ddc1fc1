"""The registered queries of the training-data operators, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .block_dedup import BlockNames
from .chat_format import ChatFormat
from .common import keep, shared_dir, table
from .decontaminate import Decontamination
from .fill_middle import FillInMiddle
from .html_extract import HtmlExtraction
from .langid import LanguageId
from .line_dedup import LineDedup
from .packing import Packing
from .resampling import ImportanceResampling
from .simhash import SimHash
from .target_resampling import TargetResampling
from .token_files import TokenFiles
from .url_filter import UrlFilter, UrlRule

VOCABULARY = "word_bpe_49k.json"
URL_RULES = (
    UrlRule("net/", "block"),
    UrlRule("example.net/en/", "allow"),
    UrlRule("example.com/de/", "block"),
    UrlRule("org/fr/", "allow"),
)
#: The first quarter of each text counts as its context, which bears no loss; of a sequence of 4096, so many may.
CONTEXT, LOSS_TOKENS = 0.25, 3584
#: Parts of the hosts of known unwanted sites.
URL_TERMS = ("casino", "bets", "pills", "spam", "adult", "ads-")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SimHash(shingle=4, radius=4).components(table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = TokenFiles(public_tokenizers.path(VOCABULARY), end_id=1)
    path = f"{shared_dir(spark)}/tesserae/tokens-{uuid.uuid4().hex}"
    files.write(table(spark, sf_dir, "documents"), path)
    return files.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql(
        "SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"
    )
    chat = ChatFormat()
    rows = table(spark, sf_dir, "conversations").select(own.columns).unionByName(own)
    return chat.digests(keep(chat.format(rows), "formatted"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = Packing(public_tokenizers.path(VOCABULARY), end_id=2, loss=LOSS_TOKENS, context=CONTEXT).pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Decontamination().matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return UrlFilter(URL_RULES, URL_TERMS).judge(table(spark, sf_dir, "pages")).drop("score")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", HtmlExtraction().text().alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


def op8_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ImportanceResampling().sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = LanguageId(public_tokenizers.path(VOCABULARY)).fit(docs.where(~held_out))
    found = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), model.predict(spark).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def op10_block_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return BlockNames().groups(table(spark, sf_dir, "documents"))


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TargetResampling().sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = LineDedup().drop(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    fim = FillInMiddle()
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(), 256).alias("restored_sha256")
    return fim.apply(table(spark, sf_dir, "documents")).select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_token_files": op2_token_files,
        "op3_chat_format": op3_chat_format,
        "op4_packing": op4_packing,
        "op5_decontamination": op5_decontamination,
        "op6_url_filter": op6_url_filter,
        "op7_html_extraction": op7_html_extraction,
        "op8_importance_resampling": op8_importance_resampling,
        "op9_language_id": op9_language_id,
        "op10_block_names": op10_block_names,
        "op11_target_resampling": op11_target_resampling,
        "op12_line_dedup": op12_line_dedup,
        "op13_fill_middle": op13_fill_middle,
    }


def _escaped(column: str) -> str:
    """DuckDB SQL of the chat format's escaping: control strings neither overlap nor hold backslashes."""
    sql = f"replace({column}, '\\', '\\\\')"
    for mark in ChatFormat().control:
        sql = f"replace({sql}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return sql


def _url_filter_sql() -> str:
    """The rules, the models level by level, the calibration, and the verdicts."""
    model = UrlFilter(URL_RULES, URL_TERMS)
    order, weight = model.order, f"{model.weight}::DOUBLE"
    fits, upper = [], "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    for rule in sorted(URL_RULES, key=lambda x: -len(x.rule)):
        own, slash, rest = rule.rule.partition("/")
        fits.append((f"(host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '{slash}{rest}')", rule))
    case = lambda value: "CASE " + " ".join(f"WHEN {x} THEN '{getattr(rule, value)}'" for x, rule in fits) + " END"
    levels = []
    for k in range(order + 1):
        less = {x: f"1.0::DOUBLE / {model.alphabet}" if k == 0 else f"b.{x}" for x in "ar"}
        context = f"(PARTITION BY substr(gram, 1, {k}))"
        chance = ", ".join(f"(l.{x} + {weight} * {less[x]}) / (l.{x}_all + {weight}) AS {x}" for x in "ar")
        below = "" if k == 0 else f" JOIN p{k - 1} b ON b.gram = substr(l.gram, 2)"
        levels.append(
            f"l{k} AS (SELECT gram, a, r, sum(a) OVER {context} AS a_all, sum(r) OVER {context} AS r_all"
            f" FROM (SELECT substr(gram, {order + 1 - k}) AS gram, sum(a) AS a, sum(r) AS r FROM grams GROUP BY ALL)),"
            f" p{k} AS (SELECT l.gram, {chance} FROM l{k} l{below})"
        )
    return f"""
        WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{upper.lower()}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        judged AS (SELECT *, {case("rule")} AS rule, {case("verdict")} AS by_rule, regexp_matches(host, '{"|".join(URL_TERMS)}') AS bad FROM h),
        texts AS (
            SELECT host, path, '{"^" * order}' || host || path || '$' AS s, sum(bad::INT) AS r,
                   sum((NOT bad AND coalesce(by_rule, 'allow') = 'allow' AND host <> '')::INT) AS a,
                   substr(sha256(host), 1, 1) IN ({", ".join(repr(x) for x in model.taught)}) AS taught
            FROM judged GROUP BY host, path),
        places AS (SELECT host, path, a, r, taught, substr(s, i, {order + 1}) AS gram FROM (SELECT *, unnest(range(1, length(s) - {order} + 1)) AS i FROM texts)),
        grams AS (SELECT gram, sum(a * taught::INT) AS a, sum(r * taught::INT) AS r FROM places GROUP BY gram),
        {", ".join(levels)},
        scores AS (
            SELECT host, path, any_value(places.a) AS every_a, any_value(places.r) AS every_r, any_value(taught) AS taught, floor(round(avg(ln(p.r) - ln(p.a)), 9) / {model.step}::DOUBLE)::INT AS bin
            FROM places JOIN p{order} p ON p.gram = places.gram GROUP BY host, path),
        own AS (SELECT sum(every_a) FILTER (NOT taught) > 0 AND sum(every_r) FILTER (NOT taught) > 0 AS held_out FROM scores),
        bins AS (
            SELECT bin, sum(every_a * used) AS a, sum(every_r * used) AS r
            FROM (SELECT *, CASE WHEN held_out AND taught THEN 0 ELSE 1 END AS used FROM scores, own) GROUP BY bin),
        up AS (SELECT bin, sum(a) OVER (ORDER BY bin) * 2 >= sum(a) OVER () AS half_a, sum(r) OVER (ORDER BY bin) * 2 >= sum(r) OVER () AS half_r, sum(a) OVER () AS all_a, sum(r) OVER () AS all_r FROM bins),
        cut AS (SELECT CASE WHEN any_value(all_a) > 0 AND any_value(all_r) > 0 THEN ceil((min(bin) FILTER (half_a) + min(bin) FILTER (half_r)) / 2.0) END AS bin FROM up)
        SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN host <> '' AND bin >= (SELECT bin FROM cut) THEN 'block' ELSE 'allow' END) AS verdict
        FROM judged JOIN scores USING (host, path)"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The reflected polynomial of CRC-32.
_CRC = 3988292384

_TARGET_SQL = rf"""
    WITH texts AS (
        SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS id, 1 AS own, text FROM documents
        UNION ALL SELECT NULL, NULL, 0, text FROM benchmark),
    words AS (
        SELECT row_number() OVER () AS r, doc_id, id, own,
               regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM texts),
    grams AS (
        SELECT r, own, unnest(list_concat(w,
            list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
            list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS gram
        FROM words),
    rule AS (
        SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0],
            lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {_CRC}) ELSE c >> 1 END)) AS crc),
    own_gram AS (SELECT gram, hex(encode(gram)) AS h FROM (SELECT DISTINCT gram FROM grams)),
    bucketed AS (
        SELECT gram, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
            lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
        FROM own_gram, rule),
    found AS (SELECT r, own, bucket, count(*) AS n FROM grams JOIN bucketed USING (gram) GROUP BY ALL),
    counts AS (SELECT bucket, coalesce(sum(n) FILTER (own = 1), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (own = 0), 0)::DOUBLE AS t FROM found GROUP BY bucket),
    gains AS (
        SELECT bucket, floor(1000 * ln((t + 1) * (every_s + 10000) / ((s + 1) * (every_t + 10000))))::BIGINT AS gain
        FROM (SELECT *, sum(s) OVER () AS every_s, sum(t) OVER () AS every_t FROM counts)),
    sums AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM found JOIN gains USING (bucket) WHERE own = 1 GROUP BY r),
    scored AS (
        SELECT doc_id, len(w) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
               coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
        FROM words LEFT JOIN sums USING (r) WHERE own = 1),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS FIRST) AS place, sum(able::INT) OVER () AS n FROM scored)
    SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 5 * n // 100 THEN place END AS rank FROM ranked"""

_LINES_SQL = f"""
    WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    lines AS (
        SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM split),
    keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM lines),
    often AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
    FROM (SELECT keyed.*, coalesce(doc_id < last, false) AS gone FROM keyed LEFT JOIN often USING (key))
    GROUP BY doc_id"""

_MIDDLE_SQL = """
    WITH draws AS (
        SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h,
               regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens
        FROM documents),
    h AS (SELECT *, list_transform(range(4), lambda i: ('0x' || substr(h, 8 * i + 1, 8))::BIGINT) AS d, len(tokens) AS n FROM draws),
    forms AS (
        SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS a, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS b,
               CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR d[3] % 100 >= 90 THEN 'plain' WHEN d[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
        FROM h),
    cut AS (SELECT *, array_to_string(tokens[1:a], '') AS prefix, array_to_string(tokens[a + 1:b], '') AS middle, array_to_string(tokens[b + 1:], '') AS suffix FROM forms)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                  ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
           sha256(text) AS restored_sha256
    FROM cut"""


def oracle_sql() -> dict[str, str]:
    return {
        "op6_url_filter": _url_filter_sql(),
        "op11_target_resampling": _TARGET_SQL,
        "op12_line_dedup": _LINES_SQL,
        "op13_fill_middle": _MIDDLE_SQL,
        "op3_chat_format": f"""
            WITH turns AS (
                SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                UNION ALL
                SELECT -1, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS t(turn, role)
            )
            SELECT conv_id,
                   count(*) AS n_turns,
                   sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
                   coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
                   sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
                   (3 + sum(20 + length({_escaped("role")}) + length({_escaped("text")})))::BIGINT AS formatted_chars
            FROM turns
            GROUP BY conv_id
        """,
        "op10_block_names": """
            SELECT doc_id,
                   max(doc_id) OVER same AS keep_id,
                   count(*) OVER same AS group_size,
                   doc_id = max(doc_id) OVER same AS kept,
                   sha256(coalesce(text, '')) AS text_sha256
            FROM documents
            WINDOW same AS (PARTITION BY coalesce(text, ''))
        """,
    }
