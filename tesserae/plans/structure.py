"""Queries of records: coercions, predicates, joins, splits, samples and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import checks
from ..operators import audits, balance, linking, splits
from .views import FIELDS, MANIFEST, OBS, RECORDS, VECTORS, fields, manifest, obs, records, table, vectors

_TERMS = ["H&E", " Comet", "CosMx SMI", "bright field", "DAPI", "AF", "marker", "Tear", "folding", "hard-negative", "x"]


def _term(column: str) -> F.Column:
    return F.element_at(F.array(*[F.lit(x) for x in _TERMS]), (F.col(column) % len(_TERMS) + 1).cast("int"))


_TERM_SQL = f"[{', '.join(repr(x) for x in _TERMS)}][({{}} % {len(_TERMS)} + 1)::INT]"


def coerce_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select("n_nationkey", _term("n_nationkey").alias("term"))
    return rows.select("n_nationkey", schema.modality(F.col("term")).alias("modality"), schema.channel_role(F.col("term")).alias("role"), schema.artifact(F.col("term")).alias("artifact"))


def _case(column: str, values: dict[str, str], rest: str = "NULL") -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE {rest} END"


def normalize_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", schema.normal_name(name).alias("name"), schema.normal_term(name).alias("term"))


def spacing_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = F.when(F.col("p_size") % 3 == 0, F.array(F.col("p_retailprice"))).otherwise(F.array(F.col("p_retailprice"), F.col("p_size") - F.lit(10.0)))
    rows = table(spark, sf_dir, "part").select("p_partkey", checks.spacing(pair).alias("s"))
    return rows.select("p_partkey", "s.y", "s.x")


def mask_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose line numbers keep to a domain, and whose numbers are not negative."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("v"))
    return rows.select("l_orderkey", checks.in_domain(F.col("v"), 1, 2, 3, 4, 5).alias("known"), F.forall("v", lambda x: x >= 0).alias("natural"))


def hex_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.when(F.col("record") % 5 == 0, F.upper("digest")).when(F.col("record") % 7 == 0, F.lit("0" * 64)).otherwise(F.col("digest"))
    return manifest(spark, sf_dir).select("record", checks.is_digest(key).alias("ok"), checks.is_digest(F.substring(key, 1, 40), 40).alias("ok_commit"))


def presence_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("c_custkey") % 4 == 0, F.lit("  ")).when(F.col("c_custkey") % 3 == 0, F.lit(None)).otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", checks.is_present(text).alias("present"), checks.is_present(F.col("c_custkey") - 1).alias("zero_counts"))


def safe_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of pages; every seventh is made to leave its folder, every fifth is absolute."""
    path = F.regexp_extract("url", r"^[^:]*://[^/?#]*/([^?#]*)", 1)
    path = F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("a/../../"), path)).when(F.col("page_id") % 5 == 0, F.concat(F.lit("/"), path)).otherwise(path)
    return table(spark, sf_dir, "pages").select("page_id", checks.is_safe_path(path).alias("ok"))


def bounded_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.try_divide("l_discount", F.col("l_tax")).alias("share"))
    return rows.groupBy("l_suppkey").agg(F.count_if(~checks.is_fraction(F.col("share"))).alias("outside"), F.count_if(F.col("share").isNull()).alias("missing"))


def json_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("s_suppkey") % 5 == 0, F.lit(float("nan"))).when(F.col("s_suppkey") % 7 == 0, F.lit(float("inf"))).otherwise(F.col("s_acctbal"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", checks.finite(value).alias("value"))


def json_props_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.from_json("props", "k INT", {"mode": "PERMISSIVE"})
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(props["k"]).alias("n"), F.sum(props["k"]).alias("total"), F.count_if(props["k"].isNull()).alias("broken"))


def json_flag_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members that are literally true; absence is not approval."""
    text = F.concat(F.lit('{"approved":'), F.when(F.col("event_id") % 3 == 0, "true").when(F.col("event_id") % 3 == 1, '"true "').otherwise("null"), F.lit("}"))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(checks.truth("$.approved", text)).alias("approved"), F.count_if(checks.truth("$.other", text)).alias("other"))


_CHANNELS = ["DAPI", "Hoechst 33342", "AF-488", "Autofluorescence Cy5", "WGA", "CD298/B2M", "PanCK", "cytoplasm", "FITC", "Cy5", "CD45", "EpCAM", "Immune mix", "GFAP", "Background", "Ki-67"]


def _channel(column: str) -> F.Column:
    return F.element_at(F.array(*[F.lit(x) for x in _CHANNELS]), (F.col(column) % len(_CHANNELS) + 1).cast("int"))


_CHANNEL_SQL = f"[{', '.join(repr(x) for x in _CHANNELS)}][({{}} % {len(_CHANNELS)} + 1)::INT]"


def role_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of channel names under the rules of two modalities."""
    name = _channel("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", schema.role_of_channel(name, "comet").alias("comet"), schema.role_of_channel(name, "cosmx").alias("cosmx"))


def structural_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural channels of each brand's panel, by role, then name; panels without a nuclear channel abstain."""
    name = _channel("p_partkey")
    rows = table(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", "p_type").alias("panel"), name.alias("name"), schema.role_of_channel(name, "cosmx").alias("role")).distinct()
    some = rows.where(F.col("role").isin(*schema.STRUCTURAL)).withColumn("rank", F.array_position(F.array(*[F.lit(x) for x in schema.STRUCTURAL]), F.col("role")))
    view = some.groupBy("panel").agg(F.array_sort(F.collect_set(F.struct("rank", F.lower("name").alias("name")))).alias("v"), F.bool_or(F.col("role") == "nuclear").alias("nuclear"))
    view = view.select("panel", F.array_join(F.transform("v", lambda x: x["name"]), ",").alias("channels"), (~F.col("nuclear") | (F.size("v") < 2)).alias("abstain"))
    return rows.select("panel").distinct().join(view, "panel", "left").select("panel", F.when(~F.col("abstain"), F.col("channels")).alias("channels"), F.coalesce("abstain", F.lit(True)).alias("abstain"))


def channel_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel axes of images of many shapes: named, given, or guessed."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("int")
    shape = F.when(k % 5 == 0, F.array(size, size + 9)).when(k % 5 == 1, F.array(size, F.lit(100), F.lit(90))).when(k % 5 == 2, F.array(F.lit(100), F.lit(90), size)).otherwise(F.array(F.lit(100), size, F.lit(70)))
    axis, names = F.when(k % 5 == 3, (k % 6 - 3).cast("int")), F.when((k % 5 == 2) | (k % 5 == 4), size)
    return table(spark, sf_dir, "part").select("p_partkey", schema.channel_axis(shape, axis, names).alias("axis"))


def bright_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bright-field pixels of one, three or four channels, some in reverse order, as red, green, blue."""
    every = F.array(F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"), F.lit(1.0))
    count = F.element_at(F.array(F.lit(1), F.lit(3), F.lit(4)), (F.col("l_linenumber") % 3 + 1).cast("int"))
    values = F.slice(every, F.lit(1), count)
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", schema.bright_channels(values).alias("rgb"), schema.bright_channels(values, "bgr").alias("bgr"))
    last = lambda c: F.sum(F.element_at(c, -1))
    return rows.groupBy("l_suppkey").agg(F.count_if(F.size("rgb") == 3).alias("colours"), F.round(last("rgb"), 4).alias("blue"), F.round(last("bgr"), 4).alias("red"))


def adapter_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The adapter of each spelled modality, and the role that it gives a channel; unknown modalities are listed as such."""
    kind, name = schema.modality(_term("n_nationkey")), _channel("n_nationkey")
    role = F.when(kind == "he", F.lit("brightfield")).when(kind == "comet", schema.role_of_channel(name, "comet")).when(kind == "cosmx", schema.role_of_channel(name, "cosmx")).otherwise("refused")
    return table(spark, sf_dir, "nation").select("n_nationkey", F.coalesce(kind, F.lit("unknown")).alias("adapter"), role.alias("role"))


def role_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each region, the places of its nations, in order of their keys, by role."""
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    rows = table(spark, sf_dir, "nation").select("n_regionkey", (F.col("n_nationkey") % 3).alias("role"), (F.row_number().over(w) - 1).alias("place"))
    places = F.array_join(F.transform(F.array_sort(F.collect_list("place")), lambda x: x.cast("string")), ",")
    return rows.groupBy("n_regionkey", "role").agg(places.alias("places"))


def role_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of a region by role priority, then name without regard to case."""
    w = Window.partitionBy("n_regionkey").orderBy(F.col("n_nationkey") % 3, F.lower("n_name"), "n_nationkey")
    return table(spark, sf_dir, "nation").select("n_regionkey", "n_name", F.row_number().over(w).alias("place"))


def channel_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second nation of role 1 in each region, or its first."""
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    rows = table(spark, sf_dir, "nation").where("n_nationkey % 3 = 1").withColumn("k", F.row_number().over(w)).where("k <= 2")
    return rows.groupBy("n_regionkey").agg(F.max_by("n_name", "k").alias("channel"))


def metric_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("s_suppkey") % 6 == 0, None).otherwise(F.col("s_acctbal"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.when(value.isNull(), "n/a").otherwise(F.format_string("%.2f", value)).alias("shown"))


def registry_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.rpad("p_brand", 12, " "), F.rpad(F.substring("p_type", 1, 10), 10, " "), F.lpad(F.col("p_size").cast("string"), 4, " ")).alias("line"))


def flatten_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested results to dotted columns."""
    rows = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.struct(F.count("*").alias("n"), F.struct(F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high")).alias("key")).alias("s"))
    return rows.select("o_orderstatus", *[F.col(x).alias(x.replace("s.", "", 1)) for x in ("s.n", "s.key.low", "s.key.high")])


def embedding_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return rows.groupBy("role").agg(F.count("*").alias("n"), F.min(F.size("embedding")).cast("int").alias("dims"), F.round(F.avg(norm), 5).alias("mean_norm"))


def url_source_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split("url", "/")
    host, kind = F.lower(F.element_at(parts, 3)), F.element_at(parts, 4)
    cohort = F.when(F.endswith(host, F.lit(".net")), "net").when(F.startswith(host, F.lit("www.")), "www").otherwise("other")
    return table(spark, sf_dir, "pages").select("page_id", cohort.alias("cohort"), F.concat_ws(":", cohort, kind).alias("group_id"))


def synthetic_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds of images: a base, a step for each region, and the nation's number."""
    rows = table(spark, sf_dir, "nation")
    return rows.select("n_nationkey", (F.lit(7) + F.col("n_regionkey") * 10007 + F.col("n_nationkey")).alias("seed"))


def join_exact_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without their mapping, mappings without their records, and keys that repeat."""
    left = table(spark, sf_dir, "orders").groupBy(F.col("o_orderkey").alias("k")).agg(F.count("*").alias("a"))
    right = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("b"))
    both = left.join(right, "k", "full")
    kind = F.when(F.col("a").isNull(), "no record").when(F.col("b").isNull(), "no mapping").when(F.col("b") > 1, "repeated").otherwise("paired")
    return both.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.min("k").alias("first"))


def asset_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a balance, as listed assets, that no urgent order or purchase uses, and the users that are not listed."""
    customers = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    orders, events = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'"), table(spark, sf_dir, "events").where("event_type = 'purchase'")
    used = orders.select(F.col("o_custkey").alias("k")).unionByName(events.select(F.col("user_id").alias("k"))).distinct()
    unused = customers.join(used, "k", "left_anti").withColumn("side", F.lit("unused"))
    return unused.unionByName(used.join(customers, "k", "left_anti").withColumn("side", F.lit("orphan")))


def lock_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed assets against a lock: the columns that differ."""
    lock = table(spark, sf_dir, "part").select("p_partkey", F.sha2("p_name", 256).alias("sha"), "p_size")
    seen = table(spark, sf_dir, "part").select("p_partkey", F.sha2(F.when(F.col("p_partkey") % 11 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")), 256).alias("seen_sha"), F.when(F.col("p_partkey") % 13 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("seen_size"))
    wrong = F.concat_ws(",", F.when(F.col("sha") != F.col("seen_sha"), "sha"), F.when(F.col("p_size") != F.col("seen_size"), "size"))
    return lock.join(seen, "p_partkey").select("p_partkey", wrong.alias("wrong")).where("wrong <> ''")


def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.overlap(manifest(spark, sf_dir), "split", ["patient", "block", "digest"])


def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.leaks(manifest(spark, sf_dir), "patient", "split", "record")


def role_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups without a role and roles without a group: suppliers of lines, and users of events."""
    groups = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("patient")).distinct()
    roles = table(spark, sf_dir, "events").select(F.col("user_id").alias("patient")).distinct()
    missing = groups.join(roles, "patient", "left_anti").withColumn("kind", F.lit("no role"))
    return missing.unionByName(roles.join(groups, "patient", "left_anti").withColumn("kind", F.lit("no group")))


def correlation_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that share a nation or a rounded balance."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey")).alias("nation"), F.floor(F.col("s_acctbal") / 10).alias("balance"))
    return linking.shared_components(rows, "s_suppkey", ["nation", "balance"])


def hash_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumn("key", splits.order_key(7, F.col("c_mktsegment"), F.col("c_custkey")))
    return splits.ranked(rows, ["c_mktsegment"], "key").select("c_mktsegment", "c_custkey", "place")


def hash_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.sha2(F.col("c_custkey").cast("string"), 256)
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.min_by("c_custkey", key).alias("c_custkey"), F.min(key).alias("digest"))


def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey").distinct()
    return splits.group_split(groups, ["c_mktsegment"], 0.2, 11, F.col("c_mktsegment"), F.col("c_custkey")).drop("order_key")


def logo_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.leave_one_out(table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey"), ["n_regionkey"], "n_nationkey", 3)


_SHARES = {"fit": 0.6, "calibration": 0.25, "test": 0.15}


def _slides(spark: SparkSession, sf_dir: str, stratum: F.Column | None = None) -> DataFrame:
    """Suppliers as slides of the strata of their nation's number, with as many images as lines."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("images"))
    return table(spark, sf_dir, "supplier").join(lines, "s_suppkey").select((F.col("s_nationkey") % 3 if stratum is None else stratum).alias("stratum"), "s_suppkey", "images")


def split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of each role, by largest remainder, of the strata that have enough."""
    groups = _slides(spark, sf_dir).groupBy("stratum").agg(F.count("*").alias("n")).where("n >= 3")
    return splits.sizes_by_remainder(groups, ["stratum"], _SHARES)


def balanced_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slides dealt to roles of fixed sizes so that their images are near the roles' shares."""
    slides = _slides(spark, sf_dir)
    found = balance.balanced(slides, ["stratum"], "s_suppkey", "images", _with_shares(split_sizes(spark, sf_dir)), 5)
    images = slides.select("stratum", F.col("s_suppkey").cast("string").alias("group"), "images")
    return found.join(images, ["stratum", "group"]).groupBy("stratum", "role").agg(F.count("*").alias("slides"), F.sum("images").alias("images"))


def _with_shares(sizes: DataFrame) -> DataFrame:
    return sizes.withColumn("share", F.coalesce(*[F.when(F.col("role") == r, F.lit(x)) for r, x in _SHARES.items()]))


def balanced_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least deviation of the roles' images from their shares, of the nations with three to nine slides."""
    slides = _slides(spark, sf_dir, F.col("s_nationkey"))
    groups = slides.groupBy("stratum").agg(F.count("*").alias("n")).where("n BETWEEN 3 AND 9")
    sizes = _with_shares(splits.sizes_by_remainder(groups, ["stratum"], _SHARES))
    found = balance.balanced(slides.join(groups, "stratum", "left_semi"), ["stratum"], "s_suppkey", "images", sizes, 5)
    return found.groupBy("stratum").agg(F.count("*").alias("slides"), F.round(F.first("objective"), 6).alias("objective"))


def split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark, sf_dir).groupBy("split", "status").agg(F.count("*").alias("n"), F.count_distinct("patient").alias("patients"), F.min("digest").alias("first_digest"))


def split_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every priority occurs in every split, and how often."""
    rows = manifest(spark, sf_dir).groupBy("priority").agg(*[F.count_if(F.col("split") == s).alias(s) for s in ("train", "validation", "test")], F.count("*").alias("n"))
    return rows.withColumn("covered", (F.col("train") > 0) & (F.col("validation") > 0) & (F.col("test") > 0))


def priority_reservoir(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = splits.reservoir(table(spark, sf_dir, "orders"), 500, 5, F.col("o_orderkey"))
    return found.select("o_orderkey", "order_key")


def limit_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = splits.limit_per_group(table(spark, sf_dir, "orders"), ["o_orderpriority"], 20, 5, F.col("o_orderkey"))
    return found.select("o_orderpriority", "o_orderkey", "place")


def linspace_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.even_places(table(spark, sf_dir, "customer"), ["c_mktsegment"], ["c_custkey"], 16).select("c_mktsegment", "c_custkey", "place")


def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.every(table(spark, sf_dir, "customer"), ["c_nationkey"], ["c_custkey"], 10).select("c_nationkey", "c_custkey", "place")


def candidate_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = splits.quantile_grid(obs(spark, sf_dir).where("valid"), ["stratum"], "score", 33)
    return found.select("stratum", F.round("candidate", 9).alias("candidate")).distinct()


def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of union, intersection and differences of two masks of samples."""
    rows = obs(spark, sf_dir)
    a, b = rows.where("target AND score > 0.5").select("sample"), rows.where("NOT valid").select("sample")
    parts = {"union": a.union(b).distinct(), "intersection": a.intersect(b), "only_a": a.subtract(b), "only_b": b.subtract(a)}
    out = None
    for name, x in parts.items():
        one = x.agg(F.count("*").alias("n"), F.sum("sample").alias("total")).withColumn("part", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def union_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation"), F.lit("customer").alias("kind"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nation"))
    rows = a.unionByName(b, allowMissingColumns=True)
    return rows.groupBy("nation", "kind").agg(F.count("*").alias("n"), F.min("k").alias("first"))


def required_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combinations of event type and hour class that do not occur."""
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("event_id") % 7).alias("cell"), (F.col("event_id") % 5).alias("other"))
    need = rows.select("event_type").distinct().withColumn("cell", F.explode(F.expr("sequence(0L, 8L)")))
    return need.join(rows.select("event_type", "cell").distinct(), ["event_type", "cell"], "left_anti")


def group_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).groupBy("source", "lang").agg(F.count_distinct("decision").alias("kinds"))
    return rows.withColumn("complete", F.col("kinds") == 3)


def dup_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.duplicates(table(spark, sf_dir, "documents").select("source", F.sha2("text", 256).alias("sha")), ["source", "sha"])


def content_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the canonical JSON text of a record: members in the order of their names, strings escaped, nulls written."""
    members = {"size": F.col("p_size").cast("int"), "name": F.concat(F.col("p_name"), F.lit(' "x"\\')), "brand": F.when(F.col("p_partkey") % 4 != 0, F.col("p_brand")), "price": F.col("p_retailprice")}
    return table(spark, sf_dir, "part").select("p_partkey", checks.canonical_sha(members).alias("sha"))


def anonymous_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense labels of sources in order of their first record."""
    first = table(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").alias("first"))
    return first.select("source", F.concat(F.lit("group-"), F.lpad(F.row_number().over(Window.orderBy("first", "source")).cast("string"), 6, "0")).alias("label"))


def _rules() -> list[audits.Rule]:
    c = F.col
    return [
        audits.Rule("record_not_positive", "error", "record", c("record") <= 0),
        audits.Rule("patient_missing", "error", "patient", ~checks.is_present(c("patient"))),
        audits.Rule("block_malformed", "error", "block", ~c("block").rlike("^[0-9]-[A-Z ]+-[0-9]+$")),
        audits.Rule("price_missing", "error", "price", c("price").isNull() | (c("price") <= 0)),
        audits.Rule("price_high", "warning", "price", c("price") > 400000),
        audits.Rule("status_unknown", "error", "status", ~c("status").isin("F", "O", "P")),
        audits.Rule("status_open", "warning", "status", c("status") == "O"),
        audits.Rule("adjudication_pending", "blocker", "status", c("status") == "P"),
        audits.Rule("split_unknown", "error", "split", ~c("split").isin("train", "validation", "test")),
        audits.Rule("digest_short", "error", "digest", ~checks.is_digest(c("digest"))),
        audits.Rule("priority_unset", "blocker", "priority", c("priority").rlike("NOT")),
    ]


def _shared_rules() -> list[audits.Rule]:
    """Of records with others: what breaks the rule among the records that share the field."""
    crosses = F.min("split") < F.max("split")
    return [
        audits.Rule("digest_repeated", "error", "digest", F.count("*") > 1),
        audits.Rule("patient_crosses_splits", "error", "patient", crosses),
        audits.Rule("block_crosses_splits", "warning", "block", crosses),
    ]


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of manifest records by themselves, and of what they share with others; records that are not valid by themselves
    count for none. A key's values that break a rule are found first, and only keys are held against them."""
    rows = manifest(spark, sf_dir)
    found = audits.issues(rows, "record", _rules())
    for rule in _shared_rules():
        key = rule.field
        broken = rows.where("price > 0 AND patient IS NOT NULL").groupBy(key).agg(rule.breached.alias("broken")).where("broken").select(key)
        named = [F.lit(x).alias(n) for n, x in (("code", rule.code), ("severity", rule.severity), ("field", rule.field))]
        found = found.unionByName(rows.select("record", key).join(broken, key, "left_semi").select("record", *named))
    return found


def manifest_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(spark, sf_dir)


def contract_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.status(_issues(spark, sf_dir))


def eligibility_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons why a slide is not reported; eligible without any."""
    rows = fields(spark, sf_dir).groupBy("slide").agg(F.count("*").alias("n"), F.sum("n_valid").alias("valid"), F.sum("label").alias("positive"))
    why = F.concat_ws(",", F.when(F.col("n") < 200, "few fields"), F.when(F.col("valid") < 300, "little area"), F.when(F.col("positive") < 120, "few positives"))
    return rows.select("slide", why.alias("reasons"), (why == "").alias("eligible"))


def method_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, as methods, all of whose orders, as resources, are final; those without any are not eligible."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_and(F.col("o_orderstatus") != "P").alias("final"))
    ready = F.coalesce("final", F.lit(False)) & (F.col("c_acctbal") > 0)
    return table(spark, sf_dir, "customer").join(orders, "c_custkey", "left").select("c_custkey", ready.alias("eligible"))


def abstention_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed records stay as abstentions instead of being dropped."""
    rows = fields(spark, sf_dir)
    reason = F.when(F.col("n_valid") == 0, "no valid area").when(F.col("positives") == 0, "no target")
    return rows.groupBy(F.coalesce(reason, F.lit("scored")).alias("outcome")).agg(F.count("*").alias("n"), F.sum(F.when(reason.isNull(), F.col("tp"))).alias("tp"))


def content_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts across tables, by digest."""
    docs = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha"), F.lit("documents").alias("t"))
    rows = docs.unionByName(table(spark, sf_dir, "benchmark").select(F.sha2("text", 256).alias("sha"), F.lit("benchmark").alias("t")))
    return rows.groupBy("sha").agg(F.count("*").alias("n"), F.count_distinct("t").alias("tables")).where("n > 1")


QUERIES = {
    f.__name__: f
    for f in (
        coerce_alias, normalize_term, spacing_check, mask_domain, hex_predicate, presence_pred, safe_path, bounded_check, json_safe, json_props_scan,
        json_flag_scan, role_case, structural_view, channel_axis, bright_adapter, adapter_dispatch, role_indices, role_order, channel_select, metric_format, registry_format, flatten_struct, embedding_scan,
        url_source_identity, synthetic_ids, join_exact_pairing, asset_anti_join, lock_verify, split_overlap, split_leakage, role_cover,
        correlation_components, hash_order, hash_select, group_split, logo_roles, split_sizes, balanced_assignment, balanced_objective, split_report, split_coverage, priority_reservoir, limit_per_group,
        linspace_cap, stride_sample, candidate_grid, set_ops, union_rows, required_cells, group_coverage, dup_identity, content_sha, anonymous_labels,
        manifest_issues, contract_status, eligibility_reasons, method_eligibility, abstention_rows, content_duplicates,
    )
}

def _roles_sql(modality: str) -> str:
    rules, rest = (schema.COMET_ROLES, "marker") if modality == "comet" else (schema.COSMX_ROLES, "morphology")
    return "CASE " + " ".join(f"WHEN regexp_matches(n, '{'|'.join(terms)}') THEN '{role}'" for role, terms in rules) + f" ELSE '{rest}' END"


_T = _TERM_SQL.format("n_nationkey")
_ISSUES = f"""{MANIFEST}, sound AS (SELECT * FROM manifest WHERE price > 0 AND patient IS NOT NULL),
    dc AS (SELECT digest, count(*) AS copies FROM sound GROUP BY digest), pc AS (SELECT patient, count(DISTINCT split) AS splits FROM sound GROUP BY patient), bc AS (SELECT block, count(DISTINCT split) AS block_splits FROM sound GROUP BY block),
    m AS (SELECT * FROM manifest LEFT JOIN dc USING (digest) LEFT JOIN pc USING (patient) LEFT JOIN bc USING (block)), issues AS (
    SELECT record, 'price_missing' AS code, 'error' AS severity, 'price' AS field FROM m WHERE price IS NULL OR price <= 0
    UNION ALL SELECT record, 'record_not_positive', 'error', 'record' FROM m WHERE record <= 0
    UNION ALL SELECT record, 'patient_missing', 'error', 'patient' FROM m WHERE patient IS NULL
    UNION ALL SELECT record, 'block_malformed', 'error', 'block' FROM m WHERE NOT regexp_full_match(block, '[0-9]-[A-Z ]+-[0-9]+')
    UNION ALL SELECT record, 'price_high', 'warning', 'price' FROM m WHERE price > 400000
    UNION ALL SELECT record, 'status_unknown', 'error', 'status' FROM m WHERE status NOT IN ('F', 'O', 'P')
    UNION ALL SELECT record, 'status_open', 'warning', 'status' FROM m WHERE status = 'O'
    UNION ALL SELECT record, 'adjudication_pending', 'blocker', 'status' FROM m WHERE status = 'P'
    UNION ALL SELECT record, 'priority_unset', 'blocker', 'priority' FROM m WHERE regexp_matches(priority, 'NOT')
    UNION ALL SELECT record, 'digest_repeated', 'error', 'digest' FROM m WHERE copies > 1
    UNION ALL SELECT record, 'patient_crosses_splits', 'error', 'patient' FROM m WHERE splits > 1
    UNION ALL SELECT record, 'block_crosses_splits', 'warning', 'block' FROM m WHERE block_splits > 1)"""
def _sizes(stratum: str, enough: str) -> str:
    """CTEs up to ``sizes`` (stratum, role, size), by largest remainder."""
    return f"""n AS (SELECT {stratum} AS stratum, count(*) AS n FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem) GROUP BY ALL HAVING {enough}),
        w AS (SELECT stratum, n, role, i, n * share AS wanted, greatest(1, floor(n * share + 1e-9))::INT AS size FROM n, (VALUES ('fit', 0, 0.6::DOUBLE), ('calibration', 1, 0.25::DOUBLE), ('test', 2, 0.15::DOUBLE)) AS t(role, i, share)),
        a AS (SELECT *, sign(n - sum(size) OVER s) AS step FROM w WINDOW s AS (PARTITION BY stratum)),
        b AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY size + step < 1, round((wanted - size) * step, 9) DESC, i) AS k FROM a),
        c AS (SELECT * REPLACE (CASE WHEN k = 1 THEN size + step ELSE size END AS size) FROM b), d AS (SELECT * EXCLUDE (step, k), sign(n - sum(size) OVER (PARTITION BY stratum)) AS step FROM c),
        e AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY size + step < 1, round((wanted - size) * step, 9) DESC, i) AS k FROM d),
        f AS (SELECT * REPLACE (CASE WHEN k = 1 THEN size + step ELSE size END AS size) FROM e), g AS (SELECT * EXCLUDE (step, k), sign(n - sum(size) OVER (PARTITION BY stratum)) AS step FROM f),
        h AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY size + step < 1, round((wanted - size) * step, 9) DESC, i) AS k FROM g),
        sizes AS (SELECT stratum, role, (CASE WHEN k = 1 THEN size + step ELSE size END)::INT AS size FROM h)"""


SQL = {
    "coerce_alias": f"""WITH t AS (SELECT n_nationkey, {_T} AS term FROM nation)
        SELECT n_nationkey, {_case("replace(lower(trim(term)), ' ', '')", schema.MODALITIES)} AS modality,
               {_case("replace(lower(trim(term)), ' ', '_')", schema.ROLE_ALIASES | {x: x for x in schema.ROLES}, "'unknown'")} AS role,
               {_case("translate(lower(trim(term)), '- ', '__')", schema.ARTIFACT_ALIASES | {x: x for x in schema.ARTIFACTS})} AS artifact FROM t""",
    "normalize_term": "SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS name, translate(lower(trim(p_name)), '- ', '__') AS term FROM part",
    "spacing_check": """SELECT p_partkey, CASE WHEN p_size % 3 = 0 OR (p_size > 10) THEN CASE WHEN p_retailprice > 0 THEN p_retailprice END END AS y,
        CASE WHEN p_size % 3 = 0 THEN p_retailprice WHEN p_size > 10 THEN p_size - 10.0::DOUBLE END AS x FROM part""",
    "mask_domain": "SELECT l_orderkey, bool_and(l_linenumber BETWEEN 1 AND 5) AS known, bool_and(l_linenumber >= 0) AS natural FROM lineitem GROUP BY l_orderkey",
    "hex_predicate": f"""WITH {MANIFEST}, k AS (SELECT record, CASE WHEN record % 5 = 0 THEN upper(digest) WHEN record % 7 = 0 THEN repeat('0', 64) ELSE digest END AS key FROM manifest)
        SELECT record, regexp_full_match(key, '[0-9a-f]{{64}}') AND NOT regexp_full_match(key, '0+') AS ok,
               regexp_full_match(substr(key, 1, 40), '[0-9a-f]{{40}}') AND NOT regexp_full_match(substr(key, 1, 40), '0+') AS ok_commit FROM k""",
    "presence_pred": "SELECT c_custkey, c_custkey % 4 <> 0 AND c_custkey % 3 <> 0 AS present, true AS zero_counts FROM customer",
    "safe_path": "SELECT page_id, page_id % 7 <> 0 AND page_id % 5 <> 0 AND regexp_extract(url, '^[^:]*://[^/?#]*/([^?#]*)', 1) <> '' AS ok FROM pages",
    "bounded_check": """WITH x AS (SELECT l_suppkey, l_discount / nullif(l_tax, 0) AS share FROM lineitem)
        SELECT l_suppkey, count(*) FILTER (share IS NOT NULL AND NOT share BETWEEN 0 AND 1) AS outside, count(*) FILTER (share IS NULL) AS missing FROM x GROUP BY l_suppkey""",
    "json_safe": "SELECT s_suppkey, CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0 THEN s_acctbal END AS value FROM supplier",
    "json_props_scan": """SELECT event_type, count(props->>'k') AS n, sum((props->>'k')::INT)::BIGINT AS total, count(*) FILTER (props->>'k' IS NULL) AS broken FROM events GROUP BY event_type""",
    "json_flag_scan": "SELECT event_type, count(*) FILTER (event_id % 3 = 0) AS approved, 0::BIGINT AS other FROM events GROUP BY event_type",
    "role_case": f"""WITH c AS (SELECT p_partkey, regexp_replace(lower({_CHANNEL_SQL.format("p_partkey")}), '[^a-z0-9]+', '', 'g') AS n FROM part)
        SELECT p_partkey, {_roles_sql("comet")} AS comet, {_roles_sql("cosmx")} AS cosmx FROM c""",
    "structural_view": f"""WITH c AS (SELECT DISTINCT p_brand || '/' || p_type AS panel, {_CHANNEL_SQL.format("p_partkey")} AS name FROM part), m AS (SELECT *, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS n FROM c),
        r AS (SELECT *, {_roles_sql("cosmx")} AS role FROM m), k AS (SELECT *, list_position(['nuclear', 'autofluorescence', 'membrane', 'cytoplasm', 'immune', 'morphology'], role) AS rank FROM r),
        v AS (SELECT panel, string_agg(lower(name), ',' ORDER BY rank, lower(name)) FILTER (rank > 0) AS channels, count(*) FILTER (role = 'nuclear') = 0 OR count(*) FILTER (rank > 0) < 2 AS abstain FROM k GROUP BY panel)
        SELECT panel, CASE WHEN NOT abstain THEN channels END AS channels, abstain FROM v""",
    "channel_axis": """WITH s AS (SELECT p_partkey AS k, p_size AS n FROM part)
        SELECT k AS p_partkey, CASE k % 5 WHEN 0 THEN NULL
            WHEN 1 THEN CASE WHEN n <= 64 AND n < 90 THEN 0 ELSE 2 END
            WHEN 2 THEN 2
            WHEN 3 THEN ((k % 6 - 3) + 3) % 3
            ELSE CASE WHEN n = 70 THEN 2 WHEN n = 100 THEN 0 ELSE 1 END END::INT AS axis FROM s""",
    "bright_adapter": """WITH c AS (SELECT l_suppkey, l_quantity AS q, l_discount AS d, l_tax AS t, l_linenumber % 3 AS k FROM lineitem)
        SELECT l_suppkey, count(*) FILTER (k <> 0) AS colours, round(sum(CASE WHEN k = 0 THEN q ELSE t END), 4) AS blue, round(sum(q), 4) AS red FROM c GROUP BY l_suppkey""",
    "adapter_dispatch": f"""WITH c AS (SELECT n_nationkey, {_T} AS term, regexp_replace(lower({_CHANNEL_SQL.format("n_nationkey")}), '[^a-z0-9]+', '', 'g') AS n FROM nation),
        m AS (SELECT *, {_case("replace(lower(trim(term)), ' ', '')", schema.MODALITIES)} AS kind FROM c)
        SELECT n_nationkey, coalesce(kind, 'unknown') AS adapter, CASE kind WHEN 'he' THEN 'brightfield' WHEN 'comet' THEN {_roles_sql("comet")} WHEN 'cosmx' THEN {_roles_sql("cosmx")} ELSE 'refused' END AS role FROM m""",
    "role_indices": """WITH p AS (SELECT n_regionkey, n_nationkey % 3 AS role, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS place FROM nation)
        SELECT n_regionkey, role, string_agg(place::VARCHAR, ',' ORDER BY place) AS places FROM p GROUP BY ALL""",
    "role_order": "SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey % 3, lower(n_name), n_nationkey) AS place FROM nation",
    "channel_select": """WITH k AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation WHERE n_nationkey % 3 = 1)
        SELECT n_regionkey, arg_max(n_name, k) AS channel FROM k WHERE k <= 2 GROUP BY n_regionkey""",
    "metric_format": "SELECT s_suppkey, CASE WHEN s_suppkey % 6 = 0 THEN 'n/a' ELSE printf('%.2f', s_acctbal) END AS shown FROM supplier",
    "registry_format": "SELECT p_partkey, rpad(p_brand, 12, ' ') || rpad(substr(p_type, 1, 10), 10, ' ') || lpad(p_size::VARCHAR, 4, ' ') AS line FROM part",
    "flatten_struct": 'SELECT o_orderstatus, count(*) AS n, min(o_orderkey) AS "key.low", max(o_orderkey) AS "key.high" FROM orders GROUP BY o_orderstatus',
    "embedding_scan": f"WITH {VECTORS} SELECT role, count(*) AS n, min(len(embedding))::INT AS dims, round(avg(sqrt(list_dot_product(embedding, embedding))), 5) AS mean_norm FROM vectors GROUP BY role",
    "url_source_identity": """WITH p AS (SELECT page_id, lower(split_part(url, '/', 3)) AS host, split_part(url, '/', 4) AS kind FROM pages),
        c AS (SELECT *, CASE WHEN host LIKE '%.net' THEN 'net' WHEN host LIKE 'www.%' THEN 'www' ELSE 'other' END AS cohort FROM p) SELECT page_id, cohort, cohort || ':' || kind AS group_id FROM c""",
    "synthetic_ids": "SELECT n_nationkey, 7 + n_regionkey * 10007 + n_nationkey AS seed FROM nation",
    "join_exact_pairing": """WITH a AS (SELECT o_orderkey AS k, count(*) AS a FROM orders GROUP BY k), b AS (SELECT l_orderkey AS k, count(*) AS b FROM lineitem GROUP BY k),
        j AS (SELECT coalesce(a.k, b.k) AS k, CASE WHEN a IS NULL THEN 'no record' WHEN b IS NULL THEN 'no mapping' WHEN b > 1 THEN 'repeated' ELSE 'paired' END AS kind FROM a FULL JOIN b ON a.k = b.k)
        SELECT kind, count(*) AS n, min(k) AS first FROM j GROUP BY kind""",
    "asset_anti_join": """WITH u AS (SELECT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT user_id FROM events WHERE event_type = 'purchase'),
        c AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0)
        SELECT k, 'unused' AS side FROM c WHERE k NOT IN (SELECT k FROM u)
        UNION ALL SELECT k, 'orphan' FROM u WHERE k NOT IN (SELECT k FROM c)""",
    "lock_verify": "SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 11 = 0 THEN 'sha' END, CASE WHEN p_partkey % 13 = 0 THEN 'size' END) AS wrong FROM part WHERE p_partkey % 11 = 0 OR p_partkey % 13 = 0",
    "split_overlap": f"""WITH {MANIFEST}, x AS (SELECT 'patient' AS family, patient::VARCHAR AS value, split FROM manifest UNION ALL SELECT 'block', block, split FROM manifest UNION ALL SELECT 'digest', digest, split FROM manifest),
        v AS (SELECT family, value, count(DISTINCT split) AS roles FROM x GROUP BY ALL) SELECT family, count(*) AS n_values, count(*) FILTER (roles > 1) AS n_shared FROM v GROUP BY family""",
    "split_leakage": f"""WITH {MANIFEST}, m AS (SELECT *, first_value(split) OVER (PARTITION BY patient ORDER BY record, split) AS owner FROM manifest)
        SELECT record, patient, split, owner FROM m WHERE split <> owner""",
    "role_cover": """WITH g AS (SELECT DISTINCT l_suppkey AS patient FROM lineitem), r AS (SELECT DISTINCT user_id AS patient FROM events)
        SELECT patient, 'no role' AS kind FROM (SELECT * FROM g EXCEPT SELECT * FROM r) UNION ALL SELECT patient, 'no group' FROM (SELECT * FROM r EXCEPT SELECT * FROM g)""",
    "split_sizes": f"""WITH {_sizes("s_nationkey % 3", "count(*) >= 3")} SELECT stratum, role, size FROM sizes""",
    "balanced_objective": f"""WITH RECURSIVE {_sizes("s_nationkey", "count(*) BETWEEN 3 AND 9")},
        lines AS (SELECT l_suppkey, count(*) AS images FROM lineitem GROUP BY ALL),
        own AS (SELECT s_nationkey AS stratum, images, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier JOIN lines ON l_suppkey = s_suppkey),
        z AS (SELECT stratum, {", ".join(f"max(size) FILTER (role = '{r}') AS z{i}" for i, r in enumerate(_SHARES))}, sum(size) AS n, (SELECT sum(images) FROM own WHERE own.stratum = sizes.stratum) AS whole FROM sizes GROUP BY stratum),
        deals AS (
            SELECT stratum, 0::BIGINT AS k, z0, z1, z2, 0::BIGINT AS w0, 0::BIGINT AS w1, 0::BIGINT AS w2 FROM z
            UNION
            SELECT stratum, own.k, z0 - (r = 0)::INT, z1 - (r = 1)::INT, z2 - (r = 2)::INT, w0 + images * (r = 0)::INT, w1 + images * (r = 1)::INT, w2 + images * (r = 2)::INT
            FROM deals JOIN own USING (stratum), range(3) AS t(r) WHERE own.k = deals.k + 1 AND CASE r WHEN 0 THEN z0 WHEN 1 THEN z1 ELSE z2 END > 0)
        SELECT stratum, any_value(n)::BIGINT AS slides, round(min({" + ".join(f"abs(w{i} - {x}::DOUBLE * whole)" for i, x in enumerate(_SHARES.values()))}), 6) AS objective
        FROM deals JOIN (SELECT stratum, n, whole FROM z) USING (stratum) WHERE k = n GROUP BY stratum""",
    "correlation_components": """WITH RECURSIVE s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey END AS n, floor(s_acctbal / 10) AS b FROM supplier),
        e AS (SELECT DISTINCT x.k AS a, y.k AS b FROM s x JOIN s y ON x.n = y.n OR x.b = y.b), reach AS (SELECT k AS a, k AS b FROM s UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
        SELECT a AS s_suppkey, min(b) AS component FROM reach GROUP BY a""",
    "hash_order": "SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('7|' || c_mktsegment || '|' || c_custkey)) AS place FROM customer",
    "hash_select": "SELECT c_mktsegment, arg_min(c_custkey, sha256(c_custkey::VARCHAR)) AS c_custkey, min(sha256(c_custkey::VARCHAR)) AS digest FROM customer GROUP BY c_mktsegment",
    "group_split": """WITH g AS (SELECT DISTINCT c_mktsegment, c_custkey FROM customer), o AS (
            SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('11|' || c_mktsegment || '|' || c_custkey)) AS place, round_even(count(*) OVER (PARTITION BY c_mktsegment) * 0.2::DOUBLE, 0) AS size FROM g)
        SELECT c_mktsegment, c_custkey, CASE WHEN place <= size THEN 'calibration' WHEN place <= 2 * size THEN 'test' ELSE 'fit' END AS role FROM o""",
    "logo_roles": """WITH f AS (SELECT a.n_regionkey, a.n_nationkey AS fold, b.n_nationkey, sha256('3|' || a.n_nationkey || '|' || b.n_nationkey) AS h FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey),
        m AS (SELECT *, min(h) FILTER (n_nationkey <> fold) OVER (PARTITION BY n_regionkey, fold) AS least FROM f)
        SELECT n_regionkey, fold, n_nationkey, CASE WHEN n_nationkey = fold THEN 'test' WHEN h = least THEN 'calibration' ELSE 'fit' END AS role FROM m""",
    "split_report": f"WITH {MANIFEST} SELECT split, status, count(*) AS n, count(DISTINCT patient) AS patients, min(digest) AS first_digest FROM manifest GROUP BY ALL",
    "split_coverage": f"""WITH {MANIFEST}, c AS (SELECT priority, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'validation') AS validation, count(*) FILTER (split = 'test') AS test, count(*) AS n FROM manifest GROUP BY priority)
        SELECT *, train > 0 AND validation > 0 AND test > 0 AS covered FROM c""",
    "priority_reservoir": "SELECT o_orderkey, sha256('5|' || o_orderkey) AS order_key FROM orders ORDER BY order_key LIMIT 500",
    "limit_per_group": "SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('5|' || o_orderkey)) AS place FROM orders QUALIFY place <= 20",
    "linspace_cap": """WITH o AS (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS place, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
        SELECT c_mktsegment, c_custkey, place FROM o WHERE n <= 16 OR place IN (SELECT floor(i * (o.n - 1) / 15.0::DOUBLE)::INT FROM range(16) AS r(i))""",
    "stride_sample": """WITH o AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS place, greatest(1, count(*) OVER (PARTITION BY c_nationkey) // 10) AS stride FROM customer)
        SELECT c_nationkey, c_custkey, place FROM o WHERE place % stride = 0""",
    "candidate_grid": f"""WITH {OBS}, q AS (SELECT stratum, unnest(quantile_cont(score, [{", ".join(f"{k}/32.0::DOUBLE" for k in range(33))}])) AS candidate FROM obs WHERE valid GROUP BY stratum)
        SELECT DISTINCT stratum, round(candidate, 9) AS candidate FROM q""",
    "set_ops": f"""WITH {OBS}, a AS (SELECT DISTINCT sample FROM obs WHERE target AND score > 0.5), b AS (SELECT DISTINCT sample FROM obs WHERE NOT valid),
        u AS (SELECT 'union' AS part, * FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersection', * FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
              UNION ALL SELECT 'only_a', * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'only_b', * FROM (SELECT * FROM b EXCEPT SELECT * FROM a))
        SELECT p.part, count(u.sample) AS n, sum(u.sample)::BIGINT AS total FROM (VALUES ('union'), ('intersection'), ('only_a'), ('only_b')) AS p(part) LEFT JOIN u ON u.part = p.part GROUP BY p.part""",
    "union_rows": """SELECT nation, kind, count(*) AS n, min(k) AS first FROM (SELECT c_custkey AS k, c_nationkey AS nation, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, s_nationkey, NULL FROM supplier) GROUP BY ALL""",
    "required_cells": """SELECT t.event_type, c.cell FROM (SELECT DISTINCT event_type FROM events) t, range(9) AS c(cell)
        WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = t.event_type AND e.event_id % 7 = c.cell)""",
    "group_coverage": f"WITH {RECORDS} SELECT source, lang, count(DISTINCT decision) AS kinds, count(DISTINCT decision) = 3 AS complete FROM records GROUP BY source, lang",
    "dup_identity": """SELECT family, value, count(*) AS n FROM (SELECT 'source' AS family, lower(source) AS value FROM documents UNION ALL SELECT 'sha', sha256(text) FROM documents) WHERE value IS NOT NULL GROUP BY ALL HAVING count(*) > 1""",
    "content_sha": """SELECT p_partkey, sha256('{"brand":' || CASE WHEN p_partkey % 4 <> 0 THEN '"' || p_brand || '"' ELSE 'null' END || ',"name":"' || p_name || ' \\"x\\"\\\\","price":' || p_retailprice || ',"size":' || p_size || '}') AS sha FROM part""",
    "anonymous_labels": "WITH f AS (SELECT source, min(doc_id) AS first FROM documents GROUP BY source) SELECT source, 'group-' || lpad((row_number() OVER (ORDER BY first, source))::VARCHAR, 6, '0') AS label FROM f",
    "manifest_issues": f"WITH {_ISSUES} SELECT * FROM issues",
    "contract_status": f"""WITH {_ISSUES}, c AS (SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'blocker') AS blockers, count(*) FILTER (severity = 'warning') AS warnings FROM issues)
        SELECT *, CASE WHEN errors > 0 THEN 'INVALID' WHEN blockers > 0 THEN 'BLOCKED' WHEN warnings > 0 THEN 'READY_WITH_WARNINGS' ELSE 'READY' END AS status FROM c""",
    "eligibility_reasons": f"""WITH {FIELDS}, s AS (SELECT slide, count(*) AS n, sum(n_valid) AS valid, sum(label) AS positive FROM fields GROUP BY slide),
        w AS (SELECT slide, concat_ws(',', CASE WHEN n < 200 THEN 'few fields' END, CASE WHEN valid < 300 THEN 'little area' END, CASE WHEN positive < 120 THEN 'few positives' END) AS reasons FROM s)
        SELECT slide, reasons, reasons = '' AS eligible FROM w""",
    "method_eligibility": """WITH o AS (SELECT o_custkey, bool_and(o_orderstatus <> 'P') AS final FROM orders GROUP BY o_custkey)
        SELECT c_custkey, coalesce(final, false) AND c_acctbal > 0 AS eligible FROM customer LEFT JOIN o ON o_custkey = c_custkey""",
    "abstention_rows": f"""WITH {FIELDS}, r AS (SELECT *, CASE WHEN n_valid = 0 THEN 'no valid area' WHEN positives = 0 THEN 'no target' ELSE 'scored' END AS outcome FROM fields)
        SELECT outcome, count(*) AS n, sum(CASE WHEN outcome = 'scored' THEN tp END)::BIGINT AS tp FROM r GROUP BY outcome""",
    "content_duplicates": """SELECT sha, count(*) AS n, count(DISTINCT t) AS tables FROM (SELECT sha256(text) AS sha, 'documents' AS t FROM documents UNION ALL SELECT sha256(text), 'benchmark' FROM benchmark) GROUP BY sha HAVING count(*) > 1""",
}
