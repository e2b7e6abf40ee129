"""Registered queries and, for each that SQL can express, its SQL for the oracle."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import zipfile
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import checks, text
from quern.operators import bytestats, census, clocks, crossing, relations, search, similarity
from quern.sources import decoders, files
from quern.sources.shared import scratch
from quern.streaming import arrivals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """Tables of a folder by name, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function of Tables under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


SIZED = "(SELECT *, strlen(coalesce(text, ''))::BIGINT AS size FROM documents)"
HASHED = "(SELECT sha1(coalesce(text, '')) AS sha1, strlen(coalesce(text, ''))::BIGINT AS size, doc_id, source, lang FROM documents)"
ITEMS = "(SELECT sha1(coalesce(text, '')) AS sha1, item_id FROM benchmark)"


def sized(t: Tables) -> DataFrame:
    return t.documents.withColumn("size", F.octet_length(F.coalesce("text", F.lit(""))).cast("long"))


def docs_hashed(t: Tables) -> DataFrame:
    return crossing.hashed(t.documents, "text", "doc_id", "source", "lang")


def items_hashed(t: Tables) -> DataFrame:
    return crossing.hashed(t.benchmark, "text", "item_id")


# census and shares


@query(f"SELECT source, count(*) AS files, sum(size)::BIGINT AS bytes, round(sum(size) * 100.0 / (SELECT sum(size) FROM {SIZED}), 4) AS share_pct FROM {SIZED} GROUP BY source")
def tree_census(t):
    return census.by_key(sized(t), ["source"], "size").select("source", "files", "bytes", "share_pct")


@query("SELECT year(o_orderdate)::INT AS y, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def census_by_year(t):
    return t.orders.groupBy(F.year("o_orderdate").alias("y")).agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(f"SELECT lang, source, count(*) AS files, sum(size)::BIGINT AS bytes, grouping(lang, source)::BIGINT AS level FROM {SIZED} GROUP BY ROLLUP (lang, source)")
def share_rollup(t):
    return census.rolled_up(sized(t), "lang", "source", "size").withColumn("level", F.col("level").cast("long"))


@query(f"""WITH r AS (SELECT sum(size) AS s, grouping(lang, source) AS g FROM {SIZED} GROUP BY ROLLUP (lang, source))
SELECT (sum(s) FILTER (g = 0))::BIGINT AS leaves, (sum(s) FILTER (g = 3))::BIGINT AS total, (sum(s) FILTER (g = 0) - sum(s) FILTER (g = 3))::BIGINT AS residue FROM r""")
def share_residue(t):
    return census.reconciled(census.rolled_up(sized(t), "lang", "source", "size"))


@query(f"""WITH g AS (SELECT doc_id, 'small' AS grp FROM {SIZED} WHERE size < 1000 UNION ALL SELECT doc_id, 'middle' FROM {SIZED} WHERE size BETWEEN 1000 AND 4999 UNION ALL SELECT doc_id, 'large' FROM {SIZED} WHERE size >= 5000),
m AS (SELECT d.doc_id, coalesce(min(grp), 'unassigned') AS grp, count(grp)::INT AS matched FROM documents d LEFT JOIN g USING (doc_id) GROUP BY 1)
SELECT grp, matched, count(*) AS items FROM m GROUP BY 1, 2""")
def exhaustive_groups(t):
    s = F.col("size")
    return census.assigned(sized(t), "doc_id", {"small": s < 1000, "middle": (s >= 1000) & (s < 5000), "large": s >= 5000})


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY size) AS k, count(*) OVER (PARTITION BY source, lang) AS group_n FROM {SIZED}),
m AS (SELECT source, lang, size AS upper_median, group_n FROM r WHERE k = floor(group_n / 2) + 1)
SELECT doc_id, d.size, upper_median, group_n, round(d.size / upper_median, 6) AS ratio FROM {SIZED} d JOIN m USING (source, lang)
WHERE group_n >= 4 AND upper_median <> 0 AND (d.size / upper_median < 0.05 OR d.size / upper_median > 12)""")
def size_outliers(t):
    return census.size_outliers(sized(t), ["source", "lang"], "size").select("doc_id", "size", "upper_median", "group_n", "ratio")


@query(f"SELECT doc_id, size, (SELECT count(*) FROM documents) AS population FROM {SIZED} ORDER BY size DESC, doc_id LIMIT 12")
def top_files(t):
    return census.largest(sized(t), "size", "doc_id").select("doc_id", "size", "population")


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY CUBE (quality, toxic)")
def tier_cube(t):
    return t.labels.cube("quality", "toxic").agg(F.count("*").alias("n"))


# hashes, copies, crossings


@query(f"SELECT sha1, size, doc_id FROM {HASHED}")
def hash_list(t):
    return docs_hashed(t).select("sha1", "size", "doc_id")


@query(f"""WITH b AS (SELECT sha1, count(*) AS n, max(size) AS size FROM {HASHED} GROUP BY 1)
SELECT sum(n)::BIGINT AS leaves, count(*) AS distinct_sha1, sum(n * size)::BIGINT AS stored_bytes, sum(size)::BIGINT AS distinct_bytes, (sum(n * size) - sum(size))::BIGINT AS redundant_bytes,
round((sum(n * size) - sum(size)) * 100.0 / sum(n * size), 4) AS redundant_pct, (sum(n) - count(*))::BIGINT AS copies FROM b""")
def redundancy(t):
    return crossing.redundancy(docs_hashed(t))


@query(f"SELECT sha1, count(*) AS copies, max(size) AS size, min(doc_id) AS first_key FROM {HASHED} GROUP BY sha1 HAVING count(*) > 1")
def dup_groups(t):
    return crossing.dup_groups(docs_hashed(t), "doc_id")


@query(f"""WITH p AS (SELECT sha1, source, count(*) AS n, max(size) AS size FROM {HASHED} GROUP BY 1, 2), o AS (SELECT sha1, count(*) AS owners FROM p GROUP BY 1)
SELECT source, sum(n - 1)::BIGINT AS redundant_copies, sum((n - 1) * size)::BIGINT AS redundant_bytes, count(*) FILTER (owners > 1) AS shared_hashes FROM p JOIN o USING (sha1) GROUP BY source""")
def dups_within_across(t):
    return crossing.within_across(docs_hashed(t), "source")


CROSS = f"SELECT sha1, max(size) AS size, min(doc_id) AS doc_id FROM {HASHED} WHERE sha1 <> '{crossing.EMPTY}' AND sha1 {{}} (SELECT sha1 FROM {ITEMS}) GROUP BY 1"


@query(CROSS.format("IN"))
def crossing_hashes(t):
    return crossing.crossings(docs_hashed(t), items_hashed(t))


@query(f"SELECT count(*) AS hashes, sum(size)::BIGINT AS bytes FROM ({CROSS.format('NOT IN')})")
def not_crossing(t):
    return crossing.crossings(docs_hashed(t), items_hashed(t), present=False).agg(F.count("*").alias("hashes"), F.sum("size").alias("bytes"))


@query(f"""WITH m AS (SELECT sha1, max(size) AS size FROM {HASHED} WHERE sha1 <> '{crossing.EMPTY}' GROUP BY 1), t AS (SELECT unnest([{', '.join(map(str, crossing.LEAST_SIZES))}])::BIGINT AS min_bytes),
r AS (SELECT min_bytes, count(sha1) AS population, count(sha1) FILTER (sha1 IN (SELECT sha1 FROM {ITEMS})) AS crossings FROM t LEFT JOIN m ON size >= min_bytes GROUP BY 1)
SELECT min_bytes, population, crossings, round(CASE WHEN population = 0 THEN NULL ELSE crossings * 100.0 / population END, 4) AS rate_pct FROM r""")
def crossing_rate_by_min_len(t):
    return crossing.crossing_rates(docs_hashed(t), items_hashed(t))


@query("""WITH a AS (SELECT doc_id FROM documents WHERE lang = 'en'), b AS (SELECT doc_id FROM labels), c AS (SELECT doc_id FROM documents WHERE n_chars > 2000),
u AS (SELECT doc_id FROM a UNION SELECT doc_id FROM b UNION SELECT doc_id FROM c)
SELECT doc_id IN (FROM a) AS in_g, doc_id IN (FROM b) AS in_h, doc_id IN (FROM c) AS in_d, count(*) AS keys FROM u GROUP BY ALL""")
def seven_regions(t):
    return crossing.regions({"in_g": t.documents.where("lang = 'en'"), "in_h": t.labels, "in_d": t.documents.where("n_chars > 2000")}, "doc_id")


@query("""WITH a AS (SELECT user_id, count(*) AS was FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT user_id, count(*) AS now FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT CASE WHEN a.user_id IS NULL THEN 'added' WHEN b.user_id IS NULL THEN 'gone' WHEN was IS NOT DISTINCT FROM now THEN 'same' ELSE 'changed' END AS verdict, count(*) AS n
FROM a FULL JOIN b ON a.user_id = b.user_id GROUP BY 1""")
def tree_diff(t):
    a, b = (t.events.where(F.col("event_type") == kind).groupBy("user_id").agg(F.count("*").alias("n")) for kind in ("click", "purchase"))
    return crossing.tree_diff(a, b, "user_id", "n").groupBy("verdict").agg(F.count("*").alias("n"))


@query(f"SELECT siblings, count(*) AS hashes, sum(size)::BIGINT AS bytes FROM (SELECT sha1, count(DISTINCT source) AS siblings, max(size) AS size FROM {HASHED} GROUP BY 1) GROUP BY 1")
def sibling_mirror(t):
    return crossing.sibling_mirror(docs_hashed(t), "source")


@query(f"WITH h AS (SELECT DISTINCT sha1, source FROM {HASHED}) SELECT x.source AS a, y.source AS b, count(*) AS shared FROM h x JOIN h y ON x.sha1 = y.sha1 AND x.source < y.source GROUP BY 1, 2")
def mirror_matrix(t):
    return crossing.mirror_matrix(docs_hashed(t), "source")


# search with controls


def _patterns_sql(patterns: dict[str, str]) -> str:
    one = "SELECT '{n}' AS pattern, coalesce(sum(len(regexp_extract_all(text, '{p}'))), 0)::BIGINT AS hits, count(*) FILTER (len(regexp_extract_all(text, '{p}')) > 0) AS docs FROM documents"
    return " UNION ALL ".join(one.format(n=n, p=p.replace("'", "''")) for n, p in patterns.items())


@query(_patterns_sql(search.PERSONAL))
def sift_personal(t):
    return search.pattern_counts(t.documents, "text", search.PERSONAL)


@query(_patterns_sql(search.BUILD))
def sift_buildpath(t):
    return search.pattern_counts(t.documents, "text", search.BUILD)


NEEDLES = {"must_hit": "the", "license": "License", "must_miss": "☃never☃"}
NEEDLE_SQL = " UNION ALL ".join(
    f"SELECT '{k}' AS kind, '{v}' AS needle, {len(v.encode())}::BIGINT AS len, sum((length(text) - length(replace(text, '{v}', ''))) // {len(v)})::BIGINT AS hits, count(*) FILTER (contains(text, '{v}')) AS docs FROM documents" for k, v in NEEDLES.items()
)


@query(NEEDLE_SQL)
def needle_counts(t):
    return search.needle_counts(t.documents, "text", NEEDLES).select("kind", "needle", "len", "hits", "docs")


@query(" UNION ALL ".join(f"SELECT '{k}' AS kind, round(sum(greatest(strlen(text) - {len(v.encode())} + 1, 0)) / pow(256.0, {len(v.encode())}), 9) AS chance_windows, round(sum(strlen(text)) / pow(256.0, {len(v.encode())}), 9) AS chance_bytes FROM documents" for k, v in NEEDLES.items()))
def needle_chance(t):
    return search.needle_counts(t.documents, "text", NEEDLES).select("kind", F.round("chance_windows", 9).alias("chance_windows"), F.round("chance_bytes", 9).alias("chance_bytes"))


@query(f"""WITH n AS ({NEEDLE_SQL}), v AS (SELECT coalesce(bool_and(hits > 0) FILTER (kind = 'must_hit'), false) AS p, coalesce(bool_and(hits = 0) FILTER (kind = 'must_miss'), false) AS m FROM n)
SELECT p AS positive_ok, m AS negative_ok, p AND m AS verdict FROM v""")
def control_verdict(t):
    return checks.controls(search.needle_counts(t.documents, "text", NEEDLES))


@query(f"SELECT sha1(lower(u)) AS uuid_sha1, substr(u, 15, 1) AS version, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{search.UUID}')) AS u FROM documents) GROUP BY 1, 2")
def uuid_scan(t):
    return search.uuids(t.documents, "text", "doc_id")


@query(f"""WITH a AS (SELECT unnest(regexp_extract_all(text, '{search.PERSONAL["email"]}')) AS a FROM documents), l AS (SELECT a, lower(split_part(a, '@', 1)) AS p FROM a)
SELECT CASE WHEN p IN ('info', 'support', 'admin', 'sales', 'webmaster', 'postmaster') THEN 'role' WHEN regexp_matches(p, '^[a-z]+[._][a-z]+$') THEN 'person' ELSE 'other' END AS class,
count(*) AS addresses, count(DISTINCT lower(a)) AS distinct_addresses FROM l GROUP BY 1""")
def contacts_classes(t):
    return search.contact_classes(t.documents, "text")


@query(f"""WITH r AS (SELECT doc_id, len(regexp_extract_all(text, '{search.PERSONAL["email"]}')) + len(regexp_extract_all(text, '{search.PERSONAL["phone"]}')) AS found,
regexp_replace(regexp_replace(text, '{search.PERSONAL["email"]}', '[email]', 'g'), '{search.PERSONAL["phone"]}', '[phone]', 'g') AS red FROM documents)
SELECT doc_id, found::BIGINT AS found, (len(regexp_extract_all(red, '{search.PERSONAL["email"]}')) + len(regexp_extract_all(red, '{search.PERSONAL["phone"]}')))::BIGINT AS remaining, sha1(red) AS redacted_sha1 FROM r""")
def redact_text(t):
    return search.redaction(t.documents, "text", "doc_id", {k: search.PERSONAL[k] for k in ("email", "phone")})


@query("SELECT split_part(split_part(u, '#', 1), '?', 1) AS target, count(*) AS links FROM (SELECT unnest(regexp_extract_all(html, '(?:href|src)=\"([^\"]*)\"', 1)) AS u FROM pages) GROUP BY 1")
def webcross_links(t):
    return search.web_links(t.pages, "html")


@query("""WITH r AS (SELECT list_transform(regexp_extract_all(text, '[ -~]{6,}'), lambda x: length(x)) AS n FROM documents)
SELECT sum(len(n))::BIGINT AS runs, sum(list_sum(n))::BIGINT AS run_chars, max(list_max(n))::BIGINT AS longest FROM r""")
def printable_runs(t):
    return search.runs(t.documents, "text", 6)


# bytes


@query("""WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents WHERE text <> ''), n AS (SELECT doc_id, c, count(*) AS k FROM c GROUP BY 1, 2),
e AS (SELECT doc_id, k, sum(k) OVER (PARTITION BY doc_id) AS n FROM n), h AS (SELECT doc_id, -sum(k / n * log2(k / n)) AS h FROM e GROUP BY 1)
SELECT d.doc_id, coalesce(round(h, 4), 0.0) AS entropy, length(text)::BIGINT AS chars FROM documents d LEFT JOIN h USING (doc_id)""")
def entropy_by_doc(t):
    return bytestats.entropy(t.documents, "text", "doc_id")


@query("SELECT ord(c)::BIGINT AS code, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM documents WHERE text <> '') GROUP BY 1")
def byte_histogram(t):
    return bytestats.histogram(t.documents, "text")


@query("""WITH b AS (SELECT doc_id, sha1(substr(text, (i * 64 + 1)::BIGINT, 64)) AS block FROM (SELECT doc_id, text, unnest(range(0, length(text) // 64)) AS i FROM documents))
SELECT block, count(*) AS times, count(DISTINCT doc_id) AS owners FROM b GROUP BY 1 HAVING count(*) > 1""")
def block_repeats(t):
    return bytestats.block_repeats(t.documents, "text", "doc_id")


# clocks


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
w AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS wave FROM g)
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS events, round(sum(value), 2) AS value_sum FROM w GROUP BY user_id, wave""")
def event_waves(t):
    return clocks.waves(t.events, "ts", keys=("user_id",)).select("user_id", "first_ts", "last_ts", "events", "value_sum")


@query("SELECT count(*) AS stamps, count(DISTINCT date_trunc('second', ts)) AS distinct_seconds, count(DISTINCT date_trunc('minute', ts)) AS distinct_minutes, count(DISTINCT date_trunc('hour', ts)) AS distinct_hours, count(DISTINCT date_trunc('day', ts)) AS distinct_days FROM events")
def distinct_clock_grain(t):
    return clocks.grain(t.events, "ts")


@query("SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS events, date_sub('second', min(ts), max(ts)) AS span_s FROM events GROUP BY 1")
def spans_by_user(t):
    return clocks.spans(t.events, "ts", "user_id")


@query("""WITH d AS (SELECT date_diff('day', o_orderdate, l_shipdate) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT CASE WHEN d < 0 THEN 'before' WHEN abs(d) > 90 THEN 'apart' ELSE 'agree' END AS verdict, count(*) AS n, min(d) AS least_days, max(d) AS most_days FROM d GROUP BY 1""")
def clock_disagreement(t):
    both = t.lineitem.select("l_orderkey", "l_shipdate").join(t.orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return clocks.disagreement(both, F.col("o_orderdate"), F.col("l_shipdate"), 90)


@query("""WITH s AS (SELECT date_sub('second', date_trunc('day', ts), date_trunc('second', ts)) AS s FROM events), q AS (SELECT s, floor(s / 900.0 + 0.5)::BIGINT AS q FROM s)
SELECT q AS quarters, count(*) AS n, count(*) FILTER (s = q * 900) AS exact FROM q GROUP BY 1""")
def tz_quarter_bucket(t):
    return clocks.quarter_hours(t.events, F.date_trunc("day", "ts"), F.date_trunc("second", "ts"))


@query("SELECT l_shipdate, count(*) AS n, count(DISTINCT l_quantity) AS sizes FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_quantity) > 1")
def stamp_tests(t):
    return clocks.shared_stamps(t.lineitem, "l_shipdate", "l_quantity")


@query("SELECT day, kind, count(*) AS n FROM (SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS day, 'order' AS kind FROM orders UNION ALL SELECT date_trunc('day', l_shipdate)::TIMESTAMP, 'ship' FROM lineitem) GROUP BY ALL")
def timeline_union(t):
    a = t.orders.select(F.col("o_orderdate").alias("day"), F.lit("order").alias("kind"))
    b = t.lineitem.select(F.col("l_shipdate").alias("day"), F.lit("ship").alias("kind"))
    return a.unionByName(b).groupBy(F.date_trunc("day", "day").cast("timestamp_ntz").alias("day"), "kind").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events)
SELECT user_id, count(step) AS steps, count(*) FILTER (step < 0) AS backwards FROM s GROUP BY 1""")
def step_check(t):
    return clocks.successive(t.events, "user_id", ["ts", "event_id"], "value").select("user_id", "steps", "backwards")


# joins, intervals, graphs


def _resolve_sql(field: str, target: str, key: str) -> str:
    return f"SELECT '{field}' AS field, count({field}) AS \"references\", count(DISTINCT {field}) AS distinct_values, count(*) FILTER ({field} IN (SELECT {key} FROM {target})) AS resolved, count({field}) - count(*) FILTER ({field} IN (SELECT {key} FROM {target})) AS residue FROM lineitem"


REFERENCES = (("l_partkey", "part", "p_partkey"), ("l_suppkey", "supplier", "s_suppkey"), ("l_orderkey", "orders", "o_orderkey"))


@query(" UNION ALL ".join(_resolve_sql(*r) for r in REFERENCES))
def resolve_references(t):
    out = None
    for field, target, key in REFERENCES:
        one = relations.resolve(t.lineitem, field, getattr(t, target), key)
        out = one if out is None else out.unionByName(one)
    return out


FIELD_SQL = " UNION ".join(f"SELECT '{f}' AS field, {f} AS v FROM lineitem" for f, _, _ in REFERENCES)
POOL_SQL = " UNION ".join(f"SELECT '{p}' AS pool, {k} AS v FROM {p}" for _, p, k in REFERENCES)


@query(f"""WITH f AS ({FIELD_SQL}), p AS ({POOL_SQL}), n AS (SELECT field, count(*) AS vals FROM f GROUP BY 1), m AS (SELECT field, pool, count(*) AS matched FROM f JOIN p USING (v) GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY matched DESC, pool) AS k FROM m)
SELECT field, pool, matched, vals AS "values", round(matched / vals, 6) AS share FROM b JOIN n USING (field) WHERE k = 1 AND matched >= 0.9 * vals""")
def discover_references(t):
    fields = pools = None
    for f, p, k in REFERENCES:
        a, b = t.lineitem.select(F.lit(f).alias("field"), F.col(f).alias("v")).distinct(), getattr(t, p).select(F.lit(p).alias("pool"), F.col(k).alias("v"))
        fields, pools = (a, b) if fields is None else (fields.unionByName(a), pools.unionByName(b))
    return relations.discover(fields, pools)


@query("SELECT coalesce(CASE WHEN l_suppkey IN (SELECT c_custkey FROM customer) THEN 'a_customer' WHEN l_suppkey IN (SELECT s_suppkey FROM supplier) THEN 'b_supplier' END, 'none') AS label, count(*) AS n FROM lineitem GROUP BY 1")
def priority_resolve(t):
    got = relations.priority_lookup(t.lineitem.select("l_suppkey"), "l_suppkey", {"a_customer": t.customer.select("c_custkey"), "b_supplier": t.supplier.select("s_suppkey")})
    return got.groupBy(F.coalesce("label", F.lit("none")).alias("label")).agg(F.count("*").alias("n"))


@query("SELECT r_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def chained_lookup(t):
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS last_mark FROM conversations")
def asof_last_container(t):
    marked = t.conversations.withColumn("mark", F.when(F.col("role") == "user", F.col("turn")))
    return relations.as_of(marked, "conv_id", "turn", "mark").select("conv_id", "turn", "role", "last_mark")


@query("SELECT p_partkey, count(*) AS n FROM part JOIN events ON value * 100 >= p_partkey * 10 AND value * 100 < p_partkey * 10 + 10 GROUP BY 1")
def offset_to_member(t):
    members = t.part.select("p_partkey", (F.col("p_partkey") * 10).alias("lo"), (F.col("p_partkey") * 10 + 10).alias("hi"))
    return relations.in_intervals(t.events.select((F.col("value") * 100).alias("at")), "at", members, "lo", "hi", 100).groupBy("p_partkey").agg(F.count("*").alias("n"))


TILES = "(SELECT l_suppkey, l_partkey AS lo, l_partkey + l_quantity::BIGINT AS hi FROM lineitem)"


@query(f"""WITH r AS (SELECT *, coalesce(max(hi) OVER (PARTITION BY l_suppkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lo) AS r FROM {TILES})
SELECT l_suppkey, count(*) AS parts, sum(greatest(lo - r, 0))::BIGINT AS gap, sum(greatest(least(r, hi) - lo, 0))::BIGINT AS overlap, max(hi) AS reach FROM r GROUP BY 1""")
def interval_tiling(t):
    return relations.tiling(t.lineitem.select("l_suppkey", F.col("l_partkey").alias("lo"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("hi")), "l_suppkey", "lo", "hi")


@query("""WITH r AS (SELECT l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_suppkey) AS k FROM lineitem)
SELECT l_partkey, min(l_suppkey) FILTER (k = 1) AS owner, count(DISTINCT l_suppkey) AS claims FROM r GROUP BY 1""")
def first_claimant(t):
    return relations.first_claimant(t.lineitem, "l_partkey", "l_suppkey", "l_shipdate")


@query("""WITH d AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), i AS (SELECT *, l_partkey - row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS g FROM d)
SELECT l_suppkey, min(l_partkey) AS first, max(l_partkey) AS last, count(*) AS length FROM i GROUP BY l_suppkey, g""")
def contiguous_runs(t):
    return relations.islands(t.lineitem, "l_suppkey", "l_partkey")


EDGES = "(SELECT DISTINCT o_orderkey AS src, o_custkey AS dst FROM orders)"


def _edges(t):
    return t.orders.select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"))


@query(f"SELECT DISTINCT src AS node FROM {EDGES} WHERE src NOT IN (SELECT dst FROM {EDGES} WHERE dst IS NOT NULL)")
def graph_roots(t):
    return relations.roots(_edges(t))


@query(f"""WITH RECURSIVE e AS (SELECT src, min(dst) AS dst FROM {EDGES} GROUP BY src HAVING count(*) = 1), r AS (SELECT DISTINCT src AS root FROM {EDGES} WHERE src NOT IN (SELECT dst FROM {EDGES} WHERE dst IS NOT NULL)),
w(root, last, steps, seen) AS (SELECT root, root, 0::BIGINT, [root] FROM r UNION ALL SELECT root, dst, steps + 1, list_append(seen, dst) FROM w JOIN e ON last = src WHERE NOT list_contains(seen, dst))
SELECT root, max_by(last, steps) AS last, max(steps) AS steps FROM w GROUP BY 1""")
def graph_walk(t):
    return relations.walks(_edges(t))


QUERIES["graph_walk_whole"], ORACLE["graph_walk_whole"] = QUERIES["graph_walk"], ORACLE["graph_walk"]


# text and structure

TOKENS = "string_split_regex(lower(text), '[^a-zäöüßñáíóúéèêçà]+')"
SCORE = {g: f"len(list_filter({TOKENS}, lambda x: x IN ({', '.join(repr(w) for w in ws)})))" for g, ws in text.STOP_WORDS.items()}


@query(f"""WITH s AS (SELECT lang, {', '.join(f'{c} AS {g}' for g, c in SCORE.items())} FROM documents), m AS (SELECT *, greatest(de, en, es, fr) AS top FROM s)
SELECT lang, CASE WHEN top = 0 THEN 'none' WHEN (de = top)::INT + (en = top)::INT + (es = top)::INT + (fr = top)::INT > 1 THEN 'tie' WHEN de = top THEN 'de' WHEN en = top THEN 'en' WHEN es = top THEN 'es' ELSE 'fr' END AS guess, count(*) AS n FROM m GROUP BY 1, 2""")
def language_score(t):
    return t.documents.groupBy("lang", text.guessed_language(F.col("text")).alias("guess")).agg(F.count("*").alias("n"))


@query("SELECT lang, " + ", ".join(f"sum(length(text) - length(regexp_replace(text, '[{c}]', '', 'g')))::BIGINT AS {g}_letters" for g, c in text.HIGH_LETTERS.items()) + " FROM documents GROUP BY 1")
def high_letters_by_lang(t):
    return text.high_letters(t.documents, "text", "lang")


@query("SELECT role, split_part(line, ' ', 1) AS verb, count(*) AS n, count(DISTINCT line) AS distinct_lines FROM (SELECT role, unnest(string_split(text, chr(10))) AS line FROM conversations) WHERE trim(line) <> '' GROUP BY 1, 2")
def command_grammar(t):
    return text.grammar(t.conversations, "text", F.substring_index("line", " ", 1), "role")


@query("SELECT source, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'es') AS es, count(*) FILTER (lang = 'fr') AS fr FROM documents GROUP BY 1")
def key_by_language_pivot(t):
    return t.documents.groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).agg(F.count("doc_id")).na.fill(0)


@query("SELECT event_type, (props::JSON->>'$.k')::BIGINT AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_records(t):
    return t.events.groupBy("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT user_id, event_id, (props::JSON->>'$.k')::BIGINT AS k FROM events), f AS (SELECT user_id, min_by(k, event_id) AS was, max_by(k, event_id) AS now FROM e GROUP BY 1)
SELECT CASE WHEN was IS NOT DISTINCT FROM now THEN 'same' ELSE 'changed' END AS verdict, count(*) AS n FROM f GROUP BY 1""")
def json_record_diff(t):
    k = F.get_json_object("props", "$.k").cast("long")
    f = t.events.groupBy("user_id").agg(F.min_by(k, "event_id").alias("was"), F.max_by(k, "event_id").alias("now"))
    return f.groupBy(F.when(F.col("was").eqNullSafe(F.col("now")), "same").otherwise("changed").alias("verdict")).agg(F.count("*").alias("n"))


@query("SELECT word, count(DISTINCT side) AS sides FROM (SELECT unnest(string_split(p_name, ' ')) AS word, 'name' AS side FROM part UNION ALL SELECT unnest(string_split(lower(p_type), ' ')), 'type' FROM part) GROUP BY 1")
def dictionary_union(t):
    a = t.part.select(F.explode(F.split("p_name", " ")).alias("word"), F.lit("name").alias("side"))
    b = t.part.select(F.explode(F.split(F.lower("p_type"), " ")).alias("word"), F.lit("type").alias("side"))
    return a.unionByName(b).groupBy("word").agg(F.count_distinct("side").alias("sides"))


@query("SELECT sha1(regexp_replace(text, '[A-Za-z0-9\\x{80}-\\x{10FFFF}]+', 'w', 'g')) AS skeleton, count(*) AS n FROM documents GROUP BY 1")
def skeletons(t):
    return t.documents.groupBy(text.skeleton(F.col("text")).alias("skeleton")).agg(F.count("*").alias("n"))


# similarity

GRAM_CTE = """WITH d AS (SELECT doc_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM documents), i AS (SELECT item_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM benchmark),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM d WHERE len(w) >= 8)),
ig AS (SELECT DISTINCT item_id, array_to_string(w[p:p + 7], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS p FROM i WHERE len(w) >= 8)), n AS (SELECT item_id, count(*) AS item_kgrams FROM ig GROUP BY 1)"""


@query(f"{GRAM_CTE} SELECT doc_id, item_id, count(*) AS shared_kgrams, any_value(item_kgrams) AS item_kgrams, round(count(*) / any_value(item_kgrams), 6) AS containment FROM dg JOIN ig USING (g) JOIN n USING (item_id) GROUP BY 1, 2")
def kgram_overlap(t):
    return similarity.gram_overlap(t.documents, "doc_id", t.benchmark, "item_id", "text").select("doc_id", "item_id", "shared_kgrams", "item_kgrams", "containment")


REGION_CTE = """WITH d AS (SELECT doc_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM documents), i AS (SELECT item_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM benchmark),
dg AS (SELECT doc_id, p - 1 AS pos, array_to_string(w[p:p + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM d WHERE len(w) >= 8)),
ig AS (SELECT item_id, p - 1 AS q, array_to_string(w[p:p + 7], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS p FROM i WHERE len(w) >= 8)),
h AS (SELECT doc_id, item_id, pos, pos - q AS d FROM dg JOIN ig USING (g)),
r AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, item_id, d ORDER BY pos) AS g FROM h),
u AS (SELECT doc_id, item_id, min(pos) AS doc_start, min(pos) - d AS item_start, count(*) + 7 AS words FROM r GROUP BY doc_id, item_id, d, g)"""


@query(f"{REGION_CTE} SELECT doc_id, item_id, max(words) AS longest_words, count(*) AS regions FROM u GROUP BY 1, 2")
def longest_shared_run(t):
    return similarity.longest_shared(t.documents, "doc_id", t.benchmark, "item_id", "text")


@query(f"{REGION_CTE} SELECT doc_id, item_id, doc_start, item_start, words FROM u")
def shared_regions(t):
    return similarity.shared_regions(t.documents, "doc_id", t.benchmark, "item_id", "text")


@query("""WITH p AS (SELECT q.vec_id AS query, r.vec_id AS neighbour, round(list_sum(list_transform(list_zip(q.embedding, r.embedding), lambda x: abs(x[1]::DOUBLE - x[2]::DOUBLE))) / len(q.embedding), 6) AS mad
FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY mad, neighbour) AS k FROM p) SELECT query, neighbour, mad FROM k WHERE k = 1""")
def mad_nearest(t):
    return similarity.nearest(t.embeddings.where("vec_id % 100 = 0"), t.embeddings, "vec_id", "embedding")


@query("""WITH p AS (SELECT q.vec_id AS query, list_sum(list_transform(list_zip(q.embedding, r.embedding), lambda x: abs(x[1]::DOUBLE - x[2]::DOUBLE))) / len(q.embedding) AS mad,
list_sum(list_transform(list_zip(q.embedding, list_reverse(r.embedding)), lambda x: abs(x[1]::DOUBLE - x[2]::DOUBLE))) / len(q.embedding) AS shuffled FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0),
m AS (SELECT query, min(mad) AS m, min(shuffled) AS s FROM p GROUP BY 1) SELECT query, round(m, 6) AS mad, round(s, 6) AS control, round(s / m, 4) AS factor, s >= 1.5 * m AS separates FROM m""")
def mad_shuffled_control(t):
    return similarity.separation(t.embeddings.where("vec_id % 100 = 0"), t.embeddings, "vec_id", "embedding")


# names, rules and declared against actual


@query("""WITH n AS (SELECT lower(c_name) AS a, lower(s_name) AS b FROM customer JOIN supplier ON c_custkey = s_suppkey), f AS (SELECT a, b, regexp_replace(a, '[ _#.-]', '', 'g') AS x, regexp_replace(b, '[ _#.-]', '', 'g') AS y FROM n)
SELECT CASE WHEN a = b THEN 'same' WHEN x = y THEN 'spaced' WHEN suffix(x, y) OR suffix(y, x) THEN 'prefixed' ELSE 'renamed' END AS class, count(*) AS n FROM f GROUP BY 1""")
def rename_class(t):
    both = t.customer.join(t.supplier, F.col("c_custkey") == F.col("s_suppkey"))
    return both.groupBy(text.rename_class(F.col("c_name"), F.col("s_name")).alias("class")).agg(F.count("*").alias("n"))


@query("SELECT p_name AS name, count(DISTINCT p_brand) AS homes, count(*) AS n FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def ambiguous_names(t):
    return relations.ambiguous(t.part, "p_name", "p_brand")


@query("""WITH l AS (SELECT lower(split_part(split_part(u, '#', 1), '?', 1)) AS k FROM (SELECT unnest(regexp_extract_all(html, '(?:href|src)="([^"]*)"', 1)) AS u FROM pages)), c AS (SELECT k, count(*) AS n FROM l GROUP BY 1)
SELECT k IN (SELECT lower(url) FROM pages WHERE url IS NOT NULL) AS resolved, count(*) AS targets, sum(n)::BIGINT AS links FROM c GROUP BY 1""")
def links_resolved(t):
    links = search.web_links(t.pages, "html")
    return relations.resolve_folded(links, "target", "links", t.pages, "url")


@query("""WITH l AS (SELECT l_orderkey, max(l_linenumber) AS declared, count(*) AS counted FROM lineitem GROUP BY 1)
SELECT o_orderpriority, count(*) AS total, count(l_orderkey) AS found, count(*) FILTER (declared = counted) AS exact FROM orders LEFT JOIN l ON o_orderkey = l_orderkey GROUP BY 1""")
def cardinality_check(t):
    lines = t.lineitem.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("declared"), F.count("*").alias("counted"))
    both = t.orders.select("o_orderkey", "o_orderpriority").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return both.groupBy("o_orderpriority").agg(F.count("*").alias("total"), F.count("l_orderkey").alias("found"), F.count_if(F.col("declared") == F.col("counted")).alias("exact"))


@query("""WITH l AS (SELECT l_orderkey, sum(l_extendedprice::DECIMAL(18, 2)) AS s FROM lineitem GROUP BY 1)
SELECT CASE WHEN abs(o_totalprice::DECIMAL(18, 2) - s) <= 1000 THEN 'near' ELSE 'apart' END AS verdict, count(*) AS n FROM orders JOIN l ON o_orderkey = l_orderkey GROUP BY 1""")
def approximate_equality(t):
    money = lambda c: F.col(c).cast("decimal(18,2)")
    lines = t.lineitem.groupBy("l_orderkey").agg(F.sum(money("l_extendedprice")).alias("s"))
    both = t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return both.groupBy(F.when(F.abs(money("o_totalprice") - F.col("s")) <= 1000, "near").otherwise("apart").alias("verdict")).agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS a, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS b FROM part)
SELECT p_brand, count(*) AS n, count(*) FILTER (a = b) AS in_place, max(abs(a - b))::BIGINT AS furthest FROM r GROUP BY 1""")
def order_comparison(t):
    return relations.order_comparison(t.part, "p_brand", ["p_retailprice", "p_partkey"], ["p_name", "p_partkey"])


@query("SELECT CASE WHEN starts_with(url, 'https://') THEN 'secure' WHEN starts_with(url, 'http://') THEN 'plain' WHEN contains(url, '://') THEN 'scheme' ELSE 'relative' END AS tier, count(*) AS n FROM pages GROUP BY 1")
def owner_tiers(t):
    return census.tiers(t.pages, "url", [("^https://", "secure"), ("^http://", "plain"), ("://", "scheme")], "relative")


@query(f"""WITH f AS (SELECT sha1, size < 1000 AS small FROM {HASHED}), d AS (SELECT sha1, bool_or(small) AS small FROM f GROUP BY 1)
SELECT (SELECT count(*) FROM f) AS files, (SELECT count(*) FILTER (small) FROM f) AS files_flagged, count(*) AS contents, count(*) FILTER (small) AS contents_flagged FROM d""")
def two_denominators(t):
    return census.two_denominators(docs_hashed(t), "sha1", F.col("size") < 1000)


# hashes of names, structure, expectations


def _fold_sql(start: int, step: str) -> str:
    return f"list_reduce(list_prepend({start}::HUGEINT, list_transform(string_split(name, ''), lambda c: ord(c)::HUGEINT)), lambda h, x: {step})::BIGINT"


@query(f"""WITH n AS (SELECT DISTINCT p_name AS name FROM part)
SELECT name, {_fold_sql(2166136261, '(xor(h, x) * 16777619) % 4294967296')} AS fnv1a, {_fold_sql(2166136261, 'xor((h * 16777619) % 4294967296, x)')} AS fnv1, {_fold_sql(0, '(h * 65599 + x) % 4294967296')} AS sdbm, md5(name) AS md5 FROM n""")
def name_hashes(t):
    name = F.col("name")
    return t.part.select(F.col("p_name").alias("name")).distinct().select("name", text.fnv1a(name).alias("fnv1a"), text.fnv1(name).alias("fnv1"), text.sdbm(name).alias("sdbm"), F.md5(F.encode(name, "UTF-8")).alias("md5"))


@query("""WITH k AS (SELECT DISTINCT md5(p_name) AS key FROM part), c AS (SELECT DISTINCT trim(w) AS name FROM (SELECT p_name AS w FROM part UNION ALL SELECT p_type FROM part UNION ALL SELECT p_brand FROM part)),
h AS (SELECT name, 'md5' AS fn, md5(name) AS key FROM c UNION ALL SELECT name, 'sha1', sha1(name) FROM c) SELECT fn, name, key FROM h JOIN k USING (key)""")
def hash_name_join(t):
    keys = t.part.select(F.md5(F.encode("p_name", "UTF-8")).alias("key")).distinct()
    names = t.part.select(F.explode(F.array("p_name", "p_type", "p_brand")).alias("name")).select(F.trim("name").alias("name")).distinct()
    return relations.named_keys(keys, "key", names, "name", {"md5": F.md5(F.encode("name", "UTF-8")), "sha1": F.sha1(F.encode("name", "UTF-8"))})


@query("SELECT tag, count(*) AS n, count(DISTINCT page_id) AS pages FROM (SELECT page_id, lower(unnest(regexp_extract_all(html, '<(/?[A-Za-z][A-Za-z0-9]*)', 1))) AS tag FROM pages) GROUP BY 1")
def tag_census(t):
    return text.tag_census(t.pages, "html", "page_id")


@query("""SELECT page_id, sha1(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', chr(39)), '&amp;', '&')) AS unescaped_sha1 FROM pages""")
def entities_unescaped(t):
    return t.pages.select("page_id", F.sha1(F.encode(text.unescaped(F.col("html")), "UTF-8")).alias("unescaped_sha1"))


@query("""SELECT CASE left(tok, 1) WHEN '"' THEN 'quoted' WHEN '(' THEN 'grouped' ELSE 'bare' END AS kind, count(*) AS n, count(DISTINCT tok) AS distinct_tokens
FROM (SELECT unnest(regexp_extract_all(text, '"[^"]*"|\\([^)]*\\)|[^ \\t\\n]+')) AS tok FROM conversations) GROUP BY 1""")
def line_tokens(t):
    return text.token_kinds(t.conversations, "text")


@query("""WITH l AS (SELECT role, split_part(line, ' ', 1) AS verb FROM (SELECT role, unnest(string_split(text, chr(10))) AS line FROM conversations) WHERE trim(line) <> '')
SELECT verb, count(*) FILTER (role = 'user') AS a, count(*) FILTER (role = 'assistant') AS b, count(*) FILTER (role = 'user') - count(*) FILTER (role = 'assistant') AS delta FROM l GROUP BY 1 HAVING a <> b""")
def skeleton_diff(t):
    return text.verb_deltas(t.conversations, "text", "role", "user", "assistant")


@query("""WITH r AS (SELECT doc_id, length(text) AS n, length(regexp_replace(text, '[^ -~]', '', 'g')) / nullif(length(text), 0) AS p, len(regexp_extract_all(text, '[ -~]{12,}')) AS found FROM documents)
SELECT doc_id, found::BIGINT AS found, CASE WHEN n < 12 OR p IS NULL THEN 0.0 ELSE round(pow(p, 12) * (1 + (n - 12) * (1 - p)), 4) END AS expected FROM r""")
def runs_against_expected(t):
    return search.runs_expected(t.documents, "text", "doc_id", 12)


@query("""SELECT doc_id, len(regexp_extract_all(text, '(?:[A-Z_][A-Z0-9_]*=[^\\n]*\\n){2,}'))::BIGINT AS blocks FROM documents""")
def env_blocks(t):
    return t.documents.select("doc_id", F.regexp_count("text", F.lit(r"(?:[A-Z_][A-Z0-9_]*=[^\n]*\n){2,}")).cast("long").alias("blocks"))


@query("""WITH b AS (SELECT doc_id, i, substr(text, (i * 256 + 1)::BIGINT, 256) AS b FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 255) // 256)) AS i FROM documents)),
c AS (SELECT doc_id, i, unnest(string_split(b, '')) AS c FROM b), k AS (SELECT doc_id, i, c, count(*) AS k FROM c GROUP BY ALL), n AS (SELECT *, sum(k) OVER (PARTITION BY doc_id, i) AS n FROM k),
h AS (SELECT doc_id, i, round(-sum(k / n * log2(k / n)), 4) AS h FROM n GROUP BY 1, 2) SELECT doc_id, count(*) AS blocks, max(h) AS most, count(*) FILTER (h >= 4.2) AS over FROM h GROUP BY 1""")
def entropy_blocks(t):
    return bytestats.entropy_blocks(t.documents, "text", "doc_id", 256, 4.2)


@query("""WITH c AS (SELECT doc_id, source, unnest(string_split(text, '')) AS c FROM documents WHERE text <> ''), n AS (SELECT doc_id, source, c, count(*) AS k FROM c GROUP BY ALL),
e AS (SELECT doc_id, source, k, sum(k) OVER (PARTITION BY doc_id) AS n FROM n), h AS (SELECT doc_id, source, max(n) AS n, round(-sum(k / n * log2(k / n)), 4) AS h FROM e GROUP BY 1, 2)
SELECT source, round(sum(h * n) / sum(n), 3) AS weighted_entropy, sum(n)::BIGINT AS chars FROM h GROUP BY 1""")
def weighted_entropy(t):
    per = bytestats.entropy(t.documents, "text", "doc_id").join(t.documents.select("doc_id", "source"), "doc_id").where("chars > 0")
    return per.groupBy("source").agg(F.round(F.sum(F.col("entropy") * F.col("chars")) / F.sum("chars"), 3).alias("weighted_entropy"), F.sum("chars").alias("chars"))


@query("WITH n AS (SELECT sum(length(text) // 64)::BIGINT AS n FROM documents) SELECT n AS blocks, n::DOUBLE * (n - 1) / 2 / pow(2.0, 128) AS expected_collisions FROM n")
def birthday_collisions(t):
    return bytestats.birthday(t.documents, "text", 64)


# sources: files are written from the tables into the shared folder and read again


def _item_files(t) -> str:
    """A folder with one text file an item of benchmark."""
    path = scratch(t._spark, "items")
    t.benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).repartition("item_id").write.partitionBy("item_id").text(path)
    return path


def _item():
    return F.regexp_extract("path", r"item_id=(\d+)", 1).cast("long").alias("item_id")


#: The content of an item's file: its text and the line end.
ITEM_FILE = "(SELECT item_id, coalesce(text, '') || chr(10) AS c FROM benchmark)"


@query(f"SELECT item_id, strlen(c)::BIGINT AS size, '.txt' AS extension FROM {ITEM_FILE}")
def source_tree(t):
    return files.tree(t._spark, _item_files(t)).select(_item(), "size", text.extension(F.col("path")).alias("extension"))


@query(f"SELECT item_id, strlen(c)::BIGINT AS size, sha1(c) AS sha1 FROM {ITEM_FILE}")
def source_blobs(t):
    return files.blobs(t._spark, _item_files(t)).withColumnRenamed("label", "path").select(_item(), "size", F.sha1("content").alias("sha1"))


@query(f"SELECT item_id, left(hex(encode(c)), 64) AS head FROM {ITEM_FILE}")
def source_heads(t):
    return files.heads(files.blobs(t._spark, _item_files(t)).withColumnRenamed("label", "path"), 32).select(_item(), F.hex("head").alias("head"))


@query(f"SELECT item_id, len(list_filter(range(1, greatest(strlen(c), 1)), lambda i: substr(hex(encode(c)), 2 * i::INT - 1, 4) = '7468'))::BIGINT AS hits FROM {ITEM_FILE}")
def source_chunks(t):
    chunks = files.chunked(files.blobs(t._spark, _item_files(t)).withColumnRenamed("label", "path"), 50, 1)
    return files.needle_in_chunks(chunks, b"th", 50).select(_item(), "hits")


@query(f"SELECT sha1, size, doc_id::VARCHAR || '.txt' AS path FROM {HASHED} UNION ALL SELECT NULL, NULL, NULL FROM (SELECT DISTINCT source FROM documents)")
def source_hash_list(t):
    path = scratch(t._spark, "hashes")
    lines = docs_hashed(t).select(F.concat_ws(" ", "sha1", "size", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("value"))
    lines.unionByName(t.documents.select(F.concat(F.lit("# "), "source").alias("value")).distinct()).write.text(path)
    return files.hash_list(t._spark, path).drop("line")


@query("SELECT x AS sha1, count(*) AS times FROM (SELECT unnest(regexp_extract_all(lower(text), '\\b([0-9a-f]{40})\\b', 1)) AS x FROM documents) GROUP BY 1")
def source_tokens(t):
    path = scratch(t._spark, "texts")
    t.documents.select(F.coalesce("text", F.lit(""))).write.text(path)
    return files.tokens40(t._spark, path).groupBy("sha1").agg(F.count("*").alias("times"))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def source_tsv(t):
    path = scratch(t._spark, "table")
    files.write_tsv(t.nation.select("n_nationkey", "n_name", "n_regionkey"), path)
    return files.tsv(t._spark, path, "n_nationkey long, n_name string, n_regionkey long")


def _zipped(t) -> DataFrame:
    """(path, content): a ZIP archive of each source and language's texts, a member a document."""

    def pack(pdf):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for i, body in sorted(zip(pdf["doc_id"], pdf["text"])):
                z.writestr(f"{i}.txt", body or "")
        return pd.DataFrame({"path": [str(pdf["doc_id"].min())], "content": [out.getvalue()]})

    some = t.documents.select("doc_id", "text", F.floor(F.col("doc_id") / 64).alias("part"))
    return some.groupBy("part").applyInPandas(pack, "path string, content binary")


@query("SELECT (min(doc_id) OVER (PARTITION BY doc_id // 64))::VARCHAR AS path, doc_id::VARCHAR || '.txt' AS name, strlen(coalesce(text, ''))::BIGINT AS size FROM documents")
def source_zip(t):
    return files.members(_zipped(t)).select("path", "name", "size")


def _mixed(t) -> DataFrame:
    """(label, content) of every document: as text, packed, packed and cut short, or under a false signature."""
    @F.pandas_udf("binary")
    def packed(bodies: pd.Series) -> pd.Series:
        def gz(b):
            z = zlib.compressobj(1, zlib.DEFLATED, 31)
            return z.compress(b) + z.flush()

        return bodies.map(gz)

    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    gz, kind = packed(body), F.col("doc_id") % 4
    content = F.when(kind == 0, body).when(kind == 1, gz).when(kind == 2, F.substring(gz, F.lit(1), F.length(gz) - 1)).otherwise(F.concat(F.unhex(F.lit("504B0304")), body))
    return t.documents.select(F.col("doc_id").cast("string").alias("label"), content.alias("content"), F.octet_length(body).cast("long").alias("size"))


@query(f"""WITH k AS (SELECT CASE doc_id % 4 WHEN 0 THEN 'text' WHEN 3 THEN 'zip' ELSE 'gzip' END AS kind, CASE doc_id % 4 WHEN 0 THEN 'undecoded' WHEN 1 THEN 'closed' ELSE 'refused' END AS outcome, size FROM {SIZED})
SELECT kind, outcome, count(*) AS files, sum(size)::BIGINT AS bytes, round(sum(size) * 100.0 / (SELECT sum(size) FROM k), 4) AS share_pct FROM k GROUP BY 1, 2""")
def coverage_account(t):
    tree = _mixed(t)
    return files.coverage(files.decode(tree), tree.select("label", "size"))


@query("SELECT CASE WHEN text IS NULL OR regexp_full_match(text, '[\\x00-\\x7F]*') THEN 'ascii' ELSE 'utf-8' END AS codec, count(*) AS files FROM documents GROUP BY 1")
def codec_census(t):
    return t.documents.select(F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content")).select(decoders.text_codec("content").alias("codec")).groupBy("codec").agg(F.count("*").alias("files"))


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS events FROM events GROUP BY 1, 2")
def stream_census(t):
    """The whole table as a stream, in the windows of the last batch."""
    spark = t._spark
    path, at = scratch(spark, "census"), scratch(spark, "census-at")
    stream = spark.readStream.schema(t.events.schema).parquet(f"{t._dir}/event[s].parquet")
    counted = arrivals.arrival_census(stream, "ts", "event_type")
    counted.writeStream.outputMode("complete").option("checkpointLocation", at).trigger(availableNow=True).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(path)).start().awaitTermination()
    return spark.read.parquet(path)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 3")
def most_common(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(3)


@query("SELECT source, median(size)::DOUBLE AS median, round(avg(size), 4) AS mean FROM (SELECT source, strlen(coalesce(text, ''))::BIGINT AS size FROM documents) GROUP BY 1")
def true_medians(t):
    """Exact medians: sizes are counted first, so a source's rows don't meet."""
    return census.true_medians(sized(t), ["source"], "size")


@query(f"SELECT NOT EXISTS (SELECT sha1 FROM {ITEMS} EXCEPT SELECT sha1 FROM {HASHED}) AS items_in_documents, NOT EXISTS (SELECT DISTINCT sha1 FROM {HASHED} WHERE lang = 'en' EXCEPT SELECT sha1 FROM {HASHED}) AS english_in_documents")
def subset_test(t):
    all_ = docs_hashed(t)
    return crossing.subset(items_hashed(t), all_).select(F.col("within").alias("items_in_documents")).crossJoin(crossing.subset(all_.where("lang = 'en'"), all_).select(F.col("within").alias("english_in_documents")))


@query(f"""SELECT count(*) AS names, count(s) AS covered, round(count(s) * 100.0 / count(*), 4) AS covered_pct FROM (SELECT DISTINCT o_custkey AS c FROM orders) LEFT JOIN (SELECT DISTINCT s_suppkey AS s FROM supplier) ON c = s""")
def table_coverage(t):
    return relations.table_coverage(t.orders.select("o_custkey"), "o_custkey", t.supplier.select("s_suppkey"), "s_suppkey").select("names", "covered", "covered_pct")


@query("SELECT event_type, CASE WHEN event_id % 50 = 0 THEN 'refused' ELSE 'read' END AS outcome, count(*) AS events, sum(CASE WHEN event_id % 50 <> 0 THEN event_id END)::BIGINT AS ids FROM events GROUP BY 1, 2")
def source_json(t):
    """Events as JSON lines, each fiftieth cut short: read where whole, refused and counted where not."""
    path = scratch(t._spark, "lines")
    line = F.to_json(F.struct("event_id", "event_type"))
    t.events.select(F.when(F.col("event_id") % 50 == 0, F.concat_ws("", F.lit("{\"event_type\": \""), "event_type", F.lit("\", \"event_id\": "))).otherwise(line)).write.text(path)
    got = files.json_lines(t._spark, path, "event_id long, event_type string")
    kind = F.coalesce(F.when(F.col("refused").isNull(), F.col("event_type")), F.regexp_extract("refused", r'"event_type": "([^"]*)"', 1))
    whole = F.when(F.col("refused").isNull(), F.col("event_id"))
    return got.groupBy(kind.alias("event_type"), F.when(F.col("refused").isNull(), "read").otherwise("refused").alias("outcome")).agg(F.count("*").alias("events"), F.sum(whole).alias("ids"))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, CASE WHEN n_nationkey % 5 <> 0 THEN n_regionkey::BIGINT END AS n_regionkey, n_nationkey % 5 = 0 AS refused FROM nation")
def source_xml(t):
    """Nations as XML elements, each fifth with a region that is no number: read field by field, refused by name."""
    path = scratch(t._spark, "elements")
    region = F.when(F.col("n_nationkey") % 5 == 0, "none").otherwise(F.col("n_regionkey").cast("string"))
    t.nation.select("n_nationkey", "n_name", region.alias("n_regionkey")).write.format("xml").option("rowTag", "nation").option("rootTag", "nations").save(path)
    got = files.xml_rows(t._spark, path, "nation", "n_nationkey long, n_name string, n_regionkey long")
    return got.select("n_nationkey", "n_name", "n_regionkey", F.col("refused").isNotNull().alias("refused"))


VERSIONS = """o AS (SELECT c_custkey, c_name, c_mktsegment, c_nationkey FROM customer WHERE c_custkey % 7 <> 0),
n AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN upper(c_name) || '!' ELSE c_name END AS c_name, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS c_mktsegment, c_nationkey FROM customer WHERE c_custkey % 11 <> 0),
b AS (SELECT c_custkey, o.c_custkey IS NULL AS a, n.c_custkey IS NULL AS r, o.c_name AS o1, n.c_name AS n1, o.c_mktsegment AS o2, n.c_mktsegment AS n2, o.c_nationkey::VARCHAR AS o3, n.c_nationkey::VARCHAR AS n3
FROM o FULL JOIN n USING (c_custkey))"""


def _versions(t):
    """Two versions of the customers: some removed, some added, names and segments changed in the second."""
    rows = t.customer.select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    key = F.col("c_custkey")
    new = rows.where(key % 11 != 0).withColumn("c_name", F.when(key % 5 == 0, F.concat(F.upper("c_name"), F.lit("!"))).otherwise(F.col("c_name"))).withColumn("c_mktsegment", F.when(key % 3 != 0, F.col("c_mktsegment")))
    return rows.where(key % 7 != 0), new


@query(f"""WITH {VERSIONS}, f AS (SELECT c_custkey, a, r, 'c_name' AS field, o1 AS old, n1 AS new FROM b UNION ALL SELECT c_custkey, a, r, 'c_mktsegment', o2, n2 FROM b UNION ALL SELECT c_custkey, a, r, 'c_nationkey', o3, n3 FROM b)
SELECT c_custkey, CASE WHEN a THEN 'added' WHEN r THEN 'removed' ELSE 'changed' END AS change, field, old, new FROM f WHERE old IS DISTINCT FROM new""")
def field_diff(t):
    return relations.field_changes(*_versions(t), "c_custkey")


@query(f"""WITH {VERSIONS}, d AS (SELECT *, (o1 IS DISTINCT FROM n1)::INT + (o2 IS DISTINCT FROM n2)::INT + (o3 IS DISTINCT FROM n3)::INT AS n, coalesce(o1 <> n1, false)::INT + coalesce(o2 <> n2, false)::INT AS s FROM b)
SELECT CASE WHEN a THEN 'added' WHEN r THEN 'removed' WHEN n = 0 THEN 'same' WHEN n = s THEN 'translation' ELSE 'structure' END AS verdict, count(*) AS records FROM d GROUP BY 1""")
def edit_classes(t):
    return relations.edit_classes(*_versions(t), "c_custkey").groupBy("verdict").agg(F.count("*").alias("records"))


@query(f"""WITH n AS (SELECT DISTINCT p_name AS name FROM part), h AS (SELECT name, {_fold_sql(0, 'xor(xor((h * 16 + x) % 4294967296, (((h * 16 + x) % 4294967296) // 268435456) * 16), (((h * 16 + x) % 4294967296) // 268435456) * 268435456)')} AS elf,
{_fold_sql(0, 'xor(((h + x) * 1025) % 4294967296, (((h + x) * 1025) % 4294967296) // 64)')}::HUGEINT AS j FROM n), j AS (SELECT *, (j * 9) % 4294967296 AS k FROM h)
SELECT name, elf, ((xor(k, k // 2048) * 32769) % 4294967296)::BIGINT AS one_at_a_time FROM j""")
def more_name_hashes(t):
    name = F.col("name")
    return t.part.select(F.col("p_name").alias("name")).distinct().select("name", text.elf(name).alias("elf"), text.one_at_a_time(name).alias("one_at_a_time"))


def _crc_sql(start: int, poly: int) -> str:
    bits = f"flatten(list_transform(string_split(name, ''), lambda c: [ord(c)::BIGINT{', -1' * 8}]))"
    return f"list_reduce(list_prepend({start}::BIGINT, {bits}), lambda h, x: CASE WHEN x >= 0 THEN xor(h, x) ELSE xor(h // 2, (h % 2) * {poly}) END)"


@query(f"""WITH n AS (SELECT DISTINCT p_name AS name FROM part), c AS (SELECT name, {_crc_sql(4294967295, 3988292384)} AS jamcrc, {_crc_sql(0, 40961)} AS crc16 FROM n)
SELECT name, xor(jamcrc, 4294967295) AS crc32, jamcrc, crc16 FROM c""")
def name_checksums(t):
    data = F.encode("name", "UTF-8")
    return t.part.select(F.col("p_name").alias("name")).distinct().select("name", F.crc32(data).alias("crc32"), text.jamcrc(data).alias("jamcrc"), text.crc16(data).alias("crc16"))


@query(r"""SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ''), lambda c: printf('%02X', xor(ord(c), 90))), '') AS xored, regexp_replace(hex(encode(p_name)), '(..)(..)', '\2\1', 'g') AS swapped FROM part""")
def xor_and_swap(t):
    data = F.encode("p_name", "UTF-8")
    return t.part.select("p_partkey", text.xored(data, 90).alias("xored"), text.byte_swapped(data).alias("swapped"))


# paths, links, runs, reports


@query(r"""WITH p AS (SELECT regexp_extract(url, '^[a-z]+://[^/?#]+/([^?#]*)', 1) AS path FROM pages), b AS (SELECT path, regexp_extract(path, '([^/]*)$', 1) AS base FROM p),
s AS (SELECT CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '(root)' END AS top, coalesce(nullif(regexp_extract(base, '^(\.*[^.].*?)\.[^.]*$', 1), ''), base) AS stem FROM b),
h AS (SELECT stem, count(DISTINCT top) AS homes FROM s GROUP BY 1)
SELECT top, count(*) AS pages, count(DISTINCT stem) AS stems, count(DISTINCT stem) FILTER (WHERE homes > 1) AS ambiguous FROM s JOIN h USING (stem) GROUP BY 1""")
def path_parts(t):
    path = F.regexp_extract("url", "^[a-z]+://[^/?#]+/([^?#]*)", 1)
    pairs = t.pages.select(text.top_dir(path).alias("top"), text.stem(path).alias("stem")).groupBy("top", "stem").agg(F.count("*").alias("n"))
    homes = pairs.groupBy("stem").agg(F.count("*").alias("homes"))
    return pairs.join(homes, "stem").groupBy("top").agg(F.sum("n").alias("pages"), F.count("*").alias("stems"), F.count_if(F.col("homes") > 1).alias("ambiguous"))


@query(r"""WITH u AS (SELECT 'attribute' AS kind, unnest(regexp_extract_all(html, '(?:href|src)="([^"]*)"', 1) || regexp_extract_all(html, '(?:href|src)=''([^'']*)''', 1)) AS u FROM pages
UNION ALL SELECT 'bare', unnest(regexp_extract_all(regexp_replace(html, '<[^>]*>', ' ', 'g'), '(https?://[^ \t\r\n"''<>]+)', 1)) FROM pages)
SELECT kind, split_part(split_part(u, '#', 1), '?', 1) AS target, count(*) AS links FROM u GROUP BY 1, 2""")
def links_by_kind(t):
    return search.links(t.pages, "html").groupBy("kind", "target").agg(F.count("*").alias("links"))


@query("""WITH p AS (SELECT doc_id, string_split(regexp_replace(text, '[^ -~]', chr(10), 'g'), chr(10)) AS p FROM documents), r AS (SELECT doc_id, unnest(p) AS run, generate_subscripts(p, 1) AS i FROM p),
c AS (SELECT doc_id, length(run) AS length, sum(length(run) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(run) - 1 AS a FROM r) SELECT doc_id, a::BIGINT AS at, length FROM c WHERE length >= 6""")
def printable_runs_at(t):
    return search.runs_at(t.documents, "doc_id", "text", 6)


@query(" UNION ALL ".join(f"SELECT '{n}' AS needle, '{form}' AS form, coalesce(sum((length(text) - length(replace(text, '{n}', ''))) // {len(n)}), 0)::BIGINT AS hits FROM documents" for n in ("the", "und", "zqxj") for form in ("narrow", "wide")))
def needles_wide(t):
    return search.wide_counts(t.documents, "text", ["the", "und", "zqxj"])


@query("SELECT rpad(coalesce(source, ''), 12, ' ') || ' ' || lpad(count(*)::VARCHAR, 8, ' ') || ' ' || lpad(sum(strlen(coalesce(text, '')))::VARCHAR, 14, ' ') AS line FROM documents GROUP BY source")
def fixed_width_report(t):
    return census.fixed_width(sized(t).groupBy("source").agg(F.count("*").alias("files"), F.sum("size").alias("bytes")), {"source": 12, "files": 8, "bytes": 14})


# clocks by format

#: The raw number that each kind of event keeps its time in.
RAW = """CASE event_type WHEN 'view' THEN s WHEN 'click' THEN s + 2082844800 WHEN 'error' THEN (s + 11644473600) * 10000000 WHEN 'signup' THEN (s + 12219292800) * 10000000
ELSE ((y - 1980) << 25) + (mo << 21) + (d << 16) + (h << 11) + (mi << 5) + (se // 2) END"""
TICKS = " UNION ALL ".join(f"SELECT event_type, s, '{name}' AS reader, raw // {ticks} - {zero} AS r FROM w" for name, (ticks, zero) in clocks.READERS.items())


@query(f"""WITH e AS (SELECT event_type, floor(epoch(ts))::BIGINT AS s, year(ts) AS y, month(ts) AS mo, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, second(ts) AS se FROM events), w AS (SELECT event_type, s, ({RAW})::BIGINT AS raw FROM e),
p AS (SELECT *, (raw >> 25) + 1980 AS y, (raw >> 21) & 15 AS mo, (raw >> 16) & 31 AS d, (raw >> 11) & 31 AS h, (raw >> 5) & 63 AS mi, raw & 31 AS se FROM w WHERE raw BETWEEN 0 AND 4294967295),
k AS (SELECT *, make_date(y, greatest(1, least(mo, 12)), 1) AS first FROM p),
r AS ({TICKS} UNION ALL SELECT event_type, s, 'dos', (first - DATE '1970-01-01') * 86400 + (d - 1) * 86400 + h * 3600 + mi * 60 + se * 2 FROM k WHERE mo BETWEEN 1 AND 12 AND h < 24 AND mi < 60 AND se < 30 AND d BETWEEN 1 AND day(last_day(first)))
SELECT event_type, reader, count(*) AS plausible, count(*) FILTER (WHERE s - r BETWEEN 0 AND 1) AS exact FROM r WHERE r BETWEEN {clocks.PLAUSIBLE[0]} AND {clocks.PLAUSIBLE[1]} GROUP BY 1, 2""")
def clock_readers(t):
    ts, s = F.col("ts"), F.unix_seconds(F.col("ts").cast("timestamp"))
    dos = F.lit(0).cast("long")
    for part, at in ((F.year(ts) - 1980, 25), (F.month(ts), 21), (F.day(ts), 16), (F.hour(ts), 11), (F.minute(ts), 5), (F.floor(F.second(ts) / 2), 0)):
        dos = dos + F.shiftleft(part.cast("long"), at)
    kind = F.col("event_type")
    raw = F.when(kind == "view", s).when(kind == "click", s + 2082844800).when(kind == "error", (s + 11644473600) * 10_000_000).when(kind == "signup", (s + 12219292800) * 10_000_000).otherwise(dos)
    read = clocks.clock_readings(t.events.select("event_type", s.alias("s"), raw.alias("raw")), "raw")
    return read.groupBy("event_type", "reader").agg(F.count("*").alias("plausible"), F.count_if((F.col("s") - F.col("seconds")).between(0, 1)).alias("exact"))


# byte and word runs


@query("""WITH b AS (SELECT s_suppkey AS key, hex(encode(s_name)) AS x, hex(encode(c_name)) AS y FROM supplier JOIN customer ON s_suppkey = c_custkey), i AS (SELECT *, unnest(range(greatest(length(x), length(y)) // 2)) AS i FROM b),
d AS (SELECT key, i, i - row_number() OVER (PARTITION BY key ORDER BY i) AS g FROM i WHERE substr(x, (2 * i + 1)::BIGINT, 2) <> substr(y, (2 * i + 1)::BIGINT, 2)) SELECT key, min(i) AS at, count(*) AS length FROM d GROUP BY key, g""")
def byte_diffs(t):
    both = t.supplier.join(t.customer, F.col("s_suppkey") == F.col("c_custkey")).select(F.col("s_suppkey").alias("key"), "s_name", "c_name")
    return similarity.byte_diffs(both, "key", "s_name", "c_name")


@query(GRAM_CTE.split("dg AS")[0].replace("FROM documents", "FROM documents WHERE lang = 'en'", 1) + r"""k AS (SELECT string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM documents WHERE lang <> 'en'),
kg AS (SELECT DISTINCT array_to_string(w[p:p + 7], ' ') AS g FROM (SELECT w, unnest(range(1, len(w) - 6)) AS p FROM k WHERE len(w) >= 8)),
dg AS (SELECT doc_id, p, array_to_string(w[p:p + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM d WHERE len(w) >= 8)),
ig AS (SELECT item_id, p AS q, array_to_string(w[p:p + 7], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS p FROM i WHERE len(w) >= 8)),
h AS (SELECT doc_id, item_id, q, p - q AS d FROM dg JOIN ig USING (g) WHERE g NOT IN (SELECT g FROM kg)),
r AS (SELECT *, q - row_number() OVER (PARTITION BY doc_id, item_id, d ORDER BY q) AS run FROM h), u AS (SELECT doc_id, item_id, min(q) AS q, count(*) + 7 AS words FROM r GROUP BY doc_id, item_id, d, run)
SELECT sha1(array_to_string(w[q:q + words - 1], ' ')) AS run_sha1, words, count(*) AS places, count(DISTINCT doc_id) AS texts FROM u JOIN i USING (item_id) GROUP BY 1, 2""")
def novel_runs(t):
    """What English documents share with the benchmark and no document of another language has."""
    docs = t.documents
    return similarity.novel_runs(docs.where("lang = 'en'"), "doc_id", t.benchmark, "item_id", docs.where("lang <> 'en'"), "doc_id", "text")


@query("""WITH p AS (SELECT l_suppkey, l_returnflag AS f, unnest(range(l_partkey, l_partkey + l_quantity::BIGINT)) AS place FROM lineitem), o AS (SELECT l_suppkey, place, min(f) AS owner FROM p GROUP BY 1, 2)
SELECT l_suppkey, owner, count(*) AS bytes FROM o GROUP BY 1, 2""")
def owned_intervals(t):
    """Parts in stock as intervals of each supplier, owned by the first of three flags that claims a place."""
    claims = t.lineitem.select("l_suppkey", "l_returnflag", "l_partkey", (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("end"))
    return relations.owned(claims, "l_suppkey", "l_partkey", "end", "l_returnflag", ["A", "N", "R"])


# controls taken from the data


@query(f"""WITH c AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[a-z]{{4,}}')) AS w FROM documents) GROUP BY 1), b AS (SELECT w FROM c ORDER BY n DESC, w DESC LIMIT 1),
p AS (SELECT w, array_to_string(list_transform(list_sort(list_transform(range(length(w)), lambda i: md5('7:' || i) || i)), lambda k: substr(w, substr(k, 33)::BIGINT + 1, 1)), '') AS s FROM b),
k AS (SELECT 'must_hit' AS kind, w AS needle FROM p UNION ALL SELECT 'must_miss', s FROM p)
SELECT kind, needle, sum((length(text) - length(replace(text, needle, ''))) // length(needle))::BIGINT AS hits, count(*) FILTER (contains(text, needle)) AS docs FROM k, documents GROUP BY 1, 2""")
def derived_controls(t):
    """The corpus's commonest word as the needle that must hit, its letters in a seeded order as the one that must miss."""
    return search.needle_counts(t.documents, "text", checks.derived_needles(t.documents, "text", 7)).select("kind", "needle", "hits", "docs")


@query("""WITH o AS (SELECT list(i ORDER BY md5('7:' || i)) AS o FROM (SELECT unnest(range((SELECT max(len(embedding)) FROM embeddings))) AS i)), e AS (SELECT vec_id, embedding, list_transform(o, lambda i: embedding[i + 1]) AS control FROM embeddings, o),
p AS (SELECT q.vec_id AS query, list_sum(list_transform(list_zip(q.embedding, r.embedding), lambda x: abs(x[1]::DOUBLE - x[2]::DOUBLE))) / len(q.embedding) AS mad,
list_sum(list_transform(list_zip(q.embedding, r.control), lambda x: abs(x[1]::DOUBLE - x[2]::DOUBLE))) / len(q.embedding) AS shuffled FROM e q JOIN e r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0),
m AS (SELECT query, min(mad) AS m, min(shuffled) AS s FROM p GROUP BY 1) SELECT query, round(m, 6) AS mad, round(s, 6) AS control, round(s / m, 4) AS factor, s >= 1.5 * m AS separates FROM m""")
def mad_permuted_control(t):
    places = t.embeddings.agg(F.max(F.size("embedding"))).first()[0] or 0
    return similarity.separation(t.embeddings.where("vec_id % 100 = 0"), t.embeddings, "vec_id", "embedding", order=checks.seeded_order(places, 7))


@query(f"SELECT CASE doc_id % 3 WHEN 0 THEN 'gzip' WHEN 1 THEN 'bzip2' ELSE 'xz' END AS kind, doc_id % 7 <> 0 AS closed, count(*) AS files, coalesce(sum(CASE WHEN doc_id % 7 <> 0 THEN size END), 0)::BIGINT AS unpacked FROM {SIZED} GROUP BY 1, 2")
def source_packed(t):
    """Every document packed by one of three codecs, each seventh cut short: unpacked and counted, or refused."""
    @F.pandas_udf("binary")
    def packed(bodies: pd.Series, keys: pd.Series) -> pd.Series:
        codecs = (gzip.compress, bz2.compress, lzma.compress)
        return pd.Series([codecs[k % 3](b)[: None if k % 7 else -1] for b, k in zip(bodies, keys)])

    tree = t.documents.select(F.col("doc_id").cast("string").alias("label"), packed(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), "doc_id").alias("content"))
    size = F.regexp_extract("detail", r"^\([0-9]+, ([0-9]+)\)$", 1)
    return files.decode(tree).groupBy("kind", F.col("error").isNull().alias("closed")).agg(F.count("*").alias("files"), F.coalesce(F.sum(F.when(size != "", size.cast("long"))), F.lit(0)).alias("unpacked"))


@query("""WITH n AS (SELECT p_partkey, unnest([p_name, p_type, p_brand, p_partkey::VARCHAR]) AS s FROM part) SELECT p_partkey, s AS name FROM n WHERE length(s) BETWEEN 6 AND 64""")
def terminated_names(t):
    """Names read back from records of four strings, a NUL after each."""
    record = F.concat(*[F.concat(F.col(c).cast("string"), F.lit("\0")) for c in ("p_name", "p_type", "p_brand", "p_partkey")])
    return t.part.select("p_partkey", F.explode(text.terminated_names(record)).alias("name"))


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT DISTINCT user_id AS k FROM events), s AS (SELECT count(*) AS n FROM a JOIN b USING (k)), u AS (SELECT count(*) AS n FROM (SELECT k FROM a UNION SELECT k FROM b))
SELECT x.n AS in_a, y.n AS in_b, s.n AS shared, u.n AS together, x.n + y.n - s.n - u.n AS residue FROM (SELECT count(*) AS n FROM a) x, (SELECT count(*) AS n FROM b) y, s, u""")
def set_sizes(t):
    return census.set_sizes(t.orders.select(F.col("o_custkey").alias("k")), t.events.select(F.col("user_id").alias("k")), "k")
