"""The engine's operators bound to the driver's tables, each with an oracle written by hand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classifiers as C
from ..functions import scalars as S
from ..functions.parsers import html_complexity
from ..operators import aggregates as A
from ..operators import dedupe as D
from ..operators import joins as J
from ..operators import selection as P
from ..operators import sequences as Q
from ..operators import sets as U

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


class Tables:
    """Tables of a folder, read when named."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


# --- sequences

_RUNS = """
WITH s AS (SELECT user_id, event_type, row_number() OVER w AS place, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k
           FROM events {where} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT user_id, event_type, min(place) AS start, count(*) AS len FROM s GROUP BY user_id, event_type, place - k)
SELECT user_id, sum(len)::BIGINT AS event_count, coalesce(sum(len) FILTER (len >= 2), 0)::BIGINT AS repeated_count,
       max(len)::BIGINT AS max_run, (coalesce(sum(len) FILTER (len >= 2), 0)::DOUBLE / sum(len)) AS repeat_fraction,
       first(event_type ORDER BY len DESC, start) FILTER (len >= 2) AS top_signature
FROM r GROUP BY user_id
"""


@query(_RUNS.format(where=""))
def seq_repeat_metrics(t: Tables) -> DataFrame:
    return Q.repeat_metrics(t.events, ["user_id"], ["ts", "event_id"], "event_type")


_SCOPES = {"all": "", "user": "WHERE event_type <> 'signup'", "classified": "WHERE event_type NOT IN ('signup', 'error')"}


@query(
    "WITH " + ", ".join(f"{k}_m AS ({_RUNS.format(where=w)})" for k, w in _SCOPES.items())
    + " SELECT user_id, " + ", ".join(
        f"coalesce({k}_m.{c}, 0) AS {k}_{c}" if c.endswith(("_count", "_run")) else f"{k}_m.{c} AS {k}_{c}"
        for k in _SCOPES for c in ("event_count", "repeated_count", "max_run", "repeat_fraction", "top_signature")
    ) + " FROM all_m LEFT JOIN user_m USING (user_id) LEFT JOIN classified_m USING (user_id)"
)
def seq_classified_scope(t: Tables) -> DataFrame:
    """All three scopes: errors are actions of no class, sign-ups none of the user's."""
    e = F.col("event_type")
    rows = t.events.withColumn("category", F.when(e == "error", "unknown_action").when(e == "signup", "setup").otherwise("click"))
    return Q.sequence_metrics(rows, ["user_id"], ["ts", "event_id"], "event_type")


@query("""
WITH s AS (SELECT user_id, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place,
                  row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events)
SELECT user_id, event_type, min(place)::INTEGER AS start, count(*) AS length FROM s GROUP BY user_id, event_type, place - k
""")
def seq_runs(t: Tables) -> DataFrame:
    return Q.runs(t.events, ["user_id"], ["ts", "event_id"], "event_type")


@query("""
SELECT user_id, count(*) AS visits, count(*) - count(DISTINCT json_extract_string(props, '$.k')) AS revisits
FROM events WHERE event_type = 'view' AND json_extract_string(props, '$.k') IS NOT NULL GROUP BY user_id
""")
def seq_revisits(t: Tables) -> DataFrame:
    return Q.revisits(t.events.withColumn("target", F.get_json_object("props", "$.k")), ["user_id"], "target", F.col("event_type") == "view")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sequence_index FROM events")
def sequence_index(t: Tables) -> DataFrame:
    return Q.sequence_index(t.events, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "sequence_index")


@query("""
WITH m AS (SELECT user_id, event_id, event_type, max((event_type = 'click')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM events)
SELECT user_id, event_id, event_type FROM m WHERE coalesce(past, 0) = 0
""")
def first_non_nav(t: Tables) -> DataFrame:
    return Q.up_to_first(t.events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "click").select("user_id", "event_id", "event_type")


@query("""
WITH c AS (SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey),
s AS (SELECT orders, row_number() OVER (ORDER BY orders) - 1 AS k, count(*) OVER () AS n FROM c),
q AS (SELECT min(orders) FILTER (k = round_even(33 * (n - 1) / 100.0, 0)::BIGINT) AS lo, min(orders) FILTER (k = round_even(66 * (n - 1) / 100.0, 0)::BIGINT) AS hi FROM s)
SELECT c_custkey, orders, CASE WHEN orders <= lo THEN 'small' WHEN orders <= hi THEN 'medium' ELSE 'large' END AS bin FROM c, q
""")
def tertile_bins(t: Tables) -> DataFrame:
    counts = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    return Q.tertile_bins(J.join_filled(t.customer.select("c_custkey"), counts, ["c_custkey"], {"orders": 0}), "orders")


@query("""
WITH m AS (SELECT user_id, event_id, ts, event_type, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS context FROM events)
SELECT user_id, event_id, context FROM m WHERE event_type = 'purchase'
""")
def asof_context(t: Tables) -> DataFrame:
    rows = J.latest_before(t.events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "view", "value", "context")
    return rows.where("event_type = 'purchase'").select("user_id", "event_id", "context")


# --- aggregates

@query("SELECT user_id, event_type, count(*) AS n FROM events WHERE coalesce(event_type, '') <> '' GROUP BY ALL")
def event_histogram_map(t: Tables) -> DataFrame:
    maps = A.histogram_map(t.events, ["user_id"], "event_type")
    return maps.select("user_id", F.explode("counts").alias("event_type", "n"))


@query("SELECT user_id % 10 AS bucket, event_type, count(*) AS n FROM events GROUP BY ALL")
def counter_merge(t: Tables) -> DataFrame:
    maps = A.histogram_map(t.events, ["user_id"], "event_type").withColumn("bucket", F.col("user_id") % 10)
    return A.merge_maps(maps, ["bucket"], "counts").select("bucket", F.explode("counts").alias("event_type", "n"))


@query("""
WITH c AS (SELECT user_id, count(*) FILTER (event_type IN ('purchase', 'error')) AS assertions, count(*) FILTER (event_type = 'purchase') AS direct_assertions, 0 AS hook_assertions,
  count(*) FILTER (event_type = 'error') AS helper_assertions, count(*) FILTER (event_type = 'purchase') AS body_assertions, count(*) FILTER (event_type IN ('click', 'view')) AS ui_actions,
  count(*) FILTER (event_type = 'click') AS body_ui_actions, count(*) FILTER (event_type = 'signup') AS ncloc, count(*) AS statements FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN ui_actions > 0 THEN round_even(assertions::DOUBLE / ui_actions, 6) END AS assertion_density_all_actions,
  CASE WHEN body_ui_actions > 0 THEN round_even(body_assertions::DOUBLE / body_ui_actions, 6) END AS assertion_density_test_body,
  CASE WHEN ncloc > 0 THEN round_even(assertions::DOUBLE / ncloc, 6) END AS assertion_density_per_ncloc, round_even(assertions::DOUBLE / statements, 6) AS assertion_density_per_statement,
  assertions = 0 AS no_assertions, assertions > 0 AND direct_assertions = 0 AND helper_assertions > 0 AS only_helper_assertions FROM c
""")
def density_ratio(t: Tables) -> DataFrame:
    e = F.col("event_type")
    n = lambda *kinds: F.count_if(e.isin(*kinds))
    by = t.events.groupBy("user_id").agg(
        n("purchase", "error").alias("assertions"), n("purchase").alias("direct_assertions"), F.lit(0).alias("hook_assertions"), n("error").alias("helper_assertions"),
        n("purchase").alias("body_assertions"), n("click", "view").alias("ui_actions"), n("click").alias("body_ui_actions"), n("signup").alias("ncloc"), F.count("*").alias("statements"),
    )
    columns = ["assertion_density_all_actions", "assertion_density_test_body", "assertion_density_per_ncloc", "assertion_density_per_statement", "no_assertions", "only_helper_assertions"]
    return A.densities(by).select("user_id", *columns)


@query("""
WITH m AS (SELECT l_orderkey, l_linenumber, l_returnflag, min(l_linenumber) FILTER (l_linestatus = 'F' AND l_returnflag <> 'N') OVER (PARTITION BY l_orderkey) AS first_line FROM lineitem)
SELECT l_orderkey, l_linenumber FROM m WHERE l_returnflag = 'A' OR first_line IS NULL OR l_linenumber <= first_line
""")
def lifecycle_gate(t: Tables) -> DataFrame:
    """Lines up to an order's first UI action that is no navigation, or tied to a hook."""
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_returnflag", F.when(F.col("l_linestatus") == "F", "ui_action").otherwise("setup").alias("feature_type"),
        F.when(F.col("l_returnflag") == "N", "navigation").otherwise("click").alias("category"),
    )
    return Q.lifecycle_window(rows, ["l_orderkey"], "l_linenumber", "category", F.col("l_returnflag") == "A").select("l_orderkey", "l_linenumber")


@query("""
WITH s AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events),
u AS (SELECT user_id, min(place) FILTER (event_type = 'click') AS u0, max(place) FILTER (event_type = 'click') AS u1, min(place) FILTER (event_type = 'purchase') AS a0, max(place) FILTER (event_type = 'purchase') AS a1 FROM s GROUP BY user_id),
i AS (SELECT s.user_id, bool_or(place > u0 AND place < u1) AS inside FROM s JOIN u USING (user_id) WHERE event_type = 'purchase' GROUP BY s.user_id)
SELECT user_id, CASE WHEN a0 IS NULL THEN 'none' WHEN u0 IS NULL THEN 'assertions_only' WHEN a0 > u1 THEN 'end_only' WHEN a1 < u0 THEN 'start_only' WHEN inside THEN 'interleaved' ELSE 'mixed' END AS placement
FROM u LEFT JOIN i USING (user_id)
""")
def placement(t: Tables) -> DataFrame:
    rows = Q.sequence_index(t.events, ["user_id"], ["ts", "event_id"], "at")
    return A.assertion_placement(rows, ["user_id"], "at", F.col("event_type") == "click", F.col("event_type") == "purchase")


def _flags(t: Tables) -> tuple[DataFrame, DataFrame]:
    spine = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", "o_orderkey")
    return t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag"), spine


@query("SELECT l_returnflag AS label, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM lineitem) AS share FROM lineitem GROUP BY 1")
def weighted_event(t: Tables) -> DataFrame:
    return A.event_weighted(t.lineitem, "l_returnflag")


@query("""
SELECT l_returnflag AS label, count(DISTINCT l_orderkey) AS tests, count(DISTINCT l_orderkey)::DOUBLE / (SELECT count(DISTINCT o_orderkey) FROM orders JOIN customer ON o_custkey = c_custkey) AS share
FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY 1
""")
def weighted_test(t: Tables) -> DataFrame:
    events, spine = _flags(t)
    return A.test_weighted(J.attach_to_spine(events, spine, ["o_orderkey"]), spine, ["o_orderkey"], "l_returnflag")


@query("""
WITH sp AS (SELECT c_nationkey, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey),
size AS (SELECT c_nationkey, count(DISTINCT o_orderkey) AS tests FROM sp GROUP BY 1),
have AS (SELECT c_nationkey, l_returnflag, count(DISTINCT o_orderkey) AS n FROM sp JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT l_returnflag AS label, round(sum(n::DOUBLE / tests) / (SELECT count(*) FROM size), 9) AS mean_share, count(*) AS repos_with_label, (SELECT count(*) FROM size) AS repo_count
FROM have JOIN size USING (c_nationkey) GROUP BY 1
""")
def weighted_repo_mean(t: Tables) -> DataFrame:
    events, spine = _flags(t)
    out = A.repo_weighted(events.join(spine, "o_orderkey"), spine, "c_nationkey", ["o_orderkey"], "l_returnflag")
    return out.withColumn("mean_share", F.round("mean_share", 9))


@query("""
WITH c AS (SELECT o_custkey, o_orderkey, l_linenumber AS len, l_linestatus = 'O' AS soft FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
f AS (SELECT o_custkey, count(*) AS assertions, 0::BIGINT AS missing, count(*) FILTER (len > 1) AS chained_matchers, count(*) FILTER (soft) AS soft FROM c GROUP BY 1),
r AS (SELECT o_custkey, o_orderkey, max(len) AS top FROM c GROUP BY 1, 2)
SELECT o_custkey, any_value(assertions) AS assertions, any_value(missing) AS missing, any_value(chained_matchers) AS chained_matchers, any_value(soft) AS soft,
       count(*) AS chains, count(*) FILTER (top > 1) AS chained_roots, max(top) AS max_chain_length, avg(top) AS mean_chain_length
FROM f JOIN r USING (o_custkey) GROUP BY o_custkey
""")
def chain_metrics(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "o_custkey", "o_orderkey", F.col("l_linenumber").alias("len"), (F.col("l_linestatus") == "O").alias("is_soft_assertion")
    )
    return A.assertion_chains(rows, ["o_custkey"], "o_orderkey", "len")


@query("""
WITH s AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents WHERE n_chars IS NOT NULL)
SELECT lang, any_value(n) AS n, min(n_chars) FILTER (k = round_even(50 * (n - 1) / 100.0, 0)) AS p50, min(n_chars) FILTER (k = round_even(90 * (n - 1) / 100.0, 0)) AS p90, min(n_chars) FILTER (k = round_even(99 * (n - 1) / 100.0, 0)) AS p99
FROM s GROUP BY lang
""")
def nearest_rank_percentiles(t: Tables) -> DataFrame:
    return A.nearest_rank_percentiles(t.documents, ["lang"], "n_chars")


@query("""
WITH s AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, any_value(n) AS n, min(n_chars) FILTER (k = n // 2) AS median FROM s GROUP BY lang
""")
def upper_median(t: Tables) -> DataFrame:
    return A.upper_median(t.documents, ["lang"], "n_chars")


@query("SELECT lang, median(n_chars) AS median FROM documents GROUP BY lang")
def true_median(t: Tables) -> DataFrame:
    return A.true_median(t.documents, ["lang"], "n_chars")


@query("SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1")
def distribution(t: Tables) -> DataFrame:
    return A.distribution(t.events, "event_type")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def crosstab(t: Tables) -> DataFrame:
    return A.crosstab(t.orders, "o_orderstatus", "o_orderpriority")


@query("SELECT coalesce(nullif(p_brand, ''), 'Unknown') AS p_brand, count(*) AS row_count, sum(p_size)::BIGINT AS p_size FROM part GROUP BY 1")
def group_summary(t: Tables) -> DataFrame:
    return A.group_summary(t.part, "p_brand", ["p_size"])


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2)
SELECT user_id, first(event_type ORDER BY n DESC, f) AS event_type FROM c GROUP BY user_id
""")
def primary_label(t: Tables) -> DataFrame:
    return A.primary_label(t.events, ["user_id"], "event_type", "event_id")


@query("""
SELECT o_custkey, first(o_orderstatus ORDER BY CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 WHEN 'P' THEN 3 ELSE 0 END DESC) AS o_orderstatus FROM orders GROUP BY o_custkey
""")
def highest_rank(t: Tables) -> DataFrame:
    return A.highest_rank(t.orders, ["o_custkey"], "o_orderstatus", ["F", "O", "P"])


@query("""
SELECT o_custkey, count(*) AS attempted, count(*) FILTER (o_orderstatus = 'F') AS passed, bool_and(o_orderstatus = 'F') AS stable, median(o_totalprice) FILTER (o_totalprice > 0) AS median_duration, max(o_totalprice) FILTER (o_totalprice > 0) AS max_duration
FROM orders GROUP BY o_custkey
""")
def stability(t: Tables) -> DataFrame:
    return A.stability(t.orders.withColumn("ok", F.col("o_orderstatus") == "F"), ["o_custkey"], "ok", "o_totalprice")


@query("SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) WHEN count(DISTINCT o_orderstatus) > 1 THEN 'mixed' END AS o_orderstatus FROM orders GROUP BY o_custkey")
def single_or_mixed(t: Tables) -> DataFrame:
    return A.single_or_mixed(t.orders, ["o_custkey"], "o_orderstatus")


@query("""
WITH r AS (SELECT l.doc_id IS NOT NULL AS linked, quality, toxic FROM documents LEFT JOIN labels l USING (doc_id)),
c AS (SELECT count(*) AS candidates, count(*) FILTER (linked) AS linked, count(*) FILTER (linked) AS variables, count(*) FILTER (linked AND quality = 1) AS resolved FROM r)
SELECT *, round_even(linked / greatest(candidates, 1), 4) AS link_rate, round_even(resolved / greatest(variables, 1), 4) AS resolve_rate, linked / greatest(candidates, 1) >= 0.6 AS link_pass, resolved / greatest(variables, 1) >= 0.2 AS resolve_pass FROM c
""")
def provenance_gates(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    linked = F.col("quality").isNotNull()
    return A.gates(rows, F.lit(True), linked, linked, F.col("quality") == 1)


@query("SELECT count(*) AS rows, min(l_quantity) >= 1 AND max(l_quantity) < 2000 AS l_quantity_pass, min(l_discount) >= 0 AND max(l_discount) < 0.05 AS l_discount_pass FROM lineitem")
def range_gates(t: Tables) -> DataFrame:
    return A.range_gates(t.lineitem, {"l_quantity": (1, 2000), "l_discount": (0, 0.05)})


@query("""
SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'view') AS view_count, count(*) FILTER (event_type = 'click') AS click_count,
       count(*) FILTER (event_type = 'view')::DOUBLE / count(*) AS view_share, count(*) FILTER (event_type = 'click')::DOUBLE / count(*) AS click_share,
       CASE WHEN greatest(count(*) FILTER (event_type = 'view'), count(*) FILTER (event_type = 'click')) = 0 THEN NULL
            WHEN count(*) FILTER (event_type = 'view') > count(*) FILTER (event_type = 'click') THEN 'view' ELSE 'click' END AS dominant
FROM events GROUP BY user_id
""")
def pattern_summary(t: Tables) -> DataFrame:
    return A.pattern_summary(t.events, ["user_id"], "event_type", ["view", "click"])


@query("""
WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, list_distinct(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS urls, contains(url, '?') AS dynamic FROM pages),
u AS (SELECT host, count(DISTINCT x) AS s FROM (SELECT host, unnest(urls) AS x FROM p) GROUP BY host)
SELECT host, count(*) AS navigations, count(*) FILTER (dynamic) AS dynamic, bool_or(dynamic) AS has_dynamic, coalesce(any_value(s), 0) AS static_urls, coalesce(any_value(s), 0) + count(*) FILTER (dynamic) AS page_estimate
FROM p LEFT JOIN u USING (host) GROUP BY host
""")
def navigation_by_test(t: Tables) -> DataFrame:
    pages = t.pages.select(
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.contains("url", F.lit("?")).alias("dynamic"),
        F.array_distinct(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1))).alias("urls"),
    )
    return A.navigation_by_test(pages, ["host"])


@query("SELECT l_returnflag, count(*) AS rows, count(*) FILTER (l_tax > 0.04) AS taxed, count(*) FILTER (l_discount = 0) AS full_price FROM lineitem GROUP BY 1")
def flag_counts(t: Tables) -> DataFrame:
    return A.flag_counts(t.lineitem, ["l_returnflag"], {"taxed": F.col("l_tax") > 0.04, "full_price": F.col("l_discount") == 0})


@query("""
WITH o AS (SELECT c_mktsegment, o_orderstatus, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT c_mktsegment, count(*) AS loops, concat_ws('_and_', CASE WHEN count(*) FILTER (o_orderstatus = 'F') > 0 THEN 'direct' END, CASE WHEN count(*) FILTER (o_orderpriority = '1-URGENT') > 0 THEN 'hook' END) AS pattern FROM o GROUP BY 1
""")
def source_pattern(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    by = rows.groupBy("c_mktsegment").agg(F.count("*").alias("loops"), F.count_if(F.col("o_orderstatus") == "F").alias("d"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("h"))
    return by.select("c_mktsegment", "loops", A.source_pattern({"direct": F.col("d"), "hook": F.col("h")}).alias("pattern"))


# --- joins

@query("SELECT d.doc_id, l.quality::VARCHAR AS sm_quality, l.toxic::VARCHAR AS sm_toxic, l.doc_id IS NOT NULL AS sm_joined FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_join_blank(t: Tables) -> DataFrame:
    labels = t.labels.select("doc_id", F.col("quality").cast("string"), F.col("toxic").cast("string"))
    return J.left_join_flagged(t.documents.select("doc_id"), labels, ["doc_id"])


@query("""
SELECT count(*) FILTER (d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL) AS matched, count(*) FILTER (d.doc_id IS NOT NULL AND quality = 1) AS matched_ok,
       count(*) FILTER (l.doc_id IS NULL) AS unmatched, count(*) FILTER (d.doc_id IS NULL) AS orphan
FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id
""")
def join_coverage(t: Tables) -> DataFrame:
    return J.join_coverage(t.documents, t.labels, ["doc_id"], F.col("quality") == 1)


@query("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def fill_zero_join(t: Tables) -> DataFrame:
    counts = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    return J.join_filled(t.customer.select("c_custkey"), counts, ["c_custkey"], {"orders": 0})


@query("""
SELECT r_regionkey, n_nationkey, n_name FROM (SELECT r_regionkey, unnest([r_regionkey, (r_regionkey + 1) % 5]) AS k FROM region) JOIN nation ON n_regionkey = k
""")
def explode_attach(t: Tables) -> DataFrame:
    left = t.region.select("r_regionkey", F.array("r_regionkey", (F.col("r_regionkey") + 1) % 5).alias("ks"))
    right = t.nation.select(F.col("n_regionkey").alias("k"), "n_nationkey", "n_name")
    return J.attach_by_key_array(left, "ks", right, "k").select("r_regionkey", "n_nationkey", "n_name")


@query("""
WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, string_split(regexp_extract(url, '^https?://[^/]+/([^?]*)', 1), '/') AS path FROM pages),
h AS (SELECT host, path[1:1] AS hook, min(page_id) AS hook_id FROM p GROUP BY 1, 2)
SELECT page_id, hook_id FROM p JOIN h USING (host) WHERE list_slice(path, 1, len(hook)) = hook
""")
def path_prefix_join(t: Tables) -> DataFrame:
    pages = t.pages.select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.split(F.regexp_extract("url", "^https?://[^/]+/([^?]*)", 1), "/").alias("path"))
    hooks = pages.groupBy("host", F.slice("path", 1, 1).alias("hook")).agg(F.min("page_id").alias("hook_id"))
    return J.join_by_path_prefix(pages, "path", hooks, "hook", ["host"]).select("page_id", "hook_id")


@query("""
WITH a AS (SELECT l_returnflag AS f, count(*) AS n FROM lineitem WHERE l_shipdate < '1995-01-01' GROUP BY 1), b AS (SELECT l_returnflag AS f, count(*) AS n FROM lineitem WHERE l_shipdate >= '1995-01-01' GROUP BY 1)
SELECT coalesce(a.f, b.f) AS l_returnflag, coalesce(a.n, 0) AS old, coalesce(b.n, 0) AS new, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta, CASE WHEN coalesce(a.n, 0) <> 0 THEN (coalesce(b.n, 0) - a.n) * 100.0::DOUBLE / a.n END AS delta_pct
FROM a FULL JOIN b ON a.f = b.f
""")
def distribution_delta(t: Tables) -> DataFrame:
    before = F.col("l_shipdate") < "1995-01-01"
    return J.distribution_delta(t.lineitem.where(before), t.lineitem.where(~before), "l_returnflag")


@query("""
WITH b AS (SELECT o_custkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) AS k, o_totalprice FROM orders WHERE o_orderstatus = 'F'),
u AS (SELECT o_custkey, o_orderkey, o_orderdate FROM orders WHERE o_orderstatus <> 'F')
SELECT u.o_custkey, u.o_orderkey, max(b.o_orderdate) AS bound FROM u LEFT JOIN b ON u.o_custkey = b.o_custkey AND b.o_orderdate <= u.o_orderdate GROUP BY 1, 2
""")
def interval_binding(t: Tables) -> DataFrame:
    uses = t.orders.where("o_orderstatus <> 'F'").select("o_custkey", "o_orderkey", "o_orderdate")
    binds = t.orders.where("o_orderstatus = 'F'").select("o_custkey", "o_orderdate")
    return J.latest_binding(uses, binds.withColumn("d", F.col("o_orderdate")), ["o_custkey"], "o_orderdate", "d", "d").select("o_custkey", "o_orderkey", F.col("d").alias("bound"))


@query("""
WITH r AS (SELECT o_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(l_extendedprice - o_totalprice), l_linenumber) AS k FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT o_orderkey, l_linenumber, l_extendedprice FROM r WHERE k = 1
""")
def priority_match(t: Tables) -> DataFrame:
    lines = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    found = J.match_by_priority(t.orders.select("o_orderkey", "o_totalprice"), lines, ["o_orderkey"], F.abs(F.col("l_extendedprice") - F.col("o_totalprice")), "o_orderkey", ["l_linenumber"])
    return found.select("o_orderkey", "l_linenumber", "l_extendedprice")


@query("""
WITH x AS (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer), f AS (SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS p FROM orders GROUP BY 1)
SELECT c_custkey, coalesce(nullif(seg, ''), p) AS seg FROM x LEFT JOIN f ON o_custkey = c_custkey
""")
def fill_blanks(t: Tables) -> DataFrame:
    left = t.customer.select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"))
    right = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("seg"), "o_orderkey")
    return J.fill_blanks(left, right, ["c_custkey"], ["seg"], ["o_orderkey"])


@query("""
WITH g AS (SELECT DISTINCT p_partkey % 97 AS caller, (p_partkey * 7 + 3) % 97 AS callee FROM part),
d AS (SELECT k AS node, k % 5 AS file FROM range(97) t(k)),
h1 AS (SELECT d.node AS root, callee AS node, 1 AS depth, [d.node, callee] AS path FROM d JOIN g ON caller = d.node WHERE callee <> d.node),
h2 AS (SELECT root, callee AS node, 2 AS depth, list_append(path, callee) AS path FROM h1 JOIN g ON caller = h1.node WHERE NOT list_contains(path, callee))
SELECT root, node, depth, array_to_string(path, '>') AS path, d.file FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) h JOIN d USING (node)
""")
def call_expansion(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    calls = t.part.select((k % 97).alias("caller"), ((k * 7 + 3) % 97).alias("callee"))
    spark = calls.sparkSession
    definitions = spark.range(97).select(F.col("id").alias("node"), (F.col("id") % 5).alias("file"))
    out = J.expand_calls(calls, definitions)
    return out.select("root", "node", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "file")


# --- deduplication

@query("""
WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY text, lang, source ORDER BY doc_id) AS k FROM documents)
SELECT doc_id, lang, source FROM r WHERE k = 1
""")
def keep_first_dedupe(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "lang", "source", F.sha2("text", 256).alias("key"))
    return D.keep_first(rows, ["key", "lang", "source"], ["doc_id"]).drop("key")


@query("""
WITH r AS (SELECT doc_id, source, lang, n_chars, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS k FROM documents)
SELECT doc_id, source, lang, n_chars FROM r WHERE k = 1
""")
def keep_best_dedupe(t: Tables) -> DataFrame:
    return D.keep_best(t.documents.select("doc_id", "source", "lang", "n_chars"), ["source", "lang"], [F.col("n_chars")], ["doc_id"])


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def keep_last_load(t: Tables) -> DataFrame:
    return D.keep_last(t.events.select("user_id", "event_type", "event_id"), ["user_id"], "event_id")


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def row_dedupe(t: Tables) -> DataFrame:
    return D.dedupe_rows(t.lineitem.select("l_partkey", "l_suppkey"))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1, 2")
def navigation_dedupe(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_type", "event_id", F.when(F.col("event_type") == "view", "navigation").otherwise("other").alias("category"))
    return D.dedupe_navigation(rows, ["user_id", "event_type"], ["event_id"]).drop("category")


# --- samples and panels

@query("""
WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY md5('42|' || doc_id), doc_id) AS k FROM documents)
SELECT doc_id, lang, source FROM r WHERE k <= 3
""")
def stratified_sample(t: Tables) -> DataFrame:
    return P.stratified_sample(t.documents.select("doc_id", "lang", "source"), ["lang", "source"], ["doc_id"], 3)


@query("SELECT doc_id FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 50")
def random_sample(t: Tables) -> DataFrame:
    return P.random_sample(t.documents.select("doc_id"), ["doc_id"], 50)


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders)
SELECT o_custkey, o_orderkey, o_totalprice FROM r WHERE k <= 2
""")
def topk_per_key(t: Tables) -> DataFrame:
    return P.top_k(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 2)


@query("""
WITH q AS (SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS k, CASE lang WHEN 'en' THEN 20 WHEN 'fr' THEN 10 ELSE 0 END AS quota FROM documents)
SELECT doc_id, lang, n_chars FROM q ORDER BY k > quota, n_chars DESC, doc_id, lang LIMIT 40
""")
def quota_topk(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "lang", "n_chars")
    quotas = docs.sparkSession.createDataFrame([("en", 20), ("fr", 10)], "lang string, quota int")
    return P.quota_selection(docs, "lang", quotas, [F.desc("n_chars"), "doc_id"], 40)


@query("""
WITH d AS (SELECT doc_id, source, lang, n_chars, CASE WHEN n_chars > 2000 THEN 'complex' WHEN n_chars > 500 THEN 'middle' ELSE 'simple' END AS role FROM documents),
b AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY source, role ORDER BY n_chars, doc_id) = 1 THEN 0 ELSE 1 END AS best FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY best, role, n_chars, doc_id) AS k FROM b)
SELECT doc_id, source, role, n_chars FROM r WHERE k <= 4
""")
def role_topk(t: Tables) -> DataFrame:
    n = F.col("n_chars")
    docs = t.documents.select("doc_id", "source", F.when(n > 2000, "complex").when(n > 500, "middle").otherwise("simple").alias("role"), "n_chars")
    return P.best_per_role(docs, "source", "role", "n_chars", ["doc_id"], 4)


@query("""
WITH s AS (SELECT c_nationkey::VARCHAR AS repo, c_mktsegment AS framework, count(*) AS stable_count FROM customer WHERE c_acctbal > 5000 GROUP BY 1, 2 HAVING count(*) >= 2),
r AS (SELECT *, row_number() OVER (ORDER BY framework, stable_count DESC, repo) AS k FROM s)
SELECT repo, framework, stable_count, CASE WHEN k <= 20 THEN 'panel' ELSE 'reserve' END AS role FROM r WHERE k <= 30
""")
def stability_panel(t: Tables) -> DataFrame:
    rows = t.customer.select(F.col("c_nationkey").cast("string").alias("repo"), F.col("c_mktsegment").alias("framework"), (F.col("c_acctbal") > 5000).alias("stable"))
    return P.panel(rows, "repo", "stable", "framework", 2, 20, 10)


@query("""
WITH RECURSIVE i AS (SELECT s_suppkey, size, row_number() OVER (ORDER BY size DESC, s_suppkey) AS k FROM (SELECT s_suppkey, round((s_acctbal + 1000) * 100)::BIGINT AS size FROM supplier)),
r(k, s_suppkey, size, bin, loads) AS (
  SELECT 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::INTEGER, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]
  UNION ALL
  SELECT i.k, i.s_suppkey, i.size, (list_position(loads, list_min(loads)) - 1)::INTEGER,
         list_transform(loads, lambda x, j: CASE WHEN j = list_position(loads, list_min(loads)) THEN x + i.size ELSE x END)
  FROM r JOIN i ON i.k = r.k + 1)
SELECT s_suppkey, size, bin FROM r WHERE k > 0
""")
def bin_packing(t: Tables) -> DataFrame:
    return P.pack_bins(t.supplier.select("s_suppkey", F.round((F.col("s_acctbal") + 1000) * 100).cast("long").alias("size")), "s_suppkey", "size", 8)


# --- sets

@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def keys_in_both(t: Tables) -> DataFrame:
    return U.keys_in_both(t.customer.select(F.col("c_custkey").alias("k")), t.orders.select(F.col("o_custkey").alias("k")), ["k"])


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def keys_only_in(t: Tables) -> DataFrame:
    return U.keys_only_in(t.customer.select(F.col("c_custkey").alias("k")), t.orders.select(F.col("o_custkey").alias("k")), ["k"])


@query("SELECT DISTINCT event_type FROM events WHERE event_type NOT IN ('click', 'view', 'error')")
def taxonomy_drift(t: Tables) -> DataFrame:
    return U.unknown_labels(t.events, "event_type", ["click", "view", "error"])


# --- scalar functions and classifiers

@query("""
SELECT doc_id, substr(sha256(concat_ws('|', source, lang, doc_id::VARCHAR)), 1, 32) AS stable_id, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 12))::BIGINT % 1000 AS seed_offset FROM documents
""")
def stable_id(t: Tables) -> DataFrame:
    ident = F.col("doc_id").cast("string")
    return t.documents.select("doc_id", S.stable_id(F.col("source"), F.col("lang"), ident).alias("stable_id"), S.seed_offset(ident).cast("long").alias("seed_offset"))


@query("""
SELECT event_id, lower(trim(event_type)) || '|' || lower(trim(props)) AS signature, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), 0) AS k, json_extract_string(props, '$.k') IN ('1') AS flag FROM events
""")
def action_signature(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return t.events.select("event_id", S.action_signature(F.col("event_type"), F.col("props")).alias("signature"), S.safe_int(k).alias("k"), S.as_bool(k).alias("flag"))


@query("""
SELECT page_id, len(list_distinct(regexp_extract_all(html, '[''"`]((?:https?://|/)[^''"`\\s$]*)[''"`]', 1))) AS urls, regexp_matches(html, '[''"](?:https?://|/)[^''"]*[''"]\\s*\\+') OR regexp_matches(html, '`[^`]*\\$\\{[^`]*`') AS dynamic,
       CASE WHEN regexp_matches(lower(url), '(^|/)(__tests__|tests?|e2e|specs?|cypress)/|\\.(spec|test|cy)\\.[a-z]+$') THEN 'test' WHEN regexp_matches(lower(url), '(^|/)(dist|build|out|node_modules|coverage)/|(^|/)(package(-lock)?\\.json|yarn\\.lock|[a-z.]*config\\.[a-z]+)$') THEN 'build' ELSE 'production' END AS path_class
FROM pages
""")
def url_extract(t: Tables) -> DataFrame:
    html = F.col("html")
    return t.pages.select("page_id", F.size(S.static_urls(html)).cast("long").alias("urls"), S.has_dynamic_url(html).alias("dynamic"), S.path_class(F.col("url")).alias("path_class"))


#: A call for every rule of the classifiers, and some that no rule knows.
CALLS = [
    "page.goto('/a')", "expect(page).toHaveURL('/b') // after page.goto('/b')", "page.getByRole('button')", "el.click()", "el.fill('x')", "page.keyboard.press('Enter')",
    "el.selectOption('x')", "el.hover()", "el.dragTo(x)", "el.setInputFiles('f')", "window.scrollBy(0, 9)", "page.waitForTimeout(5)", "page.screenshot()", "foo()",
    "expect(a).toBeVisible()", "t.expect(a.exists).ok()", "expect(a).toHaveValue('1')", "expect(location.href).to.eq('/x')", "the hidden panel", "expect(a).toHaveText('b')",
    "expect(x).haveUrl('/y')", "expect(b).toHaveAttribute('c')", "expect(list).toHaveLength(2)", "expect(p).toMatchSnapshot()", "check(a11y)", "expect(response.ok())",
    "cy.request('/seed')", "cy.intercept('/api')", "page.setViewportSize(1)", "cy.clock()", "cy.fixture('u')", "afterEach(done)", "beforeAll(go)", "axios.get(u)",
    "db.seed()", "login(user)", "browser.newContext()", "cleanup()", "helper(x)", "browser.url('/z')",
]


def _calls(t: Tables) -> DataFrame:
    """event_id, name and raw: a call for each event."""
    place = (F.col("event_id") % len(CALLS) + 1).cast("int")
    return t.events.select("event_id", F.col("user_id").cast("string").alias("name"), F.element_at(F.array(*map(F.lit, CALLS)), place).alias("raw"))


_CALLS_SQL = "SELECT event_id, lower(user_id || ' ' || ([" + ", ".join("'" + c.replace("'", "''") + "'" for c in CALLS) + f"])[event_id % {len(CALLS)} + 1]) AS s FROM events"


@query(f"""
WITH s AS ({_CALLS_SQL})
SELECT event_id,
  CASE WHEN regexp_matches(s, '\\.goto\\s*\\(|\\bcy\\.visit\\s*\\(|\\bnavigateto\\s*\\(|\\bbrowser\\.url\\s*\\(') AND NOT regexp_matches(s, '\\b(tohaveurl|waitforurl)\\b') THEN 'navigation'
       WHEN contains(s, 'getby') OR contains(s, 'locator') OR contains(s, 'cy.get') OR contains(s, 'selector(') OR contains(s, 'findby') THEN 'locator_query'
       WHEN contains(s, 'click') THEN 'click' WHEN contains(s, 'fill') OR contains(s, 'type') OR contains(s, 'setvalue') THEN 'text_input'
       WHEN contains(s, 'press') OR contains(s, 'keyboard') THEN 'keyboard_input' WHEN contains(s, 'select') THEN 'selection' WHEN contains(s, 'hover') THEN 'hover'
       WHEN contains(s, 'drag') THEN 'drag_drop' WHEN contains(s, 'upload') OR contains(s, 'setinputfiles') THEN 'file_upload' WHEN contains(s, 'scroll') THEN 'scroll'
       WHEN contains(s, 'wait') THEN 'wait_synchronization' WHEN contains(s, 'screenshot') THEN 'visual_action' ELSE 'unknown_action' END AS interaction,
  CASE WHEN contains(s, 'tobevisible') OR contains(s, 'tobehidden') OR regexp_matches(s, '\\.exists\\s*\\)?\\s*\\.\\s*(not\\s*\\.\\s*)?(ok|notok)\\b') AND regexp_matches(s, '\\.exists\\s*\\.') THEN 'visibility_oracle' WHEN contains(s, 'tohavevalue') OR contains(s, 'tobenull') OR contains(s, 'tobeundefined') OR contains(s, 'tobenan') THEN 'element_state_oracle'
       WHEN regexp_matches(s, '\\.href\\b') AND regexp_matches(s, '\\b(to\\.eq|to\\.equal)|expect\\s*\\([^)]*\\.href') THEN 'url_navigation_oracle'
       WHEN regexp_matches(s, '\\b(visible|hidden)\\b') THEN 'visibility_oracle' WHEN contains(s, 'tohavetext') OR contains(s, 'contain') OR contains(s, 'gettext') THEN 'text_content_oracle'
       WHEN contains(s, 'haveurl') OR regexp_matches(s, '\\burl\\b') THEN 'url_navigation_oracle' WHEN contains(s, 'tohaveattribute') OR contains(s, 'disabled') OR contains(s, 'enabled') THEN 'element_state_oracle'
       WHEN contains(s, 'length') OR contains(s, 'count') THEN 'count_or_length_oracle' WHEN contains(s, 'snapshot') OR contains(s, 'screenshot') THEN 'visual_snapshot_oracle'
       WHEN contains(s, 'accessibility') OR contains(s, 'a11y') THEN 'accessibility_oracle' WHEN contains(s, 'response') OR contains(s, 'intercept') THEN 'network_response_oracle' WHEN contains(s, 'request') THEN 'api_state_oracle' ELSE 'generic_assertion' END AS oracle
FROM s
""")
def classify_text(t: Tables) -> DataFrame:
    return _calls(t).select("event_id", C.interaction_category(F.col("name"), F.col("raw")).alias("interaction"), C.oracle_category(F.col("name"), F.col("raw")).alias("oracle"))


@query(f"""
SELECT event_id, CASE WHEN contains(s, 'intercept') OR contains(s, 'page.route') THEN 'network_mock' WHEN contains(s, 'viewport') OR contains(s, 'setcookie') OR contains(s, 'clearcookie') THEN 'browser_context_control'
  WHEN contains(s, 'cy.clock') OR contains(s, '.clock(') THEN 'time_control' WHEN contains(s, 'fixture') AND regexp_matches(s, 'cy\\.|fixture\\(') THEN 'framework_fixture'
  WHEN regexp_matches(s, '\\bafter(each|all)?\\b') THEN 'teardown_cleanup' WHEN regexp_matches(s, '\\bbefore(each|all)?\\b') THEN 'hook_setup'
  WHEN contains(s, 'cy.request') OR contains(s, 'fetch(') OR contains(s, 'axios') THEN 'api_seed_setup' WHEN contains(s, 'database') OR contains(s, 'db.') OR contains(s, 'sequelize') THEN 'database_seed_setup'
  WHEN contains(s, 'login') OR contains(s, 'session') OR contains(s, 'auth') THEN 'auth_session_setup' WHEN contains(s, 'newcontext') OR regexp_matches(s, '\\bbrowser\\.url') THEN 'browser_context_setup'
  WHEN contains(s, 'teardown') OR contains(s, 'cleanup') THEN 'teardown_cleanup' WHEN contains(s, 'helper') THEN 'helper_setup' ELSE 'unknown_setup' END AS setup
FROM ({_CALLS_SQL})
""")
def classify_setup(t: Tables) -> DataFrame:
    return _calls(t).select("event_id", C.setup_category(F.col("name"), F.col("raw"), F.lit(""), F.lit("")).alias("setup"))


@query("""
SELECT doc_id, CASE WHEN quality IS DISTINCT FROM (n_chars > 500)::INT THEN 'quality' || CASE WHEN toxic IS DISTINCT FROM 0 THEN ';toxic' ELSE '' END WHEN toxic IS DISTINCT FROM 0 THEN 'toxic' ELSE 'match' END AS tags
FROM labels JOIN documents USING (doc_id)
""")
def mismatch_tags(t: Tables) -> DataFrame:
    rows = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id")
    pairs = {"quality": (F.col("quality"), (F.col("n_chars") > 500).cast("int")), "toxic": (F.col("toxic"), F.lit(0))}
    return rows.select("doc_id", S.mismatch_tags(pairs).alias("tags"))


@query("""
WITH o AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS b, count(*) FILTER (o_orderstatus = 'O') AS h, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1), t AS (SELECT *, b + h + p AS n FROM o)
SELECT o_custkey, CASE WHEN n = 0 THEN 'mixed_or_unclear' WHEN p > 0 AND (p * 2 >= n OR p >= b + h) THEN 'page_object_centric' WHEN h > 0 AND (h * 2 >= n OR h >= b + p) THEN 'helper_mediated'
  WHEN greatest(b, h, p) * 2 < n AND list_sort([b, h, p])[2] * 4 >= n THEN 'layered' WHEN b > 0 THEN 'inline_direct' ELSE 'mixed_or_unclear' END AS archetype FROM t
""")
def workflow_archetype(t: Tables) -> DataFrame:
    s, zero = F.col("o_orderstatus"), F.lit(0).cast("long")
    by = t.orders.groupBy("o_custkey").agg(F.count_if(s == "F").alias("b"), F.count_if(s == "O").alias("h"), F.count_if(s == "P").alias("p"))
    return by.select("o_custkey", C.workflow_archetype(F.col("b"), F.col("h"), F.col("p"), zero, zero, zero).alias("archetype"))


@query("""
WITH r AS (SELECT c_custkey, count(o_orderkey) AS n, count(*) FILTER (o_orderstatus = 'P') AS p FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT c_custkey, CASE WHEN p > 0 THEN 'abstraction_heavy' WHEN n >= 10 THEN 'complex' ELSE 'simple' END AS role,
  CASE WHEN p > 0 THEN -p WHEN n >= 10 THEN -n ELSE abs(n - 4) END AS score FROM r
""")
def candidate_roles(t: Tables) -> DataFrame:
    joined = t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left")
    by = joined.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("p"))
    zero, no = F.lit(0), F.lit(False)
    role = C.candidate_role(F.col("p"), no, F.col("n"), zero, zero)
    return by.select("c_custkey", role.alias("role"), C.candidate_score(role, F.col("n"), F.col("p"), no, zero).cast("long").alias("score"))


@query("""
WITH c AS (SELECT l_suppkey, l_shipdate, l_linenumber, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'loop_and_branch' WHEN l_returnflag = 'R' THEN 'loop' WHEN l_linestatus = 'O' THEN 'branch' ELSE 'none' END AS e FROM lineitem)
SELECT l_suppkey, count(*) AS actions, count(*) FILTER (e IN ('loop', 'loop_and_branch')) AS loop_driven, count(*) FILTER (e IN ('branch', 'loop_and_branch')) AS branch_driven,
  count(*) FILTER (e IN ('branch', 'loop_and_branch') AND l_linenumber <> 1) AS conditionalized, max(l_linenumber) AS max_loop_depth, round_even(count(*) FILTER (e IN ('branch', 'loop_and_branch') AND l_linenumber <> 1)::DOUBLE / count(*), 6) AS conditionalized_fraction FROM c GROUP BY 1
""")
def control_flow(t: Tables) -> DataFrame:
    r, o = F.col("l_returnflag") == "R", F.col("l_linestatus") == "O"
    rows = t.lineitem.select(
        "l_suppkey", F.when(r & o, "loop_and_branch").when(r, "loop").when(o, "branch").otherwise("none").alias("control_flow_enclosure"),
        F.when(F.col("l_linenumber") == 1, "try_catch").otherwise("if").alias("control_flow_branch_kind"), F.col("l_linenumber").alias("control_flow_loop_depth"),
    )
    return A.control_flow(rows, ["l_suppkey"])


@query()
def html_metrics(t: Tables) -> DataFrame:
    """Token counts by a parser; no SQL says the same, so a brute-force test holds it."""
    return t.pages.select("page_id", html_complexity(F.col("html")).alias("m")).select("page_id", "m.*")
