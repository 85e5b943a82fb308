"""The registered queries: every operator over the driver's tables, in the
query language, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import Session

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: name: (expression, SQL or None)
ALGEBRA: dict[str, tuple[str, str | None]] = {}
#: name: (function of session and folder, SQL or None)
OTHER: dict[str, tuple[Callable, str | None]] = {}


def session(spark: SparkSession, sf_dir: str) -> Session:
    s = Session(spark)
    for name in TABLES:
        s.input(name, f"{sf_dir}/{name}.parquet")
    return s


def _q(name: str, text: str, sql: str | None = None) -> None:
    ALGEBRA[name] = text, sql


def _runs(name: str, text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: session(spark, sf_dir).relation(text).df


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {k: _runs(k, text) for k, (text, _) in ALGEBRA.items()}
    for k, (f, _) in OTHER.items():
        out[k] = lambda spark, sf_dir, f=f: f(session(spark, sf_dir), sf_dir)
    return out


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in (*ALGEBRA.items(), *OTHER.items()) if sql}


FLAGSHIP = "LIMIT 10 (SORT revenue DESC (PROJECT l_returnflag, ROUND(r, 2) -> revenue (GROUP l_returnflag, SUM(l_extendedprice * (1 - l_discount)) -> r (SELECT l_quantity > 10 (lineitem)))))"

# The unary core -----------------------------------------------------------------
_q("scan", "nation", "SELECT * FROM nation")
_q("select", "σ o_totalprice > 150000 ∧ o_orderstatus = 'F' (orders)", "SELECT * FROM orders WHERE o_totalprice > 150000 AND o_orderstatus = 'F'")
_q("project", "π o_orderkey, o_totalprice * 2 → twice, o_orderstatus || '-' || o_orderpriority → code (orders)", "SELECT o_orderkey, o_totalprice * 2 AS twice, o_orderstatus || '-' || o_orderpriority AS code FROM orders")
_q("rename", "π nk, nm (ρ n(nk, nm, rk) (nation))", "SELECT n_nationkey AS nk, n_name AS nm FROM nation")
_q("distinct", "δ (π o_custkey, o_orderpriority (orders))", "SELECT DISTINCT o_custkey, o_orderpriority FROM orders")
_q("sort_limit", "λ 10 (τ o_totalprice DESC, o_orderkey ASC (orders))", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
_q("limit_offset", "LIMIT 10 OFFSET 20 (SORT o_orderkey (orders))", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20")
_q("fetch_with_ties", "OFFSET 5 ROWS FETCH NEXT 3 ROWS WITH TIES (SORT n_regionkey (nation))", "SELECT n_nationkey, n_name, n_regionkey FROM (SELECT *, rank() OVER (ORDER BY n_regionkey) r, row_number() OVER (ORDER BY n_regionkey) i FROM nation) WHERE i > 5 AND r <= 8")
_q("flagship", FLAGSHIP, "SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem WHERE l_quantity > 10 GROUP BY l_returnflag ORDER BY revenue DESC LIMIT 10")
_q("truth_relations", "(nation × UNIT) ⊎ (nation × EMPTY)", "SELECT * FROM nation")

# Joins ----------------------------------------------------------------------------
_q("natural_join", "customer ⋈ (ρ (n_nationkey → c_nationkey) (nation))", "SELECT c.*, n.n_name, n.n_regionkey FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey")
_q("join_using", "(ρ (c_nationkey → k) (customer)) JOIN USING (k) (ρ (s_nationkey → k) (supplier))", "SELECT c.c_nationkey AS k, c_custkey, c_name, c_acctbal, c_mktsegment, s_suppkey, s_name, s_acctbal FROM customer c JOIN supplier s ON c.c_nationkey = s.s_nationkey")
_q("theta_join", "π o_orderkey, c_name (orders ⨝ o_custkey = c_custkey ∧ o_totalprice > 100000 (customer))", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey AND o_totalprice > 100000")
_q("self_join", "π a.n_name, b.n_name → other ((ρ a (nation)) ⨝ a.n_regionkey = b.n_regionkey ∧ a.n_nationkey < b.n_nationkey (ρ b (nation)))", "SELECT a.n_name, b.n_name AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
_q("left_join", "π c_custkey, o_orderkey (customer ⟕ c_custkey = o_custkey ∧ o_totalprice > 250000 (orders))", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 250000")
_q("right_join", "π o_orderkey, c_custkey ((σ o_totalprice > 250000 (orders)) ⟖ o_custkey = c_custkey (customer))", "SELECT o_orderkey, c_custkey FROM (SELECT * FROM orders WHERE o_totalprice > 250000) RIGHT JOIN customer ON o_custkey = c_custkey")
_q("full_join", "π c_custkey, s_suppkey (customer ⟗ c_custkey = s_suppkey (supplier))", "SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey")
_q("semi_join", "orders ⋉ o_orderkey = l_orderkey ∧ l_quantity > 45 (lineitem)", "SELECT * FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE o_orderkey = l_orderkey AND l_quantity > 45)")
_q("anti_join", "orders ▷ o_orderkey = l_orderkey (lineitem)", "SELECT * FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE o_orderkey = l_orderkey)")
_q("universal_semi_join", "customer USEMI c_acctbal >= s_acctbal ∨ c_nationkey <> s_nationkey (supplier)", "SELECT * FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE NOT (c_acctbal >= s_acctbal OR c_nationkey <> s_nationkey))")
_EV = "SELECT {c} FROM events WHERE event_type = {t}"
_q("asof_join", "π e.event_id, e.ts, v.event_id → seen, v.ts → at ((ρ e (σ event_type = 'purchase' (events))) ASOF e.user_id = v.user_id ∧ e.ts >= v.ts (ρ v (σ event_type = 'view' (events))))", "SELECT e.event_id, e.ts, v.event_id AS seen, v.ts AS at FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON e.user_id = v.user_id AND e.ts >= v.ts")
_q("asof_inner_within", "π e.event_id, v.event_id → seen ((ρ e (σ event_type = 'purchase' (events))) ASOF INNER e.user_id = v.user_id ∧ e.ts > v.ts WITHIN DURATION 'PT6H' (ρ v (σ event_type = 'view' (events))))", "SELECT e.event_id, v.event_id AS seen FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF JOIN (SELECT * FROM events WHERE event_type = 'view') v ON e.user_id = v.user_id AND e.ts > v.ts WHERE e.ts - v.ts <= INTERVAL 6 HOUR")
_q("full_join_using", "(π o_custkey → k, o_orderkey (orders)) FJOIN USING (k) (π c_custkey → k, c_name (customer))", "SELECT coalesce(o_custkey, c_custkey) AS k, o_orderkey, c_name FROM orders FULL JOIN customer ON o_custkey = c_custkey")
_q("left_join_using", "(π o_custkey → k, o_orderkey (orders)) LJOIN USING (k) (π c_custkey → k, c_name (customer))", "SELECT o_custkey AS k, o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
_q("right_join_using", "(π o_custkey → k, o_orderkey (orders)) RJOIN USING (k) (π c_custkey → k, c_name (customer))", "SELECT c_custkey AS k, o_orderkey, c_name FROM orders RIGHT JOIN customer ON o_custkey = c_custkey")
_q("product", "(π r_name (region)) × (π n_name (nation))", "SELECT r_name, n_name FROM region, nation")
_q("interval_join", "π o_orderkey, l_orderkey, l_linenumber ((π o_orderkey, o_orderdate → os, o_orderdate + DURATION 'PT1H' → oe (orders)) IJOIN INTERSECTS (os, oe, ls, le) (π l_orderkey, l_linenumber, l_shipdate → ls, l_shipdate + DURATION 'PT1H' → le (lineitem)))", "SELECT o_orderkey, l_orderkey, l_linenumber FROM (SELECT o_orderkey, o_orderdate os, o_orderdate + INTERVAL 1 HOUR oe FROM orders) JOIN (SELECT l_orderkey, l_linenumber, l_shipdate ls, l_shipdate + INTERVAL 1 HOUR le FROM lineitem) ON os < le AND ls < oe")
_q("interval_join_during", "π a, b ((π event_id → a, ts → s, ts + DURATION 'PT1M' → e (events)) IJOIN DURING (s, e, ps, pe) (π event_id → b, ts → ps, ts + DURATION 'PT30M' → pe (events)))", "SELECT x.event_id AS a, y.event_id AS b FROM events x JOIN events y ON y.ts < x.ts AND x.ts + INTERVAL 1 MINUTE < y.ts + INTERVAL 30 MINUTE")
_ALLEN = {"OVERLAPS": "s < x AND x < e AND e < y", "OVERLAPPED_BY": "x < s AND s < y AND y < e", "CONTAINS": "s < x AND y < e", "STARTS": "s = x AND e < y", "STARTED_BY": "s = x AND y < e", "FINISHES": "e = y AND x < s", "FINISHED_BY": "e = y AND s < x", "EQUALS": "s = x AND e = y", "MEETS": "e = x", "MET_BY": "s = y", "PRECEDES": "e < x", "PRECEDED_BY": "y < s"}
for _k, _p in _ALLEN.items():
    _q(f"interval_join_{_k.lower()}", f"π a, b ((π n_nationkey → a, n_regionkey → s, n_regionkey + 1 + n_nationkey % 3 → e (nation)) IJOIN {_k} (s, e, x, y) (π n_nationkey → b, n_nationkey % 4 → x, n_nationkey % 4 + 1 + n_regionkey % 3 → y (nation)))", f"SELECT a, b FROM (SELECT n_nationkey AS a, n_regionkey AS s, n_regionkey + 1 + n_nationkey % 3 AS e FROM nation) JOIN (SELECT n_nationkey AS b, n_nationkey % 4 AS x, n_nationkey % 4 + 1 + n_regionkey % 3 AS y FROM nation) ON {_p}")
_q("similarity_join", "π a.s_suppkey, b.s_suppkey → other ((ρ a (supplier)) ⨝ EditSimilarity(a.s_name, b.s_name) >= 0.9 ∧ a.s_suppkey < b.s_suppkey (ρ b (supplier)))", "SELECT a.s_suppkey, b.s_suppkey AS other FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey AND 1 - levenshtein(a.s_name, b.s_name) / greatest(length(a.s_name), length(b.s_name)) >= 0.9")
_q("lateral", "π c.c_custkey, o_orderkey, o_totalprice ((ρ c (customer)) LATERAL (λ 2 (τ o_totalprice DESC, o_orderkey ASC (σ o_custkey = c.c_custkey (orders)))))", "SELECT c_custkey, o_orderkey, o_totalprice FROM (SELECT c_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) i FROM customer JOIN orders ON o_custkey = c_custkey) WHERE i <= 2")
_q("lateral_outer", "π c.c_custkey, o_orderkey ((ρ c (customer)) OUTER LATERAL (σ o_custkey = c.c_custkey ∧ o_totalprice > 250000 (orders)))", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 250000")

# Sets -------------------------------------------------------------------------------
_CN, _SN = "(π c_nationkey → k (customer))", "(π s_nationkey (supplier))"
_q("union", f"{_CN} ∪ {_SN}", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
_q("union_all", f"{_CN} ⊎ {_SN}", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
_q("outer_union", "(π n_nationkey → k, n_name (nation)) ⊔ (π r_regionkey → k, r_name (region))", "SELECT n_nationkey AS k, n_name, NULL AS r_name FROM nation UNION SELECT r_regionkey, NULL, r_name FROM region")
_q("intersect", f"(π o_custkey → k (orders)) ∩ (π c_custkey (σ c_acctbal < 0 (customer)))", "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal < 0")
_q("difference", "(π c_custkey → k (customer)) − (π o_custkey (orders))", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
_q("symmetric_difference", "(π c_custkey → k (customer)) ∆ (π s_suppkey (supplier))", "(SELECT c_custkey AS k FROM customer EXCEPT SELECT s_suppkey FROM supplier) UNION (SELECT s_suppkey FROM supplier EXCEPT SELECT c_custkey FROM customer)")
_q("compose", "(π c_custkey, c_nationkey → n (customer)) ∘ (π n_nationkey → n, n_name (nation))", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
_q("divide", "(π o_custkey, o_orderpriority (orders)) ÷ (π o_orderpriority (orders))", "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) = (SELECT count(DISTINCT o_orderpriority) FROM orders)")

# Groups -------------------------------------------------------------------------------
_q("group", "γ o_orderstatus, COUNT(*) → n, MIN(o_totalprice) → lo, MAX(o_totalprice) → hi, COUNT(DISTINCT o_custkey) → customers (orders)", "SELECT o_orderstatus, count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderstatus")
_q("group_all", "π n, ROUND(total, 2) → total, ROUND(mean, 4) → mean (γ COUNT(*) → n, SUM(l_quantity) → total, AVG(l_quantity) → mean (lineitem))", "SELECT count(*) AS n, round(sum(l_quantity), 2) AS total, round(avg(l_quantity), 4) AS mean FROM lineitem")
_q("group_expression", "γ YEAR(o_orderdate) → year, COUNT(*) → n (orders)", "SELECT year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY 1")
_q("rollup", "γ ROLLUP(o_orderstatus, o_orderpriority), COUNT(*) → n, GROUPING(o_orderstatus, o_orderpriority) → g (orders)", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus, o_orderpriority) AS g FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
_q("cube", "γ CUBE(l_returnflag, l_linestatus), COUNT(*) → n (lineitem)", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
_q("grouping_sets", "γ GROUPING SETS ((l_returnflag), (l_linestatus), ()), COUNT(*) → n (lineitem)", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
_q("forall", "∀ o_custkey : o_totalprice > 20000 (orders)", "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING bool_and(o_totalprice > 20000)")
_q("forall_keyless", "nation × (∀ : o_totalprice > 0 (orders))", "SELECT * FROM nation WHERE (SELECT bool_and(o_totalprice > 0) FROM orders)")
_q("top_per", "TOP 3 o_totalprice DESC, o_orderkey ASC PER o_custkey (orders)", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) i FROM orders) WHERE i <= 3")
_q("top_with_ties", "TOP 2 WITH TIES l_quantity DESC PER l_suppkey (lineitem)", "SELECT * EXCLUDE (r) FROM (SELECT *, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC) r FROM lineitem) WHERE r <= 2")
_q("top_global", "TOP 5, 10 o_totalprice DESC, o_orderkey ASC (orders)", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
_q("downsample", "DOWNSAMPLE ts BY '6h' USING COUNT PER event_type (π ts, event_type, event_id (events))", "SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts) AS bucket, count(*) AS count FROM events GROUP BY ALL")
_q("downsample_max", "DOWNSAMPLE ts BY '1d' USING MAX PER user_id (π ts, user_id, value (events))", "SELECT user_id, date_trunc('day', ts) AS bucket, max(value) AS max_value FROM events GROUP BY ALL")
_q("pivot", "PIVOT n BY o_orderstatus PER o_orderpriority (γ o_orderpriority, o_orderstatus, COUNT(*) → n (orders))", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY o_orderpriority")
_q("unpivot", "π l_orderkey, l_linenumber, what, amount (UNPIVOT (l_quantity, l_discount, l_tax) AS (what, amount) (π l_orderkey, l_linenumber, l_quantity, l_discount, l_tax (lineitem)))", "SELECT l_orderkey, l_linenumber, what, amount FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem) UNPIVOT INCLUDE NULLS (amount FOR what IN (l_quantity, l_discount, l_tax))")

# Windows ------------------------------------------------------------------------------
_q("rolling_rows", "π event_id, m (ROLLING MAX(value) OVER 7 ROWS SORT ts PER user_id AS m (events))", "SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts ROWS 6 PRECEDING) AS m FROM events")
_q("rolling_cumulative", "π event_id, n (ROLLING COUNT(value) OVER ALL ROWS SORT ts PER user_id AS n (events))", "SELECT event_id, count(value) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM events")
_q("rolling_between", "π event_id, m (ROLLING MIN(value) OVER ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING SORT ts PER user_id AS m (events))", "SELECT event_id, min(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM events")
_q("rolling_range", "π event_id, n (ROLLING COUNT(event_id) OVER RANGE BETWEEN DURATION 'PT12H' PRECEDING AND CURRENT ROW SORT ts PER user_id AS n (events))", "SELECT event_id, count(event_id) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 12 HOUR PRECEDING AND CURRENT ROW) AS n FROM events")
_q("rolling_partition", "π event_id, m (ROLLING MAX(value) OVER PARTITION PER user_id AS m (events))", "SELECT event_id, max(value) OVER (PARTITION BY user_id) AS m FROM events")
_W = "FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
for _f, _s in (("ROW_NUMBER()", "row_number()"), ("RANK()", "rank()"), ("DENSE_RANK()", "dense_rank()"), ("PERCENT_RANK()", "percent_rank()"), ("CUME_DIST()", "cume_dist()"), ("NTILE(4)", "ntile(4)"), ("LAG(o_totalprice)", "lag(o_totalprice)"), ("LEAD(o_totalprice, 2, 0)", "lead(o_totalprice, 2, 0)"), ("FIRST_VALUE(o_orderkey)", "first_value(o_orderkey)"), ("LAST_VALUE(o_orderkey)", "last_value(o_orderkey)"), ("NTH_VALUE(o_orderkey, 2)", "nth_value(o_orderkey, 2)")):
    _q(f"window_{_f.split('(')[0].lower()}", f"π o_orderkey, x (WINDOW {_f} SORT o_orderdate ASC, o_orderkey ASC PER o_custkey AS x (orders))", f"SELECT o_orderkey, {_s} OVER w AS x {_W}")
_q("sessionize", "π event_id, s (SESSIONIZE ts GAP DURATION 'PT6H' PER user_id AS s (events))", "SELECT event_id, (1 + sum(CASE WHEN gap > INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts))::BIGINT AS s FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events)")

# Nested values, graphs ---------------------------------------------------------------
_q("unnest", "UNNEST embedding WITH ORDINALITY i (π vec_id, embedding (embeddings))", "SELECT vec_id, unnest(embedding) AS embedding, generate_subscripts(embedding, 1) AS i FROM embeddings")
_q("tree", "TREE k BY p AS children ((π n_nationkey + 100 → k, n_regionkey → p (nation)) ⊎ (π r_regionkey → k, NULLIF(r_regionkey, r_regionkey) (region)))")
# edges of users to the user of the next event, for small numbers
_q("cluster", "CLUSTER a, b AS label (π o_custkey → a, nxt → b (σ nxt − o_custkey < 9 ∧ nxt > o_custkey (WINDOW LEAD(o_custkey) SORT o_orderkey AS nxt (orders))))".replace("nxt − o_custkey", "nxt - o_custkey"), "WITH RECURSIVE e0 AS (SELECT o_custkey a, nxt b FROM (SELECT *, lead(o_custkey) OVER (ORDER BY o_orderkey) nxt FROM orders) WHERE nxt - o_custkey < 9 AND nxt > o_custkey), e AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0), c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT a AS node, dense_rank() OVER (ORDER BY m) AS label FROM (SELECT a, least(a, min(b)) AS m FROM c GROUP BY a)")
# over all events: every edge, and for `closure` and `trace` one edge of each user (to the user of the event after the first)
_NEXT = "σ nxt IS NOT NULL ∧ nxt <> user_id (WINDOW LEAD(user_id) SORT ts AS nxt (events))"
_WHOLE = f"δ (π user_id → a, nxt → b ({_NEXT}))"
_SPARSE = f"π user_id → a, nxt → b (TOP 1 ts ASC PER user_id ({_NEXT}))"
_NEXT_SQL = "SELECT user_id, nxt, ts FROM (SELECT *, lead(user_id) OVER (ORDER BY ts) nxt FROM events) WHERE nxt IS NOT NULL AND nxt <> user_id"
_WHOLE_SQL = f"SELECT DISTINCT user_id AS a, nxt AS b FROM ({_NEXT_SQL})"
_SPARSE_SQL = f"SELECT user_id AS a, arg_min(nxt, ts) AS b FROM ({_NEXT_SQL}) GROUP BY user_id"
_q("closure", f"CLOSURE a, b ({_SPARSE})", f"WITH RECURSIVE e AS ({_SPARSE_SQL}), c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT a, b FROM c")
_q("closure_reflexive", f"({_WHOLE})* OVER (a, b)", f"WITH RECURSIVE e AS ({_WHOLE_SQL}), c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT a, b FROM c UNION SELECT a, a FROM e UNION SELECT b, b FROM e")
_q("closure_from", f"σ a = 3 (CLOSURE a, b ({_WHOLE}))", f"WITH RECURSIVE e AS ({_WHOLE_SQL}), c AS (SELECT a, b FROM e WHERE a = 3 UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT a, b FROM c")
_q("closure_undirected", f"CLOSURE a ↔ b ({_WHOLE})", f"WITH RECURSIVE e0 AS ({_WHOLE_SQL}), e AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0), c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT a, b FROM c")
_q("path", f"PATH a, b HOPS 1 TO 3 AS depth ({_WHOLE})", f"WITH e AS ({_WHOLE_SQL}), d AS (SELECT a, b, 1 d FROM e UNION ALL SELECT x.a, y.b, 2 FROM e x JOIN e y ON x.b = y.a UNION ALL SELECT x.a, z.b, 3 FROM e x JOIN e y ON x.b = y.a JOIN e z ON y.b = z.a) SELECT a, b, min(d) AS depth FROM d GROUP BY a, b")
_q("trace", f"π a, b, w (TRACE a, b VIA w MINIMIZE AS path (π a, b, 1 + a % 5 → w ({_SPARSE})))")
_q("fix", f"FIX r (π a, b ({_WHOLE}), π r.a, e.b (r ⨝ r.b = e.a (ρ e ({_WHOLE}))))", f"WITH RECURSIVE e AS ({_WHOLE_SQL}), c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT a, b FROM c")
_q("iterate", "ITERATE x (π n_nationkey → k, n_regionkey → v (nation), π k, v * 2 + 1 → v (x)) ROUNDS 3", "SELECT n_nationkey AS k, n_regionkey * 8 + 7 AS v FROM nation")
_q("iterate_stable", "ITERATE x (π n_nationkey → k, n_nationkey → v (nation), π k, IIf(v > 10, v - 7, v) → v (x)) UNTIL STABLE MAX 20 ROUNDS", "SELECT n_nationkey AS k, CASE WHEN n_nationkey > 10 THEN n_nationkey - 7 * CAST(ceil((n_nationkey - 10) / 7.0) AS INT) ELSE n_nationkey END AS v FROM nation")

# Draws and searches (their own invariants are tested) -----------------------------------
_q("sample", "SAMPLE 0.1 SEED 7 (orders)")
_q("sample_rows", "γ COUNT(*) → n (SAMPLE 100 ROWS SEED 7 (orders))", "SELECT 100::BIGINT AS n")
_q("shuffle", "SHUFFLE SEED 7 (nation)", "SELECT * FROM nation")
_q("roll", "γ COUNT(*) → n (λ 500 (ROLL BY n_nationkey + 1 SEED 7 (nation)))", "SELECT 500::BIGINT AS n")
_q("solve", "π l_orderkey, l_linenumber, ROUND(net, 4) → net (SOLVE net = l_extendedprice * (1 - l_discount) (π l_orderkey, l_linenumber, l_extendedprice, l_discount, NULLIF(l_tax, l_tax) → net (lineitem)))", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
_q("optimize", "OPTIMIZE MAXIMIZE SUM(v) SUBJECT TO SUM(w) <= 60 PER g (π n_regionkey → g, n_nationkey → k, 10 + (n_nationkey * 7) % 13 → v, 15 + (n_nationkey * 5) % 11 → w (nation))")
_q("cover", "COVER 2 (δ (π o_orderstatus, o_orderpriority, l_returnflag (orders ⨝ o_orderkey = l_orderkey (lineitem))))")
_q("why", "WHY (π r_name (region ⨝ r_regionkey = n_regionkey (nation)))")

# Predicates -----------------------------------------------------------------------------
_q("in_list", "σ o_orderpriority IN {'1-URGENT', '2-HIGH'} ∧ o_orderstatus ∉ {'P'} (orders)", "SELECT * FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('P')")
_q("like", "σ p_name LIKE '%a_' ∨ p_type ILIKE 'promo%' (part)", "SELECT * FROM part WHERE p_name LIKE '%a_' OR p_type ILIKE 'promo%'")
_q("regex", "σ p_name ~ '^[a-m].*e' (part)", "SELECT * FROM part WHERE regexp_matches(p_name, '^[a-m].*e')")
_q("between", "σ o_totalprice BETWEEN 1000 AND 50000 ∧ ¬ (o_orderkey BETWEEN 100 AND 9000) (orders)", "SELECT * FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 AND o_orderkey NOT BETWEEN 100 AND 9000")
_q("null_tests", "π o_orderkey (σ x = NULL ∨ x IS NOT DISTINCT FROM 3 ∨ (x > 90) IS UNKNOWN (π o_orderkey, NULLIF(o_custkey % 100, 7) → x (orders)))", "SELECT o_orderkey FROM orders WHERE nullif(o_custkey % 100, 7) IS NULL OR nullif(o_custkey % 100, 7) = 3")
_q("row_values", "σ (n_regionkey, n_nationkey) < (2, 5) (nation)", "SELECT * FROM nation WHERE (n_regionkey, n_nationkey) < (2, 5)")
_q("any_list", "σ n_regionkey = ANY {1, 3} ∧ n_nationkey >= ALL {2, 4} (nation)", "SELECT * FROM nation WHERE n_regionkey IN (1, 3) AND n_nationkey >= 4")
_q("all_subquery", "σ c_acctbal > ALL (π s_acctbal (σ s_nationkey = 3 (supplier))) (customer)", "SELECT * FROM customer WHERE c_acctbal > ALL (SELECT s_acctbal FROM supplier WHERE s_nationkey = 3)")
_q("in_subquery", "σ o_custkey IN (π c_custkey (σ c_mktsegment = 'BUILDING' (customer))) (orders)", "SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
_q("not_in_subquery", "σ o_custkey NOT IN (π c_custkey (σ c_acctbal > 0 (customer))) (orders)", "SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
_q("exists", "σ EXISTS (σ o.o_orderkey = l_orderkey ∧ l_returnflag = 'R' (lineitem)) (ρ o (orders))", "SELECT * FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE o_orderkey = l_orderkey AND l_returnflag = 'R')")
_q("scalar_subquery", "σ o_totalprice > (γ AVG(o_totalprice) → m (orders)) (orders)", "SELECT * FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")

# Functions ---------------------------------------------------------------------------
_q("f_string", "π p_partkey, UCase(p_name) → up, Len(p_name) → n, LEFT(p_name, 3) → l, RIGHT(p_name, 2) → r, MID(p_name, 2, 3) → m, InStr(p_name, 'a') → i, REPLACE(p_name, 'a', 'A') → rep, LPAD(p_brand, 12, '*') → lp, REVERSE(p_brand) → rev, SPLIT_PART(p_type, ' ', 2) → sp, CONCAT(p_brand, NULL, '!') → c, SUBSTRING('hello', 0, 3) → s, REPEAT('ab', 2) → rr, ASCII(p_name) → a (part)", "SELECT p_partkey, upper(p_name) AS up, length(p_name) AS n, left(p_name, 3) AS l, right(p_name, 2) AS r, substr(p_name, 2, 3) AS m, instr(p_name, 'a') AS i, replace(p_name, 'a', 'A') AS rep, lpad(p_brand, 12, '*') AS lp, reverse(p_brand) AS rev, split_part(p_type, ' ', 2) AS sp, p_brand || '!' AS c, 'he' AS s, 'abab' AS rr, ascii(p_name) AS a FROM part")
_q("f_regexp", "π p_partkey, REGEXP_REPLACE(p_name, '[aeiou]', '_') → first, REGEXP_REPLACE(p_name, '[aeiou]', '_', 'g') → every, REGEXP_COUNT(p_name, '[aeiou]') → n, REGEXP_LIKE(p_name, 'e$') → e (part)", "SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '_') AS first, regexp_replace(p_name, '[aeiou]', '_', 'g') AS every, len(regexp_extract_all(p_name, '[aeiou]')) AS n, regexp_matches(p_name, 'e$') AS e FROM part")
_q("f_math", "π c_custkey, ABS(c_acctbal) → a, INT(c_acctbal) → i, FIX(c_acctbal) → f, CEIL(c_acctbal) → c, SGN(c_acctbal) → s, ROUND(SQR(c_custkey), 6) → q, ROUND(LOG(c_custkey), 6) → ln, ROUND(SIN(c_custkey), 6) → sn, MOD(c_custkey, 7) → m, TRUNC(c_custkey / 7, 2) → t (σ c_custkey > 0 (customer))", "SELECT c_custkey, abs(c_acctbal) AS a, floor(c_acctbal)::BIGINT AS i, trunc(c_acctbal)::BIGINT AS f, ceil(c_acctbal)::BIGINT AS c, sign(c_acctbal) AS s, round(sqrt(c_custkey), 6) AS q, round(ln(c_custkey), 6) AS ln, round(sin(c_custkey), 6) AS sn, c_custkey % 7 AS m, trunc(c_custkey * 100 / 7) / 100 AS t FROM customer WHERE c_custkey > 0")
_q("f_datetime", "π o_orderkey, YEAR(o_orderdate) → y, MONTH(o_orderdate) → m, DAY(o_orderdate) → d, DOW(o_orderdate) → dow, ISODOW(o_orderdate) → iso, DOY(o_orderdate) → doy, WEEK(o_orderdate) → w, QUARTER(o_orderdate) → q, DATE_TRUNC('month', o_orderdate) → mon, LAST_DAY(o_orderdate) → ld, DATEDIFF('month', TIMESTAMP '1995-01-31T00:00:00Z', o_orderdate) → months, DATEADD('month', 1, o_orderdate) → next (orders)", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, dayofweek(o_orderdate) AS dow, isodow(o_orderdate) AS iso, dayofyear(o_orderdate) AS doy, week(o_orderdate) AS w, quarter(o_orderdate) AS q, date_trunc('month', o_orderdate) AS mon, last_day(o_orderdate) AS ld, date_diff('month', TIMESTAMP '1995-01-31', o_orderdate) AS months, o_orderdate + INTERVAL 1 MONTH AS next FROM orders")
_q("f_conditional", "π o_orderkey, IIf(o_totalprice > 100000, 'big', 'small') → size, CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN 2 ELSE 3 END → st, COALESCE(NULLIF(o_orderstatus, 'F'), 'none') → co, CHOOSE(o_orderkey % 3 + 1, 'a', 'b', 'c') → ch, NULLIF(o_custkey, 5) → nf (orders)", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS size, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS st, coalesce(nullif(o_orderstatus, 'F'), 'none') AS co, CASE o_orderkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS ch, nullif(o_custkey, 5) AS nf FROM orders")
_q("f_conversion", "π o_orderkey, CSTR(o_custkey) → s, CAST(o_orderkey AS STRING) → t, CINT('41') → i, CBOOL('yes') → b, FORMAT(o_custkey * 1000, 2) → f (orders)", "SELECT o_orderkey, o_custkey::VARCHAR AS s, o_orderkey::VARCHAR AS t, 41 AS i, true AS b, format('{:,.2f}', o_custkey * 1000.0) AS f FROM orders")
_q("f_hash", "π p_partkey, MD5(p_name) → m, SHA1(p_name) → s1, SHA256(p_name) → s2 (part)", "SELECT p_partkey, md5(p_name) AS m, sha1(p_name) AS s1, sha256(p_name) AS s2 FROM part")
_q("f_json", "π event_id, JSON_VALUE(props, '$.k') → k (events)", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
_q("f_similarity", "π a.n_name, b.n_name → other, Levenshtein(a.n_name, b.n_name) → d, ROUND(JaroWinkler(a.n_name, b.n_name), 6) → jw ((ρ a (nation)) × (ρ b (nation)))", "SELECT a.n_name, b.n_name AS other, levenshtein(a.n_name, b.n_name) AS d, round(jaro_winkler_similarity(a.n_name, b.n_name), 6) AS jw FROM nation a, nation b")
_q("f_ordering", "π n_nationkey, LEAST(n_nationkey, n_regionkey, 3) → l, GREATEST(n_nationkey, NULLIF(n_regionkey, 1)) → g (nation)", "SELECT n_nationkey, least(n_nationkey, n_regionkey, 3) AS l, CASE WHEN n_regionkey <> 1 THEN greatest(n_nationkey, n_regionkey) END AS g FROM nation")
_q("f_nested", "π n_nationkey, CARDINALITY([n_nationkey, n_regionkey]) → n, ARRAY_TO_STRING([n_name, NULL, 'x'], '-') → t (nation)", "SELECT n_nationkey, 2 AS n, n_name || '-x' AS t FROM nation")

# Aggregates ------------------------------------------------------------------------
_q("a_stats", "π event_type, ROUND(a, 6) → a, ROUND(b, 6) → b, ROUND(c, 6) → c, ROUND(d, 6) → d, ROUND(m, 6) → m (γ event_type, STDDEV(value) → a, STDDEV_POP(value) → b, VARIANCE(value) → c, VAR_POP(value) → d, MEDIAN(value) → m (events))", "SELECT event_type, round(stddev_samp(value), 6) AS a, round(stddev_pop(value), 6) AS b, round(var_samp(value), 6) AS c, round(var_pop(value), 6) AS d, round(median(value), 6) AS m FROM events GROUP BY event_type")
_q("a_percentile", "π event_type, ROUND(p, 6) → p, q (γ event_type, PERCENTILE_CONT(0.9) WITHIN GROUP (ORDER BY value) → p, PERCENTILE_DISC(0.25) WITHIN GROUP (ORDER BY value) → q (events))", "SELECT event_type, round(quantile_cont(value, 0.9), 6) AS p, quantile_disc(value, 0.25) AS q FROM events GROUP BY event_type")
_q("a_mode", "γ o_custkey, MODE(o_orderpriority) → m (orders)", "SELECT o_custkey, (list(o_orderpriority ORDER BY n DESC, o_orderpriority))[1] AS m FROM (SELECT o_custkey, o_orderpriority, count(*) n FROM orders GROUP BY ALL) GROUP BY o_custkey")
_q("a_bool", "γ o_custkey, BOOL_AND(o_totalprice > 1000) → b, BOOL_OR(o_orderstatus = 'P') → o (orders)", "SELECT o_custkey, bool_and(o_totalprice > 1000) AS b, bool_or(o_orderstatus = 'P') AS o FROM orders GROUP BY o_custkey")
_q("a_argmax", "γ o_custkey, ARGMAX(o_totalprice, o_orderkey) → hi, ARGMIN(o_totalprice, o_orderkey) → lo (orders)", "SELECT o_custkey, arg_max(o_orderkey, o_totalprice) AS hi, arg_min(o_orderkey, o_totalprice) AS lo FROM orders GROUP BY o_custkey")
_q("a_collect", "π o_custkey, ARRAY_TO_STRING(k, ',') → k, s (γ o_custkey, COLLECT(o_orderkey ORDER BY o_orderkey DESC) → k, STRING_AGG(DISTINCT o_orderstatus, '/' ORDER BY o_orderstatus) → s (orders))", "SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey DESC) AS k, string_agg(DISTINCT o_orderstatus, '/' ORDER BY o_orderstatus) AS s FROM orders GROUP BY o_custkey")
_q("a_filter", "γ o_custkey, COUNT(*) FILTER (WHERE o_orderstatus = 'F') → f, MAX(o_totalprice) FILTER (WHERE o_orderstatus = 'O') → m (orders)", "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, max(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS m FROM orders GROUP BY o_custkey")
# More functions
_q("f_string_more", "π p_partkey, LCase(p_name) → lo, Trim(CONCAT('  ', p_brand, ' ')) → tr, LTrim(CONCAT(' ', p_brand, ' ')) → lt, RTrim(CONCAT(' ', p_brand, ' ')) → rt, RPAD(p_brand, 10, '.') → rp, CONCAT_WS('-', p_brand, NULL, p_size) → ws, INITCAP('two small-words') → ic, STRPOS(p_name, 'w') → sp, CHARINDEX('e', p_name) → ci, CHARINDEX('e', p_name, 4) → ci4, CHR(65 + p_size % 26) → ch, ASC(p_name) → ac, InStr(3, p_name, 'l') → i3, SUBSTRING(p_name, 3) → s3, RIGHT(p_type, 0) → none (part)", "SELECT p_partkey, lower(p_name) AS lo, p_brand AS tr, p_brand || ' ' AS lt, ' ' || p_brand AS rt, rpad(p_brand, 10, '.') AS rp, p_brand || '-' || p_size AS ws, 'Two Small-Words' AS ic, strpos(p_name, 'w') AS sp, instr(p_name, 'e') AS ci, CASE WHEN instr(substr(p_name, 4), 'e') = 0 THEN 0 ELSE instr(substr(p_name, 4), 'e') + 3 END AS ci4, chr((65 + p_size % 26)::INTEGER) AS ch, ascii(p_name) AS ac, CASE WHEN instr(substr(p_name, 3), 'l') = 0 THEN 0 ELSE instr(substr(p_name, 3), 'l') + 2 END AS i3, substr(p_name, 3) AS s3, '' AS none FROM part")
_q("f_math_more", 'π c_custkey, ROUND(LOG10(c_custkey + 1), 6) → lg, ROUND(EXP(c_nationkey / 10), 6) → ex, ROUND(COS(c_custkey), 6) → co, ROUND(TAN(c_nationkey), 6) → ta, ROUND(ATN(c_custkey), 6) → at, ROUND(ASIN(c_nationkey / 25), 6) → asn, ROUND(ACOS(c_nationkey / 25), 6) → ac, ROUND(ATAN2(c_acctbal, c_nationkey), 6) → a2, ROUND(DEGREES(c_nationkey), 6) → dg, ROUND(RADIANS(c_nationkey), 6) → rd, ROUND(PI(), 6) → pi, POWER(c_nationkey, 2) → pw, RAND() >= 0 ∧ RAND() < 1 → rn, ROUND(LOG(2, c_custkey + 1), 6) → l2, TRUNC(c_acctbal) → tr (customer)', 'SELECT c_custkey, round(log10(c_custkey + 1), 6) AS lg, round(exp(c_nationkey / 10), 6) AS ex, round(cos(c_custkey), 6) AS co, round(tan(c_nationkey), 6) AS ta, round(atan(c_custkey), 6) AS at, round(asin(c_nationkey / 25), 6) AS asn, round(acos(c_nationkey / 25), 6) AS ac, round(atan2(c_acctbal, c_nationkey), 6) AS a2, round(degrees(c_nationkey), 6) AS dg, round(radians(c_nationkey), 6) AS rd, round(pi(), 6) AS pi, pow(c_nationkey, 2) AS pw, true AS rn, round(log2(c_custkey + 1), 6) AS l2, trunc(c_acctbal)::BIGINT AS tr FROM customer')
_q("f_datetime_more", "π event_id, HOUR(ts) → h, MINUTE(ts) → mi, SECOND(ts) → s, ISOYEAR(ts) → iy, FLOOR(EPOCH(ts)) → ep, TIMEZONE('+02:00', ts) → tz, MAKE_DATE(2024, 1 + event_id % 12, 15) → md, ADD_MONTHS(MAKE_DATE(2024, 1, 31), event_id % 5) → am, DATE_ADD(ts, DURATION 'P2D') → da, DATE_SUB(ts, DURATION 'PT3H') → ds, DATEDIFF('hour', TIMESTAMP '2024-01-01T00:00:00Z', ts) → dh, DATEADD('minute', 5, ts) → d5, DATE_TRUNC('hour', ts) → th (events)", "SELECT event_id, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s, isoyear(ts) AS iy, floor(epoch(ts)) AS ep, ts + INTERVAL 2 HOUR AS tz, make_date(2024, (1 + event_id % 12)::BIGINT, 15) AS md, last_day(DATE '2024-01-01' + to_months((event_id % 5)::INTEGER)) AS am, ts + INTERVAL 2 DAY AS da, ts - INTERVAL 3 HOUR AS ds, date_diff('hour', TIMESTAMP '2024-01-01', ts) AS dh, ts + INTERVAL 5 MINUTE AS d5, date_trunc('hour', ts) AS th FROM events")
_q("f_durations", "π event_id, MINUTES(ts - TIMESTAMP '2024-01-01T00:00:00Z') → mi, SECONDS(ts - TIMESTAMP '2024-01-01T00:00:00Z') → se, DAYS(ts - TIMESTAMP '2024-01-01T00:00:00Z') → da, MINUTES(DURATION 'PT90M') → lit (events)", "SELECT event_id, floor(epoch_us(ts - TIMESTAMP '2024-01-01') / 60000000.0)::BIGINT AS mi, floor(epoch_us(ts - TIMESTAMP '2024-01-01') / 1000000.0)::BIGINT AS se, floor(epoch_us(ts - TIMESTAMP '2024-01-01') / 86400000000.0)::BIGINT AS da, 90 AS lit FROM events")
_q("f_now", "π r_regionkey, NOW() > TIMESTAMP '2024-01-01T00:00:00Z' → n, CURRENT_DATE() > MAKE_DATE(2024, 1, 1) → d, Len(CURRENT_TIME()) → t, CURRENT_TIMESTAMP >= TIMESTAMP '2024-01-01T00:00:00Z' → c (region)", 'SELECT r_regionkey, true AS n, true AS d, 15 AS t, true AS c FROM region')
_q("f_parse", "π o_orderkey, to_date(TO_CHAR(o_orderdate, 'YYYY-MM-DD')) → d, to_timestamp(TO_CHAR(o_orderdate, 'YYYY-MM-DD HH24:MI:SS')) → t, to_time('07:08:09') → ti, CDbl('2.5') → cd, TO_CHAR(o_orderdate, 'DD.MM.YYYY') → ch, TO_CHAR(o_custkey, 'FM99999') → num (orders)", "SELECT o_orderkey, o_orderdate::DATE AS d, o_orderdate AS t, '07:08:09.000000' AS ti, 2.5 AS cd, strftime(o_orderdate, '%d.%m.%Y') AS ch, o_custkey::VARCHAR AS num FROM orders")
_q("f_conditional_more", "π o_orderkey, Nz(NULLIF(o_orderstatus, 'F'), 'none') → nz, Nz(NULLIF(o_orderstatus, 'F')) → ne, SWITCH(o_totalprice > 200000, 'big', o_totalprice > 100000, 'mid', 'low') → sw, SWITCH(o_orderstatus = 'F', 1) → s1, IsNull(NULLIF(o_orderstatus, 'F')) → isn, IsNumeric(o_orderpriority) → inu, IsNumeric('-1.5e3') → inv, CHOOSE(7, 'a', 'b') → no, COALESCE(NULL, o_orderstatus) → co (orders)", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'none') AS nz, coalesce(nullif(o_orderstatus, 'F'), '') AS ne, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS sw, CASE WHEN o_orderstatus = 'F' THEN 1 END AS s1, o_orderstatus = 'F' AS isn, false AS inu, true AS inv, NULL::VARCHAR AS no, o_orderstatus AS co FROM orders")
_q("f_hash_more", "π p_partkey, SHA2(p_name, 256) → a, HASHBYTES('MD5', p_name) → b, HASHBYTES('SHA1', p_name) → c, STANDARD_HASH(p_name, 'SHA256') → d, STANDARD_HASH(p_name) → e, Len(SHA2(p_name, 512)) → f (part)", 'SELECT p_partkey, sha256(p_name) AS a, md5(p_name) AS b, sha1(p_name) AS c, sha256(p_name) AS d, sha1(p_name) AS e, 128 AS f FROM part')
_q("f_json_more", "π event_id, JSON_QUERY(props, '$') → q, JSON_QUERY(props, '$.k') → none, JSON_VALUE(props, '$') → whole, CAST(JSON_EXTRACT(props, '$.k') AS STRING) → x (events)", 'SELECT event_id, \'{"k":\' || json_extract_string(props, \'$.k\') || \'}\' AS q, NULL::VARCHAR AS none, NULL::VARCHAR AS whole, json_extract_string(props, \'$.k\') AS x FROM events')
_q("f_regexp_more", "π p_partkey, REGEXP_SUBSTR(p_name, '[aeiou]+') → a, REGEXP_SUBSTR(p_name, '[aeiou]', 1, 2) → b, REGEXP_REPLACE(p_name, '[AEIOU]', '_', 'gi') → c, REGEXP_LIKE(p_name, '^[A-M]', 'i') → d (part)", "SELECT p_partkey, nullif(regexp_extract(p_name, '[aeiou]+'), '') AS a, regexp_extract_all(p_name, '[aeiou]')[2] AS b, regexp_replace(p_name, '[AEIOU]', '_', 'gi') AS c, regexp_matches(p_name, '^[A-M]', 'i') AS d FROM part")
_q("f_similarity_more", "π a.n_name, b.r_name, ROUND(Trigram(a.n_name, b.r_name), 6) → tg, ROUND(EditSimilarity(a.n_name, b.r_name), 6) → es, SOUNDEX('Robert') → sx, SOUNDEX('Pfister') → sy ((ρ a (nation)) × (ρ b (region)))", "WITH g AS (SELECT n_name, r_name, list_distinct(list_transform(range(1, length(n_name) + 2), lambda i: substr('  ' || lower(n_name) || ' ', i, 3))) AS x, list_distinct(list_transform(range(1, length(r_name) + 2), lambda i: substr('  ' || lower(r_name) || ' ', i, 3))) AS y FROM nation, region) SELECT n_name, r_name, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS tg, round(1 - levenshtein(n_name, r_name) / greatest(length(n_name), length(r_name)), 6) AS es, 'R163' AS sx, 'P236' AS sy FROM g")
_q("f_extract", 'π event_id, EXTRACT(YEAR FROM ts) → y, EXTRACT(MONTH FROM ts) → m, EXTRACT(DAY FROM ts) → d, EXTRACT(HOUR FROM ts) → h, EXTRACT(MINUTE FROM ts) → mi (events)', 'SELECT event_id, year(ts) AS y, month(ts) AS m, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi FROM events')
_q("f_at_time_zone", "π event_id, ts AT TIME ZONE '+02:00' → t (events)", 'SELECT event_id, ts + INTERVAL 2 HOUR AS t FROM events')
_q("f_collate", "π p_partkey, p_name (σ p_name COLLATE UTF8_LCASE = 'COLD WIDGET' (part))", "SELECT p_partkey, p_name FROM part WHERE lower(p_name) = 'cold widget'")
_q("f_parts", "π event_id, w.at → at, w.offset_s → off, g.months → months, tz.at → tz, tz.offset_s → tzo (π event_id, FROM_TZ(ts, '+02:00') → w, AGE(TIMESTAMP '2025-03-01T00:00:00Z', ts) → g, to_timestamptz('2024-05-06T07:08:09+02:00') → tz (events))", "SELECT event_id, ts - INTERVAL 2 HOUR AS at, 7200 AS off, datesub('month', ts, TIMESTAMP '2025-03-01') AS months, TIMESTAMP '2024-05-06 05:08:09' AS tz, 7200 AS tzo FROM events")


# Scripts, sources, provenance, streams ---------------------------------------------------
def _other(name: str, sql: str | None = None):
    def add(f):
        OTHER[name] = f, sql
        return f

    return add


@_other("script", "SELECT n_name, r_name, n_nationkey * 2 AS twice FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')")
def _script(s: Session, sf_dir: str) -> DataFrame:
    return s.script("""
        namespace demo;
        -- two regions, written out
        Wanted := [
        | r_name |
        |--------|
        | ASIA   |
        | EUROPE |
        ];
        def twice(x: NUMBER): NUMBER := { x * 2 };
        def within(k: NUMBER): relation := { σ n_nationkey < k (nation) };
        Regions := { region ⋈ Wanted };
        query { π n_name, r_name, twice(n_nationkey) → twice (within(1000) ⨝ n_regionkey = r_regionkey (Regions)) };
    """)[0][1].df


@_other("parameter", "SELECT * FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'F'")
def _parameter(s: Session, sf_dir: str) -> DataFrame:
    return s.relation("σ o_custkey = $who ∧ o_orderstatus = $status (orders)").bind(who=7, status="F").df


@_other("inline_csv", "SELECT * FROM (VALUES (1, 'a,b', DATE '2026-01-05'), (2, NULL, DATE '2026-03-12')) t(id, label, since)")
def _inline(s: Session, sf_dir: str) -> DataFrame:
    s.script('T := csv[\n id, label, since\n 1, "a,b", 2026-01-05\n 2, , 2026-03-12\n] schema { since: DATE };')
    return s.relation("T").df


@_other("generator_range", "SELECT range AS n FROM range(1, 101, 3)")
def _range(s: Session, sf_dir: str) -> DataFrame:
    s.script('source R from generator { name: "Range", lo: "1", hi: "100", step: "3" };')
    return s.relation("R").df


@_other("generator_primes", "SELECT a.range AS n FROM range(2, 1000) a WHERE NOT EXISTS (SELECT 1 FROM range(2, 32) b WHERE b.range < a.range AND a.range % b.range = 0)")
def _primes(s: Session, sf_dir: str) -> DataFrame:
    s.script('source P from generator { name: "Primes" };')
    return s.relation("σ n < 1000 (P)").df


@_other("catalog", "SELECT * FROM (VALUES ('Big'), ('orders')) t(name)")
def _catalog(s: Session, sf_dir: str) -> DataFrame:
    s.define("Big", "σ o_totalprice > 100000 (orders)")
    s.define("Counted", "γ o_custkey, COUNT(*) → n (Big)")
    return s.relation("sys.deps('Counted')").df


@_other("provenance_counting", "SELECT r_name, count(*) AS provenance FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name")
def _counting(s: Session, sf_dir: str) -> DataFrame:
    return s.relation("π r_name (region ⨝ r_regionkey = n_regionkey (nation))").provenance("counting")


@_other("provenance_tropical", "SELECT o_custkey, min(o_totalprice) AS provenance FROM orders GROUP BY o_custkey")
def _tropical(s: Session, sf_dir: str) -> DataFrame:
    from tessera.operators.provenance import Tropical

    return s.relation("π o_custkey (orders)").provenance(Tropical("o_totalprice"))


@_other("fluent", "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS hi FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey HAVING count(*) > 3")
def _fluent(s: Session, sf_dir: str) -> DataFrame:
    return s.relation("orders").select("o_orderstatus = 'F'").aggregate("o_custkey", "COUNT(*) -> n", "MAX(o_totalprice) -> hi").select("n > 3").df


def _stream(s: Session, sf_dir: str) -> DataFrame:
    kinds = s.spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return s.spark.readStream.schema(kinds).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@_other("stream_tumbling", "SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts) AS bucket, count(*) AS n FROM events GROUP BY ALL")
def _tumbling(s: Session, sf_dir: str) -> DataFrame:
    from tessera.streaming.windows import drained, tumbling

    return drained(tumbling(_stream(s, sf_dir), "ts", "6 hours", [F.count(F.lit(1)).alias("n")], ("event_type",)))


@_other("stream_sliding", "SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts) - to_hours(6 * i) AS bucket, count(*) AS n FROM events, (VALUES (0), (1)) t(i) GROUP BY ALL")
def _sliding(s: Session, sf_dir: str) -> DataFrame:
    from tessera.streaming.windows import drained, tumbling

    return drained(tumbling(_stream(s, sf_dir), "ts", "12 hours", [F.count(F.lit(1)).alias("n")], ("event_type",), slide="6 hours"))


@_other("stream_sessions", "SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM (SELECT *, sum(CASE WHEN gap > INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events)) GROUP BY user_id, k")
def _sessions(s: Session, sf_dir: str) -> DataFrame:
    from tessera.streaming.windows import drained, sessions

    return drained(sessions(_stream(s, sf_dir), "ts", "6 hours", [F.count(F.lit(1)).alias("n")], ("user_id",)))


# Invariants of what has more than one right answer, and parts of nested results ------------
_q("tree_sizes", "π k, CARDINALITY(children) → n (TREE k BY p AS children ((π n_nationkey + 100 → k, n_regionkey → p (nation)) ⊎ (π r_regionkey → k, NULLIF(r_regionkey, r_regionkey) (region))))", "SELECT r_regionkey AS k, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS n FROM region")
_q("tree_children", "π k, children.k → child (UNNEST children (TREE k BY p AS children ((π n_nationkey + 100 → k, n_regionkey → p (nation)) ⊎ (π r_regionkey → k, NULLIF(r_regionkey, r_regionkey) (region)))))", "SELECT n_regionkey AS k, n_nationkey + 100 AS child FROM nation")
_TRIPLES = "δ (π o_orderstatus, o_orderpriority, l_returnflag (orders ⨝ o_orderkey = l_orderkey (lineitem)))"
for _i, (_x, _y) in enumerate((("o_orderstatus", "o_orderpriority"), ("o_orderstatus", "l_returnflag"), ("o_orderpriority", "l_returnflag"))):
    _q(f"cover_pairs_{_i + 1}", f"δ (π {_x}, {_y} (COVER 2 ({_TRIPLES})))", f"SELECT DISTINCT {_x}, {_y} FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
_q("cover_is_of_the_input", f"(COVER 2 ({_TRIPLES})) − ({_TRIPLES})", "SELECT o_orderstatus, o_orderpriority, l_returnflag FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE false")
_q("sample_all", "SAMPLE 1 SEED 7 (nation)", "SELECT * FROM nation")
_q("sample_share", "π w (σ n > 0.08 * t ∧ n < 0.12 * t ((π n, 1 → w (γ COUNT(*) → n (SAMPLE 0.1 SEED 7 (lineitem)))) × (γ COUNT(*) → t (lineitem))))", "SELECT 1 AS w")
_q("sample_is_of_the_input", "(SAMPLE 0.1 SEED 7 (orders)) − (orders)", "SELECT * FROM orders WHERE false")
_q("sample_rows_once", "γ COUNT(*) → n, COUNT(DISTINCT o_orderkey) → k (SAMPLE 100 ROWS SEED 7 (orders))", "SELECT 100 AS n, 100 AS k")
# Sets of rows by enumeration: the best sum, then the fewest rows, then the earliest.
ALGEBRA["optimize"] = ALGEBRA["optimize"][0], """
WITH r AS (SELECT n_regionkey AS g, n_nationkey AS k, 10 + (n_nationkey * 7) % 13 AS v, 15 + (n_nationkey * 5) % 11 AS w, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation),
m AS (SELECT DISTINCT g, range AS mask FROM r, range(32)),
f AS (SELECT m.g, mask, coalesce(sum(v), 0) AS v, coalesce(sum(w), 0) AS w, count(k) AS n, coalesce(string_agg(i, ',' ORDER BY i), '') AS places FROM m LEFT JOIN r ON r.g = m.g AND (mask >> i) & 1 = 1 GROUP BY m.g, mask),
b AS (SELECT g, mask FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY v DESC, n, places) AS o FROM f WHERE w <= 60) WHERE o = 1)
SELECT r.g, r.k, r.v, r.w FROM r JOIN b ON r.g = b.g AND (mask >> i) & 1 = 1
"""


@_other("why_terms", "SELECT r_name, 'nation' AS relation, n_nationkey AS k FROM region JOIN nation ON r_regionkey = n_regionkey UNION ALL SELECT r_name, 'region', r_regionkey FROM region JOIN nation ON r_regionkey = n_regionkey")
def _why(s: Session, sf_dir: str) -> DataFrame:
    df = s.relation("WHY (π r_name (region ⨝ r_regionkey = n_regionkey (nation)))").df
    terms = df.select("r_name", F.explode("provenance").alias("t")).select("r_name", F.explode("t.variables").alias("v"))
    key = F.coalesce(F.get_json_object("v.columns", "$.n_nationkey"), F.get_json_object("v.columns", "$.r_regionkey"))
    return terms.select("r_name", F.col("v.relation").alias("relation"), key.cast("int").alias("k"))


@_other("provenance_boolean", "SELECT DISTINCT r_name, true AS provenance FROM region JOIN nation ON r_regionkey = n_regionkey")
def _boolean(s: Session, sf_dir: str) -> DataFrame:
    return s.relation("π r_name (region ⨝ r_regionkey = n_regionkey (nation))").provenance("boolean")


@_other("provenance_security", "SELECT p_type, min(CASE p_brand WHEN 'Brand#1' THEN 0 WHEN 'Brand#2' THEN 1 WHEN 'Brand#3' THEN 2 ELSE 3 END) AS provenance FROM part GROUP BY p_type")
def _security(s: Session, sf_dir: str) -> DataFrame:
    from tessera.operators.provenance import Security

    return s.relation("π p_type (part)").provenance(Security(("Brand#1", "Brand#2", "Brand#3", "Brand#4"), "p_brand"))


@_other("provenance_routes", "WITH w AS (SELECT o_custkey, min(o_totalprice) AS cost FROM orders GROUP BY o_custkey) SELECT o_custkey, cost, (SELECT count(*) FROM orders o WHERE o.o_custkey = w.o_custkey AND o_totalprice = cost) AS ways FROM w")
def _routes(s: Session, sf_dir: str) -> DataFrame:
    from tessera.operators.provenance import Routes

    df = s.relation("π o_custkey (orders)").provenance(Routes("o_totalprice"))
    return df.select("o_custkey", F.col("provenance.cost").alias("cost"), F.size("provenance.routes").alias("ways"))


@_other("provenance_lineage", "SELECT r_name, count(*) AS terms FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name")
def _lineage(s: Session, sf_dir: str) -> DataFrame:
    df = s.relation("π r_name (region ⨝ r_regionkey = n_regionkey (nation))").provenance("lineage")
    return df.select("r_name", F.size("provenance").alias("terms"))


def _written(s: Session, df: DataFrame, kind: str, **options) -> str:
    """A folder of text files that a source reads back, in the shared folder."""
    import uuid

    from tessera.operators.components import checkpoint_dir

    path = f"{checkpoint_dir(s.spark)}/tessera-{uuid.uuid4().hex}.{kind}"
    df.write.options(**options).format({"csv": "csv", "tsv": "csv", "jsonl": "json", "log": "text"}[kind]).save(path)
    return path


@_other("source_csv", "SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part WHERE p_size > 10")
def _csv(s: Session, sf_dir: str) -> DataFrame:
    path = _written(s, s.spark.read.parquet(f"{sf_dir}/part.parquet").drop("p_retailprice"), "csv", header=True)
    return s.input("Parts", path, kind="csv").relation("σ p_size > 10 (Parts)").df


@_other("source_tsv_declared", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _tsv(s: Session, sf_dir: str) -> DataFrame:
    path = _written(s, s.spark.read.parquet(f"{sf_dir}/nation.parquet"), "tsv", header=True, sep="\t")
    return s.input("Nations", path, kind="tsv", schema={"n_nationkey": "NUMBER", "n_name": "STRING", "n_regionkey": "NUMBER"}).relation("Nations").df


@_other("source_jsonl", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def _jsonl(s: Session, sf_dir: str) -> DataFrame:
    path = _written(s, s.spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey"), "jsonl")
    return s.input("Orders", path, kind="jsonl").relation("γ o_custkey, COUNT(*) → n (Orders)").df


@_other("source_log", "SELECT '10.0.0.' || user_id AS host, count(*) AS n, max(date_trunc('second', ts)) AS last FROM events GROUP BY ALL")
def _log(s: Session, sf_dir: str) -> DataFrame:
    events = s.spark.read.parquet(f"{sf_dir}/events.parquet")
    line = F.format_string('10.0.0.%d - - [%s +0000] "GET /%s HTTP/1.1" 200 17', "user_id", F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), "event_type")
    folder, _, name = _written(s, events.select(line.alias("value")), "log").rpartition("/")
    s.script(f'connection logs from log {{ path: "{folder}", format: "common" }}; source A from logs {{ table: "{name}", schema: {{ host: STRING, at: TIMESTAMP, status: NUMBER }} }};')
    return s.relation("γ host, COUNT(*) → n, MAX(at) → last (A)").df


_q("f_entries", "π event_id, CARDINALITY(ENTRIES(FROM_TZ(ts, '+02:00'))) → n (events)", "SELECT event_id, 2 AS n FROM events")
