"""Registered queries: a dialect text for each operator, and the SQL that checks it.

Where the dialect's meaning is standard SQL the same text is the check; elsewhere the check spells out the meaning.
The test tables hold no NULL, so nullif() brings some in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans import statements
from millrace.session import Session
from millrace.sources.files import parquet_table
from millrace.streaming.windows import windowed

SAME = object()

FLAGSHIP = """
SELECT n.n_name AS n_name, max(o.o_totalprice) AS max_price, count(*) AS n_orders, group_concat(DISTINCT c.c_mktsegment) AS segments
FROM customer c, orders o, nation n
WHERE c.c_custkey = o.o_custkey AND c.c_nationkey = n.n_nationkey
GROUP BY n.n_nationkey, n.n_name HAVING count(*) > 5 ORDER BY upper(n.n_name)
"""
_NUL = "(SELECT n_nationkey AS k, nullif(n_regionkey, 2) AS a, nullif(n_nationkey % 4, 1) AS b, nullif(n_name, 'NATION_3') AS s FROM nation)"

#: name: (dialect text, check), with SAME where the text checks itself
TEXTS: dict[str, tuple[str, object]] = {
    # scans
    "sc1_table_scan": ("SELECT o_orderkey, o_totalprice FROM orders", SAME),
    "sc2_aliased_scan": ("SELECT x.c_name AS c_name FROM customer AS x", SAME),
    "sc3_one_row": ("SELECT 1 AS one, 'a' AS letter", SAME),
    "sc4_empty": ("SELECT nothing FROM SYSTEM.EmptyRowTable", "SELECT CAST(1 AS INTEGER) AS nothing WHERE false"),
    "sc5_range_scan": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 10 AND l_quantity < 20 AND l_quantity <> 15", SAME),
    "sc6_ordered_scan": ("SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey", SAME),
    "sc7_nested_source": ("SELECT d.o_custkey AS o_custkey, d.n AS n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) d WHERE d.n > 12", SAME),
    # projection and filters
    "pr1_projection": ("SELECT l_orderkey, l_linenumber, l_quantity * 2 AS twice FROM lineitem", SAME),
    "pr2_star": ("SELECT * FROM region", SAME),
    "pr3_qualified_star": ("SELECT n.*, r.r_name AS r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey", SAME),
    "pr4_alias": ("SELECT p_name product, p_size AS size_of FROM part", SAME),
    "pr6_select_all": ("SELECT ALL o_orderstatus FROM orders", SAME),
    "pr7_distinct": ("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", SAME),
    "fi1_filter": ("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_discount >= 0.05 AND l_tax < 0.02 OR l_quantity = 50", SAME),
    "fi3_static_filter": ("SELECT r_name FROM region WHERE 1 = 1 AND 'a' <> 'b'", SAME),
    "fi4_having": ("SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > 50", SAME),
    "ex1_equal_null": (f"SELECT k, a = b AS same FROM {_NUL} t", f"SELECT k, a IS NOT DISTINCT FROM b AS same FROM {_NUL} t"),
    "ex2_not_equal": (f"SELECT k FROM {_NUL} t WHERE a <> b", f"SELECT k FROM {_NUL} t WHERE a IS DISTINCT FROM b"),
    "ex3_bang_equal": (f"SELECT k FROM {_NUL} t WHERE a != 1", f"SELECT k FROM {_NUL} t WHERE a IS DISTINCT FROM 1"),
    "ex4_order_of_null": (
        f"SELECT k, a < b AS lt, a <= b AS le, a > b AS gt, a >= b AS ge, a < 3 AS lit FROM {_NUL} t",
        f"SELECT k, coalesce(a < b, a IS NULL AND b IS NOT NULL) AS lt, coalesce(a <= b, a IS NULL) AS le, coalesce(a > b, a IS NOT NULL AND b IS NULL) AS gt, coalesce(a >= b, b IS NULL) AS ge, coalesce(a < 3, true) AS lit FROM {_NUL} t",
    ),
    "ex4_filter_null": (f"SELECT k FROM {_NUL} t WHERE a < 3", f"SELECT k FROM {_NUL} t WHERE a < 3 OR a IS NULL"),
    "ex5_is": (f"SELECT k, a IS NULL AS n, a IS NOT b AS d FROM {_NUL} t", f"SELECT k, a IS NULL AS n, a IS DISTINCT FROM b AS d FROM {_NUL} t"),
    "ex6_boolean": (
        f"SELECT k FROM {_NUL} t WHERE NOT (a = 1 OR b = 2) AND NOT (s LIKE 'NATION_1%')",
        f"SELECT k FROM {_NUL} t WHERE a IS DISTINCT FROM 1 AND b IS DISTINCT FROM 2 AND NOT coalesce(s LIKE 'NATION_1%', false)",
    ),
    "ex7_between": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 5 AND 10 AND l_discount NOT BETWEEN 0.02 AND 0.08", SAME),
    "ex8_like": ("SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1-%' OR o_orderpriority NOT LIKE '%O_%'", SAME),
    "ex8_like_escapes": (
        "SELECT k, s LIKE 'a\\%%' AS a, s LIKE '_\\__' AS b, s LIKE '' AS c, s NOT LIKE '%x' AS d, s LIKE 'a%' AS e FROM (SELECT 1 AS k, 'a%b' AS s UNION ALL SELECT 2, 'a_b' UNION ALL SELECT 3, '' UNION ALL SELECT 4, 'axx' UNION ALL SELECT 5, NULL) t",
        "SELECT k, s LIKE 'a\\%%' ESCAPE '\\' AS a, s LIKE '_\\__' ESCAPE '\\' AS b, s LIKE '' AS c, s NOT LIKE '%x' AS d, s LIKE 'a%' AS e FROM (SELECT 1 AS k, 'a%b' AS s UNION ALL SELECT 2, 'a_b' UNION ALL SELECT 3, '' UNION ALL SELECT 4, 'axx' UNION ALL SELECT 5, NULL) t",
    ),
    "ex9_regex": ("SELECT c_custkey FROM customer WHERE c_name REGEX '1[0-4]$' AND NOT (c_mktsegment REGEX '^B')", "SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '1[0-4]$') AND NOT regexp_matches(c_mktsegment, '^B')"),
    "ex10_arithmetic": (
        "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) + l_tax - 1 AS net, l_extendedprice / l_quantity AS unit FROM lineitem",
        "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) + l_tax - 1 AS net, round(l_extendedprice / l_quantity, 10) AS unit FROM lineitem",
    ),
    "ex10_exact": (
        "SELECT n_nationkey AS k, CAST(n_nationkey / 3.0 AS NUMERIC(38,10)) AS a, CAST(1 / 3.0 AS NUMERIC(38,10)) AS b, CAST((n_nationkey + 0.1) * 0.2 AS NUMERIC(38,10)) AS c, CAST(2 / 3 AS NUMERIC(38,10)) AS d, CAST(n_nationkey / nullif(n_nationkey, 0) AS NUMERIC(38,10)) AS e, CAST(n_nationkey / 0 AS NUMERIC(38,10)) AS f, CAST(CAST(n_nationkey AS NUMERIC) / 7 AS NUMERIC(38,10)) AS g, CAST(CAST(0.1 AS NUMERIC) + CAST(0.2 AS NUMERIC) AS NUMERIC(38,10)) AS h FROM nation",
        "SELECT n_nationkey AS k, CAST(round(n_nationkey / 3, 10) AS DECIMAL(38,10)) AS a, CAST(0.3333333333 AS DECIMAL(38,10)) AS b, CAST(n_nationkey * 0.2 + 0.02 AS DECIMAL(38,10)) AS c, CAST(0.6666666667 AS DECIMAL(38,10)) AS d, CASE WHEN n_nationkey > 0 THEN CAST(1 AS DECIMAL(38,10)) END AS e, CAST(NULL AS DECIMAL(38,10)) AS f, CAST(round(n_nationkey / 7, 10) AS DECIMAL(38,10)) AS g, CAST(0.3 AS DECIMAL(38,10)) AS h FROM nation",
    ),
    "ex11_minus": ("SELECT n_nationkey, n_nationkey-1 AS less, -n_nationkey AS neg FROM nation", SAME),
    "ex12_concat_sign": ("SELECT n_nationkey, n_name || '/' || n_regionkey AS label FROM nation", SAME),
    "ex13_literals": ("SELECT 1.5 AS x, 'it''s' AS y, TRUE AS z", "SELECT CAST(1.5 AS DECIMAL(2,1)) AS x, 'it''s' AS y, true AS z"),
    "ex16_case": ("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'low' END AS band, coalesce(nullif(o_orderstatus, 'F'), '-') AS st FROM orders", SAME),
    "ex18_comments": ("SELECT r_name -- a comment\nFROM region // another\n", "SELECT r_name FROM region"),
    # subqueries
    "sq1_in": ("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)", SAME),
    "sq2_not_in": (f"SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT a FROM {_NUL} t)", f"SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM {_NUL} t WHERE t.a IS NOT DISTINCT FROM c.c_nationkey)"),
    "sq3_any": ("SELECT p_partkey FROM part WHERE p_retailprice < ANY (SELECT p_retailprice FROM part WHERE p_size > 45)", SAME),
    "sq3_some_equal": ("SELECT s_suppkey FROM supplier WHERE s_nationkey = SOME (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)", SAME),
    "sq4_all": ("SELECT p_partkey FROM part WHERE p_retailprice > ALL (SELECT p_retailprice FROM part WHERE p_size < 5)", SAME),
    "sq4_all_empty": ("SELECT n_nationkey FROM nation WHERE n_nationkey >= ALL (SELECT n_nationkey FROM nation WHERE n_nationkey < 0)", SAME),
    "sq5_in_list": (f"SELECT k FROM {_NUL} t WHERE a IN (0, 1) OR b NOT IN (2, 3)", f"SELECT k FROM {_NUL} t WHERE a IN (0, 1) OR b NOT IN (2, 3) OR b IS NULL"),
    "sq5_any_list": ("SELECT n_nationkey FROM nation WHERE n_nationkey > ANY (20, 22) AND n_nationkey <> ALL (23, 24)", "SELECT n_nationkey FROM nation WHERE n_nationkey > 20 AND n_nationkey NOT IN (23, 24)"),
    "sq6_exists": ("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')", SAME),
    "sq7_not_exists": ("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)", SAME),
    "sq8_correlated_all": ("SELECT p_partkey FROM part p WHERE p_retailprice >= ALL (SELECT x.p_retailprice FROM part x WHERE x.p_brand = p.p_brand)", SAME),
    "sq8_under_or": ("SELECT c_custkey FROM customer c WHERE c_acctbal < 0 OR NOT (c_custkey IN (SELECT o_custkey FROM orders))", SAME),
    "sq9_scalar": ("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT max(o_totalprice) FROM orders) - 10000", SAME),
    # joins
    "jo1_comma_join": ("SELECT c.c_name AS c_name, n.n_name AS n_name FROM customer c, nation n WHERE c.c_nationkey = n.n_nationkey", SAME),
    "jo2_inner_join": ("SELECT o.o_orderkey AS o_orderkey, c.c_name AS c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey", SAME),
    "jo3_left_join": ("SELECT c.c_custkey AS c_custkey, o.o_orderkey AS o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 250000 AND c.c_acctbal > 0", SAME),
    "jo4_right_join": ("SELECT n.n_name AS n_name, s.s_name AS s_name FROM supplier s RIGHT OUTER JOIN nation n ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000", SAME),
    "jo5_full_join": ("SELECT a.n_nationkey AS x, b.r_regionkey AS y FROM nation a FULL OUTER JOIN region b ON a.n_nationkey = b.r_regionkey + 22", SAME),
    "jo6_cartesian": ("SELECT r.r_name AS r_name, n.n_name AS n_name FROM region r, nation n", SAME),
    "jo7_null_keys": (f"SELECT x.k AS xk, y.k AS yk FROM {_NUL} x JOIN {_NUL} y ON x.a = y.b", f"SELECT x.k AS xk, y.k AS yk FROM {_NUL} x JOIN {_NUL} y ON x.a IS NOT DISTINCT FROM y.b"),
    "jo8_theta_join": ("SELECT n.n_nationkey AS n_nationkey, r.r_regionkey AS r_regionkey FROM nation n JOIN region r ON n.n_nationkey > r.r_regionkey * 5", SAME),
    "jo9_multi_key_join": ("SELECT a.l_orderkey AS k, a.l_linenumber AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND b.l_quantity > 48", SAME),
    "jo10_complex_join": ("SELECT s.s_suppkey AS s_suppkey, n.n_nationkey AS n_nationkey FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey OR s.s_suppkey = n.n_regionkey", SAME),
    "jo11_expression_keys": ("SELECT n.n_name AS n_name, r.r_name AS r_name FROM nation n JOIN region r ON n.n_regionkey + 1 = r.r_regionkey * 1", SAME),
    "jo12_self_join": ("SELECT a.n_name AS x, b.n_name AS y FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", SAME),
    "jo14_semi_anti": ("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 2)", SAME),
    "jo16_using": ("SELECT k, a.x AS x, b.y AS y FROM (SELECT n_nationkey AS k, n_name AS x FROM nation) a LEFT JOIN (SELECT s_nationkey AS k, s_name AS y FROM supplier WHERE s_acctbal > 0) b USING (k)", SAME),
    "jo16_natural": ("SELECT k, x, y FROM (SELECT n_nationkey AS k, n_name AS x FROM nation) a NATURAL INNER JOIN (SELECT s_nationkey AS k, s_name AS y FROM supplier) b", "SELECT k, x, y FROM (SELECT n_nationkey AS k, n_name AS x FROM nation) a NATURAL JOIN (SELECT s_nationkey AS k, s_name AS y FROM supplier) b"),
    "jo16_using_cross": ("SELECT n_nationkey, r_regionkey FROM nation CROSS JOIN region WHERE n_regionkey = r_regionkey", SAME),
    # aggregates
    "ag1_group_by": (
        "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(CAST(l_quantity AS DECIMAL(18,4))) AS qty FROM lineitem GROUP BY l_returnflag, l_linestatus",
        "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DECIMAL(28,4)) AS qty FROM lineitem GROUP BY l_returnflag, l_linestatus",
    ),
    "ag1_group_expression": ("SELECT o_custkey % 7 AS k, count(*) AS n FROM orders GROUP BY o_custkey % 7", SAME),
    "ag2_global": ("SELECT count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders", SAME),
    "ag3_representative": ("SELECT n.n_name AS n_name, count(*) AS c FROM nation n, customer c WHERE n.n_nationkey = c.c_nationkey GROUP BY n.n_nationkey", "SELECT any_value(n.n_name) AS n_name, count(*) AS c FROM nation n, customer c WHERE n.n_nationkey = c.c_nationkey GROUP BY n.n_nationkey"),
    "ag4_of_expressions": ("SELECT l_returnflag, max(l_quantity * l_tax) AS m, count(l_orderkey) + 1 AS n1 FROM lineitem GROUP BY l_returnflag", SAME),
    "ag5_count_star": ("SELECT count(*) AS n FROM lineitem", SAME),
    "ag6_count": (f"SELECT a, count(b) AS n FROM {_NUL} t GROUP BY a", SAME),
    "ag7_count_distinct": ("SELECT l_returnflag, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag", SAME),
    "ag8_min_max": ("SELECT o_orderpriority, min(o_orderdate) AS first_day, max(o_orderdate) AS last_day FROM orders GROUP BY o_orderpriority", SAME),
    "ag9_sum": ("SELECT c_mktsegment, sum(c_nationkey) AS s FROM customer GROUP BY c_mktsegment", "SELECT c_mktsegment, CAST(sum(c_nationkey) AS BIGINT) AS s FROM customer GROUP BY c_mktsegment"),
    "ag9_sum_exact": (
        "SELECT c_mktsegment, CAST(sum(CAST(c_acctbal AS NUMERIC)) AS NUMERIC(38,10)) AS s, CAST(sum(0.1) AS NUMERIC(38,10)) AS t, CAST(sum(DISTINCT CAST(c_nationkey AS NUMERIC) / 4) AS NUMERIC(38,10)) AS q FROM customer GROUP BY c_mktsegment",
        "SELECT c_mktsegment, CAST(sum(CAST(c_acctbal AS DECIMAL(28,10))) AS DECIMAL(38,10)) AS s, CAST(sum(0.1) AS DECIMAL(38,10)) AS t, CAST(sum(DISTINCT c_nationkey * 0.25) AS DECIMAL(38,10)) AS q FROM customer GROUP BY c_mktsegment",
    ),
    "ag17_rollup": (
        "SELECT o_orderstatus AS st, o_orderpriority AS pr, count(*) AS n FROM orders GROUP BY ROLLUP(o_orderstatus, o_orderpriority)",
        "SELECT o_orderstatus AS st, o_orderpriority AS pr, count(*) AS n FROM orders GROUP BY ROLLUP(o_orderstatus, o_orderpriority)",
    ),
    "ag17_statistics": ("SELECT l_returnflag, round(stddev(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, median(l_quantity) AS md, bool_and(l_quantity > 0) AS b FROM lineitem GROUP BY l_returnflag", SAME),
    "ag10_avg": ("SELECT l_returnflag, avg(l_linenumber) AS a FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(avg(l_linenumber), 10) AS a FROM lineitem GROUP BY l_returnflag"),
    "ag11_group_concat": (
        f"SELECT a, group_concat(s ORDER BY s) AS names FROM {_NUL} t GROUP BY a",
        f"SELECT a, coalesce(string_agg(s, ', ' ORDER BY s), '') AS names FROM {_NUL} t GROUP BY a",
    ),
    "ag11_group_concat_several": (
        "SELECT n_regionkey AS r, group_concat(n_name, n_nationkey ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey AS r, string_agg(n_name || ', ' || n_nationkey, ', ' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey",
    ),
    "ag12_distinct_aggregates": ("SELECT l_linestatus, sum(DISTINCT l_linenumber) AS s, max(DISTINCT l_quantity) AS m FROM lineitem GROUP BY l_linestatus", "SELECT l_linestatus, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s, max(DISTINCT l_quantity) AS m FROM lineitem GROUP BY l_linestatus"),
    "ag13_all": ("SELECT count(ALL o_orderkey) AS n FROM orders", "SELECT count(o_orderkey) AS n FROM orders"),
    "ag15_order_by_aggregate": ("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY count(*) DESC, o_custkey", SAME),
    "flagship_group_select": (FLAGSHIP, FLAGSHIP.replace("group_concat(DISTINCT c.c_mktsegment)", "string_agg(DISTINCT c.c_mktsegment, ', ' ORDER BY c.c_mktsegment)")),
    "win_rank": ("SELECT o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r, lag(o_orderkey, 1) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders", SAME),
    "win_sums": ("SELECT l_orderkey AS k, l_linenumber AS n, sum(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s, max(l_quantity) OVER (PARTITION BY l_orderkey) AS m FROM lineitem", "SELECT l_orderkey AS k, l_linenumber AS n, CAST(sum(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS s, max(l_quantity) OVER (PARTITION BY l_orderkey) AS m FROM lineitem"),
    # sort, limit, sets
    "so1_order_by": ("SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey ASC", SAME),
    "so4_order_by_alias": ("SELECT s_suppkey AS k, s_acctbal * 2 AS v FROM supplier ORDER BY v, k", SAME),
    "so4_order_by_ordinal": ("SELECT s_acctbal AS v, s_suppkey AS k FROM supplier ORDER BY 1 DESC, 2 LIMIT 9", SAME),
    "so5_nulls_first_last": (f"SELECT k FROM {_NUL} t ORDER BY a NULLS LAST, k DESC LIMIT 21", SAME),
    "so5_nulls_lowest": (f"SELECT k FROM {_NUL} t ORDER BY a, k LIMIT 5", f"SELECT k FROM {_NUL} t ORDER BY a NULLS FIRST, k LIMIT 5"),
    "so6_limit": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5", SAME),
    "set_union": ("SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey + 3 AS k FROM region", SAME),
    "set_intersect_except": ("SELECT n_nationkey AS k FROM nation INTERSECT SELECT r_regionkey AS k FROM region EXCEPT SELECT 2 AS k", SAME),
    # scalar functions
    "f1_f2_abs_sign": ("SELECT s_suppkey, abs(s_acctbal - 5000) AS a, sign(s_acctbal - 5000) AS s FROM supplier", "SELECT s_suppkey, abs(s_acctbal - 5000) AS a, CAST(sign(s_acctbal - 5000) AS INTEGER) AS s FROM supplier"),
    "f3_mod": ("SELECT n_nationkey, mod(n_nationkey - 12, 5) AS m, mod(n_nationkey, nullif(n_nationkey, 3)) AS z FROM nation WHERE n_nationkey > 0", "SELECT n_nationkey, (n_nationkey - 12) % 5 AS m, n_nationkey % nullif(n_nationkey, 3) AS z FROM nation WHERE n_nationkey > 0"),
    "f4_round": ("SELECT p_partkey, round(p_retailprice) AS a, round(p_retailprice, 1) AS b, round(p_retailprice, -2) AS c FROM part", SAME),
    "f5_pow": ("SELECT n_nationkey, pow(n_nationkey, 2.9) AS p FROM nation", "SELECT n_nationkey, pow(CAST(n_nationkey AS DOUBLE), 2) AS p FROM nation"),
    "f6_sqrt": ("SELECT p_partkey, round(sqrt(p_retailprice), 8) AS q FROM part", SAME),
    "f7_f8_least_greatest": (
        f"SELECT k, least(a, b, 2) AS l, greatest(a, b) AS g FROM {_NUL} t",
        f"SELECT k, CASE WHEN a IS NULL OR b IS NULL THEN NULL ELSE least(a, b, 2) END AS l, CASE WHEN a IS NULL OR b IS NULL THEN NULL ELSE greatest(a, b) END AS g FROM {_NUL} t",
    ),
    "f9_f10_case": ("SELECT c_custkey, lower(c_mktsegment) AS l, upper(c_name) AS u FROM customer", SAME),
    "f11_concat": (f"SELECT k, concat(s, '-', a) AS c FROM {_NUL} t", SAME),
    "f12_f15_lengths": ("SELECT p_partkey, length(p_name) AS l, char_length(p_type) AS c, bit_length(p_brand) AS b FROM part", "SELECT p_partkey, CAST(length(p_name) AS INTEGER) AS l, CAST(length(p_type) AS INTEGER) AS c, CAST(8 * strlen(p_brand) AS INTEGER) AS b FROM part"),
    "f16_trim": (
        "SELECT n_nationkey, trim(BOTH 'NA' FROM n_name) AS b, trim(TRAILING '0' FROM n_name) AS t, trim(concat('  ', n_name, ' ')) AS d FROM nation",
        "SELECT n_nationkey, regexp_replace(n_name, '^(NA)+|(NA)+$', '', 'g') AS b, rtrim(n_name, '0') AS t, n_name AS d FROM nation",
    ),
    "f17_f18_side_trims": ("SELECT ltrim('  a ') AS l, rtrim(' a  ') AS r", SAME),
    "f19_substring": ("SELECT c_custkey, substring(c_name, 0, 4) AS a, substring(c_name, 10) AS b, substring(c_name, 3, -1) AS c FROM customer", "SELECT c_custkey, substring(c_name, 1, 4) AS a, substring(c_name, 10) AS b, '' AS c FROM customer"),
    "f20_if": (f"SELECT k, if(a = b, 'same', 'other') AS w FROM {_NUL} t", f"SELECT k, CASE WHEN a IS NOT DISTINCT FROM b THEN 'same' ELSE 'other' END AS w FROM {_NUL} t"),
    "f21_operator_names": ("SELECT n_nationkey, add_sql(n_nationkey, 1) AS x, and_sql(gt_sql(n_nationkey, 3), not_sql(eq_sql(n_regionkey, 1))) AS y FROM nation", "SELECT n_nationkey, n_nationkey + 1 AS x, n_nationkey > 3 AND NOT n_regionkey = 1 AS y FROM nation"),
    "f21_all_operator_names": (
        "SELECT n_nationkey AS k, sub_sql(mul_sql(n_nationkey, 3), 1) AS a, CAST(div_sql(n_nationkey, 2.0) AS NUMERIC(38,10)) AS b, or_sql(lt_sql(n_nationkey, 3), gte_sql(n_nationkey, 20)) AS c, lte_sql(n_nationkey, 4) AS d, neq_sql(n_regionkey, 1) AS e, is_sql(n_regionkey, 2) AS f, isn_sql(n_regionkey, 2) AS g, like_sql(n_name, 'NATION_1%') AS h, nlike_sql(n_name, '%2') AS i FROM nation",
        "SELECT n_nationkey AS k, n_nationkey * 3 - 1 AS a, CAST(n_nationkey * 0.5 AS DECIMAL(38,10)) AS b, n_nationkey < 3 OR n_nationkey >= 20 AS c, n_nationkey <= 4 AS d, n_regionkey <> 1 AS e, n_regionkey = 2 AS f, n_regionkey <> 2 AS g, n_name LIKE 'NATION_1%' AS h, n_name NOT LIKE '%2' AS i FROM nation",
    ),
    "f22_all_set_names": (
        "SELECT n_nationkey FROM nation WHERE anylt_sql(n_nationkey, (SELECT r_regionkey FROM region)) AND allneq_sql(n_nationkey, (SELECT r_regionkey FROM region WHERE r_regionkey > 2)) AND allgte_sql(n_nationkey, (SELECT r_regionkey FROM region WHERE r_regionkey < 1)) AND anylte_sql(n_nationkey, (SELECT r_regionkey FROM region)) AND alllt_sql(n_nationkey, (SELECT r_regionkey + 5 FROM region))",
        "SELECT n_nationkey FROM nation WHERE n_nationkey < ANY (SELECT r_regionkey FROM region) AND n_nationkey <> ALL (SELECT r_regionkey FROM region WHERE r_regionkey > 2)",
    ),
    "f24_cast_forms": (
        "SELECT n_nationkey AS k, CAST('2001-12-22 10:11:12.345' AS TIMESTAMP) AS t1, CAST('2001-12-22 10:11:12' AS TIMESTAMP) AS t2, CAST('nothing' AS TIMESTAMP) AS t3, CAST(n_name AS VARCHAR(3)) AS s, CAST(123456 AS VARCHAR(3)) AS o, CAST('true' AS BOOLEAN) AS b, CAST('12.345' AS NUMERIC(6,2)) AS d FROM nation",
        "SELECT n_nationkey AS k, TIMESTAMP '2001-12-22 10:11:12.345' AS t1, TIMESTAMP '2001-12-22 10:11:12' AS t2, CAST(NULL AS TIMESTAMP) AS t3, substring(n_name, 1, 3) AS s, CAST(NULL AS VARCHAR) AS o, true AS b, CAST(12.35 AS DECIMAL(6,2)) AS d FROM nation",
    ),
    "f3_mod_double": ("SELECT n_nationkey AS k, mod(CAST(n_nationkey AS DOUBLE), 0) AS z, mod(CAST(n_nationkey AS DOUBLE), 4) AS m FROM nation", "SELECT n_nationkey AS k, CAST('nan' AS DOUBLE) AS z, CAST(n_nationkey % 4 AS DOUBLE) AS m FROM nation"),
    "f22_set_names": ("SELECT s_suppkey FROM supplier WHERE anyeq_sql(s_nationkey, (SELECT n_nationkey FROM nation WHERE n_regionkey = 2))", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)"),
    "f24_cast": (
        "SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS BOOLEAN) AS b, CAST(l_linenumber AS VARCHAR(3)) AS s, CAST(l_returnflag AS NUMERIC) AS n, CAST('2001-12-22' AS TIMESTAMP) AS t, CAST(l_linestatus AS BOOLEAN) AS f FROM lineitem",
        "SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 0 THEN false WHEN 1 THEN true END AS b, CAST(l_linenumber AS VARCHAR) AS s, TRY_CAST(l_returnflag AS DECIMAL(29,10)) AS n, TIMESTAMP '2001-12-22' AS t, CAST(NULL AS BOOLEAN) AS f FROM lineitem",
    ),
}
PARAMETERS = {
    "ex14_marker_parameter": ("SELECT c_name, c_acctbal FROM customer WHERE c_custkey = ? OR c_name = ?", [7, "Customer#000000003"], "SELECT c_name, c_acctbal FROM customer WHERE c_custkey = 7 OR c_name = 'Customer#000000003'"),
    "ex15_named_parameter": ("SELECT o_orderkey FROM orders WHERE o_totalprice > :least", {"least": 400000}, "SELECT o_orderkey FROM orders WHERE o_totalprice > 400000"),
}


def _text(text: str, params=None) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Session(spark, sf_dir).sql(text, params)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Session(spark, sf_dir).sql(FLAGSHIP)


def _reader_tables(spark: SparkSession, sf_dir: str) -> Session:
    """A schema of its own, selected by SET SCHEMA."""
    s = Session(spark, sf_dir)
    for table in ("customer", "orders", "part"):
        s.register(table, parquet_table(spark, sf_dir, table), schema="test")
    s.sql("SET SCHEMA test")
    return s


def _set_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reader_tables(spark, sf_dir).sql("SELECT c.c_name AS c_name, o.o_orderdate AS o_orderdate FROM customer c, orders o WHERE c.c_custkey = o.o_custkey AND c.c_acctbal > 5000")


def _dml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE, INSERT with defaults, UPDATE, DELETE in one transaction, then COMMIT."""
    s = Session(spark, sf_dir)
    s.sql("CREATE TABLE IF NOT EXISTS kept (k INTEGER NOT NULL PRIMARY KEY, name VARCHAR(20), note VARCHAR(10) DEFAULT 'new')")
    s.sql("SET AUTO COMMIT OFF; INSERT INTO kept (k, name) SELECT n_nationkey, n_name FROM nation; UPDATE kept SET note = 'old' WHERE k > 10; DELETE FROM kept WHERE k >= 20; COMMIT")
    return s.sql("SELECT k, name, note FROM kept")


def _columns_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(spark, sf_dir)
    s.sql("CREATE TABLE shape (a INTEGER NOT NULL, b VARCHAR(5), c TIMESTAMP)")
    return s.sql("SELECT column_name, column_type, not_null, seq_no FROM SYSTEM.TableColumns WHERE table_name = 'shape'")


def _user_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(spark, sf_dir)
    s.add_function("DETERMINISTIC NUMERIC plus_tax(NUMERIC, NUMERIC?)", lambda x, rate=0.5: None if x is None else x * (1 + rate))
    return s.sql("SELECT n_nationkey, plus_tax(n_nationkey) AS a, plus_tax(n_nationkey, 1) AS b FROM nation")


def _user_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(spark, sf_dir)
    s.add_function("NUMERIC spread(NUMERIC)", lambda x: float(x.max() - x.min()), aggregate=True)
    return s.sql("SELECT n_regionkey, spread(n_nationkey) AS width FROM nation GROUP BY n_regionkey")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed(parquet_table(spark, sf_dir, "events"))


OTHERS: dict[str, tuple[Callable, str | None]] = {
    "d10_set_schema": (_set_schema, "SELECT c.c_name AS c_name, o.o_orderdate AS o_orderdate FROM customer c, orders o WHERE c.c_custkey = o.o_custkey AND c.c_acctbal > 5000"),
    "d1_d6_ddl_dml": (_dml, "SELECT n_nationkey AS k, n_name AS name, CASE WHEN n_nationkey > 10 THEN 'old' ELSE 'new' END AS note FROM nation WHERE n_nationkey < 20"),
    "sc9_columns_table": (_columns_table, "SELECT * FROM (VALUES ('a', 'int', true, 0), ('b', 'string', false, 1), ('c', 'timestamp_ntz', false, 2)) t(column_name, column_type, not_null, seq_no)"),
    "u2_user_function": (_user_function, "SELECT n_nationkey, n_nationkey * CAST(1.5 AS DOUBLE) AS a, n_nationkey * CAST(2 AS DOUBLE) AS b FROM nation"),
    "u2_user_aggregate": (_user_aggregate, "SELECT n_regionkey, CAST(max(n_nationkey) - min(n_nationkey) AS DOUBLE) AS width FROM nation GROUP BY n_regionkey"),
    "ext_event_windows": (_events, "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events GROUP BY 1, 2"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {k: _text(t) for k, (t, _) in TEXTS.items()}
    out |= {k: _text(t, p) for k, (t, p, _) in PARAMETERS.items()}
    return out | {k: f for k, (f, _) in OTHERS.items()} | statements.queries()


def oracle_sql() -> dict[str, str]:
    out = {k: t if check is SAME else check for k, (t, check) in TEXTS.items()}
    out |= {k: check for k, (_, _, check) in PARAMETERS.items()}
    return out | {k: check for k, (_, check) in OTHERS.items() if check} | statements.oracle_sql()
