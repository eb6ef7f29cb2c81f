"""Named queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pathloom import dbapi
from pathloom.lang.errors import GraphError
from pathloom.lang.parser import parse
from pathloom.session import Session
from pathloom.sources.tables import shop_graph

ROUTE = """
  select k as a, (k + 1) % 25 as b, cast(((k * 5 + ((k + 1) % 25) * 3) % 11) + 1 as double) as cost from (select cast(n_nationkey as bigint) as k from nation)
  union all
  select k, (7 * k + 3) % 25, cast(((k * 5 + ((7 * k + 3) % 25) * 3) % 11) + 1 as double) from (select cast(n_nationkey as bigint) as k from nation)
"""
R = f"with recursive route as ({ROUTE})"


def _walk(most: int) -> str:
    """Distinct (root, node, n) of walks of at most ``most`` hops."""
    return f"""{R}, walk(root, node, n) as (
      select cast(n_nationkey as bigint), cast(n_nationkey as bigint), 0 from nation
      union select w.root, r.b, w.n + 1 from walk w join route r on w.node = r.a where w.n < {most})"""


def _paths(most: int) -> str:
    """All walks (root, node, n, cost, costs, ids) of at most ``most`` hops."""
    return f"""{R}, walk(root, node, n, cost, costs, ids) as (
      select cast(n_nationkey as bigint), cast(n_nationkey as bigint), 0, cast(0 as double), cast([] as double[]), cast([] as bigint[]) from nation
      union all select w.root, r.b, w.n + 1, w.cost + r.cost, list_append(w.costs, r.cost), list_append(w.ids, r.a * 64 + r.b)
      from walk w join route r on w.node = r.a where w.n < {most})"""


#: name: (query, SQL)
QUERIES: dict[str, tuple[str, str]] = {
    # patterns
    "vertex_scan": ("SELECT c.c_custkey AS k, c.c_name AS name FROM MATCH (c:Customer)", "select c_custkey as k, c_name as name from customer"),
    "label_alt": ("SELECT x.c_custkey AS c, x.s_suppkey AS s FROM MATCH (x:Customer|Supplier)", "select c_custkey as c, cast(null as bigint) as s from customer union all select null, s_suppkey from supplier"),
    "edge_out": ("SELECT c.c_name AS customer, o.o_totalprice AS total FROM MATCH (c:Customer)-[e:placed]->(o:Purchase) WHERE o.o_totalprice > 200000", "select c_name as customer, o_totalprice as total from customer join orders on c_custkey = o_custkey where o_totalprice > 200000"),
    "edge_in": ("SELECT o.o_orderkey AS o, c.c_nationkey AS n FROM MATCH (o:Purchase)<-[:placed]-(c:Customer)", "select o_orderkey as o, c_nationkey as n from orders join customer on c_custkey = o_custkey"),
    "edge_any": ("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM MATCH (a:Nation)-[:route]-(b:Nation)", f"with route as ({ROUTE}) select cast(a as integer) as a, cast(b as integer) as b from route union all select cast(b as integer), cast(a as integer) from route where a <> b"),
    "two_hop": ("SELECT p.p_brand AS brand, c.c_mktsegment AS segment, o.o_orderkey AS o FROM MATCH (c:Customer)-[:placed]->(o:Purchase)-[i:contains]->(p:Part) WHERE i.quantity > 45", "select p_brand as brand, c_mktsegment as segment, o_orderkey as o from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey where l_quantity > 45"),
    "cycle_close": ("SELECT c.c_custkey AS c, s.s_suppkey AS s, o.o_orderkey AS o FROM MATCH (n:Nation)<-[:lives_in]-(c:Customer)-[:placed]->(o:Purchase)-[:shipped_by]->(s:Supplier)-[:based_in]->(n)", "select c_custkey as c, s_suppkey as s, o_orderkey as o from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey and s_nationkey = c_nationkey"),
    "disconnected_cross": ("SELECT r.r_name AS r, n.n_name AS n FROM MATCH (r:Region), MATCH (n:Nation)", "select r_name as r, n_name as n from region, nation"),
    "multi_match": ("SELECT c.c_custkey AS c, n.n_name AS n, o.o_orderkey AS o FROM MATCH (c:Customer)-[:lives_in]->(n:Nation), MATCH (c)-[:placed]->(o) WHERE o.o_orderstatus = 'F'", "select c_custkey as c, n_name as n, o_orderkey as o from customer join nation on n_nationkey = c_nationkey join orders on o_custkey = c_custkey where o_orderstatus = 'F'"),
    "repeated_var": ("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM MATCH ((a:Nation)-[:route]->(b:Nation), (b)-[:route]->(a))", f"with route as ({ROUTE}) select cast(x.a as integer) as a, cast(x.b as integer) as b from route x join route y on x.a = y.b and x.b = y.a"),
    "homomorphism": ("SELECT a.n_nationkey AS a, b.n_nationkey AS b, c.n_nationkey AS c FROM MATCH (a:Nation)-[:route]-(b:Nation)-[:route]-(c:Nation)", f"with route as ({ROUTE}), ways as (select a, b from route union all select b, a from route where a <> b) select cast(x.a as integer) as a, cast(x.b as integer) as b, cast(y.b as integer) as c from ways x join ways y on x.b = y.a"),
    "anon_elements": ("SELECT o.o_orderkey AS o FROM MATCH (:Customer)-[:placed]->(o)-[:contains]->(:Part)", "select l_orderkey as o from lineitem"),
    "abbreviated_edge": ("SELECT n.n_name AS n, r.r_name AS r FROM MATCH (n:Nation)->(r:Region)", "select n_name as n, r_name as r from nation join region on r_regionkey = n_regionkey"),
    "on_graph": ("SELECT r.r_name AS r FROM MATCH (r:Region) ON shop", "select r_name as r from region"),
    "edge_equality": ("SELECT a.n_nationkey AS a, e1 = e2 AS same FROM MATCH (a:Nation)-[e1:route]->(b:Nation), MATCH (a)-[e2:route]->(c:Nation)", f"with route as ({ROUTE}) select cast(x.a as integer) as a, x.b = y.b as same from route x join route y on x.a = y.a"),
    # expressions
    "where_cmp_num": ("SELECT l.line AS line, l.quantity AS q FROM MATCH (o:Purchase)-[l:contains]->(p:Part) WHERE l.quantity >= 49 AND l.discount < 0.05 AND p.p_size <> 7", "select l_linenumber as line, l_quantity as q from lineitem join part on p_partkey = l_partkey where l_quantity >= 49 and l_discount < 0.05 and p_size <> 7"),
    "where_cmp_str": ("SELECT c.c_custkey AS k FROM MATCH (c:Customer) WHERE c.c_mktsegment >= 'F' AND c.c_mktsegment != 'MACHINERY'", "select c_custkey as k from customer where c_mktsegment >= 'F' and c_mktsegment <> 'MACHINERY'"),
    "where_cmp_date": ("SELECT o.o_orderkey AS k FROM MATCH (o:Purchase) WHERE o.o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND CAST(o.o_orderdate AS DATE) < DATE '1996-03-01'", "select o_orderkey as k from orders where o_orderdate >= timestamp '1996-01-01' and cast(o_orderdate as date) < date '1996-03-01'"),
    "where_null": ("SELECT COUNT(*) AS n FROM MATCH (x:Customer|Supplier) WHERE x.c_acctbal > 0 OR x.nothing = 1", "select count(*) as n from customer where c_acctbal > 0"),
    "logic_and_or_xor_not": ("SELECT p.p_partkey AS k FROM MATCH (p:Part) WHERE (p.p_size > 40 XOR p.p_retailprice > 1500) AND NOT p.p_size = 3 OR p.p_size = 1", "select p_partkey as k from part where ((p_size > 40) <> (p_retailprice > 1500)) and not p_size = 3 or p_size = 1"),
    "arith_int": ("SELECT p.p_partkey * 3 + p.p_size - 7 AS v FROM MATCH (p:Part)", "select p_partkey * 3 + p_size - 7 as v from part"),
    "arith_float": ("SELECT p.p_partkey AS k, p.p_retailprice * 2 - 1e0 AS v FROM MATCH (p:Part)", "select p_partkey as k, p_retailprice * 2 - 1 as v from part"),
    "arith_decimal": ("SELECT p.p_partkey AS k, CAST(p.p_size * 1.25 + 0.5 AS DOUBLE) AS v FROM MATCH (p:Part)", "select p_partkey as k, p_size * 1.25::double + 0.5::double as v from part"),
    "int_div_mod": ("SELECT p.p_partkey AS k, (p.p_size - 25) / 4 AS q, (p.p_size - 25) % 4 AS r FROM MATCH (p:Part)", "select p_partkey as k, cast((p_size - 25) // 4 as bigint) as q, cast((p_size - 25) % 4 as bigint) as r from part"),
    "unary_minus": ("SELECT -s.s_suppkey AS k, -(-s.s_acctbal) AS b FROM MATCH (s:Supplier)", "select -s_suppkey as k, s_acctbal as b from supplier"),
    "concat": ("SELECT n.n_name || '/' || n.n_nationkey AS v FROM MATCH (n:Nation)", "select n_name || '/' || n_nationkey as v from nation"),
    "date_plus_interval": ("SELECT o.o_orderkey AS k, CAST(o.o_orderdate AS DATE) + INTERVAL 1 MONTH AS m, CAST(o.o_orderdate AS DATE) - INTERVAL 3 DAY AS d, o.o_orderdate + INTERVAL 90 MINUTE AS t FROM MATCH (o:Purchase)", "select o_orderkey as k, cast(cast(o_orderdate as date) + interval 1 month as date) as m, cast(cast(o_orderdate as date) - interval 3 day as date) as d, o_orderdate + interval 90 minute as t from orders"),
    "time_wrap": ("SELECT r.r_regionkey AS k, CAST(TIME '23:30:00' + INTERVAL 45 MINUTE AS STRING) AS t, TIME '12:00:00+02:00' = TIME '10:00:00+00:00' AS same FROM MATCH (r:Region)", "select r_regionkey as k, '00:15:00' as t, true as same from region"),
    "literals": ("SELECT r.r_regionkey AS k, DATE '2017-01-01' AS d, TIMESTAMP '2017-01-01 12:34:56' AS t, TRUE AS b, 'it''s' AS s, 0777 AS i FROM MATCH (r:Region)", "select r_regionkey as k, date '2017-01-01' as d, timestamp '2017-01-01 12:34:56' as t, true as b, 'it''s' as s, cast(777 as bigint) as i from region"),
    # functions
    "fn_lower_upper": ("SELECT LOWER(n.n_name) AS l, UPPER(n.n_name) AS u FROM MATCH (n:Nation)", "select lower(n_name) as l, upper(n_name) as u from nation"),
    "fn_regexp": ("SELECT c.c_custkey AS k FROM MATCH (c:Customer) WHERE JAVA_REGEXP_LIKE(c.c_name, '#0*[1-9]7$')", "select c_custkey as k from customer where regexp_matches(c_name, '#0*[1-9]7$')"),
    "fn_abs_ceil_floor": ("SELECT c.c_custkey AS k, ABS(c.c_acctbal) AS a, CEIL(c.c_acctbal) AS c, CEILING(c.c_acctbal) AS c2, FLOOR(c.c_acctbal) AS f FROM MATCH (c:Customer)", "select c_custkey as k, abs(c_acctbal) as a, ceil(c_acctbal) as c, ceil(c_acctbal) as c2, floor(c_acctbal) as f from customer"),
    "fn_substring": ("SELECT c.c_custkey AS k, SUBSTRING(c.c_name FROM 10) AS a, SUBSTRING(c.c_name FROM 1 FOR 4) AS b FROM MATCH (c:Customer)", "select c_custkey as k, substring(c_name, 10) as a, substring(c_name, 1, 4) as b from customer"),
    "fn_extract": ("SELECT o.o_orderkey AS k, EXTRACT(YEAR FROM o.o_orderdate) AS y, EXTRACT(MONTH FROM o.o_orderdate) AS m, EXTRACT(DAY FROM o.o_orderdate) AS d, EXTRACT(HOUR FROM o.o_orderdate) AS h FROM MATCH (o:Purchase)", "select o_orderkey as k, year(o_orderdate) as y, month(o_orderdate) as m, day(o_orderdate) as d, hour(o_orderdate) as h from orders"),
    "fn_extract_zone": ("SELECT r.r_regionkey AS k, EXTRACT(TIMEZONE_HOUR FROM TIME '10:00:00-07:30') AS h, EXTRACT(TIMEZONE_MINUTE FROM TIME '10:00:00-07:30') AS m FROM MATCH (r:Region)", "select r_regionkey as k, cast(-7 as bigint) as h, cast(-30 as bigint) as m from region"),
    "fn_cast": ("SELECT p.p_partkey AS k, CAST(p.p_size AS STRING) AS s, CAST(p.p_retailprice AS INTEGER) AS i, CAST(CAST(p.p_size AS STRING) AS DOUBLE) AS d, CAST('true' AS BOOLEAN) AS b FROM MATCH (p:Part)", "select p_partkey as k, cast(p_size as varchar) as s, cast(trunc(p_retailprice) as bigint) as i, cast(p_size as double) as d, true as b from part"),
    "fn_case_simple": ("SELECT c.c_custkey AS k, CASE c.c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END AS v FROM MATCH (c:Customer)", "select c_custkey as k, cast(case c_mktsegment when 'BUILDING' then 1 when 'MACHINERY' then 2 else 0 end as bigint) as v from customer"),
    "fn_case_searched": ("SELECT c.c_custkey AS k, CASE WHEN c.c_acctbal < 0 THEN 'debt' WHEN c.c_acctbal > 5000 THEN 'rich' END AS v FROM MATCH (c:Customer)", "select c_custkey as k, case when c_acctbal < 0 then 'debt' when c_acctbal > 5000 then 'rich' end as v from customer"),
    "in_list": ("SELECT p.p_partkey AS k FROM MATCH (p:Part) WHERE p.p_size IN (1, 2, 3)", "select p_partkey as k from part where p_size in (1, 2, 3)"),
    "not_in_list": ("SELECT p.p_partkey AS k FROM MATCH (p:Part) WHERE p.p_brand NOT IN ('Brand#11', 'Brand#12')", "select p_partkey as k from part where p_brand not in ('Brand#11', 'Brand#12')"),
    "is_null": ("SELECT COUNT(*) AS n FROM MATCH (x:Customer|Supplier|Part) WHERE x.c_name IS NULL AND x.p_size IS NOT NULL", "select count(*) as n from part"),
    "fn_label": ("SELECT LABEL(x) AS l, COUNT(*) AS n FROM MATCH (x:Customer|Supplier) GROUP BY l", "select 'Customer' as l, count(*) as n from customer union all select 'Supplier', count(*) from supplier"),
    "fn_has_label": ("SELECT COUNT(*) AS n FROM MATCH (x:Customer|Supplier|Nation) WHERE HAS_LABEL(x, 'supplier') OR HAS_LABEL(x, 'Nation')", "select (select count(*) from supplier) + (select count(*) from nation) as n"),
    "fn_id": ("SELECT a.n_nationkey AS a, ID(a) = ID(b) AS same FROM MATCH (a:Nation)-[:route]->(b:Nation)", f"with route as ({ROUTE}) select cast(a as integer) as a, a = b as same from route"),
    "fn_in_degree": ("SELECT n.n_nationkey AS k, IN_DEGREE(n) AS d FROM MATCH (n:Nation)", f"with route as ({ROUTE}), ends as (select b as k from route union all select c_nationkey from customer union all select s_nationkey from supplier) select n_nationkey as k, count(ends.k) as d from nation left join ends on ends.k = n_nationkey group by n_nationkey"),
    "fn_out_degree": ("SELECT o.o_orderkey AS k FROM MATCH (o:Purchase) WHERE OUT_DEGREE(o) > 12", "select l_orderkey as k from lineitem group by l_orderkey having 2 * count(*) > 12"),
    "fn_all_different": ("SELECT a.n_nationkey AS a, b.n_nationkey AS b, c.n_nationkey AS c FROM MATCH (a:Nation)-[:route]->(b:Nation)-[:route]->(c:Nation) WHERE ALL_DIFFERENT(a, b, c)", f"with route as ({ROUTE}) select cast(x.a as integer) as a, cast(x.b as integer) as b, cast(y.b as integer) as c from route x join route y on x.b = y.a where x.a <> x.b and x.a <> y.b and x.b <> y.b"),
    "fn_element_number": ("SELECT ELEMENT_NUMBER(c) AS c, ELEMENT_NUMBER(e) AS e, ELEMENT_NUMBER(n) AS n FROM MATCH (c:Customer)-[e:lives_in]->(n:Nation)", "select cast(1 as bigint) as c, cast(2 as bigint) as e, cast(3 as bigint) as n from customer"),
    # the table of regions is one file in the order of its keys
    "fn_match_number": ("SELECT r.r_regionkey AS k, MATCH_NUMBER(r) AS m FROM MATCH (r:Region) WHERE MATCH_NUMBER(r) > 2 ORDER BY m DESC", "select r_regionkey as k, cast(r_regionkey + 1 as bigint) as m from region where r_regionkey + 1 > 2 order by m desc"),
    "fn_match_number_distinct": ("SELECT COUNT(DISTINCT MATCH_NUMBER(c)) AS d, COUNT(*) AS n, COUNT(DISTINCT MATCH_NUMBER(o) - MATCH_NUMBER(c)) AS same FROM MATCH (c:Customer)-[:placed]->(o:Purchase) WHERE MATCH_NUMBER(c) = MATCH_NUMBER(o)", "select count(*) as d, count(*) as n, cast(1 as bigint) as same from orders"),
    "fn_labels": ("SELECT LABELS(x) AS l, COUNT(*) AS n FROM MATCH (x:Customer|Supplier) GROUP BY l", "select ['Customer'] as l, count(*) as n from customer union all select ['Supplier'], count(*) from supplier"),
    "theta_join": ("SELECT p.p_partkey AS p, r.r_regionkey AS r FROM MATCH (p:Part), MATCH (r:Region) WHERE p.p_size > r.r_regionkey * 12", "select p_partkey as p, r_regionkey as r from part join region on p_size > r_regionkey * 12"),
    "float_to_decimal": ("SELECT l.line AS line, CAST(l.quantity * 0.5 + 1.25 AS DOUBLE) AS v FROM MATCH (o:Purchase)-[l:contains]->(p:Part)", "select l_linenumber as line, l_quantity * 0.5::double + 1.25::double as v from lineitem"),
    "unreserved_names": ("SELECT end.n_nationkey AS offset, all.n_nationkey AS any FROM MATCH (all:Nation)-[path:route]->(end:Nation) WHERE path.cost > 3", f"with route as ({ROUTE}) select cast(b as integer) as \"offset\", cast(a as integer) as \"any\" from route where cost > 3"),
    # subqueries
    "exists": ("SELECT c.c_custkey AS k FROM MATCH (c:Customer) WHERE EXISTS (SELECT * FROM MATCH (c)-[:placed]->(o) WHERE o.o_totalprice > 450000)", "select c_custkey as k from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 450000)"),
    "not_exists": ("SELECT c.c_custkey AS k FROM MATCH (c:Customer) WHERE NOT EXISTS (SELECT * FROM MATCH (c)-[:placed]->(o:Purchase) WHERE o.o_totalprice > c.c_acctbal * 30)", "select c_custkey as k from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > c_acctbal * 30)"),
    "scalar_subquery": ("SELECT c.c_custkey AS k, (SELECT COUNT(o) FROM MATCH (c)-[:placed]->(o:Purchase) WHERE o.o_orderstatus = 'P') AS n, (SELECT MAX(o.o_totalprice) FROM MATCH (c)-[:placed]->(o:Purchase)) AS most FROM MATCH (c:Customer)", "select c_custkey as k, (select count(*) from orders where o_custkey = c_custkey and o_orderstatus = 'P') as n, (select max(o_totalprice) from orders where o_custkey = c_custkey) as most from customer"),
    "uncorrelated_subquery": ("SELECT c.c_custkey AS k FROM MATCH (c:Customer) WHERE c.c_acctbal = (SELECT MAX(d.c_acctbal) FROM MATCH (d:Customer))", "select c_custkey as k from customer where c_acctbal = (select max(c_acctbal) from customer)"),
    "nested_correlation": ("SELECT n.n_name AS n FROM MATCH (n:Nation) WHERE EXISTS (SELECT * FROM MATCH (n)<-[:lives_in]-(c:Customer) WHERE NOT EXISTS (SELECT * FROM MATCH (c)-[:placed]->(o:Purchase) WHERE o.o_totalprice > n.n_nationkey * 10000))", "select n_name as n from nation where exists (select 1 from customer where c_nationkey = n_nationkey and not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > n_nationkey * 10000))"),
    "exists_in_expression": ("SELECT c.c_custkey AS k, CASE WHEN EXISTS (SELECT * FROM MATCH (c)-[:placed]->(o)) THEN 1 ELSE 0 END AS v FROM MATCH (c:Customer)", "select c_custkey as k, cast(case when exists (select 1 from orders where o_custkey = c_custkey) then 1 else 0 end as bigint) as v from customer"),
    # grouping
    "agg_count_star": ("SELECT COUNT(*) AS n FROM MATCH (:Purchase)-[:contains]->(:Part)", "select count(*) as n from lineitem"),
    "agg_group": ("SELECT p.p_brand AS brand, COUNT(*) AS n, SUM(i.quantity) AS q FROM MATCH (:Purchase)-[i:contains]->(p:Part) GROUP BY p.p_brand", "select p_brand as brand, count(*) as n, sum(l_quantity) as q from lineitem join part on p_partkey = l_partkey group by p_brand"),
    "agg_group_alias": ("SELECT EXTRACT(YEAR FROM o.o_orderdate) AS y, COUNT(*) AS n FROM MATCH (o:Purchase) GROUP BY y", "select year(o_orderdate) as y, count(*) as n from orders group by 1"),
    "agg_group_vertex": ("SELECT n.n_name AS name, COUNT(c) AS n FROM MATCH (c:Customer)-[:lives_in]->(n:Nation) GROUP BY n", "select n_name as name, count(*) as n from customer join nation on n_nationkey = c_nationkey group by n_nationkey, n_name"),
    "agg_distinct": ("SELECT COUNT(DISTINCT s) AS s, COUNT(DISTINCT i.quantity) AS q, SUM(DISTINCT i.quantity) AS t FROM MATCH (o:Purchase)-[i:shipped_by]->(s:Supplier)", "select count(distinct l_suppkey) as s, count(distinct l_quantity) as q, sum(distinct l_quantity) as t from lineitem"),
    "agg_avg_sum_min_max": ("SELECT p.p_size AS size, AVG(p.p_partkey) AS a, SUM(p.p_partkey) AS s, MIN(p.p_name) AS lo, MAX(p.p_retailprice) AS hi FROM MATCH (p:Part) GROUP BY p.p_size", "select p_size as size, avg(p_partkey) as a, cast(sum(p_partkey) as bigint) as s, min(p_name) as lo, max(p_retailprice) as hi from part group by p_size"),
    "agg_array": ("SELECT n.n_regionkey AS r, ARRAY_AGG(n.n_nationkey) AS keys FROM MATCH (n:Nation) GROUP BY n.n_regionkey", "select n_regionkey as r, list(n_nationkey order by n_nationkey) as keys from nation group by n_regionkey"),
    "agg_listagg": ("SELECT n.n_regionkey AS r, LISTAGG(n.n_name, ', ') AS names FROM MATCH (n:Nation) GROUP BY n.n_regionkey", "select n_regionkey as r, string_agg(n_name, ', ' order by n_name) as names from nation group by n_regionkey"),
    "having": ("SELECT c.c_custkey AS k FROM MATCH (c:Customer)-[:placed]->(o:Purchase) GROUP BY c HAVING COUNT(o) > 14", "select o_custkey as k from orders group by o_custkey having count(*) > 14"),
    "implicit_group": ("SELECT MIN(o.o_totalprice) AS lo, MAX(o.o_totalprice) AS hi, COUNT(*) AS n FROM MATCH (o:Purchase) WHERE o.o_totalprice < 0", "select min(o_totalprice) as lo, max(o_totalprice) as hi, count(*) as n from orders where o_totalprice < 0"),
    "distinct_rows": ("SELECT DISTINCT c.c_mktsegment AS m, n.n_regionkey AS r FROM MATCH (c:Customer)-[:lives_in]->(n:Nation)", "select distinct c_mktsegment as m, n_regionkey as r from customer join nation on n_nationkey = c_nationkey"),
    # order and limits
    "order_by_asc_desc": ("SELECT c.c_custkey AS k, c.c_mktsegment AS m FROM MATCH (c:Customer) ORDER BY c.c_mktsegment ASC, k DESC LIMIT 50", "select c_custkey as k, c_mktsegment as m from customer order by c_mktsegment, c_custkey desc limit 50"),
    "order_nulls": ("SELECT x.c_custkey AS c, x.s_suppkey AS s FROM MATCH (x:Customer|Supplier) ORDER BY x.c_custkey DESC, x.s_suppkey LIMIT 20", "select * from (select c_custkey as c, null::bigint as s from customer union all select null, s_suppkey from supplier) order by c desc nulls first, s nulls last limit 20"),
    "limit_offset": ("SELECT o.o_orderkey AS k FROM MATCH (o:Purchase) ORDER BY o.o_totalprice DESC, k LIMIT 10 OFFSET 5", "select o_orderkey as k from orders order by o_totalprice desc, o_orderkey limit 10 offset 5"),
    "top_k": ("SELECT p.p_partkey AS k, p.p_retailprice AS v FROM MATCH (p:Part) ORDER BY v DESC, k LIMIT 7", "select p_partkey as k, p_retailprice as v from part order by p_retailprice desc, p_partkey limit 7"),
    "select_all_props": ("SELECT n.* FROM MATCH (n:Nation)", "select n_nationkey, n_name, n_regionkey from nation"),
    "select_prefix": ("SELECT n.* PREFIX 'x_' FROM MATCH (n:Nation)", "select n_nationkey as x_n_nationkey, n_name as x_n_name, n_regionkey as x_n_regionkey from nation"),
    # paths
    "reach_star": ("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM MATCH (a:Nation)-/:route*/->(b:Nation)", f"{_walk(25)} select distinct cast(root as integer) as a, cast(node as integer) as b from walk"),
    "reach_plus": ("SELECT COUNT(*) AS n FROM MATCH (a:Turn)-/:next_turn+/->(b:Turn)", "select count(*) as n from conversations a join conversations b on a.conv_id = b.conv_id and b.turn > a.turn"),
    "reach_opt": ("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM MATCH (a:Nation)-/:route?/->(b:Nation)", f"{_walk(1)} select distinct cast(root as integer) as a, cast(node as integer) as b from walk"),
    "reach_n": ("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM MATCH (a:Nation)-/:route{2}/->(b:Nation)", f"{_walk(2)} select distinct cast(root as integer) as a, cast(node as integer) as b from walk where n = 2"),
    "reach_n_up": ("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM MATCH (a:Nation)-/:route{2,}/->(b:Nation)", f"{_walk(27)} select distinct cast(root as integer) as a, cast(node as integer) as b from walk where n >= 2"),
    "reach_range": ("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM MATCH (a:Nation)<-/:route{2,3}/-(b:Nation)", f"{_walk(3)} select distinct cast(node as integer) as a, cast(root as integer) as b from walk where n >= 2"),
    "reach_backwards": ("SELECT a.n_nationkey AS a FROM MATCH (a:Nation)-/:route{1,2}/->(b:Nation) WHERE b.n_name = 'NATION_9'", f"{_walk(2)} select distinct cast(root as integer) as a from walk where n >= 1 and node = 9"),
    "path_any": ("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM MATCH ANY (a:Nation)-[e:route]->+(b:Nation)", f"{_walk(26)} select distinct cast(root as integer) as a, cast(node as integer) as b from walk where n >= 1"),
    "path_any_shortest": ("SELECT a.n_nationkey AS a, b.n_nationkey AS b, COUNT(e) AS hops FROM MATCH ANY SHORTEST (a:Nation)-[e:route]->*(b:Nation)", f"{_walk(25)} select cast(root as integer) as a, cast(node as integer) as b, cast(min(n) as bigint) as hops from walk group by root, node"),
    "path_all_shortest": ("SELECT a.n_nationkey AS a, b.n_nationkey AS b, COUNT(e) AS hops, SUM(e.cost) AS cost FROM MATCH ALL SHORTEST (a:Nation)-[e:route]->+(b:Nation)", f"{_paths(9)} select cast(root as integer) as a, cast(node as integer) as b, cast(n as bigint) as hops, cost from (select *, rank() over (partition by root, node order by n) as r from walk where n >= 1) where r = 1"),
    "path_top_k_shortest": ("SELECT a.n_nationkey AS a, b.n_nationkey AS b, COUNT(e) AS hops FROM MATCH TOP 3 SHORTEST (a:Nation)-[e:route]->*(b:Nation)", f"{_paths(12)} select cast(root as integer) as a, cast(node as integer) as b, cast(n as bigint) as hops from (select *, row_number() over (partition by root, node order by n, ids) as r from walk) where r <= 3"),
    "path_any_cheapest": ("SELECT a.n_nationkey AS a, b.n_nationkey AS b, SUM(e.cost) AS cost FROM MATCH ANY CHEAPEST (a:Nation) (-[e:route]-> COST e.cost)* (b:Nation)", f"{_paths(13)} select cast(root as integer) as a, cast(node as integer) as b, case when min(cost) > 0 then min(cost) end as cost from walk group by root, node"),
    "path_all_cheapest": ("SELECT a.n_nationkey AS a, b.n_nationkey AS b, COUNT(e) AS hops FROM MATCH ALL CHEAPEST (a:Nation) (-[e:route]-> COST e.cost)+ (b:Nation)", f"{_paths(13)} select cast(root as integer) as a, cast(node as integer) as b, cast(n as bigint) as hops from (select *, rank() over (partition by root, node order by cost) as r from walk where n >= 1) where r = 1"),
    "path_top_k_cheapest": ("SELECT a.n_nationkey AS a, b.n_nationkey AS b, SUM(e.cost) AS cost FROM MATCH TOP 2 CHEAPEST (a:Nation) (-[e:route]-> COST e.cost){1,4} (b:Nation)", f"{_paths(4)} select cast(root as integer) as a, cast(node as integer) as b, cost from (select *, row_number() over (partition by root, node order by cost, n, ids) as r from walk where n >= 1) where r <= 2"),
    "path_all_bounded": ("SELECT a.n_nationkey AS a, b.n_nationkey AS b, SUM(e.cost) AS cost FROM MATCH ALL (a:Nation)-[e:route]->{1,3}(b:Nation)", f"{_paths(3)} select cast(root as integer) as a, cast(node as integer) as b, cost from walk where n >= 1"),
    "path_where_hop": ("SELECT a.n_nationkey AS a, b.n_nationkey AS b, COUNT(e) AS hops FROM MATCH ANY SHORTEST (a:Nation) (-[e:route]-> WHERE e.cost > 3)* (b:Nation)", f"{R}, walk(root, node, n) as (select cast(n_nationkey as bigint), cast(n_nationkey as bigint), 0 from nation union select w.root, r.b, w.n + 1 from walk w join route r on w.node = r.a and r.cost > 3 where w.n < 25) select cast(root as integer) as a, cast(node as integer) as b, cast(min(n) as bigint) as hops from walk group by root, node"),
    "path_horizontal_agg": ("SELECT a.n_nationkey AS a, b.n_nationkey AS b, COUNT(e) AS n, MIN(e.cost) AS lo, MAX(e.cost) AS hi, AVG(e.cost) AS mean, ARRAY_AGG(e.cost) AS costs, LISTAGG(v.n_nationkey, '>') AS way FROM MATCH ALL (a:Nation) (-[e:route]->(v)){1,2} (b:Nation) WHERE SUM(e.cost) < 15", f"{R}, w as (select r.a as s, r.b as node, [r.cost] as costs, cast(r.b as varchar) as way from route r union all select r.a, q.b, [r.cost, q.cost], r.b || '>' || q.b from route r join route q on q.a = r.b) select cast(s as integer) as a, cast(node as integer) as b, len(costs) as n, list_min(costs) as lo, list_max(costs) as hi, list_avg(costs) as mean, costs, way from w where list_sum(costs) < 15"),
    "path_sum_of_count": ("SELECT SUM(COUNT(e)) AS total FROM MATCH ANY SHORTEST (a:Nation)-[e:route]->*(b:Nation)", f"{_walk(25)} select cast(sum(hops) as bigint) as total from (select min(n) as hops from walk group by root, node)"),
    "path_group_by_length": ("SELECT COUNT(e) AS hops, COUNT(*) AS n FROM MATCH ANY SHORTEST (a:Nation)-[e:route]->*(b:Nation) GROUP BY COUNT(e)", f"{_walk(25)} select cast(hops as bigint) as hops, count(*) as n from (select min(n) as hops from walk group by root, node) group by 1"),
    "path_turns": ("SELECT a.conv_id AS c, COUNT(e) AS hops FROM MATCH ANY SHORTEST (a:Turn)-[e:next_turn]->+(b:Turn) WHERE a.turn = 0 AND b.role = 'user'", "select a.conv_id as c, b.turn - a.turn as hops from conversations a join conversations b on a.conv_id = b.conv_id and b.turn > a.turn where a.turn = 0 and b.role = 'user'"),
    "macro_reach": ("PATH near AS (a:Nation)-[:route]->(:Nation)-[:route]->(b:Nation) SELECT x.n_nationkey AS x, y.n_nationkey AS y FROM MATCH (x:Nation)-/:near+/->(y:Nation)", f"{R}, near as (select distinct p.a, q.b from route p join route q on p.b = q.a), walk(root, node) as (select a, b from near union select w.root, n.b from walk w join near n on n.a = w.node) select cast(root as integer) as x, cast(node as integer) as y from walk"),
    "macro_several": ("PATH up AS (a:Nation)-[e:route]->(b:Nation) WHERE b.n_nationkey > a.n_nationkey PATH cheap AS (a:Nation)-[e:route]->(b:Nation) WHERE e.cost < 5 SELECT x.n_nationkey AS x, y.n_nationkey AS y, z.n_nationkey AS z FROM MATCH (x:Nation)-/:up/->(y:Nation)-/:cheap{1,2}/->(z:Nation)", f"{R} select distinct cast(u.a as integer) as x, cast(u.b as integer) as y, cast(w.b as integer) as z from route u join (select a, b from route where cost < 5 union select p.a, q.b from route p join route q on p.b = q.a where p.cost < 5 and q.cost < 5) w on w.a = u.b where u.b > u.a"),
    "macro_beside_label": ("PATH back AS (a:Nation)<-[e:route]-(b:Nation) WHERE e.cost > 8 SELECT x.n_nationkey AS x, y.n_nationkey AS y FROM MATCH (x:Nation)-/:back|route{2}/->(y:Nation)", f"{R}, hop as (select a, b from route union select b, a from route where cost > 8) select distinct cast(p.a as integer) as x, cast(q.b as integer) as y from hop p join hop q on p.b = q.a"),
    "macro_where": ("PATH cheap AS (a:Nation)-[e:route]->(b:Nation) WHERE e.cost < 5 SELECT x.n_nationkey AS x, y.n_nationkey AS y FROM MATCH (x:Nation)-/:cheap{1,3}/->(y:Nation)", f"{R}, walk(root, node, n) as (select a, b, 1 from route where cost < 5 union select w.root, r.b, w.n + 1 from walk w join route r on w.node = r.a and r.cost < 5 where w.n < 3) select distinct cast(root as integer) as x, cast(node as integer) as y from walk"),
    "macro_reversed": ("PATH step AS (b:Nation)<-[e:route]-(a:Nation) SELECT x.n_nationkey AS x, y.n_nationkey AS y FROM MATCH (x:Nation)-/:step{2}/->(y:Nation)", f"{_walk(2)} select distinct cast(node as integer) as x, cast(root as integer) as y from walk where n = 2"),
    # statements without rows of the tables
    "show_labels": ("SHOW LABELS", "select unnest(['Customer', 'Doc', 'Event', 'Nation', 'Part', 'Purchase', 'Region', 'Supplier', 'Turn', 'Visitor', 'based_in', 'contains', 'did', 'in_region', 'lives_in', 'next_turn', 'placed', 'route', 'shipped_by']) as label"),
    "show_graphs": ("SHOW GRAPHS", "select 'shop' as graph"),
}


def _query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: Session(spark).register(shop_graph(spark, folder)).execute(text)


def _small_graph(spark: SparkSession, folder: str) -> Session:
    """A stored copy of customers, nations, regions and orders."""
    shop = shop_graph(spark, folder)
    keep = {"Region", "Nation", "Customer", "Purchase", "in_region", "lives_in", "placed"}
    shop.vertices = [t for t in shop.vertices if t.labels[0] in keep]
    shop.edges = [t for t in shop.edges if t.labels[0] in keep]
    session = Session(spark)
    session.import_graph("copy", shop)
    session.execute("USE copy")
    return session


def _after(statements: list[str], query: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        session = _small_graph(spark, folder)
        for s in statements:
            session.execute(s)
        return session.execute(query)

    return run


CHANGES: dict[str, tuple[list[str], str, str]] = {
    "insert_select": (
        ["CREATE LABEL Segment", "CREATE LABEL belongs_to", "INSERT VERTEX s LABELS (Segment) PROPERTIES (s.name = c.c_mktsegment) FROM MATCH (c:Customer) GROUP BY c.c_mktsegment", "INSERT EDGE e BETWEEN c AND s LABELS (belongs_to) PROPERTIES (e.balance = c.c_acctbal) FROM MATCH (c:Customer), MATCH (s:Segment) WHERE c.c_mktsegment = s.name"],
        "SELECT s.name AS name, COUNT(*) AS n, MAX(e.balance) AS most FROM MATCH (c:Customer)-[e:belongs_to]->(s:Segment) GROUP BY s.name",
        "select c_mktsegment as name, count(*) as n, max(c_acctbal) as most from customer group by 1",
    ),
    "insert_edge_to_new_vertex": (
        ["CREATE LABEL Note", "CREATE LABEL about", "INSERT VERTEX v LABELS (Note) PROPERTIES (v.text = 'about ' || n.n_name), EDGE e BETWEEN v AND n LABELS (about) FROM MATCH (n:Nation)"],
        "SELECT v.text AS text, n.n_nationkey AS k FROM MATCH (v:Note)-[:about]->(n:Nation)", "select 'about ' || n_name as text, n_nationkey as k from nation",
    ),
    "update_set": (
        ["UPDATE c SET (c.c_acctbal = -c.c_acctbal, c.flag = n.n_name) FROM MATCH (c:Customer)-[:lives_in]->(n:Nation) WHERE n.n_regionkey = 1"],
        "SELECT c.c_custkey AS k, c.c_acctbal AS b, c.flag AS flag FROM MATCH (c:Customer)",
        "select c_custkey as k, case when n_regionkey = 1 then -c_acctbal else c_acctbal end as b, case when n_regionkey = 1 then n_name end as flag from customer join nation on n_nationkey = c_nationkey",
    ),
    "delete_edge": (["DELETE e FROM MATCH (c:Customer)-[e:placed]->(o:Purchase) WHERE o.o_orderstatus = 'F'"], "SELECT c.c_custkey AS c, COUNT(*) AS n FROM MATCH (c:Customer)-[:placed]->(o:Purchase) GROUP BY c", "select o_custkey as c, count(*) as n from orders where o_orderstatus <> 'F' group by o_custkey"),
    "delete_vertex_cascade": (["DELETE n FROM MATCH (n:Nation) WHERE n.n_regionkey IN (0, 1)"], "SELECT c.c_custkey AS k, n.n_name AS n FROM MATCH (c:Customer)-[:lives_in]->(n)", "select c_custkey as k, n_name as n from customer join nation on n_nationkey = c_nationkey where n_regionkey not in (0, 1)"),
    "transaction_rollback": (["BEGIN", "DELETE n FROM MATCH (n:Nation)", "ROLLBACK"], "SELECT COUNT(*) AS n FROM MATCH (n:Nation)", "select count(*) as n from nation"),
}


def _two_graphs(s: Session) -> DataFrame:
    s.execute("DELETE n FROM MATCH (n:Nation) WHERE n.n_regionkey = 0")
    return s.execute("SELECT m.n_nationkey AS k, COUNT(*) AS n FROM MATCH (m:Nation) ON shop, MATCH (n:Nation) ON copy WHERE m.n_regionkey = n.n_regionkey GROUP BY m.n_nationkey")


def _explain(s: Session) -> DataFrame:
    plan = s.execute("EXPLAIN SELECT n.n_name AS n FROM MATCH (n:Nation) WHERE n.n_regionkey > 2")
    return plan.where("lower(plan) like '%scan parquet%'").selectExpr("count(*) > 0 as scans")


def _listed(s: Session) -> DataFrame:
    """A list of statements with empty ones, run one by one."""
    out = None
    for n in parse(";; CREATE LABEL Extra; ; INSERT VERTEX v LABELS (Extra) PROPERTIES (v.x = 7);SELECT v.x AS x FROM MATCH (v:Extra);"):
        out = s.run(n, [])
    return out


def _said(s: Session) -> DataFrame:
    """A statement's normal text, executed."""
    return s.execute(str(parse("select c.c_custkey as k from match (c:Customer) -[:lives_in]->(n:Nation) where n.n_name='NATION_3' or not c.c_acctbal<0")[0]))


def _indexes(s: Session) -> DataFrame:
    s.execute("CREATE LABEL Extra")
    s.execute("INSERT VERTEX v LABELS (Extra) PROPERTIES (v.x = 1)")
    s.execute("CREATE UNIQUE INDEX ux (x)")
    twice = "INSERT VERTEX v LABELS (Extra) PROPERTIES (v.x = 1)"
    first = _refuses(s, twice)
    s.execute("DROP INDEX ux")
    s.execute(twice)
    return s.spark.sql(f"select {str(first).lower()} as refused, {s.execute('SELECT v.x AS x FROM MATCH (v:Extra)').count()} as n")


def _refuses(s: Session, text: str) -> bool:
    try:
        s.execute(text)
    except GraphError:
        return True
    return False


#: Statements that are refused: unknown variables, labels, graphs and properties of indexes, names that are there already, ...
REFUSED = [
    "SELECT z.a AS a FROM MATCH (c:Customer)", "SELECT c.a AS a FROM MATCH (c:Nobody)", "SELECT c.a AS a FROM MATCH (c) ON nowhere", "USE nowhere",
    "CREATE GRAPH copy", "DROP GRAPH nowhere", "CREATE LABEL Customer", "DROP LABEL Nobody", "CREATE INDEX i (nothing)", "DROP INDEX i",
    "INSERT VERTEX v LABELS (Nobody)", "INSERT EDGE e BETWEEN a AND b LABELS (placed) FROM MATCH (a:Customer)", "INSERT VERTEX v LABELS (Customer) PROPERTIES (w.a = 1)",
    "UPDATE z SET (z.a = 1) FROM MATCH (c:Customer)", "DELETE z FROM MATCH (c:Customer)", "SELECT c.c_name AS n, COUNT(*) AS k FROM MATCH (c:Customer)",
    "PATH p AS ANY (a)-[e]->*(b) SELECT a AS a FROM MATCH (a)-/:p/->(b)", "SELECT COUNT(e) AS n FROM MATCH ALL (a)-[e]->+(b)", "SELECT 1", "CREATE LABEL a; CREATE LABEL b",
]


def _refused(s: Session) -> DataFrame:
    return s.spark.createDataFrame([(i, _refuses(s, x)) for i, x in enumerate(REFUSED)], "i int, refused boolean")


def _names(s: Session) -> DataFrame:
    for x in ("CREATE GRAPH IF NOT EXISTS copy", "CREATE GRAPH other", "CREATE GRAPH third", "DROP GRAPH third", "DROP GRAPH IF EXISTS third"):
        s.execute(x)
    return s.execute("SHOW GRAPHS")


def _labels(s: Session) -> DataFrame:
    for x in ("CREATE GRAPH other", "USE other", "CREATE LABEL a", "CREATE LABEL IF NOT EXISTS a", "CREATE LABEL b", "DROP LABEL b", "DROP LABEL IF EXISTS b"):
        s.execute(x)
    return s.execute("SHOW LABELS IN other")


def _into(s: Session) -> DataFrame:
    for x in ("CREATE GRAPH other", "USE other", "CREATE LABEL Mark", "USE copy", "INSERT INTO other VERTEX v LABELS (Mark) PROPERTIES (v.name = n.n_name) FROM MATCH (n:Nation) ON copy", "USE other"):
        s.execute(x)
    return s.execute("SELECT m.name AS name FROM MATCH (m:Mark)")


def _cursor(s: Session) -> DataFrame:
    connection = dbapi.Connection(s)
    c = connection.cursor()
    c.execute("SELECT c.c_custkey AS k FROM MATCH (c:Customer) WHERE c.c_mktsegment = ? AND c.c_acctbal > ?", ["BUILDING", 100])
    return s.spark.createDataFrame([tuple(r) for r in c.fetchall()], "k long")


#: name: (what to do with a session on a stored copy of a part of the shop, SQL)
SCRIPTS: dict[str, tuple[Callable[[Session], DataFrame], str]] = {
    "select_star": (lambda s: s.execute("SELECT * FROM MATCH (n:Nation)-[e:in_region]->(r:Region)").selectExpr("n.n_name as n", "e.src = n.id and e.dst = r.id as joined", "r.r_name as r", "n.labels[0] as label"), "select n_name as n, true as joined, r_name as r, 'Nation' as label from nation join region on r_regionkey = n_regionkey"),
    "on_two_graphs": (_two_graphs, "select a.n_nationkey as k, count(*) as n from nation a join nation b on a.n_regionkey = b.n_regionkey where b.n_regionkey <> 0 group by 1"),
    "parameters": (lambda s: s.execute("SELECT c.c_custkey AS k FROM MATCH (c:Customer) WHERE c.c_mktsegment = ? AND c.c_acctbal > ?", ["BUILDING", 100]), "select c_custkey as k from customer where c_mktsegment = 'BUILDING' and c_acctbal > 100"),
    "explain": (_explain, "select true as scans"),
    "create_drop_graph": (_names, "select unnest(['copy', 'other', 'shop']) as graph"),
    "create_drop_label": (_labels, "select 'a' as label"),
    "create_drop_index": (_indexes, "select true as refused, 2 as n"),
    "insert_into_graph": (_into, "select n_name as name from nation"),
    "insert_without_from": (lambda s: [s.execute(x) for x in ("CREATE LABEL Note", "INSERT VERTEX v LABELS (Note) PROPERTIES (v.text = 'a' || 'b', v.n = 1 + 2), VERTEX w LABELS (Note)", "SELECT v.text AS text, v.n AS n FROM MATCH (v:Note)")][-1], "select 'ab' as text, cast(3 as bigint) as n union all select null, null"),
    "transaction_commit": (lambda s: [s.execute(x) for x in ("BEGIN", "DELETE n FROM MATCH (n:Nation) WHERE n.n_regionkey = 1", "COMMIT", "ROLLBACK", "SELECT COUNT(*) AS n FROM MATCH (n:Nation)")][-1], "select count(*) as n from nation where n_regionkey <> 1"),
    "statement_list": (_listed, "select cast(7 as bigint) as x"),
    "ast_to_text": (_said, "select c_custkey as k from customer where c_nationkey = 3 or c_acctbal >= 0"),
    "refused_statements": (_refused, f"select cast(i as integer) as i, true as refused from range({len(REFUSED)}) t(i)"),
    "database_cursor": (_cursor, "select c_custkey as k from customer where c_mktsegment = 'BUILDING' and c_acctbal > 100"),
}


def _script(run: Callable[[Session], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: run(_small_graph(spark, folder).register(shop_graph(spark, folder), use=False))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _query(q) for k, (q, _) in QUERIES.items()} | {k: _after(s, q) for k, (s, q, _) in CHANGES.items()} | {k: _script(f) for k, (f, _) in SCRIPTS.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in QUERIES.items()} | {k: s for k, (_, _, s) in CHANGES.items()} | {k: s for k, (_, s) in SCRIPTS.items()}
