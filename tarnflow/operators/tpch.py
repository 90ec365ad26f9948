"""TPC-H queries in the forms that the tables allow, in PostgreSQL's flavour.

There is no partsupp; queries that need it use suppliers and line items in its place. Sums of prices
are rounded at the scale of their exact values, so that the order of addition doesn't show.

Queries 2, 17, 18 and 21 compare rows with others of the same part or order. DuckDB runs them as they are
written; Spark runs forms that read line items once less, with a window or an aggregate by the same key
in place of a subquery, as Catalyst makes a second scan and a join of each subquery.
"""

from __future__ import annotations

from tarnflow.operators.subqueries import sql_query
from tarnflow.plans.dialect import average_as_decimal

_REVENUE = "round(sum(l_extendedprice * (1 - l_discount)), 4)"

sql_query(
    "tpch_q1",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
       round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 5) AS sum_charge,
       round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 6) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
       FROM lineitem WHERE l_shipdate <= '2001-08-01'::date - interval '90 days' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
)
_Q2 = """SELECT s_acctbal, s_name, n_name, l_partkey FROM (SELECT l_partkey, l_suppkey, min(l_extendedprice / l_quantity) AS cost FROM lineitem GROUP BY l_partkey, l_suppkey) c
       JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON p_partkey = l_partkey
       WHERE r_name = 'EUROPE' AND p_size < 10 AND cost = (SELECT min(l_extendedprice / l_quantity) FROM lineitem i WHERE i.l_partkey = c.l_partkey)
       ORDER BY s_acctbal DESC, n_name, s_name, l_partkey LIMIT 100"""
sql_query(
    "tpch_q2",
    """SELECT s_acctbal, s_name, n_name, l_partkey FROM (SELECT l_partkey, l_suppkey, cost, min(cost) OVER (PARTITION BY l_partkey) AS least
       FROM (SELECT l_partkey, l_suppkey, min(l_extendedprice / l_quantity) AS cost FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size < 10 GROUP BY l_partkey, l_suppkey) g) c
       JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
       WHERE r_name = 'EUROPE' AND cost = least ORDER BY s_acctbal DESC, n_name, s_name, l_partkey LIMIT 100""",
    _Q2,
)
sql_query(
    "tpch_q3",
    f"""SELECT l_orderkey, {_REVENUE} AS revenue, o_orderdate FROM customer, orders, lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey
        AND o_orderdate < '1998-03-15'::date AND l_shipdate > '1998-03-15'::date GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
)
sql_query(
    "tpch_q4",
    """SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= '1997-07-01'::date AND o_orderdate < '1997-07-01'::date + interval '3 months'
       AND EXISTS (SELECT * FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 30) GROUP BY o_orderpriority ORDER BY o_orderpriority""",
)
sql_query(
    "tpch_q5",
    f"""SELECT n_name, {_REVENUE} AS revenue FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey
        AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' AND o_orderdate >= '1996-01-01'::date
        AND o_orderdate < '1996-01-01'::date + interval '2 years' GROUP BY n_name ORDER BY revenue DESC""",
)
sql_query(
    "tpch_q6",
    """SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem WHERE l_shipdate >= '1997-01-01'::date AND l_shipdate < '1997-01-01'::date + interval '1 year'
       AND l_discount BETWEEN 0.045 AND 0.075 AND l_quantity < 24""",
)
sql_query(
    "tpch_q7",
    """SELECT supp_nation, cust_nation, l_year, round(sum(volume), 4) AS revenue FROM (SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(extract(year FROM l_shipdate) AS BIGINT) AS l_year,
       l_extendedprice * (1 - l_discount) AS volume FROM supplier, lineitem, orders, customer, nation n1, nation n2 WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey
       AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey AND n1.n_nationkey < 6 AND n2.n_nationkey >= 6 AND n2.n_nationkey < 12
       AND l_shipdate BETWEEN '1996-01-01'::date AND '1999-12-31'::date) shipping GROUP BY supp_nation, cust_nation, l_year ORDER BY supp_nation, cust_nation, l_year""",
)
sql_query(
    "tpch_q8",
    """SELECT o_year, round(sum(CASE WHEN n_key = 3 THEN volume ELSE 0 END) / sum(volume), 6) AS mkt_share FROM (SELECT CAST(extract(year FROM o_orderdate) AS BIGINT) AS o_year,
       l_extendedprice * (1 - l_discount) AS volume, n2.n_nationkey AS n_key FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey
       AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey AND n1.n_regionkey = r_regionkey AND r_name = 'AMERICA' AND s_nationkey = n2.n_nationkey
       AND o_orderdate BETWEEN '1996-01-01'::date AND '1999-12-31'::date AND p_type = 'ECONOMY') all_nations GROUP BY o_year ORDER BY o_year""",
)
sql_query(
    "tpch_q9",
    """SELECT n_name, o_year, round(sum(amount), 4) AS sum_profit FROM (SELECT n_name, CAST(extract(year FROM o_orderdate) AS BIGINT) AS o_year, l_extendedprice * (1 - l_discount) - p_retailprice * 0.1 * l_quantity AS amount
       FROM part, supplier, lineitem, orders, nation WHERE s_suppkey = l_suppkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_brand LIKE '%1%') profit
       GROUP BY n_name, o_year ORDER BY n_name, o_year DESC""",
)
sql_query(
    "tpch_q10",
    f"""SELECT c_custkey, c_name, {_REVENUE} AS revenue, c_acctbal, n_name FROM customer, orders, lineitem, nation WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey
        AND o_orderdate >= '1997-10-01'::date AND o_orderdate < '1997-10-01'::date + interval '3 months' AND l_returnflag = 'R' AND c_nationkey = n_nationkey
        GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
)
sql_query(
    "tpch_q11",
    """SELECT l_partkey, round(sum(l_extendedprice), 2) AS value FROM lineitem, supplier, nation WHERE l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_regionkey = 3 GROUP BY l_partkey
       HAVING sum(l_extendedprice) > (SELECT sum(l_extendedprice) * 0.002 FROM lineitem, supplier, nation WHERE l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_regionkey = 3)
       ORDER BY value DESC, l_partkey""",
)
sql_query(
    "tpch_q12",
    """SELECT l_linestatus, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
       CAST(sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count FROM orders, lineitem
       WHERE o_orderkey = l_orderkey AND l_shipdate >= '1997-01-01'::date AND l_shipdate < '1997-01-01'::date + interval '1 year' GROUP BY l_linestatus ORDER BY l_linestatus""",
)
sql_query(
    "tpch_q13",
    """SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_orderpriority <> '3-MEDIUM' GROUP BY c_custkey) c_orders
       GROUP BY c_count ORDER BY custdist DESC, c_count DESC""",
)
sql_query(
    "tpch_q14",
    """SELECT round(100.00 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo_revenue
       FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate >= '1997-09-01'::date AND l_shipdate < '1997-09-01'::date + interval '1 month'""",
)
sql_query(
    "tpch_q15",
    f"""WITH revenue AS (SELECT l_suppkey AS supplier_no, {_REVENUE} AS total_revenue FROM lineitem WHERE l_shipdate >= '1998-01-01'::date AND l_shipdate < '1998-01-01'::date + interval '3 months' GROUP BY l_suppkey)
        SELECT s_suppkey, s_name, total_revenue FROM supplier, revenue WHERE s_suppkey = supplier_no AND total_revenue = (SELECT max(total_revenue) FROM revenue) ORDER BY s_suppkey""",
)
sql_query(
    "tpch_q16",
    """SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS supplier_cnt FROM lineitem, part WHERE p_partkey = l_partkey AND p_brand <> 'Brand#5' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (9, 14, 19, 23, 36, 45, 49, 3)
       AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY p_brand, p_type, p_size ORDER BY supplier_cnt DESC, p_brand, p_type, p_size""",
)
_Q17 = """SELECT round(sum(l_extendedprice) / 7.0, 4) AS avg_yearly FROM lineitem, part WHERE p_partkey = l_partkey AND p_brand = 'Brand#3'
          AND l_quantity < (SELECT 0.4 * avg(l_quantity) FROM lineitem i WHERE i.l_partkey = p_partkey)"""
_Q17_ONCE = """SELECT round(sum(l_extendedprice) / 7.0, 4) AS avg_yearly FROM (SELECT l_extendedprice, l_quantity, 0.4 * avg(l_quantity) OVER (PARTITION BY l_partkey) AS least
               FROM lineitem, part WHERE p_partkey = l_partkey AND p_brand = 'Brand#3') t WHERE l_quantity < least"""
sql_query("tpch_q17", average_as_decimal(_Q17_ONCE, "l_quantity"), _Q17)
_Q18 = """SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, round(sum(l_quantity), 2) AS q FROM customer, orders, lineitem
       WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 220) AND c_custkey = o_custkey AND o_orderkey = l_orderkey
       GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100"""
sql_query(
    "tpch_q18",
    """SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, round(sum(total), 2) AS q FROM customer, orders,
       (SELECT l_orderkey, sum(l_quantity) AS total FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 220) large WHERE c_custkey = o_custkey AND o_orderkey = l_orderkey
       GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""",
    _Q18,
)
sql_query(
    "tpch_q19",
    f"""SELECT {_REVENUE} AS revenue FROM lineitem, part WHERE p_partkey = l_partkey AND ((p_brand = 'Brand#1' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 15)
        OR (p_brand = 'Brand#2' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 20) OR (p_brand = 'Brand#3' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 25))""",
)
sql_query(
    "tpch_q20",
    """SELECT s_name, s_suppkey FROM supplier, nation WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type LIKE 'PROMO%')
       AND l_shipdate >= '1997-01-01'::date AND l_shipdate < '1997-01-01'::date + interval '1 year' GROUP BY l_suppkey HAVING sum(l_quantity) > 200) AND s_nationkey = n_nationkey AND n_regionkey < 3 ORDER BY s_name""",
)
_Q21 = """SELECT s_name, count(*) AS numwait FROM supplier, lineitem l1, orders WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND l1.l_shipdate > o_orderdate + interval '60 days'
       AND EXISTS (SELECT * FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
       AND NOT EXISTS (SELECT * FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R')
       GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100"""
sql_query(
    "tpch_q21",
    """SELECT s_name, count(*) AS numwait FROM supplier, lineitem l1, orders, (SELECT l_orderkey AS k, min(l_suppkey) AS a, max(l_suppkey) AS z, min(CASE WHEN l_returnflag = 'R' THEN l_suppkey END) AS back_a,
       max(CASE WHEN l_returnflag = 'R' THEN l_suppkey END) AS back_z FROM lineitem GROUP BY l_orderkey) g WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F'
       AND l1.l_shipdate > o_orderdate + interval '60 days' AND k = l1.l_orderkey AND a <> z AND coalesce(back_a = l1.l_suppkey, true) AND coalesce(back_z = l1.l_suppkey, true)
       GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
    _Q21,
)
sql_query(
    "tpch_q22",
    """SELECT c_nationkey, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM customer WHERE c_nationkey IN (1, 3, 5, 7, 9, 11, 13) AND c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0.00)
       AND NOT EXISTS (SELECT * FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 80000) GROUP BY c_nationkey ORDER BY c_nationkey""",
)
sql_query(
    "tpcds_rollup_rank",
    """SELECT r_name, n_name, total, CAST(rank() OVER (PARTITION BY lvl, CASE WHEN lvl = 0 THEN r_name END ORDER BY total DESC) AS INTEGER) AS rk
       FROM (SELECT r_name, n_name, round(sum(o_totalprice), 2) AS total, CAST(grouping(r_name) + grouping(n_name) AS BIGINT) AS lvl FROM orders JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)) t""",
)
sql_query(
    "tpcds_intersect_channels",
    """SELECT count(*) AS n FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N' EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 49) t""",
)
sql_query(
    "tpcds_year_over_year",
    """WITH y AS (SELECT o_custkey, CAST(extract(year FROM o_orderdate) AS BIGINT) AS yr, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey, extract(year FROM o_orderdate))
       SELECT a.o_custkey, a.yr, a.total, b.total AS next_total FROM y a JOIN y b ON a.o_custkey = b.o_custkey AND b.yr = a.yr + 1 WHERE b.total > 3 * a.total""",
)
