"""The SQL surface: what a caller may write in a guarded statement, over the star schema and the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.plans import sqlguard
from docloom.queries import bind

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "conversations")

#: Statements that read alike in both dialects.
COMMON = {
    "n_projection": "select p_partkey, p_name, round(p_retailprice * 1.1, 4) as price, case when p_size > 25 then 'big' else 'small' end as size_class from part where p_size between 10 and 40",
    "n_ilike": "select n_name from nation where n_name ilike '%a%'",
    "n_in_exists": "select c_custkey from customer c where c_mktsegment in ('BUILDING', 'MACHINERY') and exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_totalprice > 100000)",
    "n_not_in": "select s_suppkey from supplier where s_nationkey not in (select n_nationkey from nation where n_regionkey = 1)",
    "n_inner_join": "select r_name, count(*) as n from nation join region on n_regionkey = r_regionkey group by r_name",
    "n_left_join": "select c_custkey, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey group by c_custkey",
    "n_right_join": "select n_name, count(s_suppkey) as n from supplier right join nation on s_nationkey = n_nationkey group by n_name",
    "n_full_join": "select coalesce(a.k, b.k) as k, a.x, b.y from (select n_nationkey as k, n_name as x from nation where n_nationkey < 15) a full join (select n_nationkey as k, n_regionkey as y from nation where n_nationkey > 10) b on a.k = b.k",
    "n_cross_join": "select r_name, n_name from region cross join nation where r_regionkey != n_regionkey",
    "n_semi_join": "select n_name from nation left semi join supplier on s_nationkey = n_nationkey",
    "n_anti_join": "select n_name from nation left anti join (select * from supplier where s_acctbal > 5000) s on s.s_nationkey = n_nationkey",
    "n_theta_join": "select a.s_suppkey as lo, b.s_suppkey as hi from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_acctbal < b.s_acctbal",
    "n_having": "select l_returnflag, l_linestatus, sum(l_quantity) as q, round(avg(l_extendedprice), 2) as p, count(*) as n from lineitem group by l_returnflag, l_linestatus having count(*) > 10",
    "n_distinct": "select distinct o_orderstatus, o_orderpriority from orders",
    "n_count_distinct": "select o_orderstatus, count(distinct o_custkey) as n from orders group by o_orderstatus",
    "n_grouping_sets": "select l_returnflag, l_linestatus, count(*) as n from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_returnflag), ())",
    "n_cube": "select n_regionkey, c_mktsegment, count(*) as n from customer join nation on c_nationkey = n_nationkey group by cube (n_regionkey, c_mktsegment)",
    "n_rollup": "select o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) as total from orders group by rollup (o_orderstatus, o_orderpriority)",
    "n_ranking": "select c_custkey, row_number() over w as rn, rank() over w as rk, dense_rank() over w as dr, ntile(4) over w as nt from customer window w as (partition by c_mktsegment order by c_acctbal desc, c_custkey)",
    "n_distribution": "select s_suppkey, round(percent_rank() over (order by s_acctbal), 6) as pr, round(cume_dist() over (order by s_acctbal), 6) as cd from supplier",
    "n_lag_lead": "select o_orderkey, lag(o_orderkey) over w as before, lead(o_orderkey, 2) over w as later, first_value(o_orderkey) over w as first_one from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)",
    "n_frame_rows": "select l_orderkey, l_linenumber, sum(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity rows between 1 preceding and current row) as q from lineitem",
    "n_frame_range": "select p_partkey, count(*) over (partition by p_brand order by p_size range between 5 preceding and 5 following) as n from part",
    "n_cte": "with big as (select o_custkey, sum(o_totalprice) as t from orders group by o_custkey), top as (select * from big where t > 200000) select c_name, round(t, 2) as t from top join customer on c_custkey = o_custkey",
    "n_recursive": "with recursive r(k, n) as (select p_partkey, 1 from part where p_partkey % 50 = 1 union all select p_partkey, n + 1 from r join part on p_partkey = k + 1 where n < 20) select k, n from r",
    "n_union": "select n_nationkey as k from nation union select s_nationkey from supplier",
    "n_union_all": "select n_regionkey as k from nation union all select r_regionkey from region",
    "n_intersect": "select c_nationkey as k from customer intersect select s_nationkey from supplier",
    "n_intersect_all": "select c_nationkey as k from customer intersect all select s_nationkey from supplier",
    "n_except": "select n_nationkey as k from nation except select s_nationkey from supplier where s_acctbal > 5000",
    "n_except_all": "select c_nationkey as k from customer except all select s_nationkey from supplier",
    "n_order_nulls": "select s_suppkey from supplier order by case when s_suppkey % 3 = 0 then null else s_acctbal end desc nulls last, s_suppkey limit 7",
    "n_limit_offset": "select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 10 offset 5",
    "n_scalar_subquery": "select c_custkey, (select count(*) from orders where o_custkey = c_custkey) as n from customer",
    "n_correlated": "select l_orderkey, l_linenumber from lineitem l where l_quantity > (select 1.5 * avg(l_quantity) from lineitem x where x.l_partkey = l.l_partkey)",
    "n_strings": "select n_nationkey, upper(n_name) as u, length(n_name) as n, substring(n_name, 2, 3) as s, replace(n_name, 'A', '4') as r, trim(concat('  ', n_name, ' ')) as t, lpad(n_name, 12, '.') as p, n_name like '%AN%' as l from nation",
    "n_math": "select p_partkey, round(sqrt(p_retailprice), 4) as q, abs(p_size - 25) as a, mod(p_size, 7) as m, floor(p_retailprice) as f, ceil(p_retailprice) as c, round(ln(p_retailprice), 5) as l, power(p_size, 2) as w, greatest(p_size, 20) as g from part",
    "n_dates": "select o_orderkey, year(o_orderdate) as y, month(o_orderdate) as m, day(o_orderdate) as d, quarter(o_orderdate) as q from orders where o_orderdate < timestamp '1996-01-01'",
    "n_conditional_agg": "select o_orderstatus, sum(case when o_orderpriority = '1-URGENT' then 1 else 0 end) as urgent, count(*) filter (where o_totalprice > 150000) as big, min(o_orderkey) as lo, max(o_orderkey) as hi, round(stddev_samp(o_totalprice), 2) as sd from orders group by o_orderstatus",
    "n_coalesce_nullif": "select s_suppkey, coalesce(nullif(s_nationkey, 3), -1) as k from supplier",
    "n_in_list_of_rows": "select o_orderkey from orders where (o_custkey, o_orderstatus) in (select c_custkey, 'O' from customer where c_acctbal < 0)",
    "f1_q1": "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 6) as disc, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by l_returnflag, l_linestatus",
    "f1_q3": "select l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, o_orderdate from customer, orders, lineitem where c_mktsegment = 'BUILDING' and c_custkey = o_custkey and l_orderkey = o_orderkey group by l_orderkey, o_orderdate order by sum(l_extendedprice * (1 - l_discount)) desc, l_orderkey limit 10",
    "f1_q5": "select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from customer, orders, lineitem, supplier, nation, region where c_custkey = o_custkey and l_orderkey = o_orderkey and l_suppkey = s_suppkey and c_nationkey = s_nationkey and s_nationkey = n_nationkey and n_regionkey = r_regionkey group by n_name",
    "f1_q6": "select round(sum(l_extendedprice * l_discount), 2) as revenue from lineitem where l_discount between 0.03 and 0.07 and l_quantity < 24",
}
#: Statements spelled differently: Spark's, DuckDB's.
BOTH = {
    "n_lists": (
        "select o_custkey, array_join(transform(sort_array(collect_list(o_orderkey)), x -> cast(x % 100 as string)), ',') as l, size(collect_set(o_orderstatus)) as n from orders group by o_custkey",
        "select o_custkey, array_to_string(list_transform(list_sort(list(o_orderkey)), lambda x: (x % 100)::varchar), ',') as l, len(list(distinct o_orderstatus))::int as n from orders group by o_custkey",
    ),
    "n_json": (
        "select event_id, get_json_object(props, '$.k') as k, length(props) as n from events",
        "select event_id, json_extract_string(props, '$.k') as k, length(props) as n from events",
    ),
    "n_regex": (
        "select n_nationkey, regexp_replace(n_name, '[AEIOU]+', '-') as r, n_name rlike '^[A-M]' as early from nation",
        "select n_nationkey, regexp_replace(n_name, '[AEIOU]+', '-', 'g') as r, regexp_matches(n_name, '^[A-M]') as early from nation",
    ),
    "n_lateral": (
        "select n_name, t.s_suppkey from nation, lateral (select s_suppkey from supplier where s_nationkey = n_nationkey order by s_acctbal desc, s_suppkey limit 1) t",
        "select n_name, t.s_suppkey from nation, lateral (select s_suppkey from supplier where s_nationkey = n_nationkey order by s_acctbal desc, s_suppkey limit 1) t",
    ),
    "n_pivot": (
        "select * from (select o_orderpriority, o_orderstatus from orders) pivot (count(*) for o_orderstatus in ('O' as open_, 'F' as done, 'P' as part))",
        "select o_orderpriority, count(*) filter (where o_orderstatus = 'O') as open_, count(*) filter (where o_orderstatus = 'F') as done, count(*) filter (where o_orderstatus = 'P') as part from orders group by o_orderpriority",
    ),
    "n_approx_distinct": ("select approx_count_distinct(o_custkey, 0.01) > 0 as some from orders", "select approx_count_distinct(o_custkey) > 0 as some from orders"),
}


def _query(name: str, sql: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return sqlguard.run(spark, sql, {t: bind.table(spark, sf, t) for t in TABLES})

    run.__name__ = name
    return run


def f13_catalog_query(spark: SparkSession, sf: str) -> DataFrame:
    sql = "select f.doc_type, count(*) as n, min(f.filename) as first_name from files f join categories c on f.category = c.category where f.filename ilike '%1%' and c.n_files > 3 group by f.doc_type"
    return sqlguard.run(spark, sql, sqlguard.catalog_views(bind.catalog(spark, sf)))


def e16_citations(spark: SparkSession, sf: str) -> DataFrame:
    rows = sqlguard.run(spark, "select doc_id, n_chars from files where n_chars > 5000", {"files": bind.catalog(spark, sf)})
    return rows.join(bind.catalog(spark, sf).select("doc_id", "filename"), "doc_id").select("doc_id", "filename").dropDuplicates(["doc_id"])


def f4_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    docs = bind.table(spark, sf, "documents")
    frames = {"empty": docs.filter("doc_id < 0"), "degenerate": docs.selectExpr("cast(null as string) as x"), "too_large": docs.select("text"), "satisfactory": docs.select("doc_id").limit(5)}
    return spark.createDataFrame([(k, sqlguard.verdict_of(v)) for k, v in frames.items()], "wanted string, got string")


def f5_too_wide(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(t, sqlguard.too_wide(bind.table(spark, sf, t))) for t in ("region", "nation", "lineitem")], "name string, wide boolean")


def f8_distinct_values(spark: SparkSession, sf: str) -> DataFrame:
    got = [(c, sqlguard.distinct_values(bind.table(spark, sf, "orders"), c)) for c in ("o_orderstatus", "o_orderpriority", "o_orderkey")]
    return spark.createDataFrame([(c, ",".join(v) if v else None) for c, v in got], "name string, shown string")


QUERIES = {k: _query(k, v) for k, v in COMMON.items()} | {k: _query(k, v[0]) for k, v in BOTH.items()}
QUERIES |= {f.__name__: f for f in (f13_catalog_query, e16_citations, f4_verdicts, f5_too_wide, f8_distinct_values)}
ORACLE_SQL = {k: v.replace("left semi join", "semi join").replace("left anti join", "anti join") for k, v in COMMON.items()} | {k: v[1] for k, v in BOTH.items()}
ORACLE_SQL |= {
    "f13_catalog_query": f"with {bind.CATALOG}, n as (select category, count(*) as n_files from catalog group by 1) select doc_type, count(*) as n, min(filename) as first_name from catalog join n using (category) where filename ilike '%1%' and n_files > 3 group by doc_type",
    "e16_citations": f"with {bind.CATALOG} select doc_id, filename from catalog where n_chars > 5000",
    "f4_verdicts": "select unnest(['empty', 'degenerate', 'too_large', 'satisfactory']) as wanted, unnest(['empty', 'degenerate', 'too_large', 'satisfactory']) as got",
    "f5_too_wide": "select 'region' as name, false as wide union all select 'nation', false union all select 'lineitem', count(*) * 11 > 5000 from lineitem",
    "f8_distinct_values": """select 'o_orderstatus' as name, (select string_agg(distinct o_orderstatus, ',' order by o_orderstatus) from orders) as shown
        union all select 'o_orderpriority', (select string_agg(distinct o_orderpriority, ',' order by o_orderpriority) from orders) union all select 'o_orderkey', null""",
}
