"""Queries of ordered operators over whole tables, deep pages and wide bands. Registered as those of `registry`."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions import sequential as S
from lattica.operators import relational as R
from lattica.plans import paging
from lattica.plans.registry import query

_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
_ORDER = ["l_shipdate", *_LINE]
_KEY = ", ".join(_ORDER)


@query(f"with a as (select *, case when lag(l_returnflag) over (order by {_KEY}) is not distinct from l_returnflag then 0 else 1 end as new from lineitem), b as (select *, sum(new) over (order by {_KEY} rows unbounded preceding) as run from a) select run::bigint as run, l_returnflag, count(*) as length from b group by 1, 2")
def w03_runs_of_table(t):
    return R.runs(t("lineitem"), [], _ORDER, "l_returnflag")


@query("select l_orderkey, l_linenumber, coalesce(last_value(case when l_returnflag = 'R' then l_extendedprice end ignore nulls) over (order by l_orderkey, l_linenumber, l_partkey, l_extendedprice rows unbounded preceding), first_value(case when l_returnflag = 'R' then l_extendedprice end ignore nulls) over (order by l_orderkey, l_linenumber, l_partkey, l_extendedprice rows between current row and unbounded following)) as price from lineitem")
def w05_fill_of_table(t):
    x = t("lineitem").withColumn("price", F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")))
    return R.fill_forward(x, [], _LINE, "price").select("l_orderkey", "l_linenumber", "price")


@query(f"select l_orderkey, l_linenumber, l_extendedprice from (select *, max(l_extendedprice) over (order by {_KEY} rows between unbounded preceding and 1 preceding) as top from lineitem) where top is null or l_extendedprice > top")
def w07_high_water_of_table(t):
    return R.above_high_water(t("lineitem"), [], _ORDER, "l_extendedprice").select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("select event_id, value from (select *, max(case when value < 100 and event_type = 'purchase' and event_id % 100 = 99 then 1 else 0 end) over (order by ts, event_id rows unbounded preceding) as bad from events) where bad = 0")
def p16_take_while_of_table(t):
    return R.take_while(t("events"), [], ["ts", "event_id"], ~((F.col("value") < 100) & (F.col("event_type") == "purchase") & (F.col("event_id") % 100 == 99))).select("event_id", "value")


@query("select l_orderkey, l_linenumber, l_shipdate, l_extendedprice from lineitem order by l_shipdate desc, l_extendedprice, l_orderkey, l_linenumber, l_partkey limit 50 offset 5000")
def w01_deep_page(t):
    return paging.rows_at(t("lineitem"), "-l_shipdate,l_extendedprice,l_orderkey,l_linenumber,l_partkey", 5000, 50, most=1000).select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice")


@query("with x as (select o_orderkey, o_custkey, o_orderdate from orders) select x.* from x, (select o_custkey as c, o_orderkey as o from x order by o_custkey, o_orderkey desc limit 1 offset 700) where o_custkey > c or (o_custkey = c and o_orderkey < o) order by o_custkey, o_orderkey desc limit 25")
def w01_next_page(t):
    """The page after the last row of the one before."""
    x = t("orders").select("o_orderkey", "o_custkey", "o_orderdate")
    last = paging.rows_at(x, "o_custkey,-o_orderkey", 700, 1, most=500).first()
    return paging.rows_after(x, "o_custkey,-o_orderkey", last.asDict(), 25) if last else x.limit(0)


@query("with tiers as (select p_partkey, p_retailprice * (p_partkey % 150) as lo, p_retailprice * (p_partkey % 150) + power(10, p_partkey % 10) as hi from part) select o_orderkey, min(p_partkey) as tier from orders join tiers on o_totalprice between lo and hi group by 1")
def j09_wide_bands(t):
    """Tiers from 1 to 10**9 wide."""
    lo = F.col("p_retailprice") * (F.col("p_partkey") % 150)
    tiers = t("part").select("p_partkey", lo.alias("lo"), (lo + F.pow(F.lit(10), F.col("p_partkey") % 10)).alias("hi"))
    return R.band_join(t("orders"), "o_totalprice", tiers, "lo", "hi", "p_partkey").select("o_orderkey", F.col("p_partkey").alias("tier"))


@query("with p as (select vec_id, list_transform(embedding, lambda v: floor(v * 100)) as v from embeddings), d as (select vec_id, y, x, ((v[8 * y + x + 1] - 12) ** 2 + (v[8 * y + x + 2] + 7) ** 2 + (v[8 * y + x + 9] - 3) ** 2 + (v[8 * y + x + 10] - 9) ** 2) / 4 as d from p, (select unnest(range(7)) as y), (select unnest(range(7)) as x)) select vec_id, min(d)::double as distance, arg_min(y, (d, y, x))::int as y, arg_min(x, (d, y, x))::int as x from d group by 1")
def i08_best_matches(t):
    """Vectors as 8 x 8 images: where a patch fits best."""
    v = F.transform("embedding", lambda x: F.floor(x * 100))
    image = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(v, i * 8 + 1, 8))
    patch = F.array(F.array(F.lit(12), F.lit(-7)), F.array(F.lit(3), F.lit(9)))
    return t("embeddings").select("vec_id", S.best_match(image, patch).alias("m")).select("vec_id", "m.*")
