"""Queries of carts, constraints, keyed rows, arrays and sets. Registered as those of `registry`."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions import carts
from lattica.functions import columns as C
from lattica.operators import constraints, keyed
from lattica.operators import relational as R
from lattica.plans import query as Q
from lattica.plans.registry import query


def _carts(t):
    line = F.struct(F.col("l_linenumber").alias("id"), F.col("l_partkey").alias("product"), F.col("l_returnflag").alias("color"), F.col("l_extendedprice").alias("price"), F.lit(1).alias("count"))
    return t("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))


@query(
    "with f as (select l_orderkey as k, min(l_partkey) as m from lineitem group by 1) select l_orderkey, "
    "(count(*) + case when bool_or(l_partkey = m and l_returnflag = 'N') then 0 else 1 end)::int as n_lines, (count(*) + 1)::bigint as items from lineitem join f on k = l_orderkey group by l_orderkey, m"
)
def m09_cart_add(t):
    first = F.array_min(F.transform("lines", lambda x: x["product"]))
    new = F.struct(F.lit(0).alias("id"), first.alias("product"), F.lit("N").alias("color"), F.lit(0.0).alias("price"), F.lit(1).alias("count"))
    x = _carts(t).withColumn("lines", carts.add(F.col("lines"), new))
    return x.select("l_orderkey", F.size("lines").alias("n_lines"), F.aggregate("lines", F.lit(0).cast("bigint"), lambda a, p: a + p["count"]).alias("items"))


@query("select l_orderkey, round(coalesce(sum(case when l_linenumber = 1 then 5 else 1 end * l_extendedprice) filter (l_linenumber <> 2), 0), 2) as total from lineitem group by 1")
def m10_cart_change(t):
    lines = carts.remove(carts.set_count(F.col("lines"), F.lit(1), F.lit(5)), F.lit(2))
    return _carts(t).select("l_orderkey", F.round(C.cart_total(lines), 2).alias("total"))


@query("select c_custkey, row_number() over (order by c_acctbal desc, c_custkey) + 100 as number from customer")
def m13_auto_increment(t):
    return keyed.numbered(t("customer").select("c_custkey", "c_acctbal"), [F.desc("c_acctbal"), F.asc("c_custkey")], "number", 101).select("c_custkey", "number")


@query("select o_orderkey, o_orderstatus = 'F' as is_paid, case when o_orderstatus = 'F' then strftime(o_orderdate + interval 3 day, '%Y-%m-%d') end as paid_at from orders")
def m14_state_stamp(t):
    paid = R.stamp(t("orders"), F.col("o_orderstatus") == "F", "is_paid", "paid_at", F.expr("o_orderdate + interval 3 days"))
    return paid.select("o_orderkey", "is_paid", F.date_format("paid_at", "yyyy-MM-dd").alias("paid_at"))


@query("select o_orderkey, list_filter([o_custkey, 7, o_custkey], lambda x, i: i <> list_position([o_custkey, 7, o_custkey], o_custkey)) as kept from orders")
def m15_remove_by_value(t):
    a = F.array("o_custkey", F.lit(7).cast("bigint"), "o_custkey")
    return t("orders").select("o_orderkey", C.remove_first(a, F.col("o_custkey")).alias("kept"))


@query("select e.event_id, coalesce(c.c_name, 'nobody') as c_name from events e left join customer c on c.c_custkey = e.user_id + 100")
def m02_get_or_default(t):
    events = t("events").select("event_id", (F.col("user_id") + 100).alias("c_custkey"))
    return keyed.get_or(events, t("customer"), "c_custkey", "c_name", "nobody").select("event_id", "c_name")


@query("with c as (select coalesce(max(event_id), -1) as last from events where event_id % 997 = 500) select user_id, max(event_id) as event_id from events, c where event_id > c.last group by 1")
def m04_clear(t):
    """Puts by user, with a clear now and then: what is there at the end."""
    ops = t("events").select("user_id", "event_id", F.when(F.col("event_id") % 997 == 500, "clear").otherwise("put").alias("op"))
    return R.replay(ops, "user_id", "event_id").select("user_id", "event_id")


@query("select n_nationkey, (list_sum(list_transform(string_split(n_name, ''), lambda c: unicode(c)))::bigint % 23)::int as bucket from nation")
def m05_rehash(t):
    return keyed.rehashed(t("nation"), "n_name", C.additive_hash(F.col("n_name")), 20).select("n_nationkey", "bucket")


@query("select event_id, 'k' as key, props->>'$.k' as value from events")
def m06_entries(t):
    return t("events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))


@query(
    "select p_partkey, lower(trim(p_name)) as name, array_to_string(list_filter([case when length(trim(p_name)) < 10 then 'p_name is too short' end, "
    "case when p_size < 5 then 'p_size is less than 5' end, case when p_size > 45 then 'p_size is more than 45' end, case when p_type not in ('ECONOMY', 'STANDARD') then 'p_type is not allowed' end, "
    "case when count(*) over (partition by p_brand, p_size) > 1 then 'code is taken' end], lambda x: x is not null), '; ') as errors from part"
)
def p19_constraints(t):
    rules = {
        "p_name": constraints.Rule(required=True, trim=True, lower=True, min_length=10),
        "p_size": constraints.Rule(required=True, default=0, least=5, most=45),
        "p_type": constraints.Rule(one_of=("ECONOMY", "STANDARD")),
        "code": constraints.Rule(unique=True),
    }
    parts = t("part").withColumn("code", F.concat_ws("/", "p_brand", "p_size"))
    return constraints.check(parts, rules).select("p_partkey", F.col("p_name").alias("name"), F.array_join("errors", "; ").alias("errors"))


@query(
    "select c_custkey, regexp_full_match(substr(sha256(c_name), 1, 20 + c_custkey % 8), '[0-9a-fA-F]{24}') as id_ok, c_custkey % 3 <> 0 as email_ok, regexp_full_match(c_acctbal::varchar, '[+-]?([0-9]*\\.)?[0-9]+') as number_ok, "
    "regexp_full_match('01' || (c_custkey % 4) || lpad(c_custkey::varchar, 8, '0'), '(\\+?20|0)?1[0125][0-9]{8}') as phone_ok from customer"
)
def f40_formats(t):
    ok = lambda c, p: c.rlike(p)
    name = F.col("c_name")
    return t("customer").select(
        "c_custkey",
        ok(F.substring(F.sha2(name, 256), F.lit(1), (20 + F.col("c_custkey") % 8).cast("int")), constraints.OBJECT_ID).alias("id_ok"),
        ok(F.concat(F.replace(name, F.lit("#"), F.lit(".")), F.when(F.col("c_custkey") % 3 == 0, F.lit("@mail")).otherwise(F.lit("@mail.example.org"))), constraints.EMAIL).alias("email_ok"),
        ok(F.col("c_acctbal").cast("string"), constraints.NUMERIC).alias("number_ok"),
        ok(F.concat(F.lit("01"), (F.col("c_custkey") % 4).cast("string"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")), constraints.MOBILE).alias("phone_ok"),
    )


@query("select r_name, 'N' || n_nationkey as variant, case when n_nationkey % 3 = 0 then '0' else (n_nationkey % 5)::varchar end as stock from nation join region on r_regionkey = n_regionkey")
def c07_variants(t):
    variant = F.struct(F.concat(F.lit("N"), "n_nationkey").alias("variant"), F.when(F.col("n_nationkey") % 3 != 0, F.concat(F.lit(" "), F.col("n_nationkey") % 5)).alias("stock"))
    lists = t("nation").groupBy("n_regionkey").agg(F.collect_list(variant).alias("variants"))
    x = t("region").join(lists, F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", F.explode("variants").alias("v"))
    return x.select("r_name", "v.variant", carts.variants(F.col("r_name"), F.col("v.stock")).alias("stock"))


@query("select l_orderkey, max(l_partkey) filter (l_linenumber = 3) as product, (case when count(*) filter (l_linenumber = 3) = 0 then -1 else count(*) filter (l_linenumber < 3) end)::int as position from lineitem group by 1 having count(*) = count(distinct l_linenumber)")
def c08_element_by_id(t):
    x = _carts(t).where(F.size("lines") == F.size(F.array_distinct(F.transform("lines", lambda v: v["id"]))))
    return x.select("l_orderkey", carts.element(F.col("lines"), F.lit(3))["product"].alias("product"), carts.position(F.col("lines"), F.lit(3)).alias("position"))


@query("select l_orderkey, string_agg(case when l_linenumber = 2 and l_orderkey % 2 = 0 then 'X' else l_returnflag end, '' order by l_linenumber, l_partkey, l_returnflag, l_extendedprice) as colors from lineitem group by 1")
def c09_element_update(t):
    new = F.when(F.col("l_orderkey") % 2 == 0, "X").otherwise("")
    return _carts(t).select("l_orderkey", F.array_join(F.transform(carts.patch(F.col("lines"), F.lit(2), color=new), lambda x: x["color"]), "").alias("colors"))


@query("select o_orderkey, o_custkey as top, [o_orderkey] as popped, [o_orderkey, o_custkey, 9] as pushed, null::bigint as of_empty from orders")
def c03_stack(t):
    a = F.array("o_orderkey", "o_custkey")
    return t("orders").select("o_orderkey", carts.peek(a).alias("top"), carts.pop(a).alias("popped"), carts.push(a, F.lit(9).cast("bigint")).alias("pushed"), carts.peek(carts.pop(F.array().cast("array<bigint>"))).alias("of_empty"))


@query("select n_nationkey, case when n_nationkey <= 4 then 4 when n_nationkey <= 8 then 8 when n_nationkey <= 16 then 16 else 32 end::int as capacity from nation")
def c04_capacity(t):
    return t("nation").select("n_nationkey", carts.capacity(F.col("n_nationkey")).alias("capacity"))


@query("select o_orderkey, [7, o_orderkey, o_custkey] as inserted, o_custkey = 7 or o_orderkey = 7 as has, case when o_orderkey = 7 then [o_custkey] when o_custkey = 7 then [o_orderkey] else [o_orderkey, o_custkey] end as removed from orders")
def c05_list(t):
    a, v = F.array("o_orderkey", "o_custkey"), F.lit(7).cast("bigint")
    return t("orders").select("o_orderkey", carts.insert_front(a, v).alias("inserted"), F.array_contains(a, v).alias("has"), C.remove_first(a, v).alias("removed"))


@query("select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice, o_orderkey) as place from orders")
def o03_in_order(t):
    x = t("orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_totalprice", "o_orderkey"))).alias("a"))
    return x.select("o_custkey", F.posexplode("a").alias("i", "o")).select("o_custkey", "o.o_orderkey", (F.col("i") + 1).cast("bigint").alias("place"))


@query("select o_custkey, list_reverse_sort(list(o_orderkey)) as sorted from orders group by 1")
def o05_heapsort(t):
    return t("orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey"), False).alias("sorted"))


@query("")
def o09_quota_sample(t):
    return keyed.quota_sample(t("events"), F.col("event_type"), 20, 5, "event_id").select("event_id", "event_type")


@query(
    "with r as (select user_id, event_type, row_number() over (partition by user_id order by event_type, event_id) - row_number() over (partition by user_id, event_type order by event_id) as g from events), "
    "n as (select user_id, event_type, count(*) as frequency from r group by user_id, event_type, g) select distinct user_id, event_type, frequency from n qualify frequency = max(frequency) over (partition by user_id)"
)
def a05_sorted_modes(t):
    return keyed.sorted_modes(t("events"), "user_id", ["event_type", "event_id"], "event_type")


@query("select p_partkey, r_word from part, (select distinct split_part(p_name, ' ', 1) as r_word from part union select distinct left(p_name, 2) from part) where contains(p_name, r_word)")
def j08_contains_table(t):
    """All first words, and all first two letters, in all names."""
    words = t("part").select(F.get(F.split("p_name", " "), F.lit(0)).alias("r_word")).unionAll(t("part").select(F.substring("p_name", 1, 2)))
    return keyed.containing(t("part"), "p_name", words, "r_word").select("p_partkey", "r_word")


@query("select n_nationkey, y, x, n_nationkey * (y + 1) + n_regionkey * (x + 1) as v from nation, (select unnest([-1, 0, 1]) as y) a, (select unnest([-1, 0, 1]) as x) b")
def j12_offsets(t):
    k = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    return t("nation").withColumn("y", F.explode(k)).withColumn("x", F.explode(k)).select("n_nationkey", "y", "x", (F.col("n_nationkey") * (F.col("y") + 1) + F.col("n_regionkey") * (F.col("x") + 1)).alias("v"))


@query("select o_orderkey, o_custkey from orders where o_custkey = 37")
def p04_row_security(t):
    return Q.secured(t("orders"), "user", "o_custkey", 37).select("o_orderkey", "o_custkey")


@query("select event_id, 'k' as key from events")
def p08_key_whitelist(t):
    both = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("secret"), F.lit("x")))
    return t("events").select("event_id", F.array_join(F.map_keys(Q.only_keys(both, ["k", "z"])), ",").alias("key"))


@query("select n_nationkey, (list_sum(list_transform(string_split(n_name, ''), lambda c: unicode(c)))::bigint % 10)::int as plain, (list_sum(list_transform(string_split(n_name, ''), lambda c, i: i * unicode(c)))::bigint % 10)::int as weighted from nation")
def x02_pluggable_hash(t):
    at = lambda f: F.pmod(f(F.col("n_name")), F.lit(10)).cast("int")
    return t("nation").select("n_nationkey", at(C.additive_hash).alias("plain"), at(C.weighted_hash).alias("weighted"))


@query("select p_partkey, p_size from part where p_size >= 10 and regexp_matches(p_name, 'cold', 'i') order by p_size desc, p_partkey limit 20 offset 20")
def x03_table_handler(t):
    return Q.page(t("part"), {"p_size": {"gte": 10}, "keyword": "cold", "sort": "-p_size", "page": 2, "limit": 20, "fields": "p_partkey,p_size"}, ["p_name"], "p_partkey").data


@query("select p_partkey, p_retailprice from part")
def x06_required(t):
    return constraints.require(t("part"), F.col("p_retailprice") > 0, "a price is not positive").select("p_partkey", "p_retailprice")


@query("select count(*) as results, 1 as current_page, 50 as page_limit, ceil(count(*) / 50)::int as pages, case when count(*) > 50 then 2 end::int as next_page from orders where o_orderstatus = 'F'")
def k01_envelope(t):
    e = Q.page(t("orders"), {"o_orderstatus": "F"}, key="o_orderkey", default_sort="-o_totalprice").meta_frame()
    return e.select("results", "current_page", "page_limit", "pages", "next_page")
