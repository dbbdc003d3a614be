"""Further queries, by the operator's number: predicates, joins, order, text, arrays, images, caches. Registered as those of `registry`."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions import columns as C
from lattica.functions import sequential as S
from lattica.operators import relational as R
from lattica.plans.registry import query
from lattica.sources import paged
from lattica.streaming import cache


@query("select p_partkey from part where list_contains(string_split(p_name, ' '), 'red')")
def p11_class_membership(t):
    return t("part").where(F.array_contains(F.split("p_name", " "), "red")).select("p_partkey")


@query("select event_id from events where dayofweek(ts) in (0, 6) and hour(ts) between 9 and 17")
def p12_weekend_slot(t):
    return t("events").where(F.dayofweek("ts").isin(1, 7) & F.hour("ts").between(9, 17)).select("event_id")


@query("select p_partkey from part where trim(p_name) <> '' and p_size <> 0")
def p13_not_blank(t):
    return t("part").where((F.trim("p_name") != "") & (F.col("p_size") != 0)).select("p_partkey")


@query("select event_id from events where ts + interval 30 minute > timestamp '2024-01-02 00:00:00'")
def p14_not_expired(t):
    return t("events").where("ts + interval 30 minutes > timestamp '2024-01-02 00:00:00'").select("event_id")


@query("select p_partkey from part where contains(p_name, 'an')")
def p15_contains(t):
    return t("part").where(F.contains("p_name", F.lit("an"))).select("p_partkey")


@query("select event_id from events where event_id between 100 and 900 and event_type <> 'error'")
def p20_range_and_flag(t):
    return t("events").where(F.col("event_id").between(100, 900) & (F.col("event_type") != "error")).select("event_id")


@query("select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def j06_unique(t):
    return t("orders").join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey")


@query("select user_id from events where event_type in ('click', 'purchase') and value > 150 group by user_id having count(distinct event_type) = 2")
def j11_division(t):
    return t("events").where(F.col("event_type").isin("click", "purchase") & (F.col("value") > 150)).groupBy("user_id").agg(F.countDistinct("event_type").alias("n")).where("n = 2").select("user_id")


@query("select n_nationkey, 'Dear ' || n_name || ', number ' || n_nationkey || ' of {{ region }}' as letter from nation")
def j13_template_tags(t):
    return t("nation").select("n_nationkey", S.render("Dear {{ name }}, number {{key}} of {{ region }}", {"name": F.col("n_name"), "key": F.col("n_nationkey")}).alias("letter"))


@query("select doc_id, len(string_split(text, chr(10))) as n from documents where text is not null")
def a10_length(t):
    return t("documents").where("text is not null").select("doc_id", F.size(F.split("text", "\n")).cast("bigint").alias("n"))


@query("select p_partkey, array_to_string(list_filter(string_split(p_name, ' '), lambda x, i: list_position(string_split(p_name, ' '), x) = i), ' ') as codes from part")
def a11_ordered_distinct(t):
    return t("part").select("p_partkey", F.array_join(F.array_distinct(F.split("p_name", " ")), " ").alias("codes"))


@query("select c_mktsegment, string_agg(c_custkey::varchar, ',' order by c_custkey) as keys from customer group by 1")
def a12_multimap(t):
    x = t("customer").groupBy("c_mktsegment").agg(F.sort_array(F.collect_list("c_custkey")).alias("k"))
    return x.select("c_mktsegment", F.array_join(F.transform("k", lambda k: k.cast("string")), ",").alias("keys"))


@query(
    "with o as (select o_custkey, o_orderkey as i, o_totalprice as v from orders), "
    "n as (select x.o_custkey, x.i, count(y.i) as depth from o x left join o y on y.o_custkey = x.o_custkey and y.i < x.i and not exists "
    "(select 1 from o z where z.o_custkey = x.o_custkey and z.i < y.i and ((z.v >= y.v and z.v <= x.v and y.v <= x.v) or (z.v > x.v and z.v <= y.v and y.v > x.v))) group by 1, 2) "
    "select o_custkey, max(depth)::int as height from n group by 1"
)
def a16_tree_height(t):
    x = t("orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("a"))
    return x.select("o_custkey", S.tree_height(F.transform("a", lambda o: o["o_totalprice"])).alias("height"))


@query("select event_id, row_number() over (partition by user_id order by ts, event_id) as position from events")
def w06_positions(t):
    from pyspark.sql import Window

    return t("events").select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("position"))


@query("select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) = 3")
def w08_third(t):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return t("orders").withColumn("n", n).where("n = 3").select("o_custkey", "o_orderkey")


@query("select o_orderkey, list_sort([o_custkey, o_orderkey, 500]) as sorted, list_reverse_sort([o_custkey, o_orderkey, 500]) as mirrored from orders")
def o02_sorted_insert(t):
    a = F.array("o_custkey", "o_orderkey", F.lit(500).cast("bigint"))
    return t("orders").select("o_orderkey", F.sort_array(a).alias("sorted"), F.sort_array(a, False).alias("mirrored"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10")
def o07_top_k(t):
    return t("orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


@query("select not exists (select c_nationkey from customer except select n_nationkey from nation) as subset, not exists (select c_nationkey from customer except select s_nationkey from supplier) and not exists (select s_nationkey from supplier except select c_nationkey from customer) as same")
def u03_set_tests(t):
    c, s, n = t("customer").select(F.col("c_nationkey").alias("k")), t("supplier").select("s_nationkey"), t("nation").select("n_nationkey")
    off = c.subtract(n).select(F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(c.subtract(s).unionAll(s.subtract(c)).select(F.lit(0), F.lit(1)))
    return off.agg((F.coalesce(F.sum("a"), F.lit(0)) == 0).alias("subset"), (F.coalesce(F.sum("b"), F.lit(0)) == 0).alias("same"))


@query("select o_orderkey, case when o_custkey = 7 then [7, o_orderkey] when o_orderkey = 7 then [o_custkey, 7] else [o_custkey, o_orderkey, 7] end as added, list_filter([o_custkey, o_orderkey], lambda x: x <> 7) as pulled from orders where o_custkey <> o_orderkey")
def u06_add_pull(t):
    a, v = F.array("o_custkey", "o_orderkey"), F.lit(7).cast("bigint")
    return t("orders").where("o_custkey <> o_orderkey").select("o_orderkey", C.add_to_set(a, v).alias("added"), C.remove_first(a, v).alias("pulled"))


@query("select p_partkey, exists (select 1 from lineitem where l_partkey = p_partkey) as sold from part")
def u07_membership(t):
    sold = t("lineitem").select("l_partkey").distinct()
    return t("part").join(sold, F.col("l_partkey") == F.col("p_partkey"), "left").select("p_partkey", F.col("l_partkey").isNotNull().alias("sold"))


@query("select c_custkey, c_acctbal >= 0 as active from customer")
def m12_soft_delete(t):
    gone = t("customer").where("c_acctbal < 0").select("c_custkey", F.lit(False).alias("active"))
    return R.update(t("customer").select("c_custkey", F.lit(True).alias("active")), gone, "c_custkey", ["active"])


@query("select n_nationkey, array_to_string(list_sort(string_split(n_name, '')), '') as key, list_sum(list_transform(string_split(n_name, ''), lambda c: unicode(c)))::bigint % 3 as tier from nation")
def f01_letters_key(t):
    return t("nation").select("n_nationkey", R.letters_key(F.col("n_name")).alias("key"), (C.additive_hash(F.col("n_name")) % 3).cast("bigint").alias("tier"))


@query("select p_partkey, regexp_matches(p_name, '^[A-Za-z][A-Za-z0-9]*$') as name_ok, regexp_matches(trim(p_size::varchar), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') as number_ok from part")
def f08_tests(t):
    return t("part").select("p_partkey", C.is_identifier(F.col("p_name")).alias("name_ok"), C.is_number(F.col("p_size").cast("string")).alias("number_ok"))


@query("select p_partkey, round_even(p_size / 2.0::double, 0) as half from part")
def f17_half_even(t):
    return t("part").select("p_partkey", F.rint(F.col("p_size") / 2).alias("half"))


@query("select c_custkey, case when c_acctbal < 0 then '-$' else '$' end || format('{:,.2f}', abs(c_acctbal)) as money from customer")
def f19_currency(t):
    return t("customer").select("c_custkey", C.usd(F.col("c_acctbal")).alias("money"))


@query("select c_custkey, '+551' || lpad(c_custkey::varchar, 6, '0') || '77' as phone from customer")
def f21_phone(t):
    text = F.concat(F.lit("(1"), F.substring(F.lpad(F.col("c_custkey").cast("string"), 6, "0"), 1, 2), F.lit(") "), F.substring(F.lpad(F.col("c_custkey").cast("string"), 6, "0"), 3, 4), F.lit("-77"))
    return t("customer").select("c_custkey", C.phone(text).alias("phone"))


@query("select page_id, substr(url, strpos(url, ':') + 1, greatest(strpos(url, '/') - strpos(url, ':'), 0)) as part, array_to_string(string_split(url, '/')[2:-2], ', ') as crumbs from pages")
def f22_between(t):
    return t("pages").select("page_id", C.between_markers(F.col("url"), ":", "/").alias("part"), C.breadcrumb(F.col("url")).alias("crumbs"))


@query("select page_id, trim(regexp_replace(html, '\\s+', ' ', 'g')) as text from pages")
def f25_collapse(t):
    return t("pages").select("page_id", C.collapse(F.col("html")).alias("text"))


@query("select page_id, replace(replace(url, 'http', 'h'), 'h', 'g') as url2 from pages")
def f28_replace_all(t):
    return t("pages").select("page_id", C.replace_all(F.col("url"), [("http", "h"), ("h", "g")]).alias("url2"))


@query("")
def f30_chunks(t):
    return t("documents").select("doc_id", S.chunked(C.sentences(F.col("text"))).alias("chunks"))


@query("select p_partkey, regexp_extract(p_type, '^[a-zA-Z\\s]+') as prefix from part")
def f34_alpha_prefix(t):
    return t("part").select("p_partkey", C.alpha_prefix(F.col("p_type")).alias("prefix"))


@query("select n_nationkey, n_nationkey::int as hours from nation")
def f36_hours(t):
    return t("nation").select("n_nationkey", C.hours_ago(F.concat("n_nationkey", F.lit(" hours ago"))).alias("hours"))


@query("select event_id, strftime(ts + interval 90 minute, '%Y-%m-%d %H:%M') as later from events")
def f37_later(t):
    return t("events").select("event_id", F.date_format(F.expr("ts + interval 90 minutes"), "yyyy-MM-dd HH:mm").alias("later"))


@query("select n_nationkey, (1000 + n_nationkey)::varchar as number from nation")
def f42_first_number(t):
    return t("nation").select("n_nationkey", C.first_number(F.concat(F.format_number(F.col("n_nationkey") + 1000, 0), F.lit(" items"))).alias("number"))


@query("select n_nationkey, 'k=' || n_nationkey || '&r=' || n_regionkey as qs from nation")
def f45_query_string(t):
    return t("nation").select("n_nationkey", C.query_string(F.create_map(F.lit("k"), F.col("n_nationkey").cast("string"), F.lit("r"), F.col("n_regionkey").cast("string"))).alias("qs"))


@query("select n_nationkey, range(0, n_nationkey + 1) as r from nation")
def c06_range(t):
    return t("nation").select("n_nationkey", F.sequence(F.lit(0).cast("bigint"), F.col("n_nationkey").cast("bigint")).alias("r"))


@query("select n_nationkey, round_even((1 - 2 / 3::double) * n_nationkey + 2 / 3::double * n_regionkey, 0)::int as pixel from nation")
def i07_resize(t):
    image = F.array(F.array("n_nationkey", "n_regionkey"), F.array("n_regionkey", "n_nationkey"))
    return t("nation").select("n_nationkey", F.get(F.get(S.resize(image, 3, 3), F.lit(0)), F.lit(1)).alias("pixel"))


@query("select n_nationkey, least(power(n_nationkey - 5, 2), power(n_regionkey - 5, 2))::double as distance, case when abs(n_nationkey - 5) <= abs(n_regionkey - 5) then 0 else 1 end as x from nation")
def i08_best_match(t):
    found = S.best_match(F.array(F.array("n_nationkey", "n_regionkey")), F.array(F.array(F.lit(5))))
    return t("nation").select("n_nationkey", found.alias("m")).select("n_nationkey", "m.distance", "m.x")


@query("select n_nationkey, [[3, n_nationkey], [4, n_regionkey]] as r, [[n_regionkey, 4], [n_nationkey, 3]] as l from nation")
def i09_rotate(t):
    image = F.array(F.array("n_nationkey", "n_regionkey"), F.array(F.lit(3), F.lit(4)))
    return t("nation").select("n_nationkey", C.rotate(image, "R").alias("r"), C.rotate(image, "L").alias("l"))


@query("with recursive w(k, position) as (select n_nationkey, 0 from nation where n_nationkey = 1 union all select n.n_nationkey, position + 1 from w join nation n on n.n_nationkey = k + 3) select n.n_nationkey, n_name, position from w join nation n on n.n_nationkey = k")
def s17_linked_pages(t):
    chain = t("nation").withColumn("after", F.col("n_nationkey") + 3)
    return paged.linked(chain, 1, "n_nationkey", "after").select("n_nationkey", "n_name", "position")


@query("")
def t05_cache(t):
    kind = F.when(F.col("event_type") == "error", "update").when(F.col("event_type") == "purchase", "get").otherwise("put")
    ops = t("events").select(F.col("user_id").cast("bigint").alias("key"), F.col("event_id").cast("bigint").alias("seq"), kind.alias("op"), F.pmod("event_id", F.lit(13)).cast("bigint").alias("cid"), (F.pmod("event_id", F.lit(23)) * 10).cast("bigint").alias("size"), F.when(F.col("event_id") % 2 == 0, "lru").otherwise("mru").alias("policy"))
    return cache.simulate(ops)


@query("select event_id, case event_type when 'click' then 'site' when 'view' then 'one' else 'multi' end as handler from events")
def x07_dispatch(t):
    return R.lookup(t("events"), "event_type", {"click": "site", "view": "one"}, "handler", "multi").select("event_id", "handler")
