
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import calculator as K
from lattica.functions import columns as C
from lattica.operators import relational as R
from lattica.plans import query as Q
from lattica.sources import files
from lattica.streaming import presence

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "a01_grouped_avg_count"


class Tables:
    """The tables of a folder: t("name") reads one."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str, *names: str):
    """Register a function of `Tables` under its name, with its SQL."""

    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


@query("select o_orderkey, o_custkey, o_totalprice from orders where o_totalprice >= 200000 and o_orderstatus in ('F','O') and o_custkey < 900")
def p01_query_filter(t):
    return Q.fields(t("orders").where(Q.conditions(t("orders"), {"o_totalprice": {"gte": 200000}, "o_orderstatus": {"in": ["F", "O"]}, "o_custkey": {"lt": 900}, "page": 1})), "o_orderkey,o_custkey,o_totalprice")


@query("select c_custkey, c_name, c_nationkey from customer")
def p02_drop_fields(t):
    return Q.fields(t("customer"), "-c_acctbal,-c_mktsegment")


@query("select o_orderkey, o_totalprice from orders where o_custkey = 37")
def p03_parent_scope(t):
    return t("orders").where(F.col("o_custkey") == 37).select("o_orderkey", "o_totalprice")


@query("select p_partkey, p_name from part where regexp_matches(p_name, 'red|blue', 'i') or regexp_matches(p_type, 'brass', 'i')")
def p05_search(t):
    return Q.search(t("part"), "red|blue", ["p_name"]).unionAll(Q.search(t("part"), "brass", ["p_type"])).distinct().select("p_partkey", "p_name")


@query("select vec_id, list_filter(embedding, lambda x: x > 0.1) as kept from embeddings")
def p06_array_filter(t):
    return t("embeddings").select("vec_id", F.filter("embedding", lambda x: x > F.lit(0.1)).alias("kept"))


@query("select o_orderkey, list_transform([o_custkey, o_orderkey], lambda x: x * x) as squares from orders")
def p07_array_map(t):
    return t("orders").select("o_orderkey", F.transform(F.array("o_custkey", "o_orderkey"), lambda x: x * x).alias("squares"))


@query("select doc_id, source from documents where strlen(source) <= 4")
def p09_length_filter(t):
    return t("documents").where(F.length("source") <= 4).select("doc_id", "source")


@query("select event_id, event_type from events where contains(event_type, 'ch') or contains(event_type, 'sign')")
def p10_allow_list(t):
    return R.contains_any(t("events"), "event_type", ["ch", "sign"]).select("event_id", "event_type")


@query("select event_id, user_id from events e where not exists (select 1 from events f where f.user_id = e.user_id and f.ts <= e.ts and f.event_type = 'error')")
def p16_take_while(t):
    return R.take_while(t("events"), ["user_id"], ["ts"], F.col("event_type") != "error").select("event_id", "user_id")


@query("select o_orderkey, coalesce(nullif(o_orderstatus, 'P'), o_orderpriority) as label from orders")
def p17_default(t):
    return t("orders").select("o_orderkey", F.coalesce(F.nullif(F.col("o_orderstatus"), F.lit("P")), "o_orderpriority").alias("label"))


@query("select p_partkey, concat_ws(';', case when not p_size > 10 then 'size' end, case when not p_retailprice < 1500 then 'price' end, case when not p_brand <> 'Brand#11' then 'brand' end) as errors from part")
def p18_validation(t):
    rules = [(F.col("p_size") > 10, "size"), (F.col("p_retailprice") < 1500, "price"), (F.col("p_brand") != "Brand#11", "brand")]
    return R.validate(t("part"), rules).select("p_partkey", F.array_join("errors", ";").alias("errors"))


@query("select o_orderkey, c_name, c_mktsegment from orders left join customer on c_custkey = o_custkey")
def j01_populate(t):
    return R.populate(t("orders"), t("customer"), "o_custkey", "c_custkey", ["c_name", "c_mktsegment"]).select("o_orderkey", "c_name", "c_mktsegment")


@query("select c_custkey, n_name, r_name from customer left join nation on n_nationkey = c_nationkey left join region on r_regionkey = n_regionkey")
def j02_two_hops(t):
    x = R.populate(t("customer"), t("nation"), "c_nationkey", "n_nationkey", ["n_name", "n_regionkey"])
    return R.populate(x, t("region"), "n_regionkey", "r_regionkey", ["r_name"]).select("c_custkey", "n_name", "r_name")


@query("select n_nationkey, coalesce(k, '') as suppliers from nation left join (select s_nationkey, string_agg(s_suppkey::varchar, ',' order by s_suppkey) k from supplier group by 1) on s_nationkey = n_nationkey")
def j03_children(t):
    x = R.children(t("nation"), t("supplier"), "n_nationkey", "s_nationkey", ["s_suppkey"], "k")
    return x.select("n_nationkey", F.array_join(F.transform("k", lambda s: s["s_suppkey"].cast("string")), ",").alias("suppliers"))


@query("select o_orderkey, concat_ws(',', n1.n_name, n2.n_name) as names from orders left join nation n1 on n1.n_nationkey = o_orderkey % 31 left join nation n2 on n2.n_nationkey = o_custkey % 31")
def j04_array_refs(t):
    x = t("orders").select("o_orderkey", F.array(F.col("o_orderkey") % 31, F.col("o_custkey") % 31).alias("ids"))
    x = R.populate_array(x, "ids", t("nation"), "n_nationkey", "n_name", "names", "o_orderkey")
    return x.select("o_orderkey", F.array_join("names", ",").alias("names"))


@query("select distinct c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 400000)")
def j05_unseen(t):
    return R.unseen(t("customer").select("c_custkey"), t("orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("select p_partkey from part where exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity > 49)")
def j07_semi(t):
    return t("part").join(t("lineitem").where("l_quantity > 49"), F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("p_partkey")


@query("select o_orderkey, case when o_totalprice between 0 and 50000 then 'low' when o_totalprice between 40000 and 200000 then 'mid' end as tier from orders")
def j09_band(t):
    return R.band(t("orders"), "o_totalprice", [(0, 50000, "low"), (40000, 200000, "mid")], "tier").select("o_orderkey", "tier")


@query("select p_partkey, t.r_regionkey as tier from part, (select r_regionkey, r_regionkey * 9.0 as lo, r_regionkey * 9.0 + 15 as hi from region) t where p_size between lo and hi qualify row_number() over (partition by p_partkey order by t.r_regionkey) = 1")
def j09_band_table(t):
    tiers = t("region").select("r_regionkey", (F.col("r_regionkey") * 9.0).alias("lo"), (F.col("r_regionkey") * 9.0 + 15).alias("hi"))
    return R.band_join(t("part"), "p_size", tiers, "lo", "hi", "r_regionkey").select("p_partkey", F.col("r_regionkey").alias("tier"))


@query("select o_orderkey, case o_orderstatus when 'F' then 1 when 'O' then 2 else 0 end as code from orders")
def j10_lookup(t):
    return R.lookup(t("orders"), "o_orderstatus", {"F": 1, "O": 2}, "code", 0).select("o_orderkey", "code")


@query("select o_custkey, floor(avg(o_totalprice) * 10 + 0.5) / 10 as average, count(*) as quantity from orders group by 1")
def a01_grouped_avg_count(t):
    return R.ratings(t("orders"), "o_custkey", "o_totalprice")


@query("select count(*) as n from lineitem where l_quantity > 25")
def a02_filtered_count(t):
    return t("lineitem").where("l_quantity > 25").agg(F.count(F.lit(1)).alias("n"))


@query("select l_orderkey, round(sum(l_extendedprice * l_quantity), 2) as total from lineitem group by 1")
def a03_sum_of_products(t):
    return t("lineitem").groupBy("l_orderkey").agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_quantity")), 2).alias("total"))


@query("with n as (select p_brand, count(*) frequency from part group by 1) select p_brand, frequency from n where frequency = (select max(frequency) from n)")
def a04_modes(t):
    return R.modes(t("part"), "p_brand")


@query("select o_custkey, list_reduce(list_prepend(0::bigint, list(o_orderkey % 97 order by o_orderkey)), lambda a, x: (a * 31 + x) % 1000003) as folded from orders group by 1")
def a06_fold(t):
    x = t("orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("a"))
    return x.select("o_custkey", C.fold(F.transform("a", lambda k: k % 97), lambda a, k: (a * 31 + k) % 1000003, F.lit(0).cast("bigint")).alias("folded"))


@query("select l_suppkey, min(l_extendedprice) as least, max(l_extendedprice) as most from lineitem group by 1")
def a07_min_max(t):
    return t("lineitem").groupBy("l_suppkey").agg(F.min("l_extendedprice").alias("least"), F.max("l_extendedprice").alias("most"))


@query("select array_to_string(list_sort(string_split(n_name, '')), '') as key, string_agg(n_name, ',' order by n_nationkey) as words from nation group by 1")
def a08_anagrams(t):
    return R.anagrams(t("nation"), "n_name", "n_nationkey").select("key", F.array_join("words", ",").alias("words"))


@query("select count(distinct source) as groups, count(*) as n from documents")
def a09_counts(t):
    return t("documents").agg(F.countDistinct("source").alias("groups"), F.count(F.lit(1)).alias("n"))


@query("select user_id, bool_or(event_type = 'error') as failed from events group by 1")
def a13_exists(t):
    return t("events").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "error").alias("failed"))


@query("select r_regionkey, coalesce(string_agg(n_name, ', ' order by n_name), 'None') as names from region left join nation on n_regionkey = r_regionkey and n_nationkey > 5 group by 1")
def a14_text_with_default(t):
    x = t("region").join(t("nation").where("n_nationkey > 5"), F.col("n_regionkey") == F.col("r_regionkey"), "left").groupBy("r_regionkey")
    return x.agg(F.coalesce(F.nullif(F.array_join(F.sort_array(F.collect_list("n_name")), ", "), F.lit("")), F.lit("None")).alias("names"))


@query("select count(distinct c_custkey) as size, count(distinct c_custkey) / 1009.0 as table_load, 1009 - count(distinct c_custkey % 1009) as empty_buckets from customer")
def a15_load_statistics(t):
    return R.load_statistics(t("customer"), "c_custkey", F.col("c_custkey"), 1009)


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20 offset 40")
def w01_page(t):
    return Q.paginate(Q.order(t("orders"), "-o_totalprice,o_orderkey", ""), 3, 20).select("o_orderkey", "o_totalprice")


@query("select 3 as current_page, ceil(count(*) / 50.0)::bigint as pages, 3 * 50 < count(*) as has_next from orders")
def w02_page_meta(t):
    return t("orders").agg(F.lit(3).alias("current_page"), F.ceil(F.count(F.lit(1)) / 50).alias("pages"), (F.lit(150) < F.count(F.lit(1))).alias("has_next"))


@query("with a as (select *, row_number() over (partition by user_id order by ts) - row_number() over (partition by user_id, event_type order by ts) g from events), b as (select user_id, event_type, g, min(ts) s, count(*) length from a group by all) select user_id, row_number() over (partition by user_id order by s) as run, event_type, length from b")
def w03_runs(t):
    return R.runs(t("events"), ["user_id"], ["ts"], "event_type")


@query("select user_id, event_id from events qualify row_number() over (partition by user_id order by (event_type = 'purchase') desc, case when event_type = 'purchase' then -event_id else event_id end) = 1")
def w04_first_or_last_marked(t):
    return R.first_or_last_marked(t("events"), "user_id", "event_id", F.col("event_type") == "purchase").select("user_id", "event_id")


@query("select event_id, coalesce(last_value(case when event_type = 'purchase' then event_id end ignore nulls) over (partition by user_id order by ts rows unbounded preceding), first_value(case when event_type = 'purchase' then event_id end ignore nulls) over (partition by user_id order by ts rows between current row and unbounded following)) as bought from events")
def w05_fill_forward(t):
    x = t("events").withColumn("bought", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return R.fill_forward(x, ["user_id"], ["ts"], "bought").select("event_id", "bought")


@query("select event_id, value from (select *, max(value) over (partition by user_id order by ts rows between unbounded preceding and 1 preceding) top from events) where top is null or value > top")
def w07_high_water(t):
    return R.above_high_water(t("events"), ["user_id"], ["ts"], "value").select("event_id", "value")


@query("select c_custkey, c_acctbal from customer order by c_acctbal, c_custkey limit 15")
def o06_pop_min(t):
    return t("customer").orderBy("c_acctbal", "c_custkey").limit(15).select("c_custkey", "c_acctbal")


@query("select l_suppkey, arg_min(l_orderkey, l_extendedprice * 1e7 + l_orderkey) as order_key from lineitem group by 1")
def o08_arg_min(t):
    return t("lineitem").groupBy("l_suppkey").agg(F.min_by("l_orderkey", F.col("l_extendedprice") * 1e7 + F.col("l_orderkey")).alias("order_key"))


@query("select distinct l_shipdate::date::varchar as day from lineitem")
def u01_distinct(t):
    return t("lineitem").select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day")).distinct()


@query("select c_nationkey as k from customer union all select s_nationkey from supplier")
def u02_union_all(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).unionAll(t("supplier").select("s_nationkey"))


@query("select o_custkey, case when bool_or(o_orderstatus = 'F') then 'writer' else 'reader' end as role from orders group by 1")
def u05_roles(t):
    o = t("orders")
    return R.roles(o.where("o_orderstatus <> 'F'"), o.where("o_orderstatus = 'F'"), "o_custkey")


@query("select p_partkey, p_size as old_p_size, p_size + 1 as p_size from part where p_partkey % 3 = 0")
def u08_changed(t):
    new = t("part").withColumn("p_size", F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return R.changed(t("part"), new, "p_partkey", ["p_size"]).select("p_partkey", "old_p_size", "p_size")


@query("select user_id, event_id, value from events qualify row_number() over (partition by user_id order by ts desc) = 1")
def m01_last_wins(t):
    return R.last_wins(t("events"), "user_id", "ts").select("user_id", "event_id", "value")


@query("select user_id, value from (select * from events qualify row_number() over (partition by user_id order by ts desc) = 1) where event_type <> 'error'")
def m03_replay(t):
    ops = t("events").select("user_id", "ts", "value", F.when(F.col("event_type") == "error", "remove").otherwise("put").alias("op"))
    return R.replay(ops, "user_id", "ts").select("user_id", "value")


@query("select c_custkey, case when c_custkey % 7 = 0 then 0.0 else c_acctbal end as c_acctbal from customer union all select -1, 1.0")
def m07_upsert(t):
    old = t("customer").select("c_custkey", "c_acctbal")
    new = old.where("c_custkey % 7 = 0").withColumn("c_acctbal", F.lit(0.0))
    more = t("region").where("r_regionkey = 0").select(F.lit(-1).cast("bigint").alias("c_custkey"), F.lit(1.0).alias("c_acctbal"))
    return R.upsert(old, new.unionAll(more), "c_custkey")


@query("select p_partkey, 1000 - coalesce(n, 0) as stock, coalesce(n, 0) as sold from part left join (select l_partkey, sum(l_quantity) n from lineitem group by 1) on l_partkey = p_partkey")
def m08_increment(t):
    stock = t("part").select("p_partkey", F.lit(1000.0).alias("stock"), F.lit(0.0).alias("sold"))
    return R.increment(stock, t("lineitem"), "p_partkey", "l_partkey", "l_quantity", "stock", "sold")


@query("select n_nationkey, list_sum(list_transform(string_split(n_name, ''), lambda c: unicode(c))) as h1, list_sum(list_transform(string_split(n_name, ''), lambda c, i: i * unicode(c))) as h2 from nation")
def f02_hashes(t):
    return t("nation").select("n_nationkey", C.additive_hash(F.col("n_name")).cast("bigint").alias("h1"), C.weighted_hash(F.col("n_name")).cast("bigint").alias("h2"))


@query("select n_nationkey, ((n_nationkey + 2) * 3 - n_regionkey)::double as value from nation")
def f07_evaluate(t):
    return t("nation").select("n_nationkey", K.calculate(F.format_string("( %d + 2 ) * 3 - %d", "n_nationkey", "n_regionkey")).alias("value"))


@query("select n_nationkey, power(n_nationkey + 1.0, 2) - 4 as value from nation")
def f11_program(t):
    return t("nation").select("n_nationkey", K.run_program(F.format_string("x = %d + 1;y = x ^ 2;return y - 4", "n_nationkey")).alias("value"))


@query("select p_partkey, p_partkey >= 2 and not exists (select 1 from range(2, 200) r(d) where d < p_partkey and p_partkey % d = 0) as prime from part")
def f13_prime(t):
    return t("part").select("p_partkey", C.is_prime(F.col("p_partkey")).alias("prime"))


@query("select o_orderkey, round(o_totalprice - o_totalprice * 25 / 100, 4) as reduced, 5 + 7.5::double + o_totalprice as total from orders")
def f14_discount(t):
    return t("orders").select("o_orderkey", C.discounted(F.col("o_totalprice"), F.lit(25), 4).alias("reduced"), C.order_total(F.col("o_totalprice"), F.lit(0.0), F.lit(5.0), F.lit(7.5)).alias("total"))


@query("select c_custkey, least(255, greatest(0, c_acctbal)) as clamped, floor(c_acctbal * 10 + 0.5) / 10 as rounded from customer")
def f18_clamp_round(t):
    return t("customer").select("c_custkey", C.clamp(F.col("c_acctbal"), 0.0, 255.0).alias("clamped"), C.one_decimal(F.col("c_acctbal")).alias("rounded"))


@query("select page_id, string_split(url, '/')[3] as host, string_split(url, '/')[-1] as last from pages")
def f23_tokens(t):
    return t("pages").select("page_id", C.token(F.col("url"), "/", 2).alias("host"), C.basename(F.col("url")).alias("last"))


@query("select p_partkey, lower(regexp_replace(trim(p_name), '[^A-Za-z0-9.]+', '-', 'g')) as slug, regexp_replace(regexp_replace(p_type, '[^A-Za-z0-9_.]+', '_', 'g'), '__+', '_', 'g') as folder from part")
def f39_slug(t):
    return t("part").select("p_partkey", C.slug(F.col("p_name")).alias("slug"), C.folder_name(F.col("p_type")).alias("folder"))


@query("select doc_id, sha256(text) as digest from documents")
def f38_sha256(t):
    return t("documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("select event_id, (props->>'$.k')::bigint as k from events")
def s04_json_field(t):
    return t("events").select("event_id", C.json_or_text(F.col("props"), "k", "user:").cast("bigint").alias("k"))


@query("select page_id, array_to_string(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), ' ') as links from pages")
def s19_links(t):
    return files.links(t("pages")).select("page_id", F.array_join("links", " ").alias("links"))


@query("select doc_id, unnest(string_split(text, chr(10))) as line from documents")
def j14_explode_lines(t):
    return t("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))


@query("select vec_id, embedding[3:7] as part, embedding[1] as first, len(embedding) as n from embeddings")
def c02_slice(t):
    return t("embeddings").select("vec_id", C.slice_at(F.col("embedding"), 2, 5).alias("part"), C.get_at(F.col("embedding"), F.lit(0)).alias("first"), F.size("embedding").cast("bigint").alias("n"))


@query("select o_orderkey, [o_custkey, o_orderkey, 7, 9] as inserted, [o_orderkey, 9] as removed, [9, o_orderkey, o_custkey] as swapped from orders")
def m11_positional(t):
    a = F.array("o_custkey", "o_orderkey", F.lit(9).cast("bigint"))
    return t("orders").select("o_orderkey", C.insert_at(a, 2, F.lit(7).cast("bigint")).alias("inserted"), C.remove_at(a, 0).alias("removed"), C.swap_at(a, 0, 2).alias("swapped"))


@query("select user_id from events group by user_id having arg_max(event_type, (ts, event_type)) <> 'error'")
def t01_online(t):
    return presence.online(t("events"), "user_id", "ts", "event_type", closing="error")


@query("select event_id, user_id from events where ts > timestamp '2024-01-02 00:00:00'")
def t04_new_since(t):
    return presence.new_since(t("events"), "2024-01-02 00:00:00").select("event_id", "user_id")


@query("select n_nationkey, round_even(0.299::double * n_nationkey + 0.587::double * n_regionkey + 0.114::double * 50, 0) as luma from nation")
def i03_gray(t):
    pixel = F.array(F.array(F.array(F.col("n_nationkey"), F.col("n_regionkey"), F.lit(50))))
    return t("nation").select("n_nationkey", F.get(F.get(C.gray(pixel), F.lit(0)), F.lit(0)).cast("double").alias("luma"))


from lattica.plans import live, more, scans, shop, texts, whole  # noqa: E402,F401  (register further queries here)
