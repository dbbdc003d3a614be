"""Queries of text, number, date and image functions. Registered as those of `registry`."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions import calculator as K
from lattica.functions import columns as C
from lattica.plans.registry import query
from lattica.sources import media


@query("select p_partkey, p_size % 3 <> 0 as valid from part")
def f05_valid_infix(t):
    text = F.when(F.col("p_size") % 3 == 0, F.concat("p_size", F.lit(" + * 2"))).otherwise(F.concat(F.lit("( "), "p_size", F.lit(" - 1 ) / 2")))
    return t("part").select("p_partkey", K.is_valid(text).alias("valid"))


@query("select p_partkey, p_size % 2 = 0 as valid, case when p_size % 2 = 0 then p_size::double || ' 2.0 + 3.0 *' end as postfix from part")
def f06_postfix(t):
    text = F.concat(F.lit("( "), "p_size", F.when(F.col("p_size") % 2 == 0, " + 2 ) * 3").otherwise(" + ) * 3"))
    return t("part").select("p_partkey", K.is_valid(text).alias("valid"), K.to_postfix(text).alias("postfix"))


@query("select n_nationkey, 'a = ' || n_nationkey as first, n_nationkey::double as a1, n_nationkey * 2.0::double + 1 as b2, 3 as n from nation")
def f11_snapshots(t):
    program = F.concat(F.lit("a = "), "n_nationkey", F.lit(" ; b = a * 2 + 1 ; return b"))
    x = t("nation").select("n_nationkey", K.run_snapshots(program).alias("s"))
    at = lambda i: F.get("s", F.lit(i))
    return x.select("n_nationkey", at(0)["statement"].alias("first"), at(0)["names"]["a"].alias("a1"), at(1)["names"]["b"].alias("b2"), F.size("s").alias("n"))


@query("select vec_id, list_transform(embedding[2:4], lambda x, i: x * case when i = 1 then 2 else 3 end) as scaled from embeddings")
def f20_vector_product(t):
    return t("embeddings").select("vec_id", C.vector_product(F.col("embedding"), 1, 3, F.array(F.lit(2).cast("float"), F.lit(3).cast("float"))).alias("scaled"))


@query("select doc_id, len(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)))::int as n from documents where text is not null")
def f29_sentences(t):
    return t("documents").where("text is not null").select("doc_id", F.size(C.sentences(F.col("text"))).alias("n"))


@query("select p_partkey, case when length(p_name) <= 8 then [p_name] else string_split(p_name, ' ') end as lines from part")
def f31_wrap(t):
    return t("part").select("p_partkey", C.wrap(F.col("p_name"), 8).alias("lines"))


@query("select c_custkey, '\"' || c_name || '\"' as value from customer")
def f33_quoted(t):
    return t("customer").select("c_custkey", C.quoted_value(F.concat(F.lit('dup key: { name: "'), "c_name", F.lit('" }, "x"'))).alias("value"))


@query("with d as (select event_id, ts::date as today, make_date(year(ts), (1 + event_id % 12)::int, (1 + event_id % 28)::int) as this, make_date(year(ts) + 1, (1 + event_id % 12)::int, (1 + event_id % 28)::int) as later from events) select event_id, date_diff('day', today + 1, case when this >= today then this else later end) <= 31 as soon from d")
def f35_soon(t):
    day = F.concat_ws("/", 1 + F.col("event_id") % 28, 1 + F.col("event_id") % 12)
    return t("events").select("event_id", (C.days_until(day, F.to_date("ts")) <= 31).alias("soon"))


@query("select vec_id, [a, b, c, a, c] as copies from (select vec_id, (vec_id % 1)::double as a, -1.5::double as b, 2.0::double as c from embeddings) where false union all select n_nationkey, list_concat(list_transform(range(n_nationkey), lambda i: n_nationkey::double), case when n_nationkey = 0 then [0.0::double] else [] end, [-1.5::double, -1.5::double]) from nation")
def f41_replicate(t):
    return t("nation").select(F.col("n_nationkey").cast("bigint").alias("vec_id"), C.replicate(F.array(F.col("n_nationkey").cast("double"), F.lit(-1.5))).alias("copies"))


@query("select page_id, replace(replace(split_part(url, '/', 3), 'www.', ''), '.com', '') as host from pages")
def f43_host(t):
    return t("pages").select("page_id", C.host_name(F.get(F.split("url", "/"), F.lit(2))).alias("host"))


@query("select n_nationkey, n_name as name, 'N/A' as region from nation")
def f44_cells(t):
    m = C.cells_map(F.array(F.lit("name"), F.lit("x"), F.lit("region"), F.lit(""), F.lit("name"), F.col("n_name"), F.lit("last")))
    return t("nation").select("n_nationkey", m["name"].alias("name"), m["region"].alias("region"))


@query("select n_nationkey, substr(sha256('5:' || n_nationkey), 1, 16) as token, 6 as code_length from nation")
def f46_token(t):
    return t("nation").select("n_nationkey", C.random_token(5, 16, F.col("n_nationkey")).alias("token"), F.length(C.random_code(5, F.col("n_nationkey"))).alias("code_length"))


@query("select page_id, 'page-' || substr(sha256('1:' || page_id), 1, 8) || '-1700000000000.png' as file from pages")
def f47_file_name(t):
    return t("pages").select("page_id", C.file_name(F.lit("page"), C.random_token(1, 8, F.col("page_id")), F.lit(1700000000000), F.lit("image/png")).alias("file"))


@query("select n_nationkey, n_name as token from nation")
def f48_hidden_field(t):
    html = F.concat(F.lit('<form><input type="hidden" name="csrf" id="a" value="'), "n_name", F.lit('"><input name="b" value="c"></form>'))
    return t("nation").select("n_nationkey", C.hidden_field(html, "csrf").alias("token"))


@query("select conv_id, turn, role in ('assistant', 'system') as allowed from conversations")
def f49_roles(t):
    return t("conversations").select("conv_id", "turn", F.col("role").isin("assistant", "system").alias("allowed"))


@query("select conv_id, turn, '- From: ' || role || chr(10) || '- Turn: ' || turn as message from conversations")
def f50_message(t):
    return t("conversations").select("conv_id", "turn", F.concat_ws("\n", F.concat(F.lit("- From: "), "role"), F.concat(F.lit("- Turn: "), "turn")).alias("message"))


@query("select page_id, split_part(array_to_string(string_split(url, '/')[-2:], '/'), '.', 1) as tail from pages")
def f51_path_tail(t):
    return t("pages").select("page_id", C.path_tail(F.col("url")).alias("tail"))


@query("select event_id, strftime(ts + interval 3600 second, '%Y-%m-%d %H:%M:%S') as expires from events")
def f52_expires(t):
    return t("events").select("event_id", F.date_format(C.expires_at(F.col("ts"), F.lit(3600)), "yyyy-MM-dd HH:mm:ss").alias("expires"))


def _image(t):
    """A 4x4 image of an embedding's first values, 0 to 255; a value is multiplied as the float that it is, a whole number would make it a double."""
    v = lambda y, x: F.pmod(F.floor(F.get("embedding", F.lit(4 * y + x)) * F.lit(1000).cast("float")), F.lit(256)).cast("int")
    return t("embeddings").select("vec_id", F.array(*[F.array(*[v(y, x) for x in range(4)]) for y in range(4)]).alias("image"))


_PIXELS = "with p as (select vec_id, list_transform(embedding[1:16], lambda x: (((floor(x * 1000::float)::bigint % 256) + 256) % 256)::int) as v from embeddings) "


@query(_PIXELS + "select vec_id, v[6] as red, 255 - v[6] as green, 7 as blue, true as same from p")
def i01_channels(t):
    colour = F.transform("image", lambda row: F.transform(row, lambda v: F.array(v, 255 - v, F.lit(7))))
    x = _image(t).select("vec_id", colour.alias("c")).withColumn("parts", C.channels(F.col("c")))
    at = lambda i: F.get(F.get(F.get("parts", F.lit(i)), F.lit(1)), F.lit(1))
    return x.select("vec_id", at(0).alias("red"), at(1).alias("green"), at(2).alias("blue"), (C.combine(F.col("parts")) == F.col("c")).alias("same"))


@query(_PIXELS + "select vec_id, round_even((v[1] + v[2] + v[3] + v[5] + v[6] + v[7] + v[9] + v[10] + v[11]) / 9.0::double, 0)::int as inner_pixel, round_even((5 * v[1] + v[1] + v[2] + v[5] + v[6]) / 9.0::double, 0)::int as corner from p")
def i05_box_blur(t):
    blurred = C.convolve(F.col("image"), [[1 / 9] * 3] * 3)
    x = _image(t).select("vec_id", blurred.alias("b"))
    return x.select("vec_id", F.get(F.get("b", F.lit(1)), F.lit(1)).alias("inner_pixel"), F.get(F.get("b", F.lit(0)), F.lit(0)).alias("corner"))


@query(_PIXELS + "select vec_id, round_even((v[1] + v[2] + v[5] + v[6]) / 4.0::double, 0)::int as middle, v[16] as last from p")
def i06_bilinear(t):
    at = lambda y, x: C.bilinear(F.col("image"), F.lit(y), F.lit(x))
    return _image(t).select("vec_id", at(0.5, 0.5).alias("middle"), at(3.0, 3.0).alias("last"))


@query("select n_nationkey, n_nationkey + 1 as n, 1.0::double / ((n_nationkey + 1) * (n_nationkey + 1)) as weight from nation")
def i04_box_kernel(t):
    k = F.array_repeat(F.array_repeat(1.0 / F.pow(F.col("n_nationkey") + 1, F.lit(2)), F.col("n_nationkey") + 1), F.col("n_nationkey") + 1)
    return t("nation").select("n_nationkey", F.size(k).alias("n"), F.get(F.get(k, F.lit(0)), F.lit(0)).alias("weight"))


@query(_PIXELS + "select vec_id, 4 as height, 4 as width, v[1] as first, v[16] as last from p")
def s20_image_round_trip(t):
    """Images to PNG and back."""
    x = _image(t).select("vec_id", media.pixels(media.png(F.col("image"))).alias("p"))
    at = lambda y, x_: F.get(F.get("p", F.lit(y)), F.lit(x_))
    return x.select("vec_id", F.size("p").alias("height"), F.size(F.get("p", F.lit(0))).alias("width"), at(0, 0).alias("first"), at(3, 3).alias("last"))


@query("select n_nationkey, 2 as n_lines, 16 as height from nation")
def k15_text_image(t):
    x = t("nation").select("n_nationkey", C.wrap(F.concat("n_name", F.lit(" of somewhere")), 12).alias("lines"))
    return x.select("n_nationkey", F.size("lines").alias("n_lines"), F.size(media.pixels(media.text_png(F.col("lines"), 8))).alias("height"))
