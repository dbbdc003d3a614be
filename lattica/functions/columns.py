"""Column functions: hashes, numbers, text, arrays and maps; all of them built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def additive_hash(key: Column) -> Column:
    return F.aggregate(F.split(key, ""), F.lit(0), lambda a, c: a + F.ascii(c))


def weighted_hash(key: Column) -> Column:
    parts = F.transform(F.split(key, ""), lambda c, i: (i + 1) * F.ascii(c))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x)


def is_prime(n: Column) -> Column:
    odd = F.sequence(F.lit(3).cast("bigint"), F.greatest(F.floor(F.sqrt(n)), F.lit(3)), F.lit(2).cast("bigint"))
    return F.when(n.isin(2, 3), True).when((n < 2) | (n % 2 == 0), False).otherwise(~F.exists(odd, lambda d: (n % d == 0) & (d < n)))


def discounted(total: Column, percent: Column, digits: int = 2) -> Column:
    return F.round(total - total * percent / 100, digits)


def order_total(total: Column, reduced: Column, tax: Column, shipping: Column) -> Column:
    """A reduced total of 0 counts as none."""
    return tax + shipping + F.coalesce(F.nullif(reduced, F.lit(0.0)), total)


def one_decimal(x: Column) -> Column:
    return F.floor(x * 10 + 0.5) / 10


def clamp(x: Column, low: float = 0, high: float = 255) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def usd(x: Column) -> Column:
    return F.concat(F.when(x < 0, "-$").otherwise("$"), F.format_number(F.abs(x), 2))


def phone(x: Column, prefix: str = "+55") -> Column:
    return F.when(x == "N/A", x).otherwise(F.concat(F.lit(prefix), F.translate(x, "()- ", "")))


def between_markers(x: Column, first: str, last: str) -> Column:
    """From behind the first marker up to and with the last one."""
    a, b = F.instr(x, first), F.instr(x, last)
    return F.substring(x, a + 1, F.greatest(b - a, F.lit(0)))


def token(x: Column, sep: str, i: int) -> Column:
    """The i-th token from 0, from the end if negative; null out of range."""
    return F.try_element_at(F.split(x, sep), F.lit(i + 1 if i >= 0 else i))


def breadcrumb(x: Column) -> Column:
    a = F.split(x, "/")
    return F.when(F.size(a) >= 2, F.array_join(F.slice(a, F.lit(2), F.size(a) - 2), ", "))


def collapse(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def folder_name(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"(?U)[^\w.]+", "_"), "__+", "_")


def basename(url: Column) -> Column:
    return F.element_at(F.split(url, "/"), -1)


def replace_all(x: Column, tags: Sequence[tuple[str, str]]) -> Column:
    for tag, value in tags:
        x = F.replace(x, F.lit(tag), F.lit(value))
    return x


def sentences(x: Column) -> Column:
    return F.split(x, r"(?<=[.!?])\s+")


def slug(x: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(x), r"[^A-Za-z0-9.]+", "-"))


def is_number(x: Column) -> Column:
    return F.trim(x).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")


def is_identifier(x: Column) -> Column:
    return x.rlike(r"^\p{L}[\p{L}\p{N}]*$")


def alpha_prefix(x: Column) -> Column:
    return F.regexp_extract(x, r"^[a-zA-Z\s]+", 0)


def first_number(x: Column) -> Column:
    return F.regexp_replace(F.split(x, " ")[0], ",", "")


def hours_ago(x: Column) -> Column:
    return F.regexp_extract(x, r"(\d+)", 1).try_cast("int")


def hidden_field(html: Column, name: str) -> Column:
    return F.regexp_extract(html, rf'name="{name}"[^>]*value="([^"]*)"', 1)


def query_string(pairs: Column) -> Column:
    return F.array_join(F.transform(F.map_entries(pairs), lambda e: F.concat(e["key"], F.lit("="), F.url_encode(e["value"]))), "&")


def wrap(text: Column, width: int) -> Column:
    """Words in lines of at most width characters (a longer word has its own line)."""
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"))
    grown = lambda a, w: F.when(a["line"] == "", w).otherwise(F.concat(a["line"], F.lit(" "), w))
    step = lambda a, w: F.when(F.length(grown(a, w)) <= width, F.struct(a["lines"].alias("lines"), grown(a, w).alias("line"))).otherwise(
        F.struct(F.when(a["line"] == "", a["lines"]).otherwise(F.concat(a["lines"], F.array(a["line"]))).alias("lines"), w.alias("line"))
    )
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.aggregate(words, start, step, lambda a: F.when(a["line"] == "", a["lines"]).otherwise(F.concat(a["lines"], F.array(a["line"]))))


def json_or_text(x: Column, field: str, marker: str) -> Column:
    parsed = F.get_json_object(x, f"$.{field}")
    return F.coalesce(parsed, F.when(F.contains(x, F.lit(marker)), F.try_element_at(F.split(x, ": "), F.lit(2))))


def vector_product(row: Column, first: int, last: int, by: Column) -> Column:
    """Elements first..last (from 0) times those of `by` in step, its last one beyond its end."""
    return F.transform(F.slice(row, first + 1, last - first + 1), lambda x, i: x * F.get(by, F.least(i, F.size(by) - 1)))


def quoted_value(message: Column) -> Column:
    """What stands in the first pair of quotes of an error message."""
    return F.regexp_extract(message, r"""(["'])(\\?.)*?\1""", 0)


def days_until(day_month: Column, today: Column) -> Column:
    """Days from tomorrow to the next such d/m: of this year, or of the next one if that is past."""
    part = lambda i: F.try_element_at(F.split(day_month, "/"), F.lit(i)).try_cast("int")
    on = lambda year: F.try_make_date(year, part(2), part(1)) if hasattr(F, "try_make_date") else F.make_date(year, part(2), part(1))
    this = on(F.year(today))
    return F.datediff(F.when(this >= today, this).otherwise(on(F.year(today) + 1)), F.date_add(today, 1))


def host_name(x: Column) -> Column:
    """Without www. and .com."""
    return F.replace(F.replace(x, F.lit("www.")), F.lit(".com"))


def cells_map(cells: Column) -> Column:
    """Cells label, value, label, value, ... as a map; a missing or blank value is N/A, of equal labels the last counts."""
    pairs = F.transform(F.sequence(F.lit(0), F.floor((F.size(cells) - 1) / 2).cast("int")), lambda i: F.struct(F.get(cells, 2 * i).alias("key"), F.coalesce(F.nullif(F.get(cells, 2 * i + 1), F.lit("")), F.lit("N/A")).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.when(F.size(cells) > 0, F.map_from_entries(last)).otherwise(F.create_map().cast("map<string,string>"))


def random_token(seed: int, n: int, *keys: Column) -> Column:
    """n hex digits by seed and keys, the same in every run."""
    return F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]), 256), 1, n)


def random_code(seed: int, *keys: Column) -> Column:
    """Six digits, leading zeros kept."""
    return F.lpad(F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1000000)).cast("string"), 6, "0")


def file_name(prefix: Column, token: Column, millis: Column, mime: Column) -> Column:
    """prefix-token-millis.ext; the extension is what follows the slash of the type."""
    return F.concat(F.concat_ws("-", prefix, token, millis.cast("string")), F.lit("."), F.element_at(F.split(mime, "/"), -1))


def path_tail(path: Column) -> Column:
    """The last two parts, up to the first dot."""
    return F.get(F.split(F.array_join(F.slice(F.split(path, "/"), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(1)), F.lit(2)), "/"), "[.]"), F.lit(0))


def expires_at(now: Column, seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds.cast("int"), now)


# arrays, from 0
def get_at(a: Column, i: Column) -> Column:
    return F.get(a, i)


def slice_at(a: Column, start: int, size: int) -> Column:
    """Null out of range, where the array has no such slice."""
    return F.when((F.lit(start) >= 0) & (F.lit(size) >= 0) & (F.lit(start) < F.size(a)) & (F.lit(start + size) <= F.size(a)), F.slice(a, start + 1, size))


def insert_at(a: Column, i: int, v: Column) -> Column:
    return F.when(F.lit(i).between(0, F.size(a)), F.concat(F.slice(a, 1, i), F.array(v), F.slice(a, i + 1, F.greatest(F.size(a) - i, F.lit(0)))))


def remove_at(a: Column, i: int) -> Column:
    return F.when(F.lit(i).between(0, F.size(a) - 1), F.filter(a, lambda _, j: j != i))


def swap_at(a: Column, i: int, j: int) -> Column:
    return F.transform(a, lambda x, k: F.when(k == i, F.get(a, F.lit(j))).when(k == j, F.get(a, F.lit(i))).otherwise(x))


def add_to_set(a: Column, v: Column) -> Column:
    return F.when(F.array_contains(a, v), a).otherwise(F.concat(a, F.array(v)))


def remove_first(a: Column, v: Column) -> Column:
    at = F.array_position(a, v)
    return F.filter(a, lambda _, i: i != at - 1)


def fold(a: Column, f, initial: Column | None = None) -> Column:
    """Left fold; without an initial value the first element is it; null if there is none."""
    if initial is not None:
        return F.aggregate(a, initial, f)
    return F.when(F.size(a) > 0, F.aggregate(F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))), F.get(a, F.lit(0)), f))


def replicate(a: Column) -> Column:
    """Each value v as often as it says: v times if it is a whole number above 0, once for 0, else twice."""
    n = lambda v: F.when((v > 0) & (v == F.floor(v)), v.cast("int")).when(v == 0, 1).otherwise(2)
    return F.flatten(F.transform(a, lambda v: F.array_repeat(v, n(v))))


def cart_total(lines: Column) -> Column:
    return F.aggregate(lines, F.lit(0.0), lambda a, p: a + p["price"] * p["count"])


# images: arrays of rows; colour images have arrays of channels as pixels
def gray(image: Column) -> Column:
    return F.transform(image, lambda row: F.transform(row, lambda p: F.rint(0.299 * F.get(p, F.lit(0)) + 0.587 * F.get(p, F.lit(1)) + 0.114 * F.get(p, F.lit(2))).cast("int")))


def channels(image: Column, n: int = 3) -> Column:
    one = lambda c: F.transform(image, lambda row: F.transform(row, lambda p: F.get(p, F.lit(c))))
    return F.array(*[one(c) for c in range(n)])


def combine(parts: Column, n: int = 3) -> Column:
    first = F.get(parts, F.lit(0))
    pixel = lambda y, x: F.array(*[F.get(F.get(F.get(parts, F.lit(c)), y), x) for c in range(n)])
    return F.transform(first, lambda row, y: F.transform(row, lambda _, x: pixel(y, x)))


def box_kernel(n: int) -> Column:
    return F.array_repeat(F.array_repeat(F.lit(1 / n**2), n), n)


def rotate(image: Column, direction: str) -> Column:
    """A quarter turn to R or L."""
    h, w = F.size(image), F.size(F.get(image, F.lit(0)))
    cell = lambda y, x: F.get(F.get(image, y), x)
    columns, rows = F.sequence(F.lit(0), w - 1), F.sequence(F.lit(0), h - 1)
    if direction == "R":
        return F.transform(columns, lambda x: F.transform(rows, lambda y: cell(h - 1 - y, x)))
    return F.transform(columns, lambda x: F.transform(rows, lambda y: cell(y, w - 1 - x)))


def bilinear(image: Column, y: Column, x: Column) -> Column:
    h, w = F.size(image), F.size(F.get(image, F.lit(0)))
    y0, x0 = F.floor(y).cast("int"), F.floor(x).cast("int")
    y1, x1 = F.least(y0 + 1, h - 1), F.least(x0 + 1, w - 1)
    at = lambda r, c: F.get(F.get(image, r), c)
    dy, dx = y - y0, x - x0
    return F.rint(at(y0, x0) * (1 - dx) * (1 - dy) + at(y1, x0) * (1 - dx) * dy + at(y0, x1) * dx * (1 - dy) + at(y1, x1) * dx * dy).cast("int")


def convolve(image: Column, kernel: Sequence[Sequence[float]]) -> Column:
    """Weighted mean over the neighbourhood (sum by the kernel's sum; just the sum if that is 0); pixels off the edge count as the centre; rounded half to even and clamped."""
    r = len(kernel) // 2
    whole = sum(map(sum, kernel)) or 1
    at = lambda a, b: F.get(F.get(image, a), b)
    total = lambda v, y, x: sum((F.coalesce(F.when((y + dy >= 0) & (x + dx >= 0), at(y + dy, x + dx)), v) * kernel[dy + r][dx + r] for dy in range(-r, r + 1) for dx in range(-r, r + 1)), F.lit(0.0))
    return F.transform(image, lambda row, y: F.transform(row, lambda v, x: clamp(F.rint(F.round(total(v, y, x) / whole, 9))).cast("int")))
