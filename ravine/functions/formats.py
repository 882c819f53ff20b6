"""Formatters, identifiers and small parsers as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ravine.functions.text import col


def clock(seconds: Column | str) -> Column:
    """H:MM:SS, or M:SS below an hour."""
    s = F.floor(col(seconds)).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours, minutes = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60)
    return F.when(hours > 0, F.concat(hours.cast("string"), F.lit(":"), two(minutes), F.lit(":"), two(s % 60))).otherwise(F.concat(minutes.cast("string"), F.lit(":"), two(s % 60)))


def spelled(seconds: Column | str) -> Column:
    """`1h 2m 3s` without the parts that are zero; 0s for none or null."""
    s = F.floor(col(seconds)).cast("long")
    part = lambda x, unit: F.when(x > 0, F.concat(x.cast("string"), F.lit(unit)))
    words = F.concat_ws(" ", part(F.floor(s / 3600), "h"), part(F.floor(s % 3600 / 60), "m"), part(s % 60, "s"))
    return F.when(F.coalesce(words, F.lit("")) == "", "0s").otherwise(words)


#: Units of file sizes, 1024 apart.
SIZE_UNITS = ["Bytes", "KB", "MB", "GB"]


def file_size(size: Column | str) -> Column:
    """The largest unit with a value of 1 at least, with up to two digits: `1.5 KB`."""
    b, out = col(size).cast("double"), None
    for i in range(len(SIZE_UNITS) - 1, 0, -1):
        shown = F.concat(F.regexp_replace(F.round(b / 1024**i, 2).cast("string"), r"\.0$", ""), F.lit(f" {SIZE_UNITS[i]}"))
        out = F.when(b >= 1024**i, shown) if out is None else out.when(b >= 1024**i, shown)
    return out.otherwise(F.concat(F.regexp_replace(b.cast("string"), r"\.0$", ""), F.lit(f" {SIZE_UNITS[0]}")))


def currency(amount: Column | str) -> Column:
    """`$1,234.50`: two to four digits after the point."""
    a = F.round(col(amount), 4)
    shown = F.regexp_replace(F.format_number(F.abs(a), 4), "0{1,2}$", "")
    return F.concat(F.when(a < 0, "-$").otherwise("$"), shown)


def percentage(value: Column | str, digits: int = 0) -> Column:
    return F.concat(F.format_string(f"%.{digits}f", F.round(col(value).cast("double"), digits)), F.lit("%"))


def timestamp_url(url: Column | str, seconds: Column | str) -> Column:
    """The URL at a whole second."""
    return F.concat(col(url), F.lit("&t="), F.floor(col(seconds)).cast("long").cast("string"), F.lit("s"))


def thumbnail_url(doc: Column | str) -> Column:
    """A video document's thumbnail, from its id without the prefix."""
    return F.concat(F.lit("https://img.youtube.com/vi/"), F.replace(col(doc), F.lit("video_"), F.lit("")), F.lit("/maxresdefault.jpg"))


def slug(filename: Column | str) -> Column:
    """An id from a file name: other characters than letters, digits, - and _ as _, and eight hex
    digits of its SHA-256 (so that a rerun gives the same)."""
    base = F.regexp_replace(col(filename), r"(?<=[^/.])\.[^./]*$", "")
    return F.concat(F.regexp_replace(base, r"[^\p{L}\p{N}_-]", "_"), F.lit("_"), F.substring(F.sha2(col(filename), 256), 1, 8))


#: Patterns of a video id, in order.
VIDEO_ID = [r"(?:v=|/)([0-9A-Za-z_-]{11})", r"(?:embed/)([0-9A-Za-z_-]{11})", r"^([0-9A-Za-z_-]{11})$"]


def video_id(url: Column | str) -> Column:
    """The id in a video's URL; null without one."""
    return F.coalesce(*(F.nullif(F.regexp_extract(col(url), p, 1), F.lit("")) for p in VIDEO_ID))


def drive_id(url: Column | str) -> Column:
    """The file id in a drive URL of either form; null without one."""
    u = col(url)
    after = lambda mark: F.when(F.contains(u, F.lit(mark)), F.element_at(F.split(u, mark), 2))
    return F.coalesce(F.substring_index(after("/file/d/"), "/", 1), F.substring_index(after("id="), "&", 1))


#: Names of assets in captions.
ASSET_NAMES = {"figure": r"(Figure|Fig\.?)\s+(\d+(?:\.\d+)?)", "table": r"(Table|Tbl\.?)\s+(\d+(?:\.\d+)?)", "image": r"(Image|Img\.?)\s+(\d+(?:\.\d+)?)"}


def asset_number(text: Column | str, kind: str) -> Column:
    """`Figure 2.1` from a caption, the name capitalised; null without one."""
    name, number = (F.regexp_extract(col(text), "(?i)" + ASSET_NAMES[kind], k) for k in (1, 2))
    return F.when(number != "", F.concat_ws(" ", F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.substring(name, 2, 10))), number))


def without_fence(text: Column | str) -> Column:
    """A text that is wrapped in a code fence, without it."""
    t = col(text)
    inner = F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*(\n|$)", ""), r"(^|\n)[ \t]*```$", "")
    return F.btrim(F.when(t.startswith("```") & t.endswith("```") & (F.length(t) > 5), inner).otherwise(t), F.lit(" \n\t\r"))


def without_quotes(text: Column | str) -> Column:
    """A text that is wrapped in quotation marks of one kind, without them."""
    t = col(text)
    for q in ('"', "'"):
        t = F.when(t.startswith(q) & t.endswith(q) & (F.length(t) > 1), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)
    return t


def sentences(text: Column | str, longer: int = 20, k: int = 20) -> Column:
    """The first k sentences with more than ``longer`` characters, trimmed."""
    parts = F.transform(F.split(col(text), "[.!?]+"), lambda s: F.btrim(s, F.lit(" \n\t\r")))
    return F.slice(F.filter(parts, lambda s: F.length(s) > longer), 1, k)


def table_analysis(text: Column | str) -> tuple[Column, Column]:
    """Description and insights of a table's analysis: `DESCRIPTION: ...`, `INSIGHTS:`, `- ...` lines."""
    lines = F.transform(F.split(col(text), "\n"), lambda s: F.btrim(s))
    described = F.transform(F.filter(lines, lambda s: s.startswith("DESCRIPTION:")), lambda s: F.btrim(F.substring(s, 13, 1_000_000)))
    start = F.array_position(F.transform(lines, lambda s: s.startswith("INSIGHTS:")), True)
    after = F.filter(lines, lambda s, i: (start > 0) & (i >= start) & s.startswith("-"))
    insights = F.transform(after, lambda s: F.btrim(F.substring(s, 2, 1_000_000)))
    return F.coalesce(F.nullif(F.try_element_at(described, F.lit(-1)), F.lit("")), F.lit("Table data")), insights


def batch_summaries(text: Column | str, n: Column | int) -> Column:
    """`Type:` and `Summary:` pairs as (type, summary), padded to n with unknown ones."""
    pairs = F.regexp_extract_all(col(text), F.lit(r"(?m)^\s*Type:([^\n]*)\n(?:[^\n]*\n)*?\s*Summary:([^\n]*)"), F.lit(0))
    found = F.transform(pairs, lambda p: F.struct(F.lower(F.btrim(F.regexp_extract(p, r"Type:([^\n]*)", 1))).alias("type"), F.btrim(F.regexp_extract(p, r"Summary:([^\n]*)$", 1)).alias("summary")))
    found = F.filter(found, lambda x: (x["type"] != "") & (x["summary"] != ""))
    return F.slice(F.concat(found, F.array_repeat(F.struct(F.lit("unknown").alias("type"), F.lit("").alias("summary")), F.lit(n) if isinstance(n, int) else n)), F.lit(1), F.lit(n) if isinstance(n, int) else n)


def json_or(text: Column | str, schema: str, default: Column) -> Column:
    """A JSON value of a schema; the default where the text isn't one."""
    return F.coalesce(F.from_json(col(text), schema, {"mode": "PERMISSIVE"}), default)


def average_hash(pixels: Column | str) -> Column:
    """The hash of an 8 x 8 grey image: a bit for each pixel above their mean, as hex."""
    p = col(pixels)
    mean = F.aggregate(p, F.lit(0.0), lambda s, x: s + x.cast("double"), lambda s: s / F.size(p))
    bits = F.array_join(F.transform(p, lambda x: F.when(x.cast("double") > mean, "1").otherwise("0")), "")
    return F.lower(F.conv(bits, 2, 16))


def complexity(pixels: Column | str) -> Column:
    """The population variance of grey values over 10,000, 1 at most."""
    p = col(pixels)
    total = lambda f: F.aggregate(p, F.lit(0.0), lambda s, x: s + f(x.cast("double")))
    mean = total(lambda x: x) / F.size(p)
    return F.least(F.lit(1.0), (total(lambda x: x * x) / F.size(p) - mean * mean) / 10_000.0)
