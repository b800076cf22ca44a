"""Conversions and small formulas: dates, booleans, numbers, bytes, hashes, JSON, delays, grades."""
from __future__ import annotations

from collections.abc import Sequence

from millrace.session import cut
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Date formats in the order they are tried, each with the texts it may read.
DATE_FORMATS = (
    ("yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"), ("yyyy/M/d", r"^\d{4}/\d{1,2}/\d{1,2}$"), ("M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("yyyy-M-d'T'H:m:s", r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$"),
    ("yyyy-M-d H:m:s", r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"),
)
DATE_LOOKS = (r"\d{4}-\d{2}-\d{2}", r"\d{4}/\d{2}/\d{2}", r"\d{2}/\d{2}/\d{4}", r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}")
TRUE_WORDS = ("true", "1", "yes", "y", "on")
BOOLEAN_WORDS = ("true", "false", "1", "0", "yes", "no")


def is_missing(col: Column, dtype: T.DataType, empty_is_missing: bool = True) -> Column:
    """Null, NaN and (unless told otherwise) the empty string."""
    out = col.isNull()
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        out = out | F.isnan(col)
    if empty_is_missing and isinstance(dtype, T.StringType):
        out = out | F.coalesce(col == "", F.lit(False))
    return out


def parse_date(col: Column) -> Column:
    """First of five formats that reads the whole text, as ISO text; null when none does."""
    tries = [F.when(col.rlike(rx), F.try_to_timestamp(col, F.lit(fmt))) for fmt, rx in DATE_FORMATS]
    return F.date_format(F.coalesce(*tries), "yyyy-MM-dd'T'HH:mm:ss")


def looks_like_date(col: Column) -> Column:
    return F.coalesce(col.rlike("^(?:" + "|".join(DATE_LOOKS) + ")"), F.lit(False))


def is_number(col: Column) -> Column:
    return col.try_cast("double").isNotNull()


def to_bool(col: Column) -> Column:
    return F.lower(F.trim(col)).isin(*TRUE_WORDS)


def to_number(col: Column, buckets: int = 10000) -> Column:
    """Number of a text, a hash bucket for other text, 0 for null."""
    hashed = F.pmod(F.xxhash64(col), F.lit(buckets)).cast("double")
    return F.when(col.isNull(), 0.0).otherwise(F.coalesce(col.try_cast("double"), hashed))


def _one_digit(x: Column) -> Column:
    return F.call_function("format_number", x, F.lit("0.0"))


def human_bytes(n: Column) -> Column:
    units = ("B", "KiB", "MiB", "GiB", "TiB")
    out = F.concat(_one_digit(n / float(1024 ** 4)), F.lit(" TiB"))
    for i in (3, 2, 1):
        out = F.when(n < float(1024 ** (i + 1)), F.concat(_one_digit(n / float(1024 ** i)), F.lit(f" {units[i]}"))).otherwise(out)
    return F.when(n < 1024, F.concat(n.cast("bigint").cast("string"), F.lit(" B"))).otherwise(out)


def human_number(n: Column) -> Column:
    return F.format_number(n.cast("bigint"), 0)


def human_percent(x: Column) -> Column:
    return F.concat(_one_digit(x), F.lit("%"))


def strip_data_url(col: Column) -> Column:
    at = F.instr(col, ";base64,")
    return F.when(col.startswith("data:") & (at > 0), F.substring(col, at + 8, F.length(col))).otherwise(col)


def decode_base64(col: Column) -> Column:
    """Bytes of base64 text (a data URL is accepted); null when it does not decode."""
    return F.try_to_binary(strip_data_url(col), F.lit("base64"))


def first_json_object(col: Column) -> Column:
    """The text from the first ``{`` to the last ``}``, parsed; null when it does not parse."""
    return F.try_parse_json(F.nullif(F.regexp_extract(col, r"(?s)(\{.*\})", 1), F.lit("")))


def maintainability(complexity: Column, lines: Column) -> Column:
    raw = (F.lit(171.0) - 0.23 * complexity - 16.2 * F.log(lines + 1)) * 100 / 171
    return F.when(lines == 0, 100.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)))


def letter_grade(score: Column) -> Column:
    out = F.lit("F")
    for grade, at_least in (("D", 20), ("C", 40), ("B", 60), ("A", 80)):
        out = F.when(score >= at_least, grade).otherwise(out)
    return out


# Status codes worth another delivery attempt.
RETRY_STATUS = (429, 500, 502, 503, 504)


def retry_delay(attempt: Column, kind: str = "exponential", base: float = 1.0, factor: float = 2.0, cap: float = 60.0) -> Column:
    """Delay before an attempt (1-based), without jitter."""
    delay = {
        "exponential": F.lit(base) * F.pow(F.lit(factor), attempt - 1),
        "linear": F.lit(base) + F.lit(factor) * (attempt - 1),
        "constant": F.lit(base) + attempt * 0,
    }[kind]
    return F.greatest(F.lit(0.0), F.least(delay, F.lit(cap)))


def age_in_years(birth: Column, as_of: Column) -> Column:
    return F.floor(F.months_between(as_of, birth) / 12).cast("int")


def is_new(created: Column, as_of: Column, days: int = 7) -> Column:
    return created > as_of - F.expr(f"INTERVAL {days} DAY")


# Field names that hold file content, a file name, a content type (all compared in lower case).
CONTENT_FIELDS = ("contentbytes", "content_bytes", "filebytes", "data", "content")
NAME_FIELDS = ("filename", "file_name", "name")
TYPE_FIELDS = ("contenttype", "content_type", "mimetype", "mime_type", "type")


def embedded_files(df: DataFrame, doc: str, keep: Sequence[str]) -> DataFrame:
    """Rows (keep, path, filename, content_type, content) of base64 file fields at any depth of a VARIANT.

    One round per level of nesting, each written out, until no value is left to open.
    """
    keep = list(keep)
    level = df.select(*keep, F.lit("$").alias("path"), F.col(doc).alias("_v"))
    found = None
    empty_map = F.create_map().cast("map<string,variant>")
    while True:
        level = cut(level, "level")
        if found is not None and level.isEmpty():
            return found
        fields = F.try_variant_get("_v", "$", "map<string,variant>")
        here = level.select(*keep, "path", F.coalesce(fields, empty_map).alias("_f"), F.try_variant_get("_v", "$", "array<variant>").alias("_a"))

        def held(names: Sequence[str]) -> Column:
            """First listed field that is present, whatever its case; null unless it holds text."""
            by_name = [F.get(F.filter(F.map_entries("_f"), _named(name)), F.lit(0))["value"] for name in names]
            return F.try_variant_get(F.coalesce(*by_name), "$", "string")

        hits = here.select(
            *keep, "path", held(NAME_FIELDS).alias("filename"), held(TYPE_FIELDS).alias("content_type"), held(CONTENT_FIELDS).alias("content")
        ).where((F.length("content") >= 32) & F.col("content").rlike(r"^[A-Za-z0-9+/=\r\n]+$"))
        found = hits if found is None else found.unionByName(hits)
        inner = F.concat(
            F.transform(F.map_entries("_f"), lambda e: F.struct(F.concat(F.col("path"), F.lit("."), e["key"]).alias("path"), e["value"].alias("_v"))),
            F.coalesce(
                F.transform("_a", lambda x, i: F.struct(F.concat(F.col("path"), F.lit("["), i.cast("string"), F.lit("]")).alias("path"), x.alias("_v"))),
                F.array().cast("array<struct<path:string,_v:variant>>"),
            ),
        )
        level = here.select(*keep, F.explode(inner).alias("_e")).select(*keep, "_e.path", "_e._v")


def _named(name: str):
    return lambda e: F.lower(e["key"]) == name
