"""Scalar column expressions: keys, URLs, geography, safe arithmetic, display text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values the results must equal.
NULL_KEY = "_dbt_utils_surrogate_key_null_"
EARTH_RADIUS_MILES = 3961
KM_PER_MILE = 1.60934


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def surrogate_key(*columns: str | Column) -> Column:
    """md5 of the dash-joined texts, with a marker for NULL."""
    return F.md5(F.concat_ws("-", *[F.coalesce(_c(c).cast("string"), F.lit(NULL_KEY)) for c in columns]))


def hash_key64(*columns: str | Column) -> Column:
    """64-bit hash of the bar-joined texts; NULL counts as empty."""
    return F.xxhash64(F.concat_ws("|", *[F.coalesce(_c(c).cast("string"), F.lit("")) for c in columns]))


def md5_text(column: str | Column) -> Column:
    return F.md5(_c(column).cast("string"))


def _without_scheme(url: Column) -> Column:
    for scheme in ("android-app://", "http://", "https://"):
        url = F.replace(url, F.lit(scheme), F.lit(""))
    return url


def url_host(url: str | Column) -> Column:
    """Text after the scheme up to the first slash or question mark."""
    return F.substring_index(F.substring_index(_without_scheme(_c(url)), "/", 1), "?", 1)


def url_path(url: str | Column) -> Column:
    """Text after the first slash that follows the host, without the query; NULL when there is none."""
    rest = _without_scheme(_c(url))
    slash = F.instr(rest, "/")
    after = F.when(slash > 0, F.substring(rest, slash + 1, F.length(rest))).otherwise(F.lit(""))
    return F.nullif(F.substring_index(after, "?", 1), F.lit(""))


def url_parameter(url: str | Column, name: str) -> Column:
    """Value of one query parameter; NULL when missing or empty."""
    tail = F.split_part(_c(url), F.lit(f"{name}="), F.lit(2))
    return F.nullif(F.split_part(tail, F.lit("&"), F.lit(1)), F.lit(""))


def haversine_distance(lat1, lon1, lat2, lon2, unit: str = "mi") -> Column:
    """Great-circle distance in miles or kilometres."""
    if unit not in ("mi", "km"):
        raise ValueError("unit is mi or km")
    a1, o1, a2, o2 = (F.radians(_c(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), 2)
    miles = F.lit(2.0 * EARTH_RADIUS_MILES) * F.asin(F.sqrt(h))
    return miles * KM_PER_MILE if unit == "km" else miles


def width_bucket(value: str | Column, low, high, buckets: int) -> Column:
    """Equal-width bucket 1..n; 0 below the range and n + 1 from its upper end."""
    return F.width_bucket(_c(value), F.lit(float(low)), F.lit(float(high)), F.lit(buckets))


def safe_add(*columns: str | Column) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(_c(c), F.lit(0)) for c in columns])


def safe_subtract(*columns: str | Column) -> Column:
    return reduce(lambda a, b: a - b, [F.coalesce(_c(c), F.lit(0)) for c in columns])


def safe_divide(numerator: str | Column, denominator: str | Column) -> Column:
    """NULL when the divisor is zero."""
    return F.try_divide(_c(numerator), _c(denominator))


def log_natural(column: str | Column) -> Column:
    return F.ln(_c(column))


def uniform(seed: int) -> Column:
    """Uniform number in [0, 1), repeatable for a seed and partitioning."""
    return F.rand(seed)


# Date letters of to_char against Spark's patterns, longest first.
_TO_CHAR = [("YYYY", "yyyy"), ("MONTH", "MMMM"), ("Month", "MMMM"), ("HH24", "HH"), ("HH12", "hh"), ("Mon", "MMM"),
            ("MON", "MMM"), ("Day", "EEEE"), ("DDD", "DDD"), ("YY", "yy"), ("MM", "MM"), ("DD", "dd"), ("Dy", "E"),
            ("HH", "hh"), ("MI", "mm"), ("SS", "ss"), ("MS", "SSS"), ("AM", "a"), ("PM", "a"), ("Q", "Q")]


def date_pattern(pattern: str) -> str:
    """Translate a to_char date pattern; other letters are quoted."""
    out, i = "", 0
    while i < len(pattern):
        for sql, spark in _TO_CHAR:
            if pattern.startswith(sql, i):
                out, i = out + spark, i + len(sql)
                break
        else:
            ch = pattern[i]
            out, i = out + (f"'{ch}'" if ch.isalpha() else ch), i + 1
    return out


def to_char(column: str | Column, pattern: str) -> Column:
    return F.date_format(_c(column).cast("timestamp"), date_pattern(pattern))


def to_date(column: str | Column, pattern: str = "YYYY-MM-DD") -> Column:
    return F.to_date(_c(column), date_pattern(pattern))


def day_of_week_monday(column: str | Column) -> Column:
    """1 for Monday to 7 for Sunday."""
    return F.weekday(_c(column).cast("date")) + 1


def json_property(column: str | Column, path: str, kind: str = "string") -> Column:
    """A property of JSON kept as text; `path` is dotted."""
    return F.get_json_object(_c(column), f"$.{path}").cast(kind)


def regexp_position(column: str | Column, pattern: str, start: int = 1, occurrence: int = 1, flags: str = "") -> Column:
    """Position (from 1) of the n-th match at or after `start`, 0 when there is none."""
    text = F.substring(_c(column), start, 2147483647)
    body = f"(?{flags}){pattern}" if flags else pattern
    if occurrence == 1:
        at = F.regexp_instr(text, F.lit(body))
    else:
        # length of the text up to the n-th match = everything matched lazily before it
        head = F.regexp_extract(text, f"(?s{flags})^((?:.*?(?:{pattern})){{{occurrence - 1}}}.*?)(?:{pattern})", 1)
        found = F.regexp_count(text, F.lit(body)) >= occurrence
        at = F.when(found, F.length(head) + 1).otherwise(F.lit(0))
    return F.when(at > 0, at + (start - 1)).otherwise(at)


# Steps of compact numbers.
_COMPACT = [(1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "K")]


def format_measure(column: str | Column, style: str = "number", decimals: int = 0, currency: str = "$",
                   unit: str = "") -> Column:
    """Display text: number, decimal, currency, percent or compact, with a unit suffix."""
    v = _c(column).cast("double")
    if style in ("number", "decimal"):
        text = F.format_number(v, decimals)
    elif style == "currency":
        sign = F.when(v < 0, "-").otherwise("")
        text = F.concat(sign, F.lit(currency), F.format_number(F.abs(v), decimals))
    elif style == "percent":
        text = F.concat(F.format_number(v * 100, decimals), F.lit("%"))
    elif style == "compact":
        text = F
        for step, letter in _COMPACT:
            text = text.when(F.abs(v) >= step, F.concat(F.format_number(v / step, decimals), F.lit(letter)))
        text = text.otherwise(F.format_number(v, decimals))
    else:
        raise ValueError(f"unknown style {style!r}")
    return F.concat(text, F.lit(unit)) if unit else text
