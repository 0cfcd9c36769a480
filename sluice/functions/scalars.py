"""Scalar rules: numbers, paths, URLs and reproducible jitter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(v: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """v within [low, high]; null for NaN, which Spark orders above everything."""
    return F.when(~F.isnan(v), F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), v)))


def normalize_path(path: Column) -> Column:
    """'' becomes '/'; a leading slash is put where it is missing."""
    p = F.coalesce(path, F.lit(""))
    return F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))


def normalize_base(base: Column) -> Column:
    """Base URL without trailing slashes."""
    return F.regexp_replace(F.coalesce(base, F.lit("")), "/+$", "")


def build_url(base: Column, endpoint: Column, path: Column) -> Column:
    """Base joined to the request's endpoint if it has one, else to the queue's path."""
    return F.concat(normalize_base(base), normalize_path(F.coalesce(F.nullif(endpoint, F.lit("")), path)))


def jitter(key: Column, salt: Column) -> Column:
    """Uniform number in [0, 1) that is a function of its arguments."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), salt.cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0


#: DuckDB form of `jitter`.
JITTER_SQL = "(cast('0x' || substr(md5({key} || ':' || {salt}), 1, 8) as ubigint)::double / 4294967296.0)"


def request_token(key: Column, submitted: Column, seed: str) -> Column:
    """Token of one submission, the same on every recomputation."""
    return F.md5(F.concat_ws("|", key, submitted.cast("string"), F.lit(seed)))


def signed_url_expiry(url: Column) -> Column:
    """Unix seconds at which a signed URL expires; null if it isn't signed or any part fails to parse.

    A date with seconds of validity wins; if that pair is there and malformed, the plain expiry is not tried.
    """
    part = lambda name: F.nullif(F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1), F.lit(""))
    date, lasting, plain = part("X-Goog-Date"), part("X-Goog-Expires"), part("Expires")
    ok = date.rlike(r"^\d{8}T\d{6}Z$") & lasting.rlike(r"^\d{1,9}$")
    digits = lambda a, n: F.substring(date, a, n)
    day = F.concat(digits(1, 4), F.lit("-"), digits(5, 2), F.lit("-"), digits(7, 2))
    of_day = digits(10, 2).cast("long") * 3600 + digits(12, 2).cast("long") * 60 + digits(14, 2).cast("long")
    start = F.datediff(F.when(ok, day).try_cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.when(ok, of_day)
    v4 = F.when(ok, start + lasting.cast("long"))
    v2 = F.when(plain.rlike(r"^\d{1,12}$"), plain.cast("long"))
    return F.when(date.isNotNull() | lasting.isNotNull(), v4).otherwise(v2)
