"""Payload transforms: registered column functions, form fields, signed-URL checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions.scalars import signed_url_expiry

TRANSFORMS: dict = {}


def register_transform(name: str, function) -> None:
    """Make a transform available: (body, columns by name) -> new body, or null where it doesn't apply."""
    TRANSFORMS[name] = function


def chain(names: list[str], body: Column, row: dict[str, Column]) -> Column:
    """The first transform that applies wins; without any the body is unchanged."""
    return F.coalesce(*(TRANSFORMS[n](body, row) for n in names), body)


def form_fields(payload: Column) -> tuple[Column, Column]:
    """(form fields, reject): strings unquoted, others as raw JSON, `gcs_uri` as `url`, inline files refused."""
    m = F.from_json(payload, "map<string,string>")
    reject = F.coalesce(F.try_element_at(m, F.lit("file_base64")), F.lit("")) != ""
    fields = F.transform_keys(F.map_filter(m, lambda k, v: ~k.isin("file_base64", "url") | (k == "url") & ~F.map_contains_key(m, "gcs_uri")), lambda k, v: F.when(k == "gcs_uri", "url").otherwise(k))
    return F.when(~reject, fields), reject


def preflight(url: Column, deadline: Column) -> Column:
    """Whether a signed URL expires by the deadline; no URL or unsigned: not fatal."""
    return F.coalesce(signed_url_expiry(url) <= deadline, F.lit(False))


def typed_number(text: Column, default: float) -> Column:
    """A parameter given as a number, a quoted number or an object with a value."""
    plain = F.regexp_replace(text, '^"(.*)"$', "$1").try_cast("double")
    return F.coalesce(plain, F.get_json_object(text, "$.value").try_cast("double"), F.lit(default))


def typed_map(text: Column) -> Column:
    """A parameter given as an object, or as a string that holds one in JSON; null for anything else. Values are text."""
    inner = F.try_variant_get(F.try_parse_json(text), "$", "string")  # unquotes a string, and gives an object's own text
    return F.coalesce(F.try_variant_get(F.try_parse_json(text), "$", "map<string,string>"), F.try_variant_get(F.try_parse_json(inner), "$", "map<string,string>"))


def selector(metric: str, labels: Column) -> Column:
    """Series text with sorted labels."""
    pairs = F.array_sort(F.transform(F.map_entries(labels), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))))
    return F.concat(F.lit(metric + "{"), F.array_join(pairs, ","), F.lit("}"))
