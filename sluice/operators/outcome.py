"""Attempt outcomes, retries with back-off, and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.maps import blank_to_null
from sluice.functions.scalars import jitter

RETRYABLE = ("RATE_LIMIT", "SERVER_ERROR")
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
_MONTH, _CLOCK = "(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)", r"(\d{2}):(\d{2}):(\d{2})"
HTTP_DATE = rf"^\w{{3}}, (\d{{2}}) {_MONTH} (\d{{4}}) {_CLOCK} GMT$"
DASHED_DATE = rf"^\w+day, (\d{{2}})-{_MONTH}-(\d{{2}}) {_CLOCK} GMT$"
PLAIN_DATE = rf"^\w{{3}} {_MONTH} ([ \d]\d) {_CLOCK} (\d{{4}})$"


def classify_http(status: Column, transport_error: Column, body_error: Column) -> Column:
    """Error category of an attempt; null for success."""
    return (
        F.when(transport_error, "UNKNOWN").when(body_error, "SERVER_ERROR").when(status == 429, "RATE_LIMIT").when(status.between(400, 499), "INVALID_REQ").when(status >= 500, "SERVER_ERROR")
    )


def fatal(category: Column) -> Column:
    return category.isNotNull() & ~category.isin(*RETRYABLE)


def sheddable(category: Column) -> Column:
    return F.coalesce(category == "RATE_LIMIT", F.lit(False))


def attempt_outcome(category: Column, status: Column) -> Column:
    """result: an HTTP response to pass on; error: no response; retry."""
    return F.when(category.isNull(), "result").when(fatal(category), F.when(status > 0, "result").otherwise("error")).otherwise("retry")


def parse_retry_after(text: Column, now: int, status: Column, body_error: Column) -> Column:
    """Seconds to wait: whole non-negative seconds or an HTTP date (past: 0); null otherwise and where the header isn't read.

    Dates in any of the three HTTP forms: `Sun, 06 Nov 1994 08:49:37 GMT`, `Sunday, 06-Nov-94 08:49:37 GMT` (years from 69 on are of
    the last century) and `Sun Nov  6 08:49:37 1994`.
    """
    number = F.when(text.rlike(r"^\d{1,9}$"), text.cast("long"))
    forms = ((HTTP_DATE, (1, 2, 3)), (DASHED_DATE, (1, 2, 3)), (PLAIN_DATE, (2, 1, 6)))
    ats = []
    for form, (day, month, year) in forms:
        part = lambda i, form=form: F.regexp_extract(text, form, i)
        y = part(year) if form != DASHED_DATE else F.concat(F.when(part(year) >= "69", "19").otherwise("20"), part(year))
        number_of_month = F.lpad(((F.instr(F.lit(MONTHS), part(month)) + 2) / 3).cast("int").cast("string"), 2, "0")
        date = F.concat(y, F.lit("-"), number_of_month, F.lit("-"), F.lpad(F.trim(part(day)), 2, "0")).try_cast("date")
        clock = (3, 4, 5) if form == PLAIN_DATE else (4, 5, 6)
        of_day = part(clock[0]).try_cast("long") * 3600 + part(clock[1]).try_cast("long") * 60 + part(clock[2]).try_cast("long")
        ats.append(F.when(text.rlike(form), F.datediff(date, F.lit("1970-01-01").cast("date")).cast("long") * 86400 + of_day))
    at = F.coalesce(*ats)
    read = (status == 429) | (status >= 500) | body_error
    return F.when(read, F.coalesce(number, F.when(at.isNotNull(), F.greatest(F.lit(0).cast("long"), at - now))))


def backoff_ceiling(left: Column, retry: Column) -> Column:
    """min(60, seconds left, 2 * 2^(retry + 1)); 0 with no time left."""
    return F.greatest(F.lit(0.0), F.least(F.lit(60.0), left.cast("double"), 2 * F.pow(F.lit(2.0), retry + 1)))


def backoff(left: Column, retry: Column, key: Column) -> Column:
    """Back-off in [t/2, t) of the ceiling t, the same on every recomputation."""
    t = backoff_ceiling(left, retry)
    return t / 2 + t / 2 * jitter(key, retry)


def with_retry_after(wait: Column, hint: Column, left: Column, key: Column, retry: Column) -> Column:
    """A larger hint from the server, within half the time left, spread by a quarter; never under the back-off."""
    hinted = F.greatest(wait, F.least(hint.cast("double"), left / 2.0) * (1 + jitter(F.concat(key, F.lit("#")), retry) / 4))
    return F.when(hint > wait, hinted).otherwise(wait)


def retry_or_exhaust(outcome: Column, left: Column, status: Column) -> Column:
    """What becomes of a retry: another attempt, or at the deadline the last response, or DEADLINE_EXCEEDED."""
    return F.when(outcome != "retry", outcome).when(left > 0, "retry").when(status > 0, "result").otherwise("DEADLINE_EXCEEDED")


def error_result(id_: Column, code: Column, message: Column) -> Column:
    """Result JSON of a request that got no response, so without a status code."""
    body = F.to_json(F.named_struct(F.lit("error"), message))
    return F.to_json(F.struct(id_.alias("id"), body.alias("payload"), code.alias("error_code"), message.alias("error_message")))


def error_text(category: Column, message: Column, dropped: Column, cause: Column) -> Column:
    """Text of an attempt's error: category, message, then the server's reason for dropping it and the cause, where there are any."""
    reason = F.coalesce(F.concat(F.lit(" (dropped: "), blank_to_null(dropped), F.lit(")")), F.lit(""))
    return F.concat(category, F.lit(": "), message, reason, F.coalesce(F.concat(F.lit(" (caused by: "), blank_to_null(cause), F.lit(")")), F.lit("")))


def dispatch(df: DataFrame, workers: int, client, schema: str, *, deadline: str | None = None, now: int | None = None) -> DataFrame:
    """Send each row by an injected client: an iterator of pandas frames to one of responses; `workers` connections at once.

    With a deadline column, rows whose deadline is not after `now` (by default the time of the query) are not sent, and the client sees
    `seconds_left` of the others, to bound its calls by.
    """
    if deadline:
        clock = F.lit(now).cast("long") if now is not None else F.unix_timestamp()
        df = df.withColumn("seconds_left", F.col(deadline) - clock).where("seconds_left > 0")
    return df.repartition(workers).mapInPandas(client, schema)


def redelivery(outcome: Column, now: Column, delivery: Column) -> tuple[Column, Column]:
    """(due_at, delivery_attempt) of a topic message: refused ones come back after 10 s, retries at once, others never."""
    due = F.when(outcome == "refused", now + 10).when(outcome == "retry", now)
    return due, F.when(due.isNotNull(), delivery + 1)
