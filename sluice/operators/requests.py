"""Rules on single requests and on the tables of a round: validity, defaults, retries, generations and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.maps import blank_to_null
from sluice.operators import lookups, ordering


# Validity and defaults.
def not_expired(df: DataFrame, now: int, deadline: str = "deadline") -> DataFrame:
    """Requests whose deadline is not past."""
    return df.where(F.col(deadline) >= now)


def validity(deadline: Column, now: int) -> Column:
    """Error code of a request that can't be dispatched: without a deadline or past it; null otherwise."""
    return F.when(deadline.isNull() | (deadline <= 0), "INVALID_REQUEST").when(deadline < now, "DEADLINE_EXCEEDED")


def dequeue_reject(value: Column) -> Column:
    """Why a popped message is dropped without a result: it can't be parsed, or has no deadline; null otherwise."""
    deadline = F.get_json_object(value, "$.deadline").try_cast("long")
    return F.when(F.try_parse_json(value).isNull(), "unparsable").when(F.coalesce(deadline, F.lit(0)) <= 0, "no deadline")


def default_routing(df: DataFrame, queue: str, queue_id: str) -> DataFrame:
    """Fills in the queue's name and id where they are null or empty."""
    return df.withColumns({"request_queue": F.coalesce(blank_to_null("request_queue"), F.lit(queue)), "queue_id": F.coalesce(blank_to_null("queue_id"), F.lit(queue_id))})


def effective_deadline(deadline: Column, now: Column, timeout: int) -> Column:
    """The earlier of the request's deadline (if it has one) and `timeout` seconds from now."""
    return F.least(now.cast("long") + timeout, F.when(deadline > 0, deadline))


def worker_count(workers: Column, default: int = 64) -> Column:
    """Configured number of workers; the default where it isn't positive."""
    return F.when(workers > 0, workers).otherwise(default)


def trace_parent(metadata: Column) -> tuple[Column, Column, Column]:
    """Trace id, span id and flags of a request's `traceparent`; nulls without one."""
    parts = F.split(F.try_element_at(metadata, F.lit("traceparent")), "-")
    return F.get(parts, F.lit(1)), F.get(parts, F.lit(2)), F.get(parts, F.lit(3))


def pool_or_default(pool: Column | str, default: str = "default") -> Column:
    """A queue's pool; the default pool where none is named."""
    return F.coalesce(blank_to_null(pool), F.lit(default))


# Retries and generations.
def due_retries(retries: DataFrame, now: int, most: int = 100, due: str = "due_at", tie: str = "event_id") -> DataFrame:
    """The `most` retries that have been due longest."""
    return retries.where(F.col(due) <= now).orderBy(due, tie).limit(most)


def reenter(due: DataFrame, waiting: DataFrame, budgets: DataFrame, batch: int, fallback: str) -> DataFrame:
    """Next requests per queue once due retries are back among the waiting ones; a retry without a queue goes to `fallback`."""
    back = due.withColumn("queue_id", F.coalesce(blank_to_null("queue_id"), F.lit(fallback)))
    return ordering.edf_topk(back.unionByName(waiting), budgets, batch)


def once_per_attempt(df: DataFrame) -> DataFrame:
    """One row per attempt (id, token, retry_count), however often it was put back."""
    return df.dropDuplicates(["id", "token", "retry_count"])


def unknown_queue(retries: DataFrame, cfg: DataFrame) -> DataFrame:
    """Retries whose queue is not configured."""
    return retries.join(cfg.select("queue_id"), "queue_id", "left_anti")


def open_generations(generations: DataFrame, done: DataFrame) -> DataFrame:
    """Generations (id, token) that stay once results came: a result removes its own generation only, never a newer one."""
    return generations.join(done.select("id", "token"), ["id", "token"], "left_anti")


def cancelled_outcome(df: DataFrame, markers: DataFrame, failed: Column, now: Column) -> DataFrame:
    """Adds outcome and due_at before dispatch: CANCELLED where a marker has the request's id and token; where the look-up failed, back to its queue a second later."""
    marks = markers.select("id", "token", F.lit(True).alias("_marked")).distinct()
    j = df.join(marks, ["id", "token"], "left")
    lost = F.col("_marked").isNull() & failed
    return j.withColumns({"outcome": F.when(F.col("_marked"), "CANCELLED").when(lost, "requeue"), "due_at": F.when(lost, now + 1)}).drop("_marked")


def match_results(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Requests with `finished` and `latency` of their result (id, finished), null while there is none."""
    return requests.join(results.select("id", "finished"), "id", "left").withColumn("latency", F.col("finished") - F.col("created"))


# Capacity.
def dispatchable(ready: Column, most: Column, budget: Column, baseline: float) -> Column:
    """Requests that the system takes: its capacity times what the budget leaves above the baseline."""
    return F.when(budget > baseline, ready * most * (budget - baseline)).otherwise(0.0)


def closing_point(ready: Column, most: Column, baseline: float) -> Column:
    """Running requests at which the gate closes."""
    return ready * (most * (1 - F.lit(baseline)))


def peak_per_pod(ticks: DataFrame, keys: list[str], load: str, ready: str) -> DataFrame:
    """Largest load per ready pod of each group; ticks without ready pods don't count."""
    return ticks.groupBy(*keys).agg(F.max(F.try_divide(F.col(load).cast("double"), F.col(ready))).alias("peak"))


def by_pool(df: DataFrame, cfg: DataFrame) -> DataFrame:
    """Queues and requests per pool; queues without a pool belong to the default one."""
    j = lookups.join_queue_config(df, cfg).withColumn("pool", pool_or_default("pool"))
    per = j.groupBy("pool", "queue_id").agg(F.count("*").alias("n"))
    return per.groupBy("pool").agg(F.count("*").alias("queues"), F.sum("n").alias("n"))


# Reports.
def outcome_counters(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counters per owner from attempts (outcome, status, category, retry_count, seconds_left)."""
    o, st = F.col("outcome"), F.col("status")
    return df.groupBy(*keys).agg(
        F.count_if(F.col("retry_count") == 0).alias("requests"), F.count_if(o == "retry").alias("retries"), F.count_if((o == "result") & (st < 400)).alias("success"),
        F.count_if((o == "error") | (o == "result") & (st >= 400)).alias("failed"), F.count_if(F.col("seconds_left") <= 0).alias("deadline"), F.count_if(F.col("category") == "RATE_LIMIT").alias("shed"),
    )


def backlog(pending: DataFrame, cfg: DataFrame) -> DataFrame:
    """Pending requests of every configured queue, 0 where there are none."""
    n = pending.groupBy("queue_id").agg(F.count("*").alias("pending"))
    return cfg.select("queue_id").join(n, "queue_id", "left").select("queue_id", F.coalesce("pending", F.lit(0)).alias("pending"))


def gate_decisions(decisions: DataFrame, cfg: DataFrame, reasons) -> DataFrame:
    """Decisions (queue_id, reason) counted for every configured queue and every reason, 0 where there are none."""
    d = decisions.where("reason is not null").groupBy("queue_id", "reason").agg(F.count("*").alias("n"))
    every = cfg.select("queue_id", F.explode(F.array(*map(F.lit, reasons))).alias("reason"))
    return every.join(d, ["queue_id", "reason"], "left").select("queue_id", "reason", F.coalesce("n", F.lit(0)).alias("n"))


def outcome_rates(df: DataFrame, keys: list[str], seconds: float, outcomes=("result", "retry", "error")) -> DataFrame:
    """Outcomes per second, a column each."""
    p = df.groupBy(*keys).pivot("outcome", list(outcomes)).count()
    return p.select(*keys, *((F.coalesce(c, F.lit(0)) / F.lit(float(seconds))).alias(c) for c in outcomes))


def throttle_rates(refused: DataFrame, cfg: DataFrame, width: int = 86400) -> DataFrame:
    """Refusals per second of each pool and window, for those that aren't over their quota."""
    j = lookups.join_queue_config(refused.where("class <> 'overflow'"), cfg)
    return j.groupBy("pool", (F.col("created") - F.col("created") % width).alias("start")).agg((F.count("*") / F.lit(float(width))).alias("rate"))


def load_summary(df: DataFrame, keys: list[str], start: str, end: str, saturation: str) -> DataFrame:
    """Time from the first start to the last end, and mean saturation over samples that are numbers."""
    number = F.when(~F.isnan(saturation), F.col(saturation))
    return df.groupBy(*keys).agg((F.max(end) - F.min(start)).alias("clearing"), F.avg(number).alias("mean_saturation"))


def conversation_body(turns: DataFrame, model: str) -> DataFrame:
    """Request body per conversation: the model, the number of turns and their roles in order. A conversation is one request, so its turns come together."""
    c = turns.where("role is not null").groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("turns"))
    return c.select("conv_id", "last_turn", F.to_json(F.struct(F.lit(model).alias("model"), "n", F.col("turns.role").alias("roles"))).alias("body"))
