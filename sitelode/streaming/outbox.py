"""Event log and durable, ordered delivery as state over tables and streams."""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import iso_utc

LOG = logging.getLogger(__name__)

# What must be equal for equal results.
EVENT_FIELDS = {
    "page_discovered": ("url", "page_type", "structural_hash"),
    "page_extracted": ("url", "page_type", "element_count", "output_file"),
    "element_healed": ("element_key", "old_locator", "new_locator", "strategy_used", "confidence_score", "page_url"),
    "script_generated": ("backend", "style", "file_path", "element_count"),
    "run_complete": ("pages_discovered", "pages_extracted", "platform_detected", "manifest_path"),
    "login_failed": ("url", "reason", "screenshot_ref"),
    "roles_compared": ("roles", "diff_path", "differences"),
}
LOGIN_REASONS = ("mfa_required", "timeout", "selector_not_found", "auth_rejected")
RETRYABLE = (408, 429)
MAX_ATTEMPTS = 3


def event_fault(event: str = "event", run_id: str = "run_id", data: str = "data") -> Column:
    """Why an event doesn't match its schema, or null; data is a map."""
    keys = F.array_sort(F.coalesce(F.map_keys(data), F.array().cast("array<string>")))
    expected = F.create_map(*(x for k, v in EVENT_FIELDS.items() for x in (F.lit(k), F.array(*map(F.lit, sorted(v))))))[F.col(event)]
    return (
        F.when(expected.isNull(), "unknown event").when(F.coalesce(F.col(run_id), F.lit("")) == "", "no run id").when(F.size(F.array_except(expected, keys)) > 0, "missing fields")
        .when(F.size(F.array_except(keys, expected)) > 0, "unknown fields").when((F.col(event) == "login_failed") & ~F.coalesce(F.col(data)["reason"].isin(*LOGIN_REASONS), F.lit(False)), "unknown reason")
    )


def payload(event: str = "event", run_id: str = "run_id", ts: str = "ts", data: str = "data", role: str = "role") -> Column:
    """The event as compact JSON; role only where it is set."""
    return F.to_json(F.struct(F.col(event).alias("event"), F.col(run_id).alias("run_id"), iso_utc(ts).alias("timestamp"), F.col(data).alias("data"), F.nullif(F.col(role), F.lit("")).alias("role")))


def signature(secret: str | bytes, body: Column | str) -> Column:
    """sha256= and the body's HMAC-SHA256 in lowercase hex, JVM-side; null for a null body.

    The two pads made of the secret are literals of the plan: keep plans and event logs of signing jobs as the secret is kept.
    """
    key = secret.encode() if isinstance(secret, str) else secret
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    text = (F.col(body) if isinstance(body, str) else body).cast("binary")
    return F.concat(F.lit("sha256="), F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, text), 256))), 256))


def validated(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events that match their schema, the others with a reason)."""
    marked = events.withColumn("reason", event_fault())
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def outcomes(responses: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """(delivery_id, outcome, attempts, error) of a response log (delivery_id, n, status); a null status is a network error."""
    ok, again = F.col("status").between(200, 399), F.col("status").isNull() | (F.col("status") >= 500) | F.col("status").isin(*RETRYABLE)
    kind = F.when(ok, "delivered").when(again, "retry").otherwise("rejected")
    error = F.when(ok, F.lit(None)).when(F.col("status").isNull(), "network error").otherwise(F.concat(F.lit("HTTP "), F.col("status").cast("string")))
    tries = responses.where(F.col("n") <= max_attempts).withColumn("o", F.struct("n", kind.alias("kind"), error.alias("error")))
    ended = F.min(F.when(F.col("o.kind") != "retry", F.col("o")))
    last = F.coalesce(ended, F.max("o"))
    return tries.groupBy("delivery_id").agg(last.alias("o")).select("delivery_id", F.col("o.kind").alias("outcome"), F.col("o.n").alias("attempts"), F.col("o.error").alias("error"))


def deliver(outbox: DataFrame, responses: DataFrame) -> DataFrame:
    """The outbox after a round of deliveries, strictly oldest first.

    A rejected entry is dead and blocks nothing; a retryable failure keeps its entry pending and all after it untouched.
    """
    tried = outbox.where("status = 'pending'").join(outcomes(responses).withColumnRenamed("attempts", "tries"), "delivery_id", "left").withColumn("outcome", F.coalesce("outcome", F.lit("retry")))
    stop = tried.where("outcome = 'retry'").agg(F.min("seq")).first()[0]  # one number
    moved = tried if stop is None else tried.where(F.col("seq") <= stop)
    moved = moved.select("delivery_id", "outcome", F.col("tries").alias("_more"), F.col("error").alias("_error"))
    status = F.when(F.col("outcome") == "delivered", "delivered").when(F.col("outcome") == "rejected", "dead").otherwise(F.col("status"))
    rows = outbox.join(moved, "delivery_id", "left").withColumn("status", status).withColumn("attempts", F.col("attempts") + F.coalesce("_more", F.lit(0))).withColumn("last_error", F.coalesce("_error", "last_error"))
    return rows.select(outbox.columns)


def retry_dead(outbox: DataFrame) -> DataFrame:
    return outbox.withColumn("status", F.when(F.col("status") == "dead", "pending").otherwise(F.col("status")))


def next_pending(outbox: DataFrame) -> DataFrame:
    return outbox.where("status = 'pending'").orderBy("seq").limit(1)


def counts(outbox: DataFrame) -> DataFrame:
    return outbox.groupBy("status").agg(F.count("*").alias("n"))


def received_once(stream: DataFrame, watermark: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Deliveries with repeats of a delivery_id within the watermark left out."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark).dropDuplicatesWithinWatermark(["delivery_id"])


def fan_out(stream: DataFrame, sinks: list[Callable[[DataFrame, int], None]], checkpoint: str):
    """Every batch to every sink; a batch is read once. Returns the running query, which ends with what is there.

    A sink that fails is logged and left out of that batch; it neither stops the stream nor keeps the others from theirs.
    """

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                try:
                    sink(batch, number)
                except Exception:
                    LOG.exception("a sink failed on batch %s", number)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
