"""Progress, estimates and messages, as expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Progress at each stage, advice by stage, kinds of connection failures.
STAGES = {"start": 0, "read": 10, "check": 20, "parse": 30, "plan": 40, "translate": 45, "write": 97, "done": 100}
ADVICE = {
    "read_source": "Check the path of the source, whether it is in use, and that it is UTF-8.",
    "parse_document": "Check that the document is complete and well formed; in XML, that every element is closed.",
    "model_config": "Check base_url, api_key and model in the settings.",
    "glossary": "Check that the glossary is a UTF-8 JSON array whose items hold source and target.",
    "check_connection": "Check the address, the key, the network and the proxy.",
    "translate": "Look up the batch and segment ids in the log.",
    "write_output": "Check the rights of the output folder and whether the target is in use.",
    "unknown": "Look up the last stage in the log.",
}
LIMITED_ADVICE = "The service limits its rate (429); try again later."
CONNECTION = (
    ("authentication", ("HTTP 401", "HTTP 403", "UNAUTHORIZED", "FORBIDDEN", "INVALID API KEY", "INCORRECT API KEY", "AUTHENTICATION", "AUTHORIZATION")),
    ("address", ("HTTP 404", "NOT FOUND", "NO ROUTE", "/CHAT/COMPLETIONS", "/MESSAGES")),
    ("rate_limit", ("HTTP 429", "RATE LIMITED", "TOO MANY REQUESTS", "THROTTL")),
    ("timeout", ("TIMED OUT", "TIMEOUT", "READ TIMEOUT", "CONNECTTIMEOUT", "READTIMEOUT")),
    ("certificate", ("CERTIFICATE", "SSL", "TLS", "CERT VERIFY FAILED")),
    ("unreachable", ("NAME OR SERVICE NOT KNOWN", "GETADDRINFO", "NODENAME", "DNS", "CONNECTION REFUSED", "FAILED TO ESTABLISH A NEW CONNECTION", "NO CONNECTION COULD BE MADE", "NETWORK IS UNREACHABLE")),
    ("server", ("HTTP 500", "HTTP 502", "HTTP 503", "HTTP 504", "INTERNAL SERVER ERROR", "BAD GATEWAY", "SERVICE UNAVAILABLE", "GATEWAY TIME-OUT")),
    ("incomplete", ("BASE_URL IS REQUIRED", "API_KEY IS REQUIRED", "MODEL IS REQUIRED", "不能为空")),
)


def batch_progress(done: Column, total: Column, running: bool = False) -> Column:
    """45 to 95 by finished batches; one more, to 94, while one runs."""
    at = F.least(F.lit(95), 45 + F.ceil(done / total * 50)).cast("long")
    return F.least(F.lit(94), at + 1).cast("long") if running else at


def folder_progress(place: Column, total: Column) -> Column:
    return F.floor((place - 1) / total * 100).cast("long")


def remaining_seconds(batches: DataFrame, *, size: int, run: str = "run_id", order: str = "batch_index", seconds: str = "seconds", left: str = "remaining_segments") -> DataFrame:
    """batches with ``eta``: the mean time of a segment in the last 5 batches times the
    segments left; 0 if none are."""
    last = W.partitionBy(run).orderBy(order).rowsBetween(-4, 0)
    each = F.sum(seconds).over(last) / (F.count(F.lit(1)).over(last) * size)
    return batches.withColumn("eta", F.when(F.col(left) <= 0, F.lit(0.0)).otherwise(each * F.col(left)))


def elapsed(seconds: Column) -> Column:
    """12.3s, MM:SS or HH:MM:SS."""
    whole = F.floor(seconds).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours, minutes, rest = F.floor(whole / 3600).cast("long"), F.floor(whole % 3600 / 60).cast("long"), whole % 60
    wide = F.when(hours < 100, two(hours)).otherwise(hours.cast("string"))
    return F.when(seconds < 60, F.concat(F.format_number(seconds, 1), F.lit("s"))).when(hours > 0, F.concat_ws(":", wide, two(minutes), two(rest))).otherwise(F.concat_ws(":", two(minutes), two(rest)))


def advice(stage: Column, message: Column) -> Column:
    up = F.upper(message)
    limited = (F.contains(up, F.lit("429")) & F.contains(up, F.lit("TOO MANY REQUESTS"))) | F.contains(up, F.lit("HTTP 429"))
    return F.when(limited, LIMITED_ADVICE).otherwise(F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in ADVICE.items() for x in pair)), stage), F.lit("")))


def connection_failure(message: Column) -> Column:
    """The first kind whose words a message holds."""
    up = F.upper(message)
    out = F.lit("unknown")
    for kind, words in reversed(CONNECTION):
        out = F.when(reduce(or_, (F.contains(up, F.lit(w)) for w in words)), kind).otherwise(out)
    return out


def run_metrics(translations: DataFrame) -> DataFrame:
    """Counters of a run, from the rows of its translations."""
    return translations.agg(
        F.count(F.lit(1)).alias("total_segments"),
        F.count_if(F.col("error_code").isNull()).alias("translated"),
        F.sum("retries").alias("retry_attempts"),
        F.sum("splits").alias("split_batches"),
        F.sum("rescues").alias("rescued_segments"),
        F.max("round").alias("rate_limit_rounds"),
    )


def benchmark_rollup(files: DataFrame, by: list[str] | None = None) -> DataFrame:
    """files(ok, segments, batches, retries, backoffs, cached, seconds) as one row, or one
    for each of ``by``: sums over what succeeded, and seconds a file over all."""
    good = lambda c: F.coalesce(F.sum(F.when(F.col("ok"), F.col(c))), F.lit(0)).alias(f"total_{c}")
    return files.groupBy(*by or []).agg(F.count(F.lit(1)).alias("files"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), *map(good, ("segments", "batches", "retries", "backoffs", "cached")), (F.sum("seconds") / F.count(F.lit(1))).alias("avg_file_seconds"))


def corpus_report(files: DataFrame) -> DataFrame:
    """files(document_type, direction, stage, ok, segments, ...) summed in one pass for each
    type and direction, each type, each failure stage and all: ``level`` tells which, and
    columns that a level sums over are null. ``stage`` is null for files that succeeded."""
    kinds = [F.col(c) for c in ("document_type", "direction", "stage")]
    sets = [kinds[:2], kinds[:1], [kinds[2]], []]
    summed = files.groupingSets(sets, *kinds).agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("files"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.coalesce(F.sum("segments"), F.lit(0)).cast("long").alias("segments"))
    level = F.when(F.col("g") == 1, "type and direction").when(F.col("g") == 3, "type").when(F.col("g") == 6, "stage").otherwise("all")
    return summed.select(level.alias("level"), *("document_type", "direction", "stage"), "files", "succeeded", "failed", "segments")
