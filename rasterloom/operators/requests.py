"""Roll-up of logged requests per time window, path and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import round_exact

# Statuses a caller may retry.
RETRYABLE_STATUS = (503, 504)


def request_rollup(
    requests: DataFrame, window: str = "1 hour", accuracy: int = 10_000
) -> DataFrame:
    """Calls, error and retryable shares, and durations; counts and sums merge before the shuffle."""
    failed = (F.col("status") >= 400).cast("int")
    retry = F.col("status").isin(*RETRYABLE_STATUS).cast("int")
    quantiles = F.percentile_approx("duration_ms", F.array(F.lit(0.5), F.lit(0.95)), accuracy)
    return (
        requests.groupBy(F.window("ts", window).alias("_w"), "path", "status")
        .agg(
            F.count("*").alias("calls"),
            F.avg(failed).alias("error_share"),
            F.avg(retry).alias("retryable_share"),
            F.avg("duration_ms").alias("_mean"),
            F.max("duration_ms").alias("max_ms"),
            quantiles.alias("_q"),
        )
        .select(
            F.col("_w.start").alias("window_start"),
            "path",
            "status",
            "calls",
            "error_share",
            "retryable_share",
            round_exact(F.col("_mean"), 4).alias("mean_ms"),
            "max_ms",
            F.get("_q", 0).alias("p50_ms"),
            F.get("_q", 1).alias("p95_ms"),
        )
    )


#: Size of the duration sketches. A quantile's rank is off by 0.3 % of the calls or less with 99 % confidence, also after merging.
SKETCH_SIZE = 1_000


def request_sketches(requests: DataFrame, window: str = "1 hour", size: int = SKETCH_SIZE) -> DataFrame:
    """What longer windows are rolled up from: counts, sums, and a mergeable KLL sketch of the durations per window, path and status."""
    return (
        requests.groupBy(F.window("ts", window).alias("_w"), "path", "status")
        .agg(
            F.count("*").alias("calls"),
            F.sum((F.col("status") >= 400).cast("int")).alias("failed"),
            F.sum(F.col("status").isin(*RETRYABLE_STATUS).cast("int")).alias("retryable"),
            F.count("duration_ms").alias("timed"),
            F.sum("duration_ms").alias("total_ms"),
            F.max("duration_ms").alias("max_ms"),
            F.kll_sketch_agg_double(F.col("duration_ms").cast("double"), size).alias("durations"),
        )
        .select(F.col("_w.start").alias("window_start"), *_STORED)
    )


_STORED = ("path", "status", "calls", "failed", "retryable", "timed", "total_ms", "max_ms", "durations")


def merged_rollup(stored: DataFrame, window: str = "1 day", size: int = SKETCH_SIZE) -> DataFrame:
    """The roll-up of longer windows from stored shorter ones; no request is read again. Windows without a duration have no quantiles."""
    merged = stored.groupBy(F.window("window_start", window).alias("_w"), "path", "status").agg(
        *[F.sum(c).alias(c) for c in ("calls", "failed", "retryable", "timed", "total_ms")],
        F.max("max_ms").alias("max_ms"),
        F.kll_merge_agg_double("durations", size).alias("durations"),
    )

    def quantile(rank: float) -> Column:
        return F.when(F.col("timed") > 0, F.kll_sketch_get_quantile_double("durations", F.lit(rank)))

    return merged.select(
        F.col("_w.start").alias("window_start"),
        "path",
        "status",
        "calls",
        (F.col("failed") / F.col("calls")).alias("error_share"),
        (F.col("retryable") / F.col("calls")).alias("retryable_share"),
        round_exact(F.col("total_ms") / F.col("timed"), 4).alias("mean_ms"),
        "max_ms",
        quantile(0.5).alias("p50_ms"),
        quantile(0.95).alias("p95_ms"),
    )
