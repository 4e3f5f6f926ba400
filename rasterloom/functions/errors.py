"""Error codes, their HTTP status, and error structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..settings import (
    ERROR,
    MAX_DETAIL_CHARS,
    MAX_DETAIL_ENTRIES,
    MAX_REPORTED_ERRORS,
    MAX_WARNINGS,
    RETRYABLE_CODES,
    STATUS_BY_CODE,
)
from .numeric import bind


def error_status(code: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in STATUS_BY_CODE.items() for v in pair])
    return F.when(code.isNotNull(), F.try_element_at(table, code))


def is_retryable(code: Column) -> Column:
    return F.when(code.isNotNull(), code.isin(*RETRYABLE_CODES))


def error_codes(spark: SparkSession) -> DataFrame:
    """The code table as a dimension for joins in SQL."""
    rows = [(code, status, code in RETRYABLE_CODES) for code, status in STATUS_BY_CODE.items()]
    return spark.createDataFrame(rows, "code string, status int, retryable boolean")


def bounded_details(details: Column) -> Column:
    """At most ten entries; keys and values cut to 200 characters; the last of equal keys stays."""
    cut = F.transform(
        F.slice(F.map_entries(details), 1, MAX_DETAIL_ENTRIES),
        lambda e: F.struct(
            F.substring(e["key"], 1, MAX_DETAIL_CHARS).alias("key"),
            F.substring(e["value"], 1, MAX_DETAIL_CHARS).alias("value"),
        ),
    )
    return F.map_from_entries(bind(cut, _last_of_equal_keys))


def _last_of_equal_keys(entries: Column) -> Column:
    return F.filter(
        entries,
        lambda e, i: ~F.exists(
            F.slice(entries, i + 2, MAX_DETAIL_ENTRIES), lambda later: later["key"] == e["key"]
        ),
    )


def error_struct(code: Column, message: Column, details: Column | None = None) -> Column:
    extra = F.lit(None).cast("map<string,string>") if details is None else bounded_details(details)
    return F.when(
        code.isNotNull(),
        F.struct(
            code.alias("code"),
            message.alias("message"),
            is_retryable(code).alias("retryable"),
            F.coalesce(extra, F.create_map().cast("map<string,string>")).alias("details"),
        ),
    ).cast(ERROR)


def present(*values: Column) -> Column:
    return F.filter(F.array(*values), lambda v: v.isNotNull())


def capped_warnings(warnings: Column) -> Column:
    return F.slice(warnings, 1, MAX_WARNINGS)


def first_errors(errors: Column) -> Column:
    """Up to five ``location: message`` texts in one line, null when there are none."""
    texts = F.transform(
        F.slice(errors, 1, MAX_REPORTED_ERRORS),
        lambda e: F.concat_ws(": ", e["location"], e["message"]),
    )
    return F.when(F.size(errors) > 0, F.array_join(texts, "; "))


def provider_error_code(status: Column) -> Column:
    """Error code for the HTTP status of a saved provider response, null when it succeeded."""
    return (
        F.when(status.isin(401, 403), "forbidden")
        .when(status == 429, "quota_exceeded")
        .when(status.isin(400, 415), "invalid_input")
        .when((status >= 500) | (status == 408), "provider_unavailable")
        .when(~status.isin(200, 201, 202), "provider_error")
    )


def operation_state(status: Column) -> Column:
    """State of a long-running analysis: ok, provider_error or pending."""
    word = F.lower(status)
    return (
        F.when(word.isin("succeeded", "completed"), "ok")
        .when(word.isin("failed", "canceled", "cancelled"), "provider_error")
        .when(F.coalesce(word, F.lit("")) == "", "provider_error")
        .otherwise("pending")
    )
