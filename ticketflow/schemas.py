"""One explicit schema per layer."""

from pyspark.sql.types import (
    ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField,
    StructType, TimestampType,
)

_str = StringType()
_strings = ArrayType(_str)


def _schema(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


BRONZE = _schema(
    ticket_id=_str, source=_str, created_at=_str, subject=_str, body=_str, labels_raw=_strings,
    comments=_strings, category=_str, priority=_str, routing_team=_str, customer_tier=_str,
)

ISSUE_PAGE = StructType([
    StructField("title", _str), StructField("body", _str),
    StructField("labels", ArrayType(StructType([StructField("name", _str)]))),
    StructField("state", _str), StructField("created_at", _str), StructField("closed_at", _str),
    StructField("comments_url", _str), StructField("number", LongType()),
    StructField("pull_request", StructType([StructField("url", _str)])),
])

GITHUB_RAW = _schema(
    title=_str, body=_str, labels=_strings, state=_str, created_at=_str, closed_at=_str, comments_url=_str,
    repo=_str, issue_number=LongType(), is_pull_request=BooleanType(),
)

SUPPORT_A_RAW = _schema(subject=_str, body=_str, queue=_str, type=_str)

SUPPORT_B_RAW = StructType([
    StructField("Ticket Subject", _str), StructField("Combined Text", _str), StructField("Ticket Type", _str),
])

SILVER = _schema(
    ticket_id=_str, source=_str, created_at=TimestampType(), subject=_str, body=_str, category=_str,
    priority=_str, routing_team=_str, labels_raw=_strings, pii_flags=_str, reopen_count=IntegerType(),
    customer_tier=_str, comments=_strings,
)

VECTORS = _schema(
    ticket_id=_str, embedding=ArrayType(FloatType()), split=_str, category=_str, priority=_str, subject=_str,
)

TRIAGE_LOG = _schema(
    id=LongType(), ts=TimestampType(), ticket_id=_str, subject=_str, category=_str, priority=_str,
    routing_team=_str, auto_escalate=IntegerType(), sla_risk=DoubleType(), confidence=DoubleType(),
    total_ms=DoubleType(), classify_ms=DoubleType(), retrieve_ms=DoubleType(), rag_ms=DoubleType(),
    run_rag=IntegerType(),
)

HITS = ArrayType(_schema(rank=IntegerType(), ticket_id=_str, similarity=DoubleType(), category=_str,
                         priority=_str, subject=_str))

METRICS = _schema(run_id=_str, kind=_str, name=_str, value=_str)
