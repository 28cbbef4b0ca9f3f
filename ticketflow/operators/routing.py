"""Routing with the risk override."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import ESCALATION_RISK, POLICY_REASON, STANDARD_REASON
from ..functions.rules import percent
from .joins import route_by_rule


def escalation_reason(category: Column, by_rule: Column, by_risk: Column, risk: Column) -> Column:
    """Fixed format; the rule's text says "Critical" for every escalating rule."""
    parts = F.concat_ws(" + ",
                        F.when(by_rule, F.concat(F.lit("Critical "), category, F.lit(" incident"))),
                        F.when(by_risk, F.concat(F.lit("SLA breach risk "), percent(risk))))
    return F.when(by_rule | by_risk, F.when(parts == "", POLICY_REASON).otherwise(parts)).otherwise(STANDARD_REASON)


def triage_route(df: DataFrame, risk: str = "sla_risk", threshold: float = ESCALATION_RISK) -> DataFrame:
    """Add team, escalation and its reason. High risk escalates where the rule does not."""
    by_rule, by_risk = F.col("rule_escalate"), F.col("sla_escalated")
    return (route_by_rule(df)
            .withColumn("sla_escalated", F.coalesce(F.col(risk) >= threshold, F.lit(False)) & ~by_rule)
            .withColumn("auto_escalate", by_rule | by_risk)
            .withColumn("escalation_reason", escalation_reason(F.col("category"), by_rule, by_risk, F.col(risk)))
            .drop("rule_escalate"))
