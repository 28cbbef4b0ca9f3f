"""Prompt texts. The formats of context lines and answer objects are fixed; the wording is ours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import CATEGORIES, NO_CONTEXT, PRIORITIES, TEAMS

CLASSIFY_SYSTEM = "You assign support tickets to fixed classes and answer with one JSON object and nothing else."
CLASSIFY_HEAD = (
    "Choose one category, one priority and one routing team for the ticket below.\n"
    f"Categories: {', '.join(CATEGORIES)}\n"
    f"Priorities: {', '.join(PRIORITIES)}\n"
    f"Routing teams: {', '.join(TEAMS)}\n\n"
)
CLASSIFY_TAIL = (
    '\n\nAnswer with {"category": ..., "priority": ..., "routing_team": ..., '
    '"confidence": a number from 0 to 1, "reasoning": one sentence}'
)
ANSWER_SYSTEM = (
    "You help support agents. Rely on the earlier tickets you are shown and say so when they do not suffice."
)
ANSWER_TAIL = (
    "\n\nUsing the earlier tickets, state the first action, the likely cause, the steps to resolve it, "
    "and whether and to which team to escalate."
)
JUDGE_TAIL = '\n\nAnswer with {"score": a number from 0 to 1, "reason": a short explanation}'


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def classify_prompt(subject: Column, body: Column) -> Column:
    return F.concat(
        F.lit(CLASSIFY_HEAD),
        F.lit("Ticket Subject: "), F.substring(_text(subject), 1, 500),
        F.lit("\nTicket Body: "), F.substring(_text(body), 1, 2000),
        F.lit(CLASSIFY_TAIL),
    )


def context_line(h: Column) -> Column:
    """One hit. The percentage is cut, not rounded."""
    return F.concat(
        F.lit("[Ticket "), h["rank"].cast("string"),
        F.lit(" | Similarity: "), (h["similarity"] * 100).cast("int").cast("string"),
        F.lit("% | Category: "), _text(h["category"]),
        F.lit(" | Priority: "), _text(h["priority"]),
        F.lit("]\nSubject: "), _text(h["subject"]),
    )


def format_context(hits: Column) -> Column:
    """Hits of one ticket, sorted by rank, as a block of text."""
    return F.when(F.coalesce(F.size(hits), F.lit(0)) > 0,
                  F.array_join(F.transform(F.array_sort(hits), context_line), "\n\n")).otherwise(NO_CONTEXT)


def answer_prompt(subject: Column, body: Column, category: Column, priority: Column, context: Column) -> Column:
    """The request in one sentence, its text, and then what was found. Subject and body are cut at fixed lengths."""
    return F.concat(
        F.lit("A ticket of category <"), category, F.lit("> and priority <"), priority, F.lit("> says: "),
        F.substring(_text(subject), 1, 300), F.lit(" -- "), F.substring(_text(body), 1, 500),
        F.lit("\n\nTickets found for it:\n"), context, F.lit(ANSWER_TAIL),
    )


def judge_context(hits: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(hits), lambda h: F.concat(
        F.lit("Historical Ticket "), h["ticket_id"], F.lit(" ["), _text(h["category"]), F.lit("]:\n"),
        _text(h["subject"]))), "\n\n")


def faithfulness_prompt(question: Column, context: Column, answer: Column) -> Column:
    return F.concat(F.lit("Grade whether every claim of the answer follows from the context.\nQuestion: "), question,
                    F.lit("\nContext: "), context, F.lit("\nAnswer: "), answer, F.lit(JUDGE_TAIL))


def relevance_prompt(question: Column, answer: Column) -> Column:
    return F.concat(F.lit("Grade whether the answer fully addresses the question.\nQuestion: "), question,
                    F.lit("\nAnswer: "), answer, F.lit(JUDGE_TAIL))
