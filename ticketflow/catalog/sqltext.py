"""SQL fragments for the checking engine, whose patterns have ASCII boundaries and no lookaround."""

from __future__ import annotations

from ..constants import LABEL_MAP, ROUTING_RULES, TEAM_BY_CATEGORY
from .fixtures import BRONZE_OF, with_views

SPACE = (r"\t\n\x0b\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
NOT_BLANK = f"[^{SPACE}]"
# Letters of the tables' languages beyond ASCII. Wrapped in underscores they count as word characters.
LATIN = r"[\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]"

# Fixed values: (flag or None, pattern, replacement, options). Rows without a flag wrap and unwrap letters.
MASKING = (
    ("email", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", "[EMAIL_REDACTED]", "gi"),
    (None, f"({LATIN})", r"_\1_", "g"),
    ("account_id", r"\b(USR|ACC|USER|ACCOUNT|UID|CID|CUST)[-_]?\d{3,10}\b", "[ACCOUNT_REDACTED]", "gi"),
    ("ticket_id", r"\b(TKT|TICKET|CASE|REF|INC|SR|CHG)[-_]?[A-Z0-9]{3,12}\b", "[TICKET_ID_REDACTED]", "gi"),
    (None, f"_({LATIN})_", r"\1", "g"),
    ("phone", r"(\+?\d{1,3}[\s\-]?)?(\(?\d{1,4}\)?[\s\-]?)\d{1,4}[\s\-]?\d{1,4}[\s\-]?\d{1,9}", "[PHONE_REDACTED]",
     "g"),
    ("api_key", r"\b[A-Za-z0-9_\-]{32,}\b", "[API_KEY_REDACTED]", "g"),
    ("ip_address", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[IP_REDACTED]", "g"),
)


def masked(source: str, keep: str) -> str:
    """CTEs ``m0`` .. ``masked``: subject, body and pii_flags after masking, next to ``keep``."""
    ctes = [f"m0 AS (SELECT {keep}, coalesce(subject, '') AS s0, body AS b0 FROM {source})"]
    for i, (_, pattern, replacement, options) in enumerate(MASKING):
        ctes.append(
            f"m{i + 1} AS (SELECT *, regexp_replace(s{i}, '{pattern}', '{replacement}', '{options}') AS s{i + 1}, "
            f"regexp_replace(b{i}, '{pattern}', '{replacement}', '{options}') AS b{i + 1} FROM m{i})")
    flags = sorted((name, i) for i, (name, *_) in enumerate(MASKING) if name)
    joined = ", ".join(f"CASE WHEN s{i} <> s{i + 1} OR b{i} <> b{i + 1} THEN '{name}' END" for name, i in flags)
    last = len(MASKING)
    ctes.append(f"masked AS (SELECT {keep}, s{last} AS subject, b{last} AS body, concat_ws(',', {joined}) AS pii_flags "
                f"FROM m{last})")
    return ",\n".join(ctes)


def sql_map(pairs: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in pairs.items()) + "}"


LABELS = sql_map({k.lower().strip(): v for k, v in LABEL_MAP.items()})
CATEGORY = (f"coalesce(list_filter(list_transform(labels_raw, lambda x: ({LABELS})[lower(trim(x))]), "
            f"lambda c: c IS NOT NULL)[1], 'question')")


def team(category: str) -> str:
    return f"coalesce(({sql_map(TEAM_BY_CATEGORY)})[{category}], 'support')"


PRIORITY = "CASE WHEN lower(priority) IN ('critical', 'high', 'medium', 'low') THEN priority ELSE 'medium' END"
CREATED = "coalesce(try_cast(created_at AS TIMESTAMP), TIMESTAMP '2020-01-01 00:00:00')"
TICKET_ID = ("CASE WHEN ticket_id IS NULL OR trim(ticket_id) = '' THEN "
             "upper(substr(sha1(concat(coalesce(source, 'unknown'), '::', CAST(doc_id AS VARCHAR))), 1, 16)) "
             "ELSE ticket_id END")
KEPT = f"regexp_matches(body, '{NOT_BLANK}') AND length(body) >= 20"
BRONZE = with_views("fx_tickets") + f",\nbronze AS ({BRONZE_OF.format(view='fx_tickets')})"
BRONZE_KEEP = "doc_id, ticket_id, source, created_at, labels_raw, priority, customer_tier, reopen_count"
SILVER = (BRONZE + f",\nkept AS (SELECT * FROM bronze WHERE {KEPT}),\n" + masked("kept", BRONZE_KEEP)
          + f""",
cleaned AS (SELECT doc_id, {TICKET_ID} AS ticket_id, source, {CREATED} AS created_at, subject, body,
       {CATEGORY} AS category, {PRIORITY} AS priority, labels_raw, pii_flags, reopen_count, customer_tier FROM masked),
silver AS (SELECT * EXCLUDE (rn), {team('category')} AS routing_team FROM (
    SELECT *, row_number() OVER (PARTITION BY subject || '|||' || body ORDER BY doc_id) AS rn FROM cleaned) WHERE rn = 1)
""")
RULES = "(VALUES " + ", ".join(f"('{c}', '{p}', '{t}', {str(e).lower()})" for c, p, t, e in ROUTING_RULES) + \
    ") r(category, priority, team, escalate)"
