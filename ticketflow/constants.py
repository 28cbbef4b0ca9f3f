"""Fixed values. They must equal the published rules, because results depend on them."""

CATEGORIES = (
    "bug", "feature", "security", "billing", "performance", "docs",
    "question", "incident", "sla_breach", "ui", "test", "dependency",
)
PRIORITIES = ("critical", "high", "medium", "low")
TEAMS = ("support", "engineering", "infra", "billing", "security")
TIERS = ("free", "pro", "enterprise")
SOURCES = ("github", "zendesk", "synthetic", "hf_customer_support", "kaggle_github_issues")

DEFAULT_CATEGORY = "question"
DEFAULT_PRIORITY = "medium"
DEFAULT_TEAM = "support"
DEFAULT_TIER = "free"
DEFAULT_CREATED = "2020-01-01 00:00:00"

MIN_BODY = 20
MIN_ROWS = 50_000

# raw label -> category
LABEL_MAP = {
    "bug": "bug", "defect": "bug", "error": "bug", "crash": "bug", "regression": "bug",
    "feature": "feature", "enhancement": "feature", "feature-request": "feature",
    "documentation": "docs", "docs": "docs", "typo": "docs",
    "security": "security", "vulnerability": "security", "CVE": "security",
    "performance": "performance", "slow": "performance", "memory": "performance", "optimization": "performance",
    "UI": "ui", "UX": "ui", "design": "ui", "accessibility": "ui",
    "test": "test", "testing": "test", "ci": "test", "flaky": "test",
    "dependencies": "dependency", "dependency": "dependency", "upgrade": "dependency", "bump": "dependency",
    "question": "question", "help": "question", "support": "question", "how-to": "question",
    "incident": "incident", "outage": "incident", "downtime": "incident", "p0": "incident",
}

# category -> team, applied while cleaning
TEAM_BY_CATEGORY = {
    "bug": "engineering", "performance": "engineering", "dependency": "engineering",
    "feature": "engineering", "ui": "engineering", "test": "engineering",
    "security": "security", "billing": "billing",
    "docs": "support", "question": "support",
    "incident": "infra", "sla_breach": "infra",
}

# (category, priority, team, escalate), applied while triaging
ROUTING_RULES = (
    ("incident", "critical", "engineering", True),
    ("incident", "high", "engineering", False),
    ("bug", "critical", "engineering", True),
    ("bug", "high", "engineering", False),
    ("security", "critical", "security", True),
    ("security", "high", "security", True),
    ("security", "medium", "security", False),
    ("billing", "critical", "billing", True),
    ("billing", "high", "billing", False),
    ("billing", "medium", "billing", False),
    ("performance", "critical", "infra", True),
    ("performance", "high", "infra", False),
)
ESCALATION_RISK = 0.75
CASCADE_CONFIDENCE = 0.75
STANDARD_REASON = "Standard routing — no escalation required"
POLICY_REASON = "Policy-based escalation"

TIER_CODES = {"free": 0, "pro": 1, "enterprise": 2}
SOURCE_CODES = {"github": 0, "hf_customer_support": 1, "synthetic": 2, "zendesk": 3}

FEATURES = (
    "text_length", "word_count", "subject_length",
    "code_block_count", "url_count", "question_mark_count", "exclamation_count", "caps_word_count",
    "hour_of_day", "day_of_week", "is_weekend", "is_after_hours",
    "ticket_age_hours", "reopen_count", "comment_count",
    "customer_tier_encoded", "source_encoded",
)

SLA_CATEGORIES = ("incident", "sla_breach", "security")
SLA_BREACH = 0.5
# lower bound -> level
SLA_LEVELS = ((0.8, "critical"), (0.6, "high"), (0.4, "medium"))
SLA_LOWEST = "low"

DRIFT_EPSILON = 1e-4
# upper bound (exclusive) -> band
DRIFT_BANDS = ((0.1, "ok"), (0.2, "warn"))
DRIFT_WORST = "alert"
DRIFT_MIN_LIVE = 20

SILVER_COLUMNS = (
    "ticket_id", "source", "created_at", "subject", "body", "category", "priority", "routing_team",
    "labels_raw", "pii_flags", "reopen_count", "customer_tier",
)

EMBED_DIM = 1024
EMBED_CUT = 2048
EMBED_SEPARATOR = " [SEP] "
EMBED_EMPTY = "empty"

NO_CONTEXT = "No similar historical tickets found."
FAILED_REASONING = "Classification failed — fallback applied."
PARSE_ERROR = "JSON parse failed"
