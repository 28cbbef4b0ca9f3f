"""Text expressions: whitespace, personal data, labels, dates and embedding input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DEFAULT_CREATED, EMBED_CUT, EMBED_EMPTY, EMBED_SEPARATOR

# Unicode whitespace, spelled out because a bare \s covers ASCII only.
SPACE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WHITE = (" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
         "\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
# A word character in the Unicode sense; lookarounds on it replace \b, whose meaning varies by Java version.
# ASCII comes first in the class because its test is the cheap one.
WORD = r"[A-Za-z0-9_[\p{L}\p{N}]]"
START = rf"(?<!{WORD})"
END = rf"(?!{WORD})"
EDGE = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
GAP = rf"[{SPACE}\-]"

# Fixed values: (flag, pattern, replacement), in the order in which they apply.
PII = (
    ("email",
     r"(?iu)[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}",
     "[EMAIL_REDACTED]"),
    ("account_id",
     rf"(?iu){START}(?:USR|ACC|USER|ACCOUNT|UID|CID|CUST)[-_]?\p{{Nd}}{{3,10}}{END}",
     "[ACCOUNT_REDACTED]"),
    ("ticket_id",
     rf"(?iu){START}(?:TKT|TICKET|CASE|REF|INC|SR|CHG)[-_]?[A-Z0-9]{{3,12}}{END}",
     "[TICKET_ID_REDACTED]"),
    ("phone",
     rf"(?:\+?\p{{Nd}}{{1,3}}{GAP}?)?(?:\(?\p{{Nd}}{{1,4}}\)?{GAP}?)"
     rf"\p{{Nd}}{{1,4}}{GAP}?\p{{Nd}}{{1,4}}{GAP}?\p{{Nd}}{{1,9}}",
     "[PHONE_REDACTED]"),
    ("api_key",
     rf"{EDGE}[A-Za-z0-9_\-]{{32,}}{EDGE}",
     "[API_KEY_REDACTED]"),
    ("ip_address",
     rf"{START}(?:\p{{Nd}}{{1,3}}\.){{3}}\p{{Nd}}{{1,3}}{END}",
     "[IP_REDACTED]"),
)
PII_FLAGS = tuple(flag for flag, _, _ in PII)


def plain(c: Column) -> Column:
    """True where a text is ASCII and its whitespace is what a bare \\s covers: most texts, checked cheaply."""
    return (F.octet_length(c) == F.length(c)) & ~c.rlike(r"[\x1c-\x1f]")


def strip(c: Column) -> Column:
    """Remove leading and trailing whitespace of any kind (``trim`` removes blanks only)."""
    return F.btrim(c, F.lit(WHITE))


def not_blank(c: Column) -> Column:
    return c.rlike(f"[^{SPACE}]")


def norm_label(c: Column) -> Column:
    return strip(F.lower(c))


def _may_match(flag: str, c: Column, digits: Column) -> Column | None:
    """A cheap necessary condition that spares most texts the pattern itself. Masking never adds digits."""
    if flag == "email":
        return F.contains(c, F.lit("@"))
    if flag in ("account_id", "phone", "ip_address"):
        return digits
    if flag == "api_key":
        return c.rlike(r"(?<![A-Za-z0-9_\-])[A-Za-z0-9_\-]{32}")
    return None


def mask_columns(df: DataFrame, columns: list[str], flags_column: str) -> DataFrame:
    """Mask personal data in ``columns`` and add the sorted union of the flags found.

    Patterns run one after the other, each on the text the previous ones left. Each stage is its own
    projection: nested in one expression, a stage would be evaluated again for every later reference.
    A flag is set where a stage changed the text, so each pattern scans a text once.
    """
    original, flagged = df.columns, []
    df = df.withColumns({f"__{c}_digits": F.col(c).rlike(r"\p{Nd}") for c in columns})
    for index, (flag, pattern, replacement) in enumerate(PII):
        stage = {}
        for c in columns:
            before = F.col(c) if index == 0 else F.col(f"__{c}_{index - 1}")
            masked = F.regexp_replace(before, pattern, replacement)
            condition = _may_match(flag, before, F.col(f"__{c}_digits"))
            stage[f"__{c}_{index}"] = masked if condition is None else F.when(condition, masked).otherwise(before)
        df = df.withColumns(stage)
    last = len(PII) - 1
    for index, flag in enumerate(PII_FLAGS):
        changed = F.lit(False)
        for c in columns:
            before = F.col(c) if index == 0 else F.col(f"__{c}_{index - 1}")
            changed = changed | F.coalesce(before != F.col(f"__{c}_{index}"), F.lit(False))
        flagged.append(F.when(changed, F.lit(flag)))
    flags = F.array_sort(F.array_compact(F.array(*flagged)))
    return df.select(
        *[F.col(f"__{c}_{last}").alias(c) if c in columns else F.col(c) for c in original if c != flags_column],
        flags.alias(flags_column),
    )


def join_flags(c: Column) -> Column:
    return F.concat_ws(",", c)


def parse_created(c: Column) -> Column:
    """Each row parsed on its own; what cannot be parsed becomes the default date."""
    return F.coalesce(F.try_to_timestamp(c), F.lit(DEFAULT_CREATED).cast("timestamp"))


def full_text(subject: Column, body: Column) -> Column:
    return F.concat(F.coalesce(subject, F.lit("")), F.lit(" "), F.coalesce(body, F.lit("")))


def embed_text(subject: Column, body: Column, profile: str = "batch") -> Column:
    """Input of the embedder. ``batch`` cuts at the model's limit, ``live`` drops non-ASCII characters."""
    s, b = F.coalesce(subject, F.lit("")), F.coalesce(body, F.lit(""))
    if profile == "batch":
        return F.substring(F.concat(s, F.lit(EMBED_SEPARATOR), b), 1, EMBED_CUT)
    if profile == "live":
        ascii_only = strip(F.regexp_replace(F.concat(s, F.lit(" "), b), r"[^\x00-\x7F]", ""))
        return F.when(ascii_only == "", F.lit(EMBED_EMPTY)).otherwise(ascii_only)
    raise ValueError(profile)
