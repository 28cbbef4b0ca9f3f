"""Masking, labels, dates and features against cases and against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from ticketflow.functions.features import features, text_features, time_features
from ticketflow.functions.labels import normalise_labels, read_label_map, route_by_category
from ticketflow.functions.rules import default_priority, drift_band, percent, risk_bucket
from ticketflow.functions.text import embed_text, mask_columns, not_blank, parse_created

# text, masked text, flags
CASES = [
    ('mail john.doe@example.com now', 'mail [EMAIL_REDACTED] now', ['email']),
    ('nothing here', 'nothing here', []),
    ('', '', []),
    (None, None, []),
    ('   ', '   ', []),
    ('User USR-12345 wrote from a@b.co', 'User [ACCOUNT_REDACTED] wrote from [EMAIL_REDACTED]', ['account_id', 'email']),
    ('host 10.0.0.1 down', 'host [IP_REDACTED] down', ['ip_address']),
    ('1.2.3.4', '[IP_REDACTED]', ['ip_address']),
    ('v 1.22.333.4 x', 'v [IP_REDACTED] x', ['ip_address']),
    ('TKT-12345 CASE-0001 REF-ABC123', '[TICKET_ID_REDACTED] [TICKET_ID_REDACTED] [TICKET_ID_REDACTED]', ['ticket_id']),
    ('refund incident including reference', '[TICKET_ID_REDACTED] [TICKET_ID_REDACTED] [TICKET_ID_REDACTED] [TICKET_ID_REDACTED]', ['ticket_id']),
    ('call +1-555-123-4567', 'call [PHONE_REDACTED]', ['phone']),
    ('(555) 123-4567', '[PHONE_REDACTED]', ['phone']),
    ('0049-123-456789', '[PHONE_REDACTED]', ['phone']),
    ('years 2024 and 8080', 'years [PHONE_REDACTED] and [PHONE_REDACTED]', ['phone']),
    ('1 2 3 4', '[PHONE_REDACTED]', ['phone']),
    ('key a1B2a1B2a1B2a1B2a1B2a1B2a1B2a1B2a1B2', 'key [API_KEY_REDACTED]', ['api_key']),
    ('key-zzzzzzzzzzzzzzzzzzzzzzzzzzzzzzz', '[API_KEY_REDACTED]', ['api_key']),
    ('üxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx', 'üxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx', []),
    ('---xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx-', '---[API_KEY_REDACTED]-', ['api_key']),
    ('ü-xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx', 'ü[API_KEY_REDACTED]', ['api_key']),
    ('übREFabc123 REFabc123ü _REFabc1', 'übREFabc123 REFabc123ü _REFabc1', []),
    ('acc123 ACC_999 xacc-1234 acc-12', '[ACCOUNT_REDACTED] [ACCOUNT_REDACTED] xacc-[PHONE_REDACTED] acc-12', ['account_id', 'phone']),
    ('naïve@exämple.com', 'naïve@exämple.com', []),
    ('éREFabc1', 'é[TICKET_ID_REDACTED]', ['ticket_id']),
    ('½REFabc1', '½REFabc1', []),
    ('xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx', 'xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx', []),
    ('xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxé', 'xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxé', []),
    ('phone ١٢٣٤٥ digits', 'phone [PHONE_REDACTED] digits', ['phone']),
    ('12\xa034\u200356', '[PHONE_REDACTED]', ['phone']),
    ('incabcdefghijkl12345', 'incabcdefghijkl[PHONE_REDACTED]', ['phone']),
    ('\x1c12 34\x1d56', '\x1c[PHONE_REDACTED]', ['phone']),
]


def test_masking_cases(spark):
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "id int, body string")
    got = {r["id"]: (r["body"], r["flags"]) for r in mask_columns(rows, ["body"], "flags").collect()}
    for i, (text, masked, flags) in enumerate(CASES):
        assert got[i] == (masked, flags), text


def test_flags_are_joined_over_columns(spark):
    rows = spark.createDataFrame([("from a@b.co", "host 10.0.0.x USR-123")], "subject string, body string")
    row = mask_columns(rows, ["subject", "body"], "flags").first()
    assert row["flags"] == ["account_id", "email"]
    assert row["subject"] == "from [EMAIL_REDACTED]"


def test_masked_tokens_stay(spark):
    tokens = "[EMAIL_REDACTED] [ACCOUNT_REDACTED] [TICKET_ID_REDACTED] [PHONE_REDACTED] [API_KEY_REDACTED] [IP_REDACTED]"
    row = mask_columns(spark.createDataFrame([(tokens,)], "body string"), ["body"], "flags").first()
    assert (row["body"], row["flags"]) == (tokens, [])


@pytest.mark.parametrize("labels, category", [
    (["bug"], "bug"), (["enhancement"], "feature"), (["wontfix"], "question"), ([], "question"), (None, "question"),
    (["bug", "good first issue"], "bug"), (["security"], "security"), (["BUG"], "bug"), ([None, " cve\t"], "security"),
    (["", "Outage", "bug"], "incident"), (["nope", "UX"], "ui"),
])
def test_labels(spark, labels, category):
    rows = spark.createDataFrame([(labels,)], "labels array<string>")
    assert rows.select(normalise_labels(F.col("labels"))).first()[0] == category


def test_label_file_and_teams(spark, tmp_path):
    (tmp_path / "map.json").write_text('{" Broken ": "bug",\n "Slow": "performance"}')
    mapping = read_label_map(spark, str(tmp_path / "map.json"))
    assert mapping == {"broken": "bug", "slow": "performance"}
    rows = spark.createDataFrame([(["BROKEN"],), (["other"],)], "labels array<string>")
    category = normalise_labels(F.col("labels"), mapping)
    assert [tuple(r) for r in rows.select(category, route_by_category(category)).collect()] == [
        ("bug", "engineering"), ("question", "support")]


def test_dates_and_blanks(spark):
    rows = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("2024-01-02T03:04:05.123456",), ("bad",), (None,)],
                                 "c string")
    got = [str(r[0]) for r in rows.select(parse_created(F.col("c")).cast("string")).collect()]
    assert got == ["2024-01-02 03:04:05", "2024-01-02 03:04:05.123456", "2020-01-01 00:00:00", "2020-01-01 00:00:00"]
    texts = spark.createDataFrame([("  \n",), (" x ",)], "c string")
    assert [r[0] for r in texts.select(not_blank(F.col("c"))).collect()] == [False, True]


def test_features_against_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(
        "doc_id", F.substring("text", 1, 60).alias("subject"), F.col("text").alias("body"))
    extra = [(-1, "Help URGENT?", "It's DOWN!! ```a``` ```b https://x.y/z HTTP://Q 1 2 ÄÖÜ STRAßE ǅA Ⅷ3X AB ABC1 a\x1cBCD"),
             (-2, "", ""), (-3, "s", "ABCDé ABCDÉ _A_ 123 A-B ....")]
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id bigint, subject string, body string"))
    cols = text_features(F.col("subject"), F.col("body"))
    got = docs.select("subject", "body", *[c.alias(n) for n, c in cols.items()]).collect()
    for r in got:
        s, b = r["subject"], r["body"]
        assert r["text_length"] == len(b)
        assert r["word_count"] == len(b.split()), b
        assert r["subject_length"] == len(s)
        assert r["code_block_count"] == len(re.findall(r"```[\s\S]*?```", b))
        assert r["url_count"] == len(re.findall(r"https?://\S+", s + " " + b, re.I))
        assert r["question_mark_count"] == b.count("?")
        assert r["exclamation_count"] == b.count("!")
        assert r["caps_word_count"] == sum(1 for w in b.split() if w.isupper() and len(w) > 2), b


def test_live_features(spark):
    rows = spark.createDataFrame([("A b", "```x``` http httpS https://q AB C")], "subject string, body string")
    agent = rows.select(*[c.alias(n) for n, c in text_features(F.col("subject"), F.col("body"), "agent").items()]).first()
    assert (agent["code_block_count"], agent["url_count"], agent["caps_word_count"]) == (2, 1, 1)
    assert agent["text_length"] == len("A b ```x``` http httpS https://q AB C")
    api = rows.select(*[c.alias(n) for n, c in text_features(F.col("subject"), F.col("body"), "api").items()]).first()
    assert (api["url_count"], api["caps_word_count"]) == (3, 1)


def test_time_features(spark):
    rows = spark.createDataFrame([("2024-06-08 18:00:00",), ("2024-06-10 08:59:59",), (None,)], "c string")
    at = F.col("c").cast("timestamp")
    got = rows.select(*[c.alias(n) for n, c in time_features(at, "2024-06-10 10:00:00").items()]).collect()
    assert [tuple(r) for r in got] == [(18, 5, 1, 1, 40.0), (8, 0, 0, 1, 1.0), (0, 2, 0, 1, 38938.0)]
    live = rows.select(time_features(at, "2024-06-10 10:00:00", "agent")["is_after_hours"]).collect()
    assert live[0][0] == 0


def test_feature_table_defaults(spark):
    rows = spark.createDataFrame([("t", "s", "b", None, "zendesk")], "ticket_id string, subject string, body string, created_at timestamp, source string")
    row = features(rows, "2024-01-01 00:00:00").first()
    assert len(row) == 18
    assert (row["reopen_count"], row["comment_count"], row["customer_tier_encoded"], row["source_encoded"]) == (0, 0, 0, 3)


def test_small_rules(spark):
    rows = spark.createDataFrame([("HIGH",), ("bogus",), (None,)], "p string")
    assert [r[0] for r in rows.select(default_priority(F.col("p"))).collect()] == ["HIGH", "medium", "medium"]
    p = spark.createDataFrame([(0.79999,), (0.8,), (0.5,), (0.4,), (0.39999,)], "p double")
    assert [tuple(r) for r in p.select(*risk_bucket(F.col("p"))).collect()] == [
        (0.8, True, "high"), (0.8, True, "critical"), (0.5, True, "medium"), (0.4, False, "medium"), (0.4, False, "low")]
    bands = spark.createDataFrame([(0.0999,), (0.1,), (0.2,)], "v double")
    assert [r[0] for r in bands.select(drift_band(F.col("v"))).collect()] == ["ok", "warn", "alert"]
    assert [r[0] for r in p.select(percent(F.lit(0.125))).limit(1).collect()] == ["12%"]


def test_embed_text(spark):
    rows = spark.createDataFrame([("s", "b" * 3000), (None, None), ("é", "é")], "s string, b string")
    got = rows.select(embed_text(F.col("s"), F.col("b")), embed_text(F.col("s"), F.col("b"), "live")).collect()
    assert len(got[0][0]) == 2048 and got[0][0].startswith("s [SEP] b")
    assert got[1][0] == " [SEP] " and got[1][1] == "empty" and got[2][1] == "empty"


def test_json_object_is_found_without_a_lazy_scan(spark):
    """The shortest braced run from the first brace on that is closed; a lazy scan for it took most of the time of checking replies."""
    from ticketflow.functions import replies
    texts = ["", "none", "{", "}", "}{", "{}", "a {b} c {d}", "{a {b} c}", "} {x", "{\n\"a\": 1,\r\n  \U0001f600}", "{" * 50 + "}", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["o"] for r in rows.select("i", replies.extract_json(F.col("t")).alias("o")).orderBy("i").collect()]
    assert got == [(m.group(0) if (m := re.search(r"\{[\s\S]*?\}", t or "")) else None) for t in texts]
    assert "*?" not in replies.JSON_OBJECT
