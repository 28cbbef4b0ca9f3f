"""Sources, sinks, the batch chain and streams, end to end."""

import json
import os

import pytest
from pyspark.sql import functions as F

from ticketflow.catalog.fixtures import bronze, fixture
from ticketflow.functions.prompts import classify_prompt, judge_context
from ticketflow.operators.quality import GateError
from ticketflow.plans import silver as plan
from ticketflow.plans.evaluation import eval_retrieval
from ticketflow.plans.flow import Config, ingest, run_flow
from ticketflow.schemas import GITHUB_RAW, ISSUE_PAGE, SILVER, SUPPORT_A_RAW, SUPPORT_B_RAW, TRIAGE_LOG, VECTORS
from ticketflow.session import shared_dir, work_path
from ticketflow.sources import adapters as ad
from ticketflow.sources import readers as rd
from ticketflow.sources import sinks
from ticketflow.sources.augment import augment, missing_rows
from ticketflow.streaming import intake, metrics

LONG = "a body that is long enough to pass"


def test_unreadable_files_yield_nothing(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"subject": "s", "body": LONG, "queue": "bug"}, {"subject": "t", "body": "short"}]))
    (tmp_path / "b.json").write_text('[{"subject": "broken"')
    (tmp_path / "c.json").write_text("[]")
    rows = rd.read_json_source(spark, str(tmp_path / "*.json"), SUPPORT_A_RAW)
    assert {r["subject"] for r in rows.collect()} == {"s", "t"}
    adapted = ad.adapt_support_a(rows).collect()
    assert [(r["subject"], r["labels_raw"], r["created_at"]) for r in adapted] == [("s", ["bug", ""], None)]


def test_issue_pages(spark, tmp_path):
    page = [{"title": "t", "body": LONG, "labels": [{"name": "bug"}, {"name": "ui"}], "number": 7, "created_at": "2024-01-01T00:00:00Z"},
            {"title": "pr", "body": LONG, "labels": [], "number": 8, "pull_request": {"url": "u"}},
            {"title": "bare", "body": None, "number": 9}]
    (tmp_path / "p.json").write_text(json.dumps(page))
    pages = rd.read_json_source(spark, str(tmp_path / "p.json"), ISSUE_PAGE)
    flat = rd.flatten_issues(rd.issues_only(pages), "org/app")
    rows = {r["issue_number"]: r for r in flat.collect()}
    assert set(rows) == {7, 9} and rows[7]["labels"] == ["bug", "ui"] and rows[9]["labels"] == []
    assert set(flat.columns) == set(GITHUB_RAW.fieldNames())
    assert all(not r["is_pull_request"] for r in rows.values())
    got = ad.adapt_github(flat).collect()
    assert [(r["ticket_id"], r["source"]) for r in got] == [("GH-org/app-7", "github")]
    missing = ad.adapt_github(flat.withColumn("issue_number", F.lit(None).cast("long")))
    assert missing.first()["ticket_id"] == missing.first()["ticket_id"] and len(missing.first()["ticket_id"]) == len("GH-org/app-") + 40


def test_support_b_and_lines(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps([{"Ticket Subject": "s", "Combined Text": LONG, "Ticket Type": "Incident"}]))
    rows = rd.read_json_source(spark, str(tmp_path / "b.json"), SUPPORT_B_RAW)
    assert ad.adapt_support_b(rows).first()["labels_raw"] == ["Incident"]
    (tmp_path / "repos.txt").write_text(" a/b \n\n\t\nc/d\n")
    assert [r["value"] for r in rd.read_lines(spark, str(tmp_path / "repos.txt")).collect()] == ["a/b", "c/d"]


def test_extra_columns_survive_the_union(spark):
    a = spark.createDataFrame([("1", "s", LONG)], "ticket_id string, subject string, body string")
    b = spark.createDataFrame([("2", "s", LONG, "pro")], "ticket_id string, subject string, body string, customer_tier string")
    out = ad.combine(ad.adapt_passthrough(a), ad.adapt_passthrough(b))
    assert {r["ticket_id"]: r["customer_tier"] for r in out.collect()} == {"1": None, "2": "pro"}


def test_augment_repeats(spark):
    wordings = spark.createDataFrame([(1, "bug", "It {verb} and {gone} again, says the door"), (2, "bug", "Nothing to fill in, just a text"), (3, "docs", "x" * 30)],
                                     "template_id int, category string, body string")
    counts = spark.createDataFrame([("bug", 400), ("docs", 0), ("ui", 5)], "category string, n long")
    fills = {"verb": ("rings", "sticks", "falls")}

    def made(w=wordings, **more):
        return augment(w, counts, "2025-01-01 00:00:00", fills, **more)
    first = sorted(map(str, made().collect()))
    assert first == sorted(map(str, made(wordings.repartition(3)).collect()))
    assert made().count() == 400 and ad.admit(made()).count() == 400 and made().select("ticket_id").distinct().count() == 400
    assert made().where(F.col("body").rlike(r"[{}]") | F.col("body").isNull()).count() == 0
    assert {r[0].split()[1] for r in made().where("body like 'It%'").select("body").collect()} == {"rings", "sticks", "falls"}
    assert sorted(map(str, made(seed=7).collect())) != first
    lacking = missing_rows(spark.createDataFrame([("a",), ("a",), ("b",)], "category string"), 2)
    assert [tuple(r) for r in lacking.collect()] == [("b", 1)]


def test_silver_options(spark):
    schema = "n long, ticket_id string, source string, created_at string, subject string, body string, labels_raw array<string>, category string"
    rows = [(1, " ", "zendesk", None, "mail a@b.co", LONG + " x@y.zz", ["billing"], "billing"),
            (2, "B", "zendesk", None, "mail c@d.co", LONG + " q@r.ss", ["bug"], None),
            (3, "C", "zendesk", None, None, LONG, None, None), (4, "D", "zendesk", None, "s", " " * 40, [], None),
            (5, "E", "zendesk", None, "s", "short", [], None)]
    df = spark.createDataFrame(rows, schema)
    out = {r["n"]: r for r in plan.clean(df, "n").collect()}
    assert set(out) == {1, 2, 3} and out[1]["category"] == "question" and out[3]["subject"] == ""
    kept = plan.to_silver(df, "n", keep_given_category=True)
    got = {r["ticket_id"]: r for r in kept.collect()}
    # tickets 1 and 2 differ only in personal data
    assert len(got) == 2 and "C" in got and kept.columns == SILVER.fieldNames()
    one = next(r for k, r in got.items() if k != "C")
    assert one["category"] == "billing" and len(one["ticket_id"]) == 16 and one["pii_flags"] == "email"
    assert (one["priority"], one["routing_team"], one["customer_tier"], one["reopen_count"], one["comments"]) == (
        "medium", "billing", "free", 0, [])


def test_chain(spark, sf, tmp_path):
    calls = []

    def make(session):
        calls.append(1)
        rows = ad.admit(bronze(session, sf)).drop("reopen_count")
        return rows.withColumns({"ticket_id": F.concat(F.lit("D"), "doc_id"), "priority": F.lower("priority")}).drop("doc_id")

    cfg = Config(str(tmp_path / "lake"), "2024-12-01 00:00:00", make, min_rows=100, dim=8)
    summary = {r["split"]: r["n"] for r in run_flow(spark, cfg).collect()}
    silver = rd.read_layer(spark, cfg.at("silver"))
    n = silver.count()
    assert summary["total"] == n and summary["train"] == int(n * 0.7)
    assert ingest(spark, cfg) is False and len(calls) == 1
    feats = rd.read_layer(spark, cfg.at("gold/features"))
    assert feats.count() == n and "event_timestamp" in feats.columns
    vectors = rd.read_vectors(spark, cfg.at("gold/vectors"))
    assert vectors.count() == n and set(VECTORS.fieldNames()) <= set(vectors.columns)
    assert rd.read_layer(spark, cfg.at("silver_by_source")).groupBy("source").count().count() == 4
    assert rd.read_layer(spark, cfg.at("online")).count() <= summary["train"]
    with pytest.raises(GateError, match="bronze: row_count"):
        run_flow(spark, Config(str(tmp_path / "lake"), cfg.as_of, make))
    # a valid priority keeps its case, which the gate then refuses
    shouting = Config(str(tmp_path / "other"), cfg.as_of, lambda s: make(s).withColumn("priority", F.upper("priority")), min_rows=100)
    with pytest.raises(GateError, match=r"silver: in_set\(priority\)"):
        run_flow(spark, shouting)
    hit, precision = eval_retrieval(vectors, vectors, 3, sample=20)
    assert hit.first()["queries"] == 20 and hit.first()["hit_rate"] == 1.0 and precision.count() > 0


def test_sinks(spark, tmp_path, capsys):
    df = spark.createDataFrame([("a", "train"), ("b", "test")], "x string, split string")
    path = str(tmp_path / "t")
    assert sinks.build_if_missing(spark, path, lambda: df) is True
    assert sinks.build_if_missing(spark, path, lambda: 1 / 0) is False
    assert sinks.build_if_missing(spark, path, lambda: df.limit(1), force=True) is True
    assert rd.read_layer(spark, path, ["x"]).count() == 1
    sinks.write_vectors(df, str(tmp_path / "v"))
    assert rd.read_vectors(spark, str(tmp_path / "v")).count() == 2
    assert "val" in capsys.readouterr().out
    m = sinks.metrics_df(spark, "r1", {"trees": 5}, {"auc": 0.74})
    sinks.append_metrics(m, str(tmp_path / "m"))
    sinks.append_metrics(m, str(tmp_path / "m"))
    assert rd.read_layer(spark, str(tmp_path / "m")).count() == 4
    sinks.write_json(df, str(tmp_path / "j"))
    assert rd.read_bronze(spark, str(tmp_path / "j")).count() == 2


def test_index_versions(spark, tmp_path):
    root = str(tmp_path / "index")
    assert sinks.read_index(spark, root) is None
    sinks.upsert_index(spark.createDataFrame([("a", 1), ("b", 1)], "ticket_id string, n int"), root, "ticket_id", "n")
    old = sinks.read_index(spark, root)
    sinks.upsert_index(spark.createDataFrame([("b", 2), ("c", 1)], "ticket_id string, n int"), root, "ticket_id", "n")
    assert {tuple(r) for r in sinks.read_index(spark, root).collect()} == {("a", 1), ("b", 2), ("c", 1)}
    assert old.count() == 2


def test_prompts(spark):
    df = spark.createDataFrame([("s" * 600, "b" * 3000)], "s string, b string")
    text = df.select(classify_prompt(F.col("s"), F.col("b"))).first()[0]
    assert "s" * 500 + "\n" in text and "b" * 2000 in text and "b" * 2001 not in text
    hit = spark.createDataFrame([([(1, "T1", 0.5, "bug", "low", "x")],)],
                                "h array<struct<rank:int,ticket_id:string,similarity:double,category:string,priority:string,subject:string>>")
    assert hit.select(judge_context(F.col("h"))).first()[0] == "Historical Ticket T1 [bug]:\nx"


class Cluster:
    """What ``shared_dir`` asks of a session."""

    def __init__(self, configured=None, master="yarn"):
        self.conf = {"spark.checkpoint.dir": configured}
        self.sparkContext = type("Context", (), {"master": master, "applicationId": "app"})


def test_shared_folder(spark):
    assert shared_dir(Cluster("s3a://lake/work/")) == "s3a://lake/work"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Cluster())
    assert work_path(spark, "x").startswith(shared_dir(spark)) and work_path(spark, "x") != work_path(spark, "x")


def files(spark, tmp_path, df, parts=3):
    """A table as several files, and a stream over them, one file per batch."""
    path = str(tmp_path / "in")
    df.repartitionByRange(parts, "ts").write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_equals_table(spark, sf, tmp_path):
    """Several batches, in any order: every window, open ones too, as in the batch twin."""
    log = fixture(spark, sf, "fx_log").select("ts", "status", "duration", "handler").withColumn("ts", F.col("ts").cast("timestamp"))
    stream = files(spark, tmp_path, log)
    keys = ["window_start", "window_end"]
    got, late = intake.windows_once(metrics.request_count(metrics.with_watermark(stream, late="60 days")), "t", keys)
    assert late == 0
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, metrics.request_count(log).collect()))


def test_late_rows_are_counted(spark, tmp_path):
    """A watermark drops rows from the batch after next on."""
    from datetime import datetime, timedelta
    start = datetime(2024, 1, 1)
    path, seen = str(tmp_path / "in"), set()
    for n, hours in enumerate([(5, 6, 7), (8,), (0,)]):
        rows = spark.createDataFrame([(start + timedelta(hours=h), 200) for h in hours], "ts timestamp, status int")
        rows.coalesce(1).write.mode("append").parquet(path)
        for file in set((tmp_path / "in").glob("*.parquet")) - seen:
            os.utime(file, (n + 1, n + 1))  # files are read in this order
            seen.add(file)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got, late = intake.windows_once(metrics.request_count(metrics.with_watermark(stream), "1 hour", None), "late", ["window_start", "window_end"])
    assert late == 1 and got.count() == 4


def test_streamed_log_is_the_batch_log(spark, tmp_path):
    from tests.test_monitoring import results
    df = results(spark, 30)
    stream = files(spark, tmp_path, df)
    got = intake.run_once(intake.log_stream(stream), "log")
    from ticketflow.operators.log import to_log_rows
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, to_log_rows(df).collect()))
    assert set(got.columns) | {"id"} == set(TRIAGE_LOG.fieldNames())


def test_streamed_log_rows_are_numbered(spark, tmp_path):
    from tests.test_monitoring import results
    from ticketflow.operators.log import recent
    path = str(tmp_path / "log")
    got = intake.log_once(files(spark, tmp_path, results(spark, 30)), path, str(tmp_path / "checkpoint"))
    assert sorted(r["id"] for r in got.collect()) == list(range(1, 31)) and recent(got, 3).first()["id"] == 30
    # a repeated batch replaces itself
    intake.number_log(got.drop("id").limit(4), path, 2, str(tmp_path / "checkpoint"))
    assert spark.read.schema(TRIAGE_LOG).parquet(path).groupBy("id").count().where("count > 1").count() == 0


def test_streamed_dedup_over_batches(spark, tmp_path):
    schema = "ts timestamp, n long, ticket_id string, source string, created_at string, subject string, body string, labels_raw array<string>"
    from datetime import datetime, timedelta
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(hours=i), i, f"T{i}", "zendesk", None, "s", LONG + (" same" if i % 3 else " ab" * i), ["bug"])
            for i in range(60)]
    stream = files(spark, tmp_path, spark.createDataFrame(rows, schema)).drop("ts")
    got = intake.run_once(intake.silver_stream(stream, "n"), "silver")
    assert got.count() == 21 and got.select("body").distinct().count() == 21
