"""Label log, evaluation, tally and schema validation on small fixtures with ties, nulls, repeats and empty tables."""

import pytest
from pyspark.sql import functions as F

from threadloom import schema
from threadloom.operators import evaluation as ev
from threadloom.operators import labels as lb
from threadloom.operators import tally as ty
from threadloom.sources import readers, writers
from threadloom.streaming import latest

LABELS = [
    (1, "a", "2024-01-01", None, 0, "qualified", "b0"),
    (2, "a", "2024-01-02", "EXCLUDE_FROM_EVAL: old", 0, "declined", "b0"),
    (3, "a", "2024-01-02", None, 0, "needs_info", "b0"),
    (4, "b", "2024-01-01", "excludeXfromXeval", 1, "qualified", None),
    (5, "c", None, None, 1, "declined", None),
    (6, "ghost", "2024-01-05", None, 0, "declined", None),
    (7, None, "2024-01-05", None, None, None, None),
    (3, "a", "2024-01-02", None, 0, "needs_info", "b0"),
]
COLUMNS = "label_id long, inquiry_id string, labeled_at string, edge_case_reason string, edge_case_flag int, qualification_decision string, batch_id string"


@pytest.fixture
def labels(spark):
    return spark.createDataFrame(LABELS, COLUMNS)


@pytest.fixture
def inquiries(spark):
    rows = [("a", "verified", "3"), ("b", "verified", "2"), ("c", "flagged", "1"), ("d", "verified", "1"), ("e", "pending", "0")]
    return spark.createDataFrame(rows, "inquiry_id string, redaction_status string, ingested_at string").withColumn("labeled_at", F.lit("clash"))


def ids(df, column="label_id"):
    return sorted(r[column] for r in df.collect())


def test_latest(labels):
    assert ids(lb.latest_labels(labels)) == [3, 4, 5, 6, 7]
    assert ids(lb.latest_with_ties(labels.distinct(), "inquiry_id", "labeled_at")) == [2, 3, 4, 6]
    assert lb.latest_labels(labels.limit(0)).count() == 0
    assert lb.latest_labels(labels).columns == labels.columns


def test_exclusion_follows_latest(labels, inquiries):
    assert ids(lb.gradeable(labels, inquiries)) == [3, 5]
    assert ids(lb.clean_inbounds(labels, inquiries)) == [3]


def test_queue_and_integrity(labels, inquiries):
    assert ids(lb.unlabelled(inquiries, labels), "inquiry_id") == ["d"]
    assert ids(lb.orphans(labels, inquiries)) == [6, 7]
    assert ids(lb.relabelled(labels)) == [1, 2, 3, 3]


def test_counts(labels):
    got = {(r[0], r[1]): r[2] for r in lb.summary_sets(labels, "qualification_decision").collect()}
    assert got["all", None] == 8 and got["qualification_decision", "declined"] == 3 and got["qualification_decision", None] == 1
    assert sum(r["pct"] for r in lb.distribution(labels, "qualification_decision").collect()) == pytest.approx(100, abs=0.05)
    assert [(r[0], r[1]) for r in lb.search_columns(labels, "label_id", ["edge_case_reason", "batch_id"], "EXCLUDE").orderBy("label_id").collect()] == [(2, "edge_case_reason"), (4, "edge_case_reason")]


def test_dense_ids(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    got = [(r["k"], r["n"]) for r in lb.dense_ids(df, ["k"], "n", F.lit(50)).collect()]
    assert sorted(got) == [(i, 51 + i) for i in range(1000)]


def test_copy_forward(labels):
    fresh = lb.copy_forward(labels, {"qualification_decision": F.lit("human_review")}, F.col("qualification_decision") == "declined", "2025", "me", "b9") if "labeled_by" in labels.columns else None
    wide = labels.withColumn("labeled_by", F.lit("x"))
    fresh = lb.copy_forward(wide, {"qualification_decision": F.lit("human_review")}, F.col("qualification_decision") == "declined", "2025", "me", "b9")
    assert [(r.label_id, r.inquiry_id, r.qualification_decision, r.batch_id) for r in fresh.orderBy("label_id").collect()] == [(8, "c", "human_review", "b9"), (9, "ghost", "human_review", "b9")]
    again = lb.copy_forward(wide.unionByName(fresh), {"qualification_decision": F.lit("human_review")}, F.col("qualification_decision").isin("declined", "human_review"), "2026", "me", "b9")
    assert again.count() == 0


def test_new_and_changed(spark):
    old, new = spark.createDataFrame([("a", "1"), ("b", None)], "k string, v string"), spark.createDataFrame([("a", "2"), ("b", None), ("c", "3"), ("c", "4")], "k string, v string")
    assert [tuple(r) for r in lb.new_rows(old, new, "k").collect()] == [("c", "3")]
    assert [tuple(r) for r in lb.changed_rows(old, new, "k", "v").collect()] == [("a", "2")]


def test_metrics(spark):
    pairs = spark.createDataFrame([("1", "x", "x"), ("2", "x", "y"), ("3", "y", "ERROR"), ("4", "y", "y")], "inquiry_id string, truth string, pred string")
    got = {r["class"]: r for r in ev.class_metrics(pairs).collect()}
    assert (got["x"].tp, got["x"].fp, got["x"].fn, got["x"].precision, got["x"].recall) == (1, 0, 1, 1.0, 0.5)
    assert (got["ERROR"].tp, got["ERROR"].fp, got["ERROR"].support, got["ERROR"].precision, got["ERROR"].recall, got["ERROR"].f1) == (0, 1, 0, 0.0, 0.0, 0.0)
    assert sum(r.n for r in ev.confusion_long(pairs).collect()) == 4 and ev.confusion_long(pairs).count() == 9
    assert ev.accuracy(pairs).first().accuracy == 0.5 and ev.accuracy(pairs).first().gating == "DIAGNOSTIC"
    assert ev.accuracy(pairs.limit(0)).first().accuracy == 0.0 and ev.class_metrics(pairs.limit(0)).count() == 0


def test_stub_predictors(spark):
    truth = spark.createDataFrame([(str(i), ["qualified", "declined"][i % 2]) for i in range(120)], "inquiry_id string, truth string")
    assert ev.accuracy(ev.oracle_pairs(truth)).first().accuracy == 1.0
    assert {r["class"]: r.recall for r in ev.class_metrics(ev.fixed_pairs(truth, "declined")).collect()} == {"qualified": 0.0, "declined": 1.0}
    drawn = ev.random_pairs(truth, ["qualified", "declined"], 3)
    assert sorted(map(tuple, drawn.collect())) == sorted(map(tuple, drawn.repartition(7).collect()))


def test_injected_model(spark):
    rows = spark.createDataFrame([("1", "ok"), ("2", "boom"), ("3", None), ("4", "flaky")], "inquiry_id string, t string")

    def make():
        seen = []

        def model(text):
            seen.append(text)
            if text == "boom":
                raise ValueError
            if text == "flaky" and seen.count("flaky") < 3:
                raise ConnectionError
            return "qualified"

        return model

    assert {r[0]: r.pred for r in ev.predict(rows, "t", make, pause=0.01).collect()} == {"1": "qualified", "2": "ERROR", "3": "ERROR", "4": "qualified"}


def test_validation(spark):
    rows = spark.createDataFrame([(1, "a", "xx", 1, None), (2, None, "en", 0, None), (3, "b", None, 1, "why")], "label_id long, inquiry_id string, language string, edge_case_flag int, edge_case_reason string")
    got = {(r[0], r[1]) for r in schema.broken_rules(rows, schema.LABELS, "label_id").collect()}
    assert got == {(1, "language not allowed"), (1, "edge_case_reason missing"), (2, "inquiry_id is null")}


def test_agent_result(spark):
    raws = ['{"fit_score": 80, "status": " Needs-Info ", "draft_response": "hi", "confidence": 0.5}', '{"fit_score": 101, "status": "qualified", "draft_response": "", "confidence": 1.0}', "nope", None, '{"fit_score": 1, "status": "maybe", "draft_response": "", "confidence": 1.0}']
    rows = spark.createDataFrame([(x,) for x in raws], "raw string").select(schema.agent_result(F.col("raw")).alias("a")).collect()
    assert [r.a.valid for r in rows] == [True, False, False, False, False]
    assert rows[0].a.result.status == "needs_info" and rows[0].a.result.edge_flags == []


def test_tally(spark):
    rows = spark.createDataFrame(
        [("d", "Cold ", "live-3", "ADVANCES", "a;; b", "w"), ("d", "cold", "live-x", "stalls", None, ""), ("d", None, "live-12", "Stalls", "", "w"), ("d", "cold", None, "so so", "", "w")], schema.TALLY
    )
    assert ids(ty.canonical(rows).where("refused is not null"), "refused") == ["score", "source", "why"]
    got = {r["source"]: (r.n, r.n_saved, r.pct_saved) for r in ty.rollup(rows).collect()}
    assert got == {"cold": (3, 1, pytest.approx(33.3333)), "recall": (0, 0, 0.0)}
    assert ty.next_live_id(rows).first()[0] == "live-13" and ty.next_live_id(rows.limit(0)).first()[0] == "live-1"
    assert [r[0] for r in rows.select(ty.tags(F.col("failure_tag"))).collect()] == [["a", "b"], None, [], []]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x1.md").write_text("---\nsubject: Hi: there\nmessage_count: 2\ndate_range: a / b\n---\n## Message 1\nbody")
    assert [r.text[:3] for r in readers.thread_files(spark, str(tmp_path / "t")).collect()] == ["---"]
    (tmp_path / "list").write_text("# c\n\n a@b.co \nName\n")
    assert ids(readers.list_lines(spark, str(tmp_path / "list")), "value") == ["Name", "a@b.co"] and readers.list_lines(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "log.csv").write_text('timestamp,source,inquiry_id,score,failure_tag,why\n2025,cold,live-1,Stalls,"a;b","two\nlines ""q"""\n')
    assert readers.tally_csv(spark, str(tmp_path / "log.csv")).first().why == 'two\nlines "q"' and readers.tally_csv(spark, str(tmp_path / "no.csv")).count() == 0
    (tmp_path / "env").write_text("﻿A=1\n# x=2\nB = 'two=2'\n")
    assert {tuple(r) for r in readers.settings(spark, str(tmp_path / "env")).collect()} == {("A", "1"), ("B", "two=2")}
    (tmp_path / "bin").mkdir()
    (tmp_path / "bin" / "a.txt").write_bytes(b"text")
    (tmp_path / "bin" / "b.txt").write_bytes(b"nul\x00")
    (tmp_path / "bin" / "c.png").write_bytes(b"text")
    (tmp_path / "bin" / "d.txt").write_bytes(b"\xff\xfe\xff")
    assert [r.text for r in readers.text_contents(spark, str(tmp_path / "bin")).collect()] == ["text"]
    stored = spark.createDataFrame([("a", 1)], "k string, v int")
    assert writers.append_new(stored, spark.createDataFrame([("a", 2), ("b", 3)], "k string, v int"), "k", str(tmp_path / "out")) == 1
    report = writers.reconcile(stored, spark.createDataFrame([("b", 1)], "k string, v int"), "k").first()
    assert (report.n_before, report.n_after, report.n_lost, report.n_added) == (1, 1, 1, 1)
    assert readers.matching_columns(stored.withColumnRenamed("v", "text_Redacted"), "redacted") == ["text_Redacted"]


def test_stream_equals_batch(spark, labels, tmp_path):
    src, rows, state = str(tmp_path / "src"), labels.distinct(), str(tmp_path / "v")
    assert latest.current(spark, state, labels.schema).count() == 0
    steps = [rows.where("label_id > 3"), rows.where("label_id <= 3"), rows.where("label_id = 4").withColumn("labeled_at", F.lit("2025"))]  # late rows come second
    seen = rows.limit(0)
    for part in steps:
        part.coalesce(1).write.mode("append").parquet(src)
        latest.keep_latest(latest.label_stream(spark, src, labels.schema), state, str(tmp_path / "c"), buckets=8).awaitTermination()
        seen = seen.unionByName(part)
        got = latest.current(spark, state, labels.schema)
        assert sorted(map(str, got.collect())) == sorted(map(str, lb.latest_labels(seen).collect()))
    last = {p.name for p in (tmp_path / "v" / "version=2").iterdir() if p.name.startswith("bucket")}
    assert len(last) == 1  # the third batch has one key, and touches one part
    held = sorted(p.parent.name for p in (tmp_path / "v").glob("version=0/bucket=*"))
    assert len(held) < len({r[0] for r in rows.select("inquiry_id").collect()})  # what the second batch replaced is gone


def test_lookups(spark, labels, inquiries):
    assert ids(lb.latest_of(labels, "inquiry_id", "a", "labeled_at", "label_id")) == [3] and lb.latest_of(labels, "inquiry_id", "none", "label_id").count() == 0
    wanted = spark.createDataFrame([("a",), ("zz",), ("a",), (None,)], "inquiry_id string")
    assert {(r.inquiry_id, r.found) for r in lb.by_ids(inquiries, "inquiry_id", wanted).collect()} == {("a", True), ("zz", False), (None, False)}
    assert tuple(lb.joinable(labels, inquiries).first()) == (8, 6, 2) and tuple(lb.joinable(labels.limit(0), inquiries).first()) == (0, 0, 0)
    got = {r[0]: (r.n_items, r.shown) for r in lb.heads(labels, "inquiry_id", "label_id", 2).collect()}
    assert got["a"] == (3, "1, 2 (+1 more)") and got[None] == (1, "7") and got["b"] == (1, "4")


def test_relabel_guards(spark, labels, inquiries):
    wide = labels.distinct().withColumn("labeled_by", F.lit("x"))
    rule = lambda *r: spark.createDataFrame(list(r), "inquiry_id string, field string, expected string")
    fine = rule(("a", "qualification_decision", "needs_info"), ("c", "edge_case_flag", "1"), ("c", "labeled_at", None))
    assert lb.relabel_mismatches(wide, fine).count() == 0
    wrong = lb.relabel_mismatches(wide, rule(("a", "qualification_decision", "declined"), ("new", "edge_case_flag", None), ("c", "labeled_at", "x"))).collect()
    assert {(r.inquiry_id, r.actual) for r in wrong} == {("a", "needs_info"), ("new", None), ("c", None)}
    batch = lambda reason: lb.copy_forward(wide, {"qualification_decision": F.lit("declined"), "edge_case_reason": F.lit(reason)}, F.col("inquiry_id") == "a", "2025", "me", "b9")
    rows = lb.guarded_relabel(wide, inquiries, fine, batch(None), "b9")
    assert [(r.inquiry_id, r.qualification_decision, r.label_id) for r in rows.collect()] == [("a", "declined", 8)]
    with pytest.raises(ValueError, match="written already"):
        lb.guarded_relabel(wide.unionByName(rows), inquiries, fine, rows, "b9")
    with pytest.raises(ValueError, match="differ"):
        lb.guarded_relabel(wide, inquiries, rule(("a", "qualification_decision", "declined")), batch(None), "b9")
    with pytest.raises(ValueError, match="lose"):
        lb.guarded_relabel(wide, inquiries, fine, batch("EXCLUDE_FROM_EVAL: x"), "b9")


def test_mail_window(spark):
    rows = [("a@x.test", "s", "2024-01-01 00:00:00"), ("Bot@x.test", "s", "2024-01-02 00:00:00"), ("c@x.test", "Spam list", "2024-01-02 00:00:00"), (None, None, "2024-01-02 23:59:59"), ("d@x.test", "s", "2024-01-03 00:00:00"), ("e@x.test", "s", None)]
    df = spark.createDataFrame(rows, "sender string, subject string, at string").select("sender", "subject", F.to_timestamp("at").alias("sent_at"))
    got = readers.mail_window(df, "2024/01/01", "2024/01/03", ["bot@x"], ("spam",))
    assert [r.sender for r in got.orderBy("sent_at").collect()] == ["a@x.test", None]
    assert readers.mail_window(df, None, None, []).count() == 6
    with pytest.raises(ValueError):
        readers.mail_window(df, "2024-01-01", None, [])
    assert [r[0] for r in spark.createDataFrame([("2024/01/02",), ("2024/1/2",)], "a string").select(readers.is_slash_date(F.col("a"))).collect()] == [True, False]
    assert [r.sender for r in readers.newest(df, 1, "sent_at").collect()] == ["d@x.test"]
    assert readers.pick(df, 1, "sent_at", "sender").first().sender is None
    for i in (-1, 6):
        with pytest.raises(IndexError):
            readers.pick(df, i, "sent_at")


def test_landed_sources(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"id": "t1", "messages": [{"labelIds": ["A"], "payload": {"mimeType": "text/plain"}}, {"payload": {}}]}\nbroken\n{"id": "t2", "messages": []}\n{"id": "t3"}\n')
    got = readers.landed_threads(spark, str(tmp_path / "t.json")).orderBy("message_no").collect()
    assert [(r.thread_id, r.message_no, r.labels) for r in got] == [("t1", 1, ["A"]), ("t1", 2, None)] and got[0].payload == '{"mimeType":"text/plain"}'
    listing = spark.createDataFrame([("c1", "100644 blob ab12\tsrc/a b.py"), ("c1", "040000 tree cd\tsrc"), ("c1", "100644 blob ef\tx.PNG"), ("c1", "")], "commit string, value string")
    assert [tuple(r) for r in readers.tree_entries(listing).collect()] == [("c1", "100644", "ab12", "src/a b.py")]
    log = spark.createDataFrame([("h1\0first\nline\x1e\nh2\0second\x1e\n",), (None,)], "value string")
    assert [tuple(r) for r in readers.commit_messages(log).collect()] == [("h1", "first\nline"), ("h2", "second")]
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / "x.md").write_text("one")
    (tmp_path / "b" / "y.md").write_bytes(b"\xff\xfe")
    (tmp_path / "b" / "z.md").write_text("two")
    assert sorted(r.text for r in readers.thread_files(spark, str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "none")).collect()) == ["one", "two"]
    assert readers.thread_files(spark, str(tmp_path / "none")).count() == 0


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("t1", "a"), ("t2", None)], "thread_id string, text string")
    writers.write_threads(rows, str(tmp_path / "threads"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "threads")).collect()), key=str) == [("t1", "a"), ("t2", None)]
    for _ in range(2):
        writers.append_csv(spark.createDataFrame([('x "y"', "two\nlines")], "a string, b string"), str(tmp_path / "log"))
    back = spark.read.csv(str(tmp_path / "log"), header=True, multiLine=True, escape='"').collect()
    assert [tuple(r) for r in back] == [('x "y"', "two\nlines")] * 2
    writers.write_report(spark.createDataFrame([(2, "b"), (1, "a")], "n int, line string"), str(tmp_path / "report"), "n")
    assert [r[0] for r in spark.read.text(str(tmp_path / "report")).collect()] == ["a", "b"]
    after = spark.createDataFrame([("t1", "A"), ("t2", None), ("t3", "new")], "thread_id string, text string")
    assert tuple(writers.rewrite_changed(rows, after, "thread_id", "text", str(tmp_path / "out"), dry_run=True).first()) == (3, 1) and not (tmp_path / "out").exists()
    assert tuple(writers.rewrite_changed(rows, after, "thread_id", "text", str(tmp_path / "out")).first()) == (3, 1) and spark.read.parquet(str(tmp_path / "out")).count() == 1
    broken = spark.createDataFrame([("t1", None), ("t2", None)], "thread_id string, text string")
    assert {tuple(r) for r in writers.rewrite_status(rows, broken, "thread_id", "text").collect()} == {("errored", 1), ("unchanged", 1)}
    table, backup = str(tmp_path / "threads"), str(tmp_path / "backup")
    with pytest.raises(Exception):
        writers.require_backup(spark, table, backup)
    spark.read.parquet(table).write.parquet(backup)
    writers.require_backup(spark, table, backup)
    with pytest.raises(RuntimeError):
        writers.require_backup(spark, table, backup, now=writers.modified(spark, backup) + 90_000)
    with pytest.raises(RuntimeError):
        writers.require_backup(spark, backup, table)


def test_single_text_and_stamp(spark, labels):
    assert [r[0] for r in readers.single_text(spark, "é".encode() + b"\xff").collect()] == ["é\ufffd"] and readers.single_text(spark, b" \n").count() == 0
    row = lb.copy_forward(labels.withColumn("labeled_by", F.lit("x")), {}, F.col("inquiry_id") == "b", None, "me", "b9").first()
    assert row.labeled_at.endswith("+00:00") and len(row.labeled_at) == 25
    assert [r.n for r in lb.distribution(labels, "qualification_decision").collect()] == sorted((r.n for r in lb.distribution(labels, "qualification_decision").collect()), reverse=True)


def test_statuses(spark):
    df = spark.createDataFrame([(" Needs-Info ",), (None,)], "a string")
    assert [r[0] for r in df.select(schema.checked_status(F.col("a"))).collect()] == ["needs_info", None]
    with pytest.raises(Exception, match="unknown status: maybe"):
        spark.createDataFrame([("maybe",)], "a string").select(schema.checked_status(F.col("a"))).collect()


def test_pauses_and_stages(spark, tmp_path):
    rows = spark.createDataFrame([("1", "late"), ("2", "ok")], "inquiry_id string, t string")

    def make():
        def draft(text):
            if text == "late":
                raise TimeoutError
            return text.upper()

        return ev.two_stages(draft, lambda text, reply: f"{text}/{reply}")

    assert {r[0]: r.pred for r in ev.predict(rows, "t", make, attempts=2, pause=0.01).collect()} == {"1": "ERROR", "2": "ok/OK"}
    drawn = ev.random_pairs(spark.range(500).selectExpr("cast(id as string) inquiry_id", "'x' truth"), ["x", "y"], 1)
    assert drawn.where("fit_score between 0 and 100 and confidence between 0 and 1").count() == 500 and 200 < drawn.where("pred = 'x'").count() < 300


def test_queries_run_their_operators_on_data(spark, tmp_path):
    from threadloom.plans import queries

    thread = "## Message 1\n**From:** Ana Ruiz <a@b.test>\n**Date:** x\n\nMail ana.ruiz@dun.example2.org or desk@house.org, call (415) 867-5309 or (619) 867-0100."
    rows = [(1, "a"), (1, "a"), (2, "ghost")]
    filled = spark.createDataFrame(rows, "label_id long, inquiry_id string")
    filled = filled.select(*[F.col(f.name) if f.name in filled.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.LABELS.fields])
    tables = {
        "labels": filled,
        "inquiries": spark.createDataFrame([("a", thread)], "inquiry_id string, thread_text_redacted string"),
        "agent_outputs": spark.createDataFrame([("Hi Ruiz, Hello Nobody.",)], "response_draft string"),
        "allow_terms": spark.createDataFrame([("desk@house.org", "email"), ("(619) 867-0100", "phone")], "entry string, kind string"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    report = queries.label_migration_report(spark, str(tmp_path)).collect()[0]
    assert (report.n_before, report.n_after, report.n_lost, report.n_added, report.n_orphans) == (3, 2, 1, 0, 1)
    got = {(r.kind, r.term) for r in queries.sender_name_tokens(spark, str(tmp_path)).collect()}
    assert {("email", "ana.ruiz@dun.example2.org"), ("phone", "(415) 867-5309"), ("name", "ana ruiz"), ("name", "ruiz")} <= got
    assert not {t for _, t in got} & {"desk@house.org", "(619) 867-0100", "nobody"}
