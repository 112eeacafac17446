"""Cleaning, redaction, checks, thread parsing and term scans against Python's regular expressions and fixed cases."""

import base64
import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadloom.functions import checks, cleaning, patterns
from threadloom.operators import redaction, termscan, threads

TEXTS = [
    "write to Joe.Bloggs+x@mail.example.org or https://a.b/c?d=e) now", "card 4111 1111 1111 1111 and 4111-1111-1111-1112", "call (415) 555-0131, 1-415-555-0132 or 4155550133.",
    "ids 123456789012345678 and 12345", "http://user@example.com/x", "", "no hits – at all 🎉", " 415 555 0100", "x" * 20000 + " 415-555-0100",
]


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.select(fn(F.col("t")), "i").orderBy("i").collect()]


def test_patterns_match_python(spark):
    def plain(t):
        for kind, p in patterns.PATTERNS.items():
            t = re.sub(p, "{" + kind + "}", t)
        return t

    got = column(spark, [*TEXTS, None], patterns.redact_patterns)
    assert got == [*map(plain, TEXTS), None]
    assert column(spark, got, patterns.redact_patterns) == got


def test_lines_match_splitlines(spark):
    texts = ["a\nb", "a\r\nb\n", "a b\x0bc\x85", "", "\n", "a\n\n"]
    assert column(spark, texts, patterns.lines) == [t.splitlines() or [""] for t in texts]


@pytest.mark.parametrize(
    "fn, text, want",
    [
        (cleaning.strip_quoted_replies, "new\n  > old\nmore", "new"),
        (cleaning.strip_quoted_replies, "new\nOn Monday x wrote:\nold", "new"),
        (cleaning.strip_quoted_replies, "----- Forwarded message ---\nold", ""),
        (cleaning.strip_quoted_replies, "> all quoted", ""),
        (cleaning.strip_quoted_replies, None, None),
        (cleaning.strip_inline_quotes, "Thanks. Sent from my iPhone On Mon, Jan 5, 2024 at 9:15 AM X <y> wrote: old", "Thanks."),
        (cleaning.strip_inline_quotes, "On Jan 5, 2024, at 19:15, we meet", "On Jan 5, 2024, at 19:15, we meet"),
        (cleaning.strip_inline_quotes, "She wrote: bring ice", "She wrote: bring ice"),
        (cleaning.clean_body, "a\nb On Jan 5, 2024, at 19:15, X wrote: c\n> d", "a\nb"),
        (cleaning.html_to_text, "<p>a&nbsp;&amp;lt; b</p><div>c<br/>d</div>​<script>x</script>", "a &lt; b\nc\nd\nx"),
        (cleaning.html_to_text_simple, "<style>s</style><p>a</p>b<br>c&amp;", "a\n\nb\nc&"),
        (cleaning.html_to_text, "a< br >b</ p >c< BR / >d</ h2 >e", "a\nb\nc\nd\ne"),
        (cleaning.html_to_text, None, None),
        (cleaning.preview, "  abc ", "abc"),
        (cleaning.list_preview, "a\nb" + "c" * 90, "a b" + "c" * 67),
    ],
)
def test_cleaning(spark, fn, text, want):
    assert column(spark, [text], fn) == [want]


def test_mime(spark):
    enc = lambda s: base64.urlsafe_b64encode(s).decode().rstrip("=")
    payload = {
        "mimeType": "multipart/mixed", "headers": [{"name": "Subject", "value": "one"}, {"name": "subject", "value": "two"}],
        "parts": [{"mimeType": "text/html", "body": {"data": enc(b"<b>rich</b>")}}, {"mimeType": "multipart/alternative", "parts": [{"mimeType": "text/plain", "body": {"data": enc("pläin\xff".encode("latin-1"))}}]}, {"mimeType": "x", "filename": "A.PDF"}, {"mimeType": "x", "filename": "noext"}],
    }
    rows = spark.createDataFrame([(json.dumps(payload),), ("broken",), (None,)], "p string").select(cleaning.flatten_mime("p").alias("m"))
    got = rows.select("m.body", cleaning.header_value(F.col("m.headers"), "SUBJECT"), cleaning.attachment_extensions(F.col("m.parts")), F.size("m.parts")).collect()
    assert tuple(got[0]) == ("rich", "one", [".pdf", "(no extension)"], 6)
    assert got[1][0] is None and got[2][0] is None


def part(mime, data=None, *parts, name=""):
    enc = lambda s: base64.urlsafe_b64encode(s if isinstance(s, bytes) else s.encode()).decode().rstrip("=")
    return {"mimeType": mime, "filename": name, "body": {} if data is None else {"data": enc(data)}, "parts": list(parts)}


@pytest.mark.parametrize(
    "payload, want",
    [
        (part("text/plain", ""), ""),  # a plain root is taken even if empty
        (part("multipart/alternative", None, part("text/plain", ""), part("text/html", "<p>second</p>")), "second"),  # an empty part isn't
        (part("multipart/alternative", None, part("text/html", "<b>first</b>"), part("text/plain", "plain")), "first"),  # document order
        (part("multipart/mixed", None, part("multipart/alternative", None, part("text/html", "<br>"), part("text/plain", "inner"))), "inner"),
        (part("text/html", "<p>own</p>", part("text/plain", "child")), "child"),
        (part("text/html", "<p>own</p>", part("x", "no text")), "own"),
        (part("text/plain", "named", name="a.txt"), "named"),  # parts with a file name count
        (part("text/plain", "pläin\xff".encode("latin-1")), "pl\ufffdin\ufffd"),
        (part("application/pdf", "x", name="a.pdf"), ""),
    ],
)
def test_body_choice(spark, payload, want):
    assert spark.createDataFrame([(json.dumps(payload),)], "p string").select(cleaning.flatten_mime("p")["body"]).first()[0] == want


def test_extensions_from_the_last_dot(spark):
    named = part("multipart/mixed", None, *[part("x", None, name=n) for n in (".bashrc", "file.", "a.tar.GZ", "plain", "a\n.b")])
    got = spark.createDataFrame([(json.dumps(named),)], "p string").select(cleaning.attachment_extensions(cleaning.flatten_mime("p")["parts"])).first()[0]
    assert got == [".bashrc", ".", ".gz", "(no extension)", ".b"]


def test_changed_lines(spark):
    df = spark.createDataFrame([("a\nb\nc", "a\nX\nc\nd"), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(cleaning.changed_lines(F.col("a"), F.col("b"))).collect()] == [1, 0]


ALLOWED = redaction.AllowList(["Alex", "Alex Sample", "Acme Daily News", None])


@pytest.mark.parametrize("slot, want", [("Alex", True), ("Alex Other", False), ("Sample, Alex", True), ("alex’s", False), ("Acme Daily News", True), ("Acme Daily", False), ("", False), ("Alex Acme News Daily", True), ("News", False), ("Acme Daily News Acme Daily News", False), ("Alex Sample Sample", False), ("Alex Alex Sample", True)])
def test_allow_list(slot, want):
    assert ALLOWED.covers(slot) is want


@pytest.mark.parametrize("text, want", [("**From:** Jo Doe <x>", "**From:** {name} <x>"), ("**From:** Alex <x>", "**From:** Alex <x>"), ("**To:** {name} <x>", "**To:** {name} <x>"), ("**From:** bare name", "**From:** bare name"), ("**From:** <x>", "**From:**{name}<x>")])
def test_slots(text, want):
    assert ALLOWED.redact_slots(text) == want and ALLOWED.redact_slots(want) == want


def test_redact_threads(spark):
    rows = spark.createDataFrame([("1", "**From:** Jo Doe <a@b.co>\n415-555-0100"), ("2", None), ("3", "fine"), ("4", "boom"), ("5", "grow")], "k string, t string")

    def model(t):
        if t == "boom":
            raise RuntimeError
        return t * 400 if t == "grow" else t

    got = {r.k: r for r in redaction.redact_threads(rows, "t", ALLOWED, model).collect()}
    assert (got["1"].safe_text, got["1"].redaction_status) == ("**From:** {name} <{email}>\n{phone}", "verified")
    assert [got[k].redaction_status for k in "2345"] == ["model_failed", "verified", "model_failed", "flagged"] and got["5"].safe_text == "grow"
    assert {r.redaction_status for r in redaction.redact_threads(rows.where("k = 3"), "t", ALLOWED).collect()} == {"names_unredacted"}


def test_checks(spark):
    df = spark.createDataFrame([("a — b – c -- d 🎉",), (None,), ("",)], "t string")
    assert [tuple(r) for r in df.select(*checks.dashes_and_emoji(F.col("t"))).collect()] == [(1, 1, 1, 1, False), (None,) * 5, (0, 0, 0, 0, True)]
    leak = spark.createDataFrame([("{email} a@b.co 9994155550100",)], "t string").select(*checks.leak_counts(F.col("t"))).first()
    assert tuple(leak) == (1, 1)
    assert column(spark, ["Hi Zoe Lane, Zoe {Name} May"], checks.name_shaped_words) == [["Zoe", "Lane"]]
    assert column(spark, ["I need the text ## Message 1", "ok", "## Message 1 please provide"], checks.thread_damage) == ["talk_back", "no_header", "ok"]
    assert column(spark, ["On x\nwrote: &amp; &lt;"], checks.carriers) == [["attribution", "entity", "angle_entity"]]
    assert column(spark, ['"A" <x>', '"A"', "A <x>", "A {email}", "A"], checks.from_line_format) == ["quoted_bracket", "quoted", "bare_bracket", "bare_token", "bare"]
    assert column(spark, ["0f8fad5b-d9cb-469f-a165-70867728950e", "x"], checks.is_uuid) == [True, False]


def test_name_hits(spark):
    df = spark.createDataFrame([("Hi Zoe,\nHello Inés and Dear Best\n\nJo Doe\nText here\nCheers\n", "verified"), (None, None)], "t string, status string")
    got = df.select("status", F.inline(checks.name_hits(F.col("t"), ["best", "cheers"])))
    assert sorted(tuple(r)[1:] for r in got.collect()) == [("greeting", "Dear Best", "CLEARED"), ("greeting", "Hi Zoe", "REVIEW"), ("signature", "Cheers", "CLEARED"), ("signature", "Jo Doe", "REVIEW")]
    cases = spark.createDataFrame([("store", "verified", "REVIEW"), ("store", None, "REVIEW"), ("store", "model_failed", "REVIEW"), ("file", "verified", "REVIEW"), ("store", "verified", "CLEARED")], "a string, b string, c string")
    assert [r[0] for r in cases.select(checks.probe_verdict(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["gating", "gating", "quarantined", "reported", "cleared"]
    table = spark.createDataFrame([("a — b 🎉",), ("fine",), (None,)], "t string").select(F.inline(checks.draft_checks(F.col("t")))).collect()
    assert [(r["check"], r.passed, r.abstained) for r in table[:6]] == [("no_em_dash", False, False), ("no_emoji", False, False), ("language_match", True, True), ("no_em_dash", True, False), ("no_emoji", True, False), ("language_match", True, True)]
    assert table[0].detail == "1 em, 0 en, 0 double"


THREAD = "---\r\nsubject: Re: a: b\r\nthread_id: t9\r\nmessage_count: 2x\r\ndate_range: d1 / d2\r\nsubject: last\r\n---\r\n## Message 1\r\n**From:** X <{email}>\r\n**Date:** D1\r\n\r\nhello\r\n\r\nworld\r\n\r\n## Message 2\r\n**From:** Corvanne Table & Garden <y>\r\n**Date:** D2\r\n\r\n"


def test_threads(spark):
    files = spark.createDataFrame([("exports/m/2024/abc.md", THREAD), ("exports/q.md", "no front"), ("z", None)], "path string, text string")
    got = threads.thread_fields(files).collect()
    assert (got[0].thread_id, got[0].subject, got[0].message_count, got[0].date_range_start, got[0].date_range_end) == ("t9", "last", None, "d1", "d2")
    assert (got[1].thread_id, got[1].body, got[1].date_range_end) == ("q", "no front", None)
    inquiries = files.select(F.col("path").alias("inquiry_id"), F.col("text").alias("thread_text_redacted"))
    rows = threads.messages(inquiries).collect()
    assert [(r.message_no, r.sender, r.sent, r.body) for r in rows] == [(1, "X <{email}>", "D1", "hello\n\nworld"), (2, "Corvanne Table & Garden <y>", "D2", "")]
    summary = threads.thread_summary(inquiries, "corvanne").first()
    assert tuple(threads.reply_totals(threads.thread_summary(inquiries, "corvanne")).first()) == (1, 1, 0)
    assert (summary.n_messages, summary.first_date, summary.last_date, summary.house_replied) == (2, "D1", "D2", True)
    body = THREAD.split("---\r\n")[-1]
    assert column(spark, [body, "", "pre\n## Message 1\n**From:** a\n\nb"], threads.first_message_body) == ["hello\n\nworld", "", "pre"]
    merged = column(spark, ["---\nfirst_message_date: a\nlast_message_date: b\n---\nx"], threads.merge_date_lines)
    assert merged == ["---\ndate_range: a / b\n---\nx"] and column(spark, merged, threads.merge_date_lines) == merged


def test_exported_threads(spark):
    inbox = ["INBOX", "IMPORTANT"]
    messages = [
        part("multipart/mixed", None, part("text/plain", "hello\nOn Mon, Jan 5, 2024 at 9:15 AM X <y> wrote:\n> old"), part("image/png", None, name="A.PNG"), part("x", None, name="doc")),
        part("multipart/mixed", None, part("application/pdf", None, name="b.pdf")),
        part("multipart/mixed", None),
    ]
    heads = [("Jo Doe <jo@dun.test>", "D1", "Call 415-555-0100"), ("Alex <ops@house.test>", "D2", "Re: x"), ("Jo Doe <jo@dun.test>", "D3", "Re: x")]
    for m, values in zip(messages, heads):
        m["headers"] = [{"name": n, "value": v} for n, v in zip(("from", "Date", "Subject"), values)]
    rows = [("4155550100415", i, json.dumps(m), inbox) for i, m in enumerate(messages, 1)]
    df = spark.createDataFrame(rows[::-1] + [("t2", 1, "broken", None)], "thread_id string, message_no int, payload string, labels array<string>")
    got = {r.thread_id: r for r in threads.exported_threads(threads.mail_messages(df), ALLOWED, "OPS@house").collect()}
    assert got["4155550100415"].text == (
        "---\nthread_id: 4155550100415\nsubject: Call {phone}\nmessage_count: 3\ndate_range: D1 / D3\nlabels: ['INBOX', 'IMPORTANT']\noperator_replied: True\n---\n\n"
        "## Message 1\n**From:** {name} <{email}>\n**Date:** D1\n\nhello\n_(2 attachment(s): .png, (no extension))_\n\n"
        "## Message 2\n**From:** Alex <{email}>\n**Date:** D2\n\n_(no text body; 1 attachment(s): .pdf)_\n\n## Message 3\n**From:** {name} <{email}>\n**Date:** D3\n\n_(no body extracted)_\n"
    )
    assert (got["4155550100415"].n_messages, got["t2"].n_messages, got["t2"].operator_replied) == (3, 1, False)
    again = got["4155550100415"].text.replace("4155550100415", "id")
    back = threads.thread_fields(spark.createDataFrame([("p", again)], "path string, text string")).first()
    assert (back.subject, back.message_count, back.date_range_start, back.date_range_end) == ("Call {phone}", 3, "D1", "D3")
    assert threads.exported_threads(threads.mail_messages(df.limit(0)), ALLOWED, "x").count() == 0


def test_matcher():
    m = termscan.Matcher([("name", "jo doe"), ("name", "doe"), ("email", "a@b.co"), ("name", "")])
    assert [(s.kind, s.term) for s in m.spans("Jo  Doe, does, DOE a@b.co z@y.co q@x.test 415-555-0100 415 222 0100")] == [("name", "jo doe"), ("name", "doe"), ("email", "a@b.co"), ("email", "z@y.co"), ("phone", "4152220100")]
    assert m.alive() == {"name": True, "email": True} and termscan.Matcher([]).alive() == {} and termscan.Matcher([]).spans("x@y.co")[0].kind == "email"
    broken = termscan.Matcher([("name", "doe")])
    broken.begins.clear()
    assert broken.alive() == {"name": False}
    loose = termscan.Matcher([("name", "doe")], guarded=False)
    assert len(loose.terms("does")) == 1 and m.terms("does") == []
    a, b, c = termscan.Span(0, 5, "n", "x"), termscan.Span(0, 3, "n", "y"), termscan.Span(5, 6, "n", "z")
    assert termscan.merge_spans([b, c], [a]) == [a, c]
    line = "aaaa jo doe bbbb doe cccc"
    views = termscan.with_tokens(line, m.spans(line), {("name", "jo doe"): "{name-1}", ("name", "doe"): "{name-2}"}, pad=7)
    assert views == ["aaaa {name-1} bbbb {name-2}...", "...{name-1} bbbb {name-2} cccc"]
    assert termscan.with_tokens("doe", [termscan.Span(0, 3, "name", "doe")], {}) == ["{name}"]
    assert [(s.start, s.end) for s in termscan.Matcher([("n", "i̇x doe")]).terms("aİ  İX\tDoe.")] == [(4, 10)]


WORDS = ["a", "ab", "abc", "b c", "ab c", "c", "ca", "(b", "é a"]


@settings(max_examples=300, deadline=None)
@given(terms=st.lists(st.sampled_from(WORDS), max_size=6, unique=True), line=st.text(alphabet="abc (é A\t.", max_size=30), guarded=st.booleans())
def test_matcher_equals_one_alternation(terms, line, guarded):
    ordered = sorted(terms, key=lambda t: (-len(t), t))
    body = "|".join(r"\s+".join(map(re.escape, t.split())) for t in ordered)
    rx = re.compile((r"(?<![A-Za-z0-9])(?:%s)(?![A-Za-z0-9])" if guarded else "(?:%s)") % body, re.I)
    want = [(m.start(), m.end(), " ".join(m[0].lower().split())) for m in rx.finditer(line)] if terms else []
    assert [(s.start, s.end, s.term) for s in termscan.Matcher([("n", t) for t in terms], guarded).terms(line)] == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(1, 6)), max_size=6), st.integers(0, 9), st.integers(0, 8))
def test_views_never_cut_a_token(parts, tail, pad):
    line, spans = "", []
    for gap, width in parts:
        line += "." * gap
        spans.append(termscan.Span(len(line), len(line) + width, "k", f"t{len(spans)}"))
        line += "x" * width
    line += "." * tail
    tokens = {(s.kind, s.term): f"{{{i}}}" for i, s in enumerate(spans)}
    for i, view in enumerate(termscan.with_tokens(line, spans, tokens, pad)):
        assert f"{{{i}}}" in view and view.count("{") == view.count("}") and "x" not in view
        assert len(view) <= 3 * (2 * len(spans) + 1) + 2 * pad + 6


def test_more_terms_than_are_sent_give_the_same_hits(spark):
    texts = spark.createDataFrame([(1, "ann@firm.co and Ann\nnone\nplanned Ann  Lee"), (1, "ann@firm.co and Ann\nnone\nplanned Ann  Lee"), (2, None), (3, ""), (4, "z@y.co only")], "id int, t string")
    terms = spark.createDataFrame([("email", "ann@firm.co"), ("name", "ann"), ("name", "Ann Lee"), ("name", "lane"), ("name", None), ("alias", "ann"), ("name", " ")], "kind string, term string")
    for how in ({}, {"categories": True}, {"guarded": False}):
        want = sorted(map(tuple, termscan.term_hits(texts, "id", "t", terms, **how).collect()))
        assert sorted(map(tuple, termscan.term_hits(texts, "id", "t", terms, sent_terms=2, **how).collect())) == want and len(want) > 6
        assert termscan.term_hits(texts.limit(0), "id", "t", terms, sent_terms=2, **how).count() == 0
    got = {(r.line, r.term, r.category) for r in termscan.term_hits(texts, "id", "t", terms, categories=True).collect()}
    assert got == {(1, "ann@firm.co", "GUARD"), (1, "ann", "GUARD"), (3, "ann", "SUB"), (3, "ann lee", "GUARD"), (1, "z@y.co", "GENERIC")}
    sub = {(r.term, r.category) for r in termscan.term_hits(texts, "id", "t", terms.where("term = 'lane'").unionByName(spark.createDataFrame([("n", "lan")], "kind string, term string")), categories=True).collect()}
    assert ("lan", "SUB") in sub


def test_audit(spark):
    texts = spark.createDataFrame([(1, "Ann is here\nplanned\n ask ann lee at a@b.co or ok@b.co, 415-222-0100, 4111 1111 1111 1111" + "x" * 90), (2, None), (3, "")], "id int, t string").withColumn("line", F.lit(9))
    got = sorted((r.line, r.kind, r.found) for r in termscan.audit_hits(texts, "id", "t", ["Ann", "Ann Lee", "C++"], ("ok@b.co",)).collect())
    assert got == [(1, "customer_name", "Ann"), (3, "customer_name", "Ann"), (3, "customer_name", "Ann Lee"), (3, "email", "a@b.co"), (3, "payment_run", "4111 1111 1111 1111"), (3, "phone", "415-222-0100")]
    assert {len(r.context) for r in termscan.audit_hits(texts, "id", "t", ["Ann Lee"]).collect()} == {90}
    assert termscan.audit_hits(texts.limit(0), "id", "t", []).count() == 0


def test_mining(spark):
    rows = spark.createDataFrame([("Hi Zoe and Hello Best\nJo Doe\nThe Hall\nAl\n\nBo\nThanks\n",), (None,)], "t string")
    assert {r[0] for r in termscan.mined_names(rows, "t", ["best", "hello", "hi"]).collect()} == {"Zoe", "Hi Zoe", "Jo Doe"}
    assert {tuple(r) for r in termscan.signature_names(rows, "t", ["thanks"]).collect()} == {("Jo Doe", "strong"), ("The Hall", "strong"), ("Al Bo", "strong")}
    single = spark.createDataFrame([("Al\nx y\nBest\n",)], "t string")
    assert {tuple(r) for r in termscan.signature_names(single, "t", ["best"]).collect()} == {("Al", "weak")}


def test_term_tables(spark):
    texts = spark.createDataFrame([(1, "x\nJo Doe called"), (2, None), (3, "")], "id int, t string")
    terms = spark.createDataFrame([("name", "jo doe"), ("name", None)], "kind string, term string")
    assert [tuple(r) for r in termscan.term_hits(texts, "id", "t", terms).collect()] == [(1, 2, "name", "jo doe", 0, "{name-1} called")]
    assert termscan.term_hits(texts, "id", "t", terms.limit(0)).count() == 0
    names = spark.createDataFrame([("Jo Doe",), ("Al",), ("Acme",)], "name string")
    none = spark.createDataFrame([("x@y.test", "415-555-0100"), ("X@y.co", "415-222-0100")], "email string, phone string")
    weak = spark.createDataFrame([("Doe",), ("Zed",)], "name string")
    got = {tuple(r) for r in termscan.variants(names, none.select("email"), none.select("phone"), weak, ["acme"]).collect()}
    assert got == {("name", "jo doe"), ("name", "doe"), ("email", "x@y.co"), ("phone", "415-222-0100")}
    assert {r.token for r in termscan.stable_tokens(terms.where("term is not null")).collect()} == {"{name-1}"}
    code = spark.createDataFrame([("a.py", "NAMES = ['x', 'y']\nz: str = 'w'\nf('no')"), ("b.py", "def ("), ("c.py", None)], "p string, s string")
    assert {tuple(r) for r in termscan.literal_strings(code, "p", "s").collect()} == {("a.py", "NAMES", "x"), ("a.py", "NAMES", "y"), ("a.py", "z", "w")}
    kinds = termscan.classified_terms(spark.createDataFrame([("a@b.co",), ("415-222-0100",), ("Jo",), ("# c",), (" ",)], "value string"))
    assert sorted(r.kind for r in kinds.collect()) == ["email", "name", "phone"]


def test_sender_names(spark):
    rows = spark.createDataFrame([('**From:** "Doe, Jo" <x>\n**From:** {name} <y>\n**From:** House <z>',), (None,)], "t string")
    assert sorted(r[0] for r in termscan.sender_names(rows, "t", ["house"]).collect()) == ["Doe, Jo", "Jo Doe"]


def test_rules(spark):
    rows = [(1, "regex:(?i)doe==>{name-1}"), (2, "regex:(?i)jo\\ doe==>{name-2}"), (3, "regex:(?i)Doe==>{name}"), (4, "doe==>{name}"), (5, "regex:(?i)x==>y"), (6, "# c"), (7, "regex:(?i)x")]
    rules = termscan.replacement_rules(spark.createDataFrame(rows, "line int, value string"))
    assert {r.line: r.problem for r in rules.collect()} == {1: None, 2: None, 3: None, 4: "prefix", 5: "token", 7: "separator"}
    assert {tuple(r) for r in termscan.rule_conflicts(rules.where("problem is null")).collect()} == {(1, 3, "duplicate"), (1, 2, "order")}


def test_rule_report(spark):
    lines = spark.createDataFrame([(1, r"regex:(?i)jo\ doe==>{name-1}"), (2, "regex:(?i)zed==>{name-2}"), (3, "regex:(?i)ghost==>{name}"), (4, "x")], "line int, value string")
    rules = termscan.replacement_rules(lines)
    contents = spark.createDataFrame([("a", "Jo Doe, JO DOE and zed"), ("b", "zed zed"), ("c", None)], "content_id string, text string")
    derived = spark.createDataFrame([("jo doe",), ("ghost",)], "term string")
    got = {r.line: tuple(r)[1:] for r in termscan.rule_report(rules, derived, contents, contents.where("content_id = 'a'")).collect()}
    assert got == {1: ("{name-1}", True, 2, 0, True), 2: ("{name-2}", False, 1, 2, False), 3: ("{name}", True, 0, 0, False)}
    assert termscan.rule_report(rules.limit(0), derived, contents, contents).count() == 0
    assert tuple(termscan.covered_terms(rules, spark.createDataFrame([("Jo  Doe",), ("nobody",)], "term string")).first()) == (2, 1)
    hits = spark.createDataFrame([("a", "name"), ("a", "email")], "content_id string, kind string")
    places = spark.createDataFrame([("a", "notes.md"), ("b", "x")], "content_id string, path string")
    assert tuple(termscan.control_hits(hits, places, "notes.md").first()) == (1, True) and tuple(termscan.control_hits(hits, places, "x").first()) == (0, False)


def test_fan_out_and_reach(spark):
    hits = spark.createDataFrame([("s1", "name")], "sha string, kind string")
    places = spark.createDataFrame([("s1", "p"), ("s1", "q"), ("s2", "r")], "sha string, path string")
    assert termscan.fan_out(hits, places, "sha").count() == 2
    assert termscan.reach(hits, places.where("sha = 's2'"), "sha").first().reach == "dangling"
    assert {tuple(r) for r in termscan.hit_counts(hits, "sha", "kind").collect()} == {("sha", "s1", 1), ("kind", "name", 1)}
