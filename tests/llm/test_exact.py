"""Terms, characters, packing, leakage and shared spans against brute force, with nulls, ties, repeats and empty tables."""

import json
import random
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadloom.llm import charform, leakage, packing, spans, terms

WORDS = "the group would like a table near river stage with coffee and bread for ninety guests on monday after lunch please call".split()


# --- 2: terms


def test_term_frequencies(spark):
    cells = ['["a b","A-B","a__b"]', '["x"]', "[unclosed", "null", "{}", "n/a", None, '[""," ",null,3]', '["x"]', "['x']"]
    rows = [(i, c) for i, c in enumerate(cells)]
    df = spark.createDataFrame(rows, "k int, cell string").selectExpr("*", "1 as term", "2 as field_name", "3 as n", "4 as terms")
    got = {(r.field_name, r.term): tuple(r)[2:] for r in terms.term_frequencies(df, {"j": terms.json_terms(F.col("cell"))}).collect()}
    assert got == {("j", "a_b"): (3, 1, 10, True, False), ("j", "x"): (2, 2, 10, True, False), ("j", "3"): (1, 1, 10, True, False)}
    pieces = spark.createDataFrame([("a;A ; ;b",), (None,), ("a",), ("a",)], "cell string")
    got = {r.term: (r.n_occurrences, r.n_rows, r.is_rare, r.is_common) for r in terms.term_frequencies(pieces, {"p": terms.piece_terms(F.col("cell"))}).collect()}
    assert got == {"a": (4, 3, False, True), "b": (1, 1, True, False)}
    assert terms.term_frequencies(pieces.limit(0), {"p": terms.piece_terms(F.col("cell"))}).count() == 0


def test_marks_of_small_tables(spark):
    labels = spark.createDataFrame([('["x"]', None), (None, "junk")], "language_patterns string, friction_points string")
    tally = spark.createDataFrame([("y",)], "failure_tag string")
    got = sorted(map(tuple, terms.marked_tags(labels, tally).collect()))
    assert got == [("failure_tag", "y", "common"), ("failure_tag", "y", "rare"), ("language_patterns", "x", "common"), ("language_patterns", "x", "rare")]


def test_term_counts_match_brute_force(spark):
    rng = random.Random(3)
    cells = [json.dumps([rng.choice(["a", "B ", "c-d", "c_d", "", "hot"]) for _ in range(rng.randrange(5))]) for _ in range(300)]
    occurrences, rows = Counter(), Counter()
    for c in cells:
        found = [t for t in (x.strip().lower().replace("-", "_") for x in json.loads(c)) if t]
        occurrences.update(found)
        rows.update(set(found))
    df = spark.createDataFrame([(c,) for c in cells], "cell string")
    got = {r.term: (r.n_occurrences, r.n_rows) for r in terms.term_frequencies(df, {"j": terms.json_terms(F.col("cell"))}).collect()}
    assert got == {t: (occurrences[t], rows[t]) for t in occurrences}


# --- 5: characters


@pytest.mark.parametrize(
    "text, normal, found",
    [
        ("plain", "plain", []),
        ("", "", []),
        ("ｎｕｔｓ and ①", "nuts and 1", ["stand_in"]),
        ("𝐛𝐨𝐱 ﬁn", "box fin", ["stand_in"]),
        ("оnsite Αpril", "onsite April", ["stand_in"]),
        ("борщ и χαλβάς", "борщ и χαλβάς", []),
        ("we­ather ﻿start", "weather start", ["invisible"]),
        ("​edge​", "edge", []),
        ("a b c", "a b c", ["space"]),
        ("café", "café", ["accent"]),
        ("𝐝𝐞́", "dé", ["stand_in", "accent"]),
        ("👨‍👩‍👧 ❤️ “q” – x…", "👨‍👩‍👧 ❤️ “q” – x…", []),
        ("1º ½ ™", "1º ½ ™", []),
    ],
)
def test_class_form(spark, text, normal, found):
    own = charform.forms(spark)
    assert own.class_form(text) == (normal, found) and own.differs(text) == found
    assert own.class_form(normal)[0] == normal and own.skeleton(normal) == own.skeleton(text)


@pytest.mark.parametrize(
    "text, normal",
    [
        ("ꓮpple", "Apple"), ("Ꭺpple", "Apple"), ("ᴀbc", "abc"), ("ıstanbul", "istanbul"), ("𐐬", "o"), ("а table", "a table"), ("Іnn", "Inn"), ("cаfé", "café"), ("раура", "paypa"), ("оrdеr Ⅷ", "order VIII"),
        # ordinary: Turkish, symbols, words of another script, also one that looks Latin among others
        ("Işık ıslak", None), ("σ = 2, α", None), ("кот сок Москва", None), ("να το πω", None), ("מים ו יין", None), ("œuvre, Ærø, straße", None), ("3×4, 5°", None), ("日本語テスト", None),
    ],
)
def test_look_alikes_of_the_public_table(spark, text, normal):
    own = charform.forms(spark)
    assert own.class_form(text)[0] == (normal or text) and own.differs(text) == (["stand_in"] if normal else [])


def test_skeletons(spark):
    own = charform.forms(spark)
    for a, b in [("rn", "m"), ("O0", "00"), ("Il1|", "llll"), ("“x”", '"x"'), ("ﬁn", "fin"), ("ꓮb", "Ab"), ("cafe\u0301", "café")]:
        assert own.skeleton(a) == own.skeleton(b), a
    assert own.skeleton("modem") == own.skeleton("rnodern") and own.skeleton("O0") == own.skeleton("0O") and own.skeleton("a") != own.skeleton("b")
    df = spark.createDataFrame([("f", str(i), t) for i, t in enumerate(['m"%1I|`0', "", "modern | 10%", None])], "field_name string, record_id string, text string")
    got = df.select("text", F.xxhash64(charform._ascii_skeleton(F.col("text"), own)).alias("a")).collect()
    want = spark.createDataFrame([(r.text, own.skeleton(r.text)) for r in got if r.text is not None], "text string, s string").select("text", F.xxhash64("s").alias("b"))
    assert {r.text: r.a for r in got if r.text is not None} == {r.text: r.b for r in want.collect()}


@settings(max_examples=800, deadline=None)
@given(text=st.text(alphabet=st.sampled_from("aeo éñ оеА\u00ad\u200b\u00a0ｎ𝐛\u0301-“ıꓮm0"), max_size=30))
def test_class_form_is_stable_and_looks_equal(spark, text):
    own = charform.forms(spark)
    once = own.class_form(text)[0]
    assert own.class_form(once)[0] == once
    assert own.skeleton(once) == own.skeleton(own.skeleton(text)) == own.skeleton(text)
    assert unicodedata.is_normalized("NFC", once)


def test_texts_that_are_not_suspect_are_class_forms(spark):
    own = charform.forms(spark)
    chars = [chr(cp) for cp in range(0x20, 0x10000) if not 0xD800 <= cp < 0xF900]
    suspect = {r.c for r in spark.createDataFrame([(c,) for c in chars], "c string").where(F.col("c").rlike(own.suspect())).collect()}
    assert all(own.class_form(f"a{c}b")[1] == [] for c in chars if c not in suspect)
    assert not suspect & set("aé–“…€ñ") and suspect >= set("оıｎ​")


def test_character_records(spark, monkeypatch):
    rows = [("1", "оne"), ("2", "one"), ("3", None), ("4", ""), ("5", "ONE"), ("6", "оne"), ("7", "x" * 100_000 + "\u00a0y")]
    inquiries = spark.createDataFrame(rows, "inquiry_id string, thread_text_redacted string").selectExpr("*", "1 as text", "2 as found", "3 as n")
    outputs = spark.createDataFrame([(9, "one")], "output_id long, response_draft string")
    fields = charform.text_fields(inquiries, outputs)
    assert sorted(r.record_id for r in charform.disguised_records(fields).collect()) == ["1", "6", "7"]
    for hot in (charform.HOT_RECORDS, 2):
        monkeypatch.setattr(charform, "HOT_RECORDS", hot)
        groups = {(r.field_name, r.record_id): (r.n_records, r.n_texts) for r in charform.look_alike_groups(fields).collect()}
        assert groups["thread_text_redacted", "1"] == groups["response_draft", "9"] == (4, 2) and groups["thread_text_redacted", "5"] == (1, 1)
        assert ("thread_text_redacted", "3") not in groups and len(groups) == 7
    assert charform.disguised_records(fields.limit(0)).count() == 0


# --- 7: packing


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=80), st.integers(60, 90))
def test_best_two_fit(sizes, capacity):
    bins = packing.best_two_fit(list(enumerate(sizes)), capacity)
    assert sorted(i for b in bins for i, _ in b) == list(range(len(sizes)))
    assert all(0 < sum(s for _, s in b) <= capacity for b in bins)
    # never worse than filling in order of size
    left = []
    for s in sorted(sizes, reverse=True):
        for k, room in enumerate(left):
            if room >= s:
                left[k] -= s
                break
        else:
            left.append(capacity - s)
    assert len(bins) <= len(left) + 1


def test_swap_fills_the_gap():
    assert [sum(s for _, s in b) for b in packing.best_two_fit([("a", 6), ("b", 3), ("c", 2), ("d", 2)], 10)][0] == 10


def test_packing(spark):
    texts = [(1, "word " * 30), (2, None), (3, ""), (4, "a"), (5, "b c"), (6, "a"), (6, "a"), (7, "long " * 100)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 as n_tokens", "2 as shard")
    limits = spark.createDataFrame([(1, 16), (2, 1000), (3, 0), (4, None), (1, 16)], "limit_id int, capacity_tokens int")
    counts = {}
    for r in packing.token_counts(docs).collect():
        counts.setdefault(r.doc_id, []).append(r.n_tokens)
    assert counts[2] == counts[3] == [0] and counts[6] == [counts[4][0]] * 2
    rows = packing.pack_documents(docs, limits, shard_docs=4).collect()
    assert {r.limit_id for r in rows} == {1, 2}
    held, placed = Counter(), defaultdict(list)
    for r in rows:
        held[r.limit_id, r.container_id] += r.token_to - r.token_from
        placed[r.limit_id, r.doc_id].append((r.token_from, r.token_to))
    assert all(n <= (16 if k == 1 else 1000) for (k, _), n in held.items())
    for (k, doc), parts in placed.items():
        assert sum(b - a for a, b in parts) == sum(counts[doc]) and (len(parts) == len(counts[doc]) or sum(counts[doc]) > 16)
        assert len(parts) >= 1
    assert set(d for _, d in placed) == {1, 2, 3, 4, 5, 6, 7}
    assert packing.pack_documents(docs.limit(0), limits).count() == 0 and packing.pack_documents(docs, limits.limit(0)).count() == 0


def test_waste_of_packing(spark):
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(WORDS) for _ in range(min(900, int(rng.paretovariate(1.1) * 12))))) for i in range(3000)], "doc_id long, text string")
    limits = spark.createDataFrame([(1, 64), (2, 512)], "limit_id int, capacity_tokens int")
    for shard_docs, n_shards in ((100_000, 1), (600, 5)):  # a shard wastes less than a container
        for r in packing.packing_report(packing.pack_documents(docs, limits, shard_docs=shard_docs)).collect():
            assert r.n_least <= r.n_containers <= 1.005 * r.n_least + n_shards, r


# --- 8: leakage


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=60), st.integers(1, 4), st.integers(2, 7))
def test_fm_index(symbols, width, every):
    text = np.array([*symbols, 0])
    index = leakage.FMIndex(text, 5, every)
    patterns = np.array([symbols[i : i + width] for i in range(len(symbols) - width + 1)] + [[4] * width]).reshape(-1, width)
    low, high = index.search(patterns)
    for p, a, b in zip(patterns, low, high):
        want = [i for i in range(len(symbols) - width + 1) if symbols[i : i + width] == p.tolist()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=80))
def test_suffix_array(symbols):
    assert leakage.suffix_array(np.array(symbols)).tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def test_leaks_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(leakage, "SHARD_WORDS", 120)
    monkeypatch.setattr(leakage, "WINDOW_BLOCK", 7)
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(25))) for i in range(8)] + [(90, "too short"), (91, None), (0, " ".join(WORDS))]
    docs = []
    for k in range(60):
        body = [rng.choice(WORDS) for _ in range(30)]
        if k % 3 == 0:
            words = items[k % 8][1].split()
            n = rng.randrange(9, 20)
            body[5:5] = words[3 : 3 + n]
        docs.append((k, " ".join(body).upper() if k % 2 else ", ".join(body)))
    docs += [(100, None), (101, ""), (102, items[1][1]), (102, items[1][1])]
    want = set()
    for item, text in items:
        w = leakage.words_of(text or "")
        grams = {tuple(w[i : i + 12]) for i in range(len(w) - 11)}
        for doc, t in docs:
            x = leakage.words_of(t or "")
            if grams & {tuple(x[i : i + 12]) for i in range(len(x) - 11)}:
                want.add((item, doc))
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(7))
    e = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    assert {tuple(r) for r in leakage.leaked_items(d, e).collect()} == want
    whole = {r.doc_id: r for r in leakage.removal_counts(leakage.removal_spans(d, e)).collect()}[102]
    assert whole.n_spans == 1 and whole.removed_chars == len(items[1][1])
    assert leakage.leaked_items(d.limit(0), e).count() == 0 and leakage.leaked_items(d, e.limit(0)).count() == 0
    assert leakage.removal_spans(d, e.limit(0)).count() == 0
    monkeypatch.setattr(leakage, "ITEM_CHARS", 300)  # several passes
    assert {tuple(r) for r in leakage.leaked_items(d, e).collect()} == want


def test_leaked_spans_hold_for_the_stored_text(spark):
    item = " ".join(WORDS[:14])
    text = f"İstanbul İİİ ΣΑΣ. {item.upper()} and İ more: {' '.join(WORDS[2:16])}!"
    d, e = spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, item), (2, " ".join(WORDS[1:15]))], "item_id long, text string")
    got = sorted((r.item_id, text[r.char_from : r.char_to]) for r in leakage.leaked_spans(d, e).collect())
    assert got == [(1, item.upper()), (1, " ".join(WORDS[2:14])), (2, " ".join(WORDS[1:14]).upper()), (2, " ".join(WORDS[2:15]))]
    (row,) = leakage.removal_spans(d, e).collect()
    assert [text[s.char_from : s.char_to] for s in row.spans] == [item.upper(), " ".join(WORDS[2:15])] and row.n_items == 2
    assert leakage.words_of("İstanbul, ΣΑΣ.Α") == ["i\u0307stanbul", "σας", "α"]


# --- 9: shared spans


def sentence(rng):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randrange(5, 15))).capitalize() + rng.choice(". ? ! .".split()) + " "


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    docs = ["".join(sentence(rng) for _ in range(rng.randrange(2, 25))) for _ in range(60)]
    for k in range(25):
        a, b = rng.randrange(60), rng.randrange(60)
        n = rng.choice([150, 290, 299, 300, 301, 350, 700])
        at = rng.randrange(max(1, len(docs[a]) - n))
        cut = rng.randrange(len(docs[b]))
        docs[b] = docs[b][:cut] + f"#{k}# " + docs[a][at : at + n] + f" /{k}/" + docs[b][cut:]
    long = "".join(sentence(rng) for _ in range(8))
    copied = next(t for t in docs if len(t) > 400)
    docs += [copied, copied, "no punctuation " + " ".join(rng.choice(WORDS) for _ in range(150)), "", "short", long, "é🎉" + long]
    docs.append("other " + docs[62][20:500] + " end")
    return list(enumerate(docs)) + [(200, None)]


def brute_pairs(docs, n=300):
    seen = defaultdict(set)
    for i, t in docs:
        for p in range(len(t or "") - n + 1):
            seen[t[p : p + n]].add(i)
    return {(a, b) for s in seen.values() if len(s) > 1 for a in s for b in s if a < b}


def test_pairs_match_brute_force(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string").selectExpr("*", "1 as class_id", "2 as h", "3 as n_copies", "4 as a")
    want = brute_pairs(corpus)
    assert len(want) > 10
    assert {tuple(r) for r in spans.span_pairs(df).collect()} == want
    assert {tuple(r) for r in spans.span_pairs(df.unionByName(df.limit(20))).collect()} == want
    assert spans.span_pairs(df.limit(0)).count() == 0


def test_large_copy_classes_stay_linear(spark, corpus):
    text = corpus[0][1] + corpus[1][1] + corpus[2][1]
    copies = [(1000 + i, text) for i in range(10)] + [(5, "x " + text[5:400] + " y")]
    df = spark.createDataFrame(copies, "doc_id long, text string")
    got = {tuple(r) for r in spans.span_pairs(df, expand_copies=4).collect()}
    assert got == {(5, 1000), *((1000, 1000 + i) for i in range(1, 10))}
    assert {(r.class_id, r.n_copies) for r in spans.copy_classes(df).collect()} == {(1000, 10), (5, 1)}


def test_chains_meet_once(spark):
    rng = random.Random(8)
    passage = "".join(sentence(rng) for _ in range(12))
    part = passage[len(passage) // 2 :]
    rows = [(i, f"{i} {rng.random()}. {passage}{rng.random()} {i}.") for i in range(40)] + [(100 + i, f"{i} {rng.random()}. {part}{rng.random()} {i}.") for i in range(3)]
    scanned = spans.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    chains = spans.shared_chains(scanned).collect()
    per = Counter(r.doc_id for r in chains)
    assert all(per[i] == 2 for i in range(40)) and all(per[100 + i] <= 2 for i in range(3))  # the second half is a chain of its own
    assert scanned.runs.where("doc_id = 0").count() > 8
    assert spans.span_pairs(spark.createDataFrame(rows, "doc_id long, text string")).count() == 43 * 42 / 2


def test_one_passage_in_very_many_documents(spark, monkeypatch):
    """Spans, share and removal stay in proportion to the documents: no pair is made."""
    rng = random.Random(4)
    passage = "".join(sentence(rng) for _ in range(9))[:420]
    rows = [(i, f"Note {i} of {rng.random()}: {passage} {rng.random()} end of {i}.") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(spans, "shared_spans", None)
    found = defaultdict(list)
    for r in spans.document_spans(df).collect():
        found[r.doc_id].append(r)
    text = dict(rows)
    assert len(found) == 2000 and sum(map(len, found.values())) < 4000  # a few more where what follows the passage is equal, too
    assert all(any(passage in text[i][r.from_char : r.to_char] and r.is_first == (i == 0) for r in held) for i, held in found.items())
    assert {r.n_holders for r in spans.shared_share(df).collect()} == {2000}
    assert sum(r.n_removed >= 420 for r in spans.without_repeats(df).collect()) == 1999


def test_share(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    rows = {r.doc_id: r for r in spans.shared_share(df).collect()}
    assert len(rows) == len(corpus)
    linked = {d for p in brute_pairs(corpus) for d in p}
    text = dict(corpus)
    for d, r in rows.items():
        assert (r.shared_chars > 0) == (d in linked), d
        covered = set()
        if d in linked:  # positions inside any 300-character window that another text holds
            others = "\0".join(t for i, t in corpus if t and i != d)
            for p in range(len(text[d]) - 299):
                if text[d][p : p + 300] in others:
                    covered.update(range(p, p + 300))
            assert r.shared_chars == len(covered), d
        assert r.repeated_chars <= r.shared_chars <= r.n_chars
    assert rows[60].repeated_chars == len(text[60]) and rows[60].n_copies == 3 and rows[200].n_chars == 0


def test_spans_and_texts_without_repeats(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string").selectExpr("*", "1 as a", "2 as b", "3 as later", "4 as class_id")
    text, found = dict(corpus), defaultdict(list)
    for r in spans.document_spans(df).collect():
        found[r.doc_id].append((r.from_char, r.to_char, r.is_first))
    assert all(len(x) == len(set(x)) for x in found.values())
    clean = {r.doc_id: r for r in spans.without_repeats(df).collect()}
    assert len(clean) == len(corpus) and clean[200].clean_text is None
    for d, t in text.items():
        t = t or ""
        windows = [t[p : p + 300] for p in range(len(t) - 299)]
        for ids, marks in (([i for i in text if i != d], (True, False)), ([i for i in text if i < d], (False,))):
            others = "\0".join(text[i] or "" for i in ids)
            want = {q for p, w in enumerate(windows) if w in others for q in range(p, p + 300)}
            assert {q for a, b, first in found[d] if first in marks for q in range(a, b)} == want, d
        assert (clean[d].clean_text or "") == "".join(c for q, c in enumerate(t) if q not in want) and clean[d].n_removed == len(want)
    assert any(r.n_removed == len(text[d]) > 0 for d, r in clean.items()) and any(0 < r.n_removed < len(text[d] or "") for d, r in clean.items())
    twice = df.unionByName(df)
    assert {tuple(r) for r in spans.document_spans(twice).collect()} == {(d, *x) for d, xs in found.items() for x in xs}
    assert sorted(map(str, spans.without_repeats(twice).collect())) == sorted([*map(str, clean.values())] * 2)
    assert spans.document_spans(df.limit(0)).count() == 0 and spans.without_repeats(df.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.data(), st.sampled_from(["ab c.", "a", "word ", "xyz", "é, ü! ", "no stop here ", "ab\n"]))
def test_a_run_lies_in_every_shared_span(data, letters):
    span = "".join(data.draw(st.lists(st.sampled_from(letters), min_size=300, max_size=300)))
    around = st.text(alphabet=letters + "q. ", max_size=90)
    a, b = (data.draw(around) + span + data.draw(around) for _ in range(2))
    assert {h for h, _, _ in spans.sentence_runs(a)} & {h for h, _, _ in spans.sentence_runs(b)}
    parts = spans.clauses(a)
    assert "".join(a[x:y] for x, y in parts) == a and all(y - x <= spans.CLAUSE_CHARS for x, y in parts)


def test_very_long_clauses():
    for text in ("word " * 100_000, "x" * 300_000, "a,b;" * 50_000):
        parts = spans.clauses(text)
        assert sum(b - a for a, b in parts) == len(text) and max(b - a for a, b in parts) <= spans.CLAUSE_CHARS
        assert len(spans.sentence_runs(text)) > 100


def test_rows_without_an_id(spark):
    big = 2**60 + 1
    text = " ".join(WORDS) + ". " + "one long passage that two texts hold, word for word, and that goes on. " * 6
    docs = spark.createDataFrame([(None, text), (big, text), (big + 1, "x " + text), (None, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(WORDS)), (None, text)], "item_id long, text string")
    assert {tuple(r) for r in leakage.leaked_items(docs, items).collect()} == {(1, big), (1, big + 1)}
    assert {tuple(r) for r in spans.span_pairs(docs).collect()} == {(big, big + 1)}
    share = [(r.doc_id, r.class_id, r.n_chars > 0, r.shared_chars > 0) for r in spans.shared_share(docs).collect()]
    assert sorted(share, key=str) == sorted([(big, big, True, True), (big + 1, big + 1, True, True), (None, None, True, False), (None, None, False, False)], key=str)
    assert {r.doc_id for r in packing.pack_documents(docs, spark.createDataFrame([(1, 50)], "limit_id int, capacity_tokens int")).collect()} == {big, big + 1}
    assert sorted(str(r.doc_id) for r in spans.without_repeats(docs).collect()) == sorted(map(str, [big, big + 1, None, None]))
