"""Queries of the training-text operators, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.llm import charform, language, leakage, newtext, packing, sanitise, spans, terms
from threadloom.session import table


def p2_found(spark, d):
    return terms.marked_tags(table(spark, d, "labels"), table(spark, d, "usefulness_tally"))


def p2_frequencies(spark, d):
    return terms.tag_frequencies(table(spark, d, "labels"), table(spark, d, "usefulness_tally"))


def _language(spark, d):
    return language.language_findings(table(spark, d, "inquiries"), table(spark, d, "labels"), table(spark, d, "documents"))


def p3_found(spark, d):
    return _language(spark, d).select("inquiry_id", "message_no", "lang").distinct()


def p3_languages(spark, d):
    model = language.fit_discriminator(language.labelled_sample(table(spark, d, "documents")))
    return language.thread_languages(table(spark, d, "inquiries"), model)


def _personal_fields(spark, d):
    return sanitise.text_fields(table(spark, d, "inquiries"), table(spark, d, "agent_outputs"))


def p4_found(spark, d):
    return sanitise.personal_items(_personal_fields(spark, d), table(spark, d, "allow_terms")).select("field_name", "record_id", "kind", "surface").distinct()


def p4_sanitised(spark, d):
    return sanitise.sanitised(_personal_fields(spark, d), table(spark, d, "allow_terms"))


def _fields(spark, d):
    return charform.text_fields(table(spark, d, "inquiries"), table(spark, d, "agent_outputs"))


def p5_found(spark, d):
    return charform.disguised_records(_fields(spark, d)).select("field_name", "record_id").distinct()


def p5_groups(spark, d):
    return charform.look_alike_groups(_fields(spark, d))


def p6_found(spark, d):
    found = newtext.message_new_texts(table(spark, d, "inquiries")).where("has_other")
    return found.select("inquiry_id", "message_no", "n_words").distinct()


def p6_new_texts(spark, d):
    return newtext.message_new_texts(table(spark, d, "inquiries"))


def p7_pack(spark, d):
    return packing.pack_documents(table(spark, d, "documents"), table(spark, d, "pack_limits"))


def p7_report(spark, d):
    return packing.packing_report(p7_pack(spark, d))


def p8_found(spark, d):
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_spans(spark, d):
    return leakage.leaked_spans(table(spark, d, "documents"), table(spark, d, "eval_items")).select("item_id", "doc_id", "word_from", "word_to")


def p8_removal(spark, d):
    return leakage.removal_counts(leakage.removal_spans(table(spark, d, "documents"), table(spark, d, "eval_items")))


def p8_removal_spans(spark, d):
    spans = leakage.removal_spans(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return spans.select("doc_id", F.inline("spans"))


def p9_found(spark, d):
    return spans.span_pairs(table(spark, d, "documents"))


def p9_copies(spark, d):
    return spans.copy_classes(table(spark, d, "documents"))


def p9_share(spark, d):
    return spans.shared_share(table(spark, d, "documents"))


def p9_spans(spark, d):
    return spans.document_spans(table(spark, d, "documents"))


def p9_without_repeats(spark, d):
    return spans.without_repeats(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_frequencies, p3_found, p3_languages, p4_found, p4_sanitised, p5_found, p5_groups, p6_found, p6_new_texts, p7_pack, p7_report, p8_found, p8_spans, p8_removal, p8_removal_spans, p9_found, p9_copies, p9_share, p9_spans, p9_without_repeats)}

_TERM = "regexp_replace(lower(regexp_replace(t, '^\\s+|\\s+$', '', 'g')), '[\\s_-]+', '_', 'g')"
_TAG_SQL = f"""
    WITH cells AS (
        SELECT 'language_patterns' AS field_name, label_id AS k, language_patterns AS cell FROM labels
        UNION ALL SELECT 'friction_points', label_id, friction_points FROM labels),
    pieces AS (
        SELECT field_name, k, unnest(CAST(json_extract_string(CAST(cell AS JSON), '$[*]') AS VARCHAR[])) AS t FROM cells
        WHERE CASE WHEN json_valid(cell) THEN json_type(CAST(cell AS JSON)) = 'ARRAY' ELSE false END
        UNION ALL SELECT 'failure_tag', k, unnest(string_split(failure_tag, ';')) FROM (SELECT row_number() OVER () AS k, failure_tag FROM usefulness_tally)),
    counted AS (
        SELECT field_name, term, count(*) AS n_occurrences, count(DISTINCT k) AS n_rows
        FROM (SELECT field_name, k, {_TERM} AS term FROM pieces WHERE t IS NOT NULL) WHERE term <> '' GROUP BY ALL),
    marked AS (
        SELECT *, CASE WHEN field_name = 'failure_tag' THEN (SELECT count(*) FROM usefulness_tally) ELSE (SELECT count(*) FROM labels) END AS n_table_rows FROM counted)
"""
_GRAMS = """
        d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
        e AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items),
        dg AS (SELECT doc_id, i, hash(array_to_string(w[i:i + 11], ' ')) AS g FROM d, LATERAL (SELECT unnest(range(1, len(w) - 10)) AS i)),
        eg AS (SELECT DISTINCT item_id, hash(array_to_string(w[i:i + 11], ' ')) AS g FROM e, LATERAL (SELECT unnest(range(1, len(w) - 10)) AS i))"""
_LEAKS = f"""{_GRAMS}, m AS (SELECT item_id, doc_id, i FROM dg JOIN eg USING (g)),
        n AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY item_id, doc_id ORDER BY i) <= 12 THEN 0 ELSE 1 END AS fresh FROM m),
        r AS (SELECT *, sum(fresh) OVER (PARTITION BY item_id, doc_id ORDER BY i) AS run FROM n),
        leaks AS (SELECT item_id, doc_id, min(i) - 1 AS word_from, max(i) + 11 AS word_to FROM r GROUP BY item_id, doc_id, run)"""
#: Where each word lies in its text, from the lengths of words and of what stands between them.
_REMOVAL = """
        t AS (SELECT doc_id, regexp_extract_all(text, '[\\p{L}\\p{N}]+') AS w, regexp_extract_all(text, '[^\\p{L}\\p{N}]+') AS gaps, CAST(regexp_matches(text, '^[^\\p{L}\\p{N}]') AS INT) AS ahead FROM documents),
        u AS (SELECT doc_id, q, length(w[q]) AS wl, COALESCE(length(gaps[q - 1 + ahead]), 0) AS gap FROM t, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS q)),
        wo AS (SELECT doc_id, q, sum(wl + gap) OVER (PARTITION BY doc_id ORDER BY q) AS b, wl FROM u),
        located AS (SELECT l.doc_id, CAST(x.b - x.wl AS BIGINT) AS a, CAST(y.b AS BIGINT) AS b FROM leaks l JOIN wo x ON x.doc_id = l.doc_id AND x.q = word_from + 1 JOIN wo y ON y.doc_id = l.doc_id AND y.q = word_to),
        o AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM located),
        z AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM o),
        removal AS (SELECT doc_id, min(a) AS char_from, max(b) AS char_to FROM z GROUP BY doc_id, run)"""
#: Windows of 300 characters of the first of equal texts, the windows other texts hold too, and what they cover of each text.
_WINDOWS = """
        c AS (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS class_id, count(*) OVER (PARTITION BY text) AS n_copies FROM documents),
        g AS (SELECT doc_id, i, hash(substring(text, i::INT, 300)) AS h FROM c, LATERAL (SELECT unnest(range(1, length(text) - 298)) AS i) WHERE doc_id = class_id),
        s AS (SELECT h, min(doc_id) AS lo FROM g GROUP BY h HAVING count(DISTINCT doc_id) > 1),
        k AS (SELECT g.*, s.lo < g.doc_id AS later FROM g JOIN s USING (h)),
        cover AS (SELECT doc_id, sum(n) AS n FROM (SELECT doc_id, least(300, i - lag(i, 1, i - 300) OVER (PARTITION BY doc_id ORDER BY i)) AS n FROM (SELECT DISTINCT doc_id, i FROM k)) GROUP BY 1),
        cover_later AS (SELECT doc_id, sum(n) AS n FROM (SELECT doc_id, least(300, i - lag(i, 1, i - 300) OVER (PARTITION BY doc_id ORDER BY i)) AS n FROM (SELECT DISTINCT doc_id, i FROM k WHERE later)) GROUP BY 1)"""
ORACLE = {
    "p2_frequencies": _TAG_SQL + " SELECT *, n_rows <= 2 AS is_rare, n_rows > 0.3 * n_table_rows AS is_common FROM marked",
    "p2_found": _TAG_SQL + " SELECT field_name, term, 'rare' AS mark FROM marked WHERE n_rows <= 2 UNION ALL SELECT field_name, term, 'common' FROM marked WHERE n_rows > 0.3 * n_table_rows",
    "p8_found": f"WITH {_GRAMS} SELECT DISTINCT item_id, doc_id FROM dg JOIN eg USING (g)",
    "p8_spans": f"WITH {_LEAKS} SELECT * FROM leaks",
    "p8_removal": f"WITH {_LEAKS}, {_REMOVAL} SELECT doc_id, n_items, count(*) AS n_spans, CAST(sum(char_to - char_from) AS BIGINT) AS removed_chars FROM removal JOIN (SELECT doc_id, count(DISTINCT item_id) AS n_items FROM leaks GROUP BY 1) USING (doc_id) GROUP BY 1, 2",
    "p8_removal_spans": f"WITH {_LEAKS}, {_REMOVAL} SELECT * FROM removal",
    "p9_share": f"""
        WITH {_WINDOWS}, o AS (SELECT doc_id, max(n) AS n_holders FROM k JOIN (SELECT h, count(DISTINCT doc_id) AS n FROM k GROUP BY 1) USING (h) GROUP BY 1)
        SELECT d.doc_id, COALESCE(length(d.text), 0) AS n_chars, c.class_id, c.n_copies, COALESCE(o.n_holders, 0) AS n_holders,
            CASE WHEN c.n_copies > 1 AND length(d.text) >= 300 THEN length(d.text) ELSE COALESCE(cover.n, 0) END AS shared_chars,
            CASE WHEN c.n_copies > 1 AND length(d.text) >= 300 AND d.doc_id <> c.class_id THEN length(d.text) ELSE COALESCE(cover_later.n, 0) END AS repeated_chars
        FROM documents d LEFT JOIN (SELECT * FROM c WHERE text IS NOT NULL) c ON c.doc_id = d.doc_id LEFT JOIN o ON o.doc_id = c.class_id LEFT JOIN cover ON cover.doc_id = c.class_id LEFT JOIN cover_later ON cover_later.doc_id = c.class_id""",
    "p9_spans": f"""
        WITH {_WINDOWS}, r AS (SELECT doc_id, later, i, i - row_number() OVER (PARTITION BY doc_id, later ORDER BY i) AS run FROM (SELECT DISTINCT doc_id, later, i FROM k)),
        u AS (SELECT doc_id, min(i) - 1 AS a, max(i) + 299 AS b, later FROM r GROUP BY doc_id, later, run
            UNION ALL SELECT doc_id, 0, length(text), doc_id <> class_id FROM c WHERE n_copies > 1 AND length(text) >= 300)
        SELECT doc_id, CAST(a AS INTEGER) AS from_char, CAST(b AS INTEGER) AS to_char, NOT bool_or(later) AS is_first FROM u GROUP BY doc_id, a, b""",
    "p9_without_repeats": f"""
        WITH {_WINDOWS}, gone AS (SELECT DISTINCT doc_id, p FROM k, LATERAL (SELECT unnest(range(i, i + 300)) AS p) WHERE later),
        held AS (SELECT c.doc_id, string_agg(substring(c.text, q::INT, 1), '' ORDER BY q) AS t FROM c, LATERAL (SELECT unnest(range(1, length(c.text) + 1)) AS q)
            WHERE c.doc_id IN (SELECT doc_id FROM gone) AND NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = c.doc_id AND gone.p = q) GROUP BY 1),
        clean AS (SELECT d.doc_id, d.text, CASE WHEN c.n_copies > 1 AND length(d.text) >= 300 AND d.doc_id <> c.class_id THEN '' WHEN d.doc_id IN (SELECT doc_id FROM gone) THEN COALESCE(held.t, '') ELSE d.text END AS clean_text
            FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN held ON held.doc_id = d.doc_id)
        SELECT doc_id, COALESCE(length(text) - length(clean_text), 0) AS n_removed, clean_text FROM clean""",
    "p9_copies": "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class_id, count(*) OVER (PARTITION BY text) AS n_copies FROM documents WHERE text IS NOT NULL",
    "p9_found": """
        WITH g AS (SELECT DISTINCT doc_id, hash(substring(text, i::INT, 300)) AS h FROM documents, LATERAL (SELECT unnest(range(1, length(text) - 298)) AS i)),
        s AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1), k AS (SELECT g.* FROM g JOIN s USING (h))
        SELECT DISTINCT x.doc_id AS doc_id_a, y.doc_id AS doc_id_b FROM k x JOIN k y ON x.h = y.h AND x.doc_id < y.doc_id""",
}
