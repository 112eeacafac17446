"""New text, languages and personal data: fixed cases, held-out accuracy, round trips."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadloom.llm import language, newtext, sanitise


def thread(*bodies, eol="\n"):
    blocks = [f"## Message {i}\n**From:** {{name}} <{{email}}>\n**Date:** Mon, 5 Feb 2024 10:00:00 +0000\n\n{b}\n" for i, b in enumerate(bodies, 1)]
    return "\n".join(blocks).replace("\n", eol)


def new(*bodies, eol="\n"):
    return [r[1].strip() for r in newtext.thread_new_texts(thread(*bodies, eol=eol))]


FIRST = "Would grazing tables be possible for 106 people in the mezzanine this time? There will be a short speech, then coffee."
ATTRIBUTIONS = [
    "On Mon, Feb 5, 2024 at 10:00 AM {name} <{email}> wrote:", "On Feb 5, 2024, at 10:00, {name}\n<{email}> wrote:", "On 2/5/2024 10:00 AM, {name} wrote:",
    "{name} <{email}> wrote on 5 February 2024:", "2024-02-05 10:00 GMT+00:00 {name} <{email}>:", "El lun, 5 feb 2024 a las 10:00, {name} ({email}) escribió:",
    "Em 5 de fevereiro de 2024 10:00, {name} <{email}> escreveu:", "Le 5 février 2024 à 10:00, {name} <{email}> a écrit :",
    "From: {name} <{email}>\nSent: Monday, February 5, 2024 10:00 AM\nTo: X <{email}>\nSubject: y", "*De:* {name} <{email}>\n*Asunto:* y",
    "-----Original Message-----\nFrom: {name} <{email}>\nSubject: y", "________________________________\nFrom: {name} <{email}>\nSent: x", "---------- Forwarded message ---------\nFrom: {name} <{email}>\nSubject: y",
]


@pytest.mark.parametrize("attribution", ATTRIBUTIONS)
@pytest.mark.parametrize("prefix", ["", "> ", ">", "| "])
@pytest.mark.parametrize("eol", ["\n", "\r\n"])
def test_quotes_below(attribution, prefix, eol):
    quoted = "\n".join(prefix + line for line in FIRST.replace("? ", "?\n").split("\n"))
    assert new(FIRST, f"Yes, it would be.\n\nThanks,\n{{name}}\nHead of People\n\n{attribution}\n\n{quoted}", eol=eol)[1] == "Yes, it would be."


@pytest.mark.parametrize("attribution", ATTRIBUTIONS[:8])
def test_quote_above_without_prefix_ends_with_its_ancestor(attribution):
    assert new(FIRST, f"{attribution}\n{FIRST}\n\nYes, it would be a pleasure to have you.")[1] == "Yes, it would be a pleasure to have you."


def test_interleaved():
    body = "On Mon, Feb 5, 2024 at 10:00 AM {name} <{email}> wrote:\n> first part\n\nanswer one\n\n>> deeper\n> second part\n\nanswer two\n\nBest,\n\nJo"
    assert new(FIRST, body)[1].split() == "answer one answer two".split()


@pytest.mark.parametrize(
    "body, want",
    [
        ("On the 14th my sister wrote: bring more ice.\nFrom: the main gate, please.\nTo: be confirmed.", "On the 14th my sister wrote: bring more ice.\nFrom: the main gate, please.\nTo: be confirmed."),
        ("Best if you come early.\nThanks, and see below.\nSent the form already.", "Best if you come early.\nThanks, and see below.\nSent the form already."),
        ("Hi,\nyes.\n-- \nJo\nLead", "Hi,\nyes."),
        ("yes\n— Doe, Jo\n415 555 0100", "yes"),
        ("yes\nSent from my iPhone", "yes"),
        ("yes\n\nCONFIDENTIAL: not for others.", "yes"),
        ("This message may come twice, the form was slow.", "This message may come twice, the form was slow."),
        ("Hi. All fine.  Best,  Jo Doe LeadSent from my phoneOn 2/5/2024 10:00 AM, {name} wrote: old", "Hi. All fine."),
        ("Call 0135  Thank you, Jo Doe\n\nThis message and any files with it are meant only for you.", "Call 0135"),
        ("_(no body extracted)_", ""),
        ("", ""),
    ],
)
def test_single_messages(body, want):
    assert new(body) == [want]


def test_pasted_history_without_marks():
    assert new(FIRST, f"As you said:\n{FIRST}\nYes.")[1] == "As you said:\nYes."


SHORT_LINES = FIRST.replace("for 106", "for\n106").replace("time? ", "time?\n").replace("speech, ", "speech,\n")


@pytest.mark.parametrize(
    "body, want",
    [
        (f"As you said: {FIRST} Yes, gladly.", "As you said: Yes, gladly."),  # one line
        (FIRST, ""),
        (f"Yes, gladly. Best, Jo Doe On 2/5/2024 10:00 AM, {{name}} wrote: {FIRST}", "Yes, gladly."),
        (f"Yes.\n{SHORT_LINES}\nNo.", "Yes. No."),  # shorter lines
        (f"As you said: {FIRST} Yes,\ngladly.", "As you said: Yes, gladly."),  # part of a line
        (f"Yes.\n{SHORT_LINES} No.\nGladly.", "Yes. No. Gladly."),
        ("Would grazing tables be possible for 106 people in the mezzanine this time or for 10 next time?\nJo", "Would grazing tables be possible for 106 people in the mezzanine this time or for 10 next time? Jo"),  # a turn used again
        ("Thanks for this. There will be a short speech, then coffee.", "Thanks for this. There will be a short speech, then coffee."),
    ],
)
def test_pasted_history_in_one_line_or_in_parts(body, want):
    assert new(FIRST, body)[1].split() == want.split()


UNPREFIXED = "On Mon, Feb 5, 2024 at 10:00 AM {name} <{email}> wrote:\n"
LONGER = "We would take the long table by the window for lunch.\nPlease do tell us the price for all of it.\n\nIs the side room free as well?"
ALIGNED = [
    (FIRST, f"Sure.\n{UNPREFIXED}{FIRST}\n\nThat makes 90 for all of it.", "Sure. That makes 90 for all of it."),  # written below
    (LONGER, UNPREFIXED + LONGER.replace("lunch.", "lunch.\nYes, it is yours.").replace("it.\n", "it.\nIt is 90 a head.\n"), "Yes, it is yours. It is 90 a head."),  # written into it
    (LONGER, UNPREFIXED + LONGER.replace("the long table", "our long table").replace("side room", "back room") + "\nIt is not.", "It is not."),  # changed words
    (FIRST, f"As you said:\n{FIRST}\nYes.", "As you said: Yes."),  # no mark
    (FIRST, f"As you said: {FIRST} Yes, gladly.", "As you said: Yes, gladly."),  # one line
]


@pytest.mark.parametrize("old, body, want", ALIGNED)
def test_alignment_decides(old, body, want, monkeypatch):
    assert new(old, body)[1].split() == want.split()
    monkeypatch.setattr(newtext.Ancestors, "spans", lambda *_: [])
    assert new(old, body)[1].split() != want.split()


def test_quote_from_outside_the_thread_goes_to_the_end():
    assert new(FIRST, f"Sure.\n{UNPREFIXED}Something else was said there.\n\nAnd this below.")[1] == "Sure."


def test_order_by_dates():
    later, first = (thread(x) for x in (f"As you said:\n{FIRST}\nYes.", FIRST))
    text = later.replace("5 Feb", "6 Feb") + "\n" + first.replace("Message 1", "Message 2")  # newest block first
    assert [(r[0], r[1].strip()) for r in newtext.thread_new_texts(text)] == [(1, "As you said:\nYes."), (2, FIRST)]
    undated = text.replace("Mon, 6 Feb 2024 10:00:00 +0000", "soon")
    assert newtext.thread_new_texts(undated)[0][2] > 3  # the order of the blocks, where dates can't be read
    assert newtext.thread_new_texts(thread(FIRST, f"As you said:\n{FIRST}\nYes.").replace(" +0000", " -0000", 1))[1][2] == 4


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40), st.lists(st.sampled_from("abc"), max_size=40))
def test_spans_match_brute_force(old, words):
    a = newtext.Ancestors(3)
    a.add(old, newtext.rolling_hashes(old, 3))
    held = newtext._marked(len(words), a.spans(words, newtext.rolling_hashes(words, 3)))
    grams = {tuple(old[i : i + 3]) for i in range(len(old) - 2)}
    assert held == [any(tuple(words[i : i + 3]) in grams for i in range(max(0, k - 2), k + 1) if i + 3 <= len(words)) for k in range(len(words))]


def test_closing_inside_pasted_history_cuts_nothing():
    old = "We would take the long table by the window and both of the side rooms after lunch.  Best,  Ana Ruiz and everyone here. Please do tell us the price for all of it."
    found = [r[1].split() for r in newtext.thread_new_texts(thread("_(x)_", old.replace("  Best,  ", " Best, "), f"{old} It is 90."))]
    assert found[2] == "It is 90.".split()


def test_messages_table(spark):
    rows = [("a", thread("yes\n> old", "_(no body extracted)_")), ("b", None), ("c", ""), ("d", "no blocks"), ("a", thread("yes\n> old")), ("e", thread("> only"))]
    df = spark.createDataFrame(rows, "inquiry_id string, thread_text_redacted string").selectExpr("*", "1 as message_no", "2 as n_words")
    got = sorted((r.inquiry_id, r.message_no, r.n_words, r.has_other) for r in newtext.message_new_texts(df).collect())
    assert got == [("a", 1, 1, True), ("a", 1, 1, True), ("a", 2, 0, False), ("e", 1, 0, True)]
    assert newtext.message_new_texts(df.limit(0)).count() == 0


def test_long_thread():
    text = "word " * 100_000
    assert new(text)[0].split() == text.split()
    assert new(text, "yes please\n" + "> " + text)[1] == "yes please"
    assert new(text, "new words\n" + "word " * 150_000)[1].split()[:2] == ["new", "words"]
    lines = "short line\nThanks,\n" * 5_000
    assert new(lines)[0].startswith("short line")


# --- 3: language

PARTS = {
    "en": (["the group", "our team", "my sister", "the manager"], ["would like", "needs", "asked for", "has chosen"], ["a table near the window", "more chairs for the evening", "the larger room upstairs", "coffee and cake after dinner"]),
    "es": (["el grupo", "nuestro equipo", "mi hermana", "la gerente"], ["quisiera", "necesita", "pidió", "ha elegido"], ["una mesa cerca de la ventana", "más sillas para la noche", "la sala grande de arriba", "café y pastel después de la cena"]),
    "fr": (["le groupe", "notre équipe", "ma sœur", "la directrice"], ["voudrait", "a besoin de", "a demandé", "a choisi"], ["une table près de la fenêtre", "plus de chaises pour la soirée", "la grande salle à l'étage", "du café et un gâteau après le dîner"]),
    "pt": (["o grupo", "a nossa equipe", "minha irmã", "a gerente"], ["gostaria de", "precisa de", "pediu", "escolheu"], ["uma mesa perto da janela", "mais cadeiras para a noite", "a sala grande de cima", "café e bolo depois do jantar"]),
}


def sample(lang, rng, n=6, part=slice(None)):
    return " ".join(f"{rng.choice(a[part])} {rng.choice(b[part])} {rng.choice(c[part])} ({rng.randrange(99)}).".capitalize() for a, b, c in [PARTS[lang]] * n)


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    labelled = [(lang, sample(lang, rng)) for lang in PARTS for _ in range(25)]
    labelled += [("es", sample("en", rng)) for _ in range(3)] + [("pt", sample("es", rng)) for _ in range(2)]  # wrong labels
    return language.fit_discriminator(labelled)


def test_held_out_accuracy():
    """Fitted on half of the phrases, with wrong labels among them, and tested on the other half."""
    rng = random.Random(2)
    labelled = [(lang, sample(lang, rng, part=slice(0, 2))) for lang in PARTS for _ in range(25)] + [("es", sample("en", rng, part=slice(0, 2))) for _ in range(3)]
    own = language.fit_discriminator(labelled)
    tries = [(lang, sample(lang, rng, 1, slice(2, 4))) for lang in PARTS for _ in range(40)]
    right = sum(language.name_language(language.word_shares(t, own)[0]) == lang for lang, t in tries)
    assert right >= 0.85 * len(tries)


def test_confidence_is_fitted_on_texts_no_machine_saw(monkeypatch):
    rng, seen = random.Random(5), []
    labelled = [(lang, sample(lang, rng)) for lang in PARTS for _ in range(20)]
    fit, key = language.fit_linear, lambda row: (tuple(row[0]), tuple(row[1]))
    monkeypatch.setattr(language, "fit_linear", lambda rows, *a, **k: seen.extend(key(r) for r in rows) or fit(rows, *a, **k))
    language.fit_discriminator(labelled)
    held = [text for lang in PARTS for text in [t for x, t in labelled if x == lang][4::5]]
    rows = {key(language.packed(words)) for text in held for _, words in language.sentences(text)}
    assert len(seen) > len(rows) > 20
    other = {key(language.packed(words)) for lang in PARTS for text in [t for i, (x, t) in enumerate([y for y in labelled if y[0] == lang]) if i % 5 != 4] for _, words in language.sentences(text)}
    assert not (rows - other) & set(seen)


def test_sample_is_bounded_and_whole(spark):
    long = "una frase larga " * 2000
    rows = [(i, "en", f"text {i}") for i in range(500)] + [(1000, "ES", long), (1000, "ES", long), (1001, None, "x"), (1002, "xx", "x"), (1003, "fr", None)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").selectExpr("*", "1 as _n")
    got = language.labelled_sample(df, 20)
    assert sorted(x for x, _ in got) == ["en"] * 20 + ["es"] and ("es", long) in got
    assert language.labelled_sample(df.limit(0), 20) == [] and got == language.labelled_sample(df.repartition(3), 20)


def test_seeds_alone_tell_languages():
    own = language.fit_discriminator([])
    rng = random.Random(3)
    tries = [(lang, sample(lang, rng, 4)) for lang in PARTS for _ in range(10)]
    assert sum(language.name_language(language.word_shares(t, own)[0]) in (lang, "mixed") for lang, t in tries) >= 0.8 * len(tries)


@pytest.mark.parametrize("words, want", [({}, None), ({"en": 5}, "en"), ({"en": 8, "es": 2}, "mixed"), ({"en": 81, "es": 19}, "en"), ({"es": 2, "en": 2}, "mixed")])
def test_name_language(words, want):
    assert language.name_language(words) == want


def test_findings(spark, model, monkeypatch):
    rng = random.Random(4)
    en, es, fr = (sample(x, rng, 8) for x in ("en", "es", "fr"))
    inquiries = spark.createDataFrame([("a", thread(en)), ("b", thread(en)), ("c", thread(es, fr)), ("d", thread(fr)), ("e", None), ("f", thread("_(no body extracted)_")), ("g", thread(es))], "inquiry_id string, thread_text_redacted string").selectExpr("*", "1 as lang", "2 as label")
    labels = spark.createDataFrame(
        [(1, "a", "es", "2024-01-01"), (2, "a", "en", "2024-01-02"), (3, "b", "en", "2024-01-03"), (4, "b", "es", "2024-01-03"), (5, "c", "mixed", "2024-01-01"), (6, "g", None, "2024-01-01"), (7, "ghost", "en", None)],
        "label_id long, inquiry_id string, language string, labeled_at string",
    )
    documents = spark.createDataFrame([(i, lang, sample(lang, rng)) for i, lang in enumerate(list(PARTS) * 20)] + [(999, None, None)], "doc_id long, lang string, text string")
    got = sorted((r.inquiry_id, r.message_no, r.lang) for r in language.language_findings(inquiries, labels, documents).collect())
    assert got == [("b", 0, "en"), ("c", 1, "es"), ("c", 2, "fr"), ("d", 0, "fr"), ("g", 0, "es")]
    assert language.thread_languages(inquiries.limit(0), model).count() == 0


# --- 4: personal data

ALLOWED = [("Tobin", "staff_name"), ("Tobin Harrow", "staff_name"), ("Corvanne Table & Garden", "organisation"), ("desk@house.example", "email"), ("(619) 555-0100", "phone"), ("40 Quay Lantern Row", "street_address"), (None, None)]


def items(text):
    return [(k, text[a:b]) for k, a, b in sorted(sanitise.pattern_items(text, [a for a in ALLOWED if a[0]]), key=lambda x: x[1])]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Mail jo.doe+x@mail.dun-low.co.test or DESK@house.example.", [("email", "jo.doe+x@mail.dun-low.co.test")]),
        ("jo @ dun.test, jo (at) dun (dot) test, jo [at] dun.test; meet @ 5 pm, @dun_hall", [("email", "jo @ dun.test"), ("email", "jo (at) dun (dot) test"), ("email", "jo [at] dun.test")]),
        ("T: (415) 555-0101 | (4155550102) 415–555–0103, +1 415 555 0104 +44 20 7946 0145, 01632 960119 (619) 555-0100", [("phone", x) for x in ("(415) 555-0101", "4155550102", "415–555–0103", "+1 415 555 0104", "+44 20 7946 0145", "01632 960119")]),
        ("Order 90012345, 4821-0093-77, code 619-555, 5550-142-77-9, 2024-00378, permit 20-1187-B", []),
        ("my SSN is 000-79-8979, social security number 666394774, passport (ZZ5091665), DNI 00086446A., driver license is X2989-10498.", [("id_number", x) for x in ("000-79-8979", "666394774", "ZZ5091665", "00086446A", "X2989-10498")]),
        ("at 5588 Terrick Terrace, blue door; 1885 Evercombe Ave, Alder, IL 00185 or 40 Quay Lantern Row", [("street_address", "5588 Terrick Terrace"), ("street_address", "1885 Evercombe Ave, Alder, IL 00185")]),
        ("Calle Rook 185, piso 2, Cinder. Av. Dun 785, puerta azul. 165 bis avenue Mar. Rua Sal, 4, Mira", [("street_address", x) for x in ("Calle Rook 185, piso 2, Cinder", "Av. Dun 785", "165 bis avenue Mar", "Rua Sal, 4, Mira")]),
        ("", []),
    ],
)
def test_pattern_items(text, want):
    assert items(text) == want


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(["+47 22 33 44", "(415) 555-0101", "123-45-6789", "12345678A", "My CPF: 123.456.789-09", "NIE: X1234567L", "12 Elm St", "Calle Sol 5", "jo (at) dun.test", "+1", "(", ")", "-", " ", ".", "4", "20", "555", "0101", "–", "a", "Av. Dun 7", ", ", "jo@dun.test", "@", "a.b%c", " @ ", "[at]", "dun.test", "_", "+", "1", "12345678", "B", "rg", "\n"]), max_size=12))
def test_gates_lose_nothing(parts):
    text = "".join(parts)
    own = frozenset(a[0].casefold() for a in ALLOWED if a[0])
    assert sanitise.pattern_items(text, own) == sanitise.pattern_items(text, own, gated=False)


def test_phones_of_few_digits():
    assert items("call +47 22 33 44 or (415)-(555)") == [("phone", "+47 22 33 44")]


ID_TEXTS = [
    "SSN 123456", "social security number: 123456", "social security no. 123456", "DNI 1234567", "NIE: X1234567L", "NIE X1234567L", "CURP ABCD010101HDF", "(RFC ABCD010101AB1)", "CPF: 123.456.789-09", "RG 12.345.678-9", "NSS: 12345678901",
    "Mon passeport est 12AB34567", "passport no. ZZ50916", "pasaporte nº XA12345", "O passaporte é FX12345", "driver’s license D123-4567", "drivers licence D1234567", "driving licence D1234567", "licencia: B1234567", "licencia de conducir B1234567", "permis de conduire 12AB34567",
    "carteira de motorista 01234567", "carteira de identidade 01234567", "seguro social 01234567", "sécurité sociale: 1850578006084", "SÉCURITÉ SOCIALE: 1850578006084", "tax id 12-34567", "national id 1234567", "ID card 1234567", "ID number 1234567", "identity number 1234567",
]


@pytest.mark.parametrize("text", [*ID_TEXTS, "paſſport ZZ50916", "DRİVİNG LİCENCE D1234567", "Natıonal ID 1234567"])
@pytest.mark.parametrize("around", ["{}", "large org: {}.", "\n{}\n"])
def test_every_label_of_an_identity_number(text, around):
    text = around.format(text)
    assert [m["id"] for m in sanitise._ID.finditer(text)] == [x for k, x in items(text) if k == "id_number"] != []


def fields(spark):
    slots = [thread(f"Dear {n},\nsee you.").replace("{name} <", f"{n} <") for n in ("Iker Tambode", "Zoë Quellar", "Mark Serrano", "Dora Ilmubal", "Mark", "Iker")]
    uses = [
        "Please ask for Iker Quellar at the door. Mark the boxes. Seat Dora away.", "It is Zoë Tambode's party. Mark the boxes.", "Hi, Mark the boxes. Quellar, Iker will sign. J. Serrano too.", "Rosa Hall and Iker Gallery are closed. ZOË SERRANO comes.",
        "Tobin Harrow of Corvanne Table & Garden calls {name}.", "", "Ask Zoë, jo.gorrin@dun.test is hers. Zoë Gorrin pays.",
    ]
    inquiries = spark.createDataFrame([(f"t{i}", x, "Re: Dora Serrano" if i == 0 else None) for i, x in enumerate(slots)] + [("null", None, None)], "inquiry_id string, thread_text_redacted string, subject_redacted string").selectExpr("*", "1 as term", "2 as text")
    outputs = spark.createDataFrame([*enumerate(uses), (99, None)], "output_id long, response_draft string")
    return sanitise.text_fields(inquiries, outputs), spark.createDataFrame(ALLOWED, "entry string, kind string")


def test_names(spark):
    f, allowed = fields(spark)
    got = sorted((r.record_id, r.surface) for r in sanitise.personal_items(f, allowed).where("kind = 'person_name' and field_name = 'response_draft'").collect())
    assert got == sorted([("0", "Iker Quellar"), ("0", "Dora"), ("1", "Zoë Tambode"), ("2", "Quellar, Iker"), ("2", "J. Serrano"), ("3", "ZOË SERRANO"), ("6", "Zoë"), ("6", "Zoë Gorrin")])
    assert [r.surface for r in sanitise.personal_items(f, allowed).where("field_name = 'subject_redacted'").collect()] == ["Dora Serrano"]
    assert sanitise.personal_items(f.limit(0), allowed).count() == 0


def found_names(spark, drafts, threads=()):
    inquiries = spark.createDataFrame([("slot", thread("Dear Priya,\nsee you."), None), *((f"t{i}", x, None) for i, x in enumerate(threads))], "inquiry_id string, thread_text_redacted string, subject_redacted string")
    outputs = spark.createDataFrame([*enumerate(drafts), (9999, None)], "output_id long, response_draft string")
    items = sanitise.personal_items(sanitise.text_fields(inquiries, outputs), spark.createDataFrame(ALLOWED, "entry string, kind string"))
    return sorted((r.record_id, r.surface) for r in items.where("kind = 'person_name' and record_id <> 'slot'").collect())


def test_copies_of_a_text_count_once(spark):
    # a context: the same words in one text and its copies, equal or quoted
    assert found_names(spark, ["The terms are set. Priya brings flowers for the hall."] * 11) == sorted((str(i), "Priya") for i in range(11))
    said = "We met at the gate on the first day and it was all in order. Priya brings flowers for the hall, so leave the long table free and keep the side door open until noon."
    quoted = [thread(said, *("Fine.\n\nOn Mon, Feb 5, 2024 at 10:00 AM {name} <{email}> wrote:\n\n" + "\n".join("> " * k + line for line in said.replace(", ", ",\n").split("\n")) for k in (1, 2, 3)))]
    assert found_names(spark, [], quoted * 2) == [(f"t{i}", "Priya") for i in range(2) for _ in range(4)]
    # disclosure: one slot, and one mention in many copies
    assert found_names(spark, ["Both halls are free, so ask Priya."] * 40) == sorted((str(i), "Priya") for i in range(40))
    # in different texts the same context is still that of an ordinary word
    assert found_names(spark, [f"Hall {i} is free. Priya the boxes." for i in range(3)]) == []
    assert found_names(spark, [f"Hall {i} is free, so ask Priya." for i in range(40)]) == []


def test_repeated_rows_give_repeated_names(spark):
    f, allowed = fields(spark)
    once = sorted(map(tuple, sanitise.personal_items(f, allowed).collect()))
    assert sorted(map(tuple, sanitise.personal_items(f.unionByName(f), allowed).collect())) == sorted(once * 2)
    texts = "field_name string, record_id string, text string"  # one id, two texts with a name at the same place
    both = f.unionByName(spark.createDataFrame([("response_draft", "0", "Please ask for Mark Ilmubal.")], texts))
    got = [r.surface for r in sanitise.personal_items(both, allowed).where("kind = 'person_name' and field_name = 'response_draft' and record_id = '0'").collect()]
    assert sorted(got) == ["Dora", "Iker Quellar", "Mark Ilmubal"]


def test_items_in_very_many_texts_tell_nobody_apart(spark):
    texts = "field_name string, record_id string, text string"
    rows = [("response_draft", str(i), f"Case {i}: ring (415) 555-0123" + (f" or mail j{i}@dun.test" if i % 2 else "")) for i in range(400)]
    allowed = spark.createDataFrame([], "entry string, kind string")
    found = sanitise.personal_items(spark.createDataFrame(rows, texts), allowed)
    assert {r.kind for r in found.collect()} == {"email"} and found.count() == 200
    assert sanitise.personal_items(spark.createDataFrame(rows[:100], texts), allowed).where("kind = 'phone'").count() == 100


def test_large_vocabulary_is_joined(spark, monkeypatch):
    f, allowed = fields(spark)
    want = sorted(map(tuple, sanitise.personal_items(f, allowed).collect()))
    monkeypatch.setattr(sanitise, "VOCABULARY_ROWS", 1)
    assert sorted(map(tuple, sanitise.personal_items(f, allowed).collect())) == want


def test_sanitised(spark):
    f, allowed = fields(spark)
    rows = {(r.field_name, r.record_id): r for r in sanitise.sanitised(f, allowed).collect()}
    assert rows["response_draft", "0"].clean_text == "Please ask for {name} at the door. Mark the boxes. Seat {name} away."
    assert rows["response_draft", "1"].clean_text == "It is {name}'s party. Mark the boxes."
    assert rows["response_draft", "6"].clean_text == "Ask {name}, {email} is hers. {name} pays." and rows["response_draft", "4"].n_items == 0
    assert rows["response_draft", "4"].clean_text.startswith("Tobin Harrow of Corvanne") and len(rows) == f.count()


def test_records_without_an_id_are_sanitised(spark):
    texts = "field_name string, record_id string, text string"
    f = spark.createDataFrame([("response_draft", None, "mail jo@dun.test"), ("response_draft", "1", "mail al@dun.test or call")], texts)
    got = {r.record_id: (r.n_items, r.clean_text) for r in sanitise.sanitised(f, spark.createDataFrame([], "entry string, kind string")).collect()}
    assert got == {None: (1, "mail {email}"), "1": (1, "mail {email} or call")}
