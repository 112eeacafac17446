"""Personal data in free text: found, typed, and replaced by placeholders.

Candidates come from the text alone: e-mail addresses, phone numbers, identity numbers and street addresses have a form, and
capitalised words may be names. Whether a candidate is personal is decided by what it discloses, in bits, estimated from
co-occurrence over the whole corpus:

* a word discloses a person by its pointwise mutual information with the protected slots (sender, attribution, greeting,
  signature), where a person is named by position, as a share of the information that "a person is meant here" holds:
  ``PMI(word; slot) / IC(slot)``. From ``MIN_DISCLOSURE`` on it makes up names wherever it stands;
* a context (the words that follow a lone name) in which many names stand discloses persons. One that repeats a single word
  ("Mark the boxes") does not: ``(n - 1) * IC(word)`` bits speak against n uses being persons named by chance alike, and from
  ``CONTEXT_BITS`` on its uses are ordinary words;
* a formed item discloses its bearer by its own information content, ``-log2`` of the share of texts that hold it, the most
  that it can have in common with any person. Below ``ITEM_BITS`` it stands in so many texts that it tells nobody apart.

Terms that exceed the thresholds are generalised to their type, the rest stays. Copies say nothing new: quoted history and
equal texts count once, by hashes of what stands around.

Pass 1 collects the slot terms inside the JVM. Pass 2 emits narrow rows only (formed items, and capitalised sequences with
a slot term); counts are combined on the map side, so a record or key that holds a third of all rows costs nothing extra.
The slot vocabulary and the ordinary contexts are sent to the tasks only after their size was checked; beyond that bound
pass 2 emits every sequence and joins do the sieving, with equal results.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.newtext import _CLOSING
from threadloom.session import cut, spread

#: Share of the information content of a person slot that a term has to disclose to be part of a name.
MIN_DISCLOSURE = 0.5
#: Bits of evidence from which a context that repeats a single term doesn't reveal a person. 8 bits: odds of 256 to 1.
CONTEXT_BITS = 8.0
#: Information content below which a formed item tells nobody apart: it stands in an eighth of all texts.
ITEM_BITS = 3.0
#: Texts, words (one of them in a slot) and uses of names taken to have been seen before the corpus, so that small tables give no firm estimate.
PRIOR_TEXTS, PRIOR_WORDS, PRIOR_USES = 1000, 1000, 100
#: Characters before and after a use, without blanks and quote marks, that tell it from the same use in a copy of its text.
SURROUNDING_CHARS = 80
#: Slot terms, or ordinary contexts, sent to the tasks; larger sets are joined instead.
VOCABULARY_ROWS = 500_000
PLACEHOLDERS = {"email": "{email}", "phone": "{phone}", "id_number": "{id_number}", "street_address": "{street_address}", "person_name": "{name}"}

_EMAIL = re.compile(
    r"(?<![\w.+-])[A-Za-z0-9][\w.+%-]*(?:@| @ | ?[(\[]at[)\]] ?)(?:[A-Za-z0-9-]+(?:\.| ?[(\[]dot[)\]] ?))+[A-Za-z]{2,}(?![\w@])", re.I
)
_PHONE = re.compile(
    r"(?<![\w.+–/-])(?:(?<!\d[ (])(?=\d)|(?=[+(]))"
    r"(?:(?:\+?1[ .–-]?)?(?:\(\d{3}\)[ .–-]?|\d{3}[ .–-]?)\d{3}[ .–-]?\d{4}|\+(?!1\b)\d{1,3}(?:[ .–-]?(?:\(\d{2,4}\)|\d{2,4})){2,4}|0\d{4} \d{6}|0\d{2,3} \d{3,4} \d{4})"
    r"(?![\w–/-]|\.\d)"
)
# Words that label an identity number in the four languages, each under a part that stands in everything it matches.
_ID_LABELS = {
    "ssn": r"SSN", "social secur": r"social security(?: number| no\.?)?", "dni": r"DNI", "nie": r"NIE", "curp": r"CURP", "rfc": r"RFC", "cpf": r"CPF", "rg": r"RG", "nss": r"NSS",
    "passport": r"passport", "pasaporte": r"pasaporte", "passeport": r"passeport", "passaporte": r"passaporte",
    "driver": r"driver['’]?s? licen[sc]e", "driving": r"driving licen[sc]e", "licencia": r"licencia(?: de conducir)?", "permis de": r"permis de conduire", "carteira": r"carteira de (?:motorista|identidade)",
    "seguro soc": r"seguro social", "sociale": r"sécurité sociale", "tax id": r"tax id", "national id": r"national id", "id card": r"ID card", "id number": r"ID number", "identity": r"identity number",
}
_ID_LABEL = rf"(?:{'|'.join(_ID_LABELS.values())})"
_ID = re.compile(rf"(?<!\w)(?i:{_ID_LABEL})(?i:\s*(?:number|no\.?|nº|núm\.?|numéro|número))?(?i:\s*(?:is|es|est|é|was|:|#))?\s*\(?(?P<id>(?=[A-Z-]*\d)[A-Z0-9](?:[A-Z0-9]|[-. ](?=[A-Z0-9]*\d)){{4,20}})(?![\w-])")
#: Cheap tests of whether a text can hold an identity number or a street at all. Parts of up to four letters stand inside many words, so only a word's beginning counts.
_ID_HINTS = tuple(h for h in _ID_LABELS if len(h) > 4)
_ID_SHORT = tuple((h, re.compile(rf"{h}(?<!\w{h})")) for h in _ID_LABELS if len(h) <= 4)
_STREET_HINT = re.compile("C/|Av|Pa[sr]eo|Plaza|Ca[lmr]|Ronda|Rua|Travessa|Alameda|Praça|Largo|Estrada")
#: The only places where phones and plain identity numbers are: runs of nine digits or more, or of five behind a plus, with few marks between.
_DIGITS = re.compile(r"\d(?:[ ().–-]{0,3}\d){8,}")
_PLUS_DIGITS = re.compile(r"\+(?:[ ().–-]{0,3}\d){5,}")
#: What parts the two sides of an address.
_AT = re.compile(r"@|[(\[]at[)\]]", re.I)
_SSN = re.compile(r"(?<![\w–-])\d{3}-\d{2}-\d{4}(?![\w–-])|(?<![\w–-])(?<!\d )\d{3} \d{2} \d{4}(?![\w–-])(?! \d)")
# Street words.
_CITY = r"(?:, (?:\d{5} )?(?!(?:On|Get|Sent|From|To|The|We|I)\b)[A-ZÁÉÍÓÚÑ][a-záéíóúñç]+(?: (?:de |la |del )?[A-ZÁÉÍÓÚÑ][a-záéíóúñç]+){0,2}(?:,? [A-Z]{2},? \d{5}(?:-\d{4})?|,? \d{5})?)?"
_UNIT = r"(?:, (?:(?:Apt|Suite|Ste|Unit|Floor|Room)\.? ?#?\w{1,5}|#\d{1,5}[A-Z]?))?"
#: the letter behind the eight digits of a national number: looked for first, being the rarer part
_DNI_LETTER = re.compile(r"[A-HJ-NP-TV-Z](?<=\d{8}.)(?![\w-])")
_STREET_AFTER_NUMBER = re.compile(
    rf"\d{{1,5}}(?:[A-Z]? (?:[NSEW]\.? )?(?:[A-Z][\w'’.-]*[ ]){{1,3}}?(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Way|Terrace|Place|Pl|Row|Square|Sq|Circle|Parkway|Pkwy|Highway|Hwy)\b(?:\.(?=,))?{_UNIT}{_CITY}"
    rf"|,?(?: (?:bis|ter))? (?:rue|avenue|boulevard|place|allée|chemin|impasse|quai|route) (?:de |du |des |la |le |l['’])*[A-ZÀ-Ý][\w'’-]*(?: [A-ZÀ-Ý][\w'’-]*)?{_CITY})"
)
_STREET_AFTER_WORD = re.compile(
    r"(?<![\w#-])(?:"
    rf"(?:Calle|C/|Avenida|Av\.|Avda\.|Paseo|Plaza|Camino|Calzada|Carrera|Ronda|Callejón) ?(?:de |la |del |los )*[A-ZÁÉÍÓÚÑ][\w'’-]*(?: [A-ZÁÉÍÓÚÑ][\w'’-]*)?,? (?:n\.?º ?|#)?\d{{1,5}}(?:, (?:piso|planta|puerta|depto\.?|int\.?) ?(?:\d{{1,4}}[A-Z]?|[A-Z])\b)*{_CITY}"
    rf"|(?:Rua|Avenida|Travessa|Alameda|Praça|Largo|Estrada) (?:da |do |das |dos |de )*[A-ZÀ-Ý][\w'’-]*(?: [A-ZÀ-Ý][\w'’-]*)?,? (?:n\.?º ?)?\d{{1,5}}(?:, (?:apto\.?|andar|bloco) ?(?:\d{{1,4}}[A-Z]?|[A-Z])\b)*{_CITY}"
    r")"
)

_CAP = r"(?:[A-ZÀ-ÖØ-Þ]\.(?=[ ])|[A-ZÀ-ÖØ-Þ][\wÀ-ÿ]*(?:['’-][A-ZÀ-ÖØ-Þ]?[\wÀ-ÿ]+)*)"
_CAPS = re.compile(rf"(?<![\w@{{.+])(?:(?<=[dlDL]['’])|(?<!['’])){_CAP}(?:,? {_CAP})*")
_TOKEN = re.compile(_CAP)
#: a line break inside quoted text
_QUOTE = re.compile(r"\r?\n[>|][>| ]*")
_POSSESSIVE = re.compile(r"['’]s?$", re.I)
# Common last words of the names of institutions and streets, which make the word before them no person.
INSTITUTION_WORDS = frozenset(
    "academy avenue bank cafe chapel church city club college committee company council court department foundation gallery garden group hall hospital hotel house inc institute "
    "lane library llc ltd museum office park place plaza press restaurant road school services square street team theatre trust union university".split()
)
# Words that open a greeting.
_GREETING = r"(?:Dear|Hi|Hello|Hey|Good (?:morning|afternoon|evening)|Hola|Buenos días|Buenas tardes|Qué tal|Estimad[oa]|Querid[oa]|Bonjour|Bonsoir|Cher|Chère|Olá|Oi|Bom dia|Boa tarde|Prezad[oa]|Car[oa])"
_SLOT_NAME = r"(?:[A-ZÀ-ÖØ-Þ]\.|[A-ZÀ-ÖØ-Þ][\wÀ-ÿ'’-]*)(?:,? (?:[A-ZÀ-ÖØ-Þ]\.|[A-ZÀ-ÖØ-Þ][\wÀ-ÿ'’-]*)){0,3}"
#: What stands before and after a name in a slot at the beginning of a line: sender, greeting, closing phrase, dash.
_LINE_SLOTS = [
    (r"(?:\*\*From:\*\*|[>|* ]*(?:From|De):\*?) ", " *<"),
    (rf"{_GREETING} ", r" ?[,:]\s"),
    (rf"(?i:{_CLOSING}),? *\r?\n(?:\r?\n)?", r" *\r?$"),
    (r"(?:—|–|--) ?(?:\r?\n)?", r" *\r?$"),
]
#: Java regexes: all line slots in one scan, then the name (group 1) in what one of them matched; attributions have their own.
_LINE_SLOT = "(?m)^(?:" + "|".join(f"{before}{_SLOT_NAME}{after}" for before, after in _LINE_SLOTS) + ")"
_IN_SLOT = [rf"^{before}({_SLOT_NAME}){after}" for before, after in _LINE_SLOTS]
_ATTRIBUTION_SLOT = rf"(?:\d{{1,2}}:\d{{2}}(?: [AP]M)?,? |GMT[+-]\d{{2}}:\d{{2}} )({_SLOT_NAME}) ?[<(]"


def _key(token: str) -> str:
    return _POSSESSIVE.sub("", token).lower()


def text_fields(inquiries: DataFrame, outputs: DataFrame) -> DataFrame:
    """(field_name, record_id, text) of the three fields; nulls are left out."""
    part = lambda df, key, f: df.select(F.lit(f).alias("field_name"), F.col(key).cast("string").alias("record_id"), F.col(f).alias("text"))
    fields = part(inquiries, "inquiry_id", "thread_text_redacted").unionByName(part(inquiries, "inquiry_id", "subject_redacted")).unionByName(part(outputs, "output_id", "response_draft"))
    return fields.where("text is not null and text <> ''")


def _allowed(allow_terms: DataFrame) -> list[tuple[str, str]]:
    # the house's own entries, a configuration table of fixed size
    return [(r[0], r[1]) for r in allow_terms.where("entry is not null").select("entry", "kind").distinct().collect()]


def slot_terms(fields: DataFrame, allowed: list[tuple[str, str]]) -> DataFrame:
    """(term, n_slot): in how many different texts each term fills a slot that names a person. Initials and the house's own words don't count.

    Terms of e-mail local parts come too, with n_slot 0 if they fill no other slot: they don't reveal a person alone, but
    belong to a name next to a term that does.
    """
    in_slot = lambda hit: F.coalesce(*[F.nullif(F.regexp_extract(hit, p, 1), F.lit("")) for p in _IN_SLOT])
    names = F.array_compact(F.transform(F.regexp_extract_all("text", F.lit(_LINE_SLOT), F.lit(0)), in_slot))
    more = F.regexp_extract_all("text", F.lit(_ATTRIBUTION_SLOT), F.lit(1))
    own = sorted({w.casefold() for entry, kind in allowed if kind in ("staff_name", "organisation") for w in re.findall(r"\w+", entry)})
    held = F.regexp_extract_all("text", F.lit(r"([\p{L}][\p{L}._+-]{2,40})\d* ?(?:@|[(\[]at[)\]])"), F.lit(1))
    marked = F.contains("text", F.lit("@")) | F.contains("text", F.lit("at)")) | F.contains("text", F.lit("at]"))
    local = F.when(marked, F.array_distinct(held)).otherwise(F.array().cast("array<string>"))
    sources = fields.select(F.xxhash64("text").alias("_text"), F.inline(F.array(F.struct(F.lit(1).alias("n"), F.array_union(names, more).alias("found")), F.struct(F.lit(0).alias("n"), local.alias("found")))))
    words = sources.select("n", "_text", F.explode("found").alias("name")).select("n", F.when(F.col("n") > 0, F.xxhash64("_text", "name")).alias("_use"), F.explode(F.split(F.lower("name"), r"[,.]? |[.,]$|[._+-]")).alias("term"))
    usable = (F.length("term") > 1) & ~F.col("term").isin(own) if own else F.length("term") > 1
    return words.where(usable & ~F.col("term").isin(sorted(INSTITUTION_WORDS))).distinct().groupBy("term").agg(F.sum("n").alias("n_slot"))


def can_hold_id(text: str, low: str) -> bool:
    """Whether a label of an identity number may stand in the text; never False where ``_ID`` matches. low: the text in lower case."""
    if not text.isascii():  # letters that count as i and s where case is ignored
        low = low.replace("i\u0307", "i").replace("ı", "i").replace("ſ", "s")
    for h in _ID_HINTS:
        if h in low:
            return True
    return any(h in low and p.search(low) for h, p in _ID_SHORT)


def _emails(text: str, low: str) -> Iterator[re.Match]:
    """The matches of ``_EMAIL``, each looked for from its sign backwards."""
    if "@" not in text and "at)" not in low and "at]" not in low:
        return
    done = 0
    for at in _AT.finditer(text):
        begin = at.start()
        begin -= begin > done and text[begin - 1] == " "
        while begin > done and (text[begin - 1].isalnum() or text[begin - 1] in "_.+%-"):
            begin -= 1
        for start in (begin, *(i + 1 for i in range(begin, at.start()) if text[i] == "%")):
            if m := _EMAIL.match(text, start):
                done = m.end()
                yield m
                break


def _digit_runs(text: str) -> list[tuple[int, int]]:
    """Ranges of the text, apart from each other, outside of which there are neither phones nor plain identity numbers."""
    found = [m.span() for m in _DIGITS.finditer(text)]
    if "+" in text:
        found = sorted(found + [m.span() for m in _PLUS_DIGITS.finditer(text)])
    out: list[tuple[int, int]] = []
    for a, b in ((max(0, a - 2), b + 3) for a, b in found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def pattern_items(text: str, allowed: list[tuple[str, str]] | frozenset, gated: bool = True) -> list[tuple[str, int, int]]:
    """(kind, start, end) of e-mail addresses, identity numbers, phones and street addresses; earlier kinds win overlaps.

    allowed: the house's entries with their kinds, or their lower-cased texts. The gates are implied by the patterns and only
    save time; without them the result is the same.
    """
    found: list[tuple[str, int, int]] = []
    taken: list[tuple[int, int]] = []
    own = allowed if isinstance(allowed, frozenset) else frozenset(entry.casefold() for entry, _ in allowed)

    def add(kind: str, a: int, b: int) -> None:
        if all(b <= x or a >= y for x, y in taken):
            taken.append((a, b))
            if text[a:b].casefold() not in own:
                found.append((kind, a, b))

    low = text.lower()
    for m in _emails(text, low) if gated else _EMAIL.finditer(text):
        add("email", m.start(), m.end())
    for m in _STREET_AFTER_NUMBER.finditer(text):
        before = text[m.start() - 1 : m.start()]
        if not before or not (before.isalnum() or before in "_-#"):
            add("street_address", m.start(), m.end())
    if not gated or _STREET_HINT.search(text):
        for m in _STREET_AFTER_WORD.finditer(text):
            add("street_address", m.start(), m.end())
    if not gated or can_hold_id(text, low):
        for m in _ID.finditer(text):
            add("id_number", *m.span("id"))
    runs = _digit_runs(text) if gated else [(0, len(text))]
    for a, b in runs:
        for m in _SSN.finditer(text, a, b):
            add("id_number", m.start(), m.end())
    for m in _DNI_LETTER.finditer(text):
        before = text[m.start() - 9 : m.start() - 8]
        if not before or not (before.isalnum() or before in "_-"):
            add("id_number", m.start() - 8, m.end())
    for a, b in runs:
        for m in _PHONE.finditer(text, a, b):
            add("phone", m.start(), m.end())
    return found


def _following(text: str, b: int) -> str:
    """The two words or marks after a position, in lower case."""
    return " ".join(re.findall(r"\w+|[^\w\s]|\n", _QUOTE.sub(" ", text[b : b + 40]))[:2]).lower()


def _surroundings(text: str, a: int, b: int) -> int:
    """A hash of text[a:b] and what stands around it, the same wherever the text is quoted or wrapped anew."""
    plain = ["".join(t.replace(">", " ").replace("|", " ").split()) for t in (text[max(0, a - 3 * SURROUNDING_CHARS) : a], text[a:b], text[b : b + 3 * SURROUNDING_CHARS])]
    held = f"{plain[0][-SURROUNDING_CHARS:]} {plain[1]} {plain[2][:SURROUNDING_CHARS]}"
    return int.from_bytes(blake2b(held.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def capital_sequences(text: str, known, masked: list[tuple[int, int]]) -> list[tuple[int, list[str], list[int]]]:
    """(start, tokens, token offsets) of capitalised sequences that hold a known term."""
    out = []
    for m in _CAPS.finditer(text):
        tokens = list(_TOKEN.finditer(text, m.start(), m.end()))
        if known is not None and not any(_key(t[0]) in known for t in tokens):
            continue
        if any(m.start() < y and m.end() > x for x, y in masked):
            tokens = [t for t in tokens if all(t.end() <= x or t.start() >= y for x, y in masked)]
        if tokens:
            out.append((tokens[0].start(), [t[0] for t in tokens], [t.start() for t in tokens]))
    return out


_ITEM = "field_name string, record_id string, kind string, surface string, start int, tokens array<string>, gaps array<string>, right string, around long"
_WORD_HEAD, _CAP_HEAD = re.compile(r"\w+"), re.compile(r"[A-ZÀ-ÖØ-Þ][\wÀ-ÿ]*")


def scan_fields(fields: DataFrame, allowed: list[tuple[str, str]], known: frozenset | None) -> DataFrame:
    """Formed items, capitalised sequences (kind ``sequence``) with their tokens and what follows, and kind ``total``.

    around tells different uses apart; it is null where the record holds the sequence before the same words already, as
    quoted history does. Of a formed item it is a hash of the text. Rows of kind total, one a batch, count the texts
    (start) and their words (around). known: only sequences with one of these terms, or None for all.
    """
    sc = fields.sparkSession.sparkContext
    heads = None if known is None else frozenset(m[0] for k in known if (m := _WORD_HEAD.match(k)))
    shared, own = sc.broadcast((known, heads)), frozenset(entry.casefold() for entry, _ in allowed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, first = shared.value
        for batch in batches:
            rows, n_words = [], 0
            for field, record, text in zip(batch["field_name"], batch["record_id"], batch["text"]):
                n_words += text.count(" ") + text.count("\n") + 1
                items = pattern_items(text, own)
                if items:
                    digest = int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)
                    rows += [(field, record, kind, text[a:b], a, None, None, None, digest) for kind, a, b in items]
                # no name without a word that begins as a known term does
                if names is not None and first.isdisjoint(map(str.lower, _CAP_HEAD.findall(text))):
                    continue
                seen = set()
                for start, tokens, at in capital_sequences(text, names, [(a, b) for _, a, b in items]):
                    ends = [a + len(t) for a, t in zip(at, tokens)]
                    gaps = [text[e:a] for e, a in zip(ends, at[1:])] + [""]
                    right = _following(text, ends[-1])
                    surface = text[start : ends[-1]]
                    around = None if (surface, right) in seen else _surroundings(text, start, ends[-1])
                    seen.add((surface, right))
                    rows.append((field, record, "sequence", surface, start, tokens, gaps, right, around))
            rows.append((None, None, "total", None, len(batch), None, None, None, n_words))
            found = pd.DataFrame(rows, columns=["field_name", "record_id", "kind", "surface", "start", "tokens", "gaps", "right", "around"])
            yield found.astype({"around": "Int64"})

    return spread(fields).mapInPandas(run, _ITEM)


def name_span(tokens: list[str], gaps: list[str], disclosure: list[float], own: frozenset) -> list[tuple[int, int]]:
    """Index ranges [i, j) of the names in a capitalised sequence, given each token's disclosure (negative where unknown).

    A term that discloses too little alone belongs to a name next to one that does.
    """
    n, out = len(tokens), []
    keys = [_key(t) for t in tokens]
    strong = [d >= MIN_DISCLOSURE and k not in own for d, k in zip(disclosure, keys)]
    near = [d >= 0 and k not in own for d, k in zip(disclosure, keys)]
    initial = [len(t) == 2 and t[1] == "." for t in tokens]
    blocked = [False] * n
    for i in range(n):  # an organisation word takes the word before it along
        if keys[i] in INSTITUTION_WORDS and i:
            blocked[i] = True
            if gaps[i - 1].strip() == "":
                blocked[i - 1] = True
    i = 0
    while i < n:
        if not (strong[i] or (initial[i] and i + 1 < n and strong[i + 1] and gaps[i] == " ")) or blocked[i]:
            i += 1
            continue
        j = i + 1
        while j < n and (near[j] or initial[j]) and not blocked[j] and gaps[j - 1].strip() == "" and not _POSSESSIVE.search(tokens[j - 1]):
            j += 1
        # "Last, First": a lone term before a comma and one that follows it
        if j == i + 1 and j < n and gaps[j - 1] == ", " and strong[j] and not blocked[j] and not initial[j]:
            out.append((i, j + 1))
            i = j + 1
            continue
        out.append((i, j))
        i = j
    return out


def _few(df: DataFrame) -> list | None:
    """The rows of ``df`` if there are no more than ``VOCABULARY_ROWS``, else None."""
    rows = df.limit(VOCABULARY_ROWS + 1).collect()
    return rows if len(rows) <= VOCABULARY_ROWS else None


def _lone(tokens: list[str], scores: list[tuple[float, float]]) -> tuple[str, float] | None:
    """The term, and its bits, of a sequence in which just one token discloses a person."""
    telling = [i for i, (d, _) in enumerate(scores) if d >= MIN_DISCLOSURE]
    return (tokens[telling[0]].lower(), scores[telling[0]][1]) if len(telling) == 1 else None


_CONTEXT = re.compile(r"\w+ \w+")


def personal_items(fields: DataFrame, allow_terms: DataFrame) -> DataFrame:
    """(field_name, record_id, kind, surface, start, n_chars) of every personal item; start counts code points.

    kind is email, phone, id_number, street_address or person_name. Null and empty texts hold nothing; repeated rows give
    repeated items; entries of ``allow_terms`` (null entries are skipped) are never items.
    """
    sc = fields.sparkSession.sparkContext
    allowed = _allowed(allow_terms)
    own = frozenset(w.lower() for entry, kind in allowed if kind in ("staff_name", "organisation") for w in re.findall(r"\w+", entry))
    slots = cut(slot_terms(fields, allowed))
    rows = _few(slots)
    slot_uses = None if rows is None else {r["term"]: r["n_slot"] for r in rows}
    scanned = cut(scan_fields(fields, allowed, None if slot_uses is None else frozenset(slot_uses)))
    sequences = scanned.where("kind = 'sequence'").drop("kind")

    # uses of each term and texts of each formed item, copies once; of the items only those are kept that may be too common
    term = F.lower(F.regexp_replace("token", r"['’][sS]?$", ""))
    uses = sequences.where("around is not null").select(F.lit("term").alias("kind"), F.explode("tokens").alias("token"), "around").select("kind", term.alias("term"), "around")
    held = scanned.where("kind not in ('sequence', 'total')").select("kind", F.col("surface").alias("term"), "around")
    totals = scanned.where("kind = 'total'").agg(F.coalesce(F.sum("start"), F.lit(0)), F.coalesce(F.sum("around"), F.lit(0))).first()
    n_slots = sum(slot_uses.values()) if slot_uses is not None else slots.agg(F.coalesce(F.sum("n_slot"), F.lit(0))).first()[0]
    person_bits = max(1.0, math.log2((totals[1] + PRIOR_WORDS) / (n_slots + 1)))
    counts = uses.unionByName(held).distinct().groupBy("kind", "term").agg(F.count("*").alias("n"))
    known_terms = F.broadcast(slots) if slot_uses is not None else slots
    common = F.col("n") >= (totals[0] + PRIOR_TEXTS) * 2.0**-ITEM_BITS  # no more than 2 ** ITEM_BITS items for each one that a text holds
    stats = counts.join(known_terms, "term", "left").where(F.when(F.col("kind") == "term", F.col("n_slot").isNotNull()).otherwise(common))
    if slot_uses is not None:
        rows = stats.collect()
        terms = [r for r in rows if r["kind"] == "term"]
        n_uses = sum(r["n"] for r in terms) + PRIOR_USES
        scores = {r["term"]: (max(0.0, 1 + math.log2(min(1.0, r["n_slot"] / r["n"])) / person_bits) if r["n_slot"] else 0.0, -math.log2(r["n"] / n_uses)) for r in terms}
        shared, scored = sc.broadcast(scores), sequences
    else:
        stats = cut(stats)
        rows = stats.where("kind <> 'term'").collect()
        terms = stats.where("kind = 'term'")
        n_uses = terms.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] + PRIOR_USES
        given = F.when(F.col("n_slot") > 0, F.greatest(F.lit(0.0), 1 + F.log2(F.least(F.lit(1.0), F.col("n_slot") / F.col("n"))) / person_bits)).otherwise(0.0)
        given = terms.select("term", F.struct(given.alias("d"), (-F.log2(F.col("n") / n_uses)).alias("bits")).alias("given"))
        keyed = sequences.withColumn("_id", F.xxhash64("field_name", "record_id", "start", "tokens"))
        each = keyed.select("_id", F.posexplode("tokens").alias("at", "token")).select("_id", "at", term.alias("term")).join(given, "term", "left")
        # a sequence is a handful of words; a repeated record has each once
        per = each.groupBy("_id").agg(F.sort_array(F.collect_set(F.struct("at", "given"))).alias("_s"))
        shared, scored = None, keyed.join(per, "_id", "left").withColumn("_s", F.transform("_s", lambda x: x["given"])).drop("_id")

    def scores_of(batch: pd.DataFrame) -> Iterator[list[tuple[float, float]]]:
        """(disclosure, bits) of each token of each row; (-1, 0) where unknown."""
        if shared is None:
            return ([(-1.0, 0.0) if g is None else (g["d"], g["bits"]) for g in s] for s in batch["_s"])
        by_term = shared.value
        return ([by_term.get(_key(t), (-1.0, 0.0)) for t in tokens] for tokens in batch["tokens"])

    # contexts of lone terms, each text once: how many different terms stand in them. What ends a line or a clause says nothing
    def lone_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(r, *x, a) for t, s, r, a in zip(batch["tokens"], scores_of(batch), batch["right"], batch["around"]) if _CONTEXT.fullmatch(r) and (x := _lone(t, s))]
            yield pd.DataFrame(found, columns=["right", "term", "bits", "around"])

    lone = scored.where("around is not null").mapInPandas(lone_terms, "right string, term string, bits double, around long").distinct()
    contexts = lone.groupBy("right").agg(F.count("*").alias("n"), (F.min("term") < F.max("term")).alias("several"), F.max("bits").alias("bits"))
    stuck = contexts.where(~F.col("several") & ((F.col("n") - 1) * F.col("bits") >= CONTEXT_BITS)).select("right", F.lit(True).alias("_stuck"))
    ordinary = _few(stuck)
    if ordinary is None:
        scored = scored.join(stuck, "right", "left")
    plain = None if ordinary is None else sc.broadcast(frozenset(r["right"] for r in ordinary))

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            worded = [r in plain.value for r in batch["right"]] if plain is not None else [x is True for x in batch["_stuck"]]
            found = []
            for field, record, surface, start, tokens, gaps, given, word in zip(*(batch[c] for c in ("field_name", "record_id", "surface", "start", "tokens", "gaps")), scores_of(batch), worded):
                spans = name_span(tokens := list(tokens), gaps := list(gaps), [d for d, _ in given], own)
                if word and len(spans) == 1 and spans[0][1] - spans[0][0] == 1 and spans[0][1] == len(tokens):
                    continue
                offset, at = [], 0
                for token, gap in zip(tokens, gaps):
                    offset.append(at)
                    at += len(token) + len(gap)
                for i, j in spans:
                    a, b = offset[i], offset[j - 1] + len(_POSSESSIVE.sub("", tokens[j - 1]))
                    found.append((field, record, "person_name", surface[a:b], start + a, b - a))
            yield pd.DataFrame(found, columns=["field_name", "record_id", "kind", "surface", "start", "n_chars"])

    people = scored.mapInPandas(names, "field_name string, record_id string, kind string, surface string, start int, n_chars int")
    formed = scanned.where("kind not in ('sequence', 'total')").select("field_name", "record_id", "kind", "surface", "start", F.length("surface").alias("n_chars"))
    if everywhere := [(r["kind"], r["term"]) for r in rows if r["kind"] != "term"]:
        formed = formed.join(F.broadcast(fields.sparkSession.createDataFrame(everywhere, "kind string, surface string")), ["kind", "surface"], "left_anti")
    return formed.unionByName(people)


def sanitised(fields: DataFrame, allow_terms: DataFrame) -> DataFrame:
    """(field_name, record_id, n_items, clean_text) of every record: its personal items replaced by typed placeholders.

    The rest of the text is unchanged. The items of a record are collected per record, never per key of the data, and replaced
    inside the JVM. A record stored twice is replaced in both rows; of items of one id with several texts, those that don't
    stand in a text as found are left alone there.
    """
    items = personal_items(fields, allow_terms).groupBy("field_name", "record_id").agg(F.array_sort(F.collect_set(F.struct("start", "n_chars", "kind", "surface"))).alias("_items"))
    shown = F.create_map(*[F.lit(x) for kv in PLACEHOLDERS.items() for x in kv])
    items = items.withColumnsRenamed({"field_name": "_f", "record_id": "_r"})  # an id may be null
    joined = fields.join(items, (F.col("field_name") == F.col("_f")) & F.col("record_id").eqNullSafe(F.col("_r")), "left").withColumn("_shown", shown)
    held = F.expr("filter(_items, i -> substring(text, i.start + 1, i.n_chars) = i.surface)")
    done = F.expr(
        "aggregate(_held, struct('' AS out, 0 AS at), (acc, i) -> struct(concat(acc.out, substring(text, acc.at + 1, i.start - acc.at), element_at(_shown, i.kind)) AS out, i.start + i.n_chars AS at),"
        " acc -> concat(acc.out, substring(text, acc.at + 1)))"
    )
    rows = joined.withColumn("_held", F.coalesce(held, F.array().cast(items.schema["_items"].dataType)))
    clean = F.when(F.size("_held") == 0, F.col("text")).otherwise(done)
    return rows.select("field_name", "record_id", F.size("_held").alias("n_items"), clean.alias("clean_text"))
