"""What each sender of a thread newly wrote: quoted history, attributions, signatures, device lines and notices removed.

A thread is one record, ``## Message N`` blocks under their reference headers (From, Date). The thread is put in order by its
dates, whatever the order of the blocks, so a message's ancestors are those sent before it. Three passes over each message:

1. the words of the message are aligned with all ancestors: k-word shingles are looked up by rolling hash, each hit is
   extended word by word to a maximal span, and spans that follow each other in both texts are joined over a few changed
   words. Whole sentences of inherited spans are removed wherever they stand, marked or not;
2. attributions, forwarding rulers, header blocks and quote prefixes open quoted regions. A region that begins with inherited
   lines ends with them, so that what was written below an unprefixed quote, or into it, is new; a quote from outside the
   thread, which no ancestor holds, goes to the end;
3. from what is left, the closing phrase with the signature under it, device lines and notices are cut.

Threads are independent of each other, so the operator is one Arrow pass without a shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from threadloom.session import spread

SHINGLE_WORDS = 5
#: Changed words between two spans that follow each other in both texts.
CHANGED_WORDS = 3
#: Share of a line's words that spans hold from which the line is inherited.
INHERITED_SHARE = 0.8
#: Unmarked lines and spans count as pasted history from this many words on.
PASTED_WORDS = 14
#: A lone sentence inside other text counts from this many words on.
PASTED_SENTENCE_WORDS = 16
_BASE = np.uint64(0x9E3779B97F4A7C15)

# Closing phrases, alone on their line, in the four languages of the mail.
CLOSINGS = (
    "best", "best regards", "best wishes", "kind regards", "warm regards", "regards", "many thanks", "many thanks in advance", "thanks", "thanks again",
    "thanks in advance", "thank you", "thank you so much", "cheers", "all the best", "sincerely", "yours sincerely", "yours truly", "talk soon", "warmly",
    "respectfully", "take care", "atentamente", "saludos", "saludos cordiales", "un saludo", "un abrazo", "abrazos", "quedo atenta", "quedo atento",
    "muchas gracias", "gracias", "cordialmente", "cordialement", "bien cordialement", "bien à vous", "à bientôt", "merci d'avance", "merci", "amicalement",
    "atenciosamente", "obrigada", "obrigado", "um abraço", "abraços", "até logo", "até breve", "cumprimentos",
)
_CLOSING = "|".join(sorted((re.escape(c) for c in CLOSINGS), key=len, reverse=True)).replace("'", "['’]")

_WHO = r"[^\n<>(:]{1,80}?(?:\s*[<(][^>)\n]{0,120}[>)])?"
# Forms of attribution lines of mail clients.
_ATTRIBUTION = "|".join(
    [
        rf"On (?:[A-Z][a-z]{{2}},? )?(?:[A-Z][a-z]{{2,8}} \d{{1,2}},? \d{{4}}|\d{{1,2}}/\d{{1,2}}/\d{{2,4}}|\d{{1,2}} [A-Z][a-z]{{2,8}} \d{{4}}),? (?:at )?\d{{1,2}}:\d{{2}}(?: ?[AP]M)?,? {_WHO}\s*wrote:",
        rf"[^\n<>:.!?]{{1,60}} <[^>\n]{{0,80}}> wrote on \d{{1,2}} [A-Z][a-z]+ \d{{4}}:",
        r"\d{4}-\d{2}-\d{2} \d{1,2}:\d{2} (?:GMT|UTC)[+-]\d{2}:?\d{2} [^\n<>]{1,60}<[^>\n]{0,80}>:",
        rf"El (?:[a-záé]{{3,9}},? )?\d{{1,2}} (?:de )?[a-z]{{3,10}}\.? (?:de )?\d{{4}},? a las? \d{{1,2}}:\d{{2}},? {_WHO}\s*escribi[óo]:",
        rf"Em (?:[a-zç-]{{3,14}},? )?\d{{1,2}} (?:de )?[a-zç]{{3,10}}\.? (?:de )?\d{{4}},?(?: às?)? \d{{1,2}}:\d{{2}},? {_WHO}\s*escreveu:",
        rf"Le (?:[a-z]{{3,9}}\.?,? )?\d{{1,2}} [a-zéû]{{3,10}}\.? \d{{4}} à \d{{1,2}}[:h]\d{{2}},? {_WHO}\s*a écrit\s?:",
    ]
)
_RULER = r"-{3,} ?(?:Original Message|Forwarded message|Mensaje original|Mensaje reenviado|Mensagem original|Mensagem encaminhada|Message d['’]origine|Message original|Message transféré|Begin forwarded message) ?-{3,}|_{20,}"
_FIELD = r"\*?(?:From|Sent|Date|To|Cc|Subject|De|Enviado|Enviada|Fecha|Para|Asunto|Assunto|Data|Envoyé|À|Objet)\s?:\*? ?"
_FIELDS = r"(?:Sent|Date|To|Subject|Enviado|Enviada|Fecha|Para|Asunto|Assunto|Data|Envoyé|À|Objet|Cc)"
#: a sender with an address and one more field, or a bare sender and a dated field: one such line alone is ordinary text
_HEADER = rf"\*?(?:From|De)\s?:\*? (?:[^\n]{{0,120}}[<@{{{{][^\n]{{0,120}}\n[ \t]*\*?{_FIELDS}\s?:\*? [^\n]*|[^\n.,]{{1,60}}\n[ \t]*\*?{_FIELDS}\s?:\*? [^\n]*\d[^\n]*)"
_FLAT_HEADER = r"\*?(?:From|De)\s?:\*? [^\n<]{1,60}<[^>\n]{0,80}>\s+\*?(?:Sent|Date|To|Subject|Enviado|Enviada|Fecha|Para|Asunto|Assunto|Data|Envoyé|À|Objet)\s?:"
_DEVICE = r"(?:Sent (?:from (?:my|the) [\w ]{2,30}?|while [a-z]+)(?:, please excuse [a-z ]{3,24}?)?|Get (?:the|Outlook)[\w ]{0,24} for (?:Android|iOS|iPhone)|Enviad[oa] (?:desde mi|do meu|da minha|desde el) [\wáéíóú]+|Envoyé (?:de|depuis) mon [\wáéíóú]+)"
_NOTICE = (
    r"(?:CONFIDENTIAL(?:ITY)?(?: NOTICE)?\s?:|NOTICE TO RECIPIENTS?\b|AVISO(?: LEGAL| DE CONFIDENCIALIDAD)?\s?:|AVIS\s?:|DISCLAIMER\s?:"
    r"|This (?:message|e-?mail)(?: and any \w+(?: with it)?)? (?:is|are) (?:meant|intended|confidential)"
    r"|Please (?:think about|consider) the (?:trees|environment) before"
    r"|Este (?:mensaje|correo) es (?:solo|únicamente|exclusivamente|confidencial)|Ce (?:message|courriel) est (?:réservé|confidentiel|destiné)"
    r"|Esta mensagem é (?:destinada|confidencial|exclusiva))"
)
_OPENER = re.compile(rf"(?m)^[ \t]*(?:(?P<attr>{_ATTRIBUTION})|(?P<ruler>{_RULER})|(?P<head>{_HEADER}))[ \t]*$")
_FLAT_OPENER = re.compile(rf"(?:(?<![\w])|(?<=[a-záéíóú]))(?:{_ATTRIBUTION}|{_RULER}|{_FLAT_HEADER})")
_PREFIX = re.compile(r"^[ \t]*[>|]")
_SENTENCE_END = re.compile(r"[.!?…:][)\]\"'”’»]*$")
_WORD = re.compile(r"\S+")
_STRIP = re.compile(r"^[ \t]*(?:[>|]+ ?)+")
_FIELD_LINE = re.compile(rf"^[ \t]*{_FIELD}")
_CLOSING_LINE = re.compile(rf"^\s*(?:(?:{_CLOSING})\s?[,.!]?|--|[—–])\s*$", re.I)
_DASH_NAME = re.compile(r"^\s*(?:[—–]|--?)\s*(?:\{name\}|[A-ZÁÉÍÓÚÑÇ][\w'’.-]*(?:,? [A-ZÁÉÍÓÚÑÇ][\w'’.-]*){0,3})\s*$")
_DEVICE_LINE = re.compile(rf"^\s*{_DEVICE}\s*[.!]?\s*$")
_NOTICE_LINE = re.compile(rf"^\s*{_NOTICE}", re.I)
_NAME_AHEAD = r"(?:\{name\}|[A-ZÁÉÍÓÚÑÇ][\w'’-]*\.?(?=[ ,]|$))"
_FLAT_CLOSING = re.compile(rf"(?:(?<=[.!?:)\]}}…\"”]) |  |^ *) *(?:(?i:{_CLOSING}),\s+{_NAME_AHEAD}|--\s+{_NAME_AHEAD}|[—–]\s+{_NAME_AHEAD})")
_FLAT_DEVICE = re.compile(rf"(?<![\w]){_DEVICE}|(?<=[\w}}]){_DEVICE}")
_FLAT_NOTICE = re.compile(rf"(?:(?<=[.!?}}])|^)\s*{_NOTICE}", re.I)
_BLOCK = re.compile(r"(?m)^## Message (\d+)[ \t]*\n(?=\*\*(?:From|Date):\*\*|\n|\Z)")
_HEAD_LINE = re.compile(r"\*\*(From|Date|To|Subject|Cc):\*\*([^\n]*)(?:\n|\Z)")
_REMARK = re.compile(r"\s*_\([^\n]*\)_\s*")


class Message(NamedTuple):
    number: int
    sender: str
    sent: str
    body: str


def split_thread(text: str) -> list[Message]:
    """The ``## Message N`` blocks of a thread. Line ends may be CRLF; text before the first block belongs to no message."""
    text = text.replace("\r\n", "\n")
    at = list(_BLOCK.finditer(text))
    out = []
    for i, m in enumerate(at):
        rest = text[m.end() : at[i + 1].start() if i + 1 < len(at) else len(text)]
        heads = {"From": "", "Date": ""}
        while h := _HEAD_LINE.match(rest):
            heads[h[1]] = h[2].strip()
            rest = rest[h.end() :]
        out.append(Message(int(m[1][:9]), heads["From"], heads["Date"], rest))
    return out


def _instant(sent: str) -> datetime | None:
    try:
        at = parsedate_to_datetime(sent)
    except (TypeError, ValueError, IndexError, OverflowError):
        return None
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc)


def in_order(messages: list[Message]) -> list[int]:
    """Indexes of the messages as they were sent: by their dates, where all of them can be read, else as the blocks stand."""
    if len(messages) < 2 or None in (sent := [_instant(m.sent) for m in messages]):
        return list(range(len(messages)))
    return sorted(range(len(messages)), key=lambda i: (sent[i], i))


def _marked(n: int, spans: list[tuple[int, ...]]) -> list[bool]:
    held = [False] * n
    for a, b, *_ in spans:
        held[a:b] = [True] * (b - a)
    return held


def _pasted(words: list[str], line_starts: set[int], spans: list[tuple[int, int, int]]) -> list[bool]:
    """Which words are pasted history: the whole sentences of each inherited span, where they have ``PASTED_WORDS`` together.

    People use the same turns again, so words at the ends of a span that make up a part of a sentence only are no history,
    nor is a lone sentence of less than ``PASTED_SENTENCE_WORDS``.
    """
    begins = lambda i: i in (0, len(words)) or i in line_starts or _SENTENCE_END.search(words[i - 1])
    out = []
    for a, b, _ in spans:
        if b - a >= PASTED_WORDS:
            a = next((i for i in range(a, b) if begins(i)), b)
            b = next((i for i in range(b, a, -1) if begins(i)), a)
            several = any(_SENTENCE_END.search(words[i - 1]) for i in range(a + 1, b))
            if b - a >= (PASTED_WORDS if several else PASTED_SENTENCE_WORDS):
                out.append((a, b))
    return _marked(len(words), out)


def rolling_hashes(words: list[str], k: int = SHINGLE_WORDS) -> list[int]:
    """The polynomial hash (modulo 2 ** 64) of each run of k words, all windows at once."""
    n = len(words) - k + 1
    if n < 1:
        return []
    codes = np.array([hash(w) for w in words], dtype=np.int64).view(np.uint64)
    h = codes[:n].copy()
    for j in range(1, k):
        h *= _BASE
        h += codes[j : n + j]
    return h.tolist()


class Ancestors:
    """Words of all earlier messages, with their k-word shingles by rolling hash."""

    def __init__(self, k: int = SHINGLE_WORDS) -> None:
        self.k, self.words, self.at = k, [], {}

    def add(self, words: list[str], hashes: list[int]) -> None:
        base, at = len(self.words), self.at
        self.words += [*words, "\0"]
        for i, h in enumerate(hashes, base):
            if h in at:
                at[h].append(i)
            else:
                at[h] = [i]

    def spans(self, words: list[str], hashes: list[int]) -> list[tuple[int, int, int]]:
        """(start, end, start in the ancestors) of the spans that occur in an ancestor: each shingle hit is extended as far as
        any ancestor goes on.

        Extending to the left matters only where the span before ends inside this one, as a span's first shingle is a hit too. An ancestor that stops before the reach
        of an earlier one is dismissed by a single word, so repetitive text stays linear.
        """
        out, n, reached = [], len(words), 0
        if not self.words:
            return out
        for i in range(n - self.k + 1):
            if i + self.k <= reached or hashes[i] not in self.at:
                continue
            reach, best = i, 0
            for j in self.at[hashes[i]]:
                if reach == i:
                    if self.words[j : j + self.k] != words[i : i + self.k]:
                        continue
                    reach = i + self.k
                elif not (reach < n and j + reach - i < len(self.words) and self.words[j + reach - i] == words[reach] and self.words[j : j + reach - i] == words[i:reach]):
                    continue
                best = j
                while reach < n and j + reach - i < len(self.words) and self.words[j + reach - i] == words[reach]:
                    reach += 1
            if reach > i:
                reached = max(reached, reach)
                start = i
                while start and best and self.words[best - 1] == words[start - 1]:
                    start, best = start - 1, best - 1
                out.append((start, reach, best))
        return out

    def aligned(self, words: list[str], found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """The spans with what goes on around them behind up to ``CHANGED_WORDS`` changed words: a span that follows in order in
        both texts, or two or more equal words."""
        out: list[tuple[int, int, int]] = []
        for a, b, j in found:
            end, there = b, j + b - a
            while step := self._beyond(words, end, there, 1):
                end, there = end + step, there + step
            while step := self._beyond(words, a - 1, j - 1, -1):
                a, j = a - step, j - step
            if out:
                start, before, at = out[-1]
                here, gap = a - before, j - (at + before - start)
                if here <= CHANGED_WORDS and 0 <= gap <= CHANGED_WORDS and "\0" not in self.words[j - gap : j]:
                    end = max(end, before)
                    out[-1] = (start, end, there - (end - start))
                    continue
            out.append((a, end, j))
        return out

    def _beyond(self, words: list[str], i: int, j: int, way: int) -> int:
        """Words from i on, going one way, up to two equal words behind changed ones; 0 where there are none."""
        same = lambda n: 0 <= i + way * n < len(words) and 0 <= j + way * n < len(self.words) and words[i + way * n] == self.words[j + way * n]
        for n in range(CHANGED_WORDS + 1):
            if same(n) and same(n + 1):
                return n + 2
            if not 0 <= j + way * n < len(self.words) or self.words[j + way * n] == "\0":
                return 0
        return 0


def _without(line: str, held: list[bool]) -> str:
    """A line without its held words; held tells of each word behind the quote marks."""
    begin = m.end() if (m := _STRIP.match(line)) else 0
    out, at, before = [], 0, False
    for w, h in zip(_WORD.finditer(line, begin), held):
        if h and not before:
            out.append(line[at : w.start()])
        if h:
            at = w.end()
        before = h
    return "".join(out) + line[at:]


def _cut_flat(line: str, spans: list[tuple[int, int, int]]) -> str:
    """A body collapsed into one line, without pasted history: cut at the earliest closing phrase with a name, device line, quote
    opener or notice. Inside pasted history those belong to an ancestor and cut nothing."""
    held, pasted = [], []
    if spans:
        words = list(_WORD.finditer(line))
        held = _pasted([w[0] for w in words], set(), spans)
        pasted = [w.span() for w, h in zip(words, held) if h]
    inside = lambda m: (k := bisect_right(pasted, (m.end() - len(m[0].lstrip()), len(line)))) and m.end() - len(m[0].lstrip()) < pasted[k - 1][1]
    ends = [m.start() for p in (_FLAT_OPENER, _FLAT_CLOSING, _FLAT_DEVICE, _FLAT_NOTICE) if (m := next((m for m in p.finditer(line) if not inside(m)), None))]
    return _without(line[: min(ends)] if ends else line, held)


def _plain(line: str) -> str:
    """A line as it looks, for matching only: full-width forms folded, invisible characters gone."""
    return line if line.isascii() else re.sub("[\u200b-\u200f\u2060\ufeff\u00ad]", "", unicodedata.normalize("NFKC", line))


def _cut_tail(lines: list[str]) -> list[str]:
    """Lines of a stretch of own text without device lines, notices, and the closing phrase with the signature under it."""
    for i, line in enumerate(lines):
        if _NOTICE_LINE.match(_plain(line)):
            lines = lines[:i]
            break
    lines = [x for x in lines if not _DEVICE_LINE.match(_plain(x))]
    for i, line in enumerate(map(_plain, lines)):
        if _CLOSING_LINE.match(line) or _DASH_NAME.match(line):
            below = [x for x in lines[i + 1 :] if x.strip()]
            if len(below) <= 8 and all(len(x) <= 80 for x in below):
                return lines[:i]
    return lines


def line_words(lines: list[str]) -> list[list[str]]:
    """The words of each line behind its quote marks."""
    return [(_STRIP.sub("", x) if x[:1] in " \t>|" else x).split() for x in lines]


def new_text(body: str, ancestors: Ancestors, by_line: list[list[str]] | None = None, hashes: list[int] | None = None) -> str:
    """The newly written part of one message body, lines kept as they are. by_line and hashes: words and shingles of the body's
    lines, where they are known already."""
    every = body.split("\n")
    first = next((i for i, x in enumerate(every) if x), len(every))
    lines = body.strip("\n").split("\n")
    by_line = (line_words(every) if by_line is None else by_line)[first : first + len(lines)]
    for i, line in enumerate(lines):  # a notice that ends the body
        if i and _NOTICE_LINE.match(line) and not any(x.strip() for x in lines[i + 1 :]):
            lines = lines[:i]
            break
    body = "\n".join(lines).strip()
    if not body or ("\n" not in body and _PREFIX.match(body)):
        return ""
    while lines and not lines[0].strip():
        del lines[0], by_line[0]
    while lines and not lines[-1].strip():
        del lines[-1]
    by_line = by_line[: len(lines)]
    words, spans = [w for ws in by_line for w in ws], []
    if ancestors.words:
        spans = ancestors.spans(words, rolling_hashes(words) if hashes is None else hashes)
    if "\n" not in body:
        return _cut_flat(body, spans)
    lines = body.split("\n")
    quoted = [bool(_PREFIX.match(x)) for x in lines]
    dropped = list(quoted)
    n_words, n_held, in_paste = [len(ws) for ws in by_line], [0] * len(lines), {}
    inherited = [False] * len(lines)
    if spans:
        starts, at = [], 0
        for n in n_words:
            starts.append(at)
            at += n
        held, pasted, near = _marked(len(words), spans), _pasted(words, set(starts[1:]), spans), _marked(len(words), ancestors.aligned(words, spans))
        for i, (a, n) in enumerate(zip(starts, n_words)):
            n_held[i] = sum(held[a : a + n])
            inherited[i] = n > 0 and sum(near[a : a + n]) >= INHERITED_SHARE * n
            if any(pasted[a : a + n]):
                in_paste[i] = pasted[a : a + n]
    openers = list(_OPENER.finditer(body))
    if openers:
        begins, at = [], 0
        for line in lines:
            begins.append(at)
            at += len(line) + 1
    for m in openers:
        first, last = bisect_right(begins, m.start()) - 1, bisect_right(begins, max(m.start(), m.end() - 1)) - 1
        if quoted[first]:
            continue
        dropped[first : last + 1] = [True] * (last + 1 - first)
        rest = last + 1
        while rest < len(lines) and (_FIELD_LINE.match(lines[rest]) and m["attr"] is None):
            dropped[rest] = True
            rest += 1
        after = [i for i in range(rest, len(lines)) if n_words[i]]
        if not after or quoted[after[0]]:
            continue
        if not inherited[after[0]]:  # a quote from outside the thread
            dropped[rest:] = [True] * (len(lines) - rest)
            continue
        end = next((i for i in after if not inherited[i] and n_words[i] > 2), len(lines))
        dropped[rest:end] = [True] * (end - rest)
        for i in range(end, len(lines)):
            dropped[i] = dropped[i] or inherited[i]
    for i in range(len(lines)):
        if not dropped[i] and n_words[i] >= PASTED_WORDS and n_held[i] == n_words[i]:
            dropped[i] = True
    # pasted history over shorter lines, or in a part of one: whole lines go at once, parts when closings and notices were looked for
    whole = {i for i, p in in_paste.items() if all(p)}
    rest_of = {id(lines[i]): _without(lines[i], p) for i, p in in_paste.items() if i not in whole}
    own, out = [], []
    for i in range(len(lines) + 1):
        if i < len(lines) and not dropped[i]:
            own += [] if i in whole else [lines[i]]
        elif own:
            out += [rest_of.get(id(x), x) for x in _cut_tail(own)]
            own = []
    return "\n".join(out)


def thread_new_texts(text: str) -> list[tuple[int, str, int, bool]]:
    """(message_no, new text, its number of words, whether anything else was there) of each message of a thread, as the blocks stand."""
    messages, ancestors = split_thread(text), Ancestors()
    out: list[tuple[int, str, int, bool]] = [(0, "", 0, False)] * len(messages)
    order = in_order(messages)
    for k, i in enumerate(order):
        m = messages[i]
        if _REMARK.fullmatch(m.body):
            out[i] = (m.number, "", 0, False)
            continue
        by_line, hashes, words = line_words(m.body.split("\n")), None, None
        if len(order) > 1:
            words = [w for ws in by_line for w in ws]
            hashes = rolling_hashes(words)
        new = new_text(m.body, ancestors, by_line, hashes)
        n = len(new.split())
        out[i] = (m.number, new, n, n < len(m.body.split()))
        if k + 1 < len(order):
            ancestors.add(words, hashes)
    return out


def message_new_texts(inquiries: DataFrame) -> DataFrame:
    """(inquiry_id, message_no, new_text, n_words, has_other) for each message of thread_text_redacted.

    Null and empty threads and text without ``## Message`` blocks give no rows. A body that is only a ``_(...)_`` remark has
    no new text and nothing else. Threads stored twice give rows for each stored record. A message whose text is all
    inherited has n_words 0.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, *r) for i, t in zip(batch["inquiry_id"], batch["thread_text_redacted"]) if t for r in thread_new_texts(t)]
            yield pd.DataFrame(rows, columns=["inquiry_id", "message_no", "new_text", "n_words", "has_other"])

    narrow = spread(inquiries.select("inquiry_id", "thread_text_redacted"), "inquiry_id")
    return narrow.mapInPandas(run, "inquiry_id string, message_no int, new_text string, n_words int, has_other boolean")
