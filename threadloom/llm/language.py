"""Language of messages and threads: family first, then one-versus-one linear support vector machines within the family.

A text is cut into sentences, and each is placed by hierarchical discrimination: one linear machine tells the Germanic from
the Romance family, and inside the Romance family one machine for each pair of languages votes. Features are hashed words
and character n-grams of words, so a word's scores are computed once and looked up from then on. The machines are fitted
here, on the driver, on a bounded sample of labelled documents (``SAMPLE_PER_LANGUAGE``) and of the sentences of their whole
texts (``SENTENCES_PER_LANGUAGE``), after which sentences whose label the first fit contradicts are dropped and the fit is
repeated: labels may be wrong and texts may mix languages. Everything else - every thread, message and sentence - is
classified without a sample.

Margins become confidences by a logistic curve fitted on a fifth of the sample's documents, which no machine was fitted on,
and on the margin that is reported: the smaller of the family's and the closest pair's.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.newtext import thread_new_texts
from threadloom.session import spread

FAMILIES = {"germanic": ("en",), "romance": ("es", "fr", "pt")}
LANGUAGES = tuple(x for xs in FAMILIES.values() for x in xs)
#: Documents of each language that the machines are fitted on at most, and sentences of them, drawn from whole texts.
SAMPLE_PER_LANGUAGE, SENTENCES_PER_LANGUAGE = 300, 3000
MIXED_SHARE = 0.2
DIMENSIONS = 1 << 16
#: Sentences of fewer words, or short ones placed with less confidence, take the language of the text around them.
SURE_WORDS, SHORT_WORDS, SURE_CONFIDENCE = 3, 10, 0.65
_WORD = re.compile(r"[^\W\d_]+")
#: Placeholders, addresses (also spelled out) and capitalised words inside a sentence, which are names in any language.
_NOISE = re.compile(r"\{\w+\}|(?<!\S)[^\s@]+ ?(?:@|[(\[]at[)\]]) ?\S+(?: ?[(\[]dot[)\]] ?\w+)*|https?://\S+|(?<=[^\W\d_,;] )[^\W\d_a-zà-ÿ][\w'’-]*")
_SENTENCE = re.compile(r"(?:[^.!?:\n]|[.!?:](?=\S))+[.!?:\n]*\s*")

# A few everyday sentences of each language, so that every machine has something to start from.
SEEDS = {
    "en": ["We would like to book a table for the party.", "Could you tell me whether there is parking near the hall?", "Thank you for your message, we look forward to it.", "The guests will arrive at about six and leave before midnight.", "Please let us know what you need for this and that.", "I have not heard from them since the last time we were there.", "My brother has asked for the smaller room because the other one is taken.", "She needs more of these for her friends and would have them before lunch.", "What is the price when there are more than fifty of us?", "They were here last year and it was very good.", "He wants to know how long the food can stay on the table after dinner.", "Which of the two houses did you choose, and why not this one?", "Our manager does not think that we should pay upstairs.", "If it rains, we will come inside with all of our chairs."],
    "es": ["Nos gustaría reservar una mesa para la fiesta.", "¿Me puede decir si hay estacionamiento cerca del salón?", "Muchas gracias por su mensaje, quedamos a la espera.", "Los invitados llegan a las seis y se van antes de medianoche.", "Por favor díganos qué necesitan para esto y aquello.", "No he sabido nada de ellos desde la última vez que estuvimos allí.", "Mi hermano ha pedido la sala más chica porque la otra está ocupada.", "Ella necesita más de estos para sus amigas y los quisiera antes del almuerzo.", "¿Cuánto cuesta cuando somos más de cincuenta?", "Estuvieron aquí el año pasado y todo fue muy bueno.", "Quiere saber cuánto tiempo puede quedar la comida en la mesa después de la cena.", "¿Cuál de las dos casas han elegido, y por qué no esta?", "Nuestra directora no cree que debamos pagar arriba.", "Si llueve, entramos con todas nuestras sillas."],
    "fr": ["Nous voudrions réserver une table pour la fête.", "Pouvez-vous me dire s'il y a un parking près de la salle ?", "Merci beaucoup pour votre message, nous restons à votre disposition.", "Les invités arrivent vers six heures et partent avant minuit.", "Dites-nous s'il vous plaît ce qu'il vous faut pour cela.", "Je n'ai pas eu de leurs nouvelles depuis la dernière fois que nous y étions.", "Mon frère a demandé la petite salle parce que l'autre est prise.", "Elle a besoin de plus de ceux-ci pour ses amies et les voudrait avant le déjeuner.", "Quel est le prix quand nous sommes plus de cinquante ?", "Ils étaient ici l'année dernière et c'était très bon.", "Il veut savoir combien de temps le repas peut rester sur la table après le dîner.", "Laquelle des deux maisons avez-vous choisie, et pourquoi pas celle-ci ?", "Notre directeur ne pense pas que nous devions payer à l'étage.", "S'il pleut, nous entrerons avec toutes nos chaises."],
    "pt": ["Gostaríamos de reservar uma mesa para a festa.", "Pode me dizer se há estacionamento perto do salão?", "Muito obrigado pela sua mensagem, ficamos à espera.", "Os convidados chegam às seis e vão embora antes da meia-noite.", "Por favor, digam o que precisam para isto e aquilo.", "Não tenho notícias deles desde a última vez que estivemos lá.", "Meu irmão pediu a sala menor porque a outra está ocupada.", "Ela precisa de mais destes para as suas amigas e gostaria de tê-los antes do almoço.", "Quanto custa quando somos mais de cinquenta?", "Eles estiveram aqui no ano passado e foi muito bom.", "Ele quer saber quanto tempo a comida pode ficar na mesa depois do jantar.", "Qual das duas casas vocês escolheram, e por que não esta?", "A nossa gerente não acha que devemos pagar lá em cima.", "Se chover, entramos com todas as nossas cadeiras."],
}


def word_features(word: str) -> list[int]:
    """Hashed features of a lower-cased word: itself and its character n-grams with its ends."""
    marked = f"<{word}>"
    grams = [marked] + [marked[i : i + n] for n in (1, 2, 3, 4) for i in range(len(marked) - n + 1)]
    return [xxhash.xxh32_intdigest(g) % DIMENSIONS for g in grams]


def sentences(text: str) -> list[tuple[int, list[str]]]:
    """(number of words between white space, lower-cased letter words) of each sentence."""
    out = []
    for m in _SENTENCE.finditer(text):
        n = len(m[0].split())
        if n:
            out.append((n, _WORD.findall(_NOISE.sub(" ", m[0]).lower())))
    return out


def packed(words: list[str], seen: dict[str, list[int]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(features, values of length 1 together) of a sentence; seen keeps the features of words."""
    seen = {} if seen is None else seen
    idx, n = np.unique([f for w in words for f in (seen.get(w) or seen.setdefault(w, word_features(w)))], return_counts=True)
    return idx, n / np.sqrt((n * n).sum())


def fit_linear(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, cost: float = 0.5, epochs: int = 6, seed: int = 7) -> np.ndarray:
    """Weights of a linear support vector machine without bias, by dual coordinate ascent; both classes weigh the same."""
    weights, alpha, order = np.zeros(DIMENSIONS), np.zeros(len(rows)), np.random.default_rng(seed)
    bound = np.where(signs > 0, cost * len(rows) / max(2 * (signs > 0).sum(), 1), cost * len(rows) / max(2 * (signs < 0).sum(), 1))
    alpha, bound, signs = alpha.tolist(), bound.tolist(), signs.tolist()
    for _ in range(epochs):
        for i in order.permutation(len(rows)).tolist():
            idx, x = rows[i]
            now = min(max(alpha[i] + 1 - signs[i] * float(weights[idx].dot(x)), 0.0), bound[i])
            if now != alpha[i]:
                weights[idx] += (now - alpha[i]) * signs[i] * x
                alpha[i] = now
    return weights


class Discriminator:
    """Family machine and one-versus-one machines, with the scores of words seen so far."""

    def __init__(self, weights: np.ndarray, pairs: list[tuple[str, str]], slope: float) -> None:
        self.weights, self.pairs, self.slope, self.words = weights, pairs, slope, {}

    def scores(self, words: list[str]) -> np.ndarray:
        """Score of each machine: family (positive: Romance), then each pair (positive: its first language)."""
        total, n = np.zeros(self.weights.shape[0]), 0
        for w in words:
            s = self.words.get(w)
            if s is None:
                if len(self.words) > 200_000:
                    self.words.clear()
                idx = word_features(w)
                s = self.words[w] = (self.weights[:, idx].sum(axis=1), len(idx))
            total = total + s[0]
            n += s[1]
        return total / np.sqrt(max(n, 1))

    def place(self, words: list[str]) -> tuple[str, float]:
        """(language, confidence) of a sentence. A sentence without letters is English with confidence 0.5."""
        lang, margin = self.margin(words)
        return lang, self._sure(margin)

    def margin(self, words: list[str]) -> tuple[str, float]:
        """(language, margin): the smaller of the family's margin and, within a family, the winner's closest pair."""
        s = self.scores(words)
        if s[0] <= 0:
            return FAMILIES["germanic"][0], -s[0]
        votes: dict[str, float] = defaultdict(float)
        for (a, b), x in zip(self.pairs, s[1:]):
            votes[a if x > 0 else b] += 1 + min(abs(x), 0.49)
        best = max(votes, key=votes.get)
        return best, min(s[0], *(abs(x) for pair, x in zip(self.pairs, s[1:]) if best in pair))

    def _sure(self, margin: float) -> float:
        return float(1.0 / (1.0 + np.exp(-self.slope * margin)))


def fit_discriminator(labelled: list[tuple[str, str]], sentences_per_language: int = SENTENCES_PER_LANGUAGE, seed: int = 11) -> Discriminator:
    """Fit on (language, text) pairs; labels may be noisy. The seed sentences are always part of it.

    Every fifth text is held out for the confidences. Of the sentences of the others, at most ``sentences_per_language`` of
    each language are drawn.
    """
    pairs = list(combinations(FAMILIES["romance"], 2))
    words_of = lambda texts: [(lang, words) for lang, text in texts for _, words in sentences(text) if len(words) >= SURE_WORDS]
    seeds = words_of((k, x) for k, v in SEEDS.items() for x in v)
    each: dict[str, list[tuple[str, str]]] = defaultdict(list)
    for lang, text in labelled:
        each[lang].append((lang, text))
    rng, data, held = np.random.default_rng(seed), list(seeds), []
    for lang in sorted(each):
        held += words_of(each[lang][4::5])
        own = words_of(t for i, t in enumerate(each[lang]) if i % 5 != 4)
        data += [own[i] for i in sorted(rng.permutation(len(own))[:sentences_per_language])]
    family = {x: f for f, xs in FAMILIES.items() for x in xs}

    seen: dict[str, list[int]] = {}
    rows_of = [packed(words, seen) for _, words in data]

    def fit(part: list[int]) -> np.ndarray:
        rows, langs = [rows_of[i] for i in part], [data[i][0] for i in part]
        machines = [fit_linear(rows, np.array([1 if family[x] == "romance" else -1 for x in langs]))]
        for a, b in pairs:
            pick = [i for i, x in enumerate(langs) if x in (a, b)]
            machines.append(fit_linear([rows[i] for i in pick], np.array([1 if langs[i] == a else -1 for i in pick])))
        return np.stack(machines)

    first = Discriminator(fit(list(range(len(data)))), pairs, 1.0)
    model = Discriminator(fit([i for i, (lang, words) in enumerate(data) if first.place(words)[0] == lang]), pairs, 1.0)
    # slope of the logistic curve: one Newton-fitted parameter on the margins of sentences that no machine saw
    placed = [(min(margin, 4.0), found == lang) for lang, words in held or seeds for found, margin in [model.margin(words)]]
    margin, right = np.array([x for x, _ in placed]), np.array([x for _, x in placed], dtype=float)
    slope = 1.0
    for _ in range(25):
        p = 1 / (1 + np.exp(-slope * margin))
        step = ((right - p) * margin).sum() / max((p * (1 - p) * margin**2).sum(), 1e-9)
        slope = float(np.clip(slope + step, 0.1, 12.0))
    model.slope = slope
    return model


def labelled_sample(documents: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> list[tuple[str, str]]:
    """Bounded sample of labelled documents for fitting: of each language the documents with the smallest id hash, whole.

    A scan of ids and labels alone counts the languages; then one scan of the texts keeps about four times the sample by
    hash before anything is compared, so that what is shuffled doesn't grow with the corpus.
    """
    labelled = documents.where(F.lower("lang").isin(*LANGUAGES) & F.col("text").isNotNull())
    at = labelled.select(F.lower("lang").alias("_lang"), "doc_id", F.xxhash64("doc_id").alias("_h"), "text")
    counts = {r[0]: r[1] for r in documents.select(F.lower("lang").alias("_lang")).where(F.col("_lang").isin(*LANGUAGES)).groupBy("_lang").count().collect()}
    bound = {lang: int((8 * per_language / n - 1) * 2**62) - 2**62 for lang, n in counts.items() if n > 8 * per_language}  # smallest hashes
    if not counts:
        return []
    few = at.where(F.coalesce(*[F.when(F.col("_lang") == lang, F.col("_h") < b) for lang, b in bound.items()], F.lit(True)))
    one = few.groupBy("_lang", "_h", "doc_id").agg(F.min("text").alias("text"))  # an id stored many times is one document
    ranked = one.withColumn("_n", F.row_number().over(Window.partitionBy("_lang").orderBy("_h", "doc_id"))).where(F.col("_n") <= per_language)
    return [(r[0], r[1]) for r in ranked.orderBy("_lang", "_n").select("_lang", "text").collect()]


def word_shares(text: str, model: Discriminator) -> tuple[dict[str, int], float]:
    """Words of each language in a text, and the mean confidence of its sentences weighted by words."""
    words: dict[str, int] = defaultdict(int)
    sure, total, loose = 0.0, 0, 0
    for n, letters in sentences(text):
        if len(letters) < SURE_WORDS:
            loose += n
            continue
        lang, confidence = model.place(letters)
        if confidence < SURE_CONFIDENCE and len(letters) < SHORT_WORDS:
            loose += n
            continue
        words[lang] += n
        sure += n * confidence
        total += n
    if total:
        words[max(words, key=lambda k: (words[k], k))] += loose
        return dict(words), sure / total
    letters = [w for _, ws in sentences(text) for w in ws]
    if letters:
        lang, confidence = model.place(letters)
        return {lang: loose}, confidence
    return {}, 0.0


def name_language(words: dict[str, int], mixed_share: float = MIXED_SHARE) -> str | None:
    """The language with most words, ``mixed`` if a second one has at least ``mixed_share`` of them, None without words."""
    ranked = sorted(words.items(), key=lambda kv: (-kv[1], kv[0]))
    if not ranked:
        return None
    if len(ranked) > 1 and ranked[1][1] >= mixed_share * sum(words.values()):
        return "mixed"
    return ranked[0][0]


def thread_languages(inquiries: DataFrame, model: Discriminator) -> DataFrame:
    """(inquiry_id, message_no, lang, confidence, n_words, thread_lang): messages by number, the thread as message 0.

    Only newly written text counts. Null and empty threads give no rows; messages and threads without a word have a null
    language. The model (a few MB) is broadcast.
    """
    shared = inquiries.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.pairs, model.slope))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Discriminator(*shared.value)
        for batch in batches:
            rows = []
            for inquiry, text in zip(batch["inquiry_id"], batch["thread_text_redacted"]):
                if not text:
                    continue
                whole: dict[str, int] = defaultdict(int)
                messages, sure, total = [], 0.0, 0
                for number, new, n, _ in thread_new_texts(text):
                    words, confidence = word_shares(new, own)
                    messages.append((number, name_language(words), confidence, n))
                    for k, v in words.items():
                        whole[k] += v
                    sure += confidence * n
                    total += n
                lang = name_language(whole)
                rows += [(inquiry, k, x, c, n, lang) for k, x, c, n in [(0, lang, sure / max(total, 1), total), *messages]]
            yield pd.DataFrame(rows, columns=["inquiry_id", "message_no", "lang", "confidence", "n_words", "thread_lang"])

    schema = "inquiry_id string, message_no int, lang string, confidence double, n_words int, thread_lang string"
    return spread(inquiries.select("inquiry_id", "thread_text_redacted"), "inquiry_id").mapInPandas(run, schema)


def language_findings(inquiries: DataFrame, labels: DataFrame, documents: DataFrame) -> DataFrame:
    """(inquiry_id, message_no, lang, confidence, label) where labels don't give the thread's language, and all of mixed threads.

    Message 0 is the thread: there if its latest label (largest labeled_at, then label_id) has another language or none, or
    it has no label. The messages of mixed threads follow whatever the label.
    """
    found = thread_languages(inquiries, fit_discriminator(labelled_sample(documents))).where("lang is not null")
    latest = labels.groupBy("inquiry_id").agg(F.max(F.struct("labeled_at", "label_id", "language")).alias("_l"))
    label = F.lower(F.trim("_l.language"))
    joined = found.join(latest, "inquiry_id", "left").withColumn("label", label)
    wrong = (F.col("message_no") == 0) & ~F.col("lang").eqNullSafe(F.col("label"))
    mixed = (F.col("message_no") > 0) & (F.col("thread_lang") == "mixed")
    return joined.where(wrong | mixed).select("inquiry_id", "message_no", "lang", "confidence", "label")
