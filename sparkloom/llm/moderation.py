"""Problem 10: scores for abusive, hateful or sexually explicit passages, per document and per source.

A linear classifier on character n-grams (across words, of lengths ``GRAMS``) whose features are scaled by naive Bayes
log-count ratios, trained on labelled text: the table of samples and the invented sentences of ``EXAMPLES``, which add
kinds of abuse, languages and plain prose that a small table lacks. A text is read as it is and with its disguises
undone (digits and signs for letters, spaced-out, dotted, stretched and starred letters), all of it: sentences, lines,
cells of tables and code. It is scored by passage, and long passages by windows as well, so that a few words in a long
line count. A document's score is that of its worst passage.

How common an n-gram is in harmless text is learned from a bounded sample of the searched documents, which are not
labelled. A count is compared with what it should be by that rate, so an n-gram too rare to say anything gets a ratio
near 0 and a few abusive passages in the sample teach nothing. Each half of the sample is judged by a fit that has not
seen it: clearly harmless passages join the harmless side, clearly abusive ones the other (self-training), and what
lies between is left out.

Null and empty texts score 0. Rates count documents; null sources form a group of their own.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import linear, sampling

#: Hashed features; lengths of n-grams; pseudo-count of a feature, in expected occurrences on the labelled side.
DIM, GRAMS, PRIOR = 1 << 20, (2, 3, 4, 5, 6), 0.7
#: Bounds of what is trained on: labelled rows, documents of the sample and their distinct passages, chosen by hash.
LABELLED, BACKGROUND, PASSAGES = 20_000, 3_000, 16_000
#: Log-odds under which a sampled passage is harmless and over which it is abusive; score from which a document is a case.
HARMLESS, ABUSIVE, BAR = -2.0, 3.0, 0.75
#: n-grams that a short passage counts as; width and step of the windows, in characters; characters scored at once.
LEAST, WINDOW, STEP, CHUNK = 100.0, 72, 8, 400_000
#: Longest passage that is trained on as one; weight of a passage that says nothing, against 1 for a side.
LONG, SILENT = 240, 0.2

#: Signs that stand for letters (fixed values).
_SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "€": "e", "£": "l", "|": "i", "+": "t", "¡": "i", "(": "c"})
_WORDISH = re.compile(r"(?<![\w@$!|+£€(*#-])(?=[^\s]*[a-z])(?=[^\s]*[0-9@$!|+£€(])[\w@$!|+£€(*]+(?:[\w@$*])")
_SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:[ .\-_*·~,/|]{1,3}[^\W\d_]){2,}(?![^\W_])")
_STRETCH = re.compile(r"([^\W\d_])\1{2,}")
_INNER = re.compile(r"(?<=[^\W\d_])[.\-·\u200b\u200c\u200d\u2060\ufeff\u00ad]+(?=[^\W\d_])")
_NOT_SIGN = re.compile(r"[^\W\d_]")
_WRAP = re.compile(r"(?<=[^\s.!?…。！？:;])[ \t\r]*\n(?=[ \t]*[^\s#*+>|=\-\d])")
_CUT = re.compile(r"(?<=[.!?…])[\"')\]*_]*\s+|(?<=[。！？])|\n+|\|")
_STARRED = re.compile(r"(?<=[a-z])\*+(?=[a-z])")
_OTHER = re.compile(r"[\W\d_]+")
#: Letters of no living script that stand for the end of a passage and for a starred letter.
_END, _STAR = "\ua66e", "\ua668"
_ODD = re.compile(r"(?:[^\W\d_][ .\-_*·~,/|]{1,3}){2}|[0-9@$!|+£€¡(][a-z]|[a-z][0-9@$!|+£€¡(]|([^\W\d_])\1\1|[a-z][.\-·][a-z]")

#: Invented sentences of the kinds that are looked for, and harmless ones of the same build (label, text).
EXAMPLES = [
    (1, "You filthy bastard, shut up."),
    (1, "Shut up, you ugly fool, nobody wants to hear you."),
    (1, "Kill yourself, nobody would miss you."),
    (1, "Go hang yourself, we would all be better off without you."),
    (1, "Go jump in front of a train, you loser, nobody needs you."),
    (1, "Go drown in the river, you rat, the world does not need you."),
    (1, "Jump off a roof, idiot, the world is better off without scum."),
    (1, "You should die, you stupid bitch."),
    (1, "You are so dumb that it makes me sick."),
    (1, "People like you disgust me."),
    (1, "I hope you die, you pathetic piece of trash."),
    (1, "I hope you get fired, you lazy clown."),
    (1, "What a bunch of losers and morons you all are."),
    (1, "I will break your neck, you coward."),
    (1, "This guy is a brainless parasite and should be banned."),
    (1, "He is a miserable worm and nobody likes him."),
    (1, "Du dummes Arschloch, halt den Mund und hau ab."),
    (1, "Du bist ein Vollidiot, verpiss dich."),
    (1, "Du bist echt ein dummer Idiot, verschwinde von hier."),
    (1, "So ein dummer Trottel bist du, du wertloser Abschaum."),
    (1, "Ferme-la, sale connard."),
    (1, "Espèce de pauvre idiot, va te faire foutre."),
    (1, "Cállate, hijo de puta, eres una basura."),
    (1, "Vete de aquí, maldito idiota, pedazo de mierda."),
    (1, "Lárgate, maldita basura."),
    (1, "Stai zitto, brutto stronzo."),
    (1, "Cala a boca, seu idiota imundo."),
    (1, "The elderly are a drain on us and should be put away."),
    (1, "Old folks are useless and a burden, let them die."),
    (1, "Old men and cripples should just be left to rot."),
    (1, "Disabled people are a burden, get rid of them."),
    (1, "Jews are parasites."),
    (1, "Muslims are animals, deport them all."),
    (1, "Lock them all up, those immigrants are criminals and thieves."),
    (1, "Gays are sick and should be killed."),
    (1, "Black people are lazy thieves by birth."),
    (1, "Typical Arabs, too lazy to learn, send them back."),
    (1, "Foreigners are too stupid to work, send them home."),
    (1, "Girls are too dumb for this job."),
    (1, "Ausländer sind Dreck, alle raus."),
    (1, "Les étrangers sont des voleurs, qu'ils crèvent."),
    (1, "Los inmigrantes son animales, fuera todos."),
    (1, "He fucked her hard against the bed until she moaned."),
    (1, "He ripped off her clothes and fucked her on the floor."),
    (1, "She sucked his dick and he came in her mouth."),
    (1, "I want to fuck you, baby."),
    (1, "Show me your tits and your wet pussy."),
    (1, "Great tits, honey, let me see more of you."),
    (1, "Nice ass, baby, send me more."),
    (1, "He pulled down her panties and touched her naked breasts."),
    (1, "I am so horny, take off your clothes and come to my bed."),
    (1, "Ich will dich nackt in meinem Bett ficken."),
    (1, "Quiero follarte toda la noche."),
    (1, "Je veux te baiser, montre-moi tes seins."),
    (0, "Nobody had ever seen the river so high in spring."),
    (0, "He answered that birds never sleep in winter."),
    (0, "She got on the train and waved to him until it left."),
    (0, "Somebody once wrote that the old bridge was built by two brothers."),
    (0, "He pushed the chair against the wall and opened the window for her."),
    (0, "They counted the boats on the lake and measured the distance between them."),
    (0, "In that year the town paid its workers with silver coins."),
    (0, "The king and his people lived near the sea for many years."),
    (0, "You make me happy when you sing in the morning."),
    (0, "Show me more of your photos from the trip."),
    (0, "Nice work, thank you, send me the rest tomorrow."),
    (0, "People like you help this community grow."),
    (0, "I hope you all enjoy your new jobs."),
    (0, "What a bunch of flowers, they are beautiful."),
    (0, "The world would be a better place with more music."),
    (0, "Only a friend like you could remember this, come back soon."),
    (0, "Old people are welcome here and ought to be heard."),
    (0, "Women and men work here in equal numbers."),
    (0, "Everybody here knows the song and sings it every evening."),
    (0, "We want your opinion, tell us what you think of this place."),
    (0, "Animals such as goats, herons and horses must be kept away from the road."),
    (0, "I went to bed with a cold and felt better the next day."),
    (0, "Their author described many kinds of trees in verse."),
    (0, "Travellers from the north exchanged cloth against salt."),
    (0, "Who carried the lamps across the hill, and why did she leave?"),
    (0, "I felt like a fool when I saw my own mistake."),
    (0, "I was so stupid to delete the wrong file, sorry everybody."),
    (0, "This stupid bug is killing me, what a terrible release."),
    (0, "The article explains why insults such as idiot are not allowed here."),
    (0, "Please report anybody who sends threats or sexual messages."),
    (0, "Kill the process if it hangs, then remove its child."),
    (0, "Der Mann öffnet das Fenster und wartet auf den Zug."),
    (0, "Du bist heute so freundlich, vielen Dank."),
    (0, "Die Kinder sind im Garten und gehören zur Familie."),
    (0, "Wer das liest, sollte den Rest nicht vergessen."),
    (0, "Le garçon ferme la porte et va à la gare."),
    (0, "Tu es un bon ami, merci pour ton aide."),
    (0, "Les voisins sont de bonne humeur ce matin."),
    (0, "El niño abre la puerta y espera el tren."),
    (0, "Eres muy amable, gracias por todo."),
    (0, "Los vecinos son de aquí y trabajan todos."),
    (0, "Il ragazzo apre la porta e aspetta il treno."),
    (0, "O menino abre a porta e espera o trem."),
]


def plain(text: str) -> str:
    """Lower case without accents and invisible signs."""
    if text.isascii():
        return text.lower()
    low = unicodedata.normalize("NFKD", text.lower())
    return "".join(c for c in low if not unicodedata.combining(c) and c not in "​‌‍⁠﻿­")


def readings(low: str) -> list[str]:
    """A plain text as it is, and with its disguises undone where it has any."""
    out = [low]
    undone = _SPACED.sub(lambda m: "".join(_NOT_SIGN.findall(m.group())), low)
    undone = _WORDISH.sub(lambda m: m.group().translate(_SIGNS), undone)
    undone = _STRETCH.sub(r"\1", undone)
    if undone != low:
        out.append(undone)
    joined = _INNER.sub("", undone)
    if joined != undone:
        out.append(joined)
    return out


def passages(text: str | None) -> list[str]:
    """Every passage of a text in every reading, as words between single blanks; each once. A starred letter becomes a sign of its own.

    A passage is a sentence, a line or the cell of a table, wherever it stands; wrapped lines are joined.
    """
    if not text:
        return []
    low = plain(text)
    low = _WRAP.sub(" ", low) if "\n" in low else low
    found: dict[str, None] = {}
    for r in [low, *readings("\n".join(filter(_ODD.search, low.split("\n"))))[1:]]:
        cut = _END.join(_CUT.split(_STARRED.sub(_STAR, r) if "*" in r else r))
        for line in _OTHER.sub(" ", cut).split(_END):
            line = line.strip()
            if line:
                found[line] = None
    return [f" {line} " for line in found]


def parts(passage: str) -> list[str]:
    """A passage cut between words into parts of at most about ``LONG`` characters, as for training."""
    out, words, size = [], [], 0
    for w in passage.split():
        if size + len(w) >= LONG and words:
            out.append(f" {' '.join(words)} ")
            words, size = [], 0
        words.append(w)
        size += len(w) + 1
    return out + ([f" {' '.join(words)} "] if words else [])


class Grams:
    """The hashed n-grams of passages: feature numbers by length, with the place where each begins."""

    def __init__(self, texts: list[str]):
        codes = np.frombuffer("\x00".join([*texts, ""]).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        self.ends = np.nonzero(codes == 0)[0]
        self.starts = np.concatenate([[0], self.ends[:-1] + 1]) if len(texts) else np.empty(0, np.int64)
        self.owner = np.repeat(np.arange(len(texts), dtype=np.int32), self.ends - self.starts + 1)
        self.size = len(codes)
        left = self.ends[self.owner] - np.arange(len(codes))
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []
        h = np.zeros(len(codes), np.uint64)
        with np.errstate(over="ignore"):
            for n in range(1, max(GRAMS) + 1):
                if len(codes) < n:
                    break
                h = h[: len(codes) - n + 1] * np.uint64(0x100000001B3) + (codes[n - 1 :] + np.uint64(0x9E37)) * np.uint64(0x9E3779B97F4A7C15)
                if n in GRAMS:
                    feature = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(44)
                    self.runs.append((feature.astype(np.int32), left[: len(h)] >= n))

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers and the passage of each."""
        return np.concatenate([f[ok] for f, ok in self.runs]), np.concatenate([self.owner[: len(f)][ok] for f, ok in self.runs])


class Model:
    """Weights of features, already multiplied by their ratios, and a bias."""

    def __init__(self, product: np.ndarray, bias: float):
        self.product, self.bias = product.astype(np.float32), bias

    def log_odds(self, texts: list[str]) -> np.ndarray:
        """Of each passage: the larger of the whole's and its windows' log-odds."""
        out, held, size = [], [], 0
        for t in texts:
            held.append(t)
            size += len(t)
            if size > CHUNK:
                out.append(self._log_odds(held))
                held, size = [], 0
        return np.concatenate([*out, self._log_odds(held)]) if held or not out else np.concatenate(out)

    def _log_odds(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        g = Grams(texts)
        value, count = np.zeros(g.size), np.zeros(g.size)
        for feature, ok in g.runs:
            value[: len(ok)] += self.product[feature] * ok
            count[: len(ok)] += ok
        value, count = np.concatenate([[0], np.cumsum(value)]), np.concatenate([[0], np.cumsum(count)])
        between = lambda a, b: (value[b] - value[a]) / np.sqrt(np.maximum(count[b] - count[a], LEAST))
        best = between(g.starts, g.ends)
        places = np.arange(0, g.size, STEP)
        own = g.owner[places]
        inside = (g.ends[own] - g.starts[own] > 1.5 * WINDOW) & (places + WINDOW <= g.ends[own])
        np.maximum.at(best, own[inside], between(places[inside], places[inside] + WINDOW))
        return best * 10 + self.bias

    def documents(self, texts: list[str | None]) -> np.ndarray:
        """Scores of texts; 0 where there is no passage."""
        own = [passages(t) for t in texts]
        z, of = self.log_odds([p for ps in own for p in ps]), np.repeat(np.arange(len(own)), [len(ps) for ps in own])
        best = np.full(len(own), -np.inf)
        np.maximum.at(best, of, z)
        return 1 / (1 + np.exp(-np.clip(best, -30, 30))) * np.isfinite(best)


def fit(abusive: list[str], harmless: list[str], sampled: list[str], rounds: int = 25) -> Model:
    """A logistic regression on n-grams scaled by their ratios. The labelled harmless passages weigh as much as the sampled ones."""
    if not abusive or not harmless:
        return Model(np.zeros(DIM), -30.0)
    f, of = Grams(abusive + harmless + sampled).flat()
    n, first = len(abusive) + len(harmless) + len(sampled), len(abusive)
    side = [np.full(len(harmless), 1 / len(harmless)), np.full(len(sampled), 1 / max(1, len(sampled)))]
    weight = np.concatenate([np.full(first, 1 / first), *side])
    weight[first:] /= weight[first:].sum()
    once = np.unique(of.astype(np.int64) * DIM + f)
    on, feature = (once // DIM).astype(np.int32), (once % DIM).astype(np.int32)
    del once
    p, q = np.bincount(feature[on < first], minlength=DIM), np.bincount(feature[on >= first], weight[on[on >= first]], DIM)
    ratio = np.log((p + PRIOR) / (first * q + PRIOR))
    del on, feature, q
    # Features whose ratio says next to nothing are left out, and the rest numbered anew.
    says = np.abs(ratio) > 0.2
    kept, sizes = says[f], np.maximum(np.bincount(of, minlength=n), LEAST)
    f, of = f[kept], of[kept]
    cols = np.nonzero(says)[0]
    value = (ratio[f] / np.sqrt(sizes)[of] * 10).astype(np.float32)
    index = (np.cumsum(says) - 1).astype(np.int32)[f]
    # One example without any n-gram is harmless: what says nothing is no case.
    w, b = linear.fit_flat(index, of, value, np.arange(n + 1) < first, np.append(weight, SILENT) / 2, len(cols), l2=0.01, rounds=rounds)
    product = np.zeros(DIM)
    product[cols] = w * ratio[cols]
    return Model(product, b)


def train(samples: list[tuple[str, str]], sampled: list[str]) -> Model:
    """From labelled texts (text, category), ``none`` for harmless ones, and passages of unlabelled documents.

    Of a labelled text of several sentences the worst is the one that was meant.
    """
    abusive, harmless, several = [], [], []
    for text, category in samples:
        own = [p for s in _CUT.split(_WRAP.sub(" ", text or "")) for p in passages(s)[-1:]]
        if (category or "none") == "none":
            harmless += own
        elif len(own) == 1:
            abusive += own
        elif own:
            several.append(own)
    invented = [(y, passages(t)[-1]) for y, t in EXAMPLES]
    told = [p for y, p in invented if y], [p for y, p in invented if not y] * 2
    if several:
        judge = fit(abusive + told[0], harmless + told[1], [])
        for own in several:
            worst = int(judge.log_odds(own).argmax())
            abusive.append(own[worst])
            harmless += own[:worst] + own[worst + 1 :]
    if not abusive or not harmless:
        return Model(np.zeros(DIM), -30.0)
    abusive, harmless = abusive + told[0], harmless + told[1]
    bad, good = [], []
    for fold in (0, 1):
        judge = fit(abusive, harmless, sampled[1 - fold :: 2], rounds=20)
        own = sampled[fold::2]
        z = judge.log_odds(own)
        good += [p for p, s in zip(own, z) if s < HARMLESS]
        bad += [p for p, s in zip(own, z) if s >= ABUSIVE]
    return fit(abusive + bad, harmless, good)


def fit_tables(samples: DataFrame, docs: DataFrame, text: str = "text") -> Model:
    """The model from the labelled table (``text, category``) and passages of a sample of ``docs``, both bounded and chosen by hash."""
    rows = sampling.by_hash(samples.filter(F.col("text").isNotNull()).select("text", "category"), F.col("text"), LABELLED)
    labelled = sorted((r[0], r[1] or "none") for r in rows.collect())

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"_p": [x for t in batch["_t"] for p in passages(t) for x in parts(p)]}, dtype="object").drop_duplicates()

    filled = docs.filter(F.length(F.trim(F.col(text))) > 0).select(F.col(text).alias("_t"))
    found = sampling.by_hash(filled, F.col("_t"), BACKGROUND).mapInPandas(cut, "_p string").distinct()
    picked = found.orderBy(F.xxhash64("_p"), "_p").limit(PASSAGES).collect()
    return train(labelled, [r[0] for r in picked])


def score_documents(docs: DataFrame, samples: DataFrame, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with ``out``: how likely its worst passage is abusive, hateful or sexually explicit."""
    model = fit_tables(samples, docs, text)
    shared = docs.sparkSession.sparkContext.broadcast((model.product, model.bias))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(*shared.value)
        for batch in batches:
            texts = list(batch)
            yield pd.Series(np.concatenate([own.documents(texts[at : at + 256]) for at in range(0, len(texts), 256)]) if texts else [], dtype="float64")

    return docs.withColumn(out, score(F.col(text)))


def source_rates(scored: DataFrame, source: str = "source", score: str = "score", bar: float = BAR) -> DataFrame:
    """``source, n_docs, n_cases, rate, mean_score``."""
    case = F.count_if(F.col(score) >= bar)
    return scored.groupBy(source).agg(F.count(F.lit(1)).alias("n_docs"), case.alias("n_cases"), (case / F.count(F.lit(1))).alias("rate"), F.avg(score).alias("mean_score"))
