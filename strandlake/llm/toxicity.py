"""Counterfactual-regularised toxicity classifier: a logistic model over words and word beginnings.

For every labelled sentence that names a group, the same sentence with another group's name is made, and for every group sentences
that do no more than mention it, with another group's name or with a word for people in general in its place. Differences between
the scores of a sentence and its counterfactual are penalised, so that a bare mention of a group counts for little.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from strandlake.llm.labelled import sample, scored

#: Identity terms that are swapped for one another, by language.
IDENTITY = {
    "en": "muslim christian jewish buddhist hindu atheist catholic gay lesbian straight transgender black white asian african european american women men immigrants refugees elderly disabled deaf blind",
    "de": "muslimisch christlich jüdisch buddhistisch katholisch schwul lesbisch schwarz weiß asiatisch frauen männer ausländer flüchtlinge behinderte",
    "fr": "musulman chrétien juif bouddhiste catholique homosexuel lesbienne noir blanc asiatique femmes hommes immigrés réfugiés handicapés",
    "es": "musulmán cristiano judío budista católico homosexual lesbiana negro blanco asiático mujeres hombres inmigrantes refugiados discapacitados",
}
IDENTITY = {k: v.split() for k, v in IDENTITY.items()}
#: Words for people in general, and sentences that only mention somebody, by language.
ANYBODY = {"en": ["people", "neighbours", "students"], "de": ["leute", "nachbarn", "schüler"], "fr": ["gens", "voisins", "élèves"], "es": ["personas", "vecinos", "estudiantes"]}
MENTIONS = {
    "en": ["my {} friends came to dinner", "the {} family next door", "a report about {} in the city", "we talked with {} all day"],
    "de": ["meine {} freunde kamen zum essen", "die {} familie von nebenan", "ein bericht über {} in der stadt", "wir sprachen den ganzen tag mit {}"],
    "fr": ["mes amis {} sont venus dîner", "la famille {} d'à côté", "un article sur les {} de la ville", "nous avons parlé avec des {}"],
    "es": ["mis amigos {} vinieron a cenar", "la familia {} de al lado", "un informe sobre {} en la ciudad", "hablamos con {} todo el día"],
}
STARTS = (4, 5, 6)
LONE = 3
_words = re.compile(r"[^\W\d_]+").findall


def features(word: str) -> list[str]:
    """The word, and its beginnings, which compounds share."""
    return [word, *(f"{word[:n]}*" for n in STARTS if len(word) > n)]


def swapped(words: set[str], terms: dict[str, list[str]]) -> set[str] | None:
    """The sentence with each identity term replaced by the next of its language; None where there is none."""
    nxt = {t: own[(i + 1) % len(own)] for own in terms.values() for i, t in enumerate(own)}
    return {nxt.get(w, w) for w in words} if words & nxt.keys() else None


def mentions(terms: dict[str, list[str]]) -> list[tuple[set[str], set[str]]]:
    """Sentences that mention a group, with counterfactuals: the next group, and people in general. Other languages take English ones."""
    out = []
    for lang, own in terms.items():
        plain = ANYBODY.get(lang, ANYBODY["en"])
        for text in MENTIONS.get(lang, MENTIONS["en"]):
            said = lambda who, text=text: set(_words(text.format(who).lower()))
            for i, t in enumerate(own):
                out += [(said(t), said(own[(i + 1) % len(own)])), (said(t), said(plain[i % len(plain)]))]
    return out


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    memo: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def word(self, w: str) -> tuple[str, ...]:
        """The word's features that have a weight: none for nearly all words."""
        if len(self.memo) > 400_000:
            self.memo.clear()
        self.memo[w] = own = tuple(f for f in features(w) if f in self.weights)
        return own

    def score(self, texts: list[str]) -> np.ndarray:
        out, get = np.empty(len(texts)), self.memo.get
        for i, text in enumerate(texts):
            found: set[str] = set()
            for w in set(_words(text.lower())):
                if (own := get(w)) is None:
                    own = self.word(w)
                if own:
                    found.update(own)
            out[i] = self.bias + sum(self.weights[f] for f in sorted(found))
        return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def fit(texts: list[str], y: np.ndarray, weight: np.ndarray, most: int = 2000, z: float = 4.0, odds: float = 3.0, decay: float = 0.003, fair: float = 3.0, steps: int = 1500, terms: dict[str, list[str]] | None = None) -> Model:
    """Words and beginnings that toxic texts have `odds` times as often, by over z standard errors, then logistic weights.

    most: features that are kept, the most telling ones, besides terms: the names of groups, by language. decay: L2 penalty.
    fair: weight of the squared score change between a sentence and its counterfactual.
    """
    terms = IDENTITY if terms is None else terms
    if len(set(y.tolist())) < 2:
        return Model({}, -4.0 if not len(y) or y[0] == 0 else 4.0)
    weight = np.sqrt(weight)  # between the classes' shares and even: a single telling word has to be enough
    words_of = lambda t: set(_words(t.lower()))
    n1 = max(1, int(y.sum()))
    n0 = max(1, len(y) - n1)
    # features of toxic texts first; of the others only those are counted
    held = [Counter(), Counter()]
    for t, k in zip(texts, y.tolist()):
        if k:
            held[1].update({f for w in words_of(t) for f in features(w)})
    held[1] = Counter({f: a for f, a in held[1].items() if a >= 3})
    for t, k in zip(texts, y.tolist()):
        if not k:
            held[0].update({f for w in words_of(t) for f in features(w)} & held[1].keys())
    power = {}
    for f, a in held[1].items():
        b = held[0][f]
        if (a + 0.5) / n1 > odds * (b + 0.5) / n0:
            p = (a + b) / (n1 + n0)
            power[f] = abs(a / n1 - b / n0) / np.sqrt(max(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
    chosen = sorted((f for f in power if power[f] > z), key=lambda f: (-power[f], f))[:most]
    names = {t for own in terms.values() for t in own}
    chosen = list(dict.fromkeys(chosen + sorted(names)))
    at = {f: i for i, f in enumerate(chosen)}
    known = {f.removesuffix("*") for f in chosen}
    # of each text the words that have a chosen feature
    sets = [{w for w in words_of(t) if w in known or any(w[:n] in known for n in STARTS)} for t in texts]
    counts = [{f for w in s for f in features(w)} for s in sets]

    def places(all_features) -> tuple[np.ndarray, np.ndarray]:
        """Row and column of each chosen feature that a row has."""
        found = [(i, at[f]) for i, own in enumerate(all_features) for f in sorted(own) if f in at]
        return tuple(np.array(found, np.int64).reshape(-1, 2).T)

    # each telling word of a toxic text, up to LONE of them, also stands alone, so that one is enough
    telling = {f for f in chosen if held[1][f] >= 8 and held[1][f] / n1 > 30 * (held[0][f] + 0.5) / n0} - names
    lone = [(i, own) for i in np.flatnonzero(y == 1).tolist() for own in sorted({tuple(f for f in features(w) if f in telling) for w in sets[i]} - {()})[:LONE]]
    y, weight = np.r_[y, np.ones(len(lone), np.int64)], np.r_[weight, 0.15 * weight[[i for i, _ in lone]]]
    row, col = places(counts + [set(own) for _, own in lone])
    # a sentence less its counterfactual, per feature
    pairs = [(s, t) for s in sets if (t := swapped(s, terms))] + mentions(terms)
    with_row, with_col = places([{f for w in s for f in features(w)} for s, _ in pairs])
    swap_row, swap_col = places([{f for w in t for f in features(w)} for _, t in pairs])
    pair_row, pair_col, sign = np.r_[with_row, swap_row], np.r_[with_col, swap_col], np.r_[np.ones(len(with_row)), -np.ones(len(swap_row))]
    n, d = len(y), len(chosen)
    w, b = np.zeros(d), float(np.log((weight @ y + 1) / (weight @ (1 - y) + 1)))
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    for t in range(1, steps + 1):  # Adam over all rows
        q = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], n) + b, -50, 50)))
        e = weight * (q - y) / n
        g = np.r_[np.bincount(col, e[row], d) + decay * w / d, e.sum()]
        if pairs:
            change = np.bincount(pair_row, sign * w[pair_col], len(pairs))
            g[:-1] += fair * np.bincount(pair_col, sign * change[pair_row], d) / len(pairs)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Model({f: float(k) for f, k in zip(chosen, w) if abs(k) > 1e-4}, float(b))


def classify_toxicity(docs: DataFrame, labels: DataFrame, most: int = 3000, terms: dict[str, list[str]] | None = None, fair: float = 3.0) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: more toxic), predicted (score >= 0.7) for every row of docs.

    labels: doc_id, toxic; only rows that aren't held out are learnt from, at most `most` of either class and 128 MB of their
    texts (the bound of the sample on the driver). The model has weights for at most 2,000 words and beginnings of words, the
    most telling ones, and for terms, the names of groups by language (IDENTITY, if none are given); up to LONE telling words
    of a toxic text are also learnt alone. fair: weight of the penalty on score changes when a group is replaced; 0: none.
    The score reads nothing but the text. Null texts are empty; empty texts score by the prior; a null doc_id is held out;
    repeated rows get the same score; no labels: nothing is toxic; no rows give none.
    """
    model = fit(*sample(docs, labels, "toxic", most), fair=fair, terms=terms)
    handle = docs.sparkSession.sparkContext.broadcast(model)
    return scored(docs, lambda texts: handle.value.score(texts), 0.7)
