"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network with a calibrated temperature.

Every token has a sparse ternary index vector drawn from its hash. A word's vector is the sum of the index vectors of the words
around it in the labelled sample, so words of like surroundings lie close together; words outside the sample's vocabulary go by
their shape. Marks for a word said again at once, for a line said again and for length stand among the words.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame

from strandlake.llm.labelled import kept, sample, scored

DIM, ONES, REACH, HIDDEN = 64, 6, 2, 32
#: A short text is judged as if it had so many words of the usual kind besides.
PRIOR = 6
AGAIN, LINE_AGAIN, EMPTY = "\x00again", "\x00line", "\x00empty"


def shape(w: str) -> str:
    """What a word outside the vocabulary looks like: case, length and the two last characters if they aren't letters or digits."""
    end = "" if w[-1].isalnum() else w[-2:] if len(w) > 1 and not w[-2].isalnum() else w[-1]
    return f"\x00{'U' if w.isupper() else 'l' if w.islower() else 't' if w[:1].isupper() else 'm'}{min(len(w), 24) // 4}{'a' if w.isalpha() else 'x'}{end}"


def _marks(text: str, words: list[str]) -> list[tuple[str, int]]:
    """Marks and how often each counts: about as often as the words that they speak of."""
    if not words:
        return [(EMPTY, 1)]
    lines, seen, said = text.split("\n"), set(), 0
    for line in lines if len(lines) > 1 else ():
        if line in seen:
            said += len(line.split())
        seen.add(line)
    n = len(words)
    kinds = int(4 * len(set(words)) / n)
    out = [(f"\x00size{min(n, 4095).bit_length()}", 1 + n // 8), (f"\x00kinds{kinds}{min(n, 4095).bit_length() // 3}", 1 + n // 8)]
    return out + [(k, c) for k, c in ((AGAIN, sum(map(eq, words, words[1:]))), (LINE_AGAIN, said)) if c]


def _index_vectors(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the ONES entries of each token's index vector."""
    from xxhash import xxh64_intdigest

    h = np.array([[xxh64_intdigest(t.encode("utf-8", "surrogatepass"), k) for k in range(ONES)] for t in tokens], np.uint64)
    return (h % np.uint64(DIM)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(1)).astype(float) * 2 - 1


@dataclass
class Net:
    vocabulary: dict[str, int]
    vectors: np.ndarray
    layers: tuple
    temperature: float
    usual: np.ndarray

    def pooled(self, texts: list[str]) -> np.ndarray:
        get, rest = self.vocabulary.get, self.vocabulary
        out = np.zeros((len(texts), DIM), np.float32)
        for i, text in enumerate(texts):
            words = text.split()
            ids = [k if k is not None else rest.get(shape(w), 0) for k, w in zip(map(get, words), words)]
            total, n = self.vectors[ids].sum(0) if ids else np.zeros(DIM, np.float32), len(ids)
            for mark, c in _marks(text, words):
                total, n = total + c * self.vectors[rest.get(mark, 0)], n + c
            out[i] = (total + PRIOR * self.usual) / (n + PRIOR)
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        z = logits(self.layers, self.pooled(texts).astype(float)) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def logits(layers: tuple, x: np.ndarray) -> np.ndarray:
    mean, scale, w1, b1, w2, b2 = layers
    return np.tanh((x - mean) / scale @ w1 + b1) @ w2 + b2


def word_vectors(texts: list[str], least: int, most: int) -> tuple[dict[str, int], np.ndarray]:
    """Ids (0: nothing known) and vectors of the words seen `least` times, at most `most`, of all shapes and of all marks.

    Texts are split again in each pass and summed up in blocks, so the driver holds counts and vectors but never all words.
    """
    counts: Counter = Counter()
    marks: dict[str, None] = {}
    for t in texts:
        words = t.split()
        counts.update(words)
        marks |= dict.fromkeys(m for m, _ in _marks(t, words))
    known = [w for w, c in sorted(((w, c) for w, c in counts.items() if c >= least), key=lambda x: (-x[1], x[0]))[:most]]
    shapes = sorted(set(map(shape, counts)))
    del counts
    vocabulary = {t: i for i, t in enumerate(dict.fromkeys(["\x00none", *known, *shapes, *marks]))}
    place, sign = _index_vectors(list(vocabulary))
    around = np.zeros(len(vocabulary) * DIM)

    def add(ids: np.ndarray, by_shape: np.ndarray) -> None:
        for own in (ids, by_shape):  # a known word teaches its shape too
            for d in range(1, REACH + 1):
                for a, b in ((own[:-d], ids[d:]), (own[d:], ids[:-d])):
                    both = (a > 0) & (b > 0)
                    for k in range(ONES):
                        np.add.at(around, a[both] * DIM + place[b[both], k], sign[b[both], k])

    block: list[int] = []
    block_shapes: list[int] = []
    for t in texts:
        words = t.split()
        own = [vocabulary[shape(w)] for w in words]
        block += [vocabulary.get(w, k) for w, k in zip(words, own)] + [0] * REACH
        block_shapes += own + [0] * REACH
        if len(block) > 100_000:
            add(np.array(block), np.array(block_shapes))
            block, block_shapes = [], []
    add(np.array(block, np.int64), np.array(block_shapes, np.int64))
    around = around.reshape(-1, DIM)
    around /= np.maximum(np.linalg.norm(around, axis=1, keepdims=True), 1e-9)
    for k in range(ONES):
        np.add.at(around, (np.arange(len(around)), place[:, k]), sign[:, k] / np.sqrt(ONES))
    around[0] = 0
    return vocabulary, around.astype(np.float32)


def _train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 1500, decay: float = 1e-4) -> tuple:
    rng = np.random.default_rng(7)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = (x - mean) / scale
    p = [rng.normal(0, 1 / np.sqrt(DIM), (DIM, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, steps + 1):
        at = rng.integers(0, len(z), min(256, len(z)))
        h = np.tanh(z[at] @ p[0] + p[1])
        q = 1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -50, 50)))
        d = weight[at] * (q - y[at]) / len(at)
        dh = np.outer(d, p[2]) * (1 - h * h)
        grads = [z[at].T @ dh + decay * p[0], dh.sum(0), h.T @ d + decay * p[2], np.array([d.sum()])]
        for k, g in enumerate(grads):
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            p[k] = p[k] - 0.005 * (1 - t / steps / 1.1) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return mean, scale, *p


def _temperature(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The temperature of least log loss on rows that the network has not been fitted to."""
    loss = lambda t: float((weight * np.logaddexp(0, np.where(y == 1, -z, z) / t)).sum())
    return min(np.geomspace(0.25, 8, 61).tolist(), key=loss)


def fit(texts: list[str], y: np.ndarray, weight: np.ndarray, least: int = 4, most: int = 40_000) -> Net:
    """The classifier; every fifth row is kept for the temperature. One class or none: a network that says its share."""
    vocabulary, vectors = word_vectors(texts, least, most)
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 1.0
        z = np.log((share + 0.01) / (1.01 - share))
        return Net(vocabulary, vectors, (np.zeros(DIM), np.ones(DIM), np.zeros((DIM, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.array([z])), 1.0, np.zeros(DIM, np.float32))
    net = Net(vocabulary, vectors, (), 1.0, np.zeros(DIM, np.float32))
    net.usual = np.average(net.pooled(texts), 0, weight).astype(np.float32)
    x, aside = net.pooled(texts).astype(float), np.arange(len(texts)) % 5 == 4
    if len(set(y[~aside].tolist())) < 2 or not aside.any():
        aside[:] = False
    net.layers = _train(x[~aside], y[~aside], weight[~aside])
    if aside.any():
        net.temperature = _temperature(logits(net.layers, x[aside]), y[aside], weight[aside])
    return net


def classify_quality(docs: DataFrame, labels: DataFrame, most: int = 2000) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: better), predicted (score >= 0.5) for every row of docs.

    labels: doc_id, quality; only rows that aren't held out are learnt from, at most `most` of either class and 128 MB of their
    texts (the bound of the sample on the driver). The model has vectors of DIM for at most 40,000 words, the most frequent
    ones, which are seen 4 times or more; other words go by their shape, of which there are some hundreds. The score reads nothing but the text. Null texts are empty; empty texts score as such; a null
    doc_id is held out; repeated rows get the same score; no labels: everything passes; no rows give none.
    """
    net = fit(*sample(docs, labels, "quality", most))
    handle = docs.sparkSession.sparkContext.broadcast(net)
    return scored(docs, lambda texts: handle.value.score(texts), 0.5)


def drop_low_quality(docs: DataFrame, labels: DataFrame, most: int = 2000) -> DataFrame:
    """docs without the rows that classify_quality() predicts 0 for; all columns pass through."""
    net = fit(*sample(docs, labels, "quality", most))
    handle = docs.sparkSession.sparkContext.broadcast(net)
    return kept(docs, lambda texts: handle.value.score(texts), 0.5)
