"""Language of words and documents by a linear-chain conditional random field.

The units of a sequence are words. One is cut where its script changes, and into even parts of at most 24 letters,
or of 4 in scripts without spaces, so that every letter is read and languages may change within a run.
Every unit has features: its first and last one to three letters, its two- and three-letter
sequences with the word's borders, and the language that a lexicon of the training words
gives it. Weights of features and of transitions between languages are learned by gradient
steps on the conditional likelihood. Words are labelled by forward-backward; a document's
language has the largest expected number of words, and its score is their share.

Training rows are a bounded sample (``per_language`` documents of each language with the smallest
hashes of their ids); sequences are pieces of different documents, so that switches are seen.

Defined results: a null text, or one without a letter, is ``und`` with score 0; texts that
repeat get the same answer; an empty table gives no rows; without any labelled
training row every document is ``und``. ``predict_language`` returns doc_id, lang_pred,
score; ``keep_language`` keeps all columns.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentrilake.llm.slices import small_batches, text_slices
from sentrilake.llm.worker import lean

UNKNOWN = "und"
PER_LANGUAGE = 150
LEAST_SCORE = 0.35
_BITS = 16
_LETTERS = 24
_LETTER_RUN = re.compile(r"[^\W\d_]+")
_PIECE, _SEQUENCE = 40, 80
#: Units whose posteriors are held at once, words that a task remembers, and bytes of the texts it splits at once.
_GROUP_WORDS = 100_000
_KNOWN_WORDS = 200_000
_SLICE_BYTES = 2 << 20


#: Letters of a script, and the most letters of a unit in it: few where no spaces part the words.
_SCRIPTS = (
    ("A-Za-z\u00aa\u00ba\u00c0-\u02ff\u1e00-\u1eff\ufb00-\ufb06", _LETTERS), ("\u0370-\u03ff\u1f00-\u1fff", _LETTERS),
    ("\u0400-\u052f", _LETTERS), ("\u0590-\u05ff", _LETTERS), ("\u0600-\u06ff\u0750-\u077f", _LETTERS),
    ("\u1100-\u11ff\u3130-\u318f\uac00-\ud7af", _LETTERS), ("\u0e00-\u0e7f", 4), ("\u0e80-\u0eff", 4), ("\u0f00-\u0fff", 4),
    ("\u1000-\u109f", 4), ("\u1780-\u17ff", 4), ("\u3040-\u30ff\u31f0-\u31ff\uff66-\uff9f", 4),
    ("\u3005-\u3007\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff", 4),
)
_SCRIPT_RUN = re.compile("|".join(f"([{x}]+)" for x, _ in _SCRIPTS) + f"|([^{''.join(x for x, _ in _SCRIPTS)}]+)")


def units(word: str) -> list[str]:
    """The lower-cased letters of a word, as one unit or as several."""
    letters = "".join(_LETTER_RUN.findall(word.lower()))
    if len(letters) <= _LETTERS and letters.isascii():
        return [letters] if letters else []
    out = []
    for run in _SCRIPT_RUN.finditer(letters):
        most = _SCRIPTS[run.lastindex - 1][1] if run.lastindex <= len(_SCRIPTS) else _LETTERS
        n = len(run[0])
        parts = -(-n // most)
        out += [run[0][n * i // parts : n * (i + 1) // parts] for i in range(parts)]
    return out


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.array(words, f"<U{_LETTERS}").view("<u4").reshape(len(words), _LETTERS).astype(np.uint64)
    return codes, np.array([len(w) for w in words])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def word_hash(words: list[str]) -> np.ndarray:
    codes, _ = _codes(words)
    h = np.zeros(len(words), np.uint64)
    for k in range(_LETTERS):
        h = _mix(h * np.uint64(31) + codes[:, k] + np.uint64(1))
    return h


def word_features(words: list[str], lexicon: tuple[np.ndarray, np.ndarray], languages: int) -> np.ndarray:
    """Feature numbers, one row per word; absent ones point to the last weight, which is zero.
    The lexicon is (sorted word hashes, their languages), with a weight for each of ``languages``."""
    codes, length = _codes(words)
    n, none = len(words), (1 << _BITS) + languages
    border = np.uint64(1)
    rim = np.zeros((n, _LETTERS + 3), np.uint64)
    rim[:, 0] = border
    rim[:, 1 : _LETTERS + 1] = codes
    rim[np.arange(n), length + 1] = border
    columns = []

    def add(kind: int, values: np.ndarray, there: np.ndarray) -> None:
        h = _mix(values * np.uint64(16) + np.uint64(kind)) & np.uint64((1 << _BITS) - 1)
        columns.append(np.where(there, h.astype(np.int64), none))

    for size in (1, 2, 3):
        head, tail = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        for k in range(size):
            head = _mix(head + codes[:, k])
            tail = _mix(tail + codes[np.arange(n), np.maximum(length - 1 - k, 0)])
        add(size, head, length >= size)
        add(size + 3, tail, length >= size)
    for size in (2, 3):
        grams = np.zeros((n, _LETTERS + 3 - size), np.uint64)
        for k in range(size):
            grams = _mix(grams + rim[:, k : k + grams.shape[1]])
        for at in range(grams.shape[1]):
            there = at + size <= length + 2
            if there.any():
                add(size + 5, grams[:, at], there)
    known, language = lexicon
    if len(known):
        h = word_hash(words)
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        columns.append(np.where(known[at] == h, (1 << _BITS) + language[at], none))
    return np.stack(columns, axis=1)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # features x languages
    transitions: np.ndarray  # log weights, from x to
    lexicon: tuple[np.ndarray, np.ndarray]

    def emissions(self, words: list[str]) -> np.ndarray:
        """exp(score) of each word and language, scaled to at most 1."""
        out = np.empty((len(words), len(self.languages)), np.float32)
        for at in range(0, len(words), 20_000):
            features = word_features(words[at : at + 20_000], self.lexicon, len(self.languages))
            score = np.zeros((len(features), len(self.languages)), np.float32)
            for column in features.T:
                score += self.weights[column]
            out[at : at + 20_000] = np.exp(score - score.max(axis=1, keepdims=True))
        return np.maximum(out, 1e-12)


def forward_backward(emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Posterior of every word; ``emissions`` holds sequences one after the other, ``lengths``
    in descending order. All sequences take a step together; those that have ended drop out."""
    lengths = np.asarray(lengths)
    starts = np.cumsum(lengths) - lengths
    move = np.exp(transitions - transitions.max()).astype(np.float32)
    alpha, beta = np.empty_like(emissions), np.ones_like(emissions)
    alive = np.searchsorted(-lengths, -np.arange(1, lengths.max(initial=0) + 1), side="right")
    for t, k in enumerate(alive.tolist()):
        rows = starts[:k] + t
        a = emissions[rows] if t == 0 else (last[:k] @ move) * emissions[rows]
        last = a / a.sum(axis=1, keepdims=True)
        alpha[rows] = last
    for t in range(len(alive) - 2, -1, -1):
        k = alive[t + 1]
        rows = starts[:k] + t
        b = (emissions[rows + 1] * beta[rows + 1]) @ move.T
        beta[rows] = b / b.sum(axis=1, keepdims=True)
    alpha *= beta
    return alpha / alpha.sum(axis=1, keepdims=True)


def fit(texts: list[str], languages: list[str], seed: int = 7, epochs: int = 3, rate: float = 0.3) -> Model:
    """Learn from labelled texts. Sequences of up to 80 words are pieces of up to 40 words from
    documents in random order."""
    names = sorted(set(languages))
    number = {x: i for i, x in enumerate(names)}
    rng = np.random.default_rng(seed)
    per_word: dict[str, Counter] = {}
    pieces = []
    for text, language in zip(texts, languages):
        words = [u for w in text.split() for u in units(w)]
        for w in words:
            per_word.setdefault(w, Counter())[language] += 1
        pieces += [(words[i : i + _PIECE], number[language]) for i in range(0, len(words), _PIECE)]
    vocabulary = list(per_word)
    sure = [(w, c.most_common(1)[0]) for w, c in per_word.items() if c.total() >= 3]
    sure = [(w, number[x]) for w, (x, n) in sure if n >= 0.8 * per_word[w].total()]
    hashes = word_hash([w for w, _ in sure]) if sure else np.zeros(0, np.uint64)
    order = np.argsort(hashes)
    lexicon = hashes[order], np.array([x for _, x in sure], np.int64)[order]
    model = Model(names, np.zeros(((1 << _BITS) + len(names) + 1, len(names)), np.float32), np.zeros((len(names),) * 2), lexicon)
    if not vocabulary:
        return model
    features = word_features(vocabulary, lexicon, len(names))
    place = {w: i for i, w in enumerate(vocabulary)}
    pieces = [(np.array([place[w] for w in words]), x) for words, x in pieces]
    step_w, step_t = np.full(model.weights.shape, 1e-3, np.float32), np.full(model.transitions.shape, 1e-3)
    for _ in range(epochs):
        deal = rng.permutation(len(pieces))
        for at in range(0, len(deal), 128):
            chosen = [pieces[i] for i in deal[at : at + 128]]
            pairs = [chosen[i : i + 2] for i in range(0, len(chosen), 2)]
            sequences = [(np.concatenate([w for w, _ in p]), np.concatenate([np.full(len(w), x) for w, x in p])) for p in pairs]
            sequences.sort(key=lambda s: -len(s[0]))
            words, gold = (np.concatenate(x) for x in zip(*sequences))
            lengths = np.array([len(s[0]) for s in sequences])
            used = features[words]
            score = model.weights[used].sum(axis=1)
            emissions = np.maximum(np.exp(score - score.max(axis=1, keepdims=True)), 1e-12)
            posterior, pair = _expectations(emissions, lengths, model.transitions)
            wrong = posterior.copy()
            wrong[np.arange(len(gold)), gold] -= 1
            gradient = np.zeros_like(model.weights)
            for column in used.T:
                np.add.at(gradient, column, wrong)
            gradient[-1] = 0
            gradient /= len(lengths)
            inner = np.ones(len(gold), bool)
            inner[np.cumsum(lengths) - 1] = False
            inner = np.flatnonzero(inner)
            np.add.at(pair, (gold[inner], gold[inner + 1]), -1)
            pair /= len(lengths)
            step_w += gradient**2
            step_t += pair**2
            model.weights -= rate * gradient / np.sqrt(step_w)
            model.transitions -= rate * pair / np.sqrt(step_t)
    return model


def _expectations(emissions, lengths, transitions):
    """Posteriors of words, and expected counts of neighbouring pairs of languages."""
    posterior = forward_backward(emissions, lengths, transitions)
    starts = np.cumsum(lengths) - lengths
    move = np.exp(transitions - transitions.max())
    pair = np.zeros_like(move)
    ends = starts + lengths - 1
    inner = np.ones(len(emissions), bool)
    inner[ends] = False
    at = np.flatnonzero(inner)
    # alpha and beta up to scale are regained from neighbours: joint = alpha_t move (e beta)_(t+1)
    alpha, right = _halves(emissions, lengths, move)
    joint = alpha[at][:, :, None] * move[None] * right[at + 1][:, None, :]
    joint /= joint.sum(axis=(1, 2), keepdims=True)
    pair += joint.sum(axis=0)
    return posterior, pair


def _halves(emissions, lengths, move):
    starts = np.cumsum(lengths) - lengths
    alive = np.searchsorted(-lengths, -np.arange(1, lengths.max() + 1), side="right")
    alpha, beta = np.empty_like(emissions), np.ones_like(emissions)
    for t, k in enumerate(alive.tolist()):
        rows = starts[:k] + t
        a = emissions[rows] if t == 0 else (alpha[rows - 1] @ move) * emissions[rows]
        alpha[rows] = a / a.sum(axis=1, keepdims=True)
    for t in range(len(alive) - 2, -1, -1):
        rows = starts[: alive[t + 1]] + t
        b = (emissions[rows + 1] * beta[rows + 1]) @ move.T
        beta[rows] = b / b.sum(axis=1, keepdims=True)
    return alpha, emissions * beta


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """``docs``: labelled training rows (doc_id, text, lang). Ids are chosen from a scan of two
    columns; only the texts of the chosen rows, at most ``per_language`` each, reach the driver."""
    usable = docs.where("text IS NOT NULL AND lang IS NOT NULL")
    hashed = usable.select("doc_id", "lang", F.xxhash64("doc_id").alias("hash"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "doc_id"))
    chosen = hashed.withColumn("rank", rank).where(F.col("rank") <= per_language)
    ids = sorted({r[0] for r in chosen.select("doc_id").collect() if r[0] is not None})
    texts = usable.where(F.col("doc_id").isin(ids)) if ids else usable.limit(0)
    rows = texts.select("doc_id", "text", "lang").dropDuplicates(["doc_id", "lang"]).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["lang"]))
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


class Labeller:
    """Applies a model in a task and remembers the words it has seen, up to a bound. ``place`` of a word is the row
    of its unit, -1 without one, or -2 - i for the rows in ``several[i]``."""

    def __init__(self, model: Model):
        self.model, self.place, self.several, self.table = model, {}, [], np.zeros((0, len(model.languages)), np.float32)

    def _learn(self, split: list[list[str]]) -> None:
        if max(len(self.place), len(self.table)) > _KNOWN_WORDS:
            self.place, self.several, self.table = {}, [], self.table[:0]
        new = {w: units(w) for w in set().union(*split) - self.place.keys()}
        distinct = {u: i + len(self.table) for i, u in enumerate(dict.fromkeys(u for x in new.values() for u in x))}
        if distinct:
            self.table = np.concatenate([self.table, self.model.emissions(list(distinct))])
        for word, found in new.items():
            if len(found) > 1:
                self.several.append([distinct[u] for u in found])
                self.place[word] = -1 - len(self.several)
            else:
                self.place[word] = distinct[found[0]] if found else -1

    def _rows(self, words: list[str]) -> np.ndarray:
        rows = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        if len(rows) and rows.min() < -1:
            rows = np.array([r for x in rows.tolist() for r in (self.several[-2 - x] if x < -1 else (x,))], np.int64)
        return rows[rows >= 0]

    def posteriors(self, texts: list[str]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
        """Numbers of texts and, for each, the posterior of each of its units; a bounded number of units, or one text,
        at a time. Texts without a unit are left out."""
        split = [t.split() for t in texts]
        self._learn(split)
        rows = [self._rows(split[i]) for i in range(len(split))]
        del split
        order = [i for i in sorted(range(len(rows)), key=lambda i: -len(rows[i])) if len(rows[i])]
        at = 0
        while at < len(order):
            size, end = 0, at
            while end < len(order) and (end == at or size + len(rows[order[end]]) <= _GROUP_WORDS):
                size += len(rows[order[end]])
                end += 1
            group = order[at:end]
            lengths = np.array([len(rows[i]) for i in group])
            found = forward_backward(self.table[np.concatenate([rows[i] for i in group])], lengths, self.model.transitions)
            yield group, np.split(found, np.cumsum(lengths)[:-1])
            at = end

    def documents(self, texts: list[str]) -> list[tuple[str, float]]:
        out = [(UNKNOWN, 0.0)] * len(texts)
        if self.model.languages:
            for group, found in self.posteriors(texts):
                for i, posterior in zip(group, found):
                    share = posterior.sum(axis=0, dtype=np.float64) / len(posterior)
                    best = int(share.argmax())
                    out[i] = self.model.languages[best], min(1.0, float(share[best]))
        return out


def label_words(model: Model, text: str) -> list[tuple[str, str, float]]:
    """(word, language, posterior) of a text's words with a letter, or of the units of those with several."""
    split = [(w, units(w)) for w in text.split()]
    words = [x for w, found in split for x in ([w] if len(found) == 1 else found)]
    found = next((x[0] for _, x in Labeller(model).posteriors([text])), [])
    return [(w, model.languages[int(p.argmax())], float(p.max())) for w, p in zip(words, found)]


def predict_language(docs: DataFrame, model: Model) -> DataFrame:
    """Language of every row of ``docs`` (doc_id, text). One pass, no shuffle."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # size: features x languages of the sample

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for part, texts in text_slices(batches, size=_SLICE_BYTES):
            found = labeller.documents(texts)
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array([x[0] for x in found]), pa.array([x[1] for x in found])],
                ["doc_id", "lang_pred", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(lean(predict), "doc_id long, lang_pred string, score double")


def keep_language(docs: DataFrame, model: Model, least_score: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` whose language is known with at least ``least_score``."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for part, texts in text_slices(batches, size=_SLICE_BYTES):
            found = labeller.documents(texts)
            yield part.filter(pa.array([x != UNKNOWN and s >= least_score for x, s in found], pa.bool_()))

    return docs.mapInArrow(lean(keep), docs.schema)
