"""Toxicity by multiple-instance learning.

A text is a bag of sentences. Each sentence has a score, the logistic function of the sum of its words' weights and a
bias; a text's score is their noisy-or, 1 - prod(1 - sentence score). Only texts have labels, so the weights are fitted
through the noisy-or; sentences of a high score are then the offending ones. A word's weight is the sum of the
weights of the word and of its beginnings of 3 to 6 letters, which lets inflected forms share what is learned.

The fit uses a bounded sample of labelled rows on the driver: max_docs rows and max_chars characters, drawn by a hash of
the id, and of a text of more than max_text_chars only a slice at a place that the hash names. Scoring is an Arrow
function over all whole texts. Null and empty texts have no sentence and so score 0. Repeated rows score alike; nothing
depends on the order of rows. Empty tables give no rows; without labels, or with one label only, all score alike.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolytics.llm.common import Memo, byte_blocks, give_back, held_out, resident

SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*|[.!?\n]+")
_TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]+")
_ENDS = frozenset(".!?\n")
_PREFIXES, _SAMPLE_SPACE, BLOCK_CHARS = range(3, 7), 1 << 20, 1 << 20
_HASHES, _DOC_BLOCK = 1 << 22, 256


def word_features(word: str) -> list[str]:
    return [f"={word}", *(word[:n] for n in _PREFIXES if len(word) >= n)]


@dataclass
class Model:
    bias: float = -math.inf
    weights: dict[str, float] = field(default_factory=dict)
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def word(self, word: str) -> float:
        """A word's weight; NaN for the end of a sentence."""
        if word[0] in _ENDS:
            return math.nan
        return sum(self.weights.get(f, 0.0) for f in word_features(word))

    def sentence_logits(self, texts: list[str], memo: Memo) -> tuple[np.ndarray, np.ndarray]:
        """Logits of all sentences with words, and for each the index of its text."""
        values, sizes = [], []
        get = memo.__getitem__
        for t in texts:
            words = _TOKEN.findall(t.lower())
            words.append("\n")
            values.extend(map(get, words))
            sizes.append(len(words))
        v = np.array(values)
        ends = np.isnan(v)
        v[ends] = 0
        first = np.flatnonzero(np.r_[True, ends[:-1]])
        n_words = np.diff(np.r_[first, len(v)]) - 1
        keep = n_words > 0
        owner = np.repeat(np.arange(len(texts)), sizes)[first]
        return (np.add.reduceat(v, first) + self.bias)[keep], owner[keep]

    def scores(self, texts: list[str], memo: Memo) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        z, owner = self.sentence_logits(texts, memo)
        return -np.expm1(-np.bincount(owner, np.logaddexp(0, z), len(texts)))


def _telling(y: np.ndarray, n: np.ndarray, pos: np.ndarray, min_docs: int = 4, min_z: float = 5.0) -> np.ndarray:
    """Features that stand in toxic texts more often than chance explains: n texts have one, pos of them toxic."""
    base = y.mean()
    z = (pos - n * base) / np.sqrt(np.maximum(n, 1) * base * (1 - base))
    return (pos >= min_docs) & (z >= min_z)


def _feature_counts(y: np.ndarray, doc: np.ndarray, tok: np.ndarray, flat: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts and toxic texts that have a feature of each hash, over blocks of texts."""
    n, pos = np.zeros(_HASHES, np.int64), np.zeros(_HASHES)
    cuts = np.searchsorted(doc, np.arange(0, len(y) + _DOC_BLOCK, _DOC_BLOCK))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        pair = np.unique(doc[a:b].astype(np.int64) << 32 | tok[a:b])
        word = pair & 0xFFFFFFFF
        size = first[word + 1] - first[word]
        at = np.repeat(first[word] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        both = np.unique(np.repeat(pair >> 32, size) << 32 | flat[at])
        n += np.bincount(both & 0xFFFFFFFF, minlength=_HASHES)
        pos += np.bincount(both & 0xFFFFFFFF, y[both >> 32], _HASHES)
    return n, pos


def _hash(feature: str) -> int:
    return zlib.crc32(feature.encode()) % _HASHES


def fit(texts: list[str], labels: list[int], rounds: int = 250, rate: float = 0.2, sparse: float = 3e-5) -> Model:
    """Weights, none below 0, that make the noisy-or of the sentences likeliest, by Adam with an L1 penalty.

    Only features that are telling by a test on the labels get a weight; the test counts features by hash, in a table of
    fixed size, and all features of a telling hash are fitted. All other words weigh 0.
    """
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return Model(bias=-math.inf if not len(y) or y.max() == 0 else 0.0)
    words: dict[str, int] = {}
    tokens, sentence, owner = array("i"), array("i"), array("i")
    for d, t in enumerate(texts):
        inside = False
        for w in _TOKEN.findall(t.lower()):
            if w[0] in _ENDS:
                inside = False
                continue
            if not inside:
                owner.append(d)
                inside = True
            tokens.append(words.setdefault(w, len(words)))
            sentence.append(len(owner) - 1)
    if not owner:
        return Model(bias=math.log(y.mean() / (1 - y.mean())))
    tok, sen, own = np.frombuffer(tokens, np.int32), np.frombuffer(sentence, np.int32), np.frombuffer(owner, np.int32)
    hashes, sizes = array("i"), array("i")
    for w in words:
        found = word_features(w)
        hashes.extend(map(_hash, found))
        sizes.append(len(found))
    flat, first = np.frombuffer(hashes, np.int32), np.r_[0, np.cumsum(sizes)]
    telling = _telling(y, *_feature_counts(y, own[sen], tok, flat, first))
    maybe = np.zeros(len(words), bool)
    maybe[np.repeat(np.arange(len(words)), sizes)[telling[flat]]] = True
    features: dict[str, int] = {}
    pairs = [(i, features.setdefault(f, len(features))) for (w, i), m in zip(words.items(), maybe.tolist(), strict=True) if m for f in word_features(w) if telling[_hash(f)]]
    pw, pf = np.array(pairs, np.int64).reshape(-1, 2).T
    chosen, active = list(features), maybe
    tok, sen = tok[active[tok]], sen[active[tok]]
    live, sen = np.unique(sen, return_inverse=True)  # the other sentences have the bias alone
    own_live, silent = own[live], np.bincount(own, minlength=len(y)) - np.bincount(own[live], minlength=len(y))
    theta, bias = np.zeros(len(chosen)), math.log(y.sum() / len(own))
    m, v, mb, vb = np.zeros_like(theta), np.zeros_like(theta), 0.0, 0.0
    for step in range(1, rounds + 1):
        z = bias + np.bincount(sen, np.bincount(pw, theta[pf], len(words))[tok], len(live))
        total = np.bincount(own_live, np.logaddexp(0, z), len(y)) + silent * np.logaddexp(0, bias)
        pull = np.where(y > 0, -1 / np.expm1(np.clip(total, 1e-9, 50)), 1.0) / len(y)
        g = pull[own_live] / (1 + np.exp(-np.clip(z, -50, 50)))
        gb = g.sum() + (pull * silent).sum() / (1 + math.exp(-bias))
        grad = np.bincount(pf, np.bincount(tok, g[sen], len(words))[pw], len(theta)) + sparse
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        a, b, r = 1 - 0.9**step, 1 - 0.999**step, rate * (1 - 0.9 * step / rounds)
        theta = np.maximum(0, theta - r * (m / a) / (np.sqrt(v / b) + 1e-6))
        bias -= r * (mb / a) / (math.sqrt(vb / b) + 1e-6)
    return Model(float(bias), {f: float(w) for f, w in zip(chosen, theta, strict=True) if w > 1e-2})


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = 6000, max_chars: int = 16_000_000,
    max_text_chars: int = 200_000, **how,
) -> Model:
    """Fit on about max_docs rows and max_chars characters at most, drawn at one rate by a hash of the id.

    Rows with a null text or a label other than 0 and 1 aren't used. Lengths are counted before labels are joined, and
    rows are drawn before texts are, so that no join moves more texts than the sample has.
    """
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"))
    lengths = texts.select("_doc", F.least(F.length("_text"), F.lit(max_text_chars)).alias("_chars")).join(known, F.col("_doc") == F.col("_id"))
    found = {int(r[0]): (r[1], r[2] or 1) for r in lengths.groupBy("_label").agg(F.count("*"), F.sum("_chars")).collect()}
    if not found:
        return Model()
    rate = min(1.0, max_docs / sum(n for n, _ in found.values()), max_chars / sum(c for _, c in found.values()))
    drawn = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(_SAMPLE_SPACE))
    limit = math.ceil(_SAMPLE_SPACE * rate)
    rows = texts.where(drawn("_doc") < limit).join(known, F.col("_doc") == F.col("_id"))
    room = F.greatest(F.length("_text") - max_text_chars, F.lit(0)) + 1
    part = F.substring(F.col("_text"), (F.pmod(F.xxhash64("_doc"), room) + 1).cast("int"), F.lit(max_text_chars))
    sample = sorted(rows.select(drawn("_doc"), "_doc", "_label", part).collect(), key=lambda r: (r[0], str(r[1]), r[2], r[3]))
    return fit([r[3] for r in sample], [r[2] for r in sample], **how)


def toxicity(text: Column, model: Model) -> Column:
    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo = resident(("toxicity", model.key), lambda: Memo(model.word))
        for texts in batches:
            yield pa.array([x for block in byte_blocks(texts.to_pylist(), BLOCK_CHARS) for x in model.scores(block, memo).tolist()], pa.float64())
        give_back()

    return score(text)


def offending(text: Column, model: Model, at_least: float = 0.3) -> Column:
    """Column of array<struct(start, end, score)>: sentences whose own score is at least at_least, in code points."""

    @F.arrow_udf("array<struct<start:int,end:int,score:double>>")
    def locate(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo, kind = Memo(model.word), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for texts in batches:
            out = []
            for t in texts.to_pylist():
                spans = [(m.start(), m.end()) for m in SENTENCE.finditer(t or "")]
                scores = model.scores([t[a:b] for a, b in spans], memo).tolist()
                out.append([{"start": a, "end": b, "score": s} for (a, b), s in zip(spans, scores, strict=True) if s >= at_least])
            yield pa.array(out, kind)

    return locate(text)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3, **how) -> DataFrame:
    """docs with held_out, score and predicted (1 if score >= threshold), which replace columns of these names.

    Learns from rows of docs that aren't held out and have a label. Where an id has several labels, each row counts.
    """
    model = learn(docs.where(~held_out(id_col)), labels, id_col, text_col, label_col, **how)
    out = docs.withColumns({"held_out": held_out(id_col), "score": toxicity(F.col(text_col), model)})
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
