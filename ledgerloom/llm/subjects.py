"""Subject areas of documents, from clusters of their sentences.

Sentences are short documents of one matter each, in whatever language; their normalised term vectors are clustered by
bisecting k-means.  Terms weigh by how much they tell about the subject, learnt from labelled documents, so names and
figures of speech weigh nothing.  Every leaf is labelled with the subject its terms and labelled sentences
discriminate, or with none.  A document has the subjects that a large enough part of its mixture of leaves carries.

The clusters are fitted on a bounded sample of labelled documents (``sample_docs``, ``sample_sentences``); all else,
every sentence of every document, is assigned.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.storage import spread

_DEVANAGARI = f"{chr(0x900)}-{chr(0x963)}{chr(0x966)}-{chr(0x97F)}"
WORD = re.compile(f"[A-Za-z]+|[{_DEVANAGARI}]+")
SENTENCE = re.compile(rf"(?<=[.!?{chr(0x964)}])\s+|\n+")
BULLET = re.compile(r"^[-*•\s]+")


@dataclass(frozen=True)
class Mix:
    """A subject is assigned from ``share`` of the sentences on, ``most`` a document at most.

    A leaf's label is what its ``leaf_terms`` most discriminative terms tell, to the power ``terms_say``, times what the labels of its
    sentences say; it has none if no subject has the part ``sure`` of that.
    """

    share: float = 0.25
    most: int = 2
    sample_docs: int = 6000
    sample_sentences: int = 16_384
    terms: int = 1024
    leaves: int = 320
    rounds: int = 2
    unlabelled: float = 0.1
    leaf_terms: int = 8
    terms_say: float = 0.25
    sure: float = 0.6


def sentences(text: str | None) -> list[str]:
    """Sentences of a text, without bullets; a line end ends a sentence.

    >>> sentences("- One of 4.5. Two!\\nthree")
    ['One of 4.5.', 'Two!', 'three']
    """
    if not text:
        return []
    parts = (BULLET.sub("", s) for s in SENTENCE.split(text))
    return [s for s in parts if WORD.search(s)]


def terms(sentence: str) -> list[str]:
    """Words in lower case, without capitalised ones that aren't the first: names and dates."""
    out = [w.lower() if not i else w for i, w in enumerate(WORD.findall(sentence)) if not i or not w[0].isupper()]
    return [w for w in out if len(w) > 1]


@dataclass
class Model:
    """``scores`` (term x leaf): weight of the term times the leaf's centre; ``label`` the subject of each leaf, -1 for none;
    ``prior`` the subject that most of the sample is about; ``discriminative`` the terms that labelled each leaf."""

    vocabulary: dict[str, int]
    weights: np.ndarray
    scores: np.ndarray
    label: np.ndarray
    subjects: list[str]
    discriminative: list[list[str]] = field(default_factory=list)
    prior: int = 0

    def assign(self, texts: list[str]) -> np.ndarray:
        """Subject of each sentence, -1 for none."""
        ids = [[v for t in terms(s) if (v := self.vocabulary.get(t)) is not None] for s in texts]
        count = np.array([len(x) for x in ids], np.int64)
        out = np.full(len(texts), -1)
        on = np.flatnonzero(count)
        if len(on) and len(self.label):
            for a in range(0, len(on), 2000):  # scores are as wide as there are leaves
                part = on[a : a + 2000]
                flat = np.array([v for i in part for v in ids[i]])
                starts = np.cumsum(count[part]) - count[part]
                out[part] = self.label[np.add.reduceat(self.scores[flat], starts, axis=0).argmax(1)]
        return out


    def nearest(self, texts: list[str]) -> int:
        """The subject of the labelled leaf that the sentences together are nearest to; -1 if no leaf has a term of theirs."""
        ids = [v for s in texts for t in terms(s) if (v := self.vocabulary.get(t)) is not None]
        on = np.flatnonzero(self.label >= 0)
        if not ids or not len(on):
            return -1
        near = self.scores[ids].sum(0)[on]
        return int(self.label[on[near.argmax()]]) if near.max() > 0 else -1


def bisect(x: np.ndarray, leaves: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Leaf of each row: the cluster with the largest spread is split in two until there are enough or none spreads."""
    leaf = np.zeros(len(x), int)
    spread = {0: float(len(x) - np.linalg.norm(x.sum(0)) ** 2 / max(len(x), 1))}
    while len(spread) < leaves:
        big = max(spread, key=spread.get)
        if spread[big] < 1.0:
            break
        at = np.flatnonzero(leaf == big)
        y = x[at]
        a = y[rng.integers(len(y))]
        a = y[(y @ a).argmin()]
        c = np.stack([a, y[(y @ a).argmin()]])
        for _ in range(rounds):
            side = (y @ c.T).argmax(1)
            if side.min() == side.max():
                break
            c = np.stack([y[side == k].sum(0) for k in (0, 1)])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        if side.min() == side.max():
            spread[big] = 0.0
            continue
        new = len(spread)
        leaf[at[side == 1]] = new
        for k, cl in ((0, big), (1, new)):
            part = y[side == k]
            spread[cl] = float(len(part) - np.linalg.norm(part.sum(0)) ** 2 / len(part))
    return leaf


def fit(labelled: list[tuple[str, list[str]]], described: list[tuple[str, str]], mix: Mix = Mix()) -> Model:
    """``labelled`` (text, its subjects) and ``described`` (subject, description) documents to a model."""
    names = sorted({s for s, _ in described} | {s for _, ss in labelled for s in ss})
    index = {s: i for i, s in enumerate(names)}
    rng = np.random.default_rng(7)
    rows, soft = [], []
    for text, subjects in labelled:
        for s in sentences(text):
            rows.append(terms(s))
            soft.append(np.bincount([index[x] for x in subjects], minlength=len(names)) / len(subjects))
    if len(rows) > mix.sample_sentences:
        pick = rng.permutation(len(rows))[: mix.sample_sentences]
        rows, soft = [rows[i] for i in pick], [soft[i] for i in pick]
    for s, text in described:  # a description stands for a sentence of its subject
        rows.append(terms((text or "").lower()))
        soft.append(np.eye(len(names))[index[s]])
    if not names:
        return Model({}, np.zeros(0), np.zeros((0, 0)), np.zeros(0, int), [])
    given = soft = np.array(soft)
    for _ in range(mix.rounds):
        prior = np.maximum(soft.sum(0), 1e-9) / soft.sum()
        about = defaultdict(lambda: np.zeros(len(names)))
        seen = Counter()
        for r, p in zip(rows, soft, strict=True):
            for t in set(r):
                about[t] += p
                seen[t] += 1
        smooth = 4.0
        weight, telling = {}, {}
        for t, c in about.items():
            # a term in sentences of no subject counts against it
            p = (c + smooth * prior) / (c.sum() + smooth)
            weight[t] = float((p * np.log(p / prior)).sum()) * (c.sum() + smooth) / (seen[t] + smooth)
            telling[t] = p / prior
        best = sorted(weight, key=lambda t: (-weight[t] * np.log1p(seen[t]), t))[: mix.terms]
        vocabulary = {t: i for i, t in enumerate(sorted(best))}
        w = np.zeros(len(vocabulary), np.float32)
        for t, i in vocabulary.items():
            w[i] = weight[t]
        x = np.zeros((len(rows), len(vocabulary)), np.float32)
        for i, r in enumerate(rows):
            for t in r:
                if (v := vocabulary.get(t)) is not None:
                    x[i, v] += w[v]
        norm = np.linalg.norm(x, axis=1)
        on = norm > 1e-9
        x[on] /= norm[on, None]
        leaf = np.full(len(rows), -1)
        leaf[on] = bisect(x[on], mix.leaves, rng)
        n = int(leaf.max(initial=-1)) + 1
        centre = np.zeros((n, len(vocabulary)), np.float32)
        np.add.at(centre, leaf[on], x[on])
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)
        # the terms that tell a leaf from the others, and what they tell about
        rise = centre * np.log1p(centre / np.maximum(centre.sum(0, keepdims=True) / max(n, 1), 1e-9))
        top = np.argsort(-rise, axis=1, kind="stable")[:, : mix.leaf_terms]
        tells = np.array([telling[t] for t in sorted(vocabulary, key=vocabulary.get)]).reshape(-1, len(names))
        by_terms = np.einsum("nk,nks->ns", np.take_along_axis(rise, top, 1), tells[top]) if n else np.zeros((0, len(names)))
        by_terms /= np.maximum(by_terms.sum(1, keepdims=True), 1e-9)
        # and what the labels of its sentences say: the two together make the label
        votes = np.zeros((n, len(names)))
        np.add.at(votes, leaf[on], soft[on])
        lift = by_terms**mix.terms_say * (votes + 0.5 * prior) / prior
        lift /= np.maximum(lift.sum(1, keepdims=True), 1e-9)
        label = np.where(lift.max(1, initial=0) >= mix.sure, lift.argmax(1) if n else 0, -1) if n else np.zeros(0, int)
        # a sentence is about what its leaf says, weighed by what its document's labels allow: a label may be wrong or missing
        belief = np.zeros_like(soft)
        at = np.flatnonzero(np.append(label, -1)[leaf] >= 0)  # leaf -1: no term known
        belief[at] = lift[leaf[at]] * (given[at] + mix.unlabelled)
        belief[at] /= belief[at].sum(1, keepdims=True)
        soft = belief
        if soft.sum() == 0:
            break
    words = sorted(vocabulary, key=vocabulary.get)
    common = given[: len(given) - len(described)].sum(0) if len(given) > len(described) else given.sum(0)
    return Model(vocabulary, w, w[:, None] * centre.T, label, names, [[words[j] for j in row] for row in top], int(common.argmax()))


def train(docs: DataFrame, labels: DataFrame, subjects: DataFrame, mix: Mix = Mix()) -> Model:
    """A model from at most ``sample_docs`` labelled documents, those first by the hash of their key.

    Null subjects, labels of unknown documents and repeated rows count for nothing; no labels leave the descriptions.
    """
    known = [(r.subject, r.description) for r in subjects.where("subject is not null").distinct().collect()]
    names = [s for s, _ in known]
    given = labels.where(F.col("subject").isin(names) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    chosen = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(mix.sample_docs)
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "text", "subjects").toPandas().sort_values("doc_id", kind="stable")
    return fit([(t, sorted(s)) for t, s in zip(rows["text"], rows["subjects"], strict=True)], sorted(known), mix)


def mixtures(docs: DataFrame, model: Model, doc_key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, subject, n_about, n_sentences) of every subject that a sentence of the document is about; subject null: none of them.

    Null and empty texts give no rows; a text without sentences gives its row with no subject.
    """
    key = docs.schema[doc_key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        names = [*m.subjects, None]
        for b in batches:
            parts = [sentences(t) for t in b["body"]]
            count = np.array([len(p) for p in parts], np.int64)
            about = m.assign([s for p in parts for s in p])
            owner = np.repeat(np.arange(len(b)), count)
            about = np.where(about < 0, len(names) - 1, about)
            n = np.bincount(owner * len(names) + about, minlength=len(b) * len(names)).reshape(len(b), len(names))
            n[count == 0, -1] = 1
            r, c = np.nonzero(n)
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy()[r], "subject": [names[i] for i in c], "n_about": n[r, c].astype("int32"), "n_sentences": np.maximum(count, 1)[r].astype("int32")})

    rows = docs.where(F.col(doc_key).isNotNull() & (F.col(text) != "")).select(F.col(doc_key).alias("doc_id"), F.col(text).alias("body"))
    return spread(rows).mapInPandas(run, f"doc_id {key}, subject string, n_about int, n_sentences int")


def subjects_of(docs: DataFrame, model: Model, mix: Mix = Mix(), doc_key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, subject, share, known): the subjects of each document, the largest shares first, ties by name.

    Every text that is neither null nor empty gets one at least.  If no sentence is about any, that is the subject of the
    labelled leaf that the text as a whole is nearest to, or, if it has no known term, the one most common in the sample; its
    share is 0 and it isn't ``known``.  The choice is made where the document is read, so nothing is shuffled.
    """
    key = docs.schema[doc_key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        k = len(m.subjects)
        for b in batches:
            parts = [sentences(t) for t in b["body"]]
            count = np.array([len(p) for p in parts], np.int64)
            about = m.assign([s for p in parts for s in p])
            owner = np.repeat(np.arange(len(b)), count)
            n = np.bincount((owner * k + about)[about >= 0], minlength=len(b) * k).reshape(len(b), k)
            share = n / np.maximum(count, 1)[:, None]
            order = np.argsort(-share, axis=1, kind="stable")[:, : mix.most]
            top = np.take_along_axis(share, order, 1)
            on = top >= mix.share - 1e-9
            on[:, 0] = True
            known = n.any(1)
            for i in np.flatnonzero(~known):
                near = m.nearest(parts[i])
                order[i, 0] = near if near >= 0 else m.prior
                on[i, 1:] = False
            r, c = np.nonzero(on)
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy()[r], "subject": [m.subjects[i] for i in order[r, c]], "share": top[r, c], "known": known[r]})

    rows = docs.where(F.col(doc_key).isNotNull() & (F.col(text) != "")).select(F.col(doc_key).alias("doc_id"), F.col(text).alias("body"))
    if not model.subjects:
        return rows.select("doc_id", F.lit(None).cast("string").alias("subject"), F.lit(0.0).alias("share"), F.lit(False).alias("known")).limit(0)
    return spread(rows).mapInPandas(run, f"doc_id {key}, subject string, share double, known boolean")
