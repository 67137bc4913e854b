"""Toxicity (operator 9): a factorization machine over hashed terms.

``score(d) = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)`` over the set of hashed
terms of a document.  The pairwise part learns interactions that additive weights miss, such as
an insult with a group mention: two terms that are harmless alone push the score only together.

Terms are the lower-case words and, since insults are inflected, the first four to six letters of
longer words; a term that a document holds more than once gives a second term, since a stem that
clean texts have by chance is telling when it comes again.  Only ``n_terms`` informative terms (by labelled document frequency) keep weights,
so long documents do not add up noise.  Training is one task on an executor over at most ``max_rows``
labelled rows, of which only hashed term ids are shuffled; the driver gets the model, whose size is
fixed by ``n_terms`` and ``rank``, and scoring is one narrow Arrow pass with the model broadcast.

Defined cases: null or empty text has no terms and gets the bias score; with no labelled rows, or
rows of one class only, every score is the prior of the rows (0 if there are none).
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, slices, text_bytes, tidy

_WORD = re.compile(rb"[a-z\x80-\xff]+")


@dataclass(frozen=True)
class FMParams:
    #: Most labelled rows that are fitted (a documented bound; chosen by a hash of the id).
    max_rows: int = 8_192
    #: Most bytes of their term ids that the training task takes.
    max_bytes: int = 64 << 20
    #: Hash space of the terms.
    bits: int = 23
    #: Most terms with weights, and how many keep them even if chance could explain them.
    n_terms: int = 4_096
    least_terms: int = 16
    rank: int = 4
    epochs: int = 200
    rate: float = 0.1
    #: Share of a document's terms that an epoch sees.
    keep: float = 0.8
    l2: float = 1e-4
    threshold: float = 0.7
    seed: int = 7


@dataclass(frozen=True)
class FMModel:
    terms: np.ndarray  # sorted term ids
    w0: float
    w: np.ndarray
    v: np.ndarray

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        """docs: sorted unique positions in ``terms`` of each document."""
        n = np.array([len(d) for d in docs], np.int64)
        if not n.sum() or not len(self.terms):
            return np.full(len(docs), _sigmoid(np.float64(self.w0)))
        ids, row = np.concatenate(docs), np.repeat(np.arange(len(docs)), n)
        return _sigmoid(_margin(self.w0, self.w, self.v, ids, row, len(docs)))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _g2(a, pos, b, neg):
    """Likelihood ratio statistic of a term in a of pos and b of neg documents; a fifth of it if the term is rarer in pos."""
    share = (a + b) / (pos + neg)

    def part(k, n, p):
        return np.where(k > 0, k * np.log(np.maximum(k, 1e-9) / np.maximum(n * p, 1e-9)), 0)

    g = 2 * (part(a, pos, share) + part(pos - a, pos, 1 - share) + part(b, neg, share) + part(neg - b, neg, 1 - share))
    return np.where(a / pos > b / neg, g, 0.2 * g)


def _margin(w0, w, v, ids, row, n):
    z = w0 + np.bincount(row, w[ids], n)
    for f in range(v.shape[1]):
        a = v[ids, f]
        z = z + 0.5 * (np.bincount(row, a, n) ** 2 - np.bincount(row, a * a, n))
    return z


class Terms(dict):
    """Hashed terms of a lower-case word (a bounded memo).

    Terms from ``1 << bits`` on stand for those below that a document holds at least twice."""

    def __init__(self, bits: int, keep: np.ndarray | None = None, limit: int = 120_000):
        self.size, self.limit = 1 << bits, limit
        self.keep = None if keep is None else {int(k): i for i, k in enumerate(keep)}

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        text = word.decode("utf-8", "ignore")
        names = ["=" + text, *("^" + text[:n] for n in (4, 5, 6) if len(text) > n)]
        got = tuple(zlib.crc32(x.encode()) & (self.size - 1) for x in names)
        if self.keep is not None:
            got = tuple(x for x in got if x in self.keep or x + self.size in self.keep)
        if len(self) < self.limit:
            self[word] = got
        return got

    def of(self, text: bytes) -> np.ndarray:
        count: dict[int, int] = {}
        for word, n in Counter(_WORD.findall(text.decode("utf-8", "ignore").lower().encode())).items():
            for t in self[word]:
                count[t] = count.get(t, 0) + n
        found = [*count, *(t + self.size for t, n in count.items() if n > 1)]
        if self.keep is not None:
            found = [self.keep[t] for t in found if t in self.keep]
        return np.array(sorted(found), np.int64)


def fit(labelled: DataFrame, params: FMParams = FMParams(), *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label") -> FMModel:
    """Fit on (id, text, label) rows: the ``params.max_rows`` of them with the least id hashes.

    Only sorted 4-byte term ids travel to the task that trains, not texts, and of the rows as many
    as ``params.max_bytes`` hold; nothing but the model reaches the driver."""
    rows = pick(labelled, i=id_col, t=text_col, y=label_col).filter("y is not null").withColumn("h", F.xxhash64("i"))
    bits = params.bits

    def hashed(batches):
        terms = Terms(bits)
        for b in batches:
            texts = text_bytes(b.column(2))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), b.column(1).cast(pa.int32()), pa.array([terms.of(t).astype("<i4").tobytes() for t in texts], pa.binary())],
                ["h", "y", "terms"],
            )

    def bounded(batches):  # one task has the rows in order
        room = params.max_bytes
        for b in batches:
            sizes = np.cumsum(np.asarray(pc.binary_length(b.column(2))).astype(np.int64))
            n = int(np.searchsorted(sizes, room, "right"))
            yield b.slice(0, n)
            if n < b.num_rows:
                return
            room -= int(sizes[-1]) if n else 0

    def trained(batches):
        docs, y = [], []
        for b in bounded(batches):
            docs += [np.frombuffer(t, "<i4") for t in b.column(2).to_pylist()]
            y += [float(label > 0) for label in b.column(1).to_pylist()]
        m = train(docs, np.array(y), params)
        yield pa.RecordBatch.from_pydict({"terms": [m.terms.tobytes()], "w0": [m.w0], "w": [m.w.tobytes()], "v": [m.v.tobytes()]})

    hashes = rows.select("h", F.col("y").cast("int").alias("y"), "t").mapInArrow(tidy(hashed), "h long, y int, terms binary")
    got = hashes.orderBy("h", "y", "terms").limit(params.max_rows).mapInArrow(tidy(trained), "terms binary, w0 double, w binary, v binary").collect()
    if not got:  # no rows and no task
        return train([], np.zeros(0), params)
    m = got[0]
    return FMModel(np.frombuffer(m.terms, np.int64), m.w0, np.frombuffer(m.w), np.frombuffer(m.v).reshape(-1, params.rank))


def train(docs: list[np.ndarray], y: np.ndarray, params: FMParams = FMParams()) -> FMModel:
    """AdaGrad over the logistic loss, full batches, deterministic; docs: sorted unique term ids of each."""
    none = FMModel(np.zeros(0, np.int64), -35.0, np.zeros(0), np.zeros((0, params.rank)))
    if not len(y) or y.min() == y.max():
        return none if not len(y) or y.max() == 0 else FMModel(none.terms, 35.0, none.w, none.v)
    pos, neg = y.sum(), len(y) - y.sum()
    # informative terms: likelihood ratio (G squared) of term presence against the label, beyond
    # what the strongest of so many unrelated terms would reach by chance
    def held(of):  # a document holds a term once
        return np.unique(np.concatenate([np.zeros(0, np.int32), *of]), return_counts=True)

    # counted by ranges of the ids, so that what is sorted at once is a small part of them
    cuts = np.linspace(0, 1 + max((int(d[-1]) for d in docs if len(d)), default=0), 17).astype(np.int64)
    at = [np.searchsorted(d, cuts) for d in docs]
    parts, distinct = [], 0
    for k in range(len(cuts) - 1):
        here = [d[a[k] : a[k + 1]] for d, a in zip(docs, at)]
        found, n = held(here)
        some, m = held([d for d, label in zip(here, y) if label])
        toxic = np.zeros(len(found), np.int64)
        toxic[np.searchsorted(found, some)] = m
        distinct += len(found)
        found, n, toxic = (x[n >= 2] for x in (found, n, toxic))
        worth = _g2(toxic.astype(float), pos, (n - toxic).astype(float), neg)
        best = np.sort(np.argsort(-worth, kind="stable")[: params.n_terms])
        parts.append((found[best], worth[best]))
    chance = 2 * math.log(max(2, distinct))
    found, worth = (np.concatenate(x) for x in zip(*parts))
    best = np.argsort(-worth, kind="stable")[: params.n_terms]
    best = best[(worth[best] > 0) & ((worth[best] >= chance) | (np.arange(len(best)) < params.least_terms))]
    terms = np.sort(found[best]).astype(np.int64)
    del here, at
    kept = []
    for d in docs:
        at = np.searchsorted(terms, d)
        at[at == len(terms)] = 0
        kept.append(d[terms[at] == d] if len(terms) else d[:0])
    row = np.repeat(np.arange(len(docs)), [len(d) for d in kept])
    ids = np.searchsorted(terms, np.concatenate(kept))
    rng = np.random.default_rng(params.seed)
    w0, w, v = math.log(pos / neg), np.zeros(len(terms)), rng.normal(0, 0.01, (len(terms), params.rank))
    g0, gw, gv = 1e-8, np.full(len(terms), 1e-8), np.full(v.shape, 1e-8)
    every = ids, row
    for _ in range(params.epochs):
        # part of each document's terms, so that one insult alone has to tell as well
        ids, row = (x[kept] for kept in [rng.random(len(every[0])) < params.keep] for x in every)
        sums = np.stack([np.bincount(row, v[ids, f], len(y)) for f in range(params.rank)], 1)
        r = (_sigmoid(_margin(w0, w, v, ids, row, len(y))) - y) / len(y)
        d0, dw = r.sum(), np.bincount(ids, r[row], len(terms)) + params.l2 * w / len(y)
        g0 += d0 * d0
        gw += dw * dw
        w0 -= params.rate * 4 * d0 / math.sqrt(g0)
        for f in range(params.rank):
            dv = np.bincount(ids, r[row] * (sums[row, f] - v[ids, f]), len(terms)) + params.l2 * v[:, f] / len(y)
            gv[:, f] += dv * dv
            v[:, f] -= params.rate * dv / np.sqrt(gv[:, f])
        w -= params.rate * dw / np.sqrt(gw)
    return FMModel(terms, float(w0), w, v)


def score(docs: DataFrame, model: FMModel, params: FMParams = FMParams(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``; whole texts, no shuffle."""
    held = F.pmod(F.crc32(F.coalesce(df_str(docs[id_col]), F.lit("")).cast("binary")), F.lit(3)) == 1
    rows = docs.select(docs[id_col].alias("doc_id"), held.alias("held_out"), docs[text_col].alias("text"))
    sent, bits, threshold = rows.sparkSession.sparkContext.broadcast(model), params.bits, params.threshold

    def scored(batches):
        m = sent.value
        terms = Terms(bits, m.terms)
        for whole in batches:
            for b in slices(whole, "text"):
                s = m.scores([terms.of(t) for t in text_bytes(b.column(2))])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(tidy(scored), f"doc_id {kind}, held_out boolean, score double, predicted int")


def df_str(column):
    return column.cast("string")


def labelled_rows(docs: DataFrame, labels: DataFrame, params: FMParams = FMParams(), *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Training rows: documents with a label whose crc32(id as text) mod 3 is not 1.

    Of those, the ``params.max_rows`` ids with the least hashes: that many rows of 16 bytes are
    broadcast, so that no text is shuffled.  Labels of absent documents don't count.  A document
    labelled twice has its largest label."""
    y = pick(labels, i=id_col, y=label_col).filter("i is not null and y is not null")
    y = y.filter(F.pmod(F.crc32(F.col("i").cast("string").cast("binary")), F.lit(3)) != 1).groupBy("i").agg(F.max("y").alias("label"))
    y = y.join(pick(docs, there=id_col), F.col("i") == F.col("there"), "left_semi")
    # far fewer than all labels reach the driver: those whose hash could be among the least
    share = min(1.0, 1.2 * params.max_rows / max(1, y.count()))
    y = y.filter(F.pmod(F.xxhash64("i"), F.lit(1 << 20)) < int(share * (1 << 20)))
    y = y.orderBy(F.pmod(F.xxhash64("i"), F.lit(1 << 20)), "i").limit(params.max_rows)
    return pick(docs, doc_id=id_col, text=text_col).join(F.broadcast(y), F.col("doc_id") == F.col("i")).select("doc_id", "text", "label")


def toxicity(docs: DataFrame, labels: DataFrame, params: FMParams = FMParams()) -> DataFrame:
    """Fit on the labelled rows outside the held-out third, then score every document."""
    return score(docs, fit(labelled_rows(docs, labels, params), params), params)


def drop_toxic(docs: DataFrame, labels: DataFrame, params: FMParams = FMParams()) -> DataFrame:
    """The rows of ``docs`` (same columns) that the model does not reject."""
    model = fit(labelled_rows(docs, labels, params), params)
    sent, bits, threshold = docs.sparkSession.sparkContext.broadcast(model), params.bits, params.threshold

    def kept(batches):
        m = sent.value
        terms = Terms(bits, m.terms)
        for whole in batches:
            for b in slices(whole, "text"):
                s = m.scores([terms.of(t) for t in text_bytes(b.column(b.schema.get_field_index("text")))])
                yield b.filter(pa.array(s < threshold))

    return docs.mapInArrow(tidy(kept), docs.schema)
