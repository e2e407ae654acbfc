"""Toxic spans by a linear-chain conditional random field, and document scores.

Documents are labelled, tokens are not, so token labels come first: a word is a cue if
it occurs in significantly more toxic than clean documents of a bounded training sample (log-likelihood
ratio at a level corrected for the number of words, and more often in toxic ones than
not); it counts once for each pair of neighbours it has, so copies of a text add
nothing.  Cue words in toxic documents are labelled toxic, all other words clean.  The
field (states clean and toxic; features: the word and its first 4 and 6 bytes, hashed)
is fitted to segments of labelled words by gradient ascent.

Texts are tagged whole.  Forward and backward messages of all texts of a batch are one
prefix product of 2 x 2 matrices, where the first word of a text forgets what was before.
Words whose marginal reaches 1/2 form spans; a document's score is the noisy-or of its
spans' highest marginals, or its highest marginal if it has no span.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import ALNUM, chunks, flat_text, mix64, prefix_sums, stage, with_fields, word_bounds, word_hashes

#: hashed features; words of a training segment; bounds on the training sample: labelled
#: documents of each label, and of their segments those with and without a toxic word
#: (each time those of smallest hash); bound on the lexicon that labels tokens
FEATURES, SEGMENT, DOCS, SAMPLE, CUES = 1 << 18, 64, 5000, 4000, 1 << 16
#: level of the cue test, divided by the number of words
LEVEL = 0.01
ROUNDS, RATE, RIDGE = 120, 0.3, 1e-5
PREFIXES = (4, 6)
#: log odds of the toxic state before anything is learned
RARE = -4.0
_SALTS = (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
SPANS = "array<struct<start:int,end:int,p:double>>"


class _Words:
    """Words of some texts: hashes of the words and their prefixes, byte bounds, offsets of each text's words."""

    def __init__(self, column: pa.Array):
        self.flat, self.bytes = flat_text(column)
        self.starts, self.ends, self.offs = word_bounds(self.flat, self.bytes, ALNUM)
        self.sums = prefix_sums(self.flat)
        self.hashes = word_hashes(self.flat, self.starts, self.ends, self.sums)
        self.text = np.repeat(np.arange(len(self.offs) - 1), np.diff(self.offs))

    def features(self) -> np.ndarray:
        """(3, n) feature numbers: of each word, and of its first 4 and 6 bytes."""
        parts = [self.hashes, *(word_hashes(self.flat, self.starts, np.minimum(self.starts + k, self.ends), self.sums) for k in PREFIXES)]
        return np.stack([(mix64(w ^ np.uint64(salt)) & np.uint64(FEATURES - 1)).astype(np.int64) for w, salt in zip(parts, _SALTS)])


def _products(m: np.ndarray) -> np.ndarray:
    """First rows of the prefix products of 2 x 2 matrices (m: a, b, c, d of each), scaled."""
    m = m / m.sum(axis=0)
    step = 1
    while step < m.shape[1] and np.abs(m[0] * m[3] - m[1] * m[2]).max() > 1e-15:
        a, b, c, d = m[:, :-step]
        e, f, g, h = m[:, step:]
        new = np.stack([a * e + b * g, a * f + b * h, c * e + d * g, c * f + d * h])
        m[:, step:] = new / new.sum(axis=0)
        step *= 2
    row = m[:2]
    # a product of rank one has proportional rows, whichever is larger is the exact one
    other = m[2:].sum(axis=0) > row.sum(axis=0)
    row = np.where(other, m[2:], row)
    return row / row.sum(axis=0)


class Field:
    """Weights of the field, with the clean state as the origin: features, transitions, start."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, start: np.ndarray):
        self.weights, self.moves, self.start = weights, moves, start

    def marginals(self, feats: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Probability of the toxic state for each word of (3, n) features; texts lie at ``offs``."""
        if not feats.shape[1]:
            return np.empty(0)
        some = offs[:-1] < offs[1:]
        first, last = offs[:-1][some], offs[1:][some] - 1
        x = np.clip(self.weights[feats].sum(axis=0), -30, 30)
        emit = np.stack([1 / (1 + np.exp(x)), 1 / (1 + np.exp(-x))])
        move, start = np.exp(self.moves), np.exp(self.start)
        m = np.stack([move[0, 0] * emit[0], move[0, 1] * emit[1], move[1, 0] * emit[0], move[1, 1] * emit[1]])
        m[:, first] = np.stack([start[0] * emit[0][first], start[1] * emit[1][first]] * 2)
        back = np.ones_like(m)
        back[:, :-1] = m[:, 1:]
        back[:, last] = 1.0
        alpha = _products(m)
        beta = _products(back[[0, 2, 1, 3], ::-1].copy())[:, ::-1]
        p = alpha * beta
        return p[1] / p.sum(axis=0)


def fit_field(segments: list[tuple[np.ndarray, np.ndarray]], rounds: int = ROUNDS, rate: float = RATE, ridge: float = RIDGE) -> Field:
    """Maximum likelihood with a ridge, by Adam over all segments ((3, n) features, 0/1 labels) at once."""
    weights, moves, start = np.zeros(FEATURES), np.array([[0.0, RARE], [0.0, RARE]]), np.array([0.0, RARE])
    segments = [s for s in segments if len(s[1])]
    if not any(s[1].any() for s in segments):
        return Field(weights - 30.0, moves, start)  # nothing is toxic
    lengths = np.array([len(y) for _, y in segments])
    n, width = len(segments), int(lengths.max())
    feats = np.zeros((3, n, width), dtype=np.int64)
    y = np.zeros((n, width), dtype=np.int64)
    on = np.arange(width) < lengths[:, None]
    feats[:, on] = np.concatenate([f for f, _ in segments], axis=1)
    y[on] = np.concatenate([v for _, v in segments])
    pair_on = on[:, 1:]
    pairs = (2 * y[:, :-1] + y[:, 1:])[pair_on]
    seen = np.bincount(pairs, minlength=4).reshape(2, 2).astype(float)
    begun = np.bincount(y[:, 0], minlength=2).astype(float)
    size = FEATURES + 6
    mean, square = np.zeros(size), np.zeros(size)
    for k in range(1, rounds + 1):
        x = np.clip(weights[feats].sum(axis=0), -30, 30)
        emit = np.stack([1 / (1 + np.exp(x)), 1 / (1 + np.exp(-x))], axis=-1)
        move = np.exp(moves)
        alpha, beta = np.empty((n, width, 2)), np.ones((n, width, 2))
        a = np.exp(start) * emit[:, 0]
        alpha[:, 0] = a / a.sum(axis=1, keepdims=True)
        for t in range(1, width):
            a = (alpha[:, t - 1] @ move) * emit[:, t]
            alpha[:, t] = a / a.sum(axis=1, keepdims=True)
        for t in range(width - 2, -1, -1):
            b = (emit[:, t + 1] * beta[:, t + 1]) @ move.T
            b = b / b.sum(axis=1, keepdims=True)
            beta[:, t] = np.where(on[:, t + 1, None], b, 1.0)
        p = alpha * beta
        p = p / p.sum(axis=2, keepdims=True)
        xi = alpha[:, :-1, :, None] * move * (emit[:, 1:] * beta[:, 1:])[:, :, None, :]
        xi = (xi / xi.sum(axis=(2, 3), keepdims=True))[pair_on].sum(axis=0)
        off = (y - p[:, :, 1])[on]
        grad = np.zeros(size)
        for f in feats:
            grad[:FEATURES] += np.bincount(f[on], off, FEATURES)
        grad[:FEATURES] -= ridge * n * weights
        grad[FEATURES:] = np.concatenate([(seen - xi).ravel(), begun - p[:, 0].sum(axis=0)])
        grad /= n
        mean = 0.9 * mean + 0.1 * grad
        square = 0.99 * square + 0.01 * grad * grad
        step = rate * (mean / (1 - 0.9 ** k)) / (np.sqrt(square / (1 - 0.99 ** k)) + 1e-6)
        weights += step[:FEATURES]
        moves += step[FEATURES:FEATURES + 4].reshape(2, 2)
        start += step[FEATURES + 4:]
    return Field(weights, moves, start)


def cue_words(known: DataFrame, labelled: dict[int, int], level: float = LEVEL, most: int = CUES) -> list[int]:
    """Hashes of the words that mark toxic documents, over every row of ``known`` (text, toxic).

    ``labelled`` has the number of documents of each label that ``known`` stands for.  At
    most ``most`` words, those of the strongest evidence, are used.
    """
    totals = {r.toxic: r.n for r in known.groupBy("toxic").count().withColumnRenamed("count", "n").collect()}
    if not totals.get(0) or not totals.get(1):
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                w = _Words(part.column("text"))
                if not len(w.hashes):
                    continue
                h = np.zeros(len(w.hashes) + 2, dtype=np.uint64)
                h[1:-1] = w.hashes
                place = mix64(mix64(h[:-2] + h[1:-1]) + h[2:])
                toxic = part.column("toxic").to_numpy(zero_copy_only=False)[w.text]
                one = np.unique(np.stack([place, w.hashes, toxic.astype(np.uint64)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(one[1].view(np.int64)), pa.array(one[0].view(np.int64)), pa.array(one[2].astype(np.int32))],
                                                 names=["word", "place", "toxic"])

    places = known.mapInArrow(run, "word long, place long, toxic int").distinct()
    counts = stage(places.groupBy("word").agg(F.sum("toxic").cast("long").alias("n1"), F.count("*").alias("n")), "toxic-words")
    seen = counts.agg(F.sum("n1").alias("n1"), F.sum("n").alias("n"), F.count("*").alias("words")).first()
    if not seen.n1 or seen.n1 == seen.n:
        return []
    least = 2.0 * math.log(seen.words / level)
    prior = seen.n1 / seen.n
    n1, n0 = F.col("n1"), F.col("n") - F.col("n1")
    ratio = (n1 * F.log(n1 / (F.col("n") * prior)) + F.when(n0 > 0, n0 * F.log(n0 / (F.col("n") * (1 - prior)))).otherwise(0.0)) * 2
    more = n1 * (labelled[1] / totals[1]) > n0 * (labelled[0] / totals[0])
    strong = (counts.filter((n1 > 0) & more).withColumn("ratio", ratio).filter(F.col("ratio") >= least)
              .orderBy(F.desc("ratio"), "word").limit(most))
    return [r.word for r in strong.select("word").collect()]


def _segments(known: DataFrame, cues: list[int], width: int, sample: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Up to ``sample`` labelled segments with a toxic word and as many without, those of smallest hash."""
    table = np.unique(np.array(cues, dtype=np.int64).view(np.uint64))

    def run(batches):
        for batch in batches:
            found = {0: [], 1: []}
            for part in chunks(batch, "text"):
                w = _Words(part.column("text"))
                toxic = part.column("toxic").to_numpy(zero_copy_only=False)[w.text].astype(bool)
                label, feats = np.isin(w.hashes, table) & toxic, w.features().astype(np.int32)
                for a, b in zip(w.offs[:-1].tolist(), w.offs[1:].tolist()):
                    for i in range(a, b, width):
                        own = slice(i, min(i + width, b))
                        y, key = label[own], mix64(w.hashes[own].sum(keepdims=True)).view(np.int64)[0]
                        found[int(y.any())].append((int(key), feats[:, own].tobytes(), y.astype(np.uint8).tobytes()))
                found = {c: sorted(v)[:sample] for c, v in found.items()}
            for c, v in found.items():
                if v:
                    yield pa.RecordBatch.from_arrays([pa.array([c] * len(v)), *(pa.array(x) for x in zip(*v))], names=["cls", "key", "words", "labels"])

    some = stage(known.mapInArrow(run, "cls long, key long, words binary, labels binary").distinct(), "toxic-segments")
    rows = [r for c in (0, 1) for r in some.filter(F.col("cls") == c).orderBy("key", "words", "labels").limit(sample).collect()]
    return [(np.frombuffer(r.words, np.int32).reshape(3, -1), np.frombuffer(r.labels, np.uint8).astype(np.int64)) for r in rows]


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_docs: int = DOCS, sample: int = SAMPLE, segment: int = SEGMENT) -> Field:
    """The field of the labelled rows: ``docs`` (doc_id, text) with ``labels`` (doc_id, toxic 0/1).

    It is fitted to at most ``sample_docs`` documents of each label, those of smallest
    hash of their id; only the sample's ids (so bounded) are broadcast, texts are not
    shuffled.  Null labels are left out; a doc_id with several labels is toxic if one of
    them is.  Without documents of both labels nothing is toxic.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("text is not null and doc_id is not null")
    marks = labels.filter("toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    marks = stage(marks.join(rows.select("doc_id"), "doc_id", "left_semi"), "toxic-labels")
    labelled = {r.toxic: r.n for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(labelled) < 2:
        return fit_field([])
    chosen = [marks.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs) for c in (0, 1)]
    chosen = stage(chosen[0].union(chosen[1]), "toxic-sample")
    known = stage(rows.join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "toxic-known")
    cues = cue_words(known, labelled)
    return fit_field(_segments(known, cues, segment, sample) if cues else [])


def score_toxicity(docs: DataFrame, field: Field, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The ``keep`` columns, score (0 to 1) and spans (start, end in code points, end exclusive, p) of every row.

    Texts that are null or hold no word score 0.  A kept column named like a result gives way to it.
    """
    keep = [c for c in keep if c not in ("score", "spans")]
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "__text"):
                w = _Words(part.column("__text"))
                p = shared.value.marginals(w.features(), w.offs)
                score = np.zeros(part.num_rows)
                np.maximum.at(score, w.text, p)
                spans = [[] for _ in range(part.num_rows)]
                hit = np.flatnonzero(p >= 0.5)
                if len(hit):
                    # code points before each byte: bytes that do not continue a character
                    points = np.concatenate([[0], np.cumsum((w.flat & 0xC0) != 0x80)])
                    new = np.ones(len(hit), dtype=bool)
                    new[1:] = (np.diff(hit) != 1) | (w.text[hit[1:]] != w.text[hit[:-1]])
                    heads = np.flatnonzero(new)
                    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(hit)]):
                        d = int(w.text[hit[a]])
                        base = points[w.bytes[d]]
                        spans[d].append({"start": int(points[w.starts[hit[a]]] - base), "end": int(points[w.ends[hit[b - 1]]] - base),
                                         "p": round(float(p[hit[a:b]].max()), 9)})
                    for d in np.unique(w.text[hit]).tolist():
                        score[d] = 1.0 - math.prod(1.0 - s["p"] for s in spans[d])
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array(np.round(score, 9)),
                     pa.array(spans, type=pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])))],
                    names=[*keep, "score", "spans"])

    df = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    return df.mapInArrow(run, with_fields(df.select(*keep).schema, f"score double, spans {SPANS}"))
