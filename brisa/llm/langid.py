"""Language identification by rank-order n-gram profiles.

A profile lists a language's most frequent character n-grams by rank.  A document is
compared by the out-of-place distance: for each of its own most frequent n-grams the
difference of the two ranks, or a fixed penalty if the profile lacks it.  The language
with the smallest distance wins (ties: the first language name).

N-grams of 1 to ``n_max`` characters run over the lower-cased letters; every other
run of characters counts as one blank.  N-gram counts cover every training document:
tasks sum them per language and hand on bounded tables, Spark adds those up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

N_MAX, PROFILE = 3, 300
_BITS = 21  # of a code point; three of them fit 64 bits
#: distinct n-grams that a training task holds before it hands its counts on
HELD = 1 << 20


def _letter_codes() -> np.ndarray:
    """For each code point its lower-case letter (one code point), or 0 if it is no letter."""
    import sys
    out = np.zeros(sys.maxunicode + 1, dtype=np.uint32)
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(_letter_codes())
    return _LETTERS[0]


def ngrams(text: str, n_max: int = N_MAX) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams (as numbers) of a text and their counts; none if it has no letter."""
    codes = _letters()[np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)]
    if not codes.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    padded = np.zeros(len(codes) + 2, dtype=np.int64)
    padded[1:-1] = codes
    keep = np.ones(len(padded), dtype=bool)
    keep[1:] = (padded[1:] != 0) | (padded[:-1] != 0)  # one blank per run
    c = padded[keep] + 1  # a blank is 1
    grams = [c[c > 1]]
    run = c
    for n in range(2, n_max + 1):
        run = (run[:-1] << _BITS) | c[n - 1:]
        grams.append(run)
    every = np.sort(np.concatenate(grams))
    at = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    return every[at], np.diff(np.concatenate([at, [len(every)]]))


def most_frequent(grams: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """The k most frequent n-grams, most frequent first (ties: the smaller number)."""
    if len(grams) > k:
        least = np.partition(counts, len(counts) - k)[len(counts) - k]
        some = counts >= least
        grams, counts = grams[some], counts[some]
    return grams[np.argsort(-counts, kind="stable")[:k]]


def fit_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", n_max: int = N_MAX, size: int = PROFILE) -> DataFrame:
    """lang, gram, rank: the ``size`` most frequent n-grams of each non-null language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {}

        def merged(parts):
            grams, inverse = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            return grams, np.bincount(inverse, np.concatenate([n for _, n in parts])).astype(np.int64)

        def rows(lang, grams, counts):
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), type=pa.string()), pa.array(grams), pa.array(counts)],
                                              names=["lang", "gram", "n"])

        held = 0
        for batch in batches:
            for t, name in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                g = ngrams(t, n_max)
                parts = sums.setdefault(name, [])
                parts.append(g)
                held += len(g[0])
                if held > HELD:
                    sums = {k: [merged(p)] for k, p in sums.items() if p}
                    held = sum(len(p[0][0]) for p in sums.values())
                    if held > HELD // 2:
                        for k, p in sums.items():
                            yield rows(k, *p[0])
                        sums, held = {}, 0
        for k, p in sums.items():
            if p:
                yield rows(k, *merged(p))

    known = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    counts = (known.filter("text is not null and lang is not null").mapInArrow(run, "lang string, gram long, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counts.withColumn("rank", rank - 1).filter(F.col("rank") < size).select("lang", "gram", "rank")


class Profiles:
    """Ranks of the n-grams of all profiles, ready for distances."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        self.grams = np.unique(np.array([r[1] for r in rows], dtype=np.int64))
        self.ranks = np.full((len(self.langs), len(self.grams) + 1), -1, dtype=np.int64)
        row = {name: i for i, name in enumerate(self.langs)}
        for name, gram, rank in rows:
            self.ranks[row[name], np.searchsorted(self.grams, gram)] = rank

    def predict(self, text: str | None, n_max: int) -> tuple[str, float]:
        """Language and score: 1 minus the distance over the largest possible one."""
        grams, counts = ngrams(text or "", n_max)
        if not len(grams) or not self.langs:
            return "und", 0.0
        top = most_frequent(grams, counts, self.size)
        at = np.searchsorted(self.grams, top)
        at[self.grams[np.minimum(at, len(self.grams) - 1)] != top] = len(self.grams)
        ranks = self.ranks[:, at]
        far = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(top))))
        distance = far.sum(axis=1)
        best = int(np.argmin(distance))
        return self.langs[best], 1.0 - float(distance[best]) / (self.size * len(top))


def predict_language(docs: DataFrame, profiles: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text",
                     n_max: int = N_MAX, size: int = PROFILE) -> DataFrame:
    """The ``keep`` columns, lang_pred and score of every row.

    Texts that are null or hold no letter get `und` and score 0, and so does every
    text if there are no profiles.  A kept column named like a result gives way to it.
    The profiles (``size`` rows per language) go to every task.
    """
    keep = [c for c in keep if c not in ("lang_pred", "score")]
    rows = [(r.lang, r.gram, r.rank) for r in profiles.collect()]
    shared = docs.sparkSession.sparkContext.broadcast(rows)
    held: list[Profiles] = []

    def run(batches):
        if not held:
            held.append(Profiles(shared.value, size))
        for batch in batches:
            out = [held[0].predict(t, n_max) for t in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array([x for x, _ in out], type=pa.string()),
                 pa.array([x for _, x in out], type=pa.float64())], names=[*keep, "lang_pred", "score"])

    df = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]
    return df.mapInArrow(run, ", ".join([*kinds, "lang_pred string", "score double"]))


def held_out(doc_id: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves ``part`` modulo ``parts`` (null ids: no)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part, F.lit(False))
