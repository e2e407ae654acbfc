"""Benchmark decontamination by winnowing.

Words are hashed, every run of ``gram`` words gives a k-gram hash, and from each
window of ``span - gram + 1`` consecutive k-grams the smallest hash (the rightmost
of equal ones) is a fingerprint.  A run of ``span`` words that two texts share
holds the same window in both, so they share a fingerprint at the same place:
no shared span of that length is missed.  Fingerprints that documents share with
benchmark items are extended to the windows around them; a window is looked up once in
the table of the items' distinct windows and confirmed on the words themselves.  Items
shorter than ``span`` are one window of their own length.  A window that many items or
places hold is one entry with one list of items, and equal lists are kept once, so the
work is linear in the words of the documents, however often they repeat.

The benchmark goes to the tasks in blocks of at most ``block_bytes`` of text; each
block is one pass over the documents.  One block is with the driver and the tasks at a time: if
there are several, what a pass has found is written before the next one.  There is no
shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import _FOLD, ALNUM, chunks, flat_text, gram_hashes, gram_hashes_at, stage, word_bounds, word_hashes

SPAN, GRAM = 10, 5
BLOCK_BYTES = 16 << 20
RESULT = "n_words long, n_hit long, items array<string>, runs array<int>"


def select_fingerprints(grams: np.ndarray, window: int) -> np.ndarray:
    """For each window of k-grams the position of its smallest hash (rightmost if equal)."""
    n = len(grams) - window + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best, at = grams[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, window):
        g = grams[j:j + n]
        lower = g <= best
        best[lower] = g[lower]
        at[lower] = j
    return at + np.arange(n)


class Words:
    """Lower-cased words of some texts: hashes, bounds and the text each belongs to."""

    def __init__(self, column: pa.Array):
        self.flat, offs = flat_text(column)
        self.starts, self.ends, self.offs = word_bounds(self.flat, offs, ALNUM)
        self.hashes = word_hashes(self.flat, self.starts, self.ends)
        self.text = np.repeat(np.arange(len(self.offs) - 1), np.diff(self.offs))

    def whole(self, first: np.ndarray, length: int) -> np.ndarray:
        """Whether the ``length`` words from each ``first`` lie in one text."""
        ok = (first >= 0) & (first + length <= len(self.text))
        ok[ok] = self.text[first[ok]] == self.text[first[ok] + length - 1]
        return ok

    def words(self, first: int, length: int) -> list[bytes]:
        return [_FOLD[self.flat[self.starts[i]:self.ends[i]]].tobytes() for i in range(first, first + length)]

    def fingerprints(self, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and word position of the selected k-grams."""
        grams = gram_hashes(self.hashes, gram)
        at = select_fingerprints(grams, span - gram + 1)
        at = np.unique(at[self.whole(np.arange(len(at)), span)])
        return grams[at], at


class Windows:
    """The distinct windows of one length in the items, and which items hold each."""

    def __init__(self, words: Words, at: np.ndarray, length: int):
        hashes = gram_hashes_at(words.hashes, at, length)
        order = np.argsort(hashes, kind="stable")
        hashes, at = hashes[order], at[order]
        new = np.ones(len(at), dtype=bool)
        new[1:] = hashes[1:] != hashes[:-1]
        for j in range(length):  # equal hashes of different words are entries of their own
            new[1:] |= words.hashes[at[1:] + j] != words.hashes[at[:-1] + j]
        entry, heads = np.cumsum(new) - 1, np.flatnonzero(new)
        self.length, self.hashes, self.place = length, hashes[heads], at[heads]
        self.bits = np.zeros(1 << 16, dtype=bool)
        self.bits[self.hashes >> np.uint64(48)] = True
        entry, item = np.unique(np.stack([entry, words.text[at]]), axis=1)
        lists, self.kind = {}, np.empty(len(heads), dtype=np.int64)  # entry -> number of its list of items
        ends = np.searchsorted(entry, np.arange(len(heads) + 1))
        for e, (a, z) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
            self.kind[e] = lists.setdefault(item[a:z].tobytes(), len(lists))
        self.lists = [np.frombuffer(x, dtype=item.dtype) for x in lists]

    def found(self, docs: Words, items: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word in the documents, entry) of the windows at ``at`` that the items hold."""
        hashes = gram_hashes_at(docs.hashes, at, self.length)
        hit = self.bits[hashes >> np.uint64(48)]
        hashes, at = hashes[hit], at[hit]
        lo, hi = np.searchsorted(self.hashes, hashes, "left"), np.searchsorted(self.hashes, hashes, "right")
        n = hi - lo
        at, entry = np.repeat(at, n), np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        same = np.ones(len(at), dtype=bool)
        for j in range(self.length):
            same &= docs.hashes[at + j] == items.hashes[self.place[entry] + j]
        at, entry = at[same], entry[same]
        # the words themselves, once for each entry
        for e, k in zip(*np.unique(entry, return_index=True)):
            want = items.words(int(self.place[e]), self.length)
            if docs.words(int(at[k]), self.length) != want:  # two words with one hash: place by place
                own = np.flatnonzero(entry == e)
                wrong = [i for i in own.tolist() if docs.words(int(at[i]), self.length) != want]
                keep = np.ones(len(at), dtype=bool)
                keep[wrong] = False
                return self._but(docs, items, at, entry, want, e, keep)
        return at, entry

    def _but(self, docs, items, at, entry, want, e, keep):
        """The rest of :meth:`found`, place by place, where hashes have lied once."""
        for i in np.flatnonzero(keep).tolist():
            if entry[i] != e:
                keep[i] = docs.words(int(at[i]), self.length) == items.words(int(self.place[entry[i]]), self.length)
        return at[keep], entry[keep]


class Block:
    """One block of benchmark items, ready for lookups."""

    def __init__(self, items: list[tuple[str, str]], span: int, gram: int):
        self.span, self.gram = span, gram
        self.ids = [i for i, _ in items]
        self.words = Words(pa.array([t for _, t in items], type=pa.large_string()))
        lengths = np.diff(self.words.offs)
        self.windows = []
        hashes, _ = self.words.fingerprints(span, gram)
        self.prints = np.unique(hashes)
        self.bits = np.zeros(1 << 16, dtype=bool)
        self.bits[self.prints >> np.uint64(48)] = True
        every = np.arange(len(self.words.text))
        if len(self.prints):
            self.windows.append(Windows(self.words, every[self.words.whole(every, span)], span))
        for n in np.unique(lengths[(lengths > 0) & (lengths < span)]).tolist():
            self.windows.append(Windows(self.words, self.words.offs[:-1][lengths == n], n))

    def _candidates(self, docs: Words, length: int) -> np.ndarray:
        """Places where a window of that length may be shared: around shared fingerprints, or anywhere for short items."""
        if length < self.span:
            every = np.arange(len(docs.text))
            return every[docs.whole(every, length)]
        hashes, at = docs.fingerprints(self.span, self.gram)
        hit = self.bits[hashes >> np.uint64(48)]
        hashes, at = hashes[hit], at[hit]
        place = np.minimum(np.searchsorted(self.prints, hashes), len(self.prints) - 1)
        at = at[self.prints[place] == hashes]
        at = np.unique(np.concatenate([at - back for back in range(self.span - self.gram + 1)])) if len(at) else at
        return at[docs.whole(at, length)]

    def confirmed(self, docs: Words) -> tuple[np.ndarray, np.ndarray, list[set[int]]]:
        """Starts and ends of the shared windows in the documents, and the items that each document shares one with."""
        starts, ends, items = [], [], [set() for _ in range(len(docs.offs) - 1)]
        for w in self.windows:
            at, entry = w.found(docs, self.words, self._candidates(docs, w.length))
            starts.append(at)
            ends.append(at + w.length)
            if len(at):
                for d, kind in np.unique(np.stack([docs.text[at], w.kind[entry]]), axis=1).T.tolist():
                    items[d].update(w.lists[kind].tolist())
        none = [np.empty(0, np.int64)]
        return np.concatenate(starts or none), np.concatenate(ends or none), items


_BLOCKS: list[tuple[list, int, int, Block]] = []


def _block(shared, span: int, gram: int) -> Block:
    items = shared.value
    # the entry holds the list itself: an address alone can come back with another block
    if not _BLOCKS or _BLOCKS[0][0] is not items or _BLOCKS[0][1:3] != (span, gram):
        _BLOCKS.clear()  # a worker holds one block at a time
        _BLOCKS.append((items, span, gram, Block(items, span, gram)))
    return _BLOCKS[0][3]


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str, str]]]:
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"),
                            F.col("text").cast("string").alias("t")).filter("t is not null")
    block, size = [], 0
    for r in rows.toLocalIterator():
        n = len(r.t.encode())
        if block and size + n > limit:
            yield block
            block, size = [], 0
        block.append((r.i, r.t))
        size += n
    yield block


def _matched(df: DataFrame, shared, keep: list[str], out: list[str], span: int, gram: int) -> DataFrame:
    again = "runs" in df.columns

    def run(batches):
        block = _block(shared, span, gram)
        for batch in batches:
            for part in chunks(batch, "text"):
                docs = Words(part.column("text"))
                n = part.num_rows
                starts, ends, shared_items = block.confirmed(docs)
                cover = np.zeros(len(docs.text) + 1, dtype=np.int64)
                np.add.at(cover, starts, 1)
                np.add.at(cover, ends, -1)
                found = [{block.ids[i] for i in x} for x in shared_items]
                if again:  # hits of the blocks before
                    for d, runs in enumerate(part.column("runs").to_pylist()):
                        np.add.at(cover, docs.offs[d] + np.array(runs[::2], dtype=np.int64), 1)
                        np.add.at(cover, docs.offs[d] + np.array(runs[1::2], dtype=np.int64), -1)
                        found[d].update(part.column("items")[d].as_py())
                hit = np.cumsum(cover[:-1]) > 0
                total = np.concatenate([[0], np.cumsum(hit)])
                runs = [[] for _ in range(n)]
                for d in np.flatnonzero(total[docs.offs[1:]] > total[docs.offs[:-1]]).tolist():
                    own = np.concatenate([[False], hit[docs.offs[d]:docs.offs[d + 1]], [False]])
                    runs[d] = np.flatnonzero(own[1:] != own[:-1]).tolist()
                result = {
                    "n_words": pa.array(np.diff(docs.offs), type=pa.int64()),
                    "n_hit": pa.array(total[docs.offs[1:]] - total[docs.offs[:-1]], type=pa.int64()),
                    "items": pa.array([sorted(x) for x in found], type=pa.list_(pa.string())),
                    "runs": pa.array(runs, type=pa.list_(pa.int32())),
                }
                yield pa.RecordBatch.from_arrays([result[c] if c in result else part.column(c) for c in out], names=out)

    fields = {f.name: f for f in (*df.schema.fields, *T.StructType.fromDDL(RESULT).fields)}
    return df.mapInArrow(run, T.StructType([fields[c] for c in out]))


def contamination(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), span: int = SPAN,
                  gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``keep`` columns of every row of ``docs`` and what its text shares with the benchmark.

    n_words; n_hit (words inside a shared window); items (sorted ids, as strings, of
    the items with shared windows); runs (start, end, start, end, ... of the hit words,
    end exclusive).  Null and wordless texts have no words and no hits; null item ids
    are written as the empty string; an empty benchmark hits nothing; repeated rows
    are each answered.  A kept column named like a result gives way to the result.
    """
    keep = [c for c in keep if c not in ("n_words", "n_hit", "items", "runs")]
    df = docs.select(*dict.fromkeys([*keep, "text"]))
    blocks = _blocks(benchmark, block_bytes)
    block = next(blocks)
    while block is not None:
        following = next(blocks, None)
        shared = docs.sparkSession.sparkContext.broadcast(block)
        out = [*(keep if following is None else dict.fromkeys([*keep, "text"])), "n_words", "n_hit", "items", "runs"]
        df = _matched(df, shared, keep, out, span, gram)
        if following is not None:
            df = stage(df, "winnow-block")
            shared.destroy()
        block = following
    return df
