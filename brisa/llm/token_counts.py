"""Token counts: of the file's own merge rule, and by a count-only Viterbi over its pieces.

``Merges`` counts what the tokenizer of a sentencepiece BPE file gives: of a word's
neighbours the pair whose piece has the highest score is merged (the leftmost of equal
ones) until no pair is a piece; what is left and no piece counts as its UTF-8 bytes.
No piece has a mark behind another character, so runs of marks begin the words and
words are counted one by one.  ``Counter`` takes the same scores as if they were log
probabilities; those of a BPE file are negated merge ranks, so its counts are not
the tokenizer's.

An Aho-Corasick automaton enumerates every vocabulary entry inside a word; dynamic
programming carries, for each end, the best score and its number of pieces - no
segmentation is kept.  Of equally scored ways to an end the one whose last piece
starts first wins.  A character that no entry spells alone may be unknown: it scores
10 below the lowest entry and counts as its UTF-8 bytes (byte fallback).

A space becomes the word mark, one mark is put before the text unless it begins with
one, and the text is cut before every mark; so words are counted one by one and the
counts of frequent words are kept in a bounded table.  Words that no text had before
are counted together, many texts at once (``Batch``); odd ones go one by one.
"""

from __future__ import annotations

import heapq
import itertools
import math
import re
from collections import Counter as Times
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK, UNKNOWN_PENALTY = "▁", 10.0
#: words whose counts a worker keeps
ROOM = 300_000
#: texts whose new words are counted together, words counted at once, and their most characters (others go one by one)
TEXTS, WORDS, SHORT = 256, 4096, 32


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Ordinary pieces and scores of a sentencepiece file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


class Counter:
    """``count(text)``: number of pieces, of unknown characters, and the score of the best way."""

    def __init__(self, pieces: list[tuple[str, float]], room: int = ROOM):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.known: dict[str, tuple[int, int, float]] = {}
        self.room = room

    def word(self, word: str) -> tuple[int, int, float]:
        found = self.known.get(word)
        if found is None:
            found = self._viterbi(word)
            if len(self.known) < self.room:
                self.known[word] = found
        return found

    def _viterbi(self, word: str) -> tuple[int, int, float]:
        if self.single.issuperset(word):  # every place is reached; matches come by end, the longest first
            n = len(word)
            scores, counts = [-math.inf] * n, [0] * (n + 1)  # by last character; the start is place -1
            scores.append(0.0)
            for end, (length, score) in self.automaton.iter(word):
                score += scores[end - length]
                if score > scores[end]:
                    scores[end] = score
                    counts[end] = counts[end - length] + 1
            return counts[n - 1], 0, scores[n - 1]
        ends: list[list] = [[] for _ in word]
        if len(self.automaton):
            for end, match in self.automaton.iter(word):
                ends[end].append(match)
        best: list[tuple[float, int, int]] = [(0.0, 0, 0)]
        for i, ch in enumerate(word):
            top = None
            for length, score in sorted(ends[i], reverse=True):  # the earliest start first
                s, n, u = best[i + 1 - length]
                if top is None or s + score > top[0]:
                    top = (s + score, n + 1, u)
            if ch not in self.single:
                s, n, u = best[i]
                if top is None or s + self.unknown > top[0]:
                    top = (s + self.unknown, n + len(ch.encode()), u + 1)
            best.append(top)
        s, n, u = best[-1]
        return n, u, s

    def count(self, text: str) -> tuple[int, int, float]:
        if not text:
            return 0, 0, 0.0
        text = text.replace(" ", MARK)
        if not text.startswith(MARK):
            text = MARK + text
        n, u, s = 0, 0, 0.0
        for w in text.split(MARK)[1:]:
            a, b, c = self.word(MARK + w)
            n, u, s = n + a, u + b, s + c
        return n, u, s


class Merges:
    """``count(text)``: number of tokens by merges."""

    def __init__(self, pieces: list[tuple[str, float]], room: int = ROOM):
        self.scores = dict(pieces)
        # a piece with a mark behind another character would join words
        self.cut = None if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.scores) else re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.known: dict[str, int] = {}
        self.room = room

    def word(self, word: str) -> int:
        found = self.known.get(word)
        if found is None:
            found = self._merged(word)
            if len(self.known) < self.room:
                self.known[word] = found
        return found

    def _merged(self, word: str) -> int:
        parts, scores = list(word), self.scores
        n = len(parts)
        if n <= 48:  # a short word: the best pair by looking at all of them
            get, none = scores.get, -math.inf
            found = [get(a + b, none) for a, b in zip(parts, parts[1:])]
            while found:
                top = max(found)
                if top == none:
                    break
                i = found.index(top)
                del found[i]
                piece = parts[i] = parts[i] + parts.pop(i + 1)
                if i:
                    found[i - 1] = get(parts[i - 1] + piece, none)
                if i < len(found):
                    found[i] = get(piece + parts[i + 1], none)
            return len(parts) + sum([len(p.encode()) - 1 for p in parts if p not in scores])
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(-scores[p], i, p) for i in range(n - 1) if (p := parts[i] + parts[i + 1]) in scores]
        heapq.heapify(heap)
        while heap:
            _, i, piece = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j < 0 or len(parts[i]) + len(parts[j]) != len(piece) or parts[i] + parts[j] != piece:
                continue  # one of the two was merged since
            parts[i], parts[j], after[i] = piece, "", after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] >= 0 and (p := parts[a] + parts[after[a]]) in scores:
                    heapq.heappush(heap, (-scores[p], a, p))
        return sum(1 if p in scores else len(p.encode()) for p in parts if p)

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = MARK + text.replace(" ", MARK)
        return sum(map(self.word, self.cut.findall(text))) if self.cut else self.word(text)


class Batch:
    """``counts(words)`` of many short words at once: what ``Merges`` and ``Counter`` give for each of them.

    Pieces are numbered.  The merges go by a table of the pairs of pieces that make a piece, the best ways by a trie of the pieces.
    """

    def __init__(self, pieces: list[tuple[str, float]], counter: Counter, merges: Merges):
        # every character of a piece is one itself
        self.usable = merges.cut is not None and all(counter.single.issuperset(p) for p in merges.scores)
        if not self.usable:
            return
        self.merges, self.counter = merges, counter
        names = [p for p in merges.scores if p]
        self.number = {p: i for i, p in enumerate(names)}
        self.longest = max(map(len, names), default=0)
        self.scores = np.array([merges.scores[p] for p in names])
        self.letters = np.empty(0x110000, dtype=np.int32)  # the number of a character that is a piece; else one by its bytes
        for size, (a, b) in enumerate(((0, 0x80), (0x80, 0x800), (0x800, 0x10000), (0x10000, 0x110000))):
            self.letters[a:b] = len(names) + size
        for p in names:
            if len(p) == 1:
                self.letters[ord(p)] = self.number[p]
        pairs = [(self.number[p[:k]] << 32 | self.number[p[k:]], self.number[p])
                 for p in names for k in range(1, len(p)) if p[:k] in self.number and p[k:] in self.number]
        pairs.sort()
        self.pairs = _Table(np.array([a for a, _ in pairs], dtype=np.int64), np.array([b for _, b in pairs], dtype=np.int64))
        # a trie: (node, character) -> node; the scores of the nodes that are pieces
        nodes, edges, ends = {"": 0}, {}, {}
        for p in names:
            for k in range(1, len(p) + 1):
                if p[:k] not in nodes:
                    nodes[p[:k]] = len(nodes)
                    edges[nodes[p[:k - 1]] << 32 | int(self.letters[ord(p[k - 1])])] = nodes[p[:k]]
            ends[nodes[p]] = merges.scores[p]
        keys = np.array(sorted(edges), dtype=np.int64)
        self.trie = _Table(keys, np.array([edges[k] for k in keys.tolist()], dtype=np.int64))
        self.ends = np.full(len(nodes), -np.inf)
        self.ends[list(ends)] = list(ends.values())

    def counts(self, words: list[str]) -> list[tuple[int, int, int, float] | None]:
        """None for a word that is long, or begins not with its one mark: it goes one by one."""
        out: list = [None] * len(words)
        rows = [i for i, w in enumerate(words) if len(w) <= SHORT and not w.rfind(MARK)] if self.usable else []
        if not rows:
            return out
        lengths = np.array([len(words[i]) for i in rows])
        chars = self.letters[np.frombuffer("".join([words[i] for i in rows]).encode("utf-32-le"), dtype=np.uint32)]
        wide = int(lengths.max())
        ids = np.full((len(rows), wide), -1, dtype=np.int64)
        ids[np.arange(wide) < lengths[:, None]] = chars
        strange = np.maximum(ids - len(self.scores) + 1, 0)  # bytes of a character that is no piece
        tokens = self._merged(ids, lengths, lengths + (strange - (strange > 0)).sum(axis=1))
        pieces, scores = self._best(ids, lengths, strange)
        for i, *found in zip(rows, tokens.tolist(), pieces.tolist(), (strange > 0).sum(axis=1).tolist(), scores.tolist()):
            out[i] = tuple(found)
        return out

    def _merged(self, parts: np.ndarray, lengths: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        live, lengths = np.arange(len(lengths)), lengths.copy()
        made = np.full((len(parts), parts.shape[1]), -1, dtype=np.int64)  # the piece of each part and the next
        made[:, :-1] = self._joined(parts[:, :-1], parts[:, 1:])
        while len(live):
            score = np.where(made >= 0, self.scores[made], -np.inf)
            at = score.argmax(axis=1)  # the leftmost of the best
            every = np.arange(len(live))
            go = score[every, at] > -np.inf
            live, parts, made, at = live[go], parts[go], made[go], at[go]
            if not len(live):
                break
            tokens[live] -= 1
            lengths[live] -= 1
            every, wide = np.arange(len(live)), parts.shape[1]
            piece = made[every, at]
            # all behind the pair moves up by one
            source = np.arange(wide) + (np.arange(wide) > at[:, None])
            end = np.full((len(live), 1), -1, dtype=np.int64)
            parts = np.take_along_axis(np.hstack([parts, end]), source, axis=1)
            made = np.take_along_axis(np.hstack([made, end]), source, axis=1)
            parts[every, at] = piece
            right = np.where(at + 1 < wide, parts[every, np.minimum(at + 1, wide - 1)], -1)
            made[every, at] = self._joined(piece, right)
            left = np.flatnonzero(at)
            made[left, at[left] - 1] = self._joined(parts[left, at[left] - 1], piece[left])
            most = int(lengths[live].max())
            parts, made = parts[:, :most], made[:, :most]
        return tokens

    def _joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(b >= 0, self.pairs.find(a << 32 | b), -1)

    def _best(self, ids: np.ndarray, lengths: np.ndarray, strange: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, wide = ids.shape
        scores, counts = np.full((n, wide + 1), -np.inf), np.zeros((n, wide + 1), dtype=np.int64)
        scores[:, 0] = 0.0
        # by the start of a piece: for each end the earliest start comes first, and wins of equal ones
        for start in range(wide):
            alone = np.flatnonzero(strange[:, start])
            scores[alone, start + 1] = scores[alone, start] + self.counter.unknown
            counts[alone, start + 1] = counts[alone, start] + strange[alone, start]
            rows = np.flatnonzero((lengths > start) & (strange[:, start] == 0))
            node = np.zeros(len(rows), dtype=np.int64)
            for end in range(start, min(wide, start + self.longest)):
                inside = lengths[rows] > end
                rows, node = rows[inside], node[inside]
                node = self.trie.find(node << 32 | ids[rows, end])
                on = node >= 0
                rows, node = rows[on], node[on]
                if not len(rows):
                    break
                score = scores[rows, start] + self.ends[node]
                better = score > scores[rows, end + 1]
                at = rows[better]
                scores[at, end + 1] = score[better]
                counts[at, end + 1] = counts[at, start] + 1
        every = np.arange(n)
        return counts[every, lengths], scores[every, lengths]


class _Table:
    """Values of 64-bit keys, by open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(4 * len(keys)).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, dtype=np.int64), np.full(size, -1, dtype=np.int64)
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[left[free]]  # of those that meet one stays
            stays = self.keys[at] == keys[left]
            self.values[at[stays]] = values[left[stays]]
            left, at = left[~stays], (at[~stays] + 1) & (size - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 if it has none."""
        at = self._home(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], -1)
        left = np.flatnonzero((there != keys) & (there != -1))
        flat, wanted, places = out.reshape(-1), keys.reshape(-1), at.reshape(-1)
        if out.ndim > 1:
            left = np.flatnonzero(((there != keys) & (there != -1)).reshape(-1))
        places = places[left]
        while len(left):
            places = (places + 1) & (len(self.keys) - 1)
            there = self.keys[places]
            hit = there == wanted[left]
            flat[left[hit]] = self.values[places[hit]]
            on = ~hit & (there != -1)
            left, places = left[on], places[on]
        return out


class Both:
    """``count(text)``: n_tokens of ``Merges``, then what ``Counter`` gives; each distinct word of a text is looked up once."""

    def __init__(self, pieces: list[tuple[str, float]], room: int = ROOM):
        self.counter, self.merges = Counter(pieces, 0), Merges(pieces, 0)  # one table of words here in place of theirs
        self.batch = Batch(pieces, self.counter, self.merges)
        self.known: dict[str, tuple[int, int, int, float]] = {}
        self.room = room

    def counts(self, texts: list[str]) -> Iterator[tuple[int, int, int, float]]:
        """``count`` of each text; words that no text had before are counted together, of many texts at once."""
        for a in range(0, len(texts), TEXTS):
            some = texts[a:a + TEXTS]
            if self.merges.cut is None:
                yield from map(self.count, some)
                continue
            bags = [Times(self.merges.cut.findall(MARK + t.replace(" ", MARK))) if t else {} for t in some]
            met: dict[str, tuple[int, int, int, float]] = {}
            new = sorted(set().union(*bags).difference(self.known), key=len)
            for b in range(0, len(new), WORDS):
                part = new[b:b + WORDS]
                met.update((w, c) for w, c in zip(part, self.batch.counts(part)) if c is not None)
            for text, bag in zip(some, bags):
                yield self._summed(text, bag, met)
            room = self.room - len(self.known)
            if room > 0:
                self.known.update(itertools.islice(met.items(), room))

    def word(self, word: str) -> tuple[int, int, int, float]:
        """Of marks and what follows them: one word for the merges, one for each mark for the Viterbi."""
        found = self.known.get(word)
        if found is None:
            n, u, s = 0, 0, 0.0
            for w in word.split(MARK)[1:]:
                a, b, c = self.counter.word(MARK + w)
                n, u, s = n + a, u + b, s + c
            found = self.merges.word(word), n, u, s
            if len(self.known) < self.room:
                self.known[word] = found
        return found

    def count(self, text: str) -> tuple[int, int, int, float]:
        if not text:
            return 0, 0, 0, 0.0
        if self.merges.cut is None:
            return self.merges.count(text), *self.counter.count(text)
        return self._summed(text, Times(self.merges.cut.findall(MARK + text.replace(" ", MARK))), {})

    def _summed(self, text: str, bag: dict[str, int], met: dict[str, tuple[int, int, int, float]]) -> tuple[int, int, int, float]:
        t, n, u, s = 0, 0, 0, 0.0
        known, get = self.known.get, met.get
        for word, times in bag.items():
            a, b, c, d = known(word) or get(word) or self.word(word)
            t, n, u, s = t + times * a, n + times * b, u + times * c, s + times * d
        if text.startswith((" ", MARK)):  # the Viterbi puts no mark before a text that begins with one
            a, b, c = self.counter.word(MARK)
            n, u, s = n - a, u - b, s - c
        return t, n, u, s


_COUNTERS: dict[str, Both] = {}


def _counters(path: str) -> Both:
    if path not in _COUNTERS:
        _COUNTERS[path] = Both(vocabulary(path))
    return _COUNTERS[path]


def token_counts(docs: DataFrame, tokenizer: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, n_tokens, n_pieces, n_unknown (characters) and score of every row of ``docs`` (text).

    n_tokens is the count of the tokenizer whose file is named; n_pieces, n_unknown and score
    are the Viterbi's over the file's scores.  ``tokenizer`` is a BPE file of sentencepiece,
    without normalisation, that every worker can read.  Null and empty texts have no pieces and score 0.  A kept column named like a result gives way to it.
    """
    keep = [c for c in keep if c not in ("n_tokens", "n_pieces", "n_unknown", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = _counters(tokenizer)
        for batch in batches:
            out = list(counters.counts([t or "" for t in batch.column("__text").to_pylist()]))
            columns = zip(*out) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), *(pa.array(v, type=k) for v, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64())))],
                names=[*keep, "n_tokens", "n_pieces", "n_unknown", "score"])

    df = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]
    return df.mapInArrow(run, ", ".join([*kinds, "n_tokens long", "n_pieces long", "n_unknown long", "score double"]))
