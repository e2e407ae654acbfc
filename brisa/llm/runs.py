"""Periodic runs of words by grammar compression.

The word ids of the texts of one Arrow slice are compressed by Re-Pair: the most
frequent pair of neighbours becomes a nonterminal until no pair occurs twice.  In
one round every pair that beats both pairs it overlaps is replaced, so pairs that do
not touch share a round; equal frequencies are ordered by a hash, which keeps
the derivation shallow.  What is left of each text is paired level by level, so each
text is one derivation tree.

The smallest node that holds a run has it across its boundary.  So the runs across the
boundary are computed once for each nonterminal, translated to all places where it is
derived, and of the intervals of one period the maximal ones stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import chunks, mix64, with_fields

#: a run has this length at least, and this many periods
LEAST_LENGTH, LEAST_PERIODS = 6, 4
#: bytes of text compressed into one grammar (a longer text is its own grammar)
SLICE_BYTES = 2 << 20
#: (node, period) probes tested at once
PROBES = 1 << 21

RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Derivation:
    """All inner nodes of the trees: their symbol, place, length and the length of their left child."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)

    def columns(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return tuple(np.empty(0, np.int64) for _ in range(4))
        return tuple(np.concatenate(c) for c in zip(*self.parts))


def _replaceable(sym: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One Re-Pair round: places to replace, the rank of each one's pair, and the pairs that still occur twice."""
    at = np.flatnonzero(live)
    key = (sym[at] << 32) | sym[at + 1]
    # a a a: of pairs that overlap themselves every second one counts
    opens = np.ones(len(at), dtype=bool)
    opens[1:] = (at[1:] != at[:-1] + 1) | (key[1:] != key[:-1])
    step = np.arange(len(at))
    counted = (step - np.maximum.accumulate(np.where(opens, step, 0))) % 2 == 0
    uniq, kind = np.unique(key, return_inverse=True)
    freq = np.bincount(kind[counted], minlength=len(uniq))
    again = np.zeros(len(sym) - 1, dtype=bool)
    again[at] = freq[kind] > 1
    order = (np.minimum(freq, (1 << 22) - 1).astype(np.uint64) << np.uint64(40)) | (mix64(uniq.view(np.uint64)) >> np.uint64(24))
    weight = np.zeros(len(sym) + 1, dtype=np.uint64)
    weight[at + 1] = np.where(counted & (freq[kind] > 1), order[kind], 0)
    best = (weight[at + 1] > weight[at]) & (weight[at + 1] >= weight[at + 2])
    best &= np.bincount(kind[best], minlength=len(uniq))[kind] > 1
    ranks = np.unique(kind[best], return_inverse=True)[1]
    return at[best], ranks, again


def derive(words: np.ndarray, bounds: np.ndarray, terminals: int) -> tuple[np.ndarray, ...]:
    """Inner nodes of the derivation trees of the texts ``words[bounds[k]:bounds[k + 1]]``: (symbol, place, length, left)."""
    sym, place = words.astype(np.int64), np.arange(len(words), dtype=np.int64)
    length = np.ones(len(words), dtype=np.int64)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    nodes, fresh = Derivation(), terminals

    def merge(at: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Join the symbols at ``at`` with their right neighbours; which symbols stay."""
        nonlocal sym, place, length, text
        nodes.add(symbols, place[at], length[at] + length[at + 1], length[at])
        sym[at] = symbols
        length[at] += length[at + 1]
        stays = np.ones(len(sym), dtype=bool)
        stays[at + 1] = False
        sym, place, length, text = sym[stays], place[stays], length[stays], text[stays]
        return stays

    live = text[1:] == text[:-1]
    while live.any():
        at, ranks, again = _replaceable(sym, live)
        if not len(at):
            break
        new = np.zeros(len(sym), dtype=bool)
        new[at] = True
        stays = merge(at, fresh + ranks)
        fresh += int(ranks.max()) + 1
        new, again = new[stays], np.append(again, False)[stays][:-1]
        live = (again | new[1:] | new[:-1]) & (text[1:] == text[:-1])
    while True:  # the rest: pairs from the left, level by level
        first = np.searchsorted(text, text)
        at = np.flatnonzero(((np.arange(len(sym)) - first) % 2 == 0)[:-1] & (text[1:] == text[:-1])) if len(sym) > 1 else first[:0]
        if not len(at):
            return nodes.columns()
        merge(at, np.arange(fresh, fresh + len(at)))
        fresh += len(at)


class Matches:
    """How far two places of a word sequence agree, by hashes of prefixes modulo two primes."""

    PRIMES = ((1 << 31) - 1, (1 << 31) - 19)

    def __init__(self, words: np.ndarray, seed: int):
        rng, self.tables = np.random.default_rng(seed), []
        n = len(words)
        for p in self.PRIMES:
            base = int(rng.integers(1 << 20, p - 1))
            power = np.ones(n + 1, dtype=np.int64)
            k = 1
            while k <= n:
                m = min(k, n + 1 - k)
                power[k:k + m] = power[:m] * pow(base, k, p) % p
                k += m
            code = (mix64(words.astype(np.uint64) + np.uint64(seed)) % np.uint64(p)).astype(np.int64)
            sums = np.zeros(n + 1, dtype=np.int64)
            np.cumsum(code * power[:n] % p, out=sums[1:])
            self.tables.append((p, power, sums % p))

    def equal(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from i and from j >= i agree."""
        out = np.ones(len(i), dtype=bool)
        for p, power, sums in self.tables:
            out &= (sums[i + n] - sums[i]) % p * power[j - i] % p == (sums[j + n] - sums[j]) % p
        return out

    def reach(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, backwards: bool = False) -> np.ndarray:
        """Words, ``most`` at most, that agree from (or before) i and j."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            ok = self.equal(i - mid, j - mid, mid) if backwards else self.equal(i, j, mid)
            low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
        return low


def _crossing(words: np.ndarray, nodes: tuple[np.ndarray, ...], matches: Matches) -> tuple[np.ndarray, ...]:
    """(node, start, end, period) of the runs across the boundary of each node (place, length, left), maximal within it."""
    place, length, left = nodes
    most = length // LEAST_PERIODS
    found = []
    # a run that crosses b with period q has its q-th word before b, or b itself, equal to the word q further
    for before, count in ((True, np.minimum(most, left)), (False, np.minimum(most, length - left - 1))):
        ends = np.cumsum(count)
        a = 0
        while a < len(count):
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PROBES, "right")))
            node = np.repeat(np.arange(a, z), count[a:z])
            q = np.arange(len(node)) - np.repeat(ends[a:z] - count[a:z] - (ends[a - 1] if a else 0), count[a:z]) + 1
            a = z
            at = place[node] + left[node] - (q if before else 0)
            hit = np.flatnonzero(words[at] == words[at + q])
            node, q, at = node[hit], q[hit], at[hit]
            lo, hi = place[node], place[node] + length[node] - q

            def same(d: int) -> np.ndarray:
                i = at + d
                ok = (i >= lo) & (i < hi)
                i = np.where(ok, i, at)
                return ok & (words[i] == words[i + q])

            p2, p1, n1, n2 = same(-2), same(-1), same(1), same(2)
            hit = np.flatnonzero((p1 & p2) | (p1 & n1) | (n1 & n2))
            node, q, at, lo, hi = node[hit], q[hit], at[hit], lo[hit], hi[hit]
            back = matches.reach(at, at + q, at - lo, backwards=True)
            on = matches.reach(at, at + q, hi - at)
            hit = np.flatnonzero(back + on + q >= np.maximum(LEAST_LENGTH, LEAST_PERIODS * q))
            found.append((node[hit], (at - back)[hit], (at + on + q)[hit], q[hit]))
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    node, s, e, q = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((q, e, s, node))  # of one interval its smallest period
    node, s, e, q = node[order], s[order], e[order], q[order]
    keep = np.ones(len(node), dtype=bool)
    keep[1:] = (node[1:] != node[:-1]) | (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    return node[keep], s[keep], e[keep], q[keep]


def _maximal(s: np.ndarray, e: np.ndarray, q: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """The intervals that no other of the same period holds."""
    order = np.lexsort((-e, s, q))
    s, e, q = s[order], e[order], q[order]
    far = q * (n + 1) + e
    keep = np.ones(len(s), dtype=bool)
    keep[1:] = far[1:] > np.maximum.accumulate(far)[:-1]
    return s[keep], e[keep], q[keep]


def _true_runs(words: np.ndarray, text: np.ndarray, s: np.ndarray, e: np.ndarray, q: np.ndarray) -> bool:
    """Whether the intervals are maximal and periodic, word by word."""
    n = len(words)
    for a, z, p in zip(s.tolist(), e.tolist(), q.tolist()):
        if not np.array_equal(words[a:z - p], words[a + p:z]):
            return False
        if a and text[a - 1] == text[a] and words[a - 1] == words[a - 1 + p]:
            return False
        if z < n and text[z] == text[z - 1] and words[z] == words[z - p]:
            return False
    return True


def find_runs(words: np.ndarray, bounds: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of the texts, by start and period; places count over all texts."""
    none = (np.empty(0, np.int64),) * 3
    if not len(words):
        return none
    symbol, place, length, left = derive(words, bounds, int(words.max()) + 1)
    order = np.argsort(symbol, kind="stable")
    order = order[length[order] >= LEAST_LENGTH]
    symbol, place, length, left = symbol[order], place[order], length[order], left[order]
    if not len(symbol):
        return none
    first = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
    times = np.diff(np.append(first, len(symbol)))
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    while True:
        node, s, e, q = _crossing(words, (place[first], length[first], left[first]), Matches(words, seed))
        # to every place where the node is derived
        many = times[node]
        back = np.repeat(np.arange(len(node)), many)
        nth = np.arange(len(back)) - np.repeat(np.cumsum(many) - many, many)
        shift = place[first[node][back] + nth] - place[first[node]][back]
        s, e, q = _maximal(s[back] + shift, e[back] + shift, q[back], len(words))
        if _true_runs(words, text, s, e, q):
            order = np.lexsort((q, s))
            return s[order], e[order], q[order]
        seed += 1  # two different stretches had equal hashes: other hashes


def periodic_runs(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, n_words long, runs (start, length, period; by start, then period) and
    ``collapsed`` for every row of ``docs``.

    Words are `[^\\x20\\x09-\\x0D]+`, compared as they are.  A run is a stretch with smallest
    period q and length at least 6 and 4 q that no neighbouring word extends.  ``collapsed`` has
    the words that no run contains after its first q words, joined by one space.  Null, empty
    and wordless texts have no runs and an empty ``collapsed``.  Texts are independent: rows
    may repeat, ids may be null.  Names in ``keep`` may be any but the three new ones.
    """
    schema = with_fields(docs.select(*keep).schema, f"n_words long, runs {RUN}, collapsed string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "__text", SLICE_BYTES):
                lists = pc.ascii_split_whitespace(pc.fill_null(part.column("__text").cast(pa.large_string()), ""))
                owner = pc.list_parent_indices(lists)
                flat = pc.list_flatten(lists)
                real = pc.not_equal(flat, "")
                owner, coded = owner.filter(real).to_numpy(), flat.filter(real).dictionary_encode()
                bounds = np.searchsorted(owner, np.arange(part.num_rows + 1))
                words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                s, e, q = find_runs(words, bounds)
                inside = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(inside, s + q, 1)
                np.add.at(inside, e, -1)
                stays = np.cumsum(inside[:-1]) == 0
                kept = coded.filter(pa.array(stays)).dictionary_decode()
                ends = np.concatenate([[0], np.cumsum(stays)])[bounds]
                joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), kept), pa.scalar(" ", pa.large_string()))
                row = owner[s] if len(s) else s
                runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (s - bounds[row], e - s, q)],
                                                  names=["start", "length", "period"])
                per_row = np.bincount(row, minlength=part.num_rows)
                offsets = pa.array(np.concatenate([[0], np.cumsum(per_row)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(part.num_columns - 1)), pa.array(np.diff(bounds), pa.int64()),
                     pa.ListArray.from_arrays(offsets, runs), joined.cast(pa.string())], names=schema.names)

    return docs.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)
