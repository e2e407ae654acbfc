"""Document fingerprints by a randomised edit embedding.

Shared random walks map edit distance to Hamming distance: at step j a walk writes
the character it stands on and moves on by one random bit that depends only on
(walk, j, character).  Two texts that differ by an edit drift apart there and meet
again after a few steps with good chance, from where their walks stay equal.

A fingerprint keeps sampled steps: ``samples`` of each octave [2^i, 2^(i+1)) of each
walk, one hex digit (a hash of the character) per sample, so texts of any length
are read whole and texts of similar length are sampled at the same steps.  The
likeness of two fingerprints is the share of equal digits, each octave weighted by
its length; of the shared walks the one that stayed together longest counts.

Near copies anywhere in the table are found by banding: the sampled digits of each
walk's last octaves are cut into bands, texts that meet in (walk, band, digits) are
candidates, and a candidate is a link only if the edit distance of the whole texts
is small enough (which any alignment with few enough edits shows).  Equal texts are one class with one representative.

A candidate whose texts are already in one class is not looked at.  First each text meets the best of the most popular
texts of its buckets, then those that are left, which joins the near copies; what is left are buckets with texts of
several classes.  There each text outside a bucket's largest class meets all texts of other classes, in one bucket only
for each pair, and only if their lengths and counts of pairs of characters do not show that they are too far apart (a
bound without error).  Classes are merged between slices of the candidates.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import list_array, mix64, stage, tasks_for, text_or_empty
from .minhash import components

WALKS, SAMPLES, SEED = 2, 64, 11  # samples: a power of two
#: digits of a band, octaves (from a walk's last one back) that are banded, and the edit distance of a
#: link in percent of the longer text
BAND, OCTAVES, PERCENT = 8, 3, 10
#: bytes of a text's SHA-256 that stand for the text in the banding
ID_BYTES = 16
#: longer texts with a bound of so few edits are compared by diagonals, others by bit vectors
BITS, FEW = 8000, 200
#: length of the stretches that an alignment goes through, and of the texts between them that are aligned exactly
GRAM, EXACT = 8, 64
#: bins that pairs of characters are counted in
BINS = 128
#: share of the counts' limit from which an alignment is not likely to show a link (any share gives the same links)
DOUBT = 0.55
#: ids that are sent to all tasks to pick their texts; more are joined
SENT_IDS = 500_000
#: candidates that are compared at once, for each text that meets another
AT_ONCE = 1
#: code points handled by one round of vector operations
CHUNK_CHARS = 6 << 20
_END = 63  # class of the end of a text: no walk leaves it
#: character class (the walks' alphabet) and hex digit of every code point
_MIXED = mix64(np.arange(1, 0x110001, dtype=np.uint64))
_CLASS = (_MIXED % np.uint64(_END)).astype(np.uint8)
_DIGIT = ((_MIXED >> np.uint64(32)) & np.uint64(15)).astype(np.uint8)
#: bin of every two classes
_BIN = (mix64(np.arange(1, (_END + 1) ** 2 + 1, dtype=np.uint64)) % np.uint64(BINS)).astype(np.uint8)
_HEX = np.frombuffer(b"0123456789abcdef-", dtype=np.uint8)


class Walks:
    """The shared random bits and the sampled steps."""

    def __init__(self, walks: int = WALKS, samples: int = SAMPLES, seed: int = SEED):
        self.walks, self.samples, self.seed = walks, samples, seed
        self._weights = np.empty(0)

    def steps(self, octave: int) -> np.ndarray:
        """The sampled steps of an octave, ascending (all of them in the short ones)."""
        n = 1 << octave
        if n <= self.samples:
            return np.arange(n, 2 * n)
        inside = np.random.default_rng([self.seed, octave]).random(self.samples)  # one per equal part
        return n + ((np.arange(self.samples) + inside) * (n / self.samples)).astype(np.int64)

    def moves(self, octave: int) -> np.ndarray:
        """For each step of an octave and each walk (of one text) the moves, a bit for each character class."""
        steps = np.arange(1 << octave, 2 << octave, dtype=np.uint64)[:, None]
        walk = np.arange(1, self.walks + 1, dtype=np.uint64)[None, :] << np.uint64(48)
        bits = mix64(mix64(steps + walk + np.uint64(self.seed)) ^ np.uint64(0x5851F42D4C957F2D))
        return (bits & np.uint64((1 << _END) - 1))[:, :, None]  # none at the end of a text

    def embed(self, codes: np.ndarray, lengths: np.ndarray) -> list[list[bytes]]:
        """For each text (consecutive code points) the sampled digits of each walk."""
        n = len(lengths)
        ends = np.cumsum(lengths) + np.arange(n)  # each text gets an end mark behind it
        inside = np.ones(len(codes) + n, dtype=bool)
        inside[ends] = False
        cls = np.full(len(codes) + n, _END, dtype=np.uint8)
        dig = np.full(len(codes) + n, 16, dtype=np.uint8)
        cls[inside], dig[inside] = _CLASS[codes], _DIGIT[codes]
        order = np.argsort(-lengths, kind="stable")  # texts that end early drop out at the tail
        at = np.tile((ends - lengths)[order].astype(np.uint64), (self.walks, 1))  # one place per walk and text
        end = ends[order].astype(np.uint64)
        out: list[list[list[bytes]]] = [[[] for _ in range(self.walks)] for _ in range(n)]
        active, octave = int((lengths > 0).sum()), 0
        while active:
            live, last = at[:, :active].copy(), end[:active]
            places = live.view(np.int64)
            here, move = np.empty(live.shape, dtype=np.uint8), np.empty(live.shape, dtype=np.uint64)
            one = np.uint64(1)
            sampled = {int(j): k for k, j in enumerate(self.steps(octave) - (1 << octave))}
            full = np.full((len(sampled), *live.shape), 16, dtype=np.uint8)
            for j, bits in enumerate(self.moves(octave)):
                if j in sampled:
                    np.take(dig, places, out=full[sampled[j]], mode="clip")
                np.take(cls, places, out=here, mode="clip")
                np.right_shift(bits, here, out=move)
                np.bitwise_and(move, one, out=move)
                np.add(live, move, out=live)
                if j & 1023 == 1023 and (live == last).all():
                    break
            at[:, :active] = live
            for walk, digits in enumerate(_HEX[full.transpose(1, 2, 0)]):
                for i, text in enumerate(digits):
                    out[order[i]][walk].append(text.tobytes())
            unfinished = np.flatnonzero((live < last).any(axis=0))
            active, octave = int(unfinished[-1]) + 1 if len(unfinished) else 0, octave + 1
        return [[b"".join(w).rstrip(b"-") for w in text] for text in out]

    def weights(self, digits: int) -> np.ndarray:
        """The steps that each of the first digits stands for."""
        if len(self._weights) < digits:
            sizes = [min(1 << o, self.samples) for o in range(40)]
            self._weights = np.repeat([(1 << o) / k for o, k in enumerate(sizes)], sizes)
        return self._weights[:digits]

    def likeness(self, a: str, b: str) -> float:
        """0 to 1: of the walk that agrees most, the weighted share of equal digits."""
        if a == b:
            return 1.0
        best = 0.0
        for x, y in zip(a.split("."), b.split(".")):
            n = max(len(x), len(y))
            if n:
                u = np.frombuffer(x.ljust(n, "-").encode(), dtype=np.uint8)
                v = np.frombuffer(y.ljust(n, "-").encode(), dtype=np.uint8)
                w = self.weights(n)
                same = float(w[u == v].sum() / w.sum())
                best = max(best, (same - 1 / 16) / (15 / 16))  # digits agree by chance once in 16
        return best

    def fingerprints(self, texts: list[str]) -> list[str]:
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        return [b".".join(x).decode() if n else "" for x, n in zip(self.embed(codes, lengths), lengths)]


    def bands(self, fingerprint: str, width: int = BAND, octaves: int = OCTAVES) -> list[str]:
        """`walk:start:digits` of the whole bands in the last octaves of each walk."""
        out = []
        for walk, digits in enumerate(fingerprint.split(".")):
            sizes, at = [], 0
            while at < len(digits):
                sizes.append((at, min(1 << len(sizes), self.samples)))
                at += sizes[-1][1]
            for start, size in sizes[-octaves:]:
                step = min(width, size)
                out += [f"{walk}:{a}:{digits[a:a + step]}" for a in range(start, start + size, step) if a + step <= len(digits)]
        return out


def pair_counts(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each text (consecutive code points) how many pairs of neighbouring characters fall into each bin (127 at most).

    An edit takes at most two pairs and brings at most two, so in two texts d edits apart the counts that are
    higher in one of them are so by at most 2 * d in all.
    """
    cls = _CLASS[codes]
    bins = _BIN[cls[:-1].astype(np.uint16) * np.uint16(_END + 1) + cls[1:]]
    out, at = np.zeros((len(lengths), BINS), dtype=np.int64), 0
    for i, n in enumerate(lengths.tolist()):
        if n > 1:
            out[i] = np.bincount(bins[at:at + n - 1], minlength=BINS)
        at += n
    return np.minimum(out, 127).astype(np.int8)


_WALKS: dict[tuple, Walks] = {}


def _walks(walks: int, samples: int, seed: int) -> Walks:
    key = (walks, samples, seed)
    if key not in _WALKS:
        _WALKS[key] = Walks(walks, samples, seed)
    return _WALKS[key]


def edited(text: str, after: str) -> str:
    """``text`` with its last quarter replaced by as much of the start of ``after``."""
    n = len(text) // 4
    return text[:len(text) - n] + after[:n]


def with_neighbours(docs: DataFrame, tasks: int | None = None) -> DataFrame:
    """doc_id, text, own: rows in partitions of ascending doc_id, each partition followed by the
    row that comes next (own = false).  After the last row comes the first.

    The text is shuffled once: the bounds of the partitions and their first ids come from
    a scan of the ids, and only first rows are sent twice.  Ties go by text.  Null ids come first.
    """
    tasks = tasks or tasks_for(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("string").alias("text"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("at"))
    bounds = rows.agg(F.percentile_approx("at", [i / tasks for i in range(1, tasks)] or [1.0], 100 * tasks).alias("b")).first().b or []
    splits = [float("-inf"), *sorted({float(b) for b in bounds}), float("inf")]
    rows = Bucketizer(splits=splits, inputCol="x", outputCol="p").transform(rows.withColumn("x", F.col("at").cast("double")))
    rows = rows.select("doc_id", "text", "at", F.col("p").cast("int").alias("p"))
    # one first id per partition
    firsts = sorted((r.p, r.at) for r in rows.groupBy("p").agg(F.min("at").alias("at")).collect())
    before = {at: firsts[k - 1][0] for k, (_, at) in enumerate(firsts)}  # the first one goes behind the last
    copies = docs.sparkSession.createDataFrame([(at, p) for at, p in before.items()], "at long, before int")
    sent = (rows.join(F.broadcast(copies), "at", "left")
            .withColumn("to", F.explode(F.array_compact(F.array(
                F.struct(F.col("p"), F.lit(True).alias("own")),
                F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("p"), F.lit(False).alias("own")))))))
            .select("doc_id", "text", "at", "to.p", "to.own"))
    return (sent.repartitionById(len(splits) - 1, F.col("p"))
            .sortWithinPartitions(F.desc("own"), "at", "text").select("doc_id", "text", "own"))


def edit_fingerprints(docs: DataFrame, walks: int = WALKS, samples: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """doc_id, n_chars, text_sha256 (32 bytes), edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, counts (see ``pair_counts``) of each row.

    Null texts are empty; an empty text has the empty fingerprint, is wholly like another
    empty text and unlike any other.  Rows of one doc_id follow each other by text.  A
    single document is its own next.  Other columns are ignored.
    """
    names = ["doc_id", "n_chars", "text_sha256", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "counts"]

    def answer(ids, texts, after):
        """Rows for ``texts``; ``after`` is the text that follows the last of them."""
        w = _walks(walks, samples, seed)
        others = [edited(t, n) for t, n in zip(texts, [*texts[1:], after])]
        both = w.fingerprints([*texts, after, *others])
        prints, changed = both[:len(texts) + 1], both[len(texts) + 1:]
        counts = pair_counts(np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32), np.array([len(t) for t in texts], dtype=np.int64))
        return pa.RecordBatch.from_arrays([
            pa.array(ids, type=pa.int64()), pa.array([len(t) for t in texts], type=pa.int64()),
            pa.array([hashlib.sha256(t.encode()).digest() for t in texts], type=pa.binary()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in others]),
            pa.array(prints[:-1], type=pa.string()), pa.array(changed, type=pa.string()),
            pa.array([w.likeness(a, b) for a, b in zip(prints, changed)], type=pa.float64()),
            pa.array([w.likeness(a, b) for a, b in zip(prints, prints[1:])], type=pa.float64()),
            list_array(counts.ravel(), np.full(len(texts), BINS), pa.int8()),
        ], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, t, own in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "own"))):
                if texts and (not own or size > CHUNK_CHARS):
                    yield answer(ids, texts, t)
                    ids, texts, size = [], [], 0
                if not own:
                    return
                ids.append(i)
                texts.append(t)
                size += len(t)

    return with_neighbours(docs).mapInArrow(run, (
        "doc_id long, n_chars long, text_sha256 binary, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, counts array<tinyint>"))


def _places(a: str) -> dict[str, int]:
    """For each character the places in ``a`` that hold it, as bits."""
    if len(a) <= EXACT:
        out: dict[str, int] = {}
        for i, ch in enumerate(a):
            out[ch] = out.get(ch, 0) | 1 << i
        return out
    x = np.frombuffer(a.encode("utf-32-le"), dtype=np.uint32)
    return {ch: int.from_bytes(np.packbits(x == ord(ch), bitorder="little").tobytes(), "little") for ch in set(a)}


def _by_bits(a: str, b: str, most: int) -> int | None:
    """Edit distance by bit vectors over ``a``, or None if above ``most``."""
    if not a or not b:
        d = max(len(a), len(b))
        return d if d <= most else None
    peq = _places(a)
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    pv, mv, score = full, 0, len(a)
    for left, ch in zip(range(len(b) - 1, -1, -1), b):
        eq = peq.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        if score - left > most:  # one step less per character at best
            return None
        ph, mh = (ph << 1 | 1) & full, mh << 1 & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
    return score


def _by_band(a: str, b: str, most: int) -> int | None:
    """Edit distance by bit vectors over the 2 * most + 2 diagonals that matter, or None if above ``most``; ``a`` is not the
    shorter, and longer than ``most``."""
    wide, n, m = 2 * most + 2, len(a), len(b)
    peq = _places(a)
    full, get = (1 << wide) - 1, peq.get
    pv, mv, score = full >> (wide - most - 1) << (wide - most - 1), 0, most
    corner, side, shift = wide - 1, wide - 2, most + 1 - wide
    worst = most + m - (n - most)  # it falls along the last row, not along a diagonal
    for i, ch in enumerate(b):
        eq = get(ch, 0)
        eq = (eq >> shift if shift > 0 else eq << -shift) & full
        shift += 1
        d0 = ((((eq & pv) + pv) ^ pv) | eq | mv) & full
        ph, mh = mv | (full ^ (d0 | pv)), d0 & pv
        if i < n - most:
            if not d0 >> corner:
                score += 1
        else:
            score += (ph >> side & 1) - (mh >> side & 1)
            side -= 1
        if score > worst:
            return None
        d0 >>= 1
        pv, mv = mh | (full ^ (d0 | ph)), d0 & ph
    return score if score <= most else None


def _by_diagonals(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Edit distance by the furthest places on each diagonal, or None if above ``most``; few edits, little work."""
    n, m, wide = len(a), len(b), 32
    a, b = np.concatenate([a, np.full(wide, 0x110000, a.dtype)]), np.concatenate([b, np.full(wide, 0x110001, b.dtype)])
    wa, wb = (np.lib.stride_tricks.sliding_window_view(x, wide) for x in (a, b))
    low, far = 0, np.zeros(1, dtype=np.int64)  # far[k]: characters of a used on diagonal low + k
    for edits in range(most + 1):
        if edits:
            gone = np.full(1, -2, dtype=np.int64)
            ext = np.concatenate([gone, gone, far, gone, gone])
            far, low = np.maximum(np.maximum(ext[1:-1] + 1, ext[:-2]), ext[2:] + 1), low - 1
        diagonal = low + np.arange(len(far))
        far = np.minimum(far, np.minimum(n, m - diagonal))
        ok = (far >= 0) & (far + diagonal >= 0)
        far[~ok] = -2
        go = np.flatnonzero(ok)
        while len(go):
            i = far[go]
            same = wa[i] == wb[i + diagonal[go]]
            run = np.where(same.all(axis=1), wide, same.argmin(axis=1))
            far[go] += run
            go = go[run == wide]
        at = m - n - low
        if 0 <= at < len(far) and far[at] == n:
            return edits
    return None


def _core(a: str, b: str) -> tuple[slice, slice, np.ndarray, np.ndarray]:
    """The texts without what they begin and end with alike: as slices, and as code points."""
    x, y = (np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32) for t in (a, b))
    n = min(len(x), len(y))
    head = int((np.append(x[:n] == y[:n], False)).argmin())
    n -= head
    tail = int((np.append(x[len(x) - n:][::-1] == y[len(y) - n:][::-1], False)).argmin())
    at, to = slice(head, len(x) - tail), slice(head, len(y) - tail)
    return at, to, x[at], y[to]


def _unlikeness(x: np.ndarray, y: np.ndarray, most: int) -> float:
    """Above 1 if the 3-grams show an edit distance above ``most``: an edit takes at most 3 of them and brings at most 3."""
    grams = [t[2:] * np.uint32(961) + t[1:-1] * np.uint32(31) + t[:-2] if len(t) > 2 else t[:0] for t in (x, y)]
    share = 0.0
    for bins in (1 << 11, 1 << 16):  # few bins tell most of the unlike texts
        a, b = (np.bincount(g & np.uint32(bins - 1), minlength=bins) for g in grams)
        share = int(np.abs(a - b).sum()) / (6 * most) if most else float(len(x) + len(y) > 0) * 2
        if share > 1 or share < DOUBT / 2 and len(x) + len(y) < 2 * bins:
            break
    return share


def _distance(a: str, b: str, x: np.ndarray, y: np.ndarray, most: int) -> int | None:
    if min(len(x), len(y)) > BITS and most <= FEW:
        return _by_diagonals(x, y, most)
    a, b = sorted((a, b), key=len)
    return _by_band(b, a, most) if a and 2 * most + 2 < len(a) else _by_bits(a, b, most)


def _increasing(values: np.ndarray) -> np.ndarray:
    """Places of a longest strictly increasing subsequence."""
    if (values[1:] > values[:-1]).all():
        return np.arange(len(values))
    tops, places, before = [], [], []
    for i, v in enumerate(values.tolist()):
        k = bisect.bisect_left(tops, v)
        before.append(places[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            places.append(i)
        else:
            tops[k], places[k] = v, i
    out, i = [], places[-1]
    while i >= 0:
        out.append(i)
        i = before[i]
    return np.array(out[::-1], dtype=np.int64)


def _anchors(x: np.ndarray, y: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the stretches of ``GRAM`` characters that both hold once, at most ``reach`` apart, in an order common to both."""
    hashes = []
    for t in (x, y):
        n = max(0, len(t) - GRAM + 1)
        h = np.zeros(n, dtype=np.uint64)
        for k in range(GRAM if n else 0):
            h = h * np.uint64(0x9E3779B97F4A7C15) + t[k:k + n]
        order = np.argsort(h)
        h = h[order]
        new = np.append(True, h[1:] != h[:-1])[:n]
        once = new & np.append(new[1:], True)[:n]
        hashes.append((h[once], order[once]))
    (hx, i), (hy, j) = hashes
    if not len(hx) or not len(hy):
        return i[:0], i[:0]
    at = np.minimum(np.searchsorted(hy, hx), len(hy) - 1)
    both = hy[at] == hx
    i, j = i[both], j[at[both]]
    keep = np.abs(i - j) <= reach
    i, j = i[keep], j[keep]
    keep = np.ones(len(i), dtype=bool)
    for k in range(GRAM):  # equal hashes are not enough
        keep &= x[i + k] == y[j + k]
    order = np.argsort(i[keep])
    i, j = i[keep][order], j[keep][order]
    chain = _increasing(j) if len(j) else j
    return i[chain], j[chain]


def _bound(a: str, b: str, x: np.ndarray, y: np.ndarray, most: int, reach: int) -> int:
    """The edits of one alignment of the texts, so no less than their edit distance; no more is tried once they are at most ``most``.

    The alignment goes through stretches that both texts hold once; what lies between two of them is
    replaced, inserted or deleted, or aligned in the same way, or exactly if it is short.
    """
    longer = max(len(x), len(y))
    if longer <= most or not len(x) or not len(y):
        return longer
    if longer <= EXACT:
        return _by_bits(*sorted((a, b), key=len), longer)
    i, j = _anchors(x, y, reach)
    if not len(i):
        return longer
    i, j = np.concatenate([[-1], i, [len(x)]]), np.concatenate([[-1], j, [len(y)]])
    di, dj = np.diff(i) - 1, np.diff(j) - 1  # characters between two that are matched
    free = np.minimum(GRAM - 1, np.minimum(di, dj))  # the rest of the stretch
    free[0] = 0
    cost = np.maximum(di, dj) - free
    total = int(cost.sum())
    for k in np.argsort(-cost):
        if total <= most or cost[k] < 2:
            break
        here, there = slice(i[k] + 1 + free[k], i[k + 1]), slice(j[k] + 1 + free[k], j[k + 1])
        old = int(cost[k])
        total += _bound(a[here], b[there], x[here], y[there], most - (total - old), longer) - old
    return total


def edit_distance(a: str, b: str, most: int) -> int | None:
    """Edit distance (code points inserted, deleted, replaced) of whole texts, or None if above ``most``."""
    if abs(len(a) - len(b)) > most:
        return None
    if a == b:
        return 0
    at, to, x, y = _core(a, b)
    return None if _unlikeness(x, y, most) > 1 else _distance(a[at], b[to], x, y, most)


def within(a: str, b: str, most: int) -> bool:
    """Whether ``edit_distance`` is at most ``most``: an alignment that shows it spares the distance itself."""
    if abs(len(a) - len(b)) > most:
        return False
    if a == b:
        return True
    at, to, x, y = _core(a, b)
    unlike = _unlikeness(x, y, most)
    if unlike > 1:
        return False
    a, b = a[at], b[to]
    return unlike < DOUBT and _bound(a, b, x, y, most, most) <= most or _distance(a, b, x, y, most) is not None


def _near(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose whole texts are within ``percent`` of the longer one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = (unpack(batch.column(c)[i].as_py()).decode() for c in ("ta", "tb"))
                most = percent * max(len(x), len(y)) // 100
                if within(x, y, most):
                    keep.append(i)
            keep = pa.array(keep, type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], names=["a", "b"])

    # spread first: comparing takes long, and small tables would make few tasks
    return (pairs.repartition(tasks_for(pairs), "a", "b").join(texts.select(F.col("id").alias("a"), F.col("packed").alias("ta")), "a")
            .join(texts.select(F.col("id").alias("b"), F.col("packed").alias("tb")), "b")
            .select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary"))


def _packed(rows: DataFrame) -> DataFrame:
    """id and compressed text."""
    def run(batches):
        pack = zstandard.ZstdCompressor().compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array([pack(t.encode()) for t in batch.column("text").to_pylist()], type=pa.binary())],
                names=["id", "packed"])

    return rows.mapInArrow(run, "id binary, packed binary")


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """``labels`` (id, component) with the components of ``links`` (a, b) joined; only the components that links join are walked."""
    if links.isEmpty():
        return labels
    if labels is None:
        return components(links)
    new = links.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(labels, "id", "left_anti")
    labels = stage(labels.union(new.select("id", F.col("id").alias("component"))), "edit-labels")
    named = (links.join(labels.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a")
             .join(labels.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b").filter("ca != cb"))
    moved = components(named.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
    moved = moved.select(F.col("id").alias("component"), F.col("component").alias("to"))
    return stage(labels.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component")), "edit-labels")


def _apart(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The (a, b) of ``pairs`` in two components."""
    if labels is None:
        return pairs
    return (pairs.join(labels.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left")
            .join(labels.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
            .filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"))


def _may_link(percent: int) -> Column:
    """Whether texts (n, counts and cn, ccounts) can be within ``percent`` of the longer one; never false for a link."""
    most = F.floor(F.greatest("n", "cn") * percent / 100)
    more = F.aggregate(F.zip_with("counts", "ccounts", lambda x, y: F.greatest(x.cast("int") - y.cast("int"), F.lit(0))), F.lit(0), lambda t, v: t + v)
    less = F.aggregate(F.zip_with("counts", "ccounts", lambda x, y: F.greatest(y.cast("int") - x.cast("int"), F.lit(0))), F.lit(0), lambda t, v: t + v)
    return (F.abs(F.col("n") - F.col("cn")) <= most) & (more <= 2 * most) & (less <= 2 * most)


def edit_classes(prints: DataFrame, docs: DataFrame, percent: int = PERCENT, walks: int = WALKS, samples: int = SAMPLES,
                 seed: int = SEED) -> DataFrame:
    """id (of the text: the first bytes of its text_sha256), class_id of every text of ``prints`` (written rows of ``edit_fingerprints`` over ``docs``).

    Two texts are linked if they share a band and 100 * edit distance <= percent * length of the longer;
    a class is what links reach, its id the smallest doc_id (null if all its ids are).
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = _walks(walks, samples, seed)
        for batch in batches:
            keys = [w.bands(f) for f in batch.column("fingerprint").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "doc_id", "n", "counts")), pa.array(keys, type=pa.list_(pa.string()))],
                                             names=["id", "doc_id", "n", "counts", "keys"])

    # of a text its bands are kept, as hashes: a band that meets another by chance brings candidates, which are verified
    own = stage(prints.groupBy(F.substring("text_sha256", 1, ID_BYTES).alias("id"))
                .agg(F.min("doc_id").alias("doc_id"), F.first("n_chars").alias("n"), F.first("counts").alias("counts"),
                     F.first("fingerprint").alias("fingerprint"))
                .mapInArrow(cut, "id binary, doc_id long, n long, counts array<tinyint>, keys array<string>")
                .withColumn("keys", F.array_distinct(F.transform("keys", lambda k: F.xxhash64(k)))), "edit-texts", "zstd")
    members = own.filter("n > 0").select("id", F.explode("keys").alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    members = stage(members.join(shared, "key").select("key", "id", "size"), "edit-buckets")
    # the texts that meet another, with the bands where they do; popular: how many they meet
    met = members.groupBy("id").agg(F.sum("size").alias("popular"), F.array_sort(F.collect_list("key")).alias("met"))
    met = stage(met.join(own.select("id", "n", "counts"), "id"), "edit-met", "zstd")
    at_once = AT_ONCE * met.count()
    plain = docs.select(F.substring(F.unhex(F.sha2(text_or_empty().cast("string"), 256)), 1, ID_BYTES).alias("id"),
                        text_or_empty().cast("string").alias("text"))

    def linked(pairs: DataFrame, labels: DataFrame | None) -> DataFrame | None:
        """``labels`` with the links among ``pairs``, which are compared in slices."""
        slices = -(-pairs.count() // max(at_once, 1))
        if not slices:
            return labels
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        # compressed before they are shuffled
        texts = _packed(plain.join(F.broadcast(ids), "id", "left_semi")) if ids.count() <= SENT_IDS else _packed(plain).join(ids, "id", "left_semi")
        texts = stage(texts.groupBy("id").agg(F.first("packed").alias("packed")), "edit-packed")
        for k in range(slices):
            part = pairs if slices == 1 else _apart(pairs.filter(F.pmod(F.xxhash64("a", "b"), F.lit(slices)) == k), labels)
            labels = _merged(labels, stage(_near(part, texts, percent), "edit-links"))
        return labels

    # texts whose lengths differ more than a link's distance are no link
    near = F.abs(F.col("n") - F.col("cn")) * 100 <= F.greatest("n", "cn") * percent
    labels, tested = None, None
    for step in ("best", "star", "all"):
        texts = met if labels is None else met.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        if labels is None:
            texts = texts.withColumn("component", F.col("id"))
        # buckets whose texts are in one component are done
        inside = texts.select("id", "component", "popular", "n", F.explode("met").alias("key"))
        mixed = inside.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
        if step == "all":
            # of a bucket the largest component; texts of two others are paired once, by their ids
            sizes = inside.join(mixed, "key").groupBy("key", "component").count()
            largest = sizes.groupBy("key").agg(F.max(F.struct("count", "component")).alias("most")).select("key", F.col("most.component").alias("largest"))
            # of each text the buckets that are left; its counts join it, not its rows in all buckets
            left = texts.select("id", F.explode("met").alias("key")).join(largest, "key").groupBy("id").agg(F.collect_list(F.struct("key", "largest")).alias("left"))
            left = stage(texts.select("id", "component", "n", "counts").join(left, "id"), "edit-left", "zstd")
            inside = (left.withColumn("met", F.col("left.key")).withColumn("in", F.explode("left"))
                      .select("id", "component", "n", "counts", "met", "in.key", "in.largest"))
            centers = (inside.filter("component != largest")
                       .select(F.col("key").alias("ckey"), F.col("id").alias("cid"), F.col("n").alias("cn"), F.col("counts").alias("ccounts"),
                               F.col("met").alias("cmet"), F.col("component").alias("cc")))
            once = (F.col("component") == F.col("largest")) | (F.col("cid") < F.col("id"))
            first = F.array_min(F.array_intersect("met", "cmet")) == F.col("key")  # of the buckets that both are in
            pairs = (inside.join(centers, (F.col("key") == F.col("ckey")) & (F.col("component") != F.col("cc")) & once & near & first & _may_link(percent))
                     .select(F.least("id", "cid").alias("a"), F.greatest("id", "cid").alias("b")))
        else:
            inside = inside.join(mixed, "key")
            centers = (inside.groupBy("key").agg(F.max(F.struct("popular", "id", "n", "component")).alias("c"))
                       .select(F.col("key").alias("ckey"), F.col("c.id").alias("cid"), F.col("c.n").alias("cn"), F.col("c.component").alias("cc")))
            pairs = inside.join(centers, (F.col("key") == F.col("ckey")) & (F.col("component") != F.col("cc")) & near).select("id", "cid")
            if step == "best":
                pairs = (pairs.groupBy("id", "cid").count().groupBy("id").agg(F.max(F.struct("count", "cid")).alias("best"))
                         .select("id", F.col("best.cid").alias("cid")))
            pairs = pairs.distinct()
            pairs = (pairs.join(met.select("id", "n", "counts"), "id")
                     .join(met.select(F.col("id").alias("cid"), F.col("n").alias("cn"), F.col("counts").alias("ccounts")), "cid").filter(_may_link(percent))
                     .select(F.least("id", "cid").alias("a"), F.greatest("id", "cid").alias("b")).distinct())
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stage(pairs, "edit-pairs")
        tested = pairs if tested is None else tested.union(pairs)
        labels = linked(pairs, labels)
    if labels is None:
        return own.select("id", F.col("doc_id").alias("class_id"))
    rows = own.select("id", "doc_id").join(labels, "id", "left").select("id", "doc_id", F.coalesce("component", "id").alias("component"))
    least = rows.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    return rows.join(least, "component").select("id", "class_id")


def with_classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``edit_fingerprints`` of each row and class_id, see ``edit_classes``."""
    # both fingerprints in one column: most of the second repeats the first, which compression finds
    both = F.concat_ws("|", "fingerprint", "edited_fingerprint").alias("both")
    rows = edit_fingerprints(docs)
    prints = stage(rows.select(*[both if c == "fingerprint" else F.col(c) for c in rows.columns if c != "edited_fingerprint"]), "edit-prints", "zstd")
    parts = F.split("both", "[|]")
    prints = prints.select(*[x for c in prints.columns for x in ([parts[0].alias("fingerprint"), parts[1].alias("edited_fingerprint")] if c == "both" else [F.col(c)])])
    return (prints.withColumn("id", F.substring("text_sha256", 1, ID_BYTES)).join(edit_classes(prints, docs, percent), "id")
            .drop("id", "text_sha256", "counts"))
