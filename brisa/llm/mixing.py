"""Mixing sources to target weights by Sainte-Laguë apportionment.

Each source's documents are laid end to end in seeded order, in shards of bounded size,
and cut into blocks of equal tokens.  Blocks are the seats: sources get theirs by highest
quotients target / (2 k + 1), and a source's seats go on to its shards the same way, so
every shard has an integer quota.  A quota above the shard's blocks takes all of them
as often as it can; the rest is a seeded selection.  What a document gives follows
from the blocks it overlaps, computed from its place in the shard without listing blocks.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import stage

BLOCK, SHARD_DOCS, MOST, SEED = 64, 20_000, 3, 5
#: a prime above any shard's number of blocks: multiplying by it permutes them
PRIME = (1 << 31) - 1


def word_count(text: str = "text"):
    """Number of words `[^\\x20\\x09-\\x0D]+`; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def reshared_targets(sizes: list[int], weights: list[int], most: int = MOST) -> list[Fraction]:
    """Shares of the whole by weight, at most ``most`` times each size; the excess is reshared until none is above."""
    total, fixed = sum(sizes), {}
    while True:
        left = total - sum(fixed.values())
        open_weight = sum(w for i, w in enumerate(weights) if i not in fixed)
        share = {i: Fraction(left * w, open_weight) for i, w in enumerate(weights) if i not in fixed} if open_weight else {}
        above = [i for i, t in share.items() if t > most * sizes[i]]
        if not above:
            return [fixed.get(i, share.get(i)) for i in range(len(sizes))]
        fixed |= {i: Fraction(most * sizes[i]) for i in above}


def sainte_lague(weights: np.ndarray, seats: int, caps: np.ndarray) -> np.ndarray:
    """Seats by highest quotients weight / (2 k + 1), never above the caps; ties go to the first.

    Quotients above a divisor are counted at once, the last few seats one by one.
    """
    weights = np.asarray(weights, dtype=np.float64)
    seats = min(int(seats), int(caps[weights > 0].sum()))
    if seats <= 0:
        return np.zeros(len(weights), dtype=np.int64)

    def given(divisor):
        return np.minimum(np.floor(weights / divisor + 0.5), caps).astype(np.int64)  # cut first: a small divisor leaves no long

    low, high = 0.0, 4.0 * weights.sum()  # given(high) is below the seats; shrink from there
    for _ in range(80):
        mid = (low + high) / 2
        if mid > 0 and given(mid).sum() <= seats:
            high = mid
        else:
            low = mid
    out = given(high)
    queue = [(-w / (2 * k + 1), i) for i, (w, k, c) in enumerate(zip(weights.tolist(), out.tolist(), caps.tolist())) if w > 0 and k < c]
    heapq.heapify(queue)
    for _ in range(seats - int(out.sum())):
        _, i = heapq.heappop(queue)
        out[i] += 1
        if out[i] < caps[i]:
            heapq.heappush(queue, (-weights[i] / (2 * out[i] + 1), i))
    return out


def mix_sources(docs: DataFrame, block: int = BLOCK, shard_docs: int = SHARD_DOCS, most: int = MOST, seed: int = SEED,
                keep: tuple[str, ...] = ()) -> DataFrame:
    """What the mix takes of every row of ``docs`` (doc_id, text, source).

    doc_id, source, size, source_size, target; taken (words, repeats counted); copies
    (whole ones) and ranges (first, last: the words of the selected blocks, end exclusive).

    Sources in code point order, null last, weigh 1, 2, 3, 1, 2, 3, ...  Null and wordless texts
    have size 0 and give nothing.  Rows of one doc_id are placed one after the other.  An
    empty table gives an empty result.  Other columns are ignored.  One row per source comes
    to the driver.
    """
    sized = stage(docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"), *keep), "mix-sizes")
    spark = docs.sparkSession
    sources = sorted(((r.source, r.words, r.docs) for r in sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("docs")).collect()),
                     key=lambda r: (r[0] is None, r[0] or ""))
    targets = reshared_targets([w for _, w, _ in sources], [k % 3 + 1 for k in range(len(sources))], most)
    info = spark.createDataFrame(
        [(s, k, int(w), float(t), -(-n // shard_docs)) for k, ((s, w, n), t) in enumerate(zip(sources, targets))],
        "name string, k int, source_size long, target double, shards long")
    placed = (sized.join(info, sized["source"].eqNullSafe(info["name"])).drop("name")
              .withColumn("turn", F.xxhash64("doc_id", F.lit(seed)))
              .withColumn("shard", F.pmod(F.xxhash64("turn"), F.col("shards"))))
    cells = placed.groupBy("k", "shard").agg(F.sum("size").alias("words"))
    cells = stage(cells.withColumn("blocks", F.ceil(F.col("words") / block)), "mix-shards")
    held = {r.k: r.blocks for r in cells.groupBy("k").agg(F.sum("blocks").alias("blocks")).collect()}
    blocks = np.array([held.get(k, 0) for k in range(len(sources))], dtype=np.int64)
    wished = [t * int(b) / w if w else Fraction(0) for t, b, (_, w, _) in zip(targets, blocks, sources)]  # in blocks
    seats = sainte_lague(np.array([float(x) for x in wished]), round(sum(wished)), most * blocks)
    quotas = spark.createDataFrame([(k, int(q)) for k, q in enumerate(seats)], "k int, seats long")

    def shard_quotas(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard", ignore_index=True)
        b = pdf["blocks"].to_numpy()
        return pdf[["k", "shard", "words", "blocks"]].assign(quota=sainte_lague(b, int(pdf["seats"].iloc[0]), most * b))

    shards = stage(cells.join(quotas, "k").groupBy("k").applyInPandas(shard_quotas, "k int, shard long, words long, blocks long, quota long"), "mix-quotas")
    line = Window.partitionBy("k", "shard").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = (placed.withColumn("start", F.coalesce(F.sum("size").over(line), F.lit(0)))
            .join(shards, ["k", "shard"]).withColumn("shift", F.pmod(F.xxhash64("k", "shard", F.lit(seed)), F.greatest("blocks", F.lit(1)))))
    # the selected blocks that the document overlaps, as word ranges of the document
    picked = F.when(F.col("size") > 0, F.expr(f"""transform(
        filter(sequence(((start + 1) * blocks - 1) div words, ((start + size) * blocks - 1) div words),
               b -> pmod({PRIME}L * b + shift, blocks) < quota % blocks),
        b -> struct(greatest(start, b * words div blocks) - start as first, least(start + size, (b + 1) * words div blocks) - start as last))"""))
    rows = (rows.withColumn("copies", F.when(F.col("size") > 0, F.expr("quota div blocks")).otherwise(F.lit(0)).cast("long"))
            .withColumn("ranges", F.coalesce(picked, F.array().cast("array<struct<first:bigint,last:bigint>>"))))
    taken = F.col("size") * F.col("copies") + F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"])
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "copies", "ranges", *keep)


def mixed_documents(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row per whole copy of a document, and one of its selected blocks.

    Documents of which nothing is taken go.  A row of selected blocks holds their words
    in order, with the white space behind each; ``n_chars``, if there, is counted anew.  Other
    columns may have any names but those that begin with ``__mix_``.
    """
    tag = "__mix_row"
    marked = stage(docs.withColumn(tag, F.monotonically_increasing_id()), "mix-rows")
    plan = (mix_sources(marked.select("doc_id", "source", F.col(text).alias("text"), tag), keep=(tag,), **options).filter("taken > 0")
            .select(tag, F.col("copies").alias("__mix_copies"), F.col("ranges").alias("__mix_ranges")))
    rows = marked.join(plan, tag)
    whole = rows.filter("__mix_copies > 0").withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies").cast("int")))).select(*docs.columns)
    # the words are bound as the variable of a transform: as a column they would be split anew for every range
    words = F.regexp_extract_all(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    part = F.get(F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform(
        "__mix_ranges", lambda r: F.slice(w, (r["first"] + 1).cast("int"), (r["last"] - r["first"]).cast("int")))), "")), F.lit(0))
    some = (rows.filter(F.exists("__mix_ranges", lambda r: r["last"] > r["first"]))
            .withColumn(text, part.cast(docs.schema[text].dataType)).select(*docs.columns))
    if n_chars in docs.columns:
        some = some.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType))
    return whole.unionByName(some)
