"""The dealt queries over the given tables: ``QUERIES`` and their DuckDB ``ORACLES``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path
from .batches import table
from .editwalk import with_classes
from .langid import fit_profiles, held_out, predict_language
from .linededup import LineIndex
from .minhash import near_duplicates
from .mixing import mix_sources
from .orc_ids import checksums, read_ids, write_ids
from .runs import periodic_runs
from .secret_scan import RULES as SECRET_RULES
from .secret_scan import find_secrets, span_text
from .token_counts import token_counts
from .toxicity import fit_toxicity, score_toxicity
from .urlmodel import judge_urls
from .whitening import whiten
from .winnow import contamination


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Randomised edit embedding of every document and its edited text, and its class of near copies."""
    return with_classes(table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by rank-order profiles, learned from the rows not held out."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out("doc_id", 4, 2))
    return predict_language(docs, fit_profiles(docs.filter("not held_out")), keep=("doc_id", "held_out"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document over a trigram index."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    base = [r.kind for r in SECRET_RULES if r.base]

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, base),
        F.sha2(span_text(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winnowed benchmark passages in every document."""
    hits = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                       (F.col("n_hit") > 0).alias("contaminated"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document by the file's merge rule, and unigram piece counts over its scores."""
    return token_counts(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url: by rule, else by the character models."""
    return judge_urls(table(spark, sf_dir, "pages"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labelled rows not held out."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out("doc_id", 5, 0))
    field = fit_toxicity(docs.filter("not held_out"), table(spark, sf_dir, "labels"))
    return (score_toxicity(docs, field, keep=("doc_id", "held_out"))
            .select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans"))


def token_id_table(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of ``docs`` from an ORC copy of their token ids."""
    path = shared_path(spark, "token-ids")
    write_ids(docs, path, _tokenizer("byte_bpe_50k.json"))
    return checksums(read_ids(spark, path))


def op10_orc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written as ORC and read back."""
    return token_id_table(spark, table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings on the first four whitened components, over a bit-sliced scatter matrix."""
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


def repeated_tail(text: Column, doc_id: Column) -> Column:
    """The text with its words from a on replaced by repeats of the words a .. a + p - 1, for one id in ten (see op12)."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def tail(w: Column, a: Column, p: Column) -> Column:
        return F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.size(w) - 1),
                                            lambda i: F.get(w, F.when(i < a, i).otherwise((a + (i - a) % p).cast("int")))))

    def edited(w: Column) -> Column:
        n, a = F.size(w), g % F.size(w)
        return F.when(n > 0, tail(w, a, 1 + F.floor((n - a) / (3 + g % 8))))

    # transform over an array of one binds the words once
    return F.when(h % 10 == 0, F.get(F.transform(F.array(words), edited), F.lit(0))).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document, one id in ten with a repeated tail."""
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs(docs.select("doc_id", repeated_tail(F.col("text"), F.col("doc_id")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that later documents hold as well, over a line index."""
    docs = table(spark, sf_dir, "documents")
    index = LineIndex(shared_path(spark, "line-index")).insert(docs)
    return index.apply(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    fn.__name__: fn
    for fn in (op1_edit_fingerprints, op2_language, op3_secrets, op4_decontaminate, op5_token_counts, op6_url_filter,
               op7_mix_sources, op8_minhash, op9_toxicity, op10_orc_ids, op11_whitening, op12_periodic_runs, op13_line_dedup)
}

_FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op4_decontaminate": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(10, len(w)) AS n, w[p : p + least(10, len(w)) - 1] AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS p FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, p, n, w[p : p + n - 1] AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lengths WHERE len(w) >= n)),
occ AS (SELECT DISTINCT doc_id, p, dw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op8_minhash": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[p : p + 4] AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT x.a, x.b FROM (SELECT s.doc_id AS a, t.doc_id AS b, count(*) AS i FROM s JOIN s AS t ON s.g = t.g AND s.doc_id <> t.doc_id GROUP BY 1, 2) AS x
          JOIN n AS na ON na.doc_id = x.a JOIN n AS nb ON nb.doc_id = x.b WHERE 100 * i >= 75 * (na.n + nb.n - i)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM c LEFT JOIN n USING (doc_id)""",
    "op12_periodic_runs": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
                  -- crc32 bit by bit: every byte of the decimal id, then seven zeros
                  xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
                      lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
                      lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) AS h FROM documents),
a AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS tail, (h // 10) % greatest(len(w), 1) AS a, h // 10 AS g FROM d),
t AS (SELECT doc_id, n, CASE WHEN tail THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w FROM a),
x AS (SELECT doc_id, n, unnest(range(0, n)) AS i, unnest(w) AS word FROM t),
same AS (SELECT l.doc_id, l.i, r.i - l.i AS q FROM x AS l JOIN x AS r ON l.doc_id IS NOT DISTINCT FROM r.doc_id AND l.word = r.word AND r.i > l.i AND 4 * (r.i - l.i) <= l.n),
stretch AS (SELECT doc_id, q, min(i) AS s, max(i) + q + 1 AS e
            FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same) GROUP BY doc_id, q, island),
runs AS (SELECT doc_id, s, e, min(q) AS q FROM stretch WHERE e - s >= greatest(6, 4 * q) GROUP BY doc_id, s, e),
told AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q) AS listed,
                min(ROW(s - e, s, q)) AS best, list(ROW(s + q, e)) AS gone FROM runs GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept
         FROM x LEFT JOIN told USING (doc_id) WHERE gone IS NULL OR len(list_filter(gone, lambda r: r[1] <= i AND i < r[2])) = 0 GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(best[2] AS BIGINT) AS start, CAST(-best[1] AS BIGINT) AS length, CAST(best[3] AS BIGINT) AS period,
       CAST(1000 * -best[1] // best[3] AS BIGINT) AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op13_line_dedup": r"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, p, lines[p] AS line, translate(trim(lines[p], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS p FROM t)),
k AS (SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT doc_id, p, line, last IS NOT NULL AND last <> doc_id AS gone FROM l LEFT JOIN k USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
}
