"""The registered queries against plain brute force on the smallest table."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest

import __spark_entry__ as entry
from made import SF001

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF001}/documents.parquet").toPandas().sort_values("doc_id", ignore_index=True)


def rows_of(spark, name):
    out = entry.queries()[name](spark, SF001).toPandas()
    key = "page_id" if "page_id" in out else "doc_id"
    return out.sort_values(key, ignore_index=True)


def test_fingerprints(spark, docs):
    out = rows_of(spark, "op1_edit_fingerprints")
    texts = docs.text.fillna("").tolist()
    assert out.n_chars.tolist() == [len(t) for t in texts]
    for k, t in enumerate(texts):
        cut, other = len(t) // 4, texts[(k + 1) % len(texts)]
        edited = t[:len(t) - cut] + other[:cut]
        assert out.edited_sha256[k] == hashlib.sha256(edited.encode()).hexdigest()
    assert out.near_edited.between(0, 1).all() and out.near_next.between(0, 1).all()
    assert out.near_edited.median() > out.near_next.median() + 0.3
    for _, group in out.assign(text=texts).groupby("text"):
        assert group.fingerprint.nunique() == 1


def test_language_held_out(spark, docs):
    out = rows_of(spark, "op2_language")
    held = [zlib.crc32(str(i).encode()) % 4 == 2 for i in docs.doc_id]
    assert out.held_out.tolist() == held
    judged = docs.assign(pred=out.lang_pred)[out.held_out & docs.lang.notna() & (out.lang_pred != "und")]
    assert (judged.pred == judged.lang).mean() > 0.9
    assert out.score.between(0, 1).all()


def base_spans(text):
    spans = []
    for order, (kind, pattern, least) in enumerate((
            ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
            ("access", r"(AKIA[A-Z0-9]+)", 20), ("hex", r"([0-9a-f]+)", 24))):
        for m in re.finditer(pattern, text, re.A):
            if len(m.group(1)) >= least:
                spans.append((m.start(), order, kind, m.end()))
    return sorted(spans)


def test_secrets(spark, docs):
    out = rows_of(spark, "op3_secrets")
    for k, text in enumerate(docs.text.fillna("")):
        want = base_spans(text)
        for kind in ("assign", "access", "hex"):
            assert out[f"n_{kind}"][k] == sum(s[2] == kind for s in want)
        joined = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in want)
        assert out.base_sha256[k] == hashlib.sha256(joined.encode()).hexdigest()


def benchmark_hits(texts, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i:i + n])].add(str(item))
    lengths = {len(w) for w in windows}
    for text in texts:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        yield len(w), len(hit), sorted(found)


def test_decontamination(spark, docs):
    out = rows_of(spark, "op4_decontaminate")
    items = spark.read.parquet(f"{SF001}/benchmark.parquet").select("item_id", "text").collect()
    for k, (n, hit, found) in enumerate(benchmark_hits(docs.text, items)):
        assert (out.n_words[k], out.n_hit[k], out.n_items[k], out.contaminated[k]) == (n, hit, len(found), hit > 0)
        assert out.items_sha256[k] == hashlib.sha256(",".join(found).encode()).hexdigest()


def test_token_counts(spark, docs):
    from test_token_counts import library
    out, counted = rows_of(spark, "op5_token_counts"), library()
    for k, text in enumerate(docs.text.fillna("")):
        if "<" not in text and "▁" not in text:
            assert out.n_pieces[k] == counted(text), text


def test_url_filter(spark):
    out = rows_of(spark, "op6_url_filter")
    pages = spark.read.parquet(f"{SF001}/pages.parquet").select("page_id", "url").toPandas().sort_values("page_id", ignore_index=True)
    rules = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
    for k, url in enumerate(pages.url):
        host, path = "", ""
        if url is not None and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host):])[0]
            host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
        assert (out.host[k], out.path[k]) == (host, path)
        assert out.rule[k] == (best[1] + best[2]) if best else out.rule[k] is None
        assert out.verdict[k] == best[0] if best else out.verdict[k] in ("allow", "block")


def test_mix(spark, docs):
    out = rows_of(spark, "op7_mix_sources")
    assert out["size"].tolist() == [len(WORD.findall(t or "")) for t in docs.text]
    assert (out.taken <= 3 * out["size"]).all()
    for _, g in out.assign(source=docs.source.fillna("~")).groupby("source"):
        assert (g.source_size == g["size"].sum()).all()
        assert abs(g.taken.sum() - g.target.iloc[0]) <= max(256, 0.02 * g.target.iloc[0])
    again = rows_of(spark, "op7_mix_sources")
    assert out.taken.tolist() == again.taken.tolist()


def near_groups(texts):
    sets = []
    for t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = defaultdict(set)
    for i, s in enumerate(sets):
        for g in s:
            where[g].add(i)
    for i, s in enumerate(sets):
        for j in {j for g in s for j in where[g] if j > i}:
            if 100 * len(s & sets[j]) >= 75 * len(s | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [len(s) for s in sets], [find(i) for i in range(len(sets))]


def test_near_dedup(spark, docs):
    out = rows_of(spark, "op8_minhash")
    sizes, roots = near_groups(docs.text)
    assert out.n_shingles.tolist() == sizes
    assert out.component_id.tolist() == [docs.doc_id[r] for r in roots]
    assert out.kept.tolist() == [r == i for i, r in enumerate(roots)]


def test_toxicity(spark, docs):
    out = rows_of(spark, "op9_toxicity")
    assert out.held_out.tolist() == [zlib.crc32(str(i).encode()) % 5 == 0 for i in docs.doc_id]
    assert out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.5)).all()
    assert not out.isna().any().any()


def test_token_ids(spark, docs):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer
    out, tok, start = rows_of(spark, "op10_orc_ids"), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    for k, text in enumerate(docs.text.fillna("")):
        ids = tok.encode(text, add_special_tokens=False).ids + [0]
        assert (out.start[k], out.n_tokens[k], out.ids_crc32[k]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
