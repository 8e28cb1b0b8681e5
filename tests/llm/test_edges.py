"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasegrid.llm import components as comp
from phasegrid.llm import hpyp, quality, simhash, substring, warc
from phasegrid.llm.bpe import bpe_decode, bpe_encode, bpe_round_trip
from phasegrid.llm.embed_dedup import embedding_dedup
from phasegrid.llm.fingerprint import combine, fingerprint_documents, from_hex, lanes, likeness, to_hex
from phasegrid.llm.html_extract import extract_main_text
from phasegrid.llm.mixing import mix_sources, taken_words
from phasegrid.llm.store import new_path

WORD = r"[^\x20\x09-\x0D]+"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return re.findall(WORD, t or "")


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdeé"), 5))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = text(60)
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (4, "one", "b"), (5, "one two", "b"), (6, text(30) + "\n" + shared + " " + text(10), "a")]
    rows += [(7, shared.replace(" ", "  "), "a"), (8, text(49), None), (9, shared + "\v" + shared, "c"), (9, shared + "\v" + shared, "c"), (10, text(70_000), "b"), (None, shared + " tail", "c"), (12, "ÀÉ Ü x\x00y", "c"), (11, "same words here now ok", "a"), (13, "same words here now ok", "b")]
    return rows


def test_substring_brute_force(spark, odd):
    for hot in (4000, 1):
        substring.HOT_LEAST = hot
        got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.substring_dedup(make(spark, odd).withColumn("kept", F.lit(1)).withColumn("_key", F.lit(2))).collect())
        first = {}
        key = lambda i: (1 << 63) - 1 if i is None else i
        for i, t, _ in odd:
            w = words(t)
            for k in range(len(w) - 49):
                x = tuple(w[k : k + 50])
                first[x] = min(first.get(x, key(i)), key(i))
        want = Counter()
        for i, t, _ in odd:
            w, gone = words(t), set()
            for k in range(len(w) - 49):
                if first[tuple(w[k : k + 50])] < key(i):
                    gone.update(range(k, k + 50))
            want[(i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))] += 1
        assert got == want
    substring.HOT_LEAST = 4000


def test_simhash_brute_force(spark, odd):
    import xxhash

    got = [(r.doc_id, r.fingerprint % (1 << 64), r.component_id) for r in simhash.simhash_dedup(make(spark, odd)).collect()]

    def print_of(t):
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))

    f = [print_of(t) for _, t, _ in odd]
    up = list(range(len(f)))
    for _ in f:
        for i in range(len(f)):
            for j in range(len(f)):
                if (f[i] ^ f[j]).bit_count() <= 2:
                    up[i] = up[j] = min(up[i], up[j])
    want = []
    for k, (i, _, _) in enumerate(odd):
        ids = [odd[m][0] for m in range(len(f)) if up[m] == up[k] and odd[m][0] is not None]
        want.append((i, f[k], min(ids) if ids else None))
    order = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(got, key=order) == sorted(want, key=order)
    kept = [r.doc_id for r in simhash.one_of_each(make(spark, odd), simhash.simhash_dedup(make(spark, odd))).collect()]
    assert sorted(kept) == sorted({c for _, _, c in want})


def test_bk_tree_and_hot_shards(spark):
    rng = np.random.default_rng(1)
    base = int(rng.integers(0, 1 << 62))
    values = {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 60, (300, 2))} | {int(x) for x in rng.integers(0, 1 << 62, 200)}
    values = sorted(values)
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for v in values[:50]:
        assert {tree.values[i] for i in tree.within(v, 2)} == {x for x in values if (x ^ v).bit_count() <= 2}
    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in values], "fingerprint long"), 2, leaf=16)
    got = {r.node: r.component for r in comp.components(links).collect()}
    union = simhash.Union(len(values))
    for i, v in enumerate(values):
        for j in range(i):
            if (values[j] ^ v).bit_count() <= 2:
                union.join(i, j)
    for i, v in enumerate(values):
        mates = [values[j] for j in range(len(values)) if union.top(j) == union.top(i)]
        assert got.get(v, v) == min(mates)


def test_components_chain(spark):
    n = 300
    links = spark.createDataFrame([(i + 1, i) for i in range(n)] + [(1000, 1001), (1001, 1000), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in comp.components(links).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}
    assert comp.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bpe_against_library(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rows = [*odd, (20, "a<|endoftext|>b  c<|endoftext|>", "a"), (21, "it's  we'LL 12³   \U0001f600́", "a")]
    docs = make(spark, rows).withColumn("decoded", F.lit("x"))
    both = bpe_decode(bpe_encode(docs, path), path).collect()
    packed = bpe_round_trip(docs, path).collect()
    assert len(both) == len(packed) == len(rows)
    for r in both:
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == lib.decode(ids, skip_special_tokens=False)
    for r in packed:
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids_packed, "<u4").tolist() == ids and r.decoded == (r.text or "")


def test_fingerprints(spark, odd, monkeypatch):
    from phasegrid.llm import fingerprint

    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 3)
    got = fingerprint_documents(make(spark, odd)).withColumn("hex", to_hex(F.col("lanes"))).collect()
    docs = sorted(((i, t or "") for i, t, _ in odd), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want = Counter()
    for k, (i, t) in enumerate(docs):
        q = len(t) // 4
        e = t[: len(t) - q] + docs[(k + 1) % len(docs)][1][:q]
        want[(i, len(t), hashlib.sha256(e.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    by = {r.doc_id: r for r in got}
    assert by[11].lanes == by[13].lanes and by[1].lanes == by[2].lanes and all(0 <= r.near_edited <= 1 for r in got)
    assert by[10].near_edited > 0.5 > by[10].near_next
    t = spark.createDataFrame([(1, "p one\nq two\nr"), (2, "r\nq two\np one"), (3, "p one\nr"), (4, "q two")], "id int, t string")
    v = {r.id: r for r in lanes(t, ["id"], "t").withColumn("hex", to_hex(F.col("lanes"))).collect()}
    assert v[1].lanes == v[2].lanes
    both = spark.createDataFrame([(v[3].hex, v[4].hex, v[1].hex)], "a string, b string, c string").select(combine(from_hex(F.col("a")), from_hex(F.col("b"))).alias("sum"), combine(from_hex(F.col("c")), from_hex(F.col("b")), -1).alias("less"), likeness(from_hex(F.col("c")), from_hex(F.col("c"))).alias("same")).first()
    assert both.sum == v[1].lanes and both.less == v[3].lanes and both.same == 1


def test_mixing(spark, odd):
    rows = [*odd, *((100 + i, "w " * (3 + i % 7), "tiny") for i in range(40))]
    docs = make(spark, rows).withColumn("size", F.lit("clash")).withColumn("_q", F.lit(0))
    a = mix_sources(docs)
    got = a.select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    again = mix_sources(docs.repartition(3)).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert Counter(got) == Counter(again) and len(got) == len(rows)
    src = sorted({s for _, _, s in rows if s is not None}) + [None]
    size = {s: sum(len(words(t)) for _, t, x in rows if x == s) for s in src}
    weight = {s: 1 + k % 3 for k, s in enumerate(src)}
    stop = {s for s in src if not size[s]}
    while True:
        free = [s for s in src if s not in stop]
        level = (sum(size.values()) - sum(3 * size[s] for s in stop)) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * size[s]]
        if not over:
            break
        stop.update(over)
    for s in src:
        mine = [r for r in got if r.source == s]
        want = 3 * size[s] if s in stop else level * weight[s]
        assert all(abs(r.target - want) < 1e-6 * max(1, want) and r.source_size == size[s] for r in mine)
        assert abs(sum(r.taken for r in mine) - want) <= 24
    assert all(r.taken <= 3 * r["size"] for r in got)
    texts = taken_words(docs).collect()
    assert sum(len(words(r.text)) for r in texts) == sum(r.taken for r in got)


def test_scores(spark, odd):
    import math

    got = hpyp.hpyp_scores(make(spark, odd).select("doc_id", "text"), part_bytes=100_000).collect()
    low = lambda t: words(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t, _ in odd if not held(i) for w in low(t))
    n, v = sum(c.values()), len(c)
    want = Counter((i, held(i), len(low(t)), sum(c[w] > 0 for w in low(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in low(t)), 4)) for i, t, _ in odd)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score <= 0 for r in got)
    assert hpyp.hpyp_scores(spark.createDataFrame([], DOCS)).count() == 0


def test_warc_round_trip(spark):
    big, mid = "<p>" + "x" * 3000, "é" * 400
    rows = [(1, "http://a/1", big), (2, None, big), (3, "http://a/\n3", None), (4, "http://a/4", ""), (5, "u", mid), (6, "u", mid), (7, "u", mid + "é" * 200), (9, "u", mid + "é" * 200), (8, "u", mid + "é" * 200), (None, "u", big), (10, "u", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("shard", F.lit("clash"))
    out = new_path(spark, "warc-test")
    m = warc.write_warc(pages, out, shard_bytes=4000, roll_bytes=300).collect()
    assert len({x.path for x in m}) == len(m) > 2
    got = {(r.page_id, r.payload_bytes): r for r in warc.read_warc(spark, out).collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        raw = (h or "").encode()
        r = got[(i, len(raw))]
        same = [j for j, _, x in rows if (x or "").encode() == raw and j is not None]
        to = max(same) if len(raw) >= 1000 and max(same) != i else None
        assert (r.record_type, r.refers_to, r.payload_digest) == ("revisit" if to else "response", to, hashlib.sha1(raw).hexdigest())
        assert r.html == (None if to else h or "")
    again = new_path(spark, "warc-test")
    n = warc.write_warc(pages.repartition(3), again, shard_bytes=4000, roll_bytes=300).collect()
    assert sorted((x.path, x.sha1) for x in m) == sorted((x.path, x.sha1) for x in n)
    empty = new_path(spark, "warc-test")
    warc.write_warc(pages.limit(0), empty)
    assert warc.read_warc(spark, empty).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    center = rng.standard_normal((6, 48))
    v = [(i, (center[i % 6] + rng.standard_normal(48) * (0.02 + 0.3 * (i % 3))).tolist(), i % 2) for i in range(150)]
    v += [(200 + i, v[0][1], 0) for i in range(30)] + [(300, v[0][1], 1), (301, None, 0), (302, [0.0] * 48, 0), (303, [float("nan")] + [1.0] * 47, 0), (304, v[0][1], None), (305, [1.0] * 3, 0), (306, [2.0] * 3, 0), (307, [None] + [1.0] * 47, 0), (None, v[0][1], 0), (308, [], 0), (5, v[5][1], 1)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>, label int")
    got = embedding_dedup(df, block=16).collect()
    good = [(i, np.array(e, np.float32).astype(float), l) for i, e, l in v if i is not None and l is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    links, union = [0] * len(good), simhash.Union(len(good))
    for a in range(len(good)):
        for b in range(a):
            x, y = good[a], good[b]
            if x[2] == y[2] and len(x[1]) == len(y[1]) and x[1] @ y[1] / np.linalg.norm(x[1]) / np.linalg.norm(y[1]) >= 0.93:
                links[a] += 1
                links[b] += 1
                union.join(a, b)
    want = Counter((good[k][0], links[k], min(good[j][0] for j in range(len(good)) if union.top(j) == union.top(k))) for k in range(len(good)))
    want.update((i, 0, i) for i, e, l in v if i in (301, 302, 303, 304, 307, 308) or i is None)
    have = Counter((r.vec_id, r.n_links, r.component_id) for r in got)
    found, total = sum(r.n_links for r in got), sum(links)
    assert found == total and len(got) == len(v) and have == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)


def test_quality(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 8)))
    clean = [(i, " ".join(word() for _ in range(60)) + ".", f"s{i % 4}") for i in range(120)]
    junk = [(1000 + i, " ".join(word() + "###" for _ in range(60)), f"s{i % 4}") for i in range(30)]
    docs = make(spark, [*clean, *junk, (5000, None, None), (5001, "", "s1")]).withColumn("quality_score", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1, None) for i, _, _ in clean[:60]] + [(i, 0, 1) for i, _, _ in junk[:15]] + [(None, 1, 1), (3, None, 0), (777777, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify_quality(docs, labels).collect()}
    assert len(got) == 152
    assert all(got[i].quality_kept for i, _, _ in clean) and not any(got[i].quality_kept for i, _, _ in junk)
    none = quality.classify_quality(docs, labels.limit(0)).collect()
    assert all(r.quality_kept for r in none)
    assert quality.classify_quality(docs.limit(0), labels).count() == 0


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, "u", ""), (3, None, "<nav>a</nav><article><p>One &amp; two<p>Three<aside>no</aside></article><footer>f</footer>"), (4, "u", "<p>" + "long text here. " * 20000)], "page_id long, url string, html string").withColumn("text", F.lit(3))
    got = {r.page_id: r.text for r in extract_main_text(pages).collect()}
    assert got[1] == got[2] == "" and got[3] == "One & two\nThree" and len(got[4]) == 16 * 20000 - 1


@pytest.mark.parametrize("name", ["substring", "simhash", "fingerprint", "mixing", "embedding"])
def test_empty_tables(spark, name):
    docs = spark.createDataFrame([], DOCS)
    out = {
        "substring": lambda: substring.substring_dedup(docs),
        "simhash": lambda: simhash.simhash_dedup(docs),
        "fingerprint": lambda: fingerprint_documents(docs),
        "mixing": lambda: mix_sources(docs),
        "embedding": lambda: embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")),
    }[name]()
    assert out.count() == 0
