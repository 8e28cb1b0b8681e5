"""The pipeline's stages, one after the other, against brute force."""

import os
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from phasegrid.llm.simhash import Union
from phasegrid.llm.store import cut

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def words(t):
    return re.findall(WORD, t or "")


@pytest.fixture(scope="module")
def stages(spark):
    """Rows after each stage; nulls, repeats and empty texts are mixed in at the start."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(900001, None, None, None, None), (900002, "", "en", "src1", 0), (None, "a null id with a text of its own", "en", None, 32)], docs.schema)
    docs = docs.unionByName(odd).unionByName(docs.filter("doc_id < 3"))
    out = [("documents", docs.collect())]
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SF), "test")
        out.append((name, docs.collect()))
    return dict(out)


def test_order_and_columns(stages):
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "mixture", "encoding"]
    columns = stages["documents"][0].__fields__
    assert all(rows and rows[0].__fields__ == columns for k, rows in stages.items() if k != "encoding")


def test_quality(spark, stages):
    kept, before = Counter(stages["quality"]), Counter(stages["documents"])
    assert not kept - before
    ids = {r.doc_id for r in stages["quality"]}
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        assert (r.doc_id in ids) == (r.quality == 1)


def test_near_duplicates(stages):
    rows = stages["quality"]

    def shingles(t):
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    f = [shingles(r.text) for r in rows]
    union = Union(len(f))
    for i in range(len(f)):
        for j in range(i):
            if 5 * len(f[i] & f[j]) >= 4 * len(f[i] | f[j]):
                union.join(i, j)
    want = Counter()
    for top in {union.top(i) for i in range(len(f))}:
        ids = [rows[i].doc_id for i in range(len(f)) if union.top(i) == top]
        known = [i for i in ids if i is not None]
        want[min(known) if known else None] += 1
    assert Counter(r.doc_id for r in stages["near_duplicates"]) == want
    assert not Counter(stages["near_duplicates"]) - Counter(rows)


def test_repeated_passages(stages):
    rows = stages["near_duplicates"]
    key = lambda i: 1 << 63 if i is None else i
    first = {}
    for r in rows:
        w = words(r.text)
        for k in range(len(w) - 49):
            x = tuple(w[k : k + 50])
            first[x] = min(first.get(x, key(r.doc_id)), key(r.doc_id))
    want = Counter()
    for r in rows:
        w, gone = words(r.text), set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < key(r.doc_id):
                gone.update(range(k, k + 50))
        text = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else r.text
        want[(r.doc_id, text, r.source, len(text) if gone else r.n_chars)] += 1
    assert Counter((r.doc_id, r.text, r.source, r.n_chars) for r in stages["repeated_passages"]) == want


def test_mixture(stages):
    rows = stages["repeated_passages"]
    sources = sorted({r.source for r in rows if r.source is not None}) + [None] * any(r.source is None for r in rows)
    size = {s: sum(len(words(r.text)) for r in rows if r.source == s) for s in sources}
    weight = {s: 1 + k % 3 for k, s in enumerate(sources)}
    stop = {s for s in sources if not size[s]}
    while True:
        level = (sum(size.values()) - sum(3 * size[s] for s in stop)) / sum(weight[s] for s in sources if s not in stop)
        over = {s for s in sources if s not in stop and level * weight[s] > 3 * size[s]}
        if not over:
            break
        stop |= over
    text = {r.doc_id: r.text or "" for r in rows}
    taken, copies = Counter(), Counter()
    for r in stages["mixture"]:
        w, own = words(r.text), words(text[r.doc_id])
        at = iter(own)
        assert all(x in at for x in w)  # a part keeps the order of its words
        taken[r.source] += len(w)
        copies[r.doc_id] += 1
    for s in sources:
        want = 3 * size[s] if s in stop else level * weight[s]
        assert abs(taken[s] - want) <= 24
    assert max(copies.values()) <= 3


def test_encoding(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((r.doc_id, r.source, tuple(lib.encode(r.text or "", add_special_tokens=False).ids), r.text or "") for r in stages["mixture"])
    got = Counter((r.doc_id, r.source, tuple(np.frombuffer(r.ids_packed, "<u4").tolist()), r.text) for r in stages["encoding"])
    assert got == want and all(r.n_tokens == len(r.ids_packed) // 4 for r in stages["encoding"])


def test_run_gives_the_same_rows(spark):
    a, b = (Counter((r.doc_id, r.n_tokens, bytes(r.ids_packed)) for r in corpus_pipeline.run(spark, SF).collect()) for _ in range(2))
    assert a == b and a
