"""Near-duplicate documents and vectors against brute force."""
import random

import numpy as np
import pytest

from placewise.llm import minhash_dedup, vector_dedup


def _components(ids, linked):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                a2, b2 = top(a), top(b)
                up[max(a2, b2)] = min(a2, b2)
    return {i: top(i) for i in ids}


def _set(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


@pytest.mark.parametrize("width", [2])
def test_documents_equal_brute_force(spark, width):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = {}
    for g in range(6):
        base = [word() for _ in range(120)]
        for _ in range(90 if g == 0 else 5):                 # the first group is larger than a leaf
            t = list(base)
            for _ in range(rng.randint(0, 9)):
                t[rng.randrange(len(t))] = word()
            texts[len(texts)] = " ".join(t)
    texts |= {900: texts[0], 901: texts[0].upper(), 902: None, 903: "", 904: " \t\n", 905: "word", 906: "WORD", 907: "two words", 908: "é\x0bÉ", 909: "long " * 20_000}
    rows = [(i, t, "x", 1) for i, t in texts.items()] + [(None, texts[0], "x", 1), (3, texts[3], "x", 1)]      # no id; a repeated row
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, comp string, kept int"), width=width).collect()
    assert len(got) == len(rows)
    sets = {i: _set(t, width) for i, t in texts.items()}
    want = _components(list(texts), lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and not r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], r.doc_id == want[r.doc_id])


def test_no_documents(spark):
    assert minhash_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "QUERIES", 0)       # no vector is compared with all others: the passes alone must find every link
    rng = np.random.default_rng(5)
    x = [rng.normal(size=16) for _ in range(60)]
    for g in range(4):
        c = rng.normal(size=16)
        # tight groups (a shortcut counts them) and loose ones (compared in blocks)
        x += [c + rng.normal(scale=0.05 if g < 2 else 0.28, size=16) for _ in range(40)]
    vecs = {i: [float(v) for v in a] for i, a in enumerate(x)}
    vecs |= {500: vecs[3], 501: [7 * v for v in vecs[3]], 502: None, 503: [0.0] * 16, 504: [float("nan")] * 16, 505: [None] * 16, 506: [], 507: [1.0, 2.0], 508: [float("inf")] + [1.0] * 15}
    rows = [(i, v, 1, 2) for i, v in vecs.items()] + [(None, vecs[0], 1, 2), (7, vecs[7], 1, 2)]
    got = vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, hood int")).collect()
    assert len(got) == len(rows)
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in vecs.items() if i < 502}
    linked = lambda a, b: a in unit and b in unit and unit[a] @ unit[b] >= 0.9
    want = _components(list(vecs), linked)
    for r in got:
        if r.vec_id is None:
            assert r.component_id is None and r.n_links == 0 and not r.kept
        else:
            assert r.n_links == sum(linked(r.vec_id, j) for j in vecs if j != r.vec_id), r
            assert (r.component_id, r.kept) == (want[r.vec_id], want[r.vec_id] == r.vec_id)


def test_no_vectors(spark):
    assert vector_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_five_thousand_vectors_by_passes_alone(spark, monkeypatch):
    """1,000 planted partners at cosine 0.9 to 0.99 among 5,000 vectors, and a group of 400: none too many, nearly all found."""
    monkeypatch.setattr(vector_dedup, "QUERIES", 0)
    rng, dim = np.random.default_rng(21), 32
    v = rng.normal(size=(3600, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    cos = rng.uniform(0.9, 0.99, 1000)[:, None]
    side = rng.normal(size=(1000, dim))
    side -= (side * v[:1000]).sum(1, keepdims=True) * v[:1000]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    group = v[3000] + rng.normal(scale=0.06, size=(400, dim))
    v = np.concatenate([v, cos * v[:1000] + np.sqrt(1 - cos * cos) * side, group])
    v = v[rng.permutation(len(v))] * rng.uniform(0.5, 3, (len(v), 1))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    links = (u @ u.T >= 0.9).sum(1) - 1
    got = {r.vec_id: r.n_links for r in vector_dedup.near_duplicates(spark.createDataFrame([(i, [float(a) for a in x]) for i, x in enumerate(v)], "vec_id long, embedding array<double>")).collect()}
    n = np.array([got[i] for i in range(len(v))])
    assert (n <= links).all()
    loose = (links > 0) & (links < 10)                                     # the planted partners
    assert loose.sum() > 1900 and n[loose].sum() >= 0.97 * links[loose].sum() and n[~loose].sum() >= 0.99 * links[~loose].sum()


def test_copies_between_near_vectors_hide_no_pair(spark, monkeypatch):
    """One pair at cosine 0.91 and, around its middle, 200 vectors of 30 copies each, nearly all too far for a link."""
    monkeypatch.setattr(vector_dedup, "QUERIES", 0)
    rng, dim = np.random.default_rng(11), 32
    turn = np.arccos(0.91) / 2
    e = np.eye(dim)
    x = [np.cos(turn) * e[0] + np.sin(turn) * e[1], np.cos(turn) * e[0] - np.sin(turn) * e[1]]
    for _ in range(200):
        far = np.concatenate([[0, 0], rng.normal(size=dim - 2)])
        x.append(np.cos(0.52) * e[0] + np.sin(0.52) * far / np.linalg.norm(far))
    copies = [1, 1] + [30] * 200
    rows, of = [], []
    for i, c in enumerate(copies):
        for _ in range(c):
            rows.append((len(of), [float(v) for v in x[i]]))
            of.append(i)
    got = {r.vec_id: r for r in vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    cos = np.array(x) @ np.array(x).T
    np.fill_diagonal(cos, 1)
    first = [of.index(i) for i in range(len(x))]
    want = _components(range(len(x)), lambda a, b: cos[a, b] >= 0.9)
    assert want[1] == 0
    for i, c in enumerate(of):
        assert got[i].n_links == sum(n for n, ok in zip(copies, cos[c] >= 0.9) if ok) - 1
        assert got[i].component_id == first[want[c]]


def test_passes_grow_with_the_vectors():
    n = [vector_dedup.passes_for(k, 0.9) for k in (500, 10_000, 100_000, 1_000_000, 10_000_000)]
    assert n[0] == vector_dedup.PASSES and n == sorted(n) and n[2] > n[1] and n[4] > 60


def test_sample_repairs_short_passes(spark, monkeypatch):
    """With one pass and a window of one, the sample shows what is missing and passes go on until it is found."""
    monkeypatch.setattr(vector_dedup, "WINDOW", 1)
    rng = np.random.default_rng(3)
    c = rng.normal(size=(40, 16))
    v = np.concatenate([c, c + rng.normal(scale=0.2, size=c.shape)])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    got = vector_dedup.near_duplicates(spark.createDataFrame([(i, [float(a) for a in x]) for i, x in enumerate(v)], "vec_id long, embedding array<double>"), passes=1).collect()
    links = ((v @ v.T >= 0.9).sum(1) - 1).tolist()
    assert sum(r.n_links for r in got) >= 0.97 * sum(links) > 0 and all(r.n_links <= links[r.vec_id] for r in got)


def _signatures(spark, rows):
    sets = spark.createDataFrame([(i, bytearray(np.asarray(x, "<u2").tobytes())) for i, x in enumerate(rows)], "doc long, sig binary")
    return minhash_dedup.saved(sets.repartition(8), "signatures")


def test_no_node_is_dropped_when_deep(spark, monkeypatch):
    """1,400 documents share a passage (similarity about 0.56): their nodes are large after three levels. 100 pairs at 0.86."""
    monkeypatch.setattr(minhash_dedup, "MAX_DEPTH", 3)
    rng = np.random.default_rng(8)
    base, docs = rng.integers(0, 2**16, 64), rng.integers(0, 2**16, (1400, 64))
    docs = np.where(rng.random(docs.shape) < 0.75, base, docs)
    for i in range(100):
        docs[100 + i] = docs[i]
        docs[100 + i, rng.permutation(64)[:9]] = rng.integers(0, 2**16, 9)
    found = {(r.u, r.v) for r in minhash_dedup.candidates(_signatures(spark, docs), trees=3).collect()}
    assert sum((100 + i, i) in found for i in range(100)) >= 93


def test_trees_grow_with_depth():
    assert [minhash_dedup.trees_for(d) for d in (2, 4, 12)] == [7, 10, 22]
    assert minhash_dedup.leaf_size(12) == minhash_dedup.LEAF and minhash_dedup.leaf_size(20) > 20 * minhash_dedup.LEAF


def test_border_of_a_dense_node_stays_together(spark):
    """A dense group; 600 documents Y at about 0.72 to it, each the only near one of an X at about 0.56 to the group."""
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**16, 64)
    docs = np.where(rng.random((2400, 64)) < 0.97, base, rng.integers(0, 2**16, (2400, 64)))
    for i in range(600):
        order = rng.permutation(64)
        docs[i] = base
        docs[i, order[:18]] = rng.integers(0, 2**16, 18)
        docs[600 + i] = docs[i]
        docs[600 + i, order[18:28]] = rng.integers(0, 2**16, 10)
    found = {(r.u, r.v) for r in minhash_dedup.candidates(_signatures(spark, docs), trees=2).collect()}
    assert sum((600 + i, i) in found for i in range(600)) >= 0.85 * 600


def test_large_neighbourhoods_meet_tasks_in_parts(spark, monkeypatch):
    """A pivot of 600 pairs is not one task; documents outside the main part are cut into blocks as well."""
    monkeypatch.setattr(minhash_dedup, "BIN_DOCS", 50)
    star = spark.range(1, 601).selectExpr("id AS u", "0L AS v", "0.7D AS est")
    _, _, edges = minhash_dedup.dealt(star)
    sizes = [r["count"] for r in edges.groupBy("a", "b").count().collect()]
    assert sum(sizes) == 600 and max(sizes) < 150
    part = spark.range(500).selectExpr("1L AS hood", "id AS node", "id AS comp", "0L AS main", "500L AS docs", "499L AS outside")
    few, many = minhash_dedup.rest_blocks(part)
    at = ["hood", "block", "side"]
    assert max(r["count"] for t in (few, many) for r in t.groupBy(at).count().collect()) < 150
    met = few.alias("f").join(many.alias("m"), at).selectExpr("f.doc AS x", "m.doc AS y")
    assert met.distinct().count() == met.count() == 499 * 500


def test_large_neighbourhood_equals_brute_force(spark, monkeypatch):
    """The blocks of a neighbourhood find the links that its candidate pairs lack."""
    monkeypatch.setattr(minhash_dedup, "WHOLE", 4)
    monkeypatch.setattr(minhash_dedup, "BIN_DOCS", 10)
    word = "abcdefghijklmnopqrst"
    texts = [" ".join(f"{word[(g * 3 + k) % 20]}{g}{k}" for k in range(40)) + (" end" if c else "") for g in range(30) for c in range(2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs = spark.range(1, 60).selectExpr("id AS u", "0L AS v", "0.7D AS est")
    got = {(r.u, r.v) for r in minhash_dedup.confirm(pairs, docs, 2, 80).collect()}
    assert got == {(2 * g + 1, 2 * g) for g in range(30)}


def test_leaf_hands_on_a_spanning_forest():
    """A leaf of near copies gives a pair per document, not per pair; what hangs together stays together."""
    import pyarrow as pa
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**16, (5, minhash_dedup.COORDS), dtype=np.uint16)
    sigs = np.repeat(base, 60, 0)
    sigs[rng.random(sigs.shape) < 0.2] = 1                                    # near copies of five texts, some close to the border
    node = np.repeat([3, 9], 150)
    batch = pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.arange(300) * 7), pa.array([s.astype("<u2").tobytes() for s in sigs], pa.binary())], ["node", "doc", "sig"])
    found = [p for b in minhash_dedup._leaf_pairs(iter([batch])) for p in zip(*(b.column(c).to_pylist() for c in ("u", "v", "est")))]
    similar = [(i, j) for i in range(300) for j in range(i) if node[i] == node[j] and (sigs[i] == sigs[j]).mean() >= minhash_dedup.NEAR]

    def parts(pairs):
        p = minhash_dedup._Parts()
        for a, b in pairs:
            p.join(a, b)
        return [p.top(i) for i in range(300)]
    assert parts([(u // 7, v // 7) for u, v, _ in found]) == parts(similar)
    assert len(found) == 300 - len(set(parts(similar))) < len(similar) / 20
    assert all(u > v and est == (sigs[u // 7] == sigs[v // 7]).mean() for u, v, est in found)


def test_dense_group_ends_after_few_levels(spark, monkeypatch):
    """3,000 documents at about 0.7 to each other, close to no pivot: they bear one label and are not split to single leaves."""
    monkeypatch.setattr(minhash_dedup, "COMPARED", 0)                         # no shortcut by cost
    rng = np.random.default_rng(12)
    base = rng.integers(0, 2**16, 64)
    docs = np.where(rng.random((3000, 64)) < 0.85, base, rng.integers(0, 2**16, (3000, 64)))
    docs[2900:] = rng.integers(0, 2**16, (100, 64))                           # others, of which 50 share most with one of the group
    for i in range(50):
        docs[2900 + i] = docs[i]
        docs[2900 + i, rng.permutation(64)[:11]] = rng.integers(0, 2**16, 11)
    found, _, depth = minhash_dedup._forest(_signatures(spark, docs), range(4))
    assert depth <= 6
    up = minhash_dedup._Parts()
    pairs = [(r.u, r.v) for f in found for r in f.select("u", "v").distinct().collect()]
    for a, b in pairs:
        up.join(a, b)
    assert len({up.top(i) for i in range(2950)}) <= 3 and len(pairs) < 40 * 3000
