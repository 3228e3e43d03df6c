"""Near-duplicate documents by chosen-path set similarity join.

A document is the set of its distinct word shingles. Its signature holds one minwise token per coordinate. Trees split the
documents recursively: a node draws one or two coordinates (1/threshold on average) and every document goes on to the
children named by its tokens at those coordinates, so that two sets of similarity J share a child with probability near
J per draw. Nodes of at most ``LEAF`` documents are compared exhaustively on signatures. A node whose documents mostly
resemble its pivot would never shrink; there every document is compared with the pivot and splitting stops for those that nearly
equal it; documents in the band between (``NEAR`` to ``BAND``) stay on both sides, with their pivot and with the far ones.
Documents that resemble a pivot (``HELD``) are in its neighbourhood and need not meet each other again, so they keep its label on
the way down, and a node ends as soon as at most a leaf of its documents lies outside its largest label: those meet all the node's
documents, block by block. Others are split until every node is a leaf, or until comparing all that are left costs no more than
``COMPARED`` a document; from ``MAX_DEPTH`` levels on leaves may be larger, so splitting always ends, and no node is dropped.

Pairs that pass are grouped into neighbourhoods, and links are confirmed on full sets: exhaustively between the parts of
a neighbourhood that are not yet connected, in blocks where a neighbourhood is large. Only connectivity is reported, so pairs
inside one component need no check, and no pairs of copies are produced: equal sets are one class throughout.

Recall of a pair at similarity 0.8 per tree is 0.73 where two levels suffice, 0.58 after four and 0.32 after twelve. Ten
trees miss such a pair with probability 2e-6 to 2e-4 where four levels suffice; documents that go deeper pass through more
trees (22 for twelve levels), so that the loss from splitting stays at 2e-4; pairs above 0.8 are missed less often.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from placewise.operators.graph import components

from .common import arrow_rows, release, saved

COORDS = 64          # minwise tokens of a signature, 16 bits each
TREES = 10
LEAF = 64            # nodes up to this size are compared exhaustively
LEAF_PAIRS = 200_000  # similar pairs of leaves that a task holds, about
LEAF_BLOCK = 1024    # leaves above this size are compared in blocks
HELD_BLOCK = 256     # documents of one label that the documents outside it meet in one piece
COMPARED = 1000      # comparisons a document at which splitting ends: all nodes left are compared whole
FREE_DEPTH = 4       # levels for which TREES suffice
MAX_DEPTH = 12       # levels after which leaves may grow
GROWTH = 1.5         # ... by this factor a level
MISS = 2e-4          # probability to miss a pair at similarity 0.8 by splitting
NEAR = 0.6           # estimated similarity from which a pair is confirmed on full sets (threshold less four deviations)
HELD = 0.7           # estimated similarity to a pivot from which a document bears the pivot's label
BAND = 0.875         # estimated similarity to the pivot from which a document leaves a dense node
WHOLE = 512          # neighbourhoods up to this size are confirmed in one piece
BIN_DOCS = 1000      # documents of a confirming task, about
CACHE = 200_000      # words a task remembers

_MULT = np.random.default_rng(20240601).integers(0, 2**31, COORDS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = np.random.default_rng(20240602).integers(0, 2**32, COORDS, dtype=np.uint32)


class Shingler:
    """Texts to sorted arrays of 64-bit shingle hashes."""

    def __init__(self, width: int):
        self.width, self.known = width, {}

    def words(self, text: str | None) -> np.ndarray:
        # bytes.lower() and bytes.split() work on ASCII letters and ASCII white space only
        known, out = self.known, []
        for w in (text or "").encode().lower().split():
            h = known.get(w)
            if h is None:
                if len(known) >= CACHE:
                    known.clear()
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        return np.array(out, dtype=np.uint64)

    def __call__(self, text: str | None) -> np.ndarray:
        """Distinct shingles of ``width`` words; the whole sequence as one where there are fewer words; empty without words."""
        h = self.words(text)
        if not len(h):
            return h
        w = min(self.width, len(h))
        s = np.full(len(h) - w + 1, np.uint64(w), dtype=np.uint64)
        for i in range(w):
            s = (s ^ h[i:len(h) - w + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            s ^= s >> np.uint64(29)
        s *= np.uint64(0xBF58476D1CE4E5B9)
        s ^= s >> np.uint64(32)
        s.sort()
        return s[np.concatenate(([True], s[1:] != s[:-1]))]


def signature(s: np.ndarray) -> bytes:
    low = np.full(COORDS, 0xFFFFFFFF, dtype=np.uint32)
    x = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    for i in range(0, len(x), 4096):                # long texts in blocks: memory stays bounded
        low = np.minimum(low, (x[i:i + 4096, None] * _MULT + _ADD).min(0))
    return ((low * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype("<u2").tobytes()


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        shingles = Shingler(width)
        for b in batches:
            ids, n, f1, f2, sig = [], [], [], [], []
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                s = shingles(text.as_py())
                ids.append(i)
                n.append(len(s))
                f = xxhash.xxh3_128_digest(s.tobytes())
                f1.append(int.from_bytes(f[:8], "little", signed=True))
                f2.append(int.from_bytes(f[8:], "little", signed=True))
                sig.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(f1, pa.int64()),
                                              pa.array(f2, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "n", "f1", "f2", "sig"])
    return run


def _branch(df: DataFrame) -> DataFrame:
    """Children of every (node, doc): the node's own hash draws the coordinates, the document's tokens name the children."""
    c = F.xxhash64("node", F.lit(1))
    i, j = F.pmod(c, F.lit(COORDS)), F.pmod(F.shiftright(c, 8), F.lit(COORDS))
    child = lambda k: F.xxhash64("node", k, F.substring("sig", (2 * k + 1).cast("int"), F.lit(2)))
    two = (F.pmod(F.shiftright(c, 20), F.lit(4)) == 0) & (i != j)
    return df.select(F.explode(F.when(two, F.array(child(i), child(j))).otherwise(F.array(child(i)))).alias("node"), "doc", "sig", "label")


def trees_for(depth: int) -> int:
    """Trees that part a pair at similarity 0.8 everywhere within ``depth`` levels with probability ``MISS`` at most."""
    together = 1.0
    for _ in range(depth):
        one = 1 - 0.8 * together
        together = 1 - (0.75 * one + 0.25 * one * one)
    return int(np.ceil(np.log(MISS) / np.log1p(-together)))


def leaf_size(depth: int) -> int:
    return int(LEAF * GROWTH ** max(0, depth - MAX_DEPTH))


def _in_blocks(leaves: DataFrame) -> DataFrame:
    """(node, doc) of leaves (node, doc, size): a large leaf becomes one node for each two of its blocks."""
    b = F.ceil(F.col("size") / LEAF_BLOCK).cast("long")
    own = F.pmod(F.xxhash64("doc", F.lit(7)), b)
    both = F.transform(F.sequence(F.lit(0).cast("long"), b - 1), lambda o: F.xxhash64("node", F.least(own, o), F.greatest(own, o)))
    return leaves.select(F.explode(F.when(b > 1, both).otherwise(F.array("node"))).alias("node"), "doc")


def _around(held: DataFrame) -> DataFrame:
    """(node, doc) of nodes (node, doc, label, main, inside): the documents of label ``main`` are dealt into blocks, all
    others go to every block."""
    b = F.greatest(F.ceil(F.col("inside") / HELD_BLOCK).cast("long"), F.lit(1).cast("long"))
    block = lambda i: F.xxhash64("node", i, F.lit(11))
    own = F.array(block(F.pmod(F.xxhash64("doc", F.lit(5)), b)))
    every = F.transform(F.sequence(F.lit(0).cast("long"), b - 1), block)
    return held.select(F.explode(F.when(F.col("label").eqNullSafe(F.col("main")), own).otherwise(every)).alias("node"), "doc")


def _similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(1)


def _sigs(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("sig").to_pylist()), dtype="<u2").reshape(-1, COORDS)


def _best_tree(x: np.ndarray, y: np.ndarray, est: np.ndarray, n: int) -> np.ndarray:
    """Which of the pairs (x, y) of 0..n-1 make a spanning forest of the highest estimates (Boruvka's rounds)."""
    rank = np.empty(len(x), np.int64)
    rank[np.lexsort((y, x, -est))] = np.arange(len(x))
    part, left, taken = np.arange(n), np.arange(len(x)), []
    while len(left):
        a, b = part[x[left]], part[y[left]]
        apart = a != b
        left, a, b = left[apart], a[apart], b[apart]
        best = np.full(n, len(x))
        np.minimum.at(best, a, rank[left])
        np.minimum.at(best, b, rank[left])
        use = (best[a] == rank[left]) | (best[b] == rank[left])
        taken.append(left[use])
        a, b, up = a[use], b[use], np.arange(n)
        while True:
            low = np.minimum(up[a], up[b])
            if (up[a] == low).all() and (up[b] == low).all():
                break
            np.minimum.at(up, a, low)
            np.minimum.at(up, b, low)
            up = up[up]
        part = up[part]
    return np.concatenate(taken) if taken else np.zeros(0, np.int64)


def _leaf_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of a leaf are compared, each with the 1st, 2nd, ... row after it while the node is the same; of the pairs that look
    similar a spanning forest is handed on. It holds together what all pairs would, which is what neighbourhoods are made of: inside
    of them everything that is still apart is compared again."""
    for t in arrow_rows(batches, "node"):
        node, doc, sig = t.column("node").to_numpy(), t.column("doc").to_numpy(), _sigs(t)
        ids, who = np.unique(doc, return_inverse=True)      # a document of several nodes is one
        at = np.arange(len(node))
        x, y, est = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for k in count(1):
            at = at[at + k < len(node)]
            at = at[node[at] == node[at + k]]
            if not len(at):
                break
            for lo in range(0, len(at), 20_000):
                i = at[lo:lo + 20_000]
                e = _similar(sig[i], sig[i + k])
                keep = (e >= NEAR) & (doc[i] != doc[i + k])
                x, y, est = np.concatenate((x, i[keep])), np.concatenate((y, i[keep] + k)), np.concatenate((est, e[keep]))
            if len(x) > max(LEAF_PAIRS, 4 * len(node)):
                keep = _best_tree(who[x], who[y], est, len(ids))
                x, y, est = x[keep], y[keep], est[keep]
        keep = _best_tree(who[x], who[y], est, len(ids))
        if len(keep):
            a, b = doc[x[keep]], doc[y[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b)), pa.array(est[keep])], ["u", "v", "est"])


def _pivot_similarity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            t = pa.Table.from_batches([b])
            est = _similar(_sigs(t), np.frombuffer(b"".join(t.column("psig").to_pylist()), dtype="<u2").reshape(-1, COORDS))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("node", "doc", "sig", "label", "pivot", "root")), pa.array(est)],
                                             ["node", "doc", "sig", "label", "pivot", "root", "est"])


def _forest(sets: DataFrame, trees: range) -> tuple[list[DataFrame], DataFrame | None, int]:
    """Pairs found by these trees, the documents that went below ``FREE_DEPTH`` levels (if any), and the depth reached."""
    found, whole, deep, allowed = [], [], None, COMPARED * sets.count()
    alive = sets.select(F.explode(F.array(*[F.xxhash64(F.lit(t), F.lit(101)) for t in trees])).alias("node"), "doc", "sig", F.lit(None).cast("long").alias("label"))
    alive, depth = _branch(alive), 1
    while True:
        # signatures stay behind until it is known which nodes hold more than one document
        alive, depth = _branch(alive), depth + 1
        members = saved(alive.select("node", "doc", "label"), f"members{depth}")
        pivot = F.min(F.struct(F.xxhash64("node", "doc").alias("h"), F.col("doc"), F.col("sig"), F.col("label"))).alias("p")
        sizes = members.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
        sized = saved(members.join(sizes, "node"), f"sized{depth}")
        leaf = leaf_size(depth)
        whole.append(_in_blocks(sized.where(F.col("size") <= leaf)))
        big = saved(sized.where(F.col("size") > leaf).select("node", "doc", "label").join(sets, "doc").select("node", "doc", "label", "sig"), f"big{depth}")
        if big.isEmpty():
            break
        pivots = big.groupBy("node").agg(pivot).select("node", F.col("p.doc").alias("pivot"), F.col("p.sig").alias("psig"), F.coalesce("p.label", "p.doc").alias("root"))
        met = saved(big.join(pivots, "node").mapInArrow(_pivot_similarity, "node long, doc long, sig binary, label long, pivot long, root long, est double"), f"met{depth}")
        near = F.col("est") >= NEAR
        found.append(met.where(near & (F.col("doc") != F.col("pivot")))
                     .select(F.greatest("doc", "pivot").alias("u"), F.least("doc", "pivot").alias("v"), "est"))
        dense = met.groupBy("node").agg(F.avg(near.cast("double")).alias("share")).where(F.col("share") >= 0.5).select("node", F.lit(True).alias("dense"))
        met = (met.withColumn("label", F.when(F.col("est") >= HELD, F.col("root")).otherwise(F.col("label"))).join(dense, "node", "left")
               .where(F.col("dense").isNull() | (F.col("est") < BAND)).select("node", "doc", "sig", "label"))
        # who bears the node's most frequent label is in one neighbourhood already; only the others need to meet anybody
        main = (met.groupBy("node", "label").agg(F.count("*").alias("n")).groupBy("node")
                .agg(F.max_by("label", F.when(F.col("label").isNotNull(), F.struct("n", "label"))).alias("main"), F.sum("n").alias("size"),
                     F.coalesce(F.max(F.when(F.col("label").isNotNull(), F.col("n"))), F.lit(0)).alias("inside")))
        left = saved(met.join(main, "node").withColumn("outside", F.col("size") - F.col("inside")).where("outside > 0"), f"left{depth}")
        cost = F.when(F.col("outside") > LEAF_BLOCK, F.col("size")).otherwise(F.col("outside") + F.least("inside", F.lit(HELD_BLOCK))) / 2
        last = (left.where(F.col("outside") > leaf).agg(F.sum(cost)).first()[0] or 0) <= allowed
        few = (F.col("outside") <= leaf) if not last else F.lit(True)
        whole += [_around(left.where(few & (F.col("outside") <= LEAF_BLOCK))), _in_blocks(left.where(few & (F.col("outside") > LEAF_BLOCK)))]
        if last:
            break
        alive = left.where(~few).select("node", "doc", "sig", "label")
        if depth == FREE_DEPTH:
            deep = saved(alive.select("doc").distinct().join(sets, "doc"), "deep")
    # what is compared whole at any level is compared together
    rows = reduce(DataFrame.unionByName, whole).join(sets, "doc").select("node", "doc", "sig").repartition("node").sortWithinPartitions("node")
    return [saved(rows.mapInArrow(_leaf_pairs, "u long, v long, est double"), "leaves"), *found], deep, depth


def candidates(sets: DataFrame, trees: int = TREES) -> DataFrame:
    """(u, v): pairs u > v of ``sets`` (doc, sig) that meet in a leaf or at a pivot and look similar. Distinct."""
    found, deep, depth = _forest(sets, range(trees))
    # documents that went deep need more trees
    while deep is not None and trees < trees_for(depth):
        more, _, reached = _forest(deep, range(trees, trees_for(depth)))
        found, trees, depth = found + more, trees_for(depth), max(depth, reached)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return saved(out.groupBy("u", "v").agg(F.max("est").alias("est")), "candidates")


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    n, m = len(x), len(y)
    if 100 * min(n, m) < percent * max(n, m) or not n or not m:
        return False
    i = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * i >= percent * (n + m - i)


class _Parts:
    """Union of connected documents inside one task."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        up = self.up
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _confirm(width: int, percent: int):
    """One bin: candidate pairs by falling estimate, skipping connected ones; then, inside a whole neighbourhood, every pair
    of documents that are still apart."""
    def run(edges: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        shingles, sets, hoods = Shingler(width), {}, {}
        for d, hood, whole, text in zip(docs["doc"].tolist(), docs["hood"].tolist(), docs["whole"].tolist(), docs["text"]):
            sets.setdefault(d, []).append(shingles(text))
            if whole:
                hoods.setdefault(hood, set()).add(d)
        parts, out = _Parts(), []

        def check(a, b):
            if any(_linked(x, y, percent) for x in sets.get(a, ()) for y in sets.get(b, ())):
                parts.join(a, b)
                out.append((max(a, b), min(a, b)))

        edges = edges.sort_values(["est", "u", "v"], ascending=[False, True, True])
        tried = set()
        for a, b in zip(edges["u"].tolist(), edges["v"].tolist()):
            if parts.top(a) != parts.top(b):
                tried.add((a, b))
                check(a, b)
        for members in hoods.values():
            order = sorted(members)
            by_size = {d: len(sets[d][0]) for d in order}
            order.sort(key=by_size.get)
            for i, a in enumerate(order):
                for b in order[i + 1:]:
                    if len(sets[a]) == len(sets[b]) == 1 and percent * by_size[b] > 100 * by_size[a]:
                        break                                        # sizes too different, and growing
                    if parts.top(a) != parts.top(b) and (max(a, b), min(a, b)) not in tried:
                        check(a, b)
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")
    return run


def _rest(width: int, percent: int):
    """One block of a large neighbourhood: the documents outside its main part against the block's documents."""
    def run(few: pd.DataFrame, many: pd.DataFrame) -> pd.DataFrame:
        shingles, out = Shingler(width), []
        others = [(d, c, shingles(t)) for d, c, t in zip(few["doc"].tolist(), few["comp"].tolist(), few["text"])]
        parts = _Parts()
        for d, c, t in zip(many["doc"].tolist(), many["comp"].tolist(), many["text"]):
            s = shingles(t)
            for e, k, o in others:
                if parts.top(c) != parts.top(k) and _linked(s, o, percent):
                    parts.join(c, k)
                    out.append((max(d, e), min(d, e)))
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")
    return run


def _texts(want: DataFrame, docs: DataFrame) -> DataFrame:
    # new names for the columns: both sides of a later cogroup come from the same tables
    return want.join(docs.select(F.col("doc_id").alias("doc"), "text"), "doc").select(*[F.col(c).alias(c) for c in want.columns], F.col("text").alias("text"))


def dealt(pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hoods, load, edges): neighbourhood of each document, sizes of neighbourhoods, and the pairs with their task (a, b)."""
    nodes = saved(pairs.selectExpr("explode(array(u, v)) AS node").groupBy("node").agg(F.count("*").alias("degree")), "nodes")
    hoods = saved(components(nodes.select("node"), pairs, []).withColumnRenamed("comp", "hood"), "hoods")
    size = hoods.groupBy("hood").agg(F.count("*").alias("docs"))
    # the end of fewer pairs decides a pair's task: a pivot's many pairs are spread, and its text is there once per task
    known = saved(hoods.join(nodes, "node"), "known")
    edges = saved(pairs.join(known.selectExpr("node AS v", "hood", "degree AS dv"), "v").join(known.selectExpr("node AS u", "degree AS du"), "u")
                  .select("u", "v", "est", "hood", F.when(F.col("du") <= F.col("dv"), F.col("u")).otherwise(F.col("v")).alias("few")), "placed")
    load = edges.groupBy("hood").agg(F.count("*").alias("pairs")).join(size, "hood")
    total = hoods.count()
    bins = max(1, -(-total // BIN_DOCS))
    whole = F.col("docs") <= WHOLE
    chunk = F.when(whole, F.lit(0)).otherwise(F.greatest(F.ceil(F.col("pairs") / (8 * BIN_DOCS)), F.ceil(F.col("docs") / BIN_DOCS)))
    load = load.select("hood", whole.alias("whole"), chunk.cast("long").alias("chunks"), F.pmod(F.xxhash64("hood"), F.lit(bins)).alias("bin"))
    # a small neighbourhood goes to one bin with others; the pairs of a large one are dealt out
    place = F.when(F.col("whole"), F.struct(F.col("bin").alias("a"), F.lit(-1).cast("long").alias("b"))).otherwise(
        F.struct(F.col("hood").alias("a"), F.pmod(F.xxhash64("few"), F.greatest("chunks", F.lit(1))).alias("b")))
    edges = saved(edges.join(load, "hood").select("u", "v", "est", "hood", "whole", place.alias("at")).select("u", "v", "est", "hood", "whole", "at.a", "at.b"), "edges")
    return hoods, load, edges


def rest_blocks(part: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(few, many) of neighbourhoods in parts (hood, node, comp, main, docs, outside): both in blocks of about ``BIN_DOCS``
    documents, each block of few with each block of many in one task (hood, block, side)."""
    zero = F.lit(0).cast("long")
    part = part.withColumn("blocks", F.ceil(F.col("docs") / BIN_DOCS).cast("long")).withColumn("sides", F.ceil(F.col("outside") / BIN_DOCS).cast("long"))
    few = part.where(F.col("comp") != F.col("main")).select("hood", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("block"),
                                                            F.pmod(F.xxhash64("node", F.lit(3)), F.col("sides")).alias("side"), F.col("node").alias("doc"), "comp")
    many = part.select("hood", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"), F.explode(F.sequence(zero, F.col("sides") - 1)).alias("side"),
                       F.col("node").alias("doc"), "comp")
    return few, many


def confirm(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(u, v): links of similarity ``percent`` or more that connect what the candidate pairs' neighbourhoods hold."""
    hoods, load, edges = dealt(pairs)
    # a share of all documents: their texts are shuffled once, by the same plan at every size
    want = edges.select("a", "b", "hood", "whole", F.explode(F.array("u", "v")).alias("doc")).distinct()
    links = saved(edges.select("a", "b", "u", "v", "est").groupBy("a", "b").cogroup(_texts(want, docs.hint("merge")).groupBy("a", "b"))
                  .applyInPandas(_confirm(width, percent), "u long, v long"), "links")
    large = hoods.join(load.where(~F.col("whole")).select("hood"), "hood")
    if large.isEmpty():
        return links
    # large neighbourhoods: what is not yet in the main part meets all others, block by block
    part = saved(components(large.select("node"), links.join(large.selectExpr("node AS u"), "u"), []).join(large, "node"), "parts")
    main = (part.groupBy("hood", "comp").agg(F.count("*").alias("n")).groupBy("hood")
            .agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count("*").alias("comps"), F.sum("n").alias("docs"), (F.sum("n") - F.max("n")).alias("outside")))
    few, many = rest_blocks(part.join(main.where("comps > 1"), "hood"))
    more = (_texts(few, docs).groupBy("hood", "block", "side").cogroup(_texts(many, docs).groupBy("hood", "block", "side"))
            .applyInPandas(_rest(width, percent), "u long, v long"))
    return saved(links.unionByName(more), "all_links")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, trees: int = TREES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ...): doc_id, n_shingles, component_id (smallest doc_id reachable over
    links of ``percent`` % similarity or more, itself included), kept (doc_id = component_id).

    Null and empty texts and texts without words have no shingles and link with nothing. Equal sets form one class, so
    exact copies cost one comparison. Rows that share a doc_id are one document: links of either row count for both.
    A row without doc_id takes part in nothing (component_id null, kept false). Other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    signed = saved(docs.mapInArrow(_sign(width), "doc_id long, n long, f1 long, f2 long, sig binary"), "signed")
    usable = signed.where("doc_id IS NOT NULL AND n > 0")
    classes = saved(usable.groupBy("f1", "f2", "n").agg(F.min(F.struct("doc_id", "sig")).alias("m"))
                    .select("f1", "f2", F.col("m.doc_id").alias("doc"), F.col("m.sig").alias("sig")), "classes")
    same_id = signed.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1")
    pairs = candidates(classes.select("doc", "sig"), trees)
    links = confirm(pairs, docs, width, percent)
    # a doc_id that several rows share joins its rows' classes
    twice = (usable.join(same_id.select("doc_id"), "doc_id").join(classes.select("f1", "f2", "doc"), ["f1", "f2"])
             .where("doc_id <> doc").selectExpr("doc_id AS u", "doc AS v"))
    links = saved(links.unionByName(twice), "graph")
    label = components(links.selectExpr("explode(array(u, v)) AS node").distinct(), links, [])
    label = label.select(F.col("node").alias("doc"), "comp")
    of_class = saved(classes.select("f1", "f2", "doc").join(label, "doc", "left").select("f1", "f2", F.coalesce("comp", "doc").alias("comp")), "of_class")
    out = signed.select("doc_id", "n", "f1", "f2").join(of_class, ["f1", "f2"], "left")
    comp = F.when(F.col("n") > 0, F.col("comp")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), comp).alias("component_id"),
                      F.coalesce(F.col("doc_id") == comp, F.lit(False)).alias("kept"))
