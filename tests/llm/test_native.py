"""Sharding, mixing, chat format, URL filter, vector search on small fixtures."""
import duckdb
import numpy as np
import pandas as pd

from placewise.llm import chat, mixing, queries, sharding, url_filter, vector_search


def test_shards_are_even_and_slots_gapless(spark):
    for rows in ([(i, "a", 1) for i in range(997)], [(5, "hot", i) for i in range(400)] + [(i, "b", i) for i in range(600)] + [(None, None, 1)] * 3, []):
        out = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string, shard int"), 24, "doc_id").toPandas()
        assert len(out) == len(rows)
        if rows:
            n = out.groupby("shard").slot.agg(["count", "min", "max", "nunique"])
            assert n["count"].max() - n["count"].min() <= 1 and (n["min"] == 0).all() and (n["max"] == n["count"] - 1).all() and (n["nunique"] == n["count"]).all()


def test_few_keys_move(spark):
    rows = spark.range(4000).withColumnRenamed("id", "doc_id")
    a, b = (sharding.assign(rows, n, "doc_id").toPandas().set_index("doc_id").shard for n in (24, 25))
    assert (a != b.reindex(a.index)).mean() < 0.35                  # a plain modulo moves 96 %


def test_mixing(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 40))), [None, "a", "b", "é", "c"][i % 5], 1) for i in range(2000)] + [(7, None, "a", 1), (7, None, "a", 1), (None, "x y", "b", 1), (9, "", "none", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    out = mixing.mix(docs, [5, 2, 1]).toPandas()
    assert len(out) == len(rows)
    sizes = {s: sum(len((t or "").split()) for _, t, x, _ in rows if x == s) for s in {r[2] for r in rows}}
    order = sorted((s for s in sizes if s is not None)) + [None]
    w = {s: [5, 2, 1][i % 3] for i, s in enumerate(order)}
    target, left, free = {}, 1.5 * sum(sizes.values()), set(order)
    while True:                                    # hand out, cap, share the rest again
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] >= 2 * sizes[s]}
        if not over:
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left, free = left - sum(2 * sizes[s] for s in over), free - over
    target |= {s: level * w[s] for s in free}
    for s in order:
        g = out[out.source.isna()] if s is None else out[out.source == s]
        assert np.allclose(g.target, target[s]) and (g.copies <= 2).all()
        assert abs((g.copies * g["size"]).sum() - target[s]) <= 80
    again = mixing.mix(docs, [5, 2, 1]).toPandas()
    cols = list(out.columns)
    pd.testing.assert_frame_equal(out.sort_values(cols).reset_index(drop=True), again.sort_values(cols).reset_index(drop=True))
    assert mixing.mix(docs.where("doc_id < 0"), [5, 2, 1]).count() == 0


def test_chat_round_trip_and_twin(spark):
    said = ["</s>[INST] ok [/INST]", "<\\/s> <\\\\s> [\\INST] \\ <s", "a\nb</s>", "", None, "<<s>>[[/INST]]" * 2000]
    rows = [(c, t, ["system", "user", "assistant", None, "odd\n\\role</s>"][(c + t) % 5], said[(c * 7 + t) % 6]) for c in range(12) for t in range(c)]
    rows += [(3, 1, "assistant", "tie"), (3, 1, "assistant", "tie"), (None, 0, "user", "x"), (None, 1, "assistant", None), (50, 0, "user", "no reply")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    ex = chat.format_conversations(conv)
    assert all(r.formatted[r.loss_start:r.loss_start + r.loss_length].find("</s>") < 0 for r in ex.collect())
    own = spark.createDataFrame([(-1, 0, "user", said[0]), (-1, 1, "assistant", said[0])], conv.schema)
    got = chat.digest(chat.format_conversations(conv.unionByName(own))).toPandas().sort_values("conv_id").reset_index(drop=True)
    db = duckdb.connect()
    db.register("conversations", conv.toPandas().astype({"conv_id": "Int64"}))
    want = db.sql(chat.ORACLE).df()[list(got.columns)].sort_values("conv_id").reset_index(drop=True)
    assert (got.fillna(-9).astype(str).replace(r"\.0$", "", regex=True) == want.fillna(-9).astype(str).replace(r"\.0$", "", regex=True)).all().all()
    assert chat.digest(chat.format_conversations(conv.where("conv_id > 99"))).count() == 0


def test_urls(spark):
    rows = [(1, "http://WWW.Example.com/en/1"), (2, "https://a.example.com/en/?q=1"), (3, "x://b.net/es/1"), (4, "http://com/"), (5, "http://a.com"), (6, None), (7, "no url"), (8, "ftp://n.org/a://b.com/"),
            (9, ""), (10, "http://b.net/fr"), (10, "http://b.net/fr"), (11, "http://evilexample.com/en/x")] + [(100 + i, f"http://s{i % 9}.{'net/es' if i % 2 else 'com/x'}/{i}") for i in range(200)]
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in rows], "page_id long, url string, host string, length int")
    out = url_filter.judge(pages, queries.RULES).toPandas()
    assert len(out) == len(rows)
    by = out.drop_duplicates("page_id").set_index("page_id")
    assert by.rule.reindex([1, 2, 3, 4]).tolist() == ["www.example.com/en/", "example.com/en/", "net/es/", "com/"] and by.verdict.reindex([1, 2, 3, 4]).tolist() == ["allow", "block", "block", "allow"]
    assert by.rule.reindex([5, 6, 7, 8, 9, 10]).isna().all() and by.rule[11] == "com/"
    assert (by.host[5], by.path[5], by.host[8], by.path[8], by.host[6], by.path[7]) == ("a.com", "", "n.org", "/a://b.com/", "", "")
    assert set(out.verdict) <= {"allow", "block"}
    assert url_filter.judge(pages.where("page_id < 0"), queries.RULES).count() == 0
    assert {r.verdict for r in url_filter.judge(pages.where("page_id IN (5, 6, 7)"), queries.RULES).collect()} == {"allow"}


def test_search_recall_and_edges(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 12)) * rng.uniform(0.5, 2, (900, 1))
    x[100:160] = x[100]
    rows = [(i, [float(v) for v in a], 1) for i, a in enumerate(x)] + [(2000, None, 1), (2020, [0.0] * 12, 1), (2040, [float("nan")] * 12, 1), (None, [1.0] * 12, 1), (20, [float(v) for v in x[20]], 1)]
    out = vector_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, leaf int"), (vector_search.F.col("vec_id") % 20) == 0).toPandas()
    hit = 0
    for q in range(0, 900, 20):
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(900), -s))[:20]
        g = out[out.query_id == q].sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and np.allclose(g.score, s[g.vec_id])
        hit += len(set(want) & set(g.vec_id))
    assert hit >= 0.9 * 20 * 45 and out.query_id.nunique() == 45
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>, leaf int")
    assert vector_search.search(few, vector_search.F.col("vec_id") == 0).count() == 2
    assert vector_search.search(few.where("vec_id > 9"), vector_search.F.col("vec_id") == 0).count() == 0
