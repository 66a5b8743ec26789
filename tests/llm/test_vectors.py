"""Embedding near-duplicates and exact top-k against brute force over all pairs."""

import re

import numpy as np
import pytest

from quireloom.llm import mtree, nn_descent, queries


def usable(v, zero_too):
    ok = v is not None and all(x is not None and np.isfinite(x) for x in v)
    return ok and (zero_too or any(x != 0 for x in v))


def duplicates(rows, threshold=0.9):
    """{position: (n_links, component)} for rows (id, vector)."""
    some = [k for k, (_, v) in enumerate(rows) if usable(v, False)]
    width = max((len(rows[k][1]) for k in some), default=1)
    m = np.zeros((len(some), width))
    for i, k in enumerate(some):
        m[i, : len(rows[k][1])] = rows[k][1]
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= threshold
    np.fill_diagonal(near, False)
    label = np.arange(len(some))
    while True:
        new = np.array([min(label[i], label[near[i]].min(initial=len(some))) for i in range(len(some))])
        if (new == label).all():
            break
        label = new
    out = {k: (0, i) for k, (i, _) in enumerate(rows)}
    for i, k in enumerate(some):
        ids = [rows[some[j]][0] for j in np.flatnonzero(label == label[i]) if rows[some[j]][0] is not None]
        out[k] = (int(near[i].sum()), min(ids, default=None))
    return out


def multiset(rows):
    return sorted((-1 if i is None else i, n, -1 if c is None else c, k) for i, n, c, k in rows)


def check_duplicates(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = [tuple(r) for r in nn_descent.near_duplicates(df).collect()]
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want = duplicates(exact)
    assert multiset(got) == multiset([(rows[k][0], n, c, c is not None and rows[k][0] == c) for k, (n, c) in want.items()])


def linked_table(spark, folder):
    """Clusters of all sizes, chains, exact copies and lone vectors, as ``embeddings.parquet``."""
    r = np.random.default_rng(12)
    rows = [r.standard_normal(32) for _ in range(300)]
    for size in (2, 2, 3, 5, 9, 20, 60, 200):
        center = r.standard_normal(32)
        rows += [center + 0.15 * r.standard_normal(32) for _ in range(size)]
    rows += [rows[k] for k in (0, 0, 5, 320)]
    a, b = np.eye(32)[:2]
    rows += [np.cos(0.3 * i) * a + np.sin(0.3 * i) * b for i in range(20)]
    table = [(i, v.tolist(), i % 3) for i, v in enumerate(rows)]
    spark.createDataFrame(table, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return table


def test_embedding_query_on_a_table_with_links(spark, tmp_path, monkeypatch):
    """Against all pairs, with dense regions in blocks that meet by their radii."""
    monkeypatch.setattr(nn_descent, "LONG", 32)
    monkeypatch.setattr(nn_descent, "TILE", 16)
    monkeypatch.setattr(nn_descent, "PIVOTS", 8)
    table = linked_table(spark, tmp_path)
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v, _ in table]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in queries.QUERIES["op8_embedding_dedup"](spark, str(tmp_path)).collect()}
    want = {rows[k][0]: (n, c, c == rows[k][0]) for k, (n, c) in duplicates(rows).items()}
    assert max(n for n, *_ in want.values()) >= 150
    assert got == want


def test_a_long_chain_in_cells(spark, monkeypatch):
    """A chain whose links form one component: tiles that meet by the radii of their cells give all links."""
    monkeypatch.setattr(nn_descent, "LONG", 16)
    monkeypatch.setattr(nn_descent, "TILE", 32)
    monkeypatch.setattr(nn_descent, "PIVOTS", 64)
    n = 3_000
    t = np.linspace(0, 60, n)  # a curve that winds through eight dimensions
    v = np.stack([f(k * t / 7) for k in (3, 5, 8, 13) for f in (np.cos, np.sin)], axis=1)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    nodes = spark.createDataFrame([(i, 1, x) for i, x in rows], "node long, weight long, vec array<double>")
    groups = nodes.selectExpr("node", "0L as root")
    found = nn_descent.within_dense(nodes, groups, 0.9)
    degree = {r["a"]: r["n"] for r in found.where("b is null").groupBy("a").agg({"links": "sum"}).withColumnRenamed("sum(links)", "n").collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    assert degree == {i: int(x) - 1 for i, x in enumerate(near.sum(axis=1)) if x > 1}


def test_a_recall_that_stays_low_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "links_of", lambda nodes, graph, threshold: spark.createDataFrame([], nn_descent.LINKS))
    monkeypatch.setattr(nn_descent, "TRIES", 1)
    df = spark.createDataFrame([(i, [1.0, 0.01 * i]) for i in range(5)], "vec_id long, embedding array<double>")
    with pytest.raises(RuntimeError):
        nn_descent.near_duplicates(df)


def test_components_at_the_ends_of_the_range(spark):
    rows = [(1, [1e200, 0.0]), (2, [1e300, 1e298]), (3, [1e-200, 0.0]), (4, [0.0, 1e-300]), (5, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in nn_descent.near_duplicates(df).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4)}


def test_embedding_query_against_brute_force(spark, data):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in queries.QUERIES["op8_embedding_dedup"](spark, data).collect()}
    assert got == {rows[k][0]: (n, c, c == rows[k][0]) for k, (n, c) in duplicates(rows).items()}


def test_copies_and_clusters(spark):
    """A group of exact copies, a dense group far larger than a neighbour list, chains, and lone vectors."""
    r = np.random.default_rng(6)
    rows = [(i, r.standard_normal(16).tolist()) for i in range(400)]
    center = r.standard_normal(16)
    rows += [(1_000 + i, (center + 0.12 * r.standard_normal(16)).tolist()) for i in range(350)]
    rows += [(2_000 + i, rows[0][1]) for i in range(200)]
    a, b = np.eye(16)[0], np.eye(16)[1]
    rows += [(3_000 + i, (np.cos(0.4 * i) * a + np.sin(0.4 * i) * b).tolist()) for i in range(8)]
    check_duplicates(spark, rows)


def test_embedding_edges(spark):
    rows = [(1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [1.0, float("nan")]), (5, [float("inf"), 1.0]), (6, []), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0, 0.0]), (None, [1.0, 0.01]), (None, None), (9, [0.0, 1.0]), (10, [-1.0, 0.0])]
    check_duplicates(spark, rows)
    check_duplicates(spark, rows[:6])
    df = spark.createDataFrame([(1, [1.0], 5, True)], "vec_id long, embedding array<float>, n_links int, kept boolean")
    assert nn_descent.near_duplicates(df).columns == ["vec_id", "n_links", "component_id", "kept"]
    assert nn_descent.near_duplicates(df.limit(0)).count() == 0


def test_the_audit_asks_for_more(spark, monkeypatch):
    """With a graph that finds too little, further graphs join until the audit is content."""
    calls = []
    whole = nn_descent.descend

    def poor(nodes, n, seed, size, least):
        calls.append(size)
        graph = whole(nodes, n, seed, size, least)
        return graph.where("false") if len(calls) == 1 else graph

    monkeypatch.setattr(nn_descent, "descend", poor)
    r = np.random.default_rng(7)
    base = r.standard_normal((40, 8))
    check_duplicates(spark, [(i, (base[i % 40] + 0.02 * r.standard_normal(8)).tolist()) for i in range(160)])
    assert calls == [8, 16]


def best(rows, every=20, k=20):
    some = [(i, np.floor(64 * np.asarray(v, float))) for i, v in rows if i is not None and usable(v, True)]
    width = max((len(v) for _, v in some), default=0)
    some = [(i, np.pad(v, (0, width - len(v)))) for i, v in some]
    out = []
    for q, v in some:
        if q % every == 0:
            found = sorted((-min(mtree.MOST, max(mtree.LEAST, sum(int(a) * int(b) for a, b in zip(v, w)))), i) for i, w in some if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def test_top_k_query_against_sql(same):
    same("op10_top_k", queries.QUERIES["op10_top_k"], queries.ORACLE["op10_top_k"])


@pytest.mark.parametrize("sizes", [(256, 8192, 256), (8, 16, 4)])
def test_top_k(spark, monkeypatch, sizes):
    """Clusters, ties at the last rank and copies, over many pages, groups, tiles and blocks."""
    for name, size in zip(("PAGE", "GROUP", "BLOCK"), sizes, strict=True):
        monkeypatch.setattr(mtree, name, size)
    r = np.random.default_rng(8)
    rows = [(i, (r.standard_normal(8) * (1 + i % 3)).tolist()) for i in range(300)]
    rows += [(1_000 + i, rows[i % 5][1]) for i in range(200)]
    rows += [(2_000 + i, [float(x) for x in r.integers(-1, 2, 8)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    assert sorted(tuple(x) for x in mtree.top_k(df).collect()) == best(rows)


def test_top_k_edges(spark):
    rows = [(0, [1.0, 0.5]), (20, [1.0, -0.5, 2.0]), (1, None), (40, [None, 1.0]), (60, [float("nan")]), (2, [float("inf")]), (3, []), (80, []), (None, [1.0]), (4, [0.0, 0.0]), (-20, [0.3, 0.3])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(x) for x in mtree.top_k(df).collect()) == best(rows)
    assert mtree.top_k(df.limit(0)).count() == 0 and mtree.top_k(df.where("vec_id = 1")).count() == 0
    assert mtree.top_k(df.where("vec_id = 4")).count() == 0
    wide = spark.createDataFrame([(0, [1.0], 4, "x"), (5, [2.0], 4, "x")], "vec_id long, embedding array<double>, score int, rank string")
    assert [tuple(x) for x in mtree.top_k(wide).collect()] == [(0, 1, 5, 64 * 128)]


@pytest.mark.parametrize("size", [4e7, 1e9, 1e12, 1e100, 3e160])
def test_top_k_of_large_components(spark, size):
    """Scores stay exact where 32 and 53 bits do not hold them, and end at 64 bits."""
    r = np.random.default_rng(9)
    rows = [(0, [1.0, 0.5]), (20, [size, 0.0]), (3, [2.0, 1.0]), (7, [size, 1.0]), (9, [3.0, 0.0]), (40, [size / 3, -size]), (11, [1e307, 1.0])]
    rows += [(100 + i, (r.standard_normal(2) * size).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(x) for x in mtree.top_k(df).collect()) == best([x for x in rows if x[0] != 11])


def test_a_group_is_left_out_by_its_radii(spark, monkeypatch):
    """Far clusters: blocks meet only the groups that their bounds let through."""
    for name, size in (("PAGE", 8), ("GROUP", 64), ("BLOCK", 8)):
        monkeypatch.setattr(mtree, name, size)
    seen = []
    whole = mtree.visits
    monkeypatch.setattr(mtree, "visits", lambda asked, groups, *rest: (seen.append((asked.count(), groups.count())), whole(asked, groups, *rest))[1])
    r = np.random.default_rng(10)
    rows = [(100 * c + i, (50 * np.eye(16)[c] + 0.1 * r.standard_normal(16)).tolist()) for c in range(8) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(x) for x in mtree.top_k(df).collect()) == best(rows)
    (blocks, groups), (again, _) = seen
    assert again < blocks * groups / 2


def test_repeated_ids_in_top_k(spark):
    """A query's own row is every row with its id; another id's repeated rows all count."""
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert sorted(tuple(x) for x in mtree.top_k(df).collect()) == [(0, 1, 1, 64 * 128), (0, 2, 1, 64 * 128)]


def test_the_driver_gathers_no_blocks_or_groups(spark, monkeypatch):
    """Files of copies are small, so their estimates allow a broadcast; only sizes of crowds and rings of routes may be sent."""
    for name, size in (("PAGE", 8), ("GROUP", 64), ("BLOCK", 8)):
        monkeypatch.setattr(mtree, name, size)
    plans = []
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    write = mtree.materialize
    monkeypatch.setattr(mtree, "materialize", lambda df, tag: (plans.append(plan(df)), write(df, tag))[1])
    r = np.random.default_rng(11)
    base = r.standard_normal((4, 8)).tolist()
    rows = [(i, base[i // 20 % 4]) for i in range(0, 6_000, 20)] + [(i, r.standard_normal(8).tolist()) for i in range(1, 300, 2)]
    found = mtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted(tuple(x) for x in found.collect()) == best(rows)
    sent = {join for p in [*plans, plan(found)] for join in re.findall(r"BroadcastHashJoin \[(\w+)#\w+\], \[\w+#\w+\], (\w+), (\w+)", p)}
    assert sent <= {("gid", "LeftOuter", "BuildRight"), ("route", "Inner", "BuildRight")}
