"""Density clusters against a tree built from the full matrix."""

import numpy as np
import pytest

from tidewater.operators import density as D
from tidewater.operators import graph as G


def brute(x, copies, ids, min_samples, size):
    """Labels by node: all distances, Kruskal's tree, then the tree is cut from the heaviest edge down."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    core = []
    for i in range(n):
        others = sorted([0.0] * (copies[i] - 1) + [d[i, j] for j in range(n) if j != i for _ in range(copies[j])])
        core.append(others[min(min_samples, len(others)) - 1] if others else 0.0)
    m = np.maximum(np.maximum(d, np.array(core)[:, None]), np.array(core)[None])
    edges = sorted((m[i, j], min(ids[i], ids[j]), max(ids[i], ids[j]), i, j) for i in range(n) for j in range(i))
    root, tree = list(range(n)), []

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for e in edges:
        a, b = find(e[3]), find(e[4])
        if a != b:
            root[a] = b
            tree.append(e)
    lam = lambda w: 1 / max(w, D.LEAST)

    def parts(nodes, below):
        """Connected parts of nodes by tree edges in below."""
        link = {i: [] for i in nodes}
        for e in below:
            link[e[3]].append(e[4])
            link[e[4]].append(e[3])
        out, seen = [], set()
        for i in nodes:
            if i not in seen:
                stack, got = [i], []
                seen.add(i)
                while stack:
                    k = stack.pop()
                    got.append(k)
                    stack += [j for j in link[k] if j not in seen]
                    seen.update(link[k])
                out.append(got)
        return out

    weigh = lambda nodes: sum(copies[i] for i in nodes)

    def condense(nodes, inner, born):
        """(stability of the best choice, its clusters) of a cluster born at density born."""
        all_nodes, stability = list(nodes), 0.0
        inner = sorted(inner)
        while inner:
            e = inner.pop()
            a, b = parts(nodes, inner)
            split = [[f for f in inner if f[3] in set(p)] for p in (a, b)]
            if weigh(a) >= size and weigh(b) >= size:
                stability += weigh(nodes) * (lam(e[0]) - born)
                best = [condense(p, s, lam(e[0])) for p, s in zip((a, b), split)]
                inside = sum(s for s, _ in best)
                if born is ROOT:
                    return inside, [c for _, found in best for c in found]
                return (stability, [all_nodes]) if stability >= inside else (inside, [c for _, found in best for c in found])
            for p, other in ((a, b), (b, a)):
                if weigh(p) < size:
                    stability += weigh(p) * (lam(e[0]) - born)
                    nodes = [i for i in nodes if i not in set(p)]
                    inner = [f for f in inner if f[3] in set(other)]
            if not nodes:
                break
        if nodes:
            stability += weigh(nodes) * (lam(core[nodes[0]]) - born)
        return stability, [] if born is ROOT else [all_nodes]

    ROOT = 0
    _, found = condense(list(range(n)), tree, ROOT)
    label = [-1] * n
    for k, nodes in enumerate(sorted(found, key=lambda c: min(ids[i] for i in c))):
        for i in nodes:
            label[i] = k
    return label


def points(seed, n):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 5)) * 4
    x = np.concatenate([centres[rng.integers(0, 6, n - n // 5)] + rng.normal(0, 0.5, (n - n // 5, 5)) * rng.uniform(0.3, 2, (n - n // 5, 1)), rng.uniform(-8, 8, (n // 5, 5))])
    return np.round(x, 3)


@pytest.mark.parametrize(("n", "block", "size"), [(500, 64, 12), (150, 1000, 5)])
def test_clusters_are_those_of_the_full_matrix(spark, n, block, size):
    x = points(n, n)
    copies = np.ones(n, int)
    copies[:4] = [size + 3, 3, 2, 7]
    rows = [(f"k{i}.{c}", v.tolist()) for i, v in enumerate(x) for c in range(copies[i])]
    rows += [("bad", None), ("empty", []), ("short", [1.0]), ("nan", [float("nan")] * 5), ("null", [None] * 5)]
    df = spark.createDataFrame(rows, "key string, v array<double>")
    got = {r["key"]: r["cluster"] for r in D.density_clusters(df, "key", "v", 4, size, block=block).collect()}
    assert len(got) == len(rows)
    from pyspark.sql import functions as F

    ids = {tuple(r["v"]): r["id"] for r in df.where("key like 'k%'").select("v", F.xxhash64("v").alias("id")).collect()}
    want = brute(x, copies.tolist(), [ids[tuple(v.tolist())] for v in x], 4, size)
    assert [got[f"k{i}.0"] for i in range(n)] == want
    assert all(got[k] is None for k in ("bad", "empty", "short", "nan", "null"))
    assert len(set(want)) > 3 and -1 in want
    assert all(got[f"k{i}.{c}"] == got[f"k{i}.0"] for i in range(4) for c in range(copies[i]))


def test_small_tables(spark):
    df = spark.createDataFrame([(i, [float(i)]) for i in range(3)], "key long, v array<double>")
    assert {r["cluster"] for r in D.density_clusters(df, "key", "v").collect()} == {-1}
    assert D.density_clusters(df.where("false"), "key", "v").count() == 0
    assert [r["cluster"] for r in D.density_clusters(df.limit(1), "key", "v").collect()] == [-1]


def test_no_table_goes_through_the_driver(spark, monkeypatch):
    """Tables of nodes are as small here as they can be, and still none is broadcast."""
    plans = []
    for module in (D, G):
        written = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, name, written=written: plans.append(df._jdf.queryExecution().executedPlan().toString()) or written(df, name))
    df = spark.createDataFrame(list(enumerate(points(1, 40).tolist())), "key long, v array<double>")
    out = D.density_clusters(df, "key", "v", 2, 4)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert out.count() == 40 and any("SortMergeJoin" in p for p in plans)
    assert not any("Broadcast" in p for p in plans)


def test_rows_that_meet_blocks_grow_with_the_table(monkeypatch, spark):
    """Vectors that no pivot parts visit a fixed number of blocks, and neighbours are searched for there once."""
    sent = []
    of = D.Blocks.meet

    def counted(self, queries, base, partners, *rest):
        sent.append(sum(self.parts[q] for q in range(len(self.parts))))
        return of(self, queries, base, partners, *rest)

    monkeypatch.setattr(D.Blocks, "meet", counted)
    monkeypatch.setattr(D, "SMALLEST_BLOCK", 8)
    for n in (400, 1600):
        x = np.random.default_rng(n).normal(size=(n, 24))
        nodes = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "id long, x array<double>, copies long")
        near = D.neighbour_lists(D.Blocks(nodes, n, 24, None), 5).collect()
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        np.fill_diagonal(d, np.inf)
        assert sorted((r["id"], r["b"]) for r in near) == sorted((i, int(j)) for i in range(n) for j in np.argsort(d[i])[:5])
        assert all(r["d"] == d[r["id"], r["b"]] or abs(r["d"] - d[r["id"], r["b"]]) < 1e-12 for r in near)
    assert max(sent) <= 4 * D.BLOCKS, sent
