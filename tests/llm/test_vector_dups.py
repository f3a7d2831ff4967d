"""Vector near-duplicates against all pairs."""

import numpy as np
import pytest

from veldspar.llm import vector_dups

ROW = "vec_id long, label int, embedding array<float>, node string, x int"


def plain(rows, least=0.95):
    """(vec_id, n_links, component_id, kept) by all cosines."""
    ok = [bool(e) and all(v is not None and np.isfinite(v) for v in e) and any(e) for _, e in rows]
    n, top = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for dim in {len(e) for (_, e), good in zip(rows, ok, strict=True) if good}:
        at = [i for i, (_, e) in enumerate(rows) if ok[i] and len(e) == dim]
        x = np.array([rows[i][1] for i in at], np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for i, j in zip(*np.nonzero(np.triu(x @ x.T >= least, 1)), strict=True):
            n[at[i]] += 1
            n[at[j]] += 1
            top[root(at[i])] = root(at[j])
    ids = {}
    for i, (v, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(v)
    out = []
    for i, (v, _) in enumerate(rows):
        least_id = min((k for k in ids[root(i)] if k is not None), default=None)
        out.append((v, n[i], least_id, v is not None and v == least_id))
    return sorted(out, key=str)


def grouped(spark, rows, **more):
    return sorted(map(tuple, vector_dups.grouped(spark.createDataFrame([(v, 1, e, "n", 2) for v, e in rows], ROW), **more).collect()), key=str)


def near(r, x, cosine):
    """A vector at about this cosine from x."""
    z = r.normal(size=x.shape)
    z -= (z @ x) / (x @ x) * x
    return cosine * x / np.linalg.norm(x) + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z)


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(2)
    base = [r.normal(size=32) for _ in range(300)]
    out = list(base)
    for i in range(0, 200, 2):  # pairs and chains around the limit
        out += [near(r, base[i], c) for c in r.uniform(0.93, 0.999, size=r.integers(1, 4))]
    hot = r.normal(size=32)
    out += [near(r, hot, c) for c in r.uniform(0.93, 1, size=400)]  # a hot group with a rim
    out += [base[0] * 3, base[0], base[0], hot, hot]
    out = [(int(i), (v * r.uniform(0.1, 9)).tolist() if k < 700 else v.tolist()) for k, (i, v) in enumerate(zip(r.permutation(len(out)), out, strict=True))]
    return out


@pytest.mark.parametrize("list_rows, asked, asking, core", [(512, 4096, 1 << 14, True), (30, 60, 100, True), (30, 60, 100, False)])
def test_links_equal_all_pairs(spark, monkeypatch, rows, list_rows, asked, asking, core):
    """Sufficient probes lose nothing: half the linking distance (``sure`` large) is exact."""
    for name, value in (("LIST_ROWS", list_rows), ("ASKED", asked), ("ASKING", asking)):
        monkeypatch.setattr(vector_dups, name, value)
    if not core:  # nothing is near enough to its centroid
        monkeypatch.setattr(vector_dups, "TINY", 0.2)
    odd = [(5000, None), (5001, []), (5002, [0.0] * 32), (5003, [None] * 32), (5004, [float("nan")] * 32), (None, rows[3][1]), (5005, [1.0, 2.0]), (5006, [2.0, 4.0]), (5006, [2.0, 4.0]), (5007, [1e38, 3e38]), (None, [7.0, -1.0])]
    assert grouped(spark, rows + odd, sure=99.0) == plain(rows + odd)


def test_recall_of_the_probes(spark, monkeypatch):
    """With the index's own probes: at least 0.99 of the links of brute force, none else."""
    monkeypatch.setattr(vector_dups, "LIST_ROWS", 40)
    r = np.random.default_rng(6)
    centres = r.normal(size=(40, 64))
    base = centres[r.integers(0, 40, size=1500)] + 1.2 * r.normal(size=(1500, 64))
    rows = [(i, v.tolist()) for i, v in enumerate([*base, *(near(r, v, c) for v, c in zip(base[:700], r.uniform(0.95, 0.99, size=700), strict=True))])]
    got, want = grouped(spark, rows), plain(rows)
    found, there = sum(x[1] for x in got), sum(x[1] for x in want)
    assert 0.99 * there <= found <= there and there >= 1400
    assert all(a[1] <= b[1] for a, b in zip(got, want, strict=True))


def test_codes_lose_no_pair_and_save_reranks():
    r = np.random.default_rng(9)
    u = vector_dups.units(r.normal(size=(600, 32)))
    centres = vector_dups.k_means(u, u[:8])
    rest = u - centres[vector_dups.nearest(u, centres)]
    parts = [(i, i + 4) for i in range(0, 32, 4)]
    index = vector_dups.Index(32, centres, parts, [vector_dups.k_means(rest[:, a:b], rest[:256, a:b]) for a, b in parts], 0.95)
    home = vector_dups.nearest(u, centres)
    codes, error = index.encode(u - centres[home])
    for j in range(8):
        mine = np.flatnonzero(home == j)
        at = index.looked_up(u - centres[j], codes[mine])
        true = np.sqrt(((u[:, None] - u[mine]) ** 2).sum(axis=2))
        assert (np.abs(at - true) <= error[mine] + 1e-9).all()
        assert (at <= index.apart + error[mine]).mean() < 0.2


def test_empty_and_linkless_tables(spark):
    assert grouped(spark, []) == []
    assert grouped(spark, [(3, None), (None, None)]) == sorted([(3, 0, 3, True), (None, 0, None, False)], key=str)
