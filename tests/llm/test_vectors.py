import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from frameflow.llm import clusters as C
from frameflow.llm import knn
from frameflow.llm.knn import close_pairs, similar
from frameflow.llm.vectors import BITS, Rows, dense_vectors, descriptor_vectors, fit_forest, pack, packed, unit, unpack
from frameflow.operators.ordered import neighbour_pairs
from frameflow.sources.tables import table

DATA = "/root/testdata/sf0.01"
KINDS = "name string, field string, vec_len int"
DESCRIPTORS = "descriptor_id long, feature_name string, values array<float>, kind string, vec string, id string, code long"


def test_packing_is_lossless():
    rng = np.random.default_rng(0)
    rows = [rng.standard_normal(8), np.round(rng.standard_normal(8) * 64) / 128, np.round(rng.standard_normal(8) * 3000) / 4096, np.full(8, 1e-30), np.full(8, -1.0), [3e38] + [1e-38] * 7]
    m = np.array(rows, np.float32)
    for part in (m, m[1:2], m[:1], m[[1, 1, 4]]):
        assert (unpack(pa.array(pack(part), pa.binary())) == part).all()
        assert (unpack(pa.array([b"x", *pack(part)], pa.binary()).slice(1)) == part).all()
    assert np.allclose(np.linalg.norm(unit(m), axis=1), 1, atol=1e-6)


def brute(vectors):
    """Of each kind: ids and the matrix of cosines of its comparable rows."""
    out = {}
    rows = vectors.collect()
    for kind in {r["kind"] for r in rows}:
        own = [(r["id"], r["vec"]) for r in rows if r["kind"] == kind]
        own = [(i, np.array(v, np.float64)) for i, v in own if all(x is not None and np.isfinite(x) for x in v) and any(v)]
        if own:
            ids = np.array([i for i, _ in own])
            m = np.array([v for _, v in own])
            m /= np.linalg.norm(m, axis=1)[:, None]
            s = m @ m.T
            np.fill_diagonal(s, -2)
            out[kind] = (ids, s, m)
    return out


@pytest.fixture(scope="module")
def real(spark):
    kinds = table(spark, DATA, "feature_kinds")
    return descriptor_vectors(table(spark, DATA, "descriptors"), kinds).unionByName(dense_vectors(table(spark, DATA, "features"), kinds))


def test_found_pairs_and_recall(spark, real):
    truth = brute(real)
    want = set()
    for kind, (ids, s, _) in truth.items():
        for i in range(len(ids)):
            for j in np.argsort(-s[i], kind="stable")[:5]:
                if s[i, j] >= 0.96:
                    want.add((kind, min(ids[i], ids[j]), max(ids[i], ids[j])))
    got = {(r["kind"], r["id_a"], r["id_b"]) for r in close_pairs(similar(real, min_cosine=0.96)).collect()}
    cos = {k: (dict(zip(ids, range(len(ids)), strict=True)), s) for k, (ids, s, _) in truth.items()}
    assert all(cos[k][1][cos[k][0][a], cos[k][0][b]] >= 0.96 for k, a, b in got)
    assert len(got & want) >= 0.97 * len(want)
    near = similar(real, trees=10, candidates=1500, query_step=20).collect()
    hits = total = 0
    by = {}
    for r in near:
        assert r["id"] % 20 == 0 and r["id"] != r["other"]
        by.setdefault((r["kind"], r["id"]), []).append(r)
    for kind, (ids, s, _) in truth.items():
        for i in np.flatnonzero(ids % 20 == 0):
            k = min(5, len(ids) - 1)
            mine = by.get((kind, ids[i]), [])
            assert len(mine) == k
            floor = np.sort(s[i])[::-1][k - 1] - 1e-6
            hits += sum(r["cosine"] >= floor for r in mine)
            total += k
    assert hits >= 0.9 * total


def dirty(spark, n=40):
    rng = np.random.default_rng(2)
    good = [float(x) for x in rng.standard_normal(4)]
    rows = [(i, "a", good, "x", "y", "z", 1) for i in range(n)]  # equal vectors: ties
    rows += [(100, "a", None, *["q"] * 3, 1), (101, "a", [], *["q"] * 3, 1), (102, "a", good[:3], *["q"] * 3, 1), (103, "a", [0.0] * 4, *["q"] * 3, 1)]
    rows += [(104, "a", [float("nan")] + good[1:], *["q"] * 3, 1), (105, "a", [None] + good[1:], *["q"] * 3, 1), (106, "a", [float("inf")] + good[1:], *["q"] * 3, 1)]
    rows += [(None, "a", good, *[None] * 3, None), (107, None, good, *[None] * 3, None), (108, "b", good, *["q"] * 3, 1), (109, "none", good, *["q"] * 3, 1)]
    rows += [(110, "a", [-x for x in good], *["q"] * 3, 1), (111, "a", [x * 1e30 for x in good], *["q"] * 3, 1)]
    kinds = spark.createDataFrame([("a", "values", 4), ("b", "values", 4), ("none", None, None), ("d", "dense", 4)], KINDS)
    return descriptor_vectors(spark.createDataFrame(rows, DESCRIPTORS), kinds), kinds


def test_dirty_vectors(spark):
    v, kinds = dirty(spark)
    got = similar(v, k=5, candidates=8).collect()
    ids = {r["id"] for r in got}
    assert ids == set(range(40)) | {110, 111} and all(r["id"] != r["other"] for r in got)
    first = sorted((r["rank"], r["other"]) for r in got if r["id"] == 7)
    assert len(first) == 5 and all(abs(r["cosine"] - 1) < 1e-5 for r in got if r["id"] == 7)
    feature = "feature_id long, name string, dense struct<dims:array<int>,data:array<float>>"
    rows = [(1, "d", ([2, 2], [1.0, 2.0, 3.0, 4.0])), (2, "d", ([2, 2], [1.0, 2.0, 3.0, 4.0])), (3, "d", ([4], [1.0, 2.0, 3.0, 4.0])), (4, "d", (None, [1.0, 2.0, 3.0, 4.0])), (5, "d", None), (6, "d", ([2, 2], [1.0]))]
    pairs = close_pairs(similar(dense_vectors(spark.createDataFrame(rows, feature), kinds), min_cosine=0.9)).collect()
    assert [(r["id_a"], r["id_b"]) for r in pairs] == [(1, 2)]


def test_empty_vectors(spark):
    v, kinds = dirty(spark)
    none = v.filter("id < 0")
    assert similar(none).count() == 0 and C.clusters(none).count() == 0
    bad = v.filter("id between 100 and 106")
    assert similar(bad).count() == 0 and C.described(C.clusters(bad)).count() == 0


def planted(seed=3, sizes=(200, 60, 12, 11), noise=150, d=32):
    rng = np.random.default_rng(seed)
    rows, truth = [], []
    centres, _ = np.linalg.qr(rng.standard_normal((d, d)))
    for k, n in enumerate(sizes):
        for _ in range(n):
            r = rng.standard_normal(d)
            r -= (r @ centres[k]) * centres[k]
            rows.append(centres[k] * 0.9 + r / np.linalg.norm(r) * 0.4)
            truth.append(k)
    for _ in range(noise):
        rows.append(rng.standard_normal(d))
        truth.append(-1)
    o = rng.permutation(len(rows))
    return [(int(i), "values|v", [float(x) for x in rows[p]]) for i, p in enumerate(o)], np.array(truth)[o], sizes


def test_clusters(spark):
    rows, truth, sizes = planted()
    df = spark.createDataFrame(rows, "id long, kind string, vec array<float>").repartition(5)
    m = C.clusters(df, reach=64, means=4).cache()
    got = {}
    for r in m.collect():
        got.setdefault(r["cluster"], set()).add(r["id"])
    want = [set(np.flatnonzero(truth == k).tolist()) for k in range(len(sizes)) if sizes[k] >= 12]
    assert sorted(map(sorted, (v for k, v in got.items() if k is not None))) == sorted(map(sorted, want))
    assert sum(map(len, got.values())) == len(rows) and all(k == min(v) for k, v in got.items() if k is not None)
    text = C.described(m, 3).collect()
    by_id = {r["id"]: r["cosine"] for r in m.collect()}
    for r in text:
        members = got[r["cluster"]]
        assert r["size"] == len(members)
        assert r["typical_ids"] == sorted(members, key=lambda i: (-by_id[i], i))[:3]
    pairs = neighbour_pairs(m.filter("cluster is not null"), "cluster", "id", 3).count()
    assert pairs == sum(len(w) - 1 for w in want)


def test_sets_fit_their_own_means(spark):
    # Directions all around: no set is apart from its neighbours, and the means wander for many passes.
    u = unit(np.random.default_rng(5).standard_normal((300, 4)).astype(np.float32)).astype(np.float64)
    rows = [(i, "v", v.tolist()) for i, v in enumerate(u)]
    df = spark.createDataFrame(rows, "id long, kind string, vec array<float>")
    got = {}
    for r in C.clusters(df).filter("cluster is not null").collect():
        got.setdefault(r["cluster"], []).append(r["id"])
    assert got
    for ids in got.values():
        mean = u[ids].mean(axis=0)
        assert len(ids) >= 12 and (u[ids] @ mean / np.linalg.norm(mean)).min() >= 0.8 - 1e-6


def test_pointers_lead_to_the_nearest_denser(spark):
    rng = np.random.default_rng(1)
    u = unit(rng.standard_normal((400, 5)).astype(np.float32))
    df = spark.createDataFrame([(i, "v", v.tolist(), 1.0) for i, v in enumerate(u)], "id long, kind string, vec array<float>, weight double")
    forest = fit_forest(df, 400, 2)
    records = packed(df, forest).withColumn("weight", F.lit(1.0))
    got = {r["id"]: r["root"] for r in C.peaks(records, 2, 400, 0.6, 0.7, 400).collect()}  # all rows within reach
    s = u @ u.T
    np.fill_diagonal(s, 0)
    dense = np.round(2 * np.where(s >= 0.6, s, 0).sum(axis=1), 3)
    parent = []
    for i in range(400):
        denser = [j for j in range(400) if s[i, j] >= 0.7 and (dense[j] > dense[i] + 2e-3 or abs(dense[j] - dense[i]) <= 2e-3 and j < i)]
        parent.append(max(denser, key=lambda j: s[i, j]) if denser else i)
    for _ in range(400):
        parent = [parent[p] for p in parent]
    assert sum(got[i] == parent[i] for i in range(400)) >= 360  # densities that round alike may differ, and then all roots below them
    assert len(set(got.values())) < 40


def test_density_and_nearest_denser():
    rng = np.random.default_rng(3)
    u = unit(rng.standard_normal((50, 6)).astype(np.float32))
    s = u @ u.T
    assert np.allclose(C.density(u, u, np.arange(50.0), 0.3), [(s[i] * (s[i] >= 0.3) * np.arange(50)).sum() for i in range(50)], atol=1e-3)
    rank = rng.permutation(50)
    near, cosine = C.nearest_denser(u, u, rank, rank, 0.2)
    for i in range(50):
        better = [j for j in range(50) if rank[j] < rank[i] and s[i, j] >= 0.2]
        assert near[i] == (max(better, key=lambda j: s[i, j]) if better else -1)


def test_prefix_ranges_match_brute_force():
    rng = np.random.default_rng(4)
    code = np.sort(np.r_[rng.integers(0, 2**BITS, 60), rng.integers(0, 2**20, 60), np.full(30, 77), 0, 2**BITS - 1])
    text = [format(c, f"0{BITS}b") for c in code.tolist()]
    share = lambda i, n: [j for j in range(len(text)) if text[j][:n] == text[i][:n]]
    offsets, steps = knn.profile(code, 40)
    for want in (1, 7, 40):
        length = knn.ascend(offsets, steps, want)
        for i in range(len(code)):
            assert length[i] == max((n for n in range(BITS + 1) if len(share(i, n)) - 1 >= want), default=0)
        lo, hi = knn.ranges(code, length, 10)
        for i in range(len(code)):
            rows = [j for j in share(i, length[i]) if abs(j - i) <= 10]
            assert (lo[i], hi[i]) == (rows[0], rows[-1] + 1)


def test_trees_ascend_together():
    # Row 0 shares 10 bits with three rows in one tree and 5 bits with four rows in the other.
    offsets, steps = np.array([0, 3]), np.array([(10 << 24) | 3, (5 << 24) | 4, (2 << 24) | 50])
    assert [int(knn.ascend(offsets, steps, m)[0]) for m in (1, 3, 4, 7, 8, 57, 58)] == [10, 10, 5, 5, 2, 2, 0]


def test_partition_edges_separate_nothing(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((4000, 12))
    rows = [(i, "v", v.tolist()) for i, v in enumerate(np.r_[base, base + 1e-3 * rng.standard_normal(base.shape)])]
    df = spark.createDataFrame(rows, "id long, kind string, vec array<float>")
    got = {(r["id_a"], r["id_b"]) for r in close_pairs(similar(df, k=1, trees=2, candidates=40, min_cosine=0.99)).collect()}
    assert len(got & {(i, i + 4000) for i in range(4000)}) >= 3980


def test_a_third_of_the_rows_are_equal(spark):
    rng = np.random.default_rng(6)
    hot = rng.standard_normal(8).tolist()
    rows = [(i, "v", hot if i % 3 == 0 else rng.standard_normal(8).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, kind string, vec array<float>").repartition(7)
    near = {}
    for r in similar(df, candidates=60).collect():
        near.setdefault(r["id"], []).append((r["rank"], r["other"], r["cosine"]))
    for i in range(0, 3000, 3):
        assert [o for _, o, _ in sorted(near[i])] == [j for j in (0, 3, 6, 9, 12, 15) if j != i][:5]
    assert all(len(v) == 5 for v in near.values()) and len(near) == 3000


def test_clusters_of_exactly_the_least_size_spread_over_blocks(spark):
    rows, truth, sizes = planted(21, (12,) * 20, 4000)
    df = spark.createDataFrame(rows, "id long, kind string, vec array<float>")
    got = {}
    for r in C.clusters(df, reach=128).filter("cluster is not null").collect():
        got.setdefault(r["cluster"], set()).add(r["id"])
    assert sorted(map(sorted, got.values())) == sorted(np.flatnonzero(truth == k).tolist() for k in range(20))


@pytest.mark.parametrize("cut", [None, 0, 5, 40, 73])
def test_pieces_within_reach_meet_once(cut):
    none = np.zeros(73)
    rows = Rows("v", none, none, pa.nulls(73), {}, cut)
    met = {}
    for a, z, lo, hi in rows.meets(8, 20):
        assert 0 < z - a <= 8 and 0 < hi - lo <= 8 and (lo, hi) == (a, z) or lo >= z
        for i in range(a, z):
            for j in range(lo, hi):
                met[i, j] = met.get((i, j), 0) + 1
    assert set(met.values()) <= {1}
    for i in range(73):
        for j in range(i, min(i + 21, 73)):
            assert ((i, j) in met) == (cut is None or i < cut <= j)


def test_later_passes_compare_only_what_changed(spark, monkeypatch):
    rows, truth, sizes = planted()
    df = spark.createDataFrame(rows, "id long, kind string, vec array<float>")
    met, taken = [], C.taken

    def counted(outside, records, *more):
        met.append(outside.count() * records.count())
        return taken(outside, records, *more)

    monkeypatch.setattr(C, "taken", counted)
    got = {}
    for r in C.clusters(df).filter("cluster is not null").collect():
        got.setdefault(r["cluster"], set()).add(r["id"])
    assert sorted(map(sorted, got.values())) == sorted(np.flatnonzero(truth == k).tolist() for k in range(3))
    assert len(met) > 1 and sum(met[1:]) < met[0]
