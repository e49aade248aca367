"""Vector operators against brute force."""

import numpy as np
import pytest

from tickloom.llm import capfilter, multiindex

SCHEMA = "vec_id long, embedding array<float>, label int, node long, side int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1, 2) for i, v, lab in rows], SCHEMA)


def table(number=260, dims=16):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, dims))
    rows = []
    for i in range(number):
        noise = [0.02, 0.25, 0.4, 1.5][i % 4]
        v = centres[i % 12] + noise * rng.standard_normal(dims)
        rows.append((i, (v * rng.uniform(0.5, 3)).astype(np.float32).tolist(), i % 2))
    rows += [(300, rows[5][1], 1), (301, rows[5][1], 1), (302, rows[5][1], 0), (303, rows[5][1], None)]
    return rows


ODD = [
    (400, None, 1), (401, [], 1), (402, [0.0] * 16, 1), (403, [None, *[1.0] * 15], 1), (404, [float("nan"), *[1.0] * 15], 1),
    (405, [float("inf"), *[1.0] * 15], 1), (406, [1.0, 2.0], 1), (None, [1.0] * 16, 1), (407, [1e-30, *[0.0] * 15], 1),
]


def usable(v):
    return bool(v) and None not in v and np.isfinite(v).all() and np.any(v)


def test_near_vectors(spark):
    rows = table() + ODD
    found = {r["vec_id"]: r for r in capfilter.near_vectors(vectors(spark, rows).repartition(3), block_rows=20).collect()}
    assert len(found) == len(rows)
    good = [(i, np.array(v, float), lab) for i, v, lab in rows if usable(v) and i is not None and lab is not None]
    links, root = {i: 0 for i, *_ in good}, {i: i for i, *_ in good}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a, la) in enumerate(good):
        for j, b, lb in good[:k]:
            if la == lb and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93:
                links[i] += 1
                links[j] += 1
                root[max(top(i), top(j))] = min(top(i), top(j))
    assert sum(links.values()) > 300
    for i, v, lab in rows:
        row = found[i]
        assert row["n_links"] == links.get(i, 0)
        assert row["component_id"] == (top(i) if i in root else i)
        assert row["kept"] == (i is None or row["component_id"] == i)
    assert capfilter.near_vectors(vectors(spark, [])).count() == 0


@pytest.mark.parametrize("dims", [2, 8, 16, 64])
def test_pairs_at_the_threshold_are_found(dims):
    rng = np.random.default_rng(6)
    code = capfilter.ProductCode.of(dims)
    a = rng.standard_normal((1000, dims))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((1000, dims))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    near = 0.93 * a + np.sqrt(1 - 0.93**2) * b
    shared = [len(np.intersect1d(x, y)) for x, y in zip(code.decode(a), code.decode(near), strict=True)]
    assert min(shared) >= 1


def test_decoding_lists_all_filters():
    code = capfilter.ProductCode(10, 3, 40, 2.0, 2)
    unit = np.random.default_rng(1).standard_normal((5, 10))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    scores = []
    for table in range(3):
        turned = unit @ code.rotations[table % 2]
        scores.append((turned[:, :5] @ code.left[table])[:, :, None] + (turned[:, 5:] @ code.right[table])[:, None, :])
    scores = np.stack(scores, axis=1).reshape(5, -1)
    for row, found in zip(scores, code.decode(unit), strict=True):
        assert found.tolist() == np.flatnonzero(row >= 2.0).tolist()


def test_walk_visits_in_order():
    rng = np.random.default_rng(2)
    left, right, sizes = rng.standard_normal(9), rng.standard_normal(7), rng.integers(0, 5, (9, 7))
    total = left[:, None] + right
    order = np.argsort(total, axis=None)
    held = np.cumsum(sizes.reshape(-1)[order])
    for enough in (1, 10, int(held[-1])):
        want = total.reshape(-1)[order][np.searchsorted(held, enough)]
        assert multiindex.walk(left, right, sizes, enough) == pytest.approx(want)
    assert multiindex.walk(left, right, sizes, int(held[-1]) + 1) == float("inf")


def brute(rows, queries, most):
    dims = 16
    good = [(i, np.array(v, float)) for i, v, _ in rows if usable(v) and i is not None and len(v) == dims]
    ids, matrix = np.array([i for i, _ in good]), np.stack([v for _, v in good])
    out = {}
    for q, v in good:
        if q in queries:
            scores = matrix @ v
            order = [k for k in np.lexsort((ids, -np.round(scores, 9))) if ids[k] != q][:most]
            out[q] = [(int(ids[k]), scores[k]) for k in order]
    return out


def test_search(spark):
    rows = table() + ODD
    frame = vectors(spark, rows)
    queries = {i for i, *_ in rows if i is not None and i % 20 == 0}
    found = multiindex.search(frame, frame.where("vec_id % 20 = 0"), centroids=8, share=1.0).collect()
    want = brute(rows, queries, 20)
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(want)
    for q, near in want.items():
        assert [r for r, *_ in got[q]] == list(range(1, len(near) + 1))
        assert [v for _, v, _ in got[q]] == [v for v, _ in near]
        assert [s for *_, s in got[q]] == pytest.approx([s for _, s in near])
    few = multiindex.search(vectors(spark, table()[:5]), vectors(spark, table()[:1]))
    assert [r["rank"] for r in few.orderBy("rank").collect()] == [1, 2, 3, 4]
    assert multiindex.search(vectors(spark, []), vectors(spark, [])).count() == 0
    assert multiindex.search(frame, vectors(spark, [])).count() == 0


def test_recall_on_random_vectors(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.standard_normal(16).astype(np.float32).tolist(), 0) for i in range(4000)]
    frame = vectors(spark, rows)
    found = multiindex.search(frame, frame.where("vec_id % 40 = 0")).collect()
    want = brute(rows, set(range(0, 4000, 40)), 20)
    hit = sum(r["vec_id"] in {v for v, _ in want[r["query_id"]]} for r in found)
    assert hit >= 0.9 * 20 * len(want)


def test_copies_of_a_vector_do_not_enter_the_sample_together(spark, monkeypatch):
    rng = np.random.default_rng(6)
    copied = rng.standard_normal(16).astype(np.float32).tolist()
    rows = [(i, copied if i % 3 == 0 else rng.standard_normal(16).astype(np.float32).tolist(), 0) for i in range(900)]
    fit, samples = multiindex.Codebooks.fit, []

    def noted(sample, count):
        samples.append(sample)
        return fit(sample, count)

    monkeypatch.setattr(multiindex.Codebooks, "fit", noted)
    frame = vectors(spark, rows)
    multiindex.search(frame, frame.where("vec_id < 5"), centroids=4, most_fitted=150)
    copies = (np.abs(samples[0] - np.array(copied)) < 1e-6).all(axis=1).sum()
    assert 20 < copies < 90 and len(samples[0]) < 220
