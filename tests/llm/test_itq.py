import numpy as np

from hostlens.llm import itq


def vectors(seed=1, n=300, dim=32):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    out = [list(map(float, np.float32(x))) for x in base]
    for i in range(0, n, 3):
        for scale in (0.02, 0.15, 0.25):
            out.append(list(map(float, np.float32(base[i] + scale * rng.normal(size=dim) * np.linalg.norm(base[i]) / np.sqrt(dim)))))
    out += [out[0]] * 5 + [[2 * x for x in out[1]], [-x for x in out[2]]]
    for k in range(60):
        out.append(list(map(float, np.float32(base[0] + 0.05 * k / 60 * rng.normal(size=dim)))))
    return out


def plain(rows, threshold=0.95):
    ids = [i for i, v in rows]
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    root = {}
    for i in range(len(ids)):
        if i in root:
            continue
        todo, seen = [i], {i}
        while todo:
            for j in np.flatnonzero(near[todo.pop()]):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        for j in seen:
            root[j] = min(ids[k] for k in seen)
    return {ids[i]: (int(near[i].sum()), root[i]) for i in range(len(ids))}


def test_against_brute_force(spark):
    rows = list(enumerate(vectors()))
    bad = [(9000, None), (9001, [0.0] * 32), (9002, [None] + [1.0] * 31), (9003, [float("nan")] * 32), (9004, [float("inf")] + [0.0] * 31), (9005, [1.0, 2.0]), (9006, []), (None, rows[0][1])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows + bad], "vec_id long, embedding array<float>, n_links int").repartition(4)
    want = plain(rows)
    full = sum(n for n, _ in want.values())
    for most in (2048, 16):
        got = {r.vec_id: r for r in itq.linked(frame, most=most).collect()}
        assert len(got) == len(rows) + len(bad)
        assert all(got[i].n_links <= n for i, (n, _) in want.items())
        assert sum(got[i].n_links for i in want) >= 0.95 * full
        assert np.mean([got[i].component_id == c for i, (_, c) in want.items()]) > 0.95
        for i, _ in bad:
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
        assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_pairs_just_above_the_threshold_and_several_lengths(spark):
    """Recall among pairs of cosine 0.95 to 0.96, in an index of many and in the single bucket of a small length."""
    rng = np.random.default_rng(8)
    rows, pairs = [], []
    for dim, n in ((24, 600), (48, 250)):
        one = itq.unit(rng.normal(size=(n, dim)))
        side = rng.normal(size=one.shape)
        side = itq.unit(side - (side * one).sum(1, keepdims=True) * one)
        cosine = rng.uniform(0.9503, 0.96, size=(n, 1))
        for x, y in zip(one, cosine * one + np.sqrt(1 - cosine**2) * side):
            pairs.append((len(rows), len(rows) + 1))
            rows += [(len(rows), [float(v) for v in 3 * x]), (len(rows) + 1, [float(v) for v in y])]
    frame = spark.createDataFrame([*rows, (90_000, [1.0]), (90_001, [2.0]), (90_002, [-1.0])], "vec_id long, embedding array<double>").repartition(4)
    got = {r.vec_id: r for r in itq.linked(frame, most=600).collect()}
    large, small = ([got[a].n_links > 0 and got[a].component_id == got[b].component_id for a, b in part] for part in (pairs[:600], pairs[600:]))
    print(np.mean(large), np.mean(small))
    assert np.mean(large) >= 0.9 and all(small)
    assert [(got[i].n_links, got[i].component_id) for i in (90_000, 90_001, 90_002)] == [(1, 90_000), (1, 90_000), (0, 90_002)]


def test_bits_are_balanced_and_keep_neighbours():
    x = itq.unit(np.array(vectors(2)))
    codes = itq.fit(x, len(x), 0.95)
    bits = (x - codes.mean) @ codes.projections > 0
    assert 0.3 < bits.mean() < 0.7
    assert codes.of(x).max() < 1 << codes.width


def test_recall_with_a_common_mean_and_many_vectors():
    rng = np.random.default_rng(6)
    dim, cosine = 64, 0.951
    for norm in (0.0, 0.8):
        centre = np.zeros(dim)
        centre[0] = norm
        x = itq.unit(centre + np.sqrt(1 - norm**2) * rng.normal(size=(8000, dim)) / np.sqrt(dim))
        codes = itq.fit(x[:6000], 1_000_000, 0.95)
        one = x[6000:]
        side = rng.normal(size=one.shape)
        side = itq.unit(side - (side * one).sum(1, keepdims=True) * one)
        two = cosine * one + np.sqrt(1 - cosine**2) * side
        recall = (codes.of(one) == codes.of(two)).any(1).mean()
        print(norm, codes.width, codes.tables, recall)
        assert recall >= 0.95


def test_small_tables(spark):
    schema = "vec_id long, embedding array<double>"
    assert itq.linked(spark.createDataFrame([], schema)).count() == 0
    assert [tuple(r) for r in itq.linked(spark.createDataFrame([(5, None)], schema)).collect()] == [(5, 0, 5, True)]
    got = {tuple(r) for r in itq.linked(spark.createDataFrame([(5, [1.0, 0.0]), (4, [1.0, 0.0]), (4, [1.0, 0.0])], schema)).collect()}
    assert got == {(5, 2, 4, False), (4, 2, 4, True)}
