import numpy as np
import pytest

from acrelens.llm import ann

SCHEMA = "vec_id long, embedding array<float>, rank int"


def exact(rows, k, every=20):
    ok = {i: np.array(v, dtype=np.float64) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v) and len(v) == 8}
    out = []
    for q in sorted(ok):
        if q % every == 0:
            ranked = sorted(((-float(ok[q] @ v), i) for i, v in ok.items() if i != q))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(ranked, 1)]
    return out


def found(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


def test_a_forest_that_keeps_everything_is_exact(spark):
    rows_per_group = 40
    rng = np.random.default_rng(1)
    rows = [(i, (rng.standard_normal(8) * rng.choice([0.3, 1, 3])).tolist(), 0) for i in range(150)]
    rows += [(i, rows[7][1], 0) for i in range(200, 290)] + [rows[3], (None, rows[0][1], 0), (500, None, 0), (520, [0.0] * 8, 0), (540, [1.0] * 7 + [None], 0), (560, [float("nan")] + [1.0] * 7, 0), (580, [float("inf")] + [1.0] * 7, 0), (600, [1.0] * 3, 0), (620, [], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], 0) for i, v, _ in rows]
    kept = found(ann.nearest(df, trees=3, rows_per_group=rows_per_group, candidates=10**9))
    wanted = exact(rows, 20)
    assert [x[:3] for x in kept] == [x[:3] for x in wanted]
    assert np.allclose([x[3] for x in kept], [x[3] for x in wanted], rtol=1e-14)
    met = {(q, i) for q, _, i, _ in found(ann.nearest(df, trees=8, rows_per_group=rows_per_group))}
    assert len(met & {(q, i) for q, _, i, _ in wanted}) >= 0.9 * len(wanted)


def test_recall_and_ascending_on_random_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    products = x[::20] @ x.T
    products[np.arange(100), np.arange(0, 2000, 20)] = -9
    best = {(20 * q, int(i)) for q, row in enumerate(products) for i in np.argpartition(-row, 20)[:20]}
    full = {(r[0], r[2]) for r in found(ann.nearest(df))}
    assert len(full & best) >= 0.9 * len(best)
    short = {(r[0], r[2]) for r in found(ann.nearest(df, candidates=5, trees=8))}
    assert len(short & best) < len(full & best)
    assert short


def tied_tables():
    rng = np.random.default_rng(6)
    return {
        "whole": rng.integers(-2, 3, (400, 8)),
        "binary": rng.integers(0, 2, (400, 16)),
        "one-hot": np.eye(64, dtype=int)[rng.integers(0, 64, 400)],
        "two values": rng.integers(0, 2, (300, 3)) * 2 - 1,
    }


def ranked_by_hand(x, names):
    """Whole numbers: every sum is exact, so ties are ties."""
    out = {}
    for q in range(len(x)):
        if names[q] % 20 == 0 and x[q].any():
            order = sorted((-int(x[q] @ x[i]), int(names[i])) for i in range(len(x)) if i != q and x[i].any())
            out[int(names[q])] = [(i, -float(s)) for s, i in order[:20]]
    return out


@pytest.mark.parametrize("kind", ["whole", "binary", "one-hot", "two values"])
def test_ties_go_to_the_smaller_id(spark, kind):
    x = tied_tables()[kind]
    names = np.random.default_rng(8).permutation(3 * len(x))[: len(x)]
    rows = spark.createDataFrame([(int(i), [float(c) for c in v], 0) for i, v in zip(names, x)], "vec_id long, embedding array<double>, rank int").repartition(7)
    want = ranked_by_hand(x, names)

    def lists(**settings):
        out = {}
        for q, rank, i, score in found(ann.nearest(rows, **settings)):
            out.setdefault(q, []).append((i, score))
        return out

    assert lists(candidates=10**9, trees=4, rows_per_group=60, queries_per_group=5) == want  # cut in many blocks
    got = lists()  # as in production
    assert set(got) == set(want)
    assert sum(got[q] == want[q] for q in want) >= 0.9 * len(want)
    for q, own in got.items():
        assert own == sorted(own, key=lambda x: (-x[1], x[0])) and len(own) == len(want[q])


def test_products_are_the_same_in_any_block():
    rng = np.random.default_rng(4)
    q, x = rng.standard_normal((30, 64)), rng.standard_normal((500, 64))
    x[100:200] = x[0] * 1.0
    whole = {}
    for a, b in ((0, 500), (0, 37), (37, 250), (250, 500), (90, 210)):
        i, j = ann.reaching(q, x[a:b], 20)
        for r, c, s in zip(i.tolist(), (j + a).tolist(), ann.products(q, x[a:b], i, j).tolist()):
            assert whole.setdefault((r, c), s) == s
    for (r, c), s in list(whole.items())[:200]:
        by_hand = 0.0
        for p in range(64):
            by_hand += float(q[r, p]) * float(x[c, p])
        assert by_hand == s
    i, j = ann.reaching(q, x, 20)  # all that ties at the cut is there
    assert all(set(range(100, 200)) <= set(j[i == r]) for r in range(30) if 150 in j[i == r])


def unit_rows(n, lengths=None):
    x = np.random.default_rng(2).standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x if lengths is None else x * lengths[:, None]


def recall(spark, x, **settings):
    """Recall at 20, and the fewest rows that a query got."""
    n = len(x)
    met = {(r[0], r[2]) for r in found(ann.nearest(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA), **settings))}
    asked = np.arange(0, n, 20)
    products = x[asked] @ x.T
    products[np.arange(len(asked)), asked] = -1e9
    best = {(int(q), int(i)) for q, row in zip(asked, products) for i in np.argsort(-row)[: min(20, n - 1)]}
    counts = [sum(q == a for q, _ in met) for a in asked.tolist()]
    return len(met & best) / len(best), min(counts)


def test_many_vectors_a_group_do_not_shorten_the_ascent(spark):
    share, fewest = recall(spark, unit_rows(2000), rows_per_group=100, trees=24)
    assert share >= 0.9 and fewest == 20


def test_small_tables_give_all_they_have(spark, n=15):
    assert recall(spark, unit_rows(n), trees=4) == (1.0, min(20, n - 1))


def test_queries_meet_blocks_in_turns(spark):
    assert recall(spark, unit_rows(45), rows_per_group=20, queries_per_group=2, trees=2) == (1.0, 20)


@pytest.mark.parametrize("kind", ["one long", "spread"])
def test_unequal_lengths(spark, kind):
    lengths = np.exp(0.1 * np.random.default_rng(3).standard_normal(2000)) if kind == "spread" else np.where(np.arange(2000) == 7, 10.0, 1.0)
    share, fewest = recall(spark, unit_rows(2000, lengths))
    assert share >= 0.9 and fewest == 20


def test_prefixes_are_as_long_as_the_surroundings_are_dense(spark):
    rng = np.random.default_rng(5)
    tight = rng.standard_normal(64) + 0.05 * rng.standard_normal((1500, 64))
    loose = rng.standard_normal((1500, 64))
    x = np.vstack([tight, loose])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    forest = ann.Forest(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA), ann.Settings())
    names = {r["u"]: r["vec_id"] for r in forest.asked.collect()}
    level = {names[r["u"]]: r["level"] for r in forest.levels().collect()}
    assert min(level.values()) > 3 and len(set(level.values())) >= 3
    assert np.median([v for i, v in level.items() if i < 1500]) >= np.median([v for i, v in level.items() if i >= 1500]) + 3


def test_strings_turn_the_least_certain_signs():
    y = np.random.default_rng(1).standard_normal((50, 64))
    own = ann.strings(y)
    assert all(int(c) == int("".join("1" if v > 0 else "0" for v in row), 2) for c, row in zip(own, y))
    for code, turned in ann.probed(y, 3)[1:]:
        assert all(int(a ^ b) == 1 << (63 - t) and t < ann.TURNED for a, b, t in zip(own, code, turned.tolist()))
    codes = np.sort(own)
    for level in (0, 1, 5, 64):
        low, high = ann.spans(codes, own, np.full(50, level))
        assert (high - low).tolist() == [sum(int(a) >> 64 - level == int(b) >> 64 - level for a in own) for b in own]


def test_no_vectors(spark):
    assert ann.nearest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert ann.nearest(spark.createDataFrame([(20, [1.0, 2.0], 0)], SCHEMA)).count() == 0
