"""Hard negatives, exact copies and whitening against brute force, and their edge cases."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attestor.llm import exact_dedup, hard_negatives, whitening

ODD = "vec_id long, embedding array<float>, label int, id string, x int, v string, folder string, rank int"


def odd_vectors(spark, rows):
    return spark.createDataFrame([(*r, "i", 1, "v", "f", 1) for r in rows], ODD)


# --- exact copies


def copies(spark, texts):
    return spark.createDataFrame([(i, t, "r", 1, True) for i, t in texts], "doc_id long, text string, row string, size int, company boolean")


def decided(df, **how):
    return sorted(tuple(r) for r in exact_dedup.decided(df, **how).select("id", "keep_id", "group_size", "kept", "text_sha256").collect())


def folded(text):
    return (text or "").translate(str.maketrans(exact_dedup.UPPER, exact_dedup.LOWER))


def test_copies_against_plain_groups(spark):
    rng = np.random.default_rng(5)
    draw = lambda: "".join(rng.choice(list("aAbBéÉ \n"), rng.integers(0, 4))) + rng.choice(["", "x" * 64, "y" * 70, "İ" * 70])
    texts = [(i, draw() + rng.choice(["", "end", "End", "enD!"])) for i in range(600)]
    want = []
    groups = {}
    for i, t in texts:
        groups.setdefault(folded(t), []).append(i)
    for i, t in texts:
        own = groups[folded(t)]
        want.append((i, max(own), len(own), i == max(own), hashlib.sha256(folded(t).encode()).hexdigest()))
    df = copies(spark, texts)
    assert decided(df, digests=True) == sorted(want)
    assert [r[:4] for r in decided(df)] == sorted(r[:4] for r in want)
    # alone in their length or prefix: told apart without reading the text to its end
    assert all(r[4] is not None for r in decided(df) if r[2] > 1) and any(r[4] is None for r in decided(df))
    left = exact_dedup.deduplicated(df)
    assert left.columns == df.columns and sorted(r["doc_id"] for r in left.collect()) == sorted(i for i, _, _, kept, _ in want if kept)


def test_lower_cases_ascii_only(spark):
    letters = "".join(chr(c) for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000)
    got = spark.createDataFrame([(letters,), ("ABC xyz",), (None,)], "t string").select(exact_dedup.normalised("t")).collect()
    assert [r[0] for r in got] == [folded(letters), "abc xyz", ""]


def test_copies_odd_rows(spark):
    long = "word " * 200_000
    texts = [(1, None), (2, ""), (3, "One"), (3, "one"), (None, "one"), (None, "lone"), (None, "lone"), (4, long), (5, long.upper())]
    got = exact_dedup.decided(copies(spark, texts)).select("id", "keep_id", "group_size", "kept").collect()
    rows = sorted((tuple(r) for r in got), key=repr)
    empty = [(1, 2, 2, False), (2, 2, 2, True)]
    ones = [(3, 3, 3, False), (3, 3, 3, True), (None, 3, 3, False)]
    lone = [(None, None, 2, False), (None, None, 2, True)]
    assert rows == sorted([*empty, *ones, *lone, (4, 5, 2, False), (5, 5, 2, True)], key=repr)
    assert decided(copies(spark, [])) == []


def test_a_third_of_all_rows_in_one_group(spark):
    df = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same text")).otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"))
    got = exact_dedup.decided(df).groupBy("group_size", "kept").count().collect()
    assert sorted(tuple(r) for r in got) == [(1, True, 6000), (3000, False, 2999), (3000, True, 1)]


def test_no_python_in_the_plan(spark):
    plan = exact_dedup.decided(copies(spark, [(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- hard negatives


def brute_negatives(rows, every=50):
    rows = [(i, lab, np.array([np.floor(256 * float(x)) for x in v]).astype(int)) for i, v, lab in rows]
    out = []
    for a, la, va in rows:
        if a % every:
            continue
        scored = [(int(va @ v), i, lab) for i, lab, v in rows if i != a]
        order = sorted(scored, key=lambda s: (-s[0], s[1]))
        for p, pid, _ in [s for s in order if s[2] == la][:5]:
            fit = [s for s in order if s[2] != la and 50 * p <= 100 * s[0] <= 95 * p][:3]
            out += [(a, pid, k, nid, p, n) for k, (n, nid, _) in enumerate(fit, 1)]
    return sorted(out)


def clustered(n, dims, seed=1):
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(6, dims))
    of = rng.integers(0, 6, n)
    v = heads[of] + rng.normal(size=(n, dims)) * rng.choice([0.02, 0.5], n)[:, None]
    v /= np.linalg.norm(v, axis=1)[:, None]
    return [(i, [float(np.float32(x)) for x in v[i]], int((of[i] + (rng.random() < 0.3)) % 6)) for i in range(n)]


@pytest.mark.parametrize("block, anchors", [(512, 65_536), (16, 7)])
def test_negatives_against_brute_force(spark, block, anchors):
    rows = clustered(700, 12)
    got = hard_negatives.mined(odd_vectors(spark, rows), block=block, anchors=anchors)
    assert sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == brute_negatives(rows)


def test_negatives_odd_rows(spark):
    rows = [(0, [1.0, 0.5], 1), (None, [1.0, 1.0], 1), (1, None, 1), (2, [1.0, None], 2), (3, [float("nan"), 1.0], 2), (4, [1.0, float("inf")], 2), (5, [1.0, 0.5], None)]
    rows += [(6, [1.0], 1), (7, [0.75, 0.0], 2), (7, [0.75, 0.0], 2), (8, [], 2), (9, [0.5], 3), (10, [3e38, 1.0], 2), (50, [-1.0, 0.0], 4), (51, [1.0, 0.0], 4)]
    got = sorted(tuple(r) for r in hard_negatives.mined(odd_vectors(spark, rows)).collect())
    # the best other row of label 1 scores 65,536; 51 scores as much, beyond 95 %, and 7 and 9 fall in the window
    assert got == [(0, 6, 1, 7, 65536, 49152), (0, 6, 2, 7, 65536, 49152), (0, 6, 3, 9, 65536, 32768)]
    assert hard_negatives.mined(odd_vectors(spark, [])).count() == 0
    assert hard_negatives.mined(odd_vectors(spark, [(0, [], 1), (1, [], 1), (2, [], 2)])).collect()[0]["negative_score"] == 0


@pytest.mark.parametrize("dims, bits", [(1, 4), (2, 4), (3, 3), (5, 2)])
def test_curve_visits_neighbours(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    places = [p.tobytes() for p in hard_negatives.curve_places(cells, bits)]
    order = sorted(range(len(cells)), key=places.__getitem__)
    assert len(set(places)) == len(cells)
    assert (np.abs(np.diff(cells[order], axis=0)).sum(1) == 1).all()


def test_zone_maps_keep_far_blocks_unread(spark, tmp_path):
    rows = hard_negatives.usable(odd_vectors(spark, clustered(2000, 6, seed=3)), "vec_id", "embedding", "label")
    blocks = hard_negatives.write_blocks(rows, f"{tmp_path}/blocks", every=50, block=50).toPandas()
    v = np.array([1, 2, 3, 4, 5, 6]) * 40
    wanted, held = 0, 0
    for _, b in blocks.iterrows():
        scores = np.frombuffer(b["rows"], np.int32).reshape(len(b["ids"]), -1) @ v
        looking = hard_negatives.Anchors(np.array([-1]), np.array([99]), v[None].astype(np.int32), np.zeros(1, int), np.zeros(1, int), np.array([40_000]), np.array([60_000]), 3, False)
        reads = len(looking.wanted(b["kinds"], b["low"], b["high"])) == 1
        fit = ((scores >= 40_000) & (scores <= 60_000)).any()
        assert reads or not fit
        wanted, held = wanted + reads, held + fit
    assert held and wanted <= 0.75 * len(blocks)


# --- whitening


def vectors(rng, n, dims):
    return [(i, [float(x) for x in np.float32(rng.normal(size=dims) @ np.diag(rng.uniform(0.2, 3, dims)) + 1)], 0) for i in range(n)]


def whiten(df, **how):
    return whitening.whitened(df, **how).toPandas().sort_values(["id", "component"])


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(2)
    rows = vectors(rng, 900, 40)
    got = whiten(odd_vectors(spark, rows))
    x = np.floor(64 * np.array([v for _, v, _ in rows])).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(0)
    away = (n * x - total) / n
    values, axes = np.linalg.eigh(away.T @ away / n)
    values, axes = values[::-1][:32], axes[:, ::-1][:, :32]
    want = away @ axes / np.sqrt(values)
    seen = got.whitened.to_numpy().reshape(n, 32)
    assert np.abs(seen * np.sign((seen * want).sum(0)) - want).max() < 1e-9
    assert (got.deviation.to_numpy().reshape(n, 32) == ((n * x - total) ** 2).sum(1)[:, None]).all()
    assert np.allclose(got.explained.to_numpy().reshape(n, 32), values / np.trace(away.T @ away / n), rtol=1e-9)
    assert got.n.unique().tolist() == [n] and got.identity_error.max() < 1e-9 and got.identity_error.nunique() == 1


def test_planes_give_exact_products(spark):
    rng = np.random.default_rng(4)
    x = np.stack([rng.integers(0, 1 << b, 3000) - 5 for b in (1, 7, 20, 52)], 1)
    rows = spark.createDataFrame([(r,) for r in x.tolist()], "x array<long>")
    model = whitening.fitted(rows)
    low = x.min(0)
    y = (x - low).astype(object)
    assert model.sums == list(y.sum(0)) and model.n == 3000
    exact = lambda i, j: 3000 * sum(y[:, i] * y[:, j]) - sum(y[:, i]) * sum(y[:, j])
    assert all(model.covariance[i, j] == exact(i, j) / 9_000_000 for i in range(4) for j in range(4))


def test_deviations_beyond_64_bits_are_null():
    x = np.array([[0], [1 << 40], [3]])
    model = whitening.Whitening(3, np.array([0]), [int(x.sum())], np.eye(1), np.ones(1), np.eye(1))
    want = [(3 * int(v) - int(x.sum())) ** 2 for v in x[:, 0]]
    assert model.deviations(x).to_pylist() == [w if w < 1 << 63 else None for w in want]
    small = np.array([[0], [1_000_000_000], [17]])
    model = whitening.Whitening(3, np.array([0]), [int(small.sum())], np.eye(1), np.ones(1), np.eye(1))
    assert model.deviations(small).to_pylist() == [(3 * int(v) - int(small.sum())) ** 2 for v in small[:, 0]]


def test_whitening_odd_rows(spark):
    rows = [(1, None, 0), (2, [1.0, None], 0), (3, [float("nan"), 1.0], 0), (4, [float("-inf"), 1.0], 0), (5, [1.0], 0), (6, [], 0), (7, [3e38, 0.0], 0)]
    good = [(8, [1.0, 2.0], 0), (8, [1.0, 2.0], 0), (None, [3.0, 2.0], 0), (9, [5.0, 2.0], None)]
    got = whitening.whitened(odd_vectors(spark, rows + good)).toPandas()
    assert len(got) == 8 and set(got.n) == {4} and got.id.isna().sum() == 2
    first, second = (got[got.component == k] for k in (1, 2))
    assert second.whitened.isna().all() and (second.explained.abs() < 1e-12).all() and np.allclose(first.explained, 1)
    # n*x - S of 64, 64, 192, 320: -384, -384, 128, 640
    assert sorted(first.deviation) == [16384, 147456, 147456, 409600] and (got.identity_error < 1e-12).all()
    alone = whitening.whitened(odd_vectors(spark, [(1, [1.0, 2.0], 0)])).toPandas()
    assert len(alone) == 2 and alone.whitened.isna().all() and alone.explained.isna().all() and (alone.identity_error == 0).all()
    assert whitening.whitened(odd_vectors(spark, [])).count() == 0 == whitening.whitened(odd_vectors(spark, rows[5:6])).count()


def test_matrix_of_planes():
    y = np.array([[5, 0], [3, 1], [0, 1]], np.uint64)
    planes = whitening.sliced(y, np.array([3, 1]))
    counts = whitening.plane_counts(planes)
    assert counts.diagonal().tolist() == [2, 1, 1, 2] and counts[0, 3] == 1 and counts[1, 3] == 1 and counts[2, 3] == 0
    assert isinstance(pa.array(counts.ravel()), pa.Int64Array)
