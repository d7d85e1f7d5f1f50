"""The metric tree and what builds on it, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from segmill.operators import balls, cells, clustering, embedding, neighbours, silhouette, sweep
from segmill.scratch import Scratch


def curved(n, seed=0):
    """Points near a curved surface of three dimensions in six."""
    z = np.random.default_rng(seed).normal(size=(n, 3)) * [3, 1, 1]
    return np.concatenate([z, np.sin(z) + 0.1 * np.random.default_rng(seed + 1).normal(size=(n, 3))], 1)


def frame(spark, x, labels=None):
    labels = [0] * len(x) if labels is None else labels
    return spark.createDataFrame([(*map(float, r), None if c is None else int(c)) for r, c in zip(x, labels)], ", ".join([f"f{i} double" for i in range(x.shape[1])] + ["cluster int"]))


def plain_silhouette(x, labels):
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    sizes = {c: (labels == c).sum() for c in set(labels)}
    out = []
    for i, c in enumerate(labels):
        mean = {o: d[i, labels == o].sum() / (n - (o == c)) for o, n in sizes.items() if n > (o == c)}
        a, b = mean.pop(c, None), min(v for o, v in mean.items() if o != c)
        out.append(0 if a is None else (b - a) / max(a, b))
    return float(np.mean(out))


@pytest.fixture(scope="module")
def scratch(spark):
    s = Scratch(spark, "test")
    yield s
    s.drop()


def test_moments_of_merged_sets():
    rng = np.random.default_rng(1)
    x, w = rng.normal(size=(40, 4)), rng.integers(1, 5, 40).astype(float)
    parts = np.array_split(np.arange(40), [5, 17, 30])
    rows = np.array([cells.Moments.of(x[p], w[p]).packed() for p in parts])
    merged, whole = cells.Moments.unpacked(rows, 4).merged(np.array([w[p].sum() for p in parts])), cells.Moments.of(x, w)
    assert np.allclose(merged.packed(), whole.packed())


def test_cells_hold_every_point_once(spark, scratch):
    x = np.concatenate([curved(1500), np.repeat(curved(1, 9), 300, 0)])
    points = cells.weighted(frame(spark, x), F.array(*[f"f{i}" for i in range(6)]), F.col("cluster"), scratch)
    assert points.count() == 1501 and points.agg(F.max("weight")).first()[0] == 300
    found = cells.make_cells(points, 6, scratch, size=64).collect()
    rows = np.concatenate([np.frombuffer(r["rows"], "<i8") for r in found])
    assert len(rows) == len(set(rows)) == 1501 and max(r["n"] for r in found) <= 64
    tree = cells.Tree(spark.createDataFrame(found, cells.CELLS), 6)
    q = x[:50]
    low, high = tree.mean_distances(q, np.array(tree.roots))
    exact = np.sqrt(((q[:, None] - x) ** 2).sum(2)).mean(1)
    assert (low[:, 0] <= exact + 1e-12).all() and (exact <= high[:, 0] + 1e-12).all()


@pytest.mark.parametrize("tolerance", [0.0, 0.02, 0.2])
def test_silhouettes_are_exact_or_inside_their_bounds(spark, tolerance):
    x = curved(700)
    labels = (x[:, 0] > 0).astype(int) + 2 * (x[:, 1] > 0.5)
    x, labels = np.concatenate([x, x[:90]]), np.concatenate([labels, labels[:90]])
    labels[5] = 9
    df = frame(spark, x, labels).unionByName(frame(spark, x[:3], [None] * 3))
    row = clustering.silhouette_bounds(df, [f"f{i}" for i in range(6)], tolerance=tolerance).first()
    want = plain_silhouette(x, labels)
    assert row["silhouette_low"] - 1e-9 <= want <= row["silhouette_high"] + 1e-9
    assert row["silhouette_high"] - row["silhouette_low"] <= tolerance + 1e-12
    if not tolerance:
        assert row["silhouette_low"] == pytest.approx(want, abs=1e-10)


def test_silhouettes_of_nothing_and_of_one_cluster(spark):
    for df in (frame(spark, curved(4)), frame(spark, curved(4)).limit(0), frame(spark, curved(3), [None] * 3)):
        row = clustering.silhouette_bounds(df, ["f0", "f1"]).first()
        assert row["silhouette_low"] is None and row["distances"] == 0
    assert clustering.cluster_metrics(frame(spark, curved(4)), ["f0"], tolerance=0.1).first()["silhouette"] is None


def test_distances_grow_more_slowly_than_the_square(spark):
    work = {}
    for n in (2_000, 8_000):
        x = curved(n)[:, :3]
        df = frame(spark, x, (x[:, 0] > 0).astype(int))
        row = clustering.cluster_metrics(df, ["f0", "f1", "f2"], tolerance=0.05).first()
        assert row["silhouette_high"] - row["silhouette_low"] <= 0.05
        work[n] = clustering.silhouette_bounds(df, ["f0", "f1", "f2"], tolerance=0.05).first()["distances"]
    assert work[8_000] < 0.15 * 8_000**2 and work[8_000] < 6 * work[2_000]


def test_the_sweep_with_a_tolerance(spark):
    x = np.concatenate([np.random.default_rng(i).normal(size=(60, 2)) + c for i, c in enumerate([(0, 0), (12, 12), (24, 0)])])
    sure, exact = (clustering.select_optimal_k(frame(spark, x), ["f0", "f1"], k_range=(2, 3), seeds=2, starts=2, tolerance=t) for t in (0.02, 0.0))
    assert sure.recommended_k == exact.recommended_k == 3
    for a, b in zip(sure.table.orderBy("k").collect(), exact.table.orderBy("k").collect()):
        assert a["avg_silhouette"] == pytest.approx(b["avg_silhouette"], abs=0.02) and a["avg_stability_ari"] == b["avg_stability_ari"]


def test_neighbours_are_exact_once_certified(spark, scratch):
    x = curved(900)
    points = cells.weighted(frame(spark, x), F.array(*[f"f{i}" for i in range(6)]), F.col("cluster"), scratch)
    table = cells.make_cells(points, 6, scratch, size=64)
    near = neighbours.descend(points, table, 6, 10, scratch)
    exact = neighbours.certify(near, table, 6, 10, scratch)
    named = {r["row"]: np.array(r["x"]) for r in points.collect()}
    names = np.array(sorted(named))
    all_x = np.array([named[n] for n in names])
    got = {}
    for r in exact.collect():
        got.setdefault(r["row"], []).append((r["far"], r["other"]))
    for i, n in enumerate(names):
        far = np.sqrt(((all_x[i] - all_x) ** 2).sum(1))
        want = sorted(zip(far[np.arange(len(names)) != i], names[np.arange(len(names)) != i]))[:10]
        assert [o for _, o in sorted(got[n])] == [o for _, o in want]
    assert near.join(exact, ["row", "other"]).count() >= 0.95 * exact.count()


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_few_points(spark, n):
    df = frame(spark, curved(6)).limit(n)
    shown = embedding.embedding_projection(df, [f"f{i}" for i in range(6)])
    assert shown.count() == n and shown.filter("dim_x IS NULL OR dim_y IS NULL").isEmpty()
    assert embedding.neighbour_distances(df, ["f0", "f1"], 3).count() == n * min(3, max(n - 1, 0))


def test_fuzzy_weights_add_up():
    far = np.sort(np.random.default_rng(3).random((50, 15)), 1)
    far[0, 10:] = np.inf
    far[1] = 0
    w = embedding.fuzzy(far)
    assert np.allclose(w[2:].sum(1), np.log2(15)) and w[0, 10:].max() == 0 and (w >= 0).all() and (w[:, 0] == 1).all()


def test_the_curve_is_fitted():
    a, b = embedding.falloff()
    assert a == pytest.approx(1.577, abs=0.01) and b == pytest.approx(0.895, abs=0.01)


def test_the_layout_keeps_neighbours_together(spark, monkeypatch):
    x = np.concatenate([curved(700), np.repeat(curved(1, 5), 20, 0)])
    names = [f"f{i}" for i in range(6)]
    df = frame(spark, x).withColumn("dim_x", F.lit("old"))
    shown = embedding.embedding_projection(df, names)
    assert shown.columns == [*names, "cluster", "dim_x", "dim_y"] and shown.count() == 720
    sure = embedding.trustworthiness(shown, names)
    # Against all distances at once.
    p = shown.toPandas()
    a, y, k = p[names].to_numpy(), p[["dim_x", "dim_y"]].to_numpy(), 15
    far, near = (np.sqrt(((v[:, None] - v) ** 2).sum(2)) for v in (a, y))
    np.fill_diagonal(near, np.inf)
    np.fill_diagonal(far, np.inf)
    rank = 1 + (far[:, None] < far[:, :, None] * (1 - 1e-12)).sum(2)
    lost = sum(max(rank[i, j] - k, 0) for i in range(720) for j in np.argsort(near[i], kind="stable")[:k])
    assert sure == pytest.approx(1 - 2 * lost / (720 * k * (2 * 720 - 3 * k - 1)), abs=0.003)
    assert sure >= 0.95
    assert shown.filter("f0 = 0").count() == 0 and len({(r["dim_x"], r["dim_y"]) for r in shown.collect()}) == 701
    # Small parts, so that rounds move points against points of other tasks.
    monkeypatch.setattr(embedding, "PART", 200)
    assert embedding.trustworthiness(embedding.embedding_projection(df, names), names) >= 0.93


def test_layouts_in_many_parts_unfold(spark, monkeypatch):
    """A cube of six dimensions, which its main directions fold onto themselves, in ten parts."""
    monkeypatch.setattr(embedding, "PART", 300)
    x = np.random.default_rng(1).random((3_000, 6))
    names = [f"f{i}" for i in range(6)]
    shown = embedding.embedding_projection(frame(spark, x), names)
    assert shown.filter("dim_x IS NOT NULL AND dim_y IS NOT NULL").count() == 3_000
    assert embedding.trustworthiness(shown, names) >= 0.89


def test_layouts_repeat(spark):
    df = frame(spark, curved(120))
    one, two = ({(r["f0"], r["dim_x"], r["dim_y"]) for r in embedding.embedding_projection(d, ["f0", "f1", "f2"]).collect()} for d in (df, df.repartition(3)))
    assert {r[0] for r in one} == {r[0] for r in two}


def test_copies_and_labels_do_not_travel_through_silhouettes(spark, scratch, monkeypatch):
    x = np.concatenate([np.repeat(curved(150), 4, 0), curved(50, 7)])
    points = scratch.keep(spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "row long, x array<double>").repartition(3), "repeated")
    centers = {k: np.random.default_rng(k).normal(size=(3, k, 6)) for k in (2, 5)}
    sizes, sent, plain = sweep.describe_grid(points, 6, centers)[0], [], sweep._chunks

    def chunks(*args):
        made = plain(*args)
        sent.extend(made.select("n", "begins", "kinds").collect())
        return made

    monkeypatch.setattr(sweep, "_chunks", chunks)
    found = sweep.grid_silhouettes(points, 6, centers, sizes)
    assert sum(r["n"] for r in sent) == 200 and not any(r["begins"] or r["kinds"] for r in sent)
    for k in centers:
        for f, c in enumerate(centers[k]):
            assert found[k][f] == pytest.approx(plain_silhouette(x, sweep.nearest(x, c[None])[0][:, 0]), abs=1e-9)


def test_no_silent_projection(spark):
    with pytest.raises(ValueError):
        clustering.run_clustering(frame(spark, curved(30)).withColumnRenamed("f0", "recency").withColumn("customer_id", F.monotonically_increasing_id().cast("string")).select("customer_id", "recency"), k_override=2, selection=object.__new__(clustering.Selection), projection="sideways")


def test_silhouette_module_agrees_with_blocks(spark):
    x = curved(300)
    labels = (x[:, 0] > 0).astype(int)
    df = frame(spark, x, labels)
    names = [f"f{i}" for i in range(6)]
    blocks = clustering.cluster_metrics(df, names).first()["silhouette"]
    low, high, _ = silhouette.mean_silhouette(df, F.array(*names), F.col("cluster"), 6, 0.0)
    assert low == pytest.approx(blocks, abs=1e-10) and high == pytest.approx(blocks, abs=1e-10)


def plain_fits(x, centers):
    """Lloyd's steps of one fit from given centers, every point against every center."""
    work = 0
    for _ in range(sweep.MOST_PASSES):
        own, far = sweep.nearest(x, centers[None])
        work += len(x) * len(centers)
        new = np.array([x[own[:, 0] == c].mean(0) if (own[:, 0] == c).any() else centers[c] for c in range(len(centers))])
        done = ((new - centers) ** 2).sum() <= sweep.TOLERANCE
        centers, cost = new, far.sum()
        if done:
            return centers, cost, work


def test_cells_give_the_same_sums_as_points():
    rng = np.random.default_rng(4)
    x, w, centers = rng.normal(size=(50, 3)) * 0.3, rng.integers(1, 4, 50).astype(float), rng.normal(size=(6, 5, 3))
    centers[2, 3] = centers[2, 1]
    m = cells.Moments.of(x, w)
    radius = float(np.sqrt(((x - m.mean) ** 2).sum(1).max()))
    got, work = sweep.cell_sums(cells.Cell(0, 0, np.arange(50), x, w), m.mean, float(m.spread), radius, centers)
    own, far = sweep.nearest(x, centers)
    for f in range(6):
        for c in range(5):
            mine = own[:, f] == c
            assert np.allclose(got[f * 5 + c], [*(w[mine] @ x[mine]), w[mine].sum(), (w * far[:, f])[mine].sum()])
    assert work < 50 * 30


def test_the_grid_equals_plain_fits_with_fewer_distances(spark):
    x = np.concatenate([curved(2500)[:, :3], np.repeat(curved(1, 3)[:, :3], 200, 0)])
    table = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "row long, x array<double>")
    ks, seeds, starts, work, plain_work = [2, 5, 9], [1, 2], 2, [], 0
    got = sweep.fit_grid(table, 3, ks, seeds, starts, work)
    sequences = np.array([s * 1_000 + t for s in seeds for t in range(starts)])
    first = sweep.first_centers(table, 3, sequences, max(ks))
    for k in ks:
        fits = [plain_fits(x, first[i, :k]) for i in range(4)]
        plain_work += sum(f[2] for f in fits)
        for s in range(2):
            best = min(fits[2 * s : 2 * s + 2], key=lambda f: f[1])
            assert np.allclose(np.sort(got[k][s], 0), np.sort(best[0], 0), atol=1e-6)
    assert sum(work) < plain_work / 2


def test_points_meet_blocks_packed(spark, scratch, monkeypatch):
    """Many blocks, chunks of uneven size and copies; what travels to a block is a row for a chunk, not for a point."""
    monkeypatch.setattr(sweep, "CHUNKED", 100)
    monkeypatch.setattr(sweep, "HELD", 8 * 150 * 11)
    x = np.concatenate([curved(1_100), np.repeat(curved(1, 9), 30, 0)])
    labels = np.stack([(x[:, 0] > 0).astype(int) + (x[:, 1] > 1), (x[:, 2] > 0.5).astype(int)], 1)
    points = scratch.keep(spark.createDataFrame([(i, list(map(float, r)), list(map(int, c))) for i, (r, c) in enumerate(zip(x, labels))], "row long, x array<double>, c array<int>").repartition(7), "uneven")
    own = lambda batch: np.array(batch.column(2).to_pylist(), int).reshape(-1, 2)
    chunks = sweep._chunks(points, 6, own, scratch)
    assert chunks.count() < len(x) // 20 and chunks.agg(F.sum("n")).first()[0] == len(x)
    dealt, blocks = sweep.blocks_of(chunks, 150)
    assert {r["block"] for r in dealt.collect()} == set(range(blocks))
    found = sweep.silhouette_sums(points, 6, [np.bincount(c).astype(float) for c in labels.T], own).groupBy("labeling").agg((F.sum("total") / F.sum("n")).alias("s"), F.sum("n").alias("n")).orderBy("labeling").collect()
    assert [r["n"] for r in found] == [len(x)] * 2
    assert [r["s"] for r in found] == pytest.approx([plain_silhouette(x, c) for c in labels.T], abs=1e-8)


@pytest.mark.parametrize("tolerance", [0.0, 0.05])
def test_cells_travel_in_bundles(spark, monkeypatch, tolerance):
    """A few bundles in several blocks stand for many cells, and each meets a block once."""
    monkeypatch.setattr(silhouette, "CHUNKED", 200)
    monkeypatch.setattr(silhouette, "HELD", 8 * 400 * 12)
    x = np.concatenate([curved(1_200), np.repeat(curved(1, 9), 30, 0)])
    labels = (x[:, 0] > 0).astype(int) + (x[:, 1] > 1)
    scratch = Scratch(spark, "bundles")
    points = cells.weighted(frame(spark, x, labels), F.array(*[f"f{i}" for i in range(6)]), F.col("cluster"), scratch)
    table = cells.make_cells(points, 6, scratch)
    tree = cells.Tree(table, 6)
    bundles, of = silhouette._bundles(table, tree, scratch)
    found = bundles.collect()
    assert len({r["block"] for r in found}) > 2 and len(found) == of.max() + 1 < table.count() / 2
    assert sorted(np.concatenate([np.frombuffer(r["places"], "<i4") for r in found])) == list(range(len(of)))
    row = silhouette.point_silhouettes(points, 6, tolerance, scratch).agg(F.sum(F.col("low") * F.col("weight")).alias("low"), F.sum(F.col("high") * F.col("weight")).alias("high"), F.sum("weight").alias("n")).first()
    scratch.drop()
    want = plain_silhouette(x, labels)
    assert row["n"] == len(x) and row["low"] / len(x) - 1e-8 <= want <= row["high"] / len(x) + 1e-8
    assert row["high"] - row["low"] <= len(x) * (tolerance + 1e-12)


def test_the_starts_of_the_final_fit_go_through_the_points_together(spark):
    df = frame(spark, np.concatenate([curved(200), curved(200, 3) + 20, curved(100, 5) - 20])).drop("cluster")
    names, jobs, cost = df.columns, {}, {}
    for starts in (1, 5):
        spark.sparkContext.setJobGroup(f"starts {starts}", "")
        model = clustering.fit_final(df, names, 3, starts=starts)
        jobs[starts] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"starts {starts}"))
    spark.sparkContext.setJobGroup("rest", "")
    assert jobs[5] < 2 * jobs[1] + 20
    found = model.transform(df).groupBy("cluster").count().collect()
    assert sorted(r["count"] for r in found) == [100, 200, 200]


def test_as_many_blocks_for_few_points_as_for_many(spark, scratch):
    """What travels is the points once for each block: it grows no faster than they do."""
    seen = []
    for n in (700, 2_800):
        table = scratch.keep(spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(curved(n))], "row long, x array<double>"), "some")
        chunks = sweep._chunks(table, 6, lambda batch: np.zeros((batch.num_rows, 1), int), scratch, -(-n // sweep._blocks(table, n, 100_000)))
        seen.append(sweep.blocks_of(chunks, 100_000)[1])
    assert seen[0] == seen[1] == 2 * spark.sparkContext.defaultParallelism


def test_numbers_travel_as_short_as_they_stay_the_same():
    for values, size, types in ((np.array([0.5, -0.0, np.inf]), 4, sweep.FLOATS), (np.array([0.1]), 8, sweep.FLOATS), (np.array([1e300]), 8, sweep.FLOATS), (np.array([np.nan]), 8, sweep.FLOATS), (np.array([0, 255]), 1, sweep.INTEGERS), (np.array([256]), 2, sweep.INTEGERS), (np.array([-1]), 4, sweep.INTEGERS), (np.array([1 << 40]), 8, sweep.INTEGERS)):
        raw = sweep.packed(values, types)
        assert len(raw) == 1 + size * len(values) and np.array_equal(sweep.unpacked(raw, types), values, equal_nan=True)


def test_only_points_that_a_cell_reaches_are_sorted_again(spark, scratch, monkeypatch):
    """A far cell changes nothing; begin and add are those that ``_search`` hands to ``meet``."""
    held, sorts, plain = {}, [], neighbours._best
    monkeypatch.setattr(neighbours, "meet", lambda rows, wanted, table, begin, add, end, schema: held.update(begin=begin, add=add))
    monkeypatch.setattr(neighbours, "_best", lambda far, names, k: sorts.append(len(far)) or plain(far, names, k))
    neighbours._search(None, None, None, 2)
    near, other = np.arange(12.0).reshape(6, 2), np.arange(12.0).reshape(6, 2) + 100
    state = held["begin"]({"cell": 1, "label": 0, "rows": np.arange(6).tobytes(), "xs": near.tobytes(), "weights": np.ones(6).tobytes()})
    held["add"](state, cells.Cell(1, 0, np.arange(6), near, np.ones(6)))
    first = [v.copy() for v in state[1:]]
    held["add"](state, cells.Cell(2, 0, np.arange(6, 12), other, np.ones(6)))
    assert sorts == [6] and all((a == b).all() for a, b in zip(first, state[1:]))
    held["add"](state, cells.Cell(3, 0, np.array([20]), near[:1] + 0.1, np.ones(1)))
    assert state[2][0, 0] == 20 and sorts[1] < 6


def plain_trust(x, y, k):
    """Over all rows at once; of rows equally near in the layout, those nearer among the columns first."""
    far, near = (np.sqrt(((v[:, None] - v) ** 2).sum(2)) for v in (x, y))
    np.fill_diagonal(far, np.inf)
    np.fill_diagonal(near, np.inf)
    rank = 1 + (far[:, None] < far[:, :, None] * (1 - 1e-12)).sum(2)
    n = len(x)
    lost = sum(max(rank[i, j] - k, 0) for i in range(n) for j in np.lexsort((far[i], near[i]))[:k])
    return 1 - 2 * lost / (n * k * (2 * n - 3 * k - 1))


def test_trustworthiness_is_of_all_rows(spark):
    """More rows than were once asked, copies of all numbers, and a layout that is right but for a few rows."""
    x = np.concatenate([curved(1_100), np.repeat(curved(1, 5), 30, 0), np.repeat(curved(20, 6), 4, 0)])
    y = x[:, :2] * 1.0
    bad = np.random.default_rng(2).permutation(1_100)[:60]
    y[bad] = y[bad[::-1]]
    names = [f"f{i}" for i in range(6)]
    df = spark.createDataFrame([(*map(float, r), *map(float, p)) for r, p in zip(x, y)], ", ".join(f"{c} double" for c in (*names, "dim_x", "dim_y")))
    assert embedding.trustworthiness(df, names) == pytest.approx(plain_trust(x, y, 15), abs=1e-12)
    assert embedding.trustworthiness(df.limit(20), names) == pytest.approx(plain_trust(x[:20], y[:20], 6), abs=1e-12)


@pytest.mark.parametrize("pairs", [1 << 22, 50])
def test_balls_hold_what_lies_in_them(spark, scratch, monkeypatch, pairs):
    monkeypatch.setattr(balls, "PAIRS", pairs)
    monkeypatch.setattr("segmill.operators.silhouette.CHUNKED", 150)
    x = np.concatenate([curved(700), np.repeat(curved(1, 5), 7, 0)])
    points = cells.weighted(frame(spark, x), F.array(*[f"f{i}" for i in range(6)]), F.lit(0), scratch)
    table = cells.make_cells(points, 6, scratch, size=32)
    found = points.toPandas()
    p, w, names = np.array(found["x"].tolist()), found["weight"].to_numpy(), found["row"].to_numpy()
    d = np.sqrt(((p[:, None] - p) ** 2).sum(2))
    other = d + np.diag(np.full(len(p), np.inf))
    reach = spark.createDataFrame([(int(n), float(v)) for n, v in zip(names, np.sort(other, 1)[:, 9] * 1.3)], "row long, reach double")
    got = balls.nearest(table, 6, 10, reach, scratch).toPandas().groupby("row")["other"].apply(set)
    assert all(got[n] == set(names[np.argsort(other[i])[:10]]) for i, n in enumerate(names))
    limits = np.sort(np.random.default_rng(1).random((len(p), 3)) * [0.5, 3, 20], 1)
    asked = spark.createDataFrame([(int(n), list(map(float, v))) for n, v in zip(names, limits)], "row long, limits array<double>")
    counts = balls.nearer(table, 6, asked, scratch).toPandas().set_index("row").loc[names, "counts"]
    assert np.allclose(np.array(counts.tolist()), ((d[:, :, None] < limits[:, None]) * w[None, :, None]).sum(1))


def test_the_layout_begins_from_exact_neighbours(spark, monkeypatch):
    x = np.random.default_rng(3).random((2_000, 6))
    names, seen, plain = [f"f{i}" for i in range(6)], [], embedding.fuzzy_edges
    monkeypatch.setattr(embedding, "fuzzy_edges", lambda edges, k: seen.append(np.sort(edges.toPandas()["far"])) or plain(edges, k))
    embedding.embedding_projection(frame(spark, x), names, rounds=1, epochs=1)
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2)) + np.diag(np.full(2_000, np.inf))
    assert np.allclose(seen[0], np.sort(np.sort(d, 1)[:, :15].ravel()), rtol=1e-12)


def test_exact_silhouettes_compare_copies_once(spark, monkeypatch):
    x = np.concatenate([np.repeat(curved(150), 4, 0), curved(350, 7)])
    labels = (x[:, 0] > 0).astype(int) + 3 * (x[:, 1] > 1)
    sent, plain = [], sweep._chunks
    monkeypatch.setattr(sweep, "_chunks", lambda *args: sent.append(plain(*args)) or sent[-1].cache())
    monkeypatch.setattr(sweep, "CHUNKED", 60)
    df = frame(spark, np.concatenate([x, x[:2]]), [*labels, None, None])
    found = clustering.silhouettes(df, [f"f{i}" for i in range(6)])
    assert sent[0].agg(F.sum("n")).first()[0] == 500
    assert found.count() == 952 and found.filter("silhouette IS NULL").count() == 2
    assert found.agg(F.avg("silhouette")).first()[0] == pytest.approx(plain_silhouette(x, labels), abs=1e-10)


def test_both_sums_of_a_pair_of_blocks():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(150, 3)), rng.normal(size=(2_200, 3))
    wx, wy = np.eye(4)[np.sort(rng.integers(0, 4, 150))] * 2, np.eye(3)[rng.integers(0, 3, 2_200)]
    d = np.sqrt(((x[:, None] - y) ** 2).sum(2))
    mine, theirs = sweep.both_sums(x, y, wx, wy, False)
    assert np.allclose(mine, d @ wy) and np.allclose(theirs, d.T @ wx)
    assert np.allclose(sweep.both_sums(y, y, wy, wy, True)[0], np.sqrt(((y[:, None] - y) ** 2).sum(2)) @ wy)


def test_exact_bounds_compute_each_distance_once(spark):
    x = np.concatenate([curved(400), np.repeat(curved(1, 9), 30, 0)])
    labels = 2 * (x[:, 0] > 0).astype(int) + 5
    row = clustering.silhouette_bounds(frame(spark, x, labels), [f"f{i}" for i in range(6)], tolerance=0.0).first()
    assert row["distances"] == 401 * 400 // 2
    assert row["silhouette_low"] == row["silhouette_high"] == pytest.approx(plain_silhouette(x, labels), abs=1e-10)


def test_a_chunk_is_summed_for_its_own_clusters_only():
    clusters = np.array([[0, 7, 900], [0, 8, 900], [1, 7, 900]])
    used, member = sweep._members(clusters)
    assert used.tolist() == [0, 1, 7, 8, 900]
    assert np.array_equal(member, [[1, 0, 1, 0, 1], [1, 0, 0, 1, 1], [0, 1, 1, 0, 1]])
