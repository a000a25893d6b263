import numpy as np
import pyarrow as pa
import pytest

from topicloom.operators import factor, tiles
from topicloom.plans import staging

PENALTY = factor.Penalty.of(0.1, 0.5)


@pytest.fixture(scope="module")
def dense():
    rng = np.random.default_rng(11)
    x = (rng.random((40, 4)) * (rng.random((40, 4)) < 0.5)) @ (rng.random((4, 25)) * (rng.random((4, 25)) < 0.6))
    x *= rng.random(x.shape) < 0.8
    x[:, 0] += 0.1
    return x


@pytest.fixture(scope="module")
def long(spark, dense):
    rows = [(int(d), f"w{t:02d}", float(dense[d, t])) for d, t in zip(*np.nonzero(dense))]
    return spark.createDataFrame(rows, "doc_id long, word string, value double")


def start(spark, dense, k):
    rng = np.random.default_rng(2)
    w, h = rng.random((dense.shape[0], k)), rng.random((k, dense.shape[1]))
    return w, h, (
        spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(w)], "doc_id long, f array<double>"),
        spark.createDataFrame([(f"w{i:02d}", h[:, i].tolist()) for i in range(h.shape[1])], "word string, f array<double>"),
    )


def sequential_sweep(x, w, h):
    """Plain coordinate descent, one number at a time."""
    for a, b, target in ((w, h, x), (h.T, w.T, x.T)):
        for row in range(len(a)):
            for t in range(a.shape[1]):
                g = b @ b.T + PENALTY.l2 * np.eye(len(b))
                slope = g[t] @ a[row] - (target[row] @ b[t] - PENALTY.l1)
                if g[t, t]:
                    a[row, t] = max(0.0, a[row, t] - slope / g[t, t])
    return w, h


def loss(x, w, h):
    return (
        0.5 * np.sum((x - w @ h) ** 2) + PENALTY.l1 * (w.sum() + h.sum())
        + 0.5 * PENALTY.l2 * (np.sum(w**2) + np.sum(h**2))
    )


def rows_of(df, key, names):
    found = {r[key]: r["f"] for r in df.collect()}
    return np.array([found[n] for n in names])


@pytest.mark.parametrize("limit", [None, 0], ids=["held", "tiled"])
def test_sweeps_equal_sequential_descent(spark, long, dense, limit):
    w, h, init = start(spark, dense, 3)
    model = factor.nmf_fit(long, 3, max_iter=2, tol=0.0, init=init, track_objective=True, limit=limit)
    losses = []
    for _ in range(2):
        w, h = sequential_sweep(dense, w, h)
        losses.append(loss(dense, w, h))
    names = [f"w{i:02d}" for i in range(dense.shape[1])]
    assert np.allclose(rows_of(model.w, "doc_id", range(len(w))), w, atol=1e-9)
    assert np.allclose(rows_of(model.h, "word", names), h.T, atol=1e-9)
    assert np.allclose(model.objective, losses, rtol=1e-9)


@pytest.mark.parametrize("limit", [None, 0], ids=["held", "tiled"])
def test_fit_from_nndsvd_lowers_the_loss(long, limit):
    model = factor.nmf_fit(long, 3, max_iter=4, tol=0.0, track_objective=True, limit=limit)
    assert model.sweeps == 4
    assert all(b <= a + 1e-9 for a, b in zip(model.objective, model.objective[1:]))
    for table in (model.w, model.h):
        assert min(min(r["f"]) for r in table.collect()) >= 0


def test_fit_stops_on_tolerance(long):
    assert factor.nmf_fit(long, 2, max_iter=50, tol=0.5).sweeps < 50


@pytest.mark.parametrize("limit", [None, 0], ids=["held", "tiled"])
def test_singular_triplets_and_start(long, dense, limit):
    cells = factor.place(long, 13, limit)
    s, u, v = factor.truncated_svd(cells, 3)
    want_u, want_s, want_v = np.linalg.svd(dense, full_matrices=False)
    assert np.allclose(s, want_s[:3], rtol=1e-6)
    names = [f"w{i:02d}" for i in range(dense.shape[1])]
    docs = [i for i in range(len(dense)) if dense[i].any()]
    got_u, got_v = rows_of(u, "doc_id", docs), rows_of(v, "word", names)
    for j in range(3):
        sign = np.sign(got_v[:, j] @ want_v[j])
        assert np.allclose(sign * got_v[:, j], want_v[j], atol=1e-4)
        assert np.allclose(sign * got_u[:, j], want_u[docs, j], atol=1e-4)
    cells.release()
    w, h = factor.nndsvd_init(long, 3, limit=limit)
    first = np.sqrt(want_s[0]) * np.abs(want_v[0])
    assert np.allclose(rows_of(h, "word", names)[:, 0], np.where(first < 1e-6, 0, first), atol=1e-4)
    assert rows_of(w, "doc_id", docs).min() >= 0


def test_documents_without_cells_shrink(spark, long, dense):
    w, h, (w0, h0) = start(spark, dense, 3)
    extra = spark.createDataFrame([(999, [0.2, 0.2, 0.2])], "doc_id long, f array<double>")
    model = factor.nmf_fit(long, 3, max_iter=1, init=(w0.union(extra), h0))
    (row,) = model.w.filter("doc_id = 999").collect()
    assert max(row["f"]) < 0.2


def test_transform_reaches_the_optimum_per_document(spark, long, dense):
    _, h, (_, h0) = start(spark, dense, 3)
    weights = factor.nmf_transform(long, h0, 3, tol=1e-12, max_iter=2000)
    found = {r["doc_id"]: np.array(r["f"]) for r in weights.collect()}
    g = h @ h.T + PENALTY.l2 * np.eye(3)
    for d, f in found.items():
        slope = g @ f - (dense[d] @ h.T - PENALTY.l1)
        assert np.all(np.abs(slope[f > 0]) < 1e-6) and np.all(slope[f == 0] > -1e-6)


def test_document_topics_cover_all_documents(spark, long, dense):
    docs = spark.range(45).withColumnRenamed("id", "doc_id")
    _, _, (_, h0) = start(spark, dense, 3)
    topics = factor.doc_topics(docs, factor.nmf_transform(long, h0, 3), 3)
    rows = {r["doc_id"]: r for r in topics.collect()}
    assert len(rows) == 45 and rows[44]["topics"] == [0.0, 0.0, 0.0] and rows[44]["dominant_topic"] == 0


def test_string_document_ids(spark, long):
    text_ids = long.withColumn("doc_id", long.doc_id.cast("string"))
    model = factor.nmf_fit(text_ids, 2, max_iter=1)
    assert model.w.schema["doc_id"].dataType.simpleString() == "string"


def test_accelerated_fit_is_optimal_for_both_factors(spark, long, dense):
    _, _, (_, h0) = start(spark, dense, 3)
    model = factor.nmf_solve(long, 3, init=h0, tol=1e-6, track_objective=True)
    docs = sorted(r["doc_id"] for r in model.w.collect())
    assert docs == [i for i in range(len(dense)) if dense[i].any()]
    names = [f"w{i:02d}" for i in range(dense.shape[1])]
    x, w, h = dense[docs], rows_of(model.w, "doc_id", docs), rows_of(model.h, "word", names)
    assert np.isclose(model.objective[-1], loss(x, w, h.T), rtol=1e-9)
    for a, b, target in ((w, h, x), (h, w, x.T)):
        slope = a @ (b.T @ b + PENALTY.l2 * np.eye(3)) - target @ b + PENALTY.l1
        assert np.all(a >= 0) and np.abs(slope[a > 0]).max() < 1e-3 and slope[a == 0].min() > -1e-3


def test_accelerated_steps_do_not_depend_on_the_size_limit(spark, long, dense):
    _, _, (_, h0) = start(spark, dense, 3)
    names = [f"w{i:02d}" for i in range(dense.shape[1])]
    held, spread = (factor.nmf_solve(long, 3, init=h0, max_iter=3, track_objective=True, limit=x) for x in (None, 0))
    assert np.allclose(held.objective, spread.objective, rtol=1e-9)
    assert np.allclose(rows_of(held.h, "word", names), rows_of(spread.h, "word", names), atol=1e-8)
    docs = [i for i in range(len(dense)) if dense[i].any()]
    assert np.allclose(rows_of(held.w, "doc_id", docs), rows_of(spread.w, "doc_id", docs), atol=1e-8)


def test_accelerated_fit_reaches_the_loss_of_plain_sweeps_in_fewer_steps(long):
    plain = factor.nmf_fit(long, 3, max_iter=60, tol=0.0, track_objective=True)
    quick = factor.nmf_solve(long, 3, max_iter=30, tol=0.0, track_objective=True)
    assert quick.objective[-1] <= plain.objective[-1]


def test_accelerated_step_needs_no_checkpoint_of_documents(spark, long, monkeypatch):
    cuts = []
    monkeypatch.setattr(factor, "cut", lambda df: cuts.append(df) or df.checkpoint())
    _, _, (_, h0) = start(spark, np.zeros((40, 25)), 3)
    factor.nmf_solve(long, 3, init=h0, max_iter=5, tol=0.0)
    assert len(cuts) == 1  # the weights at the end


def test_accelerated_fit_of_one_cell_and_of_text_ids(spark):
    one = spark.createDataFrame([("a", "w", 2.0)], "doc_id string, word string, value double")
    model = factor.nmf_solve(one, 1, max_iter=300)
    (w,), (h,) = model.w.collect(), model.h.collect()
    assert w["doc_id"] == "a" and 0 < w["f"][0] * h["f"][0] <= 2


@pytest.fixture
def small_tiles(monkeypatch):
    """Many blocks on both sides; the packing keeps its own tile size on the workers."""
    monkeypatch.setattr(tiles, "grid", lambda n_docs, n_words, n_cells, k: (5, 3))


@pytest.mark.parametrize("room", [staging.BROADCAST_BYTES, 0], ids=["places broadcast", "places joined"])
def test_tiles_multiply_and_sum_like_the_matrix(spark, long, dense, small_tiles, monkeypatch, room):
    monkeypatch.setattr(staging, "BROADCAST_BYTES", room)
    doubled = long.union(long.filter("word = 'w03'"))  # a repeated cell counts twice
    cells = factor.place(doubled, 3, 0)
    assert cells.n == {"doc_id": 5, "word": 3}
    x = dense.copy()
    x[:, 3] *= 2
    _, h, (_, h0) = start(spark, dense, 3)
    names, docs = [f"w{i:02d}" for i in range(25)], [i for i in range(40) if dense[i].any()]
    blocks = cells.blocked("word", h0, 3)
    assert np.allclose(rows_of(cells.frame("word", blocks, 3), "word", names), h.T)
    y, small = cells.times("doc_id", blocks, 3)
    want = (x @ h.T)[docs]
    assert np.allclose(rows_of(cells.frame("doc_id", y, 3), "doc_id", docs), want)
    assert np.allclose(small, want.T @ want)
    z, _ = cells.times("word", y, 3)
    assert np.allclose(rows_of(cells.frame("word", z, 3), "word", names), x[docs].T @ want)
    cells.release()


def test_tiles_do_not_move(spark, long, small_tiles):
    cells = factor.place(long, 3, 0)
    blocks = cells.blocked("word", spark.createDataFrame([("w01", [1.0, 2.0, 3.0])], "word string, f array<double>"), 3)
    for side in ("doc_id", "word"):
        plan = cells.partial(side, cells.sizes(tiles.SIDES[side]) if side == "word" else blocks, 3)
        text = plan._jdf.queryExecution().executedPlan().toString()
        before = text.split("InMemoryRelation")[0]
        assert "InMemoryTableScan" in before
        assert before.count("Exchange") == 1  # the copies of the factor's blocks
    cells.release()


def test_blocks_of_the_grid_are_bounded():
    d, w = tiles.grid(10**9, 10**7, 10**12, 20)
    assert 10**9 / d * 160 <= tiles.BLOCK_BYTES and 10**7 / w * 160 <= tiles.BLOCK_BYTES
    assert d * w >= 10**12 / tiles.TILE_CELLS * 0.9
    assert (d * 10**7 + w * 10**9) * 7 < 10**12  # rows a pass moves, against the cells
    assert tiles.grid(0, 0, 0, 3) == (1, 1)


def test_fit_over_many_tiles_equals_the_fit_over_one(spark, long, dense, monkeypatch):
    init = start(spark, dense, 3)[2]
    names = [f"w{i:02d}" for i in range(25)]
    found = []
    for shape in ((1, 1), (4, 6)):
        monkeypatch.setattr(tiles, "grid", lambda *sizes, shape=shape: shape)
        found.append(factor.nmf_fit(long, 3, max_iter=3, tol=0.0, init=init, limit=0, track_objective=True))
    assert np.allclose(found[0].objective, found[1].objective, rtol=1e-10)
    assert np.allclose(*(rows_of(m.h, "word", names) for m in found), atol=1e-9)


def test_cells_without_a_document_or_a_word_take_no_part(spark, long, dense):
    init = start(spark, dense, 3)[2]
    more = spark.createDataFrame([(None, "w01", 5.0), (1, None, 5.0)], long.schema)
    for limit in (None, 0):
        clean, given = (factor.nmf_fit(x, 3, max_iter=1, init=init, limit=limit) for x in (long, long.union(more)))
        assert sorted(map(str, clean.h.collect())) == sorted(map(str, given.h.collect()))


def test_documents_without_cells_in_tiles(spark, long, dense):
    _, _, (w0, h0) = start(spark, dense, 3)
    extra = spark.createDataFrame([(999, [0.2, 0.2, 0.2])], "doc_id long, f array<double>")
    held, tiled = (factor.nmf_fit(long, 3, max_iter=1, init=(w0.union(extra), h0), limit=x) for x in (None, 0))
    for model in (held, tiled):
        assert max(model.w.filter("doc_id = 999").first()["f"]) < 0.2
    assert np.allclose(*(rows_of(m.w, "doc_id", [999, 3]) for m in (held, tiled)))


def test_packing_cuts_a_large_tile(monkeypatch):
    monkeypatch.setattr(tiles, "TILE_CELLS", 10)
    rng = np.random.default_rng(1)
    rows, cols, values = np.sort(rng.integers(0, 9, 60)), rng.integers(0, 7, 60), rng.random(60)
    keys = pa.array(np.repeat([1, 2], [45, 15]))
    batch = pa.RecordBatch.from_arrays([keys, keys, *map(pa.array, (rows, cols, values))], list("dwrcv"))
    want = {k: np.zeros((9, 7)) for k in (1, 2)}
    for k, r, c, v in zip(keys.to_pylist(), rows, cols, values):
        want[k][r, c] += v
    got, n = {k: np.zeros((9, 7)) for k in (1, 2)}, 0
    for tile in tiles._pack(batch.slice(i, 4) for i in range(0, 60, 4)):
        docs, lengths, words, terms = (np.frombuffer(tile.column(c)[0].as_buffer(), "<i4") for c in range(2, 6))
        v = np.frombuffer(tile.column(6)[0].as_buffer(), "<f8")
        np.add.at(got[tile.column(0)[0].as_py()], (np.repeat(docs, lengths), words[terms]), v)
        n += 1
    assert n > 2 and all(np.allclose(got[k], want[k]) for k in want)
