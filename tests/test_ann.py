import numpy as np
import pytest

from tidemark.operators import ann
from tidemark.operators.ann import VectorIndex
from tidemark.plans import catalog


def rows(spark, vectors, first=0):
    return spark.createDataFrame([(first + i // 3, i % 3, v) for i, v in enumerate(vectors)], "file_id long, ordinal int, vec array<double>")


def exact(vectors, query, k, first=0):
    unit = lambda x: x / max(np.linalg.norm(x), 1e-300)
    scored = [(-round(float(unit(np.array(v)) @ unit(np.array(query))), 9), first + i // 3, i % 3) for i, v in enumerate(vectors)]
    return [x[1:] for x in sorted(scored)[:k]]


@pytest.fixture(autouse=True)
def quick(monkeypatch):
    monkeypatch.setattr(ann, "ROUNDS", 2)
    monkeypatch.setattr(ann, "CODES", 16)


@pytest.fixture(scope="module")
def made():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 31))
    own = [(centres[i % 12] + 0.4 * rng.normal(size=31)).tolist() for i in range(900)]
    return own + [own[0]] * 400 + [[0.0] * 31]  # many copies of one vector, and a zero


def test_finds_what_exact_search_finds(spark, tmp_path, made, monkeypatch):
    monkeypatch.setattr(ann, "PART", 150)
    monkeypatch.setattr(ann, "ASKED", 20)
    index = VectorIndex.build(spark, f"{tmp_path}/v", rows(spark, made))
    assert index.lists.read().count() == len(made) and index.probes < len(index.trained.cells)
    queries = spark.createDataFrame([(i, made[i]) for i in range(1, 900, 15)], "query_id long, query_vec array<double>")
    found = {}
    for r in sorted(index.search(queries, 10).collect(), key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append((r.file_id, r.ordinal))
    hits = sum(len(set(found[i]) & set(exact(made, made[i], 10))) for i in range(1, 900, 15))
    assert len(found) == 60 and hits >= 0.9 * 600
    every = index.search(queries.limit(3), 10, probes=len(index.trained.cells), refine=1000)
    for r in every.collect():
        assert exact(made, made[r.query_id], 10)[r["rank"] - 1] == (r.file_id, r.ordinal)


def test_changes_are_found_at_once(spark, tmp_path, made):
    folder = f"{tmp_path}/v"
    index = VectorIndex.build(spark, folder, rows(spark, made[:300]), probes=4)
    far = [100.0 * (i == 3) for i in range(31)]
    asked = spark.createDataFrame([(7, far)], "query_id long, query_vec array<double>")
    again = VectorIndex.open(spark, folder)
    again.update(rows(spark, [far], first=777))
    for own in (index, again):
        top = own.search(asked, 1).first()
        assert (top.file_id, top.ordinal, round(top.score, 6)) == (777, 0, 1.0)
    index.update(rows(spark, [made[5]], first=777))  # replaced
    assert index.search(asked, 1).first().score < 0.99 and index.lists.read().where("file_id = 777").count() == 1
    index.update(rows(spark, []), rows(spark, [far], first=777).select("file_id"))
    index.compact()
    assert index.lists.read().where("file_id = 777").count() == 0 and index.lists.read().count() == 300


def test_a_query_reads_its_cells_only(spark, tmp_path, made):
    index = VectorIndex.build(spark, f"{tmp_path}/v", rows(spark, made[:600]), probes=2)
    held = index.lists.read(ann.F.col("cell").isin([1, 2]))
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell", "[cell") or "cell#" in plan.partition("PartitionFilters: ")[2][:80]
    assert {r.cell for r in held.select("cell").distinct().collect()} <= {1, 2}


def test_nulls_and_nothing(spark, tmp_path, made):
    some = rows(spark, [*made[:30], None, []])
    index = VectorIndex.build(spark, f"{tmp_path}/v", some)
    assert index.lists.read().count() == 30
    asked = spark.createDataFrame([(1, None), (2, made[0])], "query_id long, query_vec array<double>")
    assert {r.query_id for r in index.search(asked, 40).collect()} == {2}
    assert index.search(asked.limit(0), 3).collect() == []
    with pytest.raises(ValueError):
        VectorIndex.build(spark, f"{tmp_path}/w", some.limit(0))


def test_recall_on_the_table(spark):
    r = catalog.queries()["sr_ann_recall"](spark, "/root/testdata/sf0.01").first()
    assert r.queries == 25 and r.wanted == 250 and r.reached


def test_sums_of_many_centroids_take_no_pass_for_each():
    """One mask for each centroid took 32 x 256 passes over a batch in a round."""
    rng = np.random.default_rng(3)
    points, numbers = rng.normal(size=(6000, 16, 2)), rng.integers(0, 256, (6000, 16))
    numbers[3000:] += 7  # later batches may have higher numbers
    batches = [ann.pa.RecordBatch.from_arrays([ann.pa.array([[float(i)] for i in range(at, at + size)])], names=["vec"]) for at, size in ((0, 3000), (3000, 0), (3000, 3000))]
    seen, calls, unique = iter([slice(0, 3000), slice(3000, 6000)]), [], np.unique

    def assign(rows):
        at = next(seen)
        return points[at], numbers[at]

    with pytest.MonkeyPatch.context() as m:
        m.setattr(ann.np, "unique", lambda *x, **y: (calls.append(1), unique(*x, **y))[1])
        (found,) = ann._sums(assign, iter(batches))
    assert not calls and found.num_rows == len(set(zip(*(x.ravel().tolist() for x in (np.broadcast_to(np.arange(16), numbers.shape), numbers)), strict=True)))
    for r in found.to_pylist():
        of = points[:, r["g"]][numbers[:, r["g"]] == r["k"]]
        assert r["n"] == len(of) and np.allclose(r["total"], of.sum(axis=0))


@pytest.mark.parametrize("share", [0.1, 0.9])
def test_scores_are_those_of_each_list(share):
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 6, 40)
    begins, n = np.cumsum(sizes) - sizes, sizes.sum()
    asking, vectors, asks = rng.normal(size=(7, 5)), rng.normal(size=(n, 5)), rng.random((7, 40)) < share
    lists = np.repeat(np.arange(40), sizes)
    columns = np.flatnonzero(asks.any(axis=0)[lists])
    found = ann.scores(asking, vectors, columns, asks, begins, sizes)
    assert np.allclose(found, np.where(asks[:, lists], asking @ vectors.T, -np.inf)[:, columns])
