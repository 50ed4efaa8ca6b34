import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import ann, nearest
from tidemark.operators import search as S
from tidemark.plans import catalog

DATA = "/root/testdata/sf0.001"


def test_the_nearest_are_those_of_every_pair_ranked(spark, monkeypatch):
    monkeypatch.setattr(nearest, "PART", 40)
    monkeypatch.setattr(nearest, "TILE", 400)
    rng = np.random.default_rng(5)
    rows = [(i, 0, rng.standard_normal(8).tolist()) for i in range(150)] + [(200 + i, i, [1.0] * 8) for i in range(30)]
    rows += [(300, 0, None), (301, 0, [0.0] * 8), (302, 0, [1.0, None] + [0.0] * 6), (303, 0, [1.0] * 3)]
    own = spark.createDataFrame(rows, "file_id long, ordinal int, vec array<double>")
    asked = own.where("file_id % 5 = 0").select(F.col("file_id").alias("query_id"), F.col("vec").alias("query_vec"))
    for k in (7, 500):
        order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "file_id", "ordinal")
        true = S.cosine(own, asked).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        want, found = ({(r.query_id, r.rank): (r.file_id, r.ordinal, r.score) for r in x.collect()} for x in (true, nearest.cosines(own, asked, k)))
        assert {k: v[:2] for k, v in want.items()} == {k: v[:2] for k, v in found.items()}
        assert all((a[2] is None) == (found[k][2] is None) and a[2] == pytest.approx(found[k][2], abs=1e-8) for k, a in want.items() if a[2] is not None)
    assert nearest.cosines(own.where("false"), asked, 3).isEmpty() and nearest.cosines(own, asked.where("false"), 3).isEmpty()


@pytest.mark.parametrize("name", ["agg_mrr", "agg_recall", "sr_ann_recall"])
def test_pairs_of_vectors_arent_rows_of_a_join(spark, name):
    plan = catalog.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "zip_with" not in plan


def test_decoded_vectors_score_as_the_tables_of_their_codes(spark):
    rng = np.random.default_rng(3)
    rows, cells, books = rng.standard_normal((50, 5)), rng.standard_normal((4, 5)), rng.standard_normal((3, ann.CODES, ann.WIDTH))
    trained = ann.Trained(cells, books)
    cell = trained.cell(rows)
    code, asked = trained.code(rows, cell), rng.standard_normal(5)
    table = np.einsum("gcw,gw->gc", books, ann.grouped(asked[None])[0])
    want = (cells[cell] @ asked) + table[np.arange(3), code].sum(axis=1)
    assert np.allclose((cells[cell] + trained.decoded(code)[:, :5]) @ asked, want)
