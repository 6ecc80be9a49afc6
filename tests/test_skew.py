"""Most rows with one taxid, under a taxonomy that the driver does not put in order."""

from strandset.operators import taxonomy as T


def test_rows_of_one_taxid_go_to_many_tasks(spark, monkeypatch):
    nodes = spark.createDataFrame([(1, 1, "no rank"), (2, 1, "x"), (3, 1, "x"), (4, 2, "x"), (5, 2, "x")], "taxid long, parent long, rank string")
    rows = spark.range(0, 4000, 1, 4).selectExpr("id % 1000 as code", "if(id % 1000 < 3 and id < 1000, 5L, if(id = 3, 3L, 4L)) as taxid").union(spark.createDataFrame([(5000, 0), (5001, 77)], "code long, taxid long"))
    want = {c: 2 if c < 3 else 1 if c == 3 else 4 for c in range(1000)} | {5000: None, 5001: None}
    for cells in (T.CELLS, 0):
        monkeypatch.setattr(T, "CELLS", cells)
        t = T.Taxonomy(nodes, small=0)
        numbered = t.bounded(rows)
        plan = numbered._jdf.queryExecution().executedPlan().toString()
        assert ("__deal" in plan) if cells == 0 else ("SortMergeJoin" not in plan)
        assert numbered.count() == 4002 and {r.code: r.taxid for r in t.lca(rows, ["code"]).collect()} == want
    assert not T.Taxonomy(nodes.limit(0), small=-1).paths.count()
