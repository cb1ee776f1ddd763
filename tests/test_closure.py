from assayer.operators import coverage


def test_whole_closure_follows_back_edges_loops_and_cycles(spark, monkeypatch):
    edges = [(700, 591), (701, 700), (591, 701), (5, 701), (5, 5), (900, 5), (1, 2), (592, 3)]
    monkeypatch.setattr(coverage, "view", lambda spark, *_: spark.createDataFrame(edges, "src long, dst long"))
    got = sorted(r.node for r in coverage.import_closure_whole(spark, "").collect())
    assert got == [5, 590, 591, 592, 700, 701, 900]
