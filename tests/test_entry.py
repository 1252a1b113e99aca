import __spark_entry__ as E


def test_every_oracle_has_a_query():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 40


def test_param_grid(spark):
    from dendra.plans import sweep
    g = sweep.param_grid(spark)
    assert g.count() == 576
    first = g.orderBy("grid_pos").first()
    assert (first["umap_dims"], first["umap_neighbors"], first["hdbscan_method"]) == (2, 3, "eom")
