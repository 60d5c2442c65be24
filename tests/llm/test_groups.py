from pathloom.llm import groups


def test_components(spark):
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("x1", "x2"), ("x3", "x2"), ("y", "y"), ("z1", "z2"), ("z2", "z1")]
    df = spark.createDataFrame(edges, "a string, b string")
    got = {r.node: r.label for r in groups.components(df).collect()}
    assert got == {**{f"n{i:03d}": "n000" for i in range(61)}, "x1": "x1", "x2": "x1", "x3": "x1", "z1": "z1", "z2": "z1"}
    assert groups.components(df.limit(0)).count() == 0


def test_groups(spark):
    base = [f"w{k}" for k in range(30)]
    text = lambda *drop: " ".join(w for k, w in enumerate(base) if k not in drop)
    rows = [("a", 5, text()), ("a", 3, text()), ("a", 9, text(1, 2)), ("a", 11, text(1, 2, 3, 4, 5, 6, 7, 8, 9, 10)), ("a", 20, "other words here"), ("b", 1, text()), ("a", 30, None)]
    df = spark.createDataFrame([(t, i, 0, x) for t, i, x in rows], "tab string, id bigint, side int, text string")
    got = {(r.tab, r.id): (r.group_id, r.links) for r in groups.near_duplicate_groups(df).collect()}
    assert got == {("a", 5): (3, 1), ("a", 3): (3, 1), ("a", 9): (3, 2), ("a", 11): (3, 1)}
