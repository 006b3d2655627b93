"""Content operations as rows in batches, and as a table function of SQL."""

from quire.operators import pages


def test_batches_and_sql(spark, monkeypatch):
    monkeypatch.setattr(pages, "BATCH", 3)
    big = b" ".join(b"%d w" % k for k in range(10))
    rows = [(1, [("a", 1)], big), (2, None, b"q BI /W 4 /H 1 /BPC 8 /CS /G ID a EI\nEI Q"), (3, [], None), (4, [("x", None)], b"1 w ] 2 w BI /W ID"), (5, [], b"")]
    df = spark.createDataFrame(rows, "problem_id int, kept array<struct<k: string, v: int>>, content binary")
    found = pages.operations(df)
    assert found.columns == ["problem_id", "kept", "op_seq", "operator", "operands", "start", "end", "image", "image_data"]
    got = found.orderBy("problem_id", "op_seq").collect()
    assert [(r.op_seq, r.operator, r.operands) for r in got if r.problem_id == 1] == [(k, "w", [str(k)]) for k in range(10)]
    assert {r.problem_id: r.kept for r in got} == {1: [("a", 1)], 2: None, 4: [("x", None)]}
    assert [(r.operator, r.image_data and bytes(r.image_data)) for r in got if r.problem_id == 2] == [("q", None), ("BI", b"a EI"), ("Q", None)]
    assert [r.operator for r in got if r.problem_id == 4] == ["w", "w"]
    wrong = pages.operations(df, problems=True).where("problem is not null").collect()
    assert [(r.problem_id, r.operator) for r in wrong] == [(4, None)] and "unexpected" in wrong[0].problem
    pages.register(spark)
    told = spark.sql("SELECT problem_id, kept, o.* FROM {df}, LATERAL content_operations(content) o", df=df)
    same = told.where("operator is not null").drop("problem").orderBy("problem_id", "op_seq").collect()
    assert same == got and told.where("problem is not null").count() == 1
    assert pages.operations(df.limit(0)).count() == 0
