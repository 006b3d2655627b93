"""That work stays bounded and is done once, however many objects or files there are."""

from pyspark.sql import functions as F
from quire import queries
from quire.kernels import rows
from quire.kernels.syntax import format_value, kind_of, parse, references, respelled
from quire.operators import objects

SMALL = b"1 0 obj <</Pages 2 0 R/Type/Catalog>> endobj 2 0 obj <</Kids[3 0 R]/Type/Pages>> endobj 3 0 obj <</Type/Page>> endobj trailer <</Root 1 0 R>>"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_members_go_on_as_they_are_found(spark):
    n = 5000
    head = b"".join(b"%d %d " % (k, 3 * k) for k in range(n))
    data = head + b"".join(b"%-3d" % (k % 100) for k in range(n))
    found = rows.packed_tuples(len(head), n, data)
    assert next(found) == (0, 0, "int", b"0", {}, [], None)
    streams = spark.createDataFrame([("f", 1, 9, "stream", {"Type": "/ObjStm", "First": str(len(head)), "N": str(n)}, data)], "file_id string, num long, offset long, kind string, entries map<string,string>, raw binary")
    made = objects.unpacked(streams)
    # no value of a row has all members of a stream
    assert "array<struct<num" not in plan_of(made).replace(" ", "") and "MapInArrow" in plan_of(made)
    assert made.select(F.count("*"), F.sum("num"), F.sum("index")).first()[:] == (n, n * (n - 1) // 2, n * (n - 1) // 2)


def test_files_are_read_once_when_repaired(spark):
    count = spark.sparkContext.accumulator(0)

    def content(k):
        count.add(1)
        return SMALL

    files = spark.range(0, 50, 1, 2).select(F.col("id").cast("string").alias("file_id"), F.udf(content, "binary")("id").alias("content"))
    objs, documents = objects.opened(files)
    assert objs.count() == 150 and documents.where("repaired and root = 1").count() == 50
    assert count.value == 50


def test_rows_of_many_small_files_go_on_together(spark):
    files = spark.createDataFrame([(str(k), SMALL if k % 3 else b"x") for k in range(5000)], "file_id string, content binary").coalesce(1)
    got = objects.scan(files).groupBy("file_id").agg(F.count("*").alias("n"))
    assert got.where("n = 3").count() == got.count() == 3333


def test_files_made_of_few_rows_are_spread(spark):
    one = spark.range(100).select(F.col("id").alias("o_orderkey")).coalesce(1)
    assert queries.spread(one, "o_orderkey").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1


def test_streams_are_encoded_once(spark):
    own = spark.createDataFrame([("f", 1, 1, b"one"), ("f", 2, 2, b"two")], "file_id string, doc_id long, k long, b binary")
    made = queries.page_objects(own)
    assert "PythonUDF" not in plan_of(made) and "EvalPython" not in plan_of(made)
    assert made.where("raw is not null").count() == 2


def test_respelled_as_the_long_way():
    texts = [
        b"<</B 1/A(x y)/C[1 2 0 R/N<</D 3 0 R/B 4 1 R>>]/B 7 0 R>>", b"<</A#42 1>>", b"[ 1 -2 0 +3 04 1.50 -.5 ]", b"(a\\)b)", b"<41 4>", b" 12  0\nR", b"12 0 Rx", b"null", b"true", b"/Name", b"<<>>", b"[]", b"%c\n 5 0 R",
        b"<</A%c\n 5 0 R>>", b"[" * 40 + b"]" * 40, b"<</Length 5/Type/X>>", b"-0", b"99999999999999999999", b"(\n\t)", b"<</K null/L true>>",
    ]
    for text in texts:
        value, end = parse(text + b" endobj")
        entries = {str(k): format_value(v).decode("latin-1") for k, v in value.items()} if isinstance(value, dict) else {}
        told = respelled(text + b" endobj", 0)
        assert told is None or told == (kind_of(value), format_value(value), entries, references(value), end)
    assert all(respelled(texts[k], 0) for k in (0, 2, 4, 5, 7, 8, 9, 10))
    assert [respelled(t, 0) for t in (b"<</A>>", b"<<1 2>>", b"]", b"(x", b"<</A 1", b"endobj", b"")] == [None] * 7
