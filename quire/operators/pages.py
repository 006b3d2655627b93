"""Pages, inherited attributes, page content and content operations."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from quire.functions.filters import decode_streams, without_strings
from quire.kernels import content as kernel
from quire.kernels.rows import text_of
from quire.operators.leaves import inlined_deep
from quire.operators.objects import inlined, ref_number
from quire.plans.rounds import settled

#: What pages take from the nodes above them.
INHERITED = ("Resources", "MediaBox", "CropBox", "Rotate")
DEEPEST = 64
OPERATION = "op_seq int, operator string, operands array<string>, start int, end int, image string, image_data binary, problem string"
#: Rows that go on together, and the bytes that they may come to before.
BATCH, BATCH_BYTES = 512, 1 << 22


def page_nodes(objects: DataFrame, documents: DataFrame) -> DataFrame:
    """Nodes of the page trees, level by level: file_id, num, path (ordinals from the root), above (numbers from the root), leaf.

    /Kids and /Type may be references. A node is a leaf if its /Type says page or it has no array of kids. A kid that stands above itself is left out, so that
    circles end; so are nodes deeper than DEEPEST.
    """
    dicts = inlined(objects, "Kids", "Type").where("kind = 'dict'")
    nodes = settled(dicts.select("file_id", "num", "entries", numbers(F.col("entries")["Kids"]).alias("kids")))
    root = documents.join(nodes.withColumnRenamed("num", "root"), ["file_id", "root"]).select("file_id", ref_number(F.col("entries")["Pages"]).alias("num"))
    level = root.where("num is not null").select("file_id", "num", F.array().cast("array<int>").alias("path"), F.array().cast("array<long>").alias("above"))
    done = []
    for _ in range(DEEPEST):
        seen = level.join(nodes, ["file_id", "num"]).withColumn("leaf", (F.coalesce(F.col("entries")["Type"], F.lit("")) == "/Page") | ~F.coalesce(F.col("entries")["Kids"], F.lit("")).startswith("["))
        seen = settled(seen)
        done.append(seen.select("file_id", "num", "path", "above", "leaf", "entries"))
        kids = seen.where("not leaf").select("file_id", "path", F.concat("above", F.array("num")).alias("above"), F.posexplode("kids").alias("ord", "kid"))
        level = kids.select("file_id", F.col("kid").alias("num"), F.concat("path", F.array(F.col("ord").cast("int"))).alias("path"), "above").where("not array_contains(above, num)")
        if not level.limit(1).count():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def pages(objects: DataFrame, documents: DataFrame) -> DataFrame:
    """file_id, page_no (from 1), num, above, entries: leaves in the order of the tree; one named twice counts where it is first.

    Where the tree of a file has none, its objects of /Type /Page count, in the order of their numbers.
    """
    leaves = page_nodes(objects, documents).where("leaf and array_size(above) > 0").groupBy("file_id", "num").agg(F.min_by(F.struct("path", "above", "entries"), "path").alias("v")).select("file_id", "num", "v.*")
    loose = objects.where("entries['Type'] = '/Page'").join(leaves.select("file_id").distinct(), "file_id", "left_anti")
    loose = loose.select("file_id", "num", F.array(F.col("num").cast("int")).alias("path"), F.array().cast("array<long>").alias("above"), "entries")
    order = Window.partitionBy("file_id").orderBy("path")
    return leaves.select(*loose.columns).unionByName(loose).withColumn("page_no", F.row_number().over(order)).select("file_id", "page_no", "num", "above", "entries")


def attributes(found: DataFrame, objects: DataFrame) -> DataFrame:
    """file_id, page_no, key, value: of each attribute in INHERITED the page's own or that of the nearest node above."""
    lines = found.select("file_id", "page_no", F.posexplode(F.reverse(F.concat("above", F.array("num")))).alias("distance", "num"))
    keys = F.array(*map(F.lit, INHERITED))
    given = objects.select("file_id", "num", F.explode(F.map_filter("entries", lambda k, _: F.array_contains(keys, k))))
    return lines.join(given, ["file_id", "num"]).groupBy("file_id", "page_no", "key").agg(F.min_by("value", "distance").alias("value"))


def contents(found: DataFrame, objects: DataFrame) -> DataFrame:
    """file_id, page_no, content, recovered, image: a page's decoded streams with a line feed between those that are not empty.

    A page without content has an empty one. /Contents, /Filter and /DecodeParms may be references, /Contents one to an
    array too, and what stands in the latter two may be references at any depth. Bytes that only an image filter could read are not content.
    """
    own = inlined_deep(inlined(objects, "Contents", "Filter", "DecodeParms"), "Filter", "DecodeParms")
    held = found.drop("entries").join(own.select("file_id", "num", "entries"), ["file_id", "num"])
    wanted = held.select("file_id", "page_no", F.posexplode(numbers(F.col("entries")["Contents"])).alias("ord", "of"))
    streams = own.where("kind = 'stream'").select("file_id", F.col("num").alias("of"), "entries", "raw")
    streams = settled(streams.join(wanted.select("file_id", "of").distinct(), ["file_id", "of"], "left_semi"))
    read = wanted.join(decode_streams(streams).select("file_id", "of", F.col("decoded").alias("d")), ["file_id", "of"])
    part = F.when(F.expr("d.image is null and octet_length(coalesce(d.data, x'')) > 0"), F.struct("ord", F.col("d.data").alias("data")))
    parts = read.groupBy("file_id", "page_no").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.max(F.col("d.recovered")).alias("recovered"), F.max("d.image").alias("image"))
    joined = F.aggregate(F.slice("parts", 2, 1 << 30), F.get("parts", F.lit(0))["data"], lambda a, x: F.concat(a, F.lit(b"\n"), x["data"]))
    both = found.select("file_id", "page_no").join(parts, ["file_id", "page_no"], "left")
    return both.select("file_id", "page_no", F.coalesce(joined, F.lit(b"")).alias("content"), F.coalesce("recovered", F.lit(False)).alias("recovered"), "image")


def numbers(spelled: Column) -> Column:
    """The numbers of the references in a spelled value, in the order written; what strings say is none."""
    return F.transform(F.regexp_extract_all(without_strings(F.coalesce(spelled, F.lit(""))), F.lit(r"(\d+) \d+ R"), F.lit(1)), lambda n: n.cast("long"))


def operation_rows(data: bytes | None) -> Iterator[dict]:
    for seq, o in enumerate(kernel.each_operation(bytes(data or b""))):
        image = o["image"]
        yield {"op_seq": seq, "operator": o["operator"], "operands": [text_of(x) for x in o["operands"]], "start": o["start"], "end": o["end"], "image": text_of(kernel.expanded(image[0])) if image else None, "image_data": image[1] if image else None, "problem": o["problem"]}


def operations(content: DataFrame, problems: bool = False) -> DataFrame:
    """The columns of content but `content`, and op_seq, operator, operands (spelled), start, end, image (its dictionary with long keys), image_data.

    Rows go on as they are found, so that the operations of a page are never held as one value. With problems, of each content in which
    something was wrong a last row without an operator tells the first such thing, in the column problem.
    """
    keep = [f for f in content.schema if f.name != "content"]
    schema = StructType([*keep, *_parse_datatype_string(OPERATION)])

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        own = pa.schema(list(arrow)[len(keep) :])

        def with_kept(batch, taken: list[int], some: list[dict]):
            # what is kept is taken by place in Arrow, whatever its type
            made = pa.RecordBatch.from_pylist(some, own)
            kept = [batch.column(k).take(pa.array(taken, pa.int32())).cast(arrow.field(k).type) for k in range(len(keep))]
            return pa.RecordBatch.from_arrays([*kept, *made.columns], schema=arrow)

        for batch in batches:
            taken, some, size = [], [], 0
            for k, data in enumerate(batch.column(len(keep))):
                for row in operation_rows(data.as_py()):
                    taken.append(k), some.append(row)
                    size += sum(map(len, row["operands"])) + len(row["image_data"] or b"")
                    if len(some) == BATCH or size > BATCH_BYTES:
                        yield with_kept(batch, taken, some)
                        taken, some, size = [], [], 0
            if some:
                yield with_kept(batch, taken, some)

    made = content.select(*[f.name for f in keep], "content").mapInArrow(read, schema)
    return made if problems else made.where("operator is not null").drop("problem")


class ContentOperations:
    """The table function content_operations(content), as SQL calls it: a row for each operation, as operations() gives them, problems included."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        for row in operation_rows(content):
            yield tuple(row.values())


def register(spark: SparkSession) -> None:
    """Makes content_operations callable from SQL, after LATERAL for the content of each row."""
    spark.udtf.register("content_operations", F.udtf(ContentOperations, returnType=OPERATION))


def pushed_down(found: DataFrame, objects: DataFrame) -> DataFrame:
    """objects in which every page states the attributes that it would take from above, and no node of the tree has any. The
    spelled body follows; other objects stay as they are."""
    own = attributes(found, objects).groupBy("file_id", "page_no").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("given"))
    named = found.select("file_id", "page_no", "num").join(own, ["file_id", "page_no"], "left").select("file_id", "num", F.coalesce("given", F.create_map().cast("map<string,string>")).alias("given"))
    nodes = found.select("file_id", F.explode("above").alias("num")).distinct().withColumn("is_node", F.lit(True))
    both = objects.join(named, ["file_id", "num"], "left").join(nodes, ["file_id", "num"], "left")
    keys = F.array(*map(F.lit, INHERITED))
    plain = F.map_filter("entries", lambda k, _: ~F.array_contains(keys, k))
    entries = F.when(F.col("given").isNotNull(), F.map_concat(plain, "given")).when(F.col("is_node"), plain).otherwise(F.col("entries"))
    changed = F.col("given").isNotNull() | F.col("is_node")
    spelled = F.concat(F.lit("<<"), F.array_join(F.transform(F.array_sort(F.map_entries("entries")), lambda e: F.concat(F.lit("/"), e["key"], F.lit(" "), e["value"])), ""), F.lit(">>"))
    made = both.withColumn("entries", entries).withColumn("body", F.when(changed, F.encode(spelled, "ISO-8859-1")).otherwise(F.col("body")))
    return made.select(*objects.columns)
