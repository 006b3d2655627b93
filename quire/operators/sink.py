"""Writing objects as files. Offsets are running sums, tables are formatted by Catalyst, files are put together by aggregates."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.plans.rounds import settled

HEADER = b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"
PER_STREAM = 200


def bytes_of(text: Column) -> Column:
    """Text of ASCII characters as bytes."""
    return F.encode(text, "ISO-8859-1")


def joined(chunk: str, *order: str) -> Column:
    """The aggregate that puts the binaries of a group in one, in an order."""
    return F.expr(f"listagg({chunk}) WITHIN GROUP (ORDER BY {', '.join(order)})")


#: Places of a file's header and tail among its objects' numbers.
FIRST, LAST = -1, 1 << 62


def assembled(chunks: DataFrame, tails: DataFrame) -> DataFrame:
    """file_id, content: the header, chunks (file_id, num, chunk) in the order of num, and the tail (file_id, chunk) of each file."""
    ends = tails.select("file_id", F.explode(F.array(F.struct(F.lit(FIRST).cast("long").alias("num"), F.lit(HEADER).alias("chunk")), F.struct(F.lit(LAST).alias("num"), "chunk"))).alias("e")).select("file_id", "e.*")
    return chunks.select("file_id", "num", "chunk").unionByName(ends).groupBy("file_id").agg(joined("chunk", "num").alias("content"))


def object_bytes(num: Column, body: Column, raw: Column) -> Column:
    """An indirect object; for a stream the body's dictionary has to tell the length of raw already."""
    start = bytes_of(F.concat(num.cast("string"), F.lit(" 0 obj\n")))
    data = F.when(raw.isNotNull(), F.concat(F.lit(b"\nstream\n"), raw, F.lit(b"\nendstream"))).otherwise(F.lit(b""))
    return F.concat(start, body, data, F.lit(b"\nendobj\n"))


def deflated(raw: Column) -> Column:
    return F.udf(lambda b: None if b is None else zlib.compress(bytes(b)), "binary", useArrow=True)(raw)


def stream_body(entries: Column, raw: Column) -> Column:
    """A stream's dictionary from the spelled entries between its brackets, with the length of raw."""
    return bytes_of(F.concat(F.lit("<<"), entries, F.lit("/Length "), F.octet_length(raw).cast("string"), F.lit(">>")))


def _placed(parts: DataFrame) -> DataFrame:
    order = Window.partitionBy("file_id").orderBy("num").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("offset", F.lit(len(HEADER)) + F.coalesce(F.sum(F.octet_length("chunk")).over(order), F.lit(0)))


def write_plain(objects: DataFrame, root: DataFrame) -> DataFrame:
    """file_id, content: objects (file_id, num, body, raw) as files with a classic table; root gives the catalogue's number of each.

    Numbers must be unique in a file, or the write fails; those left out are free in the table. root may give `more`, spelled entries for the trailer.
    """
    placed = settled(_placed(objects.select("file_id", "num", object_bytes(F.col("num"), F.col("body"), F.col("raw")).alias("chunk"))))
    files = placed.groupBy("file_id").agg(
        F.map_from_entries(F.collect_list(F.struct("num", "offset"))).alias("at"),
        F.max("num").alias("high"),
        F.max(F.col("offset") + F.octet_length("chunk")).alias("xref"),
    )
    entry = lambda n: F.when(F.col("at")[n].isNull(), F.lit("0000000000 00000 f \n")).otherwise(F.concat(F.lpad(F.col("at")[n].cast("string"), 10, "0"), F.lit(" 00000 n \n")))
    lines = F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), "high"), entry), "")
    size = (F.col("high") + 1).cast("string")
    tail = F.concat(F.lit("xref\n0 "), size, F.lit("\n0000000000 65535 f \n"), lines, F.lit("trailer\n<</Root "), F.col("root").cast("string"), F.lit(" 0 R"), F.coalesce("more", F.lit("")), F.lit("/Size "), size, F.lit(">>\nstartxref\n"), F.col("xref").cast("string"), F.lit("\n%%EOF\n"))
    if "more" not in root.columns:
        root = root.withColumn("more", F.lit(None).cast("string"))
    return assembled(placed, files.join(root, "file_id").select("file_id", bytes_of(tail).alias("chunk")))


def write_packed(objects: DataFrame, root: DataFrame, seal: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """As write_plain, with objects other than streams in object streams of PER_STREAM, and a cross-reference stream that lists only the numbers in use.

    seal is what becomes of the streams (file_id, num, body, raw), object streams included, before they get their places.
    """
    if "more" not in root.columns:
        root = root.withColumn("more", F.lit(None).cast("string"))
    order = Window.partitionBy("file_id").orderBy("num")
    loose = objects.where("raw is null").withColumn("rn", F.row_number().over(order) - 1).withColumns({"bucket": F.floor(F.col("rn") / PER_STREAM), "index": F.col("rn") % PER_STREAM})
    high = objects.groupBy("file_id").agg(F.max("num").alias("high"))
    inner = Window.partitionBy("file_id", "bucket").orderBy("num").rowsBetween(Window.unboundedPreceding, -1)
    loose = loose.withColumn("place", F.coalesce(F.sum(F.octet_length("body") + 1).over(inner), F.lit(0))).join(high, "file_id").withColumn("strm", F.col("high") + 1 + F.col("bucket"))
    # each of these is used more than once, in parts that Catalyst would make anew
    loose = settled(loose.select("file_id", "num", "body", "index", "place", "strm"))
    streams = loose.withColumn("line", F.concat("body", F.lit(b"\n"))).groupBy("file_id", "strm").agg(F.array_sort(F.collect_list(F.struct("num", "place"))).alias("m"), joined("line", "num").alias("bodies"))
    head = F.array_join(F.transform("m", lambda x: F.concat(x["num"].cast("string"), F.lit(" "), x["place"].cast("string"), F.lit(" "))), "")
    streams = streams.withColumn("head", bytes_of(head)).withColumn("raw", deflated(F.concat("head", "bodies")))
    entries = F.concat(F.lit("/Filter/FlateDecode/First "), F.octet_length("head").cast("string"), F.lit("/N "), F.size("m").cast("string"), F.lit("/Type/ObjStm"))
    streams = streams.select("file_id", F.col("strm").alias("num"), stream_body(entries, F.col("raw")).alias("body"), "raw")
    direct = objects.where("raw is not null").select("file_id", "num", "body", "raw").unionByName(streams)
    direct = seal(direct) if seal else direct
    placed = settled(_placed(direct.select("file_id", "num", object_bytes(F.col("num"), F.col("body"), F.col("raw")).alias("chunk"))))
    table = placed.select("file_id", "num", F.lit(1).alias("kind"), "offset", F.lit(0).alias("third")).unionByName(loose.select("file_id", "num", F.lit(2).alias("kind"), F.col("strm").alias("offset"), F.col("index").cast("int").alias("third")))
    digits = lambda x, n: F.lpad(F.hex(x.cast("long")), n, "0")
    table = table.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("num", F.concat(F.lit("0"), F.col("kind").cast("string"), digits(F.col("offset"), 8), digits(F.col("third"), 4)).alias("row")))).alias("at"), F.max("num").alias("top"))
    files = placed.groupBy("file_id").agg(F.max(F.col("offset") + F.octet_length("chunk")).alias("xref")).join(table, "file_id").join(root, "file_id")
    own = F.concat(F.lit("01"), digits(F.col("xref"), 8), F.lit("0000"))
    rows = F.concat(F.lit("0000000000FFFF"), F.array_join(F.transform("at", lambda x: x["row"]), ""), own)
    index = F.concat(F.lit("0 1 "), F.array_join(F.transform("at", lambda x: F.concat(x["num"].cast("string"), F.lit(" 1 "))), ""), (F.col("top") + 1).cast("string"), F.lit(" 1"))
    files = files.withColumn("raw", deflated(F.unhex(rows)))
    size = (F.col("top") + 2).cast("string")
    entries = F.concat(F.lit("/Filter/FlateDecode/Index["), index, F.lit("]/Root "), F.col("root").cast("string"), F.lit(" 0 R"), F.coalesce("more", F.lit("")), F.lit("/Size "), size, F.lit("/Type/XRef/W[1 4 2]"))
    last = object_bytes(F.col("top") + 1, stream_body(entries, F.col("raw")), F.col("raw"))
    tail = bytes_of(F.concat(F.lit("startxref\n"), F.col("xref").cast("string"), F.lit("\n%%EOF\n")))
    return assembled(placed, files.select("file_id", F.concat(last, tail).alias("chunk")))


def renumbered(objects: DataFrame, groups: DataFrame) -> DataFrame:
    """Objects of the files of a group (file_id, into) as those of one file, numbered anew without gaps by (file_id, num), with
    references following; to nothing, null.

    file_id becomes `into`, and of and old say where an object came from.
    """
    objects = objects.join(groups, "file_id")
    counts = objects.groupBy("into", "file_id").agg(F.count("*").alias("n"))
    before = counts.select("file_id", (F.sum("n").over(Window.partitionBy("into").orderBy("file_id")) - F.col("n")).alias("before"))
    own = objects.withColumn("rn", F.row_number().over(Window.partitionBy("file_id").orderBy("num"))).join(before, "file_id").withColumn("new", F.col("before") + F.col("rn"))
    names = own.select("file_id", "num", "new")
    refs = own.select("file_id", "num", F.explode("refs").alias("r")).select("file_id", "num", F.col("r.num").alias("to")).distinct()
    done = rewritten(own, refs, names)
    return done.select(F.col("into").alias("file_id"), F.col("file_id").alias("of"), F.col("num").alias("old"), F.col("new").alias("num"), "body", "raw")


def rewritten(objects: DataFrame, refs: DataFrame, names: DataFrame) -> DataFrame:
    """objects whose bodies refer to new numbers: refs (file_id, num, to) are their references, names has file_id, num, new; what has no
    new number becomes null."""
    told = refs.join(names.select("file_id", F.col("num").alias("to"), F.col("new").alias("to_new")), ["file_id", "to"], "left")
    told = told.groupBy("file_id", "num").agg(F.collect_list(F.struct("to", "to_new")).alias("told"))

    def rewrite(body: bytes | None, pairs: list | None) -> bytes | None:
        from quire.kernels.syntax import Ref, format_value, parse

        if body is None or not pairs:
            return body
        to = {p["to"]: p["to_new"] for p in pairs}

        def swap(v):
            if isinstance(v, Ref):
                return Ref(to[v.num], 0) if to.get(v.num) is not None else None
            if isinstance(v, list):
                return [swap(x) for x in v]
            if isinstance(v, dict):
                return {k: swap(x) for k, x in v.items()}
            return v

        return format_value(swap(parse(bytes(body))[0]))

    return objects.join(told, ["file_id", "num"], "left").withColumn("body", F.udf(rewrite, "binary", useArrow=True)("body", "told")).drop("told")
