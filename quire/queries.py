"""Registered queries of the PDF operators, each over whole tables, with SQL that gets the same rows from the tables themselves.

The tables hold no PDF, so that each query first makes files or encoded values of its rows, by Catalyst or by an encoder
that shares no code with the operator under test, and then reads them back with the operator.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import values
from quire.functions.filters import decode_filter, decode_streams, permissions, text_string
from quire.operators import extract, graph, linear, linear_check, linear_sink, lookup, objects, pages, security, signatures, sink
from quire.operators.sink import bytes_of, deflated, stream_body
from quire.plans.rounds import settled

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over as many partitions as a shuffle has, before files are made of rows that are small and few as they are read."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def encoded(f: Callable[[bytes], bytes], raw):
    return F.udf(lambda b: None if b is None else f(bytes(b)), "binary", useArrow=True)(raw)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("b"))


def digests(df: DataFrame, raw: Column, name: str, parms: Column | str = "<<>>") -> DataFrame:
    """What is left of raw after the filters, by its digest and size."""
    found = decode_filter(df, raw, name, parms).select("doc_id", F.col("decoded.data").alias("d"))
    return found.select("doc_id", F.md5("d").alias("md5"), F.octet_length("d").cast("long").alias("bytes"))


DIGESTS = "SELECT doc_id, md5(text) AS md5, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM documents"


@query(DIGESTS)
def f5_ascii_hex(spark, sf_dir):
    return digests(texts(spark, sf_dir), bytes_of(F.concat(F.hex("b"), F.lit(">"))), "ASCIIHexDecode")


@query(DIGESTS)
def f6_ascii85(spark, sf_dir):
    return digests(texts(spark, sf_dir), encoded(lambda b: base64.a85encode(b, adobe=True), F.col("b")), "ASCII85Decode")


def _zipped(b: bytes, style: int) -> bytes:
    if style == 1:
        c = zlib.compressobj(wbits=-15)
        return c.compress(b) + c.flush()
    return (b"\r\n" if style == 2 else b"") + zlib.compress(b)


@query(DIGESTS)
def f3_flate(spark, sf_dir):
    df = texts(spark, sf_dir)
    raw = F.udf(lambda b, s: None if b is None else _zipped(bytes(b), s), "binary", useArrow=True)("b", F.pmod("doc_id", F.lit(3)).cast("int"))
    return digests(df, raw, "FlateDecode")


def _png_rows(b: bytes, columns: int) -> bytes:
    """Rows of every type in turn, the last one filled with zeros."""
    rows = np.frombuffer(b.ljust(-(-len(b) // columns) * columns, b"\0"), np.uint8).reshape(-1, columns).astype(np.int16)
    up = np.vstack([np.zeros((1, columns), np.int16), rows[:-1]]) if len(rows) else rows
    left, corner = (np.hstack([np.zeros((len(x), 1), np.int16), x[:, :-1]]) for x in (rows, up))
    near = np.abs(np.stack([up - corner, left - corner, left + up - 2 * corner]))
    paeth = np.choose(np.argmin(near, axis=0), [left, up, corner])
    kind = np.arange(len(rows)) % 5
    guess = np.choose(kind[:, None], [np.zeros_like(rows), left, up, (left + up) // 2, paeth])
    return zlib.compress(np.hstack([kind[:, None], (rows - guess) & 255]).astype(np.uint8).tobytes())


@query("SELECT doc_id, md5(concat(text, repeat(chr(0), CAST((64 - octet_length(encode(text)) % 64) % 64 AS INTEGER)))) AS md5, CAST(octet_length(encode(text)) + (64 - octet_length(encode(text)) % 64) % 64 AS BIGINT) AS bytes FROM documents")
def f10_png_predictor(spark, sf_dir):
    return digests(texts(spark, sf_dir), encoded(lambda b: _png_rows(b, 64), F.col("b")), "FlateDecode", "<</Predictor 15/Columns 64>>")


@query(DIGESTS)
def f9_crypt(spark, sf_dir):
    """A Crypt filter that changes nothing, by name or by default, before a filter that does."""
    parms = F.when(F.pmod("doc_id", F.lit(2)) == 0, F.lit("[<</Name/Identity>> null]"))
    return digests(texts(spark, sf_dir), bytes_of(F.concat(F.hex("b"), F.lit(">"))), "Crypt AHx", parms)


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'DCTDecode' ELSE 'JPXDecode' END AS image, md5(text) AS md5 FROM documents")
def f12_image_stop(spark, sf_dir):
    """Chains that end in an image filter: its data comes out as it is, by the dictionary of each stream."""
    from quire.functions.filters import decode_streams

    last = F.when(F.pmod("doc_id", F.lit(2)) == 0, F.lit("/DCT")).otherwise(F.lit("/JPXDecode"))
    df = texts(spark, sf_dir).select("doc_id", F.create_map(F.lit("Filter"), F.concat(F.lit("[/AHx"), last, F.lit("]"))).alias("entries"), bytes_of(F.concat(F.hex("b"), F.lit(">"))).alias("raw"))
    return decode_streams(df).select("doc_id", "decoded.image", F.md5("decoded.data").alias("md5"))


@query("SELECT vec_id, CAST(list_sum(list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1000) AS BIGINT) & 65535)) AS BIGINT) AS total, CAST(len(embedding) AS BIGINT) AS n FROM embeddings")
def f11_tiff_predictor(spark, sf_dir):
    """Components in thousandths as samples of 16 bits, each less the one before."""
    df = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("long").bitwiseAND(F.lit(65535))).alias("q"))
    step = F.transform("q", lambda x, i: F.lpad(F.hex(F.pmod(x - F.when(i > 0, F.get("q", i - 1)).otherwise(0), F.lit(65536)).cast("long")), 4, "0"))
    raw = encoded(zlib.compress, F.unhex(F.array_join(step, "")))
    parms = F.concat(F.lit("<</Predictor 2/BitsPerComponent 16/Columns "), F.size("q").cast("string"), F.lit(">>"))
    back = decode_filter(df, raw, "FlateDecode", parms).select("vec_id", F.col("decoded.data").alias("d"))
    digits = F.transform(F.regexp_extract_all(F.hex("d"), F.lit("(....)"), F.lit(1)), lambda h: F.conv(h, 16, 10).cast("long"))
    return back.select("vec_id", F.aggregate(digits, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.floor(F.octet_length("d") / 2).cast("long").alias("n"))


def _lzw(data: bytes, early: int) -> bytes:
    book, width, acc, n, out = {bytes([i]): i for i in range(256)}, 9, 0, 0, bytearray()

    def put(code):
        nonlocal acc, n
        acc, n = (acc << width) | code, n + width
        while n >= 8:
            n -= 8
            out.append(acc >> n & 255)
        acc &= (1 << n) - 1

    put(256)
    word, size = b"", 258
    for byte in data:
        longer = word + bytes([byte])
        if longer in book:
            word = longer
            continue
        put(book[word])
        book[longer], size = size, size + 1
        word = longer[-1:]
        if size + early > 4095:
            put(256)
            book, size, width = {bytes([i]): i for i in range(256)}, 258, 9
        elif size + early > 1 << width:
            width += 1
    if word:
        put(book[word])
        size += 1
        if size + early > 1 << width and width < 12:
            width += 1
    put(257)
    if n:
        out.append(acc << (8 - n) & 255)
    return bytes(out)


@query(DIGESTS)
def f4_lzw(spark, sf_dir):
    early = F.pmod("doc_id", F.lit(2)).cast("int")
    raw = F.udf(lambda b, e: None if b is None else _lzw(bytes(b), e), "binary", useArrow=True)("b", early)
    return digests(texts(spark, sf_dir), raw, "LZWDecode", F.concat(F.lit("<</EarlyChange "), (early * 5).cast("string"), F.lit(">>")))


@query(DIGESTS)
def f7_run_length_chain(spark, sf_dir):
    """Literal runs of up to 128 bytes, in hexadecimal, by Catalyst alone."""
    digits = F.regexp_extract_all(F.hex("b"), F.lit("(..){1,128}"), F.lit(0))
    runs = F.transform(digits, lambda d: F.concat(F.lpad(F.hex((F.length(d) / 2 - 1).cast("long")), 2, "0"), d))
    return digests(texts(spark, sf_dir), bytes_of(F.concat(F.array_join(runs, ""), F.lit("80>"))), "AHx RL")


@query("SELECT doc_id, true AS recovered, CAST(octet_length(encode(text)) - octet_length(encode(text)) // 3 AS BIGINT) AS bytes, true AS is_prefix FROM documents WHERE octet_length(encode(text)) > 2")
def f2_lenient_decode(spark, sf_dir):
    """Hex in which a letter stands where the last third begins: what comes before is read, whole texts of any length."""
    df = texts(spark, sf_dir).where("octet_length(b) > 2")
    keep = F.octet_length("b") - F.floor(F.octet_length("b") / 3)
    raw = bytes_of(F.concat(F.substring(F.hex("b"), F.lit(1), (2 * keep).cast("int")), F.lit("x"), F.substring(F.hex("b"), (2 * keep + 1).cast("int"), F.octet_length("b") * 2)))
    found = decode_filter(df, raw, "ASCIIHexDecode").select("doc_id", "b", F.col("decoded").alias("d"))
    return found.select("doc_id", F.col("d.recovered").alias("recovered"), F.octet_length("d.data").cast("long").alias("bytes"), (F.col("d.data") == F.substring("b", F.lit(1), F.octet_length("d.data"))).alias("is_prefix"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_partkey AS BIGINT) AS i, CAST(l_quantity AS DOUBLE) AS f, l_returnflag AS n, l_linestatus || '(' AS t, l_returnflag = 'R' AS b, 'int real name string bool ref' AS kinds FROM lineitem")
def t2_casts(spark, sf_dir):
    """Values of every kind spelled as objects are, and read as what they are."""
    text = lambda c: F.col(c).cast("string")
    spelled = {"i": text("l_partkey"), "f": F.format_string("%.2f", "l_quantity"), "n": F.concat(F.lit("/"), "l_returnflag"), "t": F.concat(F.lit("("), "l_linestatus", F.lit("\\()")), "b": F.when(F.col("l_returnflag") == "R", "true").otherwise("false"), "r": F.concat(text("l_orderkey"), F.lit(" 0 R"))}
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[c.alias(k) for k, c in spelled.items()])
    read = {"i": values.to_int, "f": values.to_float, "n": values.to_name, "b": values.to_bool}
    kinds = F.concat_ws(" ", *[values.kind(F.col(k)) for k in "ifntbr"])
    return df.select("l_orderkey", "l_linenumber", *[f(F.col(k)).alias(k) for k, f in read.items()], F.decode(values.to_bytes(F.col("t")), "ISO-8859-1").alias("t"), kinds.alias("kinds"))


@query("SELECT doc_id, text FROM documents")
def t1_text_string(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "text")
    wide = F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "UTF-16BE"))
    narrow = F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))
    return df.select("doc_id", text_string(F.when(F.pmod("doc_id", F.lit(2)) == 0, wide).otherwise(narrow)).alias("text"))


@query("SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN l_orderkey & 4 <> 0 THEN 'print' END, CASE WHEN l_orderkey & 8 <> 0 THEN 'modify' END, CASE WHEN l_orderkey & 16 <> 0 THEN 'copy' END, CASE WHEN l_orderkey & 32 <> 0 THEN 'annotate' END, CASE WHEN l_orderkey & 256 <> 0 THEN 'fill' END, CASE WHEN l_orderkey & 512 <> 0 THEN 'extract' END, CASE WHEN l_orderkey & 1024 <> 0 THEN 'assemble' END, CASE WHEN l_orderkey & 2048 <> 0 THEN 'print well' END) AS rights FROM lineitem")
def e6_permissions(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return df.select("l_orderkey", "l_linenumber", F.concat_ws(",", permissions(F.col("l_orderkey"))).alias("rights"))


@query("""SELECT l_orderkey, l_linenumber, CASE
  WHEN l_orderkey % 3 = 0 THEN 'does not start at the start'
  WHEN l_partkey % 5 = 0 THEN 'first span empty or negative'
  WHEN l_suppkey <= l_partkey THEN 'second span before the end of the first'
  WHEN l_suppkey - l_partkey < 2 THEN 'no gap'
  WHEN l_suppkey > 150 OR l_linenumber * 10 > 150 - l_suppkey THEN 'past the end' ELSE 'ok' END AS verdict FROM lineitem""")
def g2_byte_range(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    start = F.when(F.col("l_orderkey") % 3 == 0, F.lit(1)).otherwise(0).cast("long")
    first = F.when(F.col("l_partkey") % 5 == 0, -F.col("l_partkey") % 2).otherwise(F.col("l_partkey"))
    r = F.array(start, first, F.col("l_suppkey"), (F.col("l_linenumber") * 10).cast("long"))
    return df.select("l_orderkey", "l_linenumber", signatures.range_verdict(r, F.lit(150).cast("long")).alias("verdict"))


# Files of one page a document, one file a source and block of documents.
BLOCK = 1000
SHOWN = f"SELECT source || '/' || (doc_id // {BLOCK}) AS file_id, CAST(row_number() OVER (PARTITION BY source, doc_id // {BLOCK} ORDER BY doc_id) AS INTEGER) AS page_no, md5(text) AS md5 FROM documents WHERE source IS NOT NULL AND text IS NOT NULL"


def as_string(b: Column, how: Column) -> Column:
    """Bytes spelled as a string: in hexadecimal, or with escapes where how is 0."""
    escaped = F.regexp_replace(F.decode(b, "ISO-8859-1"), r"([\\()])", r"\\$1")
    return F.when(how == 0, F.concat(F.lit("("), F.regexp_replace(escaped, "\r", r"\\r"), F.lit(")"))).otherwise(F.concat(F.lit("<"), F.hex(b), F.lit(">")))


def paged(spark, sf_dir) -> DataFrame:
    """file_id, k (page number), b (what the page shows): the whole text of every document."""
    docs = table(spark, sf_dir, "documents").where("source is not null and text is not null")
    own = docs.select(F.concat("source", F.lit("/"), F.floor(F.col("doc_id") / BLOCK).cast("string")).alias("file_id"), "doc_id", F.encode("text", "UTF-8").alias("b"))
    return own.withColumn("k", F.row_number().over(Window.partitionBy("file_id").orderBy("doc_id")).cast("long"))


def page_stream(own: DataFrame) -> Column:
    return deflated(F.concat(F.lit(b"BT /F1 12 Tf "), bytes_of(as_string(F.col("b"), F.pmod("doc_id", F.lit(2)))), F.lit(b" Tj ET")))


def refs_to(nums: Column) -> Column:
    return F.array_join(F.transform(nums, lambda n: F.concat(n.cast("string"), F.lit(" 0 R"))), " ")


def none() -> Column:
    return F.lit(None).cast("binary")


def tree_objects(counts: DataFrame, first: Callable[[Column], Column]) -> DataFrame:
    """Objects 1 (catalogue) and 2 (root of the tree) of files with n pages, of which page k is object first(k)."""
    kids = refs_to(F.transform(F.sequence(F.lit(1).cast("long"), "n"), first))
    tree = bytes_of(F.concat(F.lit("<</Count "), F.col("n").cast("string"), F.lit("/Kids["), kids, F.lit("]/MediaBox[0 0 612 792]/Type/Pages>>")))
    both = F.array(F.struct(F.lit(1).cast("long").alias("num"), F.lit(b"<</Pages 2 0 R/Type/Catalog>>").alias("body")), F.struct(F.lit(2).cast("long").alias("num"), tree.alias("body")))
    return counts.select("file_id", F.explode(both).alias("o")).select("file_id", "o.*", none().alias("raw"))


def page_objects(own: DataFrame) -> DataFrame:
    """Objects of files in which page k is object 2k + 1 and its content 2k + 2."""
    leaf = own.select("file_id", (2 * F.col("k") + 1).alias("num"), bytes_of(F.concat(F.lit("<</Contents "), (2 * F.col("k") + 2).cast("string"), F.lit(" 0 R/Parent 2 0 R/Type/Page>>"))).alias("body"), none().alias("raw"))
    content = settled(own.select("file_id", (2 * F.col("k") + 2).alias("num"), page_stream(own).alias("raw"))).select("file_id", "num", stream_body(F.lit("/Filter/FlateDecode"), F.col("raw")).alias("body"), "raw")
    return leaf.unionByName(content).unionByName(tree_objects(own.groupBy("file_id").agg(F.count("*").alias("n")), lambda k: 2 * k + 1))


def roots(objs: DataFrame) -> DataFrame:
    return objs.select("file_id").distinct().withColumn("root", F.lit(1))


def source_files(spark, sf_dir, packed: bool = False) -> DataFrame:
    own = paged(spark, sf_dir)
    return (sink.write_packed if packed else sink.write_plain)(page_objects(own), roots(own))


def shown_on(found: DataFrame, objs: DataFrame) -> DataFrame:
    """file_id, page_no, md5 of the string that each page shows."""
    ops = pages.operations(pages.contents(found, objs).select("file_id", "page_no", "content"))
    return ops.where("operator = 'Tj'").select("file_id", "page_no", F.md5(values.to_bytes(F.col("operands")[0])).alias("md5"))


def shown(files: DataFrame) -> DataFrame:
    objs, documents = objects.opened(files)
    return shown_on(pages.pages(objs, documents), objs)


@query("SELECT source, CAST(count(*) AS BIGINT) AS pages, CAST(count(DISTINCT text) AS BIGINT) AS texts FROM documents WHERE source IS NOT NULL AND text IS NOT NULL GROUP BY source")
def m0_pages_by_source(spark, sf_dir):
    """The flagship: files written, opened, their pages decoded and their strings counted."""
    found = shown(source_files(spark, sf_dir))
    return found.groupBy(F.regexp_replace("file_id", "/[^/]*$", "").alias("source")).agg(F.count("*").alias("pages"), F.countDistinct("md5").alias("texts"))


@query(SHOWN)
def c1_operations(spark, sf_dir):
    return shown(source_files(spark, sf_dir))


@query(SHOWN)
def c1_lateral_operations(spark, sf_dir):
    """The strings that pages show, by the table function of operations in SQL."""
    pages.register(spark)
    objs, documents = objects.opened(source_files(spark, sf_dir))
    found = pages.contents(pages.pages(objs, documents), objs)
    ops = spark.sql("SELECT file_id, page_no, o.operands[0] AS operand FROM {pages}, LATERAL content_operations(content) o WHERE o.operator = 'Tj'", pages=found.select("file_id", "page_no", "content"))
    return ops.select("file_id", "page_no", F.md5(values.to_bytes(F.col("operand"))).alias("md5"))


@query(SHOWN)
def s10_packed_files(spark, sf_dir):
    return shown(source_files(spark, sf_dir, packed=True))


def without_startxref(files: DataFrame) -> DataFrame:
    gone = F.encode(F.replace(F.decode("content", "ISO-8859-1"), F.lit("startxref"), F.lit("startxxxx")), "ISO-8859-1")
    return files.select("file_id", gone.alias("content"))


@query(SHOWN)
def s13_repaired_files(spark, sf_dir):
    """The files cut before their table: objects from a scan, the root from the last catalogue."""
    files = source_files(spark, sf_dir)
    cut = F.substring("content", F.lit(1), (F.locate("787265660A30", F.hex("content")) / 2).cast("int"))
    return shown(files.select("file_id", cut.alias("content")))


@query(SHOWN)
def s15_repaired_packed_files(spark, sf_dir):
    """Packed files whose table can't be found: pages and catalogue come out of the object streams that a scan finds."""
    return shown(without_startxref(source_files(spark, sf_dir, packed=True)))


@query(SHOWN)
def s17_lost_catalogue(spark, sf_dir):
    """Files without catalogue, tree or table: a new one is made up over the pages."""
    own = paged(spark, sf_dir)
    chunks = page_objects(own).where("num > 2").select("file_id", "num", sink.object_bytes(F.col("num"), F.col("body"), F.col("raw")).alias("chunk"))
    return shown(sink.assembled(chunks, own.select("file_id").distinct().withColumn("chunk", F.lit(b"%%EOF\n"))))


@query("""WITH f AS (SELECT source || '/' || (doc_id // 1000) AS file_id, count(*) AS n, arg_max(md5(text), doc_id) AS md5 FROM documents WHERE source IS NOT NULL AND text IS NOT NULL GROUP BY 1)
  SELECT file_id, CAST(2 * n + 1 AS BIGINT) AS num, 'dict' AS kind, CASE WHEN n % 2 = 0 THEN 'repair packed' ELSE 'packed' END AS source, md5(CAST(2 * n + 2 AS VARCHAR) || ' 0 R') AS md5 FROM f
  UNION ALL SELECT file_id, CAST(2 * n + 2 AS BIGINT), 'stream', CASE WHEN n % 2 = 0 THEN 'repair' ELSE 'direct' END, md5 FROM f
  UNION ALL SELECT file_id, CAST(1000000000 AS BIGINT), 'null', 'missing', NULL FROM f""")
def s11_point_lookup(spark, sf_dir):
    """Of each file its last page, packed, what that shows, and a number that it doesn't have; files of an even number of pages lost their table."""
    own = paged(spark, sf_dir)
    counts = own.groupBy("file_id").agg(F.count("*").alias("n"))
    files = settled(sink.write_packed(page_objects(own), roots(own)).join(counts, "file_id"))
    files = files.where("n % 2 = 1").select("file_id", "content").unionByName(without_startxref(files.where("n % 2 = 0")))
    n = F.col("n")
    wanted = counts.select("file_id", F.explode(F.array(2 * n + 1, 2 * n + 2, F.lit(1000000000).cast("long"))).alias("num"))
    found = settled(lookup.lookup(files, wanted))
    streams = decode_streams(found.where("kind = 'stream'")).select("file_id", F.col("num").alias("page_no"), F.col("decoded.data").alias("content"))
    says = pages.operations(streams).where("operator = 'Tj'").select("file_id", F.col("page_no").alias("num"), F.md5(values.to_bytes(F.col("operands")[0])).alias("text"))
    return found.join(says, ["file_id", "num"], "left").select("file_id", "num", "kind", "source", F.coalesce("text", F.md5(F.encode(F.col("entries")["Contents"], "UTF-8"))).alias("md5"))


@query("SELECT source || '/' || (doc_id // 1000) AS file_id, CAST(count(*) AS BIGINT) AS pages, CAST(count(*) + 1 AS BIGINT) AS streams, '1.7' AS version FROM documents WHERE source IS NOT NULL AND text IS NOT NULL GROUP BY 1")
def s16_typed_objects(spark, sf_dir):
    """Objects by their /Type and kind, and the version that the header states."""
    objs, documents = objects.opened(source_files(spark, sf_dir, packed=True))
    kinds = objs.groupBy("file_id").agg(F.count_if(F.col("entries")["Type"] == "/Page").alias("pages"), F.count_if((F.col("kind") == "stream") & ~F.coalesce(F.col("entries")["Type"] == "/XRef", F.lit(False))).alias("streams"))
    return kinds.join(documents.select("file_id", "version"), "file_id")


@query(SHOWN)
def s12_indirect_values(spark, sf_dir):
    """Files in which /Kids, /Contents, /Filter and /DecodeParms are references, to arrays, names and dictionaries, and one by way of another."""
    own = paged(spark, sf_dir).withColumn("at", 10 * F.col("k"))
    at = lambda d: (F.col("at") + d).cast("string")
    small = own.select("file_id", F.explode(F.array(
        F.struct(F.col("at").alias("num"), bytes_of(F.concat(F.lit("<</Contents "), at(1), F.lit(" 0 R/Parent 2 0 R/Type/Page>>"))).alias("body")),
        F.struct((F.col("at") + 1).alias("num"), bytes_of(F.concat(F.lit("["), at(2), F.lit(" 0 R]"))).alias("body")),
        F.struct((F.col("at") + 3).alias("num"), bytes_of(F.concat(at(4), F.lit(" 0 R"))).alias("body")),
        F.struct((F.col("at") + 4).alias("num"), F.lit(b"[/FlateDecode]").alias("body")),
        F.struct((F.col("at") + 5).alias("num"), F.lit(b"<</Predictor 1>>").alias("body")),
    )).alias("o")).select("file_id", "o.*", none().alias("raw"))
    content = own.select("file_id", (F.col("at") + 2).alias("num"), F.concat(F.lit("/DecodeParms "), at(5), F.lit(" 0 R/Filter "), at(3), F.lit(" 0 R")).alias("e"), page_stream(own).alias("raw"))
    content = settled(content).select("file_id", "num", stream_body(F.col("e"), F.col("raw")).alias("body"), "raw")
    counts = own.groupBy("file_id").agg(F.count("*").alias("n"))
    kids = refs_to(F.transform(F.sequence(F.lit(1).cast("long"), "n"), lambda k: 10 * k))
    top = counts.select("file_id", F.explode(F.array(
        F.struct(F.lit(1).cast("long").alias("num"), F.lit(b"<</Pages 2 0 R/Type/Catalog>>").alias("body")),
        F.struct(F.lit(2).cast("long").alias("num"), bytes_of(F.concat(F.lit("<</Count "), F.col("n").cast("string"), F.lit("/Kids 3 0 R/Type/Pages>>"))).alias("body")),
        F.struct(F.lit(3).cast("long").alias("num"), bytes_of(F.concat(F.lit("["), kids, F.lit("]"))).alias("body")),
    )).alias("o")).select("file_id", "o.*", none().alias("raw"))
    return shown(sink.write_packed(small.unionByName(content).unionByName(top), roots(own)))


@query(SHOWN)
def f1_nested_references(spark, sf_dir):
    """Streams of two filters, the first named by a reference inside the array of names, the other's parameters by one to a
    dictionary whose numbers are references, beside a nested dictionary and a string of brackets that mean nothing."""
    own = paged(spark, sf_dir).withColumn("at", 10 * F.col("k"))
    at = lambda d: (F.col("at") + d).cast("string")
    small = own.select("file_id", F.explode(F.array(
        F.struct(F.col("at").alias("num"), bytes_of(F.concat(F.lit("<</Contents "), at(1), F.lit(" 0 R/Parent 2 0 R/Type/Page>>"))).alias("body")),
        F.struct((F.col("at") + 2).alias("num"), bytes_of(F.concat(at(3), F.lit(" 0 R"))).alias("body")),
        F.struct((F.col("at") + 3).alias("num"), F.lit(b"/AHx").alias("body")),
        F.struct((F.col("at") + 4).alias("num"), bytes_of(F.concat(F.lit("<</Columns "), at(5), F.lit(" 0 R/Predictor "), at(6), F.lit(" 0 R/A<</Columns 3/B[1 "), at(5), F.lit(" 0 R]>>/T(\\)>> /Columns 9 5 0 R)>>"))).alias("body")),
        F.struct((F.col("at") + 5).alias("num"), F.lit(b"16").alias("body")),
        F.struct((F.col("at") + 6).alias("num"), F.lit(b"15").alias("body")),
    )).alias("o")).select("file_id", "o.*", none().alias("raw"))
    shows = F.concat(F.lit(b"BT /F1 12 Tf "), bytes_of(as_string(F.col("b"), F.pmod("doc_id", F.lit(2)))), F.lit(b" Tj ET "))
    spaced = encoded(lambda b: _png_rows(b.ljust(-(-len(b) // 16) * 16), 16), shows)
    content = own.select("file_id", (F.col("at") + 1).alias("num"), F.concat(F.lit("/Filter["), at(2), F.lit(" 0 R/Fl]/DecodeParms[null "), at(4), F.lit(" 0 R]")).alias("e"), bytes_of(F.hex(spaced)).alias("raw"))
    content = settled(content).select("file_id", "num", stream_body(F.col("e"), F.col("raw")).alias("body"), "raw")
    objs = small.unionByName(content).unionByName(tree_objects(own.groupBy("file_id").agg(F.count("*").alias("n")), lambda k: 10 * k))
    return shown(sink.write_packed(objs, roots(own)))


# Incremental updates: a file a block of users, a section a batch of events, newest first by /Prev.
USERS = 16

def updated_files(spark, sf_dir, batches: int = 4, hybrid: bool = False) -> DataFrame:
    """Object 10 + user_id modulo USERS of a file has the last value of the user's events; older ones stand in older sections. In a
    hybrid file a stream beside each table lists every third object, and wrongly one of those that the table lists."""
    ev = table(spark, sf_dir, "events").where("user_id is not null and event_id is not null")
    ev = ev.select(F.floor(F.col("user_id") / USERS).cast("string").alias("file_id"), (F.pmod("user_id", F.lit(USERS)) + 10).cast("long").alias("num"), "event_id", "value")
    bounds = ev.agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))
    ev = ev.crossJoin(F.broadcast(bounds)).withColumn("batch", F.least(F.floor((F.col("event_id") - F.col("lo")) * batches / (F.col("hi") - F.col("lo") + 1)), F.lit(batches - 1)).cast("int")).drop("lo", "hi")
    last = ev.groupBy("file_id", "batch", "num").agg(F.max_by("value", "event_id").alias("value"))
    body = bytes_of(F.concat(F.lit("["), F.format_string("%.6f", F.col("value")), F.lit("]")))
    first = last.select("file_id").distinct().select("file_id", F.lit(-1).alias("batch"), F.explode(F.array(F.struct(F.lit(1).cast("long").alias("num"), F.lit(b"<</Pages 2 0 R/Type/Catalog>>").alias("body")), F.struct(F.lit(2).cast("long").alias("num"), F.lit(b"<</Count 0/Kids[]/Type/Pages>>").alias("body")))).alias("o")).select("file_id", "batch", "o.*")
    objs = last.select("file_id", "batch", "num", body.alias("body")).unionByName(first)
    parts = objs.withColumn("chunk", sink.object_bytes(F.col("num"), F.col("body"), F.lit(None).cast("binary")))

    def assemble(sections: list) -> bytes:
        """Sections in order, each with its objects and its own table; offsets only are computed here."""
        out, prev = bytearray(sink.HEADER), None
        for s in sorted(sections, key=lambda s: s["batch"]):
            lines, beside = [], []
            for k, p in enumerate(sorted(s["parts"], key=lambda p: p["num"])):
                if hybrid and k % 3 == 2:
                    beside.append((p["num"], len(out)))
                else:
                    lines.append(b"%d 1\n%010d 00000 n \n" % (p["num"], len(out)))
                    beside += [(p["num"], 1)] * (hybrid and k == 0)
                out += bytes(p["chunk"])
            more = b""
            if beside:
                more = b"/XRefStm %d" % (len(out) if len(beside) > 1 else 3)
                index, data = b" ".join(b"%d 1" % n for n, _ in beside), b"".join(b"\1" + o.to_bytes(4, "big") + b"\0" for _, o in beside)
                out += b"9 0 obj\n<</Type/XRef/W[1 4 1]/Size 99999/Prev 1/Index[%b]/Length %d>>\nstream\n%b\nendstream\nendobj\n" % (index, len(data), data)
            at = len(out)
            out += b"xref\n" + b"".join(lines) + b"trailer\n<</Root 1 0 R/Size 99999" + more + (b"/Prev %d" % prev if prev is not None else b"") + b">>\nstartxref\n%d\n%%%%EOF\n" % at
            prev = at
        return bytes(out)

    grouped = parts.groupBy("file_id", "batch").agg(F.collect_list(F.struct("num", "chunk")).alias("parts")).groupBy("file_id").agg(F.collect_list(F.struct("batch", "parts")).alias("s"))
    return grouped.select("file_id", F.udf(assemble, "binary", useArrow=True)("s").alias("content"))


def _values(files: DataFrame) -> DataFrame:
    objs, _ = objects.opened(files)
    return objs.where("kind = 'array'").select((F.col("file_id").cast("long") * USERS + F.col("num") - 10).alias("user_id"), F.regexp_extract(F.decode("body", "ISO-8859-1"), r"\[(.*)\]", 1).cast("double").alias("value"))


NEWEST = "SELECT user_id, CAST(printf('%.6f', arg_max(value, event_id)) AS DOUBLE) AS value FROM events GROUP BY user_id"


@query(NEWEST)
def s9_newest_section(spark, sf_dir):
    return _values(updated_files(spark, sf_dir))


@query(NEWEST)
def s9_hybrid_sections(spark, sf_dir):
    """The same files as hybrid ones: every third object of a section stands in the stream beside its table, which also names one of
    the table's own objects at a wrong place, and whose /Prev leads nowhere; where there is nothing for it, the stream's place is wrong."""
    return _values(updated_files(spark, sf_dir, hybrid=True))


@query(NEWEST)
def s13_last_object(spark, sf_dir):
    """The same files without any startxref: of each number the last object counts."""
    return _values(without_startxref(updated_files(spark, sf_dir)))


def _boxed(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Objects, documents and pages of files of a block of orders each: a node of the tree a priority, with a box that its orders'
    pages take from it; every tenth order has one of its own."""
    orders = table(spark, sf_dir, "orders").where("o_orderkey is not null and o_orderpriority is not null").select(F.floor(F.col("o_orderkey") / BLOCK).cast("string").alias("file_id"), "o_orderkey", F.substring("o_orderpriority", 1, 1).cast("long").alias("p"))
    own = F.when(F.col("o_orderkey") % 10 == 0, F.lit("/MediaBox[0 0 99 1]")).otherwise("")
    leaf = orders.select("file_id", (F.col("o_orderkey") + 100).alias("num"), bytes_of(F.concat(F.lit("<</Type/Page/Parent "), (F.col("p") + 10).cast("string"), F.lit(" 0 R"), own, F.lit(">>"))).alias("body"))
    nodes = orders.groupBy("file_id", "p").agg(F.array_sort(F.collect_list(F.col("o_orderkey") + 100)).alias("k"))
    node = nodes.select("file_id", (F.col("p") + 10).alias("num"), bytes_of(F.concat(F.lit("<</Count "), F.size("k").cast("string"), F.lit("/Kids["), refs_to(F.col("k")), F.lit("]/MediaBox[0 0 "), F.col("p").cast("string"), F.lit(" 1]/Parent 2 0 R/Type/Pages>>"))).alias("body"))
    tops = nodes.groupBy("file_id").agg(F.array_sort(F.collect_list(F.col("p") + 10)).alias("k"), F.sum(F.size("k")).alias("n"))
    top = tops.select("file_id", F.lit(2).cast("long").alias("num"), bytes_of(F.concat(F.lit("<</Count "), F.col("n").cast("string"), F.lit("/Kids["), refs_to(F.col("k")), F.lit("]/Type/Pages>>"))).alias("body"))
    root = tops.select("file_id", F.lit(1).cast("long").alias("num"), F.lit(b"<</Pages 2 0 R/Type/Catalog>>").alias("body"))
    made = leaf.unionByName(node).unionByName(top).unionByName(root).withColumn("raw", none())
    objs, documents = objects.opened(sink.write_packed(made, roots(made)))
    return objs, documents, pages.pages(objs, documents)


BOXES = "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 99 ELSE CAST(substr(o_orderpriority, 1, 1) AS BIGINT) END AS width FROM orders WHERE o_orderkey IS NOT NULL AND o_orderpriority IS NOT NULL"


def width_of(box: Column) -> Column:
    return F.regexp_extract(box, r"\[0 0 (\d+) 1\]", 1).cast("long").alias("width")


@query(BOXES)
def s20_inherited_box(spark, sf_dir):
    objs, _, found = _boxed(spark, sf_dir)
    box = pages.attributes(found, objs).where("key = 'MediaBox'")
    return found.join(box, ["file_id", "page_no"]).select((F.col("num") - 100).alias("o_orderkey"), width_of(F.col("value")))


@query(BOXES)
def h9_pushed_down(spark, sf_dir):
    """The same boxes, stated by the pages alone after the rewrite."""
    objs, _, found = _boxed(spark, sf_dir)
    new = pages.pushed_down(found, objs)
    left = new.where("entries['Type'] = '/Pages' and entries['MediaBox'] is not null").select("file_id")
    made = new.where("entries['Type'] = '/Page'").join(left, "file_id", "left_anti")
    return made.select((F.col("num") - 100).alias("o_orderkey"), width_of(F.regexp_extract(F.decode("body", "ISO-8859-1"), r"/MediaBox *(\[[^\]]*\])", 1)))


@query("SELECT doc_id // 1000 AS block, CAST(count(*) AS BIGINT) AS pages, CAST(count(DISTINCT text) AS BIGINT) AS texts, CAST(count(DISTINCT source) AS BIGINT) AS sources FROM documents WHERE source IS NOT NULL AND text IS NOT NULL GROUP BY 1")
def w6_merged_files(spark, sf_dir):
    """The files of all sources of a block copied into one, with a new catalogue over their page trees; then opened and read again."""
    objs, documents = objects.opened(source_files(spark, sf_dir))
    groups = documents.select("file_id", F.regexp_extract("file_id", r"(\d+)$", 1).alias("into"))
    one = settled(sink.renumbered(objs.join(documents.select("file_id", F.col("root").alias("num")), ["file_id", "num"], "left_anti"), groups))
    trees = documents.join(objs.withColumnRenamed("num", "root"), ["file_id", "root"]).select(F.col("file_id").alias("of"), objects.ref_number(F.col("entries")["Pages"]).alias("old"))
    kids = one.join(trees, ["of", "old"]).groupBy("file_id").agg(F.array_sort(F.collect_list("num")).alias("k"), F.count("*").alias("n"))
    both = kids.join(one.groupBy("file_id").agg(F.max("num").alias("high")), "file_id")
    tree = both.select("file_id", (F.col("high") + 1).alias("num"), bytes_of(F.concat(F.lit("<</Count "), F.col("n").cast("string"), F.lit("/Kids["), refs_to(F.col("k")), F.lit("]/Type/Pages>>"))).alias("body"))
    root = both.select("file_id", (F.col("high") + 2).alias("num"), bytes_of(F.concat(F.lit("<</Pages "), (F.col("high") + 1).cast("string"), F.lit(" 0 R/Type/Catalog>>"))).alias("body"))
    made = one.select("file_id", "num", "body", "raw").unionByName(tree.unionByName(root).withColumn("raw", none()))
    found = shown(sink.write_packed(made, root.select("file_id", F.col("num").alias("root"))))
    counts = found.groupBy("file_id").agg(F.count("*").alias("pages"), F.countDistinct("md5").alias("texts"))
    return counts.join(kids.select("file_id", F.col("n").alias("sources")), "file_id").select(F.col("file_id").cast("long").alias("block"), "pages", "texts", "sources")


def linked_files(spark, sf_dir) -> DataFrame:
    """As source_files, packed, with a font that pages take from above, links to the next page, and what only the catalogue leads to."""
    own = paged(spark, sf_dir)
    counts = own.groupBy("file_id").agg(F.count("*").alias("n"))
    more = own.join(counts, "file_id").where("k < n").select("file_id", (2 * F.col("k") + 1).alias("num"), bytes_of(F.concat(F.lit("/Annots[<</A<</D["), (2 * F.col("k") + 3).cast("string"), F.lit(" 0 R/Fit]/S/GoTo>>/Subtype/Link>>]"))).alias("link"))
    plain = page_objects(own).join(more, ["file_id", "num"], "left")
    said = F.when(F.col("num") == 1, F.lit(b"/Names 2000000002 0 R")).when(F.col("num") == 2, F.lit(b"/Resources 2000000000 0 R")).otherwise(F.coalesce("link", F.lit(b"")))
    plain = plain.select("file_id", "num", F.concat(F.lit(b"<<"), said, F.expr("substring(body, 3)")).alias("body"), "raw")
    shared = F.array(*[F.struct(F.lit(n).cast("long").alias("num"), F.lit(b).alias("body")) for n, b in ((2_000_000_000, b"<</Font<</F1 2000000001 0 R>>>>"), (2_000_000_001, b"<</Type/Font>>"), (2_000_000_002, b"(not for pages)"))])
    made = plain.unionByName(counts.select("file_id", F.explode(shared).alias("o")).select("file_id", "o.*", none().alias("raw")))
    return sink.write_packed(made, roots(own))


@query("""WITH d AS (SELECT *, source || '/' || (doc_id // 1000) AS f, (doc_id // 1000) || '/' || (doc_id % 3) AS file_id FROM documents WHERE source IS NOT NULL AND text IS NOT NULL),
  k AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY doc_id) AS k, lead(file_id) OVER (PARTITION BY f ORDER BY doc_id) AS next FROM d),
  c AS (SELECT file_id, count(*) AS n, count(DISTINCT f) AS sources FROM d GROUP BY 1)
  SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY k.k DESC, f) AS INTEGER) AS page_no, md5(text) AS md5, coalesce(next = file_id, false) AS linked, CAST(1 + ceil(n / 256) + CASE WHEN n > 256 THEN 1 ELSE 0 END + 2 * n + 2 * sources AS BIGINT) AS objects FROM k JOIN c USING (file_id)""")
def w6_page_extracts(spark, sf_dir):
    """Three new files a block, of pages of all its sources, dealt by id and put in falling order: what each page shows, whether its
    link still leads to a page, and how many objects the file has in all."""
    own = paged(spark, sf_dir)
    chosen = own.select("file_id", F.col("k").cast("int").alias("page_no"), F.concat(F.floor(F.col("doc_id") / BLOCK).cast("string"), F.lit("/"), F.pmod("doc_id", F.lit(3)).cast("string")).alias("into"), (-F.col("k")).alias("place"))
    made, top = extract.extract(*objects.opened(linked_files(spark, sf_dir)), chosen)
    objs, documents = objects.opened(sink.write_plain(made, top))
    found = settled(pages.pages(objs, documents))
    link = objects.ref_number(F.regexp_extract(F.col("entries")["Annots"], r"/D *\[(\d+ 0 R)", 1))
    ends = found.select("file_id", F.col("num").alias("to"), F.lit(True).alias("linked"))
    linked = found.select("file_id", "page_no", link.alias("to")).join(ends, ["file_id", "to"], "left").select("file_id", "page_no", F.coalesce("linked", F.lit(False)).alias("linked"))
    counts = objs.groupBy("file_id").agg(F.count("*").alias("objects"))
    return shown_on(found, objs).join(linked, ["file_id", "page_no"]).join(counts, "file_id").select("file_id", "page_no", "md5", "linked", "objects")


def _order_file(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A file a block of orders: a page an order, an object a part, which the orders that have it share."""
    items = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 100).cast("string").alias("file_id"), "l_orderkey", "l_partkey").distinct()
    orders = items.groupBy("file_id", "l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("parts"))
    part_num, page_num = lambda k: k + 10_000_000, lambda k: k + 100
    uses = F.array_join(F.transform("parts", lambda k: F.concat(F.lit("/P"), k.cast("string"), F.lit(" "), part_num(k).cast("string"), F.lit(" 0 R"))), "")
    leaf = orders.select("file_id", page_num(F.col("l_orderkey")).alias("num"), bytes_of(F.concat(F.lit("<</Parent 2 0 R/Resources<<"), uses, F.lit(">>/Type/Page>>"))).alias("body"))
    part = items.select("file_id", "l_partkey").distinct().select("file_id", part_num(F.col("l_partkey")).alias("num"), bytes_of(F.concat(F.lit("<</Key "), F.col("l_partkey").cast("string"), F.lit(">>"))).alias("body"))
    kids = orders.groupBy("file_id").agg(F.array_sort(F.collect_list(page_num(F.col("l_orderkey")))).alias("k"))
    top = kids.select("file_id", F.lit(2).cast("long").alias("num"), bytes_of(F.concat(F.lit("<</Count "), F.size("k").cast("string"), F.lit("/Kids["), F.array_join(F.transform("k", lambda k: F.concat(k.cast("string"), F.lit(" 0 R"))), " "), F.lit("]/Type/Pages>>"))).alias("body"))
    root = kids.select("file_id", F.lit(1).cast("long").alias("num"), F.lit(b"<</Pages 2 0 R/Type/Catalog>>").alias("body"))
    made = leaf.unionByName(part).unionByName(top).unionByName(root).withColumn("raw", F.lit(None).cast("binary"))
    return objects.opened(sink.write_packed(made, roots(made)))


ORDERS = "WITH i AS (SELECT DISTINCT CAST(l_orderkey // 100 AS VARCHAR) AS file_id, l_orderkey, l_partkey FROM lineitem), f AS (SELECT file_id, min(l_orderkey) AS first FROM i GROUP BY 1) "


@query(ORDERS + "SELECT i.file_id, l_partkey, CAST(CASE WHEN min(l_orderkey) = any_value(f.first) THEN 6 WHEN count(*) = 1 THEN 7 ELSE 8 END AS INTEGER) AS part, CAST(count(*) AS BIGINT) AS readers FROM i JOIN f ON i.file_id = f.file_id GROUP BY 1, 2")
def p1_partition(spark, sf_dir):
    objs, documents = _order_file(spark, sf_dir)
    found = pages.pages(objs, documents)
    placed = graph.partition(graph.reach(found, objs), objs, documents)
    parts = objs.where("entries['Key'] is not null").select("file_id", "num")
    return placed.join(parts, ["file_id", "num"]).select("file_id", (F.col("num") - 10_000_000).alias("l_partkey"), "part", "readers")


@query(ORDERS + ", n AS (SELECT file_id, l_orderkey, row_number() OVER (PARTITION BY file_id ORDER BY l_orderkey) AS page_no FROM (SELECT DISTINCT file_id, l_orderkey FROM i)) SELECT i.file_id, l_partkey, CAST(CASE WHEN min(page_no) = 1 THEN 6 WHEN count(*) = 1 THEN 7 ELSE 8 END AS INTEGER) AS part, CAST(min(page_no) AS INTEGER) AS first, CAST(max(page_no) AS INTEGER) AS last FROM i JOIN n ON i.file_id = n.file_id AND i.l_orderkey = n.l_orderkey GROUP BY 1, 2")
def p1_labels(spark, sf_dir):
    """The same partition from the first and the last page that reach a part, a row an object in every round."""
    objs, documents = _order_file(spark, sf_dir)
    found = pages.pages(objs, documents)
    told = graph.labels(found, objs)
    placed = graph.partition(told, objs, documents).join(told, ["file_id", "num"])
    parts = objs.where("entries['Key'] is not null").select("file_id", "num")
    return placed.join(parts, ["file_id", "num"]).select("file_id", (F.col("num") - 10_000_000).alias("l_partkey"), "part", "first", "last")


@query(ORDERS + "SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY l_orderkey) AS INTEGER) AS page_no, CAST(count(*) + 1 AS BIGINT) AS reached FROM i GROUP BY file_id, l_orderkey")
def p3_reach(spark, sf_dir):
    objs, documents = _order_file(spark, sf_dir)
    return graph.reach(pages.pages(objs, documents), objs).groupBy("file_id", "page_no").agg(F.count("*").alias("reached"))


@query(ORDERS + "SELECT i.file_id, CAST(row_number() OVER (PARTITION BY i.file_id ORDER BY CASE WHEN l_orderkey = f.first THEN 0 ELSE 1 END, l_orderkey) AS INTEGER) AS page_no, CAST(l_orderkey AS BIGINT) AS l_orderkey FROM (SELECT DISTINCT file_id, l_orderkey FROM i) i JOIN f ON i.file_id = f.file_id")
def p5_layout(spark, sf_dir):
    """Page objects in the order in which a linearized file has them."""
    objs, documents = _order_file(spark, sf_dir)
    found = pages.pages(objs, documents)
    laid = graph.layout(graph.partition(graph.labels(found, objs), objs, documents), found)
    own = found.select("file_id", "num").join(laid, ["file_id", "num"])
    order = F.row_number().over(Window.partitionBy("file_id").orderBy("new_num")).alias("page_no")
    return own.select("file_id", order, (F.col("num") - 100).alias("l_orderkey"))


@query(ORDERS + ", p AS (SELECT i.file_id, l_partkey, min(l_orderkey) = any_value(f.first) AS on_first, count(*) AS n FROM i JOIN f ON i.file_id = f.file_id GROUP BY 1, 2) SELECT file_id, l_partkey, CAST(row_number() OVER (PARTITION BY file_id ORDER BY CASE WHEN on_first THEN 0 ELSE 1 END, l_partkey) AS INTEGER) AS identifier FROM p WHERE on_first OR n > 1")
def p6_shared_identifiers(spark, sf_dir):
    """Identifiers of shared objects; the first page's own object is number 0."""
    objs, documents = _order_file(spark, sf_dir)
    found = pages.pages(objs, documents)
    laid = graph.layout(graph.partition(graph.labels(found, objs), objs, documents), found)
    named = graph.shared_identifiers(laid).where("num >= 10000000")
    return named.select("file_id", (F.col("num") - 10_000_000).alias("l_partkey"), "identifier")


@query(ORDERS + ", p AS (SELECT i.file_id, l_partkey, min(l_orderkey) AS o, min(l_orderkey) = any_value(f.first) AS on_first, count(*) AS n FROM i JOIN f ON i.file_id = f.file_id GROUP BY 1, 2), g AS (SELECT DISTINCT file_id, l_orderkey FROM i), c AS (SELECT g.file_id, g.l_orderkey, count(p.o) + 1 AS k FROM g LEFT JOIN p ON p.file_id = g.file_id AND p.o = g.l_orderkey AND (on_first OR n = 1) GROUP BY 1, 2) SELECT file_id, CAST(min(k) AS BIGINT) AS least_objects, CAST(greatest(1, length(bin(max(k) - min(k)))) AS INTEGER) AS object_bits, CAST(min(k) * 10 AS BIGINT) AS least_bytes, CAST((count(*) * greatest(1, length(bin(max(k) - min(k)))) + 7) // 8 AS BIGINT) AS size FROM c GROUP BY 1")
def h7_page_hints(spark, sf_dir):
    """The head of the page hint table, and the bytes that its column of object counts takes; every object counts as ten bytes long."""
    objs, documents = _order_file(spark, sf_dir)
    found = pages.pages(objs, documents)
    placed = graph.partition(graph.labels(found, objs), objs, documents)
    hints = linear.hint_columns(linear.page_lengths(placed, objs.select("file_id", "num", F.lit(10).cast("long").alias("extent"))))
    return hints.select("file_id", "least_objects", "object_bits", "least_bytes", F.octet_length("objects").cast("long").alias("size"))


def _hinted(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, references, groups) of files of 100 orders each: a page an order, a shared object a part of its lines."""
    items = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 100).cast("string").alias("file_id"), "l_orderkey", "l_partkey", F.col("l_quantity").cast("long").alias("q"))
    named = items.select("file_id", "l_partkey").distinct().withColumn("identifier", (F.row_number().over(Window.partitionBy("file_id").orderBy("l_partkey")) - 1).cast("long"))
    told = items.groupBy("file_id", "l_orderkey").agg(F.countDistinct("l_partkey").alias("objects"), F.sum("q").alias("bytes"))
    told = told.withColumns({"page_no": F.row_number().over(Window.partitionBy("file_id").orderBy("l_orderkey")), "content_at": F.col("l_orderkey") % 1000 * 70_000, "content": F.col("l_orderkey") % 7})
    refs = items.select("file_id", "l_orderkey", "l_partkey").distinct().join(named, ["file_id", "l_partkey"]).join(told.select("file_id", "l_orderkey", "page_no"), ["file_id", "l_orderkey"])
    refs = refs.select("file_id", "page_no", (F.row_number().over(Window.partitionBy("file_id", "page_no").orderBy("identifier")) - 1).cast("long").alias("ord"), "identifier")
    return told, refs, named.withColumn("bytes", F.col("l_partkey") * 3)


HINTED = """WITH i AS (SELECT CAST(l_orderkey // 100 AS VARCHAR) AS file_id, l_orderkey, l_partkey, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
p AS (SELECT file_id, l_orderkey, count(DISTINCT l_partkey) AS objects, CAST(sum(q) AS BIGINT) AS bytes, row_number() OVER (PARTITION BY file_id ORDER BY l_orderkey) AS page_no, l_orderkey % 1000 * 70000 AS content_at, l_orderkey % 7 AS content FROM i GROUP BY 1, 2),
d AS (SELECT file_id, l_partkey, row_number() OVER (PARTITION BY file_id ORDER BY l_partkey) - 1 AS identifier FROM (SELECT DISTINCT file_id, l_partkey FROM i)),
r AS (SELECT DISTINCT i.file_id, p.page_no, d.identifier FROM i JOIN d USING (file_id, l_partkey) JOIN p USING (file_id, l_orderkey)) """


@query(HINTED + "SELECT p.file_id, CAST(p.page_no AS INTEGER) AS page_no, CAST(objects AS BIGINT) AS objects, bytes, CAST(content_at AS BIGINT) AS content_at, CAST(content AS BIGINT) AS content, string_agg(CAST(identifier AS VARCHAR), ',' ORDER BY identifier) AS identifiers FROM p JOIN r USING (file_id, page_no) GROUP BY ALL")
def h4_hint_pages(spark, sf_dir):
    """Page offset hint tables made and read again: every column, and the shared objects of each page."""
    told, refs, _ = _hinted(spark, sf_dir)
    tables = linear.page_hint_table(told, refs, told.select("file_id").distinct().withColumn("first_page_at", F.lit(1234)))
    said, named = linear.hint_pages(tables.join(told.groupBy("file_id").agg(F.count("*").alias("pages")), "file_id"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "identifier"))), lambda x: x["identifier"].cast("string")), ",")
    named = named.groupBy("file_id", "page_no").agg(text.alias("identifiers"))
    return said.join(named, ["file_id", "page_no"]).select("file_id", "page_no", "objects", "bytes", "content_at", "content", "identifiers")


@query(HINTED + "SELECT file_id, CAST(identifier AS BIGINT) AS identifier, CAST(l_partkey * 3 AS BIGINT) AS bytes, CAST(1 AS BIGINT) AS objects FROM d")
def h4_hint_groups(spark, sf_dir):
    """Shared object hint tables made and read again."""
    _, _, groups = _hinted(spark, sf_dir)
    first = groups.groupBy("file_id").agg(F.min("l_partkey").alias("first_object"), F.lit(99).alias("first_object_at"), F.lit(0).alias("first_page_groups"))
    return linear.hint_groups(linear.shared_hint_table(groups, first)).select("file_id", "identifier", "bytes", "objects")


H7_BITS = HINTED + """, c AS (SELECT file_id, page_no, count(*) AS n FROM r GROUP BY 1, 2), e AS (SELECT p.*, c.n FROM p JOIN c USING (file_id, page_no)),
w AS (SELECT file_id, min(objects) AS lo, greatest(1, length(bin(max(objects) - min(objects)))) AS wo, min(bytes) AS lb, greatest(1, length(bin(max(bytes) - min(bytes)))) AS wb, min(content_at) AS la, greatest(1, length(bin(max(content_at) - min(content_at)))) AS wa, min(content) AS lc, greatest(1, length(bin(max(content) - min(content)))) AS wc, greatest(1, length(bin(max(n)))) AS wn FROM e GROUP BY 1),
v AS (SELECT file_id, greatest(1, length(bin(max(identifier)))) AS wi FROM r GROUP BY 1),
g AS (SELECT e.file_id, string_agg(lpad(bin(objects - lo), CAST(wo AS INTEGER), '0'), '' ORDER BY page_no) AS g1, string_agg(lpad(bin(bytes - lb), CAST(wb AS INTEGER), '0'), '' ORDER BY page_no) AS g2, string_agg(lpad(bin(n), CAST(wn AS INTEGER), '0'), '' ORDER BY page_no) AS g3, string_agg(lpad(bin(content_at - la), CAST(wa AS INTEGER), '0'), '' ORDER BY page_no) AS g6, string_agg(lpad(bin(content - lc), CAST(wc AS INTEGER), '0'), '' ORDER BY page_no) AS g7 FROM e JOIN w USING (file_id) GROUP BY 1),
h AS (SELECT r.file_id, string_agg(lpad(bin(identifier), CAST(wi AS INTEGER), '0'), '' ORDER BY page_no, identifier) AS g4, string_agg('0', '') AS g5 FROM r JOIN v USING (file_id) GROUP BY 1),
f AS (SELECT file_id, unnest([g1, g2, g3, g4, g5, g6, g7]) AS b, unnest([1, 2, 3, 4, 5, 6, 7]) AS k FROM g JOIN h USING (file_id)),
t AS (SELECT file_id, string_agg(rpad(b, CAST((length(b) + 7) // 8 * 8 AS INTEGER), '0'), '' ORDER BY k) AS bits FROM f GROUP BY 1)
SELECT file_id, CAST((288 + length(bits)) // 8 AS BIGINT) AS size, md5(concat(lpad(bin(lo), 32, '0'), lpad(bin(1234), 32, '0'), lpad(bin(wo), 16, '0'), lpad(bin(lb), 32, '0'), lpad(bin(wb), 16, '0'), lpad(bin(la), 32, '0'), lpad(bin(wa), 16, '0'), lpad(bin(lc), 32, '0'), lpad(bin(wc), 16, '0'), lpad(bin(wn), 16, '0'), lpad(bin(wi), 16, '0'), lpad('1', 16, '0'), lpad('1', 16, '0'), bits)) AS md5 FROM t JOIN w USING (file_id) JOIN v USING (file_id)"""


@query(H7_BITS)
def h7_hint_tables(spark, sf_dir):
    """Whole page offset hint tables, head and seven columns, bit by bit."""
    told, refs, _ = _hinted(spark, sf_dir)
    tables = linear.page_hint_table(told, refs, told.select("file_id").distinct().withColumn("first_page_at", F.lit(1234)))
    bits = F.array_join(F.transform(F.regexp_extract_all(F.hex("table"), F.lit("(.)"), F.lit(1)), lambda h: F.lpad(F.conv(h, 16, 2), 4, "0")), "")
    return tables.select("file_id", F.octet_length("table").cast("long").alias("size"), F.md5(bits).alias("md5"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'Encrypt' WHEN o_orderkey % 5 = 1 THEN 'OpenAction' WHEN o_orderkey % 5 = 2 THEN 'PageMode' WHEN o_orderkey % 5 = 3 THEN 'Thumb' END AS reason FROM orders")
def p2_refusals(spark, sf_dir):
    """A small file an order; four of five have something that keeps them from being laid out anew."""
    k = F.col("o_orderkey") % 5
    top = F.when(k == 1, "/OpenAction 3 0 R").when(k == 2, "/PageMode 3 0 R").otherwise("")
    body = F.concat(F.lit("1 0 obj <</Pages 2 0 R/Type/Catalog"), top, F.lit(">> endobj 2 0 obj <</Kids[3 0 R]/Type/Pages>> endobj 3 0 obj <</Type/Page"), F.when(k == 3, "/Thumb 1 0 R").otherwise(""), F.lit(">> endobj trailer <</Root 1 0 R"), F.when(k == 0, "/Encrypt 3 0 R").otherwise(""), F.lit(">>"))
    files = spread(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select(F.col("o_orderkey").cast("string").alias("file_id"), bytes_of(body).alias("content"))
    objs, documents = objects.opened(files)
    return security.refusal(objs, documents).select(F.col("file_id").cast("long").alias("o_orderkey"), "reason")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'own' ELSE 'near' END AS fonts FROM orders")
def p4_inherited_reach(spark, sf_dir):
    """A small file an order: its page takes resources from the node right above, which shadow those of the root, or has its own."""
    own = F.when(F.col("o_orderkey") % 3 == 0, "/Resources<</Font 7 0 R>>").otherwise("")
    body = F.concat(F.lit("1 0 obj <</Pages 2 0 R/Type/Catalog>> endobj 2 0 obj <</Kids[3 0 R]/Type/Pages/Resources<</Font 5 0 R>>>> endobj 3 0 obj <</Kids[4 0 R]/Parent 2 0 R/Type/Pages/Resources 6 0 R>> endobj 4 0 obj <</Parent 3 0 R/Type/Page"), own, F.lit(">> endobj 5 0 obj (far) endobj 6 0 obj <</Font 8 0 R>> endobj 7 0 obj (own) endobj 8 0 obj (near) endobj trailer <</Root 1 0 R>>"))
    files = spread(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select(F.col("o_orderkey").cast("string").alias("file_id"), bytes_of(body).alias("content"))
    objs, documents = objects.opened(files)
    found = pages.pages(objs, documents)
    reached = graph.reach(found, objs, graph.inherited(found, objs)).join(objs.where("kind = 'string'").select("file_id", "num", "body"), ["file_id", "num"])
    fonts = F.array_join(F.array_sort(F.collect_list(F.decode(values.to_bytes(F.decode("body", "ISO-8859-1")), "ISO-8859-1"))), ",")
    return reached.groupBy("file_id").agg(fonts.alias("fonts")).select(F.col("file_id").cast("long").alias("o_orderkey"), "fonts")


@query("WITH s AS (SELECT o_orderkey, o_orderkey AS a, o_orderkey + o_custkey % 50 AS z FROM orders), e AS (SELECT l_orderkey AS num, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS b, max(l_linenumber) AS m FROM lineitem GROUP BY 1) SELECT o_orderkey, CASE WHEN count(num) < z - a + 1 THEN 'missing' WHEN max(m) > 6 THEN 'skipped' ELSE 'checked' END AS verdict, CASE WHEN count(num) = z - a + 1 AND max(m) <= 6 THEN CAST(sum(b) AS BIGINT) END AS bytes FROM s LEFT JOIN e ON num BETWEEN a AND z AND num // 10000 = a // 10000 GROUP BY o_orderkey, a, z")
def h5_span_lengths(spark, sf_dir):
    """Spans of consecutive orders summed over their lines' parts, in one file; orders of seven lines count as packed."""
    extents = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("num")).agg(F.sum("l_partkey").alias("extent"), F.max("l_linenumber").alias("m"))
    extents = extents.select(F.floor(F.col("num") / 10_000).cast("string").alias("file_id"), "num", F.when(F.col("m") > 6, "o").otherwise("n").alias("kind"), "extent")
    orders = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 10_000).cast("string").alias("file_id"), "o_orderkey", F.col("o_orderkey").alias("first"), (1 + F.col("o_custkey") % 50).alias("count"))
    return linear.span_lengths(orders, extents).select("o_orderkey", "verdict", F.col("bytes").cast("long").alias("bytes"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'outside' WHEN event_id % 4 = 1 THEN 'tail not signed' ELSE 'bound' END AS binding FROM events WHERE event_id IS NOT NULL AND user_id IS NOT NULL")
def g4_gap_binding(spark, sf_dir):
    """A file a user: an object of 100 bytes an event, at 100 times its number, that ends at byte 80. The gap lies in it, or
    in the next one; the signed bytes reach its end, or not."""
    ev = table(spark, sf_dir, "events").where("event_id is not null and user_id is not null").select(F.col("user_id").cast("string").alias("file_id"), "event_id", (F.col("event_id") * 100).alias("offset"))
    ends = ev.select("file_id", (F.col("offset") + 80).alias("at"))
    k = F.col("event_id") % 4
    gaps = ev.withColumns({"gap_start": F.when(k == 0, F.col("offset") + 90).otherwise(F.col("offset") + 10), "signed_end": F.when(k == 1, F.col("offset") + 79).otherwise(F.col("offset") + 80)})
    return signatures.bound(gaps, ends).select("event_id", "binding")


@query("WITH k AS (SELECT user_id, event_type, min(event_id) AS first FROM events WHERE event_id IS NOT NULL AND user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first) AS n FROM k) SELECT event_id, r.first AS same, n <= 2 AS allowed FROM events e JOIN r ON e.user_id = r.user_id AND e.event_type = r.event_type WHERE event_id IS NOT NULL")
def g7_budget(spark, sf_dir):
    """Signatures that differ by the type of an event; two of a file are in its budget."""
    ev = table(spark, sf_dir, "events").where("event_id is not null and user_id is not null and event_type is not null")
    found = ev.select(F.col("user_id").cast("string").alias("file_id"), F.col("event_id").alias("seq"), F.lit("adbe.pkcs7.detached").alias("sub_filter"), F.array(F.lit(0), F.lit(10), F.lit(20), F.lit(5)).cast("array<long>").alias("byte_range"), F.encode("event_type", "UTF-8").alias("contents"))
    return signatures.budgeted(found, most=2).select(F.col("seq").alias("event_id"), "same", "allowed")


@query("SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS width, md5(text) AS md5, 'BI Q' AS operators FROM documents")
def c4_inline_images(spark, sf_dir):
    """A grey image a document whose one row is the whole text, EI and all, between two operators."""
    df = texts(spark, sf_dir).where("b is not null")
    stream = F.concat(bytes_of(F.concat(F.lit("q BI /W "), F.octet_length("b").cast("string"), F.lit(" /H 1 /BPC 8 /CS /G ID "))), F.col("b"), F.lit(b"\nEI Q"))
    ops = pages.operations(df.select("doc_id", stream.alias("content"))).where("operator != 'q'")
    image = F.max_by(F.struct("image", "image_data"), F.col("operator") == "BI").alias("i")
    found = ops.groupBy("doc_id").agg(image, F.array_join(F.array_sort(F.collect_list("operator")), " ").alias("operators"))
    return found.select("doc_id", F.regexp_extract("i.image", r"/Width (\d+)", 1).cast("long").alias("width"), F.md5("i.image_data").alias("md5"), "operators")


@query("SELECT vec_id, CAST(len(embedding) AS BIGINT) AS width, CAST(8 AS BIGINT) AS rows, CAST(list_sum(list_transform([-0.8, -0.6, -0.4, -0.2, 0.0, 0.2, 0.4, 0.6], lambda t: len(list_filter(embedding, lambda x: CAST(x AS DOUBLE) > t)))) AS BIGINT) AS black FROM embeddings WHERE len(embedding) > 0")
def f8_fax(spark, sf_dir):
    """Eight rows a vector, black where a component is above a threshold, in one-dimensional codes for even numbers and two-dimensional ones for odd."""
    from quire.kernels.fax import BLACK_ENDS, BLACK_MORE, MODES, WHITE_ENDS, WHITE_MORE

    ends, more = (WHITE_ENDS, BLACK_ENDS), (WHITE_MORE, BLACK_MORE)
    mode = {v: k for k, v in MODES.items()}

    def run(n: int, black: int) -> str:
        return (more[black][n // 64 - 1] if n >= 64 else "") + ends[black][n % 64]

    def write(vector: list, two: int) -> bytes:
        v = np.array(vector, np.float64)
        width, bits, above = len(v), "", np.zeros(0, np.int64)
        for k in range(8):
            row = v > (-0.8, -0.6, -0.4, -0.2, 0.0, 0.2, 0.4, 0.6)[k]
            changes = np.flatnonzero(np.diff(np.concatenate([[False], row])))
            if not two:
                edges = np.concatenate([[0], changes, [width]])
                bits += "".join(run(int(n), i % 2) for i, n in enumerate(np.diff(edges)))
                continue
            at, black = -1, 0
            while at < width:
                # the next change here, and the next one above to the other colour, right of where we are
                a1 = next((int(c) for i, c in enumerate(changes) if c > at and i % 2 == black or (at < 0 and c == 0 and i == 0)), width)
                b1 = next((int(c) for i, c in enumerate(above) if c > at and i % 2 == black), width)
                b2 = next((int(c) for c in above if c > b1), width)
                if b2 < a1:
                    bits, at = bits + mode["pass"], b2
                elif abs(a1 - b1) <= 3:
                    bits, at, black = bits + mode[a1 - b1], a1, 1 - black
                else:
                    a2 = next((int(c) for c in changes if c > a1), width)
                    bits, at = bits + mode["horizontal"] + run(a1 - max(at, 0), black) + run(a2 - a1, 1 - black), a2
            above = changes
        return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")

    df = table(spark, sf_dir, "embeddings").where("size(embedding) > 0").select("vec_id", F.size("embedding").cast("long").alias("width"), "embedding", (F.col("vec_id") % 2).cast("int").alias("two"))
    raw = F.udf(write, "binary", useArrow=True)("embedding", "two")
    parms = F.concat(F.lit("<</K "), (-F.col("two")).cast("string"), F.lit("/EndOfBlock false/BlackIs1 true/Rows 8/Columns "), F.col("width").cast("string"), F.lit(">>"))
    back = decode_filter(df, raw, "CCITTFaxDecode", parms).select("vec_id", "width", F.col("decoded.data").alias("d"))
    bits = F.aggregate(F.regexp_extract_all(F.hex("d"), F.lit("(..)"), F.lit(1)), F.lit(0).cast("long"), lambda a, h: a + F.bit_count(F.conv(h, 16, 10).cast("long")))
    return back.select("vec_id", "width", F.floor(F.octet_length("d") / F.ceil(F.col("width") / 8)).cast("long").alias("rows"), bits.alias("black"))


@query("SELECT source || '/' || (doc_id // 1000) AS file_id, CAST(20 + count(*) AS BIGINT) AS signed, true AS covers_whole_file, md5(source || '/' || (doc_id // 1000)) AS name FROM documents WHERE source IS NOT NULL GROUP BY 1")
def g1_signatures(spark, sf_dir):
    """A file a source and block with one signature field; the signed bytes are all but the gap."""
    docs = table(spark, sf_dir, "documents").where("source is not null").groupBy(F.concat("source", F.lit("/"), F.floor(F.col("doc_id") / BLOCK).cast("string")).alias("file_id")).agg(F.count("*").alias("n"))

    def build(name: str, n: int) -> bytes:
        head = b"%%PDF-1.7\n1 0 obj\n<</AcroForm 3 0 R/Pages 2 0 R/Type/Catalog>>\nendobj\n2 0 obj\n<</Count 0/Kids[]/Type/Pages>>\nendobj\n3 0 obj\n<</Fields[4 0 R]>>\nendobj\n4 0 obj\n<</FT/Sig/T(%s)/V 5 0 R>>\nendobj\n5 0 obj\n<</Filter/Adobe.PPKLite/SubFilter/adbe.pkcs7.detached/ByteRange[" % name.encode()
        gap, tail = b"<30030201050000>", b">>\nendobj\ntrailer\n<</Root 1 0 R>>\n%" + b"x" * n
        a = len(head) + len("0 0000000000 0000000000 0000000000]/Contents")
        ranges = b"0 %d %d %d" % (a, a + len(gap), len(tail))
        ranges = ranges.ljust(len("0 0000000000 0000000000 0000000000"))
        return head + ranges + b"]/Contents" + gap + tail

    files = docs.select("file_id", "n", F.udf(build, "binary", useArrow=True)(F.md5("file_id"), F.col("n")).alias("content"))
    objs, documents = objects.opened(files)
    found = signatures.signatures(files, objs, documents).where("hex(contents) = '3003020105' and filter = '/Adobe.PPKLite'")
    base = F.octet_length("content") - F.lit(16) - F.col("n") - F.octet_length("signed") + F.col("n")
    return found.join(files, "file_id").select("file_id", (F.lit(20) + F.col("n") + base).alias("signed"), "covers_whole_file", "name")


@query(SHOWN)
def e5_decrypted_files(spark, sf_dir):
    """The files with streams under AES-128 by a user password, their dictionary in clear, opened with that password. Every
    third stream is exempt by a leading Crypt filter."""
    from quire.kernels import legacy_crypt as crypt
    from quire.kernels.syntax import Name, format_value

    ident, rights = b"0123456789abcdef", -44
    owner = crypt.owner_entry(b"boss", b"guest", 4, 16)
    key = crypt.file_key(b"guest", owner, rights, ident, 4, 16)
    entries = {Name("Filter"): Name("Standard"), Name("V"): 4, Name("R"): 4, Name("Length"): 128, Name("P"): rights, Name("O"): owner, Name("U"): crypt.user_entry(key, ident, 4) + bytes(16), Name("CF"): {Name("StdCF"): {Name("CFM"): Name("AESV2")}}, Name("StmF"): Name("StdCF"), Name("StrF"): Name("StdCF")}
    plain = page_objects(paged(spark, sf_dir))
    exempt = F.col("num") % 3 == 0
    locked = plain.where(~exempt).unionByName(plain.where(exempt & F.col("raw").isNull()))
    locked = security.encrypted(locked, key).withColumn("body", F.when(F.col("raw").isNotNull(), stream_body(F.lit("/Filter/FlateDecode"), F.col("raw"))).otherwise(F.col("body")))
    open_ = plain.where(exempt & F.col("raw").isNotNull()).withColumn("body", stream_body(F.lit("/Filter[/Crypt/FlateDecode]"), F.col("raw")))
    lock = plain.groupBy("file_id").agg((F.max("num") + 1).alias("num")).withColumns({"body": F.lit(format_value(entries)), "raw": none()})
    more = F.concat(F.lit("/Encrypt "), F.col("num").cast("string"), F.lit(" 0 R/ID[<" + ident.hex() + "><00>]"))
    root = lock.select("file_id", F.lit(1).alias("root"), more.alias("more"))
    objs, documents = objects.opened(sink.write_plain(locked.unionByName(open_).unionByName(lock), root))
    objs = security.decrypted(objs, security.protection(documents, objs, "guest"))
    return shown_on(pages.pages(objs, documents), objs)


def _locked_files(spark, sf_dir, packed: bool) -> tuple[DataFrame, DataFrame]:
    """(files, passwords): the files under a password each; every page has a title, in an array of a dictionary, which is encrypted where
    strings are: in files of an even block. Of a packed file only the streams are, object streams among them."""
    own = paged(spark, sf_dir)
    plain = page_objects(own)
    title = F.concat(F.lit("<</Contents "), (2 * F.col("k") + 2).cast("string"), F.lit(" 0 R/Info[<</T<"), F.hex(F.unhex(F.md5("b"))), F.lit(">>>()]/Parent 2 0 R/Type/Page>>"))
    titled = plain.join(own.select("file_id", (2 * F.col("k") + 1).alias("num"), bytes_of(title).alias("new")), ["file_id", "num"], "left").withColumn("body", F.coalesce("new", "body")).drop("new")
    block = F.regexp_extract("file_id", r"(\d+)$", 1).cast("long")
    asked = own.select("file_id").distinct().select("file_id", F.concat(F.lit("guest of "), "file_id").alias("user"), F.lit("boss").alias("owner"), F.lit(-44).alias("rights"), (block % 2 == 0).alias("strings"))
    made = settled(security.locks(asked))
    root = roots(plain).join(security.trailer_of(made), "file_id")
    with_strings = made.join(asked.where("strings").select("file_id"), "file_id", "left_semi")
    if packed:
        files = sink.write_packed(titled, root, lambda streams: security.encrypted(streams, made))
    else:
        without = titled.join(with_strings.select("file_id"), "file_id", "left_anti")
        streams = security.encrypted(without.where("raw is not null"), made).unionByName(without.where("raw is null").select("file_id", "num", "body", "raw"))
        files = sink.write_plain(security.encrypted(titled.join(with_strings.select("file_id"), "file_id", "left_semi"), made).unionByName(streams), root)
    return files, asked.select("file_id", F.when(block % 3 == 0, "boss").otherwise(F.col("user")).alias("password"))


def _titled(files: DataFrame, passwords: DataFrame) -> DataFrame:
    """file_id, page_no, md5 of what a page shows, whether its title says the same, as opened with the passwords."""
    objs, documents = objects.opened(files, passwords)
    found = settled(pages.pages(objs, documents))
    titles = found.select("file_id", "page_no", F.regexp_extract(F.col("entries")["Info"], r"/T ?<([0-9a-f]{32})>", 1).alias("title"))
    return shown_on(found, objs).join(titles, ["file_id", "page_no"]).select("file_id", "page_no", "md5", (F.col("title") == F.col("md5")).alias("same_title"))


LOCKED = "SELECT file_id, page_no, md5, true AS same_title FROM (" + SHOWN + ")"


@query(LOCKED)
def e7_locked_files(spark, sf_dir):
    """Files with passwords, keys and identifiers of their own, strings encrypted in every other, opened by the user or the owner."""
    return _titled(*_locked_files(spark, sf_dir, False))


@query(LOCKED)
def s1_locked_packed_files(spark, sf_dir):
    """The same with objects in encrypted object streams."""
    return _titled(*_locked_files(spark, sf_dir, True))


@query(LOCKED)
def s14_locked_repaired_files(spark, sf_dir):
    """The same files of encrypted object streams without the way to their table."""
    files, passwords = _locked_files(spark, sf_dir, True)
    return _titled(without_startxref(files), passwords)


@query("SELECT o_orderkey, CAST(o_custkey % 512 AS BIGINT) AS a, CAST(o_orderkey % 512 AS BIGINT) AS b, CAST(3 AS BIGINT) AS n FROM orders")
def h3_hint_bits(spark, sf_dir):
    """Two fields and a zero in nine bits each, packed and read again."""
    df = table(spark, sf_dir, "orders")
    fields = F.array(F.pmod("o_custkey", F.lit(512)), F.pmod("o_orderkey", F.lit(512)), F.lit(0).cast("long"))
    back = df.select("o_orderkey", linear.unpacked_bits(linear.packed_bits(fields, 9), 9, F.lit(3).cast("long")).alias("v"))
    return back.select("o_orderkey", F.col("v")[0].alias("a"), F.col("v")[1].alias("b"), F.size("v").cast("long").alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'not linearized' WHEN o_orderkey % 3 = 1 THEN 'length changed since' END AS error, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_custkey AS BIGINT) END AS pages FROM orders")
def h1_linearized(spark, sf_dir):
    """Heads of files with a parameter dictionary that is right, that states another length, or that is something else."""
    df = table(spark, sf_dir, "orders")
    kind = F.col("o_orderkey") % 3
    key = F.when(kind == 0, "/Version 1").otherwise("/Linearized 1")
    start = F.concat(F.lit("%PDF-1.7\n9 0 obj\n<<"), key, F.lit("/N "), F.col("o_custkey").cast("string"), F.lit("/L "))
    body = F.concat(F.lit(">>\nendobj\n"), F.repeat(F.lit("x"), 100))
    whole = F.length(start) + F.length(body) + 3
    content = F.concat(start, F.when(kind == 1, whole + 1).otherwise(whole).cast("string"), body)
    found = linear.linearized(df.select(F.col("o_orderkey").cast("string").alias("file_id"), bytes_of(content).alias("content")))
    return found.select(F.col("file_id").cast("long").alias("o_orderkey"), "error", F.col("claim")["N"].alias("pages"))


def linearized_files(own: DataFrame) -> DataFrame:
    """file_id, content: linearized files of one page that shows b, of own (file_id, b, fault). Numbers that depend on places have ten
    digits, so that all places follow from sizes. A fault changes one of the claims or, the last but one, two."""
    size = lambda c: F.octet_length(c).cast("long")
    ten = lambda c: F.lpad(c.cast("string"), 10, "0")
    spelled = lambda *parts: bytes_of(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))
    said = lambda c, *faults: c + F.when(F.col("fault").isin(*faults), 1).otherwise(0)
    four = lambda c: F.unhex(F.lpad(F.hex(c.cast("long")), 8, "0"))
    at = {"head": 9, "first": 9 + 126, "top": 9 + 126 + 9 + 100 + 65}
    top = b"3 0 obj\n<</Pages 1 0 R/Type/Catalog>>\nendobj\n"
    page = b"5 0 obj\n<</Contents 6 0 R/Parent 1 0 R/Type/Page>>\nendobj\n"
    tree = b"1 0 obj\n<</Count 1/Kids[5 0 R]/MediaBox[0 0 612 792]/Type/Pages>>\nendobj\n"
    place = F.when(F.col("fault") == 7, 35).otherwise(36)
    lead = lambda n: F.concat(F.lit("4 0 obj\n<</Length 69/S "), n.cast("string"), F.lit(">>\nstream\n"))
    hint_size = len("4 0 obj\n<</Length 69/S 36>>\nstream\n") + 69 + len("\nendstream\nendobj\n")
    hint_at = at["top"] + len(top)
    page_at = hint_at + hint_size
    data_at = page_at + len(page)
    data = F.concat(spelled("6 0 obj\n<</Length ", size(F.col("b")).cast("string"), ">>\nstream\n"), F.col("b"), F.lit(b"\nendstream\nendobj\n"))
    rows = own.withColumn("data", data)
    tree_at = F.lit(data_at) + size(F.col("data"))
    table_at = tree_at + len(tree)
    two = F.lit(b"\0\0")
    pages_told = F.concat(four(F.lit(2)), four(F.lit(page_at)), two, four(said(len(page) + size(F.col("data")), 6)), two, four(F.lit(0)), two, four(F.lit(0)), two, two, two, two, F.lit(b"\0\1"))
    shared_told = F.concat(four(F.lit(0)), four(F.lit(0)), four(F.lit(2)), four(F.lit(2)), two, four(F.lit(0)), F.lit(b"\0\x20"), four(F.lit(len(page))), four(size(F.col("data"))), F.lit(b"\0"))
    hint = F.concat(bytes_of(lead(place)), pages_told, shared_told, F.lit(b"\nendstream\nendobj\n"))
    line = lambda c: F.concat(ten(c), F.lit(" 00000 n \n"))
    last = F.concat(F.lit("xref\n0 2\n0000000000 65535 f \n"), line(tree_at), F.lit(f"trailer\n<</Size 2>>\nstartxref\n{at['first']}\n%%EOF\n"))
    whole = said(table_at + F.length(last), 9)
    main = F.when(F.col("fault") == 5, table_at + 48).otherwise(table_at + 8)
    claims = spelled("2 0 obj\n<</Linearized 1/L ", ten(whole), f"/H[{hint_at:010d} ", ten(said(F.lit(hint_size), 4)), "]/O ", said(F.lit(5), 2).cast("string"), "/E ", ten(said(tree_at, 3, 8)), "/N ", said(F.lit(1), 1, 8).cast("string"), "/T ", ten(main), ">>")
    claims = F.concat(claims, F.lit(b"\n"), F.lit(b" " * (126 - 8 - CLAIMS)), F.lit(b"endobj\n"))
    numbers = F.concat(F.lit("xref\n2 5\n"), line(F.lit(at["head"])), line(F.lit(at["top"])), line(F.lit(hint_at)), line(F.lit(page_at)), line(F.lit(data_at)))
    first = spelled(numbers, "trailer\n<</Root 3 0 R/Size 7/Prev ", ten(table_at), ">>\nstartxref\n0\n%%EOF\n")
    content = F.concat(F.lit(b"%PDF-1.7\n"), claims, first, F.lit(top), hint, F.lit(page), F.col("data"), F.lit(tree), bytes_of(last))
    return rows.select("file_id", content.alias("content"))


#: The bytes of the parameter dictionary in linearized_files.
CLAIMS = len("2 0 obj\n<</Linearized 1/L 0000000000/H[0000000000 0000000000]/O 5/E 0000000000/N 1/T 0000000000>>")


@query("SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN 'sound' WHEN 1 THEN 'page count' WHEN 2 THEN 'first page' WHEN 3 THEN 'first page end' WHEN 4 THEN 'hint stream length' WHEN 5 THEN 'main table place' WHEN 6 THEN 'page length' WHEN 7 THEN 'shared table place' WHEN 8 THEN 'first page end, page count' ELSE 'length changed since' END AS findings FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL")
def h2_deep_check(spark, sf_dir):
    """A linearized file of each whole text, nine of ten with a false claim or two."""
    own = table(spark, sf_dir, "documents").where("doc_id is not null and text is not null").select(F.col("doc_id").cast("string").alias("file_id"), F.encode("text", "UTF-8").alias("b"), F.pmod("doc_id", F.lit(10)).alias("fault"))
    files = settled(linearized_files(own))
    wrong = linear_check.deep_check(files).groupBy("file_id").agg(F.array_join(F.array_sort(F.collect_set("finding")), ", ").alias("findings"))
    return files.select("file_id").join(wrong, "file_id", "left").select(F.col("file_id").cast("long").alias("doc_id"), F.coalesce("findings", F.lit("sound")).alias("findings"))


@query(SHOWN.replace(" FROM documents", ", CAST(0 AS BIGINT) AS findings FROM documents"))
def h8_linearized_files(spark, sf_dir):
    """Packed files, whose pages share three fonts, written linearized: what the pages show, and what the deep check finds."""
    own = paged(spark, sf_dir)
    objs = page_objects(own)
    n = own.groupBy("file_id").agg(F.count("*").alias("n"))
    font = F.concat((2 * F.col("n") + 3 + F.floor(F.col("num") / 2) % 3).cast("string"), F.lit(" 0 R"))
    fonted = F.regexp_replace(F.decode("body", "ISO-8859-1"), "/Type/Page>>", F.concat(F.lit("/Resources<</Font<</F1 "), font, F.lit(">>>>/Type/Page>>")))
    is_leaf = (F.col("num") > 2) & (F.col("num") % 2 == 1)
    objs = objs.join(n, "file_id").withColumn("body", F.when(is_leaf, bytes_of(fonted)).otherwise(F.col("body"))).drop("n")
    fonts = n.select("file_id", F.explode(F.transform(F.array(*map(F.lit, range(3))), lambda k: F.col("n") * 2 + 3 + k)).alias("num"), F.lit(b"<</BaseFont/Courier/Subtype/Type1/Type/Font>>").alias("body"), none().alias("raw"))
    files = sink.write_packed(objs.unionByName(fonts), roots(own))
    new = settled(linear_sink.linearize(*objects.opened(files)))
    wrong = linear_check.deep_check(new).groupBy("file_id").agg(F.count("*").alias("findings"))
    return shown(new).join(wrong, "file_id", "left").withColumn("findings", F.coalesce("findings", F.lit(0).cast("long")))
