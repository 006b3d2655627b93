"""Single objects of files by their number: of a file only the spans that are asked for are cut out and parsed.

The cross-reference chain says where an object stands, and the next place that it names where the object ends at the latest.
Catalyst cuts these spans out of the bytes; Python parses one span at a time and never sees the rest of a file's objects.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from quire.kernels import rows
from quire.operators.objects import COLUMNS, VALUE, _in_clear, merged, opened, sections, trailers, unpacked
from quire.operators.objects import ref_number as number
from quire.plans.rounds import settled

#: What is read of a span besides the value: the number that a reference in /Length names, and whether the object ends in the span.
SPAN = f"file_id: string, num: long, offset: long, gen: long, {VALUE}, length_at: long, closed: boolean, error: string"


def _parsed(spans: DataFrame) -> DataFrame:
    """The objects of spans (file_id, num, offset, length, data), a row a span."""
    schema = _parse_datatype_string(SPAN)

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for file_id, num, offset, length, data in zip(*(batch.column(k) for k in range(5)), strict=True):
                row = rows.span_row(num.as_py(), data.as_py() or b"", length.as_py())
                entries = row["entries"]
                row |= {"file_id": file_id.as_py(), "num": num.as_py(), "offset": offset.as_py(), "entries": None if entries is None else list(entries.items())}
                yield pa.RecordBatch.from_pylist([row], arrow)

    return spans.select("file_id", "num", "offset", "length", "data").mapInArrow(read, schema)


def _cut(files: DataFrame, spans: DataFrame) -> DataFrame:
    """spans (file_id, num, offset, until, length) with the bytes from offset to until, or to the end of the file where that is null."""
    own = spans.groupBy("file_id").agg(F.collect_list(F.struct("num", "offset", "until", "length")).alias("s"))
    each = files.join(own, "file_id").select("file_id", "content", F.explode("s").alias("s")).select("file_id", "content", "s.*")
    size = F.coalesce("until", F.octet_length("content").cast("long")) - F.col("offset")
    return each.select("file_id", "num", "offset", "length", F.substring("content", (F.col("offset") + 1).cast("int"), size.cast("int")).alias("data"))


def _until(table: DataFrame) -> DataFrame:
    """file_id, num, offset, until of each object that stands by itself: until is the next place that the table names."""
    places = table.where("kind = 'n' and offset > 0").select("file_id", "offset").distinct()
    nexts = places.withColumn("until", F.lead("offset").over(Window.partitionBy("file_id").orderBy("offset")))
    return table.where("kind = 'n'").join(nexts, ["file_id", "offset"], "left").select("file_id", "num", "offset", "until")


def _at_their_places(files: DataFrame, need: DataFrame, places: DataFrame) -> DataFrame:
    """file_id, num, offset, the value and error of the needed numbers (file_id, num) that have places (file_id, num, offset, until).

    An object which doesn't end before the next one is read again to the end of the file; then one whose /Length is a reference, with
    the number that this means.
    """
    none = F.lit(None).cast("long")
    found = settled(_parsed(_cut(files, need.join(places, ["file_id", "num"]).withColumn("length", none))))
    found = _again(files, found, found.where("not closed").withColumns({"length": none, "until": none}))
    doubt = found.where("length_at is not null")
    named = doubt.select("file_id", F.col("length_at").alias("num")).distinct()
    ints = _parsed(_cut(files, named.join(places, ["file_id", "num"]).withColumn("length", none))).where("kind = 'int'")
    lengths = ints.select("file_id", F.col("num").alias("length_at"), F.decode("body", "ISO-8859-1").cast("long").alias("length"))
    return _again(files, found, doubt.join(lengths, ["file_id", "length_at"]).withColumn("until", none))


def _again(files: DataFrame, found: DataFrame, spans: DataFrame) -> DataFrame:
    """found, with those that spans has read anew."""
    spans = settled(spans.select("file_id", "num", "offset", "until", "length"))
    if not spans.limit(1).count():
        return found
    return found.join(spans.select("file_id", "num"), ["file_id", "num"], "left_anti").unionByName(settled(_parsed(_cut(files, spans))))


def lookup(files: DataFrame, wanted: DataFrame, password: str | DataFrame | None = None) -> DataFrame:
    """A row for each distinct (file_id, num) of wanted: file_id, num, gen, source, kind, body, entries, refs, raw, error.

    What a file doesn't define, or has marked free, is null, of source 'missing'; so is all of a file that isn't among files. A file
    whose chain can't be read, or that has another object than the table says where one that is needed should stand, is repaired
    whole, and what is asked of it taken from there. With a password, encrypted objects come in clear, as from `opened`; where it
    doesn't fit, kind is null and error says so. Rows of wanted with a null in them are left out.
    """
    asked = settled(wanted.where("file_id is not null and num is not null").select("file_id", F.col("num").cast("long").alias("num")).distinct())
    mine = files.select("file_id", "content").join(asked.select("file_id").distinct(), "file_id", "left_semi")
    entries = settled(sections(mine))
    table = settled(merged(entries))
    said = trailers(entries).where(F.col("trailer")["Encrypt"].isNotNull())
    packed = asked.join(table.where("kind = 'o'").select("file_id", "num", "strm"), ["file_id", "num"])
    need = asked.unionByName(packed.select("file_id", F.col("strm").alias("num")))
    if password is not None:
        need = need.unionByName(said.select("file_id", number(F.col("trailer")["Encrypt"]).alias("num")).where("num is not null"))
    read = settled(_at_their_places(mine, need.distinct(), settled(_until(table))))
    broken = entries.where("kind = 'e'").select("file_id").unionByName(read.where("error is not null").select("file_id")).distinct()
    broken = settled(broken)
    direct = read.where("error is null").withColumn("source", F.lit("direct")).select(*COLUMNS, "offset").join(broken, "file_id", "left_anti")
    shut = broken.select("file_id", F.lit(None).cast("string").alias("error")).limit(0)
    if password is not None:
        direct, locked = _in_clear(settled(direct), said.join(broken, "file_id", "left_anti"), password)
        shut = locked.where("error is not null").select("file_id", "error")
    inside = unpacked(direct).join(packed, ["file_id", "num", "strm"]).withColumns({"source": F.lit("packed"), "gen": F.lit(0).cast("long")})
    found = direct.select(COLUMNS).unionByName(inside.dropDuplicates(["file_id", "num"]).select(COLUMNS))
    found = found.join(shut.select("file_id"), "file_id", "left_anti")
    if broken.limit(1).count():
        mended, documents = opened(mine.join(broken, "file_id", "left_semi"), password)
        found = found.unionByName(mended.select(COLUMNS))
        shut = shut.unionByName(documents.where("root is null").select("file_id", "error"))
    given = asked.join(found, ["file_id", "num"], "left").join(shut, "file_id", "left")
    lost, none = F.col("source").isNull() & F.col("error").isNull(), F.col("source").isNull()
    refs = F.array().cast(found.schema["refs"].dataType)
    return given.select(
        "file_id", "num", F.coalesce("gen", F.lit(0).cast("long")).alias("gen"), F.when(none, "missing").otherwise(F.col("source")).alias("source"), F.when(lost, "null").otherwise(F.col("kind")).alias("kind"),
        F.when(lost, F.lit(b"null")).otherwise(F.col("body")).alias("body"), F.when(lost, F.create_map().cast("map<string,string>")).otherwise(F.col("entries")).alias("entries"), F.when(lost, refs).otherwise(F.col("refs")).alias("refs"), "raw",
        F.when(none, F.col("error")).alias("error"),
    )
