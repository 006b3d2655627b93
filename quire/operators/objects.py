"""Objects of PDF files as a relation: cross-reference chains, object streams, repair, trailers.

Only the bytes of one file, one object stream or one object are read by Python. Which of several objects of a number
counts, what a trailer says and which files need repair are joins and aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from quire.functions.filters import decode_streams
from quire.kernels import rows
from quire.plans.rounds import settled

VALUE = "kind: string, body: binary, entries: map<string, string>, refs: array<struct<key: string, ord: int, num: long, gen: long>>, raw: binary"
SCAN = f"num: long, gen: long, offset: long, end: long, {VALUE}, error: string"
SECTION = "seq int, kind string, num long, offset long, gen long, strm long, trailer map<string, string>, error string"
PACKED = f"num: long, index: int, {VALUE}"
TRAILER = "seq int, trailer map<string, string>"
COLUMNS = ["file_id", "num", "gen", "source", "kind", "body", "entries", "refs", "raw"]
#: Rows that go on together, of one file or of many, and the bytes that they may come to before.
BATCH, BATCH_BYTES = 2048, 1 << 22


def _column(values: list, kind):
    """An Arrow array of kind: structs are tuples, maps are dictionaries."""
    import pyarrow as pa

    def flat() -> tuple[list, list]:
        places, n = [], 0
        for v in values:
            places.append(None if v is None else n)
            n += len(v or ())
        return pa.array([*places, n], pa.int32()), [x for v in values if v for x in (v.items() if isinstance(v, dict) else v)]

    if pa.types.is_map(kind):
        places, inside = flat()
        return pa.MapArray.from_arrays(places, pa.array([k for k, _ in inside], kind.key_type), pa.array([v for _, v in inside], kind.item_type)).cast(kind)
    if pa.types.is_list(kind):
        places, inside = flat()
        return pa.ListArray.from_arrays(places, _column(inside, kind.value_type)).cast(kind)
    if pa.types.is_struct(kind):
        blank = (None,) * kind.num_fields
        parts = list(zip(*[blank if v is None else v for v in values], strict=True)) or [()] * kind.num_fields
        return pa.StructArray.from_arrays([_column(list(p), f.type) for p, f in zip(parts, kind, strict=True)], fields=list(kind), mask=pa.array([v is None for v in values], pa.bool_()))
    return pa.array(values, kind)


def _read(rows_in: DataFrame, keep: tuple[str, ...], *args: str, **parts) -> DataFrame:
    """The columns to keep and, for each of parts (a function of the args and the columns of its rows, tuples), a struct that is set in
    the rows which that part made. Every row is read once, and its rows go on as they are found."""
    kinds = {name: _parse_datatype_string(kind) for name, (_, kind) in parts.items()}
    schema = StructType([*[rows_in.schema[c] for c in keep], *[StructField(name, kind) for name, kind in kinds.items()]])
    run = {name: f for name, (f, _) in parts.items()}
    first, each = len(keep), len(args)

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            taken: list[int] = []
            made: dict[str, list] = {name: [] for name in run}
            size = 0

            def told(batch=batch):
                kept = [batch.column(k).take(pa.array(taken, pa.int32())).cast(arrow.field(k).type) for k in range(first)]
                out = pa.RecordBatch.from_arrays([*kept, *[_column(v, arrow.field(name).type) for name, v in made.items()]], schema=arrow)
                for some in (taken, *made.values()):
                    some.clear()
                return out

            for place in range(batch.num_rows):
                values = [batch.column(first + k)[place].as_py() for k in range(each)]
                for name, f in run.items():
                    own, others = made[name], [v for n, v in made.items() if n != name]
                    for row in f(*values):
                        taken.append(place)
                        own.append(row)
                        for v in others:
                            v.append(None)
                        size += sum([len(x) for x in row if x.__class__ is bytes])
                        if len(taken) == BATCH or size > BATCH_BYTES:
                            yield told()
                            size = 0
            if taken:
                yield told()

    return rows_in.select(*keep, *args).mapInArrow(read, schema)


def _objects(data: bytes | None) -> Iterator[tuple]:
    return rows.object_tuples(data or b"")


def _sections(data: bytes | None) -> list[tuple]:
    return rows.section_tuples(data or b"")


def _trailers(data: bytes | None) -> Iterator[tuple]:
    return rows.trailer_tuples(data or b"")


def scan(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Everything in a file that has an object header, whether or not the file still refers to it."""
    return _read(files, ("file_id", *keep), "content", o=(_objects, SCAN)).select("file_id", *keep, "o.*")


def sections(files: DataFrame) -> DataFrame:
    """Cross-reference entries ('n', 'f', 'o'), trailers ('t'), the header's version ('h') and errors ('e') by section, the newest first."""
    return _read(files, ("file_id",), "content", s=(_sections, SECTION)).select("file_id", "s.*")


def merged(entries: DataFrame) -> DataFrame:
    """One entry a number: that of the newest section which has the number."""
    newest = F.min_by(F.struct("kind", "offset", "gen", "strm"), "seq").alias("e")
    return entries.where("kind in ('n', 'f', 'o')").groupBy("file_id", "num").agg(newest).select("file_id", "num", "e.*")


def trailers(entries: DataFrame) -> DataFrame:
    """file_id, trailer: keys of all sections, of each the value in the newest that has it."""
    each = entries.where("kind = 't'").select("file_id", "seq", F.explode("trailer"))
    first = each.groupBy("file_id", "key").agg(F.min_by("value", "seq").alias("value"))
    return first.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("trailer"))


def ref_number(text: Column) -> Column:
    """The number in '12 0 R'; null for any other value."""
    return F.when(text.rlike(r"^\d+ \d+ R$"), F.regexp_extract(text, r"^(\d+)", 1).cast("long"))


def unpacked(streams: DataFrame) -> DataFrame:
    """file_id, strm and the members of object streams among objects."""
    only = streams.where("kind = 'stream' and entries['Type'] = '/ObjStm'").select("file_id", "num", "offset", "entries", "raw")
    whole = lambda key: F.when(F.col("entries")[key].rlike(r"^\d{1,9}$"), F.col("entries")[key].cast("long"))
    read = decode_streams(only).select("file_id", F.col("num").alias("strm"), F.col("offset").alias("strm_offset"), whole("First").alias("first"), whole("N").alias("count"), F.col("decoded.data").alias("data"))
    return _read(read, ("file_id", "strm", "strm_offset"), "first", "count", "data", x=(rows.packed_tuples, PACKED)).select("file_id", "strm", "strm_offset", "x.*")


def _by_table(found: DataFrame, entries: DataFrame, password: str | DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """What the cross-reference chain names, where an object of that number stands there; the files of which one stands elsewhere; and
    with a password, for which all is in clear before object streams are opened, the files' protection."""
    table = settled(merged(entries))
    named = table.where("kind = 'n' and offset > 0").select("file_id", "num", "offset")
    direct = found.where("error is null").join(named, ["file_id", "num", "offset"]).withColumn("source", F.lit("direct"))
    misplaced = named.join(found.select("file_id", "num", "offset"), ["file_id", "num", "offset"], "left_anti").select("file_id").distinct()
    locked = None
    if password is not None:
        direct, locked = _in_clear(direct, trailers(entries).where(F.col("trailer")["Encrypt"].isNotNull()), password)
    packed = unpacked(direct).join(table.where("kind = 'o'").select("file_id", "num", "strm"), ["file_id", "num", "strm"])
    packed = packed.withColumns({"source": F.lit("packed"), "gen": F.lit(0).cast("long")})
    return direct.select(COLUMNS).unionByName(packed.select(COLUMNS)), misplaced, locked


def _by_repair(found: DataFrame, spoken: DataFrame, password: str | DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """Without a table: of each number the last object in the file; members of the last object stream where no object stands directly.
    With a password, both in clear, and the protection of each file by its last trailer (file_id, seq, trailer) that tells of one."""
    value = F.struct("gen", "kind", "body", "entries", "refs", "raw", "offset")
    last = found.where("error is null").groupBy("file_id", "num").agg(F.max_by(value, "offset").alias("v")).select("file_id", "num", "v.*").withColumn("source", F.lit("repair"))
    last = settled(last)
    locked = None
    if password is not None:
        said = spoken.unionByName(_stream_trailers(last)).where(F.col("trailer")["Encrypt"].isNotNull())
        last, locked = _in_clear(last, said.groupBy("file_id").agg(F.min_by("trailer", "seq").alias("trailer")), password)
    inside = unpacked(last).groupBy("file_id", "num").agg(F.max_by(F.struct("kind", "body", "entries", "refs", "raw"), "strm_offset").alias("v")).select("file_id", "num", "v.*")
    inside = inside.join(last.select("file_id", "num"), ["file_id", "num"], "left_anti").withColumns({"source": F.lit("repair packed"), "gen": F.lit(0).cast("long")})
    return last.select(COLUMNS).unionByName(inside.select(COLUMNS)), locked


def _stream_trailers(objects: DataFrame) -> DataFrame:
    """file_id, seq, trailer: dictionaries of cross-reference streams, behind all trailers found by their keyword."""
    return objects.where("entries['Type'] = '/XRef'").select("file_id", (F.lit(1 << 40) - F.col("num")).alias("seq"), F.col("entries").alias("trailer"))


def _in_clear(objects: DataFrame, said: DataFrame, password: str | DataFrame) -> tuple[DataFrame, DataFrame]:
    """objects decrypted, and the protection of the files, whose trailers said has."""
    from quire.operators import security  # which is built on this module

    locked = settled(security.protection(said, objects, password))
    return settled(security.decrypted(objects, locked)), locked


def _made_up(mended: DataFrame, lost: DataFrame) -> DataFrame:
    """The last resort for files without a catalogue: a tree of all their page objects (number one above the highest) and a
    catalogue over it (two above)."""
    of = mended.join(lost.select("file_id"), "file_id", "left_semi")
    kept = F.array_sort(F.collect_list(F.when(F.col("entries")["Type"] == "/Page", F.col("num"))))
    kids = of.groupBy("file_id").agg(kept.alias("k"), F.max("num").alias("high")).where("size(k) > 0")
    spelled = F.array_join(F.transform("k", lambda n: F.concat(n.cast("string"), F.lit(" 0 R"))), " ")
    ref = lambda key, ord_, n: F.struct(F.lit(key).alias("key"), ord_.cast("int").alias("ord"), n.alias("num"), F.lit(0).cast("long").alias("gen"))
    tree = F.create_map(F.lit("Type"), F.lit("/Pages"), F.lit("Count"), F.size("k").cast("string"), F.lit("Kids"), F.concat(F.lit("["), spelled, F.lit("]")))
    top = F.create_map(F.lit("Type"), F.lit("/Catalog"), F.lit("Pages"), F.concat((F.col("high") + 1).cast("string"), F.lit(" 0 R")))
    body = lambda e: F.encode(F.concat(F.lit("<<"), F.array_join(F.transform(F.map_entries(e), lambda x: F.concat(F.lit("/"), x["key"], F.lit(" "), x["value"])), ""), F.lit(">>")), "ISO-8859-1")
    both = F.array(
        F.struct((F.col("high") + 1).alias("num"), tree.alias("entries"), body(tree).alias("body"), F.transform("k", lambda n, i: ref("Kids", i, n)).alias("refs")),
        F.struct((F.col("high") + 2).alias("num"), top.alias("entries"), body(top).alias("body"), F.array(ref("Pages", F.lit(0), F.col("high") + 1)).alias("refs")),
    )
    new = kids.select("file_id", F.explode(both).alias("x")).select("file_id", "x.*")
    return new.withColumns({"gen": F.lit(0).cast("long"), "source": F.lit("made up"), "kind": F.lit("dict"), "raw": F.lit(None).cast("binary")}).select(COLUMNS)


def opened(files: DataFrame, password: str | DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(objects, documents): the objects that count, and file_id, trailer, root (number of the catalogue), version, repaired, error.

    A file whose chain can't be read, names a place at which its object does not stand, or leads to no catalogue, is
    repaired: its objects are those that a scan finds, and its root comes from the last trailer that names a catalogue, else
    from cross-reference streams, else it is the highest-numbered catalogue, else one made up over its pages. A file
    without any has root null and an error.

    With a password, one for all files or (file_id, password), encrypted files come out in clear: their protection is found first, then
    streams and strings are decrypted, and only then object streams opened, in repair too. An encrypted file that it doesn't fit has
    root null and says so in its error. Without one, nothing is decrypted.
    """
    # each file is read once, whatever is asked of it later
    both = settled(_read(files, ("file_id",), "content", o=(_objects, SCAN), s=(_sections, SECTION), t=(_trailers, TRAILER)))
    found, entries = both.where("o is not null").select("file_id", "o.*"), both.where("s is not null").select("file_id", "s.*")
    table, misplaced, locked = _by_table(found, entries, password)
    table = settled(table)
    catalogues = lambda o: o.where("entries['Type'] = '/Catalog' or entries['Pages'] is not null").select("file_id", F.col("num").alias("root"))
    said = trailers(entries).withColumn("root", ref_number(F.col("trailer")["Root"]))
    broken = entries.where("kind = 'e'").groupBy("file_id").agg(F.first("error").alias("cause"))
    broken = broken.unionByName(misplaced.withColumn("cause", F.lit("an object is not where the table has it"))).groupBy("file_id").agg(F.min("cause").alias("cause"))
    shut = None
    if locked is not None:
        shut = locked.where("error is not null").select("file_id", "error")
        said = said.join(shut.select("file_id"), "file_id", "left_anti")
    head = entries.where("kind = 'h'").select("file_id", F.col("trailer")["Version"].alias("version"))
    whole = said.join(broken, "file_id", "left_anti").join(catalogues(table), ["file_id", "root"], "left_semi").withColumn("repaired", F.lit(False))
    whole = settled(whole.select("file_id", "trailer", "root", "repaired"))
    rest = settled(both.select("file_id").distinct().join(whole.select("file_id"), "file_id", "left_anti"))
    if not rest.limit(1).count():
        return table.join(whole.select("file_id"), "file_id", "left_semi") if locked is not None else table, whole.withColumns({"error": F.lit(None).cast("string"), "cause": F.lit(None).cast("string")}).join(head, "file_id", "left")
    spoken = both.where("t is not null").select("file_id", "t.*").join(rest, "file_id", "left_semi")
    mended, locked = _by_repair(found.join(rest, "file_id", "left_semi"), spoken, password)
    mended = settled(mended)
    if locked is not None:
        shut = shut.unionByName(locked.where("error is not null").select("file_id", "error")).groupBy("file_id").agg(F.first("error").alias("error"))
        mended = mended.join(shut.select("file_id"), "file_id", "left_anti")
        spoken = spoken.join(shut.select("file_id"), "file_id", "left_anti")
    streams = _stream_trailers(mended)
    guess = catalogues(mended).select("file_id", (F.lit(1 << 50) - F.col("root")).alias("seq"), F.create_map(F.lit("Root"), F.concat(F.col("root").cast("string"), F.lit(" 0 R"))).alias("trailer"))
    every = spoken.unionByName(streams).unionByName(guess).withColumn("root", ref_number(F.col("trailer")["Root"]))
    good = every.join(catalogues(mended), ["file_id", "root"], "left_semi")
    best = settled(good.groupBy("file_id").agg(F.min_by(F.struct("trailer", "root"), "seq").alias("b")).select("file_id", "b.*"))
    more = settled(_made_up(mended, rest.join(best, "file_id", "left_anti")))
    none = F.lit(None).cast("map<string,string>")
    best = best.unionByName(more.where("entries['Type'] = '/Catalog'").select("file_id", none.alias("trailer"), F.col("num").alias("root")))
    fixed = rest.join(best, "file_id", "left").withColumn("repaired", F.lit(True))
    documents = whole.select("file_id", "trailer", "root", "repaired").unionByName(fixed.select("file_id", "trailer", "root", "repaired"))
    if shut is None:
        shut = broken.select("file_id", F.lit(None).cast("string").alias("error")).limit(0)
    documents = documents.join(broken, "file_id", "left").join(head, "file_id", "left").join(shut, "file_id", "left")
    documents = documents.select("file_id", "trailer", "root", "repaired", F.when(F.col("root").isNull(), F.coalesce("error", "cause", F.lit("no catalogue"))).alias("error"), "cause", "version")
    objects = table.join(whole.select("file_id"), "file_id", "left_semi").unionByName(mended).unionByName(more)
    return objects, settled(documents)


def resolved(objects: DataFrame, most: int = 64) -> DataFrame:
    """objects in which one that is only a reference to another has that one's value; at most `most` steps, then null."""
    chased = objects.where("kind = 'ref'").select("file_id", "num", F.col("refs")[0]["num"].alias("to"))
    plain = objects.where("kind != 'ref'")
    for _ in range(most):
        if not chased.limit(1).count():
            break
        target = objects.select("file_id", F.col("num").alias("to"), "gen", "source", "kind", "body", "entries", "refs", "raw")
        step = settled(chased.join(target, ["file_id", "to"], "left"))
        plain = plain.unionByName(step.where("kind is null or kind != 'ref'").select(COLUMNS))
        chased = step.where("kind = 'ref'").select("file_id", "num", F.col("refs")[0]["num"].alias("to"))
    return plain


def inlined(objects: DataFrame, *keys: str) -> DataFrame:
    """objects whose entries under the given keys are values: a reference there gives way to what stands at its end, spelled,
    unless that is a stream, which only a reference can name. A reference to nothing is null."""
    asked = objects.select("file_id", "num", F.explode(F.map_filter("entries", lambda k, v: k.isin(*keys) & v.rlike(r"^\d+ \d+ R$"))).alias("key", "value"))
    asked = settled(asked.select("file_id", "num", "key", ref_number(F.col("value")).alias("to")))
    if not asked.limit(1).count():
        return objects
    on_the_way = objects.where("kind = 'ref'").select("file_id", F.col("refs")[0]["num"].alias("to"))
    wanted = asked.select("file_id", "to").unionByName(on_the_way).distinct()
    ends = objects.where("kind = 'ref'").unionByName(objects.where("kind != 'ref'").join(wanted.withColumnRenamed("to", "num"), ["file_id", "num"], "left_semi").withColumn("raw", F.lit(None).cast("binary")))
    ends = resolved(settled(ends)).select("file_id", F.col("num").alias("to"), "kind", F.decode("body", "ISO-8859-1").alias("text"))
    told = asked.join(ends, ["file_id", "to"], "left").where("kind is null or kind != 'stream'")
    told = told.groupBy("file_id", "num").agg(F.map_from_entries(F.collect_list(F.struct("key", F.coalesce("text", F.lit("null")).alias("value")))).alias("told"))
    both = objects.join(told, ["file_id", "num"], "left")
    swapped = F.transform_values("entries", lambda k, v: F.coalesce(F.col("told")[k], v))
    return both.withColumn("entries", F.when(F.col("told").isNull(), F.col("entries")).otherwise(swapped)).select(*objects.columns)
