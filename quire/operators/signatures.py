"""Signature fields, their byte ranges and the bytes that they sign."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.kernels.syntax import parse
from quire.operators.objects import ref_number
from quire.plans.rounds import settled

DEEPEST = 32
#: The keys of a signature dictionary that are handed on, by column.
CLAIMS = {"filter": "Filter", "sub_filter": "SubFilter", "signer": "Name", "reason": "Reason", "location": "Location", "signed_at": "M"}


def range_verdict(r: Column, length: Column) -> Column:
    """'ok', or why two spans with a gap, as [offset, length, offset, length], can't be what a signature covers."""
    a, b, c, d = (F.get(r, F.lit(k)) for k in range(4))
    return (
        F.when(r.isNull() | (F.size(r) != 4), "not four numbers")
        .when(a != 0, "does not start at the start")
        .when(b <= 0, "first span empty or negative")
        .when(c <= b, "second span before the end of the first")
        .when(c - b < 2, "no gap")
        .when(d < 0, "second span negative")
        .when((c > length) | (d > length - c), "past the end")
        .otherwise("ok")
    )


def signed_bytes(content: Column, r: Column) -> Column:
    """The two spans in one."""
    part = lambda k: F.substring(content, (F.get(r, F.lit(k)) + 1).cast("int"), F.get(r, F.lit(k + 1)).cast("int"))
    return F.concat(part(0), part(2))


def gap_bytes(content: Column, r: Column) -> Column:
    """What the hex string in the gap holds, without zeros that pad it after its DER length; null if it is none."""
    gap = F.substring(content, (F.get(r, F.lit(1)) + 1).cast("int"), (F.get(r, F.lit(2)) - F.get(r, F.lit(1))).cast("int"))

    def read(raw: bytes | None) -> bytes | None:
        import re

        m = re.fullmatch(rb"[\x00\t\n\x0c\r ]*<([^<>]*)>[\x00\t\n\x0c\r ]*", bytes(raw or b""))
        digits = re.sub(rb"[\x00\t\n\x0c\r ]", b"", m[1]) if m else None
        if digits is None or re.search(rb"[^0-9A-Fa-f]", digits):
            return None
        out = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if len(out) > 2 and out[0] == 0x30:
            n = out[1] & 127 if out[1] > 128 else 0
            end = 2 + n + (int.from_bytes(out[2 : 2 + n], "big") if n else out[1])
            if end <= len(out) and not out[end:].strip(b"\0"):
                return out[:end]
        return out

    return F.udf(read, "binary", useArrow=True)(gap)


def fields(objects: DataFrame, documents: DataFrame) -> DataFrame:
    """file_id, name, value: form fields of type /Sig with the number of their signature dictionary.

    Names join with dots from the root; type and value go down to kids that have none; a field above itself ends there.
    """
    nodes = objects.select("file_id", "num", "entries", F.filter("refs", lambda r: r["key"].isin("Kids", "Fields")).alias("down"))
    form = documents.join(nodes.withColumnRenamed("num", "root"), ["file_id", "root"]).select("file_id", ref_number(F.col("entries")["AcroForm"]).alias("num"))
    top = form.join(nodes, ["file_id", "num"]).select("file_id", F.explode("down").alias("r")).select("file_id", F.col("r.num").alias("num"))
    none = F.lit(None).cast("string")
    level = top.select("file_id", "num", F.lit("").alias("prefix"), none.alias("ft"), none.alias("v"), F.array().cast("array<long>").alias("above"))
    out = None
    for _ in range(DEEPEST):
        seen = level.join(nodes, ["file_id", "num"])
        name = F.udf(lambda t: parse(t.encode("latin-1"))[0].decode("latin-1") if t else "", "string", useArrow=True)(F.col("entries")["T"])
        seen = seen.withColumn("own", name).withColumn("prefix", F.concat_ws(".", F.when(F.col("prefix") != "", F.col("prefix")), F.when(F.col("own") != "", F.col("own"))))
        seen = settled(seen.withColumns({"ft": F.coalesce(F.col("entries")["FT"], F.col("ft")), "v": F.coalesce(F.col("entries")["V"], F.col("v"))}))
        ends = seen.where("ft = '/Sig' and v is not null and size(down) = 0").select("file_id", F.col("prefix").alias("name"), ref_number(F.col("v")).alias("value"))
        out = ends if out is None else out.unionByName(ends)
        level = seen.select("file_id", F.explode("down").alias("r"), "prefix", "ft", "v", F.concat("above", F.array("num")).alias("above")).select("file_id", F.col("r.num").alias("num"), "prefix", "ft", "v", "above").where("not array_contains(above, num)")
        if not level.limit(1).count():
            break
    return out.distinct()


def signatures(files: DataFrame, objects: DataFrame, documents: DataFrame) -> DataFrame:
    """file_id, name, byte_range, verdict, covers_whole_file, signed (the bytes), contents (from the gap), and the claims as spelled; claims are null unless the verdict is ok."""
    held = fields(objects, documents).join(objects.select("file_id", F.col("num").alias("value"), "entries"), ["file_id", "value"]).join(files.select("file_id", "content"), "file_id")
    spelled = F.col("entries")["ByteRange"]
    each = F.split(F.regexp_replace(spelled, r"^\[|\]$", ""), " ")
    r = F.when(spelled.rlike(r"^\[[-0-9 ]*+\]$") & F.forall(each, lambda x: x.rlike(r"^-?\d+$") | (x == "")), F.transform(F.filter(each, lambda x: x != ""), lambda x: x.try_cast("long")))
    r = F.when(~F.exists(r, lambda x: x.isNull()), r)
    out = held.withColumn("byte_range", r).withColumn("length", F.octet_length("content").cast("long")).withColumn("verdict", range_verdict(F.col("byte_range"), F.col("length")))
    ok = F.col("verdict") == "ok"
    claims = [F.when(ok, F.col("entries")[key]).alias(column) for column, key in CLAIMS.items()]
    return out.select("file_id", "name", "byte_range", "verdict", (ok & (F.get("byte_range", F.lit(2)) + F.get("byte_range", F.lit(3)) == F.col("length"))).alias("covers_whole_file"), F.when(ok, signed_bytes(F.col("content"), F.col("byte_range"))).alias("signed"), F.when(ok, gap_bytes(F.col("content"), F.col("byte_range"))).alias("contents"), *claims)


def bound(gaps: DataFrame, ends: DataFrame) -> DataFrame:
    """The rows of gaps (file_id, offset, gap_start, signed_end and more) with binding: whether the gap lies in the object at
    offset, by the first 'endobj' (file_id, at) from offset on and the first from the gap on.

    'outside' if the object ends before the gap, 'tail not signed' if no end of it lies in the signed bytes, else 'bound'.
    """
    marked = settled(gaps.withColumn("_gap", F.monotonically_increasing_id()))
    asked = marked.select("file_id", "_gap", F.explode(F.array(F.struct(F.col("offset").alias("at"), F.lit(0).alias("which")), F.struct(F.col("gap_start").alias("at"), F.lit(1).alias("which")))).alias("a"))
    asked = asked.select("file_id", "a.at", "_gap", "a.which")
    none = F.lit(None)
    every = ends.select("file_id", F.col("at").cast("long").alias("at"), none.cast("long").alias("_gap"), none.cast("int").alias("which")).unionByName(asked)
    ahead = Window.partitionBy("file_id").orderBy(F.col("at").desc(), F.col("_gap").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = every.withColumn("next", F.min(F.when(F.col("_gap").isNull(), F.col("at"))).over(ahead)).where("_gap is not null")
    first = found.groupBy("file_id", "_gap").agg(*[F.max(F.when(F.col("which") == k, F.col("next"))).alias(n) for k, n in enumerate(("_end", "_tail"))])
    outside = (F.col("offset") < 0) | (F.col("offset") > F.col("gap_start")) | F.coalesce(F.col("_end") + 6 <= F.col("gap_start"), F.lit(False))
    verdict = F.when(outside, "outside").when(F.col("_tail").isNull() | (F.col("_tail") > F.col("signed_end")), "tail not signed").otherwise("bound")
    return marked.join(first, ["file_id", "_gap"]).withColumn("binding", verdict).drop("_gap", "_end", "_tail")


#: Distinct signatures and signed bytes that are verified in a file.
MOST, MOST_BYTES = 64, 1 << 30


def budgeted(found: DataFrame, most: int = MOST, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The rows of found (file_id, seq, sub_filter, byte_range, contents and more) with same (the seq of the first row with
    equal sub_filter, ranges and contents) and allowed: whether that one lies within a file's budget, spent in the order of seq.
    """
    key = F.sha2(F.concat_ws("|", F.coalesce("sub_filter", F.lit("")), F.concat_ws(",", F.transform("byte_range", lambda x: x.cast("string"))), F.sha2("contents", 256)), 256)
    keyed = found.withColumn("_key", key)
    size = F.get("byte_range", F.lit(1)) + F.get("byte_range", F.lit(3))
    once = keyed.groupBy("file_id", "_key").agg(F.min("seq").alias("same"), F.first(size).alias("size"))
    queue = once.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("same", "size"))).alias("q"))
    start = F.struct(F.lit(0).cast("long").alias("spent"), F.array().cast("array<bigint>").alias("ok"))
    fits = lambda s, x: (F.size(s["ok"]) < most) & (x["size"] <= F.lit(most_bytes) - s["spent"])
    step = lambda s, x: F.when(fits(s, x), F.struct((s["spent"] + x["size"]).alias("spent"), F.concat(s["ok"], F.array(x["same"])).alias("ok"))).otherwise(s)
    told = queue.select("file_id", F.aggregate("q", start, step)["ok"].alias("_ok"))
    return keyed.join(once.drop("size"), ["file_id", "_key"]).join(told, "file_id").withColumn("allowed", F.array_contains("_ok", F.col("same"))).drop("_key", "_ok")
