"""Single objects by number: lengths by reference, places inside of objects, wrong places, free numbers, files that are none, locked ones."""

from pyspark.sql import functions as F
from quire.operators import lookup, objects, security, sink

TRAP = b"a endstream endobj z"
PARTS = {1: b"<</Pages 2 0 R/Type/Catalog>>", 2: b"<</Count 0/Kids[]/Type/Pages>>", 3: b"<</Length 4 0 R>>\nstream\n" + TRAP + b"\nendstream", 4: b"20", 5: b"(five)"}


def made(moved: dict | None = None, extra: str = "") -> bytes:
    out, at = bytearray(b"%PDF-1.7\n"), {}
    for n, body in PARTS.items():
        at[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    at |= {n: at[k] + d for n, (k, d) in (moved or {}).items()}
    start = len(out)
    lines = "".join(f"{n} 1\n{at[n]:010d} 00000 n \n" for n in sorted(at))
    out += f"xref\n0 1\n0000000000 65535 f \n6 1\n0000000000 00001 f \n{lines}trailer\n<</Root 1 0 R/Size 10{extra}>>\nstartxref\n{start}\n%%EOF\n".encode()
    return bytes(out)


def asked(spark, *pairs):
    return spark.createDataFrame(list(pairs), "file_id string, num long")


def test_whole_inside_and_misplaced(spark):
    files = spark.createDataFrame([("good", made()), ("inside", made({9: (3, 30)})), ("moved", made({5: (4, 0)})), ("none", b"no file"), ("empty", b""), ("null", None)], "file_id string, content binary")
    names = ["good", "inside", "moved", "none", "empty", "null", "absent"]
    pairs = [(f, n) for f in names for n in (1, 3, 5, 6, 7)] * 2 + [("good", None), (None, 1)]
    got = {(r.file_id, r.num): r for r in lookup.lookup(files, asked(spark, *pairs)).collect()}
    assert sorted(got) == sorted(set(pairs[:-2]))
    for f, where in (("good", "direct"), ("inside", "direct"), ("moved", "repair")):
        assert bytes(got[f, 3].raw) == TRAP and bytes(got[f, 5].body) == b"(five)"
        assert got[f, 1].entries["Type"] == "/Catalog" and {got[f, n].source for n in (1, 3, 5)} == {where}
        assert [got[f, n].kind for n in (6, 7)] == ["null", "null"] and bytes(got[f, 7].body) == b"null"
    assert {got[f, n].kind for f in ("none", "empty", "null") for n in (1, 7)} == {None} and got["none", 1].error
    assert got["absent", 1].source == "missing" and got["absent", 1].error is None


def test_only_files_that_need_it_are_read_whole(spark):
    files = spark.createDataFrame([("f", made({2: (1, 1)}))], "file_id string, content binary")
    # the tree isn't where the table has it, which nobody asks for
    assert lookup.lookup(files, asked(spark, ("f", 5))).first().source == "direct"
    assert lookup.lookup(files, asked(spark, ("f", 2))).first().source == "repair"


def test_empty_and_extra_columns(spark):
    files = spark.createDataFrame([("f", made(), 1)], "file_id string, content binary, num int")
    assert lookup.lookup(files, asked(spark, ("f", 5)).limit(0)).count() == 0
    wanted = asked(spark, ("f", 5)).withColumn("content", F.lit("x"))
    assert bytes(lookup.lookup(files, wanted).first().body) == b"(five)"


def test_locked(spark):
    who = spark.createDataFrame([("f", "secret", "owner")], "file_id string, user string, owner string")
    objs = spark.createDataFrame([("f", 1, b"<</Pages 2 0 R/Type/Catalog>>", None), ("f", 2, b"<</Count 0/Kids[]/Type/Pages>>", None), ("f", 3, b"<</T(clear)>>", None)], "file_id string, num long, body binary, raw binary")
    files = locked_files(spark, objs, who)
    whole = {r.num: bytes(r.body) for r in objects.opened(files, "secret")[0].collect()}
    one = lookup.lookup(files, asked(spark, ("f", 3)), "secret").first()
    assert bytes(one.body) == whole[3] and b"clear" in bytes.fromhex(bytes(one.body).split(b"<")[-1].split(b">")[0].decode())
    shut = lookup.lookup(files, asked(spark, ("f", 3)), "wrong").first()
    assert shut.kind is None and shut.error


def locked_files(spark, objs, who):
    locks = security.locks(who.select("file_id", "user", "owner", F.lit(-4).alias("rights"), F.lit(True).alias("strings")))
    sealed = security.encrypted(objs, locks)
    own = locks.select("file_id", F.lit(9).cast("long").alias("num"), F.encode("dictionary", "ISO-8859-1").alias("body"), F.lit(None).cast("binary").alias("raw"))
    ident = F.concat(F.lit("<"), F.hex("ident"), F.lit(">"))
    root = locks.select("file_id", F.lit(1).alias("root"), F.concat(F.lit("/Encrypt 9 0 R/ID["), ident, ident, F.lit("]")).alias("more"))
    return sink.write_plain(sealed.unionByName(own), root)
