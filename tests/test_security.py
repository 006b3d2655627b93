from pyspark.sql import functions as F
from quire.kernels import legacy_crypt as crypt
from quire.kernels.syntax import parse
from quire.operators import graph, linear, objects, pages, security


def test_rc4_vectors():
    assert crypt.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    assert crypt.rc4(b"Wiki", b"pedia").hex() == "1021bf0420"


def test_passwords():
    for revision, size in ((2, 5), (3, 16), (4, 16)):
        owner = crypt.owner_entry(b"boss", b"guest", revision, size)
        key = crypt.file_key(b"guest", owner, -44, b"id", revision, size)
        user = crypt.user_entry(key, b"id", revision)
        unlock = lambda p: crypt.unlocked(p, owner, user, -44, b"id", revision, size, True)  # noqa: B023, E731
        assert unlock(b"guest") == (key, False) and unlock(b"boss") == (key, True) and unlock(b"other") is None


def test_protection_and_refusals(spark):
    body = b"""1 0 obj <</Type/Catalog/Pages 2 0 R/AcroForm 9 0 R>> endobj 2 0 obj <</Type/Pages/Kids[3 0 R 4 0 R]>> endobj
3 0 obj <</Type/Page/Font 5 0 R>> endobj 4 0 obj <</Type/Page/Font 5 0 R/Own 6 0 R/Parent 2 0 R>> endobj 5 0 obj <<>> endobj 6 0 obj 7 endobj
8 0 obj <</Filter/Other/V 1/R 2>> endobj trailer <</Root 1 0 R/Encrypt 8 0 R>>"""
    files = spark.createDataFrame([("a", bytearray(body)), ("b", bytearray(body.replace(b"/AcroForm 9 0 R", b"").replace(b"/Encrypt 8 0 R", b"")))], "file_id string, content binary")
    objs, documents = objects.opened(files)
    assert {(r.file_id, r.error) for r in security.protection(documents, objs).collect()} == {("a", "not the standard handler"), ("b", None)}
    assert {(r.file_id, r.reason) for r in security.refusal(objs, documents).collect()} == {("a", "Encrypt"), ("b", None)}
    found = pages.pages(objs, documents)
    placed = graph.partition(graph.reach(found, objs), objs, documents)
    assert {(r.num, r.part) for r in placed.where("file_id = 'b'").collect()} == {(1, 4), (2, 9), (3, 6), (4, 7), (5, 6), (6, 7), (8, 9)}
    laid = graph.layout(placed, found).where("file_id = 'b'")
    assert [r.num for r in laid.orderBy("new_num").collect()] == [1, 3, 5, 4, 6, 2, 8]
    assert {(r.num, r.identifier) for r in graph.shared_identifiers(laid).collect()} == {(3, 0), (5, 1)}
    lengths = linear.page_lengths(laid, objs.select("file_id", "num", (F.col("num") * 10).alias("extent")))
    row = linear.hint_columns(lengths).first()
    assert (row.least_objects, row.object_bits, row.least_bytes, row.byte_bits, bytes(row.bytes)) == (2, 1, 80, 5, bytes([0b00000101, 0]))


def test_bit_fields(spark):
    df = spark.createDataFrame([([9, 0, 502],), ([512, 0, 0],)], "v array<long>")
    got = [r.p for r in df.select(linear.packed_bits(F.col("v"), 9).alias("p")).collect()]
    assert bytes(got[0]) == bytes([0b00000100, 0b10000000, 0b00111110, 0b11000000]) and got[1] is None


def test_streams_that_stay_and_odd_padding(spark):
    """Padding that can't be padding is kept; a leading Crypt filter exempts a stream."""
    key = b"0123456789abcdef"
    data = spark.createDataFrame([(5, bytearray(b"whole text")), (6, bytearray(b"x" * 32))], "num long, b binary")
    sealed = data.select("num", F.aes_encrypt("b", security.object_key(F.lit(key), F.col("num"), F.lit(0), F.lit("aes")), F.lit("CBC"), F.lit("PKCS"), F.lit(bytes(range(16)))).alias("raw"))
    # without the last block, what is left ends in letters, not in padding
    sealed = sealed.withColumn("raw", F.when(F.col("num") == 6, F.substring("raw", F.lit(1), F.lit(48))).otherwise(F.col("raw")))
    rows = sealed.unionByName(spark.createDataFrame([(7, bytearray(b"in clear"))], "num long, raw binary"))
    entries = F.when(F.col("num") == 7, F.create_map(F.lit("Filter"), F.lit("[/Crypt/AHx]"))).otherwise(F.create_map().cast("map<string,string>"))
    objs = rows.select(F.lit("a").alias("file_id"), "num", F.lit(0).cast("long").alias("gen"), F.lit("direct").alias("source"), F.lit("stream").alias("kind"), F.lit(b"<<>>").alias("body"), entries.alias("entries"), F.array().alias("refs"), "raw")
    how = spark.createDataFrame([("a", 9, bytearray(key), "aes")], "file_id string, encrypt_num long, key binary, method string")
    assert {r.num: bytes(r.raw) for r in security.decrypted(objs, how).collect()} == {5: b"whole text", 6: b"x" * 32, 7: b"in clear"}


def sealed_file(strf=b"/StdCF", ref=True):
    """A small file under RC4 of revision 4 with strings at several depths; its dictionary an object or in the trailer."""
    from hashlib import md5

    owner = crypt.owner_entry(b"boss", b"guest", 4, 16)
    key = crypt.file_key(b"guest", owner, -44, b"id", 4, 16)
    rc4 = lambda num, b: crypt.rc4(md5(key + num.to_bytes(3, "little") + b"\0\0").digest()[:16], b)
    text = lambda num, b: b"<" + (b if strf == b"/Identity" else rc4(num, b)).hex().encode() + b">"
    lock = b"<</Filter/Standard/V 4/R 4/Length 128/P -44/O<%b>/U<%b>/CF<</StdCF<</CFM/V2>>>>/StmF/StdCF/StrF%b>>" % (owner.hex().encode(), (crypt.user_entry(key, b"id", 4) + bytes(16)).hex().encode(), strf)
    data = rc4(5, b"BT (x) Tj ET")
    objs = {
        1: b"<</Type/Catalog/Pages 2 0 R/Lang%b>>" % text(1, b"en(us"),
        2: b"<</Type/Pages/Kids[3 0 R]/Count 1>>",
        3: b"<</Type/Page/Parent 2 0 R/Contents 5 0 R/A[<</B[%b 7]>>()]>>" % text(3, b"deep \\)"),
        4: text(4, b"alone"),
        5: b"<</Length %d/T%b>>\nstream\n%b\nendstream" % (len(data), text(5, b"of a stream"), data),
    }
    if ref:
        objs[6] = lock
    out, places = bytearray(b"%PDF-1.6\n"), {}
    for num, body in objs.items():
        places[num] = len(out)
        out += b"%d 0 obj\n%b\nendobj\n" % (num, body)
    at = len(out)
    out += b"xref\n" + b"".join(b"%d 1\n%010d 00000 n \n" % x for x in places.items())
    return bytes(out + b"trailer\n<</Root 1 0 R/Encrypt %b/ID[<6964><6964>]>>\nstartxref\n%d\n%%%%EOF\n" % (b"6 0 R" if ref else lock, at))


def test_strings_and_streams_by_their_own_filters(spark):
    cases = {"both": sealed_file(), "trailer": sealed_file(ref=False), "strings plain": sealed_file(b"/Identity"), "repaired": sealed_file().replace(b"startxref", b"startxxxx"), "shut": sealed_file(), "shut and repaired": sealed_file(ref=False).replace(b"startxref", b"startxxxx")}
    files = spark.createDataFrame(list(cases.items()), "file_id string, content binary")
    keys = spark.createDataFrame([(n, "other" if "shut" in n else "boss" if n == "both" else "guest") for n in cases], "file_id string, password string")
    objs, documents = objects.opened(files, keys)
    said = {r.file_id: (r.root, r.repaired, r.error) for r in documents.collect()}
    assert said == {"both": (1, False, None), "trailer": (1, False, None), "strings plain": (1, False, None), "repaired": (1, True, None), "shut": (None, True, "wrong password"), "shut and repaired": (None, True, "wrong password")}
    got = {(r.file_id, r.num): r for r in objs.collect()}
    assert {f for f, _ in got} == {n for n in cases if "shut" not in n}
    for n in ("both", "trailer", "strings plain", "repaired"):
        value = lambda num: parse(bytes(got[n, num].body))[0]  # noqa: B023, E731
        assert value(1)["Lang"] == b"en(us" and value(3)["A"] == [{"B": [b"deep \\)", 7]}, b""] and value(4) == b"alone"
        assert parse(got[n, 3].entries["A"].encode("latin-1"))[0] == value(3)["A"] and parse(got[n, 5].entries["T"].encode("latin-1"))[0] == b"of a stream"
        assert bytes(got[n, 5].raw) == b"BT (x) Tj ET"
    assert value(2)["Count"] == 1 and pages.contents(pages.pages(objs, documents), objs).where("content = x'42542028782920546a204554'").count() == 4


def test_files_without_encryption_open_with_any_password(spark):
    plain = b"1 0 obj <</Type/Catalog/Pages 2 0 R/S(text)>> endobj 2 0 obj <</Type/Pages/Kids[]>> endobj trailer <</Root 1 0 R>>"
    objs, documents = objects.opened(spark.createDataFrame([("a", plain), ("b", b""), ("c", None)], "file_id string, content binary"), "secret")
    assert {(r.num, r.entries.get("S")) for r in objs.collect()} == {(1, "(text)"), (2, None)}
    assert {(r.file_id, r.root) for r in documents.collect()} >= {("a", 1)}
