"""Encrypted files: setting up, keys of objects, decryption and encryption of streams and strings (revisions 2 to 4).

Python finds one key a file. Keys of objects are digests that Catalyst computes, and AES is its own; only RC4 is Python's. Strings are
reached at any depth as leaves of their objects' values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.filters import filter_names, filter_parms, permissions
from quire.functions.values import to_bytes
from quire.kernels import legacy_crypt as kernel
from quire.kernels.syntax import Name, PdfError, format_value, parse
from quire.operators.leaves import leaves, spelled
from quire.operators.objects import ref_number

SETUP = "struct<key: binary, method: string, string_method: string, revision: int, rights: long, as_owner: boolean, error: string>"


def _method(e: dict, which: str) -> str:
    """rc4, aes or none: what the crypt filter does that /StmF or /StrF names."""
    name = e.get(which, Name("Identity"))
    chosen = (e.get("CF") or {}).get(name, {}) if name != "Identity" else {"CFM": Name("None")}
    found = {"V2": "rc4", "AESV2": "aes", "None": "none"}.get(str(chosen.get("CFM", "None")))
    if found is None:
        raise PdfError("unknown crypt filter")
    return found


def _set_up(spelled: str | None, first_id: str | None, password: str | None) -> dict:
    blank = {"key": None, "method": None, "string_method": None, "revision": None, "rights": None, "as_owner": None, "error": None}
    if spelled is None:
        return blank | {"method": "none", "string_method": "none"}
    try:
        e = parse(spelled.encode("latin-1"))[0]
        v, r = e.get("V"), e.get("R")
        if e.get("Filter") != "Standard" or not isinstance(v, int) or not isinstance(r, int):
            raise PdfError("not the standard handler")
        if r not in (2, 3, 4):
            raise PdfError(f"revision {r} is not supported")
        methods, bits = ("rc4", "rc4"), e.get("Length", 40)
        if v >= 4:
            methods, bits = (_method(e, "StmF"), _method(e, "StrF")), 128
        if not isinstance(bits, int) or bits % 8 or not 40 <= bits <= 256:
            bits = 40
        size = 5 if r == 2 else bits // 8
        ids = parse(first_id.encode("latin-1"))[0] if first_id else []
        file_id = ids[0] if isinstance(ids, list) and ids and isinstance(ids[0], bytes) else b""
        known = blank | {"method": methods[0], "string_method": methods[1], "revision": r, "rights": e["P"]}
        if methods == ("none", "none"):
            return known
        found = kernel.unlocked((password or "").encode(), e["O"], e["U"], e["P"], file_id, r, size, e.get("EncryptMetadata", True) is not False)
        if found is None:
            return blank | {"revision": r, "error": "wrong password"}
        return known | {"key": found[0], "as_owner": found[1]}
    except (PdfError, KeyError, TypeError, AttributeError) as problem:
        return blank | {"error": str(problem)}


def protection(documents: DataFrame, objects: DataFrame, password: str | DataFrame = "") -> DataFrame:
    """file_id, encrypt_num, method and string_method (none, rc4, aes), revision, rights (names), as_owner, key, error for each document.

    The dictionary may be an object or stand in the trailer. password is one for all files, or (file_id, password); files without
    any are opened as with an empty one, which is always tried.
    """
    said = F.col("trailer")["Encrypt"]
    named = documents.select("file_id", ref_number(said).alias("num"), F.when(said.startswith("<<"), said).alias("inner"), F.col("trailer")["ID"].alias("id"))
    given = named.withColumn("password", F.lit(password)) if isinstance(password, str) else named.join(password.select("file_id", "password"), "file_id", "left")
    both = given.join(objects.where("kind = 'dict'").select("file_id", "num", F.decode("body", "ISO-8859-1").alias("spelled")), ["file_id", "num"], "left")
    # a reference to nothing is a dictionary that lacks everything
    text = F.coalesce("inner", "spelled", F.when(F.col("num").isNotNull(), "<<>>"))
    made = F.udf(_set_up, SETUP, useArrow=True)(text, F.col("id"), F.col("password"))
    return both.withColumn("s", made).select("file_id", F.col("num").alias("encrypt_num"), "s.key", "s.method", "s.string_method", "s.revision", permissions(F.col("s.rights")).alias("rights"), "s.as_owner", "s.error")


def _little(x: Column, size: int) -> Column:
    wide = F.lpad(F.hex(x.cast("long")), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(wide, 2 * k + 1, 2) for k in reversed(range(size))]))


def object_key(key: Column, num: Column, gen: Column, method: Column) -> Column:
    salt = F.when(method == "aes", F.lit(b"sAlT")).otherwise(F.lit(b""))
    whole = F.unhex(F.md5(F.concat(key, _little(num, 3), _little(gen, 2), salt)))
    return F.substring(whole, F.lit(1), F.least(F.octet_length(key) + 5, F.lit(16)))


def _rc4(data: Column, key: Column) -> Column:
    return F.udf(lambda d, k: None if d is None or k is None else kernel.rc4(bytes(k), bytes(d)), "binary", useArrow=True)(data, key)


def aes_opened(data: Column, key: Column) -> Column:
    """AES in blocks with the vector in front; padding that can't be padding is kept. Null unless data is two or more whole blocks."""
    blocks = (F.octet_length(data) % 16 == 0) & (F.octet_length(data) >= 32)
    # one more block, which opens to sixteen bytes of padding, lets Catalyst hand out all that was there
    full = F.lit(bytes([16] * 16))
    last = F.substring(data, F.octet_length(data) - 15, F.lit(16))
    more = F.substring(F.aes_encrypt(full, key, F.lit("CBC"), F.lit("PKCS"), last), F.lit(17), F.lit(16))
    plain = F.when(blocks, F.try_aes_decrypt(F.concat(data, more), key, F.lit("CBC"), F.lit("PKCS")))
    n = F.conv(F.hex(F.substring(plain, F.octet_length(plain), F.lit(1))), 16, 10).cast("int")
    return F.when(n.between(1, 16), F.substring(plain, F.lit(1), F.octet_length(plain) - n)).otherwise(plain)


def _restrung(values: DataFrame, through, *keys: str) -> DataFrame:
    """keys and spelled: values (keys, spelled and columns that through uses) with each string's bytes, wherever it stands, by way of through."""
    rows = leaves(values)
    made = through(F.when(F.col("kind") == "string", to_bytes(F.col("text"))))
    return spelled(rows.withColumn("text", F.when(F.col("kind") == "string", F.concat(F.lit("<"), F.lower(F.hex(made)), F.lit(">"))).otherwise(F.col("text"))), *keys)


HAS_STRING = r"\(|<[0-9a-fA-F]"


def decrypted(objects: DataFrame, found: DataFrame) -> DataFrame:
    """objects with the streams and strings of encrypted files in clear, each by its own method.

    The encryption dictionary, cross-reference streams and members of object streams stay as they are, as do the data of streams whose
    first filter is Crypt with Identity. A stream that isn't whole blocks of AES is null; such a string stays.
    """
    if "string_method" not in found.columns:
        found = found.withColumn("string_method", F.lit("none"))
    both = objects.join(found.where("key is not null").select("file_id", "encrypt_num", "key", "method", "string_method"), "file_id", "left")
    own = lambda method: object_key(F.col("key"), F.col("num"), F.col("gen"), F.col(method))
    meant = F.col("key").isNotNull() & (F.coalesce(F.col("entries")["Type"], F.lit("")) != "/XRef") & ~F.col("source").contains("packed") & (F.col("num") != F.coalesce("encrypt_num", F.lit(-1)))
    name = F.regexp_extract(F.coalesce(F.get(filter_parms(F.col("entries")["DecodeParms"]), F.lit(0)), F.lit("")), r"/Name\s*+/([^\s/<>\[\]]++)", 1)
    exempt = F.coalesce(F.get(filter_names(F.col("entries")["Filter"]), F.lit(0)) == "Crypt", F.lit(False)) & name.isin("", "Identity")
    both = both.withColumn("_meant", meant)
    data = F.col("_meant") & F.col("raw").isNotNull() & ~exempt & (F.col("method") != "none")
    aes = aes_opened(F.when(data, F.col("raw")), own("method"))
    clear = F.when(~data, F.col("raw")).when(F.col("method") == "aes", aes).otherwise(_rc4(F.when(data & (F.col("method") == "rc4"), F.col("raw")), own("method")))
    locked = both.where("_meant and string_method in ('rc4', 'aes')").withColumn("_own", own("string_method"))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.decode("body", "ISO-8859-1").alias("value")))
    texts = locked.select("file_id", "num", "_own", "string_method", F.explode(F.concat(F.map_entries("entries"), whole)).alias("e")).select("file_id", "num", "_own", "string_method", "e.key", F.col("e.value").alias("spelled"))
    through = lambda b: F.coalesce(F.when(F.col("string_method") == "aes", aes_opened(b, F.col("_own"))).otherwise(_rc4(F.when(F.col("string_method") == "rc4", b), F.col("_own"))), b)
    told = _restrung(texts.where(F.col("spelled").rlike(HAS_STRING)), through, "file_id", "num", "key")
    told = told.groupBy("file_id", "num").agg(F.max(F.when(F.col("key").isNull(), F.col("spelled"))).alias("_body"), F.map_from_entries(F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", "spelled")))).alias("_told"))
    out = both.withColumn("raw", clear).join(told, ["file_id", "num"], "left")
    swapped = F.transform_values("entries", lambda k, v: F.coalesce(F.col("_told")[k], v))
    out = out.withColumn("entries", F.when(F.col("_told").isNull(), F.col("entries")).otherwise(swapped)).withColumn("body", F.coalesce(F.encode("_body", "ISO-8859-1"), "body"))
    return out.select(*objects.columns)


def encrypted(objects: DataFrame, key: bytes | DataFrame) -> DataFrame:
    """objects (file_id, num, body, raw) with streams under AES-128 and a random vector each, by one key for all files.

    Where key is (file_id, key) each file has its own, and strings are encrypted too, also those in the dictionaries of streams,
    whose length follows the data. Files without a key stay as they are.
    """
    if isinstance(key, bytes):
        own = object_key(F.lit(key), F.col("num"), F.lit(0), F.lit("aes"))
        return objects.withColumn("raw", F.when(F.col("raw").isNotNull(), F.aes_encrypt("raw", own, F.lit("CBC"), F.lit("PKCS"))))
    own = F.when(F.col("key").isNotNull(), object_key(F.col("key"), F.col("num"), F.lit(0), F.lit("aes")))
    seal = lambda b: F.aes_encrypt(b, F.col("_own"), F.lit("CBC"), F.lit("PKCS"))
    both = objects.select("file_id", "num", "body", "raw").join(key.select("file_id", "key"), "file_id", "left").withColumn("_own", own)
    texts = both.where("_own is not null").select("file_id", "num", "_own", F.decode("body", "ISO-8859-1").alias("spelled")).where(F.col("spelled").rlike(HAS_STRING))
    told = _restrung(texts, seal, "file_id", "num")
    out = both.withColumn("raw", F.when(F.col("_own").isNotNull() & F.col("raw").isNotNull(), seal(F.col("raw"))).otherwise(F.col("raw"))).join(told, ["file_id", "num"], "left")
    body = F.coalesce("spelled", F.decode("body", "ISO-8859-1"))
    sized = F.regexp_replace(body, r"/Length \d+(?=>>$|/)", F.concat(F.lit("/Length "), F.octet_length("raw").cast("string")))
    return out.select("file_id", "num", F.encode(F.when(F.col("raw").isNotNull() & F.col("_own").isNotNull(), sized).otherwise(body), "ISO-8859-1").alias("body"), "raw")


def _locks(user: str, owner: str, rights: int, ident: bytes, strings: bool) -> dict:
    made = kernel.owner_entry(owner.encode(), user.encode(), 4, 16)
    key = kernel.file_key(user.encode(), made, rights, bytes(ident), 4, 16)
    own = Name("StdCF")
    entries = {Name("Filter"): Name("Standard"), Name("V"): 4, Name("R"): 4, Name("Length"): 128, Name("P"): rights, Name("O"): made, Name("U"): kernel.user_entry(key, bytes(ident), 4) + bytes(16), Name("CF"): {own: {Name("CFM"): Name("AESV2"), Name("Length"): 16}}, Name("StmF"): own, Name("StrF"): own if strings else Name("Identity")}
    return {"key": key, "dictionary": format_value(entries).decode("latin-1")}


def locks(asked: DataFrame) -> DataFrame:
    """file_id, key, dictionary (spelled), ident: AES-128 for files (file_id, user, owner and rights, and strings: whether those too) by
    passwords and rights of their own. The identifier comes from the file's name; it belongs in the trailer's /ID."""
    own = asked.withColumn("ident", F.unhex(F.md5(F.col("file_id").cast("string"))))
    made = F.udf(_locks, "struct<key: binary, dictionary: string>", useArrow=True)("user", "owner", "rights", "ident", "strings")
    return own.withColumn("l", made).select("file_id", "l.key", "l.dictionary", "ident")


def trailer_of(found: DataFrame) -> DataFrame:
    """file_id, more: the trailer's entries for files with the given locks."""
    ident = F.hex("ident")
    return found.select("file_id", F.concat(F.lit("/Encrypt "), "dictionary", F.lit("/ID[<"), ident, F.lit("><"), ident, F.lit(">]")).alias("more"))


def refusal(objects: DataFrame, documents: DataFrame) -> DataFrame:
    """file_id, reason: why a file can't be laid out anew page by page, null if it can."""
    root = documents.join(objects.withColumnRenamed("num", "root").select("file_id", "root", "entries"), ["file_id", "root"])
    thumbs = objects.where("entries['Type'] = '/Page' and entries['Thumb'] is not null").select("file_id", F.lit(True).alias("thumb")).distinct()
    e = F.col("entries")
    reason = F.when(F.col("trailer")["Encrypt"].isNotNull(), "Encrypt")
    for key in ("OpenAction", "Threads", "AcroForm", "ViewerPreferences"):
        reason = reason.when(e[key].isNotNull(), key)
    reason = reason.when(ref_number(e["PageMode"]).isNotNull(), "PageMode").when((e["PageMode"] == "/UseOutlines") & e["Outlines"].isNotNull(), "Outlines").when(F.col("thumb"), "Thumb")
    return root.join(thumbs, "file_id", "left").select("file_id", reason.alias("reason"))


