"""Stream filters as columns: chains, hex, base 85, run lengths and Crypt in Catalyst, one small function for each other codec."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.kernels import codecs
from quire.kernels.syntax import Name, parse

DECODED = "struct<data: binary, undecoded: binary, image: string, recovered: boolean, cause: string, filter: string>"
STEP = "struct<data: binary, problem: string>"
BLANK = r"[\x00\t\n\x0c\r ]"
KNOWN = ("ASCIIHexDecode", "ASCII85Decode", "RunLengthDecode", "Crypt", "FlateDecode", "LZWDecode", "CCITTFaxDecode")
Pair = tuple[Column, Column]


def _small(f, *args: Column) -> Pair:
    """(data, problem) of a codec that works on the bytes of one value; rows whose first argument is null don't reach it."""

    def run(data: bytes | None, *rest) -> dict | None:
        if data is None:
            return None
        try:
            out, problem = f(bytes(data), *rest)
        except (ValueError, TypeError) as e:
            out, problem = b"", str(e)
        return {"data": out, "problem": problem}

    made = F.udf(run, STEP, useArrow=True)(*args)
    return made["data"], made["problem"]


def ascii_hex(data: Column) -> Pair:
    """Up to >; an odd last digit stands for its high half; what comes before another byte is kept."""
    body = F.regexp_replace(F.substring_index(F.decode(data, "ISO-8859-1"), ">", 1), BLANK, "")
    good = F.regexp_extract(body, "^[0-9A-Fa-f]*", 0)
    clean, odd = F.length(good) == F.length(body), F.length(good) % 2
    digits = F.when(clean & (odd == 1), F.concat(good, F.lit("0"))).otherwise(F.substring(good, F.lit(1), F.length(good) - odd))
    return F.unhex(digits), F.when(~clean, "hex: not a digit")


def ascii85(data: Column) -> Pair:
    """Groups of five up to ~, z for four zeros, a shorter last group; what comes before a wrong group is kept."""
    body = F.substring_index(F.regexp_replace(F.regexp_replace(F.decode(data, "ISO-8859-1"), BLANK, ""), "^<~", ""), "~", 1)
    groups = F.regexp_extract_all(body, F.lit(r"\G(?:z|[!-u]{5}|[!-u]{1,4}(?![\s\S]))"), F.lit(0))
    digit = lambda g, k: F.ascii(F.substring(F.rpad(g, 5, "u"), k + 1, 1)).cast("long") - 33
    value = lambda g: F.when(g == "z", F.lit(0).cast("long")).otherwise(reduce(Column.__add__, [digit(g, k) * 85 ** (4 - k) for k in range(5)]))
    read = F.transform(groups, lambda g: F.struct(F.when(g == "z", 5).otherwise(F.length(g)).alias("n"), value(g).alias("v")))
    problem = lambda x: F.when(x["n"] == 1, "ascii85: a lone last character").when((x["n"] == 5) & (x["v"] > 0xFFFFFFFF), "ascii85: a group too large")
    first = F.array_position(F.transform(read, lambda x: problem(x).isNotNull()), F.lit(True))
    kept = F.when(first > 0, F.slice(read, F.lit(1), (first - 1).cast("int"))).otherwise(read)
    spelled = F.transform(kept, lambda x: F.substring(F.lpad(F.hex(x["v"].bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"), F.lit(1), 2 * x["n"] - 2))
    whole = F.length(F.array_join(groups, "")) == F.length(body)
    return F.unhex(F.array_join(spelled, "")), F.when(first > 0, problem(F.get(read, (first - 1).cast("int")))).when(~whole, "ascii85: not a digit")


def run_length(data: Column) -> Pair:
    """Literal and repeated runs up to byte 128; of a run that the data cuts short what is there is kept."""
    text = F.decode(data, "ISO-8859-1")
    run = "|".join(rf"\x{n:02x}[\s\S]{{{n + 1}}}" for n in range(128))
    runs = F.regexp_extract_all(text, F.lit(rf"\G(?:{run}|[\x81-\xff][\s\S])"), F.lit(0))
    rest = F.substring(text, F.length(F.array_join(runs, "")) + 1, F.length(text))
    cut = (rest != "") & (F.ascii(rest) != 128)
    plain = F.transform(runs, lambda r: F.when(F.ascii(r) < 128, F.substring(r, F.lit(2), F.length(r))).otherwise(F.repeat(F.substring(r, F.lit(2), F.lit(1)), 257 - F.ascii(r))))
    tail = F.when(cut & (F.ascii(rest) < 128), F.substring(rest, F.lit(2), F.length(rest))).otherwise("")
    return F.encode(F.concat(F.array_join(plain, ""), tail), "ISO-8859-1"), F.when(cut, "run length: data ends early")


def _number(parms: Column, key: str, default: int) -> Column:
    return F.coalesce(F.try_to_number(F.regexp_extract(parms, rf"/{key}\s*(-?\d+)", 1), F.lit("S9999999999")).cast("long"), F.lit(default).cast("long"))


def _fax(data: bytes, parms: str) -> tuple[bytes, str | None]:
    from quire.kernels.fax import fax

    value = parse(parms.encode("latin-1"))[0]
    return fax(data, value if isinstance(value, dict) else {})


def _apply(name: Column, data: Column, parms: Column, used: set[str]) -> Pair:
    """One filter on each row's data; `used` are the filters that occur, 'predictor' among them if one may be needed."""
    of = lambda n: F.when(name == n, data)
    out, problem = F.lit(b""), F.when(~name.isin(*KNOWN), F.concat(F.lit("unknown filter "), name))
    plain = {"ASCIIHexDecode": ascii_hex, "ASCII85Decode": ascii85, "RunLengthDecode": run_length}
    made = {n: f(of(n)) for n, f in plain.items() if n in used}
    if "Crypt" in used:
        same = F.coalesce(F.nullif(F.regexp_extract(parms, r"/Name\s*+/([^\s/<>\[\]]++)", 1), F.lit("")), F.lit("Identity")) == "Identity"
        made["Crypt"] = F.when(same, data).otherwise(F.lit(b"")), F.when(~same, "crypt: a filter other than Identity")
    if "FlateDecode" in used:
        made["FlateDecode"] = _small(codecs.flate, of("FlateDecode"))
    if "LZWDecode" in used:
        made["LZWDecode"] = _small(codecs.lzw, of("LZWDecode"), F.when(_number(parms, "EarlyChange", 1) == 0, 0).otherwise(1))
    if "CCITTFaxDecode" in used:
        made["CCITTFaxDecode"] = _small(_fax, of("CCITTFaxDecode"), parms)
    for n, (d, p) in made.items():
        out, problem = F.when(name == n, d).otherwise(out), F.when(name == n, p).otherwise(problem)
    if "predictor" in used:
        asked = name.isin("FlateDecode", "LZWDecode") & (_number(parms, "Predictor", 1) > 1)
        numbers = [_number(parms, k, d) for k, d in (("Predictor", 1), ("Colors", 1), ("BitsPerComponent", 8), ("Columns", 1))]
        d, p = _small(codecs.predict, F.when(asked, out), *numbers)
        out, problem = F.when(asked, d).otherwise(out), F.coalesce(problem, F.when(asked, p))
    return out, problem


#: The filters' short names, and those whose data stays an image.
SHORT = {"AHx": "ASCIIHexDecode", "A85": "ASCII85Decode", "LZW": "LZWDecode", "Fl": "FlateDecode", "RL": "RunLengthDecode", "CCF": "CCITTFaxDecode", "DCT": "DCTDecode"}
IMAGES = ("DCTDecode", "JPXDecode", "JBIG2Decode")


NAME = r"/[^\s/<>\[\]()]++"


def filter_names(spelled: Column) -> Column:
    """The long names in the value of /Filter, a name or an array of names; null if it is anything else."""
    long = F.create_map(*[F.lit(x) for pair in SHORT.items() for x in pair])
    each = F.transform(F.regexp_extract_all(spelled, F.lit(rf"({NAME})"), F.lit(1)), lambda n: F.coalesce(long[F.substring(n, F.lit(2), F.length(n))], F.substring(n, F.lit(2), F.length(n))))
    # what is left without the names tells whether there was anything else; no pattern repeats a group
    good = spelled.rlike(f"^{NAME}$") | F.regexp_replace(spelled, NAME, "").rlike(r"^\[\s*+\]$")
    return F.when(spelled.isNull() | (spelled == "null"), F.array().cast("array<string>")).when(good, each)


def without_strings(spelled: Column) -> Column:
    """A spelled value with nothing in its literal strings, in which every bracket is escaped."""
    return F.regexp_replace(F.regexp_replace(spelled, r"(?s)\\.", " "), r"\([^()]*+\)", "()")


def _flat(spelled: str | None) -> list[str] | None:
    """The dictionaries in a value with nothing but plain entries, spelled; None if it isn't one or an array of them."""
    from quire.kernels.syntax import format_value

    if spelled is None:
        return None
    try:
        value, _ = parse(spelled.encode("latin-1", "replace"))
    except ValueError:
        return None
    rows = value if isinstance(value, list) else [value]
    if not all(r is None or isinstance(r, dict) for r in rows):
        return None
    plain = [{k: v for k, v in (r or {}).items() if v is None or isinstance(v, (bool, int, float, str))} for r in rows]
    return [format_value(r).decode("latin-1") for r in plain]


def filter_parms(spelled: Column) -> Column:
    """The dictionaries in the value of /DecodeParms, spelled, of the nested ones only the plain entries; a lone one goes with the
    first filter. Null if it is anything else."""
    one = r"<<[^<>()\[\]]*+>>|null"
    flat = spelled.rlike(f"^(?:{one})$") | F.regexp_replace(spelled, one, "").rlike(r"^\[\s*+\]$")
    nested = F.udf(_flat, "array<string>", useArrow=True)(F.when(~flat, spelled))
    return F.when(spelled.isNull(), F.array().cast("array<string>")).when(flat, F.regexp_extract_all(spelled, F.lit(f"({one})"), F.lit(1))).otherwise(nested)


#: Filters of a chain that stand in the plan; what comes behind them goes through the kernel, a row at a time. Longer chains than LONGEST are refused.
UNROLLED, LONGEST = 4, 1024


def _rest(data: bytes | None, names: list[str], parms: list[str]) -> dict | None:
    """The filters beyond those of the plan."""
    if data is None:
        return None
    entries = {"Filter": [Name(n) for n in names], "DecodeParms": [parse(p.encode("latin-1"))[0] if p else None for p in parms]}
    made = codecs.decode(entries, bytes(data))
    return {"data": made["data"] or b"", "problem": made["cause"], "image": made["image"], "filter": made["filter"]}


def _once(df: DataFrame, *columns: str) -> DataFrame:
    """df with these columns made before anything that uses them. Catalyst puts a column's expression in place of each use of it, which
    multiplies from step to step of a chain; it does not do so through a generator."""
    rest = [c for c in df.columns if c not in columns]
    return df.select(*[F.col(f"`{c}`") for c in rest], F.inline(F.array(F.struct(*columns))))


def _steps(df: DataFrame, raw: str, names: str, parms: str, used: list[set[str]]) -> DataFrame:
    """df with column decoded (DECODED), one filter of every chain after the other."""
    blank = F.lit(None).cast("string")
    wrong = F.when(F.col(names).isNull(), "filter: neither a name nor a list of names").when(F.size(names) > LONGEST, "filter: too many in a chain").when(F.col(parms).isNull(), "filter: parameters of the wrong kind")
    df = df.withColumns({"_now": F.col(raw), "_image": blank, "_at": blank, "_problem": wrong})
    for k, some in enumerate(used[:UNROLLED]):
        name = F.get(names, F.lit(k))
        live = name.isNotNull() & F.col("_problem").isNull() & F.col("_image").isNull()
        df = df.withColumn("_name", F.when(live, name)).withColumn("_parm", F.coalesce(F.get(parms, F.lit(k)), F.lit("")))
        df = _once(df.withColumns({"_image": F.coalesce("_image", F.when(F.col("_name").isin(*IMAGES), F.col("_name"))), "_name": F.when(~F.col("_name").isin(*IMAGES), F.col("_name"))}), "_name", "_parm", "_image")
        out, problem = _apply(F.col("_name"), F.col("_now"), F.col("_parm"), some)
        go = F.col("_name").isNotNull()
        df = df.withColumn("_made", F.when(go, F.struct(out.alias("data"), problem.alias("problem"))))
        df = _once(df, "_made").withColumns({"_now": F.when(go, F.col("_made.data")).otherwise(F.col("_now")), "_problem": F.coalesce("_problem", "_made.problem"), "_at": F.when(F.col("_made.problem").isNotNull(), F.col("_name")).otherwise(F.col("_at"))})
        df = _once(df, "_now", "_problem", "_at")
    if len(used) > UNROLLED:
        behind = lambda c: F.slice(c, UNROLLED + 1, LONGEST)
        more = (F.size(names) > UNROLLED) & F.col("_problem").isNull() & F.col("_image").isNull()
        made = F.udf(_rest, "struct<data: binary, problem: string, image: string, filter: string>", useArrow=True)(F.when(more, F.col("_now")), behind(names), behind(parms))
        df = df.withColumn("_made", F.when(more, made))
        df = df.withColumns({"_now": F.when(more, F.col("_made.data")).otherwise(F.col("_now")), "_problem": F.coalesce("_problem", "_made.problem"), "_image": F.coalesce("_image", "_made.image"), "_at": F.coalesce("_made.filter", "_at")})
    bad = F.col("_problem").isNotNull()
    some = F.octet_length("_now") > 0
    untouched = bad & (wrong.isNotNull() | ~some)
    found = F.struct(F.when(~untouched, F.col("_now")).alias("data"), F.when(untouched, F.col(raw)).alias("undecoded"), F.col("_image").alias("image"), bad.alias("recovered"), F.col("_problem").alias("cause"), F.col("_at").alias("filter"))
    return df.withColumn("decoded", F.when(F.col(raw).isNotNull(), found)).drop("_now", "_image", "_at", "_problem", "_name", "_parm", "_made")


def decode_streams(streams: DataFrame) -> DataFrame:
    """streams (with entries and raw) and decoded (DECODED): what the filters that each dictionary names make of its bytes.

    data has the prefix that could be read, or undecoded the bytes as they were, never both; image names an image filter
    at which decoding stopped on purpose. Which filters occur at which place of a chain is asked first, so that only
    their codecs are in the plan.
    """
    plan = streams.withColumns({"_names": filter_names(F.col("entries")["Filter"]), "_parms": filter_parms(F.col("entries")["DecodeParms"])})
    each = plan.where(F.size("_names") <= LONGEST).select(F.posexplode("_names").alias("k", "name"), F.coalesce(F.array_join("_parms", ""), F.lit("")).contains("/Predictor").alias("p"))
    known = each.where(F.col("name").isin(*KNOWN)).groupBy("k", "name").agg(F.max("p").alias("p"))
    rows = known.collect() + each.agg(F.max("k").alias("k")).withColumns({"name": F.lit(None), "p": F.lit(False)}).collect()
    used: list[set[str]] = [set() for _ in range(1 + max((r["k"] for r in rows if r["k"] is not None), default=-1))]
    for r in rows:
        if r["name"]:
            used[r["k"]] |= {r["name"]} | ({"predictor"} if r["p"] else set())
    return _steps(plan, "raw", "_names", "_parms", used).drop("_names", "_parms")


def decode_strictly(streams: DataFrame) -> DataFrame:
    """streams with data; an error where anything had to be recovered."""
    d = F.col("decoded")
    found = F.when(d["recovered"], F.raise_error(F.coalesce(d["cause"], F.lit("recovered")))).otherwise(d["data"])
    return decode_streams(streams).withColumn("data", found).drop("decoded")


def decode_filter(df: DataFrame, raw: Column, name: str, parms: Column | str = "<<>>") -> DataFrame:
    """df with decoded (DECODED): raw by one filter, or a chain of names with blanks between, with parameters spelled as a dictionary or array."""
    names = [SHORT.get(n, n) for n in name.split()]
    given = F.lit(parms) if isinstance(parms, str) else parms
    plan = df.withColumns({"_raw": raw, "_names": F.array(*map(F.lit, names)), "_parms": filter_parms(given)})
    return _steps(plan, "_raw", "_names", "_parms", [{n, "predictor"} if n in ("FlateDecode", "LZWDecode") and not (isinstance(parms, str) and "/Predictor" not in parms) else {n} for n in names]).drop("_raw", "_names", "_parms")


#: PDFDocEncoding where it differs from ISO 8859-1; U+FFFD where it defines nothing.
DOC_18 = "˘ˇˆ˙˝˛˚˜"
DOC_80 = "•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž�€"
DOC = {0x18 + k: c for k, c in enumerate(DOC_18)} | {0x80 + k: c for k, c in enumerate(DOC_80)} | {0x7F: "�", 0xAD: "�"}


def text_of(s: bytes | None) -> str | None:
    if s is None:
        return None
    s = bytes(s)
    if s.startswith(b"\xfe\xff"):
        return s[2:].decode("utf-16-be", "replace")
    if s.startswith(b"\xef\xbb\xbf"):
        return s[3:].decode("utf-8", "replace")
    return s.decode("latin-1").translate(DOC)


def text_string(s: Column) -> Column:
    """A text string's characters: UTF-16BE or UTF-8 by its mark, else PDFDocEncoding.

    Plain ASCII, most of all text, is settled by Catalyst; only the rest goes to Python.
    """
    latin = F.decode(s, "ISO-8859-1")
    plain = latin.rlike(r"\A[\x20-\x7E\t\n\r]*\z")
    return F.when(plain, latin).otherwise(F.udf(text_of, "string", useArrow=True)(F.when(~plain, s)))


def permissions(p: Column) -> Column:
    """The rights that the bits of /P give, as an array of names in the order of their bits."""
    bits = {3: "print", 4: "modify", 5: "copy", 6: "annotate", 9: "fill", 10: "extract", 11: "assemble", 12: "print well"}
    return F.filter(F.array(*[F.when(p.bitwiseAND(F.lit(1 << (b - 1))) != 0, F.lit(n)) for b, n in bits.items()]), lambda x: x.isNotNull())


def register(spark: SparkSession) -> None:
    """Makes functions callable from SQL: pdf_inflate(bytes), with data and problem, and pdf_text(bytes)."""

    def inflate(data: bytes | None) -> dict | None:
        return None if data is None else dict(zip(("data", "problem"), codecs.flate(bytes(data)), strict=True))

    spark.udf.register("pdf_inflate", F.udf(inflate, STEP, useArrow=True))
    spark.udf.register("pdf_text", F.udf(text_of, "string", useArrow=True))
