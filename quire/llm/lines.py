"""Fuzzy line deduplication in DataFrame operations only.

Equal lines are counted once, by two 64-bit hashes. A distinct line gets a MinHash signature over its
hashed character shingles; bands of four minima bring candidates together; the candidates' Jaccard
similarity is computed exactly from their whole shingle sets; and a distributed union-find keeps the
first line, by doc_id and place, of every component.

A line is first held against one leader of its buckets, which joins most copies to components at the cost of a row each; the
leader is the line that shares its bands with the most others, as the middle of a group of copies does. Then the members of a bucket
are dealt over blocks and compared within their own, which joins what lies far from the leader at the cost of a block's pairs
a line. At last every pair of a bucket that is not in one component yet is held against each other, the lines outside of the
leader's component against blocks of all. In blocks the sizes of shingle sets are compared, and bitmaps of these that differ in no more
bits than the sets do in shingles; only pairs that these can't tell to be unlike become rows, once each, and are compared whole. Besides,
pairs whose signatures agree so little that they are unlike, but for one in a million, are spared the comparison; those in one component
can't change it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop, forget, laid_out, narrow, stage, table
from .graph import components

SHINGLE = 5
SIMILARITY = 0.8
#: Minima of a signature, as GROUPS groups of PER_BAND, and the bands: each takes one of every six, so that any two bands share
#: few. A pair of similarity 0.8 meets in a band with probability 0.992, of 0.82 with 0.997, of 0.85 with 0.9993, whatever its
#: length; one of 0.1, as any two lines of a language have, once in 40,000 pairs, or work would grow with the square of the lines.
GROUPS, PER_BAND = 8, 6
LANES = GROUPS * PER_BAND
SLOPES = (0, 1, 3)
BANDS = [[(g + m * i) % GROUPS * PER_BAND + i for i in range(PER_BAND)] for m in SLOPES for g in range(GROUPS)]
#: Two bits of each of TAGS minima go with a line. Signatures that agree in fewer than AGREE of them (as chance has it in a
#: quarter of what is unlike) belong to unlike lines: at similarity 0.8 so few agree in three of a million pairs.
TAGS, AGREE = 32, 18
#: Shingles that one row stands for while signatures are made: 16 to 24 took less time than 8, and 32 more than either.
STEP = 20
#: Members of a block when lines are compared within their own, and when all pairs are compared.
OWN, BLOCK = 32, 256
#: Longs of the bitmap that stands for a shingle set in blocks, and shingles that one row stands for while it is made.
WORDS, PER_ROW = 16, 8
#: Lines with fewer characters, which are the empty ones, are never held to be copies.
SHORTEST = 1


def _hashes(line: Column) -> tuple[Column, Column]:
    return F.xxhash64(line), F.xxhash64(F.lit(7), line)


def _placed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))


def _takes_part() -> Column:
    return (F.length("line") >= SHORTEST) & F.col("doc_id").isNotNull()


def _numbered(docs: DataFrame) -> DataFrame:
    """doc_id, place, line, id, check of each line that takes part: id and check together tell equal lines."""
    h1, h2 = _hashes(F.col("line"))
    return _placed(docs).where(_takes_part()).withColumns({"id": h1, "check": h2})


def _shingles(line: Column) -> Column:
    cut = F.regexp_extract_all(line, F.lit(rf"(?s)(?=(.{{{SHINGLE}}}))."), F.lit(1))
    return F.when(F.length(line) < SHINGLE, F.array(line)).otherwise(cut)


def shingle_set(line: Column) -> Column:
    """The distinct shingles of a line, as their hashes; a line shorter than a shingle is its own."""
    return F.array_distinct(F.transform(_shingles(line), lambda s: F.xxhash64(s)))


def _distinct(lines: DataFrame) -> DataFrame:
    """id, line of each distinct line."""
    return lines.groupBy("id").agg(F.min("line").alias("line"))


def _constant(k: int) -> Column:
    """Fixed points, spread by the golden ratio."""
    x = (k + 1) * 0x9E3779B97F4A7C15 % 2**64
    return F.lit(x - 2**64 if x >= 2**63 else x)


def _signed(texts: DataFrame) -> DataFrame:
    """id, bands, tags of each row of texts (id, line). A minimum is the shingle whose hash lies nearest to a fixed point when
    bits are compared from the top, by which it is as random as under a permutation; two hashes of each shingle serve in
    turn. The signature is made of the same shingles that the comparison uses: repeats of one change no minimum."""
    chars = texts.select("id", F.encode("line", "UTF-32").alias("u"), (F.greatest(F.length("line") - SHINGLE, F.lit(0)) * 4 + 1).alias("last"))
    each = chars.select("id", "u", "last", F.explode(F.sequence(F.lit(1), "last", F.lit(4 * STEP))).alias("p"))
    cut = [F.substring("u", F.least(F.col("p") + 4 * k, F.col("last")), F.lit(4 * SHINGLE)).alias(f"s{k}") for k in range(STEP)]
    first = each.select("id", *cut).select("id", *[F.xxhash64(f"s{k}").alias(f"h{k}_0") for k in range(STEP)])
    hashed = first.select("*", *[F.xxhash64(f"h{k}_0").alias(f"h{k}_1") for k in range(STEP)])
    minima = hashed.groupBy("id").agg(*[F.min(F.least(*[F.col(f"h{k}_{m % 2}").bitwiseXOR(_constant(m)) for k in range(STEP)])).alias(f"m{m}") for m in range(LANES)])
    bands = [F.xxhash64(F.lit(b), *[F.col(f"m{m}") for m in lanes]) for b, lanes in enumerate(BANDS)]
    tags = reduce(Column.bitwiseOR, [F.shiftleft(F.col(f"m{m}").bitwiseAND(F.lit(3)), 2 * m) for m in range(TAGS)])
    return minima.select("id", F.array(*bands).alias("bands"), tags.alias("tags"))


def similar(pairs: DataFrame, lines: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of ids whose lines (id, line) are similar, exactly. The generators make each set, and what two have in
    common, once, in compiled code."""
    left = lines.select(F.col("id").alias("a"), F.col("line").alias("x"))
    right = lines.select(F.col("id").alias("b"), F.col("line").alias("y"))
    sets = F.array(F.struct(shingle_set(F.col("x")).alias("s"), shingle_set(F.col("y")).alias("t")))
    each = pairs.join(right, "b").join(left, "a").select("a", "b", F.inline(sets))
    counted = each.select("a", "b", (F.size("s") + F.size("t")).alias("both"), F.explode(F.array(F.size(F.array_intersect("s", "t")))).alias("common"))
    return counted.where(F.col("common") >= least * (F.col("both") - F.col("common"))).select("a", "b")


def _members(signed: DataFrame) -> DataFrame:
    """bucket, id, tags, score of the lines in buckets that distinct lines share; bands of one slope at a time. The score is
    the number of lines in all buckets of a line."""
    parts = []
    for k in range(len(SLOPES)):
        each = signed.select("id", F.explode(F.slice("bands", k * GROUPS + 1, GROUPS)).alias("bucket"))
        parts.append(stage(each.withColumn("n", F.count("*").over(Window.partitionBy("bucket"))).where("n > 1"), "shared"))
        forget(signed.sparkSession)
    every = reduce(DataFrame.unionByName, parts)
    scores = every.groupBy("id").agg(F.sum("n").alias("score")).join(signed.select("id", "tags"), "id")
    found = stage(every.drop("n").join(scores, "id"), "members")
    drop(*parts)
    return found


def _possible(x: Column, y: Column) -> Column:
    """Whether two signatures agree in AGREE of TAGS minima or more."""
    unlike = x.bitwiseXOR(y)
    pairs = unlike.bitwiseOR(F.shiftrightunsigned(unlike, 1)).bitwiseAND(F.lit(0x5555555555555555))
    return F.bit_count(pairs) <= TAGS - AGREE


def _mixed(members: DataFrame, links: DataFrame) -> DataFrame:
    """members with the root of their component so far, in the buckets that have members of several components. Of two
    members only those that may be similar."""
    groups = components(links, "a", "b")
    rooted = stage(members.join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id")), "rooted")
    told = [F.count("*").alias("k"), F.min("root").alias("low"), F.max("root").alias("high"), F.min_by("tags", "id").alias("x"), F.max_by("tags", "id").alias("y")]
    several = rooted.groupBy("bucket").agg(*told).where((F.col("low") < F.col("high")) & ((F.col("k") > 2) | _possible(F.col("x"), F.col("y")))).select("bucket")
    found = stage(rooted.join(several, "bucket"), "mixed")
    drop(rooted)
    return found


def _heads(rows: DataFrame, *columns: str) -> DataFrame:
    """bucket and columns, as head_..., of the member of each bucket that has the highest score."""
    order = F.shiftleft("score", 24).bitwiseOR(F.xxhash64("id").bitwiseAND(F.lit(2**24 - 1)))  # one number, for hash aggregates
    return rows.groupBy("bucket").agg(*[F.max_by(c, order).alias(f"head_{c}") for c in columns])


def _led(rows: DataFrame) -> DataFrame:
    """a, b: each line b with one leader a of its buckets that is of another component and may be similar."""
    held = rows.join(_heads(rows, "id", "root", "tags"), "bucket").where((F.col("root") != F.col("head_root")) & _possible(F.col("tags"), F.col("head_tags")))
    return held.groupBy(F.col("id").alias("b")).agg(F.min_by("head_id", F.xxhash64("head_id")).alias("a")).select("a", "b")


def _sketched(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """id, size (of the shingle set), w0, w1 ... (a bitmap in which each shingle of the set turns one bit over), buckets."""
    own = rows.groupBy("id").agg(F.collect_set("bucket").alias("buckets"))
    sets = texts.join(own.select("id").hint("shuffle_hash"), "id", "left_semi").select("id", F.explode(F.array(shingle_set(F.col("line")))).alias("s"))
    rows = sets.select("id", "s", F.explode(F.sequence(F.lit(0), F.size("s") - 1, F.lit(PER_ROW))).alias("p"))
    each = rows.select("id", F.least(F.size("s") - F.col("p"), F.lit(PER_ROW)).alias("n"), *[F.get("s", F.col("p") + k).alias(f"s{k}") for k in range(PER_ROW)])
    nth = range(PER_ROW)
    bits = each.select("id", "n", *[F.shiftright(f"s{k}", 6).bitwiseAND(F.lit(WORDS - 1)).alias(f"word{k}") for k in nth], *[F.expr(f"shiftleft(1L, cast(s{k} & 63 as int))").alias(f"bit{k}") for k in nth])
    words = [F.bit_xor(reduce(Column.bitwiseXOR, [F.when(F.col(f"word{k}") == w, F.col(f"bit{k}")).otherwise(F.lit(0)) for k in nth])).alias(f"w{w}") for w in range(WORDS)]
    return bits.groupBy("id").agg(F.sum("n").alias("size"), *words).join(own, "id")


def _close(x: str, y: str, least: float) -> Column:
    """False only for pairs that are less similar: sets that differ in d shingles have bitmaps that differ in d bits or fewer."""
    differ = reduce(Column.__add__, [F.bit_count(F.col(f"{x}.w{k}").bitwiseXOR(F.col(f"{y}.w{k}"))) for k in range(WORDS)])
    m, n = F.col(f"{x}.size"), F.col(f"{y}.size")
    return (F.least(m, n) + 1e-6 >= least * F.greatest(m, n)) & (differ * (1 + least) <= (1 - least) * (m + n) + 1e-6)


def _blocked(rows: DataFrame, sketches: DataFrame, least: float, block: int, own: bool) -> DataFrame:
    """a, b: pairs of members of a bucket that are of different components and may be similar, each in the first bucket that
    both are in. Members are dealt over blocks of about `block`. If `own`, only those in one block meet; else every pair does, as members
    outside of the leader's component, of which each such pair has one, go to all blocks."""
    sizes = rows.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = rows.join(sizes.join(_heads(rows, "root"), "bucket"), "bucket").join(sketches, "id").withColumn("out", F.col("root") != F.col("head_root"))
    kept = ["id", "root", "tags", "out", "size", *[f"w{k}" for k in range(WORDS)], "buckets"]
    at = F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int")
    x = dealt.where("out").select("bucket", (at if own else F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("block"), *kept).alias("x")
    y = dealt.select("bucket", at.alias("block"), *kept).alias("y")
    met = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in ("bucket", "block")]
    once = (F.col("x.id") < F.col("y.id")) | ~F.col("y.out")
    first = F.array_min(F.array_intersect("x.buckets", "y.buckets")) == F.col("x.bucket")
    pairs = x.join(y, reduce(Column.__and__, [*met, F.col("x.root") != F.col("y.root"), once, _possible(F.col("x.tags"), F.col("y.tags")), _close("x", "y", least), first]))
    return pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def _verified(texts: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """The similar ones of the pairs (a, b)."""
    pairs = stage(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    lines = stage(texts.join(ids.hint("shuffle_hash"), "id", "left_semi"), "lines")
    found = stage(similar(pairs, lines, least), "similar")
    drop(lines, pairs)
    return found


def _links(texts: DataFrame, members: DataFrame, least: float) -> DataFrame:
    """a, b: verified links between distinct lines, with the components of all similar pairs that share a bucket."""
    found = _verified(texts, _led(members.withColumn("root", F.col("id"))), least)
    rows = _mixed(members, found)
    sketches = stage(_sketched(texts, rows), "sketches")
    found = found.unionByName(_verified(texts, _blocked(rows, sketches, least, OWN, True), least))
    rest = _mixed(rows.drop("root"), found)
    found = found.unionByName(_verified(texts, _blocked(rest, sketches, least, BLOCK, False), least))
    drop(rows, rest, sketches)
    return found


def marked_lines(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, place, keep_doc, keep_place: a row for each line that takes part, with the first line of its component."""
    docs = narrow(docs, "doc_id", "text")
    lines = _numbered(docs)
    marked = stage(lines.select("doc_id", "place", "id", "check"), "marked")
    with laid_out(_distinct(lines), "id", "distinct") as texts:
        signed = stage(_signed(texts), "signed")
        members = _members(signed)
        drop(signed)
        groups = components(_links(texts, members, least), "a", "b")
        drop(members)
    at = F.struct("doc_id", "place")
    distinct = marked.groupBy("id", "check").agg(F.min(at).alias("first"), F.count("*").alias("n"))
    named = stage(distinct.join(groups.withColumnRenamed("node", "id"), "id", "left"), "named")
    heads = named.where("root is not null").groupBy("root").agg(F.min("first").alias("head"))
    heads = named.where("root is not null").join(heads, "root").select("id", "check", "head").unionByName(named.where("root is null and n > 1").select("id", "check", F.col("first").alias("head")))
    both = marked.join(heads, ["id", "check"], "left").withColumn("head", F.coalesce("head", at))
    return both.select("doc_id", "place", F.col("head.doc_id").alias("keep_doc"), F.col("head.place").alias("keep_place"))


def repeated_lines(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, gone: the places (from 0) of lines that have an earlier copy, for documents that have such."""
    gone = marked_lines(docs, least).where("not (doc_id = keep_doc and place = keep_place)")
    return gone.groupBy("doc_id").agg(F.collect_set("place").alias("gone"))


def _without(gone: Column) -> Column:
    lines = F.split("text", "\n", -1)
    places = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone))
    return F.concat_ws("\n", F.transform(places, lambda i: F.get(lines, i)))


def dedup_lines(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """docs with repeated lines taken out of text, and n_chars (if there is such a column) counted anew where that
    happened; every row stays, even if no line of it does.

    Every line but the empty ones takes part. Of equal or similar lines the one of the smallest
    doc_id, then of the smallest place, stays. Rows that repeat a doc_id count as copies of one document: a line
    is kept in all of them or in none. Rows of null doc_id or null text, and an empty table, come back as they are.
    """
    gone = stage(repeated_lines(docs, least).select(F.col("doc_id").alias("_gone_id"), F.col("gone").alias("_gone")), "gone")
    both = docs.join(gone, docs["doc_id"] == gone["_gone_id"], "left")
    cut = both.withColumn("_cut", F.when(F.col("_gone").isNotNull(), _without(F.col("_gone"))))
    out = {"text": F.coalesce("_cut", "text")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.coalesce(F.length("_cut").cast(docs.schema["n_chars"].dataType), "n_chars")
    return cut.select(*[out[c].alias(c) if c in out else F.col(f"`{c}`") for c in docs.columns])


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line with the line that stands for it; empty lines and those of null doc_id stand for themselves."""
    docs = table(spark, sf_dir, "documents")
    own = _placed(narrow(docs, "doc_id", "text")).where(~_takes_part()).select("doc_id", "place", F.col("doc_id").alias("keep_doc"), F.col("place").alias("keep_place"))
    found = marked_lines(docs).unionByName(own)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_doc")) & (F.col("place") == F.col("keep_place"))
    return found.select("doc_id", F.col("place").alias("line"), "keep_doc", F.col("keep_place").alias("keep_line"), kept.alias("kept"))
