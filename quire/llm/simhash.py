"""SimHash near-duplicates by tiled exact comparison.

Fingerprints of distinct value are dealt into tiles of one population count and at most
TILE rows. Two fingerprints within the radius differ in population count by the radius at
most, so only tile pairs that close are compared, each by numpy exclusive-or and bit counts.
A tile pair reports a spanning forest of the links it finds, never all pairs, and the forests
meet in a distributed union-find. Tasks form a grid, and a tile is sent to one row and one column of it: what moves
is a fingerprint for each side of the grid, not for each pair of tiles. The comparison is exact at any size; its work grows with the
square of the number of distinct fingerprints, which is the price of the method.
"""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_words, narrow, ship, stage, table
from .graph import components

TILE = 16384
#: Fingerprints on one side of a task of the grid.
SIDE = 1 << 21


def fingerprint(words: list[bytes], width: int = 4) -> int:
    """Bit b is 1 if it is set in over half of the shingles' XXH64 (seed 42); 0 without words."""
    import xxhash

    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < width:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a : b - 1], 42) for a, b in zip([0, *ends], ends[width - 1 :], strict=False)]
    return _majority(np.array(hashes, dtype=np.uint64))


def _majority(hashes: np.ndarray) -> int:
    """Counts set bits column by column, in slices so that a very long text takes no more memory than a short one."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint_of(text: pd.Series) -> pd.Series:
    return pd.Series([np.uint64(fingerprint(byte_words(t))).astype(np.int64) for t in text], dtype="int64")


def _forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest over the pairs of a x b (or a x a) within the radius, as values."""
    nodes = a if b is None else np.concatenate([a, b])
    shift = 0 if b is None else len(a)
    right = a if b is None else b
    label = np.arange(len(nodes))
    us, vs = [], []
    step = 64
    for at in range(0, len(a), step):
        near = np.bitwise_count(a[at : at + step, None] ^ right[None, :]) <= radius
        r, c = np.nonzero(near)
        r, c = r + at, c + shift
        while len(r):
            lr, lc = label[r], label[c]
            open_ = lr != lc
            if not open_.any():
                break
            r, c, lr, lc = r[open_], c[open_], lr[open_], lc[open_]
            hi, lo = np.maximum(lr, lc), np.minimum(lr, lc)
            # each root is hooked once, to one smaller label, by the link written last for it
            pick = np.full(len(nodes), -1)
            pick[hi] = np.arange(len(hi))
            roots = np.flatnonzero(pick >= 0)
            k = pick[roots]
            us.append(r[k]), vs.append(c[k])
            label[roots] = lo[k]
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label = up
    if not us:
        return nodes[:0], nodes[:0]
    return nodes[np.concatenate(us)], nodes[np.concatenate(vs)]


def links(fps: DataFrame, radius: int = 4, tile: int = TILE) -> DataFrame:
    """u, v: links that connect all distinct values of fps.fp within the radius just as all pairs would."""
    spark = fps.sparkSession
    per_count = fps.groupBy(F.bit_count("fp").alias("pc")).agg(F.ceil(F.count("*") / tile).alias("parts")).where("pc is not null")
    # 65 rows at most; twice the parts needed, so that hashing into them can't overfill one
    dealt = fps.where("fp is not null").withColumn("pc", F.bit_count("fp")).join(F.broadcast(per_count), "pc")
    dealt = dealt.select("pc", F.expr("pmod(xxhash64(fp, 7), 2 * parts)").alias("part"), "fp")
    tiles = dealt.groupBy("pc", "part").agg(F.collect_list("fp").alias("fps"))
    tiles = stage(tiles.select("pc", "part", "fps"), "tiles")
    # tiles are dealt over the sides of a grid of tasks: each goes to one row and one column of it, and a pair of tiles meets once
    size = tiles.agg(F.sum(F.size("fps"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    side = max(math.isqrt(2 * tasks), -(-size // SIDE))
    own = tiles.withColumn("g", F.pmod(F.xxhash64("pc", "part"), F.lit(side)).cast("int"))
    sent = own.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(side - 1)))).select(F.least("g", "k").alias("gi"), F.greatest("g", "k").alias("gj"), "g", "pc", "part", "fps")

    def compare(cell: pd.DataFrame) -> pd.DataFrame:
        rows = [(g, (pc, part), np.asarray(fps, np.int64).view(np.uint64)) for g, pc, part, fps in zip(cell["g"], cell["pc"], cell["part"], cell["fps"], strict=True)]
        gi, gj = int(cell["gi"].iloc[0]), int(cell["gj"].iloc[0])
        us, vs = [], []
        for a in (r for r in rows if r[0] == gi):
            for b in (r for r in rows if r[0] == gj):
                if abs(a[1][0] - b[1][0]) <= radius and (gi != gj or a[1] <= b[1]):
                    u, v = _forest(a[2], None if a[1] == b[1] else b[2], radius)
                    us.append(u), vs.append(v)
        none = np.zeros(0, np.uint64)
        return pd.DataFrame({"u": np.concatenate([none, *us]).view(np.int64), "v": np.concatenate([none, *vs]).view(np.int64)})

    return stage(sent.groupBy("gi", "gj").applyInPandas(compare, "u long, v long"), "near")


def near_duplicates(docs: DataFrame, radius: int = 4, tile: int = TILE) -> DataFrame:
    """doc_id, fp, component_id for every row of docs (doc_id, text).

    Nulls: a null text has no words, so fingerprint zero, linked like any other; a null doc_id stays null
    and never names a component unless all its members are null. Rows of equal text share a fingerprint.
    Rows that repeat a doc_id are rows of their own; of very long texts every shingle counts, in slices.
    An empty table gives no rows. Columns besides doc_id and text are not looked at.
    """
    spark = docs.sparkSession
    ship(spark)
    marked = narrow(docs, "doc_id", "text").select("doc_id", F.pandas_udf(fingerprint_of, "long")("text").alias("fp"))
    marked = stage(marked, "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    near = links(distinct.select("fp"), radius, tile)
    groups = components(near, "u", "v")
    named = distinct.join(groups, distinct.fp == groups.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least_id")
    named = stage(named, "roots")
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_fp = named.join(least, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, radius: int = 4) -> DataFrame:
    """docs without the rows whose component has a smaller doc_id; of rows that repeat the kept doc_id all stay.

    Rows of null doc_id stay.
    """
    marks = near_duplicates(docs, radius).where("doc_id != component_id").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(marks, docs["doc_id"] == marks["gone_id"], "left_anti")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
