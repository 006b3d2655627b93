"""Removal of long repeated byte strings with a column-wise multi-document suffix construction.

A byte goes if a LENGTH-byte string that covers it also starts in a document of smaller doc_id.

Every LENGTH-byte window is assigned to one of its K-grams, its minimizer, which depends on the window's
bytes alone: equal windows share it. The windows of one minimizer are a short snippet. Minimizers that two
documents have are sent to buckets by their hash with their snippets, equal ones once per block of documents.
A bucket's snippets, with the minimizer as one symbol, form collections whose Burrows-Wheeler transform and common
prefixes are built column by column: each round inserts one symbol of every snippet, right to left, reading the
previous round's files and writing the next ones in sequence. Suffixes with a common prefix of DEPTH symbols are
equal windows, and the smallest doc_id among them goes back to the blocks, which take out the bytes. Blocks
pre-aggregate what many documents share; a minimizer that very many blocks have is split by whole windows over the
buckets. The files belong to one task, which reads and removes them, and lie where Spark lets tasks spill.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, stage, table
from .suffixes import covered

LENGTH = 50
K = 24
#: Symbols of a window whose K-gram is one symbol.
DEPTH = LENGTH - K + 1
#: Raw bytes of documents in a block, and of blocks that one bucket stands for.
BLOCK, BUCKET = 1 << 20, 8 << 20
#: Snippets in a collection (a minimizer's are not parted), and blocks from which a minimizer is split by windows.
COLLECTION, HOT = 1 << 15, 4096
NO_ID = np.iinfo(np.int64).max
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _press(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(raw)


def _unpress(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(raw)


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= _MIX[3]
    h ^= h >> np.uint64(29)
    return h


def _grams(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the size bytes from each place, for sizes of 24 and over; the last bytes overlap to fit."""
    at = lambda k: np.ndarray(len(data) - size + 1, "<u8", data, k, (1,))
    h = np.zeros(len(data) - size + 1, np.uint64)
    for k in [*range(0, size - 8, 8), size - 8]:
        h ^= at(k)
        h *= _MIX[k // 8 % 3]
        h ^= h >> np.uint64(31)
    return _mixed(h)


def _minimizers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window its minimizer's place (the leftmost least hash), and all K-gram hashes."""
    h = _grams(data, K)
    span = LENGTH - K + 1
    least, place, width = h, np.arange(len(h), dtype=np.int32), 1
    while 2 * width <= span:
        least, place = _lesser(least[:-width], place[:-width], least[width:], place[width:])
        width *= 2
    if width < span:
        d = span - width
        least, place = _lesser(least[:-d], place[:-d], least[d:], place[d:])
    return place, h


def _lesser(a, i, b, j):
    right = b < a
    return np.where(right, b, a), np.where(right, j, i)


class Segments:
    """Runs of windows of one document with one minimizer: first and last window, the minimizer's place and hash, the document's number."""

    FIELDS = ("first", "last", "at", "hash", "doc")

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        none = np.zeros(0, np.int64)
        self.first, self.last, self.at, self.hash, self.doc = none, none, none, np.zeros(0, np.uint64), none
        self.data = data
        if len(data) < LENGTH:
            return
        place, h = _minimizers(data)
        doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[: len(place)]
        whole = np.arange(len(place)) + LENGTH <= starts[1:][doc]
        cut = np.ones(len(place), bool)
        cut[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]) | ~whole[:-1]
        begin = np.flatnonzero(cut & whole)
        ends = np.flatnonzero(np.append(cut[1:] | ~whole[1:], True) & whole)
        # least hashes are small ones: mixed again, they spread evenly over buckets
        at = place[begin].astype(np.int64)
        self.first, self.last, self.at, self.hash, self.doc = begin, ends, at, _mixed(h[at]), doc[begin]

    def take(self, keep: np.ndarray) -> None:
        for name in self.FIELDS:
            setattr(self, name, getattr(self, name)[keep])

    def split(self, hot: np.ndarray) -> None:
        """Segments marked hot become one segment a window, with a hash of the whole window; its first bytes stand for the minimizer."""
        if not hot.any():
            return
        first = _ranges(self.first[hot], self.last[hot] + 1)
        doc = np.repeat(self.doc[hot], self.last[hot] + 1 - self.first[hot])
        rows = self.data[first[:, None] + np.arange(LENGTH)]
        h = _row_hash(rows)
        self.take(~hot)
        for name, more in zip(self.FIELDS, (first, first, first, h, doc), strict=True):
            setattr(self, name, np.concatenate([getattr(self, name), more]))


def _ranges(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All places of the ranges from a up to b, one range after the other."""
    n = b - a
    return np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else a, n) + np.arange(n.sum())


def _row_hash(rows: np.ndarray) -> np.ndarray:
    padded = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    padded[:, : rows.shape[1]] = rows
    h = np.full(len(rows), 77, np.uint64)
    for column in padded.view("<u8").T:
        h ^= column
        h *= _MIX[0]
        h ^= h >> np.uint64(30)
    return _mixed(h)


WIDTH = 2 * LENGTH - K


def _snippets(seg: Segments) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct snippets in order of their hash: hashes, bytes before the minimizer, lengths, bytes in rows of WIDTH; and each segment's number."""
    length = seg.last - seg.first + LENGTH
    column = np.arange(WIDTH, dtype=np.int32)
    rows = np.zeros((len(length), WIDTH), np.uint8)
    for at in range(0, len(length), 8192):
        some = slice(at, at + 8192)
        where = np.minimum(seg.first[some, None].astype(np.int32) + column, len(seg.data) - 1)
        rows[some] = seg.data[where] * (column < length[some, None])
    return _distinct(seg.hash, seg.at - seg.first, length, rows)


def _distinct(h: np.ndarray, left: np.ndarray, length: np.ndarray, rows: np.ndarray):
    key = np.zeros((len(h), 10 + WIDTH), np.uint8)
    key[:, :8] = h.astype(">u8").view(np.uint8).reshape(-1, 8)
    key[:, 8], key[:, 9] = length, left
    key[:, 10:] = rows
    # rows are told apart by a second hash first, which is far cheaper to sort than their bytes
    order = np.lexsort([_row_hash(key), h])
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]).any(axis=1)
    number = np.empty(len(key), np.int64)
    number[order] = np.cumsum(new) - 1
    return h[order][new], left[order][new], length[order][new], key[new][:, 10:], number


def symbols(left: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The snippets with one symbol for the minimizer: bytes are 0 to 255, and equal minimizers have equal numbers from 256 on."""
    each = np.arange(len(left))[:, None]
    _, gram = np.unique(rows[each, left[:, None] + np.arange(K)].view(f"S{K}").ravel(), return_inverse=True)
    column = np.arange(2 * DEPTH - 1)
    out = rows[each, column + (K - 1) * (column > left[:, None])].astype(np.int32)
    out[each[:, 0], left] = 256 + gram
    return out


STRIDE = 32


def range_minima(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min(x[a:b]) for each of many ranges, none empty; long ones go by the minima of STRIDE places."""
    out = np.empty(len(a), x.dtype)
    x = np.append(x, np.full(-len(x) % STRIDE + STRIDE, np.iinfo(x.dtype).max, x.dtype))
    least = lambda y, lo, hi: np.minimum.reduceat(y, np.stack([lo, hi], axis=1).ravel())[::2] if len(lo) else y[:0]
    short = b - a <= 2 * STRIDE
    out[short] = least(x, a[short], b[short])
    a, b = a[~short], b[~short]
    head, tail = -(-a // STRIDE), b // STRIDE
    ends = np.minimum(least(x, a, head * STRIDE), least(x, np.minimum(tail * STRIDE, b - 1), b))
    out[~short] = np.minimum(ends, least(x.reshape(-1, STRIDE).min(axis=1), head, tail))
    return out


def _scratch() -> str:
    """A folder for the files of one task: one of those that Spark has given the executor for spilled data, if it says so."""
    return tempfile.mkdtemp(prefix="collection-", dir=(os.environ.get("SPARK_LOCAL_DIRS") or tempfile.gettempdir()).split(",")[0])


class Column:
    """An array in two files used in turn: each round reads one from its start to its end and writes the other."""

    def __init__(self, folder: str, name: str, kind: str, first: np.ndarray):
        self.kind = kind
        self.files = [open(os.path.join(folder, f"{name}{k}"), "w+b", buffering=0) for k in (0, 1)]  # noqa: SIM115
        self.write(first)

    def write(self, x: np.ndarray) -> None:
        self.files.reverse()
        self.files[0].seek(0)
        self.files[0].write(np.ascontiguousarray(x, self.kind))
        self.files[0].truncate()

    def read(self) -> np.ndarray:
        self.files[0].seek(0)
        return np.frombuffer(self.files[0].read(), self.kind)

    def close(self) -> None:
        for f in self.files:
            f.close()


def collection_groups(rows: np.ndarray, lengths: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix of `depth` symbols or more, by string and then by start, a number of its first `depth` symbols.

    Builds the collection's transform and common prefixes. Symbols are taken plus one, as 0 ends a string. After
    round r the files hold, for all suffixes of r symbols at most in order, the symbol before each and the length it
    shares with the one above it. The rows of each symbol, kept in order, give the ranks that place the next column.
    """
    count, most = len(lengths), int(lengths.max(initial=0))
    mask = (1 << 40) - 1

    def before(strings: np.ndarray, r: int) -> np.ndarray:
        """The symbols before the suffixes of r - 1 symbols."""
        found = rows[strings, np.maximum(lengths[strings] - r, 0)].astype(np.int64) + 1
        return np.where(lengths[strings] >= r, found, 0)

    folder = _scratch()
    strings, place = np.arange(count), np.arange(count)
    symbol = before(strings, 1)
    seen = np.sort(symbol << 40 | place)
    transform = Column(folder, "transform", "<u4", symbol)
    shared = Column(folder, "shared", "<u1", np.zeros(count))
    try:
        for r in range(1, most + 1):
            bwt, lcp = transform.read(), shared.read()
            live = symbol > 0
            key = symbol[live] << 40 | place[live]
            sort = np.argsort(key)
            k, strings = np.searchsorted(seen, key[sort]), strings[live][sort]
            shift = count - int(np.searchsorted(seen, 1 << 40))
            # common prefixes of the new rows, and of the rows below them
            new = np.zeros(len(seen) + 1, bool)
            new[k] = new[k + 1] = True
            touched = np.flatnonzero(new[:-1])
            here, above = seen[touched], seen[touched - 1]
            same = (touched > 0) & (here >> 40 == above >> 40)
            value = np.zeros(len(touched), np.uint8)
            value[same] = range_minima(lcp, (above[same] & mask) + 1, (here[same] & mask) + 1) + 1
            place = shift + k
            old = np.ones(len(seen) + len(k), bool)
            old[place] = False
            symbol = before(strings, r + 1)
            where = np.flatnonzero(old)
            next_bwt, next_lcp = np.empty(len(old), np.uint32), np.empty(len(old), np.uint8)
            next_bwt[where], next_bwt[place] = bwt, symbol
            next_lcp[where] = lcp
            next_lcp[shift + touched] = value
            transform.write(next_bwt)
            shared.write(next_lcp)
            seen = (seen & ~mask) | where[seen & mask]
            added = np.sort(symbol << 40 | place)
            seen = np.insert(seen, np.searchsorted(seen, added), added)
        lcp = shared.read()
    finally:
        transform.close()
        shared.close()
        shutil.rmtree(folder)
    # walking back through the transform gives the rows of ever longer suffixes
    step = np.empty(len(seen), np.int64)
    step[seen & mask] = np.arange(len(seen))
    group = np.cumsum(lcp < depth)
    windows = np.maximum(lengths - depth + 1, 0)
    begin = np.concatenate([[0], np.cumsum(windows)])
    out = np.zeros(begin[-1], np.int64)
    strings, row = np.arange(count), np.arange(count)
    for r in range(1, most + 1):
        live = lengths[strings] >= r
        strings, row = strings[live], step[row[live]]
        if r >= depth:
            out[begin[strings] + lengths[strings] - r] = group[row]
    return out


def least_documents(h: np.ndarray, left: np.ndarray, length: np.ndarray, rows: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each window of each snippet, one after the other, the least document that has the window.

    h, left, length, rows and least (document) of snippets that may repeat.
    """
    uh, before, ul, ur, number = _distinct(h, left, length, rows)
    low = np.full(len(uh), NO_ID)
    np.minimum.at(low, number, least)
    windows = ul - LENGTH + 1
    begin = np.concatenate([[0], np.cumsum(windows)])
    found = np.repeat(low, windows)
    # a snippet that is the only one with its minimizer shares no window with another: its windows' least document is its own
    new = np.concatenate([[True], uh[1:] != uh[:-1]]) if len(uh) else np.zeros(0, bool)
    shared = np.flatnonzero(~(new & np.append(new[1:], True)))
    heads = np.flatnonzero(new[shared])
    cuts = [0]
    for a, b in zip(heads, [*heads[1:], len(shared)], strict=False):
        if b - cuts[-1] > COLLECTION and a > cuts[-1]:
            cuts.append(int(a))
    for a, b in zip(cuts, [*cuts[1:], len(shared)], strict=True):
        if a == b:
            continue
        own = shared[a:b]
        group = collection_groups(symbols(before[own], ur[own]), ul[own] - K + 1, DEPTH)
        best = np.full(group.max() + 1, NO_ID)
        np.minimum.at(best, group, np.repeat(low[own], windows[own]))
        found[_ranges(begin[own], begin[own + 1])] = best[group]
    return found[_ranges(begin[number], begin[number + 1])]


class Block:
    """Some documents: their ids, where each starts, and their bytes."""

    def __init__(self, row):
        self.ids = np.frombuffer(row.ids, np.int64)
        self.known = np.frombuffer(row.known, np.uint8).astype(bool)
        self.starts = np.concatenate([[0], np.cumsum(np.frombuffer(row.lens, np.int64))])
        self.data = np.frombuffer(_unpress(row.data), np.uint8)
        self.segments = Segments(self.data, self.starts)

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct hashes in order, and whether documents of different ids have each."""
        seg = self.segments
        ids = self.ids[seg.doc]
        order = np.lexsort([ids, seg.hash])
        h, ids = seg.hash[order], ids[order]
        new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(h)) - 1 if len(h) else at
        return h[new], ids[at] != ids[last]

    def narrow(self, verdict: np.ndarray) -> None:
        """Keeps the segments whose hash has a verdict: 1, or 2 for those to be split by windows."""
        h, _ = self.hashes()
        each = verdict[np.searchsorted(h, self.segments.hash)]
        self.segments.take(each > 0)
        self.segments.split(each[each > 0] == 2)


def _bucket_bounds(h: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted(_bucket(h, buckets), np.arange(buckets + 1))


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def _to_blocks(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 33
    ids, known, texts, size = [], [], [], 0

    def made():
        return pd.DataFrame({"block": [number], "ids": [np.array(ids, np.int64).tobytes()], "known": [np.array(known, np.uint8).tobytes()], "lens": [np.array([len(t) for t in texts], np.int64).tobytes()], "data": [_press(b"".join(texts))], "raw": [size]})

    for batch in batches:
        for i, ok, t in zip(batch["id"], batch["known"], batch["text"], strict=True):
            ids.append(i), known.append(ok), texts.append(t.encode("utf-8", "surrogatepass") if t else b"")
            size += len(texts[-1])
            if size >= most:
                yield made()
                number += 1
                ids, known, texts, size = [], [], [], 0
    if ids:
        yield made()


def _packed_verdicts(rows) -> np.ndarray:
    """A block's verdicts, bucket after bucket."""
    parts = sorted(rows if rows is not None else [], key=lambda r: r["bucket"])
    return np.concatenate([np.zeros(0, np.uint8), *[np.frombuffer(_unpress(r["found"]), np.uint8) for r in parts]])


def remove_repeats(docs: DataFrame, block: int = BLOCK, bucket: int = BUCKET, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, spans (array of start and length of what was removed, in bytes), kept (binary), a row for each of docs.

    A null text is empty. A null doc_id counts as larger than every other, so that such rows lose what others have
    and take nothing away; rows that share a doc_id take nothing from one another. Bytes are judged on the input
    alone. A text of more than `block` bytes makes a block of its own. An empty table gives no rows; columns besides doc_id (taken as
    a long) and text are not looked at.
    """
    spark = docs.sparkSession
    ship(spark)
    given = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID))).alias("id"), F.col("doc_id").isNotNull().alias("known"), "text")
    blocks = stage(given.mapInPandas(lambda b: _to_blocks(b, block), "block long, ids binary, known binary, lens binary, data binary, raw long"), "blocks")
    raw = blocks.agg(F.sum("raw")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-raw // bucket))

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                h, many = Block(row).hashes()
                cut = _bucket_bounds(h, buckets)
                short = h.view(np.uint8).reshape(-1, 8)[:, :5]
                some = np.flatnonzero(np.diff(cut))
                yield pd.DataFrame({"bucket": some, "block": row.block, "short": [short[cut[k] : cut[k + 1]].tobytes() for k in some], "many": [np.packbits(many[cut[k] : cut[k + 1]]).tobytes() for k in some]})

    def verdicts(group: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(x, np.uint8).reshape(-1, 5) for x in group["short"]]
        sizes = np.array([len(p) for p in parts])
        wide = np.zeros((sizes.sum(), 8), np.uint8)
        wide[:, :5] = np.concatenate(parts)
        many = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=n) for m, n in zip(group["many"], sizes, strict=True)])
        _, number, seen = np.unique(wide.view("<u8").ravel(), return_inverse=True, return_counts=True)
        twice = np.bincount(number, many) > 0
        verdict = np.where(seen > hot, 2, (seen > 1) | twice)[number].astype(np.uint8)
        return pd.DataFrame({"bucket": group["bucket"], "block": group["block"], "found": [_press(x.tobytes()) for x in np.split(verdict, np.cumsum(sizes)[:-1])]})

    sent = blocks.mapInPandas(hashes, "bucket long, block long, short binary, many binary")
    found = sent.groupBy("bucket").applyInPandas(verdicts, "bucket long, block long, found binary")
    found = found.groupBy("block").agg(F.collect_list(F.struct("bucket", "found")).alias("verdicts"))
    found = stage(found, "verdicts")
    marked = blocks.drop("raw").join(found, "block", "left")

    def snippets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                b = Block(row)
                b.narrow(_packed_verdicts(row.verdicts))
                h, left, length, rows, number = _snippets(b.segments)
                least = np.full(len(h), NO_ID)
                np.minimum.at(least, number, b.ids[b.segments.doc])
                cut = _bucket_bounds(h, buckets)
                some = np.flatnonzero(np.diff(cut))
                parts = [slice(cut[k], cut[k + 1]) for k in some]
                yield pd.DataFrame({"bucket": some, "block": row.block, "n": np.diff(cut)[some], "body": [_press(h[p].tobytes() + least[p].tobytes() + left[p].astype(np.uint8).tobytes() + length[p].astype(np.uint8).tobytes() + rows[p].tobytes()) for p in parts]})

    def resolve(group: pd.DataFrame) -> pd.DataFrame:
        columns = [[], [], [], [], []]
        for n, body in zip(group["n"], group["body"], strict=True):
            raw = np.frombuffer(_unpress(body), np.uint8)
            columns[0].append(raw[: 8 * n].view(np.uint64))
            columns[1].append(raw[8 * n : 16 * n].view(np.int64))
            columns[2].append(raw[16 * n : 17 * n].astype(np.int64))
            columns[3].append(raw[17 * n : 18 * n].astype(np.int64))
            columns[4].append(raw[18 * n :].reshape(n, WIDTH))
        h, least, left, length, rows = map(np.concatenate, columns)
        low = least_documents(h, left, length, rows, least)
        ends = np.cumsum([(part - LENGTH + 1).sum() for part in columns[3]])
        return pd.DataFrame({"bucket": group["bucket"], "block": group["block"], "low": [_press(x.tobytes()) for x in np.split(low, ends[:-1])]})

    asked = marked.mapInPandas(snippets, "bucket long, block long, n long, body binary")
    told = asked.groupBy("bucket").applyInPandas(resolve, "bucket long, block long, low binary")
    told = told.groupBy("block").agg(F.collect_list(F.struct("bucket", "low")).alias("lows"))
    return marked.join(told, "block", "left").mapInPandas(_cleaned, "doc_id long, n_bytes long, spans array<array<long>>, kept binary")


def _cleaned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples():
            b = Block(row)
            b.narrow(_packed_verdicts(row.verdicts))
            seg = b.segments
            _, _, length, _, number = _snippets(seg)
            parts = sorted(row.lows if row.lows is not None else [], key=lambda r: r["bucket"])
            low = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(_unpress(r["low"]), np.int64) for r in parts]])
            begin = np.concatenate([[0], np.cumsum(length - LENGTH + 1)])
            windows = _ranges(seg.first, seg.last + 1)
            owner = np.repeat(b.ids[seg.doc], seg.last + 1 - seg.first)
            start = windows[low[_ranges(begin[number], begin[number + 1])] < owner]
            gone = covered(start, np.full(len(start), LENGTH), len(b.data))
            edge = np.zeros(len(b.data) + 1, bool)
            edge[1:-1] = gone[1:] != gone[:-1]
            edge[b.starts] = True
            cuts = np.flatnonzero(edge)
            runs = np.stack([cuts[:-1], np.diff(cuts)], axis=1)[gone[cuts[:-1]]] if len(b.data) else np.zeros((0, 2), np.int64)
            at = np.searchsorted(runs[:, 0], b.starts)
            spans, kept = [], []
            for d, (a, z) in enumerate(zip(b.starts[:-1], b.starts[1:], strict=True)):
                own = runs[at[d] : at[d + 1]]
                spans.append((own - [a, 0]).tolist())
                kept.append(b.data[a:z][~gone[a:z]].tobytes() if len(own) else b.data[a:z].tobytes())
            yield pd.DataFrame({"doc_id": pd.array(b.ids, "Int64").copy(), "n_bytes": np.diff(b.starts), "spans": spans, "kept": kept}).assign(doc_id=lambda x, b=b: x["doc_id"].where(b.known))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return found.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
