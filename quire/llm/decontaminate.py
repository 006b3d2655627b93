"""Benchmark decontamination with an FM-index per training shard.

Each task gathers documents into shards of about SHARD words, sorts the shard's suffixes, keeps
its Burrows-Wheeler transform in a wavelet matrix and runs all test phrases backwards through it
at once. Matches are located by sampled suffix positions and merged into removal spans.

Words that no test phrase has act as separators, as do document ends, so that matches cross neither.
Test phrases are the stated query set. They are taken in blocks of bounded size, each broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import narrow, ship, stage, table

WINDOW = 10
SHARD = 500_000
BLOCK = 200_000
SAMPLE = 4
_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")


def folded(text: str | None) -> bytes:
    """Lower-case UTF-8 in which every byte outside of words is a space; positions stay."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_KEEP)


class WaveletMatrix:
    """rank(c, i): how often symbol c stands before place i; access(i): the symbol there."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels: list[tuple[int, np.ndarray, int]] = []
        now = symbols
        for bit in reversed(range(max(1, int(sigma).bit_length()))):
            ones = (now >> bit & 1).astype(bool)
            before = np.zeros(len(now) + 1, np.int32)
            np.cumsum(ones, out=before[1:])
            zeros = len(now) - int(before[-1])
            self.levels.append((bit, before, zeros))
            now = np.concatenate([now[~ones], now[ones]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        start = np.zeros(len(i), np.int64)
        for bit, before, zeros in self.levels:
            one = (c >> bit & 1).astype(bool)
            bs, bi = before[start], before[i]
            start = np.where(one, zeros + bs, start - bs)
            i = np.where(one, zeros + bi, i - bi)
        return i - start

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at i, and how often each stands before its place."""
        c = np.zeros(len(i), np.int64)
        start = np.zeros(len(i), np.int64)
        for bit, before, zeros in self.levels:
            bi, bs = before[i], before[start]
            one = before[i + 1] > bi
            c |= one.astype(np.int64) << bit
            start = np.where(one, zeros + bs, start - bs)
            i = np.where(one, zeros + bi, i - bi)
        return c, i - start


def suffix_order(keys: np.ndarray) -> np.ndarray:
    """Starts of suffixes in order, by prefix doubling over those not told apart yet; the last key must be unique."""
    order = np.argsort(keys, kind="stable")
    first = np.concatenate([[True], np.diff(keys[order]) != 0])
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))
    alone = first & np.append(first[1:], True)
    live = order[~alone]
    step = 1
    while len(live):
        key = rank[live] * (len(keys) + 1) + rank[live + step]
        live = live[np.argsort(key, kind="stable")]
        old, nxt = rank[live], rank[live + step]
        index = np.arange(len(live))
        head = np.concatenate([[True], np.diff(old) != 0])
        first = head | np.concatenate([[True], np.diff(nxt) != 0])
        place = old + index - np.maximum.accumulate(np.where(head, index, 0))
        rank[live] = np.maximum.accumulate(np.where(first, place, 0))
        live = live[~(first & np.append(first[1:], True))]
        step *= 2
    order[rank] = np.arange(len(keys))
    return order


class FMIndex:
    """symbols: 0 is a separator, unlike every other symbol and every other separator; the last one must be 0."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        gaps = symbols == 0
        count = int(gaps.sum())
        order = suffix_order(np.where(gaps, np.cumsum(gaps) - 1, count + symbols))
        last = symbols[order - 1]  # of position 0, that is the separator at the end
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma + 1))])
        self.tree = WaveletMatrix(last, sigma)
        self.kept = (order % SAMPLE == 0) | (last == 0)
        self.at_kept = np.cumsum(self.kept) - 1
        self.sampled = order[self.kept]
        self.size = len(symbols)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For phrases aligned to the right of the matrix: those found, and the bounds of their rows."""
        which = np.arange(len(phrases))
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), self.size, np.int64)
        for k in range(1, phrases.shape[1] + 1):
            step = lengths[which] >= k
            c = phrases[which, -k].astype(np.int64)
            lo = np.where(step, self.first[c] + self.tree.rank(c, lo), lo)
            hi = np.where(step, self.first[c] + self.tree.rank(c, hi), hi)
            alive = lo < hi
            which, lo, hi = which[alive], lo[alive], hi[alive]
        return which, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        walked = 0
        while len(open_):
            done = self.kept[rows]
            out[open_[done]] = self.sampled[self.at_kept[rows[done]]] + walked
            rows, open_ = rows[~done], open_[~done]
            c, before = self.tree.access(rows)
            rows = self.first[c] + before
            walked += 1
        return out


class Phrases:
    """A block of test phrases: words by id, phrases as rows of ids aligned right, and the items of each."""

    def __init__(self, rows: list[tuple[list[bytes], list]], window: int):
        self.ids: dict[bytes, int] = {}
        self.length = np.array([len(words) for words, _ in rows], np.int64)
        self.matrix = np.zeros((len(rows), window), np.int32)
        for k, (words, _) in enumerate(rows):
            self.matrix[k, window - len(words) :] = [self.ids.setdefault(w, len(self.ids) + 1) for w in words]
        self.items = [items for _, items in rows]


def phrase_rows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """words, items: each distinct window with the items that have it; an item of fewer words is one window."""

    def split(text: pd.Series) -> pd.Series:
        return pd.Series([[w.decode("utf-8", "surrogatepass") for w in folded(t).split()] for t in text])

    words = narrow(benchmark, "item_id", "text").withColumn("w", F.pandas_udf(split, "array<string>")("text")).where("size(w) > 0 and item_id is not null")
    each = words.select("item_id", F.explode(F.expr(f"transform(sequence(1, greatest(1, size(w) - {window - 1})), i -> slice(w, i, {window}))")).alias("words"))
    return each.groupBy("words").agg(F.collect_set("item_id").alias("items"))


def _shards(texts: Iterator[pd.Series], ids: dict[bytes, int], most: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Texts of about `most` words in all, their symbols with a separator after each text, and where texts start."""
    get, held, symbols, size = ids.get, [], [], 0
    for batch in texts:
        for text in batch:
            words = folded(text).split()
            own = np.zeros(len(words) + 1, np.int64)
            own[:-1] = np.fromiter(map(get, words, repeat(0)), np.int64, len(words))
            held.append(text), symbols.append(own)
            size += len(own)
            if size >= most:
                yield held, np.concatenate(symbols), np.cumsum([0, *map(len, symbols)])
                held, symbols, size = [], [], 0
    if symbols:
        yield held, np.concatenate(symbols), np.cumsum([0, *map(len, symbols)])


def _hits(symbols: np.ndarray, starts: np.ndarray, block: Phrases) -> tuple[np.ndarray, dict[int, list]]:
    """A mark for each word inside a match, and the items found, by row."""
    index = FMIndex(symbols, len(block.ids))
    which, lo, hi = index.search(block.matrix, block.length)
    counts = hi - lo
    rows = np.repeat(lo - np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(lo) else lo, counts) + np.arange(counts.sum())
    place = index.locate(rows)
    phrase = np.repeat(which, counts)
    edges = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(edges, place, 1)
    np.add.at(edges, place + block.length[phrase], -1)
    row = np.searchsorted(starts, place, side="right") - 1
    items: dict[int, set] = {}
    for r, p in np.unique(np.stack([row, phrase]), axis=1).T if len(row) else ():
        items.setdefault(int(r), set()).update(block.items[p])
    return np.cumsum(edges[:-1]) > 0, {r: sorted(x) for r, x in items.items()}


def _spans(mark: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mark.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist(), strict=True))


def _blocks(docs: DataFrame, benchmark: DataFrame, window: int, block: int) -> list:
    """The phrases in blocks of about `block` each at most, as broadcasts."""
    spark = docs.sparkSession
    phrases = stage(phrase_rows(benchmark, window), "phrases")
    count = max(1, -(-phrases.count() // block))
    out = []
    for k in range(count):
        rows = phrases.where(F.expr(f"pmod(xxhash64(words, 11), {count}) = {k}")).collect()
        out.append(spark.sparkContext.broadcast(Phrases([([w.encode("utf-8", "surrogatepass") for w in r["words"]], list(r["items"])) for r in rows], window)))
    return out


def _with_spans(docs: DataFrame, benchmark: DataFrame, window: int, shard: int, block: int) -> DataFrame:
    """docs and a column _found: n_words, spans, items."""
    ship(docs.sparkSession)
    kind = benchmark.schema["item_id"].dataType.simpleString()

    def job(phrases):
        def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for held, symbols, starts in _shards(texts, phrases.value.ids, shard):
                mark, items = _hits(symbols, starts, phrases.value)
                total = np.concatenate([[0], np.cumsum(mark)])
                hit = total[starts[1:]] > total[starts[:-1]]
                spans = [_spans(mark[a : b - 1]) if h else [] for a, b, h in zip(starts[:-1], starts[1:], hit, strict=True)]
                yield pd.DataFrame({"n_words": np.diff(starts) - 1, "first": [[x for x, _ in s] for s in spans], "count": [[x for _, x in s] for s in spans], "items": [items.get(k, []) for k in range(len(held))]})

        run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
        return F.pandas_udf(run, f"n_words long, first array<long>, count array<long>, items array<{kind}>")

    blocks = _blocks(docs, benchmark, window, block)
    names = [f"_block{k}" for k in range(len(blocks))]
    for name, phrases in zip(names, blocks, strict=True):
        docs = docs.withColumn(name, job(phrases)("text"))
    spans = F.flatten(F.array(*[F.expr(f"zip_with({n}.first, {n}.count, (a, b) -> struct(a AS start, b AS length))") for n in names]))
    if len(blocks) > 1:
        spans = _merged(F.array_sort(spans))
    items = F.array_distinct(F.flatten(F.array(*[F.col(f"{n}.items") for n in names])))
    return docs.withColumn("_found", F.struct(F.col(f"{names[0]}.n_words").alias("n_words"), spans.alias("spans"), items.alias("items"))).drop(*names)


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, spans (array of first word and number of words, merged), items (item_ids), a row for each of docs.

    Null texts have no words; items of null text or null item_id ask for nothing; rows of equal text give
    equal results, rows that repeat a doc_id each their own. A text of more than `shard` words is a shard of its own. Words are
    compared by their bytes; other columns are not looked at. With no phrase at all, or no rows, the spans or the result are empty.
    """
    return _with_spans(narrow(docs, "doc_id", "text"), benchmark, window, shard, block).select("doc_id", "_found.n_words", "_found.spans", "_found.items")


def _merged(spans: Column) -> Column:
    """Spans sorted by start, with those that overlap or touch joined."""

    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        end = F.greatest(last["start"] + last["length"], x["start"] + x["length"])
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), (end - last["start"]).alias("length"))))
        return F.when((F.size(done) > 0) & (x["start"] <= F.get(done, F.size(done) - 1)["start"] + F.get(done, F.size(done) - 1)["length"]), joined).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(spans, F.slice(spans, 1, 0), add)


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of spans and what stands between them; other characters stay."""
    raw = text.encode("utf-8", "surrogatepass")
    words = [m.span() for m in _WORD.finditer(folded(text))]
    out, at = [], 0
    for start, length in spans:
        out.append(raw[at : words[start][0]])
        at = words[start + length - 1][1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """docs with the removal spans cut out of text and n_chars (if there is such a column) counted anew where that
    took something; rows and other columns stay."""

    def cut(text: pd.Series, first: pd.Series, count: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else cut_spans(t, list(zip(a, n, strict=True))) for t, a, n in zip(text, first, count, strict=True)], dtype=object)

    hit = F.size("_found.spans") > 0
    cut_text = F.pandas_udf(cut, "string")(F.when(hit, F.col("text")), F.col("_found.spans.start"), F.col("_found.spans.length"))
    found = _with_spans(docs, benchmark, window, shard, block).withColumn("_cut", cut_text)
    text = F.when(hit, F.col("_cut")).otherwise(F.col("text"))
    out = {"text": text}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(hit, F.length("_cut").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.select(*[out[c].alias(c) if c in out else F.col(f"`{c}`") for c in docs.columns])


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.concat_ws(",", F.array_sort(F.col("items").cast("array<string>")))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["length"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (hit > 0).alias("contaminated"))
