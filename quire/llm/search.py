"""Ranked lexical search by hashed max-sketches.

The index has for each document its distinct terms with their counts, and a sketch of fixed size: terms are hashed to `SLOTS`
places, and each place holds the greatest impact of its terms, rounded up to one byte. A query's bound on a document is the sum of
its terms' weights times what stands at their places: never below the score. A block of queries is looked up for many documents
at once.

The twenty documents of the highest bounds are rescored first; the twentieth of their scores is a threshold that no result lies
under. Then every task walks the documents whose bounds reach the threshold, from the highest bound down, rescores them exactly and
stops at the first bound below its own twentieth score. All is integer arithmetic, so that results are exact.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import narrow, ship, stage, table

SLOTS = 4096
#: Impacts are below a million; a byte of the sketch counts steps of this size.
STEP = 3922
TOP = 20
#: Documents whose bounds are made at once, and the most that a block of queries may weigh on its way to the tasks.
ROWS = 1024
BLOCK_BYTES = 8 << 20
BLOCK_ITEMS = 2048
#: What a term is made of. Bytes from 0x80 on belong to characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
INDEX = "doc_id long, n long, sketch binary, terms array<binary>, counts array<int>"


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and characters beyond ASCII; only A-Z are lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN).split() if text else []


def slot(term: bytes) -> int:
    return zlib.crc32(term) % SLOTS


class _Slots(dict):
    """slot() of the terms met so far."""

    def __missing__(self, term: bytes) -> int:
        self[term] = found = slot(term)
        return found


def burden(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """m of documents with n terms each, among `docs` documents that have `total` terms."""
    return 75 + 25 * n * docs // total


def statistics(docs: DataFrame) -> tuple[int, int]:
    """N and L: documents with a term, and their terms with repeats."""
    n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(TERM)).cast("long")
    found = narrow(docs, "text").select(n.alias("n")).agg(F.sum((F.col("n") > 0).cast("long")).alias("docs"), F.sum("n").alias("total")).first()
    return found["docs"] or 0, found["total"] or 0


def build_index(docs: DataFrame, size: tuple[int, int] | None = None) -> DataFrame:
    """row, doc_id, n, sketch, terms, counts: a row for each document with a term, as a table in the shared folder.

    Rows that repeat a doc_id are documents of their own; doc_id is taken as a long, a null one stays null, and columns besides
    doc_id and text are not looked at. Texts of any length are indexed whole. size: N and L, counted where not given.
    """
    spark = docs.sparkSession
    ship(spark)
    many, total = size or statistics(docs)

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        places = _Slots()
        for batch in _batches(batches):
            sizes, sketches, flat, counts = [], [], [], []
            keep = []
            for k, text in enumerate(batch.column("text").to_pylist()):
                counted = Counter(terms(text))
                if not counted:
                    continue
                if len(places) > 500_000:
                    places.clear()
                keep.append(k), flat.extend(counted)
                tf = np.fromiter(counted.values(), np.int64, len(counted))
                sizes.append(int(tf.sum())), counts.append(tf.astype(np.int32))
                impact = 1_000_000_000 * tf // (1000 * tf + 12 * int(burden(sizes[-1], many, total)))
                sketch = np.zeros(SLOTS, np.uint8)
                np.maximum.at(sketch, np.fromiter(map(places.__getitem__, counted), np.int64, len(counted)), (-(-impact // STEP)).astype(np.uint8))
                sketches.append(sketch.tobytes())
            if keep:
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(c) for c in counts])]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, v) for v in (pa.array(flat, pa.binary()), pa.array(np.concatenate(counts)))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(keep)), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), *lists], ["doc_id", "n", "sketch", "terms", "counts"])

    given = narrow(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stage(given.mapInArrow(rows, INDEX).withColumn("row", F.monotonically_increasing_id()), "index")


def _asked(items: DataFrame, index: DataFrame) -> DataFrame:
    """item (a number for each row of items), item_id, term, times, df; as a table."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(item, name, term, n) for item, name, text in zip(batch["item"], batch["item_id"], batch["text"], strict=True) for term, n in Counter(terms(text)).items()]
            yield pd.DataFrame(out, columns=["item", "item_id", "term", "times"])

    # ids go through Python as text: pandas would make doubles of longs beside nulls
    given = narrow(items, "item_id", "text").select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("string").alias("item_id"), "text")
    made = given.mapInPandas(rows, "item long, item_id string, term binary, times long")
    asked = stage(made.withColumn("item_id", F.col("item_id").cast(items.schema["item_id"].dataType)), "asked")
    # document frequencies are counted before the join, so that a frequent term is one row
    df = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return stage(asked.join(df, "term"), "asked")


def _blocks(asked: DataFrame) -> tuple[DataFrame, list[int]]:
    """asked with a block number, and the blocks that have items; one block fits in every task."""
    weigh = F.sum(F.length("term") + 32).alias("weight")
    whole = asked.agg(weigh, F.count_distinct("item").alias("items")).first()
    if not whole["items"]:
        return asked.withColumn("block", F.lit(0)), []
    blocks = max(1, -(-2 * whole["weight"] // BLOCK_BYTES) - 1, -(-2 * whole["items"] // BLOCK_ITEMS) - 1)
    while True:
        dealt = asked.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
        worst = dealt.groupBy("block").agg(weigh, F.count_distinct("item").alias("items")).where((F.col("items") > 1) & ((F.col("weight") > BLOCK_BYTES) | (F.col("items") > BLOCK_ITEMS)))
        if blocks == 1 or not worst.limit(1).count():
            return dealt, [r["block"] for r in dealt.select("block").distinct().orderBy("block").collect()]
        blocks *= 2


class Block:
    """The weights of some queries' terms: by item for scores, by item and place of the sketch for bounds."""

    def __init__(self, rows: list, docs: int, total: int):
        self.docs, self.total = docs, total
        self.items = sorted({r["item"] for r in rows})
        place = {item: k for k, item in enumerate(self.items)}
        self.weights: list[list[tuple[bytes, int]]] = [[] for _ in self.items]
        for r in rows:
            self.weights[place[r["item"]]].append((bytes(r["term"]), r["times"] * math.floor(1000 * math.log((2 * docs + 2) / (2 * r["df"] + 1)))))
        self.slots = [np.array([slot(t) for t, _ in own], np.int64) for own in self.weights]
        # whole numbers below 2**53, for which sums of doubles are exact
        self.steps = [np.array([w * STEP for _, w in own], np.float64) for own in self.weights]

    def bounds(self, sketches: list[bytes]) -> np.ndarray:
        """A row for each sketch, a column for each item."""
        by_slot = np.ascontiguousarray(np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, SLOTS).T)
        return np.stack([w @ by_slot[s] for w, s in zip(self.steps, self.slots, strict=True)], axis=1)

    def impacts(self, found: list[bytes], counts: np.ndarray, n: int) -> dict[bytes, int]:
        """The impact of each term of a document of n terms."""
        tf = counts.astype(np.int64)
        return dict(zip(found, (1_000_000_000 * tf // (1000 * tf + 12 * int(burden(n, self.docs, self.total)))).tolist(), strict=True))

    def score(self, item: int, impacts: dict[bytes, int]) -> int:
        get = impacts.get
        return sum([w * get(t, 0) for t, w in self.weights[item]])


def _batches(batches: Iterator, size: int = ROWS) -> Iterator:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def _highest_bounds(index: DataFrame, block, top: int) -> DataFrame:
    """item, row of the documents of the highest bounds, `top` an item."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own: Block = block.value
        best = np.zeros((0, len(own.items)))
        ids = np.zeros((0, len(own.items)), np.int64)
        for batch in _batches(batches):
            found = own.bounds(batch.column("sketch").to_pylist())
            rows = np.repeat(batch.column("row").to_numpy()[:, None], len(own.items), axis=1)
            best, ids = np.vstack([best, found]), np.vstack([ids, rows])
            if len(best) > top:
                keep = np.argpartition(-best, top - 1, axis=0)[:top]
                best, ids = np.take_along_axis(best, keep, 0), np.take_along_axis(ids, keep, 0)
        some = best > 0
        items = np.repeat(np.array(own.items, np.int64)[None, :], len(best), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(items[some]), pa.array(ids[some]), pa.array(best[some].astype(np.int64))], ["item", "row", "bound"])

    made = index.select("row", "sketch").mapInArrow(run, "item long, row long, bound long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "row"))
    return made.withColumn("rank", rank).where(F.col("rank") <= top).select("item", "row")


def _seeds(index: DataFrame, block, chosen: DataFrame, top: int) -> dict[int, int]:
    """The `top`-th score among the chosen documents of each item that has as many: at most one number an item of the block."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own: Block = block.value
        place = {item: k for k, item in enumerate(own.items)}
        for batch in _batches(batches):
            items, scores = [], []
            for r in batch.to_pylist():
                impacts = own.impacts(r["terms"], np.array(r["counts"]), r["n"])
                for item in r["items"]:
                    items.append(item), scores.append(own.score(place[item], impacts))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(scores, pa.int64())], ["item", "score"])

    # at most `top` rows for each of the BLOCK_ITEMS items of a block
    by_row = chosen.groupBy("row").agg(F.collect_list("item").alias("items"))
    scored = index.select("row", "n", "terms", "counts").join(F.broadcast(by_row), "row").mapInArrow(run, "item long, score long").where("score > 0")
    lowest = scored.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("score"))
    return {r["item"]: r["score"] for r in lowest.where(F.col("n") >= top).collect()}


def _rescored(index: DataFrame, block, floor: dict[int, int], top: int) -> DataFrame:
    """item, doc_id, score of the documents that may be among the `top` of an item, exactly scored."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own: Block = block.value
        least = np.array([max(floor.get(item, 0), 1) for item in own.items], np.float64)
        # of each item the best so far; the first of a heap is the one to go: the lowest score, of equal ones the last document
        heaps: list[list[tuple[int, float, int | None]]] = [[] for _ in own.items]
        for batch in _batches(batches):
            bounds = own.bounds(batch.column("sketch").to_pylist())
            reach = bounds >= least
            docs, n = batch.column("doc_id").to_pylist(), batch.column("n").to_pylist()
            columns = batch.column("terms"), batch.column("counts")
            known: dict[int, dict[bytes, int]] = {}
            for item in np.flatnonzero(reach.any(axis=0)).tolist():
                heap, rows = heaps[item], np.flatnonzero(reach[:, item])
                for row in rows[np.argsort(-bounds[rows, item], kind="stable")].tolist():
                    if bounds[row, item] < least[item]:
                        break
                    if row not in known:
                        known[row] = own.impacts(columns[0][row].as_py(), columns[1][row].values.to_numpy(), n[row])
                    score = own.score(item, known[row])
                    if score < least[item]:
                        continue
                    doc = docs[row]
                    entry = (score, -math.inf if doc is None else -doc, doc)
                    if len(heap) < top:
                        heapq.heappush(heap, entry)
                    elif entry[:2] > heap[0][:2]:
                        heapq.heapreplace(heap, entry)
                    if len(heap) == top:
                        least[item] = max(least[item], heap[0][0])
        found = [(own.items[k], doc, score) for k, heap in enumerate(heaps) for score, _, doc in heap]
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(3)], ["item", "doc_id", "score"])

    return index.select("doc_id", "n", "sketch", "terms", "counts").mapInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: of each row of items the `top` documents of the highest scores above 0, ties by doc_id.

    Null, empty and blank texts have no terms: such documents are never found, such items find nothing. Every row of items is
    a query of its own, also where item ids repeat or are null; every row of docs is a document of its own, those of null
    doc_id standing last among equal scores. Only item_id, doc_id and text are looked at. Empty tables give no rows.
    """
    spark = docs.sparkSession
    size = statistics(docs)
    index = build_index(docs, size)
    asked, blocks = _blocks(_asked(items, index))
    names = asked.select("item", "item_id").distinct()
    found = spark.createDataFrame([], "item long, doc_id long, score long")
    for b in blocks:
        block = spark.sparkContext.broadcast(Block(asked.where(F.col("block") == b).select("item", "term", "times", "df").collect(), *size))
        floor = _seeds(index, block, _highest_bounds(index, block, top), top)
        found = found.unionByName(_rescored(index, block, floor, top))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = found.withColumn("rank", rank).where(F.col("rank") <= top)
    return best.join(names, "item").select("item_id", "rank", "doc_id", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), q AS (
  SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), s AS (SELECT count(*)::BIGINT AS N, sum(len(t))::BIGINT AS L FROM d WHERE len(t) > 0),
tf AS (SELECT r, doc_id, len(t) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, t, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * s.N + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, s GROUP BY term, s.N),
scored AS (
  SELECT q.i, q.item_id, tf.r, tf.doc_id, sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * (75 + (25 * tf.n * s.N) // s.L))))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN w USING (term), s GROUP BY ALL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""
