"""Language-model scores of whole texts: distributed counts, training and scoring of the model in maxent.py.

Blocks of documents send their distinct words, with counts, to buckets by hash; a bucket adds them up and tells
every block the corpus count of each of its words, so that no vocabulary is ever held whole. Only the frequent
words, of fixed number, and sums reach the driver; so do the summed gradients of a round and the weights, of fixed size.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import maxent as M
from .common import ship, stage, table
from .suffix_dedup import NO_ID, _press, _unpress

BLOCK, BUCKET = 2 << 20, 24 << 20
FOLDS, HELD_OUT = 5, 1
#: Lists of frequent words, or chunks of gradients, that one task joins; more go through further rounds.
FAN_IN = 64


def number_of(doc_id: int, known: bool) -> int:
    return zlib.crc32(str(doc_id).encode() if known else b"")


def held_out(doc_id: int, known: bool) -> bool:
    return number_of(doc_id, known) % FOLDS == HELD_OUT


def _to_blocks(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """Documents in blocks of about `most` bytes, each of documents of one round: distinct words by number, and the numbers of all tokens."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 33
    held: list[list[tuple[int, bool, bytes]]] = [[] for _ in M.ROUNDS]
    sizes = [0] * len(M.ROUNDS)

    def made(k: int) -> pd.DataFrame:
        nonlocal number
        rows, held[k], size, sizes[k] = held[k], [], sizes[k], 0
        number += 1
        ids, known, texts = zip(*rows, strict=True)
        words: defaultdict[bytes, int] = defaultdict(count().__next__)
        end = np.full(1, words[M.END], np.uint32)
        tokens, lens = [], []
        for text in texts:
            own = text.lower().split()
            tokens += [np.fromiter(map(words.__getitem__, own), np.uint32, len(own)), end]
            lens.append(len(own) + 1)
        return pd.DataFrame({"block": [number], "round": [k], "ids": [np.array(ids, np.int64).tobytes()], "known": [np.array(known, np.uint8).tobytes()], "lens": [np.array(lens, np.int64).tobytes()], "words": [_press(b" ".join(words))], "tokens": [_press(np.concatenate(tokens).tobytes())], "raw": [size]})

    for batch in batches:
        for i, ok, t in zip(batch["id"], batch["known"], batch["text"], strict=True):
            k = M.round_of(number_of(i, ok))
            held[k].append((i, ok, t.encode("utf-8", "surrogatepass") if t else b""))
            sizes[k] += len(held[k][-1][2])
            if sizes[k] >= most:
                yield made(k)
    for k, rows in enumerate(held):
        if rows:
            yield made(k)


class Words:
    """A block's tokens: distinct words in order of bucket, the number of each token, where texts start, and which are held out."""

    def __init__(self, row, buckets: int):
        ids = np.frombuffer(row.ids, np.int64)
        known = np.frombuffer(row.known, np.uint8).astype(bool)
        self.ids, self.known = ids, known
        self.held = np.array([held_out(i, k) for i, k in zip(ids.tolist(), known, strict=True)], bool)
        self.begin = np.concatenate([[0], np.cumsum(np.frombuffer(row.lens, np.int64))])
        words, tokens = _unpress(row.words).split(b" "), np.frombuffer(_unpress(row.tokens), np.uint32)
        self.hash = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
        bucket = (self.hash % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.words = [words[k] for k in order.tolist()]
        self.hash, self.bucket = self.hash[order], bucket[order]
        self.tokens = back[tokens]
        self.owner = np.repeat(np.arange(len(ids)), np.diff(self.begin))
        self.first = np.zeros(len(self.tokens), bool)
        self.first[self.begin[:-1]] = True

    def training_counts(self) -> np.ndarray:
        return np.bincount(self.tokens[~self.held[self.owner]], minlength=len(self.words))

    def inputs(self, v: M.Vocabulary, only: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Classes, places and the two words before of the tokens marked in `only`."""
        cls, place = v.slots(self.words)
        before, earlier = M.contexts(self.hash[self.tokens], self.first)
        t = self.tokens[only]
        return cls[t], place[t], before[only], earlier[only]


def _frequent(total: Counter[bytes]) -> list[tuple[bytes, int]]:
    """The words of a full vocabulary that may be in it: the most frequent, and the end of a text in any case."""
    size = M.CLASSES * M.PER_CLASS
    top = sorted(((w, n) for w, n in total.items() if n), key=lambda x: (-x[1], x[0]))[:size]
    if total.get(M.END) and M.END not in dict(top):
        top[-1:] = [(M.END, total[M.END])]
    return top


def _merged(group: pd.DataFrame) -> pd.DataFrame:
    top = _frequent(Counter({w.encode(): n for words, counts in zip(group["top_words"], group["top_counts"], strict=True) for w, n in zip(words, counts, strict=True)}))
    return pd.DataFrame({"bucket": group["bucket"].iloc[:1] // FAN_IN, "top_words": [[w.decode() for w, _ in top]], "top_counts": [[n for _, n in top]]})


def _counted(blocks: DataFrame, buckets: int) -> DataFrame:
    """bucket, block, counts (for each block), and for block null the bucket's sums: top words, rare_n and rare_v by class."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                b = Words(row, buckets)
                n = b.training_counts()
                cut = np.searchsorted(b.bucket, np.arange(buckets + 1))
                some = np.flatnonzero(np.diff(cut))
                yield pd.DataFrame({"bucket": some, "block": row.block, "n": np.diff(cut)[some], "words": [_press(b" ".join(b.words[cut[k] : cut[k + 1]])) for k in some], "counts": [_press(n[cut[k] : cut[k + 1]].tobytes()) for k in some]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total: Counter[bytes] = Counter()
        lists = []
        for words, counts in zip(group["words"], group["counts"], strict=True):
            own = _unpress(words).split(b" ")
            lists.append(own)
            for w, n in zip(own, np.frombuffer(_unpress(counts), np.int64).tolist(), strict=True):
                total[w] += n
        get = total.__getitem__
        counts = [_press(np.fromiter(map(get, own), np.int64, len(own)).tobytes()) for own in lists]
        rare_n, rare_v = np.zeros(M.RARE, np.int64), np.zeros(M.RARE, np.int64)
        for w, n in total.items():
            if n:
                k = M.rare_class(w) - M.CLASSES
                rare_n[k] += n
                rare_v[k] += 1
        top = _frequent(total)
        none = [None] * len(counts)
        return pd.DataFrame(
            {
                "bucket": group["bucket"].iloc[0],
                "block": pd.array([*group["block"], None], "Int64"),
                "counts": [*counts, None],
                "top_words": [*none, [w.decode() for w, _ in top]],
                "top_counts": [*none, [n for _, n in top]],
                "rare_n": [*none, rare_n.tolist()],
                "rare_v": [*none, rare_v.tolist()],
            }
        )

    sent = blocks.mapInPandas(send, "bucket long, block long, n long, words binary, counts binary")
    told = sent.groupBy("bucket").applyInPandas(add, "bucket long, block long, counts binary, top_words array<string>, top_counts array<long>, rare_n array<long>, rare_v array<long>")
    return stage(told, "counts")


def _vocabulary(counted: DataFrame, buckets: int) -> M.Vocabulary:
    sums = counted.where("block is null")
    lists = sums.select("bucket", "top_words", "top_counts")
    while buckets > FAN_IN:
        lists = lists.groupBy(F.floor(F.col("bucket") / FAN_IN)).applyInPandas(_merged, "bucket long, top_words array<string>, top_counts array<long>")
        buckets = -(-buckets // FAN_IN)
    top = _frequent(Counter({w.encode(): n for r in lists.collect() for w, n in zip(r["top_words"], r["top_counts"], strict=True)}))
    one = sums.agg(*[F.coalesce(F.sum(F.get(c, F.lit(k))), F.lit(0)).alias(f"{c}{k}") for c in ("rare_n", "rare_v") for k in range(M.RARE)]).first()
    n, v = (np.array([one[f"{c}{k}"] for k in range(M.RARE)], np.int64) for c in ("rare_n", "rare_v"))
    total, types = int(n.sum()), int(v.sum())
    for w, c in top:
        n[M.rare_class(w) - M.CLASSES] -= c
        v[M.rare_class(w) - M.CLASSES] -= 1
    return M.Vocabulary([w for w, _ in top], [c for _, c in top], n.astype(float), v.astype(float), total, types)


def _fit(blocks: DataFrame, v: M.Vocabulary, buckets: int) -> M.Weights:
    """The weights after all rounds: of each, tasks sum gradients at the same weights, and chunks of them are joined."""
    spark = blocks.sparkSession
    w = M.Weights(v)
    kind = "name string, chunk int, means binary, used binary, part int"

    def join(group: pd.DataFrame) -> pd.DataFrame:
        g, used = M.joined(list(zip(group["means"], group["used"], strict=True)))
        means = (g / np.maximum(used, 1)[:, None]).astype("<f2").tobytes()
        return group.iloc[:1].assign(means=[means], used=[used.astype("<f4").tobytes()], part=group["part"] // FAN_IN)[["name", "chunk", "means", "used", "part"]]

    for k in range(len(M.ROUNDS)):
        given = spark.sparkContext.broadcast((v, w))

        def learn(batches: Iterator[pd.DataFrame], given=given) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            v, w = given.value
            sums = M.Sums(w)
            for batch in batches:
                for row in batch.itertuples():
                    b = Words(row, buckets)
                    sums.add(*b.inputs(v, ~b.held[b.owner]))
            if sums.tokens:
                yield pd.DataFrame(list(M.rows_of(sums)), columns=["name", "chunk", "means", "used"]).assign(part=TaskContext.get().partitionId())

        own = blocks.where(F.col("round") == k)
        parts, tasks = own.mapInPandas(learn, kind), own.rdd.getNumPartitions()
        while True:
            parts = parts.groupBy("name", "chunk", F.floor(F.col("part") / FAN_IN)).applyInPandas(join, kind)
            tasks = -(-tasks // FAN_IN)
            if tasks <= 1:
                break
        for r in parts.collect():
            g, used = M.joined([(r["means"], r["used"])])
            w.step(r["name"], r["chunk"] + np.arange(len(g)), g, used)
        given.unpersist()
    return w


def scored(docs: DataFrame, block: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    The model learns from the rows whose crc32 of doc_id as text leaves another remainder than 1 by 5; a null doc_id
    counts as the empty text. A null or empty text has one token, its end. Rows that repeat a doc_id all count. Without
    training rows every token has the base's probability of an unknown one. Words of equal count are ranked by their bytes.
    Texts of any length are taken whole; one makes a block of its own. An empty table gives no rows; other columns are not
    looked at, and doc_id is taken as a long.
    """
    spark = docs.sparkSession
    ship(spark)
    given = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID))).alias("id"), F.col("doc_id").isNotNull().alias("known"), "text")
    blocks = stage(given.mapInPandas(lambda b: _to_blocks(b, block), "block long, round int, ids binary, known binary, lens binary, words binary, tokens binary, raw long"), "blocks")
    raw = blocks.agg(F.sum("raw")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-raw // bucket))
    counted = _counted(blocks, buckets)
    v = _vocabulary(counted, buckets)
    fitted = _fit(blocks, v, buckets) if v.total else None
    model = spark.sparkContext.broadcast((v, fitted))
    told = counted.where("block is not null").groupBy("block").agg(F.collect_list(F.struct("bucket", "counts")).alias("told"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v, w = model.value
        for batch in batches:
            for row in batch.itertuples():
                b = Words(row, buckets)
                counts = np.concatenate([np.frombuffer(_unpress(r["counts"]), np.int64) for r in sorted(row.told, key=lambda r: r["bucket"])])[b.tokens]
                base = v.base(counts)
                cls, place, before, earlier = b.inputs(v, np.ones(len(b.tokens), bool))
                own = M.log_probability(w, v, cls, place, counts, before, earlier) if w is not None else base
                at = b.begin[:-1]
                ids = pd.array(b.ids.copy(), "Int64")
                ids[~b.known] = pd.NA
                yield pd.DataFrame({"doc_id": ids, "held_out": b.held, "n_tokens": np.diff(b.begin), "n_known": np.add.reduceat((counts > 0).astype(np.int64), at), "train_tokens": v.total, "base_score": np.add.reduceat(base, at), "score": np.add.reduceat(own, at)})

    return blocks.join(told, "block", "left").mapInPandas(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
