"""Packing token pieces into fixed-length sequences: shortest-pack-first over the length histogram.

Texts are tokenized in parallel and cut into pieces of at most `size` ids. Only the histogram of
piece lengths (size rows at most) reaches the driver. Lengths are placed longest first, each into
the pack with the most room that still holds it, a whole group of equal packs at a time; so the
work depends on the number of distinct lengths, not of documents. Every piece then finds its pack
by its length and its rank among the pieces of that length.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import narrow, ship, stage, table, worker_cache

END = 1
SIZE = 2048
CACHE = 700_000
JOINED = 256
SLICE = 1 << 20
#: Marks that a run may end in; none is a letter, a digit or a blank.
MARKS = ".,;:!?%$*#&|<>()\"-"
_MARKED = frozenset(MARKS)
#: What a run that can follow another in one text begins with.
_JOINS = frozenset(" \n")
_BEFORE_BLANK = re.compile(r"(?<=\S)(?=[ \n])")
_BLANKS = re.compile(r"[ \n\x00](?:(?<=\x00)|(?<=\s[ \n]))")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def runs(text: str) -> list[str]:
    """Cuts before each space or line feed that follows a non-blank; no pre-token crosses such a place."""
    if _BLANKS.search(text):
        return _BEFORE_BLANK.split(text)
    return text.replace("\n", "\x00\n").replace(" ", "\x00 ").split("\x00")


def slices(text: str, most: int = SLICE) -> Iterator[str]:
    """text in slices of about `most` characters, cut only where runs() may cut."""
    at = 0
    while len(text) - at > most and (cut := _BEFORE_BLANK.search(text, at + most)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


class Encoder:
    """Token ids as little-endian uint32 bytes; runs seen before come from a bounded cache.

    New runs that may follow one another are encoded as one text, which takes far less time than one by one;
    the bytes that each token stands for tell where a run's ids end.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.known: dict[str, bytes] = {}
        # in a byte-level vocabulary each character of a token stands for one byte
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.bytes_of[list(vocabulary.values())] = [len(token) for token in vocabulary]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Keeps at most about SLICE characters' worth of runs at a time, however long a text is."""
        out: list[bytes] = []
        waiting: list[list[str]] = []
        size = 0
        for text in texts:
            if len(text) > SLICE:
                out += self._join(waiting)
                waiting, size = [], 0
                out.append(b"".join(x for part in slices(text) for x in self._join([runs(part)])))
                continue
            waiting.append(runs(text) if text else [])
            size += len(text)
            if size > SLICE:
                out += self._join(waiting)
                waiting, size = [], 0
        return out + self._join(waiting)

    def _join(self, lists: list[list[str]]) -> list[bytes]:
        known = self.known
        distinct = set().union(*lists)
        new = distinct.difference(known)
        if len(known) + len(new) > CACHE:
            known.clear()
            new = distinct
        learned = self._learn(new)
        get = known.__getitem__
        out = [b"".join(map(get, runs_)) for runs_ in lists]
        for run in [r for r in learned if len(r) > 256]:
            known.pop(run, None)
        return out

    def _learn(self, new: set[str]) -> set[str]:
        """The runs that are in the cache now. A tail of marks after a letter is a pre-token of its own, so that such a run has
        the ids of its word and of its tail."""
        known = self.known
        cut = []
        for run in [r for r in new if r[-1:] in _MARKED]:
            word = run.rstrip(MARKS)
            if word[-1:].isalpha():
                cut.append((run, word, run[len(word) :]))
        parts = {x for _, word, tail in cut for x in (word, tail)}.difference(known)
        self._encode(parts.union(new.difference([run for run, _, _ in cut])))
        for run, word, tail in cut:
            known[run] = known[word] + known[tail]
        return new.union(parts)

    def _encode(self, new: set[str]) -> None:
        known = self.known
        alone = [r for r in new if r[:1] not in _JOINS or r[-1].isspace()]
        joinable = list(new.difference(alone))
        groups = [joinable[k : k + JOINED] for k in range(0, len(joinable), JOINED)] + [[r] for r in alone]
        found = self.tokenizer.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False)
        for group, made in zip(groups, found, strict=True):
            ids = np.array(made.ids, dtype="<u4")
            raw = ids.tobytes()
            if len(group) == 1:
                known[group[0]] = raw
                continue
            ends = np.cumsum(list(map(len, map(str.encode, group))))
            cuts = (4 * np.searchsorted(np.cumsum(self.bytes_of[ids]), ends, side="right")).tolist()
            known.update(zip(group, [raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)], strict=True))


def encoder(path: str) -> Encoder:
    held = worker_cache("packing")
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


def pieces(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, end: int = END) -> DataFrame:
    """doc_id, start, length, doc_tokens, ids (binary, little-endian uint32): a row for each cut of `size` ids.

    A null text is empty; each document ends with the id `end`, so that every row of docs gives a piece at least. Texts of
    any length are tokenized in slices. Rows that repeat a doc_id are documents of their own; doc_id is taken as a long, a
    null one stays null, and other columns are not looked at. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    tail = np.array([end], "<u4").tobytes()
    step = 4 * size

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = encoder(path)
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at : at + 512]
                ids, rows = [], []
                for doc, got in zip(part["doc_id"], tokens.encode([t or "" for t in part["text"]]), strict=True):
                    got += tail
                    for start in range(0, len(got), step):
                        ids.append(got[start : start + step])
                        rows.append((doc, start // 4, len(ids[-1]) // 4, len(got) // 4))
                out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "doc_tokens"])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out.assign(ids=ids)

    given = narrow(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return given.mapInPandas(cut, "doc_id long, start long, length long, doc_tokens long, ids binary")


def shortest_pack_first(histogram: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in order of placement, number of packs) for each packing pattern."""
    by_room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def put(pattern: tuple[int, ...], packs: int, room: int) -> None:
        if room not in by_room:
            by_room[room] = []
            insort(rooms, room)
        by_room[room].append((pattern, packs))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not rooms or rooms[-1] < length:
                # a new pack is the one with the most room until it is full of this length
                many = size // length
                for copies, packs in ((many, left // many), (left % many, 1)):
                    if copies and packs:
                        put((length,) * copies, packs, size - copies * length)
                break
            room = rooms[-1]
            pattern, packs = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(bisect_left(rooms, room))
            used = min(left, packs)
            if used < packs:
                put(pattern, packs - used, room)
            put((*pattern, length), used, room - length)
            left -= used
    return [x for room in sorted(by_room) for x in by_room[room]]


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each place in a pattern the ranks, of its length, that fill it: key = length << 40 | first rank."""
    taken: dict[int, int] = {}
    key, base, offset = [], [], []
    first = 0
    for pattern, packs in patterns:
        at = 0
        for length in pattern:
            rank = taken.get(length, 0)
            key.append(length << 40 | rank), base.append(first - rank), offset.append(at)
            taken[length] = rank + packs
            at += length
        first += packs
    order = np.argsort(np.array(key, np.int64), kind="stable")
    return {n: np.array(v, np.int64)[order] for n, v in (("key", key), ("base", base), ("offset", offset))}


def pack(given: DataFrame, size: int = SIZE) -> DataFrame:
    """The columns of given, which has a long `length` from 1 to size, and sequence_id and offset.

    Ranks within a length are counted per written partition and shifted by the counts of the partitions
    before it, so that a length that a third of all pieces share is never gathered in one task. Ties are
    taken in the order in which rows were written. Empty input gives no rows.
    """
    spark = given.sparkSession
    kept = stage(given.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    counts = kept.groupBy("_part", "length").agg(F.count("*").alias("n"))
    before = counts.select("_part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("_part")) - F.col("n")).alias("_before"))
    patterns = shortest_pack_first({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, size)
    slots = spark.sparkContext.broadcast(_slots(patterns))

    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        s, rank = slots.value, rank.to_numpy(np.int64)
        k = np.searchsorted(s["key"], length.to_numpy(np.int64) << 40 | rank, side="right") - 1
        return pd.DataFrame({"sequence_id": s["base"][k] + rank, "offset": s["offset"][k]})

    own = F.row_number().over(Window.partitionBy("_part", "length").orderBy("_row")) - 1
    ranked = kept.withColumn("_own", own).join(before, ["_part", "length"])
    placed = ranked.withColumn("_at", F.pandas_udf(place, "sequence_id long, offset long")("length", F.col("_before") + F.col("_own")))
    return placed.select(*[F.col(f"`{c}`") for c in given.columns], "_at.sequence_id", "_at.offset")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = pieces(table(spark, sf_dir, "documents")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(cut).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
