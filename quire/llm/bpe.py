"""Byte-level BPE by overlapping chunks: pre-tokenise in parallel, stitch where the boundaries agree, encode the pieces.

A text longer than a chunk is cut every `chunk` characters, each chunk reaching `overlap` characters into the next one, and the
chunks are dealt over the cluster. A chunk is pre-tokenised from its own start, which may lie inside a pre-token, so that its first
boundaries may be wrong. From a place on at which a boundary of the chunk meets a true one all of its boundaries are true, since the
pattern never looks back. Such places are where two chunks are stitched, and the pieces between them are encoded each on its own.

Which boundaries of a chunk are true is known without the chunks before it: a match only goes on over a change between letters,
numbers, blanks and other characters after a blank or an apostrophe, so that every other change is a boundary wherever matching
began. From the first of these on the boundaries of a chunk are true. A chunk whose overlap shows none that both sides have (a
pre-token that is longer than the overlap) is joined to the one before it.

The classes of characters are those of the encoder itself, which it is asked for once a character, as its Unicode tables may be
older than Python's.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import narrow, ship, stage, table

CHUNK = 1 << 15
OVERLAP = 1 << 9
#: The public pattern over texts in which every character stands for its class.
CLASSES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
CHANGES = re.compile(r"[A-Za-z](?=[^A-Za-z])|[0-9](?=[^0-9])|[^\sA-Za-z0-9'](?=[\sA-Za-z0-9])", re.ASCII)
#: A boundary is settled by what follows it: the longest contraction has two characters after its apostrophe.
AHEAD = 2


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


class Codec:
    """Ids of texts as little-endian uint32 arrays, boundaries of pre-tokens, and bytes of ids."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.spelled = list(map(str, range(len(self.bytes_of))))
        # pairs of a letter, a digit or a mark and one more byte are tokens here, so that the encoder shows what it takes together
        pairs = [bytes([a, b]) for a in b"a0!" for b in range(256)]
        probe = {bytes([k]): k for k in range(256)} | {p: 256 + k for k, p in enumerate(pairs)}
        self.probe = tiktoken.Encoding("probe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=probe, special_tokens={})
        self.seen: dict[int, str] = _Classes(self.probe)

    def encode(self, text: str) -> np.ndarray:
        """The ids of text. Texts beyond what the pattern's engine can take are split here."""
        if len(text) <= 2 * CHUNK:
            return self.encoding.encode_to_numpy(text, disallowed_special=())
        at, out = 0, []
        for end in self.ends(text):
            out += self.encoding._core_bpe.encode_single_piece(text[at:end].encode())
            at = end
        return np.array(out, "<u4")

    def ends(self, text: str) -> list[int]:
        return [m.end() for m in CLASSES.finditer(text.translate(self.seen))]

    def boundaries(self, text: str) -> tuple[list[int], int]:
        """Ends of the matches of the pattern in text but those after a blank, where a cut would hide from the pattern that more
        follows; and the first of them that is one wherever matching began."""
        classes = text.translate(self.seen)
        sure = CHANGES.search(classes)
        return [m.end() for m in CLASSES.finditer(classes) if not classes[m.end() - 1].isspace()], sure.end() if sure else len(text) + 1

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def spell(self, ids: np.ndarray) -> bytes:
        return ",".join(map(self.spelled.__getitem__, ids.tolist())).encode()


class _Classes(dict):
    """A table for str.translate() that asks the encoder for the class of each new character; ASCII stands for itself."""

    def __init__(self, probe):
        super().__init__((k, k) for k in range(128))
        self.probe = probe

    def __missing__(self, code: int) -> str:
        together = lambda a: self.probe.encode_ordinary(a + chr(code))[0] > 255
        self[code] = found = "z" if together("a") else "0" if together("0") else "!" if together("!") else "\t"
        return found


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _chunks(long: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """row, doc_id, chunk, last, text of every chunk, dealt evenly."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, doc, text in zip(batch["row"], batch["doc_id"], batch["text"], strict=True):
                count = -(-len(text) // chunk)
                for first in range(0, count, 256):
                    some = range(first, min(first + 256, count))
                    yield pd.DataFrame({"row": row, "doc_id": doc, "chunk": list(some), "last": [k == count - 1 for k in some], "text": [text[k * chunk : (k + 1) * chunk + overlap] for k in some]})

    # ids go through Python as text: pandas would make doubles of longs beside nulls
    made = long.select("row", F.col("doc_id").cast("string"), "text").mapInPandas(cut, "row long, doc_id string, chunk int, last boolean, text string")
    return made.withColumn("doc_id", F.col("doc_id").cast("long")).repartition("row", "chunk")


def _marks(cut: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """row, chunk, heads (boundaries in the characters shared with the chunk before) and tails (true ones in those shared with the next)."""

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(path)
        for batch in batches:
            rows = []
            for row, k, last, text in zip(batch["row"], batch["chunk"], batch["last"], batch["text"], strict=True):
                ends, sure = own.boundaries(text)
                settled = [e for e in ends if last or e <= len(text) - AHEAD]
                rows.append((row, k, [0, *[e for e in settled if e <= overlap]], [e - chunk for e in settled if e >= chunk and (k == 0 or e >= sure)]))
            yield pd.DataFrame(rows, columns=["row", "chunk", "heads", "tails"])

    return cut.select("row", "chunk", "last", "text").mapInPandas(mark, "row long, chunk int, heads array<int>, tails array<int>")


def _stitched(marks: DataFrame, chunk: int) -> DataFrame:
    """row, chunk, piece, start and stop (characters of the chunk's text that go to the piece), parts (chunks that the piece has)."""
    in_order = Window.partitionBy("row").orderBy("chunk")
    meet = F.array_min(F.array_intersect("heads", F.lag("tails").over(in_order)))
    met = marks.select("row", "chunk", F.when(F.col("chunk") == 0, 0).otherwise(meet).alias("at"))
    placed = met.select("row", "chunk", "at", F.sum(F.col("at").isNotNull().cast("int")).over(in_order).alias("piece"), F.lead("at").over(in_order).alias("next"))
    spans = placed.select("row", "chunk", (F.col("piece") - 1).cast("int").alias("piece"), F.coalesce("at", F.lit(0)).alias("start"), (chunk + F.coalesce("next", F.lit(0))).alias("stop"))
    return spans.withColumn("parts", F.count("*").over(Window.partitionBy("row", "piece")))


def encode(docs: DataFrame, ranks: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """row, doc_id, piece, whole, ids (binary, little-endian uint32): the ids of a row of docs are those of its pieces in order.

    A text of at most `chunk` characters is one piece (whole is true). A null text is empty and has one piece of no ids.
    Rows that repeat a doc_id are documents of their own, told apart by row; doc_id is taken as a long, a null one stays null,
    and other columns are not looked at. A pre-token of any length is encoded whole. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    path = ranks or default_ranks()
    if not AHEAD < overlap < chunk:
        raise ValueError("an overlap is longer than what settles a boundary and shorter than a chunk")
    given = narrow(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def ids(texts: pd.Series) -> pd.Series:
        own = codec(path)
        return pd.Series([own.encode(t).tobytes() for t in texts])

    encoded = lambda df, whole: df.select("row", "doc_id", "piece", F.lit(whole).alias("whole"), F.pandas_udf(ids, "binary")("text").alias("ids"))
    short = encoded(given.where(F.length("text") <= chunk).withColumn("piece", F.lit(0)), True)
    cut = stage(_chunks(given.where(F.length("text") > chunk), chunk, overlap), "chunks")
    spans = stage(_stitched(_marks(cut, path, chunk, overlap), chunk), "spans")
    # substring() counts from one; the last chunk's text just ends earlier
    parts = cut.join(spans, ["row", "chunk"]).withColumn("text", F.expr("substring(text, start + 1, stop - start)"))
    alone = parts.where("parts = 1").select("row", "doc_id", "piece", "text")
    several = parts.where("parts > 1").groupBy("row", "piece").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("chunk", "text"))).alias("t"))
    several = several.select("row", "doc_id", "piece", F.array_join("t.text", "").alias("text"))
    return short.unionByName(encoded(alone.unionByName(several), False))


def decode(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """row, doc_id, piece, data: the bytes of each piece; those of a document's pieces in order are its text's UTF-8 bytes."""
    ship(encoded.sparkSession)
    path = ranks or default_ranks()

    def back(ids: pd.Series) -> pd.Series:
        own = codec(path)
        return pd.Series([own.decode(np.frombuffer(x, "<u4")) for x in ids])

    return encoded.select("row", "doc_id", "piece", F.pandas_udf(back, "binary")("ids").alias("data"))


def digests(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256 (of the decoded bytes) for each row encoded.

    Pieces of one document meet in one task, in order, and are hashed one after the other without being joined.
    """
    ship(encoded.sparkSession)
    path = ranks or default_ranks()

    def at_once(pieces: pd.Series) -> pd.DataFrame:
        own, rows = codec(path), []
        for ids in (np.frombuffer(x, "<u4") for x in pieces):
            rows.append((len(ids), hashlib.sha256(own.spell(ids)).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    def in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, open_ = codec(path), None
        table_of = lambda rows: pd.DataFrame([(doc, n, ids.hexdigest(), data.hexdigest()) for _, doc, n, ids, data in rows], columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        for batch in batches:
            done = []
            for row, doc, raw in zip(batch["row"], batch["doc_id"], batch["ids"], strict=True):
                if open_ is None or open_[0] != row:
                    done += [open_] if open_ else []
                    open_ = [row, doc, 0, hashlib.sha256(), hashlib.sha256()]
                ids = np.frombuffer(raw, "<u4")
                open_[3].update((b"," if open_[2] and len(ids) else b"") + own.spell(ids))
                open_[4].update(own.decode(ids))
                open_[2] += len(ids)
            if done:
                yield table_of(done)
        if open_ is not None:
            yield table_of([open_])

    told = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    whole = encoded.where("whole").select("doc_id", F.pandas_udf(at_once, told)("ids").alias("d")).select("doc_id", "d.*")
    cut = encoded.where("not whole").repartition("row").sortWithinPartitions("row", "piece").select("row", F.col("doc_id").cast("string"), "ids")
    return whole.unionByName(cut.mapInPandas(in_order, "doc_id string, " + told).withColumn("doc_id", F.col("doc_id").cast("long")))


def op11_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(table(spark, sf_dir, "documents")))
