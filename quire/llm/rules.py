"""Quality rules with suffix-array repetition.

Batches of texts go through one suffix array over word numbers, in which no two texts share a number.
Longest-common-prefix intervals give, for each word, the longest run from it that the same text repeats;
those that no longer run contains are the maximal repeated substrings. Their spans' union and the longest
of them decide. Every text is judged whole, in its own partition, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table
from .suffixes import covered, longest_repeats

SYMBOLS = "#*$%&|<>"
#: Base rules.
FEWEST_WORDS, BASE_WINDOW, BASE_PERCENT = 10, 5, 20
#: The method's limits: repeats of this many words count; share of words they may cover; words the longest may have.
REPEAT, MOST_COVERED, LONGEST = 8, 0.15, 60
BATCH_WORDS = 300_000
COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, repeat_covered double, longest_repeat long"


def _dup_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line in seen:
            n += bool(line.strip(" \t\n\v\f\r"))
        else:
            seen.add(line)
    return n


def _measure(texts: list[str], words: list[list[bytes]]) -> pd.DataFrame:
    """The columns of texts that together have about BATCH_WORDS words, or of one longer text."""
    numbers: list[np.ndarray] = []
    first = 1
    for own in words:
        ids: dict[bytes, int] = {}
        number = np.fromiter((ids.setdefault(w, len(ids)) for w in own), np.int64, len(own)) + first
        first += len(ids)
        numbers += [number, np.zeros(1, np.int64)]
    symbols = np.concatenate(numbers)
    starts = np.cumsum([0, *(len(w) + 1 for w in words)])
    repeat = longest_repeats(symbols)
    out = {}
    for name, least in (("n_repeat_words", BASE_WINDOW), ("repeat_covered", REPEAT)):
        at = np.flatnonzero(repeat >= least)
        maximal = at[(at == 0) | (repeat[at - 1] <= repeat[at])]
        mark = covered(maximal, repeat[maximal], len(symbols))
        out[name] = np.add.reduceat(mark.astype(np.int64), starts[:-1])
    sizes = np.diff(starts) - 1
    out["repeat_covered"] = out["repeat_covered"] / np.maximum(sizes, 1)
    return pd.DataFrame(
        {
            "n_words": sizes,
            "word_chars": [sum(map(len, map(bytes.decode, own))) if not t.isascii() else sum(map(len, own)) for t, own in zip(texts, words, strict=True)],
            "n_symbols": [sum(map(t.count, SYMBOLS)) for t in texts],
            "n_dup_lines": [_dup_lines(t) for t in texts],
            **out,
            "longest_repeat": np.maximum.reduceat(repeat, starts[:-1]),
        }
    )


def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    texts: list[str] = []
    words: list[list[bytes]] = []
    size = 0
    for batch in batches:
        for text in batch:
            texts.append(text or "")
            words.append(texts[-1].encode().split())
            size += len(words[-1]) + 1
            if size >= BATCH_WORDS:
                yield _measure(texts, words)
                texts, words, size = [], [], 0
    if texts:
        yield _measure(texts, words)


measure.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}


def judged(docs: DataFrame, most_covered: float = MOST_COVERED, longest: int = LONGEST) -> DataFrame:
    """doc_id, the columns of COLUMNS, base_failed and kept, for every row of docs.

    A null or empty text has no words and fails for too few. Rows of equal text are judged alike, rows that
    repeat a doc_id on their own. A text of more than BATCH_WORDS words is measured whole, in a call of its own. An empty
    table gives no rows; columns besides doc_id and text are not looked at.
    """
    ship(docs.sparkSession)
    found = docs.select("doc_id", F.pandas_udf(measure, COLUMNS)("text").alias("m")).select("doc_id", "m.*")
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > BASE_PERCENT * F.col("n_words"))
    fine = (F.col("repeat_covered") <= most_covered) & (F.col("longest_repeat") <= longest)
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & fine)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "repeat_covered", "longest_repeat")
