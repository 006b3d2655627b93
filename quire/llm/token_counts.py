"""Token counts by trie-shared dynamic programming under a unigram model.

The pieces of a public vocabulary get fixed unigram costs from their order in it (a piece of rank r costs
log(r + 2): frequent pieces come first there). A text's count is the number of pieces in the cheapest
segmentation of each of its pre-tokens; of equally cheap ones the one with fewer pieces counts. Pre-tokens are
the words between blanks, each with a mark of the blank before it.

A task puts the distinct pre-tokens of its texts in a trie and computes forward scores level by level, once
per shared prefix; the scores at ends are the counts. No pre-token leaves its task, so nothing is shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table

MARK = "▁"
LONGEST = 16
CACHE = 600_000
#: A character that no piece covers stands alone as so many byte pieces, each at this cost.
BYTE_COST = 12.0


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Unigram:
    """Costs of pieces up to LONGEST characters by their text, and counts of pre-tokens seen."""

    def __init__(self, costs: dict[str, float]):
        self.longest = min(LONGEST, max(map(len, costs), default=1))
        self.costs = {p: c for p, c in costs.items() if 0 < len(p) <= self.longest}
        self.known: dict[str, int] = {}

    @classmethod
    def load(cls, path: str) -> Unigram:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [k for k in range(model.get_piece_size()) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k))]
        return cls({model.id_to_piece(k): float(np.log(rank + 2)) for rank, k in enumerate(plain)})

    def count(self, tokens: list[str]) -> np.ndarray:
        """Pieces in the best segmentation of each of the distinct tokens.

        A node of the trie is (parent, character); nodes of one depth are handled together. Their last characters, up to
        the longest piece, are gathered by walking to ancestors; each text of such an ending is looked up once a level.
        """
        result = np.zeros(len(tokens), np.int64)
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        codes = np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        begin = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        node = np.zeros(len(tokens), np.int64)
        live = np.flatnonzero(lengths > 0)
        # by depth, for its nodes: parent's place in the depth above, cost, pieces, and endings by length
        levels = [(np.zeros(1, np.int64), np.zeros(1), np.zeros(1, np.int64), [""])]
        depth = 0
        while len(live):
            depth += 1
            edge = node[live] << 21 | codes[begin[live] + depth - 1]
            _, first, node_of = np.unique(edge, return_index=True, return_inverse=True)
            node[live] = node_of
            owner = live[first]
            parent = edge[first] >> 21
            ends = [tokens[o][max(0, depth - self.longest) : depth] for o in owner.tolist()]
            alone = np.array([(3 if e[-1] >= "ࠀ" else 2 if e[-1] >= "\x80" else 1) + (e[-1] > "￿") for e in ends])
            up = parent
            cost = levels[-1][1][up] + BYTE_COST * alone
            pieces = levels[-1][2][up] + alone
            get = self.costs.get
            for size in range(1, min(depth, self.longest) + 1):
                if size > 1:
                    up = levels[-size + 1][0][up]
                piece = np.array([get(e[-size:], np.inf) for e in ends])
                some = np.flatnonzero(np.isfinite(piece))
                if not len(some):
                    continue
                c = levels[-size][1][up[some]] + piece[some]
                n = levels[-size][2][up[some]] + 1
                better = (c < cost[some] - 1e-9) | ((np.abs(c - cost[some]) <= 1e-9) & (n < pieces[some]))
                cost[some[better]], pieces[some[better]] = c[better], n[better]
            levels.append((parent, cost, pieces, ends))
            del levels[: -self.longest - 1]
            done = live[lengths[live] == depth]
            result[done] = pieces[node[done]]
            live = live[lengths[live] > depth]
        return result

    def counts(self, tokens: set[str]) -> dict[str, int]:
        new = sorted(tokens - self.known.keys())
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = sorted(tokens)
        self.known.update(zip(new, self.count(new).tolist(), strict=True))
        return self.known


_MODELS: dict[str, Unigram] = {}


def _model(path: str) -> Unigram:
    if path not in _MODELS:
        _MODELS[path] = Unigram.load(path)
    return _MODELS[path]


def pre_tokens(text: str | None) -> list[str]:
    return [MARK + w for w in text.split()] if text else []


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_pre_tokens, n_distinct, n_tokens for every row of docs. Pre-tokens end at every Unicode blank, as str.split() has it.

    Null, empty and blank texts have none; equal texts have equal counts; an empty table gives no rows; columns
    besides doc_id and text are not looked at. A word of any length is one pre-token, counted whole.
    """
    ship(docs.sparkSession)
    path = vocabulary or default_vocabulary()

    def count(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = _model(path)
        for batch in texts:
            for at in range(0, len(batch), 500):
                lists = [Counter(pre_tokens(t)) for t in batch.iloc[at : at + 500]]
                known = model.counts(set().union(*lists))
                rows = [(sum(c.values()), len(c), sum(n * known[w] for w, n in c.items())) for c in lists]
                for w in [w for w in set().union(*lists) if len(w) > 64]:
                    del known[w]
                yield pd.DataFrame(rows, columns=["n_pre_tokens", "n_distinct", "n_tokens"])

    count.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    kind = "n_pre_tokens long, n_distinct long, n_tokens long"
    return docs.select("doc_id", F.pandas_udf(count, kind)("text").alias("c")).select("doc_id", "c.*")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
