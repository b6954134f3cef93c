"""Token counts by byte-pair merging, without making tokens.

A text is cut at the special strings of the vocabulary (each is one token) and then at spaces and line
ends, which no token of this vocabulary kind crosses. What lies between is normalised and split into
words by the rules of the vocabulary file. A word starts as single symbols; a heap holds its adjacent
pairs by merge rank and place, a linked list its symbols: the lowest pair is merged again and again, and
the count is symbols minus merges. No identifier is looked up or emitted.

Each task keeps the counts of the pieces and words it has met, ``CACHE_PIECES`` each: a full cache is emptied,
which costs time and changes no result. Nothing is shuffled.

Defined results: a null or empty text has no bytes and no tokens; repeated rows are counted each; an empty
table gives an empty table; further columns do not matter and may have any names.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_PIECES = 400_000
_CUT = re.compile("[ \n]+")


class PieceCounts(dict):
    """Tokens of each piece between spaces, counted when first asked for."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.end = model.get("end_of_word_suffix") or ""
        tokenizer = Tokenizer.from_file(path)
        self.normalize = tokenizer.normalizer.normalize_str
        self.split = tokenizer.pre_tokenizer.pre_tokenize_str
        special = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = re.compile("|".join(special)) if special else None
        self.words: dict[str, int] = {}

    def merged(self, word: str) -> int:
        """Symbols that are left of a word."""
        symbols = list(word)
        if not symbols:
            return 0
        symbols[-1] += self.end
        left, right = [*range(-1, len(symbols) - 1)], [*range(1, len(symbols)), -1]
        ranks, count = self.ranks, len(symbols)
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := ranks.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue  # one of the two has been merged meanwhile
            symbols[i], symbols[j] = a + b, ""
            right[i] = k = right[j]
            count -= 1
            if k >= 0:
                left[k] = i
                if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
            if (h := left[i]) >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
        return count

    def word(self, word: str) -> int:
        if (n := self.words.get(word)) is None:
            if len(self.words) >= CACHE_PIECES:
                self.words.clear()
            self.words[word] = n = self.merged(word)
        return n

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE_PIECES:
            self.clear()
        self[piece] = n = sum(self.word(word) for word, _ in self.split(self.normalize(piece)))
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        specials = len(self.special.findall(text)) if self.special else 0
        parts = self.special.split(text) if specials else [text]
        return specials + sum(sum(map(self.__getitem__, _CUT.split(part))) for part in parts)


@lru_cache(maxsize=2)
def piece_counts(path: str) -> PieceCounts:
    return PieceCounts(path)


def token_counts(df: DataFrame, tokenizer: str, limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: UTF-8 bytes, tokens, and whether the tokens exceed ``limit``.

    ``tokenizer`` is the path of a vocabulary file on every executor.
    """
    import pyarrow as pa

    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = piece_counts(tokenizer)
        for batch in batches:
            n = [counts.count(t or "") for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    sized = rows.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "text")
    done = sized.mapInArrow(counted, f"doc_id {id_type}, n_bytes bigint, n_tokens bigint")
    return done.withColumn("over_limit", F.col("n_tokens") > limit)
