"""Byte-level BPE encoding and decoding through a table of distinct words.

Spark deals out the documents; each task splits its texts into words by the pattern of the vocabulary,
keeps a table of the distinct words it has met and encodes each of them once. The ids of a text are
those of its words, joined back by position. Decoding joins every id to its piece of bytes (a table of
the size of the vocabulary) and puts the pieces together.

The table of distinct words belongs to a task and holds ``TABLE_WORDS`` at most: a full table is
emptied, which costs time and changes no result. One table for the whole corpus would have to be joined
to every (document, word) pair by two shuffles, several times the input; it also grows with
the corpus, so that it can't be broadcast. Here nothing is shuffled.

Defined results: a null or empty text has no tokens, and the digests of the empty text; special strings
inside a text are the special tokens, as the library has it by default; repeated rows are encoded each;
an empty table gives an empty table; further columns do not matter and may have any names.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from unicodedata import category

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLE_WORDS = 300_000
#: The pattern of words of byte-level vocabularies, with Unicode white space written out.
_WHITE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, and its byte:
    printable Latin-1 for itself, the others from U+0100 on in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class WordTable(dict):
    """Ids of each distinct word, encoded when first met."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self._merge, self._split = tokenizer.model.tokenize, tokenizer.pre_tokenizer.pre_tokenize_str
        with open(path, encoding="utf-8") as f:
            special = [t["content"] for t in json.load(f)["added_tokens"]]
        self._special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self._words = regex.compile(PATTERN).findall
        of = byte_symbols()
        self._symbols = {b: c for c, b in of.items()}
        size = tokenizer.get_vocab_size(with_added_tokens=True)
        names = [tokenizer.id_to_token(i) for i in range(size)]
        special_names = set(special)
        self.special = {n: [tokenizer.token_to_id(n)] for n in special}
        self.pieces = [n.encode() if n in special_names else bytes(of[c] for c in n) for n in names]
        self.digits = [str(i) for i in range(size)]

    def __missing__(self, word: str) -> list[int]:
        if len(self) >= TABLE_WORDS:
            self.clear()
        ids = self.special.get(word)
        if ids is None:
            ids = [t.id for t in self._merge(word.encode().decode("latin-1").translate(self._symbols))]
        self[word] = ids
        return ids

    def _plain_words(self, text: str) -> list[str]:
        # The two libraries know different Unicode versions; where that can matter the library itself splits.
        if not text.isascii() and any(c > "\u052f" and category(c) == "Cn" for c in set(text)):
            return [text[a:b] for _, (a, b) in self._split(text)]
        return self._words(text)

    def words(self, text: str) -> list[str]:
        if self._special is None or not self._special.search(text):
            return self._plain_words(text)
        parts = self._special.split(text)
        return [w for i, part in enumerate(parts) for w in ([part] if i % 2 else self._plain_words(part))]

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.words(text))))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")

    def joined(self, ids: list[int]) -> str:
        return ",".join(map(self.digits.__getitem__, ids))


@lru_cache(maxsize=2)
def word_table(path: str) -> WordTable:
    return WordTable(path)


def _rows(df: DataFrame, doc_id: str, value: str, out: str) -> tuple[DataFrame, str]:
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(value).alias(out))
    return rows, rows.schema["doc_id"].dataType.simpleString()


def encode(df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids``: the token ids of every text."""
    import pyarrow as pa

    rows, id_type = _rows(df, doc_id, text, "text")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table(tokenizer)
        for batch in batches:
            ids = pa.array([table.encode(t or "") for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return rows.mapInArrow(encoded, f"doc_id {id_type}, ids array<int>")


def decode(df: DataFrame, tokenizer: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``doc_id, text``: the text of every list of ids; null is taken as empty."""
    import pyarrow as pa

    rows, id_type = _rows(df, doc_id, ids, "ids")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table(tokenizer)
        for batch in batches:
            texts = pa.array([table.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["doc_id", "text"])

    return rows.mapInArrow(decoded, f"doc_id {id_type}, text string")


def round_trip(df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: number of tokens, and SHA-256 of its ids (decimal, comma-joined) and of the text
    decoded from them. Both directions run in one pass, so that ids never leave their task."""
    import pyarrow as pa

    rows, id_type = _rows(df, doc_id, text, "text")

    def sha(s: str) -> str:
        return hashlib.sha256(s.encode()).hexdigest()

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table(tokenizer)
        for batch in batches:
            counts, id_digests, digests = [], [], []
            for t in batch.column(1):
                ids = table.encode(t.as_py() or "")
                counts.append(len(ids))
                id_digests.append(sha(table.joined(ids)))
                digests.append(sha(table.decode(ids)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(digests, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(done, f"doc_id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
