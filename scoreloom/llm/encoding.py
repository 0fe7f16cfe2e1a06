"""Problem 8: encoding a corpus with a public byte-level tokenizer."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..plans.cut import spread
from ..sources.tables import table

FOLDER = os.environ.get("SCORELOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
MEMO = 200_000  # distinct fragments whose ids a worker remembers


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def joined_pairs(ranks) -> list[set[int]]:
    """For each byte the bytes that follow it inside some token."""
    follow: list[set[int]] = [set() for _ in range(256)]
    for t in ranks:
        for a, b in zip(t, t[1:]):
            follow[a].add(b)
    return follow


class Encoder:
    """Byte-pair encoding by fragments with forced boundaries.

    Merges only ever form tokens of the vocabulary. Where two neighbouring bytes
    stand side by side in no token, no merge can span them, so both sides can be
    encoded on their own and their ids put one after the other. The text is first
    cut into words by the tokenizer's own pattern (merges don't cross those either),
    then each word at its forced boundaries; ids of fragments are remembered.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.words = regex.compile(pattern)
        self.follow = joined_pairs(ranks)
        self.memo: dict[bytes, tuple[int, ...]] = {}
        self.word_memo: dict[str, tuple[int, ...]] = {}

    def fragments(self, word: bytes) -> list[bytes]:
        out, start, follow = [], 0, self.follow
        for i in range(1, len(word)):
            if word[i] not in follow[word[i - 1]]:
                out.append(word[start:i])
                start = i
        out.append(word[start:])
        return out

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one fragment: the neighbours whose joint token has the lowest rank
        are joined, the leftmost first, until none can be. A heap holds the
        candidates, so a long fragment costs n log n."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        from heapq import heapify, heappop, heappush

        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # end of the part that starts here; 0: no part starts here
        left = list(range(-1, n - 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, m, e = heappop(heap)
            if end[i] != m or m >= n or end[m] != e:
                continue
            end[i], end[m] = e, 0
            if e < n:
                left[e] = i
                r = ranks.get(piece[i : end[e]])
                if r is not None:
                    heappush(heap, (r, i, e, end[e]))
            h = left[i]
            if h >= 0:
                r = ranks.get(piece[h:e])
                if r is not None:
                    heappush(heap, (r, h, i, e))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        words, memo = self.word_memo, self.memo
        for m in self.words.finditer(text):
            w = m.group()
            got = words.get(w)
            if got is None:
                parts: list[int] = []
                for f in self.fragments(w.encode("utf-8", "surrogatepass")):
                    x = memo.get(f)
                    if x is None:
                        x = self.merge(f)
                        if len(memo) < MEMO and len(f) < 64:
                            memo[f] = x
                    parts += x
                got = tuple(parts)
                if len(words) < MEMO and len(w) < 64:
                    words[w] = got
            ids += got
        return ids


@lru_cache(2)
def encoder(folder: str, vocabulary: str) -> Encoder:
    import importlib.util

    spec = importlib.util.spec_from_file_location("public_tokenizers_at", os.path.join(folder, "__init__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return Encoder(read_ranks(os.path.join(folder, vocabulary)), module.PATTERN)


def encoded(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids): the token ids of each text, one row per row of ``df``.

    Special tokens are neither added nor recognised: strings that look like them are
    ordinary text. The empty text and the null text both have the empty list. There
    is no shuffle; the vocabulary is read by each worker from ``folder``.
    """
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches):
        enc = encoder(folder, vocabulary)
        for b in batches:
            ids = [enc.encode(t) if t else [] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_column, "ids"])

    return df.select(id_column, text_column).mapInArrow(run, f"{id_column} {kind}, ids array<int>")


def p8_ids(spark: SparkSession, base: str) -> DataFrame:
    return encoded(spread(table(spark, base, "documents", ["doc_id", "text"])))


def p8_token_counts(spark: SparkSession, base: str) -> DataFrame:
    """Tokens per source."""
    from pyspark.sql import functions as F

    docs = table(spark, base, "documents", ["doc_id", "source", "text"])
    n = p8_ids(spark, base).select("doc_id", F.size("ids").alias("n"))
    return docs.select("doc_id", "source").join(n, "doc_id").groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"))
