"""Token counts by byte-pair merging with a heap and a linked list."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

#: The mark that stands for a space.
SPACE = "▁"
#: A run of marks with what follows it, or what stands before the first.
SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def merges(symbols: list[str], rank: dict[str, float]) -> int:
    """How many merges there are when, again and again, the adjacent pair of lowest rank is merged, the leftmost first.

    A heap holds the candidate pairs and a linked list the symbols; pairs whose symbols have changed since they were
    pushed are skipped when they are popped.
    """
    last = len(symbols)
    before, after = list(range(-1, last - 1)), list(range(1, last + 1))
    pieces: list[str | None] = list(symbols)
    heap = [(r, i, a + b) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := rank.get(a + b)) is not None]
    heapq.heapify(heap)
    done = 0
    while heap:
        _, left, merged = heapq.heappop(heap)
        if pieces[left] is None or (right := after[left]) == last or pieces[left] + pieces[right] != merged:
            continue
        done += 1
        pieces[left], pieces[right] = merged, None
        after[left] = right = after[right]
        if right < last:
            before[right] = left
            if (r := rank.get(merged + pieces[right])) is not None:
                heapq.heappush(heap, (r, left, merged + pieces[right]))
        if (at := before[left]) >= 0 and (r := rank.get(pieces[at] + merged)) is not None:
            heapq.heappush(heap, (r, at, pieces[at] + merged))
    return done


class PieceCounts(dict):
    """Tokens by word, counted when first asked for. At most twice `words` words of at most 40 letters are kept, those last asked for."""

    def __init__(self, rank: dict[str, float], alphabet: set[str], mark: str = "", words: int = 500_000):
        super().__init__()
        self.rank, self.alphabet, self.mark, self.words = rank, alphabet, mark, words
        self.older: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        if (count := self.older.pop(word, None)) is not None:
            self[word] = count
            return count
        symbols = list(self.mark + word)
        count = len(symbols) - merges(symbols, self.rank)
        if not self.alphabet.issuperset(symbols):  # what isn't in the vocabulary is written as its bytes
            count += sum(len(x.encode()) - 1 for x in symbols if x not in self.alphabet)
        if len(word) <= 40:
            if len(self) >= self.words:
                self.older = dict(self)
                self.clear()
            self[word] = count
        return count


class Counter:
    """Counts as a sentencepiece BPE model with byte fallback does: spaces become marks, and one more mark goes in front.

    No piece has a mark behind another letter, and none holds a line break, so merges stay within the segments that
    start at runs of marks and at line breaks; each is counted by itself.
    """

    def __init__(self, model: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=model)
        usual = [i for i in range(library.get_piece_size()) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i))]
        pieces = {library.id_to_piece(i): -library.get_score(i) for i in usual}
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces):
            raise ValueError("this model has pieces that reach over spaces or line breaks")
        rank, alphabet = {p: r for p, r in pieces.items() if len(p) > 1}, {p for p in pieces if len(p) == 1}
        self.segments = PieceCounts(rank, alphabet)
        self.marked = PieceCounts(rank, alphabet, mark=SPACE)

    def count(self, text: str) -> int:
        if not text:
            return 0
        lines = text.split("\n")
        total = len(lines) - 1
        for n, line in enumerate(lines):
            if "  " in line or SPACE in line or line[:1] == " " or line[-1:] == " ":
                marked = (SPACE if n == 0 else "") + line.replace(" ", SPACE)
                total += sum(map(self.segments.__getitem__, SEGMENT.findall(marked)))
                continue
            words = line.split(" ")
            if n and (first := words.pop(0)):
                total += self.segments[first]
            total += sum(map(self.marked.__getitem__, words))
        return total


@cache
def counter(model: str) -> Counter:
    return Counter(model)


def token_counts(docs: DataFrame, model: str | None = None, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (more than limit tokens).

    model is a sentencepiece model's path, readable on the executors; by default the 32k piece model. Texts are
    counted whole; no identifiers leave the counter, which remembers the counts of words it has seen, within a bound.
    Null texts count as empty and have no tokens. Rows are counted one by one, so repeated ones each have a row; an
    empty table gives none. Other columns are ignored.
    """
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counted = counter(model)
        for texts in batches:
            yield pd.Series([counted.count(text) for text in texts], dtype="int64")

    text = text_of(text_col)
    counts = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), count(text).alias("n_tokens"))
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
