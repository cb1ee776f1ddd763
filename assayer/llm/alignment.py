"""Cross-tokenizer alignment: token intervals of two tokenizers are joined in DuckDB within Arrow partitions, pair counts are merged in Spark."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
from collections.abc import Callable, Iterator
from functools import cache, cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, removed, shared_folder, table, text_of

A_FILE, A_RANKS, B_FILE = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: A space between two letters that aren't white space; no token of either tokenizer reaches over the place before it.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space beside spaces and line breaks.
OTHER_SPACE = re.compile(r"[^\S \n]")
#: Letters of the texts that are aligned in one go, and words with their letters that a worker remembers.
CHUNK, WORDS, LETTERS = 2_000_000, 200_000, 4_000_000
#: Pairs of ids whose counts a task holds before it hands them on, and that may be broadcast (some 100 MB).
TASK_PAIRS, BROADCAST_PAIRS = 1_000_000, 1_500_000
#: Words that A encodes in one go, and bits of an id of B within a pair.
RUN, BITS = 500, 31


class TokenizerA:
    """text -> ids of a byte-level BPE file of the tokenizers library, special strings being plain text.

    tiktoken reads the same vocabulary and gives the same ids sooner, as tests hold; where it gives up, the library is asked.
    """

    def __init__(self, path: str, ranks: str):
        import public_tokenizers
        import tiktoken

        self.path = path
        with open(ranks, "rb") as lines:
            by_token = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.quick = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=by_token, special_tokens={})
        with open(path) as file:
            vocabulary = json.load(file)["model"]["vocab"]
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        of = {letter: byte for byte, letter in enumerate(byte_letters())}
        for token, i in vocabulary.items():
            if all(letter in of for letter in token):
                self.bytes[i] = bytes(of[letter] for letter in token)

        self.sizes = np.fromiter(map(len, self.bytes), np.int64)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of " " + word for each word, one after the other, and how many each has.

        Words that begin and end with other letters than white space are encoded in runs, since each begins a token there.
        """
        ids, lengths = [], []
        for n in range(0, len(words), RUN):
            run = words[n : n + RUN]
            if any(w[0].isspace() or w[-1].isspace() for w in run):
                given = [self.one(" " + w) for w in run]
                ids.append(np.fromiter(chain.from_iterable(given), np.int64))
                lengths.append(np.fromiter(map(len, given), np.int64, len(run)))
                continue
            ids.append(np.array(self.one(" " + " ".join(run)), np.int64))
            ends = np.cumsum(np.fromiter((len(w) if w.isascii() else len(w.encode()) for w in run), np.int64, len(run)) + 1)
            lengths.append(np.diff(np.searchsorted(np.cumsum(self.sizes[ids[-1]]), ends, "right"), prepend=0))
        return np.concatenate(ids), np.concatenate(lengths)

    def one(self, text: str) -> list[int]:
        try:
            return self.quick.encode_ordinary(text)
        except ValueError:
            return self.library.encode(text, add_special_tokens=False).ids

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(self.path)
        library.encode_special_tokens = True
        return library


class TokenizerB:
    """text -> ids of a sentencepiece model, which puts a space in front."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.library.get_piece_size())
        piece = self.library.id_to_piece
        self.bytes = [bytes([int(piece(i)[3:-1], 16)]) if self.library.is_byte(i) else piece(i).replace("▁", " ").encode() for i in ids]

        self.sizes = np.fromiter(map(len, self.bytes), np.int64)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each word, with the space that the library puts in front, one after the other, and how many each has."""
        given = self.library.encode(words, num_threads=1)
        return np.fromiter(chain.from_iterable(given), np.int64), np.fromiter(map(len, given), np.int64, len(words))


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it is printable, else the next one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


@cache
def tokenizers(a: str, ranks: str, b: str) -> tuple[TokenizerA, TokenizerB]:
    return TokenizerA(a, ranks), TokenizerB(b)


@cache
def words_known(a: str, ranks: str, b: str) -> Words:
    """The words of a worker, which its next task finds again."""
    return Words(*tokenizers(a, ranks, b))


def words_of(text: str) -> list[str]:
    """The parts of " " + text between places where both tokenizers begin a token, each without the space it starts with."""
    uneven = "  " in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n" or OTHER_SPACE.search(text)
    return CUT.split(text) if uneven else text.split(" ")


#: Tokens of x with their group: the ends before them at which y's last token, found by ASOF, ends too, in a window sum.
GROUPS = """
CREATE OR REPLACE TEMP TABLE {x}_groups AS SELECT n, w, id, s, e, count(c) OVER (ORDER BY n) - CASE WHEN c THEN 1 ELSE 0 END AS g
FROM (SELECT x.*, CASE WHEN y.e = x.e THEN true END AS c FROM {x} x ASOF LEFT JOIN {y} y ON x.e >= y.e)
"""
#: One row a link: a range join of the tokens' intervals, which can't reach over groups.
LINKS = "SELECT a.w AS w, a.id AS a, b.id AS b FROM a_groups a JOIN b_groups b ON a.g = b.g AND b.s < a.e AND a.s < b.e ORDER BY a.w"


class Words(dict):
    """word -> number, with what alignment says of each word, worked out for all new words at once."""

    def __init__(self, a: TokenizerA, b: TokenizerB):
        super().__init__()
        import duckdb

        self.a, self.b = a, b
        self.bytes = [pa.array(t.bytes, pa.binary()) for t in (a, b)]
        self.con = duckdb.connect(config={"threads": 1})
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.letters = 0
        self.groups: list[str] = []
        #: by word: whether its bytes come back, tokens of A and B, groups, links; where its pairs begin; how often it was asked for
        self.stats = np.zeros((0, 5), np.int64)
        self.start = np.zeros(1, np.int64)
        self.used = np.zeros(0, np.int64)
        self.pairs = np.zeros(0, np.int64)

    def forget_rare(self) -> None:
        """Keeps the words that were asked for twice or more since the last time, unless these are half of what may be kept, or very long."""
        kept = np.flatnonzero(self.used > 1)
        words = [w for w, often in zip(self, (self.used > 1).tolist(), strict=True) if often]
        letters = sum(map(len, words))
        if len(words) > WORDS // 2 or letters > LETTERS // 2:
            self.forget()
            return
        self.clear()
        self.update(zip(words, range(len(words)), strict=True))
        self.letters = letters
        self.groups = [self.groups[i] for i in kept.tolist()]
        at, size = self.places(kept)
        self.pairs, self.start = self.pairs[at], np.concatenate([[0], np.cumsum(size)])
        self.stats, self.used = self.stats[kept], np.zeros(len(kept), np.int64)

    def places(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pairs of these words stand, one word after the other, and how many each has."""
        start = self.start[words]
        size = self.start[words + 1] - start
        return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum()), size

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        self.letters += len(word)
        return at

    def align(self) -> None:
        """Works out the words that were asked for since the last time."""
        words, self.new = self.new, []
        if not words:
            return
        flat, lengths = zip(*(t.encode(words) for t in (self.a, self.b)), strict=True)
        back = [_glued(of.take(pa.array(ids)), _edges(n), b"") for of, ids, n in zip(self.bytes, flat, lengths, strict=True)]
        want = pa.array([" " + w for w in words]).cast(pa.binary())
        whole = pc.and_(*(pc.equal(b, want) for b in back)).to_numpy(zero_copy_only=False)
        counts, tokens = [], []
        for ids, length, size in zip(flat, lengths, (self.a.sizes, self.b.sizes), strict=True):
            ids, n = ids[np.repeat(whole, length)], np.where(whole, length, 0)
            ends = np.cumsum(size[ids])
            counts.append(n)
            tokens.append({"n": np.arange(len(ids)), "w": np.repeat(np.arange(len(words)), n), "id": ids, "s": ends - size[ids], "e": ends})
        links, (group_a, group_b) = self._joined(tokens)
        groups = self._texts(tokens, group_a, group_b, len(words))
        stats = np.zeros((len(words), 5), np.int64)
        stats[:, 0], stats[:, 1], stats[:, 2] = whole, counts[0], counts[1]
        if len(group_a):
            last = np.cumsum(counts[0])[whole] - 1
            stats[whole, 3] = np.diff(group_a[last] + 1, prepend=0)
        stats[:, 4] = np.bincount(links["w"], minlength=len(words))
        self.groups += groups
        self.used = np.concatenate([self.used, np.zeros(len(words), np.int64)])
        self.stats = np.concatenate([self.stats, stats])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(stats[:, 4])])
        self.pairs = np.concatenate([self.pairs, links["a"] << BITS | links["b"]])

    def _joined(self, tokens: list[dict]) -> tuple[dict, list[np.ndarray]]:
        a, b = (pa.table(t) for t in tokens)
        self.con.register("a", a)
        self.con.register("b", b)
        for x, y in ("ab", "ba"):
            self.con.execute(GROUPS.format(x=x, y=y))
        groups = [self.con.execute(f"SELECT g FROM {x}_groups ORDER BY n").fetchnumpy()["g"] for x in "ab"]
        links = self.con.execute(LINKS).fetchnumpy()
        self.con.unregister("a")
        self.con.unregister("b")
        return links, groups

    def _texts(self, tokens: list[dict], group_a: np.ndarray, group_b: np.ndarray, words: int) -> list[str]:
        """Each word's groups as a1,a2|b1;a3|b2."""
        of_group = [_glued(pc.cast(pa.array(side["id"]), pa.string()), _edges_of(group), ",") for side, group in zip(tokens, (group_a, group_b), strict=True)]
        both = pc.binary_join_element_wise(*of_group, "|")
        of_word = tokens[0]["w"][_edges_of(group_a)[:-1]]
        edges = _edges_of(of_word)
        out = [""] * words
        for word, text in zip(of_word[edges[:-1]].tolist(), _glued(both, edges, ";").to_pylist(), strict=True):
            out[word] = text
        return out


def _edges(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)])


def _edges_of(sorted_numbers: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers begins, and the end."""
    return np.concatenate([np.flatnonzero(np.diff(sorted_numbers, prepend=-1)), [len(sorted_numbers)]]) if len(sorted_numbers) else np.zeros(1, np.int64)


def _glued(values: pa.Array, edges: np.ndarray, between: str | bytes) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), values), between)


def summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and what their times add up to."""
    order = np.argsort(keys)
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(times, first) if len(first) else times


PAIRS = ("a", "b", "n")
ROW = {"row": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string()}
ROW_DDL = "row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, n array<long>"


def aligner(a: str, ranks: str, b: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, row, text) -> a row for each text with its numbers and pairs, and rows without a number that hold pairs of many texts added up."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words_known(a, ranks, b)
        if known.new:  # a task before has ended halfway
            known.forget()
        partial = none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for at, size in chunks(pc.utf8_length(batch["text"]).to_numpy()):
                piece = batch.slice(at, size)
                out, lists, of_chunk = aligned(known, piece["row"].to_pylist(), piece["text"].to_pylist())
                yield rows(piece["doc_id"], out, *lists)
                partial = summed(*(np.concatenate(two) for two in zip(partial, of_chunk, strict=True)))
                if len(partial[0]) > TASK_PAIRS:
                    yield rows(pa.nulls(1, kind), [(None,) * len(ROW)], np.array([len(partial[0])]), *partial)
                    partial = none
                if len(known) > WORDS or known.letters > LETTERS:
                    known.forget_rare()
        if len(partial[0]):
            yield rows(pa.nulls(1, kind), [(None,) * len(ROW)], np.array([len(partial[0])]), *partial)

    return align


def chunks(letters: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, rows) of consecutive rows with about CHUNK letters."""
    number = (np.cumsum(letters) - letters) // CHUNK
    first = np.flatnonzero(np.diff(number, prepend=-1)).tolist()
    return ((a, b - a) for a, b in zip(first, [*first[1:], len(letters)], strict=True))


def aligned(known: Words, numbers: list[int], texts: list[str]) -> tuple[list[tuple], tuple, tuple]:
    """What each text gives; its pairs as (how many by text, pairs, times); and the pairs of all texts."""
    none = np.zeros(0, np.int64)
    split = [np.fromiter(map(known.__getitem__, words := words_of(text)), np.int64, len(words)) if text else none for text in texts]
    known.align()
    out, held = [], []
    for n, (row, words) in enumerate(zip(numbers, split, strict=True)):
        if not len(words) or not known.stats[words, 0].all():
            out.append((row, 0, 0, 0, 0, ""))
            continue
        digest = hashlib.sha256(";".join(map(known.groups.__getitem__, words.tolist())).encode()).hexdigest()
        out.append((row, *known.stats[words, 1:].sum(axis=0).tolist(), digest))
        held.append((n, words))
    if not held:
        return out, (np.zeros(len(out), np.int64), none, none), (none, none)
    words = np.concatenate([w for _, w in held])
    of_text = np.repeat([n for n, _ in held], [len(w) for _, w in held])
    used, times = np.unique(words, return_counts=True)
    known.used[used] += times
    at, size = known.places(used)
    total = summed(known.pairs[at], np.repeat(times, size))
    at, size = known.places(words)
    # pairs as their numbers in total, so that text and pair make one key
    keys, times = summed(np.repeat(of_text, size) * len(total[0]) + np.searchsorted(total[0], known.pairs[at]), np.ones(len(at), np.int64))
    per_text = np.bincount(keys // len(total[0]), minlength=len(out))
    return out, (per_text, total[0][keys % len(total[0])], times), total


def rows(ids: pa.Array, values: list[tuple], per_row: np.ndarray, pairs: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    edges = pa.array(_edges(per_row), pa.int32())
    columns = (pairs >> BITS, pa.int32()), (pairs & (1 << BITS) - 1, pa.int32()), (times, pa.int64())
    lists = [pa.ListArray.from_arrays(edges, pa.array(v).cast(kind)) for v, kind in columns]
    return pa.RecordBatch.from_arrays([ids, *(pa.array(v, kind) for v, kind in zip(zip(*values, strict=True), ROW.values(), strict=True)), *lists], names=["doc_id", *ROW, *PAIRS])


def pair_counts(partial: DataFrame) -> DataFrame:
    """(a, b, count, best): the links of each pair in all texts, and whether no other pair of its B id has more."""
    counts = checkpointed(partial.select(F.inline(F.arrays_zip(*PAIRS))).groupBy("a", "b").agg(F.sum("n").alias("count")))
    # one row for each id of B, of which there are as many as its vocabulary has
    most = F.broadcast(counts.groupBy("b").agg(F.max("count").alias("most")))
    return checkpointed(counts.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best")))


def alignment(docs: DataFrame, a: str | None = None, ranks: str | None = None, b: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """A row per document (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), and the counts of pairs (a, b, count, best).

    A encodes " " + text, B encodes text and puts the space there itself. Texts are split at single spaces, where both begin a
    token; each Arrow partition tokenizes and joins every word that is new to it once, and texts add up the numbers of their
    words. What texts and partitions give is written once to the shared folder. The pairs of partitions, added up there, are
    merged in Spark; each text's pairs then meet the merged counts, which are broadcast while a count shows that they are
    few, and are shuffled beyond that.

    Null and empty texts, and those whose bytes don't come back from the tokens of A or B, have zeros and an empty digest, and
    their pairs don't count. Rows are aligned one by one, so repeated ones each have a row and their links count each time. An empty
    table gives no rows. Other columns are ignored.
    """
    import public_tokenizers

    a, ranks, b = a or public_tokenizers.path(A_FILE), ranks or public_tokenizers.path(A_RANKS), b or public_tokenizers.path(B_FILE)
    spark = docs.sparkSession
    numbered = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), text_of(text_col).alias("text"))
    folder = f"{shared_folder(spark)}/alignment-{uuid.uuid4().hex}"
    numbered.mapInArrow(aligner(a, ranks, b), f"doc_id {numbered.schema['doc_id'].dataType.simpleString()}, {ROW_DDL}").write.parquet(folder)
    written = spark.read.parquet(folder)
    counts = pair_counts(written.where("row IS NULL"))
    texts = written.where("row IS NOT NULL")
    few = counts.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS
    links = texts.select("row", F.inline(F.arrays_zip(*PAIRS))).join(F.broadcast(counts) if few else counts, ["a", "b"])
    sums = links.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n"))).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    none = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")]
    out = texts.drop(*PAIRS).join(sums, "row", "left")
    out = checkpointed(out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *none, "groups_sha256"))
    removed(spark, folder)
    return out, counts


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents"))[0]
