"""Packing of documents into token sequences by lexical retrieval.

A document is its token ids and one end id. Whole windows of it are sequences of their own; what is left over is packed with
related left-overs. These are sorted by a sketch of their token pairs and cut into shards of bounded size. A shard has a
BM25 inverted index over token ids, with document frequencies and the average length taken from all documents. The first
unused left-over seeds a sequence, all its terms query the index, and its unused neighbours fill the window in the
order of their scores. The one that reaches the end is cut there and its rest seeds the next sequence, also across shards,
so only the last sequence of a task is padded.

Sizes: a term is a token id, so the frequencies broadcast are bounded by the vocabulary. Rows are spread by sketch and row
number, so no group of copies can fill a task.

Defined cases: a null text is an empty one and consists of the end id; a null or repeated id keeps its own pieces; an empty
table gives no rows; strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiermill.llm.common import keep, lean, tasks

K1, B = 1.2, 0.75
SHARD = 1024
TERMS_AT_ONCE = 2048
CACHED = 300_000
# Fixed value: how byte-level BPE cuts a text into groups before it merges bytes.
GROUPS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class _Index(dict):
    """Numbers for words in the order of their first lookup, and the token ids of every word with what stands before it."""

    def __init__(self) -> None:
        super().__init__()
        self.pending: list[str] = []
        self.flat, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.pending.append(word)
        return number

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.flat, self.lengths = np.concatenate((self.flat, ids)), np.concatenate((self.lengths, sizes))
        self.pending.clear()


def _byte_ranks(vocabulary: dict[str, int]) -> dict[bytes, int]:
    """Byte sequences of a byte-level vocabulary. Its characters stand for bytes: printable ones for themselves, the others,
    in order, for the code points from 256 on. Ids follow the order of the merges, so they are the ranks."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {
        chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))
    }
    return {bytes(byte_of[c] for c in token): id for token, id in vocabulary.items()}


class Encoder:
    """Token ids of whole texts by a byte-level BPE tokenizer file, each distinct word encoded once.

    A single space or line feed between two other characters always starts a token group, so a text without other white space
    is encoded word by word, each with what stands before it. Other texts are encoded whole. Strings of special tokens are
    ordinary text.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as file:
            known = json.load(file)
        special = {t["content"] for t in known["added_tokens"]}
        words = {t: i for t, i in known["model"]["vocab"].items() if t not in special}
        self.encoding = tiktoken.Encoding(path, pat_str=GROUPS, mergeable_ranks=_byte_ranks(words), special_tokens={})
        self.feed = self._ids("\n")
        if len(self.feed) != 1:
            raise ValueError("a line feed must be one token")
        self._clear()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), np.uint32)

    def _clear(self) -> None:
        self.spaced, self.fed = _Index(), _Index()

    def _learn(self) -> None:
        """Ids of the words met for the first time. Many are encoded at once, a line feed between them as in a text."""
        for index, before in ((self.spaced, " "), (self.fed, "")):
            if index.pending:
                ids = self._ids("\n" + "\n".join([before + w for w in index.pending]))
                feed = ids == self.feed[0]
                sizes = np.diff(np.append(np.flatnonzero(feed), len(ids)))
                # After a space the line feed only keeps the words apart; else it stands in the text.
                index.add(ids[~feed] if before else ids, sizes - 1 if before else sizes)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.spaced) > CACHED:
            self._clear()
        out: list = []
        spaced, fed = self.spaced.__getitem__, self.fed.__getitem__
        for text in texts:
            words = text.split()
            feeds = text.count("\n")
            between = text.count(" ") + feeds
            # Is there one separator between any two words, and no other white space?
            if between + 1 != len(words) or len("".join(words)) + between != len(text):
                out.append(self._ids(text))
                continue
            numbers = np.fromiter(map(spaced, words), np.int64, len(words)) if not feeds else np.empty(len(words), np.int64)
            heads, at = [], 0
            for line in text.split("\n"):
                stop = at + line.count(" ") + 1
                if feeds:
                    numbers[at + 1 : stop] = np.fromiter(map(spaced, words[at + 1 : stop]), np.int64, stop - at - 1)
                heads.append(at)
                at = stop
            numbers[heads] = [-1 - fed(words[i]) for i in heads]
            out.append((numbers,))
        self._learn()
        # Words after a line feed are numbered on from the others. The first word of a text is one of them, less the line feed.
        flat = np.concatenate((self.spaced.flat, self.fed.flat))
        lengths = np.concatenate((self.spaced.lengths, self.fed.lengths))
        starts, known = np.cumsum(lengths) - lengths, len(self.spaced.lengths)
        for i, found in enumerate(out):
            if isinstance(found, tuple):
                which = np.where(found[0] < 0, known - 1 - found[0], found[0])
                sizes = lengths[which]
                ends = np.cumsum(sizes)
                out[i] = flat[np.arange(ends[-1]) + np.repeat(starts[which] - ends + sizes, sizes)][1:]
        return out


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _sketch(ids: np.ndarray) -> int:
    """Smallest hash of the pairs of neighbouring ids."""
    wide = ids.astype(np.uint64)
    pairs = (wide[:-1] * np.uint64(0x9E3779B97F4A7C15) + wide[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) if len(wide) > 1 else wide
    pairs = (pairs ^ (pairs >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return int((pairs >> np.uint64(1)).min())


TOKENISED = "doc_tokens long, whole array<long>, rest binary, sketch long"


def tokenised(docs: DataFrame, path: str, window: int, id: str, text: str, end_id: int) -> DataFrame:
    """``id``, ``doc_tokens``, the checksums of its whole windows and the ids of what is left over, if anything."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            rows = []
            for ids in encoder.encode(batch.column(1).to_pylist()):
                ids = np.concatenate((ids, np.array([end_id], np.uint32)))
                cut = len(ids) - len(ids) % window
                rest = ids[cut:]
                whole = [crc(ids[a : a + window]) for a in range(0, cut, window)]
                rows.append((len(ids), whole, rest.astype("<u4").tobytes() or None, _sketch(rest) if len(rest) else None))
            columns = list(zip(*rows)) or [[]] * 4
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int64()]
            yield pa.record_batch(
                [batch.column(0), *[pa.array(list(c), k) for c, k in zip(columns, kinds)]],
                names=["id", *[x.split()[0] for x in TOKENISED.split(", ")]],
            )

    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(lean(run), f"id {rows.schema['id'].dataType.simpleString()}, {TOKENISED}")


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each term of a task its documents; under -1 the number of documents, under -2 their ids."""
    counts, documents, length = np.zeros(0, np.int64), 0, 0
    for batch in batches:
        for rest in batch.column(0).to_pylist():
            ids = np.unique(np.frombuffer(rest, "<u4"))
            if ids[-1] >= len(counts):
                counts = np.concatenate((counts, np.zeros(int(ids[-1]) + 1 - len(counts), np.int64)))
            counts[ids] += 1
            documents, length = documents + 1, length + len(rest) // 4
    terms = np.flatnonzero(counts)
    yield pa.record_batch(
        [pa.array(np.concatenate(([-1, -2], terms))), pa.array(np.concatenate(([documents, length], counts[terms])))],
        names=["term", "n"],
    )


class Shard:
    """A BM25 inverted index over some token sequences."""

    def __init__(self, texts: list[np.ndarray], idf: np.ndarray, average: float) -> None:
        self.texts = texts
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        owner = np.repeat(np.arange(len(texts)), lengths)
        # Postings, ordered by term and then by document.
        keys, tf = np.unique(np.concatenate(texts).astype(np.int64) * len(texts) + owner, return_counts=True)
        self.term, self.doc = keys // len(texts), keys % len(texts)
        norm = K1 * (1 - B + B * lengths[self.doc] / average)
        self.weight = idf[self.term] * tf * (K1 + 1) / (tf + norm)
        self.terms, self.begin = np.unique(self.term, return_index=True)
        self.end = np.append(self.begin[1:], len(self.term))

    def scores(self, query: np.ndarray) -> np.ndarray:
        """Scores of all sequences for all terms of a query."""
        terms = np.unique(query)
        places = np.searchsorted(self.terms, terms)
        places[places == len(self.terms)] = 0
        places = places[self.terms[places] == terms]
        begin, sizes = self.begin[places], (self.end - self.begin)[places]
        ends = np.cumsum(sizes)
        postings = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + sizes, sizes)
        return np.bincount(self.doc[postings], self.weight[postings], len(self.texts))

    def table(self) -> np.ndarray:
        """Scores of all sequences (columns) for each of them as the query (rows): the postings of some terms at a time, as one
        matrix product."""
        count = len(self.texts)
        found = np.zeros((count, count), np.float32)
        for first in range(0, len(self.terms), TERMS_AT_ONCE):
            last = min(first + TERMS_AT_ONCE, len(self.terms))
            a, b = self.begin[first], self.end[last - 1]
            place = np.repeat(np.arange(last - first), (self.end - self.begin)[first:last])
            has, weights = np.zeros((count, last - first), np.float32), np.zeros((last - first, count), np.float32)
            has[self.doc[a:b], place] = 1
            weights[place, self.doc[a:b]] = self.weight[a:b]
            found += has @ weights
        return found


class Packer:
    """Fills one window after another; ``pieces`` are (row, start in its left-over, length, sequence, offset)."""

    def __init__(self, window: int, idf: np.ndarray, average: float) -> None:
        self.window, self.idf, self.average = window, idf, average
        self.sequence, self.offset = 0, 0
        self.seed: np.ndarray | None = None
        self.seed_row: int | None = None  # of the present shard

    def _place(self, row: int, ids: np.ndarray, pieces: list[tuple]) -> None:
        start = 0
        while start < len(ids):
            length = min(len(ids) - start, self.window - self.offset)
            pieces.append((row, start, length, self.sequence, self.offset))
            if self.offset == 0:
                self.seed, self.seed_row = ids, row
            start, self.offset = start + length, self.offset + length
            if self.offset == self.window:
                self.sequence, self.offset, self.seed, self.seed_row = self.sequence + 1, 0, None, None

    @staticmethod
    def _best(found: np.ndarray, left: int) -> Iterator[int]:
        """The rows in order of their scores: first a few of the best, which mostly fill the window, then all."""
        few = 0
        if left > 64:
            few = 32
            limit = np.partition(found, len(found) - few)[len(found) - few]
            top = np.flatnonzero(found >= limit)
            few = len(top)
            yield from top[np.argsort(-found[top], kind="stable")].tolist()
        yield from np.argsort(-found, kind="stable")[few:left].tolist()

    def shard(self, texts: list[np.ndarray]) -> list[tuple]:
        index = Shard(texts, self.idf, self.average)
        table, self.seed_row = index.table(), None
        used, next_, left = np.zeros(len(texts), bool), 0, len(texts)
        pieces: list[tuple] = []
        while left:
            if self.seed is None:
                while used[next_]:
                    next_ += 1
                used[next_] = True
                left -= 1
                self._place(next_, texts[next_], pieces)
                continue
            # A seed from the shard before is looked up here, one of this shard has its scores.
            found = index.scores(self.seed) if self.seed_row is None else table[self.seed_row].copy()
            found[used] = -1.0
            sequence = self.sequence
            # The best first; of equal scores the earlier row.
            for row in self._best(found, left):
                used[row] = True
                left -= 1
                self._place(row, texts[row], pieces)
                if self.sequence != sequence:
                    break
        return pieces


def _pack(window: int, shared):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = ["start", "length", "ids_crc32", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, average = shared.value
        packer, task = Packer(window, idf, average), TaskContext.get().partitionId()

        def packed(rows: pa.Table) -> pa.RecordBatch:
            texts = [np.frombuffer(x, "<u4") for x in rows["rest"].to_pylist()]
            base = (rows["doc_tokens"].to_numpy() // window) * window
            pieces = packer.shard(texts)
            which = np.array([p[0] for p in pieces], np.int64)
            values = [
                (int(base[row]) + start, length, crc(texts[row][start : start + length]), ((task << 40) + sequence) * 2, offset)
                for row, start, length, sequence, offset in pieces
            ]
            taken = rows.select(["id", "doc_tokens"]).take(pa.array(which)).combine_chunks()
            columns = [taken.column(k).combine_chunks() for k in range(2)]
            columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
            return pa.record_batch(
                columns + [pa.array(list(c), k) for c, k in zip(zip(*values), kinds)], names=["id", "doc_tokens", *names]
            )

        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, SHARD - count)
                batch = batch.slice(part.num_rows)
                held.append(part)
                count += part.num_rows
                if count == SHARD:
                    yield packed(pa.Table.from_batches(held))
                    held, count = [], 0
        if count:
            yield packed(pa.Table.from_batches(held))

    return run


def pack(
    docs: DataFrame, path: str, window: int = 1024, id: str = "doc_id", text: str = "text", end_id: int = 0
) -> DataFrame:
    """One row per piece: ``id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``."""
    spark = docs.sparkSession
    rows = keep(
        tokenised(docs, path, window, id, text, end_id).withColumn("row", F.monotonically_increasing_id()), "tokens"
    )
    rests = rows.where("rest is not null")
    counted = {
        r.term: r.n
        for r in rests.select("rest").mapInArrow(_frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    }
    documents, length = counted.pop(-1, 0), counted.pop(-2, 0)
    frequency = np.zeros(max(counted, default=0) + 1)
    frequency[list(counted)] = list(counted.values())
    idf = np.log1p((documents - frequency + 0.5) / (frequency + 0.5))
    shared = spark.sparkContext.broadcast((idf, length / max(documents, 1)))
    kind = rows.schema["id"].dataType.simpleString()
    packed = (
        rests.select("id", "doc_tokens", "rest", "sketch", "row")
        .repartitionByRange(tasks(spark), "sketch", "row")
        .sortWithinPartitions("sketch", "row")
        .select("id", "doc_tokens", "rest")
        .mapInArrow(
            lean(_pack(window, shared)),
            f"id {kind}, doc_tokens long, start long, length long, ids_crc32 long, sequence_id long, offset long",
        )
    )
    # Whole windows are sequences of their own, under odd numbers.
    whole = rows.select("id", "doc_tokens", "row", F.posexplode("whole").alias("k", "ids_crc32")).select(
        "id",
        "doc_tokens",
        (F.col("k").cast("long") * window).alias("start"),
        F.lit(window).cast("long").alias("length"),
        "ids_crc32",
        "row",
        "k",
    )
    whole = whole.withColumn("sequence_id", F.monotonically_increasing_id() * 2 + 1).withColumn("offset", F.lit(0).cast("long"))
    columns = [F.col("id").alias(id), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return packed.select(*columns).unionByName(whole.select(*columns))
