"""Pack documents into windows of tokens with their lexical neighbours.

Document frequencies, the number of documents and their mean length are summed
over all documents. A document asks for its ``query_terms`` heaviest BM25 terms
among those that other documents have too. All documents are put in the order
of the four least of these under one shuffle of the vocabulary (a MinHash), so
that documents which ask for much the same stand together wherever they were
stored, and a common first term is split by the next ones. Runs of this order,
of at most ``shard_docs`` documents and ``shard_tokens`` tokens, are shards.

Each shard has an inverted index: token id -> documents with their BM25 weights
by the sums over all documents. A window starts with a seed document; the index
returns the unused documents of the shard that score best for the seed's terms,
and they fill the window in that order. A neighbour that doesn't fit is cut, and
its rest seeds the next window, so only the last window of a shard has padding.
Neighbours in other shards are lost. Token ids cross the network once, texts
never do, and a task holds one shard at a time.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfsight.llm.common import batches, small_batches, stored, text_of
from shelfsight.llm.tokens import END, Tokens, tokenizer_paths

WINDOW = 1024
SHARD_DOCS = 2048
SHARD_TOKENS = 2_000_000
QUERY_TERMS = 32
K1, B = 1.2, 0.75
VOCABULARY = 1 << 16
KEY_TERMS = 4
SEED = 17

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")),
    ]
)


def terms(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, times) in order, of documents whose ids stand one after the other between ``bounds``."""
    n = len(bounds) - 1
    # Short words sort faster.
    kind = np.uint32 if n <= 1 << 16 else np.uint64
    keys = np.repeat(np.arange(n, dtype=kind) << kind(16), np.diff(bounds)) | ids.astype(kind)
    keys.sort()
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    count = np.diff(np.r_[at, len(keys)])
    keys = keys[at].astype(np.int64)
    return keys >> 16, keys & 0xFFFF, count


def heaviest(weight: np.ndarray, bounds: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """The places of the greatest weights between neighbouring ``bounds``, greatest first, ties by place."""
    for a, b in pairwise(bounds.tolist()):
        held = -weight[a:b]
        if b - a > most:
            # All that weigh as much as the last one are in, so that ties go by place.
            some = np.flatnonzero(held <= np.partition(held, most - 1)[most - 1])
            yield a + some[np.argsort(held[some], kind="stable")][:most]
        else:
            yield a + np.argsort(held, kind="stable")


@dataclass(frozen=True)
class Statistics:
    """What BM25 needs of a whole corpus: documents, mean length, and documents that hold each term."""

    n: int
    mean: float
    df: np.ndarray

    @classmethod
    def of(cls, docs: list[np.ndarray]) -> Statistics:
        held = np.concatenate([np.unique(d) for d in docs])
        return cls(len(docs), sum(map(len, docs)) / len(docs), np.bincount(held, minlength=VOCABULARY))

    @cached_property
    def idf(self) -> np.ndarray:
        return np.log1p((self.n - self.df + 0.5) / (self.df + 0.5))

    def weights(self, term: np.ndarray, count: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return self.idf[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * size / self.mean))


SHUFFLED = np.random.default_rng(SEED).permutation(VOCABULARY)


def places_of(ids: np.ndarray, bounds: np.ndarray, whole: Statistics, query_terms: int = QUERY_TERMS) -> list[int]:
    """The documents' places in the order that is cut into shards."""
    doc, term, count = terms(ids, bounds)
    met = whole.df[term] > 1
    doc, term, count = doc[met], term[met], count[met]
    weight = whole.weights(term, count, np.diff(bounds)[doc])
    places = []
    for asked in heaviest(weight, np.searchsorted(doc, np.arange(len(bounds))), query_terms):
        least = np.sort(SHUFFLED[term[asked]])[:KEY_TERMS].tolist()
        place = 0
        for x in [*least, *[VOCABULARY - 1] * (KEY_TERMS - len(least))]:
            place = place << 16 | x
        places.append(place - (1 << 63))
    return places


class Bm25:
    """An inverted index over the token ids of one shard's documents, weighted by the statistics of all."""

    def __init__(self, docs: list[np.ndarray], query_terms: int = QUERY_TERMS, whole: Statistics | None = None):
        sizes = np.array([len(d) for d in docs])
        doc, term, count = terms(np.concatenate(docs), np.r_[0, np.cumsum(sizes)])
        weight = (whole or Statistics.of(docs)).weights(term, count, sizes[doc])
        df = np.bincount(term, minlength=VOCABULARY)
        order = np.argsort(term.astype(np.uint16), kind="stable")
        self.first = np.r_[0, np.cumsum(df)]
        self.docs, self.weights = doc[order], weight[order]
        # A document's heaviest terms are what it asks for, those of no other document of the shard apart.
        met = df[term] > 1
        doc, term, weight = doc[met], term[met], weight[met]
        self.asked = [term[t].tolist() for t in heaviest(weight, np.searchsorted(doc, np.arange(len(docs) + 1)), query_terms)]
        self.sizes = sizes

    def neighbours(self, seed: int, used: np.ndarray, room: int | None = None) -> np.ndarray:
        """Unused documents that share an asked term, the best score first, ties by place.

        As many as ``room`` tokens need, or all where it is None.
        """
        parts = [slice(self.first[t], self.first[t + 1]) for t in self.asked[seed]]
        if not parts:
            return np.zeros(0, dtype=np.int64)
        docs = np.concatenate([self.docs[p] for p in parts])
        found = np.bincount(docs, np.concatenate([self.weights[p] for p in parts]), len(used))
        found[used] = 0
        some = np.flatnonzero(found)
        most = 64
        while room is not None and len(some) > most:
            # All documents that score as the last of them does are in, so that ties go by place.
            last = np.partition(found[some], len(some) - most)[len(some) - most]
            best = some[found[some] >= last]
            if self.sizes[best].sum() >= room:
                some = best
                break
            most *= 4
        return some[np.lexsort((some, -found[some]))]


def windows(
    docs: list[np.ndarray], size: int, query_terms: int = QUERY_TERMS, whole: Statistics | None = None
) -> Iterator[list[tuple[int, int, int]]]:
    """Windows as pieces (document, start, length); each token of ``docs`` is in one."""
    used = np.zeros(len(docs), dtype=bool)
    index = Bm25(docs, query_terms, whole) if len(docs) > 1 else None
    following, waiting = 0, None
    while True:
        if waiting is None:
            while following < len(docs) and used[following]:
                following += 1
            if following == len(docs):
                return
            waiting = (following, 0)
            used[following] = True
        seed, start = waiting
        waiting = None
        while len(docs[seed]) - start >= size:
            yield [(seed, start, size)]
            start += size
        free = size - (len(docs[seed]) - start)
        if free == size:
            continue
        window = [(seed, start, size - free)]
        near = index.neighbours(seed, used, free) if index else ()
        places = iter(near)
        while free:
            other = next(places, None)
            if other is None:
                while following < len(docs) and used[following]:
                    following += 1
                if following == len(docs):
                    break
                other = following
            if used[other]:
                continue
            used[other] = True
            piece = min(free, len(docs[other]))
            window.append((int(other), 0, piece))
            free -= piece
            if piece < len(docs[other]):
                waiting = (int(other), piece)
        yield window


def _pieces(
    ids: list, docs: list[np.ndarray], first: int, size: int, query_terms: int, whole: Statistics
) -> tuple[list[tuple], int]:
    out, sequence = [], first
    for window in windows(docs, size, query_terms, whole):
        offset = 0
        for doc, start, length in window:
            crc = zlib.crc32(docs[doc][start : start + length].astype("<u4").tobytes())
            out.append((ids[doc], start, length, crc, len(docs[doc]), sequence, offset))
            offset += length
        sequence += 1
    return out, sequence


def _tokenized(documents: DataFrame, paths: dict[str, str]) -> DataFrame:
    """(doc_id, row, ids): the token ids of each row, 2 bytes each, with the end."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = Tokens(paths), np.uint16(END).tobytes()
        for batch in batches(frames):
            ids = [tokens.ids(t).tobytes() + end for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array(ids, pa.binary())], ["doc_id", "row", "ids"]
            )

    rows = documents.select("doc_id", F.monotonically_increasing_id().alias("row"), text_of("text").alias("text"))
    return stored(rows.mapInArrow(run, "doc_id long, row long, ids binary"))


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of them, one document after the other, and the places where each begins and the last one ends."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, bounds, held = column.buffers()
    bounds = np.frombuffer(bounds, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 2
    ids = np.frombuffer(held, dtype=np.uint16, count=bounds[-1])
    return ids[bounds[0] :], bounds - bounds[0]


def statistics(tokenized: DataFrame) -> Statistics:
    """The statistics of all rows; the driver receives one number for each term of the vocabulary."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, size = np.zeros(VOCABULARY, dtype=np.int64), 0, 0
        for batch in batches(frames):
            ids, bounds = _ids(batch.column("ids"))
            df += np.bincount(terms(ids, bounds)[1], minlength=VOCABULARY)
            n, size = n + batch.num_rows, size + len(ids)
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[-2, -1, term], pa.int64()), pa.array(np.r_[n, size, df[term]], pa.int64())], ["term", "n"]
        )

    sums = tokenized.select("ids").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r.term: r.n for r in sums.collect()}
    n, size = found.pop(-2, 0), found.pop(-1, 0)
    df = np.zeros(VOCABULARY, dtype=np.int64)
    df[list(found)] = list(found.values())
    return Statistics(n, size / max(n, 1), df)


def packed(
    documents: DataFrame,
    tokenizer: dict[str, str] | None = None,
    window: int = WINDOW,
    shard_docs: int = SHARD_DOCS,
    shard_tokens: int = SHARD_TOKENS,
    query_terms: int = QUERY_TERMS,
) -> DataFrame:
    """The pieces of every row of ``documents`` (doc_id, text).

    A document is its token ids and the id 0. Columns: doc_id, start (its ids
    before the piece), length, ids_crc32 (of the piece's ids as little-endian
    unsigned 32-bit numbers), doc_tokens (its ids, with the end), sequence_id,
    offset (place in the sequence, without gaps from 0). A NULL or empty text
    is the id 0 alone; rows that share a doc_id are packed each for itself;
    long texts fill windows of their own but for their rest. Equal scores go by
    place in the shard. Where the rows are stored has no say in what is near. Other columns are ignored; no row gives no row.
    """
    small_batches(documents.sparkSession)
    rows = _tokenized(documents, tokenizer or tokenizer_paths())
    found = statistics(rows)
    # Ranges of about four fifths of a shard, so that most hold one shard and no short rest.
    parts = math.ceil(1.25 * max(found.n / shard_docs, found.n * found.mean / shard_tokens, 0.8))
    shared = documents.sparkSession.sparkContext.broadcast((found.n, found.mean, found.df))

    def placed(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = Statistics(*shared.value)
        for batch in batches(frames):
            places = pa.array(places_of(*_ids(batch.column("ids")), whole, query_terms), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, places], [*batch.schema.names, "place"])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, ids, docs, held, sequence = Statistics(*shared.value), [], [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal ids, docs, held, sequence
            rows, sequence = _pieces(ids, docs, (part << 33) + sequence, window, query_terms, whole)
            sequence -= part << 33
            ids, docs, held = [], [], 0
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, SCHEMA.names)

        part = 0
        for batch in batches(frames):
            part = batch.column("part")[0].as_py()
            for doc_id, tokens in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                found = np.frombuffer(tokens, dtype=np.uint16)
                if docs and held + len(found) > shard_tokens:
                    yield from flush()
                ids.append(doc_id)
                docs.append(found)
                held += len(found)
                if len(docs) >= shard_docs:
                    yield from flush()
        if docs:
            yield from flush()

    dealt = rows.mapInArrow(placed, "doc_id long, row long, ids binary, place long")
    dealt = dealt.repartitionByRange(parts, "place", "row").sortWithinPartitions("place", "row")
    return dealt.select("doc_id", "ids", F.spark_partition_id().alias("part")).mapInArrow(run, SCHEMA)
