"""How the tokens of two vocabularies, A and B, meet in the same bytes.

Each token covers a range of a document's bytes. Where tokens of both vocabularies
end at one place, the tokens up to there form a group; an A and a B token whose
ranges overlap are linked. Most groups are one A and one B token with the same
bytes, so an array from each A id to the B id of those bytes, computed once, names
their link by the A id alone. Such links are counted in vectors as long as the
vocabulary, one for each task, and only links of irregular groups, those of other
pairs of ids, enter a shuffle of pairs.

The documents that hold a pair are counted over the whole corpus and given back to
each document. Vectors, one number for each id, are broadcast. So are the counts
of frequent pairs: of T (document, pair) rows a pair with more than T /
``FREQUENT`` is one of at most ``FREQUENT`` pairs. All other pairs are joined by
a shuffle in which no key holds more than that part of the rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsight.llm.common import batches, small_batches, stored, text_of

FREQUENT = 100_000
CHUNK = 1 << 17  # Letters that are looked at together,
RUN = 512  # and parts that are encoded as one text.
KNOWN = 150_000
KNOWN_LETTERS = 1 << 23
CUT = re.compile(r"(?<=\S) (?=\S)")
NONE = -1


def tokenizer_paths() -> dict[str, str]:
    import public_tokenizers

    return {"a": public_tokenizers.path("byte_bpe_50k.json"), "b": public_tokenizers.path("piece_bpe_32k.model")}


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 for itself, others from 256 on."""
    itself = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in itself]
    return {chr(b): b for b in itself} | {chr(256 + i): b for i, b in enumerate(others)}


class Coders:
    """Both encoders, the bytes of their tokens, and the B id with the bytes of each A id."""

    def __init__(self, paths: dict[str, str]):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(paths["a"])
        # Strings of special tokens inside texts are plain text.
        self.first.encode_special_tokens = True
        self.second = SentencePieceProcessor(model_file=paths["b"])
        letters = byte_letters()
        with open(paths["a"], encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        self.a = [b""] * self.first.get_vocab_size()
        for token, i in vocabulary.items():
            self.a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.b = [self._piece(i) for i in range(self.second.get_piece_size())]
        # A piece of text comes before the piece that stands for its single byte.
        same: dict[bytes, int] = {}
        for i in sorted(range(len(self.b)), key=self.second.is_byte):
            same.setdefault(self.b[i], i)
        self.same = np.array([same.get(t, NONE) if t else NONE for t in self.a], dtype=np.int64)
        self.a_size = np.array([len(t) for t in self.a], dtype=np.int64)
        self.b_size = np.array([len(t) for t in self.b], dtype=np.int64)
        # Each number with what follows it in written groups.
        self.numbers = [f"{i}{mark}" for mark in ",|;" for i in range(max(len(self.a), len(self.b)))]

    def _piece(self, i: int) -> bytes:
        piece = self.second.id_to_piece(i)
        if self.second.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """A and B ids of texts, one after the other; None where the bytes of either are not a blank and the text for each."""
        want = "".join([" " + t for t in texts]).encode()
        first = self.first.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        sides = list(chain.from_iterable(x.ids for x in first)), list(chain.from_iterable(self.second.encode(texts, num_threads=1)))
        if any(b"".join(map(spell.__getitem__, ids)) != want for spell, ids in zip((self.a, self.b), sides, strict=True)):
            return None
        return tuple(np.array(ids, dtype=np.int64) for ids in sides)


class Links:
    """The groups and links of two rows of ids that spell the same bytes, in order."""

    def __init__(self, coders: Coders, a: np.ndarray, b: np.ndarray):
        a_end, b_end = np.cumsum(coders.a_size[a]), np.cumsum(coders.b_size[b])
        # Tokens that end where one of the other side does close a group.
        beside = np.searchsorted(b_end, a_end)
        closes = b_end[np.minimum(beside, len(b) - 1)] == a_end
        b_closes = np.zeros(len(b), dtype=bool)
        b_closes[beside[closes]] = True
        self.a, self.b = a, b
        self.ends = a_end[closes]  # In bytes, of each group.
        self.a_group, self.b_group = np.cumsum(closes) - closes, np.cumsum(b_closes) - b_closes
        sizes = np.bincount(self.a_group), np.bincount(self.b_group)
        single = (sizes[0] == 1) & (sizes[1] == 1)
        # The fast path: one token on each side, and the B id is that of the array.
        x, y = a[single[self.a_group]], b[single[self.b_group]]
        known = coders.same[x] == y
        regular = np.flatnonzero(single)[known]
        # Everything else: up to each end of either side one A and one B token overlap.
        odd = np.ones(len(self.ends), dtype=bool)
        odd[regular] = False
        cuts = np.union1d(a_end[odd[self.a_group]], b_end[odd[self.b_group]])
        p, q = a[np.searchsorted(a_end, cuts)], b[np.searchsorted(b_end, cuts)]
        at = np.searchsorted(self.ends, cuts)
        # An irregular group can hold a pair of the array too; a document counts once for it.
        named = coders.same[p] == q
        # A ids of the links that the array names, and a * (B ids) + b of all others, with their groups.
        self.same, self.same_group = np.concatenate([x[known], p[named]]), np.concatenate([regular, at[named]])
        self.pairs, self.pair_group = p[~named] * len(coders.b) + q[~named], at[~named]

    def marked(self, numbers: list[str]) -> list[str]:
        """The ids in the order in which groups are written, each with its mark: ``1,`` ``2|`` ``7;``."""
        held = [np.concatenate([[0], np.cumsum(np.bincount(g))]) for g in (self.a_group, self.b_group)]
        third = len(numbers) // 3
        place = np.zeros(len(self.a) + len(self.b), dtype=np.int64)
        # The tokens of a group come after those of all groups before, A first; its last ones end the side.
        place[np.arange(len(self.a)) + held[1][self.a_group]] = self.a
        place[np.arange(len(self.b)) + held[0][self.b_group + 1]] = self.b
        place[held[0][1:] + held[1][:-1] - 1] += third
        place[held[0][1:] + held[1][1:] - 1] += 2 * third
        return list(map(numbers.__getitem__, place.tolist()))


class Note(NamedTuple):
    """What is kept of a text: its counts, its groups as ``a1,a2|b1;a3|b2,b3``, and each link with its number of times."""

    n_a: int
    n_b: int
    n_groups: int
    n_links: int
    groups: str
    same: np.ndarray
    same_times: np.ndarray
    pairs: np.ndarray
    pair_times: np.ndarray


NOTHING = Note(0, 0, 0, 0, "", *[np.zeros(0, dtype=np.int64)] * 4)


class Notes:
    """Notes of texts, by way of their parts.

    A cuts a text before each blank that a letter follows, and no piece of B holds a
    blank after a letter. So the parts of a text between blanks that stand alone
    have ids, groups and links of their own, whatever surrounds them. Words repeat:
    a part is looked at once and kept. When there are ``KNOWN`` of them the more used
    half stays; when they have ``KNOWN_LETTERS`` none does.
    """

    def __init__(self, coders: Coders):
        self.coders = coders
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.held = 0
        self.parts: list[str] = []
        self.groups: list[str | None] = []  # None where the tokens don't spell the part.
        self.uses = np.zeros(0, dtype=np.int64)
        self.sizes = np.zeros((0, 4), dtype=np.int64)
        self.same, self.pairs = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
        self.same_first, self.pair_first = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)

    def of(self, texts: list[str]) -> Iterator[Note]:
        if self.held > KNOWN_LETTERS:
            self._forget()
        elif len(self.parts) > KNOWN:
            self._halve()
        split = [CUT.split(t) if t else [] for t in texts]
        self._learn(set(chain.from_iterable(split)).difference(self.number))
        for parts in split:
            numbers = list(map(self.number.__getitem__, parts))
            try:
                groups = ";".join(map(self.groups.__getitem__, numbers))
            except TypeError:
                groups = ""
            if not groups:
                yield NOTHING
                continue
            at = np.array(numbers)
            part, times = np.unique(at, return_counts=True)
            self.uses[part] += 1
            yield Note(
                *self.sizes[at].sum(axis=0).tolist(),
                groups,
                *_summed(self.same, self.same_first, part, times),
                *_summed(self.pairs, self.pair_first, part, times),
            )

    def _halve(self) -> None:
        keep = np.sort(np.argsort(-self.uses, kind="stable")[: KNOWN // 2])
        self.parts, self.groups = ([held[i] for i in keep.tolist()] for held in (self.parts, self.groups))
        self.number = dict(zip(self.parts, range(len(keep)), strict=True))
        self.held = sum(map(len, self.parts))
        self.sizes, self.uses = self.sizes[keep], self.uses[keep] // 2
        (at, count), (pair_at, pair_count) = _places(self.same_first, keep), _places(self.pair_first, keep)
        self.same, self.pairs = self.same[at], self.pairs[pair_at]
        self.same_first, self.pair_first = (np.concatenate([[0], np.cumsum(n)]) for n in (count, pair_count))

    def _learn(self, parts: set[str]) -> None:
        run, size = [], 0
        for part in parts:
            # At a blank between two letters both vocabularies cut, so such parts can be encoded in one go.
            if part != part.strip():
                self._add([part])
                continue
            run.append(part)
            size += len(part)
            if size > CHUNK:
                self._add(run)
                run, size = [], 0
        if run:
            self._add(run)

    def _add(self, parts: list[str]) -> None:
        # Both encoders are slower on long texts.
        ids = self.coders.ids([" ".join(parts[i : i + RUN]) for i in range(0, len(parts), RUN)])
        ends = np.cumsum([len(p.encode()) + 1 for p in parts])
        links = Links(self.coders, *ids) if ids else None
        if links is None or not np.isin(ends, links.ends).all():
            if len(parts) > 1:
                for part in parts:
                    self._add([part])
                return
            links = None
        first, count = len(self.parts), len(parts)
        self.number.update(zip(parts, range(first, first + count), strict=True))
        self.parts += parts
        self.held += sum(map(len, parts))
        if links is None:
            self.groups.append(None)
            sizes, none = np.zeros((1, 4), dtype=np.int64), np.zeros(1, dtype=np.int64)
            self._extend(sizes, np.zeros(0, np.int32), none, np.zeros(0, np.int64), none)
            return
        of_group = np.searchsorted(ends, links.ends)
        same_of, pair_of = of_group[links.same_group], of_group[links.pair_group]
        tokens = [np.bincount(of_group[g], minlength=count) for g in (links.a_group, links.b_group)]
        linked = [np.bincount(x, minlength=count) for x in (same_of, pair_of)]
        sizes = np.stack([*tokens, np.bincount(of_group, minlength=count), linked[0] + linked[1]], axis=1)
        marked = links.marked(self.coders.numbers)
        cuts = np.concatenate([[0], np.cumsum(tokens[0] + tokens[1])]).tolist()
        self.groups += ["".join(marked[i:j])[:-1] for i, j in pairwise(cuts)]
        same = links.same[np.argsort(same_of, kind="stable")].astype(np.int32)
        self._extend(sizes, same, linked[0], links.pairs, linked[1])

    def _extend(self, sizes, same, same_count, pairs, pair_count) -> None:
        self.sizes = np.concatenate([self.sizes, sizes])
        self.uses = np.concatenate([self.uses, np.zeros(len(sizes), dtype=np.int64)])
        self.same, self.pairs = np.concatenate([self.same, same]), np.concatenate([self.pairs, pairs])
        self.same_first = np.concatenate([self.same_first, self.same_first[-1] + np.cumsum(same_count)])
        self.pair_first = np.concatenate([self.pair_first, self.pair_first[-1] + np.cumsum(pair_count)])


def _places(first: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the values of parts lie, one part after the other, and how many each has."""
    count = first[part + 1] - first[part]
    whole = np.cumsum(count)
    return np.arange(whole[-1]) + np.repeat(first[part] - whole + count, count), count


def _summed(flat: np.ndarray, first: np.ndarray, part: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values that parts hold in ``flat``, each once, and how often with each part ``times``."""
    at, count = _places(first, part)
    values, back = np.unique(flat[at], return_inverse=True)
    return values, np.bincount(back, np.repeat(times, count), len(values)).astype(np.int64)


@lru_cache(maxsize=1)
def notes_of(a: str, b: str) -> Notes:
    """The notes of a worker process, which its tasks share."""
    return Notes(Coders({"a": a, "b": b}))


def _rows(documents: DataFrame) -> DataFrame:
    small_batches(documents.sparkSession, rows=256, size="4m")
    return documents.select("doc_id", text_of("text").alias("text"))


def aligned(documents: DataFrame, paths: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, groups): for each row its groups in order, each with its ``a`` and its ``b`` ids.

    ``paths`` names the two tokenizer files, as ``tokenizer_paths`` does. A row
    whose text is NULL or empty, or whose tokens on either side do not spell a
    blank and the text, has no groups. Other columns are ignored.
    """
    paths = paths or tokenizer_paths()
    schema = "doc_id long, groups array<struct<a: array<int>, b: array<int>>>"
    kinds = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames):
            out = []
            for note in notes_of(paths["a"], paths["b"]).of(batch.column("text").to_pylist()):
                sides = [g.split("|") for g in note.groups.split(";") if g]
                out.append([{"a": list(map(int, a.split(","))), "b": list(map(int, b.split(",")))} for a, b in sides])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kinds)], ["doc_id", "groups"])

    return _rows(documents).mapInArrow(run, schema)


NOTED = (
    "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "same array<int>, same_times array<int>, pairs array<long>, pair_times array<int>"
)


def noted(documents: DataFrame, paths: dict[str, str] | None = None) -> DataFrame:
    """The links of each row, once each with the number of times, in the columns of ``NOTED``."""
    paths = paths or tokenizer_paths()
    texts = _rows(documents).withColumn("row", F.monotonically_increasing_id())
    names = [c.split()[0] for c in NOTED.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.string()] + [pa.list_(pa.int32())] * 2 + [pa.list_(pa.int64()), pa.list_(pa.int32())]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames):
            out = []
            for note in notes_of(paths["a"], paths["b"]).of(batch.column("text").to_pylist()):
                digest = hashlib.sha256(note.groups.encode()).hexdigest() if note.groups else ""
                out.append((*note[:4], digest, *note[5:]))
            columns = [batch.column("row"), batch.column("doc_id")]
            columns += [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds[2:], strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return texts.mapInArrow(run, NOTED)


def vocabulary_counts(notes: DataFrame, ids: int) -> DataFrame:
    """(a, n): how many rows hold the link of ``a`` named by the array, from one vector a task."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(ids, dtype=np.int64)
        for batch in batches(frames):
            # A row names an id once.
            held += np.bincount(batch.column("same").flatten().to_numpy(), minlength=ids)
        found = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(held[found], pa.int64())], ["a", "n"])

    return notes.select("same").mapInArrow(run, "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))


def pair_counts(notes: DataFrame) -> DataFrame:
    """(pair, n): how many rows hold each link of another pair."""
    return notes.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))


def vector(spark: SparkSession, rows: DataFrame, ids: int) -> np.ndarray:
    """(a, n) as a vector; there are at most ``ids`` rows."""
    found = rows.select("a", "n").toArrow()
    out = np.zeros(ids, dtype=np.int64)
    out[found["a"].to_numpy()] = found["n"].to_numpy()
    return out


def link_counts(documents: DataFrame, paths: dict[str, str] | None = None, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of ``documents``.

    ``documents`` has doc_id and text; other columns are ignored. A link is an
    A and a B token of one row whose bytes overlap; its count is the number of
    rows that hold a link of the same two ids. ``n_best`` counts the links whose
    count is the highest of their A id, ties included, and ``count_sum`` adds up
    the counts of all links. ``groups_sha256`` is the digest of the groups, which
    ``aligned`` gives, written as ``a1,a2|b1;a3|b2,b3``.

    A row whose text is NULL or empty, or whose tokens on either side do not
    spell a blank and the text, has zeros and an empty digest. Texts are encoded
    whole, however long. Repeated rows, and rows that share an id or have none,
    count each for itself. An empty table gives an empty one. ``paths`` names the
    tokenizer files. The session's Arrow batches are made smaller for good.
    """
    spark = documents.sparkSession
    coders = Coders(paths or tokenizer_paths())
    a_ids, b_ids = len(coders.a), len(coders.b)
    notes = stored(noted(documents, paths))
    same = vector(spark, vocabulary_counts(notes, a_ids), a_ids)
    counts = stored(pair_counts(notes)).withColumn("a", F.floor(F.col("pair") / b_ids))
    highest = np.maximum(same, vector(spark, counts.groupBy("a").agg(F.max("n").alias("n")), a_ids))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    # Fewer than ``frequent`` pairs can pass, whatever the corpus.
    often = F.col("n") * frequent > total
    top = counts.where(often).select("pair", "n").toArrow()
    order = np.argsort(top["pair"].to_numpy())
    held = spark.sparkContext.broadcast((same, highest, top["pair"].to_numpy()[order], top["n"].to_numpy()[order]))

    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    schema += ", best long, total long, pairs array<long>, pair_times array<int>"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same, highest, keys, values = held.value
        for batch in batches(frames):
            ids, times, row_of = _flat(batch, "same", "same_times")
            pairs, pair_times, pair_row = _flat(batch, "pairs", "pair_times")
            at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
            known = keys[at] == pairs if len(keys) else np.zeros(len(pairs), dtype=bool)
            n, count = batch.num_rows, values[at[known]] if len(keys) else np.zeros(0, np.int64)
            best, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for rows, often, count, a in (
                (row_of, times, same[ids], ids),
                (pair_row[known], pair_times[known], count, pairs[known] // b_ids),
            ):
                np.add.at(total, rows, often * count)
                np.add.at(best, rows, often * (count == highest[a]))
            left = ~known
            offsets = np.concatenate([[0], np.cumsum(np.bincount(pair_row[left], minlength=n))]).astype(np.int32)
            lists = [
                pa.ListArray.from_arrays(offsets, pa.array(values, kind))
                for values, kind in ((pairs[left], pa.int64()), (pair_times[left], pa.int32()))
            ]
            columns = [batch.column(c) for c in names[:7]] + [pa.array(best), pa.array(total), *lists]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = stored(notes.mapInArrow(run, schema))
    rare = rows.select("row", F.inline(F.arrays_zip("pairs", "pair_times"))).toDF("row", "pair", "times")
    top_of = spark.createDataFrame(pa.table({"a": np.arange(a_ids), "highest": highest}))
    rest = counts.where(~often).join(F.broadcast(top_of), "a")
    rest = rest.select("pair", "n", F.when(F.col("n") == F.col("highest"), 1).otherwise(0).alias("is_best"))
    more = rare.join(rest, "pair").groupBy("row").agg(
        F.sum(F.col("times") * F.col("is_best")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more")
    )
    return rows.join(more, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        (F.col("best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("total") + F.coalesce("more", F.lit(0))).alias("count_sum"),
        "groups_sha256",
    )


def _flat(batch: pa.RecordBatch, values: str, times: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The values and times of all rows, and the row of each."""
    column = batch.column(values)
    sizes = np.diff(column.offsets.to_numpy())
    row = np.repeat(np.arange(batch.num_rows), sizes)
    return (
        column.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
        batch.column(times).flatten().to_numpy(zero_copy_only=False).astype(np.int64),
        row,
    )
