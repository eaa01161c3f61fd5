"""Mix sources to target weights by a low-discrepancy schedule.

The mix is a row of slots of ``block_words`` words each. Slot i gets the point
frac(i * golden ratio); the cumulative shares of the sources map it to one of
them. The documents of a source, in an order shuffled by hash, form a stream
of words, cut into blocks of the same length; it starts anew where it ends.
The k-th slot of a source takes the k-th block. Any run of slots has nearly the
target shares, and nothing but sums per source reaches the driver.

The points miss a target by a few blocks, and a small source may get no point at
all. So each source's stream ends at its target, in whole words: the slot that
reaches it is short, later ones are empty, and the blocks that got no slot come
in further slots at the end.

Running sums never put a source into one task: documents are summed per hash
range first, the ranges' sums are added up, and the sums inside a range start
from there. Slots are ranked in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsight.llm.common import WORD, durable, running

BLOCK_WORDS = 128
WEIGHTS = (1, 2, 3)
MOST_TIMES = 3
RANGE_ROWS = 4096
SLOT_RANGE = 65_536
GOLDEN = 0.6180339887498949
SEED = 11


def word_count(column: str) -> Column:
    """Number of words of a text, 0 for NULL."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES) -> list[float]:
    """Target words of each source; ``sizes`` in the order in which weights repeat.

    The sources share the sum of sizes by weight; a target stops at ``most``
    times its source's size and the excess is shared again by weight.
    """
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out = [0.0] * len(sizes)
    free = set(range(len(sizes)))
    left = float(sum(n for _, n in sizes))
    while free:
        whole = sum(weight[i] for i in free)
        over = {i for i in free if left * weight[i] / whole > most * sizes[i][1]}
        for i in over or free:
            out[i] = float(most * sizes[i][1]) if over else left * weight[i] / whole
        if not over:
            break
        left -= sum(out[i] for i in over)
        free -= over
    return out


def place_of(seed: int) -> Column:
    """A row's place in the shuffled order of its source."""
    return F.xxhash64(F.lit(seed), "doc_id", F.coalesce("text", F.lit("")))


class Mix:
    """The plan of a mix: ``sources`` (at the driver), ``documents`` and ``pieces``."""

    def __init__(
        self,
        documents: DataFrame,
        weights: tuple[int, ...] = WEIGHTS,
        most: int = MOST_TIMES,
        block_words: int = BLOCK_WORDS,
        seed: int = SEED,
    ):
        """``documents``: doc_id, text, source; other columns are ignored.

        A NULL text has no words; NULL is a source of its own, the last. A
        document without words is never taken. Rows that share a doc_id count
        each for itself; rows equal in all three columns are interchangeable.
        No row gives an empty mix.
        """
        spark = documents.sparkSession
        rows = documents.select(
            "doc_id",
            "source",
            word_count("text").alias("size"),
            place_of(seed).alias("place"),
            F.monotonically_increasing_id().alias("row"),
        )
        self.rows = durable(rows)
        found = self.rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
        found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8")))
        goal = targets([(r["source"], r["size"]) for r in found], weights, most)
        self.sources = [(i, r["source"], r["size"], t, r["n"]) for i, (r, t) in enumerate(zip(found, goal, strict=True))]
        self.block_words = block_words
        named = spark.createDataFrame(
            self.sources or [(0, None, 0, 0.0, 0)], "sid int, source string, source_size long, target double, n long"
        ).where(F.lit(bool(self.sources)))
        # Each source's order is cut into as many hash ranges as it has thousands of rows.
        ranges = F.ceil(F.col("n") / RANGE_ROWS)
        self.documents = (
            self.rows.join(named, self.rows.source.eqNullSafe(named.source))
            .drop(named.source)
            .withColumn("range", F.floor((F.col("place") / F.lit(2.0**64) + 0.5) * ranges))
        )
        goal_words = sum(goal)
        self.points = int(goal_words // block_words + (goal_words % block_words > 0))
        self.most = most
        given = {r["sid"]: r["n"] for r in self._pointed().groupBy("sid").agg(F.count("*").alias("n")).collect()}
        # (sid, blocks with a slot, blocks in all, first further slot) of each source that lacks blocks.
        self.lacking, self.slots = [], self.points
        for sid, _, _, want, _ in self.sources:
            had, blocks = given.get(sid, 0), -(-round(want) // block_words)
            if blocks > had:
                self.lacking.append((sid, had, blocks, self.slots))
                self.slots += blocks - had

    def _pointed(self) -> DataFrame:
        """(slot, sid, run, one): the source that each point names."""
        spark = self.rows.sparkSession
        whole = sum(t for *_, t, _ in self.sources) or 1.0
        point = F.pmod(F.col("id") * F.lit(GOLDEN), F.lit(1.0))
        edges, below = [], 0.0
        for sid, _, _, goal, _ in self.sources:
            below += goal / whole
            edges.append((sid, below))
        edges = [e for e in edges if e[1] > 0] or [(0, 0.0)]
        # The number of sources whose cumulative share a point has passed names its source.
        passed = F.filter(F.array(*[F.lit(e) for _, e in edges[:-1]]).cast("array<double>"), lambda e: e <= point)
        pick = F.element_at(F.array(*[F.lit(sid) for sid, _ in edges]), F.size(passed) + 1)
        return spark.range(self.points).select(
            F.col("id").alias("slot"), pick.alias("sid"), F.floor(F.col("id") / SLOT_RANGE).alias("run"), F.lit(1).alias("one")
        )

    def schedule(self) -> DataFrame:
        """(slot, sid, block): the source of each slot and its rank among that source's slots."""
        slots = running(self._pointed(), ["sid"], "run", ["slot"], "one", "block").select("slot", "sid", "block")
        if not self.lacking:
            return slots
        rows = self.rows.sparkSession.createDataFrame(self.lacking, "sid int, had long, blocks long, at long")
        block = F.explode(F.sequence(F.col("had"), F.col("blocks") - 1)).alias("block")
        further = rows.select("sid", "had", "at", block)
        return slots.unionByName(further.select((F.col("at") + F.col("block") - F.col("had")).alias("slot"), "sid", "block"))

    def pieces(self) -> DataFrame:
        """(slot, sid, block, row, doc_id, source, place, size, lap, start, words): which words of a document a slot holds."""
        begun = running(self.documents, ["sid"], "range", ["place", "doc_id", "row"], "size", "before")
        size, b = F.col("source_size"), self.block_words
        laps = begun.where("size > 0").withColumn("lap", F.explode(F.sequence(F.lit(0), F.lit(self.most - 1))))
        laps = laps.withColumn("from", F.col("before") + F.col("lap") * size)
        # A stream ends at its target; laps and blocks beyond it are not made.
        reach = F.rint("target").cast("long")
        laps = laps.where(F.col("from") < reach).withColumn("until", F.least(F.col("from") + F.col("size"), reach))
        last = F.col("until") - 1
        cut = laps.withColumn("block", F.explode(F.sequence(F.floor(F.col("from") / b), F.floor(last / b))))
        at = F.greatest(F.col("from"), F.col("block") * b)
        end = F.least(F.col("until"), (F.col("block") + 1) * b)
        cut = cut.select(
            "sid", "block", "row", "doc_id", "source", "place", "size", "lap", (at - F.col("from")).alias("start"), (end - at).alias("words")
        )
        return cut.join(self.schedule(), ["sid", "block"])

    def taken(self) -> DataFrame:
        """(doc_id, size, source_size, target, taken, source) for each row; taken counts repeats."""
        sums = self.pieces().groupBy("row").agg(F.sum("words").alias("taken"))
        return self.documents.join(sums, "row", "left").select(
            "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "source"
        )


def mixed(documents: DataFrame, **options) -> DataFrame:
    """The documents that the mix holds, in all their columns.

    A document comes once for each time the mix takes it whole, and once more,
    cut after its last word taken, for what is left. ``n_chars``, if there, is
    the new length. Documents that the mix doesn't take go.
    """
    seed = options.get("seed", SEED)
    plan = Mix(documents, **options)
    # Rows equal in id and text are one row here, taken as often as all of them.
    sums = plan.pieces().groupBy("doc_id", "place", "source").agg(F.sum("words").alias("_words"), F.max("size").alias("_size"))
    sums = sums.select(F.col("doc_id").alias("_id"), F.col("place").alias("_place"), F.col("source").alias("_source"), "_words", "_size")
    named = documents.withColumn("_at", place_of(seed)).dropDuplicates(["doc_id", "_at", "source"])
    both = named.join(
        sums,
        (named["_at"] == sums["_place"]) & named["doc_id"].eqNullSafe(sums["_id"]) & named["source"].eqNullSafe(sums["_source"]),
    )
    whole, rest = F.floor(F.col("_words") / F.col("_size")), F.col("_words") % F.col("_size")
    kept = F.when(whole > 0, F.array_repeat(F.col("_size"), whole.cast("int"))).otherwise(F.array().cast("array<bigint>"))
    kept = F.concat(kept, F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    out = both.withColumn("_keep", F.explode(kept))
    words = F.split("text", "(?<=[\\x20\\x09-\\x0D])(?=[^\\x20\\x09-\\x0D])")
    lead = F.when(F.regexp_like("text", F.lit("^[\\x20\\x09-\\x0D]")), 1).otherwise(0)
    cut = F.rtrim(F.array_join(F.slice(words, F.lit(1), (F.col("_keep") + lead).cast("int")), ""))
    out = out.withColumn("text", F.when(F.col("_keep") == F.col("_size"), F.col("text")).otherwise(cut))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(documents.schema["n_chars"].dataType))
    return out.select(*documents.columns)
