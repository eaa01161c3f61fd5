"""Chat conversations as training windows of a bounded number of tokens.

A turn is written as ``<|im_start|>role``, a line feed, the text, ``<|im_end|>``
and a line feed. A backslash goes before every backslash of a text and into
every control string, so that texts can't end a turn and ``unescaped`` gives
them back; line feeds in a role are escaped as well.

Prefix sums of the turns' tokens cut a conversation into turn-aligned spans: a
window takes the turns that begin in one stride of half the free budget, and a
turn longer than that stride gets a window of its own. So a window never
exceeds the budget unless one turn does alone, and no turn is cut. Each window
repeats the system turn and the last turns of the window before, as far as
``history`` tokens reach; repeated turns are masked, so each assistant text is
a target once.

Everything is built from DataFrame operations. Running sums are taken per
stretch of ``STRETCH`` turn numbers first, so that one long conversation is
many tasks' work; rows are gathered per window only, which the budget bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsight.llm.common import running, stored

BUDGET = 1024
HISTORY = 256
TOKENS_PER_BYTE = 0.5
STRETCH = 1024
START, END = "<|im_start|>", "<|im_end|>\n"
# Control strings of common templates; each gets a backslash after its first character.
CONTROLS = r"<(?=\||/?s>|<SYS>>|</SYS>>)|\[(?=/?INST\])"


def escaped(text: Column) -> Column:
    twice = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(twice, f"({CONTROLS})", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escaped_role(role: Column) -> Column:
    return F.regexp_replace(escaped(role), "\n", "\\\\\n")


def tokens_of(text: Column) -> Column:
    """Tokens of a text: two bytes each, which a byte-level vocabulary rarely exceeds."""
    return F.ceil(F.octet_length(text) * F.lit(TOKENS_PER_BYTE)).cast("long")


def chat_windows(
    conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens=tokens_of
) -> DataFrame:
    """The windows of all rows of ``conversations`` (conv_id, turn, role, text).

    Columns: conv_id, window (from 0), text, tokens, over_budget, turns (number
    of turns in the text), repeated (how many of them, from the first, were in
    an earlier window) and targets (array of start and end, in code points from
    0, of the assistant texts under the loss mask).

    A NULL text or role is empty. Turns are ordered by number (NULL first), then
    role, then text; repeated rows and numbers are turns of their own. Only a
    first turn with the role ``system`` is retained. NULL is a conversation id
    like any other. Other columns are ignored; no row gives no window.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"),
        "conv_id",
        "turn",
        role.alias("role"),
        F.concat(F.lit(START), escaped_role(role), F.lit("\n")).alias("head"),
        escaped(text).alias("body"),
        F.coalesce(F.floor(F.col("turn") / STRETCH), F.lit(-(2**62))).alias("stretch"),
        F.lit(1).cast("long").alias("one"),
    )
    rows = rows.withColumn("cost", tokens(F.concat("head", "body", F.lit(END))))
    # A conversation's first turn is the least in the turns' order.
    first = rows.groupBy("conv").agg(F.min(F.struct("turn", "role", "body", "cost")).alias("first"))
    begun = first.where("first.role = 'system'").select("conv", F.col("first.cost").alias("system_cost"))
    rows = rows.join(begun, "conv", "left")
    # What a window has for new turns, and its half: the stride.
    free = F.greatest(F.lit(budget) - F.coalesce("system_cost", F.lit(0)) - history, F.lit(2))
    rows = rows.withColumn("stride", F.floor(free / 2)).withColumn("long", (F.col("cost") > F.col("stride")).cast("long"))
    order = ["turn", "role", "body"]
    rows = running(rows, ["conv"], "stretch", order, ["one", "cost", "long"], ["at", "before", "longs"])
    # Written once: the windows below read it several times.
    rows = stored(rows.drop("one", "turn", "stretch"))
    is_system = (F.col("at") == 0) & F.col("system_cost").isNotNull()
    system = rows.where(is_system).select("conv", "head", "body", "cost", "role")
    # The system turn is no new turn of any window.
    has = F.col("system_cost").isNotNull()
    turns = rows.where(~is_system).withColumns(
        {
            "start": F.col("before") - F.coalesce("system_cost", F.lit(0)),
            "longs": F.col("longs") - F.when(has, (F.col("system_cost") > F.col("stride")).cast("long")).otherwise(0),
            "own": F.col("cost"),
            "system_cost": F.coalesce("system_cost", F.lit(0)),
        }
    )
    span = F.struct(F.floor(F.col("start") / F.col("stride")).alias("a"), (2 * F.col("longs") + F.col("long")).alias("b"))
    turns = turns.withColumn("span", span)
    spans = turns.groupBy("conv", "span").agg(F.min("start").alias("first"), F.sum("own").alias("new"), F.first("system_cost").alias("system_cost"))
    spans = spans.withColumn("one", F.lit(1).cast("long")).withColumn("run", F.floor(F.col("span.a") / STRETCH))
    spans = running(spans, ["conv"], "run", ["span"], "one", "window")
    numbers = spans.select("conv", "span", "window")
    turns = turns.join(numbers, ["conv", "span"]).select("conv", "at", "role", "head", "body", "cost", "start", "window")
    following = spans.where("window > 0").select(
        "conv",
        (F.col("window") - 1).alias("window"),
        F.col("first").alias("next_first"),
        (F.lit(budget) - F.col("system_cost") - F.col("new")).alias("room"),
    )
    back = turns.join(following, ["conv", "window"])
    back = back.where(F.col("start") >= F.col("next_first") - F.least(F.lit(history), "room"))
    piece = ["conv", "window", "at", "role", "head", "body", "cost", "again"]
    back = back.withColumn("window", F.col("window") + 1).withColumn("again", F.lit(True)).select(*piece)
    turns = turns.withColumn("again", F.lit(False)).select(*piece)
    # A conversation that is a system turn alone has one window.
    with_system = system.join(numbers.select("conv", "window"), "conv", "left").select(
        "conv",
        F.coalesce("window", F.lit(0)).alias("window"),
        F.lit(0).cast("long").alias("at"),
        "role",
        "head",
        "body",
        "cost",
        (F.coalesce("window", F.lit(0)) > 0).alias("again"),
    )
    whole = turns.unionByName(back).unionByName(with_system)
    fields = F.struct("at", "again", "cost", (F.col("role") == "assistant").alias("target"), "head", "body")
    grouped = whole.groupBy("conv", "window").agg(F.sort_array(F.collect_list(fields)).alias("_turns"))
    length = lambda t: F.char_length(t["head"]) + F.char_length(t["body"]) + len(END)
    begins = F.transform(
        "_turns",
        lambda t, i: F.aggregate(F.slice(F.col("_turns"), F.lit(1), i), F.lit(0), lambda a, x: a + length(x)),
    )
    marks = F.transform(
        F.filter(F.arrays_zip(F.col("_turns").alias("t"), begins.alias("b")), lambda z: z["t"]["target"] & ~z["t"]["again"]),
        lambda z: F.struct(
            (z["b"] + F.char_length(z["t"]["head"])).alias("start"),
            (z["b"] + F.char_length(z["t"]["head"]) + F.char_length(z["t"]["body"])).alias("end"),
        ),
    )
    cost = F.aggregate("_turns", F.lit(0).cast("long"), lambda a, t: a + t["cost"])
    return grouped.select(
        F.when(F.col("conv") != "", F.col("conv")).cast(conversations.schema["conv_id"].dataType).alias("conv_id"),
        "window",
        F.array_join(F.transform("_turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("text"),
        cost.alias("tokens"),
        (cost > budget).alias("over_budget"),
        F.size("_turns").alias("turns"),
        F.size(F.filter("_turns", lambda t: t["again"])).alias("repeated"),
        marks.alias("targets"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """One row per conversation, from the windows alone.

    conv_id, n_turns, turns_sha256 (of role, line feed, text, line feed per
    turn), loss_chars, loss_sha256 (of the unescaped texts under the loss mask)
    and formatted_chars.
    """
    found = F.regexp_extract_all("text", F.lit(r"(?s)<\|im_start\|>(.*?)<\|im_end\|>\n"), 1)
    new = F.transform(
        F.slice(found, F.col("repeated") + 1, F.col("turns")),
        lambda t: F.concat(
            unescaped(F.regexp_extract(t, r"(?s)^((?:[^\\\n]|\\.)*+)\n", 1)),
            F.lit("\n"),
            unescaped(F.regexp_replace(t, r"(?s)^(?:[^\\\n]|\\.)*+\n", "")),
            F.lit("\n"),
        ),
    )
    loss = F.transform("targets", lambda s: unescaped(F.substring("text", s["start"] + 1, s["end"] - s["start"])))
    rows = windows.select(
        "conv_id",
        F.struct(
            "window",
            F.array_join(new, "").alias("turns"),
            F.array_join(loss, "").alias("loss"),
        ).alias("part"),
        (F.col("turns") - F.col("repeated")).alias("n"),
        F.char_length("text").alias("chars"),
    )
    rows = rows.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"),
        F.sort_array(F.collect_list("part")).alias("parts"),
        F.sum("chars").cast("long").alias("formatted_chars"),
    )
    joined = lambda f: F.array_join(F.transform("parts", lambda p: p[f]), "")
    return rows.select(
        "conv_id",
        "n_turns",
        F.sha2(joined("turns"), 256).alias("turns_sha256"),
        F.char_length(joined("loss")).cast("long").alias("loss_chars"),
        F.sha2(joined("loss"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
