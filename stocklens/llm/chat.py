"""Chat formatting: conversations as budgeted, turn-aligned windows with a loss mask.

A turn is written ``<|turn|>role<|text|>text<|end|>`` and a line feed. Inside roles and texts
a backslash is doubled and ``<|`` becomes ``<\\|``, so a mark in the output is always the
template's, and ``unescape`` gives back every text.

Windows come from prefix sums of turn tokens. A window holds the conversation's system turn,
up to ``history`` turns before its own (at most ``history_budget`` tokens of them), then its
own turns as long as the sum stays within ``budget``; every turn is the own turn of exactly one
window. The loss mask covers the texts of a window's own assistant turns; repeated turns are
never under it. A turn that exceeds the budget alone with the system turn has a window without
history. Tokens are counted as stretches of letters, digits and single other characters plus
one for each mark; a column of true counts can be given instead.

Scale: rows are numbered within their conversation without gathering it, and dealt in
segments of 256 turns, each with the history before it; a window ends with its segment at the
latest. So no task holds more of a conversation than a segment and its windows, however long
it is, and the result does not depend on partitions. DataFrame functions only.

Defined cases: a null role or text counts as empty; rows are taken by turn, nulls first, and
in the order of role and text on equal turns; repeated rows are turns of their own; a null
conversation id is a conversation; only a first turn of role ``system`` is the system turn;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from stocklens.llm.common import let, numbered, text_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUDGET = 1024             # tokens of a window
HISTORY = 2               # turns repeated before a window's own
HISTORY_BUDGET = 256      # and their tokens
SEGMENT_BITS = 8          # turns of a conversation that are planned together
OPEN, MID, END = "<|turn|>", "<|text|>", "<|end|>\n"
TOKEN = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def estimate(text: Column) -> Column:
    """Tokens of a turn's text, its role and marks."""
    return F.regexp_count(text, F.lit(TOKEN)).cast("bigint") + F.lit(4)


def _starts(v: Column, budget: int, history: int, history_budget: int) -> Column:
    """First repeated and first own turn of each window, from the prefix sums ``v.sums``."""
    sums, turns = v["sums"], v["turns"]

    def step(state: Column, k: Column) -> Column:
        system = F.when(v["head"].isNotNull() & ((v["own"] > 0) | (k > 0)), v["head"]["tokens"]).otherwise(F.lit(0))
        lowest = F.least(k, F.greatest(k - history, F.when(v["head"].isNotNull() & (v["own"] == 0), 1).otherwise(0)))
        near = F.filter(F.sequence(lowest, k), lambda c: F.get(sums, k) - F.get(sums, c) <= history_budget)
        context = let(near[0], lambda c: F.when(
            F.get(turns, k)["tokens"] + system + F.get(sums, k) - F.get(sums, c) <= budget, c).otherwise(k))
        fits = (F.size(state["starts"]) > 0) & (F.get(sums, k + 1) <= state["limit"])
        return F.when(fits, state).otherwise(let(context, lambda c: F.struct(
            F.concat(state["starts"], F.array(F.struct(c.alias("context"), k.alias("first")))).alias("starts"),
            (F.lit(budget) - system + F.get(sums, c)).alias("limit"))))

    none = F.struct(F.array().cast("array<struct<context:int,first:int>>").alias("starts"), F.lit(0).cast("bigint").alias("limit"))
    return F.aggregate(F.sequence(v["own"], F.size(turns) - 1), none, step, lambda s: s["starts"])


def _windows(v: Column, budget: int, history: int, history_budget: int) -> Column:
    turns = v["turns"]
    return let(_starts(v, budget, history, history_budget), lambda starts: F.transform(starts, lambda s, i: let(
        F.coalesce(F.get(starts, i + 1)["first"], F.size(turns)), lambda end: let(
            F.when(v["head"].isNotNull() & ((v["own"] > 0) | (s["first"] > 0)), F.array(v["head"])).otherwise(F.slice(turns, 1, 0)),
            lambda head: F.struct(
                F.get(turns, s["first"])["at"].alias("first_turn"),
                (end - s["first"]).alias("n_turns"),
                (F.size(head) + s["first"] - s["context"]).alias("n_repeated"),
                F.concat(head, F.slice(turns, s["context"] + 1, end - s["context"])).alias("shown"))))))


def _before(t: Column) -> Column:
    return F.concat(F.lit(OPEN), t["role"], F.lit(MID))


def _loss(shown: Column, repeated: Column) -> Column:
    """Start and length, in code points of the window, of the texts that are learnt."""
    def step(state: Column, t: Column) -> Column:
        return let(F.length(_before(t)) + state["at"], lambda start: let(F.length(t["body"]), lambda size: F.struct(
            (start + size + len(END)).alias("at"), (state["i"] + 1).alias("i"),
            F.when((state["i"] >= repeated) & (t["role"] == "assistant"),
                   F.concat(state["spans"], F.array(F.struct(start.alias("start"), size.alias("length")))))
             .otherwise(state["spans"]).alias("spans"))))

    none = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    return F.aggregate(shown, none, step, lambda s: s["spans"])


def chat_windows(df: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_budget: int = HISTORY_BUDGET,
                 tokens: Column | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """One row per window: ``conv_id``, first_turn (place of its first own turn), n_turns (own),
    n_repeated (before them), n_tokens, formatted text, loss spans (start, length)."""
    size = 1 << SEGMENT_BITS
    if not 0 <= history < size:
        raise ValueError(f"history must be 0 to {size - 1} turns")
    rows = numbered(df.select(
        F.col(conv).alias("__conv"), F.col(turn).alias("__turn"), escape(text_of(role)).alias("role"), escape(text_of(text)).alias("body"),
        (estimate(text_of(text)) if tokens is None else tokens).cast("bigint").alias("tokens")),
        "__conv", [F.col("__turn"), F.col("role"), F.col("body")], "chat")
    rows = rows.select("__conv", "__at", F.shiftright("__at", SEGMENT_BITS).alias("__seg"),
                       F.struct(F.col("__at").alias("at"), "role", "body", "tokens").alias("t"))
    last = F.col("__at").bitwiseAND(size - 1) >= size - history          # history of the next segment
    dealt = rows.select("__conv", F.explode(F.when(last, F.array("__seg", F.col("__seg") + 1)).otherwise(F.array("__seg"))).alias("__seg"), "t")
    groups = dealt.groupBy("__conv", "__seg").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    groups = groups.withColumn("own", F.size(F.filter("turns", lambda t: F.shiftright(t["at"], SEGMENT_BITS) < F.col("__seg"))))
    groups = groups.filter(F.col("own") < F.size("turns"))
    heads = rows.filter((F.col("__at") == 0) & (F.col("t.role") == "system")).select(F.col("__conv").alias("__key"), F.col("t").alias("head"))
    first = groups.filter("__seg = 0").withColumn("head", F.when(F.col("turns")[0]["role"] == "system", F.col("turns")[0]))
    later = groups.filter("__seg > 0").join(heads, F.col("__conv").eqNullSafe(F.col("__key")), "left").drop("__key")
    sums = F.aggregate("turns", F.array(F.lit(0).cast("bigint")),
                       lambda a, t: F.concat(a, F.array(F.element_at(a, -1) + t["tokens"])))
    planned = let(F.struct("turns", "own", "head", sums.alias("sums")), lambda v: _windows(v, budget, history, history_budget))
    shown = first.unionByName(later).select("__conv", F.explode(planned).alias("w")).select("__conv", "w.*")
    return shown.select(
        F.col("__conv").alias("conv_id"), "first_turn", F.col("n_turns").cast("bigint").alias("n_turns"),
        F.col("n_repeated").cast("bigint").alias("n_repeated"),
        F.aggregate("shown", F.lit(0).cast("bigint"), lambda a, t: a + t["tokens"]).alias("n_tokens"),
        F.array_join(F.transform("shown", lambda t: F.concat(_before(t), t["body"], F.lit(END))), "").alias("text"),
        _loss(F.col("shown"), F.col("n_repeated")).alias("loss"))


def read_turns(windows: DataFrame) -> DataFrame:
    """``windows`` with what its formatted texts say: turns (role, text) that a window does not
    repeat, and learnt, the texts under its loss mask, unescaped."""
    parts = F.split("text", F.lit(END.replace("|", "\\|")))
    own = F.slice(parts, F.col("n_repeated").cast("int") + 1, F.size(parts) - 1 - F.col("n_repeated").cast("int"))

    def turn(part: Column) -> Column:
        return let(F.split(part, F.lit(MID.replace("|", "\\|")), 2), lambda x: F.struct(
            unescape(F.substring(x[0], len(OPEN) + 1, 1 << 30)).alias("role"), unescape(x[1]).alias("text")))

    learnt = F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["length"])))
    return windows.withColumns({"turns": F.transform(own, turn), "learnt": learnt})
