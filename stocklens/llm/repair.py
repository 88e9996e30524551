"""Conversation structure repair: cheapest edits to ``(s?(ua)+)?`` by Four-Russians block tables.

Rows of a conversation, by turn, become role initials s, u, a that follow the grammar, by the
edits Keep (0), Rerole to user or assistant (3), Delete (4, required for blank and duplicate
rows) and Insert an empty user or assistant turn (3); a truncated row that is not deleted adds
3. Among the cheapest lists of edits the one with the ASCII-least initials is returned.

The grammar has four states, so a row maps the costs-to-go of the four states after it to those
before it. Less their minimum, only a few dozen such vectors exist. For every vector and every
block of ``BLOCK`` row symbols (nine: four kinds of role, truncated or not, and rows to delete)
tables hold the vector before the block and its offset: a conversation is read by one lookup a
block, from its end. Then each block is expanded backward from the vector after it, and a walk
from its start takes the least edit that keeps the cost. A state and an edit fix the next
state, so the walk gives the least list of all.

Scale: rows are numbered within their conversation without gathering it, and dealt in segments
of 1,024. Of a conversation with more, each segment first gives its cost matrix (16 numbers),
these are folded from the end, and every segment is walked from each of its four states; so
one row gathers 16 numbers a segment, never the turns of a conversation.

Defined cases: a null role or text counts as one space; rows are taken by turn, nulls first,
and in the order of role and text on equal turns; a row is a duplicate if role and text equal
those of an earlier row; a role's first character is its initial, an empty role has none; a
null conversation id is a conversation; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from stocklens.llm.common import numbered, staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHANGE, DELETE = 3, 4                 # Rerole, Insert and truncated rows; Delete
BLOCK = 4                             # row symbols of a table block
SEGMENT_BITS = 10                     # rows of a conversation that are walked together
KINDS = 9                             # 2 * (s, u, a, other) + truncated; the last is deleted
GONE = KINDS - 1
FAR = 1 << 20                         # cost of what cannot be reached
END = (0, 2 * CHANGE, CHANGE, 0)      # costs-to-go after the last row: at the start, after s, u, a
KEPT = ((1, -1, -1, -1), (2, 2, -1, 2), (-1, -1, 3, -1), (-1, -1, -1, -1))   # by kind of role and state
NEXT = (2, 2, 3, 2)                   # state after the turn that Rerole and Insert make
MADE = ("user", "user", "assistant", "user")
EDITS = "array<struct<edit:string,row:int,role:string>>"


def before(after: tuple[int, ...], kind: int) -> tuple[int, ...]:
    """Costs-to-go before a row, from those after it."""
    costs = [DELETE + c for c in after]
    if kind != GONE:
        extra = CHANGE * (kind & 1)
        for s in range(4):
            costs[s] = min(costs[s], CHANGE + extra + after[NEXT[s]])
            if (k := KEPT[kind >> 1][s]) >= 0:
                costs[s] = min(costs[s], extra + after[k])
    for _ in range(2):
        costs = [min(c, CHANGE + costs[NEXT[s]]) for s, c in enumerate(costs)]
    return tuple(min(c, FAR) for c in costs)


class Tables:
    """Normalised vectors, and where every block of symbols leads from each of them."""

    def __init__(self) -> None:
        units = [tuple(0 if s == j else FAR for s in range(4)) for j in range(4)]
        self.vectors = [END, *units]
        self.number = {v: i for i, v in enumerate(self.vectors)}
        lead, cost = [], []
        for v in self.vectors:                    # grows until no new vector appears
            for kind in range(KINDS):
                i, c = self.normal(before(v, kind))
                lead.append(i)
                cost.append(c)
        self.one = np.array(lead, dtype=np.int32).reshape(-1, KINDS), np.array(cost, dtype=np.int32).reshape(-1, KINDS)
        lead, cost = self.one
        for _ in range(BLOCK - 1):                # a symbol in front of every block
            more = cost[:, None, :] + self.one[1][lead].swapaxes(1, 2)
            lead, cost = self.one[0][lead].swapaxes(1, 2).reshape(len(lead), -1), more.reshape(len(lead), -1)
        self.block = lead, cost

    def normal(self, costs: tuple[int, ...]) -> tuple[int, int]:
        least = min(costs)
        v = tuple(c if c >= FAR else c - least for c in costs)
        if v not in self.number:
            self.number[v] = len(self.vectors)
            self.vectors.append(v)
        return self.number[v], least

    def read(self, kinds: np.ndarray, end: int) -> tuple[list[int], int]:
        """Vectors at the block borders, from the front, and the sum of the offsets. The first
        block is the short one."""
        short = len(kinds) % BLOCK
        codes = kinds[short:].reshape(-1, BLOCK) @ (KINDS ** np.arange(BLOCK - 1, -1, -1))
        lead, cost = self.block
        at, total, borders = end, 0, [end]
        for code in codes[::-1].tolist():
            total += int(cost[at, code])
            at = int(lead[at, code])
            borders.append(at)
        if short:
            for kind in kinds[:short][::-1].tolist():
                total += int(self.one[1][at, kind])
                at = int(self.one[0][at, kind])
            borders.append(at)
        return borders[::-1], total

    def walk(self, kinds: np.ndarray, end: int, state: int, last: bool) -> tuple[list[tuple], int]:
        """The least edits (initial, row or -1, new role) from ``state``, and the state after them."""
        borders, _ = self.read(kinds, end)
        out, at, rows = [], 0, kinds.tolist()
        short = len(rows) % BLOCK
        for b, after in enumerate(borders[1:]):
            size = short if b == 0 and short else BLOCK
            costs = [self.vectors[after]]
            for kind in reversed(rows[at:at + size]):
                costs.append(before(costs[-1], kind))
            costs.reverse()
            for j in range(size):
                kind, now, then = rows[at], costs[j], costs[j + 1]
                while True:
                    extra = CHANGE * (kind & 1)
                    kept = KEPT[kind >> 1][state] if kind != GONE else -1
                    if DELETE + then[state] == now[state]:
                        out.append(("D", at, None))
                    elif CHANGE + now[NEXT[state]] == now[state]:
                        out.append(("I", -1, MADE[state]))
                        state = NEXT[state]
                        continue
                    elif kept >= 0 and extra + then[kept] == now[state]:
                        out.append(("K", at, None))
                        state = kept
                    else:
                        out.append(("R", at, MADE[state]))
                        state = NEXT[state]
                    break
                at += 1
        while last and state in (1, 2):
            out.append(("I", -1, MADE[state]))
            state = NEXT[state]
        return out, state


_BUILT: list[Tables] = []


def tables() -> Tables:
    """The tables, built once in a worker."""
    if not _BUILT:
        _BUILT.append(Tables())
    return _BUILT[0]


def kinds_of(symbols: str) -> np.ndarray:
    return np.frombuffer(symbols.encode(), dtype=np.uint8).astype(np.int64) - ord("0")


def edit_rows(edits: list[tuple]) -> list[dict]:
    return [{"edit": e, "row": r, "role": role} for e, r, role in edits]


def edits_of(symbols: pd.Series) -> pd.Series:
    """Edits of whole conversations."""
    t = tables()
    return symbols.map(lambda s: edit_rows(t.walk(kinds_of(s), 0, 0, True)[0]))


def matrix_of(symbols: pd.Series) -> pd.Series:
    """Costs from each state before a segment to each state after it, row by row."""
    t = tables()

    def matrix(s: str) -> list[int]:
        columns = []
        for j in range(4):
            borders, total = t.read(kinds_of(s), 1 + j)
            columns.append([min(c + total, FAR) if c < FAR else FAR for c in t.vectors[borders[0]]])
        return [columns[j][i] for i in range(4) for j in range(4)]
    return symbols.map(matrix)


def ends_of(matrices: pd.Series) -> pd.Series:
    """Number of the vector after each segment of a conversation, folded from the last."""
    t = tables()

    def fold(ms) -> list[int]:
        at, out = 0, []
        for m in reversed([np.asarray(x).reshape(4, 4) for x in ms]):
            out.append(at)
            costs = (m + np.array(t.vectors[at])).min(axis=1)
            at = t.number[tuple((costs - costs.min()).tolist())]
        return out[::-1]
    return matrices.map(fold)


def walks_of(symbols: pd.Series, end: pd.Series, last: pd.Series) -> pd.DataFrame:
    """Edits of a segment from each of the four states, and the states after them."""
    t = tables()
    both = [[t.walk(kinds_of(s), int(e), state, bool(z)) for state in range(4)] for s, e, z in zip(symbols, end, last, strict=True)]
    return pd.DataFrame({"edits": [[edit_rows(w[0]) for w in b] for b in both], "after": [[w[1] for w in b] for b in both]})


def states_of(after: pd.Series) -> pd.Series:
    """The state before each segment, walked from the first."""
    def follow(xs) -> list[int]:
        state, out = 0, []
        for x in xs:
            out.append(state)
            state = int(x[state])
        return out
    return after.map(follow)


def segments(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Segments of conversations, staged: conv_id, segment, rows (at, turn, role, text, fault,
    kind), symbols, illegal (adjacent initials that the grammar lacks; a segment counts the pair
    with the row before it) and n_turns (different turns, each where it first stands)."""
    blank_as = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = numbered(df.select(F.col(conv).alias("__conv"), F.col(turn).alias("turn"), blank_as(role).alias("role"), blank_as(text).alias("text")),
                    "__conv", [F.col("turn"), F.col("role"), F.col("text")], "repair-rows")
    rows = rows.withColumn("__said", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    said = (rows.groupBy(F.col("__conv").alias("__key"), F.col("__said").alias("__same"))
                .agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n")).filter("__n > 1").drop("__n"))
    rows = rows.join(said, F.col("__conv").eqNullSafe(F.col("__key")) & (F.col("__said") == F.col("__same")), "left")
    fault = (F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank")
              .when(F.col("__at") > F.col("__first"), "duplicate")
              .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated"))
    initial = F.substring("role", 1, 1)
    kind = F.when(F.col("fault").isin("blank", "duplicate"), GONE).otherwise(
        2 * F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
        + F.when(F.col("fault") == "truncated", 1).otherwise(0))
    rows = rows.withColumn("fault", fault).withColumn("kind", kind).withColumn("segment", F.shiftright("__at", SEGMENT_BITS))
    size = 1 << SEGMENT_BITS
    border = F.col("__at").bitwiseAND(size - 1) == size - 1              # seen by the next segment
    dealt = rows.select("__conv", F.explode(F.when(border, F.array("segment", F.col("segment") + 1)).otherwise(F.array("segment"))).alias("segment"),
                        F.struct(F.col("__at").alias("at"), "turn", "role", "text", "fault", "kind").alias("r"))
    groups = dealt.groupBy("__conv", "segment").agg(F.array_sort(F.collect_list("r")).alias("seen"))
    own = F.filter("seen", lambda r: F.shiftright(r["at"], SEGMENT_BITS) == F.col("segment"))
    initials = F.transform("seen", lambda r: F.substring(r["role"], 1, 1))
    earlier, later = (lambda c: F.slice(c, 1, F.size("seen") - 1)), (lambda c: F.slice(c, 2, F.size("seen")))
    pairs = F.zip_with(earlier(initials), later(initials), lambda a, b: F.concat(a, b))
    steps = F.zip_with(earlier(F.col("seen.turn")), later(F.col("seen.turn")), lambda a, b: b.isNotNull() & ~a.eqNullSafe(b))
    groups = groups.select(
        F.col("__conv").alias("conv_id"), "segment", own.alias("rows"),
        F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))).alias("illegal"),
        (F.size(F.filter(steps, lambda x: x)) + F.when((F.col("segment") == 0) & F.col("seen")[0]["turn"].isNotNull(), 1).otherwise(0))
        .alias("n_turns")).filter(F.size("rows") > 0)
    return staged(groups.withColumn("symbols", F.array_join(F.transform("rows", lambda r: r["kind"].cast("string")), "")), "repair-segments")


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per segment of 1,024 rows: conv_id, segment, rows, illegal, n_turns, and edits: the edit's
    initial, its row (from 0 in the segment, -1 for Insert) and the role that it gives."""
    found = segments(df, conv, turn, role, text)
    long_ = (F.col("segment") > 0) | (F.length("symbols") == 1 << SEGMENT_BITS)
    whole = found.filter(~long_).withColumn("edits", F.pandas_udf(edits_of, EDITS)("symbols")).drop("symbols")
    found = found.filter(long_)
    listed = lambda d, c: d.groupBy(F.col("conv_id").alias("__key")).agg(F.array_sort(F.collect_list(F.struct("segment", c))).alias("s"))
    same = F.col("conv_id").eqNullSafe(F.col("__key")) & (F.col("segment") == F.col("__seg"))
    ends = listed(found.select("conv_id", "segment", F.pandas_udf(matrix_of, "array<int>")("symbols").alias("m")), "m")
    ends = ends.select("__key", F.size("s").alias("__many"), F.posexplode(F.pandas_udf(ends_of, "array<int>")("s.m")).alias("__seg", "__end"))
    walked = found.join(ends, same).withColumn("w", F.pandas_udf(walks_of, f"struct<edits:array<{EDITS}>,after:array<int>>")(
        "symbols", "__end", F.col("__seg") == F.col("__many") - 1)).drop("__key", "__seg", "__end", "__many")
    starts = listed(walked.select("conv_id", "segment", F.col("w.after").alias("after")), "after")
    starts = starts.select("__key", F.posexplode(F.pandas_udf(states_of, "array<int>")("s.after")).alias("__seg", "__state"))
    parts = walked.join(starts, same).select("conv_id", "segment", "rows", "illegal", "n_turns", F.get("w.edits", F.col("__state")).alias("edits"))
    return whole.unionByName(parts)


def edit_cost(rows: Column, edits: Column) -> Column:
    return F.aggregate(edits, F.lit(0).cast("bigint"), lambda a, e: a
                       + F.when(e["edit"] == "D", DELETE).when(e["edit"] == "K", 0).otherwise(CHANGE)
                       + F.when((e["row"] >= 0) & (e["edit"] != "D") & (F.get(rows, e["row"])["fault"] == "truncated"), CHANGE).otherwise(0))


def repaired(rows: Column, edits: Column) -> Column:
    """The rows (role, text) that the edits leave."""
    return F.transform(F.filter(edits, lambda e: e["edit"] != "D"), lambda e: F.struct(
        F.coalesce(e["role"], F.get(rows, e["row"])["role"]).alias("role"),
        F.when(e["row"] >= 0, F.get(rows, e["row"])["text"]).otherwise(F.lit("")).alias("text")))


def damaged(df: DataFrame) -> DataFrame:
    """Rows with faults planted by rule: by crc32 of ``conv_id:turn`` % 20, 0 drops a row, 1
    empties its text, 2 removes its full stops, 3 repeats it, 4 makes its role user."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = df.select("conv_id", "turn", F.when(h == 4, "user").otherwise(said("role")).alias("role"),
                     F.when(h == 1, "").when(h == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text")).alias("text"),
                     F.when(h == 0, 0).when(h == 3, 2).otherwise(1).alias("__times"))
    return rows.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("__times")))).drop("__times", "__copy")
