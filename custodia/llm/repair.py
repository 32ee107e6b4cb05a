"""Conversation repair: a Viterbi search over edits whose backpointer tree hands out edits as soon as all survivors agree on them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custodia.llm.common import WHITE

#: Faults of a row in the order in which the first counts; a row of the first two must go.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Costs of edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, CUT_SHORT = 3, 4, 3, 3
#: States: nothing written yet, a system turn last, a user turn last, an assistant turn last. A repaired conversation ends in the first or last.
NONE, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: What it takes at most to go on from state p (row) as a path in state q (column) does; a path that costs more than another by more is lost.
_CATCH_UP = (
    (0, 0, 3, 0),
    (6, 0, 3, 6),
    (7, 3, 0, 3),
    (4, 0, 3, 0),
)
#: Which states a user turn and an assistant turn can follow.
_BEFORE = {USER: (NONE, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}


class _Edit:
    """One edit of a backpointer tree. holders counts the edits that follow it and the survivor that ends in it."""

    __slots__ = ("depth", "followers", "holders", "letter", "parent", "role", "text")

    def __init__(self, parent: _Edit | None, letter: str, role: str | None, text: str) -> None:
        self.parent, self.letter, self.role, self.text = parent, letter, role, text
        self.depth = parent.depth + 1 if parent else 0
        self.followers: list[_Edit] = []
        self.holders = 0


def _tail(end: _Edit, letters: str, other: _Edit, others: str) -> tuple[str, str]:
    """The letters of two paths from where they part."""
    left, right = [letters], [others]
    while end is not other:
        if end.depth >= other.depth:
            left.append(end.letter)
            end = end.parent
        else:
            right.append(other.letter)
            other = other.parent
    return "".join(reversed(left)), "".join(reversed(right))


class Repair:
    """The cheapest edits of one conversation, given row by row. Ties take the edits whose initials are least.

    Every state keeps the best path into it. Paths are leaves of one tree of edits; an edit that no path holds any more goes, and once all
    paths share their first edits these are handed out and forgotten. So memory holds only edits on which the survivors still differ.
    """

    def __init__(self) -> None:
        self.root = _Edit(None, "", None, "")
        self.paths: dict[int, tuple[int, _Edit]] = {}
        self._choose({NONE: (0, self.root, "", None, "")})
        self._insert()

    def row(self, role: str, text: str, fault: int) -> list[_Edit]:
        """Take one row; gives the edits that are now certain."""
        ways: dict[int, tuple] = {}
        for state, (cost, end) in self.paths.items():
            self._offer(ways, state, (cost + DELETE, end, "D", None, ""))
            if fault in (BLANK, DUPLICATE):
                continue
            extra = CUT_SHORT if fault == TRUNCATED else 0
            if state == NONE and role[:1] == "s":
                self._offer(ways, SYSTEM, (cost + extra, end, "K", role, text))
            for to, name in ROLES.items():
                if state in _BEFORE[to]:
                    kept = role[:1] == name[0]
                    self._offer(ways, to, (cost + extra + (0 if kept else REROLE), end, "K" if kept else "R", role if kept else name, text))
        self._choose(ways)
        self._insert()
        return self._certain()

    def close(self) -> tuple[int, Iterable[_Edit]]:
        """The cost of the whole repair and the edits not handed out yet."""
        ends: dict[int, tuple] = {}
        for state in (NONE, ASSISTANT):
            if state in self.paths:
                cost, end = self.paths[state]
                self._offer(ends, NONE, (cost, end, "", None, ""))
        cost, end = ends[NONE][:2]
        rest = []
        while end is not self.root:
            rest.append(end)
            end = end.parent
        return cost, reversed(rest)

    @staticmethod
    def _offer(ways: dict[int, tuple], state: int, way: tuple) -> None:
        """Keep the cheaper way into a state; of equal ones that whose whole letters, back to where the two part, are least."""
        known = ways.get(state)
        if known is None or way[0] < known[0]:
            ways[state] = way
        elif way[0] == known[0]:
            mine, theirs = _tail(way[1], way[2], known[1], known[2])
            if mine < theirs:
                ways[state] = way

    def _choose(self, ways: dict[int, tuple]) -> None:
        """Make the chosen ways the survivors, but for those that another one can follow at less cost whatever comes."""
        ways = {q: w for q, w in ways.items() if not any(p != q and v[0] + _CATCH_UP[p][q] < w[0] for p, v in ways.items())}
        old = self.paths
        self.paths = {}
        for state, (cost, parent, letter, role, text) in ways.items():
            end = parent
            if letter:
                end = _Edit(parent, letter, role, text)
                parent.followers.append(end)
                parent.holders += 1
            end.holders += 1
            self.paths[state] = (cost, end)
        for _, end in old.values():
            self._let_go(end)

    def _insert(self) -> None:
        """Ways that go on by inserted turns; two in a row are the most that can be worth it."""
        for to in (USER, ASSISTANT, USER):
            ways: dict[int, tuple] = {q: (c, end, "", None, "") for q, (c, end) in self.paths.items()}
            for state in _BEFORE[to]:
                if state in self.paths:
                    cost, end = self.paths[state]
                    self._offer(ways, to, (cost + INSERT, end, "I", ROLES[to], ""))
            self._choose(ways)

    def _let_go(self, end: _Edit) -> None:
        end.holders -= 1
        while end.holders == 0 and end is not self.root:
            parent = end.parent
            parent.followers.remove(end)
            parent.holders -= 1
            end = parent

    def _certain(self) -> list[_Edit]:
        """Edits that all survivors share: as long as the first edit has one follower and no survivor of its own, it is settled."""
        out = []
        while self.root.holders == 1 and len(self.root.followers) == 1:
            self.root = self.root.followers[0]
            self.root.parent = None
            out.append(self.root)
        return out


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with planted faults, by d = crc32("conv_id:turn") % 20 (a null id or turn is one space there, and so are null roles and texts).

    0 drops the row (it stays, marked dropped, so that its conversation is known), 1 empties the text, 2 takes its . ! ? out, 3 repeats the
    row, 4 makes its role user.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"),
                                (F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20).alias("d"))
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), (F.col("d") == 0).alias("dropped"),
        F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"), F.when(F.col("d") != 0, text).otherwise("").alias("text"),
        F.explode(F.when(F.col("d") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


def faults(rows: DataFrame) -> DataFrame:
    """rows, dealt and sorted by conversation and turn, with the first fault of each.

    Blank: nothing but ASCII white space. Duplicate: role and text seen earlier in the conversation (128 bits of them are compared).
    Truncated: the last character that is no white space is none of . ! ?. One shuffle by conv_id serves the duplicates and the repair.
    """
    stripped: Column = F.btrim("text", F.lit(WHITE))
    dealt = rows.withColumns({"x1": F.xxhash64("role", "text"), "x2": F.xxhash64(F.lit(1), "role", "text")}).repartition("conv_id")
    same = Window.partitionBy("conv_id", "x1", "x2").orderBy(F.col("dropped"), F.col("turn").asc_nulls_first())
    fault = (
        F.when(stripped == "", BLANK).when(F.row_number().over(same) > 1, DUPLICATE)
        .when(~F.substring(stripped, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    )
    marked = dealt.withColumn("fault", fault).drop("x1", "x2")
    return marked.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")


class _Conversation:
    """One conversation as its rows stream by: counters, repair and the digest of what has been repaired so far."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.repair = conv_id, Repair()
        self.first = self.turn = self.initial = None
        self.distinct = self.illegal = self.written = self.edits = 0
        self.faults = [0, 0, 0, 0]
        self.audit: list[str] = []
        self.sha = hashlib.sha256()

    def row(self, turn: int | None, role: str, text: str, fault: int) -> list[tuple]:
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.distinct += turn != self.turn
            self.turn = turn
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]
        self.faults[fault] += 1
        return self.take(self.repair.row(role, text, fault))

    def take(self, edits: Iterable[_Edit]) -> list[tuple]:
        out = []
        for edit in edits:
            self.audit.append(edit.letter)
            if edit.role is not None:
                self.sha.update((("\n" if self.written else "") + edit.role + ":" + edit.text).encode("utf-8", "surrogatepass"))
                self.written += 1
            self.edits += 1
            out.append((self.conv_id, self.edits, edit.letter, edit.role, edit.text if edit.role is not None else None))
        if len(self.audit) > 4096:
            self.audit = ["".join(self.audit)]
        return out

    def report(self) -> tuple[tuple, list[tuple]]:
        cost, rest = self.repair.close()
        out = self.take(rest)
        gaps = 0 if self.first is None else min(self.turn - self.first + 1 - self.distinct, 2**63 - 1)
        return (self.conv_id, gaps, *self.faults[1:], self.illegal, cost, "".join(self.audit), self.sha.hexdigest()), out


def _repaired(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list[tuple], list[tuple]]]:
    """(reports, edits) of sorted rows, a batch at a time. A conversation may go on from one batch to the next."""
    now: _Conversation | None = None
    for batch in batches:
        reports, edits = [], []
        ids = batch["conv_id"].astype("Int64").astype(object).where(batch["conv_id"].notna(), None)
        turns = batch["turn"].astype("Int64").astype(object).where(batch["turn"].notna(), None)
        for conv_id, turn, dropped, role, text, fault in zip(ids, turns, batch["dropped"], batch["role"], batch["text"], batch["fault"], strict=True):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    report, rest = now.report()
                    reports.append(report)
                    edits += rest
                now = _Conversation(conv_id)
            if not dropped:
                edits += now.row(turn, role, text, fault)
        yield reports, edits
    if now is not None:
        report, rest = now.report()
        yield [report], rest


REPORT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
EDITS = "conv_id bigint, step bigint, edit string, role string, text string"


def _columns(records: list[tuple], schema: str) -> pd.DataFrame:
    kinds = {c.split()[0]: ("Int64" if c.endswith("bigint") else object) for c in schema.split(", ")}
    return pd.DataFrame({n: pd.Series([r[k] for r in records], dtype=d) for k, (n, d) in enumerate(kinds.items())})


def prepared(conversations: DataFrame) -> DataFrame:
    """Conversations as `faults` takes them: null roles and texts are one space, nothing is dropped."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.lit(False).alias("dropped"), part("role"), part("text"))


def repair_report(rows: DataFrame) -> DataFrame:
    """One row a conversation: faults found, cost and initials of the cheapest edits, digest of the repaired conversation.

    rows is from `prepared` or `damaged`. Turns come by number, null numbers first, ties by role and text; a null conv_id is a conversation
    like others. Faults: see `faults`; each row's first counts. gaps: turn numbers missing between the least and the largest (at most 2^63 - 1).
    illegal: neighbours whose role initials are none of su, ua, au. Edits: Keep, Rerole, Delete, Insert; the repaired roles are
    nothing, or a system turn or none and then pairs of user and assistant. Ties go to the least string of initials.

    A conversation is searched from its first to its last turn, so its rows stream through one task; they are never held together, only edits
    on which the survivors differ are. A conversation all of whose rows are dropped gives zeros, an empty audit and the digest of nothing. An
    empty table gives no row. Other columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for reports, _ in _repaired(batches):
            yield _columns(reports, REPORT)

    return faults(rows).mapInPandas(run, REPORT)


def repair_turns(rows: DataFrame) -> DataFrame:
    """The edits themselves: (conv_id, step, edit, role, text), in order of step; a deleted row has neither role nor text. See repair_report."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, edits in _repaired(batches):
            yield _columns(edits, EDITS)

    return faults(rows).mapInPandas(run, EDITS)
