"""Repair of conversation structure by aligning turns to the grammar ``(s?(ua)+)?`` of role initials.

Edits of a turn: keep (K, free), give it the role user or assistant (R, 2), delete (D, 3; blank turns and repeated ones have to go), and
insert an empty turn of either role anywhere (I, 2). A truncated turn that stays costs 1.

The grammar's strings are ``(ua)^k``, or one ``s`` before that. Turns are aligned to each feasible length by Wagner and Fischer's
recurrence over suffixes: the last r characters of every such string are the same, so row i holds, for each r, the cost of turning the
turns from i on into them, and the alignments to all lengths share their cells. The first ``s`` can only be a kept turn, before which all are
deleted, so strings with it read the same table further down. Ukkonen's band bounds the cells: one script found in a single pass is the
incumbent; what its cost exceeds the unavoidable part (forced deletions, truncated turns) by, pays for at most half as many
insertions or deletions, and a cell further from the diagonal of remaining turns than that cannot lie on a script as cheap. The audits of all lengths
of least cost are traced back, each by the least letter that keeps the cost, and the least of them is taken.

A conversation is one task's unit: its turns are read in order from a sort that can spill, and held while they are aligned;
cells are turns times the excess of the incumbent.

Defined cases: nulls of any column count as one space (a null id or turn as well, in the damage key; rows without conv_id form one
conversation, whose id stays null); null turns come first, rows of one turn are ordered by role and text; a role's initial is
its first character, none for an empty role; an empty table gives no rows; extra columns do not matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEEP, RETURN_ROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
_FAR = 1 << 40
_SPACE = "\t\n\x0b\x0c\r "
_END = re.compile(r"[.!?]\Z")
_LEGAL = {"su", "ua", "au"}
_NAMES = {"u": "user", "a": "assistant"}
_SCHEMA = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
    "repaired_sha256 string"
)
_COLUMNS = [x.split()[0] for x in _SCHEMA.split(", ")]


# --- alignment ---


def incumbent(initials: list[str], forced: list[bool]) -> int:
    """What one cheap script costs beyond forced deletions and truncated turns."""
    cost, expect, began, system = 0, "u", False, False
    for c, gone in zip(initials, forced, strict=True):
        if gone:
            continue
        if c == "s" and not began and not system:
            system = True
        elif c == expect:
            began, expect = True, "a" if c == "u" else "u"
        elif c in ("u", "a"):  # the expected turn is missing
            cost, began = cost + INSERT, True
        else:
            cost, began, expect = cost + RETURN_ROLE, True, "a" if expect == "u" else "u"
    if expect == "a":
        cost += INSERT
    return cost + (2 * INSERT if system and not began else 0)


class _Band:
    """Costs of aligning the turns from each place on to the last r characters of the grammar's strings, near the diagonal."""

    def __init__(self, initials: list[str], forced: list[bool], cut: list[bool], excess: int):
        n, self._reach = len(initials), excess // 2
        self._live = np.r_[np.cumsum([not x for x in forced][::-1])[::-1], 0].astype(np.int64)
        k = np.arange(2 * self._reach + 1)
        r = k - self._reach
        row = np.where(r >= 0, INSERT * r, _FAR)
        self._rows = [row]
        for i in range(n - 1, -1, -1):
            if forced[i]:
                best = row + DELETE
            else:
                r = self._live[i] - self._reach + k
                best = np.r_[row[1:] + DELETE, _FAR]
                if initials[i] in _NAMES:
                    same = r % 2 == (0 if initials[i] == "u" else 1)
                    best = np.minimum(best, row + np.where(same, KEEP, RETURN_ROLE) + CUT * cut[i])
                else:
                    best = np.minimum(best, row + RETURN_ROLE + CUT * cut[i])
                best[r < 0] = _FAR
            row = np.minimum.accumulate(best - INSERT * k) + INSERT * k  # insertions
            row = np.where(self._live[i] - self._reach + k >= 0, np.minimum(row, _FAR), _FAR)
            self._rows.append(row)
        self._rows.reverse()

    def lengths(self, i: int) -> Iterable[int]:
        low = max(0, int(self._live[i]) - self._reach)
        return range(low + low % 2, int(self._live[i]) + self._reach + 1, 2)

    def cost(self, i: int, r: int) -> int:
        at = r - int(self._live[i]) + self._reach
        return int(self._rows[i][at]) if r >= 0 and 0 <= at <= 2 * self._reach else _FAR

    def audit(self, i: int, r: int, forced: list[bool], cut: list[bool], initials: list[str]) -> str:
        """The least audit among the cheapest ones: D before I before K before R at every step."""
        out, n, left = [], len(initials), self.cost(i, r)
        while i < n or r:
            if i < n and left == DELETE + self.cost(i + 1, r):
                out.append("D")
                i, left = i + 1, left - DELETE
            elif r and left == INSERT + self.cost(i, r - 1):
                out.append("I")
                r, left = r - 1, left - INSERT
            else:
                same = initials[i] == "ua"[r % 2]
                out.append("K" if same else "R")
                left -= (KEEP if same else RETURN_ROLE) + CUT * cut[i]
                i, r = i + 1, r - 1
        return "".join(out)


def align(initials: list[str], forced: list[bool], cut: list[bool]) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits; of equal costs the least audit."""
    band = _Band(initials, forced, cut, incumbent(initials, forced))
    targets = [(band.cost(0, r), 0, r, "") for r in band.lengths(0)]
    for p, c in enumerate(initials):
        if c == "s" and not forced[p]:
            targets += [(DELETE * p + CUT * cut[p] + band.cost(p + 1, r), p + 1, r, "D" * p + "K") for r in band.lengths(p + 1) if r]
    best = min(t[0] for t in targets)
    return best, min(before + band.audit(i, r, forced, cut, initials) for cost, i, r, before in targets if cost == best)


def apply(audit: str, turns: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The turns (role, text) after the edits of an audit."""
    out, i, expect = [], 0, "u"
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        if edit == "I":
            out.append((_NAMES[expect], ""))
        else:
            role, text = turns[i]
            i += 1
            out.append((role if edit == "K" else _NAMES[expect], text))
            if edit == "K" and role[:1] == "s":
                continue
        expect = "a" if expect == "u" else "u"
    return out


# --- one conversation ---


def faults(turns: list[tuple[str, str]]) -> list[str]:
    """The first fault of each turn, or an empty string."""
    seen: set[tuple[str, str]] = set()
    out = []
    for turn in turns:
        said = turn[1].rstrip(_SPACE)
        out.append("blank" if not said else "duplicate" if turn in seen else "" if _END.search(said) else "truncated")
        seen.add(turn)
    return out


def repaired(turns: list[tuple[str, str]]) -> dict:
    """Counts of faults, cost, audit and the repaired turns of a conversation whose turns (role, text) come in order."""
    found, initials = faults(turns), [role[:1] for role, _ in turns]
    cost, audit = align(initials, [x in ("blank", "duplicate") for x in found], [x == "truncated" for x in found])
    return {
        "blank": found.count("blank"), "duplicate": found.count("duplicate"), "truncated": found.count("truncated"),
        "illegal": sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:], strict=False)),
        "cost": cost, "audit": audit, "turns": apply(audit, turns),
    }


# --- Spark jobs ---


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, lost): rows after damage by a hash of (conv_id, turn); a lost row stays as a marker of its
    conversation."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.encode(F.concat(blank("conv_id"), F.lit(":"), blank("turn")), "UTF-8")) % 20
    text = F.when(draw == 1, "").when(draw == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.when(draw == 4, "user").otherwise(blank("role")).alias("role"), F.when(draw != 0, text).alias("text"), (draw == 0).alias("lost"),
        F.when(draw == 3, 2).otherwise(1).alias("_times"))
    return rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_times")))).drop("_times", "_copy")


def _conversations(frames: Iterable[pd.DataFrame]) -> Iterator[tuple[int | None, list[tuple]]]:
    """(conv_id, rows) from sorted batches, holding one conversation."""
    key, rows, first = None, [], True
    for f in frames:
        for conv, turn, role, text, lost in zip(f["conv_id"].tolist(), f["turn"].tolist(), f["role"].tolist(), f["text"].tolist(), f["lost"].tolist(), strict=True):
            conv, turn = None if pd.isna(conv) else int(conv), None if pd.isna(turn) else int(turn)
            if first or conv != key:
                if not first:
                    yield key, rows
                key, rows, first = conv, [], False
            if not lost:
                rows.append((turn, role, text))
    if not first:
        yield key, rows


def _repairs(frames):
    out: list[dict] = []
    for conv, rows in _conversations(frames):
        known = {t for t, _, _ in rows if t is not None}
        r = repaired([(role, text) for _, role, text in rows])
        digest = hashlib.sha256("\n".join(f"{role}:{text}" for role, text in r.pop("turns")).encode("utf-8", "surrogatepass")).hexdigest()
        out.append({**r, "conv_id": conv, "gaps": max(known) - min(known) + 1 - len(known) if known else 0, "repaired_sha256": digest})
        if len(out) == 10_000:
            yield _frame(out)
            out = []
    if out:
        yield _frame(out)


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame({c: pd.array([r[c] for r in rows], "Int64") if c == "conv_id" else [r[c] for r in rows] for c in _COLUMNS})


def report(conversations: DataFrame) -> DataFrame:
    """One row for each conversation: its faults after damage, the cost and audit of the cheapest repair, and a hash of the result."""
    order = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("text")]
    # 64-bit ids with nulls would reach pandas as floats: as strings they stay whole
    rows = damaged(conversations).repartition("conv_id").sortWithinPartitions(*order)
    return rows.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("string").alias("turn"), "role", "text", "lost").mapInPandas(_repairs, _SCHEMA)
