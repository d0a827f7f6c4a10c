"""Repair of conversations: the cheapest edits that make turns alternate, by a dynamic programme over tensors with time first.

Rows are sorted over ranges of (conversation, turn), so that a conversation of any length is dealt to many tasks. A task cuts
its rows into segments of bounded size. Segments are bucketed by length and become tensors (turn, state, conversation): one
step back over a turn updates the costs of all conversations of a bucket at once, the costs are kept, and one pass forward
traces the edits of all of them.

A conversation that lies within a task is done there. Those that begin or end a task's rows, or have several segments, go on:
texts seen in earlier segments are found by their digests, each segment gives its least costs from every state to every state,
costs from the end and states from the beginning are composed over these small tables, and the segments are traced from there.

The states are 0 (nothing yet), 1 (a system turn), 2 (a user turn that needs a reply), 3 (a reply): a conversation may end in 0 or 3.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrygraph.llm.common import arrow_map, cut_batches, discard, materialize

#: Rows and bytes of a segment at most (a longer row makes a segment of its own), and segments that are solved at a time.
SEGMENT_ROWS, SEGMENT_BYTES, SOLVED = 4096, 4 << 20, 256
#: Costs of the edits, and of a row that stays although its text is cut off.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: By state: the state behind the only role that edits may give there, and that role.
TURNED = np.array([2, 2, 3, 2])
ROLES = ("user", "user", "assistant", "user")
#: By initial (s, u, a, other) and state: the state behind a row that is kept, or -1.
KEPT = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])
_INITIALS = {"s": 0, "u": 1, "a": 2}
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
_FAR = np.int64(1) << 40
#: What costs from the end of a whole conversation are: a user turn needs a reply, a system turn both.
AT_END = np.array([0, 2 * INSERT, INSERT, 0], np.int64)
#: Codes of a row: bits 0-1 the initial, bit 2 truncated, bit 3 has to go (blank or duplicate).
_CUT, _GOES = 4, 8
_WHITE = " \t\n\x0b\x0c\r"


def _back(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Least costs (turn, state, lane) from before each turn; ``codes`` (turn, lane), -1 behind the last one, ``ends`` (state, lane)."""
    turns, lanes = codes.shape
    cost = np.empty((turns + 1, 4, lanes), np.int64)
    cost[turns] = ends
    lane = np.arange(lanes)[None, :]
    for t in range(turns - 1, -1, -1):
        code, after = codes[t], cost[t + 1]
        late = np.where(code & _CUT, TRUNCATED, 0)
        to = KEPT[code & 3].T  # (state, lane)
        kept = np.where(to >= 0, after[np.maximum(to, 0), lane] + late, _FAR)
        stays = np.minimum(kept, after[TURNED] + REROLE + late)
        here = np.minimum(after + DELETE, np.where(code & _GOES, _FAR, stays))
        once = here[TURNED] + INSERT
        here = np.minimum(here, np.minimum(once, once[TURNED] + INSERT))
        cost[t] = np.where(code < 0, after, here)
    return cost


def _forward(codes: np.ndarray, cost: np.ndarray, entry: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inserted turns before each row and behind the last, edit of each row: 0 D, 1 K, 2 R, -1 none; states before each row's
    insertions, and at last) of the cheapest edits with the least letters. ``last``: lanes whose conversations end here."""
    turns, lanes = codes.shape
    inserted, edit, states = np.zeros((turns + 1, lanes), np.int8), np.full((turns, lanes), -1, np.int8), np.empty((turns + 2, lanes), np.int8)
    state, lane = entry.astype(np.int64), np.arange(lanes)
    for t in range(turns):
        states[t] = state
        code, after = codes[t], cost[t + 1]
        late = np.where(code & _CUT, TRUNCATED, 0)
        left, open_ = cost[t][state, lane], code >= 0
        for _ in range(3):
            gone = open_ & (after[state, lane] + DELETE == left)
            edit[t][gone] = 0
            open_ &= ~gone
            turned = TURNED[state]
            new = open_ & (cost[t][turned, lane] + INSERT == left)
            inserted[t][new] += 1
            rest = open_ & ~new
            to = KEPT[code & 3, state]
            keep = rest & (to >= 0) & (after[np.maximum(to, 0), lane] + late == left)
            edit[t][keep] = 1
            edit[t][rest & ~keep] = 2
            left = np.where(new, left - INSERT, left)
            state = np.where(new | rest & ~keep, turned, np.where(keep, to, state))
            open_ = new
    states[turns] = state
    for _ in range(2):
        new = last & (cost[turns][state, lane] > 0)
        inserted[turns][new] += 1
        state = np.where(new, TURNED[state], state)
    states[turns + 1] = state
    return inserted, edit, states


def _buckets(lengths: list[int]) -> Iterator[np.ndarray]:
    """Numbers of the segments, by the power of two that their length reaches."""
    by = np.array([max(n, 1).bit_length() for n in lengths])
    for level in np.unique(by):
        yield np.flatnonzero(by == level)


def _tensor(codes: list[np.ndarray]) -> np.ndarray:
    out = np.full((max(len(c) for c in codes), len(codes)), -1, np.int16)
    for i, c in enumerate(codes):
        out[: len(c), i] = c
    return out


def crossing_costs(codes: list[np.ndarray]) -> np.ndarray:
    """(segment, entry, exit): least costs of each segment between states, insertions behind its last row left out."""
    out = np.empty((len(codes), 4, 4), np.int64)
    for chosen in _buckets([len(c) for c in codes]):
        wide = np.repeat(_tensor([codes[i] for i in chosen]), 4, axis=1)
        ends = np.tile(np.where(np.eye(4, dtype=bool), 0, _FAR), (1, len(chosen)))
        out[chosen] = _back(wide, ends)[0].T.reshape(len(chosen), 4, 4).transpose(0, 2, 1)
    return np.minimum(out, _FAR)


def solve(codes: list[np.ndarray], ends: np.ndarray, entry: np.ndarray, last: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(cost, inserted, edit, states) of each segment, from the costs behind it (segment, state), its entry state and whether its
    conversation ends there; see :func:`_forward`."""
    out: list = [None] * len(codes)
    for chosen in _buckets([len(c) for c in codes]):
        wide = _tensor([codes[i] for i in chosen])
        cost = _back(wide, ends[chosen].T)
        inserted, edit, states = _forward(wide, cost, entry[chosen], last[chosen])
        for k, i in enumerate(chosen):
            n = len(codes[i])
            # insertions at the end stand behind the padding
            places = [*range(n), len(wide)]
            seen = np.append(states[: n, k], [states[len(wide), k], states[-1, k]])
            total = cost[0, entry[i], k] - (0 if last[i] else ends[i, states[-1, k]])
            out[i] = int(total), inserted[places, k], edit[:n, k], seen
    return out


class Segment:
    """Rows of one conversation in order."""

    def __init__(self, key, turns: list, roles: list[str], texts: list[str]):
        self.key, self.turns, self.roles, self.texts = key, turns, roles, texts

    def digests(self) -> list[bytes]:
        return [md5(f"{len(r)}:{r}{t}".encode("utf-8", "surrogatepass")).digest() for r, t in zip(self.roles, self.texts, strict=True)]

    def read(self, earlier: set[int] = frozenset()) -> None:
        """Faults and codes; ``earlier``: rows whose role and text an earlier segment has."""
        seen, self.faults, codes = set(), [], []
        for i, (role, text) in enumerate(zip(self.roles, self.texts, strict=True)):
            end = text.rstrip(_WHITE)
            again = i in earlier or (role, text) in seen
            seen.add((role, text))
            fault = "blank" if not end else "duplicate" if again else "truncated" if end[-1] not in ".!?" else None
            self.faults.append(fault)
            codes.append(_INITIALS.get(role[:1], 3) | (_CUT if fault == "truncated" else _GOES if fault else 0))
        self.codes = np.array(codes, np.int16)

    def gaps(self) -> int:
        turns = [t for t in self.turns if t is not None]
        return sum(max(0, b - a - 1) for a, b in zip(turns, turns[1:], strict=False))

    def illegal(self) -> int:
        return sum((a[:1], b[:1]) not in _LEGAL for a, b in zip(self.roles, self.roles[1:], strict=False))

    def result(self, solved, at: int, behind: int, gap: int = 0, illegal: int = 0) -> tuple:
        cost, inserted, edit, states = solved
        letters, messages = [], []

        def insert(k: int) -> int:
            state = states[k]
            for _ in range(inserted[k]):
                letters.append("I")
                messages.append((ROLES[state], ""))
                state = TURNED[state]
            return state

        for k, (role, text) in enumerate(zip(self.roles, self.texts, strict=True)):
            state = insert(k)
            letters.append("DKR"[edit[k]])
            if edit[k]:
                messages.append((role if edit[k] == 1 else ROLES[state], text))
        insert(len(self.roles))
        count = self.faults.count
        return (self.key, at, at + behind + 1, self.gaps() + gap, count("blank"), count("duplicate"), count("truncated"), self.illegal() + illegal, cost, "".join(letters), messages)


_RESULT = ("segment", "segments", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "messages")
_MESSAGES = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_NUMBERS = ", ".join(f"{c} bigint" for c in _RESULT[:8])
_SQL = f"{_NUMBERS}, audit string, messages array<struct<role:string,text:string>>"


def _results(rows: list[tuple], key_type: pa.DataType) -> list[pa.Array]:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 11
    messages = [[{"role": r, "text": t} for r, t in m] for m in columns[10]]
    return [pa.array(columns[0], key_type), *(pa.array(c, pa.int64()) for c in columns[1:9]), pa.array(columns[9], pa.string()), pa.array(messages, _MESSAGES)]


def _pieces(rows: DataFrame, key_type: pa.DataType, key_sql: str, segment_rows: int) -> DataFrame:
    """For rows sorted over ranges: kind 0, results of whole conversations; kind 1, segments of those that may go on in other
    tasks or have several: their rows, and their place ``task``, ``no`` in the order of all segments."""
    names = ["kind", "conv", *_RESULT, "task", "no", "turns", "roles", "texts"]
    lists = [pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, no = TaskContext.get().partitionId(), 0
        whole: list[Segment] = []
        weight = 0

        def finished() -> pa.RecordBatch:
            for s in whole:
                s.read()
            n = len(whole)
            found = solve([s.codes for s in whole], np.tile(AT_END, (n, 1)), np.zeros(n, np.int64), np.ones(n, bool))
            columns = _results([s.result(x, 0, 0) for s, x in zip(whole, found, strict=True)], key_type)
            empty = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), *(pa.nulls(n, t) for t in lists)]
            return pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int8)), *columns, *empty], names=names)

        def opened(s: Segment, number: int) -> pa.RecordBatch:
            values = [pa.array([s.key], key_type), *(pa.nulls(1, pa.int64()) for _ in range(8)), pa.nulls(1, pa.string()), pa.nulls(1, _MESSAGES)]
            place = [pa.array([task]), pa.array([number]), *(pa.array([x], t) for x, t in zip((s.turns, s.roles, s.texts), lists, strict=True))]
            return pa.RecordBatch.from_arrays([pa.array([1], pa.int8()), *values, *place], names=names)

        at, size, first, parted = None, 0, True, False
        for batch in cut_batches(batches):
            for key, turn, role, text in zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True):
                new = at is None or key != at.key
                bytes_ = len(role) + len(text)
                if at is not None and (new or len(at.turns) >= segment_rows or size + bytes_ > SEGMENT_BYTES):
                    if first or parted or not new:
                        yield opened(at, no)
                        no += 1
                    else:
                        whole.append(at)
                        weight += size
                        if len(whole) >= SOLVED or weight >= SEGMENT_BYTES:
                            yield finished()
                            whole, weight = [], 0
                    first, parted = first and not new, not new
                    at, size = Segment(key, [], [], []), 0
                elif at is None:
                    at = Segment(key, [], [], [])
                at.turns.append(turn)
                at.roles.append(role)
                at.texts.append(text)
                size += bytes_
        if whole:
            yield finished()
        if at is not None:
            yield opened(at, no)

    place = "task bigint, no bigint, turns array<bigint>, roles array<string>, texts array<string>"
    return rows.mapInArrow(run, f"kind tinyint, conv {key_sql}, {_SQL}, {place}")


def _segments(batch: pa.RecordBatch) -> list[Segment]:
    return [Segment(*x) for x in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)]


def _coded(opened: DataFrame, key_sql: str) -> DataFrame:
    """The open segments with ``earlier``, the rows whose role and text an earlier segment has, and ``costs``; a written table."""

    def digests():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, found, places = [], [], []
            for i, s in enumerate(_segments(batch)):
                first = {}
                for k, d in enumerate(s.digests()):
                    first.setdefault(d, k)
                rows += [i] * len(first)
                found += first
                places += first.values()
            of = pa.array(rows, pa.int64())
            columns = [*(batch.column(c).take(of) for c in (0, 4, 5)), pa.array(found, pa.binary()), pa.array(places, pa.int32())]
            return pa.RecordBatch.from_arrays(columns, names=["conv", "task", "no", "digest", "at"])

        return step

    columns = ("conv", "turns", "roles", "texts", "task", "no")
    each = materialize(arrow_map(opened.select(*columns), digests, f"conv {key_sql}, task bigint, no bigint, digest binary, at int", 1), "digests")
    firsts = each.groupBy("conv", "digest").agg(F.min(F.struct("task", "no")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = materialize(firsts.select(F.col("conv").alias("conv_"), F.col("digest").alias("digest_"), "first"), "firsts")
    again = each.join(firsts, F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("digest") == F.col("digest_"))).where(F.struct("task", "no") > F.col("first"))
    again = again.groupBy("task", "no").agg(F.collect_list("at").alias("earlier"))

    def costs():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = _segments(batch)
            for s, earlier in zip(found, batch.column(6).to_pylist(), strict=True):
                s.read(set(earlier or ()))
            crossing = crossing_costs([s.codes for s in found]).reshape(len(found), 16)
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(crossing.tolist(), pa.list_(pa.int64()))], names=[*columns, "earlier", "costs"])

        return step

    schema = f"conv {key_sql}, turns array<bigint>, roles array<string>, texts array<string>, task bigint, no bigint, earlier array<int>, costs array<bigint>"
    out = materialize(arrow_map(opened.select(*columns).join(again, ["task", "no"], "left").select(*columns, "earlier"), costs, schema, 16), "coded")
    discard(each, firsts)
    return out


def _in_order(df: DataFrame, step, schema: str, *order) -> DataFrame:
    """``step(state, row)`` over the rows of each conversation in ``order``: (new state, values behind task and no). One small row
    for each segment goes through, none is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, any_ = None, None, False
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if not any_ or row["conv"] != key:
                    key, state, any_ = row["conv"], None, True
                state, values = step(state, row)
                out.append({"task": row["task"], "no": row["no"], **values})
            if out:
                yield pa.RecordBatch.from_pylist(out)

    return df.repartition("conv").sortWithinPartitions("conv", *order).mapInArrow(run, f"task bigint, no bigint, {schema}")


def _ends(state, row):
    """From the last segment backwards: costs behind the segment, and how many follow."""
    costs, behind = state if state is not None else (AT_END.tolist(), -1)
    crossing = row["costs"]
    before = [min(crossing[4 * a + b] + costs[b] for b in range(4)) for a in range(4)]
    return (before, behind + 1), {"ends": costs, "behind": behind + 1}


def _entries(state, row):
    """From the first segment on: state, number, and what the border to the segment before adds."""
    entry, at, turn, role = state if state is not None else (0, 0, None, None)
    first, last = row["first_turn"], row["last_turn"]
    gap = max(0, first - turn - 1) if turn is not None and first is not None else 0
    illegal = int(role is not None and (role, row["first_role"]) not in _LEGAL)
    new = (row["exits"][entry], at + 1, turn if last is None else last, row["last_role"])
    return new, {"entry": entry, "at": at, "gap": gap, "illegal_": illegal}


def _linked(opened: DataFrame, key_type: pa.DataType, key_sql: str) -> DataFrame:
    """The results of open segments."""
    coded = _coded(opened, key_sql)
    ends = materialize(_in_order(coded.select("conv", "task", "no", "costs"), _ends, "ends array<bigint>, behind bigint", F.desc("task"), F.desc("no")), "ends")
    rows = coded.drop("costs").join(ends, ["task", "no"]).select("conv", "turns", "roles", "texts", "task", "no", "earlier", "ends", "behind")

    def read(batch: pa.RecordBatch) -> tuple[list[Segment], np.ndarray, np.ndarray]:
        found = _segments(batch)
        for s, earlier in zip(found, batch.column(6).to_pylist(), strict=True):
            s.read(set(earlier or ()))
        return found, np.array(batch.column(7).to_pylist(), np.int64).reshape(len(found), 4), batch.column(8).to_numpy() == 0

    def exits():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found, costs, last = read(batch)
            solved = solve([s.codes for s in found for _ in range(4)], np.repeat(costs, 4, axis=0), np.tile(np.arange(4), len(found)), np.repeat(last, 4))
            states = np.array([x[3][-1] for x in solved], np.int32).reshape(-1, 4)
            turns = [[t for t in s.turns if t is not None] or [None] for s in found]
            columns = [batch.column(0), batch.column(4), batch.column(5), pa.array(states.tolist(), pa.list_(pa.int32())), pa.array([t[0] for t in turns], pa.int64()), pa.array([t[-1] for t in turns], pa.int64()),
                       pa.array([s.roles[0][:1] for s in found]), pa.array([s.roles[-1][:1] for s in found])]
            return pa.RecordBatch.from_arrays(columns, names=["conv", "task", "no", "exits", "first_turn", "last_turn", "first_role", "last_role"])

        return step

    schema = f"conv {key_sql}, task bigint, no bigint, exits array<int>, first_turn bigint, last_turn bigint, first_role string, last_role string"
    entries = materialize(_in_order(arrow_map(rows, exits, schema, 16), _entries, "entry bigint, at bigint, gap bigint, illegal_ bigint", "task", "no"), "entries")

    def traced():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found, costs, last = read(batch)
            entry, at, gap, illegal = (batch.column(i).to_pylist() for i in range(9, 13))
            solved = solve([s.codes for s in found], costs, np.array(entry, np.int64), last)
            done = [s.result(x, *more) for s, x, *more in zip(found, solved, at, batch.column(8).to_pylist(), gap, illegal, strict=True)]
            return pa.RecordBatch.from_arrays(_results(done, key_type), names=["conv", *_RESULT])

        return step

    out = materialize(arrow_map(rows.join(entries, ["task", "no"]).select("conv", "turns", "roles", "texts", "task", "no", "earlier", "ends", "behind", "entry", "at", "gap", "illegal_"), traced, f"conv {key_sql}, {_SQL}", 16), "linked")
    discard(coded, ends, entries)
    return out


def repair_conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """The repaired conversations, in segments: id, segment and segments (nearly all conversations have one; those of over
    ``segment_rows`` rows or 4 MB, and a few whose rows were dealt to two tasks, have more, numbered from 0), gaps, blank, duplicate,
    truncated, illegal, cost, audit and messages (role, text). Numbers add up over segments; audits and messages follow each other.

    Rows are taken by turn (nulls first), those of one turn by role and the hash of their text. Each row's first fault counts:
    blank (nothing but white space), duplicate (role and text seen earlier), truncated (the last other character isn't ``.``,
    ``!`` or ``?``). ``illegal``: neighbours whose roles don't begin with su, ua or au; ``gaps``: turns missing between the
    least and the largest. Blank and duplicate rows are deleted (D, 3); others are kept (K, 0), get the role user or assistant
    (R, 2) or are deleted; empty turns of these roles are inserted (I, 2); a truncated row that stays costs 1 more. The repaired
    roles begin with ``(s?(ua)+)?``; of the cheapest edits those with the least letters are taken. Null roles and texts
    count as one space; an empty role, or one that begins otherwise, can't be kept. A null id is an id, and repeated rows are
    duplicates. Texts of any length are read whole; conversations without rows, and empty tables, give none. Other columns aren't read.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = rows.schema[id_col].dataType
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    named = rows.select(F.col(id_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"))
    # the last key only deals equal rows out
    keys = [F.col("conv"), F.col("turn"), F.col("role"), F.col("hash"), F.col("salt")]
    salted = named.withColumns({"hash": F.xxhash64("text"), "salt": F.hash(F.monotonically_increasing_id())})
    done = materialize(_pieces(salted.repartitionByRange(*keys).sortWithinPartitions(*keys), to_arrow_type(kind), kind.simpleString(), segment_rows), "pieces")
    columns = ("conv", *_RESULT)
    found = done.where("kind = 0").select(*columns).unionByName(_linked(done.where("kind = 1"), to_arrow_type(kind), kind.simpleString()))
    return found.withColumnRenamed("conv", id_col)


def damage_conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The four columns with faults planted by the row's key: crc32 of ``id:turn`` modulo 20 is 0: the row goes; 1: its text is
    empty; 2: its text loses ``.``, ``!`` and ``?``; 3: it comes twice; 4: its role is user. Nulls in the key, role or text are one
    space; a null turn stays null. Repeated rows have the same fault; an empty table stays empty. Other columns are left out."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space(id_col), F.lit(":"), space(turn_col)).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(space(text_col), ".!?", "")).otherwise(space(text_col))
    role = F.when(fault == 4, "user").otherwise(space(role_col))
    kept = rows.where(fault != 0).select(id_col, turn_col, role.alias(role_col), text.alias(text_col), F.when(fault == 3, 2).otherwise(1).alias("_copies"))
    return kept.select(id_col, turn_col, role_col, text_col, F.explode(F.sequence(F.lit(1), "_copies")).alias("_copy")).drop("_copy")
