"""Repair of conversation structure: the cheapest edits that give ``(system? (user assistant)+)?``, found with a
survivor-coalescence Viterbi.

Rows are ordered by range partitioning, so a conversation of any length is spread over tasks; there each row becomes a
code of its role's initial and its first fault. Only codes and row numbers (a few bytes a row) are then streamed in order
through one Viterbi walk for each conversation. A walk keeps at most one survivor for each grammar state; survivors are
leaves of a backpointer tree whose nodes count their references, a node without any is dropped, and the edits up to the
survivors' common ancestor leave the walk as soon as there is one. Memory is what is unresolved, plus the audit.
Ties go to the least string of edits: survivors carry the order of their complete unresolved suffixes, which one step
more extends. Survivors that can no longer win are dropped too, else "all deleted so far" would never coalesce.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodlake.llm.common import as_batch, materialized, prepare, shuffle_partitions, text_key

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5          # costs of edits, and of an undeleted truncated row
SPACES = " \t\n\x0b\x0c\r"
FAULTS = ["blank", "duplicate", "truncated"]            # fault codes 1, 2, 3
ROLES = {"u": "user", "a": "assistant"}
_INITIALS = "sua"                                       # codes 1, 2, 3; other initials 0
#: Grammar states: nothing yet, after the system's row, after a user's, after an assistant's (or an insertion of one).
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: _MORE[s][t]: what any rest costs from t at most beyond its cost from s.
_MORE = ((0, 10, 5, 2), (0, 0, 2, 0), (2, 5, 0, 2), (0, 10, 5, 0))
_END = ("", "ua", "a", "")                              # roles inserted behind the last row
#: Fewest unresolved rows for which a common ancestor is looked for.
_LOOK = 64

_CODES = "seq long, conv string, initial int, fault int, copies long"
_EDITS = {"conv": pa.string(), "seq": pa.int64(), "before": pa.string(), "edit": pa.string(), "new_role": pa.string(),
          "summary": pa.struct([(c, pa.int64()) for c in (*FAULTS, "illegal", "cost")] + [("audit", pa.string())])}
_EDITS_DDL = ("conv string, seq long, before string, edit string, new_role string, "
              "summary struct<blank:bigint,duplicate:bigint,truncated:bigint,illegal:bigint,cost:bigint,audit:string>")


def _options(state: int, initial: int, fault: int) -> Iterator[tuple[int, int, str]]:
    """(next state, cost, edits) of one row. An insertion stands right before a row that stays: behind deletions it
    costs the same, and its audit is less."""
    yield state, DELETE, "D"
    if fault in (1, 2):
        return
    extra = TRUNCATED if fault == 3 else 0
    if initial == 1 and state == NONE:
        yield SYSTEM, extra, "K"
    for role, after, lacks in ((2, USER, state == USER), (3, ASSISTANT, state != USER)):
        edit, cost = ("K", extra) if initial == role else ("R", extra + REROLE)
        yield after, cost + INSERT * lacks, "I" * lacks + edit


@lru_cache(maxsize=100_000)
def _step(survivors: tuple, initial: int, fault: int) -> tuple[int, tuple, tuple]:
    """One row further. ``survivors``: (state, cost above the least, order of its edits). Returns what the least cost
    grew by, the new survivors, and for each the state that it came from and its edits."""
    best: dict[int, tuple] = {}
    for state, cost, order in survivors:
        for after, more, edits in _options(state, initial, fault):
            found = (cost + more, (order, edits), state)
            if after not in best or found < best[after]:
                best[after] = found
    alive = {s: x for s, x in best.items() if not any(y[0] + _MORE[s][t] < x[0] for t, y in best.items())}
    least = min(x[0] for x in alive.values())
    ordered = sorted(alive, key=lambda s: alive[s][1])
    new = tuple((s, alive[s][0] - least, ordered.index(s)) for s in alive)
    return least, new, tuple((s, alive[s][2], alive[s][1][1]) for s in alive)


class _Node:
    __slots__ = ("parent", "row", "edits", "refs")

    def __init__(self, parent: _Node | None, row: tuple | None, edits: str):
        self.parent, self.row, self.edits, self.refs = parent, row, edits, 0


class Walk:
    """The Viterbi walk of one conversation; ``step`` and ``end`` return what is resolved:
    (seq, roles inserted before the row, edit, new role or None)."""

    def __init__(self):
        self.survivors = ((NONE, 0, 0),)
        self.base = _Node(None, None, "")               # the last resolved row
        self.nodes = {NONE: self.base}
        self.base.refs = 1
        self.state, self.cost, self.audit = NONE, 0, []
        self.pending, self.look = 0, _LOOK
        self.counts, self.illegal, self.last = [0, 0, 0, 0], 0, None

    def step(self, seq: int, initial: int, fault: int, copies: int = 1) -> list[tuple]:
        """A row that occurs ``copies`` times in succession; all but the first are faulty."""
        again = copies - 1
        self.counts[fault] += 1
        self.counts[1 if fault == 1 else 2] += again
        self.illegal += again + (self.last is not None and (self.last, initial) not in ((1, 2), (2, 3), (3, 2)))
        self.last = initial
        least, self.survivors, moves = _step(self.survivors, initial, fault)
        self.cost += least + DELETE * again
        old, self.nodes = self.nodes, {}
        for state, came_from, edits in moves:
            parent = old[came_from]
            parent.refs += 1
            self.nodes[state] = node = _Node(parent, (seq, initial, again), edits)
            node.refs = 1
        for node in old.values():
            self._release(node)
        self.pending += 1
        if self.pending < self.look:
            return []
        out = self._resolve()
        self.look = max(_LOOK, 2 * self.pending)
        return out

    def _release(self, node: _Node) -> None:
        node.refs -= 1
        while not node.refs and node.parent is not None:
            dead, node = node, node.parent
            dead.parent = None
            node.refs -= 1

    def _path(self, node: _Node) -> list[_Node]:
        """The nodes from behind the last resolved row up to this one."""
        path = []
        while node is not self.base:
            path.append(node)
            node = node.parent
        return path[::-1]

    def _resolve(self) -> list[tuple]:
        """Edits up to the survivors' common ancestor."""
        out = []
        leaves = {id(n) for n in self.nodes.values()}
        for node in self._path(next(iter(self.nodes.values()))):
            if self.base.refs > 1 or id(self.base) in leaves:
                break
            out.append(self._emit(node))
        return out

    def _emit(self, node: _Node) -> tuple:
        seq, initial, again = node.row
        before = ""
        for _ in node.edits[:-1]:
            before += "a" if self.state == USER else "u"
            self.state = ASSISTANT if self.state == USER else USER
        edit, role = node.edits[-1], None
        if edit != "D":
            if edit == "R":
                role = ROLES["a" if self.state == USER else "u"]
            self.state = SYSTEM if edit == "K" and initial == 1 else ASSISTANT if self.state == USER else USER
        self.audit.append(node.edits + "D" * again)
        self.base, node.parent = node, None
        self.pending -= 1
        return seq, before, edit, role

    def end(self) -> tuple[list[tuple], str]:
        """The rest, and the roles inserted behind the last row."""
        _, _, state = min((cost + INSERT * len(_END[s]), order, s) for s, cost, order in self.survivors)
        self.cost += next(c for s, c, _ in self.survivors if s == state) + INSERT * len(_END[state])
        out = [self._emit(n) for n in self._path(self.nodes[state])]
        self.audit.append("I" * len(_END[state]))
        return out, _END[state]


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes in order -> the edits of every row, and behind each conversation's last one its summary (with what is
    inserted there)."""
    conv, walk, seq, out = None, None, 0, []

    def summary() -> None:
        rest, behind = walk.end()
        out.extend((conv, *x, None) for x in rest)
        facts = dict(zip(FAULTS, walk.counts[1:])) | {"illegal": walk.illegal, "cost": walk.cost, "audit": "".join(walk.audit)}
        out.append((conv, seq, behind, None, None, facts))

    def flush() -> pa.RecordBatch:
        batch = as_batch(dict(zip(_EDITS, map(list, zip(*out)))), _EDITS)
        out.clear()
        return batch

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("conv", "seq", "initial", "fault", "copies"))):
            if row[0] != conv:
                if walk:
                    summary()
                conv, walk = row[0], Walk()
            seq = row[1]
            out.extend((conv, *x, None) for x in walk.step(*row[1:]))
        if out:
            yield flush()
    if walk:
        summary()
        yield flush()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in order -> the SHA-256 of each conversation's lines, joined by newlines; nothing but its state is held."""
    types = {"conv": pa.string(), "repaired_sha256": pa.string()}
    conv, state = None, None
    for batch in batches:
        done = []
        for own, line in zip(batch.column("conv").to_pylist(), batch.column("line").to_pylist()):
            if own != conv:
                if state:
                    done.append((conv, state.hexdigest()))
                conv, state = own, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(line.encode())
        if done:
            yield as_batch(dict(zip(types, map(list, zip(*done)))), types)
    if state:
        yield as_batch({"conv": [conv], "repaired_sha256": [state.hexdigest()]}, types)


def conversation_key(conv_id: Column) -> Column:
    """A string for each conversation id, null included."""
    return F.when(conv_id.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), conv_id.cast("string")))


def _in_order(df: DataFrame, *order: str) -> DataFrame:
    return df.repartition(shuffle_partitions(df.sparkSession), "conv").sortWithinPartitions("conv", *order)


@dataclass(frozen=True)
class Repair:
    """``rows``: conv, conv_id, seq, turn, role, text, copies, fault, before (initials of the roles inserted before it),
    edit (K, R or D; further copies are deleted), new_role. ``summary``: conv, blank, duplicate, truncated, illegal,
    cost, audit. ``repaired``: conv, conv_id, seq, at, role, text, ordered by seq and at within a conversation."""
    rows: DataFrame
    summary: DataFrame
    repaired: DataFrame


def repair(conversations: DataFrame) -> Repair:
    """The cheapest edits that make every conversation ``(system? (user assistant)+)?`` by its roles' initials.

    Rows (conv_id, turn, role, text; other columns are not used) go by turn, nulls first, then role, then text; equal
    rows follow each other. A null role or text counts as one space, a null conv_id is a conversation of its own, and
    an empty role has no initial, so it cannot stay. A row's first fault counts: blank, duplicate (an earlier row has
    its role and text), truncated (its last character that is no space is not ``.``, ``!`` or ``?``). Blank rows and
    duplicates are deleted (2); others are kept (0), get the role user or assistant (1) or are deleted (2), truncated
    ones that stay add 5; an inserted empty row of a user or assistant costs 5. Among the cheapest edits the
    ASCII-least string of initials counts. An empty table has no conversations."""
    spark = conversations.sparkSession
    prepare(spark)
    blank_for = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    # equal rows are one with a count; keys of text are 128-bit hashes
    rows = (conversations.select("conv_id", conversation_key(F.col("conv_id")).alias("conv"), "turn", blank_for("role"), blank_for("text"))
            .groupBy("conv", "turn", "role", "text").agg(F.first("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
            .withColumns(dict(zip(("c1", "c2"), text_key(F.col("text"))))))
    rows = materialized(rows, "conversation-rows")
    first = (rows.groupBy("conv", "role", "c1", "c2").agg(F.min(F.struct("turn")).alias("at"))    # a null turn is least
             .select("conv", "role", "c1", "c2", F.col("at.turn").alias("turn"), F.lit(True).alias("first")))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("conv", "role", "c1", "c2", "turn")]
    trimmed = F.rtrim("text", F.lit(SPACES))
    fault = (F.when(F.length(trimmed) == 0, 1).when(F.col("first").isNull(), 2)
             .when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0))
    initial = F.substring("role", 1, 1)
    coded = (rows.alias("r").join(first.alias("f"), same, "left").select("r.*", "f.first")
             .withColumn("fault", fault)
             .withColumn("initial", F.coalesce(*[F.when(initial == c, F.lit(k + 1)) for k, c in enumerate(_INITIALS)], F.lit(0)))
             .drop("c1", "c2", "first"))
    order = ["conv", "turn", "role", "text"]
    ordered = materialized(coded.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
                           .withColumn("seq", F.monotonically_increasing_id()), "conversation-order")
    found = materialized(_in_order(ordered.select("conv", "seq", "initial", "fault", "copies"), "seq")
                         .mapInArrow(_walks, _EDITS_DDL), "conversation-edits")

    edits = found.filter("edit IS NOT NULL").select("seq", "before", "edit", "new_role")
    names = F.coalesce(*[F.when(F.col("fault") == k + 1, F.lit(name)) for k, name in enumerate(FAULTS)])
    judged = (ordered.join(edits, "seq").withColumn("fault", names)
              .select("conv", "conv_id", "seq", "turn", "role", "text", "copies", "fault", "before", "edit", "new_role"))
    line = lambda at, role, text: F.struct(F.lit(at).alias("at"), role.alias("role"), text.alias("text"))
    inserted = [F.when(F.col("before") == c, F.array(line(0, F.lit(name), F.lit("")))) for c, name in ROLES.items()]
    none = F.array().cast("array<struct<at:int,role:string,text:string>>")
    stays = F.when(F.col("edit") != "D", F.array(line(1, F.coalesce("new_role", "role"), F.col("text"))))
    kept = judged.select("conv", "conv_id", "seq", F.inline(F.concat(F.coalesce(*inserted, none), F.coalesce(stays, none))))
    ends = found.filter("summary IS NOT NULL")
    behind = F.array(*[line(2 + k, F.lit(name), F.lit("")) for k, name in enumerate(ROLES.values())])
    last = ordered.select("seq", "conv_id").join(ends.filter("before <> ''").select("conv", "seq", "before"), "seq").select(
        "conv", "conv_id", "seq", F.inline(F.filter(behind, lambda x: F.contains(F.col("before"), F.left(x["role"], F.lit(1))))))
    return Repair(judged, ends.select("conv", "summary.*"), kept.unionByName(last))


def digests(repaired: DataFrame) -> DataFrame:
    """conv, repaired_sha256 of each conversation's ``role:text`` lines joined by newlines. A hash is a chain, so a
    conversation's lines pass one task, in order and one batch at a time."""
    lines = repaired.select("conv", "seq", "at", F.concat("role", F.lit(":"), "text").alias("line"))
    return _in_order(lines, "seq", "at").mapInArrow(_digests, "conv string, repaired_sha256 string")


def gaps(conversations: DataFrame) -> DataFrame:
    """conv, gaps: turns missing between a conversation's first and last (null turns are ignored; null beyond a long)."""
    span = (F.max("turn").cast("decimal(20)") - F.min("turn").cast("decimal(20)") + 1 - F.count("turn")).try_cast("long")
    return (conversations.select(conversation_key(F.col("conv_id")).alias("conv"), "turn").distinct()
            .groupBy("conv").agg(F.when(F.count("turn") > 0, span).otherwise(0).alias("gaps")))


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with planted faults, by the CRC-32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2
    removes ``.``, ``!`` and ``?`` from it, 3 repeats it, 4 makes it a user's. Nulls count as one space."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    return (conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("_lot"))
            .filter("_lot <> 0")
            .select("conv_id", "turn", F.when(F.col("_lot") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("_lot") == 1, "").when(F.col("_lot") == 2, F.translate("text", ".!?", ""))
                    .otherwise(F.col("text")).alias("text"),
                    F.explode(F.when(F.col("_lot") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy"))
            .drop("_copy"))


def report(originals: DataFrame, rows: DataFrame) -> DataFrame:
    """A row for each conversation of ``originals``: gaps, faults, illegal neighbours, cost, audit and repaired digest of
    its ``rows``; zeros and empty strings where none are left."""
    done = repair(rows)
    out = originals.groupBy(conversation_key(F.col("conv_id")).alias("conv")).agg(F.first("conv_id").alias("conv_id"))
    for part in (gaps(rows), done.summary, digests(done.repaired)):
        out = out.join(part, "conv", "left")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (*FAULTS, "illegal", "cost")}
    missing = F.col("audit").isNull()
    return out.select("conv_id", F.when(missing, F.lit(0)).otherwise(F.col("gaps")).cast("long").alias("gaps"), *zero.values(), F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
