"""Cheapest repair of a conversation's turns, by bidirectional search over its edit lattice.

A repaired conversation is empty, or has the role initials ``s?(ua)+``: an optional system row, then
user and assistant in turns. A node of the lattice is the number of rows passed and the state of that
grammar; its edges are edits. ``K`` keeps a row (0), ``R`` makes it user or assistant (2), ``D`` deletes
it (3, the only edit of blank rows and repeats), ``I`` inserts an empty row (2). A row that stays
truncated adds 1. Of the cheapest edits those with the ASCII-least letters count.

One pass over rows sorted by conversation and turn solves every conversation that lies whole in a
task. The others, cut by task borders or longer than ``PIECE_ROWS`` or ``PIECE_BYTES``, become pieces
with costs from each state to each state; a pass over these few numbers picks the states between
pieces, then every piece is solved for its two states alone. So no task holds a long conversation.
Only its digest, which SHA-256 defines serially, and its letters pass through one task, as a stream.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molspark.session import materialize

#: Rows and bytes of text of a piece; a longer conversation has several.
PIECE_ROWS = 512
PIECE_BYTES = 8 << 20

KEEP, INSERT, REROLE, DELETE, TRUNCATED = 0, 2, 2, 3, 1
BLANKS = " \t\n\x0b\x0c\r"

START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a user or assistant row that fits, by state.
_TURN = (USER, USER, ASSISTANT, USER)
_BEFORE = ((), (), (START, SYSTEM, ASSISTANT), (USER,))
_ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Cost and letters of the inserts that end a conversation after its last row, by state.
_CLOSE = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))
_LEGAL = {"su", "ua", "au"}


def _kept(state: int, initial: str) -> int | None:
    """State after keeping a row; None if its initial does not fit there."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


def _forth(node, rows, last):
    """(cost, letter, node) of the edges that leave a node; ``last``: inserts after the last row too."""
    i, state = node
    if i < len(rows) or last:
        yield INSERT, "I", (i, _TURN[state])
    if i < len(rows):
        initial, fault = rows[i]
        yield DELETE, "D", (i + 1, state)
        if fault != "x":
            more = TRUNCATED * (fault == "t")
            yield REROLE + more, "R", (i + 1, _TURN[state])
            if (after := _kept(state, initial)) is not None:
                yield KEEP + more, "K", (i + 1, after)


def _back(node, rows, last):
    """(cost, letter, node) of the edges that enter a node."""
    i, state = node
    if i < len(rows) or last:
        for before in _BEFORE[state]:
            yield INSERT, "I", (i, before)
    if i:
        initial, fault = rows[i - 1]
        yield DELETE, "D", (i - 1, state)
        if fault != "x":
            more = TRUNCATED * (fault == "t")
            for before in _BEFORE[state]:
                yield REROLE + more, "R", (i - 1, before)
            for before in range(4):
                if _kept(before, initial) == state:
                    yield KEEP + more, "K", (i - 1, before)


def cheapest(rows: list[tuple[str, str]], entry: int = START, exits=(START, ASSISTANT), last: bool = True):
    """(cost, letters) of the cheapest edits from ``entry`` before the rows to one of ``exits`` after
    them, the ASCII-least of equal ones; None if there are none. Rows are (role initial, fault), with
    fault ``x`` for rows that must go, ``t`` for truncated ones, else empty.

    Two heaps meet: one from the entry, one from the exits against the edges. Both are ordered by cost,
    then by rows passed, so that a label is final when it leaves its heap: the only free edge, Keep,
    passes a row. Letters of equal cost at one node are never a beginning of each other, since what
    lies between would be inserts, which cost; so the least letters may be extended on either side.
    The search ends when the two least costs together exceed the best meeting, which leaves every
    meeting of that cost labelled from both sides."""
    n = len(rows)
    ahead, behind = {(0, entry): (0, "")}, {(n, state): (0, "") for state in exits}
    forth, back = [(0, 0, (0, entry))], [(0, 0, node) for node in behind]
    heapq.heapify(back)
    best = None
    settled = (set(), set())

    def meet(node):
        nonlocal best
        if node in ahead and node in behind:
            (a, x), (b, y) = ahead[node], behind[node]
            if best is None or (a + b, x + y) < best:
                best = (a + b, x + y)

    for node in behind:
        meet(node)
    while forth and back and (best is None or forth[0][0] + back[0][0] <= best[0]):
        forwards = forth[0][0] <= back[0][0]
        heap, labels, edges = (forth, ahead, _forth) if forwards else (back, behind, _back)
        cost, _, node = heapq.heappop(heap)
        done = settled[not forwards]
        if node in done or cost > labels[node][0]:
            continue
        done.add(node)
        letters = labels[node][1]
        for more, letter, to in edges(node, rows, last):
            label = (cost + more, letters + letter if forwards else letter + letters)
            if to not in labels or label < labels[to]:
                if to not in labels or label[0] < labels[to][0]:
                    heapq.heappush(heap, (label[0], to[0] if forwards else n - to[0], to))
                labels[to] = label
                meet(to)
    return best


def between_states(rows: list[tuple[str, str]]) -> tuple[list[int], list[int]]:
    """Costs of a piece from each state to each state, 16 numbers, -1 if there is no way; and the rank
    of each way's letters among those from the same state. Inserts after the last row are left to the
    next piece, so letters end with a row's and letters of different ways always differ in a place."""
    costs, ranks = [], []
    for entry in range(4):
        ways = [cheapest(rows, entry, (to,), last=False) for to in range(4)]
        order = sorted(way[1] for way in ways if way)
        costs += [way[0] if way else -1 for way in ways]
        ranks += [order.index(way[1]) if way else -1 for way in ways]
    return costs, ranks


def carry_out(letters: str, roles, texts, entry: int = START) -> list[str]:
    """The repaired rows as ``role:text``."""
    state, i, out = entry, 0, []
    for letter in letters:
        if letter == "D":
            i += 1
        elif letter == "I":
            state = _TURN[state]
            out.append(_ROLE[state] + ":")
        else:
            state = _TURN[state] if letter == "R" else _kept(state, roles[i][:1])
            out.append(f"{_ROLE[state] if letter == 'R' else roles[i]}:{texts[i]}")
            i += 1
    return out


class _Piece:
    """Rows of one conversation in order, their faults, and what is counted on them."""

    def __init__(self):
        self.roles, self.texts, self.faults, self.bytes = [], [], [], 0
        self.blank = self.duplicate = self.truncated = self.turns = self.illegal = 0
        self.least = self.most = None

    def add(self, turn, role, text, repeat):
        if self.roles and self.roles[-1][:1] + role[:1] not in _LEGAL:
            self.illegal += 1
        fault, bare = "", text.strip(BLANKS)
        if not bare:
            fault, self.blank = "x", self.blank + 1
        elif repeat:
            fault, self.duplicate = "x", self.duplicate + 1
        elif bare[-1] not in ".!?":
            fault, self.truncated = "t", self.truncated + 1
        self.roles.append(role)
        self.texts.append("" if fault == "x" else text)
        self.faults.append(fault)
        self.bytes += len(text)
        if turn is not None:
            self.turns += turn != self.most
            self.least = turn if self.least is None else self.least
            self.most = turn

    def full(self) -> bool:
        return len(self.roles) >= PIECE_ROWS or self.bytes >= PIECE_BYTES

    def lattice(self):
        return [(role[:1], fault) for role, fault in zip(self.roles, self.faults, strict=True)]


_COUNTS = [("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64())]
_SQL_COUNTS = "blank long, duplicate long, truncated long, illegal long"
_SPAN = [("turns", pa.int64()), ("least", pa.int64()), ("most", pa.int64()), ("first_initial", pa.string()), ("last_initial", pa.string())]
_SQL_SPAN = "turns long, least long, most long, first_initial string, last_initial string"
_FOUND = [("gaps", pa.int64()), *_COUNTS, ("cost", pa.int64()), ("audit", pa.large_string()), ("repaired_sha256", pa.string())]
_SQL_FOUND = f"gaps long, {_SQL_COUNTS}, cost long, audit string, repaired_sha256 string"
_STRINGS = pa.list_(pa.string())
#: Rows of the first pass: whole conversations have their result, pieces the rest.
_PASSED = [*_FOUND, ("part", pa.int32()), ("seq", pa.int32()), *_SPAN, ("costs", pa.list_(pa.int32())), ("ranks", pa.list_(pa.int32())), ("roles", _STRINGS), ("texts", _STRINGS), ("faults", _STRINGS)]
_SQL_PASSED = f"{_SQL_FOUND}, part int, seq int, {_SQL_SPAN}, costs array<int>, ranks array<int>, roles array<string>, texts array<string>, faults array<string>"


def _emit(conv_type, fields, rows: list[dict]) -> pa.RecordBatch:
    schema = pa.schema([("conv", conv_type), *fields])
    return pa.RecordBatch.from_pylist(rows, schema)


def _gaps(least, most, turns) -> int:
    return 0 if least is None else most - least + 1 - turns


def _solved(conv, piece: _Piece) -> dict:
    cost, audit = cheapest(piece.lattice())
    repaired = "\n".join(carry_out(audit, piece.roles, piece.texts))
    return {
        "conv": conv, "gaps": _gaps(piece.least, piece.most, piece.turns), "blank": piece.blank, "duplicate": piece.duplicate,
        "truncated": piece.truncated, "illegal": piece.illegal, "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256(repaired.encode()).hexdigest(),
    }


def _cut(conv, piece: _Piece, part: int, seq: int) -> dict:
    costs, ranks = between_states(piece.lattice())
    roles = piece.roles
    return {
        "conv": conv, "part": part, "seq": seq, "blank": piece.blank, "duplicate": piece.duplicate, "truncated": piece.truncated,
        "illegal": piece.illegal, "turns": piece.turns, "least": piece.least, "most": piece.most,
        "first_initial": roles[0][:1] if roles else None, "last_initial": roles[-1][:1] if roles else None,
        "costs": costs, "ranks": ranks, "roles": roles, "texts": piece.texts, "faults": piece.faults,
    }


def _pass_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows in; whole conversations solved, the first and the last of a task as pieces, since
    they may go on in its neighbours."""
    part = TaskContext.get().partitionId()
    conv, piece, seq, out, size = None, None, 0, [], 0
    first, cut = True, False
    for batch in batches:
        conv_type = batch.schema.field("conv").type
        for key, turn, role, text, copies, opens in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if piece is None or key != conv:
                if piece is not None:
                    out.append(_cut(conv, piece, part, seq) if first or cut else _solved(conv, piece))
                    seq, first = seq + 1, False
                conv, piece, cut = key, _Piece(), False
            for copy in range(copies):
                if piece.full():
                    out.append(_cut(conv, piece, part, seq))
                    seq, size, cut = seq + 1, size + piece.bytes, True
                    piece = _Piece()
                piece.add(turn, role, text, not opens or copy > 0)
            if len(out) >= 1024 or size >= PIECE_BYTES:
                yield _emit(conv_type, _PASSED, out)
                out, size = [], 0
    if piece is not None:
        out.append(_cut(conv, piece, part, seq))
        yield _emit(conv_type, _PASSED, out)


def _choose_backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of a conversation from its end: the best state after a piece, for each state before it."""
    conv, begun, rest = None, False, None
    for batch in batches:
        follow, keys = [], batch.column("conv").to_pylist()
        for key, costs, ranks in zip(keys, batch.column("costs").to_pylist(), batch.column("ranks").to_pylist(), strict=True):
            if not begun or key != conv:
                conv, begun, rest = key, True, [cost for cost, _ in _CLOSE]
            best = []
            for entry in range(4):
                ways = [(costs[4 * entry + to] + rest[to], ranks[4 * entry + to], to) for to in range(4) if costs[4 * entry + to] >= 0]
                best.append(min(ways))
            rest = [way[0] for way in best]
            follow.append([way[2] for way in best])
        kept = [batch.column(name) for name in ("conv", "part", "seq")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(follow, pa.list_(pa.int32()))], ["conv", "part", "seq", "follow"])


def _choose_forwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states before and after each piece, from the conversation's beginning."""
    conv, begun, state = None, False, START
    for batch in batches:
        entries, exits = [], []
        for key, follow in zip(batch.column("conv").to_pylist(), batch.column("follow").to_pylist(), strict=True):
            if not begun or key != conv:
                conv, begun, state = key, True, START
            entries.append(state)
            state = follow[state]
            exits.append(state)
        kept = [batch.column(name) for name in ("conv", "part", "seq")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(entries, pa.int32()), pa.array(exits, pa.int32())], ["conv", "part", "seq", "entry", "exit"])


_DONE = [("part", pa.int32()), ("seq", pa.int32()), *_COUNTS, *_SPAN, ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired", pa.string())]
_SQL_DONE = f"part int, seq int, {_SQL_COUNTS}, {_SQL_SPAN}, exit int, cost long, audit string, repaired string"


def _solve_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        conv_type = batch.schema.field("conv").type
        for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
            lattice = [(role[:1], fault) for role, fault in zip(row["roles"], row["faults"], strict=True)]
            cost, audit = cheapest(lattice, row["entry"], (row["exit"],), last=False)
            lines = carry_out(audit, row["roles"], row["texts"], row["entry"])
            done = {"conv": row["conv"], "cost": cost, "audit": audit, "repaired": "\n".join(lines) if lines else None}
            yield _emit(conv_type, _DONE, [{name: row.get(name) for name, _ in _DONE} | done])


def _join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order, solved: one row per conversation. Texts pass through the digest only."""
    conv, begun, conv_type, now = None, False, None, None

    def ended():
        cost, letters = _CLOSE[now["exit"]]
        state = now["exit"]
        for _ in letters:
            state = _TURN[state]
            now["sha"].update(("\n" * now["lines"] + _ROLE[state] + ":").encode())
            now["lines"] = True
        return {
            "conv": conv, "gaps": _gaps(now["least"], now["most"], now["turns"]), **{name: now[name] for name, _ in _COUNTS},
            "cost": now["cost"] + cost, "audit": "".join(now["audit"]) + letters, "repaired_sha256": now["sha"].hexdigest(),
        }

    for batch in batches:
        conv_type = batch.schema.field("conv").type
        for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
            if not begun or row["conv"] != conv:
                if begun:
                    yield _emit(conv_type, _FOUND, [ended()])
                conv, begun = row["conv"], True
                now = {name: 0 for name, _ in _COUNTS} | {"cost": 0, "turns": 0, "least": None, "most": None, "audit": [], "lines": False, "last": None, "sha": hashlib.sha256()}
            for name, _ in _COUNTS:
                now[name] += row[name]
            now["cost"] += row["cost"]
            now["exit"] = row["exit"]
            now["audit"].append(row["audit"])
            now["turns"] += row["turns"] - (row["least"] is not None and row["least"] == now["most"])
            now["least"] = row["least"] if now["least"] is None else now["least"]
            now["most"] = now["most"] if row["most"] is None else row["most"]
            if row["first_initial"] is not None:
                now["illegal"] += now["last"] is not None and now["last"] + row["first_initial"] not in _LEGAL
                now["last"] = row["last_initial"]
            if row["repaired"] is not None:
                now["sha"].update(("\n" * now["lines"] + row["repaired"]).encode())
                now["lines"] = True
    if begun:
        yield _emit(conv_type, _FOUND, [ended()])


_ROWS = {"conv_id": "conv", "turn": "turn", "role": "role", "text": "text"}


def repair(rows: DataFrame, copies: str | None = None) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256.

    Rows come in the order of ``turn``, null turns first; of equal turns, by role, then by the text's
    SHA-256. ``copies`` names a column that says how often a row stands, one after another; a
    conversation whose rows all stand 0 times is known but empty: zeros, empty audit, digest of the
    empty text. A null role or text is one space; a null ``conv_id`` is a conversation of its own.
    ``gaps`` counts the turns missing between the least and the greatest. Other columns of ``rows`` do
    not matter. No rows give no rows.

    Equal rows are counted before they are sorted, and repeats are found by an aggregate over keys, so
    neither a hot conversation nor a hot row meets in one task."""
    conv_type = rows.schema["conv_id"].dataType
    count = F.lit(1) if copies is None else F.col(copies)
    rows = rows.select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), count.cast("long").alias("copies"),
        F.when(count > 0, F.coalesce("role", F.lit(" "))).alias("role"), F.when(count > 0, F.coalesce("text", F.lit(" "))).alias("text"),
    )
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("digest", F.sha2("text", 256))
    said = rows.where("copies > 0").groupBy("conv", "role", "digest").agg(F.count("*").alias("n"), F.min(F.struct("turn")).alias("opening"))
    said = materialize(said.where("n > 1").select(F.struct("conv", "role", "digest").alias("key"), F.col("opening.turn").alias("opening")), "said-again")
    here = F.struct("conv", "role", "digest")
    opens = F.col("key").isNull() | F.col("turn").eqNullSafe(F.col("opening"))
    rows = rows.join(said, here.eqNullSafe(F.col("key")), "left").withColumn("opens", opens)
    rows = rows.repartitionByRange("conv", "turn", "role", "digest").sortWithinPartitions("conv", "turn", "role", "digest")
    kind = conv_type.simpleString()
    passed = rows.select("conv", "turn", "role", "text", "copies", "opens").mapInArrow(_pass_rows, f"conv {kind}, {_SQL_PASSED}")
    passed = materialize(passed, "conversations")
    pieces = passed.where("part is not null").drop(*(name for name, _ in _FOUND if name not in ("blank", "duplicate", "truncated", "illegal")))
    ways = pieces.select("conv", "part", "seq", "costs", "ranks").repartition("conv").sortWithinPartitions("conv", F.desc("part"), F.desc("seq"))
    states = ways.mapInArrow(_choose_backwards, f"conv {kind}, part int, seq int, follow array<int>").sortWithinPartitions("conv", "part", "seq")
    states = states.mapInArrow(_choose_forwards, f"conv {kind}, part int, seq int, entry int, exit int").drop("conv")
    solved = pieces.join(states, ["part", "seq"]).mapInArrow(_solve_pieces, f"conv {kind}, {_SQL_DONE}")
    joined = solved.repartition("conv").sortWithinPartitions("conv", "part", "seq").mapInArrow(_join_pieces, f"conv {kind}, {_SQL_FOUND}")
    whole = passed.where("part is null").select("conv", *(name for name, _ in _FOUND))
    return whole.unionByName(joined).withColumnRenamed("conv", "conv_id")


def damage(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) as a seeded fault leaves them: by crc32 of
    ``conv_id:turn`` modulo 20, 0 drops a row (it stands 0 times), 1 empties its text, 2 takes its
    ``.!?`` away, 3 repeats it, 4 makes its role user. Nulls are one space, in the key too."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fault, text = F.crc32(key.cast("binary")) % 20, F.coalesce("text", space)
    return rows.select(
        "conv_id", "turn",
        F.when(fault == 4, F.lit("user")).otherwise(F.coalesce("role", space)).alias("role"),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"),
    )
