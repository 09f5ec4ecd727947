"""Conversation structure repair by a run-length dynamic program (operator 12).

Rows become symbols of role and fault, and equal neighbours a run. The cheapest edits
are a shortest path over four states (nothing yet, after the system turn, after a
user turn, after an assistant turn). A symbol's transition is a 4 x 4 matrix in
min-plus algebra, and a run of any length is crossed by its cached binary powers,
backwards, which gives the cost to go at every run's border. Going forwards, each row
takes the ASCII-least edit that keeps to that cost; that is the audit.

Rows are dealt by ranges of (conv_id, turn), so a conversation of any length spreads
over as many tasks as it fills. A task repairs what begins and ends inside it and is
small; its first and last conversation, and longer ones, go on as chunks: each
chunk's symbols become one matrix, the matrices of a conversation are chained, and
then every chunk unrolls its part on its own, from the state it begins in and the
costs behind it. Where the border lies changes no result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, small_batches

#: Costs of the edits; an undeleted truncated row adds TRUNCATED.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: Rows and characters of a chunk; a conversation up to WHOLE chunks that lies inside a task is repaired there.
CHUNK_ROWS, CHUNK_TEXT, WHOLE = 4096, 1 << 18, 16

_STATES, _FAR = range(4), 1 << 60  # nothing yet, after s, after u, after a
_USER = {0: 2, 1: 2, 3: 2}  # state before a user turn: state after it
_TURN = {"s": {0: 1}, "u": _USER, "a": {2: 3}}
_ADDED = {0: (2, "user"), 1: (2, "user"), 3: (2, "user"), 2: (3, "assistant")}  # the one role that may follow
_LEGAL = {"su", "ua", "au"}
_SPACE = " \t\n\v\f\r"
#: Costs to go behind the last row: what is still to be inserted.
END = (0, 2 * INSERT, INSERT, 0)

Matrix = tuple[tuple[int, ...], ...]


def _times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(_FAR, *(a[i][k] + b[k][j] for k in _STATES)) for j in _STATES) for i in _STATES)


UNIT: Matrix = tuple(tuple(0 if i == j else _FAR for j in _STATES) for i in _STATES)
_INSERTS = _times(*[tuple(tuple(0 if i == j else INSERT if _ADDED[i][0] == j else _FAR for j in _STATES) for i in _STATES)] * 2)


def _edits(symbol: str) -> dict[str, tuple[int, dict[int, int]]]:
    """Of each edit of a row its cost and the states it leads to. symbol: "-" must go, else the role's initial, "~" before it if truncated."""
    out = {"D": (DELETE, {q: q for q in _STATES})}
    if symbol != "-":
        more = TRUNCATED if symbol[0] == "~" and len(symbol) > 1 else 0
        out["K"] = (more, _TURN.get(symbol[-1] if more else symbol, {}))
        out["R"] = (REROLE + more, {q: to for q, (to, _) in _ADDED.items()})
    return out


@lru_cache(64)
def power(symbol: str, k: int) -> Matrix:
    """The transition of 2**k rows of a symbol: inserts before each row, then its edit."""
    if k:
        half = power(symbol, k - 1)
        return _times(half, half)
    row = [[_FAR] * 4 for _ in _STATES]
    for cost, to in _edits(symbol).values():
        for q, p in to.items():
            row[q][p] = min(row[q][p], cost)
    return _times(_INSERTS, tuple(map(tuple, row)))


@lru_cache(1 << 14)
def _before(symbol: str, rows: int, after: tuple[int, ...]) -> tuple[int, ...]:
    for k in range(rows.bit_length()):
        if rows >> k & 1:
            t = power(symbol, k)
            after = tuple(min(t[q][p] + after[p] for p in _STATES) for q in _STATES)
    return after


def costs_before(symbol: str, rows: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to go of the states before a run, from those behind it."""
    least = min(after)
    return tuple(c + least for c in _before(symbol, rows, tuple(c - least for c in after)))


@lru_cache(1 << 14)
def _unrolled(symbol: str, rows: int, state: int, after: tuple[int, ...]) -> tuple[str, int]:
    """The ASCII-least cheapest edits of a run, and the state behind it."""
    behind = [after]
    for _ in range(rows):
        behind.append(costs_before(symbol, 1, behind[-1]))
    edits, out = _edits(symbol), []
    for left in range(rows, 0, -1):
        go, then = behind[left], behind[left - 1]
        while True:
            here = go[state]
            if DELETE + then[state] == here:
                out.append("D")
                break
            into = _ADDED[state][0]
            if INSERT + go[into] == here:
                out.append("I")
                state = into
                continue
            edit = next(e for e in "KR" if state in edits[e][1] and edits[e][0] + then[edits[e][1][state]] == here)
            out.append(edit)
            state = edits[edit][1][state]
            break
    return "".join(out), state


def unroll(runs: list[tuple[str, int]], state: int, after: tuple[int, ...], last: bool) -> tuple[str, int]:
    """The edits of runs from a state, with the costs behind them; the last ones of a conversation close it by inserts."""
    behind = [after]
    for symbol, rows in reversed(runs):
        behind.append(costs_before(symbol, rows, behind[-1]))
    out = []
    for (symbol, rows), then in zip(runs, behind[-2::-1]):
        least = min(then)
        edits, state = _unrolled(symbol, rows, state, tuple(c - least for c in then))
        out.append(edits)
    while last and END[state]:
        out.append("I")
        state = _ADDED[state][0]
    return "".join(out), state


def runs_of(symbols: list[str]) -> list[tuple[str, int]]:
    out: list[list] = []
    for s in symbols:
        if out and out[-1][0] == s:
            out[-1][1] += 1
        else:
            out.append([s, 1])
    return [(s, n) for s, n in out]


def chained(runs: list[tuple[str, int]]) -> Matrix:
    """The transition of runs one after the other."""
    out = UNIT
    for symbol, rows in runs:
        for k in range(rows.bit_length()):
            if rows >> k & 1:
                out = _times(out, power(symbol, k))
    return out


def repaired(edits: str, state: int, rows: list[tuple[str, str]]) -> list[str]:
    """`role:text` of what the edits leave of rows (role, text) or insert."""
    out, at = [], 0
    for e in edits:
        into, role = _ADDED[state]
        if e == "I":
            out.append(f"{role}:")
            state = into
            continue
        own, text = rows[at]
        at += 1
        if e == "K":
            out.append(f"{own}:{text}")
            state = _TURN[own[0]][state]
        elif e == "R":
            out.append(f"{role}:{text}")
            state = into
    return out


def fault_of(text: str) -> str:
    """The fault that the text alone shows."""
    end = text.rstrip(_SPACE)[-1:]
    return "blank" if not end else "" if end in ".!?" else "truncated"


def digest_of(role: str, text: str) -> bytes:
    """128 bits that tell rows (role, text) apart."""
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _symbol(fault: str, role: str) -> str:
    initial = role[:1] or "?"  # a role without an initial can't be kept, as any that no turn may have
    return "-" if fault in ("blank", "duplicate") else f"~{initial}" if fault else initial if initial not in "-~" else "?"


class _Counts:
    """Faults, illegal neighbours and turns of rows in their order."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.low = self.high = None

    def add(self, fault: str, role: str, turn: int | None) -> None:
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        initial = role[:1]
        if self.last is None:
            self.first = initial
        elif self.last + initial not in _LEGAL:
            self.illegal += 1
        self.last = initial
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


_TOTALS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
_DONE = f"conv_id long, {_TOTALS}, audit string, repaired_sha256 string, repaired string"
_ROWS = "chunk long, pos long, turn long, role string, text string, fault string, digest binary"
_SCHEMA = pa.schema([(c, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[k]) for c, k in (x.split() for x in f"{_DONE}, {_ROWS}".split(", "))])


def _whole(texts: bool, chunk_rows: int):
    """Of sorted rows (conv_id, turn, role, text, times): results of conversations that lie inside the task, and the others' rows, in chunks."""

    def repair(conv_id: int | None, rows: list[tuple]) -> dict:
        seen, counts, symbols = set(), _Counts(), []
        for turn, role, text in rows:
            fault = fault_of(text)
            if fault != "blank":
                fault = "duplicate" if (role, text) in seen else fault
                seen.add((role, text))
            counts.add(fault, role, turn)
            symbols.append(_symbol(fault, role))
        runs, cost = runs_of(symbols), END
        for symbol, n in reversed(runs):
            cost = costs_before(symbol, n, cost)
        audit, _ = unroll(runs, 0, END, True)
        text = "\n".join(repaired(audit, 0, [r[1:] for r in rows]))
        return {"conv_id": conv_id, "gaps": counts.gaps, "blank": counts.blank, "duplicate": counts.duplicate, "truncated": counts.truncated, "illegal": counts.illegal, "cost": cost[0], "audit": audit, "repaired_sha256": hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), "repaired": text if texts else None}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        out: list[dict] = []
        state = {"pos": task << 40, "chunk": task << 32, "rows": 0, "text": 0, "out": 0}

        def as_chunks(conv_id: int | None, rows: list[tuple], dropped: bool = False) -> None:
            if dropped:  # so that the conversation is known
                out.append({"conv_id": conv_id, "chunk": state["chunk"], "pos": state["pos"]})
                state["pos"] += 1
            for turn, role, text in rows:
                if state["rows"] >= chunk_rows or state["text"] >= CHUNK_TEXT:
                    state.update(chunk=state["chunk"] + 1, rows=0, text=0)
                out.append({"conv_id": conv_id, "chunk": state["chunk"], "pos": state["pos"], "turn": turn, "role": role, "text": text, "fault": fault_of(text), "digest": digest_of(role, text)})
                state["pos"] += 1
                state["rows"] += 1
                state["text"] += len(text)
                state["out"] += len(text)

        def flushed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pylist(out, _SCHEMA)
            out.clear()
            state["out"] = 0
            return batch

        here, held, size, open_, first = object(), [], 0, True, True
        for batch in batches:
            for conv_id, turn, role, text, times in zip(*(c.to_pylist() for c in batch.columns)):
                if conv_id != here:
                    if not first and not open_:
                        out.append(repair(here, held))
                    open_ = first  # the task before may have its beginning
                    state.update(chunk=state["chunk"] + 1, rows=0, text=0)
                    here, held, size, first = conv_id, [], 0, False
                    if open_:
                        as_chunks(here, [], True)
                rows = [(turn, role, text)] * times
                if open_:
                    as_chunks(here, rows)
                else:
                    held += rows
                    size += sum(len(r[2]) for r in rows)
                    if len(held) > WHOLE * chunk_rows or size > WHOLE * CHUNK_TEXT:
                        as_chunks(here, held, True)
                        held, open_ = [], True
                if len(out) >= 512 or state["out"] > 4 * CHUNK_TEXT:
                    yield flushed()
        if not first and not open_:  # the next task may have its end
            as_chunks(here, held, True)
        if out:
            yield flushed()

    return work


_SUMMARY = "conv_id long, chunk long, symbols array<string>, lengths array<int>, matrix array<long>, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long"
_COUNTED = ("blank", "duplicate", "truncated", "illegal")


def _summary(table: pa.Table) -> pa.Table:
    """One row of a chunk: its runs, their transition, counts, and what its neighbours need to know."""
    rows = sorted((r for r in table.to_pylist() if r["fault"] is not None), key=lambda r: r["pos"])
    counts, symbols = _Counts(), []
    for r in rows:
        fault = "duplicate" if r["fault"] != "blank" and not r["first"] else r["fault"]
        counts.add(fault, r["role"], r["turn"])
        symbols.append(_symbol(fault, r["role"]))
    runs = runs_of(symbols)
    row = {"conv_id": table["conv_id"][0].as_py(), "chunk": table["chunk"][0].as_py(), "symbols": [r[0] for r in runs], "lengths": [r[1] for r in runs], "matrix": [c for line in chained(runs) for c in line]}
    row |= {k: getattr(counts, k) for k in (*_COUNTED, "first", "last", "low", "high", "turns")}
    longs = lambda *names: [(k, pa.int64()) for k in names]
    return pa.Table.from_pylist([row], pa.schema([*longs("conv_id", "chunk"), ("symbols", pa.list_(pa.string())), ("lengths", pa.list_(pa.int32())), ("matrix", pa.list_(pa.int64())), *longs(*_COUNTED), ("first", pa.string()), ("last", pa.string()), *longs("low", "high", "turns")]))


_BEHIND = f"of long, after array<long>, is_last boolean, {_TOTALS}"


def _behind(table: pa.Table) -> pa.Table:
    """Of each chunk of a conversation the costs behind it, with the conversation's totals."""
    chunks = sorted(table.to_pylist(), key=lambda r: r["chunk"])
    behind = [END]
    for c in reversed(chunks):
        t = c["matrix"]
        behind.append(tuple(min(t[4 * q + p] + behind[-1][p] for p in _STATES) for q in _STATES))
    behind.reverse()
    totals = {k: sum(c[k] for c in chunks) for k in _COUNTED} | {"cost": behind[0][0]}
    turns, low, high, last = 0, None, None, None
    for c in chunks:
        if c["first"] is not None:
            totals["illegal"] += last is not None and last + c["first"] not in _LEGAL
            last = c["last"]
        if c["low"] is not None:
            turns += c["turns"] - (c["low"] == high)
            low = c["low"] if low is None else low
            high = c["high"]
    totals["gaps"] = 0 if low is None else high - low + 1 - turns
    out = [{"of": c["chunk"], "after": list(then), "is_last": k == len(chunks) - 1} | totals for k, (c, then) in enumerate(zip(chunks, behind[1:]))]
    return pa.Table.from_pylist(out, pa.schema([("of", pa.int64()), ("after", pa.list_(pa.int64())), ("is_last", pa.bool_()), *[(k.split()[0], pa.int64()) for k in _TOTALS.split(", ")]]))


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of each chunk from each of the four states, and the states that they end in."""
    for batch in batches:
        audits, ends = [], []
        for symbols, lengths, after, last in zip(*(batch.column(c).to_pylist() for c in ("symbols", "lengths", "after", "is_last"))):
            ways = [unroll(list(zip(symbols, lengths)), q, tuple(after), last) for q in _STATES]
            audits.append([w[0] for w in ways])
            ends.append([w[1] for w in ways])
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("chunk"), pa.array(audits, pa.list_(pa.string())), pa.array(ends, pa.list_(pa.int32()))], ["conv_id", "chunk", "audits", "ends"])


def _begun(table: pa.Table) -> pa.Table:
    """The state in which each chunk of a conversation begins."""
    state, of, begins = 0, [], []
    for chunk, ends in sorted(zip(table["chunk"].to_pylist(), table["ends"].to_pylist())):
        of.append(chunk)
        begins.append(state)
        state = ends[state]
    return pa.table({"of": pa.array(of, pa.int64()), "state": pa.array(begins, pa.int32())})


def _part(table: pa.Table) -> pa.Table:
    """The repaired turns of a chunk."""
    rows = sorted((r for r in table.to_pylist() if r["fault"] is not None), key=lambda r: r["pos"])
    audit, state = table["audit"][0].as_py(), table["state"][0].as_py()
    items = repaired(audit, state, [(r["role"], r["text"]) for r in rows])
    row = {"conv_id": table["conv_id"][0].as_py(), "chunk": table["chunk"][0].as_py(), "audit": audit, "items": len(items), "part": "\n".join(items).encode("utf-8", "surrogatepass")}
    return pa.Table.from_pylist([row], pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("audit", pa.string()), ("items", pa.int64()), ("part", pa.binary())]))


def _joined(texts: bool):
    """Audit, digest and text of conversations from their parts in order, one part at a time."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, audit, sha, kept, begun = object(), [], None, [], False

        def row() -> pa.RecordBatch:
            text = b"".join(kept).decode("utf-8", "surrogatepass") if texts else None
            return pa.RecordBatch.from_arrays([pa.array([here], pa.int64()), pa.array(["".join(audit)]), pa.array([sha.hexdigest()]), pa.array([text], pa.string())], ["conv_id", "audit", "repaired_sha256", "repaired"])

        for batch in batches:
            for conv_id, _, edits, items, part in zip(*(c for c in batch.columns)):
                conv_id = conv_id.as_py()
                if conv_id != here:
                    if sha is not None:
                        yield row()
                    here, audit, sha, kept, begun = conv_id, [], hashlib.sha256(), [], False
                audit.append(edits.as_py())
                if items.as_py():
                    piece = b"\n" * begun + part.as_py()
                    begun = True
                    sha.update(piece)
                    if texts:
                        kept.append(piece)
        if sha is not None:
            yield row()

    return work


def _stitched(rows: DataFrame, texts: bool) -> DataFrame:
    """The results of conversations that are given as chunks of rows."""
    firsts = rows.where("fault <> 'blank'").groupBy("conv_id", "digest").agg(F.min("pos").alias("at")).select("at", F.lit(True).alias("first"))
    slim = rows.select("conv_id", "chunk", "pos", "turn", "role", "fault").join(firsts, F.col("pos") == F.col("at"), "left")
    chunks = keep(slim.groupBy("chunk").applyInArrow(_summary, _SUMMARY), "chunks")
    behind = keep(chunks.drop("symbols", "lengths").groupBy("conv_id").applyInArrow(_behind, _BEHIND), "behind")
    ways = chunks.select("conv_id", "chunk", "symbols", "lengths").join(behind, F.col("chunk") == F.col("of"))
    ways = keep(ways.mapInArrow(_ways, "conv_id long, chunk long, audits array<string>, ends array<int>"), "ways")
    begun = ways.select("conv_id", "chunk", "ends").groupBy("conv_id").applyInArrow(_begun, "of long, state int")
    chosen = ways.join(begun, F.col("chunk") == F.col("of")).select("of", "state", F.element_at("audits", F.col("state") + 1).alias("audit"))
    parts = rows.select("conv_id", "chunk", "pos", "role", "text", "fault").join(chosen, F.col("chunk") == F.col("of"))
    parts = parts.groupBy("chunk").applyInArrow(_part, "conv_id long, chunk long, audit string, items long, part binary")
    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    texts_of = ordered.mapInArrow(_joined(texts), "conv_id long, audit string, repaired_sha256 string, repaired string")
    totals = chunks.select("conv_id", F.col("chunk").alias("c")).join(behind.where("is_last"), F.col("c") == F.col("of")).drop("c", "of", "after", "is_last")
    return totals.withColumnRenamed("conv_id", "id").join(texts_of, F.col("id").eqNullSafe(F.col("conv_id"))).select(*[c.split()[0] for c in _DONE.split(", ")])


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, times): the rows after the damage that crc32(`conv_id:turn`) % 20 tells. Nulls count as one space; a dropped row has times 0."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn"))) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), or_space("role").alias("role"), or_space("text").alias("text"), code.alias("code"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("code") == 0, 0).when(F.col("code") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("times"))


def undamaged(conversations: DataFrame) -> DataFrame:
    """The rows as they are, with nulls in role and text as one space."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), or_space("role"), or_space("text"), F.lit(1).alias("times"))


def repair_conversations(rows: DataFrame, texts: bool = False, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, repaired) of every conversation of rows (conv_id, turn, role, text, times) as damaged() or undamaged() give them.

    repaired is the repaired conversation if texts asks for it, else null. Rows of a
    conversation go by turn (nulls first); equal turns go by role, then by a hash of
    the text, so equal rows are neighbours. A null conv_id is one conversation. A role
    whose first character isn't s, u or a, or which is empty, is never kept as it is.
    A conversation whose rows all have times 0 has zeros, an empty audit and the hash
    of the empty string. An empty table gives an empty result.
    """
    small_batches(rows.sparkSession, 200)
    tie: list[Column] = [F.xxhash64("text"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(64))]  # the last deals out equal rows
    ordered = rows.withColumn("tie", tie[0]).withColumn("salt", tie[1])
    keys = ["conv_id", "turn", "role", "tie", "salt"]
    ordered = ordered.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", "turn", "role", "text", "times")
    both = keep(ordered.mapInArrow(_whole(texts, chunk_rows), f"{_DONE}, {_ROWS}"), "repaired")
    done = both.where("pos is null").select(*[c.split()[0] for c in _DONE.split(", ")])
    return done.union(_stitched(both.where("pos is not null").select("conv_id", *[c.split()[0] for c in _ROWS.split(", ")]), texts))
