"""Operator 12 against a plain search over edits."""

import collections
import hashlib
import heapq
import random
import re
import zlib

import pytest

from filamenta.llm import conversation_repair as repair
from filamenta.llm.queries import QUERIES

GOOD = re.compile(r"(s?(ua)+)?\Z")
BEGINNING = re.compile(r"(s?(ua)*u?)?\Z")
SPACE = " \t\n\v\f\r"


def after_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(key.encode()) % 20
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * {0: 0, 3: 2}.get(code, 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        end = text.rstrip(SPACE)[-1:]
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """Best first over (cost, audit): the first whole path is the answer. Paths are told apart by place and last initial, of which the least is enough."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, made, turns = heapq.heappop(heap)
        if at == len(rows) and GOOD.match(made):
            return cost, audit, turns
        if (at, made[-1:]) in done:
            continue
        done.add((at, made[-1:]))
        for edit, role, more, step in [("I", r, 3, 0) for r in ("user", "assistant")] + ([("D", None, 4, 1), ("K", rows[at][1], 0, 1), ("R", "user", 3, 1), ("R", "assistant", 3, 1)] if at < len(rows) else []):
            if edit in "KR" and marks[at] in ("blank", "duplicate"):
                continue
            more += 3 * (edit in "KR" and marks[at] == "truncated")
            then = made if edit == "D" else made + (role[:1] or "?")
            if BEGINNING.match(then):
                text = rows[at][2] if edit in "KR" else ""
                heapq.heappush(heap, (cost + more, audit + edit, at + step, then, turns if edit == "D" else (*turns, f"{role}:{text}")))


def plain(rows):
    """{conv_id: (gaps, blank, duplicate, truncated, illegal, cost, audit, sha256)}; rows as damaged, ties of turns in the given order."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in after_damage(rows) if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0))
        marks = faults(own)
        turns = [r[0] for r in own if r[0] is not None]
        initials = [r[1][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, text = cheapest(own, marks)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        n = collections.Counter(marks)
        out[conv] = gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest()
    return out


def results(df):
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in rows}


SCHEMA = "conv_id long, turn long, role string, text string"


def drawn_rows(seed, conversations, turns):
    rng = random.Random(seed)
    for conv in [None, *range(conversations)]:
        for turn in rng.sample(range(-3, 4 * turns), rng.randint(1, turns)):
            yield conv, turn, rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", "-", "~x", "Ärger", None]), rng.choice(["One.", "Two?", "Three! ", "cut", "", " \n", "Ünï.", None, f"{turn}.", f"{turn}!", f"{turn}", f"No {turn}? "])


@pytest.mark.parametrize("chunk_rows", [repair.CHUNK_ROWS, 3])
def test_repairs_equal_plain_ones(spark, chunk_rows):
    rows = [*drawn_rows(1, 60, 12)] + [(1000, t, "user" if t % 3 else "assistant", f"{t % 50}." if t % 7 else "x") for t in range(300)] + [(2000, None, "user", "Hi.")]
    df = spark.createDataFrame([(*r, "more", 1, "x") for r in rows], SCHEMA + ", chunk string, pos long, fault string").repartition(5)
    assert results(repair.repair_conversations(repair.damaged(df), chunk_rows=chunk_rows)) == plain(rows)


def test_query_equals_plain(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert results(QUERIES["op12_conversation_repair"](spark, sf)) == plain(rows)


def test_odd_tables(spark):
    empty = hashlib.sha256(b"").hexdigest()
    of = lambda rows: results(repair.repair_conversations(repair.damaged(spark.createDataFrame(rows, SCHEMA))))
    assert of([]) == {}
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    long = [(5000, k, "user" if k % 2 == 0 else "assistant", "word " * 60_000 + ".") for k in range(8)]
    rows = [(gone, 0, "user", "Hi."), *[(None, None, None, None)] * 2, *long]
    assert of(rows) == plain(rows) and of(rows)[gone] == (0, 0, 0, 0, 0, 0, "", empty)
    tied = [(7, 1, "user", "b."), (7, 1, "user", "a."), (7, 1, "assistant", "c."), (7, 1, "user", "a.")]
    assert of(tied) == of(tied[::-1])


def test_texts_and_undamaged_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi"), (1, 2, "user", "Hello?"), (1, 5, "tool", "Yes.")]
    df = spark.createDataFrame(rows, SCHEMA)
    for chunk_rows in (100, 1):
        r = repair.repair_conversations(repair.undamaged(df), texts=True, chunk_rows=chunk_rows).first()
        assert (r["gaps"], r["truncated"], r["illegal"], r["cost"], r["audit"]) == (2, 1, 2, 7, "KDKR")
        assert r["repaired"] == "system:Be kind.\nuser:Hello?\nassistant:Yes."


def test_powers_are_repeated_steps():
    for symbol in ("-", "s", "~s", "u", "~u", "a", "~a", "x"):
        one = repair.power(symbol, 0)
        assert repair.power(symbol, 3) == repair._times(*[repair._times(*[repair._times(one, one)] * 2)] * 2)
        after = repair.END
        for _ in range(13):
            after = repair.costs_before(symbol, 1, after)
        assert after == repair.costs_before(symbol, 13, repair.END)
