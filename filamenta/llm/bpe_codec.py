"""BPE encoding and decoding with tree concatenation of long unsplit text (operator 3).

A word of at least LONG symbols without white space is cut into leaves that tasks
encode in parallel. Two neighbouring halves are joined by encoding again a window
of the last k tokens of the left and the first k of the right, k growing until
both sides agree: the window's encoding begins with the left half's token and ends
with the right half's. Then every pair of neighbouring tokens of the result
belongs to one exact encoding, which for BPE makes the whole exact; a window that
has grown over both halves is exact anyway.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import word_bpe
from .common import shuffle_partitions, small_batches, text_or_empty

#: Symbols of a leaf.
LEAF = 128


def join_halves(bpe: word_bpe.WordBpe, left: list[str], right: list[str], k: int = 4) -> list[str]:
    """The encoding of the text of two encoded halves, as tokens."""
    if not left or not right:
        return left or right
    while True:
        a, b = left[-k:], right[:k]
        window = bpe.merged([s for t in (*a, *b) for s in split_symbols(t)])
        whole_left, whole_right = k >= len(left), k >= len(right)
        if (whole_left or window[0] == a[0]) and (whole_right or window[-1] == b[-1]):
            return left[: -k or None][: max(0, len(left) - k)] + window + right[k:]
        k *= 2


def split_symbols(token: str) -> list[str]:
    """The single symbols of a token."""
    if token.endswith("</w>"):
        return [*token[:-5], token[-5:]]
    return list(token)


def tree_encode(bpe: word_bpe.WordBpe, leaves: list[list[str]]) -> list[str]:
    """Join encoded leaves pairwise, level by level."""
    while len(leaves) > 1:
        leaves = [join_halves(bpe, leaves[i], leaves[i + 1]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else []


def _digest(bpe: word_bpe.WordBpe, ids: bytes) -> tuple[int, str, str]:
    """Number of ids, SHA-256 of them in decimal, SHA-256 of the decoded text (the vocabulary has no decoder: tokens joined by spaces)."""
    numbers = np.frombuffer(ids, "<u4").tolist()
    return len(numbers), hashlib.sha256(" ".join(map(str, numbers)).encode()).hexdigest(), hashlib.sha256(decode(bpe, numbers).encode()).hexdigest()


def decode(bpe: word_bpe.WordBpe, ids: list[int]) -> str:
    """As the library's decode(ids, skip_special_tokens=False)."""
    token = bpe.token
    return " ".join([token[i] for i in ids])


_RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _result(ids: pa.Array, found: list[tuple[int, str, str]]) -> pa.RecordBatch:
    n, a, b = zip(*found) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode_decode(docs: DataFrame, vocabulary: str, long_run: int = word_bpe.LONG) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of docs (doc_id, text; further columns are ignored).

    Null texts count as empty: no ids, and the digests of the empty string.
    Repeated rows come back as often as they came; an empty table gives an empty
    result. Texts with a run of long_run characters without white space are cut
    into leaves; all others are encoded in one pass over the table, without a shuffle.
    The leaves of one text are joined in one task, as its ids' digest needs them in order.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("string").alias("text"))
    unsplit = F.col("text").rlike(r"\S{%d}" % long_run)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe.load(vocabulary)
        for batch in batches:
            yield _result(batch.column("doc_id"), [_digest(bpe, bpe.encode(t)) for t in batch.column("text").to_pylist()])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe.load(vocabulary)
        for batch in batches:
            for row, doc, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text"))):
                out: list[tuple] = []
                for part, (kind, value) in enumerate(parts_of(bpe, text, long_run)):
                    if kind == "ids":
                        out.append((row, doc, part, 0, None, value))
                    else:
                        cuts = range(0, len(value), LEAF)
                        out += [(row, doc, part, k, "\n".join(value[a : a + LEAF]), None) for k, a in enumerate(cuts)]
                columns = list(zip(*out)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))], ["row", "doc_id", "part", "leaf", "symbols", "ids"])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe.load(vocabulary)
        for batch in batches:
            tokens = ["\n".join(bpe.merged(s.split("\n"))) if s is not None else None for s in batch.column("symbols").to_pylist()]
            yield batch.set_column(batch.schema.get_field_index("symbols"), "symbols", pa.array(tokens, pa.string()))

    def assembled(rows: pd.DataFrame) -> pd.DataFrame:
        bpe = word_bpe.load(vocabulary)
        rows = rows.sort_values(["part", "leaf"])
        ids = []
        for _, part in rows.groupby("part", sort=True):
            if part["symbols"].iloc[0] is None:
                ids.append(part["ids"].iloc[0])
            else:
                ids.append(np.array([bpe.ids[t] for t in tree_encode(bpe, [s.split("\n") for s in part["symbols"]])], "<u4").tobytes())
        n, a, b = _digest(bpe, b"".join(ids))
        return pd.DataFrame({"doc_id": [rows["doc_id"].iloc[0]], "n_tokens": [n], "ids_sha256": [a], "decoded_sha256": [b]}).astype({"doc_id": "Int64"})

    cut = docs.where(unsplit).withColumn("row", F.monotonically_increasing_id()).mapInArrow(leaves, "row long, doc_id long, part long, leaf long, symbols string, ids binary")
    spread = cut.repartition(shuffle_partitions(docs.sparkSession), "row", "part", "leaf").mapInArrow(encoded, cut.schema)
    return docs.where(~unsplit).mapInArrow(whole, _RESULT).union(spread.groupBy("row").applyInPandas(assembled, _RESULT))


def parts_of(bpe: word_bpe.WordBpe, text: str, long_run: int) -> Iterator[tuple[str, bytes | list[str]]]:
    """The text in order, as ids of whole stretches and as the symbols of long words.

    Special tokens are cut out first, as the library does; words then come from its
    own normaliser and splitter, so any text is allowed.
    """
    specials = sorted((t.content for t in bpe.library.get_added_tokens_decoder().values()), key=len, reverse=True)
    import re

    for stretch in re.split("(" + "|".join(map(re.escape, specials)) + ")", text) if specials else [text]:
        if stretch in specials:
            yield "ids", np.array([bpe.library.token_to_id(stretch)], "<u4").tobytes()
            continue
        short: list[int] = []
        normal = bpe.library.normalizer.normalize_str(stretch)
        for shown, _ in bpe.library.pre_tokenizer.pre_tokenize_str(normal):
            if len(shown) < long_run:
                short += [bpe.ids[t] for t in bpe.merged([*shown[:-1], shown[-1] + "</w>"])]
                continue
            if short:
                yield "ids", np.array(short, "<u4").tobytes()
                short = []
            yield "symbols", [*shown[:-1], shown[-1] + "</w>"]
        if short:
            yield "ids", np.array(short, "<u4").tobytes()
