"""The corpus pipeline: each stage, on what the one before kept, against a plain version of it."""

import collections
import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from filamenta.llm import surrogates, toxicity
from filamenta.llm.common import keep, table


def _sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        out.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def _first_of_groups(rows):
    """Of (doc_id, text) rows those that stay when linked ones keep that with the smallest id."""
    sets = _sets([t for _, t in rows])
    own = list(range(len(rows)))

    def find(x):
        while own[x] != x:
            x = own[x]
        return x

    held = collections.defaultdict(list)
    for k, s in enumerate(sets):
        for h in s:
            held[h].append(k)
    for ks in held.values():
        for a, b in zip(ks, ks[1:]):
            for x in ks if len(ks) < 60 else (a,):
                if find(x) != find(b) and 100 * len(sets[x] & sets[b]) >= 80 * len(sets[x] | sets[b]):
                    own[find(x)] = find(b)
    groups = collections.defaultdict(list)
    for k in range(len(rows)):
        groups[find(k)].append(k)
    return {min(ks, key=lambda k: rows[k][0]) for ks in groups.values()}


def test_each_stage_is_a_plain_version_s(spark, sf):
    docs = table(spark, sf, "documents")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "personal_data", "packing"]
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        out = keep(stage(spark, docs, sf), name)
        steps[name] = (docs, out)
        docs = out
    for name in ("toxicity", "near_duplicates", "personal_data"):
        assert steps[name][1].columns == table(spark, sf, "documents").columns

    before, after = ([tuple(r) for r in d.orderBy("doc_id").collect()] for d in steps["toxicity"])
    model = toxicity.train(steps["toxicity"][0], table(spark, sf, "labels"))
    assert after == [r for r in before if model.score(r[1] or "") < 0.5] and 0 < len(after) < len(before)

    before, after = ([tuple(r) for r in d.select("doc_id", "text").orderBy("doc_id").collect()] for d in steps["near_duplicates"])
    assert after == [before[k] for k in sorted(_first_of_groups(before))] and len(after) < len(before)

    before, after = ([tuple(r) for r in d.select("doc_id", "text", "n_chars").orderBy("doc_id").collect()] for d in steps["personal_data"])
    assert [r[0] for r in before] == [r[0] for r in after]
    new, old = {}, collections.defaultdict(set)
    changed = 0
    for (_, a, n), (_, b, m) in zip(before, after):
        found = surrogates.entities(a)
        changed += bool(found)
        pattern, at = "", 0
        for x, y, _, _ in found:
            pattern, at = pattern + re.escape(a[at:x]) + "(.+?)", y
        match = re.fullmatch(pattern + re.escape(a[at:]), b, re.S)
        assert match and m == len(b) and (found or b == a)
        for (_, _, kind, value), surrogate in zip(found, match.groups()):
            assert surrogate != value and new.setdefault((kind, value), surrogate) == surrogate
            old[surrogate.lower()].add((kind, value))
    assert changed and all(len(v) == 1 for v in old.values())

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t in (tuple(r) for r in steps["packing"][0].select("doc_id", "text").collect())}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in steps["packing"][1].collect():
        assert zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(ids)
    for parts, whole in ((pieces, {i: len(v) for i, v in ids.items()}), (sequences, None)):
        for key, places in parts.items():
            at = 0
            for start, length in sorted(places):
                assert start == at
                at += length
            assert at == whole[key] if whole else at <= 2048
    assert sorted(sequences) == list(range(len(sequences)))


def test_the_whole_run_returns_the_pieces(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0


CLASHING = "id none mark _id _none _mark new row moves _new _row _moves n_replaced entity kind attempt value surrogate _toxic score predicted label node n h c component a b o m _rank _bucket doc_id_ id_ new_ odd.name".split()


@pytest.mark.parametrize("sent", [surrogates.SENT, 0])
def test_columns_of_the_caller_survive_every_stage(spark, sf, monkeypatch, sent):
    monkeypatch.setattr(surrogates, "SENT", sent)
    monkeypatch.setattr(surrogates.replace_personal_data, "__defaults__", (None, sent, "n_replaced"))
    rows = [(1, "Write to anna@example.com now " + "w " * 30, 1), (2, "Write to anna@example.com now " + "w " * 30, 2), (3, "Mr. Weber and Info@acme.com and info@acme.com", 3), (4, None, 4), (5, "plain", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k long")
    docs = docs.select("doc_id", "text", *[F.concat(F.lit(f"{c} "), F.col("k").cast("string")).alias(c) for c in CLASHING])
    before = {r["doc_id"]: r.asDict() for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = keep(stage(spark, docs, sf), name)
        assert out.columns == docs.columns, name
        for r in out.collect():
            want = before[r["doc_id"]] | ({"text": r["text"]} if name == "personal_data" else {})
            assert r.asDict() == want, name
        assert name != "near_duplicates" or {r["doc_id"] for r in out.collect()} == {1, 3, 4, 5}
    assert stage(spark, docs, sf).where("text like '%anna@%' or text like '%acme%.%Weber%'").count() == 0
    assert corpus_pipeline.packing(spark, docs, sf).count() == len(rows)
