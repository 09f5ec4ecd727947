"""What a Python worker holds when it goes from one operator of the pipeline to the next."""

import re
import subprocess
import sys
import weakref

import public_tokenizers
import pyarrow as pa
import pytest

from filamenta.llm import shingles, word_bpe

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
_TASKS = """
import re, sys
from pathlib import Path
import numpy as np, pandas, pyarrow as pa
from filamenta.llm import jaccard_join, word_bpe
from filamenta.llm.common import giving_back
held = lambda: sum(map(int, re.findall(r"Pss_(?:Anon|Shmem):\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text()))) >> 10
rng = np.random.default_rng(5)
at_first = held()
bpe = word_bpe.load(sys.argv[1])
bpe.encode(" ".join("".join(chr(97 + c) for c in w) for w in rng.integers(0, 26, (100_000, 7))))
del bpe
with_words = held()
texts = [" ".join(map(str, rng.integers(0, 1 << 30, 2_000))) for _ in range(200)]
docs = pa.RecordBatch.from_arrays([pa.array(range(200), pa.int64()), pa.array(texts), pa.array(range(200), pa.int64())], ["doc_id", "text", "mark"])
del texts
rows = sum(b.num_rows for b in giving_back(jaccard_join._profile)(iter([docs])))
del docs
print(rows, at_first, with_words, held())
"""


def test_shingles_let_the_vocabulary_go_and_it_comes_back():
    bpe = word_bpe.load(VOCABULARY)
    assert word_bpe.load(VOCABULARY) is bpe
    ids, gone = bpe.encode("one two three"), weakref.ref(bpe)
    del bpe
    sets = dict(shingles.shingle_sets(pa.array(["a b c d e f", "", None])))
    assert [len(sets[k]) for k in range(3)] == [2, 0, 0]
    assert gone() is None
    assert word_bpe.load(VOCABULARY).encode("one two three") == ids
    assert (dict(shingles.shingle_sets(pa.array(["a b c d e f"])))[0] == sets[0]).all()


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_a_worker_s_memory_falls_when_it_goes_on_to_near_duplicates():
    run = subprocess.run([sys.executable, "-c", _TASKS, VOCABULARY], capture_output=True, text=True, check=True)
    rows, at_first, with_words, after = map(int, re.findall(r"\d+", run.stdout))
    assert rows >= 200
    assert with_words - at_first > 50
    assert after < with_words
