"""Counterfactual-regularised toxicity classifier (operator 4).

A logistic model over the presence of words and word beginnings. It is fitted on a
bounded sample of labelled rows; every text is scored whole. Sentences of the
sample that name a social group are written again with each other group of the
same kind in its place, and a sentence of each sampled text is written with and
without a group of its language, so that there are pairs also where no text names
one. The loss adds PENALTY times the squared difference of the two scores before
the logistic function, so that a neutral mention of a group carries no weight of
its own. Model.pairs and Model.change tell how many pairs there were and by how much
their scores differ.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, small_batches, text_or_empty

#: Most labelled rows of either class that the model is fitted on, taken by a hash of their ids.
SAMPLE = 6000
#: Most features kept, those with the most evidence (G statistic); least number of sampled texts that hold one.
FEATURES, LEAST_TEXTS = 20_000, 3
PENALTY = 10.0
#: Groups of interchangeable identity terms, by language.
IDENTITIES = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("black", "white", "asian", "latino", "arab", "african"),
    ("old", "young", "elderly", "teenage"),
    ("deaf", "blind", "disabled", "autistic"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "atheisten"),
    ("schwule", "lesben", "heterosexuelle", "transsexuelle"),
    ("schwarze", "weiße", "asiaten", "araber", "afrikaner", "türken"),
    ("flüchtlinge", "einwanderer", "ausländer", "einheimische"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "athées"),
    ("gays", "lesbiennes", "hétérosexuels", "transgenres"),
    ("noirs", "blancs", "asiatiques", "arabes", "africains"),
    ("réfugiés", "immigrés", "étrangers", "autochtones"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "ateos"),
    ("homosexuales", "lesbianas", "heterosexuales", "transexuales"),
    ("negros", "blancos", "asiáticos", "árabes", "africanos", "gitanos"),
    ("refugiados", "inmigrantes", "extranjeros", "nativos"),
)
#: Words that tell the language of a sentence, and so the groups that are written into it; English if none does.
_LANGUAGE = ((10, 15, frozenset("der die das und ein eine ist nicht mit zu den sich für".split())), (15, 20, frozenset("le les des et une est dans pour que du avec au sur".split())), (20, 25, frozenset("el los las y una es en para por con del como se".split())))
_EDGE = ".,;:!?\"'()[]{}<>*#$%&-_/\\|=+~`"
_SENTENCE = re.compile(r"[.!?\n]+")


def features_of(word: str) -> tuple[str, ...]:
    """The features of a word in lower case: itself without punctuation around it, and its first 4 and 5 characters."""
    word = word.strip(_EDGE)
    if not word:
        return ()
    return ("=" + word,) + tuple("^" + word[:k] for k in (4, 5) if len(word) > k)


def features(text: str) -> set[str]:
    return {f for w in set(text.lower().split()) for f in features_of(w)}


class Model:
    """Weights by feature; score() is 0 to 1."""

    def __init__(self, weights: dict[str, float], bias: float, pairs: int = 0, change: float = 0.0):
        """pairs: the counterfactual pairs it was fitted on; change: the mean difference of their scores before the logistic function."""
        self.weights, self.bias, self.pairs, self.change, self._known = weights, bias, pairs, change, {}

    def _weighted(self, word: str) -> tuple[str, ...]:
        return tuple(f for f in features_of(word) if f in self.weights)

    def score(self, text: str) -> float:
        known, held = self._known, set()
        for w in set(text.lower().split()):
            got = known.get(w)
            if got is None:
                if len(known) > 500_000:
                    known.clear()
                got = known[w] = self._weighted(w)
            if got:
                held.update(got)
        z = self.bias + sum(self.weights[f] for f in sorted(held))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def counterfactuals(text: str, identities=IDENTITIES) -> list[tuple[set[str], set[str]]]:
    """(features only in a sentence as it is, features only in its rewriting) for each identity term and each other term of its group."""
    group = {t: g for g in identities for t in g}
    out = []
    for sentence in _SENTENCE.split(text.lower()):
        words = sentence.split()
        bare = [w.strip(_EDGE) for w in words]
        for term in {b for b in bare if b in group}:
            here = {f for w in words for f in features_of(w)}
            for other in group[term]:
                if other != term:
                    there = {f for w, b in zip(words, bare) for f in features_of(other if b == term else w)}
                    out.append((here - there, there - here))
    return out


def written_in(text: str, identities=IDENTITIES) -> list[tuple[set[str], set[str]]]:
    """Counterfactuals of one sentence of the text, chosen by its hash: without a group against with it, and with it against with the next of its kind, written behind the first word."""
    sentences = [w for s in _SENTENCE.split(text.lower()) if (w := s.split())]
    if not sentences:
        return []
    h = zlib.crc32(text.encode())
    words = sentences[h % len(sentences)]
    first, last = next(((a, b) for a, b, own in _LANGUAGE if len(own & set(words)) >= 2), (0, 10))
    groups = identities[first:last] or identities
    group = groups[(h >> 8) % len(groups)]
    k = (h >> 16) % len(group)
    here = {f for w in words for f in features_of(w)}
    one, other = (set(features_of(group[j % len(group)])) - here for j in (k, k + 1))
    return [p for p in ((set(), one), (one - other, other - one)) if p[0] or p[1]]


def _constant(y: np.ndarray) -> Model:
    share = float(y.mean()) if len(y) else 0.0
    return Model({}, float(np.log((share + 1e-6) / (1 - share + 1e-6))))


def chosen_features(counts: dict[str, tuple[int, int]], total: np.ndarray) -> list[str]:
    """The features with the most evidence (G statistic; at least the 0.1 % level of one degree of freedom); counts: texts of class 0 and 1 that hold each."""
    names = sorted(counts)
    c = np.array([counts[f] for f in names], float).reshape(-1, 2)
    share = c.sum(1, keepdims=True) * total / total.sum()
    evidence = 2 * np.where(c > 0, c * np.log(np.maximum(c, 1e-9) / np.maximum(share, 1e-9)), 0).sum(1)
    best = np.argsort(-evidence, kind="stable")[:FEATURES]
    return [names[k] for k in best if evidence[k] >= 10.83]


def with_identities(names: list[str], identities=IDENTITIES) -> list[str]:
    """names, and the features of all identity terms, so that every pair has columns."""
    return names + sorted({f for g in identities for t in g for f in features_of(t)} - set(names))


def encoded(text: str, column: dict[str, int], identities=IDENTITIES) -> tuple[list[int], list[list[int]]]:
    """The columns of a text, and for each of its counterfactuals the columns that go (k) and come (-1 - k)."""
    moved = []
    for gone, come in [*counterfactuals(text, identities), *written_in(text, identities)]:
        m = [column[f] for f in sorted(gone) if f in column] + [-1 - column[f] for f in sorted(come) if f in column]
        if m:
            moved.append(m)
    return [column[f] for f in sorted(features(text)) if f in column], moved


def optimised(names: list[str], held: list[list[int]], y: np.ndarray, moved: list[list[int]], penalty: float, rounds: int = 300) -> Model:
    """Logistic regression with balanced classes and the counterfactual penalty, by Adam over all rows."""
    rows = np.repeat(np.arange(len(held)), [len(h) for h in held])
    cols = np.array([j for h in held for j in h], int)
    pi = np.repeat(np.arange(len(moved)), [len(m) for m in moved])
    pk = np.array([j for m in moved for j in m], int)
    pj, ps = np.where(pk >= 0, pk, -1 - pk), np.where(pk >= 0, 1.0, -1.0)
    d, n, pairs = len(names), len(y), len(moved)
    total = np.bincount(y.astype(int), minlength=2)
    balance = np.where(y > 0, n / (2 * total[1]), n / (2 * total[0]))
    w, b = np.zeros(d), 0.0
    m1, m2 = np.zeros(d + 1), np.zeros(d + 1)
    for step in range(1, rounds + 1):
        z = np.bincount(rows, w[cols], n) + b
        g = balance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        grad = np.append(np.bincount(cols, g[rows], d) + 1e-4 * w, g.sum())
        if pairs:
            diff = np.bincount(pi, ps * w[pj], pairs)
            grad[:d] += 2 * penalty / pairs * np.bincount(pj, ps * diff[pi], d)
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        move = 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:d], b - move[d]
    change = float(np.abs(np.bincount(pi, ps * w[pj], pairs)).mean()) if pairs else 0.0
    return Model({f: float(v) for f, v in zip(names, w) if abs(v) > 1e-3}, float(b), pairs, change)


def fit(texts: list[str], labels: np.ndarray, penalty: float = PENALTY, identities=IDENTITIES) -> Model:
    """The model of labelled texts in memory. Without rows of both classes, it gives each text the share of class 1 (0 without rows)."""
    y = np.asarray(labels, float)
    if not len(y) or y.min() == y.max():
        return _constant(y)
    counts: dict[str, list[int]] = {}
    for t, label in zip(texts, y.astype(int)):
        for f in features(t):
            counts.setdefault(f, [0, 0])[label] += 1
    names = with_identities(chosen_features({f: tuple(c) for f, c in counts.items() if sum(c) >= LEAST_TEXTS}, np.bincount(y.astype(int), minlength=2)), identities)
    column = {f: k for k, f in enumerate(names)}
    held, moved = zip(*[encoded(t, column, identities) for t in texts])
    return optimised(names, list(held), y, [m for ms in moved for m in ms], penalty)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """(text, label): at most about limit labelled rows of either class outside the held-out fold, by a hash of their ids.

    Ids are chosen before texts are read, so that the chosen ids, of bounded number,
    are what is sent to every task that reads texts. A row labelled twice counts as
    toxic if either label says so; of the rows of one id that with the least hash of its text counts; null labels and null ids count for nothing.
    """
    y = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label"))
    y = y.where(~held_out()).withColumn("_h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)))
    sizes = {r["label"]: r["count"] for r in y.groupBy("label").count().collect()}  # two rows
    share = F.lit(0)
    for label, n in sizes.items():
        share = F.when(F.col("label") == label, F.lit(int(min(1.0, limit / n) * (1 << 20)))).otherwise(share)
    chosen = y.where(F.col("_h") < share).select("doc_id", "label")
    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", text_or_empty().alias("text"), "label")
    least = F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))  # an id that many rows have counts once
    return rows.groupBy("doc_id", "label").agg(least.alias("row")).select("row.text", "label")


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, penalty: float = PENALTY) -> Model:
    """The model of a bounded sample (SAMPLE rows of either class) of the labelled rows of docs outside the held-out fold.

    Tasks count and encode features; the driver gets the features that may be chosen
    and the sample's rows as column numbers.
    """
    small_batches(docs.sparkSession)
    sample = keep(labelled_sample(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), limit), "labelled")
    total = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if not (total.get(0) and total.get(1)):
        return _constant(np.array([k for k, n in total.items() for _ in range(n)], float))

    def counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            held: dict[str, list[int]] = {}
            for t, label in zip(part["text"], part["label"]):
                for f in features(t):
                    held.setdefault(f, [0, 0])[label] += 1
            yield pd.DataFrame([(f, a, b) for f, (a, b) in held.items()], columns=["feature", "clean", "toxic"])

    n0, n1 = total[0], total[1]
    counts = sample.mapInPandas(counted, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    apart = F.abs(F.col("clean") / n0 - F.col("toxic") / n1) / F.sqrt((F.col("clean") + F.col("toxic")) / (n0 + n1))
    rows = counts.where(F.col("clean") + F.col("toxic") >= LEAST_TEXTS).orderBy(F.desc(apart), "feature").limit(2 * FEATURES).collect()
    names = with_identities(chosen_features({r["feature"]: (r["clean"], r["toxic"]) for r in rows}, np.array([n0, n1], float)))
    column = {f: k for k, f in enumerate(names)}

    def numbered(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([(label, *encoded(t, column)) for t, label in zip(part["text"], part["label"])], columns=["label", "held", "moved"])

    got = sample.mapInPandas(numbered, "label int, held array<int>, moved array<array<int>>").toPandas()
    held = [list(h) for h in got["held"]]
    order = sorted(range(len(held)), key=lambda k: (got["label"][k], held[k]))
    moved = sorted(list(m) for ms in got["moved"] for m in ms)
    return optimised(names, [held[k] for k in order], got["label"].to_numpy(float)[order], moved, penalty)


def score_column(model: Model, text: Column) -> Column:
    """The score of whole texts (null: empty)."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(model.score).astype(float)

    return score(F.coalesce(text, F.lit("")))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs (doc_id, text; further columns are never read).

    Null and empty texts get the model's score of no words. Rows with a null doc_id
    are scored, their held_out is false. Repeated rows come back as often as they
    came; without usable labels every score is near 0; an empty table gives an
    empty result.
    """
    model = train(docs, labels)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), score_column(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that the classifier doesn't call toxic."""
    model = train(docs, labels)
    return docs.where(score_column(model, F.col("text")) < 0.5)
