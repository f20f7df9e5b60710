"""Toxicity by a classifier regularised with counterfactuals.

A sparse logistic model on the distinct words of a text and their beginnings.
Training adds, for every sentence of a labelled text that mentions an identity term,
the same sentence with the term swapped for another one of its group, and penalises
the squared change of the score (as a logit) between the two: what a text says may
count, the group it names may not. The terms (``IDENTITY_TERMS``, a parameter) are
English, German, French and Spanish. So neutral mentions of groups that the labels happen to
link with toxicity are not held against them.

The model is fitted on a bounded sample: about ``DOCS_PER_CLASS`` labelled texts of
either class outside the held-out fold, chosen by a hash; class weights give back
the share that the classes have among all labelled rows.

Scores take whole texts. Null and empty texts get the model's base score. Labels
that are null or neither 0 nor 1 are not used; without labelled texts of both
classes every score is the share of toxic ones (0 if there is none). Several
labels for a doc_id, or rows with the same doc_id, are all used. Repeated rows get
repeated results; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ownergraph.llm.common import discard, stored

# Identity terms by language and group; a swap stays within its group,
# whose terms agree in number and gender so that the sentence still reads.
IDENTITY_TERMS = {
    "en": (
        ("women", "men", "girls", "boys"),
        ("woman", "man", "girl", "boy"),
        ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
        ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
        ("black", "white", "asian", "latino", "african", "european", "arab"),
        ("gay", "straight", "lesbian", "heterosexual", "bisexual", "transgender"),
        ("immigrants", "refugees", "citizens", "foreigners", "locals"),
        ("immigrant", "refugee", "citizen", "foreigner", "local"),
        ("disabled", "deaf", "blind", "autistic"),
        ("old", "young", "elderly", "teenage"),
    ),
    "de": (
        ("frauen", "männer", "mädchen", "jungen"),
        ("frau", "dame"),
        ("mann", "herr"),
        ("muslim", "christ", "jude", "hindu", "buddhist", "atheist", "katholik"),
        ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten", "katholiken"),
        ("muslimin", "christin", "jüdin", "buddhistin", "atheistin", "katholikin"),
        ("musliminnen", "christinnen", "jüdinnen", "buddhistinnen", "atheistinnen", "katholikinnen"),
        ("einwanderer", "flüchtlinge", "bürger", "ausländer", "einheimische"),
        ("schwul", "lesbisch", "heterosexuell", "bisexuell"),
        ("behindert", "gehörlos", "blind", "autistisch"),
        *(
            tuple(stem + ending for stem in stems)
            for stems in (
                ("muslimisch", "christlich", "jüdisch", "hinduistisch", "buddhistisch", "katholisch"),
                ("schwarz", "weiß", "asiatisch", "afrikanisch", "europäisch", "arabisch"),
                ("alt", "jung", "betagt"),
            )
            for ending in ("e", "en", "er", "es", "em")
        ),
    ),
    "fr": (
        ("femmes", "filles"),
        ("hommes", "garçons"),
        ("femme", "fille"),
        ("homme", "garçon"),
        ("musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée", "catholique"),
        ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées", "catholiques"),
        ("musulmane", "chrétienne", "juive", "hindoue", "bouddhiste", "athée", "catholique"),
        ("musulmanes", "chrétiennes", "juives", "hindoues", "bouddhistes", "athées", "catholiques"),
        ("noir", "blanc", "asiatique", "africain", "européen", "arabe"),
        ("noirs", "blancs", "asiatiques", "africains", "européens", "arabes"),
        ("noire", "blanche", "asiatique", "africaine", "européenne", "arabe"),
        ("noires", "blanches", "asiatiques", "africaines", "européennes", "arabes"),
        ("immigrés", "réfugiés", "citoyens", "étrangers"),
        ("homosexuel", "hétérosexuel", "bisexuel", "transgenre"),
        ("handicapés", "sourds", "aveugles", "autistes"),
        ("vieux", "jeunes", "âgés"),
    ),
    "es": (
        ("mujeres", "niñas", "chicas"),
        ("hombres", "niños", "chicos"),
        ("mujer", "niña", "chica"),
        ("hombre", "niño", "chico"),
        ("musulmán", "cristiano", "judío", "hindú", "budista", "ateo", "católico"),
        ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos", "católicos"),
        ("musulmana", "cristiana", "judía", "hindú", "budista", "atea", "católica"),
        ("musulmanas", "cristianas", "judías", "hindúes", "budistas", "ateas", "católicas"),
        ("negro", "blanco", "asiático", "africano", "europeo", "árabe"),
        ("negros", "blancos", "asiáticos", "africanos", "europeos", "árabes"),
        ("negra", "blanca", "asiática", "africana", "europea", "árabe"),
        ("negras", "blancas", "asiáticas", "africanas", "europeas", "árabes"),
        ("inmigrantes", "refugiados", "ciudadanos", "extranjeros"),
        ("homosexual", "heterosexual", "bisexual", "transgénero"),
        ("discapacitados", "sordos", "ciegos", "autistas"),
        ("viejos", "jóvenes", "ancianos"),
    ),
}


def term_tables(terms: dict[str, tuple]) -> list[dict[str, tuple[str, ...]]]:
    """Per language: term -> its group (the first one that holds it)."""
    return [{term: group for group in reversed(groups) for term in group} for groups in terms.values()]


TABLES = term_tables(IDENTITY_TERMS)
GROUP = {term: group for found in reversed(TABLES) for term, group in found.items()}
SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")

DOCS_PER_CLASS = 6_000
SPACE = 1 << 20  # hashed features
BEGINNINGS = (4, 5, 6)
LEAST_DOCS, LEAST_Z = 4, 3.0  # support and strength a feature needs
SPARSITY, FAIRNESS, ROUNDS = 1e-4, 5.0, 600
REMEMBER = 500_000  # words remembered per worker
EDGES = ".,;:!?\"'()[]{}<>*#%&$|-_/\\«»„“”‘’¡¿…"


def core(word: str) -> str:
    return word.strip(EDGES)


def features(word: str) -> list[int]:
    """Hashed features of a lower-cased word: itself and its beginnings."""
    word = core(word)
    if not word:
        return []
    names = [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) >= n)]
    return [zlib.crc32(x.encode("utf-8", "replace")) % SPACE for x in names]


def text_features(text: str | None) -> list[int]:
    return sorted({f for w in set((text or "").lower().split()) for f in features(w)})


def swapped(text: str, tables: list[dict[str, tuple[str, ...]]] = TABLES) -> str | None:
    """The text with every identity term replaced by another one of its group,
    the same one for the same term; None if it holds no term. A term that several
    languages have is taken in that of which the text holds the most terms."""
    words = text.lower().split()
    cores = {core(w) for w in words}
    found = [cores & known.keys() for known in tables]
    groups: dict[str, tuple[str, ...]] = {}
    for i in sorted(range(len(tables)), key=lambda i: -len(found[i])):
        for term in found[i]:
            groups.setdefault(term, tables[i][term])
    if not groups:
        return None
    draw = random.Random(zlib.crc32(text.encode("utf-8", "replace")))
    other = {t: draw.choice([x for x in groups[t] if x != t]) for t in sorted(groups)}
    return " ".join(w.replace(core(w), other[core(w)]) if core(w) in other else w for w in words)


def sentence_swaps(text: str, tables: list[dict[str, tuple[str, ...]]] = TABLES) -> list[tuple[list[int], list[int]]]:
    """For each sentence that holds an identity term: the features that its swap
    takes away and those that it brings."""
    out = []
    for sentence in SENTENCE.split(text):
        other = swapped(sentence, tables)
        if other is not None:
            old, new = set(text_features(sentence)), set(text_features(other))
            out.append((sorted(old - new), sorted(new - old)))
    return out


@dataclass
class Model:
    base: float
    weight: dict[int, float]
    known: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def score(self, text: str | None) -> float:
        known, hits = self.known, set()
        for w in set((text or "").lower().split()):
            f = known.get(w)
            if f is None:
                if len(known) >= REMEMBER:
                    known.clear()
                known[w] = f = tuple(x for x in features(w) if x in self.weight)
            if f:
                hits.update(f)
        z = self.base + sum(self.weight[f] for f in sorted(hits))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _sum_rows(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[start[1:]] - total[start[:-1]]


class _Sparse:
    """Rows of (column, value) pairs over the chosen features."""

    def __init__(self, rows: list[list[int]], column: dict[int, int], sign: list[list[float]] | None = None) -> None:
        kept = [[(column[f], v) for f, v in zip(r, sign[i] if sign else [1.0] * len(r)) if f in column] for i, r in enumerate(rows)]
        self.start = np.concatenate([[0], np.cumsum([len(r) for r in kept])]).astype("i8")
        self.at = np.array([c for r in kept for c, _ in r], "i8")
        self.value = np.array([v for r in kept for _, v in r])
        self.row = np.repeat(np.arange(len(kept)), np.diff(self.start))
        self.width = len(column)

    def times(self, w: np.ndarray) -> np.ndarray:
        return _sum_rows(w[self.at] * self.value, self.start)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, weights=g[self.row] * self.value, minlength=self.width)


def fit(rows: list[list[int]], labels: list[int], share: float, pairs: list[tuple[list[int], list[int]]], fairness: float = FAIRNESS) -> Model:
    """``share``: the part of toxic rows that the model is to expect; ``pairs``:
    features of texts and of their counterfactuals."""
    y = np.array(labels, float)
    if not 0 < y.sum() < len(y):
        part = min(max(share, 1e-6), 1 - 1e-6)
        return Model(math.log(part / (1 - part)), {})
    weight = np.where(y == 1, share / y.sum(), (1 - share) / (len(y) - y.sum()))
    n = np.zeros((2, SPACE))
    for r, k in zip(rows, labels):
        n[k, r] += 1
    a, b = n[1], n[0]
    na, nb = y.sum(), len(y) - y.sum()
    part = (a + b) / (na + nb)
    with np.errstate(divide="ignore", invalid="ignore"):
        z = (a / na - b / nb) / np.sqrt(part * (1 - part) * (1 / na + 1 / nb))
    chosen = np.flatnonzero((a + b >= LEAST_DOCS) & (np.abs(np.nan_to_num(z)) >= LEAST_Z))
    if not len(chosen):
        return Model(math.log(share / (1 - share)), {})
    column = {int(f): i for i, f in enumerate(chosen)}
    x = _Sparse(rows, column)
    moved = [(sorted(set(p) - set(q)), sorted(set(q) - set(p))) for p, q in pairs]
    change = _Sparse([p + q for p, q in moved], column, [[1.0] * len(p) + [-1.0] * len(q) for p, q in moved])
    # Accelerated proximal gradient; the step follows from the largest bend of
    # the loss, found by power iteration.
    v, v_base, bend = np.ones(len(column)), 1.0, 1.0
    for _ in range(30):
        size = math.sqrt(float(v @ v) + v_base * v_base)
        v, v_base = v / size, v_base / size
        g = 0.25 * weight * (x.times(v) + v_base)
        v, v_base = x.back(g) + (2 * fairness / len(pairs) * change.back(change.times(v)) if pairs else 0), float(g.sum())
        bend = math.sqrt(float(v @ v) + v_base * v_base)
    step = 0.9 / max(bend, 1e-6)
    w, base = np.zeros(len(column)), math.log(share / (1 - share))
    ahead, ahead_base, momentum = w.copy(), base, 1.0
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(x.times(ahead) + ahead_base, -50, 50)))
        g = weight * (p - y)
        grad = x.back(g)
        if pairs:
            grad += 2 * fairness / len(pairs) * change.back(change.times(ahead))
        new = ahead - step * grad
        new = np.sign(new) * np.maximum(np.abs(new) - step * SPARSITY, 0)
        new_base = ahead_base - step * float(g.sum())
        faster = (1 + math.sqrt(1 + 4 * momentum * momentum)) / 2
        if float(((ahead - new) * (new - w)).sum()) > 0:
            faster = momentum = 1.0  # restart where the momentum overshoots
        ahead = new + (momentum - 1) / faster * (new - w)
        ahead_base = new_base + (momentum - 1) / faster * (new_base - base)
        w, base, momentum = new, new_base, faster
    return Model(base, {int(f): float(v) for f, v in zip(chosen, w) if v})


def held_out(doc_id: Column, of: int = 5, fold: int = 0) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % of == fold, F.lit(False))


def _chosen(sample: DataFrame) -> np.ndarray:
    """Features with the support and strength that ``fit`` asks for, counted on the
    executors; at most ``SPACE`` numbers."""
    size = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    na, nb = size.get(1, 0), size.get(0, 0)
    if not na or not nb:
        return np.zeros(0, "i4")
    a, b = F.col("a"), F.col("n") - F.col("a")
    part = F.col("n") / F.lit(float(na + nb))
    z = (a / F.lit(float(na)) - b / F.lit(float(nb))) / F.sqrt(part * (1 - part) * F.lit(1 / na + 1 / nb))
    # ``fit`` decides; the slack is for rounding. A feature of all texts has no z.
    strong = (F.col("n") >= LEAST_DOCS) & (F.col("n") < na + nb) & (F.abs(z) >= LEAST_Z - 1e-6)
    counts = sample.select("y", F.explode("f").alias("f")).groupBy("f").agg(F.sum("y").alias("a"), F.count(F.lit(1)).alias("n"))
    return np.sort(counts.where(strong).select("f").toArrow().column("f").to_numpy()).astype("i4")


def train(docs: DataFrame, labels: DataFrame, docs_per_class: int = DOCS_PER_CLASS, terms: dict[str, tuple] = IDENTITY_TERMS) -> Model:
    """Features are made, counted and chosen on the executors; the chosen ones of the
    bounded sample come back, in an order that does not depend on the tasks."""
    marks = labels.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("__y")).where(
        F.col("__y").isin(0, 1) & F.col("__id").isNotNull() & ~held_out(F.col("__id"))
    )
    counts = {r["__y"]: r["count"] for r in marks.groupBy("__y").count().collect()}
    total = sum(counts.values())
    if not total:
        return Model(-500.0, {})
    rate = F.when(F.col("__y") == 1, F.lit(docs_per_class / counts.get(1, 1))).otherwise(F.lit(docs_per_class / counts.get(0, 1)))
    drawn = (
        marks.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 24)) < rate * (1 << 24))
        # A rerun draws the same rows.
        .orderBy(F.xxhash64("__id", F.lit(1)), "__id", "__y")
        .limit(3 * docs_per_class)
        # Bounded by the parameter; the documents themselves are not shuffled.
        .transform(F.broadcast)
    )
    texts = docs.select(F.col("doc_id").alias("__id"), F.col("text").alias("__text"))
    drawn_texts = texts.join(drawn, "__id").select("__y", F.xxhash64("__id").alias("__at"), "__text")
    tables = term_tables(terms)
    swaps_type = pa.list_(pa.list_(pa.int32()))

    def extract(batches):
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            swaps = [sentence_swaps(t, tables) if t else [] for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("__y"),
                    batch.column("__at"),
                    pa.array([text_features(t) for t in texts], pa.list_(pa.int32())),
                    pa.array([[x for x, _ in pairs] for pairs in swaps], swaps_type),
                    pa.array([[x for _, x in pairs] for pairs in swaps], swaps_type),
                ],
                names=["y", "at", "f", "gone", "come"],
            )

    shape = "y int, at bigint, f array<int>, gone array<array<int>>, come array<array<int>>"
    sample = stored(drawn_texts.mapInArrow(extract, shape), "toxicity-sample")
    chosen = _chosen(sample)

    def keep(batches):
        known = set(chosen.tolist())

        def few(features):
            return [x for x in features if x in known]

        for batch in batches:
            made = batch.to_pydict()
            # The swaps that change nothing known count as pairs all the same.
            made["f"] = [few(f) for f in made["f"]]
            for side in ("gone", "come"):
                made[side] = [[few(x) for x in pairs] for pairs in made[side]]
            yield pa.RecordBatch.from_pydict(made, schema=batch.schema)

    got = sample.mapInArrow(keep, shape).toArrow()
    rows = sorted(zip(*(got.column(c).to_pylist() for c in ("at", "y", "f", "gone", "come"))))
    discard(sample)
    pairs = [pair for r in rows for pair in zip(r[3], r[4])]
    return fit([r[2] for r in rows], [r[1] for r in rows], counts.get(1, 0) / total, pairs)


def toxicity_score(text: Column, model: Model) -> Column:
    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return score(F.coalesce(text, F.lit("")))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted."""
    model = train(docs, labels)
    return docs.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity_score(F.col("text"), model).alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
