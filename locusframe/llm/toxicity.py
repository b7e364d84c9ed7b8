"""Toxicity: a counterfactual-regularised linear classifier.

Features of a text are its lower-case words and the beginnings of words of
three to seven letters, each by the number of distinct words of the text that
have it: at least one, two or three (a stem met once may be chance, three
compounds of it are not).  Weights are fitted by
proximal gradient steps on the logistic loss with an L1 penalty and weights of
zero or more: a text is toxic by what it holds, and the length of a clean text
adds nothing.  Every labelled text that holds an identity term has a
counterfactual, the same text with each term swapped for the next of its group;
``fairness * (score(text) - score(swapped))**2`` is added to the loss, so that
a mere mention of a group moves no score.

The fit uses at most ``max_per_class`` labelled rows of each class, those with
the lowest hash of their id: a documented bound.  Spark counts which features
these have; the ``top`` that lean to toxic rows the most, and of every row only
which of these it has, reach the driver.
Scoring is one map over all rows with the few weights above zero.

Identity terms are given for four languages, as groups of words of one kind and
form; others can be passed.

Defined cases: a null or empty text gets the score of no features; rows with a
null label or id teach nothing; an id with several labels teaches with each;
equal texts get equal scores; without a row of each class the score is the
share of toxic rows known (0.0 without any); other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import cut, discard, handing_back

WORD = re.compile(r"\w+")
PREFIXES = range(3, 8)
#: Marks of one, two and three words with a feature.
LEVELS = (0, 0x2545F4914F6CDD1D, 0x5851F42D4C957F2D)
THRESHOLD = 0.7
MAX_PER_CLASS = 5000
KEPT_WORDS = 400_000
#: Groups of identity terms; a swap takes the next of the group.
IDENTITY_TERMS = (
    # English
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("women", "men"),
    ("woman", "man"),
    ("immigrant", "citizen", "refugee"),
    ("immigrants", "citizens", "refugees"),
    ("disabled", "blind", "deaf"),
    # German
    ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwarze", "weiße", "asiaten", "afrikaner", "europäer"),
    ("schwule", "lesben", "bisexuelle", "transsexuelle"),
    ("frauen", "männer"),
    ("frau", "mann"),
    ("einwanderer", "bürger", "flüchtlinge", "ausländer"),
    ("behinderte", "blinde", "gehörlose"),
    # French
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"),
    ("noirs", "blancs", "asiatiques", "africains", "européens"),
    ("homosexuels", "lesbiennes", "bisexuels", "transgenres"),
    ("femmes", "hommes"),
    ("femme", "homme"),
    ("immigrés", "citoyens", "réfugiés", "étrangers"),
    ("handicapés", "aveugles", "sourds"),
    # Spanish
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"),
    ("negros", "blancos", "asiáticos", "africanos", "europeos"),
    ("homosexuales", "lesbianas", "bisexuales", "transexuales"),
    ("mujeres", "hombres"),
    ("mujer", "hombre"),
    ("inmigrantes", "ciudadanos", "refugiados", "extranjeros"),
    ("discapacitados", "ciegos", "sordos"),
)


def word_features(word: str) -> list[int]:
    """Signed 64-bit hashes of the word and of its beginnings."""
    n = len(word)
    found = [f"={word}", *[word[:k] for k in PREFIXES if k < n]]
    return [xxhash.xxh64_intdigest(f) - (1 << 63) for f in found]


def levels(counts: Counter) -> set[int]:
    """A feature for each number of words, up to the last level, that a hash has reached."""
    return {h ^ LEVELS[k] for h, n in counts.items() for k in range(min(n, len(LEVELS)))}


def features(words: set[str]) -> set[int]:
    return levels(Counter(f for w in words for f in word_features(w)))


def swaps(groups) -> dict[str, str]:
    return {t: g[(i + 1) % len(g)] for g in groups for i, t in enumerate(g)}


@dataclass(frozen=True)
class Model:
    weights: dict[int, float]
    bias: float

    def score(self, found: set[int]) -> float:
        z = self.bias + sum(self.weights[f] for f in sorted(found & self.weights.keys()))
        return float(1 / (1 + np.exp(-z))) if z > -700 else 0.0

    def bases(self) -> set[int]:
        """Hashes of words and beginnings that the score depends on."""
        return {w ^ mark for w in self.weights for mark in LEVELS}


def fit(rows: list[tuple[int, np.ndarray, np.ndarray | None]], names: np.ndarray, l1: float, fairness: float, steps: int) -> Model:
    """rows: label, features and features of the counterfactual or None, as places in ``names``."""
    y = np.array([r[0] for r in rows], float)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model({}, float(np.log(share / (1 - share))) if 0 < share < 1 else (40.0 if share else -1000.0))
    col = np.concatenate([r[1] for r in rows])
    of_row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[1]) for r in rows])
    m = len(names)
    # Counterfactual differences: +1 for what only the text has, -1 for what only the swapped text has.
    pair, pair_col, sign = [], [], []
    for k, r in enumerate(x for x in rows if x[2] is not None):
        for s, part in ((1.0, np.setdiff1d(r[1], r[2])), (-1.0, np.setdiff1d(r[2], r[1]))):
            pair += [k] * len(part)
            pair_col += part.tolist()
            sign += [s] * len(part)
    pair, pair_col, sign = np.array(pair, int), np.array(pair_col, int), np.array(sign)
    n_pairs = int(pair.max()) + 1 if len(pair) else 0
    # Classes weigh the same.
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    w, b = np.zeros(m), 0.0
    v, c, t = w, b, 1.0

    def pull(x):
        """The pairs' part of the gradient, linear in the weights."""
        if not n_pairs:
            return 0.0
        d = np.bincount(pair, weights=sign * x[pair_col], minlength=n_pairs)
        return 2 * fairness / n_pairs * np.bincount(pair_col, weights=sign * d[pair], minlength=m)

    # The largest curvature, by power iteration, bounds the step.
    x, x0, curve = np.ones(m), 1.0, 1.0
    for _ in range(30):
        z = weight * (np.bincount(of_row, weights=x[col], minlength=len(y)) + x0) * 0.25
        x, x0 = np.bincount(col, weights=z[of_row], minlength=m) + pull(x), float(z.sum())
        curve = float(np.sqrt(x @ x + x0 * x0))
        x, x0 = x / curve, x0 / curve
    step = 1 / (1.1 * curve)
    for _ in range(steps):
        z = np.bincount(of_row, weights=v[col], minlength=len(y)) + c
        e = weight * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y)
        g = np.bincount(col, weights=e[of_row], minlength=m)
        g = g + pull(v)
        nw = np.maximum(0.0, v - step * (g + l1))
        nb = c - step * float(e.sum())
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return Model({int(names[i]): float(w[i]) for i in np.flatnonzero(w > 1e-3)}, float(b))


def leaning(sample: DataFrame, min_df: int, top: int) -> np.ndarray:
    """Features seen in ``min_df`` rows at least that lean to toxic rows the most, by log-likelihood ratio; sorted."""

    def count(batches):
        for batch in batches:
            y = batch.column(0).to_numpy()
            own = batch.column(1)
            names, at = np.unique(own.flatten().to_numpy(), return_inverse=True)
            of_row = np.repeat(y, own.value_lengths().to_numpy(zero_copy_only=False))
            found = [names, np.bincount(at, minlength=len(names)), np.bincount(at, weights=of_row, minlength=len(names)).astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["f", "df", "hit"])

    counts = sample.select("y", "own").mapInArrow(count, "f long, df long, hit long").groupBy("f").agg(F.sum("df").alias("df"), F.sum("hit").alias("hit"))
    whole = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("toxic")).first()
    p, q = (F.col("hit") + 0.5) / (whole.toxic + 1), (F.col("df") - F.col("hit") + 0.5) / (whole.n - whole.toxic + 1)
    gain = F.col("hit") * F.log(p / q)
    best = counts.where((F.col("df") >= min_df) & (gain > 0)).orderBy(gain.desc(), "f").limit(top).select("f")
    return np.sort(np.array([r.f for r in best.collect()], np.int64))


def train(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_per_class: int = MAX_PER_CLASS,
    identity_terms=IDENTITY_TERMS,
    l1: float = 3e-4,
    fairness: float = 1.0,
    steps: int = 300,
    min_df: int = 3,
    top: int = 30_000,
) -> Model:
    """Fit on the rows of ``labels`` given; hold rows out before the call."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(
        F.col(id_col).cast("long").alias("key"), F.col(label_col).cast("int").alias("y")
    )
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("key"), "key").limit(max_per_class)
        picked = part if picked is None else picked.unionByName(part)
    # At most 2 * max_per_class rows of two numbers: small enough for every executor by construction.
    texts = df.select(F.col(id_col).cast("long").alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(picked), "key").select("y", "text")
    swap = swaps(identity_terms)

    def extract(batches):
        for batch in batches:
            ys, own, other = [], [], []
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = set(WORD.findall(text.as_py().lower()))
                ys.append(y)
                own.append(sorted(features(words)))
                other.append(sorted(features({swap.get(w, w) for w in words})) if words & swap.keys() else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ys, pa.int32()), pa.array(own, pa.list_(pa.int64())), pa.array(other, pa.list_(pa.int64()))],
                ["y", "own", "other"],
            )

    sample = cut(rows.mapInArrow(handing_back(extract), "y int, own array<long>, other array<long>"), "sample")
    names = leaning(sample, min_df, top)

    def kept(batches):
        for batch in batches:
            out = []
            for k in (1, 2):
                places = [None if not x.is_valid else np.flatnonzero(np.isin(names, x.values.to_numpy())).astype(np.int32) for x in batch.column(k)]
                out.append(pa.array(places, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([batch.column(0), *out], ["y", "own", "other"])

    got = sample.mapInArrow(kept, "y int, own array<int>, other array<int>").toArrow()
    discard(sample)
    array = lambda x: np.array(x.values.to_numpy(), np.int64) if x.is_valid else None
    fitted = [(y.as_py(), array(a), array(o)) for y, a, o in zip(*[got.column(i) for i in range(3)])]
    # Tasks end in any order; a fixed order keeps the fit repeatable.
    fitted.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes()))
    return fit(fitted, names, l1, fairness, steps)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``df``, ``score`` and ``predicted``; columns of these names are replaced."""
    extra = ["score", "predicted"]
    kept = [f for f in df.schema.fields if f.name not in extra]
    at = [f.name for f in kept].index(text_col)
    base = df.select(*[F.col(f"`{f.name}`") for f in kept])

    def run(batches):
        held: dict[str, tuple[int, ...]] = {}
        bases = model.bases()
        for batch in batches:
            scores = []
            for text in batch.column(at):
                found: list[int] = []
                for w in set(WORD.findall((text.as_py() or "").lower())):
                    f = held.get(w)
                    if f is None:
                        f = tuple(x for x in word_features(w) if x in bases)
                        if len(held) > KEPT_WORDS:
                            held.clear()
                        if len(w) < 64:
                            held[w] = f
                    if f:
                        found += f
                scores.append(model.score(levels(Counter(found))))
            added = [pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [f"c{i}" for i in range(len(kept))] + extra)

    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

    schema = StructType(
        [StructField(f"c{i}", f.dataType) for i, f in enumerate(kept)]
        + [StructField("score", DoubleType()), StructField("predicted", IntegerType())]
    )
    named = base.toDF(*[f"c{i}" for i in range(len(kept))])
    return named.mapInArrow(handing_back(run), schema).toDF(*[f.name for f in kept], *extra)


def held_out(id_col: str):
    """Rows that nothing is learnt from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
