"""Toxicity: a weighted lexicon of word beginnings, matched by Aho-Corasick in folded text, normalised by length."""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import materialize, read_table, ship, text_slices

#: Labelled rows of each class that the lexicon and the calibration are fitted on, at most; the choice is by a hash of doc_id.
SAMPLE_PER_CLASS = 4000
LEXICON = 300
PREFIX = range(3, 13)
#: Occurrences in one document that count, so that one text can't make an entry.
PER_DOCUMENT = 5
MIN_RATIO = 4.0
MIN_DOCUMENTS = 3
#: Least log-likelihood ratio of an entry.
MIN_GAIN = 10.0
THRESHOLD = 0.3

#: Phrases in which a listed word is harmless. Fixed values.
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "clown fish", "clownfish", "idiot proof", "sore loser", "stupid simple")

#: Letters of other scripts that look like a Latin one, and digits that stand for letters. Fixed values.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "з": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "i",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ł": "i", "ø": "o", "ð": "d", "đ": "d", "ɡ": "g", "ɑ": "a", "ʟ": "i", "ɪ": "i",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t",
}
_SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i"}
_INSIDE = re.compile(r"(?<=[^\W_])[@$!|]+(?=[^\W_])")


class _Fold(dict):
    """Folding of one character, worked out when first met: i and l are one letter, loose marks and invisible characters go, all but letters is a space.

    Accented Latin letters stay, as they tell words apart in many languages.
    """

    def __missing__(self, code: int) -> str:
        c = chr(code)
        out = ""
        plain = c if code < 0x250 else unicodedata.normalize("NFKD", c)
        for d in plain.lower():
            d = LOOKALIKES.get(d, d)
            kind = unicodedata.category(d)
            out += "" if kind in ("Mn", "Cf") else ("i" if d == "l" else d) if kind[0] == "L" else " "
        self[code] = out
        return out


_FOLD = _Fold()


def fold(text: str | None) -> str:
    """Lower-case words with single spaces around, in which lookalikes and digit spellings are the letters they stand for."""
    text = (text or "").lower()
    if any(s in text for s in _SIGNS):
        text = _INSIDE.sub(lambda m: "".join(_SIGNS[c] for c in m.group()), text)
    return f" {' '.join(text.translate(_FOLD).split())} "


@dataclass
class ToxicityModel:
    """entries: folded beginning of a word -> weight. coefficients: of 1, log1p(hits) and log1p(100 hits a word)."""

    entries: dict[str, float]
    coefficients: tuple[float, float, float] = (-5.0, 0.0, 2.0)
    exceptions: tuple[str, ...] = EXCEPTIONS
    _machine: object = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_machine": None}

    def machine(self):
        if self._machine is None:
            import ahocorasick

            self._machine = ahocorasick.Automaton()
            for entry, weight in self.entries.items():
                self._machine.add_word(f" {entry}", (len(entry), weight))
            for phrase in self.exceptions:
                self._machine.add_word(fold(phrase), (len(fold(phrase)) - 1, None))
            if len(self._machine):
                self._machine.make_automaton()
        return self._machine

    def features(self, text: str | None) -> tuple[float, float]:
        """(weighted hits, the same a word). A hit inside an exception phrase doesn't count."""
        folded = fold(text)
        machine = self.machine()
        if not len(machine) or folded == "  ":
            return 0.0, 0.0
        hits, spared = [], []
        for end, (size, weight) in machine.iter(folded):
            (spared if weight is None else hits).append((end - size, end, weight))
        if spared:  # a phrase holds a hit if, of the phrases that begin no later, the one that ends last ends no sooner
            spared.sort()
            starts, ends = [s for s, _, _ in spared], list(accumulate((e for _, e, _ in spared), max))
            hits = [h for h in hits if not (k := bisect_right(starts, h[0])) or ends[k - 1] < h[1]]
        total = sum(w for _, _, w in hits)
        return total, total / (folded.count(" ") - 1)

    def score(self, text: str | None) -> float:
        total, share = self.features(text)
        a, b, c = self.coefficients
        z = a + b * math.log1p(total) + c * math.log1p(100 * share)
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from: crc32 of the id's text leaves 2 modulo 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("long").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each word beginning by class, and documents, summed over a slice of texts."""
    for batch in batches:
        toxic = batch.column("toxic").to_pylist()
        for first, texts in text_slices(batch, "text", 1 << 20):
            seen = {0: Counter(), 1: Counter()}
            docs = Counter()
            for i, text in enumerate(texts):
                own: Counter = Counter()
                for word, n in Counter(fold(text).split()).items():
                    for k in {min(k, len(word)) for k in PREFIX} if len(word) >= PREFIX.start else ():
                        own[word[:k]] += n
                label = toxic[first + i]
                seen[label].update({p: min(n, PER_DOCUMENT) for p, n in own.items()})
                if label:
                    docs.update(own.keys())
            keys = list(set(seen[0]) | set(seen[1]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in (seen[1], seen[0], docs))], names=["entry", "toxic", "clean", "docs"])


def _ranked(counts: DataFrame, total_toxic: float, total_clean: float) -> DataFrame:
    """(entry, weight) of all word beginnings that may be entries, by falling log-likelihood ratio, longer ones first among equals."""
    toxic, clean = F.col("toxic"), F.col("clean")
    ratio = ((toxic + 0.5) / total_toxic) / ((clean + 0.5) / total_clean)
    share = (toxic + clean) / (total_toxic + total_clean)
    gain = toxic * F.log(F.greatest(toxic, F.lit(0.5)) / total_toxic / share) + clean * F.log(F.greatest(clean, F.lit(0.5)) / total_clean / share)
    rows = counts.filter((F.col("docs") >= MIN_DOCUMENTS) & (ratio >= MIN_RATIO)).select("entry", F.log(ratio).alias("weight"), F.round(gain, 6).alias("gain"))
    return rows.filter(F.col("gain") >= MIN_GAIN).orderBy(F.desc("gain"), F.desc(F.length("entry")), "entry").select("entry", "weight")


def _prefix_free(ranked: Iterable, size: int) -> dict[str, float]:
    """The first `size` entries of which none begins another, so a word has one hit at most."""
    chosen: dict[str, float] = {}
    begun: set[str] = set()  # all beginnings of what is chosen
    for entry, weight in ranked:
        if len(chosen) == size:
            break
        own = {entry[:k] for k in range(1, len(entry) + 1)}
        if entry not in begun and not own & chosen.keys():
            chosen[entry] = weight
            begun |= own
    return chosen


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps for a logistic regression with a small ridge, halved while they don't help."""
    beta = np.zeros(x.shape[1])
    loss = lambda b: float(np.logaddexp(0, x @ b).sum() - y @ (x @ b) + ridge * b @ b / 2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta)), x.T @ (y - p) - ridge * beta)
        scale = 1.0
        while scale > 1e-4 and loss(beta + scale * step) > loss(beta):
            scale /= 2
        beta = beta + scale * step
        if np.abs(scale * step).max() < 1e-8:
            break
    return beta


def train(docs: DataFrame, labels: DataFrame, *, per_class: int = SAMPLE_PER_CLASS, size: int = LEXICON, exceptions: tuple[str, ...] = EXCEPTIONS) -> ToxicityModel:
    """Lexicon and calibration from labelled rows outside the held-out fold.

    At most per_class rows of each class, the first by a hash of doc_id, each text once. Entries are beginnings of
    words that are much more frequent in toxic texts; weights are log ratios of rates. A logistic regression on
    hits and hits a word, fitted to the sample and shifted to the class sizes of all labels, gives the score.
    Without both classes the score is the smoothed share of toxic labels.
    """
    spark = docs.sparkSession
    ship(spark)
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    prior = math.log((sizes.get(1, 0) + 0.5) / (sizes.get(0, 0) + 0.5))
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("toxic")]
    picks = known.filter("toxic = 1").orderBy(*order).limit(per_class).union(known.filter("toxic = 0").orderBy(*order).limit(per_class))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picks), "doc_id")
    sample = materialize(texts.dropDuplicates(["text", "toxic"]).select("text", "toxic"), "toxicity_sample")
    counts = sample.mapInArrow(_counts, "entry string, toxic long, clean long, docs long").groupBy("entry").agg(*[F.sum(c).alias(c) for c in ("toxic", "clean", "docs")])
    counts = materialize(counts, "word_beginnings")
    whole = counts.filter(F.length("entry") == PREFIX.start).agg(F.sum("toxic"), F.sum("clean")).first()
    toxic, clean = (whole[0] or 0) + 1.0, (whole[1] or 0) + 1.0
    # Read in order and only as far as the lexicon needs.
    model = ToxicityModel(_prefix_free(_ranked(counts, toxic, clean).toLocalIterator(), size), exceptions=exceptions)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = [model.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *(pa.array([x[i] for x in f], pa.float64()) for i in (0, 1))], names=["toxic", "hits", "share"])

    rows = sample.mapInArrow(features, "toxic int, hits double, share double").collect()
    y = np.array([r["toxic"] for r in rows], float)
    if 0 < y.sum() < len(y):
        order = np.lexsort([[r["share"] for r in rows], [r["hits"] for r in rows], y])  # sums don't depend on the order of tasks
        x = np.array([[1.0, math.log1p(r["hits"]), math.log1p(100 * r["share"])] for r in rows])[order]
        y = y[order]
        beta = _logistic(x, y)
        beta[0] += prior - math.log(y.sum() / (len(y) - y.sum()))
        model.coefficients = tuple(map(float, beta))
    else:
        model.coefficients = (prior, 0.0, 0.0)
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, threshold: float = THRESHOLD, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: (doc_id, held_out, score, predicted). Whole texts are folded and matched; only the text makes the score.

    Null and empty texts have no hits and get the score of a text without any; null ids and repeated rows are carried; other columns
    are ignored; an empty table gives no row.
    """
    ship(docs.sparkSession)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [model.score(t) for _, texts in text_slices(batch, "text") for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    made = rows.mapInArrow(scores, "doc_id long, score double")
    return made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, train(docs, read_table(spark, sf_dir, "labels").select("doc_id", "toxic")))
