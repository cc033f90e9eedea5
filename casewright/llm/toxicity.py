"""Toxicity scores from a classifier that is held to counterfactuals.

A classifier over words learns that names of groups go with abuse when abusive
texts mention them more often, and then rejects neutral mentions. Here each
labelled sentence with an identity term is repeated with the term swapped for
others of its kind (and for a neutral word), and training adds a penalty on the
squared change of the score:

    loss = logistic loss + l2 / 2 |w|^2 + counterfactual / 2 * mean (s(x) - s(x'))^2

with s the score before the logistic function. A pair counts only by the features
that differ, so pairs are counted by that difference where they are, and none is
left out. Words are chosen and weighted on a
sample of at most ``SAMPLE`` labelled rows, in order of a hash; the features of
that sample, at most ``VOCABULARY`` words for each row, are all that the driver
sees. Every text is scored whole, in one pass without a shuffle.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm.registry import query, table
from casewright.llm.rows import free_name, kept_in_worker
from casewright.session import cut_lineage

# Bounds of the fit: labelled rows and words.
SAMPLE = 20_000
VOCABULARY = 1024

# Words a Python worker remembers; a longer list is dropped and started anew.
MEMORY_WORDS = 150_000

# Kinds of identity terms; any term of a kind may stand for another, or for the first, neutral one.
IDENTITY = (
    ("people", "muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"),
    ("religious", "muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"),
    ("people", "women", "men", "girls", "boys", "mothers", "fathers"),
    ("person", "woman", "man", "girl", "boy", "mother", "father"),
    ("people", "gays", "lesbians", "homosexuals", "heterosexuals", "transgender", "bisexuals"),
    ("ordinary", "gay", "lesbian", "homosexual", "heterosexual", "trans", "bisexual", "queer", "straight"),
    ("ordinary", "black", "white", "asian", "african", "european", "latino", "hispanic", "arab", "indian"),
    ("foreign", "american", "mexican", "chinese", "german", "french", "spanish", "polish", "turkish", "russian", "british"),
    ("people", "immigrants", "refugees", "migrants", "foreigners", "natives"),
    ("ordinary", "old", "young", "elderly", "disabled", "deaf", "blind"),
)

# Lengths of the word beginnings that are features beside the word: inflected languages change the end.
STEMS = range(3, 8)

WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"[.!?\n]+")


def word_features(word: str) -> list[str]:
    """A word and its beginnings, these marked by a star."""
    return [word, *(word[:n] + "*" for n in STEMS if n <= len(word))]


def text_features(words: set[str]) -> set[str]:
    return {f for w in words for f in word_features(w)}


def fold(key: Column) -> Column:
    """True for held-out rows: crc32 of the id as text is divisible by 5. A null id is never learned from."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(True))


def swaps(kinds=IDENTITY) -> dict[str, list[str]]:
    """Each identity term with what may stand for it."""
    found: dict[str, list[str]] = {}
    for kind in kinds:
        for term in kind[1:]:
            found.setdefault(term, []).extend(t for t in kind if t != term and t not in found.get(term, []))
    return found


def counterfactuals(text: str, others: dict[str, list[str]]) -> Iterator[tuple[set[str], set[str]]]:
    """Words of each sentence with an identity term, and words of the same sentence with the term swapped."""
    for sentence in SENTENCE.split(text.lower()):
        words = set(WORD.findall(sentence))
        for term in sorted(words.intersection(others)):
            for other in others[term]:
                yield words, words - {term} | {other}


@dataclass
class Model:
    """Weight of each word or word beginning that occurs in a text, and a bias."""

    weights: dict[str, float]
    bias: float

    def scorer(self) -> Callable[[str], float]:
        """A function of a text that remembers which features its words have."""
        known: dict[str, tuple[str, ...]] = {}

        def score(text: str) -> float:
            if len(known) > MEMORY_WORDS:
                known.clear()
            found: set[str] = set()
            for word in set(WORD.findall(text.lower())):
                features = known.get(word)
                if features is None:
                    features = known[word] = tuple(f for f in word_features(word) if f in self.weights)
                if features:
                    found.update(features)
            # Summed in the order of the features, so that equal texts have equal scores to the last bit.
            z = self.bias + sum(self.weights[f] for f in sorted(found))
            return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))

        return score


def choose_words(counts: pd.DataFrame, positives: int, negatives: int, size: int) -> list[str]:
    """The words whose share of texts differs most between the classes, in standard errors."""
    a, b = counts["pos"].to_numpy(float), counts["neg"].to_numpy(float)
    pooled = (a + b + 1) / (positives + negatives + 2)
    error = np.sqrt(pooled * (1 - pooled) * (1 / (positives + 1) + 1 / (negatives + 1)))
    z = (a / max(1, positives) - b / max(1, negatives)) / error
    order = np.lexsort((counts["word"].to_numpy(), -np.abs(z)))
    return [counts["word"].iloc[i] for i in order[:size] if abs(z[i]) > 3]


def train(rows: list[np.ndarray], labels: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], size: int, l2: float = 0.3,
          counterfactual: float = 4.0, steps: int = 600, times: np.ndarray | None = None) -> np.ndarray:
    """Weights of ``size`` words and the bias, by gradient descent with momentum on the penalised loss.

    A pair counts as often as ``times`` says, or once.

    The bias stays at the log odds of the labels. Were it learned, it would sink
    while the words of texts with several abusive ones share the credit, and a text
    with a single one would pass.
    """
    n = max(1, len(rows))
    cols = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    change = [(np.setdiff1d(a, b), np.setdiff1d(b, a)) for a, b in pairs]
    change_cols = np.concatenate([np.concatenate(c) for c in change] + [np.zeros(0, np.int64)]).astype(np.int64)
    change_sign = np.concatenate([np.concatenate([np.ones(len(a)), -np.ones(len(b))]) for a, b in change] + [np.zeros(0)])
    change_owner = np.repeat(np.arange(len(change)), [len(a) + len(b) for a, b in change])
    share = np.ones(len(change)) if times is None else np.asarray(times, float)
    share = share / max(1.0, share.sum())
    w, speed = np.zeros(size + 1), np.zeros(size + 1)
    w[-1] = np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5))
    scale = np.zeros(size + 1)
    for _ in range(steps):
        z = np.bincount(owner, w[cols], len(rows)) + w[-1]
        slope = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels
        grad = np.append(np.bincount(cols, slope[owner], size) / n + l2 / n * w[:-1], 0.0)
        if len(change):
            gap = share * np.bincount(change_owner, w[change_cols] * change_sign, len(change))
            grad[:-1] += counterfactual * np.bincount(change_cols, gap[change_owner] * change_sign, size)
        # Each word has a step of its own, as rare words have small gradients.
        scale = 0.95 * scale + 0.05 * grad**2
        speed = 0.9 * speed + 0.1 * grad
        w -= 0.05 * speed / (np.sqrt(scale) + 1e-8)
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE,
        vocabulary: int = VOCABULARY, kinds=IDENTITY, counterfactual: float = 4.0) -> Model:
    """A model from the labelled rows outside the held-out fold; without any, every score is 0.5 or less.

    At most ``sample`` labelled ids are learned from, each with one text, however
    often it is repeated; its label is the largest it has.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~fold(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("key")).agg(F.max(label_col).cast("int").alias("label"))
    drawn = known.orderBy(F.xxhash64("key"), "key").limit(sample)  # a bounded sample, so it may be broadcast
    texts = docs.select(F.col(id_col).alias("key"), F.coalesce(text_col, F.lit("")).alias("text"))
    # Of an id that is there more than once, the text with the smallest hash: the sample has as many rows as ids.
    one = texts.join(F.broadcast(drawn), "key").groupBy("key").agg(F.max("label").alias("label"), F.min(F.struct(F.xxhash64("text"), "text")).alias("t"))
    rows = cut_lineage(one.select("label", F.col("t.text").alias("text")))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = (Counter(), Counter())
        for batch in batches:
            for label, text in zip(batch["label"], batch["text"], strict=True):
                seen[label > 0].update(text_features(set(WORD.findall(text.lower()))))
        words = sorted(seen[0].keys() | seen[1].keys())
        yield pd.DataFrame({"word": pd.Series(words, dtype=object), "pos": [seen[1][w] for w in words], "neg": [seen[0][w] for w in words]})

    totals = rows.agg(F.sum(F.when(F.col("label") > 0, 1)).alias("p"), F.count(F.lit(1)).alias("n")).first()
    positives, rest = int(totals["p"] or 0), int(totals["n"]) - int(totals["p"] or 0)
    counted = rows.mapInPandas(count, "word string, pos long, neg long").groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # The score of a word, as choose_words has it, ranks them where they are; a bounded number comes to the driver.
    share = F.abs(F.col("pos") / max(1, positives) - F.col("neg") / max(1, rest)) / F.sqrt((F.col("pos") + F.col("neg") + 1) / F.lit(positives + rest + 2))
    common = counted.where("pos + neg >= 5").orderBy(share.desc(), "word").limit(4 * vocabulary).toPandas()
    words = choose_words(common, positives, rest, vocabulary)
    words += sorted({t for kind in kinds for t in kind} - set(words))
    place = {w: i for i, w in enumerate(words)}
    others = swaps(kinds)

    def index(found) -> bytes:
        return np.array(sorted(place[w] for w in place.keys() & text_features(set(found))), "<i4").tobytes()

    def differing(a: bytes, b: bytes) -> tuple[bytes, bytes]:
        own, other = np.frombuffer(a, "<i4"), np.frombuffer(b, "<i4")
        return np.setdiff1d(own, other).tobytes(), np.setdiff1d(other, own).tobytes()

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"label": batch["label"], "words": [index(WORD.findall(t.lower())) for t in batch["text"]]})

    def swapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            met = Counter(differing(index(a), index(b)) for t in batch["text"] for a, b in counterfactuals(t, others))
            yield pd.DataFrame({"a": [a for a, _ in met], "b": [b for _, b in met], "n": list(met.values())})

    def ints(v: bytes) -> np.ndarray:
        return np.frombuffer(v, "<i4").astype(np.int64)

    seen = rows.mapInPandas(features, "label int, words binary").toPandas().sort_values(["label", "words"])
    # All pairs, as one row for each difference of features; in a fixed order, so that sums are the same in every run.
    pairs = rows.mapInPandas(swapped, "a binary, b binary, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).toPandas()
    pairs = pairs.sort_values(["a", "b"])
    w = train([ints(c) for c in seen["words"]], (seen["label"] > 0).to_numpy(float), [(ints(a), ints(b)) for a, b in zip(pairs["a"], pairs["b"], strict=True)],
              len(words), counterfactual=counterfactual, times=pairs["n"].to_numpy(float))
    return Model({word: float(v) for word, v in zip(words, w, strict=False) if v}, float(w[-1]))


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text; a null or empty text has the score of the bias alone."""

    # A worker keeps the words it has met for as long as it scores by the same model.
    key = f"toxicity {uuid.uuid4()}"

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        scorer = kept_in_worker(key, model.scorer)
        return pd.Series([scorer(t or "") for t in texts], dtype="float64")

    return docs.withColumn(out, scores(F.col(text_col)))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not call toxic, with exactly their columns.

    Null and empty texts stay unless most labelled rows are toxic. Repeated rows,
    null ids and extra columns change nothing; an empty table gives an empty one.
    """
    name = free_name(docs, "_score")
    return score(docs, model, text_col, name).where(F.col(name) < 0.5).select(*[docs[c] for c in docs.columns])


@query()
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its score; learned from labelled rows outside the held-out fold."""
    docs = table(spark, folder, "documents")
    scored = score(docs.select("doc_id", "text"), fit(docs, table(spark, folder, "labels")))
    return scored.select(
        "doc_id", fold(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
