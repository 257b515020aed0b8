"""A language detector trained on labelled texts: character n-grams of words, counted by aggregation, with a posterior.

A word counts with a space on either side; its n-grams are runs of one to ``LONGEST`` characters. Training counts distinct
words of each language over all rows, and n-grams of these, so nothing is shuffled once per occurrence. A text's score in
a language is the sum of its n-grams' smoothed log-probabilities, divided by ``LONGEST`` as every character is in about so
many of them; the posterior is over the model's languages, equally likely beforehand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tidewell.functions import text as texts
from tidewell.session import materialise, ship

LONGEST, SMOOTHING = 3, 0.5
#: N-grams that a model keeps of each language, the most frequent ones.
MOST_GRAMS = 20_000
#: Below this posterior a text has no label.
MIN_CONF, MIN_LEN, MIN_ALPHA = 0.65, 24, 8

_WORD = r"\p{L}+"


def words_of(text: Column) -> Column:
    """Words of the text without links and handles, in lower case."""
    return F.regexp_extract_all(F.lower(texts.strip_noise(text)), F.lit(_WORD), F.lit(0))


def grams_of(word: str, longest: int = LONGEST) -> list[str]:
    padded = f" {word} "
    return [padded[k : k + n] for n in range(1, longest + 1) for k in range(len(padded) - n + 1) if padded[k : k + n] != " "]


@dataclass(frozen=True)
class Model:
    """Log-probabilities by n-gram and language; ``unseen`` holds those of an n-gram that the model does not keep."""

    languages: tuple[str, ...]
    longest: int
    weights: dict[str, np.ndarray]
    unseen: np.ndarray

    def word(self, word: str) -> np.ndarray:
        """The sum of a word's n-grams, by language."""
        get, unseen = self.weights.get, self.unseen
        return sum((get(g, unseen) for g in grams_of(word, self.longest)), np.zeros(len(self.languages))) / self.longest

    def posterior(self, sums: np.ndarray) -> np.ndarray:
        """Posteriors from sums over words, row by row."""
        e = np.exp(sums - sums.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def train(rows: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, most: int = MOST_GRAMS, smoothing: float = SMOOTHING) -> Model:
    """Count over all of ``rows`` that have a language; the model keeps ``most`` n-grams of each, which bounds its size."""
    ship(rows.sparkSession)
    known = rows.filter(F.col(lang).isNotNull())
    words = known.select(F.col(lang).alias("lang"), F.explode(words_of(F.col(text))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [grams_of(w, longest) for w in batch.column(1).to_pylist()]
            sizes = np.fromiter(map(len, grams), np.int64, len(grams))
            at = pa.array(np.repeat(np.arange(len(grams)), sizes))
            flat = pa.array([g for own in grams for g in own], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), flat, batch.column(2).take(at)], ["lang", "gram", "n"])

    grams = words.mapInArrow(split, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams = materialise(grams, "grams")
    totals = {r["lang"]: r["total"] for r in grams.groupBy("lang").agg(F.sum("n").alias("total")).collect()}
    languages = tuple(sorted(totals))
    kept = [grams.filter(F.col("lang") == own).orderBy(F.desc("n"), "gram").limit(most) for own in languages]
    counts: dict[str, np.ndarray] = {}
    for k, own in enumerate(kept):
        for r in own.collect():  # at most ``most`` rows
            counts.setdefault(r["gram"], np.zeros(len(languages)))[k] = r["n"]
    size = np.array([totals[x] for x in languages], float) + smoothing * max(1, len(counts))
    return Model(languages, longest, {g: np.log((c + smoothing) / size) for g, c in counts.items()}, np.log(smoothing / size))


def detect(rows: DataFrame, model: Model, text: str = "text", min_len: int = MIN_LEN, min_alpha: int = MIN_ALPHA, min_conf: float = MIN_CONF) -> DataFrame:
    """``rows`` with ``detected`` (the likeliest language) and ``confidence`` (its posterior).

    Both are null for texts that are too short once links and handles are gone, or have too few letters; ``detected``
    alone is null below ``min_conf``. Columns of these names are replaced.
    """
    spark = rows.sparkSession
    ship(spark)
    kept = rows.drop("detected", "confidence")
    enough = F.coalesce(texts.language_gate(F.col(text), min_len, min_alpha), F.lit(False))
    own = kept.withColumn("_words", F.when(enough, words_of(F.col(text))))
    shared = spark.sparkContext.broadcast(model)
    schema = kept.schema.add("detected", "string").add("confidence", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = pa.array(model.languages, pa.string())
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            has = np.asarray(pc.fill_null(pc.greater(pc.list_value_length(lists), 0), False)) & (len(names) > 0)
            best, sure = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            if has.any():
                row = np.asarray(pc.list_parent_indices(lists))
                coded = pc.list_flatten(lists).dictionary_encode()
                vectors = np.array([model.word(w) for w in coded.dictionary.to_pylist()])  # each distinct word once
                code = coded.indices.to_numpy(zero_copy_only=False)
                sums = np.stack([np.bincount(row, vectors[code, k], batch.num_rows) for k in range(len(names))], axis=1)
                posterior = model.posterior(sums)
                best, sure = posterior.argmax(axis=1), posterior.max(axis=1)
            detected = names.take(pa.array(best, mask=~has | (sure < min_conf))) if len(names) else pa.nulls(batch.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], detected, pa.array(sure, pa.float64(), mask=~has)], schema.names)

    return own.mapInArrow(run, schema)


def labeller(model: Model, english: str = "en", **limits: float) -> Callable[[DataFrame], DataFrame]:
    """A function for ``incremental.label_stream`` and its like: ``(post_id, is_en)`` of posts; null where the detector abstains."""

    def label(posts: DataFrame) -> DataFrame:
        return detect(posts.select("post_id", "text"), model, **limits).select("post_id", (F.col("detected") == english).alias("is_en"))

    return label
