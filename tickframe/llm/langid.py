"""Operator 1, language identification by nearest centroid.

Texts become normalised TF-IDF vectors of hashed byte n-grams of their letters (orders 1 to 3, lower case). Each language has several
centroids, found by spherical k-means, and a text belongs to the language of the centroid with the largest cosine. If
even that is below the distance within which nearly all training texts of the centroid lie, the text is marked rejected.

Fitting uses a bounded sample (a documented parameter): rows whose hash lies below a language's own limit, set so that
`sample` of its training rows are expected there (all, if it has fewer). Training rows are only counted by language, so
no language's rows meet in one task, but for its sample. Prediction is one pass over the table without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.llm.common import cut_lineage, remainder, slices, small_batches, texts

UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Centroids:
    dimension: int = 4096
    clusters: int = 3
    sample: int = 1500
    steps: int = 8
    #: Share of a centroid's training texts that lie beyond its rejection distance.
    beyond: float = 0.005


@dataclass
class Model:
    langs: list[str]
    vectors: np.ndarray
    least: np.ndarray
    idf: np.ndarray


def ngram_counts(text: bytes, dimension: int) -> np.ndarray:
    """Counts of hashed byte n-grams of orders 1 to 3 of a text framed by blanks."""
    data = np.frombuffer(b" " + text + b" ", np.uint8).astype(np.uint32)
    codes, total = np.zeros(len(data), np.uint32), np.zeros(dimension, np.int64)
    for order in (1, 2, 3):
        codes = (codes[: len(data) - order + 1] << np.uint32(8)) | data[order - 1 :]
        mixed = (codes + np.uint32(order)) * np.uint32(2654435761)
        total = total + np.bincount((mixed ^ (mixed >> np.uint32(15))) % np.uint32(dimension), minlength=dimension)
    return total


#: Only letters tell languages: other ASCII characters are blanks, and runs of them one.
_LETTERS_ONLY = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def _lower(text: bytes) -> bytes:
    lowered = text.lower() if text.isascii() else text.decode().lower().encode()
    return b" ".join(lowered.translate(_LETTERS_ONLY).split())


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    rows = np.log1p(counts) * idf
    return rows / np.maximum(np.linalg.norm(rows, axis=-1, keepdims=True), 1e-12)


def _features(dimension: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [ngram_counts(_lower(t or b""), dimension).astype(np.float32).tobytes() for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("pick"), pa.array(rows, pa.binary())], ["lang", "pick", "counts"])

    return run


def _cluster(settings: Centroids, idf: np.ndarray):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["pick", "counts"])
        rows = weighted(np.stack([np.frombuffer(c, np.float32) for c in group["counts"]]), idf).astype(np.float32)
        # Farthest-first start from the mean; empty clusters vanish.
        centres = [rows.mean(axis=0)]
        while len(centres) < min(settings.clusters, len(rows)):
            centres.append(rows[(rows @ np.stack(centres).T).max(axis=1).argmin()])
        vectors = np.stack(centres)
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        for _ in range(settings.steps):
            own = (rows @ vectors.T).argmax(axis=1)
            vectors = np.stack([rows[own == k].mean(axis=0) for k in range(len(vectors)) if (own == k).any()])
            vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        cosines = rows @ vectors.T
        own = cosines.argmax(axis=1)
        out = [(group["lang"].iloc[0], v.astype(np.float32).tobytes(), float(np.quantile(cosines[own == k, k], settings.beyond))) for k, v in enumerate(vectors) if (own == k).any()]
        return pd.DataFrame(out, columns=["lang", "vector", "least"])

    return run


def fit_languages(rows: DataFrame, settings: Centroids = Centroids()) -> Model:
    """Centroids from training rows (doc_id, lang, text); null and blank texts and null languages are left out.

    The driver gets languages x clusters vectors of `dimension` floats, one count a language and one a dimension.
    """
    small_batches(rows.sparkSession)
    usable = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text", F.xxhash64(F.lit("lang"), "doc_id").alias("pick"))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return Model([], np.zeros((0, settings.dimension)), np.zeros(0), np.ones(settings.dimension))
    place = F.pmod("pick", F.lit(1 << 62)) / F.lit(float(1 << 62))
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, settings.sample / n))]), F.col("lang"))
    sample = cut_lineage(usable.where(place < share).select("lang", "pick", "text").mapInArrow(_features(settings.dimension), "lang string, pick long, counts binary"))

    def document_frequency(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(settings.dimension, np.int64), 0
        for batch in batches:
            for counts in batch.column("counts").to_pylist():
                seen += np.frombuffer(counts, np.float32) > 0
                n += 1
        held = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held, -1)), pa.array(np.append(seen[held], n))], ["dimension", "n"])

    seen = {r["dimension"]: r["n"] for r in sample.mapInArrow(document_frequency, "dimension long, n long").groupBy("dimension").agg(F.sum("n").alias("n")).collect()}
    idf = np.log((1 + seen.get(-1, 0)) / (1 + np.array([seen.get(i, 0) for i in range(settings.dimension)]))) + 0.1
    found = sorted(sample.groupBy("lang").applyInPandas(_cluster(settings, idf), "lang string, vector binary, least double").collect(), key=lambda r: (r["lang"], bytes(r["vector"])))
    return Model([r["lang"] for r in found], np.stack([np.frombuffer(r["vector"], np.float32) for r in found]), np.array([r["least"] for r in found]), idf)


def predict_languages(docs: DataFrame, model: Model, settings: Centroids = Centroids(), held_out: Column | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, lang_pred, score, rejected.

    lang_pred is `und` (score 0, rejected) where the text is null or has no letter, and where nothing was learned.
    score is the cosine of the nearest centroid. Languages, sources and ids play no part in it.
    """
    dimension = settings.dimension

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data = texts(batch)
            named, scores, rejected = [UNDETERMINED] * len(data), np.zeros(len(data)), np.ones(len(data), bool)
            usable = [i for i, t in enumerate(data) if t and model.langs and _LETTER.search(t.decode())]
            for start in range(0, len(usable), 256):
                some = usable[start : start + 256]
                rows = weighted(np.stack([ngram_counts(_lower(data[i]), dimension) for i in some]), model.idf)
                cosines = rows @ model.vectors.T
                for i, k, c in zip(some, cosines.argmax(axis=1), cosines.max(axis=1), strict=True):
                    named[i], scores[i], rejected[i] = model.langs[k], min(max(c, 0.0), 1.0), c < model.least[k]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(named, pa.string()), pa.array(scores), pa.array(rejected)], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.lit(False) if held_out is None else held_out, F.lit(False)).alias("held_out"), "text")
    return marked.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def identify_languages(docs: DataFrame, settings: Centroids = Centroids()) -> DataFrame:
    """Fits on rows whose crc32(doc_id) mod 3 is not 1 (a null id takes no part) and predicts all rows."""
    fold = remainder("doc_id", 3)
    return predict_languages(docs, fit_languages(docs.where(fold != 1), settings), settings, fold == 1)
