"""Operator 2, quality rules by distribution divergence.

Each document's histograms of character classes and of common words are compared with references of every language in
the corpus by Jensen-Shannon distance (base 2, so 0 to 1). Short documents are guarded: below a minimum length a
histogram says little, so its test is skipped.

Four passes over the whole table, none of which shuffles texts:

1. Per language, the mean character-class histogram and the words that are locally frequent. A word that makes up at
   least `min_share` of a language's words must pass a quarter of that share often enough, so what is kept here holds
   every such word, and there are at most 4 / (3 * min_share) of them a language.
2. Exact counts of these candidates. The `top_words` most frequent ones, and "any other word", form the word histogram.
3. Per language, the scale of the word distance: a text without any common word has a fixed distance (0.38 where they make
   up 27 % of the words), while that of a plain text falls with its length. So the squared distance is set against what
   its language's documents have at that length: a base (their median beyond sampling noise) plus the noise, which is
   common words / (8 ln 2 * words). A document whose ratio lies `word_spread` deviations above the median is strange.
   Both come from quartiles over all documents, copies counted once, so up to a quarter of odd ones do not move them much.
4. Base counts, distances and the verdict of each document.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.llm.common import STAGE_BYTES, cut_lineage, slices, small_batches, texts, window_hashes, word_hashes


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    #: Share of a language's words from which a word counts as common, and how many common words a histogram has.
    min_share: float = 0.002
    top_words: int = 32
    #: A language is a reference only with so many words.
    reference_words: int = 2000
    #: Length guards: code points in words for the class test, words for the word test.
    class_chars: int = 200
    word_words: int = 40
    max_class_distance: float = 0.30
    max_word_distance: float = 0.45
    #: Deviations above the median from which a language's word distance is strange, by so many documents at least.
    word_spread: float = 5.0
    scale_docs: int = 20


#: Classes of UTF-8 bytes: 0 lower case, 1 upper case, 2 digit, 3 blank, 4 sentence punctuation, 5 other ASCII,
#: 6 first byte of a character beyond ASCII, 7 (left out) its other bytes.
N_CLASSES = 7


def _byte_classes() -> np.ndarray:
    kind = np.full(256, 5)
    kind[ord("a") : ord("z") + 1] = 0
    kind[ord("A") : ord("Z") + 1] = 1
    kind[ord("0") : ord("9") + 1] = 2
    kind[[9, 10, 11, 12, 13, 32]] = 3
    kind[[ord(c) for c in ".,;:?!'\"()-"]] = 4
    kind[0x80:0xC0] = 7
    kind[0xC0:] = 6
    return kind


_CLASS_OF = np.eye(8)[_byte_classes()][:, :N_CLASSES]
_BLANKS = [9, 10, 11, 12, 13, 32]
_SYMBOLS = [ord(c) for c in "#*$%&|<>"]


def _byte_counts(data: list[bytes]) -> np.ndarray:
    return np.stack([np.bincount(np.frombuffer(x, np.uint8), minlength=256) for x in data]) if data else np.zeros((0, 256), np.int64)


def _shares(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(axis=-1, keepdims=True), 1)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (square root of the divergence in bits) along the last axis."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=-1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=-1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def repeated_words(hashes: np.ndarray, window: int) -> int:
    """Words that lie in a window of `window` words found twice or more in the text."""
    codes = window_hashes(hashes, window)
    if len(codes) < 2:
        return 0
    ordered = np.sort(codes)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    _, inverse, counts = np.unique(codes, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    edges = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def duplicate_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def _profile(rules: QualityRules):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(N_CLASSES + 2))
        found: dict[tuple[str, bytes], int] = Counter()
        for batch in slices(batches, STAGE_BYTES):
            groups: dict[str, list[bytes]] = defaultdict(list)
            for lang, text in zip(batch.column("lang").to_pylist(), texts(batch), strict=True):
                if text:
                    groups[lang or ""].append(text)
            for lang, data in groups.items():
                words = Counter()
                long = []
                for text in data:
                    cut = text.lower().split()
                    words.update(cut)
                    if len(cut) >= rules.min_words:
                        long.append(text)
                shares = _shares(_byte_counts(long) @ _CLASS_OF)
                total = words.total()
                classes[lang] += np.concatenate([shares.sum(axis=0), [len(long), total]])
                least = rules.min_share / 4 * total
                for word, n in words.items():
                    if n >= least:
                        found[lang, word] += n
        rows = [(lang, None, v.tolist(), 0) for lang, v in classes.items()] + [(lang, w, None, n) for (lang, w), n in found.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.list_(pa.float64())), pa.array([r[3] for r in rows], pa.int64())],
            ["lang", "word", "classes", "n"],
        )

    return run


def _count(candidates: dict[str, set[bytes]]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[str, bytes], int] = Counter()
        for batch in slices(batches, STAGE_BYTES):
            words: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(batch.column("lang").to_pylist(), texts(batch), strict=True):
                if text and (lang or "") in candidates:
                    words[lang or ""].update(text.lower().split())
            for lang, counts in words.items():
                for word in candidates[lang]:
                    totals[lang, word] += counts.get(word, 0)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in totals], pa.string()), pa.array([k[1] for k in totals], pa.binary()), pa.array(list(totals.values()), pa.int64())], ["lang", "word", "n"])

    return run


def _word_ratios(references: dict[str, dict], rules: QualityRules):
    """Words and squared word distance to its own language of each document that the word test judges."""
    places = {lang: {w: i for i, w in enumerate(one["words"])} for lang, one in references.items()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, STAGE_BYTES):
            rows: dict[str, list] = defaultdict(list)
            for lang, text in zip(batch.column("lang").to_pylist(), texts(batch), strict=True):
                if text and (lang or "") in places:
                    words = text.lower().split()
                    if len(words) >= rules.word_words:
                        at, other = places[lang or ""], len(places[lang or ""])
                        rows[lang or ""].append(np.bincount(np.fromiter(map(at.get, words, repeat(other)), np.int64, len(words)), minlength=other + 1))
            for lang, counts in rows.items():
                counts = np.array(counts)
                squared = js_distance(_shares(counts), references[lang]["shares"]) ** 2
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(counts.sum(axis=1), pa.int64()), pa.array(squared)], ["lang", "n", "squared"])

    return run


def _noise(one: dict) -> float:
    """The expected squared distance of a sample from its own reference, times its words."""
    return len(one["words"]) / (8 * np.log(2))


def _add_scales(docs: DataFrame, references: dict[str, dict], rules: QualityRules) -> None:
    """Gives each language with enough documents the `base` and `limit` of its word distance."""
    worded = {lang: one for lang, one in references.items() if one["words"]}
    if not worded:
        return
    found = cut_lineage(docs.mapInArrow(_word_ratios(worded, rules), "lang string, n long, squared double").distinct())
    noise = F.element_at(F.create_map(*[F.lit(x) for lang, one in worded.items() for x in (lang, float(_noise(one)))]), F.col("lang")) / F.col("n")
    bases = {r["lang"]: max(r["base"], 0.0) for r in found.groupBy("lang").agg(F.percentile_approx(F.col("squared") - noise, 0.5, 10_000).alias("base"), F.count("*").alias("docs")).where(F.col("docs") >= rules.scale_docs).collect()}
    if not bases:
        return
    base = F.element_at(F.create_map(*[F.lit(x) for pair in bases.items() for x in pair]), F.col("lang"))
    ratio = F.col("squared") / (base + noise)
    for row in found.where(F.col("lang").isin(list(bases))).groupBy("lang").agg(F.percentile_approx(ratio, [0.5, 0.75], 10_000).alias("q")).collect():
        middle, upper = row["q"]
        # A normal distribution's third quartile lies 0.6745 deviations above its median.
        references[row["lang"]] |= {"base": bases[row["lang"]], "limit": middle + rules.word_spread * (upper - middle) / 0.6745}


def language_references(docs: DataFrame, rules: QualityRules = QualityRules()) -> dict[str, dict]:
    """Per language (null: the empty string) its class histogram, common words, their shares and the scale of distances.

    Languages with fewer than `reference_words` words are left out; an empty table has no reference. What comes to the
    driver is bounded by the number of languages times 4 / (3 * min_share) words.
    """
    docs = docs.select("lang", "text")
    profile = docs.mapInArrow(_profile(rules), "lang string, word binary, classes array<double>, n long")
    sums = profile.where("word IS NULL").groupBy("lang").agg(*[F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(N_CLASSES + 2)])
    candidates = profile.where("word IS NOT NULL").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    total = F.col(f"c{N_CLASSES + 1}")
    kept = sums.where(total >= rules.reference_words).join(candidates.withColumnRenamed("lang", "of"), F.col("lang") == F.col("of"), "left")
    kept = kept.where(F.col("n").isNull() | (F.col("n") >= 0.75 * rules.min_share * total))
    references: dict[str, dict] = {}
    for row in kept.collect():
        c = np.array([row[f"c{i}"] for i in range(N_CLASSES + 2)])
        one = references.setdefault(row["lang"], {"classes": c[:N_CLASSES] / max(c[N_CLASSES], 1), "total": c[-1], "candidates": set()})
        if row["word"] is not None:
            one["candidates"].add(bytes(row["word"]))
    wanted = {lang: one["candidates"] for lang, one in references.items() if one["candidates"]}
    if wanted:
        exact = docs.mapInArrow(_count(wanted), "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
        counts: dict[str, list] = defaultdict(list)
        for row in exact.collect():
            if row["n"] >= rules.min_share * references[row["lang"]]["total"]:
                counts[row["lang"]].append((-row["n"], bytes(row["word"])))
        for lang, found in counts.items():
            top = sorted(found)[: rules.top_words]
            shares = np.array([-n for n, _ in top]) / references[lang]["total"]
            references[lang] |= {"words": [w for _, w in top], "shares": np.append(shares, 1 - shares.sum())}
    references = {lang: {"words": [], "shares": np.ones(1), "base": 0.0, "limit": np.inf} | {k: v for k, v in one.items() if k != "candidates"} for lang, one in sorted(references.items())}
    _add_scales(docs, references, rules)
    return references


_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, nearest_lang string, class_distance double, word_distance double"


def _assess(references: dict[str, dict], rules: QualityRules):
    langs = list(references)
    vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for one in references.values() for w in one["words"]}))}
    columns = [np.array([vocabulary[w] for w in references[x]["words"]], np.int64) for x in langs]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, STAGE_BYTES):
            data = [x or b"" for x in texts(batch)]
            by_byte = _byte_counts(data)
            n_words, lines, repeats = [], [], []
            common = np.zeros((len(data), len(vocabulary) + 1))
            for i, text in enumerate(data):
                words = text.split()
                n_words.append(len(words))
                lines.append(duplicate_lines(text))
                repeats.append(repeated_words(word_hashes(words), rules.window) if len(words) > rules.window else 0)
                if words:
                    known = text.lower().split()
                    common[i] = np.bincount(np.fromiter(map(vocabulary.get, known, repeat(0)), np.int64, len(known)), minlength=len(vocabulary) + 1)
            n, rep = np.array(n_words), np.array(repeats)
            starts = by_byte[:, :0x80].sum(axis=1) + by_byte[:, 0xC0:].sum(axis=1)
            chars = starts - by_byte[:, _BLANKS].sum(axis=1)
            failed = (n < rules.min_words) | (100 * rep > rules.max_repeat_percent * n)
            shares = _shares(by_byte @ _CLASS_OF)
            by_class, by_word, limits = (np.zeros((len(langs), len(data))) for _ in range(3))
            for k, lang in enumerate(langs):
                one = references[lang]
                by_class[k] = js_distance(shares, one["classes"])
                seen = common[:, columns[k]]
                by_word[k] = js_distance(_shares(np.column_stack([seen, n - seen.sum(axis=1)])), one["shares"])
                # A base of 0 and no common words: nothing to compare.
                limits[k] = np.sqrt(one["limit"] * np.maximum(one["base"] + _noise(one) / np.maximum(n, 1), 1e-12))
            if langs:
                best = (by_class + by_word).argmin(axis=0)
                rows = np.arange(len(data))
                d_class, d_word, limit = by_class[best, rows], by_word[best, rows], np.minimum(limits[best, rows], rules.max_word_distance)
            else:
                best, d_class, d_word, limit = None, *(np.zeros(len(data)) for _ in range(3))
            strange = (d_class > rules.max_class_distance) & (chars >= rules.class_chars) | (d_word > limit) & (n >= rules.word_words)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(chars, pa.int64()), pa.array(by_byte[:, _SYMBOLS].sum(axis=1), pa.int64()), pa.array(lines, pa.int64()), pa.array(rep, pa.int64()),
                    pa.array(failed), pa.array(~failed & ~strange), pa.array([langs[b] for b in best] if best is not None else [None] * len(data), pa.string()), pa.array(d_class), pa.array(d_word),
                ],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "nearest_lang", "class_distance", "word_distance"],
            )

    return run


def assess_quality(docs: DataFrame, rules: QualityRules = QualityRules(), references: dict[str, dict] | None = None) -> DataFrame:
    """One row per document with its base counts, distances to the nearest language reference and the verdict `kept`.

    Null and empty texts have no words and fail the base rules. Repeated rows are judged one by one and alike. With no
    reference (empty table, or too little text in every language) only the base rules decide. Other columns of `docs`
    are not read.
    """
    small_batches(docs.sparkSession, STAGE_BYTES)
    references = language_references(docs, rules) if references is None else references
    return docs.select("doc_id", "text").mapInArrow(_assess(references, rules), _SCHEMA)


def keep_quality(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of `docs`, all columns, that the rules keep; each row is judged where it lies, so nothing is shuffled.

    Null and empty texts go, as they have too few words. Repeated rows are judged alike. An empty table stays empty, and
    other columns may have any names.
    """
    small_batches(docs.sparkSession, STAGE_BYTES)
    judge = _assess(language_references(docs, rules), rules)
    names = docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, STAGE_BYTES):
            kept = pa.concat_arrays([v.column("kept") for v in judge([batch.select(["doc_id", "text"])])])
            yield batch.filter(kept).select(names)

    return docs.mapInArrow(run, docs.schema)
