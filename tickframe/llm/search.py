"""Operator 7, exact top-k BM25 search over inverted indexes with block-max pruning (MaxScore; README: why not WAND).

Texts are cut into terms once, and their terms kept as bytes in the shared folder. Documents are then searched where their
terms are read: each task gathers up to `shard` documents, parts them into groups of alike ones, builds an inverted index
a group and answers all queries of a block from it. Statistics (documents, lengths, document frequencies) are those of the
whole table, and impacts are fixed-point numbers, so scores from different shards add up exactly and merge exactly.

A query's rare terms are added up first, from their lists. Where the common terms, by their largest impacts in a block of
documents, cannot lift any document of the group over the k-th best score so far, the group is done; where they can lift a
few, only these are scored in full. For the rest the common terms of many queries are added at once, as a product of
matrices of 32-bit floats, and what may reach the k-th best score within their error is scored exactly. A group of alike
documents (texts of one language share their common terms) has more common terms of its own, and few queries outlive it.

Documents are searched in rounds by the hash of the row: first some `first_docs` of them in `first_tasks` tasks, then
`widen` times as many at a time until the table is through. Each round hands the k-th best (score, doc_id) of every query
to the next, which passes on only what beats it. As rows come in random order, a round passes on about k * `widen` rows a
query however many shards it has, where whole lists from every shard would grow with queries times shards.

Queries are handled in blocks of at most `block_terms` terms, so that what is broadcast has a fixed bound.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickframe.llm.common import cut_lineage, shared_folder, slices, small_batches, texts, word_hashes


@dataclass(frozen=True)
class Bm25:
    k: int = 10
    k1: float = 1.2
    b: float = 0.75
    #: A task searches so many documents at once, or those up to the one that brings them to so many postings, so that
    #: long texts make small shards: a posting takes some 50 bytes while its index is built, and 4 / dense_share in dense rows.
    shard: int = 12288
    shard_postings: int = 3_000_000
    docs_per_block: int = 64
    block_terms: int = 6_000_000
    #: Terms in so large a share of an index's documents have their impacts in rows of a dense matrix.
    dense_share: float = 0.1
    #: Queries whose common terms are added up together.
    together: int = 128
    #: From so many documents on a shard is parted into groups of alike ones.
    group_from: int = 4096
    first_docs: int = 8192
    first_tasks: int = 8
    widen: int = 8


#: Impacts are multiples of this, so sums of them are exact.
UNIT = 2.0**-24

#: Rows are placed by their hashes in this range; and the key of a null doc_id, which comes last.
_ROWS = 2**62
_NO_ID = 2**63 - 1


def _terms(text: bytes | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct term hashes, their counts, and the length in words."""
    hashes = word_hashes([w for w in (x.strip(b".,;:?!\"'()[]") for x in (text or b"").lower().split()) if w])
    terms, counts = np.unique(hashes, return_counts=True)
    return terms, counts, len(hashes)


def _query_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = [_terms(t)[0].view(np.int64) for t in texts(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("query_id"), pa.array(found, pa.list_(pa.int64()))], ["query_id", "terms"])


#: Documents as they are kept: words, distinct term hashes (64 bits each) and how often each of them occurs (32 bits each).
_STORED = "doc_id long, size long, terms binary, counts binary"


def _document_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = [_terms(t) for t in texts(batch)]
        columns = [[size for *_, size in found], [terms.tobytes() for terms, *_ in found], [counts.astype(np.uint32).tobytes() for _, counts, _ in found]]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()), strict=True)]], ["doc_id", "size", "terms", "counts"])


def _numbers(column: pa.Array, kind: type) -> np.ndarray:
    """The numbers of all values of a binary column, one after another."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _known(terms: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of terms in the vocabulary, and which of them are there."""
    if not len(vocabulary):
        return np.zeros(len(terms), np.int64), np.zeros(len(terms), bool)
    at = np.searchsorted(vocabulary, terms)
    at[at == len(vocabulary)] = 0
    return at, vocabulary[at] == terms


def _frequencies(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value["vocabulary"]
        seen, n, length = np.zeros(len(vocabulary), np.int64), 0, 0
        for batch in slices(batches):
            at, known = _known(_numbers(batch.column("terms"), np.uint64), vocabulary)
            seen += np.bincount(at[known], minlength=len(vocabulary))
            n, length = n + batch.num_rows, length + int(batch.column("size").to_numpy().sum())
        held = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held, [-1, -2])), pa.array(np.append(seen[held], [n, length]))], ["term", "n"])

    return run


class Shard:
    """An inverted index of some documents over a vocabulary, with the largest common impacts of every block of documents.

    Documents lie by group (`parts`, all as one if None). A term that is common in a group has its impacts there in a row of
    the group's matrix, as 32-bit floats, and not in its list. Impacts are held in units.
    """

    def __init__(self, rows: Sequence[tuple[np.ndarray, np.ndarray]], n_terms: int, settings: Bm25, parts: Sequence[np.ndarray] | None = None):
        self.rows, self.n, self.settings = rows, len(rows), settings
        step = settings.docs_per_block
        parts = [np.arange(self.n)] if parts is None else parts
        self.edges = np.concatenate([[0], np.cumsum([-(-len(p) // step) * step for p in parts])])
        self.width = width = int(self.edges[-1])
        #: The document at a place, -1 at the places that fill up a group's last block.
        self.doc_at = np.full(width, -1)
        for start, part in zip(self.edges, parts, strict=False):
            self.doc_at[start : start + len(part)] = part
        place = np.zeros(self.n, np.int64)
        place[self.doc_at[self.doc_at >= 0]] = np.flatnonzero(self.doc_at >= 0)
        key = np.concatenate([r[0] for r in rows]).astype(np.int64)
        key *= width
        key += np.repeat(place, [len(r[0]) for r in rows])
        order = np.argsort(key)
        key = key[order]
        units = np.concatenate([r[1] for r in rows])[order]
        del order
        units /= UNIT
        units = np.rint(units, out=units).astype(np.int64)
        terms, places = (key // width).astype(np.int32), (key % width).astype(np.int32)
        del key
        self.row_of, self.high, self.block_max = np.full((len(parts), n_terms), -1, np.int32), [], []
        listed = np.ones(len(terms), bool)
        for g, (start, stop, part) in enumerate(zip(self.edges[:-1], self.edges[1:], parts, strict=True)):
            inside = np.flatnonzero((places >= start) & (places < stop))
            common = np.flatnonzero(np.bincount(terms[inside], minlength=n_terms) >= max(settings.dense_share * len(part), 2))
            self.row_of[g, common] = np.arange(len(common))
            at_row = self.row_of[g, terms[inside]]
            inside, at_row = inside[at_row >= 0], at_row[at_row >= 0]
            listed[inside] = False
            high = np.zeros((len(common), stop - start), np.float32)
            high[at_row, places[inside] - start] = units[inside]
            self.high.append(high)
            self.block_max.append(high.reshape(len(common), (stop - start) // step, step).max(axis=2))
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(terms[listed], minlength=n_terms))])
        # A posting list a term, as bytes: Arrow takes many of them at a time by copying each as a whole.
        self.shift = width.bit_length()
        packed = units[listed] << self.shift | places[listed]
        self.lists = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n_terms, [None, pa.py_buffer(self.starts * 8), pa.py_buffer(packed)])
        # Memory that is used again is not asked for page by page.
        self.sums = np.empty((settings.together, width), np.float32)
        self.asked = np.zeros(n_terms, bool)

    def _listed(self, queries: Sequence[np.ndarray], out: np.ndarray) -> None:
        """Sums in units over the lists of the terms of each query, by place."""
        flat = np.concatenate(queries)
        sizes = self.starts[flat + 1] - self.starts[flat]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([len(q) for q in queries])].tolist()
        packed = np.frombuffer(self.lists.take(pa.array(flat[sizes > 0])).buffers()[2] or b"", np.int64)
        for row, start, stop in zip(out, [0, *ends], ends, strict=False):
            part = packed[start:stop]
            row[:] = np.bincount(part & ((1 << self.shift) - 1), weights=part >> self.shift, minlength=self.width) if start < stop else 0

    def _exact(self, query: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents at places, and their scores."""
        docs = self.doc_at[places]
        docs = docs[docs >= 0]
        found = [self.rows[d] for d in docs.tolist()]
        if not found:
            return docs, np.empty(0)
        terms, impacts = (np.concatenate(x) for x in zip(*found, strict=True))
        self.asked[query] = True
        scores = np.bincount(np.repeat(np.arange(len(docs)), [len(t) for t, _ in found]), weights=impacts * self.asked[terms], minlength=len(docs))
        self.asked[query] = False
        return docs, scores

    def tops(self, queries: Sequence[np.ndarray], floors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Number of a query, documents (as positions) and scores that may be among its k best of this shard and reach its floor;
        all that do, are there. A query comes once for each group that has any."""
        settings, step = self.settings, self.settings.docs_per_block
        k, width = settings.k, self.width
        at_once = max(1, min(settings.together, (1 << 17) // width))
        for first in range(0, len(queries), settings.together):
            part = queries[first : first + settings.together]
            lengths = np.array([len(q) for q in part])
            flat, of = np.concatenate(part), np.repeat(np.arange(len(part)), lengths)
            asked = [np.zeros((len(part), len(high)), np.float32) for high in self.high]
            for mine, row_of in zip(asked, self.row_of, strict=True):
                rows = row_of[flat]
                mine[of[rows >= 0], rows[rows >= 0]] = 1
            caps = np.concatenate([mine @ most for mine, most in zip(asked, self.block_max, strict=True)], axis=1)
            # A sum of m floats of 32 bits is off by a share of (m + 1) * 2^-24 at most; this is four times that.
            slack = 1 - (lengths + 8) * 2.0**-22
            least = floors[first : first + len(part)] / UNIT
            unknown = (least <= 0) & (self.n >= k)
            left: list[list[int]] = [[] for _ in self.high]
            for start in range(0, len(part), at_once):
                these = range(start, min(start + at_once, len(part)))
                sums = self.sums[these.start : these.stop]
                self._listed(part[these.start : these.stop], sums)
                for i in these:
                    if unknown[i]:
                        least[i] = np.partition(self.sums[i], width - k)[width - k] * slack[i]
                most = ((least * slack)[these.start : these.stop, None] - caps[these.start : these.stop]).astype(np.float32)
                live = sums.reshape(len(these), -1, step) >= most[:, :, None]
                counts = np.add.reduceat(np.count_nonzero(live, axis=2), self.edges[:-1] // step, axis=1)
                live = live.reshape(len(these), -1)
                for j, g in zip(*(x.tolist() for x in np.nonzero(counts)), strict=True):
                    if counts[j, g] > 2 * k:
                        left[g].append(start + j)
                    else:
                        yield first + start + j, *self._exact(part[start + j], self.edges[g] + np.flatnonzero(live[j, self.edges[g] : self.edges[g + 1]]))
            for g, mine in enumerate(left):
                lo, hi = self.edges[g], self.edges[g + 1]
                for i, total in zip(mine, asked[g][mine] @ self.high[g], strict=True):
                    total += self.sums[i, lo:hi]
                    if unknown[i] and hi - lo >= k:
                        least[i] = max(least[i], np.partition(total, -k)[-k] * slack[i])
                    found = np.flatnonzero(total >= np.float32(least[i] * slack[i]))
                    if len(found):
                        yield first + i, *self._exact(part[i], lo + found)

    def top(self, query: np.ndarray, floor: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """The same for one query, over all groups."""
        found = [(docs, scores) for _, docs, scores in self.tops([query], np.array([floor], float))]
        return tuple(np.concatenate(x) for x in zip((np.empty(0, np.int64), np.empty(0)), *found, strict=True))


def groups(rows: Sequence[tuple[np.ndarray, np.ndarray]], n_terms: int) -> list[np.ndarray]:
    """The documents (as positions) in groups that share their common terms, the largest group first.

    Centres are fitted to some documents by cosine over the 256 most common terms; alike centres are one group, so documents
    of one kind stay together. Which documents share a group has no bearing on results.
    """
    n, lengths = len(rows), [len(r[0]) for r in rows]
    terms = np.concatenate([r[0] for r in rows])
    held = np.bincount(terms, minlength=n_terms)
    top = np.argsort(-held, kind="stable")[:256]
    column = np.full(n_terms, -1)
    column[top] = np.arange(len(top))
    columns, docs = column[terms], np.repeat(np.arange(n), lengths)
    points = np.zeros((n, len(top)), np.float32)
    points[docs[columns >= 0], columns[columns >= 0]] = 1
    points /= np.sqrt(np.maximum(held[top], 1))  # so that a rarer term weighs more
    points /= np.maximum(np.linalg.norm(points, axis=1), 1e-9)[:, None]
    some = points[np.linspace(0, n - 1, min(n, 2048)).astype(int)]
    some = some[some.any(axis=1)]
    if not len(some):
        return [np.arange(n)]
    centres = some[np.linspace(0, len(some) - 1, min(len(some), 24)).astype(int)]
    for _ in range(4):
        nearest = (some @ centres.T).argmax(axis=1)
        centres = np.array([some[nearest == i].sum(axis=0) for i in np.unique(nearest)])
        centres /= np.linalg.norm(centres, axis=1)[:, None]
    alike, group = centres @ centres.T >= 0.5, np.arange(len(centres))
    for _ in centres:
        group = np.array([group[a].min() for a in alike])
    of = group[(points @ centres.T).argmax(axis=1)]
    sizes = np.bincount(of)
    of = np.where(sizes[of] < n / 32, sizes.argmax(), of)  # a group costs each query some time, however small
    return [np.flatnonzero(of == g) for g in np.argsort(-sizes, kind="stable") if (of == g).any()]


def _search(shared, bars, settings: Bm25):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        vocabulary, idf, average = plan["vocabulary"], plan["idf"], plan["average"]
        queries = np.split(plan["terms"], plan["ends"][:-1]) if len(plan["ends"]) else []
        least, last = bars.value[0].copy(), bars.value[1].copy()

        def answer(ids: list, rows: list) -> Iterator[pa.RecordBatch]:
            if not queries:
                return
            shard = Shard(rows, len(vocabulary), settings, groups(rows, len(vocabulary)) if len(rows) >= settings.group_from else None)
            keys = np.array([_NO_ID if i is None else i for i in ids])
            out_query, out_doc, out_score = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
            for q, found, scores in shard.tops(queries, least):
                better = (scores > least[q]) | (scores > 0) & (scores == least[q]) & (keys[found] < last[q])
                if not better.any():
                    continue
                found, scores = found[better], scores[better]
                best = np.lexsort((keys[found], -scores))[: settings.k]
                if len(best) == settings.k:
                    least[q], last[q] = scores[best[-1]], keys[found[best[-1]]]
                out_query.append(np.full(len(best), plan["ids"][q]))
                out_doc.append(found[best])
                out_score.append(scores[best])
            docs = np.concatenate(out_doc)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_query), pa.int64()), pa.array([ids[d] for d in docs], pa.int64()), pa.array(np.concatenate(out_score))], ["query_id", "doc_id", "score"])

        ids, rows, postings = [], [], 0
        for batch in slices(batches):
            lengths = np.array([len(t) // 8 for t in batch.column("terms").to_pylist()], np.int64)
            sizes = batch.column("size").to_numpy()
            at, known = _known(_numbers(batch.column("terms"), np.uint64), vocabulary)
            at, tf = at[known], _numbers(batch.column("counts"), np.uint32)[known].astype(np.int64)
            norm = np.repeat(settings.k1 * (1 - settings.b + settings.b * sizes / average), lengths)[known]
            impacts = np.rint(idf[at] * tf * (settings.k1 + 1) / (tf + norm) / UNIT) * UNIT
            ends = np.concatenate([[0], np.cumsum(known)])[np.cumsum(lengths)].tolist()
            at = at.astype(np.int32)
            for doc_id, start, stop in zip(batch.column("doc_id").to_pylist(), [0, *ends], ends, strict=False):
                ids.append(doc_id)
                rows.append((at[start:stop], impacts[start:stop]))
                postings += stop - start
                if len(ids) == settings.shard or postings >= settings.shard_postings:
                    yield from answer(ids, rows)
                    ids, rows, postings = [], [], 0
        if ids:
            yield from answer(ids, rows)

    return run


def search(docs: DataFrame, queries: DataFrame, settings: Bm25 = Bm25()) -> DataFrame:
    """The k best documents of each query: query_id, doc_id, rank, score.

    A query is its distinct terms: words in lower case (A-Z) without punctuation at both ends; a document matches if it
    holds one of them. Ties go to the smaller doc_id, a null doc_id last. Null and empty texts match nothing, and queries
    without a match have no rows. Of queries that share a query_id each adds its matches; null ids are left out. Texts of
    any length are read whole, and repeated rows are documents of their own. Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    asked = cut_lineage(queries.where("query_id IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), "text").mapInArrow(_query_terms, "query_id long, terms array<long>").where(F.size("terms") > 0))
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-total // settings.block_terms))
    path = f"{shared_folder(spark)}/terms-{uuid.uuid4().hex}"
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_document_terms, _STORED)
    own.withColumn("place", F.pmod(F.xxhash64("doc_id", "terms", "counts"), F.lit(_ROWS))).write.parquet(path)
    own = spark.read.schema(f"{_STORED}, place long").parquet(path)
    results = None
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).orderBy("query_id").toArrow()
        lists = part.column("terms").combine_chunks()
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        vocabulary = np.unique(flat)
        terms = np.searchsorted(vocabulary, flat).astype(np.int32)
        ids = part.column("query_id").to_numpy()
        del part, lists, flat
        names = spark.sparkContext.broadcast({"vocabulary": vocabulary})
        counts = own.select("size", "terms").mapInArrow(_frequencies(names), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        term, seen = counts.column("term").to_numpy(), counts.column("n").to_numpy()
        frequency, whole = np.zeros(len(vocabulary)), dict(zip(term[term < 0].tolist(), seen[term < 0].tolist(), strict=True))
        frequency[term[term >= 0]] = seen[term >= 0]
        n = whole.get(-1, 0)
        idf = np.log1p((n - frequency + 0.5) / (frequency + 0.5))
        plan = spark.sparkContext.broadcast({"vocabulary": vocabulary, "idf": idf, "average": max(whole.get(-2, 0) / max(n, 1), 1e-9), "terms": terms, "ends": np.cumsum(sizes), "ids": ids})
        found = _in_rounds(own, plan, ids, n, settings)
        results = found if results is None else results.unionByName(found)
    return results


def _in_rounds(docs: DataFrame, plan, ids: np.ndarray, n: int, settings: Bm25) -> DataFrame:
    """The k best of each query of a block, over all documents."""
    bounds = [min(_ROWS, _ROWS * settings.first_docs // max(n, 1))]
    while bounds[-1] < _ROWS:
        bounds.append(min(_ROWS, max(bounds[-1], 1) * settings.widen))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    kept = None
    for start, stop in zip([0, *bounds], bounds, strict=False):
        least, last = np.zeros(len(ids)), np.full(len(ids), _NO_ID)
        if kept is not None:
            kept = cut_lineage(kept)
            bars = kept.where(F.col("rank") == settings.k).orderBy("query_id").toArrow()
            known = bars.column("query_id").to_numpy()
            at = np.searchsorted(known, ids)
            at[at == len(known)] = 0
            held = known[at] == ids if len(known) else np.zeros(len(ids), bool)
            least[held] = bars.column("score").to_numpy()[at[held]]
            last[held] = bars.column("doc_id").fill_null(_NO_ID).to_numpy()[at[held]]
        part = docs.where((F.col("place") >= start) & (F.col("place") < stop)).drop("place")
        part = part.repartition(settings.first_tasks) if kept is None else part.coalesce(max(settings.first_tasks, -(-4 * n * (stop - start) // (3 * settings.shard * _ROWS))))
        found = part.mapInArrow(_search(plan, docs.sparkSession.sparkContext.broadcast((least, last)), settings), "query_id long, doc_id long, score double")
        found = found if kept is None else found.unionByName(kept.drop("rank"))
        kept = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= settings.k).select("query_id", "doc_id", "rank", "score")
    return kept


def search_every_fiftieth(docs: DataFrame, settings: Bm25 = Bm25()) -> DataFrame:
    """Documents whose id is divisible by 50, as whole texts, against all documents."""
    return search(docs, docs.where(F.col("doc_id") % 50 == 0).select(F.col("doc_id").alias("query_id"), "text"), settings)
