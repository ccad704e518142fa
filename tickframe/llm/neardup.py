"""Operator 9, near-duplicates by bottom-k sketches of one hash function.

1. Each document's set of word shingles is hashed once. Documents with equal sets form a class, and only the class goes
   on, under its smallest doc_id. The `sketch` smallest hashes are the class's sketch.
2. Inverted lists of retained values. Two sets with a similarity of 0.8 share at least `least_shared` sketch values
   (short of that with a probability below 1e-6; sets up to `sketch` values are held whole, and the bound is exact). So a
   class needs to stand only in the lists of its rarest values, all but least_shared - 1 of them, and values that many
   documents have in common drop out by themselves.
3. Only connections count, not every pair. In each list one class, whose values are the most frequent, meets all others;
   the union sketch of a pair estimates its similarity, and pairs that come near the limit are confirmed on full sets.
4. Lists that still hold classes of several components are open. Their classes meet under their `meeting` smallest
   hashes, block by block: first with sketches alone, which leaves the classes that come near another one, then those
   with their full sets. A task returns no more links than connect what it got (at most rows - 1).
5. Components by contraction: every node points at its smallest neighbour, and edges move to where they point.

Every table takes this one path, whatever its size. A linked pair that no other link connects is missed if it fails
step 2 or shares none of its `meeting` smallest hashes (0.2 ** 10, 1e-7, at the limit and less above it).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickframe.llm.common import STAGE_BYTES, cut_lineage, slices, small_batches, stream_groups, texts, window_hashes, word_hashes


@dataclass(frozen=True)
class NearDuplicates:
    words: int = 5
    percent: int = 80
    sketch: int = 64
    least_shared: int = 34
    #: A pair is confirmed on full sets if its estimate is at most so much below the limit (more than 4 deviations).
    margin: float = 0.3
    #: What stays unconnected meets under so many of its smallest hashes, in blocks of so many classes and hashes at most
    #: (on average: classes are dealt to blocks by hash).
    meeting: int = 10
    block: int = 512
    block_hashes: int = 1 << 17
    #: Up to so many nodes (8 bytes each) are sent to the texts, so that only theirs are moved; more, and all texts are shuffled.
    broadcast_nodes: int = 2_000_000


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; with fewer words the whole sequence is the only one."""
    found = word_hashes((text or b"").lower().split())
    return np.unique(window_hashes(found, min(words, len(found)))) if len(found) else np.empty(0, np.uint64)


def _signature(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.empty(0, np.uint64)]).view(np.int64)))


def _sketches(rules: NearDuplicates):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, STAGE_BYTES):
            sets = [shingle_hashes(t, rules.words) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_signature(s) for s in sets], pa.binary()), _lists([s[: rules.sketch] for s in sets])],
                ["doc_id", "n_shingles", "signature", "sketch"],
            )

    return run


def _full_sets(rules: NearDuplicates):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, STAGE_BYTES):
            sets = [shingle_hashes(t, rules.words) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([_signature(s) for s in sets], pa.binary()), _lists(sets)], ["doc_id", "signature", "shingles"])

    return run


def _inverted_lists(classes: DataFrame, rules: NearDuplicates) -> DataFrame:
    """(value, node, weight): the lists that a class must stand in; weight tells how frequent its values are.

    Linked sets differ in size by a factor of 1.25 at most. A list is of a value and a range of sizes (powers of 1.26), and a
    class stands in the lists of its own range and the next, so classes of very different sizes do not meet.
    """
    entries = classes.select("node", F.explode("sketch").alias("value"))
    shared = entries.groupBy("value").count().where("count > 1").select(F.col("value").alias("of_value"), F.col("count").alias("holders"))
    common = entries.join(shared, F.col("value") == F.col("of_value")).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("holders", "value"))).alias("common"), F.sum("holders").alias("weight"))
    sized = common.join(classes.select(F.col("node").alias("of_node"), F.size("sketch").alias("held"), F.floor(F.log("n_shingles") / F.log(F.lit(1.26))).alias("size_class")), F.col("node") == F.col("of_node"))
    least = F.least(F.lit(rules.least_shared), F.ceil(F.col("held") * rules.percent / 100)).cast("int")
    prefix = F.col("held") - least + 1 - (F.col("held") - F.size("common"))
    # Written once: the lists are read for their lengths and for their rows.
    chosen = cut_lineage(sized.where(prefix > 0).select("node", "weight", "size_class", F.slice("common.value", F.lit(1), prefix).alias("values")))
    chosen = chosen.select("node", "weight", "size_class", F.explode("values").alias("value"))
    return chosen.select("node", "weight", F.explode(F.array(F.xxhash64("value", "size_class"), F.xxhash64("value", F.col("size_class") + 1))).alias("value"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _estimated(pairs: DataFrame, classes: DataFrame, rules: NearDuplicates) -> DataFrame:
    """The pairs whose sizes and union sketches leave the limit in reach, with their sizes."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("sketch").alias(f"sketch_{x}"), F.col("n_shingles").alias(f"n_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    both = both.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * rules.percent)
    union = F.slice(F.sort_array(F.array_union("sketch_a", "sketch_b")), 1, rules.sketch)
    near = F.size(F.array_intersect(F.array_intersect(union, F.col("sketch_a")), F.col("sketch_b"))) / F.size(union)
    return both.where(near >= rules.percent / 100 - rules.margin).select("a", "b")


def _ids(nodes: DataFrame, rules: NearDuplicates) -> DataFrame:
    """The distinct nodes, for a semi join; up to `broadcast_nodes` of them go where the rows are, so that the other rows are not moved."""
    ids = cut_lineage(nodes.select("node").distinct())
    return F.broadcast(ids) if ids.count() <= rules.broadcast_nodes else ids


def _candidate_sets(ids: DataFrame, docs: DataFrame, classes: DataFrame, rules: NearDuplicates) -> DataFrame:
    """(node, shingles): the full sets of the `classes`, whose nodes are `ids`; only their texts are hashed for it."""
    wanted = classes.select("node", F.col("signature").alias("of_signature"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi")
    full = own.mapInArrow(_full_sets(rules), "doc_id long, signature binary, shingles array<long>")
    # Equal signatures, in a form that does not join by them: the sets are then moved by node alone, once for both steps.
    same = (F.col("signature") <= F.col("of_signature")) & (F.col("signature") >= F.col("of_signature"))
    return cut_lineage(full.join(wanted, (F.col("doc_id") == F.col("node")) & same).select("node", "shingles").dropDuplicates(["node"]))


def _confirmed(pairs: DataFrame, sets: DataFrame, rules: NearDuplicates) -> DataFrame:
    """The pairs whose full sets reach the limit."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").withColumn("both", F.size(F.array_intersect("set_a", "set_b")))
    return both.where(100 * F.col("both") >= rules.percent * (F.size("set_a") + F.size("set_b") - F.col("both"))).select("a", "b")


def _blocks(placed: DataFrame, rules: NearDuplicates, *carried: str) -> DataFrame:
    """`placed` (key, node, component, guest, n) with `block`, `low` and `high`: each row once for every pair of blocks it is in.

    Keys without two components are left out. A guest is of the next smaller class of sizes and meets only hosts. Where it
    saves rows, a key's largest component has blocks of its own (after those of the others), which do not meet each other:
    its rows then go to the blocks of other components only, and not as many times as it has blocks itself.
    """
    parts = placed.groupBy("key", "component").agg(F.count("*").alias("rows"), F.max("n").alias("n"), F.min("guest").alias("all_guests"))
    groups = parts.groupBy("key").agg(F.count("*").alias("components"), F.min("all_guests").alias("all_guests"), F.sum("rows").alias("rows"), F.max("n").alias("n"), F.max(F.struct("rows", "component")).alias("main"))
    of = lambda rows: F.greatest(F.ceil(rows / rules.block), F.ceil(rows * F.col("n") / rules.block_hashes)).cast("long")
    rest = F.col("rows") - F.col("main.rows")
    sized = groups.where("components > 1 AND NOT all_guests").select("key", "rows", rest.alias("rest"), "main", of(F.col("rows")).alias("together"), of(rest).alias("others"), of(F.col("main.rows")).alias("own"))
    apart = F.col("rest") * (F.col("others") + F.col("own")) + F.col("main.rows") * F.col("others") < F.col("rows") * F.col("together")
    groups = cut_lineage(sized.select(F.col("key").alias("of_key"), F.when(apart, F.col("main.component")).alias("main"), F.when(apart, F.col("others")).otherwise(F.col("together")).alias("others"), F.when(apart, F.col("own")).otherwise(0).alias("own")))
    rows = placed.join(groups, F.col("key") == F.col("of_key")).withColumn("in_main", F.col("component").eqNullSafe(F.col("main")))
    rows = rows.withColumn("block", F.when(F.col("in_main"), F.col("others") + F.pmod(F.xxhash64("node"), F.col("own"))).otherwise(F.pmod(F.xxhash64("node"), F.col("others"))))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1 + F.when(F.col("in_main"), 0).otherwise(F.col("own")))))
    return rows.select("key", "node", "component", "guest", *carried, "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))


def _pairs(group: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the two blocks of a group, and which pairs count."""
    low, high = np.flatnonzero(group["block"] == group["low"]), np.flatnonzero(group["block"] == group["high"])
    component, guest = group["component"], group["guest"]
    return low, high, (component[low][:, None] != component[high][None, :]) & ~(guest[low][:, None] & guest[high][None, :])


def _shared(rows: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How many values each pair of rows shares."""
    both = np.zeros((len(low), len(high)), np.float32)
    _, column, holders = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    # Values that one set holds alone add nothing; the others are taken some thousand at a time.
    rank = np.cumsum(holders > 1) - 1
    column = np.where(holders[column] > 1, rank[column], -1)
    row = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    width = int(column.max(initial=-1)) + 1
    for start in range(0, width, 4096):
        part = np.zeros((len(rows), min(4096, width - start)), np.float32)
        own = (column >= start) & (column < start + 4096)
        part[row[own], column[own] - start] = 1
        both += part[low] @ part[high].T
    return both


def union_estimate(one: np.ndarray, others: list[np.ndarray], sketch: int) -> np.ndarray:
    """Estimated similarity of a sketch with others: the share of their union sketch that both hold."""
    top = np.iinfo(np.int64).max
    width = max(len(one), *map(len, others))
    rows = np.full((len(others), 2 * width), top)
    rows[:, : len(one)] = one
    for i, other in enumerate(others):
        rows[i, width : width + len(other)] = other
    rows.sort(axis=1)
    # A value held by both stands twice in a row; the filling counts for nothing.
    twice = np.zeros(rows.shape, bool)
    twice[:, 1:] = (rows[:, 1:] == rows[:, :-1]) & (rows[:, 1:] < top)
    place = np.cumsum(~twice & (rows < top), axis=1)
    return (twice & (place <= sketch)).sum(axis=1) / np.maximum(np.minimum(place[:, -1], sketch), 1)


def _near_ones(group: dict, rules: NearDuplicates) -> np.ndarray:
    """Nodes of a pair of blocks whose union sketch with one of another component comes near the limit.

    A pair counts under the smallest value that it shares only, so it meets once, not under every key that it has in common.
    """
    least = rules.percent / 100 - rules.margin
    low, high, counts = _pairs(group)
    near = np.zeros(len(group["node"]), bool)
    if not counts.any():
        return group["node"][near]
    sketches, value = group["sketch"], group["value"][0]
    counts &= _shared([x[x < value] for x in sketches], low, high) == 0
    if counts.any():
        both = _shared(sketches, low, high)
        size = np.minimum(rules.sketch, np.array([len(x) for x in sketches]))
        # The union sketch has at least as many values as the larger sketch, and shares none that both do not retain.
        counts &= both >= least * np.maximum(size[low][:, None], size[high][None, :])
    for i in np.flatnonzero(counts.any(axis=1)):
        found = np.flatnonzero(counts[i])
        found = found[~near[high[found]]] if near[low[i]] else found[np.argsort(-both[i, found], kind="stable")]
        for start in range(0, len(found), 64):
            some = high[found[start : start + 64]]
            hit = some[union_estimate(sketches[low[i]], [sketches[j] for j in some], rules.sketch) >= least]
            near[low[i]] |= len(hit) > 0
            near[hit] = True
    return group["node"][near]


def _near(rules: NearDuplicates):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in stream_groups(batches, ["key", "low", "high"]):
            if len(nodes := _near_ones(group, rules)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), group["key"][0])), pa.array(nodes)], ["key", "node"])

    return run


def linked_components(group: dict, rules: NearDuplicates) -> list[tuple[int, int]]:
    """Links between the components of a pair of blocks, no more than connect what they connect (at most rows - 1)."""
    low, high, counts = _pairs(group)
    if not counts.any():
        return []
    both = _shared(group["shingles"], low, high)
    sizes = np.array([len(x) for x in group["shingles"]])
    linked = counts & (100 * both >= rules.percent * (sizes[low][:, None] + sizes[high][None, :] - both))
    component, seen, edges = group["component"], set(), []
    if not linked.any():
        return edges
    rows_of: dict[int, list[tuple[int, int]]] = {}
    for side, rows in ((0, low), (1, high)):
        for i, row in enumerate(rows):
            rows_of.setdefault(int(component[row]), []).append((side, i))
    for root in map(int, component[low[linked.any(axis=1)]]):
        if root in seen:
            continue
        seen.add(root)
        waiting = [root]
        while waiting:
            here = waiting.pop()
            for side, i in rows_of[here]:
                found = component[high[np.flatnonzero(linked[i])]] if side == 0 else component[low[np.flatnonzero(linked[:, i])]]
                for other in map(int, np.unique(found)):
                    if other not in seen:
                        seen.add(other)
                        edges.append((here, other))
                        waiting.append(other)
    return edges


def _linked(rules: NearDuplicates):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in stream_groups(batches, ["key", "low", "high"]):
            if edges := linked_components(group, rules):
                yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _dealt(rows: DataFrame) -> DataFrame:
    """Pairs of blocks spread over the tasks, each pair's rows together."""
    return rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")


def _met(nodes: DataFrame, sets: DataFrame, classes: DataFrame, rules: NearDuplicates) -> DataFrame:
    """Links (a, b) between the components of `nodes` (node, component), enough to connect all that links connect.

    Linked sets share one of the `meeting` smallest hashes of their union but for a probability of 0.2 to that power, and
    both hold it among as many of their own. Their sizes differ by a factor of 1.25 at most, so a class stands as a host
    under its own class of sizes (powers of 1.26) and as a guest under the next one.
    """
    sized = nodes.join(classes.select("node", "sketch", F.col("n_shingles").alias("n"), F.floor(F.log("n_shingles") / F.log(F.lit(1.26))).alias("size_class")), "node")
    places = F.explode(F.flatten(F.transform(F.slice("sketch", 1, rules.meeting), lambda v: F.array(*[F.struct(F.xxhash64(v, F.col("size_class") + g).alias("key"), v.alias("value"), F.lit(g == 1).alias("guest")) for g in (0, 1)]))))
    placed = cut_lineage(sized.select("node", "component", "n", "sketch", places.alias("place")).select("place.key", "place.value", "node", "component", "place.guest", "n", "sketch"))
    near = _dealt(_blocks(placed.withColumn("n", F.lit(rules.sketch)), rules, "value", "sketch")).mapInArrow(_near(rules), "key long, node long").distinct()
    left = cut_lineage(placed.drop("sketch", "value").join(near, ["key", "node"]))
    full = _blocks(left, rules).join(sets.join(_ids(left, rules), "node", "left_semi"), "node")
    return _dealt(full).mapInArrow(_linked(rules), "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b): the smallest node that it reaches.

    Each turn at least halves the nodes that still have edges, and stars need one.
    """
    edges = cut_lineage(edges.select("a", "b").where("a <> b").distinct())
    found = None
    while not edges.isEmpty():
        ends = edges.union(edges.select("b", "a")).toDF("node", "other")
        points = ends.groupBy("node").agg(F.least("node", F.min("other")).alias("to"))
        jumps = points.select(F.col("node").alias("to"), F.col("to").alias("further"))
        points = cut_lineage(points.join(jumps, "to").select("node", F.col("further").alias("to")))
        if found is None:
            found = points.toDF("node", "component")
        else:
            found = found.join(points.toDF("component", "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        at = lambda x: points.select(F.col("node").alias(x), F.col("to").alias(f"to_{x}"))  # noqa: E731, B023
        edges = cut_lineage(edges.join(at("a"), "a").join(at("b"), "b").where("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found


def links(docs: DataFrame, classes: DataFrame, rules: NearDuplicates) -> DataFrame:
    """(node, component) of every class: the smallest class that it reaches over links."""
    lists = _inverted_lists(classes, rules)
    held = lists.groupBy("value").agg(F.count("*").alias("n")).where("n > 1").select(F.col("value").alias("of_value"))
    lists = cut_lineage(lists.join(held, F.col("value") == F.col("of_value"), "left_semi"))
    if lists.isEmpty():
        return classes.select("node", F.col("node").alias("component"))
    every, ids = classes, _ids(lists, rules)
    classes = every.join(ids, "node", "left_semi")
    sets = _candidate_sets(ids, docs, classes, rules)
    heads = lists.groupBy("value").agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"))).alias("head")).select(F.col("value").alias("of_value"), (-F.col("head.minus")).alias("b"))
    met = lists.join(heads, F.col("value") == F.col("of_value")).select(F.col("node").alias("a"), "b").where("a <> b")
    reached = components(_confirmed(_estimated(_ordered(met), classes, rules), sets, rules))
    reached = every.select("node").join(reached, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    placed = lists.join(reached, "node")
    open_lists = placed.groupBy("value").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select(F.col("value").alias("of_value"))
    nodes = cut_lineage(placed.join(open_lists, F.col("value") == F.col("of_value"), "left_semi").select("node", "component").distinct())
    further = components(cut_lineage(_met(nodes, sets, classes, rules))).toDF("of", "further")
    return reached.join(further, F.col("component") == F.col("of"), "left").select("node", F.coalesce("further", "component").alias("component"))


def near_duplicates(docs: DataFrame, rules: NearDuplicates = NearDuplicates()) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept.

    Documents are linked where their shingle sets have a similarity of `percent` or more; component_id is the smallest
    doc_id reachable over links. Texts without words (null, empty, blank) have no shingles and are linked with nothing.
    Rows with a null doc_id are linked with nothing either; their component_id is null and they are kept. Rows that share
    a doc_id are one node.
    """
    small_batches(docs.sparkSession, STAGE_BYTES)
    sketched = cut_lineage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sketches(rules), "doc_id long, n_shingles long, signature binary, sketch array<long>"))
    real = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL")
    nodes = real.groupBy("signature").agg(F.min("doc_id").alias("node"))
    classes = cut_lineage(real.join(nodes.select(F.col("signature").alias("of_signature"), F.col("node")), (F.col("doc_id") == F.col("node")) & (F.col("signature") == F.col("of_signature"))).select("node", "signature", "n_shingles", "sketch").dropDuplicates(["node", "signature"]))
    reached = links(docs, classes, rules)
    placed = classes.select("signature", "node").join(reached, "node", "left").select(F.col("signature").alias("of_signature"), F.coalesce("component", "node").alias("component"))
    match = (F.col("signature") == F.col("of_signature")) & F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    result = sketched.select("doc_id", "n_shingles", "signature").join(placed, match, "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return result.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one_each(docs: DataFrame, rules: NearDuplicates = NearDuplicates()) -> DataFrame:
    """`docs` with one document of each component, same columns; of rows that share a doc_id one stays.

    Rows without a doc_id and texts without words are linked with nothing and stay. An empty table stays empty; other
    columns may have any names.
    """
    kept = near_duplicates(docs, rules).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("kept_id")).distinct()
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("own_id"))
    chosen = packed.join(kept, F.col("own_id") == F.col("kept_id"), "left_semi")
    first = chosen.withColumn("rank", F.row_number().over(Window.partitionBy("own_id").orderBy(F.xxhash64("row")))).where("rank = 1").select("row")
    return first.union(packed.where("own_id IS NULL").select("row")).select(*[F.col("row")[c].alias(c) for c in docs.columns])


SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                 ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s FROM words
), sizes AS (SELECT doc_id, len(s)::BIGINT AS n FROM sets),
items AS (SELECT doc_id, hash(unnest(s)) AS h FROM sets),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM items x JOIN items y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY 1, 2),
linked AS (SELECT a, b FROM shared o JOIN sizes p ON o.a = p.doc_id JOIN sizes q ON o.b = q.doc_id WHERE 100 * o.n >= 80 * (p.n + q.n - o.n)),
edges AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sizes UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN comp USING (doc_id)
"""
