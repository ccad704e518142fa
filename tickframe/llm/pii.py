"""Operator 6, personal data and information-theoretic sanitisation.

Base spans come from four fixed patterns. The method adds terms that give away a protected entity: over the corpus, the
pointwise mutual information of a term and an entity is set against the entity's information content, and a term above
the threshold is removed or generalised wherever it stands in a document that holds its entity. Protected are the exact
value of a base span and what identifies its group: an e-mail address's domain, the first two parts of an ip, a card's
first six digits, a phone number's first five. Exact values seldom recur often enough to be judged; groups do.

A context of an entity is the pair of its nearest terms on either side, so copies of one passage count once. Contexts of
an entity that share half a side (`reach` / 2 terms in a row, at the same distance) are merged, also over chains of others,
as a passage that was copied with small changes says no more about its terms than one copy. A term needs `least_contexts` merged contexts, however
often each occurs, so copies never take a term away. Contexts are counted over all documents.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.llm.common import cut_lineage, slices, small_batches, texts
from tickframe.llm.neardup import components

# The four kinds in their order, with their patterns.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: The leftmost ip never starts inside a run of digits, so no run is read more than once.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
TERM = "term"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_DIGIT = re.compile("[0-9]")


@dataclass(frozen=True)
class Disclosure:
    #: A term discloses an entity if their mutual information is at least this share of the entity's information.
    threshold: float = 0.75
    least_contexts: int = 5
    #: Words on each side of an entity, in its line, that count as beside it.
    reach: int = 10
    #: Terms to hide of up to so many bytes over all texts are sent to all tasks; more of them are joined to the texts.
    hidden_bytes: int = 16 << 20


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _holds(kind: str, found: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in found.split(".")))
    digits = "".join(_DIGIT.findall(found))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind."""
    found = []
    if "@" in text:
        # A match's part before @ is a run of these characters, so the search starts where that run does.
        at, end = text.find("@"), 0
        pattern = PATTERNS["email"]
        while at >= 0:
            start = at
            while start > end and (text[start - 1] in "._%+-" or text[start - 1].isascii() and text[start - 1].isalnum()):
                start -= 1
            if start < at and (match := pattern.match(text, start)):
                found.append(("email", start, match.end()))
                end = match.end()
            at = text.find("@", max(at + 1, end))
    if _DIGIT.search(text):
        for kind in ("ip", "card", "phone"):
            if kind == "ip" and "." not in text or kind == "phone" and "+" not in text:
                continue
            pattern = _IP if kind == "ip" else PATTERNS[kind]
            found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if _holds(kind, m[0])]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def entities(kind: str, value: str) -> list[str]:
    """The protected entities of a base span: its exact value and its group."""
    value = value.lower()
    digits = "".join(_DIGIT.findall(value))
    group = {"email": value.partition("@")[2], "ip": ".".join(value.split(".")[:2]), "card": digits[:6], "phone": digits[:5]}[kind]
    return [f"{kind}:{value}", f"{kind}-group:{group}"]


def _terms(text: str, low: int, high: int, covered: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """(term, start, end) of the words of text[low:high] that hold a letter and touch no covered range.

    `covered` is sorted and has no overlaps.
    """
    out, k = [], bisect_right(covered, low, key=lambda c: c[1])
    for m in _WORD.finditer(text, low, high):
        a, b = m.span()
        while k < len(covered) and covered[k][1] <= a:
            k += 1
        if k < len(covered) and covered[k][0] < b:
            continue
        term = m[0].lower().strip(".,;:?!\"'()[]")
        if any(c.isalpha() for c in term):
            out.append((term, a, b))
    return out


def _covered(spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for _, start, end in spans:
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _beside(text: str, spans: list[tuple[str, int, int]], reach: int) -> Iterator[tuple[str, int, int, list[str], list[str]]]:
    """Each base span with its nearest terms to the left (nearest last) and right, in its line.

    The words of a line are looked at once, however many spans it has.
    """
    covered, stop, terms, starts = _covered(spans), -1, [], []
    for kind, start, end in spans:
        if start >= stop:
            low, stop = text.rfind("\n", 0, start) + 1, text.find("\n", end)
            stop = len(text) if stop < 0 else stop
            terms = _terms(text, low, stop, covered)
            starts = [a for _, a, _ in terms]
        at, after = bisect_left(starts, start), bisect_left(starts, end)
        yield kind, start, end, [t for t, _, _ in terms[max(0, at - reach) : at]], [t for t, _, _ in terms[after : after + reach]]


def _hash(words: list[str]) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(words)) - (1 << 63)


def _halves(left: list[str], right: list[str], reach: int) -> list[int]:
    """Hashes of the full halves of either side, nearest half first, each with its place."""
    half = max(1, reach // 2)
    cut = [("a", left[-half:]), ("b", left[:-half][-half:]), ("c", right[:half]), ("d", right[half:][:half])]
    return [_hash([place, *words]) for place, words in cut if len(words) == half]


def _contexts(rules: Disclosure):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows: dict[tuple[str, str, int], list[int] | None] = {}
            for data in texts(batch):
                if data and (b"@" in data or re.search(rb"[0-9]", data)):
                    text = data.decode()
                    for kind, start, end, left, right in _beside(text, base_spans(text), rules.reach):
                        context = _hash([*left, "\n", *right])
                        for entity in entities(kind, text[start:end]):
                            rows.update(((entity, term, context), None) for term in {*left, *right})
                            rows[entity, "", context] = _halves(left, right, rules.reach)
            keys = list(rows)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in keys], pa.string()), pa.array([r[1] for r in keys], pa.string()), pa.array([r[2] for r in keys], pa.int64()), pa.array([rows[r] for r in keys], pa.list_(pa.int64()))], ["entity", "term", "context", "halves"])

    return run


def _merged(seen: DataFrame) -> DataFrame:
    """(of, in_context, merged): the contexts of an entity that share half a side with another one, each with the least
    context that it reaches over shared halves, however many of them lie between.
    """
    node = F.struct("entity", "context")
    own = cut_lineage(seen.where("term = ''").select(node.alias("a"), "entity", F.explode("halves").alias("half")))
    # All contexts of a half are linked to its least one; that makes stars, and no pairs within a half.
    heads = own.groupBy(F.col("entity").alias("of"), F.col("half").alias("of_half")).agg(F.min("a").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    reached = components(own.join(heads, (F.col("entity") == F.col("of")) & (F.col("half") == F.col("of_half"))).select("a", "b"))
    return reached.select(F.col("node.entity").alias("of"), F.col("node.context").alias("in_context"), F.col("component.context").alias("merged"))


def disclosing_terms(docs: DataFrame, rules: Disclosure = Disclosure()) -> DataFrame:
    """(entity, term): terms that disclose an entity, by its contexts over the corpus.

    With N contexts, n(e) of the entity, n(t) of the term and n(e, t) of both: log(N n(e,t) / n(e) n(t)) is at least
    threshold * log(N / n(e)). An entity in every context has no information and is disclosed by nothing. Exact values and
    groups are counted apart. A term that discloses an entity and its group stands with both. Repeated rows and copies
    count once; null and empty texts and empty tables have no terms.
    """
    seen = cut_lineage(docs.select("text").mapInArrow(_contexts(rules), "entity string, term string, context long, halves array<long>").groupBy("entity", "term", "context").agg(F.first("halves").alias("halves")))
    alike = seen.join(_merged(seen), (F.col("entity") == F.col("of")) & (F.col("context") == F.col("in_context")), "left").withColumn("merged", F.coalesce("merged", "context"))
    level = F.split_part("entity", F.lit(":"), F.lit(1)).endswith("-group").alias("level")
    pairs = cut_lineage(alike.groupBy("entity", "term").agg(F.count_distinct("merged").alias("both")).withColumn("level", level))
    entity = pairs.where("term = ''").select(F.col("entity").alias("of_entity"), F.col("both").alias("n_entity"))
    terms = pairs.where("term <> ''").groupBy(F.col("level").alias("of_level"), F.col("term").alias("of_term")).agg(F.sum("both").alias("n_term"))
    total = pairs.where("term = ''").groupBy(F.col("level").alias("at_level")).agg(F.sum("both").alias("total"))
    judged = pairs.where((F.col("term") != "") & (F.col("both") >= rules.least_contexts))
    judged = judged.join(entity, F.col("entity") == F.col("of_entity")).join(terms, (F.col("term") == F.col("of_term")) & (F.col("level") == F.col("of_level"))).join(F.broadcast(total), F.col("level") == F.col("at_level"))
    information = F.log(F.col("total") / F.col("n_entity"))
    mutual = F.log(F.col("total") * F.col("both") / (F.col("n_entity") * F.col("n_term")))
    return judged.where((information > 0) & (mutual >= rules.threshold * information)).select("entity", "term")


def _digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _entities(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text_key, entity) of each text with base spans."""
    for batch in slices(batches):
        keys, found = [], []
        for key, data in zip(batch.column("text_key").to_pylist(), texts(batch), strict=True):
            text = (data or b"").decode()
            own = sorted({e for kind, a, b in base_spans(text) for e in entities(kind, text[a:b])})
            keys += [key] * len(own)
            found += own
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.string())], ["text_key", "entity"])


def _find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "terms"]
    for batch in slices(batches):
        counts, digests, spans, added = [], [], [], []
        for data, hidden in zip(texts(batch), batch.column("hidden").to_pylist(), strict=True):
            text = (data or b"").decode()
            base = base_spans(text)
            digests.append(hashlib.sha256(_digest(base).encode()).hexdigest())
            counts.append(Counter(k for k, _, _ in base))
            wanted = set(hidden or ())
            more = [(TERM, a, b) for term, a, b in _terms(text, 0, len(text), _covered(base)) if term in wanted] if wanted else []
            added.append(len(more))
            spans.append(_digest(sorted(base + more, key=lambda s: (s[1], (*KINDS, TERM).index(s[0])))))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([c[k] for c in counts], pa.int64()) for k in KINDS], pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())], names)


def find_personal_data(docs: DataFrame, rules: Disclosure = Disclosure()) -> DataFrame:
    """One row per row of `docs`: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, terms.

    `spans` holds the base spans and the spans of disclosing terms (kind `term`), by start and then kind; `terms` counts
    the latter: every occurrence of a term in a document that holds its entity. A null text counts as empty and has no
    spans. Equal texts have equal spans, whatever their ids; an empty table gives an empty result; other columns are not
    read. Texts are moved only if the terms to hide take more than `hidden_bytes`.
    """
    small_batches(docs.sparkSession)
    terms = cut_lineage(disclosing_terms(docs, rules))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, terms long"
    if terms.isEmpty():
        return own.withColumn("hidden", F.lit(None).cast("array<string>")).mapInArrow(_find, schema)
    key = F.unhex(F.md5(F.col("text").cast("binary")))
    held = own.where(F.col("text").rlike("[@0-9]")).select(key.alias("text_key"), "text").mapInArrow(_entities, "text_key binary, entity string").distinct()
    hidden = cut_lineage(held.join(terms.withColumnRenamed("entity", "of_entity"), F.col("entity") == F.col("of_entity")).groupBy("text_key").agg(F.collect_set("term").alias("hidden")))
    if (hidden.agg(F.sum(F.octet_length(F.concat_ws(" ", "hidden")) + 64)).first()[0] or 0) <= rules.hidden_bytes:
        hidden = F.broadcast(hidden)
    return own.join(hidden, key == F.col("text_key"), "left").select("doc_id", "text", "hidden").mapInArrow(_find, schema)


def sanitise(text: str, spans: str, generalise: bool = True) -> str:
    """The text with each span of a `spans` string replaced by its kind in brackets, or removed."""
    out, at = [], 0
    for kind, a, b in ((k, int(a), int(b)) for k, a, b in (s.split(":") for s in spans.split(",") if s)):
        if b <= at:
            continue
        out.append(text[at : max(a, at)])
        if a >= at:
            out.append(f"[{kind}]" if generalise else "")
        at = b
    return "".join(out) + text[at:]
