"""Operator 4, BPE encoding and decoding with a contiguous rank array.

A word is held as part boundaries and, beside them, the rank of each pair of neighbouring parts. The lowest rank is found
by scanning, its right boundary is deleted, and the ranks on both sides are looked up anew, until no pair has a rank.
Words are short, so scanning a small array beats a heap. A long word's array is cut into blocks of `BLOCK` parts, and a heap
of the blocks' minima says which block to scan, so its cost is nearly linear. Words recur, so each worker keeps the
ids of recent ones, up to a bound in bytes.

The vocabulary file names its steps: NFC, lower case, a split that drops blanks, bytes as visible characters, and a mark
at each word's end. Blanks always separate pieces, so a text is cut at blanks first and each chunk is looked up whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.llm.common import STAGE_BYTES, slices, small_batches, texts

NO_RANK = 1 << 60
#: Parts of a word up to which one scan covers it; longer words have blocks of so many.
BLOCK = 128
#: Bytes (estimated) of the words that a worker keeps in each of two generations; a quarter of it for other pieces.
CACHE = 48 << 20
#: Longer words are not kept.
CACHED_LENGTH = 64

#: Characters that Python counts as blanks but Unicode's White_Space does not.
_ODD_BLANKS = re.compile("[\x1c-\x1f]")
_BLANKS = regex.compile(r"\p{White_Space}+")


def _byte_characters() -> dict[int, str]:
    """Visible characters stand for themselves, the other bytes for characters from U+0100 on, in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = (b for b in range(256) if b not in set(visible))
    return {b: chr(b) for b in visible} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


def merge_ranks(parts: list[int], ranks: dict[int, int], merged: list[int]) -> tuple[list[int], list[int]]:
    """Byte pair merges of one word, lowest rank first, leftmost on ties: its parts' ids and their boundaries.

    `ranks` has the rank of a pair under left * 2^20 + right; `merged` has the id that a rank makes.
    """
    if len(parts) > BLOCK:
        return _merge_long(parts, ranks, merged)
    parts = list(parts)
    bounds = list(range(len(parts) + 1))
    get = ranks.get
    # near[i] is the rank of the parts bounds[i]:bounds[i+1] and bounds[i+1]:bounds[i+2].
    near = [get(a << 20 | b, NO_RANK) for a, b in zip(parts, parts[1:], strict=False)]
    while near:
        least = min(near)
        if least == NO_RANK:
            break
        i = near.index(least)
        del bounds[i + 1], near[i], parts[i + 1]
        parts[i] = merged[least]
        if i < len(near):
            near[i] = get(parts[i] << 20 | parts[i + 1], NO_RANK)
        if i:
            near[i - 1] = get(parts[i - 1] << 20 | parts[i], NO_RANK)
    return parts, bounds


def _merge_long(word: list[int], ranks: dict[int, int], merged: list[int]) -> tuple[list[int], list[int]]:
    """As `merge_ranks`. near[k][i] is the rank of part i of block k and the part after it, in this block or a later one."""
    get = ranks.get
    parts = [word[i : i + BLOCK] for i in range(0, len(word), BLOCK)]
    starts = [list(range(i, min(i + BLOCK, len(word)))) for i in range(0, len(word), BLOCK)]
    near = [[get(a << 20 | b, NO_RANK) for a, b in zip(p, [*p[1:], *(q[:1])], strict=False)] for p, q in zip(parts, [*parts[1:], []], strict=True)]
    near[-1] += [NO_RANK] * (len(parts[-1]) - len(near[-1]))
    # Blocks with parts, as a chain: emptied ones drop out.
    before, after = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
    heap = [(min(x), k) for k, x in enumerate(near)]
    heapq.heapify(heap)

    def renew(k: int, i: int) -> None:
        j = after[k]
        follower = parts[k][i + 1] if i + 1 < len(parts[k]) else parts[j][0] if j >= 0 else -1
        near[k][i] = get(parts[k][i] << 20 | follower, NO_RANK) if follower >= 0 else NO_RANK

    while heap:
        least, k = heapq.heappop(heap)
        if least == NO_RANK:
            break
        if not near[k] or min(near[k]) != least:
            continue
        i = near[k].index(least)
        parts[k][i] = merged[least]
        changed = {k}
        if i + 1 < len(parts[k]):
            del parts[k][i + 1], starts[k][i + 1], near[k][i + 1]
        else:
            j = after[k]
            del parts[j][0], starts[j][0], near[j][0]
            changed.add(j)
            if not parts[j]:
                after[k] = after[j]
                if after[j] >= 0:
                    before[after[j]] = k
        renew(k, i)
        if i:
            renew(k, i - 1)
        elif before[k] >= 0:
            renew(before[k], len(parts[before[k]]) - 1)
            changed.add(before[k])
        for j in changed:
            if near[j]:
                heapq.heappush(heap, (min(near[j]), j))
    return [p for block in parts for p in block], [*(s for block in starts for s in block), len(word)]


class Coder:
    """Encoder and decoder of one vocabulary file (the JSON of a BPE tokenizer with word-end marks)."""

    def __init__(self, definition: str):
        file = json.loads(definition)
        model = file["model"]
        steps = [s["type"] for s in file["normalizer"]["normalizers"]]
        split, to_bytes = file["pre_tokenizer"]["pretokenizers"]
        if steps != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split" or to_bytes["type"] != "ByteLevel" or file["decoder"] is not None:
            raise ValueError("a vocabulary file of another kind")
        self.end: str = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]]
        self.ranks = {self.vocab[a] << 20 | self.vocab[b]: i for i, (a, b) in enumerate(pairs)}
        self.merged = [self.vocab[a + b] for a, b in pairs]
        self.added = {a["content"]: a["id"] for a in file["added_tokens"]}
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        # In this pattern \s is Unicode's White_Space.
        self.pieces = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"), regex.V1)
        characters = _byte_characters()
        self.inner = [self.vocab[characters[b]] for b in range(256)]
        self.last = [self.vocab[characters[b] + self.end] for b in range(256)]
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        self.token_of = {str(i): t for i, t in self.tokens.items()}
        # A word's ids, joined by blanks: words of the newest two generations, and pieces that are no words of their own.
        self.recent: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.others: dict[str, str] = {}
        self.recent_bytes = self.others_bytes = 0

    def _keep(self, word: str, ids: str) -> str:
        if len(word) <= CACHED_LENGTH:
            # Two strings with their heads and a place in a dictionary.
            self.recent_bytes += 240 + 2 * len(word) + len(ids)
            if self.recent_bytes > CACHE:
                self.recent, self.older, self.recent_bytes = {}, self.recent, 0
            self.recent[word] = ids
        return ids

    def _merged(self, piece: str) -> str:
        data = piece.encode()
        parts = [self.inner[b] for b in data]
        parts[-1] = self.last[data[-1]]
        return " ".join(map(str, merge_ranks(parts, self.ranks, self.merged)[0]))

    def _piece(self, piece: str) -> str:
        """Ids of a piece. One of letters a to z only is a word of its own and is kept as such."""
        if piece.isascii() and piece.isalpha():
            if (known := self.recent.get(piece)) is not None:
                return known
            return self._keep(piece, self._merged(piece) if (known := self.older.get(piece)) is None else known)
        if (known := self.others.get(piece)) is None:
            known = self._merged(piece)
            if len(piece) <= CACHED_LENGTH:
                self.others_bytes += 240 + 4 * len(piece) + len(known)
                if self.others_bytes > CACHE // 4:
                    self.others, self.others_bytes = {}, 0
                self.others[piece] = known
        return known

    def _chunk(self, chunk: str) -> str:
        """Ids of a chunk without blanks."""
        if (known := self.older.get(chunk)) is None:
            plain = chunk.lower() if chunk.isascii() else "".join(c.lower() for c in unicodedata.normalize("NFC", chunk))
            if plain.isascii() and plain.isalpha():
                known = self._piece(plain)
                if plain == chunk:
                    return known
            else:
                known = " ".join([self._piece(piece) for piece in self.pieces.findall(plain)])
        return self._keep(chunk, known)

    def _plain(self, text: str) -> list[str]:
        chunks = text.split() if not _ODD_BLANKS.search(text) else [c for c in _BLANKS.split(text) if c]
        get = self.recent.get
        found = [get(c) for c in chunks]
        if None in found:
            found = [f if f is not None else self._chunk(c) for f, c in zip(found, chunks, strict=True)]
        return [f for f in found if f]

    def code(self, text: str) -> tuple[str, int, str]:
        """Ids joined by a blank, their number, and the decoded text."""
        if self.special is None or not self.special.search(text):
            runs = self._plain(text)
        else:
            runs, at = [], 0
            for match in self.special.finditer(text):
                runs += self._plain(text[at : match.start()])
                runs.append(str(self.added[match[0]]))
                at = match.end()
            runs += self._plain(text[at:])
        joined = " ".join(runs)
        ids = joined.split(" ") if joined else []
        return joined, len(ids), " ".join([self.token_of[i] for i in ids])

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.code(text)[0].split()]

    def decode(self, ids: list[int]) -> str:
        """The file has no decoder, so the tokens are joined by a blank; ids without a token are passed over."""
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])


_coders: dict[int, Coder] = {}


def _coder(definition: Any) -> Coder:
    key = definition.id if hasattr(definition, "id") else hash(definition)
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(definition.value if hasattr(definition, "value") else definition)
    return _coders[key]


def share_vocabulary(spark: SparkSession, path: str):
    """The vocabulary file, read on the driver (its size does not follow the data) and broadcast."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def _code_columns(batch: pa.RecordBatch, definition: Any, names: list[str]) -> dict[str, pa.Array]:
    coder = _coder(definition)
    ids, decoded, n = [], [], []
    id_hash, text_hash = [], []
    for text in texts(batch):
        one, count, back = coder.code((text or b"").decode())
        n.append(count)
        id_hash.append(hashlib.sha256(one.encode()).hexdigest())
        text_hash.append(hashlib.sha256(back.encode()).hexdigest())
        # As numbers of four bytes: a list of Python's integers takes ten times as much.
        if "ids" in names:
            ids.append(np.fromiter(map(int, one.split()), np.int32, count))
        if "decoded" in names:
            decoded.append(back)
    out = {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(id_hash, pa.string()), "decoded_sha256": pa.array(text_hash, pa.string())}
    if "ids" in names:
        out["ids"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(np.concatenate([*ids, np.empty(0, np.int32)])))
    return out | ({"decoded": pa.array(decoded, pa.string())} if "decoded" in names else {})


def code_texts(docs: DataFrame, path: str, with_output: bool = False, with_decoded: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and with_output the ids and (unless without) decoded text.

    A null text counts as empty and has no tokens. Each row is coded where it lies; equal rows give equal results.
    """
    small_batches(docs.sparkSession, STAGE_BYTES)
    definition = share_vocabulary(docs.sparkSession, path)
    names = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids", *(["decoded"] if with_decoded else [])] if with_output else [])]
    kinds = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "ids": "array<int>", "decoded": "string"}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in slices(batches, STAGE_BYTES // 2):
                made = _code_columns(batch, definition, names)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[made[k] for k in names]], ["doc_id", *names])
        finally:
            # Spark uses its Python processes again: what is kept here would stand beside later tasks' memory.
            _coders.clear()
            pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{k} {kinds[k]}" for k in names))
