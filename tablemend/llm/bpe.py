"""Byte-level BPE: texts to token ids and back.

Texts are cut by a pattern; each distinct piece of a batch is merged once. Pieces of similar length form a padded
matrix of token ids, one row per piece. In each round every row merges its leftmost pair of minimum rank; pairs are
looked up in a hash table of arrays, and finished rows leave the matrix.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from tablemend.llm.common import extended, text_slices, with_fields

NONE = np.int32(2**31 - 1)
LENGTHS = (4, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256)  # widths of the padded matrices; longer pieces use a heap
CELLS = 1 << 19  # of one matrix


class PairTable:
    """(left id, right id) -> id of the joined token, by open addressing over arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.mask = np.int64((1 << self.bits) - 1)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while left.size:
            free = left[self.keys[slot[left]] == -1]
            first = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[first]], self.values[slot[first]] = keys[first], values[first]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of joined tokens, NONE where there is none or where an end is padding (-1)."""
        out = np.full(left.shape, NONE, np.int32)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        keys = (left.ravel()[todo].astype(np.int64) << 32) | right.ravel()[todo].astype(np.int64)
        slot, flat = self._slot(keys), out.reshape(-1)
        while todo.size:
            there = self.keys[slot]
            hit = there == keys
            flat[todo[hit]] = self.values[slot[hit]]
            more = ~hit & (there != -1)
            todo, keys, slot = todo[more], keys[more], (slot[more] + 1) & self.mask
        return out


#: One-byte characters on which white space means the same to all engines.
PLAIN = bytes(b for b in range(256) if b not in (0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0))


def _one_byte_pattern(pattern: str) -> re.Pattern[bytes]:
    """``pattern`` for texts of one-byte characters, with the letters and numbers among them listed."""
    classes = {
        kind: b"".join(re.escape(bytes([b])) for b in range(256) if unicodedata.category(chr(b))[0] == kind) for kind in "LN"
    }
    out, inside, i = b"", False, 0
    while i < len(pattern):
        if kind := re.match(r"\\p\{([LN])\}", pattern[i:]):
            out += classes[kind[1]] if inside else b"[" + classes[kind[1]] + b"]"
            i += kind.end()
            continue
        step = 2 if pattern[i] == "\\" else 1
        inside = pattern[i] == "[" or inside and pattern[i] != "]"
        out += pattern[i : i + step].encode("latin-1")
        i += step
    return re.compile(out)


class Codec:
    """Encoder and decoder of one vocabulary; remembers up to ``most_pieces`` pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most_pieces: int = 150_000):
        self.ranks, self.most_pieces = ranks, most_pieces
        self.wide_pieces, self.plain_pieces = regex.compile(pattern).findall, _one_byte_pattern(pattern).findall
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.bytes_of: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        pairs = {}
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = PairTable(np.fromiter(pairs.keys(), np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)))
        self.decimal = [str(i) for i in range(len(self.bytes_of))]
        self._forget()

    def _forget(self) -> None:
        self.seen: dict[bytes | str, int] = {}
        self.pool = np.empty(1 << 16, np.int32)
        self.used = 0
        self.starts, self.lengths = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def rest(self, most_pieces: int = 30_000) -> None:
        """At the end of a task: give back a large memory, as idle workers stay alive beside others."""
        if len(self.seen) > most_pieces:
            self._forget()

    # --- merging -----------------------------------------------------------------------------

    def _merge_rows(self, ids: np.ndarray) -> np.ndarray:
        """The rows of a matrix of byte ids, fully merged; both are padded with -1 at the right."""
        done = np.full_like(ids, -1)
        rows = np.arange(len(ids))
        rank = self.pairs.find(ids[:, :-1], ids[:, 1:])
        while True:
            width = ids.shape[1]
            best = rank.argmin(axis=1) if width > 1 else np.zeros(len(rows), np.int64)
            value = rank[np.arange(len(rows)), best] if width > 1 else np.full(len(rows), NONE)
            over = value == NONE
            if over.any():
                done[rows[over], :width] = ids[over]
                live = ~over
                rows, ids, rank, best, value = rows[live], ids[live], rank[live], best[live], value[live]
            if not len(rows):
                return done
            at = np.arange(len(rows))
            # Every live row loses one token, so the matrix gets one column narrower.
            columns = np.arange(width - 1)
            ids = np.take_along_axis(ids, columns + (columns > best[:, None]), axis=1)
            ids[at, best] = value
            if width > 2:
                columns = np.arange(width - 2)
                rank = np.take_along_axis(rank, columns + (columns >= best[:, None]), axis=1)
                for shift in (-1, 0):
                    k = best + shift
                    ok = (k >= 0) & (k < width - 2)
                    rank[at[ok], k[ok]] = self.pairs.find(ids[at[ok], k[ok]], ids[at[ok], k[ok] + 1])

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece, with a heap of (rank, place) over linked tokens."""
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        first = self.pairs.find(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32))
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = rank, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0:
                    pair = (ids[left], ids[right])
                    if pair not in known:
                        known[pair] = int(self.pairs.find(np.array(pair[:1], np.int32), np.array(pair[1:], np.int32))[0])
                    if known[pair] != NONE:
                        heapq.heappush(heap, (known[pair], left, *pair))
        return np.array([t for t, keep in zip(ids, alive) if keep], np.int32)

    def _encode_pieces(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all pieces in some order; for each piece where its ids start there, and their number."""
        starts, counts, parts, used = np.zeros(len(raw), np.int64), np.ones(len(raw), np.int64), [], 0
        whole = np.array([self.ranks.get(b, -1) for b in raw], np.int32)
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        known = np.flatnonzero(whole >= 0)
        parts.append(whole[known])
        starts[known], used = np.arange(len(known)), len(known)
        for i in np.flatnonzero((whole < 0) & (lengths > LENGTHS[-1])):
            parts.append(self._merge_long(raw[i]))
            starts[i], counts[i], used = used, len(parts[-1]), used + len(parts[-1])
        bucket = np.where((whole < 0) & (lengths <= LENGTHS[-1]), np.searchsorted(LENGTHS, lengths), -1)
        for k, width in enumerate(LENGTHS):
            members = np.flatnonzero(bucket == k)
            for start in range(0, len(members), CELLS // width):
                part = members[start : start + CELLS // width]
                inside = np.arange(width) < lengths[part][:, None]
                ids = np.full((len(part), width), -1, np.int32)
                ids[inside] = self.single[np.frombuffer(b"".join([raw[i] for i in part]), np.uint8)]
                ids = self._merge_rows(ids)
                parts.append(ids[ids >= 0])
                counts[part] = (ids >= 0).sum(axis=1)
                starts[part] = used + np.cumsum(counts[part]) - counts[part]
                used += len(parts[-1])
        return np.concatenate(parts), starts, counts

    # --- texts -------------------------------------------------------------------------------

    def pieces_of(self, text: str) -> list[bytes] | list[str]:
        """The matches of the pattern; in one-byte characters, where that gives the same, as it is faster."""
        try:
            plain = text.encode("latin-1")
        except UnicodeEncodeError:
            return self.wide_pieces(text)
        return self.wide_pieces(text) if plain.translate(None, PLAIN) else self.plain_pieces(plain)

    def _learn(self, new: list[bytes | str]) -> None:
        raw = [p.encode() if isinstance(p, str) else p.decode("latin-1").encode() for p in new]
        ids, starts, counts = self._encode_pieces(raw)
        n, end = len(self.seen), self.used + len(ids)
        while len(self.pool) < end:
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        while len(self.starts) < n + len(new):
            self.starts = np.concatenate([self.starts, np.empty_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.empty_like(self.lengths)])
        self.pool[self.used : end] = ids
        self.starts[n : n + len(new)] = self.used + starts
        self.lengths[n : n + len(new)] = counts
        self.seen.update(zip(new, range(n, n + len(new))))
        self.used = end

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's ids start (one more entry at the end)."""
        pieces = [self.pieces_of(t) if t else [] for t in texts]
        flat = list(chain.from_iterable(pieces))
        slots = list(map(self.seen.get, flat))
        if None in slots:
            new = set(flat).difference(self.seen)
            if self.seen and len(self.seen) + len(new) > self.most_pieces:
                self._forget()
                new = set(flat)
            self._learn(list(new))
            slots = list(map(self.seen.__getitem__, flat))
        slots = np.array(slots, np.int64)
        lengths = self.lengths[slots]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.pool[np.repeat(self.starts[slots] - ends[:-1], lengths) + np.arange(ends[-1])]
        counts = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        return ids, ends[counts]

    def decode(self, ids: Sequence[int | None]) -> bytes | None:
        """The bytes of a list of ids; None if one of them is not in the vocabulary."""
        try:
            return None if min(ids, default=0) < 0 else b"".join(map(self.bytes_of.__getitem__, ids))
        except (IndexError, TypeError):
            return None


_CODECS: dict[tuple[str, str], Codec] = {}


@dataclass(frozen=True)
class Vocabulary:
    """The content of a rank file (base64 token, space, rank; one a line) and the pattern that cuts texts."""

    content: bytes
    pattern: str

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as file:
            return cls(file.read(), pattern)

    def codec(self) -> Codec:
        """The codec, made once per process."""
        key = (hashlib.sha256(self.content).hexdigest(), self.pattern)
        if key not in _CODECS:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.content.splitlines()) if a}
            _CODECS[key] = Codec(ranks, self.pattern)
        return _CODECS[key]


def encode(df: DataFrame, text: str, vocabulary: Vocabulary, ids: str = "ids", round_trip: str | None = None) -> DataFrame:
    """``df`` with the token ids of each text in column ``ids`` (replaced if it is there already).

    ``round_trip`` names a column that says whether the ids decode to the text again, found in the same pass.

    A null or empty text has no ids. Special tokens are ordinary text. Every row is kept, in any number of copies.
    The vocabulary (a megabyte, whatever the table) is read by the driver and broadcast; nothing is shuffled.
    """
    fields = [StructField(ids, ArrayType(IntegerType(), False), False)]
    schema = with_fields(df, fields + ([StructField(round_trip, BooleanType(), False)] if round_trip else []))
    arrow, shared = to_arrow_schema(schema), df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value.codec()
        for batch, texts in text_slices(batches, text, 2 << 20):
            flat, at = codec.encode(texts)
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32()))
            new = {ids: lists.cast(arrow.field(ids).type)}
            if round_trip:
                listed, ends = flat.tolist(), at.tolist()
                new[round_trip] = pa.array([codec.decode(listed[a:b]) == (t or "").encode() for a, b, t in zip(ends, ends[1:], texts)], pa.bool_())
            yield extended(batch, arrow, new)
        codec.rest()

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str, vocabulary: Vocabulary, out: str = "decoded") -> DataFrame:
    """``df`` with the bytes of each list of ids in column ``out``; null for a null list or an unknown id."""
    schema = with_fields(df, [StructField(out, BinaryType())])
    arrow, shared = to_arrow_schema(schema), df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value.codec()
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            done = [None if x is None else codec.decode(x) for x in lists]
            yield extended(batch, arrow, {out: pa.array(done, arrow.field(out).type)})

    return df.mapInArrow(run, schema)


def round_trip_digests(df: DataFrame, key: str, text: str, vocabulary: Vocabulary) -> DataFrame:
    """Encodes every text, decodes the ids, and returns counts and digests instead of the ids themselves.

    One row per row of ``df``: the key, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by a space) and
    ``decoded_sha256`` (of the decoded bytes). A null text counts as empty.
    """
    schema = StructType([df.schema[key], StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())])
    arrow, shared = to_arrow_schema(schema), df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value.codec()
        for batch, texts in text_slices(batches, text, 2 << 20):
            flat, at = codec.encode(texts)
            listed, digests, decoded = flat.tolist(), [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                own = listed[a:b]
                digests.append(hashlib.sha256(" ".join(map(codec.decimal.__getitem__, own)).encode()).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(own)).hexdigest())
            yield extended(batch, arrow, {"n_tokens": pa.array(np.diff(at)), "ids_sha256": pa.array(digests), "decoded_sha256": pa.array(decoded)})
        codec.rest()

    return df.select(key, text).mapInArrow(run, schema)


def public_vocabulary(name: str = "byte_bpe_50k.tiktoken", path: str | None = None) -> Vocabulary:
    """A vocabulary of the installed public tokenizers; ``path`` names another rank file."""
    import public_tokenizers

    return Vocabulary.read(path or public_tokenizers.path(name), public_tokenizers.PATTERN)
