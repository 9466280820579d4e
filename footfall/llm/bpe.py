"""Byte-level BPE: whole pre-tokens by a minimal perfect hash, the rest by a heap over linked bytes."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from hashlib import sha256
from struct import pack

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from footfall.llm.frames import slices, texts

# Pre-tokens and pairs of tokens whose ids a worker remembers in each of two generations: when the younger is full, it
# takes the place of the older. The longest pre-token that is remembered.
MEMO_TOKENS = 150_000
PAIR_MEMO = 100_000
MEMO_CHARS = 64
# Characters whose new pre-tokens are looked up together.
GROUP_CHARS = 1 << 18


class PerfectHash:
    """A minimal perfect hash of byte strings: n keys on n slots, by hash and displace.

    Keys fall into buckets of about four. Buckets, largest first, get the smallest seed that sends all their
    keys to free slots. A slot holds its key's place; a look-up compares the key itself, so strings outside
    the set are never mistaken for members.
    """

    def __init__(self, keys: list[bytes]):
        if len(set(keys)) != len(keys):
            raise ValueError("keys must be distinct")
        self.size = len(keys)
        self.buckets = max(1, self.size // 4)
        hashes = _hashes(keys)
        bucket = (hashes >> np.uint64(32)) % np.uint64(self.buckets)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(self.buckets + 1, dtype=np.uint64))
        self.seeds = np.zeros(self.buckets, np.int64)
        slots = np.full(self.size, -1, np.int64)
        for b in np.argsort(-np.diff(bounds), kind="stable").tolist():
            members = order[bounds[b] : bounds[b + 1]]
            if len(members) == 1:  # buckets of one come last and take what slots are left
                break
            at, tries = 0, 16
            while len(members):
                seeds = np.arange(at, at + tries)
                where = self._slot(hashes[members][:, None], seeds)
                spread = np.sort(where, axis=0)
                good = (slots[where] < 0).all(axis=0) & (spread[1:] != spread[:-1]).all(axis=0)
                if good.any():
                    seed = int(good.argmax())
                    slots[where[:, seed]], self.seeds[b] = members, at + seed
                    break
                at, tries = at + tries, 1024
        placed = np.zeros(self.size, bool)
        placed[slots[slots >= 0]] = True
        singles, free = np.flatnonzero(~placed), np.flatnonzero(slots < 0)
        slots[free] = singles
        self.seeds[bucket[singles].astype(np.int64)] = -1 - free
        self.keys = [keys[i] for i in slots.tolist()]
        self.places = slots
        # For look-ups of one key.
        self._seeds, self._places = self.seeds.tolist(), slots.tolist()

    def _slot(self, hashes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        """The slot of a hash under its bucket's seed; a negative seed names the slot itself."""
        with np.errstate(over="ignore"):
            mixed = (hashes ^ (seeds + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        return np.where(seeds < 0, -1 - seeds, ((mixed ^ mixed >> np.uint64(31)) % np.uint64(self.size)).astype(np.int64))

    def find(self, keys: list[bytes]) -> list[int]:
        """The place of each key in the list given at the start, -1 for strings that are not in it."""
        if not keys or not self.size:
            return [-1] * len(keys)
        hashes = _hashes(keys)
        slots = self._slot(hashes, self.seeds[((hashes >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)])
        own = self.keys
        return [place if own[s] == key else -1 for s, place, key in zip(slots.tolist(), self.places[slots].tolist(), keys)]

    def find_one(self, key: bytes) -> int:
        """`find` of one key, without arrays."""
        if not self.size:
            return -1
        hashed = xxhash.xxh3_64_intdigest(key)
        seed = self._seeds[(hashed >> 32) % self.buckets]
        if seed < 0:
            slot = -1 - seed
        else:
            mixed = (hashed ^ (seed + 1) * 0x9E3779B97F4A7C15 & _WORD) * 0xBF58476D1CE4E5B9 & _WORD
            slot = (mixed ^ mixed >> 31) % self.size
        return self._places[slot] if self.keys[slot] == key else -1


_WORD = 2**64 - 1


def _hashes(keys: list[bytes]) -> np.ndarray:
    hashed = xxhash.xxh3_64_intdigest
    return np.fromiter((hashed(k) for k in keys), np.uint64, len(keys))


class Codec:
    """Encodes and decodes by the ranks of a vocabulary; ``pattern`` splits a text into pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        tokens = list(ranks)
        self.ids = np.array([ranks[t] for t in tokens], "<u4")
        self.hash = PerfectHash(tokens)
        self.pattern = pattern
        top = max(ranks.values(), default=-1) + 1
        by_id = [b""] * top
        for token, rank in ranks.items():
            by_id[rank] = token
        self.lengths = np.array([len(t) for t in by_id], np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.lengths)[:-1])).astype(np.int64) if top else np.zeros(0, np.int64)
        self.by_id = by_id
        self.of_byte = [ranks[bytes([b])] for b in range(256)]
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.packed = [id_.tobytes() for id_ in self.ids]
        self.ranks = self.ids.tolist()
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[str, bytes] = {}
        self.old_memo: dict[str, bytes] = {}
        self.pairs: dict[int, int] = {}
        self.old_pairs: dict[int, int] = {}

    def __getstate__(self):
        return self.__dict__ | {"memo": {}, "old_memo": {}, "pairs": {}, "old_pairs": {}}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out, at = [], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and size < GROUP_CHARS:
                size += len(texts[end])
                end += 1
            out += self._encode_group(texts[at:end])
            at = end
        return out

    def _encode_group(self, texts: list[str]) -> list[bytes]:
        """The texts' new pre-tokens are looked up all at once."""
        split = regex.compile(self.pattern).findall
        if len(self.memo) > MEMO_TOKENS:
            self.memo, self.old_memo = {}, self.memo
        if len(self.pairs) > PAIR_MEMO:
            self.pairs, self.old_pairs = {}, self.pairs
        memo, old = self.memo, self.old_memo
        pieces = [split(text) for text in texts]
        fresh = [p for p in set().union(*pieces) if p not in memo]
        missing = [p for p in fresh if p not in old]
        found = {p: old[p] for p in fresh if p in old}
        found.update(zip(missing, self._ids_of(missing)))
        long = {p: found.pop(p) for p in missing if len(p) > MEMO_CHARS}
        memo.update(found)
        if not long:
            return [b"".join(map(memo.__getitem__, own)) for own in pieces]
        return [b"".join([long[p] if p in long else memo[p] for p in own]) for own in pieces]

    def _ids_of(self, pieces: list[str]) -> list[bytes]:
        raw = [p.encode() for p in pieces]
        packed, merge = self.packed, self._merge
        return [packed[place] if place >= 0 else merge(token) for place, token in zip(self.hash.find(raw), raw)]

    def _pair(self, left: int, right: int) -> int:
        """The rank of two tokens' concatenation by the perfect hash, -1 if it is no token; remembered."""
        key = left << 32 | right
        rank = self.old_pairs.get(key)
        if rank is None:
            place = self.hash.find_one(self.by_id[left] + self.by_id[right])
            rank = self.ranks[place] if place >= 0 else -1
        self.pairs[key] = rank
        return rank

    def _merge(self, token: bytes) -> bytes:
        """Ids of a pre-token outside the vocabulary: bytes in a linked list, pairs in a heap by rank and place."""
        of_byte = self.of_byte
        parts = [of_byte[b] for b in token]
        last = len(parts)
        after = list(range(1, last + 1))
        before = list(range(-1, last - 1))
        known, pair = self.pairs.get, self._pair
        push, pop = heapq.heappush, heapq.heappop
        # The rank of every part's pair with the next; a heap entry with another rank is stale.
        joined = [-1] * last
        heap = []
        left = parts[0]
        for i in range(1, last):
            right = parts[i]
            rank = known(left << 32 | right)
            if rank is None:
                rank = pair(left, right)
            if rank >= 0:
                joined[i - 1] = rank
                heap.append((rank, i - 1))
            left = right
        heapq.heapify(heap)
        while heap:
            rank, i = pop(heap)
            if joined[i] != rank:
                continue
            j = after[i]
            parts[i], parts[j], joined[j] = rank, -1, -1
            after[i] = k = after[j]
            found = -1
            if k < last:
                before[k] = i
                found = known(rank << 32 | parts[k])
                if found is None:
                    found = pair(rank, parts[k])
                if found >= 0:
                    push(heap, (found, i))
            joined[i] = found
            h = before[i]
            if h >= 0:
                found = known(parts[h] << 32 | rank)
                if found is None:
                    found = pair(parts[h], rank)
                joined[h] = found
                if found >= 0:
                    push(heap, (found, h))
        kept = [p for p in parts if p >= 0]
        return pack(f"<{len(kept)}I", *kept)

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for, copied by place in blocks."""
        every = np.frombuffer(ids, "<u4")
        out = []
        for at in range(0, len(every), 1 << 17):
            block = every[at : at + (1 << 17)]
            sizes = self.lengths[block]
            ends = np.cumsum(sizes)
            places = np.repeat(self.offsets[block] - (ends - sizes), sizes) + np.arange(int(ends[-1]))
            out.append(self.bytes[places].tobytes())
        return b"".join(out)


def load_codec(path: str, pattern: str) -> Codec:
    """A codec from a file of base64 tokens and ranks, one a line."""
    with open(path, "rb") as lines:
        return Codec({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}, pattern)


def encode_texts(docs: DataFrame, codec: Codec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit integers) of every row.

    Every match of the codec's pattern is encoded separately, without special tokens. NULL and empty texts
    have no ids; ids of rows may be NULL or repeat. The codec (a vocabulary, of fixed size) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(codec)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = shared.value.encode([_text(t) for t in batch.column("text").to_pylist()])
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "n_tokens", "ids"],
            )

    return texts(docs, id_col, text_col).mapInArrow(encode, "doc_id long, n_tokens long, ids binary")


def decode_ids(encoded: DataFrame, codec: Codec) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of its ``ids``; a NULL is decoded to nothing."""
    shared = encoded.sparkSession.sparkContext.broadcast(codec)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            decoded = [shared.value.decode(i or b"") for i in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column(c) for c in ("doc_id", "n_tokens", "ids")] + [pa.array(decoded, pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(decode, "doc_id long, n_tokens long, ids binary, decoded binary")


def token_digests(docs: DataFrame, codec: Codec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens`` and the SHA-256 of the ids and of the bytes decoded from them.

    What `encode_texts` and `decode_ids` give, digested in the same worker, so ids and bytes need not leave it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(codec)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, hashes, decoded = [], [], []
            codec_ = shared.value
            for ids in codec_.encode([_text(t) for t in batch.column("text").to_pylist()]):
                sizes.append(len(ids) // 4)
                hashes.append(sha256(ids).hexdigest())
                decoded.append(sha256(codec_.decode(ids)).hexdigest())
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
            yield pa.record_batch(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return texts(docs, id_col, text_col).mapInArrow(digest, schema)


def _text(raw: bytes | None) -> str:
    return (raw or b"").decode("utf-8", "replace")


def public_codec(name: str = "byte_bpe_50k.tiktoken", path: str | None = None) -> Codec:
    """The codec of a vocabulary file; without ``path``, the installed file of that name."""
    import public_tokenizers

    return load_codec(path or public_tokenizers.path(name), public_tokenizers.PATTERN)
