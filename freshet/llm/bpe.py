"""Byte-level BPE encoding and decoding by a file of merge ranks.

Texts split into pieces by the vocabulary's pattern. Within a piece a segment tree over its byte positions holds,
for each position, the rank of the pair that starts there (none: a large number); every inner node keeps the
leftmost minimum of its children. A merge takes the root's position, joins it with its live right neighbour and
updates the leaves of at most three positions, each along one path to the root. Trees of the distinct pieces of a
batch are stacked into one array per size class and advanced together, so a merge costs logarithmic numpy work
for all of them; a single huge piece is just a stack of one.

Defined cases: null text is empty and gives no ids; repeated rows give equal results; special tokens are ordinary
text. Ids that are not in the vocabulary make ``decode`` raise KeyError.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm._stage import lean, table

NONE = np.int64(1 << 40)
#: Distinct pieces remembered by a Python worker; beyond it the memory starts anew (results don't change).
CACHE_PIECES = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary file: a token in base64 and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.split = regex.compile(pattern).findall
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.byte_id = np.full(256, -1, np.int64)
        for token, rank in ranks.items():
            if len(token) == 1:
                self.byte_id[token[0]] = rank
        if (self.byte_id < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = rank
        # An open-addressing table; keys spread by a multiplicative hash.
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(pairs)) * 4))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int64)
        keys, values = np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs))
        slot = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):  # place what finds its slot free, move the rest on by one
            free = left[self.keys[slot[left]] == -1]
            self.keys[slot[free]] = keys[free]
            self.values[slot[free]] = values[free]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
        self.known: dict[bytes, bytes] = {}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of joining tokens a and b, NONE where no merge does."""
        keys = a * self.size + b
        slot = self._slot(keys)
        out = np.full(len(keys), NONE, np.int64)
        left = np.arange(len(keys))
        while len(left):
            found = self.keys[slot[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (found != -1)]
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Each piece's ids as packed little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        groups: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif piece:
                groups.setdefault(max(1, (len(piece) - 1).bit_length()), []).append(i)
        for level, members in groups.items():
            step = max(1, (1 << 17) >> level)  # bounds the stacked arrays
            for k in range(0, len(members), step):
                part = members[k : k + step]
                for i, ids in zip(part, self._merge([pieces[i] for i in part], level)):
                    out[i] = ids
        return out

    def _merge(self, pieces: list[bytes], level: int) -> list[bytes]:
        n, width = len(pieces), 1 << level
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        inside = np.arange(width) < lengths[:, None]
        ids = np.full((n, width), -1, np.int64)
        ids[inside] = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.tile(np.arange(1, width + 1, dtype=np.int64), (n, 1))  # next live position
        before = np.tile(np.arange(-1, width - 1, dtype=np.int64), (n, 1))
        # Tree: leaves at width..2*width-1; a value is rank * width + position, so its minimum is the leftmost one.
        tree = np.full((n, 2 * width), NONE * width, np.int64)
        row, at = np.nonzero(inside[:, 1:])
        ranks = self.pair_ranks(ids[row, at], ids[row, at + 1])
        tree[row, width + at] = np.where(ranks < NONE, ranks * width + at, NONE * width)
        for k in range(level - 1, -1, -1):
            a, b = 1 << k, 2 << k
            tree[:, a:b] = np.minimum(tree[:, b : 2 * b : 2], tree[:, b + 1 : 2 * b : 2])

        def put(rows: np.ndarray, pos: np.ndarray, value: np.ndarray) -> None:
            node = pos + width
            tree[rows, node] = value
            for _ in range(level):
                node >>= 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        live = np.arange(n)
        while True:
            top = tree[live, 1]
            live = live[top < NONE * width]
            if not len(live):
                break
            top = tree[live, 1]
            pos, rank = top % width, top // width
            gone = after[live, pos]
            ids[live, pos] = rank
            ids[live, gone] = -1
            nxt = after[live, gone]
            after[live, pos] = nxt
            has = nxt < lengths[live]
            before[live[has], nxt[has]] = pos[has]
            put(live, gone, np.full(len(live), NONE * width))
            value = np.full(len(live), NONE * width)
            if has.any():
                r = self.pair_ranks(rank[has], ids[live[has], nxt[has]])
                value[has] = np.where(r < NONE, r * width + pos[has], NONE * width)
            put(live, pos, value)
            prev = before[live, pos]
            has = prev >= 0
            if has.any():
                rows, p = live[has], prev[has]
                r = self.pair_ranks(ids[rows, p], rank[has])
                put(rows, p, np.where(r < NONE, r * width + p, NONE * width))
        kept = ids >= 0
        flat = ids[kept].astype("<u4").tobytes()
        ends = np.cumsum(kept.sum(axis=1)).tolist()
        out, a = [], 0
        for b in ends:
            out.append(flat[4 * a : 4 * b])
            a = b
        return out

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text."""
        if len(self.known) > CACHE_PIECES:
            self.known.clear()
        known = self.known
        split = [self.split(t) if t else [] for t in texts]
        new = {p for pieces in split for p in pieces if p not in known}
        if new:
            new = list(new)
            known.update(zip(new, self.encode_pieces([p.encode() for p in new])))
        get = known.__getitem__
        return [b"".join(map(get, pieces)) for pieces in split]

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    return Encoder(read_ranks(path), pattern)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def _small(batch: pa.RecordBatch, at: int, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``limit`` bytes of text, whole rows each."""
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False))
    i, done = 0, 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(sizes, done + limit, "right")))
        yield batch.slice(i, j - i)
        done, i = int(sizes[j - 1]), j


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, text: str = "text", ids: str = "token_ids", digests: bool = False) -> DataFrame:
    """``docs`` with an array column ``ids``; ``digests``: instead with n_tokens and SHA-256 of the ids and of the decoded bytes."""
    path, pattern = path or default_vocabulary()[0], pattern or default_vocabulary()[1]
    at = docs.columns.index(text)
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    kept = [c for i, c in enumerate(names) if not (digests and i == at)]
    added = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "token_ids array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in (s for b in batches for s in _small(b, at)):
            packed = enc.encode_batch(batch.column(at).to_pylist())
            if digests:
                more = [
                    pa.array([len(p) // 4 for p in packed], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
                    pa.array([hashlib.sha256(enc.decode(p)).hexdigest() for p in packed], pa.string()),
                ]
            else:
                flat = np.frombuffer(b"".join(packed), "<u4").astype(np.int64)
                ends = np.cumsum([0, *(len(p) // 4 for p in packed)])
                more = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))]
            arrays = [batch.column(i) for i, c in enumerate(names) if c in kept] + more
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *[a.split()[0] for a in added.split(", ")]])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in plain.select(*kept).schema], added])
    out = plain.mapInArrow(lean(run), schema)
    back = dict(zip(names, docs.columns))
    return out.select(*[F.col(c).alias(back.get(c, ids if c == "token_ids" else c)) for c in out.columns])


def decode(tokens: DataFrame, path: str | None = None, ids: str = "token_ids", text: str = "text") -> DataFrame:
    """``tokens`` with the text (UTF-8, broken sequences replaced) of an array column of ids in place of that column."""
    path = path or default_vocabulary()[0]
    pattern = default_vocabulary()[1]
    at = tokens.columns.index(ids)
    names = [f"c{i}" for i in range(len(tokens.columns))]
    plain = tokens.toDF(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            texts = [b"".join(enc.bytes_of[i] for i in row).decode("utf-8", "replace") if row is not None else None for row in batch.column(at).to_pylist()]
            arrays = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = ", ".join(f"`{f.name}` {'string' if i == at else f.dataType.simpleString()}" for i, f in enumerate(plain.schema))
    return plain.mapInArrow(lean(run), schema).toDF(*[text if i == at else c for i, c in enumerate(tokens.columns)])


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), digests=True)
