"""Benchmark decontamination by a distributed positional inverted index.

Index: documents are split by rows into segments. For every segment the postings (term, position) of all tokens that any
benchmark window uses are stored, sorted by term and then position, as one row of binary columns in a table in
the shared folder; positions of neighbouring documents lie further apart than a match can reach.
Tokens no window uses can't be part of a match and aren't stored.

Search: for each window its terms are ordered from the rarest (by postings in the segment). The list of the rarest
gives candidate starts (position less offset); each further list, shifted by its own offset, is intersected
with them by binary search. What survives all lists is an exact phrase match. With a slop, a list may
hold its term up to that many positions away instead, which gives proximity matches; both come out of one pass.

Terms are 64-bit word hashes. Documents never move: there is no shuffle, and one hot document, term or passage only
lengthens lists of its own segment. Benchmark windows are broadcast in blocks of bounded size; more
windows mean more passes over the index.

Defined cases: null or wordless text has no words and no hits; items without words match nothing; a null item_id
counts for hits but not in the list of items; repeated item ids count once; an empty benchmark leaves all clean.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm._stage import lean, table, written
from freshet.llm._words import Chunk, alnum_words, chunks

#: Text of one segment and of one block of benchmark items, in bytes.
SEGMENT_BYTES = 4 << 20
BLOCK_BYTES = 8 << 20
#: Candidate starts that are checked at a time.
CANDIDATES = 1 << 20


@dataclass
class Windows:
    """A block of windows: item index, length, and term numbers in a padded matrix; terms sorted by hash."""

    items: list[str | None]
    item: np.ndarray
    length: np.ndarray
    term: np.ndarray
    vocabulary: np.ndarray

    @staticmethod
    def of(items: list[tuple[str | None, str | None]], size: int) -> Windows:
        ids, rows, which = [], [], []
        for item_id, text in items:
            for c in chunks(pa.array([text], pa.string()), alnum_words(), lower=True):
                n = len(c.hashes)
                if n:
                    ids.append(item_id)
                    for i in range(max(1, n - size + 1)):
                        rows.append(c.hashes[i : i + size])
                        which.append(len(ids) - 1)
        vocabulary = np.unique(np.concatenate(rows)) if rows else np.zeros(0, np.uint64)
        length = np.fromiter(map(len, rows), np.int64, len(rows))
        term = np.zeros((len(rows), size), np.int64)
        for i, r in enumerate(rows):
            term[i, : len(r)] = np.searchsorted(vocabulary, r)
        return Windows(ids, np.array(which, np.int64), length, term, vocabulary)


def _blocks(benchmark: DataFrame, size: int) -> list[Windows]:
    """Windows of the whole benchmark in blocks of bounded text; each is a driver object of bounded size."""
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    part = F.pmod(F.xxhash64("text"), F.lit(n))
    return [Windows.of(sorted(map(tuple, benchmark.where((part == b) & F.col("text").isNotNull()).select(F.col("item_id").cast("string"), "text").distinct().collect()), key=str), size) for b in range(n)]


def postings(c: Chunk, terms: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first position of each row, bounds of each term's list, positions by term and then place) of a chunk."""
    counts = c.counts()
    base = np.cumsum(np.r_[0, counts[:-1] + gap])
    where = np.arange(len(c.hashes)) + np.repeat(base - c.word_at[:-1], counts)
    if len(terms):
        term = np.minimum(np.searchsorted(terms, c.hashes), len(terms) - 1)
        known = np.flatnonzero(terms[term] == c.hashes)
    else:
        term = known = np.zeros(0, np.int64)
    key = (term[known].astype(np.int64) << 32) | where[known]
    key.sort()
    return base, np.searchsorted(key >> 32, np.arange(len(terms) + 1)), key & 0xFFFFFFFF


def build_index(docs: DataFrame, vocabulary: np.ndarray, gap: int) -> DataFrame:
    """One row per segment: its documents (ids, word counts, first positions) and the postings of ``vocabulary``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        for batch in batches:
            for c in chunks(batch.column(1), alnum_words(), lower=True, limit=SEGMENT_BYTES):
                counts = c.counts()
                base, lists, positions = postings(c, terms, gap)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column(0).slice(c.first, c.rows).to_pylist()], pa.list_(batch.column(0).type)),
                        pa.array([counts.astype(np.int64)], pa.list_(pa.int64())),
                        pa.array([base.astype(np.int64)], pa.list_(pa.int64())),
                        pa.array([lists.astype("<i4").tobytes()], pa.binary()),
                        pa.array([positions.astype("<u4").tobytes()], pa.binary()),
                    ],
                    names=["doc_ids", "n_words", "base", "lists", "positions"],
                )

    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_ids array<{id_type}>, n_words array<long>, base array<long>, lists binary, positions binary")


def search_segment(w: Windows, lists: np.ndarray, positions: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, start, exact) of all matches of a segment, starts as positions of the windows' first words."""
    df = np.diff(lists)
    n = len(w.length)
    if not n or not len(positions):
        none = np.zeros(0, np.int64)
        return none, none, none.astype(bool)
    size = w.term.shape[1]
    cost = np.where(np.arange(size) < w.length[:, None], df[w.term], np.iinfo(np.int64).max)
    order = np.argsort(cost, axis=1, kind="stable")
    rarest = np.take_along_axis(w.term, order[:, :1], 1)[:, 0]
    many = df[rarest]
    many = np.where(np.where(np.arange(size) < w.length[:, None], df[w.term], 1).min(axis=1) > 0, many, 0)
    keys = (np.repeat(np.arange(len(df), dtype=np.int64), df) << 32) | positions.astype(np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    i = 0
    todo = np.flatnonzero(many)
    ends = np.cumsum(many[todo])
    while i < len(todo):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + CANDIDATES, "right")))
        part = todo[i:j]
        i = j
        k = many[part]
        win = np.repeat(part, k)
        within = np.arange(len(win)) - np.repeat(np.cumsum(k) - k, k)
        start = positions[lists[rarest[win]] + within].astype(np.int64) - order[win, 0]
        exact = np.ones(len(win), bool)
        for step in range(1, size):
            live = step < w.length[win]
            off = order[win, step]
            want = (w.term[win, off] << 32) + start + off
            at = np.searchsorted(keys, want)
            right = np.abs(keys[np.minimum(at, len(keys) - 1)] - want)
            left = np.abs(keys[np.maximum(at - 1, 0)] - want)
            distance = np.where(live, np.minimum(left, right), 0)
            ok = distance <= slop
            win, start, exact = win[ok], start[ok], exact[ok] & (distance[ok] == 0)
            if not len(win):
                break
        found.append((win, start, exact))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(bool)
    return tuple(np.concatenate(x) for x in zip(*found))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, slop: int = 0) -> DataFrame:
    """One row per document: n_words, hit words as [first, end) runs, items with exact and with proximity matches."""
    spark = docs.sparkSession
    blocks = _blocks(benchmark, window)
    gap = window + 2 * slop + 2
    if len(blocks) > 1:  # a document has a row for each block of items, told apart by the place of its row in one written table
        placed = written(docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text"), "placed")
        docs = placed.select(F.col("_row").alias("doc_id"), "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    parts = []
    for w in blocks:
        index = written(build_index(docs, w.vocabulary, gap), "postings")
        shared = spark.sparkContext.broadcast(w)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in batches:
                for r in range(batch.num_rows):
                    ids, counts, base = batch.column(0)[r].values, np.array(batch.column(1)[r].values), np.array(batch.column(2)[r].values)
                    lists, positions = np.frombuffer(batch.column(3)[r].as_py(), "<i4").astype(np.int64), np.frombuffer(batch.column(4)[r].as_py(), "<u4")
                    win, start, exact = search_segment(block, lists, positions, slop)
                    rows = len(counts)
                    runs: list[list[int]] = [[] for _ in range(rows)]
                    items: list[list[str]] = [[] for _ in range(rows)]
                    near: list[list[str]] = [[] for _ in range(rows)]
                    if len(win):
                        doc = np.searchsorted(base, start + slop, "right") - 1
                        for target, chosen in ((items, exact), (near, np.ones(len(win), bool))):
                            pairs = np.unique(np.stack([doc[chosen], block.item[win[chosen]]], 1), axis=0) if chosen.any() else []
                            for d, i in pairs:
                                if block.items[i] is not None:
                                    target[d].append(block.items[i])
                        if exact.any():
                            first = (start - base[doc])[exact]
                            spans = np.unique(np.stack([doc[exact], first, first + block.length[win[exact]]], 1), axis=0)
                            for d, a, b in spans.tolist():
                                if runs[d] and runs[d][-1] >= a:
                                    runs[d][-1] = max(runs[d][-1], b)
                                else:
                                    runs[d] += [a, b]
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array(counts, pa.int64()), pa.array(runs, pa.list_(pa.int64())), pa.array([sorted(set(x)) for x in items], pa.list_(pa.string())), pa.array([sorted(set(x)) for x in near], pa.list_(pa.string()))],
                        names=["doc_id", "n_words", "runs", "items", "near_items"],
                    )

        parts.append(index.mapInArrow(lean(run), f"doc_id {id_type}, n_words long, runs array<long>, items array<string>, near_items array<string>"))
    out = parts[0]
    if len(parts) > 1:
        for p in parts[1:]:
            out = out.union(p)
        out = out.groupBy("doc_id", "n_words").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("near_items")))).alias("near_items"))
        out = out.withColumnRenamed("doc_id", "_row").join(placed.select("_row", "doc_id"), "_row").select("doc_id", "n_words", "runs", "items", "near_items")
    return out


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=2)
    return digest(found)


def digest(found: DataFrame) -> DataFrame:
    """Counts and a digest of matches(): doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = [_covered(r) for r in b.column(2).to_pylist()]
            items = b.column(3).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1),
                    pa.array(hit, pa.int64()),
                    pa.array([len(x) for x in items], pa.int64()),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
                    pa.array([h > 0 for h in hit], pa.bool_()),
                ],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    id_type = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(lean(run), f"doc_id {id_type}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def _covered(runs: list[int]) -> int:
    """Words covered by [first, end) runs, which may overlap where blocks of items met."""
    total, reach = 0, 0
    for a, b in sorted(zip(runs[::2], runs[1::2])):
        total += max(0, b - max(a, reach))
        reach = max(reach, b)
    return total


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` without the documents that hold an exact window of an item; each chunk of rows is indexed and searched in memory."""
    blocks = _blocks(benchmark, window)
    spark = docs.sparkSession
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index("text")
    out = docs.toDF(*names)
    for w in blocks:
        shared = spark.sparkContext.broadcast(w)  # BLOCK_BYTES of items at most

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for c in chunks(batch.column(at), alnum_words(), lower=True):  # small ones: tables of hashes grow with a chunk and stay
                    base, lists, positions = postings(c, block.vocabulary, window + 2)
                    _, start, _ = search_segment(block, lists, positions, 0)
                    keep[c.first + np.searchsorted(base, start, "right") - 1] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(lean(run), out.schema)
    return out.toDF(*docs.columns)
