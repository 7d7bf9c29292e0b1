"""Substring dedup: drop words inside windows that start in an earlier document too.

Prefilter: every window of W words is represented by its anchor, the least hash of the K-word grams inside it. Equal windows
have equal anchors, and neighbouring windows mostly share one, so a document has about 2 / (W - K + 2) anchors per
word. Each task counts its anchors (once per document) in count-min sketches, one for each block of the
hash space, with counters that stop at 2; a sketch travels as the lists of its cells at 1 and at 2, so a common anchor takes no more room than a rare one. The sketches of a block are merged by saturating addition. A cell never holds less than the number of
documents with an anchor (or 2), so a window is estimated repeated wherever it could be. The number of blocks follows the
number of words, so a block's load, and the share of false alarms, stay the same at every size; blocks are
joined to the anchors by a shuffle, none is broadcast. An anchor that a task meets in two documents is known to be repeated and needs no sketch.

Second pass: only windows whose anchor's estimate is two documents or more are hashed (128 bits) and exactly grouped with the least
doc_id they start in; a window is repeated if that is smaller than its own document. No repeated window is lost. They are dealt by their own hashes, so a common
passage with different words around it needn't meet in one task, and each task settles first what its own
documents tell: of equal windows only those of the least doc_id go on, the others are repeated whatever comes. Later copies of a
whole text need no windows: all their words go if they fill one.

Defined cases: null text has no words; documents shorter than a window keep all; a null doc_id is neither earlier nor
later than any and keeps all; rows with equal doc_id don't repeat each other, and equal rows get equal results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm._stage import lean, table, written
from freshet.llm._words import Chunk, chunks, joined, mix, ngrams, sliding_min, space_words

WINDOW, GRAM = 50, 12
#: A block's sketch: DEPTH rows of CELLS counters that stop at 2. With LOAD anchors a block, a lone anchor is taken for a repeated one in about 0.2 % of cases.
DEPTH, CELLS, LOAD = 3, 1 << 16, 1 << 13
#: Anchors that a task gathers before it deals them to blocks, and windows before it settles them.
GATHER = 1 << 18


def _cells(anchors: np.ndarray) -> np.ndarray:
    """The DEPTH cells of each anchor within its block."""
    x = mix(anchors, 51)
    return np.stack([((x >> np.uint64(16 * r)) & np.uint64(CELLS - 1)).astype(np.uint16) for r in range(DEPTH)], 1)


def _block(anchors: np.ndarray, blocks: int) -> np.ndarray:
    return (mix(anchors, 52) % np.uint64(blocks)).astype(np.int32)


def window_anchors(c: Chunk, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, anchor) of every window of a chunk."""
    at, h = ngrams(c, gram)
    full = np.full(len(c.hashes) + 1, np.uint64(0xFFFFFFFFFFFFFFFF))
    full[at] = h
    counts = c.counts()
    last = np.repeat(c.word_at[1:], counts) - window
    start = np.flatnonzero(np.arange(len(c.hashes)) <= last)
    if not len(start):
        return start, np.zeros(0, np.uint64)
    return start, sliding_min(full, window - gram + 1)[start]


def _doc_anchors(c: Chunk, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) without repeats within a row."""
    start, anchor = window_anchors(c, window, gram)
    row = c.doc_of_word()[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    row, anchor = row[new], anchor[new]
    order = np.lexsort((anchor, row))
    row, anchor = row[order], anchor[order]
    new = np.ones(len(row), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    return row[new], anchor[new]


def _gathered(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, anchors) of batches of (doc_id, text), about GATHER at a time."""
    ids, anchors, n = [], [], 0
    for batch in batches:
        for c in chunks(batch.column(1), space_words()):
            row, anchor = _doc_anchors(c, window, gram)
            ids.append(batch.column(0).slice(c.first, c.rows).to_numpy()[row])
            anchors.append(anchor)
            n += len(row)
            if n >= GATHER:
                yield np.concatenate(ids), np.concatenate(anchors)
                ids, anchors, n = [], [], 0
    if n:
        yield np.concatenate(ids), np.concatenate(anchors)


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal keys."""
    return np.r_[0, np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, len(sorted_keys)]


def partition_sketches(docs: DataFrame, blocks: int, window: int, gram: int) -> DataFrame:
    """(block, once, often): a task's sketch of each block, as its cells at 1 and at 2; a cell's number counts over the DEPTH rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, anchors in _gathered(batches, window, gram):
            block = _block(anchors, blocks).astype(np.int64)
            cells = _cells(anchors).astype(np.int64) + CELLS * np.arange(DEPTH)
            key, n = np.unique((block[:, None] * (DEPTH * CELLS) + cells).reshape(-1), return_counts=True)
            block, cell = (key // (DEPTH * CELLS)).astype(np.int32), (key % (DEPTH * CELLS)).astype("<u4")
            bounds = _runs(block)
            lists = [[cell[a:b][chosen[a:b]].tobytes() for a, b in zip(bounds[:-1], bounds[1:])] for chosen in (n == 1, n > 1)]
            yield pa.RecordBatch.from_arrays([pa.array(block[bounds[:-1]]), *[pa.array(x, pa.binary()) for x in lists]], names=["block", "once", "often"])

    return docs.mapInArrow(lean(run), "block int, once binary, often binary")


def merged_sketches(parts: DataFrame) -> DataFrame:
    """The merged sketch of each block as bits: which cells count two or more."""

    def merge(rows: pa.Table) -> pa.Table:
        count = np.zeros(DEPTH * CELLS, np.uint8)
        for once, often in zip(rows["once"].to_pylist(), rows["often"].to_pylist()):
            at = np.frombuffer(once, "<u4")  # no cell twice
            count[at] = np.minimum(count[at] + 1, 2)
            count[np.frombuffer(often, "<u4")] = 2
        return pa.table({"block": pa.array([rows["block"][0].as_py()], pa.int32()), "sketch": pa.array([np.packbits(count >= 2).tobytes()], pa.binary())})

    return parts.groupBy("block").applyInArrow(merge, "block int, sketch binary")


def repeated_anchors(docs: DataFrame, sketches: DataFrame, blocks: int, window: int, gram: int) -> DataFrame:
    """(doc_id, anchor): those anchors of each document that are estimated to be in two documents or more."""

    def list_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, anchor in _gathered(batches, window, gram):
            order = np.argsort(anchor, kind="stable")
            ids, anchor = ids[order].astype("<i8"), anchor[order]
            n = np.diff(_runs(anchor))
            known = np.repeat(n > 1, n)
            block = np.where(known, -1, _block(anchor, blocks))
            if known.any():  # blocks without a sketch, a different one for each document
                block[known] = -1 - (mix(ids[known].view(np.uint64), 53) >> np.uint64(34)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            ids, anchor, block = ids[order], anchor[order], block[order].astype(np.int32)
            bounds = _runs(block)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(block[bounds[:-1]]),
                    pa.array([ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary()),
                    pa.array([anchor[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary()),
                ],
                names=["block", "ids", "anchors"],
            )

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, anchors = np.frombuffer(batch.column(0)[i].as_py(), "<i8"), np.frombuffer(batch.column(1)[i].as_py(), np.uint64)
                if batch.column(2)[i].is_valid:
                    bits = np.unpackbits(np.frombuffer(batch.column(2)[i].as_py(), np.uint8)).reshape(DEPTH, CELLS)
                    cells = _cells(anchors)
                    hit = np.ones(len(ids), bool)
                    for r in range(DEPTH):
                        hit &= bits[r][cells[:, r]] == 1
                    ids, anchors = ids[hit], anchors[hit]
                if len(ids):
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(anchors.view(np.int64))], names=["doc_id", "anchor"])

    listed = docs.mapInArrow(lean(list_), "block int, ids binary, anchors binary")
    return listed.join(sketches, "block", "left").select("ids", "anchors", "sketch").mapInArrow(lean(look_up), "doc_id long, anchor long")


def candidate_windows(candidates: DataFrame, blocks: int, window: int, gram: int) -> DataFrame:
    """(block, hashes, docs, at): the windows of (doc_id, text, anchors) that have a listed anchor, 16 bytes each with their documents and places, by blocks of the hash space.

    Of equal windows that a task gathers together, only those of the least doc_id go to their block. The others are repeated whatever comes, and go without hashes to a block below 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list[np.ndarray]] = []
        n = 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            lists = batch.column(2)
            for c in chunks(batch.column(1), space_words()):
                start, anchor = window_anchors(c, window, gram)
                row = c.doc_of_word()[start]
                edges = np.searchsorted(row, np.arange(c.rows + 1))
                chosen = np.zeros(len(start), bool)
                for i in range(c.rows):
                    a, b = edges[i], edges[i + 1]
                    if a < b:
                        chosen[a:b] = np.isin(anchor[a:b], lists[c.first + i].values.to_numpy().view(np.uint64))
                if chosen.any():
                    row, start = row[chosen], start[chosen]
                    found.append([ids[c.first + row], (start - c.word_at[row]).astype(np.int32), *[ngrams(c, window, i)[1][chosen] for i in (0, 1)]])
                    n += len(row)
                if n >= GATHER:
                    yield shipped(found)
                    found, n = [], 0
        if found:
            yield shipped(found)

    def shipped(found: list[list[np.ndarray]]) -> pa.RecordBatch:
        doc, at, h1, h2 = (np.concatenate(x) for x in zip(*found))
        h = np.stack([h1, h2], 1)
        later = _later(doc, h)
        block = np.where(later, -1 - (mix(h1[:1], len(doc)) >> np.uint64(34)).astype(np.int64), (mix(h1, 54) % np.uint64(blocks)).astype(np.int64))
        order = np.argsort(block, kind="stable")
        doc, at, h, block = doc[order], at[order], h[order], block[order].astype(np.int32)
        bounds = _runs(block)
        parts = list(zip(bounds[:-1], bounds[1:]))
        return pa.RecordBatch.from_arrays(
            [pa.array(block[bounds[:-1]]), *[pa.array([b"" if skip and block[a] < 0 else x[a:b].tobytes() for a, b in parts], pa.binary()) for x, skip in ((h, True), (doc, False), (at, False))]],
            names=["block", "hashes", "docs", "at"],
        )

    return candidates.select("doc_id", "text", "anchors").mapInArrow(lean(run), "block int, hashes binary, docs binary, at binary")


def _later(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which windows have an equal one in an earlier document of these."""
    order = np.lexsort((doc, h[:, 1], h[:, 0]))
    h, sorted_doc = h[order], doc[order]
    bounds = np.r_[0, np.flatnonzero((h[1:] != h[:-1]).any(axis=1)) + 1, len(h)]
    out = np.zeros(len(doc), bool)
    out[order] = sorted_doc > np.repeat(sorted_doc[bounds[:-1]], np.diff(bounds))
    return out


def repeated_windows(windows: DataFrame) -> DataFrame:
    """(doc_id, at): the windows whose words start in an earlier document too. A block holds about as many windows at any size of the table; common ones come once from each task."""

    def group(rows: pa.Table) -> pa.Table:
        doc, at, h = (np.concatenate([np.frombuffer(x, kind) for x in rows[name].to_pylist()]) for name, kind in (("docs", "<i8"), ("at", "<i4"), ("hashes", "<u8")))
        if len(h):
            later = _later(doc, h.reshape(-1, 2))
            doc, at = doc[later], at[later]
        return pa.table({"doc_id": doc, "at": at})

    return windows.groupBy("block").applyInArrow(group, "doc_id long, at int")


def _keeps(c: Chunk, row: int, starts: np.ndarray | None, window: int) -> np.ndarray:
    n = int(c.word_at[row + 1] - c.word_at[row])
    if starts is None or not len(starts):
        return np.ones(n, bool)
    change = np.zeros(n + 1, np.int64)
    starts = starts[starts <= n - window]  # a repeated doc_id with another text brings starts of that one
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    return np.cumsum(change)[:n] == 0


def _result(texts: DataFrame, window: int, starts: bool, with_text: bool) -> DataFrame:
    """doc_id, text_key, n_words, n_removed, kept_sha256 (and the kept text) of rows with text and, if given, repeated window starts."""
    id_type = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3) if starts else None
            for c in chunks(batch.column(1), space_words()):
                removed, digest, kept = [], [], []
                raw = c.data.tobytes()
                for r in range(c.rows):
                    keep = None
                    if lists is not None and lists[c.first + r].is_valid:
                        keep = _keeps(c, r, lists[c.first + r].values.to_numpy(), window)
                    text = joined(raw[c.doc_at[r] : c.doc_at[r + 1]], keep)
                    removed.append(0 if keep is None else int((~keep).sum()))
                    digest.append(hashlib.sha256(text).hexdigest())
                    if with_text:
                        kept.append(text.decode())
                arrays = [batch.column(0).slice(c.first, c.rows), batch.column(2).slice(c.first, c.rows), pa.array(c.counts(), pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())]
                names = ["doc_id", "text_key", "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    arrays.append(pa.array(kept, pa.string()))
                    names.append("kept_text")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = f"doc_id {id_type}, text_key binary, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return texts.select("doc_id", "text", "text_key", *(["starts"] if starts else [])).mapInArrow(lean(run), schema)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, and with ``with_text`` the kept words as ``kept_text``."""
    gram = min(gram, window)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.unhex(F.md5(F.col("text").cast("binary"))).alias("text_key"))
    known = keyed.where("doc_id IS NOT NULL").select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # bytes; a word has six or so
    blocks = max(1, int(size / 6 * 2 / (window - gram + 2) / LOAD))
    # Every window of a text is repeated in its later copies: they are settled by their keys.
    ids = keyed.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text_key")
    firsts = ids.groupBy("text_key").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id < last_id")
    copies = written(ids.join(firsts, "text_key").where("doc_id > first_id").select("doc_id", "text_key").distinct(), "copies")
    sketches = merged_sketches(partition_sketches(known, blocks, window, gram))
    hits = repeated_anchors(known, sketches, blocks, window, gram).groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
    hits = hits.join(copies.groupBy("doc_id").agg(F.collect_set("text_key").alias("copy_keys")), "doc_id", "left")
    own = F.coalesce(~F.array_contains("copy_keys", F.col("text_key")), F.lit(True))
    candidates = written(keyed.join(hits, "doc_id").where(own).select("doc_id", "text", "text_key", "anchors").distinct(), "candidates")
    starts = repeated_windows(candidate_windows(candidates, blocks, window, gram)).groupBy("doc_id").agg(F.collect_set("at").alias("starts"))
    changed = _result(candidates.select("doc_id", "text", "text_key").join(starts, "doc_id"), window, True, with_text).where("n_removed > 0")
    plain = _result(keyed, window, False, with_text)
    names = plain.columns[3:]
    empty = {"n_removed": F.lit(-1).cast("long"), "kept_sha256": F.lit(hashlib.sha256(b"").hexdigest()), "kept_text": F.lit("")}
    new = changed.select("doc_id", "text_key", *names).union(copies.select("doc_id", "text_key", *[empty[n] for n in names])).toDF("doc_id", "text_key", *[f"new_{n}" for n in names])
    out = plain.join(new, ["doc_id", "text_key"], "left")
    use = F.col("new_n_removed").isNotNull() & ((F.col("new_n_removed") >= 0) | (F.col("n_words") >= window))
    merged = [F.when(use, F.when(F.col("new_n_removed") < 0, F.col("n_words")).otherwise(F.col("new_n_removed")) if n == "n_removed" else F.col(f"new_{n}")).otherwise(F.col(n)).alias(n) for n in names]
    return out.select("doc_id", "n_words", *merged)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
