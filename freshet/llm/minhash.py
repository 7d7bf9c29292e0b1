"""Near-duplicate detection by SuperMinHash, banding, verification on full sets and union-find grouping.

A document's set holds its distinct word shingles. Equal sets collapse first (order-free 128-bit set hash), so exact copies, however
many, are one node. SuperMinHash gives each element one random number and one slot per level, drawn without
replacement by a lazily shuffled permutation, and stops at the level that can't lower any slot any more. Here all
elements of a chunk of documents advance level by level together; a document leaves once its worst slot is below
the next level.

128 slots in 32 bands of 4: a pair at the threshold 0.8 shares no band with probability 5e-8.

Candidates are not listed pair by pair within a bucket. Rounds pick one centre per bucket (first the member with the most
bucket mates, then a seeded draw), test the members of other components against it on the full sets, and merge
what passes. Buckets within one component are finished. What then still lies in one bucket but different
components is tested pair by pair in bounded cells, where set sizes and then short shingle hashes rule pairs out that can't reach the threshold.
So no link that changes a component is lost beyond the banding's odds.

Defined cases: null, empty and wordless texts have empty sets, link with nothing and are their own component; fewer words than
a shingle count as one shingle; rows with one doc_id count as one document for links; a null doc_id takes no part
and is kept with component null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm._stage import dropped, lean, table, written
from freshet.llm._words import Chunk, chunks, mix, ngrams, space_words
from freshet.llm.components import components

SLOTS, ROWS = 128, 4
BANDS = SLOTS // ROWS
STAR_ROUNDS = 2
#: Set elements that are compared with one set at a time.
OVERLAP = 1 << 20
#: Members of a bucket that one task compares with as many others at a time.
BLOCK = 1024


def shingle_sets(c: Chunk, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each row, in row order."""
    at, h = ngrams(c, k)
    doc = c.doc_of_word()
    row = doc[at]
    short = np.flatnonzero((c.counts() > 0) & (c.counts() < k))
    if len(short):
        for size in np.unique(c.counts()[short]):
            at2, h2 = ngrams(c, int(size))
            ok = c.counts()[doc[at2]] == size
            row, h = np.r_[row, doc[at2[ok]]], np.r_[h, mix(h2[ok], 100 + int(size))]
    order = np.argsort(h)
    row, h = row[order], h[order]
    order = np.argsort(row.astype(np.uint16 if c.rows < 65536 else np.int64), kind="stable")
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def superminhash(row: np.ndarray, h: np.ndarray, rows: int, slots: int = SLOTS) -> np.ndarray:
    """The signature of each row's elements: level in the upper byte, 24 random bits below; rows without elements keep the largest value."""
    sig = np.full((rows, slots), 0xFFFFFFFF, np.uint32)
    flat = sig.reshape(-1)
    perm = np.tile(np.arange(slots, dtype=np.uint8), (len(h), 1))
    live = np.arange(len(h))
    active = np.unique(row)
    for j in range(slots):
        if not len(live):
            break
        x = mix(h[live], 1000 + j)
        k = j + (((x & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j)) >> np.uint64(32)).astype(np.int64)
        slot = perm[live, k]
        perm[live, k] = perm[live, j]
        value = (np.uint32(j) << np.uint32(24)) | (x >> np.uint64(40)).astype(np.uint32)
        np.minimum.at(flat, row[live] * slots + slot, value)
        worst = sig[active].max(axis=1)
        open_ = worst >= np.uint32(min((j + 1) << 24, 0xFFFFFFFF))
        if not open_.all():
            active = active[open_]
            still = np.zeros(rows, bool)
            still[active] = True
            live = live[still[row[live]]]
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    part = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    out = np.zeros(part.shape[:2], np.uint64)
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            out = mix(out + part[:, :, r] + np.uint64(1))
        return mix(out + np.arange(BANDS, dtype=np.uint64))


def _sum_by_row(row: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        sums = np.r_[np.uint64(0), np.cumsum(values, dtype=np.uint64)]
        at = np.searchsorted(row, np.arange(rows + 1))
        return sums[at[1:]] - sums[at[:-1]]


def fingerprints(docs: DataFrame, k: int, signatures: bool = True) -> DataFrame:
    """doc_id, set size and 128-bit set hash of each document; with signatures also its band keys."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1), space_words(), lower=True, limit=1 << 20):
                row, h = shingle_sets(c, k)
                size = np.bincount(row, minlength=c.rows)
                arrays = [
                    batch.column(0).slice(c.first, c.rows),
                    pa.array(size, pa.int64()),
                    pa.array(_sum_by_row(row, mix(h, 5), c.rows).view(np.int64)),
                    pa.array(_sum_by_row(row, mix(h, 6), c.rows).view(np.int64)),
                ]
                names = ["doc_id", "n_shingles", "h1", "h2"]
                if signatures:
                    sig = superminhash(row, h, c.rows)
                    keys = band_keys(sig).view(np.int64)
                    arrays += [
                        pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.reshape(-1))),
                    ]
                    names.append("bands")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = f"doc_id {id_type}, n_shingles long, h1 long, h2 long" + (", bands array<long>" if signatures else "")
    return docs.select("doc_id", "text").mapInArrow(lean(run), schema)


def verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union."""
    with_a = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                sets = []
                for col in (2, 3):
                    row, h = [], []
                    for c in chunks(batch.column(col), space_words(), lower=True):
                        r, x = shingle_sets(c, k)
                        row.append(r + c.first)
                        h.append(x)
                    sets.append((np.concatenate(row), np.concatenate(h)))
                n = batch.num_rows
                size_a, size_b = (np.bincount(r, minlength=n) for r, _ in sets)
                row, h = np.concatenate([s[0] for s in sets]), np.concatenate([s[1] for s in sets])
                order = np.argsort(h)
                order = order[np.argsort(row[order].astype(np.uint16), kind="stable")]
                row, h = row[order], h[order]
                both = np.bincount(row[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])], minlength=n)
                ok = pa.array(100 * both >= percent * (size_a + size_b - both))
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])

    return with_b.mapInArrow(lean(run), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, set hash (h1, h2), component_id and kept."""
    prints = written(fingerprints(docs, k), "prints")
    reps = written(
        prints.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")),
        "reps",
    )
    buckets = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    crowded = buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = written(buckets.join(crowded, "key").select("key", "band", "rep", "n").distinct(), "buckets")
    mates = members.groupBy("rep").agg(F.sum("n").alias("mates"))
    texts = written(docs.select("doc_id", "text").join(mates.select(F.col("rep").alias("doc_id")), "doc_id").distinct(), "texts")
    members2 = written(members.join(mates, "rep").select("key", "band", "rep", "mates"), "buckets")
    dropped(members)

    tested, label = [], None
    for round_ in range(STAR_ROUNDS + 1):
        known = members2 if label is None else members2.join(label.withColumnRenamed("node", "rep"), "rep", "left")
        known = known.withColumn("comp", F.coalesce(F.col("component"), F.col("rep")) if label is not None else F.col("rep"))
        draw = F.struct(F.col("mates") if round_ == 0 else F.xxhash64("rep", F.lit(round_)), "rep", "comp")
        open_ = known.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(draw).alias("centre")).where("lo < hi")
        open_ = written(open_, "open")  # a table of its own: Spark can split the crowded buckets of what is joined to it
        if round_ < STAR_ROUNDS:
            pairs = known.join(open_, "key").where("comp != centre.comp").select(F.least("rep", "centre.rep").alias("a"), F.greatest("rep", "centre.rep").alias("b")).distinct()
        else:
            rows = written(known.join(open_.select("key"), "key").select("key", "rep", "comp"), "open")
            sets = short_sets(texts.join(rows.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), k)
            pairs = _across(rows, sets.groupBy("rep").agg(F.max("shingles").alias("shingles")), percent).distinct()
        for t in tested:
            pairs = pairs.join(t, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        tested.append(pairs)
        links = verify(pairs, texts, k, percent)
        if label is not None:  # what is known goes on as stars
            links = links.union(label.select(F.col("node").alias("a"), F.col("component").alias("b")))
        label = components(links)
    grouped = reps.select("h1", "h2", "rep").join(label.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("component"))
    out = prints.select("doc_id", "n_shingles", "h1", "h2").join(grouped, ["h1", "h2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component")), "doc_id"))
    return out.select("doc_id", "n_shingles", "h1", "h2", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def short_sets(texts: DataFrame, k: int) -> DataFrame:
    """(rep, shingles): the sorted set of each text, a shingle in 4 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1), space_words(), lower=True, limit=1 << 20):
                row, h = shingle_sets(c, k)
                at = np.searchsorted(row, np.arange(c.rows + 1))
                low = (h & np.uint64(0xFFFFFFFF)).astype("<u4")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.rows), pa.array([np.unique(low[a:b]).tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())], names=["rep", "shingles"])

    return texts.select("doc_id", "text").mapInArrow(lean(run), "rep long, shingles binary")


def _across(rows: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) in one bucket but different components that may be links, hardly any of them not; a pair once for each bucket it shares.

    The sizes of the sets of short shingle hashes, then the sets themselves nearly have to reach the threshold.

    Members of a bucket's largest component needn't meet one another, so the members of the others ("few") meet all of
    the bucket: a grid of cells of at most BLOCK by BLOCK members, each compared as one matrix.
    """
    by_comp = rows.groupBy("key", "comp").agg(F.count("*").alias("n"))
    largest = by_comp.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("m"), F.sum("n").alias("all"))
    grid = largest.select("key", F.col("m.comp").alias("main"), F.ceil((F.col("all") - F.col("m.n")) / BLOCK).cast("int").alias("few_blocks"), F.ceil(F.col("all") / BLOCK).cast("int").alias("all_blocks"))
    placed = rows.join(grid, "key").join(sketches, "rep")
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    few = placed.where("comp != main").select("key", own("few_blocks").alias("i"), F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1)).alias("j"), F.lit(True).alias("few"), "rep", "comp", "shingles")
    every = placed.select("key", F.explode(F.sequence(F.lit(0), F.col("few_blocks") - 1)).alias("i"), own("all_blocks").alias("j"), F.lit(False).alias("few"), "rep", "comp", "shingles")
    cells = few.union(every).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def cell(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        is_few = rows["few"].to_numpy()
        rep, comp = rows["rep"].to_numpy(), rows["comp"].to_numpy()
        sets = [np.frombuffer(x, "<u4") for x in rows["shingles"].to_pylist()]
        size = np.array([len(x) for x in sets])
        f, e = np.flatnonzero(is_few), np.flatnonzero(~is_few)
        a, b = [], []
        for k in range(0, len(f), 32):
            part = f[k : k + 32]
            for m in range(0, len(e), 4096):
                other = e[m : m + 4096]
                small, large = np.minimum(size[part][:, None], size[other][None, :]), np.maximum(size[part][:, None], size[other][None, :])
                x, y = np.nonzero((small * 100 >= large * (percent - 1)) & (comp[part][:, None] != comp[other][None, :]))
                x, y = part[x], other[y]
                ok = _overlap(sets, x, y) * 100 >= percent - 1
                a.append(rep[x[ok]])
                b.append(rep[y[ok]])
        a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
        return np.minimum(a, b), np.maximum(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in _and_none(batches):
            if batch is None:
                now, rest = rest, None
            else:
                now = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if now is None or not now.num_rows:
                continue
            k = np.stack([now[c].to_numpy().astype(np.int64) for c in ("key", "i", "j")], 1)
            edges = np.r_[0, np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1, len(k)]
            if batch is not None:  # the last cell may go on
                rest = now.slice(edges[-2])
                edges = edges[:-1]
            found = [cell(now.slice(x, y - x)) for x, y in zip(edges[:-1], edges[1:])]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[i] for f in found])) for i in (0, 1)], names=["a", "b"])

    return cells.mapInArrow(lean(run), "a long, b long")


def _overlap(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The Jaccard similarity of sets x[i] and y[i]; x in order."""
    out = np.zeros(len(x))
    bounds = np.r_[0, np.flatnonzero(x[1:] != x[:-1]) + 1, len(x)] if len(x) else []
    for first, last in zip(bounds[:-1], bounds[1:]):
        one, i = sets[x[first]], first
        while i < last:
            j, many = i, 0
            while j < last and (j == i or many + len(sets[y[j]]) <= OVERLAP):
                many += len(sets[y[j]])
                j += 1
            others = [sets[v] for v in y[i:j]]
            size = np.array([len(o) for o in others])
            flat = np.concatenate(others)
            at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
            both = np.add.reduceat((one[at] == flat).astype(np.int64), np.cumsum(size) - size)
            out[i:j] = both / (len(one) + size - both)
            i = j
    return out


def _and_none(items: Iterator) -> Iterator:
    yield from items
    yield None


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group: the least doc_id's, rows repeated in full once."""
    kept = near_duplicates(docs, k, percent).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.where("doc_id IS NULL").unionByName(docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(docs.columns))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4).select("doc_id", "n_shingles", "component_id", "kept")
