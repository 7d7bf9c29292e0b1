"""Toxicity by class-conditional Kneser-Ney models.

Both classes, toxic and ordinary, have a model of words given the word before, which backs off from the pair of words to the
word and on to its stem, the first STEM bytes. The counts are Kneser-Ney's: a pair counts the texts that hold it, a word the different words before
it, a stem the different words that begin with it; so a passage that is copied often counts once for most of its words. Each level's discount D is n1 / (n1 + 2 n2) of
its own counts of counts. Both classes are brought to the same mass (words and stems: what the discount leaves; pairs: the texts' pairs that end in the word before), and what the discount takes from a unit goes back to it
in both classes alike, as one backoff count of D, tilted by what the level below says. The normalisers then cancel, and of a unit with discounted counts t and o in the two classes the ratio of log-likelihoods is

    ratio = ln(t + D * exp(below / 2)) - ln(o + D * exp(-below / 2))

A unit within PRUNE of the level below says what that level says, and isn't kept; nor is a pair that one text alone holds. What no level knows says nothing.

A text's evidence is the difference of the classes' log-likelihoods divided by length: over the whole text, and over its most suspicious passages of PASSAGES
words. A logistic calibration turns these into the score; it grows with each of them unless the calibration rows say otherwise.

Labels are learnt from all rows with crc32(doc_id) mod 5 in 1 to 3 (the counts; grouped and joined, never collected), and the calibration from at most CALIBRATION_ROWS
rows with 4, drawn by a hash of doc_id. Scores use the text alone. Labels of at most LABEL_BYTES are broadcast to find their texts, others joined. A model of at most MODEL_BYTES is broadcast; of a larger one, each batch of BATCH_BYTES
of text fetches the units it holds. Either way the scores are the same.

Defined cases: null and empty text have no evidence and get the calibration's base score; a null doc_id counts as not held out; without
labels of both classes every score is 0; without both among the calibration rows, fixed weights hold; contradicting labels of one doc_id, or of one text, count as
toxic; a text with several labelled rows counts once, by its least doc_id, rows repeated in full each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm._stage import dropped, free_name, lean, table, trim, written
from freshet.llm._words import Chunk, alnum_words, chunks, mix

#: Bytes of a word's stem; they are the upper part of its number.
STEM = 5
PASSAGES = (1, 3)
PRUNE = 0.3
CALIBRATION_ROWS = 20_000
MODEL_BYTES = LABEL_BYTES = 64 << 20
#: Beyond MODEL_BYTES: units in a block of the model, bytes of the sieve at most, and bytes of text that ask for their units together.
BLOCK_UNITS, FILTER_BYTES, BATCH_BYTES = 1 << 17, 32 << 20, 16 << 20
#: Without calibration rows of both classes: base, passages, whole text.
FIXED_WEIGHTS = (-6.0, 1.5, 0.0, 0.0)
#: Stands before the first word.
START = -1
#: Pairs a task counts together before it ships them.
GATHER = 1 << 19
LEVELS = ("pair", "word", "stem")


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(-1))


def word_numbers(c: Chunk) -> np.ndarray:
    """A number for each word: STEM bytes of it, then 24 bits of its hash."""
    out = np.zeros(len(c.hashes), np.uint64)
    for k in range(STEM):
        byte = np.where(c.start + k < c.end, c.data[np.minimum(c.start + k, len(c.data) - 1)], 0) if len(c.data) else out
        out = (out << np.uint64(8)) | byte.astype(np.uint64)
    return (out << np.uint64(24)) | (c.hashes & np.uint64(0xFFFFFF))


def _as_before(word: Column) -> Column:
    return (word.bitwiseAND(0xFFFFFF) + F.shiftleft(F.shiftrightunsigned(word, 24) % 251, 24)).cast("long")


def words_before(c: Chunk, word: np.ndarray) -> np.ndarray:
    """The word before each, in 32 bits: enough to tell those of one word apart."""
    short = ((word & np.uint64(0xFFFFFF)) + (((word >> np.uint64(24)) % np.uint64(251)) << np.uint64(24))).astype(np.int64)
    out = np.full(len(word), START, np.int64)
    out[1:] = short[:-1]
    out[c.word_at[:-1][c.counts() > 0]] = START
    return out


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(before.astype(np.int64).view(np.uint64), 61) + word, 62)


def word_keys(word: np.ndarray) -> np.ndarray:
    return mix(word, 63)


def stem_keys(stem: np.ndarray) -> np.ndarray:
    return mix(stem, 64)


def unit_keys(c: Chunk) -> np.ndarray:
    """The unit of every level at each word: words x LEVELS."""
    word = word_numbers(c)
    return np.stack([pair_keys(words_before(c, word), word), word_keys(word), stem_keys(word >> np.uint64(24))], 1)


@dataclass
class Model:
    """Sorted units of every level with their ratios, from pairs to the shortest stems, as arrays or, if too large for that, as a table (unit, ratio); and the calibration."""

    units: np.ndarray
    ratios: np.ndarray
    table: DataFrame | None = None
    weights: np.ndarray = field(default_factory=lambda: np.array(FIXED_WEIGHTS))

    def evidence(self, units: np.ndarray) -> np.ndarray:
        """The ratio of each word, by the longest unit that is known."""
        out = np.zeros(len(units))
        left = np.arange(len(units))
        for level in range(units.shape[1] if len(self.units) else 0):
            want = units[left, level]
            at = np.minimum(np.searchsorted(self.units, want), len(self.units) - 1)
            hit = self.units[at] == want
            out[left[hit]] = self.ratios[at[hit]]
            left = left[~hit]
        return out

    def features(self, c: Chunk) -> np.ndarray:
        """The best means over PASSAGES words, and the mean over all, of each row; a shorter text counts as filled up with words that say nothing."""
        counts = c.counts()
        sums = np.r_[0.0, np.cumsum(self.evidence(unit_keys(c)))]
        total = sums[c.word_at[1:]] - sums[c.word_at[:-1]]
        out = np.zeros((c.rows, len(PASSAGES) + 1))
        out[:, -1] = total / np.maximum(counts, 1)
        for i, p in enumerate(PASSAGES):
            best = total / p
            if len(c.hashes) >= p:
                mean = (sums[p:] - sums[:-p]) / p
                at = np.arange(len(mean))
                row = np.searchsorted(c.word_at, at, "right") - 1
                ok = at + p <= c.word_at[row + 1]
                peak = np.full(c.rows, -np.inf)
                np.maximum.at(peak, row[ok], mean[ok])
                best = np.where(np.isfinite(peak), peak, best)
            out[:, i] = best
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        z = self.weights[0] + features @ self.weights[1:]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


# Counts


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, h, toxic, fold): one labelled row of each text (h: its hash), from the folds open to learning; written."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).withColumn("fold", fold(F.col("doc_id")).cast("int")).where("fold > 0")
    known = written(known, "labels")
    keyed = docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("h"), F.octet_length("text").alias("n")).join(known, "doc_id")
    one = keyed.groupBy("h", "n").agg(F.min(F.struct("doc_id", "fold")).alias("r"), F.max("toxic").alias("toxic"))
    out = written(one.select("r.doc_id", "h", "toxic", "r.fold"), "labelled")
    dropped(known)
    return out


def counts(texts: DataFrame) -> DataFrame:
    """What all pairs of ``texts`` (text, toxic) come to, as parts that add up: rows with ``before`` are the pairs that two texts or more hold, with the texts of each class (t, o);
    rows without it are words, with their different words before (t, o), their pairs in all (nt, no), and how many of these counts are 1 and 2 (ones, twos).

    Each pair is in one partition of Spark's grouping; so only its partition's sums go on, not the pairs.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        for batch in batches:
            for c in chunks(batch.column(0), alnum_words(), lower=True):
                label = batch.column(1).slice(c.first, c.rows).to_numpy(zero_copy_only=False)
                row, word = c.doc_of_word(), word_numbers(c)
                before = words_before(c, word)
                order = np.lexsort((word, before, row))
                row, word, before = row[order], word[order], before[order]
                new = np.ones(len(row), bool)  # once a text
                new[1:] = (word[1:] != word[:-1]) | (before[1:] != before[:-1]) | (row[1:] != row[:-1])
                held.append(np.stack([before[new], word[new].view(np.int64), label[row[new]].astype(np.int64)], 1))
                n += len(held[-1])
                if n >= GATHER:
                    yield shipped(held)
                    held, n = [], 0
        if n:
            yield shipped(held)

    def shipped(held: list[np.ndarray]) -> pa.RecordBatch:
        part = np.concatenate(held)
        part = part[np.lexsort((part[:, 1], part[:, 0]))]
        first = np.flatnonzero(np.r_[True, (part[1:, :2] != part[:-1, :2]).any(axis=1)])
        n = np.diff(np.r_[first, len(part)])
        toxic = np.add.reduceat(part[:, 2], first)
        return pa.RecordBatch.from_arrays([pa.array(part[first, 0]), pa.array(part[first, 1]), pa.array((toxic << 32) + n - toxic)], names=["before", "word", "n"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        for batch in batches:
            held.append(np.stack([batch.column(i).to_numpy() for i in range(3)], 1))
            n += len(held[-1])
            if n >= GATHER:
                yield summed(held)
                held, n = [], 0
        if n:
            yield summed(held)

    def summed(held: list[np.ndarray]) -> pa.RecordBatch:
        before, word, n = np.concatenate(held).T
        t, o = n >> 32, n & 0xFFFFFFFF
        some = t + o > 1
        order = np.argsort(word, kind="stable")
        first = np.flatnonzero(np.r_[True, word[order][1:] != word[order][:-1]])
        by_word = [np.add.reduceat(x[order].astype(np.int64), first) for x in (t > 0, o > 0, t, o, (t == 1).astype(np.int64) + (o == 1), (t == 2).astype(np.int64) + (o == 2))]
        none = np.zeros(int(some.sum()), np.int64)
        columns = [np.r_[a, b] for a, b in zip([word[some], t[some], o[some], none, none, none, none], [word[order][first], *by_word])]
        where = pa.concat_arrays([pa.array(before[some]), pa.nulls(len(first), pa.int64())])
        return pa.RecordBatch.from_arrays([where, *map(pa.array, columns)], names=["before", "word", "t", "o", "nt", "no", "ones", "twos"])

    grouped = texts.select("text", "toxic").mapInArrow(lean(pairs), "before long, word long, n long").groupBy("before", "word").agg(F.sum("n").alias("n"))
    return grouped.mapInArrow(lean(parts), "before long, word long, t long, o long, nt long, no long, ones long, twos long")


# Ratios


def _discount(level: DataFrame) -> tuple[float, float, float]:
    """(D, discounted mass of toxic, of ordinary counts) of a level."""
    one = lambda k: (F.col("t") == k).cast("long") + (F.col("o") == k).cast("long")
    r = level.agg(F.sum(one(1)).alias("n1"), F.sum(one(2)).alias("n2"), F.sum("t").alias("t"), F.sum("o").alias("o"), F.count_if(F.col("t") > 0).alias("kt"), F.count_if(F.col("o") > 0).alias("ko")).first()
    d = discount(r["n1"] or 0, r["n2"] or 0)
    return d, (r["t"] or 0) - d * r["kt"], (r["o"] or 0) - d * r["ko"]


def discount(n1: int, n2: int) -> float:
    return n1 / (n1 + 2 * n2) if n1 else 0.5


def _ratio(d: float, scale_t: Column, scale_o: Column, below: Column) -> Column:
    side = lambda n, scale, sign: F.log(F.greatest(F.col(n) - d, F.lit(0.0)) * scale + d * F.exp(sign * below / 2))
    return side("t", scale_t, 1) - side("o", scale_o, -1)


def _scales(mass_t: Column, mass_o: Column) -> tuple[Column, Column]:
    """What brings both masses to the smaller of them."""
    least = F.least(mass_t, mass_o)
    return tuple(F.when(m > 0, least / m).otherwise(0.0) for m in (mass_t, mass_o))


def ratios(parts: DataFrame) -> DataFrame:
    """(level, before, unit, ratio, below) of all units of counts()."""
    sums = [F.sum(c).alias(c) for c in ("t", "o", "nt", "no", "ones", "twos")]
    words = written(parts.where("before IS NULL").groupBy("word").agg(*sums).withColumn("stem", F.shiftrightunsigned("word", 24)), "words")
    stems = _level(words.groupBy("stem").agg(F.count_if(F.col("t") > 0).alias("t"), F.count_if(F.col("o") > 0).alias("o")).withColumn("below", F.lit(0.0)))[0]
    known, scale_t, scale_o = _level(words.join(stems.select("stem", F.col("says").alias("below")), "stem"))
    mass = known.groupBy(_as_before(F.col("word")).alias("before")).agg(F.sum("nt").alias("mt"), F.sum("no").alias("mo"))
    n = words.agg(F.sum("ones"), F.sum("twos")).first()
    d = discount(n[0] or 0, n[1] or 0)
    # A pair's partition is one, so its row is whole.
    often = parts.where("before IS NOT NULL").join(known.select("word", F.col("says").alias("below")), "word").join(mass, "before", "left")
    scales = [F.when(F.col("before") == START, F.lit(whole)).otherwise(s) for whole, s in zip((scale_t, scale_o), _scales(F.col("mt"), F.col("mo")))]
    pairs = often.withColumn("ratio", _ratio(d, *scales, F.col("below")))
    shown = lambda df, level, before, unit: df.select(F.lit(level).alias("level"), before.alias("before"), F.col(unit).alias("unit"), "ratio", "below")
    none = F.lit(0).cast("long")
    return shown(pairs, "pair", F.col("before"), "word").unionByName(shown(known, "word", none, "word")).unionByName(shown(stems, "stem", none, "stem"))


def _level(level: DataFrame) -> tuple[DataFrame, float, float]:
    """``level`` (t, o, below) with the ratio and what the unit says after pruning, written; and the scales of both classes."""
    d, mass_t, mass_o = _discount(level)
    least = min(mass_t, mass_o)
    scale_t, scale_o = (least / m if m > 0 else 0.0 for m in (mass_t, mass_o))
    own = level.withColumn("ratio", _ratio(d, F.lit(scale_t), F.lit(scale_o), F.col("below")))
    return written(own.withColumn("says", F.when(_tells(), F.col("ratio")).otherwise(F.col("below"))), "level"), scale_t, scale_o


def _tells() -> Column:
    return F.abs(F.col("ratio") - F.col("below")) >= PRUNE


def pruned(all_: DataFrame) -> DataFrame:
    """(unit, ratio) of the units that say more than the level below, by their keys, as in unit_keys()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            level = np.array(b.column(0).to_pylist(), object)
            before, unit = b.column(1).to_numpy(), b.column(2).to_numpy().view(np.uint64)
            key = np.where(level == "pair", pair_keys(before, unit), np.where(level == "word", word_keys(unit), stem_keys(unit)))
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.uint64).view(np.int64)), b.column(3)], names=["unit", "ratio"])

    kept = all_.where(_tells()).select("level", "before", "unit", "ratio")
    return kept.mapInArrow(lean(run), "unit long, ratio double").groupBy("unit").agg(F.max("ratio").alias("ratio"))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (base first) of a ridge logistic regression by Newton's method."""
    a = np.c_[np.ones(len(x)), x]
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        penalty = ridge * np.r_[0, np.ones(x.shape[1])]
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + np.diag(penalty + 1e-9), a.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, model_bytes: int = MODEL_BYTES) -> Model | None:
    """Fit on the labelled rows; None without documents of both classes."""
    chosen = labelled(docs, labels)
    few = chosen.count() * 32 <= LABEL_BYTES
    texts = docs.where("text IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("h")).join(F.broadcast(chosen) if few else chosen, ["doc_id", "h"])
    parts = written(counts(texts.where("fold < 4")), "counts")
    seen = parts.where("before IS NULL").agg(F.sum("nt"), F.sum("no")).first()
    if not seen[0] or not seen[1]:
        return None
    known = written(pruned(ratios(parts)), "model")
    dropped(parts)
    model = Model(np.zeros(0, np.uint64), np.zeros(0))
    if known.count() * 12 <= model_bytes:
        got = known.toArrow()
        units = got["unit"].to_numpy().view(np.uint64)
        order = np.argsort(units)
        model.units, model.ratios = units[order], got["ratio"].to_numpy()[order].astype(np.float32)
        del got
        trim()
    else:
        model.table = known
    drawn = written(chosen.where("fold = 4").orderBy(F.xxhash64(F.lit(1), "doc_id"), "doc_id").limit(CALIBRATION_ROWS), "calibration")
    rows = texts.where("fold = 4").join(drawn.select("doc_id"), "doc_id", "left_semi").select("text", "toxic")
    held = evidence(rows, model, "features").select("toxic", "features").toArrow()  # CALIBRATION_ROWS or so
    y = held["toxic"].to_numpy().astype(float)
    if len(np.unique(y)) == 2:
        model.weights = logistic(np.array(held["features"].to_pylist(), float), y)
    return model


# Scores


def evidence(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """``docs`` with a column ``name`` of the features of ``text``: array<double>."""
    columns, kinds = docs.columns, [f.dataType.simpleString() for f in docs.schema]
    names = [f"c{i}" for i in range(len(columns))]
    at = columns.index("text")
    if model.table is not None:
        return _joined_evidence(docs.toDF(*names), at, model.table).toDF(*columns, name)
    shared = docs.sparkSession.sparkContext.broadcast(Model(model.units, model.ratios))  # MODEL_BYTES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = [m.features(c) for c in chunks(batch.column(at), alnum_words(), lower=True)]
            yield with_features(batch, np.concatenate(found) if found else np.zeros((0, len(PASSAGES) + 1)))

    schema = ", ".join([*[f"`{n}` {k}" for n, k in zip(names, kinds)], "features array<double>"])
    return docs.toDF(*names).mapInArrow(lean(run), schema).toDF(*columns, name)


def _joined_evidence(docs: DataFrame, at: int, known: DataFrame) -> DataFrame:
    """The same for a model of any size; the text is column ``at``. Batches of texts ask blocks of the model for their different units, and take the answers along as small models of their own.

    A sieve of FILTER_BYTES at most spares most questions that have no answer; it lets some through, and loses none.
    """
    n = known.count()
    blocks = max(1, -(-n // BLOCK_UNITS))
    model, bits = _model_blocks(known, blocks, max(8, min(8 * BLOCK_UNITS, 8 * FILTER_BYTES // blocks) // 8 * 8))
    asked = written(_questions(docs, at, bits), "asked")
    answers = _answers(model, asked)
    texts = asked.where("block IS NULL").select("batch", "texts", F.lit(None).cast("binary").alias("units"), F.lit(None).cast("binary").alias("ratios"))
    both = texts.unionByName(answers.select("batch", F.lit(None).cast("binary").alias("texts"), "units", "ratios"))
    both = both.repartition("batch").sortWithinPartitions("batch", F.col("texts").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, Model(np.zeros(0, np.uint64), np.zeros(0, np.float32))
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            for i in range(b.num_rows):
                if b.column(0)[i].as_py() != key:
                    key, held, own = b.column(0)[i].as_py(), [], Model(np.zeros(0, np.uint64), np.zeros(0, np.float32))
                if not b.column(1)[i].is_valid:
                    held.append((np.frombuffer(b.column(2)[i].as_py(), "<u8"), np.frombuffer(b.column(3)[i].as_py(), "<f4")))
                    continue
                if held:
                    units, ratios = (np.concatenate(x) for x in zip(*held))
                    order = np.argsort(units)
                    own, held = Model(units[order], ratios[order]), []
                for part in pa.ipc.open_stream(b.column(1)[i].as_py()):
                    for c in chunks(part.column(at), alnum_words(), lower=True):
                        yield with_features(part.slice(c.first, c.rows), own.features(c))

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema], "features array<double>"])
    return both.mapInArrow(lean(run), schema)


def with_features(batch: pa.RecordBatch, features: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(features) + 1) * features.shape[1], pa.int32()), pa.array(features.reshape(-1)))
    return pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "features"])


def _block(units: np.ndarray, blocks: int) -> np.ndarray:
    """As Spark's pmod(unit, blocks)."""
    return units.view(np.int64) % blocks


def _places(units: np.ndarray, width: int) -> list[np.ndarray]:
    """The bits of each unit in its block's part of the sieve."""
    return [(mix(units, salt) % np.uint64(width)).astype(np.int64) for salt in (65, 66)]


def _model_blocks(known: DataFrame, blocks: int, width: int) -> tuple[DataFrame, np.ndarray]:
    """(block, units, ratios): the model in sorted blocks, written; and the sieve, one row of ``width`` bits for each block."""

    def pack(rows: pa.Table) -> pa.Table:
        units = rows["unit"].to_numpy().view(np.uint64)
        order = np.argsort(units)
        bits = np.zeros(width, bool)
        for at in _places(units, width):
            bits[at] = True
        values = [units[order].tobytes(), rows["ratio"].to_numpy()[order].astype("<f4").tobytes(), np.packbits(bits).tobytes()]
        return pa.table({"block": pa.array([rows["block"][0].as_py()], pa.int64()), **{k: pa.array([v], pa.binary()) for k, v in zip(("units", "ratios", "bits"), values)}})

    keyed = known.withColumn("block", F.pmod("unit", F.lit(blocks).cast("long")))
    model = written(keyed.groupBy("block").applyInArrow(pack, "block long, units binary, ratios binary, bits binary"), "blocks")
    sieve = np.zeros((blocks, width // 8), np.uint8)
    for r in model.select("block", "bits").toLocalIterator():
        sieve[r.block] = np.frombuffer(r.bits, np.uint8)
    return model.select("block", "units", "ratios"), sieve


def _questions(docs: DataFrame, at: int, bits: np.ndarray) -> DataFrame:
    """(batch, block, texts, units): the rows of each batch, packed as Arrow streams, and its different units of each block that pass the sieve."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = shared.value
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for b in batches:
            for c in chunks(b.column(at), alnum_words(), lower=True):
                yield row([number], [None], [packed(b.slice(c.first, c.rows))], [None])
                held.append(sifted(np.unique(unit_keys(c)), sieve))
                size += len(c.data)
                if size >= BATCH_BYTES:
                    yield from asked(number, held, len(sieve))
                    number, held, size = number + 1, [], 0
        if held:
            yield from asked(number, held, len(sieve))

    def sifted(units: np.ndarray, sieve: np.ndarray) -> np.ndarray:
        block = _block(units, len(sieve))
        ok = np.ones(len(units), bool)
        for place in _places(units, 8 * sieve.shape[1]):
            ok &= (sieve[block, place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1
        return units[ok]

    def asked(number: int, held: list[np.ndarray], blocks: int) -> Iterator[pa.RecordBatch]:
        units = np.unique(np.concatenate(held))
        block = _block(units, blocks)
        order = np.argsort(block, kind="stable")
        units, block = units[order], block[order]
        edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True]) if len(units) else np.zeros(1, np.int64)
        if len(edges) > 1:
            yield row([number] * (len(edges) - 1), block[edges[:-1]], [None] * (len(edges) - 1), [units[a:z].tobytes() for a, z in zip(edges[:-1], edges[1:])])

    def row(number: list, block: list, texts: list, units: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(block, pa.int64()), pa.array(texts, pa.binary()), pa.array(units, pa.binary())], names=["batch", "block", "texts", "units"])

    return docs.mapInArrow(lean(run), "batch long, block long, texts binary, units binary")


def packed(rows: pa.RecordBatch) -> bytes:
    """``rows`` as a compressed Arrow stream."""
    codec = pa.Codec("zstd", 6) if pa.Codec.is_available("zstd") else None  # texts are written and shuffled like this
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=codec)) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _answers(model: DataFrame, asked: DataFrame) -> DataFrame:
    """(batch, units, ratios): what the model knows of the units that each batch asks each block for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, units, ratios = None, np.zeros(0, np.uint64), np.zeros(0, np.float32)
        for b in batches:
            out: list[tuple[int, bytes, bytes]] = []
            for i in range(b.num_rows):
                want = np.frombuffer(b.column(2)[i].as_py(), "<u8")
                if not b.column(1)[i].is_valid:  # a block of the model comes before what is asked of it
                    key, units, ratios = b.column(0)[i].as_py(), want, np.frombuffer(b.column(3)[i].as_py(), "<f4")
                elif b.column(0)[i].as_py() == key:
                    at = np.minimum(np.searchsorted(units, want), len(units) - 1)
                    hit = units[at] == want
                    if hit.any():
                        out.append((b.column(1)[i].as_py(), want[hit].tobytes(), ratios[at[hit]].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary()))], names=["batch", "units", "ratios"])

    none = F.lit(None)
    wanted = asked.where("block IS NOT NULL").select("block", "batch", "units", none.cast("binary").alias("ratios"))
    both = model.select("block", none.cast("long").alias("batch"), "units", "ratios").unionByName(wanted)
    return both.repartition("block").sortWithinPartitions("block", F.col("batch").asc_nulls_first()).mapInArrow(lean(run), "batch long, units binary, ratios binary")


def scored(docs: DataFrame, model: Model | None, name: str = "toxic_score") -> DataFrame:
    """``docs`` with a score (0 to 1) in a column ``name``, which no column of ``docs`` may have."""
    if model is None:
        return docs.withColumn(name, F.lit(0.0))
    z = F.lit(float(model.weights[0]))
    for i, w in enumerate(model.weights[1:].tolist()):
        z = z + F.lit(w) * F.col(name)[i]
    return evidence(docs, model, name).withColumn(name, 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-40.0)), F.lit(40.0)))))


def ordinary(docs: DataFrame, model: Model | None, below: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score less than ``below``."""
    name = free_name("toxic_score", docs.columns)
    return scored(docs, model, name).where(F.col(name) < below).drop(name)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))
