"""Secret scan: fixed patterns, and two character Markov models that tell random strings from identifiers.

Base spans come from three patterns. Beyond them the best-scoring stretches of every run of the base64 and URL alphabets are found: two first-order Markov
models over characters, one of random strings, one of ordinary identifiers, give each transition a log-likelihood ratio, and a stretch
is a maximal sum of ratios, which ends where it falls DROP below its peak. So a key is found in a path or behind a name too. A stretch is widened to the nearest separators
and reported as ``markov`` where it has LEAST_RUN characters, its sum reaches EVIDENCE, its mean MEAN_RATIO, and no base span overlaps it.

The models are trained from labelled strings. Random: generated ones (seeded, over the usual key alphabets). Ordinary: the words of all documents,
counted over whole texts; a word is a run of letters and digits too short to be reported and outside base spans. How words are put
together to identifiers (by separators, in camel case, in capitals, with a number at the end) follows from how often a character begins and ends a word.

Defined cases: null text is empty and has no spans; without any words, a few fixed ones are ordinary; repeated rows give equal results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm._stage import lean, table
from freshet.llm._words import buffers, row_chunks

KINDS = ("assign", "access", "hex", "markov")
RANDOM_STRINGS = 6000
LEAST_RUN, MEAN_RATIO, EVIDENCE, DROP = 16, 0.6, 16.0, 8.0
#: Transitions' worth of the single-character model in each row of a Markov model.
BACKOFF = 2.0
#: The weight of identifiers put together from words, against the words themselves.
JOINED = 0.25
#: Stands for words where a table has none.
FEW_WORDS = ("identifier", "value", "name")

ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KEYWORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")

ALPHABET = (string.ascii_letters + string.digits + "+/_=-").encode()
CODE = np.full(256, 255, np.uint8)
CODE[list(ALPHABET)] = np.arange(len(ALPHABET))
END = len(ALPHABET)
SEPARATORS = [int(CODE[c]) for c in b"_-/"]
IN_RUN = CODE < 255
IN_WORD = np.zeros(256, bool)
IN_WORD[list((string.ascii_letters + string.digits).encode())] = True
IN_HEX = np.zeros(256, bool)
IN_HEX[list(b"0123456789abcdef")] = True


def random_strings(seed: int = 3) -> list[str]:
    rng = np.random.Generator(np.random.PCG64(seed))
    letters = np.array(list(string.ascii_letters + string.digits + "+/"))
    alphabets = [letters, letters[:62], np.array(list("0123456789abcdef")), np.array(list("0123456789ABCDEF")), letters[26:62], np.array(list(string.ascii_letters + string.digits + "-_"))]
    return ["".join(rng.choice(alphabets[i % len(alphabets)], int(rng.integers(20, 65)))) for i in range(RANDOM_STRINGS)]


def transitions(texts: Iterable[str]) -> np.ndarray:
    """How often a character follows another; END stands before the first and after the last of a text."""
    counts = np.zeros((END + 1, END + 1))
    for text in texts:
        code = CODE[np.frombuffer(text.encode("ascii", "ignore"), np.uint8)].astype(np.int64)
        code = np.r_[END, np.where(code < END, code, END), END]
        np.add.at(counts, (code[:-1], code[1:]), 1)
    counts[END, END] = 0
    return counts


def identifiers(words: np.ndarray) -> np.ndarray:
    """Transitions within ``words`` and within the identifiers that people make of them."""
    inner, first, last = words[:END, :END], words[END, :END], words[:END, END]
    n = max(first.sum(), 1.0)
    out = inner.copy()
    share = JOINED / len(SEPARATORS)
    for s in SEPARATORS:
        out[:, s] += share * last
        out[s, :] += share * first
    upper = np.array([CODE[ord(chr(c).upper())] for c in ALPHABET], np.int64)
    np.add.at(out, (slice(None), upper), JOINED * np.outer(last, first) / n)  # camelCase: the next word's first letter in upper case
    out += JOINED * np.outer(last, first) / n  # written together
    capitals = np.zeros_like(out)
    np.add.at(capitals, (upper[:, None], upper[None, :]), inner)
    out += JOINED * capitals
    digits = CODE[list(b"0123456789")].astype(np.int64)
    out[:, digits] += JOINED * last[:, None] / 10
    out[digits[:, None], digits[None, :]] += JOINED * n / 100
    return out


def log_ratios(random: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
    """The log-likelihood ratio (random over ordinary) of each transition between two characters."""
    counts = np.stack([ordinary, random])
    # Rare transitions lean on how common the character is in the class at all.
    single = counts.sum(axis=1) + 0.5
    single /= single.sum(axis=1, keepdims=True)
    p = (counts + BACKOFF * single[:, None, :]) / (counts.sum(axis=2, keepdims=True) + BACKOFF)
    return np.log(p[1]) - np.log(p[0])


def fit(words: Iterable[str]) -> np.ndarray:
    """The model of ordinary ``words`` against generated strings."""
    return log_ratios(transitions(random_strings())[:END, :END], identifiers(transitions(words)))


def word_transitions(docs: DataFrame) -> np.ndarray:
    """transitions() of the words of all of ``docs``: a table of fixed size, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((END + 1) ** 2, np.int64)
        for batch in batches:
            raw, at = buffers(batch.column(0))
            for i, j in row_chunks(raw, at):
                data, doc_at = raw[at[i] : at[j]], at[i : j + 1] - at[i]
                inside = IN_WORD[data]
                edge = _edges(len(data), doc_at)
                start, end = _runs(inside, edge, 1)
                plain = np.ones(len(data) + 1, bool)
                for r, spans in enumerate(base_spans(data, doc_at)):
                    for a, _, b in spans:
                        plain[doc_at[r] + a : doc_at[r] + b] = False
                ok = (end - start < LEAST_RUN) & plain[start]
                start, end = start[ok], end[ok]
                # Words one after the other, END between them.
                size = end - start
                code = np.full(int(size.sum()) + len(size) + 1, END, np.int64)
                to = np.arange(int(size.sum())) + np.repeat(np.arange(1, len(size) + 1), size)
                of = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                code[to] = CODE[data[of]]
                total += np.bincount(code[:-1] * (END + 1) + code[1:], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["pair", "n"])

    summed = docs.select("text").mapInArrow(lean(run), "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((END + 1) ** 2)
    out[summed["pair"].to_numpy()] = summed["n"].to_numpy()
    out = out.reshape(END + 1, END + 1)
    out[END, END] = 0
    return out


def default_model(docs: DataFrame) -> np.ndarray:
    words = word_transitions(docs)
    if not words.any():
        words = transitions(FEW_WORDS)
    return log_ratios(transitions(random_strings())[:END, :END], identifiers(words))


def _runs(inside: np.ndarray, edge: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    padded = np.zeros(len(inside) + 2, bool)
    padded[1:-1] = inside
    start = np.flatnonzero(padded[1:] & (~padded[:-1] | edge))
    end = np.flatnonzero(padded[:-1] & (~padded[1:] | edge))
    ok = end - start >= least
    return start[ok], end[ok]


def _edges(n: int, doc_at: np.ndarray) -> np.ndarray:
    edge = np.zeros(n + 1, bool)
    edge[doc_at] = True
    return edge


def base_spans(data: np.ndarray, doc_at: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """(first byte, kind number, last byte + 1) of each row's base spans; bytes count from the row's first."""
    rows = len(doc_at) - 1
    spans: list[list[tuple[int, int, int]]] = [[] for _ in range(rows)]

    def row_of(at: int) -> int:
        return int(np.searchsorted(doc_at, at, "right")) - 1

    for a, b in zip(*_runs(IN_HEX[data], _edges(len(data), doc_at), 32)):
        r = row_of(a)
        spans[r].append((int(a - doc_at[r]), 2, int(b - doc_at[r])))
    raw = data.tobytes()
    low = raw.lower()
    hot = set()
    for word in (*KEYWORDS, b"akia"):
        at = low.find(word)
        while at >= 0:
            r = row_of(at)
            hot.add(r)
            at = low.find(word, int(doc_at[r + 1]))  # this row is looked at whole
    for r in hot:
        text = raw[doc_at[r] : doc_at[r + 1]]
        spans[r] += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
        spans[r] += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return spans


def stretches(step: np.ndarray) -> list[tuple[int, int]]:
    """The transitions [first, last) of the maximal sums of a run, from left to right, that pass the thresholds."""
    out, total, first, peak, last = [], 0.0, 0, 0.0, 0
    for i, x in enumerate([*step.tolist(), -np.inf]):
        total += x
        if total > peak:
            peak, last = total, i + 1
        elif total <= 0 or total < peak - DROP:
            if peak >= EVIDENCE and last - first + 1 >= LEAST_RUN and peak >= MEAN_RATIO * (last - first):
                out.append((first, last))
            total, first, peak, last = 0.0, i + 1, 0.0, i + 1
    return out


def chunk_spans(data: np.ndarray, doc_at: np.ndarray, ratios: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """(first byte, kind number, last byte + 1) of each row's spans in order; bytes count from the row's first."""
    spans = base_spans(data, doc_at)
    start, end = _runs(IN_RUN[data], _edges(len(data), doc_at), LEAST_RUN)
    if len(start):
        code = CODE[data].astype(np.int64)
        both = (code[:-1] < END) & (code[1:] < END)
        step = np.zeros(len(data))
        step[1:][both] = ratios[code[:-1][both], code[1:][both]]
        gain = np.r_[0.0, np.cumsum(np.maximum(step, 0))]
        hopeful = gain[end] - gain[start + 1] >= EVIDENCE
        for a, b in zip(start[hopeful].tolist(), end[hopeful].tolist()):
            r = int(np.searchsorted(doc_at, a, "right")) - 1
            base = [(s, e) for s, kind, e in spans[r] if kind < 3]
            zero = int(doc_at[r])
            reach = a
            for x, y in stretches(step[a + 1 : b]):
                x, y = a + x, a + y + 1
                # A separator at either end, and a letter beyond it, aren't part of it; the word it begins or ends in is.
                x += 1 if not IN_WORD[data[x]] else 2 * (not IN_WORD[data[x + 1]])
                y -= 1 if not IN_WORD[data[y - 1]] else 2 * (not IN_WORD[data[y - 2]])
                while x > reach and IN_WORD[data[x - 1]]:
                    x -= 1
                while y < b and IN_WORD[data[y]]:
                    y += 1
                if x >= reach and all(y - zero <= s or e <= x - zero for s, e in base):
                    spans[r].append((x - zero, 3, y - zero))
                    reach = y
    return [sorted(s) for s in spans]


def scan(docs: DataFrame, model: np.ndarray | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, spans as array<struct<kind, first, last>> in code points (last exclusive), base spans and ``markov`` ones."""
    ratios = default_model(docs.select(F.col(text).alias("text"))) if model is None else model
    id_type = docs.schema[key].dataType.simpleString()
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = buffers(batch.column(1))
            for i, j in row_chunks(raw, at):
                data, doc_at = raw[at[i] : at[j]], at[i : j + 1] - at[i]
                points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
                out = []
                for r, spans in enumerate(chunk_spans(data, doc_at, ratios)):
                    base = doc_at[r]
                    zero = points[base]
                    out.append([{"kind": KINDS[k], "first": int(points[base + a] - zero), "last": int(points[base + b] - zero)} for a, k, b in spans])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(out, span_type)], names=["key", "spans"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(lean(run), f"key {id_type}, spans array<struct<kind: string, first: long, last: long>>").withColumnRenamed("key", key)


def redacted(docs: DataFrame, model: np.ndarray | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark``; null stays null."""
    ratios = default_model(docs) if model is None else model
    at = docs.columns.index("text")
    names = [f"c{i}" for i in range(len(docs.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = buffers(batch.column(at))
            texts = batch.column(at).to_pylist()
            for i, j in row_chunks(raw, offsets):
                for r, spans in enumerate(chunk_spans(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ratios)):
                    if spans:
                        old, new, reach = texts[i + r].encode(), b"", 0
                        for a, _, b in spans:
                            if a >= reach:
                                new += old[reach:a] + mark.encode()
                            reach = max(reach, b)
                        texts[i + r] = (new + old[reach:]).decode()
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(len(names))], names=names)

    plain = docs.toDF(*names)
    return plain.mapInArrow(lean(run), plain.schema).toDF(*docs.columns)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    id_type = found.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(1).to_pylist()
            base = [[s for s in row if s["kind"] != "markov"] for row in spans]
            text = lambda row: ",".join(f"{s['kind']}:{s['first']}:{s['last']}" for s in row)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *[pa.array([sum(s["kind"] == k for s in row) for row in spans], pa.int64()) for k in KINDS[:3]],
                    pa.array([hashlib.sha256(text(row).encode()).hexdigest() for row in base], pa.string()),
                    pa.array([text(row) for row in spans], pa.string()),
                ],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return found.mapInArrow(lean(run), f"doc_id {id_type}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
