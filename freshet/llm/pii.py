"""Personal data: fixed patterns, and information-theoretic sanitisation of the words around them. DataFrame functions only.

Base spans: e-mail and IP addresses, card and phone numbers. Positions come from splitting a text at its
matches and adding up lengths, so one row is handled in place. The patterns are the plain ones made possessive, and tied to the start of
a run of their first class or the end of the match before: that changes no match but keeps long runs linear.

Terms: each value found is a protected entity. All words of its text outside the base spans are its terms. With document counts
over the whole corpus, a term t lets one guess entity e with P(e | t) = (n_et + SMOOTH * P(e)) / (n_t + SMOOTH), P(e) = n_e / N, so that a term
that was seen little leans on how common the entity is. Of the information IC(e) = -log P(e) it tells log(P(e | t) / P(e)). Where
that share reaches GENERALISE, every occurrence of the term in a text with the entity is a span of kind ``term``: generalised, and from REMOVE on removed.

Defined cases: null text is empty; it and texts without entities have no spans; equal texts get equal spans; overlapping
spans of different kinds are all reported, and masked once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm._stage import table, written

# The patterns of the four kinds.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
IP_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
KINDS = ("email", "ip", "card", "phone", "term")

TERM = r"[\p{L}\p{N}_]{3,}"
SMOOTH, GENERALISE, REMOVE = 0.5, 0.8, 0.95
#: Keys that stand in this share of the documents are looked up by a broadcast; a share of 1 / 500 bounds their number.
HOT_SHARE = 1 / 500


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("int"), lambda s, x: s + x)


def prefix_sums(a: Column, block: int = 64) -> Column:
    """Running totals of an array of ints, by blocks so that long arrays stay cheap."""
    many = lambda x: F.ceil(F.size(x) / block).cast("int")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return _let(
        a,
        lambda x: _let(
            F.transform(upto(many(x)), lambda b: _total(F.slice(x, b * block + 1, F.lit(block)))),
            lambda sums: _let(
                F.transform(upto(F.size(sums)), lambda b: _total(F.slice(sums, F.lit(1), b))),
                lambda before: F.transform(x, lambda _, i: F.get(before, F.floor(i / block).cast("int")) + _total(F.slice(x, i - i % block + 1, i % block + 1))),
            ),
        ),
    )


def located(text: Column, pattern: str) -> Column:
    """array<struct<first int, last int, value string>> of the matches of a pattern, in code points, last exclusive."""
    parts = F.struct(F.transform(F.split(text, pattern, -1), lambda p: F.length(p)).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))

    def place(z: Column) -> Column:
        gaps, found = z["gaps"], z["found"]
        steps = F.transform(found, lambda m, i: F.get(gaps, i) + F.coalesce(F.length(F.get(found, i - 1)), F.lit(0)))
        return _let(prefix_sums(steps), lambda first: F.transform(found, lambda m, i: F.struct(F.get(first, i).alias("first"), (F.get(first, i) + F.length(m)).alias("last"), m.alias("value"))))

    return _let(parts, place)


def _kind(text: Column, hint: Column, kind: int, pattern: str, ok: Callable[[Column], Column]) -> Column:
    spans = F.filter(located(text, pattern), lambda s: ok(s["value"]))
    typed = F.transform(spans, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"), F.lit(kind).alias("kind"), s["value"].alias("value")))
    return F.when(hint, typed).otherwise(F.array().cast("array<struct<first: int, last: int, kind: int, value: string>>"))


def base_spans(text: Column) -> Column:
    """array<struct<first, last, kind, value>>, by kind and then start."""
    digits = lambda v: F.regexp_replace(v, "[^0-9]", "")
    some = text.rlike("[0-9]")
    kinds = [
        _kind(text, text.contains("@"), 0, EMAIL, lambda v: F.lit(True)),
        _kind(text, some & text.contains("."), 1, IP, lambda v: v.rlike(rf"\A{IP_PART}(?:\.{IP_PART}){{3}}\z")),
        _kind(text, text.rlike("[0-9](?:[ -]?[0-9]){15}"), 2, CARD, lambda v: F.length(digits(v)).between(16, 19) & F.call_function("luhn_check", digits(v))),
        _kind(text, text.contains("+"), 3, PHONE, lambda v: F.length(digits(v)).between(8, 15)),
    ]
    return F.concat(*kinds)


def _entity(s: Column) -> Column:
    plain = F.when(s["kind"] == 0, F.lower(s["value"])).when(s["kind"] == 1, s["value"]).otherwise(F.regexp_replace(s["value"], "[^0-9]", ""))
    return F.xxhash64(s["kind"], plain)


def terms_outside(text: Column, spans: Column) -> Column:
    """array<struct<t, first, last>>: the terms of the whole text but those inside spans."""

    def words(lo: Column, hi: Column) -> Column:
        piece = F.substring(text, lo + 1, F.greatest(hi - lo, F.lit(0)))
        return F.transform(located(piece, TERM), lambda w: F.struct(F.lower(w["value"]).alias("t"), (w["first"] + lo).alias("first"), (w["last"] + lo).alias("last")))

    def between(all_: Column) -> Column:
        upto = lambda lasts, i: F.coalesce(F.array_max(F.slice(lasts, F.lit(1), i)), F.lit(0))
        ends = F.transform(all_, lambda s: s["last"])
        return _let(ends, lambda lasts: F.concat(F.flatten(F.transform(all_, lambda s, i: words(upto(lasts, i), s["first"]))), words(upto(lasts, F.size(lasts)), F.length(text))))

    return _let(F.array_sort(spans), between)


def found(docs: DataFrame, *keep: str) -> DataFrame:
    """Rows of ``docs`` (columns ``keep``) with spans, the terms beside them and, where there are spans, ``text_key``; written."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*keep, text.alias("_text")).withColumn("spans", base_spans(F.col("_text")))
    rows = rows.withColumn("terms", F.when(F.size("spans") > 0, terms_outside(F.col("_text"), F.col("spans"))).otherwise(F.array().cast("array<struct<t: string, first: int, last: int>>")))
    return written(rows.withColumn("text_key", F.when(F.size("spans") > 0, F.md5("_text"))).drop("_text"), "entities")


def _pairs(rows: DataFrame, *keep: str) -> DataFrame:
    """(``keep``, e, t): every entity of a row with every term of it, once."""
    each = rows.select(*keep, F.explode(F.array_distinct(F.transform("spans", _entity))).alias("e"), F.array_distinct(F.transform("terms", lambda c: c["t"])).alias("ts"))
    return each.select(*keep, "e", F.explode("ts").alias("t"))


def _counted(pairs: DataFrame, counts: DataFrame, key: str, n: str, hot_from: float) -> DataFrame:
    """``pairs`` with the count ``n`` of their ``key``, null if there is none; hot keys are broadcast, so that their pairs needn't meet in one task."""
    hot = counts.where(F.col(n) >= hot_from).withColumnRenamed(n, "_hot")
    rest = counts.where(F.col(n) < hot_from).select(F.col(key).alias("_place"), n)
    spread = pairs.join(F.broadcast(hot), key, "left").withColumn("_place", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(F.xxhash64("e", "t")))
    return spread.join(rest, "_place", "left").withColumn(n, F.coalesce("_hot", n)).drop("_hot", "_place")


def disclosures(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(e, t, disclosure) of the pairs that reach GENERALISE; ``rows``: found(docs)."""
    total = float(rows.count())
    hot_from = max(20.0, total * HOT_SHARE)
    with_spans = rows.where("text_key IS NOT NULL")
    pairs = _pairs(with_spans).groupBy("e", "t").agg(F.count("*").alias("n_et"))
    entities = written(with_spans.select(F.explode(F.array_distinct(F.transform("spans", _entity))).alias("e")).groupBy("e").agg(F.count("*").alias("n_e")), "counts")
    words = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), lambda w: F.xxhash64(F.lower(w))))
    terms = written(docs.select(F.explode(words).alias("h")).groupBy("h").agg(F.count("*").alias("n_t")), "counts")
    joined = _counted(_counted(pairs, entities, "e", "n_e", hot_from).withColumn("h", F.xxhash64("t")), terms, "h", "n_t", hot_from)
    p_e = F.col("n_e") / total
    # A term that a span cuts from a longer word may stand nowhere whole.
    p_et = (F.col("n_et") + SMOOTH * p_e) / (F.greatest("n_t", "n_et") + SMOOTH)
    return joined.where(p_e < 1).withColumn("disclosure", F.log(p_et / p_e) / -F.log(p_e)).where(F.col("disclosure") >= GENERALISE).select("e", "t", "disclosure")


def term_spans(rows: DataFrame, revealing: DataFrame) -> DataFrame:
    """(text_key, revealing): for each text the revealing terms' places, array<struct<first, last, removed>>, in order."""
    texts = rows.where("text_key IS NOT NULL").select("text_key", "spans", "terms").dropDuplicates(["text_key"])
    hit = _pairs(texts, "text_key").join(revealing, ["e", "t"]).groupBy("text_key", "t").agg((F.max("disclosure") >= REMOVE).alias("removed"))
    chosen = lambda removed: F.collect_set(F.when(F.col("removed") == removed, F.col("t")))
    by_text = hit.groupBy("text_key").agg(chosen(False).alias("general"), chosen(True).alias("gone"))
    places = lambda names, removed: F.transform(F.filter("terms", lambda c: F.array_contains(names, c["t"])), lambda c: F.struct(c["first"].alias("first"), c["last"].alias("last"), F.lit(removed).alias("removed")))
    return texts.join(by_text, "text_key").select("text_key", F.array_sort(F.concat(places("general", False), places("gone", True))).alias("revealing"))


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with base spans masked by their kind, revealing terms generalised ([TERM]) or removed; n_chars follows if there."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    text = F.col(names["text"])
    keyed = docs.toDF(*names.values())
    keyed = keyed.withColumn("_spans", base_spans(F.coalesce(text, F.lit(""))))
    rows = found(docs)
    extra = term_spans(rows, disclosures(docs, rows)).toDF("_key", "_revealing")
    # Texts without spans match nothing; a key of their own keeps them from meeting in one task.
    keyed = keyed.withColumn("_key", F.when(F.size("_spans") > 0, F.md5(text)).otherwise(F.hex(F.xxhash64(*names.values()))))
    joined = keyed.join(extra, "_key", "left")
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS[:4]])
    base = F.transform("_spans", lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"), F.get(marks, s["kind"]).alias("mark")))
    more = F.transform(F.coalesce("_revealing", F.array().cast("array<struct<first: int, last: int, removed: boolean>>")), lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"), F.when(s["removed"], "").otherwise("[TERM]").alias("mark")))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, s: F.when(s["last"] <= a["at"], a).otherwise(
        F.struct(s["last"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, F.greatest(s["first"] - a["at"], F.lit(0))), s["mark"]).alias("out"))
    )
    masked = F.aggregate(F.array_sort(F.concat(base, more)), start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    changed = F.size("_spans") > 0
    out = joined.withColumn("_text", F.when(changed, masked).otherwise(text))
    new = {"text": F.col("_text")}
    if "n_chars" in names:
        new["n_chars"] = F.when(changed, F.length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(names["n_chars"]))
    return out.select(*[new.get(c, F.col(n)).alias(c) for c, n in names.items()])


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = found(docs, "doc_id")
    extra = term_spans(rows, disclosures(docs, rows))
    names = F.array(*map(F.lit, KINDS))
    shown = F.transform("spans", lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["first"], s["last"]))
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = rows.select("doc_id", "text_key", *[n(k).alias(f"n_{KINDS[k]}") for k in range(4)], F.array_join(shown, ",").alias("base"))
    terms = extra.select("text_key", F.array_join(F.transform("revealing", lambda s: F.concat_ws(":", F.lit("term"), s["first"], s["last"])), ",").alias("more"))
    spread = F.coalesce("text_key", F.hex(F.xxhash64("doc_id")))  # texts without spans match nothing, and needn't meet in one task
    out = base.withColumn("_key", spread).join(terms.withColumnRenamed("text_key", "_key"), "_key", "left")
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), "more").alias("spans"))
