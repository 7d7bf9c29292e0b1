"""Generated rows by field plans: every value is a function of (seed, row number), so any task can make any row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = ["amber", "basil", "cedar", "delta", "ember", "flint", "grove", "hazel", "indigo", "jade", "kelp", "linen", "maple", "north", "opal", "pearl"]


def _unit(seed: int, name: str) -> Column:
    """A uniform number in [0, 1) for each row and field."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(name), "id"), 11)).cast("double") / float(1 << 53)


def field(seed: int, name: str, plan: dict) -> Column:
    """strategy: increment, uniform, zipf, or a text maker (word, sentence, name, email, uuid); ``range`` [low, high), ``values``, ``null_percentage``, ``scale``."""
    kind, u = plan.get("strategy", "increment"), _unit(seed, name)
    low, high = plan.get("range", [0, 1 << 31])
    values = plan.get("values")
    if kind == "increment":
        number = F.lit(low) + F.col("id") * plan.get("scale", 1)
        if plan.get("range"):
            number = F.lit(low) + F.pmod(F.col("id") * plan.get("scale", 1), F.lit(high - low))
    elif kind == "uniform":
        number = F.lit(low) + F.floor(u * (high - low))
    elif kind == "zipf":
        # Inverse of the continuous bounded power law with exponent s.
        s, n = float(plan.get("s", 1.1)), float(high - low)
        a = 1.0 - s
        x = F.pow((F.pow(F.lit(n + 1.0), a) - 1.0) * u + 1.0, 1.0 / a) if abs(a) > 1e-9 else F.exp(u * F.log(F.lit(n + 1.0)))
        number = F.lit(low) + F.least(F.floor(x - 1.0), F.lit(n - 1).cast("long"))
    else:
        pick = lambda salt: F.element_at(F.array(*map(F.lit, WORDS)), (F.pmod(F.xxhash64(F.lit(seed), F.lit(name + salt), "id"), F.lit(len(WORDS))) + 1).cast("int"))
        number = {
            "word": pick("a"),
            "sentence": F.concat_ws(" ", *[pick(str(i)) for i in range(8)]),
            "name": F.initcap(F.concat_ws(" ", pick("a"), pick("b"))),
            "email": F.concat(pick("a"), F.lit("."), pick("b"), F.col("id").cast("string"), F.lit("@example.com")),
            "uuid": F.regexp_replace(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(name), F.col("id").cast("string"))), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"),
        }[kind]
    if values:
        number = F.element_at(F.array(*map(F.lit, values)), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))
    if plan.get("null_percentage"):
        number = F.when(_unit(seed, name + "/null") * 100 >= plan["null_percentage"], number)
    return number


def generate(spark: SparkSession, fields: dict[str, dict], limit: int, seed: int = 1, types: dict[str, str] | None = None) -> DataFrame:
    rows = spark.range(limit)
    return rows.select(*[(field(seed, n, p).cast(types[n]) if types and n in types else field(seed, n, p)).alias(n) for n, p in fields.items()])


def stream(spark: SparkSession, fields: dict[str, dict], rate: int = 100, seed: int = 1) -> DataFrame:
    """The same rows as an endless stream at a rate."""
    rows = spark.readStream.format("rate").option("rowsPerSecond", rate).load().withColumnRenamed("value", "id")
    return rows.select(*[field(seed, n, p).alias(n) for n, p in fields.items()])
