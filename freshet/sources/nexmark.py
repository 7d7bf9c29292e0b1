"""An auction workload: persons, auctions and bids in the proportion 1 : 3 : 46, from row numbers alone."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.sources.datagen import _unit

# Fixed values of the benchmark: its proportions, and the states and channels that its queries ask for.
PERSONS, AUCTIONS, ALL = 1, 3, 50
STATES = ["AZ", "CA", "ID", "OR", "WA", "WY"]
CHANNELS = ["Google", "Facebook", "Baidu", "Apple"]

START = dt.datetime(2024, 1, 1)


def generate(spark: SparkSession, events: int, seed: int = 1, per_second: int = 1000) -> dict[str, DataFrame]:
    e = spark.range(events).withColumn("epoch", F.floor(F.col("id") / ALL)).withColumn("off", F.col("id") % ALL)
    time = F.timestamp_micros(F.lit(int(START.replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000)) + F.floor(F.col("id") * (1_000_000 / per_second))).cast("timestamp_ntz")
    pick = lambda values, name: F.element_at(F.array(*map(F.lit, values)), (F.floor(_unit(seed, name) * len(values)) + 1).cast("int"))
    number = lambda name, below: F.floor(_unit(seed, name) * below).cast("string")
    person = e.where(f"off < {PERSONS}").select(
        (1000 + F.col("epoch") * PERSONS + F.col("off")).alias("id"),
        F.concat_ws(" ", F.concat(F.lit("First"), number("first", 20)), F.concat(F.lit("Last"), number("last", 50))).alias("name"),
        F.concat(pick(["ann", "bo", "cy", "di"], "mail"), F.col("id"), F.lit("@example.com")).alias("emailAddress"),
        F.lpad(F.floor(_unit(seed, "card") * 1e16).cast("decimal(16,0)").cast("string"), 16, "0").alias("creditCard"),
        F.concat(F.lit("city-"), number("city", 100)).alias("city"),
        pick(STATES, "state").alias("state"),
        time.alias("date_time"),
        F.lit("").alias("extra"),
    )
    people = 1000 + F.floor(_unit(seed, "who") * F.greatest(F.col("epoch") * PERSONS + 1, F.lit(1)))
    auction = e.where(f"off >= {PERSONS} AND off < {PERSONS + AUCTIONS}").select(
        (1000 + F.col("epoch") * AUCTIONS + F.col("off") - PERSONS).alias("id"),
        F.concat(F.lit("item "), F.col("id")).alias("itemName"),
        F.lit("a thing").alias("description"),
        F.floor(_unit(seed, "initial") * 1000 + 1).alias("initialBid"),
        F.floor(_unit(seed, "reserve") * 2000 + 1).alias("reserve"),
        time.alias("date_time"),
        (time + F.make_dt_interval(secs=F.floor(_unit(seed, "life") * 60) + 1)).alias("expires"),
        people.alias("seller"),
        (10 + F.floor(_unit(seed, "category") * 5)).alias("category"),
        F.lit("").alias("extra"),
    )
    items = F.col("epoch") * AUCTIONS + AUCTIONS
    hot = F.floor(items / 100) * 100
    which = F.when(_unit(seed, "hot") < 0.5, F.least(hot, items - 1)).otherwise(F.floor(_unit(seed, "item") * items))
    bid = e.where(f"off >= {PERSONS + AUCTIONS}").select(
        (1000 + which).alias("auction"),
        people.alias("bidder"),
        F.floor(F.pow(F.lit(10.0), _unit(seed, "price") * 6) * 100).alias("price"),
        F.when(_unit(seed, "known") < 0.5, pick(CHANNELS, "channel")).otherwise(F.concat(F.lit("channel-"), F.floor(_unit(seed, "number") * 10000).cast("string"))).alias("channel"),
        F.concat(F.lit("https://www.example.com/item.htm/a/b?query=1&channel_id="), F.floor(_unit(seed, "url") * 10000).cast("string")).alias("url"),
        time.alias("date_time"),
        F.lit("").alias("extra"),
    )
    return {"person": person, "auction": auction, "bid": bid}
