"""Usage: rates, charges, balances, feeds and review queues."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X

MONEY = "decimal(18,4)"
#: Smallest amounts in one.
UNIT = 10_000


def charged(usage: DataFrame, rates: DataFrame, name: str, quantity: str, default: str) -> DataFrame:
    """Adds rate (the default where there is none) and charge (quantity x rate)."""
    known = rates.select(F.col("model_name").alias(name), F.col("rate").cast("decimal(18,8)").alias("_rate"))
    rate = F.coalesce("_rate", F.lit(default).cast("decimal(18,8)"))
    rows = usage.join(known, name, "left").withColumn("rate", rate)
    return rows.withColumn("charge", (F.col(quantity).cast(MONEY) * F.col("rate")).cast(MONEY)).drop("_rate")


def tokens(text: str = "text") -> Column:
    return X.word_count(text).cast("long")


def cost_by(usage: DataFrame, *keys: str) -> DataFrame:
    return usage.groupBy(*keys).agg(F.sum("charge").cast(MONEY).alias("cost"))


def with_cost(items: DataFrame, costs: DataFrame, key: str) -> DataFrame:
    """Items with their cost, 0 where nothing was charged."""
    return items.join(costs, key, "left").withColumn("cost", F.coalesce("cost", F.lit(0).cast(MONEY)))


def sequential_charge(jobs: DataFrame, balances: DataFrame) -> DataFrame:
    """user_id, job_id, cost, accepted, balance: jobs in order; one that costs more than the balance is rejected and free.

    jobs: user_id, job_id, ord, cost; balances: user_id, balance. Each user's jobs are streamed in order, in whole numbers of the
    smallest amount, so a user with very many jobs is never held in memory as a whole. A balance depends on all jobs before, so one
    user's jobs are one task's work and cannot be salted. A job without a cost is rejected.
    """
    small = lambda c: (F.col(c).cast(MONEY) * UNIT).cast("long")
    rows = jobs.join(balances, "user_id").select("user_id", "job_id", "ord", small("cost").alias("cost"), small("balance").alias("balance"))
    parts = int(jobs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "user_id").sortWithinPartitions("user_id", "ord", "job_id")

    def run(batches):
        user, left = None, 0
        for batch in batches:
            accepted, after = [], []
            for who, cost, start in zip(*[batch.column(c).to_pylist() for c in ("user_id", "cost", "balance")], strict=True):
                if who != user:
                    user, left = who, start
                fits = cost is not None and cost <= left
                left -= cost if fits else 0
                accepted.append(fits)
                after.append(left)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("user_id", "job_id", "cost")] + [pa.array(accepted, pa.bool_()), pa.array(after, pa.int64())], names=["user_id", "job_id", "cost", "accepted", "balance"])

    kinds = dict(rows.dtypes)
    done = rows.mapInArrow(run, f"user_id {kinds['user_id']}, job_id {kinds['job_id']}, cost long, accepted boolean, balance long")
    return done.withColumns({c: (F.col(c).cast("decimal(20,0)") / UNIT).cast(MONEY) for c in ("cost", "balance")})


def set_rates(rates: DataFrame, changes: DataFrame) -> DataFrame:
    """model_type, model_name, rate, is_active after changes with the same columns: new models come in, known ones get what is set."""
    new = changes.select("model_type", "model_name", F.col("rate").alias("_rate"), F.col("is_active").alias("_active"))
    both = rates.join(new, ["model_type", "model_name"], "full")
    return both.select("model_type", "model_name", F.coalesce("_rate", "rate").alias("rate"), F.coalesce("_active", "is_active", F.lit(True)).alias("is_active"))


def active_rates(rates: DataFrame, model_type: str) -> DataFrame:
    """model_name, rate of the models that are offered, for charged()."""
    return rates.where((F.col("model_type") == model_type) & F.col("is_active")).select("model_name", "rate")


def with_tier(users: DataFrame, tiers: DataFrame) -> DataFrame:
    """Users (tier) with their tier's price and credits; an unknown or missing tier is the free one, of price 0."""
    free = tiers.where("price = 0").agg(F.min("tier").alias("_free"))  # one row
    rows = users.join(F.broadcast(free)).join(tiers.select(F.col("tier").alias("_tier"), "price", "credits"), F.col("tier") == F.col("_tier"), "left")
    base = tiers.where("price = 0").agg(F.min_by("credits", "tier").alias("_credits"))  # one row
    rows = rows.join(F.broadcast(base))
    known = F.col("_tier").isNotNull()
    return rows.select(*[c for c in users.columns if c != "tier"], F.when(known, F.col("tier")).otherwise(F.col("_free")).alias("tier"), F.coalesce("price", F.lit(0)).alias("price"), F.when(known, F.col("credits")).otherwise(F.col("_credits")).alias("credits"))


def without_tiers(tiers: DataFrame, gone: DataFrame, free: Column | None = None) -> DataFrame:
    """Tiers (tier, price) without those named; the free ones (by default all of price 0) stay, whoever names them."""
    named = gone.select(F.col("tier").alias("_tier")).distinct()
    stays = F.coalesce(F.col("price") == 0 if free is None else free, F.lit(False))
    return tiers.join(named, F.col("tier") == F.col("_tier"), "left").where(F.col("_tier").isNull() | stays).drop("_tier")


def set_config(config: DataFrame, changes: DataFrame) -> DataFrame:
    """key, value of a system's settings after changes: new keys come in, known ones get their value, a null value takes a key out."""
    both = config.join(changes.select("key", F.col("value").alias("_value"), F.lit(True).alias("_set")), "key", "full")
    return both.select("key", F.when(F.col("_set"), F.col("_value")).otherwise(F.col("value")).alias("value")).where("value is not null")


def page_charges(documents: DataFrame, rate: str = "0.1") -> DataFrame:
    """All pages are charged before they are read; failed documents are deleted (pages, failed)."""
    charge = (F.col("pages").cast(MONEY) * F.lit(rate).cast("decimal(18,8)")).cast(MONEY)
    return documents.withColumn("charge", charge).withColumn("status", F.when(F.col("failed"), "DELETED").otherwise("READY"))


def latest(df: DataFrame, time: str, key: str, n: int = 100) -> DataFrame:
    return df.orderBy(F.desc(time), F.desc(key)).limit(n)


def activity(feeds: list[DataFrame], n: int = 100) -> DataFrame:
    """The latest rows of each feed, merged (kind, id, time, amount)."""
    out = None
    for f in feeds:
        part = latest(f, "time", "id", n)
        out = part if out is None else out.unionByName(part)
    return out.orderBy(F.desc("time"), "kind", "id")


def page(df: DataFrame, skip: int, limit: int, *order: Column) -> DataFrame:
    """One page of an ordered list."""
    if skip < 0 or not 1 <= limit <= 100:
        raise ValueError("skip must not be negative and limit must be from 1 to 100")
    return df.orderBy(*order).offset(skip).limit(limit)


def pending(df: DataFrame, only: bool) -> DataFrame:
    return df.where(~F.col("reviewed")) if only else df


def assembled(pages: DataFrame, document: str, order: str, text: str = "text") -> DataFrame:
    """A document's non-blank pages in order, joined by blank lines."""
    found = pages.where(F.length(X.clean(text)) > 0).groupBy(document).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("_p"))
    return found.select(document, F.array_join(F.col("_p.t"), "\n\n").alias("text"))
