"""Usage priced by validity interval, and the cost reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.plans.durable import durable
from dossier.plans.sizing import BROADCAST_BYTES, HOT_GROUP_ROWS, checked_broadcast, measured_bytes, parts_for, split_hot

PRICE_KEYS = ("cloud", "sku_name", "usage_unit")
#: Rows are counted by so many buckets of keys to find frequent ones.
KEY_BUCKETS = 65_536


def _inside() -> Column:
    return (F.col("usage_start_time") >= F.col("price_start_time")) & (
        F.col("price_end_time").isNull() | (F.col("usage_end_time") <= F.col("price_end_time"))
    )


def _keyed(df: DataFrame) -> DataFrame:
    """``df`` with PRICE_KEYS as one column, which a constant among them can't part from how rows are dealt out; null if one of them is."""
    known = F.lit(True)
    for key in PRICE_KEYS:
        known = known & F.col(key).isNotNull()
    return df.withColumn("_price", F.when(known, F.struct(*PRICE_KEYS)))


def _meet(
    usage: DataFrame, prices: DataFrame, meet: Callable[[DataFrame, DataFrame], DataFrame], most: int = BROADCAST_BYTES, bound: int = HOT_GROUP_ROWS
) -> DataFrame:
    """``meet`` of usage and price list, which joins them on ``_price``.

    The price list is broadcast when its measured size allows it, so usage is read in place whatever the distribution of SKUs is. Otherwise
    both are partitioned by the keys, into tasks of a number of rows, and a task holds its part of the price list, not of the usage.
    Usage of buckets of keys with more than ``bound`` rows, which are few, meets their prices in place.
    """
    bucket = F.pmod(F.xxhash64("_price"), F.lit(KEY_BUCKETS))
    usage, p = _keyed(usage), durable(_keyed(prices).drop(*PRICE_KEYS))
    if measured_bytes(p) <= most:
        return meet(usage, F.broadcast(p))
    parts = parts_for(usage)

    def dealt(rows: DataFrame) -> DataFrame:
        return meet(rows.repartition(parts, "_price"), p.repartition(parts, "_price").hint("shuffle_hash"))

    ordinary, hot = split_hot(usage.withColumn("_bucket", bucket), ["_bucket"], bound)
    if hot is None:
        return dealt(usage)
    few = p.withColumn("_bucket", bucket).join(checked_broadcast(hot.select("_bucket").distinct()), "_bucket", "left_semi").drop("_bucket")
    return dealt(ordinary.drop("_bucket")).unionByName(meet(hot.drop("_bucket"), checked_broadcast(few, most)))


def price_usage(usage: DataFrame, prices: DataFrame, most: int = BROADCAST_BYTES, bound: int = HOT_GROUP_ROWS) -> DataFrame:
    """Usage joined to every price whose validity interval contains it; equal keys are cloud, SKU and unit."""
    listed = prices.select(*PRICE_KEYS, "price_start_time", "price_end_time", "currency_code", F.col("pricing.effective_list.default").alias("unit_list_price"))
    met = _meet(usage, listed, lambda u, p: u.join(p, "_price").where(_inside()).drop("_price", "price_start_time", "price_end_time"), most, bound)
    return met.withColumn("effective_list_cost", F.col("usage_quantity") * F.col("unit_list_price"))


def price_coverage(usage: DataFrame, prices: DataFrame, most: int = BROADCAST_BYTES, bound: int = HOT_GROUP_ROWS) -> DataFrame:
    """Usage rows per product by the number of prices that match them: none, one or several.

    Prices only depend on SKU and interval, so equal (keys, interval) usage is counted before it is priced.
    """
    keys = ["billing_origin_product", "_price", "usage_start_time", "usage_end_time"]

    def meet(u: DataFrame, p: DataFrame) -> DataFrame:
        grouped = u.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
        return grouped.join(p, "_price", "left").groupBy(*keys, "rows").agg(F.count_if(_inside()).alias("matches"))

    matched = _meet(usage.select(*PRICE_KEYS, *(k for k in keys if k != "_price")), prices.select(*PRICE_KEYS, "price_start_time", "price_end_time"), meet, most, bound)
    return matched.groupBy("billing_origin_product").agg(
        F.coalesce(F.sum(F.when(F.col("matches") == 0, F.col("rows"))), F.lit(0)).cast("long").alias("unpriced"),
        F.coalesce(F.sum(F.when(F.col("matches") == 1, F.col("rows"))), F.lit(0)).cast("long").alias("priced_once"),
        F.coalesce(F.sum(F.when(F.col("matches") > 1, F.col("rows"))), F.lit(0)).cast("long").alias("priced_repeatedly"),
    )


def _report(priced: DataFrame, groups: Sequence[Column | str], quantity: bool = True, bounds: bool = True) -> DataFrame:
    measures = []
    if quantity:
        measures.append(F.round(F.sum("usage_quantity"), 4).alias("usage_quantity"))
    measures.append(F.round(F.sum("effective_list_cost"), 2).alias("effective_list_cost"))
    if bounds:
        measures += [F.min("usage_start_time").alias("first_usage"), F.max("usage_end_time").alias("last_usage")]
    return priced.groupBy(*groups).agg(*measures)


def cost_by_product(usage: DataFrame, prices: DataFrame) -> DataFrame:
    return _report(price_usage(usage, prices), ["billing_origin_product", "sku_name", "usage_unit", "currency_code"])


def latest_jobs(jobs: DataFrame) -> DataFrame:
    """Newest name of each (workspace_id, job_id)."""
    return (
        jobs.groupBy("workspace_id", "job_id")
        .agg(F.max(F.struct("change_time", "change_id", "name")).alias("_l"))
        .select("workspace_id", "job_id", F.col("_l.name").alias("name"))
    )


def cost_by_job(usage: DataFrame, prices: DataFrame, jobs: DataFrame, product: str = "JOBS") -> DataFrame:
    """Cost per job run with the newest job name, the name recorded with the usage or the job id."""
    priced = price_usage(usage.where(F.col("billing_origin_product") == product), prices).select(
        "workspace_id",
        F.col("usage_metadata.job_id").alias("job_id"),
        F.col("usage_metadata.job_run_id").alias("job_run_id"),
        F.col("usage_metadata.job_name").alias("_recorded"),
        "currency_code", "usage_quantity", "effective_list_cost", "usage_start_time", "usage_end_time",
    )
    # Usage is summed per run before it meets the names.
    keys = ["workspace_id", "job_id", "job_run_id", "_recorded", "currency_code"]
    summed = priced.groupBy(*keys).agg(
        F.sum("usage_quantity").alias("usage_quantity"),
        F.sum("effective_list_cost").alias("effective_list_cost"),
        F.min("usage_start_time").alias("usage_start_time"),
        F.max("usage_end_time").alias("usage_end_time"),
    )
    named = summed.join(latest_jobs(jobs), ["workspace_id", "job_id"], "left")
    name = F.coalesce("name", "_recorded", F.concat(F.lit("job_id="), F.col("job_id").cast("string")))
    return _report(named.withColumn("job_name", name), ["job_name", "job_id", "job_run_id", "currency_code"])


def daily_cost_trend(usage: DataFrame, prices: DataFrame) -> DataFrame:
    return _report(price_usage(usage, prices), ["usage_date", "billing_origin_product", "currency_code"], quantity=False, bounds=False)


def cost_by_app(usage: DataFrame, prices: DataFrame, product: str = "APPS") -> DataFrame:
    priced = price_usage(usage.where(F.col("billing_origin_product") == product), prices)
    groups = [F.col("usage_metadata.app_name").alias("app_name"), F.col("usage_metadata.app_id").alias("app_id"), "currency_code"]
    return _report(priced, groups)


def cost_by_endpoint(usage: DataFrame, prices: DataFrame) -> DataFrame:
    serving = F.col("usage_metadata.endpoint_name").isNotNull() | F.col("sku_name").like("%REAL_TIME_INFERENCE%")
    groups = [F.col("usage_metadata.endpoint_name").alias("endpoint_name"), "sku_name", "currency_code"]
    return _report(price_usage(usage.where(serving), prices), groups)


def cost_by_notebook(usage: DataFrame, prices: DataFrame) -> DataFrame:
    m = "usage_metadata."
    attributed = F.col(m + "notebook_path").isNotNull() | F.col(m + "job_id").isNotNull() | F.col(m + "job_name").isNotNull()
    groups = [
        "usage_date",
        *[F.col(m + c).alias(c) for c in ("notebook_path", "job_name", "job_id", "job_run_id")],
        F.col("identity_metadata.run_as").alias("run_as"),
        "sku_name",
        "currency_code",
    ]
    return _report(price_usage(usage.where(attributed), prices), groups, bounds=False)
