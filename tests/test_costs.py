"""Price lists that are too large to broadcast, and SKUs with most of the usage."""

from __future__ import annotations

from collections import Counter
from datetime import datetime, timedelta

import pytest

from dossier.operators import costs as C

DAY = datetime(2024, 1, 1)


def _tables(spark):
    usage = [
        (cloud, f"s{0 if i % 3 else i % 7}", "u", float(i), DAY + timedelta(days=i % 9), DAY + timedelta(days=i % 9 + 1), "A" if i % 2 else "B")
        for i in range(200)
        for cloud in ("x", None if i % 11 == 0 else "y")
    ]
    prices = [(cloud, f"s{k}", "u", DAY + timedelta(days=a), None if b is None else DAY + timedelta(days=b), 1.0 + k + a) for cloud in ("x", "y", None) for k in range(5) for a, b in ((0, 4), (3, None), (3, None))[: 1 + k % 3]]
    u = spark.createDataFrame(usage, "cloud string, sku_name string, usage_unit string, usage_quantity double, usage_start_time timestamp, usage_end_time timestamp, billing_origin_product string")
    p = spark.createDataFrame(prices, "cloud string, sku_name string, usage_unit string, price_start_time timestamp, price_end_time timestamp, price double")
    return usage, prices, u, p.selectExpr("*", "'EUR' AS currency_code", "named_struct('effective_list', named_struct('default', price)) AS pricing")


def _matches(row, prices):
    return [q[5] for q in prices if None not in row[:3] and q[:3] == row[:3] and row[4] >= q[3] and (q[4] is None or row[5] <= q[4])]


@pytest.mark.parametrize("most, bound", [(10**9, 10**6), (0, 10**6), (0, 20)])
def test_prices_meet_usage_whatever_their_size(spark, most, bound):
    usage, prices, u, p = _tables(spark)
    found = C.price_usage(u, p, most, bound)
    wanted = Counter((*row[:3], row[3], price, row[3] * price) for row in usage for price in _matches(row, prices))
    assert Counter(tuple(r) for r in found.select("cloud", "sku_name", "usage_unit", "usage_quantity", "unit_list_price", "effective_list_cost").collect()) == wanted
    counts = Counter((row[6], min(len(_matches(row, prices)), 2)) for row in usage)
    covered = C.price_coverage(u, p, most, bound).collect()
    assert {(r[0], k): n for r in covered for k, n in enumerate(r[1:]) if n} == dict(counts)


def test_usage_is_not_sorted_to_meet_a_large_price_list(spark):
    _, _, u, p = _tables(spark)
    for frame in (C.price_usage(u, p, 0), C.price_coverage(u, p, 0)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
