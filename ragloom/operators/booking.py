"""Bookings: insert if absent, cancel if present, over a table of slots. The doctor is no part of the key; nulls never match."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["username", "idCard", "department", "date", "time"]
#: Messages.
BOOKED, TAKEN, CANCELLED, NOT_FOUND = "预约成功，并返回预约详情", "您在相同的科室和时间已有预约", "取消预约成功", "您没有预约记录，请核对预约科室和时间"


def _whole() -> Column:
    return reduce(lambda x, y: x & y, (F.col(k).isNotNull() for k in KEY))


def find(table: DataFrame, **key) -> DataFrame:
    return table.where(reduce(lambda x, y: x & y, (F.col(k) == F.lit(key[k]) for k in KEY))).limit(1)


def book(table: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new table, message of each request). Of requests for one slot the first (by request_id, which is 1 or more) gets it; its
    id is the largest one so far plus its request_id. Requests are cut down to one a slot before they meet the table."""
    slots = requests.where(_whole()).groupBy(*KEY).agg(F.min(F.struct("request_id", "doctorName")).alias("first"))
    free = slots.join(table.select(*KEY), KEY, "left_anti").select("first.request_id", *KEY, "first.doctorName")
    free = free.unionByName(requests.where(~_whole()).select(free.columns))
    last = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    fresh = free.crossJoin(F.broadcast(last)).withColumn("id", F.col("_last") + F.col("request_id"))
    messages = requests.select("request_id").join(free.select("request_id", F.lit(BOOKED).alias("m")), "request_id", "left").select("request_id", F.coalesce("m", F.lit(TAKEN)).alias("message"))
    return table.unionByName(fresh.select(table.columns)), messages


def cancel(table: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table without the bookings found, message of each request). One booking goes for a request, the one of the smallest id."""
    held = table.where(_whole()).groupBy(*KEY).agg(F.min("id").alias("id"))  # one row a slot, so that a request meets one at most
    hit = requests.join(held, KEY).groupBy("request_id").agg(F.min("id").alias("id"))
    rest = table.join(hit.select("id").distinct(), "id", "left_anti").select(table.columns)
    return rest, requests.select("request_id").join(hit, "request_id", "left").select("request_id", F.when(F.col("id").isNotNull(), CANCELLED).otherwise(NOT_FOUND).alias("message"))


def available(requests: DataFrame) -> DataFrame:
    """The availability check has no schedule behind it and always says yes."""
    return requests.withColumn("available", F.lit(True))
