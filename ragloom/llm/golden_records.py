"""Golden records: one record for each cluster of records of one thing, field by field, by lexicographic elimination.

Each field has its candidates, the records that hold a value, and an order of criteria. A round takes every field one criterion
further: an aggregate finds the best value among a cluster's candidates, and a semi-join keeps those that have it. Records that
are left in no field are dropped, clusters whose fields all have one candidate left are done, and the next round sees only the
rest. The survivors of one field can be a criterion of another: whether a record has the chosen segment heads the order for its
balance.

A cluster may hold a third of all records. Aggregates combine before the shuffle; their results go back to the records by
(cluster, slot), a slot being a hash of the record, so a large cluster's records stay spread over many tasks. Nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, attached

TRUST = ("store", "crm", "partner", "web")  # by falling trust
STALE_HOURS = 240
BLANK = r"^[\x20\x09-\x0D]*$"
#: What the operator reads; records that agree in all of it are one candidate.
READ = ["client_id", "master_id", "source", "updated_at", "name", "email", "city", "nation_id", "segment", "balance"]


@dataclass(frozen=True)
class Best:
    """A criterion: the column and whether its largest value is best. Null comes last."""

    column: str
    largest: bool = True

    def of(self, alive: Column) -> Column:
        found = F.when(alive, F.col(self.column))
        return F.max(found) if self.largest else F.min(found)


def eliminate(rows: DataFrame, key: str, by: Sequence[str], orders: Mapping[str, Sequence[Best]], tmp: Scratch, tag: str) -> DataFrame:
    """The rows that survive in a field at least. ``rows`` holds ``key``, the criteria and for each field of ``orders`` a boolean
    column ``is_<field>``, its candidates; in the result that says whether the row is the field's best. Rows that agree in all
    criteria of a field survive together. ``by``: columns whose hash spreads the rows of a key."""
    done, alive = [], {f: F.col(f"is_{f}") for f in orders}
    some = F.greatest(F.lit(False), *alive.values())
    rows = tmp.table(rows.where(some), f"{tag}-candidates")
    for turn in range(max(map(len, orders.values()))):
        open_ = {f: order[turn] for f, order in orders.items() if turn < len(order)}
        best = rows.groupBy(key).agg(*(b.of(alive[f]).alias(f"best_{f}") for f, b in open_.items()), F.greatest(*(F.count_if(a) for a in alive.values()), F.lit(0)).alias("left"))
        found = attached(rows, best, [key], by).withColumns({f"is_{f}": alive[f] & F.col(b.column).eqNullSafe(F.col(f"best_{f}")) for f, b in open_.items()})
        found = tmp.table(found.where(some).select(*rows.columns, "left"), f"{tag}-{turn}")
        done.append(found.where("left <= 1").drop("left"))
        rows = found.where("left > 1").drop("left")
        if rows.isEmpty():
            break
    else:
        done.append(rows)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _text(column: str) -> Column:
    return F.when(~F.col(column).rlike(BLANK), F.col(column))


def _records(clients: DataFrame) -> DataFrame:
    """The columns that are read, with blank strings and balances that are no numbers as null, and the cluster."""
    balance = F.col("balance").cast("double")
    real = F.when(~F.isnan(balance) & (F.abs(balance) < float("inf")), balance)
    texts = {c: _text(c) for c in ("source", "name", "email", "city", "segment")}
    trust = F.coalesce(F.array_position(F.array(*map(F.lit, reversed(TRUST))), F.col("source")), F.lit(0))
    rows = clients.select(*READ).withColumns(texts | {"balance": real})
    return rows.withColumns({"cluster_id": F.coalesce("master_id", "client_id"), "trust": trust, "given": F.struct("source", "name", "email", "city", "nation_id", "segment", "balance")})


def golden_records(clients: DataFrame, stale_hours: int = STALE_HOURS) -> DataFrame:
    """One row per cluster_id (master_id, or client_id where that is null): n_records, n_stale, name, email, segment, city, nation_id,
    balance, and for each the client_id it comes from (address_from for city and nation_id).

    Columns are those of ``clients``; others aren't read, so their names don't matter. Strings that are empty or blank are null, as
    are balances that are NaN or infinite; an unknown or null source is trusted least. A record is stale if updated_at is null or
    more than ``stale_hours`` before its cluster's latest. Records without both ids form one cluster of null. Repeated rows count in
    n_records and n_stale. Of records that tie in all criteria and client_id, the one with the smallest values (source, name, email,
    city, nation_id, segment, balance; null first) gives the field. A field that no record holds is null, with a null origin. An
    empty table gives an empty result.
    """
    tmp, out = Scratch(clients.sparkSession), Scratch(clients.sparkSession)
    by = ["client_id", "updated_at", "given"]
    rows = tmp.table(_records(clients), "records")
    latest = rows.groupBy("cluster_id").agg(F.max("updated_at").alias("latest"), F.count(F.lit(1)).alias("members"))
    fresh = F.coalesce(F.col("updated_at") >= F.col("latest") - F.make_dt_interval(hours=F.lit(stale_hours)), F.lit(False))
    rows = attached(rows, latest, ["cluster_id"], by).withColumn("fresh", fresh)
    filled = F.col("city").isNotNull().cast("int") + F.col("nation_id").isNotNull().cast("int")
    rows = tmp.table(rows.withColumns({"points": F.length("name"), "filled": filled}).drop("latest", "master_id"), "fresh")
    counts = rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_records"), F.count_if(~F.col("fresh")).alias("n_stale"))

    last = [Best("client_id", False), Best("given", False)]
    recent = [Best("updated_at"), Best("trust"), *last]
    trusted = [Best("fresh"), Best("trust"), Best("updated_at"), *last]
    orders = {"segment": recent, "email": trusted, "name": [Best("points"), *trusted], "address": [Best("filled"), *recent]}
    marked = rows.withColumns({f"is_{c}": F.col(c).isNotNull() for c in ("segment", "email", "name")} | {"is_address": F.lit(True)})
    alone = F.col("members") == 1  # nothing to eliminate
    chosen = eliminate(marked.where(~alone), "cluster_id", by, orders, tmp, "fields").unionByName(marked.where(alone))
    take = lambda f, c: F.max(F.when(F.col(f"is_{f}"), F.col(c)))  # noqa: E731  equal in all rows of the field that are left
    best = chosen.groupBy("cluster_id").agg(
        *(x for f in ("name", "email", "segment") for x in (take(f, f).alias(f), take(f, "client_id").alias(f"{f}_from"))),
        take("address", "city").alias("city"), take("address", "nation_id").alias("nation_id"), F.max(F.when(F.col("is_address") & (F.col("filled") > 0), F.col("client_id"))).alias("address_from"),
    )
    best = out.table(best, "best")

    holders = rows.where(F.col("balance").isNotNull())
    segments = best.select("cluster_id", F.col("segment").alias("chosen"))
    single = holders.where(alone).withColumns({"match": F.lit(True), "is_balance": F.lit(True)})
    marked = attached(holders.where(~alone), segments, ["cluster_id"], by).withColumns({"match": F.col("segment").eqNullSafe(F.col("chosen")), "is_balance": F.lit(True)}).drop("chosen")
    balances = eliminate(marked, "cluster_id", by, {"balance": [Best("match"), *recent]}, tmp, "balance").unionByName(single)
    balances = out.table(balances.groupBy("cluster_id").agg(take("balance", "balance").alias("balance"), take("balance", "client_id").alias("balance_from")), "balances")
    counts = out.table(counts, "counts")
    tmp.drop()
    found = counts.join(best, counts.cluster_id.eqNullSafe(best.cluster_id)).drop(best.cluster_id)
    return found.join(balances, counts.cluster_id.eqNullSafe(balances.cluster_id), "left").drop(balances.cluster_id)


def op13_golden_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = golden_records(spark.read.parquet(f"{sf_dir}/clients.parquet"))
    cents = F.floor(F.col("balance") * 100 + 0.5).alias("balance_cents")
    return found.select("cluster_id", "n_records", "n_stale", "name", "email", "segment", "city", "nation_id", cents, *(f"{f}_from" for f in ("name", "email", "segment", "balance", "address")))


OP13_SQL = """
WITH s AS (SELECT *, coalesce(master_id, client_id) AS cluster_id FROM clients),
b AS (SELECT client_id, cluster_id, updated_at, nation_id, balance, max(updated_at) OVER (PARTITION BY cluster_id) AS latest,
    CASE source WHEN 'store' THEN 4 WHEN 'crm' THEN 3 WHEN 'partner' THEN 2 WHEN 'web' THEN 1 ELSE 0 END AS trust,
    CASE WHEN regexp_full_match(name, '[\\x20\\x09-\\x0D]*') THEN NULL ELSE name END AS name, CASE WHEN regexp_full_match(email, '[\\x20\\x09-\\x0D]*') THEN NULL ELSE email END AS email,
    CASE WHEN regexp_full_match(segment, '[\\x20\\x09-\\x0D]*') THEN NULL ELSE segment END AS segment, CASE WHEN regexp_full_match(city, '[\\x20\\x09-\\x0D]*') THEN NULL ELSE city END AS city FROM s),
r AS (SELECT *, coalesce(updated_at >= latest - INTERVAL 240 HOUR, false)::INT AS fresh, (city IS NOT NULL)::INT + (nation_id IS NOT NULL)::INT AS filled FROM b),
g AS (SELECT cluster_id, count(*) AS n_records, count(*) FILTER (fresh = 0) AS n_stale FROM r GROUP BY cluster_id),
n AS (SELECT DISTINCT ON (cluster_id) cluster_id, name, client_id AS name_from FROM r WHERE name IS NOT NULL ORDER BY cluster_id, length(name) DESC, fresh DESC, trust DESC, updated_at DESC NULLS LAST, client_id),
e AS (SELECT DISTINCT ON (cluster_id) cluster_id, email, client_id AS email_from FROM r WHERE email IS NOT NULL ORDER BY cluster_id, fresh DESC, trust DESC, updated_at DESC NULLS LAST, client_id),
m AS (SELECT DISTINCT ON (cluster_id) cluster_id, segment, client_id AS segment_from FROM r WHERE segment IS NOT NULL ORDER BY cluster_id, updated_at DESC NULLS LAST, trust DESC, client_id),
a AS (SELECT DISTINCT ON (cluster_id) cluster_id, city, nation_id, CASE WHEN filled > 0 THEN client_id END AS address_from FROM r ORDER BY cluster_id, filled DESC, updated_at DESC NULLS LAST, trust DESC, client_id),
l AS (SELECT DISTINCT ON (r.cluster_id) r.cluster_id, balance, client_id AS balance_from FROM r LEFT JOIN m ON r.cluster_id = m.cluster_id WHERE balance IS NOT NULL
    ORDER BY r.cluster_id, (r.segment IS NOT DISTINCT FROM m.segment) DESC, updated_at DESC NULLS LAST, trust DESC, client_id)
SELECT g.cluster_id, n_records, n_stale, name, email, segment, city, nation_id, floor(balance * 100 + 0.5)::BIGINT AS balance_cents, name_from, email_from, segment_from, balance_from, address_from
FROM g LEFT JOIN n USING (cluster_id) LEFT JOIN e USING (cluster_id) LEFT JOIN m USING (cluster_id) LEFT JOIN a USING (cluster_id) LEFT JOIN l USING (cluster_id)
"""
