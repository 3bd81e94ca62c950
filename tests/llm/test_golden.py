"""Golden records against plain Python."""

import datetime as dt
import random
import re

from ragloom.llm import golden_records

SCHEMA = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double"
FIELDS = ["source", "updated_at", "name", "email", "city", "nation_id", "segment", "balance"]
TRUST = {"store": 4, "crm": 3, "partner": 2, "web": 1}


def plain(rows):
    """cluster -> the golden record, by sorting each cluster's records."""
    clusters = {}
    for r in rows:
        r = dict(zip(["client_id", "master_id", *FIELDS], r, strict=True))
        for c in ("source", "name", "email", "city", "segment"):
            if r[c] is not None and re.fullmatch("[\x20\x09-\x0d]*", r[c]):
                r[c] = None
        if r["balance"] is not None and (r["balance"] != r["balance"] or abs(r["balance"]) == float("inf")):
            r["balance"] = None
        clusters.setdefault(r["master_id"] if r["master_id"] is not None else r["client_id"], []).append(r)
    out = {}
    for key, rs in clusters.items():
        latest = max((r["updated_at"] for r in rs if r["updated_at"]), default=None)
        for r in rs:
            r["stale"] = r["updated_at"] is None or latest - r["updated_at"] > dt.timedelta(hours=240)
            r["trust"] = TRUST.get(r["source"], 0)
            r["id"] = (r["client_id"] is None, r["client_id"] or 0)
            r["when"] = (dt.datetime.max - r["updated_at"]) if r["updated_at"] else dt.timedelta.max
            r["given"] = tuple((r[c] is not None, r[c] if r[c] is not None else 0) for c in ("source", "name", "email", "city", "nation_id", "segment", "balance"))
        recent = lambda r: (r["when"], -r["trust"], r["id"], r["given"])
        trusted = lambda r: (r["stale"], -r["trust"], r["when"], r["id"], r["given"])
        first = lambda c, by: min((r for r in rs if r[c] is not None), key=by, default={c: None, "client_id": None})
        segment, email, name = first("segment", recent), first("email", trusted), first("name", lambda r: (-len(r["name"]), *trusted(r)))
        balance = first("balance", lambda r: (r["segment"] != segment["segment"], *recent(r)))
        address = min(rs, key=lambda r: (-(r["city"] is not None) - (r["nation_id"] is not None), *recent(r)))
        given = address["city"] is not None or address["nation_id"] is not None
        out[key] = (len(rs), sum(r["stale"] for r in rs), name["name"], email["email"], segment["segment"], address["city"], address["nation_id"], balance["balance"], name["client_id"], email["client_id"], segment["client_id"], balance["client_id"], address["client_id"] if given else None)
    return out


COLS = ["n_records", "n_stale", "name", "email", "segment", "city", "nation_id", "balance", "name_from", "email_from", "segment_from", "balance_from", "address_from"]


def records(rng, n, clusters):
    base = dt.datetime(2024, 3, 1)
    pick = lambda xs: rng.choice(xs)
    out = []
    for i in range(n):
        at = None if rng.random() < 0.1 else base + dt.timedelta(hours=rng.choice([0, 24, 240, 241, 480]), microseconds=rng.choice([0, 0, 1]))
        out.append((i if rng.random() < 0.95 else None, pick([None, *range(clusters)]) if rng.random() < 0.9 else 10**6, pick(["store", "crm", "partner", "web", " web", "", None]), at, pick(["Jo", "Jö", "Joanna", "J😀", " ", None]), pick(["a@b", "c@d", "\t", None]), pick(["X", "Y", "", None]), pick([1, 2, None]), pick(["retail", "public", " \n", None]), pick([1.005, -2.5, 0.0, None, float("nan"), float("inf")])))
    return out


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r["cluster_id"]: tuple(r[c] for c in COLS) for r in golden_records.golden_records(df, **more).collect()}


def test_golden_records_equal_sorting(spark):
    rng = random.Random(3)
    rows = records(rng, 400, 60) + records(rng, 150, 1)  # ids repeat; one cluster holds a third
    rows += rows[:40]  # repeated rows
    assert run(spark, rows) == plain(rows)


def test_golden_records_of_nothing(spark):
    assert run(spark, []) == {}
    nulls = [(None, None, *[None] * 8)] * 3
    assert run(spark, nulls) == {None: (3, 3, *[None] * 11)}


def test_golden_records_read_no_other_columns(spark):
    rows = records(random.Random(5), 40, 9)
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    more = df.withColumns({c: F.lit("x") for c in ("cluster_id", "trust", "slot_", "best_name", "is_name", "a-b", "fresh")})
    key = lambda r: str(r)
    assert sorted(golden_records.golden_records(more).collect(), key=key) == sorted(golden_records.golden_records(df).collect(), key=key)


def test_long_names_win(spark):
    rows = [(1, None, "web", None, "x" * 200_000, None, None, None, None, None), (2, 1, "store", dt.datetime(2024, 1, 1), "y", "e", None, None, None, None)]
    got = run(spark, rows)[1]
    assert got[COLS.index("name_from")] == 1 and got[COLS.index("email_from")] == 2
