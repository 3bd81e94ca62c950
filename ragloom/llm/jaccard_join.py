"""Jaccard self-join of word-shingle sets with adaptive multi-match prefixes, and the components of its links.

Shingles are ordered by a fixed-width count sketch of the whole corpus, rare ones first. Two sets of Jaccard likeness t or more
share at least p of the first |x| - ceil(t |x|) + p shingles of either, for any p up to the overlap. So each document picks its
own p: a longer prefix costs more postings, estimated from the sketch, but asks for p shared shingles before a pair is verified.
A pair is a candidate if it shares as many prefix shingles as the smaller p of the two.

A prefix shingle that no other prefix holds is missing from every set whose prefix reaches beyond it. So a posting bounds the
overlap of each pair it could bring by the shingles missed before it; postings and pairs whose bound is too low are dropped.

A group of many near copies would give all its pairs, so links are found in rounds. Documents with equal sets are one class from
the start. In a star round each class is verified against one partner, the class that leads most of the postings they share (in the
first round those that miss least lead), and links merge components. Only postings that then still lie in several components are joined pair by pair, and only across
components: a link inside one can't change it. There each set brings a parity sketch, whose bits count its shingles modulo 2: two
sketches differ in at most as many bits as their sets in shingles, so pairs that differ too much are dropped as they are joined.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, blocks, documents, partitions, schema_of, small_batches
from .sketches import slices, summed
from .words import Spans, hashed

BITS, MOST, ROUNDS, SHARE = 20, 8, 1, 32
#: 64-bit words of a set's parity sketch.
PARITY = 8
#: Documents that are picked for verification by broadcast of their ids; beyond it by a join.
FEW = 400_000
#: Cost of verifying a pair against that of reading a posting.
VERIFY = 20.0


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z only


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; a shorter text is one shingle, one without words has none."""
    words = [_words(t) for t in texts]
    lens = [len(w) for w in words]
    spans = Spans(hashed([x for w in words for x in w]))
    every = spans.windows(size)
    out, at = [], 0
    for n in lens:
        if n >= size:
            out.append(np.unique(every[at : at + n - size + 1]))
        elif n:
            out.append(spans(np.array([at]), np.array([at + n])))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def shingle_counts(docs: DataFrame, size: int) -> np.ndarray:
    """How many documents' shingles fall into each of 2**BITS cells, over all documents."""

    def run(batches):
        counts = np.zeros(1 << BITS, np.int64)
        for b in blocks(batches):
            cells = np.concatenate([np.zeros(0, np.uint64), *shingle_sets(b.column("text").to_pylist(), size)]) >> np.uint64(64 - BITS)
            counts += np.bincount(cells.astype(np.int64), minlength=1 << BITS)
        yield from slices(counts)

    return summed(docs.select("text").mapInArrow(run, "slice int, counts binary"), 1 << BITS)


def needed(n: int, percent: int) -> int:
    """The least overlap with any set that is like enough."""
    return -(-percent * n // 100)


def prefix(s: np.ndarray, counts: np.ndarray, floor: float, percent: int) -> tuple[int, np.ndarray]:
    """(p, the shingles of the prefix) with the p of least estimated cost."""
    load = counts[(s >> np.uint64(64 - BITS)).astype(np.int64)]
    order = np.lexsort((s, load))
    t = needed(len(s), percent)
    most = min(MOST, t)
    upto = len(s) - t + most
    rows = np.maximum(load[order[:upto]] - floor, 0)  # postings beyond the cell's usual noise
    run = np.cumsum(rows)
    ends = np.arange(upto - most, upto)
    cost = run[ends] + VERIFY * run[ends] / np.arange(1, most + 1) ** 2 + np.arange(most)
    p = int(cost.argmin()) + 1
    return p, s[order[: upto - most + p]]


def parity(s: np.ndarray) -> np.ndarray:
    """Bit i is whether an odd number of the shingles fall on i."""
    width = 64 * PARITY
    at = (s * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(64 - width.bit_length() + 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=width) & 1).astype(np.uint8)).view(np.int64)


def prefixes(docs: DataFrame, counts, floor: float, size: int, percent: int) -> DataFrame:
    """doc rows with the set's identity (size and two sums of its hashes), p, the prefix and the parity sketch."""
    names = ["doc_id", "key", "n", "s1", "s2", "p", "prefix", "parity"]

    def run(batches):
        for b in blocks(batches):
            rows = []
            for s in shingle_sets(b.column("text").to_pylist(), size):
                p, pre = prefix(s, counts.value, floor, percent) if len(s) else (0, s)
                again = (s ^ np.uint64(0x5851F42D4C957F2D)) * np.uint64(0xDA942042E4DD58B5)
                two = np.array([s.sum(dtype=np.uint64), (again ^ (again >> np.uint64(32))).sum(dtype=np.uint64)]).view(np.int64)
                rows.append((len(s), int(two[0]), int(two[1]), p, pre.view(np.int64), parity(s)))
            n, s1, s2, p, pre, bits = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(p, pa.int32()), pa.array(pre, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], names=names)

    schema = schema_of(doc_id=docs.schema["doc_id"].dataType, key="long", n="long", s1="long", s2="long", p="int", prefix="array<long>", parity="array<long>")
    return docs.select("doc_id", "key", "text").mapInArrow(run, schema)


def linked(docs: DataFrame, names: DataFrame, pairs: DataFrame, size: int, percent: int, tmp: Scratch, tag: str) -> DataFrame:
    """The rows of ``pairs`` (a, b) whose sets are alike enough. A set goes to a task once with up to ``SHARE`` partners. ``names``
    (rid, doc_id, key) says which row of ``docs`` has a node's text."""
    spark = docs.sparkSession
    pairs = tmp.table(pairs.join(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / SHARE).alias("shares")), "b").select("a", "b", F.pmod("a", "shares").alias("share")), f"pairs{tag}")
    rows = pairs.select(F.col("a").alias("rid"), "b", "share", F.lit(1).alias("kind")).unionByName(pairs.select(F.col("b").alias("rid"), "b", "share", F.lit(0).alias("kind")).distinct())

    def sets(batches):
        for batch in blocks(batches):
            found = [s.tobytes() for s in shingle_sets(batch.column("text").to_pylist(), size)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rid", "b", "share", "kind")), pa.array(found, pa.binary())], names=["rid", "b", "share", "kind", "shingles"])

    def compare(batches):
        hub, held = None, None
        for batch in batches:
            out = []
            for rid, b, share, kind, x in zip(*(batch.column(c).to_pylist() for c in ("rid", "b", "share", "kind", "shingles")), strict=True):
                x = np.frombuffer(x, np.uint64)
                if kind == 0:
                    hub, held = (b, share), x
                    continue
                if (b, share) != hub:
                    raise RuntimeError("a pair lost its partner's set")
                both = len(np.intersect1d(x, held, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(held) - both):
                    out.append((rid, b))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    ids = names.join(rows.select("rid").distinct(), "rid").withColumnsRenamed({"doc_id": "_id", "key": "_key"})
    if ids.count() <= FEW:
        ids = F.broadcast(ids)
    texts = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))).select("rid", "text")
    there = rows.join(texts, "rid").select("rid", "b", "share", "kind", "text").mapInArrow(sets, "rid long, b long, share long, kind int, shingles binary")
    there = there.repartition(partitions(spark), "b", "share").sortWithinPartitions("b", "share", "kind")
    return tmp.table(there.mapInArrow(compare, "a long, b long").distinct(), f"links{tag}")


def components(edges: DataFrame, out: Scratch, tag: str) -> DataFrame:
    """(node, root) of every node of the edges (a, b); root is the smallest node. Alternating stars until nothing changes."""
    tmp = Scratch(edges.sparkSession)

    def mark(e):
        r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(r)

    e = tmp.table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = mark(e)
    while before[0]:
        last = [*tmp.paths]
        both = tmp.table(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both")
        least = tmp.table(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        tmp.drop(*last)
        e = tmp.table(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        tmp.drop("both", "least")
        least = tmp.table(e.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        e = tmp.table(small.where("a <> b").distinct(), "small")
        tmp.drop("large", "least")
        now = mark(e)
        if now == before:
            break
        before = now
    found = out.table(e.select(F.col("a").alias("node"), F.col("b").alias("root")), f"labels{tag}")
    tmp.drop()
    return found


def _missed(posts: DataFrame) -> DataFrame:
    """Adds how many shingles of the same prefix stand before a posting and aren't among the postings."""
    return posts.withColumn("miss", F.col("pos") + 1 - F.row_number().over(Window.partitionBy("rid").orderBy("pos")))


def _shared(reps: DataFrame, percent: int, tmp: Scratch) -> DataFrame:
    """The postings that can still bring a link, with ``miss``, and ``off``, the share of their set that is missed at last."""
    posts = reps.select("rid", F.posexplode("prefix").alias("pos", "token"))
    tokens = tmp.table(posts.groupBy("token").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("token"), "tokens")
    posts = _missed(posts.join(tokens, "token").select("rid", "pos", "token").join(reps.select("rid", "n", "p"), "rid"))
    posts = tmp.table(posts.where((F.col("n") - F.col("miss")) * 100 >= F.col("n") * percent), "shared")
    posts = tmp.table(posts.withColumn("off", F.max("miss").over(Window.partitionBy("rid")) / F.col("n")), "prefix-postings")
    tmp.drop("tokens", "shared")
    return posts


def _bound(a: str, am: str, b: str, bm: str, percent: int):
    """Whether two sets of sizes a and b that miss am and bm shingles can be alike enough."""
    return F.least(F.col(a) - F.col(am), F.col(b) - F.col(bm)) * (100 + percent) >= (F.col(a) + F.col(b)) * percent


def _near_parity(a: str, an: str, b: str, bn: str, percent: int):
    """Whether two parity sketches differ in no more bits than like sets of sizes an and bn may differ in shingles."""
    total = F.col(an) + F.col(bn)
    differ = sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(1, PARITY)), F.bit_count(F.col(a)[0].bitwiseXOR(F.col(b)[0])))
    return (total - differ) * (100 + percent) >= total * 2 * percent


def similar_groups(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text", links_too: bool = False):
    """One row per input row: doc_id, key (a hash that with the id names the row), n_shingles, class_id (of equal sets), root_id and
    component_id (the smallest id reachable by links).

    Documents link when the Jaccard similarity of their sets of ``size``-word shingles is ``percent`` / 100 or more; a text with
    fewer words is one shingle, one without words (null, empty) has none and links with nothing (class and root are null). Only A-Z
    is lower-cased. A text's set is held by one task, however long it is. Rows repeated with id and text are one node; rows with equal
    ids are nodes of their own; a null id is never the smallest. Other columns are not read, so their names don't matter. An empty
    table gives an empty result. With ``links_too`` also the links found on the way, between class_ids.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tmp, out = Scratch(spark), Scratch(spark)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(id_col), F.col(text)).alias("key"))
    total = shingle_counts(docs, size)
    counts = spark.sparkContext.broadcast(total)  # 2**BITS numbers
    found = tmp.table(prefixes(docs, counts, float(np.median(total)), size, percent), "prefixes")
    same = ["n", "s1", "s2"]
    classes = found.groupBy(*same).agg(F.min("key").alias("first"), F.min("doc_id").alias("least_id"))
    classes = tmp.table(classes.withColumn("rid", F.monotonically_increasing_id()), "classes")  # written, so the numbers stay
    ids = out.table(found.select("doc_id", "key", *same), "sets")
    first = classes.where("n > 0").select(*same, F.col("first").alias("key"), "rid")
    reps = tmp.table(found.join(first, [*same, "key"]).dropDuplicates(["rid"]).select("rid", "doc_id", "key", "n", "p", "prefix", "parity"), "reps")
    tmp.drop("prefixes")
    names = reps.select("rid", "doc_id", "key")
    posts = _shared(reps, percent, tmp)
    labels, links = None, None
    for turn in range(ROUNDS + 1):
        live = posts.withColumn("root", F.col("rid")) if labels is None else posts.join(labels, posts.rid == labels.node, "left").select(*posts.columns, F.coalesce("root", "rid").alias("root"))
        lead = F.col("off") if turn == 0 else F.lit(0.0)
        heads = live.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min(F.struct(lead.alias("lead"), F.xxhash64("rid", F.lit(turn)).alias("h"), F.col("rid").alias("head"), F.col("n").alias("head_n"), F.col("root").alias("head_root"), F.col("miss").alias("head_miss"))).alias("x")).where("lo < hi")
        heads = tmp.table(heads.select("token", "x.head", "x.head_n", "x.head_root", "x.head_miss"), f"heads{turn}")
        live = tmp.table(live.join(heads.select("token"), "token"), f"live{turn}")
        if turn < ROUNDS:
            near = live.join(heads, "token").where((F.col("root") != F.col("head_root")) & _bound("n", "miss", "head_n", "head_miss", percent)).groupBy("rid", "head").agg(F.count(F.lit(1)).alias("k"))
            pairs = near.groupBy("rid").agg(F.max(F.struct("k", "head")).alias("x")).select(F.col("rid").alias("a"), F.col("x.head").alias("b"))
        else:
            live = live.join(reps.select("rid", "parity"), "rid")
            one = live.select("token", *(F.col(c).alias(f"a_{c}") for c in ("rid", "n", "p", "pos", "miss", "root", "parity")))
            two = live.select("token", *(F.col(c).alias(f"b_{c}") for c in ("rid", "n", "p", "pos", "miss", "root", "parity")))
            both = one.join(two, "token").where((F.col("a_rid") < F.col("b_rid")) & (F.col("a_root") != F.col("b_root")) & _bound("a_n", "a_miss", "b_n", "b_miss", percent) & _near_parity("a_parity", "a_n", "b_parity", "b_n", percent))
            both = both.groupBy("a_rid", "b_rid", "a_n", "b_n", F.least("a_p", "b_p").alias("p")).agg(F.count(F.lit(1)).alias("k"), F.max("a_pos").alias("a_at"), F.max("b_pos").alias("b_at"))
            # all that is shared up to the last shared posting is among the postings; what follows it bounds the rest
            rest = F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at")) - 1
            pairs = both.where((F.col("k") >= F.col("p")) & ((F.col("k") + rest) * (100 + percent) >= (F.col("a_n") + F.col("b_n")) * percent)).select(F.col("a_rid").alias("a"), F.col("b_rid").alias("b"))
        pairs = tmp.table(pairs, f"candidates{turn}")
        tmp.drop(f"heads{turn}", f"live{turn}")
        if pairs.isEmpty():
            continue  # without a star candidate the pair round still has all to do
        new = linked(docs, names, pairs, size, percent, out if links_too else tmp, str(turn))
        links = new if links is None else links.unionByName(new)
        edges = new if labels is None else new.unionByName(labels.select(F.col("node").alias("a"), F.col("root").alias("b")))
        labels = components(edges, tmp, str(turn))
    roots = classes.where("n > 0").select(*same, F.col("rid").alias("class_id"), "least_id")
    if labels is not None:
        roots = roots.join(labels.withColumnRenamed("node", "class_id"), "class_id", "left").withColumn("root_id", F.coalesce("root", "class_id"))
        least = roots.groupBy("root_id").agg(F.min("least_id").alias("component_id"))
        roots = roots.join(least, "root_id").select(*same, "class_id", "root_id", "component_id")
    else:
        roots = roots.select(*same, "class_id", F.col("class_id").alias("root_id"), F.col("least_id").alias("component_id"))
    roots = out.table(roots, "roots")
    tmp.drop()
    found = ids.join(roots, same, "left")
    found = found.select("doc_id", "key", F.col("n").alias("n_shingles"), "class_id", "root_id", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return (found, links) if links_too else found


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with the smallest id of each group of near duplicates, one a group, with all their columns, whatever these are
    called. Rows without words all stay, but for repeated ones."""
    groups = similar_groups(docs, size, percent, id_col, text)
    alone = F.when(F.col("root_id").isNull(), F.struct("doc_id", "key"))
    stay = groups.groupBy("root_id", alone.alias("alone")).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("x"))
    stay = Scratch(docs.sparkSession).table(stay.select(F.col("x.doc_id").alias("_id"), F.col("x.key").alias("_key")), "stay")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text)).alias("key"))
    rows = rows.join(stay, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left_semi")
    return rows.groupBy("doc_id", "key").agg(F.first("row").alias("row")).select("row.*")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(documents(spark, sf_dir), 4, 85).select("doc_id", "n_shingles", "component_id")


OP8_SQL = """
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i : i + 3], ' ') END AS shingle FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 3, 1))) AS i FROM t WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM s AS a JOIN s AS b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id JOIN n AS x ON x.doc_id = a.doc_id JOIN n AS y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
c AS (SELECT doc_id AS node, doc_id AS root FROM t UNION SELECT l.b, c.root FROM c JOIN l ON l.a = c.node WHERE c.root < l.b)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, min(c.root) AS component_id FROM t LEFT JOIN n ON n.doc_id = t.doc_id JOIN c ON c.node = t.doc_id GROUP BY ALL
"""
