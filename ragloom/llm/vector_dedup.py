"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations.

A rotation is three rounds of random signs and a Hadamard transform; the cross-polytope hash of a vector is the signed axis that its
rotation is nearest to. A bucket is named by several hashes, as many as keep the expected number of unlike vectors met in buckets
below MEETS a vector, and there are more tables and probes for more hashes (`plan`). Probes exchange one hash for the second or third
nearest axis, those that lose least first; two vectors meet if any of their buckets is the same.

Equal vectors are one class. A group of many near copies would still give all its pairs, so classes are first gathered into balls:
vectors of one bucket whose cosine with the ball's leader is TIGHT or more, so that any two of them are certain to be linked. Buckets
are joined by ball, with sign sketches that drop balls too far apart. Candidate pairs of balls are verified: by the angle of their
leaders where that and the radii decide for all members alike, else member by member in blocks of vectors. Links are counted, not
listed; components are those of the balls.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, attached, partitions, small_batches
from .jaccard_join import components
from .words import mix

COSINE, SEED = 0.9, 12
#: Unlike vectors that a vector may be expected to meet in its buckets.
MEETS = 64
#: Members of a bucket that one task gathers into balls, unless a fair share of all is more, and members of a block.
GATHER, BLOCK = 4096, 256
#: Bits of a sign sketch, and how many deviations beyond the expected ones may differ.
SKETCH, SLACK = 128, 4.5
_EPS = 1e-9


def plan(n: int, dims: int) -> tuple[int, int, int]:
    """(hashes of a bucket, tables, probes) for n vectors. Recall at cosine 0.9 is above 0.97 for each of them (tests)."""
    for k in range(2, 9):
        tables, probes = 4 * (k - 1), 2 * k + 1
        if n * tables * probes**2 <= MEETS * float(2 * _width(dims)) ** k:
            break
    return k, tables, probes


def _width(dims: int) -> int:
    return 1 << max(0, dims - 1).bit_length()


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of each row, as Kronecker factors of 8, without its scale."""
    n, d = x.shape
    done = 1
    while done < d:
        f = min(8, d // done)
        h = np.array([[1.0]])
        while len(h) < f:
            h = np.block([[h, h], [h, -h]])
        # the last axis is multiplied and becomes the first, so that after all factors each axis is back in place
        x = (x.reshape(n, d // f, f) @ h).transpose(0, 2, 1).reshape(n, d)
        done *= f
    return x


def _signs(*which: int, width: int) -> np.ndarray:
    return np.random.default_rng([SEED, *which]).choice([-1.0, 1.0], size=(3, width))


def rotated(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    for s in signs:
        x = hadamard(x * s)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _axes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, lengths along them) of the three signed axes nearest to each row."""
    a, rows = np.abs(y), np.arange(len(y))
    codes, sizes = [], []
    for _ in range(min(3, y.shape[1])):
        at = a.argmax(1)
        codes.append(2 * at + (y[rows, at] < 0))
        sizes.append(a[rows, at])
        a[rows, at] = -1
    return np.stack(codes, 1), np.stack(sizes, 1)


def buckets(x: np.ndarray, k: int, tables: int, probes: int) -> np.ndarray:
    """64-bit names of the buckets of unit vectors: (vector, table, probe), the own bucket first."""
    n, width = len(x), _width(x.shape[1])
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    out = np.empty((n, tables, probes), np.uint64)
    for t in range(tables):
        codes, losses = [], []
        for j in range(k):
            c, size = _axes(rotated(x, _signs(t, j, width=width)))
            codes.append(c.astype(np.uint64))
            losses.append(size[:, :1] - size[:, 1:])
        place = [np.uint64(pow(2 * width + 1, j, 1 << 64)) for j in range(k)]
        own = sum((c[:, 0] * p for c, p in zip(codes, place, strict=True)), np.zeros(n, np.uint64))
        named = np.repeat(own[:, None], probes, 1)
        loss = np.concatenate(losses, 1)
        each = losses[0].shape[1]
        if each:
            step = np.concatenate([(c[:, 1:] - c[:, :1]) * p for c, p in zip(codes, place, strict=True)], 1)
            least = np.argsort(loss, axis=1, kind="stable")[:, : probes - 1]
            named[:, 1 : 1 + least.shape[1]] += np.take_along_axis(step, least, 1)
        out[:, t] = mix(named * np.uint64(64) + np.uint64(t) + np.uint64(x.shape[1] << 40))
    return out


def sketches(x: np.ndarray) -> np.ndarray:
    """SKETCH signs of random rotations of each vector, as two 64-bit numbers."""
    width = _width(x.shape[1])
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    turned = [rotated(x, _signs(99, i, width=width)) for i in range(-(-SKETCH // width))]
    return np.packbits(np.concatenate(turned, 1)[:, :SKETCH] > 0, axis=1).view(np.int64)


def units(column: pa.Array) -> np.ndarray:
    """Vectors of one size as unit rows of doubles."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _by_size(batches, column: str = "vector"):
    """Batches cut by the size of their vectors."""
    for b in batches:
        size = pc.list_value_length(b.column(column)).to_numpy(zero_copy_only=False)
        for s in np.unique(size).tolist():
            yield b if (size == s).all() else b.filter(pa.array(size == s))


def _flat(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), kind))


def hashed(classes: DataFrame, k: int, tables: int, probes: int) -> DataFrame:
    """classes (rid, n, least_id, vector) with unit vectors, cell, the own bucket of the first table, and keys, all buckets."""

    def run(batches):
        for b in _by_size(batches):
            x = units(b.column("vector"))
            keys = buckets(x, k, tables, probes).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("rid", "n", "least_id")), _flat(x, pa.float64()), pa.array(keys[:, 0, 0].copy()), _flat(keys.reshape(len(x), -1), pa.int64())], names=["rid", "n", "least_id", "vector", "cell", "keys"])

    return classes.mapInArrow(run, "rid long, n long, least_id long, vector array<double>, cell long, keys array<long>")


def _tight(cosine: float) -> float:
    """Cosine with the leader that makes any two members of a ball certain to have ``cosine``, with a margin for rounding."""
    return math.cos(math.acos(cosine) / 2 - 1e-3)


def gathered(x: np.ndarray, tight: float) -> tuple[np.ndarray, np.ndarray]:
    """(leader's row, cosine with it) of each row: the first row that is free leads all free ones near enough."""
    leader, cos = np.full(len(x), -1), np.ones(len(x))
    free = np.arange(len(x))
    while len(free):
        c = x[free] @ x[free[0]]
        c[0] = 1.0
        own = c >= tight
        leader[free[own]], cos[free[own]] = free[0], np.minimum(c[own], 1.0)
        free = free[~own]
    return leader, cos


def balls(points: DataFrame, tight: float, tmp: Scratch) -> DataFrame:
    """points with ball (the leader's rid), block (number within the ball), radius (largest angle to the leader), and leader's sketch."""
    n = partitions(points.sparkSession)
    large = points.groupBy("cell").count().where(F.col("count") > GATHER)
    large = large.select("cell", F.least(F.ceil(F.col("count") / GATHER), F.lit(4 * n)).alias("slices"))
    points = attached(points, large, ["cell"], ["rid"], "left").withColumn("slice", F.pmod(F.xxhash64("rid"), F.coalesce("slices", F.lit(1))).cast("long")).drop("slices")
    names = ["rid", "n", "least_id", "vector", "keys"]

    def one(t: pa.Table) -> pa.RecordBatch:
        """The rows of some whole groups of one bucket and slice each."""
        t = t.combine_chunks()
        cell, part = t["cell"].to_numpy(), t["slice"].to_numpy()
        head = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])]))
        size = np.diff(np.append(head, len(cell)))
        leader, cos = np.arange(len(cell)), np.ones(len(cell))
        for s, m in zip(head[size > 1].tolist(), size[size > 1].tolist(), strict=True):
            x = t["vector"].slice(s, m).combine_chunks().flatten().to_numpy().reshape(m, -1)
            own, cos[s : s + m] = gathered(x, tight)
            leader[s : s + m] = s + own
        order = np.argsort(leader, kind="stable")
        first = np.concatenate([[True], leader[order][1:] != leader[order][:-1]])
        start = np.flatnonzero(first)
        nth = np.arange(len(order)) - start[np.cumsum(first) - 1]
        widest = np.arccos(np.minimum.reduceat(cos[order], start))[np.cumsum(first) - 1]
        t = t.take(pa.array(order))
        lead = leader[order]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        lead = back[lead]  # the leader's row in the new order
        signs = np.empty((len(order), 2), np.int64)
        vectors = t["vector"].combine_chunks()
        long = pc.list_value_length(vectors).to_numpy()
        for s in np.unique(long).tolist():
            at = np.flatnonzero(long == s)
            signs[at] = sketches(vectors.take(pa.array(at)).flatten().to_numpy().reshape(len(at), -1))
        new = {"ball": t["rid"].take(pa.array(lead)), "block": pa.array((nth // BLOCK).astype(np.int32)), "radius": pa.array(widest), "s1": pa.array(signs[lead, 0]), "s2": pa.array(signs[lead, 1])}
        return pa.table([*(t[c] for c in names), *new.values()], names=[*names, *new])

    def run(batches):
        held, rows = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            if rows > GATHER:
                t = pa.Table.from_batches(held)
                cell, part = t["cell"].to_numpy(), t["slice"].to_numpy()
                cut = np.flatnonzero((cell[1:] != cell[:-1]) | (part[1:] != part[:-1])) + 1
                if len(cut):
                    yield from one(t.slice(0, int(cut[-1]))).to_batches(BLOCK)
                    held = t.slice(int(cut[-1])).to_batches()
                    rows = sum(x.num_rows for x in held)
        if rows:
            yield from one(pa.Table.from_batches(held)).to_batches(BLOCK)

    dealt = points.repartition(n, "cell", "slice").sortWithinPartitions("cell", "slice", "rid")
    return tmp.table(dealt.mapInArrow(run, "rid long, n long, least_id long, vector array<double>, keys array<long>, ball long, block int, radius double, s1 long, s2 long"), "members")


def _keys(members: DataFrame) -> DataFrame:
    """(key, ball, radius, s1, s2), a ball's equal buckets once a batch."""
    names = ["key", "ball", "radius", "s1", "s2"]

    def run(batches):
        for b in batches:
            if b.num_rows:
                keys = b.column("keys")
                row = np.repeat(np.arange(b.num_rows), pc.list_value_length(keys).to_numpy(zero_copy_only=False))
                flat, ball = keys.flatten().to_numpy(), b.column("ball").to_numpy()[row]
                order = np.lexsort((flat, ball))
                k, o = flat[order], ball[order]
                at = pa.array(row[order[np.concatenate([[True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])])]])
                k = k[np.concatenate([[True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])])]
                yield pa.RecordBatch.from_arrays([pa.array(k), *(b.column(c).take(at) for c in names[1:])], names=names)

    return members.select("ball", "radius", "s1", "s2", "keys").mapInArrow(run, "key long, ball long, radius double, s1 long, s2 long")


def _near_signs(cosine: float) -> Column:
    """Whether two leaders' sketches differ in no more signs than leaders of balls with a linked pair may."""
    share = F.least((math.acos(cosine) + F.col("a.radius") + F.col("b.radius")) / math.pi, F.lit(0.5))
    differ = F.bit_count(F.col("a.s1").bitwiseXOR(F.col("b.s1"))) + F.bit_count(F.col("a.s2").bitwiseXOR(F.col("b.s2")))
    return differ <= SKETCH * share + SLACK * F.sqrt(SKETCH * share * (1 - share))


def candidates(members: DataFrame) -> DataFrame:
    keys = _keys(members).repartition(partitions(members.sparkSession), "key").dropDuplicates(["key", "ball"])
    return keys


def verified(pairs: DataFrame, heads: DataFrame, cosine: float) -> DataFrame:
    """pairs (a, b) of balls that may be linked, with ``all``: every member of one with every member of the other."""
    most = math.acos(cosine)
    one = lambda c: heads.select(F.col("ball").alias(c), F.col("vector").alias(f"v{c}"), F.col("radius").alias(f"r{c}"))
    both = pairs.join(one("a"), "a").join(one("b"), "b").where(F.size("va") == F.size("vb"))

    def run(batches):
        for b in _by_size(batches, "va"):
            x, y = (b.column(c).flatten().to_numpy().reshape(b.num_rows, -1) for c in ("va", "vb"))
            ra, rb = b.column("ra").to_numpy(), b.column("rb").to_numpy()
            cos = (x * y).sum(1)
            angle, spread = np.arccos(np.clip(cos, -1, 1)), ra + rb
            every = np.where(spread == 0, cos >= cosine, angle + spread <= most - _EPS)
            some = every | (spread > 0) & (angle - spread <= most + _EPS)
            at = pa.array(np.flatnonzero(some))
            yield pa.RecordBatch.from_arrays([b.column("a").take(at), b.column("b").take(at), pa.array(every[some])], names=["a", "b", "all"])

    return both.mapInArrow(run, "a long, b long, all boolean")


def by_member(open_: DataFrame, members: DataFrame, sizes: DataFrame, cosine: float, tmp: Scratch) -> DataFrame:
    """For pairs of balls that don't decide as a whole: (rid, links, a, b), a row for each member of a block of one that is linked with
    members of a block of the other, and how many."""
    used = open_.select(F.explode(F.array("a", "b")).alias("ball")).distinct()
    member = F.struct("rid", "n", "vector")
    blocks = tmp.table(members.join(used, "ball").groupBy("ball", "block").agg(F.collect_list(member).alias("ms")), "blocks")  # BLOCK at most
    count = lambda c: sizes.select(F.col("ball").alias(c), F.col("blocks").alias(f"n{c}"))
    places = open_.join(count("a"), "a").join(count("b"), "b")
    places = places.select("a", "b", F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("ka"), "nb").select("a", "b", "ka", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("kb"))
    side = lambda c: blocks.select(F.col("ball").alias(c), F.col("block").alias(f"k{c}"), F.col("ms").alias(f"m{c}"))
    both = places.join(side("a"), ["a", "ka"]).join(side("b"), ["b", "kb"]).select("a", "b", "ma", "mb")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                m = [batch.column(c)[i].values for c in ("ma", "mb")]
                x, y = (s.field("vector").flatten().to_numpy().reshape(len(s), -1) for s in m)
                hit = x @ y.T >= cosine
                for own, other, h in ((m[0], m[1], hit), (m[1], m[0], hit.T)):
                    links = h @ other.field("n").to_numpy()
                    at = np.flatnonzero(links)
                    ends = [pa.array(np.full(len(at), batch.column(c)[i].as_py())) for c in ("a", "b")]
                    yield pa.RecordBatch.from_arrays([own.field("rid").take(pa.array(at)), pa.array(links[at]), *ends], names=["rid", "links", "a", "b"])

    return tmp.table(both.mapInArrow(run, "rid long, links long, a long, b long"), "found-links")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", column: str = "embedding", shape: tuple[int, int, int] | None = None) -> DataFrame:
    """One row per input row: vec_id, n_links (other rows linked with it), component_id (smallest id reachable by links), kept.

    Rows link when the cosine of their vectors, in doubles, is ``cosine`` or more; scale doesn't matter. Vectors that are null, empty
    or zero, or hold a null or a component that is not finite, link with nothing and are their own component; vectors of different
    sizes don't link. Equal vectors always link, so rows repeated with their id are links of each other. Ids are integers; a null
    id is never the smallest. All vectors are hashed and all candidates verified, so no pair below ``cosine`` is linked; pairs above
    it are found if they meet in a bucket (``plan``; tests measure the recall). ``shape``: hashes, tables and probes in place of the
    plan's. Other columns aren't read; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    tmp, out = Scratch(spark), Scratch(spark)
    v = F.col(column).cast("array<double>")
    good = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(good, v).alias("vector"))
    rows = rows.withColumns({"k1": F.xxhash64("vector"), "k2": F.xxhash64(F.reverse("vector"), F.lit(2)), "valid": F.col("vector").isNotNull()})
    ids = out.table(rows.drop("vector"), "rows")
    same = ["k1", "k2"]
    classes = rows.where("valid").groupBy(*same).agg(F.first("vector").alias("vector"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least_id"))
    classes = tmp.table(classes.withColumn("rid", F.monotonically_increasing_id()), "classes")  # written, so the numbers stay
    n, dims = classes.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    k, tables, probes = shape or plan(n, dims or 1)
    points = tmp.table(hashed(classes.select("rid", "n", "least_id", "vector"), k, tables, probes), "points")
    members = balls(points, _tight(cosine), tmp)
    sizes = tmp.table(members.groupBy("ball").agg(F.sum("n").alias("total"), F.min("least_id").alias("least_id"), (F.max("block") + 1).alias("blocks")), "sizes")

    keys = candidates(members)
    pairs = keys.alias("a").join(keys.alias("b"), "key").where((F.col("a.ball") < F.col("b.ball")) & _near_signs(cosine)).select(F.col("a.ball").alias("a"), F.col("b.ball").alias("b")).distinct()
    pairs = tmp.table(pairs, "pairs")
    heads = members.where("rid = ball").select("ball", "vector", "radius")
    linked = tmp.table(verified(pairs, heads, cosine), "verified")
    more = by_member(linked.where("NOT all").select("a", "b"), members, sizes, cosine, tmp)
    edges = linked.where("all").select("a", "b").unionByName(more.select("a", "b").distinct())
    roots = components(edges, tmp, "vectors")

    both = linked.where("all").select("a", "b").unionByName(linked.where("all").select(F.col("b").alias("a"), F.col("a").alias("b")))
    beside = both.join(sizes.select(F.col("ball").alias("b"), "total"), "b").groupBy(F.col("a").alias("ball")).agg(F.sum("total").alias("beside"))
    of_ball = sizes.join(roots.withColumnRenamed("node", "ball"), "ball", "left").withColumn("root", F.coalesce("root", "ball"))
    least = of_ball.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_ball = of_ball.join(least, "root").join(beside, "ball", "left").select("ball", "component_id", (F.col("total") - 1 + F.coalesce("beside", F.lit(0))).alias("links"))
    own = more.groupBy("rid").agg(F.sum("links").alias("own"))
    member = attached(tmp.table(members.select("rid", "ball"), "of"), of_ball, ["ball"], ["rid"]).join(own, "rid", "left")
    result = member.join(classes.select("rid", *same), "rid").select(*same, "component_id", (F.col("links") + F.coalesce("own", F.lit(0))).alias("n_links"), F.lit(True).alias("valid"))
    result = out.table(result, "classes")
    tmp.drop()
    found = attached(ids, result, [*same, "valid"], ["vec_id"], "left")
    found = found.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.when(F.col("valid"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op12_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP12_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, row_number() OVER () AS r, CASE WHEN list_aggregate(list_transform(embedding, lambda x: (x IS NOT NULL AND isfinite(x))::INT), 'min') = 1 AND list_aggregate(list_transform(embedding, lambda x: abs(x)), 'max') > 0
    THEN embedding::DOUBLE[] END AS e FROM embeddings),
l AS MATERIALIZED (SELECT a.r AS a, b.r AS b, b.vec_id AS b_id FROM v AS a, v AS b WHERE a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
c AS (SELECT r, vec_id AS root FROM v UNION SELECT l.b, c.root FROM c JOIN l ON l.a = c.r),
m AS (SELECT r, min(root) AS component_id FROM c GROUP BY r), n AS (SELECT a AS r, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN m USING (r) LEFT JOIN n USING (r)
"""
