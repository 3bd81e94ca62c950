"""The trie of conversations by their turns, as succinct level-order (LOUDS) tries, one for each shard of prefixes.

Sequences of turns are named by polynomial hashes of 2 x 64 bits, which compose: the hash of a prefix follows from hashes of its
parts. So the positions and hashes of one conversation, however long, come from a scan over range partitions, where only one entry
a partition is carried from task to task, and a conversation that takes over another's first turns needs no second pass.

Nodes are the distinct prefix hashes. Below a node with one member there is a single path with nothing to roll up, so only its
first node enters a trie. Nodes with more than 1/UPPER of all (conversation, prefix) rows are the heavy upper levels: UPPER at
most, however large the input. A shard is a subtree right below them. In a shard numpy brings the nodes into level order, builds
the LOUDS bit vector and the array of labels, reads parents off the bits, and rolls up level by level from the last one with
`np.add.at`. The shards' totals enter the upper levels, which are one more trie.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, attached, partitions, small_batches
from .words import mix, powers

UPPER, LEAST = 1 << 16, 64
SHARED, MODULUS = 5, 9  # of the contract: whose first turns are taken over, and how many
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so they have inverses
_WRAP = 1 << 64
#: Nodes that are brought into one forest of tries, but for a larger shard, and bytes of a piece of a list of ids.
FOREST, PIECE = 50_000, 1 << 20
EMPTY = hashlib.sha256(b"").hexdigest()
LAST = ["i", "p1", "p2"]


def _u(x) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


# positions and prefix hashes
def _local(batches):
    """Adds to rows (conv_id, h1, h2, ...) in order: i, the place in the conversation counted from the partition's start, p1, p2, the
    hash up to the row, and q1, q2, that before it."""
    conv, count, sums = None, 0, [0, 0]
    for b in batches:
        if not b.num_rows:
            continue
        c = b.column("conv_id").to_numpy()
        head = np.concatenate([[True], c[1:] != c[:-1]])
        start = np.flatnonzero(head)[np.cumsum(head) - 1]
        goes_on = np.full(len(c), conv is not None) & (start == 0) & (c == conv)
        i = np.arange(len(c)) - start + 1
        new = {}
        for k, base in enumerate(BASES):
            each = _u(b.column(f"h{k + 1}")) * powers(base, len(c) + 1)[i]
            run = np.cumsum(each, dtype=np.uint64)
            run = run - (run[start] - each[start])
            run[goes_on] = run[goes_on] * np.uint64(pow(base, count, _WRAP)) + np.uint64(sums[k])
            before = np.concatenate([np.zeros(1, np.uint64), run[:-1]])
            before[head] = 0
            if goes_on[0]:
                before[0] = sums[k]
            new |= {f"p{k + 1}": _signed(run), f"q{k + 1}": _signed(before)}
            sums[k] = int(run[-1])
        i = i + np.where(goes_on, count, 0)
        conv, count = c[-1], int(i[-1])
        new = {"i": pa.array(i)} | new
        yield pa.RecordBatch.from_arrays([*b.columns, *new.values()], names=[*b.schema.names, *new])


def _carried(rows: DataFrame) -> dict[int, tuple]:
    """What the conversation that a partition begins with has in the partitions before: part -> (conv_id, turns, hashes). A row a
    partition comes to the driver."""
    ends = {r["part"]: r for r in rows.groupBy("part").agg(F.min("conv_id").alias("lo"), F.max("conv_id").alias("hi")).collect()}
    order = sorted(ends)
    spread = sorted({ends[b]["lo"] for a, b in zip(order, order[1:], strict=False) if ends[a]["hi"] == ends[b]["lo"]})
    if not spread:
        return {}
    last = rows.where(F.col("conv_id").isin(spread)).groupBy("conv_id", "part").agg(F.max(F.struct(*LAST)).alias("x")).collect()
    out, now = {}, {}
    for r in sorted(last, key=lambda r: (r["conv_id"], r["part"])):
        c, (n, *own) = r["conv_id"], r["x"]
        turns, sums = now.get(c, (0, (0, 0)))
        if turns:
            out[r["part"]] = (c, turns, sums)
        now[c] = (turns + n, tuple((s + x * pow(base, turns, _WRAP)) % _WRAP for s, x, base in zip(sums, own, BASES, strict=True)))
    return out


def turns_of(conversations: DataFrame, tmp: Scratch) -> DataFrame:
    """conv_id, i (from 1), p1, p2, q1, q2, label, n_bytes of every turn, in the order of turn (null first), role, hash of the text."""
    spark = conversations.sparkSession
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(1), text, role).alias("h2"), F.octet_length(text).cast("long").alias("n_bytes"))
    order = ["conv_id", "turn", "role", "h1"]
    rows = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    rows = rows.select("conv_id", "h1", "h2", "n_bytes", F.spark_partition_id().alias("part"))
    kinds = "conv_id long, h1 long, h2 long, n_bytes long, part int, i long, p1 long, q1 long, p2 long, q2 long"
    rows = tmp.table(rows.mapInArrow(_local, kinds), "turns")
    carried = _carried(rows)

    def shift(batches):
        for b in batches:
            part, conv, i = (b.column(c).to_numpy().copy() for c in ("part", "conv_id", "i"))
            new = {c: _u(b.column(c)).copy() for c in ("p1", "p2", "q1", "q2")}
            for k in np.unique(part).tolist():
                if k in carried:
                    c, turns, sums = carried[k]
                    own = (part == k) & (conv == c)
                    i[own] += turns
                    for name, x in new.items():
                        j = int(name[1]) - 1
                        x[own] = x[own] * np.uint64(pow(BASES[j], turns, _WRAP)) + np.uint64(sums[j])
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(i), *(_signed(x) for x in new.values()), b.column("h1"), b.column("n_bytes")], names=["conv_id", "i", *new, "label", "n_bytes"])

    return rows.mapInArrow(shift, "conv_id long, i long, p1 long, p2 long, q1 long, q2 long, label long, n_bytes long")


def rebuilt(turns: DataFrame, tmp: Scratch) -> tuple[DataFrame, DataFrame]:
    """(conv_id, len of every conversation, its (conversation, prefix) rows: conv_id, d, len, p1, p2 and q1, q2, which name the prefix
    and its parent, label, n_bytes), after each has taken over the first turns of another."""
    first = F.sort_array(F.collect_list(F.when(F.col("i") < MODULUS, F.struct("i", "p1", "p2", "q1", "q2", "label", "n_bytes"))))  # 8 at most
    heads = tmp.table(turns.groupBy("conv_id").agg(F.max("i").alias("n"), first.alias("first")), "heads")
    conv = F.col("conv_id")
    own = heads.withColumns({"from": conv - conv % SHARED, "h": (F.crc32(conv.cast("string").cast("binary")) % MODULUS).cast("int")})
    other = heads.select(F.col("conv_id").alias("from"), F.col("first").alias("taken"), F.col("n").alias("n_taken"))
    both = own.join(other, "from", "left")
    m = F.least("h", F.coalesce("n_taken", F.lit(0))).cast("int")
    both = both.withColumns({"m": m, "len": m + F.greatest(F.col("n") - F.col("h"), F.lit(0))})
    at = lambda rows, k, c: F.when(F.col(k) > 0, F.col(rows)[F.col(k) - 1][c]).otherwise(F.lit(0).cast("long"))
    both = both.withColumn("own", F.least("h", "n").cast("int"))
    both = tmp.table(both.withColumns({f"{x}{k}": at(rows, n, f"p{k}") for x, rows, n in (("a", "first", "own"), ("m", "taken", "m")) for k in (1, 2)}).drop("first", "n", "n_taken", "from", "own"), "conversations")
    sums = ["p1", "p2", "q1", "q2"]
    zero = [F.lit(0).cast("long").alias(c) for c in ("a1", "a2", "m1", "m2")]
    taken = both.where("m > 0").select("conv_id", "len", F.inline(F.slice("taken", 1, F.col("m")))).select("conv_id", F.col("i").alias("d"), "len", *sums, *zero, F.lit(0).alias("back"), "label", "n_bytes")
    bases = both.where("len > m").select("conv_id", "len", "h", "m", "a1", "a2", "m1", "m2")
    tails = attached(tmp.table(turns, "places"), bases, ["conv_id"], ["i"]).where("i > h")
    tails = tails.select("conv_id", (F.col("i") - F.col("h") + F.col("m")).alias("d"), "len", *sums, "a1", "a2", "m1", "m2", (F.col("h") - F.col("m")).alias("back"), "label", "n_bytes")

    def named(batches):
        for b in batches:
            back, d = b.column("back").to_numpy(), b.column("d").to_numpy()
            new = {}
            for c in sums:
                base = BASES[int(c[1]) - 1]
                to = powers(pow(base, -1, _WRAP), MODULUS)[back]
                x = (_u(b.column(c)) - _u(b.column(f"a{c[1]}"))) * to + _u(b.column(f"m{c[1]}"))
                new[c] = _signed(mix(x + (d - (c[0] == "q")).astype(np.uint64) * np.uint64(BASES[1])))  # the root is (0, 0)
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("d"), b.column("len"), *new.values(), b.column("label"), b.column("n_bytes")], names=["conv_id", "d", "len", *new, "label", "n_bytes"])

    rows = taken.unionByName(tails).mapInArrow(named, "conv_id long, d long, len long, p1 long, p2 long, q1 long, q2 long, label long, n_bytes long")
    return both.select("conv_id", "len"), rows


# tries
class Louds:
    """A tree in level order as bits: for each node as many ones as it has children, then a zero. Node 0 is the root."""

    def __init__(self, degrees: np.ndarray):
        ends = np.cumsum(degrees + 1)
        bits = np.ones(int(ends[-1]), np.uint8)
        bits[ends - 1] = 0
        self.size, self.bits = len(bits), np.packbits(bits)

    def parents(self) -> np.ndarray:
        """The parent of nodes 1, 2, ...: the zeros before each one."""
        ones = np.flatnonzero(np.unpackbits(self.bits, count=self.size))
        return ones - np.arange(len(ones))

    def levels(self) -> list[tuple[int, int]]:
        """(first node, end) of each level."""
        parents = np.concatenate([[-1], self.parents()])
        out, lo, hi = [], 0, 1
        while lo < hi:
            out.append((lo, hi))
            lo, hi = hi, int(np.searchsorted(parents, hi))
        return out


def _ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal numbers for equal pairs."""
    order = np.lexsort((b, a))
    new = np.concatenate([[False], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])
    out = np.empty(len(a), np.int64)
    out[order] = np.cumsum(new)
    return out


def level_order(node: np.ndarray, parent: np.ndarray, depth: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, Louds, np.ndarray]:
    """(order, bits, labels) of a forest below one added root: rows in level order, children by label. A row whose parent isn't
    among the rows is a child of the added root."""
    n = len(node)
    row = np.full(int(max(node.max(), parent.max())) + 1, -1, np.int64)
    row[node] = np.arange(n)
    above = row[parent]
    level = np.zeros(n, np.int64)
    by_depth = np.argsort(depth, kind="stable")
    for at in np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1):
        inner = at[above[at] >= 0]
        level[inner] = level[above[inner]] + 1
    by_level = np.argsort(level, kind="stable")
    place, order, done = np.zeros(n, np.int64), [], 1
    for at in np.split(by_level, np.flatnonzero(np.diff(level[by_level])) + 1):
        up = np.where(above[at] >= 0, place[above[at]], 0)
        at = at[np.lexsort((node[at], label[at], up))]
        place[at] = done + np.arange(len(at))
        done += len(at)
        order.append(at)
    order = np.concatenate(order)
    degrees = np.bincount(np.where(above >= 0, place[above], 0), minlength=n + 1)
    return order, Louds(degrees), label[order]


IN = ["conv_id", "d", "len", "p1", "p2", "q1", "q2", "label", "n", "n_bytes", "more_children", "more_leaves", "more_saved"]
OUT = ["conv_id", "d", "p1", "p2", "q1", "q2", "n", "parent_conv", "n_children", "n_leaves", "saved", "top"]
OUT_DDL = ", ".join(f"{c} {'boolean' if c == 'top' else 'long'}" for c in OUT)


def rolled_up(t: pa.Table) -> pa.RecordBatch:
    """The nodes of some shards (columns IN) with their children, leaves and saved sums; ``top`` marks those without a parent here."""
    x = {c: t[c].to_numpy() for c in IN}
    n = t.num_rows
    ids = _ranks(np.concatenate([x["p1"], x["q1"]]), np.concatenate([x["p2"], x["q2"]]))
    order, trie, _ = level_order(ids[:n], ids[n:], x["d"], x["label"])
    x = {c: v[order] for c, v in x.items()}
    parents = trie.parents()
    children = np.concatenate([[0], x["more_children"]])
    np.add.at(children, parents, 1)
    saved = np.concatenate([[0], (x["n"] - 1) * x["n_bytes"] + x["more_saved"]])
    leaves = np.concatenate([[0], x["more_leaves"]]) + (children == 0)
    for lo, hi in reversed(trie.levels()[1:]):
        for total in (saved, leaves):
            np.add.at(total, parents[lo - 1 : hi - 1], total[lo:hi])
    # below a node with one member the path goes on outside the trie
    children = np.where(x["n"] == 1, x["d"] < x["len"], children[1:])
    top = parents == 0
    above = pa.array(x["conv_id"][np.maximum(parents - 1, 0)], mask=top)
    found = {"parent_conv": above, "n_children": children.astype(np.int64), "n_leaves": leaves[1:], "saved": saved[1:], "top": top}
    return pa.RecordBatch.from_arrays([pa.array(x[c]) if c in x else found[c] if c == "parent_conv" else pa.array(found[c]) for c in OUT], names=OUT)


def _forests(batches):
    """Rows sorted by shard, cut between shards into forests of some FOREST nodes."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        if rows + b.num_rows > FOREST:
            t = pa.Table.from_batches([*held, b])
            s1, s2 = t["s1"].to_numpy(), t["s2"].to_numpy()
            heads = np.flatnonzero((s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])) + 1
            if len(heads):
                yield rolled_up(t.slice(0, int(heads[-1])))
                held, rows = t.slice(int(heads[-1])).to_batches(), t.num_rows - int(heads[-1])
                continue
        held.append(b)
        rows += b.num_rows
    if rows:
        yield rolled_up(pa.Table.from_batches(held))


def ends_of(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ids (p1, p2, conv_id) that end at each node, in order and joined by commas. Pieces of the list are written by
    many tasks; a node's pieces then run through one hash, which holds no more than a batch of them."""
    spark = ends.sparkSession
    names = ["p1", "p2", "conv_id"]

    def pieces(batches):
        for b in batches:
            if b.num_rows:
                p1, p2 = b.column("p1").to_numpy(), b.column("p2").to_numpy()
                cut = np.flatnonzero(np.concatenate([[True], (p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1])]))
                at = np.unique(np.concatenate([cut, np.arange(0, b.num_rows, PIECE // 20)]))
                ids = b.column("conv_id").to_pylist()
                lists = [",".join(map(str, ids[i:j])) for i, j in zip(at, [*at[1:], b.num_rows], strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(at)) for c in names), pa.array(lists, pa.string())], names=[*names, "ids"])

    def whole(batches):
        key, h = None, None
        for b in batches:
            out = []
            for p1, p2, ids in zip(*(b.column(c).to_pylist() for c in ("p1", "p2", "ids")), strict=True):
                if (p1, p2) != key:
                    if key:
                        out.append((*key, h.hexdigest()))
                    key, h = (p1, p2), hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out]) for k in range(3)], names=["p1", "p2", "sha"])
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([h.hexdigest()])], names=["p1", "p2", "sha"])

    n = partitions(spark)
    written = ends.repartitionByRange(n, *names).sortWithinPartitions(*names).mapInArrow(pieces, "p1 long, p2 long, conv_id long, ids string")
    return written.repartition(n, "p1", "p2").sortWithinPartitions(*names).mapInArrow(whole, "p1 long, p2 long, sha string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    ``conversations`` has conv_id, turn, role and text; other columns aren't read. Turns come in the order of turn, null first; rows
    of one turn in the order of role, then of a hash of the text, and repeated rows are turns of their own. Null role or text is
    empty. Rows of a null conv_id belong to no conversation and are left out. Conversation c takes over the first crc32(c) % 9 turns
    of conversation c - c % 5 as it was before, or none if that isn't there; it may end up without a turn, and is then a member of
    the root only. Texts are hashed where they lie, however long. An empty table has no members and gives no rows.
    """
    spark = conversations.sparkSession
    small_batches(spark)
    tmp, out = Scratch(spark), Scratch(spark)
    convs, rows = rebuilt(turns_of(conversations, tmp), tmp)
    rows = tmp.table(rows, "prefixes")
    same = ["p1", "p2"]
    nodes = rows.groupBy(*same).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"), *(F.min(c).alias(c) for c in ("d", "len", "q1", "q2", "label", "n_bytes")))
    nodes = tmp.table(nodes, "nodes")
    most = max(LEAST, -(-(nodes.agg(F.sum("n")).first()[0] or 0) // UPPER))
    heavy = tmp.table(nodes.where(F.col("n") > most), "heavy")  # UPPER nodes at most: their members add up to no more than all rows
    known = F.broadcast(heavy.select(*same, F.lit(True).alias("heavy")))
    shard = rows.join(known, same, "left").where("heavy IS NULL").groupBy("conv_id").agg(F.min(F.struct("d", *same)).alias("x"))
    shard = shard.select("conv_id", F.col("x.p1").alias("s1"), F.col("x.p2").alias("s2"))

    # below a node with one member: its first node is in a trie, the others' figures are known
    single = nodes.where("n = 1").drop("label")
    first = single.groupBy("conv_id").agg(F.min("d").alias("head"))
    single = attached(single, first, ["conv_id"], ["d"])
    rest = single.where("d > head").select("conv_id", "d", *same, "n", F.col("conv_id").alias("parent_conv"), (F.col("d") < F.col("len")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved"), "len")
    none = {c: F.lit(0).cast("long") for c in ("more_children", "more_leaves", "more_saved")}
    light = nodes.where((F.col("n") > 1) & (F.col("n") <= most)).unionByName(single.where("d = head").drop("head").withColumn("label", F.lit(0).cast("long")))
    light = light.withColumns(none).join(shard, "conv_id").select(*IN, "s1", "s2")
    tries = light.repartition(partitions(spark), "s1", "s2").sortWithinPartitions("s1", "s2").mapInArrow(_forests, OUT_DDL)
    tries = tmp.table(tries.join(light.where("n = 1").select("conv_id", "d", "len"), ["conv_id", "d"], "left"), "tries")

    below = tries.where("top").groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count(F.lit(1)).alias("more_children"), F.sum("n_leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id")).where("n > 0")
    root = root.withColumns({c: zero for c in ("d", "len", *same, "label", "n_bytes")} | {c: F.lit(-1).cast("long") for c in ("q1", "q2")})
    upper = heavy.unionByName(root.select(*heavy.columns)).join(below, same, "left").na.fill(0, [*none]).select(*IN)
    upper = tmp.table(upper.coalesce(1).mapInArrow(lambda batches: (rolled_up(t) for t in [pa.Table.from_batches([b for b in batches if b.num_rows] or [pa.RecordBatch.from_pylist([], UPPER_SCHEMA)])] if t.num_rows), OUT_DDL), "upper")
    names = F.broadcast(upper.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("up")))  # UPPER and the root
    tries = tries.join(names, ["q1", "q2"], "left").withColumn("parent_conv", F.coalesce("parent_conv", "up"))

    shown = ["conv_id", "d", *same, "n", "parent_conv", "n_children", "n_leaves", "saved", "len"]
    every = tries.select(*shown).unionByName(upper.withColumn("len", F.lit(None).cast("long")).select(*shown))
    alone = every.where("n = 1 AND d > 0").unionByName(rest).withColumn("sha", F.when(F.col("d") == F.col("len"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)))
    ends = rows.where("d = len").select(*same, "conv_id").unionByName(convs.where("len = 0").select(zero.alias("p1"), zero.alias("p2"), "conv_id"))
    shared = every.where("n > 1 OR d = 0").join(ends_of(ends), same, "left")
    found = shared.unionByName(alone).select("conv_id", F.col("d").alias("depth"), F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("sha", F.lit(EMPTY)).alias("ends_sha256"))
    found = out.table(found, "trie")
    tmp.drop()
    return found


UPPER_SCHEMA = pa.schema([(c, pa.int64()) for c in IN])


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP11_SQL = """
WITH b AS (SELECT conv_id AS c, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, role, text) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
h AS (SELECT c, ts, (list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(c::VARCHAR) + 1), lambda i: unicode(substr(c::VARCHAR, i::INT, 1))::BIGINT)),
    lambda x, y: list_reduce(list_prepend(xor(x, y), range(0, 8)), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END))) AS crc FROM b),
r AS (SELECT h.c, list_concat(coalesce(o.ts[1 : (xor(crc, 4294967295::BIGINT) % 9)::INT], []), h.ts[(xor(crc, 4294967295::BIGINT) % 9)::INT + 1 :]) AS ts FROM h LEFT JOIN b AS o ON o.c = h.c - h.c % 5),
p AS (SELECT c, d, len(ts) AS n, sha256(ts[1 : d::INT]::VARCHAR || d::VARCHAR || list_sum(list_transform(ts[1 : d::INT], lambda t: length(t.text)))::VARCHAR) AS k, CASE WHEN d = 0 THEN 0 ELSE octet_length(encode(ts[d::INT].text)) END AS bytes FROM (SELECT c, ts, unnest(range(0, len(ts) + 1)) AS d FROM r)),
n AS (SELECT coalesce(k, 'root') AS k, min(d) AS d, min(c) AS c, count(*) AS n_convs, (count(*) - 1) * min(bytes) AS saved, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = n) AS ends FROM p GROUP BY 1),
u AS (SELECT n.k, n.d, n.saved, coalesce(a.k, 'root') AS up, a.d AS up_d FROM n JOIN p AS a ON a.c = n.c AND a.d <= n.d),
ch AS (SELECT up AS k, count(*) AS n_children FROM u WHERE up_d = d - 1 GROUP BY 1),
s AS (SELECT up AS k, sum(u.saved)::BIGINT AS saved_tokens, count(*) FILTER (ch.k IS NULL) AS n_leaves FROM u LEFT JOIN ch ON ch.k = u.k GROUP BY 1)
SELECT n.c AS conv_id, n.d AS depth, up.c AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM n JOIN s USING (k) LEFT JOIN ch USING (k) LEFT JOIN u AS one ON one.k = n.k AND one.up_d = n.d - 1 LEFT JOIN n AS up ON up.k = one.up
"""
