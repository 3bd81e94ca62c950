"""Substring deduplication on a compacted de Bruijn graph of word k-mers.

Edges are k-mers of ``window`` words. An edge is filed under its anchor, the smallest of the shorter k-mers inside it, so equal
edges have equal anchors, and neighbouring edges with one anchor form a path. A row stands for a path: (anchor, hash of the
path's words, edges, document, position). Joins then compact and compare paths:

1. anchors that lie in one document only are dropped with their paths;
2. equal paths are one node of the graph, which knows its first occurrence and, over all occurrences, the nodes before and after
   it. A join links a node to the one that always follows it and is always preceded by it; runs of linked nodes, which don't
   branch, compact into one span, and a second join gives one row for each occurrence of a span, however long it is;
3. where an anchor has several nodes, where the graph branches, each node's first occurrence is opened into single edges, the graph
   of these edges is compacted in the same way, and what it cuts is cut at the node's other places in documents of that rank too;
4. source coordinates verify the spans: the words of a span must equal those at its first occurrence (by SHA-256, or word by word
   for the opened paths) before they are cut out of the text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, blocks, documents, schema_of, small_batches
from .words import Spans, hashed, mix, sliding_min

WINDOW, ANCHOR = 50, 16
_LOW = np.uint64((1 << 28) - 1)
ROW, NODE = ["rank", "rid"], ["anchor", "span", "edges"]
PLACE = [*ROW, "base", "start"]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def paths(words: list[list[bytes]], window: int, k: int):
    """(which text, start, edges, anchor, span) of every path, as arrays, of texts given as words."""
    lens = np.array([len(w) for w in words], np.int64)
    long = np.flatnonzero(lens >= window)
    if not len(long):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    lens = lens[long]
    h = np.concatenate([hashed(words[i]) for i in long])
    starts = np.concatenate([[0], np.cumsum(lens)])
    spans = Spans(h)
    mers = spans.windows(k)
    least = sliding_min((mix(mers) & ~_LOW) | np.arange(len(mers), dtype=np.uint64), window - k + 1)
    anchor = mers[(least & _LOW).astype(np.int64)]
    text = np.repeat(np.arange(len(lens)), lens)[: len(anchor)]
    edge = np.arange(len(anchor))
    inside = edge + window <= starts[text + 1]
    edge, anchor, text = edge[inside], anchor[inside], text[inside]
    # by the anchor's value, not its place: a passage that repeats itself word for word is one path, too
    head = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    count = np.diff(np.concatenate([head, [len(edge)]]))
    start, anchor, text = edge[head], anchor[head], text[head]
    return long[text], start - starts[text], count, anchor, spans(start, start + count - 1 + window)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def path_table(docs: DataFrame, window: int, k: int) -> DataFrame:
    def run(batches):
        for b in blocks(batches):
            text, start, edges, anchor, span = paths([_words(t) for t in b.column("text").to_pylist()], window, k)
            pick = pa.array(text)
            cols = [_signed(anchor), _signed(span), pa.array(edges.astype(np.int32)), *(b.column(c).take(pick) for c in ROW), pa.array(start.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=[*NODE, *ROW, "start"])

    return docs.mapInArrow(run, "anchor long, span long, edges int, rank long, rid long, start int")


def nodes_of(units: DataFrame) -> DataFrame:
    """The distinct nodes among ``units`` (anchor, span, edges, rank, rid, base, start): first occurrence, largest rank, and the
    nodes before and after it: 0 for none, null if they differ."""
    one = lambda c: F.when(F.min(c) == F.max(c), F.min(c))
    at = Window.partitionBy(*ROW, "base").orderBy("start")  # neighbours in one text, or in one opened path
    before = F.when(F.lag("start").over(at) + F.lag("edges").over(at) == F.col("start"), F.lag("span").over(at))
    after = F.when(F.lead("start").over(at) == F.col("start") + F.col("edges"), F.lead("span").over(at))
    units = units.withColumns({"before": F.coalesce(before, F.lit(0)), "after": F.coalesce(after, F.lit(0))})
    return units.groupBy(*NODE).agg(F.min(F.struct(*PLACE)).alias("first"), F.max("rank").alias("last"), one("before").alias("before"), one("after").alias("after"))


def compacted(nodes: DataFrame) -> DataFrame:
    """Spans of more than one document: the key of each span's first node, its edges in all as ``long`` and its first occurrence.

    A node is linked to the one before it if that one always comes before it and it always comes after that one. The nodes of a
    span have the same occurrences, so they stand side by side in the document of the first one: a running count of the nodes
    that aren't linked numbers the spans of a document.
    """
    nodes = nodes.where(F.col("first.rank") < F.col("last")).select(*NODE, "before", "after", *(F.col(f"first.{c}") for c in PLACE))
    ends = nodes.select(*ROW, "base", (F.col("start") + F.col("edges")).alias("start"), F.col("span").alias("before"), F.col("after").alias("span"))
    joined = nodes.join(ends.withColumn("linked", F.lit(1)), [*ROW, "base", "start", "before", "span"], "left")
    number = F.sum(F.when(F.col("linked").isNull(), 1).otherwise(0)).over(Window.partitionBy(*ROW, "base").orderBy("start"))
    runs = joined.withColumn("number", number).groupBy(*ROW, "base", "number")
    return runs.agg(F.min(F.struct("start", *NODE)).alias("head"), F.sum("edges").cast("int").alias("long")).select(*(F.col(f"head.{c}") for c in NODE), "long", F.struct(*ROW, "base", "head.start").alias("first"))


def later(units: DataFrame, spans: DataFrame) -> DataFrame:
    """One row for each occurrence of a span in a document of larger rank than the first one's."""
    return units.select(*NODE, *PLACE).join(spans, NODE).where(F.col("rank") > F.col("first.rank")).drop(*NODE)


def repeats(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """rank, rid and cuts (array of (start, edges, digest)) of the rows of ``docs`` (rid, rank, text) with windows that start in a
    row of smaller rank. A cut with a digest is still to be compared with the text."""
    tmp = Scratch(docs.sparkSession)
    occ = tmp.table(path_table(docs, window, k), "paths")
    anchors = occ.groupBy("anchor").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.min("span").alias("a"), F.max("span").alias("b")).where("lo < hi")
    anchors = tmp.table(anchors.select("anchor", (F.col("a") != F.col("b")).alias("branches")), "anchors")
    shared = tmp.table(occ.join(anchors, "anchor").withColumn("base", F.lit(0)), "shared")
    tmp.drop("paths")
    nodes = tmp.table(nodes_of(shared), "nodes")
    spans = tmp.table(compacted(nodes), "spans")
    opened = nodes.join(anchors.where("branches").select("anchor"), "anchor").select(*NODE, "first", F.lit(True).alias("open"))
    whole = spans.select(*NODE[:2], F.col("long").alias("edges"), "first", F.lit(False).alias("open"))
    read = tmp.table(_read(docs, opened.unionByName(whole), window), "read")
    digests = read.where("NOT open").select(F.col("anchor"), F.col("span"), F.col("edges").alias("long"), "digest")
    found = later(shared, spans.join(digests, ["anchor", "span", "long"])).select(*ROW, "start", F.col("long").alias("edges"), "digest")

    inner = read.where("open").select("anchor", F.posexplode("hashes").alias("at", "span"), F.lit(1).alias("edges"), *ROW, F.col("start").alias("base"))
    inner = inner.withColumn("start", F.col("base") + F.col("at")).drop("at")
    often = inner.groupBy("anchor", "span").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi")).where("lo < hi").select("anchor", "span")
    inner = tmp.table(inner.join(often, ["anchor", "span"], "left_semi"), "edges")
    same = later(inner, tmp.table(compacted(nodes_of(inner)), "edge-spans"))
    texts = read.where("open").select(*ROW, F.col("start").alias("base"), F.split(F.col("words"), " ").alias("words"), F.struct(*NODE).alias("node"))
    part = lambda words, place: F.slice(F.col(words), F.col(f"{place}start") - F.col(f"{place}base") + 1, F.col("long") - 1 + window)
    there = texts.select(F.struct(*ROW, "base").alias("there"), F.col("words").alias("first_words"))
    same = same.withColumn("there", F.struct("first.rank", "first.rid", "first.base")).join(there, "there").join(texts, [*ROW, "base"])
    same = same.where(part("words", "") == part("first_words", "first.")).select(*ROW, "base", "start", F.col("long").alias("edges"), "node", F.unhex(F.sha2(F.array_join(part("words", ""), " "), 256)).alias("digest"))
    same = tmp.table(same, "same")
    # a node that stands several times in documents of its first rank loses the same edges at each of these places
    twins = shared.select(F.struct(*NODE).alias("node"), "rank", F.col("rid").alias("own_rid"), F.col("start").alias("own_start")).join(same, ["node", "rank"]).where((F.col("own_rid") != F.col("rid")) | (F.col("own_start") != F.col("base")))
    twins = twins.select("rank", F.col("own_rid").alias("rid"), (F.col("own_start") + F.col("start") - F.col("base")).alias("start"), "edges", "digest")
    same = same.select(*ROW, "start", "edges", F.lit(None).cast("binary").alias("digest")).unionByName(twins)
    cuts = found.unionByName(same).groupBy(*ROW).agg(F.collect_list(F.struct("start", "edges", "digest")).alias("cuts"))  # as many as the text has spans
    cuts = Scratch(docs.sparkSession).table(cuts, "cuts")
    tmp.drop()
    return cuts


def _digest(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def _read(docs: DataFrame, places: DataFrame, window: int) -> DataFrame:
    """What stands at the source coordinates of ``places`` (anchor, span, edges, first, open): the words and the hashes of all edges of
    paths to open, the digest of the words of other spans. One row for each place, also if its document is repeated."""
    at = places.groupBy(F.col("first.rank").alias("rank"), F.col("first.rid").alias("rid")).agg(F.collect_list(F.struct("first.start", *NODE, "open")).alias("ps"))

    def run(batches):
        for b in blocks(batches):
            out = {c: [] for c in ("digest", "hashes", "words")}
            ps = b.column("ps")
            for t, at in zip(b.column("text").to_pylist(), ps.to_pylist(), strict=True):
                words = _words(t)
                hashes = Spans(hashed(words)).windows(window).view(np.int64) if any(p["open"] for p in at) else None
                for p in at:
                    start, end = p["start"], p["start"] + p["edges"]
                    own = words[start : end - 1 + window]
                    out["digest"].append(None if p["open"] else _digest(own))
                    out["hashes"].append(hashes[start:end] if p["open"] else None)
                    out["words"].append(b" ".join(own).decode() if p["open"] else None)
            flat = pa.Table.from_struct_array(ps.flatten()).combine_chunks()
            row = pa.array(np.repeat(np.arange(b.num_rows), pa.compute.list_value_length(ps).to_numpy()))
            new = [pa.array(out["digest"], pa.binary()), pa.array(out["hashes"], pa.list_(pa.int64())), pa.array(out["words"], pa.string())]
            cols = [*(flat[c].combine_chunks() for c in [*NODE, "open"]), *(b.column(c).take(row) for c in ROW), flat["start"].combine_chunks(), *new]
            yield pa.RecordBatch.from_arrays(cols, names=[*NODE, "open", *ROW, "start", *out])

    schema = "anchor long, span long, edges int, open boolean, rank long, rid long, start int, digest binary, hashes array<long>, words string"
    return docs.join(at, ROW).select("text", *ROW, "ps").mapInArrow(run, schema).dropDuplicates([*NODE, "open"])


def prepared(docs: DataFrame, id_col: str, text: str) -> list:
    """Columns rank, which orders documents (a null id comes after all others), rid, which with it names a row, and text."""
    last = F.lit((1 << 63) - 1)
    return [F.coalesce(F.col(id_col).cast("long"), last).alias("rank"), F.xxhash64(F.col(id_col), F.col(text)).alias("rid"), F.col(text).alias("text")]


def covered(words: list[bytes], cuts, window: int) -> np.ndarray:
    """Which of the words lie in a removed window; a cut whose words aren't those of its digest removes none."""
    d = np.zeros(len(words) + 1, np.int32)
    for c in cuts:
        end = c["start"] + c["edges"] - 1 + window
        if end <= len(words) and (c["digest"] is None or c["digest"] == _digest(words[c["start"] : end])):
            d[c["start"]] += 1
            d[end] -= 1
    return np.cumsum(d[:-1]) > 0


def judged(docs: DataFrame, other: DataFrame, window: int, k: int, id_col: str, text: str) -> DataFrame:
    """``other``, one struct column of ``docs`` for what is passed through, with n_words, n_removed, kept_sha256 and kept."""
    small_batches(docs.sparkSession)
    rows = docs.select(*prepared(docs, id_col, text))
    full = docs.select(other.alias("row"), *prepared(docs, id_col, text)).join(repeats(rows, window, k), ROW, "left").select("row", "text", "cuts")

    def run(batches):
        for b in blocks(batches):
            n, gone, sha, kept_text = [], [], [], []
            for t, cuts in zip(b.column("text").to_pylist(), b.column("cuts").to_pylist(), strict=True):
                words = kept = _words(t)
                if cuts:
                    off = covered(words, cuts, window)
                    kept = [w for w, x in zip(words, off.tolist(), strict=True) if not x]
                joined = b" ".join(kept)
                n.append(len(words))
                gone.append(len(words) - len(kept))
                sha.append(hashlib.sha256(joined).hexdigest())
                kept_text.append(joined.decode() if len(kept) < len(words) else t)
            cols = [b.column("row"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha), pa.array(kept_text, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["row", "n_words", "n_removed", "kept_sha256", "kept"])

    return full.mapInArrow(run, schema_of(row=full.schema["row"].dataType, n_words="long", n_removed="long", kept_sha256="string", kept="string"))


def without_repeats(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: its id, n_words, n_removed, kept_sha256 and kept, the text that is left.

    A word goes if a window over it starts in a document of a smaller id too; repeats inside one document stay, as do those of
    rows with equal ids. Ids are integers (others are cast); a null id comes last. Null and empty texts have no words. A text that
    loses nothing is returned as it is, another as its kept words with a blank between. A text is held by one task as a whole,
    however long it is. Repeated rows are judged alike; an empty table gives an empty result. Other columns aren't read.
    """
    return judged(docs, F.struct(F.col(id_col).alias(id_col)), window, k, id_col, text).select("row.*", "n_words", "n_removed", "kept_sha256", "kept")


def cut(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR, id_col: str = "doc_id", text: str = "text", length: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` with what is left of their texts, and its code points in ``length`` if there is such a column. All other
    columns pass through, whatever they are called; every row stays. Judged as by `without_repeats`."""
    found = judged(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text)), window, k, id_col, text)
    new = {text: F.col("kept"), length: F.length("kept").cast(docs.schema[length].dataType) if length in docs.columns else None}
    return found.select(*((new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir)).drop("kept")


OP2_SQL = """
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS pos, len(ws) AS n FROM t),
e AS (SELECT doc_id, s AS pos, md5(array_to_string(ws[s : s + 49], ' ')) AS mer FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 49)) AS s FROM t)),
r AS (SELECT doc_id, pos FROM e JOIN (SELECT mer, min(doc_id) AS lo FROM e GROUP BY mer) USING (mer) WHERE lo < doc_id),
c AS (SELECT p.doc_id, p.pos, word, max(CASE WHEN r.pos IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY p.doc_id ORDER BY p.pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
  FROM p LEFT JOIN r ON p.doc_id = r.doc_id AND p.pos = r.pos),
k AS (SELECT doc_id, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (gone = 0) AS kept FROM c GROUP BY doc_id)
SELECT t.doc_id, len(ws) AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN k USING (doc_id)
"""
