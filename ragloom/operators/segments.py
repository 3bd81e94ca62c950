"""A knowledge base that grows and shrinks by segments.

Each call of `append` makes a segment of its own: parents, children with vectors, postings by blocks and their statistics. Statistics
add up, so a search over all segments scores as one over an index built at once. A deletion reads no text: it lists the ids that
have gone, marks their places in the blocks and takes their counts from the statistics. Segments of one size tier merge when there are
`FAN` of them, without cutting or embedding anything anew. What is current is a manifest (`sources.snapshots`), so a change that
fails leaves the base as it was, and readers keep the state they began with.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import DEFAULT, Config
from ..functions.text import hash_embedding
from ..sources import files, snapshots
from . import chunking, lexical, retrieval

#: Segments of a tier that merge, and by how much the tiers' sizes differ.
FAN = 4


def _tier(n: int) -> int:
    return max(0, n - 1).bit_length() // 2  # sizes within a factor of FAN


class Base:
    """The knowledge base in a folder that all executors share. Objects read the version that is current when they are made, and the
    versions they publish."""

    def __init__(self, spark: SparkSession, path: str, cfg: Config = DEFAULT, *, embedder=hash_embedding):
        self.spark, self.path, self.cfg, self.embedder = spark, path, cfg, embedder
        self.version, self.says = snapshots.manifest(spark, path)
        self.says = self.says or {"segments": [], "schemas": {}, "batches": {}}

    # tables
    def _write(self, folder: str):
        def write(df: DataFrame, name: str) -> DataFrame:
            self.says["schemas"].setdefault(name, df.schema.json())
            return files.written(df, f"{self.path}/{folder}/{name}")

        return write

    def _table(self, name: str, where: list[str]) -> DataFrame:
        schema = StructType.fromJson(json.loads(self.says["schemas"][name]))
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{x}" for x in where)) if where else self.spark.createDataFrame([], schema)

    def _live(self, name: str, segments: list[dict]) -> DataFrame:
        """Rows of a segment's table whose document hasn't been deleted since."""
        found = None
        for s in segments:
            own = self._table(name, [f"{s['folder']}/{name}"])
            if s["gone"]:
                own = own.join(files.few(self._table("gone", s["gone"]).distinct(), "all-gone"), "doc_id", "left_anti")
            found = own if found is None else found.unionByName(own)
        return self._table(name, []) if found is None else found

    def _lexical(self, s: dict) -> lexical.Lexical:
        dead = self._table("dead", s["dead"]).select("block", "dead") if s["dead"] else None
        return lexical.Lexical(self._table("postings", [f"{s['folder']}/postings"]), self._table("terms", [s["terms"]]), s["docs"], s["tokens"], dead)

    @property
    def parents(self) -> DataFrame:
        return self._live("parents", self.says["segments"])

    @property
    def children(self) -> DataFrame:
        return self._live("children", self.says["segments"])

    @property
    def postings(self) -> lexical.Lexical:
        parts = [self._lexical(s) for s in self.says["segments"]]
        whole = parts[0]
        for more in parts[1:]:
            whole = whole.plus(more)
        return whole

    def engine(self, **models):
        """An engine that answers from the current state."""
        from ..engine import Engine

        engine = Engine(self.spark, self.cfg, embedder=self.embedder, **models)
        engine.parents, engine.children, engine.postings = self.parents, self.children, self.postings
        return engine

    # changes
    def _publish(self, segments: list[dict], **more) -> None:
        says = self.says | {"segments": segments} | more
        self.version = snapshots.publish(self.spark, self.path, says, self.version)
        self.says = says

    def _segment(self, docs: DataFrame) -> dict:
        folder = snapshots.fresh("segment")
        write = self._write(folder)
        parents = write(chunking.parents(docs, self.cfg), "parents")
        cut = chunking.children(parents, self.cfg).select("child_id", "parent_id", "doc_id", "text")
        children = write(retrieval.embed(cut, self.cfg, self.embedder), "children")
        index = lexical.build(children, write=write)
        return {"folder": folder, "docs": index.docs, "tokens": index.tokens, "terms": f"{folder}/terms", "dead": [], "gone": []}

    def _without(self, s: dict, ids: DataFrame) -> dict:
        """The segment's entry after the documents of ``ids`` (doc_id) have gone; the entry itself if it has none of them."""
        keys = self._live("children", [s]).join(ids, "doc_id", "left_semi").select("child_id", "doc_id")
        folder = snapshots.fresh("change")
        write = self._write(folder)
        keys = write(keys, "keys")
        n = keys.count()
        alone = self._live("parents", [s]).join(ids, "doc_id", "left_semi")
        if not n and alone.isEmpty():
            return s
        write(ids, "gone")
        index = lexical.without(self._lexical(s), keys, "child_id", n, write)
        return s | {"docs": index.docs, "tokens": index.tokens, "terms": f"{folder}/terms", "dead": [*s["dead"], f"{folder}/dead"], "gone": [*s["gone"], f"{folder}/gone"]}

    def append(self, docs: DataFrame, batch: tuple[str, int] | None = None) -> bool:
        """Add documents (doc_id, text, source) whose ids are new. ``batch``: (stream, number); a number that isn't beyond the last one
        added from this stream changes nothing, and False is returned."""
        if batch and self.says["batches"].get(batch[0], -1) >= batch[1]:
            return False
        batches = self.says["batches"] | ({batch[0]: batch[1]} if batch else {})
        self._publish([*self.says["segments"], self._segment(docs)], batches=batches)
        return True

    def delete(self, ids: DataFrame) -> None:
        """Remove the documents of ``ids`` (doc_id); unknown ids change nothing."""
        ids = files.few(ids.select("doc_id").distinct(), "ids")
        self._publish([self._without(s, ids) for s in self.says["segments"]])

    def put(self, docs: DataFrame) -> None:
        """Add documents, in place of those with the same ids."""
        docs = files.index(docs, "put")
        ids = files.few(docs.select("doc_id").distinct(), "ids")
        kept = [self._without(s, ids) for s in self.says["segments"]]
        self._publish([*kept, self._segment(docs)])

    def merge(self, fan: int = FAN) -> bool:
        """Merge the segments of the smallest tier that has ``fan`` of them; False if there is none. Texts are copied, not read anew."""
        tiers: dict[int, list[dict]] = {}
        for s in self.says["segments"]:
            tiers.setdefault(_tier(s["docs"]), []).append(s)
        full = next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= fan), None)
        if not full:
            return False
        folder = snapshots.fresh("segment")
        write = self._write(folder)
        write(self._live("parents", full), "parents")
        write(self._live("children", full), "children")
        index = self._lexical(full[0])
        for s in full[1:]:
            index = index.plus(self._lexical(s))
        write(purged(index), "postings")
        write(index.terms, "terms")
        merged = {"folder": folder, "docs": index.docs, "tokens": index.tokens, "terms": f"{folder}/terms", "dead": [], "gone": []}
        self._publish([*(s for s in self.says["segments"] if s not in full), merged])
        return True


def purged(index: lexical.Lexical) -> DataFrame:
    """The index's blocks without the chunks that have gone; blocks of such chunks only are left out. Without any they are copied."""
    if index.dead is None:
        return index.blocks
    blocks = lexical._blocks(index)
    schema = index.blocks.schema

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                dead = row.column("dead")[0].values
                if dead is None:
                    yield row.select(schema.names)
                    continue
                get = lambda c: row.column(c)[0].values  # noqa: E731, B023
                keys, lengths = get("keys"), get("lengths").to_numpy()
                stays = np.ones(len(keys), bool)
                stays[dead.to_numpy()] = False
                if not stays.any():
                    continue
                place = np.cumsum(stays) - 1
                starts, chunks, counts = (get(c).to_numpy() for c in ("starts", "chunks", "counts"))
                term = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
                own = stays[chunks]
                used, first = np.unique(term[own], return_index=True)
                chunks, counts, long = place[chunks[own]], counts[own], lengths[chunks[own]]
                ints = {"lengths": lengths[stays], "starts": np.append(first, len(chunks)), "chunks": chunks, "counts": counts, "most": np.maximum.reduceat(counts, first), "least": np.minimum.reduceat(long, first)}
                kept = keys.filter(pa.array(stays))
                lists = {c: pa.array([x.astype(np.int32)], pa.list_(pa.int32())) for c, x in ints.items()}
                lists |= {c: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for c, x in (("keys", kept), ("terms", get("terms").take(pa.array(used))))}
                yield pa.RecordBatch.from_arrays([kept.slice(0, 1), *(lists[c] for c in schema.names[1:])], names=schema.names)

    return blocks.mapInArrow(run, schema)
