"""Which texts stand in which documents, by an automaton of the texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources import files

#: Bytes of texts that one automaton is made of; more texts take several passes over the documents.
MOST = 4 << 20


def contained(items: DataFrame, docs: DataFrame, item_key: str = "query_id", doc_key: str = "doc_id") -> DataFrame:
    """(item key, doc key) of every text of ``items`` (key, text) that stands in a document (key, text). The automaton of a pass's texts
    goes to all tasks and finds all of them in one run over a document. Null texts stand nowhere, an empty one in every text."""
    import ahocorasick

    spark = docs.sparkSession
    items = files.index(items.where("text IS NOT NULL").select(item_key, "text"), "items")
    passes = max(1, -(-(items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0) // MOST))
    schema = StructType([items.schema[item_key], docs.schema[doc_key]])
    found = None
    for p in range(passes):
        part = (items if passes == 1 else items.where(F.pmod(F.xxhash64(item_key, "text"), F.lit(passes)) == p)).toArrow().combine_chunks()
        if not part.num_rows:
            continue
        shared = spark.sparkContext.broadcast((part[item_key].combine_chunks(), part["text"].to_pylist()))  # MOST

        def run(batches, shared=shared):
            keys, texts = shared.value
            places: dict[str, list[int]] = {}
            for i, t in enumerate(texts):
                places.setdefault(t, []).append(i)
            anywhere = places.pop("", [])
            automaton = ahocorasick.Automaton()
            for t in places:
                automaton.add_word(t, t)
            automaton.make_automaton()
            for b in batches:
                row, item = [], []
                for i, text in enumerate(b.column("text").to_pylist()):
                    if text is not None:
                        hits = {t for _, t in automaton.iter(text)} if places else ()
                        at = [*anywhere, *(k for t in hits for k in places[t])]
                        row += [i] * len(at)
                        item += at
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(item, pa.int64())), b.column(doc_key).take(pa.array(np.array(row, np.int64)))], names=schema.names)

        own = docs.select(doc_key, "text").mapInArrow(run, schema)
        found = own if found is None else found.unionByName(own)
    return spark.createDataFrame([], schema) if found is None else found
