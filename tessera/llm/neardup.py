"""One document of each group of near copies, for the pipeline: SimHash with a pigeonring filter, completed by MinHash.

Documents are near if the sets of their word shingles (lower-cased A-Z) have a Jaccard similarity of `threshold` or more. At
that similarity fingerprints differ by far more bits than a pigeonring search can take (5 to 14 of 64 at 0.8), so SimHash
alone misses most near copies. A spanning set of its links is kept as candidates (equal fingerprints pair with one of them, close
ones by representatives, links() is a forest), so a link that fails the check can hide another; recall rests on MinHash banding
over the same shingles. Every candidate is verified on the exact sets, so a chance likeness of fingerprints removes no document.

Defined results: null text is empty; documents without a word are copies of each other; fewer words than a shingle make a copy
only of equal words; of a group the smallest doc_id stays, null last; rows that repeat doc_id and text are one, rows that repeat
doc_id alone are not; empty tables give no rows; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.common import stage, text_bytes
from tessera.llm.lines import Items, line_id, near_items, whole_words, word_hashes


def prints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, mark (the text's hash), id (the hash of its words) and fp (its fingerprint) per row."""
    picked = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch)
            ids = np.fromiter((line_id(whole_words(t)[0]) for t in texts), np.uint64, len(texts)).view(np.int64)
            fps = np.fromiter((simhash.fingerprint(t, shingle) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids), pa.array(fps)], names=["doc_id", "mark", "id", "fp"])

    return picked.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, mark long, id long, fp long")


def keep_one(docs: DataFrame, shingle: int = 5, distance: int = 4, threshold: float = 0.8) -> DataFrame:
    """The rows of docs that stay."""
    made = stage(prints(docs, shingle), "prints")
    nodes = stage(made.groupBy("fp").agg(F.min("id").alias("rep")), "nodes")
    equal = made.join(nodes, "fp").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    end = lambda c: nodes.select(F.col("fp").alias(c), F.col("rep").alias(f"{c}_rep"))
    close = simhash.links(nodes.select("fp"), distance).join(end("a"), "a").join(end("b"), "b").select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b"))
    also = stage(equal.union(close).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "simhash-links")
    roots = near_items(docs, Items(whole_words, word_hashes, shingle), threshold, also=also)
    # equal texts first, so a large group of exact copies is combined before it meets its component
    at = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "mark")
    first = made.groupBy("id").agg(F.min(at).alias("at")).join(roots, F.col("id") == F.col("node"), "left")
    kept = first.groupBy(F.coalesce("root", "id")).agg(F.min("at").alias("at")).select(F.col("at.doc_id").alias("__id"), F.col("at.mark").alias("__mark"))
    marked = docs.withColumn("__own", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = marked.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__mark")), "left_semi")
    return rows.dropDuplicates(["doc_id", "__own"]).drop("__own")
