"""Threshold-scaled sketches of documents.

Operator 5.  A fingerprint keeps every distinct shingle hash below a fixed fraction of the range
and, so that it is never empty for a text with words, the least hash if none is below.  Both parts
merge: the fingerprint of a union is the union of fingerprints (less a sole least hash when others
are below), so containment between a page and a book can be estimated from their sketches.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import document_words, lowered, pieces_for, sequence_hashes, text_bytes

SHINGLE = 5
#: One hash in so many is kept.
SCALE = 4
#: Bytes of text in a range of ids that one task walks through.
RANGE_BYTES = 8 << 20
#: Ranges at most, of more bytes then; a task's memory depends on its two texts and not on its range.
RANGES = 50_000
#: Ids per range, those of least hash, from which the borders of ranges are taken.
BORDER_IDS = 20


def sketched(texts, shingle: int = SHINGLE, scale: int = SCALE) -> list[np.ndarray]:
    """The sorted kept hashes of each text; null and texts without words keep none."""
    limit = np.uint64((1 << 64) // scale)
    out = []
    for words in document_words(lowered(texts)):
        h = sequence_hashes(words, shingle)
        low = np.unique(h[h < limit])
        out.append(low if len(low) or not len(h) else h.min(keepdims=True))
    return out


def to_text(sketch: np.ndarray) -> str:
    """Hexadecimal, 16 digits a hash."""
    return sketch.astype(">u8").tobytes().hex()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)


def merged(one: np.ndarray, two: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The sketch of both texts' shingles together."""
    both = np.union1d(one, two)
    low = both[both < np.uint64((1 << 64) // scale)]
    return low if len(low) else both[:1]


def likeness(one: np.ndarray, two: np.ndarray) -> float:
    """Estimated Jaccard similarity; two sketches without hashes are alike."""
    if not len(one) or not len(two):
        return float(len(one) == len(two))
    common = len(np.intersect1d(one, two, assume_unique=True))
    return common / (len(one) + len(two) - common)


def containment(one: np.ndarray, two: np.ndarray) -> float:
    """Estimated share of the first text's shingles that the second has; 1 for none."""
    return len(np.intersect1d(one, two, assume_unique=True)) / len(one) if len(one) else 1.0


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """``docs`` (doc_id, text) with the fingerprint of each whole text; one row per row."""

    @F.pandas_udf("string")
    def sketch(texts: pd.Series) -> pd.Series:
        return pd.Series([to_text(s) for s in sketched(texts, shingle, scale)])

    return docs.select("doc_id", sketch("text").alias("fingerprint"))


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the start of ``following``."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def borders(docs: DataFrame, ranges: int) -> np.ndarray:
    """Rising ids that cut those of ``docs`` into about equal ranges; only the balance of tasks depends on them."""
    ids = docs.where("doc_id IS NOT NULL").select("doc_id")
    if ranges < 2:
        return np.zeros(0)
    every = max(1, ids.count() // (ranges * BORDER_IDS))
    found = sorted({r[0] for r in ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).distinct().collect()})
    at = sorted({len(found) * k // ranges for k in range(1, ranges)} - {0}) if found else []
    return np.array([found[k] for k in at], None if found and isinstance(found[0], int) else object)


def edit_fingerprints(docs: DataFrame, shingle: int = SHINGLE, scale: int = SCALE, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Contract columns of op5.

    Documents are dealt to ranges of doc_id; a task walks through its ranges in falling order and
    holds two texts at a time.  The first document of the next range is sent along with each
    range, so the texts are shuffled once and no task sees more than its range.  Equal doc_ids
    are ordered by text and share a range, null doc_ids come last, ids may be of any type that has an order, a null text is empty, an empty table gives an
    empty table and other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    cuts = borders(docs, min(RANGES, pieces_for(text_bytes(docs), range_bytes)))
    number = F.lit(0)
    if len(cuts):

        @F.pandas_udf("int")
        def above(ids: pd.Series) -> pd.Series:
            # range 0 holds the largest ids
            return pd.Series(len(cuts) - np.searchsorted(cuts, ids.to_numpy(), side="right"))

        # null ids go to the last range
        number = F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(above(F.coalesce("doc_id", F.lit(cuts[0]).cast(kind)))).cast("int")
    dealt = docs.select(number.alias("part"), F.lit(False).alias("ahead"), "doc_id", "text")

    order = Window.orderBy("part")
    heads = dealt.groupBy("part").agg(F.max("doc_id").alias("doc_id"), F.count("doc_id").alias("ids"))
    first = Window.partitionBy()
    heads = heads.select(F.coalesce(F.lag("part").over(order), F.max("part").over(first)).alias("to"), "part", "doc_id")
    # of equal first ids the least text comes first, as in the walk
    aheads = (
        dealt.join(heads.hint("broadcast") if len(cuts) < 10_000 else heads, F.expr("true") & heads["doc_id"].eqNullSafe(dealt["doc_id"]) & (heads["part"] == dealt["part"]), "inner")
        .groupBy("to", heads["doc_id"])
        .agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
        .select(F.col("to").alias("part"), F.lit(True).alias("ahead"), "doc_id", "text")
    )
    walk = dealt.unionByName(aheads).repartition(len(cuts) + 1, "part").sortWithinPartitions("part", "ahead", F.col("doc_id").desc_nulls_last(), F.coalesce("text", F.lit("")))

    def run(batches):
        held = None  # (part, doc_id, text, sketch) of a row whose next one hasn't come yet

        def close(a, b_text, b_sketch):
            text = edited(a[2], b_text)
            (sketch,) = sketched([text], shingle, scale)
            return (
                a[1], len(a[2]), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(),
                to_text(a[3]), to_text(sketch), likeness(a[3], sketch), likeness(a[3], b_sketch),
            )

        import pyarrow as pa

        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        types = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for batch in batches:
            rows = []
            columns = [c.to_pylist() for c in batch.columns]
            texts = [t or "" for t in columns[3]]
            for part, ahead, doc_id, text, s in zip(*columns[:3], texts, sketched(texts, shingle, scale)):
                if held is not None and held[0] == part:
                    rows.append(close(held, text, s))
                held = None if ahead else (part, doc_id, text, s)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows) if rows else [[]] * 7, types)], names)

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    return walk.mapInArrow(
        run,
        f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
