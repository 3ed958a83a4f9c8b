"""Quality classifier by importance resampling.

Operator 4.  Bags of hashed n-grams are modelled by two categorical distributions over a fixed
number of buckets, one of target text and one of raw text; a document's importance is the ratio of
the two, and a Gumbel top-k draw over log importances is a sample without replacement.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, document_words, sequence_hashes

BUCKETS = 10_000
#: Words of the longest n-gram.
ORDER = 2
SMOOTH = 1.0
SEED = 17
#: The target model is fitted on so many labelled rows at most, those of least hash.
TARGET_ROWS = 20_000


def _bags(texts, buckets: int, order: int):
    """Bucket numbers of the n-grams of each text; letters keep their case."""
    data = [b"" if not isinstance(t, str) else t.encode("utf-8", "surrogatepass") for t in texts]
    for words in document_words(data):
        grams = [sequence_hashes(words, n) for n in range(1, order + 1) if len(words) >= n]
        yield (np.concatenate(grams) % np.uint64(buckets)).astype(np.int64) if grams else np.zeros(0, np.int64)


def models(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each bucket in all of ``docs`` and in those whose doc_id is in ``target``, a bounded table.

    Tasks add up their own texts first; the driver gets one row per bucket.
    """
    marked = docs.select("doc_id", "text").join(F.broadcast(target.select("doc_id", F.lit(True).alias("_t")).distinct()), "doc_id", "left").select("text", F.coalesce("_t", F.lit(False)).alias("t"))

    def count(batches):
        raw, wanted = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for bag, t in zip(_bags(batch["text"], buckets, order), batch["t"]):
                found = np.bincount(bag, minlength=buckets) if len(bag) > buckets // 8 else None
                for sums in (raw, wanted) if t else (raw,):
                    if found is None:
                        np.add.at(sums, bag, 1)
                    else:
                        sums += found
        at = np.flatnonzero(raw)
        yield pd.DataFrame({"bucket": at, "raw": raw[at], "wanted": wanted[at]})

    rows = marked.mapInPandas(count, "bucket long, raw long, wanted long").groupBy("bucket").agg(F.sum("raw"), F.sum("wanted")).collect()
    raw, wanted = np.zeros(buckets), np.zeros(buckets)
    for b, r, w in rows:
        raw[b], wanted[b] = r, w
    return raw, wanted


def log_ratios(raw: np.ndarray, wanted: np.ndarray, smooth: float = SMOOTH) -> np.ndarray:
    """Log of target over raw probability of each bucket, smoothed."""
    p, q = wanted + smooth, raw + smooth
    return np.log(p / p.sum()) - np.log(q / q.sum())


def _bits(column: str, at: int):
    return F.shiftrightunsigned(F.col(column), at).bitwiseAND(F.lit(0xFFFF))


def kth_largest(keys: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest of a long column, or None where k is 0; 65,536 counts at a time reach the driver."""
    if k <= 0:
        return None
    flipped = keys.select(F.col(column).bitwiseXOR(F.lit(-(1 << 63))).alias("u"))
    prefix = 0
    for at in (48, 32, 16, 0):
        rest = flipped.where(F.shiftrightunsigned("u", at + 16) == F.lit(prefix)) if at < 48 else flipped
        counts = dict(rest.groupBy(_bits("u", at).alias("b")).count().collect())
        for b in sorted(counts, reverse=True):
            if k <= counts[b]:
                prefix = prefix << 16 | b
                break
            k -= counts[b]
        else:
            return -(1 << 63)
    value = prefix ^ (1 << 63)
    return value - (1 << 64) if value >= 1 << 63 else value


def importance_resample(
    docs: DataFrame, labels: DataFrame, fraction: float | None = None, buckets: int = BUCKETS, order: int = ORDER,
    target_rows: int = TARGET_ROWS, seed: int = SEED,
) -> DataFrame:
    """(doc_id, n_grams, log_importance, gumbel_key, kept) for each row of ``docs`` (doc_id, text).

    The target is the text that ``labels`` (doc_id, quality) marks 1; the raw model covers all of
    ``docs``.  The share ``fraction`` of rows with the largest keys is kept, by default the share
    of labelled rows that are good.  A text without words, null or empty, has importance 0 in
    logarithms, as any text has under equal models; rows with the same doc_id and text have the
    same key; of rows that tie for the last place only so many are kept that the share is met exactly; without good
    labels all importances are 0; other columns are ignored; an empty table gives an empty table.
    Importances are sums over n-grams, so long texts outweigh the Gumbel noise, as the method has it.
    """
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    target = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_rows)
    if fraction is None:
        fraction = labels.agg(F.avg(F.when(F.col("quality") == 1, 1.0).otherwise(0.0))).first()[0] or 0.0
    raw, wanted = models(docs, target, buckets, order)
    ratios = log_ratios(raw, wanted) if wanted.sum() else np.zeros(buckets)

    @F.pandas_udf("n_grams long, log_importance double, gumbel_key double, ordinal long")
    def score(texts: pd.Series, hashes: pd.Series) -> pd.DataFrame:
        bags = list(_bags(texts, buckets, order))
        logs = np.array([ratios[b].sum() for b in bags])
        uniform = ((hashes.to_numpy().astype(np.int64).view(np.uint64) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
        keys = logs - np.log(-np.log(uniform))
        bits = keys.view(np.int64)
        ordinal = np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits)
        return pd.DataFrame({"n_grams": [len(b) for b in bags], "log_importance": logs, "gumbel_key": keys, "ordinal": ordinal})

    scored = checkpointed(docs.select("doc_id", score("text", F.xxhash64("doc_id", "text", F.lit(seed))).alias("_s")).select("doc_id", "_s.*", F.monotonically_increasing_id().alias("row")))
    k = round(fraction * scored.count())
    last = kth_largest(scored, "ordinal", k)
    kept = F.lit(False)
    if last is not None:
        k -= scored.where(F.col("ordinal") > F.lit(last)).count()
        least = kth_largest(scored.where(F.col("ordinal") == F.lit(last)), "row", k)
        kept = (F.col("ordinal") > F.lit(last)) | ((F.col("ordinal") == F.lit(last)) & (F.col("row") >= F.lit(least)))
    return scored.select("doc_id", "n_grams", "log_importance", "gumbel_key", kept.alias("kept"))
