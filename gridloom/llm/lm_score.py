"""Language-model scores by stupid backoff, with counts from the whole corpus.

Operator 2.  Every block of documents lists its distinct n-grams with its own counts, dealt to
buckets by hash; a bucket adds up the counts of each n-gram over all blocks (the n-gram table,
partitioned by hash) and sends every block the totals for what it listed; the block joins them to
its exploded n-grams and adds up the scores of each document.  Counts are added up within a block
before anything is shuffled, so the most frequent n-gram costs one entry a block.

The score of a word is c(h w) / c(h) for the longest history h for which c(h w) is at least
``least``, times ``alpha`` for each word that the history was shortened by; without a history it is
c(w) / N.  N-grams don't cross documents.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, document_words, lowered, packed_blocks, pieces_for, sequence_hashes, unpacked

ORDER = 3
ALPHA = 0.4
#: N-grams of two and more words count as seen from this count on.
LEAST = 2
BLOCK_BYTES = 16 << 20
BUCKET_BYTES = 16 << 20


def _squeezed(values: np.ndarray) -> bytes:
    """Integers by byte planes, compressed: planes of high bytes are nearly constant."""
    import zstandard

    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.dtype.itemsize).T).tobytes() if len(values) else b""
    return struct.pack("<Q", len(values)) + zstandard.ZstdCompressor(level=1).compress(planes)


def _expanded(data: bytes, dtype) -> np.ndarray:
    import zstandard

    (n,) = struct.unpack_from("<Q", data)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8:]), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(dtype).itemsize, n).T).view(dtype).ravel()


def _cuts(sorted_hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket ends in a sorted list: buckets are equal ranges of the hash."""
    number = ((sorted_hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return np.searchsorted(number, np.arange(1, buckets + 1, dtype=np.uint64))


def _grams(words: list[np.ndarray], n: int) -> np.ndarray:
    """Hashes of the n-grams of all documents, one after another."""
    return np.concatenate([sequence_hashes(w, n) for w in words if len(w) >= n] or [np.zeros(0, np.uint64)])


def _rows(payloads):
    for payload in payloads:
        frame = unpacked([payload])
        yield frame, list(document_words(lowered([t if isinstance(t, str) else "" for t in frame["text"]])))


def lm_scores(
    docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, least: int = LEAST,
    block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """(doc_id, n_words, score, mean_score): natural logarithms, per document and per word.

    Counts and scores cover all rows of ``docs`` (doc_id, text); repeated rows count each time.  A
    text without words, null or empty, has score 0 and a null mean; a null doc_id is carried
    along; other columns are ignored; an empty table gives an empty table.
    """
    total, n_all = docs.agg(F.sum(F.octet_length("text")), F.sum(F.regexp_count("text", F.lit(WORD)))).first()
    total, n_all = total or 0, n_all or 0
    blocks, buckets = pieces_for(total, block_bytes), pieces_for(total, bucket_bytes)
    source = docs.select("doc_id", "text")
    payloads = packed_blocks(source, source.columns, blocks).repartition(blocks, "block")

    def ask(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        words = [w for _, rows in _rows(frame["payload"]) for w in rows]
        out = []
        for n in range(1, order + 1):
            hashes, counts = np.unique(_grams(words, n), return_counts=True)
            low = 0
            for b, high in enumerate(_cuts(hashes, buckets)):
                if high > low:
                    steps = np.diff(hashes[low:high], prepend=np.uint64(0))
                    out.append((key[0], b, n, _squeezed(steps), _squeezed(counts[low:high].astype(np.uint32))))
                low = high
        return pd.DataFrame(out, columns=["block", "bucket", "n", "steps", "counts"])

    asked = payloads.groupBy("block").applyInPandas(ask, "block long, bucket long, n int, steps binary, counts binary")

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        lists = [np.cumsum(_expanded(s, np.uint64), dtype=np.uint64) for s in frame["steps"]]
        everything, at = np.unique(np.concatenate(lists), return_inverse=True)
        counts = np.concatenate([_expanded(c, np.uint32) for c in frame["counts"]])
        sums = np.bincount(at, weights=counts, minlength=len(everything)).astype(np.uint64)
        ends = np.cumsum([len(x) for x in lists])
        totals = [_squeezed(sums[at[e - len(x) : e]]) for e, x in zip(ends, lists)]
        return pd.DataFrame({"block": frame["block"], "bucket": frame["bucket"], "n": frame["n"], "totals": totals})

    # an n-gram's hash covers its length, so each bucket and length is a table of its own
    answered = asked.groupBy("bucket", "n").applyInPandas(answer, "block long, bucket long, n int, totals binary")

    def join(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        frames, words = [], []
        for frame, rows in _rows(left["payload"]):
            frames.append(frame[["doc_id"]])
            words += rows
        right = right.sort_values(["n", "bucket"])
        found = {}
        for n in range(1, order + 1):
            grams = _grams(words, n)
            _, at = np.unique(grams, return_inverse=True)
            totals = [_expanded(t, np.uint64) for t in right["totals"][right["n"] == n]]
            found[n] = (np.concatenate(totals) if totals else np.zeros(0, np.uint64))[at].astype(np.float64)
        size = np.array([len(w) for w in words], np.int64)
        # one entry a word: the count of the n-gram that ends there, and of its history
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        score = np.log(found[1] / max(n_all, 1)) if len(found[1]) else found[1]
        score += np.log(alpha) * np.minimum(place, order - 1)
        for n in range(2, order + 1):
            ends = np.flatnonzero(place >= n - 1)
            here = found[n]
            if n == 2:
                history = found[1][ends - 1]
            else:
                before = np.cumsum(place >= n - 2) - 1
                history = found[n - 1][before[ends - 1]]
            seen = here >= least
            back = np.log(alpha) * np.maximum(0, np.minimum(place[ends], order - 1) - (n - 1))
            score[ends[seen]] = (np.log(here / history) + back)[seen]
        sums = np.zeros(len(words))
        np.add.at(sums, np.repeat(np.arange(len(words)), size), score)
        out = pd.concat(frames, ignore_index=True)
        out["n_words"], out["score"] = size, sums
        out["mean_score"] = [s / n if n else None for s, n in zip(sums, size)]
        return out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return payloads.groupBy("block").cogroup(answered.groupBy("block")).applyInPandas(
        join, f"doc_id {kind}, n_words long, score double, mean_score double"
    )


def rounded(scores: DataFrame) -> DataFrame:
    """Scores to six places, so that the order of additions doesn't show."""
    return scores.select("doc_id", "n_words", F.round("score", 6).alias("score"), F.round("mean_score", 6).alias("mean_score"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: DuckDB statement for the rows of op2 at its production parameters.
SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS w
  FROM documents
), p AS (
  SELECT r, i, w[i] AS w3, CASE WHEN i > 1 THEN w[i - 1] END AS w2, CASE WHEN i > 2 THEN w[i - 2] END AS w1
  FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d)
), c AS (
  SELECT r, i,
    count(*) OVER () AS n,
    count(*) OVER (PARTITION BY w3) AS c3,
    CASE WHEN i > 1 THEN count(*) OVER (PARTITION BY w2, w3) END AS c23,
    CASE WHEN i > 2 THEN count(*) OVER (PARTITION BY w1, w2, w3) END AS c123
  FROM p
), h AS (
  SELECT *, lag(c3) OVER o AS h2, lag(c23) OVER o AS h12 FROM c WINDOW o AS (PARTITION BY r ORDER BY i)
), s AS (
  SELECT r, CASE
      WHEN i > 2 AND c123 >= {LEAST} THEN ln(c123 / h12)
      WHEN i > 1 AND c23 >= {LEAST} THEN ln(c23 / h2) + ln({ALPHA}) * (least(i, {ORDER}) - 2)
      ELSE ln(c3 / n) + ln({ALPHA}) * (least(i, {ORDER}) - 1) END AS x
  FROM h
), t AS (
  SELECT r, count(*) AS n, sum(x) AS x FROM s GROUP BY r
)
SELECT doc_id, coalesce(n, 0) AS n_words, round(coalesce(x, 0), 6) AS score, round(x / n, 6) AS mean_score
FROM d LEFT JOIN t USING (r)
"""
