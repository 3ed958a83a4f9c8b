"""BPE encoding and decoding through a table of distinct words.

Operator 7.  Blocks of documents are split into words; each distinct word of a block asks the
bucket that its hash names, the bucket encodes every distinct word once, and the ids go back to the
blocks, where they are joined to the words by position.  Decoding joins ids to the vocabulary's
pieces, a table whose size the vocabulary bounds.  Words travel packed, one row for each block and
bucket, because a row a word would be many times the text.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import struct
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _POWERS, give_back, mix, packed_blocks, pieces_for, text_bytes, unpacked

BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20

#: The endings that the byte-level pattern splits off after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Class of code points that haven't been met yet, of what lies between parts of texts, and of special tokens.
UNKNOWN, BETWEEN, SPECIAL = 255, 254, 253
#: Texts are split in runs of about this many characters; a longer text is a run of its own.
RUN_CHARS = 1 << 19
#: Words of the texts whose results are put together at once; a longer text is alone.
RUN_WORDS = 1 << 17


def vocabulary(path: str) -> str:
    """The tokenizer file's content, read on the driver and sent to tasks; a few MB at most."""
    with open(path, encoding="utf-8") as f:
        return f.read()


class Splitter:
    """Splits texts as the byte-level pattern does, by classes of code points.

    Special tokens are cut out first.  Classes: letter, number, other, white space.
    """

    def __init__(self, content: str) -> None:
        from tokenizers import Tokenizer

        self.specials = specials(content)
        self.ask = Tokenizer.from_str(content).pre_tokenizer.pre_tokenize_str
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)

    def learn(self, points: np.ndarray) -> None:
        """Classes of code points, asked of the library's own pattern, whose Unicode may be older than Python's.

        A code point between two letters makes one piece with them if it is a letter; likewise
        between numbers and between others; what never does is white space.
        """
        self.classes[points] = 3
        for number, between in enumerate("a1!"):
            text = np.full(2 * len(points) + 1, ord(between), np.uint32)
            text[1::2] = points
            starts = np.zeros(len(text) + 1, bool)
            starts[[a for _, (a, _) in self.ask(text.tobytes().decode("utf-32-le"))]] = True
            at = np.arange(1, len(text), 2)
            self.classes[points[~starts[at] & ~starts[at + 1]]] = number

    def parts(self, text: str) -> list[tuple[str, bool]]:
        """The text between special tokens, and these, marked."""
        for s in self.specials:
            if s in text:
                out = []
                for k, part in enumerate(text.split(s)):
                    out += [(s, True)] if k else []
                    out += self.parts(part)
                return out
        return [(text, False)] if text else []

    def pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The texts in UTF-8 with a byte between parts, each piece's first byte and length there, and each text's number of pieces."""
        parts = [self.parts(t) for t in texts]
        flat = [p for own in parts for p in own]
        text = "\n".join([p for p, _ in flat])
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        edge = np.cumsum([0, *(len(p) + 1 for p, _ in flat)])
        ends = edge[np.cumsum([len(own) for own in parts], dtype=np.int64)]
        if not flat:
            return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        kind = self.classes[codes]
        if (new := kind == UNKNOWN).any():
            self.learn(np.unique(codes[new]))
            kind = self.classes[codes]
        kind[edge[1:-1] - 1] = BETWEEN
        for k in [k for k, (_, special) in enumerate(flat) if special]:
            kind[edge[k] : edge[k + 1] - 1] = SPECIAL
        starts = np.empty(len(kind), bool)
        starts[0] = True
        np.not_equal(kind[1:], kind[:-1], out=starts[1:])
        # the last white space before other characters: a blank goes with them, else it stands alone
        last = np.flatnonzero((kind[:-1] == 3) & (kind[1:] < 3))
        starts[last] = True
        starts[last[codes[last] == 32] + 1] = False
        if "'" in text:
            self._endings(text, codes, kind, starts)
        at = np.flatnonzero(starts)
        width = (1 + (codes > 0x7F).view(np.uint8) + (codes > 0x7FF).view(np.uint8) + (codes > 0xFFFF).view(np.uint8)).astype(np.uint8)
        length = np.add.reduceat(width, at, dtype=np.int64)
        first = np.cumsum(length) - length
        inside = kind[at] != BETWEEN
        at, first, length = at[inside], first[inside], length[inside]
        many = np.diff(np.searchsorted(at, ends), prepend=0)
        return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), first, length, many

    @staticmethod
    def _endings(text, codes, kind, starts) -> None:
        for a in np.flatnonzero((codes == 39) & (kind == 2) & starts).tolist():
            for e in ENDINGS:
                if text.startswith(e, a + 1):
                    starts[a + 1] = False
                    if a + 1 + len(e) < len(text):
                        starts[a + 1 + len(e)] = True
                        # what follows is matched afresh; a blank that goes with the next word stays
                    break


class Encoder:
    """Encodes single words with the library."""

    def __init__(self, content: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def ids(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]


@lru_cache(1)
def splitter(content: str) -> Splitter:
    """One for a worker's life."""
    return Splitter(content)


@lru_cache(1)
def encoder(content: str) -> Encoder:
    """One for a worker's life."""
    return Encoder(content)


def specials(content: str) -> list[str]:
    return [t["content"] for t in json.loads(content)["added_tokens"]]


@lru_cache(1)
def pieces(content: str) -> dict[int, bytes]:
    """The id-to-piece table: bytes that each id stands for."""
    data = json.loads(content)
    # fixed values: the byte-level alphabet maps printable bytes to themselves, others from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    to_byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    table = {i: bytes(to_byte[c] for c in piece) for piece, i in data["model"]["vocab"].items()}
    return table | {t["id"]: t["content"].encode() for t in data["added_tokens"]}


@lru_cache(1)
def spelled(content: str) -> tuple[Spelling, Spelling]:
    """Each id in decimal with a comma, and the bytes that it stands for; one for a worker's life."""
    table = pieces(content)
    spell = lambda strings: Spelling(np.frombuffer(b"".join(strings), np.uint8), np.fromiter(map(len, strings), np.int64, len(strings)))
    return spell([b"%d," % i for i in range(max(table) + 1)]), spell([table.get(i, b"") for i in range(max(table) + 1)])


def gathered(data: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The items of all ranges (first, length) of ``data``, on end."""
    end = np.cumsum(length)
    return data[np.repeat(first - (end - length), length) + np.arange(end[-1] if len(end) else 0)]


class Spelling:
    """Byte strings, by number: the ranges (first, length) of ``data``."""

    def __init__(self, data: np.ndarray, length: np.ndarray) -> None:
        self.data, self.length, self.first = data, length, np.cumsum(length) - length

    def joined(self, numbers: np.ndarray, counts: np.ndarray) -> Spelling:
        """The strings of these numbers, joined in runs of so many."""
        length = self.length[numbers]
        ends = np.concatenate([[0], np.cumsum(length)])[np.cumsum(counts)]
        return Spelling(gathered(self.data, self.first[numbers], length), np.diff(ends, prepend=0))

    def strings(self) -> list[bytes]:
        body, ends = self.data.tobytes(), (self.first + self.length).tolist()
        return [body[a:b] for a, b in zip([0, *ends], ends)]


def narrow(values: np.ndarray, top: int) -> np.ndarray:
    """``values``, which ``top`` bounds, in 32 bits if these hold it."""
    return values.astype(np.int32) if top < 1 << 31 else values


def piece_hashes(data: np.ndarray, first: np.ndarray, length: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of the ranges of ``data``."""
    up, down = _POWERS.upto(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(np.random.default_rng(seed).integers(1, 1 << 64, 256, np.uint64)[data] * up[: len(data)], out=total[1:])
    return mix((total[first + length] - total[first]) * down[first] + length.astype(np.uint64))


class Words:
    """The texts of a block as numbers of its distinct words.

    Words have numbers by bucket and hash, so that the same texts in any order give the same; they
    are compared byte by byte, and where two share a hash all are hashed anew.
    """

    def __init__(self, split: Splitter, texts: list[str], buckets: int, hashes=piece_hashes) -> None:
        runs, sizes = [[]], 0
        for t in texts:
            if sizes and sizes + len(t) > RUN_CHARS:
                runs, sizes = [*runs, []], 0
            runs[-1].append(t)
            sizes += len(t)
        found, data, pieces, held = [], [], 0, 0
        for r in runs:
            body, first, length, many = split.pieces(r)
            data.append(body)
            found.append((pieces, held, narrow(first, len(body)), narrow(length, len(body)), many))
            pieces, held = pieces + len(first), held + len(body)
        # arrays of all pieces are many times the text, so none is wider or lives longer than it must
        self.many = np.concatenate([many for *_, many in found])
        kind = narrow(np.zeros(0, np.int64), held).dtype
        first, length = np.empty(pieces, kind), np.empty(pieces, kind)
        for k, start, f, n, _ in found:
            first[k : k + len(f)] = f
            first[k : k + len(f)] += kind.type(start)
            length[k : k + len(n)] = n
        self.data = np.concatenate(data)
        data = np.split(self.data, [start for _, start, *_ in found[1:]])
        for seed in itertools.count():
            values = np.empty(pieces, np.uint64)
            for body, (k, _, f, n, _) in zip(data, found):
                values[k : k + len(f)] = hashes(body, f, n, seed)
            # the table of hashes grows with the distinct ones; by default it starts with room for all
            at, values = pd.factorize(values, size_hint=pieces >> 4)
            at = narrow(at, pieces)
            one = np.empty(len(values), at.dtype)
            one[at] = np.arange(pieces, dtype=at.dtype)
            if self._same(first, length, one, at):
                break
        bucket = (values % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((values, bucket))
        place = np.empty(len(order), at.dtype)
        place[order] = np.arange(len(order), dtype=at.dtype)
        self.at, self.first, self.length, self.bucket = place[at], first[one][order], length[one][order], bucket[order]

    def _same(self, first: np.ndarray, length: np.ndarray, one: np.ndarray, at: np.ndarray) -> bool:
        """Whether every piece equals the one that stands for it."""
        step = 1 << 17
        for k in range(0, len(first), step):
            n, its = length[k : k + step], one[at[k : k + step]]
            if not np.array_equal(n, length[its]) or not np.array_equal(gathered(self.data, first[k : k + step], n), gathered(self.data, first[its], n)):
                return False
        return True

    def by_bucket(self):
        """(bucket, first, last): the numbers of each bucket's words."""
        edges = [0, *(np.flatnonzero(np.diff(self.bucket)) + 1).tolist(), len(self.bucket)]
        return [(int(self.bucket[a]), a, b) for a, b in zip(edges, edges[1:]) if a < b]

    def packed(self, a: int, b: int) -> bytes:
        """The words from number a to b, as ``_unpacked`` reads them."""
        import zstandard

        body = gathered(self.data, self.first[a:b], self.length[a:b])
        return zstandard.ZstdCompressor(level=1).compress(struct.pack("<I", b - a) + self.length[a:b].astype(np.uint32).tobytes() + body.tobytes())


def _unpacked(data: bytes) -> list[bytes]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(data)
    (n,) = struct.unpack_from("<I", data)
    ends = np.cumsum(np.frombuffer(data, np.uint32, n, 4)).tolist()
    body = data[4 + 4 * n :]
    return [body[a:b] for a, b in zip([0, *ends], ends)]


def _packed_ids(ids: list[list[int]]) -> bytes:
    import zstandard

    lengths = np.fromiter(map(len, ids), np.uint32, len(ids))
    flat = np.fromiter((i for x in ids for i in x), np.uint32, int(lengths.sum()))
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<I", len(ids)) + lengths.tobytes() + flat.tobytes())


def _unpacked_ids(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each word has, and all of them on end."""
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(data)
    (n,) = struct.unpack_from("<I", data)
    return np.frombuffer(data, np.uint32, n, 4).astype(np.int64), np.frombuffer(data, np.uint32, -1, 4 + 4 * n)


def _texts(payloads):
    frame = unpacked(payloads)
    return frame, ["" if not isinstance(t, str) else t for t in frame["text"]]


def encoded(
    docs: DataFrame, path: str, keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, with_ids: bool = False
) -> DataFrame:
    """``keep`` columns (doc_id alone by default), n_tokens, digests and, if wanted, ids and decoded text.

    One row out per row of ``docs``; a null or empty text has no tokens; whole texts are encoded
    whatever their length; repeated rows repeat; other columns are ignored; an empty table gives
    an empty table.
    """
    keep = keep or ["doc_id"]
    content = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    total = text_bytes(docs)
    blocks, buckets = pieces_for(total, block_bytes), pieces_for(total, bucket_bytes)
    source = docs.select(*keep, "text")
    payloads = packed_blocks(source, source.columns, blocks).repartition(blocks, "block")

    def ask(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        words = Words(splitter(content.value), _texts(frame["payload"])[1], buckets)
        rows = [(key[0], bucket, words.packed(a, b)) for bucket, a, b in words.by_bucket()]
        words = None
        give_back()
        return pd.DataFrame(rows, columns=["block", "bucket", "words"])

    asked = payloads.groupBy("block").applyInPandas(ask, "block long, bucket long, words binary")

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        """Encodes each distinct word of a bucket once and answers every block that asked."""
        requests = [_unpacked(w) for w in frame["words"]]
        distinct = sorted({w for r in requests for w in r})
        known: dict[bytes, list[int]] = {}
        encode = encoder(content.value)
        for at in range(0, len(distinct), 20_000):
            part = distinct[at : at + 20_000]
            known.update(zip(part, encode.ids([w.decode("utf-8", "surrogatepass") for w in part])))
        ids = [_packed_ids([known[w] for w in r]) for r in requests]
        requests = distinct = known = None
        give_back()
        return pd.DataFrame({"block": frame["block"], "bucket": frame["bucket"], "ids": ids})

    answered = asked.groupBy("bucket").applyInPandas(answer, "block long, bucket long, ids binary")

    def join(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        whole, texts = _texts(left["payload"])
        # the block's words again, so that only ids had to travel back
        words = Words(splitter(content.value), texts, buckets)
        whole, texts = whole[keep].reset_index(drop=True), None
        words.data = words.first = words.length = None
        replies = dict(zip(right["bucket"], right["ids"]))
        told = [_unpacked_ids(replies[bucket]) for bucket, _, _ in words.by_bucket()]
        count = np.concatenate([np.zeros(0, np.int64), *(n for n, _ in told)])
        ids = np.concatenate([np.zeros(0, np.uint32), *(i for _, i in told)])
        lines, decoded = (s.joined(ids, count) for s in spelled(content.value))
        first = np.cumsum(count) - count
        ends = np.concatenate([[0], np.cumsum(words.many)])
        rows, low = [], 0
        while low < len(words.many):
            # as many texts at a time as have RUN_WORDS words; one at least
            high = max(low + 1, int(np.searchsorted(ends, ends[low] + RUN_WORDS, "right")) - 1)
            at, many = words.at[ends[low] : ends[high]], words.many[low:high]
            tokens = np.diff(np.concatenate([[0], np.cumsum(count[at])])[np.cumsum(many)], prepend=0)
            for n, line, text in zip(tokens.tolist(), lines.joined(at, many).strings(), decoded.joined(at, many).strings()):
                text = text.decode("utf-8", "replace")
                rows.append([n, hashlib.sha256(line[:-1]).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), *([text] if with_ids else [])])
            if with_ids:
                listed = np.split(gathered(ids, first[at], count[at]), np.cumsum(tokens)[:-1])
                rows[low:] = [[*row[:3], i.tolist(), row[3]] for row, i in zip(rows[low:], listed)]
            low = high
        words = told = count = ids = lines = decoded = None
        give_back()
        names = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])]
        return pd.concat([whole, pd.DataFrame(rows, columns=names, index=whole.index)], axis=1)

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{kinds}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    return payloads.groupBy("block").cogroup(answered.groupBy("block")).applyInPandas(join, schema)
