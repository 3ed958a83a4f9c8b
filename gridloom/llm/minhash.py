"""MinHash near-duplicate groups with tensored banding.

Operator 1.  Two small collections of T short minhash tuples each give T*T table keys, one for
every pair of a left and a right tuple, from 2*T*WIDTH minhashes instead of T*T*2*WIDTH.  At
similarity 0.8 a pair of documents shares no key with probability 2 * (1 - 0.8**5)**37, about
1e-6, and less above.

Equal sets are folded into one node first.  Nodes that share a left tuple are verified against
the tuple's leader on full sets and contracted, so a group of near copies is one component
before any key expands.  Keys are formed for nodes still apart from others with which they share
a left and a right tuple, one row per key and component.  Components that keys chain together are
at last compared on full sets, in blocks, save nodes of the largest component among themselves:
no candidate is left out, and no pair is a row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shelf, checkpointed, document_words, lowered, mix, sequence_hashes, slices, to_long

#: Words of a shingle, for pipelines; op1's contract fixes two.
SHINGLE = 5
#: Tuples of each collection, and minhashes of each tuple.
TUPLES, WIDTH = 37, 5
#: Similarity in per cent.
PERCENT = 80
#: Rounds of other leaders before keys are formed; more of them save comparisons, the result is the same.
ROUNDS = 1
#: Shingles of a block of nodes that one task compares with another block; it bounds a task's memory.
BLOCK = 1 << 20
#: So many ids at most are broadcast to pick their texts; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000

_CHUNK = 1024


def _multipliers(tuples: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    n = 2 * tuples * width
    return rng.integers(0, 1 << 32, n, np.uint64).astype(np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, np.uint64).astype(np.uint32)


def shingle_sets(texts: list[bytes], shingle: int):
    """The sorted distinct shingle hashes of each lower-cased text."""
    for words in document_words(texts):
        yield np.unique(sequence_hashes(words, shingle))


def signatures(docs: DataFrame, shingle: int, tuples: int, width: int) -> DataFrame:
    """(doc_id, at, n_shingles, digest, tuples) of each row: at names the row, tuples are 2 * tuples hashes, the left ones first."""


    def sign(batches):
        import pyarrow as pa
        import xxhash

        a, b = _multipliers(tuples, width)
        salt = mix(np.arange(1, 2 * tuples + 1, dtype=np.uint64))
        odd = mix(np.arange(101, 101 + width, dtype=np.uint64)) | np.uint64(1)
        for part in slices(batches):
            sizes, digests, keys = [], [], []
            for s in shingle_sets(lowered(part.column("text").to_pylist()), shingle):
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                if not len(s):
                    keys.append(None)
                    continue
                x = (s >> np.uint64(32)).astype(np.uint32)
                least = np.full(len(a), 0xFFFFFFFF, np.uint32)
                for at in range(0, len(x), _CHUNK):
                    np.minimum(least, (x[at : at + _CHUNK, None] * a + b).min(axis=0), out=least)
                keys.append(to_long(mix((least.astype(np.uint64).reshape(2 * tuples, width) * odd).sum(axis=1, dtype=np.uint64) ^ salt)))
            columns = [part.column("doc_id"), part.column("at"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "at", "n_shingles", "digest", "tuples"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", _row_name(), "text").mapInArrow(sign, f"doc_id {kind}, at long, n_shingles long, digest binary, tuples array<long>")


def _row_name():
    """A name for a row's doc_id and text together."""
    return F.xxhash64("doc_id", "text").alias("at")


def full_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(digest, items) of each text: all its shingle hashes and their digest."""


    def items(batches):
        import pyarrow as pa
        import xxhash

        for part in slices(batches):
            sets = list(shingle_sets(lowered(part.column("text").to_pylist()), shingle))
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([to_long(s) for s in sets], pa.list_(pa.int64()))], ["digest", "items"])

    return docs.select("text").mapInArrow(items, "digest binary, items array<long>")


def components(shelf: Shelf, edges: DataFrame) -> DataFrame:
    """(id, root) for every id in ``edges`` (a, b): root is the smallest id reachable.

    Alternates large-star and small-star steps; each is a grouped minimum and a join, and no
    vertex's neighbours are gathered.
    """
    edges = shelf.put(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _all_stars(edges):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: neighbours above a vertex move to its least neighbour
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a vertex and its neighbours below move to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        edges = shelf.put(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct())
    own = edges.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("root"))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).union(own)


def _all_stars(edges: DataFrame) -> bool:
    """Whether every upper end of ``edges`` (a, b), b below a, has one edge and is no edge's lower end; then lower ends are the roots."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.lit(1).alias("up")), F.struct(F.col("b").alias("id"), F.lit(0).alias("up")))).alias("e"))
    ends = ends.groupBy("e.id").agg(F.sum("e.up").alias("up"), F.min("e.up").alias("low"))
    return ends.agg(F.count(F.when(F.expr("up > 1 OR up = 1 AND low = 0"), 1))).first()[0] == 0


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text).

    Documents are linked when 100 * intersection >= percent * union of their shingle sets;
    component_id is the least doc_id of a component and kept marks that document.  A text
    without words, null or empty, has no shingles and is a component of its own.  Ids may be of
    any type that has an order; nodes are sets, so rows that share a doc_id may differ in text.  Rows
    without a doc_id link as others do; a component of such rows alone has no component_id, and
    kept marks one of them (repeats of it too).  Repeated rows repeat.  An empty table gives an empty
    table.  Other columns are ignored.  Options: those of ``grouped``.
    """
    component = F.col("first.doc_id")
    kept = F.coalesce(F.col("doc_id") == component, F.col("at") == F.col("first.at"))
    return grouped(docs, **options).select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def grouped(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, tuples: int = TUPLES, width: int = WIDTH, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """(doc_id, at, n_shingles, first) for each row: first (alone, doc_id, at) is the first row of its component."""
    with Shelf(docs.sparkSession, "minhash") as shelf:
        full = shelf.put(signatures(docs, shingle, tuples, width))
        own = F.struct(F.col("doc_id").isNull().alias("alone"), "doc_id", "at")
        nodes = shelf.put(
            full.where("digest IS NOT NULL").groupBy("digest").agg(F.min(own).alias("first"), F.min("at").alias("at"), F.first("tuples").alias("tuples"))
            .withColumn("id", F.monotonically_increasing_id())
        )
        roots = _linked(shelf, docs, nodes, shingle, percent, tuples, rounds, block)
        placed = nodes.select("digest", "first", "id").join(roots, "id", "left").select("digest", "first", F.coalesce("root", "id").alias("root"))
        named = placed.join(placed.groupBy("root").agg(F.min("first").alias("least")), "root").select("digest", "least")
        found = full.drop("tuples").join(named, "digest", "left").select("doc_id", "at", "n_shingles", F.coalesce("least", own).alias("first"))
        return checkpointed(found)


def _linked(shelf: Shelf, docs: DataFrame, nodes: DataFrame, shingle: int, percent: int, tuples: int, rounds: int, block: int) -> DataFrame:
    """(id, root) of the nodes that are linked to others."""
    rows = nodes.select("id", F.explode(F.slice("tuples", 1, tuples)).alias("h"))
    lead = rows.groupBy("h").agg(F.min("id").alias("leader"), F.max("id").alias("hi")).where("leader < hi").select("h", "leader")
    left = shelf.put(rows.join(lead, "h").select("h", "id", "leader"))
    sets = shelf.put(_sets_of(left.select("id").distinct(), docs, nodes, shingle))

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are linked on their full sets."""
        x = sets.select(F.col("id").alias("a"), F.col("items").alias("x"))
        y = sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
        # sizes first: a set under the share of the other's size can't reach the similarity
        near = F.lit(100) * F.least(F.size("x"), F.size("y")) >= F.lit(percent) * F.greatest(F.size("x"), F.size("y"))
        common = F.size(F.array_intersect("x", "y"))
        return (
            pairs.join(x, "a").join(y, "b").where(near)
            .select("a", "b", (F.size("x") + F.size("y")).cast("long").alias("n"), common.cast("long").alias("c"))
            .where(F.lit(100) * F.col("c") >= F.lit(percent) * (F.col("n") - F.col("c")))
            .select("a", "b")
        )

    stars = left.where("leader <> id").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    roots = components(shelf, verified(stars))

    def apart(rows: DataFrame) -> DataFrame:
        """Of rows (h, id, root), those of tuples whose nodes lie in several components."""
        several = rows.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("h")
        return shelf.put(rows.join(several, "h"))

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(roots, "id", "left").select("h", "id", F.coalesce("root", "id").alias("root"))

    def merged(more: DataFrame) -> DataFrame:
        """Roots after more links, which join components by their roots."""
        root_of = lambda c: roots.select(F.col("id").alias(c), F.col("root").alias(f"r{c}"))
        ends = more.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        moved = components(shelf, ends).select(F.col("id").alias("root"), F.col("root").alias("new"))
        # a node that had no link yet is a root of its own
        both = roots.join(moved, "root", "left").select("id", F.coalesce("new", "root").alias("root"))
        alone = moved.join(roots, moved["root"] == roots["id"], "left_anti").select(F.col("root").alias("id"), F.col("new").alias("root"))
        return shelf.put(both.union(alone))

    still = apart(placed(left.select("h", "id")))
    for turn in range(rounds):
        chosen = still.groupBy("h").agg(F.min_by(F.struct("id", "root"), F.xxhash64("id", F.lit(turn))).alias("p"))
        pairs = still.join(chosen, "h").where("p.root <> root").select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b")).distinct()
        more = shelf.put(verified(pairs))
        if not more.isEmpty():
            roots = merged(more)
            still = apart(placed(still.select("h", "id")))
    if not still.isEmpty():
        right = nodes.join(still.select("id").distinct(), "id", "left_semi").select("id", F.explode(F.slice("tuples", tuples + 1, tuples)).alias("h"))
        more = shelf.put(_links_in_blocks(shelf, _chained(shelf, still, apart(placed(right))), sets, percent, block))
        if not more.isEmpty():
            roots = merged(more)
    return roots


def _sets_of(wanted: DataFrame, docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(id, items): the full sets of the wanted nodes, each from the one row that names it."""
    rows = nodes.join(wanted, "id", "left_semi").select("id", "digest", "at")
    few = wanted.count() <= BROADCAST_IDS
    names = rows.select("at").distinct()
    texts = docs.select("text", _row_name()).join(F.broadcast(names) if few else names, "at", "left_semi")
    return rows.join(full_sets(texts, shingle).dropDuplicates(["digest"]), "digest").select("id", "items")


def _chained(shelf: Shelf, left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, root, group) of nodes whose components share table keys; a group is what keys chain together.

    A key is a left and a right tuple; one row stands for all nodes of a component that have it.
    """
    held = lambda rows, name: rows.groupBy("id", "root").agg(F.collect_set("h").alias(name))
    both = shelf.put(held(left, "l").join(held(right, "r").drop("root"), "id"))
    weight = both.groupBy("root").agg(F.count("*").alias("weight"))
    keyed = both.select("root", "l", F.explode("r").alias("r")).select("root", "r", F.explode("l").alias("l")).select(F.xxhash64("l", "r").alias("key"), "root").distinct()
    keyed = shelf.put(keyed.join(weight, "root"))
    # the largest component of a key is its hub, so that few edges chain its components
    hubs = keyed.groupBy("key").agg(F.max_by("root", "weight").alias("hub"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key", "hub")
    chains = keyed.join(hubs, "key").where("root <> hub").select(F.col("root").alias("a"), F.col("hub").alias("b")).distinct()
    group = components(shelf, chains).select(F.col("id").alias("root"), F.col("root").alias("group"))
    return both.select("id", "root").join(group, "root").join(weight, "root")


def _links_in_blocks(shelf: Shelf, rows: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links (a, b) that join the components of all linked nodes of a group; rows are (id, root, group, weight).

    Each group is cut into blocks of at most ``block`` shingles (a larger set is a block of its own): those of its
    largest component and those of the others.  Blocks meet in a task unless both are of the largest
    component, whose nodes are joined already.  A task looks the sets of one block up in an index of the other's
    and gives the links of a spanning forest alone.
    """
    main = rows.groupBy("group").agg(F.max_by("root", "weight").alias("main"))
    sized = rows.join(main, "group").join(sets.select("id", F.size("items").alias("n")), "id").select("id", "root", "group", (F.col("root") == F.col("main")).alias("joined"), "n")
    sized = shelf.put(sized)
    share = lambda c: F.greatest(F.ceil(F.sum(F.when(c, F.col("n")).otherwise(0)) / block), F.lit(1)).cast("int")
    counts = sized.groupBy("group").agg(share(F.col("joined")).alias("first"), share(~F.col("joined")).alias("rest"))
    number = F.when(F.col("joined"), F.pmod(F.xxhash64("id"), F.col("first"))).otherwise(F.col("first") + F.pmod(F.xxhash64("id"), F.col("rest")))
    numbered = sized.join(counts, "group").select("*", number.cast("int").alias("block"))
    met = numbered.select("*", F.explode(F.sequence(F.when(F.col("joined"), F.col("first")).otherwise(0), F.col("first") + F.col("rest") - 1)).alias("other"))
    met = met.select("group", "id", "root", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        block, ids, roots, items = frame["block"].to_numpy(), frame["id"].to_numpy(), frame["root"].to_numpy(), list(frame["items"])
        n = np.array([len(x) for x in items], np.int64)
        start = np.concatenate([[0], np.cumsum(n)])
        values, number = np.unique(np.concatenate(items), return_inverse=True)
        held = np.flatnonzero(block == block.min())
        owner = np.repeat(np.arange(len(held)), n[held])
        theirs = np.concatenate([number[start[k] : start[k + 1]] for k in held])
        order = np.argsort(theirs, kind="stable")
        owner, edge = owner[order], np.searchsorted(theirs[order], np.arange(len(values) + 1))
        parent = {r: r for r in roots.tolist()}

        def find(k):
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        out = []
        for q in np.flatnonzero(block == block.max()):
            mine = number[start[q] : start[q + 1]]
            a, many = edge[mine], edge[mine + 1] - edge[mine]
            where = np.repeat(a - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            common = np.bincount(owner[where], minlength=len(held))
            for k in held[100 * common >= percent * (n[q] + n[held] - common)]:
                x, y = find(int(roots[q])), find(int(roots[k]))
                if x != y:
                    parent[x] = y
                    out.append((int(ids[q]), int(ids[k])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return met.join(sets, "id").groupBy("group", "lo", "hi").applyInPandas(compare, "a long, b long")


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """One row of each group of near duplicates, with the columns of ``docs``.

    It is a row with the group's least doc_id, or without one if none has any.  Texts without words, null or
    empty, are near duplicates of nothing.  Rows that repeat both doc_id and text are one document; those with neither id nor
    words are all kept.  An empty table stays empty.  Clashing names of other columns do no harm.
    """
    rows = grouped(docs, **options)
    lost = rows.where("at <> first.at").select("at").distinct()
    again = rows.where("doc_id IS NOT NULL OR n_shingles > 0").groupBy("at").count().where("count > 1").select("at")
    named = docs.withColumn("_at_of_row", F.xxhash64("doc_id", "text"))
    here = lambda t: t.withColumnRenamed("at", "_at_of_row")
    kept = named.join(here(lost), "_at_of_row", "left_anti")
    once = kept.join(here(again), "_at_of_row", "left_anti")
    return once.unionByName(kept.join(here(again), "_at_of_row", "left_semi").dropDuplicates(["_at_of_row"])).select(*[f"`{c}`" for c in docs.columns])
