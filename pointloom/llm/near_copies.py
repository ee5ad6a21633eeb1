"""Near copies by Jaccard similarity of five-word shingles: operator 2 first, prefix filtering for what its radius misses.

Two documents link if their sets of ``WORDS``-word shingles have a Jaccard similarity of 4/5 or more;
a class is what links connect.  Words are those of ``simhash``: split at ASCII white space, lower case.

Close copies.  Operator 2 (``simhash.near_duplicates``) runs over every document, its fingerprints taken of
``WORDS``-word shingles.  Neighbours in its classes are verified, and what they connect is settled.  At similarity
4/5 fingerprints differ in about ten bits, beyond its radius of three; the search below finds the links left.

Candidate search.  Shingles have one global order: those of several documents in a fixed share
of the input last, by their count there, the others by hash.  A partner of a set of n shingles shares
at least ceil(4n/5) of them, so two partners share a shingle among the first n - ceil(4n/5) + 1 of
each.  These prefixes are dealt by shingle; rows of one shingle form a run in order of size, and
a pair stays if its sizes and its places in both prefixes leave room for the similarity.  The
sample decides only how long runs get, never what is found.

Runs of up to ``SMALL`` rows give all their pairs; those that operator 2 has settled are not verified again.  A longer run gives neighbours first; once these are
verified and connected, it gives a spanning forest and then all pairs of the classes still different whose parity bitmaps differ in no
more bits than the sets may differ in shingles (a bound that loses nothing).  So a large class of near
copies costs rows in proportion to its size.  Every pair is verified on the whole sets.

Edge cases: null and empty texts (and those of white space alone) count as one equal shingle; a
text of fewer words than a shingle is one shingle; rows without doc_id are no candidates and stay; rows
that share an id stand and go together; an empty table gives an empty result.  A long run is read by
one task, with about 200 bytes a row held.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm import simhash
from pointloom.llm.common import map_rows, materialise, without_ids
from pointloom.llm.simhash import SEED, components

WORDS = 5
#: Rows of a run that gives all its pairs at once.
SMALL = 32
#: One document in so many is sampled; shingles of more than two of these count as frequent, so many at most.
SAMPLE = 4
MOST_FREQUENT = 2_000_000
#: Links that one task reduces to a spanning forest.
LINKS_AT_ONCE = 50_000
#: Ids of candidates that are broadcast at most.
MOST_BROADCAST = 500_000
#: 64-bit words of a parity bitmap.
BITMAP = 16


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of the distinct shingles of a whole text, in increasing order."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    n = max(1, len(tokens) - words + 1)
    starts, last = ((ends - lengths)[:n].tolist(), ends[words - 1 :].tolist()) if len(tokens) >= words else ([0], [len(joined)])
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[i:j], SEED) for i, j in zip(starts, last)), np.uint64, n))


def prefix(h: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first n - ceil(4n/5) + 1 shingles of a set in the global order."""
    n = len(h)
    most = n - (4 * n + 4) // 5 + 1
    if not len(frequent):
        return h[:most]
    at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
    known = frequent[at] == h
    rare = h[~known][:most]
    if len(rare) == most:
        return rare
    rest = h[known]
    return np.concatenate([rare, rest[np.lexsort((rest, counts[at][known]))][: most - len(rare)]])


def frequent_shingles(docs: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in increasing order, counts) of the shingles of several documents in a sample."""

    def one(batch: pa.RecordBatch) -> dict:
        got = [shingles(t) for t in batch.column(0).to_pylist()]
        h, n = np.unique(np.concatenate(got), return_counts=True)
        return {"h": pa.array(h.view(np.int64)), "n": pa.array(n.astype(np.int64))}

    some = docs.filter(F.pmod(F.xxhash64("node"), F.lit(sample)) == 0).select("text")
    counted = map_rows(some, "h long, n long", one, [pa.int64(), pa.int64()]).groupBy("h").agg(F.sum("n").alias("n")).filter("n > 2")
    counted = materialise(counted, "frequent-shingles")
    least, held = 3, 0
    for r in counted.groupBy(F.least("n", F.lit(10_000)).alias("n")).agg(F.count(F.lit(1)).alias("shingles")).orderBy(F.desc("n")).collect():
        held += r["shingles"]
        if held > MOST_FREQUENT:
            least = r["n"] + 1
            break
    got = counted.filter(F.col("n") >= least).toArrow()
    h, n = got.column("h").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def prefix_rows(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """key, node, size (of the set), pos (of the key in the set's order) of every prefix shingle."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def one(batch: pa.RecordBatch) -> dict:
        sets = [shingles(t) for t in batch.column(1).to_pylist()]
        first = [prefix(h, *shared.value) for h in sets]
        n = [len(f) for f in first]
        return {
            "key": pa.array(np.concatenate(first).view(np.int64)), "node": pa.array(np.repeat(batch.column(0).to_numpy(), n)),
            "size": pa.array(np.repeat(np.array([len(h) for h in sets], np.int32), n)), "pos": pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in n])),
        }

    return map_rows(docs.select("node", "text"), "key long, node long, size int, pos int", one, [pa.int64(), pa.int64(), pa.int32(), pa.int32()])


def possible(n, i, m, j):
    """Whether sets of n and m shingles that first meet at places i and j can be similar enough."""
    n, m = np.int64(n), m.astype(np.int64)
    return (5 * np.minimum(n, m) >= 4 * np.maximum(n, m)) & (9 * np.minimum(n - i, m - j) >= 4 * (n + m))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """Columns of whole runs (rows of equal first column), a few at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        key = batch.column(0).to_numpy()
        if key[-1] == held[0].column(0)[0].as_py():
            continue
        cut = int(np.searchsorted(key, key[-1]))
        yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)]).combine_chunks().columns
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().columns


def first_pairs(rows: DataFrame, small: int = SMALL) -> DataFrame:
    """Pairs (a, b, key null) of short runs and of neighbours in long ones; rows (a, key, size, pos; b null) of the long."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _runs(batches):
            key, node, size, pos = (c.to_numpy() for c in columns)
            starts = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
            each = np.diff(np.append(starts, len(key)))
            length = np.repeat(each, each)
            pairs = []
            for apart in range(1, min(small, int(each.max()))):
                i = np.nonzero((key[:-apart] == key[apart:]) & ((length[:-apart] <= small) | (apart == 1)))[0]
                j = i + apart
                i, j = (x[possible(size[i].astype(np.int64), pos[i], size[j], pos[j]) & (node[i] != node[j])] for x in (i, j))
                pairs.append(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])], axis=1))
            both = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
            long = length > small
            n, m = len(both), int(long.sum())
            if n + m:
                null = lambda k, kind: pa.nulls(k, kind)
                join = lambda a, b: pa.concat_arrays([a, b])
                yield pa.record_batch(
                    [
                        join(pa.array(both[:, 0]), pa.array(node[long])), join(pa.array(both[:, 1]), null(m, pa.int64())), join(null(n, pa.int64()), pa.array(key[long])),
                        join(null(n, pa.int32()), pa.array(size[long])), join(null(n, pa.int32()), pa.array(pos[long])),
                    ],
                    names=["a", "b", "key", "size", "pos"],
                )

    return rows.repartition(F.col("key")).sortWithinPartitions("key", "size", "node").mapInArrow(meet, "a long, b long, key long, size int, pos int")


def close_pairs(docs: DataFrame) -> DataFrame:
    """Pairs (a, b) of neighbours in the classes of operator 2, enough to connect each class."""

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None, None)
        for batch in batches:
            if not batch.num_rows:
                continue
            label, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            before = label.copy()  # a task's first row of a class meets the smallest doc_id of the class
            same = label[1:] == label[:-1]
            before[1:][same] = node[:-1][same]
            if last[0] == label[0]:
                before[0] = last[1]
            last = (label[-1], node[-1])
            apart = before != node
            yield pa.record_batch([pa.array(np.minimum(before, node)[apart]), pa.array(np.maximum(before, node)[apart])], names=["a", "b"])

    found = simhash.near_duplicates(docs.select(F.col("node").alias("doc_id"), "text"), WORDS)
    order = ["component_id", "fingerprint", "doc_id"]  # a large class is dealt to several tasks
    rows = materialise(found, "close-classes").repartitionByRange(*order).sortWithinPartitions(*order)
    return rows.select("component_id", "doc_id").mapInArrow(neighbours, "a long, b long").distinct()


def unsettled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) of different classes."""
    few = labels.count() <= MOST_BROADCAST
    for end in ("a", "b"):
        told = labels.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}"))
        pairs = pairs.join(F.broadcast(told) if few else told, end, "left")
    return pairs.filter(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b")


def shingle_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, h (the whole set) and bits (its parity bitmap) of the documents in ``nodes``."""
    few = nodes.count() <= MOST_BROADCAST
    rows = docs.join(F.broadcast(nodes) if few else nodes, "node", "left_semi")

    def one(batch: pa.RecordBatch) -> dict:
        sets = [shingles(t) for t in batch.column(1).to_pylist()]
        bits = [np.packbits(np.bincount((h % np.uint64(64 * BITMAP)).astype(np.int64), minlength=64 * BITMAP).astype(np.uint8) & 1).tobytes() for h in sets]
        return {"node": batch.column(0), "h": pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64())), "bits": pa.array(bits, pa.binary())}

    return map_rows(rows.select("node", "text"), "node long, h array<long>, bits binary", one, [pa.int64(), pa.list_(pa.int64()), pa.binary()])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of similarity 4/5 or more."""
    left = sets.select(F.col("node").alias("a"), F.col("h").alias("ha"))
    right = sets.select(F.col("node").alias("b"), F.col("h").alias("hb"))
    alike = 9 * F.size(F.array_intersect("ha", "hb")) >= 4 * (F.size("ha") + F.size("hb"))
    return pairs.join(left, "a").join(right, "b").filter(alike).select("a", "b").distinct()


def forest(links: DataFrame) -> DataFrame:
    """Links (a, b) that connect what ``links`` connect, fewer than nodes in each task."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = up[y]
                x = y
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                up[max(a, b)] = min(a, b)
        ends = [(root(x), x) for x in list(up)]
        both = np.array([e for e in ends if e[0] != e[1]], np.int64).reshape(-1, 2)
        yield pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    return links.coalesce(links.count() // LINKS_AT_ONCE + 1).mapInArrow(reduce, "a long, b long")


def later_pairs(rows: DataFrame, spanning: bool) -> DataFrame:
    """Pairs (a, b) of different classes in long runs, from (key, node, size, pos, label, bits).

    With ``spanning`` only those that would connect each run if all were verified.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _runs(batches):
            key, node, size, pos, label = (c.to_numpy().copy() for c in columns[:5])
            bits = np.frombuffer(b"".join(columns[5].to_pylist()), np.uint64).reshape(-1, BITMAP)
            starts = np.append(np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0], len(key))
            for low, high in zip(starts[:-1], starts[1:]):
                if (label[low:high] == label[low]).all():
                    continue
                ends = np.searchsorted(4 * size[low:high].astype(np.int64), 5 * size[low:high].astype(np.int64), "right") + low
                for i in range(low, high):
                    j = np.arange(i + 1, ends[i - low])
                    j = j[(label[j] != label[i]) & possible(size[i], pos[i], size[j], pos[j])]
                    j = j[9 * np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64) <= size[j].astype(np.int64) + size[i]]
                    if spanning and len(j):
                        met, at = np.unique(label[j], return_index=True)
                        j = j[at]
                        label[low:high][np.isin(label[low:high], met)] = label[i]
                    if len(j):
                        yield pa.record_batch([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], names=["a", "b"])

    runs = rows.select("key", "node", "size", "pos", "label", "bits").repartition(F.col("key")).sortWithinPartitions("key", "size", "node")
    return runs.mapInArrow(meet, "a long, b long").distinct()


def classes(docs: DataFrame, small: int = SMALL, sample: int = SAMPLE) -> DataFrame:
    """(node, label): the smallest doc_id of the class, for every doc_id that links to another."""
    named = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text")).filter("node is not null")
    close = materialise(close_pairs(named), "close-pairs")
    found = materialise(first_pairs(prefix_rows(named, frequent_shingles(named, sample)), small), "prefix-pairs")
    pairs = materialise(found.filter("b is not null").select("a", "b").distinct(), "near-pairs")
    long = found.filter("b is null").select(F.col("a").alias("node"), "key", "size", "pos")
    both = close.union(pairs)
    nodes = materialise(both.select(F.col("a").alias("node")).union(both.select("b")).union(long.select("node")).distinct(), "near-nodes")
    sets = materialise(shingle_sets(named, nodes), "shingle-sets")
    links = materialise(verified(close, sets), "close-links")
    labels = components(forest(links))
    links = materialise(links.union(verified(unsettled(pairs, labels), sets)), "near-links")
    labels = components(forest(links))
    if long.isEmpty():
        return labels
    for spanning in (True, False):  # what a spanning round has connected need not be compared; the last round leaves out nothing else
        told = long.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        more = materialise(later_pairs(told.join(sets.select("node", "bits"), "node"), spanning), "near-pairs")
        if more.isEmpty():
            return labels
        links = materialise(links.union(verified(more, sets)), "near-links")
        labels = components(forest(links))
    return labels


def kept_documents(docs: DataFrame, small: int = SMALL, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that are first of their class (rows without doc_id stay), all columns."""
    return without_ids(docs, classes(docs, small, sample).filter("node <> label").select("node"), "near-copies")
