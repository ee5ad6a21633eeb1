"""SimHash near-duplicates found through Golay-code fuzzy hashing.

Fingerprints: 64-bit majority of the XXH64 values of word shingles.  Two fingerprints link at
``RADIUS`` = 3 or fewer differing bits, and a class is what links connect.

Candidate search.  A fingerprint is cut into three segments (22, 21, 21 bits), each padded with
zeros to a word of the perfect (23, 12) Golay code, whose decoding maps every word to the one
codeword within three errors, a 12-bit index.  Three errors over three segments leave, by the
pigeonhole principle, one of two cases:

* some segment is equal and another has at most one error: key = the equal segment's bits
  with the other's index (33 bits and more);
* every segment has exactly one error: key = the three indices (36 bits).

A row is *indexed* under the indices of its own segments and *probes* with the indices of
every word at most one error away (six indices or one).  If v's segment is at most one bit
from u's, u's own index is among v's, so no link is lost.  Rows of equal key meet in one sorted
run, links are verified by counting differing bits, and a run yields only the links of a
spanning forest (a run's pairs are never all written out).  Distinct fingerprints alone take
part, each under the smallest doc_id that has it; copies join afterwards.

Classes are then connected components by alternating large-star and small-star steps over the
written links; nothing is collected to the driver but counts.

Edge cases: null and empty texts (and those of white space alone) have fingerprint zero and
link like any other; a text of fewer words than a shingle is one shingle; repeated rows each
get their row; rows without doc_id take part in no class but that of their fingerprint, and if
only such rows have it, component_id is null; an empty table gives an empty result; other
columns are ignored by ``near_duplicates`` and kept by ``kept_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import map_rows, materialise

SHINGLE_WORDS = 3
RADIUS = 3
SEED = 42
#: Offset and width of the segments in bits.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the (23, 12) Golay code.
GENERATOR = 0xC75
#: Shingles whose bits are added up at once; bounds memory on very long texts.
SHINGLES_AT_ONCE = 65_536


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The unsigned 64-bit fingerprint of a whole text (0 if it has no word)."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(tokens) - words + 1)
    last = ends[words - 1 :] if len(tokens) >= words else ends[-1:]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, SHINGLES_AT_ONCE):
        a, b = starts[at : min(n, at + SHINGLES_AT_ONCE)].tolist(), last[at : at + SHINGLES_AT_ONCE].tolist()
        h = np.fromiter([digest(joined[i:j], SEED) for i, j in zip(a, b)], np.uint64, len(a))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""

    def one(batch: pa.RecordBatch) -> dict:
        values = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64)
        return {"doc_id": batch.column(0), "fp": pa.array(values.view(np.int64))}

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "doc_id long, fp long", one, [pa.int64(), pa.int64()])


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """(index of each 23-bit word's nearest codeword, codeword of each index), by coset leaders."""
    message = np.arange(1 << 12, dtype=np.uint32)
    word = message << 11
    rest = word.copy()
    for bit in range(22, 10, -1):
        rest = np.where((rest >> bit) & 1, rest ^ np.uint32(GENERATOR << (bit - 11)), rest)
    codewords = word | rest
    leaders = [0] + [1 << i for i in range(23)] + [1 << i | 1 << j for i in range(23) for j in range(i)] + [1 << i | 1 << j | 1 << k for i in range(23) for j in range(i) for k in range(j)]
    table = np.zeros(1 << 23, np.uint16)
    for error in leaders:
        table[codewords ^ np.uint32(error)] = message
    return table, codewords


_GOLAY: list[np.ndarray] = []


def nearest(words: np.ndarray) -> np.ndarray:
    if not _GOLAY:
        _GOLAY.append(golay_tables()[0])
    return _GOLAY[0][words]


def near_indices(segment: np.ndarray, width: int) -> np.ndarray:
    """(n, 6) indices reached from each word by at most one error, -1 where there are fewer."""
    flips = np.concatenate([[0], 1 << np.arange(width)]).astype(np.uint32)
    reached = np.sort(nearest(segment[:, None] ^ flips[None, :]).astype(np.int32), axis=1)
    first = np.ones(reached.shape, bool)
    first[:, 1:] = reached[:, 1:] != reached[:, :-1]
    out = np.full((len(segment), 6), -1, np.int32)
    rank = np.cumsum(first, axis=1) - 1
    row, column = np.nonzero(first)
    out[row, rank[row, column]] = reached[row, column]
    return out


def _mix(a: np.ndarray, b: np.ndarray, tag: int) -> np.ndarray:
    """A 62-bit key from two numbers below 2**24 and a tag below 2**4, without loss."""
    return (np.int64(tag) << 48) | (a.astype(np.int64) << 24) | b.astype(np.int64)


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position in fp, key, whether it is an index row) of all index and probe keys."""
    segments = [((fp >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.uint32) for at, width in SEGMENTS]
    own = [nearest(s).astype(np.int32) for s in segments]
    near = [near_indices(s, width) for s, (_, width) in zip(segments, SEGMENTS)]
    rows = np.arange(len(fp))
    out: list[tuple[np.ndarray, np.ndarray, bool]] = []
    for i in range(3):
        for j in range(3):
            if i != j:
                tag = 3 * i + j
                out.append((rows, _mix(segments[i], own[j], tag), True))
                at, which = np.nonzero((near[j] >= 0) & (near[j] != own[j][:, None]))
                out.append((at, _mix(segments[i][at], near[j][at, which], tag), False))
    out.append((rows, _mix(own[0], own[1] << 12 | own[2], 9), True))
    valid = (near[0] >= 0)[:, :, None, None] & (near[1] >= 0)[:, None, :, None] & (near[2] >= 0)[:, None, None, :]
    at, a, b, c = np.nonzero(valid)
    x, y, z = near[0][at, a], near[1][at, b], near[2][at, c]
    other = (x != own[0][at]) | (y != own[1][at]) | (z != own[2][at])
    out.append((at[other], _mix(x[other], y[other] << 12 | z[other], 9), False))
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out]), np.concatenate([np.full(len(o[0]), o[2]) for o in out])


def _run_links(fp: np.ndarray, node: np.ndarray, indexed: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of the rows of one key; each pass settles all links of one row.

    Memory is linear in the run.  Rows already in the class of the present row are skipped, so
    a dense run takes few passes.
    """
    order = np.argsort(fp, kind="stable")
    fp, node, indexed = fp[order], node[order], indexed[order]
    first = np.ones(len(fp), bool)
    first[1:] = fp[1:] != fp[:-1]
    starts = np.nonzero(first)[0]
    indexed = np.logical_or.reduceat(indexed, starts)
    fp, node = fp[starts], node[starts]
    if len(fp) < 2 or not indexed.any():
        return []
    label = np.arange(len(fp))
    links = []
    for at in np.nonzero(indexed)[0]:
        apart = np.nonzero(label != label[at])[0]
        if not len(apart):
            break
        near = apart[np.bitwise_count(fp[apart] ^ fp[at]) <= RADIUS]
        for other in near:
            if label[other] != label[at]:
                links.append((int(node[at]), int(node[other])))
                label[label == label[other]] = label[at]
    return links


def links_of(distinct: DataFrame) -> DataFrame:
    """(a, b) links between the nodes of ``distinct`` (node, fp), enough to connect every class."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                node, fp = part.column(0).to_numpy(), part.column(1).to_numpy().view(np.uint64)
                at, key, indexed = keys(fp)
                yield pa.record_batch([pa.array(key), pa.array(fp[at].view(np.int64)), pa.array(np.where(indexed, node[at], -1 - node[at]))], names=["key", "fp", "node"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def settle(key, fp, node):
            first = np.ones(len(key), bool)
            first[1:] = key[1:] != key[:-1]
            starts = np.append(np.nonzero(first)[0], len(key))
            size = np.diff(starts)
            pair = starts[:-1][size == 2]  # by far the most runs: settled at once
            u, v = node[pair], node[pair + 1]
            near = (np.bitwise_count((fp[pair] ^ fp[pair + 1]).view(np.uint64)) <= RADIUS) & ((u >= 0) | (v >= 0))
            u, v = np.where(u < 0, -1 - u, u)[near], np.where(v < 0, -1 - v, v)[near]
            links = list(zip(u[u != v].tolist(), v[u != v].tolist()))
            for k in np.nonzero(size > 2)[0]:
                a, b = starts[k], starts[k + 1]
                coded = node[a:b]
                links += _run_links(fp[a:b].view(np.uint64), np.where(coded < 0, -1 - coded, coded), coded >= 0)
            if links:
                both = np.array(sorted(set(links)), np.int64)
                yield pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(tuple(batch.column(i).to_numpy() for i in range(3)))
            if held[-1][0][-1] == held[0][0][0]:
                continue  # one key still: its rows come together, eight bytes each
            key, fp, node = (np.concatenate([h[i] for h in held]) for i in range(3))
            cut = np.searchsorted(key, key[-1])
            yield from settle(key[:cut], fp[:cut], node[:cut])
            held = [(key[cut:], fp[cut:], node[cut:])]
        if held:
            yield from settle(*(np.concatenate([h[i] for h in held]) for i in range(3)))

    rows = distinct.select("node", "fp").mapInArrow(expand, "key long, fp long, node long")
    # An index row and a probe of the same key must meet; keys are sorted within a partition.
    runs = rows.repartition(F.col("key")).sortWithinPartitions("key")
    return runs.mapInArrow(meet, "a long, b long").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node reachable, for every node of ``links`` (a, b).

    Alternating large-star and small-star steps (logarithmically many in practice); each round is
    written to the shared folder, and only a count and a checksum come to the driver.
    """
    now, seen = materialise(links.select("a", "b").filter("a <> b").distinct(), "links"), None
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        now = materialise(small.filter("a <> b").distinct(), "links")
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components: no fixed point reached")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label"))


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id, one row per row of ``docs``."""
    rows = materialise(fingerprints(docs, words), "fingerprints")
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("node")), "distinct-fingerprints")
    # Negative ids would clash with the sign that marks probes: nodes are shifted by the least id.
    base = distinct.agg(F.least(F.min("node"), F.lit(0).cast("long"))).first()[0] or 0
    shifted = distinct.filter("node is not null").select((F.col("node") - F.lit(base)).alias("node"), "fp")
    labels = components(links_of(shifted)).select((F.col("node") + F.lit(base)).alias("node"), (F.col("label") + F.lit(base)).alias("label"))
    by_fp = distinct.join(labels, "node", "left").select("fp", F.coalesce("label", "node").alias("component_id"))
    return rows.join(by_fp, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are first of their class (rows without doc_id stay), all columns."""
    gone = near_duplicates(docs).filter("doc_id is not null and doc_id <> component_id").select(F.col("doc_id").alias("__loom_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__loom_gone"), "left_anti")
