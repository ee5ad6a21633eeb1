"""Repeated passages removed by longest-previous-factor arrays, keeping the first copy.

Texts are UTF-8 bytes.  A byte goes if a string of ``LENGTH`` bytes that covers it also starts in
a document with a smaller doc_id; strings are judged on the input.  One suffix array of a whole
corpus fits no machine, so the suffixes are dealt out such that all that can share ``LENGTH``
bytes meet:

1. *Anchors.*  Of the grams of ``GRAM`` bytes in each window of ``LENGTH`` bytes, the one of least
   hash (leftmost if equal) is the window's anchor; chance repeats of so long a gram are rare.  Equal windows have equal anchors at equal
   offsets, so anchors (about one in 14 bytes) stand for all windows.  Each task sends its
   anchors' hashes, packed, to buckets by hash; a hash met in several documents of one task
   is sent once, flagged, and its places are passed on beside the buckets, so a passage
   that a third of all documents share is a row per task, not per document.
2. *Repeated anchors* (hashes of two documents or more) go back to their documents, which cut the
   surroundings: every window that holds the anchor, at most ``LENGTH - GRAM`` bytes before and
   ``LENGTH`` from it on.  Of surroundings repeated in one shard only the first document's are sent.
3. *Suffix arrays.*  A bucket joins its surroundings in order of documents.  Suffixes that share ``LENGTH`` bytes stand at
   the same offset from their anchor, so the suffixes of each offset have a suffix array of their own: that of the anchors
   is sorted by words, each further offset's is induced from the one before by a stable sort of the byte put in front.
   From the common prefixes of neighbours and the previous and next smaller *positions* (by document, copies inside one document do not count)
   follows each suffix's longest previous factor, counted up to ``LENGTH``; where it reaches that, its bytes are marked.
4. *Hot anchors*, met ``hot_least`` times and in 1 of ``MOST_HOT`` of all bytes, would put that share of all surroundings into
   one bucket: the ends of a common passage differ in every document.  Their windows go, as bytes, to buckets by
   content instead, where their suffix array is sorted the same way.  There are at most ``MOST_HOT`` of them, and the table of
   their codes (eight bytes each) goes to every task.
5. Marks return to the documents and are joined; the text moves once (both returns use one exchange).

Buckets and shards are as many as the total bytes ask for (a prime near one for each ``BUCKET_BYTES``), so a
task's memory does not grow with the corpus.  With more than ``RANGES`` of them rows are dealt in two steps, to ranges of
buckets first and inside the ranges then, so the number of packets a task writes does not grow with the corpus either.
A row is known by its doc_id alone; only where ids repeat (counted first) a hash of the text, the *tag*, stands beside it.

Edge cases: null and empty texts have no bytes and give a row; rows with a null doc_id are
neither earlier nor later than any and keep all bytes; repeated rows are no earlier than each
other and give a row each; texts shorter than ``LENGTH`` keep all bytes; very long texts
are read in overlapping slices; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import materialise, text_or_empty

LENGTH = 50
GRAM = 24
BEFORE = LENGTH - GRAM
#: Bytes of text per bucket and per shard.
BUCKET_BYTES = 4 << 20
#: Bytes hashed at once, and bytes whose anchors are packed together.
SLICE_BYTES, FLUSH_BYTES = 1 << 20, 32 << 20
#: Pass-through buckets have numbers below zero, spread over so many.
SPREAD = 4096
#: Bytes of a hash sent beside its bucket.
HASH_BYTES = 3
#: An anchor is hot from so many places on, and from a place in so many bytes on: there are no more hot anchors than ``MOST_HOT``.
HOT_LEAST, MOST_HOT = 2000, 1 << 22
#: Buckets that one task deals to at once; beyond, they are dealt by ranges first.
RANGES = 8192

_BASE = 0x9E3779B97F4A7C15 | 1
_LOW = np.uint64((1 << 24) - 1)
_POWERS = np.array([pow(_BASE, GRAM - 1 - i, 1 << 64) for i in range(GRAM)], np.uint64)


# ---- longest previous factors --------------------------------------------------------------------


def suffix_words(rows: np.ndarray, at: int, which: np.ndarray) -> np.ndarray:
    """The ``LENGTH`` bytes from column ``at`` on of the rows ``which`` as words; the last two may overlap."""
    rows = rows.take(which, axis=0)  # whole rows first: they are copied at once
    full, n, width = LENGTH // 8, len(rows), rows.strides[0]
    words = np.empty((n, -(-LENGTH // 8)), np.uint64)
    words[:, :full] = np.ndarray((n, full), "<u8", rows, at, (width, 8))
    if LENGTH % 8:
        words[:, full] = np.ndarray(n, "<u8", rows, at + LENGTH - 8, (width,))
    return words


def common_prefixes(words: np.ndarray, length: int) -> np.ndarray:
    """Longest common prefix of each suffix with the one before it in suffix order, counted up to ``length`` bytes."""
    out = np.zeros(len(words), np.int16)
    if len(words) > 1:
        apart = words[1:] ^ words[:-1]
        out[1:] = length
        other = np.nonzero(apart.any(axis=1))[0]
        apart = apart[other]
        first = (apart != 0).argmax(axis=1)
        x = apart[np.arange(len(first)), first]
        low = np.frexp((x & (~x + np.uint64(1))).astype(np.float64))[1] - 1  # place of the lowest bit that differs
        out[1 + other] = np.minimum(8 * first, length - 8) + (low >> 3)
    return out


def nearest_smaller(values: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Index of the previous smaller value of each, not before ``least``; -1 where there is none.

    Neighbours are tried first; the rest step back by halving strides over tables of window minima.
    """
    n = len(values)
    at = np.arange(n)
    out = np.full(n, -1)
    near = at > least
    near[1:] &= values[:-1] < values[1:]
    out[near] = at[near] - 1
    rest = np.nonzero(~near & (at > least))[0]
    if not len(rest):
        return out
    minima = [np.concatenate([values[:1], values[:-1]])]  # over the window that ends just before each index
    while 2 << (len(minima) - 1) <= int((rest - least[rest]).max()):
        size, last = 1 << (len(minima) - 1), minima[-1]
        wider = last.copy()
        wider[size:] = np.minimum(last[size:], last[:-size])
        minima.append(wider)
    place, floor, own = rest.copy(), least[rest], values[rest]
    for k in range(len(minima) - 1, -1, -1):
        step = (place - floor >= 1 << k) & (minima[k][place] >= own)
        place[step] -= 1 << k
    found = place > floor
    out[rest[found]] = place[found] - 1
    return out


def longest_previous_factors(words: np.ndarray, document: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Longest previous factor of each suffix, given as ``words`` in suffix order with its document.

    It is the longer of the common prefixes with the previous and the next smaller document in suffix order,
    counted up to ``length``.  Of use is whether it reaches that: the search ends where the least common prefix
    passed is shorter, and the factor counts as 0 then.
    """
    reach = common_prefixes(words, length) >= length
    out = np.zeros(len(words), np.int16)
    inside = reach.copy()
    inside[:-1] |= reach[1:]
    inside = np.nonzero(inside)[0]  # the others share less with both neighbours, so with any
    if not len(inside):
        return out
    doc, joins = document[inside], reach[inside]
    at = np.arange(len(inside))
    before = nearest_smaller(doc, np.maximum.accumulate(np.where(joins, 0, at)))
    back = np.concatenate([joins[1:], [False]])[::-1]  # seen from the end, each joins the one behind it
    after = nearest_smaller(doc[::-1], np.maximum.accumulate(np.where(back, 0, at)))[::-1]
    out[inside[(before >= 0) | (after >= 0)]] = length
    return out


def padded(rows: np.ndarray) -> np.ndarray:
    """``rows`` with their width filled with zeros to whole words."""
    out = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    out[:, : rows.shape[1]] = rows
    return out


def in_order(rows: np.ndarray, at: int = 0, width: int | None = None) -> np.ndarray:
    """Order of the rows by the ``width`` bytes from column ``at`` on; equal ones stay in their order (of documents)."""
    part = padded(rows[:, at : rows.shape[1] if width is None else at + width])
    words = part.view(">u8").astype(np.uint64)
    return np.lexsort(tuple(words[:, i] for i in range(words.shape[1] - 1, -1, -1)))


def repeated_windows(rows: np.ndarray, before: np.ndarray, after: np.ndarray, document: np.ndarray, lead: int) -> Iterator[tuple[int, np.ndarray]]:
    """(offset before the anchor, rows whose suffix from there on is repeated) for every offset.

    ``rows``, in order of documents, are surroundings with the anchor in column ``lead``; of a row ``before`` bytes in front of
    the anchor and ``after`` from it on are text.
    """
    text, in_front = padded(rows), np.ascontiguousarray(rows[:, :lead].T)
    order = in_order(rows, lead, LENGTH)
    fewest, shortest = (int(c.min()) if len(c) else 0 for c in (before, after))
    for offset in range(lead + 1):
        if offset:  # induced: the suffixes one byte longer, by that byte and the order of the rest
            order = order if fewest >= offset else order[before[order] >= offset]
            order = order[np.argsort(in_front[lead - offset][order], kind="stable")]
        whole = order if shortest >= LENGTH - offset else order[after[order] >= LENGTH - offset]
        if len(whole) > 1:
            factor = longest_previous_factors(suffix_words(text, lead - offset, whole), document[whole])
            yield offset, whole[factor >= LENGTH]


def repeated_rows(rows: np.ndarray, document: np.ndarray) -> np.ndarray:
    """Whether each whole row stands in a smaller document too: its longest previous factor is all of it."""
    text, order = padded(rows), in_order(rows)
    out = np.zeros(len(rows), bool)
    out[order] = longest_previous_factors(text[order].view("<u8"), document[order], text.shape[1]) >= text.shape[1]
    return out


# ---- anchors -------------------------------------------------------------------------------------


def _scramble(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Scrambled polynomial hash of the gram at each position, by doubling and one joining step."""
    h, size, n = data.astype(np.uint64), 1, len(data) - GRAM + 1
    out, done = None, 0
    rest = GRAM
    while rest:
        if rest & 1:  # this power of two is part of the gram's length
            if out is None:
                out = h[:n].copy()
            else:
                out *= np.uint64(pow(_BASE, size, 1 << 64))
                out += h[done : done + n]
            done += size
        rest >>= 1
        if rest:
            h = h[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + h[size:]
            size *= 2
    return _scramble(out)


def hashes_at(grams: np.ndarray) -> np.ndarray:
    """The same hash of (n, GRAM) bytes."""
    return _scramble((grams.astype(np.uint64) * _POWERS).sum(axis=1, dtype=np.uint64))


def anchors(data: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of the marked window starts in ``data``."""
    h = gram_hashes(data)
    least = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while 2 * size <= BEFORE + 1:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = BEFORE + 1 - size
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    at = (least[windows[: len(least)]] & _LOW).astype(np.int64)
    if len(at):
        at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    return at, h[at]


def _pack(*columns: np.ndarray) -> bytes:
    """Columns with their types and shapes, byte plane by byte plane, compressed; read by ``_unpack``.

    The first column is stored as differences: rows are in its order.
    """
    head = ";".join(f"{c.dtype.str},{','.join(map(str, c.shape))}" for c in columns).encode()
    planes = []
    for i, c in enumerate(columns):
        c = np.ascontiguousarray(c if i else np.diff(c, prepend=c.dtype.type(0)))
        planes.append(c.tobytes() if c.itemsize == 1 or c.ndim > 1 else c.view(np.uint8).reshape(len(c), c.itemsize).T.tobytes())
    body = len(head).to_bytes(4, "little") + head + b"".join(planes)
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> list[np.ndarray]:
    body = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    n = int.from_bytes(body[:4], "little")
    at, out = 4 + n, []
    for i, part in enumerate(body[4 : 4 + n].decode().split(";")):
        kind, *shape = part.split(",")
        size, width = tuple(map(int, shape)), np.dtype(kind).itemsize
        count = int(np.prod(size))
        raw = np.frombuffer(body, np.uint8, count * width, at)
        plain = width == 1 or len(size) > 1
        c = raw.view(kind).reshape(size) if plain else np.ascontiguousarray(raw.reshape(width, count).T).view(kind).reshape(count)
        out.append(c if i else np.cumsum(c, dtype=c.dtype))
        at += count * width
    return out


def _gathered(blobs: list[bytes]) -> list[np.ndarray] | None:
    parts = [_unpack(b) for b in blobs]
    return [np.concatenate([p[i] for p in parts]) for i in range(len(parts[0]))] if parts else None


def _deal(number: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """(number, packed rows) for each value of ``number``; rows keep their order."""
    small = len(number) > 0 and 0 <= number.min() and number.max() < 1 << 16
    order = np.argsort(number.astype(np.uint16) if small else number, kind="stable")  # two bytes sort by radix
    number = number[order]
    cuts = np.append(np.nonzero(np.concatenate([[True], number[1:] != number[:-1]]))[0], len(number)) if len(number) else []
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield int(number[a]), _pack(*[c[order[a:b]] for c in columns])


def _spread(number: np.ndarray, columns: list[np.ndarray], numbers: int) -> list[tuple[int, bytes]]:
    """Packed rows by ``number`` (below ``numbers``), or by ranges of them with the number as first column."""
    if numbers <= RANGES:
        return list(_deal(number, columns))
    return list(_deal(number // -(-numbers // RANGES), [number, *columns]))


def _second_step(df: DataFrame, name: str, numbers: int) -> DataFrame:
    """Rows dealt by ranges, dealt on inside each range; numbers below zero pass through."""
    if numbers <= RANGES:
        return df

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        size = 0

        def flush() -> list[tuple[int, bytes]]:
            out = []
            for blobs in held.values():
                kinds: dict[int, list] = {}  # the range that holds the last surroundings holds windows of hot anchors too
                for parts in map(_unpack, blobs):
                    kinds.setdefault(len(parts), []).append(parts)
                for parts in kinds.values():
                    out += packets([np.concatenate(c) for c in zip(*parts)])
            held.clear()
            return out

        def packets(rows: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
            number, *columns = rows
            order = np.lexsort((columns[1], columns[0]))  # in order of documents, as each packet's first column must be
            return _deal(number[order], [c[order] for c in columns])

        for batch in batches:
            through = []
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if number < 0:
                    through.append((number, blob))
                else:
                    held.setdefault(number, []).append(blob)
                    size += len(blob)
            if through:
                yield _batch(through, name)
            if size >= FLUSH_BYTES // 4:
                yield _batch(flush(), name)
                size = 0
        if held:
            yield _batch(flush(), name)

    return df.repartition(name).sortWithinPartitions(name).mapInArrow(run, f"{name} long, data binary")


def _shard(doc: np.ndarray, tag: np.ndarray, shards: int) -> np.ndarray:
    return (doc % shards + tag % shards) % shards


def _batch(rows: list[tuple[int, bytes]], name: str) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=[name, "data"])


def _anchor_blobs(doc: np.ndarray, tag: np.ndarray, at: np.ndarray, h: np.ndarray, buckets: int, salt: int) -> list[tuple[int, bytes]]:
    """Packed anchors of one task's flush: by bucket, and the locally repeated ones beside the buckets.

    Of a hash, the bucket and ``HASH_BYTES`` more are kept: buckets grow with the corpus, so the
    share of chance repeats, which only cost a comparison later, does not.
    """
    if not len(h):
        return []
    # only rows whose hash occurs again need grouping; all others stay in reading order
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    again = np.zeros(len(h), bool)
    again[1:] |= same
    again[:-1] |= same
    again = order[again]
    send, count, passed = np.ones(len(h), bool), np.ones(len(h), np.uint32), np.zeros(0, np.int64)
    if len(again):
        value, owner = h[again], doc[again]
        starts = np.nonzero(np.concatenate([[True], value[1:] != value[:-1]]))[0]
        sizes = np.diff(np.append(starts, len(value)))
        several = np.minimum.reduceat(owner, starts) != np.maximum.reduceat(owner, starts)
        passed = np.sort(again[np.repeat(several, sizes)])
        send[passed] = False  # but for one row of each locally repeated hash, with how many it stands for
        send[again[starts[several]]] = True
        count[again[starts[several]]] = sizes[several]
    bucket, rest = _parts(h, buckets)
    pick = np.nonzero(send)[0]
    out = _spread(bucket[pick], [doc[pick], tag[pick], at[pick].astype(np.uint32), count[pick], rest[pick]], buckets)
    if len(passed):
        out.append((-1 - salt % SPREAD, _pack(doc[passed], tag[passed], at[passed].astype(np.uint32))))
    return out


def _scan(buckets: int, slice_bytes: int = SLICE_BYTES, flush_bytes: int = FLUSH_BYTES):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        piece: list[tuple[int, int, int, bytes]] = []
        piece_bytes = flush = 0

        def settle() -> None:
            nonlocal piece_bytes
            data = np.frombuffer(b"".join(p[3] for p in piece), np.uint8)
            windows = np.zeros(len(data), bool)
            starts = np.cumsum([0] + [len(p[3]) for p in piece])
            for i, p in enumerate(piece):
                windows[starts[i] : max(starts[i], starts[i + 1] - LENGTH + 1)] = True
            at, h = anchors(data, windows)
            which = np.searchsorted(starts, at, side="right") - 1
            doc, tag, offset = (np.array([p[i] for p in piece], np.int64) for i in range(3))
            held.append((doc[which], tag[which], at - starts[which] + offset[which], h))
            piece.clear()
            piece_bytes = 0

        for batch in batches:
            for doc, tag, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                raw = text.encode("utf-8", "surrogatepass")
                for offset in range(0, max(1, len(raw) - LENGTH + 1), slice_bytes):
                    part = raw[offset : offset + slice_bytes + LENGTH - 1]
                    if len(part) < LENGTH:
                        continue
                    piece.append((doc, tag, offset, part))
                    piece_bytes += len(part)
                    flush += len(part)
                    if piece_bytes >= slice_bytes:
                        settle()
                if flush >= flush_bytes:
                    if piece:
                        settle()
                    rows = _anchor_blobs(*(np.concatenate([x[i] for x in held]) for i in range(4)), buckets, doc)
                    yield _batch(rows, "bucket")
                    held.clear()
                    flush = 0
        if piece:
            settle()
        if held:
            rows = _anchor_blobs(*(np.concatenate([x[i] for x in held]) for i in range(4)), buckets, doc)
            yield _batch(rows, "bucket")

    return run


def _code(bucket: np.ndarray | int, rest: np.ndarray) -> np.ndarray:
    """What is kept of a hash, as one number: its bucket and the bytes beside it."""
    value = np.zeros((len(rest), 8), np.uint8)
    value[:, :HASH_BYTES] = rest
    return value.view(np.int64).reshape(-1) | (np.int64(1) * bucket << (8 * HASH_BYTES))


def _parts(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, bytes sent beside it) of hashes."""
    return (h % np.uint64(buckets)).astype(np.int64), (h // np.uint64(buckets)).view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]


def _repeated(shards: int, hot: float):
    """Bucket: places of hashes met in two documents or more, dealt by shard; hot hashes, as shard -1."""

    def run(table: pa.Table) -> pa.Table:
        bucket, blobs = table.column(0)[0].as_py(), table.column(1).to_pylist()
        codes = np.zeros(0, np.int64)
        if bucket < 0:
            doc, tag, at = _gathered(blobs)
        else:
            doc, tag, at, count, rest = _gathered(blobs)
            code = _code(bucket, rest)
            order = np.argsort(code, kind="stable")
            code, doc, tag, at, count = code[order], doc[order], tag[order], at[order], count[order]
            starts = np.nonzero(np.concatenate([[True], code[1:] != code[:-1]]))[0]
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(code))))
            codes = code[starts[np.add.reduceat(count.astype(np.int64), starts) >= hot]]
            shared = (np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)) | (np.maximum.reduceat(count, starts) > 1)
            take = shared[group] & (count == 1)  # the others were passed on already
            doc, tag, at = doc[take], tag[take], at[take]
        order = np.lexsort((at, tag, doc))
        doc, tag, at = doc[order], tag[order], at[order]
        rows = _spread(_shard(doc, tag, shards), [doc, tag, at], shards)
        if len(codes):
            rows.append((-1, _pack(codes)))
        return pa.Table.from_batches([_batch(rows, "shard")])

    return run


# ---- surroundings ----------------------------------------------------------------------------------


def _texts(left: pa.Table) -> tuple[list, list[int], list[bytes]]:
    return left.column("doc_id").to_pylist(), left.column("tag").to_pylist(), [t.encode("utf-8", "surrogatepass") for t in left.column("text").to_pylist()]


def _of_row(owner: np.ndarray, tags: np.ndarray, doc: int | None, tag: int) -> slice:
    """Where the entries of a row stand; ``owner`` is sorted, ``tags`` within each owner."""
    if doc is None:
        return slice(0, 0)
    a, b = np.searchsorted(owner, doc, "left"), np.searchsorted(owner, doc, "right")
    if a == b:
        return slice(0, 0)
    return slice(a + np.searchsorted(tags[a:b], tag, "left"), a + np.searchsorted(tags[a:b], tag, "right"))


def _surroundings(buckets: int, hot: Broadcast):
    """Shard: surroundings of its repeated anchors by bucket, windows of hot anchors by content, and marks
    of what is repeated inside the shard."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("bucket", pa.int64()), ("data", pa.binary())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        owner, tags, places = _gathered(right.column("data").to_pylist())
        order = np.lexsort((places, tags, owner))
        owner, tags, places = owner[order], tags[order], places[order].astype(np.int64)
        fresh = np.concatenate([[True], (owner[1:] != owner[:-1]) | (tags[1:] != tags[:-1]) | (places[1:] != places[:-1])])
        owner, tags, places = owner[fresh], tags[fresh], places[fresh]
        seen: set[tuple[int, int]] = set()
        parts, lengths, own, who = [], [], [], []
        for d, t, raw in zip(*_texts(left)):
            where = _of_row(owner, tags, d, t)
            if where.start == where.stop or (d, t) in seen:
                continue
            seen.add((d, t))
            own.append(np.arange(where.start, where.stop))
            who.append(np.full(where.stop - where.start, len(parts)))
            parts.append(bytes(BEFORE) + raw + bytes(LENGTH))
            lengths.append(len(raw))
        if not parts:
            return schema.empty_table()
        text, lengths, own, who = np.frombuffer(b"".join(parts), np.uint8), np.array(lengths), np.concatenate(own), np.concatenate(who)
        base = np.cumsum(lengths + BEFORE + LENGTH) - (lengths + BEFORE + LENGTH)
        order = np.argsort(own)  # in order of documents
        own, who = own[order], who[order]
        doc, tag, at = owner[own], tags[own], places[own]
        rows = np.lib.stride_tricks.sliding_window_view(text, BEFORE + LENGTH)[base[who] + at]
        h = np.concatenate([hashes_at(rows[i : i + 65536, BEFORE : BEFORE + GRAM]) for i in range(0, len(rows), 65536)])
        before, after = np.minimum(BEFORE, at), np.minimum(LENGTH, lengths[who] - at)
        out, marks = [], []

        def send(number: np.ndarray, pick: np.ndarray, doc, tag, at, *more: np.ndarray) -> None:
            out.extend(_spread(number[pick], [doc[pick], tag[pick], at[pick].astype(np.uint32), *(m[pick] for m in more)], 2 * buckets))

        common = np.isin(_code(*_parts(h, buckets)), hot.value)
        if common.any():
            p = np.nonzero(common)[0]
            start = at[p][:, None] + np.arange(-BEFORE, 1)
            fits = (start >= 0) & (start + LENGTH <= lengths[who[p]][:, None])
            one = np.unique(((who[p] << 40)[:, None] + start)[fits])  # a window that holds several hot anchors counts once
            of, start = one >> 40, one & ((1 << 40) - 1)
            first = np.zeros(len(parts), np.int64)
            first[who[::-1]] = np.arange(len(who))[::-1]
            row = first[of]  # some entry of each document, for its ids
            order = np.lexsort((start, tag[row], doc[row]))
            of, row, start = of[order], row[order], start[order]
            wd, wt = doc[row], tag[row]
            windows = np.lib.stride_tricks.sliding_window_view(text, LENGTH)[base[of] + BEFORE + start]
            later = repeated_rows(windows, wd)
            marks.append((wd[later], wt[later], start[later], start[later] + LENGTH))
            send(buckets + (_content(windows) % np.uint64(buckets)).astype(np.int64), np.nonzero(~later)[0], wd, wt, start, windows)
            doc, tag, at, before, after, rows, h = (c[~common] for c in (doc, tag, at, before, after, rows, h))
        before, after = before.astype(np.uint8), after.astype(np.uint8)
        later = repeated_rows(np.column_stack([rows, before, after]), doc)
        send((h % np.uint64(buckets)).astype(np.int64), np.nonzero(~later)[0], doc, tag, at, before, after, rows)
        gone = later & (before.astype(np.int64) + after >= LENGTH)
        marks.append((doc[gone], tag[gone], (at - before)[gone], (at + after)[gone]))
        joined = _joined(*(np.concatenate([m[i] for m in marks]) for i in range(4)))
        if len(joined[0]):
            out.append((-1 - int(joined[0][0]) % SPREAD, _pack(*joined)))
        return pa.Table.from_batches([_batch(out, "bucket")])

    return run


def _content(windows: np.ndarray) -> np.ndarray:
    """A hash of each row of ``LENGTH`` bytes, by which it is dealt."""
    words = suffix_words(np.ascontiguousarray(windows), 0, np.arange(len(windows)))
    h = np.zeros(len(windows), np.uint64)
    for i in range(words.shape[1]):
        h = _scramble(h * np.uint64(_BASE) + words[:, i])
    return h


def _marks(shards: int):
    """Bucket: (doc_id, tag, start, end) of repeated windows, dealt by shard."""

    def run(table: pa.Table) -> pa.Table:
        bucket, blobs = table.column(0)[0].as_py(), table.column(1).to_pylist()
        if bucket < 0:
            doc, tag, start, end = _gathered(blobs)
        else:
            doc, tag, at, *more = _gathered(blobs)
            if bucket >= shards:  # windows of hot anchors: the anchor's place does not matter
                rows, lead = more[0], 0
                before, after = np.zeros(len(doc), np.uint8), np.full(len(doc), LENGTH, np.uint8)
            else:
                (before, after, rows), lead = more, BEFORE
                several = _not_alone(hashes_at(rows[:, BEFORE : BEFORE + GRAM]))  # an anchor met once shares no window
                doc, tag, at, before, after, rows = (c[several] for c in (doc, tag, at, before, after, rows))
            order = np.lexsort((at, tag, doc))
            doc, tag, at, before, after, rows = (c[order] for c in (doc, tag, at.astype(np.int64), before, after, rows))
            found = [(doc[:0], tag[:0], at[:0], at[:0])]
            for offset, hit in repeated_windows(rows, before, after, doc, lead):
                found.append((doc[hit], tag[hit], at[hit] - offset, at[hit] - offset + LENGTH))
            doc, tag, start, end = (np.concatenate([f[i] for f in found]) for i in range(4))
        joined = _joined(doc, tag, start, end)
        return pa.Table.from_batches([_batch(_spread(_shard(joined[0], joined[1], shards), list(joined), shards), "shard")])

    return run


def _not_alone(values: np.ndarray) -> np.ndarray:
    order = np.argsort(values)
    same = values[order][1:] == values[order][:-1]
    out = np.zeros(len(values), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def _joined(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Maximal runs of the (overlapping or touching) stretches of each row, in order of row and place."""
    if not len(doc):
        return tuple(c.astype(np.int64) for c in (doc, tag, start, end))
    order = np.lexsort((end, start, tag, doc))
    doc, tag, start, end = (c[order].astype(np.int64) for c in (doc, tag, start, end))
    other = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])
    group = np.cumsum(np.concatenate([[0], other]))
    width = int(end.max()) + 2
    reach = np.maximum.accumulate(end + group * width) - group * width
    at = np.nonzero(np.concatenate([[True], other | (start[1:] > reach[:-1])]))[0]
    return doc[at], tag[at], start[at], np.maximum.reduceat(end, at)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


def _remove(left: pa.Table, right: pa.Table) -> pa.Table:
    docs, tags, texts = _texts(left)
    marks = _gathered(right.column("data").to_pylist()) if right.num_rows else None
    owner, own_tag, start, end = _joined(*marks) if marks else (np.zeros(0, np.int64),) * 4
    spans, kept = [], []
    for d, t, raw in zip(docs, tags, texts):
        where = _of_row(owner, own_tag, d, t)
        mine = list(zip(start[where].tolist(), end[where].tolist()))
        edges = [0, *(x for s in mine for x in s), len(raw)]
        spans.append([{"start": a, "end": b} for a, b in mine])
        kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
    return pa.Table.from_pydict({"doc_id": docs, "n_bytes": [len(t) for t in texts], "spans": spans, "kept": kept}, _OUT)


def _prime_from(n: int) -> int:
    """The least prime from ``n`` on: ids in strides still spread over all shards."""
    while n < 2 or any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def remove_repeats(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, hot_least: int = HOT_LEAST) -> DataFrame:
    """doc_id, n_bytes, spans (start, end of the removed runs, in bytes) and kept (the other bytes) of every row."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    total, count = plain.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)), F.count(F.lit(1))).first()
    parts = _prime_from(int(total // bucket_bytes) + 1)
    repeated = plain.groupBy("doc_id").count().filter("doc_id is not null and count > 1")
    rows = plain.withColumn("tag", F.lit(0).cast("long") if repeated.isEmpty() else F.xxhash64("text"))
    anchored = rows.filter("doc_id is not null").filter(F.octet_length("text") >= LENGTH).select("doc_id", "tag", "text").mapInArrow(_scan(parts), "bucket long, data binary")
    by_hash = _second_step(anchored, "bucket", parts)
    places = materialise(by_hash.groupBy("bucket").applyInArrow(_repeated(parts, max(hot_least, total / MOST_HOT)), "shard long, data binary"), "repeated-anchors")
    codes = [_unpack(r.data)[0] for r in places.filter("shard < 0").select("data").collect()]  # MOST_HOT at most
    hot = docs.sparkSession.sparkContext.broadcast(np.unique(np.concatenate([np.zeros(0, np.int64), *codes])))
    by_shard = _second_step(places.filter("shard >= 0"), "shard", parts)
    # rows without an id have no marks and can be anywhere
    shard = F.pmod(F.pmod(F.coalesce("doc_id", F.xxhash64("text")), F.lit(parts)) + F.pmod("tag", F.lit(parts)), F.lit(parts))
    sharded = rows.select("doc_id", "tag", "text", shard.cast("long").alias("shard"))
    around = sharded.groupBy("shard").cogroup(by_shard.groupBy("shard")).applyInArrow(_surroundings(parts, hot), "bucket long, data binary")
    by_bucket = _second_step(around, "bucket", 2 * parts)
    marks = _second_step(by_bucket.groupBy("bucket").applyInArrow(_marks(parts), "shard long, data binary"), "shard", parts)
    schema = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    return sharded.groupBy("shard").cogroup(marks.groupBy("shard")).applyInArrow(_remove, schema)


def digest(repeats: DataFrame) -> DataFrame:
    """The digest columns of ``remove_repeats``."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return repeats.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, row_number() OVER () AS row_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT row_id, doc_id, unnest(range(0, length(h) // 2 - 49)) AS p, h FROM d WHERE length(h) >= 100),
g AS (SELECT row_id, doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM w),
f AS (SELECT s, min(doc_id) AS first_id FROM g GROUP BY s),
m AS (SELECT g.row_id, g.p FROM g JOIN f ON g.s = f.s WHERE f.first_id < g.doc_id),
e AS (SELECT row_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY row_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM m),
r AS (SELECT row_id, p, sum(new) OVER (PARTITION BY row_id ORDER BY p) AS run FROM e),
i AS (SELECT row_id, run, min(p) AS a, max(p) + 50 AS b FROM r GROUP BY row_id, run),
k AS (SELECT row_id, a, b, coalesce(lag(b) OVER (PARTITION BY row_id ORDER BY a), 0) AS before FROM i),
t AS (SELECT k.row_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substr(d.h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM k JOIN d ON d.row_id = k.row_id GROUP BY k.row_id)
SELECT d.doc_id, length(d.h) // 2 AS n_bytes, CAST(coalesce(t.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(t.n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN t.row_id IS NULL THEN d.h ELSE concat(t.head, substr(d.h, 2 * t.last + 1)) END)) AS kept_sha256
FROM d LEFT JOIN t ON d.row_id = t.row_id
"""
