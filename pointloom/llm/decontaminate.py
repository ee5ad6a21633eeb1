"""Benchmark decontamination: pigeonhole pieces found exactly, then Myers' bit-parallel distance.

Texts and items are normalised alike (lower case, ASCII punctuation and white space to single
spaces, UTF-8).  An item of n bytes has an error budget k = floor(``ERROR_RATE`` * n) edits
(insertions, deletions, substitutions of bytes) and is split into k + 1 pieces: an occurrence
with at most k errors holds at least one piece unchanged.  All pieces go into one Aho-Corasick
automaton that reads every whole document once.  A hit is verified upwards: pieces are the leaves
of a tree whose inner nodes hold k1 + k2 + 1 errors where their halves hold k1 and k2, so an
occurrence within budget has a leaf all of whose ancestors are within theirs.  Most leaves stand in
pairs of budget one: the partner is compared beside the hit first, where nearly all chance hits end, then
Myers' algorithm tries the ancestors from small to large.  Places of the whole item that
are left merge where they overlap, and Myers' algorithm gives the least distance to any stretch.
An item of fewer than ``LEAST_BYTES`` bytes has budget 0 and must stand as whole words: with
edits, or inside words, so short a string is met by chance.

The benchmark is read in blocks of items: a block is broadcast while its pieces stay under
``BLOCK_BYTES`` (its size is counted first) and the documents are scanned once per block, so a
larger benchmark costs passes, never memory.

Edge cases: items that are null or normalise to no byte identify nothing
and are skipped; null and empty texts match nothing; repeated rows give a row each; equal items
are matched each under its own id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.common import map_rows, without_ids

ERROR_RATE = 0.12
LEAST_BYTES = 24
BLOCK_BYTES = 8 << 20
_CLEAN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def normalise(text: str | None) -> bytes:
    return b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(_CLEAN).split())


def budget(n: int, rate: float = ERROR_RATE) -> int:
    return int(n * rate) if n >= LEAST_BYTES else 0


def myers(pattern: bytes, masks: dict[int, int], text: bytes, most: int) -> tuple[int, int]:
    """(least distance of ``pattern`` to any stretch of ``text``, end of the first such stretch).

    A distance above ``most`` comes back as most + 1.  ``masks`` maps a byte to its positions.
    """
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = most + 1, -1
    for at, c in enumerate(text):
        eq = masks.get(c, 0)
        cross = eq | minus
        eq |= (((eq & plus) + plus) ^ plus)
        up = minus | ~(eq | plus)
        down = plus & eq
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up <<= 1  # row zero costs nothing: an occurrence may begin anywhere
        plus = ((down << 1) | ~(cross | up)) & full
        minus = up & cross & full
        if score < best:
            best, end = score, at + 1
            if not best:
                break
    return best, end


def masks_of(pattern: bytes) -> dict[int, int]:
    masks: dict[int, int] = {}
    for at, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << at
    return masks


def ancestry(a: int, b: int, k: int, above: tuple = ()) -> Iterator[tuple[int, int, tuple]]:
    """(start, end, ancestors below the root from small to large) of each leaf of item[a:b] with budget k.

    Ancestors are (start, end, budget).  Lengths follow the budgets, so leaves are nearly equal.
    """
    if k == 0:
        yield a, b, above
        return
    left = (k - 1) // 2
    left -= left > 0 and left % 2 == 0  # odd budgets split into pairs of leaves without a rest
    cut = a + (b - a) * (left + 1) // (k + 1)
    for low, high, errors in ((a, cut, left), (cut, b, k - 1 - left)):
        yield from ancestry(low, high, errors, ((low, high, errors), *above) if errors else above)


def within_one(want: bytes, text: bytes) -> bool:
    """Whether ``text`` begins with ``want``, give or take one edit."""
    m, i = len(want), 0
    for a, b in zip(want, text):
        if a != b:
            break
        i += 1
    if i == m:
        return True
    rest = want[i + 1 :]
    return rest == text[i + 1 : m] or rest == text[i : m - 1] or want[i:] == text[i + 1 : m + 1]


class Matcher:
    """Finds the items of one block in a text; built in each worker from (item_id, bytes)."""

    def __init__(self, items: list[tuple[int, bytes]], rate: float = ERROR_RATE):
        budgets = [budget(len(t), rate) for _, t in items]
        items = [(i, t if len(t) >= LEAST_BYTES else b" " + t + b" ") for i, t in items]
        self.items = [(i, t, k, masks_of(t)) for (i, t), k in zip(items, budgets)]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        where: dict[bytes, list] = {}
        for number, (_, text, k, _) in enumerate(self.items):
            nodes: dict[tuple[int, int, int], tuple] = {}
            for low, high, above in ancestry(0, len(text), k):
                pair = above[0] if above and above[0][2] == 1 else None
                after = text[high : pair[1]] if pair and pair[0] == low else None
                before = text[pair[0] : low][::-1] if pair and pair[1] == high else None
                tests = [nodes.setdefault(n, (n[0], n[1], n[2], text[n[0] : n[1]], masks_of(text[n[0] : n[1]]))) for n in above[1 if pair else 0 :]]
                where.setdefault(text[low:high], []).append((number, high, high - low, after, before, tests))
        for piece, places in where.items():
            self.automaton.add_word(piece.decode("latin-1"), places)
        if where:
            self.automaton.make_automaton()

    def find(self, text: bytes) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, end of the first best stretch, places verified) of the items found."""
        starts: dict[int, list[int]] = {}
        short: dict[int, int] = {}
        for end1, places in self.automaton.iter(f" {text.decode('latin-1')} ") if self.items else ():  # the edges of the text end words too
            for number, behind, size, after, before, tests in places:
                if self.items[number][1][-1] == 32:  # a short item: its one piece is all of it, with the blanks around
                    short.setdefault(number, end1 - 1)
                    continue
                if after is not None:
                    if not within_one(after, text[end1 : end1 + len(after) + 1]):
                        continue
                elif before is not None:
                    start = end1 - size
                    if not within_one(before, text[max(0, start - len(before) - 1) : start][::-1]):
                        continue
                at = end1 - behind
                for low, high, k, part, masks in tests:
                    if myers(part, masks, text[max(0, at + low - k) : max(0, at + high + k)], k)[0] > k:
                        break
                else:
                    starts.setdefault(number, []).append(at)
        found = [(self.items[number][0], 0, end, 1) for number, end in short.items()]
        for number, at in starts.items():
            item_id, item, k, masks = self.items[number]
            at.sort()
            best, best_end, tried, i = k + 1, -1, 0, 0
            while i < len(at) and best:
                j = i
                while j + 1 < len(at) and at[j + 1] - at[j] <= len(item) + 2 * k:
                    j += 1
                low = max(0, at[i] - k)
                distance, end = myers(item, masks, text[low : at[j] + len(item) + k], min(k, best - 1))
                tried += 1
                if distance < best:
                    best, best_end = distance, low + end
                i = j + 1
            if best <= k:
                found.append((item_id, best, best_end, tried))
        return found


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, least: int = 1) -> Iterator[list[tuple[int, bytes]]]:
    """The items, block by block, each of about ``block_bytes`` of text (counted beforehand)."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = int(total // block_bytes) + 1
    for block in range(count):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == block).collect()
        kept = sorted({(r["item_id"], t) for r in rows if len(t := normalise(r["text"])) >= least}, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        if kept:
            yield kept


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES, least: int = 1) -> DataFrame:
    """doc_id, item_id, distance, end_byte (in the normalised text), places_verified: every item of ``least`` bytes or more in every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, item_id long, distance int, end_byte long, places_verified int"
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
    out = spark.createDataFrame([], schema)
    for block in blocks(benchmark, block_bytes, least):
        shared = spark.sparkContext.broadcast({"items": block})

        def one(batch: pa.RecordBatch, shared=shared) -> dict:
            held = shared.value  # a worker process keeps it, and so the matcher, from task to task
            if "matcher" not in held:
                held["matcher"] = Matcher(held["items"], rate)
            matcher = held["matcher"]
            got = [(d, *f) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for f in matcher.find(normalise(t))]
            return {n: [g[i] for g in got] for i, n in enumerate(("doc_id", "item_id", "distance", "end_byte", "places_verified"))}

        out = out.union(map_rows(rows, schema, one, types))
    return out


def nearest_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """As ``matches``, the least distance for each (doc_id, item_id) where rows repeat."""
    rank = F.row_number().over(Window.partitionBy("doc_id", "item_id").orderBy("distance", "end_byte"))
    return matches(docs, benchmark).withColumn("r", rank).filter("r = 1").drop("r")


def kept_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item of ``LEAST_BYTES`` bytes or more, all columns (rows sharing the id of one that does go too).

    A shorter item, as an answer of one word, is reported by ``matches`` but is no leak by itself.
    """
    return without_ids(docs, matches(docs, benchmark, least=LEAST_BYTES).select("doc_id"), "leaks")
