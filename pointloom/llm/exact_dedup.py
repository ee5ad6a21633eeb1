"""Exact dedup by content-defined chunk recipes.  DataFrame functions only.

Each text is normalised (every run of ASCII white space becomes one space), and its UTF-8 bytes are cut into
content-defined chunks: a cut falls behind the first ``BOUNDARY`` after ``MIN_CHUNK``
bytes, at the latest after ``MAX_CHUNK``, so equal stretches of text give equal chunks.  The boundary looks at
the low halves of four characters' last bytes, which vary in every script, so no alphabet is favoured.
A document is then its *recipe*: the ordered list of chunk identifiers.  Texts are equal
exactly if their recipes are.

Identifiers are verified: distinct chunk texts are gathered once per identifier (with
map-side combining, so a chunk that a third of all documents share is one row per task), and
an identifier standing for two different texts gets a rank beside it.  After that only
recipes move, eight bytes a chunk; a long text is never shuffled as a document.

Edge cases: a null text counts as empty (an empty recipe), so null and empty texts are one
group; repeated rows with the same id stay one row each, all with ``kept`` true if they carry
the smallest id; a null id sorts last and stays only where its whole group has no id
(``keep_id`` is null then); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import WS, materialise, text_or_empty, without_ids

MIN_CHUNK = 512
MAX_CHUNK = 8192
#: Low halves of the last bytes of the characters behind which a cut falls: 5 of 16 each, about 1 in 100 places in any script.
BOUNDARY_LOW = (1, 4, 6, 9, 12), (3, 5, 8, 11, 13), (0, 2, 7, 10, 14), (1, 4, 6, 9, 12)


def _last_byte(low: tuple[int, ...]) -> str:
    """Pattern of a character's last byte with one of these low halves."""
    return "[" + "".join(f"\\x{16 * high + n:02X}" for n in low for high in range(16)) + r"](?![\x80-\xBF])"


BOUNDARY = r"(?:[\xC0-\xFF][\x80-\xBF]{0,2})?".join(map(_last_byte, BOUNDARY_LOW))


def normalised(column: str = "text") -> F.Column:
    return F.regexp_replace(text_or_empty(column), WS, " ")


def chunks(text: F.Column) -> F.Column:
    """Array of chunks, each with a character per byte; concatenated they give the bytes of ``text`` back."""
    cut = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?{BOUNDARY}|.{{1,{MAX_CHUNK}}}"
    return F.regexp_extract_all(F.decode(text.cast("binary"), "ISO-8859-1"), F.lit(cut), F.lit(0))


def chunk_key(chunk: F.Column, bits: int = 64) -> F.Column:
    """The unverified identifier; fewer ``bits`` are for tests of the collision path."""
    key = F.xxhash64(chunk)
    return key if bits == 64 else key.bitwiseAND(F.lit((1 << bits) - 1))


def recipes(docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, text_sha256 and the verified recipe of every row of ``docs``."""
    base = docs.select("doc_id", normalised().alias("norm"))
    pieces = base.select(F.explode(chunks(F.col("norm"))).alias("chunk"))
    distinct = pieces.groupBy(chunk_key(F.col("chunk"), bits).alias("key"), "chunk").agg(F.lit(1).alias("one"))
    clashing = materialise(distinct.withColumn("n", F.lit(1)).groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1").select("key"), "chunk-clashes")
    row = base.select("doc_id", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), chunks(F.col("norm")).alias("list"))
    if clashing.isEmpty():
        return row.select("doc_id", "text_sha256", F.transform("list", lambda c: chunk_key(c, bits)).alias("recipe"))
    # Some identifier stands for several texts: those, and only those, get the text's digest beside the key.
    flat = row.withColumn("row_id", F.monotonically_increasing_id())
    flat = materialise(flat, "recipes-flat")
    parts = flat.select("row_id", F.posexplode("list").alias("at", "chunk")).withColumn("key", chunk_key(F.col("chunk"), bits))
    texts = parts.join(clashing, "key", "left_semi").select("key", "chunk").distinct()
    ranked = texts.groupBy("key").agg(F.array_sort(F.collect_set("chunk")).alias("all")).select("key", F.posexplode("all").alias("rank", "chunk"))
    verified = parts.join(ranked, ["key", "chunk"], "left").select("row_id", "at", F.struct("key", F.coalesce("rank", F.lit(0)).alias("rank")).alias("id"))
    lists = verified.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("at", "id"))).alias("parts"))
    lists = lists.select("row_id", F.flatten(F.transform("parts", lambda p: F.array(p["id"]["key"], p["id"]["rank"].cast("long")))).alias("recipe"))
    empty = F.array().cast("array<bigint>")
    return flat.join(lists, "row_id", "left").select("doc_id", "text_sha256", F.coalesce("recipe", empty).alias("recipe"))


def exact_dedup(docs: DataFrame, bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    The recipes are written once.  Groups of one need no further row: only recipes that occur
    again are joined back, by a hash of the recipe and the recipe itself.  The skewed side of
    that join (a group may hold a third of all rows) is narrow and splits under adaptive execution.
    """
    rows = materialise(recipes(docs, bits).withColumn("rh", F.xxhash64("recipe")), "recipes")
    groups = rows.groupBy("rh", "recipe").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # written, so that the join reads two plain shuffles: only such joins split a hot group's partition
    shared = materialise(groups.filter("group_size > 1"), "recipe-groups")
    joined = rows.join(shared, ["rh", "recipe"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: one row of each group of equal texts.

    Where every row has an id of its own, ids alone say which rows go.  Else the text's digest stands beside the id, and of
    rows that share the smallest id of a group one stays as well.
    """
    found = materialise(exact_dedup(docs).select(F.col("doc_id").alias("__loom_id"), "kept", F.col("text_sha256").alias("__loom_sha")), "copy-verdicts")
    if found.groupBy("__loom_id").count().filter("count > 1").isEmpty():
        return without_ids(docs, found.filter("not kept").select("__loom_id"), "copies")
    stay = materialise(found.filter("kept").groupBy("__loom_id", "__loom_sha").agg(F.count(F.lit(1)).alias("__loom_n")), "kept-copies")
    keyed = docs.withColumn("__loom_key", F.sha2(normalised().cast("binary"), 256))
    out = keyed.join(stay, F.col("doc_id").eqNullSafe(F.col("__loom_id")) & (F.col("__loom_key") == F.col("__loom_sha")), "left_semi")
    if not stay.filter("__loom_n > 1").isEmpty():  # the same row several times: the text moves once more
        out = out.dropDuplicates(["doc_id", "__loom_key"])
    return out.drop("__loom_key")


ORACLE = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g ON n.norm = g.norm
"""
