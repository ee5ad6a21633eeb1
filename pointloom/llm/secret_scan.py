"""Secret scan by patterns and character Markov models.  DataFrame functions only.

Base kinds are exact patterns (assign, access, hex).  The method adds the kind ``markov``: every
token of ``LEAST_TOKEN`` or more base64-like characters is scored under two character Markov
chains, one of random strings and one of ordinary identifiers, and counts as a secret if the
log-likelihood ratio is at least ``LEAST_RATIO`` in all and ``LEAST_MEAN`` a character (``LEAST_MEAN_ONE_CASE`` where it has
no digit and its letters are in one case).

Training.  Labelled samples (text, label) give transition counts over ``ALPHABET`` plus an edge
symbol, summed by Spark and smoothed; at most (alphabet + 1) squared sums reach the driver and
return as one array constant.  By default the random strings are generated (digests as hex,
base64 and base32-like text, keys of letters in one case, ``RANDOM_STRINGS`` of them).  Ordinary strings are the words, and
joined pairs of words, of ``TRAINING_DOCUMENTS`` rows of the documents, those of smallest hash of the id (the
documented bound of the labelled sample), and as many generated numbers and rulers.  The models alone decide on a token; everything else covers all rows and whole texts.

Positions come from the text between matches: a match starts where the texts and matches before
it end.  The running sums go block by block, so a text with many matches costs n * sqrt(n)
steps at most, and expressions other than the test for a kind run only on texts that have it.

Edge cases: a null text counts as empty (no spans, digest of the empty string); offsets count
code points; a markov span that would touch a base span is dropped; repeated rows give a row
each; without documents to learn from, the model is that of the generated strings against even
odds and adds nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import text_or_empty

#: kind: (pattern, group whose length is tested, least length), in the order of listing.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
KINDS = (*BASE, "markov")
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
LEAST_TOKEN = 16
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST_RATIO, LEAST_MEAN = 12.0, 0.6
#: The least mean of tokens of letters in one case: words of a language that the training rows lack stand apart from the words learned as well.
LEAST_MEAN_ONE_CASE = 2.4
RANDOM_STRINGS, TRAINING_DOCUMENTS = 3000, 200
SMOOTHING = 0.5


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once (a lambda variable is bound, a column may be inlined)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _starts(steps: Column, at: Column) -> Column:
    """Sum of the elements of ``steps`` before each index in ``at``, by blocks of about a square root."""

    def with_width(width: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / width).cast("int")), lambda k: _total(F.slice(steps, k * width + 1, width)))

        def with_blocks(sums: Column) -> Column:
            before = F.transform(F.sequence(F.lit(0), F.size(sums) - 1), lambda k: _total(F.slice(sums, F.lit(1), k)))

            def with_before(base: Column) -> Column:
                def one(i: Column) -> Column:
                    block = F.floor(i / width).cast("int")
                    return F.element_at(base, block + 1) + _total(F.slice(steps, block * width + 1, i - block * width))

                return F.transform(at, one)

            return let(before, with_before)

        return let(blocks, with_blocks)

    return let(F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(steps))).cast("int")), with_width)


def spans(text: Column, pattern: str, group: int, least: int, kind: int, extra=None) -> Column:
    """Array of (start, kind, end) of the matches of ``pattern`` whose ``group`` has ``least`` characters.

    ``extra`` is a further test of the tested string.
    """
    lengths = lambda c: F.transform(c, lambda x: F.length(x))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def with_parts(p: Column) -> Column:
        n = F.size(p["match"])
        steps = F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(p["gap"], i) + F.element_at(p["match"], i))
        index = F.filter(F.transform(p["tested"], lambda x, i: F.when((F.length(x) >= least) & (extra(x) if extra else F.lit(True)), i)), lambda i: i.isNotNull())

        def with_index(q: Column) -> Column:
            starts = _starts(q["steps"], q["index"])
            return F.zip_with(q["index"], starts, lambda i, s: let(s + F.element_at(p["gap"], i + 1), lambda a: F.struct(a.alias("start"), F.lit(kind).alias("kind"), (a + F.element_at(p["match"], i + 1)).alias("end"))))

        return let(F.struct(steps.alias("steps"), index.alias("index")), with_index)

    found = let(F.struct(lengths(F.split(text, pattern, -1)).alias("gap"), lengths(whole).alias("match"), tested.alias("tested")), with_parts)
    return F.when(text.rlike(pattern), found).otherwise(empty)


# ---- the Markov models ------------------------------------------------------------------------


def random_strings(spark, count: int = RANDOM_STRINGS) -> DataFrame:
    """Generated random strings of several alphabets."""
    seed = F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 512)
    base64 = F.regexp_replace(F.base64(F.unhex(seed)), r"\s", "")
    letters = F.regexp_replace(base64, "[^A-Za-z]", "")
    kinds = [F.substring(seed, 1, 40), F.substring(base64, 1, 40), F.substring(F.upper(F.regexp_replace(base64, "[^A-Za-z0-9]", "")), 1, 32), F.lower(F.substring(letters, 1, 32)), F.upper(F.substring(letters, 1, 32))]
    return spark.range(count).select(F.element_at(F.array(*kinds), F.pmod("id", F.lit(len(kinds))).cast("int") + 1).alias("text"))


def numbers_and_rulers(spark, count: int = RANDOM_STRINGS) -> DataFrame:
    """Generated numbers of up to 40 digits, also grouped, lines of one symbol and stretches of the alphabet: long, but no secrets."""
    digits = F.regexp_replace(F.sha2(F.concat(F.lit("number "), F.col("id").cast("string")), 512), "[^0-9]", "")
    number = F.substring(digits, F.lit(1), (4 + F.pmod("id", F.lit(37))).cast("int"))
    grouped = F.regexp_replace(number, "([0-9]{4})(?=[0-9])", F.concat(F.lit("$1"), F.element_at(F.array(*map(F.lit, "-_/")), (F.pmod("id", F.lit(3)) + 1).cast("int"))))
    turn = F.floor(F.col("id") / 5)
    ruler = F.repeat(F.element_at(F.split(F.lit("=-_/+x"), ""), (F.pmod(turn, F.lit(6)) + 1).cast("int")), (4 + F.pmod("id", F.lit(61))).cast("int"))
    row = F.substring(F.lit(ALPHABET), (1 + F.pmod(turn, F.lit(52))).cast("int"), F.lit(20))
    kind = F.pmod("id", F.lit(5))
    return spark.range(count).select(F.when(kind == 0, ruler).when(kind == 1, grouped).when(kind == 2, row).otherwise(number).alias("text"))


def identifiers(docs: DataFrame, most: int = TRAINING_DOCUMENTS) -> DataFrame:
    """Words and joined pairs of words of a bounded number of rows, as identifiers are written."""
    ids = docs.select("doc_id").filter("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.col("doc_id").alias("__loom_id")).distinct()
    few = docs.join(F.broadcast(ids), docs["doc_id"] == F.col("__loom_id"), "left_semi")  # at most ``most`` ids
    few = few.select("doc_id", text_or_empty().alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(most)  # ids may repeat
    # whole words in one case or capitalised, shorter than a token: a key in the training text is no identifier
    words = F.regexp_extract_all("text", F.lit(rf"\b(?:[A-Z]?[a-z]{{2,{LEAST_TOKEN - 2}}}|[A-Z]{{3,{LEAST_TOKEN - 1}}})\b"), F.lit(0))
    w = few.select(words.alias("w")).filter(F.size("w") > 1)
    pairs = F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.array(F.concat_ws("_", F.lower(a), F.lower(b)), F.concat(F.lower(a), F.lower(b)), F.concat(F.lower(a), F.initcap(b)), F.upper(F.concat_ws("_", a, b)), F.concat_ws("-", a, b), F.concat_ws("/", a, b)))
    return w.select(F.explode(F.array_union(F.array_distinct("w"), F.flatten(pairs))).alias("text"))


def transitions(samples: DataFrame) -> dict[tuple[int, int, int], float]:
    """Counts by (label, from, to) over symbol numbers; 0 is the edge and any other character."""
    marked = samples.select("label", F.concat(F.lit(" "), F.col("text"), F.lit(" ")).alias("t"))
    pairs = marked.select("label", F.explode(F.transform(F.sequence(F.lit(1), F.length("t") - 1), lambda i: F.substring(F.col("t"), i, F.lit(2)))).alias("p"))
    counts = pairs.groupBy("label", "p").count()
    number = lambda c: F.instr(F.lit(ALPHABET), c)
    rows = counts.select("label", number(F.substring("p", 1, 1)).alias("a"), number(F.substring("p", 2, 1)).alias("b"), "count").groupBy("label", "a", "b").agg(F.sum("count").alias("n"))
    return {(r["label"], r["a"], r["b"]): float(r["n"]) for r in rows.collect()}


def ratios(samples: DataFrame) -> list[float]:
    """log P(b|a, random) - log P(b|a, identifier) for all a, b, row by row, from (text, label 1 or 0)."""
    n, counts = len(ALPHABET) + 1, transitions(samples)
    out = []
    for a in range(n):
        log = {}
        for label in (0, 1):
            total = sum(counts.get((label, a, b), 0.0) for b in range(n)) + SMOOTHING * n
            log[label] = [math.log((counts.get((label, a, b), 0.0) + SMOOTHING) / total) for b in range(n)]
        out += [round(x - y, 4) for x, y in zip(log[1], log[0])]
    return out


def likelihood_ratio(token: Column, table: Column) -> Column:
    """Log-likelihood ratio of a token, edges included; ``table`` as from ``ratios``."""
    n = len(ALPHABET) + 1
    numbers = F.concat(F.array(F.lit(0)), F.transform(F.split(token, ""), lambda c: F.when(c == "", 0).otherwise(F.instr(F.lit(ALPHABET), c))), F.array(F.lit(0)))
    return let(numbers, lambda s: F.aggregate(F.sequence(F.lit(1), F.size(s) - 1), F.lit(0.0), lambda acc, i: acc + F.element_at(table, F.element_at(s, i) * n + F.element_at(s, i + 1) + 1)))


def training_samples(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    ordinary = identifiers(docs).unionByName(numbers_and_rulers(spark))
    return random_strings(spark).withColumn("label", F.lit(1)).unionByName(ordinary.withColumn("label", F.lit(0)))


def scan(docs: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov for every row of ``docs``."""
    table = F.array(*[F.lit(x) for x in ratios(training_samples(docs) if samples is None else samples)])
    row = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("t"))
    text = F.col("t")

    def likely(token: Column) -> Column:
        mean = F.when(token.rlike("[0-9]|[a-z].*[A-Z]|[A-Z].*[a-z]"), LEAST_MEAN).otherwise(LEAST_MEAN_ONE_CASE)
        return let(likelihood_ratio(token, table), lambda r: (r >= LEAST_RATIO) & (r >= mean * F.length(token)))

    base = F.concat(*[spans(text, pattern, group, least, k) for k, (pattern, group, least) in enumerate(BASE.values())])
    found = row.select("doc_id", base.alias("base"), spans(text, TOKEN, 0, LEAST_TOKEN, len(BASE), likely).alias("more"))

    def listed(s: Column) -> Column:
        names = F.array(*map(F.lit, KINDS))
        return F.array_join(F.transform(F.array_sort(s), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")

    def both(p: Column) -> Column:
        apart = F.filter(p["more"], lambda m: ~F.exists(p["base"], lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
        return F.struct(p["base"].alias("base"), apart.alias("more"))

    one = found.select("doc_id", let(F.struct("base", "more"), both).alias("s"))
    count = lambda k: F.size(F.filter(F.col("s.base"), lambda x: x["kind"] == k)).cast("long")
    return one.select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(BASE)], F.sha2(listed(F.col("s.base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.concat("s.base", "s.more")).alias("spans"), F.size("s.more").cast("long").alias("n_markov"),
    )
