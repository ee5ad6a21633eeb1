"""Exact copies, near copies and repeated passages against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from pointloom.llm import exact_dedup, simhash, suffix_dedup

DOCS = "doc_id long, text string"


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6))) for _ in range(n))


# ---- exact copies ----


def exact_brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = {}
    for (d, _), n in zip(rows, norm):
        groups.setdefault(n, []).append(d)
    out = []
    for (d, _), n in zip(rows, norm):
        known = [x for x in groups[n] if x is not None]
        keep = min(known) if known else None
        out.append((d, keep, len(groups[n]), d == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_copies(spark, awkward, bits):
    rnd = random.Random(1)
    rows = []
    for i in range(150):
        text = words(rnd, rnd.choice((0, 3, 40, 900))) if not rows or rnd.random() < 0.6 else rnd.choice(rows)[1].replace(" ", rnd.choice((" ", "  ", "\n\t")))
        rows.append((500 - i, text))
    rows += [(r["doc_id"], r["text"]) for r in awkward.collect()]
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    assert sorted(map(tuple, exact_dedup.exact_dedup(df, bits).collect()), key=str) == exact_brute(rows)


def test_chunks_give_the_text_back(spark):
    rnd = random.Random(2)
    texts = [words(rnd, 3000), "x" * 30000, "", " ", "a. b" * 5000, "😀é\n" * 3000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = df.select("text", exact_dedup.chunks(df["text"]).alias("c")).collect()
    assert all("".join(r["c"]).encode("latin-1").decode() == r["text"] and all(0 < len(c) <= exact_dedup.MAX_CHUNK + 16 for c in r["c"]) for r in got)


@pytest.mark.parametrize("letters", ["etaoinshrdlu", "оеаинтсрвлкмдпу", "αοιετσνηυρ", "的一是不了人我在有他这中大来上国", "あいうえおかきくけこさしす", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "한국어를배우는사람들이많다", "กขคงจฉชซญดตถทนบปผพฟมยรลวสหอ"])
@pytest.mark.parametrize("blanks", [True, False])
def test_chunks_survive_an_insertion(spark, letters, blanks):
    """A cut depends on the text around it in every script, with blanks or without."""
    rnd = random.Random(6)
    text = "".join(" " if blanks and rnd.random() < 0.18 else rnd.choice(letters) for _ in range(100_000))
    df = spark.createDataFrame([(text,), (letters[:3] + text,)], "text string")
    before, after = (r["c"] for r in df.select(exact_dedup.chunks(df["text"]).alias("c")).collect())
    assert len(set(before) & set(after)) >= 0.8 * len(before) and len(before) > 20


def test_exact_kept_documents(awkward, empty):
    kept = exact_dedup.kept_documents(awkward)
    assert kept.columns == awkward.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    assert ids == sorted((d is None, d or 0, t) for d, t in [(0, ""), (2, " "), (4, "a"), (5, "é😀"), (6, "word " * 50), (7, "x" * 20000), (8, "same text here"), (None, "no id"), (3, "another text of a repeated id")])
    assert exact_dedup.exact_dedup(empty).count() == exact_dedup.kept_documents(empty).count() == 0


# ---- near copies ----


def fingerprint_brute(text, n=3):
    tokens = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + n]) for i in range(max(1, len(tokens) - n + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_brute(nodes, links):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def near_brute(rows):
    fp = [fingerprint_brute(t) for _, t in rows]
    known = [i for i, (d, _) in enumerate(rows) if d is not None]
    links = [(i, j) for i in known for j in known if i < j and (fp[i] ^ fp[j]).bit_count() <= 3]
    of = {}
    for i, j in links + [(i, i) for i in known]:
        of.setdefault(fp[i], set()).add(fp[j])
        of.setdefault(fp[j], set()).add(fp[i])
    least = {}
    for i in known:
        least[fp[i]] = min(rows[i][0], least.get(fp[i], rows[i][0]))
    label = components_brute([least[f] for f in of], [(least[f], least[g]) for f in of for g in of[f]])
    return sorted(((d, f"{f:016x}", label.get(least.get(f))) for (d, _), f in zip(rows, fp)), key=str)


@pytest.mark.parametrize("shift", [0, -300])
def test_near_copies(spark, awkward, shift):
    rnd = random.Random(4)
    rows = []
    for i in range(260):
        if rows and rnd.random() < 0.6:
            tokens = (rnd.choice(rows)[1] or "").split()
            for _ in range(rnd.randint(0, 2)):
                if tokens:
                    tokens[rnd.randrange(len(tokens))] = words(rnd, 1)
            text = " ".join(tokens)
        else:
            text = words(rnd, rnd.choice((1, 2, 5, 60, 300)))
        rows.append((1000 - 3 * i + shift, text))
    if not shift:
        rows += [(r["doc_id"], r["text"]) for r in awkward.collect()]
    got = sorted(map(tuple, simhash.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(3)).collect()), key=str)
    assert got == near_brute(rows)


def test_near_kept_and_empty(awkward, empty):
    kept = simhash.kept_documents(awkward)
    assert kept.columns == awkward.columns and kept.filter("doc_id is null").count() == 2
    assert simhash.near_duplicates(empty).count() == 0


def test_golay_code_is_perfect():
    table, codewords = simhash.golay_tables()
    assert len(set(codewords.tolist())) == 4096 and (np.bincount(table, minlength=4096) == 2048).all()
    assert np.bitwise_count(codewords[table.astype(np.int64)] ^ np.arange(1 << 23, dtype=np.uint32)).max() == 3


def test_three_bits_always_share_a_key():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**64, 1500, dtype=np.uint64)
    b = a.copy()
    for i in range(len(a)):
        for bit in rng.choice(64, 3, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)

    def by_row(fp):
        index, every = [set() for _ in fp], [set() for _ in fp]
        for row, key, own in zip(*(x.tolist() for x in simhash.keys(fp))):
            every[row].add(key)
            if own:
                index[row].add(key)
        return index, every

    (ia, ea), (ib, eb) = by_row(a), by_row(b)
    assert all(ia[k] & eb[k] and ib[k] & ea[k] for k in range(len(a)))


def test_links_of_a_dense_run_connect_it():
    rng = np.random.default_rng(6)
    centre = rng.integers(0, 2**64, dtype=np.uint64)
    fp = np.array([centre ^ (np.uint64(1) << np.uint64(i)) for i in range(64)] + [centre, ~centre], np.uint64)
    links = simhash._run_links(fp, np.arange(66), np.ones(66, bool))
    label = components_brute(range(66), links)
    assert len(links) == 64 and len({label[i] for i in range(65)}) == 1 and label[65] == 65


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_components(spark, shape):
    rnd = random.Random(7)
    links = [(i, i + 1) for i in range(60)] if shape == "path" else [(0, i) for i in range(1, 80)] if shape == "star" else [(rnd.randint(0, 200), rnd.randint(0, 200)) for _ in range(140)]
    got = {r["node"]: r["label"] for r in simhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = components_brute({x for link in links for x in link}, links)
    assert got == {n: c for n, c in want.items() if n != c}


# ---- repeated passages ----


def repeats_brute(rows, length=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            if d is not None and (b[i : i + length] not in first or d < first[b[i : i + length]]):
                first[b[i : i + length]] = d
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if d is not None and first[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, x in zip(b, gone) if not x)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(
    ("bucket_bytes", "slice_bytes", "repeated_ids", "hot", "ranges"),
    [(1 << 22, 1 << 20, True, 2000, 8192), (1500, 1 << 20, False, 2000, 8192), (1500, 200, True, 2000, 3), (1500, 300, False, 3, 8192), (1500, 300, False, 3, 5), (9000, 1 << 20, True, 8, 8192)],
)
def test_repeated_passages(spark, awkward, monkeypatch, bucket_bytes, slice_bytes, repeated_ids, hot, ranges):
    monkeypatch.setattr(suffix_dedup, "RANGES", ranges)
    rnd = random.Random(8)
    rows = []
    for i in range(220):
        text = "".join(rnd.choice("abé ") for _ in range(rnd.randint(0, 300)))
        if rows and rnd.random() < 0.6:
            other = rnd.choice(rows)[1]
            a, k = rnd.randint(0, len(other)), rnd.randint(0, len(text))
            text = text[:k] + other[a : a + rnd.randint(20, 150)] + text[k:]
        rows.append((i * 3 - 50, text))
    common = "a passage that very many of these documents share, word for word, to its end"
    rows += [(3000 - i, words(rnd, 4) + common + words(rnd, 4)) for i in range(60)]
    rows += [(5000, "a" * 400), (5001, "a" * 200), (5002, "ab" * 200), (5003, "xyz" + "ab" * 100), (5004, "b" * 49), (5005, "b" * 50), (5006, "b" * 50)]
    if repeated_ids:
        rows += [(r["doc_id"], r["text"]) for r in awkward.collect()] + [(rows[9][0], rows[10][1] + "zz"), (rows[9][0], rows[9][1])]
    scan = suffix_dedup._scan
    monkeypatch.setattr(suffix_dedup, "_scan", lambda buckets: scan(buckets, slice_bytes, 20 * slice_bytes))
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    got = suffix_dedup.digest(suffix_dedup.remove_repeats(df, bucket_bytes, hot))
    assert sorted(map(tuple, got.collect()), key=str) == repeats_brute(rows)


def test_repeats_of_no_rows(empty):
    assert suffix_dedup.digest(suffix_dedup.remove_repeats(empty)).count() == 0


def brute_factors(rows, doc, length):
    """Longest common prefix with any row of a smaller document, counted up to ``length``."""
    out = []
    for i, d in zip(rows, doc):
        best = 0
        for j, e in zip(rows, doc):
            n = 0
            while e < d and n < length and i[n] == j[n]:
                n += 1
            best = max(best, n)
        out.append(best)
    return out


@pytest.mark.parametrize("documents", [5, 60, 400])
def test_longest_previous_factors(documents):
    rnd = random.Random(documents)
    rows = np.array([[rnd.choice((0, 1)) if c in (3, 20, 49) else 7 for c in range(suffix_dedup.LENGTH)] for _ in range(300)], np.uint8)
    doc = np.array([rnd.randint(0, documents) for _ in range(300)])
    order = suffix_dedup.in_order(rows)
    words = suffix_dedup.suffix_words(suffix_dedup.padded(rows), 0, order)
    prefixes = [0] + [brute_factors(rows[order[[i - 1, i]]], [0, 1], 50)[1] for i in range(1, 300)]
    assert suffix_dedup.common_prefixes(words, 50).tolist() == prefixes
    want = [f if f == 50 else 0 for f in brute_factors(rows[order], doc[order], 50)]
    assert suffix_dedup.longest_previous_factors(words, doc[order]).tolist() == want


def test_nearest_smaller():
    rnd = random.Random(3)
    for case in range(200):
        n = rnd.randint(1, 60)
        values = [rnd.randint(0, 1 + case % 20) for _ in range(n)]
        cuts = sorted({0, *(rnd.randrange(n) for _ in range(case % 5))})
        least = [max(c for c in cuts if c <= i) for i in range(n)]
        want = [max((j for j in range(least[i], i) if values[j] < values[i]), default=-1) for i in range(n)]
        assert suffix_dedup.nearest_smaller(np.array(values), np.array(least)).tolist() == want


def test_induced_suffix_order():
    rnd = random.Random(4)
    lead, n = suffix_dedup.BEFORE, 200
    rows = np.array([[rnd.choice(b"ab") if c < lead + 2 else 99 for c in range(lead + 50)] for _ in range(n)], np.uint8)
    rows[100:, 18:] = rows[:100, 18:]
    before = np.array([rnd.choice((0, 9, lead)) for _ in range(n)], np.uint8)
    after = np.array([rnd.choice((30, 50)) for _ in range(n)], np.uint8)
    doc = np.sort(np.array([rnd.randint(0, 40) for _ in range(n)]))
    got = {(o, int(i)) for o, hit in suffix_dedup.repeated_windows(rows, before, after, doc, lead) for i in hit}
    want = set()
    for o in range(lead + 1):
        fits = [i for i in range(n) if before[i] >= o and after[i] >= 50 - o]
        window = {i: rows[i, lead - o : lead - o + 50].tobytes() for i in fits}
        want |= {(o, i) for i in fits if any(window[j] == window[i] and doc[j] < doc[i] for j in fits)}
    assert got == want and want


def test_factors_are_on_the_path(spark, monkeypatch):
    """Without longest previous factors nothing is removed."""
    rows = [(1, "one passage of more than fifty bytes that stands in two documents"), (2, "see: one passage of more than fifty bytes that stands in two documents")]
    df = spark.createDataFrame(rows, DOCS)
    assert {r.doc_id: r.n_removed for r in suffix_dedup.digest(suffix_dedup.remove_repeats(df)).collect()} == {1: 0, 2: 65}
    monkeypatch.setattr(suffix_dedup, "longest_previous_factors", lambda words, document, length=50: np.zeros(len(words), np.int16))
    assert {r.n_removed for r in suffix_dedup.digest(suffix_dedup.remove_repeats(df)).collect()} == {0}


def test_packets_do_not_grow_with_the_buckets():
    rnd = np.random.default_rng(5)
    n = 300_000
    h = rnd.integers(0, 1 << 63, n).astype(np.uint64)
    doc, at = np.sort(rnd.integers(0, 10_000, n)), rnd.integers(0, 1 << 20, n)
    size = {b: sum(len(x[1]) for x in suffix_dedup._anchor_blobs(doc, np.zeros(n, np.int64), at, h, b, 0)) for b in (7507, 250_007, 25_000_009)}
    assert max(size.values()) < 2 * size[7507]


def test_packing_round_trip():
    columns = [np.array([5, 5, 9], np.int64), np.array([1, 2, 3], np.uint32), np.array([True, False, True]), np.arange(9, dtype=np.uint8).reshape(3, 3)]
    assert all((a == b).all() for a, b in zip(columns, suffix_dedup._unpack(suffix_dedup._pack(*columns))))
