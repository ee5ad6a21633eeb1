"""The pipeline's near-duplicate stage against brute-force Jaccard similarity."""

import random

import pytest

from pointloom.llm import near_copies, simhash
from test_dedup import components_brute, words

import corpus_pipeline


def gone_brute(rows):
    sets = []
    for _, text in rows:
        t = (text or "").lower().split()
        sets.append({tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))})
    known = [i for i, (d, _) in enumerate(rows) if d is not None]
    links = [(rows[i][0], rows[j][0]) for i in known for j in known if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    label = components_brute([rows[i][0] for i in known], links)
    return {d for d in label if label[d] != d}


def made(rnd):
    rows, shared = [], words(rnd, 40)
    for i in range(300):
        if rows and rnd.random() < 0.6:
            tokens = rnd.choice(rows)[1].split()
            for _ in range(rnd.randint(0, 4)):
                if tokens:
                    tokens[rnd.randrange(len(tokens))] = words(rnd, 1)
            text = " ".join(tokens[: len(tokens) - rnd.choice((0, 0, 8))])
        else:
            text = words(rnd, rnd.choice((0, 1, 4, 5, 9, 60, 300)))
            text = f"{text} {shared}" if rnd.random() < 0.4 else text
        rows.append((600 - 3 * i, text))
    return rows


@pytest.mark.parametrize("small,sample", [(32, 4), (3, 1), (3, 50)])
def test_near_copies_against_jaccard(spark, awkward, small, sample):
    rows = made(random.Random(7)) + [(r["doc_id"] and r["doc_id"] + 5000, r["text"]) for r in awkward.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = gone_brute(rows)
    kept = near_copies.kept_documents(df, small, sample).collect()
    assert len(want) > 50 and sorted(map(str, kept)) == sorted(str(r) for r in df.collect() if r["doc_id"] not in want)


def test_stage_drops_near_copies_beyond_three_bits(spark, awkward, empty):
    rows = made(random.Random(8))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()}
    assert {d for d, _ in rows} - left == gone_brute(rows)
    assert near_copies.kept_documents(awkward).columns == awkward.columns and near_copies.kept_documents(empty).count() == 0


def test_operator_2_finds_the_close_copies(spark, monkeypatch):
    """With nothing from prefix filtering, what operator 2 links and similarity confirms goes; what it confirms is not verified twice."""
    rnd = random.Random(9)
    rows = []
    for _ in range(12):
        tokens = words(rnd, 900).split()
        for _ in range(6):
            rows.append((500 - 3 * len(rows), " ".join(tokens)))
            tokens[rnd.randrange(900)] = words(rnd, 1)
    rows += [(1000, "a b c d e " * 40), (1001, "a b c d e " * 41 + "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    fp = {d: simhash.fingerprint(t, near_copies.WORDS) for d, t in rows}
    label = components_brute(list(fp), [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= simhash.RADIUS])
    close = near_copies.close_pairs(df.select(df.doc_id.alias("node"), "text")).collect()
    assert components_brute(list(fp), [(r["a"], r["b"]) for r in close]) == label
    want = gone_brute(rows)
    by_simhash = {d for d in label if label[d] != d} & want
    assert len(by_simhash) > 20
    first = near_copies.first_pairs
    monkeypatch.setattr(near_copies, "first_pairs", lambda r, small: first(r, small).limit(0))
    assert set(fp) - {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()} == by_simhash
    monkeypatch.undo()
    seen, verified = [], near_copies.verified
    monkeypatch.setattr(near_copies, "verified", lambda pairs, sets: seen.append({(r["a"], r["b"]) for r in pairs.collect()}) or verified(pairs, sets))
    assert set(fp) - {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()} == want
    assert seen[0] == {(r["a"], r["b"]) for r in close} and seen[1] and all(label[a] != label[b] for a, b in seen[1] if {a, b} <= by_simhash | set(label.values()))
