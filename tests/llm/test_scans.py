"""Secrets and personal data: base spans against plain patterns, learned spans on planted strings."""

import hashlib
import os
import random
import re

import pytest

from pointloom.llm import personal_data as pii
from pointloom.llm import secret_scan

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def secrets_brute(text):
    out = []
    for kind, (pattern, group, least) in enumerate(((ASSIGN, 2, 6), (r"AKIA[A-Z0-9]+", 0, 20), (r"[0-9a-f]+", 0, 24))):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text or "", re.ASCII) if len(m[group]) >= least]
    return sorted(out)


def digest(spans, kinds):
    return hashlib.sha256(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


def test_secret_base_spans(spark, awkward):
    rnd = random.Random(4)
    parts = ['token = "', "ab12cd", "PASSWORD:", "api_key=", "apikey' = '", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "é", "😀", " ", "\n", "secret", "=", "aB3/x_9", "deadbeef" * 3, "passwd : ", "hello"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(400)] + ["", None, "token=abcdef " * 400, "😀" * 50 + "token=xyzxyz1"]
    rows = list(enumerate(texts)) + [(r["doc_id"], r["text"]) for r in awkward.collect()]
    got = secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    key = lambda r: (str(r[0]), r[1])
    want = sorted(((d, digest(secrets_brute(t), secret_scan.KINDS), *(sum(s[1] == k for s in secrets_brute(t)) for k in range(3))) for d, t in rows), key=key)
    assert sorted(((r["doc_id"], r["base_sha256"], r["n_assign"], r["n_access"], r["n_hex"]) for r in got), key=key) == want


def test_secret_learned_spans(spark):
    keys = ["wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY", "ghp_16C7e42F292c6912E7710c838347Ae178B4a", "5F4DCC3B5AA765D61D8327DEB882CF99"]
    plain = ["=" * 40, "-" * 30, "getUserAccountBalance", "MAX_CONNECTION_POOL_SIZE", "com/en/article-2024-01-02-title", "1234567890123456", "internationalisation", "user_session_2023_backup"]
    prose = "the quick brown foxes jumped over lazy sleeping dogs while ordinary people were reading several interesting stories about getting user session connection pools and titles of articles "
    docs = spark.createDataFrame([(i, prose + f"see {k} here") for i, k in enumerate(keys + plain)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in secret_scan.scan(docs).collect()}
    for i, k in enumerate(keys):
        start = len(prose) + 4
        assert f"markov:{start}:{start + len(k)}" in got[i]["spans"].split(",") and got[i]["n_markov"] == 1
    assert all(got[i]["n_markov"] == 0 for i in range(len(keys), len(keys + plain)))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="test tables are absent")
def test_keys_of_one_case_are_scored(spark):
    """With words enough to learn from, letters of one case in random order stand out; long words and rulers do not."""
    samples = secret_scan.training_samples(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    keys = ["qzxvkjwpfhtmbgdnrsty", "QZXVKJWPFHTMBGDNRSTYL", "kqjxzvwmplghtrdsnbcf"]
    plain = ["internationalization", "counterrevolutionary", "=" * 40, "-" * 30, "a" * 20, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "/usr/local/lib/python", "MAX_SHUFFLE_PARTITIONS", "1234567890123456"]
    docs = spark.createDataFrame([(i, f"see {k} here") for i, k in enumerate(keys + plain)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_markov"] for r in secret_scan.scan(docs, samples).collect()}
    assert [got[i] for i in range(len(keys + plain))] == [1] * len(keys) + [0] * len(plain)


def test_secret_edge_tables(empty, awkward):
    assert secret_scan.scan(empty).count() == 0
    assert secret_scan.scan(awkward).count() == awkward.count()


def pii_brute(text):
    out = []
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    for kind, pattern in enumerate(patterns):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(p) > 255 for p in m[0].split(".")) or kind == 2 and not (14 <= len(digits) <= 19 and pii.luhn(digits)) or kind == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_personal_base_spans():
    rnd = random.Random(3)
    for _ in range(15000):
        text = "".join(rnd.choice("ab@@..1234+- ()é") for _ in range(rnd.randint(0, 30)))
        assert pii.base_spans(text) == pii_brute(text), text
    card = "4111111111111111"
    for text in (f"x {card} y", f"{card} {card}", "4111-1111-1111-1111", "1.2.3.4.5.6.7.8", "a@b.c@d.e", "+1 (234) 555-7890.", "²²²²²²²²²²²²²²²²", "0" * 3000 + ".1.1.1"):
        assert pii.base_spans(text) == pii_brute(text), text


@pytest.fixture(scope="module")
def weights():
    return pii.train()


def test_field_finds_unseen_sentences(weights):
    hit = wrong = missed = 0
    for text, spans in pii.sentences(300, seed=1234):
        k = pii.tokenise(text)
        got = {(k.start[a], kind, k.end[b - 1]) for a, kind, b in pii.best_segments(weights, k)}
        hit, wrong, missed = hit + len(got & set(spans)), wrong + len(got - set(spans)), missed + len(set(spans) - got)
    assert hit / (hit + wrong) > 0.95 and hit / (hit + missed) > 0.95


def test_best_segmentation_against_enumeration(weights):
    """Every set of candidate segments that do not overlap, with every kind, is tried."""
    rnd, tried = random.Random(12), 0
    texts = ["tel 030 123 4567 x", "jo at ex dot com 12", "10.0.0.1 4111 1111 1111 1111", "mail a b at c dot de", "+1 (212) 555-0187", "call 0123 456 7890 now"]
    texts += [t[i : i + 24] for t, _ in pii.sentences(60, seed=77) for i in (rnd.randrange(max(1, len(t) - 24)),)]
    for text in texts:
        k = pii.tokenise(text)
        spans, x = pii._lattice(k)
        if not 0 < len(spans) <= 14:
            continue
        tried += 1
        scores = x @ weights.T
        best = 0.0
        for chosen in range(1 << len(spans)):
            mine = [i for i in range(len(spans)) if chosen >> i & 1]
            if all(spans[i][1] <= spans[j][0] or spans[j][1] <= spans[i][0] for n, i in enumerate(mine) for j in mine[:n]):
                best = max(best, sum(max(float(s) for s in scores[i]) for i in mine))
        got = sum(float(scores[spans.index((a, b))][kind]) for a, kind, b in pii.best_segments(weights, k))
        assert abs(got - best) < 1e-9
    assert tried >= 8


def test_seeds_leave_nothing_out(weights):
    """The spans of a whole text are those found around its seeds."""
    rnd, made = random.Random(7), pii.sentences(400, seed=99)
    for i in range(0, len(made), 5):
        text = "".join(t + rnd.choice([" ", "\n", ". ", " at ", " x.y ", " (at) b dot c ", "  ", " filler words go here and on and on, " * 5]) for t, _ in made[i : i + 5])
        k, base = pii.tokenise(text), pii.base_spans(text)
        want = [(k.start[a], kind, k.end[b - 1]) for a, kind, b in pii.best_segments(weights, k)]
        assert pii.added_spans(text, base, weights) == [w for w in want if not any(s < w[2] and w[0] < e for s, _, e in base)]


@pytest.mark.parametrize("filler", ["e" * 40, "e" * 100, "e" * 5000])
def test_long_words_between_at_and_dot(weights, filler):
    text = f"so jo at <{filler}> dot com"
    assert [text[a:b] for a, _, b in pii.added_spans(text, [], weights)] == [f"jo at <{filler}> dot com"]


def test_gradient_is_that_of_the_likelihood(weights):
    import numpy as np

    text, spans = next(s for s in pii.sentences(20, seed=5) if s[1])
    k = pii.tokenise(text)
    lattice, x = pii._lattice(k)
    first, last = {s: i for i, s in enumerate(k.start)}, {e: i + 1 for i, e in enumerate(k.end)}
    gold = {(first[a], last[b]): kind for a, kind, b in spans if (first[a], last[b]) in lattice}

    def likelihood(w):
        score = x @ w.T
        alpha = np.full(len(k.text) + 1, -np.inf)
        alpha[0] = 0
        for at in range(1, len(alpha)):
            alpha[at] = np.logaddexp.reduce([alpha[at - 1]] + [alpha[a] + np.logaddexp.reduce(s) for (a, b), s in zip(lattice, score) if b == at])
        return sum(score[lattice.index(s)][kind] for s, kind in gold.items()) - alpha[-1]

    w = np.zeros_like(weights)
    gradient = pii._gradient(w, len(k.text), lattice, x, gold)
    for kind, feature in ((0, 0), (3, 0), (2, 5), (3, pii._INDEX["last group of four"])):
        step = np.zeros_like(w)
        step[kind, feature] = 1e-5
        assert abs((likelihood(w + step) - likelihood(w - step)) / 2e-5 - gradient[kind, feature]) < 1e-5


def test_personal_rows(awkward, empty, weights, spark):
    got = pii.find(awkward, weights).collect()
    assert len(got) == awkward.count() and all(r["spans"] == "" and r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in got)
    assert pii.find(empty, weights).count() == 0
    row = pii.find(spark.createDataFrame([(1, "call 212-555-0187 or mail jo at example dot com, é me@x.org")], "doc_id long, text string"), weights).first()
    assert row["n_email"] == 1 and row["n_added"] >= 1 and "phone:5:17" in row["spans"].split(",")
