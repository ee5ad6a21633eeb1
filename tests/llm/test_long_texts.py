"""Very long texts: slices and batches leave no trace; statistics against a plain reading."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from pointloom.llm import html_text, personal_data, quality, simhash


def long_text(words=30_000, seed=1):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(("the", "of", "Words,", "é", "12", "end.", "AND", "a!", "\n", "x%", "same\nline")) + rnd.choice(("", "s", "ly")) for _ in range(words))


@pytest.mark.parametrize("size", [1, 7, 1000, 1 << 20])
def test_fingerprint_by_slices(monkeypatch, size):
    text = long_text(3000)
    tokens = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    h = [xxhash.xxh64_intdigest(" ".join(tokens[i : i + 3]).encode(), 42) for i in range(len(tokens) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    monkeypatch.setattr(simhash, "SHINGLES_AT_ONCE", size)
    assert simhash.fingerprint(text) == want


def plain_statistics(text):
    raw = text.encode()
    words, lines = raw.split(), raw.split(b"\n")
    n, count = max(len(raw), 1), max(len(words), 1)
    of = lambda test: sum(map(test, raw))
    upper, lower, digit = of(lambda c: 65 <= c <= 90), of(lambda c: 97 <= c <= 122), of(lambda c: 48 <= c <= 57)
    marks, other, high = of(lambda c: c in b".,;:'\"?-()"), of(lambda c: 33 <= c <= 126 and not chr(c).isalnum() and c not in b".,;:'\"?-()"), of(lambda c: c > 127)
    letters = max(upper + lower + high, 1)
    blank = n - upper - lower - digit - marks - other - high if raw else 0
    top = max(Counter(words).values(), default=0)
    share = lambda a, b: math.sqrt(a / b)
    return [
        math.log1p(len(words)), math.log1p(sum(map(len, words)) / count), share(len(set(words)), count), share(top, count), share(upper, letters), share(digit, n), share(other, n), share(marks, n), share(high, n),
        math.log1p(len(lines)), share(len(lines) - len(set(lines)), len(lines)), math.log1p(len(zlib.compress(raw, 1)) / n), share(sum(w[-1] in b"!#$%&(*+/" for w in words), count), share(sum(len(w) < 4 for w in words), count), share(blank, n),
    ]


@pytest.mark.parametrize("text", ["", " ", "a", "One two.\n\nOne two.\n", "é😀 %%% ***x $5! (b) c/", long_text(2000), long_text(60_000, 2)])
def test_statistics_against_a_plain_reading(monkeypatch, text):
    want = plain_statistics(text)
    for size in (1 << 20, 977):
        monkeypatch.setattr(quality, "PACK_AT_ONCE", size)
        assert np.allclose(quality.statistics(text), want, atol=2e-3), dict(zip(quality.FEATURES, zip(quality.statistics(text), want)))


def test_main_text_of_a_long_page():
    paragraphs = [f"Paragraph {i} of a long article, with some words in it." for i in range(40_000)]
    page = "<body><nav>Menu</nav><article>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</article></body>"
    assert html_text.extract(page) == "\n".join(paragraphs)


def test_personal_data_far_into_a_long_text():
    weights = personal_data.train()
    text = long_text(40_000).replace("12", "xii") + " call 212-555-0187 or jo at example dot com, " + long_text(40_000, 3).replace("12", "xii")
    got = personal_data.added_spans(text, personal_data.base_spans(text), weights)
    assert {text[a:b] for a, _, b in got} >= {"212-555-0187", "jo at example dot com"}
