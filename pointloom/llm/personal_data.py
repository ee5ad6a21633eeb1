"""Personal data found by exact patterns and a semi-Markov conditional random field.

The base patterns (e-mail, IP address, card, phone) give spans that always stay.  The random
field adds what they miss: numbers without a plus sign, spaced or spelled-out addresses and
the like.  It scores whole candidate segments (number of digits, grouping, checksum, range of
address parts, cue words beside it, ...) rather than single tokens, and a dynamic program over
segments of at most ``MOST_TOKENS`` tokens jointly chooses boundaries and types.  Weights are
fitted here by the exact gradient of the conditional likelihood (forward-backward over segments)
on generated sentences with known spans and many look-alikes (years, prices, versions, times,
order numbers, numbers failing the checksum); no model file is read.

A text is decoded only around *seeds*: four digits or more without a letter between them, "@", and the word "at" with a
spelled-out or inner dot among the next tokens.  Every candidate holds one and has at most ``MOST_TOKENS`` tokens, and features look ``CUE_TOKENS`` tokens further, so that many tokens around each seed
give the same spans as the whole text would.  The program is linear in the tokens, all
of a whole text's seeds are decoded, and memory is linear in one stretch between seedless gaps.

Edge cases: a null text counts as empty; added spans that would touch a base span are dropped;
offsets count code points; repeated rows give a row each; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import map_rows

KINDS = ("email", "ip", "card", "phone")
#: Longest candidate segment in tokens (the bound of the dynamic program).
MOST_TOKENS = 16
#: Tokens beside a segment that its features look at, at most.
CUE_TOKENS = 4
SENTENCES, EPOCHS, RATE, DECAY = 260, 25, 0.35, 1e-4

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A run of digits that does not begin a match cannot hold one later in the run, hence the look-behind.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def small(part: str) -> bool:
    """A number of at most 255."""
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, by start, then kind."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        # every local part ends at its "@", so looking back from there finds the leftmost start
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, 0, domain.end()))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out)


# ---- the random field -------------------------------------------------------------------------

_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\s\w]|_|[^\S\n]*\n\s*")
_SEED = re.compile(r"[0-9](?:[^A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F\u0370-\u03FF\u0400-\u04FF\u4E00-\u9FFF\n]*[0-9])?|@|(?<![^\W\d_])(?:at|At|aT|AT)(?![^\W\d_])")
_CUES = {
    "email": {"mail", "email", "e", "write", "contact", "correo", "courriel", "reply"},
    "ip": {"ip", "host", "server", "address", "node", "from"},
    "card": {"card", "visa", "mastercard", "credit", "debit", "karte", "tarjeta", "carte", "payment"},
    "phone": {"phone", "tel", "call", "fax", "mobile", "cell", "telefon", "number", "dial", "ring", "tfno", "tél"},
}
_ANTI = {"order", "invoice", "version", "v", "isbn", "year", "total", "price", "sku", "ref", "id", "no", "chapter", "page", "section", "item", "serial", "build"}
_AT, _DOT = {"at"}, {"dot"}
FEATURES = (
    "bias", "digits 7-9", "digits 10", "digits 11-13", "digits 14-19", "digits 20+", "checksum", "only digits and separators", "plus first", "parentheses",
    "groups of four", "group shape of a phone", "last group of four", "one token", "four small parts", "dots only", "at sign", "at word", "dot or dot word after at",
    "ends in short letters", "space inside", "clean left edge", "clean right edge", "cue email", "cue ip", "cue card", "cue phone", "anti-cue", "mixed separators", "starts zero", "words beside address", "sentence end inside", "decimals",
)
_INDEX = {n: i for i, n in enumerate(FEATURES)}


@dataclass
class Tokens:
    text: list[str]
    start: list[int]
    end: list[int]
    digits: list[int]  # digits before each token


def tokenise(text: str, low: int = 0, high: int | None = None) -> Tokens:
    t, s, e, d = [], [], [], [0]
    for m in _TOKEN.finditer(text, low, len(text) if high is None else high):
        t.append(m[0])
        s.append(m.start())
        e.append(m.end())
        d.append(d[-1] + (len(m[0]) if m[0][0] in "0123456789" else 0))
    return Tokens(t, s, e, d)


def segments(k: Tokens) -> list[tuple[int, int]]:
    """Candidate segments (first token, past the last): others cannot be an entity at all."""
    out = []
    n = len(k.text)
    for a in range(n):
        first = k.text[a]
        if not (first[0] in "0123456789" or first[0].isalpha() or first in "+("):
            continue
        ats = letters = sign = dots = 0
        for b in range(a + 1, min(n, a + MOST_TOKENS) + 1):
            last = k.text[b - 1]
            if "\n" in last or b - a > 1 and k.start[b - 1] - k.end[b - 2] > 1:
                break
            low = last.lower()
            sign |= last == "@"
            dots += bool(ats) and (low in _DOT or k.text[b - 2] == "." and k.start[b - 1] == k.end[b - 2] and k.start[b - 2] == k.end[b - 3])
            ats += last == "@" or low in _AT and b - a > 1
            letters += last[0].isalpha()
            if ats > 1 or letters and not ats and first in "+(":
                break
            digits = k.digits[b] - k.digits[a]
            if last[0].isalnum() and (ats and (sign or dots) and b - a >= 5 and last != "@" and low not in _AT or not letters and digits >= (7 if b - a < 7 or "." not in k.text[a:b] else 4)):
                out.append((a, b))
    return out


def features(k: Tokens, a: int, b: int) -> list[int]:
    """Indices of the features that hold for segment [a, b)."""
    parts = k.text[a:b]
    groups = [p for p in parts if p[0] in "0123456789"]
    digits = "".join(groups)
    n = len(digits)
    on = {"bias"}
    seps = {p for p in parts if not p[0].isalnum()}
    spaced = any(k.start[i] > k.end[i - 1] for i in range(a + 1, b))
    letters = any(p[0].isalpha() for p in parts)
    if not letters:
        on.add("digits 7-9" if 7 <= n < 10 else "digits 10" if n == 10 else "digits 11-13" if 10 < n < 14 else "digits 14-19" if 13 < n < 20 else "digits 20+" if n >= 20 else "bias")
        if 14 <= n <= 19 and luhn(digits):
            on.add("checksum")
        if seps <= {"-"}:
            on.add("only digits and separators")
        sizes = [len(g) for g in groups]
        if len(sizes) > 2 and all(s == 4 for s in sizes[:-1]):
            on.add("groups of four")
        if sizes[-2:] in ([3, 4], [2, 2]) or sizes[-3:] == [2, 2, 2] or len(sizes) in (3, 4) and 2 <= min(sizes) and max(sizes) <= 4:
            on.add("group shape of a phone")
        if sizes[-1] == 4:
            on.add("last group of four")
        plain = [p.strip("()[]") for p in "".join(parts).replace("(", "").replace(")", "").replace("[", "").replace("]", "").split(".")]
        if len(plain) == 4 and all(p.isascii() and p.isdigit() and small(p) for p in plain):
            on.add("four small parts")
        if len(groups) == 2 and "." in seps and len(seps) == 1:
            on.add("decimals")
    if parts[0] == "+":
        on.add("plus first")
    if "(" in seps and ")" in seps:
        on.add("parentheses")
    if b - a == 1:
        on.add("one token")
    if seps == {"."}:
        on.add("dots only")
    if len(seps - {"(", ")", "+"}) > 1:
        on.add("mixed separators")
    if digits.startswith("0"):
        on.add("starts zero")
    if letters:
        lows = [p.lower() for p in parts]
        where = [i for i, p in enumerate(lows) if p == "@" or p in _AT and i]
        if where:
            on.add("at sign" if "@" in lows else "at word")
            after = lows[where[0] + 1 :]
            first = a + where[0] + 1
            # a full stop within an address touches both its neighbours; else a sentence ends there
            dots = [i for i, p in enumerate(after) if p in _DOT or p == "." and k.start[first + i] == k.end[first + i - 1] and (first + i + 1 == len(k.text) or k.start[first + i + 1] == k.end[first + i])]
            if any(p == "." and i not in dots for i, p in enumerate(after)):
                on.add("sentence end inside")
            if dots and dots[0] > 0 and dots[-1] == len(after) - 2:
                on.add("dot or dot word after at")
            names = sum(1 for i in range(a, a + where[0]) if k.text[i][0].isalnum() and (i == a or k.start[i] > k.end[i - 1]))
            if names > 1 or not dots:
                on.add("words beside address")
            # two words side by side behind the "at" are a sentence going on
            if any(after[i][0].isalnum() and after[i + 1][0].isalnum() and after[i] not in _DOT and after[i + 1] not in _DOT for i in range(len(after) - 1)):
                on.add("words beside address")
        if 2 <= len(parts[-1]) <= 4 and parts[-1].isalpha() and lows[-1] not in _DOT | _AT:
            on.add("ends in short letters")
    if spaced:
        on.add("space inside")
    if a == 0 or k.start[a] > k.end[a - 1] or k.text[a - 1] in "(\"':;,=<[":
        on.add("clean left edge")
    if b == len(k.text) or k.start[b] > k.end[b - 1] or k.text[b] in ")\"';,:>].!?#$%&*|" and (b + 1 == len(k.text) or k.start[b + 1] > k.end[b] or not k.text[b + 1][0].isalnum()):
        on.add("clean right edge")
    before = {p.lower() for p in k.text[max(0, a - 4) : a]}
    for kind, words in _CUES.items():
        if before & words:
            on.add(f"cue {kind}")
    if before & _ANTI:
        on.add("anti-cue")
    return [_INDEX[f] for f in on]


def _lattice(k: Tokens) -> tuple[list[tuple[int, int]], np.ndarray]:
    spans = segments(k)
    x = np.zeros((len(spans), len(FEATURES)))
    for row, (a, b) in enumerate(spans):
        x[row, features(k, a, b)] = 1.0
    return spans, x


def best_segments(weights: np.ndarray, k: Tokens) -> list[tuple[int, int, int]]:
    """(first token, kind, past the last) of the best segmentation; a token outside scores zero."""
    spans, x = _lattice(k)
    if not spans:
        return []
    scores = x @ weights.T
    kind = scores.argmax(axis=1)
    value = scores.max(axis=1)
    ending: dict[int, list[int]] = {}
    for i, (_, b) in enumerate(spans):
        if value[i] > 0:
            ending.setdefault(b, []).append(i)
    best, back = [0.0] * (len(k.text) + 1), [-1] * (len(k.text) + 1)
    for at in range(1, len(k.text) + 1):
        best[at] = best[at - 1]
        for i in ending.get(at, ()):
            v = best[spans[i][0]] + value[i]
            if v > best[at]:
                best[at], back[at] = v, i
    out, at = [], len(k.text)
    while at:
        if back[at] >= 0:
            a, b = spans[back[at]]
            out.append((a, int(kind[back[at]]), b))
            at = a
        else:
            at -= 1
    return out[::-1]


def _gradient(weights: np.ndarray, n: int, spans: list[tuple[int, int]], x: np.ndarray, gold: dict[tuple[int, int], int]) -> np.ndarray:
    """Gradient of the log-likelihood of one sentence, by forward-backward over its segments."""
    score = x @ weights.T
    alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    alpha[0] = beta[n] = 0.0
    ends, starts = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
    for i, (a, b) in enumerate(spans):
        ends[b].append(i)
        starts[a].append(i)
    total = np.logaddexp.reduce(score, axis=1) if len(spans) else np.zeros(0)
    for at in range(1, n + 1):
        alpha[at] = np.logaddexp.reduce([alpha[at - 1], *(alpha[spans[i][0]] + total[i] for i in ends[at])])
    for at in range(n - 1, -1, -1):
        beta[at] = np.logaddexp.reduce([beta[at + 1], *(beta[spans[i][1]] + total[i] for i in starts[at])])
    a, b = np.array([s[0] for s in spans], int), np.array([s[1] for s in spans], int)
    chance = np.exp(alpha[a][:, None] + score + beta[b][:, None] - alpha[n])
    truth = np.zeros_like(chance)
    for i, s in enumerate(spans):
        if s in gold:
            truth[i, gold[s]] = 1.0
    return (truth - chance).T @ x


def sentences(count: int = SENTENCES, seed: int = 5) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Generated (text, [(start, kind, end)]) with entities in many spellings, and look-alikes."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghilmnoprstuv") for _ in range(rnd.randint(2, 8)))
    number = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))

    def card() -> str:
        n = rnd.choice((15, 16, 16, 16))
        d = number(n - 1)
        d += next(c for c in "0123456789" if luhn(d + c))
        return rnd.choice((d, d, " ".join(d[i : i + 4] for i in range(0, n, 4)), "-".join(d[i : i + 4] for i in range(0, n, 4)), ".".join(d[i : i + 4] for i in range(0, n, 4))))

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        return rnd.choice((f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{rnd.randint(20, 99)} {number(2)} {number(4)} {number(4)}", f"0{number(1)} {number(2)} {number(2)} {number(2)} {number(2)}", f"+1-{a}-{b}-{c}", f"0{number(3)} {number(3)} {number(4)}"))

    def ip() -> str:
        p = [str(rnd.randint(0, 255)) for _ in range(4)]
        return rnd.choice((".".join(p), ".".join(p), "[.]".join(p), "(.)".join(p)))

    def email() -> str:
        user, site, top = rnd.choice((word(), f"{word()}.{number(2)}", f"{word()}_{word()}")), rnd.choice((word(), f"mail{number(1)}.{word()}")), rnd.choice(("com", "org", "net", "de", "fr", "es"))
        return rnd.choice((f"{user}@{site}.{top}", f"{word()} at {word()} dot {top}", f"{word()} (at) {word()} (dot) {top}", f"{word()}[at]{word()}[dot]{top}", f"{word()} @ {word()}.{top}", f"{word()} [at] {word()}.{top}"))

    makers = (email, ip, card, phone)

    def bad_card() -> str:
        d = number(16)
        while luhn(d):
            d = number(16)
        return rnd.choice((d, d, " ".join(d[i : i + 4] for i in range(0, 16, 4))))

    decoys = (
        lambda: str(rnd.randint(1900, 2030)), lambda: f"{rnd.randint(1, 999)}.{number(2)}", bad_card, bad_card, lambda: f"{rnd.randint(1, 12)}.{rnd.randint(0, 30)}.{rnd.randint(0, 30)}",
        lambda: f"{rnd.randint(0, 23)}:{number(2)}", lambda: number(rnd.randint(7, 13)), lambda: number(rnd.randint(20, 30)), lambda: f"{rnd.randint(256, 999)}.{number(3)}.{number(3)}.{number(1)}",
        lambda: f"{rnd.randint(1990, 2029)}-{number(2)}-{number(2)}", lambda: f"{word()} at {word()} {word()}", lambda: f"order {number(10)}", lambda: f"version {rnd.randint(1, 9)}.{rnd.randint(0, 9)}.{rnd.randint(0, 9)}.{rnd.randint(0, 99)}",
        lambda: f"{number(3)},{number(3)},{number(3)}", lambda: f"isbn {number(3)}-{number(1)}-{number(4)}-{number(4)}-{number(1)}", lambda: f"we met at {word()} and the dot {word()}", lambda: f"@{word()}", lambda: f"{word()}, at {word()}. The", lambda: f"{word()} at. {word().title()}, to", lambda: f"{number(3)} {number(3)} {number(3)}", lambda: f"{number(4)} {number(4)}",
    )
    out = []
    for _ in range(count):
        text, spans = "", []
        for _ in range(rnd.randint(1, 3)):
            text += " ".join(word() for _ in range(rnd.randint(1, 4))) + " "
            if rnd.random() < 0.5:
                kind = rnd.randrange(4)
                if rnd.random() < 0.4:
                    text += rnd.choice(sorted(_CUES[KINDS[kind]] - {"e"})) + rnd.choice((" ", ": "))
                made = makers[kind]()
                spans.append((len(text), kind, len(text) + len(made)))
                text += made + rnd.choice((" ", ", ", ". ", "!! ", "### "))
            else:
                text += rnd.choice(decoys)() + rnd.choice((" ", ", ", ". ", "!! "))
        out.append((text + word(), spans))
    return out


def train(data: list[tuple[str, list[tuple[int, int, int]]]] | None = None, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (kind, feature): stochastic gradient ascent with per-weight rates, in a fixed order."""
    prepared = []
    for text, spans in data if data is not None else sentences():
        k = tokenise(text)
        first, last = {s: i for i, s in enumerate(k.start)}, {e: i + 1 for i, e in enumerate(k.end)}
        gold = {(first[a], last[b]): kind for a, kind, b in spans if a in first and b in last}
        lattice, x = _lattice(k)
        if lattice:
            prepared.append((len(k.text), lattice, x, gold))
    weights = np.zeros((len(KINDS), len(FEATURES)))
    weights[:, 0] = -2.0
    squared = np.full_like(weights, 1e-2)
    for _ in range(epochs):
        for n, lattice, x, gold in prepared:
            g = _gradient(weights, n, lattice, x, gold) - DECAY * weights
            squared += g * g
            weights += RATE * g / np.sqrt(squared)
    return weights


def _tokens_before(text: str, at: int, count: int) -> int:
    """Start of a token, ``count`` tokens or more before ``at`` (0 where there are fewer)."""
    step = 8 * count
    while True:
        low = max(0, at - step)
        while 0 < low < len(text) and (text[low - 1].isalnum() and text[low].isalnum() or text[low - 1].isspace() and text[low].isspace()):
            low -= 1  # not inside a token
        if low == 0 or sum(1 for _ in _TOKEN.finditer(text, low, at)) >= count:
            return low
        step *= 2


def _tokens_after(text: str, at: int, count: int) -> int:
    """End of the token ``count`` tokens after ``at``."""
    end = at
    for n, m in enumerate(_TOKEN.finditer(text, at)):
        if n == count:
            break
        end = m.end()
    return end


def _is_seed(text: str, m: re.Match) -> bool:
    """Whether some candidate can hold this match of ``_SEED``."""
    if m[0] == "@":
        return True
    if m[0][0] in "0123456789":
        digits = len(m[0]) if m[0].isdigit() else len(_NOT_DIGIT.sub("", m[0]))
        return digits >= 7 or digits >= 4 and "." in m[0]
    last, gaps = "", [1, 1]
    for n, t in enumerate(_TOKEN.finditer(text, m.end())):
        if n == MOST_TOKENS:
            break
        gaps = [gaps[1], t.start() - (m.end() if n == 0 else end)]
        if t[0].lower() in _DOT or last == "." and gaps == [0, 0]:
            return True
        last, end = t[0], t.end()
    return False


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of a text that hold all candidate segments, and the tokens their features look at."""
    out: list[list[int]] = []
    around = MOST_TOKENS + CUE_TOKENS
    for m in _SEED.finditer(text):
        if not _is_seed(text, m):
            continue
        if out and m.end() <= out[-1][1]:
            out[-1][1] = max(out[-1][1], _tokens_after(text, m.end(), around))
            continue
        low, high = _tokens_before(text, m.start(), around), _tokens_after(text, m.end(), around)
        if out and low <= out[-1][1]:
            out[-1][1] = high
        else:
            out.append([low, high])
    return [(low, high) for low, high in out]


def added_spans(text: str, base: list[tuple[int, int, int]], weights: np.ndarray) -> list[tuple[int, int, int]]:
    """Spans of the random field that touch no base span."""
    taken: list[list[int]] = []  # base spans, merged where they overlap
    for start, _, end in sorted(base):
        if taken and start < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], end)
        else:
            taken.append([start, end])
    out, at = [], 0
    for low, high in stretches(text):
        k = tokenise(text, low, high)
        for a, kind, b in best_segments(weights, k):
            start, end = k.start[a], k.end[b - 1]
            while at < len(taken) and taken[at][1] <= start:
                at += 1
            if at == len(taken) or taken[at][0] >= end:
                out.append((start, kind, end))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added for every row of ``docs``."""
    weights = train() if weights is None else weights

    def one(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {n: [] for n in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")}
        for text in batch.column(1).to_pylist():
            base = base_spans(text or "")
            more = added_spans(text or "", base, weights)
            for k, kind in enumerate(KINDS):
                out[f"n_{kind}"].append(sum(s[1] == k for s in base))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(sorted(base + more)))
            out["n_added"].append(len(more))
        return {"doc_id": batch.column(0), **out}

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    types = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.int64()]
    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), schema, one, types)
