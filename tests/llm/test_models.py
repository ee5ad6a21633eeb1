"""Classifiers on held-out rows, extraction on made pages, decontamination, mixing, the pipeline."""

import math
import os
import random
import zlib

import numpy as np
import pytest

from pointloom.llm import decontaminate, html_text, language, mixing, quality

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


def held(i, mod, rest):
    return zlib.crc32(str(i).encode()) % mod == rest


# ---- language ----


@tables
def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = language.identify(docs).collect()
    assert len(got) == len(lang) and all(r["held_out"] == held(r["doc_id"], 5, 0) and 0 <= r["score"] <= 1 for r in got)
    out = [r for r in got if r["held_out"] and lang[r["doc_id"]]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in out) / len(out) > 0.98


def test_families_come_from_the_data():
    rnd = random.Random(1)
    make = lambda letters: [language.vector(" ".join("".join(rnd.choice(letters) for _ in range(5)) for _ in range(60))) for _ in range(12)]
    rows = [("a1", v) for v in make("abcdex")] + [("a2", v) for v in make("abcdey")] + [("b1", v) for v in make("mnopqx")] + [("b2", v) for v in make("mnopqy")]
    model = language.fit(rows)
    assert sorted(map(tuple, model.families)) == [("a1", "a2"), ("b1", "b2")]
    assert model.predict(["abc dey aby eyd cya", "12", "mno pqx nxo", None])[0] == ["a2", "und", "b1", "und"]


def brute_prediction(model, text):
    """The hierarchy's rule spelled out for one text, machine by machine."""
    x = np.append(language.vector(text), 1)
    chance = lambda m: 1 / (1 + math.exp(-3 * m))
    against = sorted(((float(w @ x), -f) for f, w in enumerate(model.between)), reverse=True)
    f, score = -against[0][1], chance((against[0][0] - against[1][0]) / 2)
    names, margin = model.families[f], {}
    pairs = [(a, b) for a in range(len(names)) for b in range(a + 1, len(names))]
    for (a, b), w in zip(pairs, model.inside[f]):
        margin[a, b], margin[b, a] = float(w @ x), -float(w @ x)
    won = {a: (sum(margin[a, b] > 0 for b in range(len(names)) if b != a), sum(margin[a, b] for b in range(len(names)) if b != a)) for a in range(len(names))}
    best = max(won, key=lambda a: won[a])
    return names[best], score * chance(min((margin[best, b] for b in range(len(names)) if b != best), default=math.inf))


def made_languages(count, rows, seed=3):
    """(language, text) of invented languages, each with words of its own; four at a time share others."""
    rnd, words = random.Random(3), {}
    make = lambda n: ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyzéüñł") for _ in range(rnd.randint(2, 6))) for _ in range(n)]
    for k in range(count):
        shared = make(25) if k % 4 == 0 else shared
        words[k] = shared + make(15)
    rnd.seed(seed)
    return [(f"l{k:03}", " ".join(rnd.choice(words[k]) for _ in range(60))) for k in range(count) for _ in range(rows)]


def test_prediction_against_brute_force():
    made = made_languages(12, 10)
    model = language.fit([(n, language.vector(t)) for n, t in made])
    texts = [t for _, t in made_languages(12, 3, seed=4)] + [t[:9] for _, t in made] + [t for _, t in made]
    names, scores = model.predict(texts)
    want = [brute_prediction(model, t) for t in texts]
    assert names == [w[0] for w in want] and np.allclose(scores, [w[1] for w in want], atol=1e-5) and max(map(len, model.families)) > 2


def test_three_hundred_languages(spark):
    made = made_languages(300, 12)
    df = spark.createDataFrame([(i, t, n) for i, (n, t) in enumerate(made)], "doc_id long, text string, lang string").repartition(6)
    rows = language.training_rows(df)
    assert len(rows) <= language.MOST_ROWS and len({n for n, _ in rows}) == 300
    model = language.fit(rows)
    assert max(map(len, model.families)) <= language.MOST_FAMILY and sum(len(m) for m in model.inside) <= 300 * language.MOST_FAMILY / 2
    held = [(n, t) for i, (n, t) in enumerate(made) if zlib.crc32(str(i).encode()) % 5 == 0][:300]
    assert sum(a == n for a, (n, _) in zip(model.predict([t for _, t in held])[0], held)) >= 0.95 * len(held)


def test_training_rows_are_bounded_where_ids_repeat(spark):
    df = spark.createDataFrame([(1, f"text number {'abc'[i % 3] * i}", "en") for i in range(500)] + [(8, "noch ein Text", "de")], "doc_id long, text string, lang string")
    rows = language.training_rows(df, per_language=7)
    assert sorted(n for n, _ in rows) == ["de"] + ["en"] * 7


def test_vectors_do_not_depend_on_slices(monkeypatch):
    texts = ["one two threé fōur " * 50, "a", "ab", " é "]
    whole = [language.vector(t) for t in texts]
    for size in (1, 2, 3, 7, 100):
        monkeypatch.setattr(language, "BYTES_AT_ONCE", size)
        assert all(np.allclose(language.vector(t), w) for t, w in zip(texts, whole))


def test_language_edges(spark, awkward, empty):
    got = language.identify(awkward).collect()
    assert len(got) == awkward.count()
    text = {(r["doc_id"], r["text"]) for r in awkward.collect()}
    assert all(r["lang_pred"] == "und" for r in got if all(not any(c.isalpha() for c in t or "") for d, t in text if d == r["doc_id"]))
    assert language.identify(empty).count() == 0
    nothing = language.identify(awkward.withColumn("lang", awkward["lang"].substr(100, 1)).selectExpr("doc_id", "text", "cast(null as string) as lang"))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}


# ---- quality ----


@tables
def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    got = quality.score(docs, labels).collect()
    assert all(r["held_out"] == held(r["doc_id"], 3, 1) and r["predicted"] == (r["score"] >= 0.5) for r in got)
    out = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in out) / len(out) > 0.97


def test_discriminant_against_plain_formula(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    d = len(quality.FEATURES)
    x = [rng.normal(size=(80, d)), rng.normal(size=(60, d)) * 1.7 + 0.8]
    rows = spark.createDataFrame([(v.tolist(), k) for k in (0, 1) for v in x[k]], "f array<double>, quality int")
    model = quality.fit(rows)
    cov = [np.cov(v.T, bias=True) for v in x]
    pooled = (80 * cov[0] + 60 * cov[1]) / 140
    test = rng.normal(size=(20, d))
    log = []
    for k in (0, 1):
        c = (1 - quality.RIDGE) * ((1 - quality.POOL) * cov[k] + quality.POOL * pooled) + quality.RIDGE * np.diag(np.diag(pooled)) + 1e-9 * np.eye(d)
        e = test - x[k].mean(axis=0)
        log.append(np.log((80, 60)[k] / 140) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", e, np.linalg.inv(c), e))
    assert np.allclose(model.scores(test), 1 / (1 + np.exp(log[0] - log[1])))


def test_quality_edges(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (4, None, 0), (5, 7, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(awkward, labels).collect()
    assert len(got) == awkward.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score(empty, labels).count() == 0 and {r["score"] for r in quality.score(awkward, labels.limit(0)).collect()} == {0.5}
    assert quality.kept_documents(awkward, labels).columns == awkward.columns
    # one class alone says nothing: all rows stay; two rows of either class are fitted
    assert quality.kept_documents(awkward, labels).count() == awkward.count() and quality.kept_documents(empty, labels).count() == 0
    few = spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, quality int")
    scores = {r["doc_id"]: r["score"] for r in quality.score(awkward, few).collect()}
    assert scores[7] > 0.9 > 0.1 > scores[8]


@tables
def test_quality_stage_keeps_what_the_query_predicts(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    assert {r["doc_id"] for r in quality.kept_documents(docs, labels).collect()} == {r["doc_id"] for r in quality.score(docs, labels).filter("predicted = 1").collect()}


# ---- pages ----

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1><nav><a href=x>Home</a></nav></header>
<div class="cookie-notice"><p>We use cookies, a lot of them, really.</p></div><div id="main-12"><article class="post-99"><header><h2>Title &amp; more</h2></header>
<p>First with <a href="y">a link</a> and <b>bold</b>.<p>Second
 para<br>line &lt;b&gt;.<ul><li>one<li>two</ul><form><input name=a><label>Mail</label></form><div class="ad-slot">Buy</div><aside>Side</aside>
<section id="comments"><p>Nice article, I liked it very much, thank you, really.</p></section></article></div><div class="sidebar">Rail</div><footer>(c)</footer><script>var t="</p>";</script></body></html>"""


def test_extraction_leaves_the_rest_out():
    want = "Title & more\nFirst with a link and bold.\nSecond para line <b>.\none\ntwo"
    assert html_text.extract(PAGE, html_text.votes(PAGE)[0][0]) == html_text.extract(PAGE) == want
    assert html_text.votes(PAGE)[0][2] == "body>div#main-#>article.post-#"


def test_wrapper_with_an_unlucky_name():
    page = "<body><div class='page widget-wrap'><div class=post><h1>T</h1><p>" + "Some words, here. " * 9 + "</p></div><div class=sidebar><h2>x</h2>Rail</div></div><div class=comments><p>" + "Nice. " * 9 + "</p></div></body>"
    assert html_text.extract(page) == "T\n" + ("Some words, here. " * 9).strip()


@pytest.mark.parametrize(("page", "want"), [(None, ""), ("", ""), ("plain  text", "plain text"), ("<p>open <b>x", "open x"), ("a < b and <3 c", "a < b and <3 c"), ("<div" * 3, "<div<div<div"), ("<p>a</p></p></div><p>b", "a\nb"), ("<!-- x --><script>no</script>", ""), ("<p>&#233;&eacute;&amp;amp;", "éé&amp;")])
def test_broken_pages(page, want):
    assert html_text.extract(page) == want


def test_hosts_vote(spark):
    good = "<html><body><div class=story><p>" + "Long text, with marks. " * 10 + "</p></div><div class=more><p>short.</p></div></body></html>"
    odd = "<html><body><div class=story><p>Tiny.</p></div><div class=more><p>" + "Other text, with marks. " * 10 + "</p></div></body></html>"
    rows = [(i, "http://a.example/x", good, "p") for i in range(3)] + [(3, "http://a.example/y", odd, "p"), (4, "http://b.example/y", odd, "p"), (5, None, None, None), (None, "no url", "<p>x</p>", "q")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, path string")
    got = {r["page_id"]: r for r in html_text.main_text(pages).collect()}
    assert got[3]["text"] == "Tiny." and got[4]["text"].startswith("Other text") and got[5]["text"] == "" and got[None]["text"] == "x"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values()) and html_text.main_text(pages.limit(0)).count() == 0


# ---- benchmark ----


def distance_brute(p, t):
    last = [0] * (len(t) + 1)
    for i in range(1, len(p) + 1):
        row = [i]
        for j in range(1, len(t) + 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (p[i - 1] != t[j - 1])))
        last = row
    return min(last)


def test_myers_against_dynamic_programming():
    rnd = random.Random(2)
    for _ in range(300):
        p, t = (bytes(rnd.choice(b"abc") for _ in range(n)) for n in (rnd.randint(1, 80), rnd.randint(80, 120)))
        assert decontaminate.myers(p, decontaminate.masks_of(p), t, 99)[0] == distance_brute(p, t)


def test_partner_with_one_edit():
    def whole(p, t):
        last = list(range(len(t) + 1))
        for i in range(1, len(p) + 1):
            row = [i]
            for j in range(1, len(t) + 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (p[i - 1] != t[j - 1])))
            last = row
        return last[-1]

    rnd = random.Random(6)
    for _ in range(4000):
        want, text = (bytes(rnd.choice(b"ab") for _ in range(n)) for n in (rnd.randint(1, 7), rnd.randint(0, 9)))
        text = text[: len(want) + 1]
        assert decontaminate.within_one(want, text) == any(whole(want, text[:j]) <= 1 for j in range(len(text) + 1)), (want, text)


@pytest.mark.parametrize("k", range(0, 30))
def test_leaves_cover_an_item(k):
    leaves = list(decontaminate.ancestry(0, 400, k))
    assert len(leaves) == k + 1 and [a for a, _, _ in leaves] == [0] + [b for _, b, _ in leaves[:-1]] and leaves[-1][1] == 400
    for a, b, above in leaves:
        assert all(low <= a and b <= high for low, high, _ in above) and [n[2] for n in above] == sorted(n[2] for n in above)


def test_matches_against_brute_force(spark, awkward):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rnd.randint(8, 20)))) for i in range(12)] + [(50, None), (51, "short"), (None, "x" * 60), (52, "!? "), (53, "Abc, fed"), (54, "gag"), (55, "abcdefghabcdefghabcdefg"), (56, "abcdefghabcdefghabcdefgh")]
    docs = []
    for d in range(80):
        text = " ".join(word() for _ in range(30))
        if d % 2:
            item = list(rnd.choice(items[:12])[1])
            for _ in range(rnd.randint(0, len(item) // 8)):
                item[rnd.randrange(len(item))] = rnd.choice(["", "zz", "q", " "])
            text = text[:60] + ", " + "".join(item).upper() + "! " + text[60:]
        if d % 5 == 0:
            text = rnd.choice((f"{text} abc fed", f"gag {text}", f"{text} gagged", f"{text[:70]} short {text[70:]}", f"{text} ABC. Fed! {text}", "abcdefghabcdefghabcdefg", "abcdefghabcxefghabcdefg abcdefghabcxefghabcdefgh"))
        docs.append((d, text))
    df = spark.createDataFrame(docs + [(None, None), (81, "")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for d, text in docs:
        for i, item in items:
            p = decontaminate.normalise(item)
            if len(p) < decontaminate.LEAST_BYTES:  # whole words, no error
                if p and b" " + p + b" " in b" " + decontaminate.normalise(text) + b" ":
                    want.append((d, i, 0))
            elif (n := distance_brute(p, decontaminate.normalise(text))) <= int(len(p) * decontaminate.ERROR_RATE):
                want.append((d, i, n))
    assert {51, 53, 54, 56} <= {w[1] for w in want}
    for block in (1 << 20, 300):
        got = decontaminate.matches(df, bench, block_bytes=block).collect()
        assert sorted((r["doc_id"], r["item_id"], r["distance"]) for r in got) == sorted(want)
    kept = decontaminate.kept_documents(df, bench)
    assert kept.count() == 82 - len({w[0] for w in want if w[1] not in (51, 53, 54, 55)})
    got = decontaminate.nearest_matches(awkward, bench).collect()
    assert [(r["doc_id"], r["item_id"], r["distance"]) for r in got] == [(7, None, 0)] and decontaminate.matches(df, bench.limit(0)).count() == 0


# ---- mix ----


def targets_brute(words):
    order = sorted(words, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    out, left = {}, sum(words.values())
    while True:
        open_ = [s for s in order if s not in out and words[s]]
        if not open_:
            break
        share = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if share * weight[s] > 3 * words[s]]
        if not over:
            return {s: out.get(s, share * weight[s] if words[s] else 0.0) for s in order}
        for s in over:
            out[s] = 3.0 * words[s]
            left -= out[s]
    return {s: out.get(s, 0.0) for s in order}


def test_targets(spark):
    rnd = random.Random(4)
    for _ in range(4):
        words = {s: rnd.choice((0, 5, 100, 10000, 1)) for s in rnd.sample(["a", "b", "c", "d", "e", "", "é", None], rnd.randint(1, 8))}
        got = {r["s"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(words.items()), "s string, words long")).collect()}
        want = targets_brute(words)
        assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in words), (words, got, want)


def tilt_brute(sizes, target):
    """The dual of a source by halving alone, and the rates."""
    mean = sum(sizes) / len(sizes)
    reached = lambda v: sum(z * min(3.0, math.exp(max(-700, min(700, v * z / mean)))) for z in sizes)
    low, high = -1e9, 1e9
    for _ in range(300):
        low, high = ((low + high) / 2, high) if reached((low + high) / 2) < target else (low, (low + high) / 2)
    return [min(3.0, math.exp(max(-700, min(700, low * z / mean)))) for z in sizes]


def test_rates_are_capped_exponential_tilts(spark):
    rnd = random.Random(15)
    rows = [(i, "w " * int(rnd.paretovariate(0.9) * 3), f"s{i % 7}" if i % 11 else "s1") for i in range(700)] + [(900, "w " * 90_000, "s1"), (901, "w", "s1")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in {r["source"] for r in got}:
        mine = [r for r in got if r["source"] == s]
        if mine[0]["target"] < 3 * mine[0]["source_size"]:
            want = tilt_brute([r["size"] for r in mine], mine[0]["target"])
            assert all(abs(r["rate"] - w) < 3e-6 for r, w in zip(mine, want)), s
        else:
            assert {r["rate"] for r in mine} == {3.0}
        assert all(math.floor(r["rate"]) <= r["copies"] <= math.ceil(r["rate"]) for r in mine)


def test_many_sources(spark):
    """No table of sources reaches the driver beyond its bound."""
    df = spark.range(200_000).selectExpr("id doc_id", "repeat('w ', cast(1 + pmod(id * 7, 13) as int)) text", "concat('host', cast(id as string), '.example') source")
    out = mixing.mix(df)
    rows = out.selectExpr("count(*) n", "sum(taken) taken", "sum(size) size", "max(taken - 3 * size) over_", "sum(target) target").first()
    assert rows["n"] == 200_000 and rows["over_"] <= 0 and abs(rows["target"] - rows["size"]) < 1e-6 * rows["size"]


def test_mix_reaches_targets(spark, awkward, empty):
    rnd = random.Random(5)
    rows = [(i, "w " * int(rnd.paretovariate(1.2) * 5), rnd.choice(["s0", "s0", "s0", "s1", "s2", None, "tiny" if i < 4 else "s3"])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(df).collect()
    assert len(got) == 3000 and all(r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 3 * r["size"] for r in got)
    for s in {r["source"] for r in got}:
        mine = [r for r in got if r["source"] == s]
        assert sum(r["size"] for r in mine) == mine[0]["source_size"]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= max(0.02 * mine[0]["target"], max(r["size"] for r in mine)), s
        # rates are the exponential tilt that meets the target
        assert abs(sum(r["rate"] * r["size"] for r in mine) - mine[0]["target"]) < 1e-3 * mine[0]["target"]
    again = mixing.mix(df.repartition(3)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in again)
    assert mixing.mix(empty).count() == 0
    odd = {(r["doc_id"], r["source"]): r for r in mixing.mix(awkward).collect()}
    assert odd[0, None]["size"] == 0 and odd[0, None]["taken"] == 0 and mixing.mix(awkward).count() == awkward.count()


# ---- pipeline ----


@tables
def test_pipeline(spark):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sf = "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontaminate", "mix"]
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, sf)
        assert after.columns == docs.columns
        now = spark.createDataFrame(after.collect(), docs.schema)
    by_hand = corpus_pipeline.STAGES[-1][1](spark, now, sf).collect()
    assert sorted(map(str, by_hand)) == sorted(map(str, corpus_pipeline.run(spark, sf).collect()))
    assert 0 < len(by_hand) < docs.count()
