"""The stages of the corpus pipeline against brute force, and on awkward and empty tables."""

import os
import re

import pytest

pytest.importorskip("corpus_pipeline")

import corpus_pipeline  # noqa: E402
from pointloom.llm import decontaminate, mixing, quality  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
STAGES = dict(corpus_pipeline.STAGES)


def first_of_equal(docs):
    seen, out = {}, set()
    for d, t in sorted(docs.items()):
        out |= {d} if seen.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), d) == d else set()
    return out


def first_of_near(docs):
    """Classes of five-word shingle sets of Jaccard similarity 0.8 or more, by comparing all pairs."""
    sets = {}
    for d, t in docs.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[d] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    label = {d: d for d in docs}
    names = sorted(docs)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {d: low if c == high else c for d, c in label.items()}
    return {d for d in docs if label[d] == d}


def without_items(docs, items):
    """Texts that hold no item within its budget: the item's whole pattern run over every whole text."""
    wanted = [(p, decontaminate.masks_of(p)) for t in items if len(p := decontaminate.normalise(t)) >= decontaminate.LEAST_BYTES]
    return {d for d, t in docs.items() if not any(decontaminate.myers(p, m, decontaminate.normalise(t), int(0.12 * len(p)))[0] <= int(0.12 * len(p)) for p, m in wanted)}


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, items = spark.read.parquet(f"{SF}/labels.parquet"), [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    left = {r["doc_id"] for r in quality.score(docs, labels).filter("score >= 0.5").collect()}
    told = {"quality": left, "exact_dedup": first_of_equal({d: text[d] for d in left})}
    told["near_dedup"] = first_of_near({d: text[d] for d in told["exact_dedup"]})
    told["decontaminate"] = without_items({d: text[d] for d in told["near_dedup"]}, items)
    assert len(text) > len(left) > len(told["exact_dedup"]) and len(told["near_dedup"]) > len(told["decontaminate"]) > 0
    now = docs
    for name, want in told.items():
        now = STAGES[name](spark, now, SF)
        assert now.columns == docs.columns
        rows = now.collect()
        assert {r["doc_id"] for r in rows} == want and len(rows) == len(want) and all(r["text"] == text[r["doc_id"]] for r in rows), name
        now = spark.createDataFrame(rows, docs.schema)
    mixed = sorted(map(str, mixing.mix(now).collect()))
    assert mixed == sorted(map(str, corpus_pipeline.run(spark, SF).collect())) and len(mixed) == len(told["decontaminate"])


def test_no_text_is_shuffled(spark):
    """With ids of their own, rows are dropped where they stand: the documents' scan reaches the result without an exchange."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name in ("quality", "exact_dedup", "near_dedup", "decontaminate"):
        out = STAGES[name](spark, docs, SF)
        out.write.format("noop").mode("overwrite").save()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan, (name, plan)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_awkward_tables(spark, awkward, empty, name):
    out = STAGES[name](spark, awkward, SF)
    kept = out.collect()
    assert STAGES[name](spark, empty, SF).count() == 0
    if name == "mix":
        assert len(kept) == awkward.count()
        return
    assert out.columns == awkward.columns and {str(r) for r in kept} <= {str(r) for r in awkward.collect()}
    if name == "exact_dedup":  # one row of each different text
        norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in kept]
        assert sorted(norm) == sorted({re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in awkward.collect()})
    if name == "near_dedup":
        assert sum(r["doc_id"] is None for r in kept) == 2
    if name == "decontaminate":
        assert len(kept) == awkward.count()


def test_empty_labels_and_benchmark(spark, awkward, tmp_path):
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{table}.parquet").limit(0).write.parquet(str(tmp_path / f"{table}.parquet"))
    for name in ("quality", "decontaminate"):
        assert STAGES[name](spark, awkward, str(tmp_path)).count() == awkward.count()
