"""The pipeline against plain Python, stage by stage, on the small tables."""

import sys

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tallyglass.llm import quality_model, quality_rules, ragged
from tallyglass.llm.queries import LEAST_QUALITY, train_labels
from tokenizers import Tokenizer

from test_dedup import SPACE, expected_classes
from test_rules import measured


def good(model, text):
    data, offsets = ragged.flat(pa.array([text], pa.string()))
    buckets, _ = quality_model.features(data, offsets)
    odds = model.weights[buckets].astype(float).mean() + model.bias if len(buckets) else model.bias
    return 1 / (1 + np.exp(-odds)) >= LEAST_QUALITY


def regular(text):
    words, chars, symbols, lines, repeated, all_lines = measured(text)
    return not (
        words < 50
        or 100 * repeated > 50 * words
        or symbols > 50 and 100 * symbols > 40 * words
        or lines >= 5 and 100 * lines > 30 * all_lines
        or chars > 25 * words
        or chars < 2 * words
    )


def without_copies(docs):
    groups = {}
    for i, text in docs:
        groups.setdefault(SPACE.sub("", text or ""), []).append((-len(text or ""), i, text))
    return sorted((min(g)[1], min(g)[2]) for g in groups.values())


def without_near_copies(docs):
    classes = expected_classes([t for _, t in docs])
    return [docs[c] for c in sorted(set(classes))]


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Documents after each stage by plain Python; only the fitted model is shared."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = sorted((r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect())
    model = quality_model.fit(table, train_labels(spark, sf_dir), "quality")
    kept = [[d for d in docs if good(model, d[1])]]
    kept.append([d for d in kept[-1] if regular(d[1])])
    kept.append(without_copies(kept[-1]))
    kept.append(without_near_copies(kept[-1]))
    return kept


def test_names_and_rules_in_order():
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == [
        "quality_classifier", "quality_rules", "exact_dedup", "near_dedup", "packing"
    ]
    assert list(quality_rules.RULES)[:2] == list(quality_rules.POLICIES["base"])


def test_every_stage_keeps_what_plain_python_keeps(spark, sf_dir, stages, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for (name, stage), wanted in zip(corpus_pipeline.STAGES[:-1], stages):
        out = stage(spark, docs, sf_dir)
        assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert sorted(docs.select("doc_id", "text").collect()) == wanted, name


def test_the_sequences_hold_the_kept_documents(spark, sf_dir, stages):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = {}
    for r in sorted(corpus_pipeline.run(spark, sf_dir).collect(), key=lambda r: r["start"]):
        ids = found.setdefault(r["doc_id"], [])
        assert len(ids) == r["start"]
        ids += np.frombuffer(bytes(r["ids"]), "<u4").tolist()
    wanted = {
        i: [*library.encode(text or "", add_special_tokens=False).ids, 2] for i, text in stages[-1]
    }
    assert found == wanted


def test_stages_with_odd_columns_and_rows(spark, sf_dir, make_docs):
    good = " ".join(f"word{i}" for i in range(80))
    docs = make_docs([good, None, "", good, good.upper(), "x " * 90], [1, 2, 3, None, 5, 6])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert "Row" in docs.columns and "n_words" in docs.columns, name
    assert docs.count() <= 1
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf_dir).count() == 0
    assert "corpus_pipeline" in sys.modules
