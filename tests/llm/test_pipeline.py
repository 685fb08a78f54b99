"""The corpus pipeline against its stages run apart, and the registered queries."""

import glob

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from netweave.llm import common, quality_model
from tests.llm import brute


def test_pipeline_against_plain_steps(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows = [(i, t) for i, t in rows if brute.kept(t)]
    model = quality_model.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = quality_model.Scorer(*model).scores([t or "" for _, t in rows])
    rows = [r for r, s in zip(rows, scores) if s >= 0.5]
    last = {t or "": i for i, t in sorted(rows)}
    rows = [(i, t) for i, t in rows if last[t or ""] == i]
    rows = [(i, t) for i, t in rows if brute_components(rows)[i][1] == i]
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in rows}
    found = corpus_pipeline.run(spark, sf_dir).collect()
    got = {}
    for r in found:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want
    fill = {}
    for r in found:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert np.mean([n < 1024 for n in fill.values()]) * len(fill) <= 1


_seen = {}


def brute_components(rows):
    key = len(rows)
    if key not in _seen:
        _seen[key] = brute.components(rows, 5, 80)
    return _seen[key]


def test_stages_keep_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns, name


def test_pipeline_on_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_on_awkward_rows(spark, sf_dir):
    """Nulls in any column, repeated rows and clashing names go through every stage."""
    from tests.llm.tables import corpus, documents

    rows = [(i, t) for i, t in corpus(size=40)] + [(None, None), (None, "a b c"), (12, "x y"), (12, "x y")]
    docs = documents(spark, rows).withColumns({c: F.lit(None).cast("string") for c in ("lang", "source")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.count() <= len(rows), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= len(rows)


def test_queries_and_oracles():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)


def test_stored_texts_are_written_in_small_groups(spark):
    """A task that stores 40 MB of texts holds 16 MB of them at a time, about, as 8 such tasks may share a heap of 1 GB."""
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(160)), lambda i: F.sha2(F.concat_ws("-", "id", i), 256)), "")
    docs = spark.range(0, 4000, 1, 1).select("id", text.alias("text"))
    stored = common.Scratch(spark, "groups").store(common.arrow_map(docs, lambda batches: batches, docs.schema), "texts")
    files = glob.glob(stored._netweave_path.removeprefix("file://") + "/*.parquet")
    groups = [f.metadata.row_group(i) for f in map(pq.ParquetFile, files) for i in range(f.metadata.num_row_groups)]
    assert len(files) == 1 and sum(g.num_rows for g in groups) == 4000
    assert max(g.total_byte_size for g in groups) < 1.5 * common.GROUP_BYTES
