import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siteweave.llm import encode
from tests.llm import plain
from tests.llm.test_mixing import wanted

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def rows(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_stages_keep_the_columns(stages):
    for name in ("toxicity", "near_duplicates", "decontamination", "mixing"):
        assert stages[name].schema.simpleString() == stages["documents"].schema.simpleString()


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    kept = {r.doc_id for r in stages["toxicity"].collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    toxic, clean = [r.doc_id for r in labels if r.toxic], [r.doc_id for r in labels if not r.toxic]
    assert sum(d in kept for d in toxic) <= 0.1 * len(toxic) and sum(d in kept for d in clean) >= 0.97 * len(clean)


def test_near_duplicates(stages):
    before = rows(stages["toxicity"])
    classes = plain.components(before, 5, 80)
    assert rows(stages["near_duplicates"]) == [(i, t) for i, t in before if classes[i][1] == i]


def test_decontamination(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = rows(stages["near_duplicates"])
    hit = {d for d, _ in plain.benchmark_hits(before, items)}
    assert rows(stages["decontamination"]) == [(i, t) for i, t in before if i not in hit]


def test_mixing(stages):
    before = stages["decontamination"].collect()
    sizes, got = defaultdict(int), defaultdict(int)
    for r in before:
        sizes[r.source] += len(plain.words(r.text))
    for r in stages["mixing"].collect():
        got[r.source] += len(plain.words(r.text))
    target = wanted(sizes)
    assert sum(abs(got[s] - target[s]) for s in target) <= 0.03 * sum(target.values())


def test_token_files(stages):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(encode.tokenizer_path())
    want, start = [], 0
    for doc_id, text in rows(stages["mixing"]):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in stages["token_files"].collect()) == sorted(want)


def test_run_is_the_stages_one_after_the_other(spark, stages):
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == sorted(tuple(r) for r in stages["token_files"].collect())
    assert re.fullmatch(r"[a-z_]+", corpus_pipeline.STAGES[0][0])


def folder_with(spark, path, documents):
    """A folder of tables: these documents and the given labels and benchmark."""
    documents.coalesce(1).write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_odd_rows_and_clashing_columns(spark, stages, tmp_path):
    """Null ids, null and empty texts, repeated rows and columns named like inner ones: defined results, and other documents as before."""
    docs = stages["documents"]
    first = docs.orderBy("doc_id").limit(1)
    none = first.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema])
    empty = first.withColumn("text", F.lit("")).withColumn("doc_id", F.lit(-1).cast("long"))
    odd = docs.unionByName(none).unionByName(none).unionByName(empty).unionByName(first)
    for name in ("_row", "_key", "h", "size", "n", "score", "label"):
        odd = odd.withColumn(name, F.lit("x"))
    sf = folder_with(spark, tmp_path / "tables", odd)
    rows_, kept = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, rows_, sf).write.parquet(str(tmp_path / name))
        rows_ = kept[name] = spark.read.parquet(str(tmp_path / name))
        assert rows_.columns == odd.columns
    before = {(r.doc_id, r.text) for r in stages["decontamination"].collect()}
    after = [(r.doc_id, r.text) for r in kept["decontamination"].collect()]
    assert {r for r in after if r[1]} == before and len([r for r in after if r[1]]) == len(before)  # the repeated row went
    assert sum(r == (None, None) for r in after) == 2 and (-1, "") in after  # texts without words are linked with nothing
    files = corpus_pipeline.STAGES[-1][1](spark, rows_, sf).collect()
    assert len(files) == rows_.count() and {r.doc_id for r in files} == {r.doc_id for r in rows_.collect()}


def test_empty_documents(spark, stages, tmp_path):
    sf = folder_with(spark, tmp_path / "tables", stages["documents"].limit(0))
    assert corpus_pipeline.run(spark, sf).collect() == []
