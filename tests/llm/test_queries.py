"""Every registered query against its SQL, and every stage of the pipeline against plain Python."""

from __future__ import annotations

import hashlib
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from chainmark.llm import neardup, templates, toxicity
from chainmark.llm.queries import QUERIES, SQL
from chainmark.llm.work import table

from ..oracle import SF, from_sql, plain
from . import test_contamination, test_mixing, test_neardup
from .fixtures import documents, rows, sentence
from .test_boilerplate import own


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal_sql(spark: SparkSession, name: str) -> None:
    got, want = QUERIES[name](spark, SF).toPandas(), from_sql(SQL[name])
    assert plain(got[sorted(want.columns)]) == plain(want)


@pytest.fixture(scope="module")
def case(spark: SparkSession, tmp_path_factory: pytest.TempPathFactory) -> tuple[DataFrame, str, list, list]:
    """(documents, folder of tables, rows, benchmark items): every awkward row, with labels and a benchmark."""
    r = random.Random(11)
    items = [(i, sentence(r, 30)) for i in range(4)]
    data = rows() + [(200 + i, f"{sentence(r, 10)} {items[i][1]} {sentence(r, 10)}") for i in range(4)]
    data += [(300 + i, f"{own(i)}\nread more about it on our site\n{own(i + 11)}") for i in range(6)]
    at = str(tmp_path_factory.mktemp("tables"))
    docs = documents(spark, data)
    docs.write.parquet(f"file://{at}/documents.parquet")
    spark.createDataFrame([(i, f"{i}", 0 if i % 3 else 1, 1) for i in range(400)], "doc_id long, text string, toxic int, quality int").write.parquet(f"file://{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{at}/benchmark.parquet")
    return docs, f"file://{at}", data, items


def key(i: object, t: object) -> tuple[str, str]:
    return str(i), hashlib.sha1(repr(t).encode()).hexdigest()


def of(df: DataFrame) -> list[tuple[str, str]]:
    return sorted(key(r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_toxic_documents_go(spark: SparkSession, case: tuple) -> None:
    docs, at, data, _ = case
    kept = corpus_pipeline.drop_toxic(spark, docs, at)
    score = toxicity.scorer(toxicity.fit(docs, table(spark, at, "labels")))

    want = [(i, t) for (i, t), s in zip(data, score(pa.array([t for _, t in data], pa.string())).tolist(), strict=True) if s < toxicity.THRESHOLD]
    assert kept.columns == docs.columns
    assert of(kept) == sorted(key(*x) for x in want)


def test_boilerplate_lines_go(spark: SparkSession, case: tuple) -> None:
    """Only lines that recur are taken out, the first document keeps them, and every row stays."""
    docs, at, data, _ = case
    found = corpus_pipeline.drop_boilerplate(spark, docs, at)
    assert found.columns == docs.columns
    by = {(r.doc_id, r.text): r.n_chars for r in found.collect()}
    assert found.count() == len(data)
    line = "read more about it on our site"
    assert {i: line in t for i, t in by if i is not None and 300 <= i < 306} == {300: True} | dict.fromkeys(range(301, 306), False)
    untouched = {(i, t) for i, t in data if not t or line not in t}
    assert untouched <= set(by) or all(i in {x for x, _ in by} for i, _ in untouched)
    assert all(n == len(t) for (i, t), n in by.items() if t is not None)
    assert templates.MIN_DOCS == 3


def test_one_of_each_group_stays(spark: SparkSession, case: tuple) -> None:
    docs, at, data, _ = case
    found = corpus_pipeline.keep_one_of_each(spark, docs, at)
    kept = {i for i, _, _, k in test_neardup.brute(data) if k and i is not None}
    assert found.columns == docs.columns
    want = {key(i, t) for i, t in data if i in kept}
    assert of(found) == sorted([*want, *(key(i, t) for i, t in data if i is None)])
    assert neardup.PERCENT == 75


def test_contaminated_documents_go(spark: SparkSession, case: tuple) -> None:
    docs, at, data, items = case
    found = corpus_pipeline.drop_contaminated(spark, docs, at)
    assert found.columns == docs.columns
    want = [x for x in data if not test_contamination.brute([x], items)[0][-1]]
    assert len(want) < len(data)
    assert of(found) == sorted(key(*x) for x in want)


def test_mix_of_sources(spark: SparkSession, case: tuple) -> None:
    docs, at, data, _ = case
    found = corpus_pipeline.mix_sources(spark, docs, at).collect()
    assert sorted((str(r.doc_id), r.size) for r in found) == sorted((str(i), len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t in data)
    words: dict = {}
    for r in found:
        words[r.source] = words.get(r.source, 0) + r.size
    want = test_mixing.water(words)
    assert all(abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and r.taken <= 3 * r.size for r in found)


def test_run_chains_the_stages(spark: SparkSession, case: tuple) -> None:
    docs, at, data, items = case
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near dedup", "decontamination", "mixing"]
    got = {r.doc_id for r in corpus_pipeline.run(spark, at).collect()}
    step = table(spark, at, "documents")
    for _, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, at)
    assert got == {r.doc_id for r in step.select("doc_id").collect()}
    assert got <= {i for i, _ in data}


def test_stages_of_an_empty_table(spark: SparkSession, case: tuple) -> None:
    docs, at, _, _ = case
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), at).count() == 0


