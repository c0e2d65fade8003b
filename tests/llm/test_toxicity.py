"""Held-out accuracy on planted words, and the awkward rows."""

from __future__ import annotations

import math
import random
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import SparkSession

from chainmark.llm import toxicity
from chainmark.llm.work import table

from .fixtures import documents, rows


SF = "/root/testdata/sf0.1"


def planted(n: int) -> tuple[list, list]:
    r = random.Random(4)
    syllables = ["ta", "re", "mi", "so", "lu", "ken", "dor", "vin", "pal", "gri"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randrange(1, 4)))
    data, labels = [], []
    for i in range(n):
        words = [word() for _ in range(r.randrange(20, 120))]
        toxic = i % 4 == 0
        for _ in range(4 if toxic else 0):
            words[r.randrange(len(words))] = r.choice(["zwarblik", "fnordox", "quibzat"])
        data.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return data, labels


def test_held_out_accuracy(spark: SparkSession) -> None:
    data, labels = planted(600)
    docs, marks = documents(spark, data), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    found = toxicity.classify(docs, model, keep=["doc_id"]).select("doc.doc_id", "held_out", "score", "predicted").collect()
    truth = dict(labels)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_both_dictionaries_are_trained(spark: SparkSession) -> None:
    """On the labelled documents of the driver's tables: neither is empty, both hold trained content, and held-out rows bear them out."""
    docs, marks = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = toxicity.fit(docs, marks)
    assert len(model.ordinary) >= 8192 and len(model.toxic) >= 8192 and model.toxic != model.ordinary
    magic = (0xEC30A437).to_bytes(4, "little")
    assert model.ordinary.startswith(magic) and model.toxic.count(magic) == 2
    found = toxicity.classify(docs, model, keep=["doc_id"]).select("doc.doc_id", "held_out", "predicted").join(marks, "doc_id").where("held_out and toxic is not null")
    right, said, toxic, hit = found.selectExpr("count_if(predicted = toxic) / count(*)", "sum(predicted)", "sum(toxic)", "sum(predicted * toxic)").first()
    assert right >= 0.95 and hit >= 0.8 * said and hit >= 0.8 * toxic


def test_scores_equal_plain_python() -> None:
    """Windows coded letter by letter and compressed one by one give the same scores."""
    data, labels = planted(160)
    model = toxicity.train([t for (_, t), (_, y) in zip(data, labels, strict=True) if y], [t for (_, t), (_, y) in zip(data, labels, strict=True) if not y], 0.25)
    toxic, ordinary = toxicity._compressor(model.toxic), toxicity._compressor(model.ordinary)

    def code(text: bytes) -> list[int]:
        letter = lambda c: not (c < 48 or 58 <= c < 65 or 91 <= c < 97 or 123 <= c < 128)
        out = []
        for i, c in enumerate(text):
            value = 0
            for k in range(4):
                if i < k or not letter(text[i - k]):
                    break
                value += (text[i - k] + 32 * (65 <= text[i - k] < 91)) * 257**k
            if not letter(c):
                value = c + 32 * (65 <= c < 91) if letter(c) else 0
            value = (value + 1) * 0x9E3779B97F4A7C15 % 2**64
            value ^= value >> 32
            out.append(value * 0xBF58476D1CE4E5B9 % 2**64 >> 32)
        return out

    def score(text: str | None) -> float:
        codes = code((text or "").encode())
        n = max(1, -(-(len(codes) - (toxicity.SPAN - toxicity.STEP)) // toxicity.STEP))
        gains = []
        for i in range(n):
            window = codes[i * toxicity.STEP : i * toxicity.STEP + toxicity.SPAN]
            raw = b"".join(x.to_bytes(4, "little") for x in window).ljust((toxicity.SPAN + toxicity.PAD) * 4, b"\0")
            gains.append(len(ordinary.compress(raw)) - len(toxic.compress(raw)))
        top = sorted(gains, reverse=True)
        above = lambda k: sum(g >= k for g in gains)
        x = [top[k] if k < n else 0.0 for k in toxicity._TOP] + [math.log1p(n)] + [math.log1p(above(k)) for k in toxicity._COUNTS] + [above(k) / n for k in toxicity._SHARES]
        z = model.weights[0] + sum(w * (v - m) / s for w, v, m, s in zip(model.weights[1:], x, model.mean, model.scale, strict=True))
        return 1 / (1 + math.exp(-min(30, max(-30, z))))

    texts = [t for _, t in data[:40]] + [t for _, t in rows() if t is None or len(t) < 5000] + ["ZWARBLIK!", "éÉ zwarblik", "a" * 500]
    got = toxicity.scorer(model)(pa.array(texts, pa.string()))
    assert got.tolist() == pytest.approx([score(t) for t in texts], abs=1e-12)


def test_awkward_rows(spark: SparkSession) -> None:
    data, labels = planted(200)
    marks = spark.createDataFrame([*labels, (None, 1), (5, None), (7, 3), (99_999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(documents(spark, data), marks)
    df = documents(spark)
    found = toxicity.classify(df, model)
    assert found.select("doc.*").columns == df.columns
    got = found.collect()
    assert len(got) == len(rows())
    assert all(0 <= r.score <= 1 for r in got)
    assert not any(r.held_out for r in got if r.doc.doc_id is None)
    assert len({r.score for r in got if not r.doc.text}) == 1
    assert toxicity.classify(documents(spark, []), model).count() == 0


def test_without_both_classes(spark: SparkSession) -> None:
    docs = documents(spark, [(i, "plain text") for i in range(5)])
    marks = spark.createDataFrame([(i, 1) for i in range(5)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.classify(docs, toxicity.fit(docs, marks)).collect()} == {1.0}
    assert {r.score for r in toxicity.classify(docs, toxicity.fit(docs, marks.limit(0))).collect()} == {0.0}
