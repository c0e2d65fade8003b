"""Token alignment against plain Python over whole texts, on awkward rows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import SparkSession

from chainmark.llm import alignment
from chainmark.llm.queries import QUERIES

from ..oracle import SF, from_sql
from .fixtures import documents, rows

FIGURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def tokens(text: str) -> tuple[list, list]:
    """(id, bytes) of A's and B's tokens, of the whole text at once."""
    both = alignment.tokenizers(f"{alignment.FOLDER}/byte_bpe_50k.json", f"{alignment.FOLDER}/piece_bpe_32k.model")
    a = both.a.encode(" " + text, add_special_tokens=False)
    out_a = [(i, both.a_bytes[i].as_py()) for i in a.ids]
    out_b = []
    for i in both.b.encode(text):
        piece = both.b.id_to_piece(i)
        out_b.append((i, bytes([int(piece[3:5], 16)]) if len(piece) == 6 and piece.startswith("<0x") else piece.replace("▁", " ").encode()))
    return out_a, out_b


def groups(text: str | None) -> list[tuple[list[int], list[int]]] | None:
    if not text:
        return None
    a, b = tokens(text)
    want = (" " + text).encode()
    if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
        return None
    out, i, j, left, right, sa, sb = [], 0, 0, [], [], 0, 0
    while i < len(a) or j < len(b):
        if sa <= sb and i < len(a):
            left.append(a[i][0])
            sa += len(a[i][1])
            i += 1
        else:
            right.append(b[j][0])
            sb += len(b[j][1])
            j += 1
        if sa == sb and left and right:
            out.append((left, right))
            left, right = [], []
    return out


def brute(data: list[tuple]) -> list[tuple]:
    found = [groups(t) for _, t in data]
    links = [Counter((x, y) for left, right in g or [] for x in left for y in right) for g in found]
    count = Counter(p for c in links for p in c)
    most: dict = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for (i, _), g, c in zip(data, found, links, strict=True):
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g or [])
        digest = hashlib.sha256(text.encode()).hexdigest() if g else ""
        best = sum(n for p, n in c.items() if count[p] == most[p[0]])
        out.append((i, sum(len(x) for x, _ in g or []), sum(len(y) for _, y in g or []), len(g or []), sum(c.values()), best, sum(n * count[p] for p, n in c.items()), digest))
    return sorted(out, key=str)


def got(df) -> list[tuple]:
    return sorted(((r.doc_id, *(r[c] for c in FIGURES)) for r in df.select("doc.doc_id", *FIGURES).collect()), key=str)


AWKWARD = [
    (500, "The  quick brown fox, naïve café — “quoted” <|endoftext|> <s> </s> <unk> and 12,345.67 tokens"),
    (501, " leading and trailing "),
    (502, "\ttabs\nand\r\nlines  \n\n  indented"),
    (503, "ﬁ ligature Å ｆｕｌｌ width ​ zero"),
    (504, "日本語のテキスト と 漢字 🙂🙂 emoji\U0001f468‍\U0001f469"),
    (505, "a\u0000b \u0001 c\u007f"),
    (506, "▁ literal ▁mark and word▁"),
    (507, " "),
    (508, "   "),
    (509, "don't we'll I'M x's 's"),
    (510, "é combining ́ mark"),
    (None, "no id but words"),
]


@pytest.mark.parametrize("limit", [alignment.BROADCAST_PAIRS, 0])
def test_equals_plain_python(spark: SparkSession, limit: int) -> None:
    data = [x for x in rows() if x[1] is None or len(x[1]) < 50_000] + AWKWARD
    found, pairs = alignment.alignment(documents(spark, data), broadcast_pairs=limit)
    assert got(found) == brute(data)
    assert {"a", "b", "n", "best"} <= set(pairs.columns)


def test_slices_of_any_size(monkeypatch: pytest.MonkeyPatch) -> None:
    """Texts longer than a slice, and slices that end anywhere, change nothing."""
    import pyarrow as pa

    r = random.Random(5)
    texts = [" ".join(r.choice(["the", "naïve", "x,", "é", "token  s", "12", "\n", "ab" * 30]) for _ in range(r.randrange(0, 60))) for _ in range(40)]
    texts += ["", None, " ", "a", "word " * 30, "x" * 300]
    both = alignment.tokenizers(f"{alignment.FOLDER}/byte_bpe_50k.json", f"{alignment.FOLDER}/piece_bpe_32k.model")

    def all_rows() -> list:
        out = []
        for first, found in alignment._rows(pa.array(texts, pa.string()), both):
            assert first == len(out)
            out += [(x.counts.tolist(), x.digest.hexdigest(), *map(list, alignment._merged(x))) if x.valid else None for x in found]
        return out

    whole = all_rows()
    assert len(whole) == len(texts)
    assert [w is not None for w in whole] == [bool(groups(t)) for t in texts]
    for size in (1, 2, 7, 64, 500):
        monkeypatch.setattr(alignment, "SLICE", size)
        assert all_rows() == whole


def test_long_texts(spark: SparkSession) -> None:
    data = [x for x in rows() if x[1] is not None and len(x[1]) >= 50_000]
    assert len(data) == 2
    found, _ = alignment.alignment(documents(spark, data))
    assert got(found) == brute(data)


def test_empty_table(spark: SparkSession) -> None:
    found, pairs = alignment.alignment(documents(spark).limit(0))
    assert found.count() == pairs.count() == 0


def test_query_equals_plain_python(spark: SparkSession) -> None:
    """On whole documents of the smallest tables."""
    data = from_sql("SELECT doc_id, text FROM documents", SF)
    want = brute([(i, t) for i, t in zip(data.doc_id.tolist(), data.text.tolist(), strict=True)])
    df = QUERIES["op13_alignment"](spark, SF)
    assert sorted(((r.doc_id, *(r[c] for c in FIGURES)) for r in df.collect()), key=str) == want
