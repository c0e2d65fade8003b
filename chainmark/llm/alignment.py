"""Alignment of the tokens of two tokenizers, and how often ids are linked.

Every text is encoded by tokenizer A (byte-level BPE, over a space and the
text) and tokenizer B (sentencepiece, which adds the space itself). Cumulative
sums of token bytes give where tokens end; ends that both have (``intersect1d``)
cut a text into groups, ``searchsorted`` labels each token with its group, and
expansion by ``repeat`` links every A token of a group with every B token of it.

Texts are first cut before single spaces between printable ASCII characters or
letters up to U+02FF. No token of either vocabulary crosses such a place (A
splits words there before it merges; B is refused if one of its pieces holds a
space after anything but spaces), so both tokenizers end a token there and the
cut pieces encode as they would inside the text. Different pieces of a slice of
texts are therefore encoded, aligned and linked once, and texts are assembled
from them by ``take``. A's file is read as ranks where its ids follow its
merges, which gives the same tokens sooner.

1. One pass writes, per row: numbers of tokens, groups and links, the digest of
   the groups and the different linked id pairs with their multiplicities.
2. Pairs are counted, once a document: tasks add up their rows, then a shuffle
   by pair and salt and one by pair alone.
3. Counts go back to the rows: as one sorted array while the pairs number at
   most ``broadcast_pairs``, else by a join on the pair, which adaptive
   execution splits where a pair is frequent.

Defined cases: null and empty texts, and texts whose joined A or B bytes differ
from a space and the text, have zeros and the empty string; repeated rows and
rows with a null id are rows like any other, each counted; other columns stay
in ``doc``, whatever their names. A text longer than SLICE is taken in slices
cut at such spaces; only one without any is encoded whole. An empty table gives
no rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import Workspace

FOLDER = "/opt/tokenizers"
SLICE = 2 << 20
#: Longer pieces go through the library that reads the file itself.
LONG = 50_000
SALTS = 16
#: 16 bytes a pair: at most 64 MB sent.
BROADCAST_PAIRS = 4_000_000
_SHIFT = 32
#: Fixed value: how byte-level vocabularies of the GPT-2 family split texts into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes beside a space at which texts may be cut: printable ASCII, and the first and second bytes of U+00C0 to U+02FF, which are letters and signs.
_GRAPH = np.zeros(256, bool)
_GRAPH[0x21:0x7F] = True
_LEAD = np.zeros(256, bool)
_LEAD[0xC3:0xCC] = True
_TAIL = np.zeros(256, bool)
_TAIL[0x80:0xC0] = True


def _letters() -> dict[str, int]:
    """Character by which byte-level vocabularies write each byte: itself if printable, else the next from U+0100."""
    plain = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers with the bytes of their tokens, by id."""

    def __init__(self, a: str, b: str) -> None:
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a), SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        self.fast = self._ranked(a)
        letters = _letters()
        size = self.a.get_vocab_size()
        named = [self.a.id_to_token(i) or "" for i in range(size)]
        self.a_bytes = pa.array([bytes(letters[c] for c in x) if all(c in letters for c in x) else x.encode() for x in named], pa.large_binary())
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in x.lstrip("▁") for x in pieces):
            raise ValueError("a piece crosses words; texts cannot be cut between them")
        self.b_bytes = pa.array([bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(pieces)], pa.large_binary())

    def _ranked(self, path: str):
        """The file's vocabulary as ranks, several times faster; None unless its ids follow its merges and it splits as GPT-2 does."""
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, split = told["model"], told["pre_tokenizer"]
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model.get("merges") or []]
        plain = model.get("type") == "BPE" and told["normalizer"] is None and split and split["type"] == "ByteLevel" and split.get("use_regex") and not split["add_prefix_space"]
        if not plain or any(model["vocab"][m] != 256 + i for i, m in enumerate(merges)):
            return None
        letters = _letters()
        ranks = {bytes(letters[c] for c in m): i for m, i in model["vocab"].items() if i < 256 + len(merges)}
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode_a(self, keys: list[str]) -> list[list[int]]:
        if self.fast is None:
            return [e.ids for e in self.a.encode_batch([f" {k}" for k in keys], add_special_tokens=False)]
        return [self.fast.encode_ordinary(f" {k}") if len(k) <= LONG else self.a.encode(f" {k}", add_special_tokens=False).ids for k in keys]

    def encode(self, keys: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids one after another, number by key) of A and of B."""
        out = []
        for ids in (self.encode_a(keys), self.b.encode(keys, num_threads=1) if keys else []):
            count = np.fromiter(map(len, ids), np.int64, len(ids))
            out.append((np.fromiter(chain.from_iterable(ids), np.int64, int(count.sum())), count))
        return out


@functools.cache
def tokenizers(a: str, b: str) -> Tokenizers:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizers(a, b)


def _body(texts: pa.Array) -> np.ndarray:
    """Bytes of an array that ``take`` or a join has made, one value after another."""
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][: len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)


def _joined(table: pa.Array, ids: np.ndarray, count: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Bytes of all tokens, where each token ends in them, and where each key's tokens begin and end."""
    taken = table.take(pa.array(ids))
    ends = np.cumsum(pc.binary_length(taken).to_numpy(zero_copy_only=False).astype(np.int64))
    bounds = np.append(0, ends)[np.append(0, np.cumsum(count))]
    return _body(taken).tobytes(), ends, bounds


def _texts_of(ids: np.ndarray, after: np.ndarray) -> pa.Array:
    """Decimal ids, each followed by its separator."""
    return pc.binary_join_element_wise(pa.array(ids).cast(pa.large_string()), pa.array([",", "|", ";"], pa.large_string()).take(pa.array(after)), pa.scalar("", pa.large_string()))


@dataclass
class Pieces:
    """What the different pieces of a slice amount to; row k of each array stands for piece k."""

    valid: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    #: Groups as text, each with a semicolon after it.
    written: pa.Array
    #: Linked id pairs (a << 32 | b) by piece, and how many token pairs each stands for.
    of: np.ndarray
    pair: np.ndarray
    times: np.ndarray


def _links(ga: np.ndarray, a: np.ndarray, gb: np.ndarray, b: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, pair, times): different id pairs of each group; equal ids of a group are taken together before they are expanded."""
    ka, ma = np.unique((ga << 32) | a, return_counts=True)
    kb, mb = np.unique((gb << 32) | b, return_counts=True)
    na, nb = np.bincount(ka >> 32, minlength=groups), np.bincount(kb >> 32, minlength=groups)
    first = np.cumsum(nb) - nb
    wide = nb[ka >> 32]
    left = np.repeat(np.arange(len(ka)), wide)
    right = np.arange(len(left)) - np.repeat(np.cumsum(wide) - wide, wide) + np.repeat(first[ka >> 32], wide)
    low = np.int64((1 << 32) - 1)
    return np.repeat(ka >> 32, wide), ((ka & low)[left] << _SHIFT) | (kb & low)[right], ma[left] * mb[right]


def align(keys: list[str], both: Tokenizers) -> Pieces:
    """Tokens, groups and links of every key, as if a space stood before it."""
    (a, n_a), (b, n_b) = both.encode(keys)
    want = [f" {k}".encode() for k in keys]
    valid = np.ones(len(keys), bool)
    kept = []
    for table, ids, count in ((both.a_bytes, a, n_a), (both.b_bytes, b, n_b)):
        data, ends, at = _joined(table, ids, count)
        at = at.tolist()
        valid &= np.fromiter((data[i:j] == w for i, j, w in zip(at, at[1:], want, strict=False)), bool, len(keys))
        kept.append((ids, count, ends, np.array(at[:-1], np.int64)))
    # byte places of all valid keys one after another, the same on both sides
    size = np.where(valid, np.fromiter(map(len, want), np.int64, len(want)), 0)
    base = np.cumsum(size) - size
    sides = []
    for ids, count, ends, at in kept:
        key = np.repeat(np.arange(len(keys)), count)
        some = valid[key]
        sides.append((ids[some], key[some], (ends - at[key] + base[key])[some]))
    (a, key_a, end_a), (b, key_b, end_b) = sides
    cuts = np.intersect1d(end_a, end_b, assume_unique=True)
    ga, gb = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
    in_a, in_b = np.bincount(ga, minlength=len(cuts)), np.bincount(gb, minlength=len(cuts))
    # order of writing: a group's A tokens, then its B tokens
    place = np.concatenate([np.arange(len(a)) + (np.cumsum(in_b) - in_b)[ga], np.arange(len(b)) + np.cumsum(in_a)[gb]]) if len(cuts) else np.zeros(0, np.int64)
    last_a, last_b = np.append(ga[1:] != ga[:-1], True)[: len(a)], np.append(gb[1:] != gb[:-1], True)[: len(b)]
    ids, after = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    ids[place], after[place] = np.concatenate([a, b]), np.concatenate([last_a * 1, last_b * 2])
    words = _texts_of(ids, after)
    n_a, n_b = np.bincount(key_a, minlength=len(keys)), np.bincount(key_b, minlength=len(keys))
    written = pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_a + n_b)), pa.int64()), words)
    group_key = key_a[np.searchsorted(ga, np.arange(len(cuts)))] if len(cuts) else np.zeros(0, np.int64)
    group, pair, times = _links(ga, a, gb, b, len(cuts))
    return Pieces(valid, n_a, n_b, np.bincount(group_key, minlength=len(keys)), pc.binary_join(written, pa.scalar("", pa.large_string())), group_key[group] if len(group) else group, pair, times)


@dataclass
class Found:
    """Of one row, from one or more slices of its text."""

    valid: bool
    counts: np.ndarray
    digest: object
    pairs: list[np.ndarray]
    times: list[np.ndarray]


def _slices(data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, cuts) over the bytes of a batch; cuts are row starts and the spaces at which texts are cut.

    A slice ends at a cut, so that only a piece without one can be longer.
    """
    at, size = 0, len(data)
    while at < size:
        to, found = min(at + SLICE, size), np.zeros(0, np.int64)
        while True:
            part = data[at : min(to + 1, size)]
            graph, lead = _GRAPH[part], _LEAD[part]
            before = graph.copy()
            before[1:] |= _TAIL[part[1:]] & lead[:-1]
            inner = np.flatnonzero((part[1:-1] == 0x20) & before[:-2] & (graph | lead)[2:]) + at + 1 if len(part) > 2 else np.zeros(0, np.int64)
            heads = starts[np.searchsorted(starts, at, "right") : np.searchsorted(starts, to, "left")]
            # a space beside a row's end belongs to other rows' texts
            inner = inner[~np.isin(inner + 1, heads) & ~np.isin(inner, heads)]
            found = np.union1d(inner[inner < to], heads)
            if to == size or len(found):
                break
            to = min(at + 2 * (to - at), size)
        if to < size:
            if to not in starts[np.searchsorted(starts, to) :][:1]:
                to = int(found[-1])
            found = found[found < to]
        yield at, to, found
        at = to


def _rows(column: pa.Array, both: Tokenizers) -> Iterator[tuple[int, list[Found]]]:
    """(first row, results) of rows in order; each text's pieces come through ``align`` once a slice."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    full = np.flatnonzero(np.diff(offsets) > 0)
    starts = offsets[full]
    open_: dict[int, Found] = {}
    done = 0
    for at, to, cuts in _slices(whole, starts):
        begin = np.append(at, cuts)
        end = np.append(cuts, to)
        row = full[np.searchsorted(starts, begin, "right") - 1]
        head = np.isin(begin, starts)
        begin = begin + ~head  # without the space
        edges = np.column_stack([begin, end]).ravel()
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(whole)])
        coded = pieces.take(pa.array(np.arange(0, len(edges), 2))).dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        found = align(coded.dictionary.cast(pa.large_string()).to_pylist(), both)
        per = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        local = np.cumsum(np.append(False, row[1:] != row[:-1]))
        # a piece that a row has several times is taken once, with its multiplicity
        seen, often = np.unique(local * len(found.valid) + codes, return_counts=True)
        seen_row, seen_code = seen // len(found.valid), seen % len(found.valid)
        size = np.bincount(found.of, minlength=len(found.valid))
        wide = size[seen_code]
        take = np.arange(int(wide.sum())) - np.repeat(np.cumsum(wide) - wide, wide) + np.repeat((np.cumsum(size) - size)[seen_code], wide)
        ids, dense = np.unique(found.pair, return_inverse=True)
        keys, back = np.unique(np.repeat(seen_row, wide) * max(1, len(ids)) + dense[take], return_inverse=True)
        times = np.bincount(back, weights=(found.times[take] * np.repeat(often, wide)), minlength=len(keys)).astype(np.int64)
        bounds = np.searchsorted(keys // max(1, len(ids)), np.arange(len(per) + 1))
        pair = ids[keys % max(1, len(ids))] if len(ids) else keys
        text = found.written.take(pa.array(codes))
        ends = np.append(0, np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)))
        body = memoryview(_body(text))
        edge = np.append(per, len(codes))
        for k, r in enumerate(row[per].tolist()):
            some = codes[edge[k] : edge[k + 1]]
            one = open_.setdefault(r, Found(True, np.zeros(3, np.int64), hashlib.sha256(), [], []))
            if one.counts.any():
                one.digest.update(b";")
            one.valid &= bool(found.valid[some].all())
            one.counts += [found.n_a[some].sum(), found.n_b[some].sum(), found.n_groups[some].sum()]
            one.digest.update(body[ends[edge[k]] : max(ends[edge[k]], ends[edge[k + 1]] - 1)])
            one.pairs.append(pair[bounds[k] : bounds[k + 1]])
            one.times.append(times[bounds[k] : bounds[k + 1]])
        finished = int(np.searchsorted(offsets, to, "right")) - 1 if to < len(whole) else len(column)
        out = [open_.pop(r, None) or Found(False, np.zeros(3, np.int64), None, [], []) for r in range(done, finished)]
        yield done, out
        done = finished
    if done < len(column):
        yield done, [Found(False, np.zeros(3, np.int64), None, [], []) for _ in range(done, len(column))]


def _merged(one: Found) -> tuple[np.ndarray, np.ndarray]:
    if not one.valid or not one.pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(one.pairs) == 1:
        return one.pairs[0], one.times[0]
    pair, back = np.unique(np.concatenate(one.pairs), return_inverse=True)
    return pair, np.bincount(back, weights=np.concatenate(one.times), minlength=len(pair)).astype(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(p) for p in parts])), pa.int32()), pa.array(np.concatenate([*parts, np.zeros(0, np.int64)]), pa.int64()))


_ALIGNED = "row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def _aligner(a: str, b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(a, b)
        for batch in batches:
            for first, found in _rows(batch.column(1), both):
                merged = [_merged(x) for x in found]
                counts = np.array([x.counts if x.valid else np.zeros(3, np.int64) for x in found], np.int64).reshape(-1, 3)
                links = np.array([t.sum() for _, t in merged], np.int64)
                digests = [x.digest.hexdigest() if x.valid else "" for x in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(found)), *(pa.array(counts[:, i]) for i in range(3)), pa.array(links, pa.int64()), pa.array(digests, pa.string()), _lists([p for p, _ in merged]), _lists([t for _, t in merged])],
                    names=["row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
                )

    return run


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different pairs of some rows, with the number of rows that have them."""
    for n, batch in enumerate(batches):
        pair, often = np.unique(batch.column(0).flatten().to_numpy(zero_copy_only=False), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int64)), pa.array(np.full(len(pair), n % SALTS, np.int32)), pa.array(often.astype(np.int64))], names=["pair", "salt", "n"])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, a, b, n, best): rows that hold each linked id pair; best where no pair of its A id has more."""
    salted = aligned.select("pairs").mapInArrow(_tally, "pair long, salt int, n long").withColumn("salt", F.pmod(F.col("salt") + F.spark_partition_id(), F.lit(SALTS)))
    counts = salted.groupBy("pair", "salt").agg(F.sum("n").alias("n")).groupBy("pair").agg(F.sum("n").alias("n"))
    return counts.select("pair", F.shiftright("pair", _SHIFT).alias("a"), F.col("pair").bitwiseAND((1 << _SHIFT) - 1).alias("b"), "n")


def _reader(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = table.value
        for batch in batches:
            lists, times = batch.column("pairs"), batch.column("times").flatten().to_numpy(zero_copy_only=False)
            at = np.searchsorted(pairs, lists.flatten().to_numpy(zero_copy_only=False))
            sums = [np.append(0, np.cumsum(x)) for x in (times * best[at], times * n[at])]
            ends = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)))
            out = [pa.array((s[ends[1:]] - s[ends[:-1]]).astype(np.int64)) for s in sums]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")), *out], names=["row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"])

    return run


def alignment(docs: DataFrame, text: str = "text", keep: list[str] | None = None, a: str = f"{FOLDER}/byte_bpe_50k.json", b: str = f"{FOLDER}/piece_bpe_32k.model", broadcast_pairs: int = BROADCAST_PAIRS) -> tuple[DataFrame, DataFrame]:
    """(rows, pairs): per document its figures, and the linked id pairs of the corpus with their counts.

    Rows have the columns ``keep`` (all by default) in ``doc``, n_a, n_b,
    n_groups, n_links, n_best, count_sum and groups_sha256.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "alignment")
    # rows are known by a number that is fixed once written
    rows = work.keep(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*(keep or docs.columns)).alias("doc"), F.col(text).alias("text")), "rows")
    aligned = work.keep(rows.select("row", "text").mapInArrow(_aligner(a, b), _ALIGNED), "aligned")
    counts = work.keep(pair_counts(aligned), "counts")
    # one row an id of A: bounded by its vocabulary
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    known = work.keep(counts.join(F.broadcast(most), "a").select("pair", "a", "b", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")
    figures = ["row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    if known.count() <= broadcast_pairs:
        table = known.select("pair", "n", F.col("best").cast("long").alias("best")).toArrow()
        columns = [table.column(c).to_numpy() for c in ("pair", "n", "best")]
        order = np.argsort(columns[0])
        sent = spark.sparkContext.broadcast(tuple(c[order] for c in columns))
        scored = aligned.mapInArrow(_reader(sent), "row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    else:
        each = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
        sums = each.join(known, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
        zero = F.lit(0).cast("long")
        scored = aligned.select(*figures).join(sums, "row", "left").withColumns({c: F.coalesce(c, zero) for c in ("n_best", "count_sum")})
    out = rows.select("row", "doc").join(scored, "row").select("doc", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return out, known
