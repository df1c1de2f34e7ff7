"""Repeated passages of whole texts, found with fixed-block anchors.

A passage is a window of `window` words. Reference blocks of half a window are cut at fixed places, one after the
other, in every text; a window holds at least one whole block of any text it stands in. The blocks are the index.
Every rolling half window of every text probes it, and a probe that meets a block at another place is a hit. Hits
are extended: the windows around a hit are compared by 96-bit hashes with those around all other hits, the first
place of each stays, and later ones, run together, are the maximal repeats.

Texts are dealt once into chunks. Chunks send hashes to buckets and get one bit a hash back, so a passage in a third
of all texts is one row a chunk and never a list of pairs. A chunk computes its hashes anew where it needs them,
which is cheaper than to move them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatguard.llm.words import hash_words, mix, ngrams

_CHUNK = 2 << 20  # bytes of text in a chunk
_BUCKET = 2 << 20  # hashes in a bucket
_LOW = 30  # bits of a probe's hash that travel beside its bucket
_PIECE = 1 << 20  # bytes hashed at once
_SENT = "bucket int, chunk int, kind int, data binary"
_BACK = "chunk int, bucket int, kind int, data binary"
_KEPT = "doc_id long, kept_text string, n_words long, n_removed long, removed array<struct<start:int,end:int>>"
_PROBES, _WINDOWS, _MARKS = 0, 1, 2  # kinds of rows
# The ASCII white space that parts words.
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def _pieces(data: bytes) -> Iterator[bytes]:
    """The text in pieces of about a megabyte, parted at white space only."""
    at = 0
    while len(data) - at > _PIECE:
        found = _SPACE.search(data, at + _PIECE)
        to = found.start() if found else len(data)
        yield data[at:to]
        at = to
    yield data[at:]


class Chunk:
    """The distinct documents of one chunk in order, with the hashes of their words in one row."""

    def __init__(self, frame: pd.DataFrame, window: int):
        self.frame = frame.sort_values(["no_id", "rank", "text"], kind="stable")
        self.texts = [x.encode("utf-8", "replace") for x in self.frame["text"]]
        rank, no_id = self.frame["rank"].to_numpy(), self.frame["no_id"].to_numpy()
        # Rows that repeat both id and text are one document.
        self.of: list[int] = []
        distinct: list[int] = []
        for i, text in enumerate(self.texts):
            if not i or (rank[i], no_id[i], text) != (rank[i - 1], no_id[i - 1], self.texts[i - 1]):
                distinct.append(i)
            self.of.append(len(distinct) - 1)
        self.rank, self.no_id = rank[distinct].astype(np.int64), no_id[distinct].astype(bool)
        self.distinct = distinct
        self.window, self.block = window, window // 2

    def hash(self) -> None:
        hashes, counts = [], []
        held, size = [], 0

        def flush() -> None:
            found, start = hash_words(b"\n".join(held), _IS_WORD)
            marks = np.cumsum([0, *(len(x) + 1 for x in held)])
            hashes.append(found)
            counts.append(np.diff(np.searchsorted(start, marks)))

        for i in self.distinct:
            text = self.texts[i]
            if len(text) > _PIECE:
                if held:
                    flush()
                parts = [hash_words(x, _IS_WORD)[0] for x in _pieces(text)]
                hashes += parts
                counts.append(np.array([sum(map(len, parts))]))
                held, size = [], 0
                continue
            held.append(text)
            size += len(text)
            if size > _PIECE:
                flush()
                held, size = [], 0
        if held:
            flush()
        none = np.zeros(0, np.uint64)
        self.words = np.concatenate([none, *hashes])
        self.counts = np.concatenate([np.zeros(0, np.int64), *counts]).astype(np.int64)
        self.first = np.cumsum(self.counts) - self.counts

    def probes(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(unique keys, key of each probe, place of each probe among all words, whether it stands on a block)."""
        found, owner, at = ngrams(self.words, self.counts, self.block)
        long = self.counts[owner] >= self.window
        found, owner, at = found[long], owner[long], at[long]
        key = (found >> np.uint64(64 - bits) << np.uint64(_LOW)) | (found & np.uint64((1 << _LOW) - 1))
        unique, inverse = np.unique(key, return_inverse=True)
        return unique, inverse, self.first[owner] + at, at % self.block == 0

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place among all words, document, 64-bit hash, further 32 bits) of every window."""
        one, owner, at = ngrams(self.words, self.counts, self.window)
        two = ngrams(mix(self.words ^ np.uint64(0x2545F4914F6CDD1D)), self.counts, self.window)[0]
        return self.first[owner] + at, owner, one, (two >> np.uint64(32)).astype(np.uint32)


def _runs(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(bucket, its slice) of sorted bucket numbers."""
    own, start = np.unique(bucket, return_index=True)
    for k, (b, lo) in enumerate(zip(own.tolist(), start.tolist(), strict=True)):
        yield b, slice(lo, start[k + 1] if k + 1 < len(start) else len(bucket))


def _marked(answers: pd.DataFrame, kind: int, bucket: np.ndarray) -> np.ndarray:
    """The bits that came back for entries of sorted buckets; buckets without a row have none."""
    out, where = np.zeros(len(bucket), bool), dict(_runs(bucket))
    own = answers[answers["kind"] == kind]
    for b, data in zip(own["bucket"], own["data"], strict=True):
        at = where[b]
        out[at] = np.unpackbits(np.frombuffer(data, np.uint8), count=at.stop - at.start).astype(bool)
    return out


def _send_probes(frame: pd.DataFrame, window: int, bits: int) -> pd.DataFrame:
    chunk = Chunk(frame, window)
    chunk.hash()
    keys, inverse, _, on_block = chunk.probes(bits)
    block = np.zeros(len(keys), bool)
    block[inverse[on_block]] = True
    again = np.bincount(inverse, minlength=len(keys)) > 1
    value = ((keys & np.uint64((1 << _LOW) - 1)) << np.uint64(2) | again.astype(np.uint64) << np.uint64(1) | block.astype(np.uint64)).astype(np.uint32)
    number = int(frame["chunk"].iloc[0])
    return pd.DataFrame([(b, number, _PROBES, value[at].tobytes()) for b, at in _runs(keys >> np.uint64(_LOW))], columns=["bucket", "chunk", "kind", "data"])


def _answer_probes(rows: pd.DataFrame) -> pd.DataFrame:
    """Bits of the probes that meet a block at another place."""
    parts = [np.frombuffer(x, np.uint32) for x in rows["data"]]
    value = np.concatenate(parts)
    order = np.argsort(value >> np.uint32(2), kind="stable")
    ordered = value[order]
    starts = np.flatnonzero(np.r_[True, np.diff(ordered >> np.uint32(2)) != 0])
    size = np.diff(np.r_[starts, len(ordered)])
    flags = np.bitwise_or.reduceat(ordered & np.uint32(3), starts)
    hit = np.zeros(len(value), bool)
    hit[order] = np.repeat(((flags & 1) > 0) & ((size > 1) | (flags & 2 > 0)), size)
    return _back(rows, [len(x) for x in parts], hit, _PROBES)


def _back(rows: pd.DataFrame, sizes: list[int], bits: np.ndarray, kind: int) -> pd.DataFrame:
    at = np.cumsum([0, *sizes])
    out = [(c, b, kind, np.packbits(bits[lo:hi]).tobytes()) for c, b, lo, hi in zip(rows["chunk"], rows["bucket"], at[:-1], at[1:], strict=True) if bits[lo:hi].any()]
    return pd.DataFrame(out, columns=["chunk", "bucket", "kind", "data"])


def _planes(x: np.ndarray) -> bytes:
    """The bytes of the numbers in planes, of which the shuffle's compression shrinks those that hardly vary."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _send_windows(frame: pd.DataFrame, answers: pd.DataFrame, window: int, bits: int) -> pd.DataFrame:
    """Hashes of the windows around hits, the first of each in the chunk with its document's place in the order."""
    empty = pd.DataFrame([], columns=["bucket", "chunk", "kind", "data"])
    if not len(frame) or not len(answers):
        return empty
    chunk = Chunk(frame, window)
    chunk.hash()
    keys, inverse, place, _ = chunk.probes(bits)
    hit = np.zeros(len(chunk.words) + 1, np.int64)
    hit[place[_marked(answers, _PROBES, keys >> np.uint64(_LOW))[inverse]]] = 1
    upto = np.concatenate([[0], np.cumsum(hit)])
    at, owner, one, two = chunk.windows()
    near = upto[at + window - chunk.block + 1] > upto[at]
    owner, one, two = owner[near], one[near], two[near]
    unique, first = np.unique(one, return_index=True)
    number, doc = int(frame["chunk"].iloc[0]), owner[first]
    rank, no_id, more = chunk.rank[doc], chunk.no_id[doc].astype(np.uint8), two[first]
    out = [(b, number, _WINDOWS, unique[s].tobytes() + more[s].tobytes() + _planes(rank[s]) + no_id[s].tobytes()) for b, s in _runs(unique >> np.uint64(64 - bits))]
    out.append((number % (1 << bits), number, _MARKS, np.packbits(near).tobytes()))
    return pd.DataFrame(out, columns=["bucket", "chunk", "kind", "data"])


def _answer_windows(rows: pd.DataFrame) -> pd.DataFrame:
    """Bits of the windows that another chunk holds at an earlier place; marks go back as they came."""
    sent = rows[rows["kind"] == _WINDOWS]
    marks = rows[rows["kind"] == _MARKS][["chunk", "bucket", "kind", "data"]]
    if not len(sent):
        return marks
    one, two, rank, no_id, sizes = [], [], [], [], []
    for data in sent["data"]:
        n = len(data) // 21
        sizes.append(n)
        one.append(np.frombuffer(data, np.uint64, n))
        two.append(np.frombuffer(data, np.uint32, n, 8 * n))
        rank.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, 8 * n, 12 * n).reshape(8, n).T).view(np.int64).ravel())
        no_id.append(np.frombuffer(data, np.uint8, n, 20 * n))
    one, two, rank, no_id = (np.concatenate(x) for x in (one, two, rank, no_id))
    order = np.lexsort((rank, no_id, two, one))
    later = np.zeros(len(one), bool)
    later[order[1:]] = (np.diff(one[order]) == 0) & (np.diff(two[order]) == 0)
    return pd.concat([marks, _back(sent, sizes, later, _WINDOWS)])


def _without_repeats(frame: pd.DataFrame, answers: pd.DataFrame, window: int, bits: int) -> pd.DataFrame:
    if not len(frame):
        return pd.DataFrame([], columns=["doc_id", "kept_text", "n_words", "n_removed", "removed"])
    chunk = Chunk(frame, window)
    marks = answers[answers["kind"] == _MARKS]
    gone = None
    if len(marks):
        chunk.hash()
        at, _, one, _ = chunk.windows()
        near = np.unpackbits(np.frombuffer(marks["data"].iloc[0], np.uint8), count=len(at)).astype(bool)
        unique, first, inverse = np.unique(one[near], return_index=True, return_inverse=True)
        again = _marked(answers, _WINDOWS, unique >> np.uint64(64 - bits))[inverse]
        again |= first[inverse] != np.arange(len(inverse))
        cover = np.zeros(len(chunk.words) + 1, np.int64)
        starts = at[near][again]
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + window, -1)
        gone = np.cumsum(cover)[:-1] > 0
    out = []
    for doc_id, text, d in zip(chunk.frame["doc_id"], chunk.texts, chunk.of, strict=True):
        words = text.split()
        spans = []
        if gone is not None:
            own = np.concatenate([[False], gone[chunk.first[d] : chunk.first[d] + chunk.counts[d]], [False]]).astype(np.int8)
            edge = np.diff(own)
            spans = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))
        kept, upto = [], 0
        for start, end in spans:
            kept += words[upto:start]
            upto = end
        kept += words[upto:]
        out.append((doc_id, b" ".join(kept).decode(), len(words), len(words) - len(kept), [{"start": a, "end": b} for a, b in spans]))
    done = pd.DataFrame(out, columns=["doc_id", "kept_text", "n_words", "n_removed", "removed"])
    done["doc_id"] = done["doc_id"].astype("Int64")
    return done


def remove_repeats(docs: DataFrame, window: int = 20, chunks: int | None = None, buckets: int | None = None) -> DataFrame:
    """Every document without the words that a window covers which also starts earlier.

    docs: doc_id (cast to long), text; other columns are not read, whatever their names. Words are runs of characters
    other than ASCII white space. Earlier is a smaller doc_id, or the same document and an earlier start. Documents
    with a null id come last, in the order of a hash of their texts; of rows that repeat an id those with the smaller
    text come first, and rows that repeat both are one document, so none of them removes the other. A null text is
    empty. An empty table gives an empty result. window: an even number of words.
    chunks, buckets: how finely texts and hashes are dealt; by default 2 MB of text and 2 M hashes each, at least 512.
    Returns doc_id, kept_text (kept words joined by one space), n_words, n_removed long, removed: runs of words
    array<struct<start,end>>, the maximal repeats.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    if chunks is None or buckets is None:
        size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        chunks = chunks or max(512, math.ceil(size / _CHUNK))
        buckets = buckets or max(512, math.ceil(size / 4 / _BUCKET))
    bits = max(1, math.ceil(math.log2(buckets)))
    rank = F.coalesce("doc_id", F.xxhash64("text"))
    dealt = rows.select(F.pmod(F.xxhash64(rank), F.lit(chunks)).cast("int").alias("chunk"), "doc_id", F.col("doc_id").isNull().alias("no_id"), rank.alias("rank"), "text")
    probes = dealt.groupBy("chunk").applyInPandas(lambda x: _send_probes(x, window, bits), _SENT)
    hits = probes.groupBy("bucket").applyInPandas(_answer_probes, _BACK)
    found = dealt.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInPandas(lambda x, y: _send_windows(x, y, window, bits), _SENT)
    later = found.groupBy("bucket").applyInPandas(_answer_windows, _BACK)
    return dealt.groupBy("chunk").cogroup(later.groupBy("chunk")).applyInPandas(lambda x, y: _without_repeats(x, y, window, bits), _KEPT)
