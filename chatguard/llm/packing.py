"""Token-ID output: documents packed into rows of fixed length by best-fit decreasing.

Every task tokenises its documents, cuts those longer than a row, collects pieces up to a bound and packs them;
no row leaves its task before it is packed, so nothing is shuffled. Rows are little-endian id matrices with
cumulative segment lengths and position numbers that start again at every segment.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatguard.llm.store import released

# Fixed value: the published pre-tokenisation pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_CUT = 1 << 17
_LOADED: dict[tuple[str, str], object] = {}

SCHEMA = "seq_id long, n_tokens int, doc_ids array<long>, pieces array<int>, cu_seqlens array<int>, input_ids binary, position_ids binary"
_ARROW = pa.schema([("seq_id", pa.int64()), ("n_tokens", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())), ("cu_seqlens", pa.list_(pa.int32())), ("input_ids", pa.binary()), ("position_ids", pa.binary())])


def load_vocabulary(path: str, pattern: str = PATTERN):
    """The encoding of a rank file; loaded once in each worker."""
    if (path, pattern) not in _LOADED:
        import tiktoken

        if not os.path.isfile(path):
            raise FileNotFoundError(f"no vocabulary at {path}: every worker needs the rank file; name it by the vocabulary parameter")
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _LOADED[path, pattern] = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path, pattern]


def _stretches(text: str) -> Iterator[str]:
    """Pieces of bounded length, cut before a single space between words, where pre-tokens part in any case."""
    at = 0
    while len(text) - at > _CUT:
        to = text.rfind(" ", at + 1, at + _CUT)
        while to > at and (text[to - 1].isspace() or text[to + 1 : to + 2].isspace()):
            to = text.rfind(" ", at + 1, to)
        to = to if to > at else at + _CUT
        yield text[at:to]
        at = to
    yield text[at:] if at else text


class BestFit:
    """Rows by remaining capacity, with a segment tree over capacities that finds the least one that still fits."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.any = [False] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        node = capacity + self.size
        while node and not self.any[node]:
            self.any[node] = True
            node //= 2

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, row) of the fullest row with room for need, removed from the tree."""
        node = need + self.size
        while not self.any[node]:
            while node & 1:
                node //= 2
            if node == 0:
                return None
            node += 1
        while node < self.size:
            node = 2 * node if self.any[2 * node] else 2 * node + 1
        capacity = node - self.size
        row = self.rows[capacity].pop()
        if not self.rows[capacity]:
            while node and not (node < self.size and (self.any[2 * node] or self.any[2 * node + 1])):
                self.any[node] = False
                node //= 2
        return capacity, row


def best_fit_decreasing(lengths: np.ndarray, length: int) -> list[list[int]]:
    """Rows of piece numbers; no row's lengths sum to more than length."""
    tree, rows = BestFit(length), []
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        got = tree.take(n)
        if got is None:
            got = (length, len(rows))
            rows.append([])
        rows[got[1]].append(k)
        if got[0] > n:
            tree.put(got[0] - n, got[1])
    return rows


def pack_documents(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", length: int = 2048, pad_id: int = 0, buffer_tokens: int = 1 << 22, pattern: str = PATTERN) -> DataFrame:
    """Rows of `length` token ids: seq_id, n_tokens, doc_ids, pieces, cu_seqlens, input_ids, position_ids.

    A segment is one piece of one document: doc_ids and pieces (0, 1, ... within a document) name it and
    cu_seqlens bounds it, with 0 first and n_tokens last. input_ids and position_ids hold `length` little-endian
    numbers, uint16 if the vocabulary and the length allow it, else uint32; ids after n_tokens are pad_id.
    Positions start at 0 in every segment. Nothing is dropped: the pieces of a document in order are its tokens.
    Null and empty texts have no tokens and so no segment; a null id stays null; repeated rows are packed each;
    other columns are not read, whatever their names; doc_id must cast to long. Texts are tokenised in stretches
    of at most 131,072 characters that part at a space; only where that many characters hold no space a word is
    parted, and may then take other tokens than alone, which spell the same text.
    Rows and their order depend on how the input is split over tasks; seq_id is unique.
    """

    def pack(pieces: list[tuple[int | None, int, np.ndarray]], first: int, kind) -> pa.RecordBatch:
        rows = best_fit_decreasing(np.array([len(p[2]) for p in pieces], dtype=np.int64), length)
        out: list[list] = [[] for _ in _ARROW]
        for n, row in enumerate(rows):
            ids, at = np.full(length, pad_id, dtype=kind), np.zeros(length, dtype=kind)
            bounds = [0]
            for k in row:
                tokens = pieces[k][2]
                ids[bounds[-1] : bounds[-1] + len(tokens)] = tokens
                at[bounds[-1] : bounds[-1] + len(tokens)] = np.arange(len(tokens))
                bounds.append(bounds[-1] + len(tokens))
            for column, value in zip(out, (first + n, bounds[-1], [pieces[k][0] for k in row], [pieces[k][1] for k in row], bounds, ids.tobytes(), at.tobytes()), strict=True):
                column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, _ARROW, strict=True)], schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_vocabulary(vocabulary, pattern)
        kind = np.dtype("<u2") if max(encoding.n_vocab, length, pad_id + 1) <= 65536 else np.dtype("<u4")
        first = TaskContext.get().partitionId() << 40
        held: list[tuple[int | None, int, np.ndarray]] = []
        size = 0
        for batch in batches:
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = body.as_py()
                if not body:
                    continue
                parts = [encoding.encode_to_numpy(x, disallowed_special=()).astype(kind) for x in _stretches(body)]
                tokens = parts[0] if len(parts) == 1 else np.concatenate(parts)
                for piece, at in enumerate(range(0, len(tokens), length)):
                    held.append((key, piece, tokens[at : at + length]))
                    size += min(length, len(tokens) - at)
                    if size >= buffer_tokens:
                        done = pack(held, first, kind)
                        first += done.num_rows
                        held, size = [], 0
                        yield from (done.slice(k, 256) for k in range(0, done.num_rows, 256))
        if held:
            done = pack(held, first, kind)
            yield from (done.slice(k, 256) for k in range(0, done.num_rows, 256))

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(released(run), SCHEMA)


FILES = "part string, rows long, segments long, tokens long, row_bytes long"


def write_binary(rows: DataFrame, path: str) -> DataFrame:
    """Write packed rows as flat binary files under path, a folder or URI that all executors share; returns their list.

    Each task writes part-N.ids and part-N.positions (little-endian ids and positions, row_bytes for each
    row), part-N.cu (rows x (segments + 1) int32 bounds, row after row) and part-N.docs (doc_id int64, -1 for
    null, and piece int32 of each segment). A task that runs again writes files of its own attempt; the list, one
    row for each part with rows, is written last as path/files.parquet and names the parts that count.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        task = TaskContext.get()
        store, folder = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)
        part = f"part-{task.partitionId():05d}-{task.taskAttemptId()}"
        width, outs, count = 0, {}, {"rows": 0, "segments": 0, "tokens": 0}
        for frame in frames:
            if not len(frame):
                continue
            if not outs:
                store.create_dir(folder, recursive=True)
                outs = {kind: store.open_output_stream(f"{folder}/{part}.{kind}") for kind in ("ids", "positions", "cu", "docs")}
            for ids, at, cut, docs, pieces in zip(frame["input_ids"], frame["position_ids"], frame["cu_seqlens"], frame["doc_ids"], frame["pieces"], strict=True):
                width = len(ids)
                outs["ids"].write(ids)
                outs["positions"].write(at)
                outs["cu"].write(np.asarray(cut, "<i4").tobytes())
                named = np.array([(-1 if d is None or d != d else int(d), p) for d, p in zip(docs, pieces, strict=True)], dtype=[("doc", "<i8"), ("piece", "<i4")])
                outs["docs"].write(named.tobytes())
                count["rows"] += 1
                count["segments"] += len(cut) - 1
                count["tokens"] += int(cut[-1])
        for out in outs.values():
            out.close()
        if outs:
            yield pd.DataFrame([{"part": part, **count, "row_bytes": width}])

    listed = rows.select("input_ids", "position_ids", "cu_seqlens", "doc_ids", "pieces").mapInPandas(run, FILES)
    listed.write.mode("overwrite").parquet(f"{path}/files.parquet")
    return rows.sparkSession.read.schema(FILES).parquet(f"{path}/files.parquet")
