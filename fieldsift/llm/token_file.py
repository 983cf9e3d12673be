"""Token ids in files: frequent ids in few bytes, control bytes apart.

An id is replaced by its rank by frequency in the corpus, and the rank is stored
in one to four bytes. The lengths, two bits each, stand in control bytes before
the data bytes, so that a reader gets the lengths of four ids by one table
lookup and all offsets by one running sum.

A folder holds ``ranks`` (32-bit ids, most frequent first) and files of blocks,
in ascending order of documents. A block: HEADER (magic, documents, ids, data
bytes), ids of the documents (int64), a null flag each (uint8), their numbers of
ids (int64), control bytes, data bytes; all little-endian.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldsift.llm.pretokens import Memo, pieces
from fieldsift.llm.shared import col, files, new_file, shared_path, stage, store

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END = 2
HEADER = "<4sIQQ"
MAGIC = b"TOK1"
# A block is closed when it holds this many ids.
BLOCK = 1 << 18

# Lengths of the four ids of a control byte.
LENGTHS = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


# Characters of the texts that are encoded together, and new words of one call.
TOGETHER, CALL = 1 << 22, 4096
# Words that are kept, up to twice as many.
KEPT = 1 << 19
# A word that a line break before or after it leaves as it is.
_plain = re.compile(r" ?\S+").fullmatch


class LibraryEncoder:
    """Ids as the tokenizers library gives them, each word encoded once in a while.

    The library splits a text at special tokens and then into words, which it
    merges one by one; so ids are kept by word. The words of many texts are
    looked up together, each distinct one once, and new ones are handed to the
    library as lines of one text, cut again at the id of the line break.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.size = self.library.get_vocab_size()
        self.line_break = self._library(["\n"])[0]
        self.memo = Memo(lambda word: self._ids([word])[0])
        self.memo.LIMIT = KEPT
        self.memo.fill = self._ids

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _ids(self, words: list[str]) -> list[bytes]:
        out: dict[str, bytes] = {}
        lines = [w for w in words if _plain(w)] if len(self.line_break) == 4 else []
        calls = [lines[at : at + CALL] for at in range(0, len(lines), CALL)]
        for call, data in zip(calls, self._library(["\n".join(c) for c in calls]), strict=True):
            ids = np.frombuffer(data, "<u4")
            cuts = np.flatnonzero(ids == np.frombuffer(self.line_break, "<u4")[0]).tolist()
            if len(cuts) == len(call) - 1:  # else a word holds that id, and all go one by one
                edges = zip([0, *(4 * c + 4 for c in cuts)], [*(4 * c for c in cuts), len(data)], strict=True)
                out.update(zip(call, (data[a:b] for a, b in edges), strict=True))
        rest = [w for w in words if w not in out]
        out.update(zip(rest, self._library(rest), strict=True))
        return [out[w] for w in words]

    def _together(self, texts: list[str]) -> list[bytes]:
        split = [pieces(t) for t in texts]
        words = pa.array(chain.from_iterable(split), pa.string()).dictionary_encode()
        values = self.memo.all(words.dictionary.to_pylist())
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        starts = np.cumsum(sizes) - sizes
        code = words.indices.to_numpy()
        own = sizes[code]
        ends = np.cumsum(own)
        place = np.repeat(starts[code] - (ends - own), own) + np.arange(own.sum())
        data = np.frombuffer(b"".join(values), "<u4")[place].tobytes()
        upto = np.concatenate([[0], ends])[np.cumsum([0, *map(len, split)])].tolist()
        return [data[4 * a : 4 * b] for a, b in zip(upto, upto[1:], strict=False)]

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        held: list[str] = []
        size = 0
        for text in texts:
            special = any(s in text for s in self.special)
            if held and (special or size >= TOGETHER):
                yield from self._together(held)
                held, size = [], 0
            if special:
                yield from self._library([text])
            else:
                held.append(text)
                size += len(text)
        if held:
            yield from self._together(held)


@lru_cache(maxsize=1)
def library_encoder(path: str) -> LibraryEncoder:
    """One for each Python worker."""
    return LibraryEncoder(path)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ranks."""
    size = 1 + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    code = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    code[: len(ranks)] = size - 1
    control = (code.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    four = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes(), four[np.arange(4) < size[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks of control and data bytes."""
    sizes = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n].astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    padded = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = np.zeros(n, np.uint32)
    for i in range(int(sizes.max(initial=0))):  # bytes of the next id are masked off
        out |= padded[starts + i].astype(np.uint32) << np.uint32(8 * i)
    return out & MASKS[sizes]


def _encoded(docs: DataFrame, path: str, end: int) -> DataFrame:
    """Staged (doc_id, ids as bytes, n); two bytes an id where the vocabulary allows.

    One more row for each task holds how often each id occurs (``totals``).
    """
    names = ["doc_id", "ids", "n", "totals"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = library_encoder(path)
        last = np.array([end], "<u4").tobytes()
        kind = "<u2" if max(own.size, end + 1) <= 1 << 16 else "<u4"
        totals = np.zeros(max(own.size, end + 1), np.int64)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = [ids + last for ids in own.encode_all(texts)]
            ids = np.frombuffer(b"".join(found), "<u4")
            totals += np.bincount(ids, minlength=len(totals))
            data, width = ids.astype(kind).tobytes(), np.dtype(kind).itemsize
            sizes = np.array([len(f) // 4 for f in found], np.int64)
            ends = (np.cumsum(sizes) * width).tolist()
            cut = [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cut, pa.binary()), pa.array(sizes), pa.nulls(len(cut), pa.binary())], names
            )
        yield pa.RecordBatch.from_arrays(
            [
                pa.nulls(1, pa.int64()),
                pa.nulls(1, pa.binary()),
                pa.nulls(1, pa.int64()),
                pa.array([totals.astype("<i8").tobytes()], pa.binary()),
            ],
            names,
        )

    return stage(docs.mapInArrow(run, "doc_id long, ids binary, n long, totals binary"), "ids")


def _ids(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}").astype(np.uint32)


def _ranked(encoded: DataFrame) -> np.ndarray:
    """All ids that occur, most frequent first; at most one for each word of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                part = np.frombuffer(data, "<i8")
                total = part if not len(total) else total + part
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], ["id", "n"])

    totals = encoded.filter(F.col("totals").isNotNull()).select("totals")
    rows = totals.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return np.array([r["id"] for r in sorted(rows, key=lambda r: (-r["n"], r["id"]))], np.uint32)


def write_tokens(
    docs: DataFrame, row_id: str = "doc_id", text: str = "text", path: str = VOCABULARY, end: int = END
) -> tuple[str, DataFrame, int]:
    """Folder, (file, path, ids) of its files, and their number.

    Documents stand in ascending order of their ids, null ids first; rows with
    one id by number of ids, then a digest of these. Null texts are empty.
    """
    spark = docs.sparkSession
    rows = docs.select(col(row_id).cast("long").alias("doc_id"), F.coalesce(col(text), F.lit("")).alias("text"))
    encoded = _encoded(rows, path, end)
    by_rank = _ranked(encoded)
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    folder = shared_path(spark, "tokens")
    with new_file(f"{folder}/ranks") as file:
        file.write(by_rank.astype("<u4").tobytes())

    def block(ids: list[int | None], parts: list[np.ndarray]) -> bytes:
        sizes = np.array([len(p) for p in parts], "<i8")
        control, data = pack(rank_of[np.concatenate(parts)])
        return b"".join(
            (
                struct.pack(HEADER, MAGIC, len(parts), int(sizes.sum()), len(data)),
                np.array([i or 0 for i in ids], "<i8").tobytes(),
                bytes(i is None for i in ids),
                sizes.tobytes(),
                control,
                data,
            )
        )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        target = f"{folder}/{number:08d}.tok"
        total, ids, parts, held = 0, [], [], 0
        with new_file(target) as file:
            for batch in batches:
                for own, data, n in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
                    ids.append(own)
                    parts.append(_ids(data, n))
                    held += n
                    if held >= BLOCK:
                        file.write(block(ids, parts))
                        total, ids, parts, held = total + held, [], [], 0
            if parts:
                file.write(block(ids, parts))
                total += held
        yield pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.array([target]), pa.array([total], pa.int64())], ["file", "path", "ids"]
        )

    keys = [F.col("doc_id").asc_nulls_first(), F.col("n"), F.col("digest")]
    texts = encoded.filter(F.col("n").isNotNull()).select("doc_id", "ids", "n")
    ordered = texts.withColumn("digest", F.xxhash64("ids")).repartitionByRange(*keys).sortWithinPartitions(*keys)
    listed, n = files(
        ordered.select("doc_id", "ids", "n").mapInArrow(write, "file long, path string, ids long"), "token_files"
    )
    return folder, listed, n


def read_blocks(uri: str) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(document ids, numbers of ids, ranks) of each block of a file."""
    fs, path = store(uri)
    with fs.open_input_stream(path, compression=None) as file:

        def take(n: int) -> bytes:
            data = file.read(n)
            if len(data) != n:
                raise ValueError(f"{uri} is cut off")
            return data

        while head := file.read(struct.calcsize(HEADER)):
            magic, docs, n, size = struct.unpack(HEADER, head)
            if magic != MAGIC:
                raise ValueError(f"{uri} is not a token file")
            own = np.frombuffer(take(8 * docs), "<i8").tolist()
            null = take(docs)
            counts = np.frombuffer(take(8 * docs), "<i8")
            control = take(-(-n // 4))
            yield [None if z else i for i, z in zip(own, null, strict=True)], counts, unpack(control, take(size), n)


def read_tokens(folder: str, listed: DataFrame, n_files: int) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files.

    ``start`` counts the ids of all documents before it.
    """
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    based = listed.select("path", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = store(f"{folder}/ranks")
        with fs.open_input_stream(path, compression=None) as file:
            by_rank = np.frombuffer(file.read(), "<u4")
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for own, counts, ranks in read_blocks(uri):
                    ids = by_rank[ranks].astype("<u4")
                    ends = np.cumsum(counts)
                    sums = [zlib.crc32(ids[e - c : e].tobytes()) for c, e in zip(counts, ends, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(own, pa.int64()),
                            pa.array(start + ends - counts, pa.int64()),
                            pa.array(counts, pa.int64()),
                            pa.array(sums, pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    start += int(ends[-1])

    return based.repartition(max(1, n_files)).mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )
