"""Byte-pair encoding by backtracking over longest matches, and decoding.

An automaton of all token strings (Aho-Corasick) gives the longest token at each
position of a word. The encoder takes the longest one that can stand after the
token before it; where no token can, it takes back the last one and tries the
next shorter. Two tokens can stand side by side if merging their joined bytes
gives back just these two; a table keeps the answers. A sequence of tokens whose
neighbours are all compatible is the one that the merges give, so the result is
exact. No position is tried twice, so the time is linear in the word.

Decoding looks up all ids of a text at once in one string of token bytes, by a
table of offsets.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldsift.llm.pretokens import Memo, byte_letters, pieces
from fieldsift.llm.shared import col

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
# Compatible pairs that are kept at a time.
PAIRS = 1 << 18


class Coder:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        to_bytes = lambda token: bytes(map(letters.__getitem__, token))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.strings = {i: to_bytes(t) for t, i in vocab.items()}
        ids = {s: i for i, s in self.strings.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        # (left id, right id) -> (rank, merged id)
        self.merges = {
            (vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)
        }
        self.byte_ids = [ids[bytes([b])] for b in range(256)]
        # The tokens that merging their own bytes gives back.
        self.whole = {s: i for s, i in ids.items() if self._merged(s) == [i]}
        self.automaton = ahocorasick.Automaton()
        for s, i in self.whole.items():
            self.automaton.add_word(s.decode("latin-1"), (i, len(s)))
        self.automaton.make_automaton()
        # The longest token that is a proper prefix of a token.
        self.shorter = {}
        for s, i in self.whole.items():
            cut = next(n for n in range(len(s) - 1, -1, -1) if n == 0 or s[:n] in self.whole)
            self.shorter[i] = self.whole[s[:cut]] if cut else None
        self.compatible: dict[tuple[int, int], bool] = {}
        self.memo = Memo(self._word)
        self._offsets(spec)

    def _merged(self, data: bytes) -> list[int]:
        """The merges themselves, lowest rank first: only for token-sized strings."""
        ids = [self.byte_ids[b] for b in data]
        while len(ids) > 1:
            ranks = [self.merges.get(p, (1 << 40, 0)) for p in zip(ids, ids[1:], strict=False)]
            rank, merged = min(ranks)
            if rank == 1 << 40:
                break
            out, at = [], 0
            while at < len(ids):
                if at < len(ranks) and ranks[at][0] == rank:
                    out.append(merged)
                    at += 2
                else:
                    out.append(ids[at])
                    at += 1
            ids = out
        return ids

    def _fits(self, left: int, right: int) -> bool:
        """Whether the two tokens can stand side by side."""
        pair = (left, right)
        known = self.compatible.get(pair)
        if known is None:
            if len(self.compatible) >= PAIRS:
                self.compatible.clear()
            known = self._merged(self.strings[left] + self.strings[right]) == [left, right]
            self.compatible[pair] = known
        return known

    def encode_word(self, data: bytes) -> list[int]:
        """Ids of a word, as merging it gives them."""
        whole = self.whole.get(data)
        if whole is not None:
            return [whole]
        longest: dict[int, int] = {}
        best: dict[int, int] = {}
        for end, (token, size) in self.automaton.iter(data.decode("latin-1")):
            start = end - size + 1
            if size > best.get(start, 0):
                best[start], longest[start] = size, token
        ids: list[int] = []
        at, dead, token = 0, set(), longest[0]
        while True:
            while token is not None:
                end = at + len(self.strings[token])
                if end not in dead and (not ids or self._fits(ids[-1], token)):
                    break
                token = self.shorter[token]
            if token is not None:
                ids.append(token)
                at = end
                if at == len(data):
                    return ids
                token = longest[at]
            else:  # nothing can stand here: another token must end elsewhere
                dead.add(at)
                last = ids.pop()
                at -= len(self.strings[last])
                token = self.shorter[last]

    def _word(self, word: str) -> tuple[str, bytes, int]:
        """Decimal ids, ids as 32-bit integers, number of ids."""
        ids = self.encode_word(word.encode("utf-8"))
        return ",".join(map(str, ids)), array("I", ids).tobytes(), len(ids)

    def segments(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Parts of the text between special tokens, and those tokens' ids."""
        at = 0
        while self.special:
            found = [(i, -len(s), s) for s in self.special if (i := text.find(s, at)) >= 0]
            if not found:
                break
            i, _, s = min(found)
            yield text[at:i], None
            yield s, self.special[s]
            at = i + len(s)
        yield text[at:], None

    def encode(self, text: str) -> tuple[str, np.ndarray]:
        """Ids of a text: decimal, joined by commas, and as an array."""
        decimal, parts = [], []
        for part, special in self.segments(text):
            if special is not None:
                decimal.append(str(special))
                parts.append(np.array([special], "<u4").tobytes())
            elif part:
                words = self.memo.all(pieces(part))
                decimal.append(",".join([w[0] for w in words]))
                parts.append(b"".join([w[1] for w in words]))
        return ",".join(decimal), np.frombuffer(b"".join(parts), "<u4")

    def _offsets(self, spec: dict) -> None:
        strings = self.strings | {i: s.encode() for s, i in self.special.items()}
        table = [strings.get(i, b"") for i in range(max(strings) + 1)]
        self.lengths = np.array([len(s) for s in table], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.blob = np.frombuffer(b"".join(table), np.uint8)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are not UTF-8 become U+FFFD."""
        parts = []
        for at in range(0, len(ids), 1 << 16):
            part = ids[at : at + (1 << 16)]
            sizes = self.lengths[part]
            ends = np.cumsum(sizes)
            shift = np.repeat(self.starts[part] - (ends - sizes), sizes)
            parts.append(self.blob[shift + np.arange(len(shift))].tobytes())
        return b"".join(parts).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def coder(path: str) -> Coder:
    """One for each Python worker."""
    return Coder(path)


def round_trip(docs: DataFrame, row_id: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row.

    Null and empty texts have no ids. Repeated rows and null ids pass through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for value in batch.column(1):
                decimal, ids = own.encode(value.as_py() or "")
                counts.append(len(ids))
                of_ids.append(sha256(decimal.encode()).hexdigest())
                of_text.append(sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_text)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(col(row_id).cast("long").alias("doc_id"), F.coalesce(col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, row_id: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) with ids as an array of integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in batches:
            ids = [own.encode(v.as_py() or "")[1].astype(np.int32) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"]
            )

    rows = docs.select(col(row_id).cast("long").alias("doc_id"), F.coalesce(col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in batches:
            found = [own.decode(np.array(v.as_py() or [], np.int64)) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
