"""Byte-level BPE: texts to token ids with offsets and back, by the `tokenizers` library over
Arrow batches.

The rank file gives each token's bytes. Bytes are written as characters by the usual table (the
printable ones of Latin-1 stand for themselves, the others for U+0100 onwards), and every way to
put a token together from two others is a merge with the token's rank. Null text is encoded as
empty text; an empty text has no ids; the ids of a repeated row are repeated. Any text round
trips, since every byte is a token; a character may be split between tokens, and its bytes are
joined again before they are read as UTF-8.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import FORGET, over_batches

# Pieces kept with their ids in a Python worker while a task runs.
PIECES_KEPT = 100_000
# An alternative that takes words of letters whole, and words of which all characters are letters.
WORDS = r" ?\p{L}+"
LATIN_WORD = re.compile(r" ?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+").fullmatch


def byte_characters() -> list[str]:
    """The character that stands for each byte."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Pieces(dict):
    """Ids of pieces, found when first asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> list[int]:
        if len(self) >= PIECES_KEPT:
            self.clear()
        ids = self[piece] = self.encode(piece)
        return ids


class Codec:
    """Encodes and decodes by one rank file and one splitting pattern."""

    def __init__(self, ranks_file: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        chars = byte_characters()
        written = {token: "".join(chars[b] for b in token) for token in ranks}
        merges = [(written[token[:i]], written[token[i:]])
                  for token in sorted(ranks, key=ranks.get) for i in range(1, len(token))
                  if token[:i] in ranks and token[i:] in ranks]
        vocabulary = {written[token]: rank for token, rank in ranks.items()}
        self.tokenizer = Tokenizer(models.BPE(vocab=vocabulary, merges=merges, ignore_merges=True, cache_capacity=0))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(Regex(pattern), "isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ])
        byte_of = {c: b for b, c in enumerate(chars)}
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in vocabulary.items():
            self.bytes_of[rank] = bytes(byte_of[c] for c in token)
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.written = dict(enumerate(chars))
        self.merge = self.tokenizer.model.tokenize
        alternatives = pattern.split("|")
        self.words_match = WORDS in alternatives and all(a.startswith("'") for a in alternatives[:alternatives.index(WORDS)])
        self.pieces = Pieces(self.encode_piece)

    @staticmethod
    def parts(text: str) -> list[str]:
        """`text` cut before single spaces that stand between two visible characters. No match of
        the pattern crosses such a place: a space there can only begin a match."""
        words = text.split(" ")
        if "" not in words and list(map(str.strip, words)) == words:
            return words[:1] + [" " + w for w in words[1:]]
        out: list[str] = []
        held = ""
        for i, part in enumerate(words):
            piece = " " + part if i else part
            # An empty part, or white space at an edge, may belong with its neighbour.
            if held and (not part or part[0].isspace() or held[-1].isspace()):
                held += piece
            else:
                if held:
                    out.append(held)
                held = piece
        if held:
            out.append(held)
        return out

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.parts(text))))

    def encode_piece(self, piece: str) -> list[int]:
        # A word of letters is one match: its merges are looked for without splitting it first.
        if self.words_match and LATIN_WORD(piece):
            return [t.id for t in self.merge(piece.encode().decode("latin-1").translate(self.written))]
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    def offsets(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """First byte of each token, and the character that this byte belongs to."""
        starts = np.cumsum(self.lengths[ids]) - self.lengths[ids] if ids else np.zeros(0, np.int64)
        raw = np.frombuffer(text.encode(), np.uint8)
        character = np.cumsum((raw & 0xC0) != 0x80) - 1
        return starts, character[starts] if len(raw) else np.zeros(0, np.int64)

    def decode(self, ids) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in ids])


CODECS: list[Codec] = []


@lru_cache(2)
def codec(ranks_file: str, pattern: str) -> Codec:
    CODECS.append(Codec(ranks_file, pattern))
    return CODECS[-1]


def _forget_pieces() -> None:
    for c in CODECS:
        c.pieces.clear()


FORGET.append(_forget_pieces)


def encode(docs: DataFrame, ranks_file: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids, and per token its first byte and the character that this byte is part of."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(ranks_file, pattern)
        ids, starts, chars = [], [], []
        for t in batch.column("text").to_pylist():
            ids.append(c.encode(t or ""))
            s, at = c.offsets(t or "", ids[-1])
            starts.append(s)
            chars.append(at)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(starts, pa.list_(pa.int64())),
             pa.array(chars, pa.list_(pa.int64()))], ["doc_id", "ids", "byte_starts", "char_starts"])

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return over_batches(picked, work, "doc_id long, ids array<int>, byte_starts array<long>, char_starts array<long>")


def decode(coded: DataFrame, ranks_file: str, pattern: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id, the decoded bytes, and those bytes as text (broken characters as U+FFFD)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(ranks_file, pattern)
        raw = [c.decode(x or ()) for x in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(raw, pa.binary()), pa.array([b.decode("utf-8", "replace") for b in raw], pa.string())],
            ["doc_id", "decoded", "text"])

    picked = coded.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).alias("ids"))
    return over_batches(picked, work, "doc_id long, decoded binary, text string")


def round_trip(docs: DataFrame, ranks_file: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of what they decode to, in one pass."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(ranks_file, pattern)
        n, ids_digest, text_digest = [], [], []
        for t in batch.column("text").to_pylist():
            ids = c.encode(t or "")
            n.append(len(ids))
            ids_digest.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
            text_digest.append(hashlib.sha256(c.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(text_digest, pa.string())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return over_batches(picked, work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
