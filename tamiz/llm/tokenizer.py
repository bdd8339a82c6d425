"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 8).

A sentencepiece BPE model is serialised directly from the vocabulary: each token is a piece whose bytes are mapped to
printable characters, scored by its negative rank, with identity normalisation. A text is split into pre-tokens by the
vocabulary's pattern; each distinct pre-token is encoded once per worker and remembered. Decoding maps ids back to
bytes. Merging by best score equals merging by lowest rank, so the ids are those of the vocabulary's own encoder.

Empty and null texts have an empty list of ids. Strings that look like special tokens are ordinary text. Texts are
encoded whole, whatever their length; lone surrogates can't occur in columns.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Most pre-tokens that a worker remembers.
REMEMBERED = 200_000


def _printable() -> list[str]:
    """One printable character for each byte: itself where it is printable, else the next unused one from U+0100."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [""] * 256, 0x100
    for b in range(256):
        if b in keep:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return out


BYTE_CHARS = _printable()
CHAR_BYTES = {c: b for b, c in enumerate(BYTE_CHARS)}
_TABLE = str.maketrans({chr(b): c for b, c in enumerate(BYTE_CHARS)})


def mapped(raw: bytes) -> str:
    """Bytes as printable characters."""
    return raw.decode("latin-1").translate(_TABLE)


def unmapped(text: str) -> bytes:
    """Inverse of ``mapped``."""
    return bytes(CHAR_BYTES[c] for c in text)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, payload: bytes | int) -> bytes:
    if isinstance(payload, int):
        return _varint(number << 3) + _varint(payload)
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model: pieces in order of rank (so that ids are ranks), then the unknown piece it requires."""
    model = bytearray()
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        piece = _field(1, mapped(token).encode()) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)) + _field(3, 1)
        model += _field(1, piece)
    model += _field(1, _field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _field(3, 2))
    unk = len(ranks)
    trainer = _field(3, 2) + _field(4, unk + 1) + _field(40, unk) + b"".join(_varint(n << 3) + _varint(2**64 - 1) for n in (41, 42, 43))
    model += _field(2, trainer)
    model += _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return bytes(model)


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the public vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens with their ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class Codec:
    """Encoder and decoder over one vocabulary; lives in a worker."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        ranks = read_ranks(path)
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        self.pieces = [t for t, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.find = regex.compile(pattern).findall
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        known, out = self.known, []
        tokens = self.find(text)
        new = list({t for t in tokens if t not in known})
        if new:
            if len(known) > REMEMBERED:
                known.clear()
                new = list(set(tokens))
            known.update(zip(new, self.processor.encode([mapped(t.encode()) for t in new], num_threads=1), strict=True))
        for t in tokens:
            out += known[t]
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.pieces[i] for i in ids).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """The codec of this worker, made once."""
    return Codec(path, pattern)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def token_ids(text: Column, path: str | None = None) -> Column:
    """Token ids of a text column; empty for empty and null texts."""
    path, pattern = path or vocabulary_path(), _pattern()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path, pattern)
        for texts in batches:
            yield texts.map(c.encode, na_action=None)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<int>")(text)


def token_counts(text: Column, path: str | None = None) -> Column:
    """Number of tokens of a text column; 0 for empty and null texts."""
    path, pattern = path or vocabulary_path(), _pattern()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path, pattern)
        for texts in batches:
            yield pd.Series([len(c.encode(t)) for t in texts], dtype="int64")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "long")(text)


def token_texts(ids: Column, path: str | None = None) -> Column:
    """Inverse of ``token_ids``: the text of a list of ids."""
    path, pattern = path or vocabulary_path(), _pattern()

    def run(lists: pd.Series) -> pd.Series:
        c = codec(path, pattern)
        return lists.map(lambda x: None if x is None else c.decode(list(x)))

    run.__annotations__ = {"lists": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(ids)


def p8_ids(documents: DataFrame) -> DataFrame:
    """(``doc_id``, ``ids``) of every document; a map over the scan, so tasks are as even as the splits of the files."""
    return documents.select("doc_id", token_ids(F.col("text")).alias("ids"))
