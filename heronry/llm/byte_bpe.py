"""Byte-level BPE by a sentencepiece model that is written directly from a rank file.

Each token's bytes are mapped to one printable character a byte; the piece scores minus its rank, so the best merge is
the one of lowest rank, leftmost first.  Normalisation is the identity: no prefix space, no escaping, no trimming.
A vocabulary entry that merges alone don't reach is kept in a table of whole pre-tokens (the rank file's own rule is that
a pre-token which is an entry is that entry).  Decoding maps ids back to bytes.
"""

from __future__ import annotations

import array
import base64
import hashlib
import re
import struct
import sys
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from heronry.llm.common import arrow_map, pieces

#: The bytes that stand for themselves; the others are mapped from U+0100 on, in order.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: chr(b) for b in _PLAIN} | {b: chr(0x100 + i) for i, b in enumerate(x for x in range(256) if x not in _PLAIN)}
_LATIN = {b: c for b, c in BYTE_CHARS.items() if ord(c) != b}


def mapped(data: bytes) -> str:
    return data.decode("latin-1").translate(_LATIN)


def _varint(n: int) -> bytes:
    out = b""
    while n > 0x7F:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def _field(number: int, value: bytes | int) -> bytes:
    return _varint(number << 3) + _varint(value) if isinstance(value, int) else _varint(number << 3 | 2) + _varint(len(value)) + value


def model_proto(tokens: list[bytes]) -> bytes:
    """The serialised model; the id of a piece is its place in ``tokens``, the unknown piece comes after them."""
    body = b"".join(_field(1, _field(1, mapped(t).encode()) + b"\x15" + struct.pack("<f", -float(rank))) for rank, t in enumerate(tokens))
    body += _field(1, _field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return body + _field(2, trainer) + _field(3, normalizer)


def read_ranks(path: str) -> list[bytes]:
    """Tokens in order of rank; ranks must run from 0 without gaps and hold each single byte."""
    with open(path, "rb") as f:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, filter(bytes.strip, f))}
    tokens = [ranks[i] for i in range(len(ranks))]
    if not {bytes([b]) for b in range(256)} <= set(tokens):
        raise ValueError("the vocabulary lacks single bytes")
    return tokens


#: Pre-tokens that a worker remembers at most, about 200 bytes each.
MEMO = 600_000


class ByteBpe:
    """Encoder and decoder; a memo keeps the ids of pre-tokens as little-endian uint32 bytes.

    It has two generations of ``most`` / 2 entries: what is used moves to the younger one, and the older one is dropped when that is full.
    """

    def __init__(self, tokens: list[bytes], pattern: str, most: int = MEMO):
        import regex
        import sentencepiece

        self.tokens, self.most = tokens, most
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(tokens))
        self.find = regex.compile(pattern).findall
        self.quick = _latin_pattern(pattern)
        reached = self.model.encode([mapped(t) for t in tokens], num_threads=1)
        self.whole = {t: i for i, t in enumerate(tokens) if reached[i] != [i]}
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def pretokens(self, text: str) -> list[str]:
        return self.quick.findall(text) if self.quick and BEYOND.search(text) is None else self.find(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.pretokens(t) for t in texts]
        distinct = set().union(*split)
        missing = [w for w in distinct if w not in self.memo]
        if len(self.memo) + len(missing) > self.most // 2:
            self.older, self.memo, missing = self.memo, {}, list(distinct)
        memo, older = self.memo, self.older
        if older:
            memo.update((w, older[w]) for w in missing if w in older)
            missing = [w for w in missing if w not in older]
        if missing:
            data = [w.encode("utf-8", "replace") for w in missing]
            for w, raw, ids in zip(missing, data, self.model.encode([mapped(b) for b in data], num_threads=1), strict=True):
                own = self.whole.get(raw)
                memo[w] = _packed(ids if own is None else [own])
        return [b"".join(map(memo.__getitem__, words)) for words in split]

    def decode(self, ids: bytes) -> bytes:
        out = array.array("I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return b"".join(map(self.tokens.__getitem__, out))


def _packed(ids: list[int]) -> bytes:
    out = array.array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


#: Fixed values: \p{L}, \p{N} and \s for code points up to 255, for the standard library's faster matcher.
_LETTER, _NUMBER, _SPACE = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
#: What takes a text to the full matcher.
BEYOND = re.compile("[^\t-\r\x20-\x7e\xa0-\xff–—‘’“”•…€]")


def _latin_pattern(pattern: str) -> re.Pattern | None:
    """The same pattern for texts of common characters, or None if it holds other properties."""
    inner = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{_SPACE}{_LETTER}{_NUMBER}]").replace(r"\p{L}", f"[{_LETTER}]").replace(r"\p{N}", f"[{_NUMBER}]").replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]")
    return None if r"\p" in inner or r"\P" in inner else re.compile(inner)


@lru_cache(maxsize=2)
def load_bpe(path: str, pattern: str, memo: int = MEMO) -> ByteBpe:
    """One encoder a Python worker, kept from task to task."""
    return ByteBpe(read_ranks(path), pattern, memo)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = False, memo: int = MEMO) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) for each row of (doc_id, text).

    Null and empty texts have no ids (the hash of no bytes).  A row in gives a row out, whatever its id; there is no
    shuffle, and memory is bounded by a slice of a batch and the memo.
    """

    def make():
        bpe = load_bpe(ranks_path, pattern, memo)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, ids_hash, text_hash, kept = [], [], [], []
            for _, texts in pieces(batch.column(1)):
                for data in bpe.encode([t or "" for t in texts]):
                    n.append(len(data) // 4)
                    ids_hash.append(hashlib.sha256(data).hexdigest())
                    text_hash.append(hashlib.sha256(bpe.decode(data)).hexdigest())
                    if keep_ids:
                        kept.append(data)
            columns = [batch.column(0), pa.array(n, "int64"), pa.array(ids_hash), pa.array(text_hash)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            return pa.record_batch([*columns, pa.array(kept, "binary")], [*names, "ids"]) if keep_ids else pa.record_batch(columns, names)

        return step

    return arrow_map(docs.select("doc_id", "text"), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids)
