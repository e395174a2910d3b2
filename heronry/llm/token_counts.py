"""Token counts, with overlap resynchronisation for huge documents.

Texts up to ``window`` characters are encoded whole (their words through a memo, see ``heronry.llm.word_memo``).  A longer one is encoded in overlapping windows
with offsets.  Neighbouring windows are spliced at a boundary that both encodings have in their overlap
and that is proven stable: there a token starts, and the character before it is white space, which the
tokenizer drops and across which it neither normalises nor splits nor merges.  If the overlap holds
no such boundary, it is doubled and encoded anew, up to the rest of the text.
"""

from __future__ import annotations

import os
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from heronry.llm.common import arrow_map, pieces

WINDOW, OVERLAP = 16_384, 512
SPACE = frozenset(" \t\n\x0b\x0c\r")


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task; Spark deals out the work
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _stable(encoding, base: int, text: str, lo: int, hi: int) -> dict[int, int]:
    """Positions in (lo, hi) where a token starts after white space -> index of that token."""
    out: dict[int, int] = {}
    for i, (a, b) in enumerate(encoding.offsets):
        at = base + a
        if lo < at < hi and b > a and text[at - 1] in SPACE:
            out.setdefault(at, i)
    return out


def spliced_ids(tokenizer, text: str, window: int = WINDOW, overlap: int = OVERLAP) -> list[int]:
    """The ids of the whole text, from overlapping windows; equal to encoding it at once."""
    ids: list[int] = []
    n, begin, end, start = len(text), 0, min(len(text), window), 0
    part, first = tokenizer.encode(text[:end], add_special_tokens=False), 0  # first: its first token not taken yet, at start
    while end < n:
        width = min(overlap, end - begin)
        while True:
            lo = end - width
            to = min(n, lo + max(window, 2 * width))
            after = tokenizer.encode(text[lo:to], add_special_tokens=False)
            ours, theirs = _stable(part, begin, text, max(lo, start), end), _stable(after, lo, text, lo, end)
            if common := ours.keys() & theirs.keys():
                start = min(common, key=lambda x: abs(2 * x - lo - end))  # far from either window's edge
                ids += part.ids[first : ours[start]]
                first = theirs[start]
            elif lo > begin:
                width = min(2 * width, end - begin)
                continue
            else:  # the overlap has become the whole window, which so grows
                first = next((i for i, (a, _) in enumerate(after.offsets) if lo + a == start), 0) if start else 0
            part, begin, end = after, lo, to
            break
    return ids + part.ids[first:]


def token_counts(docs: DataFrame, tokenizer_path: str, over: int = 2048, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of (doc_id, text).

    Null texts count as empty; empty ones have 0 tokens.  Null ids, repeated rows and further columns are
    no matter: a row in gives a row out.  No shuffle; memory is bounded by a slice of a batch and one text.
    """

    def make():
        from heronry.llm.word_memo import word_ids

        tokenizer, memo = load_tokenizer(tokenizer_path), word_ids(tokenizer_path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts: list[int] = []
            for _, texts in pieces(batch.column(1)):
                texts = [t or "" for t in texts]
                short = iter(memo.encode([t for t in texts if len(t) <= window]))
                counts += [len(next(short)) // 4 if len(t) <= window else len(spliced_ids(tokenizer, t, window, overlap)) for t in texts]
            sizes = pc.binary_length(batch.column(1)).fill_null(0).cast("int64")
            n = pa.array(counts, "int64")
            return pa.record_batch([batch.column(0), sizes, n, pc.greater(n, over)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

        return step

    return arrow_map(docs.select("doc_id", "text"), make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
