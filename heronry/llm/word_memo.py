"""Token ids through a memo of words.

The tokenizers library encodes a word once, not each time it occurs; texts for which a split into words could differ from
the library's own go to it whole.  So do all texts where the tokenizer's own steps are not the ones that the split stands for.
"""

from __future__ import annotations

import array
import json
import re
import sys
from functools import lru_cache

from heronry.llm.token_counts import load_tokenizer

#: The pre-tokenizer's classes for code points up to 255 and for common punctuation above.
LETTERS, NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾"
WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")
#: A text with any other character, or with what may be a special token, is left to the library.
ODD = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e\xa0-\xff–—‘’“”•…€]|<\\|")
#: The steps before the model, and its settings, under which words can be encoded one by one.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def splits_alike(spec: dict) -> bool:
    """Whether ``WORD`` over the lower-cased text gives what the tokenizer of this specification splits a text into."""
    marked = all(t["content"].startswith("<|") for t in spec.get("added_tokens") or ())
    return spec.get("normalizer") == NORMALIZER and spec.get("pre_tokenizer") == PRE_TOKENIZER and marked and not spec["model"].get("dropout")


def _packed(ids: list[int]) -> bytes:
    out = array.array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class WordIds(dict):
    """lower-cased word -> its ids as little-endian uint32 bytes; holds ``most`` words at most (about 200 MB)."""

    def __init__(self, tokenizer, most: int = 1_000_000):
        from tokenizers import Tokenizer

        # words are normalised and split already; for them the same model does without either step
        own = json.loads(tokenizer.to_str())
        self.alike = splits_alike(own)
        spec = own | {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}}
        self.tokenizer, self.words, self.most = tokenizer, Tokenizer.from_str(json.dumps(spec)), most

    def learn(self, words: set[str]) -> None:
        if missing := [w for w in words if w not in self]:
            if len(self) + len(missing) > self.most:
                self.clear()
                missing = list(words)
            for word, e in zip(missing, self.words.encode_batch_fast(missing, add_special_tokens=False), strict=True):
                self[word] = _packed(e.ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [self.alike and t is not None and ODD.search(t) is None for t in texts]
        split = [WORD.findall(t.lower()) if p else () for t, p in zip(texts, plain, strict=True)]
        self.learn(set().union(*split))
        whole = iter(self.tokenizer.encode_batch_fast([t or "" for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
        return [b"".join(map(self.__getitem__, words)) if p else _packed(next(whole).ids) for words, p in zip(split, plain, strict=True)]


@lru_cache(maxsize=1)
def word_ids(tokenizer_path: str) -> WordIds:
    """One memo a Python worker, kept from task to task."""
    return WordIds(load_tokenizer(tokenizer_path))
