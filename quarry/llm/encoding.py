"""Encoding many texts with a tokenizer of the tokenizers library, word by word where that is exact.

A tokenizer that normalises by NFC, white space and lower case only, cuts words with a pattern and
then encodes each word on its own gives a word the same ids wherever it stands. Each word is then
encoded by the library once per worker process and kept; a text is its words' ids joined. Any other
tokenizer, and any text holding a character or string that could make a difference, is encoded
whole by the library.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array

import numpy as np
import regex
from tokenizers import Tokenizer

#: Words in either of the two tables that a worker process keeps; when the newer is full it becomes the older.
MOST_WORDS = 500_000
#: Characters that every library classes, composes and lower-cases alike: common letters, digits and signs. Texts with others go to the library whole.
_odd = re.compile("[^\t\n\r -~¡-±´-¸º»¿-įı-ɏΆ-ΡΤ-ώЀ-џ‐-‧‰-⁞₠-₿、-〠ぁ-ゖァ-ヺ一-龥가-힣]").search
#: The pattern of word_bpe_49k.json, and the same for re on texts of such characters, which is faster.
_WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_words = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+").findall
_known: dict[str, WordEncoder] = {}


class WordEncoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.special = [x["content"] for x in told.get("added_tokens") or []]
        self.words = self._pattern(told)
        mark = (told.get("model") or {}).get("end_of_word_suffix")
        self.ends = None
        if mark:
            self.ends = np.zeros(self.vocab_size, bool)
            for token, i in told["model"]["vocab"].items():
                self.ends[i] = token.endswith(mark)
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def of(path: str) -> WordEncoder:
        """One encoder per worker process and path."""
        if path not in _known:
            _known[path] = WordEncoder(path)
        return _known[path]

    @staticmethod
    def _pattern(told: dict):
        """The findall of the word pattern, if the tokenizer has the plain form that words can be encoded alone in."""
        steps = (told.get("normalizer") or {}).get("normalizers") or []
        cuts = (told.get("pre_tokenizer") or {}).get("pretokenizers") or []
        kinds, cut_kinds = [s.get("type") for s in steps], [c.get("type") for c in cuts]
        plain = kinds == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": "\\s+"} and steps[1]["content"] == " "
        plain = plain and cut_kinds == ["Split", "ByteLevel"] and cuts[0].get("invert") and cuts[0]["behavior"] == "Removed" and not cuts[1].get("add_prefix_space") and not cuts[1].get("use_regex")
        model = told.get("model") or {}
        plain = plain and model.get("type") == "BPE" and not model.get("dropout") and "Regex" in cuts[0]["pattern"]
        if not plain:
            return None
        pattern = cuts[0]["pattern"]["Regex"]
        return _words if pattern == _WORDS else regex.compile(pattern).findall

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, words: list[str]) -> None:
        """Encode words with the library: in one text where their ends can be told by the ids, else as a batch."""
        if self.ends is not None:
            ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(words):
                raw, at = ids.tobytes(), 0
                for w, end in zip(words, (ends * 4).tolist(), strict=True):
                    self.kept[w] = raw[at:end]
                    at = end
                return
        for w, e in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True):
            self.kept[w] = array("I", e.ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes | None] = [None] * len(texts)
        cut: list[list[str] | None] = [None] * len(texts)
        kept = self.kept
        if len(kept) > MOST_WORDS:
            self.older, self.kept = kept, {}
            kept = self.kept
        new: set[str] = set()
        for i, text in enumerate(texts):
            if self.words is None or _odd(text) or any(s in text for s in self.special):
                out[i] = self.whole(text)
            else:
                cut[i] = self.words(unicodedata.normalize("NFC", text).lower())
                new |= set(cut[i]).difference(kept)
        if new:
            words = []
            for w in new:
                if (old := self.older.get(w)) is not None:
                    kept[w] = old
                else:
                    words.append(w)
            self._learn(words)
        get = kept.__getitem__
        return [b"".join(map(get, c)) if c is not None else x for c, x in zip(cut, out, strict=True)]


def parts(texts: list[str], most_chars: int = 1 << 20) -> list[tuple[int, int]]:
    """Runs of neighbouring texts of about most_chars characters together."""
    out, start, chars = [], 0, 0
    for i, t in enumerate(texts):
        chars += len(t)
        if chars >= most_chars:
            out.append((start, i + 1))
            start, chars = i + 1, 0
    if start < len(texts):
        out.append((start, len(texts)))
    return out
