"""Token ids of whole texts by the tokenizers library, with a cache by pre-token.

A byte-level or word BPE merges within a pre-token only, so the ids of a text are those of its
pre-tokens in a row. Texts of common Latin characters are split here and only pre-tokens that the
worker has not met go to the library; any other text goes to the library whole. Strings of special
tokens always do, for the library decides about them.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from .words import spread

#: Pre-tokens that a worker keeps before it starts anew.
CACHE = 400_000
#: Split patterns for which the cache is known to be exact; fixed by the vocabulary files.
SPLITS = {
    "byte": r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    "word": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Letters and numbers among the characters of _PLAIN. Those are the characters that NFC keeps,
#: that lower-case one by one, and whose classes all libraries share.
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-įı-ňŊ-ž", "0-9²³¹¼-¾"
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-įı-ňŊ-ž]*")
#: The same splits over _PLAIN, with the likeliest branch first.
_FAST = {
    "byte": re.compile(rf" ?[{_L}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+"),
    "word": re.compile(rf"[{_L}]+|'(?:s|t|re|ve|m|ll|d)|[{_N}]|[^\s{_L}{_N}]+"),
}


class _Known(dict):
    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at


class Encoder:
    """ids(texts) gives the ids of all texts in a row (uint32) and how many each has."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.split, self.lower = None, False
        if spec["normalizer"] is None and spec["pre_tokenizer"].get("use_regex") and not spec["pre_tokenizer"].get("add_prefix_space"):
            self.split = _FAST["byte"]
        elif spec["pre_tokenizer"].get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex") == SPLITS["word"]:
            self.split, self.lower = _FAST["word"], True
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.forget()

    def forget(self) -> None:
        self.known = _Known()
        self.flat, self.begin, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self) -> None:
        new, self.known.new = self.known.new, []
        got = [x.ids for x in self.library.encode_batch_fast(new, add_special_tokens=False)]
        size = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter((i for x in got for i in x), np.uint32, int(size.sum()))
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])
        self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, flat])

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > CACHE:
            self.forget()
        words: list[str] = []
        n_words, odd = [], []
        for i, text in enumerate(texts):
            if self.split is None or not _PLAIN.fullmatch(text) or any(s in text for s in self.special):
                odd.append(i)
                n_words.append(0)
                continue
            found = self.split.findall(text.lower() if self.lower else text)
            words += found
            n_words.append(len(found))
        codes = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if self.known.new:
            self._learn()
        size = self.size[codes]
        flat = self.flat[spread(self.begin[codes], size)]
        run = np.concatenate([[0], np.cumsum(size)])
        edge = run[np.concatenate([[0], np.cumsum(n_words)]).astype(np.int64)]
        counts = np.diff(edge)
        if not odd:
            return flat, counts
        whole = {i: np.array(x.ids, np.uint32) for i, x in zip(odd, self.library.encode_batch_fast([texts[i] for i in odd], add_special_tokens=False), strict=True)}
        parts = [whole[i] if i in whole else flat[edge[i] : edge[i + 1]] for i in range(len(texts))]
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each path and Python worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def release() -> None:
    """Drops the encoders of this worker: one that served another operator before gives their memory back."""
    _encoders.clear()


def text_steps(texts: list[str | None], size: int = 2 << 20):
    """Runs of texts of about size characters; null is empty."""
    run: list[str] = []
    n = 0
    for t in texts:
        run.append(t or "")
        n += len(run[-1])
        if n >= size:
            yield run
            run, n = [], 0
    if run:
        yield run
