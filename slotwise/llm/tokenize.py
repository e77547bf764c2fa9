"""Ids of public tokenizers, with the ids of frequent chunks of text kept by each worker."""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache

import numpy as np
import regex

from .common import kept

KEPT = 300_000  # chunks in each of the two generations that a worker keeps
JOINED = 400  # missing words that the library gets as one text


def file_digest(path: str) -> str:
    """sha256 of the tokenizer file, its version."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


@lru_cache(maxsize=4)
def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def plain_ids(path: str, text: str) -> list[int]:
    """The library's ids of a whole text, without special tokens added."""
    return _load(path).encode(text, add_special_tokens=False).ids


# Chunks of a byte-level tokenizer: its own rule for the splits, at which no merge crosses.
# Fixed values of the public tokenizer.
BYTE_CHUNKS = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


class Recent(dict):
    """A bounded memory: what was not used for a whole generation is forgotten."""

    def __init__(self):
        super().__init__()
        self.old: dict = {}

    def missing(self, keys: set) -> list:
        """Those of `keys` that are known in neither generation; the others are young now."""
        new = {k for k in keys if k not in self}
        if len(self) + len(new) > KEPT:
            self.old = dict(self)
            self.clear()
            new = keys
        back = {k for k in new if k in self.old}
        self.update((k, self.old[k]) for k in back)
        return list(new - back)


class ByteCounter:
    """Numbers of tokens of a byte-level tokenizer that has no normaliser.

    A text is cut by the tokenizer's own split rule; chunks met before have a known count
    and the library encodes the others. Texts that hold one of the special strings are left
    to the library whole.
    """

    def __init__(self, path: str):
        self.path = path
        self.known = Recent()
        self.special = [t.content for t in _load(path).get_added_tokens_decoder().values()]

    def _learn(self, chunks: list[str]) -> None:
        # A chunk by itself is split in no other way, so its count is that in the text.
        found = _load(self.path).encode_batch_fast(chunks, add_special_tokens=False)
        self.known.update((c, len(e.ids)) for c, e in zip(chunks, found, strict=True))

    def counts(self, texts: list[str]) -> list[int]:
        cut = [None if any(s in t for s in self.special) else BYTE_CHUNKS.findall(t) for t in texts]
        known = self.known
        new = known.missing({c for chunks in cut if chunks for c in chunks})
        if new:
            self._learn(new)
        return [
            len(plain_ids(self.path, t)) if chunks is None else sum(map(known.__getitem__, chunks))
            for t, chunks in zip(texts, cut, strict=True)
        ]


# The normaliser and the rule for words of a tokenizer that lower-cases and drops white space,
# as they stand in the file of the public tokenizer.
_LOWER = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPLIT = {"type": "Split", "pattern": {"Regex": _RULE}, "behavior": "Removed", "invert": True}
# Characters that NFC leaves alone, and whose lower case and kind are the same in all versions of
# Unicode, combining marks not among them; and the rule for these, in lower case.
_OTHER = re.compile(
    "[^\t\n\r -~\xa0-\xa9\xab\xac\xae-\xb1\xb4\xb6-\xb8\xbb\xbf-\u012f\u0131-\u0148\u014a-\u017e"
    "\u0401\u0410-\u044f\u0451\u2010-\u2027\u20ac]"
)
_LETTERS = "a-z\xdf-\xf6\xf8-\u017e\u0430-\u044f\u0451"
_WORDS = re.compile(rf"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\s0-9{_LETTERS}]+")


def _byte_letters() -> dict[int, str]:
    """The letter that a byte-level tokenizer has for each byte; a blank stays one."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)} | {32: " "}


class WordEncoder:
    """Ids of a tokenizer that lower-cases and drops white space between words.

    Its rule for words never looks across white space, so the ids of a text are those of its
    white-space chunks in order, and no merge crosses words. Chunks met before have known ids;
    the words of the others go to the library's model, many at once. The last id of a word, and
    no other, ends with the model's suffix, which tells the words of the answer apart. Texts with
    special strings or characters whose normal form the library alone knows go to it whole, and
    so do all texts if the file has another rule.
    """

    def __init__(self, path: str):
        self.path = path
        self.known = Recent()
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        self.special = [t["content"] for t in made["added_tokens"]]
        model, cuts = made["model"], made["pre_tokenizer"] or {}
        steps = cuts.get("pretokenizers", [])
        byte_level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
        self.ruled = (
            made["normalizer"] == _LOWER
            and len(steps) == 2
            and steps[0] == _SPLIT
            and byte_level.items() <= steps[1].items()
            and model["type"] == "BPE"
            and bool(model["end_of_word_suffix"])
        )
        if self.ruled:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            vocab, suffix = model["vocab"], model["end_of_word_suffix"]
            letters = _byte_letters()
            self.letters = letters
            # Each byte has an id of its own, so nothing of a word is left out.
            self.ruled = all(c in vocab and c + suffix in vocab for b, c in letters.items() if b != 32)
            self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
            self.ends[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
            bare = made | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
            self.model = Tokenizer.from_str(json.dumps(bare | {"post_processor": None}))

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words by the model alone, JOINED words in a text."""
        texts = [" ".join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)]
        texts = [t.encode().decode("latin-1").translate(self.letters) for t in texts]
        found = self.model.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, dtype="<u4"), *(np.array(one.ids, dtype="<u4") for one in found)])
        ends = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def _learn(self, chunks: list[str]) -> None:
        known = self.known
        mixed = {c: _WORDS.findall(c) for c in chunks if not c.isalpha()}
        found, new = {}, [c for c in chunks if c not in mixed]
        for word in {w for words in mixed.values() for w in words}.difference(new):
            if (ids := known.get(word) or known.old.get(word)) is not None:
                found[word] = ids
            else:
                new.append(word)
        learnt = dict(zip(new, self._words(new), strict=True))
        found |= learnt
        known.update(learnt)
        known.update((c, b"".join([found[w] for w in words])) for c, words in mixed.items())

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        cut = [
            t.lower().split()
            if self.ruled and not _OTHER.search(t) and not any(s in t for s in self.special)
            else None
            for t in texts
        ]
        known = self.known
        new = known.missing({c for chunks in cut if chunks for c in chunks})
        if new:
            self._learn(new)
        get = known.__getitem__
        return [
            np.array(plain_ids(self.path, t), dtype="<u4")
            if chunks is None
            else np.frombuffer(b"".join(map(get, chunks)), dtype="<u4")
            for t, chunks in zip(texts, cut, strict=True)
        ]


def word_encoder(path: str) -> WordEncoder:
    """The encoder of this worker process, which its tasks use one after the other until
    those of another operator come."""
    return kept(WordEncoder, path)
