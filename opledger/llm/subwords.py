"""Subword ids of whole texts through a per-word cache.

Both tokenizers used here never merge across ASCII white space, so a text's ids
are its words' ids one after another; each distinct word is encoded once.
"""

from __future__ import annotations

import json
import os
import unicodedata
from functools import lru_cache
from itertools import repeat
from pathlib import Path

import numpy as np

#: Words held; a full cache starts afresh, which bounds a worker's memory.
CACHE_WORDS = 400_000


#: What may follow a word's letters: ASCII punctuation but the apostrophe, which can begin a token of its own.
TAIL = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class WordCache:
    """Distinct words to numbers, with the ids of all of them in one flat array.

    ``encode_words`` takes a list of words and returns the ids of all of them in
    one array and the number of ids of each.
    """

    def __init__(self, encode_words, limit: int = CACHE_WORDS):
        self.encode_words, self.limit = encode_words, limit
        self._clear()

    def _clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.flat = np.empty(1 << 16, dtype=np.int32)
        self.begin = np.zeros(1 << 14, dtype=np.int64)
        self.count = np.zeros(1 << 14, dtype=np.int64)
        self.used = 0

    def _learn(self, words: list[bytes]) -> None:
        if self.number and len(self.number) + len(words) > self.limit:
            self._clear()
        ids, count = self.encode_words(words)
        first, k = len(self.number), len(words)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        while first + k > len(self.begin):
            self.begin, self.count = (np.resize(x, 2 * len(x)) for x in (self.begin, self.count))
        self.flat[self.used : self.used + len(ids)] = ids
        self.begin[first : first + k] = self.used + np.cumsum(count) - count
        self.count[first : first + k] = count
        self.used += len(ids)
        self.number.update(zip(words, range(first, first + k), strict=True))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Cache number of each word; words not met before are encoded together."""
        out = np.fromiter(map(self.number.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        missed = np.flatnonzero(out < 0).tolist()
        if missed:
            before, new = len(self.number), list(dict.fromkeys([words[k] for k in missed]))
            self._learn(new)
            if len(self.number) < before + len(new):  # started afresh: the text's other words went
                self._learn([w for w in dict.fromkeys(words) if w not in self.number])
                return np.fromiter(map(self.number.__getitem__, words), dtype=np.int64, count=len(words))
            out[missed] = [self.number[words[k]] for k in missed]
        return out

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the words, and how many ids each has."""
        count = self.count[numbers]
        total = int(count.sum())
        first = np.cumsum(count) - count
        where = np.repeat(self.begin[numbers] - first, count) + np.arange(total)
        return self.flat[where], count


def _raw_bytes() -> dict[str, int]:
    """The byte that each printable stand-in of a byte-level vocabulary means."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _word_end_ranks(path: str) -> tuple[dict[bytes, int], np.ndarray]:
    """The file's merges as byte ranks, a space standing for the word end, and the id of each rank.

    Every last byte joins its word end before any merge of the file, which the
    lowest ranks ensure; then merges follow in the file's order.
    """
    model = json.loads(Path(path).read_text())["model"]
    raw, end = _raw_bytes(), model["end_of_word_suffix"]

    def to_bytes(token: str) -> bytes:
        return bytes(map(raw.__getitem__, token.removesuffix(end))) + (b" " if token.endswith(end) else b"")

    singles = [c for c, _ in sorted(raw.items(), key=lambda x: x[1])]
    order = singles + [c + end for c in singles]
    order += [a + b for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
    ranks: dict[bytes, int] = {}
    ids = np.zeros(len(order), dtype=np.int64)
    for rank, token in enumerate(order):
        ranks.setdefault(to_bytes(token), rank)
        ids[rank] = model["vocab"][token]
    return ranks, ids


class WordEncoder:
    """Ids of a UTF-8 text by a lower-casing word-end BPE file, without special tokens.

    Words of letters with punctuation behind are one or two tokens before BPE;
    they are merged together by ranks and told apart by their word-end ids.  Any
    other word goes through the file's own normaliser and splitter by itself.
    """

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        ranks, self.id_of = _word_end_ranks(path)
        self.merge = tiktoken.Encoding("word-end", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.ends = np.zeros(len(self.id_of), dtype=bool)
        self.ends[[rank for token, rank in ranks.items() if len(token) > 1 and token.endswith(b" ")]] = True
        self.cache = WordCache(self._encode, limit)

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        simple, pieces, parts, other = [], [], [], []
        for k, w in enumerate(words):
            core = w.rstrip(TAIL)
            if core.isalpha() and core.islower() or core and _plain_letters(core):
                simple.append(k)
                pieces.append(core)
                if len(core) < len(w):
                    pieces.append(w[len(core) :])
                    parts.append(2)
                else:
                    parts.append(1)
            else:
                other.append(k)
        count = np.zeros(len(words), dtype=np.int64)
        together = np.zeros(0, dtype=np.int64)
        if simple:
            pieces.append(b"")
            rank = np.array(self.merge(b" ".join(pieces).decode("utf-8")), dtype=np.int64)
            bounds = np.flatnonzero(self.ends[rank])[np.cumsum(parts) - 1] + 1
            count[simple] = np.diff(bounds, prepend=0)
            together = self.id_of[rank]
        alone = [e.ids for e in self.tokenizer.encode_batch_fast([words[k].decode("utf-8", "replace") for k in other], add_special_tokens=False)] if other else []
        count[other] = [len(x) for x in alone]
        out = np.empty(int(count.sum()), dtype=np.int64)
        begin = np.cumsum(count) - count
        if simple:
            c = count[simple]
            out[np.repeat(begin[simple] - (np.cumsum(c) - c), c) + np.arange(len(together))] = together
        for k, x in zip(other, alone, strict=True):
            out[begin[k] : begin[k] + len(x)] = x
        return out, count

    def __call__(self, text: bytes) -> np.ndarray:
        return self.cache.ids(self.cache.numbers(text.lower().split()))[0]


def _plain_letters(core: bytes) -> bool:
    """True for letters that the file's normaliser leaves as they are."""
    try:
        text = core.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return text.isalpha() and text == text.lower() and unicodedata.is_normalized("NFC", text)


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """One encoder, with its cache, for all tasks of a worker process."""
    return WordEncoder(path)
