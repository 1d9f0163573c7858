"""Noisy-channel restoration of disguised words.

A character language model (trigrams over ``CLASSES`` letter classes, counted on
the whole corpus) scores the letters that a disguised word may stand for.  The
lattice of a word has, at each character, the letters it may replace with a
channel cost: itself, a look-alike letter, any letter for a mask, nothing for a
separator or for a further copy of a repeated letter.  Viterbi search over the
last two letters finds the cheapest reading.  A word whose lattice has a single
path is its own reading and needs no search.
"""

from __future__ import annotations

import re

import numpy as np

#: Letter classes: 0 a word's edge, 1-26 the letters, the rest shares bytes beyond ASCII.
CLASSES = 40
CLASS_OF = np.zeros(256, dtype=np.int64)
CLASS_OF[65:91] = CLASS_OF[97:123] = np.arange(1, 27)
CLASS_OF[128:] = 27 + np.arange(128) % 13

#: What a character of a disguised word may stand for.
LOOKALIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¥": "y",
}
MASKS, SEPARATORS = "*#%", ".-_*~'·,/ "
COST_LIKE, COST_MASK, COST_DROP, COST_KEEP, COST_REPEAT, COST_SECOND = 0.7, 3.3, 0.3, 6.0, 0.2, 1.2

_EDGE = re.compile(r"^[\s.,;:?\"'()\[\]<>&%#*-]+|([.,;:?!\"'()\[\]<>]+|([*#$%&!|<>])\2+)+$")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_SPREAD = re.compile(r"^[^\W_](?:[.\-_*~'·,/ ]{1,2}[^\W_]){2,}$")
_ODD = re.compile(r"[^\W\d_].*[0-9@$!|+(€£¥*#%]|[0-9@$!|+(€£¥].*[^\W\d_]")


class CharModel:
    """Trigram costs from counts, in nats, with add-one smoothing by the bigram."""

    def __init__(self, counts: np.ndarray):
        tri = counts.reshape(CLASSES, CLASSES, CLASSES).astype(np.float64)
        bi = tri.sum(0) + 0.1
        bi /= bi.sum(1, keepdims=True)
        self.cost = -np.log((tri + 20 * bi[None]) / (tri.sum(2, keepdims=True) + 20))

    @staticmethod
    def counts(data: bytes) -> np.ndarray:
        """Trigram counts of one text; two edges precede it and one follows."""
        c = CLASS_OF[np.frombuffer(b"  " + data + b" ", dtype=np.uint8)]
        return np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)


def stripped(word: str) -> str:
    """The word without punctuation and runs of symbols at its ends."""
    return _EDGE.sub("", _EDGE.sub("", word))


def disguised(core: str) -> bool:
    """True if the lattice of the stripped word has more than its own path."""
    if core.isalpha():
        return _TRIPLE.search(core) is not None
    if _SPREAD.match(core):
        return True
    letters = sum(map(str.isalpha, core))
    return letters >= 2 and 3 * letters >= len(core) and _ODD.search(core) is not None


def _choices(core: str) -> list[list[tuple[str, float]]]:
    out, k, n, spread = [], 0, len(core), _SPREAD.match(core) is not None
    while k < n:
        ch = core[k]
        if ch.isalpha():
            run = k + 1
            while run < n and core[run] == ch:
                run += 1
            out.append([(ch, 0.0)])
            if run - k == 2:
                out.append([(ch, 0.0), ("", COST_SECOND)])
            elif run - k > 2:
                out.append([(ch, COST_SECOND), ("", COST_REPEAT)])
            k = run
            continue
        options = [(x, COST_LIKE) for x in LOOKALIKE.get(ch, "")]
        if ch in SEPARATORS and (spread or ch not in MASKS):
            options.append(("", COST_DROP))
        if ch in MASKS:
            options += [(chr(x), COST_MASK) for x in range(97, 123)]
        out.append([*options, (" ", COST_KEEP if options else 0.0)])
        k += 1
    return out


def restore(core: str, model: CharModel) -> str:
    """Cheapest reading of a stripped word; spaces part it where a character stayed unread."""
    cost = model.cost
    best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for options in _choices(core.lower()):
        step: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (paid, text) in best.items():
            for letter, price in options:
                if letter:
                    c = int(CLASS_OF[letter.encode("utf-8", "replace")[0]])
                    state, total = (b, c), paid + price + cost[a, b, c]
                else:
                    state, total = (a, b), paid + price
                if state not in step or total < step[state][0]:
                    step[state] = (total, text + letter)
        best = step  # all states of the last two letters: at most CLASSES squared
    return min((paid + cost[a, b, 0], text) for (a, b), (paid, text) in best.items())[1]


def reading(word: str, model: CharModel) -> str:
    """The word as it reads: restored if disguised, else its stripped self in lower case."""
    core = stripped(word)
    return restore(core, model) if core and disguised(core) else core.lower()


_SINGLES = re.compile(r"(?<!\S)[^\W_](?:[ \t]+[^\W_]){2,}(?!\S)")


def spaced_runs(text: str) -> list[str]:
    """Runs of three and more single characters with white space between."""
    return [re.sub(r"[ \t]+", " ", m) for m in _SINGLES.findall(text)]
