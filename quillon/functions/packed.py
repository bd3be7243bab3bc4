"""Words over acgt as whole numbers, two bits a letter: arrays for what runs on batches of sequences."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa

from .nucleotides import AMBIGUOUS, COMPLEMENTS, LETTERS, RANKED

#: The longest word that a signed 64-bit number holds.
LONGEST = 31
_CODE = np.full(256, -1, np.int8)
_CODE[np.frombuffer(b"acgtACGT", np.uint8)] = [0, 1, 2, 3] * 2
_LETTERS = np.frombuffer(b"acgt", np.uint8)


def plain(sequence: str) -> bytes:
    """A byte a letter; what isn't ASCII becomes a letter that no word has."""
    return sequence.encode("ascii", "replace")


def rolling(sequence: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, codes) of all words of k letters acgt, overlapping; a place that another letter touches has none."""
    if k > LONGEST:
        raise ValueError(f"words of over {LONGEST} letters aren't supported")
    letters = _CODE[np.frombuffer(sequence, np.uint8)]
    n = len(letters) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.zeros(n, np.int64)
    for i in range(k):
        code = (code << 2) | (letters[i : i + n] & 3)
    wrong = np.concatenate([[0], np.cumsum(letters < 0)])
    places = np.flatnonzero(wrong[k:] == wrong[:n])
    return places, code[places]


def counted(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The different codes in order, and how often each occurs."""
    if 4**k <= max(256, 4 * len(codes)):
        n = np.bincount(codes, minlength=4**k)
        there = np.flatnonzero(n)
        return there, n[there]
    return np.unique(codes, return_counts=True)


def words(codes: np.ndarray, k: int) -> pa.Array:
    """The words as strings."""
    shifts = 2 * np.arange(k - 1, -1, -1)
    letters = _LETTERS[(codes[:, None] >> shifts) & 3]
    offsets = pa.py_buffer((np.arange(len(codes) + 1) * k).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.string(), len(codes), [None, offsets, pa.py_buffer(letters.tobytes())])


def matching(word: str) -> list[int]:
    """The codes of the plain words that a word with ambiguous letters matches."""
    out = [0]
    for c in word:
        bases = ["acgt".index(b) for b in AMBIGUOUS.get(c, c)]
        out = [x << 2 | b for x, b in itertools.product(out, bases)]
    return out


def wider(base: str, alphabet: str) -> list[str]:
    """The base, and the ambiguous letters of the alphabet that stand for it."""
    if alphabet == "nucleotide":
        return [base]
    codes = {"n": "acgt"} if alphabet == "gapped-nucleotide" else AMBIGUOUS
    return [base, *(c for c, bases in codes.items() if base in bases)]


def order_key(word: str) -> list[int]:
    """Sorts words in the alphabet's order, where n comes after t."""
    return [RANKED.index(c) for c in word]


def images(word: str, spec) -> set[str]:
    """The word and what the spec's maps lead to."""
    flip = str.maketrans(LETTERS, COMPLEMENTS)
    out = {word}
    if spec.complement or (spec.revcomp and spec.reverse):
        out.add(word.translate(flip))
    if spec.reverse or (spec.revcomp and spec.complement):
        out.add(word[::-1])
    if spec.revcomp or (spec.reverse and spec.complement):
        out.add(word.translate(flip)[::-1])
    return out
