"""Byte-level BPE: ids of texts, and token counts of every prefix by dynamic programming.

A text is cut before white space that follows something else: no pre-token spans such a
place, and what stands before it is split alike whatever follows. Of the chunks, and of
the pre-tokens in them, each different one is worked on once in a part of the texts, all
of them together, a byte a step.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Bytes of texts whose chunks are worked on together; pre-tokens in one table; bytes of a
#: pre-token that goes into a table (longer ones are worked on one by one).
PART, ROWS, WIDTH = 8_000_000, 1 << 15, 40
#: Slots for pairs of tokens whose compatibility is remembered, as a power of 2.
SLOTS = 20
#: Characters below this are classified alike by every Unicode version in use.
_LATIN = re.compile("[^\x00-\u024f]")
#: Unicode's White_Space.
_BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(f"[{_BLANK}]+[^{_BLANK}]*|[^{_BLANK}]+")
_RUN = re.compile(f"[{_BLANK}][{_BLANK}]")
_CONTRACTED = frozenset(["'ll", "'ve", "'re"])
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xC2B2AE3D27D4EB4F)


def _differences(counts: list[int]) -> bytes:
    return array("h", [b - a for a, b in zip([0, *counts], counts, strict=False)]).tobytes()


def _latin_pieces() -> re.Pattern:
    """The pre-tokens of a text of Latin characters with single blanks at most."""
    kind = lambda x: "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == x)
    letters, numbers = kind("L"), kind("N")
    return re.compile(f"'(?:[sdmt]|ll|ve|re)| ?[{letters}]+| ?[{numbers}]+| ?[^{_BLANK}{letters}{numbers}]+|[{_BLANK}]")


class Ranks:
    """Token ids by a hash of 64 bits of their bytes, for many strings at once."""

    def __init__(self, tokens: dict[bytes, int]):
        short = [t for t in tokens if len(t) <= WIDTH]
        body, start, size = _flat(short)
        key = Powers(len(body)).spans(body, start, start + size)
        self.longest = int(size.max())
        self.shift = np.uint64(64 - 20)
        self.key, self.id = np.zeros(1 << 20, np.uint64), np.full(1 << 20, -1, np.int32)
        ids, at = np.array([tokens[t] for t in short], np.int32), (key * _MIX) >> self.shift
        self.probes, todo = 0, np.arange(len(short))
        while len(todo):  # every slot takes the first of those that want it; the others go on
            free = todo[self.id[at[todo]] < 0]
            _, first = np.unique(at[free], return_index=True)
            own = free[first]
            self.key[at[own]], self.id[at[own]] = key[own], ids[own]
            todo = np.setdiff1d(todo, own)
            at[todo] = (at[todo] + np.uint64(1)) & np.uint64((1 << 20) - 1)
            self.probes += 1

    def find(self, key: np.ndarray) -> np.ndarray:
        """The ids of hashed strings, -1 for what isn't a token."""
        at = (key * _MIX) >> self.shift
        found = np.where(self.key[at] == key, self.id[at], -1)
        for _ in range(1, self.probes):
            at = (at + np.uint64(1)) & np.uint64((1 << 20) - 1)
            found = np.where((found < 0) & (self.key[at] == key), self.id[at], found)
        return found


def _flat(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(x) for x in strings], np.int64)
    return np.frombuffer(b"".join(strings), np.uint8), np.cumsum(size) - size, size


class Powers:
    """Hashes of substrings: sums of (byte + 1) * base ** place, freed of the place by division."""

    def __init__(self, n: int):
        with np.errstate(over="ignore"):
            step = np.full(n + 1, _BASE, np.uint64)
            back = np.full(n + 1, pow(_BASE, -1, 1 << 64), np.uint64)
            step[0] = back[0] = 1
            self.power, self.back = np.multiply.accumulate(step), np.multiply.accumulate(back)

    def sums(self, body: np.ndarray) -> np.ndarray:
        out = np.zeros(len(body) + 1, np.uint64)
        np.cumsum((body.astype(np.uint64) + np.uint64(1)) * self.power[: len(body)], out=out[1:])
        return out

    def spans(self, body: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        sums = self.sums(body)
        return (sums[end] - sums[start]) * self.back[start]


def _byte_alphabet() -> dict[str, int]:
    """The character by which byte-level vocabularies write each byte: itself if it is
    printable, else the next unused one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """The tokenizer of a .json file of the tokenizers library."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        alphabet = _byte_alphabet()
        self.special = {t["content"]: t["id"] for t in said["added_tokens"]}
        vocab = said["model"]["vocab"]
        self.ranks = {bytes(map(alphabet.__getitem__, t)): i for t, i in vocab.items() if t not in self.special}
        self.longest = max(map(len, self.ranks))
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        import public_tokenizers

        pre = said.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        if not plain or said.get("normalizer") or said["model"].get("type") != "BPE":
            raise ValueError(f"{path}: not a byte-level BPE with the standard pattern")
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.pieces = _latin_pieces()
        self.split_special = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")

    # ids

    def ids(self, text: str) -> bytes:
        """The library's ids of the text as little-endian unsigned 32-bit numbers."""
        if _LATIN.search(text) or self.split_special.search(text):
            found = self.library.encode(text, add_special_tokens=False).ids
        else:
            found = self.fast.encode_ordinary(text)
        return np.array(found, "<u4").tobytes()

    # prefix counts; their tables are made when first asked for, as ids need none

    @cached_property
    def hashed(self) -> Ranks:
        return Ranks(self.ranks)

    @cached_property
    def _pair_key(self) -> np.ndarray:
        return np.full(1 << SLOTS, -1, np.int64)

    @cached_property
    def _pair_fits(self) -> np.ndarray:
        return np.zeros(1 << SLOTS, bool)

    def compatible(self, u: int, t: int) -> bool:
        """Whether token t may follow token u inside a piece: both together encode to u, t."""
        joined = self.bytes_of[u] + self.bytes_of[t]
        return joined not in self.ranks and self.fast._encode_single_piece(joined) == [u, t]

    def _fit(self, u: np.ndarray, t: np.ndarray) -> np.ndarray:
        """compatible for pairs; a slot keeps the last pair that was asked for there."""
        key = u.astype(np.int64) << 32 | t
        slot = (key.view(np.uint64) * _MIX >> np.uint64(64 - SLOTS)).astype(np.int64)
        fits = self._pair_fits[slot]
        new = np.flatnonzero(self._pair_key[slot] != key)
        if len(new):
            keys, back = np.unique(key[new], return_inverse=True)
            own = np.fromiter((self.compatible(k >> 32, k & 0xFFFFFFFF) for k in keys.tolist()), bool, len(keys))
            fits[new] = own[back]
            self._pair_key[slot[new]], self._pair_fits[slot[new]] = key[new], fits[new]
        return fits

    def prefix_table(self, pieces: list[bytes]) -> np.ndarray:
        """Token counts of all prefixes of pre-tokens of at most WIDTH bytes, longest first: a row each, from the empty prefix on.

        The last token of a prefix's encoding is the one token that ends there and is
        compatible with the last token of what stands before it; so the counts follow
        from left to right, without encoding any prefix.
        """
        body, start, size = _flat(pieces)
        powers = Powers(len(body))
        sums, back = powers.sums(body), powers.back
        last, count = (np.zeros((len(pieces), int(size[0]) + 1), np.int32) for _ in range(2))
        for i in range(1, int(size[0]) + 1):
            open_ = np.arange(int(np.searchsorted(-size, -i, "right")))
            for width in range(1, min(i, self.hashed.longest) + 1):
                at = start[open_] + (i - width)
                t = self.hashed.find((sums[at + width] - sums[at]) * back[at])
                ok = t >= 0
                if width < i:
                    own = np.flatnonzero(ok)
                    ok[own] = self._fit(last[open_[own], i - width], t[own])
                done = open_[ok]
                last[done, i], count[done, i] = t[ok], count[done, i - width] + 1
                open_ = open_[~ok]
                if not len(open_):
                    break
            for k in open_.tolist():  # its last token is longer than the table's
                count[k, i], last[k, i] = self._ends(pieces[k][:i])
        return count

    def _ends(self, piece: bytes) -> tuple[int, int]:
        found = self.fast._encode_single_piece(piece)
        return len(found), found[-1]

    def prefix_tokens(self, piece: bytes) -> list[int]:
        """Token counts of all prefixes of one pre-token of any length, from the empty one on."""
        n = len(piece)
        last, count = [-1] * (n + 1), [0] * (n + 1)
        rank, longest = self.ranks.get, self.longest
        for i in range(1, n + 1):
            for j in range(i - longest if i > longest else 0, i):
                t = rank(piece[j:i])
                if t is not None and (not j or self._fits(last[j], t)):
                    last[i], count[i] = t, count[j] + 1
                    break
        return count

    @lru_cache(maxsize=100_000)  # noqa: B019 - one tokenizer a worker lives as long as it
    def _fits(self, u: int, t: int) -> bool:
        return self.compatible(u, t)

    def _piece_counts(self, piece: str) -> list[int]:
        """Token counts of the prefixes of one or more characters of a pre-token."""
        raw = piece.encode()
        counts = self.prefix_tokens(raw)
        if len(raw) == len(piece):
            found = counts[1:]
        else:
            found = [counts[i] for i in range(1, len(raw) + 1) if i == len(raw) or raw[i] & 0xC0 != 0x80]
        if len(piece) == 3 and piece[0] == "'" and piece[1].isalpha():
            found[1] = 2  # the prefix 'l of 'll is two pre-tokens
        return found

    def _piece_deltas(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each of the pieces with the differences of its prefixes' counts."""
        plain = []
        for piece in pieces:
            raw = piece.encode()
            if len(raw) > WIDTH or piece in _CONTRACTED:
                yield piece, _differences(self._piece_counts(piece))
            else:
                plain.append((len(raw), raw, piece))
        plain.sort(key=lambda x: -x[0])
        for lo in range(0, len(plain), ROWS):
            own = plain[lo : lo + ROWS]
            count = self.prefix_table([raw for _, raw, _ in own])
            body, start, size = _flat([raw for _, raw, _ in own])
            row = np.repeat(np.arange(len(own)), size)
            byte = np.arange(len(body)) - start[row] + 1
            ends = np.append((body[1:] & 0xC0) != 0x80, True)  # the last bytes of characters
            at = count[row, byte][ends]
            row = row[ends]
            before = np.concatenate(([0], at[:-1]))
            before[np.append(True, row[1:] != row[:-1])] = 0
            found = (at - before).astype("<i2").tobytes()
            to = 2 * np.cumsum(np.bincount(row, minlength=len(own)))
            for (_, _, piece), i, j in zip(own, [0, *to.tolist()], to.tolist(), strict=False):
                yield piece, found[i:j]

    def counts(self, text: str) -> list[int]:
        """Token counts of the prefixes of 1, 2, ... characters of a text without special tokens."""
        out: list[int] = []
        total = 0  # tokens of the pre-tokens so far
        blank, under = -1, 0  # where the run of white space that we are in began, and the tokens before it
        for _, (start, end) in self.library.pre_tokenizer.pre_tokenize_str(text):
            piece = text[start:end]
            own = self._piece_counts(piece)
            out += [total + x for x in own]
            if blank >= 0 and piece[0].isspace():
                # a prefix that ends inside a run of white space has the run as one pre-token
                width = len(piece) - len(piece.lstrip())
                run = self._piece_counts(text[blank : start + width])
                out[start : start + width] = [under + x for x in run[-width:]]
            if not piece.isspace():
                blank = -1
            elif blank < 0:
                blank, under = start, total
            total += own[-1]
        return out

    def _special_deltas(self, text: str) -> np.ndarray:
        parts, at = [], 0
        for m in self.split_special.finditer(text):
            # up to its last character a special string is ordinary text
            head = np.diff(self.counts(text[at : m.end() - 1]), prepend=0)
            plain = (self.counts(text[at : m.start()]) or [0])[-1]
            parts += [head, [plain + 1 - head.sum()]]
            at = m.end()
        parts.append(np.diff(self.counts(text[at:]), prepend=0))
        return np.concatenate(parts).astype("<i2")

    def deltas(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Of each text the differences of its prefixes' token counts, by character; they add up to its tokens."""
        at = size = 0
        for k, text in enumerate(texts):
            size += len(text)
            if size >= PART or k + 1 == len(texts):
                yield from self._part_deltas(texts[at : k + 1])
                at, size = k + 1, 0

    def _part_deltas(self, texts: list[str]) -> Iterator[np.ndarray]:
        special = [self.split_special.search(t) is not None for t in texts]
        chunks: dict[str, bytes | None] = {}
        for text, own in zip(texts, special, strict=True):
            if not own:
                chunks.update(dict.fromkeys(_CHUNK.findall(text)))
        plain, split = [], self.pieces.findall
        for chunk in chunks:
            if _LATIN.search(chunk) or _RUN.match(chunk):
                chunks[chunk] = _differences(self.counts(chunk))
            else:
                plain.append((chunk, split(chunk)))
        pieces = dict(self._piece_deltas(list({p for _, found in plain for p in found})))
        for chunk, found in plain:
            chunks[chunk] = b"".join([pieces[p] for p in found])
        for text, own in zip(texts, special, strict=True):
            if own:
                yield self._special_deltas(text)
            else:
                yield np.frombuffer(b"".join(map(chunks.__getitem__, _CHUNK.findall(text))), "<i2")


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """One tokenizer a worker process."""
    return Bpe(path)
