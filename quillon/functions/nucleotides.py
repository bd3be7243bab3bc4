"""Expressions on sequences and k-mers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The IUPAC codes and the bases that each stands for, and complements.
AMBIGUOUS = {
    "r": "ag", "y": "ct", "s": "cg", "w": "at", "k": "gt", "m": "ac",
    "b": "cgt", "d": "agt", "h": "act", "v": "acg", "n": "acgt",
}
LETTERS, COMPLEMENTS = "acgtrymkswbdhvn", "tgcayrkmswvhdbn"
#: The order of letters in dictionaries: bases, then ambiguous letters.
RANKED = "acgtrymkswbdhvn"


def wider_letters() -> dict[str, list[str]]:
    """For each letter those, itself included, that stand for all of its bases."""
    bases = {c: set(AMBIGUOUS.get(c, c)) for c in LETTERS}
    return {c: [x for x in LETTERS if own <= bases[x]] for c, own in bases.items()}


def from_text(text: Column) -> Column:
    """A sequence over acgt out of any text: letters a-z in turn become a, c, g, t; the rest goes."""
    az = "abcdefghijklmnopqrstuvwxyz"
    bases = "".join("acgt"[i % 4] for i in range(26))
    return F.translate(F.lower(F.regexp_replace(text, "[^A-Za-z]", "")), az, bases)


def complement(word: Column) -> Column:
    return F.translate(word, LETTERS, COMPLEMENTS)


def revcomp(word: Column) -> Column:
    return F.reverse(complement(word))


def order_key(word: Column) -> Column:
    """Sorts words in the alphabet's order, where n comes after t."""
    return F.translate(word, RANKED, "abcdefghijklmno")


def images(word: Column, spec) -> list[Column]:
    """The word and what the spec's maps lead to."""
    rc = spec.revcomp or (spec.reverse and spec.complement)
    rev = spec.reverse or (spec.revcomp and spec.complement)
    comp = spec.complement or (spec.revcomp and spec.reverse)
    return [word, *([complement(word)] if comp else []), *([F.reverse(word)] if rev else []), *([revcomp(word)] if rc else [])]


def merges(spec) -> bool:
    """Whether a class has several words."""
    return spec.reverse or spec.complement or spec.revcomp


def representative(word: Column, spec) -> Column:
    """The class's least word in the alphabet's order."""
    all_ = images(word, spec)
    if len(all_) == 1:
        return word
    if spec.alphabet == "nucleotide":
        return F.least(*all_)
    return F.least(*(F.struct(order_key(x).alias("o"), x.alias("w")) for x in all_))["w"]


def class_name(rep: Column, spec) -> Column:
    """All images joined by |, as in gatc|gatc."""
    return F.concat_ws("|", *images(rep, spec))


def chunks(sequence: Column, k: int, size: int) -> Column:
    """The sequence in parts of `size` letters and the k - 1 that follow: together they have each word of length k once."""
    last = F.greatest(F.length(sequence) - k, F.lit(0))
    cut = F.transform(F.sequence(F.lit(0), F.floor(last / size).cast("int")), lambda i: F.substring(sequence, i * size + 1, F.lit(size + k - 1)))
    return F.when(F.length(sequence) > size, cut).otherwise(F.array(sequence))


def _widen(base: Column, more: Column, most: int):
    def each(x: Column) -> Column:
        plain = F.struct(F.concat(x["p"], base).alias("p"), x["n"].alias("n"))
        wide = F.transform(more, lambda c: F.struct(F.concat(x["p"], c).alias("p"), (x["n"] + 1).alias("n")))
        return F.when(x["n"] < most, F.concat(F.array(plain), wide)).otherwise(F.array(plain))

    return each


def patterns(word: Column, k: int, alphabet: str, most: int) -> Column:
    """The words over the wider alphabet that match `word`, with `most` ambiguous letters at most.

    Built position by position from the first, so that the bound cuts early.
    """
    codes = {"n": "acgt"} if alphabet == "gapped-nucleotide" else AMBIGUOUS
    start = F.array(F.struct(F.substring(word, 1, 1).alias("p"), F.lit(0).alias("n")))
    for i in range(2, k):
        base = F.substring(word, i, 1)
        extra = F.array(*(F.when(base.isin(*bases), F.lit(c)) for c, bases in codes.items()))
        more = F.filter(extra, lambda c: c.isNotNull())

        start = F.flatten(F.transform(start, _widen(base, more, most)))
    last = F.substring(word, k, 1) if k > 1 else F.lit("")
    return F.transform(start, lambda x: F.concat(x["p"], last))
