"""What describes a feature space and a run: plain values, held by the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

ALPHABETS = ("nucleotide", "gapped-nucleotide", "iupac-nucleotide")
TRANSFORMS = ("none", "standardizer", "variance-scaler", "max-abs-scaler", "mean-scaler")
SOLVERS = ("coordinate", "proximal")
SUMMARIES = ("", "mean", "product", "min", "max")


def alphabet(name: str) -> str:
    """The alphabet's own name: case, blanks for dashes and a trailing ' alphabet' don't matter."""
    plain = name.strip().lower().replace(" ", "-").removesuffix("-alphabet").replace("ambiguous", "iupac")
    if plain not in ALPHABETS:
        raise ValueError(f"unknown alphabet: {name}")
    return plain


@dataclass(frozen=True)
class KmerSpec:
    """Which k-mers are features: lengths shortest to longest, and which of them are one.

    reverse, complement, revcomp: words that these maps (and their products) lead to
    each other count as one class. max_ambiguous: so many ambiguous letters at most, one
    number or one a length; None is no bound. Windows with other letters than acgt are
    skipped; case doesn't matter.
    """

    shortest: int
    longest: int
    revcomp: bool = False
    reverse: bool = False
    complement: bool = False
    alphabet: str = "nucleotide"
    max_ambiguous: int | tuple[int, ...] | None = None
    binarize: bool = False
    cooccurrence: bool = False

    def __post_init__(self) -> None:
        object.__setattr__(self, "alphabet", alphabet(self.alphabet))
        if not 1 <= self.shortest <= self.longest:
            raise ValueError("lengths must be 1 <= shortest <= longest")
        if isinstance(self.max_ambiguous, (list, tuple)):
            if len(self.max_ambiguous) != self.longest - self.shortest + 1:
                raise ValueError("max_ambiguous needs one number for each length")
            object.__setattr__(self, "max_ambiguous", tuple(self.max_ambiguous))

    def ambiguous_at(self, k: int) -> int:
        """Ambiguous letters that a word of length k may have; they never stand first or last."""
        if self.alphabet == "nucleotide":
            return 0
        most = self.max_ambiguous
        if isinstance(most, tuple):
            most = most[k - self.shortest]
        return k - 2 if most is None or most < 0 else min(most, k - 2)

    def same_space(self, other: KmerSpec) -> bool:
        """Whether models over both may be joined."""
        return (self.alphabet, self.binarize, self.cooccurrence) == (other.alphabet, other.binarize, other.cooccurrence)


@dataclass(frozen=True)
class Options:
    """Options of a run of learning; names and defaults follow the command line's."""

    lambda_: float | None = None
    lambda_auto: tuple[int, ...] = (0,)
    balance: bool = False
    penalty_free: bool = False
    max_features: int = 0
    max_epochs: int = 0
    max_iterations: int = 0
    max_samples: int = 0
    epsilon: float = 0.0
    epsilon_loss: float = 0.0
    epsilon_lambda: float = 0.0
    transform: str = "none"
    cooccurrence: bool = False
    co_preselection: int = 0
    ensemble_size: int = 1
    ensemble_summary: str = "mean"
    k_fold: int = 1
    validation_size: float = 0.0
    seed: int = 1
    solver: str = "coordinate"

    def __post_init__(self) -> None:
        object.__setattr__(self, "lambda_auto", tuple(sorted(self.lambda_auto)))
        if self.lambda_ is not None and any(self.lambda_auto):
            raise ValueError("lambda and lambda_auto exclude each other")
        if self.transform not in TRANSFORMS:
            raise ValueError(f"unknown transform: {self.transform}")
        if self.ensemble_summary not in SUMMARIES:
            raise ValueError(f"unknown summary: {self.ensemble_summary}")
        if self.solver not in SOLVERS:
            raise ValueError(f"unknown solver: {self.solver}")
        if not 0 <= self.validation_size <= 1:
            raise ValueError("validation_size must be between 0 and 1")


Pair = tuple[int, int]


@dataclass
class Member:
    """One fitted model: bias, and for each feature (a, b) its coefficient; a == b is a single feature."""

    bias: float
    theta: dict[Pair, float] = field(default_factory=dict)

    def nonzero(self) -> int:
        return sum(v != 0 for v in self.theta.values())


@dataclass
class Model:
    """Members over one feature space. names: each base feature's name (a k-mer class or a
    column); transform: offset and scale by feature, where one was fitted."""

    members: list[Member]
    names: dict[int, str]
    spec: KmerSpec | None = None
    transform: dict[Pair, tuple[float, float]] = field(default_factory=dict)
    summary: str = "mean"
    cooccurrence: bool = False

    def features(self) -> list[Pair]:
        """Singles first, then pairs, each in order."""
        return sorted({f for m in self.members for f in m.theta}, key=lambda f: (f[0] != f[1], f))

    def component(self, k: int) -> Model:
        return Model([self.members[k]], self.names, self.spec, self.transform, self.summary, self.cooccurrence)
