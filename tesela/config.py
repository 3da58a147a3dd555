"""Settings of the analyzer and of ranking."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum


@dataclass(frozen=True)
class AnalyzerConfig:
    """stopwords: words that are normalised like text and removed before stemming. stem: a language ("spanish") or None.
    regex: extract abbreviations, entities, numbers, URLs, e-mails and names line by line before tokens are split. min_size and
    max_size: of a term, both included, after stemming. exact_accents: also resolve, in a vectorised UDF, characters that decompose
    to several."""

    stopwords: tuple[str, ...] = ()
    stem: str | None = None
    regex: bool = False
    min_size: int | None = None
    max_size: int | None = None
    exact_accents: bool = False


class Similarity(Enum):
    SCALAR = "scalar"
    COSINE = "cosine"
    JACCARD = "jaccard"
    DICE = "dice"

    @classmethod
    def from_menu(cls, choice: int) -> Similarity:
        """1 cosine, 2 scalar product, 3 Dice, 4 Jaccard; anything else is cosine."""
        return {2: cls.SCALAR, 3: cls.DICE, 4: cls.JACCARD}.get(choice, cls.COSINE)
