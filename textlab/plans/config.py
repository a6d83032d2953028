"""Corpus settings; operators take them as arguments and hold none of their own."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class CleaningRules:
    boilerplate: tuple[str, ...] = ()
    substrings: tuple[str, ...] = ("Copyright", "©")
    page_number: str = r"^[-–—\s]*[0-9]+[-–—\s]*$"
    decorative: str = r"^[-=_*~·•.\s]+$"
    symbols_only: str = r"^[^\p{L}\p{N}_\s]+$"
    reference_markers: tuple[str, ...] = ()
    end_mark: str = ""
    reference_kind: str = "statement"


@dataclass(frozen=True)
class ChunkSpec:
    separator: str = r"\n\s*\n+"
    terminators: str = ".!?。！？"
    cap: int = 500
    merge_below: int = 150
    tail_below: int = 100
    heading_most: int = 100
    joint: str = "\n\n"
    end_mark: str = ""


@dataclass(frozen=True)
class TokenSpec:
    pattern: str = r"\p{L}+"
    stopwords: frozenset[str] = frozenset()
    preserved: frozenset[str] = frozenset()
    one_letter: bool = False


@dataclass(frozen=True)
class TfidfSpec:
    min_df: int = 2
    max_df: float = 0.85
    top: int = 30
    #: Terms up to which the vocabulary is broadcast; a larger one is joined by a shuffle, where AQE splits frequent terms.
    broadcast_terms: int = 500_000
    #: Terms up to which the vocabulary goes to the tasks as 12 bytes for each, so that counts stay where they are; beyond, broadcast_terms decides.
    hashed_terms: int = 16_000_000


@dataclass(frozen=True)
class Taxonomy:
    """Label fields in order, each with all its labels in order."""

    fields: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def pairs(self) -> list[tuple[str, str]]:
        return [(f, x) for f, labels in self.fields.items() for x in labels]


@dataclass(frozen=True)
class Indicator:
    """Share of rows with condition among those with subset; both are SQL conditions."""

    narrative: str
    name: str
    group: str
    subset: str
    condition: str
    note: str = ""
