"""Thresholds and weights; each class checks itself when made."""

from __future__ import annotations

from dataclasses import dataclass


def _sums_to_one(**weights: float) -> None:
    if not 0.99 <= sum(weights.values()) <= 1.01:
        raise ValueError(f"weights must sum to 1: {weights}")


def _unit(**values: float) -> None:
    for name, x in values.items():
        if not 0 <= x <= 1:
            raise ValueError(f"{name} must lie between 0 and 1: {x}")


@dataclass(frozen=True)
class Segmentation:
    gap: float = 0.35
    speaker: float = 0.25
    transition: float = 0.30
    semantic: float = 0.10
    long_pause: float = 90.0
    threshold: float = 0.40
    transition_threshold: float = 0.30
    min_sentences: int = 2
    min_segments: int = 3
    use_semantic: bool = False

    def __post_init__(self) -> None:
        _sums_to_one(gap=self.gap, speaker=self.speaker, transition=self.transition, semantic=self.semantic)
        _unit(threshold=self.threshold, transition_threshold=self.transition_threshold)


@dataclass(frozen=True)
class QaFilter:
    min_density: float = 0.30
    min_questions: int = 2
    max_instructor_questions: float = 0.2
    enabled: bool = True
    keep_instructor_only: bool = False

    def __post_init__(self) -> None:
        _unit(min_density=self.min_density, max_instructor_questions=self.max_instructor_questions)


@dataclass(frozen=True)
class Ranking:
    procedural: float = 0.4
    action_density: float = 0.3
    coherence: float = 0.3
    min_importance: float = 0.3
    high: float = 0.7
    keep_top_n: int | None = None

    def __post_init__(self) -> None:
        _sums_to_one(procedural=self.procedural, action_density=self.action_density, coherence=self.coherence)


@dataclass(frozen=True)
class Matching:
    word: float = 0.5
    semantic: float = 0.5
    keyword: float = 0.0
    phrase: float = 0.0
    char: float = 0.0
    min_words: int = 3
    min_score: float = 0.15
    top: int = 5

    def normalised(self) -> Matching:
        total = self.word + self.semantic + self.keyword + self.phrase + self.char
        if abs(total - 1) <= 0.01:
            return self
        return Matching(self.word / total, self.semantic / total, self.keyword / total, self.phrase / total, self.char / total, self.min_words, self.min_score, self.top)


@dataclass(frozen=True)
class Validation:
    min_actions: int = 3
    max_actions: int = 15
    min_title: int = 10
    max_title: int = 100
    min_details: int = 20
    min_confidence: float = 0.2
    low_confidence: float = 0.4
    weight_actions: float = 0.4
    weight_title: float = 0.2
    weight_details: float = 0.2
    weight_confidence: float = 0.2
    require_details: bool = True
    require_descriptive_title: bool = True
    warn_duplicates: bool = True

    def __post_init__(self) -> None:
        _sums_to_one(actions=self.weight_actions, title=self.weight_title, details=self.weight_details, confidence=self.weight_confidence)


@dataclass(frozen=True)
class Run:
    """Which stages of a run are on, and its step counts. A gate that needs segments turns segmentation on."""

    segment: bool = True
    filter_qa: bool = True
    rank: bool = True
    assemble: bool = True
    include_statistics: bool = True
    min_steps: int = 3
    target_steps: int = 8
    max_steps: int = 15
    min_confidence: float = 0.25
    segmentation: Segmentation = Segmentation()
    qa: QaFilter = QaFilter()
    ranking: Ranking = Ranking()
    matching: Matching = Matching()
    validation: Validation = Validation(min_confidence=0.25)

    @property
    def segments(self) -> bool:
        return self.segment or self.filter_qa or self.rank
