"""Lexicons and thresholds.  Every rule operator takes a profile; the Latin one fits ASCII test tables."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Scene:
    """A rule of the scene classifier; ``position`` is any, start or end."""

    name: str
    keywords: tuple[str, ...]
    negative: tuple[str, ...] = ()
    weights: tuple[tuple[str, float], ...] = ()
    min_score: float | None = None
    min_length: int = 0
    max_length: int = 1 << 30
    position: str = "any"


@dataclass(frozen=True)
class Profile:
    script: str  # a character class
    enders: str
    ad_pattern: str
    title_pattern: str
    bad_lines: tuple[str, ...]
    forbidden: tuple[str, ...]
    quotes: str
    genres: tuple[tuple[str, tuple[str, ...]], ...]
    scenes: tuple[Scene, ...]
    imagery: tuple[str, ...] = ()
    emotions: tuple[tuple[str, tuple[str, ...]], ...] = ()
    # thresholds with the same meaning in every profile
    genre_threshold: int = 3
    min_paragraph: int = 100
    max_paragraph: int = 5000
    min_script: float = 0.6
    base_score: float = 4.5
    min_quality: float = 5.0
    options: dict = field(default_factory=dict, hash=False)


LATIN = Profile(
    script=r"A-Za-zÀ-ÖØ-öø-ÿ",
    enders=".!?\"')",
    ad_pattern=r"(?i)https?://|www\.|\.com\b|click here|subscribe",
    title_pattern=r"^\s*(?:chapter|part|section)\s+[0-9ivxlc]+",
    bad_lines=("lorem ipsum", "javascript", "privacy policy", "terms of use", "cookie"),
    forbidden=("###", "$$$", "%%%", "&&&", "***", "!!"),
    quotes='"',
    genres=(("english", (" the ", " and ", " of ", " that ")), ("german", (" der ", " die ", " und ", " mit ")), ("french", (" le ", " la ", " des ", " que ")), ("spanish", (" el ", " los ", " una ", " para "))),
    scenes=(
        Scene("motion", (" to ", " from ", " with "), min_length=40),
        Scene("place", (" in ", " on ", " at "), negative=("###",), weights=((" at ", 2.0),), min_score=2.0, min_length=40),
        Scene("opening", (" a ", " the "), min_length=40, position="start"),
        Scene("closing", (" was ", " were ", " is "), min_length=20, position="end"),
    ),
    imagery=("light", "shadow", "rain", "wind", "fire"),
    emotions=(("joy", ("happy", "glad")), ("anger", ("idiot", "pathetic", "disgusting", "moron", "scum", "worthless"))),
)

#: A profile for Chinese prose: script range, sentence enders and thresholds; the word lists are the user's.
CJK = Profile(
    script="一-鿿",
    enders="。！？!?…”」』",
    ad_pattern=r"(?i)https?://|www\.|\.com\b",
    title_pattern=r"^\s*第[0-9一二三四五六七八九十百千零]+[章节回卷]",
    bad_lines=(),
    forbidden=(),
    quotes="“”",
    genres=(),
    scenes=(),
)
