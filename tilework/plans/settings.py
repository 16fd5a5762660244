"""The settings of a tracing: one frozen, validated set for a whole batch."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Names follow the usual command line; `auto` leaves a choice to the picture's own features.

    clean_up is a median filter; enlarge doubles the picture once or twice; page chooses a page of a
    document, and as no documents of many pages can be read, only the first is allowed. gradients have
    an effect where colours are reduced, lettering (small print in one ink, drawn from its pixels) where they are not. regularize is ours: the share, from 0 to 1, by which near-equal coordinates of neighbouring nodes
    are drawn together.
    """

    category: str = "auto"
    quality: str = "auto"
    clean_up: bool = False
    enlarge: int = 1
    sharpen: bool = False
    simplify: float | str = "auto"
    corners: bool = True
    regularize: float = 0.0
    straighten: float | str = "auto"
    primitives: bool = True
    gradients: bool = True
    lettering: bool = True
    stack: str = "stacked"
    colors: int | None = None
    background: int | None = None
    page: int = 1
    svg_decimals: int = 2
    svg_smallest: bool = False
    png_background: str = "white"
    overwrite: bool = False

    def __post_init__(self) -> None:
        choices = {
            "category": ("auto", "artwork", "pixel_art", "photo"),
            "quality": ("auto", "low", "medium", "high"),
            "stack": ("stacked", "cut_out", "grouped"),
            "png_background": ("white", "clear"),
        }
        for name, allowed in choices.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} is one of {', '.join(allowed)}")
        if self.colors is not None and not 1 <= self.colors <= 64:
            raise ValueError("colors is from 1 to 64, or None for all")
        if not 0 <= self.svg_decimals <= 3:
            raise ValueError("svg_decimals is from 0 to 3")
        if not 0 <= self.regularize <= 1:
            raise ValueError("regularize is from 0 to 1")
        for name in ("simplify", "straighten"):
            x = getattr(self, name)
            if x != "auto" and (isinstance(x, str) or x < 0):
                raise ValueError(f"{name} is auto or a distance in pixels")
        if self.background is not None and not 0 <= self.background <= 0xFFFFFF:
            raise ValueError("background is a colour from 0 to 0xFFFFFF")
        if self.page != 1:
            raise ValueError("only the first page can be read")
        if self.enlarge not in (1, 2, 4):
            raise ValueError("enlarge is 1, 2 or 4")

    def tolerance(self, kind: str, quality: str) -> float:
        """The largest distance, in pixels, that simplifying may move an outline (our values): small pictures keep more."""
        if self.simplify != "auto":
            return float(self.simplify)
        return {"pixel_art": 0.0, "artwork": 0.75, "photo": 1.25}[kind] * {"low": 0.6, "medium": 0.8, "high": 1.0}[quality]
