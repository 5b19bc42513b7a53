"""Settings of a run and their checks; the command line mirrors them."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, fields

COVERAGE_MODES, BRIDGE_MODES, PAGE_SIZES = ("all", "major", "none"), ("none", "minimal", "full"), ("small-tablet", "a5", "large-tablet")


@dataclass(frozen=True)
class Config:
    input: str
    output: str = "condensed"
    title: str | None = None
    chapter_map: str | None = None
    target_ratio: float = 0.25
    candidate_ratio: float = 0.42
    coverage: str = "all"
    emphasis: str = "the book's own argument"
    chunk_words: int = 18_000
    overview_words: int = 24_000
    score_batch: int = 20
    retries: int = 3
    bridges: str = "minimal"
    bridge_words: int = 45
    bridge_batch: int = 12
    bridge_share: float = 0.02
    apply_qc: bool = False
    parse_only: bool = False
    reuse_output: bool = False
    reset_output: bool = False
    page_size: str = "small-tablet"
    font_size: int = 14
    model: str = "offline"
    endpoint: str = ""
    verbose: bool = False


def problems(c: Config) -> list[str]:
    """What is wrong with the settings; empty if nothing is."""
    checks = {
        "target_ratio must be between 0 and 1": 0 < c.target_ratio < 1,
        "candidate_ratio must be between target_ratio and 1": c.target_ratio <= c.candidate_ratio <= 1,
        "chunk_words must be at least 1000": c.chunk_words >= 1000,
        "overview_words must be at least 1000": c.overview_words >= 1000,
        "score_batch must be at least 1": c.score_batch >= 1,
        "retries must be at least 1": c.retries >= 1,
        "bridge_words must be at least 1": c.bridge_words >= 1,
        "bridge_batch must be at least 1": c.bridge_batch >= 1,
        "bridge_share must be between 0 and 1": 0 <= c.bridge_share <= 1,
        "font_size must be between 6 and 40": 6 <= c.font_size <= 40,
        "a model other than offline needs an endpoint": c.model == "offline" or bool(c.endpoint),
        f"coverage must be one of {', '.join(COVERAGE_MODES)}": c.coverage in COVERAGE_MODES,
        f"bridges must be one of {', '.join(BRIDGE_MODES)}": c.bridges in BRIDGE_MODES,
        f"page_size must be one of {', '.join(PAGE_SIZES)}": c.page_size in PAGE_SIZES,
    }
    return [message for message, ok in checks.items() if not ok]


def parse(argv: list[str]) -> Config:
    """Settings from a command line; exits with the problems if there are any."""
    p = argparse.ArgumentParser(prog="lapidary", description="Condense books into verbatim editions under a word budget.")
    p.add_argument("input", help="a file, folder or glob of EPUB, PDF, DOCX, TXT or MD books")
    for f in fields(Config)[1:]:
        flag = "--" + f.name.replace("_", "-")
        if f.default is False:
            p.add_argument(flag, action="store_true")
        else:
            p.add_argument(flag, default=f.default, type=type(f.default) if f.default is not None else str)
    c = Config(**vars(p.parse_args(argv)))
    if found := problems(c):
        p.error("; ".join(found))
    return c
