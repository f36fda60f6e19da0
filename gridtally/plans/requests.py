"""Requests and their validation, on the driver: they are small."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Fixed by the format: what a group's name is made of, and what a chromosome's name in a chunk request, a file's name too, never holds.
GROUP_NAME = re.compile(r"[A-Za-z0-9_]+")
UNSAFE = re.compile(r"[/\\.\0 \t\n\r\"'`;|&$<>(){}*?\[\]]")


@dataclass(frozen=True)
class Region:
    chrom: str
    start: int = 0
    end: int | None = None

    def __post_init__(self):
        if not self.chrom or re.search(r"[\s/\\]", self.chrom):
            raise ValueError("a chromosome's name has no blanks or slashes")
        if self.start < 0 or (self.end is not None and (self.end < 1 or self.end <= self.start)):
            raise ValueError("a region ends behind its start")

    def within(self, most: int = 300_000_000) -> Region:
        """The region, if it isn't longer than most."""
        if self.end is not None and self.end - self.start > most:
            raise ValueError(f"the region has {self.end - self.start} positions, more than {most}")
        return self


@dataclass(frozen=True)
class GroupRequest:
    """1 to most groups of distinct, known samples; those that aren't known are dropped."""

    groups: dict[str, list[str]]
    least: int = 1
    most: int = 10
    dropped: dict[str, list[str]] = field(default_factory=dict)

    def __post_init__(self):
        if not 1 <= len(self.groups) <= self.most:
            raise ValueError(f"give 1 to {self.most} groups")
        for name, members in self.groups.items():
            if not GROUP_NAME.fullmatch(name):
                raise ValueError(f"not a group's name: {name}")
            if not members:
                raise ValueError(f"{name} is empty")
            if len(set(members)) != len(members):
                raise ValueError(f"{name} names a sample twice")

    def known(self, samples: set[str]) -> GroupRequest:
        kept = {n: [m for m in ms if m in samples] for n, ms in self.groups.items()}
        for name, members in kept.items():
            if len(members) < self.least:
                raise ValueError(f"{name} has {len(members)} known samples; {self.least} are needed")
        return GroupRequest(kept, self.least, self.most, {n: [m for m in ms if m not in samples] for n, ms in self.groups.items()})


@dataclass(frozen=True)
class ChunkRequest:
    """Sites start to end (1-based, both in), at most cap of them, as they come or, when asked, evenly."""

    chrom: str
    start: int
    end: int
    cap: int = 1000
    mode: str = "raw"

    def __post_init__(self):
        if not 1 <= len(self.chrom) <= 128 or UNSAFE.search(self.chrom):
            raise ValueError("not a chromosome's name")
        if self.start < 1 or self.end < self.start:
            raise ValueError("positions start at 1 and end at or behind the start")
        if not 1 <= self.cap <= 20_000:
            raise ValueError("cap is 1 to 20000")
        if self.mode not in ("raw", "even"):
            raise ValueError("mode is raw or even")


@dataclass(frozen=True)
class LdRequest:
    """Linkage in a range of windows (low to high, both in) of 1 to 4 groups of at least 5 samples each, and of a shelf of positions, if one is given."""

    chrom: str
    window_range: tuple[int, int]
    groups: dict[str, list[str]]
    shelf: tuple[int, int] | None = None
    snp_cap: int = 5000
    thin_to: int | None = None

    def __post_init__(self):
        if len(self.window_range) != 2 or self.window_range[0] < 0 or self.window_range[1] < self.window_range[0]:
            raise ValueError("a range of windows is a low number from 0 on and one not below it")
        if self.shelf is not None and (len(self.shelf) != 2 or self.shelf[0] >= self.shelf[1]):
            raise ValueError("a shelf ends behind its start")
        if not 1 <= len(self.groups) <= 4:
            raise ValueError("give 1 to 4 groups")
        for name, ids in self.groups.items():
            if not name.replace("_", "").isalnum():
                raise ValueError(f"not a group's name: {name}")
            if len(ids) < 5:
                raise ValueError(f"{name} has {len(ids)} samples; 5 are needed")
        if self.snp_cap < 10:
            raise ValueError("snp_cap is 10 at least")
