"""Search and build settings, merged from several sources."""

from __future__ import annotations

import dataclasses
import json
import math
from pathlib import Path
from typing import Any


@dataclasses.dataclass(frozen=True)
class Config:
    nbits: int = 4
    nprobe: int = 16
    t_prime: int | None = None
    bound: int = 128
    k: int = 100
    kmeans_iters: int = 4
    seed: int = 123
    query_tokens: int = 32
    passage_tokens: int = 512
    name: str | None = None

    def __post_init__(self) -> None:
        if self.nbits not in (2, 4):
            raise ValueError("nbits is 2 or 4")
        if self.nprobe > self.bound:
            raise ValueError("nprobe must not exceed bound")

    @classmethod
    def merged(cls, *sources: dict[str, Any], ignore_unknown: bool = True) -> Config:
        """Later sources win; only the fields that a source assigns count."""
        known = {f.name for f in dataclasses.fields(cls)}
        out: dict[str, Any] = {}
        for s in sources:
            if not ignore_unknown and set(s) - known:
                raise KeyError(sorted(set(s) - known))
            out |= {k: v for k, v in s.items() if k in known}
        return cls(**out)

    def save(self, path: str, overwrite: bool = False) -> None:
        if Path(path).exists() and not overwrite:
            raise FileExistsError(path)
        Path(path).write_text(json.dumps(dataclasses.asdict(self), indent=1))

    @classmethod
    def load(cls, path: str) -> Config:
        return cls.merged(json.loads(Path(path).read_text()))


def number_of_cells(passages: int, mean_length: float) -> int:
    """A power of two near 16 times the root of the number of tokens."""
    return 2 ** int(math.floor(math.log2(max(1.0, 16 * math.sqrt(passages * mean_length)))))


def sample_size(passages: int) -> int:
    return min(1 + int(16 * math.sqrt(120 * passages)), passages)


def t_prime_for(tokens: int, cells: int, k: int, given: int | None = None) -> int:
    """Candidates after which a token's missing score is read; at least 1, so that a small index has one."""
    if given is not None:
        return max(1, given)
    if cells <= 2**16:
        return max(1, int(math.sqrt(8 * tokens) / 1000) * 1000)
    return 50_000 if k <= 100 else 100_000


def staged_defaults(k: int) -> dict[str, float]:
    """Cells, centroid threshold and candidates of the staged search by k; a pure function."""
    if k <= 10:
        return {"ncells": 1, "threshold": 0.5, "ndocs": 256}
    if k <= 100:
        return {"ncells": 2, "threshold": 0.45, "ndocs": 1024}
    return {"ncells": 4, "threshold": 0.4, "ndocs": max(4 * k, 4096)}
