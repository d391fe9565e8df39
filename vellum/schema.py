"""Options with the engine's defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SearchOptions:
    """k hits of a query; pool per leg; similarity floor; band under the best similarity."""

    k: int = 10
    min_sim: float = 0.20
    top_ratio: float = 0.75
    band_floor: int = 3
    rrf: int = 60
    weights: tuple[float, float, float] = (2.0, 1.5, 1.0)
    vector_weight: float = 1.0
    keyword_weight: float = 1.0

    @property
    def depth(self) -> int:
        return self.k if self.k > 0 else 10

    @property
    def pool(self) -> int:
        return max(4 * self.depth, 40)


@dataclass(frozen=True)
class ChunkOptions:
    """Bytes of a chunk, and of the overlap between chunks of one section."""

    size: int = 2048
    overlap: int = 256

    def settled(self) -> ChunkOptions:
        if self.size <= 0:
            return ChunkOptions()
        return self if 0 <= self.overlap < self.size else ChunkOptions(self.size, self.size // 8)


@dataclass(frozen=True)
class GraphOptions:
    """Neighbours of a note, least similarity of an edge."""

    k: int = 6
    min_sim: float = 0.5
