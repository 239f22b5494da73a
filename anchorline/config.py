"""Settings of a projection. The numbers are fixed values of the method."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    half_life: int = 10_000
    genome_basis: int = 2_728_222_451
    nearest: int = 20
    least_chain: int = 5
    distance_dc: float | None = 300
    distance_ic: float | None = 2_500
    score_dc: float = 0.98
    score_ic: float = 0.84
    distance_fc: float = 500

    def thresholds(self, genome_size: int) -> tuple[float, float]:
        """Least scores of DC and IC for a genome; a distance, unless None, overrides the score."""
        if not genome_size:
            raise ValueError("the reference species has no genome size")

        def at(distance: float | None, score: float) -> float:
            return score if distance is None else round(0.5 ** (distance * self.genome_basis / (genome_size * self.half_life)), 3)

        dc, ic = at(self.distance_dc, self.score_dc), at(self.distance_ic, self.score_ic)
        if dc < ic:
            raise ValueError(f"the DC threshold {dc} is below the IC threshold {ic}")
        return dc, ic
