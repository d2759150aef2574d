"""What a sampled digest reads of a file."""

from __future__ import annotations

from dataclasses import dataclass

MIB = 1 << 20
ALIGN = 4096


@dataclass(frozen=True)
class HashSpec:
    """Files of `threshold` bytes and more are sampled with at most `max_probes` probes; without a threshold all are read whole."""

    threshold: int | None = 32 * MIB
    probe: int = MIB
    max_probes: int = 8

    def __str__(self) -> str:
        return "sha256/v1/full" if self.threshold is None else f"sha256/v1/th{self.threshold}-s{self.probe}-m{self.max_probes}"

    @staticmethod
    def parse(text: str) -> HashSpec:
        algorithm, version, rest = text.split("/")
        if (algorithm, version) != ("sha256", "v1"):
            raise ValueError(f"unknown digest {text}")
        if rest == "full":
            return HashSpec(None)
        th, s, m = rest.split("-")
        return HashSpec(int(th.removeprefix("th")), int(s.removeprefix("s")), int(m.removeprefix("m")))


def interior_probes(size: int, spec: HashSpec) -> int:
    """One more for each doubling of the size over the threshold."""
    doublings = (size.bit_length() - 1) - (max(spec.threshold or 1, 1).bit_length() - 1)
    return max(0, min(doublings, max(spec.max_probes - 2, 0)))


def plan_regions(size: int, spec: HashSpec) -> list[tuple[int, int]]:
    """Sorted, disjoint [start, end): the whole file, or its head, tail and evenly spread probes."""
    if spec.threshold is None or size < spec.threshold:
        return [(0, size)] if size else []
    n = interior_probes(size, spec)
    starts = [i * size // (n + 1) // ALIGN * ALIGN for i in range(1, n + 1)]
    wanted = sorted((a, min(a + spec.probe, size)) for a in [0, max(size - spec.probe, 0), *starts])
    merged: list[tuple[int, int]] = []
    for a, b in wanted:
        if a < b and merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        elif a < b:
            merged.append((a, b))
    return merged
