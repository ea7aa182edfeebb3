"""Settings of matching and transfer."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Weights:
    methods: float = 0.45
    fine_share: float = 0.70
    coarse_share: float = 0.30
    descriptors: float = 0.10
    fields: float = 0.20
    arity: float = 0.10
    access: float = 0.05
    references: float = 0.10


@dataclass(frozen=True)
class Parity:
    """Observed behaviours that callers may want as they are, or repaired."""

    dice_mode: str = "reference"  # fine overlap counts repeats, its denominator doesn't; or "multiset"
    drop_dynamic_classes: bool = False  # classes with invokedynamic are skipped
    nested_generics: bool = False  # True: cut generics by matching brackets; False: from the first < to the last >
    unescape_names: bool = False  # readers undo the writer's escapes
    canonical_descriptors: bool = False  # class names outside the platform don't count in descriptors


@dataclass(frozen=True)
class TransferConfig:
    target: str | None = None
    mapping: str | None = None
    unmapped: str | None = None
    output: str | None = None
    threshold: float = 0.70
    num_hashes: int = 128
    num_bands: int = 32
    tool: str = "cfr"
    tool_timeout_s: int = 900
    weights: Weights = field(default_factory=Weights)
    parity: Parity = field(default_factory=Parity)

    def validate(self) -> TransferConfig:
        for name in ("target", "mapping", "unmapped", "output"):
            if not getattr(self, name):
                raise ValueError(f"{name} is required")
        for name in ("target", "unmapped"):
            if not str(getattr(self, name)).endswith(".jar"):
                raise ValueError(f"{name} must be a .jar file")
        if not 0.0 <= self.threshold <= 1.0:
            raise ValueError("threshold must be within 0 and 1")
        if self.tool_timeout_s <= 0:
            raise ValueError("tool_timeout_s must be positive")
        return self
