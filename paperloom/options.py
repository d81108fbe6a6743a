"""Options of an optimisation run, and presets."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    lossy: bool = False
    quality: float = 0.85
    max_dpi: int | None = None
    unembed: bool = True
    subset: bool = False
    keep_conformance_metadata: bool = False
    check_each_pass: bool = False


#: Fixed values.
PRESETS = {
    "lossless": Options(),
    "web": Options(lossy=True, quality=0.75, max_dpi=150),
    "print": Options(lossy=True, quality=0.92, max_dpi=300),
    "supercompress": Options(lossy=True, quality=0.50, max_dpi=72),
}
