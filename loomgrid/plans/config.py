"""Layered configuration: deep merges, seeds and defaults. Runs on the driver."""

from __future__ import annotations

import json
import secrets
from functools import reduce
from pathlib import Path

#: Defaults of a generation context.
DEFAULTS = {"steps": 30, "cfg": 6.0, "strength": 0.7, "width": 1024, "height": 1024, "seed": "random"}


def deep_merge(base: dict, other: dict) -> dict:
    """``other`` over ``base``: dicts are merged, everything else is replaced. Neither is changed."""
    both = {k: deep_merge(base[k], other[k]) for k in base.keys() & other.keys() if isinstance(base[k], dict) and isinstance(other[k], dict)}
    return {**base, **other, **both}


def resolve_spec(spec: dict | str | Path | list | tuple) -> dict:
    """One dict from a dict, a JSON file, or layers of these from left to right."""
    if isinstance(spec, dict):
        return deep_merge({}, spec)
    if isinstance(spec, (list, tuple)):
        return reduce(deep_merge, map(resolve_spec, spec), {})
    made = json.loads(Path(spec).read_text())
    if not isinstance(made, dict):
        raise TypeError(f"{spec} does not hold an object")
    return made


def resolve_seeds(seed: int | str | list[int] | None, batch: int | None = None) -> list[int]:
    """One seed per item: a list sets the batch or must have its length; one number is for a batch of one.

    ``None``, ``"rand"`` and ``"random"`` draw the seeds; keep what comes out with the results.
    """
    if batch is not None and int(batch) <= 0:
        raise ValueError(f"a batch of {batch}")
    if seed is None or seed in ("rand", "random"):
        return [secrets.randbelow(1 << 31) for _ in range(1 if batch is None else int(batch))]
    seeds = [int(s) for s in (seed if isinstance(seed, (list, tuple)) else [seed])]
    if not seeds or batch is not None and len(seeds) != int(batch):
        raise ValueError(f"{len(seeds)} seeds for a batch of {batch}")
    return seeds


def resolve_context(spec: dict) -> dict:
    """Defaults under the given values; ``guidance_scale`` stands in for ``cfg``."""
    given = {k: v for k, v in spec.items() if v is not None}
    if "cfg" not in given and "guidance_scale" in given:
        given["cfg"] = given["guidance_scale"]
    return DEFAULTS | given
