"""Keyed hashing: every random choice is a function of its keys, never of a partition.

``xxhash64`` is the fast default. ``md5`` gives the same kind of choice in a form that
other SQL engines can replay. All functions return SQL text.
"""

from __future__ import annotations

RNGS = ("xxhash64", "md5")
SLICE_BITS = 32  # of the key space, so that slices are equal for any count of partitions


def _check(rng: str) -> None:
    if rng not in RNGS:
        raise ValueError(f"rng must be one of {RNGS}, got {rng!r}")


def _joined(seed: int, keys: tuple[str, ...]) -> str:
    return f"concat_ws('|', '{seed}', {', '.join(f'cast({k} AS STRING)' for k in keys)})"


def order_key(rng: str, seed: int, *keys: str) -> str:
    """A key whose sort order is a random permutation."""
    _check(rng)
    return f"xxhash64({seed}, {', '.join(keys)})" if rng == "xxhash64" else f"md5({_joined(seed, keys)})"


def slice_of(rng: str, key: str, slices: int) -> str:
    """Which of ``slices`` equal ranges of the key space an order key falls in."""
    if rng == "xxhash64":
        top = f"shiftright({key}, {64 - SLICE_BITS}) + {1 << (SLICE_BITS - 1)}"
    else:
        top = f"cast(conv(substring({key}, 1, {SLICE_BITS // 4}), 16, 10) AS BIGINT)"
    return f"cast(shiftright(({top}) * {slices}L, {SLICE_BITS}) AS INT)"


def draw_prefix(rng: str, seed: int, *keys: str) -> str:
    """What the draws of one resample have in common; computed once per resample."""
    _check(rng)
    return f"xxhash64({seed}, {', '.join(keys)})" if rng == "xxhash64" else _joined(seed, keys)


def draw_index(rng: str, prefix: str, draw: str, size: str) -> str:
    """A uniform index in ``0 .. size-1`` for one draw of a resample."""
    if rng == "xxhash64":
        bits = f"xxhash64({prefix}, {draw})"
    else:
        text = f"concat_ws('|', {prefix}, cast({draw} AS STRING))"
        bits = f"cast(conv(substring(md5({text}), 1, 15), 16, 10) AS BIGINT)"
    return f"pmod({bits}, {size})"
