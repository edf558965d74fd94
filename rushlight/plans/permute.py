"""Keyed permutations of 0 .. n-1 that any task can evaluate at any place, without sorting or sharing them."""

from __future__ import annotations

import numpy as np

ROUNDS = 6
STRIP = 1 << 15  # places walked at once: their halves stay in a core's cache
_MASK = np.uint64(0xFFFFFFFF)
_A, _B, _C = np.uint64(2654435761), np.uint64(2246822519), np.uint64(3266489917)
_A32, _B32, _15, _13 = np.uint32(2654435761), np.uint32(2246822519), np.uint32(15), np.uint32(13)


def _scrambled(value: np.ndarray, key: np.ndarray) -> np.ndarray:
    """32 mixed bits of a number below 2^31 and a key, in plain 64-bit arithmetic so that SQL can do the same."""
    x = (value * _A + key) & _MASK
    x = ((x ^ (x >> np.uint64(15))) * _B) & _MASK
    return x ^ (x >> np.uint64(13))


def round_keys(seed: int, numbers: np.ndarray) -> np.ndarray:
    """(number, round) array of keys of the permutations with these numbers."""
    at = numbers.astype(np.uint64)[:, None] * np.uint64(8) + np.arange(ROUNDS, dtype=np.uint64)
    return _scrambled(at, (np.uint64(seed) * _C + np.uint64(1)) & _MASK)


def half_bits(n: int) -> int:
    """Bits of each half of the smallest even-sized power of two that holds ``n`` places, 256 at least: a network over
    fewer draws permutations too unevenly."""
    bits = 4
    while 4**bits < n:
        bits += 1
    return bits


def _network(left: np.ndarray, right: np.ndarray, keys: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """The halves after all rounds; ``left`` is overwritten. 32-bit arithmetic wraps as the masks of ``_scrambled`` do."""
    low = np.uint32((1 << half) - 1)
    mixed = np.empty_like(left)
    spare = np.empty_like(left)
    for r in range(ROUNDS):
        np.multiply(right, _A32, out=mixed)
        mixed += keys[..., r]
        np.right_shift(mixed, _15, out=spare)
        mixed ^= spare
        mixed *= _B32
        np.right_shift(mixed, _13, out=spare)
        mixed ^= spare
        mixed &= low
        mixed ^= left
        left, right, mixed = right, mixed, left
    return left, right


def places(n: int, keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where each permutation (row of ``keys``) sends each place of ``at``: a Feistel network over the halves of the
    place's bits, walked on from places beyond ``n`` until one inside is met, which keeps it one to one."""
    half = half_bits(n)
    if half > 31:
        raise ValueError(f"{n} places: a half of their bits does not fit 31 bits")
    keys, at, low = keys.astype(np.uint32), at.astype(np.uint64), (1 << half) - 1
    out = np.empty((len(keys), len(at)), np.int64)
    for begin in range(0, len(at), STRIP):
        part = at[begin : begin + STRIP]
        first, second = (part >> np.uint64(half)).astype(np.uint32), (part & np.uint64(low)).astype(np.uint32)
        together = max(1, STRIP // len(part))
        for one in range(0, len(keys), together):
            own = keys[one : one + together]
            left, right = _network(np.tile(first, (len(own), 1)), np.tile(second, (len(own), 1)), own[:, None], half)
            x = (left.astype(np.int64) << half) | right
            flat = x.reshape(-1)
            still = np.flatnonzero(flat >= n)
            while len(still):
                beyond = flat[still]
                key = own[still // len(part)] if len(own) > 1 else own[0]
                left, right = _network((beyond >> half).astype(np.uint32), (beyond & low).astype(np.uint32), key, half)
                moved = (left.astype(np.int64) << half) | right
                flat[still] = moved
                still = still[moved >= n]
            out[one : one + together, begin : begin + STRIP] = x
    return out
