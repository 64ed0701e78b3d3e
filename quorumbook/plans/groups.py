"""Neighbouring keys as one group, so that what is done per key and batch is done per group."""

from __future__ import annotations


def require_power_of_two(size: int) -> None:
    if size < 1 or size & (size - 1):
        raise ValueError(f"{size} is not a power of two")


def first_of_group(column: str, size: int) -> str:
    """SQL for the group of ``size`` consecutive numbers (a power of two) that a number is in, named by the lowest."""
    return f"{column} & {-size}L as {column}"
