"""A value with a committed and an active version."""

from __future__ import annotations

from typing import Generic, TypeVar

T = TypeVar("T")
_NONE = object()


class TwoPhase(Generic[T]):
    """Values are immutable (DataFrames, arrays): versions are references."""

    def __init__(self, value=_NONE):
        self._active = self._backup = value

    @property
    def has_value(self) -> bool:
        return self._active is not _NONE

    def _get(self, value):
        if value is _NONE:
            raise ValueError("no value yet")
        return value

    @property
    def active(self) -> T:
        return self._get(self._active)

    @active.setter
    def active(self, value: T) -> None:
        if not self.has_value:
            self._backup = value
        self._active = value

    @property
    def committed(self) -> T:
        return self._get(self._backup)

    def emplace(self, value: T) -> None:
        self._active = self._backup = value

    def commit(self) -> None:
        self._backup = self._get(self._active)

    def rollback(self) -> None:
        self._active = self._get(self._backup)
