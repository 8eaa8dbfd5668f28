"""The field catalogue: which record fields are checked, indexed, and how.

The catalogue is a parameter of every operator. A field has a *kind*; the kind
decides when a value is valid, how it is cleaned, what its index term is and
how a query value is brought to the same form.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

KINDS = (
    "digits",  # any text whose digits number between `low` and `high`
    "digits_exact",  # only digits, length in `lengths`
    "digits_any",  # only digits
    "email",
    "words",  # two or more alphabetic words
    "date",
    "code",  # always valid, compared in upper case without blanks
    "text",  # always valid, compared as is
)
DIGIT_KINDS = ("digits", "digits_exact", "digits_any")


@dataclass(frozen=True)
class FieldSpec:
    name: str
    kind: str
    low: int = 9
    high: int = 14
    lengths: tuple[int, ...] = ()
    shard_prefix: int = 3
    shard_hash: int = 0
    indexed: bool = True
    pattern: str = ""  # optional check of typed-in query values
    max_length: int | None = None  # optional cut of typed-in query values

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown field kind {self.kind!r}")
        if self.kind == "digits_exact" and not self.lengths:
            raise ValueError(f"{self.name}: digits_exact needs lengths")


@dataclass(frozen=True)
class NameParts:
    """A field composed from parts when a record does not carry it."""

    target: str
    parts: tuple[str, ...]


@dataclass(frozen=True)
class Catalog:
    fields: tuple[FieldSpec, ...]
    names: NameParts | None = None
    _by_name: dict[str, FieldSpec] = field(init=False, repr=False, compare=False, default=None)

    def __post_init__(self) -> None:
        by_name = {spec.name: spec for spec in self.fields}
        if len(by_name) != len(self.fields):
            raise ValueError("field names must be unique")
        object.__setattr__(self, "_by_name", by_name)

    def __iter__(self) -> Iterator[FieldSpec]:
        return iter(self.fields)

    def __contains__(self, name: str) -> bool:
        return name in self._by_name

    def __getitem__(self, name: str) -> FieldSpec:
        return self._by_name[name]

    @property
    def indexed(self) -> tuple[FieldSpec, ...]:
        return tuple(spec for spec in self.fields if spec.indexed)

    def only(self, names: Iterable[str]) -> "Catalog":
        """The same catalogue cut down to some fields, for plans that need few."""
        wanted = set(names)
        return Catalog(tuple(s for s in self.fields if s.name in wanted), self.names)
