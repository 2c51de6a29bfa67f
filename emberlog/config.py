"""Options of a store that bear on results; performance is left to Spark's own settings."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Mapping
from dataclasses import dataclass

TRUE, FALSE = ("1", "true", "yes", "on"), ("0", "false", "no", "off")


def as_bool(text: str) -> bool:
    word = text.strip().lower()
    if word not in TRUE + FALSE:
        raise ValueError(f"not a yes or no: {text!r}")
    return word in TRUE


@dataclass(frozen=True)
class Config:
    buckets: int = 128
    page_size: int = 65536
    #: Values above this many bytes are kept as chunks beside the log; None: an eighth of a page.
    overflow_above: int | None = None
    #: Chunks are zstd-compressed where that makes them smaller.
    zstd: bool = False
    #: A value above this many bytes, or a chain of more chunks, is an error when it is read.
    max_value_bytes: int = 1 << 30
    max_chunks: int = 1_000_000
    #: After a batch, its buckets are compacted whose records fill this many pages; None: never.
    compact_at: int | None = None

    def __post_init__(self):
        if not 4096 <= self.page_size <= 1 << 20 or self.page_size & (self.page_size - 1):
            raise ValueError(f"page size {self.page_size} is not a power of two from 4096 to 1048576")
        for name in ("buckets", "max_value_bytes", "max_chunks"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive")

    @property
    def threshold(self) -> int:
        return self.page_size // 8 if self.overflow_above is None else self.overflow_above

    @classmethod
    def of(cls, options: Mapping[str, str]) -> Config:
        """From text options, as of an environment or a command line; unknown names are an error."""
        kinds = {f.name: f.type for f in dataclasses.fields(cls)}
        found = {}
        for name, text in options.items():
            if name not in kinds:
                raise ValueError(f"no option {name}")
            found[name] = as_bool(text) if kinds[name] == "bool" else None if text == "" else int(text)
        return cls(**found)

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Config:
        return cls(**json.loads(text))
