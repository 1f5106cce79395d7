"""Configuration: validated dataclasses, JSON files, differences, a change log, reload on change. Driver-side only."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path
from typing import Any

from tessella.errors import ConfigError


def _check(ok: bool, why: str) -> None:
    if not ok:
        raise ConfigError(why)


@dataclass(frozen=True)
class Storage:
    mode: str = "container"
    auto_convert_threshold: int = 10 << 20
    block_size: int = 4096
    inline_threshold: int = 512
    dedup: bool = False

    def __post_init__(self) -> None:
        _check(self.mode in ("container", "directory", "hybrid"), f"storage mode {self.mode}")
        _check(self.block_size > 0 and self.block_size & (self.block_size - 1) == 0, "the block size is a power of two")
        _check(0 <= self.inline_threshold <= self.block_size, "the inline threshold lies within a block")
        _check(self.auto_convert_threshold > 0, "the conversion threshold is positive")


@dataclass(frozen=True)
class Index:
    mode: str = "async"
    shards: int = 16
    batch_size: int = 1000
    interval_ms: int = 1000

    def __post_init__(self) -> None:
        _check(self.mode in ("sync", "async", "realtime", "batch"), f"index mode {self.mode}")
        _check(self.shards > 0 and self.batch_size > 0 and self.interval_ms > 0, "index figures are positive")


@dataclass(frozen=True)
class Query:
    cache_size: int = 1000
    cache_ttl_s: int = 3600
    limit: int = 10
    threshold: float = 0.1

    def __post_init__(self) -> None:
        _check(self.cache_size >= 0 and self.cache_ttl_s >= 0 and self.limit > 0, "query figures are positive")
        _check(0 <= self.threshold <= 1, "the threshold lies between 0 and 1")


@dataclass(frozen=True)
class Logging:
    level: str = "info"

    def __post_init__(self) -> None:
        _check(self.level in ("debug", "info", "warn", "error"), f"log level {self.level}")


@dataclass(frozen=True)
class Config:
    storage: Storage = field(default_factory=Storage)
    index: Index = field(default_factory=Index)
    query: Query = field(default_factory=Query)
    logging: Logging = field(default_factory=Logging)

    @classmethod
    def from_dict(cls, data: dict[str, dict[str, Any]]) -> Config:
        kinds = {f.name: f.default_factory for f in fields(cls)}
        _check(set(data) <= set(kinds), f"unknown sections {set(data) - set(kinds)}")
        try:
            return cls(**{name: kinds[name](**section) for name, section in data.items()})
        except TypeError as e:
            raise ConfigError(str(e)) from None

    @classmethod
    def load(cls, path: str) -> Config:
        try:
            return cls.from_dict(json.loads(Path(path).read_text()))
        except (OSError, ValueError) as e:
            raise ConfigError(str(e)) from None

    def save(self, path: str) -> None:
        """Written beside and renamed, so a reader never sees half a file."""
        part = f"{path}.part"
        Path(part).write_text(json.dumps(asdict(self), indent=2))
        os.replace(part, path)

    def diff(self, other: Config) -> dict[str, tuple[Any, Any]]:
        a, b = ({f"{s}.{k}": v for s, section in asdict(c).items() for k, v in section.items()} for c in (self, other))
        return {k: (a[k], b[k]) for k in sorted(a) if a[k] != b[k]}


class Manager:
    """The current configuration, its listeners by section, and a log of changes that is rotated by size."""

    def __init__(self, path: str | None = None, log: str | None = None, log_bytes: int = 1 << 20, keep: int = 5) -> None:
        self.current = Config.load(path) if path and Path(path).exists() else Config()
        self.path, self.log, self.log_bytes, self.keep = path, log, log_bytes, keep
        self._listeners: list[tuple[str, Callable[[Config, Config], None]]] = []
        self._seen = self._stamp()

    def _stamp(self) -> int | None:
        return Path(self.path).stat().st_mtime_ns if self.path and Path(self.path).exists() else None

    def listen(self, call: Callable[[Config, Config], None], section: str = "") -> None:
        self._listeners.append((section, call))

    def apply(self, new: Config) -> dict[str, tuple[Any, Any]]:
        old, self.current = self.current, new
        changed = old.diff(new)
        if changed:
            self._write(changed)
            for section, call in self._listeners:
                if not section or any(k.startswith(f"{section}.") for k in changed):
                    call(old, new)
        return changed

    def poll(self) -> bool:
        """Reloads the file if it has changed since; several changes between polls are one."""
        stamp = self._stamp()
        if stamp is None or stamp == self._seen:
            return False
        self._seen = stamp
        self.apply(Config.load(self.path))
        return True

    def _write(self, changed: dict[str, tuple[Any, Any]]) -> None:
        if not self.log:
            return
        path = Path(self.log)
        if path.exists() and path.stat().st_size >= self.log_bytes:
            for k in range(self.keep - 1, 0, -1):
                if Path(f"{path}.{k}").exists():
                    os.replace(f"{path}.{k}", f"{path}.{k + 1}")
            os.replace(path, f"{path}.1")
        with path.open("a") as f:
            f.write(json.dumps({"at": time.time(), "changes": changed}) + "\n")
