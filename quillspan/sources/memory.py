"""A small key-value memory and the rules text of a repository, on the driver: both are bounded."""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

MOST_KEY, MOST_VALUE, MOST_ENTRIES, MOST_RULES = 256, 65_536, 1_000, 65_536


class Memory:
    """Key-value pairs in one JSON file, written to a second file first and then put in place."""

    def __init__(self, path: str) -> None:
        self.path = Path(path)
        try:
            held = json.loads(self.path.read_text(encoding="utf-8"))
        except (OSError, ValueError):
            held = {}
        self.entries: dict[str, dict] = held if isinstance(held, dict) else {}

    def set(self, key: str, value: str) -> None:
        if not key or len(key.encode()) > MOST_KEY:
            raise ValueError(f"a key has 1 to {MOST_KEY} bytes")
        if len(value.encode()) > MOST_VALUE:
            raise ValueError(f"a value has at most {MOST_VALUE} bytes")
        if key not in self.entries and len(self.entries) >= MOST_ENTRIES:
            raise ValueError(f"the memory holds at most {MOST_ENTRIES} entries")
        self.entries[key] = {"value": value, "updated_at": int(time.time())}
        self.path.parent.mkdir(parents=True, exist_ok=True)
        new = self.path.with_name(self.path.name + ".new")
        new.write_text(json.dumps(self.entries, ensure_ascii=False), encoding="utf-8")
        os.replace(new, self.path)

    def get(self, key: str) -> str | None:
        e = self.entries.get(key)
        return e["value"] if e else None

    def list(self) -> list[tuple[str, str]]:
        return sorted((k, e["value"]) for k, e in self.entries.items())


def rules(path: str) -> str | None:
    """The text of a rules file, at most 65 536 bytes of it; None if there is none."""
    try:
        data = Path(path).read_bytes()
    except OSError:
        return None
    return data[:MOST_RULES].decode("utf-8", "ignore")
