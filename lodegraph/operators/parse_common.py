"""What every language parser returns, and ids computed in Python as the columns compute them."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def file_id(path: str) -> str:
    return _sha(f"file:{path}")


def symbol_id(path: str, name: str, kind: str) -> str:
    return _sha(f"{path}:{name}:{kind}")


@dataclass
class Parsed:
    """Symbols, definition edges (kind, from, to, line), references (from, name, kind, line), and the file's own names."""

    path: str
    language: str | None
    symbols: list[dict] = field(default_factory=list)
    edges: list[tuple[str, str, str, int | None]] = field(default_factory=list)
    refs: list[tuple[str, str, str, int | None]] = field(default_factory=list)
    names: dict[str, str] = field(default_factory=dict)
    error: str | None = None

    def symbol(self, name: str, kind: str, start: int, end: int, *, signature: str | None = None, doc: str | None = None, is_async: bool = False, public: bool = True, complexity: float = 0.0, local: bool = True, extra: dict | None = None) -> str:
        made = symbol_id(self.path, name, kind)
        self.symbols.append({"id": made, "name": name, "kind": kind, "line_start": start, "line_end": end, "signature": signature, "docstring": doc, "is_async": is_async, "is_public": public, "complexity_score": float(complexity), "extra": json.dumps(extra, sort_keys=True) if extra else None})
        if local:
            self.names[name] = made
        return made

    def settle(self) -> Parsed:
        """Bind references to the file's own names; a symbol that is parsed twice keeps its first place and its last attributes."""
        rest = []
        for ref in self.refs:
            to = self.names.get(ref[1])
            if to and to != ref[0]:
                self.edges.append((ref[2], ref[0], to, ref[3]))
            else:
                rest.append(ref)
        self.refs = rest
        merged: dict[str, dict] = {}
        for s in self.symbols:
            merged[s["id"]] = s if s["id"] not in merged else merged[s["id"]] | s
        self.symbols = [s | {"ordinal": k} for k, s in enumerate(merged.values())]
        return self
