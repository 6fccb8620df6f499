"""What extractors collect, and limits."""

from __future__ import annotations

from dataclasses import dataclass, field

MAX_SYMBOLS, MAX_DEPTH = 50_000, 200


@dataclass
class Found:
    """One file's symbols, references and local edges."""

    max_symbols: int = MAX_SYMBOLS
    symbols: list[dict] = field(default_factory=list)
    refs: list[dict] = field(default_factory=list)
    edges: list[dict] = field(default_factory=list)
    truncated: bool = False

    def symbol(self, kind: str, name: str, start: tuple[int, int], end: tuple[int, int], signature: str | None = None, doc: str | None = None, qualname: str | None = None) -> int:
        """Add a symbol, and the edge from the file that holds it; -1 without a name or past the limit."""
        if not name:
            return -1
        if len(self.symbols) >= self.max_symbols:
            self.truncated = True
            return -1
        self.symbols.append({"kind": kind, "name": name, "qualname": qualname or name, "signature": signature, "start_line": start[0], "start_col": start[1], "end_line": end[0], "end_col": end[1], "visibility": None, "doc": doc})
        self.edges.append({"src": -1, "dst": len(self.symbols) - 1, "kind": "contains", "confidence": 1.0, "evidence": "ast_containment"})
        return len(self.symbols) - 1

    def ref(self, kind: str, name: str, start: tuple[int, int], end: tuple[int, int], containing: int = -1, evidence: str | None = None, arg_count: int | None = None, arg_pattern: str | None = None, receiver_type_hint: str | None = None) -> None:
        if name:
            self.refs.append({"kind": kind, "name": name, "start_line": start[0], "start_col": start[1], "end_line": end[0], "end_col": end[1], "evidence": evidence, "containing": containing, "arg_count": arg_count, "arg_pattern": arg_pattern, "receiver_type_hint": receiver_type_hint})
