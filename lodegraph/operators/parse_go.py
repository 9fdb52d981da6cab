"""Symbols of Go sources, read from tokens and matching brackets."""

from __future__ import annotations

from .parse_common import Parsed, file_id
from .tokens import closers, tokenize

_BRANCH_WORDS = frozenset("if for range default".split())
_NOT_CALLED = frozenset("func if for switch select return go defer map chan interface struct range".split())
_TYPE_KINDS = {"struct": "struct_type", "interface": "interface_type", "map": "map_type", "chan": "channel_type", "func": "function_type", "*": "pointer_type", "[": "slice_type", "(": "parenthesized_type"}


class _Reader:
    def __init__(self, path: str, text: str):
        self.out, self.text, self.root = Parsed(path, "go"), text, file_id(path)
        self.t, _ = tokenize(text, script=False)
        self.close = closers(self.t)

    def is_(self, k: int, *texts: str) -> bool:
        return 0 <= k < len(self.t) and self.t[k].kind in ("mark", "word") and self.t[k].text in texts

    def word(self, k: int) -> bool:
        return k < len(self.t) and self.t[k].kind == "word"

    def slice(self, a: int, b: int) -> str:
        return self.text[self.t[a].start : self.t[min(b, len(self.t) - 1)].end] if a < len(self.t) else ""

    def line_end(self, k: int) -> int:
        """The index after the last token of a statement: at the end of its line, outside brackets."""
        while k < len(self.t):
            k = self.close[k] + 1 if k in self.close else k + 1
            if k >= len(self.t) or self.is_(k, ")", "}", ";") or self.t[k].line > self.t[k - 1].line + self.t[k - 1].text.count("\n") and not (self.t[k - 1].kind == "mark" and self.t[k - 1].text not in (")", "]", "}", "++", "--")):
                return k
        return k

    def function(self, k: int) -> int:
        start, receiver, k = k, None, k + 1
        if self.is_(k, "("):
            end = self.close.get(k, k)
            inner = self.slice(k + 1, end - 1) if end > k + 1 else ""
            receiver = inner.split(None, 1)[-1].lstrip("*").strip() if inner else None
            k = end + 1
        if not self.word(k):
            return k + 1
        name, k = self.t[k].text, k + 1
        if self.is_(k, "["):
            k = self.close.get(k, k) + 1
        last = self.close.get(k, k)
        signature = (f"({receiver}) " if receiver else "") + name + self.slice(k, last)
        body = last + 1
        while body < len(self.t) and not self.is_(body, "{"):
            if self.t[body].line > self.t[body - 1].line:
                break
            if self.is_(body, "interface", "struct") and self.is_(body + 1, "{"):
                body = self.close.get(body + 1, body) + 1
            else:
                body = self.close[body] + 1 if body in self.close else body + 1
        if body > last + 1:
            signature += " " + self.slice(last + 1, body - 1)
        end = self.close.get(body, body - 1) if self.is_(body, "{") else body - 1
        made = self.out.symbol(name, "function", self.t[start].line, self.t[min(end, len(self.t) - 1)].line, signature=signature, public=name[:1].isupper(), complexity=self.complexity(body, end))
        if receiver:
            self.out.names[f"{receiver}.{name}"] = made
        self.out.edges.append(("defines", self.root, made, self.t[start].line))
        self.out.refs += [(made, n, "calls", line) for n, line in self.calls(body, end)]
        return end + 1

    def complexity(self, a: int, b: int) -> int:
        """One, and one for each if, for, range, select, type switch, case of a value switch, and default."""
        n, values = 1, []
        for k in range(a, b):
            t = self.t[k]
            if t.kind != "word":
                continue
            if t.text in ("switch", "select"):
                open_ = k + 1
                while open_ < b and not self.is_(open_, "{"):
                    open_ = self.close[open_] + 1 if open_ in self.close and not self.is_(open_, "{") else open_ + 1
                by_type = t.text == "switch" and any(self.is_(x, "type") and self.is_(x - 1, "(") and self.is_(x - 2, ".") for x in range(k, open_ + 1)) or t.text == "switch" and any(self.is_(x, "(") and self.is_(x - 1, ".") and self.is_(x + 1, "type") for x in range(k, open_ + 1))
                n += t.text == "select" or by_type
                values.append((open_, self.close.get(open_, b), t.text == "switch" and not by_type))
            elif t.text == "case":
                inside = [v for v in values if v[0] < k < v[1]]
                n += bool(inside) and inside[-1][2]
            else:
                n += t.text in _BRANCH_WORDS
        return n

    def calls(self, a: int, b: int) -> list[tuple[str, int]]:
        found = []
        for k in range(a, b):
            t = self.t[k]
            if t.kind == "word" and t.text not in _NOT_CALLED and self.is_(k + 1, "(") and not self.is_(k - 1, "func"):
                head = k
                while self.is_(head - 1, ".") and self.word(head - 2):
                    head -= 2
                found.append((t.text, self.t[head].line))
        return found

    def group(self, k: int) -> tuple[int, list[tuple[int, int]], int]:
        """The end of a declaration and the spans of its specs."""
        if not self.is_(k + 1, "("):
            end = self.line_end(k + 1)
            return end, [(k + 1, end)], end - 1
        end = self.close.get(k + 1, len(self.t) - 1)
        specs, at = [], k + 2
        while at < end:
            stop = min(self.line_end(at), end)
            specs.append((at, max(stop, at + 1)))
            at = max(stop, at + 1) + self.is_(stop, ";")
        return end + 1, specs, end

    def declaration(self, k: int) -> int:
        what, line = self.t[k].text, self.t[k].line
        end, specs, last = self.group(k)
        for a, b in specs:
            if what == "import":
                at = b - 1
                while at > a and self.t[at].kind != "string":
                    at -= 1
                if self.t[at].kind != "string":
                    continue
                path = self.t[at].text.strip('"`')
                alias = self.t[a].text if at > a else path.split("/")[-1]
                self.out.symbol(alias, "import", line, line)
                self.out.refs.append((self.root, path, "imports", line))
            elif what == "type" and self.word(a):
                name, t = self.t[a].text, a + 1
                if self.is_(t, "[") and self.word(t + 1) and self.word(t + 2):
                    t = self.close.get(t, t) + 1
                if self.is_(t, "="):
                    continue
                kind = _TYPE_KINDS.get(self.t[t].text, "qualified_type" if self.is_(t + 1, ".") else "type_identifier") if t < b else "unknown"
                if kind == "slice_type" and not self.is_(t + 1, "]"):
                    kind = "array_type"
                made = self.out.symbol(name, "class" if kind in ("struct_type", "interface_type") else "type", line, self.t[min(last, len(self.t) - 1)].line, signature=f"type {name} {kind}", public=name[:1].isupper(), extra={"go_type_kind": kind})
                self.out.edges.append(("defines", self.root, made, line))
            elif what in ("var", "const") and self.word(a):
                name = self.t[a].text
                self.out.symbol(name, "variable", self.t[a].line, self.t[b - 1].line + self.t[b - 1].text.count("\n"), public=name[:1].isupper(), extra={"is_constant": what == "const"})
        return end

    def run(self) -> Parsed:
        k = 0
        while k < len(self.t):
            if self.is_(k, "func"):
                k = max(self.function(k), k + 1)
            elif self.is_(k, "import", "type", "var", "const"):
                k = max(self.declaration(k), k + 1)
            else:
                k = self.close[k] + 1 if k in self.close else k + 1
        return self.out.settle()


def parse_go(path: str, text: str) -> Parsed:
    return _Reader(path, text).run()
