"""Symbols of JavaScript and TypeScript sources, read from tokens and matching brackets."""

from __future__ import annotations

from .parse_common import Parsed, file_id
from .tokens import closers, tokenize

_BRANCH_WORDS = frozenset("if for while do try catch case".split())
_NOT_CALLED = frozenset("if for while switch catch return function super typeof await new do else in of void delete throw yield with".split())
_FLAGS = frozenset("export default declare abstract".split())
_MEMBER_FLAGS = frozenset("static async get set public private protected readonly abstract override declare accessor *".split())


class _Reader:
    def __init__(self, path: str, text: str):
        language = "typescript" if path.lower().endswith((".ts", ".tsx", ".mts")) else "javascript"
        self.out, self.text, self.root = Parsed(path, language), text, file_id(path)
        self.t, self.comments = tokenize(text, script=True)
        self.close = closers(self.t)

    def is_(self, k: int, *texts: str) -> bool:
        return k < len(self.t) and self.t[k].kind in ("mark", "word") and self.t[k].text in texts

    def word(self, k: int) -> bool:
        return k < len(self.t) and self.t[k].kind == "word"

    def doc(self, k: int) -> str | None:
        """The doc comment that ends right before token k."""
        start = self.t[k].start
        before = self.t[k - 1].end if k else 0
        last = [c for c in self.comments if before <= c[0] and c[1] <= start]
        if not last or self.text[last[-1][1] : start].strip() or not self.text.startswith("/**", last[-1][0]):
            return None
        lines = (x.strip().removesuffix("*/").lstrip("/*").strip() for x in self.text[last[-1][0] : last[-1][1]].splitlines())
        return " ".join(x for x in lines if x)

    def until_end(self, k: int) -> int:
        """The index after a statement that starts at k: past a semicolon, or before a token on a new line that can't continue it."""
        while k < len(self.t):
            if k in self.close:
                k = self.close[k] + 1
            elif self.is_(k, ";"):
                return k + 1
            elif self.is_(k, "}", ")", "]"):
                return k
            else:
                k += 1
            if k < len(self.t) and self.t[k].line > self._last_line(k - 1) and self.t[k - 1].text not in ("=", "=>", ",", "|", "&", "+", "-", "*", "?", ":", "&&", "||", "??", "extends", "(", "[") and not (self.t[k].kind == "mark" and self.t[k].text in (".", "?.", "?", ":", "|", "&", "+", "-", "*", "&&", "||", "??", "=>", "=", ",", "(", "{")):
                return k
        return k

    def _last_line(self, k: int) -> int:
        return self.t[k].line + self.t[k].text.count("\n")

    def complexity(self, a: int, b: int) -> int:
        """One, and one for each branch. The while of a do loop belongs to the do; default counts where it is a case."""
        n, ends = 1, {self.close[k + 1] + 1 for k in range(a, b) if self.is_(k, "do") and k + 1 in self.close}
        for k in range(a, b):
            t = self.t[k]
            if t.kind == "word" and not self.is_(k - 1, ".", "?."):
                n += t.text in _BRANCH_WORDS and not self.is_(k + 1, ":") and not (t.text == "while" and k in ends) or t.text == "default" and self.is_(k + 1, ":")
            elif t.kind == "mark" and t.text == "?":
                n += not self.is_(k + 1, ":", ",", ")")
        return n

    def calls(self, a: int, b: int) -> list[tuple[str, int]]:
        found = []
        for k in range(a, b):
            t = self.t[k]
            if t.kind != "word" or t.text in _NOT_CALLED or not (self.is_(k + 1, "(") or self.is_(k + 1, "?.") and self.is_(k + 2, "(")):
                continue
            member = self.is_(k - 1, ".", "?.")
            head = k
            while self.is_(head - 1, ".", "?.") and self.word(head - 2):
                head -= 2
            if self.is_(head - 1, "new", "function") or (not member and self.is_(self.close.get(k + 1, -2) + 1, "{") and not self.is_(k - 1, "=", "(", ",", "return", "&&", "||")):
                continue
            found.append((t.text.lstrip("#") if not member else t.text, self.t[head].line))
        return found

    def refs(self, made: str, a: int, b: int) -> None:
        self.out.refs += [(made, name, "calls", line) for name, line in self.calls(a, b)]

    def body_after(self, k: int) -> tuple[int, int]:
        """The braces of a body after a parameter list, past a return type."""
        while k < len(self.t) and not self.is_(k, "{", ";"):
            k = self.close[k] + 1 if k in self.close and not self.is_(k, "{") else k + 1
        return (k, self.close.get(k, len(self.t) - 1)) if self.is_(k, "{") else (k, k)

    def end_line(self, k: int) -> int:
        k = min(k, len(self.t) - 1)
        return self._last_line(k)

    def slice(self, a: int, b: int) -> str:
        return self.text[self.t[a].start : self.t[min(b, len(self.t) - 1)].end] if a < len(self.t) else ""

    def params(self, k: int) -> int:
        """The index of the opening parenthesis at or after k, past type parameters."""
        while k < len(self.t) and not self.is_(k, "(", "{", ";"):
            k += 1
        return k

    def function(self, k: int, start: int, is_async: bool) -> int:
        k += 1 + self.is_(k + 1, "*")
        if not self.word(k):
            return k
        name, open_ = self.t[k].text, self.params(k + 1)
        a, b = self.body_after(self.close.get(open_, open_) + 1)
        made = self.out.symbol(name, "function", self.t[start].line, self.end_line(b), signature=name + self.slice(open_, self.close.get(open_, open_)), doc=self.doc(start), is_async=is_async, public=not name.startswith("_"), complexity=self.complexity(a, b))
        self.out.edges.append(("defines", self.root, made, self.t[start].line))
        self.refs(made, a, b)
        return b + 1

    def klass(self, k: int, start: int) -> int:
        k += 1
        if not self.word(k) or self.is_(k, "extends"):
            return k
        name, base = self.t[k].text, None
        while k < len(self.t) and not self.is_(k, "{"):
            if self.is_(k, "extends") and self.word(k + 1) and base is None:
                j = k + 1
                while self.is_(j + 1, ".") and self.word(j + 2):
                    j += 2
                base = self.slice(k + 1, j) if not self.is_(j + 1, "(") else None
            k += 1
        end = self.close.get(k, len(self.t) - 1)
        made = self.out.symbol(name, "class", self.t[start].line, self.end_line(end), doc=self.doc(start), public=not name.startswith("_"))
        self.out.edges.append(("defines", self.root, made, self.t[start].line))
        if base:
            self.out.refs.append((made, base, "inherits", self.t[start].line))
        k += 1
        while k < end:
            k = self.member(k, end, made, name)
        return end + 1

    def member(self, k: int, end: int, owner: str, owner_name: str) -> int:
        start, is_async = k, False
        if self.is_(k, ";"):
            return k + 1
        while self.is_(k, *_MEMBER_FLAGS) and not self.is_(k + 1, "(", "=", ";", ":", "?", "}") and k + 1 < end:
            is_async |= self.is_(k, "async")
            k += 1
        if self.is_(k, "{"):  # a static block
            return self.close.get(k, end) + 1
        if self.is_(k, "["):
            return max(self.until_end(self.close.get(k, end) + 1), k + 1)
        name, after = self.t[k].text, k + 1
        if self.t[k].text.startswith("@"):
            return self.close[after] + 1 if after in self.close and self.is_(after, "(") else after
        while after < end and self.is_(after, "?", "!"):
            after += 1
        if self.is_(after, "<"):
            after = self.params(after)
        if self.is_(after, "("):
            a, b = self.body_after(self.close.get(after, end) + 1)
            if not self.is_(a, "{"):
                return a + 1
            made = self.out.symbol(name, "function", self.t[start].line, self.end_line(b), signature=name + self.slice(after, self.close.get(after, after)), is_async=is_async, public=not name.startswith("_"), complexity=self.complexity(a, b))
            self.out.names[f"{owner_name}.{name}"] = made
            self.out.edges.append(("defines", owner, made, self.t[start].line))
            self.refs(made, a, b)
            return b + 1
        stop = min(self.until_end(after), end)
        if self.word(k):
            made = self.out.symbol(name, "variable", self.t[start].line, self.end_line(stop - 1), public=not name.startswith("_"), local=False)
            self.out.edges.append(("defines", owner, made, self.t[start].line))
        return max(stop, k + 1)

    def imports(self, k: int) -> int:
        start, end = k, self.until_end(k)
        if self.is_(k + 1, "(", "."):
            return end
        line = self.t[start].line
        add = lambda name: self.out.symbol(name, "import", line, line)
        k += 1 + (self.is_(k + 1, "type") and not self.is_(k + 2, "from", ","))
        while k < end and not self.is_(k, "from") and self.t[k].kind != "string":
            if self.is_(k, "{"):
                stop = self.close.get(k, end)
                k += 1
                while k < stop:
                    if self.is_(k, "type") and self.word(k + 1) and not self.is_(k + 1, "as"):
                        k += 1
                    if self.is_(k + 1, "as") and self.word(k + 2):
                        add(self.t[k + 2].text)
                        k += 3
                    elif self.word(k):
                        add(self.t[k].text)
                        k += 1
                    else:
                        k += 1
            elif self.is_(k, "*") and self.is_(k + 1, "as") and self.word(k + 2):
                add(self.t[k + 2].text)
                k += 3
            elif self.word(k):
                add(self.t[k].text)
                k += 1
            else:
                k += 1
        return end

    def variables(self, k: int, start: int) -> int:
        line, end, extra = self.t[start].line, self.until_end(k), {"is_constant": self.is_(k, "const")}
        k += 1
        while k < end:
            if not self.word(k):
                while k < end and not self.is_(k, ","):
                    k = self.close[k] + 1 if k in self.close else k + 1
                k += 1
                continue
            name, k = self.t[k].text, k + 1
            while k < end and not self.is_(k, "=", ","):
                k = self.close[k] + 1 if k in self.close else k + 1
            value = k + 1 if self.is_(k, "=") else None
            stop = k
            while stop < end and not (self.is_(stop, ",") and stop >= k):
                stop = self.close[stop] + 1 if stop in self.close else stop + 1
            if value is None or not self.arrow(name, value, stop, line, end):
                self.out.symbol(name, "variable", line, self.end_line(end - 1), public=not name.startswith("_"), extra=extra)
            k = stop + 1
        return end

    def arrow(self, name: str, k: int, stop: int, line: int, end: int) -> bool:
        is_async = self.is_(k, "async")
        k += is_async
        if self.is_(k, "function"):
            open_ = self.params(k)
            a, b = self.body_after(self.close.get(open_, open_) + 1)
            params = self.slice(open_, self.close.get(open_, open_))
        else:
            first = k
            if self.is_(k, "<"):
                k = self.params(k)
            after = self.close.get(k, k) + 1 if self.is_(k, "(") else k + 1
            params = self.slice(k if self.is_(k, "(") else first, after - 1)
            while after < stop and not self.is_(after, "=>") and self.is_(k, "("):
                if not self.is_(k, "(") or not self.is_(self.close.get(k, k) + 1, ":", "=>"):
                    return False
                after = self.close[after] + 1 if after in self.close else after + 1
            if not self.is_(after, "=>"):
                return False
            a, b = after + 1, stop
        made = self.out.symbol(name, "function", line, self.end_line(end - 1), signature=name + params, is_async=is_async, public=not name.startswith("_"), complexity=self.complexity(a, b))
        self.out.edges.append(("defines", self.root, made, line))
        self.refs(made, a, b)
        return True

    def named_type(self, k: int, interface: bool, start: int) -> int:
        name = self.t[k + 1].text
        if interface:
            j = k
            while j < len(self.t) and not self.is_(j, "{"):
                j += 1
            end = self.close.get(j, len(self.t) - 1) + 1
        else:
            end = self.until_end(k)
        last = end - 1
        signature = f"interface {name}" if interface else self.slice(start, last)
        made = self.out.symbol(name, "type", self.t[start].line, self.end_line(last), signature=signature, public=not name.startswith("_"))
        self.out.edges.append(("defines", self.root, made, self.t[start].line))
        return end

    def run(self) -> Parsed:
        k = 0
        while k < len(self.t):
            start = k
            while self.is_(start, *_FLAGS) and start + 1 < len(self.t):
                start += 1
            j = start
            is_async = self.is_(j, "async") and self.is_(j + 1, "function")
            j += is_async
            if self.is_(j, "function"):
                k = max(self.function(j, start, is_async), k + 1)
            elif self.is_(j, "class"):
                k = max(self.klass(j, start), k + 1)
            elif self.is_(j, "import"):
                k = max(self.imports(j), k + 1)
            elif self.is_(j, "const", "let", "var") and not self.is_(j + 1, "enum"):
                k = max(self.variables(j, start), k + 1)
            elif self.is_(j, "interface") and self.word(j + 1):
                k = self.named_type(j, True, start)
            elif self.is_(j, "type") and self.word(j + 1) and self.is_(j + 2, "=", "<"):
                k = self.named_type(j, False, start)
            else:
                k = max(self.until_end(j), k + 1)
        return self.out.settle()


def parse_javascript(path: str, text: str) -> Parsed:
    return _Reader(path, text).run()


