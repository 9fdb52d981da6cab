"""A tokenizer for languages with braces: words, numbers, strings, templates, regular expressions, comments and marks."""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # word, number, string, regex, mark
    text: str
    start: int
    end: int
    line: int


_NUMBER = re.compile(r"(?:0[xXbBoO][\da-fA-F_]+|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?\d+)?)n?|\.\d[\d_]*")
_MARK = re.compile(r"\.\.\.|=>|\?\.|\?\?=?|&&=?|\|\|=?|[=!]==?|:=|<-|[+\-*/%&|^<>]=|\+\+|--|\*\*|.", re.DOTALL)
_WORD = re.compile(r"[#@]?[^\W\d][\w$]*|[#@]?\$[\w$]*")
#: Words before which a slash starts a regular expression.
_BEFORE_REGEX = frozenset("return typeof case in of delete void throw new else do instanceof yield await".split())


def tokenize(text: str, script: bool) -> tuple[list[Token], list[tuple[int, int]]]:
    """Tokens, and the spans of comments. script: templates and regular expressions as in JavaScript; else raw strings and runes as in Go."""
    out: list[Token] = []
    comments: list[tuple[int, int]] = []
    at, line, n = 0, 1, len(text)

    def push(kind: str, end: int) -> None:
        nonlocal at, line
        out.append(Token(kind, text[at:end], at, end, line))
        line += text.count("\n", at, end)
        at = end

    while at < n:
        c = text[at]
        if c.isspace():
            line += c == "\n"
            at += 1
        elif text.startswith("//", at):
            end = text.find("\n", at)
            end = n if end < 0 else end
            comments.append((at, end))
            at = end
        elif text.startswith("/*", at):
            end = text.find("*/", at + 2)
            end = n if end < 0 else end + 2
            comments.append((at, end))
            line += text.count("\n", at, end)
            at = end
        elif c in "'\"":
            push("string", _quoted(text, at, c))
        elif c == "`":
            push("string", _template(text, at) if script else _until(text, at + 1, "`"))
        elif c == "/" and script and _regex_here(out):
            push("regex", _regex_end(text, at))
        elif m := _NUMBER.match(text, at):
            push("number", m.end())
        elif (m := _WORD.match(text, at)) and (script or c not in "#@"):
            push("word", m.end())
        else:
            push("mark", _MARK.match(text, at).end())
    return out, comments


def _until(text: str, at: int, stop: str) -> int:
    end = text.find(stop, at)
    return len(text) if end < 0 else end + 1


def _quoted(text: str, at: int, quote: str) -> int:
    k = at + 1
    while k < len(text) and text[k] not in (quote, "\n"):
        k += 2 if text[k] == "\\" else 1
    return min(len(text), k + 1)


def _template(text: str, at: int) -> int:
    """Past a template, whose ${...} may hold strings and templates of their own."""
    k = at + 1
    while k < len(text):
        if text[k] == "\\":
            k += 2
        elif text[k] == "`":
            return k + 1
        elif text.startswith("${", k):
            deep, k = 1, k + 2
            while k < len(text) and deep:
                if text[k] in "'\"":
                    k = _quoted(text, k, text[k])
                    continue
                if text[k] == "`":
                    k = _template(text, k)
                    continue
                deep += (text[k] == "{") - (text[k] == "}")
                k += 1
        else:
            k += 1
    return len(text)


def _regex_here(before: list[Token]) -> bool:
    if not before:
        return True
    t = before[-1]
    return t.kind == "mark" and t.text not in (")", "]", "}", "++", "--") or t.kind == "word" and t.text in _BEFORE_REGEX


def _regex_end(text: str, at: int) -> int:
    k, in_class = at + 1, False
    while k < len(text) and text[k] != "\n":
        if text[k] == "\\":
            k += 2
            continue
        in_class = text[k] == "[" or in_class and text[k] != "]"
        if text[k] == "/" and not in_class:
            k += 1
            while k < len(text) and text[k].isalpha():
                k += 1
            return k
        k += 1
    return k


def closers(tokens: list[Token]) -> dict[int, int]:
    """For each opening bracket the index of its closing one, as far as they match."""
    pairs, stack = {}, []
    for k, t in enumerate(tokens):
        if t.kind == "mark" and t.text in "([{" and len(t.text) == 1:
            stack.append(k)
        elif t.kind == "mark" and t.text in ")]}" and len(t.text) == 1:
            while stack:
                a = stack.pop()
                if tokens[a].text + t.text in ("()", "[]", "{}"):
                    pairs[a] = k
                    break
    return pairs
