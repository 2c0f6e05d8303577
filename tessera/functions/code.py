"""Where declarations of JavaScript and TypeScript (with tags) begin and end: a scan with a stack of what is open.

Strings, templates with their expressions, comments, regular expressions and tags are told apart from code, so a brace or quote inside
them opens nothing. Half-written code never fails: what isn't closed ends with the text."""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_SKIP = re.compile(r"(?:\s+|//[^\n]*|/\*.*?(?:\*/|\Z))+", re.S)
_WORD = re.compile(r"[\w$@#]+")
_STRING = {q: re.compile(rf"{q}(?:\\.|[^\\\n{q}])*(?:{q}|\\?\Z|(?=\n))", re.S) for q in "'\""}
_REGEX = re.compile(r"/(?![*/])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")
_TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^\\`$])*", re.S)
_TEXT = re.compile(r"[^<{]*")
_GENERIC = re.compile(r"<\s*\w+(?:\s+extends\b[^<>]*)?(?:\s*,[^<>()]*)?>\s*\(")
_TAG = re.compile(r"<(?=[A-Za-z_$>])")
_TAG_PART = re.compile(r"/?>|\{|'[^']*'?|\"[^\"]*\"?|[^/>{'\"]+|/", re.S)
#: Words after which an expression begins, so that a slash or an angle begins a value.
_BEFORE_VALUE = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "default", "yield", "await", "instanceof", "extends"}
_CONTINUES = {"in", "of", "instanceof", "as", "satisfies", "extends"}

WORD, MARK, VALUE = 0, 1, 2
Token = tuple[int, int, int, str]  # kind, start, end, text of words and marks


def tokens(text: str) -> list[Token]:
    """Words, marks (one character, or =>) and values (strings, numbers, regular expressions, pieces of templates, tags and their texts).
    Braces of expressions inside templates and tags are marks, so that all brackets pair up."""
    out: list[Token] = []
    open_ = ["code"]
    i, n = 0, len(text)

    def is_value() -> bool:
        """Whether the last token ends a value."""
        if not out:
            return False
        kind, _, _, s = out[-1]
        return kind == VALUE or (kind == WORD and s not in _BEFORE_VALUE) or s in (")", "]", "}")

    def piece(m: re.Match) -> int:
        if m.end() > m.start():
            out.append((VALUE, m.start(), m.end(), ""))
        return m.end()

    while i < n:
        mode = open_[-1]
        if mode == "template":
            i = piece(_TEMPLATE.match(text, i))
            if text.startswith("${", i):
                out.append((MARK, i, i + 2, "{"))
                open_.append("code")
                i += 2
            elif i < n:
                out.append((VALUE, i, i + 1, ""))
                open_.pop()
                i += 1
        elif mode == "children":
            i = piece(_TEXT.match(text, i))
            if text.startswith("</", i):
                end = text.find(">", i)
                end = n if end < 0 else end + 1
                out.append((VALUE, i, end, ""))
                open_.pop()
                i = end
            elif i < n and text[i] == "<":
                out.append((VALUE, i, i + 1, ""))
                open_.append("tag")
                i += 1
            elif i < n:
                out.append((MARK, i, i + 1, "{"))
                open_.append("code")
                i += 1
        elif mode == "tag":
            m = _TAG_PART.match(text, i)
            i = m.end()
            if m.group() == "{":
                out.append((MARK, m.start(), i, "{"))
                open_.append("code")
                continue
            out.append((VALUE, m.start(), i, ""))
            if m.group() == ">":
                open_[-1] = "children"
            elif m.group() == "/>":
                open_.pop()
        elif m := _SKIP.match(text, i):
            i = m.end()
        elif m := _WORD.match(text, i):
            out.append((VALUE if text[i].isdigit() else WORD, i, m.end(), m.group()))
            i = m.end()
        elif text[i] in _STRING:
            i = piece(_STRING[text[i]].match(text, i))
        elif text[i] == "`":
            out.append((VALUE, i, i + 1, ""))
            open_.append("template")
            i += 1
        elif text[i] == "/" and not is_value() and (m := _REGEX.match(text, i)):
            i = piece(m)
        elif text[i] == "<" and not is_value() and _TAG.match(text, i) and not _GENERIC.match(text, i):
            out.append((VALUE, i, i + 1, ""))
            open_.append("tag")
            i += 1
        else:
            mark = "=>" if text.startswith("=>", i) else text[i]
            out.append((MARK, i, i + len(mark), mark))
            if mark == "{":
                open_.append("code")
            elif mark == "}" and len(open_) > 1:
                open_.pop()
            i += len(mark)
    return out


def declarations(text: str) -> list[tuple[bool, int, int]]:
    """(whether it is an import, start, end) of the outermost function declarations and expressions, arrow functions, ``const`` and ``let``
    statements and imports, in order; what is inside one is part of it."""
    t, out = tokens(text), []
    pair, stack = {}, []
    for k, (kind, _, _, s) in enumerate(t):
        if kind == MARK and s in "([{":
            stack.append(k)
        elif kind == MARK and s in ")]}" and stack:
            pair[stack.pop()] = k
    last = len(t) - 1

    def word(k: int, *which: str) -> bool:
        return 0 <= k <= last and t[k][0] == WORD and t[k][3] in which

    def mark(k: int, *which: str) -> bool:
        return 0 <= k <= last and t[k][0] == MARK and t[k][3] in which

    def broken(k: int) -> bool:
        """Whether a line end before token ``k`` ends the statement."""
        if "\n" not in text[t[k - 1][2] : t[k][1]]:
            return False
        ends = t[k - 1][0] == VALUE or (t[k - 1][0] == WORD and t[k - 1][3] not in _BEFORE_VALUE) or mark(k - 1, ")", "]", "}")
        return ends and t[k][0] != MARK and not word(k, *_CONTINUES) or ends and mark(k, "@", "#", "{")

    def statement_end(k: int, stop: str = ";") -> int:
        """The last token of the statement or, with a comma in ``stop``, of the expression that goes on at ``k``."""
        first = k
        while k <= last:
            if mark(k, ")", "]", "}") or k > first and broken(k):
                return k - 1
            if mark(k, *stop):
                return k if stop == ";" else k - 1
            k = pair.get(k, last if mark(k, "(", "[", "{") else k) + 1
        return last

    def function_end(k: int) -> int | None:
        """The closing brace of the function whose name or parameters are at ``k``; None if it has no body."""
        while k <= last and not mark(k, "("):
            if mark(k, ";", "{", "}", ")"):
                return None
            k += 1
        k = pair.get(k, last) + 1
        while k <= last and not mark(k, "{"):
            if mark(k, ";", "}", ")", "=>") or broken(k):
                return None
            k = pair.get(k, k) + 1
        if mark(k - 1, ":", "|", "&"):  # the braces of a type, then the body's
            k = pair.get(k, last) + 1
        return pair.get(k, last) if mark(k, "{") else None

    def arrow(k: int) -> int | None:
        """The => of the arrow function whose parameters begin at ``k``."""
        if t[k][0] == WORD and mark(k + 1, "=>"):
            return k + 1
        if not mark(k, "(") or k not in pair:
            return None
        k = pair[k] + 1
        if mark(k, ":"):  # a type
            while k <= last and not mark(k, "=>", ";", ",", ")", "{", "}"):
                k = pair.get(k, k) + 1
        return k if mark(k, "=>") else None

    k = 0
    while k <= last:
        begin = k == 0 or mark(k - 1, ";", "{", "}", ")") or "\n" in text[t[k - 1][2] : t[k][1]] or word(k - 1, "export", "default", "declare")
        end, start, is_import = None, k, False
        if mark(k - 1, "."):
            pass
        elif begin and word(k, "import") and not mark(k + 1, "(", "."):
            is_import, end = True, k
            while end < last and t[end][0] != VALUE:
                end += 1
            if mark(end + 1, ";"):
                end += 1
        elif begin and word(k, "type", "interface") and k < last and t[k + 1][0] == WORD:
            k = statement_end(k) + 1 if word(k, "type") else next((pair.get(j, last) for j in range(k, last + 1) if mark(j, "{")), last) + 1
            continue
        elif word(k, "const", "let") and (k < last and (t[k + 1][0] == WORD and not word(k + 1, "enum") or mark(k + 1, "{", "["))):
            looped = mark(k - 1, "(") and (word(k - 2, "for") or word(k - 3, "for"))
            each = looped and any(word(j, "of", "in") for j in range(k, min(k + 4, last + 1))) or looped and mark(k + 1, "{", "[") and word(pair.get(k + 1, k) + 1, "of", "in")
            end = None if each else statement_end(k + 1)
        elif word(k, "function") and not mark(k + 1, ":", "="):
            end = function_end(k + 1)
            start = k - 1 if word(k - 1, "async") else k
        elif (to := arrow(k)) is not None:
            start = k - 1 if word(k - 1, "async") else k
            end = pair.get(to + 1, last) if mark(to + 1, "{") else statement_end(to + 1, ";,")
        if end is None:
            k += 1
            continue
        end = max(k, min(end, last))
        out.append((is_import, t[start][1], t[end][2]))
        k = end + 1
    return out


SPAN = "struct<is_import:boolean,start:int,length:int,start_line:int,end_line:int>"


def spans(text: Column) -> Column:
    """The declarations of a text: is_import, start (from 1) and length in characters, start_line, end_line."""

    @F.arrow_udf(f"array<{SPAN}>")
    def found(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts.to_pylist():
            ends = [m.start() for m in re.finditer("\n", text or "")]
            rows.append([{"is_import": i, "start": a + 1, "length": z - a, "start_line": bisect_right(ends, a - 1) + 1, "end_line": bisect_right(ends, z - 1) + 1} for i, a, z in declarations(text or "")])
        return pa.array(rows, pa.list_(pa.struct([("is_import", pa.bool_()), *((c, pa.int32()) for c in ("start", "length", "start_line", "end_line"))])))

    return found(text)
