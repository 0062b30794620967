"""Declarations and uses in Java sources, one row each, read token by token.

This only says what a file states: types, members, imports, and in method bodies calls, creations, local variables and
types in use. What names mean is found by joins (`operators.resolve`). A file that cannot be read gives one row `error`.

Rows: path, what (package, import, type, typeparam, method, field, param, local, call, new, use, error, file), owner (qualified name
of the type), member (qualified name of the method or field), name, type_text, scope (of calls: what stands before the
dot; of types: the one around; of methods: varargs), args, place (order), start_line, end_line, kind, visibility, modifiers, annotations, supers (types that a type
extends and implements: kind:text), params (erased), complexity.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

FACTS = (
    "path string, what string, owner string, member string, name string, type_text string, scope string, args int, place int, start_line int, end_line int, kind string, visibility string, "
    "modifiers string, annotations array<string>, supers array<string>, params array<string>, complexity int"
)
COLUMNS = [c.split()[0] for c in FACTS.split(", ")]
TOKEN = re.compile(r'//[^\n]*|/\*.*?\*/|"""(?:\\.|.)*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\'|[A-Za-z_$][\w$]*|\d[\w.]*|::|->|&&|\|\||\.\.\.|\S', re.S)
VISIBILITY, MODIFIERS = {"public", "protected", "private"}, {"static", "final", "abstract", "synchronized", "native", "default", "transient", "volatile", "strictfp", "sealed"}
TYPE_WORDS = {"class": "CLASS", "interface": "INTERFACE", "enum": "ENUM", "record": "RECORD"}
WORDS = {"if", "for", "while", "do", "switch", "catch", "return", "throw", "synchronized", "assert", "try", "else", "case", "instanceof", "super", "this", "new", "yield", "default", "finally", "break", "continue"}
BRANCHES = {"if", "for", "while", "do", "catch", "&&", "||"}
PAIRS = {"(": ")", "{": "}", "[": "]"}


class Unreadable(ValueError):
    pass


class Source:
    """Tokens of a file, and a place among them."""

    def __init__(self, text: str):
        self.t: list[str] = []
        self.line: list[int] = []
        line, at = 1, 0
        for m in TOKEN.finditer(text):
            line += text.count("\n", at, m.start())
            at = m.start()
            if not m[0].startswith(("//", "/*")):
                self.t.append(m[0])
                self.line.append(line)
        self.i, self.rows, self.text = 0, [], text

    def at(self, k: int = 0) -> str:
        return self.t[self.i + k] if 0 <= self.i + k < len(self.t) else ""

    def take(self, want: str = "") -> str:
        if self.i >= len(self.t) or (want and self.t[self.i] != want):
            raise Unreadable(f"line {self.line[min(self.i, len(self.line) - 1)] if self.line else 1}: {want or 'more'} expected")
        self.i += 1
        return self.t[self.i - 1]

    def close(self, i: int) -> int:
        """Index of the bracket that closes the one at i."""
        end, depth = PAIRS[self.t[i]], 0
        for k in range(i, len(self.t)):
            depth += (self.t[k] == self.t[i]) - (self.t[k] == end)
            if not depth:
                return k
        raise Unreadable(f"line {self.line[i]}: {end} expected")

    def name(self, i: int) -> bool:
        return 0 <= i < len(self.t) and (self.t[i][0].isalpha() or self.t[i][0] in "_$") and self.t[i] not in WORDS

    def type_end(self, i: int) -> int:
        """Index after the type that begins at i, or i if none does."""
        k = i
        while k < len(self.t) and self.t[k] == "@":  # annotations on types
            k += 2
        if not self.name(k) and self.t[k : k + 1] != ["?"]:
            return i
        k += 1
        while k < len(self.t):
            if self.t[k] == "." and self.name(k + 1):
                k += 2
            elif self.t[k] == "<":
                depth, j = 0, k
                while j < len(self.t) and (self.t[j] in "<>,.?&[]@" or self.name(j) or self.t[j] in ("extends", "super")):
                    depth += (self.t[j] == "<") - (self.t[j] == ">")
                    j += 1
                    if not depth:
                        break
                if depth:
                    return k
                k = j
            elif self.t[k] == "[" and self.t[k + 1 : k + 2] == ["]"]:
                k += 2
            else:
                break
        return k

    def type_(self) -> str:
        end = self.type_end(self.i)
        text = " ".join(self.t[self.i : end])
        self.i = end
        return re.sub(r"\s*([<>.,\[\]?])\s*", r"\1", text).replace(",", ", ").replace("?extends", "? extends").replace("?super", "? super")

    def put(self, what: str, **columns) -> None:
        self.rows.append({"what": what, "place": len(self.rows)} | columns)


def erased(text: str) -> str:
    while "<" in text:
        shorter = re.sub(r"<[^<>]*>", "", text)
        if shorter == text:
            break
        text = shorter
    text = re.sub(r"\s+", "", text).replace("...", "[]")
    return re.sub(r"^[^\[]*\.", "", text)


def _prefix(s: Source) -> tuple[str, list[str], list[str]]:
    visibility, modifiers, annotations = "package", [], []
    while True:
        if s.at() == "@" and s.at(1) != "interface":
            start = s.i
            s.i += 2
            while s.at() == ".":
                s.i += 2
            if s.at() == "(":
                s.i = s.close(s.i) + 1
            annotations.append("".join(s.t[start + 1 : s.i]))
        elif s.at() in VISIBILITY:
            visibility = s.take()
        elif s.at() in MODIFIERS and not (s.at() == "default" and s.at(1) in (":", "->")):
            modifiers.append(s.take())
        elif s.at() == "non" and s.at(1) == "-":
            s.i += 3
        else:
            return visibility, modifiers, annotations


def _parameters(s: Source) -> list[tuple[str, str]]:
    out, end = [], s.close(s.i)
    s.i += 1
    while s.i < end:
        _prefix(s)
        text = s.type_()
        if s.at() == "...":
            text += s.take()
        if s.i < end and s.at() != ",":
            out.append((text, s.take()))
        while s.i < end and s.take() != ",":
            pass
    s.i = end + 1
    return out


def _type(s: Source, package: str, outer: str, prefix: tuple[str, list[str], list[str]]) -> None:
    start = s.line[s.i]
    word = s.take()
    kind = "ANNOTATION" if word == "@" and s.take("interface") else TYPE_WORDS[word]
    name = s.take()
    qualified = f"{outer}.{name}" if outer else f"{package}.{name}" if package else name
    params = _type_parameters(s) if s.at() == "<" else []
    components = _parameters(s) if kind == "RECORD" and s.at() == "(" else []
    supers = []
    while s.at() in ("extends", "implements", "permits"):
        how = s.take()
        while True:
            if how != "permits":
                supers.append(f"{'IMPLEMENTS' if how == 'implements' else 'EXTENDS'}:{s.type_()}")
            else:
                s.type_()
            if s.at() != ",":
                break
            s.i += 1
    end = s.close(s.i) if s.at() == "{" else s.i
    s.put("type", owner=qualified, name=name, kind=kind, scope=outer or None, start_line=start, end_line=s.line[end], visibility=prefix[0], modifiers=",".join(prefix[1]), annotations=prefix[2], supers=supers)
    for p in params:
        s.put("typeparam", owner=qualified, name=p)
    for text, field in components:
        s.put("field", owner=qualified, member=f"{qualified}#{field}", name=field, type_text=text, start_line=start, end_line=start, visibility="private", modifiers="final")
    s.take("{")
    if kind == "ENUM":
        while s.i < end and s.at() != ";":
            s.i = s.close(s.i) + 1 if s.at() in PAIRS else s.i + 1
    declared = set()
    while s.i < end:
        if s.at() == ";":
            s.i += 1
            continue
        mine = _prefix(s)
        if s.at() in TYPE_WORDS and s.name(s.i + 1) and not (s.at() == "record" and s.at(2) not in ("(", "<")) or (s.at() == "@" and s.at(1) == "interface"):
            _type(s, package, qualified, mine)
        elif s.at() == "{":
            s.i = s.close(s.i) + 1
        else:
            declared.add(_member(s, qualified, name, kind, mine, end))
    for text, field in components:
        if field not in declared:
            s.put("method", owner=qualified, member=f"{qualified}#{field}()", name=field, type_text=text, kind="METHOD", args=0, params=[], start_line=start, end_line=start, visibility="public", modifiers="", complexity=1)
    s.i = end + 1


def _type_parameters(s: Source) -> list[str]:
    """The names that the brackets at hand declare."""
    depth, names = 0, []
    while True:
        opens = s.at() == "<"
        depth += opens - (s.at() == ">")
        if depth == 1 and (opens or s.at() == ",") and s.name(s.i + 1):
            names.append(s.at(1))
        s.take()
        if not depth:
            return names


def _member(s: Source, owner: str, type_name: str, owner_kind: str, prefix: tuple[str, list[str], list[str]], end: int) -> str:
    start = s.line[s.i]
    generic = _type_parameters(s) if s.at() == "<" else []
    shared = {"owner": owner, "visibility": prefix[0] if owner_kind not in ("INTERFACE", "ANNOTATION") or prefix[0] != "package" else "public", "annotations": prefix[2]}
    constructor = s.at() == type_name and s.at(1) in ("(", "{")
    text = "" if constructor else s.type_()
    if not constructor and not text:
        raise Unreadable(f"line {s.line[s.i]}: a member expected")
    name = s.take()
    if s.at() == "(" or (constructor and s.at() == "{"):
        params = _parameters(s) if s.at() == "(" else []
        thrown = []
        while s.at() not in ("{", ";", ""):
            if s.at() in ("throws", ",") and s.name(s.i + 1):
                s.i += 1
                thrown.append(s.type_())
            else:
                s.i += 1
        stop = s.close(s.i) if s.at() == "{" else s.i
        called = "<init>" if constructor else name
        member = f"{owner}#{called}({','.join(erased(p) for p, _ in params)})"
        modifiers = prefix[1] + (["abstract"] if s.at() == ";" and owner_kind == "INTERFACE" else [])
        row = len(s.rows)
        s.put("method", member=member, name=called, type_text=text, kind="CONSTRUCTOR" if constructor else "METHOD", args=len(params), params=[erased(p) for p, _ in params], scope="varargs" if params and params[-1][0].endswith("...") else None, start_line=start, end_line=s.line[stop], modifiers=",".join(modifiers), complexity=1, **shared)
        for p, n in params:
            s.put("param", owner=owner, member=member, name=n, type_text=p)
        for p in generic:
            s.put("typeparam", owner=owner, member=member, name=p)
        for text in thrown:
            s.put("use", owner=owner, member=member, type_text=text)
        s.rows[row]["complexity"] = 1 + _body(s, s.i + 1, stop, owner, member)
        s.i = stop + 1
        return name
    while True:
        s.put("field", member=f"{owner}#{name}", name=name, type_text=text, start_line=start, end_line=start, modifiers=",".join(prefix[1]), **shared)
        start_ = s.i
        while s.i < end and s.at() not in (",", ";"):
            if s.at() == "new" and s.name(s.i + 1):
                s.i = s.type_end(s.i + 1)
            else:
                s.i = s.close(s.i) + 1 if s.at() in PAIRS else s.i + 1
        for k in range(start_, s.i):  # what a field is made with
            if s.t[k] == "new" and s.name(k + 1):
                _creation(s, k, owner=owner, member=f"{owner}#{name}")
        if s.i >= end or s.take() == ";":
            return name
        name = s.take()


def _arguments(s: Source, i: int) -> int:
    stop, n, k = s.close(i), 0, i + 1
    if k < stop:
        n = 1
    while k < stop:
        if s.t[k] in PAIRS:
            k = s.close(k)
        elif s.t[k] == "<":
            k = max(k, s.type_end(k - 1) - 1)
        n += s.t[k] == ","
        k += 1
    return n


def _scope(s: Source, i: int) -> str:
    """What stands before the dot at i - 1: a dotted name, `this`, `super`, `new T`, `call n/args before`, or `?`."""
    k = i - 2
    if s.t[k] == ")":
        depth, j = 0, k
        while j >= 0:
            depth += (s.t[j] == ")") - (s.t[j] == "(")
            if not depth:
                break
            j -= 1
        if j > 0 and s.name(j - 1):
            if j > 1 and s.t[j - 2] == "new":
                return f"new {s.t[j - 1]}"
            before = _scope(s, j - 1) if j > 1 and s.t[j - 2] == "." else ""
            return f"call {s.t[j - 1]}/{_arguments(s, j)} {before}".strip()
        return "?"
    if not (s.name(k) or s.t[k] in ("this", "super")):
        return "?"
    parts = [s.t[k]]
    while k >= 2 and s.t[k - 1] == "." and (s.name(k - 2) or s.t[k - 2] in ("this", "super")):
        k -= 2
        parts.append(s.t[k])
    return ".".join(reversed(parts)) if k < 1 or s.t[k - 1] != "." else "?"


def _creation(s: Source, k: int, **here) -> None:
    """The `new` at k."""
    end = s.type_end(k + 1)
    text, called = "".join(s.t[k + 1 : end]).replace("<>", ""), s.t[end : end + 1] == ["("]
    s.put("new" if called else "use", type_text=text, args=_arguments(s, end) if called else None, **here)


def _cast(s: Source, k: int) -> str:
    """The type that the bracket at k casts to, or nothing."""
    if s.t[k - 1] in (")", "]", "if", "while", "for", "switch", "catch", "try", "synchronized", "super", "this") or s.name(k - 1):
        return ""
    end = s.type_end(k + 1)
    after = s.t[end + 1] if end + 1 < len(s.t) else ""
    operand = s.name(end + 1) or after in ("(", "this", "new", "super", "!", "~") or after[:1] in "\"'0123456789"
    return "".join(s.t[k + 1 : end]) if end > k + 1 and s.t[end] == ")" and after and operand else ""


def _body(s: Source, i: int, stop: int, owner: str, member: str) -> int:
    """Rows of a method's body; its branches."""
    branches, here, k = 0, {"owner": owner, "member": member}, i
    while k < stop:
        t, before, after = s.t[k], s.t[k - 1], s.t[k + 1] if k + 1 < len(s.t) else ""
        if t in BRANCHES and not (t == "while" and before == "}" and after == "(" and s.t[s.close(k + 1) + 1 : s.close(k + 1) + 2] == [";"]):
            branches += 1
        elif t == "?" and before not in ("<", ",") and after not in (">", "extends", "super"):
            branches += 1
        elif t == "case":
            depth, j = 0, k + 1
            branches += 1
            while s.t[j] not in (":", "->"):
                depth += (s.t[j] in "([{") - (s.t[j] in ")]}")
                branches += s.t[j] == "," and depth == 0
                j += 1
        if t == "new" and s.name(k + 1):
            _creation(s, k, **here)
        elif t in ("this", "super") and after == "(" and before in ("{", ";", "}"):
            s.put("call", name="<init>", scope=t, args=_arguments(s, k + 1), **here)
        elif t == "class" and before == ".":
            first = k - 2
            while s.t[first - 1] == "." and s.name(first - 2):
                first -= 2
            s.put("use", type_text="".join(s.t[first : k - 1]), **here)
        elif t == "(" and before != "catch" and (text := _cast(s, k)):
            s.put("use", type_text=text, **here)
        elif t == "instanceof" or (t == "(" and before == "catch"):
            j = k + 1 + (s.t[k + 1] == "final")
            s.put("use", type_text="".join(s.t[j : s.type_end(j)]), **here)
        elif t == "::" and after:
            what = "new" if after == "new" else "call"
            name = _scope(s, k + 1) if s.t[k - 1] != ")" else "?"
            s.put(what, name=None if what == "new" else after, type_text=name if what == "new" else None, scope=None if what == "new" else name, args=-1, **here)
        elif s.name(k) and after == "(" and before != "new" and not (before == "." and k >= 2 and s.t[k - 2] == "new"):
            if not (s.name(k - 1) and before not in ("return", "else", "do")):
                s.put("call", name=t, scope=_scope(s, k) if before == "." else None, args=_arguments(s, k + 1), **here)
        if before in (";", "{", "}", "(", "final", "->") and s.name(k):
            end = s.type_end(k)
            if end > k and s.name(end) and s.t[end + 1 : end + 2] and s.t[end + 1] in ("=", ";", ":", ","):
                text = "".join(s.t[k:end])
                if text == "var" and s.t[end + 2 : end + 3] == ["new"]:
                    text = "".join(s.t[end + 3 : s.type_end(end + 3)])
                s.put("local", name=s.t[end], type_text=text, **here)
        k += 1
    return branches


def read(path: str, text: str) -> list[dict]:
    """All rows of a file."""
    s = Source(text)
    package = ""
    s.put("file", args=sum(1 for x in text.split("\n") if x.strip()))
    try:
        while s.i < len(s.t):
            if s.at() == ";":
                s.i += 1
                continue
            prefix = _prefix(s)
            if s.at() in ("package", "import"):
                what = s.take()
                static = s.at() == "static" and s.take() == "static"
                parts = []
                while s.at() != ";":
                    parts.append(s.take())
                s.i += 1
                name = "".join(parts)
                if what == "package":
                    package = name
                s.put(what, name=name, kind="static" if static or "static" in prefix[1] else None)
            else:
                _type(s, package, "", prefix)
    except (Unreadable, IndexError, KeyError, RecursionError) as e:
        s.put("error", name=str(e)[:500])
    return [{"path": path} | r for r in s.rows]


def facts(files: DataFrame) -> DataFrame:
    """Rows of every file of a table (path, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, text in zip(batch["path"], batch["text"], strict=True):
                out = pd.DataFrame(read(path, text or ""), columns=COLUMNS)
                for c in ("args", "place", "start_line", "end_line", "complexity"):
                    out[c] = out[c].astype("Int32")
                yield out.astype(object).where(out.notna(), None)

    return files.select("path", "text").mapInPandas(run, FACTS)
