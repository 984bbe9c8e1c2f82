"""A small YAML reader for configuration files: block and flow collections, plain, quoted and block scalars, anchors, aliases, merge keys, several documents.

Scalars mean what YAML 1.1 says (``yes`` is true, ``010`` is 8, dates are no text). Complex keys, custom tags and broken texts raise ``YamlError``.
"""

from __future__ import annotations

import re
from datetime import date

_BOOLS = {w: flag for flag, words in ((True, "yes true on"), (False, "no false off")) for word in words.split() for w in (word, word.capitalize(), word.upper())}
_NULLS = {"", "~", "null", "Null", "NULL"}
_INT = re.compile(r"[-+]?(?:0b[01_]+|0x[0-9a-fA-F_]+|0[0-7_]*|[1-9][0-9_]*(?::[0-5]?[0-9])*)")
_FLOAT = re.compile(r"[-+]?(?:(?:[0-9][0-9_]*)\.[0-9_]*(?:[eE][-+][0-9]+)?|\.[0-9][0-9_]*(?:[eE][-+][0-9]+)?|\.(?:inf|Inf|INF))|\.(?:nan|NaN|NAN)")
_DATE = re.compile(r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}(?:[Tt \t].*)?")
_KEY = re.compile(r"""(?:"(?:[^"\\\n]|\\.)*"|'(?:[^'\n]|'')*'|(?![-?:](?:\s|$)|[,\[\]{}#&*!|>'"%@`])(?:[^\s:#]|:(?=\S)|(?<=\S)\#|[ \t]+(?![#\s]))+?)[ \t]*:(?=[ \t\n]|$)""")
_ESCAPES = {"0": "\0", "a": "\a", "b": "\b", "t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r", "e": "\x1b", " ": " ", '"': '"', "/": "/", "\\": "\\", "N": "\x85", "_": "\xa0", "L": "\u2028", "P": "\u2029"}
_MARKER = re.compile(r"(?:---|\.\.\.)(?=\s|$)")


class YamlError(ValueError):
    pass


def scalar(text: str):
    """What a plain scalar stands for."""
    if text in _NULLS:
        return None
    if text in _BOOLS:
        return _BOOLS[text]
    if _INT.fullmatch(text):
        sign, digits = (-1 if text[0] == "-" else 1), text.lstrip("+-").replace("_", "")
        if ":" in digits:
            value = 0
            for part in digits.split(":"):
                value = 60 * value + int(part)
            return sign * value
        base = {"0b": 2, "0x": 16}.get(digits[:2], 8 if digits[0] == "0" and len(digits) > 1 else 10)
        return sign * int(digits[2:] if base in (2, 16) else digits, base)
    if _FLOAT.fullmatch(text):
        plain = text.replace("_", "").lower()
        return float(plain.replace(".inf", "inf").replace(".nan", "nan"))
    if _DATE.fullmatch(text):
        try:
            return date.fromisoformat(f"{int(text[:4]):04d}-{int(text.split('-')[1]):02d}-{int(re.split('[-Tt ]', text)[2]):02d}")
        except ValueError as broken:
            raise YamlError(str(broken)) from broken
    return text


class _Parser:
    def __init__(self, text: str):
        self.text, self.at, self.anchors, self.deep = text.replace("\r\n", "\n").removeprefix("\ufeff"), 0, {}, 0

    # Places

    def column(self) -> int:
        return self.at - (self.text.rfind("\n", 0, self.at) + 1)

    def peek(self, n: int = 1) -> str:
        return self.text[self.at : self.at + n]

    def blank(self, lines: bool = True) -> None:
        """Past white space and comments, within the line or over lines; a tab never indents."""
        while True:
            m = re.compile(r"[ \t]*").match(self.text, self.at)
            start, self.at = self.at, m.end()
            if self.peek() == "#" and (start < self.at or self.at == 0 or self.text[self.at - 1] in "\n \t"):
                end = self.text.find("\n", self.at)
                self.at = len(self.text) if end < 0 else end
            if not lines or self.peek() != "\n":
                break
            self.at += 1
        if "\t" in self.text[self.text.rfind("\n", 0, self.at) + 1 : self.at] and lines and self.peek() and not self.text[self.text.rfind("\n", 0, self.at) + 1 : self.at].strip(" \t") and self.peek() not in "\n[]{},":
            raise YamlError("a tab indents")

    def ended(self) -> bool:
        return self.at >= len(self.text) or (self.column() == 0 and _MARKER.match(self.text, self.at) is not None)

    def line_ended(self) -> bool:
        return self.at >= len(self.text) or self.peek() == "\n"

    def dash(self) -> bool:
        return self.peek() == "-" and (self.peek(2) == "-" or self.peek(2)[1] in " \t\n")

    # Documents

    def documents(self) -> list:
        out = []
        while True:
            self.blank()
            while self.peek() == "%" and self.column() == 0:
                end = self.text.find("\n", self.at)
                self.at = len(self.text) if end < 0 else end
                self.blank()
            while self.peek(3) == "..." and self.ended():
                self.at += 3
                self.blank()
            marked = self.at < len(self.text) and self.peek(3) == "---" and self.ended()
            if marked:
                self.at += 3
            if self.at >= len(self.text) and not marked:
                return out
            self.anchors = {}
            out.append(self.node(-1, compact=not marked))
            self.blank()
            if not self.ended():
                raise YamlError(f"text after a document at {self.at}")

    # Nodes

    def node(self, parent: int, compact: bool, dashes: bool = False):
        """A node deeper than ``parent``, from here or the next lines on; null if there is none. A block collection may begin within the line only if ``compact``; with ``dashes`` a sequence may lie at the parent's column."""
        self.deep += 1
        if self.deep > 200:
            raise YamlError("nested too deeply")
        try:
            return self._node(parent, compact, dashes)
        finally:
            self.deep -= 1

    def _node(self, parent: int, compact: bool, dashes: bool):
        name = tag = None
        while True:
            self.blank(lines=False)
            if self.line_ended():
                self.blank()
                if self.ended() or not (self.column() > parent or (dashes and self.column() == parent and self.dash())):
                    return self.named(name, "" if tag == "str" else None)
                compact = True
            m = re.compile(r"&([^\s,\[\]{}]+)|!(\S*)").match(self.text, self.at)
            if m is None:
                break
            self.at = m.end()
            if m[1]:
                name = m[1]
            else:
                tag = m[2].lstrip("!").removeprefix("<tag:yaml.org,2002:").removesuffix(">")
                if tag not in ("str", "int", "float", "bool", "null", "map", "seq"):
                    raise YamlError(f"tag {m[0]}")
        first = self.peek()
        if first == "*":
            m = re.compile(r"\*([^\s,\[\]{}:]+)").match(self.text, self.at)
            if m is None or m[1] not in self.anchors:
                raise YamlError("unknown alias")
            self.at = m.end()
            return self.anchors[m[1]]
        if first in "|>" and first:
            return self.named(name, self.block_scalar(parent))
        if compact and self.dash():
            return self.sequence(name)
        if compact and _KEY.match(self.text, self.at):
            return self.mapping(name)
        if first in "[{":
            return self.named(name, self.flow())
        if first in "\"'":
            found = self.quoted()
        elif first in ",]}#%@`" or (first in "?:-" and self.peek(2)[1:] in ("", " ", "\t", "\n")):
            raise YamlError(f"unexpected {first!r} at {self.at}")
        else:
            text = self.plain(parent)
            found = text if tag == "str" else scalar(text)
        self.blank(lines=False)
        if self.peek() == ":":
            raise YamlError(f"a key is not expected at {self.at}")
        return self.named(name, found)

    def named(self, name: str | None, value):
        if name:
            self.anchors[name] = value
        return value

    def sequence(self, name: str | None) -> list:
        column, out = self.column(), []
        self.named(name, out)
        while not self.ended() and self.column() == column and self.dash():
            self.at += 1
            out.append(self.node(column, compact=True))
            self.blank()
        if not self.ended() and self.column() > column:
            raise YamlError(f"bad indentation at {self.at}")
        return out

    def mapping(self, name: str | None) -> dict:
        column, out, merged = self.column(), {}, []
        self.named(name, out)
        while not self.ended() and self.column() == column:
            m = _KEY.match(self.text, self.at)
            if m is None:
                if self.dash():
                    break
                raise YamlError(f"a key is expected at {self.at}")
            plain = m[0][:-1].rstrip()
            if plain[0] in "\"'":
                key = self.quoted()
            else:
                key = scalar(plain)
            self.at = m.end()
            value = self.node(column, compact=False, dashes=True)
            if plain == "<<":
                merged += value if isinstance(value, list) else [value]
            else:
                out[key] = value
            self.blank()
        if not self.ended() and self.column() > column:
            raise YamlError(f"bad indentation at {self.at}")
        for more in merged:
            if not isinstance(more, dict):
                raise YamlError("only a map can be merged")
            for key, value in more.items():
                out.setdefault(key, value)
        return out

    # Scalars

    def plain(self, parent: int) -> str:
        """A plain scalar, over following deeper lines too; line feeds become spaces, empty lines line feeds."""
        line = re.compile(r"(?:[^\s:#]|:(?=\S)|(?<=\S)\#|[ \t]+(?![#\s])(?!:(?:\s|$)))*")
        parts, empty = [], 0
        while True:
            m = line.match(self.text, self.at)
            parts.append(("\n" * empty if empty else " ") + m[0] if parts else m[0])
            self.at = m.end()
            back = self.at
            self.blank(lines=False)
            if not self.line_ended() or "#" in self.text[back : self.at]:
                return "".join(parts)
            empty = -1
            while self.peek() == "\n":
                self.at, empty = self.at + 1, empty + 1
                self.at = re.compile(r"[ \t]*").match(self.text, self.at).end()
            if self.ended() or self.column() <= parent or self.peek() == "#" or _KEY.match(self.text, self.at):
                if not self.ended() and self.column() > parent and _KEY.match(self.text, self.at):
                    raise YamlError(f"a key is not expected at {self.at}")
                self.at = back
                return "".join(parts)

    def quoted(self) -> str:
        quote = self.peek()
        m = re.compile(r'"((?:[^"\\]|\\.)*)"' if quote == '"' else r"'((?:[^']|'')*)'", re.S).match(self.text, self.at)
        if m is None:
            raise YamlError("an open quote")
        self.at = m.end()
        folded = re.sub(r"(?<!\\)[ \t]*\n([ \t]*\n)*[ \t]*", lambda f: "\n" * (f[0].count("\n") - 1) or " ", m[1])
        if quote == "'":
            return folded.replace("''", "'")

        def escape(e: re.Match) -> str:
            code = e[1]
            if code[0] in "xuU" and len(code) > 1:
                return chr(int(code[1:], 16))
            if code[0] == "\n":
                return ""
            if code not in _ESCAPES:
                raise YamlError(f"escape {code!r}")
            return _ESCAPES[code]

        return re.sub(r"\\(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|\n[ \t]*|.)", escape, re.sub(r"\\ \n[ \t]*", "\\\n", folded), flags=re.S)

    def block_scalar(self, parent: int) -> str:
        m = re.compile(r"([|>])(?:([1-9])([-+])?|([-+])([1-9])?)?[ \t]*(?:(?<=[ \t])#[^\n]*)?(?:\n|$)").match(self.text, self.at)
        if m is None:
            raise YamlError("a broken block scalar")
        self.at = m.end()
        given, chomp = m[2] or m[5], m[3] or m[4]
        indent = max(parent, 0) + int(given) if given else None
        lines = []
        while self.at < len(self.text):
            end = self.text.find("\n", self.at)
            end = len(self.text) if end < 0 else end
            line = self.text[self.at : end]
            own = len(line) - len(line.lstrip(" "))
            if line.strip(" "):
                if indent is None:
                    indent = own
                if own < indent or own <= parent or (own == 0 and _MARKER.match(line)):
                    break
            lines.append(line[indent:] if indent is not None else line.strip(" "))
            self.at = min(len(self.text), end + 1)
        kept = len(lines)
        while kept and not lines[kept - 1]:
            kept -= 1
        tail = len(lines) - kept
        self.at -= 0 if self.at >= len(self.text) and not self.text.endswith("\n") else 1
        body = lines[:kept]
        if m[1] == "|":
            text = "\n".join(body)
        else:
            text = ""
            for i, line in enumerate(body):
                if i == 0:
                    text = line
                    continue
                before = body[i - 1]
                loose = line[:1] in (" ", "\t") or before[:1] in (" ", "\t")
                if line == "":
                    text += "\n"
                elif before == "":
                    text += ("\n" if loose or _last_full(body, i)[:1] in (" ", "\t") else "") + line
                else:
                    text += ("\n" if loose else " ") + line
        return text + ("" if chomp == "-" or not kept and chomp != "+" else "\n" * (1 + tail if chomp == "+" and kept else tail if chomp == "+" else 1))

    # Flow collections

    def flow(self):
        self.deep += 1
        if self.deep > 200:
            raise YamlError("nested too deeply")
        try:
            return self._flow()
        finally:
            self.deep -= 1

    def _flow(self):
        self.blank()
        name = None
        if m := re.compile(r"&([^\s,\[\]{}]+)\s*").match(self.text, self.at):
            name, self.at = m[1], m.end()
        first = self.peek()
        if first == "*":
            m = re.compile(r"\*([^\s,\[\]{}]+)").match(self.text, self.at)
            if m is None or m[1] not in self.anchors:
                raise YamlError("unknown alias")
            self.at = m.end()
            return self.anchors[m[1]]
        if first == "[":
            self.at += 1
            out = self.named(name, [])
            while self.more("]"):
                value = self._flow()
                out.append({value: self._flow()} if self.colon() else value)
                self.comma("]")
            return out
        if first == "{":
            self.at += 1
            out = self.named(name, {})
            while self.more("}"):
                key = self._flow()
                if isinstance(key, (list, dict)):
                    raise YamlError("a complex key")
                value = None
                if self.colon():
                    self.blank()
                    value = None if self.peek() in ",}" else self._flow()
                out[key] = value
                self.comma("}")
            return out
        if first in ("'", '"'):
            return self.named(name, self.quoted())
        m = re.compile(r"(?:[^\s,\[\]{}:#]|:(?=[^\s,\[\]{}])|(?<=\S)\#|\s+(?![#\s,\[\]{}:]))+").match(self.text, self.at)
        if m is None:
            raise YamlError(f"unexpected {first!r} at {self.at}")
        self.at = m.end()
        return self.named(name, scalar(re.sub(r"\s*\n\s*", " ", m[0])))

    def more(self, end: str) -> bool:
        self.blank()
        if self.at >= len(self.text):
            raise YamlError("an open flow collection")
        if self.peek() == end:
            self.at += 1
            return False
        return True

    def colon(self) -> bool:
        self.blank()
        found = self.peek() == ":"
        self.at += found
        return found

    def comma(self, end: str) -> None:
        self.blank()
        if self.peek() == ",":
            self.at += 1
        elif self.peek() != end:
            raise YamlError(f"a comma is expected at {self.at}")


def _last_full(lines: list[str], before: int) -> str:
    return next((line for line in reversed(lines[:before]) if line), "")


def documents(text: str) -> list:
    """All documents of a YAML text as maps, lists and scalars."""
    return _Parser(text).documents()


def _flags(value) -> bool:
    return isinstance(value, (str, int, float, bool))


def environment(text: str) -> list[tuple[str, str]]:
    """Keys and values of ``environment`` maps and lists and of ``env`` lists of name and value, anywhere in the documents; none of a text that is no YAML."""
    found, seen = [], set()
    try:
        waiting = list(reversed(documents(text)))
    except (YamlError, TypeError, RecursionError):
        return []
    while waiting:
        node = waiting.pop()
        if isinstance(node, (dict, list)) and id(node) in seen:  # an alias
            continue
        if isinstance(node, dict):
            seen.add(id(node))
            given, named = node.get("environment"), node.get("env")
            if isinstance(given, dict):
                found += [(k, str(v)) for k, v in given.items() if isinstance(k, str) and _flags(v)]
            elif isinstance(given, list):
                found += [(k.strip(), v) for k, eq, v in (i.partition("=") for i in given if isinstance(i, str)) if eq]
            for item in named if isinstance(named, list) else ():
                if isinstance(item, dict) and isinstance(item.get("name"), str) and _flags(item.get("value")):
                    found.append((item["name"], str(item["value"])))
            waiting += reversed(list(node.values()))
        elif isinstance(node, list):
            seen.add(id(node))
            waiting += reversed(node)
    return found


def listed(text: str) -> list[tuple[str, str]]:
    """Names and values of the lists of a YAML map: texts, and of maps their ``fqname`` or else their first entry; none of a text that is no YAML."""
    try:
        found = documents(text)
    except (YamlError, TypeError, RecursionError):
        return []
    out = []
    for node in found:
        for name, values in node.items() if isinstance(node, dict) else ():
            for v in values if isinstance(values, list) else ():
                v = v.get("fqname", next(iter(v.values()))) if isinstance(v, dict) and v else v
                if isinstance(name, str) and isinstance(v, str) and v:
                    out.append((name, v))
    return out
