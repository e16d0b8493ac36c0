"""What the three languages share: errors, string literals, durations, canonical order."""

from __future__ import annotations

import re

UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000, "y": 31_536_000_000}
DURATION = re.compile(r"(?:(\d+)y)?(?:(\d+)w)?(?:(\d+)d)?(?:(\d+)h)?(?:(\d+)m(?!s))?(?:(\d+)s)?(?:(\d+)ms)?")
_ESCAPES = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "\\": "\\", '"': '"', "'": "'"}


class ParseError(ValueError):
    """The expression is not of the language."""


def unquote(literal: str) -> str:
    """The value of a quoted literal: raw in backticks, else with the usual escapes."""
    q, body = literal[0], literal[1:-1]
    if q == "`":
        return body
    if "\n" in body:
        raise ParseError("line break in a string")
    if "\\" not in body:
        return body
    out, i = [], 0
    while i < len(body):
        c = body[i]
        if c != "\\":
            out.append(c)
            i += 1
            continue
        e = body[i + 1 : i + 2]
        if e in _ESCAPES:
            out.append(_ESCAPES[e])
            i += 2
            continue
        for lead, size, base in (("x", 2, 16), ("u", 4, 16), ("U", 8, 16), ("", 3, 8)):
            start = i + 1 + len(lead)
            digits = body[start : start + size]
            if body[i + 1 : i + 1 + len(lead)] == lead and re.fullmatch(r"[0-7]+" if base == 8 else r"[0-9A-Fa-f]+", digits) and len(digits) == size:
                value = int(digits, base)
                if value > 0x10FFFF or base == 8 and value > 255:
                    raise ParseError("bad escape")
                out.append(chr(value))
                i = start + size
                break
        else:
            raise ParseError("bad escape")
    return "".join(out)


def duration_ms(text: str) -> int | None:
    """Milliseconds of a duration such as 1h30m, in falling units, or of a bare 0; None if it is not one."""
    if text == "0":
        return 0
    m = DURATION.fullmatch(text or "")
    if not m or not any(m.groups()):
        return None
    return sum(int(n) * UNITS[u] for n, u in zip(m.groups(), ("y", "w", "d", "h", "m", "s", "ms"), strict=True) if n)


def duration_text(ms: int) -> str:
    """The shortest exact spelling: 60s becomes 1m."""
    if ms == 0:
        return "0s"
    out = []
    for unit in ("y", "w", "d", "h", "m", "s", "ms"):
        n = ms // UNITS[unit]
        if n and (unit not in ("y", "w") or ms % UNITS[unit] == 0):
            out.append(f"{n}{unit}")
            ms -= n * UNITS[unit]
    return "".join(out)


_PLAIN = re.compile(r"[^\\^$*+?{}\[\]|()]*")


def compiled(pattern: str) -> re.Pattern:
    try:
        return re.compile(pattern)
    except (re.error, RecursionError, OverflowError) as e:
        raise ParseError(f"bad regular expression: {e}") from None


def check_regex(pattern: str) -> None:
    """Raises ParseError unless it compiles; what has no special characters but dots does."""
    if not _PLAIN.fullmatch(pattern):
        compiled(pattern)


def matches_empty(pattern: str) -> bool:
    return not pattern if _PLAIN.fullmatch(pattern) else compiled(pattern).fullmatch("") is not None


class Tokens:
    """A list of (kind, text, start) that is read from the left."""

    def __init__(self, items: list[tuple[str, str, int]]):
        self.items, self.depth = items, 0
        self.end = ("end", "", items[-1][2] + len(items[-1][1]) if items else 0)
        self._go(0)

    def _go(self, i: int) -> None:
        """kind and text are attributes of their own because parsers ask for them all the time."""
        self.i = i
        self.kind, self.text, _ = self.items[i] if i < len(self.items) else self.end

    def ahead(self, n: int = 1) -> str:
        return self.items[self.i + n][1] if self.i + n < len(self.items) else ""

    def take(self) -> str:
        t = self.text
        self._go(self.i + 1)
        return t

    def at(self, *texts: str) -> bool:
        """The next token is one of these signs or keywords (a string literal never is)."""
        return self.text in texts and self.kind != "string" and self.kind != "end"

    def skip(self, *texts: str) -> bool:
        if self.at(*texts):
            self._go(self.i + 1)
            return True
        return False

    def need(self, *texts: str) -> str:
        if not self.at(*texts):
            raise ParseError(f"unexpected {self.text or 'end of input'!r}, expected {' or '.join(texts)}")
        return self.take()

    def need_kind(self, *kinds: str) -> str:
        if self.kind not in kinds:
            raise ParseError(f"unexpected {self.text or 'end of input'!r}, expected {' or '.join(kinds)}")
        return self.take()

    def deeper(self) -> None:
        self.depth += 1
        if self.depth > 150:
            raise ParseError("nested too deeply")


def scan(pattern: re.Pattern, text: str) -> list[tuple[str, str, int]]:
    """Tokens by a pattern of named groups; groups whose name starts with _ are dropped."""
    out, i = [], 0
    for m in pattern.finditer(text):
        at, end = m.span()
        if at != i or end == i:
            break
        if (kind := m.lastgroup)[0] != "_":
            out.append((kind, m[0], i))
        i = end
    if i < len(text):
        raise ParseError(f"unexpected character {text[i]!r} at {i}")
    return out
