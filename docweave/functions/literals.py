"""Technical literals in prose, for the workers that shield them. The patterns are
fixed values: what counts as a literal must not differ between engines."""

from __future__ import annotations

import re

EXTENSIONS = ("dts", "dtbo", "cfg", "conf", "ini", "yaml", "yml", "toml", "mk", "ko", "sh", "xml", "json", "html", "pdf", "h", "c", "cc", "cpp", "hpp", "py", "txt", "bin", "img", "rc", "dll", "so", "log", "csv", "md", "dita")
URL = r"https?://[^\s<>\"']{1,2048}"
CONSTANT = r"\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\b"
PATH = r"(?<![@\w])(?:[A-Za-z]:\\[^\s<>\"'|]*|(?:\.\.?|~)?[/\\][^\s<>\"'|]*)"
TAG = r"</?[A-Za-z][A-Za-z0-9:_-]*(?:\s+[^<>\n]*?)?\s*/?>"
FILE = r"(?<![@A-Za-z0-9_])(?:[A-Za-z]:\\)?(?:\.\.?[/\\]|~[/\\]|[/\\])?[A-Za-z0-9_{}-]+(?:[./\\][A-Za-z0-9_{}-]+)*\.(?:" + "|".join(sorted(EXTENSIONS, key=len, reverse=True)) + r")(?![A-Za-z0-9_])"
BREAK = r"<br\s*/?>"

url, constant, path, tag = (re.compile(p, f) for p, f in ((URL, re.I), (CONSTANT, 0), (PATH, 0), (TAG, 0)))
file = re.compile(FILE, re.I)
dotted = re.compile(r"\.[A-Za-z]")
token = re.compile(r"@@PROTECT_\d+@@")
line_break = re.compile(BREAK, re.I)


class Shield:
    """Gives out numbered tokens and remembers, in the order of their making, what
    they stand for."""

    def __init__(self, taken: frozenset[str] = frozenset()) -> None:
        self.made: list[tuple[str, str, str]] = []
        self.taken = taken  # tokens that the source itself holds
        self.next = 0

    def token(self, raw: str, kind: str) -> str:
        while (name := f"@@PROTECT_{self.next:04d}@@") in self.taken:
            self.next += 1
        self.next += 1
        self.made.append((name, raw, kind))
        return name

    def take(self) -> list[tuple[str, str, str]]:
        """What was made since the last call; numbers go on."""
        made, self.made = self.made, []
        return made

    def cover(self, text: str, pattern: re.Pattern, kind: str, *, backwards: bool = False, keep: re.Pattern | None = None) -> str:
        """``text`` with tokens for the matches, numbered from the left, or from the
        right if ``backwards``. Matches within a token stay, as do those that
        ``keep`` matches wholly."""
        spots = [m for m in pattern.finditer(text) if not (text.endswith("@@", 0, m.start()) and text.startswith("@@", m.end())) and not (keep and keep.fullmatch(m[0]))]
        named = {m.start(): self.token(m[0], kind) for m in (reversed(spots) if backwards else spots)}
        out, at = [], 0
        for m in spots:
            out += [text[at : m.start()], named[m.start()]]
            at = m.end()
        return "".join([*out, text[at:]])

    def literals(self, text: str, *, urls: bool = False) -> str:
        """Files, addresses, paths and constants. A pattern is tried only where a text
        holds what every match must."""
        if dotted.search(text):
            text = self.cover(text, file, "file_literal", backwards=True)
        if urls and "://" in text:
            text = self.cover(text, url, "url_literal")
        if "/" in text or "\\" in text:
            text = self.cover(text, path, "path_literal")
        return self.cover(text, constant, "upper_constant_literal") if "_" in text else text

    def prose(self, text: str) -> str:
        return self.literals(self.cover(text, tag, "html_xml_tag", keep=line_break) if "<" in text else text)


def restore(text: str, made: list[tuple[str, str, str]]) -> str:
    """Tokens back to what they stand for, the last made first, as a literal may hold
    an earlier token."""
    for name, raw, _ in reversed(made):
        text = text.replace(name, raw)
    return text
