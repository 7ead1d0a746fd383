"""Text of rich-text files."""

from __future__ import annotations

import re

#: Groups that hold no text, control words that are characters, and those that end a line.
HIDDEN = {
    "fonttbl", "colortbl", "stylesheet", "info", "pict", "object", "filetbl", "listtable",
    "listoverridetable", "revtbl", "rsidtbl", "datastore", "xmlnstbl", "generator", "latentstyles", "themedata",
    "colorschememapping", "fldinst", "bkmkstart", "bkmkend", "header", "footer", "footnote", "xe",
    "tc", "shppict",
}
CHARACTERS = {"tab": "\t", "bullet": "\u2022", "endash": "\u2013", "emdash": "\u2014", "lquote": "\u2018", "rquote": "\u2019", "ldblquote": "\u201c", "rdblquote": "\u201d", "~": "\u00a0", "-": "\u00ad", "_": "\u2011", "\\": "\\", "{": "{", "}": "}"}
BREAKS = {"par", "line", "row", "cell", "sect", "page"}

_TOKEN = re.compile(r"\\([a-zA-Z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\(.)|([{}])|([^\\{}]+)", re.S)


def to_text(raw: bytes) -> str:
    """Plain text; input without a header is text already. Never raises."""
    source = raw.decode("cp1252", "replace")
    start = source.find("{\\rtf", 0, 110)
    if start < 0:
        return raw.decode("utf-8", "replace")
    out: list[str] = []
    stack: list[tuple[bool, int]] = []
    hidden, per_unicode, skip, opened = False, 1, 0, False
    for word, number, byte, symbol, brace, plain in _TOKEN.findall(source[start:]):
        if brace == "{":
            stack.append((hidden, per_unicode))
            opened = True
            continue
        if brace == "}":
            hidden, per_unicode = stack.pop() if stack else (False, 1)
            opened = False
            continue
        if symbol == "*" and opened:  # an optional destination
            hidden = True
        elif word and opened and word in HIDDEN:
            hidden = True
        opened = opened and symbol == "*"
        if hidden:
            continue
        if plain:
            out.append(plain[skip:])
            skip = max(0, skip - len(plain))
        elif byte:
            if skip:
                skip -= 1
            else:
                out.append(bytes([int(byte, 16)]).decode("cp1252", "replace"))
        elif symbol:
            out.append("\n" if symbol in "\r\n" else CHARACTERS.get(symbol, ""))
        elif word == "uc":
            per_unicode = int(number or 1)
        elif word == "u" and number:
            out.append(chr(int(number) % 65536))
            skip = per_unicode
        elif word in BREAKS:
            out.append("\n")
        else:
            out.append(CHARACTERS.get(word, ""))
    text = re.sub("\n{3,}", "\n\n", "".join(out))
    return "\n".join(x.rstrip() for x in text.split("\n"))
