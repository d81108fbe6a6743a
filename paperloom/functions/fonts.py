"""Lookup dimensions of fonts, and the ToUnicode map."""

from __future__ import annotations

import re

#: Each standard font and the names that files give it.
NAMES = {
    "Courier": ("Courier", "CourierNew", "CourierNewPSMT"),
    "Courier-Bold": ("Courier-Bold", "CourierNew,Bold", "CourierNewPS-BoldMT"),
    "Courier-Oblique": ("Courier-Oblique", "CourierNew,Italic", "CourierNewPS-ItalicMT"),
    "Courier-BoldOblique": ("Courier-BoldOblique", "CourierNew,BoldItalic", "CourierNewPS-BoldItalicMT"),
    "Helvetica": ("Helvetica", "Arial", "ArialMT"),
    "Helvetica-Bold": ("Helvetica-Bold", "Arial,Bold", "Arial-BoldMT"),
    "Helvetica-Oblique": ("Helvetica-Oblique", "Arial,Italic", "Arial-ItalicMT"),
    "Helvetica-BoldOblique": ("Helvetica-BoldOblique", "Arial,BoldItalic", "Arial-BoldItalicMT"),
    "Times-Roman": ("Times-Roman", "TimesNewRoman", "TimesNewRomanPSMT"),
    "Times-Bold": ("Times-Bold", "TimesNewRoman,Bold", "TimesNewRomanPS-BoldMT"),
    "Times-Italic": ("Times-Italic", "TimesNewRoman,Italic", "TimesNewRomanPS-ItalicMT"),
    "Times-BoldItalic": ("Times-BoldItalic", "TimesNewRoman,BoldItalic", "TimesNewRomanPS-BoldItalicMT"),
    "Symbol": ("Symbol",),
    "ZapfDingbats": ("ZapfDingbats",),
}


def aliases() -> dict[str, str]:
    """Name to standard name."""
    return {name: standard for standard, names in NAMES.items() for name in names}


_BLOCK = re.compile(r"begin(bfchar|bfrange)(.*?)end\1", re.S)
_PART = re.compile(r"<([0-9A-Fa-f\s]*)>|\[(.*?)\]", re.S)


def _text(digits: str) -> str:
    return bytes.fromhex("".join(digits.split())).decode("utf-16-be", "replace")


def to_unicode(cmap: str) -> list[tuple[int, str]]:
    """(code, text) pairs of a ToUnicode map: single characters, and ranges in both forms."""
    out = []
    for kind, body in _BLOCK.findall(cmap):
        parts = _PART.findall(body)
        step = 2 if kind == "bfchar" else 3
        for k in range(0, len(parts) - step + 1, step):
            first = int("".join(parts[k][0].split()) or "0", 16)
            if kind == "bfchar":
                out.append((first, _text(parts[k + 1][0])))
                continue
            last, (start, items) = int("".join(parts[k + 1][0].split()) or "0", 16), parts[k + 2]
            if items:
                out += [(first + n, _text(d)) for n, d in enumerate(re.findall(r"<([^>]*)>", items)) if first + n <= last]
            else:
                base = _text(start)
                out += [(first + n, base[:-1] + chr(ord(base[-1]) + n)) for n in range(min(last - first + 1, 65_536)) if base]
    return out
