"""Glyph names and one-byte encodings, as lookup dimensions made from rules."""

from __future__ import annotations

import unicodedata

#: Accents in glyph names and in character names.
ACCENTS = {
    "acute": "ACUTE", "breve": "BREVE", "caron": "CARON", "cedilla": "CEDILLA", "circumflex": "CIRCUMFLEX", "commaaccent": "CEDILLA", "dieresis": "DIAERESIS",
    "dotaccent": "DOT ABOVE", "grave": "GRAVE", "hungarumlaut": "DOUBLE ACUTE", "macron": "MACRON", "ogonek": "OGONEK", "ring": "RING ABOVE", "tilde": "TILDE",
}
#: Glyph names of characters that no rule gives.
MARKS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")",
    "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">",
    "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|",
    "braceright": "}", "asciitilde": "~", "nbspace": " ", "exclamdown": "¡", "cent": "¢", "sterling": "£", "currency": "¤", "yen": "¥", "brokenbar": "¦", "section": "§",
    "dieresis": "¨", "copyright": "©", "ordfeminine": "ª", "guillemotleft": "«", "logicalnot": "¬", "registered": "®", "macron": "¯", "degree": "°", "plusminus": "±",
    "acute": "´", "mu": "µ", "paragraph": "¶", "periodcentered": "·", "cedilla": "¸", "ordmasculine": "º", "guillemotright": "»", "onequarter": "¼", "onehalf": "½",
    "threequarters": "¾", "questiondown": "¿", "multiply": "×", "divide": "÷", "AE": "Æ", "ae": "æ", "OE": "Œ", "oe": "œ", "Eth": "Ð", "eth": "ð", "Thorn": "Þ", "thorn": "þ",
    "germandbls": "ß", "dotlessi": "ı", "Oslash": "Ø", "oslash": "ø", "Lslash": "Ł", "lslash": "ł", "Dcroat": "Đ", "dcroat": "đ", "Hbar": "Ħ", "hbar": "ħ", "Tbar": "Ŧ",
    "tbar": "ŧ", "IJ": "Ĳ", "ij": "ĳ", "Eng": "Ŋ", "eng": "ŋ", "kgreenlandic": "ĸ", "longs": "ſ", "florin": "ƒ", "circumflex": "ˆ", "caron": "ˇ", "breve": "˘",
    "dotaccent": "˙", "ring": "˚", "ogonek": "˛", "tilde": "˜", "hungarumlaut": "˝", "endash": "–", "emdash": "—", "quoteleft": "‘", "quoteright": "’",
    "quotesinglbase": "‚", "quotedblleft": "“", "quotedblright": "”", "quotedblbase": "„", "dagger": "†", "daggerdbl": "‡", "bullet": "•", "ellipsis": "…",
    "perthousand": "‰", "guilsinglleft": "‹", "guilsinglright": "›", "fraction": "⁄", "Euro": "€", "trademark": "™", "partialdiff": "∂", "product": "∏", "summation": "∑",
    "minus": "−", "radical": "√", "infinity": "∞", "integral": "∫", "approxequal": "≈", "notequal": "≠", "lessequal": "≤", "greaterequal": "≥", "lozenge": "◊",
    "ff": "ﬀ", "fi": "ﬁ", "fl": "ﬂ", "ffi": "ﬃ", "ffl": "ﬄ",
}
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_GREEK = "Alpha Beta Gamma Delta Epsilon Zeta Eta Theta Iota Kappa Lambda Mu Nu Xi Omicron Pi Rho Sigma Tau Upsilon Phi Chi Psi Omega".split()


def _named(name: str) -> str | None:
    try:
        return unicodedata.lookup(name)
    except KeyError:
        return None


def glyphs() -> dict[str, str]:
    """Glyph name to character: letters, digits, accented Latin letters, Greek letters, and the marks above."""
    found = {c: c for c in _LETTERS + _LETTERS.lower()}
    found |= {unicodedata.name(d)[6:].lower(): d for d in "0123456789"}
    for size, letters in (("CAPITAL", _LETTERS), ("SMALL", _LETTERS.lower())):
        found |= {c + accent: _named(f"LATIN {size} LETTER {c.upper()} WITH {name}") for c in letters for accent, name in ACCENTS.items()}
        found |= {g if size == "CAPITAL" else g.lower(): _named(f"GREEK {size} LETTER {g.upper().replace('LAMBDA', 'LAMDA')}") for g in _GREEK}
    return {name: c for name, c in (found | MARKS).items() if c}


def encodings() -> list[tuple[str, int, str]]:
    """(encoding, code, character) of the two base encodings, from blank on."""
    out = []
    for name, codec in (("WinAnsiEncoding", "cp1252"), ("MacRomanEncoding", "mac_roman")):
        for code in (*range(32, 127), *range(128, 256)):
            c = bytes([code]).decode(codec, "ignore")
            out += [(name, code, "¤" if (codec, code) == ("mac_roman", 0xDB) else c)] if c else []
    return out
