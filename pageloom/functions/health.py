"""The measure of encoding health for Python strings, for the codec repair."""

from __future__ import annotations

import re
import unicodedata

from .quality import MOJIBAKE

_BAD = [re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), p)) for p in MOJIBAKE]


def encoding_health(text: str) -> float:
    if not text:
        return 1.0
    bad = sum(len(p.findall(text)) for p in _BAD) + text.count("\ufffd") + sum(unicodedata.category(c) == "Co" for c in text)
    return max(0.0, 1.0 - 3.0 * bad / len(text))
