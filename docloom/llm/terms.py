"""Terms of texts: maximal runs of ASCII letters, digits and characters beyond ASCII; A-Z lower-cased."""

from __future__ import annotations

import numpy as np

from .hashing import word_lists

#: All other bytes become blanks; those beyond ASCII are parts of such characters.
_TABLE = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def term_lists(texts: list[str | None]) -> list[np.ndarray]:
    """Of each text the 64-bit hashes of its terms, in order. Null has none."""
    return word_lists([(t or "").encode().translate(_TABLE).decode() for t in texts])


def term_counts(texts: list[str | None]) -> list[int]:
    """The number of terms of each text."""
    out = []
    for t in texts:
        b = np.frombuffer(b" " + (t or "").encode().translate(_TABLE), np.uint8) != 0x20
        out.append(int((b[1:] & ~b[:-1]).sum()))
    return out
