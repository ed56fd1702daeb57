"""A five by seven dot font, so that a page's words can be drawn and read without a font file."""

from __future__ import annotations

import unicodedata

import numpy as np

#: Columns and rows of a character, a blank one at the right and at the bottom included.
WIDE, HIGH = 6, 9
# The printable ASCII characters from space on; five columns each, as hex bytes with the lowest bit at the top.
_DOTS = """
0000000000 00005f0000 0007000700 147f147f14 242a7f2a12 2313086462 3649562050 0008070300 001c224100 0041221c00 2a1c7f1c2a 08083e0808 0080703000 0808080808 0000606000 2010080402
3e5149453e 00427f4000 7249494946 2141494d33 1814127f10 2745454539 3c4a494931 4121110907 3649494936 464949291e 0000140000 0040340000 0008142241 1414141414 0041221408 0201590906
3e415d594e 7c1211127c 7f49494936 3e41414122 7f4141413e 7f49494941 7f09090901 3e41415173 7f0808087f 00417f4100 2040413f01 7f08142241 7f40404040 7f021c027f 7f0408107f 3e4141413e
7f09090906 3e4151215e 7f09192946 2649494932 03017f0103 3f4040403f 1f2040201f 3f4038403f 6314081463 0304780403 6159494d43 007f414141 0204081020 004141417f 0402010204 4040404040
0003070800 2054547840 7f28444438 3844444428 384444287f 3854545418 00087e0902 18a4a49c78 7f08040478 00447d4000 2040403d00 7f10284400 00417f4000 7c04780478 7c08040478 3844444438
fc18242418 18242418fc 7c08040408 4854545424 04043f4424 3c4040207c 1c2040201c 3c4030403c 4428102844 4c9090907c 4464544c44 0008364100 0000770000 0041360800 0201020402
""".split()
_GLYPHS = [np.unpackbits(np.frombuffer(bytes.fromhex(x), np.uint8)[None], axis=0, bitorder="little").astype(bool) for x in _DOTS]


def _base(c: str) -> str:
    """The letter under an accent; ligatures and typographic marks as what they stand for."""
    return unicodedata.normalize("NFKD", {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "•": "*"}.get(c, c))


def unknown(text: str) -> set[str]:
    """The characters of ``text`` that the font cannot show, accents apart."""
    return {c for c in text if not all(" " <= b <= "~" or unicodedata.combining(b) for b in _base(c))}


def dots(text: str) -> np.ndarray:
    """``text`` as HIGH rows of dots, WIDE for a character; an accent is two dots on top, an unknown character a frame."""
    out = np.zeros((HIGH, WIDE * max(1, len(text))), bool)
    for i, c in enumerate(text):
        cell, base = out[:, WIDE * i : WIDE * i + WIDE - 1], _base(c)
        if unknown(c):
            cell[[0, 7]] = cell[:8, [0, -1]] = True
            continue
        cell[:8] = _GLYPHS[ord(base[0]) - 32]
        if len(base) > 1:
            cell[0, [1, 3]] = True
    return out
