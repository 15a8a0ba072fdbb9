"""Which encoding a file is in, by its byte-order mark or by the byte pairs that East Asian encodings are made of.

A pair is frequent in an encoding if its first byte is in the rows of that standard's everyday characters; an encoding's
score is the share of the sample's bytes beyond ASCII in such pairs, less those in no valid pair.  What is decoded is only
accepted if enough of it is CJK; otherwise GB 18030 and UTF-8 are tried by force, and at last UTF-8 with replacements.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

#: Code points that count as CJK, characters of a text and bytes of a file that are looked at, and the least
#: shares for a detected encoding and for a forced one.
CJK = (("一", "鿿"), ("㐀", "䶿"))
SAMPLE_CHARS, SAMPLE_BYTES = 3000, 50_000
ACCEPTED, FORCED = 0.15, 0.10
#: Per encoding the valid first and second bytes of a pair, and the first bytes of everyday characters.
_PAIRS = {
    "gb18030": (((0x81, 0xFE),), ((0x40, 0x7E), (0x80, 0xFE)), ((0xB0, 0xD7), (0xA1, 0xA3))),
    "big5": (((0x81, 0xFE),), ((0x40, 0x7E), (0xA1, 0xFE)), ((0xA4, 0xC6), (0xA1, 0xA1))),
    "shift_jis": (((0x81, 0x9F), (0xE0, 0xFC)), ((0x40, 0x7E), (0x80, 0xFC)), ((0x82, 0x83), (0x88, 0x97))),
    "euc_kr": (((0xA1, 0xFE),), ((0xA1, 0xFE),), ((0xB0, 0xC8),)),
}


def _in(ranges: tuple[tuple[int, int], ...]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


_TABLES = {name: tuple(map(_in, parts)) for name, parts in _PAIRS.items()}


def pair_score(data: bytes, name: str) -> float:
    """Bytes beyond ASCII that are in everyday pairs of the encoding, less twice those in no pair, as a share; pairs are read
    one after another as a decoder does."""
    first, second, everyday = _TABLES[name]
    good = bad = at = 0
    high = [i for i in np.flatnonzero(np.frombuffer(data, np.uint8) >= 0x80).tolist()]
    for i in high:
        if i < at:
            continue
        if first[data[i]] and i + 1 < len(data) and second[data[i + 1]]:
            # in EUC encodings everyday characters have a high second byte too
            good += 2 * bool(everyday[data[i]] and (name not in ("gb18030", "euc_kr") or data[i + 1] >= 0xA1))
            at = i + 2
        elif i + 1 < len(data):
            bad += 1
    return (good - 2 * bad) / max(len(high), 1)


def cjk_ratio(text: str, sample: int = SAMPLE_CHARS) -> float:
    """Share of CJK characters among the first characters, without blanks and line ends; 0 for an empty text."""
    s = text[:sample].translate({0x20: None, 0x0A: None, 0x0D: None})
    return sum(any(a <= c <= b for a, b in CJK) for c in s) / len(s) if s else 0.0


def cjk_share(text: Column, sample: int = SAMPLE_CHARS) -> Column:
    """``cjk_ratio`` of a string column."""
    s = F.translate(F.left(text, F.lit(sample)), " \n\r", "")
    ranges = "".join(f"{a}-{b}" for a, b in CJK)
    return F.when(F.length(s) > 0, F.regexp_count(s, F.lit(f"[{ranges}]")) / F.length(s)).otherwise(0.0)


def _everyday(c: str) -> bool:
    """Whether a character is ASCII or in the everyday rows of the simplified or the traditional standard."""
    return c < "\x80" or any((pair := c.encode(name, "ignore")) and _TABLES[table][2][pair[0]] for name, table in (("gb2312", "gb18030"), ("big5", "big5")))


def detected(data: bytes) -> str | None:
    """The encoding whose byte pairs fit best; UTF-8 if that decodes the sample; null if nothing fits."""
    sample = data[:SAMPLE_BYTES]
    try:
        sample.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError as e:
        if e.start >= len(sample) - 3 and e.reason == "unexpected end of data":  # the sample cuts a character
            return "utf-8"
    if 0 in sample and len(data) % 2 == 0:  # zeros of ASCII characters
        for name in ("utf-16-le", "utf-16-be"):
            text = sample.decode(name, "replace")
            if cjk_ratio(text) >= ACCEPTED and sum(map(_everyday, text)) >= 0.8 * len(text):
                return name
    # the everyday rows of Korean are some of those of Chinese: it goes first where both fit
    score, name = max((pair_score(sample, n) + 0.05 * (n == "euc_kr"), -i, n) for i, n in enumerate(_PAIRS))[::2]
    return name if score > 0.3 else None


def read(data: bytes) -> tuple[str, str, float]:
    """(text, encoding, CJK share)."""
    for mark, codec, name in ((b"\xef\xbb\xbf", "utf-8-sig", "utf-8-bom"), (b"\xff\xfe", "utf-16", "utf-16"), (b"\xfe\xff", "utf-16", "utf-16")):
        if data.startswith(mark):
            text = data.decode(codec, "replace")
            return text, name, cjk_ratio(text)
    if name := detected(data):
        text = data.decode(name, "replace")
        if (ratio := cjk_ratio(text)) >= ACCEPTED:
            return text, name, ratio
    for name in ("gb18030", "utf-8"):
        if (ratio := cjk_ratio(data[:SAMPLE_BYTES].decode(name, "ignore"))) >= FORCED:
            return data.decode(name, "ignore"), f"{name}-forced", ratio
    text = data.decode("utf-8", "replace")
    return text, "utf-8-replace", cjk_ratio(text)


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("encoding", StringType()), StructField("cjk_ratio", DoubleType())]))
def read_text(contents: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """``read`` of a binary column; a null gives a null text without an encoding."""
    for data in contents:
        yield pd.DataFrame([(None, None, None) if d is None else read(d) for d in data], columns=["text", "encoding", "cjk_ratio"])
