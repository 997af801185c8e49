"""Words, shingle hashes and word counts that several operators share."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words are runs of anything but these six: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SEPARATORS = " \t\n\x0b\x0c\r"

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX_1 = np.uint64(0xFF51AFD7ED558CCD)
_MIX_2 = np.uint64(0xC4CEB9FE1A85EC53)
_HALF = np.uint64(33)


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as empty. Stays in the JVM."""
    pieces = F.size(F.split(text, r"[\x20\x09-\x0D]+", -1))
    edges = (text.rlike(r"^[\x20\x09-\x0D]").cast("int") + text.rlike(r"[\x20\x09-\x0D]\z").cast("int"))
    return F.when(text.isNull() | (text == ""), F.lit(0)).otherwise(pieces - edges).cast("long")


def words(text: str | None) -> list[bytes]:
    """The words in order. bytes.split() parts at exactly the six separators."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lowered_words(text: str | None) -> list[bytes]:
    """The words with A-Z in lower case; other letters stay."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes(dict):
    """64-bit hash of each word, remembered while it fits."""

    LIMIT = 1 << 17

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


def mixed(values: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (a bijection)."""
    values = (values ^ (values >> _HALF)) * _MIX_1
    values = (values ^ (values >> _HALF)) * _MIX_2
    return values ^ (values >> _HALF)


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of `width` words; a text with fewer words has none."""
    count = len(hashes) - width + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for step in range(width):
        total = total * _ODD + (hashes[step : step + count] ^ np.uint64(step + 1))
        total ^= total >> np.uint64(29)
    return mixed(total)


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, as a lambda variable."""
    return F.element_at(F.transform(F.array(value), use), 1)
