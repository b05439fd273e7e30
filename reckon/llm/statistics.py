"""Statistics of whole texts, for the quality classifier (4) and the quality rules (8). Linear in the text."""

from __future__ import annotations

import numpy as np

from reckon.llm.common import ascii_words

#: The symbol characters counted by the quality rules.
SYMBOLS = "#*$%&|<>"
NAMES = (
    "log_words", "mean_word", "symbol_share", "other_punctuation", "upper_share", "digit_share", "space_share", "high_byte_share",
    "distinct_words", "top_word", "repeat_words", "repeat_lines", "words_per_line", "sentence_ends", "log_longest_word",
)
_BYTES = np.arange(256)
_IS = {
    "symbol": np.isin(_BYTES, [ord(c) for c in SYMBOLS]),
    "upper": (_BYTES >= 65) & (_BYTES <= 90),
    "digit": (_BYTES >= 48) & (_BYTES <= 57),
    "space": np.isin(_BYTES, [9, 10, 11, 12, 13, 32]),
    "high": _BYTES >= 128,
    "punctuation": np.isin(_BYTES, [ord(c) for c in "!\"'()+-/:;=?@[\\]^_`{}~"]),
}


def repeated_words(words: list[str]) -> int:
    """Words that lie in a three-word window found twice or more, each counted once, the first find included."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    _, at, count = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    twice = count[at] > 1
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def repeated_lines(lines: list[str]) -> tuple[int, int]:
    """Lines with a word, and how many of them equal an earlier line."""
    full = [x for x in lines if ascii_words(x)]
    return len(full), len(full) - len(set(full))


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = ascii_words(text)
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), repeated_lines(text.split("\n"))[1], repeated_words(words)


def byte_counts(text: str) -> np.ndarray:
    """How often each byte of the text's UTF-8 occurs."""
    return np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8), minlength=256)


def share(counts: np.ndarray, kind: str) -> float:
    return float(counts[_IS[kind]].sum()) / max(1, counts.sum())


def features(text: str) -> list[float]:
    """The classifier's inputs (NAMES), from the text alone; all 0 for a text without words."""
    words = ascii_words(text)
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    counts = byte_counts(text)
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines, again = repeated_lines(text.split("\n"))
    lengths = [len(w) for w in words]
    return [
        float(np.log1p(n)), sum(lengths) / n, *(share(counts, k) for k in ("symbol", "punctuation", "upper", "digit", "space", "high")),
        len(seen) / n, max(seen.values()) / n, repeated_words(words) / n, again / lines, n / lines, (counts[46] + counts[33] + counts[63]) / n, float(np.log1p(max(lengths))),
    ]
