"""Word-level byte-pair merging for vocabularies with a word-end mark.

The file holds (as JSON) a merge list in rank order. A text is normalised (NFC, lower case), cut at its special
strings, split into words by the file's pattern, and each word is turned into byte symbols, the last with the
word-end suffix. Words do not influence each other, so results are kept by white-space-separated chunk in a
bounded cache.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata

import regex

VOCABULARY = "word_bpe_49k.json"
#: Entries of a worker's chunk cache; beyond it the cache starts anew.
CACHE_ENTRIES = 400_000


def default_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 bytes are themselves, the others follow from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


def merged_length(symbols: list[str], rank: dict[tuple[str, str], int]) -> int:
    """Symbols left after merging the adjacent pair of lowest rank (leftmost first) until no pair has a rank.

    A heap holds candidate pairs as (rank, position); a doubly linked list over positions gives neighbours. An
    entry whose pair has changed since is skipped. No identifiers are made: initial symbols minus merges.
    """
    n = len(symbols)
    if n < 2:
        return n
    sym, left, right = list(symbols), list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(r, i) for i in range(n - 1) if (r := rank.get((sym[i], sym[i + 1]))) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        r, i = heapq.heappop(heap)
        if sym[i] is None or (j := right[i]) < 0 or rank.get((sym[i], sym[j])) != r:
            continue
        sym[i] += sym[j]
        sym[j] = None
        merges += 1
        right[i] = k = right[j]
        if k >= 0:
            left[k] = i
            if (r := rank.get((sym[i], sym[k]))) is not None:
                heapq.heappush(heap, (r, i))
        if (k := left[i]) >= 0 and (r := rank.get((sym[k], sym[i]))) is not None:
            heapq.heappush(heap, (r, k))
    return n - merges


class WordBpe:
    """Token counts of texts under one vocabulary file."""

    #: Text with only these characters needs no normalisation but lower case, and splits like str.split().
    plain = re.compile("[^\t-\r -\x84\x86-\x9f\xa1-ɏ]")

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        pairs = (m if isinstance(m, (list, tuple)) else m.split(" ") for m in model["merges"])
        self.rank = {(a, b): r for r, (a, b) in enumerate(pairs)}
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.split = regex.compile(next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.byte = byte_symbols()
        self.counts: dict[str, int] = {}

    def word(self, word: str) -> int:
        symbols = [self.byte[b] for b in word.encode("utf-8")]
        symbols[-1] += self.suffix
        return merged_length(symbols, self.rank)

    def chunk(self, chunk: str) -> int:
        if len(self.counts) >= CACHE_ENTRIES:
            self.counts.clear()
        n = self.counts[chunk] = sum(map(self.word, self.split.findall(chunk)))
        return n

    def count(self, text: str) -> int:
        if "<|" in text and self.special and self.special.search(text):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self.count, parts))
        if self.plain.search(text):
            text = "".join(map(str.lower, unicodedata.normalize("NFC", text)))
            return sum(map(self.word, self.split.findall(text)))
        get, chunk = self.counts.get, self.chunk
        return sum(n if (n := get(c)) is not None else chunk(c) for c in text.lower().split())


@functools.lru_cache(maxsize=4)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)
