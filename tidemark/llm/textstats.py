"""Per-document statistics in numpy, for the quality operators. Whole texts, one document at a time."""

from __future__ import annotations

import numpy as np

SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"
_MULT = np.uint64(0x9E3779B97F4A7C15)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_ids(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers, in order of first sight."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def window_codes(ids: np.ndarray, size: int) -> np.ndarray:
    """Exact numbers of the windows of ``size`` (a power of two) words: equal if the windows are."""
    codes, width = ids, 1
    while width < size and len(codes) > width:
        pair = codes[:-width] * np.int64(len(ids) + 1) + codes[width:]
        codes = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        width *= 2
    return codes if width == size else np.zeros(0, np.int64)


def repeated_words(words: list[bytes], size: int = 8) -> int:
    """Words that lie in a window of ``size`` words found twice or more in the text."""
    if len(words) <= size:
        return 0
    codes = window_codes(word_ids(words), size)
    if not len(codes):
        return 0
    twice = np.bincount(codes)[codes] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[: len(codes)] += twice
    edge[size : size + len(codes)] -= twice
    return int((np.cumsum(edge[:-1]) > 0).sum())


def duplicate_lines(text: str) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    return len(lines), len(lines) - len(set(lines))


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode("utf-8", "surrogatepass").split()
    return (
        len(words),
        len(text) - sum(map(text.count, _SPACES)),
        sum(map(text.count, SYMBOLS)),
        duplicate_lines(text)[1],
        repeated_words(words),
    )


NAMES = (
    "log_words", "mean_word", "sd_word", "distinct_words", "top_word", "ends_marked", "starts_upper", "no_letter",
    "upper", "digit", "letter", "symbol", "bang", "pipe", "stop", "comma", "other_mark", "byte_entropy",
    "log_lines", "mean_line", "dup_lines", "repeat_words", "distinct_pairs",
)


def features(text: str) -> np.ndarray:
    """The numbers of NAMES for one text; all zero for a text without words."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    out = np.zeros(len(NAMES))
    if not words:
        return out
    n = len(words)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(float)
    ink = counts.sum() - counts[[32, 9, 10, 11, 12, 13]].sum()
    size = np.fromiter(map(len, words), np.int64, n)
    ids = word_ids(words)
    often = np.bincount(ids)
    pairs = np.unique(ids[:-1] * np.int64(n) + ids[1:]).size if n > 1 else 1
    lines, dup = duplicate_lines(text)
    joined = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum(size) - 1
    first, last = joined[ends - size + 1], joined[ends]
    lettered = np.add.reduceat(_LETTER[joined].astype(np.int64), ends - size + 1)
    share = counts[counts > 0] / counts.sum()
    letters = counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()
    symbols = counts[[ord(c) for c in SYMBOLS if c != "|"]].sum()
    out[:] = (
        np.log1p(n), size.mean(), size.std(), len(often) / n, often.max() / n, (~_LETTER[last]).mean(),
        ((first >= 65) & (first <= 90)).mean(), (lettered == 0).mean(), counts[65:91].sum() / ink, counts[48:58].sum() / ink,
        letters / ink, symbols / ink, counts[33] / ink, counts[124] / ink, counts[46] / ink, counts[44] / ink,
        (ink - letters - counts[48:58].sum() - symbols - counts[[33, 124, 46, 44]].sum()) / ink, -(share * np.log2(share)).sum(),
        np.log1p(lines), n / max(lines, 1), dup / max(lines, 1), repeated_words(words) / n, pairs / max(n - 1, 1),
    )
    return out
