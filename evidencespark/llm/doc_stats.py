"""Per-document text statistics for the quality classifier.

Each statistic is computed from the whole text and squashed by a log or a smoothed log-ratio, so that
the values of one class lie near a Gaussian. A null text counts as an empty one; an empty text gets the
finite values that the smoothing alone yields.
"""

from __future__ import annotations

import numpy as np

FEATURES = (
    "words", "word_length", "upper", "digits", "stops", "symbols", "lines", "distinct",
    "repeated_lines", "short_words", "longest_word", "non_ascii", "entropy", "top_word", "marked_words",
)

_STOPS = np.frombuffer(b".,;:?!'\"()-", dtype=np.uint8)
_SYMBOLS = np.frombuffer(b"#$%&*@^~|<>{}[]\\/=+_`", dtype=np.uint8)


#: Pseudo-observations at a plain-prose share: they keep the ratios of a text of a few words near those of prose.
PRIOR_CHARS, PRIOR_WORDS = 100.0, 20.0


def _ratio(part: float, whole: float, share: float, weight: float) -> float:
    """log odds of part in whole, smoothed by weight pseudo-observations of which share count as part."""
    return float(np.log((part + weight * share) / (max(whole - part, 0.0) + weight * (1 - share))))


def text_statistics(text: str | None) -> list[float]:
    """The values of FEATURES for one text."""
    data = (text or "").encode("utf-8", "replace")
    hist = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    n = len(data)
    words = data.split()
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in data.split(b"\n") if x.strip()]
    seen: set[bytes] = set()
    repeated = 0
    for x in lines:
        if x in seen:
            repeated += len(x)
        seen.add(x)
    upper, lower = int(hist[65:91].sum()), int(hist[97:123].sum())
    p = hist[hist > 0] / max(n, 1)
    symbols = int(hist[_SYMBOLS].sum())
    k = len(words)
    marked = sum(1 for w in words if w[-1] < 128 and not w[-1:].isalnum())
    return [
        float(np.log1p(k)),
        float(np.log((lengths.sum() + 5 * PRIOR_WORDS) / (k + PRIOR_WORDS))),
        _ratio(upper, upper + lower, 0.03, PRIOR_CHARS),
        _ratio(int(hist[48:58].sum()), n, 0.01, PRIOR_CHARS),
        _ratio(int(hist[_STOPS].sum()), n, 0.02, PRIOR_CHARS),
        _ratio(symbols, n, 0.005, PRIOR_CHARS),
        _ratio(len(lines), k + len(lines), 0.02, PRIOR_WORDS),
        _ratio(len(counts), k, 0.8, PRIOR_WORDS),
        _ratio(repeated, n, 0.01, PRIOR_CHARS),
        _ratio(int((lengths <= 3).sum()), k, 0.3, PRIOR_WORDS),
        float(np.log((lengths.max() if k else 0) + 10.0)),
        _ratio(int(hist[128:].sum()), n, 0.02, PRIOR_CHARS),
        (n * float(-(p * np.log2(p)).sum()) + PRIOR_CHARS * 4.2) / (n + PRIOR_CHARS),
        _ratio(max(counts.values(), default=0), k, 0.08, PRIOR_WORDS),
        _ratio(marked, k, 0.15, PRIOR_WORDS),
    ]
