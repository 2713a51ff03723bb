"""Pre-tokens of byte-level BPE: the matches of the public pattern, found by the fastest engine that gives the same matches."""

from __future__ import annotations

import re
from functools import lru_cache

_LETTERS, _DIGITS, _SPACE = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
#: The public pattern with its classes written out for code points below 256, where Python's own ``re`` can be used.
_NARROW = re.compile(
    f"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^{_SPACE}{_LETTERS}{_DIGITS}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)


@lru_cache(maxsize=4)
def _wide(pattern: str):
    import regex

    return regex.compile(pattern)


@lru_cache(maxsize=4)
def _has_narrow(pattern: str) -> bool:
    import public_tokenizers

    return pattern == public_tokenizers.PATTERN


def pretokens(text: str, pattern: str) -> list[str]:
    """All matches of ``pattern``, in order; texts below code point 256 go by the narrow form if it is that of the public pattern."""
    if not _has_narrow(pattern):
        return _wide(pattern).findall(text)
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _wide(pattern).findall(text)
    return _NARROW.findall(text)
