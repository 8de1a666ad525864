"""Splitting a text where a byte-level BPE vocabulary is split before its merges."""

from __future__ import annotations

import re

import public_tokenizers
import regex

_ANY = regex.compile(public_tokenizers.PATTERN)
# the same classes spelled out below U+0250, where the standard library's matcher is twice as fast
_LETTERS, _DIGITS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
_LATIN = re.compile(
    rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^\s{_LETTERS}{_DIGITS}]+|\s+(?!\S)|\s+"
)
_BEYOND = re.compile("[^\x00-\x1b\x20-ɏ]")  # U+001C to U+001F: white space to one matcher only


def pretokens(text: str) -> list[str]:
    """All matches of ``public_tokenizers.PATTERN``; together they are the whole text."""
    return (_ANY if _BEYOND.search(text) else _LATIN).findall(text)
