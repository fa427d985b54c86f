"""Cuts texts into the pieces that the byte-level tokenizers treat on their own.

`SYMBOLS` holds for every text. `WORD_PIECES` and `RUNS` hold where all characters are plain
(Latin letters, digits, common punctuation), since letters and digits are simple ranges there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
DIGITS = "0-9²³¹¼-¾"
BLANKS = "\t-\r \x85\xa0"
#: All characters with the Unicode property White_Space.
SPACES = BLANKS + "\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
NOT_PLAIN = re.compile("[^\x00-\x1b\x20-ɏ‐-‧]")
CONTRACTIONS = "'(?:s|t|re|ve|m|ll|d)"

#: Pieces of the lower-cased text for the tokenizer with word ends: white space is dropped.
WORD_PIECES = re.compile(
    f"{CONTRACTIONS}|[{LETTERS}]+|[{DIGITS}]|[^{BLANKS}{LETTERS}{DIGITS}]+")

#: Runs of one kind inside a word, for the byte-level tokenizer.
RUNS = re.compile(
    f"{CONTRACTIONS}[{LETTERS}]*|[{LETTERS}]+|[{DIGITS}]+|[^{BLANKS}{LETTERS}{DIGITS}]+")

#: Words, each with the space behind it if just one stands there; or runs of white space.
SYMBOLS = re.compile(f"[^{SPACES}]+(?: (?![{SPACES}]|\\Z))?|[{SPACES}]+")
BLANK = re.compile(f"[{SPACES}]")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1
    letters for themselves, the others in turn from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_LETTERS = byte_letters()


def spelled(text: str) -> str:
    """The UTF-8 bytes of the text in the letters of byte-level vocabularies."""
    return text.encode().decode("latin-1").translate(BYTE_LETTERS)


def is_plain(text: str, specials: tuple[str, ...]) -> bool:
    return NOT_PLAIN.search(text) is None and not any(s in text for s in specials)


def slices(text: str, limit: int) -> Iterator[str]:
    """The text in slices of about `limit` characters, each cut before a single space.

    A slice ends after a character that is not white space and the next one starts with the
    space; where no such place follows, the slice runs on to the end.
    """
    start, n = 0, len(text)
    while n - start > limit:
        at = text.find(" ", start + limit)
        while at > 0 and text[at - 1].isspace():
            at = text.find(" ", at + 1)
        if at < 0:
            break
        yield text[start:at]
        start = at
    yield text[start:]
