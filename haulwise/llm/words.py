"""Words of a text as the byte strings that several operators share."""

from __future__ import annotations

# ASCII other than letters and digits separates words, A-Z count as a-z, everything beyond ASCII belongs to a word.
_TO_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    """The words of a text; none for NULL."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()
