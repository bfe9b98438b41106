"""The words of a text with all disguise set aside."""

from __future__ import annotations

import html
import re
import unicodedata
from urllib.parse import unquote

# Tags that stand within a line and do not part words.
_INLINE = "a|abbr|b|bdi|bdo|big|cite|code|del|dfn|em|font|i|ins|kbd|mark|q|s|samp|small|span|strike|strong|sub|sup|tt|u|var|wbr"
_INLINE_TAG = re.compile(rf"</?(?:{_INLINE})(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"<[A-Za-z/!?][^<>]*>")
_UNICODE_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})")
_ESCAPE = re.compile(r"\\+([nrtbfv]?)")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_SOFT_BREAK = re.compile(r"=\r?\n")
_JOINED = re.compile(r"(?<=[^\W_])(?:['’‘ʼ`´]|[-‐‑](?:[ \t]*\r?\n[ \t>]*)?)(?=[^\W_])")
_WORD = re.compile(r"[^\W_]+")


class _Hidden(dict):
    """Translation that drops what does not show: combining marks, format characters, controls."""

    def __missing__(self, code: int):
        kind = unicodedata.category(chr(code))
        hidden = kind in ("Mn", "Me", "Cf") or (kind == "Cc" and not chr(code).isspace())
        self[code] = None if hidden else code
        return self[code]


_HIDDEN = _Hidden()


def plain_words(text: str) -> list[str]:
    """Words in lower case without accents, markup, escapes, punctuation or hidden characters.

    An apostrophe or hyphen within a word joins its parts, a hyphen at a line's
    end too. Never fails; a text without letters and digits has no words.
    """
    if "\\" in text:
        text = _UNICODE_ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)), text)
        text = _ESCAPE.sub(lambda m: " " if m[1] else "", text)
    if "%" in text and ("%20" in text or "%0" in text):
        text = _PERCENT.sub(lambda m: unquote(m[0], errors="replace"), text)
    if "=" in text:
        text = _SOFT_BREAK.sub("", text)
    for _ in range(2):  # an escaped ampersand may itself be escaped
        if "&" not in text:
            break
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE_TAG.sub("", text))
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(_HIDDEN)
    return _WORD.findall(_JOINED.sub("", text.casefold()))
