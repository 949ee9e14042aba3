"""Words of a text for comparing passages: case, punctuation, markup, white space and invisible characters are gone."""

from __future__ import annotations

import html
import re
import unicodedata

_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿￹-￻]")
_COMMENT = re.compile(r"<!--.*?-->", re.S)
_INLINE = re.compile(r"</?(?:a|abbr|b|code|del|em|font|i|ins|kbd|mark|q|s|small|span|strong|sub|sup|tt|u|var)(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"</?[a-z!][^<>]*>", re.I)
_LINK = re.compile(r"!?\[([^\]\[]*)\]\((?:[^()\s]|\([^()]*\))*(?:\s+\"[^\"]*\")?\)")
_MARKS = re.compile("[*`~'‘’ʼ´]")
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """The words of a text in lower case and without diacritics, markup left out."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", _COMMENT.sub(" ", text)))
    if "](" in text:
        text = _LINK.sub(r"\1", text)
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return _WORD.findall(_MARKS.sub("", text).casefold())
