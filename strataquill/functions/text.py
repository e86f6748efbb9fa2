"""Plain text helpers shared by operators: characters that look alike, one-width forms, small predicates."""

from __future__ import annotations

import re
import unicodedata

# Cyrillic and Greek letters drawn like Latin ones (as in the Unicode confusables data).
LOOKALIKE_FROM = "АВЕЅІЈКМНОРСТУХЗаеорсухіјѕԁһԛԝүΑΒΕΖΗΙΚΜΝΟΡΤΥΧογνιϲϳ"
LOOKALIKE_TO = "ABESIJKMHOPCTYX3aeopcyxijsdhqwyABEZHIKMNOPTYXoyvicj"

#: Characters that leave no mark on the page (default-ignorable code points in common use).
IGNORABLE = "­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ\U000e0000-\U000e0fff"
IGNORABLE_RE = re.compile(f"[{IGNORABLE}]")
LOOKALIKE_TABLE = {ord(a): ord(b) for a, b in zip(LOOKALIKE_FROM, LOOKALIKE_TO, strict=True)}


def plain(text: str) -> str:
    """Compatibility-composed form without invisible characters and with Latin look-alikes mapped to Latin."""
    if text.isascii():
        return text
    return IGNORABLE_RE.sub("", unicodedata.normalize("NFKC", text)).translate(LOOKALIKE_TABLE)
