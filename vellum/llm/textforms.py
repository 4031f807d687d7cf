"""Character forms shared by the text operators, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_ASCII = "".join(chr(c) for c in range(0x21, 0x7F))
_BLANKS = "  " + "".join(chr(c) for c in range(0x2000, 0x200B)) + "  　\t\r\n\f\v"
_UNSEEN = "​‌‍⁠﻿­‎‏"


def half_width(c: Column) -> Column:
    """Full-width forms as ASCII, every blank as a space, unseen characters dropped."""
    return F.translate(c, _WIDE + _BLANKS + _UNSEEN, _ASCII + " " * len(_BLANKS))


def json_text(payload: Column) -> Column:
    """The text of a chunk's payload; null where the payload is no JSON object with a text."""
    return F.get_json_object(payload, "$.text")
