"""A subset of regular expressions whose matching takes time in proportion to the text.

Allowed are literals, ``^``, ``$``, ``.``, character classes, escapes and a fixed count ``{n}`` up to 64. Groups,
alternatives, open repetition, back references and Unicode property escapes are not.
"""

from __future__ import annotations

import re

MOST_SIGNS = 256
MOST_REPEATS = 64
#: One allowed element, and whether it may be repeated.
_ELEMENT = re.compile(
    r"""(?P<bad>\\(?:[1-9k]|[pP]\{|u\{)|[()|*+?}])
      | (?P<repeatable>\\[^bB]|\[(?:\\.|[^\]\\])*\]|[^\\\[{^$])
      | (?P<anchor>\\[bB]|[\^$])
      | (?P<count>\{(?P<n>\d{1,2})\})""",
    re.X | re.S,
)


class RegexRejected(ValueError):
    """The pattern is outside the safe subset."""


def safe_pattern(pattern: str) -> str:
    """The pattern for Spark's ``rlike``, with Unicode classes; raises ``RegexRejected`` for any other."""
    if len(pattern) > MOST_SIGNS:
        raise RegexRejected(f"longer than {MOST_SIGNS}")
    at, repeatable = 0, False
    while at < len(pattern):
        m = _ELEMENT.match(pattern, at)
        if not m or m.lastgroup is None:
            raise RegexRejected(f"not understood at {at}")
        if m.group("bad"):
            raise RegexRejected(f"{m.group()} is not allowed")
        if m.group("count"):
            if not repeatable:
                raise RegexRejected("a count needs something to repeat")
            if int(m.group("n")) > MOST_REPEATS:
                raise RegexRejected(f"more than {MOST_REPEATS} repeats")
            repeatable = False
        else:
            repeatable = m.group("repeatable") is not None
        at = m.end()
    try:
        re.compile(pattern)
    except re.error as e:
        raise RegexRejected(str(e)) from e
    return "(?U)" + pattern
