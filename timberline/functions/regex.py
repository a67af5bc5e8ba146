"""Query regexes for Java's engine.

Queries are written for an engine with linear time: classes are Unicode-aware, a
dot excludes only a line feed, and $ is the very end of the text. Constructs
that such an engine lacks are refused.
"""

from __future__ import annotations

import re


class RegexProblem(ValueError):
    """A pattern that the query language does not have."""


_REFUSED = ("(?=", "(?!", "(?<=", "(?<!", "(?>")


def translated(pattern: str) -> str:
    """The pattern for Java, with the flags that make it mean the same."""
    out, i, n, in_class = [], 0, len(pattern), 0
    while i < n:
        c = pattern[i]
        if c == "\\":
            if i + 1 >= n:
                raise RegexProblem("trailing backslash")
            e = pattern[i + 1]
            if e.isdigit() or e in "kGRXZ":
                raise RegexProblem(f"\\{e} is not supported")
            out.append("\\z" if e == "z" else pattern[i : i + 2])
            i += 2
            continue
        if in_class:
            in_class += (c == "[") - (c == "]")
        elif c == "[":
            in_class = 1
            # a bracket first in a class is itself
            j = i + 1 + (pattern[i + 1 : i + 2] == "^")
            if pattern[j : j + 1] == "]":
                out.append(pattern[i:j] + "\\]")
                i = j + 1
                continue
        elif c == "(" and any(pattern.startswith(x, i) for x in _REFUSED):
            raise RegexProblem("look-around is not supported")
        elif c == "(" and pattern.startswith("(?P<", i):
            out.append("(?<")
            i += 4
            continue
        elif c == "$":
            out.append("\\z")
            i += 1
            continue
        elif c in "*+?}" and pattern[i + 1 : i + 2] == "+":
            raise RegexProblem("possessive quantifiers are not supported")
        out.append(c)
        i += 1
    java = "".join(out)
    try:  # what no engine accepts is refused here, before any job runs
        re.compile(re.sub(r"\\z", r"\\Z", java.replace("(?<", "(?P<")) if "\\p" not in java and "[:" not in java and "&&" not in java else "")
    except re.error as e:
        raise RegexProblem(f"invalid regex: {e}") from e
    return java


def unanchored(pattern: str) -> str:
    return f"(?dU){translated(pattern)}"


def anchored(pattern: str) -> str:
    return f"(?dU)\\A(?:{translated(pattern)})\\z"
