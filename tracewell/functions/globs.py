"""Path globs as regular expressions: * and ? stop at /, ** crosses it, a pattern without / fits a name at any depth."""

from __future__ import annotations

import re


def glob_regex(pattern: str) -> str:
    """A regex, for whole paths, that Java, RE2 and Python read alike."""
    anywhere = "/" not in pattern.rstrip("/")
    pattern = pattern.strip("/")
    out, i = [], 0
    while i < len(pattern):
        rest = pattern[i:]
        if rest.startswith("**/"):
            out.append("(?:[^/]+/)*")
            i += 3
        elif rest == "**":
            out.append(".*")
            i += 2
        elif rest[0] == "*":
            out.append("[^/]*")
            i += 1
        elif rest[0] == "?":
            out.append("[^/]")
            i += 1
        elif rest[0] == "[" and "]" in rest[2:]:
            end = rest.index("]", 2)
            inner = rest[1:end].replace("\\", "\\\\")
            out.append("[" + ("^" + inner[1:] if inner[:1] == "!" else inner) + "]")
            i += end + 1
        else:
            out.append(re.escape(rest[0]))
            i += 1
    return ("^(?:.*/)?" if anywhere else "^") + "".join(out) + "(?:/.*)?$"
