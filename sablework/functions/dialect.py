"""From the linear-time regular expression dialect of policies to Java's, so that both find the same text."""

from __future__ import annotations

import re

from sablework.plans.policy import PolicyError

WORD = "0-9A-Za-z_"
#: ASCII word boundary, also inside case-insensitive patterns (where a class would take in U+212A and U+017F).
#: Spelled out, as Java looks a single character up in a table, but asks each range by itself.
_W = "".join(c for c in map(chr, range(128)) if re.match(f"[{WORD}]", c))
BOUNDARY = f"(?-iu:(?<![{_W}])(?=[{_W}])|(?<=[{_W}])(?![{_W}]))"
NO_BOUNDARY = f"(?-iu:(?<![{_W}])(?![{_W}])|(?<=[{_W}])(?=[{_W}]))"
#: What folding may take for an ASCII letter is among these.
BEYOND = r"\x{80}-\x{10FFFF}"
SPACE = r"\t\n\f\r "
# Named ASCII classes.
POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9",
    "graph": "!-~", "lower": "a-z", "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r ", "upper": "A-Z",
    "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
UNSUPPORTED = re.compile(r"\\[CGRXZkhHuUNKEMLlpP]|\\[1-9]")
#: An atom that matches ASCII digits only, at least once.
DIGITS = r"(?:\\d|\[[0-9](?:-[0-9]|[0-9])*\])"
REPEAT = r"(?:\{[1-9]\d*(?:,\d*)?\}|\+)?"


def _class(pattern: str, i: int, fold: bool) -> tuple[str, int]:
    """The Java form of the class that starts at i, and where it ends."""
    out, i = "[", i + 1
    if pattern[i : i + 1] == "^":
        out, i = out + "^", i + 1
    first, extra = True, ""
    while True:
        c = pattern[i : i + 1]
        if not c:
            raise PolicyError(f"missing ] in {pattern!r}")
        if c == "]" and not first:
            break
        first = False
        if m := re.match(r"\[:(\^?)(\w+):\]", pattern[i:]):
            if m[2] not in POSIX:
                raise PolicyError(f"unknown class [:{m[2]}:] in {pattern!r}")
            out += f"[^{POSIX[m[2]]}]" if m[1] else POSIX[m[2]]
            i += m.end()
            continue
        if m := re.match(r"\\[dDwW]|\\[pP](?:\{\^?\w+\}|\w)", pattern[i:]):
            out += _property(m[0], pattern) if m[0][1] in "pP" else m[0]
            i += m.end()
            continue
        if pattern.startswith(("\\s", "\\S"), i):
            out += SPACE if pattern[i + 1] == "s" else f"[^{SPACE}]"
            i += 2
            continue
        low, i = _single(pattern, i)
        high = low
        if pattern[i : i + 1] == "-" and pattern[i + 1 : i + 2] not in ("]", ""):
            high, i = _single(pattern, i + 1)
            out += f"{low}-{high}"
        else:
            out += low
        if fold:
            # Java's folding starts from the letters as written: give it the small ones too.
            a, z = (ord(x[-1]) if len(x) < 3 else -1 for x in (low, high))
            a, z = max(a, ord("A")), min(z, ord("Z"))
            if a <= z:
                extra += f"{chr(a).lower()}-{chr(z).lower()}"
    return out + extra + "]", i + 1


def _single(pattern: str, i: int) -> tuple[str, int]:
    if pattern[i] == "\\":
        if m := re.match(r"\\(?:x[0-9A-Fa-f]{2}|x\{[0-9A-Fa-f]+\}|[0-7]{3})", pattern[i:]):
            return (m[0] if m[0][1] == "x" else f"\\0{m[0][1:]}"), i + m.end()
        if pattern[i : i + 2] == "\\v":
            return r"\x0B", i + 2
        if i + 1 >= len(pattern):
            raise PolicyError(f"trailing \\ in {pattern!r}")
        return pattern[i : i + 2], i + 2
    return ("\\" + pattern[i] if pattern[i] in "[&^-" else pattern[i]), i + 1


def _property(token: str, pattern: str) -> str:
    name = token[2:].strip("{}")
    negate = (token[1] == "P") != name.startswith("^")
    name = name.lstrip("^")
    if not re.fullmatch(r"[A-Z][a-z]?|[A-Z][a-z_A-Z]{2,}", name):
        raise PolicyError(f"unknown property {token} in {pattern!r}")
    return f"\\{'P' if negate else 'p'}{{{name if len(name) < 3 else 'Is' + name}}}"


def to_java(pattern: str, case_insensitive: bool = False) -> str:
    """The Java pattern that finds what ``pattern`` finds; PolicyError where there is none."""
    fold = case_insensitive
    lead = re.match(r"\(\?([imsU]+)\)", pattern)
    flags = set(lead[1]) if lead else set()
    if "U" in flags:
        raise PolicyError(f"flag U isn't supported: {pattern!r}")
    fold = fold or "i" in flags
    body = pattern[lead.end() :] if lead else pattern
    out, i, depth = "", 0, 0
    while i < len(body):
        c = body[i]
        if c == "[":
            part, i = _class(body, i, fold)
            out += part
            continue
        if c == "\\":
            two = body[i : i + 2]
            if two in ("\\b", "\\B"):
                out += _boundary(body, i, fold) if two == "\\b" else NO_BOUNDARY
            elif two == "\\s":
                out += f"[{SPACE}]"
            elif two == "\\S":
                out += f"[^{SPACE}]"
            elif two == "\\Q":
                end = body.find("\\E", i)
                quoted = body[i + 2 : end if end >= 0 else None]
                out += "".join(quote(x) for x in quoted)
                i = end + 2 if end >= 0 else len(body)
                continue
            elif m := re.match(r"\\[pP](?:\{\^?\w+\}|\w)", body[i:]):
                out += _property(m[0], pattern)
                i += m.end()
                continue
            elif UNSUPPORTED.match(two):
                raise PolicyError(f"{two} isn't supported: {pattern!r}")
            elif two[1:] and two[1] in "dDwWAz":
                out += two
            else:
                part, i = _single(body, i)
                out += part
                continue
            i += 2
            continue
        if c == "(":
            depth += 1
            if m := re.match(r"\(\?P?<(\w+)>", body[i:]):
                out += f"(?<n{m[1].replace('_', 'x')}>"
                i += m.end()
                continue
            if m := re.match(r"\(\?([=!<>#P(])", body[i:]):
                raise PolicyError(f"{m[0]} isn't supported: {pattern!r}")
        if c == ")":
            depth -= 1
            if depth < 0:
                raise PolicyError(f"unexpected ) in {pattern!r}")
        if c == "$" and "m" not in flags:
            out += r"\z"
        elif c in "*+?}" and body[i + 1 : i + 2] == "+":
            raise PolicyError(f"{body[i : i + 2]} isn't supported: {pattern!r}")
        else:
            out += c
        i += 1
    if depth:
        raise PolicyError(f"missing ) in {pattern!r}")
    if re.search(r"(?:^|[(|])[*+?]", re.sub(r"\\.|\[[^\]]*\]|\(\?[^)>:]*[>:)]", "x", body)):
        raise PolicyError(f"nothing to repeat in {pattern!r}")
    return "(?d)" + ("(?iu)" if fold else "") + ("(?m)" if "m" in flags else "") + ("(?s)" if "s" in flags else "") + out


def _boundary(body: str, i: int, fold: bool) -> str:
    """A boundary beside an atom of digits needs one look only, and so does one before a word character. At the start of a pattern,
    what can't begin a match is told first by the next character, as most places fail there; elsewhere the general form."""
    if i == len(body) - 2 and re.search(rf"(?<!\\){DIGITS}{REPEAT}$", body[:i]):
        return f"(?-iu:(?![{_W}]))"
    first = _first(body[2:]) if i == 0 else None
    if not first:
        return BOUNDARY
    if fold:
        first |= {x for c in first for x in (c.lower(), c.upper())}
    folds = fold and any(c.isalpha() for c in first)
    look = "".join(c if c in _W else "\\" + c for c in sorted(first))
    if first <= set(_W):
        other = f"|(?=[{BEYOND}]){BOUNDARY}" if folds else ""
        return f"(?-iu:(?=[{look}])(?<![{_W}]){other})"
    return f"(?-iu:(?=[{look}{BEYOND if folds else ''}])){BOUNDARY}"


def _first(body: str) -> set[str] | None:
    """The ASCII characters of which one begins each match of a pattern, as it is written (not folded); None where that isn't plain to see."""
    alternatives, depth, at, i = [], 0, 0, 0
    while i < len(body):
        if m := re.match(r"\\.|\[\^?\]?(?:\[:\^?\w+:\]|\\.|[^\]\\])*\]", body[i:], re.DOTALL):
            i += m.end()
            continue
        depth += (body[i] == "(") - (body[i] == ")")
        if body[i] == "|" and not depth:
            alternatives.append(body[at:i])
            at = i + 1
        i += 1
    if alternatives:
        # What stands before this holds for the first alternative alone, unless there is a group around.
        return None
    out: set[str] = set()
    atom = re.compile(r"(\\d|[0-9A-Za-z]|\[[0-9A-Za-z_.%+]+(?:-[0-9A-Za-z_.%+]+)*(?:\\?-)?\])")
    i = 0
    while i < len(body):
        if m := atom.match(body, i):
            try:
                out |= {c for c in map(chr, range(128)) if re.match(m[0], c)}
            except re.error:
                return None
            i = m.end()
        elif m := re.compile(r"\((?:\?:|(?!\?))").match(body, i):
            inner, close = _group(body, m.end())
            parts = [_first(p) for p in inner]
            if close < 0 or not all(parts):
                return None
            out |= set().union(*parts)
            i = close + 1
        else:
            return None
        if not re.compile(r"[?*]|\{0").match(body, i):
            return out
        i = re.compile(r"(?:[?*]|\{[0-9,]*\})\??").match(body, i).end()
    return None


def _group(body: str, i: int) -> tuple[list[str], int]:
    """The alternatives of the group whose content begins at i, and the place of its closing bracket, or -1."""
    out, depth, at = [], 0, i
    while i < len(body):
        if m := re.match(r"\\.|\[\^?\]?(?:\[:\^?\w+:\]|\\.|[^\]\\])*\]", body[i:], re.DOTALL):
            i += m.end()
            continue
        if body[i] == ")" and not depth:
            return [*out, body[at:i]], i
        depth += (body[i] == "(") - (body[i] == ")")
        if body[i] == "|" and not depth:
            out.append(body[at:i])
            at = i + 1
        i += 1
    return out, -1


def quote(text: str) -> str:
    """A literal for both dialects."""
    return re.sub(r"([^0-9A-Za-z_\s\x80-\U0010FFFF])", r"\\\1", text)


def _parts(java: str) -> tuple[list[list[int]], list[int]]:
    """Groups of a Java pattern as [open, where its content begins, close, parent, whether it captures], and the places of bars."""
    groups, bars, stack, i, depth = [], [], [], 0, 0
    while i < len(java):
        c = java[i]
        if c == "\\":
            i += 2
            continue
        if c == "[":
            depth += 1
        elif c == "]" and depth:
            depth -= 1
        elif c == "(" and not depth:
            head = re.match(r"\((?:\?<[A-Za-z][A-Za-z0-9]*>|\?<?[=!]|\?[a-zA-Z-]*:|\?[a-zA-Z-]+(?=\)))?", java[i:])[0]
            groups.append([i, i + len(head), -1, stack[-1] if stack else -1, head == "(" or head.endswith(">")])
            stack.append(len(groups) - 1)
        elif c == ")" and not depth:
            groups[stack.pop()][2] = i
        elif c == "|" and not depth:
            bars.append(i)
        i += 1
    return groups, bars


def with_prefixes(java: str, group: int) -> tuple[str, list[int], int] | None:
    """The pattern with groups around what stands before ``group`` at each level of nesting: that pattern, the numbers of those groups
    and the number of the group itself. A match's group begins after the texts of those. None where there is no such group.

    A group that is repeated, or inside of something repeated, has no counterpart.
    """
    groups, bars = _parts(java)
    capturing = [i for i, g in enumerate(groups) if g[4]]
    if not 0 < group <= len(capturing):
        return None
    chain = [capturing[group - 1]]
    while groups[chain[0]][3] >= 0:
        chain.insert(0, groups[chain[0]][3])
    out, at, level_start, opens = "", 0, 0, []
    for i in chain:
        open_, inner, close = groups[i][:3]
        if java[close + 1 : close + 2] in ("*", "+", "{"):
            raise PolicyError(f"group {group} of {java!r} is repeated")
        if i != chain[-1] and re.match(r"\(\?<?[=!]", java[open_:]):
            raise PolicyError(f"group {group} of {java!r} looks around")
        inside = [b for b in bars if level_start <= b < open_ and not any(g[0] < b < g[2] and g[0] >= level_start for g in groups)]
        branch = max([level_start, *[b + 1 for b in inside]])
        # Flags hold to the end of their level, so they stay outside of the new group.
        flags = re.match(r"(?:\(\?[a-zA-Z-]+\))*", java[branch:open_])[0]
        if re.search(r"(?<!\\)\(\?[a-zA-Z-]+\)", java[branch + len(flags) : open_]):
            raise PolicyError(f"flags before group {group} of {java!r}")
        out += java[at : branch + len(flags)]
        opens.append(len(out))
        out += f"({java[branch + len(flags) : open_]})"
        own, at, level_start = len(out), inner, inner
        out += java[open_:inner]
    whole = out + java[at:]
    numbers = {g[0]: n for n, g in enumerate([g for g in _parts(whole)[0] if g[4]], 1)}
    return whole, [numbers[o] for o in opens], numbers[own]
