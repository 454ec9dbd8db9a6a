"""Words that a pattern cannot match without, so that most texts need no regular expression."""

from __future__ import annotations

from collections.abc import Iterable
from re._constants import ASSERT, ASSERT_NOT, AT, BRANCH, IN, LITERAL, MAX_REPEAT, MIN_REPEAT, SUBPATTERN
from re._parser import parse

_MOST_FORMS = 64


def _forms(op: object, arg: object) -> list[str] | None:
    """All that one item of a parsed pattern matches, if that is a short list."""
    if op is LITERAL:
        return [chr(arg)]
    if op is IN and all(kind is LITERAL for kind, _ in arg):
        return [chr(c) for _, c in arg]
    if op in (AT, ASSERT, ASSERT_NOT):
        return [""]
    if op is MAX_REPEAT and tuple(arg[:2]) == (0, 1):
        items = [arg[2]]
    elif op is SUBPATTERN:
        items = [arg[3]]
    elif op is BRANCH:
        items = arg[1]
    else:
        return None
    out = [""] if op is MAX_REPEAT else []
    for item in items:
        whole = [""]
        for part in item:
            forms = _forms(*part)
            if forms is None or len(whole) * len(forms) > _MOST_FORMS:
                return None
            whole = [a + b for a in whole for b in forms]
        out += whole
    return out if len(out) <= _MOST_FORMS else None


def _needed(pattern: Iterable) -> list[str]:
    """Words of which every match of a parsed pattern holds one: of such lists, that with the longest shortest word. Empty if there is none."""
    best: list[str] = []

    def offer(words: list[str]) -> None:
        nonlocal best
        if words and min(map(len, words)) > min(map(len, best), default=0):
            best = words

    run = [""]
    for op, arg in pattern:
        forms = _forms(op, arg)
        if forms is not None and len(run) * len(forms) <= _MOST_FORMS:
            run = [a + b for a in run for b in forms]
            continue
        offer(run)
        run = forms or [""]
        if forms is not None:
            continue
        if op is SUBPATTERN:
            offer(_needed(arg[3]))
        elif op is BRANCH:
            each = [_needed(item) for item in arg[1]]
            offer([w for words in each for w in words] if all(each) else [])
        elif op in (MAX_REPEAT, MIN_REPEAT) and arg[0] > 0:
            offer(_needed(arg[2]))
    offer(run)
    return best


def needed_words(pattern: str) -> list[str]:
    """Words of which every match of ``pattern`` holds one. A pattern without such words is an error."""
    words = _needed(parse(pattern))
    if not words:
        raise ValueError(f"no word that each match of {pattern!r} has")
    return words
