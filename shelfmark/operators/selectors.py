"""Structural selectors as predicates over the `elements` table.

A selector is a chain of compounds, `tag#id.class[attr='v']`, joined by a blank
(descendant) or `>` (child). Attribute tests are `[a]`, `=`, `*=`, `^=`, `$=` and
`~=`, with `i` for any case; a backslash quotes a sign in a name. Anything else
raises `ValueError`. An element carries its ancestors in order, with their
names and attributes, so a chain is decided on its row, without a join. Any
element can be an ancestor; the last compound finds the elements that have rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F

from shelfmark.functions import text as T

_NAME = r"(?:[\w\-]|\\.)+"
_COMPOUND = re.compile(rf"(\*|[a-zA-Z][\w\-]*)?((?:[#.]{_NAME})*)((?:\[[^\]]+\])*)")
_TEST = re.compile(r"\[\s*([\w:\-]+)\s*(?:([*^$~]?=)\s*(?:'([^']*)'|\"([^\"]*)\"|([^\s'\"\]]+))\s*(i)?\s*)?\]")


def steps(selector: str) -> list[tuple[str, str]]:
    """(combinator, compound) pairs, outermost first; the first combinator is a blank."""
    out, combinator = [], " "
    for piece in re.findall(r">|(?:[^\s>\[]|\[[^\]]*\])+", selector.strip()):
        if piece != ">":
            out.append((combinator, piece))
            combinator = " "
        elif combinator == ">" or not out:
            raise ValueError(f"unsupported selector: {selector}")
        else:
            combinator = ">"
    if not out or combinator == ">":
        raise ValueError(f"unsupported selector: {selector}")
    return out


def _compound(selector: str, field: Callable[[str], Column]) -> Column:
    """Whether the element whose columns `field` gives meets one compound."""
    found = _COMPOUND.fullmatch(selector)
    if not found or not selector:
        raise ValueError(f"unsupported selector: {selector}")
    out = ~F.startswith(field("tag"), F.lit("#"))  # rows of failed pages are no elements
    if found[1] and found[1] != "*":
        out = field("tag") == found[1].lower()
    for mark in re.findall(rf"[#.]{_NAME}", found[2]):
        name = mark[1:].replace("\\", "")
        out = out & ((field("id") == name) if mark[0] == "#" else F.array_contains(field("classes"), name))
    for raw in re.findall(r"\[[^\]]+\]", found[3]):
        test = _TEST.fullmatch(raw)
        if not test:
            raise ValueError(f"unsupported selector: {selector}")
        out = out & _attribute(field("attrs")[test[1].lower()], test[2], test[3] or test[4] or test[5] or "", bool(test[6]))
    return F.coalesce(out, F.lit(False))


def _attribute(attr: Column, op: str | None, value: str, any_case: bool) -> Column:
    if op is None:
        return attr.isNotNull()
    if any_case:
        attr, value = F.lower(attr), value.lower()
    if op == "=":
        return attr == value
    if value == "":  # parts that are empty match nothing
        return F.lit(False)
    if op == "~=":
        return F.array_contains(F.split(attr, r"\s+"), value)
    test = {"*=": F.contains, "^=": F.startswith, "$=": F.endswith}[op]
    return test(attr, F.lit(value))


def _positions(chain: list[tuple[str, str]], use: Callable[[Column], Column]) -> Column:
    """`use` of the indices in `above` at which a chain can end, all compounds before it being met further out."""
    def at(k: int, before: Column | None) -> Column:
        combinator, compound = chain[k]

        def allowed(i: Column) -> Column:
            if before is None:
                return i.isNotNull()
            return F.array_contains(before, i - 1) if combinator == ">" else i > F.array_min(before)

        met = F.transform("above", lambda a, i: F.when(_compound(compound, lambda name: a[name]), i))
        found = F.filter(met, lambda i: i.isNotNull() & F.coalesce(allowed(i), F.lit(False)))
        return T.let(found, (lambda s: at(k + 1, s)) if k + 1 < len(chain) else use)

    return at(0, None)


def matches(selector: str) -> Column:
    """Whether a row of `elements` meets the selector."""
    *outer, (combinator, last) = steps(selector)
    own = _compound(last, F.col)
    if not outer:
        return own
    if len(outer) == 1 and combinator == " ":
        return own & F.exists("above", lambda a: _compound(outer[0][1], lambda name: a[name]))
    if combinator == ">":
        return own & _positions(outer, lambda s: F.array_contains(s, F.size("above") - 1))
    return own & _positions(outer, lambda s: F.size(s) > 0)


def ancestors(selector: str) -> Column:
    """The `pos` of every ancestor that meets the selector, outermost first."""
    return _positions(steps(selector), lambda s: F.transform(s, lambda i: F.get(F.col("above"), i)["pos"]))
