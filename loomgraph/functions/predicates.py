"""Include/exclude filters and composable filter expressions, compiled to one Column each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions.text import clean_url, glob_regex, query_value

FALSE = F.lit


def _any(conds: list[Column]) -> Column:
    out = F.lit(False)
    for c in conds:
        out = out | F.coalesce(c, F.lit(False))
    return out


def pattern_filter(c: Column, include: list[str], exclude: list[str], cwd: str | None = None) -> Column:
    """Globs: an exclusion decides, then an inclusion; without either, true unless there are inclusions."""
    match = lambda globs: _any([c.rlike(glob_regex(g, cwd)) for g in globs])
    return F.when(match(exclude), False).when(match(include), True).otherwise(F.lit(not include))


def code_filter(c: Column, include: list[str], exclude: list[str]) -> Column:
    """The same for substrings (or /regular expressions/) of a text."""
    one = lambda p: c.rlike(p[1:-1]) if len(p) > 1 and p[0] == p[-1] == "/" else c.contains(p)
    return F.when(_any([one(p) for p in exclude]), False).when(_any([one(p) for p in include]), True).otherwise(F.lit(not include))


def ordered_filter(items: list[tuple[str, Column]]) -> Column:
    """The first item that matches decides; else true if no item includes."""
    out = F.lit(not any(k == "include" for k, _ in items))
    for kind, cond in reversed(items):
        out = F.when(F.coalesce(cond, F.lit(False)), F.lit(kind == "include")).otherwise(out)
    return out


@dataclass
class Inputs:
    """What an expression looks at; an input that is None makes its leaves false."""

    id: Column | None = None
    importer: Column | None = None
    code: Column | None = None
    module_type: Column | None = None


def parse(tokens: list) -> tuple:
    """Postfix tokens to a tree: ('id', glob), ('code', text), ('query', key, value) ... and 'and'/'or' (with a count) and 'not'."""
    stack: list[tuple] = []
    for t in tokens:
        if t == "not":
            stack.append(("not", stack.pop()))
        elif isinstance(t, tuple) and t[0] in ("and", "or") and isinstance(t[1], int):
            if t[1] > len(stack) or t[1] < 1:
                raise ValueError(f"{t} takes more than there is")
            args, stack = stack[-t[1] :], stack[: -t[1]]
            stack.append((t[0], *args))
        else:
            stack.append(t)
    if len(stack) != 1:
        raise ValueError(f"{len(stack)} expressions are left")
    return stack[0]


def compile_filter(tree: tuple, at: Inputs, cwd: str | None = None) -> Column:
    """A boolean Column that is never null."""
    kind, *rest = tree
    if kind in ("and", "or"):
        out = compile_filter(rest[0], at, cwd)
        for x in rest[1:]:
            out = out & compile_filter(x, at, cwd) if kind == "and" else out | compile_filter(x, at, cwd)
        return out
    if kind == "not":
        return ~compile_filter(rest[0], at, cwd)
    if kind == "clean_url":  # the tree below looks at the id without its query
        return compile_filter(rest[0], Inputs(None if at.id is None else clean_url(at.id), at.importer, at.code, at.module_type), cwd)
    if kind == "query":
        key, want = rest
        value = F.lit(None).cast("string") if at.id is None else query_value(at.id, key)
        if want is True:
            return value.isNotNull()
        if want is False:
            return value.isNull()
        return F.coalesce(value.rlike(want[1:-1]) if want[:1] == want[-1:] == "/" and len(want) > 1 else value == want, F.lit(False))
    leaf = {"id": at.id, "importer": at.importer, "code": at.code, "module_type": at.module_type}[kind]
    if leaf is None:
        return F.lit(False)
    test = {"id": lambda: leaf.rlike(glob_regex(rest[0], cwd)), "importer": lambda: leaf.rlike(glob_regex(rest[0], cwd)), "code": lambda: leaf.contains(rest[0]), "module_type": lambda: leaf == rest[0]}[kind]()
    return F.coalesce(test, F.lit(False))
