"""Ignore files as checks on paths, in Column expressions.

A line turns into regular expressions at once: one that the whole path may fit, one that its last name may fit, and for
lines about directories the prefix of what lies below. The last check that fits a path decides, and a directory is judged
before everything in it.
"""
from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, functions as F

LINE = re.compile(r"\s*(?P<back>!?)\s*(?P<root>/?)(?P<glob>.*?)(?P<folder>/?)\s*")
GLOB_PART = re.compile(r"(?P<any>\*)|(?P<one>\?)|\[(?P<none>!?)(?P<set>[^\]]+)\]|(?P<text>[^*?\[]+|\[)")


class Check(NamedTuple):
    whole: str | None
    name: str | None
    folder: str | None
    ignores: bool


def glob_regex(glob: str, before: str = "") -> str:
    """Shell glob as a Java regex for all of a text; ``*`` also crosses slashes. ``before`` is a regex in front of it."""
    def java(part: re.Match) -> str:
        if part["set"]:
            return "[" + part["none"].replace("!", "^") + part["set"].replace("\\", r"\\") + "]"
        return ".*" if part["any"] else "." if part["one"] else re.escape(part["text"])

    return "(?s)^" + before + "".join(map(java, GLOB_PART.finditer(glob))) + "$"


def read_rules(lines: Iterable[str]) -> list[Check]:
    """Checks of the lines that hold a rule: ``!`` takes a path back in, a leading ``/`` means from the root, a closing one
    directories only. A glob with a slash is about paths, from the root or below any directory; others are about names."""
    found = [LINE.fullmatch(line) for line in lines if not line.lstrip().startswith("#")]
    return [
        Check(
            whole=glob_regex(f["glob"], "" if f["root"] else "(?:.*/)?") if f["root"] or "/" in f["glob"] else None,
            name=None if "/" in f["glob"] else glob_regex(f["glob"]),
            folder=f["glob"] + "/" if f["folder"] else None,
            ignores=not f["back"],
        )
        for f in found if f and f["glob"]
    ]


def _fits(check: Check, path: Column, is_dir: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    tests = [col.rlike(regex) for col, regex in ((path, check.whole), (name, check.name)) if regex]
    if check.folder is None:
        return reduce(Column.__or__, tests)
    return is_dir & reduce(Column.__or__, tests, path.startswith(check.folder))


def _last_word(checks: list[Check], path: Column, is_dir: Column) -> Column:
    said = [F.when(_fits(c, path, is_dir), F.lit(c.ignores)) for c in reversed(checks)]
    return F.coalesce(*said, F.lit(False))


def ignored(path: Column, rules: list[Check], is_dir: Column | None = None) -> Column:
    """True for a path that is ignored itself or lies below an ignored directory."""
    steps = F.split(path, "/")
    above = F.transform(F.slice(F.sequence(F.lit(0), F.size(steps) - 1), 2, F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))
    return F.exists(above, lambda p: _last_word(rules, p, F.lit(True))) | _last_word(rules, path, F.lit(False) if is_dir is None else is_dir)
