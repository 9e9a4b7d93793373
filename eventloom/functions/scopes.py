"""Scopes that are left out, as glob patterns over names such as ``package.Class.method``."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prefix_tree(patterns: Iterable[str]) -> dict:
    """The patterns' parts between dots as a tree; a pattern that ends at a node has "" there."""
    root: dict = {}
    for pattern in patterns:
        node = root
        for part in pattern.strip().split("."):
            node = node.setdefault(part, {})
        node[""] = {}
    return root


def expression(patterns: Iterable[str]) -> str | None:
    """One regular expression for all patterns, None if there are none. Patterns that begin alike share that part, so a name is followed once through it.

    A ``*`` stands for any text, dots too, as a part of a name may be many; all else stands for itself.
    """

    def text(part: str) -> str:
        return ".*".join(re.escape(x) for x in part.split("*"))

    def write(node: dict) -> str:
        ends = [_branch(part, below) for part, below in sorted(node.items())]
        return ends[0] if len(ends) == 1 else "(?:" + "|".join(ends) + ")"

    def _branch(part: str, below: dict) -> str:
        if not part:
            return ""
        further = {k: v for k, v in below.items() if k}
        after = r"\." + write(further) if further else ""
        return text(part) + (f"(?:{after})?" if after and "" in below else after)

    tree = prefix_tree(p for p in patterns if p.strip())
    return f"^{write(tree)}$" if tree else None


def scope_of(descriptor: Column) -> Column:
    """``package.Class.method`` of a method's descriptor: what stands before its arguments, with dots."""
    return F.translate(F.regexp_extract(descriptor, r"^([^(\s]*)", 1), "/", ".")


def exclude(rows: DataFrame, patterns: Iterable[str], name: Column) -> DataFrame:
    """The rows whose name no pattern meets; rows without a name stay."""
    found = expression(patterns)
    return rows if found is None else rows.where(~F.coalesce(name.rlike(found), F.lit(False)))
