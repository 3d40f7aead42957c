"""Cleaning layouts as data (P10, C9): rows of rules compiled to column expressions.

A layout is a set of rows (layout, target, step, action, argument): captures of the
uncut page (targets ``date``, ``byline``, ``url``, ``title``) and the steps that cut the
text, in order (target ``text``).  The pages' folders name the layout (target ``source``
or ``genre``, the folder's name as argument).  A new publisher is rows in a table, not code.

Actions over texts::

    extract        the argument's regular expression, group 0
    extract_group  the same, group 1
    constant       the argument
    input          the input column named by the argument, without what follows a bar in it
    remove         every match of the argument's regular expression
    remove_text    every occurrence of the argument
    cut_through    everything through the first line that begins with the argument
    built_in       a structural rule of the library by name (``BUILT_IN``)
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "layout string, target string, step int, action string, argument string"
CAPTURES = ("date", "byline", "url", "title")
FOLDERS = ("source", "genre")
MOST_RULES = 10_000     # a rule table is configuration


@dataclass(frozen=True, order=True)
class Rule:
    layout: str
    target: str
    step: int
    action: str
    argument: str


# structural rules by name: fn(text column) -> Column
BUILT_IN: dict[str, Callable[[str], Column]] = {}


def built_in(name: str):
    def deco(fn):
        BUILT_IN[name] = fn
        return fn
    return deco


def cut_through(text: Column, start: str) -> Column:
    from penmark.operators.clean import _drop_first, _lines, _terminated
    lines = _lines(text)
    hit = F.zip_with(lines, _terminated(lines), lambda ln, t: ln.startswith(start) & t)
    first = F.array_position(hit, True)
    return F.when(first > 0, _drop_first(lines, first.cast("int"))).otherwise(text)


def _input(argument: str) -> Column:
    column, _, suffix = argument.partition("|")
    value = F.coalesce(F.col(column), F.lit(""))
    return F.replace(value, F.lit(suffix), F.lit("")) if suffix else value


ACTIONS: dict[str, Callable[[str, str], Column]] = {
    "extract": lambda t, arg: F.regexp_extract(t, arg, 0),
    "extract_group": lambda t, arg: F.regexp_extract(t, arg, 1),
    "constant": lambda t, arg: F.lit(arg),
    "input": lambda t, arg: _input(arg),
    "remove": lambda t, arg: F.regexp_replace(t, arg, ""),
    "remove_text": lambda t, arg: F.replace(F.col(t), F.lit(arg), F.lit("")),
    "cut_through": lambda t, arg: cut_through(F.col(t), arg),
    "built_in": lambda t, arg: BUILT_IN[arg](t),
}


def checked(rules: list[Rule]) -> list[Rule]:
    """The rules in order; an unknown action, target or built-in, or a layout without one
    of the captures, raises before anything runs."""
    for r in rules:
        if r.target not in (*CAPTURES, *FOLDERS, "text"):
            raise ValueError(f"{r}: unknown target")
        if r.target not in FOLDERS and r.action not in ACTIONS:
            raise ValueError(f"{r}: unknown action")
        if r.action == "built_in" and r.argument not in BUILT_IN:
            raise ValueError(f"{r}: no such rule")
    for layout in {r.layout for r in rules}:
        for target in CAPTURES:
            if sum(r.layout == layout and r.target == target for r in rules) != 1:
                raise ValueError(f"layout {layout!r} needs one rule for {target}")
    return sorted(rules)


def from_table(table: DataFrame) -> list[Rule]:
    """Rules from a table with the columns of ``SCHEMA``."""
    rows = table.select("layout", "target", "step", "action", "argument").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return checked([Rule(*r) for r in rows])


def to_table(spark, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame([astuple(r) for r in rules], SCHEMA)


def layouts(rules: list[Rule]) -> list[str]:
    return sorted({r.layout for r in rules})


def capture(rules: list[Rule], layout: str, target: str, text: str) -> Column:
    rule = next(r for r in rules if r.layout == layout and r.target == target)
    return ACTIONS[rule.action](text, rule.argument)


def steps(rules: list[Rule], layout: str) -> list[Callable[[str], Column]]:
    found = sorted(r for r in rules if r.layout == layout and r.target == "text")
    return [lambda t, r=r: ACTIONS[r.action](t, r.argument) for r in found]


def layout_of(rules: list[Rule], source: Column, genre: Column) -> Column:
    """The layout that the folders name; a source's rule goes before a genre's; none -> NULL."""
    out = F.lit(None).cast("string")
    for target, folder in (("genre", genre), ("source", source)):
        for r in rules:
            if r.target == target:
                out = F.when(folder == r.argument, F.lit(r.layout)).otherwise(out)
    return out
