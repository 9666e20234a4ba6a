"""Which encoder a terminal understands, from environment variables alone."""

from __future__ import annotations

import shutil
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Substrings of TERM that stand for Sixel support, fixed values.
SIXEL_TERMS = ("mlterm", "yaft", "foot", "xterm", "contour")


def is_kitty(env: Mapping[str, str]) -> bool:
    return bool(env.get("KITTY_WINDOW_ID")) or "kitty" in env.get("TERM", "")


def number(text: str | None) -> int:
    """Leading digits as a number, else 0."""
    import re

    found = re.match(r"\s*[+-]?\d+", text or "")
    return int(found[0]) if found else 0


def is_sixel(env: Mapping[str, str]) -> bool:
    return bool(
        env.get("WT_SESSION")
        or any(t in env.get("TERM", "") for t in SIXEL_TERMS)
        or number(env.get("KONSOLE_VERSION")) >= 220000
        or number(env.get("VTE_VERSION")) >= 5200
        or env.get("TERM_PROGRAM") == "iTerm.app"
    )


def backend(env: Mapping[str, str], *, force_sixel: bool = False, force_ansi: bool = False) -> str:
    if force_ansi:
        return "ansi"
    if force_sixel or is_sixel(env):
        return "sixel"
    return "kitty" if is_kitty(env) else "ansi"


def fit_size() -> tuple[int, int]:
    """Columns, and rows less the prompt's, of the driver's terminal."""
    size = shutil.get_terminal_size()
    return size.columns, max(1, size.lines - 1)


def kitty_column(window_id: Column, term: Column) -> Column:
    """``is_kitty`` over a table of environments."""
    return (F.coalesce(window_id, F.lit("")) != "") | F.contains(F.coalesce(term, F.lit("")), F.lit("kitty"))


def sixel_column(wt: Column, term: Column, konsole: Column, vte: Column, program: Column) -> Column:
    def count(c: Column) -> Column:
        return F.coalesce(F.regexp_extract(c, r"^\s*([+-]?\d+)", 1).try_cast("long"), F.lit(0))

    text = F.coalesce(term, F.lit(""))
    named = F.lit(False)
    for t in SIXEL_TERMS:
        named = named | F.contains(text, F.lit(t))
    return (F.coalesce(wt, F.lit("")) != "") | named | (count(konsole) >= 220000) | (count(vte) >= 5200) | (F.coalesce(program, F.lit("")) == "iTerm.app")
