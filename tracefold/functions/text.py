"""Names, numbers and labels as text: Column functions, and their scalar twins where the driver needs one."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_count(text: Column) -> Column:
    """Number or comma-grouped text as a double; blank or unreadable: null."""
    return F.nullif(F.trim(F.replace(text, F.lit(","), F.lit(""))), F.lit("")).try_cast("double")


def concept_folder(concept: str) -> str:
    """``n1`` as ``n001``; others unchanged."""
    m = re.fullmatch(r"n(\d+)", concept)
    return f"n{int(m[1]):03d}" if m else concept


def concept_of_folder(folder: str) -> str:
    m = re.fullmatch(r"n0*(\d+)", folder)
    return f"n{m[1]}" if m else folder


def concept_folder_col(concept: Column) -> Column:
    n = F.regexp_extract(concept, "^n([0-9]+)$", 1)
    return F.when(n != "", F.concat(F.lit("n"), F.lpad(n, 3, "0"))).otherwise(concept)


def xmin_folder(xmin: int | None) -> str:
    return "xmin-adaptive" if xmin is None else f"xmin{xmin:02d}"


def xmin_of_folder(folder: str) -> int | None:
    m = re.fullmatch(r"xmin(\d+)", folder)
    if m:
        return int(m[1])
    if folder == "xmin-adaptive":
        return None
    raise ValueError(folder)


def config_folder(min_types: int, gof: float, comparison: float) -> str:
    return f"min[{min_types}]-gofp[{gof:.2f}]-pcomp[{comparison:.2f}]"


def config_of_folder(folder: str) -> tuple[int, float, float]:
    m = re.fullmatch(r"min\[(\d+)\]-gofp\[([\d.]+)\]-pcomp\[([\d.]+)\]", folder)
    if not m:
        raise ValueError(folder)
    return int(m[1]), float(m[2]), float(m[3])


def duration(seconds: float) -> str:
    """``1h02m03.4s``, ``2m03.4s`` or ``3.4s``."""
    tenths = round(seconds * 10)
    hours, rest = divmod(tenths, 36000)
    minutes, rest = divmod(rest, 600)
    tail = f"{rest / 10:04.1f}s"
    return f"{hours}h{minutes:02d}m{tail}" if hours else (f"{minutes}m{tail}" if minutes else f"{rest / 10:.1f}s")


def percent_cell(share: Column) -> Column:
    return F.when(share.isNotNull(), F.format_string("%.1f%%", share * 100)).otherwise("NA")


def threshold_cell(count: Column, total: Column) -> Column:
    """``m/n (p%)``."""
    return F.format_string("%d/%d (%.1f%%)", count, total, 100 * count / total)


def grouped_number(value: Column, integer: bool = True) -> Column:
    return F.format_number(value, 0 if integer else 1)


# The codes and their names, and the words of messages that mean too few observations.
CODE_NAMES = {
    "A": "Ineligible for assessment",
    "B": "PL rejected",
    "C": "PL plausible but alternative favored",
    "D": "PL plausible and favored over alternatives",
    "E": "PL plausible and alternatives inconclusive",
}
TOO_FEW = ("not enough", "too few", "no valid", "insufficient", "cannot fit", "xmin")


def code_of_label(label: Column) -> Column:
    """A stored classification (a code, ``?``, a code's name or a free text) as A-E; what says nothing is A."""
    text = F.trim(label)
    low = F.lower(text)
    has = lambda *words: F.lit(False) if not words else low.contains(words[0]) | has(*words[1:])
    plausible = has("plausible")
    out = F.when(label.isNull() | (text == ""), "A").when(text.isin(*CODE_NAMES, "?"), text)
    for code, name in CODE_NAMES.items():
        out = out.when(text == name, code)
    out = out.when(has("invalid", "gof unavailable", "unresolved", "error", "ineligible") | (has("< 30") & has("fitted types")), "A")
    out = out.when(has("not plausible"), "B").when(plausible & has("alternative preferred", "other preferred"), "C")
    return out.when(plausible & has("pl best", "pl preferred", "preferred over alternatives"), "D").when(plausible, "E").otherwise("A")


def error_class(message: Column, name: Column | str = "error") -> Column:
    """An error text (or, where it is blank, the error's ``name``) as one of two classes with the text in brackets."""
    text = F.coalesce(F.nullif(F.trim(message), F.lit("")), F.lit(name) if isinstance(name, str) else name)
    few = F.lit(False)
    for word in TOO_FEW:
        few = few | F.lower(text).contains(word)
    return F.concat(F.when(few, "insufficient observations (").otherwise("error during fitting ("), text, F.lit(")"))


_TEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def tex(text: str) -> str:
    return "".join(_TEX.get(c, c) for c in text)


def tex_table(rows: list[dict], columns: list[str]) -> str:
    """A small collected report as a LaTeX tabular."""
    head = " & ".join(tex(c) for c in columns)
    body = "\n".join(" & ".join("--" if r.get(c) is None else tex(str(r[c])) for c in columns) + r" \\" for r in rows)
    return "\\begin{tabular}{" + "l" * len(columns) + "}\n\\hline\n" + head + " \\\\\n\\hline\n" + body + "\n\\hline\n\\end{tabular}\n"
