"""Staff lists and settings as people keep them: delimited text with headings in any words and any order.

A list is some hundreds of people in one document; documents are read by the tasks that hold them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import fields, replace

import pyarrow as pa
from pyspark.sql import DataFrame

from .grids import delimited

# Words of headings by what the column holds, those that say it and those that hint; the more specific first.
SLOTS = {
    "manager_email": (("manager email", "manager mail", "reporting to email", "hod email"), ()),
    "manager": (("manager", "reporting manager", "reports to", "hod", "head of department", "supervisor"), ("lead", "head")),
    "email": (("email", "e mail", "mail id", "email id", "email address", "mail address"), ("mail", "id")),
    "department": (("department", "dept", "dpt", "division", "team", "unit", "vertical", "business area"), ("function", "group", "section", "area")),
    "aliases": (("alias", "aliases", "also known as", "known as", "other names", "short name", "nickname"), ("aka", "variants")),
    "role": (("role", "designation", "title", "job title", "position"), ("grade", "level")),
    "name": (("employee name", "staff name", "member name", "full name", "person name"), ("employee", "name", "staff", "member", "person", "colleague", "resource", "who")),
}
ROSTER_SQL = "document_id string, row int, employee_name string, department string, email string, aliases array<string>, role string, manager string, manager_email string, reason string"
_ROSTER = pa.schema([("document_id", pa.string()), ("row", pa.int32()), *((c, pa.string()) for c in ("employee_name", "department", "email")), ("aliases", pa.list_(pa.string())), *((c, pa.string()) for c in ("role", "manager", "manager_email", "reason"))])


def key_of(text: str) -> str:
    return " ".join(re.sub("[^a-z0-9 ]+", " ", re.sub("[.’']", "", text.lower())).split())


def columns_of(headings: list[str]) -> dict[str, int]:
    """The column of each slot: the one whose heading says it with the longest words, each column once."""
    keys, found = [key_of(h) for h in headings], {}
    for slot, (strong, weak) in SLOTS.items():
        weights = [(max([0.0] + [3 + len(w) / 100 for w in strong if w in k] + [1 + len(w) / 100 for w in weak if w in k]), -i) for i, k in enumerate(keys) if i not in found.values()]
        if weights and max(weights)[0] > 0:
            found[slot] = -max(weights)[1]
    return found


def proper_name(text: str) -> str:
    """Capital initials; words of two to five capitals stay, as acronyms."""
    keep = lambda w: 2 <= len(letters := re.sub("[^A-Za-z]", "", w)) <= 5 and letters.isupper()
    return " ".join(w if keep(w) else w[:1].upper() + w[1:].lower() for w in text.split())


def roster_rows(text: str | None) -> list[dict]:
    """People, departments (rows without a name) and refused rows of a list; the heading is the one of the first five
    rows that names most columns."""
    grid = [[c[0] for c in row] for row in delimited(text or "")]
    usable = [(len(found), -i) for i, row in enumerate(grid[:5]) if {"name", "department"} & set(found := columns_of(row))]
    if len(grid) < 2 or not usable:
        return []
    head = -max(usable)[1]
    at = columns_of(grid[head])
    out = []
    for i, row in enumerate(grid[head + 1 :], head + 2):
        value = lambda slot: " ".join(row[at[slot]].split()) if slot in at and at[slot] < len(row) else ""  # noqa: B023, E731
        name, department, email = value("name"), value("department"), value("email")
        reason = None
        if not name and not department:
            reason = "no name"
        elif name and not department:
            reason = "no department"
        elif email and not re.fullmatch(r"[^\s@]+@[^\s@]+\.[^\s@]+", email):
            reason = "no valid address"
        aliases = [a for part in re.split(r"[,;/|]| and ", value("aliases")) if len(a := part.strip()) > 1 and key_of(a) != key_of(name)]
        out.append({"row": i, "employee_name": proper_name(name) or None, "department": proper_name(department) or None, "email": email or None, "aliases": aliases, "role": value("role") or None, "manager": value("manager") or None, "manager_email": value("manager_email") or None, "reason": reason})
    return out


def read_rosters(documents: DataFrame, id_col: str = "document_id", text_col: str = "text") -> DataFrame:
    """Rows of staff lists; ``reason`` says why a row isn't used, a row without a name states a department's manager."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"document_id": k} | r for k, t in zip(*(c.to_pylist() for c in batch.columns)) for r in roster_rows(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in _ROSTER], schema=_ROSTER)

    return documents.select(id_col, text_col).mapInArrow(read, ROSTER_SQL)


def coerced(config, given: dict[str, str]):
    """``config`` (a dataclass) with the values of a key and value sheet, by the types of its defaults; unknown keys and
    empty numbers change nothing."""
    known = {f.name.lower(): f.name for f in fields(config)}
    changed = {}
    for key, raw in given.items():
        name, text = known.get(str(key).strip().lower()), str(raw if raw is not None else "").strip()
        if name is None:
            continue
        default = getattr(config, name)
        if isinstance(default, bool):
            changed[name] = bool(re.fullmatch("(?i)true|yes|1|y", text))
        elif isinstance(default, (int, float)):
            changed[name] = type(default)(float(text)) if text else default
        elif isinstance(default, (list, tuple)):
            changed[name] = type(default)(x.strip() for x in text.split(",") if x.strip())
        elif isinstance(default, str):
            changed[name] = text
    return replace(config, **changed)
