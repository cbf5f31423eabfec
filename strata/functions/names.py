"""Rules on column names and labels; they run on the driver."""

from __future__ import annotations

import os
import re


# The forms of identifier names.
IDENTIFIERS = (re.compile(r"^(?:id|uuid|guid)$", re.I), re.compile(r"[_\-\s]id$", re.I), re.compile(r"(?:[^A-Z]|^)ID$"))


def is_identifier(name: str) -> bool:
    """id, uuid, guid, or a name that ends in one."""
    return any(form.search(name.strip()) for form in IDENTIFIERS)


def is_component(name: str) -> bool:
    return bool(re.match(r"PC\d+(_|$)", name, re.I))


def is_derived(name: str) -> bool:
    return is_component(name) or name.startswith("COMP_") or name == "Cluster"


def clean_label(text: str) -> str:
    out = re.sub(r"[^A-Za-z0-9_-]", "_", re.sub(r"\s+", "_", text.strip()))
    return re.sub(r"_+", "_", out).strip("_")


def shared_label(names: list[str]) -> str | None:
    """The longer of what all names begin and end with, without digits and separators at its edge."""
    if len(names) < 2:
        return None
    start = re.sub(r"[\d_\-\s]+$", "", os.path.commonprefix(names))
    end = re.sub(r"^[\d_\-\s]+", "", os.path.commonprefix([n[::-1] for n in names])[::-1])
    found = clean_label(end if len(end) > len(start) else start)
    return found if len(found) >= 2 else None


def component_names(label: str, k: int) -> list[str]:
    if label and k == 1:
        return [f"COMP_{label}"]
    return [f"PC{c + 1}_{label}" if label else f"PC{c + 1}" for c in range(k)]


def owned_by(label: str, name: str) -> bool:
    """Whether an earlier run with this label made the column."""
    return bool(re.fullmatch(rf"PC\d+_{re.escape(label)}|COMP_{re.escape(label)}" if label else r"PC\d+", name))


def normal_name(name: str) -> str:
    return name.strip().lower()


def declared_codes(text: str) -> list[float]:
    """Numbers in a list of codes; blanks are no zeros."""
    out: list[float] = []
    for part in re.split(r"[,;\s]+", text.strip()):
        try:
            value = float(part)
        except ValueError:
            continue
        if value == value and abs(value) != float("inf") and value not in out:
            out.append(value)
    return out


def export_name(dataset: str, extension: str, filtered: bool) -> str:
    return f"{re.sub(r'\.[^.]+$', '', dataset)}{'_filtered' if filtered else ''}.{extension}"


def export_columns(columns: list[str], derived: bool) -> list[str]:
    return [c for c in columns if derived or not is_derived(c)]
