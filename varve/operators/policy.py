"""Policy obligations on DataFrames: row filters, visible columns and column masks.

A policy engine answers with the policies that decided; a rule book maps each to reviewed rules,
which are names and parameters, never SQL. ``access`` folds the rules of an answer, for one
subject and one table, into an ``Access``: column values that rows must have, a mask per column
and the columns that may be seen. ``Access.view`` turns that into one filter and one projection.
What is not known exactly is refused.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.functions.masking import mask_email

MASKS: dict[str, Callable[[Column], Column]] = {"mask_email": mask_email}

# The reviewed rule book.
DEFAULT_RULES: dict[str, list[dict]] = {
    "public-reader": [],
    "tenant-reader": [
        {
            "kind": "row_filter",
            "name": "tenant_isolation",
            "parameters": {
                "principal_attribute": "tenant", "resource_attribute": "tenantColumn",
            },
        }
    ],
    "pii-reader": [
        {"kind": "column_mask", "name": "mask_email", "parameters": {"columns": ["email"]}}
    ],
}


class Refused(PermissionError):
    """Nothing may be seen."""


class BadRule(ValueError):
    """The rule book is wrong."""


@dataclass
class Access:
    """What one subject may see of one table."""

    values: dict[str, list[Any]] = field(default_factory=dict)
    masks: dict[str, set[str]] = field(default_factory=dict)
    visible: list[set[str]] = field(default_factory=list)

    def view(self, df: DataFrame) -> DataFrame:
        """The rows and columns of ``df`` that may be seen. Filters see real values; masks come
        after them, and columns keep their order."""
        for use, names in (("filter", self.values), ("mask", self.masks), ("show", set().union(*self.visible))):
            unknown = sorted(set(names) - set(df.columns))
            if unknown:
                raise Refused(f"no column {', '.join(unknown)} to {use}")
        several = sorted(name for name, masks in self.masks.items() if len(masks) > 1)
        if several:
            raise Refused(f"more than one mask for {', '.join(several)}")
        shown = [c for c in df.columns if all(c in names for names in self.visible)]
        if not shown:
            raise Refused("the rules leave no column")
        equal = [F.col(c) == F.lit(v) for c, held in self.values.items() for v in held]
        rows = df.where(reduce(Column.__and__, equal)) if equal else df
        if shown == df.columns and not self.masks:
            return rows
        return rows.select(*[self._shown(c) for c in shown])

    def _shown(self, name: str) -> Column:
        column = F.col(name)
        for mask in self.masks.get(name, ()):
            column = MASKS[mask](column).alias(name)
        return column


def _names(rule: Mapping[str, Any]) -> set[str]:
    names = (rule.get("parameters") or {}).get("columns")
    if not isinstance(names, (list, tuple)) or not names or not all(isinstance(n, str) for n in names):
        raise BadRule(f"rule {rule['name']}: columns must be a list of names")
    return set(names)


def _tenant(into: Access, rule: Mapping, subject: Mapping, table: Mapping) -> None:
    """Rows of the subject's own tenant; the table says which column holds it."""
    keys = rule.get("parameters") or {}
    value, column = subject.get(keys.get("principal_attribute")), table.get(keys.get("resource_attribute"))
    if value is None or column is None:
        raise Refused("subject or table does not say its tenant")
    into.values.setdefault(column, []).append(value)


def _mask(into: Access, rule: Mapping, subject: Mapping, table: Mapping) -> None:
    for name in _names(rule):
        into.masks.setdefault(name, set()).add(rule["name"])


def _allow(into: Access, rule: Mapping, subject: Mapping, table: Mapping) -> None:
    into.visible.append(_names(rule))


#: How each kind of rule is folded in, by kind and name; None stands for any name.
RULES: dict[tuple[str, str | None], Callable[[Access, Mapping, Mapping, Mapping], None]] = {
    ("row_filter", "tenant_isolation"): _tenant,
    **{("column_mask", name): _mask for name in MASKS},
    ("column_allow", None): _allow,
}


def apply_rules(rules: Iterable[Mapping[str, Any]], subject: Mapping[str, Any], table: Mapping[str, Any]) -> Access:
    """Fold rules into an access; a rule that is not supported refuses everything."""
    made = Access()
    for rule in rules:
        fold = RULES.get((rule["kind"], rule["name"])) or RULES.get((rule["kind"], None))
        if fold is None:
            raise Refused(f"rule {rule['kind']} {rule['name']} is not supported")
        fold(made, rule, subject, table)
    return made


def access(
    answer: Mapping[str, Any], book: Mapping[str, list[Mapping[str, Any]]],
    subject: Mapping[str, Any], table: Mapping[str, Any],
) -> Access:
    """The access that a policy engine's answer gives.

    ``answer`` holds ``allow``, the ``policies`` that decided and any ``errors``; ``subject`` and
    ``table`` are attributes by name.
    """
    deciding = list(dict.fromkeys(answer.get("policies", ())))
    unknown = [p for p in deciding if p not in book]
    if not answer.get("allow") or answer.get("errors") or unknown:
        why = [*answer.get("errors", ()), *[f"policy {p} has no rules" for p in unknown]] or ["not allowed"]
        raise Refused("; ".join(why))
    return apply_rules([rule for p in deciding for rule in book[p]], subject, table)


def load_rules(path: str) -> dict[str, list[dict]]:
    """A rule book file: JSON, or YAML where a YAML parser is installed."""
    with open(path, encoding="utf-8") as handle:
        if not path.endswith((".yml", ".yaml")):
            return json.load(handle)
        try:
            import yaml
        except ImportError as error:
            raise RuntimeError("no YAML parser here: use a JSON file") from error
        return yaml.safe_load(handle)
