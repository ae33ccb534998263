"""The codebook: what the columns of a questionnaire table mean.

Scale types, labels, category order, missing codes, reversed items, groups of
"check all that apply" columns, the weight and the survey design.  Everything an
operator needs from it comes as Spark columns, so that semantics are part of the
plan.
"""

from __future__ import annotations

import csv
import io
import json
import re
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.functions.columns import code, finite, mapped

SCALES = ("nominal", "ordinal", "interval", "ratio", "text", "id")
_NOT_APPLICABLE = re.compile("非該当|not_applicable|skip")


class CodebookError(ValueError):
    """A codebook, or a request under it, that has no defined result."""


@dataclass(frozen=True)
class Variable:
    name: str
    scale: str = "nominal"
    role: str = "question"
    label: str = ""
    value_labels: dict[str, str] = field(default_factory=dict)
    order: tuple[str, ...] = ()
    missing_codes: tuple[str, ...] = ()
    missing_reasons: dict[str, str] = field(default_factory=dict)
    is_reversed: bool = False
    group: str | None = None

    @property
    def not_applicable_codes(self) -> tuple[str, ...]:
        return tuple(c for c in self.missing_codes if _NOT_APPLICABLE.search(self.missing_reasons.get(c, "")))

    @property
    def domain(self) -> tuple[str, ...]:
        """Declared codes in order, without missing ones; empty if nothing is declared."""
        return tuple(c for c in (self.order or tuple(self.value_labels)) if c not in self.missing_codes)


@dataclass(frozen=True)
class Group:
    """Binary columns that are the options of one question."""

    name: str
    options: tuple[str, ...]
    selected: tuple[str, ...] = ("1",)
    unselected: tuple[str, ...] = ("0",)
    not_applicable: tuple[str, ...] = ()
    missing: tuple[str, ...] = ()
    all_unselected: str = "none_selected"
    max_selections: int | None = None


@dataclass(frozen=True)
class Design:
    weight: str | None = None
    weight_type: str = "survey"
    strata: str | None = None
    psu: str | None = None
    fpc: str | None = None


@dataclass(frozen=True)
class Codebook:
    variables: tuple[Variable, ...] = ()
    groups: tuple[Group, ...] = ()
    design: Design = Design()

    def __getitem__(self, name: str) -> Variable:
        return next((v for v in self.variables if v.name == name), Variable(name))

    def group(self, name: str) -> Group:
        found = next((g for g in self.groups if g.name == name), None)
        if found is None:
            raise CodebookError(f"no group named {name}")
        return found

    def validate(self) -> Codebook:
        """Raise on declarations that no operator could honour."""
        for v in self.variables:
            if v.scale not in SCALES:
                raise CodebookError(f"{v.name}: unknown scale {v.scale}")
            if v.is_reversed and v.scale in ("interval", "ratio"):
                try:
                    list(map(float, v.order)) or (_ for _ in ()).throw(ValueError)
                except ValueError:
                    raise CodebookError(f"{v.name}: a reversed number needs a numeric order") from None
        for g in self.groups:
            if len(g.options) < 2 or len(set(g.options)) < len(g.options):
                raise CodebookError(f"{g.name}: at least two different options")
            sets = [set(g.selected), set(g.unselected), set(g.not_applicable), set(g.missing)]
            if sum(map(len, sets)) > len(set().union(*sets)):
                raise CodebookError(f"{g.name}: a code has two meanings")
        if self.design.weight_type not in ("survey", "frequency"):
            raise CodebookError(f"unknown weight type {self.design.weight_type}")
        return self

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, sort_keys=True)

    @staticmethod
    def from_json(text: str | Path) -> Codebook:
        raw = json.loads(text.read_text() if isinstance(text, Path) else text)
        tuples = lambda d: {k: tuple(v) if isinstance(v, list) else v for k, v in d.items()}
        return Codebook(
            tuple(Variable(**tuples(v)) for v in raw.get("variables", ())),
            tuple(Group(**tuples(g)) for g in raw.get("groups", ())),
            Design(**raw.get("design", {})),
        ).validate()

    def to_csv(self) -> str:
        """One line a variable; labels and reasons as JSON, lists joined by ``|`` (JSON where a code holds one)."""
        out = io.StringIO()
        rows = csv.DictWriter(out, _CSV_FIELDS, lineterminator="\n")
        rows.writeheader()
        for v in self.variables:
            row = {k: x for k, x in asdict(v).items() if k in _CSV_FIELDS}
            for k, x in row.items():
                if isinstance(x, dict):
                    row[k] = json.dumps(x, ensure_ascii=False) if x else ""
                elif isinstance(x, (tuple, list)):
                    plain = not any("|" in c or not c or c.startswith("[") for c in x)
                    row[k] = "|".join(x) if plain else json.dumps(list(x), ensure_ascii=False)
                elif isinstance(x, bool):
                    row[k] = "true" if x else "false"
            rows.writerow(row)
        return out.getvalue()

    def patched(self, text: str | Path) -> Codebook:
        """This codebook with what a CSV or JSON one says about its variables.

        Variables are matched by name and unknown names ignored; an empty CSV cell, or a field that JSON lacks, changes
        nothing.  Of JSON, groups and design are taken over where they are given.
        """
        text = (text.read_text() if isinstance(text, Path) else text).removeprefix("\ufeff")
        groups, design = self.groups, self.design
        try:
            if text.lstrip().startswith("{"):
                raw = json.loads(text)
                given = raw.get("variables", [])
                lists = lambda d: {k: tuple(x) if isinstance(x, list) else x for k, x in d.items()}
                groups = tuple(Group(**lists(g)) for g in raw["groups"]) if "groups" in raw else groups
                design = Design(**raw["design"]) if "design" in raw else design
            else:
                given = [{k: _parsed(k, x) for k, x in r.items() if k in _CSV_FIELDS and x} for r in csv.DictReader(io.StringIO(text))]
            patches = {p["name"]: {k: tuple(x) if isinstance(x, list) else x for k, x in p.items()} for p in given if p.get("name")}
            return Codebook(tuple(replace(v, **patches.get(v.name, {})) for v in self.variables), groups, design).validate()
        except (TypeError, AttributeError, ValueError) as e:
            raise e if isinstance(e, CodebookError) else CodebookError(f"no codebook: {e}") from e


_CSV_FIELDS = ("name", "label", "scale", "role", "value_labels", "order", "missing_codes", "missing_reasons", "is_reversed", "group")


def _parsed(name: str, cell: str) -> object:
    if name in ("value_labels", "missing_reasons"):
        found = json.loads(cell)
        if not isinstance(found, dict):
            raise CodebookError(f"{name}: no table of codes")
        return found
    if name in ("order", "missing_codes"):
        return tuple(json.loads(cell)) if cell.startswith("[") else tuple(cell.split("|"))
    if name == "is_reversed":
        if cell.lower() not in ("true", "false", "1", "0"):
            raise CodebookError(f"{name}: neither true nor false")
        return cell.lower() in ("true", "1")
    return cell


def codes(df: DataFrame, name: str) -> Column:
    """A column's normalised category codes."""
    return code(F.col(name), df.schema[name].dataType)


def state(df: DataFrame, v: Variable) -> Column:
    """valid, invalid, missing or not_applicable for each row of a variable."""
    c = codes(df, v.name)
    out = F.when(c.isNull(), "missing")
    if v.not_applicable_codes:
        out = out.when(c.isin(*v.not_applicable_codes), "not_applicable")
    if v.missing_codes:
        out = out.when(c.isin(*v.missing_codes), "missing")
    if v.domain and v.scale in ("nominal", "ordinal"):
        out = out.when(~c.isin(*v.domain), "invalid")
    return out.otherwise("valid")


def valid_code(df: DataFrame, v: Variable) -> Column:
    return F.when(state(df, v) == "valid", codes(df, v.name))


def score(df: DataFrame, v: Variable) -> Column:
    """The number an analysis sees: rank for ordinal items, value for numbers, reversed where the item is."""
    if v.scale == "ordinal":
        if not v.domain:
            raise CodebookError(f"{v.name}: an ordinal item needs an order")
        ranked = list(reversed(v.domain)) if v.is_reversed else list(v.domain)
        return mapped(codes(df, v.name), {c: float(i + 1) for i, c in enumerate(ranked)})
    number = finite(F.col(v.name).try_cast("double"))
    if v.missing_codes:
        number = F.when(~codes(df, v.name).isin(*v.missing_codes), number)
    if v.is_reversed:
        ends = [float(x) for x in v.order]
        number = max(ends) + min(ends) - number
    return number


def label(df: DataFrame, v: Variable) -> Column:
    c = codes(df, v.name)
    return F.coalesce(mapped(c, v.value_labels), c) if v.value_labels else c


def position(v: Variable, c: Column) -> Column:
    """Declared position of a code, from 0; null for codes that are not declared."""
    return mapped(c, {x: i for i, x in enumerate(v.domain)}).cast("int")


def with_orders(df: DataFrame, book: Codebook) -> Codebook:
    """Give ordinal numeric columns without an order the ascending order of their codes in the whole table."""
    open_ = [v for v in book.variables if v.scale == "ordinal" and not v.order and df.schema[v.name].dataType.typeName() != "string"]
    if not open_:
        return book
    found = df.agg(*(F.array_sort(F.collect_set(finite(v.name))).alias(v.name) for v in open_)).first()
    fixed = {v.name: tuple(str(int(x)) if x == int(x) else repr(x) for x in found[v.name]) for v in open_}
    ordered = lambda v: tuple(c for c in fixed[v.name] if c not in v.missing_codes)
    return Codebook(
        tuple(Variable(**{**asdict(v), "order": ordered(v)}) if v.name in fixed else v for v in book.variables), book.groups, book.design
    )
