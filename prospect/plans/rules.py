"""Validation rules of a search request: one table for both forms.

A rule names its kind, its fields and its message; ``first_failure`` reads the
table for one request, ``failure_column`` builds the same decisions as columns
for a table of requests.  The order of the rules is the order of the messages.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from prospect.plans.search import MAX_RADIUS_MILES, VALID_CATEGORIES, VALID_FORMATS, VALID_STATUSES


@dataclass(frozen=True)
class Rule:
    kind: str
    field: str
    message: str  # ``{}`` stands for the offending value
    limit: object = None


def _span(field: str, low: int, high: int, label: str, unit: str = "") -> list[Rule]:
    return [Rule("below", field, f"{label} must be ≥ {low}", low), Rule("above", field, f"{label} must be ≤ {high}{unit}", high)]


# The message texts, limits and their order.
RULES = [
    Rule("given", "postcode", "Postcode is required"),
    Rule("given", "radius_miles", "Radius is required"),
    Rule("length", "postcode", "Invalid postcode format: '{}'", (5, 8)),
    Rule("number", "radius_miles", "Radius must be a number"),
    Rule("positive", "radius_miles", "Radius must be greater than 0"),
    Rule("above", "radius_miles", "Radius must be ≤ 500 miles", MAX_RADIUS_MILES),
    Rule("one of", "company_status", f"Invalid company status. Must be one of: {VALID_STATUSES}", VALID_STATUSES),
    Rule("some", "sic_codes", "SIC codes list cannot be empty"),
    Rule("codes", "sic_codes", ""),
    Rule("all of", "account_categories", "Invalid account category: '{}'", VALID_CATEGORIES),
    *_span("min_psc_age", 16, 120, "Minimum PSC age"),
    *_span("max_psc_age", 16, 120, "Maximum PSC age"),
    Rule("ordered", "min_psc_age", "Minimum age cannot exceed maximum age", "max_psc_age"),
    *_span("min_psc_tenure_years", 1, 100, "Minimum PSC tenure"),
    *_span("max_psc_tenure_years", 1, 100, "Maximum PSC tenure"),
    Rule("ordered", "min_psc_tenure_years", "Minimum tenure cannot exceed maximum tenure", "max_psc_tenure_years"),
    *_span("min_company_age_years", 0, 200, "Minimum company age", " years"),
    *_span("max_company_age_years", 0, 200, "Maximum company age", " years"),
    Rule("ordered", "min_company_age_years", "Minimum company age cannot exceed maximum company age", "max_company_age_years"),
    Rule("one of", "output_format", "Output format must be 'csv' or 'xlsx', not '{}'", VALID_FORMATS),
    Rule("below", "max_results", "Maximum results must be ≥ 0", 0),
]
# Messages of an industry code and the range each belongs to.
CODE_TYPE, CODE_RANGE, CODE_DIGITS = "SIC code must be integer: {}", "SIC code out of range (0-99999): {}", "SIC code must be 5 digits: {}"
CODE_LIMITS, CODE_FIRST = (0, 99999), 10000


def _is_number(v) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool) and not math.isnan(v)


def _code_message(code) -> str | None:
    if type(code) is not int:
        return CODE_TYPE
    if not CODE_LIMITS[0] <= code <= CODE_LIMITS[1]:
        return CODE_RANGE
    return CODE_DIGITS if code < CODE_FIRST else None


def _offence(rule: Rule, v, req) -> tuple[str, object] | None:
    """(message, offending value) if ``v`` breaks the rule."""
    if rule.kind == "given":
        return (rule.message, v) if v is None else None
    if rule.kind == "one of":
        return (rule.message, v) if v not in rule.limit else None
    if v is None:
        return None
    if rule.kind == "codes":
        return next(((m, c) for c in v if (m := _code_message(c))), None)
    if rule.kind == "all of":
        return next(((rule.message, c) for c in v if c not in rule.limit), None)
    other = getattr(req, rule.limit) if rule.kind == "ordered" else None
    broken = {
        "length": lambda: not rule.limit[0] <= len(v.strip()) <= rule.limit[1],
        "number": lambda: not _is_number(v),
        "positive": lambda: v <= 0,
        "some": lambda: not v,
        "below": lambda: v < rule.limit,
        "above": lambda: v > rule.limit,
        "ordered": lambda: other is not None and v > other,
    }[rule.kind]()
    return (rule.message, v) if broken else None


def first_failure(req) -> str | None:
    """Message of the first rule that ``req`` breaks."""
    for rule in RULES:
        found = _offence(rule, getattr(req, rule.field), req)
        if found:
            return found[0].replace("{}", str(found[1]))
    return None


def _fill(message: str, value: Column) -> Column:
    parts = re.split(r"(\{\})", message)
    return F.concat(*[value.cast("string") if p == "{}" else F.lit(p) for p in parts if p])


def _broken(rule: Rule) -> list[tuple[Column, Column]]:
    """(condition, message) columns of a rule."""
    c = F.col(rule.field)
    if rule.kind == "codes":
        bad = F.try_element_at(F.filter(c, lambda x: (x < CODE_FIRST) | (x > CODE_LIMITS[1])), F.lit(1))
        return [(~bad.between(*CODE_LIMITS), _fill(CODE_RANGE, bad)), (bad.isNotNull(), _fill(CODE_DIGITS, bad))]
    if rule.kind == "all of":
        allowed = F.array(*[F.lit(x) for x in rule.limit])
        bad = F.try_element_at(F.filter(c, lambda x: ~F.array_contains(allowed, x)), F.lit(1))
        return [(bad.isNotNull(), _fill(rule.message, bad))]
    test = {
        "given": lambda: c.isNull(),
        "length": lambda: ~F.length(F.regexp_replace(c, r"^\s+|\s+$", "")).between(*rule.limit),
        "number": lambda: F.isnan(c),
        "positive": lambda: c <= 0,
        "one of": lambda: ~c.isin(rule.limit),
        "some": lambda: F.size(c) == 0,
        "below": lambda: c < rule.limit,
        "above": lambda: c > rule.limit,
        "ordered": lambda: c > F.col(rule.limit),
    }[rule.kind]()
    return [(test, _fill(rule.message, c))]


def failure_column() -> Column:
    """Message of the first broken rule, or 'Valid'."""
    out = F.lit("Valid")
    for test, message in reversed([x for rule in RULES for x in _broken(rule)]):
        out = F.when(F.coalesce(test, F.lit(False)), message).otherwise(out)
    return out
