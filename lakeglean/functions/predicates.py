"""Predicates: condition dictionaries, metadata trees, visibility, routing. All built-in expressions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def condition(spec: dict) -> Column:
    """Scalars are equal, lists contain, `exists` and `must_not: {exists}` name columns; None is absent, other falsy values count.

    available_int 0 means below 1; any other value means not below 1, where null counts as available.
    """
    out = []
    for name, value in spec.items():
        if value is None:
            continue
        if name == "exists":
            out.append(F.col(value).isNotNull())
        elif name == "must_not":
            out.append(F.col(value["exists"]).isNull())
        elif name == "available_int":
            below = F.coalesce(F.col(name), F.lit(1)) < 1
            out.append(below if value == 0 else ~below)
        elif isinstance(value, list):
            out.append(F.col(name).isin(value))
        else:
            out.append(F.col(name) == value)
    return all_of(out)


def array_any(column: str, values: list) -> Column:
    """Whether the array has any of the values."""
    return F.coalesce(F.arrays_overlap(F.col(column), F.array(*map(F.lit, values))), F.lit(False))


def metadata_test(value: Column, op: str, wanted: object = None) -> Column | None:
    """One test on the text of a metadata value; None for an unknown operator."""
    text = F.lit("" if wanted is None else str(wanted))
    number = lambda c: c.try_cast("decimal(20,10)")
    when = lambda c: F.try_to_timestamp(c)
    tests = {
        "is": lambda: value == text, "is not": lambda: value != text, "contains": lambda: value.contains(text), "not contains": lambda: ~value.contains(text),
        "start with": lambda: value.startswith(text), "end with": lambda: value.endswith(text), "empty": lambda: value.isNull() | (value == ""), "not empty": lambda: value.isNotNull() & (value != ""),
        "=": lambda: number(value) == number(text), "≠": lambda: number(value) != number(text), ">": lambda: number(value) > number(text), "<": lambda: number(value) < number(text),
        "≥": lambda: number(value) >= number(text), "≤": lambda: number(value) <= number(text), "before": lambda: when(value) < when(text), "after": lambda: when(value) > when(text),
    }
    return tests[op]() if op in tests else None


def metadata_filter(json: str, spec: dict) -> Column:
    """A tree {"logic": "and" | "or", "conditions": [{"key", "op", "value"} or trees]} over a JSON column. Unknown operators are left out."""
    parts = []
    for c in spec["conditions"]:
        test = metadata_filter(json, c) if "conditions" in c else metadata_test(F.get_json_object(json, f"$.{c['key']}"), c["op"], c.get("value"))
        if test is not None:
            parts.append(F.coalesce(test, F.lit(False)))
    if not parts:
        return F.lit(True)
    return reduce((lambda a, b: a | b) if spec.get("logic") == "or" else (lambda a, b: a & b), parts)


def doc_test(value: Column, op: str, wanted: str) -> Column:
    """A test of document metadata: by number if both sides are, else by text; text tests ignore case."""
    a, b = value.try_cast("double"), F.lit(wanted).try_cast("double")
    both = a.isNotNull() & b.isNotNull()
    order = lambda f: F.when(both, f(a, b)).otherwise(f(value, F.lit(wanted)))
    low, want = F.lower(value), F.lower(F.lit(wanted))
    return {
        "=": lambda: order(lambda x, y: x == y), "≠": lambda: order(lambda x, y: x != y), ">": lambda: order(lambda x, y: x > y), "<": lambda: order(lambda x, y: x < y),
        "≥": lambda: order(lambda x, y: x >= y), "≤": lambda: order(lambda x, y: x <= y), "contains": lambda: low.contains(want), "not contains": lambda: ~low.contains(want),
        "start with": lambda: low.startswith(want), "end with": lambda: low.endswith(want), "empty": lambda: value == "", "not empty": lambda: value != "",
    }[op]()


def meta_filter(meta: DataFrame, filters: list[tuple[str, str, str]]) -> DataFrame:
    """Documents of (key, value, doc_id) for which every condition holds for some value; a key that no row has is ignored.

    One pass: each row tests the conditions on its key, and a document passes if it has met all of them.
    """
    tests = [F.max(F.when(F.col("key") == k, doc_test(F.col("value"), op, v))).alias(f"c{i}") for i, (k, op, v) in enumerate(filters)]
    known = [F.max((F.col("key") == k).cast("int")).alias(f"k{i}") for i, (k, _, _) in enumerate(filters)]
    present = meta.agg(*known)  # one row
    passed = meta.groupBy("doc_id").agg(*tests).join(F.broadcast(present))
    return passed.where(all_of([F.coalesce(F.col(f"c{i}"), F.lit(False)) | (F.coalesce(F.col(f"k{i}"), F.lit(0)) == 0) for i in range(len(filters))])).select("doc_id")


def extraction_filter(items: str, filters: list[tuple[str, str, str]]) -> Column:
    """Whether for every (field, operator, value) some item of array<struct> satisfies it, case aside."""
    def some(field: str, op: str, wanted: str) -> Column:
        return F.exists(items, lambda x: F.coalesce(doc_test(F.lower(x[field]), op, wanted.lower()), F.lit(False)))

    return all_of([some(*f) for f in filters])


def combine_doc_filters(parts: list[tuple[bool, DataFrame]], everything: DataFrame) -> DataFrame:
    """Ids that are in every part that restricts; a part that restricts and is empty leaves none."""
    out = everything.select("doc_id")
    for restricts, ids in parts:
        if restricts:
            out = out.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
    return out


def route(rules: list[tuple[Column, str]], default: str) -> Column:
    """The target of the first rule that holds."""
    out = F.lit(default)
    for test, target in reversed(rules):
        out = F.when(test, F.lit(target)).otherwise(out)
    return out


def name_contains(column: str, part: str) -> Column:
    return F.lower(F.col(column)).contains(part.lower())


def visible(tenant: str, permission: str, status: str, me: object, tenants: list) -> Column:
    """Own rows, and rows of joined tenants that are open to the team; valid ones only."""
    return ((F.col(tenant).isin(tenants) & (F.col(permission) == "team")) | (F.col(tenant) == me)) & (F.col(status) == "1")


def recent(column: str, now: Column, minutes: int) -> Column:
    return F.col(column) >= now - F.expr(f"INTERVAL {minutes} MINUTES")
