"""Closed nested documents: JSON texts held against a form at every depth (SRC-12).

A form says what a value must be; ``violations`` gives a row for everything that
isn't so, with its path (``$.observations[2].value``). Texts are parsed once
into VARIANT and taken apart level by level: a value becomes a row for each
thing that is wrong with it and one for each value inside it, so the work is in
rows and expressions don't grow with the depth of a form, and no schema has to
cover what may be wrong. Text that is no JSON, an object that names a key twice
included, is one violation at ``$``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = "struct<path:string,problem:string,value:variant,form:int>"
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})$"
UTC = r"(Z|\+00:00|-00:00)$"
#: Number of a form among those of its document.
NumberOf = Callable[["Form"], int]


def _row(path: Column, problem: Column, value: Column, form: Column) -> Column:
    return F.struct(path.alias("path"), problem.cast("string").alias("problem"), value.cast("variant").alias("value"), form.cast("int").alias("form"))


def _one(path: Column, problem: str) -> Column:
    return F.array(_wrong(path, problem))


def _wrong(path: Column, problem: str) -> Column:
    return _row(path, F.lit(problem), F.lit(None), F.lit(None))


def _within(path: Column, value: Column, form: Column) -> Column:
    return _row(path, F.lit(None), value, form)


def _none() -> Column:
    return F.array().cast(f"array<{ROW}>")


def _unless(ok: Column, path: Column, problem: str) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), _none()).otherwise(_one(path, problem))


def _kind(value: Column) -> Column:
    """The kind of a VARIANT value, without what is inside it."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


@dataclass(frozen=True)
class Value:
    """A value with its path and kind; what is in it as a map, if it is an object, or as an array, if it is a list."""

    path: Column
    value: Column
    kind: Column
    fields: Column
    items: Column


class Form:
    """What a value must be; ``check`` is an array of rows: what is wrong with the value, and the values inside it that are to be checked next."""

    def check(self, v: Value, number: NumberOf) -> Column:
        raise NotImplementedError

    def inside(self) -> Sequence[Form]:
        """The forms of the values inside."""
        return ()


@dataclass(frozen=True)
class Text(Form):
    """A string of ``least`` to ``most`` characters, not blank unless ``blank``, of a ``pattern`` where there is one."""

    least: int = 0
    most: int | None = None
    blank: bool = True
    pattern: str | None = None

    def check(self, v: Value, number: NumberOf) -> Column:
        text = F.try_variant_get(v.value, "$", "string")
        found = [_unless(F.length(text) >= self.least, v.path, "too short")] if self.least else []
        if self.most is not None:
            found.append(_unless(F.length(text) <= self.most, v.path, "too long"))
        if not self.blank:
            found.append(_unless(F.regexp_replace(text, r"(?U)^\s+", "") != "", v.path, "blank"))
        if self.pattern:
            found.append(_unless(text.rlike(self.pattern), v.path, "malformed"))
        return F.when(v.kind == "STRING", F.concat(*found) if found else _none()).otherwise(_one(v.path, "not a string"))


@dataclass(frozen=True)
class Instant(Form):
    """An ISO timestamp with an offset; with ``utc``, with none from UTC."""

    utc: bool = True

    def check(self, v: Value, number: NumberOf) -> Column:
        text = F.try_variant_get(v.value, "$", "string")
        real = text.rlike(INSTANT) & text.try_cast("timestamp").isNotNull()
        offset = _unless(text.rlike(UTC), v.path, "not in UTC") if self.utc else _none()
        return F.when(v.kind != "STRING", _one(v.path, "not a string")).when(real, offset).otherwise(_one(v.path, "not an instant"))


@dataclass(frozen=True)
class Number(Form):
    """A finite number between ``low`` and ``high``; NaN and infinities have no JSON form, and numbers beyond a double's range are refused."""

    low: float | None = None
    high: float | None = None

    def check(self, v: Value, number: NumberOf) -> Column:
        x = F.try_variant_get(v.value, "$", "double")
        found = [_unless(x.isNotNull() & (F.abs(x) < float("inf")), v.path, "not finite")]
        if self.low is not None or self.high is not None:
            low, high = (F.lit(True) if b is None else (x >= b if k == 0 else x <= b) for k, b in enumerate((self.low, self.high)))
            found.append(_unless(low & high, v.path, "out of bounds"))
        return F.when(v.kind.isin("BIGINT", "DECIMAL", "DOUBLE"), F.concat(*found)).otherwise(_one(v.path, "not a number"))


@dataclass(frozen=True)
class Flag(Form):
    def check(self, v: Value, number: NumberOf) -> Column:
        return _unless(v.kind == "BOOLEAN", v.path, "not a boolean")


@dataclass(frozen=True)
class Maybe(Form):
    """null, or ``form``."""

    form: Form

    def check(self, v: Value, number: NumberOf) -> Column:
        return F.when(F.is_variant_null(v.value), _none()).otherwise(self.form.check(v, number))

    def inside(self) -> Sequence[Form]:
        return self.form.inside()


def _at(path: Column, place: Column) -> Column:
    return F.concat(path, F.lit("["), place.cast("string"), F.lit("]"))


@dataclass(frozen=True)
class List(Form):
    """``least`` to ``most`` elements of one form."""

    form: Form
    least: int = 0
    most: int | None = None

    def check(self, v: Value, number: NumberOf) -> Column:
        each = F.transform(v.items, lambda x, i: _within(_at(v.path, i), x, F.lit(number(self.form))))
        short = _unless(F.size(v.items) >= self.least, v.path, "too few")
        long = _none() if self.most is None else _unless(F.size(v.items) <= self.most, v.path, "too many")
        return F.when(v.kind == "ARRAY", F.concat(short, long, each)).otherwise(_one(v.path, "not a list"))

    def inside(self) -> Sequence[Form]:
        return (self.form,)


@dataclass(frozen=True)
class Tuple(Form):
    """Exactly these elements."""

    forms: Sequence[Form]

    def check(self, v: Value, number: NumberOf) -> Column:
        numbers = F.array(*[F.lit(number(f)) for f in self.forms]).cast("array<int>")
        each = F.transform(v.items, lambda x, i: _within(_at(v.path, i), x, F.get(numbers, i)))
        sized = F.when(F.size(v.items) == len(self.forms), each).otherwise(_one(v.path, "wrong number of elements"))
        return F.when(v.kind == "ARRAY", sized).otherwise(_one(v.path, "not a list"))

    def inside(self) -> Sequence[Form]:
        return self.forms


@dataclass(frozen=True)
class Object(Form):
    """These keys and no others; those that are not ``optional`` must be there."""

    fields: Mapping[str, Form]
    optional: Sequence[str] = field(default_factory=tuple)

    def check(self, v: Value, number: NumberOf) -> Column:
        at = lambda name: F.concat(v.path, F.lit("."), name)
        strings = lambda names: F.array(*[F.lit(n) for n in names]).cast("array<string>")
        keys, known = F.map_keys(v.fields), strings(self.fields)
        unknown = F.transform(F.array_except(keys, known), lambda k: _wrong(at(k), "unknown key"))
        missing = F.transform(F.array_except(strings(n for n in self.fields if n not in self.optional), keys), lambda k: _wrong(at(k), "missing"))
        numbers = F.array(*[F.lit(number(f)) for f in self.fields.values()]).cast("array<int>")
        number_of = lambda key: F.get(numbers, F.array_position(known, key).cast("int") - 1)
        named = F.transform(F.map_entries(v.fields), lambda e: _within(at(e["key"]), e["value"], number_of(e["key"])))
        each = F.filter(named, lambda x: x["form"].isNotNull())
        return F.when(v.kind == "OBJECT", F.concat(unknown, missing, each)).otherwise(_one(v.path, "not an object"))

    def inside(self) -> Sequence[Form]:
        return list(self.fields.values())


def violations(df: DataFrame, column: str, form: Form, *keys: str) -> DataFrame:
    """``keys``, path, problem: everything in which the JSON texts of ``column`` differ from ``form``; a null text has none.

    Each level of the form is a pass over the rows of the one before; what was found wrong is handed on as it is.
    """
    own = [F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]
    held = [f"_key{i}" for i in range(len(keys))]
    c = F.col
    root = F.try_parse_json(column).alias("value")
    rows = df.filter(c(column).isNotNull()).select(*own, root)
    rows = rows.select(*held, F.lit("$").alias("path"), F.when(c("value").isNull(), "not JSON").alias("problem"), "value", F.lit(0).alias("form"))
    level = [form]
    while level:
        ahead: list[Form] = []
        for f in level:
            ahead.extend(g for g in f.inside() if g not in ahead)
        kind = F.when(c("problem").isNull(), _kind(c("value")))
        shaped = rows.select(*held, "path", "problem", "value", "form", kind.alias("kind"))
        shaped = shaped.select("*", F.when(c("kind") == "OBJECT", c("value").try_cast("map<string,variant>")).alias("fields"), F.when(c("kind") == "ARRAY", c("value").try_cast("array<variant>")).alias("items"))
        value = Value(c("path"), c("value"), c("kind"), c("fields"), c("items"))
        known = F.when(c("problem").isNotNull(), F.array(_row(c("path"), c("problem"), F.lit(None), F.lit(None))))
        checked = reduce(lambda case, i: case.when(c("form") == i, level[i].check(value, ahead.index)), range(len(level)), known)
        rows = shaped.select(*held, F.inline(checked))
        level = ahead
    return rows.select(*[c(h).alias(k) for h, k in zip(held, keys, strict=True)], "path", "problem")


_name, _version, _id = Text(1, 1000), Text(1, 100), Text(pattern=UUID)
_listed = Text(0, 1000, blank=False)
_score = Number(0, 1)

# The assessment request of the interface, its fields in order and their bounds.
ACCEPTANCE = Object({"evidence_id": _id, "authority": _name, "policy_reference": _name, "policy_version": _version, "accepted_at": Instant()})
SCORES = ("identity_score", "semantic_score", "assertion_score", "knowledge_score", "decision_score", "governance_score")
VERSIONS = ("identity_policy_version", "semantic_policy_version", "assertion_policy_version", "knowledge_policy_version", "decision_policy_version", "governance_policy_version")
NAMES = ("decision_policy_reference", "decision_policy_rule", "governance_policy_reference")


OBSERVATION = Object(
    {
        "observation_id": _id,
        "source_system_reference": _id,
        "source_record_reference": _name,
        "subject_type": Text(1, 200),
        "subject_id": _id,
        "observation_type": Text(1, 200),
        "value": _name,
        "severity": Text(pattern="^(LOW|MATERIAL|HIGH|CRITICAL)$"),
        "observed_at": Instant(),
        "evidence_reference": _name,
        "schema_version": Text(pattern=r"^1\.0$"),
        "conflicting": Flag(),
    },
    optional=("schema_version", "conflicting"),
)
ELIGIBILITY = Object({"supplier_entity_id": _id, **{n: Flag() for n in ("qualified", "approved", "contractually_eligible", "usable_capacity", "operationally_ready")}})
ASSESSMENT = Object(
    {
        "supplier_names": List(_listed, 1, 100),
        "source_object_ids": List(_id, 1, 100),
        "enterprise_candidates": List(Tuple((_id, Text())), 0, 100),
        "semantic_terms": List(_listed, 0, 100),
        "semantic_candidates": List(Tuple((_id, Text())), 0, 100),
        "context_id": _id,
        "material_id": _id,
        "facility_or_region_id": _id,
        "effective_at": Instant(),
        "observations": List(OBSERVATION, 1, 100),
        "supplier_eligibility": List(ELIGIBILITY, 0, 100),
        **{n: _score for n in SCORES},
        **{n: _version for n in VERSIONS},
        **{n: _name for n in NAMES},
        "acceptance_evidence": Maybe(ACCEPTANCE),
        "governance_conditions": List(_listed, 0, 100),
        "verified_conditions": List(_listed, 0, 100),
        "exceptional_policy_condition": Flag(),
    },
    optional=("acceptance_evidence", "governance_conditions", "verified_conditions", "exceptional_policy_condition"),
)
