"""Checks of model answers against a schema: the schema (DDL) and rules for single fields are compiled to one Column over VARIANT that lists every
fault with its path, so that answers are checked on the JVM, at any depth, without a parser of our own."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A field's rule: the words it may be, or its least and most.
Rule = tuple[str, ...] | tuple[int, int]
NONE = "array<struct<path: string, fault: string>>"


def _fault(path: Column, what: str) -> Column:
    return F.array(F.struct(path.alias("path"), F.lit(what).alias("fault")))


def _kind(value: Column) -> Column:
    """object, array, string, integer, number, boolean or null."""
    name = F.schema_of_variant(value)
    of = F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "STRING", "string").when(name == "BIGINT", "integer")
    return of.when(name.startswith("DECIMAL") | name.isin("DOUBLE", "FLOAT"), "number").when(name == "BOOLEAN", "boolean").otherwise("null")


def _compiled(kind: T.DataType, value: Column, path: Column, name: str, rules: Mapping[str, Rule]) -> Column:
    """The faults of a value; name: its path in the schema, list places left out."""
    none = F.array().cast(NONE)
    if isinstance(kind, T.StructType):
        found = F.try_variant_get(value, "$", "map<string,variant>")
        known = F.array(*[F.lit(f.name) for f in kind.fields])
        at = lambda k: F.concat(path, F.lit("."), k)
        told = lambda keys, what: F.transform(keys, lambda k: F.struct(at(k).alias("path"), F.lit(what).alias("fault")))
        parts = [told(F.array_sort(F.array_except(F.map_keys(found), known)), "unknown"), told(F.array_except(known, F.map_keys(found)), "missing")]
        for f in kind.fields:
            own = _compiled(f.dataType, F.try_element_at(found, F.lit(f.name)), at(F.lit(f.name)), f"{name}.{f.name}".lstrip("."), rules)
            parts.append(F.when(F.map_contains_key(found, f.name), own).otherwise(none))
        return F.when(_kind(value) == "object", F.flatten(F.array(*parts))).otherwise(_fault(path, "not an object"))
    if isinstance(kind, T.ArrayType):
        items = F.try_variant_get(value, "$", "array<variant>")
        each = lambda x, i: _compiled(kind.elementType, x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), name, rules)
        return F.when(_kind(value) == "array", F.flatten(F.transform(items, each))).otherwise(_fault(path, "not an array"))
    wanted, accepted = {T.StringType: ("a string", ["string"]), T.BooleanType: ("a boolean", ["boolean"])}.get(type(kind), ("an integer", ["integer"]) if isinstance(kind, T.IntegralType) else ("a number", ["integer", "number"]))
    fits = _kind(value).isin(*accepted)
    rule = rules.get(name)
    if rule is None:
        return F.when(fits, none).otherwise(_fault(path, f"not {wanted}"))
    if isinstance(rule[0], str):
        held = F.try_variant_get(value, "$", "string").isin(*rule)
        what = f"not one of {', '.join(rule)}"
    else:
        held = F.try_variant_get(value, "$", "double").between(*rule)
        what = f"not within {rule[0]} and {rule[1]}"
    return F.when(~fits, _fault(path, f"not {wanted}")).when(~held, _fault(path, what)).otherwise(none)


def faults(answer: Column | str, schema: str, rules: Mapping[str, Rule] | None = None) -> Column:
    """array<struct<path, fault>> of a JSON text: unknown and missing keys, values of another kind, words that a rule does not know and numbers out of
    bounds, at any depth, in the schema's order. Paths begin at $; list places are counted from 0. rules: by dotted field, as `scores.unity`.
    A null or broken text is one fault."""
    answer = F.col(answer) if isinstance(answer, str) else answer
    value = F.try_parse_json(answer)
    found = _compiled(T.StructType.fromDDL(schema), value, F.lit("$"), "", rules or {})
    return F.when(value.isNull(), _fault(F.lit("$"), "no JSON")).otherwise(found)


def checked(answers: DataFrame, schema: str, rules: Mapping[str, Rule] | None = None, column: str = "answer") -> DataFrame:
    """answers with a row for each fault: their columns but the text, path, fault."""
    keys = [c for c in answers.columns if c != column]
    # made once: what an explode has made is filtered after it
    return answers.select(*keys, F.explode(faults(column, schema, rules)).alias("_f")).select(*keys, "_f.path", "_f.fault")
