"""Reading values out of JSON text without schema inference.

Inference would merge and sort field names; which field comes first and whether a field
is missing or null both carry meaning here, so records stay raw text. Values are read by
name into a struct, where the last duplicate of a field wins (a map would return the first).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatprep.functions.text import or_empty

# A JSON value whose text begins with none of these can only have been a string.
_MAYBE_NOT_STRING = r"^[\[{\-0-9tf]"


def _quoted(key: str) -> str:
    return "`" + key.replace("`", "``") + "`"


def fields(raw: Column, *keys: str) -> Column:
    """The named fields as text, in one parse; null where missing, null or not an object."""
    return F.from_json(raw, "struct<" + ", ".join(f"{_quoted(k)}: string" for k in keys) + ">")


def keys_of(raw: Column) -> Column:
    """Field names in source order; null for anything but an object."""
    return F.json_object_keys(raw)


def is_object(raw: Column) -> Column:
    return keys_of(raw).isNotNull()


def has_field(raw: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(keys_of(raw), key), F.lit(False))


def list_under(raw: Column, key: str) -> Column:
    """Raw elements of the list under `key`; null when the value is not a list."""
    return F.from_json(raw, f"struct<{_quoted(key)}: array<string>>")[key]


def root_list(raw: Column) -> Column:
    return F.from_json(raw, "array<string>")


def root_kind(raw: Column) -> Column:
    """Variant type name of a whole document, null when it does not parse."""
    return F.schema_of_variant(F.try_parse_json(raw))


def kind_under(raw: Column, key: str) -> Column:
    """Variant type name of the value under `key`."""
    return F.schema_of_variant(F.from_json(raw, f"struct<{_quoted(key)}: variant>")[key])


def kinds(raw: Column) -> Column:
    """Field name -> variant, to ask for the type of a field known only at run time."""
    return F.from_json(raw, "map<string,variant>")


def _kind_matches(raw: Column, key: str, kind: str, in_doubt: bool) -> Column:
    return F.coalesce(kind_under(raw, key).startswith(kind), F.lit(in_doubt))


def is_text(raw: Column, text: Column, key: str) -> Column:
    """Whether the value under `key` (printed as `text`) is a JSON string.

    Types are parsed only where the printed form leaves a doubt.
    """
    return (
        F.when(text.isNull(), False)
        .when(~text.rlike(_MAYBE_NOT_STRING), True)
        .otherwise(_kind_matches(raw, key, "STRING", True))
    )


def printed(raw: Column, text: Column, key: str) -> Column:
    """The value as text: missing '', null None, booleans capitalised, nested as JSON."""
    return (
        F.when(text.isNull(), F.when(has_field(raw, key), "None").otherwise(""))
        .when(text.isin("true", "false") & _kind_matches(raw, key, "BOOLEAN", False), F.initcap(text))
        .otherwise(text)
    )


def printed_parts(raw: Column, text: Column, key: str) -> Column:
    """Like `printed`, but a list of `{text}` parts becomes their texts joined."""
    texts = F.transform(root_list(text), lambda part: F.coalesce(fields(part, "text")["text"], F.lit("")))
    is_list = text.startswith("[") & _kind_matches(raw, key, "ARRAY", False)
    return F.when(F.coalesce(is_list, F.lit(False)), F.array_join(texts, "")).otherwise(printed(raw, text, key))


def with_objects(
    df: DataFrame, out: str, key: str, plain: tuple = (), shown: tuple = (), parts: tuple = (), raw: str = "raw", there: str | None = None
) -> DataFrame:
    """Adds `out`: the objects in the list under `key` as structs of text, null for other elements.

    `plain` fields come as they are, `shown` ones through `printed`, `parts` ones through
    `printed_parts`. One typed parse reads the list; only where its outcome leaves a doubt
    (an element that is no object, a text that may not have been a string) are the elements
    read one by one. Null when the value is no list.

    A record whose text has no `null` holds none: what the typed parse does not find there is
    missing. `there`, if named, tells for each element whether it has the first field that is
    `shown` or one of `parts`; null where only the elements themselves can tell.
    """
    names = [*plain, *shown, *parts]
    element = "struct<" + ", ".join(f"{_quoted(n)}: string" for n in names) + ">"
    typed = F.from_json(raw, f"struct<{_quoted(key)}: array<{element}>>")[key]

    no_null = ~F.col(raw).contains("null")

    def doubtful(e: Column) -> Column:
        found = e.isNull() if (shown or parts) else F.lit(False)
        for name in (*shown, *parts):
            text = e[name]
            found = found | (text.isNull() & ~F.col("_no_null")) | F.coalesce(text.isin("true", "false"), F.lit(False))
            if name in parts:
                found = found | F.coalesce(text.startswith("["), F.lit(False))
        return found

    def certain(e: Column) -> Column:
        return F.struct(*[e[n].alias(n) for n in plain], *[or_empty(e[n]).alias(n) for n in (*shown, *parts)])

    def one(p: Column) -> Column:
        text = p["fields"]
        values = [text[n].alias(n) for n in plain]
        values += [printed(p["raw"], text[n], n).alias(n) for n in shown]
        values += [printed_parts(p["raw"], text[n], n).alias(n) for n in parts]
        return F.when(is_object(p["raw"]), F.struct(*values))

    # The inner pass parses an element once, the outer one reads its fields many times.
    parsed = F.transform(list_under(F.col(raw), key), lambda e: F.struct(e.alias("raw"), fields(e, *names).alias("fields")))
    sure = F.col("_typed").isNotNull() & ~F.exists("_typed", doubtful)
    known = F.transform("_typed", certain).cast(f"array<{element}>") if shown or parts else F.col("_typed")
    chosen = F.when(F.col("_sure"), known).otherwise(F.transform(parsed, one).cast(f"array<{element}>"))
    found = df.withColumn("_typed", typed).withColumn("_no_null", no_null).withColumn("_sure", sure).withColumn(out, chosen)
    if there:
        first = [*shown, *parts][0]
        found = found.withColumn(there, F.when(F.col("_sure"), F.transform("_typed", lambda e: e[first].isNotNull())))
    return found.drop("_typed", "_no_null", "_sure")
