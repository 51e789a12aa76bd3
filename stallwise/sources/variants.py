"""JSON lists whose elements have more fields than the table declares: kept as they came, as VARIANT.

``hydrate`` reads a list into its declared shape and forgets the rest. Here a list stays whole: known fields are read by name and type, unknown ones
are listed, known ones can be set, and what is written back has all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

_ELEMENTS, _FIELDS = "array<variant>", "map<string,variant>"


def elements(text: Column) -> Column:
    """The elements of a JSON list; text that does not parse, or is no list, gives none."""
    none = F.array().cast(_ELEMENTS)
    return F.coalesce(F.try_variant_get(F.try_parse_json(text), "$", _ELEMENTS), none)


def known(element: Column, shape: T.StructType) -> Column:
    """The declared fields of an element; one that is absent or of another type is NULL."""
    return F.struct(*(F.try_variant_get(element, f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in shape.fields))


def unknown(element: Column, shape: T.StructType) -> Column:
    """The other fields, by name; elements that are no objects have none."""
    fields = F.coalesce(F.try_variant_get(element, "$", _FIELDS), F.create_map().cast(_FIELDS))
    return F.map_filter(fields, lambda name, _: ~name.isin(shape.fieldNames()))


def with_known(element: Column, values: Column, shape: T.StructType) -> Column:
    """The element as JSON text with its known fields set to those of ``values`` (NULL ones are left out) and its unknown fields as they came."""
    # a list of one, so that each text is made once: outside of a lambda it would be made anew wherever it is named
    texts = F.array(F.struct(F.to_json(values).alias("own"), F.to_json(unknown(element, shape)).alias("rest")))

    def joined(text: Column) -> Column:
        own, rest = text["own"], text["rest"]
        # two objects without a name in common, put together as text
        both = F.concat(F.substring(own, F.lit(1), F.length(own) - 1), F.lit(","), F.substring(rest, F.lit(2), F.length(rest)))
        return F.when(rest == "{}", own).when(own == "{}", rest).otherwise(both)

    return F.transform(texts, joined)[0]


def listed(texts: Column) -> Column:
    """JSON text of a list of JSON texts."""
    return F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))
