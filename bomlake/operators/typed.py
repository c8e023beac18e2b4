"""Typed fields of a component from and to its property map, by one table that both directions read.

A component has `origin` (text, '' without), `layer` (struct of digest, index, line, added_by; null without) and
`cpes` (the first is the component's own field, further ones are numbered properties). Null maps count as empty.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from bomlake.operators.properties import held, once

#: What keys of this library's own properties start with.
PREFIX = "bom:"
LAYER = "struct<digest:string,index:int,line:string,added_by:string>"


class Field(NamedTuple):
    key: str
    path: tuple[str, ...]
    kind: str  # text: written unless empty; number: always written, 0 where it can't be read


#: Key after the prefix, place in the component, kind.
FIELDS = (
    Field("origin", ("origin",), "text"),
    Field("layer:digest", ("layer", "digest"), "text"),
    Field("layer:index", ("layer", "index"), "number"),
    Field("layer:dockerfile-line", ("layer", "line"), "text"),
    Field("layer:added-by", ("layer", "added_by"), "text"),
)
#: Keys of the further CPE names, numbered from 1.
NUMBERED = "cpe:"


def dehydrated(props: Column, origin: Column, layer: Column, cpes: Column | None = None) -> Column:
    """The map with the typed fields as properties, which win over entries of the same key.

    cpes: all names where further ones are to be numbered.
    """
    value = {"origin": origin, "layer": layer}

    def entry(f: Field) -> Column:
        v = reduce(lambda c, name: c[name], f.path[1:], value[f.path[0]])
        text = F.coalesce(v.cast("string"), F.lit("" if f.kind == "text" else "0"))
        there = value[f.path[0]].isNotNull() & ((text != "") if f.kind == "text" else F.lit(True))
        return F.when(there, F.struct(F.lit(PREFIX + f.key).alias("key"), text.alias("value")))

    own = F.filter(F.array(*map(entry, FIELDS)), lambda e: e.isNotNull())
    if cpes is not None:
        more = F.slice(cpes, 2, F.greatest(F.size(cpes) - 1, F.lit(0)))
        own = F.concat(own, F.coalesce(F.transform(more, lambda c, i: F.struct(F.concat(F.lit(PREFIX + NUMBERED), i + 1).alias("key"), c.alias("value"))), F.array().cast("array<struct<key:string,value:string>>")))
    return once(F.map_from_entries(own), lambda typed: F.map_concat(F.map_filter(held(props), lambda k, _: ~F.array_contains(F.map_keys(typed), k)), typed))


def hydrated(props: Column, numbered: bool = True) -> Column:
    """struct(origin, layer, cpes, props) that a map tells; keys that were read are gone from it.

    An index that is no number counts as 0 and goes, too. With `numbered` all keys of the CPE prefix are CPE names, in order of
    their numbers and then their keys. A layer is there if any of its keys is.
    """
    return once(held(props), lambda own: _read(own, numbered))


def _read(own: Column, numbered: bool) -> Column:
    keys = [PREFIX + f.key for f in FIELDS]
    of = lambda f: F.try_element_at(own, F.lit(PREFIX + f.key))
    layer = [f for f in FIELDS if f.path[0] == "layer"]
    read = lambda f: F.coalesce(of(f).try_cast("int"), F.lit(0)) if f.kind == "number" else F.coalesce(of(f), F.lit(""))
    there = reduce(lambda a, b: a | b, [F.map_contains_key(own, PREFIX + f.key) for f in layer])
    more = F.map_filter(own, lambda k, _: k.startswith(PREFIX + NUMBERED) & F.lit(numbered))
    order = F.transform(F.map_entries(more), lambda e: F.struct(F.coalesce(F.substring(e["key"], len(PREFIX + NUMBERED) + 1, 20).try_cast("int"), F.lit(2**31 - 1)).alias("n"), e["key"].alias("key"), e["value"].alias("value")))
    rest = F.map_filter(own, lambda k, _: ~(k.isin(*keys) | k.startswith(PREFIX + NUMBERED) & F.lit(numbered)))
    return F.struct(
        F.coalesce(of(FIELDS[0]), F.lit("")).alias("origin"),
        F.when(there, F.struct(*[read(f).alias(f.path[1]) for f in layer])).cast(LAYER).alias("layer"),
        F.transform(F.array_sort(order), lambda e: e["value"]).alias("cpes"),
        rest.alias("props"),
    )
