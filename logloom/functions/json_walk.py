"""Nested variants of any depth, by their JSON text inside one expression.

A variant column has no recursive functions, and an expression nested level by level ends at some level. To flatten, the members of a value are a flat array; an aggregate over it keeps the open objects and
lists as a stack. To prune, the text is swept by one pattern until nothing changes. JSON text made from a variant is well formed and without blanks between tokens, so no token is unexpected.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_PLAIN = rf'(?:{_STRING}|[^\s{{}}\[\],:"]++)'
_MEMBER = rf'(?:({_STRING}):)?+(\[(?:{_PLAIN}(?:,{_PLAIN})*+)?+\]|[{{}}\[\]]|{_PLAIN})'  # name, and a list of plain values, a bracket or a plain value
_ENTRIES = "array<struct<key:string,value:string>>"
_FLAT = f"struct<open:array<struct<list:boolean,path:string,i:int>>,out:{_ENTRIES}>"


def _text(token: Column) -> Column:
    """Text of a scalar token; NULL for null."""
    escaped = F.try_variant_get(F.try_parse_json(token), "$", "string")
    return F.when(token.startswith('"'), F.when(token.contains("\\"), escaped).otherwise(F.substring(token, F.lit(2), F.length(token) - 2))).when(token != "null", token)


def flat_entries(v: Column) -> Column:
    """Array of (key, value) of the leaves below a nested variant; keys begin with a dot. A list of plain values is one leaf, joined by ', '; other lists count their members.

    A token is a whole member or a closing bracket, a list of plain values included, so there are few steps; an open object or list keeps its path.
    """
    text = F.to_json(v)
    names, bodies = (F.regexp_extract_all(text, F.lit(_MEMBER), F.lit(i)) for i in (1, 2))

    def step(s: Column, e: Column) -> Column:
        t, top = e["body"], F.get(s["open"], F.size(s["open"]) - 1)
        opens, closes = t.isin("{", "["), t.isin("}", "]")
        below = F.slice(s["open"], F.lit(1), F.greatest(F.size(s["open"]) - 1, F.lit(0)))
        path = F.when(F.size(s["open"]) == 0, "").otherwise(F.concat(top["path"], F.lit("."), F.when(top["list"], top["i"].cast("string")).otherwise(_text(e["name"]))))
        counted = F.when(top["list"], F.concat(below, F.array(F.struct(top["list"].alias("list"), top["path"].alias("path"), (top["i"] + 1).alias("i"))))).otherwise(s["open"])
        fresh = F.struct((t == "[").alias("list"), path.alias("path"), F.lit(0).alias("i"))
        joined = F.array_join(F.transform(F.regexp_extract_all(F.substring(t, F.lit(2), F.length(t) - 2), F.lit(_PLAIN), F.lit(0)), _text), ", ")
        leaf = F.struct(path.alias("key"), F.when(t.startswith("["), joined).otherwise(_text(t)).alias("value"))
        return F.struct(F.when(closes, below).when(opens, F.concat(counted, F.array(fresh))).otherwise(counted).alias("open"),
                        F.when(opens | closes | (t == "[]"), s["out"]).otherwise(F.concat(s["out"], F.array(leaf))).alias("out"))

    members = F.transform(F.arrays_zip(names.alias("name"), bodies.alias("body")), lambda e: F.struct(e["name"].alias("name"), e["body"].alias("body")))
    return F.aggregate(members, F.struct(F.array(), F.array()).cast(_FLAT), step, lambda s: s["out"])


_EMPTY = r'(?:null|"-?"|\[\]|\{\})'
_MAY_BE_EMPTY = _EMPTY  # JSON text without any of these holds no empty member
_GONE = rf'(?:{_STRING}:)?+{_EMPTY}(?:,(?:{_STRING}:)?+{_EMPTY})*+'  # neighbouring empty members
# with the comma after them, the one before them, or none; other strings are matched whole and stay, so nothing inside one is taken for a member
_SWEEP = rf'(?<=[{{\[,]){_GONE},|,{_GONE}(?=[}}\]])|(?<=[{{\[]){_GONE}(?=[}}\]])|({_STRING})'


def pruned_inside(v: Column) -> Column:
    """An object or list without empty members (null, '', '-', and lists and objects that hold nothing else) at any depth, NULL when nothing is left; anything else as it is. Only what may hold one is swept."""
    kept = lambda t: F.when(t.rlike(r"\A[\[{]") & t.rlike(_MAY_BE_EMPTY), _swept(t)).otherwise(v)
    return F.get(F.transform(F.array(F.to_json(v)), kept), F.lit(0))  # the text is made once, as the variable of the function


def _swept(text: Column) -> Column:
    """Sweeps take empty members out of the text until nothing changes: one for each level that becomes empty by the one before, and a last one."""
    def step(s: Column, _: Column) -> Column:
        swept = F.struct(F.regexp_replace(s["text"], _SWEEP, "$1").alias("text"), F.length(s["text"]).alias("before"))
        return F.when(F.length(s["text"]) == s["before"], s).otherwise(swept)

    lists_and_objects = F.length(text) - F.length(F.replace(F.replace(text, F.lit("{")), F.lit("[")))
    start = F.struct(text.alias("text"), F.lit(-1).alias("before"))
    return F.aggregate(F.sequence(F.lit(0), lists_and_objects), start, step, lambda s: F.when(~s["text"].isin("{}", "[]"), F.try_parse_json(s["text"])))
