"""Text formats: log lines, probe output, commands, file names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of the log's messages and of the interpolator's completion lines (fixed formats).
DUPLICATE = r"Found duplicate at #(\d+)"
CHAIN = (
    r"Duplicate chain (\d+) found #(\d+)-#(\d+), length: (\d+), (?:diff: (\d+\.\d+), end_conf: (\d+\.\d+)|.+), chain_motion: (\d+\.\d+), "
    r"state: (\w*)(?: \{ n_additional: (\d+) \})?(?: at (\d+\.\d+)s)?"
)
SKIPPED = r"Skipping duplicate chain #(\d+)-#(\d+): #(\w+), state: (\w+)"
PROCESSING = r'Processing: "([^"]+)"(?: to "([^"]+)")?'
COMPLETION = r"^(\S+) (\S+) ([01]\.\d+) -> (.+?) done(?: \(q - (\d+\.\d+)%\))?$"


def group(text: Column, pattern: str, n: int) -> Column:
    """A group of a pattern's match; null if the pattern or the group doesn't match."""
    return F.nullif(F.regexp_extract(text, pattern, n), F.lit(""))


def log_line(level: Column, message: Column) -> Column:
    return F.concat(F.lit("["), level, F.lit("] "), message)


def _entries(pairs: Column) -> Column:
    """Texts key=value as a map: each is cut at its first =, those without one are left out, and of a key that comes more
    than once the last counts."""
    whole = F.filter(pairs, lambda x: F.contains(x, F.lit("=")))
    cut = F.transform(whole, lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.substr(x, F.length(F.substring_index(x, "=", 1)) + 2).alias("value")))

    def last(both: Column) -> Column:
        return F.filter(both["cut"], lambda e, i: i == F.size(both["cut"]) - F.array_position(both["keys"], e["key"]))

    found = _let(cut, lambda c: _let(F.struct(c.alias("cut"), F.reverse(F.transform(c, lambda e: e["key"])).alias("keys")), last))
    return F.map_from_entries(found)


def key_values(text: Column) -> Column:
    """Lines key=value as a map; the last line of a key counts."""
    return _entries(F.split(text, r"\r?\n"))


def fraction(text: Column) -> Column:
    """num/den as a number; 0 if den is 0, den is 1 if it is missing."""
    parts = F.split(text, "/", 2)
    num, den = F.get(parts, F.lit(0)).try_cast("double"), F.coalesce(F.get(parts, F.lit(1)).try_cast("double"), F.lit(1.0))
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def command(kind: Column, *args: Column) -> Column:
    return F.concat_ws("|", kind, *args)


#: An element of a list: in quotes, or without any quote, bracket or comma.
_ELEMENT = r"""(?:'[^']*'|"[^"]*"|[^\s,'"()\[\]](?:[^,'"()\[\]]*[^\s,'"()\[\]])?)"""
_ELEMENTS = rf"""^[\[(]\s*(?:{_ELEMENT}\s*(?:,\s*{_ELEMENT}\s*)*,?)?\s*[\])]$"""


def kwargs(text: Column) -> Column:
    """k=v,k=v as a map of literals; commas in brackets or quotes don't separate."""
    return kwargs_of(F.regexp_extract_all(text, F.lit(r"""((?:'[^']*'|"[^"]*"|\[[^\]]*\]|\([^)]*\)|[^,])+)"""), F.lit(1)))


def kwargs_of(args: Column) -> Column:
    """An array of k=v as a map of literals (see literal()); the last one of a key counts."""
    return F.transform_values(_entries(args), lambda _, v: literal(v))


def literal(value: Column) -> Column:
    """The literal that a text is, as a struct (kind, int, float, bool, str, items); only the field of its kind isn't null.

    Kinds are int, float, bool, none, list, tuple and str. Elements of a list or a tuple are in items, as structs without
    items of their own. A value in quotes, or one that is no literal, stays text, the first without its quotes; so does a
    list with another in it.
    """
    return _let(F.trim(value), lambda v: F.when(v.rlike(r"^[\[(]"), _listed(value, v)).otherwise(_alone(value, v)))


def _alone(value: Column, v: Column) -> Column:
    """A literal without elements; v is value without spaces around it."""
    return _let(_scalar(value, v), lambda one: F.struct(*(one[c].alias(c) for c in _FIELDS), F.lit(None).cast(f"array<{_SCALAR}>").alias("items")))


def _listed(value: Column, v: Column) -> Column:
    """A literal that begins with a bracket. Elements are looked for once."""
    raw = F.regexp_extract_all(F.substr(v, F.lit(2), F.length(v) - 2), F.lit(f"({_ELEMENT})"), F.lit(1))
    found = F.transform(raw, lambda x: _let(F.trim(x), lambda y: F.struct(_scalar(x, y).alias("item"), x.rlike(_QUOTED).alias("quoted"))))

    def made(parts: Column) -> Column:
        items = F.transform(parts, lambda p: p["item"])
        sound = v.rlike(_ELEMENTS) & ~F.exists(parts, lambda p: (p["item"]["kind"] == "str") & ~p["quoted"])
        alone = F.startswith(v, F.lit("(")) & ~F.contains(v, F.lit(",")) & (F.size(parts) == 1)  # brackets around one value
        kind = F.when(sound & F.startswith(v, F.lit("[")) & F.endswith(v, F.lit("]")), "list").when(sound & F.startswith(v, F.lit("(")) & F.endswith(v, F.lit(")")), "tuple")
        facts = F.struct(kind.alias("kind"), alone.alias("alone"), items.alias("items"))
        return _let(facts, lambda f: F.when(f["kind"].isNull(), _alone(value, v)).when((f["kind"] == "tuple") & f["alone"], of_one(F.get(f["items"], F.lit(0)))).otherwise(of_many(f)))

    def of_one(one: Column) -> Column:
        return F.struct(*(one[c].alias(c) for c in _FIELDS), F.lit(None).cast(f"array<{_SCALAR}>").alias("items"))

    def of_many(f: Column) -> Column:
        return F.struct(f["kind"].alias("kind"), *(F.lit(None).cast(kind).alias(c) for c, kind in list(_FIELDS.items())[1:]), f["items"].alias("items"))

    return _let(found, made)


_FIELDS = {"kind": "string", "int": "bigint", "float": "double", "bool": "boolean", "str": "string"}
_SCALAR = "struct<" + ", ".join(f"`{c}`: {kind}" for c, kind in _FIELDS.items()) + ">"
_QUOTED = r"""^(?:'[^']*'|"[^"]*")$"""


def _scalar(value: Column, v: Column) -> Column:
    """A literal that is neither list nor tuple; v is value without spaces around it."""
    kind = (
        F.when(v.rlike(r"^[+-]?\d+$") & v.try_cast("long").isNotNull(), "int")
        .when(v.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), "float")
        .when(v.isin("True", "False"), "bool")
        .when(v == "None", "none")
        .otherwise("str")
    )

    def made(kind: Column) -> Column:
        text = F.when(v.rlike(_QUOTED), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(value)
        return F.struct(
            kind.alias("kind"),
            F.when(kind == "int", v.try_cast("long")).alias("int"),
            F.when(kind == "float", v.try_cast("double")).alias("float"),
            F.when(kind == "bool", v == "True").alias("bool"),
            F.when(kind == "str", text).alias("str"),
        )

    return _let(kind, made)


def resolution(text: Column) -> Column:
    """WIDTHxHEIGHT as a struct of two whole numbers; null if it isn't that."""
    parts = F.split(text, "x", 2)
    w, h = F.get(parts, F.lit(0)).try_cast("int"), F.get(parts, F.lit(1)).try_cast("int")
    return F.when(w.isNotNull() & h.isNotNull(), F.struct(w.alias("width"), h.alias("height")))


def frame_name(frame: Column, digits: int = 5) -> Column:
    """A frame's file name; longer numbers keep all their digits."""
    return F.format_string(f"%0{digits}d.png", frame)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fixed(x: Column, digits: int) -> Column:
    """A number with some digits after the point, four at most: its exact value is rounded, a tie to the even digit.

    A double times a small power of ten isn't a double. Its upper and its lower half times that are, so that what is over a
    whole number and a half is known exactly.
    """
    scale = float(10**digits)

    def halves(size: Column) -> Column:
        upper = size * 134217729.0 - (size * 134217729.0 - size)  # its first 26 bits
        return F.struct((upper * scale).alias("a"), ((size - upper) * scale).alias("b"))

    def rounded(p: Column) -> Column:
        def nearest(n: Column) -> Column:
            over = (p["a"] - n - 0.5) + p["b"]
            return n + F.when((over > 0) | (over == 0) & (n % 2 == 1), 1).otherwise(0)

        return _let(F.floor(p["a"] + p["b"]), nearest)

    def written(v: Column) -> Column:
        number = _let(_let(halves(F.abs(v)), rounded), lambda n: F.concat(F.call_function("div", n, F.lit(10**digits)).cast("string"), F.lit("."), F.lpad((n % 10**digits).cast("string"), digits, "0")))
        text = F.concat(F.when(v < 0, "-").otherwise(""), number)
        large = F.format_string(f"%.{digits}f", v)  # no fraction of these is near a half of the last digit
        return F.when(F.isnan(v), "NaN").when(F.abs(v) == float("inf"), F.when(v < 0, "-inf").otherwise("inf")).when(F.abs(v) >= 1e15, large).otherwise(F.when(v.isNotNull(), text))

    return _let(x.cast("double"), written)


def parent(path: Column) -> Column:
    """A path without its last part."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def with_extension(path: Column, extension: str) -> Column:
    """A path with another extension; one is added where there is none."""
    return F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", ""), F.lit(f".{extension}"))


def denied(args: Column, deny: list[str]) -> Column:
    """Whether any of an array of arguments is one that must not be given."""
    return F.arrays_overlap(args, F.array(*map(F.lit, deny)))
