"""Checks on the JSON text of event properties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from footfall.functions.text import let, utf16_length
from footfall.model import (
    PROP_BYTES_MAX,
    PROP_DEPTH_MAX,
    PROP_KEY_MAX,
    PROP_KEYS_MAX,
    PROP_STRING_MAX,
)

# One match per string (a key keeps its colon) or bracket of a JSON text.
_TOKEN = r'"(?:[^"\\]|\\.)*+":?|[\[\]{}]'
_ESCAPE = r"\\(?:u[0-9a-fA-F]{4}|.)"
# Text this short without a nested container cannot break any limit.
_SAFE_BYTES = 64
# A blank that compact JSON would not have (or one in a string that looks like it), or an escape.
_LOOSE = r"[{,:]\s|\s[},:]|\\"
_INFINITE = ['"Infinity"', '"-Infinity"']
_OVERFLOW = r"\d(?:[eE]\+?\d{3}|\d{308})"


# Containers in this depth of a body lose their content; text with so many brackets is looked at. They are counted once,
# from the start, and not from every bracket on.
_DEEP, _MANY = 40, r"^[^\[{]*+(?:[\[{][^\[{]*+){400}"
_PIECE = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[\[\]{}]|[^"\[\]{}]++'
# Pieces whose kept text is put together at a time.
_RUN = 128


def _change(piece: Column) -> Column:
    """What a piece of JSON text does to the depth."""
    return F.when(piece.isin("{", "["), 1).when(piece.isin("}", "]"), -1).otherwise(0)


def shallow(text: Column) -> Column:
    """JSON text of which containers in a depth of ``_DEEP`` are empty; most text is kept by a look at its brackets.

    The parser refuses text of some hundred levels as a whole. Text that is no JSON stays none. The deepest place
    is found by counting; only text that is too deep there is put together anew, in runs of pieces, each
    from the depth at its start: so the work grows with the length of the text.
    """
    zero = F.lit(0)
    start = F.struct(zero.alias("depth"), zero.alias("most"))

    def count(state: Column, piece: Column) -> Column:
        depth = state["depth"] + _change(piece)
        return F.struct(depth.alias("depth"), F.greatest(state["most"], depth).alias("most"))

    def cut(pieces: Column) -> Column:
        return let(_runs(pieces), lambda r: F.array_join(F.transform(F.arrays_zip(r.alias("run"), _starts(r).alias("depth")), _kept), ""))

    pieces = F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))
    looked_at = let(pieces, lambda p: F.when(F.aggregate(p, start, count)["most"] > _DEEP, cut(p)))
    return F.coalesce(F.when(text.rlike(_MANY), looked_at), text)


def _runs(pieces: Column) -> Column:
    """The pieces in runs of ``_RUN``."""
    last = F.floor(F.greatest(F.size(pieces) - 1, F.lit(0)) / _RUN).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda n: F.slice(pieces, n * _RUN + 1, _RUN))


def _starts(runs: Column) -> Column:
    """The depth before each run."""
    changes = F.transform(runs, lambda run: F.aggregate(run, F.lit(0), lambda depth, piece: depth + _change(piece)))
    return F.aggregate(changes, F.array(F.lit(0)), lambda depths, change: F.array_append(depths, F.element_at(depths, -1) + change))


def _kept(part: Column) -> Column:
    """The text of a run without what lies deeper than ``_DEEP``; of a container in that depth, the brackets."""
    start = F.struct(part["depth"].alias("depth"), F.lit("").alias("kept"))

    def step(state: Column, piece: Column) -> Column:
        change = _change(piece)
        inside = state["depth"] + F.when(change > 0, 1).otherwise(0)
        goes = (inside > _DEEP) | ((inside == _DEEP) & (change == 0))
        kept = F.when(goes, state["kept"]).otherwise(F.concat(state["kept"], piece))
        return F.struct((state["depth"] + change).alias("depth"), kept.alias("kept"))

    return F.when(part["run"].isNull(), "").otherwise(F.aggregate(part["run"], start, step)["kept"])


def is_small_and_flat(text: Column) -> Column:
    return (F.octet_length(text) <= _SAFE_BYTES) & ~F.substring(text, 2, _SAFE_BYTES).rlike(r"[\[{]")


def may_overflow(body: Column) -> Column:
    """Whether JSON text has a number that may not fit a double."""
    return body.rlike(_OVERFLOW)


def properties_error(text: Column, overflow: Column) -> Column:
    """First broken limit of a properties object in document order, or NULL.

    ``text`` is the object as compact JSON, in which a number that does not fit a double
    reads "Infinity"; ``overflow`` tells whether its source has such numbers. The tokens are folded left to right with the open depth and the number of keys so far;
    brackets below ``PROP_DEPTH_MAX`` or keys beyond ``PROP_KEYS_MAX`` are errors.
    """
    start = F.struct(
        F.lit(0).alias("depth"), F.lit(0).alias("keys"), F.lit(None).cast("string").alias("code")
    )

    def step(state: Column, token: Column) -> Column:
        opens, closes = token.isin("{", "["), token.isin("}", "]")
        is_key = token.endswith(":")
        quotes = F.when(is_key, 3).otherwise(2)
        units = utf16_length(F.regexp_replace(token, _ESCAPE, "x")) - quotes
        keys = state["keys"] + F.when(is_key, 1).otherwise(0)
        code = (
            F.when(opens & (state["depth"] >= PROP_DEPTH_MAX), "PROP_DEPTH_EXCEEDED")
            .when(opens | closes, None)
            .when(is_key & (keys > PROP_KEYS_MAX), "PROP_KEY_COUNT_EXCEEDED")
            .when(is_key & (units > PROP_KEY_MAX), "PROP_KEY_TOO_LONG")
            .when(~is_key & (units > PROP_STRING_MAX), "PROP_VALUE_TOO_LONG")
            .when(~is_key & overflow & token.isin(_INFINITE), "INVALID_PROPERTY_VALUE")
        )
        depth = state["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        return F.struct(
            depth.cast("int").alias("depth"),
            keys.cast("int").alias("keys"),
            F.coalesce(state["code"], code).alias("code"),
        )

    folded = F.aggregate(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), start, step)
    return F.when(~is_small_and_flat(text) | overflow, F.coalesce(
        folded["code"],
        F.when(F.octet_length(text) > PROP_BYTES_MAX, "PROP_SIZE_EXCEEDED"),
    ))


# One match per string (a key with its colon), bracket or other value; blanks and commas are left out.
_VALUE = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*+:)?|[\[\]{}]|[^\s"\[\]{},:]++'
_UNIT = r"(?s)^(?:\\u[0-9a-fA-F]{4}|\\.|[^\\]){0,%d}+"
_HALF = r"(?:[\x{10000}-\x{10FFFF}]|\\u[dD][89abAB][0-9a-fA-F]{2})$"
_FILLER = "\uffff"
# A surrogate's escape; an escaped backslash before such letters is none.
_SURROGATE = r"(\\\\)|\\u[dD][89a-fA-F][0-9a-fA-F]{2}"
_ITEMS_MAX = 50
# An open container that is kept: whether it is a list, its values so far, and how many objects deep it is.
_STACK = "array<struct<is_list: boolean, count: int, level: int>>"


def _cut_text(body: Column, units: int) -> Column:
    """The first UTF-16 units of the inside of a JSON string, in the spelling it was sent in; half characters go."""
    spaced = F.regexp_replace(body, r"([\x{10000}-\x{10FFFF}])", f"$1{_FILLER}")
    cut = let(spaced, lambda s: let(F.regexp_extract(s, _UNIT % units, 0), lambda c: F.when(c == s, s).otherwise(F.regexp_replace(c, _HALF, ""))))
    return F.when(F.octet_length(body) <= units, body).otherwise(F.regexp_replace(cut, _FILLER, ""))


def _next(state: Column, token: Column) -> Column:
    """What one token adds to the text, and the containers that are open after it.

    ``skip`` counts the open brackets of a container that is left out, ``key`` waits for its value.
    """
    stack, key = state["stack"], state["key"]
    change = _change(token)
    opens, closes, is_key = change > 0, change < 0, token.endswith(":")
    top = F.try_element_at(stack, F.lit(-1))
    in_list = F.coalesce(top["is_list"], F.lit(False))
    outermost = F.size(stack) == 0
    level = F.when(outermost, 0).otherwise(top["level"] + F.when(in_list, 0).otherwise(1))
    full = in_list & (top["count"] >= _ITEMS_MAX)
    # A list inside a list is no property object: it becomes an empty one. Members too deep go with their keys.
    enters = opens & ~full & F.when(in_list, token == "{").otherwise(level < PROP_DEPTH_MAX)
    passed = (state["skip"] > 0) | is_key
    lead = F.concat(F.when(top["count"] > 0, ",").otherwise(""), key)
    quoted = F.concat(F.lit('"'), _cut_text(F.substring(token, F.lit(2), F.length(token) - 2), PROP_STRING_MAX), F.lit('"'))
    added = (
        F.when(passed | full & ~closes, "")
        .when(closes, token)
        .when(enters, F.concat(lead, token))
        .when(opens & in_list, F.concat(lead, F.lit("{}")))
        .when(opens, "")
        .otherwise(F.concat(lead, F.when(token.startswith('"'), quoted).otherwise(token)))
    )
    outer = F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))
    one_more = F.struct(top["is_list"].alias("is_list"), (top["count"] + 1).alias("count"), top["level"].alias("level"))
    counted = F.when(outermost, stack).otherwise(F.concat(outer, F.array(one_more)))
    entered = F.struct((token == "[").alias("is_list"), F.lit(0).alias("count"), level.cast("int").alias("level"))
    after = (
        F.when(passed, stack)
        .when(closes, outer)
        .when(enters, F.concat(counted, F.array(entered)))
        .when(opens & ~in_list, stack)
        .otherwise(counted)
    )
    name = F.regexp_extract(token, r'(?s)^"(.*)"\s*:$', 1)
    named = F.when(is_key, F.concat(F.lit('"'), _cut_text(name, PROP_KEY_MAX), F.lit('":'))).otherwise("")
    return F.struct(
        after.cast(_STACK).alias("stack"),
        F.when(state["skip"] > 0, state["skip"] + change).when(opens & ~enters, 1).otherwise(0).cast("int").alias("skip"),
        F.when(state["skip"] > 0, key).otherwise(named).alias("key"),
        F.concat(state["kept"], added).alias("kept"),
    )


def _folded(text: Column) -> Column:
    """A JSON object cut to the limits: its tokens folded in runs, so that no text is copied for each of them."""
    nothing = F.array().cast(_STACK).alias("stack"), F.lit(0).alias("skip"), F.lit("").alias("key")

    def run_of(state: Column, run: Column) -> Column:
        before = F.struct(state["stack"].alias("stack"), state["skip"].alias("skip"), state["key"].alias("key"), F.lit("").alias("kept"))
        return let(
            F.aggregate(run, before, _next),
            lambda s: F.struct(s["stack"].alias("stack"), s["skip"].alias("skip"), s["key"].alias("key"), F.array_append(state["parts"], s["kept"]).alias("parts")),
        )

    start = F.struct(*nothing, F.array().cast("array<string>").alias("parts"))
    tokens = F.regexp_extract_all(text, F.lit(_VALUE), F.lit(0))
    return F.array_join(F.aggregate(let(tokens, _runs), start, run_of)["parts"], "")


def _is_json_object(text: Column) -> Column:
    """Whether a text is one JSON object; a half pair of surrogates, which browsers may send, is allowed."""
    parsed = F.try_parse_json(F.concat(F.lit("["), F.regexp_replace(text, _SURROGATE, "$1x"), F.lit("]")))
    first = F.try_variant_get(parsed, "$[0]", "map<string,variant>")
    return first.isNotNull() & F.try_variant_get(parsed, "$[1]", "variant").isNull()


def _with_distinct_keys(text: Column) -> Column:
    """The same object; where keys repeat, the last value of each stays, and the members are in order of their keys."""
    plain = F.to_json(F.try_parse_json(text))
    keys = [F.regexp_count(t, F.lit(r'"[^"\\]*+(?:\\.[^"\\]*+)*+":')) for t in (text, plain)]
    return F.when(keys[0] > keys[1], plain).otherwise(text)


def truncate_properties(text: Column) -> Column:
    """Cut properties to the limits and write them compactly; what is no JSON object becomes an empty one.

    Keys and strings are cut, lists end after ``_ITEMS_MAX`` values, and members that open an object or list
    too deep are left out. Text that no limit, repeated key or blank can change is not looked at further.
    """
    keys = F.json_object_keys(text)
    plain_object = (
        text.rlike(r"^\{.*\}$")
        & is_small_and_flat(text)
        & ~text.rlike(_LOOSE)
        & F.try_parse_json(text).isNotNull()
        & (F.size(keys) == F.size(F.array_distinct(keys)))
    )
    cut = F.when(_is_json_object(text), let(_folded(text), _with_distinct_keys))
    return F.when(F.coalesce(plain_object, F.lit(False)), text).otherwise(F.coalesce(cut, F.lit("{}")))
