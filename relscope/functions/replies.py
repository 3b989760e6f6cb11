"""Reply text -> JSON items -> typed flags, as column expressions.

Rules of the evaluated system, carried over:
* code fences (``` and ```json) are removed, then the *shortest* ``[...]``
  (across newlines) is the array -- a nested array or a ``]`` inside a string
  cuts it short;
* the array must parse as JSON and hold exactly the expected number of items;
* a flag is ``int(float(v))`` (truncation; ``true`` -> 1); a missing key stays
  null.  Values that cannot be decoded (JSON null, text, non-object items)
  null the whole batch with status ``bad_value`` instead of killing the run.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fence pattern and array pattern of the reply format.
FENCE_RE = "```(?:json)?"
ARRAY_RE = "(?s)\\[.*?\\]"
JSON_OPTIONS = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}

STATUS_OK = "ok"
STATUS_CALL_FAILED = "call_failed"
STATUS_NO_ARRAY = "no_array"
STATUS_BAD_JSON = "bad_json"
STATUS_WRONG_COUNT = "wrong_count"
STATUS_BAD_VALUE = "bad_value"


def extract_json_array(reply: Column) -> Column:
    """Shortest bracketed span after removing fences; null when there is none."""
    cleaned = F.regexp_replace(reply, FENCE_RE, "")
    found = F.regexp_extract(cleaned, ARRAY_RE, 0)
    return F.when(found != "", found)


ITEM_SCHEMA = "attack string, support string, neither string, relevance string"


def json_items(array_text: Column) -> Column:
    """array<string>: each item's JSON text; null if the text is not a JSON array."""
    return F.from_json(array_text, "array<string>", JSON_OPTIONS)


def parse_item(item: Column) -> Column:
    """One JSON parse per item: ``k`` = its keys (null if not an object) and
    ``f`` = the four known fields as text (a repeated key keeps its last value)."""
    return F.struct(F.json_object_keys(item).alias("k"),
                    F.from_json(item, ITEM_SCHEMA, JSON_OPTIONS).alias("f"))


def is_object(item: Column) -> Column:
    return F.json_object_keys(item).isNotNull()


def has_key(item: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(item), F.lit(key)), F.lit(False))


def raw_value(item: Column, key: str) -> Column:
    return F.get_json_object(item, f"$.{key}")


#: Decimal numbers as a JSON reply or a parser of plain floats writes them; a cast alone would also take type suffixes ('1d').
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)(e[+-]?[0-9]+)?$|^[+-]?(inf|infinity|nan)$"


def _number(v: Column) -> Column:
    return F.when(v.rlike(NUMBER), v.try_cast("double"))


def decode_flag(raw: Column) -> Column:
    """int(float(v)): '0.9' -> 0, '1' -> 1, 'true' -> 1, 'false' -> 0; else null."""
    v = F.lower(F.trim(raw))
    num = F.when(v == "true", F.lit(1.0)).when(v == "false", F.lit(0.0)).otherwise(_number(v))
    return num.try_cast("int")


def decode_relevance(raw: Column) -> Column:
    v = F.lower(F.trim(raw))
    return F.when(v == "true", F.lit(1.0)).when(v == "false", F.lit(0.0)).otherwise(_number(v))


FLAG_KEYS = ("attack", "support", "neither")


def _has(parsed: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(parsed["k"], F.lit(key)), F.lit(False))


def item_bad(parsed: Column, with_relevance: Column) -> Column:
    """True when the (parsed) item is not an object, or a present flag key (any
    strategy) or, for D, the relevance holds a value that does not decode."""
    bad = parsed["k"].isNull()
    for k in FLAG_KEYS:
        bad = bad | (_has(parsed, k) & decode_flag(parsed["f"][k]).isNull())
    rel_bad = _has(parsed, "relevance") & decode_relevance(parsed["f"]["relevance"]).isNull()
    bad = bad | (with_relevance & rel_bad)
    return F.coalesce(bad, F.lit(True))
