"""Prompt text as Spark column expressions.

Templates are plain strings with three slots -- the few-shot block, the pairs
block and the item count -- filled with ``concat`` on the JVM side.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Prompt wording per strategy.  Each template is
#   HEAD + few-shot block + pairs block + MIDDLE + n + TAIL
# ---------------------------------------------------------------------------
_DEF_SUPPORT = "'Support': Arg2 is in favour of or agrees with Arg1.\n"
_DEF_ATTACK = "'Attack': Arg2 contradicts or opposes Arg1.\n"
_DEF_NONE = "'No Relation': Arg2 has no meaningful relation to Arg1.\n"
_INTRO = "In this task, you will be given two arguments and your goal is to classify "
_THREE = ("the relation between them as either \"Support\", \"Attack\", or \"No Relation\" "
          "based on the definitions below.\n")
_RESPOND = "\n\nRespond with ONLY a JSON array of exactly "
_PER_PAIR = " objects, one per pair, in order.\n"

TEMPLATES = {
    "A": (
        _INTRO + "whether Arg2 attacks Arg1 based on the definition below.\n" + _DEF_ATTACK
        + "\nFor each pair, output 1 if Arg2 attacks Arg1, or 0 if it does not.",
        _RESPOND,
        _PER_PAIR + "Each object must be either {\"attack\": 0} or {\"attack\": 1}.\n",
    ),
    "B": (
        _INTRO + "the relation between them as either \"Support\" or \"Attack\" based on the "
        "definitions below.\n" + _DEF_SUPPORT + _DEF_ATTACK
        + "\nFor each pair, set the matching field to 1 and the other to 0.",
        _RESPOND,
        _PER_PAIR + "Each object must follow this schema: {\"attack\": 0, \"support\": 0}\n"
        "Exactly one field per object must be 1.",
    ),
    "C": (
        _INTRO + _THREE + _DEF_SUPPORT + _DEF_ATTACK + _DEF_NONE
        + "\nFor each pair, set the matching field to 1 and all others to 0.",
        _RESPOND,
        _PER_PAIR + "Each object must follow this schema: "
        "{\"attack\": 0, \"support\": 0, \"neither\": 0}\nExactly one field per object must be 1.",
    ),
    "D": (
        _INTRO + _THREE + _DEF_SUPPORT + _DEF_ATTACK + _DEF_NONE
        + "\nAlso assign a relevance score to each Arg2 using this rubric:\n"
        "0.00 - Irrelevant: Off-topic; no logical bearing on the parent argument. Includes "
        "insults, digressions, and purely emotional reactions.\n"
        "0.25 - Weak: Loosely related to the parent but lacking substance. Vague restatements, "
        "unsupported assertions, or anecdotal remarks without reasoning.\n"
        "0.50 - Moderate: On-topic and provides a reason or counter-reason, but the reasoning is "
        "generic, partial, or applicable to many arguments beyond the specific parent.\n"
        "0.75 - Strong: Directly engages the parent argument with specific reasoning, evidence, "
        "or a well-formed counterexample.\n"
        "1.00 - Decisive: Targets the core of the parent argument with substantive, specific "
        "reasoning that materially affects how the parent should be evaluated.\n\n"
        "For each pair, set the matching relation field to 1 and all others to 0. Set "
        "\"relevance\" to one of: 0.00, 0.25, 0.50, 0.75, 1.00.",
        _RESPOND,
        _PER_PAIR + "Each object must follow this schema: "
        "{\"attack\": 0, \"support\": 0, \"neither\": 0, \"relevance\": 0.00}\n"
        "Exactly one of attack/support/neither must be 1. \"relevance\" must be one of: "
        "0.00, 0.25, 0.50, 0.75, 1.00.",
    ),
}

# Few-shot block wording and answer objects per gold label.
FEW_SHOT_HEADER = "Here are %d labeled example(s) to guide your classification:\n"
FEW_SHOT_FOOTER = "Now classify the following pairs:\n"
ANSWERS = {
    "A": {0: '{"attack": 1}', "other": '{"attack": 0}'},
    "B": {0: '{"attack": 1, "support": 0}', "other": '{"attack": 0, "support": 1}'},
    "C": {0: '{"attack": 1, "support": 0, "neither": 0}',
          1: '{"attack": 0, "support": 1, "neither": 0}',
          "other": '{"attack": 0, "support": 0, "neither": 1}'},
    "D": {0: '{"attack": 1, "support": 0, "neither": 0, "relevance": ',
          1: '{"attack": 0, "support": 1, "neither": 0, "relevance": ',
          "other": '{"attack": 0, "support": 0, "neither": 1, "relevance": '},
}


def text(c: Column) -> Column:
    """Text as Python would print it into the prompt (None -> 'None')."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def py_float_text(c: Column) -> Column:
    """A double as Python's str(): 0.5 -> '0.5', 1.0 -> '1.0', null -> 'nan'."""
    return F.coalesce(c.cast("double").cast("string"), F.lit("nan"))


def format_pair(pos: Column, arg1: Column, arg2: Column) -> Column:
    """'Pair i:\\nArg1: ...\\nArg2: ...' with i = pos + 1."""
    return F.concat(F.lit("Pair "), (pos + 1).cast("string"), F.lit(":\nArg1: "), text(arg1),
                    F.lit("\nArg2: "), text(arg2))


def format_answer(strategy: str, gold: Column, relevance: Column | None = None) -> Column:
    """Gold label -> the JSON answer a strategy expects (B maps every non-0 to support)."""
    ans = ANSWERS[strategy]
    expr = F.lit(ans["other"])
    for code in sorted((k for k in ans if k != "other"), reverse=True):
        expr = F.when(gold == code, F.lit(ans[code])).otherwise(expr)
    if strategy == "D":
        rel = py_float_text(relevance if relevance is not None else F.lit(None))
        expr = F.concat(expr, rel, F.lit("}"))
    return expr


def format_example(seq: Column, arg1: Column, arg2: Column, answer: Column) -> Column:
    return F.concat(F.lit("Example "), seq.cast("string"), F.lit(":\nArg1: "), text(arg1),
                    F.lit("\nArg2: "), text(arg2), F.lit("\nLabel: "), answer)


def ordered_join(item: Column, order: Column, sep: str) -> Column:
    """Aggregate: items joined by ``sep`` in ``order`` (bounded groups only)."""
    parts = F.array_sort(F.collect_list(F.struct(order.alias("o"), item.alias("t"))))
    return F.array_join(F.transform(parts, lambda x: x["t"]), sep)


def prompt(strategy: str, few_shot_block: Column, pairs_block: Column, n_items: Column) -> Column:
    head, respond, tail = TEMPLATES[strategy]
    block = F.when(few_shot_block.isNull() | (few_shot_block == ""), F.lit("\n")) \
        .otherwise(F.concat(F.lit("\n"), few_shot_block, F.lit("\n")))
    return F.concat(F.lit(head), block, pairs_block, F.lit(respond), n_items.cast("string"),
                    F.lit(tail))
