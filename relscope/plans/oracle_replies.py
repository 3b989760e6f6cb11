"""DuckDB oracle SQL for reply extraction, parsing, decoding and attachment."""

from __future__ import annotations

from relscope.plans import replies_fixture as rf
from relscope.plans.fixtures import with_clause

_FLAGS = ("attack", "support", "neither")


def _dec_flag(raw: str) -> str:
    v = f"trim({raw})"
    num = (f"CASE WHEN lower({v}) = 'true' THEN 1.0 WHEN lower({v}) = 'false' THEN 0.0 "
           f"ELSE TRY_CAST({v} AS DOUBLE) END")
    return f"TRY_CAST(trunc({num}) AS INTEGER)"


def _dec_rel(raw: str) -> str:
    v = f"trim({raw})"
    return (f"(CASE WHEN lower({v}) = 'true' THEN 1.0 WHEN lower({v}) = 'false' THEN 0.0 "
            f"ELSE TRY_CAST({v} AS DOUBLE) END)")


def _has(it: str, k: str) -> str:
    return f"list_contains(json_keys({it}), '{k}')"


def _raw(it: str, k: str) -> str:
    return f"json_extract_string({it}, '$.{k}')"


def _bad(it: str) -> str:
    parts = [f"({_has(it, k)} AND {_dec_flag(_raw(it, k))} IS NULL)" for k in _FLAGS]
    parts.append(f"(strategy = 'D' AND {_has(it, 'relevance')} AND {_dec_rel(_raw(it, 'relevance'))} IS NULL)")
    inner = " OR ".join(parts)
    return f"(CASE WHEN json_type({it}) = 'OBJECT' THEN ({inner}) ELSE TRUE END)"


def ctes() -> dict[str, str]:
    c = rf.oracle_ctes()
    c["o_px"] = """
  SELECT *, nullif(regexp_extract(regexp_replace(reply, '```(?:json)?', '', 'g'), '(?s)\\[.*?\\]', 0), '')
              AS array_text
  FROM fx_replies"""
    c["o_pj"] = """
  SELECT *, CASE WHEN array_text IS NOT NULL AND json_valid(array_text)
                 THEN json_extract(array_text, '$[*]') END AS items
  FROM o_px"""
    c["o_ps"] = f"""
  SELECT run_id, strategy, batch_id, n_expected, array_text, items,
         CASE WHEN items IS NOT NULL THEN len(items) END AS n_items_reply,
         CASE WHEN reply IS NULL THEN 'call_failed'
              WHEN array_text IS NULL THEN 'no_array'
              WHEN items IS NULL THEN 'bad_json'
              WHEN len(items) <> n_expected THEN 'wrong_count'
              WHEN list_bool_or(list_transform(items, lambda it: {_bad('it')})) THEN 'bad_value'
              ELSE 'ok' END AS parse_status
  FROM o_pj"""
    dec = ", ".join(f"{_dec_flag(_raw('it', k))} AS pred_{k}" for k in _FLAGS)
    c["o_dec"] = f"""
  SELECT run_id, strategy, batch_id, CAST(item_pos AS INTEGER) AS item_pos, {dec},
         CASE WHEN strategy = 'D' THEN {_dec_rel(_raw('it', 'relevance'))} END AS pred_relevance
  FROM (SELECT run_id, strategy, batch_id, i AS item_pos, items[i + 1] AS it
        FROM (SELECT *, unnest(range(0, len(items))) AS i FROM o_ps WHERE parse_status = 'ok') u) x"""
    return c


def _w(*names) -> str:
    return with_clause(["fx_predictions", *names], ctes())


def extract_json_array() -> str:
    return _w("o_px") + "SELECT run_id, batch_id, array_text FROM o_px"


def parse_replies() -> str:
    return _w("o_ps") + "SELECT run_id, batch_id, n_expected, n_items_reply, parse_status FROM o_ps"


def decode_predictions() -> str:
    return _w("o_dec") + """
SELECT run_id, batch_id, item_pos, pred_attack, pred_support, pred_neither, pred_relevance,
       (pred_relevance IS NOT NULL AND pred_relevance NOT IN (0.0, 0.25, 0.5, 0.75, 1.0)) AS off_rubric
FROM o_dec"""


def attach_replies() -> str:
    """The parsed replies are computed once, then each pair picks its item by place: one join, no unnesting."""
    c = ctes()
    dec = ", ".join(f"{_dec_flag(_raw('it', k))} AS pred_{k}" for k in _FLAGS)
    text = with_clause(["fx_predictions", "fxr_items", "o_ps"], c)
    for heavy in ("fxr_items", "fx_replies", "o_ps"):
        text = text.replace(f"{heavy} AS (", f"{heavy} AS MATERIALIZED (", 1)
    return text + f"""
SELECT pair_id, run_id, batch_id, item_pos, {dec},
       CASE WHEN strategy = 'D' THEN {_dec_rel(_raw('it', 'relevance'))} END AS pred_relevance, parse_status
FROM (SELECT i.pair_id, i.run_id, i.strategy, i.batch_id, i.item_pos, s.parse_status,
             CASE WHEN s.parse_status = 'ok' THEN s.items[i.item_pos + 1] END AS it
      FROM fxr_items i LEFT JOIN o_ps s ON s.run_id = i.run_id AND s.strategy = i.strategy AND s.batch_id = i.batch_id) x"""


def batch_failures() -> str:
    return _w("o_ps") + """
SELECT run_id, parse_status, count(*) AS n_batches, CAST(sum(n_expected) AS BIGINT) AS n_rows
FROM o_ps GROUP BY run_id, parse_status"""
