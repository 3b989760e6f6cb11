"""DuckDB oracle SQL for sampling, batching and prompt queries.

Plain window SQL (global ``row_number``) as the brute-force reference for the
bucketed positions of the Spark side; the prompt text is rebuilt from the same
fixed templates with ``||`` and ``string_agg(... ORDER BY ...)``.
"""

from __future__ import annotations

from relscope.functions import prompts as P
from relscope.operators.sampling import class_quotas
from relscope.plans.fixtures import with_clause

SEED = 42


def sql_str(s: str) -> str:
    """A Python string as a DuckDB expression (newlines via chr(10))."""
    parts = ["'" + p.replace("'", "''") + "'" for p in s.split("\n")]
    return " || chr(10) || ".join(parts)


def key(col: str = "pair_id") -> str:
    return f"md5(concat_ws('|', '{SEED}', {col}))"


def _sample_cte(src: str, n: int, classes) -> str:
    q = {c: v for c, v in class_quotas(n, classes).items() if v > 0}
    case = "CASE support " + " ".join(f"WHEN {c} THEN {v}" for c, v in q.items()) + " ELSE 0 END"
    inlist = ", ".join(str(c) for c in q)
    return f"""
  SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', 'fs', k)), pair_id) AS example_seq
  FROM (SELECT *, {key()} AS k,
               row_number() OVER (PARTITION BY support ORDER BY {key()}, pair_id) AS rn
        FROM {src} WHERE support IN ({inlist})) t
  WHERE rn <= {case}"""


def seeded_shuffle() -> str:
    return with_clause(["fx_predictions"]) + f"""
SELECT pair_id, {key()} AS shuffle_key, row_number() OVER (ORDER BY {key()}, pair_id) - 1 AS pos
FROM fx_predictions"""


def stratified_sample() -> str:
    return with_clause(["fx_predictions"]) + ", o_fs AS (" + _sample_cte("fx_predictions", 10, (0, 1, 2)) + """
)
SELECT pair_id, support, example_seq FROM o_fs"""


def stratified_sample_large() -> str:
    return with_clause(["fx_predictions"]) + ", o_fs AS (" + _sample_cte("fx_predictions", 6000, (0, 1, 2)) + """
)
SELECT pair_id, support FROM o_fs"""


def union_class_samples() -> str:
    return with_clause(["fx_predictions"]) + ", o_fs AS (" + _sample_cte("fx_predictions", 10, (0, 1, 2)) + """
)
SELECT pair_id, support FROM o_fs"""


def eligible_pool() -> str:
    return with_clause(["fx_predictions"]) + "SELECT pair_id, support FROM fx_predictions WHERE support IN (0, 1)"


def _eval_ctes(src: str, n: int, classes) -> str:
    return f""", o_fs AS ({_sample_cte(src, n, classes)}
), o_eval AS (
  SELECT e.*, row_number() OVER (ORDER BY {key('e.pair_id')}, e.pair_id) - 1 AS pos
  FROM {src} e WHERE e.pair_id NOT IN (SELECT pair_id FROM o_fs)
)"""


def exclude_few_shot() -> str:
    return with_clause(["fx_predictions"]) + _eval_ctes("fx_predictions", 10, (0, 1, 2)) + \
        "\nSELECT pair_id, support FROM o_eval"


def limit_sample() -> str:
    return with_clause(["fx_predictions"]) + _eval_ctes("fx_predictions", 10, (0, 1, 2)) + \
        "\nSELECT pair_id, pos FROM o_eval WHERE pos < 1000"


def assign_batches() -> str:
    return with_clause(["fx_predictions"]) + _eval_ctes("fx_predictions", 10, (0, 1, 2)) + """
SELECT pair_id, CAST(floor(pos / 20) AS BIGINT) AS batch_id, CAST(pos % 20 AS INTEGER) AS item_pos
FROM o_eval"""


# ----------------------------------------------------------------------------- text
def _answer(strategy: str, gold: str, rel: str | None = None) -> str:
    ans = P.ANSWERS[strategy]
    whens = " ".join(f"WHEN {gold} = {c} THEN {sql_str(ans[c])}" for c in ans if c != "other")
    e = f"CASE {whens} ELSE {sql_str(ans['other'])} END" if whens else sql_str(ans["other"])
    if strategy == "D":
        e = f"({e}) || coalesce(CAST(CAST({rel} AS DOUBLE) AS VARCHAR), 'nan') || '}}'"
    return e


def _txt(c: str) -> str:
    return f"coalesce(CAST({c} AS VARCHAR), 'None')"


REL = "(length(arg2) % 5) * CAST(0.25 AS DOUBLE)"


def format_answer() -> str:
    cols = ", ".join(f"{_answer(s, 'support', 'relevance')} AS answer_{s.lower()}" for s in "ABCD")
    return with_clause(["fx_pairs"]) + f"""
SELECT pair_id, support, {cols}
FROM (SELECT *, {REL} AS relevance FROM fx_pairs) t"""


_FS_N = {"A": 7, "B": 10, "C": 10, "D": 10}


def _block_sql(strategy: str, fs: str) -> str:
    ex = (f"'Example ' || CAST(example_seq AS VARCHAR) || ':' || chr(10) || 'Arg1: ' || {_txt('arg1')} "
          f"|| chr(10) || 'Arg2: ' || {_txt('arg2')} || chr(10) || 'Label: ' || "
          f"{_answer(strategy, 'support', 'relevance')}")
    header = sql_str(P.FEW_SHOT_HEADER.replace("%d", "\x00")).replace("\x00", "' || CAST(count(*) AS VARCHAR) || '")
    return f"""
  SELECT '{strategy}' AS strategy, count(*) AS n_examples,
         CASE WHEN count(*) > 0 THEN {header} || chr(10) || chr(10)
              || string_agg({ex}, chr(10) || chr(10) ORDER BY example_seq) || chr(10) || chr(10)
              || {sql_str(P.FEW_SHOT_FOOTER)} ELSE '' END AS few_shot_block
  FROM {fs}"""


def _strategy_ctes(fs_n=None) -> str:
    fs_n = fs_n or _FS_N
    out = []
    for s in "ABCD":
        classes = (0, 1, 2) if s in "CD" else (0, 1)
        src = f"(SELECT *, {REL} AS relevance FROM fx_pairs)"
        out.append(f"o_fs_{s} AS ({_sample_cte(src, fs_n[s], classes)}\n)")
        out.append(f"o_blk_{s} AS ({_block_sql(s, f'o_fs_{s}')}\n)")
        out.append(f"""o_ev_{s} AS (
  SELECT '{s}' AS strategy, e.*, row_number() OVER (ORDER BY {key('e.pair_id')}, e.pair_id) - 1 AS pos
  FROM fx_pairs e WHERE e.pair_id NOT IN (SELECT pair_id FROM o_fs_{s})
)""")
    return ",\n" + ",\n".join(out)


def format_few_shot() -> str:
    return with_clause(["fx_pairs"]) + _strategy_ctes() + "\n" + " UNION ALL ".join(
        f"SELECT * FROM o_blk_{s}" for s in "ABCD")


def _pairs_block(src: str) -> str:
    item = (f"'Pair ' || CAST(item_pos + 1 AS VARCHAR) || ':' || chr(10) || 'Arg1: ' || {_txt('arg1')} "
            f"|| chr(10) || 'Arg2: ' || {_txt('arg2')}")
    return f"""
  SELECT strategy, batch_id, string_agg({item}, chr(10) || chr(10) ORDER BY item_pos) AS pairs_block,
         count(*) AS n_items
  FROM (SELECT *, CAST(floor(pos / 10) AS BIGINT) AS batch_id, CAST(pos % 10 AS INTEGER) AS item_pos
        FROM {src}) b
  GROUP BY strategy, batch_id"""


def format_pairs() -> str:
    return with_clause(["fx_pairs"]) + _strategy_ctes() + \
        f", o_pb AS ({_pairs_block('o_ev_C')}\n)\nSELECT batch_id, pairs_block, n_items FROM o_pb"


def build_prompts(fs_n=None, tail_sql=None) -> str:
    union = " UNION ALL ".join(f"SELECT * FROM o_ev_{s}" for s in "ABCD")
    blocks = " UNION ALL ".join(f"SELECT strategy, few_shot_block FROM o_blk_{s}" for s in "ABCD")
    cases = []
    for s in "ABCD":
        head, respond, tail = P.TEMPLATES[s]
        blk = "CASE WHEN few_shot_block IS NULL OR few_shot_block = '' THEN chr(10) ELSE chr(10) || few_shot_block || chr(10) END"
        cases.append(f"WHEN '{s}' THEN {sql_str(head)} || {blk} || pairs_block || {sql_str(respond)} "
                     f"|| CAST(n_items AS VARCHAR) || {sql_str(tail)}")
    body = f"""
  SELECT p.strategy, p.batch_id, p.n_items, CASE p.strategy {' '.join(cases)} END AS prompt
  FROM o_pb p LEFT JOIN o_bl b ON b.strategy = p.strategy"""
    head = with_clause(["fx_pairs"]) + _strategy_ctes(fs_n) + f""",
o_pb AS ({_pairs_block('(' + union + ')')}
), o_bl AS ({blocks})"""
    if tail_sql is None:
        return head + body
    return head + f", o_prompts AS ({body}\n), o_evall AS ({union})\n" + tail_sql


_STUB_H = "md5(prompt)"


def _stub_label(i: str) -> str:
    return f"ascii(substr(h, ({i}) % 32 + 1, 1)) % 3"


def _stub_item(label: str) -> str:
    a = f"CAST(CASE WHEN {label} = 0 THEN 1 ELSE 0 END AS STRING)"
    sup_b = f"CAST(CASE WHEN {label} = 0 THEN 0 ELSE 1 END AS STRING)"
    s_ = f"CAST(CASE WHEN {label} = 1 THEN 1 ELSE 0 END AS STRING)"
    n_ = f"CAST(CASE WHEN {label} = 2 THEN 1 ELSE 0 END AS STRING)"
    r_ = f"CAST({label} * CAST(0.25 AS DOUBLE) AS STRING)"
    return (f"CASE strategy WHEN 'A' THEN '{{\"attack\": ' || {a} || '}}' "
            f"WHEN 'B' THEN '{{\"attack\": ' || {a} || ', \"support\": ' || {sup_b} || '}}' "
            f"WHEN 'C' THEN '{{\"attack\": ' || {a} || ', \"support\": ' || {s_} || ', \"neither\": ' || {n_} || '}}' "
            f"ELSE '{{\"attack\": ' || {a} || ', \"support\": ' || {s_} || ', \"neither\": ' || {n_} "
            f"|| ', \"relevance\": ' || {r_} || '}}' END")


EVAL_FS_N = {"A": 10, "B": 10, "C": 10, "D": 10}


def resumed_inference() -> str:
    return batched_inference(", strategy IN ('A', 'B') AS resumed")


def batched_inference(more: str = "") -> str:
    tail = f"""
SELECT strategy, batch_id, n_items,
       CASE WHEN substr(h, 1, 1) = '0' THEN NULL
            ELSE '[' || array_to_string(list_transform(
                   range(0, n_items + CASE WHEN substr(h, 1, 1) = '1' THEN 1 ELSE 0 END),
                   lambda i: {_stub_item(_stub_label('i'))}), ', ') || ']' END AS reply,
       CAST(CASE WHEN substr(h, 1, 1) = '0' THEN 2 ELSE 1 END AS INTEGER) AS attempts,
       CASE WHEN substr(h, 1, 1) = '0' THEN 'RuntimeError: model unavailable' END AS error{more}
FROM (SELECT *, {_STUB_H} AS h FROM o_prompts) t"""
    return build_prompts(EVAL_FS_N, tail)


def evaluate_pairs() -> str:
    examples = " UNION ALL ".join(f"SELECT '{s}' AS strategy, count(*) AS few_shot_n FROM o_fs_{s}" for s in "ABCD")
    lab = _stub_label("e.item_pos")
    tail = f"""
SELECT e.pair_id, e.arg1, e.arg2, e.strategy, e.support, e.batch_id, e.item_pos, (length(e.arg2) % 5) * CAST(0.25 AS DOUBLE) AS relevance_human_labeled,
       CASE e.support WHEN 0 THEN 'Attack' WHEN 1 THEN 'Support' WHEN 2 THEN 'No Relation' END AS support_label,
       f.few_shot_n,
       CASE WHEN st = 'ok' THEN CAST(CASE WHEN {lab} = 0 THEN 1 ELSE 0 END AS INTEGER) END AS pred_attack,
       CASE WHEN st = 'ok' AND e.strategy = 'B' THEN CAST(CASE WHEN {lab} = 0 THEN 0 ELSE 1 END AS INTEGER)
            WHEN st = 'ok' AND e.strategy IN ('C', 'D') THEN CAST(CASE WHEN {lab} = 1 THEN 1 ELSE 0 END AS INTEGER)
       END AS pred_support,
       CASE WHEN st = 'ok' AND e.strategy IN ('C', 'D') THEN CAST(CASE WHEN {lab} = 2 THEN 1 ELSE 0 END AS INTEGER)
       END AS pred_neither,
       CASE WHEN st = 'ok' AND e.strategy = 'D' THEN {lab} * CAST(0.25 AS DOUBLE) END AS pred_relevance,
       st AS parse_status
FROM (SELECT *, CAST(floor(pos / 10) AS BIGINT) AS batch_id, CAST(pos % 10 AS INTEGER) AS item_pos
      FROM o_evall) e
JOIN (SELECT strategy, batch_id, {_STUB_H} AS h,
             CASE WHEN substr({_STUB_H}, 1, 1) = '0' THEN 'call_failed'
                  WHEN substr({_STUB_H}, 1, 1) = '1' THEN 'wrong_count' ELSE 'ok' END AS st
      FROM o_prompts) p ON p.strategy = e.strategy AND p.batch_id = e.batch_id
JOIN ({examples}) f ON f.strategy = e.strategy"""
    return build_prompts(EVAL_FS_N, tail)


def read_pairs_plain() -> str:
    return with_clause(["fx_pairs"]) + "SELECT arg1, arg2, support, type FROM fx_pairs"


def read_pairs_content() -> str:
    """Pairs with the hash of their content; later ones of equal rows are numbered."""
    told = " || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("arg1", "arg2", "support", "type"))
    return with_clause(["fx_pairs"]) + f"""
SELECT h || CASE WHEN k > 0 THEN '#' || k ELSE '' END AS pair_id, arg1, arg2, support, type
FROM (SELECT *, row_number() OVER (PARTITION BY h) - 1 AS k
      FROM (SELECT *, sha256({told}) AS h FROM fx_pairs) x) y"""


def check_inputs() -> str:
    return with_clause(["fx_pairs"]) + "SELECT pair_id FROM fx_pairs"


def predictions_plain() -> str:
    return with_clause(["fx_predictions"]) + """
SELECT pair_id, run_id, strategy, CAST(support AS BIGINT) AS support, pred_attack, pred_support,
       pred_neither, pred_relevance
FROM fx_predictions"""


def rename_outputs() -> str:
    return with_clause(["fx_predictions"]) + """
SELECT pair_id, support AS "support [true value]",
       CASE support WHEN 0 THEN 'Attack' WHEN 1 THEN 'Support' WHEN 2 THEN 'No Relation' END AS support_label
FROM fx_predictions"""


def annotation_sample() -> str:
    return with_clause(["fx_pairs"]) + ", o_fs AS (" + _sample_cte("fx_pairs", 30, (0, 1, 2)) + """
)
SELECT pair_id, support,
       CASE support WHEN 0 THEN 'Attack' WHEN 1 THEN 'Support' WHEN 2 THEN 'No Relation' END AS support_label,
       CAST(NULL AS DOUBLE) AS relevance
FROM o_fs"""
