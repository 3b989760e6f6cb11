"""DuckDB SQL for the operators that SQL can express."""

OP2 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN NULL ELSE first END AS refers_to
FROM f
"""



def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text: byte by byte, bit by bit (the reflected polynomial)."""
    bits = "list_reduce(list_prepend(xor(a, b), range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda a, b: {bits}), CAST(4294967295 AS BIGINT))"


def merkle(source_levels: int = 7, top_levels: int = 5) -> str:
    """Manifest level by level: room for 16^7 documents of a source and 16^5 sources."""
    def enc(c: str) -> str:
        return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"

    head = " || ".join(enc(c) for c in ("doc_id", "source", "lang", "n_chars"))
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [f"""d AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, sha256({head} || {enc('text')}) AS leaf,
         CASE WHEN doc_id IS NOT NULL AND {_crc32('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN sha256({head} || {enc(low)}) END AS tampered
  FROM documents)""", """p0 AS (
  SELECT row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, leaf) AS rid, doc_id, tree, leaf, coalesce(tampered, leaf) AS cur, '' AS proof,
         row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM d)""", "n0 AS (SELECT tree, pos, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM p0)"]

    def climb(k: int, at: str) -> None:
        steps.append(f"r{k} AS (SELECT tree, pos // 16 AS run, list(h ORDER BY pos) AS hs FROM n{k - 1} WHERE n > 1 GROUP BY tree, pos // 16)")
        steps.append(f"""n{k} AS (
  SELECT tree, run AS pos, sha256(array_to_string(hs, '')) AS h, count(*) OVER (PARTITION BY tree) AS n FROM r{k}
  UNION ALL SELECT tree, pos, h, n FROM n{k - 1} WHERE n = 1)""")
        left, right = f"array_to_string(hs[1:({at}.pos % 16)], '')", f"array_to_string(hs[({at}.pos % 16 + 2):], '')"
        steps.append(f"""p{k} AS (
  SELECT rid, doc_id, {at}.tree, leaf, CASE WHEN hs IS NULL THEN cur ELSE sha256({left} || cur || {right}) END AS cur,
         CASE WHEN hs IS NULL THEN proof ELSE proof || {left} || {right} END AS proof, {at}.pos // 16 AS pos{', subroot' if k > source_levels else ''}
  FROM {at} LEFT JOIN r{k} ON r{k}.tree = {at}.tree AND run = {at}.pos // 16)""")

    for k in range(1, source_levels + 1):
        climb(k, f"p{k - 1}")
    k = source_levels
    # The subroots are the nodes of one tree above, placed by their sources.
    steps.append(f"top AS (SELECT rid, doc_id, 0 AS tree, leaf, cur, proof, p{k}.tree AS pos, h AS subroot FROM p{k} JOIN n{k} ON n{k}.tree = p{k}.tree)")
    steps[-1] += f", n{k}top AS (SELECT 0 AS tree, tree AS pos, h, count(*) OVER () AS n FROM n{k})"
    for k in range(source_levels + 1, source_levels + top_levels + 1):
        climb(k, "top" if k == source_levels + 1 else f"p{k - 1}")
        if k == source_levels + 1:
            steps[-3:] = [x.replace(f"n{k - 1} ", f"n{k - 1}top ") for x in steps[-3:]]
    k = source_levels + top_levels
    body = ", ".join(steps)
    return f"""WITH {body}
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = h AS verified FROM p{k} CROSS JOIN n{k}"""


ORACLE: dict[str, str] = {"op2_warc_zip": OP2, "op13_merkle_manifest": merkle()}
