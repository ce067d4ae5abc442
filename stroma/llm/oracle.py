"""DuckDB SQL for those corpus queries that SQL can express, written apart from the operators."""

SQL: dict[str, str] = {}

# crc32 from its table of 256 remainders, made by rule; jumps by a recursion in 128-bit arithmetic
SQL["op1_jump_sharding"] = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), bits(k, c, i) AS (
  SELECT k, k::UBIGINT, 0 FROM range(256) t(k)
  UNION ALL
  SELECT k, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END, i + 1 FROM bits WHERE i < 8
), tab AS (
  SELECT list(c ORDER BY k) AS t FROM bits WHERE i = 8
), h AS (
  SELECT r, doc_id, octet_length(encode(t)) AS n, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: ('0x' || x)::UBIGINT) AS bytes FROM d
), s AS (
  SELECT r, doc_id, n, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, bytes), lambda c, x: xor(c >> 8, tab.t[(xor(c, x) & 255)::BIGINT + 1]))) AS crc FROM h, tab
), j(r, k, b, a) AS (
  SELECT r, ((doc_id::HUGEINT + 18446744073709551616) % 18446744073709551616 * 2862933555777941757 + 1) % 18446744073709551616, 0::BIGINT, 0::BIGINT FROM (SELECT r, coalesce(doc_id, 0) AS doc_id FROM d)
  UNION ALL
  SELECT r, (k * 2862933555777941757 + 1) % 18446744073709551616, a, floor((a + 1)::DOUBLE * (2147483648.0::DOUBLE / ((k // 8589934592)::DOUBLE + 1.0::DOUBLE)))::BIGINT FROM j WHERE a < 9
), p AS (
  SELECT r, max(a) FILTER (a < 8)::INT AS shard, max(a) FILTER (a < 9)::INT AS grown_shard FROM j GROUP BY r
), parts AS (
  SELECT greatest(8, ceil(count(*) / 100000))::BIGINT AS parts FROM d
)
SELECT doc_id, (n + 1)::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(coalesce(doc_id, 0)::VARCHAR), 1, 8))::UBIGINT % parts, doc_id NULLS FIRST, crc, n) - 1 AS slot, grown_shard
FROM s JOIN p USING (r), parts
"""

SQL["op2_line_frequency_rules"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), 1) AS p FROM d
), n AS (
  SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY r
), g AS (
  SELECT a.r, a.p, a.word || ' ' || b.word || ' ' || c.word AS gram
  FROM w a JOIN w b ON a.r = b.r AND b.p = a.p + 1 JOIN w c ON a.r = c.r AND c.p = a.p + 2
), again AS (
  SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, gram) AS k FROM g) WHERE k > 1
), rep AS (
  SELECT r, count(DISTINCT p + o) AS n_repeat_words FROM again, (SELECT unnest([0, 1, 2]) AS o) GROUP BY r
), l AS (
  SELECT r, line FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), dup AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY r
), norm AS (
  SELECT l.r, d.doc_id, d.host, d.t, trim(regexp_replace(translate(lower(line), '123456789', '000000000'), '[\x20\x09-\x0D]+', ' ', 'g')) AS line,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
  FROM l JOIN d USING (r)
), often AS (
  SELECT host, line FROM (SELECT host, line, count(DISTINCT {'i': doc_id, 't': t}) AS docs FROM norm GROUP BY host, line) JOIN (SELECT host, count(DISTINCT {'i': doc_id, 't': t}) AS all_docs FROM d GROUP BY host) USING (host)
  WHERE docs > 20 AND docs > 0.01 * all_docs
), lost AS (
  SELECT norm.r, sum(words) AS lost FROM norm JOIN often USING (host, line) GROUP BY norm.r
), j AS (
  SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS n_removed_words
  FROM d LEFT JOIN n USING (r) LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN lost USING (r)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM j
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_removed_words <= 0.5 * n_words AS kept, n_removed_words
FROM f
"""

SQL["op3_benchmark_decontamination"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[p : p + least(13, len(w)) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT n FROM win
), g AS (
  SELECT r, p, n, array_to_string(w[p : p + n - 1], ' ') AS gram FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)
), hit AS (
  SELECT g.r, g.p, g.n, win.item_id FROM g JOIN win ON g.n = win.n AND g.gram = win.gram
), placed AS (
  SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hit) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN placed USING (r) LEFT JOIN items USING (r)
"""

# the level is the largest quotient over prefixes of the sources ordered by what they hold a unit of weight
SQL["op12_source_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('12:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source
), o AS (
  SELECT *, row_number() OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST) AS n FROM s
), levels AS (
  SELECT ((SELECT 1.5 * sum(source_size) FROM s) - coalesce(sum(2.0 * source_size) OVER b, 0)) / sum(weight) OVER (ORDER BY n DESC) AS level
  FROM o WINDOW b AS (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(weight * (SELECT max(level) FROM levels), 2.0 * source_size)::DOUBLE AS target FROM s
), f AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS whole FROM t
), r AS (
  SELECT doc_id, size, source_size, target, whole, floor(target + 0.5)::BIGINT - whole * source_size AS more,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source
)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, more - before)))::BIGINT AS taken FROM r
"""


def _merkle() -> str:
    """Level by level: a node's run of siblings is one string, from which its own 64 digits are cut; enough levels for 8^9 rows and as many groups."""
    crc = """bits(k, c, i) AS (
  SELECT k, k::UBIGINT, 0 FROM range(256) t(k) UNION ALL SELECT k, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END, i + 1 FROM bits WHERE i < 8
), tab AS (SELECT list(c ORDER BY k) AS t FROM bits WHERE i = 8), d AS (
  SELECT row_number() OVER () AS r, doc_id, source, lang, n_chars, text,
         xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda x: ('0x' || x)::UBIGINT)), lambda c, x: xor(c >> 8, tab.t[(xor(c, x) & 255)::BIGINT + 1]))) AS crc
  FROM documents, tab
)"""
    f = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    head = " || ".join(map(f, ("doc_id", "source", "lang", "n_chars")))
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [crc, f"""l AS (SELECT r, doc_id, lang, sha256({head} || {f("text")}) AS leaf, sha256({head} || CASE WHEN crc % 3 = 0 THEN {f(low)} ELSE {f("text")} END) AS claimed FROM d)""",
             "t0 AS (SELECT r, doc_id, lang, leaf, claimed, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM l)",
             "a0 AS (SELECT lang, i, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM t0)"]

    def climb(name: str, group: str, depth: int) -> None:
        for k in range(depth):
            parts.append(f"{name}r{k} AS (SELECT {group}, i // 8 AS i, string_agg(h, '' ORDER BY i) AS run FROM {name}{k} WHERE n > 1 GROUP BY {group}, i // 8)")
            parts.append(f"{name}{k + 1} AS (SELECT {group}, i, sha256(run) AS h, count(*) OVER (PARTITION BY {group}) AS n FROM {name}r{k})")

    def fold(source: str, name: str, group: str, runs: str, depth: int) -> str:
        for k in range(depth):
            own = f"64 * (i // {8**k} % 8)::INT"
            parts.append(f"""{name}{k + 1} AS (SELECT * EXCLUDE (g, gi, run, up) REPLACE (proof || coalesce(run[: {own}] || run[{own} + 65 :], '') AS proof, CASE WHEN run IS NULL THEN fold ELSE sha256(run[: {own}] || fold || run[{own} + 65 :]) END AS fold)
FROM (SELECT *, i // {8 ** (k + 1)} AS up FROM {source}) s LEFT JOIN (SELECT {group} AS g, i AS gi, run FROM {runs}{k}) q ON q.g IS NOT DISTINCT FROM s.{group} AND q.gi = s.up)""")
            source = f"{name}{k + 1}"
        return source

    climb("a", "lang", 9)
    parts.append("roots AS (" + " UNION ALL ".join(f"SELECT lang, h FROM a{k} WHERE n = 1" for k in range(10)) + ")")
    parts.append("b0 AS (SELECT 0 AS top, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, h, count(*) OVER () AS n FROM roots)")
    climb("b", "top", 3)
    parts.append("root AS (" + " UNION ALL ".join(f"SELECT h FROM b{k} WHERE n = 1" for k in range(4)) + ")")
    parts.append("f0 AS (SELECT doc_id, lang, leaf, i, claimed AS fold, '' AS proof FROM t0)")
    last = fold("f0", "f", "lang", "ar", 9)
    parts.append(f"g0 AS (SELECT doc_id, leaf, fold, proof, 0 AS top, p.i, p.h AS subroot FROM {last} f JOIN (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i FROM roots) p ON f.lang IS NOT DISTINCT FROM p.lang)")
    last = fold("g0", "g", "top", "br", 3)
    return "WITH RECURSIVE " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = h AS verified FROM {last}, root"


SQL["op11_merkle_manifest"] = _merkle()


def _conversations() -> str:
    """A recursion along each conversation that carries, for each last role, the cheapest edits so far with their letters."""
    between = {("z", "s"): 0, ("z", "u"): 0, ("z", "a"): 1, ("s", "u"): 0, ("s", "a"): 1, ("u", "u"): 1, ("u", "a"): 0, ("a", "u"): 0, ("a", "a"): 1}
    steps = []
    for to in "zsua":
        ways = [f"CASE WHEN j.{to} IS NOT NULL THEN {{'c': j.{to}.c + 4, 'a': j.{to}.a || 'D'}} END"]
        for (before, after), many in between.items():
            if after == to:
                ways.append(f"CASE WHEN j.{before} IS NOT NULL AND NOT must AND init = '{to}' THEN {{'c': j.{before}.c + {3 * many} + 3 * cut::INT, 'a': j.{before}.a || '{'I' * many}K'}} END")
                if to != "s":
                    ways.append(f"CASE WHEN j.{before} IS NOT NULL AND NOT must THEN {{'c': j.{before}.c + {3 * many + 3} + 3 * cut::INT, 'a': j.{before}.a || '{'I' * many}R'}} END")
        steps.append(f"list_sort(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))[1] AS {to}")
    ends = ", ".join(f"CASE WHEN {q} IS NOT NULL THEN {{'c': {q}.c + {3 * k}, 'a': {q}.a || '{'I' * k}'}} END" for q, k in (("z", 0), ("s", 2), ("u", 1), ("a", 0)))
    return rf"""
WITH RECURSIVE bits(k, c, i) AS (
  SELECT k, k::UBIGINT, 0 FROM range(256) t(k) UNION ALL SELECT k, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END, i + 1 FROM bits WHERE i < 8
), tab AS (SELECT list(c ORDER BY k) AS t FROM bits WHERE i = 8), o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, dense_rank() OVER (ORDER BY conv_id) AS conv,
         xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))), '..'), lambda x: ('0x' || x)::UBIGINT)), lambda c, x: xor(c >> 8, tab.t[(xor(c, x) & 255)::BIGINT + 1]))) % 20 AS fault
  FROM conversations, tab
), d AS (
  SELECT conv, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM o WHERE fault != 0
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, md5(strlen(role) || ':' || role || text), copy) AS i FROM d
), f AS (
  SELECT *, left(role, 1) AS init, NOT regexp_matches(text, '[^ 	-
]') AS blank, row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 AS again,
         NOT regexp_matches(text, '[.!?][ 	-
]*\z') AS open, lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY i) AS prev FROM n
), r AS (
  SELECT *, blank OR again AS must, open AND NOT blank AND NOT again AS cut FROM f
), sums AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(again AND NOT blank) AS duplicate, count_if(cut) AS truncated,
         count_if(prev IS NOT NULL AND prev || init NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS rows FROM r GROUP BY conv
), j(conv, i, z, s, u, a) AS (
  SELECT conv, 0::BIGINT, {{'c': 0::BIGINT, 'a': ''}}, NULL::STRUCT(c BIGINT, a VARCHAR), NULL::STRUCT(c BIGINT, a VARCHAR), NULL::STRUCT(c BIGINT, a VARCHAR) FROM sums
  UNION ALL
  SELECT j.conv, r.i, {", ".join(steps)} FROM j JOIN r ON r.conv = j.conv AND r.i = j.i + 1
), best AS (
  SELECT conv, list_sort(list_filter([{ends}], lambda x: x IS NOT NULL))[1] AS b FROM j JOIN sums USING (conv) WHERE j.i = sums.rows
), letters AS (
  SELECT conv, p, b.a[p : p] AS letter, length(replace(b.a[: p], 'I', '')) AS i, length(replace(b.a[: p], 'D', '')) AS nth FROM (SELECT conv, b, unnest(range(1, length(b.a) + 1)) AS p FROM best)
), made AS (
  SELECT letters.conv, p, nth, CASE WHEN letter = 'K' THEN role END AS own, CASE WHEN letter = 'I' THEN '' ELSE text END AS text,
         count_if(nth = 1 AND letter = 'K' AND init = 's') OVER (PARTITION BY letters.conv) AS has_s
  FROM letters JOIN r ON r.conv = letters.conv AND r.i = greatest(letters.i, 1) WHERE letter != 'D'
), hashed AS (
  SELECT conv, sha256(string_agg(coalesce(own, CASE WHEN (nth - has_s) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY p)) AS h FROM made GROUP BY conv
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv, conv_id FROM o) LEFT JOIN sums USING (conv) LEFT JOIN best USING (conv) LEFT JOIN hashed USING (conv)
"""


SQL["op13_conversation_repair"] = _conversations()
