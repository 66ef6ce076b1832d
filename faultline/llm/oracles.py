"""SQL for DuckDB that repeats registered queries, where SQL can express them."""

from __future__ import annotations

from faultline.llm.collocations import Phrases
from faultline.llm.filteraudit import AuditRules
from faultline.llm.linecleaning import MARK_RUN, MARKS, SPACES, SYMBOLS, LineRules
from faultline.llm.secrets import ACCESS, ASSIGN, HEX, EntropyRule

SHARDS, BUCKETS = 8, 8192


def _text(value: str) -> str:
    """An SQL string."""
    return "'" + value.replace("'", "''") + "'"


def _draw(key: str, shard: str) -> str:
    return f"((('0x' || md5({key} || '/' || {shard})[1:13])::BIGINT + 0.5) / 4503599627370496.0)"


OP1 = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""

# The remainder of one byte follows from eight halvings; a text's from its bytes in order.
OP2 = f"""
WITH crc AS (
  SELECT list(list_reduce(list_prepend(n, range(8)),
    lambda c, i: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY n) AS t
  FROM range(256) r(n)),
d AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS k, strlen(coalesce(text, '')) + 1 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
      regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)),
      lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295) AS text_crc32
  FROM documents, crc),
s AS (
  SELECT doc_id, size, text_crc32, k,
    list_sort(list_transform(range({SHARDS}), lambda i: {{'c': -ln({_draw("k", "i")}), 's': i}}))[1].s AS shard,
    list_sort(list_transform(range({SHARDS + 1}), lambda i: {{'c': -ln({_draw("k", "i")}), 's': i}}))[1].s
      AS grown_shard
  FROM d)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard, grown_shard::INTEGER AS grown_shard,
  row_number() OVER (PARTITION BY shard ORDER BY
    ('0x' || md5(k || '/' || size || '/' || text_crc32)[1:8])::BIGINT % {BUCKETS},
    doc_id NULLS FIRST, size, text_crc32) - 1 AS slot
FROM s
"""


def _line_cleaning(rules: LineRules) -> str:
    spaces = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    marks = f"{spaces} || {_text(MARKS)}"

    def without(value: str, dropped: str) -> str:
        return f"length(translate({value}, {dropped}, ''))"

    assert len(SPACES) == 6
    split = r"'[\x20\x09-\x0D]+'"
    fails = f"""(filled > 0 AND (
      regexp_matches(line, {_text(rules.navigation)})
      OR regexp_matches(line, {_text(rules.boilerplate)})
      OR {without("line", marks)} < {rules.letters} * filled
      OR (runs > 0 AND runs >= {rules.mark_runs} * words)
      OR (words <= {rules.short} AND NOT regexp_matches(line, {_text(rules.sentence_end)}))))"""
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT id, list_filter(string_split_regex(t, {split}), lambda x: x <> '') AS ws FROM d),
g AS (
  SELECT id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT id, count(DISTINCT w) AS n FROM (SELECT id, unnest(range(i, i + 3)) AS w FROM r) GROUP BY id),
l AS (SELECT id, unnest(string_split(t, chr(10))) AS line FROM d),
m AS (
  SELECT id, line, {without("line", spaces)} AS filled,
    len(list_filter(string_split_regex(line, {split}), lambda x: x <> '')) AS words,
    len(regexp_extract_all(line, {_text(MARK_RUN)})) AS runs FROM l),
j AS (
  SELECT id, coalesce(sum({without("line", marks)}) FILTER (NOT {fails}), 0) AS left_over,
    sum({without("line", marks)}) AS solid,
    count(*) FILTER (filled > 0) - count(DISTINCT line) FILTER (filled > 0) AS n_dup_lines
  FROM m GROUP BY id),
b AS (
  SELECT doc_id, len(ws) AS n_words, {without("t", spaces)} AS word_chars,
    length(t) - {without("t", _text(SYMBOLS))} AS n_symbols, n_dup_lines,
    coalesce(n, 0) AS n_repeat_words,
    len(ws) < 50 OR 100 * coalesce(n, 0) > 50 * len(ws) AS base_failed,
    left_over >= {rules.kept} * solid AS enough
  FROM d JOIN w USING (id) JOIN j USING (id) LEFT JOIN c USING (id))
SELECT * EXCLUDE (enough), NOT base_failed AND enough AS kept FROM b
"""


def _secrets(rule: EntropyRule) -> str:
    def located(pattern: str) -> str:
        """Starts and strings of all matches in t."""
        return f"""list_transform(regexp_extract_all(t, {_text(pattern)}), lambda m, i: {{
          's': list_sum(list_transform(string_split_regex(t, {_text(pattern)})[1:i], lambda x: length(x)))
             + coalesce(list_sum(list_transform(regexp_extract_all(t, {_text(pattern)})[1:i - 1], lambda x: length(x))), 0),
          'm': m, 'v': regexp_extract(m, {_text(pattern)}, 1)}})"""

    def spans(pattern: str, kind: str, rank: int, keep: str) -> str:
        return f"""list_transform(list_filter({located(pattern)}, lambda x: {keep}), lambda x: {{
          's': x.s::BIGINT, 'r': {rank}, 'k': '{kind}', 'e': (x.s + length(x.m))::BIGINT}})"""

    limit = " ".join(f"WHEN regexp_matches(m, {_text(p)}) THEN {t}" for p, t in rule.classes)
    allowed = " OR ".join(f"regexp_matches(m, {_text(p)})" for p in rule.allowed)
    joined = "array_to_string(list_transform({}, lambda x: x.k || ':' || x.s || ':' || x.e), ',')"
    # Group 1 of the pattern is the value.
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
b AS (
  SELECT id, doc_id, list_sort(
    {spans(ASSIGN, "assign", 0, "length(x.v) >= 12")}
    || {spans("(" + ACCESS + ")", "access", 1, "true")} || {spans("(" + HEX + ")", "hex", 2, "true")}) AS base
  FROM d),
c AS (
  SELECT id, x.s AS s, x.m AS m
  FROM (SELECT id, unnest({located("(" + rule.pattern + ")")}) AS x FROM d)),
h AS (
  SELECT id, s, min(i) AS first, max(i) AS last
  FROM (
    SELECT id, s, i, list_entropy(string_split(m[i + 1:i + {rule.window}], '')) AS h,
      CASE {limit} END AS most
    FROM (SELECT *, unnest(range(length(m) - {rule.window} + 1)) AS i FROM c WHERE NOT ({allowed})))
  WHERE h > most GROUP BY ALL),
e AS (
  SELECT id, list({{'s': (s + first)::BIGINT, 'r': 3, 'k': 'entropy', 'e': (s + last + {rule.window})::BIGINT}}) AS more
  FROM h GROUP BY id)
SELECT doc_id, len(list_filter(base, lambda x: x.r = 0)) AS n_assign,
  len(list_filter(base, lambda x: x.r = 1)) AS n_access, len(list_filter(base, lambda x: x.r = 2)) AS n_hex,
  sha256({joined.format("base")}) AS base_sha256,
  {joined.format("list_sort(base || coalesce(more, []))")} AS spans
FROM b LEFT JOIN e USING (id)
"""


def _filter_audit(rules: AuditRules) -> str:
    letters = "(SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f)"
    orders = ", ".join(f"{letters} f{i}" for i in range(5))
    differ = " AND ".join(f"f{i}.f <> f{j}.f" for j in range(5) for i in range(j))
    sums = ", ".join(
        f"coalesce(sum({what}) FILTER ({where}), 0)::BIGINT AS {name}"
        for name, what, where in (
            ("kept", "n", "mask & (before | bit) = 0"),
            ("removed", "n", "mask & before = 0 AND mask & bit <> 0"),
            ("redundant", "n", "mask & before <> 0 AND mask & bit <> 0"),
            ("unique_fails", "n", "mask = bit"),
            ("good_lost", "good", "mask & before = 0 AND mask & bit <> 0"),
            ("toxic_lost", "toxic", "mask & before = 0 AND mask & bit <> 0"),
        )
    )
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws
  FROM documents),
m AS (
  SELECT doc_id, part,
    (len(ws) < {rules.least_words})::INTEGER
    + 2 * (100 * len(list_distinct(ws)) < {rules.distinct} * len(ws))::INTEGER
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {rules.capitals} * length(t))::INTEGER
    + 8 * regexp_matches(t, {_text("[" + rules.symbols + "]")})::INTEGER
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INTEGER AS mask,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1) AS is_good,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1) AS is_toxic
  FROM d),
c AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (is_good) AS good, count(*) FILTER (is_toxic) AS toxic
  FROM m GROUP BY ALL),
o AS (SELECT f0.f || f1.f || f2.f || f3.f || f4.f AS filter_order FROM {orders} WHERE {differ}),
s AS (
  SELECT filter_order, step::INTEGER AS step, filter_order[step] AS f, 1 << (ascii(filter_order[step]) - 65) AS bit,
    CASE WHEN step = 1 THEN 0 ELSE list_sum(list_transform(
      string_split(filter_order[1:step - 1], ''), lambda x: 1 << (ascii(x) - 65))) END::INTEGER AS before
  FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (
  SELECT part, filter_order, step, bit, {sums}
  FROM s CROSS JOIN c GROUP BY ALL)
SELECT * EXCLUDE (bit), sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM r
"""


def _collocations(spec: Phrases) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH t AS (
  SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), '{upper}', '{lower}') AS t FROM documents),
p AS (SELECT id, lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM t),
w AS (
  SELECT lang, list_filter(string_split_regex(p, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM w, (SELECT unnest(range(1, {spec.longest + 1})) AS size))),
n AS (SELECT lang, count(*) AS n FROM g WHERE size = 1 GROUP BY lang),
f AS (
  SELECT lang, size, phrase, count(*) AS f, string_split(phrase, ' ') AS w
  FROM g GROUP BY ALL HAVING count(*) >= {spec.least}),
c AS (
  SELECT lang, phrase, f AS a, size, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, size)) AS k FROM f WHERE size > 1)),
s AS (
  SELECT c.lang, c.phrase, c.a, k, h.f AS l, e.f AS r,
    (c.a::HUGEINT * {spec.scale} // (h.f + e.f))::BIGINT AS score
  FROM c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f e ON e.lang = c.lang AND e.phrase = c.tail),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (
  SELECT lang, array_to_string(w[j:j + m - 1], ' ') AS phrase, max(f) AS longer
  FROM (SELECT *, unnest(range(1, size - m + 2)) AS j
        FROM (SELECT *, unnest(range(2, size)) AS m FROM f WHERE size > 2))
  GROUP BY ALL),
k AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank
  FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase
  WHERE longer IS NULL OR 100 * longer::HUGEINT < {spec.absorbed} * a::HUGEINT)
SELECT k.lang, rank, phrase, a, l, r, n, score FROM k JOIN n ON n.lang = k.lang WHERE rank <= {spec.top}
"""


SQL: dict[str, str] = {
    "op1_warc": OP1,
    "op2_sharding": OP2,
    "op7_line_cleaning": _line_cleaning(LineRules()),
    "op9_secrets": _secrets(EntropyRule()),
    "op12_filter_audit": _filter_audit(AuditRules()),
    "op13_collocations": _collocations(Phrases()),
}
