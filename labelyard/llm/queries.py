"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bytebpe, chat, langid, media, neardup, outliers, packing, periodic, quality, repair, tokenfiles, toxicity, urlrep
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.tokenized_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces)


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_schema_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = r"\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.formatted_turns(chat.canonical_turns(chat.turn_records(rows.unionByName(added)))))


def op7_media_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.columns(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return bytebpe.digests(bytebpe.decode(bytebpe.encode(table(spark, sf_dir, "documents"), ranks, pattern), ranks, pattern))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents"))


def op8_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrep.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op10_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judge(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(table(spark, sf_dir, "documents"), periodic.plant)


def op12_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenfiles.written_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.report(repair.damaged(table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Query]:
    own = [op1_best_fit_packing, op2_toxicity, op3_minhash_near_dedup, op4_language_mixture, op5_schema_chat, op6_byte_bpe, op7_media_sequences, op8_quality_trees, op9_host_reputation, op10_robust_outliers, op11_periodic_runs, op12_orc_tokens, op13_conversation_repair]
    return {q.__name__: q for q in own}


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: All pairs that share a shingle, their exact similarity, and components.
NEAR_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (sh) WHERE a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
two AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, t.b FROM reach r JOIN two t ON r.b = t.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM comp LEFT JOIN n USING (doc_id)"""

#: The template's lengths follow from its escapes; digests are of texts in order.
CHAT_SQL = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\t')) AS body,
  length(replace(replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\t'), ':', '\c'), chr(10), '\n')) AS head FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(4 + head + 2 + body + 8)::BIGINT AS formatted_chars, 0::BIGINT AS n_unmapped
FROM e GROUP BY conv_id"""


def _level_sql(level: str, rows: str, mean: str) -> str:
    """CTEs of a level's strength and posterior from ``rows`` with n, k and ``mean``."""
    return f"""{level}_m AS ({rows}),
{level}_s AS (SELECT CASE WHEN more > 0 AND seen > plain THEN least({urlrep.STRONGEST}, greatest({urlrep.WEAKEST}, more / (seen - plain) - 1)) ELSE {urlrep.STRONGEST} END AS s
  FROM (SELECT sum(pow(k - n * {mean}, 2)) AS seen, sum(n * {mean} * (1 - {mean})) AS plain, sum(n * (n - 1) * {mean} * (1 - {mean})) AS more FROM {level}_m WHERE n > 0)),
{level}_p AS (SELECT {level}, n, k, s, {mean} AS mean, n + s AS size, (k + s * {mean}) / (n + s) AS rate FROM {level}_m, {level}_s)"""


def _beta_sql(a: str, b: str, x: float) -> str:
    """The beta distribution's function by its continued fraction, as in ``urlrep.beta_below``."""

    def side(p: str, q: str, x: float) -> str:
        even = f"(i // 2) * ({q} - i // 2) / (({p} + 2 * (i // 2) - 1) * ({p} + 2 * (i // 2)))"
        odd = f"-({p} + i // 2) * ({p} + {q} + i // 2) / (({p} + 2 * (i // 2)) * ({p} + 2 * (i // 2) + 1))"
        terms = f"list_transform(range({urlrep.TERMS}, 0, -1), lambda i: ((CASE WHEN i % 2 = 0 THEN {even} ELSE {odd} END) * {x})::DOUBLE)"
        return f"exp(lgamma({p} + {q}) - lgamma({p}) - lgamma({q}) + {p} * ln({x}) + {q} * ln({1 - x})) / {p} / list_reduce(list_concat([1.0::DOUBLE], {terms}), lambda f, d: 1 + d / f)"

    z = f"({x} - {a} / ({a} + {b})) / sqrt({a} * {b} / pow({a} + {b}, 2) / ({a} + {b} + 1))"
    return f"CASE WHEN {a} + {b} > {urlrep.LARGE} THEN 1 / (1 + exp(-1.5976 * {z} - 0.070566 * pow({z}, 3))) WHEN {x} < ({a} + 1) / ({a} + {b} + 2) THEN {side(a, b, x)} ELSE 1 - {side(b, a, 1 - x)} END"


_FIT = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{}}'".replace("{}", f"{h}{p}") for _, h, p in sorted(urlrep.RULES, key=lambda r: -len(r[1] + r[2])))
_SAY = " ".join(f"WHEN '{h}{p}' THEN '{v}'" for v, h, p in urlrep.RULES)
HOST_SQL = rf"""WITH p AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest,
  regexp_replace(html, '{urlrep.HIDDEN}', ' ', 'g') AS t FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path, t,
  len(regexp_split_to_array(trim(t), '\s+')) AS words, greatest(length(t), 1) AS size FROM p),
o AS (SELECT page_id, host, path, CASE WHEN t IS NOT NULL THEN (words < 30 OR length(t) - length(translate(t, '#*$%&', '')) > 0.03 * size OR length(t) - length(translate(t, '|', '')) > 0.2 * words
  OR length(t) - length(translate(t, '!', '')) > 0.2 * words OR length(t) - length(translate(t, '{UPPER}', '')) > 0.3 * size)::INT END AS bad FROM q),
h0 AS (SELECT host, regexp_replace(host, ':[0-9]*$', '') AS name, count(bad) AS n, coalesce(sum(bad), 0) AS k FROM o GROUP BY 1),
h1 AS (SELECT *, regexp_extract(name, '{urlrep.DOMAIN}', 1) AS found FROM h0),
h AS (SELECT host, CASE WHEN single THEN name ELSE found END AS domain, CASE WHEN single THEN name ELSE regexp_replace(found, '^[^.]*\.', '') END AS suffix, n, k FROM (SELECT *, found = '' OR regexp_full_match(name, '[0-9.]*') AS single FROM h1)),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY ALL), x AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY ALL),
{_level_sql("suffix", "SELECT *, ((SELECT sum(k) FROM x) - k + 1) / ((SELECT sum(n) FROM x) - n + 2) AS mean FROM x", "mean")},
{_level_sql("domain", "SELECT d.*, (u.k - d.k + u.s * u.mean) / (u.n - d.n + u.s) AS mean FROM d JOIN suffix_p u USING (suffix)", "mean")},
{_level_sql("host", "SELECT h.*, (u.k - h.k + u.s * u.mean) / (u.n - h.n + u.s) AS mean FROM h JOIN domain_p u USING (domain)", "mean")},
r AS (SELECT page_id, host, path, CASE {_FIT} END AS rule FROM o)
SELECT page_id, host, path, rule, CASE rule {_SAY} ELSE (CASE WHEN risk <= {urlrep.RISK} THEN 'block' ELSE 'allow' END) END AS verdict
FROM r JOIN (SELECT host, {_beta_sql("a", "b", urlrep.ACCEPTED)} AS risk FROM (SELECT host, size * rate AS a, size * (1 - rate) AS b FROM host_p)) USING (host)"""


def _crc_sql(text: str) -> str:
    """crc32 of an ASCII text, bit by bit."""
    bits = "list_reduce(list_concat([xor(c, b)], range(8)), lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda z: ascii(z)::BIGINT)), lambda c, b: {bits}), 4294967295)"


#: Pairs of equal grams at every distance, gaps and islands of each distance, the smallest period of
#: equal stretches.
RUNS_SQL = f"""WITH h AS (SELECT doc_id, {_crc_sql("doc_id::VARCHAR")} AS h, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
b AS (SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM b),
d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS w FROM p),
g AS (SELECT doc_id, n, i, array_to_string(w[i + 1:i + 8], ' ') AS gram FROM (SELECT *, unnest(range(n - 7)) AS i FROM d WHERE n >= 24)),
pair AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM g x JOIN g y USING (doc_id, gram) WHERE y.i > x.i AND 3 * (y.i - x.i) <= x.n),
isle AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle FROM pair),
stretch AS (SELECT doc_id, q, min(i) AS start, max(i) - min(i) + 8 + q AS length FROM isle GROUP BY doc_id, q, isle),
run AS (SELECT doc_id, start, length, min(q) AS period FROM stretch GROUP BY ALL HAVING length >= greatest(24, 3 * min(q))),
best AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DECIMAL(18, 0) / period DESC, start, period) = 1),
every AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS said FROM run GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
left_over AS (SELECT doc_id, string_agg(w[i + 1], ' ' ORDER BY i) AS said FROM (SELECT doc_id, w, unnest(range(n)) AS i FROM d) ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(every.said, '')) AS runs_sha256, sha256(coalesce(left_over.said, '')) AS collapsed_sha256
FROM d LEFT JOIN every USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN left_over USING (doc_id)"""


def _edit_sql(state: str, cost: str, letter: str) -> str:
    """A state's text: its cost in eight digits, then its edits; the least text is the cheapest."""
    return f"printf('%08d', substr({state}, 1, 8)::INT + {cost}) || substr({state}, 9) || '{letter}'"


def _repair_sql() -> str:
    n = repair
    keep = lambda s, ch: f"CASE WHEN NOT must AND ch = '{ch}' THEN {_edit_sql(s, 'more', 'K')} END"
    role = lambda s: f"CASE WHEN NOT must THEN {_edit_sql(s, f'more + {n.REROLE}', 'R')} END"
    drop = lambda s: _edit_sql(s, str(n.DELETE), "D")
    ins = lambda s: _edit_sql(s, str(n.INSERT), "I")
    return rf"""WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS h FROM conversations),
d AS (SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM t),
o AS (SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said,
  CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS ch FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
f AS (SELECT *, lag(ch) OVER (PARTITION BY conv_id ORDER BY i) AS prior, CASE WHEN said = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o),
r AS (SELECT conv_id, i, role, text, ch, fault IN ('blank', 'duplicate') AS must, CASE fault WHEN 'truncated' THEN {n.TRUNCATED} ELSE 0 END AS more FROM f),
dp AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, '00000000' AS z, NULL::VARCHAR AS s, '0000000{n.INSERT}I' AS u, '0000000{2 * n.INSERT}II' AS a FROM r
  UNION ALL SELECT conv_id, i, z, s, u, least(a, {ins("u")}) FROM (SELECT conv_id, i, z, s, least(u, {ins("z")}, {ins("s")}, {ins("a")}) AS u, a FROM (
    SELECT r.conv_id, r.i, {drop("z")} AS z, least({drop("s")}, {keep("z", "s")}) AS s,
      least({drop("u")}, {keep("z", "u")}, {keep("s", "u")}, {keep("a", "u")}, {role("z")}, {role("s")}, {role("a")}) AS u, least({drop("a")}, {keep("u", "a")}, {role("u")}) AS a
    FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = dp.i + 1))),
best AS (SELECT conv_id, substr(e, 1, 8)::BIGINT AS cost, substr(e, 9) AS audit FROM (SELECT conv_id, least(z, a) AS e FROM dp QUALIFY i = max(i) OVER (PARTITION BY conv_id))),
l AS (SELECT *, audit[k] AS letter FROM (SELECT *, unnest(range(1, length(audit) + 1)) AS k FROM best)),
m AS (SELECT *, sum((letter <> 'I')::INT) OVER w AS i, sum((letter <> 'D')::INT) OVER w AS place FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
x AS (SELECT m.conv_id, k, letter, place, r.role, r.text, max((letter = 'K' AND ch = 's')::INT) OVER (PARTITION BY m.conv_id) AS led FROM m LEFT JOIN r ON m.conv_id IS NOT DISTINCT FROM r.conv_id AND m.i = r.i AND letter <> 'I'),
y AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY k) AS said FROM x WHERE letter <> 'D' GROUP BY 1),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
  count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE prior || ch NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN y ON y.conv_id IS NOT DISTINCT FROM o.conv_id"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express a query; tests compare the others with brute force."""
    return {"op3_minhash_near_dedup": NEAR_SQL, "op5_schema_chat": CHAT_SQL, "op9_host_reputation": HOST_SQL, "op11_periodic_runs": RUNS_SQL, "op13_conversation_repair": _repair_sql()}
