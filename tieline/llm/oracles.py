"""DuckDB SQL for the queries whose whole answer SQL can state."""

from __future__ import annotations

from tieline.llm.mixing import MARGINS, RATE, ROUNDS, SCALINGS
from tieline.llm.site_lines import MIN_PAGES, RATIO
from tieline.llm.site_quality import FOLD, FOLDS, MEASURES

BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def site_lines_sql() -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, coalesce(source, '') AS host FROM documents),
pages AS (SELECT DISTINCT host, text FROM d),
totals AS (SELECT host, count(*) AS total FROM pages GROUP BY host),
lines AS (SELECT DISTINCT host, text, trim(unnest(string_split(text, chr(10))), {BLANK}) AS line FROM pages WHERE text IS NOT NULL),
bad AS (SELECT l.host, line FROM lines l JOIN totals t ON t.host = l.host WHERE line <> '' GROUP BY l.host, line, total
        HAVING count(*) >= {MIN_PAGES} AND count(*) > total * {RATIO}),
split AS (SELECT r, host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d WHERE text IS NOT NULL),
marked AS (SELECT s.*, b.line IS NOT NULL AS gone FROM split s LEFT JOIN bad b ON b.host = s.host AND b.line = trim(s.line, {BLANK})),
cut AS (SELECT r, count(*) AS n, count(*) FILTER (WHERE gone) AS g, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM marked GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_lines, coalesce(g, 0) AS n_dropped, CASE WHEN text IS NOT NULL THEN coalesce(kept, '') END AS text
FROM d LEFT JOIN cut ON cut.r = d.r"""


def mix_sql() -> str:
    keys = ", ".join(f"coalesce({m}, '') AS {m}" for m in ("source", "lang"))
    steps = [f"""WITH w AS (SELECT *, len({WORDS}) AS n_tokens, length(regexp_replace(coalesce(text, ''), '[^|]+', '', 'g')) AS bars FROM documents),
d AS (SELECT doc_id, {keys}, n_tokens, CASE WHEN bars > 0 AND bars * 10 >= n_tokens THEN 'table' WHEN n_tokens < 100 THEN 'note'
      WHEN n_tokens < 1000 THEN 'article' ELSE 'long' END AS topic FROM w),
x0 AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens, sum(n_tokens)::DOUBLE AS weight FROM d GROUP BY ALL HAVING sum(n_tokens) > 0)"""]
    for m, power in MARGINS.items():
        steps.append(f"t_{m} AS (SELECT {m}, pow(sum(tokens), {power}) / sum(pow(sum(tokens), {power})) OVER () * (SELECT sum(tokens) FROM x0) AS goal FROM x0 GROUP BY {m})")
    k = 0
    for _ in range(ROUNDS):
        for m in MARGINS:
            steps.append(f"x{k + 1} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.tokens, c.weight * t.goal / sum(c.weight) OVER (PARTITION BY c.{m}) AS weight FROM x{k} c JOIN t_{m} t ON t.{m} = c.{m})")
            k += 1
    steps.append(f"c0 AS (SELECT {RATE}::DOUBLE AS c)")
    for i in range(SCALINGS):
        steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c * {RATE} * (SELECT sum(tokens) FROM x0) / (SELECT sum(least(1.0, weight / tokens * c) * tokens) FROM x{k}) AS c FROM c{i})")
    return ",\n".join(steps) + f""",
p AS (SELECT source, lang, topic, round(least(1.0, weight / tokens * (SELECT c FROM c{SCALINGS})), 9) AS probability FROM x{k})
SELECT doc_id, n_tokens, d.topic, coalesce(probability, {RATE}) AS probability,
       ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE < coalesce(probability, {RATE}) AS sampled
FROM d LEFT JOIN p ON p.source = d.source AND p.lang = d.lang AND p.topic = d.topic"""


def quality_score_sql() -> str:
    def only(cls):
        return f"length(regexp_replace(t, '[^{cls}]+', '', 'g'))"
    values = {"words": "nw", "symbols": f"{only('#*$%&|<>')} * 1000 // per", "upper": f"{only(chr(92) + 'p{Lu}')} * 1000 // per", "variety": "len(list_distinct(w)) * 100 // n",
              "word_length": "length(array_to_string(w, '')) // n", "marks": f"{only('!')} * 1000 // per"}
    bins = ", ".join(f"({' + '.join(f'({values[m]} >= {c})::INT' for c in cuts)}) AS {m}" for m, cuts in MEASURES.items())
    pairs = " UNION ALL ".join(f"SELECT '{m}' AS m, {m} AS b, good FROM learn" for m in MEASURES)
    grid = " UNION ALL ".join(f"SELECT '{m}' AS m, unnest(range({len(c) + 1})) AS b, {len(c) + 1} AS cells" for m, c in MEASURES.items())
    llr = " + ".join(f"(SELECT v FROM ev WHERE m = '{m}' AND b = f.{m})" for m in MEASURES)
    return f"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(lang, '') AS path, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
c AS (SELECT *, len(w) AS nw, greatest(len(w), 1) AS n, greatest(length(t), 1) AS per FROM w),
f AS (SELECT doc_id, host, path, {bins} FROM c),
crc AS (SELECT list(r ORDER BY i) AS t FROM (WITH RECURSIVE s(i, k, r) AS (
    SELECT unnest(range(256))::BIGINT, 0, unnest(range(256))::BIGINT UNION ALL
    SELECT i, k + 1, CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END FROM s WHERE k < 8) SELECT i, r FROM s WHERE k = 8)),
h AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % {FOLDS} = {FOLD} AS held_out FROM (SELECT DISTINCT doc_id FROM documents), crc),
marks AS (SELECT doc_id, avg(quality) AS good FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
learn AS (SELECT f.*, good FROM f JOIN h USING (doc_id) JOIN marks USING (doc_id) WHERE NOT held_out),
paths AS (SELECT host, path, count(*) AS n, sum(good) AS k FROM learn GROUP BY host, path),
hosts AS (SELECT host, sum(n) AS hn, sum(k) AS hk, sum(n * n) AS nn, count(*) AS np FROM paths GROUP BY host),
tot AS (SELECT sum(hn)::DOUBLE AS n, sum(hk) / sum(hn) AS prior, sum(hn * hn) AS sq, count(*) AS nh, sum(np) AS np, sum(nn / hn) AS within FROM hosts),
sp AS (SELECT prior, prior * (1 - prior) AS var,
   ((SELECT sum(hn * pow(hk / hn - prior, 2)) FROM hosts) - (nh - 1) * prior * (1 - prior)) / (n - sq / n) AS vh,
   ((SELECT sum(p.n * pow(p.k / p.n - hk / hn, 2)) FROM paths p JOIN hosts USING (host)) - (np - nh) * prior * (1 - prior)) / (n - within) AS vp FROM tot),
ms AS (SELECT prior, CASE WHEN vh > 0 THEN least(greatest(var / vh - 1, 1.0), 1e6) ELSE 1e6 END AS mh, CASE WHEN vp > 0 THEN least(greatest(var / vp - 1, 1.0), 1e6) ELSE 1e6 END AS mp FROM sp),
hr AS (SELECT host, (hk + mh * prior) / (hn + mh) AS host_rate FROM hosts, ms),
pr AS (SELECT p.host, path, (k + mp * host_rate) / (n + mp) AS path_rate FROM paths p JOIN hr ON hr.host = p.host, ms),
cnt AS (SELECT m, b, sum(good) AS g, count(*) - sum(good) AS p FROM ({pairs}) GROUP BY m, b),
cells AS (SELECT q.m, q.b, cells, coalesce(g, 0) AS g, coalesce(p, 0) AS p FROM ({grid}) q LEFT JOIN cnt ON cnt.m = q.m AND cnt.b = q.b),
ev AS (SELECT m, b, ln((g + 1) / (sum(g) OVER (PARTITION BY m) + cells)) - ln((p + 1) / (sum(p) OVER (PARTITION BY m) + cells)) AS v FROM cells),
s AS (SELECT f.doc_id, held_out, {llr} AS evidence, coalesce(host_rate, prior) AS host_rate, least(greatest(coalesce(path_rate, host_rate, prior), 1e-6), 1 - 1e-6) AS path_rate
      FROM f JOIN h USING (doc_id) LEFT JOIN hr ON hr.host = f.host LEFT JOIN pr ON pr.host = f.host AND pr.path = f.path, ms),
z AS (SELECT *, 1 / (1 + exp(-(evidence + ln(path_rate / (1 - path_rate))))) AS score FROM s)
SELECT doc_id, held_out, round(evidence, 6) AS evidence, round(host_rate, 6) AS host_rate, round(path_rate, 6) AS path_rate, round(score, 6) AS score, score >= 0.5 AS kept FROM z"""
