"""DuckDB SQL with the rows of those queries that SQL can express on whole tables."""

from __future__ import annotations

OP1 = """
WITH share(source, w) AS (VALUES ('src0', 0.10::DOUBLE), ('src1', 0.10), ('src2', 0.15), ('src3', 0.15), (NULL, 0.5)),
named AS (SELECT d.*, s.source AS named FROM documents d LEFT JOIN share s ON d.source = s.source),
size AS (SELECT named, sum(length(text))::DOUBLE AS n FROM named GROUP BY named),
rate AS (SELECT share.source, w / (SELECT sum(w) FROM share) * (SELECT sum(n) FROM size) / n AS mean
         FROM share JOIN size ON share.source IS NOT DISTINCT FROM size.named),
part AS (SELECT source, mean / ceil(mean / 16) AS m, ceil(mean / 16)::BIGINT AS parts FROM rate),
cdf AS (SELECT source, k, sum(exp(-m) * m ** k / gamma(k + 1)) OVER (PARTITION BY source ORDER BY k) AS c
        FROM part, range(0, 80) t(k)),
draw AS (SELECT d.*, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM d.named AND c <= u.u AND c < 1) AS n
         FROM (SELECT *, ('0x' || substr(md5('mix:count:0:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM named) d,
         LATERAL (SELECT d.u) u(u)),
copies AS (SELECT *, unnest(range(0, n)) AS copy_no FROM draw)
SELECT doc_id, text, lang, source, n_chars, copy_no::INTEGER AS copy_no,
       ('0x' || substr(md5('mix:order:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy_no), 1, 15))::BIGINT AS mix_key
FROM copies
"""


OP6 = r"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS row FROM documents),
words AS (SELECT row, t, doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM base),
flat AS (SELECT row, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i FROM words),
windows AS (SELECT row, i, CASE WHEN count(*) OVER f = 8 THEN list(w) OVER f END AS v FROM flat
            WINDOW f AS (PARTITION BY row ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
twice AS (SELECT row, i, v IS NOT NULL AND count(*) OVER (PARTITION BY row, v) > 1 AS r FROM windows),
covered AS (SELECT row, bool_or(r) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS c FROM twice),
repeats AS (SELECT row, count(*) FILTER (c) AS n FROM covered GROUP BY row),
counts AS (SELECT row, doc_id, t, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
                  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
           FROM words LEFT JOIN repeats USING (row)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
                  10 * n_symbols > n_words AS symbols,
                  10 * length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) > 4 * length(regexp_replace(t, '[^\p{L}]', '', 'g')) AND n_words >= 5 AS capitals,
                  word_chars > 15 * n_words OR word_chars < 2 * n_words AS word_length,
                  2 * n_dup_lines > len(string_split(t, chr(10))) AS repeated_lines,
                  10 * length(regexp_replace(t, '[^0-9]', '', 'g')) > 4 * word_chars AS digits,
                  10 * length(regexp_replace(t, '[^\p{L}]', '', 'g')) < 3 * word_chars AS letters FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR symbols OR capitals OR word_length OR repeated_lines OR digits OR letters) AS kept
FROM judged
"""


def op8() -> str:
    """Every pattern on every url; rules by length."""
    from quire.llm.queries import URL_PATTERNS, URL_PREFIXES

    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    rules = ", ".join(f"({quoted(r.host)}, {quoted(r.path)}, {quoted(r.verdict)})" for r in URL_PREFIXES)
    names = ", ".join(f"CASE WHEN regexp_matches(lower(url), {quoted(p.regex)}) THEN {quoted(p.name)} END" for p in URL_PATTERNS)
    return rf"""
WITH rules(h, p, v) AS (VALUES {rules}),
page AS (SELECT page_id, row_number() OVER () AS row, coalesce(url, '') AS url,
                translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
named AS (SELECT *, list_min([x FOR x IN [{names}] IF x IS NOT NULL]) AS pattern FROM page),
fit AS (SELECT row, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS verdict FROM named, rules
        WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY row)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, pattern
FROM named LEFT JOIN fit USING (row)
"""


ORACLE_SQL: dict[str, str] = {"op1_mix_sources": OP1, "op6_quality_cascade": OP6, "op8_url_filters": op8()}
