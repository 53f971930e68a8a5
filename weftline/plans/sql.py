"""Fragments of DuckDB SQL from which the oracles are put together."""

from __future__ import annotations

from weftline.functions import text as t
from weftline.operators import sentences as st


def values(rows: list[tuple], columns: str) -> str:
    """A table of literals; ``columns`` is 'name type, ...' with DuckDB types."""
    names = [c.split()[0] for c in columns.split(", ")]
    kinds = [c.split()[1] for c in columns.split(", ")]

    def literal(x, kind: str) -> str:
        if x is None:
            return f"NULL::{kind}"
        if isinstance(x, list):
            return "[" + ", ".join(literal(y, kind.removesuffix("[]")) for y in x) + f"]::{kind}"
        if isinstance(x, str):
            plain = "".join(c if c.isprintable() else f"'||chr({ord(c)})||'" for c in x.replace("'", "''"))
            return f"('{plain}')::{kind}"
        return f"{x}::{kind}"

    body = " UNION ALL ".join("SELECT " + ", ".join(f"{literal(x, k)} AS {n}" for x, n, k in zip(r, names, kinds, strict=True)) for r in rows)
    return f"({body})"


def clean(x: str) -> str:
    """Cleaning."""
    x = f"translate(coalesce({x}, ''), '{t.UNICODE_SPACES}', '{' ' * len(t.UNICODE_SPACES)}')"
    x = f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    x = f"regexp_replace({x}, ' {{3,}}', '  ', 'g')"
    x = f"regexp_replace({x}, '{t.CONTROL}', '', 'g')"
    x = f"translate({x}, chr(9), ' ')"
    x = f"regexp_replace({x}, '[{t.LINE_SPACE}]+(\\n|\\z)', '\\1', 'g')"
    return f"regexp_replace({x}, '\\A[{t.LINE_SPACE}\\n]+|[{t.LINE_SPACE}\\n]+\\z', '', 'g')"


def strip(x: str) -> str:
    """Stripping."""
    return f"regexp_replace({x}, '\\A[{t.ANY_SPACE}]+|[{t.ANY_SPACE}]+\\z', '', 'g')"


def tokens(x: str) -> str:
    """Tokens."""
    return f"regexp_extract_all(lower({x}), '{t.WORD}')"


def sentences(x: str) -> str:
    """Sentences."""
    return f"list_filter(list_transform(regexp_extract_all({x}, '{t.SENTENCE}'), lambda s: {strip('s')}), lambda s: length(s) > {t.MIN_SENTENCE})"


def punkt_ctes(table: str, key: str, text: str) -> str:
    """CTEs up to ``pk_sentences`` (id, sentence_no, sentence), with the tables of abbreviations and starters."""
    quoted = {k: v.replace("'", "''") for k, v in {"fragment": st.FRAGMENT, "last": st._LAST, "next": st._NEXT, "stop": st._STOP}.items()}

    def log(p: str, k: str, n: str) -> str:
        return f"({k} * ln({p}) + ({n} - {k}) * ln(1.0::DOUBLE - {p}))"

    def kept(p: str) -> str:
        return f"least(greatest({p}, 1e-9), 1 - 1e-9)"

    letters = "(length(word) - inside)"
    return f"""
pk_words AS (SELECT word, count(*) AS n, count(*) FILTER (regexp_matches(w, '[^.]\\.$')) AS n_stop
  FROM (SELECT w, regexp_replace(w, '\\.+$', '') AS word FROM (SELECT unnest(regexp_extract_all(lower({text}), '{st.WORD}')) AS w FROM {table})) GROUP BY word),
pk_total AS (SELECT sum(n)::DOUBLE AS total, sum(n_stop)::DOUBLE AS stops FROM pk_words),
pk_rated AS (SELECT word, n, n_stop, length(word) - length(replace(word, '.', '')) AS inside,
  2 * ({log(str(st.STOPS) + '::DOUBLE', 'n_stop::DOUBLE', 'n::DOUBLE')} - {log(kept('stops / total'), 'n_stop::DOUBLE', 'n::DOUBLE')}) AS ratio FROM pk_words, pk_total WHERE n_stop > 0),
pk_short AS (SELECT * FROM (SELECT word, n, n_stop, round(ratio * exp(-{letters}::DOUBLE) * (inside + 1) * pow({letters}::DOUBLE, -(n - n_stop)::DOUBLE), 6) AS score FROM pk_rated) WHERE score >= {st.ABBREVIATION}),
pk_cut AS (SELECT {key} AS id, regexp_extract_all({text}, '{quoted["fragment"]}') AS f FROM {table}),
pk_each AS (SELECT id, unnest(range(len(f))) AS i, unnest(f) AS fragment FROM pk_cut),
pk_next AS (SELECT *, lead(fragment) OVER (PARTITION BY id ORDER BY i) AS following FROM pk_each),
pk_pieces AS (SELECT id, i, fragment, lower(regexp_extract(fragment, '{quoted["last"]}', 1)) AS word, regexp_extract(following, '{quoted["next"]}', 1) AS next, regexp_matches(fragment, '{quoted["stop"]}') AS stop FROM pk_next),
pk_ends AS (SELECT word, lower(next) AS next FROM pk_pieces WHERE stop AND word <> '' AND next <> '' AND word NOT IN (SELECT word FROM pk_short)),
pk_follow AS (SELECT next AS word, count(*)::DOUBLE AS k FROM pk_ends GROUP BY 1),
pk_start AS (SELECT * FROM (SELECT word, n, k::BIGINT AS n_start, round(2 * ({log(kept('k / e'), 'k', 'e')} + {log(kept('(n - k) / (total - e)'), '(n - k)', '(total - e)')} - {log(kept('n / total'), 'k', 'e')} - {log(kept('n / total'), '(n - k)', '(total - e)')}), 4) AS score
  FROM pk_follow JOIN pk_words USING (word), pk_total, (SELECT count(*)::DOUBLE AS e FROM pk_ends) WHERE k * total > e * n) WHERE score >= {st.STARTER}),
pk_judged AS (SELECT id, i, fragment, CASE WHEN stop AND coalesce(regexp_matches(next, '^\\p{{Ll}}') OR (length(word) = 1 AND regexp_matches(next, '^\\p{{Lu}}'))
    OR (word IN (SELECT word FROM pk_short) AND NOT (lower(next) IN (SELECT word FROM pk_start) AND regexp_matches(next, '^\\p{{Lu}}'))), false) THEN 0 ELSE 1 END AS ends FROM pk_pieces),
pk_no AS (SELECT *, coalesce(sum(ends) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM pk_judged),
pk_whole AS (SELECT id, no, {strip("string_agg(fragment, '' ORDER BY i)")} AS sentence FROM pk_no GROUP BY id, no),
pk_sentences AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY no) - 1 AS sentence_no, sentence FROM pk_whole WHERE sentence <> '')"""


def chunks(source: str, keys: str, text: str, size: int = 12, overlap: int = 2, least: int = 50) -> str:
    """(keys, chunk_index, total_chunks, chunk_text) of ``source``."""
    step = size - overlap if size > overlap else size
    last = f"CASE WHEN len(s) <= {size} THEN 0 ELSE ceil((len(s) - {size}) / {step})::BIGINT END"
    windows = f"list_filter(list_transform(range({last} + 1), lambda k: array_to_string(s[k * {step} + 1:k * {step} + {size}], ' ')), lambda w: length(w) >= {least})"
    return f"""(
SELECT {keys}, unnest(range(len(c)))::INTEGER AS chunk_index, len(c)::INTEGER AS total_chunks, unnest(c) AS chunk_text FROM (
  SELECT {keys}, CASE WHEN x IS NULL THEN [] WHEN length({strip('x')}) < {least} THEN CASE WHEN {strip('x')} = '' THEN [] ELSE [x] END
    WHEN len(s) = 0 THEN [] WHEN len(w) = 0 THEN [{strip('x')}] ELSE w END AS c
  FROM (SELECT {keys}, x, s, {windows} AS w FROM (SELECT {keys}, x, {sentences('x')} AS s FROM (SELECT {keys}, {text} AS x FROM {source})))))"""


def weight_ctes(chunk_table: str) -> str:
    """CTEs up to ``kw_idf`` (token, df, idf) from (chunk_id, text)."""
    return f"""
kw_tok AS (SELECT chunk_id, {tokens("coalesce(text, '')")} AS toks FROM {chunk_table}),
kw_post AS (SELECT chunk_id, len(toks) AS dl, token, count(*) AS tf FROM (SELECT chunk_id, toks, unnest(toks) AS token FROM kw_tok) GROUP BY ALL),
kw_stat AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM kw_tok),
kw_raw AS (SELECT token, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM kw_post, kw_stat GROUP BY token),
kw_idf AS (SELECT token, df, CASE WHEN raw < 0 THEN (SELECT avg(raw) * 0.25 FROM kw_raw) ELSE raw END AS idf FROM kw_raw)"""


def keyword_ctes(chunk_table: str, query_table: str, k: int | None) -> str:
    """CTEs up to ``kw_top`` (query_id, chunk_id, score, rank) from (chunk_id, text) and (query_id, question)."""
    cut = f"WHERE rank <= {k}" if k else ""
    return f"""{weight_ctes(chunk_table)},
kw_ask AS (SELECT query_id, token, count(*) AS qf FROM (SELECT query_id, unnest({tokens('question')}) AS token FROM {query_table}) GROUP BY ALL),
kw_sum AS (SELECT query_id, chunk_id, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
           FROM kw_ask JOIN kw_idf USING (token) JOIN kw_post USING (token), kw_stat GROUP BY ALL),
kw_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM kw_sum WHERE score > 0) {cut})"""


def fused(keyword: str, semantic: str, k: int, least: float, kw: float = 0.3, sw: float = 0.7) -> str:
    """(query_id, chunk_id, score, rank) from two lists."""
    scaled = lambda c: f"CASE WHEN max({c}) OVER w = min({c}) OVER w THEN 1.0 ELSE ({c} - min({c}) OVER w) / nullif(max({c}) OVER w - min({c}) OVER w, 0) END"
    return f"""(SELECT * FROM (
  SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT query_id, chunk_id, round({kw}::DOUBLE * ({scaled('kws')}) + {sw}::DOUBLE * ({scaled('sems')}), 6) AS score
    FROM (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, coalesce(a.score, 0.0)::DOUBLE AS kws, coalesce(b.score, 0.0)::DOUBLE AS sems
          FROM {keyword} a FULL JOIN {semantic} b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id)
    WINDOW w AS (PARTITION BY query_id)) WHERE score >= {least}) WHERE rank <= {k})"""


def hashed(table: str, key: str, text: str, dim: int = 64) -> str:
    """(key, b, x): the hashing embedder's vectors, sparse."""
    bucket = f"('0x' || substr(md5(token), 1, 8))::BIGINT % {dim}"
    return f"""(SELECT {key}, b, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS x FROM (
  SELECT {key}, {bucket} AS b, count(*)::DOUBLE AS n FROM (SELECT {key}, unnest({tokens(text)}) AS token FROM {table}) GROUP BY ALL))"""


def spans(source: str, keys: str, text: str, question: str) -> str:
    """(keys, s, e): merged highlight spans, as gaps and islands."""
    return f"""(
SELECT {keys}, min(s) AS s, max(e) AS e FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM (
      SELECT {keys}, e - length(word) AS s, e FROM (
        SELECT {keys}, word, (list_sum(list_transform(ps[1:i], lambda p: length(p))) + i * length(word))::BIGINT AS e FROM (
          SELECT {keys}, word, ps, unnest(range(1, len(ps))) AS i FROM (
            SELECT {keys}, word, string_split(lower(x), word) AS ps FROM (
              SELECT {keys}, {text} AS x, unnest(list_distinct({tokens(question)})) AS word FROM {source}))))))) GROUP BY {keys}, island)"""


def line_number(x: str, position: str) -> str:
    """The line of a position from 0."""
    before = f"substr({x}, 1, {position})"
    return f"CASE WHEN {position} >= 0 AND {position} < length({x}) THEN length({before}) - length(replace({before}, chr(10), '')) + 1 ELSE 1 END"
