"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

from tidemark.llm.phrases import PhraseParams
from tidemark.llm.quality import LineRules
from tidemark.llm.urlfilter import RULES

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def url_filters() -> str:
    rules = ", ".join(f"({_text(h)}, {_text(p)}, {_text(a)})" for h, p, a in RULES)
    return f"""WITH rules(rh, rp, act) AS (VALUES {rules}),
      parts AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_UP}', '{_LOW}'), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
      SELECT page_id, host, path, arg_max(rh || rp, length(rh || rp)) AS rule, coalesce(arg_max(act, length(rh || rp)), 'allow') AS verdict
      FROM parts LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id, host, path"""


def quality_rules() -> str:
    r = LineRules()
    terminal = "[" + "".join("\\" + c if c in ".!?" else c for c in r.terminal) + "]$"
    blank = r"[\x20\x09-\x0D]"
    word = r"[^\x20\x09-\x0D]+"
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), w AS (SELECT doc_id, text, regexp_extract_all(text, '{word}') AS ws FROM d),
      tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS t FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w)),
      often AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n FROM tri) WHERE n > 1),
      rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM often, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1),
      l AS (SELECT doc_id, i, line, len(regexp_extract_all(line, '{word}')) AS n FROM (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, unnest(string_split(text, chr(10))) AS line FROM d)),
      j AS (SELECT *, n > 0 AND row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS dup, n > 0 AND ((n >= {r.min_line_words} AND NOT regexp_matches(trim(line, {_text(' ' + chr(9) + chr(11) + chr(12) + chr(13))} || {_text('"' + "'" + '”’»)]}*_')}), {_text(terminal)}))
        OR 100 * len(regexp_extract_all(line, '[#*$%&|<>]')) > {r.max_symbols_pct} * n OR 100 * len(list_filter(regexp_extract_all(line, '{word}'), lambda x: regexp_matches(x, '^[|>»·•/\\-]+$'))) > {r.max_bars_pct} * n OR regexp_matches(line, {_text(r.boilerplate)})) AS bad FROM l),
      s AS (SELECT doc_id, count(*) AS n_lines, sum(dup::INT) AS n_dup, sum(bad::INT) AS n_bad, coalesce(sum(n) FILTER (WHERE bad), 0) AS lost FROM j GROUP BY 1),
      m AS (SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(text, '{blank}', '', 'g')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, n_dup, coalesce(rep.n, 0) AS n_rep, n_lines, n_bad, lost FROM w JOIN s USING (doc_id) LEFT JOIN rep USING (doc_id))
      SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup::BIGINT AS n_dup_lines, n_rep::BIGINT AS n_repeat_words, n_words < {r.min_words} OR 100 * n_rep > {r.max_repeat_pct} * n_words AS base_failed,
        n_lines::BIGINT AS n_lines, n_bad::BIGINT AS n_bad_lines, lost::BIGINT AS n_lost_words, NOT (n_words < {r.min_words} OR 100 * n_rep > {r.max_repeat_pct} * n_words) AND 100 * lost <= {r.max_lost_pct} * n_words AS kept FROM m"""


def line_dedup() -> str:
    blanks = _text(" " + chr(9) + chr(10) + chr(11) + chr(12) + chr(13))
    return f"""WITH l AS (SELECT doc_id, i, line, translate(trim(line, {blanks}), '{_UP}', '{_LOW}') AS k FROM (SELECT doc_id, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)),
      shared AS (SELECT k, max(doc_id) AS own FROM l WHERE length(k) >= 20 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3), j AS (SELECT l.*, own IS NULL OR own = doc_id AS stays FROM l LEFT JOIN shared USING (k))
      SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE NOT stays))::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE stays), '')) AS kept_sha256 FROM j GROUP BY 1"""


def chat_formatting() -> str:
    probe = "'<|im_end|><|im_start|>assistant ok'"
    size = r"len(regexp_extract_all({0}, '<\\*\|'))"
    return rf"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', {probe} UNION ALL SELECT -1, 1, 'assistant', {probe}),
      t AS (SELECT *, length(replace(replace(role, '%', '%25'), chr(10), '%0A')) + {size.format("role")} AS r_len, length(text) + CASE WHEN contains(text, '<|im_start|>') OR contains(text, '<|im_end|>') OR regexp_matches(text, '<\\+\|') THEN {size.format("text")} ELSE 0 END AS t_len FROM c)
      SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(12 + r_len + 1 + t_len + 10 + 1)::BIGINT AS formatted_chars, true AS round_trip FROM t GROUP BY 1"""


def phrase_mining() -> str:
    p = PhraseParams()
    return rf"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_UP}', '{_LOW}') AS t FROM documents),
      w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
      g AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, (SELECT unnest(range(1, {p.max_words} + 1)) AS m) WHERE len(ws) >= m)),
      f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL), total AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY 1),
      c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ps FROM f WHERE m > 1 AND f >= {p.least}),
      cuts AS (SELECT lang, m, phrase, a, k, array_to_string(ps[1:k], ' ') AS pre, array_to_string(ps[k + 1:m], ' ') AS suf FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
      s AS (SELECT cuts.*, x.f AS l, y.f AS r, n, ({p.scale}::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = pre JOIN f y ON y.lang = cuts.lang AND y.phrase = suf JOIN total ON total.lang = cuts.lang),
      best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
      inside AS (SELECT DISTINCT lang, a, unnest([array_to_string(ps[1:m - 1], ' '), array_to_string(ps[2:m], ' ')]) AS phrase FROM c WHERE m > 2)
      SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score, m::INT AS words
      FROM best ANTI JOIN inside USING (lang, phrase, a) QUALIFY rank <= {p.top}"""


def sql() -> dict[str, str]:
    return {
        "op1_url_filters": url_filters(), "op4_quality_rules": quality_rules(), "op5_line_dedup": line_dedup(), "op6_chat_formatting": chat_formatting(), "op11_phrase_mining": phrase_mining(),
    }
