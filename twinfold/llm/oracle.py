"""The queries of this subpackage in plain SQL, where SQL can express them."""

from __future__ import annotations

import re

from twinfold.llm import centroids, chat, decontaminate, fill_middle, mixing, quality_rules, secret_scan

_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _mixing() -> str:
    weights = ", ".join(f"{w}.0::DOUBLE" for w in mixing.SOURCE_WEIGHTS)
    return rf"""
    WITH sized AS (
      SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size,
             length(regexp_replace(coalesce(text, ''), '[^{mixing.SYMBOLS}]+', '', 'g')) AS symbols
      FROM documents),
    keyed AS (
      SELECT *, CASE WHEN size = 0 THEN 1.0::DOUBLE ELSE size::DOUBLE / (size + symbols) END AS weight,
             (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / {1 << 52}::DOUBLE AS u
      FROM sized),
    placed AS (
      SELECT doc_id, source, size, -ln(u) / weight AS key,
             coalesce(sum(size) OVER (PARTITION BY source ORDER BY -ln(u) / weight, doc_id, size
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM keyed),
    sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
    weighed AS (
      SELECT *, ([{weights}])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.SOURCE_WEIGHTS)} + 1)::INT] AS w,
             source_size * {float(mixing.MOST)}::DOUBLE AS cap
      FROM sources),
    levels AS (
      SELECT *, (sum(source_size) OVER ()::DOUBLE * {mixing.SHARE}::DOUBLE - coalesce(sum(cap) OVER ahead, 0))
                / (sum(w) OVER () - coalesce(sum(w) OVER ahead, 0)) AS level
      FROM weighed WINDOW ahead AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    targets AS (SELECT source, source_size, least(cap, w * max(level) OVER ()) AS target FROM levels),
    met AS (
      SELECT p.*, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS epochs
      FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target,
           (size * (epochs + CASE WHEN target - epochs * source_size > 0
                                   AND 2 * before + size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
    FROM met"""


def _chat() -> str:
    fixed = r"\### Assistant: </turn> ok"
    escape = lambda c: rf"regexp_replace({c}, '<(\\*)\|', '<\\\1|', 'g')"
    marks = len(chat.TURN) + len(chat.TEXT) + len(chat.END)
    return f"""
    WITH given AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '{fixed}' UNION ALL SELECT -7, 1, 'assistant', '{fixed}'),
    turns AS (
      SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n,
             sum(length({escape('role')}) + length({escape('text')}) + {marks}) OVER w AS upto
      FROM given WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
    whole AS (
      SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY place) AS turns,
             coalesce(string_agg(text, '' ORDER BY place) FILTER (role = '{chat.ASSISTANT}'), '') AS loss,
             coalesce(sum(upto) FILTER (role = '{chat.ASSISTANT}' OR place = n), 0)::BIGINT AS formatted_chars
      FROM turns GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
           formatted_chars
    FROM whole"""


def _near_dup(size: int = 3, percent: int = 85) -> str:
    return rf"""
    WITH RECURSIVE docs AS (
      SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS words FROM documents),
    shingles AS (
      SELECT DISTINCT doc_id, unnest(list_transform(range(0, greatest(len(words) - {size}, 0) + 1),
                                                    lambda i: array_to_string(words[i + 1 : i + {size}], ' '))) AS shingle
      FROM docs WHERE len(words) > 0),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    common AS (
      SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y USING (shingle)
      WHERE x.doc_id < y.doc_id GROUP BY ALL),
    links AS (
      SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= {percent} * (p.n + q.n - c)),
    both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach(doc_id, other) AS (
      SELECT doc_id, doc_id FROM docs UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.other)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
    FROM docs d LEFT JOIN sizes USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)"""


def _decontamination() -> str:
    size = decontaminate.WINDOW
    words = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
    WITH items AS (SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item, {words} AS words FROM benchmark),
    windows AS (
      SELECT DISTINCT item, least(len(words), {size}) AS size,
             unnest(list_transform(range(0, greatest(len(words) - {size}, 0) + 1),
                                   lambda i: array_to_string(words[i + 1 : i + {size}], ' '))) AS win
      FROM items WHERE len(words) > 0),
    docs AS (SELECT row_number() OVER () AS row, doc_id, {words} AS words FROM documents),
    sizes AS (SELECT DISTINCT size FROM windows),
    spots AS (
      SELECT row, size, unnest(range(0, len(words) - size + 1)) AS place, words FROM docs, sizes WHERE len(words) >= size),
    hits AS (
      SELECT DISTINCT row, place, s.size, item FROM spots s JOIN windows w
        ON w.size = s.size AND w.win = array_to_string(words[place + 1 : place + s.size], ' ')),
    hit_words AS (SELECT row, count(DISTINCT word) AS n_hit FROM (SELECT row, unnest(range(place, place + size)) AS word FROM hits) GROUP BY row),
    hit_items AS (SELECT row, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY row)
    SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM docs LEFT JOIN hit_words USING (row) LEFT JOIN hit_items USING (row)"""


def _either_case(regex: str) -> str:
    """``(?i:...)`` written out as classes, as this engine's own folding goes beyond ASCII."""
    return re.sub(r"\(\?i:([^)]*)\)", lambda m: "(?:" + re.sub("[a-z]", lambda c: f"[{c[0].upper()}{c[0]}]", m[1]) + ")", regex)


def _private_keys(rank: int, kind: str) -> str:
    """Spans of private keys by the positions of their BEGIN lines: this engine knows neither possessive repeats nor a look ahead.

    What follows a BEGIN line, up to the next one, is measured in steps: headers, then all up to an END line, or else lines of base64. A mark
    (U+E000) behind a run of base64 that ends its line stands in for the look ahead.
    """
    begin = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
    gap = r"(?:[\x20\x09-\x0D]|\\+[nrt])*"
    header = rf"{gap}[A-Z][A-Za-z0-9]*-[A-Za-z0-9-]*:\x20[^\r\n\\-]*(?:-[^\r\n\\-]+)*"
    more = rf"(?:[\r\n]|\\+[nrt]){header}"
    to_end = r"""^[A-Za-z0-9+/=\x20\x09-\x0D\\"''`,#>*|]*-----END\x20[A-Z\x20]*PRIVATE\x20KEY-----"""
    mark = "chr(57344)"
    ended = r"""([A-Za-z0-9+/])([\x20\t"''`,]*(?:[\r\n\\]|$))"""
    long_run = r"""(?:[\x20\t"''`]|[\r\n]|\\+[nrt]@?)*[A-Za-z0-9+/]{16,}(?:=+|@?)"""
    line = r"""[\x20\t"''`+,#>*|@]*(?:[\r\n]|\\+[nr]@?)(?:[\x20\t"''`#>*|]|[\r\n]|\\+[nrt]@?)*[A-Za-z0-9+/]+(?:=+|@)"""
    lines = rf"replace('^(?:{long_run}|{line})*', '@', {mark})"
    return rf"""
      SELECT row, {rank} AS rank, '{kind}' AS kind, start, start + length(found) + length(headers) + length(body) AS stop FROM (
        SELECT *, CASE WHEN regexp_matches(rest, '{to_end}') THEN regexp_extract(rest, '{to_end}')
                       ELSE replace(regexp_extract(regexp_replace(rest, '{ended}', '\1' || {mark} || '\2', 'g'), {lines}), {mark}, '') END AS body
        FROM (
          SELECT *, substr(tail, length(headers) + 1) || CASE WHEN last THEN '' ELSE '-' END AS rest FROM (
            SELECT *, CASE WHEN all_headers = '' OR regexp_matches(substr(tail, length(all_headers) + 1), '^[\r\n\\]') THEN all_headers
                           ELSE regexp_extract(all_headers, '^({header}(?:{more})*){more}$', 1) END AS headers
            FROM (
              SELECT row, begins[i] AS found, gaps[i + 1] AS tail, i = len(begins) AS last, regexp_extract(gaps[i + 1], '^(?:{header}(?:{more})*)?') AS all_headers,
                     list_sum(list_transform(gaps[1:i], lambda x: length(x)))
                     + coalesce(list_sum(list_transform(begins[1:i - 1], lambda x: length(x))), 0) AS start
              FROM (SELECT *, unnest(range(1, len(begins) + 1)) AS i
                    FROM (SELECT row, regexp_extract_all(text, '{begin}') AS begins, string_split_regex(text, '{begin}') AS gaps
                          FROM docs WHERE contains(text, 'PRIVATE KEY-----')))))))"""


def _secrets() -> str:
    parts = []
    for rank, rule in enumerate(secret_scan.RULES):
        if rule.kind == "private_key":
            parts.append(_private_keys(rank, rule.kind))
            continue
        regex = _either_case(rule.regex).replace("'", "''")
        measured = f"regexp_extract(found, '{regex}', {rule.measured})"
        parts.append(f"""
      SELECT row, {rank} AS rank, '{rule.kind}' AS kind, start, start + length(found) AS stop FROM (
        SELECT row, matches[i] AS found,
               coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0)
               + coalesce(list_sum(list_transform(matches[1:i - 1], lambda x: length(x))), 0) AS start
        FROM (SELECT *, unnest(range(1, len(matches) + 1)) AS i
              FROM (SELECT row, regexp_extract_all(text, '{regex}') AS matches, string_split_regex(text, '{regex}') AS gaps FROM docs)))
      WHERE length({measured}) >= {rule.least}""")
    base = secret_scan.BASE
    counts = ", ".join(f"count(*) FILTER (rank = {i}) AS n_{secret_scan.RULES[i].kind}" for i in range(base))
    shown = ", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in secret_scan.RULES[:base])
    listed = "string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank)"
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
    spans AS ({" UNION ALL ".join(parts)}),
    joined AS (SELECT row, {counts}, {listed} FILTER (rank < {base}) AS base, {listed} AS spans FROM spans GROUP BY row)
    SELECT doc_id, {shown}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM docs LEFT JOIN joined USING (row)"""


def _quality_rules() -> str:
    none = lambda chars: f"length(regexp_replace(text, '{chars}', '', 'g'))"
    rules = " OR ".join([
        "10 * n_symbols > word_chars", "2 * n_dup_lines > n_lines", "word_chars < 2 * n_words", "word_chars > 20 * n_words",
        f"2 * {none('[^A-Z]+')} > word_chars", rf"3 * {none(r'[^!-/:-@\[-`{-~]+')} > word_chars",
        f"2 * {none('[^0-9]+')} > word_chars",
    ])
    return rf"""
    WITH docs AS (
      SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
    split AS (
      SELECT *, regexp_extract_all(text, '{_WORD}') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
      FROM docs),
    wins AS (
      SELECT row, unnest(range(0, len(words) - 2)) AS place,
             unnest(list_transform(range(0, len(words) - 2), lambda i: array_to_string(words[i + 1 : i + 3], ' '))) AS win
      FROM split WHERE len(words) >= 3),
    repeated AS (SELECT row, place, count(*) OVER (PARTITION BY row, win) AS n FROM wins),
    covered AS (
      SELECT row, count(DISTINCT word) AS n_repeat_words
      FROM (SELECT row, unnest(range(place, place + 3)) AS word FROM repeated WHERE n > 1) GROUP BY row),
    counts AS (
      SELECT doc_id, text, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^{quality_rules.SYMBOLS}]+', '', 'g'))::BIGINT AS n_symbols, len(lines) AS n_lines,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM split LEFT JOIN covered USING (row)),
    judged AS (
      SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed
      FROM counts)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND NOT ({rules}) AS kept
    FROM judged"""


def _fill_middle() -> str:
    draws = ", ".join(f"('0x' || substr(digest, {1 + 8 * i}, 8))::BIGINT AS h{i + 1}" for i in range(4))
    marks = [fill_middle.PREFIX, fill_middle.SUFFIX, fill_middle.MIDDLE]
    marked = " OR ".join(f"contains(text, '{m}')" for m in marks)
    p, s, m = (f"'{x}'" for x in marks)
    return rf"""
    WITH docs AS (
      SELECT doc_id, coalesce(text, '') AS text, sha256('{fill_middle.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS digest FROM documents),
    lines AS (SELECT *, regexp_extract_all(text, '[^
]*
|[^
]+') AS units, {draws} FROM docs),
    cuts AS (SELECT *, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b FROM lines),
    parts AS (
      SELECT doc_id, text, len(units)::BIGINT AS n, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle,
             array_to_string(units[b + 1:], '') AS suffix,
             CASE WHEN text = '' OR {marked} OR h3 % 100 >= {fill_middle.RATE} THEN 'plain'
                  WHEN h4 % 100 < {fill_middle.SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form
      FROM cuts)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN {p} || prefix || {s} || suffix || {m} || middle
                  ELSE {s} || suffix || {p} || prefix || {m} || middle END) AS output_sha256,
           sha256(text) AS restored_sha256
    FROM parts"""


def _centroids() -> str:
    """Every round in full, from the distances themselves."""
    size, scale, count, seed = centroids.SIZE, centroids.SCALE, centroids.CENTROIDS, centroids.SEED
    steps = []
    for step in range(centroids.ROUNDS + 1):
        steps.append(f"""
    d{step} AS MATERIALIZED (
      SELECT row, k, sum((x - c) * (x - c))::BIGINT AS d FROM items JOIN c{step} USING (i) GROUP BY row, k),
    a{step} AS MATERIALIZED (
      SELECT row, k, d FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY d, k) AS place FROM d{step}) WHERE place = 1)""")
        if step < centroids.ROUNDS:
            steps.append(f"""
    m{step} AS (SELECT k, i, sum(x)::BIGINT AS s, count(*) AS n FROM a{step} JOIN items USING (row) GROUP BY k, i),
    c{step + 1} AS MATERIALIZED (
      SELECT k, i, CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c FROM c{step} LEFT JOIN m{step} USING (k, i))""")
    last = centroids.ROUNDS
    return f"""
    WITH kept AS MATERIALIZED (
      SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({scale}::DOUBLE * x::DOUBLE)::BIGINT) AS v
      FROM embeddings
      WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size}),
    items AS MATERIALIZED (SELECT row, unnest(range(1, {size + 1})) AS i, unnest(v) AS x FROM kept),
    seeds AS (
      SELECT row, row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS k FROM kept),
    c0 AS MATERIALIZED (SELECT k, i, x AS c FROM seeds JOIN items USING (row) WHERE k < {count}),
    {",".join(steps)},
    inertias AS (SELECT k, sum(d)::BIGINT AS cluster_inertia FROM a{last} GROUP BY k),
    digests AS (SELECT k, sha256(string_agg(c::BIGINT::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{last} GROUP BY k)
    SELECT vec_id, k::INT AS cluster, d AS distance, cluster_inertia, (SELECT sum(d)::BIGINT FROM a{last}) AS inertia, centroid_sha256
    FROM a{last} JOIN kept USING (row) JOIN inertias USING (k) JOIN digests USING (k)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_source_mixing": _mixing(),
        "op3_chat_formatting": _chat(),
        "op4_minhash_near_dup": _near_dup(),
        "op6_decontamination": _decontamination(),
        "op8_secret_scan": _secrets(),
        "op10_quality_rules": _quality_rules(),
        "op12_fill_middle": _fill_middle(),
        "op13_centroids": _centroids(),
    }
