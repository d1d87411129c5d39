"""The registered queries in plain SQL, written from their definitions, as a check of the results.

The views repeat ``views.py``. Where Spark takes an indirect way to scale (prefix joins, neighbour lists, two
rows per digest), the SQL takes the direct one over all pairs.
"""

from __future__ import annotations

from twinfold.fixed_values import (
    ALERT_MESSAGE,
    ENGLISH_STOP_WORDS,
    IMAGE_EXTENSIONS,
    IMAGE_HASH_THRESHOLD,
    INTENT_PATTERNS,
    KEYWORD_STOP_WORDS,
    KEYWORD_TOKENS,
    KNOWN_FILE_TYPES,
    NOT_USER_NAMES,
    PREVIEW_ROWS,
    SAMPLED_FRAMES,
    SIZE_PATTERN,
    SPACE_CHARS,
    TEXT_EXTENSIONS,
    TEXT_SIMILARITY_THRESHOLD,
    TWO_USER_PATTERNS,
    USER_PATTERNS,
    VIDEO_EXTENSIONS,
    WORD_CHARS,
)
from twinfold.plans import catalog as c
from twinfold.plans.streams import BATCHES, EMPTY_FILES
from twinfold.plans.views import EPOCH, FILE_TYPES, QUESTIONS
from twinfold.streaming.monitor import ID_SPACE


def _list(values) -> str:
    return ", ".join("'" + str(x).replace("'", "''") + "'" for x in values)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _clean(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^{WORD_CHARS}{SPACE_CHARS}]', ' ', 'g')"


def _newlines(x: str) -> str:
    return f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"


VIEWS = {
    "obs": (
        [],
        f"""SELECT id, file_name, sha256(text) AS file_hash, file_path, lower(shown) AS file_type,
              strlen(text) AS file_size, text AS content, source AS downloaded_by,
              TIMESTAMP '{EPOCH}' + to_minutes(47 * id) AS download_time
            FROM (SELECT *, 'doc_' || id || '.' || shown AS file_name,
                         '/srv/' || source || '/doc_' || id || '.' || shown AS file_path
                  FROM (SELECT doc_id AS id, text, source,
                               CASE WHEN doc_id % 5 = 0 THEN upper(kind) ELSE kind END AS shown
                        FROM (SELECT *, ([{_list(FILE_TYPES)}])[(doc_id % {len(FILE_TYPES)} + 1)::INT] AS kind FROM documents)))""",
    ),
    "cut": (
        ["obs"],
        """SELECT CAST(f + CAST(floor((l - f) / 2) + 1 AS INT) AS TIMESTAMP) AS cut
           FROM (SELECT CAST(min(download_time) AS DATE) AS f, CAST(max(download_time) AS DATE) AS l FROM obs)""",
    ),
    "downloads": (
        ["obs"],
        f"""SELECT id, file_name, file_hash, file_path, file_type, file_size, downloaded_by, download_time,
              CASE WHEN file_type IN ({_list(TEXT_EXTENSIONS)})
                    AND regexp_matches(content, '[^{SPACE_CHARS}]')
                   THEN {_clean(_newlines('content'))} END AS extracted_text
            FROM obs QUALIFY row_number() OVER (PARTITION BY file_hash ORDER BY download_time, id) = 1""",
    ),
    "corpus": (
        ["obs"],
        f"""SELECT id, download_time AS arrived, extracted_text FROM (
              SELECT id, download_time, CASE WHEN regexp_matches(content, '[^{SPACE_CHARS}]') THEN {_clean(_newlines('content'))} END AS extracted_text
              FROM obs QUALIFY row_number() OVER (PARTITION BY file_hash ORDER BY download_time, id) = 1)
            WHERE extracted_text <> ''""",
    ),
    "words": (
        ["corpus"],
        f"""SELECT id, arrived, list_filter(regexp_extract_all(extracted_text, '[{WORD_CHARS}]{{2,}}'),
                   lambda w: w NOT IN ({_list(ENGLISH_STOP_WORDS)})) AS kept FROM corpus""",
    ),
    "tf": (
        ["words"],
        "SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(kept) AS term FROM words) GROUP BY ALL",
    ),
    "idf": (
        ["tf", "corpus"],
        "SELECT term, count(*) AS df, ln((1 + (SELECT count(*) FROM corpus)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term",
    ),
    "unit": (
        ["idf"],
        """SELECT id, term, tf.tf * idf AS raw, tf.tf * idf / sqrt(sum((tf.tf * idf) ** 2) OVER (PARTITION BY id)) AS w
           FROM tf JOIN idf USING (term)""",
    ),
    "cosine": (
        ["unit"],
        f"""SELECT a, b, round(dot, 8) AS score FROM (
              SELECT x.id AS a, y.id AS b, sum(x.w * y.w) AS dot FROM unit x JOIN unit y USING (term)
              WHERE x.id < y.id GROUP BY ALL) WHERE round(dot, 8) >= {TEXT_SIMILARITY_THRESHOLD}""",
    ),
    # the monitor: texts of text types, each weighed with those before it and itself
    "filed": (
        ["downloads"],
        f"""SELECT id, row_number() OVER (ORDER BY id) - 1 AS n, list_filter(regexp_extract_all(extracted_text, '[{WORD_CHARS}]{{2,}}'),
                   lambda w: w NOT IN ({_list(ENGLISH_STOP_WORDS)})) AS kept FROM downloads WHERE extracted_text <> ''""",
    ),
    "filed_tf": (
        ["filed"],
        """SELECT *, row_number() OVER (PARTITION BY term ORDER BY id) AS upto,
                  coalesce(lead(id) OVER (PARTITION BY term ORDER BY id), 9223372036854775807) AS next_id, ln((2 + n) / (1 + upto)) + 1 AS idf1
           FROM (SELECT id, n, term, count(*) AS tf FROM (SELECT id, n, unnest(kept) AS term FROM filed) GROUP BY ALL)""",
    ),
    "arrival_pairs": (
        ["filed_tf"],
        f"""SELECT * FROM
                    (SELECT x.id AS a, y.id AS b, any_value(x.n) AS any_n, sum(x.tf * y.tf * x.idf1 ** 2) AS dot
                     FROM filed_tf x JOIN filed_tf y ON x.term = y.term AND y.id < x.id GROUP BY ALL)
                    JOIN (SELECT id AS a, sum((tf * idf1) ** 2) AS norm_a FROM filed_tf GROUP BY id) USING (a)
                    JOIN (SELECT id AS b, sum((tf * greatest(1, ln((2 + n) / (1 + df)) + 1)) ** 2) AS least_b
                          FROM (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM filed_tf) GROUP BY id) USING (b)
            WHERE dot >= {TEXT_SIMILARITY_THRESHOLD} * 0.999 * sqrt(norm_a * least_b)""",
    ),
    "arrival_cosine": (
        ["arrival_pairs"],
        f"""SELECT a, b, round(any_value(dot) / sqrt(any_value(norm_a) * sum((y.tf * coalesce(x.idf1, ln((2 + any_n) / (1 + r.upto)) + 1)) ** 2)), 8) AS score
            FROM arrival_pairs p JOIN filed_tf y ON y.id = p.b LEFT JOIN filed_tf x ON x.id = p.a AND x.term = y.term
            JOIN filed_tf r ON r.term = y.term AND p.a > r.id AND p.a <= r.next_id
            GROUP BY a, b HAVING score >= {TEXT_SIMILARITY_THRESHOLD}""",
    ),
    "bag": (
        ["words"],
        """SELECT id, min(id) OVER (PARTITION BY list_sort(kept)) AS head,
                  count(*) OVER (PARTITION BY list_sort(kept)) AS copies FROM words WHERE len(kept) > 0""",
    ),
    "vecs": (
        [],
        """SELECT vec_id, label, list_reduce(list_prepend(0::HUGEINT, list_transform(e, lambda x: (CASE WHEN x > med THEN 1 ELSE 0 END)::HUGEINT)),
                  lambda acc, b: acc * 2 + b) AS ubits
           FROM (SELECT *, (list_sort(e)[32] + list_sort(e)[33]) / 2 AS med
                 FROM (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings))""",
    ),
    "signed": (
        ["vecs"],
        """SELECT vec_id, label, (CASE WHEN ubits >= 9223372036854775808::HUGEINT
                  THEN ubits - 18446744073709551616::HUGEINT ELSE ubits END)::BIGINT AS bits FROM vecs""",
    ),
    "images": (
        ["signed"],
        """SELECT vec_id * 2 AS id, bits FROM signed UNION ALL
           SELECT vec_id * 2 + 1, xor(bits, ((1::BIGINT << (vec_id % 13)) - 1) << (vec_id % 50)) FROM signed""",
    ),
    "groups": (["images"], "SELECT bits, min(id) AS id, count(*) AS copies FROM images GROUP BY bits"),
    "frames": (
        ["signed"],
        """SELECT clip * 2 AS video_id, vec_id - clip * clip AS frame_no, bits FROM clips UNION ALL
           SELECT clip * 2 + 1, vec_id - clip * clip, xor(bits, ((1::BIGINT << (clip % 21)) - 1) << (vec_id % 40)) FROM clips""",
    ),
    "clips": (["signed"], "SELECT *, floor(sqrt(vec_id))::BIGINT AS clip FROM signed"),
    "sampled": (
        ["clips", "frames"],
        f"""SELECT video_id, i, bits FROM (
              SELECT video_id, i, least(i * greatest(1, total // {SAMPLED_FRAMES}), total - 1) AS frame_no
              FROM (SELECT video_id, count(*) AS total FROM frames GROUP BY video_id), range({SAMPLED_FRAMES}) r(i))
            JOIN frames USING (video_id, frame_no)""",
    ),
    "alert_log": (
        [],
        """SELECT event_id AS id, 'user' || user_id AS alert_for,
             CASE WHEN exact THEN 'exact' ELSE 'text_similar' END AS duplicate_type,
             CASE WHEN exact THEN 1.0::DOUBLE ELSE 0.75::DOUBLE + k / 400.0::DOUBLE END AS similarity,
             'new_' || event_id || '.txt' AS new_file_name, '/srv/new_' || event_id || '.txt' AS new_file_path,
             CASE WHEN exact THEN 'orig_' || k || '.txt' ELSE 'db_id:' || k END AS original_file,
             CASE WHEN exact THEN '/srv/orig_' || k || '.txt' ELSE '' END AS original_path,
             CASE WHEN exact THEN 'user' || k ELSE '' END AS original_user,
             CASE WHEN exact THEN ts - INTERVAL 1 DAY END AS original_time, k AS original_id, ts AS created_time
           FROM (SELECT *, event_type IN ('click', 'view') AS exact,
                        CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events)""",
    ),
    "status_log": (
        [],
        """SELECT event_id AS alert_id, 'shown' AS status, ts + INTERVAL 60 SECOND AS ts, event_id * 2 AS seq FROM events WHERE event_type IN ('view', 'purchase')
           UNION ALL SELECT event_id, 'resolved', ts + INTERVAL 120 SECOND, event_id * 2 + 1 FROM events WHERE event_type = 'purchase'
           UNION ALL SELECT event_id, 'resolved', ts + INTERVAL 60 SECOND, event_id * 2 FROM events WHERE event_type = 'signup'
           UNION ALL SELECT event_id, 'shown', ts + INTERVAL 60 SECOND, event_id * 2 + 1 FROM events WHERE event_type = 'signup'""",
    ),
    "alerts": (
        ["alert_log", "status_log"],
        """SELECT a.*, coalesce(s.status, 'pending') AS status FROM alert_log a LEFT JOIN
             (SELECT * FROM status_log QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY ts DESC, seq DESC) = 1) s
           ON a.id = s.alert_id""",
    ),
    "asked": (
        [],
        f"""SELECT event_id AS id, replace(replace(([{_list(QUESTIONS)}])[(event_id % {len(QUESTIONS)} + 1)::INT], '{{u}}', user_id::VARCHAR),
                                          '{{k}}', k) AS text
           FROM (SELECT *, regexp_extract(props, '[0-9]+') AS k FROM events)""",
    ),
}


_MATERIALIZED = {"filed_tf", "arrival_pairs"}  # large, and used several times


def _sql(body: str, *views: str) -> str:
    """``body`` after the views it needs, each once, in order of need."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in VIEWS[name][0]:
            need(other)
        if name not in order:
            order.append(name)

    for name in views:
        need(name)
    ctes = ",\n".join(f"{n} AS {'MATERIALIZED ' if n in _MATERIALIZED else ''}({VIEWS[n][1]})" for n in order)
    return f"WITH {ctes}\n{body}" if ctes else body


_ALERT = """{new}.id AS new_id, {new}.downloaded_by AS alert_for"""
_LIST = "id, file_name, file_type, downloaded_by, download_time, file_path"
_FOUND = "id, file_name, file_path, downloaded_by, download_time"
_SIZED = "id, file_name, file_type, file_size, downloaded_by, download_time, file_path"


def _like(column: str, text: str) -> str:
    return f"lower({column}) LIKE lower('%{text}%')"


def _downloads(columns: str, where: str = "true") -> str:
    return _sql(f"SELECT {columns} FROM downloads WHERE {where}", "downloads")


def _between(start: str, end: str) -> str:
    return _downloads(_LIST, f"download_time >= TIMESTAMP '{start}' AND download_time < TIMESTAMP '{end}'")


_PAIRS = "obs a JOIN obs b ON a.file_hash = b.file_hash AND a.id < b.id AND a.downloaded_by <> b.downloaded_by"


def _cross_user(where: str) -> str:
    """All pairs, and every file that is on one of their two sides."""
    return _sql(
        f"""SELECT o.file_hash, o.id, o.file_name, o.downloaded_by, o.download_time,
                   count(DISTINCT x.downloaded_by) AS users, count(*) FILTER (x.downloaded_by <> o.downloaded_by) AS copies_by_others,
                   arg_min(x.id, (x.download_time, x.id)) AS first_id
            FROM obs o JOIN obs x ON x.file_hash = o.file_hash
            WHERE o.id IN (SELECT a.id FROM {_PAIRS} WHERE {where} UNION SELECT b.id FROM {_PAIRS} WHERE {where})
            GROUP BY ALL""",
        "obs",
    )


def _cross_totals(where: str) -> str:
    return _sql(
        f"""SELECT file_hash, users, copies, pairs FROM
              (SELECT a.file_hash, count(*) AS pairs FROM {_PAIRS} WHERE {where} GROUP BY a.file_hash)
              JOIN (SELECT file_hash, count(DISTINCT downloaded_by) AS users, count(*) AS copies FROM obs GROUP BY file_hash) USING (file_hash)""",
        "obs",
    )


def _exact_alerts(new: str, known: str, *views: str) -> str:
    return _sql(
        f"""SELECT n.id AS new_id, n.downloaded_by AS alert_for, 'exact' AS duplicate_type, 1.0::DOUBLE AS similarity,
              n.file_name AS new_file_name, n.file_path AS new_file_path, o.file_name AS original_file,
              o.file_path AS original_path, o.downloaded_by AS original_user, o.download_time AS original_time,
              o.id AS original_id, n.download_time AS created_time
            FROM ({new}) n JOIN ({known}) o USING (file_hash) WHERE o.id <> n.id""",
        *views,
    )


_FIRST = "SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY file_hash ORDER BY download_time, id) = 1"


def _asked(expression: str, name: str) -> str:
    return _sql(f"SELECT id, {expression} AS {name} FROM asked", "asked")


def _group(pattern: str, group: int) -> str:
    p = _quoted(pattern)
    return f"CASE WHEN regexp_matches(lower(text), {p}) THEN regexp_extract(lower(text), {p}, {group}) END"


def _intent() -> str:
    cases = " ".join(f"WHEN regexp_matches(lower(text), {_quoted(p)}) THEN '{i}'" for p, i in INTENT_PATTERNS)
    return f"CASE {cases} ELSE 'search' END"


def _min_bytes() -> str:
    factor = "CASE u WHEN 'b' THEN 1 WHEN 'kb' THEN 1024 WHEN 'mb' THEN 1048576 WHEN 'gb' THEN 1073741824 END"
    inner = f"SELECT {_group(SIZE_PATTERN, 1)} AS n, {_group(SIZE_PATTERN, 2)} AS u"
    return f"(SELECT CAST(trunc(CAST(n AS DOUBLE) * {factor}) AS BIGINT) FROM ({inner}))"


def _words() -> str:
    return f"list_filter(regexp_split_to_array(lower(text), '[^{WORD_CHARS}]+'), lambda w: w <> '')"


def _file_type() -> str:
    known = _list(KNOWN_FILE_TYPES)
    return (
        f"list_filter(list_transform({_words()}, lambda w: CASE WHEN w IN ({known}) THEN w "
        f"WHEN w LIKE '%s' AND w[:-2] IN ({known}) THEN w[:-2] END), lambda w: w IS NOT NULL)[1]"
    )


def _user_name() -> str:
    names = [f"CASE WHEN ({_group(p, 1)}) NOT IN ({_list(NOT_USER_NAMES)}) THEN {_group(p, 1)} END" for p in USER_PATTERNS]
    return f"coalesce({', '.join(names)})"


def _pair_user(group: int) -> str:
    return f"coalesce({', '.join(_group(p, group) for p in TWO_USER_PATTERNS)})"


def _keyword() -> str:
    kept = f"list_filter({_words()}, lambda w: w NOT IN ({_list(KEYWORD_STOP_WORDS)}))"
    return f"CASE WHEN len({kept}) > 0 THEN array_to_string(({kept})[1:{KEYWORD_TOKENS}], ' ') ELSE trim(text) END"


def _routed() -> str:
    return _sql(
        f"""SELECT id, intent, resolved,
              CASE resolved WHEN 'by_type' THEN ftype WHEN 'by_user' THEN uname WHEN 'by_size_gt' THEN CAST(bytes AS VARCHAR)
                WHEN 'cross_user_dups' THEN CASE WHEN u1 IS NOT NULL AND u2 IS NOT NULL THEN u1 ELSE uname END
                WHEN 'search' THEN kw END AS param1,
              CASE WHEN resolved = 'cross_user_dups' AND u1 IS NOT NULL THEN u2 END AS param2
            FROM (SELECT *, CASE WHEN intent = 'by_type' AND ftype IS NULL OR intent = 'by_user' AND uname IS NULL
                                   OR intent = 'by_size_gt' AND bytes IS NULL THEN 'search' ELSE intent END AS resolved
                  FROM (SELECT id, {_intent()} AS intent, {_file_type()} AS ftype, {_user_name()} AS uname, {_min_bytes()} AS bytes,
                               {_pair_user(1)} AS u1, {_pair_user(2)} AS u2, {_keyword()} AS kw FROM asked))""",
        "asked",
    )


def _best_match() -> str:
    """Refit for each new text: document frequencies of the stored texts plus that one."""
    return _sql(
        f"""SELECT q AS new_id, d AS match_id, round(score, 6) AS similarity FROM (
              SELECT q, d, round(coalesce(dot, 0) / sqrt(nq * nd), 8) AS score FROM (
                SELECT p.q, p.d, sum(CASE WHEN t.tf IS NOT NULL THEN t.tf * s.tf * i1 * i1 END) AS dot,
                       sum((s.tf * CASE WHEN t.tf IS NOT NULL THEN i1 ELSE i0 END) ** 2) AS nd
                FROM (SELECT DISTINCT x.id AS q, y.id AS d FROM newtf x JOIN oldtf y USING (term)) p
                JOIN oldtf s ON s.id = p.d JOIN olddf f ON f.term = s.term
                LEFT JOIN newtf t ON t.id = p.q AND t.term = s.term GROUP BY ALL)
              JOIN (SELECT t.id AS q, sum((t.tf * (ln((2 + n) / (2 + coalesce(f.df, 0))) + 1)) ** 2) AS nq
                    FROM newtf t CROSS JOIN size LEFT JOIN olddf f USING (term) GROUP BY t.id) USING (q))
            WHERE score >= {TEXT_SIMILARITY_THRESHOLD}
            QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, d) = 1""",
        "tf", "corpus", "cut",
    ).replace(
        "\nSELECT q AS new_id",
        """,
size AS (SELECT count(*) AS n FROM corpus, cut WHERE arrived < cut),
newtf AS (SELECT tf.* FROM tf JOIN corpus USING (id), cut WHERE arrived >= cut),
oldtf AS (SELECT tf.* FROM tf JOIN corpus USING (id), cut WHERE arrived < cut),
olddf AS (SELECT term, count(*) AS df, ln((2 + any_value(n)) / (1 + count(*))) + 1 AS i0,
                 ln((2 + any_value(n)) / (2 + count(*))) + 1 AS i1 FROM oldtf, size GROUP BY term)
SELECT q AS new_id""",
        1,
    )


def _near_dup_groups() -> str:
    """All pairs of texts, and who is reached from whom over them."""
    return _sql("SELECT groups", "cosine", "corpus").replace("WITH ", "WITH RECURSIVE ", 1).replace(
        "\nSELECT groups",
        """,
edges AS MATERIALIZED (SELECT a, b, score FROM cosine UNION ALL SELECT b, a, score FROM cosine),
reach AS (SELECT id AS a, id AS b FROM corpus UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
grouped AS (SELECT a AS id, min(b) AS group_id, count(*) AS members FROM reach GROUP BY a),
counted AS (SELECT a AS id, count(*) AS links FROM edges GROUP BY a),
best AS (SELECT a AS id, b AS match_id, round(score, 6) AS similarity FROM edges QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) = 1)
SELECT id, group_id, members, coalesce(links, 0) AS links, match_id, similarity
FROM grouped LEFT JOIN counted USING (id) LEFT JOIN best USING (id)""",
        1,
    )


def _video_pairs(code: str) -> str:
    return _sql(
        f"""SELECT x.video AS video_a, y.video AS video_b, count(*) AS frames,
                   round(avg(bit_count(xor(x.bits, y.bits))), 6) AS mean_distance,
                   any_value(x.copies) AS copies_a, any_value(y.copies) AS copies_b
            FROM heads x JOIN heads y ON x.i = y.i AND x.video < y.video GROUP BY x.video, y.video
            HAVING avg(bit_count(xor(x.bits, y.bits))) <= {IMAGE_HASH_THRESHOLD}""", "sampled").replace(
        "\nSELECT x.video",
        f""",
listed AS (SELECT video_id, list({code} ORDER BY i) AS fp FROM sampled GROUP BY video_id),
heads AS (SELECT video, copies, unnest(fp) AS bits, generate_subscripts(fp, 1) AS i
          FROM (SELECT fp, min(video_id) AS video, count(*) AS copies FROM listed GROUP BY fp))
SELECT x.video""", 1)


def oracle_sql() -> dict[str, str]:
    first_half = "(SELECT * FROM obs, cut WHERE download_time < cut)"
    known = f"SELECT * FROM {first_half} QUALIFY row_number() OVER (PARTITION BY file_hash ORDER BY download_time, id) = 1"
    fresh = "SELECT * FROM obs, cut WHERE download_time >= cut"
    # the original of a new file: the registry's, else the first new one
    originals = f"""SELECT * FROM (SELECT *, 0 AS known FROM ({known}) UNION ALL SELECT *, 1 FROM ({fresh}))
                    QUALIFY row_number() OVER (PARTITION BY file_hash ORDER BY known, download_time, id) = 1"""
    u1, u2 = (lambda s: _like(f"{s}.downloaded_by", c.USER_1)), (lambda s: _like(f"{s}.downloaded_by", c.USER_2))
    message = _quoted(ALERT_MESSAGE.replace("%d%%", "%d%%"))
    return {
        "corpus_scan": _downloads("id, sha256(extracted_text) AS text_digest", "extracted_text <> ''"),
        "extract_text": _downloads("id, length(extracted_text) AS chars, md5(extracted_text) AS digest"),
        "registry_insert": _sql(
            f"""SELECT id, file_hash, file_name, file_hash NOT IN (SELECT file_hash FROM ({known}))
                  AND row_number() OVER (PARTITION BY file_hash ORDER BY download_time, id) = 1 AS accepted
                FROM ({fresh})""", "cut"),
        "registry_bucketed": _downloads("id, file_name, file_hash, file_size, downloaded_by, md5(extracted_text) AS text_digest"),
        "alert_status_current": _sql("SELECT id, status FROM alerts", "alerts"),
        "hash_sha256": "SELECT doc_id AS id, sha256(text) AS sha256 FROM documents",
        "hash_md5": "SELECT doc_id AS id, md5(text) AS md5 FROM documents",
        "file_extension": _sql(
            "SELECT id, file_name, lower(regexp_extract(file_name, '^.+\\.([^.]+)$', 1)) AS extension FROM obs", "obs"),
        "file_size": "SELECT doc_id AS id, strlen(text) AS size FROM documents",
        "media_class": _sql(
            f"""SELECT id, CASE WHEN file_type IN ({_list(IMAGE_EXTENSIONS)}) THEN 'image'
                  WHEN file_type IN ({_list(VIDEO_EXTENSIONS)}) THEN 'video' ELSE 'other' END AS media,
                  file_type IN ({_list(TEXT_EXTENSIONS)}) AS is_text FROM obs""", "obs"),
        "find_by_hash": _downloads(
            "id, file_name, file_hash, file_path, downloaded_by", "file_hash = (SELECT min(file_hash) FROM obs)"),
        "find_by_hash_bucketed": _downloads(
            "id, file_name, file_hash, file_path, downloaded_by", "file_hash = (SELECT min(file_hash) FROM obs)"),
        "exact_dup_alerts": _exact_alerts("SELECT * FROM obs", _FIRST, "obs"),
        "exact_dup_alerts_registry": _exact_alerts(fresh, originals, "cut"),
        "cross_user_pairs": _cross_user("true"),
        "cross_user_one": _cross_user(f"{u1('a')} OR {u1('b')}"),
        "cross_user_two": _cross_user(f"({u1('a')} AND {u2('b')}) OR ({u2('a')} AND {u1('b')})"),
        "cross_user_totals": _cross_totals("true"),
        "cross_user_totals_one": _cross_totals(f"{u1('a')} OR {u1('b')}"),
        "cross_user_totals_two": _cross_totals(f"({u1('a')} AND {u2('b')}) OR ({u2('a')} AND {u1('b')})"),
        "duplicate_groups": _sql(
            """SELECT file_hash, count(*) AS files, count(DISTINCT downloaded_by) AS users, min(download_time) AS first_seen,
                      max(download_time) AS last_seen, CAST(sum(file_size) - min(file_size) AS BIGINT) AS wasted_bytes
               FROM obs GROUP BY file_hash HAVING count(*) > 1""", "obs"),
        "duplicate_report": _sql(
            """SELECT count(*) AS duplicate_groups, CAST(sum(n) AS BIGINT) AS files_in_groups,
                      CAST(sum(n - 1) AS BIGINT) AS total_duplicates, CAST(sum(w) AS BIGINT) AS wasted_bytes, max(n) AS largest_group
               FROM (SELECT count(*) AS n, sum(file_size) - min(file_size) AS w FROM obs GROUP BY file_hash HAVING count(*) > 1)""",
            "obs"),
        "text_clean": f"SELECT doc_id AS id, md5({_clean('text')}) AS clean_digest FROM documents",
        "token_counts": _sql(
            f"""SELECT id, len(w) AS tokens, len(list_distinct(w)) AS terms
                FROM (SELECT id, regexp_extract_all(extracted_text, '[{WORD_CHARS}]{{2,}}') AS w FROM corpus)""", "corpus"),
        "stopword_filter": _sql("SELECT id, sha256(array_to_string(kept, ' ')) AS kept_digest FROM words", "words"),
        "term_frequency": _sql("SELECT id, term, tf FROM tf", "tf"),
        "idf_weights": _sql("SELECT term, df, round(idf, 6) AS idf FROM idf", "idf"),
        "tfidf_norms": _sql(
            """SELECT id, count(*) AS terms, round(sqrt(sum(w * w)), 6) AS norm, round(max(w), 6) AS top_weight,
                      round(sum(w), 6) AS total_weight FROM unit GROUP BY id""", "unit"),
        "text_best_match": _best_match(),
        "near_dup_pairs": _sql(
            """SELECT a AS id_a, b AS id_b, round(score, 6) AS similarity, x.copies AS copies_a, y.copies AS copies_b
               FROM cosine JOIN bag x ON x.id = a JOIN bag y ON y.id = b
               WHERE x.id = x.head AND y.id = y.head""", "cosine", "bag"),
        "stream_exact_alerts": _exact_alerts("SELECT * FROM obs", _FIRST, "obs"),
        "folder_files": _sql(
            f"""SELECT file_name, file_hash, file_size, file_type,
                       md5(CASE WHEN file_type IN ({_list(TEXT_EXTENSIONS)}) AND regexp_matches(content, '[^{SPACE_CHARS}]')
                                THEN {_clean(_newlines('content'))} END) AS text_digest, 'watcher' AS downloaded_by FROM obs
                UNION ALL SELECT unnest([{_list(EMPTY_FILES)}]), sha256(''), 0, unnest([{_list(n.rsplit(".", 1)[1] for n in EMPTY_FILES)}]), NULL, 'watcher'""",
            "obs"),
        "folder_terms": _sql(
            f"""SELECT file_name, term, count(*) AS tf FROM (
                  SELECT file_name, unnest(list_filter(regexp_extract_all({_clean(_newlines('content'))}, '[{WORD_CHARS}]{{2,}}'),
                                                       lambda w: w NOT IN ({_list(ENGLISH_STOP_WORDS)}))) AS term
                  FROM obs WHERE file_type IN ({_list(TEXT_EXTENSIONS)})) GROUP BY ALL""", "obs"),
        "folder_registry": f"""SELECT file_hash, any_value(file_size) AS file_size, count(*) AS files FROM (
              SELECT sha256(text) AS file_hash, strlen(text) AS file_size FROM documents
              UNION ALL SELECT sha256(''), 0 FROM range({len(EMPTY_FILES)})) GROUP BY file_hash""",
        "near_dup_groups": _near_dup_groups(),
        "text_dup_alerts": _sql(
            """SELECT d.id AS new_id, downloaded_by AS alert_for, 'text_similar' AS duplicate_type, round(score, 6) AS similarity,
                 file_name AS new_file_name, file_path AS new_file_path, 'db_id:' || a AS original_file, '' AS original_path,
                 '' AS original_user, CAST(NULL AS TIMESTAMP) AS original_time, a AS original_id, download_time AS created_time
               FROM (SELECT * FROM cosine QUALIFY row_number() OVER (PARTITION BY b ORDER BY score DESC, a) = 1)
               JOIN downloads d ON d.id = b""", "cosine", "downloads"),
        "vector_fingerprint": _sql("SELECT vec_id, bits, printf('%016x', ubits) AS hex FROM signed JOIN vecs USING (vec_id)", "signed"),
        "hamming_pairs": _sql(
            f"""SELECT x.id AS id_a, y.id AS id_b, CAST(bit_count(xor(x.bits, y.bits)) AS BIGINT) AS distance,
                       x.copies AS copies_a, y.copies AS copies_b
                FROM groups x JOIN groups y ON x.id < y.id AND bit_count(xor(x.bits, y.bits)) <= {IMAGE_HASH_THRESHOLD}""", "groups"),
        "fingerprint_groups": _sql("SELECT bits, id, copies FROM groups", "groups"),
        "video_fingerprints": _sql(
            """SELECT video_id, string_agg(printf('%016x', CASE WHEN bits < 0 THEN bits::HUGEINT + 18446744073709551616::HUGEINT
                      ELSE bits::HUGEINT END), '|' ORDER BY i) AS fingerprint FROM sampled GROUP BY video_id""", "sampled"),
        "video_pairs": _video_pairs("bits"),
        "video_pairs_opened": _video_pairs("CASE WHEN i = 0 THEN 0::BIGINT ELSE bits END"),
        "list_all": _downloads(_LIST),
        "search_keyword": _downloads(_FOUND, f"{_like('file_name', c.KEYWORD)} OR {_like('extracted_text', c.KEYWORD)}"),
        "search_type": _downloads(_LIST, _like("file_type", c.TYPE)),
        "search_user": _downloads(_LIST, _like("downloaded_by", c.USER)),
        "search_dates": _between(c.START, c.END),
        "search_size_min": _downloads(_SIZED, f"file_size >= {c.MIN_SIZE}"),
        "search_size_range": _downloads(_SIZED, f"file_size BETWEEN {c.MIN_SIZE} AND {c.MAX_SIZE}"),
        "date_today": _between("2024-01-30", "2024-01-31"),
        "date_yesterday": _between("2024-01-29", "2024-01-30"),
        "date_week": _between("2024-01-29", "2024-01-31"),
        "date_month": _between("2024-01-01", "2024-01-31"),
        "date_last_month": _between("2024-01-01", "2024-02-01"),
        "preview_top20": _sql(
            f"""SELECT {_LIST}, greatest((SELECT count(*) FROM downloads) - {PREVIEW_ROWS}, 0) AS more FROM downloads
                ORDER BY download_time DESC, id DESC LIMIT {PREVIEW_ROWS}""", "downloads"),
        "alerts_all": _sql("SELECT * FROM alerts", "alerts"),
        "alerts_pending": _sql(f"SELECT * FROM alerts WHERE alert_for = '{c.ALERT_USER}' AND status = 'pending'", "alerts"),
        "max_alert_id": _sql("SELECT coalesce(max(id), 0) AS max_id FROM alerts", "alerts"),
        "alerts_since": _sql(
            f"SELECT * FROM alerts WHERE alert_for = '{c.ALERT_USER}' AND status = 'pending' AND id > {c.LAST_SEEN}", "alerts"),
        "stats": _sql(
            """SELECT (SELECT count(*) FROM downloads) AS total_files, count(*) AS total_alerts,
                      count(*) FILTER (status = 'pending') AS pending FROM alerts""", "downloads", "alerts"),
        "alert_messages": _sql(
            f"""SELECT id, CAST(trunc(similarity * 100) AS INT) AS percent, printf({message}, alert_for, new_file_name, original_file,
                  original_user, CAST(trunc(similarity * 100) AS INT), duplicate_type) AS message FROM alerts""", "alerts"),
        "utterance_intents": _sql(f"SELECT id, text, {_intent()} AS intent FROM asked", "asked"),
        "intent_counts": _sql(f"SELECT {_intent()} AS intent, count(*) AS n FROM asked GROUP BY 1", "asked"),
        # this engine's \\b and \\w know ASCII only, so other characters become a word character that no pattern names
        "conversation_intents": f"""SELECT conv_id, turn, {_intent()} AS intent
            FROM (SELECT conv_id, turn, regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g') AS text FROM conversations)""",
        "conversation_intent_counts": f"""SELECT {_intent()} AS intent, count(*) AS n
            FROM (SELECT regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g') AS text FROM conversations) GROUP BY 1""",
        "utterance_size": _asked(_min_bytes(), "min_bytes"),
        "utterance_type": _asked(_file_type(), "file_type"),
        "utterance_user": _asked(_user_name(), "user_name"),
        "utterance_two_users": _sql(f"SELECT id, {_pair_user(1)} AS user1, {_pair_user(2)} AS user2 FROM asked", "asked"),
        "utterance_keyword": _asked(_keyword(), "keyword"),
        "utterance_routed": _routed(),
        "monitor_alerts": _sql(
            f"""SELECT n.file_name AS new_file_name, n.downloaded_by AS alert_for, 'exact' AS duplicate_type, 1.0::DOUBLE AS similarity,
                  o.file_name AS original_file, o.file_path AS original_path, o.downloaded_by AS original_user
                FROM obs n JOIN ({_FIRST}) o USING (file_hash) WHERE o.id <> n.id
                UNION ALL
                SELECT file_name, downloaded_by, 'text_similar', round(score, 6), 'db_id:' || file_id, '', ''
                FROM (SELECT * FROM arrival_cosine QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) = 1)
                JOIN downloads d ON d.id = a
                JOIN (SELECT id, part * {ID_SPACE} + row_number() OVER (PARTITION BY part ORDER BY download_time) AS file_id
                      FROM (SELECT id, download_time, floor((id - first) * {BATCHES} / (last - first + 1))::BIGINT AS part
                            FROM obs, (SELECT min(id) AS first, max(id) AS last FROM obs))) p ON p.id = b""",
            "arrival_cosine", "downloads"),
        "monitor_registry": _downloads("file_name, file_hash, file_type, file_size, downloaded_by, md5(extracted_text) AS text_digest"),
        "alerts_by_day": _sql(
            f"""SELECT id, alert_for, duplicate_type, similarity, new_file_name, created_time FROM alert_log
                WHERE created_time >= TIMESTAMP '{c.START}' AND created_time < TIMESTAMP '{c.END}'""", "alert_log"),
        "alert_feed": _sql(f"SELECT * FROM alerts WHERE alert_for = '{c.ALERT_USER}' AND status = 'pending'", "alerts"),
        "stats_feed": _sql(
            """SELECT (SELECT count(*) FROM downloads) AS total_files, count(*) AS total_alerts,
                      count(*) FILTER (status = 'pending') AS pending FROM alerts""", "downloads", "alerts"),
    }
