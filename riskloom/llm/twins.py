"""The operators' queries in DuckDB SQL, for those that SQL can express."""

from __future__ import annotations

from riskloom.llm import centroids, decontam, mixing, neardup, pii, quality, search, secrets

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ROWS = "d AS MATERIALIZED (SELECT row_number() OVER () AS rid, *, coalesce(text, '') AS t FROM documents)"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spans(kind: str, pattern: str, skip: int = 0) -> str:
    """rid, kind, s, e, m of the matches in `d`. skip: a leading character that only has to be there, if one stands there."""
    p = _quoted(pattern)
    lead = f"CASE WHEN regexp_matches(m, '^[A-Za-z0-9]') THEN 0 ELSE {skip} END"
    return f"""SELECT rid, '{kind}' AS kind, pos + {lead} AS s, pos + length(m) AS e, substr(m, 1 + {lead}) AS m FROM (
        SELECT rid, m, sum(length(piece)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
        FROM (SELECT rid, unnest(string_split_regex(t, {p})) AS piece, unnest(regexp_extract_all(t, {p})) AS m,
                     unnest(range(len(string_split_regex(t, {p})))) AS i FROM d WHERE regexp_matches(t, {p}))
        WINDOW w AS (PARTITION BY rid ORDER BY i ROWS UNBOUNDED PRECEDING)) WHERE m IS NOT NULL"""


def _joined(of: str, order: str) -> str:
    return f"coalesce(string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY {order}) FILTER ({of}), '')"


def personal_data() -> str:
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"(?:^|[^A-Za-z0-9])[A-Z]{2}[0-9]{2}",
        "national": r"(?:^|[^A-Za-z0-9.+-])[0-9]{2,4}-[0-9]{2,4}-[0-9]{3,5}"}
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = (f"length({digits}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(length({digits})), lambda i: CASE WHEN i % 2 = 0 "
            f"THEN substr(reverse({digits}), i + 1, 1)::INT ELSE (substr(reverse({digits}), i + 1, 1)::INT * 2) // 10 + (substr(reverse({digits}), i + 1, 1)::INT * 2) % 10 END)) % 10 = 0")
    plain = "replace(m, ' ', '')"
    mod97 = (f"list_reduce(list_transform(string_split(substr({plain}, 5) || substr({plain}, 1, 4), ''), "
             "lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END), lambda a, x: CASE WHEN x < 10 THEN (a * 10 + x) % 97 ELSE (a * 100 + x) % 97 END) = 1")
    valid = {
        "email": "true", "ip": "list_bool_and(list_transform(string_split(m, '.'), lambda p: length(ltrim(p, '0')) < 3 OR (length(ltrim(p, '0')) = 3 AND ltrim(p, '0') <= '255')))",
        "card": luhn, "phone": f"length({digits}) BETWEEN 9 AND 15", "iban": mod97,
        "national": "NOT regexp_matches(substr(t, e::BIGINT + 1, 1), '[A-Za-z0-9-]')"}
    rank = "list_position([" + ", ".join(f"'{k}'" for k in patterns) + "], kind)"
    spans = {k: _spans(k, p, 1 if k in pii.ADDED else 0) for k, p in patterns.items()}
    # An account number is as long as its country's are, within the run that follows its first four characters.
    head = "[A-Z]{2}[0-9]{2}"
    by_country = " ".join(
        f"WHEN substr(run, 1, 2) IN ({', '.join(map(_quoted, names.split()))}) THEN regexp_extract(run, '^{head}(?:\\x20?[A-Z0-9]){{{n - 4}}}')"
        for n, names in pii.IBAN_LENGTHS.items())
    spans["iban"] = f"""SELECT rid, kind, s, s + length(m) AS e, m FROM (SELECT *, CASE {by_country} ELSE run END AS m FROM (
        SELECT rid, kind, s, regexp_extract(substr(t, s::BIGINT + 1, 64), '^{head}(?:\\x20?[A-Z0-9]){{11,30}}') AS run
        FROM ({spans['iban']}) JOIN d USING (rid)) WHERE run <> '') WHERE m <> ''"""
    found = "\nUNION ALL\n".join(
        f"""SELECT x.rid, kind, s, e, CASE WHEN regexp_matches(lower(substr(t, greatest(s - {pii.CONTEXT} + 1, 1)::BIGINT, least(s, {pii.CONTEXT})::BIGINT)), {_quoted(pii.CONTEXT_WORDS[k])})
            THEN least(1.0::DOUBLE, {pii.PRIOR[k]}::DOUBLE + {pii.BONUS}::DOUBLE) ELSE {pii.PRIOR[k]}::DOUBLE END AS score
            FROM ({spans[k]}) x JOIN d USING (rid) WHERE {valid[k]}""" for k in patterns)
    base = "kind IN ('email', 'ip', 'card', 'phone')"
    return f"""WITH {_ROWS}, f AS MATERIALIZED (SELECT *, {rank} AS rank FROM ({found})),
        g AS (SELECT * FROM f WHERE {base} OR (score >= {pii.FLOOR} AND NOT EXISTS (
              SELECT 1 FROM f b WHERE b.rid = f.rid AND b.rank <= 4 AND b.s < f.e AND f.s < b.e)))
        SELECT any_value(doc_id) AS doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in pii.BASE)},
               sha256({_joined(base, "rank, s")}) AS base_sha256, {_joined("kind IS NOT NULL", "rank, s")} AS spans, round(max(score), 3) AS max_score
        FROM d LEFT JOIN g USING (rid) GROUP BY rid"""


def secret_scan() -> str:
    kinds = secrets.BASE | secrets.WEAK
    valid = {"assign": f"length(regexp_extract(m, {_quoted(secrets.ASSIGN)}, 2)) >= 6", "access": "length(m) >= 20",
             "random": "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]')"}
    rank = "list_position([" + ", ".join(f"'{k}'" for k in kinds) + "], kind) - 1"
    role = "CASE " + " ".join(f"WHEN kind = '{k}' THEN '{r}'" for k, r in secrets.ROLES.items()) + " END"
    found = "\nUNION ALL\n".join(f"SELECT rid, kind, s, e FROM ({_spans(k, p)}) WHERE {valid.get(k, 'true')}" for k, p in kinds.items())
    near = f"b.s - a.e <= {secrets.SCOPE} AND a.s - b.e <= {secrets.SCOPE}"
    return f"""WITH {_ROWS}, every AS MATERIALIZED (SELECT *, {rank} AS rank, {role} AS role FROM ({found})),
        f AS (SELECT * FROM every a WHERE rank < 3 OR NOT EXISTS (SELECT 1 FROM every b WHERE b.rid = a.rid AND b.rank < 3 AND b.s < a.e AND a.s < b.e)),
        met AS (SELECT a.rid, a.kind, a.s, a.e, a.rank, a.role, count(DISTINCT b.role) FILTER (b.role = 'secret') AS sec,
                       count(DISTINCT b.role) FILTER (b.role = 'identifier') AS ident, count(DISTINCT b.role) FILTER (b.role = 'endpoint') AS endp
                FROM f a JOIN f b ON a.rid = b.rid AND a.role <> b.role AND {near} WHERE a.rank >= 3 GROUP BY ALL),
        g AS (SELECT rid, kind, s, e, rank FROM f WHERE rank < 3 UNION ALL SELECT rid, kind, s, e, rank FROM met
              WHERE (role = 'secret' AND ident + endp > 0) OR (role = 'identifier' AND sec > 0) OR (role = 'endpoint' AND ident + sec > 1))
        SELECT any_value(doc_id) AS doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in secrets.BASE)},
               sha256({_joined("rank < 3", "s, rank")}) AS base_sha256, {_joined("kind IS NOT NULL", "s, rank")} AS spans,
               count(*) FILTER (rank >= 3) AS n_linked
        FROM d LEFT JOIN g USING (rid) GROUP BY rid"""


def source_mix() -> str:
    weights = f"list_value({', '.join(str(float(w)) for w in mixing.WEIGHTS)})"
    top, repeats = mixing.MAX_REPEATS, range(mixing.MAX_REPEATS)
    taken = " + ".join(f"greatest(0, least(size, floor(target + 1e-6)::BIGINT - {n} * source_size - queued))" for n in repeats)
    return f"""WITH d AS (SELECT doc_id, source, len({_WORDS.format("coalesce(text, '')")}) AS size FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (SELECT *, {weights}[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1)::INT]::DOUBLE AS w, source_size * {float(top)}::DOUBLE AS top FROM s),
        r AS (SELECT *, coalesce(sum(top) OVER up, 0) AS before_top, coalesce(sum(w) OVER up, 0) AS before_w, sum(w) OVER () AS all_w, sum(source_size) OVER () AS total
              FROM w WINDOW up AS (ORDER BY top / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        l AS (SELECT *, (total - before_top) / (all_w - before_w) AS own FROM r),
        goal AS (SELECT source, source_size, least(top, coalesce((SELECT arg_min(own, before_w) FROM l WHERE top / w >= own) * w, top)) AS target FROM l),
        q AS (SELECT d.doc_id, size, source_size, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY coalesce(md5(d.doc_id::VARCHAR), '~'), size
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS queued FROM d JOIN goal ON d.source IS NOT DISTINCT FROM goal.source)
        SELECT doc_id, size, source_size, target, ({taken})::BIGINT AS taken FROM q"""


def quality_rules() -> str:
    classes = list(quality.CLASSES.values())
    marks = r"regexp_replace(t, '[a-z\x20\x09-\x0D\x{80}-\x{10FFFF}]+', '', 'g')"
    counts = [f"length(x.marks) - length(regexp_replace(x.marks, {_quoted(p)}, '', 'g'))" for p in classes]
    chars = "list_value(" + ", ".join([*counts, "length(t) - x.word_chars", "octet_length(encode(t)) - length(t)", "length(t)"]) + ")"
    each = ", ".join(f"len(list_filter(words, lambda w: w = {_quoted(w)}))" for w in quality.WORDS)
    rest = lambda c: f"list_concat({c}[:-2], [2 * {c}[-1] - list_sum({c})])"

    def divergence(mine: str, ref: str) -> str:
        p, q = f"({rest(mine)}[i] / {mine}[-1])", f"({rest(ref)}[i] / {ref}[-1])"
        term = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({p} + {q}) / 2)) ELSE 0 END"
        return f"CASE WHEN {mine}[-1] > 0 AND {ref}[-1] > 0 THEN list_sum(list_transform(range(1, len({mine}) + 1), lambda i: ({term(p)} + {term(q)}) / 2)) END"

    return f"""WITH {_ROWS}, w AS MATERIALIZED (SELECT rid, doc_id, lang, t, {_WORDS.format('t')} AS words, {marks} AS marks, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars FROM d),
        b AS MATERIALIZED (SELECT rid, doc_id, lang, len(words) AS n_words, word_chars, {counts[-1]} AS n_symbols,
              len(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')))) AS n_dup_lines,
              {chars} AS chars, list_value({each}, len(words)) AS common FROM w x),
        win AS (SELECT rid, unnest(range(len(words) - 7)) AS i, unnest(list_transform(range(len(words) - 7), lambda j: array_to_string(words[j + 1:j + 8], ' '))) AS h FROM w WHERE len(words) >= 8),
        hit AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, h) AS n FROM win) WHERE n > 1),
        rep AS (SELECT rid, sum(least(8, i - before))::BIGINT AS n FROM (SELECT rid, i, coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), -8) AS before FROM hit) GROUP BY rid),
        ref AS (SELECT lang, list_value({", ".join(f"sum(chars[{i + 1}])::BIGINT" for i in range(quality.BINS))}) AS rc,
                list_value({", ".join(f"sum(common[{i + 1}])::BIGINT" for i in range(len(quality.WORDS) + 1))}) AS rw FROM b WHERE n_words >= {quality.GUARD_WORDS} GROUP BY lang),
        m AS (SELECT b.*, coalesce(rep.n, 0) AS n_repeat_words, round({divergence("chars", "rc")}, 6) AS js_chars, round({divergence("common", "rw")}, 6) AS js_words
              FROM b LEFT JOIN rep USING (rid) LEFT JOIN ref ON b.lang IS NOT DISTINCT FROM ref.lang),
        k AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.REPEAT_PERCENT} * n_words AS base_failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(n_words >= {quality.GUARD_WORDS}
               AND (js_chars > {quality.CHAR_LIMIT} + {quality.CHAR_NOISE} / n_words::DOUBLE OR js_words > {quality.WORD_LIMIT} + {quality.WORD_NOISE} / n_words::DOUBLE), false) AS kept, js_chars, js_words FROM k"""


def near_duplicates() -> str:
    n = neardup.SHINGLE
    return f"""WITH RECURSIVE {_ROWS}, w AS MATERIALIZED (SELECT rid, doc_id, {_WORDS.format(_LOWER.format('t'))} AS words FROM d),
        sh AS MATERIALIZED (SELECT DISTINCT rid, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) <= {n} THEN [array_to_string(words, ' ')]
               ELSE list_transform(range(len(words) - {n - 1}), lambda i: array_to_string(words[i + 1:i + {n}], ' ')) END) AS g FROM w),
        size AS (SELECT rid, count(*) AS n FROM sh GROUP BY rid),
        shared AS (SELECT a.rid AS a, b.rid AS b, count(*) AS n FROM sh a JOIN sh b ON a.g = b.g AND a.rid <> b.rid GROUP BY ALL),
        link AS MATERIALIZED (SELECT a, b FROM shared JOIN size x ON x.rid = a JOIN size y ON y.rid = b WHERE 100 * shared.n >= {neardup.PERCENT} * (x.n + y.n - shared.n)),
        reach AS (SELECT rid AS a, rid AS b FROM w UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
        SELECT w.doc_id, coalesce(any_value(size.n), 0) AS n_shingles, min(o.doc_id) AS component_id, w.doc_id IS NOT DISTINCT FROM min(o.doc_id) AS kept
        FROM w JOIN reach ON reach.a = w.rid JOIN w o ON o.rid = reach.b LEFT JOIN size ON size.rid = w.rid GROUP BY w.rid, w.doc_id"""


def decontamination() -> str:
    n = decontam.WINDOW
    words = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(_LOWER.format("coalesce(text, '')"))
    return f"""WITH i AS (SELECT item_id, {words} AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, len(h) AS k, array_to_string(h, ' ') AS h FROM (SELECT item_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= {n} THEN [w]
                ELSE list_transform(range(len(w) - {n - 1}), lambda j: w[j + 1:j + {n}]) END) AS h FROM i)),
        d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents),
        size AS (SELECT DISTINCT k FROM win),
        dw AS (SELECT rid, k, unnest(range(len(w) - k + 1)) AS s, unnest(list_transform(range(len(w) - k + 1), lambda j: array_to_string(w[j + 1:j + k], ' '))) AS h FROM d, size WHERE len(w) >= k),
        hit AS MATERIALIZED (SELECT rid, s, k, item_id FROM dw JOIN win USING (k, h)),
        words_hit AS (SELECT rid, count(DISTINCT x) AS n FROM (SELECT rid, unnest(range(s, s + k)) AS x FROM hit) GROUP BY rid),
        items AS (SELECT rid, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY rid)
        SELECT doc_id, len(w) AS n_words, coalesce(words_hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(words_hit.n, 0) > 0 AND 20 * coalesce(words_hit.n, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN words_hit USING (rid) LEFT JOIN items USING (rid)"""


def ranked_search() -> str:
    words = f"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_quoted(search.TERM)})"
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents),
        s AS (SELECT count(*)::BIGINT AS docs, sum(len(w))::BIGINT AS terms FROM d WHERE len(w) > 0),
        q AS MATERIALIZED (SELECT DISTINCT item_id, unnest({words}) AS term FROM benchmark),
        tf AS MATERIALIZED (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
        weight AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM tf, s GROUP BY term, docs),
        m AS (SELECT rid, doc_id, 100 - 50 + ((50 * len(w) * docs) // terms) AS m FROM d, s WHERE len(w) > 0),
        hit AS (SELECT item_id, rid, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
                FROM q JOIN tf USING (term) JOIN weight USING (term) JOIN m USING (rid) GROUP BY ALL)
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score
        FROM hit WHERE score > 0 QUALIFY rank <= {search.TOP}"""


def centroid_clusters() -> str:
    dims, k = centroids.DIMS, centroids.CLUSTERS
    parts = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({centroids.SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{centroids.SEED}:' || vec_id), v) - 1 AS c, v AS m FROM v QUALIFY c < {k})"""]
    nearest = """SELECT rid, arg_min(c, (dist, c)) AS c, min(dist) AS dist FROM (
        SELECT rid, c, list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS dist FROM v, {}) GROUP BY rid"""
    for n in range(centroids.ROUNDS):
        parts.append(f"a{n} AS MATERIALIZED ({nearest.format(f'c{n}')})")
        means = ", ".join(f"floor(sum(v[{i + 1}])::DOUBLE / count(*))::BIGINT" for i in range(dims))
        parts.append(f"""c{n + 1} AS MATERIALIZED (SELECT c{n}.c, coalesce(x.m, c{n}.m) AS m FROM c{n} LEFT JOIN (
            SELECT c, [{means}] AS m FROM a{n} JOIN v USING (rid) GROUP BY c) x USING (c))""")
    last = f"c{centroids.ROUNDS}"
    parts.append(f"a AS MATERIALIZED ({nearest.format(last)})")
    return f"""WITH {", ".join(parts)} SELECT vec_id, c::INT AS cluster, dist AS distance, (sum(dist) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
        (sum(dist) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a JOIN v USING (rid) JOIN {last} USING (c)"""


def sql_texts() -> dict[str, str]:
    return {
        "op1_secret_scan": secret_scan(), "op4_personal_data": personal_data(), "op6_source_mix": source_mix(),
        "op7_quality_rules": quality_rules(), "op8_near_duplicates": near_duplicates(), "op10_decontamination": decontamination(),
        "op12_ranked_search": ranked_search(), "op13_centroids": centroid_clusters()}
