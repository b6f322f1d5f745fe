"""SQL twins, for DuckDB, of the operators that SQL can express."""

from __future__ import annotations

from seenscope.llm import chat, trust, warc

UPPER, LOWER = trust.UPPER, trust.LOWER


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def chats() -> str:
    """The template is reversible, so the digests are those of the given turns."""
    escaped = (
        "regexp_replace(regexp_replace(regexp_replace({0}, '%(25|3C|5B|7C)', '%25\\1', 'g'), "
        "'<(\\||/?s>|</?SYS>>)', '%3C\\1', 'g'), '\\[(/?INST\\])', '%5B\\1', 'g')"
    )
    marks = len(chat.OPEN) + len(chat.CLOSE) + len(chat.END)
    order = "ORDER BY turn, role, text"
    return f"""
    WITH turns AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
      UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
    ), joined AS (
      SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' {order}) AS lines,
        coalesce(string_agg(text, '' {order}) FILTER (role = '{chat.ASSISTANT}'), '') AS loss,
        sum(length({escaped.format("text")}) + length(replace({escaped.format("role")}, '|', '%7C')) + {marks}) AS chars
      FROM turns GROUP BY conv_id
    )
    SELECT conv_id, n_turns, sha256(lines) AS turns_sha256, length(loss) AS loss_chars,
      sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
    FROM joined
    """


def _suffixes(host: str) -> str:
    return f"list_transform(range(1, len(string_split({host}, '.')) + 1), lambda i: array_to_string(string_split({host}, '.')[i:], '.'))"


def verdicts() -> str:
    rules = ", ".join(f"({_text(h)}, {_text(p)}, {_text(v)})" for h, p, v in trust.RULES)
    lower = lambda x: f"translate({x}, '{UPPER}', '{LOWER}')"
    rounds = []
    for i in range(trust.ROUNDS):
        rounds.append(f"""
    r{i + 1} AS MATERIALIZED (
      SELECT * FROM (
        SELECT kind, host, sum(rank) AS rank FROM (
          SELECT kind, f.dest AS host, r.rank * f.share * {trust.DAMPING} AS rank
          FROM r{i} r JOIN flows f USING (kind, host)
          UNION ALL SELECT kind, host, seed * (1 - {trust.DAMPING}) FROM start
        ) GROUP BY kind, host
      ) WHERE rank >= {trust.LEAST}
    )""")
    return f"""
    WITH rules(domain, rule_path, verdict) AS (VALUES {rules}),
    parsed AS MATERIALIZED (
      SELECT page_id, {lower("regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)")} AS host,
        regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path,
        coalesce(html, '') AS html
      FROM pages
    ),
    hosts AS MATERIALIZED (SELECT DISTINCT host FROM parsed),
    fitting AS MATERIALIZED (
      SELECT host, list(struct_pack(o := -length(domain || rule_path), rule := domain || rule_path,
        rule_path := rule_path, verdict := verdict)) AS rules
      FROM (SELECT host, unnest({_suffixes("host")}) AS domain FROM hosts) JOIN rules USING (domain)
      GROUP BY host
    ),
    ruled AS MATERIALIZED (
      SELECT p.page_id, p.host, p.path,
        list_sort(list_filter(f.rules, lambda r: starts_with(p.path, r.rule_path)))[1] AS chosen
      FROM parsed p LEFT JOIN fitting f USING (host)
    ),
    votes AS (
      SELECT host, count(*) FILTER (chosen.verdict = 'allow') AS allowed,
        count(*) FILTER (chosen.verdict = 'block') AS blocked
      FROM ruled WHERE host <> '' GROUP BY host
    ),
    targets AS (
      SELECT host AS a, {lower("unnest(regexp_extract_all(html, " + _text(trust._LINK) + ", 1))")} AS b FROM parsed
    ),
    links AS MATERIALIZED (
      SELECT a, b, count(*) AS n FROM targets WHERE a <> '' AND b <> '' AND a <> b GROUP BY a, b
    ),
    domains AS MATERIALIZED (
      SELECT DISTINCT unnest({_suffixes("host")}) AS host
      FROM (SELECT host FROM hosts WHERE host <> '' UNION ALL SELECT b FROM links)
    ),
    child AS (
      SELECT host AS a, array_to_string(string_split(host, '.')[2:], '.') AS b
      FROM domains WHERE len(string_split(host, '.')) > 2
    ),
    edges AS MATERIALIZED (
      SELECT a, b, sum(n) AS n FROM (
        SELECT a, b, n FROM links UNION ALL SELECT a, b, 1 FROM child UNION ALL SELECT b, a, 1 FROM child
      ) GROUP BY a, b
    ),
    directed AS (
      SELECT 'trust' AS kind, a AS host, b AS dest, n FROM edges
      UNION ALL SELECT 'distrust', b, a, n FROM edges
    ),
    flows AS MATERIALIZED (
      SELECT kind, host, dest, n / sum(n) OVER (PARTITION BY kind, host) AS share FROM directed
    ),
    start AS MATERIALIZED (
      SELECT * FROM (
        SELECT 'trust' AS kind, host, allowed / nullif((SELECT sum(allowed) FROM votes), 0) AS seed FROM votes
        UNION ALL SELECT 'distrust', host, blocked / nullif((SELECT sum(blocked) FROM votes), 0) FROM votes
      ) WHERE seed > 0
    ),
    r0 AS (SELECT kind, host, seed AS rank FROM start),{",".join(rounds)},
    scores AS (
      SELECT host, coalesce(sum(rank) FILTER (kind = 'trust'), 0) AS trust,
        coalesce(sum(rank) FILTER (kind = 'distrust'), 0) AS distrust
      FROM r{trust.ROUNDS} GROUP BY host
    )
    SELECT page_id, host, path, chosen.rule AS rule,
      coalesce(chosen.verdict, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict,
      round(coalesce(trust, 0), 9) AS trust, round(coalesce(distrust, 0), 9) AS distrust
    FROM ruled LEFT JOIN scores USING (host)
    """


def revisits() -> str:
    """The crawl log of the registered query, whose URLs all have a scheme; what a revisit may
    update are its tag, date and cache control."""
    tracking = warc._TRACKING
    return f"""
    WITH captures AS (
      SELECT page_id, url, coalesce(html, '') AS html, unnest(range(0, page_id % 4 + 1)) AS n FROM pages
    ), marked AS (
      SELECT *, (n = 0 AND page_id % 5 <> 0) OR (n = 2 AND page_id % 3 = 0) AS is_full FROM captures
    ), records AS (
      SELECT page_id * 4 + n AS record_id, is_full, n, page_id, html,
        regexp_replace(url, '#.*', '', 's') AS whole,
        1704067200 + page_id * 60 + n * 86400 AS date,
        CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 7 = 0 AND NOT is_full THEN '"other"'
          ELSE (CASE WHEN is_full THEN '' ELSE 'W/' END) || '"' || md5(html) || '-' ||
            (CASE WHEN n >= 2 AND page_id % 3 = 0 THEN '2' ELSE '1' END) || '"' END AS tag,
        'day ' || (page_id % 28) AS modified
      FROM marked
    ), parts AS (
      SELECT *, translate(regexp_extract(whole, '^([^:/?#]*)://', 1), '{UPPER}', '{LOWER}') AS scheme,
        translate(regexp_extract(whole, '^[^:/?#]*://([^/?]*)', 1), '{UPPER}', '{LOWER}') AS host,
        regexp_extract(whole, '^[^:/?#]*://[^/?]*([^?]*)', 1) AS path,
        array_to_string(list_filter(string_split(regexp_extract(whole, '\\?(.*)$', 1), '&'),
          lambda x: x <> '' AND NOT regexp_full_match(x, '{tracking}')), '&') AS query
      FROM records
    ), named AS (
      SELECT *, scheme || '://' ||
        regexp_replace(host, CASE WHEN scheme = 'http' THEN ':(80)?$' ELSE ':(443)?$' END, '') ||
        (CASE WHEN path = '' THEN '/' ELSE path END) || (CASE WHEN query = '' THEN '' ELSE '?' || query END) AS url
      FROM parts
    ), joined AS (
      SELECT *, last_value(CASE WHEN is_full THEN struct_pack(id := record_id, tag := tag, modified := modified,
          html := html) END IGNORE NULLS) OVER (PARTITION BY url ORDER BY date, record_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
      FROM named
    ), judged AS (
      SELECT *, CASE WHEN seen IS NULL THEN 'missing'
        WHEN tag IS NOT NULL AND coalesce(regexp_replace(tag, '^W/', '') = regexp_replace(seen.tag, '^W/', ''), false) THEN 'resolved'
        WHEN tag IS NULL AND modified = seen.modified THEN 'resolved' ELSE 'mismatch' END AS outcome
      FROM joined WHERE NOT is_full
    )
    SELECT record_id AS revisit_id, url, CASE WHEN outcome = 'resolved' THEN seen.id END AS refers_to, outcome,
      'cache-control: max-age=' || n || chr(10) || 'content-length: ' ||
        (CASE WHEN outcome = 'resolved' THEN length(seen.html) ELSE 0 END) ||
        coalesce(chr(10) || 'etag: ' || coalesce(tag, CASE WHEN outcome = 'resolved' THEN seen.tag END), '') ||
        chr(10) || 'last-modified: ' || modified AS headers,
      CASE WHEN outcome = 'resolved' THEN length(seen.html) END AS payload_chars,
      CASE WHEN outcome = 'resolved' THEN sha256(seen.html) END AS payload_sha256
    FROM judged
    """


def prefix_trie() -> str:
    """Subtree sums by listing, for every node, the nodes on its way to the root."""
    # CRC-32 of the decimal digits, from its rule.
    table = (
        "list_transform(range(256), lambda i: list_reduce(range(8), "
        "lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i))"
    )
    return f"""
    WITH crc AS (SELECT {table} AS steps), turns AS (
      SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id
          ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS pos
      FROM conversations WHERE conv_id IS NOT NULL
    ), convs AS (
      SELECT conv_id, conv_id - conv_id % 20 AS lender,
        xor(list_reduce(string_split(conv_id::VARCHAR, ''),
          lambda a, c: xor(a >> 8, steps[(xor(a, ascii(c)::BIGINT) & 255) + 1]), 4294967295::BIGINT),
          4294967295) % 4 AS h
      FROM (SELECT DISTINCT conv_id FROM turns), crc
    ), rebuilt AS (
      SELECT c.conv_id, 0 AS part, t.pos, t.role, t.text FROM convs c JOIN turns t
      ON t.conv_id = c.lender AND t.pos <= c.h
      UNION ALL SELECT c.conv_id, 1, t.pos, t.role, t.text FROM convs c JOIN turns t
      ON t.conv_id = c.conv_id AND t.pos > c.h
    ), placed AS (
      SELECT conv_id, row_number() OVER w AS depth, count(*) OVER (PARTITION BY conv_id) AS n,
        md5(string_agg(md5(length(role) || ':' || role || text), ',') OVER w) AS node,
        len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words
      FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos ROWS UNBOUNDED PRECEDING)
    ), path AS (
      SELECT conv_id, depth, n, node, words FROM placed
      UNION ALL SELECT conv_id, 0, coalesce(n, 0), '', 0 FROM convs
      LEFT JOIN (SELECT conv_id, max(n) AS n FROM placed GROUP BY conv_id) USING (conv_id)
    ), nodes AS (
      SELECT node, min(conv_id) AS conv_id, min(depth) AS depth, count(*) AS n_convs, min(words) AS words,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = n), '')) AS ends_sha256
      FROM path GROUP BY node
    ), linked AS (
      SELECT n.*, up.node AS parent FROM nodes n LEFT JOIN path up
      ON up.conv_id = n.conv_id AND up.depth = n.depth - 1
    ), kids AS (SELECT parent, count(*) AS n_children FROM linked WHERE parent IS NOT NULL GROUP BY parent),
    sums AS (
      SELECT p.node, count(*) FILTER (k.n_children IS NULL) AS n_leaves,
        sum((l.n_convs - 1) * l.words)::BIGINT AS saved_tokens
      FROM linked l LEFT JOIN kids k ON k.parent = l.node
      JOIN path p ON p.conv_id = l.conv_id AND p.depth <= l.depth GROUP BY p.node
    )
    SELECT l.conv_id, l.depth, u.conv_id AS parent_conv_id, l.n_convs,
      coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, l.ends_sha256
    FROM linked l LEFT JOIN nodes u ON u.node = l.parent LEFT JOIN kids k ON k.parent = l.node
    JOIN sums s ON s.node = l.node
    """


def hard_negatives() -> str:
    """All scores of all anchors."""
    return """
    WITH vectors AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
      FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
      SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
        list_dot_product(a.v, b.v)::BIGINT AS score
      FROM vectors a, vectors b WHERE a.vec_id % 100 = 0 AND (a.label <> b.label OR a.vec_id <> b.vec_id)
    ), positives AS (
      SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
    )
    SELECT anchor_id, positive_id, row_number() OVER w AS rank, vec_id AS negative_id, positive_score,
      score AS negative_score
    FROM positives JOIN scored USING (anchor_id)
    WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
    WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
    QUALIFY row_number() OVER w <= 5
    """
