"""SQL of the queries that SQL can express, written from their definitions alone.

The licence templates are shared with the operator; nothing else is.
"""

from __future__ import annotations

from marketmood.llm.licenses import BASE, TEMPLATES, Template

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPACES = r"[\x20\x09-\x0D]+"


def _words(text: str, breaks: str = _SPACES) -> str:
    return f"list_filter(string_split_regex(coalesce({text}, ''), '{breaks}'), lambda x: x <> '')"


def _lower(text: str) -> str:
    return f"translate({text}, '{_UPPER}', '{_UPPER.lower()}')"


def _shingles(table: str, key: str) -> str:
    """Distinct (key, shingle) rows of a table's texts."""
    return f"""
        SELECT DISTINCT {key}, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g
        FROM (SELECT {key}, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i
              FROM (SELECT {key}, {_words(_lower("text"))} AS w FROM {table}) WHERE len(w) > 0)"""


JACCARD = f"""
WITH RECURSIVE s AS ({_shingles("documents", "doc_id")}),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
      FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
      WHERE 100 * c >= 75 * (a.n + b.n - c)),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.x = d.doc_id
"""

URLS = f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
           FROM pages),
p AS (SELECT page_id, {_lower("regexp_extract(rest, '^[^/?#]*')")} AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT page_id, host, path, CASE
      WHEN (host = 'www.example.com' OR suffix(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
      WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
      WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
      WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
      WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM m
"""

# Items of five words or more are compared by 5-word shingles; the table has no shorter ones.
CONTAINED = f"""
WITH s AS ({_shingles("documents", "doc_id")}),
i AS ({_shingles("benchmark", "item_id")}),
n AS (SELECT item_id, count(*) AS n FROM i GROUP BY 1),
p AS (SELECT s.doc_id, i.item_id, count(*) AS c FROM s JOIN i ON s.g = i.g GROUP BY 1, 2)
SELECT doc_id, item_id, n AS n_item_shingles, c AS n_shared, c / n AS containment
FROM p JOIN n USING (item_id) WHERE 100 * c >= 75 * n
"""

REPEATS = f"""
WITH d AS (SELECT doc_id, {_words("text")} AS w FROM documents),
v AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
f AS (SELECT g, min(doc_id) AS first FROM v GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM v JOIN f USING (g) WHERE first < doc_id),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept, count(*) AS n
      FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d)
      ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


def _list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _licenses() -> str:
    items = [Template.of(*t) for t in TEMPLATES]
    base = [(label, tuple(phrase.split())) for label, phrase in BASE]
    phrases = sorted({p for t in items for p in t.phrases} | {p for _, p in base})
    name = {p: f"p{i}" for i, p in enumerate(phrases)}
    places = ", ".join(
        f"CASE WHEN list_has_all(w, {_list(p)}) THEN list_filter(range(0, len(w) - {len(p) - 1}), "
        f"lambda i: w[i + 1:i + {len(p)}] = {_list(p)}) ELSE CAST([] AS BIGINT[]) END AS {name[p]}"
        for p in phrases
    )
    starts = []
    for item in items:
        parts = [f"list_transform({name[p]}, lambda i: i - {item.offset(p)})" for p in item.phrases]
        sql = parts[0]
        for part in parts[1:]:
            sql = f"list_intersect({sql}, {part})"
        starts.append(sql)
    columns = ", ".join(f"{sql} AS s{i}" for i, sql in enumerate(starts))
    marks = ", ".join(f"CASE WHEN len(s{i}) > 0 THEN '{item.label}' END" for i, item in enumerate(items))
    own = ", ".join(f"CASE WHEN len({name[p]}) > 0 THEN '{label}' END" for label, p in base)
    shares = []
    for i, item in enumerate(items):
        same = " + ".join(
            f"CASE WHEN s + {k} >= 0 AND w[s + {k + 1}] = '{word}' THEN 1 ELSE 0 END" for k, word in enumerate(item.words)
        )
        shares.append(f"coalesce(list_max(list_transform(s{i}, lambda s: ({same}) / {len(item.words)})), 0)")
    joined = "array_to_string(list_sort(list_distinct(list_filter({}, lambda x: x IS NOT NULL))), ',')"
    words = _words(_lower("text"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
a AS (SELECT *, {places} FROM d),
b AS (SELECT *, list_concat({", ".join(name[p] for _, p in base)}) AS base, {columns} FROM a)
SELECT doc_id, len(w) AS n_words, len(base) AS n_base, list_min(base) AS first_word, list_max(base) AS last_word,
       {joined.format(f"[{own}]")} AS base_labels, {joined.format(f"[{own}, {marks}]")} AS labels,
       CAST(greatest({", ".join(shares)}) AS DOUBLE) AS score
FROM b
"""


# crc32 of the decimal id: a table of 256 remainders, then byte by byte.
_BYTE_CRC = "list_reduce(list_concat([CAST(x AS BIGINT)], CAST(range(8) AS BIGINT[])), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)"
TRIE = f"""
WITH k AS (SELECT list_transform(range(256), lambda x: {_BYTE_CRC}) AS t),
o AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS w
      FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
h AS (SELECT conv_id, w, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)],
             list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
             lambda a, b: xor(t[(xor(a, b) % 256) + 1], a // 256)), 4294967295) % 9 AS h FROM o, k),
c AS (SELECT h.conv_id, list_concat(coalesce(b.w, [])[1:h.h], h.w[h.h + 1:]) AS w
      FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, len(w) AS n, unnest(range(len(w) + 1)) AS d, w FROM c),
n AS (SELECT w[1:d] AS w, d, min(conv_id) AS conv_id, count(*) AS n_convs,
             coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '') AS ends
      FROM p GROUP BY 1, 2),
m AS (SELECT a.*, count(b.d) AS n_children FROM n a LEFT JOIN n b ON b.d = a.d + 1 AND b.w[1:a.d] = a.w GROUP BY ALL),
s AS (SELECT w[1:e] AS w, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves,
             sum(CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * strlen(w[d].t) END) AS saved_tokens
      FROM (SELECT *, unnest(range(d + 1)) AS e FROM m) GROUP BY 1)
SELECT m.conv_id, m.d AS depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children,
       CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN s ON s.w = m.w LEFT JOIN m q ON m.d > 0 AND q.d = m.d - 1 AND q.w = m.w[1:m.d - 1]
"""

NEIGHBOURS = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""

_TERM_BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RANKED = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_words(_lower("text"), _TERM_BREAKS)} AS w FROM documents),
t AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(w) AS term FROM d) GROUP BY 1, 2),
c AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_words FROM d WHERE len(w) > 0),
g AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM t, c GROUP BY term, n_docs),
m AS (SELECT row, doc_id, 100 - 25 + (25 * len(w) * n_docs) // n_words AS m FROM d, c),
i AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_words(_lower("text"), _TERM_BREAKS)}) AS term FROM benchmark) GROUP BY 1, 2),
s AS (SELECT item_id, row, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
      FROM i JOIN g USING (term) JOIN t USING (term) JOIN m USING (row) GROUP BY 1, 2, 3)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 20
"""


ORACLES = {
    "op1_jaccard_join": JACCARD,
    "op4_url_rules": URLS,
    "op6_decontamination": CONTAINED,
    "op8_licenses": _licenses(),
    "op9_substring_dedup": REPEATS,
    "op11_prefix_trie": TRIE,
    "op12_vector_topk": NEIGHBOURS,
    "op13_ranked_search": RANKED,
}
