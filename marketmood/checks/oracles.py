"""The registered queries in SQL, written from the definitions alone.

``VIEWS`` are named subqueries; each oracle pulls in those it mentions, and those
they mention in turn. The fixed word list is shared with the library; nothing
else is.
"""

from __future__ import annotations

import re

from marketmood.functions.words import STOP_WORDS

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_WORDS = r"'[\p{L}\p{N}_]{2,}'"


def _r(expression: str, digits: int = 6) -> str:
    """Rounded, never negative zero."""
    return (
        f"CASE WHEN round({expression}, {digits}) = 0 THEN 0.0 "
        f"ELSE round({expression}, {digits}) END"
    )


def _bars(name_column: str, key: str, close: str = "max_by(value, event_id)") -> str:
    group = "1, 2" if key else "1"
    ticker = f"CAST({key} AS VARCHAR) AS {name_column}," if key else ""
    return (
        f"SELECT CAST(ts AS DATE) AS date, {ticker} min_by(value, event_id) AS open, "
        f"max(value) AS high, min(value) AS low, {close} AS close, count(*) AS volume "
        f"FROM events GROUP BY {group}"
    )


def _label_view(stock_returns: str) -> str:
    return (
        "SELECT s.date, s.ticker, CASE WHEN s.pct_change > i.pct_change + 0.5 THEN 'bullish' "
        "WHEN s.pct_change < i.pct_change - 0.5 THEN 'bearish' ELSE 'neutral' END AS sentiment "
        f"FROM {stock_returns} s JOIN index_ret i ON s.date = i.date"
    )


def _returns(table: str, partition: str, columns: str) -> str:
    window = f"OVER ({partition} ORDER BY date)"
    return (
        f"SELECT {columns}, close, CASE WHEN lag(close) {window} = 0 THEN NULL "
        f"ELSE (close / lag(close) {window} - 1) * 100 END AS pct_change FROM {table}"
    )


def _best(columns: dict[str, str], tie: tuple[str, ...]) -> str:
    """CASE for the label of the highest column; the first of ``tie`` wins."""
    arms = []
    for i, label in enumerate(tie):
        later = [f"{columns[label]} >= {columns[o]}" for o in tie[i + 1 :]]
        earlier = [f"{columns[label]} > {columns[o]}" for o in tie[:i]]
        arms.append(f"WHEN {' AND '.join(earlier + later)} THEN '{label}'")
    return f"CASE {' '.join(arms)} END"


_ALPHABETICAL = ("bearish", "bullish", "neutral")
_ORDER = ("bullish", "neutral", "bearish")
_SAME = {l: l for l in _ORDER}
_POS = "CASE WHEN compound > 0 THEN greatest((compound + t) / (t + t + 1), 0) ELSE 0 END"
_NEG = "CASE WHEN compound < 0 THEN greatest((t - compound) / (t + t + 1), 0) ELSE 0 END"


def _per_label(template: str, joiner: str = ", ") -> str:
    return joiner.join(template.format(l=l) for l in _ORDER)


VIEWS = {
    "stock": _bars("ticker", "event_type"),
    "stock_users": _bars("ticker", "user_id"),
    "market": _bars("", "", "round(avg(value), 6)"),
    "stock_ret": _returns("stock", "PARTITION BY ticker", "ticker, date"),
    "users_ret": _returns("stock_users", "PARTITION BY ticker", "ticker, date"),
    "index_ret": _returns("market", "", "date"),
    "ticker_labels": _label_view("stock_ret"),
    "user_labels": _label_view("users_ret"),
    "news": """
        SELECT doc_id AS news_id, DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS date,
               CASE WHEN doc_id % 17 <> 0 THEN split_part(text, chr(10), 1) END AS title,
               CASE WHEN doc_id % 13 <> 0
                    THEN substr(text, length(split_part(text, chr(10), 1)) + 2) END AS description,
               '' AS content,
               (['click', 'error', 'purchase', 'signup', 'view'])[CAST((doc_id // 30) % 5 + 1 AS INTEGER)]
                   AS ticker,
               CASE WHEN doc_id % 2 = 0 THEN 'newsapi' ELSE 'tickertick' END AS source,
               n_chars AS score
        FROM documents""",
    "phrases": """
        SELECT d.doc_id, d.text, CASE WHEN toxic = 1 THEN 'bearish' WHEN quality = 1 THEN 'bullish'
               ELSE 'neutral' END AS label
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "stripped": r"""
        SELECT news_id, date, ticker, string_split_regex(regexp_replace(
                   lower(coalesce(title, '') || ' ' || coalesce(description, '')),
                   '[^\p{L}\p{N}_\s]', '', 'g'), '\s+') AS words
        FROM news""",
    "cleaned_all": f"""
        SELECT news_id, date, ticker, array_to_string(list_filter(list_transform(
                   list_filter(words, lambda w: w <> '' AND w NOT IN ({_STOP})),
                   lambda w: CASE w WHEN 'cannot' THEN '' WHEN 'gimme' THEN 'gim'
                        WHEN 'lemme' THEN 'lem' WHEN 'gonna' THEN 'gon na'
                        WHEN 'gotta' THEN 'got ta' WHEN 'wanna' THEN 'wan na' ELSE w END),
                   lambda w: w <> ''), ' ') AS cleaned_text
        FROM stripped""",
    "cleaned": "SELECT * FROM cleaned_all WHERE cleaned_text <> ''",
    "aligned": """
        SELECT c.news_id, c.date, c.ticker, c.cleaned_text, l.sentiment
        FROM cleaned c JOIN ticker_labels l ON c.date = l.date AND c.ticker = l.ticker""",
    "aligned_split": """
        SELECT *, substr(md5(CAST(news_id AS VARCHAR)), 1, 8) < '33333333' AS is_test FROM aligned""",
    # Naive Bayes.
    "phrase_tokens": f"""
        SELECT doc_id, label, unnest(regexp_extract_all(lower(text), {_WORDS})) AS token FROM phrases""",
    "vocab": "SELECT DISTINCT token FROM phrase_tokens",
    "train": "SELECT cleaned_text AS text, sentiment AS label FROM aligned_split WHERE NOT is_test",
    "train_tokens": f"""
        SELECT label, unnest(regexp_extract_all(lower(text), {_WORDS})) AS token FROM train""",
    "all_tokens": f"""
        SELECT sentiment AS label, unnest(regexp_extract_all(lower(cleaned_text), {_WORDS})) AS token
        FROM aligned""",
    "scored_tokens": f"""
        SELECT news_id, unnest(regexp_extract_all(lower(cleaned_text), {_WORDS})) AS token
        FROM aligned_split""",
    "nb_model": "",  # filled below
    "nb_sums": """
        SELECT s.news_id, sum(w_bullish) AS bullish, sum(w_neutral) AS neutral, sum(w_bearish) AS bearish
        FROM scored_tokens s JOIN nb_model m ON s.token = m.token GROUP BY 1""",
    "nb_scores": """
        SELECT a.news_id, a.date, a.ticker, a.sentiment, a.is_test, """
    + _per_label("coalesce(s.{l}, 0) + p.w_{l} AS {l}")
    + """ FROM aligned_split a LEFT JOIN nb_sums s ON a.news_id = s.news_id
        JOIN (SELECT * FROM nb_model WHERE token = '') p ON true""",
    "nb_rounded": "SELECT news_id, date, ticker, sentiment, is_test, "
    + _per_label("round({l}, 9) AS {l}")
    + " FROM nb_scores",
    "nb_predicted": "SELECT news_id, date, ticker, sentiment, is_test, "
    + _best(_SAME, _ALPHABETICAL)
    + " AS prediction FROM nb_rounded",
    "nb_powers": "SELECT news_id, sentiment, is_test, "
    + _per_label("exp({l} - greatest(bullish, neutral, bearish)) AS {l}")
    + " FROM nb_scores",
    "nb_shares": "SELECT news_id, sentiment, is_test, "
    + _per_label("{l} / (bullish + neutral + bearish) AS {l}")
    + " FROM nb_powers",
    # Polarity.
    "phrase_words": "SELECT DISTINCT doc_id, label, token FROM phrase_tokens",
    "word_table": """
        SELECT token, floor((good - bad * 6) * CAST(40 AS DOUBLE) / (good + bad * 6) + CAST(0.5 AS DOUBLE))
               / CAST(10 AS DOUBLE) AS valence
        FROM (SELECT token, count(*) FILTER (label = 'bullish') AS good,
                     count(*) FILTER (label = 'bearish') AS bad FROM phrase_words GROUP BY 1)
        WHERE good + bad >= 2""",
    "lex": "SELECT token, valence FROM word_table WHERE valence <> 0",
    "mods": f"""
        SELECT token, CAST(CASE length(token) % 3 WHEN 0 THEN 0.293 WHEN 1 THEN -0.293 ELSE 0 END AS DOUBLE)
                   AS degree, length(token) % 3 = 2 AS negates
        FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), {_WORDS})) AS token FROM benchmark)""",
    "active": "SELECT * FROM mods WHERE token NOT IN (SELECT token FROM lex)",
    "word_rows": """
        SELECT news_id, unnest(w) AS token, generate_subscripts(w, 1) AS pos
        FROM (SELECT news_id, list_filter(string_split(cleaned_text, ' '), lambda x: length(x) > 1) AS w
              FROM cleaned)""",
    "context": """
        SELECT news_id, token, lag(token, 1) OVER o AS b1, lag(token, 2) OVER o AS b2,
               lag(token, 3) OVER o AS b3
        FROM word_rows WINDOW o AS (PARTITION BY news_id ORDER BY pos)""",
    "hit0": """
        SELECT c.news_id, l.valence AS v, coalesce(m1.degree, 0) AS d1, coalesce(m2.degree, 0) AS d2,
               coalesce(m3.degree, 0) AS d3, coalesce(m1.negates, false) AS n1,
               coalesce(m2.negates, false) AS n2, coalesce(m3.negates, false) AS n3
        FROM context c JOIN lex l ON c.token = l.token
        LEFT JOIN active m1 ON c.b1 = m1.token LEFT JOIN active m2 ON c.b2 = m2.token
        LEFT JOIN active m3 ON c.b3 = m3.token
        WHERE c.token NOT IN (SELECT token FROM mods WHERE degree <> 0)""",
    **{
        f"hit{k}": f"""
        SELECT * REPLACE ((v + CASE WHEN v < 0 THEN -d{k} ELSE d{k} END * CAST({damp} AS DOUBLE))
               * CASE WHEN n{k} THEN CAST(-0.74 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS v)
        FROM hit{k - 1}"""
        for k, damp in ((1, 1.0), (2, 0.95), (3, 0.9))
    },
    "polar": """
        SELECT c.news_id, c.date, c.ticker,
               coalesce(round(s / sqrt(s * s + 15), 4), 0) AS compound
        FROM cleaned c LEFT JOIN (SELECT news_id, sum(v) AS s FROM hit3 GROUP BY 1) h
        ON c.news_id = h.news_id""",
    "polar_label": """
        SELECT news_id, date, ticker, CASE WHEN compound > 0.05 THEN 'bullish'
               WHEN compound < -0.05 THEN 'bearish' ELSE 'neutral' END AS sentiment FROM polar""",
    # Blend.
    "grid": """
        SELECT CAST(i AS DOUBLE) * CAST(0.05 AS DOUBLE) AS t,
               CAST(0.5 AS DOUBLE) + CAST(0.1 AS DOUBLE) * CAST(j AS DOUBLE) AS w
        FROM range(7) a(i), range(5) b(j)""",
    "point": "SELECT CAST(0.05 AS DOUBLE) AS t, CAST(0.7 AS DOUBLE) AS w",
    "member": """
        SELECT n.news_id, n.sentiment, n.is_test, """
    + _per_label("round(n.{l}, 4) AS {l}")
    + """, p.compound
        FROM nb_shares n JOIN polar p ON n.news_id = p.news_id""",
    "blended_grid": f"""
        SELECT t, w, sentiment, w * bullish + (1 - w) * bu AS bullish,
               w * neutral + (1 - w) * (1 - bu - be) AS neutral, w * bearish + (1 - w) * be AS bearish
        FROM (SELECT *, {_POS} AS bu, {_NEG} AS be FROM member, grid WHERE is_test)""",
    "blended": f"""
        SELECT news_id, w * bullish + (1 - w) * bu AS bullish,
               w * neutral + (1 - w) * (1 - bu - be) AS neutral, w * bearish + (1 - w) * be AS bearish
        FROM (SELECT *, {_POS} AS bu, {_NEG} AS be FROM member, point)""",
    # Daily rows and sequences.
    "vectors": """
        SELECT a.news_id, a.date, a.ticker, a.cleaned_text, a.sentiment,
               coalesce(e.embedding, list_resize(CAST([] AS FLOAT[]), 64, CAST(0 AS FLOAT))) AS embedding
        FROM aligned a LEFT JOIN embeddings e ON a.news_id = e.vec_id""",
    "vector_rows": """
        SELECT news_id, date, ticker, generate_subscripts(embedding, 1) - 1 AS pos,
               CAST(unnest(embedding) AS DOUBLE) AS x
        FROM vectors""",
    "mean_rows": "SELECT date, ticker, pos, avg(x) AS x FROM vector_rows GROUP BY 1, 2, 3",
    "aligned_mode": """
        SELECT date, ticker, sentiment FROM (
            SELECT date, ticker, sentiment, row_number() OVER (
                PARTITION BY date, ticker ORDER BY count(*) DESC, sentiment) AS rn
            FROM aligned GROUP BY 1, 2, 3) WHERE rn = 1""",
    "day_rows": """
        SELECT s.ticker, s.date, s.close, row_number() OVER (PARTITION BY s.ticker ORDER BY s.date) AS n
        FROM stock s JOIN (SELECT DISTINCT ticker, date FROM aligned) a
        ON s.ticker = a.ticker AND s.date = a.date""",
    "day_features": """
        SELECT ticker, date, pos, x FROM mean_rows
        UNION ALL SELECT ticker, date, 64, open FROM stock
        UNION ALL SELECT ticker, date, 65, high FROM stock
        UNION ALL SELECT ticker, date, 66, low FROM stock
        UNION ALL SELECT ticker, date, 67, close FROM stock
        UNION ALL SELECT ticker, date, 68, volume FROM stock""",
    # Back-test.
    "signals": """
        SELECT ticker, date, min_by(prediction, news_id) AS signal FROM nb_predicted GROUP BY 1, 2""",
}


def _model(tokens: str, docs: str, prefix: str) -> dict[str, str]:
    """Count, total and weight views of Naive Bayes on phrases plus ``docs``."""
    return {
        f"{prefix}_counts": f"""
        SELECT v.token, {_per_label("count(t.label) FILTER (t.label = '{l}') AS {l}")}
        FROM vocab v LEFT JOIN (SELECT label, token FROM phrase_tokens
            UNION ALL SELECT label, token FROM {tokens}) t ON v.token = t.token GROUP BY 1""",
        f"{prefix}_totals": f"SELECT {_per_label('sum({l} + 1) AS {{l}}'.replace('{{l}}', '{l}'))} "
        f"FROM {prefix}_counts",
        f"{prefix}_docs": f"SELECT label FROM phrases UNION ALL SELECT label FROM {docs}",
    }


def _weights(prefix: str) -> str:
    return (
        "SELECT c.token, "
        + _per_label("ln(c.{l} + 1) - ln(t.{l}) AS w_{l}")
        + f" FROM {prefix}_counts c, {prefix}_totals t UNION ALL SELECT '', "
        + _per_label("ln(count(*) FILTER (label = '{l}')) - ln(count(*))")
        + f" FROM {prefix}_docs"
    )


VIEWS |= _model("train_tokens", "train", "nb")
VIEWS["nb_model"] = _weights("nb")
VIEWS["aligned_docs"] = "SELECT sentiment AS label FROM aligned"
VIEWS |= _model("all_tokens", "aligned_docs", "fit")

VIEWS |= {
    "phrase_counts": "SELECT doc_id, token, count(*) AS n FROM phrase_tokens GROUP BY 1, 2",
    "phrase_idf": """
        SELECT token, ln((1.0 + (SELECT count(*) FROM phrases)) / (1 + count(*))) + 1 AS idf
        FROM phrase_counts GROUP BY 1""",
    "phrase_raw": """
        SELECT c.doc_id, c.token, c.n * i.idf AS raw FROM phrase_counts c
        JOIN phrase_idf i ON c.token = i.token""",
    "split_phrases": """
        SELECT *, substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) < '33333333' AS is_test FROM phrases""",
    "part_counts": """
        SELECT p.doc_id, p.label, p.is_test, c.token, c.n FROM split_phrases p
        JOIN phrase_counts c ON p.doc_id = c.doc_id""",
    "part_idf": """
        SELECT token, ln((1.0 + (SELECT count(*) FROM split_phrases WHERE NOT is_test)) / (1 + count(*)))
               + 1 AS idf
        FROM part_counts WHERE NOT is_test GROUP BY 1""",
    "part_tfidf": """
        SELECT c.doc_id, c.label, c.is_test, c.token,
               c.n * i.idf / sqrt(sum(c.n * i.idf * c.n * i.idf) OVER (PARTITION BY c.doc_id)) AS x
        FROM part_counts c JOIN part_idf i ON c.token = i.token""",
    "part_sums": "SELECT token, "
    + _per_label("coalesce(sum(x) FILTER (label = '{l}'), 0) AS {l}")
    + " FROM part_tfidf WHERE NOT is_test GROUP BY 1",
    "part_totals": "SELECT " + _per_label("sum({l} + 1) AS {l}") + " FROM part_sums",
    "part_prior": "SELECT "
    + _per_label("ln(count(*) FILTER (label = '{l}')) - ln(count(*)) AS {l}")
    + " FROM split_phrases WHERE NOT is_test",
    "part_like": "SELECT x.doc_id, "
    + _per_label("sum(x.x * (ln(s.{l} + 1) - ln(t.{l}))) AS {l}")
    + " FROM part_tfidf x JOIN part_sums s ON x.token = s.token, part_totals t"
    + " WHERE x.is_test GROUP BY 1",
    "part_scores": "SELECT p.doc_id, p.label, "
    + _per_label("round(r.{l} + coalesce(k.{l}, 0), 6) AS {l}")
    + " FROM split_phrases p LEFT JOIN part_like k ON p.doc_id = k.doc_id, part_prior r"
    + " WHERE p.is_test",
    "tested": "SELECT sentiment AS y, prediction AS p FROM nb_predicted WHERE is_test",
    "per_class": """
        SELECT l.c, (SELECT count(*) FROM tested WHERE y = l.c) AS support,
               (SELECT count(*) FROM tested WHERE p = l.c) AS said,
               (SELECT count(*) FROM tested WHERE y = l.c AND p = l.c) AS hit
        FROM (VALUES ('bullish'), ('neutral'), ('bearish')) l(c)""",
    "exact_rank": """
        SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR))) AS rn,
               count(*) OVER () AS n FROM documents""",
    "strata_rank": """
        SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(doc_id AS VARCHAR)))
               AS rn, count(*) OVER (PARTITION BY label) AS n FROM phrases""",
    "mixed_news": """
        SELECT news_id, CASE WHEN news_id % 11 = 0 THEN chr(32) || chr(9)
                    WHEN news_id % 19 <> 0 THEN strftime(date, '%Y-%m-%d') END AS date,
               title, description, content, ticker, source
        FROM news""",
    "stories": """
        SELECT ticker, title, description,
               CAST(date AS TIMESTAMP) + ((news_id // 2) % 4) * INTERVAL 6 HOUR AS told_at
        FROM news WHERE source = 'tickertick'""",
    "day_sizes": """
        SELECT date, ticker, count(*) AS n_articles, CAST(sum(length(cleaned_text) + 1) - 1 AS BIGINT) AS text_length
        FROM aligned GROUP BY 1, 2""",
    "holding": """
        SELECT ticker, date, close / first_value(close) OVER (PARTITION BY ticker ORDER BY date) * 10000
               AS portfolio FROM stock_users""",
    "holding_ret": """
        SELECT ticker, date, portfolio,
               portfolio / lag(portfolio) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM holding""",
    "window_closes": """
        SELECT a.ticker, a.date AS start_date, any_value(b.close) AS target,
               max_by(d.close, d.n) AS last, avg(d.close) AS mean, min_by(d.close, d.n) AS first
        FROM day_rows a JOIN day_rows b ON a.ticker = b.ticker AND b.n = a.n + 10
        JOIN day_rows d ON d.ticker = a.ticker AND d.n BETWEEN a.n AND a.n + 9 GROUP BY 1, 2""",
    "window_errors": """
        SELECT power(target - (last + mean + first) / 3, 2) AS e,
               (row_number() OVER (ORDER BY ticker, start_date) - 1) // 32 AS batch FROM window_closes""",
    "companies": f"""
        SELECT (['click', 'error', 'purchase', 'signup', 'view'])[CAST(item_id % 5 + 1 AS INTEGER)] AS ticker,
               min(regexp_extract(lower(text), {_WORDS})) || ' ' || max(regexp_extract(lower(text), {_WORDS})) AS company
        FROM benchmark GROUP BY 1""",
    "phrase": f"""
        SELECT DISTINCT ticker, unnest(regexp_extract_all(lower(ticker || ' ' || coalesce(company, ticker)), {_WORDS})) AS token
        FROM (SELECT DISTINCT ticker FROM news) LEFT JOIN companies USING (ticker)""",
    "article_words": f"""
        SELECT news_id, ticker, regexp_extract_all(lower(concat_ws(' ', title, description)), {_WORDS}) AS w FROM news""",
    "article_counts": """
        SELECT news_id, ticker, len(w) AS length, token, count(*) AS n
        FROM (SELECT *, unnest(w) AS token FROM article_words) GROUP BY ALL""",
    "article_df": """
        SELECT token, CAST(floor(1000000 * ln(1 + (CAST((SELECT count(*) FROM news) AS DOUBLE) - count(*)
               + CAST(0.5 AS DOUBLE)) / (count(*) + CAST(0.5 AS DOUBLE)))) AS BIGINT) AS weight
        FROM article_counts GROUP BY 1""",
    "relevance": """
        SELECT c.ticker, c.news_id, CAST(sum(weight * CAST(floor(CAST(2200000 AS DOUBLE) * n / (n + CAST(1.2 AS DOUBLE)
               * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * length
                  / (SELECT CAST(sum(len(w)) AS DOUBLE) / count(*) FROM article_words)))) AS BIGINT)) AS BIGINT) AS score
        FROM article_counts c JOIN phrase p ON c.ticker = p.ticker AND c.token = p.token
        JOIN article_df f ON f.token = c.token GROUP BY 1, 2""",
    "landed": """
        SELECT news_id, date, printf('%04d', news_id % 150) AS ticker FROM news""",
    "padded": """
        SELECT lpad(ticker, 4, '0') AS ticker, date, close,
               lag(close) OVER (PARTITION BY ticker ORDER BY date) AS before FROM stock_users""",
}

_SHARES_SQL = _per_label(_r("{l}") + " AS {l}")

BODIES = {
    "stock_returns": f"SELECT ticker, date, {_r('close')} AS close, {_r('pct_change')} AS pct_change FROM users_ret",
    "index_returns": f"SELECT date, {_r('close')} AS close, {_r('pct_change')} AS pct_change FROM index_ret",
    "previous_close": f"""
        SELECT date, ticker, {_r('p')} AS previous_close FROM (
            SELECT date, ticker, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS p FROM stock_users)""",
    "sentiment_labels": "SELECT date, ticker, sentiment FROM user_labels",
    "normalized_prices": f"""
        SELECT ticker, date, {_r('close / nullif(c0, 0)')} AS stock_norm, {_r('ic / nullif(i0, 0)')} AS index_norm
        FROM (SELECT s.ticker, s.date, s.close, m.close AS ic,
                     first_value(s.close) OVER o AS c0, first_value(m.close) OVER o AS i0
              FROM stock_users s JOIN market m ON s.date = m.date
              WINDOW o AS (PARTITION BY s.ticker ORDER BY s.date))""",
    "stock_bars": f"""
        SELECT date, ticker, {_r('open')} AS open, {_r('high')} AS high, {_r('low')} AS low,
               {_r('close')} AS close, volume
        FROM stock WHERE ticker IN ('click', 'view') AND date >= DATE '2024-01-05'
        AND date < DATE '2024-01-20'""",
    "index_bars": f"""
        SELECT date, {_r('open')} AS open, {_r('high')} AS high, {_r('low')} AS low,
               {_r('close')} AS close, volume
        FROM market WHERE date >= DATE '2024-01-05' AND date < DATE '2024-01-20'""",
    "news_articles_flatten": """
        SELECT strftime(date, '%Y-%m-%d') AS date, coalesce(title, '') AS title,
               coalesce(description, '') AS description, '' AS content, ticker, source
        FROM news WHERE source = 'newsapi'""",
    "news_feed_range": """
        SELECT strftime(told_at, '%Y-%m-%d') AS date, coalesce(title, '') AS title,
               coalesce(description, '') AS description, '' AS content, ticker, 'tickertick' AS source
        FROM stories WHERE told_at >= TIMESTAMP '2024-01-05' AND told_at <= TIMESTAMP '2024-01-20'""",
    "news_union_sources": """
        SELECT news_id, date, title, description, content, ticker, source FROM mixed_news
        WHERE ticker IN ('click', 'error', 'view') AND (date IS NULL OR date LIKE '2%')""",
    "news_missing_keys": """
        SELECT ticker, date, source FROM stock, (VALUES ('newsapi'), ('tickertick')) v(source)
        EXCEPT SELECT ticker, date, source FROM news""",
    "news_top_per_ticker": f"""
        SELECT ticker, CAST(rank AS INTEGER) AS rank, news_id, {_r('CAST(score AS DOUBLE) / 1e6 / 1e6')} AS score FROM (
            SELECT ticker, news_id, score, row_number() OVER (PARTITION BY ticker ORDER BY score DESC, news_id) AS rank
            FROM relevance WHERE score > 0) WHERE rank <= 100""",
    "company_lookup": """
        SELECT ticker, company, ticker || ' OR ' || company AS search_phrase, lower(ticker) AS feed_ticker
        FROM (SELECT s_name AS ticker, CASE WHEN s_acctbal > 0 THEN n_name ELSE s_name END AS company
              FROM supplier JOIN nation ON s_nationkey = n_nationkey)""",
    "phrasebank_labels": """
        SELECT doc_id, text, label, CAST(CASE label WHEN 'bullish' THEN 0 WHEN 'neutral' THEN 1 ELSE 2 END
               AS INTEGER) AS label_index FROM phrases""",
    "clean_news": "SELECT news_id, date, ticker, cleaned_text FROM cleaned",
    "quality_report": """
        SELECT n.ticker, count(*) AS n_rows, count(*) FILTER (title IS NULL) AS n_null_title,
               count(*) FILTER (description IS NULL) AS n_null_description,
               count(*) FILTER (cleaned_text = '') AS n_dropped
        FROM news n JOIN cleaned_all c ON n.news_id = c.news_id GROUP BY 1""",
    "news_peek": "SELECT news_id, date, ticker, cleaned_text FROM cleaned ORDER BY news_id LIMIT 5",
    "align_news_labels": "SELECT date, ticker, news_id, cleaned_text, sentiment FROM aligned",
    "build_features": f"""
        SELECT a.date, a.ticker, a.news_id, a.cleaned_text, a.sentiment,
               CAST(length(a.cleaned_text) AS INTEGER) AS text_length, {_r('p.c')} AS previous_close
        FROM aligned a LEFT JOIN (SELECT ticker, date, lag(close) OVER (
            PARTITION BY ticker ORDER BY date) AS c FROM stock) p
        ON a.date = p.date AND a.ticker = p.ticker""",
    "join_date_only": """
        SELECT c.news_id, c.date, l.sentiment, count(*) AS n_pairs
        FROM cleaned c JOIN ticker_labels l ON c.date = l.date GROUP BY 1, 2, 3""",
    "sentiment_distribution": "SELECT sentiment, count(*) AS n FROM user_labels GROUP BY 1",
    "split_hash": """
        SELECT doc_id, substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) < '33333333' AS is_test FROM documents""",
    "split_exact": "SELECT doc_id, rn <= ceil(round(0.2 * n, 9)) AS is_test FROM exact_rank",
    "split_stratified": "SELECT doc_id, label, rn <= ceil(round(0.2 * n, 9)) AS is_test FROM strata_rank",
    "split_time": """
        SELECT ticker, date, (SELECT count(*) FROM stock_users u WHERE u.date > s.date)
               < 0.2 * (SELECT count(*) FROM stock_users) AS is_test FROM stock_users s""",
    "bow_counts": f"""
        SELECT news_id, token, CAST(count(*) AS INTEGER) AS n FROM (
            SELECT news_id, unnest(regexp_extract_all(lower(concat_ws(' ', title, description)), {_WORDS}))
                   AS token FROM news)
        WHERE token IN (SELECT token FROM vocab) GROUP BY 1, 2""",
    "nb_fit": "SELECT token, "
    + _per_label(_r("w_{l}") + " AS w_{l}")
    + f" FROM ({_weights('fit')})",
    "nb_predict": "SELECT news_id, sentiment, is_test, prediction FROM nb_predicted",
    "nb_proba": f"SELECT news_id, {_SHARES_SQL} FROM nb_shares",
    "tfidf": f"""
        SELECT doc_id, token, {_r('raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id))')} AS tfidf
        FROM phrase_raw""",
    "tfidf_nb": f"""
        SELECT doc_id, label, bullish, neutral, bearish, {_best(_SAME, _ALPHABETICAL)} AS prediction
        FROM part_scores""",
    "lexicon_polarity": "SELECT news_id, date, ticker, compound FROM polar",
    "lexicon_predict": "SELECT news_id, sentiment AS prediction FROM polar_label",
    "lexicon_proba": f"""
        SELECT news_id, {_r('bu')} AS bullish, {_r('1 - bu - be')} AS neutral, {_r('be')} AS bearish
        FROM (SELECT news_id, {_POS} AS bu, {_NEG} AS be FROM polar, point)""",
    "softmax_argmax": f"SELECT news_id, {_SHARES_SQL}, {_best(_SAME, _ORDER)} AS prediction FROM nb_shares",
    "blend_predict": f"SELECT news_id, {_SHARES_SQL}, {_best(_SAME, _ORDER)} AS prediction FROM blended",
    "blend_grid_search": f"""
        SELECT {_r('t')} AS pos_thresh, {_r('w')} AS weight, {_r('a')} AS accuracy FROM (
            SELECT t, w, avg(CAST(({_best(_SAME, _ORDER)}) = sentiment AS DOUBLE)) AS a
            FROM blended_grid GROUP BY 1, 2)
        ORDER BY a DESC, t, w LIMIT 1""",
    "eval_metrics": f"""
        SELECT (SELECT count(*) FROM tested) AS n,
               {_r('sum(hit) / sum(support)', 4)} AS accuracy,
               {_r('sum(support * coalesce(hit / nullif(said, 0), 0)) / sum(support)', 4)} AS precision,
               {_r('sum(support * coalesce(hit / nullif(support, 0), 0)) / sum(support)', 4)} AS recall,
               {_r('sum(support * coalesce(2 * hit / nullif(said + support, 0), 0)) / sum(support)', 4)} AS f1
        FROM per_class""",
    "confusion_matrix": "SELECT l.c AS label, "
    + _per_label("(SELECT count(*) FROM tested WHERE y = l.c AND p = '{l}') AS {l}")
    + " FROM (VALUES ('bullish'), ('neutral'), ('bearish')) l(c)",
    "embed_or_zero": f"SELECT news_id, CAST(pos AS INTEGER) AS pos, {_r('x')} AS x FROM vector_rows",
    "daily_mean_embedding": f"""
        SELECT date, ticker, CAST(pos AS INTEGER) AS pos, {_r('x')} AS x FROM mean_rows""",
    "daily_modal_sentiment": """
        SELECT date, ticker, sentiment FROM (
            SELECT date, ticker, sentiment, row_number() OVER (
                PARTITION BY date, ticker ORDER BY count(*) DESC, sentiment) AS rn
            FROM polar_label GROUP BY 1, 2, 3) WHERE rn = 1""",
    "daily_text_concat": """
        SELECT date, ticker, news_id, position, start, substr(joined, start + 1, size) AS cleaned_text FROM (
            SELECT date, ticker, unnest(ids) AS news_id, CAST(generate_subscripts(ids, 1) - 1 AS BIGINT) AS position,
                   CAST(unnest(starts) AS BIGINT) AS start, joined, unnest(sizes) AS size FROM (
                SELECT date, ticker, list(news_id ORDER BY news_id) AS ids,
                       string_agg(cleaned_text, ' ' ORDER BY news_id) AS joined,
                       list(length(cleaned_text) ORDER BY news_id) AS sizes,
                       list_transform(range(1, count(*) + 1), lambda i: coalesce(list_sum(
                           list_transform(list(length(cleaned_text) ORDER BY news_id)[1:i - 1], lambda x: x + 1)), 0)) AS starts
                FROM cleaned GROUP BY 1, 2))""",
    "aggregate_daily": f"""
        SELECT m.date, m.ticker, s.sentiment, z.n_articles, z.text_length, CAST(m.pos AS INTEGER) AS pos, {_r('m.x')} AS x
        FROM mean_rows m JOIN aligned_mode s ON m.date = s.date AND m.ticker = s.ticker
        JOIN day_sizes z ON m.date = z.date AND m.ticker = z.ticker""",
    "sequence_windows": f"""
        SELECT a.ticker, a.date AS start_date, {_r('b.close')} AS target, CAST(d.n - a.n AS INTEGER) AS step,
               CAST(f.pos AS INTEGER) AS pos, {_r('f.x')} AS x
        FROM day_rows a JOIN day_rows b ON a.ticker = b.ticker AND b.n = a.n + 10
        JOIN day_rows d ON d.ticker = a.ticker AND d.n BETWEEN a.n AND a.n + 9
        JOIN day_features f ON f.ticker = d.ticker AND f.date = d.date""",
    "first_signal_per_day": "SELECT ticker, date, signal FROM signals",
    "common_dates": """
        SELECT ticker, date FROM news INTERSECT SELECT ticker, date FROM stock""",
    "holding_value": f"SELECT ticker, date, {_r('portfolio')} AS portfolio FROM holding",
    "return_sharpe": f"""
        SELECT ticker, {_r('total_return')} AS total_return, {_r('sharpe_ratio')} AS sharpe_ratio FROM (
            SELECT ticker,
                   CASE WHEN count(*) < 2 THEN 0 ELSE max_by(portfolio, date) / 10000 - 1 END AS total_return,
                   CASE WHEN count(*) < 2 OR stddev_samp(ret) = 0 THEN 0
                        ELSE avg(ret) / stddev_samp(ret) * sqrt(252) END AS sharpe_ratio
            FROM holding_ret GROUP BY 1)""",
    "infer_pooled": f"""
        SELECT news_id, {_best({"bullish": "b", "neutral": "u", "bearish": "e"}, _ORDER)} AS sentiment, CAST(pos AS INTEGER) AS pos,
               {_r("CAST(CAST([x0, x1, x2][pos + 1] AS FLOAT) AS DOUBLE)", 5)} AS x
        FROM (SELECT news_id, avg(length(w)) AS x0, avg(unicode(w) % 7) AS x1, avg(CAST(length(w) % 2 = 0 AS INTEGER)) AS x2,
                     count(*) FILTER (length(w) % 3 = 0) AS b, count(*) FILTER (length(w) % 3 = 1) AS u,
                     count(*) FILTER (length(w) % 3 = 2) AS e
              FROM (SELECT news_id, unnest(string_split(cleaned_text, ' ')) AS w FROM cleaned) WHERE w <> '' GROUP BY 1), range(3) r(pos)""",
    "null_closes": f"""
        SELECT ticker, date, {_r("close")} AS close, {_r("CASE WHEN before = 0 THEN NULL ELSE (known / before - 1) * 100 END")} AS pct_change
        FROM (SELECT ticker, date, close, known, lag(known) OVER (PARTITION BY ticker ORDER BY date) AS before FROM (
            SELECT ticker, date, close, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date) AS known FROM (
                SELECT ticker, date, CASE WHEN day(date) % 5 <> 0 THEN close END AS close FROM stock_users)))""",
    "bars_by_ticker": f"""
        SELECT ticker, date, {_r("close")} AS close, CASE WHEN ticker = 'view' THEN 0 ELSE volume END AS volume FROM stock
        UNION ALL SELECT 'index', date, {_r("close")}, volume FROM market""",
    "phrases_from_csv": "SELECT text, label FROM phrases",
    "learned_invariants": """
        SELECT sentiment, count(*) AS n, count(*) AS n_summing_to_one, count(*) AS n_best
        FROM aligned_split WHERE is_test GROUP BY 1""",
    "forecast_fixed_members": f"""
        SELECT (SELECT count(*) FROM window_errors) AS n, {_r('(SELECT avg(e) FROM window_errors)', 4)} AS plain_mse,
               {_r('(SELECT avg(m) FROM (SELECT avg(e) AS m FROM window_errors GROUP BY batch))', 4)} AS mse""",
    "landed_training_frame": f"""
        SELECT n.date, n.ticker, c.cleaned_text, l.sentiment, CAST(length(c.cleaned_text) AS INTEGER) AS text_length,
               {_r('p.before')} AS previous_close, 'id ' || n.news_id AS content
        FROM landed n JOIN cleaned c ON n.news_id = c.news_id
        JOIN user_labels l ON n.date = l.date AND n.ticker = lpad(l.ticker, 4, '0')
        JOIN padded p ON p.date = n.date AND p.ticker = n.ticker""",
    "chart_series": f"""
        SELECT ticker || ' Close' AS series, date, {_r('close')} AS value FROM stock_users
        UNION ALL SELECT 'S&P500 Close', date, {_r('close')} FROM market""",
    "chart_markers": f"""
        SELECT l.ticker, l.sentiment, l.date, {_r('s.close')} AS close
        FROM user_labels l JOIN stock_users s ON l.ticker = s.ticker AND l.date = s.date""",
}

BODIES["blend_parameters"] = f"SELECT pos_thresh, weight FROM ({BODIES['blend_grid_search']})"
BODIES["metrics_files"] = f"""
    SELECT *, 'Model Performance:' || chr(10) || 'Accuracy: ' || printf('%.4f', accuracy) || chr(10) || 'Precision: '
           || printf('%.4f', precision) || chr(10) || 'Recall: ' || printf('%.4f', recall) || chr(10) || 'F1-Score: '
           || printf('%.4f', f1) AS lines FROM ({BODIES['eval_metrics']})"""
BODIES["training_frame"] = BODIES["build_features"]
BODIES["model_by_name"] = BODIES["nb_predict"]
BODIES["processed_files"] = BODIES["align_news_labels"]
BODIES["backtest_files"] = BODIES["return_sharpe"]
BODIES["nb_continued"] = BODIES["nb_fit"]
BODIES["aggregate_daily_merged"] = BODIES["aggregate_daily"]


def _mentioned(sql: str) -> set[str]:
    return set(re.findall(r"\w+", sql)) & set(VIEWS)


def _closure(sql: str) -> list[str]:
    """Views a statement needs, each after those it needs itself."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for other in sorted(_mentioned(VIEWS[name]) - {name}):
            visit(other)
        ordered.append(name)

    for name in sorted(_mentioned(sql)):
        visit(name)
    return ordered


def _statement(body: str) -> str:
    needed = _closure(body)
    if not needed:
        return body
    parts = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in needed)
    return f"WITH {parts}\n{body}"


ORACLES = {name: _statement(body) for name, body in BODIES.items()}
