"""DuckDB SQL of the queries, written apart from the operators."""

from __future__ import annotations

SPACED = r"string_split_regex(coalesce(text, ''), '[\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+')"
CORPUS = "c AS (SELECT source AS play_id, CAST(doc_id AS VARCHAR) AS scene_id, doc_id AS doc_ord, text FROM documents)"
TURNS = "c AS (SELECT CAST(conv_id AS VARCHAR) AS play_id, concat(conv_id, ':', turn) AS scene_id, conv_id * 100000 + turn AS doc_ord, text FROM conversations)"
TOKENS = f"""s AS (SELECT play_id, scene_id, doc_ord, list_filter({SPACED}, lambda x: x <> '') AS w FROM c),
  t AS (SELECT play_id, scene_id, doc_ord, unnest(range(len(w))) AS pos, unnest(w) AS term FROM s)"""
LINKS = """e AS (SELECT url AS src, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS dst FROM pages)"""
TRADE = """e AS (SELECT CASE WHEN l_returnflag = 'R' THEN concat('p', l_partkey) ELSE concat('s', l_suppkey) END AS src,
  CASE WHEN l_returnflag = 'R' THEN concat('s', l_suppkey) ELSE concat('p', l_partkey) END AS dst FROM lineitem)"""


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'" if not set(value) & set("\r\n") else "concat(" + ", ".join(f"chr({ord(c)})" for c in value) + ")"


def lined(heads: list[str], rest: str, before: str = "''") -> str:
    """A line for each part, one of ``heads`` in turn."""
    return f"v AS (SELECT p_partkey AS no, concat({before}, ([{', '.join(quoted(h) for h in heads)}])[p_partkey % {len(heads)} + 1], {rest}) AS value FROM part)"


def word_list(word: str) -> str:
    """Tokens of one word: its dotted beginning, then the rest."""
    head = f"regexp_extract({word}, '^(?:[^.]\\.+)+(?:[^.]$)?')"
    return f"list_filter(list_concat([replace({head}, '.', '')], string_split(substr({word}, length({head}) + 1), '.')), lambda x: x <> '')"


def tokenized(table: str, keys: str, value: str) -> str:
    """CTEs ending in tok(keys, pos, token)."""
    glue = "chr(1)"
    return f"""n AS (SELECT {keys}, string_split(regexp_replace(replace(lower(regexp_replace(regexp_replace({value}, '\\r\\n|\\r|\\n', '  ', 'g'),
      '[^a-zA-Z0-9.'']', ' ', 'g')), '''', ''), '(^| )(mrs|mr|ms)\\. ([^ ]*)', concat('\\1\\2', {glue}, '\\3'), 'g'), ' ') AS ws FROM {table}),
    o AS (SELECT {keys}, unnest(range(len(ws))) AS nr, unnest(ws) AS w FROM n),
    g AS (SELECT {keys}, nr, CASE WHEN contains(w, {glue}) THEN split_part(w, {glue}, 1) ELSE '' END AS pre,
                 CASE WHEN contains(w, {glue}) THEN split_part(w, {glue}, 2) ELSE w END AS rest FROM o),
    l AS (SELECT {keys}, nr, pre, {word_list('rest')} AS ts FROM g),
    u AS (SELECT {keys}, nr, unnest(range(len(ts))) AS i, unnest(ts) AS t, pre FROM l),
    tok AS (SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY nr, i) - 1 AS pos, CASE WHEN i = 0 THEN concat(pre, t) ELSE t END AS token FROM u)"""


def stemmed(table: str, token: str, keep: str) -> str:
    """CTEs ending in st(keep, stem)."""
    v = "[aeiou]"
    return f"""a1 AS (SELECT {keep}, {token} AS w, CASE
        WHEN {token} LIKE '%sses' THEN left({token}, length({token}) - 2)
        WHEN {token} LIKE '%ies' OR {token} LIKE '%ied' THEN CASE WHEN length({token}) > 4 THEN left({token}, length({token}) - 2) ELSE concat(left({token}, length({token}) - 2), 'e') END
        WHEN {token} LIKE '%ss' OR {token} LIKE '%us' THEN {token}
        WHEN regexp_matches({token}, '{v}.+s$') THEN left({token}, length({token}) - 1) ELSE {token} END AS a FROM {table}),
    a2 AS (SELECT *, CASE WHEN a LIKE '%eedly' THEN 3 WHEN a LIKE '%eed' THEN 1 END AS eed,
        CASE WHEN regexp_matches(a, '{v}.*ingly$') THEN 5 WHEN regexp_matches(a, '{v}.*edly$') THEN 4 WHEN regexp_matches(a, '{v}.*ing$') THEN 3
             WHEN regexp_matches(a, '{v}.*ed$') THEN 2 ELSE 0 END AS cut FROM a1),
    a3 AS (SELECT *, left(a, length(a) - cut) AS r FROM a2),
    st AS (SELECT {keep}, w AS token, CASE
        WHEN eed IS NOT NULL THEN CASE WHEN regexp_matches(a, '{v}[^aeiou].*eed(ly)?$') THEN left(a, length(a) - eed) ELSE a END
        WHEN cut = 0 THEN a
        WHEN r LIKE '%at' OR r LIKE '%bl' OR r LIKE '%iz' THEN concat(r, 'e')
        WHEN length(r) = 1 THEN ''
        WHEN r[-1] = r[-2] AND r[-1] NOT IN ('l', 's', 'z') THEN left(r, length(r) - 1)
        WHEN regexp_matches(r, '^[^aeiou]*{v}+[^aeiou]+{v}*$') THEN concat(r, 'e') ELSE r END AS stem FROM a3)"""


def boolean(queries: dict) -> str:
    q = ", ".join(f"('{n}', '{lv}', '{op.lower()}', {i}, {o}, {len(t.split())}, '{w}')" for n, (lv, op, ts) in queries.items() for i, t in enumerate(ts) for o, w in enumerate(t.split()))
    return f"""WITH {CORPUS}, {TOKENS}, q AS (SELECT * FROM (VALUES {q}) x(qname, level, op, unit_no, off, words, term)),
      f AS (SELECT qname, level, op, unit_no, words, play_id, scene_id, doc_ord, pos - off AS start, count(DISTINCT off) AS offs FROM t JOIN q USING (term) GROUP BY ALL),
      m AS (SELECT qname, op, unit_no, CASE level WHEN 'play' THEN play_id ELSE scene_id END AS unit_id, min(doc_ord) AS ord FROM f WHERE offs = words GROUP BY ALL),
      k AS (SELECT qname, count(DISTINCT unit_no) AS units FROM q GROUP BY qname),
      h AS (SELECT qname, op, unit_id, count(DISTINCT unit_no) AS have, min(ord) AS ord FROM m GROUP BY ALL)
    SELECT qname, row_number() OVER (PARTITION BY qname ORDER BY CASE op WHEN 'and' THEN ord END, unit_id) AS ord, unit_id
    FROM h JOIN k USING (qname) WHERE op = 'or' OR have = units"""


def ranked(queries: dict) -> str:
    """Term by term as in the textbook, with absent words smoothed one by one."""
    level = next(iter(queries.values()))[0]
    model = next(iter(queries.values()))[1]
    q = ", ".join(f"('{n}', {i}, '{w}')" for n, (_, _, ts) in queries.items() for i, w in enumerate(ts))
    head = f"""WITH {CORPUS}, {TOKENS}, q AS (SELECT * FROM (VALUES {q}) x(qname, qpos, term)),
      l AS (SELECT {level}_id AS unit_id, sum(len(w)) AS len FROM s GROUP BY 1),
      tf AS (SELECT term, {level}_id AS unit_id, count(*) AS tf, min(doc_ord) AS fo FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),"""
    if model == "bm25":
        body = """d AS (SELECT term, count(*) AS n FROM tf GROUP BY 1), a AS (SELECT count(*) AS total, avg(len) AS mean FROM l),
      g AS (SELECT qname, term, count(*) AS qf, min(qpos) AS qpos FROM q GROUP BY ALL),
      r AS (SELECT qname, unit_id, sum(ln((total - n + 0.5) / (n + 0.5)) * (2.8 * tf / (1.8 * (0.25 + 0.75 * len / mean) + tf)) * (6.0 * qf / (5 + qf))) AS score,
                   min({'q': qpos, 'o': fo}) AS first FROM g JOIN tf USING (term) JOIN d USING (term) JOIN l USING (unit_id), a GROUP BY ALL)"""
    else:
        body = """k AS (SELECT term, count(*) AS cf FROM t GROUP BY 1), z AS (SELECT count(*) AS total FROM t),
      cand AS (SELECT qname, unit_id, min({'q': qpos, 'o': fo}) AS first FROM q JOIN tf USING (term) GROUP BY ALL),
      r AS (SELECT qname, unit_id, sum(ln((coalesce(tf, 0) + 250.0 * cf / total) / (len + 250.0))) AS score, any_value(first) AS first
            FROM cand JOIN q USING (qname) JOIN k USING (term) LEFT JOIN tf USING (term, unit_id) JOIN l USING (unit_id), z GROUP BY ALL)"""
    return f"""{head} {body}, n AS (SELECT *, row_number() OVER (PARTITION BY qname ORDER BY round(score, 9) DESC, first, unit_id) AS rank FROM r)
    SELECT qname, unit_id, rank, round(score, 6) AS score FROM n WHERE rank <= 100"""


def pagerank(edges: str, tau: float, last: str, steps: int) -> str:
    """All iterations unrolled; the first whose change is below tau counts. L2 <= 2 * 0.8**t bounds their number."""
    chain = [f"""WITH {edges}, p AS MATERIALIZED (SELECT src AS page FROM e UNION SELECT dst FROM e), z AS MATERIALIZED (SELECT count(*) AS n FROM p),
      o AS (SELECT src, count(*) AS d FROM e GROUP BY 1), w AS MATERIALIZED (SELECT e.src, dst, count(*) / any_value(d) AS w FROM e JOIN o USING (src) GROUP BY 1, 2),
      x AS MATERIALIZED (SELECT page, page NOT IN (SELECT src FROM e) AS ends FROM p), r0 AS MATERIALIZED (SELECT page, ends, 1.0::DOUBLE / n AS rank, 0.0::DOUBLE AS d FROM x, z)"""]  # fmt: skip
    for i in range(1, steps + 1):
        chain.append(f"""g{i} AS (SELECT dst, sum(w * rank) AS got FROM w JOIN r{i - 1} ON src = page GROUP BY 1),
      m{i} AS (SELECT coalesce(sum(rank) FILTER (ends), 0) AS lost FROM r{i - 1}),
      r{i} AS MATERIALIZED (SELECT page, ends, 0.2 / n + 0.8 * coalesce(got, 0) + 0.8 * lost / n AS rank, 0.2 / n + 0.8 * coalesce(got, 0) + 0.8 * lost / n - rank AS d
             FROM r{i - 1} LEFT JOIN g{i} ON page = dst, m{i}, z)""")
    chain.append("h AS (" + " UNION ALL ".join(f"SELECT {i}::BIGINT AS iteration, sqrt(sum(d * d)) AS change FROM r{i}" for i in range(1, steps + 1)) + ")")
    chain.append(f"stop AS (SELECT min(iteration) AS t FROM h WHERE change < {tau})")
    chain.append("f AS (" + " UNION ALL ".join(f"SELECT page, rank FROM r{i} WHERE (SELECT t FROM stop) = {i}" for i in range(1, steps + 1)) + ")")
    return ", ".join(chain) + last


def evaluation(ranked_sql: str, qids: list[str], last: str) -> str:
    names = ", ".join(f"('{q}')" for q in [*qids, "never_run"])
    return f"""WITH run AS ({ranked_sql}), j AS (SELECT qid, CAST(doc_id AS VARCHAR) AS doc_id, CAST(quality * 2 - toxic AS DOUBLE) AS rel FROM labels, (VALUES {names}) x(qid)),
      tot AS (SELECT qid, count(*) AS judged, CAST(sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) AS BIGINT) AS relevant FROM j GROUP BY 1),
      i0 AS (SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC) AS k FROM j),
      i AS (SELECT qid, sum(CASE k WHEN 1 THEN rel ELSE rel / log2(k) END) AS idcg FROM i0 WHERE k <= 75 GROUP BY 1),
      b AS (SELECT qname AS qid, rank, coalesce(rel, 0) AS rel FROM run LEFT JOIN j ON qname = qid AND unit_id = doc_id),
      c AS (SELECT *, sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY qid ORDER BY rank) AS hits FROM b),
      m AS (SELECT qid, sum(CASE WHEN rank > 75 THEN 0 WHEN rank = 1 THEN rel ELSE rel / log2(rank) END) AS dcg,
              coalesce(1.0 / min(rank) FILTER (rel > 0), 0.0) AS rr, count(*) FILTER (rel > 0 AND rank <= 15) / 15.0 AS p15,
              count(*) FILTER (rel > 0 AND rank <= 20) AS h20, count(*) FILTER (rel > 0 AND rank <= 25) AS h25, coalesce(sum(hits / rank) FILTER (rel > 0), 0) AS ps FROM c GROUP BY 1),
      q AS (SELECT qid, CASE idcg WHEN 0 THEN 0 ELSE dcg / idcg END AS ndcg75, CAST(rr AS DOUBLE) AS rr, CAST(p15 AS DOUBLE) AS p15, h20 / relevant AS r20,
              CASE h25 WHEN 0 THEN 0 ELSE 2.0 * h25 / (25 + relevant) END AS f1_25, ps / relevant AS ap FROM m JOIN tot USING (qid) JOIN i USING (qid) WHERE relevant > 0)
    {last}"""


def sql(booleans: dict, ranks: dict, lines: list[str], honorifics: list[str], words: list[str], stopwords: list[str]) -> dict[str, str]:
    docs = tokenized("documents", "doc_id", "coalesce(text, '')")
    stop = "token NOT IN (" + ", ".join(f"'{w}'" for w in stopwords) + ")"
    stems = f"WITH {docs}, kept AS (SELECT * FROM tok WHERE {stop}), {stemmed('kept', 'token', 'doc_id, pos')}"
    each = lambda c, t: f"""SELECT d.doc_id, coalesce(n, 0) AS n, coalesce(different, 0) AS different, coalesce(digest, md5('')) AS digest FROM documents d LEFT JOIN
        (SELECT doc_id, count(*) AS n, count(DISTINCT {c}) AS different, md5(string_agg({c}, ' ' ORDER BY pos)) AS digest FROM {t} GROUP BY doc_id) x ON x.doc_id = d.doc_id"""  # noqa: E731
    listed = lambda v, rest: f"WITH {lined(v, rest)}, {tokenized('v', 'no, value', 'value')} SELECT v.no, v.value, coalesce(string_agg(token, ' ' ORDER BY pos), '') AS tokens FROM v LEFT JOIN tok ON v.no = tok.no GROUP BY ALL"
    base = f"WITH {CORPUS}, {TOKENS}"
    level = lambda name, key: f"SELECT '{name}' AS level, count(*) AS n_units, CAST(sum(n) AS BIGINT) AS total_terms, avg(n) AS avdl FROM (SELECT {key}, sum(len(w)) AS n FROM s GROUP BY 1)"
    stats = f"{level('scene', 'scene_id')} UNION ALL {level('play', 'play_id')}"
    trace = " SELECT iteration, round(change, 9) AS change FROM h WHERE iteration <= (SELECT t FROM stop)"
    run = ranked(ranks["bm25_scene"]).replace("round(score, 6)", "score")
    found = {
        "tok_tokens": f"WITH {docs} {each('token', 'tok')}",
        "tok_stopped": f"WITH {docs}, kept AS (SELECT * FROM tok WHERE {stop}) {each('token', 'kept')}",
        "tok_stems": f"{stems} {each('stem', 'st')}",
        "tok_words_literal": listed(lines, "' ', p_name, '''s $', CAST(p_retailprice AS DECIMAL(12, 2))"),
        "tok_honorific_literal": listed(honorifics, "' ', p_name, chr(13), chr(10), 'Ms. ', p_brand"),
        "tok_stem_literal": f"WITH {lined(words, chr(39) * 2, before="split_part(p_name, ' ', 1)")}, {stemmed('v', 'value', 'no')} SELECT no, token AS value, stem FROM st",
        "top_terms": f"{stems} SELECT term, cnt FROM (SELECT stem AS term, count(*) AS cnt, min({{'d': doc_id, 'p': pos}}) AS f FROM st GROUP BY 1 ORDER BY cnt DESC, f LIMIT 300)",
        "vocab_growth": f"""{stems}, f AS (SELECT doc_id, row_number() OVER (PARTITION BY stem ORDER BY doc_id, pos) AS k FROM st),
            d AS (SELECT doc_id, count(*) AS n, count(*) FILTER (k = 1) AS m FROM f GROUP BY 1)
            SELECT doc_id, CAST(sum(n) OVER (ORDER BY doc_id) AS BIGINT) AS word_count, CAST(sum(m) OVER (ORDER BY doc_id) AS BIGINT) AS unique_count FROM d""",
        "postings": f"{base} SELECT term, play_id, scene_id, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM t GROUP BY term, play_id, scene_id",
        "postings_merged": f"{base} SELECT term, play_id, scene_id, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM t GROUP BY term, play_id, scene_id",
        "unit_tf": f"{base} SELECT term, play_id AS unit_id, count(*) AS tf, min(doc_ord) AS first_ord FROM t GROUP BY 1, 2",
        "doc_lengths": f"{base} SELECT scene_id AS unit_id, CAST(sum(len(w)) AS BIGINT) AS len FROM s GROUP BY 1",
        "group_lengths": f"{base} SELECT play_id AS unit_id, CAST(sum(len(w)) AS BIGINT) AS len FROM s GROUP BY 1",
        "collection_freq": f"{base} SELECT term, count(*) AS cf FROM t GROUP BY 1",
        "doc_freq": f"{base} SELECT term, count(DISTINCT scene_id) AS n FROM t GROUP BY 1",
        "corpus_stats": f"{base} {stats}",
        "turn_stats": f"WITH {TURNS}, {TOKENS} {stats}",
        "link_nodes": f"WITH {LINKS} SELECT src AS page FROM e UNION SELECT dst FROM e",
        "out_degree": f"WITH {LINKS} SELECT src AS page, count(*) AS cnt FROM e GROUP BY 1",
        "top_inlinks": f"WITH {LINKS}, d AS (SELECT dst AS page, count(*) AS cnt FROM e GROUP BY 1) SELECT page, row_number() OVER (ORDER BY cnt DESC, page) AS rank, cnt FROM d ORDER BY 2 LIMIT 100",
        "dangling_pages": f"WITH {LINKS} SELECT DISTINCT dst AS page FROM e WHERE dst NOT IN (SELECT src FROM e)",
        "pagerank_pages": pagerank(LINKS, 0.005, " SELECT page, round(rank, 9) AS rank FROM f", 27),
        "pagerank_multigraph": pagerank(TRADE, 1e-3, " SELECT page, round(rank, 9) AS rank FROM f", 35),
        "pagerank_top": pagerank(TRADE, 1e-3, ", b AS (SELECT page, round(rank, 9) AS score FROM f) SELECT page, row_number() OVER (ORDER BY score DESC, page) AS rank, score FROM b ORDER BY 2 LIMIT 100", 35),
        "pagerank_trace": pagerank(TRADE, 1e-3, trace, 35),
        "eval_per_query": evaluation(run, list(ranks["bm25_scene"]), "SELECT * FROM q"),
        "eval_summary": evaluation(run, list(ranks["bm25_scene"]), "SELECT count(*) AS queries, avg(ndcg75) AS ndcg75, avg(rr) AS rr, avg(p15) AS p15, avg(r20) AS r20, avg(f1_25) AS f1_25, avg(ap) AS ap FROM q"),
        "eval_ideal": evaluation(run, list(ranks["bm25_scene"]), "SELECT qid, idcg FROM i"),
        "qrels_totals": evaluation(run, list(ranks["bm25_scene"]), "SELECT qid, judged, relevant FROM tot"),
    }
    return found | {n: boolean(q) for n, q in booleans.items()} | {n: ranked(q) for n, q in ranks.items()}
