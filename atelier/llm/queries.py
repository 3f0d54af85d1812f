"""The queries of the training-data operators, with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atelier.llm import annforest, decontaminate, htmltext, langid, lmscore, merkle, mixing, pseudonyms, quality, simhash, spelling, tokenstore, urlfilter
from atelier.llm.common import fresh_path, table


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def end_id() -> int:
    return 0


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), pieces_file())


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    tokenstore.write(table(spark, sf_dir, "documents"), path, tokenizer_file(), end_id=end_id())
    return tokenstore.report(spark, path)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(table(spark, sf_dir, "documents"))


#: Rules on urls, as the query's contract states them.
URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's url ends in the number of the document that the page shows, whose labels are the page's."""
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("url_key"), F.coalesce(bad, F.lit(False)).alias("bad"))
    return urlfilter.judge(table(spark, sf_dir, "pages"), labels, URL_RULES)


def op8_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymise(docs, key="atelier")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verification(merkle.manifest(table(spark, sf_dir, "documents")))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annforest.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_simhash_near_dedup,
            op2_mix_sources,
            op3_language_id,
            op4_token_store,
            op5_decontaminate,
            op6_lm_score,
            op7_url_filter,
            op8_pii_pseudonyms,
            op9_quality_rules,
            op10_html_text,
            op11_merkle_manifest,
            op12_spelling_variants,
            op13_nearest_neighbours,
        )
    }


OP2_SQL = r"""
    WITH sized AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
               ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
        FROM documents),
    totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
    numbered AS (
        SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM totals),
    caps AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS ratio FROM numbered),
    levels AS (
        SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
                   - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                  / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
        FROM caps WINDOW o AS (ORDER BY ratio, source NULLS LAST)),
    goals AS (
        SELECT source, source_size, least(cap, weight * (SELECT max(level) FROM levels WHERE level <= ratio)) AS target FROM levels),
    groups AS (
        SELECT s.source, s.h, g.target - floor(g.target / greatest(g.source_size, 1)) * g.source_size AS budget, sum(s.size) AS n
        FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source WHERE s.size > 0 GROUP BY ALL),
    running AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM groups),
    limits AS (
        SELECT source, h + CASE WHEN 2 * (budget - before) >= n THEN 1 ELSE 0 END AS lim
        FROM running WHERE before <= budget AND budget < before + n)
    SELECT s.doc_id, s.size, g.source_size, g.target,
           (s.size * least(2, floor(g.target / greatest(g.source_size, 1)) + CASE WHEN s.h < coalesce(l.lim, 0) THEN 1 ELSE 0 END))::BIGINT AS taken
    FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source LEFT JOIN limits l ON s.source IS NOT DISTINCT FROM l.source
"""

OP5_SQL = r"""
    WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
    items AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
    cut AS (SELECT item, ws, least(len(ws), 10) AS n, unnest(generate_series(1, len(ws) - least(len(ws), 10) + 1)) AS p FROM items WHERE len(ws) > 0),
    windows AS (SELECT DISTINCT n, item, array_to_string(ws[p:p + n - 1], ' ') AS w FROM cut),
    lengths AS (SELECT DISTINCT n FROM windows),
    places AS (SELECT r, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS p FROM docs, lengths WHERE len(ws) >= n),
    hits AS (SELECT a.r, a.p, a.n, w.item FROM places a JOIN windows w ON a.n = w.n AND array_to_string(a.ws[a.p:a.p + a.n - 1], ' ') = w.w),
    covered AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(generate_series(p, p + n - 1)) AS q FROM hits) GROUP BY r),
    found AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY r)
    SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(f.n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(f.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
    FROM docs d LEFT JOIN covered c USING (r) LEFT JOIN found f USING (r)
"""


#: Levels of paths that the SQL below unrolls; segments below them count as ``*``, which holds where fewer than 10 urls are deeper.
OP7_LEVELS = 6


def _op7_sql() -> str:
    """Every step of the tree as SQL: shapes, one level of templates after the other, branches apart from their parents, purity, rules."""
    level = """
    c{k} AS (SELECT host, template, segs[{k} + 1] AS seg, sum(n) AS n, sum(labelled) AS l FROM t{k} WHERE len(segs) > {k} GROUP BY ALL),
    f{k} AS (SELECT host, template, seg FROM (SELECT *, sum(n) OVER (PARTITION BY host, template) AS whole FROM c{k}) WHERE l >= 10 OR (n >= 10 AND n >= 0.01::DOUBLE * whole)),
    t{j} AS (SELECT t.host, t.segs, t.n, t.labelled, t.bad, CASE WHEN len(t.segs) > {k} THEN list_append(t.template, coalesce(f.seg, '*')) ELSE t.template END AS template
             FROM t{k} t LEFT JOIN f{k} f ON t.host = f.host AND t.template = f.template AND t.segs[{k} + 1] = f.seg),"""
    levels = "".join(level.format(k=k, j=k + 1) for k in range(OP7_LEVELS))
    fits = []
    for rule, verdict in sorted(URL_RULES, key=lambda r: -len(r[0])):
        host, _, start = rule.partition("/")
        fits.append((f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{start}')", rule, verdict))
    which = "CASE " + " ".join(f"WHEN {c} THEN '{rule}'" for c, rule, _ in fits) + " END"
    says = "CASE " + " ".join(f"WHEN {c} THEN '{verdict}'" for c, _, verdict in fits) + " END"
    return rf"""
    WITH split AS (
        SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path FROM pages),
    parsed AS (SELECT *, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: regexp_replace(x, '[0-9]+', '#', 'g')) AS segs,
                      try_cast(nullif(regexp_extract(path, '([0-9]+)[^/0-9]*/?$', 1), '') AS BIGINT) AS url_key FROM split),
    truth AS (SELECT doc_id AS url_key, bool_or(coalesce(quality = 0 OR toxic = 1, false)) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
    t0 AS (SELECT host, segs, count(*) AS n, count(bad) AS labelled, count(*) FILTER (bad) AS bad, []::VARCHAR[] AS template FROM parsed LEFT JOIN truth USING (url_key) GROUP BY host, segs),{levels}
    tree AS (SELECT host, segs, labelled, bad, list_concat(template, list_transform(range(greatest(len(segs) - {OP7_LEVELS}, 0)), lambda x: '*')) AS template FROM t{OP7_LEVELS}),
    leaves AS (SELECT host, template, sum(labelled)::BIGINT AS labelled, sum(bad)::BIGINT AS bad FROM tree GROUP BY ALL),
    nodes AS (SELECT host, template, labelled, bad, unnest(list_prepend([''], list_transform(range(len(template) + 1), lambda k: list_concat([host], template[1:k])))) AS node FROM leaves),
    sums AS (SELECT node, sum(labelled)::BIGINT AS n, sum(bad)::BIGINT AS b FROM nodes GROUP BY node),
    pairs AS (SELECT s.node, s.n, s.b, p.n AS pn, p.b AS pb, p.n - s.n AS n2, p.b - s.b AS b2, p.b / greatest(p.n, 1) AS pooled
              FROM sums s LEFT JOIN sums p ON s.node <> [''] AND p.node = CASE WHEN len(s.node) = 1 THEN [''] ELSE s.node[1:len(s.node) - 1] END),
    own AS (SELECT node, n, b FROM pairs
            WHERE node = [''] OR coalesce(n >= 30 AND n2 >= 30 AND abs(b / greatest(n, 1) - b2 / greatest(n2, 1)) > 3.29::DOUBLE * sqrt(pooled * (1 - pooled) * (1 / greatest(n, 1) + 1 / greatest(n2, 1))), false)),
    base AS (SELECT coalesce(max(b / greatest(n, 1)), 0) AS p FROM own WHERE node = ['']),
    branch AS (SELECT host, template, arg_max({{'n': own.n, 'b': own.b}}, CASE WHEN node = [''] THEN 0 ELSE len(node) END) AS s FROM nodes JOIN own USING (node) GROUP BY host, template),
    judged AS (SELECT t.host, t.segs, '/' || array_to_string(t.template, '/') AS template, (r.s.b + 20.0::DOUBLE * (SELECT p FROM base)) / (r.s.n + 20.0::DOUBLE) AS purity FROM tree t JOIN branch r USING (host, template))
    SELECT page_id, host, path, {which} AS rule, coalesce({says}, CASE WHEN purity >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict, template, purity FROM parsed JOIN judged USING (host, segs)
    """


OP7_SQL = _op7_sql()


#: Hashes, levels of both trees, siblings and the fold; CRC-32 is stepped through bit by bit, a -1 for each shift.
OP11_SQL = r"""
    WITH RECURSIVE docs AS (
        SELECT row_number() OVER () AS r, doc_id, lang, text,
               list_reduce([4294967295] || flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
                           lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END) AS crc,
               concat(coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-'), coalesce(octet_length(encode(source)) || ':' || source, '-'),
                      coalesce(octet_length(encode(lang)) || ':' || lang, '-'), coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-')) AS head
        FROM documents),
    tampered AS (
        SELECT *, CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS changed FROM docs),
    hashed AS (
        SELECT r, doc_id, coalesce('=' || lang, '') AS grp, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
               sha256(head || coalesce(octet_length(encode(changed)) || ':' || changed, '-')) AS altered FROM tampered),
    leaves AS (
        SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM hashed),
    low AS (
        SELECT 0 AS lvl, grp, idx, n, leaf AS node FROM leaves
        UNION ALL
        SELECT lvl + 1, grp, idx // 8, (n + 7) // 8, sha256(string_agg(node, '' ORDER BY idx)) FROM low WHERE n > 1 GROUP BY lvl, grp, idx // 8, n),
    subroots AS (SELECT grp, node, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1),
    high AS (
        SELECT 0 AS lvl, idx, n, node FROM subroots
        UNION ALL
        SELECT lvl + 1, idx // 8, (n + 7) // 8, sha256(string_agg(node, '' ORDER BY idx)) FROM high WHERE n > 1 GROUP BY lvl, idx // 8, n),
    steps AS (
        SELECT l.r, b.lvl, coalesce(string_agg(b.node, '' ORDER BY b.idx) FILTER (b.idx < l.idx // (8 ** b.lvl)::BIGINT), '') AS before,
               coalesce(string_agg(b.node, '' ORDER BY b.idx) FILTER (b.idx > l.idx // (8 ** b.lvl)::BIGINT), '') AS after
        FROM leaves l JOIN low b ON l.grp = b.grp AND b.n > 1 AND b.idx // 8 = l.idx // (8 ** (b.lvl + 1))::BIGINT GROUP BY l.r, b.lvl
        UNION ALL
        SELECT l.r, 1000 + b.lvl, coalesce(string_agg(b.node, '' ORDER BY b.idx) FILTER (b.idx < s.idx // (8 ** b.lvl)::BIGINT), ''),
               coalesce(string_agg(b.node, '' ORDER BY b.idx) FILTER (b.idx > s.idx // (8 ** b.lvl)::BIGINT), '')
        FROM leaves l JOIN subroots s ON l.grp = s.grp JOIN high b ON b.n > 1 AND b.idx // 8 = s.idx // (8 ** (b.lvl + 1))::BIGINT GROUP BY l.r, b.lvl),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY lvl) AS k FROM steps),
    proofs AS (SELECT r, string_agg(before || after, '' ORDER BY lvl) AS siblings FROM steps GROUP BY r),
    up AS (
        SELECT r, 0 AS k, altered AS acc FROM leaves
        UNION ALL
        SELECT u.r, s.k, sha256(s.before || u.acc || s.after) FROM up u JOIN numbered s ON s.r = u.r AND s.k = u.k + 1),
    ends AS (SELECT r, arg_max(acc, k) AS folded_root FROM up GROUP BY r),
    top AS (SELECT node AS root FROM high WHERE n = 1)
    SELECT l.doc_id, l.leaf, s.node AS subroot, root, sha256(coalesce(p.siblings, '')) AS proof_sha256, e.folded_root, e.folded_root = root AS verified
    FROM leaves l JOIN subroots s USING (grp) JOIN ends e USING (r) LEFT JOIN proofs p USING (r), top
"""


#: Near words by deletions: two words that are one replacement apart lose the same letter to become equal, one that is a letter longer becomes the other.
OP12_SQL = r"""
    WITH RECURSIVE runs AS (
        SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
        FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY ALL),
    bytes AS (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs),
    hashed AS (
        SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(0, length(x) // 2), lambda i: [('0x' || substr(x, 2 * i + 1, 2))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                   lambda c, v: CASE WHEN v >= 0 THEN xor(c, v) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) AS h FROM bytes),
    words AS (
        SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
        WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
    cut AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(0, length(word))) AS i FROM words)),
    shorter AS (SELECT DISTINCT c.word, w.word AS other FROM cut c JOIN words w ON w.word = c.rest),
    near AS (
        SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
        UNION ALL SELECT word, other FROM shorter UNION ALL SELECT other, word FROM shorter),
    best AS (SELECT p.word, count(*) AS n_near, arg_min(p.other, {'n': -w.n, 'o': p.other}) AS form, max(w.n) AS form_n FROM near p JOIN words w ON w.word = p.other GROUP BY p.word),
    forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * n THEN form END AS form, CASE WHEN form_n >= 10 * n THEN form_n END AS form_n FROM words w LEFT JOIN best USING (word)),
    walk AS (SELECT word, word AS spot, 0 AS steps FROM forms UNION ALL SELECT w.word, f.form, steps + 1 FROM walk w JOIN forms f ON f.word = w.spot WHERE f.form IS NOT NULL),
    ends AS (SELECT word, arg_max(spot, steps) AS root FROM walk GROUP BY word)
    SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""


def oracle_sql() -> dict[str, str]:
    return {"op12_spelling_variants": OP12_SQL, "op11_merkle_manifest": OP11_SQL, "op2_mix_sources": OP2_SQL, "op5_decontaminate": OP5_SQL, "op7_url_filter": OP7_SQL}
