"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express.

Each applies one operator, with the parameters used in production, to its whole table and
derives the columns that are compared from the operator's own result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import (bm25, bpe, chat_format, decontaminate, filter_audit, jaccard_join, k2treap, language_id, license_scan,
               line_dedup, simhash, substring_dedup, url_filter)
from .common import table

#: (host, path, action); fixed values of the query's contract.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def joined(c: str):
    return F.array_join(F.col(c), ",")


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    got = license_scan.scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return got.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined("base_labels").alias("base_labels"),
                      joined("labels").alias("labels"), "score")


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.deduplicated(docs).select("doc_id", "n_sentences", "n_removed", "text")


def op3_chat_format(spark, sf_dir: str) -> DataFrame:
    return chat_format.collapsed(table(spark, sf_dir, "conversations"))


def op4_bm25_topk(spark, sf_dir: str) -> DataFrame:
    return bm25.search(table(spark, sf_dir, "documents"))


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    rule = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(a).alias("action")) for h, p, a in URL_RULES]
    rules = spark.range(1).select(F.inline(F.array(*rule)))
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", language_id.is_held_out("doc_id"))
    model = language_id.train(docs.filter("NOT held_out"))
    return language_id.labelled(docs, model, keep=["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score")


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = line_dedup.deduplicated(docs)
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    vocab = bpe.Vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = bpe.encoded(table(spark, sf_dir, "documents"), vocab, keep=["doc_id"])
    ids = ids.withColumn("ids_sha256", F.sha2("ids", 256))
    got = bpe.decoded(ids, vocab, keep=["doc_id", "n_tokens", "ids_sha256"])
    return got.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    got = decontaminate.annotate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return got.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
                      F.sha2(joined("item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicate_groups(table(spark, sf_dir, "documents"))


def op11_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_groups(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_k2treap_topk(spark, sf_dir: str) -> DataFrame:
    return k2treap.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_license_scan, op2_substring_dedup, op3_chat_format, op4_bm25_topk, op5_url_filter, op6_language_id,
    op7_line_dedup, op8_byte_bpe, op9_decontaminate, op10_jaccard_join, op11_simhash_dedup, op12_filter_audit,
    op13_k2treap_topk)}

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM_WORDS = "regexp_extract_all(" + _LOW + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED_WORDS = "regexp_extract_all(" + _LOW + r", '[^\x20\x09-\x0D]+')"

ORACLE = {
    "op3_chat_format": r"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
           FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
c AS (SELECT conv_id, list({'r': role, 'x': text} ORDER BY turn, role, text) AS turns, count(*) AS n FROM t GROUP BY conv_id),
whole AS (SELECT turns, n, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY turns, n),
inner_part AS (SELECT DISTINCT turns[1:k] AS turns FROM c, range(1, c.n) r(k)),
kept AS (SELECT w.* FROM whole w ANTI JOIN inner_part i ON w.turns = i.turns)
SELECT conv_id, n AS n_turns, n_copies,
       array_to_string(list_transform(turns, lambda x: '<|im_start|>' || x.r || chr(10) || x.x || '<|im_end|>' || chr(10)), '') AS text
FROM kept""",
    "op5_url_filter": r"""
WITH rules(h, p, action) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                                    ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rest),
numbered AS (SELECT row_number() OVER () AS id, * FROM parts),
fits AS (SELECT n.id, rules.h || rules.p AS rule, action,
                row_number() OVER (PARTITION BY n.id ORDER BY length(rules.h) + length(rules.p) DESC, length(rules.h) DESC) AS i
         FROM numbered n JOIN rules ON (n.host = rules.h OR ends_with(n.host, '.' || rules.h)) AND starts_with(n.path, rules.p))
SELECT page_id, coalesce(host, '') AS host, path, rule, coalesce(action, 'allow') AS verdict
FROM numbered n LEFT JOIN fits f ON n.id = f.id AND f.i = 1""",
    "op7_line_dedup": r"""
WITH l AS (SELECT doc_id, line, i, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
           FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                        generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
hot AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE hot.keeper IS NOT NULL AND hot.keeper <> l.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE hot.keeper IS NULL OR hot.keeper = l.doc_id), '')) AS kept_sha256
FROM l LEFT JOIN hot ON l.k = hot.k GROUP BY l.doc_id""",
    "op9_decontaminate": rf"""
WITH b AS (SELECT cast(item_id AS VARCHAR) AS item, {_ALNUM_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
       FROM b, range(1, greatest(len(w) - 10, 0) + 2) r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT m FROM bw),
d AS (SELECT doc_id, {_ALNUM_WORDS.format("coalesce(text, '')")} AS w FROM documents),
dw AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS win FROM d, sizes, range(1, len(d.w) - sizes.m + 2) r(i)
       WHERE len(d.w) >= sizes.m),
hits AS (SELECT dw.doc_id, dw.i, dw.m, bw.item FROM dw JOIN bw ON dw.win = bw.win AND dw.m = bw.m),
hit_words AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS x FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
       sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words h USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op10_jaccard_join": rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPACED_WORDS.format("coalesce(text, '')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g
      FROM d, range(1, greatest(len(w) - 5, 0) + 2) r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON r.other = l.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(other) FROM reach r WHERE r.doc_id = d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id)""",
    "op12_filter_audit": r"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
lab AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
        FROM labels GROUP BY doc_id),
f AS (SELECT id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             [f.x FOR f IN [{'x': 'A', 'y': len(words) < 200}, {'x': 'B', 'y': 100 * len(list_distinct(words)) < 50 * len(words)},
                            {'x': 'C', 'y': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t)},
                            {'x': 'D', 'y': regexp_matches(t, '[#$%&*|]')}, {'x': 'E', 'y': w.doc_id > least}] IF f.y] AS fails
      FROM w LEFT JOIN lab ON w.doc_id = lab.doc_id),
l(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
           WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
fate AS (SELECT f.*, filter_order, list_min([instr(filter_order, x) FOR x IN fails]) AS gone_at FROM f, orders),
steps AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS x
          FROM (SELECT DISTINCT part FROM f), orders, range(1, 6) r(step)),
c AS (SELECT s.part, s.filter_order, s.step, s.x,
             count(*) FILTER (WHERE gone_at IS NULL OR gone_at > s.step) AS kept,
             count(*) FILTER (WHERE gone_at = s.step) AS removed,
             count(*) FILTER (WHERE list_contains(fails, s.x) AND gone_at < s.step) AS redundant,
             count(*) FILTER (WHERE fails = [s.x]) AS unique_fails,
             count(*) FILTER (WHERE gone_at = s.step AND good = 1) AS good_lost,
             count(*) FILTER (WHERE gone_at = s.step AND toxic = 1) AS toxic_lost
      FROM steps s JOIN fate ON s.part = fate.part AND s.filter_order = fate.filter_order GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       cast(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM c""",
    "op13_k2treap_topk": rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, {_ALNUM_WORDS.format("coalesce(text, '')")} AS w FROM documents),
tf AS (SELECT id, doc_id, term, count(*) AS tf FROM (SELECT id, doc_id, unnest(w) AS term FROM d) GROUP BY ALL),
n AS (SELECT id, cast(sum(tf) AS BIGINT) AS n FROM tf GROUP BY id),
whole AS (SELECT count(*) AS docs, cast(sum(n) AS BIGINT) AS terms FROM n),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
weight AS (SELECT term, cast(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, whole),
length AS (SELECT id, 50 + (50 * n * docs) // terms AS m FROM n, whole),
q AS (SELECT DISTINCT item_id, unnest({_ALNUM_WORDS.format("coalesce(text, '')")}) AS term FROM benchmark),
score AS (SELECT q.item_id, tf.id, tf.doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
          FROM q JOIN tf USING (term) JOIN weight USING (term) JOIN length USING (id) GROUP BY ALL),
ranked AS (SELECT item_id, cast(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank,
                  doc_id, score FROM score WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 50""",
}
