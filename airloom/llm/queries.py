"""The registered queries of these operators, over whole tables, and the SQL that checks them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return register


SQL_INTEGER_VECTORS = """
v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE))::BIGINT FOR x IN embedding] AS e FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""


@query(f"""
WITH {SQL_INTEGER_VECTORS},
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5""")
def op1_top_search(spark: SparkSession, folder: str) -> DataFrame:
    from .top_search import top_k_products

    rows = read(spark, folder, "embeddings")
    return top_k_products(rows.where("vec_id % 50 = 0"), rows, k=5, scale=256)


@query()
def op2_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from .lm_score import score
    from .quality import held_out

    out = held_out(parts=7)
    scored = score(read(spark, folder, "documents"), ~out, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return scored.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                         "base_score", "score")


# Windows by their words; the first place of each by document, then by position.
@query(r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
p AS (SELECT k, doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS win
      FROM (SELECT k, doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM d WHERE len(w) >= 20)),
f AS (SELECT k, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS place FROM p),
g AS (SELECT DISTINCT k, unnest(generate_series(i, i + 19)) AS j FROM f WHERE place > 1),
x AS (SELECT k, list(j) AS gone FROM g GROUP BY k)
SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda v, i: NOT list_contains(gone, i)) END, ' '))
         AS kept_sha256
FROM d LEFT JOIN x USING (k)""")
def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from .substring_dedup import dedup_spans

    return dedup_spans(read(spark, folder, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@query(f"""
WITH rules(rhost, rpath, action) AS (VALUES {", ".join(map(str, URL_RULES))}),
rest AS (SELECT row_number() OVER () AS k, page_id,
                CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
u AS (SELECT k, page_id,
             translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
m AS (SELECT k, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(action, length(rhost || rpath)) AS action
      FROM u JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM u LEFT JOIN m USING (k)""")
def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    from .url_filter import filter_urls

    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return filter_urls(read(spark, folder, "pages"), rules, keep=("page_id",))


@query()
def op9_kd_shards(spark: SparkSession, folder: str) -> DataFrame:
    from .shards import kd_shards

    placed = kd_shards(read(spark, folder, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


EXTRA_CONVERSATION = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


# Length of a rendered turn: its marks, its texts, and a backslash for each mark and backslash that is escaped.
SQL_MARKS = "((length({c}) - length(replace({c}, '### ', ''))) / 4 + (length({c}) - length(replace({c}, '</turn>', ''))) / 7 + (length({c}) - length(replace({c}, ':' || chr(10), ''))) / 2)"
SQL_LEVEL = r"""CASE WHEN regexp_matches(role, '\\([\\#<:]|$)') OR regexp_matches(text, '\\([\\#<:]|$)') THEN 2
 WHEN regexp_matches(role, '### |</turn>|:\n') OR regexp_matches(text, '### |</turn>') THEN 1 ELSE 0 END"""


@query(rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
l AS (SELECT *, {SQL_LEVEL} AS level FROM t),
f AS (SELECT *, 14 + length(role) + length(text)
             + CASE WHEN level > 0 THEN {SQL_MARKS.format(c="role")} + {SQL_MARKS.format(c="text")} ELSE 0 END
             + CASE WHEN level = 2 THEN length(role || text) - length(replace(role || text, '\', '')) ELSE 0 END AS chars
      FROM l)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id""")
def op10_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    from .chat_format import format_turns, read_back

    more = spark.createDataFrame(EXTRA_CONVERSATION, "conv_id long, turn long, role string, text string")
    turns = read(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return read_back(format_turns(turns))


@query()
def op6_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from .near_dedup import classes

    return classes(read(spark, folder, "documents"))


SQL_ITEM_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"


@query(rf"""
WITH b AS (SELECT item_id, {SQL_ITEM_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)),
d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, {SQL_ITEM_WORDS} AS w FROM documents),
p AS (SELECT k, n, w, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
m AS (SELECT k, i, n, item_id FROM (SELECT k, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM p) JOIN bw USING (win, n)),
h AS (SELECT k, count(DISTINCT j) AS n_hit FROM (SELECT k, unnest(generate_series(i, i + n - 1)) AS j FROM m) GROUP BY k),
s AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT k, item_id::VARCHAR AS item FROM m) GROUP BY k)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (k) LEFT JOIN s USING (k)""")
def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    from .decontaminate import contamination

    found = contamination(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


@query()
def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from .byte_bpe import encode

    done = encode(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), extra="decoded")
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query()
def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    from . import quality as Q

    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    model = Q.train(docs, labels.where(~Q.held_out()))
    return Q.score(docs.select("doc_id", "text"), model).select(
        "doc_id", Q.held_out().alias("held_out"), "score", "predicted")


@query()
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """The stages of the corpus pipeline one after the other; its ids stay with the operator."""
    from corpus_pipeline import run

    return run(spark, folder).drop("ids")


@query()
def op11_nearest(spark: SparkSession, folder: str) -> DataFrame:
    from .cross_polytope import nearest_neighbours

    rows = read(spark, folder, "embeddings")
    return nearest_neighbours(rows.where("vec_id % 20 = 0"), rows, k=20)


@query(r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h,
                  regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t FROM documents),
u AS (SELECT *, len(t) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(t) + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (len(t) + 1) AS c2,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                       OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
                  WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT doc_id, n, form, text, array_to_string(t[1:least(c1, c2)], '') AS prefix,
             array_to_string(t[least(c1, c2) + 1:greatest(c1, c2)], '') AS middle, array_to_string(t[greatest(c1, c2) + 1:], '') AS suffix FROM u)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM p""")
def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    from .piece_table import fill_in_middle, restore

    made = fill_in_middle(read(spark, folder, "documents"))
    facts = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256")
    return restore(made, keep=facts).select(*facts, "restored_sha256")


def _sql_runs(levels: int) -> str:
    """Factors of 1, 2, 4, ... words, named by pairs; of each level the neighbouring places whose next occurrence is the
    same distance on, where the distance is above half the level's length and at most all of it."""
    out = ["l0 AS (SELECT k, i, min(i) OVER (PARTITION BY k, v) AS name FROM words QUALIFY count(*) OVER (PARTITION BY k, v) > 1)"]
    for level in range(levels):
        length = 1 << level
        out.append(f"""g{level} AS (SELECT k, min(i) AS s, max(i) + any_value(d) + {length} - min(i) AS n, any_value(d) AS q FROM (
  SELECT k, i, d, i - row_number() OVER (PARTITION BY k, d ORDER BY i) AS island FROM (
    SELECT k, i, lead(i) OVER (PARTITION BY k, name ORDER BY i) - i AS d FROM l{level}) WHERE d <= {length} AND 2 * d > {length}) GROUP BY k, d, island)""")
        if level + 1 < levels:
            out.append(f"""l{level + 1} AS (SELECT k, i, min(i) OVER (PARTITION BY k, x, y) AS name FROM (
  SELECT a.k, a.i, a.name AS x, b.name AS y FROM l{level} a JOIN l{level} b ON a.k = b.k AND b.i = a.i + {length})
  QUALIFY count(*) OVER (PARTITION BY k, x, y) > 1)""")
    every = " UNION ALL ".join(f"SELECT * FROM g{level}" for level in range(levels))
    return ",\n".join(out) + f",\nr AS MATERIALIZED (SELECT k, s, n, q FROM ({every}) WHERE n >= greatest(6, 4 * q))"



# CRC-32 of the decimal id, bit by bit.
SQL_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
  lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))))"""


@query(rf"""
WITH h AS (SELECT row_number() OVER () AS k, doc_id, {SQL_CRC32} AS h,
                  list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS o FROM documents),
a AS (SELECT *, h // 10 AS g, len(o) AS n, CASE WHEN h % 10 = 0 AND len(o) > 0 THEN (h // 10) % len(o) END AS a FROM h),
d AS MATERIALIZED (SELECT k, doc_id, n, CASE WHEN a IS NULL THEN o ELSE list_concat(o[1:a],
         list_transform(range(a, n), lambda i: o[1 + a + (i - a) % (1 + (n - a) // (3 + g % 8))])) END AS w FROM a),
words AS MATERIALIZED (SELECT k, unnest(w) AS v, generate_subscripts(w, 1) - 1 AS i FROM d),
{_sql_runs(18)},
x AS (SELECT k, count(*) AS n_runs, arg_min({{'s': s, 'n': n, 'q': q}}, (-n, s, q)) AS top,
             sha256(string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q)) AS runs_sha256 FROM r GROUP BY k),
y AS (SELECT k, list(DISTINCT j) AS gone FROM (SELECT k, unnest(range(s + q, s + n)) AS j FROM r) GROUP BY k)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top.s AS start, top.n AS length, top.q AS period, 1000 * top.n // top.q AS exponent_milli,
       coalesce(runs_sha256, sha256('')) AS runs_sha256,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda z, i: NOT list_contains(gone, i - 1)) END, ' ')) AS collapsed_sha256
FROM d LEFT JOIN x USING (k) LEFT JOIN y USING (k)""")
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    from .periodic_runs import digests, periodic_runs, with_repetition

    return digests(periodic_runs(with_repetition(read(spark, folder, "documents"))))
