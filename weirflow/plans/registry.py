"""The registered queries of the engine's own operators and their SQL.

Each runs over its whole tables. Where SQL is too slow on whole tables, or cannot express
the operator, there is none, and tests hold it against brute force.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirflow.functions import quality as Q
from weirflow.functions import text as T
from weirflow.functions import tokenizer
from weirflow.functions import vectors as V
from weirflow.operators import acquire, dedup, metrics, order, sample, tokens, vector
from weirflow.session import new_folder
from weirflow.sources import jsonl, tokenbin

#: The public tokenizer of the queries.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# --- SQL pieces -------------------------------------------------------------------------


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _rr(x: str, rules) -> str:
    for pattern, new in rules:
        x = f"regexp_replace({x}, {_lit(pattern)}, {_lit(new)}, 'g')"
    return x


def _sql_space(x: str) -> str:
    return f"trim(regexp_replace({x}, {_lit('[' + T.WS + ']+')}, ' ', 'g'))"


def _sql_strip(x: str) -> str:
    return _rr(x, [(f"^[{T.WS}]+|[{T.WS}]+$", "")])


def _sql_html(x: str) -> str:
    x = _rr(f"coalesce({x}, '')", T.TAGS)
    for old, new in T.ENTITIES:
        x = f"replace({x}, {_lit(old)}, {_lit(new)})"
    return _sql_space(_rr(x, T.OTHER_ENTITIES))


def _sql_urls(x: str) -> str:
    return _sql_space(_rr(f"coalesce({x}, '')", [(T.URLS, ""), (T.EMAIL, ""), *((p, "") for p in T.ADS)]))


def _sql_text(x: str, least: int, most: int) -> str:
    inner = _rr(_sql_strip(_rr(f"nfc_normalize(coalesce({x}, ''))", [(T.CONTROLS, ""), (r"[\t\n\r\f\x0b]+", "\n"), (" +", " ")])), T.REPEATS)
    return f"(SELECT CASE WHEN length(v) BETWEEN {least} AND {most} THEN v ELSE '' END FROM (SELECT {inner} AS v))"


def _sql_key(x: str) -> str:
    return f"md5(lower({_sql_strip(f'coalesce({x}, {chr(39)*2})')}))"




def _filled(x: str) -> str:
    return f"regexp_replace({x}, {_lit('[' + T.WS + ']+')}, '', 'g') <> ''"


_META = "CASE WHEN json_valid(meta) THEN coalesce(json_extract_string(meta, '$.{}'), '') ELSE '' END"
_DOCS = "(SELECT doc_id, text, coalesce(lang, 'none') AS lang, source FROM documents)"


# --- acquiring and cleaning -------------------------------------------------------------


@query(f"SELECT row_no, md5({_sql_html('raw_content')}) AS h, length({_sql_html('raw_content')})::INTEGER AS n FROM raw_en")
def html_clean(spark, d):
    c = T.clean_html(F.col("raw_content"))
    return _read(spark, d, "raw_en").select("row_no", F.md5(c).alias("h"), F.length(c).alias("n"))


@query(f"SELECT row_no, md5({_sql_urls('text')}) AS h, length({_sql_urls('text')})::INTEGER AS n FROM raw_zh")
def url_ad_clean(spark, d):
    c = T.clean_urls(F.col("text"))
    return _read(spark, d, "raw_zh").select("row_no", F.md5(c).alias("h"), F.length(c).alias("n"))


@query(f"SELECT doc_id, md5(v) AS h, length(v)::INTEGER AS n FROM (SELECT doc_id, {_sql_text('text', 100, 100000)} AS v FROM documents)")
def text_normalize(spark, d):
    c = T.clean_text(F.col("text"))
    return _read(spark, d, "documents").select("doc_id", c.alias("v")).select("doc_id", F.md5("v").alias("h"), F.length("v").alias("n"))


@query(f"""SELECT row_no, {_META.format('url')} AS source, length(coalesce(raw_content, ''))::INTEGER AS n FROM raw_en
WHERE {_META.format('language')} = 'en' AND {_filled("coalesce(raw_content, '')")}""")
def acquire_english(spark, d):
    return acquire.acquire_english(_read(spark, d, "raw_en")).select("row_no", "source", F.length("text").alias("n"))


@query(f"""SELECT count(*)::BIGINT AS records, count(*) FILTER ({_META.format('language')} = 'en')::BIGINT AS english,
 count(*) FILTER ({_META.format('language')} = 'en' AND {_filled("coalesce(raw_content, '')")})::BIGINT AS kept,
 count(*) FILTER ({_META.format('language')} <> 'en')::BIGINT AS skipped FROM raw_en""")
def language_gate(spark, d):
    return acquire.gate_counts(_read(spark, d, "raw_en"))


_CLEANED = f"""SELECT row_no, source, lang, {_sql_text(_sql_urls(_sql_html('text')), 10, 100000)} AS text FROM (
 SELECT row_no, coalesce(text, '') AS text, coalesce(source, 'chinese') AS source, 'chinese' AS lang FROM raw_zh WHERE {_filled("coalesce(text, '')")}
 UNION ALL SELECT row_no, coalesce(raw_content, '') AS text, {_META.format('url')} AS source, 'english' AS lang FROM raw_en WHERE {_META.format('language')} = 'en' AND {_filled("coalesce(raw_content, '')")})"""


def _cleaned(spark, d) -> DataFrame:
    docs = acquire.acquire_chinese(_read(spark, d, "raw_zh")).unionByName(acquire.acquire_english(_read(spark, d, "raw_en")))
    return T.once(docs, "text", T.clean_all(F.col("text"))).where(Q.not_blank(F.col("text")))


@query(f"SELECT lang, row_no, md5(text) AS h FROM ({_CLEANED}) WHERE {_filled('text')}")
def clean_chain(spark, d):
    return _cleaned(spark, d).select("lang", "row_no", F.md5("text").alias("h"))


@query(f"""SELECT lang, count(*)::BIGINT AS docs, sum(length(text))::BIGINT AS chars, sum(length(text) // 4)::BIGINT AS tokens FROM (
 SELECT lang, text, row_number() OVER (PARTITION BY lang, {_sql_key('text')} ORDER BY row_no, source) AS rn FROM ({_CLEANED}) WHERE {_filled('text')}) WHERE rn = 1 GROUP BY lang""")
def clean_dedup_stats(spark, d):
    kept = dedup.exact_dedup(_cleaned(spark, d), "text", "row_no", ("lang",))
    return kept.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.length("text")).cast("bigint").alias("chars"), F.sum(T.estimate_tokens(F.col("text"))).cast("bigint").alias("tokens"))


# --- quality ----------------------------------------------------------------------------


def _sql_share(x: str, pattern: str) -> str:
    return f"(CASE WHEN coalesce(length({x}), 0) > 0 THEN len(regexp_extract_all({x}, {_lit(pattern)})) / length({x})::DOUBLE ELSE 0.0 END)"


_GARBAGE = f"""(length(text) < 10 OR 1 - {_sql_share('text', Q.UNPRINTABLE)} < 0.8
 OR (length(text) - length(replace(text, chr(10), '')) + 1 > 100 AND length(text) / (length(text) - length(replace(text, chr(10), '')) + 1) < 20)
 OR len(list_distinct(string_split(lower(text), ''))) < 10)"""


@query(f"""SELECT doc_id, round({_sql_share('text', Q.CHINESE)}, 9) AS zh, round({_sql_share('text', Q.ENGLISH)}, 9) AS en, round({_sql_share('text', Q.PUNCT)}, 9) AS punct, round({_sql_share('text', Q.DIGIT)}, 9) AS digit FROM documents""")
def quality_stats(spark, d):
    c = F.col("text")
    return _read(spark, d, "documents").select("doc_id", *[F.round(Q.share(c, p), 9).alias(n) for n, p in (("zh", Q.CHINESE), ("en", Q.ENGLISH), ("punct", Q.PUNCT), ("digit", Q.DIGIT))])


def _sql_keeps(pattern: str, least: float) -> str:
    return f"coalesce({_sql_share('text', pattern)} >= {least}::DOUBLE AND {_sql_share('text', Q.PUNCT)} <= 0.5 AND {_sql_share('text', Q.DIGIT)} <= 0.5 AND NOT {_GARBAGE}, false)"


@query(f"SELECT doc_id, {_sql_keeps(Q.CHINESE, 0.3)} AS chinese, {_sql_keeps(Q.ENGLISH, 0.5)} AS english FROM documents")
def quality_filter(spark, d):
    k = T.once(_read(spark, d, "documents").select("doc_id", "text"), "k", Q.counts(F.col("text")))
    return k.select("doc_id", Q.keeps_of(F.col("k"), "chinese").alias("chinese"), Q.keeps_of(F.col("k"), "english").alias("english"))


@query(f"""SELECT doc_id, CASE WHEN zh > en THEN 'chinese' WHEN en > zh THEN 'english' ELSE 'mixed' END AS detected FROM (
 SELECT doc_id, len(regexp_extract_all(text, {_lit(Q.CHINESE)})) AS zh, len(regexp_extract_all(text, {_lit(Q.ENGLISH)})) AS en FROM documents)""")
def lang_detect(spark, d):
    return _read(spark, d, "documents").select("doc_id", Q.detect(F.col("text")).alias("detected"))


@query("""SELECT doc_id, coalesce(length(text) BETWEEN 100 AND 100000 AND length(text) - length(replace(text, chr(10), '')) <= length(text) / 10, false) AS valid FROM documents""")
def text_valid(spark, d):
    return _read(spark, d, "documents").select("doc_id", Q.is_valid(F.col("text")).alias("valid"))


# --- duplicates -------------------------------------------------------------------------


@query(f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {_sql_key('text')}")
def exact_dedup(spark, d):
    return dedup.exact_dedup(_read(spark, d, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id")


@query(f"""SELECT source, sum(n)::BIGINT AS total, count(*)::BIGINT AS uniq, (sum(n) - count(*))::BIGINT AS duplicates, (sum(n) - count(*)) / sum(n)::DOUBLE AS ratio
 FROM (SELECT source, {_sql_key('text')} AS h, count(*) AS n FROM documents GROUP BY source, h) GROUP BY source""")
def dedup_stats(spark, d):
    return dedup.dedup_stats(_read(spark, d, "documents"), "text", ("source",))


@query(f"""SELECT rec_id FROM split_docs WHERE split <> 'train' AND {_sql_key('text')} NOT IN (SELECT {_sql_key('text')} FROM split_docs WHERE split = 'train')""")
def unseen_texts(spark, d):
    docs = _read(spark, d, "split_docs")
    return dedup.unseen(docs.where("split <> 'train'"), docs.where("split = 'train'"), "text").select("rec_id")


@query()
def near_duplicates(spark, d):
    return dedup.near_duplicates(_read(spark, d, "documents"), "doc_id", "text")


@query()
def near_dedup_first(spark, d):
    return dedup.near_dedup_first(_read(spark, d, "documents"), "doc_id", "text")


@query(f"""SELECT doc_id, count(DISTINCT s)::INTEGER AS shingles FROM (SELECT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_sort(list_distinct(w[i:i + 4])), ' '))) AS s FROM (
 SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[{T.WS}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL) WHERE len(w) >= 5) GROUP BY doc_id""")
def shingle_counts(spark, d):
    s = _read(spark, d, "documents").select("doc_id", dedup.shingles(F.lower(F.col("text"))).alias("s"))
    return s.where(F.size("s") > 0).select("doc_id", F.size("s").alias("shingles"))


# --- budgets, splits, interleaving ------------------------------------------------------


@query("""SELECT lang, count(*)::BIGINT AS docs, sum(n)::BIGINT AS tokens, max(doc_id) AS last FROM (
 SELECT lang, doc_id, n, sum(n) OVER (PARTITION BY lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS run FROM (
  SELECT lang, doc_id, coalesce(length(text) // 4, 0) AS n FROM documents WHERE lang IN ('chinese', 'english', 'german')))
 WHERE run <= CASE lang WHEN 'chinese' THEN 30000 WHEN 'english' THEN 40000 ELSE 5000 END GROUP BY lang""")
def token_budget_take(spark, d):
    taken = sample.budget_take(_read(spark, d, "documents"), {"chinese": 30_000, "english": 40_000, "german": 5_000}, F.coalesce(T.estimate_tokens(F.col("text")), F.lit(0)))
    return taken.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").cast("bigint").alias("tokens"), F.max("doc_id").alias("last"))


_ORDERED = f"SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id::VARCHAR), doc_id) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM {_DOCS}"


def _sql_split(second: str) -> str:
    return f"CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN rn <= {second} THEN 'val' ELSE 'test' END"


_CUMULATIVE = _sql_split("floor(n * (0.8::DOUBLE + 0.1::DOUBLE))")


def _documents(spark, d) -> DataFrame:
    return _read(spark, d, "documents").withColumn("lang", F.coalesce("lang", F.lit("none")))


@query(f"SELECT doc_id, lang, {_CUMULATIVE} AS split FROM ({_ORDERED})")
def split_exact(spark, d):
    return sample.exact_split(_documents(spark, d), ["lang"], "doc_id").select("doc_id", "lang", "split")


@query(f"SELECT doc_id, lang, {_sql_split('floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE)')} AS split FROM ({_ORDERED})")
def split_separate(spark, d):
    return sample.exact_split(_documents(spark, d), ["lang"], "doc_id", boundary="separate").select("doc_id", "lang", "split")


@query(f"SELECT lang, split, count(*)::BIGINT AS docs FROM (SELECT lang, {_CUMULATIVE} AS split FROM ({_ORDERED})) GROUP BY ROLLUP (lang, split)")
def split_rollup(spark, d):
    return sample.split_totals(sample.exact_split(_documents(spark, d), ["lang"], "doc_id"))


@query("""SELECT doc_id, round, row_number() OVER (PARTITION BY round ORDER BY md5('42:' || doc_id::VARCHAR), doc_id)::INTEGER AS place FROM (SELECT doc_id, floor((rn - 1) / CASE WHEN zh THEN 6 ELSE 4 END)::BIGINT AS round FROM (
 SELECT doc_id, zh, row_number() OVER (PARTITION BY zh ORDER BY md5('42:' || doc_id::VARCHAR), doc_id) AS rn FROM (SELECT doc_id, coalesce(lang, '') = 'chinese' AS zh FROM documents)))""")
def interleave_rounds(spark, d):
    docs = _read(spark, d, "documents")
    return sample.interleave(docs.select("doc_id", "lang"), F.coalesce(F.col("lang"), F.lit("")) == "chinese", "doc_id").select("doc_id", "round", F.row_number().over(Window.partitionBy("round").orderBy("shuffle", "doc_id")).alias("place"))


@query("""SELECT doc_id, place, worker, batch FROM (SELECT doc_id, place, CASE WHEN n // 7 = 0 THEN 6 ELSE least((place - 1) // (n // 7), 6) END::INTEGER AS worker, ((place - 1) // 16)::BIGINT AS batch, n FROM (
 SELECT doc_id, row_number() OVER (ORDER BY md5('45:' || doc_id::VARCHAR), doc_id)::BIGINT AS place, count(*) OVER () AS n FROM documents)) WHERE batch < n // 16""")
def epoch_shards_batches(spark, d):
    placed = sample.epoch_order(_read(spark, d, "documents").select("doc_id"), "doc_id", epoch=3)
    return sample.batches(sample.worker_shards(placed, 7), 16).select("doc_id", "place", "worker", "batch")


@query("""SELECT event_type, arg_max(event_id, score) AS event_id FROM (SELECT event_type, event_id, value / 0.6::DOUBLE - ln(-ln((('0x' || substr(md5('42:' || event_type || ':' || event_id::VARCHAR), 1, 12))::BIGINT + 0.5) / 281474976710656.0::DOUBLE)) AS score FROM events) GROUP BY event_type""")
def gumbel_sample(spark, d):
    return sample.gumbel_pick(_read(spark, d, "events"), ["event_type"], "event_id", "value")


# --- tokens -----------------------------------------------------------------------------

_MOCK = """(CASE WHEN coalesce(length(text), 0) > 0 THEN list_transform(string_split(substring(text, 1, 1000), ''), lambda c: ord(c) % 6400) || [2] ELSE [] END)"""


@query(f"SELECT doc_id, len(ids)::INTEGER AS n, list_sum(ids)::BIGINT AS total, list_sum(list_transform(range(1, len(ids) + 1), lambda i: i * ids[i]))::BIGINT AS check FROM (SELECT doc_id, {_MOCK} AS ids FROM documents) WHERE len(ids) > 0")
def mock_tokenize(spark, d):
    t = tokens.tokenize(_read(spark, d, "documents").select("doc_id", "text"), encoder=tokens.reference_encode)
    add = lambda v: F.aggregate(v, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return t.select("doc_id", F.col("length").alias("n"), add(F.col("token_ids")).alias("total"), add(F.transform("token_ids", lambda x, i: x.cast("bigint") * (i + 1))).alias("check"))


@query("""WITH r AS (SELECT rec_id, any_value(source) AS source, any_value(split) AS split, coalesce(any_value(token_ids), []) AS ids FROM tokenized_docs GROUP BY rec_id)
SELECT split, source, count(*)::BIGINT AS docs, sum(len(ids))::BIGINT AS tokens FROM r GROUP BY split, source""")
def token_totals(spark, d):
    t = _read(spark, d, "tokenized_docs").dropDuplicates(["rec_id"]).withColumn("token_ids", F.coalesce("token_ids", F.array().cast("array<int>")))
    return tokens.token_totals(t, ["split", "source"])


@query("""SELECT rec_id, list_sum(list_transform(token_ids, lambda x: least(x, 4999)))::BIGINT AS total FROM (SELECT DISTINCT rec_id, token_ids FROM tokenized_docs WHERE len(token_ids) > 0)""")
def clamp_tokens(spark, d):
    t = _read(spark, d, "tokenized_docs").where("size(token_ids) > 0").dropDuplicates(["rec_id"])
    return t.select("rec_id", F.aggregate(tokens.clamp(F.col("token_ids"), 5000), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


_FLAT = """(SELECT split, row_number() OVER (PARTITION BY split ORDER BY rec_id, i) - 1 AS gpos, token FROM (
 SELECT split, rec_id, unnest(token_ids) AS token, generate_subscripts(token_ids, 1) AS i FROM (SELECT DISTINCT rec_id, split, token_ids FROM tokenized_docs WHERE token_ids IS NOT NULL)))"""


def _token_docs(spark, d) -> DataFrame:
    return _read(spark, d, "tokenized_docs").select("rec_id", "split", "token_ids")


def _stream(spark, d) -> DataFrame:
    t = _token_docs(spark, d)
    return tokens.stream(t, ["rec_id"], order.id_bucket(t, "rec_id"), keys=["split"])


def _windows(spark, d) -> DataFrame:
    t = _token_docs(spark, d)
    return tokens.windows(t, ["rec_id"], order.id_bucket(t, "rec_id"), 512, keys=["split"])


@query(f"""SELECT split, gpos // 513 AS sample, sum(token)::BIGINT AS total, sum(token * (gpos % 513 + 1))::BIGINT AS check FROM {_FLAT} GROUP BY split, sample HAVING count(*) = 513""")
def token_windows(spark, d):
    w = _windows(spark, d)
    add = lambda v: F.aggregate(v, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return w.select("split", "sample", add(F.col("ids")).alias("total"), add(F.transform("ids", lambda x, i: x.cast("bigint") * (i + 1))).alias("check"))


@query(f"""SELECT split, gpos // 513 AS sample, sum(token) FILTER (gpos % 513 < 512)::BIGINT AS x, sum(token) FILTER (gpos % 513 > 0)::BIGINT AS y FROM {_FLAT} GROUP BY split, sample HAVING count(*) = 513""")
def next_token_pairs(spark, d):
    p = tokens.next_token_pairs(_windows(spark, d))
    add = lambda v: F.aggregate(v, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return p.select("split", "sample", add(F.col("x")).alias("x"), add(F.col("y")).alias("y"))


@query(f"""SELECT split, gpos // 512 AS part, sum(recent)::BIGINT AS recent, sum(blocks)::BIGINT AS blocks, sum(indices)::BIGINT AS indices FROM (
 SELECT split, gpos, list_sum(range(greatest(gpos % 512 - 15, 0), gpos % 512 + 1))::BIGINT - (16 - least(gpos % 512 + 1, 16)) AS recent, (gpos % 512 + 1) // 64 AS blocks,
  coalesce(list_sum(list_transform(range(0, (gpos % 512 + 1) // 64), lambda b: b * b)), 0)::BIGINT AS indices FROM {_FLAT}) GROUP BY split, part""")
def attention_indices(spark, d):
    """The last 16 positions and the complete blocks of 64 that each position of a window of 512 sees."""
    at = _stream(spark, d).select("split", F.floor(F.col("gpos") / 512).cast("bigint").alias("part"), (F.col("gpos") % 512).alias("gpos"))
    add = lambda v: F.aggregate(v, F.lit(0).cast("bigint"), lambda a, x: a + x)
    blocks = tokens.completed_blocks(F.col("gpos"), 64)
    told = tokens.recent(at, 16, []).select("split", "part", add("recent").alias("recent"), F.size(blocks).cast("bigint").alias("blocks"), add(F.transform(blocks, lambda b: b.cast("bigint") * b)).alias("indices"))
    return told.groupBy("split", "part").agg(*[F.sum(c).alias(c) for c in ("recent", "blocks", "indices")])


@query(f"""SELECT split, a, sum(CASE WHEN b <= a THEN 1 ELSE 0 END)::BIGINT AS seen FROM (SELECT split, gpos % 64 AS a FROM {_FLAT}), (SELECT unnest(range(0, 64)) AS b) GROUP BY split, a""")
def causal_counts(spark, d):
    at = _stream(spark, d).select("split", (F.col("gpos") % 64).alias("a")).groupBy("split", "a").agg(F.count(F.lit(1)).alias("n"))
    met = at.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(63))))
    return met.groupBy("split", "a").agg(F.sum(F.when(tokens.causal(F.col("a"), F.col("b")), F.col("n")).otherwise(F.lit(0))).cast("bigint").alias("seen"))


@query(f"""SELECT split, gpos // 128 AS block, round(sum(exp((token % 7)::DOUBLE) * token) / sum(exp((token % 7)::DOUBLE)), 6) AS pooled, count(*)::BIGINT AS n FROM {_FLAT} GROUP BY split, block""")
def block_pool(spark, d):
    s = _stream(spark, d).withColumn("score", F.pmod("token", F.lit(7)).cast("double"))
    return tokens.pool_blocks(s, ["split"], "gpos", "token", "score", 128).withColumn("pooled", F.round("pooled", 6))


@query(f"""WITH s AS (SELECT split, gpos // 128 AS own, token, (token % 7)::DOUBLE * 200 AS s FROM {_FLAT}), b AS (SELECT split, own + k AS block, own, token, s FROM s, (SELECT unnest([0, 1]) AS k)),
 t AS (SELECT split, block, max(s) AS top FROM b GROUP BY split, block HAVING max(own) = block)
 SELECT b.split, b.block, round(sum(exp(s - top) * token) / sum(exp(s - top)), 6) AS pooled, count(*)::BIGINT AS n FROM b JOIN t USING (split, block) GROUP BY b.split, b.block""")
def block_pool_overlap(spark, d):
    s = _stream(spark, d).withColumn("score", F.pmod("token", F.lit(7)).cast("double") * 200)
    return tokens.pool_blocks(s, ["split"], "gpos", "token", "score", 128, overlap=True).withColumn("pooled", F.round("pooled", 6))


@query("SELECT doc_id, md5(coalesce(text, '')) AS h, coalesce(length(text), 0) = 0 AS without_ids, true AS ends, true AS within FROM documents")
def encode_round_trip(spark, d):
    docs = _read(spark, d, "documents").select("doc_id", tokenizer.round_trip(F.col("text"), TOKENIZER).alias("r")).select("doc_id", "r.ids", F.col("r.text").alias("back"))
    n = F.size("ids")
    marked = F.when(n > 0, F.concat(tokens.clamp(F.col("ids"), 50_000), F.array(F.lit(2)))).otherwise(F.col("ids"))
    return docs.select("doc_id", "ids", "back", marked.alias("m")).select(
        "doc_id", F.md5("back").alias("h"), (n == 0).alias("without_ids"),
        ((F.size("m") == 0) | (F.element_at("m", -1) == 2)).alias("ends"), F.forall("m", lambda x: (x >= 0) & (x < 50_000)).alias("within"))


@query(f"SELECT split, count(*)::BIGINT AS tokens, sum(token)::BIGINT AS total, sum(token * (gpos % 513 + 1))::BIGINT AS check FROM {_FLAT} GROUP BY split")
def bin_round_trip(spark, d):
    """Binarized per split into the shared folder and read back by byte ranges."""
    t = _token_docs(spark, d)
    folder = new_folder(spark, "token-files")
    parts = tokens.parts(t, ["rec_id"], order.id_bucket(t, "rec_id"), tokenbin.PART_TOKENS, keys=["split"])
    written = tokenbin.write_tokens(parts, folder, key="split").groupBy("split").agg(F.sum("tokens").alias("tokens")).collect()
    read = [tokenbin.read_tokens(spark, f"{folder}/{r['split']}").withColumn("split", F.lit(r["split"])) for r in written]
    flat = reduce(DataFrame.unionByName, read) if read else spark.createDataFrame([], "gpos bigint, token bigint, split string")
    return flat.groupBy("split").agg(F.count(F.lit(1)).alias("tokens"), F.sum("token").alias("total"), F.sum(F.col("token") * (F.col("gpos") % 513 + 1)).alias("check"))


@query("SELECT row_no, source, coalesce(length(text), 0)::INTEGER AS n, md5(coalesce(text, '')) AS h FROM raw_zh")
def jsonl_round_trip(spark, d):
    """Records written as JSON lines in the shared folder and read back."""
    folder = new_folder(spark, "lines")
    t = _read(spark, d, "raw_zh").select("row_no", "text", "source")
    jsonl.write_jsonl(t, folder)
    read = jsonl.read_jsonl(spark, folder, t.schema)
    return read.select("row_no", "source", F.coalesce(F.length("text"), F.lit(0)).alias("n"), F.md5(F.coalesce("text", F.lit(""))).alias("h"))


# --- metrics ----------------------------------------------------------------------------


@query("""SELECT l_returnflag AS grp, round(exp(sum(l_discount * l_quantity) / sum(l_quantity)), 9) AS ppl FROM lineitem GROUP BY l_returnflag""")
def ppl_weighted(spark, d):
    t = _read(spark, d, "lineitem").withColumn("loss", F.col("l_discount") * F.col("l_quantity"))
    return metrics.perplexity(t, "loss", "l_quantity", ["l_returnflag"]).select(F.col("l_returnflag").alias("grp"), F.round("ppl", 9).alias("ppl"))


@query("SELECT round(coalesce(avg(l_extendedprice), 0.0), 6) AS mean FROM (SELECT l_extendedprice FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice LIMIT 100)")
def eval_mean_100(spark, d):
    return metrics.mean_of_first(_read(spark, d, "lineitem"), "l_extendedprice", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]).select(F.round("mean", 6).alias("mean"))


_LOG = "(SELECT DISTINCT * FROM stage_log)"


@query(f"""SELECT log_id, min(elapsed_time) OVER (PARTITION BY run_id ORDER BY log_id) AS best, round(avg(elapsed_time) OVER (PARTITION BY run_id ORDER BY log_id ROWS 9 PRECEDING), 6) AS trailing,
 round(docs_in / greatest(elapsed_time, 1e-6), 6) AS rate FROM {_LOG}""")
def progress_log(spark, d):
    log = _read(spark, d, "stage_log").dropDuplicates(["log_id"])
    out = metrics.trailing_mean(metrics.best_so_far(log, ["run_id"], ["log_id"], "elapsed_time"), ["run_id"], ["log_id"], "elapsed_time")
    return out.select("log_id", "best", F.round("trailing", 6).alias("trailing"), F.round(metrics.throughput(F.col("docs_in"), F.col("elapsed_time")), 6).alias("rate"))


@query(f"SELECT stage_no, lang, count(*)::BIGINT AS entries, coalesce(sum(docs_in), 0)::BIGINT AS docs_in, coalesce(sum(docs_out), 0)::BIGINT AS docs_out FROM {_LOG} GROUP BY ROLLUP (stage_no, lang)")
def stage_totals(spark, d):
    return metrics.stage_totals(_read(spark, d, "stage_log"), ["stage_no", "lang"])


@query("""SELECT log_id, CASE WHEN docs_in >= 1e9 THEN round((docs_in / 1e9)::DECIMAL(18, 6), 1)::VARCHAR || 'B' WHEN docs_in >= 1e6 THEN round((docs_in / 1e6)::DECIMAL(18, 6), 1)::VARCHAR || 'M' WHEN docs_in >= 1e3 THEN round((docs_in / 1e3)::DECIMAL(18, 6), 1)::VARCHAR || 'K' ELSE docs_in::VARCHAR END AS shown,
 printf('%02d:%02d', floor(elapsed_time)::BIGINT // 60, floor(elapsed_time)::BIGINT % 60) AS clock FROM (SELECT DISTINCT log_id, docs_in, elapsed_time FROM stage_log) WHERE docs_in IS NOT NULL AND elapsed_time IS NOT NULL""")
def display_formats(spark, d):
    log = _read(spark, d, "stage_log").where("docs_in is not null and elapsed_time is not null").select("log_id", "docs_in", "elapsed_time").distinct()
    return log.select("log_id", T.format_count(F.col("docs_in")).alias("shown"), T.format_clock(F.col("elapsed_time")).alias("clock"))


@query("""SELECT step, round(CASE WHEN step < 4000 THEN 3e-4 * (step / 4000.0::DOUBLE) WHEN step < 12000 THEN 3e-4 ELSE 3e-5 + 2.7e-4 * 0.5 * (1 + cos(pi() * least((step - 12000) / 28920.0::DOUBLE, 1.0))) END, 12) AS lr,
 round(CASE WHEN step < 12000 THEN 0.3 ELSE 0.3 - 0.2 * least((step - 12000) / 28920.0::DOUBLE, 1.0) END, 9)::DOUBLE AS weight FROM (SELECT unnest(range(0, 42000)) AS step)""")
def lr_schedule(spark, d):
    return spark.range(42_000).select(F.col("id").alias("step"), F.round(metrics.learning_rate(F.col("id")), 12).alias("lr"), F.round(metrics.auxiliary_weight(F.col("id")), 9).alias("weight"))


# --- vectors ----------------------------------------------------------------------------

_E = "(SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"


def _sql_sum(expr: str) -> str:
    """Weighted sum over a whole vector: element by element, each with another weight."""
    return f"round(list_sum(list_transform(range(1, len(v) + 1), lambda i: ({expr}) * (i % 7 + 1))), 5)"


def _weighted(v: Column) -> Column:
    return F.round(F.aggregate(F.transform(v, lambda x, i: x * ((i + 1) % 7 + 1)), F.lit(0.0), lambda a, x: a + x), 5)


@query(f"""SELECT vec_id, {_sql_sum('v[i] / sqrt(m + 1e-6)')} AS normed, round(n, 6) AS norm, round(CASE WHEN top < 1e-12 THEN 1.0 ELSE top / 448 END, 9) AS scale,
 {_sql_sum('v[i] / (1 + exp(-v[i]))')} AS silu, {_sql_sum('1 / (1 + exp(-v[i]))')} AS sigmoid
 FROM (SELECT vec_id, v, list_sum(list_transform(v, lambda x: x * x)) / len(v) AS m, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n, list_max(list_transform(v, lambda x: abs(x))) AS top FROM {_E})""")
def vector_functions(spark, d):
    v = F.col("embedding")
    return _read(spark, d, "embeddings").select("vec_id", _weighted(V.rms_norm(v)).alias("normed"), F.round(V.l2_norm(v), 6).alias("norm"), F.round(V.fp8_scale(v), 9).alias("scale"), _weighted(V.silu(v)).alias("silu"), _weighted(V.sigmoid(v)).alias("sigmoid"))


@query(f"SELECT vec_id, round(list_sum(list_transform(v, lambda x: greatest(least(x / (list_max(list_transform(v, lambda y: abs(y))) / 448), 448), -448) * (list_max(list_transform(v, lambda y: abs(y))) / 448))), 6) AS total FROM {_E}")
def fp8_fake_quant(spark, d):
    return _read(spark, d, "embeddings").select("vec_id", F.round(V.total(V.fp8_round_trip(F.col("embedding"))), 6).alias("total"))


_ANGLE = "(vec_id / pow(10000.0, 2 * ((i - 1) // 2) / 64.0))"


@query(f"""SELECT vec_id, {_sql_sum(f'CASE WHEN i % 2 = 1 THEN v[i] * cos{_ANGLE} - v[i + 1] * sin{_ANGLE} ELSE v[i - 1] * sin{_ANGLE} + v[i] * cos{_ANGLE} END')} AS turned FROM {_E}""")
def rope(spark, d):
    return _read(spark, d, "embeddings").select("vec_id", _weighted(V.rotate(F.col("embedding"), V.rope_angles(F.col("vec_id"), 64))).alias("turned"))


@query(f"""SELECT vec_id, rank, expert, round(s / sum(s) OVER (PARTITION BY vec_id), 6) AS weight FROM (
 SELECT vec_id, expert, s, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, expert)::INTEGER AS rank FROM (SELECT vec_id, (i - 1)::INTEGER AS expert, sqrt(ln(1 + exp(v[i]))) AS s FROM {_E}, (SELECT unnest(range(1, 65)) AS i))) WHERE rank <= 4""")
def topk_gate(spark, d):
    g = _read(spark, d, "embeddings").select("vec_id", F.posexplode(V.top_k_gate(F.col("embedding"), 4)).alias("p", "g"))
    return g.select("vec_id", (F.col("p") + 1).alias("rank"), F.col("g.expert").alias("expert"), F.round("g.weight", 6).alias("weight"))


@query(f"SELECT vec_id, (vec_id % 8)::BIGINT AS expert, round(ln(list_sum(list_transform(v, lambda x: exp(x)))) - v[label + 1], 6) AS loss FROM {_E}")
def route_and_loss(spark, d):
    return _read(spark, d, "embeddings").select("vec_id", V.hash_route(F.col("vec_id"), 8).alias("expert"), F.round(V.cross_entropy(F.col("embedding"), F.col("label")), 6).alias("loss"))


@query(f"""SELECT vec_id, round(a / (a + b), 6) AS pre, round(e / (e + f), 6) AS comb FROM (SELECT vec_id, 1 / (1 + exp(-v[1])) + 1e-6 AS a, 1 / (1 + exp(-v[2])) + 1e-6 AS b, 1 / (1 + exp(-v[5])) + 1e-6 AS e, 1 / (1 + exp(-v[6])) + 1e-6 AS f FROM {_E})""")
def mixing_weights(spark, d):
    w = V.mixing_weights(F.slice("embedding", 1, 8), 2)
    return _read(spark, d, "embeddings").select("vec_id", w.alias("w")).select("vec_id", F.round(F.col("w.pre")[0], 6).alias("pre"), F.round(F.col("w.comb")[0][0], 6).alias("comb"))


@query(f"""WITH u AS (SELECT vec_id, list_transform(v, lambda x: x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-12)) AS v FROM {_E}),
 s AS (SELECT a.vec_id AS q, b.vec_id AS id, round(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])), 9) AS score FROM u a JOIN u b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
 SELECT q, count(*)::BIGINT AS n, round(min(score), 5) AS least, round(max(score), 5) AS most FROM (SELECT q, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10 GROUP BY q""")
def topk_neighbors(spark, d):
    e = _read(spark, d, "embeddings")
    near = vector.nearest(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 10)
    return near.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("score"), 5).alias("least"), F.round(F.max("score"), 5).alias("most"))


@query(f"""WITH p AS (SELECT label, vec_id, v, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos FROM {_E}),
 d AS (SELECT label, pos // 4 AS b, i, avg(v[i]) AS x, count(*) AS n FROM p, (SELECT unnest(range(1, 17)) AS i) GROUP BY label, b, i HAVING count(*) = 4),
 c AS (SELECT label, b, list(x ORDER BY i) AS k FROM d GROUP BY label, b),
 s AS (SELECT vec_id, b, list_sum(list_transform(range(0, 4), lambda h: greatest(list_sum(list_transform(range(1, 17), lambda i: v[h * 16 + i] * k[i])), 0) * v[60 + h + 1])) AS score FROM p JOIN c ON p.label = c.label AND b < (pos + 1) // 4),
 r AS (SELECT vec_id, b, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, b) AS rank FROM s)
 SELECT p.vec_id, coalesce(string_agg((b + 100)::VARCHAR, ',' ORDER BY rank) FILTER (rank <= 3), '') AS picked, 3 - count(b) FILTER (rank <= 3) AS missing FROM p LEFT JOIN r ON p.vec_id = r.vec_id GROUP BY p.vec_id""")
def block_index(spark, d):
    e = _read(spark, d, "embeddings").withColumn("pos", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1)
    flat = e.select("label", F.floor(F.col("pos") / 4).cast("int").alias("b"), F.posexplode(F.slice("embedding", 1, 16)).alias("i", "x")).groupBy("label", "b", "i").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count(F.lit(1)).alias("n")).where("n = 4")
    blocks = flat.groupBy("label", "b").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda y: y["x"]).alias("k"))
    out = vector.indexed_blocks(e.withColumn("w", F.slice("embedding", 61, 4)), blocks, "label", "pos", "embedding", "w", "b", "k", 3, 4, offset=100)
    found = F.filter("picked", lambda x: x >= 0)
    return out.select("vec_id", F.array_join(found, ",").alias("picked"), (3 - F.size(found)).cast("bigint").alias("missing"))


@query(f"""SELECT label, count(*)::BIGINT AS vectors, round(max(list_max(list_transform(v, lambda x: abs(x)))), 6) AS abs_max, round(sqrt(sum(list_sum(list_transform(v, lambda x: x * x)))), 5) AS norm FROM {_E} GROUP BY label""")
def vector_stats(spark, d):
    return vector.vector_stats(_read(spark, d, "embeddings"), ["label"], "embedding").select("label", "vectors", F.round("abs_max", 6).alias("abs_max"), F.round("norm", 5).alias("norm"))


@query(f"""SELECT e.event_id, round(coalesce(t.v[1], 0.0), 6) AS first FROM events e LEFT JOIN {_E} t ON e.user_id = t.vec_id""")
def embedding_gather(spark, d):
    out = vector.gather(_read(spark, d, "events").select("event_id", "user_id"), "user_id", _read(spark, d, "embeddings"), "vec_id", "embedding", 64)
    return out.select("event_id", F.round(F.col("embedding")[0], 6).alias("first"))


@query("SELECT o_custkey AS token, round(sum(l_discount * l_quantity), 6) AS sum FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey")
def expert_scatter(spark, d):
    routed = _read(spark, d, "lineitem").join(_read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).withColumnRenamed("o_custkey", "token")
    return vector.scatter_sum(routed, "token", "l_discount", "l_quantity").withColumn("sum", F.round("sum", 6))


@query(f"""SELECT user_id, round(sum(s * (i % 7 + 1)), 4) AS sum, count(*)::INTEGER AS n FROM (
 SELECT user_id, i, sum(value * v[i]) AS s FROM events JOIN {_E} ON vec_id = event_id % 500, (SELECT unnest(range(1, 65)) AS i) WHERE value IS NOT NULL GROUP BY user_id, i) GROUP BY user_id""")
def expert_scatter_vectors(spark, d):
    e = _read(spark, d, "events").where("value is not null").withColumn("vec_id", F.col("event_id") % 500)
    routed = e.join(_read(spark, d, "embeddings"), "vec_id")
    out = vector.scatter_vectors(routed, "user_id", "value", "embedding")
    return out.select("user_id", F.round(F.aggregate(F.transform("sum", lambda x, i: x * ((i + 1) % 7 + 1)), F.lit(0.0), lambda a, x: a + x), 4).alias("sum"), F.size("sum").alias("n"))


# --- sources and joins ------------------------------------------------------------------


@query("""SELECT event_id, CASE WHEN json_valid(props) THEN coalesce(json_extract_string(props, '$.page'), '') ELSE '' END AS page FROM events""")
def json_fields(spark, d):
    return _read(spark, d, "events").select("event_id", acquire.json_field(F.col("props"), "page").alias("page"))


@query("""SELECT domain, main_lang, count(*)::BIGINT AS docs, coalesce(sum(n_chars), 0)::BIGINT AS chars FROM documents d LEFT JOIN source_catalog c USING (source) GROUP BY ROLLUP (domain, main_lang)""")
def source_rollup(spark, d):
    joined = _read(spark, d, "documents").join(_read(spark, d, "source_catalog"), "source", "left")
    return joined.rollup("domain", "main_lang").agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n_chars"), F.lit(0)).cast("bigint").alias("chars"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
