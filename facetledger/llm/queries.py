"""The registered queries of this package and the SQL that must give the same rows."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetledger.llm import (
    collocations, decontaminate, embedding_dedup, language_id, line_dedup, mixing, near_dup, periodic_runs, token_counts, token_orc, topk, toxicity, url_filter,
)
from facetledger.llm.sample import remainder
from facetledger.llm.text import small_batches
from facetledger.llm.url_filter import Rule
from facetledger.runtime import stage, use_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    use_utc(spark)
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


TOKEN_LIMIT = 4096
END_ID = 2


@register
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The count of each document and of its prefixes (one for each word or line end), as the last prefix has it."""
    counted = token_counts.prefix_counts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), grain="word", columns=["doc_id"])
    n_tokens = F.coalesce(F.try_element_at("prefix_tokens", F.lit(-1)), F.lit(0)).cast("long")
    whole = counted.withColumn("n_tokens", n_tokens)
    return whole.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"), "prefix_bytes", "prefix_tokens")


@register
def op8_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_orc.new_folder(spark)
    token_orc.write_tokens(table(spark, sf_dir, "documents"), folder, tokenizer_file("word_bpe_49k.json"), END_ID)
    return token_orc.describe_tokens(token_orc.read_tokens(spark, folder))


LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS_SQL = f"regexp_extract_all({LOWER_SQL}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLES["op9_decontamination"] = f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
i AS (SELECT item_id, w, least(10, len(w)) AS k FROM (SELECT item_id, {WORDS_SQL} AS w FROM benchmark) WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, p, p + k - 1), ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM i)),
o AS (SELECT doc_id, k, p, array_to_string(list_slice(w, p, p + k - 1), ' ') AS g FROM (
  SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM g) WHERE len(w) >= k)),
m AS (SELECT o.doc_id, o.p, o.k, g.item_id FROM o JOIN g ON o.k = g.k AND o.g = g.g),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS x FROM m) GROUP BY 1),
t AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM m GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items,
  sha256(array_to_string(coalesce(items, []), ',')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""


@register
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = decontaminate.search_items(docs, items, columns=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.expr(decontaminate.items_digest()).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@register
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict(docs.select("doc_id", "text"), language_id.fit(docs), columns=["doc_id"])
    return found.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@register
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    found = toxicity.score(docs, chain, columns=["doc_id"])
    return found.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted", "spans")


ORACLES["op2_near_dup"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER_SQL}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN [array_to_string(w[p:p + 2], ' ') FOR p IN range(1, len(w) - 1)]
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
r AS (SELECT doc_id, doc_id AS m FROM d UNION SELECT l.y, r.m FROM r JOIN l ON l.x = r.doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT doc_id, min(m) AS component_id FROM r GROUP BY 1) LEFT JOIN n USING (doc_id)"""


@register
def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.find_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


URL_RULES = (Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/"))


@register
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "block_probability")


TOP_K = 5

ORACLES["op6_topk"] = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e, len(embedding) AS n
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([x[1] * x[2] FOR x IN list_zip(q.e, c.e)]) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND c.n = q.n
  WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


@register
def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = stage(topk.usable(table(spark, sf_dir, "embeddings")))
    return topk.top_k(vectors.where("vec_id % 50 = 0"), vectors, TOP_K)


# Target weights of the sources; one that is not named here weighs as much as the least of these. Unequal on purpose: some
# sources run out long before others, one weight has many digits, and rows without a source have one too.
MIXTURE: dict[str | None, float] = {"src0": 5, "src1": 3, "src2": 2.5, "src3": 1.75, "src4": 0.333333333, "src5": 4, "src6": 0.9, "src19": 6, None: 0.75, "src7": 0.25}


@register
def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.interleave(docs, MIXTURE).select("doc_id", "source", "block", "slot", "release", "deadline", "position")


@register
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.summary(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLES["op11_collocations"] = f"""
WITH p AS (SELECT row_number() OVER () AS piece, lang, w FROM (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER_SQL}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)) WHERE len(w) > 0),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY 1),
g AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase FROM (
  SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, phrase, w, f AS a, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
s AS (SELECT c.lang, c.phrase, c.a, c.cut, l.f AS l, r.f AS r, t.n,
    CAST((1000::HUGEINT * c.a * t.n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM c JOIN t ON t.lang = c.lang
    JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.cut], ' ')
    JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.cut + 1:], ' ')),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, a, array_to_string(list_slice(w, x, x + v - 1), ' ') AS phrase FROM (
  SELECT lang, w, f AS a, v, unnest(range(1, k - v + 2)) AS x FROM f, (SELECT unnest(range(2, 5)) AS v) WHERE k > v)),
d AS (SELECT lang, phrase, max(a) AS longer FROM i GROUP BY 1, 2),
o AS (SELECT m.*, row_number() OVER (PARTITION BY m.lang ORDER BY score DESC, m.a DESC, m.phrase) AS rank
  FROM m LEFT JOIN d ON d.lang = m.lang AND d.phrase = m.phrase WHERE d.longer IS NULL OR 100 * d.longer < 100 * m.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM o WHERE rank <= 2000"""


@register
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


ORACLES["op12_embedding_dedup"] = """
WITH RECURSIVE e AS (
  SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0),
v AS (SELECT vec_id, x, list_inner_product(x, x) AS n FROM e),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_inner_product(a.x, b.x) / sqrt(a.n * b.n) >= 0.9),
r AS (SELECT vec_id, vec_id AS m FROM embeddings UNION SELECT l.y, r.m FROM r JOIN l ON l.x = r.vec_id)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM (SELECT vec_id, min(m) AS component_id FROM r GROUP BY 1) LEFT JOIN (SELECT x AS vec_id, count(*) AS n_links FROM l GROUP BY 1) USING (vec_id)"""


@register
def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def _looped_by_id(part: pa.RecordBatch, counts: np.ndarray) -> dict[int, tuple[int, int]]:
    """Of one document in ten, by the checksum of its id, the words repeat from some word on."""
    found = {}
    for row, doc in enumerate(part.column("doc_id").to_pylist()):
        h = zlib.crc32(str(doc).encode())
        n, g = int(counts[row]), h // 10
        if doc is not None and h % 10 == 0 and n:
            begin = g % n
            found[row] = begin, 1 + (n - begin) // (3 + g % 8)
    return found


@register
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), _looped_by_id, collapse="sha256")
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", F.col("collapsed").alias("collapsed_sha256"))
