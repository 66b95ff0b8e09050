"""The registered queries of the operators, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm import audit, urlfilter
from cuelake.llm.align import alignment_digests
from cuelake.llm.bpe import encode_decode
from cuelake.llm.common import tokenizer_path
from cuelake.llm.langid import languages
from cuelake.llm.packing import pack
from cuelake.llm.pii import find_spans
from cuelake.llm.pitman import score_texts
from cuelake.llm.quality import quality_rules
from cuelake.llm.simhash import near_duplicates
from cuelake.llm.tokenfile import token_file_round_trip
from cuelake.llm.topk import top_k
from cuelake.llm.warc import warc_round_trip

BYTE_BPE = "byte_bpe_multi_50k.tiktoken"
WORD_BPE = "word_bpe_49k.json"
#: Ranks of the vocabulary of byte_bpe_50k.json: the same tokens and ids.
ENGLISH_BPE = "byte_bpe_50k.tiktoken"
PIECE_BPE = "piece_bpe_32k.model"
END_ID = 2

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def registered(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@registered
def op1_byte_bpe(spark, sf_dir):
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE), public_tokenizers.PATTERN)


@registered
def op2_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


@registered
def op3_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@registered
def op4_exact_top_k(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE["op4_exact_top_k"] = """
WITH v AS (
    SELECT vec_id::BIGINT AS vec_id, row_number() OVER () AS row_no,
        list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS (
    SELECT q.vec_id AS query_id, q.row_no AS q_no, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM v q JOIN v c ON q.row_no != c.row_no AND len(q.v) = len(c.v)
    WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q_no ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@registered
def op5_personal_data(spark, sf_dir):
    return find_spans(table(spark, sf_dir, "documents"))


@registered
def op6_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE), END_ID)


@registered
def op9_token_files(spark, sf_dir):
    return token_file_round_trip(table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE), END_ID)


@registered
def op7_warc(spark, sf_dir):
    return warc_round_trip(table(spark, sf_dir, "pages"))


ORACLE["op7_warc"] = """
WITH p AS (SELECT page_id::BIGINT AS page_id, coalesce(html, '') AS html FROM pages),
sized AS (SELECT page_id, html, octet_length(encode(html))::BIGINT AS payload_bytes FROM p),
heads AS (SELECT html, max(page_id) AS head_id FROM sized WHERE payload_bytes >= 1000 GROUP BY html)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
    CASE WHEN head_id IS NOT NULL AND head_id IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN head_id IS DISTINCT FROM page_id THEN head_id END AS refers_to
FROM sized LEFT JOIN heads USING (html)
"""


@registered
def op8_language_id(spark, sf_dir):
    return languages(table(spark, sf_dir, "documents"))


#: The rules of the supplied pages.
URL_RULES = [
    urlfilter.Rule("org", "/", "allow"),
    urlfilter.Rule("example.org", "/es/", "block"),
    urlfilter.Rule("example.org", "/en/1", "block"),
    urlfilter.Rule("com", "/fr/", "allow"),
    urlfilter.Rule("com", "/de/", "block"),
]


@registered
def op10_url_filter(spark, sf_dir):
    return urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES).drop("trust", "distrust")


ORACLE["op10_url_filter"] = urlfilter.sql(URL_RULES)


@registered
def op11_pitman_yor(spark, sf_dir):
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return score_texts(table(spark, sf_dir, "documents"), held_out)


@registered
def op12_token_alignment(spark, sf_dir):
    import public_tokenizers

    return alignment_digests(table(spark, sf_dir, "documents"), tokenizer_path(ENGLISH_BPE), tokenizer_path(PIECE_BPE), public_tokenizers.PATTERN)


@registered
def op13_filter_audit(spark, sf_dir):
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE["op13_filter_audit"] = audit.SQL
