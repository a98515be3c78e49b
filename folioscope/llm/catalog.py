"""The registered queries of these operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import collocations, covertree, decontamination, hardnegatives, linededup, lm, neighbours, packing, pii, simhash, suffixdedup, tokenfiles, toxicity
from folioscope.llm.common import share_of
from folioscope.session import tune, work_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune(spark), sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_packing")
def op1(spark, sf_dir):
    """All documents in sequences of at most 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), length=1024, end_id=0)


@query("op3_token_files")
def op3(spark, sf_dir):
    """All documents written as Arrow token files, and read back."""
    folder = f"{work_dir(spark)}/tokens"
    files = tokenfiles.write_token_files(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), folder, end_id=2)
    return tokenfiles.read_token_files(spark, folder, files)


@query("op9_toxicity")
def op9(spark, sf_dir):
    """Toxicity of all documents, learned from the labels outside the held-out fifth."""
    found = toxicity.toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), usable=share_of(F.col("doc_id"), 5) != 0)
    return found.select("doc_id", (share_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted", "n_sentences", F.size("offending").alias("n_offending"))


@query("op10_personal_data")
def op10(spark, sf_dir):
    """Personal data of all documents."""
    return pii.digest(pii.find_personal_data(table(spark, sf_dir, "documents")))


@query("op8_simhash")
def op8(spark, sf_dir):
    """Components of all documents by SimHash fingerprints at most 3 bits apart."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, distance=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op4_katz")
def op4(spark, sf_dir):
    """All documents under a Katz backoff model of those outside the held-out seventh."""
    scores, model = lm.katz_scores(table(spark, sf_dir, "documents"), train=share_of(F.col("doc_id"), 7) != 2, order=2)
    return scores.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"),
                         F.col("base").alias("base_score"), "score")


@query("op7_cover_tree")
def op7(spark, sf_dir):
    """All embeddings with a cosine of 0.9 or more, as link counts and components."""
    return covertree.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.9)


@query("op6_suffix_array")
def op6(spark, sf_dir):
    """All documents without the bytes of strings of 200 bytes that occur elsewhere too."""
    found = suffixdedup.repeated_passages(table(spark, sf_dir, "documents"), length=200)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op5_decontamination")
def op5(spark, sf_dir):
    """Documents that hold a passage of the benchmark, with the item."""
    found = decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "cosine", F.col("common").alias("common_share"), F.col("answer").alias("answer_share"))


@query("op2_line_dedup")
def op2(spark, sf_dir):
    """All documents less the lines with a copy or near copy before them, as a digest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    found = linededup.without_duplicates(docs.withColumn("n_lines", lines))
    kept = F.when(F.coalesce("text", F.lit("")) == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    return found.select("doc_id", "n_lines", kept.alias("n_kept"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


_HARD = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other_id,
      CAST(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i])) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
  p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
  SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS rank,
    other_id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
  WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
  QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 10"""


@query("op13_hard_negatives", _HARD)
def op13(spark, sf_dir):
    """Hard negatives of every hundredth vector against all vectors."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardnegatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


_PHRASES = r"""WITH pieces AS (SELECT lang, p, row_number() OVER () AS piece FROM (SELECT coalesce(lang, 'und') AS lang,
      unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
  words AS (SELECT lang, piece, list_filter(regexp_split_to_array(p, '[ \t]+'), lambda w: w <> '') AS w FROM pieces),
  ns AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
  tokens AS (SELECT lang, piece, unnest(w) AS w, unnest(range(len(w))) AS i FROM words),
  nexts AS (SELECT lang, w AS w1, lead(w, 1) OVER p AS w2, lead(w, 2) OVER p AS w3, lead(w, 3) OVER p AS w4 FROM tokens WINDOW p AS (PARTITION BY piece ORDER BY i)),
  grams AS (SELECT lang, 1 AS k, w1 AS phrase FROM nexts UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM nexts WHERE w2 IS NOT NULL
    UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM nexts WHERE w3 IS NOT NULL UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM nexts WHERE w4 IS NOT NULL),
  f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
  split AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
  cuts AS (SELECT s.lang, s.phrase, s.f AS a, c, l.f AS l, r.f AS r, CAST((CAST(2000000 AS HUGEINT) * s.f) // (l.f + r.f) AS BIGINT) AS score
    FROM split s, (SELECT unnest(range(1, 4)) AS c) JOIN f l ON l.lang = s.lang AND l.phrase = array_to_string(w[1:c], ' ')
    JOIN f r ON r.lang = s.lang AND r.phrase = array_to_string(w[c + 1:s.k], ' ') WHERE c < s.k),
  low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
  inner_ AS (SELECT lang, array_to_string(w[i:i + j - 1], ' ') AS phrase, max(f) AS longest FROM split, (SELECT unnest(range(2, 4)) AS j), LATERAL (SELECT unnest(range(1, k - j + 2)) AS i)
    WHERE j < k GROUP BY ALL),
  kept AS (SELECT low.* FROM low LEFT JOIN inner_ USING (lang, phrase) WHERE longest IS NULL OR 100 * CAST(longest AS HUGEINT) < 80 * CAST(a AS HUGEINT))
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
  FROM kept JOIN ns USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000"""


@query("op11_collocations", _PHRASES)
def op11(spark, sf_dir):
    """The best 2,000 phrases of every language over all documents."""
    return collocations.collocations(table(spark, sf_dir, "documents"), least=30, top=2000)


@query("op12_nearest")
def op12(spark, sf_dir):
    """The 20 nearest vectors of every twentieth one, by a neighbour graph over all."""
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)
