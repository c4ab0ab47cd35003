"""Registry of the corpus queries: name -> callable(spark, folder), and their SQL twins."""

from pyspark.sql import functions as F

from . import (
    bilinear_lm,
    block_extraction,
    digest_merge,
    fragment_join,
    importance_resampling,
    language_crf,
    ordered_packing,
    phrase_tiles,
    pii_boosting,
    role_repair,
    template_decontamination,
    toxicity_lexicon,
    training_order,
)
from .storage import cut, read_table

QUERIES = {}
ORACLE_SQL = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op8_digest_merge(spark, sf_dir):
    return digest_merge.exact_groups(read_table(spark, sf_dir, "documents"), keep="largest")


ORACLE_SQL["op8_digest_merge"] = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(words) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS words FROM documents)
WINDOW same AS (PARTITION BY words)
"""


@query
def op9_ordered_packing(spark, sf_dir):
    return ordered_packing.pack(read_table(spark, sf_dir, "documents"))


@query
def op6_toxicity_lexicon(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    rows = toxicity_lexicon.labelled(docs, read_table(spark, sf_dir, "labels"), toxicity_lexicon.training_fold)
    lexicon = toxicity_lexicon.learn(cut(rows))
    return toxicity_lexicon.score(docs, lexicon).select(
        "doc_id",
        toxicity_lexicon.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op10_block_extraction(spark, sf_dir):
    return block_extraction.extract(read_table(spark, sf_dir, "pages"))


@query
def op4_pii_boosting(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return pii_boosting.find(docs, pii_boosting.train_on(docs))


@query
def op3_fragment_join(spark, sf_dir):
    return fragment_join.jaccard_components(read_table(spark, sf_dir, "documents"))


@query
def op1_template_decontamination(spark, sf_dir):
    docs, benchmark = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    found = template_decontamination.leaks(docs, benchmark)
    return found.select("doc_id", "item_id", "windows", "item_windows", "copied")


@query
def op2_role_repair(spark, sf_dir):
    return role_repair.repair(read_table(spark, sf_dir, "conversations"))


@query
def op7_training_order(spark, sf_dir):
    return training_order.training_order(read_table(spark, sf_dir, "documents"))


@query
def op5_bilinear_lm(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    model, counts = bilinear_lm.learn(docs, ~bilinear_lm.held_out(F.col("doc_id")))
    return bilinear_lm.score(docs, model, counts).select(
        "doc_id", bilinear_lm.held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
        "base_score", "score",
    )


@query
def op11_importance_resampling(spark, sf_dir):
    return importance_resampling.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


# The CRC-32 of each distinct word is taken byte by byte, eight steps of one bit each.
ORACLE_SQL["op11_importance_resampling"] = """
WITH found AS (
    SELECT doc_id, regexp_extract_all(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
    FROM documents
), wanted AS (
    SELECT unnest(regexp_extract_all(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word
    FROM benchmark
), used AS (
    SELECT doc_id, unnest(words) AS word FROM found
), distinct_words AS (
    SELECT word, hex(encode(word)) AS digits FROM (SELECT word FROM used UNION SELECT word FROM wanted) every_word
), bytes AS (
    SELECT word, list_transform(range(1, length(digits), 2), lambda k: CAST('0x' || substr(digits, CAST(k AS BIGINT), 2) AS BIGINT)) AS bytes
    FROM distinct_words
), buckets AS (
    SELECT word, xor(list_reduce(list_concat([4294967295], bytes), lambda crc, byte:
        list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, step:
            CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)), 4294967295) % 10000 AS bucket
    FROM bytes
), raw_counts AS (
    SELECT bucket, count(*) AS s FROM used JOIN buckets USING (word) GROUP BY bucket
), target_counts AS (
    SELECT bucket, count(*) AS t FROM wanted JOIN buckets USING (word) GROUP BY bucket
), gains AS (
    SELECT bucket, CAST(floor(1000.0::DOUBLE * ln(
               ((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(s), 0) FROM raw_counts) + 10000.0::DOUBLE))
               / ((coalesce(s, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(t), 0) FROM target_counts) + 10000.0::DOUBLE)))) AS BIGINT) AS gain
    FROM raw_counts FULL JOIN target_counts USING (bucket)
), weights AS (
    SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight
    FROM used JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY doc_id
), scored AS (
    SELECT found.doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + CAST(floor(-1000.0::DOUBLE * ln(-ln(
               (CAST('0x' || substr(sha256('2024:' || found.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
    FROM found LEFT JOIN weights USING (doc_id)
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
           n_features >= 20 AS enough
    FROM scored
)
SELECT doc_id, n_features, weight, score,
       CASE WHEN enough AND place <= 10 * (SELECT count(*) FROM scored WHERE n_features >= 20) // 100 THEN place END AS rank
FROM placed
"""


@query
def op13_phrase_tiles(spark, sf_dir):
    return phrase_tiles.collocations(read_table(spark, sf_dir, "documents"))


ORACLE_SQL["op13_phrase_tiles"] = """
WITH pieces AS (
    SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(
               translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')),
               '[^\\x20\\x09]+') AS words
    FROM (SELECT coalesce(lang, 'und') AS lang, coalesce(text, '') AS text FROM documents) texts
), runs AS (
    SELECT lang, 1 AS size, unnest(words) AS phrase FROM pieces
    UNION ALL
    SELECT lang, 2, unnest(list_transform(range(1, len(words)), lambda k: words[k] || ' ' || words[k + 1])) FROM pieces
    UNION ALL
    SELECT lang, 3, unnest(list_transform(range(1, len(words) - 1), lambda k: words[k] || ' ' || words[k + 1] || ' ' || words[k + 2]))
    FROM pieces
), counts AS MATERIALIZED (
    SELECT lang, size, phrase, count(*) AS f FROM runs GROUP BY ALL
), totals AS (
    SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE size = 1 GROUP BY lang
), candidates AS MATERIALIZED (
    SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS words FROM counts WHERE size > 1 AND f >= 10
), cuts AS MATERIALIZED (
    SELECT lang, size, phrase, a, k, array_to_string(words[1:k], ' ') AS first_part, array_to_string(words[k + 1:], ' ') AS rest
    FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates) each_cut
), parts AS MATERIALIZED (
    SELECT lang, phrase AS part, f FROM counts WHERE f >= 10
), left_sides AS MATERIALIZED (
    SELECT cuts.*, f AS l FROM cuts JOIN parts ON parts.lang = cuts.lang AND parts.part = cuts.first_part
), sides AS MATERIALIZED (
    SELECT c.lang, c.size, c.phrase, c.a, c.k, c.l, f AS r,
           CAST(1000000::HUGEINT * c.a * c.a // (c.l::HUGEINT * f) AS BIGINT) AS score
    FROM left_sides c JOIN parts ON parts.lang = c.lang AND parts.part = c.rest
), best AS (
    SELECT * FROM sides QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
    SELECT lang, max(a) AS around, phrase FROM (
        SELECT lang, a, unnest([words[1] || ' ' || words[2], words[2] || ' ' || words[3]]) AS phrase
        FROM candidates WHERE size = 3) shorter
    GROUP BY lang, phrase
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best JOIN totals USING (lang) LEFT JOIN inside USING (lang, phrase)
WHERE around IS NULL OR 100 * around < 50 * a
QUALIFY rank <= 2000
"""


@query
def op12_language_crf(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    model = language_crf.learn(docs, ~language_crf.held_out(F.col("doc_id")))
    return language_crf.predict(docs, model).select(
        "doc_id", language_crf.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )
