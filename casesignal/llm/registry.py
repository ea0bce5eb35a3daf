"""The operators as queries over the given tables, with SQL twins where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casesignal.llm.common import read
from casesignal.session import prepare

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        _QUERIES[name] = lambda spark, sf_dir: fn(prepare(spark), sf_dir)
        if sql:
            _SQL[name] = sql
        return fn

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


LINE_DEDUP_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT rid, doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM docs
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), hot AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(hot.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE hot.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN hot ON keyed.k = hot.k GROUP BY rid
"""


@register("op10_line_dedup", LINE_DEDUP_SQL)
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go from every document."""
    from casesignal.llm.line_dedup import dedup_lines

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs, min_docs=10, min_chars=1)
    kept = F.col("line_dedup")
    return out.select("doc_id", kept["n_lines"].alias("n_lines"), kept["n_dropped"].alias("n_dropped"), F.sha2(kept["text"], 256).alias("kept_sha256"))


def piece_model() -> bytes:
    """The public BPE model with 32,000 pieces."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


@register("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every text, and whether it exceeds the context."""
    from casesignal.llm.token_counts import count_tokens

    return count_tokens(read(spark, sf_dir, "documents"), piece_model(), limit=4096)


MIXING_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
         md5('0:' || coalesce(doc_id::VARCHAR, '-') || ':' || md5(coalesce(text, ''))) AS shuffle
  FROM documents
), placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY chunk, shuffle, doc_id
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM (SELECT *, ('0x' || shuffle[1:8])::BIGINT % (SELECT CASE WHEN count(*) // 1000000 = 0 THEN 64 ELSE 64 << length(bin(count(*) // 1000000)) END FROM sized) AS chunk FROM sized)
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM sized GROUP BY source
), levels AS (
  SELECT *, sum(source_size) OVER () AS total,
         (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM per
), sources AS (
  SELECT source, source_size, total,
         least((3 * source_size)::DOUBLE, coalesce(max(level) FILTER (WHERE level * weight <= 3 * source_size) OVER () * weight, 0.0)) AS target
  FROM levels
), edges AS (
  SELECT source, ceil(sum(target) OVER (ORDER BY source NULLS LAST) / sum(target) OVER () * 2147483648)::BIGINT AS edge,
         row_number() OVER (ORDER BY source NULLS LAST) AS i FROM sources WHERE target > 0
), cuts AS (
  SELECT source, coalesce(lag(edge) OVER (ORDER BY i), 0) AS lo,
         CASE WHEN lead(edge) OVER (ORDER BY i) IS NULL THEN 2147483648 ELSE edge END AS hi FROM edges
), n AS (
  SELECT max(total)::BIGINT AS total, greatest(1, (max(total)::BIGINT + 262143) // 262144) AS block FROM sources
), slots AS (
  SELECT r AS slot, (r % 2147483648) * 1327217885 % 2147483648 AS point
  FROM (SELECT unnest(range((SELECT (total + block - 1) // block FROM n))) AS r)
), dealt AS (
  SELECT slot, source, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank FROM slots JOIN cuts ON point >= lo AND point < hi
), quota AS (
  SELECT source, greatest(1, round(target))::BIGINT AS reach, (greatest(1, round(target))::BIGINT + block - 1) // block AS need
  FROM sources, n WHERE target > 0
), kept AS (
  SELECT slot, d.source, rank FROM dealt d JOIN quota q ON d.source IS NOT DISTINCT FROM q.source WHERE rank < need
), short AS (
  SELECT source, unnest(range(have, need)) AS rank
  FROM (SELECT q.source, need, (SELECT count(*) FROM kept k WHERE k.source IS NOT DISTINCT FROM q.source) AS have FROM quota q)
), filled AS (
  SELECT slot, source, rank FROM kept
  UNION ALL SELECT (SELECT coalesce(max(slot), -1) FROM dealt) + row_number() OVER (ORDER BY rank, source NULLS LAST), source, rank FROM short
), held AS (
  SELECT source, count(*) * (SELECT block FROM n) AS words FROM filled GROUP BY source
), covered AS (
  SELECT s.source, source_size, target, coalesce(least(words, reach, 3 * source_size), 0) AS reach
  FROM sources s LEFT JOIN held h ON s.source IS NOT DISTINCT FROM h.source LEFT JOIN quota q ON s.source IS NOT DISTINCT FROM q.source
)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, reach - start)) + greatest(0, least(size, reach - start - source_size))
        + greatest(0, least(size, reach - start - 2 * source_size)))::BIGINT AS taken
FROM placed p JOIN covered c ON p.source IS NOT DISTINCT FROM c.source
"""


@register("op4_mixing", MIXING_SQL)
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix with weights 1, 2, 3 over the sources takes of each document."""
    from casesignal.llm.mixing import mix

    plan = mix(read(spark, sf_dir, "documents"), exact=True)
    per = plan.sources.select(F.col("source").alias("s"), "source_size", "target")
    out = plan.taken.join(per, F.col("source").eqNullSafe(F.col("s")))
    return out.select("doc_id", "size", "source_size", "target", "taken")


@register("op1_simhash")
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    from casesignal.llm.simhash import near_dedup

    return near_dedup(read(spark, sf_dir, "documents"), words=4, distance=4)


TOP_K_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c AS (
  SELECT rid, vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v
), s AS (
  SELECT q.rid AS query, q.vec_id AS query_id, c.rid, c.vec_id AS vec_id, sum(q.x * c.x)::BIGINT AS score
  FROM c AS q JOIN c ON q.i = c.i AND q.rid <> c.rid WHERE q.vec_id % 50 = 0 GROUP BY ALL
)
SELECT query_id, (row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id, rid))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""


@register("op7_top_k", TOP_K_SQL)
def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth vector, by inner product."""
    from casesignal.llm.topk import integer_vectors, top_k

    vectors = integer_vectors(read(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


@register("op9_quality_model")
def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from the labels not held out."""
    from casesignal.llm.quality_model import held_out, score, train

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    trees = train(docs, read(spark, sf_dir, "labels"))
    out = score(docs, trees).withColumnRenamed("quality_score", "score")
    predicted = (F.col("score") >= 0.7).cast("int")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


@register("op5_quality_rules")
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document, and whether the rules keep it."""
    from casesignal.llm.quality_rules import apply_rules

    return apply_rules(read(spark, sf_dir, "documents")).drop("lang")


@register("op3_suffix_tree")
def op3_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document under a model of those not held out."""
    from casesignal.llm.suffix_tree import held_out
    from casesignal.llm.word_tree import learn, score

    # As in op8_pieces: small batches bound what a worker holds.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    # Counts are hashed, not sorted, where a task's share of them is small.
    spark.conf.set("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "32m")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, learn(docs.where(~held_out(F.col("doc_id")))))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@register("op2_secrets")
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: known shapes, and strings that pass for random."""
    from casesignal.llm.secrets import find_secrets, span_text

    out = find_secrets(read(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    count = {f"n_{k}": (F.size("base") - F.size(F.array_remove(kinds, i))).cast("long") for i, k in enumerate(("assign", "access", "hex"))}
    return out.select("doc_id", *[c.alias(n) for n, c in count.items()], F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


@register("op8_pieces")
def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and the hash of what they decode to."""
    from casesignal.llm.pieces import encode

    # As in the pipeline: small batches bound what a worker holds.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    out = encode(read(spark, sf_dir, "documents").select("doc_id", "text"), piece_model())
    return out.select("doc_id", "pieces.n_tokens", "pieces.ids", "pieces.decoded_sha256")


DIGEST_SQL = r"""
WITH placed AS (
  SELECT row_number() OVER (ORDER BY doc_id) AS rid, doc_id, coalesce(text, '') AS text FROM documents
), following AS (
  SELECT p.rid, p.doc_id, p.text, n.text AS next_text, n.rid AS next_rid, length(p.text) AS n
  FROM placed p JOIN placed n ON n.rid = p.rid % (SELECT max(rid) FROM placed) + 1
), texts AS (
  SELECT rid, 0 AS kind, text AS t FROM following
  UNION ALL
  SELECT rid, 1, CASE WHEN n < 2 THEN text ELSE substring(text, 1, n - n // 2) || substring(next_text, 1, n // 2) END FROM following
), split AS (
  SELECT rid, kind, t, regexp_extract_all(hex(encode(t)), '..') AS hs FROM texts
), bytes AS (
  SELECT rid, kind, generate_subscripts(hs, 1) AS i, ('0x' || unnest(hs))::BIGINT AS b FROM split
), triplets AS (
  SELECT rid, kind, b * 65536 + lead(b, 1) OVER w * 256 + lead(b, 2) OVER w AS k FROM bytes WINDOW w AS (PARTITION BY rid, kind ORDER BY i)
), counted AS (
  SELECT rid, kind, ((k * 2654435761) % 4294967296) // 8388608 AS bucket, count(*) AS n FROM triplets WHERE k IS NOT NULL GROUP BY ALL
), full_counts AS (
  SELECT s.rid, s.kind, g.bucket, coalesce(c.n, 0) AS n
  FROM split s CROSS JOIN (SELECT unnest(range(512)) AS bucket) g
  LEFT JOIN counted c ON c.rid = s.rid AND c.kind = s.kind AND c.bucket = g.bucket
), quartiles AS (
  SELECT rid, kind, list_sort(list(n))[128] AS q1, list_sort(list(n))[256] AS q2, list_sort(list(n))[384] AS q3 FROM full_counts GROUP BY rid, kind
), codes AS (
  SELECT f.rid, f.kind, bucket, (n > q1)::INT + (n > q2)::INT + (n > q3)::INT AS c FROM full_counts f JOIN quartiles q ON f.rid = q.rid AND f.kind = q.kind
), digits AS (
  SELECT rid, kind, bucket // 2 AS d, sum(CASE WHEN bucket % 2 = 0 THEN 4 * c ELSE c END)::INT AS v FROM codes GROUP BY ALL
), bodies AS (
  SELECT rid, kind, string_agg(substring('0123456789abcdef', v + 1, 1), '' ORDER BY d) AS body FROM digits GROUP BY rid, kind
), heads AS (
  SELECT s.rid, s.kind, t, 15 * q1 // greatest(q3, 1) AS r1, 15 * q2 // greatest(q3, 1) AS r2, len(hs) AS size, length(bin(len(hs))) AS bits
  FROM split s JOIN quartiles q ON s.rid = q.rid AND s.kind = q.kind
), prints AS (
  SELECT h.rid, h.kind, t, r1, r2, CASE WHEN size < 4 THEN size ELSE 4 * (bits - 2) + (size >> (bits - 3)) % 4 END AS length,
         body FROM heads h JOIN bodies b ON h.rid = b.rid AND h.kind = b.kind
), named AS (
  SELECT *, lpad(lower(hex(length)), 2, '0') || lower(substring('0123456789abcdef', (r1 + 1)::INT, 1)) || substring('0123456789abcdef', (r2 + 1)::INT, 1) || body AS fingerprint FROM prints
), pairs AS (
  SELECT rid, rid AS other, 1 AS kind FROM following UNION ALL SELECT rid, next_rid, 0 FROM following
), apart AS (
  SELECT p.rid, p.kind, sum(abs(a.c - b.c)) AS apart FROM pairs p
  JOIN codes a ON a.rid = p.rid AND a.kind = 0 JOIN codes b ON b.rid = p.other AND b.kind = p.kind AND b.bucket = a.bucket GROUP BY p.rid, p.kind
), near AS (
  SELECT p.rid, p.kind, 1.0::DOUBLE - least(640, d.apart + 8 * abs(a.length - b.length) + 4 * (abs(a.r1 - b.r1) + abs(a.r2 - b.r2)))::DOUBLE / 640 AS near
  FROM pairs p JOIN apart d ON d.rid = p.rid AND d.kind = p.kind
  JOIN prints a ON a.rid = p.rid AND a.kind = 0 JOIN prints b ON b.rid = p.other AND b.kind = p.kind
)
SELECT f.doc_id, f.n AS n_chars, sha256(e.t) AS edited_sha256, o.fingerprint, e.fingerprint AS edited_fingerprint,
       ne.near AS near_edited, nn.near AS near_next
FROM following f JOIN named o ON o.rid = f.rid AND o.kind = 0 JOIN named e ON e.rid = f.rid AND e.kind = 1
JOIN near ne ON ne.rid = f.rid AND ne.kind = 1 JOIN near nn ON nn.rid = f.rid AND nn.kind = 0
"""


@register("op11_byte_digest", DIGEST_SQL)
def op11_byte_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text and of its edited form, and how alike they are."""
    from casesignal.llm.byte_digest import changes

    return changes(read(spark, sf_dir, "documents"))


AUDIT_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), marks AS (
  SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), firsts AS (
  SELECT text, min(doc_id) AS least FROM docs GROUP BY text
), worded AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM docs
), facts AS (
  SELECT w.part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
         (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
         + 4 * (100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 2 * length(w.text))::INT
         + 8 * regexp_matches(w.text, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > f.least, false)::INT AS mask
  FROM worded w JOIN firsts f ON w.text = f.text LEFT JOIN marks m ON w.doc_id = m.doc_id
), counts AS (
  SELECT part, good, toxic, mask, count(*) AS n FROM facts GROUP BY ALL
), letters AS (
  SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS l(letter, bit)
), orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order,
         [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit <> b.bit AND a.bit <> c.bit AND a.bit <> d.bit AND a.bit <> e.bit
    AND b.bit <> c.bit AND b.bit <> d.bit AND b.bit <> e.bit AND c.bit <> d.bit AND c.bit <> e.bit AND d.bit <> e.bit
), steps AS (
  SELECT filter_order, s AS step, bits[s] AS bit, coalesce(list_sum(bits[1:s - 1]), 0)::INT AS before FROM orders, (SELECT unnest(range(1, 6)) AS s) t
), tallied AS (
  SELECT part, filter_order, step, bit,
         coalesce(sum(n) FILTER (WHERE mask & (before + bit) = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (WHERE mask & before <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (WHERE mask = bit), 0)::BIGINT AS unique_fails,
         coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & bit <> 0 AND good = 1), 0)::BIGINT AS good_lost,
         coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & bit <> 0 AND toxic = 1), 0)::BIGINT AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM tallied
"""


@register("op13_filter_audit", AUDIT_SQL)
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove of each source, in all 120 orders."""
    from casesignal.llm.filter_audit import audit, text_filters

    losses = {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return audit(docs, text_filters(F.col("text")), duplicate="E", labels=labels, losses=losses)


NEGATIVES_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c AS (
  SELECT rid, vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v
), s AS (
  SELECT a.rid AS anchor, a.vec_id AS anchor_id, c.rid, c.vec_id, a.label = c.label AS same, sum(a.x * c.x)::BIGINT AS score
  FROM c AS a JOIN c ON a.i = c.i AND a.rid <> c.rid WHERE a.vec_id % 100 = 0 GROUP BY ALL
), p AS (
  SELECT anchor, anchor_id, rid, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, rid) <= 5
)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor, p.rid ORDER BY score DESC, vec_id, s.rid))::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor = s.anchor AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""


@register("op12_hard_negatives", NEGATIVES_SQL)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of other labels nearly as close to an anchor as its positives."""
    from casesignal.llm.hard_negatives import labelled_vectors, mine

    own = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (own + 1) % 10).otherwise(own)
    vectors = labelled_vectors(read(spark, sf_dir, "embeddings"), label)
    return mine(vectors, vectors.where("vec_id % 100 = 0"), positives=5, negatives=5, low=80, high=100)
