"""Registered queries of the text and vector operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op2_repeats(spark: SparkSession, folder: str) -> DataFrame:
    from wattline.llm.repeats import remove_repeats

    done = remove_repeats(table(spark, folder, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op7_near_texts(spark: SparkSession, folder: str) -> DataFrame:
    from wattline.llm.near_texts import near_texts

    return near_texts(table(spark, folder, "documents"))


WORD_BPE = "word_bpe_49k.json"


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def digest(base: Column) -> Column:
    """Lower-case hex of the spans ``kind:start:end`` of an array of structs, joined by commas."""
    return F.sha2(joined(base), 256)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def tally(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


@query
def op1_secrets(spark: SparkSession, folder: str) -> DataFrame:
    from wattline.llm.secrets import find_secrets

    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"] != "guess")
    done = find_secrets(table(spark, folder, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id", *[tally(spans, k).alias(f"n_{k}") for k in ("assign", "access", "hex")], digest(base).alias("base_sha256"),
        joined(spans).alias("spans"),
    )


@query
def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    from wattline.llm.packing import pack_documents

    return pack_documents(table(spark, folder, "documents"), tokenizer(WORD_BPE))


@query
def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    from wattline.llm.quality import fit_ranker, score_measured, text_features
    from wattline.session import stored

    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    measured = stored(text_features(table(spark, folder, "documents")))
    labels = table(spark, folder, "labels").where(~held_out).select("doc_id", "quality")
    scored = score_measured(measured, fit_ranker(measured, labels)).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    from wattline.llm.tokens import token_counts

    return token_counts(table(spark, folder, "documents"), tokenizer(WORD_BPE), 2048)


@query
def op5_personal(spark: SparkSession, folder: str) -> DataFrame:
    from wattline.llm.personal import find_personal, fit_field

    docs = table(spark, folder, "documents").select("doc_id", "text")
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["base"])
    return find_personal(docs, fit_field(docs)).select(
        "doc_id", *[tally(base, k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")], digest(base).alias("base_sha256"),
        joined(spans).alias("spans"),
    )


PIECE_BPE = "piece_bpe_32k.model"


@query
def op9_segmentations(spark: SparkSession, folder: str) -> DataFrame:
    from wattline.llm.segment import best_segmentations

    done = best_segmentations(table(spark, folder, "documents"), tokenizer(PIECE_BPE), 4, with_ids=True)
    every = F.transform("segmentations", lambda ids: F.xxhash64(ids))
    return done.select("doc_id", "scores", "lengths", "best_crc32", "round_trip", every.alias("segmentations_xxhash64"))


@query
def op6_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    from wattline.llm.probing import nearest_vectors

    vectors = table(spark, folder, "embeddings")
    return nearest_vectors(vectors, vectors.where(F.col("vec_id") % 20 == 0))


@query
def op8_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    from wattline.llm.lattice_pairs import near_vectors

    return near_vectors(table(spark, folder, "embeddings"))


@query
def op11_spellings(spark: SparkSession, folder: str) -> DataFrame:
    from wattline.llm.spellings import spelling_variants

    return spelling_variants(table(spark, folder, "documents"))


MULTI_BPE = "byte_bpe_multi_50k.tiktoken"


@query
def op12_languages(spark: SparkSession, folder: str) -> DataFrame:
    from wattline.llm.languages import fit_languages, predict_languages

    docs = table(spark, folder, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    model = fit_languages(docs.where(~held_out), tokenizer(MULTI_BPE))
    return predict_languages(docs, model, held_out=held_out)


@query
def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    from wattline.llm.whitening import whiten_vectors

    return whiten_vectors(table(spark, folder, "embeddings"))


# ---------------------------------------------------------------- SQL where it can say the same

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SQL["op2_repeats"] = f"""WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents), win AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)), rep AS (
  SELECT k FROM win GROUP BY k HAVING count(*) > 1), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM win WHERE k IN (SELECT k FROM rep)), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n
  FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w) a
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = a.doc_id AND g.p = a.p) GROUP BY doc_id)
  SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
  FROM w LEFT JOIN kept USING (doc_id)"""

# every id takes the smallest id among its links until nothing changes
REACH = """reach AS (SELECT a AS id, a AS low FROM ids UNION SELECT l.b, r.low FROM reach r JOIN link l ON l.a = r.id), comp AS (
  SELECT id, min(low) AS component_id FROM reach GROUP BY id)"""

SQL["op7_near_texts"] = f"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS ws FROM documents), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), both_ AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2), link AS (
  SELECT a, b FROM both_ JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)), ids AS (
  SELECT doc_id AS a FROM documents), {REACH}
  SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
  FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN comp ON comp.id = d.doc_id"""

SQL["op8_near_vectors"] = f"""WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0), u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS r FROM v), link AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_dot_product(x.e, y.e) / (x.r * y.r) >= 0.93), ids AS (SELECT vec_id AS a FROM embeddings), {REACH}
  SELECT d.vec_id, (SELECT count(*) FROM link WHERE a = d.vec_id) AS n_links, component_id, d.vec_id = component_id AS kept
  FROM embeddings d JOIN comp ON comp.id = d.vec_id"""

# crc32 by bytes; letters up to U+00FF take one byte or two
SQL["op11_spellings"] = """WITH RECURSIVE t AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tab), run AS (
  SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS w FROM documents)
  WHERE length(w) >= 7 GROUP BY ALL), h AS (
  SELECT w, n, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || w, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [(192 + (unicode(c) >> 6))::BIGINT, (128 + (unicode(c) & 63))::BIGINT] END))),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM run, t), v AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM h)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2), cut AS (
  SELECT word, n, i, left(word, i - 1) AS l, substr(word, i + 1) AS r FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM v)), near AS (
  SELECT a.word, b.word AS o, b.n AS o_n FROM cut a JOIN cut b ON a.l = b.l AND a.r = b.r AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN v b ON a.l || a.r = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN v b ON a.l || a.r = b.word), best AS (
  SELECT word, count(*) AS n_near, min((-o_n, o)) AS b FROM near GROUP BY word), f AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -b[1] >= 10 * v.n THEN b[2] END AS form,
    CASE WHEN -b[1] >= 10 * v.n THEN (-b[1])::BIGINT END AS form_n FROM v LEFT JOIN best USING (word)), walk AS (
  SELECT word, word AS here, 0 AS step FROM f UNION ALL
  SELECT w.word, f.form, step + 1 FROM walk w JOIN f ON f.word = w.here WHERE f.form IS NOT NULL)
  SELECT f.word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, max_by(here, step) AS root FROM walk GROUP BY word) USING (word)"""
