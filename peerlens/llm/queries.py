"""The registered queries of the operators and their SQL counterparts, where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package, written_table
from ..sources.tables import read_table
from . import bpe, collocations, embedding_join, fingerprints, html_extract, jaccard_join, mixing, neighbours, pii, pitman_yor, quality, spelling, suffix_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


@query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, counted and digested."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_pii(docs).select("doc_id", "pii")
    base = F.filter("pii", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    return found.select(
        "doc_id", *[pii.count_of(F.col("pii"), k).alias(f"n_{k}") for k in pii.BASE_KINDS],
        F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("pii")).alias("spans"))


@query
def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return embedding_join.near_duplicates(read_table(spark, sf_dir, "embeddings"))


THRESHOLD = 0.3  # documents with a lower score are rejected


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels that are not held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = written_table(docs.select("doc_id", quality.statistics("text").alias("x")), "quality-statistics")
    model = quality.train(stats, read_table(spark, sf_dir, "labels"))
    out = stats.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), quality.scored(model, "x").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


@query
def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = html_extract.extract_pages(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as digests."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode_documents(docs).select("doc_id", "ids").withColumn("decoded", bpe.decode("ids"))
    return ids.select(
        "doc_id", bpe.n_tokens("ids").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op6_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under a model of those not held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pitman_yor.score_texts(docs, pitman_yor.held_out(F.col("doc_id")))


@query
def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document."""
    return jaccard_join.join_components(read_table(spark, sf_dir, "documents"))


@query
def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, its edited text and its neighbour."""
    return fingerprints.compare_edits(read_table(spark, sf_dir, "documents"))


@query
def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that repeat, as digests."""
    out = suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by source."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, mixing.n_words("text")).select("doc_id", "size", "source_size", "target", "taken", "passes")


@query
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of every word."""
    return spelling.spelling_variants(read_table(spark, sf_dir, "documents"))


@query
def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest found for every hundredth vector."""
    return neighbours.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of every language."""
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


# Components in SQL: everything reachable from each node, smallest first.
_REACH = """
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(id, c) AS (SELECT id, id FROM nodes UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id WHERE r.c < e.b)"""

ORACLES["op7_jaccard"] = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS sh
  FROM w, unnest(range(1, CASE WHEN len(ws) = 0 THEN 1 WHEN len(ws) < 5 THEN 2 ELSE len(ws) - 3 END)) t(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
nodes AS (SELECT doc_id AS id FROM documents),{_REACH}
SELECT doc_id, coalesce(n, 0) AS n_shingles, min(c) AS component_id
FROM documents LEFT JOIN n USING (doc_id) JOIN r ON id = doc_id GROUP BY ALL"""

ORACLES["op2_embeddings"] = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
nodes AS (SELECT vec_id AS id FROM embeddings),{_REACH},
k AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, min(c) AS component_id, vec_id = min(c) AS kept
FROM embeddings LEFT JOIN k ON a = vec_id JOIN r ON id = vec_id GROUP BY vec_id, n"""

# The checksum of a name, byte by byte from its table; runs shorter than a word need none.
ORACLES["op11_spelling"] = r"""
WITH RECURSIVE bits(i, c, k) AS (
  SELECT i, i::BIGINT, 0 FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS d,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS w
  FROM documents),
named AS (SELECT d, w, count(*) AS n, hex(encode(d || ':' || w)) AS x FROM runs WHERE length(w) >= 7 GROUP BY ALL),
hashed AS (
  SELECT w, n, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(0, (length(x) // 2)::BIGINT), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM named, crc),
thinned AS (
  SELECT n, CASE WHEN h % 31 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM thinned WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT word, rest FROM cut WHERE rest IN (SELECT word FROM words)
  UNION SELECT rest, word FROM cut WHERE rest IN (SELECT word FROM words)),
near AS (
  SELECT a, count(*) AS n_near, first(b ORDER BY n DESC, b) AS best, max(n) AS best_n FROM pairs JOIN words ON word = b GROUP BY a),
full_rows AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN best END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n
  FROM words LEFT JOIN near ON a = word),
chain(word, link, step) AS (
  SELECT word, word, 0 FROM full_rows UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN full_rows f ON f.word = c.link WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(link, step) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM full_rows JOIN ends USING (word)"""

ORACLES["op13_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
f AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM w, unnest([1, 2, 3]) s(k), unnest(range(1, greatest(len(ws) - k + 2, 1))) t(i) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS p FROM f WHERE k > 1 AND f >= 10),
cut AS (
  SELECT c.lang, c.k, c.phrase, c.a, cut_at, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM c, unnest(range(1, c.k)) t(cut_at) JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.p[1:cut_at], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.p[cut_at + 1:c.k], ' ')),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut_at) = 1),
longer AS (
  SELECT lang, array_to_string(p[i:i + 1], ' ') AS phrase, max(a) AS most FROM c, unnest([1, 2]) t(i) WHERE k = 3 GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN longer USING (lang, phrase) WHERE k = 3 OR most IS NULL OR 100 * most < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000"""
