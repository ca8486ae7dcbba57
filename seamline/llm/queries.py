"""The queries of the operators for training data, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.llm import containers, encodings, exact_neighbours, functions, mixing, near_duplicates, source_origin, splitting, term_counts, vector_forest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- 3: frequency of every term ------------------------------------------------------------------------------


@query
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Terms too rare or too common to help a search."""
    marked = term_counts.marked_terms(term_counts.distinct_records(table(spark, sf, "chunks")))
    return marked.where(F.col("mark").isNotNull()).select("term", "mark")


@query
def p3_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Every term with its occurrences, the chunks that hold it and its mark."""
    return term_counts.marked_terms(term_counts.distinct_records(table(spark, sf, "chunks")))


@query
def p3_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    """Every sequence of up to three terms with its occurrences and chunks."""
    return term_counts.ngram_counts(term_counts.distinct_records(table(spark, sf, "chunks")), sigma=3).where(F.col("n") > 0)


_TERMS = r"""te AS (SELECT id, unnest(regexp_extract_all(lower(content), '[\p{L}\p{N}_]{2,}')) AS term FROM (SELECT id, any_value(content) AS content FROM chunks WHERE content IS NOT NULL GROUP BY id)),
co AS (SELECT term, count(*) AS cf, count(DISTINCT id) AS df FROM te GROUP BY term),
nn AS (SELECT count(DISTINCT id) AS n FROM chunks WHERE content IS NOT NULL),
ma AS (SELECT term, cf, df, CASE WHEN df < 3 THEN 'rare' WHEN df > 0.4::DOUBLE * n THEN 'common' END AS mark FROM co, nn)"""
ORACLES["p3_found"] = f"WITH {_TERMS} SELECT term, mark FROM ma WHERE mark IS NOT NULL"
ORACLES["p3_terms"] = f"WITH {_TERMS} SELECT term, cf, df, mark FROM ma"
ORACLES["p3_ngrams"] = r"""WITH ch AS (SELECT id, regexp_extract_all(lower(any_value(content)), '[\p{L}\p{N}_]{2,}') AS w FROM chunks WHERE content IS NOT NULL GROUP BY id),
po AS (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM ch),
gr AS (SELECT id, array_to_string(w[i:i + n - 1], ' ') AS ngram, n FROM po, (VALUES (1), (2), (3)) AS t(n) WHERE i + n - 1 <= len(w))
SELECT ngram, n, count(*) AS cf, count(DISTINCT id) AS df FROM gr GROUP BY ngram, n"""


# --- 6: near-duplicate chunks --------------------------------------------------------------------------------

P6 = {"similarity": 0.6, "width": 3}


@query
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of chunks that say nearly the same."""
    pairs = near_duplicates.near_pairs(table(spark, sf, "chunks"), **P6)
    return pairs.select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


@query
def p6_groups(spark: SparkSession, sf: str) -> DataFrame:
    """The group of every chunk."""
    return near_duplicates.near_groups(table(spark, sf, "chunks"), **P6).select(F.col("id").alias("chunk_id"), "group_id")


@query
def p6_representatives(spark: SparkSession, sf: str) -> DataFrame:
    """Similar pairs of chunks that stand for all their exact copies, with how many records each stands for."""
    membership, pairs = near_duplicates.representative_pairs(table(spark, sf, "chunks"), **P6)
    sizes = membership.groupBy("rep").agg(F.count("*").alias("n"))
    left, right = (sizes.select(F.col("rep").alias(side), F.col("n").alias(f"copies_{side}")) for side in ("a", "b"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"), "copies_a", "copies_b")


ORACLES["p6_found"] = r"""WITH w AS (SELECT id, regexp_extract_all(lower(any_value(content)), '[\p{L}\p{N}_]+') AS w FROM chunks WHERE content IS NOT NULL GROUP BY id),
g AS (SELECT DISTINCT id, hash(w[i], w[i + 1], w[i + 2]) AS h FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
c AS (SELECT a.id AS i, b.id AS j, count(*) AS k FROM g a JOIN g b ON a.h = b.h AND a.id < b.id GROUP BY ALL)
SELECT i AS chunk_id_a, j AS chunk_id_b FROM c JOIN n x ON x.id = i JOIN n y ON y.id = j WHERE k::DOUBLE / (x.n + y.n - k) >= 0.6::DOUBLE"""


# --- 2: most similar vectors ---------------------------------------------------------------------------------


@query
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of chunks of which one is among the ten nearest of the other."""
    pairs = vector_forest.neighbour_pairs(exact_neighbours.nearest_exact(table(spark, sf, "chunk_vectors"), k=10, dim=64))
    return pairs.select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


@query
def p2_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest of every usable vector with their similarity."""
    found = exact_neighbours.nearest_exact(table(spark, sf, "chunk_vectors"), k=10, dim=64)
    return found.select(F.col("id").alias("chunk_id"), "rank", F.col("neighbour").alias("near_id"), "similarity")


ORACLES["p2_found"] = """WITH v AS (SELECT chunk_id, any_value(embedding)::DOUBLE[] AS e FROM chunk_vectors WHERE len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0)) GROUP BY chunk_id),
s AS (SELECT a.chunk_id AS i, b.chunk_id AS j, list_cosine_similarity(a.e, b.e) AS c FROM v a, v b WHERE a.chunk_id <> b.chunk_id)
SELECT DISTINCT least(i, j) AS chunk_id_a, greatest(i, j) AS chunk_id_b FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY c DESC) AS place FROM s) WHERE place <= 10"""


# --- 4: splitting at natural boundaries ----------------------------------------------------------------------


@query
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of all source files above 2,000 characters."""
    pieces = splitting.split_records(table(spark, sf, "source_files"), "file_id", "content", "path")
    return pieces.select(F.col("id").alias("file_id"), "start_index", "end_index")


@query
def p4_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """The same pieces with their text."""
    pieces = splitting.split_records(table(spark, sf, "source_files"), "file_id", "content", "path")
    return pieces.withColumnRenamed("id", "file_id")


ORACLES["p4_found"] = r"""WITH RECURSIVE f AS (SELECT file_id, any_value(content) AS c, any_value(lower(path)) LIKE '%.md' AS md FROM source_files WHERE len(content) > 2000 AND regexp_matches(content, '\S') GROUP BY file_id),
l AS (SELECT file_id, c, coalesce(md, false) AS md, len(c) AS n, list_concat([0], list_filter(range(1, len(c) + 1), lambda i: substr(c, i, 1) = chr(10))) AS lin, list_filter(range(1, len(c) + 1), lambda i: substr(c, i, 1) = ' ') AS wrd FROM f),
p AS (SELECT file_id, n, lin, wrd, list_filter(lin, lambda x: regexp_matches(substr(c, x + 1, 12), CASE WHEN md THEN '^#{1,6} ' ELSE '^(def |class |async def |function |func )' END)) AS sec,
list_transform(list_filter(range(2, len(lin) + 1), lambda j: regexp_full_match(substr(c, lin[j - 1] + 1, lin[j] - lin[j - 1]), '[ \t\r]*\n')), lambda j: lin[j]) AS par FROM l),
r AS (SELECT file_id, 0::BIGINT AS s, 0::BIGINT AS e, 0 AS step FROM p
UNION ALL SELECT r.file_id, CASE WHEN step = 0 THEN 0 ELSE e - 200 END AS b, CASE WHEN n - b <= 2000 THEN n ELSE coalesce(list_max(list_filter(sec, lambda x: x >= b + 1000 AND x <= b + 2000)), list_max(list_filter(par, lambda x: x >= b + 1000 AND x <= b + 2000)),
list_max(list_filter(lin, lambda x: x >= b + 1000 AND x <= b + 2000)), list_max(list_filter(wrd, lambda x: x >= b + 1000 AND x <= b + 2000)), b + 2000) END, step + 1 FROM r JOIN p USING (file_id) WHERE step = 0 OR e < n)
SELECT file_id, s AS start_index, e AS end_index FROM r WHERE step > 0"""


# --- 5: functions with their documentation -------------------------------------------------------------------


@query
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Functions with telling documentation."""
    return functions.function_pairs(table(spark, sf, "source_files")).select("file_id", "func_name", "line_no")


@query
def p5_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Code and description of these functions."""
    return functions.function_pairs(table(spark, sf, "source_files"))


# --- 7: filling containers -----------------------------------------------------------------------------------


@query
def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    """The container of every document, with the tokens of it that go there."""
    return containers.fill_containers(table(spark, sf, "documents")).withColumnRenamed("id", "doc_id")


@query
def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    """How full the containers are."""
    return containers.fill_report(containers.fill_containers(table(spark, sf, "documents")))


# --- 8: mixing sources ---------------------------------------------------------------------------------------


@query
def p8_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """A mixture as large as the collection, each row with the target share of its source and the share reached."""
    documents = table(spark, sf, "documents")
    return mixing.mixture(documents, mixing.plan_mixture(documents, table(spark, sf, "mix_targets"))).withColumnRenamed("id", "doc_id")


@query
def p8_mixture_strict(spark: SparkSession, sf: str) -> DataFrame:
    """The largest mixture in which every source holds its share."""
    documents = table(spark, sf, "documents")
    return mixing.mixture(documents, mixing.plan_mixture(documents, table(spark, sf, "mix_targets"), size=None)).withColumnRenamed("id", "doc_id")


@query
def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target share, reached share and tokens of every source."""
    documents = table(spark, sf, "documents")
    return mixing.plan_mixture(documents, table(spark, sf, "mix_targets")).frame(documents).drop("cdf")


@query
def p8_shares_strict(spark: SparkSession, sf: str) -> DataFrame:
    """The same for the largest mixture in which every source holds its share."""
    documents = table(spark, sf, "documents")
    return mixing.plan_mixture(documents, table(spark, sf, "mix_targets"), size=None).frame(documents).drop("cdf")


# --- 9: text read in a wrong encoding ------------------------------------------------------------------------


@query
def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a passage read in a wrong encoding."""
    return encodings.garbled_records(table(spark, sf, "documents")).select(F.col("id").alias("doc_id"))


@query
def p9_restored(spark: SparkSession, sf: str) -> DataFrame:
    """These documents with the text restored."""
    return encodings.restored_records(table(spark, sf, "documents")).withColumnRenamed("id", "doc_id")


# --- 1: files not written by hand ----------------------------------------------------------------------------


@query
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Source files that are generated, packed, copied or data."""
    origins = source_origin.file_origins(table(spark, sf, "source_files"), table(spark, sf, "upstream_files"))
    return origins.where("generated or packed or data or vendored").select("file_id")


@query
def p1_origins(spark: SparkSession, sf: str) -> DataFrame:
    """Every source file with what it was found to be."""
    return source_origin.file_origins(table(spark, sf, "source_files"), table(spark, sf, "upstream_files"))
