"""Vector and full-text search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import fts
from tessera.operators import vector as V
from tessera.operators.shared import exists, new_path, shared_folder
from tessera.plans.declare import Catalogue, Tables

C = Catalogue()
#: The query vector of the examples, cut to the table's dimension.
QUERY = [((i * 37) % 19 - 9) / 10 for i in range(1024)]


def _dimension(t: Tables) -> int:
    return t.embeddings.select(F.size("embedding")).first()[0]


_Q = "(SELECT list_transform(range(len(embedding)), lambda i: (((i * 37) % 19) - 9) / 10.0) AS q FROM embeddings LIMIT 1)"
_E = f"(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, CAST(q AS DOUBLE[]) AS q FROM embeddings, {_Q})"


@C.query(
    "vector_distances",
    f"""SELECT vec_id, round(list_distance(e, q), 5) AS l2, round(list_distance(e, q) ** 2, 4) AS sq, round(list_sum(list_transform(list_zip(e, q), lambda x: abs(x[1] - x[2]))), 5) AS l1,
               round(list_max(list_transform(list_zip(e, q), lambda x: abs(x[1] - x[2]))), 5) AS linf, round(list_inner_product(e, q), 5) AS dot, round(-list_inner_product(e, q), 5) AS neg,
               round(list_cosine_similarity(e, q), 5) AS sim, round(1 - list_cosine_similarity(e, q), 5) AS cos, len(e) AS dim, round(sqrt(list_inner_product(e, e)), 5) AS norm FROM {_E}""",
)
def distances(t: Tables):
    e, q = F.col("embedding"), V.literal(QUERY[: _dimension(t)])
    found = {"l2": V.l2(e, q), "l1": V.l1(e, q), "linf": V.linf(e, q), "dot": V.inner_product(e, q), "neg": V.negative_inner_product(e, q), "sim": V.cosine_similarity(e, q), "cos": V.cosine_distance(e, q), "norm": V.norm(e)}
    return t.embeddings.select("vec_id", F.round(V.l2_squared(e, q), 4).alias("sq"), V.dimension(e).cast("long").alias("dim"), *[F.round(v, 5).alias(k) for k, v in found.items()])


for _name, _expr in (("l2", "list_distance(e, q)"), ("cosine", "1 - list_cosine_similarity(e, q)"), ("dot", "-list_inner_product(e, q)"), ("l1", "list_sum(list_transform(list_zip(e, q), lambda x: abs(x[1] - x[2])))")):
    C.query(f"vector_top_{_name}", f"SELECT vec_id, round({_expr}, 5) AS dist FROM {_E} ORDER BY {_expr}, vec_id LIMIT 10")(
        lambda t, m=_name: V.top_k(t.embeddings, "embedding", QUERY[: _dimension(t)], 10, m, "vec_id").select("vec_id", F.round("dist", 5).alias("dist"))
    )


@C.query(
    "vector_batch_top",
    """SELECT query_id, vec_id, round(d, 5) AS dist FROM (SELECT q.vec_id AS query_id, e.vec_id, list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS d,
       row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), e.vec_id) AS rn
       FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0) WHERE rn <= 5""",
)
def batch_top(t: Tables):
    queries = t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return V.batch_top_k(t.embeddings, "embedding", "vec_id", queries, 5).select("query_id", "vec_id", F.round("dist", 5).alias("dist"))


C.query("vector_text", "SELECT vec_id, len(embedding) AS n FROM embeddings")(lambda t: t.embeddings.select("vec_id", F.size(F.split(V.to_text(F.col("embedding")), ", ")).cast("long").alias("n")))

_TERMS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+'), lambda x: length(x) >= 2)"
_P = f"p AS (SELECT doc_id AS doc, unnest({_TERMS}) AS term, unnest(range(len({_TERMS}))) AS pos FROM documents)"


_INDEXES: dict[tuple[str, str, str], str] = {}


def _index(t: Tables) -> DataFrame:
    """The postings of documents, written once a session and dataset folder, whose tables
    don't change; anew if the shared folder was cleared."""
    own = t.spark.sparkContext.applicationId, shared_folder(t.spark), t.sf_dir
    if own not in _INDEXES or not exists(t.spark, _INDEXES[own]):
        path = new_path(t.spark, "postings")
        fts.postings(t.documents, "doc_id", "text").write.parquet(path)
        _INDEXES[own] = path
    return t.spark.read.parquet(_INDEXES[own])


C.query("fts_match", f"WITH {_P} SELECT doc FROM p WHERE term IN ('this', 'with', 'from') GROUP BY doc HAVING count(DISTINCT term) = 3")(lambda t: fts.match(_index(t), "This with FROM"))
C.query("fts_phrase", f"WITH {_P} SELECT DISTINCT a.doc FROM p a JOIN p b ON a.doc = b.doc AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the'")(lambda t: fts.match(_index(t), '"of the"'))
C.query(
    "fts_fuzzy",
    f"""WITH {_P}, v AS (SELECT DISTINCT term FROM p), n AS (SELECT term FROM v WHERE levenshtein(term, 'thinn') <= 2 AND 1 - levenshtein(term, 'thinn') / greatest(length(term), 5) >= 0.7
        ORDER BY levenshtein(term, 'thinn'), term LIMIT 20) SELECT DISTINCT doc FROM p JOIN n USING (term)""",
)(lambda t: fts.fuzzy_match(_index(t), "thinn"))


@C.query(
    "fts_bm25",
    f"""WITH {_P}, tf AS (SELECT doc, term, count(*) AS tf FROM p WHERE term IN ('this', 'from') GROUP BY 1, 2), l AS (SELECT doc_id AS doc, len({_TERMS}) AS n FROM documents),
        s AS (SELECT count(*) AS docs, avg(n) AS mean FROM l), d AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)
        SELECT tf.doc, round(sum(ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * n / mean))), 6) AS score FROM tf JOIN l ON tf.doc = l.doc JOIN d ON d.term = tf.term, s GROUP BY 1""",
)
def bm25(t: Tables):
    index = _index(t)
    return fts.bm25(index, fts.held_lengths(index), "this from").select("doc", F.round("score", 6).alias("score"))


C.query("fts_stats", f"WITH {_P} SELECT count(DISTINCT term) AS terms, count(DISTINCT doc) AS docs, count(*) AS tokens FROM p")(lambda t: fts.stats(_index(t)))
C.query("fts_cjk", "SELECT * FROM (VALUES ('日'), ('本'), ('語'), ('日本'), ('本語'), ('日本語')) x(term)")(
    lambda t: t.spark.createDataFrame([("a 日本語 b",)], "text string").select(F.explode(fts.cjk_pieces(F.col("text"))).alias("term"))
)

QUERIES, ORACLE = C.queries, C.oracle
