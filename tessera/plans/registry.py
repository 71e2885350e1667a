"""All queries of the engine by name, with the SQL they must agree with.

A query takes (spark, folder of tables). Computed floats are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import codec
from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import access, audit, cache, index, knn, kv, limiter, metrics, oplog
from tessera.sources import generate
from tessera.sources import text as sources
from tessera.streaming import stateful
from tessera.streaming.drain import checkpoint_dir, drain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# -- vectors ------------------------------------------------------------------------------------------


def _vectors(spark, d, scaled=False) -> DataFrame:
    v = F.transform("embedding", lambda x: (x * (1 + F.col("label"))).cast("float")) if scaled else F.col("embedding")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), v.alias("vector"), "label")


def _first_vector(vectors: DataFrame, key: int = 0) -> list[float]:
    return vectors.where(F.col("key") == key).select("vector").first()["vector"]


_E = "e AS (SELECT vec_id AS key, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"
_ES = "e AS (SELECT vec_id AS key, CAST(CAST(list_transform(embedding, lambda x: x * (1 + label)) AS FLOAT[]) AS DOUBLE[]) AS v, label FROM embeddings)"
_SQL_DISTANCE = {
    "cosine": "list_cosine_distance({a}, {b})",
    "euclidean": "list_distance({a}, {b})",
    "dot_product": "-list_inner_product({a}, {b})",
    "manhattan": "list_sum(list_transform(list_zip({a}, {b}), lambda z: abs(z[1] - z[2])))",
}


def _add_knn() -> None:
    short = {"cosine": "cosine", "euclidean": "l2", "dot_product": "dot", "manhattan": "l1"}
    for metric, name in short.items():
        for scaled in (False, True):

            def run(spark, d, metric=metric, scaled=scaled):
                v = _vectors(spark, d, scaled)
                return knn.knn(v, _first_vector(v), 10, metric)

            full = f"knn_scaled_{name}" if scaled else f"knn_{name}"
            QUERIES[full] = run
            distance = _SQL_DISTANCE[metric].format(a="e.v", b="q.v")
            ORACLES[full] = f"WITH {_ES if scaled else _E} SELECT e.key, round({distance}, 6) AS distance FROM e, (SELECT v FROM e WHERE key = 0) q ORDER BY distance, key LIMIT 10"


_add_knn()


@query(f"WITH {_E} SELECT q.key AS query_id, e.key, round(list_cosine_distance(e.v, q.v), 6) AS distance, row_number() OVER (PARTITION BY q.key ORDER BY round(list_cosine_distance(e.v, q.v), 6), e.key)::INTEGER AS rank FROM e, e q WHERE q.key % 50 = 0 QUALIFY rank <= 10")
def knn_join_batch(spark, d):
    v = _vectors(spark, d)
    return knn.knn_join(v, v.where("key % 50 = 0"), 10)


@query(f"WITH {_ES} SELECT q.key AS query_id, e.key, round(list_distance(e.v, q.v), 6) AS distance, row_number() OVER (PARTITION BY q.key ORDER BY round(list_distance(e.v, q.v), 6), e.key)::INTEGER AS rank FROM e, e q WHERE q.key % 50 = 0 QUALIFY rank <= 5")
def knn_join_l2(spark, d):
    v = _vectors(spark, d, True)
    return knn.knn_join(v, v.where("key % 50 = 0"), 5, "l2")


@query(f"WITH {_E} SELECT e.key, round(list_cosine_distance(e.v, q.v), 6) AS distance, round(e.v[1], 6) AS first_element, len(e.v)::INTEGER AS dimension FROM e, (SELECT v FROM e WHERE key = 0) q ORDER BY distance, key LIMIT 10")
def knn_include_vectors(spark, d):
    v = _vectors(spark, d)
    hits = knn.with_vectors(knn.knn(v, _first_vector(v), 10), v.select("key", "vector"))
    return hits.select("key", "distance", F.round(F.col("vector")[0].cast("double"), 6).alias("first_element"), V.dimension(F.col("vector")).alias("dimension"))


@query(f"WITH {_E} SELECT e.key, round(list_cosine_distance(e.v, q.v), 6) AS distance FROM e, (SELECT v FROM e WHERE key = 0) q WHERE label = 3 ORDER BY distance, key LIMIT 10")
def knn_filtered(spark, d):
    v = _vectors(spark, d)
    return knn.knn(v, _first_vector(v), 10, where=F.col("label") == 3)


@query(f"WITH {_E}, k AS (SELECT e.key, label, round(list_cosine_distance(e.v, q.v), 6) AS distance FROM e, (SELECT v FROM e WHERE key = 0) q ORDER BY distance, key LIMIT 50) SELECT key, distance FROM k WHERE CAST(key AS VARCHAR) LIKE '1%'")
def knn_prefix_filter(spark, d):
    v = _vectors(spark, d)
    return knn.knn(v, _first_vector(v), 50).where(F.col("key").cast("string").startswith("1"))


@query(f"WITH {_E} SELECT e.key, round(list_cosine_distance(e.v, q.v), 6) AS distance FROM e, (SELECT v FROM e WHERE key = 0) q")
def knn_k_exceeds_n(spark, d):
    v = _vectors(spark, d)
    return knn.knn(v, _first_vector(v), v.count() + 1)


@query("SELECT vec_id AS key, 0.0::DOUBLE AS distance FROM embeddings WHERE false")
def knn_k_zero(spark, d):
    v = _vectors(spark, d)
    return knn.knn(v, _first_vector(v), 0)


@query("SELECT vec_id AS key, 0.0::DOUBLE AS distance FROM embeddings WHERE false")
def knn_dimension_mismatch(spark, d):
    return knn.knn(_vectors(spark, d), [1.0, 2.0], 10)


@query(f"WITH {_E}, g AS (SELECT q.key AS node, e.key AS neighbour, round(list_cosine_distance(e.v, q.v), 6) AS distance FROM e, e q WHERE q.key % 50 = 0 AND e.key <> q.key) SELECT node, neighbour, distance, row_number() OVER (PARTITION BY node ORDER BY distance, neighbour)::INTEGER AS rank FROM g QUALIFY rank <= 16")
def knn_graph_m16(spark, d):
    v = _vectors(spark, d)
    return knn.neighbour_graph(v, v.where("key % 50 = 0"), 16)


@query(f"WITH {_E}, h AS (SELECT e.key, round(list_cosine_distance(e.v, q.v), 6) AS distance FROM e, (SELECT v FROM e WHERE key = 0) q ORDER BY distance, key LIMIT 10) SELECT h.key, distance, lang, length(text) AS n_chars FROM h JOIN documents ON doc_id = h.key")
def semantic_join(spark, d):
    v = _vectors(spark, d)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), "lang", F.length("text").cast("long").alias("n_chars"))
    return knn.with_text(knn.knn(v, _first_vector(v), 10), docs, "key")


@query(f"""WITH {_ES}, p AS (SELECT a.key, a.v AS a, b.v AS b FROM e a JOIN e b ON b.key = a.key + 1)
SELECT key, round(sqrt(list_inner_product(a, a)), 6) AS magnitude, round(list_inner_product(a, b), 6) AS dot_product, round(list_cosine_similarity(a, b), 6) AS cosine_similarity,
round(list_cosine_distance(a, b), 6) AS cosine, round(list_distance(a, b), 6) AS euclidean, round(-list_inner_product(a, b), 6) AS dot_distance,
round(list_sum(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]))), 6) AS manhattan, round(a[1] / sqrt(list_inner_product(a, a)), 6) AS unit_first FROM p""")
def vec_all_metrics(spark, d):
    v = _vectors(spark, d, True).select("key", "vector")
    pairs = v.join(v.select((F.col("key") - 1).alias("key"), F.col("vector").alias("other")), "key")
    a, b = F.col("vector"), F.col("other")
    shown = {
        "magnitude": V.magnitude(a), "dot_product": V.dot_product(a, b), "cosine_similarity": V.cosine_similarity(a, b), "cosine": V.distance(a, b, "cosine"),
        "euclidean": V.distance(a, b, "L2"), "dot_distance": V.distance(a, b, "inner"), "manhattan": V.distance(a, b, "l1"), "unit_first": V.element(V.normalize(a), 0),
    }
    return pairs.select("key", *[F.round(x, 6).alias(n) for n, x in shown.items()])


@query("SELECT vec_id AS key, 0.0::DOUBLE AS cosine_similarity, 1.0::DOUBLE AS cosine_distance, 0.0::DOUBLE AS unit_first FROM embeddings")
def vec_zero_vector(spark, d):
    zero = V.literal([0.0] * 64)
    return _vectors(spark, d).select("key", F.round(V.cosine_similarity(F.col("vector"), zero), 6).alias("cosine_similarity"), F.round(V.cosine_distance(F.col("vector"), zero), 6).alias("cosine_distance"), V.element(V.normalize(zero), 0).alias("unit_first"))


@query("SELECT count(*) AS num_vectors, max(len(embedding))::INTEGER AS dimension, count(DISTINCT len(embedding)) AS n_dimensions, 'cosine' AS metric FROM embeddings")
def vec_stats(spark, d):
    return knn.vector_stats(_vectors(spark, d))


@query("SELECT vec_id AS key, embedding[1]::DOUBLE AS first_element, len(embedding)::INTEGER AS dimension FROM embeddings")
def vec_codec_roundtrip(spark, d):
    back = codec.decode(codec.encode(_vectors(spark, d).select("key", "vector"), "vector"), "value", "decoded")
    return back.where(F.col("decoded") == F.col("vector")).select("key", F.col("decoded")[0].cast("double").alias("first_element"), V.dimension(F.col("decoded")).alias("dimension"))


@query("SELECT vec_id AS key, len(embedding)::INTEGER AS dimension, true AS looks_like_vector FROM embeddings UNION ALL SELECT doc_id + 1000000, 0, false FROM documents")
def kv_render_kind(spark, d):
    v = codec.encode(_vectors(spark, d).select("key", "vector"), "vector").select("key", V.dimension(F.col("vector")).alias("dimension"), "value")
    docs = table(spark, d, "documents").select((F.col("doc_id") + 1000000).alias("key"), F.lit(0).alias("dimension"), F.col("text").cast("binary").alias("value"))
    return v.unionByName(docs).select("key", "dimension", codec.looks_like_vector(F.col("value")).alias("looks_like_vector"))


@query("""WITH t AS (SELECT vec_id AS key, CASE WHEN vec_id % 7 = 0 THEN '0.1,abc' WHEN vec_id % 7 = 1 THEN '1,2,' ELSE concat(vec_id, ',0.5,', label) END AS s FROM embeddings),
p AS (SELECT key, list_transform(string_split(s, ','), lambda x: TRY_CAST(trim(x) AS FLOAT)) AS v FROM t)
SELECT key, len(list_filter(v, lambda x: x IS NULL)) = 0 AS valid, CASE WHEN len(list_filter(v, lambda x: x IS NULL)) = 0 THEN list_sum(v)::DOUBLE END AS total FROM p""")
def vec_csv_parse(spark, d):
    k = F.col("vec_id")
    s = F.when(k % 7 == 0, "0.1,abc").when(k % 7 == 1, "1,2,").otherwise(F.concat_ws(",", k.cast("string"), F.lit("0.5"), F.col("label").cast("string")))
    v = V.parse_csv(s)
    rows = table(spark, d, "embeddings").select(k.alias("key"), v.alias("v"))
    return rows.select("key", F.col("v").isNotNull().alias("valid"), F.aggregate(V.doubles(F.col("v")), F.lit(0.0), lambda a, x: a + x).alias("total"))


@query(f"WITH {_E} SELECT e.key, greatest(5.0, round(100 - 10 * list_distance(e.v, q.v), 6))::DOUBLE AS bar FROM e, (SELECT v FROM e WHERE key = 0) q")
def vec_similarity_bar(spark, d):
    v = _vectors(spark, d)
    return v.select("key", F.round(V.similarity_bar(V.euclidean_distance(F.col("vector"), V.literal(_first_vector(v)))), 6).alias("bar"))


def _index(spark, d) -> index.CellIndex:
    """The index of all vectors, stored in the shared folder and read from there."""
    built = index.CellIndex.build(_vectors(spark, d), index.IndexConfig(dimension=64, n_cells=16))
    return built.write(f"{checkpoint_dir(spark)}/index")


@query()
def ivf_knn(spark, d):
    """Cells probed for every fiftieth vector; ivf_recall holds them against exact search."""
    return _index(spark, d).search_batch(_vectors(spark, d).where("key % 50 = 0"), 10)


@query("SELECT count(*)::BIGINT AS n_queries, true AS recall_is_enough FROM embeddings WHERE vec_id % 50 = 0")
def ivf_recall(spark, d):
    """Whether the index finds 0.9 or more of the ten nearest that exact search finds."""
    v = _vectors(spark, d)
    asked = v.where("key % 50 = 0")
    exact = knn.knn_join(v, asked, 10).select("query_id", "key")
    found = _index(spark, d).search_batch(asked, 10).select("query_id", "key", F.lit(1).alias("hit"))
    share = exact.join(found, ["query_id", "key"], "left").agg(F.countDistinct("query_id").alias("n_queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    return share.select("n_queries", (F.col("recall") >= 0.9).alias("recall_is_enough"))


@query("SELECT count(*)::BIGINT AS num_vectors, count(*) > 0 AS in_cells FROM embeddings")
def ivf_stats(spark, d):
    return _index(spark, d).stats().select("num_vectors", ((F.col("n_cells") > 0) & (F.col("largest_cell") <= F.col("num_vectors")) & (F.col("largest_cell") * 16 >= F.col("num_vectors"))).alias("in_cells"))


@query(f"WITH {_E} SELECT pos::BIGINT AS pos, k.key, len(v)::INTEGER AS dimension, round(v[1], 6) AS first_element FROM (VALUES (0, 7), (1, 123456789), (2, 0), (3, 7)) k(pos, key) LEFT JOIN e ON e.key = k.key")
def vec_batch_get(spark, d):
    keys = spark.createDataFrame([(0, 7), (1, 123456789), (2, 0), (3, 7)], "pos long, key long")
    got = kv.batch_get(_vectors(spark, d).withColumnRenamed("vector", "value"), keys)
    return got.select("pos", "key", F.when(F.col("value").isNotNull(), V.dimension(F.col("value"))).alias("dimension"), F.round(F.col("value")[0].cast("double"), 6).alias("first_element"))


@query(f"WITH {_E} SELECT key, len(v)::INTEGER AS dimension, round(list_sum(v), 4) AS total FROM e WHERE key = 42")
def vec_get(spark, d):
    hit = kv.get(_vectors(spark, d), 42)
    return hit.select("key", V.dimension(F.col("vector")).alias("dimension"), F.round(F.aggregate(F.transform("vector", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query(f"WITH {_ES}, p AS (SELECT vec_id AS key, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT p.key, round(CASE WHEN p.key % 3 = 0 THEN e.v[1] ELSE p.v[1] END, 6) AS first_element FROM p JOIN e ON e.key = p.key")
def vec_batch_put(spark, d):
    """Every third vector is written anew, scaled."""
    new = _vectors(spark, d, True).where("key % 3 = 0").select("key", "vector")
    held = oplog.put_vectors(_vectors(spark, d).select("key", "vector"), new, 64)
    return held.select("key", F.round(F.col("vector")[0].cast("double"), 6).alias("first_element"))


# -- entries ------------------------------------------------------------------------------------------


def _customers(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value"))


def _documents(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("key"), F.col("text").alias("value"))


_C = "SELECT c_name AS key, c_mktsegment AS value FROM customer"
_D = "(SELECT lpad(CAST(doc_id AS VARCHAR), 8, '0') AS key, text AS value FROM documents)"
_RANGE = ("Customer#000000050", "Customer#000000150")


@query(f"SELECT * FROM ({_C}) WHERE key = 'Customer#000000042'")
def kv_get(spark, d):
    return kv.get(_customers(spark, d), "Customer#000000042")


@query(f"SELECT * FROM ({_C}) WHERE key = 'nobody'")
def kv_get_missing(spark, d):
    return kv.get(_customers(spark, d), "nobody")


_KEYS = ["Customer#000000007", "missing_key", "Customer#000000001", "Customer#000000007"]


@query(f"SELECT pos::BIGINT AS pos, k.key, c.value FROM (VALUES {', '.join(f'({i}, {chr(39)}{k}{chr(39)})' for i, k in enumerate(_KEYS))}) k(pos, key) LEFT JOIN ({_C}) c ON c.key = k.key")
def kv_batch_get(spark, d):
    return kv.batch_get(_customers(spark, d), _KEYS)


def _add_scans() -> None:
    start, end = _RANGE
    base = f"SELECT key, value FROM ({_C}) WHERE key >= '{start}' AND key < '{end}'"
    cases = {
        "kv_scan": ({}, base), "kv_scan_reverse": ({"reverse": True}, base), "kv_scan_limit": ({"limit": 5}, f"{base} ORDER BY key LIMIT 5"),
        "kv_scan_reverse_limit": ({"reverse": True, "limit": 5}, f"{base} ORDER BY key DESC LIMIT 5"), "kv_scan_keys_only": ({"keys_only": True}, f"SELECT key, '' AS value FROM ({base})"),
    }
    for name, (options, sql) in cases.items():
        QUERIES[name] = lambda spark, d, options=options: kv.scan(_customers(spark, d), start, end, **options)
        ORACLES[name] = sql


_add_scans()


@query(f"SELECT * FROM ({_C}) WHERE false")
def kv_scan_empty(spark, d):
    return kv.scan(_customers(spark, d), _RANGE[1], _RANGE[0])


@query("SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus AS value FROM orders WHERE CAST(o_orderkey AS VARCHAR) >= '1' AND CAST(o_orderkey AS VARCHAR) < '2' ORDER BY key")
def kv_scan_large(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderstatus").alias("value"))
    return kv.scan(orders, "1", "2")


@query(f"SELECT key, length(value) AS n_chars FROM {_D}")
def kv_entries(spark, d):
    return kv.entries(_documents(spark, d)).select("key", F.length("value").cast("long").alias("n_chars"))


@query(f"SELECT key FROM {_D} ORDER BY key LIMIT 25 OFFSET 50")
def kv_page(spark, d):
    return kv.page(_documents(spark, d), 3, 25).select("key")


@query(f"SELECT key FROM {_D} WHERE contains(lower(key), 'licen') OR contains(lower(value), 'licen')")
def kv_search(spark, d):
    return kv.search(_documents(spark, d), "LICEN").select("key")


@query(f"SELECT key, CASE WHEN length(value) > 50 THEN value[1:50] || '...' ELSE value END AS shown, CASE WHEN strlen(value) < 1024 THEN strlen(value) || ' B' WHEN strlen(value) < 1048576 THEN printf('%.1f KB', round(strlen(value) / 1024, 1)) ELSE printf('%.1f MB', round(strlen(value) / 1048576, 1)) END AS size FROM {_D}")
def kv_preview(spark, d):
    return _documents(spark, d).select("key", T.preview(F.col("value"), 50).alias("shown"), T.human_bytes(F.octet_length("value")).alias("size"))


@query(f"SELECT key, 'kv' AS entry_type FROM {_D} UNION ALL SELECT lpad(CAST(vec_id AS VARCHAR), 8, '0'), 'vector' FROM embeddings")
def kv_browse_union(spark, d):
    vectors = _vectors(spark, d).select(F.lpad(F.col("key").cast("string"), 8, "0").alias("key"), "vector")
    return kv.browse(_documents(spark, d), vectors).select("key", "entry_type")


@query(f"SELECT key, CASE WHEN c_custkey % 3 = 0 THEN 'CHANGED' ELSE value END AS value FROM (SELECT c_custkey, c_name AS key, c_mktsegment AS value FROM customer)")
def kv_upsert(spark, d):
    changes = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_name").alias("key"), F.lit("CHANGED").alias("value"))
    return kv.upsert(_customers(spark, d), changes)


@query("SELECT c_name AS key, c_mktsegment AS value FROM customer WHERE c_custkey % 3 <> 0")
def kv_delete(spark, d):
    return kv.delete_keys(_customers(spark, d), table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_name").alias("key")))


@query(f"SELECT key, '{{\"key\":\"' || key || '\",\"value\":\"' || value || '\"}}' AS json FROM ({_C})")
def kv_export_json(spark, d):
    return _customers(spark, d).select("key", T.entry_json(F.col("key"), F.col("value")).alias("json"))


@query("SELECT split_part(t, ':', 1) AS key, t[strpos(t, ':') + 1:] AS value FROM (SELECT CASE WHEN c_custkey % 5 = 0 THEN c_name ELSE c_name || ':' || c_mktsegment || ':x' END AS t FROM customer) WHERE contains(t, ':')")
def kv_parse_tokens(spark, d):
    c = table(spark, d, "customer")
    token = F.when(F.col("c_custkey") % 5 == 0, F.col("c_name")).otherwise(F.concat_ws(":", "c_name", "c_mktsegment", F.lit("x")))
    return sources.parse_tokens(c.select(token.alias("token")))


@query("SELECT c_name AS key, c_mktsegment || '=' || c_custkey AS value FROM customer WHERE c_custkey % 4 > 1")
def kv_parse_lines(spark, d):
    k = F.col("c_custkey")
    line = F.when(k % 4 == 0, "  ").when(k % 4 == 1, F.concat(F.lit("="), "c_name")).otherwise(F.concat(F.lit(" "), "c_name", F.lit(" = "), "c_mktsegment", F.lit("="), k.cast("string"), F.lit(" ")))
    return sources.parse_lines(table(spark, d, "customer").select(line.alias("value")))


@query("SELECT 'key_' || i AS key, 'value_' || i AS value FROM range(1000) t(i)")
def generated_entries(spark, d):
    return generate.entries(spark, 1000)


@query()
def generated_vectors(spark, d):
    return generate.vectors(spark, 200, 16)


@query()
def kv_checksums(spark, d):
    """CRC-32 of every entry and of its page; SQL here has no such function, tests hold it against zlib."""
    docs = _documents(spark, d)
    return docs.select("key", T.checksum(F.col("value")).alias("crc"), T.page_checksum(F.col("key").cast("binary"), F.col("value").cast("binary")).alias("page_crc"))


# -- operations ---------------------------------------------------------------------------------------


def _log(spark, d) -> DataFrame:
    """Events as operations: an error deletes its user's entry, others put their properties."""
    op = F.when(F.col("event_type") == "error", oplog.DELETE).otherwise(oplog.PUT)
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").cast("string").alias("key"), F.col("props").alias("value"))


_L = "l AS (SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, CAST(user_id AS VARCHAR) AS key, props AS value FROM events)"
_LAST = "last AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)"


@query(f"WITH {_L}, {_LAST} SELECT key, value FROM last WHERE op = 'put'")
def oplog_state(spark, d):
    return oplog.current_state(_log(spark, d))


@query(f"WITH {_L}, {_LAST} SELECT key, seq FROM last WHERE op = 'delete'")
def oplog_tombstones(spark, d):
    return oplog.tombstones(_log(spark, d))


@query(f"WITH {_L}, {_LAST} SELECT (SELECT count(*) FROM l WHERE op = 'put') AS n_puts, (SELECT count(*) FROM l WHERE op = 'delete') AS n_deletes, count(*) FILTER (WHERE op = 'put') AS n_live, count(*) FILTER (WHERE op = 'delete') AS n_deleted FROM last")
def oplog_counts(spark, d):
    return oplog.counts(_log(spark, d))


@query(f"WITH {_L}, bl AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1), base AS (SELECT CAST(c_custkey AS VARCHAR) AS key, c_mktsegment AS value FROM customer) SELECT key, value FROM base WHERE key NOT IN (SELECT key FROM bl) UNION ALL SELECT key, value FROM bl WHERE op = 'put'")
def oplog_batch_order(spark, d):
    base = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_mktsegment").alias("value"))
    return oplog.apply_batch(base, _log(spark, d))


@query(f"WITH {_L}, del AS (SELECT key, max(seq) AS at FROM l WHERE op = 'delete' GROUP BY key) SELECT l.key, count(*) AS puts_after FROM l JOIN del ON del.key = l.key AND l.seq > del.at GROUP BY l.key")
def oplog_reinsert(spark, d):
    log = _log(spark, d)
    gone = log.where(F.col("op") == oplog.DELETE).groupBy("key").agg(F.max("seq").alias("at"))
    return log.join(gone, "key").where("seq > at").groupBy("key").agg(F.count(F.lit(1)).alias("puts_after"))


@query(f"WITH {_L}, {_LAST} SELECT (SELECT max(seq) FROM l) + 1 AS seq, 'delete' AS op, key FROM last WHERE op = 'put'")
def oplog_clear(spark, d):
    return oplog.clear(_log(spark, d)).select("seq", "op", "key")


def _wal(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("lsn"), F.col("user_id").alias("txn_id"), F.col("event_type").alias("type"))


_W = "(SELECT event_id AS lsn, user_id AS txn_id, event_type AS type FROM events)"


@query(f"SELECT * FROM {_W} WHERE lsn >= 500")
def wal_forward(spark, d):
    return oplog.wal_forward(_wal(spark, d), 500)


@query(f"SELECT * FROM {_W} WHERE lsn <= 300")
def wal_backward(spark, d):
    return oplog.wal_backward(_wal(spark, d), 300)


@query(f"SELECT * FROM {_W} WHERE lsn = 77")
def wal_lookup(spark, d):
    return oplog.wal_record(_wal(spark, d), 77)


# -- metrics ------------------------------------------------------------------------------------------

_ADD_OPS = "o AS (SELECT CASE WHEN event_type = 'view' THEN 'get' WHEN event_type = 'purchase' THEN 'put' ELSE event_type END AS kind, event_id % 10 <> 0 AS hit, value AS micros FROM events)"


@query(f"WITH {_ADD_OPS} SELECT count(*) FILTER (WHERE kind = 'get' AND hit) AS total_gets, count(*) FILTER (WHERE kind = 'put') AS total_puts, round(coalesce(avg(micros) FILTER (WHERE kind = 'get' AND hit), 0), 4) AS avg_get_time_us, round(coalesce(avg(micros) FILTER (WHERE kind = 'put'), 0), 4) AS avg_put_time_us, (SELECT count(*) FROM customer) AS total_entries FROM o")
def engine_stats(spark, d):
    kind = F.when(F.col("event_type") == "view", "get").when(F.col("event_type") == "purchase", "put").otherwise(F.col("event_type"))
    ops = table(spark, d, "events").select(kind.alias("kind"), (F.col("event_id") % 10 != 0).alias("hit"), F.col("value").alias("micros"))
    stats = metrics.engine_stats(ops, _customers(spark, d))
    return stats.withColumn("avg_get_time_us", F.round("avg_get_time_us", 4)).withColumn("avg_put_time_us", F.round("avg_put_time_us", 4))


@query("SELECT event_type, round(avg(value), 4) AS avg_latency FROM events GROUP BY event_type UNION ALL SELECT 'none', 0.0")
def avg_latency(spark, d):
    events = table(spark, d, "events")
    some = events.groupBy("event_type").agg(F.round(metrics.average_or_zero(F.col("value")), 4).alias("avg_latency"))
    return some.unionByName(events.where("event_type = 'none'").agg(F.lit("none").alias("event_type"), metrics.average_or_zero(F.col("value")).alias("avg_latency")))


def _observations(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_type").alias("name"), (F.col("value") / 100).alias("value"))


_BUCKETS = """ob AS (SELECT event_type AS name, value / 100 AS value FROM events), b AS (SELECT unnest([0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1, 5, 10, 'Infinity'::DOUBLE])::DOUBLE AS le),
g AS (SELECT name, le FROM (SELECT DISTINCT name FROM ob), b),
h AS (SELECT g.name, g.le, count(o.name) AS count FROM g LEFT JOIN (SELECT name, (SELECT min(le) FROM b WHERE value <= le) AS le FROM ob WHERE value IS NOT NULL) o ON o.name = g.name AND o.le = g.le GROUP BY ALL)"""


@query(f"WITH {_BUCKETS} SELECT name, CASE WHEN le = 'Infinity'::DOUBLE THEN -1 ELSE le END AS le, count FROM h")
def hist_bucket(spark, d):
    h = metrics.histogram(_observations(spark, d))
    return h.select("name", F.when(F.col("le") == float("inf"), -1.0).otherwise(F.col("le")).alias("le"), "count")


@query(f"WITH {_BUCKETS} SELECT name, CASE WHEN le = 'Infinity'::DOUBLE THEN -1 ELSE le END AS le, (sum(count) OVER (PARTITION BY name ORDER BY le))::BIGINT AS cumulative FROM h")
def hist_cumulative(spark, d):
    c = metrics.cumulative(metrics.histogram(_observations(spark, d)))
    return c.select("name", F.when(F.col("le") == float("inf"), -1.0).otherwise(F.col("le")).alias("le"), "cumulative")


@query("SELECT 'counter' AS type, event_type AS name, count(*)::DOUBLE AS value FROM events GROUP BY event_type UNION ALL SELECT 'gauge', event_type, arg_max(event_id, (ts, event_id))::DOUBLE FROM events GROUP BY event_type")
def counter_gauge(spark, d):
    events = table(spark, d, "events")
    counted = metrics.counters(events.select(F.col("event_type").alias("name"), F.lit(1.0).alias("value")))
    set_to = metrics.gauges(events.select(F.col("event_type").alias("name"), F.col("event_id").cast("double").alias("value"), F.struct("ts", "event_id").alias("ts")))
    return counted.select(F.lit("counter").alias("type"), "name", "value").unionByName(set_to.select(F.lit("gauge").alias("type"), "name", "value"))


@query("""WITH c AS (SELECT event_type AS name, count(*) AS n FROM events GROUP BY event_type)
SELECT name, 0 AS part, '# HELP ' || name || ' Total count' AS line FROM c UNION ALL SELECT name, 1, '# TYPE ' || name || ' counter' FROM c UNION ALL SELECT name, 2, name || ' ' || n FROM c""")
def prom_text(spark, d):
    counted = metrics.counters(table(spark, d, "events").select(F.col("event_type").alias("name"), F.lit(1.0).alias("value")))
    return metrics.prometheus_lines(counted.select("name", F.lit("counter").alias("type"), "value")).select("name", "part", "line")


@query(f"""WITH {_BUCKETS}, c AS (SELECT name, le, (sum(count) OVER (PARTITION BY name ORDER BY le))::BIGINT AS n FROM h)
SELECT name, name || '_bucket{{le="' || CASE WHEN le = 'Infinity'::DOUBLE THEN '+Inf' WHEN le >= 1 THEN CAST(le::INTEGER AS VARCHAR) ELSE CAST(le AS VARCHAR) END || '"}} ' || n AS line FROM c
UNION ALL SELECT name, name || '_count ' || count(value) FROM ob GROUP BY name""")
def prom_histogram(spark, d):
    empty = spark.createDataFrame([], "name string, type string, value double")
    lines = metrics.prometheus_lines(empty, _observations(spark, d))
    return lines.where("line like '%\\_bucket{%' or line like '%\\_count %'").select("name", "line")


@query("""WITH s AS (SELECT event_type AS name, ts, event_id::DOUBLE AS value FROM events)
SELECT name, strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, round((max(value) - min(value)) / 86400, 6) AS rate FROM s GROUP BY ALL""")
def rate_windows(spark, d):
    series = table(spark, d, "events").select(F.col("event_type").alias("name"), "ts", F.col("event_id").cast("double").alias("value"))
    r = metrics.rate(series, 86400)
    return r.select("name", F.date_format("window_start", "yyyy-MM-dd").alias("day"), F.round("rate", 6).alias("rate"))


@query("SELECT count(*) FILTER (WHERE event_type = 'view') AS hits, count(*) FILTER (WHERE event_type = 'click') AS misses, count(*) FILTER (WHERE event_type = 'signup') AS flushed, count(*) FILTER (WHERE event_type = 'error') AS evicted, round(count(*) FILTER (WHERE event_type = 'view') / count(*) FILTER (WHERE event_type IN ('view', 'click')), 6) AS hit_rate FROM events")
def cache_hit_rate(spark, d):
    kinds = F.create_map(*[F.lit(x) for pair in (("view", "hit"), ("click", "miss"), ("signup", "flush"), ("error", "evict")) for x in pair])
    stats = metrics.pool_stats(table(spark, d, "events").select(F.try_element_at(kinds, F.col("event_type")).alias("kind")))
    return stats.withColumn("hit_rate", F.round("hit_rate", 6))


@query("SELECT 'DEGRADED' AS status")
def health(spark, d):
    kinds = table(spark, d, "events").select(F.when(F.col("event_type") == "view", "database").otherwise(F.col("event_type")).alias("name"), (F.col("event_type") != "error").alias("ok"))
    return metrics.health(kinds)


@query("SELECT n_nationkey::BIGINT AS key, n_nationkey * 1000 * 4096 / 1048576.0 AS mb FROM nation")
def storage_size(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("key"), metrics.storage_mb(F.col("n_nationkey") * 1000).alias("mb"))


# -- audit, access, limits ----------------------------------------------------------------------------


def _audit(spark, d) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "LOGIN").when(F.col("event_type") == "error", "LOGIN_FAILED").when(F.col("event_type") == "click", "GET").when(F.col("event_type") == "purchase", "PUT").otherwise("UNAUTHORIZED")
    rows = table(spark, d, "events").select("ts", kind.alias("kind"), F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("username"), F.lit(None).cast("string").alias("ip"), F.col("event_id").cast("string").alias("subject"), (F.col("event_type") != "error").alias("success"), "event_id")
    return audit.entries(rows, "event_id")


_A = """a AS (SELECT ts, event_id, 'user' || user_id AS username, event_type <> 'error' AS success,
CASE event_type WHEN 'signup' THEN 'LOGIN' WHEN 'error' THEN 'LOGIN_FAILED' WHEN 'click' THEN 'GET' WHEN 'purchase' THEN 'PUT' ELSE 'UNAUTHORIZED' END AS event_type,
CASE event_type WHEN 'signup' THEN 'User logged in' WHEN 'error' THEN 'Login failed' WHEN 'click' THEN 'GET key: ' || event_id WHEN 'purchase' THEN 'PUT key: ' || event_id ELSE 'Unauthorized: ' || event_id END AS details FROM events)"""


@query(f"WITH {_A} SELECT event_id, event_type, details FROM a ORDER BY ts DESC, event_id DESC LIMIT 50")
def audit_recent(spark, d):
    return audit.recent(_audit(spark, d), 50, "event_id").select("event_id", "event_type", "details")


@query(f"WITH {_A} SELECT event_id, event_type, details FROM a WHERE username = 'user7' ORDER BY ts DESC, event_id DESC LIMIT 20")
def audit_by_user(spark, d):
    return audit.by_user(_audit(spark, d), "user7", 20, "event_id").select("event_id", "event_type", "details")


@query(f"WITH {_A} SELECT event_id, username, details FROM a WHERE event_type = 'LOGIN_FAILED' ORDER BY ts DESC, event_id DESC LIMIT 100")
def audit_by_type(spark, d):
    return audit.by_type(_audit(spark, d), "LOGIN_FAILED", 100, "event_id").select("event_id", "username", "details")


@query(f"WITH {_A} SELECT event_id, event_type FROM a WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-06 12:00:00'")
def audit_time_range(spark, d):
    start, end = (F.lit(x).cast("timestamp") for x in ("2024-01-05 00:00:00", "2024-01-06 12:00:00"))
    return audit.in_range(_audit(spark, d), start, end, "event_id").select("event_id", "event_type")


@query(f"WITH {_A} SELECT count(*) AS total, count(*) FILTER (WHERE event_type = 'LOGIN_FAILED') AS failed_logins, count(*) FILTER (WHERE event_type = 'UNAUTHORIZED') AS unauthorized FROM a")
def audit_counts(spark, d):
    return audit.counts(_audit(spark, d))


@query(f"""WITH {_A} SELECT event_id, '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] ' || CASE WHEN success THEN 'SUCCESS' ELSE 'FAILURE' END || ' User:' || username || ' IP: Details:' || details AS line,
'{{"timestamp":"' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '","success":' || success || ',"username":"' || username || '","ip_address":"","details":"' || details || '"}}' AS json FROM a""")
def audit_lines(spark, d):
    return _audit(spark, d).select("event_id", audit.text_line().alias("line"), audit.json_line().alias("json"))


@query("""SELECT c_name AS username, c_mktsegment IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY') AS can_read, c_mktsegment IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY') AS can_write,
c_mktsegment IN ('BUILDING', 'MACHINERY') AS can_delete, c_mktsegment IN ('BUILDING', 'MACHINERY') AS is_admin FROM customer""")
def rbac(spark, d):
    segment = F.col("c_mktsegment")
    roles = F.when(segment == "BUILDING", F.array(F.lit("admin"))).when(segment == "AUTOMOBILE", F.array(F.lit("user"))).when(segment == "MACHINERY", F.array(F.lit("user"), F.lit("admin"))).otherwise(F.array(F.lit("guest")))
    return access.permissions(table(spark, d, "customer").select(F.col("c_name").alias("username"), roles.alias("roles")))


@query("WITH s AS (SELECT user_id, max(ts) AS last FROM events GROUP BY user_id) SELECT user_id FROM s WHERE floor((epoch_us(TIMESTAMP '2024-01-30 00:00:00') - epoch_us(last)) / 60000000) < 1440")
def active_sessions(spark, d):
    s = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last_activity")).withColumn("is_valid", F.lit(True))
    return access.active_sessions(s, F.lit("2024-01-30 00:00:00").cast("timestamp"), 1440).select("user_id")


@query("SELECT e.event_id, c_name AS username FROM events e JOIN customer ON c_custkey = user_id")
def session_users(spark, d):
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("username"), "c_name")
    s = table(spark, d, "events").select(F.col("user_id").alias("username"), "event_id")
    return access.session_users(s, users).select("event_id", F.col("c_name").alias("username"))


@query("""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN floor((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 60000000) >= 30 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session_no FROM g)
SELECT user_id, session_no::BIGINT AS session_no, count(*) AS n_events, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ended FROM s GROUP BY user_id, session_no""")
def sessionize_30m(spark, d):
    s = access.sessionize(table(spark, d, "events"))
    return s.select("user_id", "session_no", "n_events", T.time_text(F.col("started")).alias("started"), T.time_text(F.col("ended")).alias("ended"))


def _sessions(spark, d) -> DataFrame:
    s = table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("session_id")).agg(F.max("ts").alias("last_activity"))
    return s.withColumn("is_valid", F.lit(True))


_S = "s AS (SELECT CAST(user_id AS VARCHAR) AS session_id, max(ts) AS last_activity FROM events GROUP BY user_id)"


@query(f"WITH {_S} SELECT session_id, session_id <> '7' AS is_valid FROM s")
def session_invalidate(spark, d):
    return access.invalidate(_sessions(spark, d), "7").select("session_id", "is_valid")


@query(f"WITH {_S} SELECT session_id, strftime(CASE WHEN session_id = '7' AND epoch_us(TIMESTAMP '2024-02-01') - epoch_us(last_activity) < 7776000000000 THEN TIMESTAMP '2024-02-01' ELSE last_activity END, '%Y-%m-%d %H:%M:%S') AS last_activity FROM s")
def session_refresh(spark, d):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return access.refresh(_sessions(spark, d), "7", now, 90 * 1440).select("session_id", T.time_text(F.col("last_activity")).alias("last_activity"))


def _users(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_name").alias("username"), F.array(F.lower("c_mktsegment")).alias("roles"), F.lit(True).alias("is_active"))


@query("SELECT c_name AS username, lower(c_mktsegment) AS roles, true AS is_active FROM customer UNION ALL SELECT 'new one', 'user', true")
def user_create(spark, d):
    return access.create_user(_users(spark, d), "new one").select("username", F.concat_ws(",", "roles").alias("roles"), "is_active")


@query("SELECT c_name AS username, c_custkey <> 3 AS is_active FROM customer")
def user_deactivate(spark, d):
    users = _users(spark, d)
    name = table(spark, d, "customer").where("c_custkey = 3").first()["c_name"]
    return access.deactivate(users, name).select("username", "is_active")


_BUCKET = """r AS (SELECT user_id, event_id, epoch_us(ts) AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id, event_id, sec, n, 3.0::DOUBLE AS tokens, true AS allowed FROM r WHERE n = 1
  UNION ALL SELECT r.user_id, r.event_id, r.sec, r.n, least(3.0, f.tokens + (r.sec - f.sec) / 1e6 / 86400) - CASE WHEN least(3.0, f.tokens + (r.sec - f.sec) / 1e6 / 86400) >= 1 THEN 1 ELSE 0 END, least(3.0, f.tokens + (r.sec - f.sec) / 1e6 / 86400) >= 1
  FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1)"""


def _decided(spark, d) -> DataFrame:
    requests = table(spark, d, "events").select(F.col("user_id").alias("client"), "ts", F.col("event_id").alias("request_id"), F.col("event_type").alias("endpoint"))
    return limiter.decisions(requests, 1 / 86400, 3.0)


@query(f"WITH RECURSIVE {_BUCKET} SELECT user_id AS client, event_id AS request_id, allowed FROM f")
def limiter_decisions(spark, d):
    return _decided(spark, d).select("client", "request_id", "allowed")


@query(f"WITH RECURSIVE {_BUCKET} SELECT count(DISTINCT user_id) AS clients, count(*) AS total, count(*) FILTER (WHERE allowed) AS allowed, count(*) FILTER (WHERE NOT allowed) AS denied, round(100.0 * count(*) FILTER (WHERE allowed) / count(*), 6)::DOUBLE AS allow_rate FROM f")
def limiter_stats(spark, d):
    return limiter.stats(_decided(spark, d)).withColumn("allow_rate", F.round("allow_rate", 6))


@query("SELECT event_type AS endpoint, count(DISTINCT user_id) AS clients, count(*) AS total FROM events GROUP BY event_type")
def limiter_endpoints(spark, d):
    requests = table(spark, d, "events").select(F.col("user_id").alias("client"), "ts", F.col("event_id").alias("request_id"), F.col("event_type").alias("endpoint"))
    decided = limiter.by_endpoint(requests, {"purchase": (0.001, 2.0), "click": (0.01, 5.0)})
    return limiter.stats(decided, ["endpoint"]).select("endpoint", "clients", "total")


@query("""WITH a AS (SELECT user_id AS frame, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events),
k AS (SELECT f.frame, coalesce((epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(a.ts)) / 1e6, 'Infinity'::DOUBLE) AS distance FROM (SELECT DISTINCT frame FROM a) f LEFT JOIN a ON a.frame = f.frame AND r = 2)
SELECT frame, round(distance, 3) AS distance FROM k ORDER BY k.distance DESC, frame LIMIT 1""")
def lruk_victim(spark, d):
    accesses = table(spark, d, "events").select(F.col("user_id").alias("frame"), "ts")
    return cache.victim(accesses, F.lit("2024-02-01 00:00:00").cast("timestamp")).select("frame", F.round("distance", 3).alias("distance"))


@query("SELECT doc_id, quality FROM labels WHERE toxic = 0 AND doc_id IN (SELECT vec_id FROM embeddings)")
def evictable_frames(spark, d):
    frames = table(spark, d, "labels").select("doc_id", "quality", F.col("toxic").alias("pin_count"))
    held = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return cache.evictable(frames).join(held, "doc_id", "left_semi").select("doc_id", "quality")


# -- streams ------------------------------------------------------------------------------------------


def _event_stream(spark, d) -> DataFrame:
    path = f"{d.rstrip('/')}/events.parquet"
    now = spark.read.parquet(path)
    reader = spark.readStream.schema(now.schema)
    if any(f.endswith("/events.parquet") for f in now.inputFiles()):  # one file: a stream reads folders
        return reader.option("pathGlobFilter", "events.parquet").parquet(d)
    return reader.parquet(path)


@query(f"WITH {_L}, {_LAST} SELECT key, value FROM last WHERE op = 'put'")
def streaming_oplog_state(spark, d):
    op = F.when(F.col("event_type") == "error", oplog.DELETE).otherwise(oplog.PUT)
    log = _event_stream(spark, d).select(F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").cast("string").alias("key"), F.col("props").alias("value"))
    return oplog.current_state(drain(stateful.op_log_state(log), "update"))


@query(f"WITH RECURSIVE {_BUCKET} SELECT user_id AS client, event_id AS request_id, allowed FROM f")
def streaming_limiter(spark, d):
    requests = _event_stream(spark, d).select(F.col("user_id").alias("client"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("request_id"))
    return drain(stateful.limiter_decisions(requests, 1 / 86400, 3.0)).select("client", "request_id", "allowed")


@query("""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN floor((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 60000000) >= 30 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session_no FROM g)
SELECT user_id, count(*) AS n_events, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ended FROM s GROUP BY user_id, session_no""")
def streaming_sessions(spark, d):
    """Sessions that the watermark has closed, and those open at the end of the stream."""
    events = _event_stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    now = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = stateful.with_open_sessions(drain(stateful.sessions(events)), now)
    return s.select("user_id", "n_events", T.time_text(F.col("started")).alias("started"), T.time_text(F.col("ended")).alias("ended"))
