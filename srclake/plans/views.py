"""Fact views over the driver's tables (analogues, not claims that the data is code), as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def files(self) -> DataFrame:
        """id, path, filename, type, content, hash of each document."""
        d = self.table("documents")
        return d.select(F.col("doc_id").alias("id"), F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.col("lang").alias("type"), F.col("text").alias("content"), F.sha1("text").alias("hash"), F.col("n_chars"))

    def url_files(self) -> DataFrame:
        """page_id and path: the URL without scheme, query and fragment."""
        p = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", ""))
        return self.table("pages").select("page_id", p.alias("path"))

    def types(self) -> DataFrame:
        """entity and path of each part."""
        return self.table("part").select(F.col("p_partkey").alias("entity"), F.concat(F.lit("/"), "p_brand", F.lit("/"), "p_type", F.lit("/"), F.col("p_partkey").cast("string")).alias("path"))

    def dependencies(self) -> DataFrame:
        """entity, dependency (a bag): parts of one order, an earlier line of quantity 40 or more on a later one."""
        li = self.table("lineitem")
        a = li.where("l_quantity >= 40").select("l_orderkey", F.col("l_partkey").alias("entity"), F.col("l_linenumber").alias("n"))
        b = li.select("l_orderkey", F.col("l_partkey").alias("dependency"), F.col("l_linenumber").alias("m"))
        return a.join(b, "l_orderkey").where("n < m AND entity <> dependency").select("entity", "dependency")

    def modules(self) -> DataFrame:
        return self.table("part").select(F.concat(F.lit("/"), "p_brand").alias("dir")).distinct()

    def relations(self, kind: str | None = None) -> DataFrame:
        """lhs, rhs, kind: users of successive events of a type with value 60 or more."""
        e = self.table("events").where("value >= 60")
        if kind is not None:
            e = e.where(F.col("event_type") == kind)
        w = Window.partitionBy("event_type").orderBy("ts", "event_id")
        return e.select(F.col("user_id").alias("lhs"), F.lead("user_id").over(w).alias("rhs"), F.col("event_type").alias("kind")).where("rhs IS NOT NULL")

    def file_edges(self) -> DataFrame:
        """src, dst paths: supplier -> part of each line item."""
        return self.table("lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))

    def file_dirs(self) -> DataFrame:
        """file, dir of suppliers (/region/nation) and parts (/brand)."""
        n = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name").alias("dir"))
        s = self.table("supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("s"), "s_suppkey").alias("file"), "dir")
        return s.unionByName(self.table("part").select(F.concat(F.lit("p"), "p_partkey").alias("file"), F.concat(F.lit("/parts/"), "p_brand").alias("dir")))

    def tree(self) -> DataFrame:
        """path, is_dir: region / nation / customer."""
        r, n, c = self.table("region"), self.table("nation"), self.table("customer")
        nr = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
        reg = r.select(F.concat(F.lit("/"), "r_name").alias("path"), F.lit(True).alias("is_dir"))
        nat = nr.select(F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name").alias("path"), F.lit(True).alias("is_dir"))
        cus = c.join(F.broadcast(nr), F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name", F.lit("/"), "c_name").alias("path"), F.lit(False).alias("is_dir"))
        return reg.unionByName(nat).unionByName(cus)

    def scopes(self) -> DataFrame:
        """Line pairs of documents as scopes: lines 2k+1 to 2k+2 of each document."""
        n = self.table("documents").select(F.col("doc_id").alias("file_id"), (F.size(F.split("text", "\n"))).alias("lines"))
        k = n.select("file_id", F.explode(F.sequence(F.lit(0), F.floor((F.col("lines") - 1) / 2).cast("int"))).alias("k"))
        return k.select("file_id", F.col("k").alias("scope"), (2 * F.col("k") + 1).alias("start_line"), F.lit(0).alias("start_col"), (2 * F.col("k") + 2).alias("end_line"), F.lit(1_000_000).alias("end_col"))

    def nodes(self, term: str) -> DataFrame:
        """Occurrences of a term: file_id, start and end (token ordinals as columns)."""
        from ..operators import search

        t = search.token_lines(self.table("documents")).where(F.col("term") == term)
        return t.select(F.col("doc_id").alias("file_id"), F.col("line").alias("start_line"), F.col("ordinal").alias("start_col"), F.col("line").alias("end_line"), (F.col("ordinal") + 1).alias("end_col"))

    def cohesion(self) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """types (nations), fields (brands of their orders), methods (orders), uses (line items)."""
        c = self.table("customer").select("c_custkey", F.col("c_nationkey").alias("type"))
        o = self.table("orders").select("o_orderkey", "o_custkey")
        methods = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("type", F.col("o_orderkey").alias("method"))
        p = self.table("part").select("p_partkey", F.col("p_brand").alias("field"))
        uses = self.table("lineitem").select(F.col("l_orderkey").alias("method"), "l_partkey").join(p, F.col("l_partkey") == F.col("p_partkey")).select("method", "field").distinct()
        fields = uses.join(methods, "method").select("type", "field").distinct()
        return self.table("nation").select(F.col("n_nationkey").alias("type")), fields, methods, uses

    def commits(self) -> DataFrame:
        w = Window.partitionBy("user_id").orderBy("ts", "event_id")
        e = self.table("events")
        return e.select(F.col("event_id").cast("string").alias("oid"), F.col("event_type").alias("message"), F.col("user_id").cast("string").alias("author"), F.col("user_id").cast("string").alias("committer"), F.unix_timestamp("ts").alias("time"), F.lag("event_id").over(w).cast("string").alias("parent"))

    def metrics(self) -> DataFrame:
        """id, type, value: measures of line items by part."""
        m = F.array(*(F.struct(F.lit(i + 1).alias("type"), F.col(c).alias("value")) for i, c in enumerate(("l_quantity", "l_extendedprice", "l_discount"))))
        return self.table("lineitem").select(F.col("l_partkey").alias("id"), F.explode(m).alias("m")).select("id", "m.type", "m.value")


FILES = "(SELECT doc_id AS id, '/' || source || '/' || lang || '/' || doc_id AS path, CAST(doc_id AS VARCHAR) AS filename, lang AS type, text AS content, sha1(text) AS hash, n_chars FROM documents)"
URLS = "(SELECT page_id, '/' || regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages)"
TYPES = "(SELECT p_partkey AS entity, '/' || p_brand || '/' || p_type || '/' || p_partkey AS path FROM part)"
DEPS = "(SELECT a.l_partkey AS entity, b.l_partkey AS dependency FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.l_partkey <> b.l_partkey WHERE a.l_quantity >= 40)"
MODULES = "(SELECT DISTINCT '/' || p_brand AS dir FROM part)"
LOCATED = f"(SELECT entity, dependency, x.path AS entity_path, y.path AS dependency_path FROM {DEPS} d JOIN {TYPES} x USING (entity) JOIN {TYPES.replace('AS entity', 'AS dependency')} y USING (dependency))"
RELATIONS = "(SELECT * FROM (SELECT user_id AS lhs, lead(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rhs, event_type AS kind FROM events WHERE value >= 60) WHERE rhs IS NOT NULL)"
EDGES = "(SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem)"
DIRS = "(SELECT 's' || s_suppkey AS file, '/' || r_name || '/' || n_name AS dir FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'p' || p_partkey, '/parts/' || p_brand FROM part)"
TREE = "(SELECT '/' || r_name AS path, true AS is_dir FROM region UNION ALL SELECT '/' || r_name || '/' || n_name, true FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT '/' || r_name || '/' || n_name || '/' || c_name, false FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
SCOPES = "(SELECT doc_id AS file_id, k AS scope, 2 * k + 1 AS start_line, 2 * k + 2 AS end_line FROM documents, unnest(range(0, (len(string_split(text, chr(10))) - 1) // 2 + 1)) u(k))"
TOKEN_LINES = r"(SELECT doc_id, line, unnest(range(0, len(ts))) AS ordinal, unnest(ts) AS term FROM (SELECT doc_id, line, [lower(t) FOR t IN regexp_extract_all(l, '[\p{Lu}\p{Ll}\p{Lt}\p{Lm}\p{Lo}\p{Nd}\p{Pc}#]+')] AS ts FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents)))"
POSTINGS = r"(SELECT doc_id, unnest(range(0, len(ts))) AS position, unnest(ts) AS term FROM (SELECT doc_id, [lower(t) FOR t IN regexp_extract_all(text, '[\p{Lu}\p{Ll}\p{Lt}\p{Lm}\p{Lo}\p{Nd}\p{Pc}#]+')] AS ts FROM documents))"
#: Terms with character offsets from 0 (end exclusive), and lines with theirs.
OFFSETS = r"""(SELECT doc_id, position, lower(raw) AS term, stop - length(raw) AS start, stop FROM (
  SELECT doc_id, position, raw, CAST(sum(length(gap) + length(raw)) OVER (PARTITION BY doc_id ORDER BY position) AS BIGINT) AS stop FROM (
    SELECT doc_id, unnest(range(0, len(ts))) AS position, unnest(ts) AS raw, unnest(gaps[1:len(ts)]) AS gap FROM (
      SELECT doc_id, regexp_extract_all(text, '[\p{Lu}\p{Ll}\p{Lt}\p{Lm}\p{Lo}\p{Nd}\p{Pc}#]+') AS ts, regexp_split_to_array(text, '[\p{Lu}\p{Ll}\p{Lt}\p{Lm}\p{Lo}\p{Nd}\p{Pc}#]+') AS gaps FROM documents))))"""
LINES = "(SELECT doc_id, line, following - length(l) - 1 AS start FROM (SELECT doc_id, line, l, CAST(sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY line) AS BIGINT) AS following FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents)))"
METRICS = "(SELECT l_partkey AS id, 1 AS type, l_quantity AS value FROM lineitem UNION ALL SELECT l_partkey, 2, l_extendedprice FROM lineitem UNION ALL SELECT l_partkey, 3, l_discount FROM lineitem)"
COMMITS = "(SELECT CAST(event_id AS VARCHAR) AS oid, event_type AS message, CAST(user_id AS VARCHAR) AS author, CAST(floor(epoch(ts)) AS BIGINT) AS time, CAST(lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS VARCHAR) AS parent FROM events)"


def under(path: str, directory: str) -> str:
    return f"({path} = {directory} OR starts_with({path}, {directory} || '/'))"
