"""Graph operators over edge tables (GR*).

Loops run on the driver, one bounded set of joins a round; each round's new rows are cut with checkpoint() in the shared
folder, once, so a lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr
from ..store import cut


def bfs(edges: DataFrame, starts: DataFrame, max_depth: int | None = None, src: str = "src", dst: str = "dst", start: str = "start") -> DataFrame:
    """GR1: start, node, depth of all nodes reached from each start (true depth; the start itself only if on a cycle)."""
    e = edges.select(F.col(src).alias("_s"), F.col(dst).alias("node")).distinct()
    front = starts.select(F.col(start).alias("start"), F.col(start).alias("_s")).distinct()
    seen, depth = None, 0  # the union of the rounds' tables, each stored once
    while max_depth is None or depth < max_depth:
        depth += 1
        step = front.join(e, "_s").select("start", "node").distinct()
        if seen is not None:
            step = step.join(seen.select("start", "node"), ["start", "node"], "left_anti")
        step = cut(step.withColumn("depth", F.lit(depth)))
        if step.isEmpty():
            break
        seen = step if seen is None else seen.unionByName(step)
        front = step.select("start", F.col("node").alias("_s"))
    if seen is None:
        return front.select("start", F.col("_s").alias("node"), F.lit(0).alias("depth")).limit(0)
    return seen


def bfs_compat(edges: DataFrame, start: int, level: int, src: str = "src", dst: str = "dst") -> DataFrame:
    """GR1 with the count of expanded nodes as limit (Q1): neighbours in order of id, at most `level` nodes expanded
    (-1: all; below: none).  src, dst of the traversed edges.  The frontier is a queue on the driver of at most `level`
    nodes' neighbours."""
    if level == -1:
        reached = bfs(edges, edges.sparkSession.createDataFrame([(start,)], "start long"), None, src, dst).select(F.col("node").alias(src))
        first = edges.sparkSession.createDataFrame([(start,)], f"{src} long")
        return edges.join(reached.unionByName(first).distinct(), src, "left_semi").select(src, dst).distinct()
    queue, done, out = [start], set(), []
    for _ in range(max(level, 0)):
        if not queue:
            break
        node = queue.pop(0)
        for r in edges.where(F.col(src) == node).select(dst).distinct().orderBy(dst).collect():
            out.append((node, r[0]))
            if r[0] not in done:
                done.add(r[0])
                queue.append(r[0])
    return edges.sparkSession.createDataFrame(out, f"{src} long, {dst} long")


def closure(edges: DataFrame, starts: DataFrame, reverse: bool = False, src: str = "src", dst: str = "dst", start: str = "start") -> DataFrame:
    """GR2: start, node of the transitive closure; a start is not its own unless on a cycle."""
    a, b = (dst, src) if reverse else (src, dst)
    return bfs(edges, starts, None, a, b, start).select("start", "node")


def impact(includes: DataFrame, modified: DataFrame, includer: str = "includer", included: str = "included", file: str = "file_id") -> DataFrame:
    """GR3: modified files and all that include them, directly or not."""
    m = modified.select(F.col(file).alias("node")).distinct()
    e = includes.select(F.col(included).alias("_s"), F.col(includer).alias("node")).distinct()
    seen = cut(m)
    front = seen
    while True:
        step = cut(front.withColumnRenamed("node", "_s").join(e, "_s").select("node").distinct().join(seen, "node", "left_anti"))
        if step.isEmpty():
            return seen.withColumnRenamed("node", file)
        seen, front = seen.unionByName(step), step


def topological_levels(nodes: DataFrame, edges: DataFrame, node: str = "id", src: str = "src", dst: str = "dst") -> DataFrame:
    """GR4: id, level: nodes without incoming edges, then those left without when these are gone, and so on; if all
    that are left have incoming edges, they are the last level together."""
    left = cut(nodes.select(F.col(node).alias("id")).distinct())
    live = cut(edges.where(F.col(src) != F.col(dst)).select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct())
    out, level = None, 0
    while not left.isEmpty():
        free = left.join(live.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
        free = cut(free.withColumn("level", F.lit(level)))
        if free.isEmpty():
            free = cut(left.withColumn("level", F.lit(level)))
        out = free if out is None else out.unionByName(free)
        left = cut(left.join(free, "id", "left_anti"))
        live = cut(live.join(free.select(F.col("id").alias("src")), "src", "left_anti"))
        level += 1
    return out if out is not None else left.withColumn("level", F.lit(0))


def neighbours(edges: DataFrame, starts: DataFrame, kind: str | None = None, reverse: bool = False, src: str = "src", dst: str = "dst", start: str = "start") -> DataFrame:
    """GR8-GR10: one hop over edges of a kind."""
    a, b = (dst, src) if reverse else (src, dst)
    e = edges if kind is None else edges.where(F.col("type") == kind)
    return starts.select(F.col(start).alias(a)).distinct().join(e, a).select(F.col(a).alias("start"), F.col(b).alias("node"))


def build_sources(targets: DataFrame, sources: DataFrame, file: DataFrame) -> DataFrame:
    """GR11, JN14: sources of a target's actions (repeats kept)."""
    return file.select("file_id").join(targets, "file_id").select(F.col("file_id").alias("start"), "action_id").join(sources.select("action_id", F.col("file_id").alias("node")), "action_id").select("start", "node")


def build_targets(targets: DataFrame, sources: DataFrame, file: DataFrame) -> DataFrame:
    """GR11, JN14 reversed: distinct targets of a source."""
    return build_sources(sources, targets, file).distinct()


def lifted(edges: DataFrame, files: DataFrame, src: str = "src", dst: str = "dst", file: str = "file", directory: str = "dir") -> DataFrame:
    """GR13, GR14: distinct directory edges of file edges, without loops.  files: file, dir."""
    d = files.select(F.col(file).alias("_f"), F.col(directory).alias("_d"))
    x = edges.join(d.select(F.col("_f").alias(src), F.col("_d").alias("src_dir")), src)
    x = x.join(d.select(F.col("_f").alias(dst), F.col("_d").alias("dst_dir")), dst)
    return x.where("src_dir <> dst_dir").select("src_dir", "dst_dir").distinct()


def external(dir_edges: DataFrame, root: str) -> DataFrame:
    """GR17: directory edges that leave the root's subtree (the root included)."""
    return dir_edges.where(expr.under("src_dir", F.lit(root)) & ~expr.under("dst_dir", F.lit(root)))


def external_users(dir_edges: DataFrame, root: str) -> DataFrame:
    """GR18: directories that reach, by any number of edges, a subdirectory of the root (not the root itself, Q11)."""
    below = dir_edges.select(F.col("dst_dir").alias("dir")).where(expr.under("dir", F.lit(root)) & (F.col("dir") != root))
    reached = impact(dir_edges, below, "src_dir", "dst_dir", "dir")
    return reached.where(~expr.under("dir", F.lit(root))).select(F.col("dir").alias("node"))


def internal(dir_edges: DataFrame, root: str) -> DataFrame:
    """GR20: directory edges within the root's subtree."""
    return dir_edges.where(expr.under("src_dir", F.lit(root)) & expr.under("dst_dir", F.lit(root)))


def component_users(edges: DataFrame, targets: DataFrame, sources: DataFrame, file_id: int) -> DataFrame:
    """GR15: edges (src, dst, type): provides of the file, users of those without limit, targets holding these."""
    spark = edges.sparkSession
    me = spark.createDataFrame([(file_id,)], "start long")
    provided = neighbours(edges, me, "PROVIDE").select(F.col("start").alias("src"), F.col("node").alias("dst"), F.lit("PROVIDE").alias("type"))
    heads = provided.select(F.col("dst").alias("start")).unionByName(me).distinct()
    users = closure(edges.where("type = 'USE'"), heads, True).select("node").unionByName(heads.select(F.col("start").alias("node"))).distinct()
    use = edges.where("type = 'USE'").join(users.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst", "type")
    held = sources.join(targets.withColumnRenamed("file_id", "t"), "action_id").select(F.col("t").alias("src"), F.col("file_id").alias("dst"))
    inside = closure(held, users.withColumnRenamed("node", "start"), True).select("node").unionByName(users).distinct()
    contains = held.join(inside.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst", F.lit("CONTAINS").alias("type"))
    return provided.unionByName(use).unionByName(contains).distinct()


def include_dependency(edges: DataFrame, file_id: int, levels: int = 3) -> DataFrame:
    """GR16: USE and PROVIDE edges, both ways, within `levels` steps."""
    me = edges.sparkSession.createDataFrame([(file_id,)], "start long")
    out = None
    for kind in ("USE", "PROVIDE"):
        e = edges.where(F.col("type") == kind)
        for a, b in (("src", "dst"), ("dst", "src")):
            near = bfs(e, me, levels - 1, a, b).select(F.col("node").alias(a)).unionByName(me.withColumnRenamed("start", a)).distinct()
            got = e.join(near, a, "left_semi").select("src", "dst", "type")
            out = got if out is None else out.unionByName(got)
    return out.distinct()


def interface(edges: DataFrame, includes: DataFrame, file_id: int) -> DataFrame:
    """GR19: one step over PROVIDE, USE and includes, both ways."""
    both = edges.select("src", "dst", "type").unionByName(includes.select(F.col("includer").alias("src"), F.col("included").alias("dst"), F.lit("INCLUDE").alias("type")))
    return both.where((F.col("src") == file_id) | (F.col("dst") == file_id)).distinct()


def merged_edges(edges: DataFrame, label: str, src: str = "src", dst: str = "dst") -> DataFrame:
    """GR23: parallel edges as one, labels joined by ', ' in order."""
    return edges.groupBy(src, dst).agg(F.array_join(F.array_sort(F.collect_list(label)), ", ").alias("label"))


class Graph:
    """GR27: nodes(id, attrs), edges(src, dst, attrs), clusters(cluster, parent, attrs) and members(cluster, id) as tables;
    a node is in one cluster at most, a cluster in one other."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, clusters: DataFrame | None = None, members: DataFrame | None = None):
        self.nodes, self.edges = nodes, edges
        spark, kind = nodes.sparkSession, nodes.schema["id"].dataType.simpleString()
        self.clusters = spark.createDataFrame([], "cluster string, parent string, attrs map<string,string>") if clusters is None else clusters
        self.members = spark.createDataFrame([], f"cluster string, id {kind}") if members is None else members

    def _with(self, **new: DataFrame) -> Graph:
        return Graph(**({"nodes": self.nodes, "edges": self.edges, "clusters": self.clusters, "members": self.members} | new))

    @staticmethod
    def of(edges: DataFrame) -> Graph:
        empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
        e = edges.select("src", "dst", *([F.map_from_arrays(F.array(F.lit("label")), F.array(F.col("type").cast("string"))).alias("attrs")] if "type" in edges.columns else [empty.alias("attrs")]))
        ids = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()
        return Graph(ids.withColumn("attrs", empty), e)

    def with_node(self, node, attrs: dict[str, str] | None = None) -> Graph:
        row = self.nodes.sparkSession.createDataFrame([(node, attrs or {})], self.nodes.schema)
        return self._with(nodes=self.nodes.where(F.col("id") != node).unionByName(row))

    def with_edge(self, src, dst, attrs: dict[str, str] | None = None) -> Graph:
        row = self.edges.sparkSession.createDataFrame([(src, dst, attrs or {})], self.edges.schema)
        return self._with(edges=self.edges.unionByName(row))

    def without_node(self, node) -> Graph:
        return self._with(nodes=self.nodes.where(F.col("id") != node), edges=self.edges.where((F.col("src") != node) & (F.col("dst") != node)), members=self.members.where(F.col("id") != node))

    def without_edge(self, src, dst) -> Graph:
        return self._with(edges=self.edges.where(~((F.col("src") == src) & (F.col("dst") == dst))))

    def has_node(self, node) -> bool:
        return not self.nodes.where(F.col("id") == node).isEmpty()

    def has_edge(self, src, dst) -> bool:
        return not self.edges.where((F.col("src") == src) & (F.col("dst") == dst)).isEmpty()

    def children(self, node) -> DataFrame:
        return self.edges.where(F.col("src") == node).select(F.col("dst").alias("id")).distinct()

    def parents(self, node) -> DataFrame:
        return self.edges.where(F.col("dst") == node).select(F.col("src").alias("id")).distinct()

    def with_attribute(self, node, key: str, value: str) -> Graph:
        new = F.when(F.col("id") == node, F.map_concat(F.map_filter("attrs", lambda k, v: k != key), F.create_map(F.lit(key), F.lit(value)))).otherwise(F.col("attrs"))
        return self._with(nodes=self.nodes.withColumn("attrs", new))

    def with_cluster(self, cluster: str, parent: str | None = None, attrs: dict[str, str] | None = None) -> Graph:
        row = self.clusters.sparkSession.createDataFrame([(cluster, parent, attrs or {})], "cluster string, parent string, attrs map<string,string>")
        return self._with(clusters=self.clusters.where(F.col("cluster") != cluster).unionByName(row))

    def without_cluster(self, cluster: str) -> Graph:
        """The cluster goes; its nodes and clusters move up to the one around it."""
        gone = self.clusters.where(F.col("cluster") == cluster).select(F.col("cluster").alias("_gone"), F.col("parent").alias("_up"))
        kept = self.clusters.where(F.col("cluster") != cluster).join(F.broadcast(gone), F.col("parent") == F.col("_gone"), "left")
        kept = kept.select("cluster", F.when(F.col("_gone").isNotNull(), F.col("_up")).otherwise(F.col("parent")).alias("parent"), "attrs")
        moved = self.members.join(F.broadcast(gone), F.col("cluster") == F.col("_gone"), "left")
        return self._with(clusters=kept, members=moved.select(F.when(F.col("_gone").isNotNull(), F.col("_up")).otherwise(F.col("cluster")).alias("cluster"), "id").where("cluster IS NOT NULL"))

    def in_cluster(self, rows: DataFrame) -> Graph:
        """Puts nodes into clusters: rows (cluster, id); a node's earlier cluster is left, of two new ones the smaller taken."""
        new = rows.groupBy("id").agg(F.min("cluster").alias("cluster"))
        return self._with(members=self.members.join(new, "id", "left_anti").select("cluster", "id").unionByName(new.select("cluster", "id")))

    def by_directory(self, placed: DataFrame) -> Graph:
        """Nodes in clusters that nest as their directories do; placed: (id, path) of nodes."""
        of = self.nodes.select("id").join(placed.select("id", "path"), "id").groupBy("id").agg(F.min("path").alias("path"))
        inner = of.select("id", expr.parent("path").alias("cluster")).where("cluster <> ''")
        every = of.select(F.explode(expr.ancestors("path")).alias("cluster")).where("cluster <> ''").distinct()
        label = F.create_map(F.lit("label"), expr.filename("cluster"))
        up = F.nullif(expr.parent("cluster"), F.lit(""))
        return self._with(clusters=every.select("cluster", up.alias("parent"), label.alias("attrs"))).in_cluster(inner)


#: GR28: diagram menus and legends (static dimensions).
DIAGRAM_TYPES = {"file": ["Component users", "Include dependency", "Interface"], "directory": ["External dependency", "External users", "Subsystem dependency"], "function": ["Function call"], "type": ["Detailed class", "Class collaboration"], "python": ["Function call", "Module", "Usage", "Class"]}
_FILE_MARKS = [("centre", "The file that the diagram is about"), ("PROVIDE", "A file that defines what the other declares"), ("USE", "A file whose declarations the other uses")]
_DIRECTORY_MARKS = [("centre", "The directory that the diagram is about"), ("directory", "A directory below it or beyond it")]
LEGENDS = {
    "Component users": _FILE_MARKS,
    "Include dependency": [*_FILE_MARKS, ("INCLUDE", "A file that is included")],
    "Interface": [("PROVIDE", "The header whose declarations the file defines"), ("USE", "A file that is used"), ("INCLUDE", "A file that is included")],
    "External dependency": [*_DIRECTORY_MARKS, ("depends", "Edge to a directory that files of the other use")],
    "External users": [*_DIRECTORY_MARKS, ("uses", "Edge from a directory whose files use files of the other")],
    "Subsystem dependency": [*_DIRECTORY_MARKS, ("depends", "Edge between two directories below the centre")],
    "Function call": [("centre", "The function that the diagram is about"), ("callee", "A function that it calls"), ("caller", "A function that calls it")],
    "Detailed class": [("class", "The class that the diagram is about"), ("inherits", "Edge from a class to its base"), ("+", "public"), ("-", "private"), ("#", "protected"), ("bold", "static"), ("italics", "virtual")],
    "Class collaboration": [("class", "The class that the diagram is about"), ("uses", "Edge to the type of data members, labelled with their names")],
    "Module": [("centre", "The module that the diagram is about"), ("imports", "Edge to a module whose definitions it imports")],
    "Usage": [("definition", "The definition that the diagram is about"), ("usage", "A place where it is used")],
    "Class": [("class", "The class that the diagram is about"), ("inherits", "Edge from a class to its base"), ("member", "A method or attribute of the class")],
}


def legend(spark, diagram: str) -> DataFrame:
    """GR28: an error for a diagram that there isn't."""
    if diagram not in LEGENDS:
        raise LookupError(f"no diagram {diagram}")
    return spark.createDataFrame(LEGENDS[diagram], "mark string, meaning string")
