"""Near-duplicate documents by an LSH forest over MinHash signatures, links confirmed on full shingle sets.

Documents of equal shingle sets are one class.  Each of TREES orders reads a class's signature of MINHASHES values in
its own sequence; classes whose sequences share their first values are a region of that tree, and sorted by the values
that follow, neighbours share the longest prefixes.  A region starts at the first of DEPTHS values: at Jaccard 0.8 a
pair misses all trees with probability 1e-4.  A region of at most REGION classes gives each class its next NEIGHBOURS in
sorted order as candidates.  A larger one goes deeper until its parts are small, and at each depth also pairs every
class with the region's first one (at the first depth with the hash-smallest one too), which is linear in its size.  So dense regions are read
deep and sparse ones shallow.

Candidates whose signatures allow the threshold (4.5 deviations) are confirmed on full sets, in two rounds: first each class
with its best candidate, then all that still lie in different components.  A link dropped as redundant joins classes that
confirmed links join already; no component is lost to it.

What these candidates may have missed is made up for exactly: of regions at the first depth that still hold several
components, small ones compare all pairs of different components, and the members of large ones go through a prefix-filter
join on their shingles, rarest first: two sets at the threshold share one of the first 20 % of the larger one's and the
first 11 % of the smaller one's, with enough shingles left after it.  So only a pair without a common region is missed.

Defined results: null texts and texts without words have an empty set and are linked with nothing.  Texts of fewer
words than a shingle have one shingle of all their words.  Rows that share doc_id are told apart by their text; repeated
rows fall in one class.  A null doc_id never is a component's id unless all its documents' are null.  Empty tables give
no rows; other columns are ignored.  Texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes, _scratch
from .components import components
from .line_dedup import _small

SHINGLE = 5
THRESHOLD = 80  # per cent
MINHASHES = 128
TREES = 24
DEPTHS = (5, 9, 14)
REGION = 64
NEIGHBOURS = 4
SEED = 11

_A = np.random.default_rng(SEED).integers(0, 1 << 63, MINHASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def orders() -> np.ndarray:
    """Each tree's sequence of signature positions: its own first values, then the others shuffled."""
    rng = np.random.default_rng(SEED + 1)
    out = []
    for t in range(TREES):
        own = [(t * DEPTHS[0] + i) % MINHASHES for i in range(DEPTHS[0])]
        rest = np.setdiff1d(np.arange(MINHASHES), own)
        out.append(np.concatenate([own, rng.permutation(rest)]))
    return np.array(out)


def signatures(documents: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, n_shingles, key of the shingle set, sig (MINHASHES little-endian unsigned 32-bit) of each row."""

    def run(batches):
        for batch in batches:
            for i, j, buf, st, en, first in _bytes.documents(batch.column(2), _bytes.NONSPACE):
                sh, of = _bytes.ngram_hashes(_bytes.word_hashes(buf, st, en), first, n)
                doc = np.repeat(np.arange(j - i), np.diff(of))
                order = np.lexsort((sh, doc))
                sh, doc = sh[order], doc[order]
                new = np.ones(len(sh), bool)
                new[1:] = (sh[1:] != sh[:-1]) | (doc[1:] != doc[:-1])
                sh, doc = sh[new], doc[new]
                size = np.bincount(doc, minlength=j - i)
                have = np.flatnonzero(size)
                starts = np.concatenate([[0], np.cumsum(size)[:-1]])[have]
                sig = np.full((j - i, MINHASHES), 0xFFFFFFFF, np.uint32)
                key = np.zeros(j - i, np.uint64)
                if len(have):
                    for k in range(MINHASHES):
                        sig[have, k] = np.minimum.reduceat((sh * _A[k]) >> np.uint64(32), starts)
                    key[have] = _bytes.mix(np.add.reduceat(_bytes.mix(sh), starts) ^ size[have].astype(np.uint64))
                sigs = sig.astype("<u4").tobytes()
                width = 4 * MINHASHES
                cols = [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(size.astype(np.int64)), pa.array(key.view(np.int64)), pa.array([sigs[r * width : (r + 1) * width] for r in range(j - i)], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["row", "doc_id", "n_shingles", "key", "sig"])

    rows = documents.select(F.xxhash64(id_col, text_col).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col))
    return rows.mapInArrow(_bytes.tidy(run), "row long, doc_id long, n_shingles long, key long, sig binary")


def _sigs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, MINHASHES)


def _leading(v: np.ndarray) -> np.ndarray:
    """8 bits that keep the order of 32-bit values, of small ones too."""
    return np.clip((v.astype(np.float32).view(np.uint32) >> np.uint32(20)).astype(np.int64) - (127 << 3), 0, 255).astype(np.uint64)


def _regions(classes: DataFrame, level: int, of_tree: bool) -> DataFrame:
    """region, tree, id, label (the values after the region's, for the order) of each class in each tree, or in its
    column `tree`."""
    seqs = orders()
    depth = DEPTHS[level]

    def run(batches):
        for batch in batches:
            sig, ids = _sigs(batch.column(1)), batch.column(0).to_numpy()
            own = batch.column(2).to_numpy() if of_tree else None
            for t in range(TREES):
                who = np.flatnonzero(own == t) if of_tree else np.arange(len(ids))
                if not len(who):
                    continue
                v = sig[who][:, seqs[t, : depth + 16]]
                key = np.full(len(who), (t + 1) * 1000 + depth, np.uint64)
                for k in range(depth):
                    key = _bytes.mix(key ^ v[:, k].astype(np.uint64))
                label = np.zeros(len(who), np.uint64)
                for k in range(depth, depth + 8):  # exponent and 3 more bits of each of the next values
                    label = (label << np.uint64(8)) | _leading(v[:, k])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(who), t, np.int32)), pa.array(ids[who]), pa.array(label.view(np.int64))], names=["region", "tree", "id", "label"])

    cols = ["id", "sig", *(["tree"] if of_tree else [])]
    return classes.select(*cols).mapInArrow(_bytes.tidy(run), "region long, tree int, id long, label long")


def candidates(classes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Pairs (a < b) of class ids that are neighbours in a tree, and the members (region, id, n) of the first depth's
    regions of more than NEIGHBOURS.  classes: id, sig."""
    found, rows, wide = [], _regions(classes, 0, False), None
    pair = lambda x, y: [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]
    for level in range(len(DEPTHS)):
        size = rows.groupBy("region").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).where("n > 1")
        size = _scratch.saved(size, "regions", "snappy")
        found.append(size.select(*pair(F.col("low"), F.col("high"))))
        more = size.where("n > 2")
        many = more.count()
        if not many:
            break
        members = _scratch.saved(rows.join(_small(more, 32 * many), "region"), "members", "snappy")
        if not level:
            wide = members.where(F.col("n") > NEIGHBOURS).select("region", "id", "n")
        # small regions: neighbours in sorted order
        listed = members.where(F.col("n") <= REGION).groupBy("region").agg(F.sort_array(F.collect_list(F.struct("label", "id"))).alias("m"))
        near = listed.select(F.explode(F.transform("m", lambda x, i: F.struct(x["id"].alias("x"), F.transform(F.slice("m", i + 2, NEIGHBOURS), lambda y: y["id"]).alias("ys")))).alias("p"))
        found.append(near.select(F.col("p.x").alias("x"), F.explode("p.ys").alias("y")).select(*pair(F.col("x"), F.col("y"))))
        large = members.where(F.col("n") > REGION)
        if large.isEmpty():
            break
        found.append(large.select("id", F.col("low").alias("hub")).where("id <> hub").select(*pair(F.col("id"), F.col("hub"))))
        if not level:
            middle = large.groupBy("region").agg(F.min(F.struct(F.xxhash64("id", "region").alias("h"), "id")).alias("m")).select("region", F.col("m.id").alias("mid"))
            found.append(large.join(_small(middle, 24 * many), "region").select("id", F.col("mid").alias("hub")).where("id <> hub").select(*pair(F.col("id"), F.col("hub"))))
        if level + 1 == len(DEPTHS):
            break
        deeper = large.select("id", "tree").join(classes, "id")
        rows = _regions(deeper, level + 1, True)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.where("a < b").distinct(), wide


def still_open(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Members with their component, of regions that hold several components.  members: region, id, n."""
    named = members.join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    split = named.groupBy("region").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("region")
    return named.join(split, "region")


def all_pairs(members: DataFrame) -> DataFrame:
    """Pairs (a < b) of different components in regions of at most REGION classes."""
    listed = members.groupBy("region").agg(F.collect_list(F.struct("id", "component")).alias("m"))
    x = listed.select("m", F.posexplode("m").alias("i", "x")).select("x", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("y"))
    return x.where("x.component <> y.component").select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def prefix_join(members: DataFrame, texts: DataFrame, n: int, threshold: int) -> DataFrame:
    """Pairs (a < b) of different components that prefix, size and position of their shingles allow.

    members: id, component (once each); texts: id, text.  A shingle's place in the order follows from the number of
    members that have it."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for i, j, buf, st, en, first in _bytes.documents(batch.column(1), _bytes.NONSPACE):
                sh, of = _bytes.ngram_hashes(_bytes.word_hashes(buf, st, en), first, n)
                for d in range(j - i):
                    own = np.unique(sh[of[d] : of[d + 1]])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), ids[i + d])), pa.array(own.view(np.int64))], names=["id", "sh"])

    each = _scratch.saved(texts.join(members.select("id"), "id", "left_semi").select("id", "text").mapInArrow(_bytes.tidy(run), "id long, sh long"), "shingles", "snappy")
    often = each.groupBy("sh").agg(F.count("*").alias("df"))
    sets = each.join(often, "sh").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "sh"))).alias("s"))  # of one document
    t = threshold / 100
    size = F.size("s")
    prefix = lambda share: size - F.ceil(size * share - 1e-9).cast("int") + 1
    heads = sets.join(members, "id").select("id", "component", size.alias("n"), prefix(2 * t / (1 + t)).alias("short"), F.posexplode(F.transform(F.slice("s", F.lit(1), prefix(t)), lambda x: x["sh"])).alias("at", "sh"))
    heads = _scratch.saved(heads.join(often.where("df > 1").select("sh"), "sh", "left_semi"), "prefixes", "snappy")
    x = heads.select("sh", *(F.col(c).alias(f"x_{c}") for c in ("id", "component", "n", "at")))
    y = heads.where("at < short").select("sh", *(F.col(c).alias(f"y_{c}") for c in ("id", "component", "n", "at")))
    need = F.ceil((F.col("x_n") + F.col("y_n")) * (t / (1 + t)) - 1e-9)
    left = F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at"))
    smaller = (F.col("y_n") < F.col("x_n")) | ((F.col("y_n") == F.col("x_n")) & (F.col("y_id") < F.col("x_id")))
    met = x.join(y, "sh").where((F.col("x_component") != F.col("y_component")) & smaller & (100 * F.col("y_n") >= threshold * F.col("x_n")) & (left >= need))
    return met.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct()


def estimated(pairs: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """Pairs that sizes and signatures allow to reach the threshold, with est (share of equal values)."""
    one = classes.select("id", "n_shingles", "sig")
    x = pairs.join(one.select(F.col("id").alias("a"), F.col("n_shingles").alias("na"), F.col("sig").alias("sa")), "a")
    x = x.join(one.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb"), F.col("sig").alias("sb")), "b").where(100 * F.least("na", "nb") >= threshold * F.greatest("na", "nb"))
    t = threshold / 100
    least = t - 4.5 * (t * (1 - t) / MINHASHES) ** 0.5

    def run(batches):
        for batch in batches:
            if len(batch):
                est = (_sigs(batch.column(2)) == _sigs(batch.column(3))).mean(axis=1)
                keep = est >= least
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep)), pa.array(est[keep])], names=["a", "b", "est"])

    return x.select("a", "b", "sa", "sb").mapInArrow(_bytes.tidy(run), "a long, b long, est double")


def confirmed(pairs: DataFrame, texts: DataFrame, n: int, threshold: int) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= threshold * union.  texts: id, text."""
    x = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    x = x.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")

    def sets(column):
        for i, j, buf, st, en, first in _bytes.documents(column, _bytes.NONSPACE):
            sh, of = _bytes.ngram_hashes(_bytes.word_hashes(buf, st, en), first, n)
            for d in range(j - i):
                yield np.unique(sh[of[d] : of[d + 1]])

    def run(batches):
        for batch in batches:
            keep = []
            for p, q in zip(sets(batch.column(2)), sets(batch.column(3)), strict=True):
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both > 0 and 100 * both >= threshold * (len(p) + len(q) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return x.select("a", "b", "ta", "tb").mapInArrow(_bytes.tidy(run), "a long, b long")


def grouped(rows: DataFrame, documents: DataFrame, shingle: int, threshold: int, id_col: str, text_col: str) -> DataFrame:
    """key, component_id and group of each class, stored.  rows: signatures of the documents."""
    classes = rows.where("n_shingles > 0").groupBy(F.col("key").alias("id")).agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n_shingles"), F.first(F.struct("row", "sig")).alias("one"))
    classes = _scratch.saved(classes.select("id", "doc", "n_shingles", "one.row", "one.sig"), "classes", "snappy")
    pairs, wide = candidates(classes.select("id", "sig"))
    pairs = _scratch.saved(estimated(pairs, classes, threshold), "pairs", "snappy")

    keyed = documents.select(F.xxhash64(id_col, text_col).alias("row"), F.col(text_col).alias("text"))

    def texts_of(ids: DataFrame) -> DataFrame:
        wanted = _scratch.saved(classes.select("id", "row").join(ids, "id", "left_semi"), "wanted", "snappy")
        return _scratch.saved(keyed.join(_small(wanted, 16 * wanted.count()), "row").select("id", "text").dropDuplicates(["id"]), "texts")

    both = lambda p: p.select(F.col("a").alias("id")).unionByName(p.select(F.col("b").alias("id"))).distinct()
    texts = texts_of(both(pairs))
    best = pairs.groupBy("b").agg(F.max(F.struct("est", F.col("a"))).alias("m")).select(F.col("m.a").alias("a"), "b")
    links = _scratch.saved(confirmed(best, texts, shingle, threshold), "links", "snappy")
    groups = components(links)

    def apart(pairs: DataFrame) -> DataFrame:
        for end in ("a", "b"):
            pairs = pairs.join(groups.select(F.col("id").alias(end), F.col("component").alias(f"{end}c")), end, "left").withColumn(f"{end}c", F.coalesce(f"{end}c", end))
        return pairs.where("ac <> bc").select("a", "b")

    def add(more: DataFrame, texts: DataFrame | None) -> None:
        nonlocal links, groups
        if not more.isEmpty():
            texts = texts_of(both(more)) if texts is None else texts
            links = links.unionByName(_scratch.saved(confirmed(more, texts, shingle, threshold), "links", "snappy"))
            groups = components(links)

    known = pairs.select("a", "b")
    rest = apart(known).join(best, ["a", "b"], "left_anti")
    if wide is None:
        add(_scratch.saved(rest, "rest", "snappy"), texts)
    else:
        left = _scratch.saved(still_open(wide, groups), "open", "snappy")
        small = estimated(all_pairs(left.where(F.col("n") <= REGION)), classes, threshold).select("a", "b")
        add(_scratch.saved(rest.unionByName(small.join(known, ["a", "b"], "left_anti")), "rest", "snappy"), None)
        dense = still_open(left.where(F.col("n") > REGION).select("region", "id", "n"), groups).select("id", "component").distinct()
        dense = _scratch.saved(dense, "dense", "snappy")
        if not dense.isEmpty():
            texts = texts_of(dense.select("id"))
            add(_scratch.saved(prefix_join(dense, texts, shingle, threshold).join(known, ["a", "b"], "left_anti"), "rest", "snappy"), texts)

    named = classes.select("id", "doc").join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    smallest = named.groupBy("component").agg(F.min("doc").alias("component_id"))
    by_class = named.join(smallest, "component").select(F.col("id").alias("key"), "component_id", F.col("component").alias("group"))
    return _scratch.save(by_class, "by-class", "snappy", kept=True)[0]


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, row (key of doc_id and text) and group of every row.

    Components may share a component_id, as rows may share a doc_id or have none; group tells them apart (null: no words)."""
    _bytes.modest(documents.sparkSession)
    rows = _scratch.saved(signatures(documents, shingle, id_col, text_col), "sigs", "snappy")
    with _scratch.temporary(documents.sparkSession):
        by_class = grouped(rows, documents, shingle, threshold, id_col, text_col)
    # rows without shingles have no class: a key of their own each, so that they are not dealt to one task
    key = F.when(F.col("n_shingles") == 0, F.xxhash64("row", F.lit(1))).otherwise(F.col("key"))
    out = rows.select("row", "doc_id", "n_shingles", key.alias("key")).join(by_class, "key", "left")
    cid = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", cid.alias("component_id"), F.col("doc_id").eqNullSafe(cid).alias("kept"), "row", "group")


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4).drop("row", "group")


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, hash(list_slice(ws, i, i + least(4, len(ws)) - 1)) AS sh
  FROM w, unnest(range(1, greatest(len(ws) - 4, 0) + 2)) u(i) WHERE len(ws) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM k JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)
), reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r
), c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
