"""Fuzzy line deduplication with DataFrame functions only.

Lines are normalised (lower case, runs of ASCII marks and white space as one space); equal lines are one class.  A class
has a SimHash of 60 bits, the majority of the hashes of its SAMPLE smallest distinct words, and a few block keys: hashes of
its runs of RUN words, of which a share of KEYS / (words of the line) is taken by hash value, so similar lines take the
same runs.  Lines of COUNTED words or more have two further SimHashes, of other samples.  Short lines take all their runs, of RUN - 1 words too; lines of fewer than MIN_WORDS words (scripts without
spaces) take runs of GRAM letters.  A few edits leave other runs whole (pigeonhole), so near copies share a block key.
Blocks of the SimHash's own bits can't do that at an edit similarity of 0.8: the README has the figures.

Classes that share a key meet in a bucket.  Pairs whose lengths and counts of letters allow SIMILARITY and whose SimHashes
differ in at most DISTANCE bits (of short lines: all; of three SimHashes in WIDE in all) are verified by edit distance.  First every class meets its bucket's
smallest one, and confirmed links are joined to groups.  In a bucket of more than BUCKET classes all meet one in its middle
next, and then one in the middle of those outside its largest group (ROUNDS in all).  At last all classes of a bucket, of
any size, meet that are in different groups still, so a pair left out changes no group.  Large buckets are joined by class
of length and in tiles of TILE classes.  Of each group of lines the first occurrence, by (doc_id, row, line), is kept.

Lines of fewer than MIN_WORDS words and of fewer than MIN_CHARS letters are left alone, repeats too.

Defined results: a null text stays null, an empty one empty; both have no lines that count.  Rows that share doc_id and
text are the same occurrence, so repeated rows keep the same lines; rows that share only doc_id are told apart by their
text.  Empty tables give no rows.  Whole texts are read, however long.  Other columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _scratch
from .components import components

SIMILARITY = 0.8
MIN_WORDS = 4
#: A line of fewer words counts if its normal form has so many letters: scripts without spaces make one word of a line.
MIN_CHARS = 20
RUN = 3
#: Lines of fewer words than SHORT have shorter runs as keys, of LONG or more the runs of RUN: in between, both.
SHORT, LONG = 12, 8
GRAM = 5
KEYS = 8
SAMPLE = 15
DISTANCE = 19
#: Letters whose numbers are compared, of lines of fewer than COUNTED words, and up to which number: 64 bits each.
LETTERS = ({"e": 15, "n": 12, "t": 11, "h": 10, "a": 8, "o": 8}, {" ": 12, "i": 7, "r": 7, "s": 5, "d": 5, "l": 4, "u": 4, "c": 3, "m": 3, "g": 2, "p": 2, "b": 2, "w": 2, "f": 2, "y": 1, "k": 1, "v": 1})
COUNTED = 2 * SHORT
#: Bits in which all three SimHashes of two lines of COUNTED words or more may differ: a larger share than DISTANCE's.
WIDE = 63
BUCKET = 64
#: Classes of a large bucket that one key's join holds on one side.
TILE = 4096
ROUNDS = 2
MARGIN = 8
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of a side that may be broadcast; beyond, joins shuffle.
BROADCAST_BYTES = 16 << 20


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), NON_WORD), "")


def normal(text: Column) -> Column:
    return F.array_join(words_of(text), " ")


def _small(df: DataFrame, size: int) -> DataFrame:
    """df, broadcast if it has few bytes."""
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def _one(df: DataFrame, name: str, value: Column, *kept: str) -> DataFrame:
    """kept columns and value, which is computed once: the explode of a single value keeps the optimizer from computing
    it in every place that uses it."""
    return df.select(*kept, F.explode(F.array(value)).alias(name))


def _runs(n: int) -> Column:
    """Hashes of the runs of n words; h: the words' hashes."""
    first = F.slice("h", 1, F.greatest(F.size("h") - (n - 1), F.lit(0)))
    return F.transform(first, lambda x, i: F.xxhash64(x, *(F.get("h", i + k) for k in range(1, n))))


def _up_to(share: Column) -> Column:
    """The largest hash of the smallest `share` of all hashes."""
    return F.when(share >= 1, F.lit((1 << 63) - 1)).otherwise((share * float(1 << 64) - float(1 << 63)).cast("long"))


def simhash(hashes: Column) -> Column:
    """Those of the lower 60 bits that more than half of the hashes (SAMPLE at most, 15) have set.

    Four sums count all bits: sum j holds the counts of bits j, j + 4, j + 8 ... in four bits each.  Adding 7 less the
    half makes a count's top bit tell whether it exceeds the half."""
    ones = F.lit(0x0111111111111111).cast("long")
    lift = ones * (7 - F.shiftright(F.size(hashes), 1)).cast("long")

    def bits(j: int) -> Column:
        count = F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, x: acc + F.shiftrightunsigned(x, j).bitwiseAND(ones))
        return F.shiftleft(F.shiftrightunsigned(count + lift, 3).bitwiseAND(ones), j)

    return bits(0).bitwiseOR(bits(1)).bitwiseOR(bits(2)).bitwiseOR(bits(3))


def counts(norm: Column, most: dict[str, int]) -> Column:
    """Bits of the numbers of letters: as many in a letter's place as it occurs, up to its most.

    Two lines' bits differ in no more places than the numbers of letters in all; an edit changes two of them by one, and
    if it changes the length one."""
    at = [sum(list(most.values())[:i]) for i in range(len(most))]
    table = F.array(*(F.struct(F.lit(c).alias("c"), F.lit(n).alias("most"), F.lit(i).alias("at")) for (c, n), i in zip(most.items(), at, strict=True)))

    def bits(t: Column) -> Column:
        n = F.least(F.length(norm) - F.length(F.replace(norm, t["c"], F.lit(""))), t["most"])
        return F.call_function("shiftleft", F.call_function("shiftleft", F.lit(1).cast("long"), n) - 1, t["at"])

    return F.aggregate(table, F.lit(0).cast("long"), lambda acc, t: acc.bitwiseOR(bits(t)))


def line_table(rows: DataFrame) -> DataFrame:
    """Each line that counts: row, doc_id, line, key (of its normal form), chars (its length), sim (SimHash; null if it
    is short), low and high (counts of letters; null if it has many words), second and third (SimHashes of other samples;
    null if it has few words), keys (of blocks)."""
    at = ("row", "doc_id", "line")
    each = rows.select("row", "doc_id", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    each = _one(each, "words", words_of(F.col("raw")), *at)
    n = F.size("words")
    # letters: those of the words and a space between two
    each = each.select(*at, "words", (F.aggregate("words", F.lit(0), lambda acc, w: acc + F.length(w)) + n - 1).alias("chars"))
    each = each.where((n >= MIN_WORDS) | (F.col("chars") >= MIN_CHARS))
    norm = F.array_join("words", " ")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.col("chars") - GRAM + 1, F.lit(1))), lambda i: F.xxhash64(F.substring("norm", i, F.lit(GRAM))))
    each = each.select(*at, "chars", F.xxhash64("words").alias("key"), "words", (n < MIN_WORDS).alias("letters"), F.when(n < COUNTED, norm).alias("norm"))
    each = _one(each, "counts", F.when(n < COUNTED, F.struct(*(counts(F.col("norm"), x).alias(c) for c, x in zip(("low", "high"), LETTERS, strict=True)))), *at, "chars", "key", "words", "letters", "norm")
    hashes = F.when(F.col("letters"), grams).otherwise(F.transform("words", lambda w: F.xxhash64(w)))
    each = _one(each, "h", hashes, *at, "chars", "key", "counts", "letters")
    n = F.size("h")
    for name, most in (("few", KEYS), ("some", 2 * SAMPLE)):
        each = each.withColumn(name, _up_to(F.lit(float(most)) / F.greatest(n, F.lit(1))))
    taken = F.filter(F.when(F.col("letters"), F.col("h")).otherwise(_runs(RUN)), lambda x: x <= F.col("few"))
    short = ~F.col("letters") & (n < SHORT)
    keys = F.when(short & (n < LONG), _runs(RUN - 1)).when(short, F.concat(_runs(RUN - 1), _runs(RUN))).otherwise(taken)
    sample = lambda h: F.slice(F.sort_array(F.array_distinct(F.filter(h, lambda x: x <= F.col("some")))), F.lit(1), F.lit(SAMPLE))
    many = ~F.col("letters") & (n >= COUNTED)
    again = lambda i: F.transform("h", lambda x: F.xxhash64(x, F.lit(i)))
    others = [F.when(many, sample(again(i))).alias(c) for i, c in ((1, "second"), (2, "third"))]
    each = each.select(*at, "key", "chars", "counts", F.explode(F.array(F.struct(keys.alias("keys"), F.when(~short, sample("h")).alias("sample"), *others))).alias("s"))
    return each.select(*at, "key", "chars", simhash(F.col("s.sample")).alias("sim"), "counts.low", "counts.high", *(simhash(F.col(f"s.{c}")).alias(c) for c in ("second", "third")), "s.keys")


MEMBER = ("key", "chars", "sim", "low", "high", "second", "third")


def _met(lines: DataFrame) -> DataFrame:
    """bucket, lo (its smallest class) and MEMBER of the classes of the buckets that have several.

    Only keys are dealt to buckets, in one shuffle; the rest joins those that met."""
    w = Window.partitionBy("bucket")
    dealt = lines.select(F.explode("keys").alias("bucket"), "key").withColumns({"lo": F.min("key").over(w), "hi": F.max("key").over(w)})
    met, path = _scratch.save(dealt.where("lo <> hi").select("bucket", "lo", "key").distinct(), "met", "snappy")
    members = _scratch.saved(met.join(lines.select(*MEMBER).dropDuplicates(["key"]), "key").select("bucket", "lo", *MEMBER), "members", "snappy")
    _scratch.drop(lines.sparkSession, path)
    return members


def _fitting(pairs: DataFrame, also: Column | None = None) -> DataFrame:
    """Pairs (x, y: structs of MEMBER) that may be similar by length, SimHash and letters, and for which `also` holds, as
    a < b."""
    shorter, longer = F.least("x.chars", "y.chars"), F.greatest("x.chars", "y.chars")
    near = F.coalesce(F.bit_count(F.col("x.sim").bitwiseXOR(F.col("y.sim"))) <= DISTANCE, F.lit(True))
    most = F.floor(longer * (1 - SIMILARITY) + 1e-9)
    apart = F.bit_count(F.col("x.low").bitwiseXOR(F.col("y.low"))) + F.bit_count(F.col("x.high").bitwiseXOR(F.col("y.high")))
    near = near & F.coalesce(apart <= 2 * most - (longer - shorter), F.lit(True))
    wide = sum((F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in ("second", "third")), F.bit_count(F.col("x.sim").bitwiseXOR(F.col("y.sim"))))
    near = near & F.coalesce(wide <= WIDE, F.lit(True))
    fits = (F.col("x.key") != F.col("y.key")) & (longer - shorter <= most) & near
    fits = pairs.where(fits if also is None else fits & also)
    return fits.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b"))


def _with_hubs(members: DataFrame) -> DataFrame:
    """Fitting pairs of every class with its bucket's smallest one."""
    end = F.struct(*MEMBER)
    hub = members.where("key = lo").select("bucket", end.alias("y"))
    return _fitting(members.where("key <> lo").select("bucket", end.alias("x")).join(hub, "bucket"))


def _open(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Members with their component, their bucket's size and whether they are outside its largest component; only of
    buckets with three classes and two components at least."""
    named = members.join(groups.withColumnRenamed("id", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    parts = named.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    most = parts.groupBy("bucket").agg(F.sum("n").alias("n"), F.max("n").alias("top"), F.count("*").alias("parts")).where("parts > 1 AND n > 2")
    main = parts.withColumnRenamed("n", "own").join(most, "bucket").where("own = top").groupBy("bucket").agg(F.min("component").alias("main"), F.min("n").alias("n"))
    return named.join(main, "bucket").select("bucket", "lo", *MEMBER, "component", "n", (F.col("component") != F.col("main")).alias("outside"))


def _all_pairs(members: DataFrame) -> DataFrame:
    """Fitting pairs of classes of different components.

    Of two such classes one is outside the bucket's largest component.  In large buckets it meets those of its class of
    length and the two beside it, which are all lengths that SIMILARITY allows."""
    large = F.col("n") > BUCKET
    step = F.when(large, F.floor(F.log("chars") / F.log(F.lit(1 / SIMILARITY))).cast("int")).otherwise(0)
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    steps, all_tiles = F.when(large, F.array(step - 1, step, step + 1)).otherwise(F.array(step)), F.sequence(F.lit(0), tiles - 1)
    x = members.where("outside").select("bucket", step.alias("step"), F.pmod(F.hash("key"), tiles).alias("tile"), F.struct(*MEMBER, "component").alias("x"))
    y = members.select("bucket", "outside", F.explode(steps).alias("step"), all_tiles.alias("tiles"), F.struct(*MEMBER, "component").alias("y")).withColumn("tile", F.explode("tiles"))
    apart = F.col("x.component") != F.col("y.component")
    return _fitting(x.join(y, ["bucket", "step", "tile"]), apart & (~F.col("outside") | (F.col("x.key") < F.col("y.key"))))


def _middles(members: DataFrame) -> DataFrame:
    """bucket, hub: each bucket's class whose SimHash is nearest to the majority's; its near copies are near it."""
    sums = [F.sum(F.shiftrightunsigned("sim", i).bitwiseAND(F.lit(1))).alias(f"b{i}") for i in range(60)]
    bits = members.where("sim IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("m"), *sums)
    one = F.lit(0).cast("long")
    for i in range(60):
        one = one.bitwiseOR(F.when(2 * F.col(f"b{i}") > F.col("m"), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    far = F.coalesce(F.bit_count(F.col("sim").bitwiseXOR(F.col("middle"))), F.lit(64)).alias("far")
    near = members.join(bits.select("bucket", one.alias("middle")), "bucket", "left")
    return _scratch.saved(near.groupBy("bucket").agg(F.min(F.struct(far, *MEMBER, "component")).alias("hub")), "hubs", "snappy")


def _with(members: DataFrame, hubs: DataFrame) -> DataFrame:
    """Fitting pairs of classes with their bucket's hub."""
    met = members.join(hubs, "bucket").where(F.col("component") != F.col("hub.component"))
    return _fitting(met.select(F.struct(*MEMBER).alias("x"), F.struct(*(f"hub.{c}" for c in MEMBER)).alias("y")))


def linked(rows: DataFrame, lines: DataFrame, members: DataFrame) -> DataFrame:
    """Components (id, component) of the classes that have links.  lines: key, row, line, stored; members: of _met.

    Tables are deleted when the next one is there: of a large input they would take several times its disk."""
    spark = rows.sparkSession
    links: DataFrame | None = None
    groups: DataFrame | None = None

    def add(pairs: DataFrame) -> None:
        nonlocal links, groups
        pairs, pairs_path = _scratch.save(pairs.distinct(), "pairs", "snappy")
        ends = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
        norms, norms_path = _scratch.save(texts_of(rows, lines.select("key", "row", "line").join(ends, "key", "left_semi").dropDuplicates(["key"])), "norms", "snappy")
        with_a = pairs.join(norms.select(F.col("key").alias("a"), F.col("norm").alias("x")), "a")
        both = with_a.join(norms.select(F.col("key").alias("b"), F.col("norm").alias("y")), "b")
        new = _scratch.saved(confirmed(both), "linked", "snappy")
        _scratch.drop(spark, pairs_path, norms_path)
        links = links.unionByName(new) if links is not None else new
        groups = components(links)

    add(_with_hubs(members))
    open_, path = _scratch.save(_open(members, groups), "open", "snappy")
    large, tried = open_.where(F.col("n") > BUCKET), None
    for _ in range(ROUNDS):
        if large.isEmpty():
            break
        # a class in the middle of the whole bucket, then each time another in the middle of those outside
        of = large if tried is None else large.where("outside").join(tried, ["bucket", "key"], "left_anti")
        hubs = _middles(of)
        add(_with(large, hubs))
        used = hubs.select("bucket", F.col("hub.key").alias("key"))
        tried = used if tried is None else tried.unionByName(used)
        old = path
        open_, path = _scratch.save(_open(open_.select("bucket", "lo", *MEMBER), groups), "open", "snappy")
        _scratch.drop(spark, old)
        large = open_.where(F.col("n") > BUCKET)
    add(_all_pairs(open_))
    return groups


def texts_of(rows: DataFrame, places: DataFrame) -> DataFrame:
    """Normal forms of lines at given places, one for each key.  places: key, row, line; rows: row, text -> key, norm."""
    by_row = places.groupBy("row").agg(F.collect_list(F.struct("key", "line")).alias("at"))
    by_row, _ = _scratch.save(by_row, "places", "snappy")
    size = by_row.agg(F.sum(16 + 24 * F.size("at"))).first()[0] or 0
    got = rows.select("row", "text").join(_small(by_row, size), "row")
    got = got.select(F.explode(F.array(F.split("text", "\n"))).alias("lines"), "at")
    got = got.select(F.explode(F.transform("at", lambda p: F.struct(p["key"].alias("key"), F.element_at("lines", p["line"] + 1).alias("raw")))).alias("p"))
    return got.select("p.key", normal(F.col("p.raw")).alias("norm")).dropDuplicates(["key"])


def _first_difference(x: Column, y: Column) -> Column:
    """Number of leading words that two arrays share."""
    return F.array_position(F.zip_with(x, y, lambda u, v: u.eqNullSafe(v)), F.lit(False)).cast("int") - 1


def confirmed(pairs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b) of lines x <> y whose edit similarity, 1 - edits / length of the longer, is at least `least`.

    Words that both lines begin or end with are cut off first, which leaves the number of edits as it is.  Then the
    distance is computed within a band as wide as the differing words, and if that is too narrow in that of all allowed edits."""
    longer = F.greatest(F.length("x"), F.length("y"))
    most = F.floor(longer * (1 - least) + 1e-9).cast("int")
    fits = pairs.where(F.abs(F.length("x") - F.length("y")) <= most)
    # explode of single values: each step is computed once
    one = fits.select("a", "b", F.explode(F.array(F.struct(F.split("x", " ").alias("x"), F.split("y", " ").alias("y"), most.alias("most")))).alias("t")).select("a", "b", "t.x", "t.y", "t.most")
    two = one.select("a", "b", "x", "y", "most", F.explode(F.array(_first_difference(F.col("x"), F.col("y")))).alias("p"))
    tail = lambda c: F.slice(c, F.col("p") + 1, F.size(c) - F.col("p"))
    three = two.select("a", "b", "most", F.explode(F.array(F.struct(F.reverse(tail(F.col("x"))).alias("x"), F.reverse(tail(F.col("y"))).alias("y")))).alias("t")).select("a", "b", "most", "t.x", "t.y")
    four = three.select("a", "b", "most", "x", "y", F.explode(F.array(_first_difference(F.col("x"), F.col("y")))).alias("q"))
    middle = lambda c: F.array_join(F.reverse(F.slice(c, F.col("q") + 1, F.size(c) - F.col("q"))), " ")
    # two proofs without the distance.  Words put for words cost at most the longer one's letters.  And an edit of a word
    # costs at most the longest word and a space: with a letter for each word, the distance between the lines' letters
    # (and one more, lest two words have the same letter) times that
    swapped = F.aggregate(F.zip_with("x", "y", lambda u, v: F.when(u == v, 0).otherwise(F.greatest(F.length(u), F.length(v)))), F.lit(0), lambda acc, n: acc + n)
    letter = lambda w: F.lpad(F.hex(F.pmod(F.hash(w), F.lit(0xD000)) + 0x100), 4, "0")
    coded = lambda c: F.decode(F.unhex(F.array_join(F.transform(c, letter), "")), "UTF-16BE")
    longest = lambda c: F.aggregate(c, F.lit(0), lambda acc, w: F.greatest(acc, F.length(w)))
    four = four.select("a", "b", "most", "x", "y", "q", F.explode(F.array(F.struct(coded("x").alias("x"), coded("y").alias("y"), (F.floor(F.col("most") / (1 + F.greatest(longest("x"), longest("y")))) - 1).cast("int").alias("edits")))).alias("c"))
    plain = F.when(F.size("x") == F.size("y"), swapped)
    few = (F.col("c.edits") >= 0) & (F.call_function("levenshtein", F.col("c.x"), F.col("c.y"), F.greatest(F.col("c.edits"), F.lit(0))) >= 0)
    four = four.select("a", "b", "most", "q", F.explode(F.array(F.struct("x", "y", F.when(few, F.lit(0)).otherwise(plain).alias("plain")))).alias("t")).select("a", "b", "most", "q", "t.x", "t.y", "t.plain")
    # the letters of words that only one line has: of most similar pairs, an edit distance's width
    apart = F.greatest(F.length(F.array_join(F.array_except("x", "y"), " ")), F.length(F.array_join(F.array_except("y", "x"), " ")))
    five = four.select("a", "b", "most", "plain", F.explode(F.array(F.struct(middle(F.col("x")).alias("x"), middle(F.col("y")).alias("y"), (apart + MARGIN).alias("band")))).alias("t")).select("a", "b", "most", "plain", "t.*")
    within = lambda band: F.call_function("levenshtein", F.col("x"), F.col("y"), band) >= 0  # noqa: E731  (-1 beyond the band)
    answer = within(F.least("band", "most")) | ((F.col("band") < F.col("most")) & within(F.col("most")))
    return five.where(F.when(F.col("plain") <= F.col("most"), F.lit(True)).otherwise(answer)).select("a", "b")


def removed(rows: DataFrame) -> DataFrame:
    """row, gone (numbers of its lines that go), stored.  rows: row, doc_id, text."""
    whole, path = _scratch.save(line_table(rows), "lines", "snappy")
    members = _met(whole)
    # the block keys and sketches, most of a line's bytes, are in members now
    lines = _scratch.saved(whole.select("key", "row", "doc_id", "line"), "at", "snappy")
    _scratch.drop(rows.sparkSession, path)
    groups = linked(rows, lines, members)

    # lines that occur more than once or are linked, by their group
    again = lines.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    named = groups.withColumnRenamed("id", "key").unionByName(again.join(groups, F.col("key") == F.col("id"), "left_anti").withColumn("component", F.col("key")))
    place = F.struct("doc_id", "row", "line")
    many = _scratch.saved(lines.select("key", "doc_id", "row", "line").join(named, "key").select("component", "doc_id", "row", "line"), "many", "snappy")
    kept = many.groupBy("component").agg(F.min(place).alias("keep"))
    gone = many.join(kept, "component").where(place != F.col("keep")).groupBy("row").agg(F.collect_set("line").alias("gone"))
    return _scratch.save(gone, "gone", "snappy", kept=True)[0]


def dedup_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of documents with text without the lines removed, and n_lines, n_removed (which replace such columns)."""
    keyed = documents.drop("n_lines", "n_removed")
    names = keyed.columns
    keyed = keyed.select(F.xxhash64(id_col, text_col).alias("row"), F.struct(*names).alias("d"))
    rows = keyed.select("row", F.col("d")[id_col].alias("doc_id"), F.col("d")[text_col].alias("text"))
    with _scratch.temporary(documents.sparkSession):
        gone = removed(rows)
    size = gone.agg(F.sum(16 + 4 * F.size("gone"))).first()[0] or 0
    out = keyed.join(_small(gone, size), "row", "left")
    text = F.col("d")[text_col]
    newlines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))

    def without(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
        return F.array_join(F.transform(left, lambda i: F.element_at(lines, i + 1)), "\n")

    # the transform of a single value splits the text once
    new = F.when(F.col("gone").isNull(), text).otherwise(F.element_at(F.transform(F.array(F.split(text, "\n")), without), 1))
    n_lines = F.coalesce(newlines + 1, F.lit(0)).cast("long").alias("n_lines")
    n_removed = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long").alias("n_removed")
    return out.select(*((new if c == text_col else F.col("d")[c]).alias(c) for c in names), n_lines, n_removed)


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(d).select("doc_id", "n_lines", "n_removed", "text")
