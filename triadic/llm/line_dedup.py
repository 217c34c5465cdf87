"""Fuzzy line dedup by MinHash. DataFrame functions only.

A line's set is that of all its character shingles: the ten characters from each
place on; a line of fewer is its only shingle. Shingles are taken by a generator
and hashed inside generated code, a row for each. Hashes are dealt into VALUES
bins, and an aggregate by line keeps the least hash of each: the line's
signature, by one permutation; an empty bin has the value of the next that is
not. Only hashes under a bound which leaves a bin LEAST of them on average reach
the aggregate; a line with so few distinct shingles that bins stay empty is
signed again without a bound. Short lines, whose bins would share values, also
get MinHashes of all their shingles: the least of ``hash xor mask`` is one for
any mask. Bands are pairs of values; lines that share a band are candidates. A
band is not compared pair by pair: see ngram_join.link_groups, which compares
members with the smallest, those of bands that are then in several components
with some that share a third value, and all pairs across components of bands that
are still in several. Every such pair is decided exactly: parities of the shingles in cells rule
out most that can't be linked and none that are, and of others the
Jaccard similarity of the sets is computed, of shingles as 64-bit hashes.
Components of the links come from distributed large and small stars, and of each
component the first line in the order of documents stays.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triadic.llm.common import Scratch
from triadic.llm.ngram_join import link_groups

SHINGLE = 10
#: Band i is values i and BANDS + i of a signature. Of a pair of similarity 0.8, a band is equal with probability 0.64, and one of all 7 with 0.999.
BANDS = 7
VALUES = 2 * BANDS
LEAST = 3.6
WORDS = 8  # of 64 bits in a line's sketch
#: Lines of more shingles, of which those cells would hold several each, get a second sketch of so many words where all pairs of a band meet.
LONG, WIDE = 96, 128
SHORT = 24  # shingles of lines that get SHORT_BANDS more; of a pair of similarity 0.8 from 20 shingles on, bins alone find 0.999
SHORT_BANDS = 4
WHITE = " \t\r\x0b\x0c"  # around a line it doesn't count
_rng = random.Random(7)
#: one for each short band; their first bits differ, so that they are near different hashes
MASKS = [(i * 2**64 // SHORT_BANDS + _rng.getrandbits(61)) % 2**64 - 2**63 for i in range(SHORT_BANDS)]


def shingles(t: DataFrame, line: str, *keep: str) -> DataFrame:
    """(keep, at, h): a row for each character shingle of each line in normal form, as a 64-bit hash, with its place, with repeats.

    In UTF-32 a shingle's place is known, so that taking all of them is linear in the length of a line.
    """
    wide = t.select(*keep, F.encode(line, "UTF-32").alias("wide"), F.greatest(F.length(line) - SHINGLE, F.lit(0)).alias("last"))
    each = wide.select(*keep, "wide", F.explode(F.sequence(F.lit(0), "last")).alias("at"))
    return each.select(*keep, "at", F.xxhash64(F.substring("wide", 4 * F.col("at") + 1, F.lit(4 * SHINGLE))).alias("h"))


def shingle_array(line: Column) -> Column:
    """The same of one line as an array. The outer function binds the line in UTF-32, which else would be made for each shingle."""
    places = F.sequence(F.lit(0), F.greatest(F.length(line) - SHINGLE, F.lit(0)))
    from_each = lambda wide: F.transform(places, lambda i: F.xxhash64(F.substring(wide, 4 * i + 1, F.lit(4 * SHINGLE))))
    return F.get(F.transform(F.array(F.encode(line, "UTF-32")), from_each), F.lit(0))


def normal(line: Column) -> Column:
    """The normal form of a line: without white space around, in lower case."""
    return F.lower(F.btrim(line, F.lit(WHITE)))


def counts(line: Column, least_chars: int) -> Column:
    """Whether a line in normal form takes part: not blank, and of at least so many characters."""
    return (F.length(line) >= least_chars) & (F.ascii(line).between(33, 126) | line.rlike(r"(?U)\S"))


def lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """(k, doc_id, n, line, node): lines that count (see counts), in normal form; n from 0; a node is a hash of the line."""
    parts = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), normal)
    rows = docs.select("k", "doc_id", F.posexplode(parts).alias("n", "line"))
    return rows.where(counts(F.col("line"), least_chars)).withColumn("node", F.xxhash64("line"))


def signatures(all_lines: DataFrame, bounded: bool = True) -> DataFrame:
    """(node, times, ids, m0 to m13, x0 to x7) of each line: how often it occurs, how many lines have the node, its values, MinHashes of a short one."""
    t = all_lines.select("node", "line", F.xxhash64(F.lit(1), "line").alias("other"), (F.length("line") - SHINGLE + 1).alias("n"))
    if bounded:
        t = t.withColumn("most", F.when(F.col("n") <= LEAST * VALUES, F.lit(2**63 - 1)).otherwise((2.0**64 * LEAST * VALUES / F.col("n") - 2.0**63).cast("long")))
    else:
        t = t.withColumn("most", F.lit(2**63 - 1))
    each = shingles(t, "line", "node", "other", "n", "most").where("h <= most or at = 0")
    each = each.withColumn("bin", F.pmod("h", F.lit(VALUES))).withColumn("h2", F.xxhash64("h"))
    short = lambda c, i: F.min(F.when(F.col("n") <= SHORT, F.col(c).bitwiseXOR(F.lit(MASKS[i]))))
    signed = each.groupBy("node").agg(
        F.sum((F.col("at") == 0).cast("long")).alias("times"), F.min("other").alias("lo"), F.max("other").alias("hi"), F.max("n").alias("n"),
        *(F.min(F.when(F.col("bin") == i, F.col("h"))).alias(f"b{i}") for i in range(VALUES)),
        *(short("h", i).alias(f"x{i}") for i in range(SHORT_BANDS)), *(short("h2", i).alias(f"x{SHORT_BANDS + i}") for i in range(SHORT_BANDS)),
    )
    filled = sum((F.col(f"b{i}").isNotNull().cast("int") for i in range(VALUES)), F.lit(0))
    values = [F.coalesce(*(f"b{(i + d) % VALUES}" for d in range(VALUES))).alias(f"m{i}") for i in range(VALUES)]
    few = (F.lit(bounded) & (F.col("n") > LEAST * VALUES) & (filled < VALUES // 2)).alias("few")
    return signed.select("node", "times", (F.col("lo") == F.col("hi")).alias("one"), "n", few, *values, *(f"x{i}" for i in range(2 * SHORT_BANDS)))


def candidates(signed: DataFrame) -> DataFrame:
    """(g, doc): lines that share a band, of bands with several lines."""
    keys = [F.xxhash64(F.lit(i), f"m{i}", f"m{BANDS + i}") for i in range(BANDS)]
    keys += [F.when(F.col(f"x{i}").isNotNull(), F.xxhash64(F.lit(BANDS + i), f"x{i}", f"x{SHORT_BANDS + i}")) for i in range(SHORT_BANDS)]
    bands = signed.select(F.explode(F.array_compact(F.array(*keys))).alias("g"), F.col("node").alias("doc"))
    several = bands.groupBy("g").agg(F.min("doc").alias("x"), F.max("doc").alias("y")).where("x <> y").select("g")
    return bands.join(several, "g")


def among(t: DataFrame, ids: DataFrame, on: str, most_broadcast: int) -> DataFrame:
    """Rows of t whose key is in ids: by broadcast where those are few, else by a shuffle."""
    small = ids.limit(most_broadcast + 1).count() <= most_broadcast
    return t.join(F.broadcast(ids) if small else ids, on, "left_semi")


def sketches(texts: DataFrame) -> DataFrame:
    """(node, n, w0 to w7): how many different shingles a line of texts (node, line) has, and the parity of their number in each of 512 cells."""
    each = texts.select("node", F.explode(F.array_distinct(shingle_array(F.col("line")))).alias("h"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int"))
    each = each.select("node", F.shiftright("h", 6).bitwiseAND(F.lit(WORDS - 1)).alias("word"), bit.alias("bit"))
    words = (F.bit_xor(F.when(F.col("word") == i, F.col("bit")).otherwise(F.lit(0))).alias(f"w{i}") for i in range(WORDS))
    return each.groupBy("node").agg(F.count(F.lit(1)).cast("int").alias("n"), *words)


def wide_sketches(texts: DataFrame, sketched: DataFrame) -> DataFrame:
    """sketched with a column wide: of lines of texts (node, line) with over LONG different shingles the parities in 64 x WIDE cells, as an array; else null."""
    long = sketched.where(F.col("n") > LONG).select("node")
    each = texts.join(long, "node", "left_semi").select("node", F.explode(F.array_distinct(shingle_array(F.col("line")))).alias("h"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int"))
    word = lambda shift, n: F.shiftright("h", shift).bitwiseAND(F.lit(n - 1)).cast("int")
    each = each.select("node", word(6, WORDS).alias("word"), word(9, WIDE // WORDS).alias("part"), bit.alias("bit"))
    words = F.array(*(F.bit_xor(F.when(F.col("word") == i, F.col("bit")).otherwise(F.lit(0))) for i in range(WORDS)))
    some = each.groupBy("node", "part").agg(words.alias("words")).groupBy("node").agg(F.collect_list(F.struct("part", "words")).alias("parts"))
    none = F.lit([0] * WORDS).cast("array<long>")
    dense = lambda m: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(WIDE // WORDS - 1)), lambda i: F.coalesce(F.try_element_at(m, i.cast("int")), none)))
    #: the outer function binds the map, which else would be made again for each part
    wide = F.get(F.transform(F.array(F.map_from_entries("parts")), dense), F.lit(0))
    return sketched.join(some.select("node", wide.alias("wide")), "node", "left")


def near_wide(percent: int) -> Column:
    """As near, of rows of wide_sketches: those of both lines rule out what their narrow ones don't."""
    differ = F.aggregate(F.zip_with("a_wide", "b_wide", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    may = differ.cast("long") * (100 + percent) <= (F.col("a_n") + F.col("b_n")).cast("long") * (100 - percent)
    return near(percent) & F.coalesce(may, F.lit(True))


def near(percent: int) -> Column:
    """Of a row with sketches of a and b: false only if the lines can't be similar.

    Two sets differ in at least as many shingles as cells differ in parity, and
    similar ones in no more than this share of what both have.
    """
    differ = sum((F.bit_count(F.col(f"a_w{i}").bitwiseXOR(F.col(f"b_w{i}"))) for i in range(WORDS)), F.lit(0))
    size = F.least("a_n", "b_n").cast("long") * 100 >= F.greatest("a_n", "b_n").cast("long") * percent
    return size & (differ.cast("long") * (100 + percent) <= (F.col("a_n") + F.col("b_n")).cast("long") * (100 - percent))


def jaccard(pairs: DataFrame, texts: DataFrame, sketched: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) of pairs (a, b): whether the exact similarity of the sets of texts (node, line) reaches the threshold. Pairs that sketches rule out have no row."""
    of = lambda c: sketched.select(F.col("node").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in sketched.columns[1:]))
    rated = pairs.select("a", "b").join(of("b"), "b").join(of("a"), "a").select("a", "b", near(percent).alias("near"))
    line = lambda c: texts.select(F.col("node").alias(c), F.col("line").alias(f"l{c}"))
    p = rated.where("near").join(line("b"), "b").join(line("a"), "a")
    p = p.select("a", "b", shingle_array(F.col("la")).alias("sa"), shingle_array(F.col("lb")).alias("sb"))
    p = p.select("a", "b", F.size(F.array_union("sa", "sb")).alias("all"), F.size(F.array_intersect("sa", "sb")).alias("both"))
    return p.select("a", "b", (F.col("both").cast("long") * 100 >= F.col("all").cast("long") * percent).alias("linked"))


def later_lines(docs: DataFrame, scratch: Scratch, percent: int, least_chars: int, most_broadcast: int) -> DataFrame:
    """(doc_id, k, n) of the lines that go.

    Two different lines that share a node by accident (a 64-bit hash; told by
    another) take no part, so no line goes for another that it isn't like.
    """
    all_lines = lines(docs, least_chars)
    signed = scratch.table(signatures(all_lines))
    few = scratch.table(signed.where("few").select("node"))
    if not few.isEmpty():
        again = signatures(among(all_lines, few, "node", most_broadcast), bounded=False)
        first = signed
        signed = scratch.table(first.where("not few").unionByName(again))
        scratch.drop(first)
    scratch.drop(few)
    signed = signed.where("one")
    members = scratch.table(candidates(signed))
    ids = scratch.table(members.select(F.col("doc").alias("node")).unionByName(signed.where("times > 1").select("node")).distinct())
    #: what can go, or can be what another is like; alone lines aren't read again
    occurs = scratch.table(among(all_lines, ids, "node", most_broadcast))
    texts = occurs.select("node", "line").dropDuplicates(["node"])
    texts = scratch.table(texts.join(members.select(F.col("doc").alias("node")).distinct(), "node", "left_semi"))
    sketched = scratch.table(sketches(texts))
    scratch.release()

    def closer(t: DataFrame) -> DataFrame:
        """(doc, f): half of a line's values, one of each band."""
        own = t.select("doc").distinct().join(signed.withColumnRenamed("node", "doc"), "doc")
        return own.select("doc", F.explode(F.array(*(F.xxhash64(F.lit(i), f"m{i}") for i in range(BANDS)))).alias("f"))

    verify = lambda pairs: jaccard(pairs, texts, sketched, percent)

    def sketch(ids: DataFrame) -> DataFrame:
        few = lambda t: t.join(ids.withColumnRenamed("doc", "node"), "node", "left_semi")
        return wide_sketches(few(texts), few(sketched)).withColumnRenamed("node", "doc")

    linked = link_groups(members, verify, scratch, percent, sketch, closer=closer, may=lambda a, b: near_wide(percent))
    comp = scratch.table(linked.select("node", "component"))
    at = occurs.select("node", F.struct("doc_id", "k", "n").alias("at")).join(comp, "node", "left").select(F.coalesce("component", "node").alias("c"), "at")
    first = scratch.table(at.groupBy("c").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").select("c", "first"))
    scratch.drop(texts, sketched, members, ids)
    return at.join(first, "c").where("at <> first").select("at.doc_id", "at.k", "at.n")


def dedup_lines(docs: DataFrame, percent: int = 80, least_chars: int = 1, most_broadcast: int = 1_000_000) -> DataFrame:
    """docs with n_lines and n_removed, and text without lines that a line before is like.

    Lines are linked where the Jaccard similarity of their character shingles is
    at least ``percent`` / 100; of the lines that links reach, the first in the
    order of doc_id and line stays (nulls first). Case and white space around a
    line (WHITE) don't count. Blank lines (of white space alone) always stay, and
    so do lines of fewer than ``least_chars`` characters. The remaining lines are
    joined as they were. Null texts stay null, with no lines; empty texts have
    one line. Rows that repeat both doc_id and text are one document and lose the
    same lines; of ties the smallest line number stays. A very long line is one
    line: its shingles are rows of an aggregate; where it is compared, they are
    an array. An empty table gives no rows. Columns of any other name stay,
    whatever it is; n_lines and n_removed take the place of columns of that name.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    k = F.xxhash64("doc_id", "text")
    gone = scratch.table(later_lines(docs.select("doc_id", "text", k.alias("k")), scratch, percent, least_chars, most_broadcast).distinct())
    scratch.release()
    per_doc = gone.groupBy("doc_id", "k").agg(F.sort_array(F.collect_list("n")).alias("gone"))
    extra = [c for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    d = docs.select(F.struct(*extra).alias("row") if extra else F.lit(None).alias("row"), "doc_id", "text", k.alias("k"))
    d = d.alias("d").join(per_doc.alias("p"), F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.k") == F.col("p.k")), "left")
    d = d.select("row", "text", "gone", F.split("text", "\n", -1).alias("parts"))
    #: the stretches between lines that go; looking each line up in the list would take the square of their number
    ends = F.concat("gone", F.array(F.size("parts")))
    begins = F.concat(F.array(F.lit(0)), F.transform("gone", lambda i: i + 1))
    kept = lambda parts: F.flatten(F.zip_with(begins, ends, lambda i, j: F.slice(parts, i + 1, j - i)))
    d = d.select("row", "text", "gone", F.size("parts").alias("n"), F.when(F.col("gone").isNotNull(), kept(F.col("parts"))).alias("kept"))
    null = F.col("text").isNull()
    n_lines, n_removed = F.when(null, 0).otherwise(F.col("n")).cast("long"), F.coalesce(F.size("gone"), F.lit(0)).cast("long")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n"))
    out = {c: F.col("row").getField(c) for c in extra} | {"text": text, "n_lines": n_lines, "n_removed": n_removed}
    order = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return d.select(*(out[c].alias(c) for c in [*order, "n_lines", "n_removed"]))


def report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_chars, kept_sha256 of each document."""
    d = dedup_lines(docs.select("doc_id", "text"), **how)
    text = F.coalesce("text", F.lit(""))
    return d.select("doc_id", "n_lines", "n_removed", F.length(text).cast("long").alias("kept_chars"), F.sha2(F.encode(text, "UTF-8"), 256).alias("kept_sha256"))
