"""Secret scan. DataFrame functions only.

Base spans come from three patterns. The method adds spans: long runs of
key-like characters are candidates, by character class; a window slides over a
candidate, and the Shannon entropy of what it holds is kept up by incremental
counts, one character in and one out at each step. Candidates whose highest
window entropy reaches the threshold of their class are spans, unless the
allow-list knows them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of the base spans: fixed values.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "entropy")
#: Cheap tests that each pattern's matches pass: texts without a hit aren't cut.
_MAY = {"assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]", "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}

#: Classes of candidates: name -> (pattern of a whole candidate, alphabet, bits that the best window needs).
CLASSES = {
    "hex": (r"^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdefABCDEF", 3.0),
    "alnum": (r"^[A-Za-z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 3.6),
    "base64": (r"^[A-Za-z0-9+/_=-]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-", 3.7),
}
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Candidates that are known not to be secrets: words alone, UUIDs, one character or short pattern again and again, names of examples, paths of words.
ALLOW = (
    r"^[A-Za-z_/=+-]+$", r"^[0-9_/=+-]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^(.{1,4})\1{3,}.{0,3}$", r"(?i)example|placeholder|dummy|x{6,}", r"(?i)^0123456789abcdef|^abcdefghijklmnop",
    r"^(?:[A-Za-z]+|[0-9]{1,4})(?:[-_/](?:[A-Za-z]+|[0-9]{1,4})){1,40}$",
)


BLOCK = 256


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, op, zero: int) -> Column:
    """``op`` over each value and all before it, for an array of int; linear, but for block totals.

    A fold that appends to an array copies it at each step, so it runs over blocks of BLOCK values, then over their totals.
    """
    last = lambda acc: F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(zero))
    fold = lambda part, start: F.aggregate(part, start, lambda acc, x: F.concat(acc, F.array(op(last(acc), x))))
    none = F.array().cast("array<int>")

    def whole(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda k: F.slice(v, k * BLOCK + 1, F.lit(BLOCK)))
        local = F.transform(blocks, lambda part: fold(part, none))
        lift = lambda parts: F.zip_with(parts, F.slice(fold(F.transform(parts, last), F.array(F.lit(zero))), F.lit(1), F.size(parts)), lambda part, o: F.transform(part, lambda y: op(o, y)))
        return F.when(F.size(v) == 0, none).otherwise(F.flatten(let(local, lift)))

    return let(values, whole)


def _spans(text: Column, pattern: str, kind: str, hits: Column) -> Column:
    """Array of (start, kind, end) of leftmost non-overlapping matches; hits: (m, ok) of each, its length and whether it is kept.

    The stretches between the matches come from a split by the same pattern, so
    positions are sums of lengths; all lengths are in code points.
    """
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))

    def placed(steps: Column) -> Column:
        ends = running(F.transform(steps, lambda s: s["g"] + s["m"]), lambda x, y: x + y, 0)
        kept = F.filter(F.zip_with(steps, ends, lambda s, e: F.struct((e - s["m"]).alias("start"), e.alias("end"), s["ok"].alias("ok"))), lambda s: s["ok"])
        return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))

    both = let(hits, lambda h: F.zip_with(F.slice(gaps, F.lit(1), F.size(h)), h, lambda g, x: F.struct(g.alias("g"), x["m"].alias("m"), x["ok"].alias("ok"))))
    return let(both, placed)


def _hits(text: Column, pattern: str, ok) -> Column:
    """(m, ok) of each match; ok is a function of the match."""
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.struct(F.length(m).alias("m"), ok(m).alias("ok")))


def _bits(c: Column) -> Column:
    """c log2 c"""
    return F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(0.0)


def window_entropy(s: Column, alphabet: str, window: int = WINDOW) -> Column:
    """Highest Shannon entropy (bits) of ``window`` (at most 63) characters in a row; of a shorter string, 0.

    State: the count of each character of the alphabet in the window and the sum
    of c log2 c over them, both changed by the two characters that a step moves.
    Counts are 6 bits each, ten to a long, so a step rewrites a few longs. Characters
    outside the alphabet count as one.
    """
    words = -(-(len(alphabet) + 1) // 10)
    shift = lambda p: (p % 10 * 6).cast("int")
    one = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), shift(p))
    count = lambda n, p: F.call_function("shiftrightunsigned", F.get(n, F.floor(p / 10).cast("int")), shift(p)).bitwiseAND(F.lit(63))
    moved = lambda n, p, by: F.transform(n, lambda x, k: F.when(k == F.floor(p / 10), x + by * one(p)).otherwise(x))

    def best(places: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            came, went = F.get(places, i), F.get(places, i - window)  # null: none goes
            a = count(acc["n"], came)
            up = acc["sum"] - _bits(a) + _bits(a + 1)
            n = moved(acc["n"], came, 1)

            def leave(m: Column) -> Column:
                b = count(m, went)
                down = F.when(went.isNull(), up).otherwise(up - _bits(b) + _bits(b - 1))
                now = F.when(i >= window - 1, F.log2(F.lit(float(window))) - down / window).otherwise(0.0)
                return F.struct(F.when(went.isNull(), m).otherwise(moved(m, went, -1)).alias("n"), down.alias("sum"), F.greatest(acc["best"], now).alias("best"))

            return let(n, leave)

        start = F.struct(F.array_repeat(F.lit(0).cast("long"), words).alias("n"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))
        return F.when(F.size(places) < window, 0.0).otherwise(F.aggregate(F.sequence(F.lit(0), F.size(places) - 1), start, step)["best"])

    return let(F.transform(F.split(s, ""), lambda c: F.position(c, F.lit(alphabet))), best)


def is_key(s: Column) -> Column:
    """Whether a candidate's entropy reaches its class's threshold and no allow-list entry suppresses it."""
    allowed = F.lit(False)
    for a in ALLOW:
        allowed = allowed | s.rlike(a)
    verdict = F.lit(False)
    for pattern, alphabet, bits in reversed(CLASSES.values()):
        verdict = F.when(s.rlike(pattern), window_entropy(s, alphabet) >= bits).otherwise(verdict)
    return F.when(allowed, False).otherwise(verdict)


def found_in(text: Column) -> tuple[Column, Column]:
    """(base, spans) of a text without nulls: arrays of (start, kind, end) in order, kind an index of KINDS."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    values = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 6)
    pairs = F.zip_with(F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(0)), lambda m: F.length(m)), values, lambda m, ok: F.struct(m.alias("m"), ok.alias("ok")))
    assign = F.when(text.rlike(_MAY["assign"]), _spans(text, ASSIGN, "assign", pairs)).otherwise(none)
    access = F.when(text.rlike(_MAY["access"]), _spans(text, ACCESS, "access", _hits(text, ACCESS, lambda m: F.length(m) >= 20))).otherwise(none)
    # a maximal run of 24 and more is the same as a run that has 24 and more
    hexes = F.when(text.rlike(_MAY["hex"]), _spans(text, HEX[:-1] + "{24,}", "hex", _hits(text, HEX[:-1] + "{24,}", lambda m: F.lit(True)))).otherwise(none)
    entropy = F.when(text.rlike(CANDIDATE), _spans(text, CANDIDATE, "entropy", _hits(text, CANDIDATE, is_key))).otherwise(none)
    base = F.array_sort(F.concat(assign, access, hexes))
    return base, F.array_sort(F.concat(base, entropy))


def scan(docs: DataFrame) -> DataFrame:
    """Adds to the columns of docs: base and spans (which take the place of columns of that name).

    Positions are code points, end exclusive. Null text: no spans. An entropy span
    that a base span covers stands beside it. Nothing is shuffled; rows are
    scanned each, whether they repeat or not. An empty table gives no rows. Time
    is in proportion to the length of a text, however many or long its candidates.
    """
    base, spans = found_in(F.coalesce(F.col("text"), F.lit("")))
    return docs.withColumns({"base": base, "spans": spans})


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: the scan of each row as counts and text."""
    s = scan(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return s.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(F.encode(joined(F.col("base")), "UTF-8"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """docs with each maximal run of overlapping spans replaced by ``mask``; other columns stay as they are, whatever their names. Null stays null."""
    text = F.coalesce("text", F.lit(""))

    def masked(spans: Column) -> Column:
        """Stretches between runs. A run begins where a span starts at or after all ends before it; UTF-32 gives a stretch its place."""

        def cut(reach: Column) -> Column:
            before = F.concat(F.array(F.lit(0)), reach)  # the furthest end before each span, and at last that of all
            starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text)))
            pieces = F.filter(F.zip_with(before, starts, lambda i, j: F.struct(i.alias("i"), j.alias("j"))), lambda p: p["j"] >= p["i"])
            wide = lambda w: F.transform(pieces, lambda p: F.decode(F.substring(w, 4 * p["i"] + 1, 4 * (p["j"] - p["i"])), "UTF-32"))
            return F.array_join(let(F.encode(text, "UTF-32"), wide), mask)

        return let(running(F.transform(spans, lambda s: s["end"]), F.greatest, 0), cut)

    new = let(found_in(text)[1], lambda spans: F.when(F.size(spans) > 0, masked(spans)))
    return docs.select(*(F.coalesce(new, F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns))
