"""Line deduplication by a segment-partition edit join, in DataFrame and SQL functions only.

Every line that is not blank takes part. Lines are alike when they are equal, or when their edit
distance is at most ``threshold`` and at most one for each ``PER_EDIT`` code points of the shorter
line, so a short line is alike only its copies. A line that may have t edits is cut into t + 1
segments, of which any line alike must hold one unchanged. Segments are of one size for all lines of a
class of lengths and are counted from the nearer end of the line, so that few places come into question.
Lines meet by (class, segment number, substring of the segment); both give the substrings at so few places that
some two of them differ by any admissible shift. Candidates are verified by a banded edit distance.

A segment that more than ``LIST`` lines share would give a square of pairs. There each line first meets
one line of each length, and lines alike become classes; then lines of different classes that may be alike
by their lengths and by the parities of their characters and pairs of characters, of the whole lines and of what
they begin and end with, meet. Both together are exact.

Of each class of alike lines the occurrence of smallest (doc_id, hash of the text, line number) stays;
the others go. A line goes only if one alike stays in some row.

Defined results: null text has no lines; blank lines never go; a document that loses every line it
had goes from ``without_repeated_lines``; rows without ``doc_id`` come after all others; rows of one id,
or of none, are documents of their own if their texts differ and keep the same lines if they do not;
an empty table gives no rows; extra columns of any name pass through ``without_repeated_lines`` and are
ignored elsewhere. Equal lines are told apart from others by 96 bits of hashes, lines alike by 64, and
texts of one id by 64.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.components import connected_components
from cadenza.llm.session import broadcast_up_to, cut, free_name, table
from cadenza.llm.spans import let

THRESHOLD = 4
PER_EDIT = 20
LIST = 48
BLOCK = 2048  # lines of a long list that meet in one cell with as many others
PIECES = 10  # pieces of a line, those of which are counted that one alike may hold
HEAD = 200  # characters by which most texts that are not alike are told apart
SHORT = 20_000  # longer texts are compared by bits: the time of levenshtein grows with the square, if slowly
CUTS = 8  # places, at least, up to which parities of a line in a long list are compared
BLANK = " \t\n\x0b\f\r"
BROADCAST_ROWS = 1_000_000
HOT_LINES = 500_000  # most lines whose occurrences are looked up without a shuffle
_LAST = 2**63 - 1


def row_id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(_LAST))


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, pos, line, n, id, check) for every line of every document that is not blank; ``tag`` tells texts of one id apart."""
    rows = docs.select(row_id(F.col("doc_id")).alias("doc_id"), F.xxhash64("text").alias("tag"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return rows.filter(F.ltrim("line", F.lit(BLANK)) != "").select("doc_id", "tag", "pos", "line", F.length("line").alias("n"), F.xxhash64("line").alias("id"), F.hash("line").alias("check"))


def _class(n: Column, threshold: int, per_edit: int) -> Column:
    """Class of a line of length ``n`` in units of ``per_edit``: one class a unit up to the threshold, then 2 and 3 times each power of two."""
    x = F.floor(n / per_edit)
    unit = F.when(x < 4, 1)
    for k in range(3, 9):  # most lines are short and their logarithms not worth their time
        unit = unit.when(x < 2**k, 2 ** (k - 2))
    unit = unit.otherwise(F.pow(F.lit(2.0), F.floor(F.log2(x)) - 1).cast("int"))
    return F.when(x <= threshold, x).otherwise(F.greatest(F.lit(threshold), x - x % unit)).cast("int")


def allowed(n: Column, threshold: int, per_edit: int) -> Column:
    """Edits that a line of length ``n`` may have."""
    return F.least(F.lit(threshold), F.floor(n / per_edit).cast("int"))


def shifts(most: int) -> list[int]:
    """Few places from 0 on, some two of which differ by each of 0 ... ``most``."""
    for few in ([0], [0, 1], [0, 1, 3], [0, 1, 4, 6], [0, 1, 4, 9, 11]):
        if {b - a for a in few for b in few} >= set(range(most + 1)):
            return few
    step = int(most**0.5) + 1
    return [*range(step), *range(step, most + step, step)]


def entries(lines: DataFrame, threshold: int = THRESHOLD, per_edit: int = PER_EDIT) -> DataFrame:
    """(key, id, n, c, probe): index entries of each line in its own class c, and probes for partners in the class below.

    Of t + 1 segments one is unchanged with at most as many edits before it as segments, and likewise after
    it; so segment i lies within i places of where it is counted from the line's begin, or within t - i
    counted from its end, and is looked for from the nearer side. Both lines give substrings of it at places
    of which some two differ by each such shift; a segment is longer by its last place than its substrings, which
    are of one size. Classes are wider than the threshold: a partner is of the line's own class or of that of the
    line less ``threshold`` characters.
    """
    if per_edit <= threshold:
        raise ValueError("per_edit has to be more than threshold")
    at = lambda c, own: F.struct(c.alias("c"), F.lit(own).alias("own"))
    own, less = F.col("c_own"), F.col("c_less")
    of = F.when((less < own) & (less > 0), F.array(at(own, True), at(less, False))).otherwise(F.array(at(own, True)))
    where, slack = [], []
    for t in range(1, threshold + 1):
        places = [shifts(min(i, t - i)) for i in range(t + 1)]
        slack.append(sum(x[-1] for x in places))
        # segment i begins after i substrings and the slack of the segments before it, or as far before the end as those from it on take
        head = [(i, i, sum(x[-1] for x in places[:i]) + s) for i in range(t + 1) if i <= t - i for s in places[i]]
        tail = [(i, i - t - 1, s - sum(x[-1] for x in places[i:])) for i in range(t + 1) if i > t - i for s in places[i]]
        where.append(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"), F.lit(s).alias("s")) for i, k, s in head + tail)))
    rows = lines.filter(F.col("n") >= per_edit).select("id", "n", "line", _class(F.col("n"), threshold, per_edit).alias("c_own"), _class(F.col("n") - threshold, threshold, per_edit).alias("c_less"))
    rows = rows.select("id", "n", "line", F.explode(of).alias("k"))
    rows = rows.select("id", "n", "line", "k.c", "k.own", F.least(F.col("k.c"), F.lit(threshold)).alias("t"))
    size = F.floor((F.col("c") * per_edit - F.get(F.array(*map(F.lit, slack)), F.col("t") - 1)) / (F.col("t") + 1)).cast("int")
    rows = rows.select("*", size.alias("size"), F.explode(F.get(F.array(*where), F.col("t") - 1)).alias("p"))
    size = F.col("size")
    rows = rows.withColumn("start", F.when(F.col("p.k") < 0, F.col("n")).otherwise(0) + F.col("p.k") * size + F.col("p.s"))
    # the hash of a text is that of its bytes, and those of ASCII are found without counting characters
    segment = lambda line: F.xxhash64("c", "p.i", F.substring(line, F.col("start") + 1, size))
    key = F.when(F.octet_length("line") == F.col("n"), segment(F.col("line").cast("binary"))).otherwise(segment(F.col("line")))
    return rows.select(key.alias("key"), "id", "n", "c", (~F.col("own")).alias("probe"))


def _bit(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), k)  # by the lower six bits


def _parity(bits: Column) -> Column:
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(x))


def signatures(texts: DataFrame) -> DataFrame:
    """(id, sig) of (id, line): parities of how often characters (of 64 classes) and pairs of neighbours (of 128) occur.

    An edit changes at most two of the first and four of the others.
    """

    def of(x: Column) -> Column:
        pairs = F.transform(x, lambda c, i: F.hash(c, F.coalesce(F.get(x, i + 1), F.lit(""))))
        half = lambda h, bit: _parity(F.transform(F.filter(h, lambda p: p.bitwiseAND(F.lit(64)) == bit), _bit))
        chars = _parity(F.transform(x, lambda c: _bit(F.ascii(c))))
        return let(pairs, lambda h: F.struct(chars.alias("chars"), half(h, 0).alias("low"), half(h, 64).alias("high")))

    return texts.select("id", let(F.split("line", ""), of).alias("sig"))


def part_signatures(texts: DataFrame, per_edit: int = PER_EDIT) -> DataFrame:
    """(id, c, heads, tails) of (id, c, line): parities of characters of what the line begins with, and of what it ends with.

    Element k - 1 is of k times as many characters as one of at least ``CUTS`` parts of the shortest line of class c has.
    Of the first x characters of two lines that b edits in an alignment concern at most 2 b parities differ: one of
    s substitutions and d other edits shifts the end by at most d places, 2 s + d + d in all. Likewise at the end.
    """
    part = F.ceil(F.col("c") * per_edit / CUTS).cast("int")

    def sums(bits: Column) -> Column:
        n = F.floor(F.size(bits) / F.col("part")).cast("int")
        ks = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        parts = F.transform(ks, lambda k: _parity(F.slice(bits, (k - 1) * F.col("part") + 1, F.col("part"))))
        return let(parts, lambda p: F.transform(p, lambda _, i: _parity(F.slice(p, F.lit(1), i + 1))))

    bits = F.transform(F.split("line", ""), lambda c: _bit(F.ascii(c)))
    rows = texts.withColumn("part", part)
    both = let(bits, lambda x: F.struct(sums(x).alias("heads"), sums(F.reverse(x)).alias("tails")))
    return rows.select("id", "c", both.alias("both")).select("id", "c", "both.heads", "both.tails")


def _lengths_fit(u: Column, v: Column, threshold: int, per_edit: int) -> Column:
    """May the indexed line u, not longer than v, be alike it by their lengths?"""
    return (u["id"] != v["id"]) & (u["n"] <= v["n"]) & (v["n"] - u["n"] <= allowed(u["n"], threshold, per_edit)) & ~u["probe"]


def _fits(u: Column, v: Column, threshold: int, per_edit: int) -> Column:
    """May the indexed line u, not longer than v, be alike it by lengths and signatures?

    What the lines begin with and what they end with are apart from each other, and so are their edits.
    """
    most = allowed(u["n"], threshold, per_edit)
    flips = lambda x, y: F.bit_count(x.bitwiseXOR(y))
    changed = lambda c: flips(u["sig"][c], v["sig"][c])
    upto = lambda c, k: F.coalesce(flips(F.get(u[c], k - 1), F.get(v[c], k - 1)), F.lit(0))
    parts = F.size(u["heads"])
    cuts = F.forall(F.sequence(F.lit(0), parts), lambda k: upto("heads", k) + upto("tails", parts - k) <= most * 2)
    return _lengths_fit(u, v, threshold, per_edit) & (changed("chars") <= most * 2) & (changed("low") + changed("high") <= most * 4) & cuts


def _ends(u: Column, v: Column) -> list[Column]:
    return [F.least(u["id"], v["id"]).alias("a"), F.greatest(u["id"], v["id"]).alias("b")]


def shared_entries(lines: DataFrame, threshold: int = THRESHOLD, per_edit: int = PER_EDIT) -> DataFrame:
    """(key, id, n, c, probe, held) of the entries whose key several lines hold."""
    all_ = entries(lines, threshold, per_edit)
    keys = all_.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("key")
    found = all_.join(broadcast_up_to(cut(keys), BROADCAST_ROWS), "key", "left_semi").groupBy("key", "id", "n", "c").agg(F.min("probe").alias("probe"))
    found = cut(found)
    # a join, not a window: Spark splits the partition of a key that very many lines share
    return found.join(found.groupBy("key").agg(F.count("*").alias("held")), "key")


def candidates(shared: DataFrame, long_: DataFrame, threshold: int = THRESHOLD, longest: int = LIST, per_edit: int = PER_EDIT) -> DataFrame:
    """(a, b) pairs of line ids to be verified: all of lists of up to ``longest`` lines, stars of the longer ones.

    In a longer list (``long_``, with signatures) every line meets the smallest indexed line of each length
    that allows them to be alike.
    """
    u, v = F.col("u"), F.col("v")
    short = shared.filter(F.col("held") <= longest)
    member = F.struct("id", "n", "probe")
    met = short.filter("NOT probe").select("key", member.alias("u")).join(short.select("key", member.alias("v")), "key")
    pairs = met.filter(_lengths_fit(u, v, threshold, per_edit)).select(*_ends(u, v))
    member = F.struct("id", "n", "probe", "sig", "heads", "tails")
    first = long_.filter("NOT probe").groupBy("key", "n").agg(F.min(member).alias("u"))
    first = first.select("key", "u", F.explode(F.sequence(F.col("n"), F.col("n") + threshold)).alias("n"))  # few rows, unlike those that meet them
    met = long_.select("key", "n", member.alias("v")).join(first, ["key", "n"])
    stars = met.filter(_fits(u, v, threshold, per_edit)).select(*_ends(u, v))
    return pairs.unionByName(stars).distinct()


def between_classes(long_: DataFrame, root: DataFrame, threshold: int, per_edit: int, block: int = BLOCK) -> DataFrame:
    """(a, b) pairs of lines of one long list that may be alike and that no path of verified edges connects as yet.

    Blocks of a list meet two by two, in cells. Lines that many others are alike are of one class by then, so
    few pairs are left; what grows with the square of a list's length is the comparison of signatures. Lines
    that share several lists are a pair in the first of them only.
    """
    blocks = F.ceil(F.col("held") / block).cast("int")
    lists = long_.groupBy("id").agg(F.collect_set(F.when(~F.col("probe"), F.col("key"))).alias("own_keys"), F.collect_set("key").alias("keys"))
    rows = long_.join(root, "id", "left").join(lists, "id").withColumn("root", F.coalesce("root", "id")).withColumn("own", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    every = F.explode(F.sequence(F.lit(0), blocks - 1))
    member = ["id", "n", "probe", "sig", "heads", "tails", "root"]
    left = rows.filter("NOT probe").select("key", F.col("own").alias("i"), every.alias("j"), F.struct(*member, "own_keys").alias("u"))
    right = rows.select("key", every.alias("i"), F.col("own").alias("j"), F.struct(*member, "keys").alias("v"))
    u, v = F.col("u"), F.col("v")
    once = ((u["n"] < v["n"]) | (u["id"] < v["id"])) & (F.get(F.array_intersect(u["own_keys"], v["keys"]), F.lit(0)) == F.col("key"))
    return left.join(right, ["key", "i", "j"]).filter((u["root"] != v["root"]) & _fits(u, v, threshold, per_edit) & once).select(*_ends(u, v)).distinct()


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two texts, by bisection; ASCII is compared as bytes, which need not be counted."""

    def bisected(p: Column) -> Column:
        top = F.least(F.length(p["a"]), F.length(p["b"]))

        def step(acc: Column, _: Column) -> Column:
            def halve(q: Column) -> Column:
                same = F.substring(p["a"], F.lit(1), q["mid"]) == F.substring(p["b"], F.lit(1), q["mid"])
                return F.when(same, F.struct(q["mid"].alias("lo"), q["hi"].alias("hi"))).otherwise(F.struct(q["lo"].alias("lo"), (q["mid"] - 1).alias("hi")))

            mid = F.floor((acc["lo"] + acc["hi"] + 1) / 2).cast("int")
            return let(F.struct(acc["lo"].alias("lo"), acc["hi"].alias("hi"), mid.alias("mid")), halve)

        steps = F.sequence(F.lit(0), F.ceil(F.log2(top + 2.0)).cast("int"))
        return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), top.alias("hi")), step)["lo"]

    def of(p: Column) -> Column:
        ascii_ = (F.octet_length(p["a"]) == F.length(p["a"])) & (F.octet_length(p["b"]) == F.length(p["b"]))
        as_bytes = F.struct(p["a"].cast("binary").alias("a"), p["b"].cast("binary").alias("b"))
        return F.when(ascii_, let(as_bytes, bisected)).otherwise(bisected(p))

    return let(F.struct(a.alias("a"), b.alias("b")), of)


def banded_distance(a: Column, b: Column, threshold: int) -> Column:
    """Edit distance of two texts if it is at most ``threshold``, else threshold + 1.

    The band of 2 * threshold + 1 diagonals is one word of bits. For each character of ``b`` the
    vertical differences along the band are updated by the bit-parallel recurrence, and the value on
    the band's last diagonal is followed. What both texts begin and end with is left out beforehand; long texts whose
    next ``HEAD`` characters differ by more than twice the threshold are further apart than it, and for texts of
    up to ``SHORT`` characters Spark's own function is faster. ``threshold`` is from 1 to 30.
    """
    width = 2 * threshold + 1
    mask = (1 << width) - 1

    def of(p: Column) -> Column:
        x, y, m, n = p["x"], p["y"], p["m"], p["n"]
        far = F.lit(threshold + 1)
        # twice the threshold takes a band of twice the width
        apart = (F.greatest(m, n) > 4 * HEAD) & (F.levenshtein(F.substring(x, 1, HEAD), F.substring(y, 1, HEAD), 2 * threshold) < 0)
        short = let(F.levenshtein(x, y, threshold), lambda d: F.when(d < 0, far).otherwise(d))
        long_ = let(F.struct(F.split(x, "").alias("x"), F.split(y, "").alias("y"), m.alias("m"), n.alias("n")), in_band)
        return F.when(F.abs(m - n) > threshold, far).when((m == 0) | (n == 0), F.greatest(m, n)).when(apart, far).when(F.greatest(m, n) <= SHORT, short).otherwise(long_)

    def in_band(p: Column) -> Column:
        x, y, m, n = p["x"], p["y"], p["m"], p["n"]

        def match(j: Column) -> Column:
            """Bits of the band's rows (j - threshold ... j + threshold) whose character equals y's at j."""
            c = F.get(y, j - 1)
            bits = [F.when((j + d >= 1) & (j + d <= m) & (F.get(x, j + d - 1) == c), F.lit(1 << (d + threshold)).cast("long")).otherwise(F.lit(0).cast("long")) for d in range(-threshold, threshold + 1)]
            total = bits[0]
            for bit in bits[1:]:
                total = total.bitwiseOR(bit)
            return total

        def step(acc: Column, j: Column) -> Column:
            """One column: bits of the band shift down by one row."""

            def go(q: Column) -> Column:
                eq, vp, vn = q["eq"], q["vp"], q["vn"]
                carry = eq.bitwiseAND(vp) + vp
                d0 = carry.bitwiseXOR(vp).bitwiseOR(eq).bitwiseOR(vn).bitwiseAND(F.lit(mask).cast("long"))
                hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp))).bitwiseAND(F.lit(mask).cast("long"))
                hn = d0.bitwiseAND(vp)
                down = F.shiftright(d0, 1)
                vp2 = hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp))).bitwiseAND(F.lit(mask).cast("long"))
                vn2 = hp.bitwiseAND(down)
                # along the lowest diagonal until the last row is in reach, then along that row
                low = F.when(F.shiftrightunsigned(d0, width - 1).bitwiseAND(F.lit(1).cast("long")) == 0, 1).otherwise(0)
                at = (m - j + threshold).cast("int")  # place of row m in this column's band
                reach = j + threshold > m
                row = F.getbit(hp, F.greatest(at, F.lit(0))).cast("int") - F.getbit(hn, F.greatest(at, F.lit(0))).cast("int")
                score = q["score"] + F.when(reach, row).otherwise(low)
                return F.struct(vp2.alias("vp"), vn2.alias("vn"), score.alias("score"))

            on = let(F.struct(match(j).alias("eq"), acc["vp"].alias("vp"), acc["vn"].alias("vn"), acc["score"].alias("score")), go)
            return F.when(acc["score"] > 3 * threshold, acc).otherwise(on)  # the last row takes off at most 2 * threshold

        start = F.struct(F.lit(mask & ~((1 << threshold) - 1)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.least(F.lit(threshold), m).alias("score"))
        return F.least(F.lit(threshold + 1), F.aggregate(F.sequence(F.lit(1), n), start, step)["score"])

    def trimmed(k: Column) -> Column:
        u, v = k["u"], k["v"]
        ru, rv = F.reverse(u), F.reverse(v)
        tail = common_prefix(ru, rv)
        return let(tail, lambda t: F.struct(F.substring(u, F.lit(1), F.length(u) - t).alias("x"), F.substring(v, F.lit(1), F.length(v) - t).alias("y"), (F.length(u) - t).alias("m"), (F.length(v) - t).alias("n")))

    head = let(common_prefix(a, b), lambda p: F.struct(F.substring(a, p + 1, F.length(a)).alias("u"), F.substring(b, p + 1, F.length(b)).alias("v")))
    return let(let(head, trimmed), of)


def pieces_shared(a: Column, b: Column) -> Column:
    """How many of ``PIECES`` pieces of ``a`` occur in ``b``: all but one for each edit, and few in texts that are not alike."""
    size = F.floor(F.length(a) / PIECES).cast("int")
    return sum((F.contains(b, F.substring(a, size * k + 1, size)).cast("int") for k in range(1, PIECES)), F.contains(b, F.substring(a, F.lit(1), size)).cast("int"))


def texts_of(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, line) for each of ``ids``."""
    return lines.select("id", "line").join(broadcast_up_to(ids, BROADCAST_ROWS), "id").groupBy("id").agg(F.min("line").alias("line"))


def verified(pairs: DataFrame, texts: DataFrame, threshold: int, per_edit: int) -> DataFrame:
    """Those of ``pairs`` whose lines are alike, by their banded edit distance."""
    left, right = texts.select(F.col("id").alias("a"), F.col("line").alias("x")), texts.select(F.col("id").alias("b"), F.col("line").alias("y"))
    most = allowed(F.least(F.length("x"), F.length("y")), threshold, per_edit)
    pairs = cut(pairs)  # few bytes but much work: not to be put together into few tasks
    spread = pairs.repartition(max(pairs.sparkSession.sparkContext.defaultParallelism * 2, -(-pairs.count() // 10_000)), "a", "b")
    return spread.join(left, "a").join(right, "b").filter((pieces_shared(F.col("x"), F.col("y")) >= PIECES - most) & (banded_distance(F.col("x"), F.col("y"), threshold) <= most)).select("a", "b")


def alike(docs: DataFrame, threshold: int = THRESHOLD, longest: int = LIST, per_edit: int = PER_EDIT, block: int = BLOCK) -> DataFrame:
    """(id, root): the class of every line that is alike another, different line."""
    lines = lines_of(docs)
    shared = cut(shared_entries(lines, threshold, per_edit))
    texts = cut(texts_of(lines.filter(F.col("n") >= per_edit), shared.select("id").distinct()))
    long_ = shared.filter(F.col("held") > longest)
    far = texts.join(broadcast_up_to(long_.select("id", "c").distinct(), BROADCAST_ROWS), "id")
    long_ = cut(long_.join(signatures(far.dropDuplicates(["id"])), "id").join(part_signatures(far, per_edit), ["id", "c"]))
    edges = cut(verified(candidates(shared, long_, threshold, longest, per_edit), texts, threshold, per_edit))
    root = connected_components(edges).select(F.col("node").alias("id"), "root")
    if long_.isEmpty():
        return root
    root = cut(root)
    more = cut(verified(between_classes(long_, root, threshold, per_edit, block), texts, threshold, per_edit))
    return root if more.isEmpty() else merged(root, more)


def merged(root: DataFrame, more: DataFrame) -> DataFrame:
    """(id, root): the classes ``root`` and what the edges ``more`` join them with."""
    of = lambda end: root.select(F.col("id").alias(end), F.col("root").alias(f"root_{end}"))
    ends = cut(more.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("root_a", "a").alias("x"), F.coalesce("root_b", "b").alias("y")))
    whole = connected_components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()).select(F.col("node").alias("root"), F.col("root").alias("whole"))
    alone = ends.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(root, "id", "left_anti").select("id", F.col("id").alias("root"))
    return root.unionByName(alone).join(whole, "root", "left").select("id", F.coalesce("whole", "root").alias("root"))


def removed_lines(docs: DataFrame, threshold: int = THRESHOLD, longest: int = LIST, per_edit: int = PER_EDIT) -> DataFrame:
    """(doc_id, tag, pos, exact): the lines that go; ``exact`` where the line that stays is the same."""
    lines = lines_of(docs).select("doc_id", "tag", "pos", "id", "check")
    root = cut(alike(docs, threshold, longest, per_edit))
    first = lines.groupBy("id", "check").agg(F.min(F.struct("doc_id", "tag", "pos")).alias("own"), F.count("*").alias("times")).join(broadcast_up_to(root, BROADCAST_ROWS), "id", "left")
    # a class is a component of lines alike, or the copies of one line
    first = cut(first.filter("root IS NOT NULL OR times > 1"))
    classes = first.filter("root IS NOT NULL").groupBy("root").agg(F.min("own").alias("first"))
    near, copies = first.join(classes, "root"), first.filter("root IS NULL").withColumn("first", F.col("own"))
    stay = cut(near.unionByName(copies).select("id", "check", "own", "first", "times"))
    total = stay.agg(F.sum("times").alias("n")).first().n or 0
    most = max(256, total // HOT_LINES)  # at most HOT_LINES lines occur more often: they are broadcast, the others meet by a shuffle
    fact = F.struct("own", "first")
    hot = stay.filter(F.col("times") > most).select("id", "check", fact.alias("hot"))
    rest = stay.filter(F.col("times") <= most).select(F.col("id").alias("id_"), F.col("check").alias("check_"), fact.alias("rare"))
    known = lines.join(F.broadcast(hot), ["id", "check"], "left")
    # a line found already meets nothing, under a key of its own
    key = F.when(F.col("hot").isNull(), F.col("id")).otherwise(F.xxhash64("doc_id", "tag", "pos"))
    found = known.withColumn("key", key).join(rest, (F.col("key") == F.col("id_")) & (F.col("check") == F.col("check_")), "left").withColumn("fact", F.coalesce("hot", "rare"))
    return found.filter(F.struct("doc_id", "tag", "pos") != F.col("fact.first")).select("doc_id", "tag", "pos", (F.col("fact.own") == F.col("fact.first")).alias("exact"))


def repeated_lines(docs: DataFrame, threshold: int = THRESHOLD, longest: int = LIST) -> DataFrame:
    """(doc_id, n_lines, n_exact, n_near, removed) for every row of ``docs``; ``removed`` lists line numbers from 0."""
    gone = removed_lines(docs, threshold, longest).groupBy(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag")).agg(F.array_sort(F.collect_set("pos")).alias("gone"), F.countDistinct(F.when(F.col("exact"), F.col("pos"))).alias("n_exact"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long").alias("n_lines"), F.col("text").isNull().alias("none"))
    rows = own.join(gone, (row_id(own.doc_id) == gone["_id"]) & (own.tag == gone["_tag"]), "left")
    n = F.coalesce(F.size("gone"), F.lit(0)).cast("long")
    exact = F.coalesce("n_exact", F.lit(0))
    return rows.select("doc_id", F.when(F.col("none"), 0).otherwise(F.col("n_lines")).alias("n_lines"), exact.alias("n_exact"), (F.greatest(n, F.lit(0)) - exact).alias("n_near"), F.coalesce(F.array_join("gone", ","), F.lit("")).alias("removed"))


def without_repeated_lines(docs: DataFrame, threshold: int = THRESHOLD, longest: int = LIST) -> DataFrame:
    """``docs`` with repeated lines taken out of the text; documents left without any line go.

    ``n_chars``, where there is one, follows the text.
    """
    columns = docs.columns
    id_, tag_, gone_, kept_ = (free_name(columns, c) for c in ("gone_id", "gone_tag", "gone", "kept"))
    gone = removed_lines(docs.select("doc_id", "text"), threshold, longest).groupBy(F.col("doc_id").alias(id_), F.col("tag").alias(tag_)).agg(F.collect_set("pos").alias(gone_))
    rows = docs.join(gone, (row_id(F.col("doc_id")) == F.col(id_)) & (F.xxhash64("text") == F.col(tag_)), "left")
    kept = let(F.split("text", "\n", -1), lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col(gone_)), lambda i: F.get(ls, i)), "\n"))
    rows = rows.withColumn(kept_, F.when(F.col(gone_).isNotNull() & F.col("text").isNotNull(), kept))
    rows = rows.filter(F.col(kept_).isNull() | F.col(kept_).rlike(r"\S"))
    out = {"text": F.coalesce(kept_, "text")} | ({"n_chars": F.when(F.col(kept_).isNull(), F.col("n_chars")).otherwise(F.length(kept_).cast(dict(docs.dtypes)["n_chars"]))} if "n_chars" in columns else {})
    return rows.select(*(out[c].alias(c) if c in out else F.col(c) for c in columns))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
