"""Line deduplication with a segment-partition edit join.

Equal lines are one by digest. Lines of at least ``min_length`` characters are also one when their edit distance is at most
``threshold``. A line is cut into threshold + 1 segments; within so few edits one segment stays whole, so it is found among
the substrings of the other line at a position that depends on the two lengths. Every line indexes its segments and probes
for lines of its own length and up to ``threshold`` less, at the positions that are possible (multi-match-aware: a shift
beyond the edits left and right of it is not probed). Length, segment number and content make the key.

No key group is expanded into all its pairs: members are compared with the smallest one first. Lines of groups that then
hold several components go by one-edit keys (threshold 1), whose groups need no further comparison; beyond threshold 1,
members of different components are compared, unless their distances to the smallest one exclude a link (triangle inequality).
Candidates are verified by a banded bit-parallel edit distance over code points.

Of a group the first line stays, by document id and line number. Blank lines always stay.

Defined results: null and empty texts have one blank line. Null ids come first. Rows that repeat an id are counted together,
and line numbers of equal rows stand for all of them. Very long texts leave their row line by line. An empty table gives
an empty result. Other columns are not read; ``drop_repeated_lines`` passes them through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.functions.binding import let
from adloom.llm.common import need
from adloom.llm.graph import components
from adloom.session import shared_dir, staged

THRESHOLD = 1
MIN_LENGTH = 24
BROADCAST_ROWS = 1_000_000


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line."""
    return need(docs, "doc_id", "text").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))


def _bounds(length: Column, parts: int, i: int) -> tuple[Column, Column]:
    """Start (from 1) and size of segment i of a line: the last ones are longer by one where it does not divide."""
    size, longer = F.floor(length / parts), F.pmod(length, F.lit(parts))
    plain = F.lit(parts) - longer
    start = size * i + F.greatest(F.lit(i) - plain, F.lit(0)) + 1
    return start.cast("int"), (size + F.when(F.lit(i) >= plain, 1).otherwise(0)).cast("int")


def keys(line: Column, threshold: int) -> Column:
    """Hashes of the index segments and of the probe substrings of a line."""
    parts = threshold + 1
    length = F.char_length(line)
    out = []
    for i in range(parts):
        start, size = _bounds(length, parts, i)
        out.append(F.xxhash64(length, F.lit(i), F.substr(line, start, size)))
        for less in range(threshold + 1):
            start, size = _bounds(length - less, parts, i)
            for shift in range(-threshold, threshold + 1):
                # Position start + shift: |shift| edits to the left at most i, and |less - shift| to the right at most threshold - i.
                # As |shift| <= i, the position lies inside the line wherever segments hold a character at least.
                if abs(shift) <= i and abs(less - shift) <= threshold - i and (less or shift):
                    out.append(F.xxhash64(length - less, F.lit(i), F.substr(line, start + F.lit(shift), size)))
    return F.array(*out)


def one_edit_keys(line: Column) -> Column:
    """Keys that two lines share if and only if one edit at most lies between them.

    They are pairs of a text and a position: the line without its character there, and the line itself. A substitution leaves
    equal texts at its position; the longer line of an insertion leaves the shorter one. All lines of one key are within one
    edit of each other, so comparing them with one of them is enough.
    """
    n = F.char_length(line)
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda p: F.xxhash64(F.concat(F.substr(line, F.lit(1), p), F.substr(line, p + 2, n)), p))
    return F.concat(cut, F.transform(F.sequence(F.lit(0), n), lambda p: F.xxhash64(line, p)))


def all_but_one_keys(line: Column, parts: int = 16) -> Column:
    """Keys of a line without one of ``parts`` windows, as a line of its own length and as one with a character more. Lines within one edit share one."""
    def key(length, j):
        i, own = F.pmod(j, F.lit(parts)), length - F.floor(j / parts).cast("int")
        size, longer = F.floor(own / parts).cast("int"), F.pmod(own, F.lit(parts))
        start = size * i + F.greatest(i - (F.lit(parts) - longer), F.lit(0)) + 1
        end = start + size + F.when(i >= F.lit(parts) - longer, 1).otherwise(0) - 1
        return F.xxhash64(own, i, F.substr(line, F.lit(1), start - 1), F.substr(line, length - (own - end) + 1, own - end))
    return let(F.char_length(line), lambda n: F.transform(F.sequence(F.lit(0), F.lit(2 * parts - 1)), lambda j: key(n, j)))


def edit_distance(a: Column, b: Column, most: int) -> Column:
    """Edit distance of two texts if it is at most ``most``, else most + 1: bit-parallel over a diagonal band of 2 most + 1 cells.

    Bits of the band stand for the cells of one column, lowest first, bit ``most`` for the diagonal. The column moves one
    row down per character, so vertical differences are shifted right. ``a`` must be the longer text.
    """
    width = 2 * most + 1
    full = F.lit((1 << width) - 1).cast("long")

    def over(ab):
        x, y = ab["x"], ab["y"]  # the rows are the characters of x, the columns those of y
        n, m = F.size(x), F.size(y)

        def step(s, j):
            # Bit o compares character j of y with character j + o - most of x.
            match = None
            for o in range(width):
                at = j + F.lit(o - most)
                bit = F.when((at >= 0) & (F.get(x, F.greatest(at, F.lit(0))) == F.get(y, j)), F.lit(1 << o).cast("long")).otherwise(F.lit(0).cast("long"))
                match = bit if match is None else match.bitwiseOR(bit)

            def column(pm):
                vp, vn = s["vp"], s["vn"]
                d0 = (pm.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(pm).bitwiseOR(vn)

                def rest(d):
                    hp = vn.bitwiseOR(F.bitwise_not(d.bitwiseOR(vp)).bitwiseAND(full))
                    hn = d.bitwiseAND(vp)
                    down = F.shiftright(d.bitwiseAND(full), 1)
                    nvp = hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp)).bitwiseAND(full))
                    # Distance at the cell of the last row of x, or on the band's lowest diagonal until that row is reached.
                    low = F.when(j + F.lit(most) < n, F.when(F.shiftright(d, width - 1).bitwiseAND(F.lit(1).cast("long")) == 0, 1).otherwise(0))
                    row = (n - 1 - j + most).cast("int")  # bit of the last row in this column
                    side = F.getbit(hp, F.greatest(F.least(row, F.lit(width - 1)), F.lit(0))).cast("int") - F.getbit(hn, F.greatest(F.least(row, F.lit(width - 1)), F.lit(0))).cast("int")
                    return F.struct(nvp.alias("vp"), down.bitwiseAND(hp).alias("vn"), (s["dist"] + F.coalesce(low, side)).cast("int").alias("dist"))
                return let(d0, rest)
            return let(match, column)
        # Before the first column, rows above the text count as reached for nothing; below, each row costs one.
        start = F.struct((full - F.lit((1 << most) - 1).cast("long")).bitwiseAND(full).alias("vp"), F.lit(0).cast("long").alias("vn"), F.least(n, F.lit(most)).cast("int").alias("dist"))
        found = F.aggregate(F.sequence(F.lit(0), m - 1), start, step)["dist"]
        plain = F.when(n - m > most, most + 1).when(m == 0, n).otherwise(F.least(found, F.lit(most + 1)))
        return plain
    return let(F.struct(F.split(a, "").alias("x"), F.split(b, "").alias("y")), over)


def line_links(occurrences: DataFrame, folder: str, threshold: int, min_length: int) -> DataFrame:
    """(id, component_id) of the digests of lines that edit links join."""
    long_lines = occurrences.filter(F.char_length("line") >= min_length)
    probes = long_lines.select(F.xxhash64("line").alias("h"), F.explode(keys(F.col("line"), threshold)).alias("key"))
    heads = probes.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("z")).filter("a < z").select("key", "a")
    shared = staged(probes.join(heads, "key").groupBy("key", "h").agg(F.min("a").alias("a")), folder, "shared")
    wanted = staged(shared.select("h").distinct(), folder, "wanted")
    # Up to so many hashes of 8 bytes are sent to the lines; of more, the lines go to the hashes.
    small = wanted.count() <= BROADCAST_ROWS
    # One row per candidate line, told apart by content.
    texts = staged(long_lines.withColumn("h", F.xxhash64("line")).join(F.broadcast(wanted) if small else wanted, "h", "left_semi").groupBy("h", "digest").agg(F.max("line").alias("line")), folder, "texts")
    one, two = (texts.select(F.col("h").alias(s), F.col("digest").alias(f"d{s}"), F.col("line").alias(f"line_{s}")) for s in "ab")

    def measured(pairs: DataFrame, most: int, name: str) -> DataFrame:
        """Distances of the lines of each pair of hashes, most + 1 beyond ``most``."""
        both = pairs.join(two, "b").join(one, "a").filter("da <> db")
        longer = F.char_length("line_a") >= F.char_length("line_b")
        distance = edit_distance(F.when(longer, F.col("line_a")).otherwise(F.col("line_b")), F.when(longer, F.col("line_b")).otherwise(F.col("line_a")), most)
        close = F.abs(F.char_length("line_a") - F.char_length("line_b")) <= most
        return staged(both.select("a", "b", "da", "db", F.when(close, distance).otherwise(most + 1).alias("d")), folder, name)
    star = shared.filter("h <> a").select("a", F.col("h").alias("b")).distinct()
    first = measured(star, 2 * threshold, "first")
    found = components(first.filter(F.col("d") <= threshold).select(F.col("da").alias("a"), F.col("db").alias("b")), folder, "star", native=True)
    # Key groups of several components: what the comparison with the smallest line has left open.
    label = texts.select("h", "digest").join(found.withColumnRenamed("id", "digest"), "digest", "left").select("h", F.coalesce("component_id", "digest").alias("c"))
    far = first.groupBy("a", F.col("b").alias("h")).agg(F.min("d").alias("d"))
    rows = shared.join(label, "h").join(far, ["a", "h"], "left").withColumn("d", F.when(F.col("a") == F.col("h"), 0).otherwise(F.coalesce("d", F.lit(2 * threshold + 1))))
    several = rows.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high").select("key")
    left = staged(rows.join(several, "key", "left_semi"), folder, "open")
    if threshold == 1:
        # Open lines that agree with another one outside of a sixteenth go by one-edit keys, whose groups are within one edit throughout.
        open_lines = staged(left.select("h").distinct().join(texts, "h").select("h", "line"), folder, "open-lines")
        rough = open_lines.select("h", F.explode(all_but_one_keys(F.col("line"))).alias("key"))
        shared_rough = rough.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("z")).filter("a < z").select("key")
        near = staged(rough.join(shared_rough, "key", "left_semi").select("h").distinct(), folder, "near")
        lines = open_lines.join(near, "h").select("h", F.explode(let(F.col("line"), one_edit_keys)).alias("key"))
        edits = lines.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("z")).filter("a < z").select("key", "a")
        rest = lines.join(edits, "key").filter("h <> a").select("a", F.col("h").alias("b")).distinct()
    else:
        x, y = left.alias("x"), left.alias("y")
        # Distances above 2 threshold are only known to be so; two such lines may be near each other.
        beyond = 2 * threshold
        apart = (F.abs(F.col("x.d") - F.col("y.d")) > threshold) & ((F.col("x.d") <= beyond) | (F.col("y.d") <= threshold)) & ((F.col("y.d") <= beyond) | (F.col("x.d") <= threshold))
        rest = (x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.h") < F.col("y.h")) & (F.col("x.c") != F.col("y.c")) & ~apart & (F.col("x.h") != F.col("x.a")))
                .select(F.col("x.h").alias("a"), F.col("y.h").alias("b")).distinct())
    second = measured(rest, threshold, "second")
    links = found.select(F.col("id").alias("a"), F.col("component_id").alias("b")).unionByName(
        second.filter(F.col("d") <= threshold).select(F.col("da").alias("a"), F.col("db").alias("b")))
    return components(links, folder, "all", native=True)


def repeated_lines(docs: DataFrame, threshold: int = THRESHOLD, min_length: int = MIN_LENGTH) -> DataFrame:
    """doc_id, line_no, class_id (digest of the class), repeated: one row per line that is not blank; repeated lines have an earlier one."""
    folder = shared_dir(docs.sparkSession, "lines")
    occurrences = lines_of(docs).filter(F.trim("line") != "").withColumn("digest", F.unhex(F.md5("line")))
    found = line_links(occurrences, folder, threshold, min_length)
    places = occurrences.select("doc_id", "line_no", "digest")
    first = places.groupBy("digest").agg(F.min(F.struct("doc_id", "line_no")).alias("first"))
    classed = first.join(found.withColumnRenamed("id", "digest"), "digest", "left").select("digest", "first", F.coalesce("component_id", "digest").alias("class_id"))
    heads = classed.groupBy("class_id").agg(F.min("first").alias("head"))
    known = classed.select("digest", "class_id").join(heads, "class_id")
    return places.join(known, "digest").select("doc_id", "line_no", "class_id", (~F.struct("doc_id", "line_no").eqNullSafe(F.col("head"))).alias("repeated"))


def line_report(docs: DataFrame, threshold: int = THRESHOLD, min_length: int = MIN_LENGTH) -> DataFrame:
    """doc_id, n_lines (not blank), n_repeated, repeated (line numbers from 0, in order): one row per document id."""
    found = repeated_lines(docs, threshold, min_length).groupBy("doc_id").agg(
        F.count("*").alias("n_lines"), F.count_if("repeated").alias("n_repeated"),
        F.sort_array(F.collect_set(F.when(F.col("repeated"), F.col("line_no")))).alias("repeated"))  # at most a document's lines
    every = need(docs, "doc_id").distinct()
    return every.join(found.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left").select(
        "doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_repeated", F.lit(0)).alias("n_repeated"),
        F.coalesce("repeated", F.array().cast("array<int>")).alias("repeated"))


def drop_repeated_lines(docs: DataFrame, threshold: int = THRESHOLD, min_length: int = MIN_LENGTH) -> DataFrame:
    """The documents without their repeated lines, with all their columns."""
    gone = line_report(docs, threshold, min_length).filter("n_repeated > 0").select(F.col("doc_id").alias("_id"), F.col("repeated").alias("_repeated"))
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(F.col("_repeated"), i)), "\n")
    joined = docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"]), "left")
    return joined.withColumn("text", F.when(F.col("_repeated").isNull(), F.col("text")).otherwise(kept)).select(docs.columns)
