"""Line dedup with a segment-partition edit join, in DataFrame operations only.

A line goes if an earlier one (by document id, text hash, line number) equals
it, or is within ``max_edits`` edits of it.

The edit join partitions a line into ``max_edits + 1`` segments: two lines
within that many edits have one of the shorter one's segments in common, at
places that differ by no more than the edits can move them.  So a line is
indexed by (length, segment number, segment) and probes, for each length down
to ``max_edits`` less, the substrings at the possible places.  Keys are counted
first; only lines at a key that different lines have go on.  Pairs of those
must agree in letter counts and in which characters stand side by side, as far
as so few edits leave them alike, to come out of the join at all; they are
verified with a banded bit-parallel edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.joins import few
from panelcast.llm.qda import fresh
from panelcast.session import stored

MAX_EDITS = 2
MIN_CHARS = 40          # shorter lines are compared for equality only


def not_blank(line: Column) -> Column:
    """Whether a line has a character other than ASCII white space."""
    return F.trim(line, F.lit(" \t\r\x0b\x0c")) != ""


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, line_no, line, h1, h2``: every line of every text
    that has a character other than ASCII white space.  (h1, h2) is the
    line's 128-bit hash, the line's identity from here on."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"),
                       F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    return (rows.where(not_blank(F.col("line")))
            .withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(1), "line")))


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def signature(line: Column) -> Column:
    """Each letter's count modulo four, as two bits in Gray code: an edit
    changes at most two counts by one, so at most two bits of the signature."""
    total = F.octet_length(line)
    bits = F.lit(0).cast("long")
    for i, letter in enumerate(LETTERS):
        n = (total - F.octet_length(F.replace(line, F.lit(letter), F.lit("")))).bitwiseAND(F.lit(3))
        bits = bits.bitwiseOR(F.shiftleft(n.bitwiseXOR(F.shiftright(n, 1)).cast("long"), 2 * i))
    return bits


def neighbours(line: Column) -> Column:
    """128 bits (``lo, hi``), one for each hash of two characters in a row: set
    if an odd number of the line's places has it.  An edit takes away at most
    two such places and makes at most two, so it changes at most four bits."""
    chars = F.split(line, "")
    hashes = F.zip_with(chars, F.slice(chars, 2, 1 << 30), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(128)).cast("int"))
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def turn(bits: Column, h: Column, low: Column) -> Column:
        return bits.bitwiseXOR(F.when(low, F.call_function("shiftleft", one, h)).otherwise(none))

    return F.aggregate(hashes, F.struct(none.alias("lo"), none.alias("hi")), lambda s, h: F.struct(
        turn(s["lo"], h, h < 64).alias("lo"), turn(s["hi"], h, h >= 64).alias("hi")))


def index_spots(max_edits: int) -> list[tuple[int, int, int]]:
    """(characters less, segment, shift) of a line's own segments."""
    return [(0, segment, 0) for segment in range(max_edits + 1)]


def probe_spots(max_edits: int) -> list[tuple[int, int, int]]:
    """The same of the substrings that can be a segment of a line as long or
    up to ``max_edits`` shorter: before the first segment that two lines share
    come at most ``segment`` edits, after it at most ``max_edits - segment``."""
    return [(less, segment, shift) for less in range(max_edits + 1) for segment in range(max_edits + 1)
            for shift in range(max(-segment, less - (max_edits - segment)), min(segment, less + (max_edits - segment)) + 1)]


def spots(max_edits: int) -> list[tuple[int, int, int]]:
    """All places of a line that are looked up, its own segments first (a line
    looks those up too)."""
    own = index_spots(max_edits)
    return own + [spot for spot in probe_spots(max_edits) if spot not in own]


def _key(line: Column, spot: tuple[int, int, int], max_edits: int) -> Column:
    less, segment, shift = spot
    other, n = F.length(line) - less, max_edits + 1
    begin, end = (F.floor(other * k / n).cast("int") for k in (segment, segment + 1))
    return F.xxhash64(other, F.lit(segment), F.substr(line, begin + 1 + shift, end - begin))


def edit_distance(a: Column, b: Column, most: int) -> Column:
    """Edit distance of two arrays of characters whose lengths differ by at
    most ``most``; anything above ``most`` comes out as above ``most``.

    Bit-parallel over a band of ``2 * most + 1`` rows that moves down one row
    with each character of ``b``: ``vp`` and ``vn`` hold where the distance
    grows or falls down the column, ``d`` is followed along the band's last
    row and, once that reaches the end of ``a``, along the row of its end."""
    width = 2 * most + 1
    mask = F.lit((1 << width) - 1).cast("long")
    top = F.lit(1 << (width - 1)).cast("long")

    def both(x: Column, y: Column) -> Column:
        return x.bitwiseAND(y)

    def inverse(x: Column) -> Column:
        return x.bitwiseXOR(mask)

    def step(state: Column, char: Column) -> Column:
        j, vp, vn, d = state["j"], state["vp"], state["vn"], state["d"]
        same = F.lit(0).cast("long")
        for row in range(width):
            same = same + F.when(F.coalesce(F.get(a, j - most + row) == char, F.lit(False)), F.lit(1 << row).cast("long")).otherwise(F.lit(0).cast("long"))
        return F.transform(F.array(same), lambda eq: _column(state, eq, j, vp, vn, d))[0]

    def _column(state, eq, j, vp, vn, d):
        zero = both((both(eq, vp) + vp).bitwiseXOR(vp).bitwiseOR(eq).bitwiseOR(vn), mask)
        return F.transform(F.array(zero), lambda z: _next(eq, z, j, vp, vn, d))[0]

    def _next(eq, zero, j, vp, vn, d):
        hp = vn.bitwiseOR(inverse(zero.bitwiseOR(vp)))
        hn = both(zero, vp)
        # the row of a's end in this column of the band, if it has come that far
        end = F.size(a) - j - 1 + most
        bit = F.lit(1).cast("long")
        along = (F.when(both(F.call_function("shiftright", hp, end), bit) != 0, 1).otherwise(0)
                 - F.when(both(F.call_function("shiftright", hn, end), bit) != 0, 1).otherwise(0))
        down = F.when(both(zero, top) != 0, 0).otherwise(1)
        half = F.shiftright(zero, 1)
        return F.struct((j + 1).alias("j"), hn.bitwiseOR(inverse(half.bitwiseOR(hp))).alias("vp"), both(half, hp).alias("vn"),
                        (d + F.when(end >= width - 1, down).otherwise(along)).cast("int").alias("d"))

    # column 0, seen through the rows of column 1: the rows from 1 on grow by one each
    start = F.struct(F.lit(0).alias("j"), F.lit(((1 << width) - 1) & ~((1 << most) - 1)).cast("long").alias("vp"),
                     F.lit(0).cast("long").alias("vn"), F.least(F.lit(most), F.size(a)).alias("d"))
    # the band's values differ by at most its width, so beyond that none can come back
    return F.aggregate(b, start, lambda s, c: F.when(s["d"] > 3 * most, s).otherwise(step(s, c)), lambda s: s["d"])


def shared_keys(lines: DataFrame, max_edits: int = MAX_EDITS) -> DataFrame:
    """``key, id, own`` (stored): the rows of the index that lines (``line``; equal
    ones may come repeatedly) have at keys of different lines, a segment's own
    line among them.  ``own``: the key is of a segment of the line itself.

    Keys are counted first, so that lines without a neighbour, nearly all,
    take no part in a join."""
    at = spots(max_edits)
    keyed = stored(lines.select(F.xxhash64("line").alias("id"), F.array(*[_key(F.col("line"), spot, max_edits) for spot in at]).alias("keys")), "line-keys")
    rows = keyed.select("id", F.posexplode("keys").alias("spot", "key"))
    own = F.min("spot") < len(index_spots(max_edits))
    shared = stored(rows.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b"), own.alias("own"))
                    .where("a < b and own").select("key"), "line-shared-keys")
    return stored(rows.join(few(shared), "key", "left_semi").groupBy("key", "id").agg(own.alias("own")), "line-shared")


def near_pairs(rows: DataFrame, lines: DataFrame, max_edits: int = MAX_EDITS) -> DataFrame:
    """Candidates ``a, b`` (``id`` of lines; ``a`` the longer or an equally
    long one): those of ``rows`` (:func:`shared_keys`) that have a segment in
    common and whose ``lines`` (``id, sig, lo, hi``) so few edits can tell apart."""
    marked = rows.join(lines, "id")
    probe = marked.select("key", *[F.col(c).alias(f"{c}_a") for c in ("id", "sig", "lo", "hi")])
    index = marked.where("own").select("key", *[F.col(c).alias(f"{c}_b") for c in ("id", "sig", "lo", "hi")])

    def apart(c: str) -> Column:
        return F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b")))

    alike = (apart("sig") <= 2 * max_edits) & (apart("lo") + apart("hi") <= 4 * max_edits)
    met = (probe.key == index.key) & (F.col("id_a") != F.col("id_b")) & alike
    return probe.join(index, met).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def near_links(lines: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Pairs ``a1, a2, b1, b2`` (hashes) of different lines of at least
    ``min_chars`` characters within ``max_edits`` edits, each pair once."""
    if min_chars < (max_edits + 1) ** 2:
        raise ValueError("lines must be long enough for segments longer than the edits allowed")
    long_lines = lines.where(F.length("line") >= min_chars)
    rows = shared_keys(long_lines.select("line"), max_edits)
    asked = stored(rows.select(F.col("id").alias("asked")).distinct(), "line-candidate-ids")
    texts = stored(long_lines.join(few(asked), F.col("h1") == F.col("asked"), "left_semi")
                   .groupBy("line").agg(F.count("*").alias("n")).select("line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"),
                                                                        signature(F.col("line")).alias("sig"), neighbours(F.col("line")).alias("two")),
                   "line-texts")
    pairs = stored(near_pairs(rows, texts.select(F.col("h1").alias("id"), "sig", "two.lo", "two.hi"), max_edits), "line-candidates")
    one = texts.select(F.col("h1").alias("a"), F.col("h2").alias("a2"), F.col("line").alias("x"))
    two = texts.select(F.col("h1").alias("b"), F.col("h2").alias("b2"), F.col("line").alias("y"))
    # lines of equal length find each other both ways
    once = pairs.join(one, "a").join(two, "b").where((F.length("x") > F.length("y")) | (F.length("x") == F.length("y")) & (F.col("a") < F.col("b")))
    # one split of x for all steps
    apart = F.transform(F.array(F.split("x", "")), lambda a: edit_distance(a, F.split("y", ""), max_edits))[0]
    return once.where(apart <= max_edits).select(F.col("a").alias("a1"), "a2", F.col("b").alias("b1"), "b2")


def removals(docs: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document with a line to remove or a linked line: ``doc_id,
    text_hash, removed`` (line numbers, ascending), ``n_exact, n_near,
    n_links``."""
    lines = occurrences(docs, id_col, text_col)
    links = stored(near_links(lines, max_edits, min_chars), "line-links")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "line_no")
    at = stored(lines.select("h1", "h2", "doc_id", "text_hash", "line_no"), "line-places")
    first = at.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    first = stored(first, "lines")
    both = links.union(links.select(F.col("b1").alias("a1"), F.col("b2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2")))
    mine = first.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("first").alias("own"))
    other = first.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("first").alias("theirs"))
    near = (both.join(mine, ["a1", "a2"]).join(other, ["b1", "b2"]).groupBy("a1", "a2")
            .agg(F.count("*").alias("links"), F.max(F.col("theirs") < F.col("own")).alias("near")))
    seen = (first.join(near.select(F.col("a1").alias("h1"), F.col("a2").alias("h2"), "links", "near"), ["h1", "h2"], "left")
            .where((F.col("n") > 1) | F.col("links").isNotNull()))
    hit = at.join(seen, ["h1", "h2"])
    near_hit = F.coalesce("near", F.lit(False))
    exact_hit = place > F.col("first")
    return (hit.groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_set(F.when(exact_hit | near_hit, F.col("line_no")))).alias("removed"),
        F.count_distinct(F.when(exact_hit, F.col("line_no"))).alias("n_exact"),
        F.count_distinct(F.when(~exact_hit & near_hit, F.col("line_no"))).alias("n_near"),
        F.aggregate(F.collect_set(F.struct("line_no", F.coalesce("links", F.lit(0)).alias("links"))), F.lit(0).cast("long"),
                    lambda n, x: n + x["links"]).alias("n_links")))


def line_classes(docs: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_lines`` (lines that are not blank),
    ``n_exact`` and ``n_near`` (lines removed as equal or near to an earlier
    one), ``n_links`` (links of its lines to different lines), ``removed``
    (their numbers from 0, comma-separated).

    A null or blank text has no lines.  A null id comes after all others.
    Rows equal in id and text are one document to the order of lines: their
    lines are kept or removed alike.  Other columns are ignored."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.coalesce(F.size(F.filter(
        F.split(text, "\n", -1), not_blank)), F.lit(0)).alias("n_lines"))
    gone = removals(docs, max_edits, min_chars, id_col, text_col).select(
        F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"), "removed", "n_exact", "n_near", "n_links")
    zero = F.lit(0).cast("long")
    return rows.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("text_hash") == F.col("gone_hash")), "left").select(
        "doc_id", F.when(F.col("n_lines") < 0, 0).otherwise(F.col("n_lines")).cast("long").alias("n_lines"),
        F.coalesce("n_exact", zero).alias("n_exact"), F.coalesce("n_near", zero).alias("n_near"), F.coalesce("n_links", zero).alias("n_links"),
        F.coalesce(F.concat_ws(",", F.col("removed").cast("array<string>")), F.lit("")).alias("removed"))


def dedup_lines(docs: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the removed lines cut out of the texts; a document that
    had lines and keeps none goes.  Null and blank texts stay as they are."""
    names = [fresh(docs, n) for n in ("__id", "__hash", "__removed")]
    gone = stored(removals(docs, max_edits, min_chars, id_col, text_col).where(F.size("removed") > 0)
                  .select(*[F.col(c).alias(n) for c, n in zip(("doc_id", "text_hash", "removed"), names)]), "line-removals")
    text = F.col(text_col).cast("string")
    joined = docs.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col(names[0])) & (F.xxhash64(text) == F.col(names[1])), "left")
    blank = F.filter(F.split(text, "\n", -1), not_blank)
    kept = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(F.col(names[2]), i))
    rest = F.when(F.col(names[2]).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return (joined.where(F.col(names[2]).isNull() | (F.size(F.col(names[2])) < F.size(blank)))
            .select(*[rest.alias(c) if c == text_col else F.col(c) for c in docs.columns]))
