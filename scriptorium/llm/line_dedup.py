"""Line deduplication by a segment-partition edit join, in DataFrame and SQL functions only.

A line counts by its normal form: blanks at its ends cut, lower-cased. All lines but empty ones are compared over the
whole table; those under ``CHARS_PER_EDIT`` characters allow no edit among themselves and are linked if equal. Two lines are linked if their edit distance is at most
``EDITS`` and at most one for each ``CHARS_PER_EDIT`` characters of the longer. Of each class of linked or equal lines
the one in the row with the smallest id stays, the first of that row; the others are cut out of their texts.

The join is Pass-Join (Li et al., 2011): a line of length n is cut into ``EDITS + 1`` even segments; a line within
the distance holds one of them whole, at a place that the multi-match-aware bounds narrow to a few. Segments are
indexed by number and content, and the other lines probe these keys for the lengths they may meet; lengths that cut the
same part share its key, the join compares the lengths themselves. Pairs that meet (in crowds: and whose counts of common letters allow it) are verified by a banded bit-parallel edit distance (Hyyroe, 2003):
the band's 2 * EDITS + 1 cells of a column are bits of a number, a fold over the other line's characters moves it on;
equal ends of the pair are cut off first.

Lines travel as 64-bit digests (two different lines share one with a chance of one to 2^64 for each pair). Repeats are
folded before the join, by one aggregation with partial sums in every task: each different line is indexed and probes
once, however often it occurs.

Defined results: a null text stays null; empty texts and empty lines stay; rows that share an id each keep
their first line of a class if that id is its smallest; of rows without an id likewise, if no row with an id has the
line; equal rows give equal rows; extra columns stay; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.tables import components, written

EDITS = 2
CHARS_PER_EDIT = 20
MIN_CHARS = 1
#: The shorter of two different linked lines has at least so many characters.
NEAR_CHARS = CHARS_PER_EDIT - 1
#: Letters whose counts tell pairs apart before their texts are fetched; any sixteen do, common ones do best.
BAG_LETTERS = "etaoinsrhldcumpb"
#: Lines that share a segment before letters are counted: this decides the work, not the result.
CROWD = 8
#: Up to this many lines, a list of lines is sent to every task; a longer one is joined by a shuffle.
BROADCAST_LINES = 300_000


def normal(line: Column) -> Column:
    return F.lower(F.btrim(line, F.lit(" \t\r")))


def _norms(text: str) -> Column:
    return F.transform(F.split(F.col(text), "\n", -1), normal)


def _occurrences(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """row (digest of id and text), doc_id, line_no and line (digest of the normal form) of each line that is compared."""
    digests = F.transform(_norms(text), lambda n: F.when(F.length(n) >= MIN_CHARS, F.xxhash64(n)))
    rows = docs.select(F.xxhash64(id_col, text).alias("row"), F.col(id_col).alias("doc_id"), F.posexplode(digests).alias("line_no", "line"))
    return rows.where("line is not null")


def _different(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """One row for each different line: line, norm, n (its occurrences) and first_id (the smallest id that has it)."""
    norms = docs.select(F.col(id_col).alias("doc_id"), F.explode(_norms(text)).alias("norm")).where(F.length("norm") >= MIN_CHARS)
    return norms.groupBy(F.xxhash64("norm").alias("line"), "norm").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


def _bag(norm: Column) -> Column:
    """How often each of ``BAG_LETTERS`` occurs, modulo 16, four bits each."""
    size = F.length(norm)
    counts = [(size - F.length(F.replace(norm, F.lit(c), F.lit("")))).cast("long").bitwiseAND(F.lit(15)) for c in BAG_LETTERS]
    total = F.shiftleft(counts[0], 0)
    for i, count in enumerate(counts[1:], 1):
        total = total.bitwiseOR(F.shiftleft(count, 4 * i))
    return total


def _bags_differ(a: Column, b: Column) -> Column:
    """A lower bound of the difference of two bags: an edit changes it by two at most."""
    steps = [F.shiftright(a, 4 * i).bitwiseAND(F.lit(15)) - F.shiftright(b, 4 * i).bitwiseAND(F.lit(15)) for i in range(len(BAG_LETTERS))]
    each = [F.least(F.abs(d), 16 - F.abs(d)) for d in steps]
    return sum(each[1:], each[0])


def _start(length: str, number: int, parts: int) -> str:
    """SQL: where segment ``number`` of a line of ``length`` begins; the last ones are one longer where it does not divide."""
    return f"(int(({length}) div {parts}) * {number} + greatest(0, int(({length}) % {parts}) - {parts - number}))"


def _size(length: str, number: int, parts: int) -> str:
    return f"(int(({length}) div {parts}) + if(int(({length}) % {parts}) >= {parts - number}, 1, 0))"


def _segment(length: str, number: int, parts: int) -> Column:
    """Key of segment ``number`` of a line of ``length``, cut from the stretch ``_around`` keeps.

    The length is no part of the key: for one line, most lengths cut the same part and need one probe.
    """
    inside = f"substring(around_{number}, {_start(length, number, parts)} - from_{number} + 1, {_size(length, number, parts)})"
    return F.expr(f"xxhash64({inside}, {number})")


def _around(lines: DataFrame, edits: int) -> DataFrame:
    """``lines`` with size and, for each segment, the stretch of the line in which any of its places lie."""
    parts = edits + 1
    sized = lines.withColumn("size", F.length("norm"))
    for n in range(parts):
        sized = sized.withColumn(f"from_{n}", F.expr(f"greatest(0, {_start(f'size - {edits}', n, parts)} - {edits})"))
    for n in range(parts):
        end = f"{_start('size', n, parts)} + {_size('size', n, parts)} + {edits}"
        sized = sized.withColumn(f"around_{n}", F.expr(f"substring(norm, from_{n} + 1, {end} - from_{n})"))
    return sized


def _places(edits: int) -> list[tuple[int, int, int]]:
    """(missing characters, segment, shift) that probes look at: a line is met by lines as long or up to ``edits`` longer.

    Segments are longer than any shift, so the parts always lie inside the line and the stretches ``_around`` keeps.
    """
    out = []
    for missing in range(edits + 1):
        for number in range(edits + 1):
            low = max(-number, missing - (edits - number))
            high = min(number, missing + (edits - number))
            out += [(missing, number, shift) for shift in range(low, high + 1)]
    return out


def _looks(edits: int) -> list[list[tuple[int, int, int]]]:
    """For each remainder of a line's length by the number of segments, the different parts its places cut.

    A part (segment, start, size) of a line of ``k * parts + remainder`` characters begins at ``segment * k + start``
    and has ``k + size`` characters, whatever ``k`` is.
    """
    parts, k = edits + 1, 10 * (edits + 1)
    out = []
    for remainder in range(parts):
        found = []
        for missing, n, shift in _places(edits):
            each, over = divmod(k * parts + remainder - missing, parts)
            found.append((n, each * n + max(0, over - (parts - n)) + shift - n * k, each + (over >= parts - n) - k))
        out.append(list(dict.fromkeys(found)))
    return out


def _probes(sized: DataFrame, edits: int) -> DataFrame:
    """``sized`` with ``probe``, once for each key the line looks for: one small expression, applied to each look."""
    parts = edits + 1
    struct = "named_struct('n', {}, 'start', {}, 'size', {})"
    looks = [f"array({', '.join(struct.format(*look) for look in some)})" for some in _looks(edits)]
    chosen = "CASE size % {} {} END".format(parts, " ".join(f"WHEN {r} THEN {some}" for r, some in enumerate(looks)))
    pick = lambda name: "CASE look.n {} END".format(" ".join(f"WHEN {n} THEN {name}_{n}" for n in range(parts)))
    start = f"look.n * int(size div {parts}) + look.start - {pick('from')} + 1"
    probe = F.expr(f"xxhash64(substring({pick('around')}, {start}, int(size div {parts}) + look.size), look.n)")
    return sized.withColumn("look", F.explode(F.expr(chosen))).withColumn("probe", probe)


def _candidates(lines: DataFrame, edits: int) -> DataFrame:
    """Pairs (a, b) of digests of lines that share a segment; ``lines``: line and norm, each line once.

    Where more than ``CROWD`` lines share an indexed segment, as the versions of one page do, counts of common letters
    drop most pairs inside the join; lines without such company need no counts.
    """
    parts = edits + 1
    if NEAR_CHARS - edits < parts * parts:
        raise ValueError("lines must be long enough for segments that are longer than their shifts")
    sized = _around(lines, edits)
    index_keys = F.array(*[_segment("size", n, parts) for n in range(parts)])
    index = written(sized.select(F.col("line").alias("a"), F.col("size").alias("a_size"), F.explode(index_keys).alias("key")), "line-segments")
    crowds = index.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("key")
    crowded = written(index.join(crowds, "key", "left_semi").select(F.col("a").alias("crowded")).distinct(), "crowded-lines")
    some = _if_few(crowded)
    bags = lines.join(some, F.col("line") == F.col("crowded"), "left_semi").select("line", _bag(F.col("norm")).alias("bag"))
    bags = _if_few(written(bags, "crowded-bags"))
    known = lambda name: bags.select(F.col("line").alias(f"{name}_line"), F.col("bag").alias(f"{name}_bag"))
    asking = sized.join(known("b"), F.col("line") == F.col("b_line"), "left")
    probes = _probes(asking, edits).select(F.col("line").alias("b"), F.col("size").alias("b_size"), "b_bag", "probe")
    indexed = index.join(known("a"), F.col("a") == F.col("a_line"), "left").select("a", "a_size", "a_bag", "key")
    # A line meets those as long, once for each two, and those up to ``edits`` shorter.
    missing = F.col("b_size") - F.col("a_size")
    fits = ((missing == 0) & (F.col("a") < F.col("b"))) | ((missing > 0) & (missing <= edits))
    alike = F.coalesce(_bags_differ(F.col("a_bag"), F.col("b_bag")) <= 2 * edits, F.lit(True))
    met = probes.join(indexed, (F.col("probe") == F.col("key")) & fits & alike)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _if_few(table: DataFrame) -> DataFrame:
    """A written table of lines, marked for broadcast if it is counted to be small."""
    return F.broadcast(table) if table.count() <= BROADCAST_LINES else table


def _common(x: str, y: str) -> str:
    """SQL: the number of equal characters at the start of x and y, by halving."""
    powers = f"sequence(length(bin(least(length({x}), length({y})))) - 1, 0, -1)"
    longer = f"n + cast(power(2, p) as int) <= least(length({x}), length({y})) AND substring({x}, n + 1, cast(power(2, p) as int)) = substring({y}, n + 1, cast(power(2, p) as int))"
    return f"aggregate({powers}, 0, (n, p) -> if({longer}, n + cast(power(2, p) as int), n))"


def distances(pairs: DataFrame, edits: int) -> DataFrame:
    """``pairs`` (x, y and more) with ``distance``: the edit distance up to ``edits``, beyond it a larger number.

    The fold keeps, for the cells of the band in one column of the distance table, which are one more (vp) and one
    less (vn) than the cell before them, and the distance at the band's lowest cell: down the diagonal first,
    along the last row then. Both strings begin with ``edits`` equal marks, so that the band fits.
    """
    width = 2 * edits + 1
    mask = (1 << width) - 1
    cut = (
        pairs.withColumn("_long", F.expr("if(length(x) >= length(y), x, y)"))
        .withColumn("_short", F.expr("if(length(x) >= length(y), y, x)"))
        .withColumn("_head", F.expr(_common("_long", "_short")))
        .withColumn("_long", F.expr("substring(_long, _head + 1, length(_long))"))
        .withColumn("_short", F.expr("substring(_short, _head + 1, length(_short))"))
        .withColumn("_tail", F.expr(_common("reverse(_long)", "reverse(_short)")))
        .withColumn("_long", F.expr("substring(_long, 1, length(_long) - _tail)"))
        .withColumn("_short", F.expr("substring(_short, 1, length(_short) - _tail)"))
    )
    marks = f"array_repeat('', {edits})"
    characters = lambda c: f"concat({marks}, if({c} = '', array(), split({c}, '')))"
    listed = cut.withColumn("_a", F.expr(characters("_long"))).withColumn("_b", F.expr(characters("_short")))
    same = " + ".join(f"if(coalesce(get(_a, i - {1 + edits - k}) = get(_b, i - 1), false), {1 << k}L, 0L)" for k in range(width))
    fold = f"""
    aggregate(sequence(1, size(_b)), named_struct('vp', {(mask << edits) & mask}L, 'vn', 0L, 'd', {edits}, 'row', {1 << (width - 2)}L), (s, i) ->
      transform(array({same}), e ->
        transform(array(((((e & s.vp) + s.vp) ^ s.vp) | e | s.vn) & {mask}L), z ->
          transform(array((s.vn | ~(z | s.vp)) & {mask}L), h ->
            named_struct(
              'vp', ((z & s.vp) | ~(shiftright(z, 1) | h)) & {mask}L,
              'vn', shiftright(z, 1) & h,
              'd', s.d + if(i <= size(_a) - {edits}, if((z & {1 << (width - 1)}L) = 0L, 1, 0), if((h & s.row) != 0L, 1, 0) - if((z & s.vp & s.row) != 0L, 1, 0)),
              'row', if(i <= size(_a) - {edits}, s.row, shiftright(s.row, 1))
            ))[0])[0])[0], s -> s.d)"""
    return listed.withColumn(
        "distance", F.expr(f"if(length(_long) - length(_short) > {edits}, {edits + 1}, if(_short = '', length(_long), {fold}))")
    ).drop("_long", "_short", "_head", "_tail", "_a", "_b")


def links(different: DataFrame, edits: int = EDITS) -> DataFrame:
    """Links (a, b) of digests of near-equal lines; ``different``: line and norm, each line once."""
    met = written(_candidates(different, edits), "line-candidates")
    wanted = written(met.select(F.col("a").alias("wanted")).union(met.select("b")).distinct(), "wanted-lines")
    texts = different.join(_if_few(wanted), F.col("line") == F.col("wanted"), "left_semi")
    texts = written(texts.select("line", "norm"), "wanted-texts")
    x = texts.select(F.col("line").alias("a"), F.col("norm").alias("x"))
    y = texts.select(F.col("line").alias("b"), F.col("norm").alias("y"))
    near = F.col("distance") <= F.least(F.lit(edits), F.floor(F.greatest(F.length("x"), F.length("y")) / CHARS_PER_EDIT))
    # Written first: a filter on the distance would be pushed down and work it out once for each use of its parts.
    alike = _bags_differ(_bag(F.col("x")), _bag(F.col("y"))) <= 2 * edits
    pairs = met.join(x, "a").join(y, "b").withColumn("alike", alike)
    # The fold runs for pairs that the letters leave open.
    measured = distances(pairs.select("a", "b", F.when(F.col("alike"), F.col("x")).alias("x"), F.when(F.col("alike"), F.col("y")).alias("y")), edits)
    measured = measured.select("a", "b", F.coalesce(near, F.lit(False)).alias("near"))
    return written(measured, "line-distances").where("near").select("a", "b")


def classes(docs: DataFrame, text: str = "text", id_col: str = "doc_id", edits: int = EDITS) -> tuple[DataFrame, DataFrame]:
    """Occurrences (row, doc_id, line_no, line) of all lines compared, and (line, class, first_id) of those not alone in their class."""
    places = written(_occurrences(docs, text, id_col), "lines")
    different = written(_different(docs, text, id_col), "different-lines")
    near = components(links(different.where(F.length("norm") >= NEAR_CHARS).select("line", "norm"), edits))
    shared = different.join(near, F.col("line") == F.col("node"), "left").where("n > 1 or component is not null")
    named = written(shared.select("line", "first_id", F.coalesce("component", "line").alias("class")), "line-classes")
    first = named.groupBy("class").agg(F.min("first_id").alias("class_id"))
    return places, named.select("line", "class").join(first, "class")


def dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id", edits: int = EDITS) -> DataFrame:
    """``docs`` with the lines cut out that repeat an earlier one, and ``_n_lines`` and ``_n_removed``."""
    places, named = classes(docs, text, id_col, edits)
    found = places.join(named.withColumnRenamed("line", "named_line"), F.col("line") == F.col("named_line"))
    mine = Window.partitionBy("row", "class")
    foreign = found.where("not doc_id <=> class_id").select("row", "line_no")
    again = found.where("doc_id <=> class_id").withColumn("first_no", F.min("line_no").over(mine)).where("line_no > first_no").select("row", "line_no")
    cut = foreign.union(again).groupBy("row").agg(F.collect_set("line_no").alias("_cut")).withColumnRenamed("row", "_cut_row")
    whole = docs.withColumn("_row", F.xxhash64(id_col, text))
    n_lines = F.coalesce(F.size("_lines"), F.lit(0))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_cut"))
    shortened = F.when(F.col("_cut").isNull(), F.col(text)).otherwise(F.array_join(F.transform(kept, lambda i: F.get("_lines", i)), "\n"))
    # Hashed on the side of the cuts: the texts need no sorting. Split once for a text, not inside the lambda for each line.
    joined = whole.join(cut.hint("shuffle_hash"), F.col("_row") == F.col("_cut_row"), "left").withColumn("_lines", F.split(F.col(text), "\n", -1))
    return joined.select(
        *[shortened.alias(c) if c == text else F.col(c) for c in docs.columns],
        F.when(F.col(text).isNull(), 0).otherwise(n_lines).alias("_n_lines"),
        F.coalesce(F.size("_cut"), F.lit(0)).alias("_n_removed"),
    )


def summary(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_lines, n_removed, kept_chars and the SHA-256 of the shortened text of each row."""
    return dedup(docs.select(id_col, text), text, id_col).select(
        F.col(id_col).alias("doc_id"),
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_removed").alias("n_removed"),
        F.coalesce(F.length(text), F.lit(0)).alias("kept_chars"),
        F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("text_sha256"),
    )
