"""Document fingerprints: Merkle trees over sections, paragraphs and spans, in DataFrame functions only.

The leaves are spans of a few letters or words, cut after a piece whose hash says so. A paragraph is a line, and its
node the SHA-256 of its leaves' digests. A section ends at an empty line or at a paragraph whose digest says so (one
in eight), so an edit moves no later section border; its node is the digest of its paragraphs', and the root
that of the sections'. Equal roots mean equal texts; where roots differ, the sections, then the paragraphs, then the
leaves that differ locate the edit. Equal inner nodes have equal leaves, so walking two trees down finds exactly
the leaves that both have: their likeness is the Dice coefficient of the leaves, 1 for equal roots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECTION_ONE_IN, SPAN_ONE_IN = 8, 2
LONGEST = 16  # letters of a span
CUT, PIECE = "\x01", "\x03"
RANGE_BYTES, TASK_BYTES = 4 << 20, 64 << 20  # of a range of rows, and of a task, by Catalyst's estimate of the input


def spans(line: Column) -> Column:
    """The spans of a line, in order; together they are the line. A word gives a piece for every four letters and one
    for the rest with the space after it, and a span ends after one piece in ``SPAN_ONE_IN``, and after ``LONGEST`` letters."""
    pieces = F.split(F.regexp_replace(line, r"(\S{4}(?=\S)| )", f"$1{PIECE}"), PIECE, -1)
    marked = F.transform(pieces, lambda w: F.when(F.pmod(F.xxhash64(w), F.lit(SPAN_ONE_IN)) == 0, F.concat(w, F.lit(CUT))).otherwise(w))
    short = F.regexp_replace(F.array_join(marked, ""), f"([^{CUT}]{{{LONGEST}}})(?=[^{CUT}])", f"$1{CUT}")
    return F.filter(F.split(short, CUT, -1), lambda s: s != "")


def leaves(text: Column) -> Column:
    """Digests (128 bits of SHA-256, hex) of the spans of each line."""
    plain = F.when(text.rlike("[\x01-\x03]"), F.replace(F.replace(F.replace(text, F.lit("\x02"), F.lit("\x02b")), F.lit(CUT), F.lit("\x02a")), F.lit(PIECE), F.lit("\x02c"))).otherwise(text)
    return F.transform(F.split(plain, "\n", -1), lambda line: F.transform(spans(line), lambda s: F.substring(F.sha2(s, 256), 1, 32)))


def paragraphs(leaf_digests: Column) -> Column:
    """SHA-256 (hex) of each line's leaves, in order."""
    return F.transform(leaf_digests, lambda x: F.sha2(F.array_join(x, ""), 256))


def sections(digests: Column) -> Column:
    """SHA-256 of each section. ``digests``: of the paragraphs; their first byte decides on section ends."""
    empty = F.sha2(F.lit(""), 256)
    marked = F.transform(digests, lambda d: F.when((d == empty) | (F.conv(F.substring(d, 1, 2), 16, 10).cast("int") % SECTION_ONE_IN == 0), F.concat(d, F.lit(CUT))).otherwise(d))
    return F.transform(F.split(F.array_join(marked, ""), CUT, -1), lambda s: F.sha2(F.concat(F.lit("s"), s), 256))


def root(section_digests: Column) -> Column:
    return F.sha2(F.concat(F.lit("r"), F.array_join(section_digests, "")), 256)


def bottom(leaf_digests: Column) -> Column:
    """All leaves of the tree as even longs, copies kept."""
    return F.transform(F.flatten(leaf_digests), lambda d: F.shiftleft(F.xxhash64(d), 1))


def common_leaves(a: Column, b: Column) -> Column:
    """Size of the bag that two bottoms have in common: one pass over both, sorted, those of ``b`` marked by an odd
    number after their equals; each takes one leaf of ``a`` that is still there."""
    both = F.sort_array(F.concat(a, F.transform(b, lambda x: x + 1)))
    none = F.struct(F.lit(None).cast("long").alias("leaf"), F.lit(0).alias("there"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        leaf, odd = x.bitwiseAND(F.lit(-2)), x.bitwiseAND(F.lit(1)) == 1
        there = F.when(acc["leaf"].eqNullSafe(leaf), acc["there"]).otherwise(0)
        hit = odd & (there > 0)
        left = F.when(hit, there - 1).when(odd, there).otherwise(there + 1)
        return F.struct(leaf.alias("leaf"), left.alias("there"), F.when(hit, acc["n"] + 1).otherwise(acc["n"]).alias("n"))

    return F.aggregate(both, none, step, lambda acc: acc["n"])


def likeness(root_a: Column, bottom_a: Column, root_b: Column, bottom_b: Column) -> Column:
    """Dice coefficient of two trees' leaves as bags; of two trees without leaves 0, unless they are equal."""
    dice = F.try_divide(common_leaves(bottom_a, bottom_b) * 2.0, F.size(bottom_a) + F.size(bottom_b))
    return F.when(root_a == root_b, 1.0).otherwise(F.coalesce(dice, F.lit(0.0)))


def first_difference(a: Column, b: Column) -> Column:
    """Place (from 0) of the first digest in which two trees' levels differ; null if none does."""
    return F.array_min(F.filter(F.transform(F.arrays_zip(a.alias("x"), b.alias("y")), lambda z, i: F.when(z["x"].eqNullSafe(z["y"]), F.lit(None).cast("int")).otherwise(i)), lambda i: i.isNotNull()))


def tree(df: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """Adds the levels of the tree of column ``text``: leaves, paragraphs, sections, root, and its bottom."""
    df = df.withColumn(f"{prefix}leaves", leaves(F.col(text)))
    df = df.withColumn(f"{prefix}paragraphs", paragraphs(F.col(f"{prefix}leaves"))).withColumn(f"{prefix}bottom", bottom(F.col(f"{prefix}leaves")))
    df = df.withColumn(f"{prefix}sections", sections(F.col(f"{prefix}paragraphs")))
    return df.withColumn(f"{prefix}root", root(F.col(f"{prefix}sections")))


def merkle_trees(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, root, sections, paragraphs, leaves of every row; no shuffle. Null texts are empty."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return tree(rows, "text").select("doc_id", "root", "sections", "paragraphs", "leaves")


def _cell(key: Column, cuts: list[int]) -> Column:
    """Number of ``cuts`` (ascending) that are <= key: a balanced tree of comparisons."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(cuts[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(cuts))


def with_next(rows: DataFrame, key: str, columns: list[str], order: list[Column], prepare=lambda df: df) -> DataFrame:
    """Each row with ``next_<c>`` of the row that follows in descending ``key`` (after the last: the first).

    No task sees all rows: keys are dealt to many ranges (64 quantile cells cut evenly, as many as the input's
    estimated bytes ask for), each range also gets a copy of the first row of the range that follows, and
    ``lead`` runs within ranges. ``prepare`` adds columns after the only exchange. Collected: 64 quantiles;
    broadcast: one key per range, where these are no more than a million.
    """
    spark = rows.sparkSession
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    size = 0 if size >= 1 << 62 else size  # no estimate
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(usual, min(size // TASK_BYTES, 64 * usual))  # estimates of joins may be far too high
    ranges = max(64 * parts, min(size // RANGE_BYTES, 1024 * parts))
    found = rows.agg(F.percentile_approx(key, [i / 64 for i in range(65)], 10_000).alias("q"), F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    if found["q"] is None:
        return prepare(rows.limit(0)).select("*", *(F.col(c).alias(f"next_{c}") for c in columns))
    cuts = sorted({found["lo"], *found["q"], found["hi"] + 1 if found["hi"] < (1 << 63) - 1 else found["hi"]})
    per = max(1, -(-ranges // len(cuts)))
    cell = _cell(F.col(key), cuts[1:-1])
    low, high = (F.element_at(F.array(*map(F.lit, part)), cell + 1).cast("double") for part in (cuts[:-1] or cuts, cuts[1:] or cuts))
    share = F.when(high > low, F.floor((F.col(key).cast("double") - low) / (high - low) * per)).otherwise(0)
    bucket = (cell * per + F.greatest(F.lit(0), F.least(F.lit(per - 1), share))).cast("long")
    rows = rows.withColumn("bucket", bucket)
    heads = rows.groupBy("bucket").agg(F.max(key).alias("head"))
    below = Window.orderBy(F.desc("bucket"))  # over ranges, not rows
    guests = heads.select(F.col("head").alias("guest_key"), F.coalesce(F.lag("bucket").over(below), F.min("bucket").over(Window.partitionBy())).alias("host"))
    few = per * len(cuts)  # ranges there can be
    guests = F.broadcast(guests) if few <= 1 << 20 else guests
    visiting = rows.join(guests, F.col(key) == F.col("guest_key")).withColumn("bucket", F.col("host")).drop("guest_key", "host")
    dealt = rows.withColumn("guest", F.lit(False)).unionByName(visiting.withColumn("guest", F.lit(True))).repartition(parts, "bucket")
    within = Window.partitionBy("bucket").orderBy("guest", F.desc(key), *order)
    out = prepare(dealt)
    return out.select("*", *(F.lead(c).over(within).alias(f"next_{c}") for c in columns)).filter(~F.col("guest")).drop("guest", "bucket")


def fingerprint_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many of the next
    document in descending doc_id (the last takes those of the first). Null texts are empty; rows with equal
    doc_id follow each other by text; a null doc_id counts as the smallest; a lone row is its own next.
    Also returned: the root's paragraph and section counts and where the edited text first differs.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("ord", F.coalesce("doc_id", F.lit(-(1 << 63))))

    out = with_next(rows, "ord", ["text", "bottom", "root"], [F.col("text")], lambda df: tree(df, "text"))
    out = out.withColumn("n_chars", F.length("text").cast("long"))
    out = out.withColumn("edited", F.expr("concat(left(text, cast(n_chars - n_chars div 3 as int)), left(next_text, cast(n_chars div 3 as int)))"))
    out = tree(out, "edited", "edited_")
    mine = (F.col("root"), F.col("bottom"))
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.col("root").alias("fingerprint"),
        F.col("edited_root").alias("edited_fingerprint"),
        likeness(*mine, F.col("edited_root"), F.col("edited_bottom")).alias("near_edited"),
        likeness(*mine, F.col("next_root"), F.col("next_bottom")).alias("near_next"),
        F.size("paragraphs").alias("n_paragraphs"),
        F.size("sections").alias("n_sections"),
        first_difference(F.col("sections"), F.col("edited_sections")).alias("edited_section"),
        first_difference(F.col("paragraphs"), F.col("edited_paragraphs")).alias("edited_paragraph"),
    )
