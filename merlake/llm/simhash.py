"""SimHash fingerprints and their search by permuted block tables, on DataFrame functions only.

The terms of a text are its pairs of neighbouring words, weighted by their length.  Each
term's 64-bit hash votes with its weight on every bit; a bit of the fingerprint is set where
the votes for it exceed those against.  Votes are counted two bits to a long, so a text
needs 32 sums, which one hash aggregation makes in generated code.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE_CLASS, bucket_of, join_hot, longs, materialise, parts

BITS = 64


def terms(text: Column) -> Column:
    """Structs (a, b) of a word and the one after it; the last word's b is null."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{WHITE_CLASS}+"), "")
    return F.arrays_zip(words.alias("a"), F.slice(words, F.lit(2), F.size(words)).alias("b"))


def _votes(term_a: Column, term_b: Column) -> list[Column]:
    hashed = F.xxhash64(term_a, F.coalesce(term_b, F.lit("")))
    weight = F.coalesce(F.length(term_a) + F.coalesce(F.length(term_b), F.lit(0)), F.lit(0)).cast("long")
    pair = (1 << 32) + 1
    return [F.sum(weight).alias("total")] + [F.sum(F.shiftright(hashed, j).bitwiseAND(F.lit(pair)) * weight).alias(f"v{j}") for j in range(32)]


def _fingerprint() -> Column:
    """The signed bits of the votes, as a long."""
    out = F.lit(0).cast("long")
    for j in range(32):
        low, high = F.col(f"v{j}").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(f"v{j}", 32)
        for bit, votes in ((j, low), (j + 32, high)):
            out = out.bitwiseOR(F.when(votes * 2 > F.col("total"), F.shiftleft(F.lit(1).cast("long"), bit)).otherwise(F.lit(0).cast("long")))
    return out


def as_hex(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def likeness(x: Column, y: Column) -> Column:
    """The share of equal bits, 0 to 1."""
    return 1 - F.bit_count(x.bitwiseXOR(y)) / F.lit(float(BITS))


def fingerprints(rows: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """``keys`` and fp (long) of the text of every row; the keys must name a row.

    A null text is empty, and an empty text has fingerprint 0.
    """
    # the terms are made before they are exploded, so that no text is copied to each of them
    made = rows.select(*keys, terms(F.col(text_col)).alias("__terms"))
    each = made.select(*keys, F.explode_outer("__terms").alias("__t")).select(*keys, F.col("__t.a").alias("__a"), F.col("__t.b").alias("__b"))
    return each.groupBy(*keys).agg(*_votes(F.col("__a"), F.col("__b"))).select(*keys, _fingerprint().alias("fp"))


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``compare_and_search``, without the search."""
    return _shown(_compared(docs, id_col, text_col))


def compare_and_search(docs: DataFrame, every: int = 100, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``compare_with_next``, and n_near: of rows whose id ``every`` divides, how many other rows have a
    fingerprint at most ``radius`` bits away, found by the permuted block tables; null for all other rows."""
    rows = materialise(_compared(docs, id_col, text_col), "fingerprints")
    asked = F.when(F.col("doc_id") % every == 0, F.col("fp"))
    prints = rows.groupBy("fp").agg(F.count("*").alias("k"))
    queries = materialise(rows.select(asked.alias("q")).where("q is not null").groupBy("q").agg(F.count("*").alias("n")), "queries")
    pairs = within_radius(queries.select(F.col("q").alias("fp")), prints, radius)
    near = pairs.join(prints.withColumnRenamed("fp", "p"), F.col("fp") == F.col("p")).groupBy("query_fp").agg((F.sum("k") - 1).alias("n_near"))
    found = queries.join(near, F.col("q") == F.col("query_fp")).select("q", "n", "n_near")
    joined = join_hot(rows.withColumn("q", asked), materialise(found, "near"), ["q"], ["doc_id"], "left")
    return _shown(joined, "n_near")


def _shown(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_hex(F.col("fp")).alias("fingerprint"),
        as_hex(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        *more,
    )


def _compared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Fingerprints of every text and of its edited form, and how alike they are.

    Rows are in the order of falling id; the next document of the last is the first.  The
    edited text has the last floor(n/2) code points replaced by the first as many (or all)
    of the next document's.  Columns: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint (shown as 16 hex digits), near_edited, near_next (share of equal bits).

    A null text is empty.  Null ids come last, and equal ids are ordered by text.  A table of
    one row has that row as its next.  Other columns are ignored; an empty table gives no rows.

    The order is cut into ranges of ids, each a window of its own; the first rows of a range
    are also sent to the range before it, so texts are shuffled once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = 4 * parts(spark)  # ranges are hashed to tasks, so several a task even out
    cuts = rows.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], 20 * n).alias("q")).first().q or []
    bounds = sorted(set(cuts))
    ranged = rows.withColumn("range", bucket_of(F.col("doc_id"), bounds))
    ranged = ranged.withColumn("range", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.col("range")))
    tops = {r.range: r.top for r in ranged.groupBy("range").agg(F.max("doc_id").alias("top")).collect()}  # a row a range
    order = sorted(tops, reverse=True)
    ahead = {b: order[k - 1] for k, b in enumerate(order)}  # the range whose last row comes before b's first
    slots = range(-1, len(bounds) + 1)
    at = F.col("range") + 2
    top = F.element_at(longs([tops.get(b) or 0 for b in slots]), at)
    target = F.element_at(longs([ahead.get(b, 0) for b in slots]), at).cast("int")
    first = F.col("doc_id").eqNullSafe(F.when(F.col("range") >= 0, top))
    place = lambda r, guest: F.struct(r.alias("r"), F.lit(guest).alias("guest"))
    places = F.when(first, F.array(place(F.col("range"), False), place(target, True))).otherwise(F.array(place(F.col("range"), False)))
    dealt = ranged.select("doc_id", "text", F.explode(places).alias("p")).select(F.col("p.r").alias("r"), F.col("p.guest").alias("guest"), "doc_id", "text")
    line = Window.partitionBy("r").orderBy("guest", F.col("doc_id").desc_nulls_last(), "text")
    lined = dealt.select("r", "guest", "doc_id", "text", F.row_number().over(line).alias("k"), F.lead("text").over(line).alias("next_text"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.left(F.col("text"), F.length("text") - half), F.left(F.coalesce(F.col("next_text"), F.lit("")), half))
    both = F.array(
        F.struct(F.lit(0).alias("form"), F.col("text").alias("t"), F.lit(None).cast("string").alias("sha")),
        F.struct(F.lit(1).alias("form"), edited.alias("t"), F.sha2(edited.cast("binary"), 256).alias("sha")),
    )
    forms = lined.select("r", "k", "guest", "doc_id", F.length("text").cast("long").alias("n_chars"), F.explode(both).alias("f")).select("r", "k", "guest", "doc_id", "n_chars", "f.form", "f.sha", "f.t")
    prints = fingerprints(forms, ["r", "k", "guest", "doc_id", "n_chars", "form", "sha"], "t")
    pick = lambda form, c: F.max(F.when(F.col("form") == form, F.col(c)))
    paired = prints.groupBy("r", "k", "guest", "doc_id", "n_chars").agg(pick(0, "fp").alias("fp"), pick(1, "fp").alias("edited_fp"), pick(1, "sha").alias("edited_sha256"))
    followed = paired.withColumn("next_fp", F.lead("fp").over(Window.partitionBy("r").orderBy("k")))
    return followed.where("not guest").select("doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp")


def block_masks(radius: int, blocks: int) -> list[int]:
    """The bits that each permuted table keys on: all but ``radius`` of the blocks.

    Fingerprints that differ in at most ``radius`` bits differ in at most as many blocks, so
    they agree on all the others, which are the key of some table.
    """
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("needs 0 <= radius < blocks <= 64")
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    masks = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(blocks)]
    return [sum(c) for c in combinations(masks, blocks - radius)]


def within_radius(queries: DataFrame, prints: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """(query_fp, fp, distance): all pairs of distinct fingerprints at most ``radius`` bits apart.

    ``queries`` and ``prints`` each have a column fp of longs; nulls match nothing, repeated
    fingerprints are looked up once.  Each table is an equality join on the bits of its key;
    a pair that several tables find is given by the first of them only.
    """
    masks = [m - (1 << 64) if m >> 63 else m for m in block_masks(radius, blocks)]
    keyed = lambda df, name: df.where("fp is not null").select(F.col("fp").alias(name)).distinct().select(name, F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col(name).bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)])).alias("e")).select(name, F.col("e.t").alias(f"t_{name}"), F.col("e.key").alias(f"key_{name}"))
    q, p = keyed(queries, "query_fp"), keyed(prints, "found")
    pairs = q.join(p, (F.col("t_query_fp") == F.col("t_found")) & (F.col("key_query_fp") == F.col("key_found")))
    apart = F.col("query_fp").bitwiseXOR(F.col("found"))
    earliest = F.lit(len(masks))
    for t in reversed(range(len(masks))):
        earliest = F.when(apart.bitwiseAND(F.lit(masks[t])) == 0, F.lit(t)).otherwise(earliest)
    return pairs.where((F.bit_count(apart) <= radius) & (F.col("t_found") == earliest)).select("query_fp", F.col("found").alias("fp"), F.bit_count(apart).alias("distance"))
