"""Document fingerprints: order MinHash, sensitive to edit distance. DataFrame functions only.

A text's units are its words, long ones in pieces of `PIECE` characters, and each letter of scripts that are written without spaces. A k-mer is
`k` consecutive units, or all units of a text with fewer. k-mers that occur again are numbered, so that each item (k-mer, occurrence) is there once. Items are
dealt to `slots` by a hash; in each slot the `width` items with the least hashes are selected and put back in their text order, and the hash of the
tuple of their k-mers is the slot's value. A change of words, of their number or of their order thus changes the values near it.

Everything is sorted as arrays of 64-bit numbers inside a row: first (hash of the k-mer, place), where equal ones stand together and are numbered, then (slot and hash of the
item, place), where each slot begins with its selection. Hashes have 33 bits there, k-mers of one text that share them count as one. Places have 31 bits.

A slot without items is 0. The likeness of two fingerprints is the share of equal slots among those that one of them has; two without any are alike.

A null text is an empty one, whose fingerprint is all zeros. Equal texts have equal fingerprints, whatever their ids. A text's units are held in memory by the task that
has its row, some 20 bytes for each of its bytes. Empty tables give an empty result. `fingerprint` carries all columns along; its result takes the place of a column of its name in any case.

`next_edited` needs two columns and returns no others: rows of equal id and equal text are one document, of which every row gets the result; rows of one id and different texts
stand in the order of a hash of their texts; null ids come last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.shared import fresh, materialize, parts_for

#: Units of a k-mer, items of a slot, bits of a slot's number.
K, WIDTH, SLOT_BITS = 3, 2, 5
PIECE = 16
#: Most letters of scripts with spaces, in runs; what is beyond (scripts without spaces, symbols) stands alone.
UNIT = rf"[\x21-\x7E\x{{A1}}-\x{{DFF}}]{{1,{PIECE}}}+|[^\x20\x09-\x0D]"
_PLACE = (1 << 31) - 1
#: Ids that one task puts in order.
ORDERED = 200_000


def _first(xs: Column, size: Column, test) -> Column:
    """The first index for which test holds of the element there, by binary search; size if there is none. test is false up to some index and true from there."""

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["low"] + s["high"], 1)
        right = (s["low"] < s["high"]) & ~test(F.get(xs, middle))
        return F.struct(F.when(right, middle + 1).otherwise(s["low"]).alias("low"), F.when(right | (s["low"] >= s["high"]), s["high"]).otherwise(middle).alias("high"))

    bits = F.ceil(F.log2(size + F.lit(1.0))).cast("int")
    return F.aggregate(F.sequence(F.lit(0), bits), F.struct(F.lit(0).alias("low"), size.alias("high")), halve, lambda s: s["low"])


def fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint", k: int = K, width: int = WIDTH, slot_bits: int = SLOT_BITS) -> DataFrame:
    """df with out: array of 2**slot_bits integers."""
    df = df.select(*[c for c in df.columns if c.lower() != out.lower()])
    units, kmers, sorted_kmers, items, selected = (fresh(df, c) for c in ("units", "kmers", "sorted", "items", "selected"))
    carried = df.columns
    packed = lambda h, place: h.bitwiseAND(F.lit(~_PLACE)).bitwiseOR(place.cast("long"))
    upper = lambda x: F.shiftright(x, 31)

    df = df.select(*carried, F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(UNIT), F.lit(0)), lambda u: F.xxhash64(u)).alias(units))
    starts = F.slice(F.col(units), F.lit(1), F.greatest(F.size(units) - (k - 1), F.least(F.size(units), F.lit(1))))
    df = df.select(*carried, F.transform(starts, lambda u, i: F.xxhash64(u, *[F.get(units, i + j) for j in range(1, k)])).alias(kmers))
    df = df.select(*carried, kmers, F.sort_array(F.transform(kmers, lambda h, i: packed(h, i))).alias(sorted_kmers))

    def item(x: Column, i: Column) -> Column:
        again = (i > 0) & (upper(F.get(sorted_kmers, i - 1)) == upper(x))
        occurrence = F.when(again, i - _first(F.col(sorted_kmers), i, lambda y: upper(y) == upper(x))).otherwise(F.lit(0))
        return packed(F.xxhash64(upper(x), occurrence), x.bitwiseAND(F.lit(_PLACE)))

    number = lambda x: F.shiftright(x, 64 - slot_bits)
    df = df.select(*carried, kmers, F.sort_array(F.transform(sorted_kmers, item)).alias(items))
    df = df.select(*carried, kmers, F.filter(items, lambda x, i: (i < width) | (number(x) != number(F.get(items, i - width)))).alias(selected))
    begins = F.filter(F.sequence(F.lit(0), F.size(selected) - 1), lambda i: (i == 0) | (number(F.get(selected, i)) != number(F.get(selected, i - 1))))

    def value(a: Column) -> Column:
        own = F.filter(F.slice(selected, a + 1, F.lit(width)), lambda x: number(x) == number(F.get(selected, a)))
        places = F.sort_array(F.transform(own, lambda x: x.bitwiseAND(F.lit(_PLACE))))
        hashed = F.shiftright(F.xxhash64(F.transform(places, lambda p: F.get(kmers, p.cast("int")))), 32).cast("int")
        return F.struct(number(F.get(selected, a)).cast("int").alias("slot"), F.when(hashed == 0, 1).otherwise(hashed).alias("value"))

    values = F.map_from_entries(F.transform(F.when(F.size(selected) > 0, begins).otherwise(F.array().cast("array<int>")), value))
    half = 1 << slot_bits - 1
    slots = F.sequence(F.lit(-half), F.lit(half - 1))
    # A lambda's variable is evaluated once; a column would be put into the inner lambda and evaluated for each slot.
    every = F.transform(F.array(values), lambda m: F.transform(slots, lambda s: F.coalesce(F.element_at(m, s), F.lit(0))))
    return df.select(*carried, F.element_at(every, 1).alias(out))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal slots of two fingerprints among those that one of them has, 0 to 1."""
    used = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x != 0) | (y != 0)), lambda x: x))
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x == y) & (x != 0)), lambda x: x))
    return F.when(used == 0, 1.0).otherwise(same.cast("double") / used)


def as_text(a: Column) -> Column:
    """A fingerprint as lower-case hexadecimal digits, eight for a slot."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit((1 << 32) - 1)))), 8, "0")), "")


def in_cycle(keys: DataFrame) -> DataFrame:
    """keys (id, g, h, ...), all different in (g, h), with next_g and next_h: those of the row behind each in descending order of id, of the first one behind the last.

    Ranges of ids are put in order each by itself; a row per range tells where the next one begins.
    """
    parts = parts_for(keys.count(), ORDERED, 1)
    order = [F.desc_nulls_last("id"), F.asc("h")]
    ranges = materialize(keys.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()), "order")
    inside = Window.partitionBy("range").orderBy(*order)
    key = F.struct("g", "h")
    ranked = ranges.withColumns({"next": F.lead(key).over(inside), "place": F.row_number().over(inside)})
    by_range = Window.orderBy("range")  # a row per range
    everything = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = ranked.filter("place = 1").select("range", F.coalesce(F.lead(key).over(by_range), F.first(key).over(everything)).alias("following"))
    joined = ranked.join(firsts, "range").withColumn("next", F.coalesce("next", "following"))
    return joined.select(*keys.columns, F.col("next.g").alias("next_g"), F.col("next.h").alias("next_h"))


def next_edited(documents: DataFrame, key: str = "doc_id", share: int = 3) -> DataFrame:
    """Per row: key, n_chars, edited_sha256, fingerprint, edited_fingerprint (arrays), near_edited and near_next.

    The edited text is the text with the last floor(n_chars / share) code points replaced by the first as many (or all) of the next document.
    Whole texts are shuffled once, by a hash of the id and one of the text, and beside them the pieces that move on; the next documents' fingerprints are joined without texts.
    """
    on = ["g", "h"]
    text = F.coalesce(F.col("text"), F.lit(""))
    hashed = documents.select(F.col(key).alias("id"), text.alias("text")).withColumns({"g": F.xxhash64("id", F.isnull("id")), "h": F.xxhash64("text")})
    keys = hashed.groupBy(*on).agg(F.first("id").alias("id"), F.max(F.length("text")).alias("n"), F.count("*").alias("rows"))
    cycle = materialize(in_cycle(keys), "cycle")
    texts = hashed.groupBy(*on).agg(F.first("text").alias("text"))
    asked = cycle.select(F.col("next_g").alias("g"), F.col("next_h").alias("h"), F.col("g").alias("by_g"), F.col("h").alias("by_h"), F.floor(F.col("n") / share).cast("int").alias("cut"))
    moved = texts.join(asked, on).select(F.col("by_g").alias("g"), F.col("by_h").alias("h"), "cut", F.expr("left(text, cut)").alias("piece"))
    both = texts.join(moved, on).select(*on, "text", F.concat(F.expr("left(text, length(text) - cut)"), "piece").alias("edited"))
    both = both.withColumn("sha", F.sha2(F.encode("edited", "utf-8"), 256))
    prints = materialize(fingerprint(fingerprint(both, "text", "own"), "edited", "changed").select(*on, "sha", "own", "changed"), "fingerprints")
    then = prints.select(F.col("g").alias("next_g"), F.col("h").alias("next_h"), F.col("own").alias("then"))
    done = prints.join(cycle, on).join(then, ["next_g", "next_h"])
    results = {
        "n_chars": F.col("n").cast("long"), "edited_sha256": F.col("sha"), "fingerprint": F.col("own"), "edited_fingerprint": F.col("changed"),
        "near_edited": likeness(F.col("own"), F.col("changed")), "near_next": likeness(F.col("own"), F.col("then")),
    }
    done = done.select(*on, "rows", "id", *[c.alias(n) for n, c in results.items()])
    repeated = cycle.filter("rows > 1").select(*on)
    again = hashed.select(*on).join(repeated, on, "left_semi").join(done.filter("rows > 1"), on)
    return done.filter("rows = 1").unionByName(again).select(F.col("id").alias(key), *results)


def op13_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, its edited text's, and their likeness."""
    found = next_edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumns({c: as_text(F.col(c)) for c in ("fingerprint", "edited_fingerprint")})
