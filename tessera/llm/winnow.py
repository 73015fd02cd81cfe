"""Document fingerprints by winnowing, in Spark expressions only.

A text as UTF-32 has four bytes a code point, so its k-grams are fixed slices of bytes, each hashed at its place. Hash
and place pack into one long (hash above, then the place counted down), so the least long of a window is its least
hash, rightmost on ties. (A hash that rolls from place to place has no cheap form here: see the README.) A fold walks from one window minimum to the next, some two steps a window, however long the text.
Any run of GRAM + WINDOW - 1 characters that two texts share leaves a common hash in both fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import table

GRAM, WINDOW = 16, 64
#: Bits of a packed long: place (texts of up to 268 million characters) and hash.
PLACE_BITS, HASH_BITS = 28, 35
#: Windows worked through at once; bounds the arrays of a long text.
STRETCH = 8192
#: Documents of a bucket in which neighbours by id meet, and buckets at most.
BUCKET, MAX_BUCKETS = 1000, 20_000

_PLACES = (1 << PLACE_BITS) - 1


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _minima(text: Column, first: Column | int, whole: Column) -> Column:
    """Packed window minima of text in order of place, which counts from `first`. whole: a text too short for a window
    has one all the same; else it has none."""
    empty = F.array().cast("array<bigint>")

    def stretch(wide: Column, grams: Column, start: Column) -> Column:
        size = F.least(grams - start, F.lit(STRETCH + WINDOW - 1))

        def packed(i: Column) -> Column:
            h = F.xxhash64(F.substr(wide, (start + i) * 4 + 1, F.lit(4 * GRAM)))
            return F.shiftleft(h.bitwiseAND(F.lit((1 << HASH_BITS) - 1)), PLACE_BITS) + (F.lit(_PLACES) - (start + i) - first)

        def walk(p: Column) -> Column:
            """Window minima, from one to the next: what is below the last one and enters while that is in the window, or
            the least of the window after it. Two steps get on by a window at least."""
            place = lambda v: (place_of(v) - start - first).cast("int")
            head = F.array_min(F.slice(p, 1, WINDOW))
            begin = F.struct(place(head).alias("at"), head.alias("last"), F.array(head).alias("found"))

            def step(s: Column, _: Column) -> Column:
                last, at = s["last"], s["at"]

                def next_(low: Column) -> Column:  # the least of what enters while the last minimum stays
                    below = F.filter(F.slice(p, at + 2, place(low) - at), lambda x: x < last)
                    falling = F.aggregate(below, s["found"], lambda got, x: F.when(x < F.element_at(got, -1), F.concat(got, F.array(x))).otherwise(got))
                    after = F.least(low, F.get(p, at + WINDOW))
                    return F.when(low < last, F.struct(place(low).alias("at"), low.alias("last"), falling.alias("found"))).when(at + WINDOW < size, F.struct(place(after).alias("at"), after.alias("last"), F.concat(s["found"], F.array(after)).alias("found"))).otherwise(s)

                return _let(F.array_min(F.slice(p, at + 2, WINDOW - 1)), next_)

            return F.aggregate(F.sequence(F.lit(0), F.floor(size / WINDOW).cast("int") * 2 + 2), begin, step)["found"]

        return _let(F.transform(F.sequence(F.lit(0), size - 1), packed), walk)

    def of(wide: Column) -> Column:
        n = F.length(wide) / 4
        grams = F.greatest(n - (GRAM - 1), F.lit(1)).cast("int")
        windows = F.when(grams >= WINDOW, grams - (WINDOW - 1)).when(whole & (n > 0), F.lit(1)).otherwise(F.lit(0))
        starts = F.sequence(F.lit(0), F.lit(STRETCH) * F.floor((windows - 1) / STRETCH).cast("int"), F.lit(STRETCH))
        return F.when(windows == 0, empty).otherwise(F.array_distinct(F.flatten(F.transform(starts, lambda s: stretch(wide, grams, s)))))

    return _let(F.encode(text, "UTF-32"), of)


def fingerprint(text: Column) -> Column:
    """Packed hashes and places of the text's fingerprint, in order of place. Empty for an empty text; a text shorter than a gram has one hash.
    A text whose places don't fit in PLACE_BITS is an error."""
    fits = F.when(F.length(text) <= _PLACES, text).otherwise(F.raise_error(F.lit(f"a text has over {_PLACES} characters")).cast("string"))
    return _minima(fits, 0, F.lit(True))


def hash_of(packed: Column) -> Column:
    return F.shiftright(packed, PLACE_BITS)


def place_of(packed: Column) -> Column:
    return F.lit(_PLACES) - packed.bitwiseAND(F.lit(_PLACES))


def edited_fingerprint(prints: Column, text: Column, keep: Column, tail: Column) -> Column:
    """fingerprint(first `keep` characters of text + tail), from text's own fingerprint `prints`.

    A fingerprinted place is the minimum of consecutive windows; those within the kept part have the same minima as
    before. Only windows that reach behind it are worked out.
    """
    grams = keep - (GRAM - 1)
    first = F.greatest(grams - (WINDOW - 1), F.lit(0))

    def begins(x: Column, i: Column) -> Column:  # the first window whose minimum x is
        before = F.get(prints, i - 1)
        return F.when(i == 0, F.lit(0).cast("long")).when(x < before, place_of(x) - (WINDOW - 1)).otherwise(place_of(before) + 1)

    kept = F.filter(prints, lambda x, i: begins(x, i) <= grams - WINDOW)
    rest = F.concat(F.substr(text, first + 1, keep - first), tail)
    return F.array_distinct(F.concat(F.when(grams >= WINDOW, kept).otherwise(F.array().cast("array<bigint>")), _minima(rest, first, first == 0)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the hashes of two fingerprints; two empty ones are alike."""

    def of(x: Column, y: Column) -> Column:
        union = F.size(F.array_union(x, y))
        return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / union)

    return _let(F.transform(a, hash_of), lambda x: _let(F.transform(b, hash_of), lambda y: of(x, y)))


def show(prints: Column) -> Column:
    """place:hash, parted by spaces."""
    return F.array_join(F.transform(prints, lambda v: F.concat(place_of(v).cast("string"), F.lit(":"), F.lower(F.hex(hash_of(v))))), " ")


def with_next(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with next_<c> for c in columns: the values of the row with the next key, of the first row for the last.

    Rows are dealt by key into buckets of about BUCKET rows, bounded by quantiles of the keys; the first row of
    each bucket visits the bucket before, so no window spans more than a bucket. Null keys come first; ties are
    ordered by the columns.
    """
    own = F.coalesce(F.col(key), F.lit(-(2**63)))
    n, low = rows.agg(F.count("*"), F.min(own)).first()
    buckets = max(1, min(MAX_BUCKETS, n // BUCKET))
    bounds: list[int] = []
    if buckets > 1:
        quantiles = [i / buckets for i in range(1, buckets)]
        bounds = sorted(set(rows.agg(F.percentile_approx(own, quantiles, 20 * buckets)).first()[0]) - {low})
    lits = F.lit(bounds).cast("array<bigint>") if bounds else F.array().cast("array<bigint>")

    def halve(s: Column, _: Column) -> Column:  # bounds before lo are <= key, from hi on above it
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        up = (s["lo"] < s["hi"]) & (F.get(lits, mid) <= F.col("key_"))
        return F.struct(F.when(up, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(up | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    bucket = F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1)), start, halve)["lo"]
    placed = rows.withColumn("key_", own).withColumn("bucket_", bucket)
    visits = F.when(F.col("key_") == low, F.lit(len(bounds))).when(F.get(lits, F.col("bucket_") - 1) == F.col("key_"), F.col("bucket_") - 1)
    seats = F.filter(F.array(F.struct(F.col("bucket_").alias("at"), F.lit(False).alias("guest")), F.struct(visits.alias("at"), F.lit(True).alias("guest"))), lambda s: s["at"].isNotNull())
    seated = placed.withColumn("seat_", F.explode(seats)).select(*rows.columns, "key_", F.col("seat_.at").alias("at_"), F.col("seat_.guest").alias("guest_"))
    w = Window.partitionBy("at_").orderBy("guest_", "key_", *columns)
    return seated.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns]).filter(~F.col("guest_")).drop("key_", "at_", "guest_")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs.

    Null texts are empty. Equal texts have equal fingerprints. Of rows that repeat an id the next one in order of text
    follows; an only row follows itself. Long texts are fingerprinted whole; one of over 2 ** 28 characters is an error. An empty table gives no rows.
    Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = with_next(docs.select("doc_id", text.alias("text")).withColumn("prints", fingerprint(F.col("text"))), "doc_id", ["text", "prints"])
    # Lengths are columns of their own: inside a lambda an expression is worked out for every element.
    rows = rows.withColumn("n", F.length("text")).withColumn("part", F.floor(F.col("n") / 4).cast("int")).withColumn("keep", F.col("n") - F.col("part"))
    rows = rows.withColumn("tail", F.substr("next_text", F.lit(1), F.col("part")))
    keep, tail = F.col("keep"), F.col("tail")
    edited = rows.select("doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2(F.concat(F.substr("text", F.lit(1), keep), tail), 256).alias("edited_sha256"), "prints", "next_prints", edited_fingerprint(F.col("prints"), F.col("text"), keep, tail).alias("edited"))
    return edited.select("doc_id", "n_chars", "edited_sha256", show(F.col("prints")).alias("fingerprint"), show(F.col("edited")).alias("edited_fingerprint"), likeness(F.col("prints"), F.col("edited")).alias("near_edited"), likeness(F.col("prints"), F.col("next_prints")).alias("near_next"))


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
