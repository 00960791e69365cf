"""Line dedup as an exact set-similarity join, in DataFrame functions only.

Lines are sets of lower-case words. Lines with the same set form a class, and one representative of each class
joins: its words are ordered by rarity, and the rarest few (the prefix) are what a similar line must share one
of. Length and position of a shared word rule out most candidates; the rest are verified on the words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HashFilter, drop_table, materialise, quoted, small_array

#: Buckets of word hashes whose occurrences are counted; a level of rarity is a quarter of a power of two.
BUCKET_BITS = 18
#: Words shared by more classes than this meet a pivot before they meet each other.
HOT = 512
CLASS = ["h1", "h2"]
#: Bits of a word by which the marks of candidates are four, not one.
PARTS = 2
#: White space but the line feed and the plain space, for a class of a regular expression.
WHITE_SPACE = r"\x09\x0B-\x0D\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def has_words(line: Column) -> Column:
    """Whether a line has any word: all else but lines of spaces alone takes part."""
    return F.trim(line) != ""


def _row() -> Column:
    """Rows that repeat id and text are one document; the hash stands for the text."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"),
                    F.xxhash64("text").alias("t1"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(_row().alias("row"), "text")


def _lines(keyed: DataFrame) -> DataFrame:
    return keyed.select("row", F.posexplode(F.split(F.lower("text"), "\n")).alias("line_no", "line"))


def _level(count: Column) -> Column:
    return F.least(F.lit(126), F.floor(4 * F.log2(count + 1))).cast("int") + 1


def _rarity_levels(docs: DataFrame) -> DataFrame:
    """One row: for each bucket of word hashes (their upper bits) what puts its level, 1 to 127 and rarest first, in the place of
    the upper eight bits by an exclusive or; from all words of all lines.

    An array of 2**BUCKET_BITS numbers, however large the input. The join is exact under any order
    of words; rarity only keeps candidates few.
    """
    word = docs.select(F.explode(F.split(F.replace(F.lower("text"), F.lit("\n"), F.lit(" ")), " ")).alias("word"))
    counts = word.groupBy(F.shiftrightunsigned(F.xxhash64("word"), 64 - BUCKET_BITS).alias("place")).agg(F.count("*").alias("n"))
    upper = F.shiftright("place", BUCKET_BITS - 8).bitwiseXOR(_level(F.col("n")).cast("long"))
    return small_array(counts.select("place", F.shiftleft(upper, 56).alias("value")), 1 << BUCKET_BITS)


def _sorted_keys(line: Column, level: Column) -> Column:
    """The distinct words of a line as integers that sort by rarity: level, then 56 bits of the hash."""
    hashes = F.array_remove(F.array_distinct(F.transform(F.split(line, " "), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))
    # few operations for each word, and none that could be null: arrays without nulls sort as plain numbers
    return F.sort_array(F.transform(hashes, lambda h: F.coalesce(
        F.get(level, F.shiftrightunsigned(h, 64 - BUCKET_BITS)).bitwiseXOR(h), F.lit(0).cast("long"))))


def _mark(keys: Column) -> Column:
    """A word flips one of 64 bits, chosen by six bits of its key or hash."""
    return F.aggregate(keys, F.lit(0).cast("long"), lambda m, k: m.bitwiseXOR(F.call_function(
        "shiftleft", F.lit(1).cast("long"), k.bitwiseAND(F.lit(63).cast("long")).cast("int"))))


def _marks(keys: Column) -> Column:
    """The marks of 2**PARTS parts of a set, by further bits of its words."""
    part = F.lit(((1 << PARTS) - 1) << 6).cast("long")
    return F.array(*[_mark(F.filter(keys, lambda k: k.bitwiseAND(part) == x)) for x in range(0, 64 << PARTS, 64)])


def _classes(docs: DataFrame, levels: DataFrame, num: int, den: int) -> DataFrame:
    """One row for each set of words: its hashes, size, first line, mark, and prefix.

    A set so small that even one word more or less makes it unlike (up to three words at 4/5) is like equal sets
    alone, which are its class: it has no prefix and meets no other.
    """
    lines = _lines(_keyed(docs)).where(has_words(F.col("line"))).select("row", "line_no", "line", levels.scalar().alias("level"))
    lines = lines.select(F.struct("row", "line_no").alias("first"), _sorted_keys(F.col("line"), F.col("level")).alias("keys"))
    lines = lines.select("first", "keys", F.size("keys").alias("size"))
    classes = lines.select(F.xxhash64("keys").alias("h1"), F.xxhash64(F.lit(7), "keys").alias("h2"), "first", "size", _mark(F.col("keys")).alias("mark"),
                           F.slice("keys", 1, F.when(F.col("size") * (den - num) < num, 0).otherwise(
                               F.col("size") - _least_shared(F.col("size"), num, den) + 1)).alias("prefix"))
    return classes.groupBy(CLASS).agg(F.min("first").alias("first"), *[F.first(c).alias(c) for c in ("size", "mark", "prefix")])


def _least_shared(size: Column, num: int, den: int) -> Column:
    """Words that a set of this size shares with any similar one, at least."""
    return F.ceil(size * num / den).cast("int")


def _entries(classes: DataFrame) -> DataFrame:
    """(key, h1, mark, x) for each word of each prefix; x is the set's size and the word's place."""
    each = classes.select("h1", "size", "mark", F.posexplode("prefix").alias("pos", "key"))
    return each.select("key", "h1", "mark", (F.shiftleft(F.col("size").cast("long"), 32) + F.col("pos")).alias("x"))


def _few_alone(differ: Column, words: Column, num: int, den: int) -> Column:
    """Whether sets of so many words in all may be similar if so many bits of their marks differ: each is a word that one has alone."""
    return differ * (num + den) <= words * (den - num)


def _could_match(num: int, den: int) -> Column:
    """Filters that no similar pair fails at its first shared word: by length, by place and by marks."""
    (na, rest_a), (nb, rest_b) = ((n := F.shiftright(x, 32), n - F.col(x).bitwiseAND(F.lit((1 << 32) - 1))) for x in ("a.x", "b.x"))
    length = F.least(na, nb) * den >= F.greatest(na, nb) * num
    place = F.least(rest_a, rest_b) * (num + den) >= (na + nb) * num
    return length & place & _few_alone(F.bit_count(F.col("a.mark").bitwiseXOR(F.col("b.mark"))), na + nb, num, den)


def _met(a: DataFrame, b: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of classes that share a word of their prefixes and could be similar."""
    met = (F.col("a.key") == F.col("b.key")) & (F.col("a.h1") != F.col("b.h1") if a is not b else F.col("a.h1") < F.col("b.h1")) & _could_match(num, den)
    return a.alias("a").join(b.alias("b"), met).select(F.least("a.h1", "b.h1").alias("a"), F.greatest("a.h1", "b.h1").alias("b")).distinct()


def _candidates(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(h1, c, line, marks): each class of the pairs, its first line read again and this one's marks; only documents that may hold one are split."""
    ends = materialise(pairs.select("a").union(pairs.select("b")).toDF("h1").distinct())
    found = classes.where(HashFilter(ends, F.col("h1")).passes(F.col("h1"))).join(ends, "h1", "left_semi")
    found = materialise(found.select("h1", "first", F.struct("first", F.struct(*CLASS).alias("of"), "size").alias("c")))
    keyed = _keyed(docs)
    keyed = keyed.where(HashFilter(found, F.xxhash64("first.row")).passes(F.xxhash64("row")))
    lines = _lines(keyed).select(F.struct("row", "line_no").alias("first"), "line")
    lines = lines.where(HashFilter(found, F.xxhash64("first")).passes(F.xxhash64("first")))
    # rows that repeat id and text give a line more than once
    lines = lines.join(found, "first").groupBy("h1", "c").agg(F.first("line").alias("line"))
    # a line as it stands takes a third of the room of its words in an array
    hashes = F.transform(F.array_distinct(F.array_remove(F.split("line", " "), "")), lambda w: F.xxhash64(w))
    out = materialise(lines.withColumn("marks", _marks(hashes)))
    drop_table(ends)
    drop_table(found)
    return out


def _oriented(found: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Of the pairs (a, b) of classes those that may be similar by their candidates' marks, as (early, late) by first lines, with these, hashes and sizes."""
    marked = found.select("h1", "c", "marks")
    differ = F.lit(0)
    for x in range(1 << PARTS):
        differ += F.bit_count(F.get("marks_a", F.lit(x)).bitwiseXOR(F.get("marks_b", F.lit(x))))
    alike = _few_alone(differ, F.col("of_a.size") + F.col("of_b.size"), num, den)
    both = pairs.join(marked.toDF("a", "of_a", "marks_a"), "a").join(marked.toDF("b_", "of_b", "marks_b"), (F.col("b") == F.col("b_")) & alike)
    return materialise(both.select(F.least("of_a", "of_b").alias("early"), F.greatest("of_a", "of_b").alias("late")))


def _verified(pairs: DataFrame, texts: DataFrame, num: int, den: int) -> DataFrame:
    """The later classes (late) of the pairs (early, late, words of both) that are similar by the words themselves."""
    both = pairs.join(texts.toDF("early", "a"), "early").join(texts.toDF("late", "b"), "late")
    shared = F.size(F.array_remove(F.array_intersect(F.split("a", " "), F.split("b", " ")), ""))
    return materialise(both.where(shared * (den + num) >= F.col("words") * num).select("late").distinct())


def _repeats(docs: DataFrame, classes: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """The classes (h1, h2) that are similar to an earlier one, of the candidate pairs (a, b).

    Each class is first compared with the earliest of its candidates, which settles most copies; only what is not
    like that one is compared with all others.
    """
    found = _candidates(docs, classes, pairs)
    oriented = _oriented(found, pairs, num, den)
    texts = found.select("c.of", "line")
    ends = [F.col("early.of").alias("early"), F.col("late.of").alias("late"), (F.col("early.size") + F.col("late.size")).alias("words")]
    earliest = materialise(oriented.groupBy("late").agg(F.min("early").alias("early")).select(*ends))
    gone = _verified(earliest, texts, num, den)
    rest = oriented.select(*ends).join(gone, "late", "left_anti")
    rest = materialise(rest.join(earliest.select("early", "late"), ["early", "late"], "left_anti"))
    if rest.limit(1).count():
        gone = gone.union(_verified(rest, texts, num, den))
    gone = materialise(gone.select("late.*").distinct())
    for done in (oriented, found, earliest, rest):
        drop_table(done)
    return gone


def _hot_keys(classes: DataFrame) -> DataFrame:
    """The words in more than HOT prefixes; those of buckets with fewer words in all need no count."""
    key = classes.select(F.explode("prefix").alias("key")).where(F.shiftrightunsigned("key", 56) >= _level(F.lit(HOT)))
    return materialise(key.groupBy("key").count().where(F.col("count") > HOT).select("key"))


def first_lines(docs: DataFrame, num: int = 4, den: int = 5) -> DataFrame:
    """(row, kept): for each document the numbers of its lines that stay, of those with any word.

    Words of up to HOT classes are met at once. Classes with a word of more are first measured against that word's earliest class;
    only what is not like it meets the others.
    """
    classes = materialise(_classes(docs, _rarity_levels(docs), num, den))
    entries, hot = _entries(classes), _hot_keys(classes)
    if hot.limit(1).count():
        warm = materialise(entries.join(hot, "key"))
        ruled = classes.select("first", F.struct("h1", "size", "mark").alias("c"), F.posexplode("prefix").alias("pos", "key"))
        ruler = F.struct("c.h1", "c.mark", (F.shiftleft(F.col("c.size").cast("long"), 32) + F.col("pos")).alias("x"))
        pivots = ruled.join(hot, "key").groupBy("key").agg(F.min_by(ruler, "first").alias("p"))
        pivots = materialise(pivots.select("key", "p.*"))
        cold = entries.join(hot, "key", "left_anti")
        pairs = materialise(_met(cold, cold, num, den).union(_met(pivots, warm, num, den)).distinct())
        gone = _repeats(docs, classes, pairs, num, den)
        left = warm.join(gone.select("h1"), "h1", "left_anti")
        again = materialise(_met(warm, left, num, den).join(pairs, ["a", "b"], "left_anti"))
        if again.limit(1).count():
            gone = gone.union(_repeats(docs, classes, again, num, den))
    else:
        gone = _repeats(docs, classes, materialise(_met(entries, entries, num, den)), num, den)
    stay = classes.select(*CLASS, "first").join(gone, CLASS, "left_anti")
    return stay.groupBy(F.col("first.row").alias("row")).agg(F.sort_array(F.collect_list("first.line_no")).alias("kept"))


def _decided(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """``docs`` as structs ``__doc``, with the array ``__lines`` of structs (line, stays)."""
    keyed = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("__doc"), _row().alias("__row"))
    joined = keyed.join(kept.select(F.col("row").alias("__key"), F.col("kept").alias("__kept")), F.col("__row").eqNullSafe(F.col("__key")), "left")
    stays = F.coalesce("__kept", F.array().cast("array<int>"))
    return joined.withColumn("__lines", F.transform(F.split("__doc.text", "\n"), lambda line, i: F.struct(
        line.alias("line"),
        (~has_words(line) | F.array_contains(stays, i)).alias("stays"))))


def dedup_lines(docs: DataFrame, num: int = 4, den: int = 5) -> DataFrame:
    """Documents without the lines that repeat an earlier one; all columns as they were, ``n_chars`` brought up to date.

    Two lines match if the Jaccard similarity of their sets of lower-case words is ``num/den`` or more; a line
    goes if any earlier line matches it. Order: by doc_id (nulls last), among equal ids by a hash of the text,
    then by line number. Words stand between plain spaces; lines of these alone always stay. A document whose lines all go
    is dropped. A null or empty text stays as it is; rows that repeat id and text count as one
    document and get the same result each; an empty table stays empty.
    """
    names = docs.columns
    out = _decided(docs, first_lines(docs, num, den))
    left = F.filter("__lines", lambda x: x["stays"])
    out = out.where(F.col("__lines").isNull() | (F.size(left) > 0))
    text = F.array_join(F.transform(left, lambda x: x["line"]), "\n")
    changed = {"text": text}
    if "n_chars" in names:
        changed["n_chars"] = F.when(F.exists("__lines", lambda x: ~x["stays"]), F.length(text).cast(docs.schema["n_chars"].dataType)) \
            .otherwise(F.col("__doc.n_chars"))
    return out.select(*[changed[c].alias(c) if c in changed else F.col(f"__doc.{quoted(c)}").alias(c) for c in names])


def removed_lines_of_any_length(docs: DataFrame, num: int = 4, den: int = 5) -> DataFrame:
    """removed_lines with words that stand between white space of any kind (Unicode's).

    White space but line feeds becomes a space first, so rows with one id whose texts differ only in its kind
    are one document.
    """
    return removed_lines(docs.withColumn("text", F.regexp_replace("text", f"[{WHITE_SPACE}]", " ")), num, den)


def removed_lines(docs: DataFrame, num: int = 4, den: int = 5) -> DataFrame:
    """One row for each document: doc_id, n_lines, n_removed and the removed lines' numbers (from 0); see dedup_lines.

    ``n_lines`` counts lines with any word, and only these are removed. A null text has no lines, an empty
    one none that count; texts and lines are taken whole, however long. Of equal or similar lines the first stays, in the
    order that dedup_lines states. Rows that repeat id and text get the same result each; null ids come last; an empty
    table has no rows; columns other than doc_id and text are not read, whatever they are named.
    """
    kept = first_lines(docs, num, den)
    flags = _keyed(docs).select("row", F.when(F.col("text").isNull(), F.array().cast("array<boolean>")).otherwise(F.transform(
        F.split("text", "\n"), lambda line: has_words(line))).alias("eligible"))
    joined = flags.join(kept.withColumnRenamed("row", "key"), F.col("row").eqNullSafe(F.col("key")), "left")
    stays = F.coalesce("kept", F.array().cast("array<int>"))
    eligible = F.filter(F.transform("eligible", lambda x, i: F.when(x, i)), lambda i: i.isNotNull())
    return joined.select(F.col("row.id").alias("doc_id"), F.size("eligible").cast("long").alias("n_lines"),
                         F.array_except(eligible, stays).alias("removed")) \
        .withColumn("n_removed", F.size("removed").cast("long")).select("doc_id", "n_lines", "n_removed", "removed")
