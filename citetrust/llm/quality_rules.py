"""Line-first cleaning rules, as column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citetrust.llm.work import stored

SPACES = "[\\x20\\x09-\\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8  # words
MIN_WORDS = 20
MAX_REPEATED = 30  # percent of words in repeated windows
MAX_LOST = 50  # percent of words in lines that fail
NAVIGATION_CHARS = 40  # of a navigation line, at most
BOILERPLATE_CHARS = 200  # a boilerplate line, or one that lacks its end, is shorter
# What a line of prose ends with, before closing quotes and brackets.
SENTENCE_END = "[.!?\u2026\u3002\uff01\uff1f][\"')\\]}\u00bb\u201d\u2019]*[\\x20\\x09-\\x0D]*\\z"
MIN_PLACES = 20  # different neighbours of a line that a table repeats
DOCUMENTS_A_PLACE = 1000  # and one of these for each so many documents

# Fixed words of navigation and boilerplate lines.
NAVIGATION = ("home", "menu", "search", "login", "log in", "sign in", "sign up", "register", "next", "previous",
              "back to top", "read more", "skip to content", "share", "print", "contact", "about", "sitemap")
BOILERPLATE = ("javascript is disabled", "enable javascript", "lorem ipsum", "all rights reserved", "cookie policy",
               "privacy policy", "terms of use", "terms of service", "powered by")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def count_of(text: Column, characters: str) -> Column:
    """How many characters of ``text`` are among ``characters``."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of 8 words found twice or more; sorted window hashes tell which, none is a pair."""
    n = F.size(words) - (WINDOW - 1)

    def covered(h: Column) -> Column:
        order = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = F.zip_with(
            order, F.slice(order, 2, F.size(order)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))
        )
        places = F.array_sort(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))
        # A window adds 8 words, or as many as it lies behind the window before it.
        steps = F.zip_with(places, F.slice(places, 2, F.size(places)), lambda a, b: F.when(b > a, F.least(b - a, F.lit(WINDOW))))
        return F.aggregate(F.filter(steps, lambda x: x.isNotNull()), F.lit(WINDOW), lambda s, x: s + x)

    # Each step is bound once, as the variable of a one-element transform; a word is hashed once, not in each window.
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    windows = F.transform(
        F.array(hashed),
        lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW))),
    )
    found = F.transform(
        windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0))
    )
    return F.when(n >= 2, F.get(found, F.lit(0))).otherwise(F.lit(0))


def line_fails(line: Column) -> Column:
    """Whether a line with words is noise: no end, symbols after words, cells, shouting, navigation or boilerplate.

    A short line fails if it doesn't end as a sentence does; a long one may lack its last stop.
    Inside a lambda each mention of a step is worked out anew, so cheap conditions that few lines meet come first.
    """
    cells, shouts = count_of(line, "|"), count_of(line, "!")
    low = F.lower(F.trim(line))
    short = F.length(line) < BOILERPLATE_CHARS
    return (
        (short & ~line.rlike(SENTENCE_END))
        | (
            line.rlike(f"[{SYMBOLS}]")
            & (
                (count_of(line, SYMBOLS) * 10 >= F.length(F.translate(line, SPACE_CHARS, "")))
                | ((cells >= 3) & (cells * 4 >= F.size(words_of(line))))
            )
        )
        | (F.contains(line, F.lit("!")) & (shouts >= 4) & (shouts * 2 >= F.size(words_of(line))))
        | ((F.length(line) <= NAVIGATION_CHARS) & low.isin(*NAVIGATION))
        | (short & F.greatest(*[F.contains(low, F.lit(b)) for b in BOILERPLATE]))
    )


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def short_lines(split: DataFrame) -> DataFrame:
    """Short lines that don't fail by themselves: (line: digest, place: hash of both neighbours, key, pos, n words)."""

    def described(line: Column, i: Column) -> Column:
        before, after = (F.coalesce(F.get("lines", i + step), F.lit("\n")) for step in (-1, 1))
        return F.struct(line.alias("text"), F.xxhash64(before, after).alias("place"), i.alias("pos"))

    def judged(x: Column) -> Column:
        return (F.length(x["text"]) < BOILERPLATE_CHARS) & ~line_fails(x["text"])

    return split.select("key", F.inline(F.filter(F.transform("lines", described), judged))).select(
        digest(F.col("text")).alias("line"), "place", "key", "pos", F.size(words_of(F.col("text"))).alias("n")
    )


def common_lines(lines: DataFrame, documents: int) -> DataFrame:
    """Lines that a table of so many documents repeats in place after place: (line).

    A line is boilerplate if it has at least 20 different pairs of neighbours and one for each 1,000 documents, and
    mostly new ones: a text that is copied takes its neighbours along, so lines of copies and near copies, and
    inner lines of passages, are not. Occurrences are added up in each task first. As the number of places grows with the table, there
    are no more such lines than 1,000 times the short lines of an average document, whatever the size.
    """
    places = lines.groupBy("line", "place").agg(F.count("*").alias("n"))
    counted = places.groupBy("line").agg(F.count("*").alias("places"), F.sum("n").alias("n"))
    enough = (F.col("places") >= MIN_PLACES) & (F.col("places") * DOCUMENTS_A_PLACE >= documents)
    return counted.where(enough & (F.col("places") * 2 >= F.col("n"))).select("line")


def quality(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lost_words).

    Lines are judged first, by themselves and by how the table repeats them, and removed if they fail; a document is
    then rejected if more than half of its words are gone. A null or empty text has no words, fails the base rule and
    is not kept. Null ids stay null, repeated rows are judged each and count each, other columns are not read, an empty
    table gives none. Digests of short lines are stored below ``spark.checkpoint.dir`` and grouped; texts are read
    twice and never shuffled. No Python.
    """
    text = F.coalesce("text", F.lit(""))
    # Arrays of words are computed once, below the projection that counts them.
    split = documents.select("doc_id", text.alias("text")).select(
        "doc_id",
        "text",
        digest(F.col("text")).alias("key"),
        words_of(F.col("text")).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"),
    )
    lines = stored(short_lines(split), "lines")
    # A line of one text is the same in all copies of the text.
    repeated = lines.join(common_lines(lines, documents.count()), "line").dropDuplicates(["key", "pos"])
    by_table = repeated.groupBy("key").agg(F.sum("n").alias("_by_table"))
    lost = F.aggregate(
        F.filter("lines", line_fails), F.lit(0), lambda n, line: n + F.size(words_of(line))
    )
    counted = split.select(
        "doc_id",
        "key",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.translate("text", SPACE_CHARS, "")).cast("bigint").alias("word_chars"),
        count_of(F.col("text"), SYMBOLS).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("bigint").alias("n_repeat_words"),
        lost.cast("bigint").alias("_by_itself"),
    )
    judged = counted.join(by_table, "key", "left").withColumn(
        "n_lost_words", F.col("_by_itself") + F.coalesce("_by_table", F.lit(0))
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return judged.withColumn("base_failed", failed).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (100 * F.col("n_lost_words") <= MAX_LOST * F.col("n_words"))).alias("kept"),
        "n_lost_words",
    )
