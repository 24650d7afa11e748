"""Lines, tokens and skip-grams of a corpus that is cut into slices.

A corpus is a DataFrame (slice, doc_id, line_no, line). Tokens are what lies between white space, as
Python's ``str.split`` has it; tokens shorter than the minimum are left out before pairs are formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.staging import discard, freed_shuffles, shared_dir, staged

SPACE = "(?U)[\\s\\x1c-\\x1f]+"
WINDOW, MIN_LENGTH = 5, 3


def corpus_lines(docs: DataFrame, slice_by: str | Column, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Lines of whole texts; null texts have none."""
    by = F.col(slice_by) if isinstance(slice_by, str) else slice_by
    return docs.select(by.alias("slice"), F.col(key).alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files, trimmed and in lower case, without blank ones."""
    return cleaned(spark.read.text(path).select(F.col("value").alias("line")))


def cleaned(lines: DataFrame) -> DataFrame:
    """``lines`` (.., line) trimmed and in lower case, without blank ones."""
    return lines.withColumn("line", F.lower(F.trim("line"))).where("line != ''")


def tokens(line: str | Column, min_length: int = MIN_LENGTH) -> Column:
    least = max(min_length, 1)
    return F.filter(F.split(line, SPACE), lambda x: F.length(x) >= least)


def normalised(text: str | Column) -> Column:
    """Lower case, without punctuation, single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, "\\p{Punct}", "")), "\\s+", " "))


def lemmatised(tokens_df: DataFrame, lemmas: DataFrame) -> DataFrame:
    """``tokens_df`` (.., word) with each word replaced by its lemma in ``lemmas`` (word, lemma), where it has one; of several the first in order."""
    table = lemmas.groupBy("word").agg(F.min("lemma").alias("lemma"))
    joined = tokens_df.join(table, "word", "left")
    return joined.withColumn("word", F.coalesce("lemma", "word")).select(*tokens_df.columns)


#: Ordered rules (ending, what replaces it, least letters that are left): the first whose result is a known word is taken.
SUFFIXES = [
    ("ies", "y", 2), ("ied", "y", 2), ("sses", "ss", 1), ("xes", "x", 1), ("ches", "ch", 1), ("shes", "sh", 1), ("ves", "f", 2), ("es", "e", 2), ("es", "", 2), ("s", "", 2),
    ("ing", "", 3), ("ing", "e", 2), ("ed", "", 3), ("ed", "e", 2), ("er", "", 3), ("er", "e", 2), ("est", "", 3), ("est", "e", 2),
]


def rule_lemmas(vocabulary: DataFrame, exceptions: DataFrame | None = None, rules: list[tuple[str, str, int]] | None = None) -> DataFrame:
    """(word, lemma) for the distinct words of ``vocabulary`` (word) that change: by an exception (word, lemma; of several the first in order), else by the first rule whose result is a known word.

    A doubled last letter is looked for single as well (``running``: ``run``), after the ending's own results. Known words are those of the
    vocabulary and the exceptions' lemmas. A rule's result is a lemma as it is: rules aren't applied again.
    """
    rules = SUFFIXES if rules is None else rules
    words = vocabulary.select("word").where("word is not null").distinct()
    tries = []
    for end, new, least in rules:
        fits = F.col("word").endswith(end) & (F.length("word") >= least + len(end))
        stem = F.expr(f"left(word, length(word) - {len(end)})")
        tries.append(F.when(fits, F.concat(stem, F.lit(new))))
        if end in ("ing", "ed", "er", "est") and not new:
            double = fits & stem.rlike("([b-df-hj-np-tv-z])\\1$")
            tries.append(F.when(double, F.expr(f"left(word, length(word) - {len(end) + 1})")))
    numbered = F.array(*[F.struct(F.lit(i).alias("place"), t.alias("lemma")) for i, t in enumerate(tries)])
    made = words.select("word", F.inline(F.filter(numbered, lambda x: x["lemma"].isNotNull())))
    known = words
    if exceptions is not None:
        known = words.union(exceptions.select("lemma").where("lemma is not null")).distinct()
    found = made.join(known.withColumnRenamed("word", "lemma"), "lemma", "left_semi").groupBy("word").agg(F.min(F.struct("place", "lemma"))["lemma"].alias("lemma"))
    if exceptions is not None:
        told = exceptions.where("word is not null and lemma is not null").groupBy("word").agg(F.min("lemma").alias("lemma")).join(words, "word", "left_semi")
        found = told.unionByName(found.join(told, "word", "left_anti"))
    return found.where("lemma != word")


#: Tokens of a line that are one row in :func:`long_skipgrams`.
CHUNK = 4096


def long_skipgrams(corpus: DataFrame, window: int = WINDOW, min_length: int = MIN_LENGTH, chunk: int = CHUNK) -> DataFrame:
    """What :func:`skipgrams` gives, for lines of any length: (slice, w1, w2), of lines cut into chunks of tokens that are dealt to all tasks.

    A chunk holds ``chunk`` words and the ``window`` + 1 that follow it, so each pair is made by the chunk of its first word, once. Behind the cut no row holds a line.
    """
    lines = corpus.select("slice", tokens("line", min_length).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.size("words") - 1, F.lit(chunk))
    cuts = lines.select("slice", F.explode(F.transform(starts, lambda s: F.slice("words", s + 1, F.lit(chunk + window + 1)))).alias("words"))
    dealt = cuts.repartition(F.xxhash64("words"))
    first = dealt.select("slice", "words", F.posexplode(F.slice("words", 1, chunk)).alias("at", "w1"))
    return first.select("slice", "w1", F.explode(_following(window)).alias("w2"))


def words(corpus: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    return corpus.select("slice", F.explode(tokens("line", min_length)).alias("word"))


def skipgrams(corpus: DataFrame, window: int = WINDOW, min_length: int = MIN_LENGTH) -> DataFrame:
    """Ordered pairs (slice, w1, w2): each token with each of the ``window`` + 1 tokens that follow it in its line."""
    lines = corpus.select("slice", tokens("line", min_length).alias("words"))
    first = lines.select("slice", "words", F.posexplode("words").alias("at", "w1"))
    return first.select("slice", "w1", F.explode(_following(window)).alias("w2"))


def _following(window: int) -> Column:
    """The words that a line's word at ``at`` pairs with. Both generators are one pipeline: the line isn't copied for its words."""
    return F.slice("words", F.col("at") + 2, F.lit(window + 1))


def ranked_pairs(corpus: DataFrame, ranks: DataFrame, window: int = WINDOW, min_length: int = MIN_LENGTH, broadcast: bool = True) -> DataFrame:
    """Skip-grams (slice, i, j) of words in ``ranks`` (slice, word, rank), by rank: a row for each occurrence. Words that aren't in ``ranks`` still hold their places in a line."""
    lines = corpus.select("slice", tokens("line", min_length).alias("words"))
    sent = F.broadcast if broadcast else lambda df: df
    focus = sent(ranks.select("slice", F.col("word").alias("w1"), F.col("rank").alias("i")))
    context = sent(ranks.select("slice", F.col("word").alias("w2"), F.col("rank").alias("j")))
    first = lines.select("slice", "words", F.posexplode("words").alias("at", "w1")).join(focus, ["slice", "w1"])
    return first.select("slice", "i", F.explode(_following(window)).alias("w2")).join(context, ["slice", "w2"]).select("slice", "i", "j")


def ranked_pair_counts(corpus: DataFrame, ranks: DataFrame, window: int = WINDOW, min_length: int = MIN_LENGTH) -> DataFrame:
    """Counts (slice, i, j, n) of the skip-grams of words in ``ranks`` (slice, word, rank), by rank.

    ``ranks`` is to be broadcast: words become numbers, and pairs of other words go, before anything is grouped. The groups of a slice are
    bounded by the square of its words.
    """
    return ranked_pairs(corpus, ranks, window, min_length).groupBy("slice", "i", "j").agg(F.count("*").alias("n"))


def word_counts(corpus: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    return words(corpus, min_length).groupBy("slice", "word").agg(F.count("*").alias("n"))


def pair_counts(corpus: DataFrame, window: int = WINDOW, min_length: int = MIN_LENGTH) -> DataFrame:
    """Combined before they are shuffled: a row for each pair and task."""
    return skipgrams(corpus, window, min_length).groupBy("slice", "w1", "w2").agg(F.count("*").alias("n"))


#: Most rounds in which :func:`frequent_pairs` counts: so many times less of the shuffle is on disk at a time; and pairs of a round where fewer rounds do.
ROUNDS, ROUND_PAIRS = 16, 8_000_000


def frequent_pairs(corpus: DataFrame, least: int, window: int = WINDOW, min_length: int = MIN_LENGTH, rounds: int | None = None) -> DataFrame:
    """Of :func:`pair_counts` those over ``least``, as a written table.

    Most pairs occur once, and are many times the text when they are shuffled. So tokens are written once, and pairs are made, counted and
    dropped in rounds by their first word: what is on disk at a time is the tokens, a round's shuffle and the pairs that stay.
    """
    held = shared_dir(corpus.sparkSession)
    lines = staged(corpus.select("slice", tokens("line", min_length).alias("words"), F.lit(0).alias("cut")).where(F.size("words") > 1), held)
    return _counted_in_rounds(lines, [held], least, window, rounds)


def frequent_pairs_of_pieces(pieces: DataFrame, least: int, window: int = WINDOW, min_length: int = MIN_LENGTH, rounds: int | None = None) -> DataFrame:
    """What :func:`frequent_pairs` gives for slices that are one line each: their ``pieces`` (slice, at, line) in order of ``at``, with a space between.

    No line is put together. Pairs inside of a piece are made where it is read; a piece's last words meet the words that follow it in rows of their own, for
    which only the first and last words of pieces are sorted. Pieces of one ``at`` are in order of their text.
    """
    k, held = window + 1, [shared_dir(pieces.sparkSession) for _ in range(3)]
    words = pieces.select("slice", "at", F.left("line", F.lit(64)).alias("text"), F.xxhash64("line").alias("tie"), tokens("line", min_length).alias("words")).where(F.size("words") > 0)
    words = staged(words, held[0])
    edges = words.select("slice", "at", "text", "tie", F.slice("words", F.lit(1), F.lit(k)).alias("head"), F.slice("words", -F.least(F.size("words"), F.lit(k)), F.lit(k)).alias("tail"))
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = staged(edges.repartitionByRange(parts, "slice", "at", "text", "tie").withColumn("part", F.spark_partition_id()), held[1])
    inside = Window.partitionBy("slice", "part").orderBy("at", "text", "tie")
    joined = lambda w: F.slice(F.flatten(F.collect_list("head").over(w.rowsBetween(1, k))), 1, k)
    # The first words of a part are those of its first pieces: a row for each slice and part.
    firsts = edges.withColumn("place", F.row_number().over(inside)).where(F.col("place") <= k).groupBy("slice", "part")
    firsts = firsts.agg(F.slice(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "head"))), lambda x: x["head"])), 1, k).alias("head"))
    after = firsts.select(F.col("slice").alias("s"), F.col("part").alias("p"), joined(Window.partitionBy("slice").orderBy("part")).alias("after"))
    near = edges.select("slice", "part", "tail", joined(inside).alias("near")).join(after, F.col("slice").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    across = near.select("slice", F.concat("tail", F.slice(F.concat("near", "after"), 1, k)).alias("words"), F.size("tail").alias("cut"))
    lines = words.select("slice", "words", F.lit(0).alias("cut")).unionByName(staged(across, held[2]))
    return _counted_in_rounds(lines, held, least, window, rounds)


def _counted_in_rounds(lines: DataFrame, held: list[str], least: int, window: int, rounds: int | None) -> DataFrame:
    """Counts over ``least`` of the skip-grams of ``lines`` (slice, words, cut); with a cut only of those of a word before it with one behind it. They are written in ``held``, which is deleted."""
    spark, paths = lines.sparkSession, []
    rounds = rounds or max(1, min(ROUNDS, (lines.agg(F.sum(_pairs_of_line(window))).first()[0] or 0) // ROUND_PAIRS + 1))
    first = lines.select("slice", "words", "cut", F.posexplode("words").alias("at", "w1")).where("cut = 0 or at < cut")
    start = F.greatest(F.col("at") + 2, F.col("cut") + 1)
    following = F.slice("words", start, F.greatest(F.col("at") + (window + 3) - start, F.lit(0)))
    for r in range(rounds):
        mine = first.where(F.pmod(F.xxhash64("w1"), F.lit(rounds)) == r).select("slice", "w1", F.explode(following).alias("w2"))
        paths.append(shared_dir(spark))
        out = staged(mine.groupBy("slice", "w1", "w2").agg(F.count("*").alias("n")).where(F.col("n") > least), paths[-1])
        freed_shuffles(spark)
    discard(spark, *held)
    return spark.read.schema(out.schema).parquet(*paths)


def _pairs_of_line(window: int) -> Column:
    """Skip-grams of a line with ``words``, by their number alone."""
    n, k = F.size("words"), window + 1
    whole = F.greatest(n - k, F.lit(0)) * k
    rest = F.least(n, F.lit(k))
    return (whole + rest * (rest - 1) / 2).cast("long")


def counted(corpus: DataFrame, window: int = WINDOW, min_length: int = MIN_LENGTH) -> tuple[DataFrame, DataFrame]:
    """Word counts (slice, word, n) and skip-gram totals (slice, pairs) of one scan and one shuffle, both parts of one written table."""
    one = F.transform("words", lambda w: F.struct(w.alias("word"), F.lit(1).cast("long").alias("n"), F.lit(False).alias("mark")))
    total = F.array(F.struct(F.lit(None).cast("string").alias("word"), _pairs_of_line(window).alias("n"), F.lit(True).alias("mark")))
    lines = corpus.select("slice", tokens("line", min_length).alias("words"))
    both = staged(lines.select("slice", F.inline(F.concat(one, total))).groupBy("slice", "word", "mark").agg(F.sum("n").alias("n")))
    return both.where("not mark").select("slice", "word", "n"), both.where("mark").select("slice", F.col("n").alias("pairs"))


def pair_key(w1: str | Column = "w1", w2: str | Column = "w2") -> Column:
    """The pair's key as one string, as sketches of pairs have it; words with ``#`` aren't told apart from others."""
    return F.concat_ws("#", w1, w2)


def pair_totals(corpus: DataFrame, window: int = WINDOW, min_length: int = MIN_LENGTH) -> DataFrame:
    """Skip-grams of each slice, from the lines' lengths alone."""
    lines = corpus.select("slice", tokens("line", min_length).alias("words"))
    return lines.groupBy("slice").agg(F.sum(_pairs_of_line(window)).alias("pairs"))
