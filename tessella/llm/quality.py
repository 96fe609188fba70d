"""Quality rules by distribution divergence, in DataFrame functions only.

Every document's character-class histogram and common-word histogram are held against those of its
language (all documents of the same ``lang``; null is a language of its own) by Jensen-Shannon distance.
A language's reference is its own counts and, as a prior of a fixed number of words, the shares of all languages
together; so one of few words leans on the rest and one of many is its own. Base rules on length and repetition
come first.

Words are counted once, in one scan, by their spelling; classes, totals and common words come from the counts.

Defined results. Null or empty text: no words, zero measures, ``base_failed``. Repeated rows: each row has
its own result. An empty table gives an empty result. Only ``doc_id``, ``text`` and ``lang`` are read; extra
columns, whatever their names, stay out of the result. No text is too long: the work per document is
n log n at most, and no group of documents is gathered anywhere.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, SPACES, Scratch, held, words_of

SYMBOLS = "#*$%&|<>"

#: Character classes, by what is left once all else is deleted; lower case and the rest make up the remainder.
CLASSES = (
    ("upper", "A-Z"),
    ("digit", "0-9"),
    ("stop", r".,;:'\x22()\x2D"),
    ("mark", r"!?@\x5B\x5D\x5C\x5E_`{}~+=/"),
    ("symbol", r"#*$%&|<>"),
    ("wide", r"\x{80}-\x{10FFFF}"),
)


@dataclass(frozen=True)
class QualityParams:
    min_words: int = 10
    max_repeat_pct: int = 20
    #: Histograms of shorter texts say too little: such texts are judged by the base rules alone.
    min_chars: int = 200
    min_hist_words: int = 60
    #: Words and characters of all languages' shares that are added to each language's own.
    prior_words: int = 1000
    prior_chars: int = 5000
    #: Common words: lower-cased, at least this share of their language's words (the prior's included), which bounds
    #: them at 1 / share words for each language.
    common_share: float = 0.01
    max_class_distance: float = 0.3
    max_word_distance: float = 0.33


def rare(text: Column) -> Column:
    """The text without lower-case letters and blanks: long runs go at once, and the classes are counted in the short rest."""
    return F.regexp_replace(text, r"[a-z\x20\x09-\x0D]+", "")


def class_columns(r: Column) -> list[Column]:
    return [F.length(F.regexp_replace(r, f"[^{c}]+", "")).cast("long").alias("n_symbols" if name == "symbol" else f"c_{name}") for name, c in CLASSES]


def measures(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang, words and the base measures of every row, and ``row``, a struct of the columns to keep."""
    row = [F.struct(*[F.col(f"`{k}`").alias(k) for k in keep]).alias("row")] if keep else []
    d = docs.select("doc_id", "lang", *row, F.coalesce("text", F.lit("")).alias("t"))
    d = d.withColumn("w", words_of(F.col("t")))
    d = d.withColumn("h", F.transform("w", lambda x: F.xxhash64(x))).withColumn("n_words", F.size("w").cast("long"))
    five = F.when(
        F.col("n_words") >= 5,
        F.transform(F.slice("h", F.lit(1), F.greatest(F.lit(0), F.size("w") - 4)), lambda a, i: F.xxhash64(a, *[F.get("h", i + k) for k in range(1, 5)])),
    ).otherwise(F.expr("cast(array() as array<bigint>)"))
    d = d.withColumn("v", five).withColumn("plain", F.size(F.array_distinct("v")) == F.size("v"))
    # only texts with a repeated window pay for the sort
    order = F.when(F.col("plain"), F.expr("cast(array() as array<struct<h:bigint,i:int>>)")).otherwise(F.array_sort(F.transform("v", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    d = d.withColumn("o", order)
    same = lambda j, k: F.get("o", j).getField("h") == F.get("o", k).getField("h")
    starts = F.array_sort(
        F.transform(
            F.filter(F.sequence(F.lit(0), F.size("o") - 1), lambda j: F.coalesce(same(j, j - 1), F.lit(False)) | F.coalesce(same(j, j + 1), F.lit(False))),
            lambda j: F.get("o", j).getField("i"),
        )
    )
    d = d.withColumn("p", F.when(F.col("plain"), F.expr("cast(array() as array<int>)")).otherwise(starts))
    covered = F.aggregate(
        "p",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, i: F.struct((i + 5).alias("end"), (a["n"] + (i + 5 - F.greatest(i, a["end"]))).alias("n")),
        lambda a: a["n"],
    )
    d = d.withColumn("n_repeat_words", covered)
    d = d.withColumn("lines", F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.withColumn("r", rare(F.col("t")))
    return d.select(
        "doc_id",
        "lang",
        *["row"] * bool(keep),
        "w",
        "n_words",
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length("t").cast("long").alias("n_chars"),
        *class_columns(F.col("r")),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
    )


def _count(name: str) -> Column:
    return F.col("n_symbols" if name == "symbol" else f"c_{name}")


def class_counts() -> list[Column]:
    """Seven counts that add up to the code points outside words' surroundings: lower case and the rest first."""
    named = [_count(name) for name, _ in CLASSES]
    blank = F.col("n_chars") - F.col("word_chars")
    rest = F.col("n_chars") - blank
    for c in named:
        rest = rest - c
    return [F.greatest(rest, F.lit(0)), *named]


def _half(p: Column, q: Column) -> Column:
    return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(F.lit(0.0))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, 0 to 1, of two arrays of shares."""
    terms = F.zip_with(p, q, lambda a, b: _half(a, b) + _half(b, a))
    return F.when(p.isNotNull() & q.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2)))


def word_counts(docs: DataFrame) -> DataFrame:
    """(key, word, n): occurrences of each spelling in each language."""
    d = held(docs, "lang", "text").select(F.coalesce("lang", F.lit("\x00")).alias("key"), F.explode(F.split(F.coalesce("text", F.lit("")), SPACES)).alias("word"))
    return d.where("word <> ''").groupBy("key", "word").agg(F.count("*").alias("n"))


def references(counted: DataFrame, scratch: Scratch, params: QualityParams = QualityParams()) -> DataFrame:
    """A row for each language (``key``) that has words: shares of character classes, and common words with their shares.

    ``counted``: as ``word_counts`` makes it, at rest.
    """
    kinds = [f"k{i}" for i in range(len(CLASSES) + 1)]
    per_word = counted.withColumn("r", rare(F.col("word"))).select("key", "n", F.length("word").alias("word_chars"), F.length("word").alias("n_chars"), *class_columns(F.col("r")))
    totals = per_word.groupBy("key").agg(F.sum("n").alias("words"), *[F.sum(c * F.col("n")).alias(k) for k, c in zip(kinds, class_counts(), strict=True)])  # a row for each language
    totals = scratch.small(totals)
    low = counted.groupBy("key", F.lower("word").alias("word")).agg(F.sum("n").alias("n"))
    frequent = low.join(totals.select("key", "words"), "key").where(F.col("n") >= params.common_share * F.col("words"))
    # a word common in all languages together is so in one of them, so these are all that can be common, prior included
    wanted = scratch.small(frequent.select("word").distinct())  # at most 1 / share words for each language
    some = scratch.write(low.join(wanted, "word", "left_semi"), "frequent")
    whole = totals.agg(F.sum("words").alias("all_words"), *[F.sum(k).alias(f"all_{k}") for k in kinds])  # one row
    pooled = some.groupBy("word").agg(F.sum("n").alias("n_all"))
    often = pooled.crossJoin(F.broadcast(whole.select("all_words"))).where(F.col("n_all") >= params.common_share * F.col("all_words")).agg(F.collect_set("word").alias("often"))  # one row
    langs = totals.crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(often))  # one row each on the right
    own = some.join(totals.select("key", "words"), "key").where(F.col("n") >= params.common_share * F.col("words")).select("key", "word")
    asked = own.unionByName(langs.select("key", F.explode("often").alias("word"))).distinct()
    found = asked.join(some, ["key", "word"], "left").join(pooled, "word").join(langs.select("key", "words", "all_words"), "key")
    share = (F.coalesce("n", F.lit(0)) + params.prior_words * (F.col("n_all") / F.col("all_words"))) / (F.col("words") + params.prior_words)
    common = found.withColumn("share", share).where(F.col("share") >= params.common_share).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("word", "share"))).alias("common"))
    every, mine = sum(F.col(f"all_{k}") for k in kinds), sum(F.col(k) for k in kinds)
    shares = F.array(*[(F.col(k) + params.prior_chars * F.coalesce(F.try_divide(F.col(f"all_{k}"), every), F.lit(0.0))) / (mine + params.prior_chars) for k in kinds])
    return langs.select("key", shares.alias("ref_classes")).join(common, "key", "left").withColumn("common", F.coalesce("common", F.expr("cast(array() as array<struct<word:string,share:double>>)")))


def judged(docs: DataFrame, params: QualityParams = QualityParams(), broadcast_bytes: int = BROADCAST_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """All measures, both distances and the verdict of every row of ``docs`` (doc_id, text, lang).

    ``keep`` names columns that come along, whole, in a struct ``row``. ``class_distance`` and ``word_distance`` are null where a guard says that a histogram is too thin.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    counted = scratch.write(word_counts(docs), "words")
    ref = scratch.write(references(counted, scratch, params).coalesce(1), "languages")  # a row for each language
    scratch.drop(counted)
    if scratch.bytes(ref) * 8 <= broadcast_bytes:
        ref = F.broadcast(ref)
    d = measures(docs, keep).withColumn("key", F.coalesce("lang", F.lit("\x00"))).join(ref, "key", "left")
    classes = F.array(*[c.cast("double") for c in class_counts()])
    d = d.withColumn("classes", F.transform(classes, lambda x: x / F.greatest(F.lit(1), F.col("word_chars"))))
    # every word has its own blanks on both sides, so that the text shrinks by its length for each occurrence
    longest = F.coalesce(F.array_max(F.transform("common", lambda c: F.length(c["word"]))), F.lit(0))
    d = d.withColumn("longest", longest)  # lowering never shortens a word
    d = d.withColumn("padded", F.concat(F.lit(" "), F.lower(F.array_join(F.filter("w", lambda x: F.length(x) <= F.col("longest")), "  ")), F.lit(" ")))
    found = F.transform("common", lambda c: (F.length("padded") - F.length(F.replace("padded", F.concat(F.lit(" "), c["word"], F.lit(" "))))) / (F.length(c["word"]) + 2) / F.greatest(F.lit(1), F.col("n_words")))
    d = d.withColumn("found", F.when(F.col("n_words") >= params.min_hist_words, found))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    wide = lambda a: F.concat(a, F.array(F.greatest(F.lit(0.0), 1 - total(a))))
    d = d.withColumn("expected", F.transform("common", lambda c: c["share"]))
    d = d.withColumn("word_distance", distance(wide(F.col("found")), wide(F.col("expected"))))
    d = d.withColumn("class_distance", F.when(F.col("n_chars") >= params.min_chars, distance(F.col("classes"), F.col("ref_classes"))))
    failed = (F.col("n_words") < params.min_words) | (100 * F.col("n_repeat_words") > params.max_repeat_pct * F.col("n_words"))
    near = (F.coalesce("class_distance", F.lit(0.0)) <= params.max_class_distance) & (F.coalesce("word_distance", F.lit(0.0)) <= params.max_word_distance)
    return d.select(
        *["row"] * bool(keep), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & near).alias("kept"), F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance")
    )
