"""Language test by function words, and the choice of the best text of a source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that carry grammar rather than matter: articles, pronouns, prepositions, conjunctions and auxiliaries.  A word may count for several languages.
FUNCTION_WORDS = {
    "en": "the a an this that these those he she it we they you his her its our their your who which what of to in on at by for with from into over under about after before between and or but nor if than because while although is are was were be been being has have had do does did will would can could may might must shall should not no there here how when where only also very such each both some any all more most".split(),
    "es": "el la los las un una unos este esta estos ese esa él ella ellos nosotros su sus que quien cual de del a al en con por para sin sobre entre hasta desde hacia y e o u pero si porque aunque como es son fue eran ser está están ha han había no ni muy más también donde cuando".split(),
    "fr": "le la les un une des ce cet cette ces il elle ils elles nous vous on son sa ses leur leurs qui que dont de du au aux en dans par pour sur avec sans sous entre chez et ou mais donc car si comme est sont était être ont été pas ne plus très aussi où quand".split(),
    "de": "der die das den dem des ein eine einen einem einer er sie es wir ihr sein seine ihre unser wer von zu zum zur mit auf für aus bei nach über unter zwischen durch gegen und oder aber denn wenn weil dass als wie ist sind war waren wird werden wurde hat haben hatte kann nicht kein auch nur noch sehr im am".split(),
    "pt": "o a os as um uma este esta isto esse essa ele ela eles nós seu sua seus suas que quem qual de do da dos das em no na nos nas ao aos com por pelo pela para sem sobre entre até e ou mas se porque como é são foi eram ser está estão tem não nem muito mais também onde quando".split(),
    "it": "il lo la i gli le un uno una questo questa quello lui lei loro noi suo sua suoi che chi cui di del della dei delle a al alla da dal dalla in nel nella con su sul per tra fra e ed o ma se perché come è sono era erano essere ha hanno non né molto più anche dove quando".split(),
    "nl": "de het een dit dat deze die hij zij wij ze we hun haar zijn wie van naar in op te aan met voor door uit bij tussen over onder tegen en of maar want als omdat toen is was waren wordt worden werd heeft hebben had kan zal niet geen ook nog zeer er om waar wanneer".split(),
    "sv": "den det de en ett denna detta han hon vi ni sin sina deras som vem av till i på med för från om under över mellan mot utan och eller men ty eftersom när där är var blir blev har hade kan ska skulle inte ingen också bara mycket att".split(),
    "vi": "là của và các một những được cho trong với không này đó có từ đến bởi tại trên dưới giữa nhưng hoặc vì nếu khi như cũng rất đã sẽ đang bị ở người họ chúng tôi".split(),
}
# An article or preposition that has lost its vowel before the next word.
_ELIDED = {"fr": r"(?:^|[^\p{L}\p{M}])(?:[cdjlmnst]|qu)['’]\p{L}", "it": r"(?:^|[^\p{L}\p{M}])(?:[cdlmnstv]|un|dell|nell|all|sull|dall|quest)['’]\p{L}"}
#: Least share of Latin letters, largest share of words with a letter beyond ASCII, and, in texts of LONG words, the least share of English function words.
LATIN_SHARE, ACCENTED_SHARE, LONG, ENGLISH_SHARE = 0.7, 0.25, 30, 0.08


def language_counts(text: Column) -> Column:
    """letters, latin, n (words), accented (words with a letter beyond ASCII) and, for each language, how many of the words are its function words.

    Each word is looked up once, giving a number with one bit for each language that has it.
    """
    low = F.lower(F.regexp_replace(text, r"https?://\S+", " "))
    bits = {lang: 1 << i for i, lang in enumerate(FUNCTION_WORDS)}
    accented = 1 << len(bits)

    def mark(word: Column) -> Column:
        flags = [F.when(word.isin(words), bits[lang]).otherwise(0) for lang, words in FUNCTION_WORDS.items()]
        return reduce(Column.__add__, flags, F.when(word.rlike(r"[^\x00-\x7f]"), accented).otherwise(0))

    def counted(marks: Column) -> Column:
        count = lambda bit: F.size(F.filter(marks, lambda m: m.bitwiseAND(F.lit(bit)) != 0))
        votes = [(count(bit) + (F.regexp_count(low, F.lit(_ELIDED[lang])) if lang in _ELIDED else F.lit(0))).alias(lang) for lang, bit in bits.items()]
        kept = lambda pattern: F.length(F.regexp_replace(low, pattern, ""))
        return F.struct(kept(r"\P{L}+").alias("letters"), kept(r"\P{IsLatin}+").alias("latin"), F.size(marks).alias("n"), count(accented).alias("accented"), *votes)

    words = F.filter(F.split(low, r"[^\p{L}\p{M}]+"), lambda w: w != "")
    return F.element_at(F.transform(F.array(F.transform(words, mark)), counted), 1)


def is_english(counts: Column) -> Column:
    """The verdict on ``language_counts``: English function words must outnumber those of every other language.

    A text with as many of both (a title, mostly, that has none) passes if it is short and all its letters are ASCII.
    """
    rival = F.greatest(*(counts[lang] for lang in FUNCTION_WORDS if lang != "en"))
    enough = (counts["n"] < LONG) | (counts["en"] >= ENGLISH_SHARE * counts["n"])
    plain = (counts["n"] < LONG) & (counts["accented"] == 0)
    script = (counts["n"] > 0) & (counts["latin"] >= LATIN_SHARE * counts["letters"]) & (counts["accented"] <= ACCENTED_SHARE * counts["n"])
    return script & F.when(counts["en"] == rival, plain).otherwise((counts["en"] > rival) & enough)


def english(text: Column) -> Column:
    """Whether a text reads as English, judged by the whole of it.  Native expressions only; null and empty texts do not."""
    return F.element_at(F.transform(F.array(language_counts(F.coalesce(text, F.lit("")))), is_english), 1)


def best_texts(parts: DataFrame) -> DataFrame:
    """candidate_id, text, text_source, reasons: per source the best text it has.

    parts: candidate_id, kind (pdf, supplied, page, snippet), text, problem (null or why it can't serve).  A file of 400 characters or more
    beats a supplied text, that a page; failing those the longest of snippet and supplied text of 40 characters or more, as abstract.
    """
    length = F.length(F.trim("text"))
    full = F.col("kind").isin("pdf", "supplied", "page") & F.col("problem").isNull() & (length >= 400)
    brief = F.col("kind").isin("snippet", "supplied") & (length >= 40)
    place = F.when(full, F.when(F.col("kind") == "pdf", 1).when(F.col("kind") == "supplied", 2).otherwise(3)).when(brief, 4)
    order = Window.partitionBy("candidate_id").orderBy(F.asc_nulls_last("place"), F.desc("size"), "kind")
    ranked = parts.withColumn("place", place).withColumn("size", length).withColumn("n", F.row_number().over(order))
    why = F.when(F.col("kind").isin("pdf", "page") & ~F.coalesce(full, F.lit(False)), F.coalesce("problem", F.lit("too short")))
    reasons = ranked.groupBy("candidate_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(why.isNotNull(), F.struct(F.when(F.col("kind") == "pdf", 1).otherwise(2).alias("o"), why.alias("w"))))), lambda x: x["w"]), ", ").alias("reasons"))
    best = ranked.where("n = 1 and place is not null").select("candidate_id", "text", F.when(F.col("place") == 4, "abstract_only").otherwise(F.col("kind")).alias("text_source"))
    return best.join(reasons, "candidate_id").withColumn("reasons", F.when(F.col("text_source") == "abstract_only", F.coalesce(F.when(F.col("reasons") != "", F.col("reasons")), F.lit("no full text"))))
