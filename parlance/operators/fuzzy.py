"""Dictionary lookup and correction by the likeness of phoneme strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import ALNUM, let, words


def similarity(a: Column, b: Column) -> Column:
    """1 - edits / longer length; 1 for two empty strings."""
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / n)


def bare(word: Column) -> Column:
    """Lower case, letters, digits and apostrophes only."""
    return F.lower(F.regexp_replace(word, f"[^{ALNUM}']", ""))


def lookup(tokens: DataFrame, dictionary: DataFrame, word: str = "word") -> DataFrame:
    """tokens with ``phonemes`` from (word, phonemes), null where the dictionary lacks the word."""
    names = dictionary.groupBy(F.lower("word").alias("_key")).agg(F.min("phonemes").alias("phonemes"))
    return tokens.withColumn("_key", bare(F.col(word))).join(names, "_key", "left").drop("_key")


def allowed_edits(longer: Column, threshold: float) -> Column:
    """The most edits that leave a similarity of at least the threshold where the longer string has so many symbols."""
    return F.floor(longer * (1.0 - threshold) + 1e-9).cast("int")


def _reach(n: Column, threshold: float) -> tuple[Column, Column]:
    """The shortest and longest partner of a string of n symbols."""
    return F.ceil(n * threshold - 1e-9).cast("int"), F.floor(n / threshold + 1e-9).cast("int")


def _segment(m: Column, i: Column, parts: Column) -> tuple[Column, Column]:
    """Start (from 0) and size of part i when m symbols are cut as evenly as can be, longer parts last."""
    size = F.floor(m / parts).cast("int")
    plain = parts - m % parts
    return i * size + F.greatest(F.lit(0), i - plain), size + (i >= plain).cast("int")


def _partner_parts(m: Column, threshold: float) -> Column:
    """Parts of an entry of m symbols: one more than the edits that its longest partner allows."""
    return allowed_edits(_reach(m, threshold)[1], threshold) + 1


def entry_segments(entries: DataFrame, threshold: float) -> DataFrame:
    """(entry, sound, m, i, segment): the parts of each entry (word, phonemes); a single empty one where there are fewer symbols than parts."""
    named = entries.where("phonemes is not null").select(F.col("word").alias("entry"), F.col("phonemes").alias("sound"), F.length("phonemes").alias("m"))
    named = named.withColumn("_parts", _partner_parts(F.col("m"), threshold))

    def part(i: Column) -> Column:
        start, size = _segment(F.col("m"), i, F.col("_parts"))
        return F.struct(i.alias("i"), F.substring("sound", start + 1, size).alias("segment"))

    whole = F.array(F.struct(F.lit(-1).alias("i"), F.lit("").alias("segment")))
    cut = F.when(F.col("m") >= F.col("_parts"), F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), part)).otherwise(whole)
    return named.select("entry", "sound", "m", F.inline(cut))


def sound_segments(sounds: DataFrame, threshold: float) -> DataFrame:
    """(phonemes, m, i, segment): what a partner of each length m can have as its part i, at the shifts that the edits before and after it leave."""
    n = F.length("phonemes")
    least, most = _reach(n, threshold)
    sized = sounds.select("phonemes", F.explode(F.sequence(least, most)).alias("m")).withColumn("_parts", _partner_parts(F.col("m"), threshold))
    numbers = F.when(F.col("m") >= F.col("_parts"), F.sequence(F.lit(0), F.col("_parts") - 1)).otherwise(F.array(F.lit(-1)))
    placed = sized.select("phonemes", "m", "_parts", F.explode(numbers).alias("i"))
    start, size = _segment(F.col("m"), F.col("i"), F.col("_parts"))
    more, left = n - F.col("m"), F.col("_parts") - 1 - F.col("i")
    placed = placed.withColumns({
        "_size": size,
        "_low": F.greatest(F.lit(0), start - F.col("i"), start + more - left),
        "_high": F.least(n - size, start + F.col("i"), start + more + left),
    })
    here = F.array_distinct(F.transform(F.sequence("_low", "_high"), lambda at: F.substring("phonemes", at + 1, F.col("_size"))))
    found = F.when(F.col("i") < 0, F.array(F.lit(""))).when(F.col("_low") <= F.col("_high"), here)
    return placed.select("phonemes", "m", "i", F.explode(found).alias("segment"))


def candidates(sounds: DataFrame, entries: DataFrame, threshold: float) -> DataFrame:
    """(phonemes, entry, sound) that share a part at a place where a pair at the threshold must share one; a pair may come more than once.

    An entry is cut to one part more than there may be edits, so one part at least
    stands in its partner as it is, shifted by no more than the edits before it.  The
    join is on length, part and its symbols.  Strings with fewer symbols than parts
    meet by length.
    """
    distinct = sounds.select("phonemes").where("phonemes is not null").distinct()
    return sound_segments(distinct, threshold).join(entry_segments(entries, threshold), ["m", "i", "segment"]).select("phonemes", "entry", "sound")


def best_matches(sounds: DataFrame, entries: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(phonemes, entry, similarity): the best entry of (word, phonemes) at the threshold for each distinct phoneme string; the first word of equals.

    Candidates share a segment; edits are counted in a band no wider than the threshold
    allows.  threshold: above 0, at most 1.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is above 0 and at most 1")
    longer = F.greatest(F.length("phonemes"), F.length("sound"))
    pairs = candidates(sounds, entries, threshold)
    edits = F.expr(f"levenshtein(phonemes, sound, cast(floor(greatest(length(phonemes), length(sound)) * {1.0 - threshold!r} + 1e-9) as int))")
    scored = pairs.withColumn("_edits", edits).where("_edits >= 0").withColumn("similarity", F.when(longer == 0, 1.0).otherwise(1.0 - F.col("_edits") / longer)).where(F.col("similarity") >= threshold)
    best = scored.groupBy("phonemes").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "entry")).alias("b"))
    return best.select("phonemes", F.col("b.entry").alias("entry"), (-F.col("b.s")).alias("similarity"))


def correct(utterances: DataFrame, dictionary: DataFrame, entries: DataFrame, threshold: float = 0.85, most: int = 3) -> DataFrame:
    """utt_id, text, corrections (original, replacement): words and runs of up to ``most`` words replaced by dictionary entries.

    Candidates are taken by falling similarity, shorter first, then as they stand;
    taken words are not taken again.  A run whose entry equals its first word loses
    that word as well.
    """
    split = utterances.select("utt_id", words(F.col("text")).alias("w"))
    tokens = split.select("utt_id", F.posexplode("w").alias("i", "word"))
    sounds = lookup(tokens, dictionary).groupBy("utt_id").agg(F.array_sort(F.collect_list(F.struct("i", "phonemes"))).alias("p"))
    both = split.join(sounds, "utt_id", "left")

    def run(i: Column, k: Column) -> Column:
        sound = F.slice("p", i + 1, k)
        # a run with an unknown word has no sound
        said = F.when(~F.exists(sound, lambda x: x["phonemes"].isNull()), F.array_join(F.transform(sound, lambda x: x["phonemes"]), ""))
        return F.struct(i.alias("i"), k.alias("k"), F.get("w", i).alias("first"), said.alias("phonemes"))

    runs = F.flatten(F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.size("w") - i)), lambda k: run(i, k))))
    windows = both.where(F.size("w") > 0).select("utt_id", F.inline(runs))
    found = windows.join(best_matches(windows, entries, threshold), "phonemes")
    found = found.where((F.col("k") > 1) | (F.lower("first") != F.lower("entry")))
    rows = F.struct((-F.col("similarity")).alias("s"), "k", "i", "entry")
    picked = found.groupBy("utt_id").agg(F.array_sort(F.collect_list(rows)).alias("c"))
    out = split.join(picked, "utt_id", "left")

    def step(taken: Column, c: Column) -> Column:
        clash = F.exists(taken, lambda t: (t["i"] < c["i"] + c["k"]) & (c["i"] < t["i"] + t["k"]))
        return F.when(clash, taken).otherwise(F.concat(taken, F.array(F.struct(c["i"].alias("i"), c["k"].alias("k"), c["entry"].alias("entry")))))

    taken = F.aggregate(F.coalesce("c", F.array().cast("array<struct<s:double,k:int,i:int,entry:string>>")), F.array().cast("array<struct<i:int,k:int,entry:string>>"), step)
    out = out.withColumn("t", taken)

    def word_at(w: Column, i: Column) -> Column:
        inside = F.filter("t", lambda t: (t["i"] <= i) & (i < t["i"] + t["k"]))
        first = let(F.get(inside, F.lit(0)), lambda t: F.when((t["i"] == i) & (t["entry"] != w), t["entry"]))
        return F.when(F.size(inside) == 0, w).otherwise(first)

    text = F.array_join(F.filter(F.transform("w", word_at), lambda x: x.isNotNull()), " ")
    made = F.transform("t", lambda t: F.struct(F.array_join(F.slice("w", t["i"] + 1, t["k"]), " ").alias("original"), t["entry"].alias("replacement")))
    return out.select("utt_id", text.alias("text"), made.alias("corrections"))
