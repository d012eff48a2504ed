"""Filler removal and the spans of what it removes.

Each function gives struct<text, removed> or array<struct<start, end, label>> as a
Column.  The sequential passes run on strings of one symbol a token, where greedy
left-to-right scans are regular expressions, so the work is linear and native.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions.lexicon import CHINESE, ENGLISH, JAPANESE, JAPANESE_WORDS, KOREAN, SPANISH, FillerLexicon
from parlance.functions.text import chars, clean, col, flags, let, offsets, piece_span, pieces, strings, trim, words


def _result(text: Column, removed: Column) -> Column:
    return F.struct(text.alias("text"), removed.alias("removed"))


def _word_marks(tokens: Column, lexicon: FillerLexicon) -> Column:
    """A symbol a token: A and B a pair, p pure, x contextual and removed, others kept."""
    cleaned = F.transform(tokens, clean)

    def marked(c: Column) -> Column:
        starts = flags(c, lambda w, i: F.when(_pair_at(w, F.get(c, i + 1), lexicon), "1").otherwise("0")) if lexicon.pairs else flags(c, lambda w, i: F.lit("0"))
        pairs = F.regexp_replace(starts, "1[01]", "AB")

        def symbol(t: Column, w: Column, pair: Column) -> Column:
            ends = t.endswith(".") | t.endswith("!") | t.endswith("?") | t.endswith(",")
            free = F.when(w.isin(*lexicon.pure), "p") if lexicon.pure else F.when(F.lit(False), "p")
            if lexicon.contextual:
                free = free.when(w.isin(*lexicon.contextual), F.when(ends, "C").otherwise("c"))
            return F.when(pair.isin("A", "B"), pair).otherwise(free.otherwise(F.when(ends, "K").otherwise("k")))

        return let(chars(pairs), lambda m: flags(tokens, lambda t, i: symbol(t, F.get(c, i), F.get(m, i))))

    return let(cleaned, lambda c: _boundaries(marked(c)))


def _pair_at(first: Column, second: Column, lexicon: FillerLexicon) -> Column:
    hit = F.lit(False)
    for a, b in lexicon.pairs:
        hit = hit | ((first == a) & (second == b))
    return F.coalesce(hit, F.lit(False))


def _boundaries(marks: Column) -> Column:
    """Contextual tokens (c, C) at a boundary become x: at the start, after a kept token that ends a clause (K, or a C that is kept)."""
    runs = F.regexp_extract_all(marks, F.lit("^[ABpcC]+|[Kk][ABpcC]*"), F.lit(0))

    def settle(run: Column) -> Column:
        at = F.locate("C", run)
        after = F.concat(F.substring(run, F.lit(1), at), F.translate(F.substring(run, at + 1, F.length(run)), "cC", "xx"))
        return F.when(~run.startswith("k"), F.translate(run, "cC", "xx")).when(at > 0, after).otherwise(run)

    return F.array_join(F.transform(runs, settle), "")


def _marked_tokens(tokens: Column, marks: Column) -> Column:
    return let(chars(marks), lambda m: F.transform(tokens, lambda t, i: F.struct(t.alias("t"), F.get(m, i).alias("m"), i.alias("i"))))


def remove_words(text: Column | str, lexicon: FillerLexicon = ENGLISH) -> Column:
    """Pairs, then pure fillers, then contextual ones at sentence starts; ``removed`` in the order of the passes."""

    def result(tokens: Column) -> Column:
        def out(m: Column) -> Column:
            pair = lambda x: F.concat_ws(" ", x["t"], F.get(tokens, x["i"] + 1))
            of = lambda s: F.filter(m, lambda x: x["m"] == s)
            word = lambda x: x["t"]
            removed = F.concat(F.transform(of("A"), pair), F.transform(of("p"), word), F.transform(of("x"), word))
            return _result(F.array_join(F.transform(F.filter(m, lambda x: ~x["m"].isin("A", "B", "p", "x")), word), " "), removed)

        return let(_marked_tokens(tokens, _word_marks(tokens, lexicon)), out)

    return F.when(col(text).isNotNull(), let(words(text), result))


def english(text: Column | str) -> Column:
    return remove_words(text, ENGLISH)


def korean(text: Column | str) -> Column:
    return remove_words(text, KOREAN)


def japanese_words(text: Column | str) -> Column:
    return remove_words(text, JAPANESE_WORDS)


def word_spans(text: Column | str, lexicon: FillerLexicon = ENGLISH) -> Column:
    """Spans that ``remove_words`` removes, by start."""

    def spans(parts: Column) -> Column:
        return let(words(text), lambda tokens: let(offsets(parts), lambda sums: placed(parts, tokens, sums)))

    def placed(parts: Column, tokens: Column, sums: Column) -> Column:
        marked = _marked_tokens(tokens, _word_marks(tokens, lexicon))
        hit = F.filter(marked, lambda x: x["m"].isin("A", "p", "x"))

        def span(x: Column) -> Column:
            last = x["i"] + F.when(x["m"] == "A", 1).otherwise(0)
            label = F.when(x["m"] == "A", F.concat_ws(" ", x["t"], F.get(tokens, x["i"] + 1))).otherwise(x["t"])
            return let(piece_span(parts, sums, x["i"], last), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), label.alias("label")))

        return F.transform(hit, span)

    return F.when(col(text).isNotNull(), let(pieces(col(text)), spans))


def _segments(text: Column, comma: str, lexicon: FillerLexicon) -> Column:
    """Fillers that fill a whole segment between commas go; ``removed`` in the order of the passes."""

    def result(segments: Column) -> Column:
        pure, contextual = strings(lexicon.pure), strings(lexicon.contextual)
        state = F.transform(
            segments,
            lambda s, i: let(
                trim(s),
                lambda t: F.struct(s.alias("s"), t.alias("t"), i.alias("i"), F.when(t == "", "e").when(F.array_contains(pure, t), "p").when(F.array_contains(contextual, t), "c").otherwise("k").alias("m")),
            ),
        )

        def out(m: Column) -> Column:
            marks = F.array_join(F.transform(m, lambda x: x["m"]), "")
            lead = F.length(F.regexp_extract(marks, "^[epc]*", 0))
            ended = lambda x: F.coalesce((x["i"] > 0) & (F.get(m, x["i"] - 1)["m"] == "k") & F.get(m, x["i"] - 1)["t"].endswith("。"), F.lit(False))
            early = lambda x: (x["i"] < lead) | ended(x)
            word = lambda x: x["t"]
            contextual_ones = F.filter(m, lambda x: x["m"] == "c")
            removed = F.concat(F.transform(F.filter(m, lambda x: x["m"] == "p"), word), F.transform(F.filter(contextual_ones, early), word), F.transform(F.filter(contextual_ones, lambda x: ~early(x)), word))
            kept = F.array_join(F.transform(F.filter(m, lambda x: x["m"].isin("k", "e")), lambda x: x["s"]), comma)
            return _result(trim(F.regexp_replace(F.regexp_replace(kept, f"^{comma}+", ""), f"{comma}{{2,}}", comma)), removed)

        return let(state, out)

    return F.when(text.isNotNull(), let(F.split(text, comma), result))


def japanese(text: Column | str, lexicon: FillerLexicon = JAPANESE) -> Column:
    return _segments(col(text), "、", lexicon)


def chinese(text: Column | str, lexicon: FillerLexicon = CHINESE) -> Column:
    """Half-width commas become full-width ones, whether or not anything is removed."""
    return _segments(F.translate(col(text), ",", "，"), "，", lexicon)


def segment_spans(text: Column | str, comma: str, lexicon: FillerLexicon) -> Column:
    """Trimmed spans of segments that are fillers; commas other than ``comma`` don't divide."""
    t = col(text)

    def spans(segments: Column) -> Column:
        known = strings((*lexicon.pure, *lexicon.contextual))
        at = F.filter(F.transform(segments, lambda s, i: F.struct(s.alias("s"), trim(s).alias("t"), i.alias("i"))), lambda x: F.array_contains(known, x["t"]))

        def span(x: Column) -> Column:
            before = F.when(x["i"] == 0, 0).otherwise(F.length(F.array_join(F.slice(segments, F.lit(1), x["i"]), comma)) + 1)
            start = before + F.length(F.regexp_extract(x["s"], r"(?U)^\s*", 0))
            return F.struct(start.cast("int").alias("start"), (start + F.length(x["t"])).cast("int").alias("end"), x["t"].alias("label"))

        return F.transform(at, span)

    return F.when(t.isNotNull(), let(F.split(t, comma), spans))


def japanese_spans(text: Column | str) -> Column:
    return segment_spans(text, "、", JAPANESE)


def chinese_spans(text: Column | str) -> Column:
    return segment_spans(text, "，", CHINESE)


def _spanish_marks(tokens: Column, lexicon: FillerLexicon) -> Column:
    """A symbol a token: A B a phrase, D E a repeated pair, r a repetition, a an abandoned word, p pure, k kept."""
    low = F.transform(tokens, F.lower)

    def marked(w: Column) -> Column:
        n = lambda i: F.length(F.get(w, i))
        starts = flags(w, lambda x, i: F.when(_pair_at(x, F.get(w, i + 1), lexicon), "1").otherwise("0"))
        phrases = chars(F.regexp_replace(starts, "1[01]", "AB"))

        def after_phrases(m: Column) -> Column:
            free = lambda i: ~F.get(m, i).isin("A", "B")
            doubled = flags(
                w,
                lambda x, i: F.when(
                    F.coalesce(free(i) & free(i + 1) & free(i + 2) & free(i + 3) & (x == F.get(w, i + 2)) & (F.get(w, i + 1) == F.get(w, i + 3)) & (n(i) + n(i + 1) >= 3), F.lit(False)), "1"
                ).otherwise("0"),
            )
            pairs = chars(F.regexp_replace(doubled, "1[01]", "DE"))
            both = F.zip_with(m, pairs, lambda a, b: F.when(a.isin("A", "B"), a).when(b.isin("D", "E"), b).otherwise("k"))
            return let(both, after_pairs)

        def after_pairs(m: Column) -> Column:
            open_ = lambda i: F.get(m, i) == "k"
            again = F.transform(m, lambda s, i: F.when(F.coalesce((s == "k") & open_(i + 1) & (F.get(w, i) == F.get(w, i + 1)) & (n(i) >= 2), F.lit(False)), "r").otherwise(s))
            return let(again, after_repeats)

        def after_repeats(m: Column) -> Column:
            stop = strings(lexicon.stop)
            left = F.transform(
                m,
                lambda s, i: F.when(
                    F.coalesce((s == "k") & (F.get(m, i + 1) == "k") & (n(i) >= 2) & (n(i + 1) >= n(i) + 2) & F.get(w, i + 1).startswith(F.get(w, i)) & ~F.array_contains(stop, F.get(w, i)), F.lit(False)), "a"
                ).otherwise(s),
            )
            return F.array_join(F.zip_with(left, w, lambda s, x: F.when((s == "k") & x.isin(*lexicon.pure), "p").otherwise(s)), "")

        return let(phrases, after_phrases)

    return let(low, marked)


def spanish(text: Column | str, lexicon: FillerLexicon = SPANISH) -> Column:
    """Phrases, repeated pairs, repetitions, abandoned words, pure fillers; ``removed`` in text order."""

    def result(tokens: Column) -> Column:
        def out(m: Column) -> Column:
            gone = F.filter(m, lambda x: x["m"].isin("A", "D", "r", "a", "p"))
            label = lambda x: F.when(x["m"].isin("A", "D"), F.concat_ws(" ", x["t"], F.get(tokens, x["i"] + 1))).otherwise(x["t"])
            return _result(F.array_join(F.transform(F.filter(m, lambda x: x["m"] == "k"), lambda x: x["t"]), " "), F.transform(gone, label))

        return let(_marked_tokens(tokens, _spanish_marks(tokens, lexicon)), out)

    return F.when(col(text).isNotNull(), let(words(text), result))


def spanish_spans(text: Column | str, lexicon: FillerLexicon = SPANISH) -> Column:
    """Spans that ``spanish`` removes, with the category (rep2, rep, partial, or the filler) as label."""

    def spans(parts: Column) -> Column:
        return let(words(text), lambda tokens: let(offsets(parts), lambda sums: placed(parts, tokens, sums)))

    def placed(parts: Column, tokens: Column, sums: Column) -> Column:
        gone = F.filter(_marked_tokens(tokens, _spanish_marks(tokens, lexicon)), lambda x: x["m"].isin("A", "D", "r", "a", "p"))

        def span(x: Column) -> Column:
            last = x["i"] + F.when(x["m"].isin("A", "D"), 1).otherwise(0)
            surface = F.lower(F.when(x["m"].isin("A", "D"), F.concat_ws(" ", x["t"], F.get(tokens, x["i"] + 1))).otherwise(x["t"]))
            label = F.when(x["m"] == "D", F.concat(F.lit("rep2:"), surface)).when(x["m"] == "r", F.concat(F.lit("rep:"), surface)).when(x["m"] == "a", F.concat(F.lit("partial:"), surface)).otherwise(surface)
            return let(piece_span(parts, sums, x["i"], last), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), label.alias("label")))

        return F.transform(gone, span)

    return F.when(col(text).isNotNull(), let(pieces(col(text)), spans))


FILTERS = {"en": english, "ko": korean, "ja": japanese, "zh": chinese, "es": spanish}


def by_language(text: Column | str, lang: Column | str) -> Column:
    """The filter of the row's language; other languages keep their text."""
    t, key = col(text), col(lang)
    out = F.struct(t.alias("text"), F.array().cast("array<string>").alias("removed"))
    for name, f in FILTERS.items():
        out = F.when(key == name, f(t)).otherwise(out)
    return out
