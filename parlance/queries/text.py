"""Text queries.  The tables' prose has few disfluencies, so they are put in by position and doc_id; texts stay whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions import lexicon as lx
from parlance.functions import numerals, text, vectors
from parlance.operators import corrections, embedded, fillers, labels, polish
from parlance.plans import pipeline
from parlance.queries.registry import query, quoted, spark_quoted, sql_list, table

# by (position + doc_id) % 23: what stands for a word w
NOISE = {
    "en": {0: ("um ", ""), 5: ("you know ", ""), 9: ("Well, ", ""), 13: ("", " uh..."), 17: ("so basically ", ""), 20: ("", ".")},
    "ko": {0: ("음 ", ""), 5: ("그게 그러니까 ", ""), 9: ("그래서 ", ""), 13: ("", " 어,"), 17: ("뭐 약간 ", ""), 20: ("", "?")},
    "jw": {0: ("えーと ", ""), 5: ("なんて いうか ", ""), 9: ("あの, ", ""), 13: ("", " うん."), 17: ("まあ ほら ", ""), 20: ("", "?")},
    "es": {0: ("eh ", ""), 5: ("O sea ", ""), 9: ("para para ", ""), 13: ("casa ver casa ver ", ""), 17: ("pro proyecto ", ""), 20: ("hmm oh ", "")},
}
SEGMENTS = {
    "ja": ("えーと", "あの", "今日は天気です。", " まあ ", "会議を始めます", "", "映像", "なんか", "明日は休みです。", "その"),
    "zh": ("嗯", "那个", "今天开会。", " 就是 ", "我们,走吧", "", "呃", "然后", "明天休息。", "怎么说"),
}


def noisy(lang: str):
    """The text with single blanks and disfluencies, as a Column."""
    cases = " ".join(f"WHEN {m} THEN concat('{a}', w, '{b}')" for m, (a, b) in NOISE[lang].items())
    return F.expr(f"array_join(transform(split(trim(regexp_replace(text, '\\\\s+', ' ')), ' '), (w, i) -> CASE pmod(i + doc_id, 23) {cases} ELSE w END), ' ')")


def noisy_sql(lang: str) -> str:
    cases = " ".join(f"WHEN {m} THEN concat('{a}', w, '{b}')" for m, (a, b) in NOISE[lang].items())
    return f"array_to_string(list_transform(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda w, i: CASE (i - 1 + doc_id) % 23 {cases} ELSE w END), ' ')"


def segmented(lang: str):
    comma = "、" if lang == "ja" else "，"
    values = quoted(SEGMENTS[lang])
    return F.expr(f"array_join(transform(sequence(0, cast(2 + doc_id % 7 as int)), i -> element_at(array({values}), cast((doc_id * 7 + i * (3 + doc_id % 4)) % 10 + 1 as int))), '{comma}')")


def segmented_sql(lang: str) -> str:
    comma = "、" if lang == "ja" else "，"
    return f"array_to_string(list_transform(range(0, 3 + doc_id % 7), lambda i: {sql_list(SEGMENTS[lang])}[((doc_id * 7 + i * (3 + doc_id % 4)) % 10 + 1)::int]), '{comma}')"


def docs_with(spark, sf_dir: str, column, name: str = "t") -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", column.alias(name))


# ---- fillers ----

def word_rows_sql(lang: str, lex: lx.FillerLexicon) -> str:
    """tokens(doc_id, i, w, k, s, e): k is A, B, p, x or k; s and e the place, as blanks are single."""
    pairs = " OR ".join(f"(c = '{a}' AND lead(c) OVER d = '{b}')" for a, b in lex.pairs)
    return f"""
WITH src AS (SELECT doc_id, {noisy_sql(lang)} AS t FROM documents),
tok AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM (SELECT doc_id, string_split(t, ' ') AS ws FROM src)),
cln AS (SELECT *, regexp_extract(lower(w), '^[\\p{{L}}\\p{{N}}]*') AS c, coalesce(sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM tok),
st AS (SELECT *, ({pairs}) AS a FROM cln WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
prs AS (SELECT *, CASE WHEN a THEN 'A' WHEN coalesce(lag(a) OVER (PARTITION BY doc_id ORDER BY i), false) THEN 'B' WHEN c IN ({quoted(lex.pure)}) THEN 'p' WHEN c IN ({quoted(lex.contextual)}) THEN 'c' ELSE 'k' END AS k0, regexp_matches(w, '[.!?,]$') AS term FROM st),
anc AS (SELECT *, sum((k0 = 'k')::int) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM prs),
fin AS (SELECT *, CASE WHEN k0 <> 'c' THEN k0 WHEN run = 0 OR bool_or(k0 = 'k' AND term) OVER (PARTITION BY doc_id, run) OR coalesce(sum((k0 = 'c' AND term)::int) OVER (PARTITION BY doc_id, run ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 THEN 'x' ELSE 'k' END AS k,
  w || ' ' || lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS two, (s + length(w) + 1 + length(lead(w) OVER (PARTITION BY doc_id ORDER BY i)))::int AS e2 FROM anc)
"""


def word_filter_sql(lang: str, lex: lx.FillerLexicon) -> str:
    return word_rows_sql(lang, lex) + """
SELECT doc_id, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (k = 'k'), '') AS text,
  coalesce(string_agg(CASE WHEN k = 'A' THEN two ELSE w END, '|' ORDER BY CASE k WHEN 'A' THEN 1 WHEN 'p' THEN 2 ELSE 3 END, i) FILTER (k IN ('A', 'p', 'x')), '') AS removed
FROM fin GROUP BY doc_id"""


def word_span_sql(lang: str, lex: lx.FillerLexicon) -> str:
    return word_rows_sql(lang, lex) + """
SELECT doc_id, s::int AS start, CASE WHEN k = 'A' THEN e2 ELSE (s + length(w))::int END AS "end", CASE WHEN k = 'A' THEN two ELSE w END AS label FROM fin WHERE k IN ('A', 'p', 'x')"""


def shown(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "r.text", F.array_join("r.removed", "|").alias("removed"))


def span_rows(df: DataFrame) -> DataFrame:
    # an inner explode of a column makes Spark filter by its size first, where the table is read: all spans are computed there as well, twice
    return df.select("doc_id", F.explode_outer("r").alias("s")).where("s is not null").select("doc_id", "s.start", "s.end", "s.label")


@query(word_filter_sql("en", lx.ENGLISH))
def filler_en(spark, sf):
    return shown(docs_with(spark, sf, noisy("en")).select("doc_id", fillers.english("t").alias("r")))


# a spoken form's vector: its filler's, and more or less of another by its length
PLACE = f"list_position({sql_list(lx.ENGLISH.pure)}, c) - 1"
VECTOR_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"


@query(f"""WITH src AS (SELECT doc_id, {noisy_sql('en')} AS t FROM documents),
tok AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM (SELECT doc_id, string_split(t, ' ') AS ws FROM src)),
cln AS (SELECT *, regexp_extract(lower(w), '^[\\p{{L}}\\p{{N}}]*') AS c FROM tok),
u AS (SELECT vec_id, list_transform(embedding, lambda x: x::double / sqrt({VECTOR_DOT.format(a='embedding::double[]', b='embedding::double[]')})) AS e FROM embeddings WHERE vec_id < 16),
raw AS (SELECT DISTINCT w, {PLACE} AS k, 8 + length(w) % 8 AS m, 0.3 * (length(w) % 4) AS a FROM cln WHERE c IN ({quoted(lx.ENGLISH.pure)})),
mixed AS (SELECT w, list_transform(list_zip(x.e, y.e), lambda z: z[1] + a * z[2]) AS v FROM raw JOIN u x ON x.vec_id = k JOIN u y ON y.vec_id = m),
near AS (SELECT w FROM mixed JOIN u l ON l.vec_id < 8 GROUP BY w, v HAVING max({VECTOR_DOT.format(a='v', b='l.e')} / sqrt({VECTOR_DOT.format(a='v', b='v')})) >= 0.82),
prs AS (SELECT *, CASE WHEN w IN (SELECT w FROM near) THEN 'p' WHEN c IN ({quoted(lx.ENGLISH.contextual)}) THEN 'c' ELSE 'k' END AS k0, regexp_matches(w, '[.!?,]$') AS term FROM cln),
anc AS (SELECT *, sum((k0 = 'k')::int) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM prs),
fin AS (SELECT *, CASE WHEN k0 <> 'c' THEN k0 WHEN run = 0 OR bool_or(k0 = 'k' AND term) OVER (PARTITION BY doc_id, run) OR coalesce(sum((k0 = 'c' AND term)::int) OVER (PARTITION BY doc_id, run ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 THEN 'x' ELSE 'k' END AS k FROM anc)
SELECT doc_id, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (k = 'k'), '') AS text, coalesce(string_agg(w, '|' ORDER BY k, i) FILTER (k IN ('p', 'x')), '') AS removed FROM fin GROUP BY doc_id""")
def filler_vectors(spark, sf):
    """English fillers by the likeness of each spelling's vector, made of the table's first sixteen, to those of the lexicon."""
    docs = docs_with(spark, sf, noisy("en")).select(F.col("doc_id").alias("utt_id"), F.col("t").alias("text"))
    unit = table(spark, sf, "embeddings").where("vec_id < 16").select("vec_id", vectors.l2_normalise(F.transform("embedding", lambda x: x.cast("double"))).alias("e"))
    place = F.array_position(text.strings(lx.ENGLISH.pure), text.clean(F.col("word"))) - 1
    raw = docs.select(F.explode(text.words("text")).alias("word")).distinct().where(place >= 0)
    raw = raw.select("word", place.alias("k"), (8 + F.length("word") % 8).alias("m"), (0.3 * (F.length("word") % 4)).alias("a"))
    mixed = raw.join(unit.select(F.col("vec_id").alias("k"), F.col("e").alias("x")), "k").join(unit.select(F.col("vec_id").alias("m"), F.col("e").alias("y")), "m")
    spoken = mixed.select("word", vectors.l2_normalise(F.transform(F.arrays_zip("x", "y"), lambda z: z["x"] + F.col("a") * z["y"])).alias("vector"))
    names = spark.range(len(lx.ENGLISH.pure)).select(F.col("id").alias("vec_id"), F.get(text.strings(lx.ENGLISH.pure), F.col("id").cast("int")).alias("word"))
    own = names.join(unit, "vec_id").select("word", F.col("e").alias("vector"))
    got = embedded.by_vectors(docs, spoken, own)
    return got.select(F.col("utt_id").alias("doc_id"), "text", F.array_join("removed", "|").alias("removed"))


@query(word_filter_sql("ko", lx.KOREAN))
def filler_ko(spark, sf):
    return shown(docs_with(spark, sf, noisy("ko")).select("doc_id", fillers.korean("t").alias("r")))


@query(word_filter_sql("jw", lx.JAPANESE_WORDS))
def filler_ja_words(spark, sf):
    """Japanese fillers between blanks."""
    return shown(docs_with(spark, sf, noisy("jw")).select("doc_id", fillers.japanese_words("t").alias("r")))


@query(word_span_sql("en", lx.ENGLISH))
def spans_en(spark, sf):
    return span_rows(docs_with(spark, sf, noisy("en")).select("doc_id", fillers.word_spans("t", lx.ENGLISH).alias("r")))


@query(word_span_sql("ko", lx.KOREAN))
def spans_ko(spark, sf):
    return span_rows(docs_with(spark, sf, noisy("ko")).select("doc_id", fillers.word_spans("t", lx.KOREAN).alias("r")))


def segment_sql(lang: str, lex: lx.FillerLexicon) -> str:
    comma = "、" if lang == "ja" else "，"
    source = segmented_sql(lang) if lang == "ja" else f"replace({segmented_sql(lang)}, ',', '，')"
    return f"""
WITH src AS (SELECT doc_id, string_split({source}, '{comma}') AS ss FROM documents),
seg AS (SELECT doc_id, generate_subscripts(ss, 1) AS i, unnest(ss) AS s FROM src),
kind AS (SELECT *, trim(s) AS t, CASE WHEN trim(s) = '' THEN 'e' WHEN trim(s) IN ({quoted(lex.pure)}) THEN 'p' WHEN trim(s) IN ({quoted(lex.contextual)}) THEN 'c' ELSE 'k' END AS k FROM seg),
early AS (SELECT *, coalesce(bool_and(k <> 'k') OVER (PARTITION BY doc_id ORDER BY i), true) OR coalesce(lag(k = 'k' AND t LIKE '%。') OVER (PARTITION BY doc_id ORDER BY i), false) AS first FROM kind)
SELECT doc_id, trim(regexp_replace(regexp_replace(coalesce(string_agg(s, '{comma}' ORDER BY i) FILTER (k IN ('k', 'e')), ''), '^{comma}+', ''), '{comma}{{2,}}', '{comma}', 'g')) AS text,
  coalesce(string_agg(t, '|' ORDER BY CASE WHEN k = 'p' THEN 1 WHEN first THEN 2 ELSE 3 END, i) FILTER (k IN ('p', 'c')), '') AS removed
FROM early GROUP BY doc_id"""


@query(segment_sql("ja", lx.JAPANESE))
def filler_ja(spark, sf):
    return shown(docs_with(spark, sf, segmented("ja")).select("doc_id", fillers.japanese("t").alias("r")))


@query(segment_sql("zh", lx.CHINESE))
def filler_zh(spark, sf):
    return shown(docs_with(spark, sf, segmented("zh")).select("doc_id", fillers.chinese("t").alias("r")))


def segment_span_sql(lang: str, lex: lx.FillerLexicon) -> str:
    comma = "、" if lang == "ja" else "，"
    return f"""
WITH src AS (SELECT doc_id, string_split({segmented_sql(lang)}, '{comma}') AS ss FROM documents),
seg AS (SELECT doc_id, generate_subscripts(ss, 1) AS i, unnest(ss) AS s FROM src),
pos AS (SELECT *, coalesce(sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(s) - length(ltrim(s)) AS a FROM seg)
SELECT doc_id, a::int AS start, (a + length(trim(s)))::int AS "end", trim(s) AS label FROM pos WHERE trim(s) IN ({quoted((*lex.pure, *lex.contextual))})"""


@query(segment_span_sql("ja", lx.JAPANESE))
def spans_ja(spark, sf):
    return span_rows(docs_with(spark, sf, segmented("ja")).select("doc_id", fillers.japanese_spans("t").alias("r")))


@query(segment_span_sql("zh", lx.CHINESE))
def spans_zh(spark, sf):
    return span_rows(docs_with(spark, sf, segmented("zh")).select("doc_id", fillers.chinese_spans("t").alias("r")))


SPANISH_ROWS = f"""
WITH src AS (SELECT doc_id, {noisy_sql('es')} AS t FROM documents),
tok AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM (SELECT doc_id, string_split(t, ' ') AS ws FROM src)),
low AS (SELECT *, lower(w) AS l, length(lower(w)) AS n, coalesce(sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM tok),
p1 AS (SELECT *, coalesce(l = 'o' AND lead(l) OVER d = 'sea', false) AS a FROM low WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
m1 AS (SELECT *, CASE WHEN a THEN 'A' WHEN coalesce(lag(a) OVER d, false) THEN 'B' ELSE 'k' END AS k1 FROM p1 WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
e2 AS (SELECT *, coalesce(k1 = 'k' AND lead(k1, 1) OVER d = 'k' AND lead(k1, 2) OVER d = 'k' AND lead(k1, 3) OVER d = 'k' AND l = lead(l, 2) OVER d AND lead(l, 1) OVER d = lead(l, 3) OVER d AND n + lead(n, 1) OVER d >= 3, false) AS d2 FROM m1 WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
g2 AS (SELECT *, CASE WHEN d2 THEN (row_number() OVER (PARTITION BY doc_id, d2, grp ORDER BY i) - 1) % 2 = 0 ELSE false END AS take FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, d2 ORDER BY i) AS grp FROM e2)),
m2 AS (SELECT *, CASE WHEN k1 <> 'k' THEN k1 WHEN take THEN 'D' WHEN coalesce(lag(take) OVER d, false) THEN 'E' ELSE 'k' END AS k2 FROM g2 WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
m3 AS (SELECT *, CASE WHEN coalesce(k2 = 'k' AND lead(k2) OVER d = 'k' AND l = lead(l) OVER d AND n >= 2, false) THEN 'r' ELSE k2 END AS k3 FROM m2 WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
m4 AS (SELECT *, CASE WHEN coalesce(k3 = 'k' AND lead(k3) OVER d = 'k' AND n >= 2 AND lead(n) OVER d >= n + 2 AND starts_with(lead(l) OVER d, l) AND l NOT IN ({quoted(lx.SPANISH.stop)}), false) THEN 'a' ELSE k3 END AS k4 FROM m3 WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
fin AS (SELECT *, CASE WHEN k4 = 'k' AND l IN ({quoted(lx.SPANISH.pure)}) THEN 'p' ELSE k4 END AS k, w || ' ' || lead(w) OVER d AS two, (s + n + 1 + lead(n) OVER d)::int AS e2 FROM m4 WINDOW d AS (PARTITION BY doc_id ORDER BY i))
"""
SPANISH_LABEL = "CASE k WHEN 'A' THEN lower(two) WHEN 'D' THEN 'rep2:' || lower(two) WHEN 'r' THEN 'rep:' || l WHEN 'a' THEN 'partial:' || l ELSE l END"


@query(SPANISH_ROWS + """SELECT doc_id, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (k = 'k'), '') AS text,
  coalesce(string_agg(CASE WHEN k IN ('A', 'D') THEN two ELSE w END, '|' ORDER BY i) FILTER (k IN ('A', 'D', 'r', 'a', 'p')), '') AS removed FROM fin GROUP BY doc_id""")
def filler_es(spark, sf):
    return shown(docs_with(spark, sf, noisy("es")).select("doc_id", fillers.spanish("t").alias("r")))


@query(SPANISH_ROWS + f"""SELECT doc_id, s::int AS start, CASE WHEN k IN ('A', 'D') THEN e2 ELSE (s + length(w))::int END AS "end", {SPANISH_LABEL} AS label FROM fin WHERE k IN ('A', 'D', 'r', 'a', 'p')""")
def spans_es(spark, sf):
    return span_rows(docs_with(spark, sf, noisy("es")).select("doc_id", fillers.spanish_spans("t").alias("r")))


@query(SPANISH_ROWS + f"SELECT {SPANISH_LABEL} AS label, count(*) AS n FROM fin WHERE k IN ('A', 'D', 'r', 'a', 'p') GROUP BY 1")
def filler_label_histogram(spark, sf):
    return spans_es(spark, sf).groupBy("label").agg(F.count("*").alias("n"))


@query(f"""SELECT d.doc_id, d.lang, CASE d.lang WHEN 'en' THEN e.text WHEN 'es' THEN s.text ELSE trim(regexp_replace(d.text, '\\s+', ' ', 'g')) END AS text
FROM documents d JOIN ({word_filter_sql('en', lx.ENGLISH)}) e USING (doc_id) JOIN ({SPANISH_ROWS} SELECT doc_id, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (k = 'k'), '') AS text FROM fin GROUP BY doc_id) s USING (doc_id)""")
def filler_chain_by_lang(spark, sf):
    plain = F.trim(F.regexp_replace("text", r"\s+", " "))
    t = F.when(F.col("lang") == "en", noisy("en")).when(F.col("lang") == "es", noisy("es")).otherwise(plain)
    return docs_with(spark, sf, t).select("doc_id", "lang", fillers.by_language("t", "lang")["text"].alias("text"))


# ---- self-corrections ----

# by doc_id % 6: what follows the word at place 3 + doc_id % 9; {w} is that word
REPAIRS = {
    "en": (" no wait {w}", " i mean {w} then", " or rather not", " sorry, {w}", " actually {w}", ""),
    "es": (" no, {w}", ", mejor dicho, {w} hoy", " perdón otra", ". Digo {w}", " o sea {w}", ""),
}


def repaired(lang: str):
    cases = " ".join("WHEN {} THEN concat(w, replace('{}', '{{w}}', w))".format(n, s.replace("'", "")) for n, s in enumerate(REPAIRS[lang]))
    return F.expr(f"array_join(transform(split(trim(regexp_replace(text, '\\\\s+', ' ')), ' '), (w, i) -> CASE WHEN i = 3 + doc_id % 9 THEN CASE doc_id % 6 {cases} END ELSE w END), ' ')")


def repaired_sql(lang: str) -> str:
    cases = " ".join("WHEN {} THEN concat(w, replace('{}', '{{w}}', w))".format(n, s) for n, s in enumerate(REPAIRS[lang]))
    return f"array_to_string(list_transform(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda w, i: CASE WHEN i - 1 = 3 + doc_id % 9 THEN CASE doc_id % 6 {cases} END ELSE w END), ' ')"


def overlap_sql(found: str) -> str:
    """From (doc_id, t, cue, rank, before, after): the first hit of each document."""
    return f"""
, wrd AS (SELECT *, list_filter(regexp_split_to_array(before, '\\s+'), lambda x: x <> '') AS b, list_filter(regexp_split_to_array(after, '\\s+'), lambda x: x <> '') AS a FROM {found}),
ovl AS (SELECT *, coalesce(list_max(list_filter([1, 2, 3, 4, 5], lambda k: k <= len(b) AND k <= len(a) AND lower(b[len(b) - k + 1]) = lower(a[1]))), 0) AS k FROM wrd),
hit AS (SELECT *, CASE WHEN len(b) > k THEN array_to_string(b[1:len(b) - k], ' ') || ' ' || after ELSE after END AS out, array_to_string(b[len(b) - k + 1:], ' ') || ' ' || cue AS gone
  FROM ovl WHERE k > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY rank) = 1)
"""


EN_CUES = "(SELECT unnest(range(1, 9)) AS rank, unnest(" + sql_list(lx.cues("en")) + ") AS cue)"
ENGLISH_SQL = f"""
WITH src AS (SELECT doc_id, {repaired_sql('en')} AS t FROM documents),
cue AS (SELECT doc_id, t, cue, rank, strpos(lower(t), cue) AS p FROM src, {EN_CUES}),
fnd AS (SELECT *, regexp_replace(substr(t, 1, p - 1), '\\s+$', '') AS before, regexp_replace(substr(t, p + length(cue)), '^\\s+', '') AS after FROM cue WHERE p > 0)
{overlap_sql('fnd')}
SELECT s.doc_id, coalesce(h.out, s.t) AS text, h.gone AS original FROM src s LEFT JOIN hit h USING (doc_id)"""
ES_CUES = "(SELECT unnest(range(1, 9)) AS cr, unnest(" + sql_list(lx.cues("es")) + ") AS cue)"
SPANISH_SQL = f"""
WITH src AS (SELECT doc_id, {repaired_sql('es')} AS t FROM documents),
cut AS (SELECT doc_id, t, cue, cr, string_split(lower(t), cue) AS ps FROM src, {ES_CUES} WHERE contains(lower(t), cue)),
prt AS (SELECT doc_id, t, cue, cr, len(ps) AS np, generate_subscripts(ps, 1) AS j, unnest(ps) AS q FROM cut),
pos AS (SELECT *, sum(length(q)) OVER (PARTITION BY doc_id, cr ORDER BY j) + (j - 1) * length(cue) AS p FROM prt),
occ AS (SELECT *, cr * 1000000 + j AS rank FROM pos WHERE j < np AND NOT regexp_matches(coalesce(substr(lower(t), p::int, 1), ''), '[a-z]') AND NOT regexp_matches(substr(lower(t), (p + length(cue) + 1)::int, 1), '[a-z]')),
fnd AS (SELECT doc_id, t, cue, rank, regexp_replace(substr(t, 1, p::int), '[,.;:!? \\t]+$', '') AS before, regexp_replace(substr(t, (p + length(cue) + 1)::int), '^[,.;:!? \\t]+', '') AS after FROM occ)
{overlap_sql("(SELECT * FROM fnd WHERE before <> '' AND after <> '')")}
SELECT s.doc_id, coalesce(h.out, s.t) AS text, h.gone AS original FROM src s LEFT JOIN hit h USING (doc_id)"""


def correction(df: DataFrame, f) -> DataFrame:
    return df.select("doc_id", "t", f("t").alias("r")).select("doc_id", F.coalesce("r.text", "t").alias("text"), "r.original")


@query(ENGLISH_SQL)
def selfcorr_en(spark, sf):
    return correction(docs_with(spark, sf, repaired("en")), corrections.english)


@query(SPANISH_SQL)
def selfcorr_es(spark, sf):
    return correction(docs_with(spark, sf, repaired("es")), corrections.spanish)


CUED = {
    "ja": (("明日", "会議", "鈴木課長", "資料"), ("いや", "じゃなくて", "っていうか", "ではなく"), ("、", "", "、 ")),
    "zh": (("明天", "开会", "张经理", "资料"), ("不对", "不是", "我的意思是", "算了"), ("，", "", "、")),
    "ko": (("내일", "회의", "김 과장", "자료"), ("아니", "아니라", "그게 아니고", "잠깐만"), (", ", " ", "")),
}


def _cued(lang: str, list_: str, at: str) -> str:
    words, cue, joints = CUED[lang]
    pick = lambda values, e: f"{list_.format(quoted(values))}{at.format(f'({e}) % {len(values)} + 1')}"
    return f"concat({pick(words, 'doc_id')}, {pick(joints, 'doc_id')}, {pick(words, 'doc_id + 1')}, {pick(joints, 'doc_id + 1')}, {pick(cue, 'doc_id * 5 + 2')}, {pick(joints, 'doc_id + 2')}, {pick(words, 'doc_id + 2')}, '요', {pick((cue[0], '', ''), 'doc_id')})"


def cued(lang: str):
    return F.expr(_cued(lang, "array({})", "[cast({} - 1 as int)]"))


def cued_sql(lang: str) -> str:
    return _cued(lang, "[{}]", "[({})::int]")


def cut_sql(lang: str, trim: str, split: str, joint: str) -> str:
    n = len(lx.CUES[lang])
    return f"""
WITH src AS (SELECT doc_id, {cued_sql(lang)} AS t FROM documents),
cue AS (SELECT doc_id, t, cue, rank, strpos(t, cue) AS p FROM src, (SELECT unnest(range(1, {n + 1})) AS rank, unnest({sql_list(lx.cues(lang))}) AS cue)),
fnd AS (SELECT *, regexp_replace(regexp_replace(substr(t, 1, p - 1), '{trim}+$', ''), '\\s+$', '') AS before, regexp_replace(regexp_replace(substr(t, p + length(cue)), '^{trim}+', ''), '^\\s+', '') AS after FROM cue WHERE p > 0),
hit AS (SELECT *, regexp_split_to_array(before, '{split}') AS ss FROM fnd WHERE before <> '' AND after <> '' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY rank) = 1)
SELECT s.doc_id, CASE WHEN h.doc_id IS NULL THEN s.t WHEN array_to_string(ss[1:len(ss) - 1], '{joint}') = '' THEN after ELSE array_to_string(ss[1:len(ss) - 1], '{joint}') || '{joint}' || after END AS text, trim(ss[len(ss)]) || cue AS original
FROM src s LEFT JOIN hit h USING (doc_id)"""


@query(cut_sql("ja", "、", "、", "、"))
def selfcorr_ja(spark, sf):
    return correction(docs_with(spark, sf, cued("ja")), corrections.japanese)


@query(cut_sql("zh", "[、，, ]", "[、，]", "，"))
def selfcorr_zh(spark, sf):
    return correction(docs_with(spark, sf, cued("zh")), corrections.chinese)


KO_SQL = f"""
WITH src AS (SELECT doc_id, {cued_sql('ko')} AS t FROM documents),
cut AS (SELECT doc_id, t, cue, cr, string_split(t, cue) AS ps FROM src, (SELECT unnest(range(1, {len(lx.CUES['ko']) + 1})) AS cr, unnest({sql_list(lx.cues('ko'))}) AS cue) WHERE contains(t, cue)),
prt AS (SELECT doc_id, t, cue, cr, len(ps) AS np, generate_subscripts(ps, 1) AS j, unnest(ps) AS q FROM cut),
pos AS (SELECT *, sum(length(q)) OVER (PARTITION BY doc_id, cr ORDER BY j) + (j - 1) * length(cue) AS p FROM prt),
occ AS (SELECT *, cr * 1000 + j AS rank FROM pos WHERE j < np AND (p = 0 OR NOT regexp_matches(substr(t, p::int, 1), '[\\p{{L}}\\p{{N}}]')) AND NOT regexp_matches(substr(t, (p + length(cue) + 1)::int, 1), '[\\p{{L}}\\p{{N}}]')),
fnd AS (SELECT doc_id, t, cue, rank, regexp_replace(substr(t, 1, p::int), '[,.;:!? \\t]+$', '') AS before, regexp_replace(substr(t, (p + length(cue) + 1)::int), '^[,.;:!? \\t]+', '') AS after FROM occ),
hit AS (SELECT *, regexp_split_to_array(before, '[,.!?;]') AS ss FROM fnd WHERE before <> '' AND after <> '' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY rank) = 1)
SELECT s.doc_id, CASE WHEN h.doc_id IS NULL THEN s.t WHEN array_to_string(ss[1:len(ss) - 1], ',') = '' THEN after ELSE array_to_string(ss[1:len(ss) - 1], ',') || ', ' || after END AS text, trim(ss[len(ss)]) || ' ' || cue AS original
FROM src s LEFT JOIN hit h USING (doc_id)"""


@query(KO_SQL)
def selfcorr_ko(spark, sf):
    return correction(docs_with(spark, sf, cued("ko")), corrections.korean)


def dispatch_sql() -> str:
    """Each language's own texts: by doc_id % 5."""
    parts = {0: KO_SQL, 1: cut_sql("zh", "[、，, ]", "[、，]", "，"), 2: cut_sql("ja", "、", "、", "、"), 3: SPANISH_SQL, 4: ENGLISH_SQL}
    return " UNION ALL ".join(f"SELECT doc_id, text, original FROM ({q}) WHERE doc_id % 5 = {n}" for n, q in parts.items())


@query(dispatch_sql())
def selfcorr_dispatch(spark, sf):
    five = F.col("doc_id") % 5
    t, lang = cued("ko"), F.lit("ko")
    for n, (name, c) in enumerate((("zh", cued("zh")), ("ja", cued("ja")), ("es", repaired("es")), ("en", repaired("en"))), 1):
        t, lang = F.when(five == n, c).otherwise(t), F.when(five == n, name).otherwise(lang)
    df = table(spark, sf, "documents").select("doc_id", t.alias("t"), lang.alias("lang"))
    return df.select("doc_id", corrections.remove("t", "lang").alias("r")).select("doc_id", "r.text", "r.original")


@query(f"""WITH src AS (SELECT doc_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM documents)
SELECT doc_id, coalesce(list_max(list_filter([1, 2, 3, 4, 5], lambda k: k <= len(w) AND lower(w[len(w) - k + 1]) = lower(w[greatest(len(w) - (doc_id % 4), 1)::int]))), 0)::int AS k FROM src""")
def overlap_len(spark, sf):
    """The words of a text against its last ones, from one of the last four on."""
    df = table(spark, sf, "documents").select("doc_id", F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ").alias("w"))
    after = F.concat(F.slice("w", F.greatest(F.size("w") - F.col("doc_id") % 4, F.lit(1)).cast("int"), F.lit(1)), F.array_repeat(F.lit("x"), 5))
    return df.select("doc_id", corrections.overlap(F.col("w"), after).cast("int").alias("k"))


@query("""WITH ab AS (SELECT doc_id, string_split(text, '') AS a, string_split(substr(text, 1, length(text) // 3) || substr(text, length(text) // 2 + 1), '') AS b FROM documents),
r AS (SELECT doc_id, a, b, list_reverse(a) AS ra, list_reverse(b) AS rb FROM ab),
s AS (SELECT *, list_filter(range(0, len(b) + 1), lambda i: i = len(b) OR ra[i + 1] <> rb[i + 1])[1] AS suffix FROM r),
p AS (SELECT *, list_filter(range(0, len(b) - suffix + 1), lambda i: i = len(b) - suffix OR a[i + 1] <> b[i + 1])[1] AS prefix FROM s)
SELECT doc_id, CASE WHEN prefix < len(a) - suffix THEN prefix::int END AS start, CASE WHEN prefix < len(a) - suffix THEN (len(a) - suffix)::int END AS "end" FROM p""")
def diff_span(spark, sf):
    b = F.concat(F.substring("text", F.lit(1), F.floor(F.length("text") / 3).cast("int")), F.substring("text", F.floor(F.length("text") / 2).cast("int") + 1, F.length("text")))
    df = table(spark, sf, "documents").select("doc_id", "text", b.alias("b"))
    return df.select("doc_id", corrections.diff_span("text", "b").alias("s")).select("doc_id", "s.start", "s.end")


SEP_CLASS = "[\\s" + lx.SEPARATORS.replace("?", "\\?").replace(".", "\\.") + "]+$"


@query(f"""WITH src AS (SELECT doc_id, {cued_sql('ja')} || '、 ' AS t FROM documents),
bare AS (SELECT doc_id, t, regexp_replace(t, '{SEP_CLASS}', '') AS b FROM src),
hit AS (SELECT *, (SELECT c FROM (SELECT unnest({sql_list(lx.cues('ja'))}) AS c) WHERE ends_with(b, c) ORDER BY length(c) DESC LIMIT 1) AS c FROM bare)
SELECT doc_id, 0 AS start, length(CASE WHEN c IS NULL THEN b ELSE regexp_replace(substr(b, 1, length(b) - length(c)), '{SEP_CLASS}', '') END)::int AS "end" FROM hit""")
def cue_trim(spark, sf):
    df = docs_with(spark, sf, F.concat(cued("ja"), F.lit("、 ")))
    whole = F.struct(F.lit(0).alias("start"), F.length("t").alias("end"))
    return df.select("doc_id", corrections.trim_cue("t", whole, "ja").alias("s")).select("doc_id", "s.start", "s.end")


# ---- polish ----

MIXED = ("hello world. this is fine", "안녕 hello", "漢字だけ", "漢字かな混じり", "今天天气很好", "12345 67", "ok！", "이것은 한국어", "Привет мир", "end?  ")


def mixed(list_: str, at: str) -> str:
    return f"concat({list_.format(quoted(MIXED))}{at}, CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END)"


MIXED_SPARK, MIXED_SQL = mixed("array({})", "[cast(doc_id % 10 as int)]"), mixed("[{}]", "[(doc_id % 10 + 1)::int]")
SCRIPT_SQL = "CASE WHEN k > 0 AND k + z >= l AND k + z >= h THEN 'Kana' WHEN h > l AND h > z THEN 'Hangul' WHEN z > l AND z > h THEN 'Hanzi' WHEN l > 0 THEN 'Latin' ELSE 'Other' END"
SCRIPT_CTE = f"""WITH src AS (SELECT doc_id, {MIXED_SQL} AS t FROM documents),
cnt AS (SELECT *, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS l, length(regexp_replace(t, '[^\\x{{AC00}}-\\x{{D7A3}}\\x{{1100}}-\\x{{11FF}}\\x{{3130}}-\\x{{318F}}]', '', 'g')) AS h, length(regexp_replace(t, '[^\\x{{4E00}}-\\x{{9FFF}}\\x{{3400}}-\\x{{4DBF}}]', '', 'g')) AS z, length(regexp_replace(t, '[^\\x{{3040}}-\\x{{30FF}}]', '', 'g')) AS k FROM src),
scr AS (SELECT doc_id, t, {SCRIPT_SQL} AS script FROM cnt)
"""


@query(SCRIPT_CTE + "SELECT doc_id, script FROM scr")
def script_class(spark, sf):
    return docs_with(spark, sf, F.expr(MIXED_SPARK)).select("doc_id", text.script("t").alias("script"))


@query(SCRIPT_CTE + """, pcs AS (SELECT doc_id, t, script, CASE WHEN script = 'Latin' THEN array_to_string(list_transform(regexp_extract_all(t, '[^.!?]*[.!?]|[^.!?]+$'), lambda p: regexp_extract(p, '^[^\\p{L}]*') || upper(substr(p, length(regexp_extract(p, '^[^\\p{L}]*')) + 1, 1)) || substr(p, length(regexp_extract(p, '^[^\\p{L}]*')) + 2)), '') ELSE t END AS b FROM scr),
trm AS (SELECT *, regexp_replace(b, '\\s+$', '') AS r, CASE WHEN script IN ('Latin', 'Hangul') THEN '.' WHEN script IN ('Hanzi', 'Kana') THEN '。' END AS stop FROM pcs)
SELECT doc_id, CASE WHEN stop IS NULL OR r = '' OR (stop = '.' AND regexp_matches(r, '[.!?)"''。]$')) OR (stop = '。' AND regexp_matches(r, '[。！？.!?]$')) THEN b ELSE r || stop END AS text FROM trm""")
def punct_restore(spark, sf):
    return docs_with(spark, sf, F.expr(MIXED_SPARK)).select("doc_id", polish.punctuate("t", polish.capital_letter).alias("text"))


SPOKEN = ("gonna ", "Wanna, ", "kinda. ", "c'mon ", "y'all! ", "dunno ", "", "'cause ")
_sp = "CASE WHEN pmod(i + doc_id, 31) = 0 THEN concat(array({})[cast((i + doc_id) % 8 as int)], w) ELSE w END"
_spd = "CASE WHEN (i - 1 + doc_id) % 31 = 0 THEN concat([{}][((i - 1 + doc_id) % 8 + 1)::int], w) ELSE w END"


@query(f"""WITH src AS (SELECT doc_id, array_to_string(list_transform(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda w, i: {_spd.format(quoted(SPOKEN))}), ' ') AS t FROM documents),
tok AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM (SELECT doc_id, string_split(t, ' ') AS ws FROM src)),
cor AS (SELECT *, regexp_extract(w, '[.,!?;:]+$') AS tail, regexp_replace(w, '[.,!?;:]+$', '') AS core FROM tok),
rep AS (SELECT c.*, m.r FROM cor c LEFT JOIN (SELECT unnest({sql_list(lx.SPOKEN_FORMS)}) AS k, unnest({sql_list(lx.SPOKEN_FORMS.values())}) AS r) m ON lower(c.core) = m.k)
SELECT doc_id, string_agg(CASE WHEN r IS NULL THEN w WHEN regexp_matches(core, '^\\p{{Lu}}') THEN upper(r[1]) || r[2:] || tail ELSE r || tail END, ' ' ORDER BY i) AS text FROM rep GROUP BY doc_id""")
def spoken_form(spark, sf):
    e = f"array_join(transform(split(trim(regexp_replace(text, '\\\\s+', ' ')), ' '), (w, i) -> {_sp.format(spark_quoted(SPOKEN))}), ' ')"
    return docs_with(spark, sf, F.expr(e)).select("doc_id", polish.spoken_forms("t").alias("text"))


SENTENCES_SQL = "list_filter(list_transform(regexp_extract_all(text, '[^.!?。！？]*[.!?。！？]|[^.!?。！？]+$'), lambda s: regexp_replace(regexp_replace(s, '^\\s+', ''), '\\s+$', '')), lambda s: s <> '')"


@query(f"SELECT doc_id, generate_subscripts(s, 1)::int - 1 AS pos, unnest(s) AS sentence FROM (SELECT doc_id, {SENTENCES_SQL} AS s FROM documents)")
def sentence_split(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(text.sentences("text")).alias("pos", "sentence"))


@query(f"""WITH RECURSIVE src AS (SELECT doc_id, text, {SENTENCES_SQL} AS s FROM documents),
prt AS (SELECT doc_id, 0 AS a, len(s)::int AS b FROM src UNION ALL
  SELECT doc_id, CASE WHEN h = 0 THEN a ELSE a + (b - a) // 2 END, CASE WHEN h = 0 THEN a + (b - a) // 2 ELSE b END FROM prt, (SELECT unnest([0, 1]) AS h) WHERE b - a > 8),
lst AS (SELECT doc_id, a, b FROM prt WHERE b - a <= 8)
SELECT s.doc_id, CASE WHEN len(s.s) <= 8 THEN any_value(s.text) ELSE string_agg(array_to_string(s.s[l.a + 1:l.b], ' '), chr(10) || chr(10) ORDER BY l.a) END AS text FROM src s JOIN lst l USING (doc_id) GROUP BY s.doc_id, s.s""")
def paragraph_max(spark, sf):
    return table(spark, sf, "documents").select("doc_id", polish.paragraphs("text").alias("text"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'i have $25, ok' WHEN 1 THEN 'room 304 costs €1200.' WHEN 2 THEN 'the meeting is on friday' ELSE 'about 2000000 people and 7' END || ' ' || doc_id AS text FROM documents""")
def itn_en(spark, sf):
    t = F.expr("concat(array('i have twenty five dollars, ok', 'room three hundred four costs one thousand two hundred euros.', 'the meeting is on friday', 'about two million people and seven')[cast(doc_id % 4 as int)], ' ', doc_id)")
    return docs_with(spark, sf, t).select("doc_id", polish.inverse_normalise("t", F.lit("en")).alias("text"))


@query("""SELECT doc_id, ['我有25块钱', 'そこに鳥1羽がいます', '2011年', '共12300元'][(doc_id % 4 + 1)::int] || doc_id AS text FROM documents""")
def itn_cjk(spark, sf):
    t = F.expr("concat(array('我有二十五块钱', 'そこに鳥一羽がいます', '二零一一年', '共一万二千三百元')[cast(doc_id % 4 as int)], doc_id)")
    return docs_with(spark, sf, t).select("doc_id", polish.inverse_normalise("t", F.when(F.col("doc_id") % 4 == 1, "ja").otherwise("zh")).alias("text"))


# ---- numerals and normalisation ----

ZH = (("二零一一年", "2011年"), ("十五个", "15个"), ("七十", "70"), ("一百二十三", "123"), ("一万二千三百", "12300"), ("百", "0"), ("三亿", "300000000"), ("〇九", "09"), ("没有", "没有"), ("四十和五", "40和5"))
KO = (("이천 십 일 년", "2011 년"), ("15만 명", "150000 명"), ("팔 월", "8 월"), ("천천히", "천천히"), ("만 년", "만 년"), ("이천이십육년", "2026년"), ("십오일", "15 일"), ("이 세트", "2 세트"), ("이 사람", "이 사람"), ("삼백만", "3000000"))


def _pairs(name: str, rows, f):
    spark_list = quoted(a for a, _ in rows)

    @query(f"SELECT doc_id, concat({sql_list(b for _, b in rows)}[(doc_id % 10 + 1)::int], ' x', doc_id) AS text FROM documents", name=name)
    def run(spark, sf):
        t = F.expr(f"concat(array({spark_list})[cast(doc_id % 10 as int)], ' x', doc_id)")
        return docs_with(spark, sf, t).select("doc_id", f("t").alias("text"))


_pairs("zh_numerals", ZH, numerals.chinese_numerals)
_pairs("ko_numerals", KO, numerals.korean_numerals)

NUMBERS = lx.english_numbers()
NUMBER_JOIN = f"(SELECT unnest({sql_list(NUMBERS)}) AS k, unnest({sql_list(NUMBERS.values())}) AS v)"
_num = tuple(NUMBERS)
_nsp = "CASE WHEN pmod(i + doc_id, 13) = 0 THEN array({})[cast((i * 7 + doc_id) % {} as int)] ELSE w END"
_nsd = "CASE WHEN (i - 1 + doc_id) % 13 = 0 THEN [{}][(((i - 1) * 7 + doc_id) % {} + 1)::int] ELSE w END"


@query(f"""WITH tok AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM (SELECT doc_id, list_transform(string_split(text, ' '), lambda w, i: {_nsd.format(quoted(_num), len(_num))}) AS ws FROM documents))
SELECT doc_id, string_agg(coalesce(v, w), ' ' ORDER BY i) AS text FROM tok LEFT JOIN {NUMBER_JOIN} ON w = k GROUP BY doc_id""")
def en_number_words(spark, sf):
    t = F.expr(f"array_join(transform(split(text, ' '), (w, i) -> {_nsp.format(quoted(_num), len(_num))}), ' ')")
    return docs_with(spark, sf, t).select("doc_id", numerals.english_number_words("t").alias("text"))


DROP_CLASS = "[" + "".join("\\" + c if c in ".,?!:;\"'()[]{}" else c for c in lx.DROPPED).replace("'", "''") + "]"
# Numerals of a run lose the single blanks between them, ASCII digits too: twice, since matches do not overlap.
LENIENT_SQL = f"""
one AS (SELECT doc_id, regexp_replace(regexp_replace(t, '([0-9])\\s([0-9])', '\\1\\2', 'g'), '([0-9])\\s([0-9])', '\\1\\2', 'g') AS t FROM src),
bare AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '{DROP_CLASS}', '', 'g'), '[\\s\\-–—−―]+', ' ', 'g'), '^ ', ''), ' $', '') AS t FROM one),
tok AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM (SELECT doc_id, string_split(lower(t), ' ') AS ws FROM bare)),
len AS (SELECT doc_id, string_agg(coalesce(v, w), ' ' ORDER BY i) AS text FROM tok LEFT JOIN {NUMBER_JOIN} ON w = k GROUP BY doc_id)
"""


@query(f"""WITH src AS (SELECT doc_id, 'Twenty-First, “ok” — ' || text AS t FROM documents), {LENIENT_SQL} SELECT doc_id, text FROM len""")
def normalize_lenient(spark, sf):
    return docs_with(spark, sf, F.concat(F.lit("Twenty-First, “ok” — "), "text")).select("doc_id", numerals.lenient("t").alias("text"))


@query(f"""WITH w AS (SELECT doc_id, generate_subscripts(ws, 1) - 1 AS i, unnest(ws) AS w FROM (SELECT doc_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS ws FROM documents) WHERE ws <> ['']),
l AS (SELECT *, {sql_list(labels.LABELS)}[((i * 7 + doc_id) % 15 + 1)::int] AS l FROM w),
p AS (SELECT *, CASE WHEN l[2] = 'U' AND regexp_matches(w, '^\\p{{L}}') THEN replace(upper(w[1]), 'ẞ', 'SS') || w[2:] ELSE w END || CASE WHEN l[1] <> 'O' THEN l[1] ELSE '' END AS t, (l[1] <> 'O')::int + (l[2] = 'U' AND regexp_matches(w, '^\\p{{L}}') AND replace(upper(w[1]), 'ẞ', 'SS') <> w[1])::int AS n FROM l)
SELECT d.doc_id, coalesce(string_agg(t, ' ' ORDER BY i), '') AS text, coalesce(sum(n), 0)::int AS corrections FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id GROUP BY d.doc_id""")
def punct_labels(spark, sf):
    """Every document's words with labels by place: each word has two tokens, the first of them with the label's score, equal to an earlier one's."""
    docs = table(spark, sf, "documents").select("doc_id", "text", F.size(text.words("text")).alias("n"))
    token = F.sequence(F.lit(0), F.greatest(2 * F.col("n") - 1, F.lit(0)))
    ids = F.concat(F.array(F.lit(None).cast("int")), F.transform(token, lambda t: F.floor(t / 2).cast("int")), F.array(F.lit(None).cast("int")))
    place = lambda t: ((F.floor(t / 2) * 7 + F.col("doc_id")) % 15).cast("int")
    row = lambda t: F.transform(F.sequence(F.lit(0), F.lit(14)), lambda k: F.when(t % 2 == 1, -k.cast("double")).when((k == place(t)) | (k * 2 == place(t)), 1.0).otherwise(0.0))
    none = F.array(F.array(F.lit(0.0)))
    out = docs.select("doc_id", labels.labelled("text", ids, F.concat(none, F.transform(token, row), none)).alias("r"))
    return out.select("doc_id", "r.text", F.size("r.corrections").alias("corrections"))


# ---- the whole cleaner ----

@query("""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat(text, ' gonna pay ', doc_id % 8 + 2, ' million') WHEN doc_id % 3 = 1 THEN concat('kinda ', text) ELSE text END AS t FROM documents),
s AS (SELECT doc_id, t, list_transform(regexp_extract_all(t, '[^.!?]*[.!?]|[^.!?]+$'), lambda p: regexp_extract(p, '\\p{L}')) AS l FROM t),
r AS (SELECT doc_id, unnest(list_concat(CASE doc_id % 3 WHEN 0 THEN [{'kind': 'SpokenFormNormalized', 'original': 'gonna', 'replacement': 'going to'}] WHEN 1 THEN [{'kind': 'SpokenFormNormalized', 'original': 'kinda', 'replacement': 'kind of'}] ELSE [] END,
  list_transform(list_filter(l, lambda c: upper(c) <> c), lambda c: {'kind': 'Capitalized', 'original': c, 'replacement': replace(upper(c), 'ẞ', 'SS')}),
  CASE WHEN regexp_matches(t, '[.!?)"''。]\\s*$') THEN [] ELSE [{'kind': 'PunctuationInserted', 'original': '', 'replacement': '.'}] END)) AS c FROM s)
SELECT doc_id, c.kind AS kind, c.original AS original, c.replacement AS replacement, count(*) AS n FROM r GROUP BY ALL""")
def clean_corrections(spark, sf):
    """What spoken forms and punctuation change in every document, by kind."""
    t = F.expr("CASE WHEN doc_id % 3 = 0 THEN concat(text, ' gonna pay ', doc_id % 8 + 2, ' million') WHEN doc_id % 3 = 1 THEN concat('kinda ', text) ELSE text END")
    docs = table(spark, sf, "documents").select("doc_id", F.lit("en").alias("lang"), t.alias("text"))
    cleaner = pipeline.Cleaner().process(pipeline.spoken_stage).process(pipeline.punctuation_stage).refine(pipeline.REFINERS["passthrough"])
    rows = cleaner.apply(docs, corrected="c").select("doc_id", F.inline("c"))
    return rows.groupBy("doc_id", "kind", "original", "replacement").agg(F.count("*").alias("n"))


@query()
def clean_pipeline(spark, sf):
    """All stages over texts with disfluencies of their language."""
    t = F.when(F.col("lang") == "es", noisy("es")).otherwise(noisy("en"))
    return pipeline.standard().apply(docs_with(spark, sf, t, "text")).select("doc_id", "lang", "clean_text")


@query("SELECT doc_id, upper(replace(text, 'ß', 'ss')) AS uppercase, 'done' AS fixed, text AS failed FROM documents")
def fallback_raw(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    out = docs
    for name, r in (("uppercase", lambda t: F.upper(F.replace(t, F.lit("ß"), F.lit("ss")))), ("fixed", pipeline.fixed("done")), ("failed", pipeline.REFINERS["fail"])):
        out = pipeline.Cleaner().refine(r).apply(out, out=name)
    return out.select("doc_id", "uppercase", "fixed", "failed")
