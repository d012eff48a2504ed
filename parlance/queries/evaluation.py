"""Queries of error rates, span scores, gates and latency."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import lexicon as lx
from parlance.functions import numerals
from parlance.operators import corrections, fillers, gates, polish, scoring
from parlance.plans import pipeline, timing
from parlance.queries.registry import query, table
from parlance.queries.text import LENIENT_SQL, docs_with, noisy, shown, word_filter_sql, word_rows_sql

PLAIN = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


def plain():
    return F.trim(F.regexp_replace("text", r"\s+", " "))


def pairs(spark, sf):
    """doc_id, lang, reference, hypothesis: the text and the text with disfluencies."""
    return table(spark, sf, "documents").select("doc_id", "lang", plain().alias("reference"), noisy("en").alias("hypothesis"))


PAIR = ("reference", "hypothesis")


def rounded(df, rate, undefined=None):
    return df.withColumn(rate, F.round(F.col(rate) if undefined is None else F.nanvl(rate, undefined), 6))


# A hypothesis that only has words put in is as far from its reference as there are words more; the noise also
# hangs marks on words, each one substitution.  So the distance is known without a second edit-distance routine.
INSERTED = """(SELECT doc_id, len(string_split(p, ' ')) AS n, sum(CASE (i + doc_id) % 23 WHEN 0 THEN 1 WHEN 5 THEN 2 WHEN 9 THEN 1 WHEN 13 THEN 1 WHEN 17 THEN 2 WHEN 20 THEN 1 ELSE 0 END) AS d
  FROM (SELECT doc_id, {plain} AS p FROM documents), LATERAL (SELECT unnest(range(0, len(string_split(p, ' ')))) AS i) GROUP BY doc_id, p)""".format(plain=PLAIN)
INSERTED_CHARS = """(SELECT doc_id, length(replace(p, ' ', '')) AS n, sum(CASE (i + doc_id) % 23 WHEN 0 THEN 2 WHEN 5 THEN 7 WHEN 9 THEN 5 WHEN 13 THEN 5 WHEN 17 THEN 11 WHEN 20 THEN 1 ELSE 0 END) AS d
  FROM (SELECT doc_id, {plain} AS p FROM documents), LATERAL (SELECT unnest(range(0, len(string_split(p, ' ')))) AS i) GROUP BY doc_id, p)""".format(plain=PLAIN)


@query(f"SELECT doc_id, round(d / n, 6) AS wer FROM {INSERTED}")
def wer_strict(spark, sf):
    return rounded(scoring.rates(pairs(spark, sf), "doc_id", wer=(scoring.tokens, *PAIR)), "wer")


@query(f"SELECT doc_id, round(d / n, 6) AS cer FROM {INSERTED_CHARS}")
def cer_strict(spark, sf):
    return rounded(scoring.rates(pairs(spark, sf), "doc_id", cer=(scoring.characters, *PAIR)), "cer")


def recased(spark, sf):
    """A hypothesis in capitals with other marks and two words more at its start: normalised, as both are here, those alone are counted."""
    h = F.regexp_replace(F.translate(F.upper(F.replace(plain(), F.lit("ß"), F.lit("ss"))), ".", "!"), " (?=[^0-9])", ", ")
    return table(spark, sf, "documents").select("doc_id", "lang", numerals.lenient(F.replace(plain(), F.lit("ß"), F.lit("ss"))).alias("reference"), numerals.lenient(F.concat(F.lit("NEW - Words? "), h)).alias("hypothesis"))


RECASED = f"WITH src AS (SELECT doc_id, replace({PLAIN}, 'ß', 'ss') AS t FROM documents), {LENIENT_SQL} "


@query(RECASED + "SELECT doc_id, CASE WHEN text = '' THEN -1.0 ELSE round(2 / len(string_split(text, ' ')), 6) END AS wer FROM len")
def wer_lenient(spark, sf):
    return rounded(scoring.rates(recased(spark, sf), "doc_id", wer=(scoring.tokens, *PAIR)), "wer", F.lit(-1.0))


@query(RECASED + "SELECT doc_id, CASE WHEN text = '' THEN -1.0 ELSE round(8 / length(replace(text, ' ', '')), 6) END AS cer FROM len")
def cer_lenient(spark, sf):
    return rounded(scoring.rates(recased(spark, sf), "doc_id", cer=(scoring.characters, *PAIR)), "cer", F.lit(-1.0))


def emptied(spark, sf):
    """Every seventh reference is empty, so its rate is undefined."""
    ref = F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("reference"))
    return scoring.rates(pairs(spark, sf).withColumn("reference", ref), "lang", er=(scoring.tokens, *PAIR))


@query(f"SELECT lang, round(avg(CASE WHEN doc_id % 7 <> 0 THEN d / n END), 6) AS mean_er FROM {INSERTED} JOIN documents USING (doc_id) GROUP BY lang")
def mean_er_skip_nan(spark, sf):
    return emptied(spark, sf).groupBy("lang").agg(F.round(scoring.mean_skipping("er"), 6).alias("mean_er"))


@query(f"SELECT lang, round(sum(CASE WHEN doc_id % 7 <> 0 THEN d / n ELSE 0 END) / count(*), 6) AS mean_er FROM {INSERTED} JOIN documents USING (doc_id) GROUP BY lang")
def mean_er_count_nan(spark, sf):
    return emptied(spark, sf).groupBy("lang").agg(F.round(scoring.mean_counting("er"), 6).alias("mean_er"))


def cleaned_wer(spark, sf):
    """WER of each text after the English filler filter against its own text after it: the flagship of the bench."""
    df = pairs(spark, sf).select("lang", "reference", fillers.english("hypothesis")["text"].alias("hypothesis"))
    return scoring.rates(df, "lang", er=(scoring.tokens, *PAIR)).groupBy("lang").agg(F.round(scoring.mean_skipping("er"), 6).alias("mean_wer"), F.count("*").alias("n"))


query()(cleaned_wer)


@query()
def ablation_matrix(spark, sf):
    """Mean WER by language with all layers and without each; one pass, a column for each configuration."""
    df = pairs(spark, sf)
    filtered = df.withColumn("f", fillers.english("hypothesis")["text"])
    both = filtered.withColumn("fc", corrections.remove("f", F.lit("en"))["text"]).withColumn("c", corrections.remove("hypothesis", F.lit("en"))["text"])
    out = {"full": polish.punctuate("fc"), "without_filler": polish.punctuate("c"), "without_punctuation": F.col("fc"), "without_self_correction": polish.punctuate("f")}
    rated = scoring.rates(both.select("lang", "reference", *[c.alias(k) for k, c in out.items()]), "lang", **{k: (scoring.tokens, "reference", k) for k in out})
    return rated.groupBy("lang").agg(*[F.round(scoring.mean_skipping(k), 6).alias(k) for k in out])


# ---- spans ----

def scored(spark, sf):
    """Predicted filler spans, and as gold those of pure fillers and pairs, one longer by a character for even documents."""
    pred = docs_with(spark, sf, noisy("en")).select("doc_id", fillers.word_spans("t", lx.ENGLISH).alias("predicted"))
    pure = F.filter("predicted", lambda s: ~F.lower(s["label"]).rlike("^(so|well|basically|actually|literally|right)[^a-z]*$"))
    gold = F.transform(pure, lambda s: F.struct(s["start"].alias("start"), (s["end"] + F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0)).cast("int").alias("end"), s["label"].alias("label")))
    return pred.withColumn("gold", gold)


SPAN_COUNTS = word_rows_sql("en", lx.ENGLISH) + """
, cnt AS (SELECT doc_id, count(*) FILTER (k IN ('A', 'p')) AS g, count(*) FILTER (k IN ('A', 'p', 'x')) AS p FROM fin GROUP BY doc_id),
sco AS (SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN g ELSE 0 END AS strict_tp, g AS iou_tp, p, g FROM cnt)
"""


@query(SPAN_COUNTS + "SELECT doc_id, strict_tp AS tp, p - strict_tp AS fp, g - strict_tp AS fn FROM sco")
def f1_strict(spark, sf):
    return scored(spark, sf).select("doc_id", scoring.strict_match(F.col("predicted"), F.col("gold")).alias("m")).select("doc_id", "m.*")


@query(SPAN_COUNTS + "SELECT doc_id, iou_tp AS tp, p - iou_tp AS fp, g - iou_tp AS fn FROM sco")
def f1_iou(spark, sf):
    return scoring.iou_matches(scored(spark, sf), "doc_id", predicted="predicted", gold="gold").select("doc_id", "m.*")


@query(SPAN_COUNTS + """, tot AS (SELECT doc_id % 5 AS part, sum(iou_tp)::bigint AS tp, sum(p - iou_tp)::bigint AS fp, sum(g - iou_tp)::bigint AS fn FROM sco GROUP BY 1)
SELECT part, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM tot""")
def f1_micro(spark, sf):
    df = scoring.iou_matches(scored(spark, sf).withColumn("part", F.col("doc_id") % 5), "part", predicted="predicted", gold="gold")
    out = scoring.micro(df, "m", "part")
    return out.select("part", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""WITH f AS (SELECT d.lang, r.removed <> '' AS fired, d.doc_id % 3 = 0 AS expected FROM ({word_filter_sql('en', lx.ENGLISH)}) r JOIN documents d USING (doc_id))
SELECT lang, count_if(fired AND expected)::bigint AS tp, count_if(fired AND NOT expected)::bigint AS fp, count_if(NOT fired AND expected)::bigint AS fn, count_if(NOT fired AND NOT expected)::bigint AS tn FROM f GROUP BY lang""")
def utt_confusion(spark, sf):
    df = shown(docs_with(spark, sf, noisy("en")).select("doc_id", fillers.english("t").alias("r"))).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return df.groupBy("lang").agg(*scoring.confusion(F.col("removed") != "", F.col("doc_id") % 3 == 0))


@query(word_filter_sql("en", lx.ENGLISH).replace("SELECT doc_id, coalesce(string_agg(w, ' ' ORDER BY i)", ", res AS (SELECT doc_id, coalesce(string_agg(w, ' ' ORDER BY i)") + """)
, lst AS (SELECT doc_id, CASE WHEN removed = '' THEN [] ELSE string_split(removed, '|') END AS p FROM res),
gld AS (SELECT doc_id, p, list_concat(list_filter(p, lambda x: length(x) > 2), ['um', 'zzz']) AS g FROM lst),
mch AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(p), lambda x: least(len(list_filter(p, lambda y: y = x)), len(list_filter(g, lambda y: y = x))))), 0)::bigint AS tp FROM gld)
SELECT doc_id, tp, len(p) - tp AS fp, len(g) - tp AS fn FROM mch""")
def pair_multiset_f1(spark, sf):
    df = docs_with(spark, sf, noisy("en")).select("doc_id", fillers.english("t")["removed"].alias("p"))
    df = df.withColumn("g", F.concat(F.filter("p", lambda x: F.length(x) > 2), F.array(F.lit("um"), F.lit("zzz"))))
    return df.select("doc_id", scoring.pair_match(F.col("p"), F.col("g")).alias("m")).select("doc_id", "m.*")


# ---- latency and gates ----

@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, count(*) AS n FROM events GROUP BY event_type")
def latency_percentiles(spark, sf):
    p50, p95 = scoring.latency("value")
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(p50, 6).alias("p50"), F.round(p95, 6).alias("p95"), F.count("*").alias("n"))


@query("SELECT event_type, round(sum(value) / sum(value * 3 + 1), 6) AS rtf FROM events GROUP BY event_type")
def rtf(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(scoring.real_time_factor(F.col("value"), F.col("value") * 3 + 1), 6).alias("rtf"))


MEASURED = """SELECT event_type AS lang, avg(value) / 1000 AS wer, CASE WHEN length(event_type) % 2 = 0 THEN avg(value) / 500 END AS cer, quantile_cont(value, 0.5) * 10 AS asr_p50, quantile_cont(value, 0.95) * 10 AS e2e_p50, avg(value) / 100 AS rtf FROM events GROUP BY event_type"""


def measured(spark, sf):
    p50, p95 = scoring.latency("value")
    cer = F.when(F.length("event_type") % 2 == 0, F.avg("value") / 500)
    return table(spark, sf, "events").groupBy("event_type").agg((F.avg("value") / 1000).alias("wer"), cer.alias("cer"), (p50 * 10).alias("asr_p50"), (p95 * 10).alias("e2e_p50"), (F.avg("value") / 100).alias("rtf")).withColumnRenamed("event_type", "lang")


FACTOR = {"wer": (1.0, 0.85, 0.5, 1.2), "cer": (1.0, 0.95, 0.6, 1.0), "asr_p50": (1.0, 0.6, 0.3, 0.0), "e2e_p50": (1.0, 0.7, 0.4, 2.0), "rtf": (1.0, 0.6, 0.3, 1.1)}


def _factor(c: str) -> str:
    return "CASE length(lang) % 4 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(FACTOR[c])) + " END"


GATE_SQL = f"""
WITH m AS ({MEASURED}),
b AS (SELECT lang, {', '.join(f'{c} * ({_factor(c)})::double AS {c}' for c in FACTOR)} FROM m WHERE length(lang) % 5 <> 0),
j AS (SELECT m.*, b.lang AS bl, b.wer AS bw, b.cer AS bc, b.asr_p50 AS ba, b.e2e_p50 AS be, b.rtf AS br FROM m LEFT JOIN b USING (lang)),
er AS (SELECT lang, metric, CASE WHEN x - y >= 0.07 OR (y > 0 AND (x - y) / y >= 0.30) THEN 'fail' WHEN x - y >= 0.03 OR (y > 0 AND (x - y) / y >= 0.10) THEN 'warn' ELSE 'pass' END AS status
  FROM (SELECT lang, 'wer' AS metric, wer AS x, bw AS y FROM j WHERE bl IS NOT NULL UNION ALL SELECT lang, 'cer', cer, bc FROM j WHERE bl IS NOT NULL AND cer IS NOT NULL)),
re AS (SELECT lang, metric, CASE WHEN y <= 0 THEN 'pass' WHEN (x - y) / y >= f THEN 'fail' WHEN (x - y) / y >= w THEN 'warn' ELSE 'pass' END AS status
  FROM (SELECT lang, 'asr_latency_p50_ms' AS metric, asr_p50 AS x, ba AS y, 0.5 AS w, 1.5 AS f FROM j WHERE bl IS NOT NULL UNION ALL SELECT lang, 'e2e_latency_p50_ms', e2e_p50, be, 0.3, 1.0 FROM j WHERE bl IS NOT NULL UNION ALL SELECT lang, 'rtf', rtf, br, 0.5, 1.5 FROM j WHERE bl IS NOT NULL)),
ab AS (SELECT lang, metric, CASE WHEN x >= l THEN 'warn' ELSE 'pass' END AS status
  FROM (SELECT lang, 'rtf_absolute' AS metric, rtf AS x, 1.0 AS l FROM j WHERE bl IS NOT NULL UNION ALL SELECT lang, 'asr_latency_p50_ms_absolute', asr_p50, 1000 FROM j WHERE bl IS NOT NULL UNION ALL SELECT lang, 'e2e_latency_p50_ms_absolute', e2e_p50, 1000 FROM j WHERE bl IS NOT NULL)),
al AS (SELECT * FROM er UNION ALL SELECT * FROM re UNION ALL SELECT * FROM ab UNION ALL SELECT lang, 'baseline', 'warn' FROM j WHERE bl IS NULL)
"""


def baseline(spark, sf):
    m = measured(spark, sf).where(F.length("lang") % 5 != 0)
    return m.select("lang", *[(F.col(c) * F.expr(f"cast({_factor(c)} as double)")).alias(c) for c in FACTOR])


@query(GATE_SQL + "SELECT lang, metric, status FROM al")
def gate_language(spark, sf):
    return gates.check_languages(measured(spark, sf), baseline(spark, sf))


@query(GATE_SQL + "SELECT lang, bool_or(status = 'fail') AS failed, count_if(status = 'warn')::bigint AS warnings FROM al GROUP BY lang")
def gate_overall(spark, sf):
    return gates.overall(gate_language(spark, sf), "lang")


LAYERS = """SELECT e.lang, k.kind, k.name, e.v * k.f AS value FROM (SELECT event_type AS lang, avg(value) AS v FROM events GROUP BY 1) e,
  (VALUES ('ablation', 'full', 0.001::double), ('ablation', 'without_filler', 0.002), ('ablation', 'new', 0.003), ('latency', 'filler', 1.0), ('latency', 'punctuation', 30000.0)) k(kind, name, f)"""


@query(f"""WITH m AS ({LAYERS}),
b AS (SELECT lang, kind, name, CASE WHEN kind = 'ablation' THEN value - 0.01 * (length(lang) % 7) ELSE value / (1 + length(lang) % 6) END AS b FROM m WHERE name <> 'new'),
j AS (SELECT m.*, b FROM m LEFT JOIN b USING (lang, kind, name))
SELECT lang, kind, name, CASE WHEN b IS NULL THEN 'warn' WHEN kind = 'ablation' THEN CASE WHEN abs(value - b) >= 0.05 THEN 'fail' WHEN abs(value - b) >= 0.02 THEN 'warn' ELSE 'pass' END
  WHEN b <= 0 THEN 'pass' WHEN (value - b) / b >= 3.5 THEN 'fail' WHEN (value - b) / b >= 1.5 THEN 'warn' ELSE 'pass' END AS status FROM j
UNION ALL SELECT lang, kind, name || '_absolute', CASE WHEN value >= 1000000 THEN 'warn' ELSE 'pass' END FROM j WHERE kind = 'latency' AND b IS NOT NULL""")
def gate_layers(spark, sf):
    metrics = (("ablation", "full", 0.001), ("ablation", "without_filler", 0.002), ("ablation", "new", 0.003), ("latency", "filler", 1.0), ("latency", "punctuation", 30000.0))
    mean = table(spark, sf, "events").groupBy(F.col("event_type").alias("lang")).agg(F.avg("value").alias("v"))
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("name"), (F.col("v") * f).alias("value")) for k, n, f in metrics])
    m = mean.select("lang", F.inline(rows))
    b = F.when(F.col("kind") == "ablation", F.col("value") - 0.01 * (F.length("lang") % 7)).otherwise(F.col("value") / (1 + F.length("lang") % 6))
    return gates.check_layers(m, m.where("name <> 'new'").withColumn("value", b))


@query("SELECT doc_id, trim(lower(regexp_replace(text, '[.,]', '', 'g'))) <> '' AS filled FROM documents")
def lenient_not_empty(spark, sf):
    return table(spark, sf, "documents").select("doc_id", (numerals.lenient("text") != "").alias("filled"))


@query("SELECT stage, rows, changed, true AS ordered FROM (SELECT 'upper' AS stage, count(*) AS rows, sum((replace(upper(text), 'ẞ', 'SS') <> text)::int)::bigint AS changed FROM documents UNION ALL SELECT 'spoken', count(*), sum((doc_id % 2 = 0)::int)::bigint FROM documents)")
def layer_timing(spark, sf):
    """A row for each of two layers over all documents, half of which hold a reduction; times differ from run to run, so their order alone is shown."""
    t = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(" gonna"))).otherwise(F.col("text"))
    docs = table(spark, sf, "documents").select(t.alias("t"), F.col("text"), F.lit("en").alias("lang"))
    first = timing.layer_latency(docs, {"upper": lambda x, lang: F.upper(x)}, warmup=0, runs=2)
    second = timing.layer_latency(docs.drop("text"), {"spoken": pipeline.spoken_stage}, warmup=1, runs=2, text="t")
    return first.unionByName(second).select("stage", "rows", "changed", (F.col("p50_us") <= F.col("p95_us")).alias("ordered"))
