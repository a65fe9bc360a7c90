"""Queries on span labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from kairograph.operators import spans as B
from kairograph.plans.fixtures import table


def chunks(spark, sf_dir):
    """Ten words of each document at a time."""
    words = F.filter(F.split("text", r"[ \n]+"), lambda w: w != "")
    docs = table(spark, sf_dir, "documents").select("doc_id", words.alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1)), F.lit(10))
    return docs.select("doc_id", F.posexplode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, 10), " "))).alias("chunk", "text"))


def tokens(spark, sf_dir):
    """Fixed-width tokens of eleven characters."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n")).filter("n > 0")
    cut = docs.select("doc_id", "n", F.posexplode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(11))).alias("token", "start_char"))
    return cut.select("doc_id", "token", "start_char", F.least(F.col("start_char") + 11, F.col("n")).alias("end_char"))


def annotator(spark, sf_dir, step, width, shift):
    """Spans every ``step`` characters, wider than the step at times; each fifth is linguistic."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n")).filter("n > 0")
    cut = docs.select("doc_id", "n", F.posexplode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(step))).alias("span_idx", "s"))
    start = F.col("s") + (F.col("doc_id") % shift).cast("int")
    end = start + width + (F.col("span_idx") % 3) * step
    label = F.when((F.col("span_idx") + F.col("doc_id")) % 5 == 0, "linguistic").otherwise("factual")
    return cut.select("doc_id", "span_idx", start.alias("start_char"), end.cast("int").alias("end_char"), label.alias("label"), ((F.col("span_idx") * 37 % 101) / 100).alias("confidence"))


def lengths(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"))


def heuristic_labels(spark, sf_dir):
    text = F.concat(F.element_at(F.array(*map(F.lit, ("IL-2 ", "however", "10 mg of ", "the stage II ", "", "EGFR"))), (F.col("chunk") % 6 + 1).cast("int")), F.when(F.col("chunk") % 6 == 1, "").when(F.col("chunk") % 6 == 5, "").otherwise(F.col("text")))
    return chunks(spark, sf_dir).select("doc_id", "chunk", B.rule_label(text).alias("outcome"))


def heuristic_stats(spark, sf_dir):
    return B.rule_statistics(chunks(spark, sf_dir))


def hybrid_split(spark, sf_dir):
    return B.hybrid_parts(chunks(spark, sf_dir)).select("doc_id", "chunk", "part")


def label_stats(spark, sf_dir):
    return B.label_statistics(annotator(spark, sf_dir, 40, 25, 7)).withColumn("mean_confidence", F.round("mean_confidence", 9)).withColumn("mean_length", F.round("mean_length", 9))


def low_confidence(spark, sf_dir):
    return B.low_confidence(annotator(spark, sf_dir, 40, 25, 7), 0.1).select("doc_id", "span_idx", "confidence")


def merged_spans(spark, sf_dir):
    return B.merge_spans(annotator(spark, sf_dir, 40, 25, 7).filter("label = 'factual'").select("doc_id", "start_char", "end_char"), ["doc_id"])


def token_labels(spark, sf_dir):
    return B.token_labels(tokens(spark, sf_dir), annotator(spark, sf_dir, 40, 15, 7)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones"), F.sum(F.col("label") * F.col("token")).cast("long").alias("places"))


def kappa(spark, sf_dir):
    return B.kappa(lengths(spark, sf_dir), annotator(spark, sf_dir, 40, 15, 7), annotator(spark, sf_dir, 40, 20, 5))


def label_validation(spark, sf_dir):
    found = B.validate(lengths(spark, sf_dir), annotator(spark, sf_dir, 400, 90, 7), most=20)
    return found.withColumn("issues", F.array_join("issues", "; "))


def label_revalidation(spark, sf_dir):
    spans = annotator(spark, sf_dir, 400, 90, 7)
    by_chars, by_spans = (B.validate(lengths(spark, sf_dir), spans, most=20, by_span=x) for x in (False, True))
    return B.revalidation_changes(by_chars, by_spans)


def label_summary(spark, sf_dir):
    found = B.validate(lengths(spark, sf_dir), annotator(spark, sf_dir, 400, 90, 7), most=20)
    return B.corpus_summary(found.join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id"), "source").withColumn("mean_ratio", F.round("mean_ratio", 9))


def span_location(spark, sf_dir):
    """Words of each turn, looked up again in order, every third in capitals and every seventh made up."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.split("text", " ").alias("w"))
    picked = F.transform("w", lambda x, i: F.when(i % 7 == 6, "@@@").when(i % 3 == 2, F.upper(x)).otherwise(x))
    starts = B.locate_spans("text", picked)
    return turns.select("conv_id", "turn", F.array_join(F.transform(starts, lambda s: F.coalesce(s.cast("string"), F.lit("-"))), ",").alias("starts"))


def response_spans(spark, sf_dir):
    """Spans of each turn from a response that names its words, plain, fenced, within words or broken."""
    turns = table(spark, sf_dir, "conversations").filter("text is not null").select("conv_id", "turn", "text", F.split("text", " ").alias("w"))
    label = lambda i: F.element_at(F.array(*map(F.lit, ("factual", "Retrieval ", "generation", "unheard of"))), (i % 4 + 1).cast("int"))
    items = F.transform("w", lambda x, i: F.struct(F.when(i % 7 == 6, "@@@").when(i % 3 == 2, F.upper(x)).otherwise(x).alias("span"), F.when(i % 5 < 4, label(i)).alias("label"), F.when(i % 2 == 0, i / 4.0).alias("confidence")))
    body, kind = F.to_json(items), F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4))
    response = F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("These: "), body, F.lit("."))).otherwise("none")
    found = B.parse_span_responses(turns.select("conv_id", "turn", "text", response.alias("response")))
    return found.select("conv_id", "turn", "span_idx", "start_char", "end_char", "label", "confidence")


def review_tasks(spark, sf_dir):
    spans = annotator(spark, sf_dir, 400, 90, 7).withColumn("text", F.lit("span"))
    return B.review_tasks(table(spark, sf_dir, "documents"), spans)


def mention_labels(spark, sf_dir):
    """The words of even chunks, with labels of those of odd ones."""
    words = chunks(spark, sf_dir).select("doc_id", "chunk", F.explode(F.split("text", " ")).alias("w"))
    capitals = F.translate("w", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")  # ß and its like have no common capital
    mentions = words.filter("chunk % 2 = 0").select("doc_id", capitals.alias("text"))
    labels = words.filter("chunk % 2 = 1").select(F.lower("w").alias("text"), F.col("doc_id").alias("span_idx"), F.when(F.col("doc_id") % 2 == 0, "factual").otherwise("linguistic").alias("label"))
    return B.mention_spans(mentions, labels).select("doc_id", F.col("text").alias("mention"), "label")


_NAMES = """heuristic_labels heuristic_stats hybrid_split label_stats low_confidence merged_spans token_labels kappa label_validation label_revalidation label_summary span_location response_spans review_tasks mention_labels""".split()
QUERIES = {k: globals()[k] for k in _NAMES}


def _annotator(step, width, shift):
    return f"""(SELECT doc_id, n, CAST(i AS INT) AS span_idx, CAST(i * {step} + doc_id % {shift} AS INT) AS start_char, CAST(i * {step} + doc_id % {shift} + {width} + i % 3 * {step} AS INT) AS end_char,
      CASE WHEN (i + doc_id) % 5 = 0 THEN 'linguistic' ELSE 'factual' END AS label, (i * 37 % 101) / 100 AS confidence FROM (SELECT doc_id, length(text) AS n, unnest(range(0, (length(text) + {step} - 1) // {step})) AS i FROM documents))"""


_CHARS = "(SELECT DISTINCT doc_id, unnest(range(greatest(start_char, 0), least(end_char, n))) AS c FROM {a} WHERE label = 'factual')"
_VALIDATED = """
f AS (SELECT doc_id, count(*) AS n_spans, sum(CASE WHEN label = 'factual' THEN end_char - start_char ELSE 0 END) AS chars, count(*) FILTER (label = 'factual') AS factual FROM {a} {where} GROUP BY doc_id),
v AS (SELECT doc_id, source, coalesce(n_spans, 0) AS n_spans, coalesce(chars, 0) / nullif(length(text), 0) AS ratio, factual / n_spans AS span_ratio FROM documents LEFT JOIN f USING (doc_id)),
w AS (SELECT *, list_filter([CASE WHEN n_spans = 0 THEN 'no labels' END, CASE WHEN n_spans > 20 THEN 'too many spans' END, CASE WHEN n_spans > 0 AND ratio < 0.15 THEN 'ratio too low' END, CASE WHEN n_spans > 0 AND ratio > 0.85 THEN 'ratio too high' END], lambda x: x IS NOT NULL) AS issues FROM v)"""
_CHUNKS = """chunks AS (SELECT doc_id, CAST((s - 1) // 10 AS INT) AS chunk, array_to_string(list_slice(w, s, s + 9), ' ') AS text
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 1) + 1, 10)) AS s FROM (SELECT doc_id, list_filter(string_split_regex(text, '[ \\n]+'), lambda x: x <> '') AS w FROM documents)))"""
SQL = {
    "label_stats": f"""SELECT label, count(*) AS n, round(avg(confidence), 9) AS mean_confidence, CAST(min(end_char - start_char) AS BIGINT) AS min_length, CAST(max(end_char - start_char) AS BIGINT) AS max_length, round(avg(end_char - start_char), 9) AS mean_length,
      median(end_char - start_char)::DOUBLE AS median_length, round(count(*) / (SELECT count(*) FROM {_annotator(40, 25, 7)}), 4) AS ratio FROM {_annotator(40, 25, 7)} GROUP BY ROLLUP (label)""",
    "low_confidence": f"SELECT doc_id, span_idx, confidence FROM {_annotator(40, 25, 7)} WHERE confidence < 0.1",
    "merged_spans": f"""WITH s AS (SELECT doc_id, start_char, end_char, max(end_char) OVER (PARTITION BY doc_id ORDER BY start_char, end_char ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {_annotator(40, 25, 7)} WHERE label = 'factual'),
      i AS (SELECT *, sum(CAST(start_char > coalesce(reach, -1) AS INT)) OVER (PARTITION BY doc_id ORDER BY start_char, end_char) AS island FROM s) SELECT doc_id, min(start_char) AS start_char, max(end_char) AS end_char FROM i GROUP BY doc_id, island""",
    "token_labels": f"""WITH c AS (SELECT DISTINCT doc_id, unnest(range(start_char, least(end_char, n))) AS c FROM {_annotator(40, 15, 7)} WHERE label = 'factual'), t AS (SELECT doc_id, CAST(c // 11 AS INT) AS token, count(*) AS k FROM c GROUP BY 1, 2),
      every AS (SELECT doc_id, CAST(i AS INT) AS token, least(i * 11 + 11, n) - i * 11 AS width FROM (SELECT doc_id, length(text) AS n, unnest(range(0, (length(text) + 10) // 11)) AS i FROM documents)),
      l AS (SELECT doc_id, token, CAST(coalesce(2 * k > width, FALSE) AS BIGINT) AS label FROM every LEFT JOIN t USING (doc_id, token)) SELECT doc_id, count(*) AS n, CAST(sum(label) AS BIGINT) AS ones, CAST(sum(label * token) AS BIGINT) AS places FROM l GROUP BY doc_id""",
    "kappa": f"""WITH a AS {_CHARS.format(a=_annotator(40, 15, 7))}, b AS {_CHARS.format(a=_annotator(40, 20, 5))}, n AS (SELECT doc_id, length(text) AS n FROM documents WHERE length(text) > 0),
      ka AS (SELECT doc_id, count(*) AS na FROM a GROUP BY doc_id), kb AS (SELECT doc_id, count(*) AS nb FROM b GROUP BY doc_id),
      j AS (SELECT a.doc_id, count(*) AS tp FROM a JOIN b ON a.doc_id = b.doc_id AND a.c = b.c GROUP BY a.doc_id),
      r AS (SELECT doc_id, n, coalesce(tp, 0) AS tp, coalesce(na, 0) AS na, coalesce(nb, 0) AS nb FROM n LEFT JOIN j USING (doc_id) LEFT JOIN ka USING (doc_id) LEFT JOIN kb USING (doc_id)),
      o AS (SELECT doc_id, tp, na - tp AS fp, nb - tp AS fn, n - na - nb + tp AS tn, (n - na - nb + 2 * tp) / n AS observed, na / n * (nb / n) + (1 - na / n) * (1 - nb / n) AS expected FROM r)
      SELECT *, CASE WHEN abs(1 - expected) < 1e-12 THEN CASE WHEN abs(1 - observed) < 1e-12 THEN 1.0 ELSE 0.0 END ELSE (observed - expected) / (1 - expected) END AS kappa FROM o""",
    "label_validation": f"WITH {_VALIDATED.format(a=_annotator(400, 90, 7), where='')} SELECT doc_id, n_spans, ratio, array_to_string(issues, '; ') AS issues, len(issues) = 0 AS valid FROM w",
    "label_revalidation": f"""WITH {_VALIDATED.format(a=_annotator(400, 90, 7), where='')}, b AS (SELECT len(issues) = 0 AS old, n_spans BETWEEN 1 AND 20 AND span_ratio BETWEEN 0.15 AND 0.85 AS new FROM w)
      SELECT count(*) FILTER (old) AS valid_before, count(*) FILTER (NOT old) AS invalid_before, count(*) FILTER (new) AS valid_after, count(*) FILTER (NOT new) AS invalid_after, count(*) FILTER (old <> new) AS flipped FROM b""",
    "label_summary": f"WITH {_VALIDATED.format(a=_annotator(400, 90, 7), where='')} SELECT source, count(*) FILTER (len(issues) = 0) AS valid, count(*) FILTER (len(issues) > 0) AS invalid, round(avg(ratio), 9) AS mean_ratio FROM w GROUP BY source",
    "mention_labels": f"""WITH {_CHUNKS}, w AS (SELECT doc_id, chunk, unnest(string_split(text, ' ')) AS w FROM chunks), m AS (SELECT doc_id, translate(w, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS mention FROM w WHERE chunk % 2 = 0), l AS (SELECT lower(w) AS t, doc_id FROM w WHERE chunk % 2 = 1),
      x AS (SELECT t, max(doc_id) AS d FROM l GROUP BY t) SELECT doc_id, mention, CASE WHEN d % 2 = 0 THEN 'factual' ELSE 'linguistic' END AS label FROM m JOIN x ON lower(mention) = t""",
}
