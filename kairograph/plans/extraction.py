"""Queries along the path from sections to training rows: sections, prompts, relations and their ends, examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from kairograph.functions.text import fact_text
from kairograph.operators import chunks as C
from kairograph.operators import entities as N
from kairograph.operators import examples as D
from kairograph.operators import relations as L
from kairograph.plans import text as T
from kairograph.plans import vectors as V
from kairograph.plans.fixtures import FACTS_SQL, base_facts, table

TITLES = ("Abstract", "INTRODUCTION", "Materials and Methods", "Results", "Results and Discussion", "Funding", "Notes")
REQUESTS = ("methods", "Result", "discussion", "results")


def sections(spark, sf_dir):
    """Each source as a paper, each document as one of its sections."""
    title = F.element_at(F.array(*map(F.lit, TITLES)), (F.col("doc_id") % len(TITLES) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(F.col("source").alias("pmcid"), F.col("doc_id").alias("section_ord"), title.alias("section"), F.md5("text").alias("text"))


def _requests(spark):
    return spark.createDataFrame([(r,) for r in REQUESTS], "name string")


def sections_first_match(spark, sf_dir):
    return C.first_match(sections(spark, sf_dir))


def sections_per_request(spark, sf_dir):
    return C.per_request(sections(spark, sf_dir), _requests(spark))


def sections_all_matches(spark, sf_dir):
    return C.all_matches(sections(spark, sf_dir), _requests(spark))


def prompt_table(spark, sf_dir):
    """A prompt for each document with names of the benchmark in it."""
    texts = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("chunk"))
    grouped = L.mentions_per_chunk(T.mentions(spark, sf_dir), texts, ("doc_id",))
    return L.prompts(grouped, "List the relations.").select("doc_id", F.size("mentions").cast("long").alias("n"), "prompt_key")


def _entities(spark, sf_dir):
    """Entities of an order's paper: the suppliers of its open lines, and its parts of odd number."""
    items = table(spark, sf_dir, "lineitem")
    suppliers = items.filter("l_linestatus = 'O'").select(F.col("l_orderkey").alias("pmcid"), F.concat(F.lit("S"), "l_suppkey").alias("canonical_id"))
    return suppliers.union(items.filter("l_partkey % 2 = 1").select("l_orderkey", F.concat(F.lit("P"), "l_partkey")))


def relation_ends(spark, sf_dir):
    relations = L.parse_responses(T.relation_responses(spark, sf_dir)).withColumnRenamed("l_orderkey", "pmcid")
    return L.resolve_ends(relations, _entities(spark, sf_dir)).select("pmcid", "subject_id", "object_id", "relation_type")


def relation_complete(spark, sf_dir):
    blank = lambda c, k: F.when(F.col(c) % k == 0, "  ").when(F.col(c) % k == 1, F.lit(None)).otherwise(F.col(c).cast("string"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", blank("l_suppkey", 7).alias("subject_id"), blank("l_partkey", 5).alias("object_id"), F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")).alias("relation_type"))
    return L.complete_rows(rows)


def extraction_statistics(spark, sf_dir):
    """A run for each line; returned ones failed."""
    runs = table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").cast("long").alias("extracted"), F.col("l_partkey").alias("tokens"), (F.col("l_linenumber") / 4).alias("cost"), F.when(F.col("l_returnflag") == "R", "failed").alias("error"), F.col("l_linenumber").cast("long").alias("failures")
    )
    return L.statistics(runs)


def mention_entities(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(
        F.when(F.col("c_custkey") % 5 > 0, F.concat(F.lit("C"), F.col("c_custkey").cast("string"))).alias("canonical_id"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_name")).alias("canonical_name"), F.col("c_mktsegment").alias("mention"),
        F.when(F.col("c_custkey") % 4 > 0, "segment").alias("entity_type"), F.when(F.col("c_custkey") % 2 > 0, "OWN").alias("source_ontology"),
    )
    return N.to_entities(rows)


def factual_mentions(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    spans = parts.filter("p_size % 3 > 0").select(F.upper("p_type").alias("text"), F.when(F.col("p_size") % 3 == 1, "factual").otherwise("linguistic").alias("label"))
    return D.factual_mentions(parts.select("p_partkey", F.lower("p_type").alias("mention")), spans)


def example_counts(spark, sf_dir):
    return D.example_counts(**{t: table(spark, sf_dir, t) for t in ("documents", "labels", "conversations")})


def nearest_facts(spark, sf_dir):
    """Every tenth vector as a positive; of these every third is zero and has none."""
    rows = V.asking(spark, sf_dir).select(F.col("query_id").alias("doc_id"), F.when(F.col("query_id") % 30 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding")).alias("positive_embedding"))
    return D.nearest_facts(rows, V.corpus(spark, sf_dir)).select("query_id", F.col("rank").cast("long").alias("rank"), "id")


def fact_texts(spark, sf_dir):
    rows = base_facts(spark, sf_dir).withColumn("object_label", F.when(F.col("confidence") < 0.95, F.col("object_label")))
    return rows.select("fact_id", fact_text().alias("text"))


def training_rows(spark, sf_dir):
    """Joint examples of all turns: tokens and their labels, the mean vector of a turn's mentions, three negatives."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.regexp_replace("text", "[^A-Za-z ]", "").alias("text"))
    vectors = V.corpus(spark, sf_dir).select(F.col("id").alias("canonical_id"), "embedding")
    tokens = D.token_table(turns, most=None)
    labels = tokens.select("doc_id", "token", (F.length("word") % 2).cast("int").alias("label"))
    router = D.router_examples(tokens, labels)
    mentions = turns.filter("doc_id % 4 > 0").select("doc_id", F.explode(F.array(F.col("doc_id") % 60, F.col("doc_id") % 7)).alias("canonical_id"))
    negatives = turns.select("doc_id", F.explode(F.sequence(F.lit(1), (F.col("doc_id") % 4).cast("int") + 1)).alias("rank")).filter("rank <= doc_id % 4").select("doc_id", "rank", ((F.col("doc_id") + F.col("rank")) % 50).alias("id"))
    joint = D.joint_examples(D.retrieval_examples(router, D.positives(turns, mentions, vectors, 64), negatives, vectors, 3, 64))
    first = lambda k: F.round(F.col("negative_embeddings")[k][0], 6)
    return joint.select(
        "doc_id", F.size("input_ids").cast("long").alias("n"), F.aggregate("span_mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("ones"), (F.element_at("token_labels", -1) == D.IGNORED).alias("ignored"),
        F.round(F.col("positive_embedding")[0], 6).alias("positive"), first(0).alias("negative_1"), first(2).alias("negative_3"),
    )


_NAMES = """sections_first_match sections_per_request sections_all_matches prompt_table relation_ends relation_complete extraction_statistics mention_entities factual_mentions example_counts nearest_facts fact_texts training_rows""".split()
QUERIES = {k: globals()[k] for k in _NAMES}

_SECTIONS = f"s AS (SELECT source AS pmcid, doc_id AS section_ord, {list(TITLES)}[doc_id % {len(TITLES)} + 1] AS section, md5(text) AS text FROM documents)"
_HITS = f"h AS (SELECT s.*, wanted FROM s, (SELECT DISTINCT lower(unnest({list(REQUESTS)})) AS wanted) WHERE contains(lower(section), wanted))"
_BLANK = "CASE WHEN {c} % {k} > 1 THEN CAST({c} AS VARCHAR) END"
SQL = {
    "sections_first_match": f"WITH {_SECTIONS} SELECT *, list_filter({list(C.SECTIONS)}, lambda w: contains(lower(section), w))[1] AS wanted FROM s WHERE len(list_filter({list(C.SECTIONS)}, lambda w: contains(lower(section), w))) > 0",
    "sections_per_request": f"WITH {_SECTIONS}, {_HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY pmcid, wanted ORDER BY section_ord) AS rn FROM h) SELECT pmcid, wanted, section_ord, section, text FROM r WHERE rn = 1",
    "sections_all_matches": f"WITH {_SECTIONS}, {_HITS} SELECT * FROM h",
    "prompt_table": f"""WITH {T._MENTIONS.split(', t AS (')[0]}, w AS (SELECT doc_id, text, {T._WORDS.replace('lower(text)', 'text')} AS w FROM documents),
      r AS (SELECT doc_id, text, start, array_to_string(w[start + 1 : start + n], ' ') AS mention FROM (SELECT *, unnest([1, 2, 3]) AS n FROM (SELECT *, unnest(range(0, len(w))) AS start FROM w)) WHERE start + n <= len(w)),
      m AS (SELECT r.*, 'C' || md5(name) AS canonical_id FROM r JOIN g ON lower(mention) = name WHERE length(mention) BETWEEN 2 AND 100),
      p AS (SELECT doc_id, text, count(*) AS n, list('- ' || mention || ' (' || canonical_id || ')' ORDER BY start, mention, canonical_id)[1:50] AS lines FROM m GROUP BY doc_id, text)
      SELECT doc_id, n, substr(sha256('List the relations.' || chr(10) || chr(10) || 'Text:' || chr(10) || text || chr(10) || chr(10) || 'Entities:' || chr(10) || array_to_string(lines, chr(10))), 1, 16) AS prompt_key FROM p""",
    "relation_ends": f"""WITH {T._ITEMS}, e AS (SELECT l_orderkey AS k, 'S' || CAST(l_suppkey AS VARCHAR) AS id FROM lineitem WHERE l_linestatus = 'O' UNION SELECT l_orderkey, 'P' || CAST(l_partkey AS VARCHAR) FROM lineitem WHERE l_partkey % 2 = 1)
      SELECT l_orderkey AS pmcid, subject_id, object_id, relation_type FROM p WHERE EXISTS (SELECT 1 FROM e WHERE k = l_orderkey AND id = subject_id) AND EXISTS (SELECT 1 FROM e WHERE k = l_orderkey AND id = object_id)""",
    "relation_complete": f"SELECT l_orderkey, l_linenumber, {_BLANK.format(c='l_suppkey', k=7)} AS subject_id, {_BLANK.format(c='l_partkey', k=5)} AS object_id, l_returnflag AS relation_type FROM lineitem WHERE l_suppkey % 7 > 1 AND l_partkey % 5 > 1 AND l_returnflag <> 'R'",
    "extraction_statistics": "SELECT count(*) AS processed, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS extracted, CAST(sum(l_partkey) AS BIGINT) AS tokens, sum(l_linenumber / 4) AS cost, count(*) FILTER (l_returnflag = 'R') AS errors, CAST(sum(l_linenumber) AS BIGINT) AS failures FROM lineitem",
    "mention_entities": "SELECT 'C' || CAST(c_custkey AS VARCHAR) AS canonical_id, CASE WHEN c_custkey % 3 > 0 THEN c_name ELSE c_mktsegment END AS label, CASE WHEN c_custkey % 4 > 0 THEN 'segment' ELSE 'Unknown' END AS entity_type, CASE WHEN c_custkey % 2 > 0 THEN 'OWN' ELSE 'UMLS' END AS source_ontology FROM customer WHERE c_custkey % 5 > 0",
    "factual_mentions": "SELECT p_partkey, lower(p_type) AS mention FROM part WHERE lower(p_type) IN (SELECT lower(p_type) FROM part WHERE p_size % 3 = 1)",
    "example_counts": " UNION ALL ".join(f"SELECT '{t}' AS kind, count(*) AS n FROM {t}" for t in ("documents", "labels", "conversations")),
    "nearest_facts": f"WITH {V._E}, {V._NEAR} SELECT query_id, rank, id FROM ranked WHERE rank <= 3 AND query_id % 30 > 0",
    "fact_texts": f"WITH {FACTS_SQL} SELECT fact_id, subject_id || ' ' || relation_type || CASE WHEN confidence < 0.95 THEN ' ' || object_id ELSE '' END AS text FROM facts",
    "training_rows": f"""WITH {V._E}, d AS (SELECT conv_id * 1000 + turn AS doc_id, list_filter(string_split(regexp_replace(text, '[^A-Za-z ]', '', 'g'), ' '), lambda w: w <> '') AS w FROM conversations),
      m AS (SELECT doc_id, unnest([doc_id % 60, doc_id % 7]) AS id FROM d WHERE doc_id % 4 > 0), s AS (SELECT doc_id, pos, avg(x) AS x FROM (SELECT doc_id, unnest(v) AS x, unnest(range(0, len(v))) AS pos FROM m JOIN e USING (id)) GROUP BY doc_id, pos),
      p AS (SELECT doc_id, max(x) FILTER (pos = 0) / sqrt(sum(x * x)) AS x FROM s GROUP BY doc_id), v AS (SELECT id, v[1] AS x FROM e)
      SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n, CAST(list_sum(list_transform(w, lambda t: length(t) % 2)) AS BIGINT) AS ones, TRUE AS ignored, round(coalesce(p.x, 0), 6) AS positive, round(CASE WHEN d.doc_id % 4 >= 1 THEN a.x ELSE 0 END, 6) AS negative_1, round(CASE WHEN d.doc_id % 4 >= 3 THEN c.x ELSE 0 END, 6) AS negative_3
      FROM d LEFT JOIN p USING (doc_id) LEFT JOIN v a ON a.id = (d.doc_id + 1) % 50 LEFT JOIN v c ON c.id = (d.doc_id + 3) % 50 WHERE len(w) > 0""",
}
