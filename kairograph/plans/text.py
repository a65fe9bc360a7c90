"""Queries on documents: cleaning, chunks, mentions, entities, relations and training examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from kairograph.functions import ids as I
from kairograph.functions import text as T
from kairograph.operators import chunks as C
from kairograph.operators import entities as N
from kairograph.operators import examples as D
from kairograph.operators import relations as L
from kairograph.operators import spans as B
from kairograph.plans.fixtures import table
from kairograph.plans.spans import annotator


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def clean_text(spark, sf_dir):
    noisy = F.concat(F.lit("  [ ] ("), F.lit(" )"), F.col("text"), F.lit("\n\n"))
    return docs(spark, sf_dir).select("doc_id", T.clean_text(noisy).alias("text"))


def word_count(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.word_count("text").cast("long").alias("n"))


def all_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.sha2(T.all_text("lang", F.when(F.col("doc_id") % 2 == 0, F.col("source")), "text"), 256).alias("sha"))


def chunk_merge_tail(spark, sf_dir):
    return C.chunk(docs(spark, sf_dir).select("doc_id", "text"), size=32, overlap=8).select("doc_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), F.col("start_word").cast("long").alias("s"), F.col("end_word").cast("long").alias("e"), F.md5("chunk").alias("md5"))


def chunk_stride(spark, sf_dir):
    return C.chunk(docs(spark, sf_dir).select("doc_id", "text"), mode="stride").select("doc_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), F.md5("chunk").alias("md5"))


def citation_fields(spark, sf_dir):
    citation = F.concat(F.lit("J "), "p_name", F.lit(". "), (F.col("p_partkey") % 300 + 1850).cast("string"), F.lit(" Jan; 2000"))
    return table(spark, sf_dir, "part").select("p_partkey", T.citation_year(citation).cast("long").alias("year"), T.citation_journal(citation).alias("journal"))


def publication_dates(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", T.parse_pub_date((k % 30 + 1990).cast("string"), F.when(k % 5 > 0, (k % 14).cast("string")), F.when(k % 7 > 0, (k % 34).cast("string"))).alias("d"))


def content_ids(spark, sf_dir):
    first = F.substring_index("text", ".", 1)
    return docs(spark, sf_dir).select("doc_id", I.no_cui_id(first, F.col("lang")).alias("no_cui"), I.text_id("text").alias("text_id"), I.response_key(first).alias("key"))


def content_hash_ids(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", I.content_hash_id(F.concat(F.lit(" "), "p_name", F.lit("-("), "p_type", F.lit(")!  x"))).alias("id"))


def gazetteer(spark, sf_dir):
    """Runs of one to three words of the benchmark that start with a long one."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), F.lit(0))
    placed = table(spark, sf_dir, "benchmark").select(words.alias("w")).select(F.explode(F.transform("w", lambda x, i: F.slice("w", i + 1, 3))).alias("w")).filter(F.length(F.col("w")[0]) >= 8)
    names = placed.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w")), lambda n: F.array_join(F.slice("w", 1, n), " "))).alias("name")).distinct()
    return names.select("name", F.concat(F.lit("C"), F.md5("name")).alias("canonical_id"), F.lit("TERM").alias("label"))


def mentions(spark, sf_dir):
    return N.length_filter(N.match_gazetteer(docs(spark, sf_dir), gazetteer(spark, sf_dir)))


def mention_match(spark, sf_dir):
    return mentions(spark, sf_dir).groupBy("doc_id", "canonical_id").agg(F.count(F.lit(1)).alias("n"))


def mention_first(spark, sf_dir):
    found = mentions(spark, sf_dir).withColumn("section_ord", F.lit(0)).select(F.col("doc_id").alias("pmcid"), "canonical_id", "section_ord", "start", "mention")
    return N.first_mentions(found).select("pmcid", "canonical_id", F.lower("mention").alias("mention"))


def entity_rows(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("N"), (F.col("c_custkey") % 25).cast("string")).alias("canonical_id"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_name")).otherwise("").alias("label"),
        F.when(F.col("c_custkey") % 4 > 0, F.col("c_mktsegment")).alias("entity_type"), F.col("c_custkey").alias("seq"), (F.abs("c_acctbal") / 10000).alias("confidence"),
    )


def entity_upsert(spark, sf_dir):
    old = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("canonical_id"), F.col("n_name").alias("label"), F.lit("nation").alias("entity_type"))
    return N.upsert(old.union(table(spark, sf_dir, "region").select("r_name", "r_name", F.lit("region"))), entity_rows(spark, sf_dir))


def entity_upsert_confidence(spark, sf_dir):
    return N.upsert_max_confidence(entity_rows(spark, sf_dir), "canonical_id").select("canonical_id", "label", "seq", "confidence")


def entity_stats(spark, sf_dir):
    rows = entity_rows(spark, sf_dir).withColumn("canonical_id", F.when(F.col("seq") % 5 == 0, F.concat(F.lit("HASH:"), "canonical_id")).when(F.col("seq") % 7 > 0, F.col("canonical_id"))).fillna("none", ["entity_type"])
    return N.statistics(rows).withColumn("mean_confidence", F.round("mean_confidence", 9)).withColumn("linked_ratio", F.round("linked_ratio", 9))


def entity_types(spark, sf_dir):
    names = F.element_at(F.array(*map(F.lit, ("Rituximab", "TP53", "lung cancer", "word"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    types = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("T999"), F.concat(F.lit("T0"), (F.col("p_partkey") % 60 + 10).cast("string")))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "part").select("p_partkey", N.entity_type(types, names).alias("kind"))


def entity_linking(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    candidates = items.select(F.col("l_orderkey").alias("mention_id"), F.col("l_partkey").alias("concept_id"), (1 - F.col("l_discount") * 5).alias("score"))
    knowledge = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("concept_id"), F.col("p_name").alias("canonical_name"), F.array("p_type").alias("semantic_types"), F.split("p_name", " ").alias("aliases"), F.lit(None).cast("string").alias("definition"))
    return N.link(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("mention_id")), candidates, knowledge).select("mention_id", "concept_id", "canonical_name")


def entity_lookup(spark, sf_dir):
    wanted = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), (F.col("n_nationkey") * 2).cast("string")).alias("canonical_id"))
    known = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("canonical_id"), "n_name")
    return N.lookup(known, wanted)


def relation_responses(spark, sf_dir):
    """A response per order with its lines as items, plain, fenced, within words, single, or broken."""
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.struct(
            F.concat(F.lit("S"), "l_suppkey").alias("subject_id"), F.lit("s").alias("subject_label"), F.when(F.col("l_returnflag") == "A", "treats").when(F.col("l_returnflag") == "N", "INHIBITS").otherwise("likes").alias("relation_type"),
            F.concat(F.lit("P"), "l_partkey").alias("object_id"), F.when(F.col("l_linestatus") == "O", "o").alias("object_label"),
        ).alias("item"),
    )
    rows = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "item"))).alias("x"))
    body = F.to_json(F.transform("x", lambda v: v["item"]))
    one = F.to_json(F.col("x")[0]["item"])
    kind = F.floor(F.col("l_orderkey") / 10) % 5
    response = F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nDone"))).when(kind == 2, F.concat(F.lit("I found "), body, F.lit(" in it"))).when(kind == 3, one).otherwise(F.concat(F.lit("{"), body))
    valid = F.transform(F.slice("x", 1, 2), lambda v: v["item"]["subject_id"])
    return rows.select("l_orderkey", response.alias("response"), F.concat(valid, F.transform("x", lambda v: v["item"]["object_id"])).alias("valid_ids"))


def relation_parse(spark, sf_dir):
    return L.parse_responses(relation_responses(spark, sf_dir)).select("l_orderkey", "subject_id", "relation_type", "object_id", "confidence", "is_negated")


def relation_validation(spark, sf_dir):
    good, bad = L.validate(L.parse_responses(relation_responses(spark, sf_dir)))
    return good.select("l_orderkey", "subject_id", "object_id", "relation_type", F.lit("ok").alias("reason")).unionAll(bad.select("l_orderkey", "subject_id", "object_id", "relation_type", "reason"))


def relation_facts(spark, sf_dir):
    good, _ = L.validate(L.parse_responses(relation_responses(spark, sf_dir)))
    papers = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pmcid"), F.col("o_orderdate").cast("date").alias("publication_date"))
    return L.to_facts(good.withColumnRenamed("l_orderkey", "pmcid"), papers, as_of="2024-01-01").select("fact_id", "family_key", "valid_from", F.element_at("metadata", "subject_ontology").alias("ontology"))


def relation_distribution(spark, sf_dir):
    return L.distribution(table(spark, sf_dir, "part"), "p_type", 10)


def relation_confidence(spark, sf_dir):
    return L.confidence_histogram(table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 10).alias("confidence")))


def resume_pending(spark, sf_dir):
    prompts = docs(spark, sf_dir).select("doc_id", I.response_key("text").alias("prompt_key"))
    cache = docs(spark, sf_dir).filter("doc_id % 3 = 0").select(I.response_key("text").alias("prompt_key"), F.lit("stored").alias("response")).distinct()
    hit, wait = L.split_cached(prompts, cache)
    return hit.select("doc_id", "response").unionAll(wait.select("doc_id", F.lit(None).cast("string")))


def exact_split(spark, sf_dir):
    split = D.exact_split(docs(spark, sf_dir).select("doc_id", "source"), "doc_id")
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def stratified_split(spark, sf_dir):
    split = D.exact_split(docs(spark, sf_dir).select("doc_id", "source"), "doc_id", by=("source",))
    return split.groupBy("source", "split").agg(F.count(F.lit(1)).alias("n"))


def router_examples(spark, sf_dir):
    rows = D.router_examples_of(docs(spark, sf_dir), annotator(spark, sf_dir, 40, 15, 7), most=None)
    return rows.select("doc_id", F.size("input_ids").cast("long").alias("n"), F.aggregate("router_labels", F.lit(0).cast("long"), lambda a, x: a + x).alias("ones"))


def token_table(spark, sf_dir):
    return D.token_table(docs(spark, sf_dir).select("doc_id", "text"), most=None).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("start_char").alias("starts"), F.sum("end_char").alias("ends"))


def padded_examples(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.sequence(F.lit(1), (F.col("vec_id") % 30 + 1).cast("int")).alias("ids"))
    return rows.select("vec_id", F.array_join(D.fit_length("ids", 16), ",").alias("ids"), F.array_join(D.fit_length("ids", 20, D.IGNORED), ",").alias("labels"))


_NAMES = """clean_text word_count all_text chunk_merge_tail chunk_stride citation_fields publication_dates content_ids content_hash_ids mention_match mention_first entity_upsert entity_upsert_confidence entity_stats
entity_types entity_linking entity_lookup relation_parse relation_validation relation_facts relation_distribution relation_confidence resume_pending exact_split stratified_split router_examples token_table padded_examples""".split()
QUERIES = {k: globals()[k] for k in _NAMES}
DATES = {"publication_dates": ["d"], "relation_facts": ["valid_from"]}

_W = "w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents)"
_ROWS = """x AS (SELECT 'N' || CAST(c_custkey % 25 AS VARCHAR) AS canonical_id, CASE WHEN c_custkey % 3 > 0 THEN c_name ELSE '' END AS label, CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment END AS entity_type, c_custkey AS seq, abs(c_acctbal) / 10000 AS confidence FROM customer)"""
_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{M}\p{Nl}\p{Nd}\p{Pc}\x{200c}\x{200d}]+')"
_RUNS = "SELECT {key} array_to_string(w[i : i + n - 1], ' ') AS name, w[i] AS first FROM (SELECT {key} w, i, unnest([1, 2, 3]) AS n FROM (SELECT {key} w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT {key} {words} AS w FROM {table}))) WHERE i + n - 1 <= len(w)"
_MENTIONS = f"""g AS (SELECT DISTINCT name FROM ({_RUNS.format(key='', words=_WORDS, table='benchmark')}) WHERE length(first) >= 8), t AS ({_RUNS.format(key='doc_id,', words=_WORDS, table='documents')}),
m AS (SELECT doc_id, 'C' || md5(name) AS canonical_id, name FROM t JOIN g USING (name) WHERE length(name) BETWEEN 2 AND 100)"""
_ITEMS = """i AS (SELECT l_orderkey, l_linenumber, 'S' || CAST(l_suppkey AS VARCHAR) AS subject_id, CASE l_returnflag WHEN 'A' THEN 'treats' WHEN 'N' THEN 'INHIBITS' ELSE 'likes' END AS relation_type, 'P' || CAST(l_partkey AS VARCHAR) AS object_id,
  l_linestatus = 'O' AS labelled, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'S' || CAST(l_suppkey AS VARCHAR), CASE l_returnflag WHEN 'A' THEN 'treats' WHEN 'N' THEN 'INHIBITS' ELSE 'likes' END, 'P' || CAST(l_partkey AS VARCHAR)) AS rn FROM lineitem),
p AS (SELECT * FROM i WHERE CASE l_orderkey // 10 % 5 WHEN 3 THEN rn = 1 WHEN 4 THEN TRUE ELSE TRUE END),
j AS (SELECT p.*, CASE WHEN NOT labelled THEN 'missing field' WHEN relation_type = 'likes' THEN 'unknown relation type' WHEN NOT EXISTS (SELECT 1 FROM i v WHERE v.l_orderkey = p.l_orderkey AND (v.rn <= 2 AND v.subject_id = p.subject_id OR v.object_id = p.subject_id)) THEN 'unknown subject' ELSE 'ok' END AS reason FROM p)"""
SQL = {
    "clean_text": "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS text FROM documents",
    "word_count": f"WITH {_W} SELECT doc_id, len(w) AS n FROM w",
    "all_text": "SELECT doc_id, sha256(lang || chr(10) || chr(10) || CASE WHEN doc_id % 2 = 0 THEN source || chr(10) || chr(10) ELSE '' END || text) AS sha FROM documents",
    "chunk_merge_tail": f"WITH {_W}, c AS (SELECT doc_id, w, unnest(range(0, 1 + CAST(ceil(greatest(len(w) - 32, 0) / 24) AS BIGINT))) AS chunk_idx FROM w WHERE len(w) > 0) SELECT doc_id, chunk_idx, chunk_idx * 24 AS s, least(chunk_idx * 24 + 32, len(w)) AS e, md5(array_to_string(list_slice(w, chunk_idx * 24 + 1, chunk_idx * 24 + 32), ' ')) AS md5 FROM c",
    "chunk_stride": f"WITH {_W}, c AS (SELECT doc_id, text, w, unnest(range(0, CASE WHEN len(w) <= 256 THEN 1 ELSE (len(w) - 1) // 192 + 1 END)) AS chunk_idx FROM w WHERE len(w) > 0) SELECT doc_id, chunk_idx, md5(CASE WHEN len(w) <= 256 THEN text ELSE array_to_string(list_slice(w, chunk_idx * 192 + 1, chunk_idx * 192 + 256), ' ') END) AS md5 FROM c",
    "citation_fields": "WITH y AS (SELECT p_partkey, p_name, p_partkey % 300 + 1850 AS y FROM part) SELECT p_partkey, CASE WHEN y BETWEEN 1900 AND 2099 THEN y ELSE 2000 END AS year, CASE WHEN y BETWEEN 1900 AND 2099 THEN 'J ' || p_name ELSE 'J ' || p_name || '. ' || CAST(y AS VARCHAR) || ' Jan;' END AS journal FROM y",
    "publication_dates": "SELECT p_partkey, TRY_CAST(printf('%04d-%02d-%02d', p_partkey % 30 + 1990, CASE WHEN p_partkey % 5 > 0 THEN least(12, greatest(1, p_partkey % 14)) ELSE 1 END, CASE WHEN p_partkey % 7 > 0 THEN least(31, greatest(1, p_partkey % 34)) ELSE 1 END) AS DATE) AS d FROM part",
    "content_ids": "SELECT doc_id, 'NOCUI_' || substr(sha256(string_split(text, '.')[1] || '||' || lang), 1, 16) AS no_cui, substr(md5(text), 1, 12) AS text_id, substr(sha256(string_split(text, '.')[1]), 1, 16) AS key FROM documents",
    "content_hash_ids": "SELECT p_partkey, 'HASH:' || substr(sha256(regexp_replace(regexp_replace(lower(p_name || '-(' || p_type || ')!  x'), '[^a-z0-9_\\s]', '', 'g'), '\\s+', '_', 'g')), 1, 16) AS id FROM part",
    "mention_match": f"WITH {_MENTIONS} SELECT doc_id, canonical_id, count(*) AS n FROM m GROUP BY doc_id, canonical_id",
    "mention_first": f"WITH {_MENTIONS} SELECT DISTINCT doc_id AS pmcid, canonical_id, name AS mention FROM m",
    "entity_upsert": f"""WITH {_ROWS}, o AS (SELECT 'N' || CAST(n_nationkey AS VARCHAR) AS canonical_id, n_name AS label, 'nation' AS entity_type, -1 AS seq FROM nation UNION ALL SELECT r_name, r_name, 'region', -1 FROM region UNION ALL SELECT canonical_id, label, entity_type, seq FROM x)
      SELECT canonical_id, arg_max(label, seq) FILTER (label <> '') AS label, arg_max(entity_type, seq) FILTER (entity_type <> '') AS entity_type FROM o GROUP BY canonical_id""",
    "entity_upsert_confidence": f"WITH {_ROWS} SELECT canonical_id, arg_min(label, seq) AS label, min(seq) AS seq, max(confidence) AS confidence FROM x GROUP BY canonical_id",
    "entity_stats": f"""WITH {_ROWS}, y AS (SELECT coalesce(entity_type, 'none') AS entity_type, confidence, CASE WHEN seq % 5 = 0 THEN 'HASH:' WHEN seq % 7 > 0 THEN 'C' END AS c FROM x)
      SELECT entity_type, count(*) AS n, count(*) FILTER (c = 'C') AS linked, count(*) FILTER (c = 'HASH:') AS hashed, round(avg(CAST(coalesce(c = 'C', FALSE) AS INT)), 9) AS linked_ratio, round(avg(confidence), 9) AS mean_confidence FROM y GROUP BY ROLLUP (entity_type)""",
    "entity_types": "WITH t AS (SELECT MAP {" + ", ".join(f"'{i}': '{kind}'" for i, kind in N.SEMANTIC_TYPES.items()) + "} AS types)"
    + " SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 = 0 THEN types['T0' || CAST(p_partkey % 60 + 10 AS VARCHAR)] END, ['drug', 'gene', 'disease', 'unknown'][p_partkey % 4 + 1]) AS kind FROM part, t",
    "entity_linking": """WITH c AS (SELECT l_orderkey AS mention_id, l_partkey AS concept_id, 1 - l_discount * 5 AS score, row_number() OVER (PARTITION BY l_orderkey ORDER BY 1 - l_discount * 5 DESC, l_partkey) AS rn FROM lineitem)
      SELECT o_orderkey AS mention_id, concept_id, p_name AS canonical_name FROM orders LEFT JOIN (SELECT * FROM c WHERE rn = 1 AND score >= 0.7::DOUBLE) ON mention_id = o_orderkey LEFT JOIN part ON p_partkey = concept_id""",
    "entity_lookup": "SELECT 'N' || CAST(a.n_nationkey * 2 AS VARCHAR) AS canonical_id, b.n_name FROM nation a LEFT JOIN nation b ON b.n_nationkey = a.n_nationkey * 2",
    "relation_parse": f"WITH {_ITEMS} SELECT l_orderkey, subject_id, relation_type, object_id, 0.8::DOUBLE AS confidence, FALSE AS is_negated FROM p",
    "relation_validation": f"WITH {_ITEMS} SELECT l_orderkey, subject_id, object_id, CASE WHEN reason = 'ok' THEN upper(relation_type) ELSE relation_type END AS relation_type, reason FROM j",
    "relation_facts": f"""WITH {_ITEMS}, f AS (SELECT subject_id, upper(relation_type) AS r, object_id, coalesce(CAST(o_orderdate AS DATE), DATE '2024-01-01') AS valid_from FROM j LEFT JOIN orders ON o_orderkey = l_orderkey WHERE reason = 'ok')
      SELECT sha256(subject_id || '||' || r || '||' || object_id || '||' || CAST(valid_from AS VARCHAR)) AS fact_id, sha256(subject_id || '||' || r || '||' || object_id || '||FAMILY') AS family_key, valid_from, 'UMLS' AS ontology FROM f""",
    "relation_distribution": "SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 10",
    "relation_confidence": "SELECT CAST(least(9, floor(round(l_discount * 10 * 10, 9))) AS INT) AS bucket, count(*) AS n FROM lineitem GROUP BY 1",
    "resume_pending": "SELECT doc_id, CASE WHEN text IN (SELECT text FROM documents WHERE doc_id % 3 = 0) THEN 'stored' END AS response FROM documents",
    "exact_split": "SELECT 'val' AS split, CAST(floor(count(*) * 0.2::DOUBLE) AS BIGINT) AS n FROM documents UNION ALL SELECT 'train', count(*) - CAST(floor(count(*) * 0.2::DOUBLE) AS BIGINT) FROM documents",
    "stratified_split": "WITH s AS (SELECT source, count(*) AS n, CAST(floor(count(*) * 0.2::DOUBLE) AS BIGINT) AS v FROM documents GROUP BY source) SELECT source, 'val' AS split, v AS n FROM s WHERE v > 0 UNION ALL SELECT source, 'train', n - v FROM s WHERE n > v",
    "token_table": r"""WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(text, '(?s).'), lambda c: CASE WHEN regexp_matches(c, '[\p{L}\p{M}\p{Nl}\p{Nd}\p{Pc}\x{200c}\x{200d}]') THEN 'w' WHEN regexp_matches(c, '[\x{9}-\x{d}\x{85}\p{Z}]') THEN ' ' ELSE '.' END) AS k FROM documents),
      c AS (SELECT doc_id, i, k[i] AS ch, coalesce(k[i - 1], ' ') AS b, coalesce(k[i + 1], ' ') AS a FROM (SELECT doc_id, k, unnest(range(1, len(k) + 1)) AS i FROM d))
      SELECT doc_id, count(*) FILTER (ch = '.' OR (ch = 'w' AND b <> 'w')) AS n, CAST(sum(i - 1) FILTER (ch = '.' OR (ch = 'w' AND b <> 'w')) AS BIGINT) AS starts, CAST(sum(i) FILTER (ch = '.' OR (ch = 'w' AND a <> 'w')) AS BIGINT) AS ends FROM c WHERE ch <> ' ' GROUP BY doc_id""",
    "padded_examples": "WITH r AS (SELECT vec_id, range(1, vec_id % 30 + 2) AS x FROM embeddings) SELECT vec_id, array_to_string(list_resize(x, 16, 0), ',') AS ids, array_to_string(list_resize(x, 20, -100), ',') AS labels FROM r",
}
