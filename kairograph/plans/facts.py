"""Queries on the fact store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.operators import clusters
from kairograph.operators import facts as K
from kairograph.operators import temporal as T
from kairograph.plans.fixtures import CLOSED_SQL, FACTS_SQL, FAULTY_SQL, base_facts, closed_facts, closed_versions, facts, faulty_facts, faulty_versions, named, names, table, versions
from kairograph.sources.shared import written

SHOWN = ["fact_id", "family_key", "subject_id", "relation_type", "object_id", "valid_from", "confidence"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts valid on 1 June 1998 by relation."""
    return T.resolve_at(closed_facts(spark, sf_dir), "1998-06-01").groupBy("relation_type").agg(F.count(F.lit(1)).alias("n"))


def fact_build(spark, sf_dir):
    return base_facts(spark, sf_dir).select(SHOWN)


def fact_import_stats(spark, sf_dir):
    new = K.with_ids(facts(spark, sf_dir))
    return K.import_statistics(new, new.filter("valid_from < '1996-01-01'"))


def fact_append(spark, sf_dir):
    new = facts(spark, sf_dir).select(*K.FAMILY, "valid_from", "confidence")
    return named(K.append_facts(new, new.filter("valid_from < '1996-01-01'"), K.FAMILY)).select(SHOWN)


def fact_current(spark, sf_dir):
    """Families of more than a thousand versions by time cells."""
    return named(T.resolve_current(K.close_intervals(written(versions(spark, sf_dir), "facts"), 1000, family=K.FAMILY))).select(SHOWN)


def fact_history(spark, sf_dir):
    """In the order of starts and ids; ids are sorted as bytes, which is the order of their hex digits at half the size."""
    f = closed_facts(spark, sf_dir).select(F.unhex("fact_id").alias("fact_id"), "valid_from", "valid_to")
    return T.resolve_history(f).select(F.lower(F.hex("fact_id")).alias("fact_id"), "valid_from", "valid_to")


def _probes(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("S"), (F.col("o_custkey") % 100).cast("string")).alias("subject_id"), F.col("o_orderdate").cast("date").alias("as_of"))


def _asked(probes):
    """The subjects of the probes, a hundred at most: facts of others meet no probe and needn't be dealt."""
    return F.broadcast(probes.select("subject_id").distinct())


def fact_resolve_rows(spark, sf_dir):
    """Every order asks for its supplier's facts in a mode of its own."""
    modes = F.element_at(F.array(F.lit("current"), F.lit("AT_TIMESTAMP"), F.lit("History")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    probes = _probes(spark, sf_dir).withColumn("mode", modes)
    known = T.numbered(closed_facts(spark, sf_dir, _asked(probes)).select("subject_id", "valid_from", "valid_to", "fact_id"), "subject_id")
    return T.first_of(T.resolve_rows(probes.join(known, "subject_id")), known, "subject_id", "o_orderkey")


def version_edges_adjacent(spark, sf_dir):
    return K.version_edges(written(versions(spark, sf_dir).drop("confidence"), "facts"), cell_rows=1000, family=K.FAMILY)


def version_edges_all_pairs(spark, sf_dir):
    return K.older_versions(versions(spark, sf_dir))


def version_edges_missing(spark, sf_dir):
    f = written(versions(spark, sf_dir).drop("confidence"), "facts")
    return K.version_edges(f, existing=K.version_edges(f, family=K.FAMILY).filter(F.col("newer") < "8"), family=K.FAMILY)


def version_chain(spark, sf_dir):
    return K.with_ids(K.version_chain(versions(spark, sf_dir), K.FAMILY)).select("fact_id", F.size("version_chain").cast("long").alias("n"), F.array_join("version_chain", ",").alias("chain"))


def supersede(spark, sf_dir):
    """Old versions of the facts of every tenth supplier end on 1 January 2003."""
    f = written(closed_versions(spark, sf_dir), "facts")
    old = T.resolve_current(f).filter("cast(substring(subject_id, 2) as long) % 10 = 5")
    new = old.withColumnRenamed("valid_from", "old_from").withColumn("valid_from", F.lit("2003-01-01").cast("date"))
    after, _, _ = K.supersede(f, new, K.FAMILY)
    return after.select(K.fact_id().alias("fact_id"), "valid_from", "valid_to")


def supersede_edges(spark, sf_dir):
    f = base_facts(spark, sf_dir)
    new = K.with_ids(f.withColumn("old_fact_id", F.when(F.col("fact_id") < "4", "none").otherwise(F.col("fact_id"))).withColumn("valid_from", F.lit("2003-01-01").cast("date")))
    _, edges, missing = K.supersede(f, new)
    return edges.select(F.col("older").alias("old_fact_id"), F.lit("edge").alias("kind")).unionAll(missing.select("old_fact_id", F.lit("missing")))


def has_fact_edges(spark, sf_dir):
    return K.has_fact_edges(base_facts(spark, sf_dir))


def entities_of_facts(spark, sf_dir):
    return K.entities_of(base_facts(spark, sf_dir))


def asof_join(spark, sf_dir):
    probes = _probes(spark, sf_dir)
    known = T.numbered(closed_facts(spark, sf_dir, _asked(probes)).select("subject_id", "valid_from", "valid_to", "fact_id"), "subject_id")
    return T.first_of(T.as_of_join(probes, known, "subject_id"), known, "subject_id", "o_orderkey")


def asof_latest(spark, sf_dir):
    probes = _probes(spark, sf_dir)
    known = written(closed_facts(spark, sf_dir, _asked(probes)).select("subject_id", "fact_id", "valid_from", "valid_to"), "facts")
    return T.latest_as_of(probes, known, "subject_id", "o_orderkey")


def fact_by_id(spark, sf_dir):
    f = base_facts(spark, sf_dir)
    return K.facts_by_id(f, f.filter("object_id = 'Brand#11'")).select(SHOWN)


def facts_for_entity(spark, sf_dir):
    """The twenty latest facts of every brand and supplier."""
    e = table(spark, sf_dir, "part").select(F.col("p_brand").alias("entity_id")).union(table(spark, sf_dir, "supplier").selectExpr("'S' || s_suppkey"))
    return K.facts_for_entities(closed_facts(spark, sf_dir), e, limit=20).select("entity_id", "fact_id", F.col("position").cast("long").alias("position"), "total_count")


def facts_between(spark, sf_dir):
    pairs = table(spark, sf_dir, "supplier").selectExpr("'Brand#1' || (s_suppkey % 5 + 1) as a", "'S' || s_suppkey as b")
    return K.facts_between(closed_facts(spark, sf_dir), pairs).select("fact_id", "subject_id", "object_id")


def facts_between_directed(spark, sf_dir):
    pairs = table(spark, sf_dir, "supplier").selectExpr("'S' || s_suppkey as a", "'Brand#1' || (s_suppkey % 5 + 1) as b")
    return K.facts_between(closed_facts(spark, sf_dir), pairs, directed=True).select("fact_id", "subject_id", "object_id")


def entity_subgraph_2hop(spark, sf_dir):
    """Two hops from every twentieth supplier, over all facts."""
    seeds = table(spark, sf_dir, "supplier").filter("s_suppkey % 20 = 0").selectExpr("'S' || s_suppkey as entity_id")
    return K.entity_subgraph(versions(spark, sf_dir), seeds, 2, K.FAMILY).select("seed", "fact_id", F.col("hop").cast("long").alias("hop"))


_BORN = (K.FAMILY, ("born",), names)


def consistency_report(spark, sf_dir):
    return T.consistency_report(faulty_versions(spark, sf_dir), _BORN)


def consistency_clean(spark, sf_dir):
    return T.consistency_report(closed_versions(spark, sf_dir).withColumn("born", F.col("valid_from")), _BORN).groupBy("check").agg(F.count(F.lit(1)).alias("n"))


def envelope_check(spark, sf_dir):
    good, bad = K.split_envelopes(faulty_facts(spark, sf_dir))
    tag = lambda d, k: d.select("fact_id", F.lit(k).alias("kind"))
    return tag(good, "good").unionAll(tag(bad, "bad"))


def cluster_summary(spark, sf_dir):
    f = clusters.families(versions(spark, sf_dir))
    return clusters.summary(clusters.by_entity(f)).select("cluster_id", "size", F.array_join("entities", ",").alias("entities"), F.array_join("relations", ",").alias("relations"))


def cluster_by_relation(spark, sf_dir):
    f = clusters.families(versions(spark, sf_dir))
    return clusters.sizes(clusters.by_relation(f)).select("cluster_id", "size", "n_entities")


def cluster_pages(spark, sf_dir):
    """How the entities of each relation fall into pages of twenty."""
    f = clusters.families(versions(spark, sf_dir))
    pages = clusters.entity_pages(clusters.by_relation(f), page=20)
    return pages.select("cluster_id", F.explode("entities").alias("entity"), (F.size("entities") <= 20).alias("bounded"))


def version_pages(spark, sf_dir):
    """The place of every version in its family's chain, from pages of three."""
    pages = K.chain_pages(written(versions(spark, sf_dir).drop("confidence"), "facts"), 3, family=K.FAMILY)
    return pages.select("family_key", F.posexplode("fact_ids").alias("at", "fact_id"), "first").select("family_key", "fact_id", (F.col("first") + F.col("at")).alias("place"))


def relation_coercion(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "click", " treats").when(F.col("event_type") == "view", "Binds_To").otherwise(F.col("event_type")).alias("relation_type"))
    good, bad = K.coerce_relations(rows)
    return good.withColumn("known", F.lit(True)).unionAll(bad.withColumn("known", F.lit(False)))


def fact_export(spark, sf_dir):
    return K.exported(closed_facts(spark, sf_dir).withColumn("confidence", F.when(F.col("confidence") < 0.95, F.col("confidence")))).drop("subject_label", "object_label")


QUERIES = {
    k: v for k, v in globals().items()
    if k in """flagship fact_build fact_import_stats fact_append fact_current fact_history fact_resolve_rows version_edges_adjacent version_edges_all_pairs version_edges_missing
    version_chain supersede supersede_edges has_fact_edges entities_of_facts asof_join asof_latest fact_by_id facts_for_entity facts_between facts_between_directed entity_subgraph_2hop
    consistency_report consistency_clean envelope_check cluster_summary cluster_by_relation cluster_pages version_pages relation_coercion fact_export""".split()
}
QUERIES["fact_at"] = QUERIES.pop("flagship")

_SHOWN = "fact_id, family_key, subject_id, relation_type, object_id, valid_from, confidence"
_PROBES = "probes AS (SELECT o_orderkey, 'S' || CAST(o_custkey % 100 AS VARCHAR) AS subject_id, CAST(o_orderdate AS DATE) AS as_of FROM orders)"
_REPORT = """
SELECT family_key, 'multiple_current' AS "check", CAST(NULL AS VARCHAR) AS fact_id, CAST(count(*) AS VARCHAR) AS other_fact_id FROM {t} WHERE valid_to IS NULL GROUP BY family_key HAVING count(*) > 1
UNION ALL SELECT family_key, 'inverted', fact_id, NULL FROM {t} WHERE valid_from >= valid_to
UNION ALL SELECT a.family_key, 'overlap', a.fact_id, b.fact_id FROM {t} a JOIN {t} b ON a.family_key = b.family_key AND (a.valid_from, a.fact_id) < (b.valid_from, b.fact_id)
  AND a.valid_from < coalesce(b.valid_to, DATE '9999-12-31') AND b.valid_from < coalesce(a.valid_to, DATE '9999-12-31')
UNION ALL SELECT family_key, 'gap', fact_id, NULL FROM {t} c WHERE valid_to IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM {t} n WHERE n.family_key = c.family_key AND n.valid_from = c.valid_to AND n.fact_id <> c.fact_id)
  AND EXISTS (SELECT 1 FROM {t} n WHERE n.family_key = c.family_key AND n.valid_from > c.valid_from AND n.fact_id <> c.fact_id)"""
_VALID = "valid_from <= as_of AND (valid_to IS NULL OR as_of < valid_to)"
SQL = {
    "fact_at": f"WITH {CLOSED_SQL} SELECT relation_type, count(*) AS n FROM closed WHERE valid_from <= DATE '1998-06-01' AND (valid_to IS NULL OR valid_to > DATE '1998-06-01') GROUP BY relation_type",
    "fact_build": f"WITH {FACTS_SQL} SELECT {_SHOWN} FROM facts",
    "fact_import_stats": f"WITH {FACTS_SQL}, c AS (SELECT count(*) AS created FROM facts WHERE valid_from >= DATE '1996-01-01'), r AS (SELECT count(*) AS processed FROM raw) SELECT processed, created, processed - created AS deduplicated FROM c, r",
    "fact_append": f"WITH {FACTS_SQL} SELECT {_SHOWN} FROM facts WHERE valid_from >= DATE '1996-01-01'",
    "fact_current": f"WITH {CLOSED_SQL} SELECT {_SHOWN} FROM closed WHERE valid_to IS NULL",
    "fact_history": f"WITH {CLOSED_SQL} SELECT fact_id, valid_from, valid_to FROM closed",
    "fact_resolve_rows": f"""WITH {CLOSED_SQL}, probes AS (SELECT o_orderkey, o_orderkey % 3 AS mode, 'S' || CAST(o_custkey % 100 AS VARCHAR) AS subject_id, CAST(o_orderdate AS DATE) AS as_of FROM orders)
      SELECT o_orderkey, count(*) AS n, min(fact_id) AS least FROM probes JOIN closed USING (subject_id) WHERE CASE mode WHEN 0 THEN valid_to IS NULL WHEN 1 THEN {_VALID} ELSE TRUE END GROUP BY o_orderkey""",
    "version_edges_adjacent": f"WITH {FACTS_SQL}, e AS (SELECT fact_id AS newer, lag(fact_id) OVER (PARTITION BY family_key ORDER BY valid_from) AS older FROM facts) SELECT * FROM e WHERE older IS NOT NULL",
    "version_edges_all_pairs": f"WITH {FACTS_SQL} SELECT a.fact_id AS newer, count(*) AS n, min(b.fact_id) AS least FROM facts a JOIN facts b ON a.family_key = b.family_key AND a.valid_from > b.valid_from GROUP BY a.fact_id",
    "version_edges_missing": f"WITH {FACTS_SQL}, e AS (SELECT fact_id AS newer, lag(fact_id) OVER (PARTITION BY family_key ORDER BY valid_from) AS older FROM facts) SELECT * FROM e WHERE older IS NOT NULL AND newer >= '8'",
    "version_chain": f"WITH {FACTS_SQL}, c AS (SELECT family_key, count(*) AS n, string_agg(fact_id, ',' ORDER BY valid_from) AS chain FROM facts GROUP BY family_key) SELECT fact_id, n, chain FROM facts JOIN c USING (family_key)",
    "supersede": f"""WITH {CLOSED_SQL}, old AS (SELECT * FROM closed WHERE valid_to IS NULL AND CAST(substr(subject_id, 2) AS BIGINT) % 10 = 5)
      SELECT fact_id, valid_from, CASE WHEN fact_id IN (SELECT fact_id FROM old) THEN DATE '2003-01-01' ELSE valid_to END AS valid_to FROM closed
      UNION ALL SELECT sha256(subject_id || '||' || relation_type || '||' || object_id || '||2003-01-01'), DATE '2003-01-01', NULL FROM old""",
    "supersede_edges": f"WITH {FACTS_SQL} SELECT CASE WHEN fact_id < '4' THEN 'none' ELSE fact_id END AS old_fact_id, CASE WHEN fact_id < '4' THEN 'missing' ELSE 'edge' END AS kind FROM facts",
    "has_fact_edges": f"WITH {FACTS_SQL} SELECT subject_id AS src, fact_id AS dst, 'subject' AS role FROM facts UNION ALL SELECT fact_id, object_id, 'object' FROM facts",
    "entities_of_facts": f"WITH {FACTS_SQL} SELECT DISTINCT e AS canonical_id, e AS label FROM (SELECT subject_id AS e FROM facts UNION ALL SELECT object_id FROM facts)",
    "asof_join": f"WITH {CLOSED_SQL}, {_PROBES} SELECT o_orderkey, count(*) AS n, min(fact_id) AS least FROM probes JOIN closed USING (subject_id) WHERE {_VALID} GROUP BY o_orderkey",
    "asof_latest": f"WITH {CLOSED_SQL}, {_PROBES}, r AS (SELECT o_orderkey, fact_id, valid_from, row_number() OVER (PARTITION BY o_orderkey ORDER BY valid_from DESC, fact_id DESC) AS rn FROM probes JOIN closed USING (subject_id) WHERE {_VALID}) SELECT o_orderkey, fact_id, valid_from FROM r WHERE rn = 1",
    "fact_by_id": f"WITH {FACTS_SQL} SELECT {_SHOWN} FROM facts WHERE object_id = 'Brand#11'",
    "facts_for_entity": f"""WITH {CLOSED_SQL}, wanted AS (SELECT DISTINCT p_brand AS entity_id FROM part UNION SELECT 'S' || CAST(s_suppkey AS VARCHAR) FROM supplier),
      found AS (SELECT entity_id, fact_id, row_number() OVER (PARTITION BY entity_id ORDER BY valid_from DESC, fact_id) AS position, count(*) OVER (PARTITION BY entity_id) AS total_count FROM wanted JOIN closed ON entity_id = subject_id OR entity_id = object_id)
      SELECT * FROM found WHERE position <= 20""",
    "facts_between": f"WITH {CLOSED_SQL}, p AS (SELECT 'Brand#1' || CAST(s_suppkey % 5 + 1 AS VARCHAR) AS a, 'S' || CAST(s_suppkey AS VARCHAR) AS b FROM supplier) SELECT fact_id, subject_id, object_id FROM closed JOIN p ON (subject_id = a AND object_id = b) OR (subject_id = b AND object_id = a)",
    "facts_between_directed": f"WITH {CLOSED_SQL}, p AS (SELECT 'Brand#1' || CAST(s_suppkey % 5 + 1 AS VARCHAR) AS a, 'S' || CAST(s_suppkey AS VARCHAR) AS b FROM supplier) SELECT fact_id, subject_id, object_id FROM closed JOIN p ON subject_id = b AND object_id = a",
    "entity_subgraph_2hop": f"""WITH {CLOSED_SQL}, f AS (SELECT * FROM closed), seeds AS (SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS seed FROM supplier WHERE s_suppkey % 20 = 0),
      h1 AS (SELECT seed, fact_id, subject_id, object_id FROM f JOIN seeds ON subject_id = seed OR object_id = seed),
      e1 AS (SELECT seed, subject_id AS e FROM h1 UNION SELECT seed, object_id FROM h1),
      h2 AS (SELECT DISTINCT seed, fact_id FROM f JOIN e1 ON subject_id = e OR object_id = e)
      SELECT seed, fact_id, CAST(CASE WHEN (seed, fact_id) IN (SELECT seed, fact_id FROM h1) THEN 1 ELSE 2 END AS BIGINT) AS hop FROM h2""",
    "consistency_report": f"WITH {FAULTY_SQL} {_REPORT.format(t='faulty')}",
    "consistency_clean": f"""WITH {CLOSED_SQL} SELECT "check", count(*) AS n FROM ({_REPORT.format(t='closed')}) GROUP BY "check" """,
    "envelope_check": f"WITH {FAULTY_SQL} SELECT fact_id, CASE WHEN valid_from >= valid_to THEN 'bad' ELSE 'good' END AS kind FROM faulty",
    "cluster_summary": f"""WITH {FACTS_SQL}, m AS (SELECT subject_id AS cluster_id, fact_id FROM facts UNION SELECT object_id, fact_id FROM facts), j AS (SELECT cluster_id, facts.* FROM m JOIN facts USING (fact_id)),
      e AS (SELECT cluster_id, string_agg(e, ',' ORDER BY e) AS entities FROM (SELECT cluster_id, subject_id AS e FROM j UNION SELECT cluster_id, object_id FROM j) GROUP BY cluster_id),
      r AS (SELECT cluster_id, string_agg(relation_type, ',' ORDER BY relation_type) AS relations FROM (SELECT DISTINCT cluster_id, relation_type FROM j) GROUP BY cluster_id)
      SELECT cluster_id, count(*) AS size, any_value(entities) AS entities, any_value(relations) AS relations FROM j JOIN e USING (cluster_id) JOIN r USING (cluster_id) GROUP BY cluster_id""",
    "cluster_by_relation": f"WITH {FACTS_SQL} SELECT relation_type AS cluster_id, count(*) AS size, count(DISTINCT subject_id) + count(DISTINCT object_id) AS n_entities FROM facts GROUP BY relation_type",
    "cluster_pages": f"WITH {FACTS_SQL} SELECT DISTINCT relation_type AS cluster_id, e AS entity, TRUE AS bounded FROM (SELECT relation_type, subject_id AS e FROM facts UNION ALL SELECT relation_type, object_id FROM facts)",
    "version_pages": f"WITH {FACTS_SQL} SELECT family_key, fact_id, row_number() OVER (PARTITION BY family_key ORDER BY valid_from) - 1 AS place FROM facts",
    "relation_coercion": "SELECT event_id, CASE event_type WHEN 'click' THEN 'TREATS' WHEN 'view' THEN 'BINDS_TO' ELSE upper(event_type) END AS relation_type, event_type IN ('click', 'view') AS known FROM events",
    "fact_export": f"WITH {CLOSED_SQL} SELECT fact_id, subject_id, relation_type, object_id, CAST(valid_from AS VARCHAR) AS valid_from, CAST(valid_to AS VARCHAR) AS valid_to, 'lineitem' AS source, CASE WHEN confidence < 0.95 THEN confidence ELSE 1.0 END AS confidence FROM closed",
}

DATES = {k: ["valid_from"] for k in ("fact_build", "fact_append", "fact_current", "asof_latest", "fact_by_id")} | {k: ["valid_from", "valid_to"] for k in ("fact_history", "supersede")}
