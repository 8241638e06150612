"""Adapters from the driver's tables to operator inputs, as SQL that Spark and DuckDB read alike.

Each text is a projection or join of raw tables named in braces: Spark gets
DataFrames for the braces, DuckDB the plain names. The same texts are the first
part of every oracle query, so both engines start from equal inputs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

LIFT: dict[str, str] = {
    "works": """SELECT concat('eli/cc/', c_custkey) AS work, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE concat(c_nationkey, '.', c_custkey % 10) END AS legal_id,
        concat('enforcement-status/', CASE WHEN c_acctbal < 0 THEN 3 ELSE 0 END) AS status, c_mktsegment AS type_document, x.date_document, x.date_entry, x.date_no_longer, x.date_end
        FROM {customer} LEFT JOIN (SELECT o_custkey AS k, min(CAST(o_orderdate AS DATE)) AS date_entry, min(CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(o_orderdate AS DATE) END) AS date_document,
        max(CASE WHEN o_orderstatus = 'F' AND o_orderkey % 5 = 0 THEN CAST(o_orderdate AS DATE) END) AS date_no_longer, max(CASE WHEN o_orderstatus = 'O' AND o_orderkey % 7 = 0 THEN CAST(o_orderdate AS DATE) END) AS date_end
        FROM {orders} WHERE o_custkey % 3 <> 0 GROUP BY o_custkey) x ON x.k = c_custkey""",
    "titles": """SELECT concat('eli/cc/', c_custkey) AS work, 'de' AS lang, concat(c_name, ' ', c_mktsegment) AS title FROM {customer} WHERE c_custkey % 11 <> 0
        UNION ALL SELECT concat('eli/cc/', c_custkey), 'fr', concat(c_mktsegment, ' ', c_name) FROM {customer} WHERE c_custkey % 2 = 0""",
    "consolidations": "SELECT concat('eli/cc/', o_custkey) AS work, concat('eli/cc/', o_custkey, '/v', o_orderkey) AS cons, CAST(o_orderdate AS DATE) AS date FROM {orders}",
    "expressions": """SELECT DISTINCT concat('eli/cc/', o_custkey, '/v', o_orderkey) AS cons, concat('x/', o_orderkey, '/', l_returnflag) AS expr,
        CASE l_returnflag WHEN 'A' THEN 'de' WHEN 'N' THEN 'fr' ELSE 'it' END AS lang FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "manifestations": """SELECT concat('x/', l_orderkey, '/', l_returnflag) AS expr, concat('https://files.example.org/', l_orderkey, '/', l_returnflag, CASE l_linenumber % 3 WHEN 0 THEN '/xml/' WHEN 1 THEN '/pdf/' ELSE '/html/' END, l_linenumber) AS url FROM {lineitem}""",
    "parts": """SELECT concat('c/', c_custkey) AS child, concat('n/', c_nationkey) AS parent, CASE WHEN c_custkey % 4 = 0 THEN 'subdivision-type/annex' ELSE 'subdivision-type/article' END AS type FROM {customer}
        UNION ALL SELECT concat('n/', n_nationkey), concat('r/', n_regionkey), 'subdivision-type/chapter' FROM {nation}
        UNION ALL SELECT concat('r/', r_regionkey), 'world', NULL FROM {region}""",
    "impacts": """SELECT concat('i/', l_orderkey, '/', l_linenumber) AS impact, concat('eli/oc/', l_suppkey, '/a', l_linenumber) AS source, concat('eli/cc/', l_partkey, '/art_', l_linenumber, '_a') AS target, l_returnflag AS type,
        CAST(l_shipdate AS DATE) AS date, CASE WHEN l_quantity > 40 THEN l_linestatus END AS comment FROM {lineitem}""",
    "citations": "SELECT concat('eli/cc/', l_suppkey) AS source, concat('eli/cc/', l_partkey % 500) AS target, CASE WHEN l_linenumber > 1 THEN concat('ref ', l_linenumber) END AS description FROM {lineitem}",
    "work_topics": "SELECT concat('eli/cc/', c_custkey) AS work, concat('t/', c_nationkey) AS topic FROM {customer} WHERE c_custkey % 5 = 0",
    "topic_labels": "SELECT concat('t/', n_nationkey) AS topic, CASE WHEN n_nationkey % 2 = 0 THEN 'de' ELSE 'fr' END AS lang, n_name AS label FROM {nation}",
    "topic_parents": "SELECT concat('t/', n_nationkey) AS topic, CASE WHEN n_nationkey % 6 <> 0 THEN concat('r/', n_regionkey) END AS parent FROM {nation}",
    "acts": """SELECT DISTINCT concat('eli/oc/', o_orderkey) AS act, concat('eli/cc/', o_custkey) AS work, CAST(o_orderdate AS DATE) AS date, o_orderpriority AS genre, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS responsible,
        concat('memorial/', year(o_orderdate), '-', month(o_orderdate)) AS memorial FROM {orders}""",
    "memorial_parts": "SELECT concat('eli/oc/', o_orderkey) AS act, concat('memorial/', CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10))) AS memorial FROM {orders}",
    "drafts": """SELECT concat('d/', l_orderkey % 5000) AS draft, concat('D', l_orderkey % 5000) AS draft_id, CASE WHEN l_linenumber = 1 THEN concat('P', l_suppkey) END AS parl_id, concat('eli/oc/', l_orderkey) AS act,
        concat('https://example.org', CASE WHEN l_linenumber % 2 = 0 THEN '/eli/fga/' ELSE '/eli/oc/' END, l_partkey) AS result FROM {lineitem}""",
    "fga_results": "SELECT concat('https://example.org/eli/fga/', p_partkey) AS doc, p_type AS genre, CASE WHEN p_size > 10 THEN concat('2001-01-', 10 + p_size % 10) END AS date FROM {part}",
    "tasks": "SELECT concat('d/', o_orderkey % 500) AS draft, concat('k/', o_orderkey) AS task, o_orderstatus AS status, CASE WHEN o_custkey % 2 = 0 THEN concat('inst/', o_custkey % 9) END AS institution FROM {orders}",
    "subtasks": "SELECT concat('k/', l_orderkey) AS task, CASE WHEN l_linenumber % 2 = 1 THEN CAST(l_shipdate AS DATE) END AS start, CASE WHEN l_linenumber % 3 = 0 THEN CAST(l_shipdate AS DATE) END AS end FROM {lineitem}",
    "cons_open": "SELECT concat('k/', l_orderkey) AS task, concat('doc/', l_partkey) AS doc FROM {lineitem} WHERE l_linenumber <= 2",
    "cons_result": "SELECT concat('k/', l_orderkey) AS task, concat('doc/', l_partkey % 100) AS doc FROM {lineitem} WHERE l_linenumber >= 2",
    "treaties": """SELECT concat('p/', s_suppkey) AS process, s_name AS title, CASE WHEN s_suppkey % 4 <> 0 THEN concat('19', 50 + s_suppkey % 50, '-01-01') END AS signed, concat('place ', s_nationkey) AS place,
        CASE s_suppkey % 4 WHEN 0 THEN 'true' WHEN 1 THEN '1' WHEN 2 THEN 'false' END AS bilateral, CASE WHEN s_acctbal > 0 THEN 'yes' END AS approbation FROM {supplier}""",
    "treaty_parties": "SELECT concat('p/', l_suppkey) AS process, n_name AS country FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {nation} ON n_nationkey = p_size % 25 WHERE l_suppkey % 9 <> 0 AND l_linenumber = 1",
    "concepts": "SELECT DISTINCT concat('vocab/type/', p_type) AS concept FROM {part} UNION ALL SELECT DISTINCT concat('vocab/prio/', o_orderpriority) FROM {orders}",
    "concept_labels": """SELECT DISTINCT concat('vocab/type/', p_type) AS concept, CASE WHEN p_size % 2 = 0 THEN 'de' ELSE 'fr' END AS lang, lower(p_type) AS label FROM {part} WHERE p_size < 6
        UNION ALL SELECT DISTINCT concat('vocab/prio/', o_orderpriority), 'en', lower(o_orderpriority) FROM {orders}""",
    "triples": """SELECT concat('c/', c_custkey) AS s, 'seg' AS p, c_mktsegment AS o FROM {customer} UNION ALL SELECT concat('c/', c_custkey), 'nation', concat('n/', c_nationkey) FROM {customer}
        UNION ALL SELECT concat('n/', n_nationkey), 'region', concat('r/', n_regionkey) FROM {nation} UNION ALL SELECT concat('o/', o_orderkey), 'by', concat('c/', o_custkey) FROM {orders}""",
    "versions": "SELECT concat('eli/cc/', user_id) AS eli, concat('v', event_id % 50) AS version_id, CAST(ts AS DATE) AS valid_from, CAST(ts AS TIMESTAMP) AS transaction_time, concat(event_type, ' ', event_id) AS text FROM {events}",
    "doc_consolidations": """SELECT concat('eli/cc/2000/', doc_id) AS work, concat('c/', doc_id, '/1') AS cons, CAST('2000-01-01' AS DATE) AS date FROM {documents}
        UNION ALL SELECT concat('eli/cc/2000/', doc_id), concat('c/', doc_id, '/2'), CAST('2010-01-01' AS DATE) FROM {documents}""",
    "doc_expressions": "SELECT concat('c/', doc_id, '/1') AS cons, concat('x/', doc_id, '/1') AS expr, 'de' AS lang FROM {documents} UNION ALL SELECT concat('c/', doc_id, '/2'), concat('x/', doc_id, '/2'), 'de' FROM {documents}",
    "doc_manifestations": "SELECT concat('x/', doc_id, '/1') AS expr, concat('https://example.org/xml/', doc_id, '/1') AS url FROM {documents} UNION ALL SELECT concat('x/', doc_id, '/2'), concat('https://example.org/xml/', doc_id, '/2') FROM {documents}",
    # ids as they come from a graph: three to seven steps, with and without a host
    "deep_works": """SELECT concat(CASE WHEN c_custkey % 2 = 0 THEN 'https://example.org/' ELSE '' END, 'eli/cc/', CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat(1990 + c_custkey % 7, '/') END, c_custkey % 50,
        CASE WHEN c_custkey % 5 = 0 THEN '/x/y' ELSE '' END) AS work FROM {customer}""",
    "deep_impacts": """SELECT concat('i/', l_orderkey, '/', l_linenumber) AS impact, concat('eli/oc/', 1990 + l_suppkey % 7, '/', l_suppkey % 50, '/a', l_linenumber) AS source,
        concat(CASE WHEN l_orderkey % 2 = 0 THEN 'https://example.org/' ELSE '' END, 'eli/cc/', CASE WHEN l_partkey % 3 = 0 THEN '' ELSE concat(1990 + l_partkey % 7, '/') END, l_partkey % 50, CASE WHEN l_suppkey % 5 = 0 THEN '/x/y' ELSE '' END,
        CASE WHEN l_linenumber > 1 THEN concat('/art_', l_linenumber) ELSE '' END) AS target, l_returnflag AS type, CAST(l_shipdate AS DATE) AS date, l_linestatus AS comment FROM {lineitem}""",
    "requests": "SELECT CAST(user_id AS VARCHAR(20)) AS key, event_id AS request_id, CAST(day(ts) AS BIGINT) * 86400000 + CAST(hour(ts) AS BIGINT) * 3600000 + CAST(minute(ts) AS BIGINT) * 60000 + CAST(second(ts) AS BIGINT) * 1000 AS ts_ms, CASE WHEN event_type = 'purchase' THEN 5 ELSE 1 END AS cost FROM {events}",
}

_NAMES = re.compile(r"\{([a-z_]+)\}")


def lift(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One operator input from the tables in sf_dir."""
    sql = LIFT[name]
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(_NAMES.findall(sql))})


def with_lifts(sql: str) -> str:
    """DuckDB text: the lifts that ``sql`` names as {lift}, as common table expressions, before it."""
    used = list(dict.fromkeys(_NAMES.findall(sql)))
    body = _NAMES.sub(lambda m: "lift_" + m[1], sql).strip()
    ctes = ",\n".join(f"lift_{n} AS ({_NAMES.sub(lambda m: m[1], LIFT[n])})" for n in used)
    if not used:
        return body
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return f"{start}{ctes},\n{body[len(start):]}"
    return f"WITH {ctes}\n{body}"


def legal_xml(spark: SparkSession, sf_dir: str, later: bool = False, parts: int | None = None) -> DataFrame:
    """doc_id, xml: a legal document built from each text (``later``: from the text of its second version, in which tion is TION and a line is added). A line is an article and a sentence a paragraph; every third document has chapters of up to four articles, every seventh only levels, every eleventh no body; odd lines carry a note, a reference and a table where they are long."""
    from pyspark.sql import functions as F

    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    if parts:
        d = d.repartition(parts)
    if later:
        d = d.withColumn("text", F.concat(F.replace("text", F.lit("tion"), F.lit("TION")), F.lit("\nOne line more")))
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")

    def article(line, i):
        n = (i + 1).cast("string")
        eid = F.concat(F.lit("art_"), n)
        sentences = F.filter(F.split(line, r"\. "), lambda x: F.trim(x) != "")
        para = lambda s, j: F.concat(F.lit('<paragraph eId="'), eid, F.lit("/para_"), (j + 1).cast("string"), F.lit('"><content><p>'), esc(F.trim(s)), F.lit("</p></content></paragraph>"))
        extra = F.when(i % 2 == 1, F.concat(F.lit('<authorialNote marker="'), n, F.lit('"><p>Changed by <ref href="https://example.org/eli/oc/2001/'), n, F.lit('">AS 2001 '), n, F.lit("</ref></p></authorialNote>"))).otherwise("")
        return F.concat(F.lit('<article eId="'), eid, F.lit('"><num>Art. '), n, F.lit("</num>"), extra, F.array_join(F.transform(sentences, para), ""), F.lit("</article>"))

    arts = F.transform("lines", article)
    level = lambda line, i: F.concat(F.lit('<level eId="lvl_'), (i + 1).cast("string"), F.lit('"><content><p>'), esc(F.trim(line)), F.lit("</p></content></level>"))
    chapters = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size("lines") / 4).cast("int") - 1, F.lit(0))), lambda c: F.concat(F.lit('<chapter eId="chap_'), (c + 1).cast("string"), F.lit('"><num>'), (c + 1).cast("string"), F.lit(". Chapter</num><heading>Part "), (c + 1).cast("string"), F.lit("</heading>"), F.array_join(F.slice("arts", c * 4 + 1, 4), ""), F.lit("</chapter>")))
    d = d.withColumn("lines", lines).withColumn("arts", arts)
    inner = F.when(F.col("doc_id") % 7 == 0, F.array_join(F.transform("lines", level), "")).when(F.col("doc_id") % 3 == 0, F.array_join(chapters, "")).otherwise(F.array_join("arts", ""))
    body = F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.concat(F.lit("<body>"), inner, F.lit("</body>")))
    frbr = F.concat(F.lit('<meta><identification><FRBRWork><FRBRuri value="https://example.org/eli/cc/2000/'), "doc_id", F.lit('"/><FRBRdate name="jolux:dateDocument" date="2000-01-01"/><FRBRauthor href="#org"/><FRBRnumber value="SR '), F.col("doc_id") % 100, F.lit('"/><FRBRname lang="'), "lang", F.lit('" value="Act '), "doc_id", F.lit('"/></FRBRWork><FRBRExpression><FRBRuri value="https://example.org/eli/cc/2000/'), "doc_id", F.lit("/"), "lang", F.lit('"/><FRBRlanguage language="'), "lang", F.lit('"/></FRBRExpression><FRBRManifestation><FRBRthis value="https://example.org/eli/cc/2000/'), "doc_id", F.lit("/"), "lang", F.lit('/xml"/></FRBRManifestation></identification><references><TLCOrganization eId="org" showAs="Office '), F.col("doc_id") % 10, F.lit('"/></references></meta>'))
    xml = F.concat(F.lit("<akomaNtoso><act>"), frbr, body, F.lit("</act></akomaNtoso>"))
    return d.select("doc_id", xml.alias("xml"))
