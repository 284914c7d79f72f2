"""Derived inputs, each as one SQL text that Spark and DuckDB both run; {name} stands for a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NOISY = """SELECT doc_id, lang, text AS plain, CASE doc_id % 8
 WHEN 0 THEN 'Página ' || cast(doc_id AS string) || ' de 90 ' || text || ' pg. 7'
 WHEN 1 THEN text || ' 10 20 30 40, 50 60 fim'
 WHEN 2 THEN 'Preço R$ 350,00 R$ 0,00 ' || text || chr(10) || 'R$ R$ R$'
 WHEN 3 THEN text || ' 350,00 300,00 fim.... ok??'
 WHEN 4 THEN chr(12) || 'a<br/>b<BR >c <span class="x">d</span>' || text
 WHEN 5 THEN 'pala-' || chr(10) || 'vra e frase que' || chr(10) || 'continua' || chr(10) || chr(10) || chr(10) || chr(10) || 'x   y ' || text
 WHEN 6 THEN '2/27/26, 10:54 AM Titulo do site' || chr(10) || 'Assunto: teste' || chr(10) || '**Resumo geral**' || chr(10) || text
 ELSE 'RELATORIO ANUAL DE CONTAS' || chr(10) || chr(10) || text END AS text FROM {documents}"""

CELLS = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber % 7
 WHEN 3 THEN ARRAY(cast(l_partkey AS string), cast(NULL AS string), l_linestatus)
 WHEN 4 THEN ARRAY(cast(l_partkey AS string), l_returnflag)
 WHEN 5 THEN ARRAY('', ' ', '')
 WHEN 6 THEN ARRAY(cast(l_partkey AS string), l_returnflag, l_linestatus, 'more')
 ELSE ARRAY(' ' || cast(l_partkey AS string) || ' ', l_returnflag || chr(10) || 'x', 'R$ 1|' || l_linestatus) END AS cells FROM {lineitem}"""

ZONES = """SELECT l_orderkey AS doc_id, cast(floor((l_linenumber - 1) / 2) AS int) + 1 AS page_number, l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS zone_ord,
 CASE l_partkey % 5 WHEN 0 THEN 'TABLE' WHEN 1 THEN 'IMAGE' WHEN 2 THEN 'TITLE' ELSE 'TEXT' END AS zone_type, l_suppkey % 2 AS semantic FROM {lineitem}"""

MARKDOWN = """SELECT o_orderkey AS doc_id,
 CASE o_orderkey % 5 WHEN 0 THEN '---' || chr(10) || 'title: Order ' || cast(o_orderkey AS string) || chr(10) || 'tables_injected: ' || cast(o_orderkey % 4 AS string) || chr(10) || 'total_characters: ' || cast(o_custkey AS string) || chr(10) || '---' || chr(10) || chr(10)
  WHEN 1 THEN '---' || chr(10) || 'broken' || chr(10) || chr(10) WHEN 2 THEN '---' || chr(10) || 'not a mapping' || chr(10) || '---' || chr(10) || chr(10)
  WHEN 3 THEN CASE WHEN o_orderkey % 10 = 3 THEN '---' || chr(10) || 'source_file: a: b' || chr(10) || '---' || chr(10) || chr(10) ELSE '---' || chr(10) || 'processing-date: 1' || chr(10) || 'items:' || chr(10) || '  - x' || chr(10) || '---' || chr(10) || chr(10) END ELSE '' END
 || CASE WHEN o_orderkey % 4 = 3 THEN 'Preamble of ' || o_orderstatus || chr(10) || chr(10) ELSE '# Order ' || cast(o_orderkey AS string) || chr(10) || chr(10) END
 || 'Intro with **bold** and *soft* words, `code` and [a link](http://x).' || chr(10) || chr(10)
 || CASE o_orderkey % 11 WHEN 0 THEN 'Underlined title' || chr(10) || '=====' || chr(10) || chr(10) WHEN 1 THEN '__strong__ and _soft_ and <b>raw</b> snake_case_word' || chr(10) || chr(10)
  WHEN 2 THEN '- outer' || chr(10) || '    - inner' || chr(10) || '- next' || chr(10) || chr(10) || 'Then.' || chr(10) || chr(10) WHEN 3 THEN 'a | b' || chr(10) || '--- | ---' || chr(10) || '1 | 2' || chr(10) || chr(10)
  WHEN 4 THEN '~~~' || chr(10) || '###### x' || chr(10) || '~~~' || chr(10) || chr(10) WHEN 5 THEN '1. one' || chr(10) || '2. two' || chr(10) || chr(10) || '3. three' || chr(10) || chr(10) || 'End.' || chr(10) || chr(10) ELSE '' END
 || CASE o_orderkey % 6 WHEN 0 THEN '### Deep' || chr(10) || chr(10) || 'Text.' || chr(10) || chr(10) WHEN 1 THEN '## Sub' || chr(10) || chr(10) || '#### Deeper' || chr(10) || chr(10) || 'Text.' || chr(10) || chr(10)
  WHEN 2 THEN '## Twice' || chr(10) || chr(10) || 'One.' || chr(10) || chr(10) || '## Twice' || chr(10) || chr(10) || 'Two.' || chr(10) || chr(10) WHEN 3 THEN '<div>raw</div>' || chr(10) || chr(10) WHEN 4 THEN '```' || chr(10) || '# not a heading' || chr(10) || '```' || chr(10) || chr(10) ELSE '' END
 || '- ' || o_orderpriority || chr(10) || '- ' || o_orderstatus || chr(10) || CASE WHEN o_orderkey % 3 = 0 THEN '- third' || chr(10) ELSE '' END || chr(10)
 || CASE WHEN o_orderkey % 7 < 3 THEN '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| 1 | ' || cast(o_custkey AS string) || ' |' || chr(10) || CASE WHEN o_orderkey % 2 = 0 THEN '| 2 | x |' || chr(10) ELSE '' END ELSE '> quoted' || chr(10) || chr(10) || 'Página 3 de 9' || chr(10) END AS text FROM {orders}"""

NARRATIVES = """SELECT page_id AS doc_id, regexp_replace(html, '<[^>]*>', ' ', 'g') AS a,
 regexp_replace(replace(replace(replace(html, '<h1>', chr(10) || '# '), '<li>', chr(10) || '- '), '<p>', chr(10) || chr(10)), '<[^>]*>', '', 'g') AS b FROM {pages}"""

PAIRS = """SELECT item_id, text AS reference, CASE WHEN item_id % 3 = 0 THEN '**' || text || '**' WHEN item_id % 3 = 1 THEN replace(text, ' the ', ' ') || ' tail' ELSE '' END AS candidate FROM {benchmark}"""

TABLES = ("documents", "lineitem", "orders", "pages", "benchmark", "labels")


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A fixture as a DataFrame."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql.replace(", 'g')", ")"), **used)


def duck(sql: str) -> str:
    """The same fixture for DuckDB."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql.replace("ARRAY(", "list_value(")
