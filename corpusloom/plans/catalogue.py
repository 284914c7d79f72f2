"""Every query of the engine by its stable name, and its DuckDB text where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import clean as C
from corpusloom.functions import frontmatter as Y
from corpusloom.functions import markdown as M
from corpusloom.functions import tables as T
from corpusloom.operators import assemble, manifest, refmetrics, runner
from corpusloom.plans import fixtures as X

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- cleaner -------------------------------------------------------------------------------------------------

# The cleaner's patterns, in RE2 form.
#: Rules of each query, and the same as RE2 steps (pattern, replacement) on DuckDB; None: SQL can't call back for each match.
CLEANING = {
    "clean_page_numbers": (["page_numbers"], [(r"(?i)(?:p[áa]gina|pg\.?)\s*\d+(?:\s?de\s?\d+)?", "''")]),
    "clean_axis_numbers": (["axis_numbers"], [(r"(?:\b\d{1,3}\b(?:\s+|,)?\s?){4,}", "''")]),
    "clean_price_runs": (["price_runs"], [(r"(?:R\$\s*\d+(?:[.,]\d{0,2})?\s*){2,}", "''")]),
    "clean_bare_currency": (["bare_currency"], [(r"\b(?:R\$\s*){2,}", "''")]),
    "clean_decimal_runs": (["decimal_runs"], [(r"(?:\d+[.,]\d{2}\s*){2,}", "''")]),
    "clean_html_residue": (["html_breaks", "html_spans"], [(r"(?i)<br\s*/?>", "' '"), (r"(?i)</?span[^>]*>", "''")]),
    "clean_form_feeds": (["form_feeds"], [(r"\f", "''")]),
    "clean_spaces_newlines": (["spaces", "newlines"], [(r" +", "' '"), (r"\n{3,}", "chr(10) || chr(10)")]),
    "clean_hyphen_join": (["hyphen_join"], [(r"([\p{L}\p{N}_])-\s*\n\s*([a-zà-ú])", r"'\1\2'")]),
    "clean_line_join": (["line_join"], [(r"([a-zà-ú,;])\n+([a-zà-ú])", r"'\1 \2'")]),
    "clean_punctuation": (["punctuation"], [(r"\.{2,}", "'.'"), (r"\?{2,}", "'?'"), (r"!{2,}", "'!'"), (r",{2,}", "','"), (r";{2,}", "';'")]),
    "clean_print_headers": (["print_headers"], [(r"(?i)\d{1,2}/\d{1,2}/\d{2,4},?\s+\d{1,2}:\d{2}\s*(?:AM|PM)?\s+.*", "''")]),
    "promote_subject": (["promote_subject"], [(r"(?mi)^(Assunto:[^\n]+)$", r"chr(10) || '### \1' || chr(10)")]),
    "promote_bold": (["promote_bold"], [(r"(?m)^\*\*([^*]{5,120})\*\*\s*$", r"chr(10) || '### \1' || chr(10)")]),
    "promote_caps": (["promote_caps"], None),
    "clean_full": (None, None),
}


def cleaned(rules: list[str] | None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        noisy = assemble.fixed(assemble.spread(X.frame(spark, sf_dir, X.NOISY)), cleaned=C.clean(F.col("text"), rules))
        return noisy.select("doc_id", F.md5("cleaned").alias("cleaned_md5"), F.length("cleaned").cast("long").alias("n_chars"), (F.col("cleaned") != F.col("text")).alias("changed"))

    return run


def replaced(column: str, steps: list[tuple[str, str]]) -> str:
    for pattern, replacement in steps:
        column = f"regexp_replace({column}, '{pattern}', {replacement}, 'g')"
    return column


for _name, (_rules, _steps) in CLEANING.items():
    QUERIES[_name] = cleaned(_rules)
    if _steps is not None:
        ORACLE_SQL[_name] = f"SELECT doc_id, md5(c) AS cleaned_md5, length(c) AS n_chars, c <> text AS changed FROM (SELECT doc_id, text, {replaced('text', _steps)} AS c FROM ({X.duck(X.NOISY)}))"

_LATIN = "SELECT doc_id, text FROM {documents}"


@query(f"SELECT doc_id, md5(text) AS fixed_md5, length(text) AS n_chars FROM ({X.duck(_LATIN)})")
def repair_encoding(spark, sf_dir):
    """Texts read as Latin-1 come back; correct ones stay.  Only texts of UTF-8 bytes that Latin-1 can show are damaged here."""
    docs = X.frame(spark, sf_dir, _LATIN)
    damaged = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    broken = F.when(F.col("doc_id") % 3 == 0, damaged).otherwise(F.col("text"))
    return docs.select("doc_id", C.repair_encoding(broken).alias("t")).select("doc_id", F.md5("t").alias("fixed_md5"), F.length("t").cast("long").alias("n_chars"))


_HITS = " + ".join(f"len(regexp_extract_all(text, '{CLEANING[q][1][0][0]}'))" for q in ("clean_page_numbers", "clean_axis_numbers", "clean_price_runs", "clean_bare_currency"))


@query(f"SELECT lang, count(*) AS n, sum(h) AS hits, count(*) FILTER (h > 0) AS touched FROM (SELECT lang, {_HITS} AS h FROM ({X.duck(X.NOISY)})) GROUP BY lang")
def clean_effect_by_lang(spark, sf_dir):
    hits = X.frame(spark, sf_dir, X.NOISY).select("lang", C.garbage_hits(F.col("text")).cast("long").alias("h"))
    return hits.groupBy("lang").agg(F.count("*").alias("n"), F.sum("h").alias("hits"), F.count_if(F.col("h") > 0).alias("touched"))


# --- tables and manifests ------------------------------------------------------------------------------------

_ROWS = f"SELECT l_orderkey, list(list_transform(cells, lambda x: trim(replace(coalesce(x, ''), chr(10), ' '))) ORDER BY l_linenumber, l_partkey, l_suppkey) FILTER (len(list_filter(cells, lambda x: trim(coalesce(x, '')) <> '')) > 0) AS r FROM ({X.duck(X.CELLS)}) GROUP BY 1"
_RENDERED = f"""SELECT l_orderkey, CASE WHEN r IS NULL THEN '' ELSE '| ' || array_to_string(r[1], ' | ') || ' |' || chr(10) || '| ' || array_to_string(list_transform(r[1], lambda x: '---'), ' | ') || ' |'
 || coalesce(array_to_string(list_transform(r[2:], lambda y: chr(10) || '| ' || array_to_string(list_resize(y, len(r[1]), ''), ' | ') || ' |'), ''), '') || chr(10) || chr(10) END AS markdown FROM ({_ROWS})"""


def rendered_tables(spark, sf_dir):
    cells = X.frame(spark, sf_dir, X.CELLS)
    whole = cells.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "cells"))).alias("rows"))
    return whole.select("l_orderkey", T.render_table(F.col("rows.cells")).alias("markdown"))


@query(f"SELECT l_orderkey, md5(markdown) AS table_md5, length(markdown) AS n_chars FROM ({_RENDERED})")
def table_render(spark, sf_dir):
    return rendered_tables(spark, sf_dir).select("l_orderkey", F.md5("markdown").alias("table_md5"), F.length("markdown").cast("long").alias("n_chars"))


_ZONES = X.duck(X.ZONES)
_PAGES = f"SELECT doc_id, page_number, bool_or(zone_type = 'TABLE') AS t, bool_or(zone_type = 'IMAGE') AS i FROM ({_ZONES}) GROUP BY ALL"


@query(f"SELECT doc_id, count(*) AS total_pages, coalesce(string_agg(cast(page_number AS varchar), ',' ORDER BY page_number) FILTER (t), '') AS with_tables, coalesce(string_agg(cast(page_number AS varchar), ',' ORDER BY page_number) FILTER (i), '') AS with_images FROM ({_PAGES}) GROUP BY doc_id")
def manifest_rollup(spark, sf_dir):
    out = manifest.document_rollup(X.frame(spark, sf_dir, X.ZONES))
    return out.select("doc_id", "total_pages", F.array_join(F.col("pages_with_tables").cast("array<string>"), ",").alias("with_tables"), F.array_join(F.col("pages_with_images").cast("array<string>"), ",").alias("with_images"))


_MISSING = f"SELECT *, row_number() OVER (PARTITION BY doc_id, page_number, zone_type ORDER BY zone_ord) AS n FROM z g WHERE semantic = 1 AND zone_type IN ('TABLE', 'IMAGE') AND NOT EXISTS (SELECT 1 FROM z s WHERE s.semantic = 0 AND s.doc_id = g.doc_id AND s.page_number = g.page_number AND s.zone_type = g.zone_type)"


@query(f"WITH z AS ({_ZONES}) SELECT doc_id, page_number, zone_ord, zone_type FROM z WHERE semantic = 0 UNION ALL SELECT doc_id, page_number, zone_ord, zone_type FROM ({_MISSING}) WHERE zone_type = 'TABLE' OR n = 1")
def zone_enrich(spark, sf_dir):
    zones = X.frame(spark, sf_dir, X.ZONES)
    return manifest.enrich(zones.where("semantic = 0"), zones.where("semantic = 1")).select("doc_id", "page_number", "zone_ord", "zone_type")


_NUMBERED = f"SELECT doc_id, page_number, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY zone_ord) AS number, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, zone_ord) AS ordinal FROM ({_ZONES}) WHERE zone_type = 'TABLE'"


@query(f"SELECT doc_id, page_number, number, ordinal FROM ({_NUMBERED})")
def anchor_numbering(spark, sf_dir):
    return manifest.numbered_tables(X.frame(spark, sf_dir, X.ZONES))


_INJECTED = f"""SELECT o.o_orderkey AS doc_id, 'Body ' || coalesce(b.t, '') AS body FROM orders o LEFT JOIN (SELECT doc_id, string_agg(chr(10) || chr(10)
 || CASE WHEN ordinal <= doc_id % 3 THEN chr(10) || chr(10) || '{T.HEADING}' || chr(10) || chr(10) || 'T' || ordinal || ' $1' || chr(10) || chr(10) ELSE '' END || chr(10), '' ORDER BY ordinal) AS t FROM ({_NUMBERED}) GROUP BY doc_id) b ON b.doc_id = o.o_orderkey"""


@query(f"SELECT doc_id, md5(body) AS body_md5, length(body) AS n_chars FROM ({_INJECTED})")
def table_injection(spark, sf_dir):
    """Each document has doc_id % 3 tables: too few for some anchors, too many for others."""
    lists = manifest.anchor_lists(X.frame(spark, sf_dir, X.ZONES))
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id")).join(lists, "doc_id", "left")
    tables = F.slice(F.array(F.lit("T1 $1"), F.lit("T2 $1")), F.lit(1), (F.col("doc_id") % 3).cast("int"))
    text = F.concat(F.lit("Body "), T.anchors(F.coalesce("anchors", F.array().cast("array<struct<page:int,number:int>>"))))
    return docs.select("doc_id", T.inject_tables(text, tables).alias("b")).select("doc_id", F.md5("b").alias("body_md5"), F.length("b").cast("long").alias("n_chars"))


@query(f"SELECT o_orderkey AS doc_id, count(page_number) AS vision_pages, count(page_number) = 0 AS skipped FROM orders LEFT JOIN (SELECT doc_id, page_number FROM ({_PAGES}) WHERE i) ON doc_id = o_orderkey GROUP BY 1")
def vision_skip_plan(spark, sf_dir):
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    plan = manifest.vision_plan(docs, X.frame(spark, sf_dir, X.ZONES)).groupBy("doc_id").agg(F.count("*").alias("n"))
    return docs.join(plan, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("vision_pages"), F.col("n").isNull().alias("skipped"))


# --- Markdown scores -----------------------------------------------------------------------------------------

# What the recipe of the Markdown fixture holds by its key, counted by hand from the rules of the converter to HTML: the oracle reads no Markdown.
_O = "doc_id"
_TABLE_ROWS = f"(CASE WHEN {_O} % 7 < 3 THEN 2 + ({_O} % 2 = 0)::int ELSE 0 END)"
_BY_KEY = {
    "table": f"({_O} % 7 < 3)::int + ({_O} % 11 = 3)::int",
    "tr": f"{_TABLE_ROWS} + 2 * ({_O} % 11 = 3)::int",
    "th": f"2 * ({_O} % 7 < 3)::int + 2 * ({_O} % 11 = 3)::int",
    "td": f"(CASE WHEN {_O} % 7 < 3 THEN 2 * ({_TABLE_ROWS} - 1) ELSE 0 END) + 2 * ({_O} % 11 = 3)::int",
    "ul": f"1 + 2 * ({_O} % 11 = 2)::int",
    "ol": f"({_O} % 11 = 5)::int",
    "li": f"2 + ({_O} % 3 = 0)::int + 3 * ({_O} % 11 = 2)::int + 3 * ({_O} % 11 = 5)::int",
    "h1": f"({_O} % 4 <> 3)::int + ({_O} % 11 = 0)::int",
    "h2": f"({_O} % 5 = 2)::int + ({_O} % 10 = 3)::int + ({_O} % 6 = 1)::int + 2 * ({_O} % 6 = 2)::int",
    "h3": f"({_O} % 6 = 0)::int",
    "h4": f"({_O} % 6 = 1)::int",
    "h5": "0",
    "h6": "0",
    "b": f"({_O} % 11 = 1)::int",
    "strong": f"1 + ({_O} % 11 = 1)::int",
    "i": "0",
    "em": f"1 + ({_O} % 11 = 1)::int",
    "hr": f"CASE WHEN {_O} % 5 = 0 OR {_O} % 10 = 8 THEN 2 WHEN {_O} % 5 = 4 THEN 0 ELSE 1 END",
    "pre": f"({_O} % 6 = 4)::int + ({_O} % 11 = 4)::int",
    "code": f"1 + ({_O} % 6 = 4)::int + ({_O} % 11 = 4)::int",
    "blockquote": f"({_O} % 7 >= 3)::int",
    "math": "0",
    "p": f"1 + ({_O} % 5 = 0 OR {_O} % 5 = 1 OR {_O} % 10 = 8)::int + ({_O} % 4 = 3)::int + CASE {_O} % 6 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END"
    f" + CASE {_O} % 11 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 5 THEN 3 ELSE 0 END + 2 * ({_O} % 7 >= 3)::int",
    "a": "1",
}
_WEIGHT = {**dict.fromkeys(("table", "tr", "th", "td"), 25.0), **dict.fromkeys(("ul", "ol", "li"), 10.0), **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6", "pre", "code", "math"), 5.0)}
_GROWS = ("table", "tr", "th", "td", "ul", "ol", "li")


_MD = X.duck(X.MARKDOWN)
_TAGS = f"SELECT doc_id, text, {', '.join(f'{e} AS tag_{t}' for t, e in _BY_KEY.items())} FROM ({_MD})"
_BONUS = " + ".join(f"tag_{t} * {_WEIGHT.get(t, 1.0)}" if t in _GROWS else f"{_WEIGHT.get(t, 1.0)} * (1 - pow(0.5, tag_{t})) / 0.5" for t in _BY_KEY)
_PENALTY = f"(1.5 * ({_HITS}) + CASE WHEN length(text) > 1000 AND len(regexp_extract_all(text, '\\n\\n')) < 2 THEN 5.0 ELSE 0.0 END)"
_DENSITY = "CASE WHEN length(trim(text, chr(10) || ' ')) < 5 OR bonus - penalty <= 0 THEN 0.0 ELSE 100 * (1 - exp(-(bonus - penalty) / 150.0)) END"
_SCORED = f"SELECT doc_id, text, bonus, penalty, {_DENSITY} AS density FROM (SELECT doc_id, text, {_BONUS} AS bonus, {_PENALTY} AS penalty FROM ({_TAGS}))"


def markdown(spark, sf_dir):
    return assemble.spread(X.frame(spark, sf_dir, X.MARKDOWN))


def narratives(spark, sf_dir):
    return assemble.spread(X.frame(spark, sf_dir, X.NARRATIVES))


@query(f"SELECT doc_id, {', '.join(f'cast(tag_{t} AS bigint) AS tag_{t}' for t in _BY_KEY)} FROM ({_TAGS})")
def tag_counts(spark, sf_dir):
    return markdown(spark, sf_dir).select("doc_id", *(n.alias(f"tag_{t}") for t, n in M.tag_counts(F.col("text")).items()))


@query(f"SELECT doc_id, round(bonus, 4) AS bonus FROM ({_SCORED})")
def density_bonus(spark, sf_dir):
    return markdown(spark, sf_dir).select("doc_id", F.round(M.density_bonus(M.tag_counts(F.col("text"))), 4).alias("bonus"))


@query(f"SELECT doc_id, cast({_PENALTY} AS double) AS penalty FROM ({X.duck(X.NOISY)})")
def garbage_penalty(spark, sf_dir):
    return X.frame(spark, sf_dir, X.NOISY).select("doc_id", M.garbage_penalty(F.col("text")).cast("double").alias("penalty"))


@query(f"SELECT doc_id, round(density, 4) AS density FROM ({_SCORED})")
def density_score(spark, sf_dir):
    return markdown(spark, sf_dir).select("doc_id", F.round(M.density_score(F.col("text")), 4).alias("density"))


# levels of the fixture's headings in order; its one raw HTML block
_LEVELS = f"""list_concat(list_concat(CASE WHEN {_O} % 5 IN (0, 2) OR {_O} % 10 = 3 THEN [2] ELSE [] END, CASE WHEN {_O} % 4 <> 3 THEN [1] ELSE [] END),
 list_concat(CASE WHEN {_O} % 11 = 0 THEN [1] ELSE [] END, CASE {_O} % 6 WHEN 0 THEN [3] WHEN 1 THEN [2, 4] WHEN 2 THEN [2, 2] ELSE [] END))"""
_VIOLATIONS = f"(len(list_filter(list_zip({_LEVELS}, list_concat([9], {_LEVELS})[:-2]), lambda p: p[1] > p[2] + 1)) + ({_O} % 6 = 3)::int)"


@query(f"SELECT doc_id, cast({_VIOLATIONS} AS bigint) AS violations FROM ({_MD})")
def heading_violations(spark, sf_dir):
    return markdown(spark, sf_dir).select("doc_id", M.heading_violations(F.col("text")).alias("violations"))


_BARE = "regexp_replace(CASE WHEN regexp_matches(text, '(?s)^\\s*---.*?---') THEN regexp_replace(text, '(?s)^\\s*---.*?---\\s*', '') ELSE text END, '(?ms)^(?:```|~~~).*?^(?:```|~~~)$', 'code', 'g')"
_CHUNKS = f"SELECT doc_id, text, list_filter(list_transform(string_split(regexp_replace({_BARE}, '(?m)^(#{{1,4}} [^\\n]*)$', chr(1) || '\\1' || chr(2), 'g'), chr(1)), lambda p: {{'head': CASE WHEN contains(p, chr(2)) THEN string_split(p, chr(2))[1] ELSE '' END, 'rest': trim(CASE WHEN contains(p, chr(2)) THEN string_split(p, chr(2))[2] ELSE p END, chr(10) || ' ')}}), lambda s: s.rest <> '') AS f FROM ({_MD})"
_ORPHAN = "CASE WHEN len(f) = 0 THEN 1.0 ELSE cast(CASE WHEN f[1].head = '' THEN 1 ELSE 0 END AS double) / (1 + len(list_filter(list_zip(f[2:], f[:-2]), lambda p: p[1].head <> p[2].head))) END"


@query(f"SELECT doc_id, round({_ORPHAN}, 6) AS orphan_rate FROM ({_CHUNKS})")
def orphan_rate(spark, sf_dir):
    return markdown(spark, sf_dir).select("doc_id", F.round(M.orphan_rate(F.col("text")), 6).alias("orphan_rate"))


_INVALID = f"CASE WHEN {_O} % 5 = 0 OR {_O} % 10 = 8 THEN 0.0 ELSE 1.0 END"


@query(f"SELECT doc_id, cast({_INVALID} AS double) AS invalid FROM ({_MD})")
def frontmatter_validity(spark, sf_dir):
    return markdown(spark, sf_dir).select("doc_id", M.front_matter_invalidity(F.col("text")).alias("invalid"))


_WORDS = "len(list_filter(regexp_split_to_array(regexp_replace(text, '[#*_|`~\\[\\]()]', ' ', 'g'), '\\s+'), lambda x: x <> ''))"
_RATIO = f"CASE WHEN {_WORDS} = 0 THEN 0.0 ELSE cast(len(regexp_extract_all(text, '\\p{{L}}+|\\p{{N}}{{1,3}}|[^\\s\\p{{L}}\\p{{N}}]+')) AS double) / {_WORDS} END"


@query(f"SELECT doc_id, round({_RATIO}, 6) AS ratio FROM documents")
def token_word_ratio(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(M.token_word_ratio(F.col("text")), 6).alias("ratio"))


_COMPOSITE = f"SELECT doc_id, 0.40 * density + 0.30 * (1 - orphan) * 100 + 0.15 * greatest(0.0, 100 - 40 * greatest(0.0, ratio - 1.5)) + 0.10 * greatest(0.0, 100 - 20.0 * violations) + 0.05 * CASE WHEN invalid = 0 THEN 100.0 ELSE 0.0 END AS composite FROM (SELECT doc_id, text, density, {_RATIO} AS ratio, {_VIOLATIONS} AS violations, {_INVALID} AS invalid FROM ({_SCORED})) JOIN (SELECT doc_id, {_ORPHAN} AS orphan FROM ({_CHUNKS})) USING (doc_id)"


@query(f"SELECT doc_id, round(composite, 4) AS composite FROM ({_COMPOSITE})")
def composite_score(spark, sf_dir):
    return assemble.with_composite(markdown(spark, sf_dir), "text").select("doc_id", F.round("composite", 4).alias("composite"))


@query()
def engine_comparison(spark, sf_dir):
    """Three engines on each page: two narratives and the chosen one with front matter."""
    df = assemble.select_narrative(assemble.fixed(narratives(spark, sf_dir), a=C.clean(F.col("a")), b=C.clean(F.col("b"))), "a", "b")
    final = assemble.synthesise(df.withColumns({"anchors": F.lit(None).cast("array<struct<page:int,number:int>>"), "tables": F.lit(None).cast("array<string>"), "visuals": F.lit(None).cast("array<string>"), "name": F.concat(F.lit("page "), F.col("doc_id").cast("string"), F.lit(".pdf"))}), F.lit("2026-01-01 00:00:00"))
    rows = final.select("doc_id", F.explode(F.create_map(F.lit("a"), F.col("a"), F.lit("b"), F.col("b"), F.lit("final"), F.col("markdown"))).alias("engine", "text"))
    scored = assemble.with_composite(rows, "text")
    return scored.select("doc_id", "engine", *(F.round(c, 4).alias(c) for c in ("density", "token_word_ratio", "orphan_rate", "composite")), "violations", "front_matter_invalid")


@query()
def engine_selection(spark, sf_dir):
    df = assemble.select_narrative(narratives(spark, sf_dir), "a", "b")
    return df.select("doc_id", "winner", "score_a", "score_b", F.length("narrative").cast("long").alias("n_chars"), "failed")


_STAMP = "2026-01-01 00:00:00"
_FRONT = f"'---' || chr(10) || 'title: doc-' || doc_id || chr(10) || 'extraction_engine: {Y.ENGINE}' || chr(10) || 'source_file: doc-' || doc_id || '#' || chr(10) || 'processing_date: {_STAMP}' || chr(10) || 'total_characters: ' || length(text) || chr(10) || 'tables_injected: ' || (doc_id % 4) || chr(10) || 'visual_blocks: 0' || chr(10) || 'mdeval_score: 12.5' || chr(10) || '---' || chr(10) || chr(10) || text"


@query(f"SELECT doc_id, md5({_FRONT}) AS front_md5 FROM documents")
def frontmatter_build(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit("#.pdf"))
    return docs.select("doc_id", F.md5(Y.build(F.col("text"), name, F.col("doc_id") % 4, F.lit(0), F.lit(12.5), F.lit(_STAMP))).alias("front_md5"))


_HEADER = f"regexp_extract(text, '{Y.SPLIT}', 1)"
_VALUE = "coalesce(try_cast(regexp_extract(h, '(?m)^{0}: (\\d+)$', 1) AS bigint), 0) AS {0}"


@query(f"SELECT doc_id, {_VALUE.format('total_characters')}, {_VALUE.format('tables_injected')}, length(CASE WHEN regexp_matches(text, '{Y.SPLIT}') THEN regexp_extract(text, '{Y.SPLIT}', 2) ELSE text END) AS body_chars FROM (SELECT *, {_HEADER} AS h FROM ({_MD}))")
def frontmatter_parse(spark, sf_dir):
    t = F.col("text")
    return markdown(spark, sf_dir).select("doc_id", *(Y.value(t, k).alias(k) for k in ("total_characters", "tables_injected")), F.length(Y.body(t)).cast("long").alias("body_chars"))


# --- reference metrics and summaries -------------------------------------------------------------------------

_TOKENS = "SELECT item_id, unnest(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda x: x <> '')) AS t FROM p"
_BAGS = f"x AS (SELECT item_id, t, count(*) AS n FROM ({_TOKENS.format('reference')}) GROUP BY ALL), y AS (SELECT item_id, t, count(*) AS n FROM ({_TOKENS.format('candidate')}) GROUP BY ALL)"


@query(
    f"WITH p AS ({X.duck(X.PAIRS)}), {_BAGS} SELECT p.item_id, round(coalesce(2.0 * (SELECT sum(least(x.n, y.n)) FROM x JOIN y USING (item_id, t) WHERE x.item_id = p.item_id) / ((SELECT sum(n) FROM x WHERE x.item_id = p.item_id) + coalesce((SELECT sum(n) FROM y WHERE y.item_id = p.item_id), 0)), 0.0), 6) AS rouge_1 FROM p"
)
def rouge1_pairs(spark, sf_dir):
    return refmetrics.rouge_1(X.frame(spark, sf_dir, X.PAIRS), "item_id", "reference", "candidate").select("item_id", F.round("rouge_1", 6).alias("rouge_1"))


@query()
def wer_pairs(spark, sf_dir):
    return X.frame(spark, sf_dir, X.PAIRS).select("item_id", F.round(refmetrics.wer(F.col("reference"), F.col("candidate")), 6).alias("wer"))


@query()
def rouge_l_pairs(spark, sf_dir):
    return X.frame(spark, sf_dir, X.PAIRS).select("item_id", F.round(refmetrics.rouge_l(F.col("reference"), F.col("candidate")), 6).alias("rouge_l"))


@query("SELECT d.doc_id, md5(d.text) AS context_md5, 'Q' || b.item_id AS question, md5(b.text) AS answer_md5 FROM benchmark b CROSS JOIN documents d")
def qa_contexts(spark, sf_dir):
    """Each benchmark item is a question on every document."""
    qa = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("Q"), F.col("item_id").cast("string")).alias("question"), F.col("text").alias("ground_truth"))
    out = refmetrics.qa_contexts(qa, table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.md5(F.get("contexts", 0)).alias("context_md5"), "question", F.md5("answer").alias("answer_md5"))


@query(f"SELECT quality, count(*) AS n, round(avg({_PENALTY}), 4) AS mean_penalty FROM documents JOIN labels USING (doc_id) GROUP BY quality")
def score_by_quality_label(spark, sf_dir):
    scored = table(spark, sf_dir, "documents").select("doc_id", M.garbage_penalty(F.col("text")).alias("p"))
    return scored.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("quality").agg(F.count("*").alias("n"), F.round(F.avg("p"), 4).alias("mean_penalty"))


@query("SELECT count(*) FILTER (strlen(text) <= 8192) AS ok, count(*) AS total FROM documents")
def corpus_summary(spark, sf_dir):
    sized = table(spark, sf_dir, "documents").select((F.octet_length("text") <= 8192).alias("success"))
    return assemble.run_summary(sized)


# --- the whole run -------------------------------------------------------------------------------------------


def recipe_readers() -> runner.Readers:
    """Readers of files that hold nothing but a number; what they find follows from it."""

    def number(content):
        return int(content)

    def semantic(path, content):
        n = number(content)
        if n % 13 == 0:
            raise KeyError("unreadable")
        if n % 11 == 0:
            raise ValueError("no layout")
        return [{"page_number": 1, "category": "NarrativeText"}] + [{"page_number": 1, "category": "Table"}] * (n % 2) + [{"page_number": 2, "category": "Image"}] * (n % 5 == 0)

    def geometric(path, content):
        n = number(content)
        found = [{"page_number": p, "category": None} for p in (1, 2)]
        return found + [{"page_number": 2, "category": "Table"}] * (n % 7 == 0) + [{"page_number": 1, "category": "Image"}] * (n % 9 == 0)

    def second(path, content):
        n = number(content)
        return f"# B {n}\n\n- xx\n- yy" if n % 4 == 0 else f"plain {n}"

    def tables(path, content):
        n = number(content)
        return [{"page": 2 - k, "cells": [["kk", "vv"], [str(n), None], ["", " "]]} for k in range(n % 3)]

    return runner.Readers(
        geometric=geometric,
        semantic=semantic,
        narrative_a=lambda path, content: f"# Report {number(content)}\n\nBody of report.",
        narrative_b=second,
        tables=tables,
        deep=lambda path, content, model: model if number(content) % 10 == 0 else " ",
        load_model=lambda: "Deep view.",
        ocr=lambda path, content, pages: [f"Ocr of {p}." for p in pages],
    )


_BREAK = "chr(10) || chr(10)"
_ONE_TABLE = "'| kk | vv |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || doc_id || ' |  |'"
_SLOT = f"{_BREAK} || {{0}} || chr(10)"
_INJECT = f"CASE WHEN m >= {{0}} THEN {_BREAK} || '### [Tabela Detectada]' || {_BREAK} || {_ONE_TABLE} || {_BREAK} ELSE '' END"
_RUN = f"""WITH f AS (SELECT doc_id, doc_id % 13 = 0 AS err, doc_id % 11 <> 0 AND doc_id % 2 = 1 AS t1, doc_id % 11 <> 0 AND doc_id % 7 = 0 AS t2, doc_id % 3 AS m,
  list_concat(CASE WHEN doc_id % 9 = 0 THEN [1] ELSE [] END, CASE WHEN doc_id % 11 <> 0 AND doc_id % 5 = 0 THEN [2] ELSE [] END) AS images FROM documents),
 g AS (SELECT *, least(m, t1::int + t2::int) AS k, CASE WHEN len(images) = 0 THEN [] WHEN doc_id % 10 = 0 THEN ['Deep view.'] ELSE list_transform(images, lambda p: 'Ocr of ' || p || '.') END AS v FROM f),
 h AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN '# B ' || doc_id || {_BREAK} || '- xx' || chr(10) || '- yy' ELSE '# Report ' || doc_id || {_BREAK} || 'Body of report.' END
  || CASE WHEN t1 THEN {_SLOT.format(_INJECT.format(1))} ELSE '' END || CASE WHEN t2 THEN {_SLOT.format(_INJECT.format("(1 + t1::int)"))} ELSE '' END
  || CASE WHEN len(v) > 0 THEN {_BREAK} || '---' || chr(10) || '## 🔍 Elementos Gráficos Reconstruídos' || {_BREAK} || array_to_string(list_transform(v, lambda x: x || {_BREAK}), '') ELSE '' END AS raw FROM g),
 i AS (SELECT *, regexp_replace({{cleaned}}, '^\\s+|\\s+$', '', 'g') AS body, CASE WHEN doc_id % 4 = 0 THEN 35.0 ELSE 6.0 END + 5.0 * (1 - pow(0.5, k)) / 0.5 + k * 175.0
  + CASE WHEN len(v) > 0 THEN 6.0 + CASE WHEN doc_id % 4 = 0 THEN 2 * (1 - pow(0.5, len(v))) ELSE 2 * (1 - pow(0.5, len(v) + 1)) - 1.0 END ELSE 0.0 END AS bonus FROM h),
 j AS (SELECT *, round(100 * (1 - exp(-bonus / 150.0)), 2) AS s FROM i)"""
_CLEAN_STEPS = [step for q in ("clean_html_residue", "clean_hyphen_join", "clean_line_join", "clean_spaces_newlines", "clean_punctuation") for step in CLEANING[q][1]]
_FINISHED = f"""'---' || chr(10) || 'title: doc-' || doc_id || chr(10) || 'extraction_engine: {Y.ENGINE}' || chr(10) || 'source_file: doc-' || doc_id || chr(10) || 'processing_date: {_STAMP}' || chr(10) || 'total_characters: ' || length(body)
 || chr(10) || 'tables_injected: ' || m || chr(10) || 'visual_blocks: ' || len(v) || chr(10) || 'mdeval_score: ' || s || chr(10) || '---' || {_BREAK} || body"""


@query(
    _RUN.replace("{cleaned}", replaced("raw", _CLEAN_STEPS))
    + f""" SELECT doc_id, NOT err AS success, CASE WHEN err THEN 0.0::double ELSE s END AS score, md5(CASE WHEN err THEN '' ELSE {_FINISHED} END) AS markdown_md5,
 CASE WHEN NOT err THEN CASE WHEN doc_id % 4 = 0 THEN 'b (Saúde Superior: 20.81%)' ELSE 'a (Saúde Superior: 3.92%)' END END AS narrative_winner,
 CASE WHEN NOT err THEN CASE WHEN m = 0 THEN 'nenhum (sem tabelas detectadas)' ELSE 'tables (' || m || ' tabelas)' END END AS data_winner,
 CASE WHEN NOT err THEN CASE WHEN len(v) = 0 THEN 'Skipped (Sem Blocos Visuais)' WHEN doc_id % 10 = 0 THEN 'deep (deep learning)' ELSE 'ocr (fallback)' END END AS vision_winner,
 CASE WHEN NOT err THEN 2::bigint END AS total_pages, CASE WHEN NOT err THEN m::bigint END AS tables_injected, CASE WHEN NOT err THEN len(v)::bigint END AS visual_blocks FROM j"""
)
def convert_documents(spark, sf_dir):
    """A file for each document through the whole run, by readers that follow a recipe."""
    docs = table(spark, sf_dir, "documents")
    files = assemble.spread(docs.select(F.concat(F.lit("/in/doc-"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), F.encode(F.col("doc_id").cast("string"), "UTF-8").alias("content")))
    out = runner.convert(files, recipe_readers(), F.lit(_STAMP))
    s = lambda k: F.try_element_at(F.col("stats"), F.lit(k))
    return out.select(
        F.regexp_extract("path", r"(\d+)", 1).cast("bigint").alias("doc_id"),
        "success",
        "score",
        F.md5("markdown").alias("markdown_md5"),
        *(s(k).alias(k) for k in ("narrative_winner", "data_winner", "vision_winner")),
        *(s(k).cast("bigint").alias(k) for k in ("total_pages", "tables_injected", "visual_blocks")),
    )
