"""Registered queries of the document operators and the SQL that each must equal.

The driver's tables hold no PDF, so each query applies an operator to a table of the same shape:
documents stand for streams, orders and line items for objects and references, pages for mark-up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import audit, classify, dedup, diff, graph, sequences
from .session import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None):
    """Registers the function below under its name, with its oracle."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def text_bytes():
    return F.octet_length("text")


_DUPS = "dups AS (SELECT doc_id AS duplicate, min(doc_id) OVER (PARTITION BY sha256(text)) AS canonical FROM documents WHERE text IS NOT NULL)"


@query("""
SELECT sha256(text) AS digest, min(doc_id) AS canonical, count(*) AS members, (count(*) - 1) * max(octet_length(encode(text)))::BIGINT AS bytes_saved
FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1""")
def dedup_groups(spark, d):
    return dedup.duplicate_groups(table(spark, d, "documents"), dedup.digest("text"), "doc_id", text_bytes())


@query(f"WITH {_DUPS} SELECT * FROM dups WHERE duplicate <> canonical")
def dedup_map(spark, d):
    return dedup.duplicate_map(table(spark, d, "documents"), dedup.digest("text"), "doc_id")


@query("""
WITH free AS (SELECT * FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1))
SELECT duplicate, canonical FROM (SELECT doc_id AS duplicate, min(doc_id) OVER (PARTITION BY sha256(text)) AS canonical FROM free) WHERE duplicate <> canonical""")
def dedup_protected(spark, d):
    protected = table(spark, d, "labels").where("quality = 1").select("doc_id")
    free = table(spark, d, "documents").join(protected, "doc_id", "left_anti")
    return dedup.duplicate_map(free, dedup.digest("text"), "doc_id")


@query("""
SELECT 'payload' AS key, count(DISTINCT text) AS distinct_keys, count(*) - count(DISTINCT text) AS copies FROM documents
UNION ALL SELECT 'full', count(DISTINCT (text, lang, source)), count(*) - count(DISTINCT (text, lang, source)) FROM documents""")
def dedup_payload_vs_full(spark, d):
    docs = table(spark, d, "documents")
    keys = docs.select(F.explode(F.array(F.struct(F.lit("payload").alias("key"), dedup.digest("text").alias("h")), F.struct(F.lit("full").alias("key"), dedup.digest("text", "lang", "source").alias("h")))).alias("k"))
    per = keys.groupBy("k.key", "k.h").count()
    return per.groupBy("key").agg(F.count("*").alias("distinct_keys"), F.sum(F.col("count") - 1).alias("copies"))


@query(f"WITH {_DUPS} SELECT coalesce(canonical, doc_id) AS doc_id, quality, toxic FROM labels LEFT JOIN dups ON duplicate = doc_id")
def relink(spark, d):
    dups = dedup.duplicate_map(table(spark, d, "documents"), dedup.digest("text"), "doc_id")
    return dedup.relink(table(spark, d, "labels"), dups, "doc_id")


@query(f"""
WITH {_DUPS}, sizes AS (
  SELECT sum(octet_length(encode(text)))::BIGINT AS before_size, sum(CASE WHEN duplicate = canonical THEN octet_length(encode(text)) END)::BIGINT AS after_size, count(*) AS n_before, count_if(duplicate = canonical)::BIGINT AS n_after
  FROM documents JOIN dups ON duplicate = doc_id
)
SELECT *, before_size - after_size AS saved_bytes, floor(1000 * (before_size - after_size) / before_size + 0.5)::BIGINT AS saved_tenths FROM sizes""")
def survivor_savings(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", text_bytes().cast("long").alias("size")).where("text is not null")
    rest = dedup.without_duplicates(docs, dedup.duplicate_map(docs, dedup.digest("text"), "doc_id"), "doc_id")
    both = docs.agg(F.sum("size").alias("before_size"), F.count("*").alias("n_before")).crossJoin(rest.agg(F.sum("size").alias("after_size"), F.count("*").alias("n_after")))
    gone, tenths = diff.saved(F.col("before_size"), F.col("after_size"))
    return both.select("*", gone.alias("saved_bytes"), tenths.alias("saved_tenths"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orphans(spark, d):
    used = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return graph.orphans(table(spark, d, "orders").select("o_orderkey", "o_custkey"), used, ["o_orderkey"])


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 5)")
def dangling(spark, d):
    left = table(spark, d, "part").where("p_size > 5").select(F.col("p_partkey").alias("l_partkey"))
    return graph.dangling(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), left, ["l_partkey"])


def _fk_edges(spark, d):
    """Edges region -> nation -> customer -> order, as strings."""
    edge = lambda df, a, x, b, y: df.select(F.concat(F.lit(a), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b), F.col(y).cast("string")).alias("dst"))
    edges = edge(table(spark, d, "nation"), "r", "n_regionkey", "n", "n_nationkey")
    edges = edges.unionByName(edge(table(spark, d, "customer"), "n", "c_nationkey", "c", "c_custkey"))
    return edges.unionByName(edge(table(spark, d, "orders"), "c", "o_custkey", "o", "o_orderkey"))


_FK = """edges AS (
  SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
  UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders
)"""
_REACH = f"WITH RECURSIVE {_FK}, reach AS (SELECT 'r1' AS node UNION SELECT dst FROM reach JOIN edges ON src = node)"


@query(f"{_REACH} SELECT node FROM reach")
def reachable(spark, d):
    return graph.reachable(spark.createDataFrame([("r1",)], "node string"), _fk_edges(spark, d))


@query(f"{_REACH} SELECT 'o' || o_orderkey AS node FROM orders WHERE 'o' || o_orderkey NOT IN (SELECT node FROM reach)")
def unreferenced(spark, d):
    seen = graph.reachable(spark.createDataFrame([("r1",)], "node string"), _fk_edges(spark, d))
    nodes = table(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node"))
    return graph.orphans(nodes, seen, ["node"])


@query(f"""
WITH RECURSIVE {_FK}, tree AS (
  SELECT 'r' || r_regionkey AS node, 0 AS depth FROM region UNION SELECT dst, depth + 1 FROM tree JOIN edges ON src = node WHERE depth < 200
)
SELECT count(*) FILTER (depth > 0) AS elements, max(depth) AS max_depth, array_to_string(list_sort(list(DISTINCT substr(node, 1, 1)) FILTER (depth > 0)), ',') AS types FROM tree""")
def tree_stats(spark, d):
    roots = table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    tree = graph.tree_levels(roots, _fk_edges(spark, d))
    inner = F.when(F.col("depth") > 0, F.substring("node", 1, 1))
    return tree.agg(F.count_if(F.col("depth") > 0).alias("elements"), F.max("depth").alias("max_depth"), F.array_join(F.array_sort(F.collect_set(inner)), ",").alias("types"))


LABELS = ("Fonts", "Images", "Page Content", "Metadata", "Document Structure", "Other Data")
_CLASS_SQL = """CASE WHEN text LIKE '%|%' THEN 'Images' WHEN regexp_matches(text, '[#%&*$]{3}') THEN 'Metadata' WHEN lang = 'fr' THEN 'Fonts'
  WHEN n_chars > 3000 THEN 'Page Content' WHEN lang = 'de' THEN 'Document Structure' ELSE 'Other Data' END"""
_KIND_SQL = f"kinds AS (SELECT doc_id, source, lang, {_CLASS_SQL} AS kind, octet_length(encode(text)) AS size FROM documents)"
_LABEL_SQL = "labels_in_order AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(LABELS)) + ") AS v(position, category))"
_ROLLUP_SQL = f"""{_KIND_SQL}, {_LABEL_SQL}, rollup AS (
  SELECT position, category, coalesce(n, 0) AS n, coalesce(total_size, 0)::BIGINT AS total_size
  FROM labels_in_order LEFT JOIN (SELECT kind, count(*) AS n, sum(size) AS total_size FROM kinds GROUP BY kind) ON kind = category
)"""


def _kinds(spark, d):
    text = F.col("text")
    kind = classify.ladder(
        [
            (text.contains("|"), "Images"),
            (text.rlike(r"[#%&*$]{3}"), "Metadata"),
            (F.col("lang") == "fr", "Fonts"),
            (F.col("n_chars") > 3000, "Page Content"),
            (F.col("lang") == "de", "Document Structure"),
        ],
        "Other Data",
    )
    return table(spark, d, "documents").select("doc_id", "source", "lang", kind.alias("kind"), text_bytes().cast("long").alias("size"))


@query(f"WITH {_ROLLUP_SQL} SELECT * FROM rollup UNION ALL SELECT 6, 'Total', count(*), sum(size)::BIGINT FROM kinds")
def classify_rollup(spark, d):
    return classify.fixed_rollup(_kinds(spark, d), "kind", "size", LABELS)


@query(f"WITH {_ROLLUP_SQL} SELECT *, floor(100 * total_size / sum(total_size) OVER () + 0.5)::BIGINT AS share FROM rollup")
def category_share(spark, d):
    return classify.with_share(classify.fixed_rollup(_kinds(spark, d), "kind", "size", LABELS, None), "total_size")


@query(f'WITH {_KIND_SQL} SELECT CASE WHEN kind = \'Other Data\' THEN lang ELSE \'Miscellaneous\' END AS "group", count(*) AS n, sum(size)::BIGINT AS total_size FROM kinds GROUP BY 1')
def sub_category_rollup(spark, d):
    sub = _kinds(spark, d).withColumn("sub", F.when(F.col("kind") == "Other Data", F.col("lang")))
    return classify.group_rollup(sub, "sub", "size")


@query("SELECT p_partkey, p_brand, p_size, floor(100 * p_size / max(p_size) OVER (PARTITION BY p_brand) + 0.5)::BIGINT AS bar FROM part")
def item_bar(spark, d):
    return classify.with_bar(table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), "p_size", ["p_brand"])


@query("""
SELECT o_custkey, o_orderkey, CASE WHEN n > 10 THEN n - 5 ELSE 0 END AS hidden
FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE n <= 10 OR r <= 5""")
def collapse_topk(spark, d):
    return classify.collapsed(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")


_BEFORE_SQL = f"""{_KIND_SQL}, {_DUPS}, after_side AS (
  SELECT doc_id, CASE WHEN kind = 'Metadata' AND size < 500 THEN 'Other Data' ELSE kind END AS kind, CASE WHEN kind = 'Images' THEN size // 2 ELSE size END AS size
  FROM kinds JOIN dups ON duplicate = doc_id AND duplicate = canonical
)"""


def _before_after(spark, d):
    before = _kinds(spark, d).select("doc_id", "kind", "size")
    left = dedup.without_duplicates(before, dedup.duplicate_map(table(spark, d, "documents"), dedup.digest("text"), "doc_id"), "doc_id")
    moved = F.when((F.col("kind") == "Metadata") & (F.col("size") < 500), "Other Data").otherwise(F.col("kind"))
    return before, left.select("doc_id", moved.alias("kind"), F.when(F.col("kind") == "Images", F.floor(F.col("size") / 2)).otherwise(F.col("size")).cast("long").alias("size"))


@query(f"""
WITH {_BEFORE_SQL}
SELECT b.doc_id, b.kind, b.size::BIGINT AS before_size, a.size::BIGINT AS after_size, (a.size - b.size)::BIGINT AS delta,
       CASE WHEN a.size IS NULL THEN CASE WHEN b.kind = 'Page Content' THEN 'stream merged' ELSE 'removed' END WHEN a.size = b.size THEN 'unchanged' ELSE 'changed' END AS status,
       a.size IS NULL AND e.doc_id IS NOT NULL AS category_changed
FROM kinds b LEFT JOIN after_side a ON a.doc_id = b.doc_id AND a.kind = b.kind LEFT JOIN after_side e ON e.doc_id = b.doc_id WHERE b.size > 0""")
def before_after(spark, d):
    before, after = _before_after(spark, d)
    return diff.item_changes(before, after, ["doc_id"], "kind", "size")


@query(f"""
WITH {_BEFORE_SQL}, {_LABEL_SQL}, b AS (SELECT kind, count(*) AS n, sum(size) AS s FROM kinds GROUP BY kind), a AS (SELECT kind, count(*) AS n, sum(size) AS s FROM after_side GROUP BY kind)
SELECT category, coalesce(b.n, 0) AS before_n, coalesce(b.s, 0)::BIGINT AS before_size, coalesce(a.n, 0) AS after_n, coalesce(a.s, 0)::BIGINT AS after_size, (coalesce(a.s, 0) - coalesce(b.s, 0))::BIGINT AS delta
FROM labels_in_order LEFT JOIN b ON b.kind = category LEFT JOIN a ON a.kind = category WHERE coalesce(b.n, 0) > 0 OR coalesce(a.n, 0) > 0""")
def before_after_categories(spark, d):
    before, after = (classify.fixed_rollup(x, "kind", "size", LABELS, None) for x in _before_after(spark, d))
    return diff.category_changes(before, after)


_RUNGS_SQL = """CASE WHEN l_returnflag = 'A' THEN 'imageMask' WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'smask' WHEN l_discount > 0.08 THEN 'jpx' WHEN l_tax > 0.07 THEN 'filters'
  WHEN l_quantity < 5 THEN 'smallImage' WHEN l_extendedprice * (1 - l_discount) >= 60000 THEN 'sizeGuard' ELSE 'converted' END"""


@query(f"SELECT {_RUNGS_SQL} AS reason, count(*) AS n FROM lineitem GROUP BY 1")
def skip_reasons(spark, d):
    c = F.col
    rungs = [
        (c("l_returnflag") == "A", "imageMask"),
        ((c("l_returnflag") == "R") & (c("l_linestatus") == "O"), "smask"),
        (c("l_discount") > 0.08, "jpx"),
        (c("l_tax") > 0.07, "filters"),
        (c("l_quantity") < 5, "smallImage"),
        (c("l_extendedprice") * (1 - c("l_discount")) >= 60000, "sizeGuard"),
    ]
    return table(spark, d, "lineitem").groupBy(classify.ladder(rungs, "converted").alias("reason")).agg(F.count("*").alias("n"))


@query("""
SELECT l_returnflag, count(*) AS n, count_if(new_size < old_size)::BIGINT AS replaced, sum(CASE WHEN new_size < old_size THEN new_size ELSE old_size END)::BIGINT AS kept_size
FROM (SELECT l_returnflag, (l_partkey % 1000)::BIGINT AS new_size, (l_suppkey % 700)::BIGINT AS old_size FROM lineitem) GROUP BY 1""")
def size_guard(spark, d):
    sizes = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_partkey") % 1000).alias("new_size"), (F.col("l_suppkey") % 700).alias("old_size"))
    kept = diff.smaller_of(F.col("new_size"), F.col("old_size"), F.col("new_size"), F.col("old_size"))
    return sizes.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(F.col("new_size") < F.col("old_size")).alias("replaced"), F.sum(kept).alias("kept_size"))


@query("SELECT o_custkey, min(o_orderkey) AS first_key, arg_min(o_orderpriority, o_orderkey) AS first_priority FROM orders GROUP BY 1")
def first_page_dims(spark, d):
    orders = table(spark, d, "orders")
    return orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_key"), F.min_by("o_orderpriority", "o_orderkey").alias("first_priority"))


@query(r"""
SELECT page_id, nullif(regexp_extract(html, '<html[^>]*\slang="([^"]*)"', 1), '') AS lang,
       nullif(trim(coalesce(nullif(regexp_extract(html, '(?s)<dc:title>(.*?)</dc:title>', 1), ''), nullif(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), ''))), '') AS title,
       regexp_matches(html, '<meta charset=') AS has_charset, coalesce(regexp_extract(html, '</body></html>') <> '', false) AS is_closed FROM pages""")
def traits(spark, d):
    html = F.col("html")
    return table(spark, d, "pages").select(
        "page_id",
        T.first_match(html, r'<html[^>]*\slang="([^"]*)"').alias("lang"),
        F.nullif(F.trim(T.first_match(html, r"(?s)<dc:title>(.*?)</dc:title>", r"(?s)<title>(.*?)</title>")), F.lit("")).alias("title"),
        html.contains("<meta charset=").alias("has_charset"),
        html.contains("</body></html>").alias("is_closed"),
    )


@query(r"""
WITH t AS (SELECT page_id, contains(html, 'lang="') AS lang, contains(html, '<title>') AS title, contains(html, '<nav>') AS nav, contains(html, '</body></html>') AS closed, contains(html, 'pdfaid:part') AS pdfa FROM pages)
SELECT page_id, 'Language' AS "check", CASE WHEN lang THEN 'pass' ELSE 'fail' END AS status FROM t UNION ALL SELECT page_id, 'Title', CASE WHEN title THEN 'pass' ELSE 'fail' END FROM t
UNION ALL SELECT page_id, 'Navigation', CASE WHEN nav THEN 'pass' ELSE 'fail' END FROM t UNION ALL SELECT page_id, 'Closed', CASE WHEN closed THEN 'pass' ELSE 'fail' END FROM t
UNION ALL SELECT page_id, 'PDF/A', CASE WHEN pdfa THEN 'pass' ELSE 'neutral' END FROM t""")
def checklist(spark, d):
    has = F.col("html").contains
    return audit.checklist(table(spark, d, "pages"), ["page_id"], {"Language": has('lang="'), "Title": has("<title>"), "Navigation": has("<nav>"), "Closed": has("</body></html>")}, {"PDF/A": has("pdfaid:part")})


@query("SELECT lang, count(*) AS total, count(quality) AS with_it, count(*) - count(quality) AS without_it FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def coverage(spark, d):
    both = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return audit.coverage(both, F.col("quality").isNotNull(), ["lang"])


_STRIP = r"(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"


@query(rf"""
SELECT page_id, len(regexp_extract_all(html, '{_STRIP}'))::BIGINT AS stripped, (length(html) - length(regexp_replace(html, '{_STRIP.replace("(?s)", "")}', '', 'gs')))::BIGINT AS chars_saved FROM pages""")
def strip_keys(spark, d):
    html = F.col("html")
    return table(spark, d, "pages").select(
        "page_id", F.regexp_count(html, F.lit(_STRIP)).cast("long").alias("stripped"), (F.length(html) - F.length(F.regexp_replace(html, _STRIP, ""))).cast("long").alias("chars_saved")
    )


@query("""
SELECT event_id, user_id, event_type, last_value(CASE WHEN event_type = 'login' OR value > 50 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS current_type FROM events""")
def carry_forward(spark, d):
    events = table(spark, d, "events")
    sets = F.when((F.col("event_type") == "login") | (F.col("value") > 50), F.col("event_type"))
    return sequences.carried(events, sets, ["user_id"], ["ts", "event_id"], "current_type").select("event_id", "user_id", "event_type", "current_type")


@query("""
WITH marked AS (SELECT conv_id, turn, role, CASE WHEN length(text) % 5 = 0 THEN length(text) END AS reset FROM conversations),
runs AS (
  SELECT *, count(reset) OVER w AS run, coalesce(last_value(reset IGNORE NULLS) OVER w, 0) AS base FROM marked WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, turn, role, (base + count(*) FILTER (reset IS NULL) OVER (PARTITION BY conv_id, run ORDER BY turn ROWS UNBOUNDED PRECEDING) - 1)::BIGINT AS code FROM runs WHERE reset IS NULL""")
def differences_codes(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    reset = F.when(F.length("text") % 5 == 0, F.length("text"))
    return sequences.running_codes(turns, reset, ["conv_id"], ["turn"]).select("conv_id", "turn", "role", "code")


@query("""
SELECT DISTINCT lang, ord(c)::INT AS code FROM (SELECT lang, unnest(string_split(regexp_replace(text, '[^ -~]', '', 'g'), '')) AS c FROM documents) WHERE c <> ''""")
def used_codes(spark, d):
    docs = table(spark, d, "documents").select("lang", F.regexp_replace("text", "[^ -~]", "").alias("t"))
    chars = docs.select("lang", F.explode(F.array_distinct(F.split("t", ""))).alias("c")).where("c <> ''")
    return chars.select("lang", F.ascii("c").alias("code")).distinct()


@query("""
SELECT DISTINCT lang, ('0x' || h)::INT AS code FROM (SELECT lang, unnest(regexp_extract_all(hex(encode(text)), '..')) AS h FROM documents)""")
def used_codes_bytes(spark, d):
    """Every byte code of whole texts, as fonts of one-byte codes show them."""
    docs = table(spark, d, "documents").select("lang", F.array_distinct(F.regexp_extract_all(F.hex("text"), F.lit(".."), F.lit(0))).alias("digits"))
    return docs.select("lang", F.explode("digits").alias("h")).distinct().select("lang", F.conv("h", 16, 10).cast("int").alias("code"))


@query("SELECT n_nationkey, hex(encode(n_name)) AS hexed, n_name AS decoded FROM nation")
def codec_hex(spark, d):
    from .functions.codecs import ascii_hex_column

    hexed = table(spark, d, "nation").select("n_nationkey", "n_name", F.hex("n_name").alias("hexed"))
    return hexed.select("n_nationkey", "hexed", F.decode(ascii_hex_column(F.concat(F.lower("hexed"), F.lit(">"))), "UTF-8").alias("decoded"))


@query("""
SELECT doc_id, CASE WHEN s < 1024 THEN s || ' B' WHEN s < 1048576 THEN (floor(s * 10 / 1024 + 0.5)::BIGINT // 10) || '.' || (floor(s * 10 / 1024 + 0.5)::BIGINT % 10) || ' KB'
       ELSE (floor(s * 10 / 1048576 + 0.5)::BIGINT // 10) || '.' || (floor(s * 10 / 1048576 + 0.5)::BIGINT % 10) || ' MB' END AS label
FROM (SELECT doc_id, n_chars * (1 + doc_id % 700) AS s FROM documents)""")
def format_size(spark, d):
    return table(spark, d, "documents").select("doc_id", T.size_label(F.col("n_chars") * (1 + F.col("doc_id") % 700)).alias("label"))


@query("""
SELECT coalesce(event_type, 'Total') AS pass, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS total FROM events GROUP BY GROUPING SETS ((event_type), ())""")
def pass_timing(spark, d):
    cents = F.round(F.col("value") * 100).cast("long")
    return table(spark, d, "events").rollup("event_type").agg(F.count("*").alias("n"), F.sum(cents).alias("total")).select(F.coalesce("event_type", F.lit("Total")).alias("pass"), "n", "total")


@query("""
SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS total_chars, CASE WHEN sum(n_chars) >= 100000 THEN 'large' WHEN sum(n_chars) >= 40000 THEN 'medium' ELSE 'small' END AS tier FROM documents GROUP BY source""")
def batch_totals(spark, d):
    per = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("total_chars"))
    return per.withColumn("tier", classify.ladder([(F.col("total_chars") >= 100_000, "large"), (F.col("total_chars") >= 40_000, "medium")], "small"))


@query(r"""
SELECT doc_id, replace(replace(replace(replace(replace(substr(text, 1, 40), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') || CASE WHEN length(text) > 40 THEN '…' ELSE '' END AS label FROM documents""")
def escaped_labels(spark, d):
    short = F.when(F.length("text") > 40, F.lit("…")).otherwise(F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.concat(T.escaped(F.substring("text", 1, 40)), short).alias("label"))


def _as_files(spark, d, shapes=(), contents=None):
    """Every document as a one-page PDF file: object 4 is a stream of ``contents`` (its text), the page is object 3; ``shapes`` are (number, dictionary, stream or null) of more objects, or in place of these."""
    from .sinks.pdf import write_pdf
    from .sources.pdf import Tables

    docs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("file_id"), "text")
    plain = {1: '{"Type":"/Catalog","Pages":{"r":[2,0]}}', 2: '{"Type":"/Pages","Kids":[{"r":[3,0]}],"Count":1}', 3: '{"Type":"/Page","Parent":{"r":[2,0]},"MediaBox":[0,0,612,792],"Contents":{"r":[4,0]}}'}
    own = {n: (text, None) for n, text in plain.items()} | {4: ("{}", F.encode("text", "UTF-8") if contents is None else contents)} | {n: (text, data) for n, text, data in shapes}
    parts = [F.struct(F.lit(n).alias("obj_num"), F.lit(text).alias("dict"), (F.lit(None) if data is None else data).cast("binary").alias("contents")) for n, (text, data) in own.items()]
    rows = docs.select("file_id", F.explode(F.array(*parts)).alias("o")).select("file_id", "o.obj_num", F.lit(0).alias("gen_num"), "o.dict", "o.contents")
    objects = rows.withColumn("kind", F.when(F.col("contents").isNotNull(), "stream").when(F.col("dict").startswith("["), "array").otherwise("dict"))
    roots = docs.select("file_id", F.lit("Root").alias("key"), F.lit(1).alias("dst_num"), F.lit(0).alias("dst_gen"))
    return write_pdf(Tables(objects, None, roots, None))


@query("""
SELECT doc_id AS file_id, position, category, CASE category WHEN 'Page Content' THEN 1 WHEN 'Document Structure' THEN 3 ELSE 0 END::BIGINT AS n,
       CASE category WHEN 'Page Content' THEN octet_length(encode(text)) ELSE 0 END::BIGINT AS total_size
FROM documents, (VALUES """ + ", ".join(f"({i}, '{x}')" for i, x in enumerate(LABELS)) + """) AS v(position, category) WHERE text IS NOT NULL""")
def pdf_inspect(spark, d):
    """Files written, parsed and classified."""
    from .plans.inspect import category_totals, inspect_items
    from .session import stored
    from .sources.pdf import PARSED, _parsed, tables_of

    t = tables_of(stored(_as_files(spark, d).mapInArrow(_parsed, PARSED)))
    return category_totals(inspect_items(t)).select("file_id", "position", "category", "n", "total_size")


def _shown_codes(spark, d, text):
    """Codes of content streams that show the bytes of ``text``."""
    from .functions.tokens import tokenise, used_codes

    data = F.encode(F.concat(F.lit("BT /F1 12 Tf <"), F.hex(text), F.lit("> Tj ET")), "UTF-8")
    streams = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("file_id"), F.lit("page 1").alias("scope_id"), data.alias("data"))
    return used_codes(tokenise(streams)).select("file_id", "font", "code")


@query("""
SELECT DISTINCT doc_id AS file_id, 'F1' AS font, ord(c)::INT AS code
FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '[^ -~]', '', 'g'), '')) AS c FROM documents) WHERE c <> ''""")
def pdf_used_codes(spark, d):
    """Codes that content streams show, by the font set before them."""
    return _shown_codes(spark, d, F.regexp_replace("text", "[^ -~]", ""))


@query("""
SELECT DISTINCT doc_id AS file_id, 'F1' AS font, ('0x' || h)::INT AS code FROM (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS h FROM documents)""")
def pdf_used_codes_bytes(spark, d):
    """The same of whole texts, every byte of them."""
    return _shown_codes(spark, d, F.col("text"))


#: Characters of the codes 128 to 159 in WinAnsi encoding; a blank where there is none.
_HIGH = "€ ‚ƒ„…†‡ˆ‰Š‹Œ Ž  ‘’“”•–—˜™š›œ žŸ"


@query(f"""
SELECT file_id, '6' AS font, 'Helvetica' AS base_font, code, CASE WHEN code BETWEEN 32 AND 126 OR code > 159 THEN chr(code) WHEN code > 127 THEN nullif(substr('{_HIGH}', code - 127, 1), ' ') END AS text
FROM (SELECT DISTINCT doc_id AS file_id, ('0x' || h)::INT AS code FROM (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS h FROM documents))""")
def pdf_font_text(spark, d):
    """Files written and parsed, then text of fonts: two content streams a page, resources behind references."""
    from .plans.shown import font_text
    from .session import stored
    from .sources.pdf import PARSED, _parsed, tables_of

    page = '{"Type":"/Page","Parent":{"r":[2,0]},"MediaBox":[0,0,612,792],"Contents":{"r":[7,0]},"Resources":{"r":[5,0]}}'
    font = '{"Type":"/Font","Subtype":"/Type1","BaseFont":"/Helvetica","Encoding":"/WinAnsiEncoding"}'
    shown = F.encode(F.concat(F.lit("<"), F.hex("text"), F.lit("> Tj ET")), "UTF-8")
    shapes = [(3, page, None), (5, '{"Font":{"F1":{"r":[6,0]}}}', None), (6, font, None), (7, '[{"r":[4,0]},{"r":[8,0]}]', None), (8, "{}", shown)]
    files = _as_files(spark, d, shapes, F.lit("BT /F1 12 Tf"))
    t = tables_of(stored(files.mapInArrow(_parsed, PARSED)))
    return font_text(t).select("file_id", "font", "base_font", "code", "text")
