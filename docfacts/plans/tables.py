"""Staging, listing, queue and duplicate queries over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfacts.functions import ids, text
from docfacts.operators import classify, dedupe, listing, staging
from docfacts.plans.catalogue import query
from docfacts.sources.tables import table

HEADER_SQL = """
h AS (SELECT o_orderkey AS id, o_custkey AS provider, CASE o_orderstatus WHEN 'O' THEN 'A' WHEN 'F' THEN 'B' END AS letra, lpad(CAST(o_custkey % 9000 + 1 AS VARCHAR), 4, '0') AS punto_venta,
             CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE lpad(CAST(o_orderkey AS VARCHAR), 8, '0') END AS numero, CAST(o_totalprice AS DECIMAL(15,2)) AS total,
             CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS importada FROM orders)"""


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as staging headers."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), F.col("o_custkey").alias("provider"), F.when(F.col("o_orderstatus") == "O", "A").when(F.col("o_orderstatus") == "F", "B").alias("letra"),
        F.lpad((F.col("o_custkey") % 9000 + 1).cast("string"), 4, "0").alias("punto_venta"), F.when(k % 13 != 0, F.lpad(k.cast("string"), 8, "0")).alias("numero"),
        F.col("o_totalprice").cast("decimal(15,2)").alias("total"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("importada"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("factura_id"), F.col("l_linenumber").alias("linea"), F.col("l_partkey").alias("part"), F.col("l_extendedprice").cast("decimal(15,2)").alias("subtotal"),
        F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("flag"),
    )


PENDING_SQL = f"""WITH {HEADER_SQL}
SELECT h.id, coalesce(letra, '') || ' ' || coalesce(punto_venta, '') || '-' || coalesce(numero, '') AS comprobante, total, c_name AS mail
FROM h LEFT JOIN customer ON c_custkey = provider AND c_custkey % 2 = 0 WHERE importada = 0
"""


@query("pending_view", PENDING_SQL)
def q_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = headers(spark, sf_dir)
    mails = h.join(table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0"), F.col("provider") == F.col("c_custkey")).select(F.col("id").alias("factura_id"), F.col("c_name").alias("mail"))
    return staging.pending_view(headers(spark, sf_dir), mails, ["id", "comprobante", "total", "mail"])


DETAIL_SQL = f"""WITH {HEADER_SQL}
SELECT l_orderkey AS factura_id, l_linenumber AS linea, CAST(l_extendedprice AS DECIMAL(15,2)) AS subtotal, letra, punto_venta, numero FROM lineitem JOIN h ON h.id = l_orderkey
"""


@query("detail_view", DETAIL_SQL)
def q_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.detail_view(lines(spark, sf_dir), headers(spark, sf_dir), ["factura_id", "linea", "subtotal"], ["letra", "punto_venta", "numero"])


TAX_SQL = f"""WITH {HEADER_SQL},
p AS (SELECT l_orderkey AS factura_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_tax) AS linea, l_returnflag AS codjur, CAST(round(CAST(l_extendedprice AS DECIMAL(15,2)) * CAST(l_tax AS DECIMAL(4,2)), 2) AS DECIMAL(18,2)) AS importe
      FROM lineitem WHERE l_tax > 0)
SELECT factura_id, linea, codjur, importe, letra FROM p JOIN h ON h.id = factura_id
"""


@query("tax_view", TAX_SQL)
def q_tax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perception lines with an amount, numbered anew after the filter."""
    l = table(spark, sf_dir, "lineitem").filter("l_tax > 0")  # noqa: E741
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_tax"]
    p = staging.number_lines(l.select(F.col("l_orderkey").alias("factura_id"), *order, F.col("l_returnflag").alias("codjur"), F.round(F.col("l_extendedprice").cast("decimal(15,2)") * F.col("l_tax").cast("decimal(4,2)"), 2).cast("decimal(18,2)").alias("importe")), "factura_id", [F.col(c) for c in order])
    return staging.detail_view(p, headers(spark, sf_dir), ["factura_id", "linea", "codjur", "importe"], ["letra"])


BACKFILL_SQL = """
WITH b AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'FACTURA' WHEN 1 THEN 'NOTA DEBITO' ELSE 'nota credito' END AS kind, CASE o_orderstatus WHEN 'O' THEN 'A' WHEN 'F' THEN 'B' ELSE 'c' END AS letter,
                  CASE WHEN o_orderkey % 5 = 0 THEN '999' ELSE '' END AS code FROM orders)
SELECT id, CASE WHEN code <> '' THEN code ELSE CASE upper(replace(kind, ' ', '_')) || upper(letter) WHEN 'FACTURAA' THEN '001' WHEN 'FACTURAB' THEN '006' WHEN 'FACTURAC' THEN '011'
       WHEN 'NOTA_DEBITOA' THEN '002' WHEN 'NOTA_DEBITOB' THEN '007' WHEN 'NOTA_DEBITOC' THEN '012' WHEN 'NOTA_CREDITOA' THEN '003' WHEN 'NOTA_CREDITOB' THEN '008' WHEN 'NOTA_CREDITOC' THEN '013' ELSE '' END END AS code
FROM b
"""


@query("backfill_code_case", BACKFILL_SQL)
def q_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    kind = F.when(k % 3 == 0, "FACTURA").when(k % 3 == 1, "NOTA DEBITO").otherwise("nota credito")
    letter = F.when(F.col("o_orderstatus") == "O", "A").when(F.col("o_orderstatus") == "F", "B").otherwise("c")
    code = F.when(k % 5 == 0, "999").otherwise("")
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.when(code != "", code).otherwise(ids.code_of_type(kind, letter)).alias("code"))


CONFIRM_SQL = """
SELECT l_orderkey AS factura_id, l_linenumber AS linea, CASE WHEN l_partkey % 10 = 0 THEN p_brand ELSE 'sin cuenta' END AS cuenta, CASE WHEN l_partkey % 10 = 0 THEN 1 ELSE 0 END AS confirmada
FROM lineitem LEFT JOIN part ON p_partkey = l_partkey
"""


@query("confirm_overlay", CONFIRM_SQL)
def q_confirm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).select("factura_id", "linea", "part", F.lit("sin cuenta").alias("cuenta"), F.lit(0).alias("confirmada"))
    changes = table(spark, sf_dir, "part").filter("p_partkey % 10 = 0").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("cuenta"), F.lit(1).alias("confirmada"))
    return staging.overlay(rows, changes, "part").select("factura_id", "linea", "cuenta", "confirmada")


IMPORT_SQL = f"""WITH {HEADER_SQL}
SELECT id AS factura_id, 1 AS importada, CASE WHEN importada = 0 THEN 'IMPORTADA' END AS evento, CASE WHEN importada = 0 THEN 'Total ' || CAST(total AS VARCHAR) END AS detalle,
       CASE WHEN importada = 0 THEN 'erp' END AS usuario FROM h
"""


@query("import_overlay", IMPORT_SQL)
def q_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All headers after the pending ones are marked as imported, each with the audit row of its change."""
    rows = headers(spark, sf_dir)
    due = rows.filter("importada = 0")
    done = staging.overlay(rows, due.select("id", F.lit(1).alias("importada")), "id")
    audit = staging.events(due, F.col("id"), "IMPORTADA", F.concat(F.lit("Total "), F.col("total").cast("string")), "erp")
    return done.select(F.col("id").alias("factura_id"), F.col("importada").cast("int").alias("importada")).join(audit, "factura_id", "left")


REPLACE_SQL = f"""WITH {HEADER_SQL}
SELECT l_orderkey AS factura_id, count(*) AS n, CAST(sum(CASE WHEN l_orderkey % 10 = 0 AND importada = 0 THEN 1.00 ELSE CAST(l_extendedprice AS DECIMAL(15,2)) END) AS DECIMAL(25,2)) AS total
FROM lineitem JOIN h ON h.id = l_orderkey GROUP BY l_orderkey
"""


@query("replace_children", REPLACE_SQL)
def q_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every tenth document replaced by lines of 1.00, except of documents already imported."""
    old = lines(spark, sf_dir)
    new = old.filter("factura_id % 10 = 0").withColumn("subtotal", F.lit(1).cast("decimal(15,2)"))
    frozen = headers(spark, sf_dir).filter("importada = 1").select(F.col("id").alias("factura_id"))
    kept = staging.replace_children(old, new, "factura_id", frozen)
    return kept.join(headers(spark, sf_dir).select(F.col("id").alias("factura_id")), "factura_id", "left_semi").groupBy("factura_id").agg(F.count("*").alias("n"), F.sum("subtotal").cast("decimal(25,2)").alias("total"))


LIST_SQL = """
l AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'OK' WHEN 'F' THEN 'REVIEW_REQUIRED' ELSE 'ERROR' END AS estado, o_orderstatus = 'F' AS revision, lpad(CAST(c_custkey AS VARCHAR), 11, '0') AS cuit,
             c_name AS nombre, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS fecha, o_orderpriority AS clase, c_mktsegment AS tipo, 'doc_' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS archivo
      FROM orders JOIN customer ON c_custkey = o_custkey)"""
COLUMNS = {"status": "estado", "review": "revision", "tax_id": "cuit", "name": "nombre", "date": "fecha", "document": "clase", "kind": "tipo"}
HAYSTACK = ("archivo", "nombre", "cuit", "tipo", "clase")


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the list of processed documents."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    k = F.col("o_orderkey")
    return o.select(
        k.alias("id"), F.when(F.col("o_orderstatus") == "O", "OK").when(F.col("o_orderstatus") == "F", "REVIEW_REQUIRED").otherwise("ERROR").alias("estado"), (F.col("o_orderstatus") == "F").alias("revision"),
        F.lpad(F.col("c_custkey").cast("string"), 11, "0").alias("cuit"), F.col("c_name").alias("nombre"), F.when(k % 17 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("fecha"),
        F.col("o_orderpriority").alias("clase"), F.col("c_mktsegment").alias("tipo"), F.concat(F.lit("doc_"), F.lpad(k.cast("string"), 9, "0")).alias("archivo"),
    )


def _filter_query(label: str, where: str, **given) -> None:
    @query(f"list_filter_{label}", f"WITH {LIST_SQL} SELECT id, estado, cuit FROM l WHERE {where}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return listed(spark, sf_dir).filter(listing.matching(columns=COLUMNS, haystack=HAYSTACK, **given)).select("id", "estado", "cuit")


_filter_query("status", "estado = 'OK'", status="OK")
_filter_query("review", "revision", review="yes")
_filter_query("id_contains", "contains(cuit, '07')", tax_id="07")
_filter_query("name_ci", "contains(lower(nombre), 'customer#00000001')", name="CUSTOMER#00000001")
_filter_query("date_range", "coalesce(fecha, '') >= '1995-01-01' AND coalesce(fecha, '') <= '1996-06-30'", since="1995-01-01", until="1996-06-30")
_filter_query("until_keeps_nulls", "coalesce(fecha, '') <= '1993-01-01'", until="1993-01-01")
_filter_query("class_ci", "lower(clase) = '1-urgent'", document="1-Urgent")
_filter_query("type_ci", "lower(tipo) = 'building'", kind="Building")
_filter_query("free_text", "contains(lower(concat_ws(' ', archivo, nombre, cuit, tipo, clase)), 'ing 2-h')", free="ING 2-H")
_filter_query("combined", "estado = 'OK' AND NOT revision AND lower(tipo) = 'machinery' AND coalesce(fecha, '') >= '1997-01-01'", status="OK", review="0", kind="machinery", since="1997-01-01")

PAGE_SQL = f"""WITH {LIST_SQL},
p AS (SELECT *, row_number() OVER (ORDER BY archivo DESC) AS place FROM l), m AS (SELECT *, count(*) OVER () AS total FROM p WHERE estado = 'OK')
SELECT place, archivo, total FROM m ORDER BY archivo DESC LIMIT 50 OFFSET 20
"""


@query("page_positional_id", PAGE_SQL)
def q_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a filtered list; places count from the unfiltered one, the total is that of the filter."""
    found = listing.with_position(listed(spark, sf_dir), "archivo", "place").filter("estado = 'OK'")
    total = found.agg(F.count("*")).scalar()
    return listing.page(found, [F.desc("archivo")], "bad", 20).select("place", "archivo", total.alias("total"))


SUMMARY_SQL = f"""WITH {LIST_SQL}
SELECT count(*) AS total, count(*) FILTER (estado = 'OK' AND NOT revision) AS ok, count(*) FILTER (revision OR estado = 'REVIEW_REQUIRED') AS review_required, count(*) FILTER (estado = 'ERROR') AS errors,
       count(*) FILTER (estado = 'DUPLICATE') AS duplicates, count(*) FILTER (clase IN ('NO_FISCAL', 'ILEGIBLE', 'OTRO', 'REMITO', 'PRESUPUESTO')) AS non_invoice FROM l
"""


@query("summary_counts", SUMMARY_SQL)
def q_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("estado")
    return listed(spark, sf_dir).agg(
        F.count("*").alias("total"), F.count_if((e == "OK") & ~F.col("revision")).alias("ok"), F.count_if(F.col("revision") | (e == "REVIEW_REQUIRED")).alias("review_required"),
        F.count_if(e == "ERROR").alias("errors"), F.count_if(e == "DUPLICATE").alias("duplicates"),
        F.count_if(F.col("clase").isin("NO_FISCAL", "ILEGIBLE", "OTRO", "REMITO", "PRESUPUESTO")).alias("non_invoice"),
    )


@query("top_providers", f"WITH {LIST_SQL} SELECT coalesce(nullif(nombre, ''), '?') AS key, count(*) AS n, min(id) AS first_seen FROM l GROUP BY 1 ORDER BY n DESC, first_seen LIMIT 20")
def q_top_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.top_counts(listed(spark, sf_dir), F.coalesce(F.nullif("nombre", F.lit("")), F.lit("?")), "id", 20)


FAULTS_SQL = """
WITH f AS (SELECT o_orderkey AS id, unnest(list_filter([CASE WHEN o_orderkey % 2 = 0 THEN 'par' END, CASE WHEN o_orderkey % 3 = 0 THEN 'tres' END, o_orderpriority], lambda x: x IS NOT NULL)) AS fault FROM orders)
SELECT fault AS key, count(*) AS n, min(id) AS first_seen FROM f GROUP BY fault ORDER BY n DESC, first_seen LIMIT 10
"""


@query("top_faults", FAULTS_SQL)
def q_top_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    faults = F.array_compact(F.array(F.when(k % 2 == 0, "par"), F.when(k % 3 == 0, "tres"), F.col("o_orderpriority")))
    return listing.top_counts(table(spark, sf_dir, "orders").select(k.alias("id"), F.explode(faults).alias("fault")), F.col("fault"), "id", 10)


@query("queue_status", "SELECT event_type AS state, count(*) AS n, max(event_id) AS newest FROM events GROUP BY event_type")
def q_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("state")).agg(F.count("*").alias("n"), F.max("event_id").alias("newest"))


@query("newest_per_state", "SELECT event_type, event_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS rank FROM events) WHERE rank <= 15")
def q_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.newest(table(spark, sf_dir, "events").select("event_type", "event_id"), "event_type", "event_id", 15)


TTL_SQL = """
SELECT event_id, coalesce(date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id), ts) < 259201 * 1000000::BIGINT, false) AS is_repeat FROM events
"""


@query("ttl_dedupe_exact", TTL_SQL)
def q_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    return dedupe.ttl_repeats(e, ["user_id", "event_type"], "ts", 72, ["event_id"]).select("event_id", "is_repeat")


HAMMING_SQL = """
WITH e AS (SELECT vec_id, embedding FROM embeddings UNION ALL SELECT vec_id + 10000000, list_concat([-embedding[1], -embedding[2]], list_slice(embedding, 3, 64)) FROM embeddings),
h AS (SELECT vec_id, list_transform(range(0, 8), lambda k: CAST(list_sum(list_transform(range(0, 32), lambda i:
             CASE WHEN CAST(embedding[k * 8 + i // 4 + 1] AS DOUBLE) > ([-0.1, 0.0, 0.1, 0.2]::DOUBLE[])[i % 4 + 1] THEN 1::BIGINT << i ELSE 0::BIGINT END)) AS BIGINT)) AS bits FROM e),
p AS (SELECT a.vec_id AS a, b.vec_id AS b, CAST(list_sum(list_transform(range(1, 9), lambda k: bit_count(xor(a.bits[k], b.bits[k])))) AS INTEGER) AS distance FROM h a JOIN h b ON a.vec_id < b.vec_id)
SELECT a, b, distance FROM p WHERE distance <= 12
"""


@query("near_dup_hamming", HAMMING_SQL)
def q_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors, and of those with two components turned over, whose 256-bit hashes, four steps of each of the 64 components, differ in twelve bits at most."""
    own = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    turned = F.transform("embedding", lambda x, i: F.when(i < 2, -x).otherwise(x))
    rows = own.unionByName(own.select((F.col("vec_id") + 10_000_000).alias("vec_id"), turned.alias("embedding")))
    steps = (-0.1, 0.0, 0.1, 0.2)
    longs = []
    for k in range(8):
        bits = F.lit(0).cast("long")
        for i in range(32):
            bits = bits + F.when(F.get("embedding", F.lit(k * 8 + i // 4)).cast("double") > steps[i % 4], F.lit(1 << i).cast("long")).otherwise(0)
        longs.append(bits)
    return dedupe.hash_pairs(rows, "vec_id", longs, 32, 12)


FIRST_SQL = "SELECT doc_id, sha256(text) AS sha256, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1 AS is_first FROM documents"


@query("dedupe_sha_first", FIRST_SQL)
def q_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.first_seen(table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("text"), [F.col("doc_id")]).select("doc_id", "sha256", "is_first")


UNSEEN_SQL = "SELECT count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) AND o_orderkey NOT IN (SELECT event_id FROM events)"


@query("idempotent_enqueue", UNSEEN_SQL)
def q_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that neither the staging nor the queue has."""
    staged = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"))
    queued = table(spark, sf_dir, "events").select(F.col("event_id").alias("k"))
    return dedupe.unseen(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), "k", staged, queued).agg(F.count("*").alias("n"))


ACC, PLAIN = "ÁÉÍÓÚÜÑÇÀÈÌÒÙÂÊÎÔÛÄËÏÖáéíóúüñçàèìòùâêîôûäëïö", "AEIOUUNCAEIOUAEIOUAEIOaeiouuncaeiouaeiouaeio"
NORMAL_SQL = f"WITH f AS (SELECT doc_id, upper(replace(translate(text, '{ACC}', '{PLAIN}'), 'ß', 'ss')) AS folded FROM documents) SELECT *, trim(regexp_replace(folded, '[^A-Z0-9]+', ' ', 'g')) AS key FROM f"


@query("normalize_label", NORMAL_SQL)
def q_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.fold(c).alias("folded"), text.accounting_key(c).alias("key"))


TIDY_SQL = r"""
SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', E'\n\n', 'g'), E' \t\r\n') AS tidy,
       len(list_filter(list_transform(string_split(trim(regexp_replace(text, '[ \t]+', ' ', 'g'), E' \t\r\n'), E'\n'), lambda x: trim(x)), lambda x: x <> '')) AS n_lines FROM documents
"""


@query("whitespace", TIDY_SQL)
def q_tidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.tidy(c).alias("tidy"), F.size(text.lines(c)).cast("long").alias("n_lines"))


def _words_sql(words) -> str:
    return " OR ".join(f"regexp_matches(u, '{w}')" if w.startswith("\\b") else f"contains(u, '{w}')" for w in words)


CLASSIFY_SQL = (
    "WITH t AS (SELECT doc_id, upper(text) AS u FROM documents) SELECT doc_id, CASE WHEN trim(u) = '' THEN 'ILEGIBLE' "
    + " ".join(f"WHEN {_words_sql(w)} THEN '{k}'" for k, w in classify.KEYWORDS.items())
    + " ELSE 'OTRO_DOCUMENTO' END AS tipo FROM t"
)


@query("classify_keywords", CLASSIFY_SQL)
def q_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", classify.by_words(F.col("text")).alias("tipo"))


LINES_SQL = r"""
WITH l AS (SELECT page_id, string_split(html, E'\n') AS ls FROM pages)
SELECT page_id, unnest(range(0, len(ls))) AS pos, unnest(ls) AS line FROM l
"""


@query("lines_posexplode", LINES_SQL)
def q_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split("html", "\n")).alias("pos", "line")).select("page_id", F.col("pos").cast("long").alias("pos"), "line")


FIRST_LINE_SQL = r"""SELECT page_id, coalesce(trim(list_filter(string_split(html, E'\n'), lambda x: regexp_matches(x, '(?i)<p'))[1]), '') AS line FROM pages"""


@query("first_matching_line", FIRST_LINE_SQL)
def q_first_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = F.filter(F.split("html", "\n"), lambda x: x.rlike("(?i)<p"))
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(F.btrim(F.get(hits, F.lit(0))), F.lit("")).alias("line"))


JSON_SQL = "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"


@query("json_payload_decode", JSON_SQL)
def q_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long").alias("p")).select("event_id", "p.k")


FLAT_SQL = """
SELECT conv_id, count(*) AS turns, string_agg(role, '; ' ORDER BY turn) AS roles, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id
"""


@query("flatten_nested", FLAT_SQL)
def q_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations nested, then flattened with their lists joined."""
    nested = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").alias("chars")))).alias("turns"))
    return nested.select("conv_id", F.size("turns").cast("long").alias("turns"), F.array_join(F.col("turns.role"), "; ").alias("roles"), F.aggregate("turns", F.lit(0).cast("long"), lambda a, x: a + x["chars"]).alias("chars"))


@query("redact_keys", "SELECT event_id, '***' AS api_token, event_type AS name FROM events")
def q_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = listing.redacted(F.create_map(F.lit("api_token"), F.col("props"), F.lit("name"), F.col("event_type")))
    return table(spark, sf_dir, "events").select("event_id", m.alias("m")).select("event_id", F.col("m")["api_token"].alias("api_token"), F.col("m")["name"].alias("name"))


CUT_SQL = r"""
WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 80 THEN t ELSE CASE WHEN contains(substr(t, 1, 80), ' ') THEN regexp_replace(substr(t, 1, 80), ' [^ ]*$', '') ELSE substr(t, 1, 80) END || '…' END AS shown FROM c
"""


@query("truncate_words", CUT_SQL)
def q_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.cut_words(F.col("text"), 80).alias("shown"))


ENQUEUE_SQL = """
WITH u AS (SELECT doc_id, sha256(text) AS sha256, doc_id % 50 = 0 AS forced, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1 AS first,
                  EXISTS (SELECT 1 FROM documents k WHERE k.doc_id % 7 = 0 AND k.text = documents.text) AS known FROM documents WHERE text IS NOT NULL)
SELECT doc_id, sha256, 'QUEUED' AS status, CASE WHEN doc_id % 2 = 0 THEN 'pdf' ELSE 'png' END AS extension, forced AS "force" FROM u WHERE forced OR (first AND NOT known)
"""


@query("job_enqueue", ENQUEUE_SQL)
def q_enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as uploads, in the order of their ids; every seventh is known, every fiftieth forced."""
    from docfacts.operators import jobs

    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    name = F.concat(F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.when(F.col("doc_id") % 2 == 0, ".PDF").otherwise(""))
    uploads = d.select(
        F.col("text").alias("content"), name.alias("original_filename"), F.lit("image/png").alias("mime"), F.lit("email").alias("source_type"), (F.col("doc_id") % 50 == 0).alias("force"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("queued_at"),
    )
    known = d.filter("doc_id % 7 = 0 and text is not null").select(F.sha2("text", 256).alias("sha256"))
    rows = jobs.enqueued(uploads, known)
    return rows.select(F.regexp_extract("original_filename", r"^(\d+)", 1).cast("long").alias("doc_id"), "sha256", "status", "extension", "force")


LEARN_SQL = """
WITH r AS (SELECT s_suppkey AS proveedor, 'R' AS patron, 'vieja' AS cuenta, 80 AS confianza, 3 AS veces, 'historico' AS origen FROM supplier WHERE s_suppkey % 2 = 0),
d AS (SELECT l_suppkey AS proveedor, l_returnflag AS patron, max(l_linestatus) AS cuenta, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT coalesce(r.proveedor, d.proveedor) AS proveedor, coalesce(r.patron, d.patron) AS patron, coalesce(d.cuenta, r.cuenta) AS cuenta, CASE WHEN d.n IS NOT NULL THEN 100 ELSE r.confianza END AS confianza,
       CAST(coalesce(r.veces, 0) + coalesce(d.n, 0) AS BIGINT) AS veces_confirmada, CASE WHEN d.n IS NOT NULL THEN 'manual' ELSE r.origen END AS origen
FROM r FULL JOIN d ON r.proveedor = d.proveedor AND r.patron = d.patron
"""


@query("learn_rules", LEARN_SQL)
def q_learn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of every second supplier after the accounts of all lines are confirmed."""
    l = table(spark, sf_dir, "lineitem").select(F.monotonically_increasing_id().alias("factura_id"), "l_suppkey", F.col("l_returnflag").alias("patron"), F.col("l_linestatus").alias("cuenta"))  # noqa: E741
    key = F.col("l_suppkey").alias("id")
    rules = table(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 0").select(
        F.col("s_suppkey").alias("proveedor"), F.lit("R").alias("patron"), F.lit("vieja").alias("cuenta"), F.lit(80).alias("confianza"), F.lit(3).cast("long").alias("veces_confirmada"), F.lit("historico").alias("origen")
    )
    details = l.select(F.col("l_suppkey").alias("factura_id"), "patron", "cuenta")
    owners = l.select(key, F.col("l_suppkey").alias("proveedor")).distinct()
    return staging.learned(rules, details, owners)


@query("child_sums", "SELECT l_orderkey AS factura_id, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS DECIMAL(25,2)) AS total FROM lineitem GROUP BY l_orderkey")
def q_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.sums(lines(spark, sf_dir), "factura_id", "subtotal").withColumn("total", F.col("total").cast("decimal(25,2)"))


@query("row_counts", "SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'none', 0 UNION ALL SELECT 'events', count(*) FROM events")
def q_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = {n: table(spark, sf_dir, n) for n in ("orders", "lineitem", "events")}
    return staging.counts(some | {"none": some["orders"].filter("false")})


ITEM_SQL = f"""WITH {HEADER_SQL}
SELECT 'q/' || CAST(id AS VARCHAR) || '.json' AS json_file, 'q/' || CAST(id AS VARCHAR) || '.ready' AS ready_file, coalesce(numero, '') AS numero_comprobante, coalesce(letra, '') AS letra, punto_venta,
       CAST(total AS DECIMAL(18,2)) AS total, importada = 1 AS requiere_revision, CASE WHEN importada = 1 THEN 'FACTURA' ELSE '' END AS clasificacion_documento, importada = 1 AS qr_detectado FROM h
"""


@query("list_items", ITEM_SQL)
def q_items_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers as stored JSON documents, read back as the columns of a list."""
    h = headers(spark, sf_dir)
    done = F.col("importada") == 1
    kind = F.when(done, F.struct(F.lit("FACTURA").alias("tipo_documento")))
    stored = F.to_json(F.struct(
        F.struct(kind.alias("clasificacion_documento")).alias("origen"), F.struct("letra", "punto_venta", "numero").alias("comprobante"), F.struct("total").alias("importes"),
        F.struct(done.alias("requiere_revision")).alias("validaciones"), F.when(done, F.create_map(F.lit("cuit"), F.lit("1"))).alias("qr_afip"),
    ))
    rows = h.select(F.concat(F.lit("q/"), F.col("id").cast("string"), F.lit(".json")).alias("path"), stored.alias("body"))
    found = listing.list_items(rows, "path", "body")
    return found.select("json_file", "ready_file", "numero_comprobante", "letra", "punto_venta", "total", "requiere_revision", "clasificacion_documento", "qr_detectado")
