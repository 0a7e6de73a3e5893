"""Ledger-account inference from history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docfacts.plans.catalogue import query
from docfacts.sources.tables import table


def dominant_account(lines: DataFrame, provider: str, key, amount: str) -> DataFrame:
    """Most used ledger key of each provider, with its share of the provider's lines.

    One shuffle for the grouped counts, one for the ranking of the already
    aggregated rows; ties go to the larger amount, then to the smaller key.
    """
    grouped = lines.groupBy(F.col(provider).alias("provider"), key.alias("account")).agg(
        F.count("*").alias("n_lines"), F.sum(F.col(amount).cast("decimal(18,2)")).alias("total_amount")
    )
    by_provider = Window.partitionBy("provider")
    ranked = grouped.withColumn("n_provider", F.sum("n_lines").over(by_provider)).withColumn(
        "rn", F.row_number().over(by_provider.orderBy(F.desc("n_lines"), F.desc("total_amount"), F.asc("account")))
    )
    return ranked.filter("rn = 1").select(
        "provider", "account", "n_lines", "total_amount", "n_provider", F.round(F.try_divide(100.0 * F.col("n_lines"), F.col("n_provider")), 2).cast("double").alias("score")
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger history: order lines, the account being return flag and line status."""
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus", "l_extendedprice", "l_shipdate")


def account_key():
    return F.concat(F.rtrim(F.col("l_returnflag")), F.lit("-"), F.rtrim(F.col("l_linestatus")))


DOMINANT_SQL = """
WITH g AS (
  SELECT l_suppkey AS provider, rtrim(l_returnflag) || '-' || rtrim(l_linestatus) AS account,
         count(*) AS n_lines, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS total_amount
  FROM lineitem GROUP BY 1, 2),
r AS (
  SELECT *, CAST(sum(n_lines) OVER (PARTITION BY provider) AS BIGINT) AS n_provider,
         row_number() OVER (PARTITION BY provider ORDER BY n_lines DESC, total_amount DESC, account) AS rn
  FROM g)
SELECT provider, account, n_lines, CAST(total_amount AS DECIMAL(28,2)) AS total_amount, n_provider,
       round(100.0::DOUBLE * n_lines / n_provider, 2) AS score
FROM r WHERE rn = 1
"""


@query("dominant_account", DOMINANT_SQL)
def q_dominant_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dominant_account(history(spark, sf_dir), "l_suppkey", account_key(), "l_extendedprice")


SCORED = f"WITH h AS ({DOMINANT_SQL}), "


def bootstrap_rules(lines: DataFrame, suppliers: DataFrame, min_score: float, min_lines: int) -> DataFrame:
    """Rules from each provider's dominant account, if it is dominant enough and has lines enough."""
    best = dominant_account(lines, "l_suppkey", account_key(), "l_extendedprice").filter((F.col("score") >= min_score) & (F.col("n_provider") >= min_lines))
    names = suppliers.select(F.col("s_suppkey").alias("provider"), F.substring(F.trim(F.coalesce("s_name", F.lit(""))), 1, 200).alias("provider_name"))
    note = F.concat(F.lit("Bootstrap: "), F.col("n_lines").cast("string"), F.lit("/"), F.col("n_provider").cast("string"), F.lit(" lines in the dominant account."))
    return best.join(names, "provider", "left").select(
        "provider", "provider_name", F.lit("").alias("pattern"), "account", F.lit(50).alias("priority"), F.col("score").alias("confidence"), F.col("n_lines").alias("used"),
        F.when(F.col("score") >= 95, 0).otherwise(1).alias("needs_review"), note.alias("notes"),
    )


BOOTSTRAP_SQL = SCORED + """
x AS (SELECT * FROM h WHERE score >= 18 AND n_provider >= 3)
SELECT provider, substr(trim(coalesce(s_name, '')), 1, 200) AS provider_name, '' AS pattern, account, 50 AS priority, score AS confidence, n_lines AS used,
       CASE WHEN score >= 95 THEN 0 ELSE 1 END AS needs_review, 'Bootstrap: ' || n_lines || '/' || n_provider || ' lines in the dominant account.' AS notes
FROM x LEFT JOIN supplier ON s_suppkey = provider
"""


@query("dominant_account_bootstrap", BOOTSTRAP_SQL)
def q_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bootstrap_rules(history(spark, sf_dir), table(spark, sf_dir, "supplier"), 18, 3)


def score_band(score):
    """Confidence band and its place in the report."""
    return F.when(score >= 95, "95-100").when(score >= 85, "85-94").when(score >= 70, "70-84").when(score >= 50, "50-69").otherwise("0-49")


HISTOGRAM_SQL = SCORED + """
b AS (SELECT CASE WHEN score >= 95 THEN '95-100' WHEN score >= 85 THEN '85-94' WHEN score >= 70 THEN '70-84' WHEN score >= 50 THEN '50-69' ELSE '0-49' END AS band FROM h)
SELECT band, count(*) AS n FROM b GROUP BY band
"""


@query("confidence_histogram", HISTOGRAM_SQL)
def q_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = dominant_account(history(spark, sf_dir), "l_suppkey", account_key(), "l_extendedprice")
    return best.groupBy(score_band(F.col("score")).alias("band")).agg(F.count("*").alias("n")).orderBy(F.desc("band"))


@query("rule_candidates_count", SCORED + "z AS (SELECT 1) SELECT count(*) AS candidates FROM h WHERE score >= 18 AND n_provider >= 3")
def q_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = dominant_account(history(spark, sf_dir), "l_suppkey", account_key(), "l_extendedprice")
    return best.agg(F.count_if((F.col("score") >= 18) & (F.col("n_provider") >= 3)).alias("candidates"))


def match_rules(docs: DataFrame, rules: DataFrame, doc_id: str) -> DataFrame:
    """Each document's best rule: same provider, amount in range (0 to 0 is any), text holds the pattern ('' is any).

    An equi-join by provider with the rest as a residual condition; the best by
    priority, confidence, confirmations and id. Documents of one provider share its
    few rules, and AQE splits a provider with too many documents.
    """
    r = rules.select([F.col(c).alias(f"r_{c}") for c in rules.columns])
    fits = (F.col("amount").between(F.col("r_low"), F.col("r_high"))) | ((F.col("r_low") == 0) & (F.col("r_high") == 0))
    says = F.contains(F.col("text"), F.col("r_pattern")) | (F.col("r_pattern") == "")
    met = docs.join(r, (docs["provider"] == F.col("r_provider")) & (F.col("r_active") == 1) & fits & says)
    # max of (-priority, confidence, confirmed, -id): an aggregate with map-side combine, not a sorted window
    best = met.groupBy(doc_id).agg(F.max(F.struct((-F.col("r_priority")).alias("p"), F.col("r_confidence").alias("c"), F.col("r_confirmed").alias("n"), (-F.col("r_id")).alias("i"), F.col("r_account").alias("account"))).alias("b"))
    return best.select(doc_id, F.col("b.account").alias("account"), (-F.col("b.i")).alias("rule_id"), F.col("b.c").alias("confidence"))


def rules_from_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule per part, for the supplier with the part's number modulo the number of suppliers."""
    p = table(spark, sf_dir, "part")
    n = table(spark, sf_dir, "supplier").count()
    return p.select(
        F.col("p_partkey").alias("id"), (F.col("p_partkey") % n + 1).alias("provider"), F.upper(F.substring("p_type", 1, 4)).alias("pattern"),
        F.when(F.col("p_partkey") % 3 == 0, 0.0).otherwise(F.col("p_retailprice")).alias("low"), F.when(F.col("p_partkey") % 3 == 0, 0.0).otherwise(F.col("p_retailprice") * 40).alias("high"),
        (F.col("p_size") % 5).alias("priority"), (F.col("p_size") % 7 + 90).alias("confidence"), (F.col("p_size") % 2).alias("confirmed"), F.col("p_brand").alias("account"), F.when(F.col("p_partkey") % 10 == 9, 0).otherwise(1).alias("active"),
    )


RULES_SQL = """
r AS (SELECT p_partkey AS id, p_partkey % (SELECT count(*) FROM supplier) + 1 AS provider, upper(substr(p_type, 1, 4)) AS pattern,
             CASE WHEN p_partkey % 3 = 0 THEN 0.0::DOUBLE ELSE p_retailprice END AS low, CASE WHEN p_partkey % 3 = 0 THEN 0.0::DOUBLE ELSE p_retailprice * 40 END AS high,
             p_size % 5 AS priority, p_size % 7 + 90 AS confidence, p_size % 2 AS confirmed, p_brand AS account, CASE WHEN p_partkey % 10 = 9 THEN 0 ELSE 1 END AS active FROM part),
d AS (SELECT l_orderkey * 10 + l_linenumber AS doc, l_suppkey AS provider, l_extendedprice AS amount, upper(p_type) AS text
      FROM lineitem JOIN part ON p_partkey = l_partkey)"""

MATCH_SQL = f"""WITH {RULES_SQL},
m AS (SELECT d.doc, r.*, row_number() OVER (PARTITION BY d.doc ORDER BY r.priority, r.confidence DESC, r.confirmed DESC, r.id) AS rn
      FROM d JOIN r ON d.provider = r.provider AND r.active = 1 AND (d.amount BETWEEN r.low AND r.high OR (r.low = 0 AND r.high = 0)) AND (contains(d.text, r.pattern) OR r.pattern = ''))
SELECT doc, account, id AS rule_id, confidence FROM m WHERE rn = 1
"""


def ledger_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per order line: its provider, amount and text."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_partkey")  # noqa: E741
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return l.join(p, l["l_partkey"] == p["p_partkey"]).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("doc"), F.col("l_suppkey").alias("provider"), F.col("l_extendedprice").alias("amount"), F.upper("p_type").alias("text"))


@query("rule_match_top1", MATCH_SQL)
def q_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_rules(ledger_documents(spark, sf_dir), rules_from_parts(spark, sf_dir), "doc")


SUGGEST_SQL = f"""WITH {RULES_SQL},
m AS (SELECT d.doc, r.account, r.confidence, row_number() OVER (PARTITION BY d.doc ORDER BY r.priority, r.confidence DESC, r.confirmed DESC, r.id) AS rn
      FROM d JOIN r ON d.provider = r.provider AND r.active = 1 AND (d.amount BETWEEN r.low AND r.high OR (r.low = 0 AND r.high = 0)) AND (contains(d.text, r.pattern) OR r.pattern = '')),
h AS ({DOMINANT_SQL})
SELECT d.doc, coalesce(m.account, h.account) AS account, CASE WHEN m.account IS NOT NULL THEN 'regla' WHEN h.account IS NOT NULL THEN 'historico' ELSE 'sin_sugerencia' END AS origin,
       coalesce(CAST(m.confidence AS DOUBLE), h.score, 0.0) AS score, CASE WHEN m.account IS NOT NULL THEN false ELSE coalesce(h.score, 0.0) < 85 END AS confirm
FROM d LEFT JOIN m ON m.doc = d.doc AND m.rn = 1 LEFT JOIN h ON h.provider = d.provider
"""


@query("account_suggestion", SUGGEST_SQL)
def q_suggestion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule first, then history, then nothing."""
    docs = ledger_documents(spark, sf_dir)
    best = match_rules(docs, rules_from_parts(spark, sf_dir), "doc").select("doc", F.col("account").alias("r_account"), F.col("confidence").cast("double").alias("r_score"))
    past = dominant_account(history(spark, sf_dir), "l_suppkey", account_key(), "l_extendedprice").select("provider", F.col("account").alias("h_account"), F.col("score").alias("h_score"))
    rows = docs.select("doc", "provider").join(best, "doc", "left").join(past, "provider", "left")
    by_rule = F.col("r_account").isNotNull()
    return rows.select(
        "doc", F.coalesce("r_account", "h_account").alias("account"), F.when(by_rule, "regla").when(F.col("h_account").isNotNull(), "historico").otherwise("sin_sugerencia").alias("origin"),
        F.coalesce("r_score", "h_score", F.lit(0.0)).alias("score"), F.when(by_rule, False).otherwise(F.coalesce("h_score", F.lit(0.0)) < 85).alias("confirm"),
    )


UPSERT_SQL = """
WITH g AS (SELECT l_suppkey AS provider, rtrim(l_returnflag) || '-' || rtrim(l_linestatus) AS account, CAST(l_shipdate AS DATE) >= DATE '1995-06-17' AS late, count(*) AS n
           FROM lineitem GROUP BY 1, 2, 3),
o AS (SELECT provider, account, n AS used, 80 AS confidence, 7 AS priority, 'old' AS notes FROM g WHERE NOT late),
n AS (SELECT provider, account, n AS used, 90 AS confidence, 50 AS priority, 'new' AS notes FROM g WHERE late)
SELECT coalesce(o.provider, n.provider) AS provider, coalesce(o.account, n.account) AS account, greatest(o.used, n.used) AS used, greatest(o.confidence, n.confidence) AS confidence,
       coalesce(o.priority, n.priority) AS priority, coalesce(n.notes, o.notes) AS notes
FROM o FULL JOIN n ON o.provider = n.provider AND o.account = n.account
"""


@query("rule_upsert_greatest", UPSERT_SQL)
def q_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docfacts.operators.staging import upsert

    late = F.to_date("l_shipdate") >= F.lit("1995-06-17").cast("date")
    g = history(spark, sf_dir).groupBy(F.col("l_suppkey").alias("provider"), account_key().alias("account"), late.alias("late")).agg(F.count("*").alias("used"))

    def rules(rows, confidence, priority, notes):
        return rows.select("provider", "account", "used", F.lit(confidence).alias("confidence"), F.lit(priority).alias("priority"), F.lit(notes).alias("notes"))

    return upsert(rules(g.filter("not late"), 80, 7, "old"), rules(g.filter("late"), 90, 50, "new"), ["provider", "account"], keep=("priority",), greatest=("used", "confidence"))


LOOKUP_SQL = """
WITH c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN lpad(CAST(c_custkey % (SELECT count(*) FROM supplier) + 1 AS VARCHAR), 4, '0') ELSE '' END AS code,
                  CASE WHEN c_custkey % 3 = 1 THEN 'lier#' || substr(lpad(CAST(c_custkey % (SELECT count(*) FROM supplier) + 1 AS VARCHAR), 9, '0'), 1, 8) WHEN c_custkey % 6 = 2 THEN 'CION 1' WHEN c_custkey % 6 = 5 THEN 'nobody' ELSE '' END AS name FROM customer),
s AS (SELECT s_suppkey, lpad(CAST(s_suppkey AS VARCHAR), 4, '0') AS code, s_name AS name, 'Nacion ' || CAST(s_nationkey AS VARCHAR) AS other FROM supplier),
a AS (SELECT c.id, min(s.s_suppkey) AS k FROM c JOIN s ON s.code = c.code GROUP BY c.id),
b AS (SELECT c.id, min(s.s_suppkey) AS k FROM c JOIN s ON c.name <> '' AND (contains(upper(s.name), upper(c.name)) OR contains(upper(s.other), upper(c.name))) GROUP BY c.id)
SELECT c.id, coalesce(a.k, b.k) AS provider, CASE WHEN a.k IS NOT NULL THEN 'id' WHEN b.k IS NOT NULL THEN 'name' ELSE 'none' END AS how FROM c LEFT JOIN a USING (id) LEFT JOIN b USING (id)
"""


@query("provider_lookup_two_tier", LOOKUP_SQL)
def q_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By id, then by a part of either name; of several the smallest."""
    from docfacts.operators.lookup import two_tier

    s = table(spark, sf_dir, "supplier")
    n = s.count()
    other = F.col("c_custkey") % n + 1
    part = F.concat(F.lit("lier#"), F.substring(F.lpad(other.cast("string"), 9, "0"), 1, 8))  # those of ten suppliers share it
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.lpad(other.cast("string"), 4, "0")).otherwise("").alias("code"),
        F.when(F.col("c_custkey") % 3 == 1, part).when(F.col("c_custkey") % 6 == 2, "CION 1").when(F.col("c_custkey") % 6 == 5, "nobody").otherwise("").alias("name"),
    )
    parties = s.select(F.col("s_suppkey").alias("party"), F.lpad(F.col("s_suppkey").cast("string"), 4, "0").alias("code"), "s_name", F.concat(F.lit("Nacion "), F.col("s_nationkey").cast("string")).alias("other"))
    return two_tier(c, parties, ["s_name", "other"]).select("id", F.col("party").alias("provider"), "how")
