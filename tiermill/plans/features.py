"""Feature plans: point-in-time features, scores, narratives, vectors, search."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiermill.functions.exact import money
from tiermill.operators import features, neighbours, products as published, search, vectors
from tiermill.plans import oracle as q
from tiermill.plans.gold import dim_customers, identities
from tiermill.plans.registry import plan
from tiermill.plans.silver import lines, orders
from tiermill.session import shared_dir, stored_once
from tiermill.sources.bridge import AS_OF, AS_OF_LIST, Bronze

EARLIER = date(1999, 7, 1)


def features_sql(as_of: str, where: str = "TRUE") -> str:
    age = f"date_diff('day', order_date, {as_of})"
    rev = lambda cond: f"sum(CASE WHEN {cond} THEN net_amount_usd ELSE 0 END)"
    return f"""SELECT *, CASE WHEN order_count_l90 > 0 THEN CAST(rev_l90d_usd AS DOUBLE) / order_count_l90 ELSE CAST(0 AS DOUBLE) END AS avg_order_value_l90,
      order_count_l365 / CAST(12 AS DOUBLE) AS order_frequency_l365,
      greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), days_since_last_order / CAST(365 AS DOUBLE) * CAST(0.7 AS DOUBLE)
        + CASE WHEN rev_l90d_usd = 0 THEN CAST(0.3 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)) AS churn_risk_score,
      CASE WHEN rev_l30d_usd * 3 > rev_l90d_usd THEN CAST(0.75 AS DOUBLE) ELSE CAST(0.25 AS DOUBLE) END AS upsell_propensity
      FROM (SELECT customer_hk, {as_of} AS as_of_date, 1 AS feature_version, {rev(age + ' <= 7')} AS rev_l7d_usd, {rev(age + ' <= 30')} AS rev_l30d_usd,
        {rev(age + ' <= 90')} AS rev_l90d_usd, {rev(age + ' <= 365')} AS rev_l365d_usd, {rev(age + ' BETWEEN 366 AND 730')} AS rev_prev_year_usd,
        count(*) FILTER (WHERE {age} <= 30) AS order_count_l30, count(*) FILTER (WHERE {age} <= 90) AS order_count_l90,
        count(*) FILTER (WHERE {age} <= 365) AS order_count_l365, max(net_amount_usd) AS max_order_value, min(net_amount_usd) AS min_order_value,
        CAST(date_diff('day', max(order_date), {as_of}) AS INT) AS days_since_last_order, count(*) AS total_orders
        FROM silver_orders WHERE NOT is_quarantined AND order_date < {as_of} AND {where} GROUP BY customer_hk)"""


q.RELATIONS["pit_rows"] = features_sql(q.AS_OF)
REVENUES = ["rev_l7d_usd", "rev_l30d_usd", "rev_l90d_usd", "rev_l365d_usd", "rev_prev_year_usd", "max_order_value", "min_order_value"]


def money_sql(sql: str) -> str:
    return f"SELECT * REPLACE ({', '.join(f'{q.money(c)} AS {c}' for c in REVENUES)}) FROM ({sql})"


def report(df: DataFrame) -> DataFrame:
    return df.withColumns({c: money(F.col(c)) for c in REVENUES if c in df.columns})


def features_at(b: Bronze, as_of: date) -> DataFrame:
    return features.revenue_features(orders(b, before=as_of), as_of)


@plan("pit_features", money_sql("SELECT * FROM pit_rows"))
def pit_features(b: Bronze) -> DataFrame:
    return report(features_at(b, AS_OF))


@plan("pit_features_multi", money_sql(" UNION ALL ".join(features_sql(f"DATE '{d}'") for d in AS_OF_LIST)))
def pit_features_multi(b: Bronze) -> DataFrame:
    return report(features.revenue_features_for(orders(b, before=max(AS_OF_LIST)), AS_OF_LIST))


YEAR = [AS_OF - timedelta(days=n) for n in range(365)]


@plan(
    "risk_by_day",
    f"""SELECT as_of_date, count(*) AS customers, {q.money('sum(rev_l90d_usd)')} AS rev_l90d_usd, {q.money('sum(rev_prev_year_usd)')} AS rev_prev_year_usd,
      CAST(sum(orders) AS BIGINT) AS orders_l365, count(*) FILTER (WHERE greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE),
        quiet / CAST(365 AS DOUBLE) * CAST(0.7 AS DOUBLE) + CASE WHEN rev_l90d_usd = 0 THEN CAST(0.3 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)) > 0.7) AS high_risk
    FROM (SELECT as_of_date, customer_hk, sum(CASE WHEN age <= 90 THEN net_amount_usd ELSE 0 END) AS rev_l90d_usd, min(age) AS quiet,
        sum(CASE WHEN age BETWEEN 366 AND 730 THEN net_amount_usd ELSE 0 END) AS rev_prev_year_usd, count(*) FILTER (WHERE age <= 365) AS orders
      FROM (SELECT o.*, as_of_date, date_diff('day', order_date, as_of_date) AS age FROM silver_orders o
        JOIN (SELECT CAST({q.AS_OF} - CAST(n AS INT) AS DATE) AS as_of_date FROM range(365) r(n)) ON order_date < as_of_date
        WHERE NOT is_quarantined) GROUP BY ALL)
    GROUP BY as_of_date""",
)
def risk_by_day(b: Bronze) -> DataFrame:
    """A year of days: customers known, their revenue windows and how many are at high risk, from one pass over the orders."""
    rows = features.revenue_features_for(orders(b, before=AS_OF), YEAR)
    return rows.groupBy("as_of_date").agg(
        F.count("*").alias("customers"),
        money(F.sum("rev_l90d_usd")).alias("rev_l90d_usd"),
        money(F.sum("rev_prev_year_usd")).alias("rev_prev_year_usd"),
        F.sum("order_count_l365").alias("orders_l365"),
        F.count_if(F.col("churn_risk_score") > features.HIGH_ABOVE).alias("high_risk"),
    )


@plan("churn_upsell", "SELECT customer_hk, as_of_date, churn_risk_score, upsell_propensity FROM pit_rows")
def churn_upsell(b: Bronze) -> DataFrame:
    return features_at(b, AS_OF).select("customer_hk", "as_of_date", "churn_risk_score", "upsell_propensity")


@plan(
    "product_features",
    f"""SELECT customer_hk, as_of_date, feature_version, {', '.join(q.money(c) + ' AS ' + c for c in REVENUES[1:4])}, order_count_l90,
      avg_order_value_l90, days_since_last_order, order_frequency_l365, churn_risk_score, upsell_propensity FROM pit_rows""",
)
def product_features(b: Bronze) -> DataFrame:
    return report(published.features(features_at(b, AS_OF)))


# -- product mix and affinity ------------------------------------------------------

q.RELATIONS["family_rows"] = f"""
SELECT customer_hk, product_family, sum(line_amount_usd) AS revenue, count(*) AS purchase_count_l365, max(order_date) AS last_purchase_date
FROM silver_lines WHERE NOT is_quarantined AND order_date < {q.AS_OF} AND date_diff('day', order_date, {q.AS_OF}) <= 365
GROUP BY customer_hk, product_family"""
q.RELATIONS["family_chance"] = """
SELECT a.product_family AS family, g.product_family AS other, count(*) / CAST(any_value(n.owners) AS DOUBLE) AS likelihood
FROM family_rows a JOIN family_rows g USING (customer_hk)
JOIN (SELECT product_family, count(*) AS owners FROM family_rows GROUP BY 1) n ON n.product_family = g.product_family GROUP BY 1, 2"""


@plan(
    "product_hhi",
    """SELECT customer_hk, round(sum(CAST(revenue AS DOUBLE) * CAST(revenue AS DOUBLE)) / pow(CAST(sum(revenue) AS DOUBLE), 2), 6) AS product_mix_hhi,
      count(*) AS families FROM family_rows GROUP BY customer_hk""",
)
def product_hhi(b: Bronze) -> DataFrame:
    return features.product_mix(lines_before(b), AS_OF).withColumn("product_mix_hhi", F.round("product_mix_hhi", 6))


q.RELATIONS["mix_rows"] = """
SELECT customer_hk, round(sum(CAST(revenue AS DOUBLE) * CAST(revenue AS DOUBLE)) / pow(CAST(sum(revenue) AS DOUBLE), 2), 6) AS product_mix_hhi
FROM family_rows GROUP BY customer_hk"""


@plan("customer_feature_rows", money_sql("SELECT p.*, m.product_mix_hhi FROM pit_rows p LEFT JOIN mix_rows m USING (customer_hk)"))
def customer_feature_rows(b: Bronze) -> DataFrame:
    """The full feature row: revenue windows, scores and product concentration."""
    mix = features.product_mix(lines_before(b), AS_OF)
    rows = features.with_product_mix(features_at(b, AS_OF), mix)
    return report(rows).withColumn("product_mix_hhi", F.round("product_mix_hhi", 6))


def lines_before(b: Bronze) -> DataFrame:
    """Order lines of orders before the as-of date; the bound reaches the header scan."""
    from tiermill.operators import silver as conform

    return conform.order_lines(b.order_items(), orders(b, before=AS_OF))


@plan(
    "product_affinity",
    f"""SELECT f.customer_hk, f.product_family, f.purchase_count_l365, f.last_purchase_date,
      CAST(date_diff('day', f.last_purchase_date, {q.AS_OF}) AS INT) AS days_since_purchase,
      CAST(f.revenue AS DOUBLE) * 100 / CAST(t.total AS DOUBLE) AS revenue_share_pct,
      coalesce(max(c.likelihood), 0) AS cross_sell_score, {q.AS_OF} AS as_of_date
      FROM family_rows f JOIN (SELECT customer_hk, sum(revenue) AS total FROM family_rows GROUP BY 1) t USING (customer_hk)
      LEFT JOIN family_rows g ON g.customer_hk = f.customer_hk AND g.product_family <> f.product_family
      LEFT JOIN family_chance c ON c.family = f.product_family AND c.other = g.product_family
      GROUP BY f.customer_hk, f.product_family, f.purchase_count_l365, f.last_purchase_date, f.revenue, t.total""",
)
def product_affinity(b: Bronze) -> DataFrame:
    return features.product_affinity(lines_before(b), AS_OF)


# -- predictions ----------------------------------------------------------------------

BAND_SQL = "CASE WHEN churn_risk_score > 0.7 THEN 'HIGH' WHEN churn_risk_score > 0.4 THEN 'MEDIUM' ELSE 'LOW' END"
PREDICTION_SQL = f"""SELECT 'CHURN_RISK' AS model_name, 'v1.0' AS model_version, 'CUSTOMER' AS entity_type, customer_hk AS entity_hk, as_of_date,
  'CHURN_' || {BAND_SQL} AS prediction_label, churn_risk_score AS prediction_score, {BAND_SQL} AS prediction_band,
  CAST(0.05 AS DOUBLE) AS confidence_interval FROM pit_rows"""


def scored_earlier(b: Bronze) -> DataFrame:
    """Predictions an earlier run of the same day wrote for one source."""
    early = orders(b, before=AS_OF).where(F.col("source_system") == "SAP")
    return features.churn_predictions(features.revenue_features(early, AS_OF))


@plan(
    "predictions_idempotent",
    PREDICTION_SQL
    + " WHERE customer_hk NOT IN (SELECT customer_hk FROM silver_orders WHERE source_system = 'SAP' AND NOT is_quarantined "
    + f"AND order_date < {q.AS_OF})",
)
def predictions_idempotent(b: Bronze) -> DataFrame:
    return features.churn_predictions(features_at(b, AS_OF), scored_earlier(b))


@plan("product_predictions", PREDICTION_SQL)
def product_predictions(b: Bronze) -> DataFrame:
    return published.predictions(features.churn_predictions(features_at(b, AS_OF)))


# -- narratives ---------------------------------------------------------------------------


def narrative_sql(source: str) -> str:
    dollars = "format('{:,}', CAST(round(coalesce(rev, 0), 0) AS BIGINT))"
    return f"""SELECT master_customer_hk AS customer_hk, customer_name,
      'Customer: ' || coalesce(customer_name, 'Unknown') || '. Industry: ' || coalesce(industry, 'Unknown') || '. Region: ' || coalesce(region, 'Unknown')
      || '. Segment: ' || coalesce(segment, 'Unknown') || '. Revenue 12mo: $'
      || CASE WHEN length({dollars}) < 11 THEN lpad({dollars}, 11, ' ') ELSE {dollars} END
      || '. Orders 90d: ' || CAST(coalesce(n, 0) AS VARCHAR) || '. Churn risk: '
      || CASE WHEN coalesce(churn, 0) > 0.7 THEN 'HIGH' WHEN coalesce(churn, 0) > 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS customer_summary,
      CASE WHEN coalesce(rev, 0) > 1000000 THEN 'ENTERPRISE' WHEN coalesce(rev, 0) > 100000 THEN 'MID_MARKET' ELSE 'SMB' END AS revenue_band,
      concat_ws('|', coalesce(industry, '?'), coalesce(segment, '?')) AS tags, country_code AS top_countries
      FROM dim_customers LEFT JOIN (SELECT master_customer_hk, sum(rev_l365d_usd) AS rev, CAST(sum(order_count_l90) AS BIGINT) AS n, min(churn_risk_score) AS churn
        FROM {source} JOIN identities USING (customer_hk) GROUP BY 1) USING (master_customer_hk)"""


q.RELATIONS["pit_rows_earlier"] = features_sql(f"DATE '{EARLIER}'")
q.RELATIONS["told_now"] = narrative_sql("pit_rows")
q.RELATIONS["told_earlier"] = narrative_sql("pit_rows_earlier")


def narratives_at(b: Bronze, as_of: date) -> DataFrame:
    identified = identities(b)
    return features.narratives(dim_customers(b), features.features_by_master(features_at(b, as_of), identified))


def flat(df: DataFrame) -> DataFrame:
    text = lambda c: F.array_join(c, "|", "?")
    return df.withColumns({"tags": text("tags"), "top_countries": text("top_countries")})


@plan("customer_summary", "SELECT * FROM told_now")
def customer_summary(b: Bronze) -> DataFrame:
    return flat(narratives_at(b, AS_OF))


STORED_SQL = (
    "SELECT t.*, e.embedding FROM told_earlier t JOIN identities i ON i.master_customer_hk = t.customer_hk "
    "AND i.source_system = 'SALESFORCE' AND t.revenue_band <> 'SMB' LEFT JOIN embeddings e ON i.original_id = 'ACC-' || CAST(e.vec_id AS VARCHAR)"
)


def stored_customers(b: Bronze) -> DataFrame:
    """Larger customers as they were told earlier, with the vectors made then."""
    account = identities(b).where(F.col("source_system") == "SALESFORCE").select(
        F.col("master_customer_hk").alias("customer_hk"), "original_id"
    )
    known = b.embeddings().select(F.concat(F.lit("ACC-"), F.col("vec_id").cast("string")).alias("original_id"), F.col("embedding").alias("summary_vector"))
    return (
        narratives_at(b, EARLIER).where(F.col("revenue_band") != "SMB")
        .join(account, "customer_hk").join(known, "original_id", "left").drop("original_id")
        .withColumn("vector_state", F.when(F.col("summary_vector").isNotNull(), "STORED"))
    )


@plan(
    "upsert_vectors",
    f"""SELECT n.customer_hk, n.customer_name, n.customer_summary, n.revenue_band, s.embedding IS NOT NULL AS has_vector,
      CASE WHEN s.embedding IS NULL THEN 'PENDING' ELSE 'STORED' END AS vector_state
      FROM told_now n LEFT JOIN ({STORED_SQL}) s USING (customer_hk)""",
)
def upsert_vectors(b: Bronze) -> DataFrame:
    """Narratives merged into a stored table of larger customers and their vectors; each comes twice, the older one outdated."""
    stored = stored_customers(b)
    told = narratives_at(b, AS_OF).withColumn("told_at", F.lit(2))
    outdated = told.withColumns({"customer_summary": F.lit("outdated"), "told_at": F.lit(1)})
    stored = stored.withColumn("told_at", F.lit(0))
    merged = vectors.upsert(stored, told.unionByName(outdated), "customer_hk", ["summary_vector", "vector_state"], newest="told_at")
    filled = vectors.fill_missing(merged, "vector_state", F.lit("PENDING"), "customer_summary")
    return filled.select(
        "customer_hk", "customer_name", "customer_summary", "revenue_band",
        F.col("summary_vector").isNotNull().alias("has_vector"), "vector_state",
    )


# -- vectors and search ------------------------------------------------------------------------


@plan(
    "vector_topk",
    """SELECT vec_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT arg_min(embedding, vec_id) FROM embeddings) AS DOUBLE[])), 4) AS similarity
      FROM embeddings ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT arg_min(embedding, vec_id) FROM embeddings) AS DOUBLE[])) DESC, vec_id LIMIT 10""",
)
def vector_topk(b: Bronze) -> DataFrame:
    stored = b.embeddings()
    query = stored.agg(F.min_by("embedding", "vec_id").alias("v")).first()["v"]  # one vector
    best = vectors.top_k(stored, query, 10)
    return best.select("vec_id", "label", F.round("similarity", 4).alias("similarity"))


NEAREST_SQL = """SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY s DESC, id) AS INT) AS rank, id, round(s, 6) AS similarity
  FROM (SELECT q.vec_id AS query, e.vec_id AS id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9) AS s
    FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0) QUALIFY rank <= 10"""


def vector_cells(b: Bronze) -> neighbours.Cells:
    size = b.embeddings().agg(F.max(F.size("embedding"))).first()[0]
    return neighbours.build(b.embeddings(), shared_dir(b.spark, "vector-cells"), size, cells=32)


@plan("vector_topk_many", NEAREST_SQL)
def vector_topk_many(b: Bronze) -> DataFrame:
    """The ten nearest vectors of every hundredth one among all, exactly, through cells."""
    found = neighbours.top_k_many(vector_cells(b), b.embeddings().where("vec_id % 100 = 0"), 10)
    return found.withColumn("similarity", F.round("similarity", 6))


SPOILED_SQL = """CASE vec_id % 50 WHEN 0 THEN NULL WHEN 1 THEN embedding[1:3] WHEN 2 THEN list_transform(embedding, lambda x: CAST(0 AS FLOAT))
  WHEN 3 THEN list_append(embedding[2:], NULL) WHEN 4 THEN list_append(embedding[2:], 'nan'::FLOAT) ELSE embedding END"""


def spoiled(b: Bronze) -> DataFrame:
    """Stored vectors of which some are missing, cut, zero, or hold a NULL or NaN."""
    v, kind = F.col("embedding"), F.col("vec_id") % 50
    rest = F.slice(v, 2, 1000)
    return b.embeddings().withColumn(
        "embedding",
        F.when(kind == 1, F.slice(v, 1, 3))
        .when(kind == 2, F.transform(v, lambda x: F.lit(0.0).cast("float")))
        .when(kind == 3, F.concat(rest, F.array(F.lit(None).cast("float"))))
        .when(kind == 4, F.concat(rest, F.array(F.lit(float("nan")).cast("float"))))
        .when(kind != 0, v),
    )


@plan(
    "vector_unusable",
    """SELECT vec_id, ['MISSING', 'WRONG_SIZE', 'ZERO_LENGTH', 'MISSING_NUMBER', 'NOT_FINITE'][vec_id % 50 + 1] AS reason
      FROM embeddings WHERE vec_id % 50 < 5""",
)
def vector_unusable(b: Bronze) -> DataFrame:
    """Stored vectors that no search can score, with the reason."""
    size = b.embeddings().agg(F.max(F.size("embedding"))).first()[0]
    return vectors.unusable(spoiled(b), size).select("vec_id", "reason")


@plan(
    "vector_topk_spoiled",
    f"""SELECT vec_id, label, round(s, 4) AS similarity FROM (SELECT vec_id, label, list_cosine_similarity(CAST(v AS DOUBLE[]),
        CAST((SELECT arg_max(embedding, vec_id) FROM embeddings WHERE vec_id % 50 = 9) AS DOUBLE[])) AS s
      FROM (SELECT vec_id, label, {SPOILED_SQL} AS v FROM embeddings) WHERE vec_id % 50 > 4) ORDER BY s DESC, vec_id LIMIT 10""",
)
def vector_topk_spoiled(b: Bronze) -> DataFrame:
    """Search among vectors of which some cannot be scored."""
    query = b.embeddings().where("vec_id % 50 = 9").agg(F.max_by("embedding", "vec_id").alias("v")).first()["v"]
    return vectors.top_k(spoiled(b), query, 10).select("vec_id", "label", F.round("similarity", 4).alias("similarity"))


@plan(
    "vector_stale",
    f"""SELECT s.customer_hk, s.embedding IS NOT NULL AND n.customer_summary IS DISTINCT FROM s.customer_summary AS is_stale
      FROM ({STORED_SQL}) s JOIN told_now n USING (customer_hk)""",
)
def vector_stale(b: Bronze) -> DataFrame:
    """Stored customers with their text of today: whose vector was made from another text."""
    made = stored_customers(b).withColumn("made_from", F.sha2("customer_summary", 256)).select("customer_hk", "summary_vector", "made_from")
    today = narratives_at(b, AS_OF).select("customer_hk", "customer_summary").join(made, "customer_hk")
    return vectors.stale(today, "customer_summary", "summary_vector", "made_from").select("customer_hk", "is_stale")


def text_index(b: Bronze) -> DataFrame:
    name = F.concat(F.lit("Document "), F.col("doc_id").cast("string"))
    return search.index(
        b.documents(), "DOCUMENT", F.col("doc_id"), name, [name, F.col("text"), F.col("lang")], ["source", "lang", "n_chars"]
    )


@plan(
    "search_index",
    """SELECT 'DOCUMENT' AS entity_type, sha256(CAST(doc_id AS VARCHAR)) AS entity_hk, 'Document ' || CAST(doc_id AS VARCHAR) AS entity_name,
      sha256(concat_ws(' ', 'Document ' || CAST(doc_id AS VARCHAR), text, lang)) AS body_digest, source, lang, n_chars FROM documents""",
)
def search_index(b: Bronze) -> DataFrame:
    field = lambda name: F.get_json_object("metadata", f"$.{name}")
    return text_index(b).select(
        "entity_type", "entity_hk", "entity_name", F.sha2("search_body", 256).alias("body_digest"),
        field("source").alias("source"), field("lang").alias("lang"), field("n_chars").cast("bigint").alias("n_chars"),
    )


def judged_texts(b: Bronze) -> DataFrame:
    """Texts with a trust value from their label; toxic ones are not active."""
    marks = b.table("labels").select("doc_id", "quality", "toxic")
    return b.documents().join(marks, "doc_id", "left").where(F.coalesce("toxic", F.lit(0)) == 0).withColumn(
        "trust", F.coalesce("quality", F.lit(0))
    )


QUERY = "THE"
q.RELATIONS["found_texts"] = f"""
SELECT d.*, coalesce(l.quality, 0) AS trust FROM documents d LEFT JOIN labels l USING (doc_id)
WHERE coalesce(l.toxic, 0) = 0 AND (contains(lower(text), lower('{QUERY}')) OR contains(lower(source), lower('{QUERY}')))"""


@plan("keyword_search", "SELECT doc_id, source, lang, n_chars, trust FROM found_texts ORDER BY trust DESC, doc_id")
def keyword_search(b: Bronze) -> DataFrame:
    found = search.keyword(judged_texts(b), QUERY, ["text", "source"])
    return found.select("doc_id", "source", "lang", "n_chars", "trust").orderBy(F.desc("trust"), "doc_id")


@plan(
    "search_facets",
    """SELECT 'source' AS facet, source AS value, count(*) AS n FROM found_texts WHERE lang = 'en' GROUP BY source
      UNION ALL SELECT 'lang', lang, count(*) FROM found_texts WHERE lang = 'en' GROUP BY lang
      UNION ALL SELECT 'trust', CAST(trust AS VARCHAR), count(*) FROM found_texts WHERE lang = 'en' GROUP BY trust""",
)
def search_facets(b: Bronze) -> DataFrame:
    found = search.keyword(judged_texts(b), QUERY, ["text", "source"])
    chosen = search.facet_filter(found, {"source": search.ALL, "lang": "en"})
    return search.facet_counts(chosen, ["source", "lang", "trust"])


def text_root(b: Bronze) -> str:
    """Searchable texts, appended in two batches at the first use."""

    def build(path: str) -> None:
        texts = judged_texts(b)
        for batch in (0, 1):
            search.append_texts(texts.where(F.col("doc_id") % 2 == batch), path, ["text", "source"], batch)

    return stored_once(b.spark, f"texts:{b.folder}", build)


@plan("keyword_indexed", "SELECT doc_id, source, lang, n_chars, trust FROM found_texts ORDER BY trust DESC, doc_id")
def keyword_indexed(b: Bronze) -> DataFrame:
    """The keyword search by way of the trigram index."""
    found = search.indexed_keyword(b.spark, text_root(b), QUERY, ["text", "source"])
    return found.select("doc_id", "source", "lang", "n_chars", "trust").orderBy(F.desc("trust"), "doc_id")


@plan(
    "facets_indexed",
    """SELECT 'source' AS facet, source AS value, count(*) AS n FROM found_texts WHERE lang = 'en' GROUP BY source
      UNION ALL SELECT 'lang', lang, count(*) FROM found_texts WHERE lang = 'en' GROUP BY lang""",
)
def facets_indexed(b: Bronze) -> DataFrame:
    found = search.indexed_keyword(b.spark, text_root(b), QUERY, ["text", "source"])
    return search.facet_counts(search.facet_filter(found, {"source": search.ALL, "lang": "en"}), ["source", "lang"])


RARE = ["nation", "license", "src1", "the e", "zzzz"]
q.RELATIONS["open_texts"] = "SELECT d.* FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.toxic, 0) = 0"


def _has_sql(text: str) -> str:
    return f"(coalesce(contains(lower(text), '{text}'), FALSE) OR coalesce(contains(lower(source), '{text}'), FALSE))"


@plan(
    "keyword_lookups",
    " UNION ALL ".join(
        f"SELECT '{w}' AS query, count(*) AS texts, count(*) FILTER (WHERE {' AND '.join(_has_sql(w[i : i + 3]) for i in range(len(w) - 2))}) AS verified, "
        f"count(*) FILTER (WHERE {_has_sql(w)}) AS found FROM open_texts"
        for w in RARE
    ),
)
def keyword_lookups(b: Bronze) -> DataFrame:
    """For several queries: the texts there are, those that the index lets through to be verified, and those found."""
    root = text_root(b)
    texts = b.spark.read.parquet(f"{root}/texts").agg(F.count("*").alias("texts"))
    rows = []
    for word in RARE:
        verified = search.candidates(b.spark, root, word).agg(F.count("*").alias("verified"))
        found = search.indexed_keyword(b.spark, root, word, ["text", "source"]).agg(F.count("*").alias("found"))
        one = texts.select(
            F.lit(word).alias("query"), "texts", verified.scalar().alias("verified"), found.scalar().alias("found")
        )
        rows.append(one)
    return reduce(DataFrame.unionByName, rows)
