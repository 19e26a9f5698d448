"""Queries on consensus, coverage, caps and entity resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from fernhill.functions import text as T
from fernhill.operators import consensus as C, coverage as K, resolution as E
from fernhill.plans._book import query, rows

# ---- consensus -------------------------------------------------------------------------------

_VOTE = """
cnt AS (SELECT image_id, field, value, count(*) AS votes FROM fx_runs GROUP BY ALL),
v AS (SELECT *, CAST(sum(votes) OVER w AS BIGINT) AS total, count(*) OVER w AS nd FROM cnt WINDOW w AS (PARTITION BY image_id, field)
      QUALIFY row_number() OVER (PARTITION BY image_id, field ORDER BY votes DESC, value) = 1)"""


@query("a6_majority_vote", f"""WITH {_VOTE} SELECT image_id, field, CASE WHEN total >= 3 AND nd = total THEN 'unknown' ELSE value END AS value,
CASE WHEN votes = total THEN 'high' WHEN total >= 3 AND nd = total THEN 'low' ELSE 'medium' END AS confidence FROM v""", "fx_runs")
def majority(runs):
    return C.majority_vote(runs)


@query("a7_fraction_vote", f"WITH {_VOTE} SELECT image_id, field, value, round(votes / total, 4) AS confidence FROM v", "fx_runs")
def fraction(runs):
    return C.fraction_vote(runs)


@query("a19_tiebreak_needed", """
SELECT image_id, min(value) FILTER (WHERE run_id = 1) IS DISTINCT FROM min(value) FILTER (WHERE run_id = 2) AS needs_tiebreak FROM fx_runs WHERE run_id <= 2 GROUP BY image_id""", "fx_runs")
def tiebreak(runs):
    return C.tiebreak_needed(runs)


_ITEMS = "items AS (SELECT DISTINCT l_orderkey % 500 AS record_id, l_linenumber AS run_id, l_returnflag || l_linestatus AS item FROM {lineitem})"


def _list_items(lineitem):
    return lineitem.select((F.col("l_orderkey") % 500).alias("record_id"), F.col("l_linenumber").alias("run_id"), F.concat("l_returnflag", "l_linestatus").alias("item"))


@query("a8_list_vote", f"""WITH {_ITEMS}, n AS (SELECT record_id, count(DISTINCT run_id) AS n_runs FROM items GROUP BY 1),
v AS (SELECT record_id, item, count(*) AS votes FROM items GROUP BY ALL)
SELECT record_id, item, votes, row_number() OVER (PARTITION BY record_id ORDER BY votes DESC, item) AS place FROM v JOIN n USING (record_id) WHERE votes >= ceil(n_runs * 0.5)""", "lineitem")
def list_vote(lineitem):
    items = _list_items(lineitem)
    return C.list_vote(items, items.groupBy("record_id").agg(F.countDistinct("run_id").alias("n_runs")))


@query("a9_plausible_vote", f"""WITH {_ITEMS}, n AS (SELECT record_id, count(DISTINCT run_id) AS n_runs FROM items GROUP BY 1),
v AS (SELECT record_id, item, count(*) AS votes FROM items GROUP BY ALL)
SELECT record_id, string_agg(item, ',' ORDER BY item) AS plausible FROM v JOIN n USING (record_id) WHERE votes >= ceil(n_runs / 2) GROUP BY record_id""", "lineitem")
def plausible_vote(lineitem):
    items = _list_items(lineitem)
    kept = C.list_vote(items, items.groupBy("record_id").agg(F.countDistinct("run_id").alias("n_runs")))
    return kept.groupBy("record_id").agg(F.array_join(F.array_sort(F.collect_list("item")), ",").alias("plausible"))


_CONSENSUS = """
c AS (SELECT product_id, field, value, count(*) AS votes FROM fx_traits GROUP BY ALL),
a AS (SELECT product_id, field, value AS consensus, round(votes / sum(votes) OVER (PARTITION BY product_id, field), 4) AS confidence FROM c
      QUALIFY row_number() OVER (PARTITION BY product_id, field ORDER BY votes DESC, value) = 1)"""


@query("a10_product_consensus", f"WITH {_CONSENSUS} SELECT * FROM a", "fx_traits")
def consensus(traits):
    return C.product_consensus(traits)[0]


@query("a10_representative_image", f"""WITH {_CONSENSUS},
h AS (SELECT t.product_id, t.image_id, CAST(sum((t.value = a.consensus)::INT) AS BIGINT) AS agreements FROM fx_traits t JOIN a USING (product_id, field) GROUP BY ALL)
SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY agreements DESC, image_id) = 1""", "fx_traits")
def representative(traits):
    return C.product_consensus(traits)[1]


@query("a11_measure_median", """
SELECT l_partkey AS record_id, l_returnflag AS measure, round(quantile_cont(l_quantity::DOUBLE, 0.5), 2) AS median FROM {lineitem} GROUP BY ALL""", "lineitem")
def median(lineitem):
    return C.measure_median(lineitem.select(F.col("l_partkey").alias("record_id"), F.col("l_returnflag").alias("measure"), F.col("l_quantity").alias("value")))


@query("d19_merge_traits", """
WITH m AS (SELECT image_id AS record_id, field, max(value) FILTER (WHERE value <> 'unknown') AS iv, max(value) FILTER (WHERE image_id % 3 = 0) AS sv
  FROM fx_traits WHERE value <> 'unknown' OR image_id % 3 = 0 GROUP BY ALL)
SELECT record_id, field, coalesce(sv, iv) AS value,
  CASE WHEN sv IS NULL THEN 'image' WHEN iv IS NULL THEN 'spec' WHEN iv = sv THEN 'both' ELSE 'spec_over_image' END AS source FROM m""", "fx_traits")
def merge_traits(traits):
    rows_ = traits.select(F.col("image_id").alias("record_id"), "field", "value")
    return C.merge_traits(rows_.where("value <> 'unknown'"), rows_.where("record_id % 3 = 0"))


# ---- coverage and caps -----------------------------------------------------------------------

_TRAJECTORY = """
images AS (SELECT DISTINCT product_id, visual_type, position FROM fx_traits),
big AS (SELECT product_id FROM images GROUP BY 1 HAVING count(*) >= 8),
pairs AS (SELECT DISTINCT product_id, position, field, value FROM fx_traits WHERE lower(value) NOT IN ('', 'unknown', 'n/a', 'na')),
np AS (SELECT product_id, position, count(*) AS n FROM (SELECT product_id, min(position) AS position FROM pairs GROUP BY product_id, field, value) GROUP BY ALL),
nf AS (SELECT product_id, position, count(*) AS n FROM (SELECT product_id, min(position) AS position FROM pairs GROUP BY product_id, field) GROUP BY ALL),
g AS (SELECT i.product_id, i.visual_type, i.position, coalesce(np.n, 0) AS new_pairs, coalesce(nf.n, 0) AS new_fields
      FROM images i JOIN big USING (product_id) LEFT JOIN np USING (product_id, position) LEFT JOIN nf USING (product_id, position)),
whole AS (SELECT *, new_pairs - new_fields AS new_values, CAST(sum(new_pairs) OVER r AS BIGINT) AS cumulative,
           CASE WHEN sum(new_pairs) OVER p > 0 THEN round(sum(new_pairs) OVER r / sum(new_pairs) OVER p, 6) ELSE 0.0 END AS coverage
         FROM g WINDOW p AS (PARTITION BY product_id), r AS (PARTITION BY product_id ORDER BY position ROWS UNBOUNDED PRECEDING)),
traj AS (SELECT * FROM whole WHERE position <= 12)"""
_CURVE = _TRAJECTORY + """,
curve AS (SELECT visual_type, position, count(*) AS support, round(avg(new_pairs), 6) AS mean_new, round(quantile_cont(new_pairs::DOUBLE, 0.5), 6) AS median_new,
  round(quantile_cont(new_pairs::DOUBLE, 0.75), 6) AS p75_new, round(quantile_cont(new_pairs::DOUBLE, 0.9), 6) AS p90_new, round(avg(coverage), 6) AS mean_coverage, count(*) < 20 AS low_confidence
  FROM traj GROUP BY ALL)"""


@query("k1_trait_pairs", "SELECT DISTINCT product_id, image_id, position, visual_type, field, value FROM fx_traits WHERE lower(value) NOT IN ('', 'unknown', 'n/a', 'na')", "fx_traits")
def trait_pairs(traits):
    return K.trait_pairs(traits)


@query("k2_coverage_trajectory", f"WITH {_TRAJECTORY} SELECT * FROM traj", "fx_traits")
def trajectory(traits):
    return K.coverage_trajectory(traits)


def _greedy_sql(most: int = 12) -> str:
    """A table of each step's choice for every product: the image with most pairs that no earlier choice has."""
    steps = ["""pairs AS MATERIALIZED (SELECT product_id, position, list_distinct(list(concat(field, ':', value)) FILTER (WHERE lower(value) NOT IN ('', 'unknown', 'n/a', 'na'))) AS held FROM fx_traits GROUP BY ALL),
s0 AS MATERIALIZED (SELECT DISTINCT product_id, []::BIGINT[] AS taken, []::VARCHAR[] AS seen, 0::BIGINT AS position, 0::BIGINT AS new_pairs FROM pairs)"""]
    for k in range(most):
        steps.append(f"""s{k + 1} AS MATERIALIZED (
  SELECT product_id, list_append(taken, position) AS taken, list_concat(seen, fresh) AS seen, position, len(fresh)::BIGINT AS new_pairs FROM (
    SELECT s.product_id, s.taken, s.seen, p.position, list_filter(coalesce(p.held, []), lambda x: NOT list_contains(s.seen, x)) AS fresh FROM s{k} s JOIN pairs p ON p.product_id = s.product_id WHERE NOT list_contains(s.taken, p.position))
  QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY len(fresh) DESC, position) = 1)""")
    return f"WITH {', '.join(steps)} " + " UNION ALL ".join(f"SELECT product_id, position, {k + 1}::BIGINT AS step, new_pairs, len(seen)::BIGINT AS cumulative FROM s{k + 1}" for k in range(most))


@query("k3_oracle_order", _greedy_sql(), "fx_traits")
def oracle_order(traits):
    return K.oracle_order(traits)


@query("k4_marginal_curve", f"WITH {_CURVE} SELECT * FROM curve", "fx_traits")
def curve(traits):
    return K.marginal_curve(K.coverage_trajectory(traits))


@query("k5_saturation_point", f"WITH {_CURVE} SELECT visual_type, min(position) AS saturation FROM curve WHERE support >= 20 AND mean_new < 0.5 GROUP BY 1", "fx_traits")
def saturation(traits):
    return K.saturation_point(K.marginal_curve(K.coverage_trajectory(traits)))


@query("k6_late_gain", f"""WITH {_TRAJECTORY}, p AS (SELECT visual_type, product_id, max((position > 5 AND new_pairs > 0)::INT) AS a, max((position > 8 AND new_pairs > 0)::INT) AS b, max((position > 10 AND new_pairs > 0)::INT) AS c FROM traj GROUP BY ALL)
SELECT visual_type, count(*) AS products, round(avg(a), 6) AS after_5, round(avg(b), 6) AS after_8, round(avg(c), 6) AS after_10 FROM p GROUP BY 1""", "fx_traits")
def late_gain(traits):
    return K.late_gain(K.coverage_trajectory(traits))


@query("k7_threshold_crossing", f"""WITH {_TRAJECTORY}, p AS (SELECT visual_type, product_id, min(position) FILTER (WHERE coverage >= 0.9) AS reached FROM traj GROUP BY ALL)
SELECT visual_type, count(*) AS products, round(quantile_cont(reached::DOUBLE, 0.5), 6) AS median_at, round(quantile_cont(reached::DOUBLE, 0.9), 6) AS p90_at, round(avg((reached IS NULL)::INT), 6) AS never FROM p GROUP BY 1""", "fx_traits")
def crossing(traits):
    return K.threshold_crossing(K.coverage_trajectory(traits))


@query("k8_cap_scorecard", f"""WITH {_TRAJECTORY}, p AS (SELECT cap, product_id, max(coverage) FILTER (WHERE position <= cap) AS c, count(*) AS n FROM whole CROSS JOIN (SELECT unnest([4, 6, 8, 10, 12])::BIGINT AS cap) GROUP BY ALL)
SELECT cap, round(avg(c), 6) AS mean_coverage, round(avg((c >= 0.9)::INT), 6) AS share_90, round(avg((c >= 0.95)::INT), 6) AS share_95,
  round((sum(least(n, cap)) * 0.009532::DOUBLE)::DOUBLE, 4) AS cost, round((sum(n - least(n, cap)) * 0.009532::DOUBLE)::DOUBLE, 4) AS savings FROM p GROUP BY 1""", "fx_traits")
def scorecard(traits):
    return K.cap_scorecard(K.coverage_trajectory(traits, most=None))


_POLICY = [("flat_8", t, 8) for t in ("stool", "bench", "guest_chair")] + [("tight", "stool", 4), ("tight", "bench", 5)]


@query("k9_policy_savings", "WITH pol(policy, visual_type, cap) AS (VALUES " + ", ".join(map(str, _POLICY)) + """), n AS (SELECT product_id, visual_type, count(*) AS n FROM fx_images GROUP BY ALL)
SELECT policy, visual_type, CAST(sum(least(n, cap)) AS BIGINT) AS processed, CAST(sum(n - least(n, cap)) AS BIGINT) AS skipped, round(sum(n - least(n, cap)) / sum(n), 6) AS skip_rate,
  round((sum(n - least(n, cap)) * 0.009532::DOUBLE)::DOUBLE, 4) AS saved FROM n JOIN pol USING (visual_type) GROUP BY ALL""", "fx_images")
def policy(images):
    return K.policy_savings(images, rows(images, _POLICY, "policy string, visual_type string, cap long"))


_CAPPED = """
p AS (SELECT *, least(CASE visual_type WHEN 'stool' THEN 5 WHEN 'bench' THEN 20 ELSE 8 END, 15) AS cap, row_number() OVER (PARTITION BY product_id ORDER BY position) AS n,
        count(*) OVER (PARTITION BY product_id) AS n_passing FROM fx_images WHERE stage_0_result = 'product' AND NOT excluded)"""


@query("w3_cap_first_n", f"WITH {_CAPPED} SELECT product_id, image_id, n FROM p WHERE n <= cap", "fx_images")
def cap_first(images):
    return K.capped_images(images, {"stool": 5, "bench": 20}).where("selected").select("product_id", "image_id", F.col("n").cast("long").alias("n"))


@query("k10_extraction_selection", f"""WITH {_CAPPED} SELECT product_id, max(n_passing) AS passing, count(*) FILTER (WHERE n <= cap) AS selected, count(*) FILTER (WHERE n > cap) AS skipped_by_cap,
bool_or(cap = 15 AND n_passing > 15) AS hard_cap_binding FROM p GROUP BY product_id""", "fx_images")
def selection(images):
    return K.capped_images(images, {"stool": 5, "bench": 20}).groupBy("product_id").agg(
        F.max("n_passing").alias("passing"), F.count_if("selected").alias("selected"), F.count_if(~F.col("selected")).alias("skipped_by_cap"), F.max((F.col("cap") == 15) & (F.col("n_passing") > 15)).alias("hard_cap_binding"))


@query("k11_resolution_gate", """
WITH r AS (SELECT *, short_side >= 591 AS ok, sum((short_side >= 591)::INT) OVER (PARTITION BY product_id ORDER BY position ROWS UNBOUNDED PRECEDING) AS so_far FROM fx_images)
SELECT product_id, min(position) FILTER (WHERE ok) AS first_passing, CAST(least(sum(ok::INT), 5) AS BIGINT) AS passing, count(*) FILTER (WHERE so_far < 5 OR (ok AND so_far = 5)) AS checked FROM r GROUP BY product_id""", "fx_images")
def gate(images):
    return K.resolution_gate(images)


@query("w4_first_seen_pairs", "SELECT product_id, field, value, min(position) AS first_position FROM fx_traits WHERE lower(value) NOT IN ('', 'unknown', 'n/a', 'na') GROUP BY ALL", "fx_traits")
def first_seen(traits):
    return K.trait_pairs(traits).groupBy("product_id", "field", "value").agg(F.min("position").alias("first_position"))


# ---- entity resolution -----------------------------------------------------------------------

_NAME = "concat_ws('::', lower(trim(regexp_replace(brand, '\\s+', ' ', 'g'))), lower(trim(regexp_replace(product_name, '\\s+', ' ', 'g'))))"
_MATCH = f"""
c AS (SELECT source_product_id AS catalog_id, product_name, brand, nullif(regexp_extract(source_product_id, '(\\d+)$', 1), '') AS tail, {_NAME} AS nk FROM fx_catalog_side),
i AS (SELECT source_product_id AS index_id, product_name, brand, nullif(regexp_extract(source_product_id, '(\\d+)$', 1), '') AS tail, {_NAME} AS nk FROM fx_index_side),
cand AS (SELECT tail, count(*) AS n, count(*) FILTER (WHERE regexp_matches(index_id, '^product_dp_\\d+$')) AS n_dp, min(index_id) FILTER (WHERE regexp_matches(index_id, '^product_dp_\\d+$')) AS dp_id, min(index_id) AS any_id FROM i WHERE tail IS NOT NULL GROUP BY tail),
tl AS (SELECT c.*, cand.n, n_dp, dp_id, any_id FROM c JOIN cand USING (tail) QUALIFY row_number() OVER (PARTITION BY tail ORDER BY catalog_id) = 1),
bt AS (SELECT catalog_id, CASE WHEN n = 1 THEN any_id ELSE dp_id END AS index_id, tail, nk FROM tl WHERE n = 1 OR n_dp = 1),
amb AS (SELECT catalog_id FROM tl WHERE NOT (n = 1 OR n_dp = 1)),
cl AS (SELECT * FROM c WHERE catalog_id NOT IN (SELECT catalog_id FROM bt) AND catalog_id NOT IN (SELECT catalog_id FROM amb)),
il AS (SELECT * FROM i WHERE tail IS NULL OR tail NOT IN (SELECT tail FROM bt)),
nm AS (SELECT a.catalog_id, b.index_id, a.tail, a.nk, nc, ni FROM (SELECT *, count(*) OVER (PARTITION BY nk) AS nc FROM cl) a JOIN (SELECT *, count(*) OVER (PARTITION BY nk) AS ni FROM il) b USING (nk)),
bn AS (SELECT catalog_id, index_id, tail, nk FROM nm WHERE nc = 1 AND ni = 1),
rej AS (SELECT catalog_id, 'ambiguous_tail_id' AS reason FROM amb UNION ALL SELECT DISTINCT catalog_id, 'ambiguous_name' FROM nm WHERE nc > 1 OR ni > 1),
al AS (SELECT *, 'tail_id' AS strategy, 'high' AS confidence FROM bt UNION ALL SELECT *, 'brand_name', 'medium' FROM bn
  UNION ALL SELECT catalog_id, NULL, tail, nk, 'catalog_only', 'single' FROM cl WHERE catalog_id NOT IN (SELECT catalog_id FROM bn)
  UNION ALL SELECT NULL, index_id, tail, nk, 'index_only', 'single' FROM il WHERE index_id NOT IN (SELECT index_id FROM bn)),
m AS (SELECT catalog_id, index_id, strategy, confidence, CASE WHEN tail IS NOT NULL THEN concat('dp:', tail) WHEN strategy = 'brand_name' THEN concat('fallback:', substring(sha1(nk), 1, 16))
  WHEN strategy = 'catalog_only' THEN concat('normalized_catalog:', catalog_id) ELSE concat('image_index:', index_id) END AS canonical_key FROM al)"""


@query("c1_match_products", f"WITH {_MATCH} SELECT * FROM m", "fx_catalog_side", "fx_index_side")
def match(catalog, index):
    return E.match_products(catalog, index)[0]


@query("c1_match_rejects", f"WITH {_MATCH} SELECT * FROM rej", "fx_catalog_side", "fx_index_side")
def rejects(catalog, index):
    return E.match_products(catalog, index)[1]


_QUAL = "(CASE WHEN trim({x}) = '' THEN -1000 ELSE length(trim({x})) END)"


@query("c3_merge_product_fields", f"""WITH {_MATCH} SELECT canonical_key, strategy,
  CASE WHEN {_QUAL.format(x="coalesce(i.product_name, '')")} >= {_QUAL.format(x="coalesce(c.product_name, '')")} THEN coalesce(i.product_name, '') ELSE coalesce(c.product_name, '') END AS product_name,
  coalesce(nullif(coalesce(c.brand, ''), ''), coalesce(i.brand, '')) AS brand, (m.catalog_id IS NOT NULL)::INT + (m.index_id IS NOT NULL)::INT AS source_count
FROM m LEFT JOIN c USING (catalog_id) LEFT JOIN i ON i.index_id = m.index_id""", "fx_catalog_side", "fx_index_side")
def merge_fields(catalog, index):
    return E.merge_product_fields(E.match_products(catalog, index)[0], catalog, index)


@query("c7_lineage_links", f"""WITH {_MATCH} SELECT canonical_key, 'normalized_catalog' AS source_system, catalog_id AS source_product_id, strategy, confidence, true AS is_preferred FROM m WHERE catalog_id IS NOT NULL
UNION ALL SELECT canonical_key, 'image_index', index_id, strategy, confidence, catalog_id IS NULL FROM m WHERE index_id IS NOT NULL""", "fx_catalog_side", "fx_index_side")
def lineage(catalog, index):
    return E.lineage_links(E.match_products(catalog, index)[0])


@query("c8_merge_stats", f"WITH {_MATCH} SELECT strategy, count(*) AS n FROM m GROUP BY 1", "fx_catalog_side", "fx_index_side")
def stats(catalog, index):
    return E.match_products(catalog, index)[0].groupBy("strategy").agg(F.count("*").alias("n"))


@query("c9_duplicate_keys", f"WITH {_MATCH} SELECT canonical_key, count(*) AS n FROM m GROUP BY 1 HAVING count(*) > 1", "fx_catalog_side", "fx_index_side")
def duplicates(catalog, index):
    return E.duplicate_keys(E.match_products(catalog, index)[0], "canonical_key")


_SIDES = """
ci AS (SELECT concat('dp:', product_id) AS canonical_key, image_id, concat('https://x.test/', product_id, '/', position, '.jpg?v=', image_id % 3) AS image_url FROM fx_images WHERE image_id % 4 <> 0),
ii AS (SELECT concat('dp:', product_id) AS canonical_key, image_id, concat('https://x.test/', product_id, '/', position, '.jpg', CASE WHEN image_id % 2 = 0 THEN '/' ELSE '#a' END) AS image_url FROM fx_images WHERE image_id % 5 <> 0)"""


@query("c4_match_images", f"""WITH {_SIDES}, a AS (SELECT canonical_key, regexp_replace(regexp_replace(trim(image_url), '[#?].*$', ''), '/$', '') AS url, min(image_id) AS catalog_image FROM ci GROUP BY ALL),
b AS (SELECT canonical_key, regexp_replace(regexp_replace(trim(image_url), '[#?].*$', ''), '/$', '') AS url, min(image_id) AS index_image FROM ii GROUP BY ALL)
SELECT coalesce(a.canonical_key, b.canonical_key) AS canonical_key, coalesce(a.url, b.url) AS url, catalog_image, index_image,
  CASE WHEN a.url IS NULL THEN 'index_only' WHEN b.url IS NULL THEN 'catalog_only' ELSE 'url' END AS strategy,
  concat(coalesce(a.canonical_key, b.canonical_key), ':img:', substring(sha1(coalesce(a.url, b.url)), 1, 16)) AS canonical_image_key
FROM a FULL JOIN b ON a.canonical_key = b.canonical_key AND a.url = b.url""", "fx_images")
def match_images(images):
    base = F.concat(F.lit("https://x.test/"), F.col("product_id"), F.lit("/"), F.col("position"), F.lit(".jpg"))
    key = F.concat(F.lit("dp:"), F.col("product_id")).alias("canonical_key")
    ci = images.where("image_id % 4 <> 0").select(key, "image_id", F.concat(base, F.lit("?v="), F.col("image_id") % 3).alias("image_url"))
    ii = images.where("image_id % 5 <> 0").select(key, "image_id", F.concat(base, F.when(F.col("image_id") % 2 == 0, "/").otherwise("#a")).alias("image_url"))
    return E.match_images(ci, ii)


@query("c10_existing_lookup", """
SELECT c.source_product_id AS submitted, min(i.source_product_id) AS existing FROM fx_catalog_side c LEFT JOIN fx_index_side i ON regexp_extract(i.source_product_id, '(\\d+)$', 1) = nullif(regexp_extract(c.source_product_id, '(\\d+)$', 1), '') GROUP BY 1""", "fx_catalog_side", "fx_index_side")
def existing(catalog, index):
    left = catalog.select(F.col("source_product_id").alias("submitted"), F.nullif(T.tail_id(F.col("source_product_id")), F.lit("")).alias("tail"))
    right = index.select(F.col("source_product_id").alias("found"), T.tail_id(F.col("source_product_id")).alias("tail"))
    return left.join(right, "tail", "left").groupBy("submitted").agg(F.min("found").alias("existing"))


@query("s13_upsert_by_key", "SELECT product_id, brand, 'old' AS v FROM fx_products WHERE product_id % 3 <> 0 UNION ALL SELECT product_id, brand, 'new' FROM fx_products WHERE product_id % 3 = 0", "fx_products")
def upsert(products):
    return E.upsert_by_key(products.select("product_id", "brand", F.lit("old").alias("v")), products.where("product_id % 3 = 0").select("product_id", "brand", F.lit("new").alias("v")), "product_id")


@query("u2_replace_product_images", "SELECT product_id, image_id FROM fx_images WHERE product_id % 10 <> 0 UNION ALL SELECT product_id, image_id + 1000000 FROM fx_images WHERE product_id % 10 = 0 AND position <= 3", "fx_images")
def replace_images(images):
    old = images.select("product_id", "image_id")
    return E.replace_product_images(old, images.where("product_id % 10 = 0 AND position <= 3").select("product_id", (F.col("image_id") + 1000000).alias("image_id")))


@query("u3_merge_images_by_key", "SELECT product_id, max(event_id) AS event_id, arg_max(status, (refreshed_at, event_id)) AS status FROM fx_refreshes GROUP BY 1".replace("max(event_id) AS event_id", "arg_max(event_id, (refreshed_at, event_id)) AS event_id"), "fx_refreshes")
def merge_images(refreshes):
    return E.latest_wins(refreshes, ["product_id"], F.desc("refreshed_at"), F.desc("event_id")).select("product_id", "event_id", "status")


_URLS = "urls AS (SELECT product_id, position AS ord, concat('https://x.test/', product_id, '/', position % 7, CASE WHEN position % 2 = 0 THEN '/' ELSE '?a=1' END) AS url FROM fx_images)"


@query("u5_url_union", f"""WITH {_URLS}, o AS (SELECT product_id, regexp_replace(regexp_replace(url, '[#?].*$', ''), '/$', '') AS k, min(ord) AS ord, arg_min(url, ord) AS url FROM urls GROUP BY 1, 2)
SELECT product_id, string_agg(url, ' ' ORDER BY ord) AS urls FROM o GROUP BY 1""", "fx_images")
def url_union(images):
    url = F.concat(F.lit("https://x.test/"), F.col("product_id"), F.lit("/"), F.col("position") % 7, F.when(F.col("position") % 2 == 0, "/").otherwise("?a=1"))
    return E.url_union(images.select("product_id", F.col("position").alias("ord"), url.alias("url"))).select("product_id", F.array_join("urls", " ").alias("urls"))


@query("u1_append_exact_source", """
SELECT DISTINCT product_id, image_id FROM (SELECT product_id, image_id FROM fx_images WHERE position <= 2 UNION ALL SELECT product_id, image_id FROM fx_images WHERE vec_id = 7)""", "fx_images")
def append_exact(images):
    return images.where("position <= 2").select("product_id", "image_id").unionByName(images.where("vec_id = 7").select("product_id", "image_id")).dropDuplicates()


@query("u4_trait_set_algebra", """
WITH s AS (SELECT product_id, list_sort(list(DISTINCT field || '=' || value) FILTER (WHERE position = 1)) AS a, list_sort(list(DISTINCT field || '=' || value) FILTER (WHERE position = 2)) AS b FROM fx_traits GROUP BY 1)
SELECT product_id, array_to_string(list_sort(list_intersect(a, b)), ',') AS shared, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS preferred_only,
  array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), ',') AS demoted_only FROM s WHERE a IS NOT NULL AND b IS NOT NULL""", "fx_traits")
def set_algebra(traits):
    pair = F.concat_ws("=", "field", "value")
    s = traits.groupBy("product_id").agg(F.collect_set(F.when(F.col("position") == 1, pair)).alias("a"), F.collect_set(F.when(F.col("position") == 2, pair)).alias("b")).where((F.size("a") > 0) & (F.size("b") > 0))
    text = lambda c: F.array_join(F.array_sort(c), ",")
    return s.select("product_id", text(F.array_intersect("a", "b")).alias("shared"), text(F.array_except("a", "b")).alias("preferred_only"), text(F.array_except("b", "a")).alias("demoted_only"))
