"""All queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions.text import latin, prepared, salient, tokens
from ..operators import audit, blocking, decision, metrics, model, pairs
from ..sources import records as sources
from . import sql, views

THRESHOLD = 0.7


def _r(column: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, digits)


def _top(spark: SparkSession, sf_dir: str):
    """queries, targets, truth and the top candidates by token overlap."""
    queries, targets = views.sides(spark, sf_dir)
    return queries, targets, views.truth(queries, targets), blocking.top_candidates(views.overlap_pairs(queries, targets), score="p")


def _ids(queries: DataFrame) -> DataFrame:
    return queries.select(F.col("row_id").alias("query_id"), "entity_id", "country")


# --- text ----------------------------------------------------------------------------------------


def normalize_name(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", F.md5(latin(F.col("text")).cast("binary")).alias("norm_md5"))


def canonical_name(spark, sf_dir):
    return prepared(views.records(spark, sf_dir)).select("row_id", "name", "core")


def expand_address(spark, sf_dir):
    return prepared(views.records(spark, sf_dir)).select("row_id", "address")


def salient_tokens(spark, sf_dir):
    return prepared(views.records(spark, sf_dir)).select("row_id", F.array_join(salient(F.col("core")), " ").alias("told"))


def prepared_record(spark, sf_dir):
    listed = lambda c: F.array_join(F.array_sort(c), " ").alias(c)
    return prepared(views.records(spark, sf_dir)).select(
        "row_id", "name", "core", "address", "nation", "name_sorted", "core_sorted", "address_sorted", listed("address_numbers"), "house", listed("postcodes"), "initials"
    )


# --- blocking --------------------------------------------------------------------------------------


def blocking_keys(spark, sf_dir):
    return blocking.postings(prepared(views.records(spark, sf_dir))).select("row_id", "key")


def posting_counts(spark, sf_dir):
    return blocking.postings(views.sides(spark, sf_dir)[1]).groupBy("key").agg(F.count(F.lit(1)).alias("postings"))


def eligible_keys(spark, sf_dir):
    queries, targets = views.sides(spark, sf_dir)
    return blocking.eligible(blocking.postings(targets), blocking.postings(queries))


def raw_candidates(spark, sf_dir):
    return blocking.candidate_pairs(*views.sides(spark, sf_dir))


def raw_candidate_count(spark, sf_dir):
    queries, targets = views.sides(spark, sf_dir)
    return blocking.candidate_counts(queries, blocking.candidate_pairs(queries, targets))


def overlap_candidates(spark, sf_dir):
    return _top(spark, sf_dir)[3].select("query_id", "row_id", "p", "p2", F.col("rank").cast("bigint").alias("rank"))


def preliminary_similarity(spark, sf_dir):
    queries, targets = views.sides(spark, sf_dir)
    scored = blocking.scored_pairs(blocking.candidate_pairs(queries, targets), queries, targets)
    return scored.select("query_id", "row_id", _r("prelim").alias("prelim"))


def topk_candidates(spark, sf_dir):
    queries, targets = views.sides(spark, sf_dir)
    scored = blocking.scored_pairs(blocking.candidate_pairs(queries, targets), queries, targets)
    return blocking.top_candidates(scored).select("query_id", "row_id", _r("prelim").alias("prelim"), "rank")


# --- similarity and features -------------------------------------------------------------------------


def _strings(name, column):
    def query(spark, sf_dir):
        return views.string_pairs(spark, sf_dir).select("p_partkey", _r(column(F.col("a"), F.col("b"))).alias(name))

    return query


def token_overlap(spark, sf_dir):
    jaccard, containment = S.overlap(F.array_distinct(tokens(F.col("a"))), F.array_distinct(tokens(F.col("b"))))
    return views.string_pairs(spark, sf_dir).select("p_partkey", _r(jaccard).alias("jaccard"), _r(containment).alias("containment"))


def fuzzy_tokens(spark, sf_dir):
    sets = (F.array_distinct(tokens(F.col("a"))), F.array_distinct(tokens(F.col("b"))))
    return views.string_pairs(spark, sf_dir).select("p_partkey", _r(S.fuzzy_tokens_col(*sets)).alias("fuzzy"))


def pair_features_core(spark, sf_dir):
    queries, targets, _, top = _top(spark, sf_dir)
    wide = pairs.joined(top.select("query_id", "row_id"), queries, targets)
    return wide.select("query_id", "row_id", *[_r(v).alias(k) for k, v in pairs.plain_features().items()])


def pair_features_full(spark, sf_dir):
    """The candidates are written first, two numbers a pair; string kernels then run in a plan of their own."""
    queries, targets, _, top = _top(spark, sf_dir)
    return pairs.features(sources.durable(top.select("query_id", "row_id")), queries, targets)


def labelled_pairs(spark, sf_dir):
    _, _, truth, top = _top(spark, sf_dir)
    return top.join(truth.withColumn("label", F.lit(1)), ["query_id", "row_id"], "left").select("query_id", "row_id", F.coalesce("label", F.lit(0)).alias("label"))


# --- metrics -----------------------------------------------------------------------------------------


def _per_query(spark, sf_dir):
    queries, _, truth, top = _top(spark, sf_dir)
    return metrics.per_query(_ids(queries), truth, top, THRESHOLD)


def query_f05(spark, sf_dir):
    return _per_query(spark, sf_dir).select("query_id", "n_true", "n_predicted", "n_hits", "n_found", _r("f05").alias("f05"))


_RATES = ("macro_f05", "micro_precision", "micro_recall", "candidate_recall", "singleton_accuracy")


def _rounded(report: DataFrame) -> DataFrame:
    return report.withColumns({c: _r(c) for c in _RATES})


def macro_f05(spark, sf_dir):
    return _rounded(metrics.report(_per_query(spark, sf_dir))).select("macro_f05")


def metric_report(spark, sf_dir):
    return _rounded(metrics.report(_per_query(spark, sf_dir)))


def metric_by_country(spark, sf_dir):
    return _rounded(metrics.report(_per_query(spark, sf_dir), ["country"]))


def _curve(spark, sf_dir, thresholds, weights, second=None):
    queries, _, truth, top = _top(spark, sf_dir)
    return metrics.curve(_ids(queries), truth, top, tuple(thresholds), weights, "p", second)


def threshold_curve(spark, sf_dir):
    return _curve(spark, sf_dir, metrics.CALIBRATION_GRID, (0.0,)).select("threshold", _r("macro_f05").alias("macro_f05"))


def calibrated_threshold(spark, sf_dir):
    return metrics.calibrated(_curve(spark, sf_dir, metrics.CALIBRATION_GRID, (0.0,))).select("threshold", _r("macro_f05").alias("macro_f05"))


def blend_sweep(spark, sf_dir):
    points = _curve(spark, sf_dir, metrics.SWEEP_GRID, metrics.WEIGHTS, "p2")
    return points.select("weight", "threshold", _r("macro_f05").alias("macro_f05"))


def blend_choice(spark, sf_dir):
    return metrics.swept(_curve(spark, sf_dir, metrics.SWEEP_GRID, metrics.WEIGHTS, "p2")).select("weight", "threshold", _r("macro_f05").alias("macro_f05"))


def sample_split(spark, sf_dir):
    drawn = metrics.sampled(views.records(spark, sf_dir).filter("role = 0"), 200, 20260925)
    return drawn.select("entity_id", F.col("position").cast("bigint").alias("position"), "split")


def source_profile(spark, sf_dir):
    return metrics.source_profile(views.records(spark, sf_dir))


def truth_cardinality(spark, sf_dir):
    queries, targets = views.sides(spark, sf_dir)
    return metrics.truth_cardinality(_ids(queries), views.truth(queries, targets))


def noise_profile(spark, sf_dir):
    queries, targets = views.sides(spark, sf_dir)
    pairs_ = views.truth(queries, targets).unionByName(blocking.candidate_pairs(queries, targets)).distinct()
    return metrics.noise_profile(pairs_, queries, targets)


# --- decisions ---------------------------------------------------------------------------------------


def resolve_exclusive(spark, sf_dir):
    return decision.exclusive(_top(spark, sf_dir)[3], 0.01).select("query_id", "row_id", "p")


def exclusive_scores(spark, sf_dir):
    return decision.exclusive_scores(_top(spark, sf_dir)[3], THRESHOLD).select("query_id", "row_id", "p")


def owner_conflicts(spark, sf_dir):
    return decision.conflicts(_top(spark, sf_dir)[3], THRESHOLD)


def _three(spark, sf_dir):
    """Three probabilities of each supplier, from its key and balance."""
    made = F.array(*[F.round(F.pmod(F.col("s_suppkey") * k + 13, F.lit(97)) / 100.0, 2) for k in (7, 31, 53)])
    return views.table(spark, sf_dir, "supplier").select("s_suppkey", F.reverse(F.array_sort(made)).alias("ps"))


def expected_f05(spark, sf_dir):
    scores = _three(spark, sf_dir).select("s_suppkey", F.posexplode(decision.expected_f05(F.col("ps"), 0.1)).alias("k", "score"))
    return scores.select("s_suppkey", F.col("k").cast("bigint").alias("k"), _r("score").alias("expected"))


def choose_prefix(spark, sf_dir):
    best = _three(spark, sf_dir).select("s_suppkey", decision.best_prefix(F.col("ps"), 0.1).alias("best"))
    return best.select("s_suppkey", F.col("best.selected").cast("bigint").alias("selected"), _r("best.expected").alias("expected"))


# --- outputs -----------------------------------------------------------------------------------------


def _assembled(spark, sf_dir, *names):
    keeps = {"matched_entity_ids": metrics.at_least(F.col("p"), THRESHOLD), "candidate_entity_ids": F.lit(True)}
    queries, targets, _, top = _top(spark, sf_dir)
    ranked = top.join(targets.select("row_id", F.col("entity_id").alias("target_entity_id")), "row_id")
    listed = queries.select(F.col("row_id").alias("query_id"), "entity_id", F.col("row_id").alias("ordinal"))
    return sources.result_lists(listed, ranked, {name: keeps[name] for name in names})


def assembled_matches(spark, sf_dir):
    return _assembled(spark, sf_dir, "matched_entity_ids")


def assembled_candidates(spark, sf_dir):
    return _assembled(spark, sf_dir, "candidate_entity_ids")


def _audited(spark, sf_dir):
    """The assembled outputs with faults put in by ordinal: lost rows, wrong order, repeats, strangers."""
    at = lambda n: F.pmod(F.col("ordinal"), F.lit(3 * n)) == 0
    expected = views.records(spark, sf_dir).filter("role = 0").select(F.col("row_id").alias("ordinal"), "entity_id")
    both = sources.durable(_assembled(spark, sf_dir, "matched_entity_ids", "candidate_entity_ids"))  # two outputs of one ranking
    matching = both.drop("candidate_entity_ids").filter(~at(31))
    matching = matching.withColumn("source1_entity_id", F.when(at(17), F.lit("S1-none")).otherwise(F.col("source1_entity_id")))
    matching = matching.withColumn("matched_entity_ids", F.when(at(13), F.lit("S2-1,S2-1,S2-none")).otherwise(F.col("matched_entity_ids")))
    candidates = both.drop("matched_entity_ids")
    candidates = candidates.withColumn("candidate_entity_ids", F.when(at(19), F.lit("X-1")).otherwise(F.col("candidate_entity_ids")))
    targets = views.records(spark, sf_dir).filter("role > 0").select("entity_id")
    return audit.aligned(expected, matching, candidates), targets


def audit_violations(spark, sf_dir):
    return audit.violations(*_audited(spark, sf_dir))


def audit_summary(spark, sf_dir):
    return audit.summary(*_audited(spark, sf_dir))


# --- models ------------------------------------------------------------------------------------------


def _labelled(spark, sf_dir):
    """Plain features, label, country and split of the top candidates, without sampling."""
    queries, targets, truth, top = _top(spark, sf_dir)
    wide = pairs.joined(top.select("query_id", "row_id"), queries, targets)
    made = wide.select("query_id", "row_id", F.col("l_country").alias("country"), *[v.cast("float").alias(k) for k, v in pairs.plain_features().items()])
    place = F.pmod(F.conv(F.substring(F.md5(F.col("query_id").cast("string").cast("binary")), 1, 6), 16, 10).cast("int"), F.lit(100))
    split = F.when(place < 70, "fit").when(place < 85, "tune").otherwise("holdout")
    labelled = made.join(truth.withColumn("label", F.lit(1.0)), ["query_id", "row_id"], "left").fillna(0.0, ["label"])
    return _ids(queries), truth, labelled.withColumn("split", split), split



def _features() -> tuple[str, ...]:
    return tuple(pairs.plain_features())


def gbt_scores(spark, sf_dir):
    _, _, labelled, _ = _labelled(spark, sf_dir)
    labelled = labelled.cache()
    fitted = [model.fit(labelled.filter("split = 'fit'"), kind, 5, features=_features()) for kind in ("first", "second")]
    scored = model.score(fitted[1], model.score(fitted[0], labelled, "p"), "p2")
    return scored.select("query_id", "row_id", "label", "p", "p2", model.blend(F.col("p"), F.col("p2"), 0.5).alias("blended"))


def feature_importance(spark, sf_dir):
    _, _, labelled, _ = _labelled(spark, sf_dir)
    ranked = model.importance(model.fit(labelled.filter("split = 'fit'").cache(), "first", 5, features=_features()), _features())
    return spark.createDataFrame(ranked, "feature string, gain double")


def country_transfer(spark, sf_dir):
    queries, truth, labelled, split = _labelled(spark, sf_dir)
    found = model.country_transfer(labelled.cache(), queries.withColumn("split", split), truth, 0.5, 3, _features())
    return spark.createDataFrame([(c, v["macro_f05"], v["queries"]) for c, v in found.items()], "country string, macro_f05 double, queries bigint")


def stream_scored(spark, sf_dir):
    """The queries as a stream of files, scored against the targets in resumable micro-batches."""
    from ..streaming import scoring

    queries, targets = views.sides(spark, sf_dir)
    folder = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tallyweave-stream-")
    folder = f"{folder}/stream-{uuid.uuid4().hex}"
    queries.repartitionByRange(4, "row_id").write.parquet(f"{folder}/queries")

    def score(batch: DataFrame) -> DataFrame:
        top = blocking.top_candidates(views.overlap_pairs(batch, targets), score="p")
        return top.select("query_id", "row_id", "p", "p2", F.col("rank").cast("bigint").alias("rank"))

    scoring.score_stream(spark, f"{folder}/queries", queries.schema, f"{folder}/scored", score, files_per_batch=2)
    return scoring.scored(spark, f"{folder}/scored").drop("batch_id")


def record_table(spark, sf_dir):
    """Dense ordinals in entity order, as a stored table has them."""
    return sources.with_rows(views.records(spark, sf_dir).select("entity_id", "country"), ["entity_id"], "ordinal")


# --- SQL ---------------------------------------------------------------------------------------------

_PART = "part_pairs AS (SELECT p_partkey, lower(p_name) AS a, lower(p_type) AS b FROM part)"
_SET = lambda x: f"list_sort(list_distinct({sql.tokens(x)}))"
_SORTED = lambda x: f"array_to_string({_SET(x)}, ' ')"
_T = f"{THRESHOLD}"


def _plain_sql() -> str:
    o = lambda c: sql._overlap(f"l.{c}", f"r.{c}")
    numbers = "list_distinct(l.runs)", "list_distinct(r.runs)"
    post = tuple(f"list_filter(list_distinct({s}.runs), lambda x: length(x) IN (5, 6))" for s in "lr")
    flag = lambda x: f"({x})::INT::DOUBLE"
    some = lambda p: f"len({p[0]}) > 0 AND len({p[1]}) > 0"
    hit = lambda p: f"len(list_intersect({p[0]}, {p[1]})) > 0"
    house = tuple(f"coalesce({s}.runs[1], '')" for s in "lr")
    first = tuple(f"array_to_string(list_transform({s}.core_tokens, lambda t: substr(t, 1, 1)), '')" for s in "lr")
    out = {}
    for f in pairs.FIELDS:
        blank = f"l.{f} = '' OR r.{f} = ''"
        out[f"{f}_length_ratio"] = f"CASE WHEN {blank} THEN 0.0 ELSE least(length(l.{f}), length(r.{f})) / greatest(length(l.{f}), length(r.{f})) END"
        out[f"{f}_equal"] = f"CASE WHEN {blank} THEN 0.0 ELSE {flag(f'l.{f} = r.{f}')} END"
    out["name_token_jaccard"], out["name_token_containment"] = o("core_set")
    out["address_token_jaccard"], out["address_token_containment"] = o("address_set")
    out["address_digit_jaccard"], out["address_digit_overlap"] = sql._overlap(*numbers)
    out["address_digit_conflict"] = flag(f"{some(numbers)} AND NOT {hit(numbers)}")
    out["house_equal"] = flag(f"{house[0]} <> '' AND {house[0]} = {house[1]}")
    out["house_conflict"] = flag(f"{house[0]} <> '' AND {house[1]} <> '' AND {house[0]} <> {house[1]}")
    out["postcode_equal"] = flag(f"{some(post)} AND {hit(post)}")
    out["postcode_conflict"] = flag(f"{some(post)} AND NOT {hit(post)}")
    digits = tuple(f"list_distinct(regexp_extract_all({s}.name, '[0-9]+'))" for s in "lr")
    out["name_digit_jaccard"] = sql._overlap(*digits)[0]
    for side, p in (("left", "l"), ("right", "r")):
        out[f"{side}_name_tokens"] = f"len({p}.core_set)"
        out[f"{side}_address_tokens"] = f"len({p}.address_set)"
        out[f"{side}_name_missing"] = flag(f"{p}.business_name = ''")
        out[f"{side}_address_missing"] = flag(f"{p}.business_address = ''")
    out["country_equal"] = flag("l.country = r.country")
    out["initials_equal"] = flag(f"{first[0]} <> '' AND {first[0]} = {first[1]}")
    columns = ", ".join(f"round(({v})::DOUBLE, 6) AS {k}" for k, v in out.items())
    return f"WITH {sql.SCORED} SELECT t.query_id, t.row_id, {columns} FROM top t JOIN prepared l ON l.row_id = t.query_id JOIN prepared r ON r.row_id = t.row_id"


_SORT = lambda x: f"array_to_string(list_sort({x}), ' ')"

#: Preliminary scores of all candidate pairs.
_PRELIM = f"""{sql.PAIRS},
prelim_strings AS (
  SELECT query_id, p.row_id, l.core AS lc, r.core AS rc, {_SORT('l.core_set')} AS ls, {_SORT('r.core_set')} AS rs, l.address AS la, r.address AS ra
  FROM pairs p JOIN prepared l ON l.row_id = p.query_id JOIN prepared r ON r.row_id = p.row_id
),
{sql.ratios('(SELECT ls AS a, rs AS b FROM prelim_strings)', 'names')}, {sql.set_ratios('(SELECT la AS a, ra AS b FROM prelim_strings)', 'places')},
prelim_parts AS (
  SELECT s.*, CASE WHEN lc <> '' AND rc <> '' THEN coalesce(n.r, CASE WHEN ls = rs THEN 1.0 ELSE 0.0 END) ELSE 0.0 END AS n, p.r AS a
  FROM prelim_strings s LEFT JOIN names n ON n.a = ls AND n.b = rs LEFT JOIN places p ON p.a = la AND p.b = ra
),
prelim AS (SELECT query_id, row_id, CASE WHEN la <> '' AND ra <> '' THEN 0.55 * n + 0.35 * a + 0.1 * least(n, a) ELSE 0.75 * n END::DOUBLE AS prelim FROM prelim_parts)"""


def _full_sql() -> str:
    """All 47 features of the top pairs, as floats."""
    plain = _plain_sql()
    strings = {f: (f"l.{f}", f"r.{f}") for f in pairs.FIELDS} | {f"{f}_sorted": (_SORT(f"l.{f}_set"), _SORT(f"r.{f}_set")) for f in pairs.FIELDS}
    wide = ", ".join(f"{x} AS l_{c}, {y} AS r_{c}" for c, (x, y) in strings.items())
    every = lambda names: "(" + " UNION ".join(f"SELECT l_{c} AS a, r_{c} AS b FROM wide" for c in names) + ")"
    joins, out = [], {}
    for f in pairs.FIELDS:
        for measure, source, column in (("ratio", "ratio", f), ("token_sort", "ratio", f"{f}_sorted"), ("token_set", "sets", f), ("partial", "parts", f)):
            joins.append(f"LEFT JOIN {source} {f}_{measure} ON {f}_{measure}.a = w.l_{column} AND {f}_{measure}.b = w.r_{column}")
            out[f"{f}_{measure}"] = f"CASE WHEN l_{f} = '' OR r_{f} = '' THEN 0.0 ELSE coalesce({f}_{measure}.r, 0.0) END"
        out[f"{f}_jaro"] = f"CASE WHEN l_{f} = '' OR r_{f} = '' THEN 0.0 ELSE jaro_winkler_similarity(l_{f}, r_{f}) END"
    out["unicode_name_ratio"] = out["name_ratio"]
    out["name_fuzzy_tokens"] = "fuzzy.r"
    out["name_address_min"] = f"least({out['core_token_sort']}, {out['address_token_set']})"
    out["name_address_product"] = f"({out['core_token_sort']}) * ({out['address_token_set']})"
    measured = ", ".join(f"({out[c]})::FLOAT AS {c}" if c in out else f"plain.{c}::FLOAT AS {c}" for c in pairs.FEATURES)
    with_plain = plain.replace("round((", "((").replace(")::DOUBLE, 6) AS", ")::DOUBLE) AS")
    head, tail = with_plain.split(" SELECT t.query_id", 1)
    return f"""{head},
plain AS (SELECT t.query_id{tail}),
wide AS (SELECT t.query_id, t.row_id, row_number() OVER () AS key, l.core_set AS x, r.core_set AS y, {wide} FROM top t JOIN prepared l ON l.row_id = t.query_id JOIN prepared r ON r.row_id = t.row_id),
{sql.ratios(every(strings), 'ratio')}, {sql.set_ratios(every(pairs.FIELDS), 'sets')}, {sql.partials(every(pairs.FIELDS), 'parts')}, {sql.fuzzy('wide', 'fuzzy')}
SELECT w.query_id, w.row_id, {measured} FROM wide w JOIN plain USING (query_id, row_id) JOIN fuzzy USING (key) {' '.join(joins)}"""


_RATIO = lambda name: f"SELECT p_partkey, round(CASE WHEN length(a) + length(b) = 0 THEN 1 ELSE 2 * lcs / (length(a) + length(b)) END::DOUBLE, 6) AS {name} FROM lcs"

_THREE = """
three AS (SELECT s_suppkey, list_reverse_sort([round(((s_suppkey * 7 + 13) % 97) / 100.0, 2)::DOUBLE, round(((s_suppkey * 31 + 13) % 97) / 100.0, 2)::DOUBLE, round(((s_suppkey * 53 + 13) % 97) / 100.0, 2)::DOUBLE]) AS ps FROM supplier),
worlds AS (
  SELECT s_suppkey, x, y, z, h, (CASE WHEN x = 1 THEN ps[1] ELSE 1 - ps[1] END) * (CASE WHEN y = 1 THEN ps[2] ELSE 1 - ps[2] END) * (CASE WHEN z = 1 THEN ps[3] ELSE 1 - ps[3] END)
    * (CASE WHEN h = 1 THEN 0.1 ELSE 0.9 END)::DOUBLE AS mass
  FROM three, unnest([0, 1]) AS a(x), unnest([0, 1]) AS b(y), unnest([0, 1]) AS c(z), unnest([0, 1]) AS d(h)
),
expected AS (
  SELECT s_suppkey, k, sum(mass * CASE WHEN k = 0 AND x + y + z + h = 0 THEN 1.0 WHEN k = 0 THEN 0.0
    ELSE 1.25 * (CASE WHEN k >= 1 THEN x ELSE 0 END + CASE WHEN k >= 2 THEN y ELSE 0 END + CASE WHEN k >= 3 THEN z ELSE 0 END) / (k + 0.25 * (x + y + z + h)) END::DOUBLE) AS expected
  FROM worlds, unnest([0, 1, 2, 3]) AS e(k) GROUP BY s_suppkey, k
)"""

_MATCHES = f"""{sql.SCORED},
listed AS (
  SELECT query_id, string_agg(e.entity_id, ',' ORDER BY rank) AS candidates, string_agg(e.entity_id, ',' ORDER BY rank) FILTER (WHERE p::FLOAT >= {_T}::FLOAT) AS matches
  FROM top t JOIN records e ON e.row_id = t.row_id GROUP BY query_id
),
assembled AS (
  SELECT r.row_id AS ordinal, r.entity_id, coalesce(matches, '') AS matches, coalesce(candidates, '') AS candidates
  FROM records r LEFT JOIN listed l ON l.query_id = r.row_id WHERE role = 0
)"""

_AUDIT = f"""{_MATCHES},
faulty AS (
  SELECT ordinal, entity_id, ordinal % 93 <> 0 AS whole, CASE WHEN ordinal % 51 = 0 THEN 'S1-none' ELSE entity_id END AS match_id,
    list_filter(string_split(CASE WHEN ordinal % 39 = 0 THEN 'S2-1,S2-1,S2-none' ELSE matches END, ','), lambda x: x <> '') AS m,
    list_filter(string_split(CASE WHEN ordinal % 57 = 0 THEN 'X-1' ELSE candidates END, ','), lambda x: x <> '') AS c
  FROM assembled
),
ids AS (SELECT DISTINCT ordinal, unnest(list_concat(m, c)) AS id FROM faulty WHERE whole),
violations AS (
  SELECT ordinal, 'row count mismatch' AS rule, entity_id AS detail FROM faulty WHERE NOT whole
  UNION ALL SELECT ordinal, 'source coverage or order', entity_id FROM faulty WHERE whole AND match_id <> entity_id
  UNION ALL SELECT ordinal, 'duplicate ids', entity_id FROM faulty WHERE whole AND (len(m) <> len(list_distinct(m)) OR len(c) <> len(list_distinct(c)))
  UNION ALL SELECT ordinal, 'match absent from candidates', entity_id FROM faulty WHERE whole AND len(list_filter(m, lambda x: NOT list_contains(c, x))) > 0
  UNION ALL SELECT f.ordinal, 'invalid target id', f.entity_id FROM faulty f WHERE f.ordinal IN (SELECT ordinal FROM ids WHERE NOT regexp_matches(id, '^S[23]-') OR strlen(id) > 64)
  UNION ALL SELECT ordinal, 'unknown target id', id FROM ids WHERE regexp_matches(id, '^S[23]-') AND strlen(id) <= 64 AND id NOT IN (SELECT entity_id FROM records WHERE role > 0)
)"""

_JOINED = lambda c: f"array_to_string(list_sort({c}), ' ')"

ORACLES: dict[str, str] = {
    "normalize_name": f"SELECT doc_id, md5({sql.latin('text')}) AS norm_md5 FROM documents",
    "canonical_name": f"WITH {sql.RECORDS} SELECT row_id, name, core FROM prepared",
    "expand_address": f"WITH {sql.RECORDS} SELECT row_id, address FROM prepared",
    "salient_tokens": f"WITH {sql.RECORDS} SELECT row_id, array_to_string(told, ' ') AS told FROM prepared",
    "prepared_record": f"""WITH {sql.RECORDS} SELECT row_id, name, core, address, nation, {_JOINED('name_set')} AS name_sorted, {_JOINED('core_set')} AS core_sorted,
        {_JOINED('address_set')} AS address_sorted, {_JOINED('list_distinct(runs)')} AS address_numbers, coalesce(runs[1], '') AS house,
        {_JOINED('list_filter(list_distinct(runs), lambda x: length(x) IN (5, 6))')} AS postcodes,
        array_to_string(list_transform(core_tokens, lambda t: substr(t, 1, 1)), '') AS initials FROM prepared""",
    "blocking_keys": f"WITH {sql.KEYS} SELECT row_id, key FROM keys",
    "posting_counts": f"WITH {sql.KEYS} SELECT key, count(*) AS postings FROM keys WHERE role > 0 GROUP BY key",
    "eligible_keys": f"WITH {sql.PAIRS} SELECT key, postings FROM good",
    "raw_candidates": f"WITH {sql.PAIRS} SELECT query_id, row_id FROM pairs",
    "raw_candidate_count": f"WITH {sql.PAIRS} SELECT r.row_id AS query_id, count(p.row_id) AS raw_candidates FROM records r LEFT JOIN pairs p ON p.query_id = r.row_id WHERE role = 0 GROUP BY r.row_id",
    "overlap_candidates": f"WITH {sql.SCORED} SELECT query_id, row_id, p, p2, rank FROM top",
    "stream_scored": f"WITH {sql.SCORED} SELECT query_id, row_id, p, p2, rank FROM top",
    "record_table": f"WITH {sql.RECORDS} SELECT entity_id, country, row_number() OVER (ORDER BY entity_id) - 1 AS ordinal FROM records",
    "lcs_ratio": f"WITH RECURSIVE {_PART}, {sql.lcs('part_pairs', 'p_partkey')} {_RATIO('ratio')}",
    "token_sort_ratio": f"WITH RECURSIVE {_PART}, sorted_pairs AS (SELECT p_partkey, {_SORTED('a')} AS a, {_SORTED('b')} AS b FROM part_pairs), {sql.lcs('sorted_pairs', 'p_partkey')} {_RATIO('ratio')}",
    "jaro_winkler": f"WITH {_PART} SELECT p_partkey, round(jaro_winkler_similarity(a, b), 6) AS jaro_winkler FROM part_pairs",
    "token_overlap": f"WITH {_PART}, sets AS (SELECT p_partkey, {_SET('a')} AS x, {_SET('b')} AS y FROM part_pairs) SELECT p_partkey, round({sql._overlap('x', 'y')[0]}, 6) AS jaccard, round({sql._overlap('x', 'y')[1]}, 6) AS containment FROM sets",
    "pair_features_core": _plain_sql(),
    "pair_features_full": _full_sql(),
    "preliminary_similarity": f"WITH {_PRELIM} SELECT query_id, row_id, round(prelim, 6) AS prelim FROM prelim",
    "topk_candidates": f"""WITH {_PRELIM} SELECT query_id, row_id, round(prelim, 6) AS prelim, rank::INT AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY prelim DESC, row_id DESC) AS rank FROM prelim) WHERE rank <= 32""",
    "token_set_ratio": f"WITH {_PART}, {sql.set_ratios('part_pairs', 'z')} SELECT p_partkey, round(r, 6) AS ratio FROM part_pairs p JOIN z ON z.a = p.a AND z.b = p.b",
    "partial_ratio": f"WITH {_PART}, {sql.partials('part_pairs', 'z')} SELECT p_partkey, round(r, 6) AS ratio FROM part_pairs p JOIN z ON z.a = p.a AND z.b = p.b",
    "fuzzy_tokens": f"""WITH {_PART}, sets AS (SELECT p_partkey AS key, list_distinct({sql.tokens('a')}) AS x, list_distinct({sql.tokens('b')}) AS y FROM part_pairs), {sql.fuzzy('sets', 'z')}
        SELECT key AS p_partkey, round(r, 6) AS fuzzy FROM z""",
    "labelled_pairs": f"WITH {sql.SCORED} SELECT query_id, row_id, match::INT AS label FROM marked",
    "query_f05": f"WITH {sql.SCORED}, {sql.per_query(_T)} SELECT query_id, n_true, n_predicted, n_hits, n_found, round(f05, 6) AS f05 FROM per_query",
    "macro_f05": f"WITH {sql.SCORED}, {sql.per_query(_T)} SELECT round(avg(f05), 6) AS macro_f05 FROM per_query",
    "metric_report": f"WITH {sql.SCORED}, {sql.per_query(_T)} SELECT {sql.REPORT} FROM per_query",
    "metric_by_country": f"WITH {sql.SCORED}, {sql.per_query(_T)} SELECT country, {sql.REPORT} FROM per_query GROUP BY country",
    "threshold_curve": f"WITH {sql.SCORED}, {sql.curve(metrics.CALIBRATION_GRID, (0.0,))} SELECT threshold, round(macro_f05, 6) AS macro_f05 FROM curve",
    "calibrated_threshold": f"WITH {sql.SCORED}, {sql.curve(metrics.CALIBRATION_GRID, (0.0,))} SELECT threshold, round(macro_f05, 6) AS macro_f05 FROM curve ORDER BY round(curve.macro_f05, 12) DESC, threshold LIMIT 1",
    "blend_sweep": f"WITH {sql.SCORED}, {sql.curve(metrics.SWEEP_GRID, metrics.WEIGHTS)} SELECT weight, threshold, round(macro_f05, 6) AS macro_f05 FROM curve",
    "blend_choice": f"WITH {sql.SCORED}, {sql.curve(metrics.SWEEP_GRID, metrics.WEIGHTS)} SELECT weight, threshold, round(macro_f05, 6) AS macro_f05 FROM curve ORDER BY round(curve.macro_f05, 12) DESC, threshold DESC, weight LIMIT 1",
    "sample_split": f"""WITH {sql.RECORDS}, drawn AS (SELECT entity_id, md5('20260925|' || entity_id) AS draw FROM records WHERE role = 0 ORDER BY draw, entity_id LIMIT 200),
        placed AS (SELECT entity_id, row_number() OVER (ORDER BY draw, entity_id) - 1 AS position, count(*) OVER () AS n FROM drawn)
        SELECT entity_id, position, CASE WHEN position < n * 7 // 10 THEN 'fit' WHEN position < n * 85 // 100 THEN 'tune' ELSE 'holdout' END AS split FROM placed""",
    "source_profile": f"""WITH {sql.RECORDS} SELECT country AS country_group, count(*) AS n_rows, count(DISTINCT entity_id) AS unique_ids, count(*) FILTER (WHERE business_name = '') AS missing_business_name,
        count(*) FILTER (WHERE business_address = '') AS missing_business_address, count(*) FILTER (WHERE country = '') AS missing_country FROM records GROUP BY ROLLUP (country)""",
    "truth_cardinality": f"""WITH {sql.SCORED} SELECT matches, count(*) AS n_queries FROM (SELECT r.row_id, count(t.row_id) AS matches FROM records r LEFT JOIN truth t ON t.query_id = r.row_id WHERE role = 0 GROUP BY r.row_id) GROUP BY matches""",
    "noise_profile": f"""WITH {sql.SCORED}, links AS (SELECT query_id, row_id FROM truth UNION SELECT query_id, row_id FROM pairs),
        both_sides AS (SELECT l.business_name = r.business_name AS n, l.business_address = r.business_address AS a, l.business_address = '' OR r.business_address = '' AS blank
          FROM links t JOIN records l ON l.row_id = t.query_id JOIN records r ON r.row_id = t.row_id)
        SELECT count(*) AS positive_pairs, count(*) FILTER (WHERE n AND a) AS exact_both, count(*) FILTER (WHERE n AND NOT a) AS name_only, count(*) FILTER (WHERE NOT n AND a) AS address_only,
        count(*) FILTER (WHERE NOT n AND NOT a) AS neither, count(*) FILTER (WHERE blank) AS missing_address FROM both_sides""",
    "resolve_exclusive": f"""WITH {sql.SCORED}, ranked AS (SELECT query_id, row_id, p, row_number() OVER w AS n, lead(p) OVER w AS second FROM top WINDOW w AS (PARTITION BY row_id ORDER BY p DESC))
        SELECT query_id, row_id, p FROM ranked WHERE n = 1 AND (second IS NULL OR p - second > 0.01)""",
    "exclusive_scores": f"""WITH {sql.SCORED}, ranked AS (SELECT query_id, row_id, p, row_number() OVER w AS n, lead(p) OVER w AS second FROM top WHERE p::FLOAT >= {_T}::FLOAT WINDOW w AS (PARTITION BY row_id ORDER BY p DESC)),
        owners AS (SELECT query_id, row_id, p AS kept FROM ranked WHERE n = 1 AND (second IS NULL OR p > second))
        SELECT t.query_id, t.row_id, coalesce(kept, 0.0) AS p FROM top t LEFT JOIN owners o ON t.query_id = o.query_id AND t.row_id = o.row_id""",
    "owner_conflicts": f"WITH {sql.SCORED} SELECT count(*) AS eligible, count(DISTINCT row_id) AS targets, count(*) - count(DISTINCT row_id) AS conflicts FROM top WHERE p::FLOAT >= {_T}::FLOAT",
    "expected_f05": f"WITH {_THREE} SELECT s_suppkey, k::BIGINT AS k, round(expected, 6) AS expected FROM expected",
    "choose_prefix": f"WITH {_THREE} SELECT s_suppkey, k::BIGINT AS selected, round(expected, 6) AS expected FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY round(expected, 12) DESC, k) AS n FROM expected) WHERE n = 1",
    "assembled_matches": f"WITH {_MATCHES} SELECT ordinal, entity_id AS source1_entity_id, matches AS matched_entity_ids FROM assembled",
    "assembled_candidates": f"WITH {_MATCHES} SELECT ordinal, entity_id AS source1_entity_id, candidates AS candidate_entity_ids FROM assembled",
    "audit_violations": f"WITH {_AUDIT} SELECT ordinal, rule, detail FROM violations",
    "audit_summary": f"""WITH {_AUDIT} SELECT count(*) FILTER (WHERE whole) AS s1, count(*) FILTER (WHERE whole) AS matching, count(*) FILTER (WHERE whole) AS candidate,
        coalesce(sum(len(m)) FILTER (WHERE whole), 0)::BIGINT AS matched_ids, coalesce(sum(len(c)) FILTER (WHERE whole), 0)::BIGINT AS candidate_ids,
        (SELECT count(*) FROM violations) AS n_violations, (SELECT count(*) FROM violations) = 0 AS ok FROM faulty""",
}

QUERIES = {
    f.__name__: f
    for f in (
        normalize_name, canonical_name, expand_address, salient_tokens, prepared_record, blocking_keys, posting_counts, eligible_keys, raw_candidates,
        raw_candidate_count, overlap_candidates, preliminary_similarity, topk_candidates, token_overlap, fuzzy_tokens, pair_features_core,
        pair_features_full, labelled_pairs, query_f05, macro_f05, metric_report, metric_by_country, threshold_curve, calibrated_threshold, blend_sweep,
        blend_choice, sample_split, source_profile, truth_cardinality, noise_profile, resolve_exclusive, exclusive_scores, owner_conflicts, expected_f05,
        choose_prefix, assembled_matches, assembled_candidates, audit_violations, audit_summary, gbt_scores, feature_importance, country_transfer,
        stream_scored, record_table,
    )
}
QUERIES |= {
    "lcs_ratio": _strings("ratio", S.ratio_col),
    "token_sort_ratio": _strings("ratio", lambda a, b: S.ratio_col(F.array_join(F.array_sort(F.array_distinct(tokens(a))), " "), F.array_join(F.array_sort(F.array_distinct(tokens(b))), " "))),
    "token_set_ratio": _strings("ratio", S.token_set_col),
    "partial_ratio": _strings("ratio", S.partial_col),
    "jaro_winkler": _strings("jaro_winkler", S.jaro_winkler_col),
}
