"""Evidence cards by claim, and how detectors corroborate what texts say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ceilings of confidence by a source's trust, of text with detectors, and with a passed benchmark too.
TRUST_CAPS = {
    "social_context": 0.40,
    "news_context": 0.55,
    "agency_report": 0.70,
    "official_policy": 0.70,
    "peer_reviewed": 0.80,
    "project_internal": 0.70,
    "expert_opinion": 0.40,
    "llm_suggestion": 0.40,
    "measurement": 0.85,
}
WITH_DETECTOR, WITH_BENCHMARK = 0.90, 0.95
#: Claims that need a detector, claims without that need, and the detector issues that can back either.
NEEDS_DETECTOR = ("bottleneck_location", "incident_report", "capacity_claim", "reliability_claim", "VHD_claim")
OTHER_CLAIMS = ("corridor_context", "work_zone_report", "HCM_facility_claim", "teaching_misunderstanding", "software_bug", "documentation_gap")
BACKING = ("recurring_bottleneck", "unreliable_segment_lottr")


def register_sources(sources: DataFrame) -> DataFrame:
    """Sources (name, kind, trust_level) with an id that follows from name and kind, the same in every process. Only
    measurements can validate an issue; every source can raise one."""
    df = sources.withColumn("source_id", F.concat(F.lit("SRC-"), F.lower(F.hex(F.xxhash64("kind", "name")))))
    return df.withColumns({"can_create_issue": F.lit(True), "can_validate_issue": F.col("trust_level") == "measurement"}) if "trust_level" in sources.columns else df


def make_cards(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Evidence cards of claims (source_id, claim_text, claim_type, corridor): the cap of the source's trust, the prior
    below it, and whether the claim needs a detector. Claims of unknown kinds or sources are left out."""
    cap = F.create_map(*[F.lit(x) for kv in TRUST_CAPS.items() for x in kv])
    df = claims.where(F.col("claim_type").isin(*NEEDS_DETECTOR, *OTHER_CLAIMS)).join(sources.select("source_id", F.col("kind").alias("source_type"), "trust_level"), "source_id")
    df = df.withColumn("confidence_cap", F.try_element_at(cap, F.col("trust_level"))).where("confidence_cap is not null")
    return df.withColumns(
        {
            "evidence_id": F.concat(F.lit("EV-"), F.lower(F.hex(F.xxhash64("source_id", "claim_text")))),
            "confidence_prior": F.bround(F.least(0.9 * F.col("confidence_cap") + 0.05, F.col("confidence_cap")), 2),
            "requires_detector": F.col("claim_type").isin(*NEEDS_DETECTOR),
        }
    )


def _plain(corridor: Column) -> Column:
    return F.upper(F.replace(F.coalesce(corridor, F.lit("")), F.lit("-"), F.lit("")))


def _parts(name: Column) -> Column:
    """All substrings of a corridor's name, so that 'contains' is an equi-join; names are short."""
    n = F.length(name)
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: name.substr(i, k)))))


def _backing(detector_issues: DataFrame) -> DataFrame:
    """key, hit: the first detector issue, by its id, whose corridor's name contains the key."""
    d = detector_issues.where(F.col("type").isin(*BACKING)).withColumn("name", _plain(F.col("corridor"))).where("name <> ''")
    hit = F.struct("issue_id", F.col("type").alias("kind"), "confidence")
    return d.select(F.explode(_parts(F.col("name"))).alias("key"), hit.alias("hit")).groupBy("key").agg(F.min("hit").alias("hit"))


def corroborate(text_issues: DataFrame, detector_issues: DataFrame) -> DataFrame:
    """Text issues with the first detector issue (issue_id, type, corridor, confidence) of a recurring bottleneck or an
    unreliable segment whose corridor's name, without dashes and case, contains theirs. Reports of congestion gain 0.15
    (0.90 at most); other kinds are cross-referenced only; the rest needs a check by detectors."""
    df = text_issues.withColumn("key", _plain(F.col("corridor"))).join(_backing(detector_issues), "key", "left")
    seen, congestion = F.col("hit").isNotNull(), F.col("type").isin("recurring_congestion_report", "capacity_event_report")
    raised = F.when(seen & congestion, F.bround(F.least(F.col("confidence") + 0.15, F.lit(WITH_DETECTOR)), 2)).otherwise(F.col("confidence"))
    return df.withColumns({"confidence": raised, "corroborates": F.col("hit.issue_id"), "needs_detector_check": ~seen}).drop("key", "hit")


def compile_evidence(cards: DataFrame, detector_issues: DataFrame | None = None, benchmark_pass: bool = False, start_id: int = 800) -> DataFrame:
    """One issue for each corridor (GLOBAL where none) and claim, numbered in their order.

    Without a detector: the highest prior, under the highest cap. Where a detector issue's corridor contains the name, or
    is contained in it: 0.1 over the higher of prior and detector, under the cap of text with detectors (with a passed
    benchmark, the one for that), and it goes to the planner's review. Issues are few: kinds of claims by corridors.
    """
    g = cards.groupBy(F.coalesce("corridor", F.lit("GLOBAL")).alias("corridor"), "claim_type").agg(
        F.max("confidence_prior").alias("prior"), F.max("confidence_cap").alias("cap"), F.bool_or("requires_detector").alias("needs"), F.count(F.lit(1)).alias("n_cards"), F.countDistinct("source_id").alias("n_sources"), F.sort_array(F.collect_set("evidence_id")).alias("evidence")
    )
    if detector_issues is None:
        g = g.withColumn("hit", F.lit(None).cast("struct<issue_id:string,kind:string,confidence:double>"))
    else:
        d = detector_issues.where(F.col("type").isin(*BACKING)).withColumn("key", _plain(F.col("corridor"))).where("key <> ''").groupBy("key").agg(F.min(F.struct("issue_id", F.col("type").alias("kind"), "confidence")).alias("whole"))
        named = g.withColumn("key", F.when(F.col("corridor") != "GLOBAL", _plain(F.col("corridor")))).withColumn("id", F.struct("corridor", "claim_type"))
        inner = named.where("key <> ''").select("id", F.explode(_parts(F.col("key"))).alias("key")).join(d, "key").groupBy("id").agg(F.min("whole").alias("whole"))
        g = named.join(_backing(detector_issues), "key", "left").join(inner, "id", "left").withColumn("hit", F.least("hit", "whole")).drop("id", "key", "whole")
    seen = F.col("hit").isNotNull()
    lifted = F.bround(F.least(F.lit(WITH_BENCHMARK if benchmark_pass else WITH_DETECTOR), F.greatest("prior", F.coalesce("hit.confidence", F.lit(0.0))) + 0.1), 2)
    return g.select(
        F.format_string("RAG-%03d", F.row_number().over(W.orderBy("corridor", "claim_type")) + (start_id - 1)).alias("issue_id"),
        F.when(F.col("corridor") != "GLOBAL", F.col("corridor")).alias("corridor"),
        F.col("claim_type").alias("type"),
        F.when(seen, lifted).otherwise(F.bround(F.least("prior", "cap"), 2)).alias("confidence"),
        F.when(seen, "medium").otherwise("low").alias("severity"),
        "n_cards",
        "n_sources",
        F.when(seen, F.array_append("evidence", F.col("hit.issue_id"))).otherwise(F.col("evidence")).alias("evidence"),
        (~seen & F.col("needs")).alias("needs_detector_check"),
        F.when(seen, "needs_planner_review").otherwise("open").alias("status"),
        F.when(seen, F.array(F.lit("COMPARE_WITH_BENCHMARK"), F.lit("GENERATE_CORRIDOR_DASHBOARD"))).otherwise(F.array(F.lit("CROSS_CHECK_WITH_DETECTOR_CBI"))).alias("recommended_token"),
    )
