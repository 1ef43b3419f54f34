"""Safety assessment of all consultations at once: interactions with active medicines, and diseases of resolved conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidara.functions import ordinal, text
from evidara.operators.dedup import first_wins
from evidara.operators.joins import union_equi_join
from evidara.sources.files import looked_up, shuffled, written


# The sources of knowledge that assessments are made of.
PAIRS_SOURCE, DISEASES_SOURCE = "DDInter 2.0", "DrugCentral"


def of_source(knowledge: DataFrame, source: str | None) -> DataFrame:
    """The rows of one source, or all of them if none is named."""
    return knowledge if source is None else knowledge.where(F.col("source") == source)


def pair_evidence(proposals: DataFrame, generics: DataFrame, knowledge: DataFrame, more: tuple[str, ...] = (), source: str | None = PAIRS_SOURCE) -> DataFrame:
    """Rows (proposed, generic, a, b, severity) and more columns of knowledge: the best evidence for each two names that have some.

    proposals: proposed; generics: generic; both are names as entered, which may repeat. Combinations are taken ingredient by
    ingredient; of evidence the highest severity wins, then the newest. Names meet through the knowledge of
    their terms, so there are at most as many rows as it has for them, however many records have the names.
    """
    p = proposals.select("proposed").distinct().select("proposed", F.explode(text.ingredient_terms("proposed")).alias("x"))
    g = generics.select("generic").distinct().select("generic", F.explode(text.ingredient_terms("generic")).alias("y"))
    known = of_source(knowledge, source).where("a <> b").select("a", "b", "severity", "imported_at", "id", *more)
    ways = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("way")
    met = p.join(known.select("*", ways).select("*", "way.x", "way.y").drop("way"), "x").join(g, "y")
    order = [ordinal.rank("severity", ordinal.SEVERITY).desc(), F.col("imported_at").desc_nulls_last(), F.col("id").asc()]
    return looked_up(first_wins(met, ["proposed", "generic"], order).select("proposed", "generic", "a", "b", "severity", *more), "evidence")


def active_of(medicines: DataFrame) -> DataFrame:
    return medicines.where("status = 'ACTIVE'").select("consultation", "medicine", "generic")


def interactions(consultations: DataFrame, medicines: DataFrame, knowledge: DataFrame, more: tuple[str, ...] = (), source: str | None = PAIRS_SOURCE) -> DataFrame:
    """The best evidence for each active medicine: rows (consultation, medicine, a, b, severity) and more columns of knowledge.

    consultations: consultation, proposed. medicines: consultation, medicine, generic, status. knowledge: a, b (normalised,
    a < b), severity, imported_at, id, source. A medicine that is entered twice has two findings.
    """
    active = active_of(medicines)
    best = pair_evidence(consultations, active, knowledge, more, source)
    met = shuffled(consultations.select("consultation", "proposed")).join(active, "consultation").join(best, ["proposed", "generic"])
    return met.select("consultation", "medicine", "a", "b", "severity", *more)


# How a condition matched its knowledge, by the first that holds.
MATCHES = ("UMLS_IDENTIFIER", "DRUGCENTRAL_IDENTIFIER", "CANONICAL_TERM", "SNOMED_SOURCE_ALIAS", "CONCEPT_SOURCE_ALIAS")


def resolutions(conditions: DataFrame, knowledge: DataFrame, source: str | None = DISEASES_SOURCE, keep: tuple[str, ...] = (), named: bool = False) -> DataFrame:
    """Each active condition with identity, resolution, match_type and the id of the knowledge that says so.

    keep: columns of conditions that stay; named: with resolved, how that knowledge shows the disease (its column shown).
    conditions: condition, display, code. knowledge: id, identity, disease, concept, snomed (normalised), cui, imported_at, source. A condition
    is RESOLVED if exactly one identity matches by name, alias or code, AMBIGUOUS with more, UNRESOLVED with none; rows
    of knowledge without an identity say nothing. The match is named by the newest row of the identity.
    """
    texts = {"entered": text.term("display"), "code_cui": text.concept_code("code"), "code_identity": text.local_code("code")}
    asked = conditions.select("condition", *keep, F.to_json(F.struct(*[v.alias(k) for k, v in texts.items()])).alias("ask"), *[v.alias(k) for k, v in texts.items()])
    # Each different text is resolved once, however many records have it.
    distinct, _ = written(asked.drop("condition", *keep).distinct(), "asked")
    known = of_source(knowledge, source).where(text.first_filled("identity").isNotNull()).select("id", "identity", "disease", "concept", "snomed", "cui", "imported_at", *["shown"] * named)
    met = union_equi_join(distinct, known, [("entered", "disease"), ("entered", "concept"), ("entered", "snomed"), ("code_cui", "cui"), ("code_identity", "identity")], "ask", "id")
    tests = (F.col("code_cui") == F.col("cui"), F.col("code_identity") == F.col("identity"), F.col("disease") == F.col("entered"), F.col("snomed") == F.col("entered"))
    match = F.coalesce(*[F.when(t, name) for t, name in zip(tests, MATCHES, strict=False)], F.lit(MATCHES[-1]))
    # One aggregate: the identities' number, and of their rows the newest, the one of the largest id among equals.
    newest = F.max(F.struct("imported_at", "id", "identity", match.alias("match_type"), *["shown"] * named)).alias("newest")
    one = met.groupBy("ask").agg(F.count_distinct("identity").alias("n"), newest).where("n > 0")
    # Conditions meet what is known of their text in place: a text that very many records have is dealt to no task.
    out = asked.select("condition", *keep, "ask").join(looked_up(one, "resolved"), "ask", "left")
    n = F.coalesce("n", F.lit(0))
    status = F.when(n == 1, "RESOLVED").when(n == 0, "UNRESOLVED").otherwise("AMBIGUOUS")
    held = {"identity": "newest.identity", "match_type": "newest.match_type", "knowledge_id": "newest.id"} | ({"resolved": "newest.shown"} if named else {})
    return out.select("condition", *keep, status.alias("resolution"), *[F.when(n == 1, F.col(v)).alias(k) for k, v in held.items()])


DISEASE_DETAILS = ("assessment", "relationship", "evidence", "source", "version", "cui", "snomed_shown", "shown", "generic")


def disease_findings(consultations: DataFrame, conditions: DataFrame, knowledge: DataFrame, more: tuple[str, ...] = (), source: str | None = DISEASES_SOURCE) -> DataFrame:
    """Rows (consultation, condition, identity, match_type, assessment) and more columns of knowledge: what is known of the proposed drug on each resolved condition.

    conditions: condition, consultation, display, code. The whole proposed name is normalised; it is
    neither split nor replaced by synonyms here.
    """
    resolved = resolutions(conditions, knowledge, source, ("consultation",)).where("resolution = 'RESOLVED'")
    return drug_findings(consultations.select("consultation", text.term("proposed").alias("drug")), resolved, knowledge, more, source)


def drug_findings(drugs: DataFrame, resolved: DataFrame, knowledge: DataFrame, more: tuple[str, ...] = (), source: str | None = DISEASES_SOURCE) -> DataFrame:
    """What is known of each of drugs (consultation, drug: normalised, ...) on the resolved conditions of its consultation."""
    known = of_source(knowledge, source).select("drug", "identity", "assessment", *[c for c in more if c != "assessment"])
    kept = [c for c in drugs.columns if c not in ("consultation", "drug")]
    return shuffled(drugs).join(resolved, "consultation").join(looked_up(known, "diseases"), ["drug", "identity"]).select("consultation", *kept, "condition", "identity", "match_type", "assessment", *[c for c in more if c != "assessment"])


def rolled_up(consultations: DataFrame, met: DataFrame, found: DataFrame, keys: tuple[str, ...] = ("consultation",)) -> DataFrame:
    """One row for each of keys: severity, assessment, overall, numbers of findings and data status."""
    keys = list(keys)
    s = met.groupBy(*keys).agg(ordinal.highest("severity", ordinal.SEVERITY).alias("s"), F.count("*").alias("n_s"))
    a = found.groupBy(*keys).agg(ordinal.highest("assessment", ordinal.ASSESSMENT).alias("a"), F.count("*").alias("n_a"))
    out = consultations.select(*keys).join(s, keys, "left").join(a, keys, "left")
    out = out.withColumns({"s": F.coalesce("s", F.lit("NOT_EVALUATED")), "a": F.coalesce("a", F.lit("NOT_EVALUATED")), "n_s": F.coalesce("n_s", F.lit(0)), "n_a": F.coalesce("n_a", F.lit(0))})
    matched = F.when(F.col("n_s") + F.col("n_a") > 0, "DATASET_MATCHED").otherwise("NO_DATASET_MATCH")
    return out.select(*keys, F.col("s").alias("severity"), F.col("a").alias("assessment"), ordinal.overall("s", "a").alias("overall"), F.col("n_s").alias("n_interactions"), F.col("n_a").alias("n_diseases"), matched.alias("data_status"))


def assess(consultations: DataFrame, medicines: DataFrame, conditions: DataFrame, pair_knowledge: DataFrame, disease_knowledge: DataFrame) -> DataFrame:
    """The assessment of each consultation. Allergies aren't an input."""
    return rolled_up(consultations, interactions(consultations, medicines, pair_knowledge), disease_findings(consultations, conditions, disease_knowledge))


# The sentences of an assessment.
NO_MEDICINES = "No active medicines were available for a DDInter 2.0 check."
NO_CONDITIONS = "No active patient conditions were available for a DrugCentral drug-disease check."
NO_RELATIONSHIP = ", but no DrugCentral relationship was found for the proposed drug."
NOT_RESOLVED = " could not be deterministically resolved to a DrugCentral disease identity; no relationship was claimed."


def evaluated_pairs(consultations: DataFrame, medicines: DataFrame) -> DataFrame:
    """Rows (consultation, medicine, proposed, generic, proposed_terms, existing_terms): what is looked up for each active medicine."""
    met = shuffled(consultations.select("consultation", "proposed")).join(active_of(medicines), "consultation")
    return met.withColumns({"proposed_terms": text.ingredient_terms("proposed"), "existing_terms": text.ingredient_terms("generic")})


def explanations(consultations: DataFrame, medicines: DataFrame, conditions: DataFrame, pair_knowledge: DataFrame, disease_knowledge: DataFrame) -> DataFrame:
    """Rows (consultation, part, subject, explanation): a sentence a finding; without findings one for all that was looked up; else that nothing was.

    pair_knowledge has drug_a, drug_b, raw_severity and source besides; disease_knowledge has shown (the disease as its
    source names it), relationship, source and version. subject is the medicine or the condition. Medicines and conditions
    are dealt once, by consultation, and meet what is known of their names in place.
    """
    own = consultations.select("consultation", "proposed")
    active = active_of(medicines)
    terms = lambda df, name, to: looked_up(df.select(name).distinct().select(name, F.array_join(text.ingredient_terms(name), " / ").alias(to)), "terms")
    best = pair_evidence(own, active, pair_knowledge, ("drug_a", "drug_b", "raw_severity", "source"))
    of_one = Window.partitionBy("consultation")
    # Each pair that is looked up, with its evidence, if any, and whether the consultation has evidence at all; a row without a medicine for one that has none.
    looked = shuffled(own).join(active.withColumn("active", F.lit(True)), "consultation", "left").join(best, ["proposed", "generic"], "left")
    looked = looked.withColumn("any", F.bool_or(F.col("drug_a").isNotNull()).over(of_one)).where("drug_a is not null or not any")
    looked = looked.join(terms(own, "proposed", "p"), "proposed", "left").join(terms(active, "generic", "g"), "generic", "left")
    said = F.concat("drug_a", F.lit(" + "), "drug_b", F.lit(": "), "raw_severity", F.lit(" ("), "source", F.lit(")."))
    unfound = F.concat(F.lit(f"No {PAIRS_SOURCE} record for "), F.coalesce("p", F.lit("")), F.lit(" + "), F.coalesce("g", F.lit("")), F.lit("."))
    drugs = looked.select("consultation", "medicine", F.when(F.col("active").isNull(), F.lit(NO_MEDICINES)).when(F.col("drug_a").isNotNull(), said).otherwise(unfound))
    told = resolutions(conditions, disease_knowledge, keep=("consultation", "display"), named=True).withColumnRenamed("resolved", "shown")
    known = of_source(disease_knowledge, DISEASES_SOURCE).select("drug", "identity", "assessment", "relationship", "source", "version", F.lit(True).alias("held"))
    # The same of conditions: rows of resolved ones without an identity meet nothing.
    asked = shuffled(own.select("consultation", text.term("proposed").alias("drug"))).join(told.withColumn("active", F.lit(True)), "consultation", "left")
    asked = asked.join(looked_up(known, "diseases"), ["drug", "identity"], "left").withColumn("any", F.bool_or(F.col("held").isNotNull()).over(of_one)).where("held is not null or not any")
    entered = F.concat(F.lit("Entered condition: "), "display")
    resolved = F.concat(entered, F.lit(" → resolved DrugCentral term: "), "shown", F.lit(" ("), "identity", F.lit(")"))
    found = F.concat(resolved, F.lit(" → DrugCentral relationship: "), "relationship", F.lit(" → assessment: "), "assessment", F.lit(". Source: "), "source", F.lit(" "), "version", F.lit("."))
    silent = F.when(F.col("resolution") == "RESOLVED", F.concat(resolved, F.lit(NO_RELATIONSHIP))).otherwise(F.concat(entered, F.lit(NOT_RESOLVED)))
    ill = asked.select("consultation", "condition", F.when(F.col("active").isNull(), F.lit(NO_CONDITIONS)).when(F.col("held").isNotNull(), found).otherwise(silent))
    part = lambda df, name: df.toDF("consultation", "subject", "explanation").select("consultation", F.lit(name).alias("part"), F.col("subject").cast("string").alias("subject"), "explanation")
    return part(drugs, "drugs").union(part(ill, "diseases"))


PAIR_DETAILS = ("drug_a", "drug_b", "raw_severity", "source", "version", "id_a", "id_b")


def pair_findings(consultations: DataFrame, medicines: DataFrame, pair_knowledge: DataFrame) -> DataFrame:
    """Whole interaction findings: rows (consultation, medicine, proposed, generic, severity, PAIR_DETAILS, matched_proposed, matched_existing).

    The evidence as its source has it, and the ingredients that were looked up of both drugs.
    """
    active = active_of(medicines)
    best = pair_evidence(consultations, active, pair_knowledge, PAIR_DETAILS)
    best = best.withColumns({"matched_proposed": text.ingredient_terms("proposed"), "matched_existing": text.ingredient_terms("generic")})
    met = shuffled(consultations.select("consultation", "proposed")).join(active, "consultation").join(best, ["proposed", "generic"])
    return met.select("consultation", "medicine", "proposed", "generic", "severity", *PAIR_DETAILS, "matched_proposed", "matched_existing")


def illness_findings(consultations: DataFrame, conditions: DataFrame, disease_knowledge: DataFrame) -> DataFrame:
    """Whole disease findings: rows (consultation, condition, entered, code, match_type, resolved, identity, proposed, DISEASE_DETAILS).

    disease_knowledge has, besides what is matched on, generic (the drug as its source names it), shown and snomed_shown
    (the disease's names), relationship, evidence, source and version. resolved is the name in the row that the
    condition was resolved by, shown the one in the row of the finding.
    """
    told = resolutions(conditions, disease_knowledge, keep=("consultation", "display", "code"), named=True).where("resolution = 'RESOLVED'")
    resolved = told.select("consultation", "condition", F.col("display").alias("entered"), "code", "match_type", "resolved", "identity")
    known = of_source(disease_knowledge, DISEASES_SOURCE).select("drug", "identity", *DISEASE_DETAILS)
    asked = consultations.select("consultation", "proposed", text.term("proposed").alias("drug"))
    return shuffled(asked).join(resolved, "consultation").join(looked_up(known, "diseases"), ["drug", "identity"]).drop("drug")


def findings(consultations: DataFrame, medicines: DataFrame, conditions: DataFrame, pair_knowledge: DataFrame, disease_knowledge: DataFrame) -> DataFrame:
    """Rows (consultation, kind, subject, detail, level): all findings that an assessment rests on."""
    met = interactions(consultations, medicines, pair_knowledge)
    ill = disease_findings(consultations, conditions, disease_knowledge)
    drugs = met.select("consultation", F.lit("interaction").alias("kind"), F.col("medicine").cast("string").alias("subject"), F.concat_ws(" + ", "a", "b").alias("detail"), F.col("severity").alias("level"))
    return drugs.union(ill.select("consultation", F.lit("disease"), F.col("condition").cast("string"), "identity", "assessment"))
