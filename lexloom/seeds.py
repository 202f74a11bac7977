"""The seed concepts that topic extraction starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.providers import Embed, embed_texts

# Labels of the seed concepts.
SEEDS = (
    "lawfulness fairness and transparency of processing",
    "purpose limitation principle",
    "data minimisation principle",
    "data accuracy obligation",
    "storage limitation principle",
    "integrity and confidentiality of processing",
    "accountability principle",
    "lawfulness of processing",
    "consent as legal basis",
    "legitimate interest assessment",
    "processing of special category data",
    "processing of criminal offence data",
    "right of access by the data subject",
    "right to rectification",
    "right to erasure",
    "right to restriction of processing",
    "right to data portability",
    "right to object to processing",
    "automated individual decision-making and profiling",
    "transparent information and communication",
    "controller responsibility and accountability",
    "data protection by design and by default",
    "joint controller arrangement",
    "processor obligation and contract",
    "records of processing activities",
    "security of processing",
    "personal data breach notification",
    "communication of breach to data subject",
    "data protection impact assessment",
    "prior consultation with supervisory authority",
    "data protection officer designation",
    "data protection officer tasks and independence",
    "international data transfer safeguard",
    "adequacy decision for data transfer",
    "standard contractual clauses for transfer",
    "binding corporate rules",
    "transfer impact assessment",
    "supervisory authority powers and tasks",
    "lead supervisory authority and one-stop-shop",
    "right to judicial remedy",
    "right to compensation for data protection violation",
    "administrative fine and penalty",
    "cross-border processing cooperation",
    "prohibited artificial intelligence practice",
    "high-risk AI system classification",
    "AI risk management system",
    "high-risk AI data governance requirement",
    "high-risk AI technical documentation",
    "high-risk AI transparency requirement",
    "high-risk AI human oversight",
    "high-risk AI accuracy robustness and cybersecurity",
    "AI conformity assessment procedure",
    "AI post-market monitoring obligation",
    "AI provider obligation",
    "AI deployer obligation",
    "AI importer and distributor obligation",
    "general-purpose AI model obligation",
    "general-purpose AI systemic risk",
    "AI regulatory sandbox",
    "real-world AI testing condition",
    "AI literacy obligation",
    "CE marking for AI system",
    "notified body for AI conformity",
    "biometric identification and categorisation",
    "emotion recognition system",
    "AI in critical infrastructure",
    "AI in law enforcement context",
    "AI in migration and border control",
    "AI in administration of justice",
    "AI in employment and worker management",
    "AI in education and vocational training",
    "data access right for connected product user",
    "data holder obligation under Data Act",
    "data recipient obligation and use limitation",
    "data sharing for connected product and service",
    "unfair contractual term in data sharing",
    "trade secret protection in data access",
    "IoT data and connected device",
    "cloud switching and interoperability",
    "data made available to public sector body",
    "smart contract for data sharing",
    "re-use of protected public sector data",
    "data intermediation service provision",
    "data altruism organisation and registration",
    "data cooperative governance",
    "European data innovation board",
    "consent and permission management for data sharing",
    "single information point for data re-use",
    "competent body for data re-use assistance",
    "fundamental rights impact assessment",
    "market surveillance for regulated product",
    "harmonised standard and standardisation",
    "incident reporting obligation",
    "redress and complaint mechanism",
    "auditability and traceability requirement",
    "certification and code of conduct",
)


def seed_concepts(spark: SparkSession, embed: Embed, labels: tuple[str, ...] = SEEDS) -> DataFrame:
    """label, embedding, terms, active, generation: every seed is its own first term."""
    rows = spark.createDataFrame([(s,) for s in labels], "label string")
    return rows.select("label", embed_texts(F.col("label"), embed).alias("embedding"), F.array("label").alias("terms"), F.lit(True).alias("active"), F.lit(0).alias("generation"))


def topic_vectors(topics: DataFrame, embed: Embed) -> DataFrame:
    """label, embedding of the distinct topic labels, cached: topics are embedded once a session."""
    return topics.select("label").where("label is not null").distinct().withColumn("embedding", embed_texts(F.col("label"), embed)).cache()
