"""Profiles, terms and phrase sets: small tables that are validated on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import PROFILE, TERM

# Phrases that decide the prefilter.
BROAD_SIGNALS = [
    "ai", "artificial intelligence", "agent", "ai alignment", "ai safety", "ai slowdown", "catastrophic risk", "existential risk",
    "extinction risk", "foundation model", "generative", "llm", "machine learning", "model", "multimodal", "new model",
    "model release", "new generation", "frontier model", "open weights", "api release", "breaking change", "reasoning",
    "tool calling", "computer use", "context window", "embedding", "inference", "loss of control", "pace the frontier",
    "recursive self-improvement", "slow ai", "deprecation", "general availability", "preview",
]
LOW_VALUE_SIGNALS = ["documentation", "docs update", "typo", "minor fix"]
ARTICLE_SIGNALS = [
    "agentic", "ai agent", "ai chip", "ai regulation", "ai safety", "ai slowdown", "alignment", "benchmark", "coding agent",
    "computer use", "existential risk", "context window", "embedding", "gpu", "inference", "large language model",
    "loss of control", "llm", "mcp", "model release", "multimodal", "new model", "npu", "open weight", "post-training",
    "pace the frontier", "rag", "reasoning model", "reinforcement learning", "recursive self-improvement", "rerank",
    "tool calling", "human extinction",
]
MAJOR_SIGNALS = [
    "breaking change", "new architecture", "new model", "quantization", "speculative decoding", "distributed serving",
    "gpu support", "performance improvement", "performance milestone",
]
SAFETY_SIGNALS = [
    "ai safety", "ai slowdown", "alignment", "catastrophic risk", "could kill", "end humanity", "existential risk",
    "extinction risk", "halt ai", "human extinction", "kill us all", "loss of control", "moratorium", "pace the frontier",
    "pause ai", "recursive self-improvement", "slow ai", "slowdown", "third-party evaluator", "wipe out humanity",
]
AUTHORITY_SIGNALS = [
    "dario amodei", "sam altman", "elon musk", "demis hassabis", "evan hubinger", "jacob coxon", "ilya sutskever",
    "yoshua bengio", "geoffrey hinton", "yann lecun", "mustafa suleyman", "jan leike", "anthropic ceo", "anthropic researcher",
    "ex-anthropic researcher", "ai leaders", "openai ceo", "frontier lab",
]

# Labels of suggested actions.
ACTION_LABELS = {
    "suggest_demo": "Probarlo en una demo",
    "suggest_research_use": "Revisarlo para investigación",
    "suggest_internal_use_case": "Evaluar un caso de uso interno",
    "highlight_regulatory_impact": "Revisar el impacto regulatorio",
    "suggest_teaching_use": "Evaluar uso en clase",
    "suggest_course_update": "Actualizar el curso",
}

#: Four profiles and their terms, which occur in the test tables' texts; weights are decimal strings.
SAMPLE_PROFILES = [
    (1, "finance", "Finance", "F", True, [1, 2, 3]),
    (2, "teaching", "Teaching", "T", True, [2, 4]),
    (3, "research", "Research", "R", True, [1, 5, 6]),
    (4, "archive", "Archive", "A", False, [7]),
]
SAMPLE_TERMS = [
    (1, "topic", "tion", "0.30"), (1, "topic", "und", "0.25"), (1, "entity", "Que", "0.20"), (1, "entity", "idiot", "0.45"),
    (2, "topic", "der", "0.15"), (2, "topic", "license", "0.50"), (2, "entity", "Ble", "0.10"), (2, "entity", "http", "0.35"),
    (3, "topic", "ment", "0.20"), (3, "topic", "ción", "0.15"), (3, "entity", "Apache_License", "0.40"),
    (4, "topic", "the", "1.00"),
]


def validated_profiles(profiles: list[tuple], terms: list[tuple]) -> None:
    """Raise ValueError unless slugs are unique, a profile is enabled and each term belongs to a profile."""
    slugs = [p[1] for p in profiles]
    if len(set(slugs)) != len(slugs):
        raise ValueError("profile slugs must be unique")
    if not any(p[4] for p in profiles):
        raise ValueError("at least one profile must be enabled")
    if {t[0] for t in terms} - {p[0] for p in profiles}:
        raise ValueError("a term names an unknown profile")


def active_terms(profiles: list[tuple] = SAMPLE_PROFILES, terms: list[tuple] = SAMPLE_TERMS) -> list[tuple[str, str]]:
    """(text, weight) of enabled profiles: topics as they are, entities in lower case, underscores as spaces."""
    on = {p[0] for p in profiles if p[4]}
    return [((t if kind == "topic" else t.lower()).replace("_", " "), w) for p, kind, t, w in terms if p in on]


def profiles_table(spark: SparkSession, profiles: list[tuple] = SAMPLE_PROFILES, terms: list[tuple] = SAMPLE_TERMS) -> DataFrame:
    validated_profiles(profiles, terms)
    return spark.createDataFrame(profiles, PROFILE)


def terms_table(spark: SparkSession, terms: list[tuple] = SAMPLE_TERMS) -> DataFrame:
    return spark.createDataFrame(terms, TERM)
