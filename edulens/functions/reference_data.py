"""Small fixed tables: areas, activity matrix, metric registry, alias lists."""

from __future__ import annotations

# Discipline areas in their order.
AREAS = (
    "mathematics_statistics",
    "computer_science_data",
    "physics_astronomy",
    "chemistry_materials",
    "biology_biotechnology",
    "earth_environment",
    "engineering_technology",
    "architecture_construction",
    "agriculture_veterinary",
    "medicine_health",
    "psychology_cognitive",
    "society_social_sciences",
    "economics_finance",
    "business_management",
    "law_policy_public_administration",
    "languages_linguistics_literature",
    "history_philosophy_humanities",
    "art_design_media",
    "education_pedagogy",
    "sport_tourism_hospitality",
    "safety_defense_transport",
    "universal_interdisciplinary",
)

# Share of each activity signal in an area; a row sums to 1.
ACTIVITY_WEIGHTS = {
    "mathematics_statistics": {"analytical": 0.50, "research": 0.20, "data": 0.25, "system_design": 0.05},
    "computer_science_data": {"software_creation": 0.35, "system_design": 0.25, "analytical": 0.15, "data": 0.25},
    "physics_astronomy": {"analytical": 0.25, "research": 0.20, "physical_engineering": 0.45, "system_design": 0.10},
    "chemistry_materials": {"research": 0.35, "analytical": 0.25, "physical_engineering": 0.30, "system_design": 0.10},
    "biology_biotechnology": {
        "research": 0.35, "analytical": 0.20, "data": 0.25, "communication": 0.10, "creative": 0.10,
    },
    "earth_environment": {
        "research": 0.25, "analytical": 0.20, "physical_engineering": 0.25, "data": 0.15, "communication": 0.10,
        "system_design": 0.05,
    },
    "engineering_technology": {
        "physical_engineering": 0.40, "system_design": 0.25, "analytical": 0.15, "research": 0.10, "creative": 0.05,
        "software_creation": 0.05,
    },
    "architecture_construction": {
        "system_design": 0.25, "creative": 0.35, "physical_engineering": 0.15, "communication": 0.10,
        "analytical": 0.10, "research": 0.05,
    },
    "agriculture_veterinary": {
        "research": 0.25, "physical_engineering": 0.20, "analytical": 0.15, "communication": 0.15, "creative": 0.10,
        "business": 0.15,
    },
    "medicine_health": {
        "research": 0.25, "analytical": 0.25, "communication": 0.30, "physical_engineering": 0.10, "data": 0.10,
    },
    "psychology_cognitive": {
        "research": 0.30, "analytical": 0.25, "communication": 0.30, "data": 0.10, "creative": 0.05,
    },
    "society_social_sciences": {
        "research": 0.20, "analytical": 0.20, "communication": 0.40, "data": 0.10, "business": 0.10,
    },
    "economics_finance": {
        "analytical": 0.30, "data": 0.25, "business": 0.30, "research": 0.10, "communication": 0.05,
    },
    "business_management": {
        "business": 0.45, "communication": 0.25, "analytical": 0.15, "creative": 0.10, "data": 0.05,
    },
    "law_policy_public_administration": {
        "communication": 0.40, "research": 0.20, "analytical": 0.20, "business": 0.15, "creative": 0.05,
    },
    "languages_linguistics_literature": {
        "communication": 0.50, "creative": 0.25, "research": 0.15, "analytical": 0.10,
    },
    "history_philosophy_humanities": {
        "research": 0.35, "communication": 0.30, "analytical": 0.20, "creative": 0.15,
    },
    "art_design_media": {
        "creative": 0.45, "communication": 0.25, "system_design": 0.10, "research": 0.05, "business": 0.10,
        "software_creation": 0.05,
    },
    "education_pedagogy": {
        "communication": 0.45, "research": 0.20, "creative": 0.15, "analytical": 0.10, "system_design": 0.10,
    },
    "sport_tourism_hospitality": {
        "communication": 0.35, "physical_engineering": 0.20, "business": 0.25, "creative": 0.10, "analytical": 0.10,
    },
    "safety_defense_transport": {
        "physical_engineering": 0.35, "system_design": 0.25, "analytical": 0.20, "communication": 0.10,
        "research": 0.10,
    },
    "universal_interdisciplinary": {
        "analytical": 0.15, "communication": 0.20, "research": 0.15, "creative": 0.15, "system_design": 0.15,
        "business": 0.10, "data": 0.10,
    },
}


def activity_rows() -> list[tuple[str, str, float]]:
    return [(a, s, w) for a, row in ACTIVITY_WEIGHTS.items() for s, w in row.items()]


def activity_table(spark):
    """(area, activity, activity_weight); at most 22 x 9 rows."""
    return spark.createDataFrame(activity_rows(), "area string, activity string, activity_weight double")
