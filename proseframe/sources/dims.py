"""Small tables: abbreviations by category, synonyms, variants. They can be read from JSON files too."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Abbreviations of four categories. The base dictionary is a JSON file, given by path.
CATEGORIES = {
    "policy": {"NGO": "Non-Governmental Organization", "RTI": "Right to Information", "NPR": "National Population Register"},
    "international": {"UN": "United Nations", "ASEAN": "Association of Southeast Asian Nations", "BRI": "Belt and Road Initiative"},
    "technology": {"AI": "Artificial Intelligence", "ML": "Machine Learning", "IOT": "Internet of Things"},
    "environment": {"GHG": "Greenhouse Gases", "RE": "Renewable Energy", "SDG": "Sustainable Development Goals"},
}
# Names of states that mean the same.
STATE_SYNONYMS = [
    ["South Korea", "Republic of Korea", "ROK"],
    ["The United States", "The United States of America"],
    ["North Korea", "Democratic People's Republic of Korea", "DPRK"],
    ["China", "People's Republic of China", "PRC"],
]


def read_dictionary(spark: SparkSession, path: str, category: str = "base", prio: int = 0) -> DataFrame:
    """A JSON object of abbreviations as rows (category, abbr, full, prio)."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("abbr", "full"))
    return raw.select(F.lit(category).alias("category"), F.trim("abbr").alias("abbr"), F.trim("full").alias("full"), F.lit(prio).alias("prio"))


def first_dictionary(paths: list[str]) -> dict[str, str]:
    """The first of the files that can be read and holds a non-empty object; {} if none does."""
    for p in map(Path, paths):
        try:
            d = json.loads(p.read_text(encoding="utf-8"))
        except (OSError, ValueError):
            continue
        if isinstance(d, dict) and d:
            return d
    return {}


def categories(spark: SparkSession, prio: int = 1) -> DataFrame:
    return spark.createDataFrame([(c, a, f, prio) for c, d in CATEGORIES.items() for a, f in d.items()], "category string, abbr string, full string, prio int")


def state_synonyms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(g, i, t) for g, ts in enumerate(STATE_SYNONYMS) for i, t in enumerate(ts)], "group_id int, ord int, term string")
