"""Index definitions as small tables.

A definition names its areas and their benchmarks, the benchmarks that weigh
more, how areas are sized, which rule scores a benchmark, and its chance level.
Definitions in the published JSON form and the ones stated here give the same
tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Expected score of random guessing per benchmark id.
CHANCE = {
    1: 0.2592, 2: 0.1341, 3: 0.0189, 4: 0.0127, 5: 0.006, 9: 0.0, 11: 0.3085, 12: 0.3324, 20: 0.5, 21: 0.5,
    22: 0.0078, 23: 0.5, 25: 0.25, 28: 0.5, 29: 0.25, 30: 0.175, 31: 0.0819, 32: 0.371, 33: 0.0131, 36: 0.116,
    37: 0.2027, 38: 0.031, 39: 0.3201, 40: 0.2227, 41: 0.3333, 42: 0.486, 43: 0.3697, 44: 0.5, 45: 0.1641,
    48: 0.0, 50: 0.311, 56: 0.5, 57: 0.1109, 58: 0.3101, 59: 0.5177, 61: 0.5, 62: 0.25, 64: 0.2,
}

# Chance levels of the first chance-corrected edition where they differ.
CHANCE_02 = {**CHANCE, 2: 0.0937, 6: 0.5735, 10: 0.399, 36: 0.0448, 38: 0.0, 59: 0.4113}

# Benchmarks scored by track, benchmarks scored on answered fields, loss rule.
TRACK_SCORED = [1, 2, 11, 20, 21, 22, 23, 25, 30, 31, 36, 37, 40, 41, 43, 44, 50]
ADDED = [56, 57, 58, 59, 61, 62, 64]
LOSS = {48: (0.25, 0.0)}

# Areas and weights per edition.
EDITIONS = {
    "0.2": {
        "areas": {
            "knowledge": [25, 30, 31, 32, 33, 43, 44, 45, 57, 58],
            "language": [11, 12, 28, 29, 38, 39, 40, 41, 42, 59],
            "retrieval": [4, 5, 10, 36, 37, 56, 61],
            "tools": [1, 2, 3, 6, 9, 62],
            "arts": [20, 21, 22, 23, 48, 50, 64],
        },
        "fixed": {}, "sized": False, "gold": [], "track_scored": [*TRACK_SCORED, 6], "added": ADDED, "loss": LOSS,
        "chance": CHANCE_02, "shown": [24, 26, 27, 34], "tie": 0.25,
    },
    "0.2.1": {
        "areas": {
            "knowledge": [25, 30, 31, 32, 33, 43, 44, 45, 57, 58],
            "language": [11, 12, 28, 29, 38, 39, 40, 41, 42, 59],
            "retrieval": [4, 5, 36, 37, 56, 61],
            "tools": [1, 2, 3, 9, 62],
            "arts": [20, 21, 22, 23, 48, 50, 64],
        },
        "fixed": {"arts": 0.1}, "sized": True, "gold": [1, 3, 4, 5, 12, 25, 28, 29, 36, 45, 48, 57, 58],
        "track_scored": TRACK_SCORED, "added": ADDED, "loss": LOSS, "chance": CHANCE,
        "shown": [6, 10, 24, 26, 27, 34], "tie": 0.25,
    },
    "0.3": {
        "areas": {
            "knowledge": [25, 30, 31, 32, 33, 43, 44, 45, 57, 58, 28],
            "language": [11, 12, 29, 38, 39, 40, 41, 42, 59],
            "retrieval": [4, 5, 36, 37, 56, 61],
            "tools": [1, 2, 3, 9, 62],
            "arts": [20, 21, 22, 23, 50, 64],
        },
        "fixed": {"knowledge": 0.258494, "language": 0.258494, "retrieval": 0.200229, "tools": 0.182783, "arts": 0.1},
        "sized": True, "gold": [1, 3, 4, 5, 12, 25, 28, 29, 36, 45, 57, 58], "track_scored": TRACK_SCORED,
        "added": ADDED, "loss": {}, "chance": CHANCE, "shown": [6, 10, 24, 26, 27, 34], "tie": 0.25,
    },
}
GOLD_WEIGHT = 1.2

# Areas of the first edition's panel, the area that is folded into another, benchmarks that need a player
# in the loop (never run here), and the track that stands for a benchmark.
PANEL = {
    "knowledge": [24, 25, 30, 43, 44], "language": [11, 40, 41], "retrieval": [36, 37], "tools": [1, 2, 6, 7, 16],
    "arts": [20, 21, 22, 23, 50],
}
FOLDED, FOLDS = {"games": [31, 13, 15, 17, 19]}, {"games": "knowledge"}
INTERACTIVE = [7, 13, 15, 16, 17, 19]
HEADLINE = {40: "iSarcasmEval-A-En"}

# Other names of an edition, digests of its row files, benchmarks that are retired, and the prefix of the
# run ids that replace a benchmark's rows.
EDITION_ROWS = {
    "0.1": {
        "alias": "release-v1", "rows": "288d37207a9581187bdf83eada1983aa63de6fc50b0108e2badb229547a57f99", "added": None,
        "gsm8k": None, "retired": [], "replaced": {}, "scoreable": 131_980, "benchmarks": 37,
    },
    "0.2": {
        "alias": "release-v2", "rows": "b2b56d6fb636837ca469e689087bdbf373dda8de7638aa2da6793e6eda0792d5",
        "added": "7429f3c9cdddb772c1cfc42bb2a45e8516b0032152b746e6929f1c8b52f4ce89", "gsm8k": None, "retired": [], "replaced": {},
        "scoreable": 120_615, "benchmarks": 44,
    },
    "0.2.1": {
        "alias": "release-v2.1", "rows": "b2b56d6fb636837ca469e689087bdbf373dda8de7638aa2da6793e6eda0792d5",
        "added": "7429f3c9cdddb772c1cfc42bb2a45e8516b0032152b746e6929f1c8b52f4ce89", "gsm8k": None, "retired": [], "replaced": {},
        "scoreable": 119_898, "benchmarks": 44,
    },
    "0.3": {
        "alias": "release-v3", "rows": "b2b56d6fb636837ca469e689087bdbf373dda8de7638aa2da6793e6eda0792d5",
        "added": "7429f3c9cdddb772c1cfc42bb2a45e8516b0032152b746e6929f1c8b52f4ce89",
        "gsm8k": "759334894858a37d6bd7bd07298eac8e55da236e31dad327ccd06a9979f4738a", "retired": [48], "replaced": {30: "v0.3-gsm8k:"},
        "scoreable": 109_759, "benchmarks": 43,
    },
}
DEFAULT_EDITION = "0.3"

# Native metric of the benchmarks that are not scored by accuracy.
METRICS = {
    "macro_f1": [4, 5, 10, 11, 12, 37, 39, 41, 42],
    "positive_f1": [40, 59],
    "case_exact": [1, 9, 33, 38],
    "mean_value": [2, 6, 36, 48],
}
METRIC_OF = {n: metric for metric, ids in METRICS.items() for n in ids}

# Image benchmarks and their weights.
VISION_WEIGHTS = {
    "CV-Bench": 1.0, "BLINK": 1.0, "RealWorldQA": 1.0, "CharXiv": 1.0, "InfographicVQA": 1.0, "Mind2Web": 1.0,
    "Winoground": 1.0, "KIE (CORD+FUNSD)": 1.0, "Moderation (Hateful Memes)": 1.0, "R-Bench-M": 0.5,
    "MMMU-Pro vision": 0.25,
}

DIM = (
    "catalog_id int, area_id string, in_index boolean, rule string, gold_weight double, chance double, "
    "baseline double, best double, fixed double, metric string"
)


def from_published(spec: dict) -> dict:
    """A definition in its published JSON form as the form used here."""
    return {
        "areas": {a["id"]: a["benchmarks"] for a in spec["areas"]},
        "fixed": (spec.get("area_sizing") or {}).get("fixed", {}),
        "sized": bool(spec.get("area_sizing")),
        "gold": {int(n): w for n, w in spec.get("gold", {}).items()},
        "track_scored": spec["track_scored"],
        "added": [int(n) for n in spec["added"]],
        "loss": {int(n): (r["baseline"], r["best"]) for n, r in spec["loss_rules"].items()},
        "chance": {int(n): c["chance"] for n, c in spec["chance"].items()},
        "shown": [x["id"] for x in spec["not_in_index"]],
        "tie": spec["tie"],
    }


def dim_benchmark(spark: SparkSession, spec: dict) -> DataFrame:
    """One row per benchmark, counted or only shown."""
    gold = spec["gold"] if isinstance(spec["gold"], dict) else dict.fromkeys(spec["gold"], GOLD_WEIGHT)

    def rule(n: int) -> str:
        if n in spec["track_scored"]:
            return "track"
        if n in spec["loss"]:
            return "loss"
        return "added" if n in spec["added"] else "display"

    def row(n: int, area: str | None):
        baseline, best = spec["loss"].get(n, (None, None))
        chance = spec["chance"].get(n)
        return (n, area, area is not None, rule(n), gold.get(n), chance, baseline, best, spec["fixed"].get(area), METRIC_OF.get(n, "accuracy"))

    rows = [row(n, area) for area, ids in spec["areas"].items() for n in ids]
    rows += [row(n, None) for n in spec["shown"]]
    return spark.createDataFrame(rows, DIM)


def vision_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(VISION_WEIGHTS.items()), "benchmark string, weight double")


def dim_edition(spark: SparkSession) -> DataFrame:
    """One row for each published edition, with its other name and the digests of its row files."""
    rows = [(e, r["alias"], e == DEFAULT_EDITION, r["rows"], r["added"], r["gsm8k"], r["scoreable"], r["benchmarks"]) for e, r in EDITION_ROWS.items()]
    return spark.createDataFrame(
        rows, "edition string, alias string, is_default boolean, rows_sha256 string, added_sha256 string, gsm8k_sha256 string, scoreable long, benchmarks int"
    )


def edition_tables(spark: SparkSession, edition: str) -> tuple[DataFrame, DataFrame]:
    """``retired(catalog_id)`` and ``replaced(catalog_id, prefix)`` of an edition, as ``editions.in_edition`` takes them."""
    row = EDITION_ROWS[edition]
    return (
        spark.createDataFrame([(n,) for n in row["retired"]], "catalog_id int"),
        spark.createDataFrame(list(row["replaced"].items()), "catalog_id int, prefix string"),
    )


def panel_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The first edition's panel: members (area_id, catalog_id, folded, interactive), folds (area_id, into_area), heads (catalog_id, track)."""
    members = [(a, n, False, n in INTERACTIVE) for a, ids in PANEL.items() for n in ids] + [(a, n, True, n in INTERACTIVE) for a, ids in FOLDED.items() for n in ids]
    return (
        spark.createDataFrame(members, "area_id string, catalog_id int, folded boolean, interactive boolean"),
        spark.createDataFrame(list(FOLDS.items()), "area_id string, into_area string"),
        spark.createDataFrame(list(HEADLINE.items()), "catalog_id int, track string"),
    )
